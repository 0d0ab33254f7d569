"""Queries of the contact and link pipeline over the test tables, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.functions import classify, lite, phones, text, urls
from kavosh.functions.dicts import (
    AREA_CODES, CATEGORIES, CITIES, EMAIL_IN_TEXT, GENERAL, GENERIC_NAMES, MOBILE, OTHER_PRIORITY, PLATFORM_HOSTS, PRIORITIES, QUALITY, SKIP_EXTENSIONS, TECHNOLOGIES, TECHNOLOGY_ORDER, TRACKING_PARAMS,
)
from kavosh.operators import contacts, extract, frontier, layers, links
from kavosh.sources.tables import load, spread

c = F.col
_q = lambda s: "'" + s.replace("'", "''") + "'"
_DIGITS = f"translate(%s, {_q(phones.PERSIAN_DIGITS + phones.ARABIC_DIGITS)}, '01234567890123456789')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


# --- URLs --------------------------------------------------------------------------------

_AUTHORITY = r"regexp_extract(%s, '^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#\s]*)', 1)"
_SITE_KEY = rf"regexp_replace(regexp_replace(lower({_AUTHORITY}), ':\d*$', ''), '^www\.', '')"
_PATH = r"regexp_extract(%s, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1)"


def _site_key(x: str) -> str:
    return _SITE_KEY % x


def _canonical_sql(table: str, key: str, url: str) -> str:
    """(key, canonical, site_key) of each row of a table."""
    return rf"""(WITH u AS (SELECT {key} AS key, trim({url}) AS url FROM {table}),
p AS (SELECT key, lower(regexp_extract(url, '^\s*([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch, lower({_AUTHORITY % "url"}) AS net,
        regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '#.*$', '') AS rest, {_site_key("url")} AS site_key FROM u),
r AS (SELECT *, regexp_replace(regexp_extract(rest, '^([^?]*)', 1), ';[^/]*$', '') AS path, regexp_extract(rest, '\?(.*)$', 1) AS query FROM p),
k AS (SELECT key, regexp_extract(x, '^([^=]*)', 1) AS k, regexp_extract(x, '^[^=]*=(.*)$', 1) AS v FROM (SELECT key, unnest(string_split(query, '&')) AS x FROM r) WHERE x <> ''),
e AS (SELECT key, replace(replace(url_encode(url_decode(replace(k, '+', ' '))), '%20', '+'), '%7E', '~') AS k, replace(replace(url_encode(url_decode(replace(v, '+', ' '))), '%20', '+'), '%7E', '~') AS v FROM k),
g AS (SELECT key, string_agg(k || '=' || v, '&' ORDER BY k, v) AS q FROM e WHERE lower(k) NOT IN ({", ".join(map(_q, TRACKING_PARAMS))}) GROUP BY key)
SELECT r.key, CASE WHEN sch IN ('http', 'https') AND net <> '' THEN sch || '://' || net || CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(path, '/+$', '') END || coalesce('?' || q, '') END AS canonical, site_key
FROM r LEFT JOIN g USING (key))"""


@query(f"SELECT key AS url_id, canonical, site_key FROM {_canonical_sql('crawl_urls', 'url_id', 'url')}")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_urls").select("url_id", urls.canonical(c("url")).alias("canonical"), urls.site_key(c("url")).alias("site_key"))


@query(rf"""
SELECT url_id, CASE {" ".join(f"WHEN regexp_matches(lower({_PATH % 'url'}), {_q(w)}) THEN {n}" for n, w in PRIORITIES)} ELSE {OTHER_PRIORITY} END AS priority,
       regexp_matches(lower({_PATH % "url"}), '[.]({"|".join(SKIP_EXTENSIONS)})$') AS skipped
FROM crawl_urls WHERE url IS NOT NULL""")
def url_priority(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "crawl_urls").filter("url is not null")
    return u.select("url_id", urls.url_priority(c("url")).alias("priority"), urls.has_skipped_extension(c("url")).alias("skipped"))


@query(rf"""
SELECT target_domain, target_domain LIKE '%.ir.example' OR target_domain LIKE '%.test' OR target_domain = 'fehrest-iran.example' AS allowed,
       coalesce(regexp_matches(lower(target_domain), '(^|[.])({"|".join(h.replace(".", "[.]") for h in PLATFORM_HOSTS)})$'), false) AS platform, count(*) AS n_links
FROM discovered_links WHERE target_domain IS NOT NULL GROUP BY 1""")
def domain_classes(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "discovered_links").filter("target_domain is not null").groupBy("target_domain").agg(F.count("*").alias("n_links"))
    return e.select("target_domain", urls.is_allowed(c("target_domain"), ("fehrest-iran.example",), (".ir.example", ".test")).alias("allowed"), text.is_platform(c("target_domain")).alias("platform"), "n_links")


# --- phones, e-mails, words --------------------------------------------------------------

_PIECES = "SELECT id, trim(unnest(regexp_split_to_array(phones, '[,;|\\n\\t،؛]'))) AS raw FROM contacts WHERE phones IS NOT NULL"
_NATIONAL = f"regexp_replace(regexp_replace({_DIGITS % 'raw'}, '[^0-9]', '', 'g'), '^(?:0098|98)', '')"
_LANDLINE = f"0(?:{'|'.join(AREA_CODES)})[0-9]{{8}}"


@query(f"""
WITH p AS ({_PIECES}), d AS (SELECT *, {_NATIONAL} AS n FROM p WHERE raw <> ''),
f AS (SELECT *, CASE WHEN regexp_full_match(n, '9[0-9]{{9}}') THEN '0' || n ELSE n END AS m, CASE WHEN regexp_full_match(n, '[0-9]{{10}}') THEN '0' || n ELSE n END AS k FROM d)
SELECT id, CASE WHEN regexp_full_match(m, '0[0-9]{{10}}') THEN m ELSE raw END AS phone,
       CASE WHEN regexp_full_match(k, '{MOBILE}') THEN 'mobile' WHEN regexp_full_match(k, '{_LANDLINE}') THEN 'landline' ELSE '' END AS kind
FROM f""")
def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "contacts").select("id", F.explode(F.split("phones", r"[,;|\n\t،؛]")).alias("raw")).select("id", F.trim("raw").alias("raw")).filter("raw <> ''")
    return p.select("id", phones.normalize_iranian(c("raw")).alias("phone"), phones.classify_phone(c("raw")).alias("kind"))


_SIGNAL_PATTERNS = [p.replace("(?<![0-9])", "(?:^|[^0-9])(", 1).removesuffix("(?![0-9])") + ")(?:[^0-9]|$)" for p in phones.PHONE_PATTERNS]
_EMAIL_BODY = EMAIL_IN_TEXT.removeprefix(r"(?U)(?<![\w.+-])").removesuffix(r"(?![\w.-])")


# every character that may stand around a number or an address is doubled, so that patterns without look-around can take one copy on each side
@query(f"""
WITH t AS (SELECT id, concat_ws(' ; ', phones, emails, address, title) AS t FROM contacts),
d AS (SELECT id, regexp_replace({_DIGITS % "t"}, '([^0-9])', '\\1\\1', 'g') AS t FROM t),
h AS (SELECT id, regexp_replace(unnest({" || ".join(f"regexp_extract_all(t, {_q(p)}, 1)" for p in _SIGNAL_PATTERNS)}), '([^0-9])[^0-9]', '\\1', 'g') AS raw FROM d),
n AS (SELECT id, raw, {_NATIONAL} AS n FROM h), f AS (SELECT id, raw, CASE WHEN regexp_full_match(n, '9[0-9]{{9}}') THEN '0' || n ELSE n END AS m, CASE WHEN regexp_full_match(n, '[0-9]{{10}}') THEN '0' || n ELSE n END AS k FROM n),
p AS (SELECT id, string_agg(DISTINCT v, ',' ORDER BY v) AS phones FROM (SELECT id, CASE WHEN regexp_full_match(m, '0[0-9]{{10}}') THEN m ELSE trim(raw) END AS v FROM f WHERE regexp_full_match(k, '{MOBILE}') OR regexp_full_match(k, '{_LANDLINE}')) GROUP BY id),
m AS (SELECT id, lower(unnest(regexp_extract_all(regexp_replace(translate(t, chr(8203) || chr(8204), ''), '([^\\p{{L}}\\p{{M}}\\p{{N}}_.+@%-])', '\\1\\1', 'g'), {_q(r"(?:^|[^\p{L}\p{M}\p{N}_.+-])" + _EMAIL_BODY + r"(?:[^\p{L}\p{M}\p{N}_.-]|$)")}, 1))) AS e FROM t),
e AS (SELECT id, string_agg(DISTINCT e, ',' ORDER BY e) AS emails FROM m WHERE NOT contains(e, '..') AND length(e) <= 254 GROUP BY id)
SELECT id, coalesce(phones, '') AS phones, coalesce(emails, '') AS emails FROM t LEFT JOIN p USING (id) LEFT JOIN e USING (id)""")
def contact_signals(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and addresses found in free text."""
    t = load(spark, d, "contacts").select("id", F.concat_ws(" ; ", "phones", "emails", "address", "title").alias("t"))
    return t.select("id", F.array_join(phones.extract_phones(c("t")), ",").alias("phones"), F.array_join(text.extract_emails(c("t")), ",").alias("emails"))


_PLAIN = "lower(translate(%s, 'يك' || chr(8204), 'یک '))"


def _lite_sql(x: str, table: dict[str, tuple[str, ...]], default: str) -> str:
    return "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({x}), {_q(w)})" for w in ws) + f" THEN {_q(k)}" for k, ws in table.items()) + f" ELSE {default} END"


def _detect(x: str, table: dict[str, tuple[str, ...]], default: str) -> str:
    hits = {k: " + ".join(f"contains({x}, {_q(w.lower())})::INT" for w in ws) for k, ws in table.items()}
    best = f"greatest({', '.join(hits.values())})"
    return f"CASE WHEN {best} = 0 THEN {default} " + " ".join(f"WHEN {h} = {best} THEN {_q(k)}" for k, h in hits.items()) + " END"


@query(f"""
WITH t AS (SELECT id, {_PLAIN % "coalesce(title, '') || ' ' || coalesce(address, '')"} AS t, {_PLAIN % "coalesce(title, '') || ' ' || coalesce(domain, '')"} AS k FROM contacts)
SELECT id, {_detect("t", CITIES, "NULL")} AS city, {_detect("k", CATEGORIES, _q(GENERAL))} AS category FROM t""")
def city_category(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "contacts")
    both = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("address", F.lit("")))
    return t.select("id", text.detect_city(both).alias("city"), text.detect_category(c("title"), c("domain")).alias("category"))


_HOST = r"regexp_replace(regexp_replace(lower(trim(coalesce(domain, ''))), '^www\.', ''), '\.+$', '')"


@query(rf"""
WITH v AS (SELECT id, regexp_replace(regexp_replace(coalesce(business_name, ''), '\s+', ' ', 'g'), '^[ |:\-]+|[ |:\-]+$', '', 'g') AS v, {_HOST} AS h FROM contacts)
SELECT id, CASE WHEN length(v) < 2 OR length(v) > 120 OR lower(v) IN ({", ".join(map(_q, GENERIC_NAMES))}) OR lower(v) = h OR regexp_replace(lower(v), '^www\.', '') = h
  OR contains(lower(v), 'http://') OR contains(lower(v), 'https://') OR contains(lower(v), 'www.') OR len(string_split(v, ' ')) > 14
  OR length(v) - length(replace(v, ',', '')) > 4 OR length(v) - length(replace(v, '|', '')) > 1 OR len(regexp_extract_all(v, '[.!?]')) > 4 THEN '' ELSE v END AS name
FROM v""")
def name_clean(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "contacts").select("id", text.clean_business_name(c("business_name"), c("domain")).alias("name"))


_FULL = "coalesce(trim(%s), '') <> ''"


@query(f"""
SELECT id, round(least(CASE WHEN {_FULL % "phones"} THEN {QUALITY["phones"]} ELSE 0.0 END + CASE WHEN {_FULL % "emails"} THEN {QUALITY["emails"]} ELSE 0.0 END
  + CASE WHEN coalesce(trim(socials), '') NOT IN ('', '{{}}') THEN {QUALITY["socials"]} ELSE 0.0 END + CASE WHEN {_FULL % "technologies"} THEN {QUALITY["technologies"]} ELSE 0.0 END
  + CASE WHEN coalesce(business_name, '') <> coalesce(domain, '') THEN {QUALITY["name"]} ELSE 0.0 END + CASE WHEN coalesce(city, '') <> '' THEN {QUALITY["city"]} ELSE 0.0 END
  + CASE WHEN coalesce(address, '') <> '' THEN {QUALITY["address"]} ELSE 0.0 END, 1.0)::DOUBLE, 2) AS quality
FROM contacts""")
def quality_score(spark: SparkSession, d: str) -> DataFrame:
    full = lambda n: F.coalesce(F.trim(n), F.lit("")) != ""
    q = classify.quality_score(full("phones"), full("emails"), ~F.coalesce(F.trim("socials"), F.lit("")).isin("", "{}"), full("technologies"), c("business_name"), c("domain"), c("city"), c("address"))
    return load(spark, d, "contacts").select("id", q.alias("quality"))


# --- pages -------------------------------------------------------------------------------

_ESC = "replace(replace(coalesce(%s, ''), '&', '&amp;'), '<', '&lt;')"
_MOBILE_OF = "concat('0912', lpad(cast(id %% 10000000 as string), 7, '0'))".replace("%%", "%")
#: A page for each contact row, written the same way in both engines: its parts come back out of the extractors.
_HTML = f"""concat('<html><head><title> {_ESC % "title"} </title>'""".replace(f"{_ESC % 'title'}", f"', {_ESC % 'title'}, '") + f""", '<link rel="canonical" href="', {_ESC % "source_url"}, '"><meta property="og:site_name" content="', replace({_ESC % "business_name"}, '"', '&quot;'), '">',
  '<script type="application/ld+json">{{{{"@type": "Store", "telephone": "+98', substring({_MOBILE_OF}, 2, 10), '", "url": "/relative", "sameAs": ["https:\\\\/\\\\/linked.example\\\\/', cast(id % 50 as string), '" ], "logo": "https://img.example/l.png" }}}}</script>',
  '<script src="/wp-content/', lower(coalesce(technologies, '')), '.js"></script><meta http-equiv="refresh" content="5; url=/next"></head><body class=main data-v-', cast(id % 10 as string), '><p>', {_ESC % "business_name"},
  '</p><script>var x = "09351112233";</script><address>', {_ESC % "address"}, '</address><a href="/contact?id=', cast(id % 7 as string), '&amp;utm_source=x&amp;b=2">c&nbsp;</a><a href=''//cdn-host.example/a.css''>d</a><a href=tel:', {_MOBILE_OF}, '>t</a>',
  '<a href="mailto:Info', cast(id % 100 as string), '@Mail.example.com?subject=x">m</a><a href="https://www.instagram.com/shop', cast(id % 9 as string), '?a=1&amp;b=2">i</a><img src="/i.png" srcset="/s1.png 1x, /s2.png 2x"></body></html>')"""
_HTML = _HTML.replace("{{", "{").replace("}}", "}")
#: The same expression in the other engine, which reads no backslashes in strings.
_HTML_SQL = _HTML.replace("\\\\", "\\").replace("as string", "as varchar")
PAGES = f"SELECT id, source_url AS url, {_HTML_SQL} AS html FROM contacts WHERE source_url IS NOT NULL"
_SP = rf"[\s{text.SPACES}]+"


def _blanked(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}|{_SP}$', '', 'g')"


_VISIBLE = f"array_to_string(list_filter([{_blanked('coalesce(business_name, chr(32))')}, {_blanked('coalesce(address, chr(32))')}, 'c', 'd', 't', 'm', 'i'], lambda x: x <> ''), ' ')"


def pages(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "contacts").filter("source_url is not null").select("id", c("source_url").alias("url"), F.expr(_HTML).alias("html"))


@query(f"SELECT id, {_blanked('coalesce(title, chr(32))')} AS title, {_VISIBLE} AS visible FROM contacts WHERE source_url IS NOT NULL")
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("id", text.page_title(c("html")).alias("title"), text.visible_text(c("html")).alias("visible"))


def _tech_sql() -> str:
    found = []
    for name, rules in TECHNOLOGIES.items():
        where = {"html": "html", "header": "headers"}
        hit = [f"regexp_matches({where.get(w, 'url')}, {_q(p)}, 'i')" for p, _, w in rules]
        score = " + ".join(f"CASE WHEN {h} THEN {w} ELSE 0.0 END" for h, (_, w, _) in zip(hit, rules))
        top = "greatest(0.0, " + ", ".join(f"CASE WHEN {h} THEN {w} ELSE 0.0 END" for h, (_, w, _) in zip(hit, rules)) + ")"
        n = " + ".join(f"{h}::INT" for h in hit)
        places = " + ".join("greatest(0, " + ", ".join(f"{h}::INT" for h, (_, _, p) in zip(hit, rules) if p == place) + ")" for place in dict.fromkeys(p for _, _, p in rules))
        most = max(0.55 * sum(w for _, w, _ in rules), 0.01)
        found.append(f"SELECT id, {_q(name)} AS technology, round(least(({score})::DOUBLE / {most!r}::DOUBLE, 1.0), 2) AS confidence, {n} AS evidence_count, {top} AS top, {places} AS places FROM p")
    pages_sql = PAGES.replace(" AS html FROM", " AS html, CASE WHEN id % 3 = 0 THEN 'server: x; cf-ray: 1' WHEN id % 3 = 1 THEN 'set-cookie: laravel_session=1; xsrf-token' ELSE '' END AS headers FROM")
    return f"WITH p AS ({pages_sql}), a AS ({' UNION ALL '.join(found)}) SELECT id, technology, confidence, evidence_count::INT AS evidence_count FROM a WHERE top >= 0.9 OR ((evidence_count >= 2 OR places >= 2) AND confidence >= 0.35)"


@query(_tech_sql())
def tech_detect(spark: SparkSession, d: str) -> DataFrame:
    headers = F.when(c("id") % 3 == 0, "server: x; cf-ray: 1").when(c("id") % 3 == 1, "set-cookie: laravel_session=1; xsrf-token").otherwise("")
    found = spread(pages(spark, d)).select("id", F.explode(classify.detect_technologies(c("html"), c("url"), headers)).alias("t"))
    return found.select("id", c("t.name").alias("technology"), "t.confidence", "t.evidence_count")


_CRAWLED_SQL = rf"""site_key LIKE '%.ir.example' AND NOT regexp_matches(lower({_PATH % "canonical"}), '[.]({"|".join(SKIP_EXTENSIONS)})$')"""


@query(rf"""
WITH p AS (SELECT *, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) AS origin, regexp_extract(url, '^([A-Za-z]+:)', 1) AS sch FROM ({PAGES}) QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1),
l AS (SELECT url, unnest([{{'ord': 0, 'kind': 'anchor', 'to': origin || '/contact?id=' || id % 7 || '&utm_source=x&b=2'}}, {{'ord': 0, 'kind': 'anchor', 'to': sch || '//cdn-host.example/a.css'}}, {{'ord': 0, 'kind': 'anchor', 'to': 'https://www.instagram.com/shop' || id % 9 || '?a=1&b=2'}},
    {{'ord': 1, 'kind': 'canonical', 'to': url}}, {{'ord': 4, 'kind': 'image', 'to': origin || '/i.png'}}, {{'ord': 12, 'kind': 'srcset', 'to': origin || '/s1.png'}}, {{'ord': 12, 'kind': 'srcset', 'to': origin || '/s2.png'}},
    {{'ord': 13, 'kind': 'meta_refresh', 'to': origin || '/next'}}, {{'ord': 14, 'kind': 'jsonld', 'to': 'https://linked.example/' || id % 50}}, {{'ord': 14, 'kind': 'jsonld', 'to': 'https://img.example/l.png'}}], recursive := true) FROM p
  UNION ALL SELECT url, 3, 'script', origin || regexp_replace(regexp_extract(html, 'script src="([^"]*)"', 1), '^[ \t\r\n.,;:!?)\]}}''"]+|[ \t\r\n.,;:!?)\]}}''"]+$', '', 'g') FROM p
  UNION ALL SELECT url, 15, 'text_or_script', x FROM (SELECT url, unnest(list_transform(regexp_extract_all(html, '(?i)https?://[^\s<>]+'), lambda u: regexp_replace(u, '^[ \t\r\n.,;:!?)\]}}''"]+|[ \t\r\n.,;:!?)\]}}''"]+$', '', 'g'))) AS x FROM p)),
n AS (SELECT url, ord, kind, "to", row_number() OVER () AS k FROM l), s AS (SELECT n.url, n.ord, n.kind, x.canonical, x.site_key FROM n JOIN {_canonical_sql("n", "k", '"to"')} x ON x.key = n.k WHERE canonical IS NOT NULL),
f AS (SELECT url, canonical, site_key, arg_min(kind, ord) AS link_type FROM s GROUP BY 1, 2, 3)
SELECT url AS source_url, canonical AS target_url, site_key AS target_domain, site_key <> {_site_key("url")} AS external, link_type NOT IN ('script', 'image', 'srcset') AND {_CRAWLED_SQL} AS crawlable, link_type FROM f""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the pages, of each URL the first page."""
    first = pages(spark, d).groupBy("url").agg(F.min_by("html", "id").alias("html"))
    return links.page_links(first, (), (".ir.example",))


@query(f"""
WITH p AS (SELECT id, trim(unnest(string_split(technologies, ';'))) AS raw FROM contacts WHERE technologies IS NOT NULL),
n AS (SELECT id, trim(split_part(raw, '(', 1)) AS name FROM p WHERE raw <> ''),
o AS (SELECT DISTINCT id, name, coalesce(list_position([{", ".join(map(_q, TECHNOLOGY_ORDER))}], name), {len(TECHNOLOGY_ORDER) + 1}) AS r FROM n)
SELECT id, string_agg(name, '; ' ORDER BY r, lower(name), name) AS technologies FROM o GROUP BY id""")
def tech_format(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "contacts").filter("technologies is not null")
    names = F.filter(F.transform(F.split("technologies", ";"), lambda v: F.trim(v)), lambda x: x != "")
    techs = F.transform(names, lambda x: F.struct(F.trim(F.split_part(x, F.lit("("), F.lit(1))).alias("name"), F.lit(0.0).alias("confidence")))
    return t.select("id", classify.format_technologies(techs).alias("technologies")).filter("technologies <> ''")


# --- link graph --------------------------------------------------------------------------


@query("""
WITH k AS (SELECT source_url, target_url, unnest(string_split(link_type, ',')) AS kind, generate_subscripts(string_split(link_type, ','), 1) AS i, first_seen, id FROM discovered_links),
m AS (SELECT source_url, target_url, kind, min(first_seen || lpad(id::VARCHAR, 19, '0') || lpad(i::VARCHAR, 3, '0')) AS arrival FROM k GROUP BY 1, 2, 3),
t AS (SELECT source_url, target_url, string_agg(kind, ',' ORDER BY arrival) AS link_type FROM m GROUP BY 1, 2),
g AS (SELECT source_url, target_url, arg_min_null(target_domain, first_seen || lpad(id::VARCHAR, 19, '0')) AS target_domain, bool_or(external) AS external, bool_or(crawlable) AS crawlable, min(first_seen) AS first_seen FROM discovered_links GROUP BY 1, 2)
SELECT g.*, t.link_type FROM g JOIN t ON g.source_url IS NOT DISTINCT FROM t.source_url AND g.target_url IS NOT DISTINCT FROM t.target_url""")
def links_fold(spark: SparkSession, d: str) -> DataFrame:
    return links.fold_links(load(spark, d, "discovered_links"))


#: The state table after a new cycle began with batch 9: what failed before may be tried again.
_CYCLE = "WITH cu AS (SELECT * REPLACE (CASE WHEN status = 'failed' AND batch_no < 9 THEN 'retry_pending' ELSE status END AS status) FROM crawl_urls)"


def cycle(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "crawl_urls").withColumn("status", F.when((c("status") == "failed") & (c("batch_no") < 9), "retry_pending").otherwise(c("status")))


_STATE = """
SELECT e.*, CASE WHEN NOT coalesce(e.crawlable, false) THEN 'NON_CRAWLABLE' WHEN u.status = 'crawled' THEN 'CRAWLED' WHEN u.status = 'queued' THEN 'QUEUED' WHEN u.status = 'failed' AND u.failure_reason ILIKE 'robots%' THEN 'ROBOTS_BLOCKED'
  WHEN u.status = 'failed' THEN 'FAILED' WHEN u.status = 'retry_pending' THEN 'RETRY_PENDING' ELSE 'DISCOVERED' END AS crawl_status
FROM discovered_links e LEFT JOIN (SELECT * FROM cu WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen DESC, url_id DESC) = 1) u ON e.target_url = u.url"""


@query(f"{_CYCLE} SELECT target_domain, crawl_status, count(*) AS n_links FROM ({_STATE}) GROUP BY 1, 2")
def links_status(spark: SparkSession, d: str) -> DataFrame:
    state = links.target_state(load(spark, d, "discovered_links"), cycle(spark, d))
    return state.groupBy("target_domain", "crawl_status").agg(F.count("*").alias("n_links"))


_SHOP = "external AND NOT crawlable AND (source_url ILIKE '%shop%' OR target_url ILIKE '%shop%' OR target_domain ILIKE '%shop%')"


@query(f"{_CYCLE}, f AS (SELECT id, source_url, target_url, crawl_status, first_seen FROM ({_STATE}) WHERE {_SHOP}) SELECT id, source_url, target_url, crawl_status, (SELECT count(*) FROM f) AS total, (SELECT greatest(1, ceil(count(*) / 50))::INT FROM f) AS total_pages FROM f ORDER BY first_seen DESC, id LIMIT 50 OFFSET 50")
def links_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a searched list, 50 a page, with the list's total and number of pages."""
    found = links.search_links(load(spark, d, "discovered_links"), "shop", links.crawlable_flag("denied"))
    shown = links.with_totals(found, 2, 50, c("first_seen").desc(), c("id"))
    return links.target_state(shown, cycle(spark, d)).select("id", "source_url", "target_url", "crawl_status", "total", "total_pages")


@query(f"{_CYCLE} SELECT {', '.join(links.LINK_COLUMNS)} FROM ({_STATE}) WHERE external AND NOT crawlable")
def links_denied(spark: SparkSession, d: str) -> DataFrame:
    """The list of external links that may not be crawled, as it is downloaded."""
    return links.link_list(load(spark, d, "discovered_links"), cycle(spark, d), crawlable_only=False)


@query("""
SELECT * FROM (SELECT count(*) AS n_links, count(DISTINCT target_domain) FILTER (WHERE external) AS n_external_domains, count(*) FILTER (WHERE crawlable) AS n_crawlable FROM discovered_links),
 (SELECT count(*) FILTER (WHERE status = 'crawled') AS n_crawled, count(DISTINCT domain) FILTER (WHERE status = 'crawled') AS n_domains, count(*) FILTER (WHERE status IN ('failed', 'retry_pending')) AS n_failed, count(*) FILTER (WHERE failure_reason ILIKE 'robots%') AS n_robots FROM crawl_urls)""")
def crawl_figures(spark: SparkSession, d: str) -> DataFrame:
    return links.crawl_figures(load(spark, d, "discovered_links"), load(spark, d, "crawl_urls"))


@query(f"""
{_CYCLE}, u AS (SELECT url FROM (SELECT url, status FROM cu WHERE url IS NOT NULL QUALIFY row_number() OVER (PARTITION BY url ORDER BY first_seen DESC, url_id DESC) = 1) WHERE status <> 'retry_pending'),
t AS (SELECT target_domain, target_url, min(first_seen) AS first_seen FROM discovered_links WHERE crawlable AND target_domain IS NOT NULL AND target_url NOT IN (SELECT url FROM u) GROUP BY 1, 2)
SELECT target_domain, target_url, first_seen, row_number() OVER (PARTITION BY target_domain ORDER BY first_seen, target_url)::INT AS place FROM t QUALIFY place <= 20""")
def frontier_batch(spark: SparkSession, d: str) -> DataFrame:
    return links.next_batch(load(spark, d, "discovered_links"), cycle(spark, d), 20)


@query("""
WITH k AS (SELECT source_url, target_url, unnest(string_split(link_type, ',')) AS kind, generate_subscripts(string_split(link_type, ','), 1) AS i, (first_seen >= '2024-02-01') AS late, first_seen, id FROM discovered_links),
m AS (SELECT source_url, target_url, kind, min(late::INT::VARCHAR || first_seen || lpad(id::VARCHAR, 19, '0') || lpad(i::VARCHAR, 3, '0')) AS arrival FROM k GROUP BY 1, 2, 3),
t AS (SELECT source_url, target_url, string_agg(kind, ',' ORDER BY arrival) AS link_type FROM m GROUP BY 1, 2),
g AS (SELECT source_url, target_url, arg_min_null(target_domain, first_seen || lpad(id::VARCHAR, 19, '0')) AS target_domain, bool_or(external) AS external, bool_or(crawlable) AS crawlable, min(first_seen) AS first_seen FROM discovered_links GROUP BY 1, 2)
SELECT g.*, t.link_type FROM g JOIN t ON g.source_url IS NOT DISTINCT FROM t.source_url AND g.target_url IS NOT DISTINCT FROM t.target_url""")
def links_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored edges of January with all later ones folded in."""
    e = load(spark, d, "discovered_links")
    return links.merged_links(links.fold_links(e.filter("first_seen < '2024-02-01'")), e.filter("first_seen >= '2024-02-01'"))


# --- states of URLs ----------------------------------------------------------------------

# A log of each URL row: reserved, or queued as a seed; then crawled or failed; every third batch begins with a reset.
_LOG = """
log AS (SELECT batch_no::BIGINT * 10000000000 + url_id * 10 + 1 AS seq, CASE WHEN source_url IS NULL THEN 'reserve_seed' ELSE 'reserve' END AS op, url, domain, source_url, NULL AS reason, first_seen AS "at" FROM crawl_urls
  UNION ALL SELECT batch_no::BIGINT * 10000000000 + url_id * 10 + 2, CASE WHEN status = 'crawled' THEN 'crawled' ELSE 'failed' END, url, NULL, NULL, CASE WHEN status = 'blocked' THEN 'robots.txt' ELSE failure_reason END, coalesce(crawled_at, first_seen) FROM crawl_urls WHERE status <> 'queued'
  UNION ALL SELECT batch_no::BIGINT * 10000000000, 'reset', NULL, NULL, NULL, NULL, NULL FROM crawl_batches WHERE batch_no % 3 = 0)"""


def url_log(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "crawl_urls")
    base, none = c("batch_no").cast("bigint") * 10000000000, F.lit(None).cast("string")
    opened = u.select((base + c("url_id") * 10 + 1).alias("seq"), F.when(c("source_url").isNull(), "reserve_seed").otherwise("reserve").alias("op"), "url", "domain", "source_url", none.alias("reason"), c("first_seen").alias("at"))
    done = u.filter("status <> 'queued'").select(
        (base + c("url_id") * 10 + 2).alias("seq"), F.when(c("status") == "crawled", "crawled").otherwise("failed").alias("op"), "url", none.alias("domain"), none.alias("source_url"),
        F.when(c("status") == "blocked", "robots.txt").otherwise(c("failure_reason")).alias("reason"), F.coalesce("crawled_at", "first_seen").alias("at"),
    )
    resets = load(spark, d, "crawl_batches").filter("batch_no % 3 = 0").select(base.alias("seq"), F.lit("reset").alias("op"), *[none.alias(x) for x in ("url", "domain", "source_url", "reason", "at")])
    return opened.unionByName(done).unionByName(resets)


# in SQL: each operation with those after it looked up by windows, not by the last of each kind
_STATES = f"""{_LOG},
o AS (SELECT *, count(*) FILTER (WHERE op LIKE 'reserve%') OVER w > 0 AS there, max(CASE WHEN op = 'reserve_seed' THEN seq END) OVER (PARTITION BY url) AS seed, (SELECT max(seq) FROM log WHERE op = 'reset') AS reset
  FROM log WHERE url IS NOT NULL WINDOW w AS (PARTITION BY url ORDER BY seq ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq) AS n, (op = 'reserve' AND n_before > 0) AS idle FROM (SELECT *, count(*) OVER (PARTITION BY url ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n_before FROM o WHERE there)),
l AS (SELECT * FROM e WHERE NOT idle QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1), b AS (SELECT * FROM e WHERE CASE WHEN seed IS NULL THEN n = 1 ELSE seq = seed END),
states AS (SELECT l.url, b.domain, CASE WHEN l.op = 'crawled' THEN 'crawled' WHEN l.op = 'failed' THEN CASE WHEN l.reset > l.seq THEN 'retry_pending' ELSE 'failed' END ELSE 'queued' END AS status, b.source_url, b."at" AS first_seen, c."at" AS crawled_at, nullif(trim(f.reason), '') AS failure_reason
  FROM l JOIN b USING (url) LEFT JOIN (SELECT url, e."at" FROM e WHERE op = 'crawled' AND seq > coalesce(seed, -1) QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) c USING (url)
  LEFT JOIN (SELECT url, reason FROM e WHERE op IN ('crawled', 'failed') QUALIFY row_number() OVER (PARTITION BY url ORDER BY seq DESC) = 1) f USING (url))"""


@query(f"WITH {_STATES} SELECT * FROM states")
def url_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each URL after the whole log."""
    return frontier.url_states(url_log(spark, d))


@query(f"""
WITH {_LOG}, s AS (SELECT a.seq, a.url, (SELECT max(b.seq) FROM log b WHERE b.url = a.url AND b.seq < a.seq AND b.op <> 'reserve') AS last, EXISTS (SELECT 1 FROM log b WHERE b.url = a.url AND b.seq < a.seq AND b.op LIKE 'reserve%') AS there FROM log a WHERE op = 'reserve' AND url IS NOT NULL)
SELECT seq, url, NOT there OR EXISTS (SELECT 1 FROM log f, log r WHERE f.seq = s.last AND f.op = 'failed' AND r.op = 'reset' AND r.seq > f.seq AND r.seq < s.seq) AS granted FROM s""")
def url_reservations(spark: SparkSession, d: str) -> DataFrame:
    """Which reservations were granted when they were asked for."""
    return frontier.reservations(url_log(spark, d))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_url, target_url FROM discovered_links WHERE crawlable AND target_url IS NOT NULL),
r(url, depth) AS (SELECT DISTINCT source_url, 0 FROM discovered_links WHERE source_url LIKE 'https://fehrest-iran.example/%' UNION SELECT e.target_url, r.depth + 1 FROM r JOIN e ON e.source_url = r.url WHERE r.depth < 3)
SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")
def layered_closure(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "discovered_links")
    return layers.layers(e.filter("crawlable"), e.filter("source_url like 'https://fehrest-iran.example/%'").select(c("source_url").alias("url")), 3)


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT source_url, target_url FROM discovered_links WHERE crawlable AND target_url IS NOT NULL),
r(url, depth) AS (SELECT DISTINCT source_url, 0 FROM discovered_links WHERE source_url LIKE 'https://fehrest-iran.example/%' UNION SELECT e.target_url, r.depth + 1 FROM r JOIN e ON e.source_url = r.url WHERE r.depth < 40)
SELECT url, min(depth)::INT AS depth FROM r GROUP BY url""")
def link_closure(spark: SparkSession, d: str) -> DataFrame:
    """Everything a directory's pages lead to, however many links away (on the test tables less than 40)."""
    e = load(spark, d, "discovered_links")
    return layers.layers(e.filter("crawlable"), e.filter("source_url like 'https://fehrest-iran.example/%'").select(c("source_url").alias("url")))


# Layer state of each URL under the host that led to it, from the state table alone.
_LAYERS = "SELECT domain AS seed_url, url, (url_id % 4)::INT AS depth, CASE status WHEN 'queued' THEN 'queued' WHEN 'failed' THEN 'pending' ELSE status END AS status FROM crawl_urls WHERE domain IS NOT NULL AND url IS NOT NULL"


def _layer_state(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "crawl_urls").filter("domain is not null and url is not null")
    return u.select(c("domain").alias("seed_url"), "url", (c("url_id") % 4).cast("int").alias("depth"), F.when(c("status") == "failed", "pending").otherwise(c("status")).alias("status"))


@query(f"WITH s AS ({_LAYERS}), o AS (SELECT seed_url, min(depth) AS o FROM s WHERE status IN ('pending', 'queued') GROUP BY 1) SELECT seed_url, url, depth, status FROM s JOIN o USING (seed_url) WHERE depth = o AND status = 'pending'")
def layer_open(spark: SparkSession, d: str) -> DataFrame:
    return layers.lowest_open_layer(_layer_state(spark, d))


@query(f"WITH s AS ({_LAYERS}) SELECT seed_url, min(depth) AS depth FROM s a WHERE status = 'crawled' AND NOT EXISTS (SELECT 1 FROM s b WHERE b.seed_url = a.seed_url AND b.status IN ('pending', 'queued') AND b.depth <= (SELECT min(depth) FROM s m WHERE m.seed_url = a.seed_url AND m.status = 'crawled')) GROUP BY 1")
def layer_finished(spark: SparkSession, d: str) -> DataFrame:
    return layers.finished_depth(_layer_state(spark, d))


_FULL_LAYERS = "SELECT seed_url, url, min(depth)::INT AS depth, arg_max(status, k) AS status, arg_min(source_url, k) AS source_url, min(first_seen) AS first_seen, NULL::VARCHAR AS crawled_at FROM (SELECT domain AS seed_url, url, url_id % 4 AS depth, CASE status WHEN 'failed' THEN 'pending' ELSE status END AS status, coalesce(source_url, '') AS source_url, first_seen, url_id AS k FROM crawl_urls WHERE domain IS NOT NULL AND url IS NOT NULL) GROUP BY 1, 2"


def _full_layers(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "crawl_urls").filter("domain is not null and url is not null").withColumn("status", F.when(c("status") == "failed", "pending").otherwise(c("status")))
    return u.groupBy(c("domain").alias("seed_url"), "url").agg(
        F.min(c("url_id") % 4).cast("int").alias("depth"), F.max_by("status", "url_id").alias("status"), F.min_by(F.coalesce("source_url", F.lit("")), "url_id").alias("source_url"), F.min("first_seen").alias("first_seen"), F.lit(None).cast("string").alias("crawled_at"))


@query(f"""
WITH s AS MATERIALIZED ({_FULL_LAYERS}), d AS (SELECT seed_url, min(depth) FILTER (WHERE status = 'crawled') AS done, min(depth) FILTER (WHERE status IN ('pending', 'queued')) AS o FROM s GROUP BY 1),
p AS (SELECT s.* FROM s JOIN d USING (seed_url) WHERE s.depth = done AND s.status = 'crawled' AND (o IS NULL OR o > done)),
n AS (SELECT p.seed_url, e.target_url AS url, min(p.depth + 1) AS depth, arg_min(p.url, e.first_seen || p.url) AS source_url, min(e.first_seen) AS first_seen FROM p JOIN discovered_links e ON e.source_url = p.url WHERE e.crawlable AND e.target_url IS NOT NULL GROUP BY 1, 2),
k AS (SELECT DISTINCT url FROM crawl_urls WHERE status = 'crawled')
SELECT coalesce(s.seed_url, n.seed_url) AS seed_url, coalesce(s.url, n.url) AS url, least(s.depth, n.depth) AS depth, coalesce(s.status, CASE WHEN n.url IN (SELECT url FROM k) THEN 'crawled' ELSE 'pending' END) AS status, coalesce(s.source_url, n.source_url) AS source_url,
  coalesce(s.first_seen, n.first_seen) AS first_seen, CASE WHEN s.url IS NULL AND n.url IN (SELECT url FROM k) THEN '2024-06-01T00:00:00' END AS crawled_at FROM s FULL JOIN n ON s.seed_url = n.seed_url AND s.url = n.url""")
def layers_advanced(spark: SparkSession, d: str) -> DataFrame:
    """The layered state after every site went on from its lowest finished layer."""
    return frontier.advance_layered(_full_layers(spark, d), load(spark, d, "discovered_links"), load(spark, d, "crawl_urls"), "2024-06-01T00:00:00")


@query("""
WITH q AS (SELECT url_id, url FROM crawl_urls WHERE status = 'queued' AND url IS NOT NULL), a AS (SELECT DISTINCT target_url AS url FROM discovered_links WHERE target_url IS NOT NULL), k AS (SELECT DISTINCT url FROM crawl_urls WHERE status = 'crawled')
SELECT url_id, url, CASE WHEN url IN (SELECT url FROM k) THEN 'crawled' ELSE 'pending' END AS status FROM q WHERE url NOT IN (SELECT url FROM a)""")
def queue_reconciled(spark: SparkSession, d: str) -> DataFrame:
    u = load(spark, d, "crawl_urls").filter("url is not null")
    active = load(spark, d, "discovered_links").select(c("target_url").alias("url")).filter("url is not null")
    return layers.reconciled(u.filter("status = 'queued'").select("url_id", "url"), active, u.filter("status = 'crawled'"))


# --- contacts and sites ------------------------------------------------------------------

_SPLIT = "list_filter(list_transform(string_split(coalesce(%s, ''), ','), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""
WITH k AS (SELECT id, 'd:' || coalesce(domain, '') AS key FROM contacts UNION ALL SELECT id, 'p:' || unnest({_SPLIT % "phones"}) FROM contacts UNION ALL SELECT id, 'e:' || unnest({_SPLIT % "emails"}) FROM contacts),
f AS (SELECT DISTINCT id FROM (SELECT key, min(id) AS id FROM k GROUP BY key))
SELECT id FROM contacts WHERE id IN (SELECT id FROM f) OR coalesce(trim(socials), '') NOT IN ('', '{{}}', '[]', 'null') OR coalesce(trim(technologies), '') NOT IN ('', '{{}}', '[]', 'null')""")
def contacts_new(spark: SparkSession, d: str) -> DataFrame:
    return contacts.newcomers(load(spark, d, "contacts")).select("id")


@query("""
WITH old AS (SELECT * FROM contacts WHERE batch_no < 6), new AS (SELECT * FROM contacts WHERE batch_no >= 6)
SELECT id FROM (SELECT id, source_url, coalesce(phones, '') AS p, coalesce(source_url, '') AS s, row_number() OVER (PARTITION BY coalesce(source_url, ''), coalesce(phones, '') ORDER BY id) AS n FROM new) x
WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE coalesce(o.source_url, '') = x.s AND coalesce(o.phones, '') = x.p)""")
def contacts_insert(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "contacts")
    return contacts.insert_ignore(t.filter("batch_no < 6"), t.filter("batch_no >= 6")).select("id")


@query("SELECT id, domain, city FROM contacts WHERE (domain ILIKE '%gol%' OR phones ILIKE '%gol%' OR emails ILIKE '%gol%' OR business_name ILIKE '%gol%') AND technologies ILIKE '%wordpress%' AND city = 'تهران'")
def contact_search(spark: SparkSession, d: str) -> DataFrame:
    return contacts.search(load(spark, d, "contacts"), "gol", "wordpress", "تهران").select("id", "domain", "city")


def _merged(column: str, by: str, joiner: str) -> str:
    split = f"string_split(coalesce({column}, ''), {by})"
    return f"""(SELECT domain, string_agg(v, {joiner} ORDER BY place) AS {column} FROM (SELECT domain, v, min(place) AS place FROM (
      SELECT domain, trim(v) AS v, o * 100000 + i AS place FROM (SELECT domain, o, unnest({split}) AS v, generate_subscripts({split}, 1) AS i FROM r)) WHERE v <> '' GROUP BY domain, v) GROUP BY domain)"""


def _longest(column: str) -> str:
    return f"(SELECT domain, trim({column}) AS {column} FROM r WHERE trim(coalesce({column}, '')) <> '' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY length(trim({column})) DESC, o) = 1)"


_LATEST = "crawled_at DESC NULLS LAST, id"
_PROFILES = f"""(SELECT domain, network, profile FROM (SELECT domain, o, e.key AS network, CASE WHEN e.type = 'VARCHAR' THEN e.value ->> '$' ELSE e.value::VARCHAR END AS profile
  FROM (SELECT coalesce(domain, '') AS domain, socials, row_number() OVER (ORDER BY {_LATEST}) AS o FROM contacts WHERE json_valid(socials) AND json_type(socials) = 'OBJECT') c, json_each(c.socials) e)
  WHERE trim(profile) <> '' QUALIFY row_number() OVER (PARTITION BY domain, network ORDER BY o, profile) = 1)"""
#: ev: evidence of each row; es: lists of sources by field; ev_values: each page and source of a site with its first place; ev_sums: counts of links.
_EVIDENCE = f"""
ev AS MATERIALIZED (SELECT coalesce(domain, '') AS domain, source_url, CASE WHEN json_valid(evidence) AND json_type(evidence) = 'OBJECT' THEN evidence::JSON ELSE '{{}}'::JSON END AS e, row_number() OVER (ORDER BY {_LATEST}) AS o FROM contacts),
es AS (SELECT domain, o, j.key AS field, CASE WHEN j.type = 'ARRAY' THEN from_json(j.value, '["VARCHAR"]') ELSE [j.value ->> '$'] END AS l FROM (SELECT domain, o, CASE WHEN json_exists(e, '$.field_sources') THEN e -> 'field_sources' ELSE e END AS f FROM ev) x, json_each(x.f) j
  WHERE j.key NOT IN ('page', 'field_sources', 'tel_links', 'mailto_links')),
ev_values AS (SELECT domain, field, value, min(o * 100000 + i) AS place FROM (SELECT domain, field, o, unnest(l) AS value, generate_subscripts(l, 1) AS i FROM es UNION ALL SELECT domain, 'page', o, coalesce(e ->> 'page', source_url), 0 FROM ev) WHERE value IS NOT NULL GROUP BY 1, 2, 3),
ev_sums AS (SELECT domain, sum(greatest(coalesce((e ->> 'tel_links')::INT, 0), 0)) AS t, sum(greatest(coalesce((e ->> 'mailto_links')::INT, 0), 0)) AS m FROM ev GROUP BY 1),
ev_fields AS (SELECT domain, string_agg(to_json(field)::VARCHAR || ':' || coalesce(l, '[]'), ',' ORDER BY field) AS fields FROM (SELECT DISTINCT domain, field FROM es) LEFT JOIN (SELECT domain, field, to_json(list(value ORDER BY place))::VARCHAR AS l FROM ev_values WHERE field <> 'page' GROUP BY 1, 2) USING (domain, field) GROUP BY 1),
ev_pages AS (SELECT domain, to_json(list(value ORDER BY place))::VARCHAR AS pages FROM ev_values WHERE field = 'page' GROUP BY 1)"""
_EVIDENCE_JSON = """(SELECT domain, '{' || array_to_string(list_filter([CASE WHEN pages IS NOT NULL THEN '"pages":' || pages END, CASE WHEN fields IS NOT NULL THEN '"field_sources":{' || fields || '}' END,
  CASE WHEN t <> 0 THEN '"tel_links":' || t END, CASE WHEN m <> 0 THEN '"mailto_links":' || m END], lambda x: x IS NOT NULL), ',') || '}' AS evidence FROM ev_sums LEFT JOIN ev_pages USING (domain) LEFT JOIN ev_fields USING (domain))"""
_SITES = f"""
r AS MATERIALIZED (SELECT * REPLACE (coalesce(domain, '') AS domain), row_number() OVER (PARTITION BY coalesce(domain, '') ORDER BY {_LATEST}) AS o FROM contacts),
s AS (SELECT domain, coalesce(round(max(quality_score), 2), 0.0) AS quality_score, max(crawled_at) AS crawled_at, count(*) AS n_rows FROM r GROUP BY 1),
t AS (SELECT domain, trim(title) AS title FROM r WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY domain ORDER BY o) = 1),
one AS (SELECT s.*, t.title, {", ".join(f"coalesce({x}.{x}, '') AS {x}" for x in ("address", "business_name", "category", "city", "source_url"))}
  FROM s LEFT JOIN t USING (domain) {" ".join(f"LEFT JOIN {_longest(x)} {x} USING (domain)" for x in ("address", "business_name", "category", "city"))} LEFT JOIN {_merged("source_url", "chr(10)", "','")} source_url USING (domain))"""


@query(f"""
WITH {_SITES}, {_EVIDENCE}
SELECT one.*, {", ".join(f"coalesce({x}.{x}, '') AS {x}" for x in ("phones", "emails", "technologies"))}, coalesce(socials, '{{}}') AS socials, evidence FROM one JOIN {_EVIDENCE_JSON} evidence USING (domain)
LEFT JOIN (SELECT domain, '{{' || string_agg(to_json(network)::VARCHAR || ':' || to_json(profile)::VARCHAR, ',' ORDER BY network) || '}}' AS socials FROM {_PROFILES} GROUP BY 1) socials USING (domain)
LEFT JOIN {_merged("phones", "','", "','")} phones USING (domain) LEFT JOIN {_merged("emails", "','", "','")} emails USING (domain) LEFT JOIN {_merged("technologies", "';'", "'; '")} technologies USING (domain)""")
def site_export(spark: SparkSession, d: str) -> DataFrame:
    return contacts.sites(load(spark, d, "contacts"))


def _kind(x: str) -> str:
    k = f"(CASE WHEN regexp_full_match({x}, '[0-9]{{10}}') THEN '0' || {x} ELSE {x} END)"
    return f"CASE WHEN regexp_full_match({k}, '{MOBILE}') THEN 'mobile' WHEN regexp_full_match({k}, '{_LANDLINE}') THEN 'landline' ELSE '' END"


def _panel_sql(where: str = "true") -> str:
    def merged(column: str, by: str, joiner: str) -> str:
        split = f"string_split(coalesce({column}, ''), {by})"
        return f"(SELECT site, list(v ORDER BY place) AS l, string_agg(v, {joiner} ORDER BY place) AS {column} FROM (SELECT site, v, min(place) AS place FROM (SELECT site, {_blanked('v')} AS v, o * 100000 + i AS place FROM (SELECT site, o, unnest({split}) AS v, generate_subscripts({split}, 1) AS i FROM r)) WHERE v <> '' GROUP BY site, v) GROUP BY site)"

    kind = lambda k: f"coalesce(array_to_string(list_filter(phones.l, lambda x: ({_kind(_NATIONAL.replace('raw', 'x'))}) = '{k}'), ','), '')"
    one = lambda x, order: f"(SELECT site, {x} FROM r WHERE trim(coalesce({x}, '')) <> '' QUALIFY row_number() OVER (PARTITION BY site ORDER BY {order}) = 1)"
    return f"""
r AS (SELECT *, lower(trim(domain)) AS site, row_number() OVER (PARTITION BY lower(trim(domain)) ORDER BY crawled_at NULLS FIRST, id) AS o FROM contacts WHERE lower(trim(domain)) <> '' AND {where}),
panel AS (SELECT s.*, city.city, category.category, u.source_url, coalesce(phones.phones, '') AS phones, coalesce(emails.emails, '') AS emails, coalesce(technologies.technologies, '') AS technologies, {kind("mobile")} AS mobiles, {kind("landline")} AS landlines
 FROM (SELECT site, max(crawled_at) AS crawled_at, count(*) AS n_rows FROM r GROUP BY 1) s LEFT JOIN {one("city", "o DESC")} city USING (site) LEFT JOIN {one("category", "o DESC")} category USING (site) LEFT JOIN {one("source_url", "o")} u USING (site)
 LEFT JOIN {merged("phones", "','", "','")} phones USING (site) LEFT JOIN {merged("emails", "','", "','")} emails USING (site) LEFT JOIN {merged("technologies", "';'", "'; '")} technologies USING (site))"""



@query(f"WITH {_panel_sql()} SELECT * FROM panel")
def site_panel(spark: SparkSession, d: str) -> DataFrame:
    return contacts.panel_sites(load(spark, d, "contacts"))


@query(f"WITH {_panel_sql("technologies ILIKE '%wordpress%'")} SELECT *, (SELECT count(*) FROM panel) AS total, (SELECT greatest(1, ceil(count(*) / 20))::INT FROM panel) AS total_pages FROM panel ORDER BY crawled_at DESC NULLS LAST, site LIMIT 20 OFFSET 20")
def contacts_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of the sites found by a search, 20 a page."""
    return contacts.panel_page(load(spark, d, "contacts"), tech="wordpress", page=2, per_page=20)


@query("""
WITH r AS (SELECT *, lower(trim(domain)) AS site FROM contacts WHERE lower(trim(domain)) <> ''),
b AS (SELECT site, bool_or(trim(coalesce(phones, '')) <> '') AS p, bool_or(trim(coalesce(emails, '')) <> '') AS e, bool_or(contains(coalesce(technologies, ''), 'WordPress')) AS w, bool_or(contains(coalesce(technologies, ''), 'WooCommerce')) AS o FROM r GROUP BY 1)
SELECT * FROM (SELECT count(*) AS n_sites, count(*) FILTER (WHERE p) AS n_with_phones, count(*) FILTER (WHERE e) AS n_with_emails, count(*) FILTER (WHERE w) AS n_wordpress, count(*) FILTER (WHERE o) AS n_woocommerce FROM b),
 (SELECT count(DISTINCT city) FILTER (WHERE trim(city) <> '') AS n_cities FROM r)""")
def panel_figures(spark: SparkSession, d: str) -> DataFrame:
    return contacts.panel_figures(load(spark, d, "contacts"))


@query(ORACLE["panel_figures"].strip().replace("\nSELECT * FROM", ", c AS (" + ORACLE["crawl_figures"].strip() + ")\nSELECT * FROM c,", 1))
def stats(spark: SparkSession, d: str) -> DataFrame:
    """All figures of the panel in one row."""
    return contacts.stats(load(spark, d, "contacts"), load(spark, d, "discovered_links"), load(spark, d, "crawl_urls"))


@query("""
WITH j AS (SELECT c.domain, c.row_id AS id, e.key AS name, e.value AS v, e.type AS t FROM (SELECT domain, id AS row_id, socials FROM contacts WHERE json_valid(socials) AND json_type(socials) = 'OBJECT') c, json_each(c.socials) e),
k AS (SELECT domain, id, name, CASE WHEN t = 'VARCHAR' THEN v ->> '$' ELSE v::VARCHAR END AS value FROM j)
SELECT domain, name, value FROM k WHERE trim(value) <> '' QUALIFY row_number() OVER (PARTITION BY domain, name ORDER BY id, value) = 1""")
def site_profiles(spark: SparkSession, d: str) -> DataFrame:
    return contacts.merged_json(load(spark, d, "contacts").filter(F.try_parse_json("socials").isNotNull()), "domain", "socials")


@query("""
SELECT domain, technology, max(confidence) AS confidence, sum(evidence_count)::BIGINT AS evidence_count, arg_min(source_url, first_seen || source_url) AS source_url, min(first_seen) AS first_seen, max(last_seen) AS last_seen
FROM site_technology_evidence WHERE trim(domain) <> '' AND trim(technology) <> '' GROUP BY 1, 2""")
def tech_evidence(spark: SparkSession, d: str) -> DataFrame:
    return contacts.technology_evidence(load(spark, d, "site_technology_evidence"))


@query("""
WITH t AS (SELECT *, (last_seen >= '2024-02-01')::INT AS late FROM site_technology_evidence WHERE trim(domain) <> '' AND trim(technology) <> '')
SELECT domain, technology, max(confidence) AS confidence, sum(evidence_count)::BIGINT AS evidence_count, arg_min(source_url, late || first_seen || source_url) AS source_url, arg_min(first_seen, late || first_seen || source_url) AS first_seen, max(last_seen) AS last_seen FROM t GROUP BY 1, 2""")
def tech_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The stored evidence of January with all later rows folded in."""
    t = load(spark, d, "site_technology_evidence")
    return contacts.merged_technologies(contacts.technology_evidence(t.filter("last_seen < '2024-02-01'")), t.filter("last_seen >= '2024-02-01'"))


def _cells_sql() -> str:
    def split(x: str, by: str) -> str:
        s = f"string_split(coalesce({x}, ''), '{by}')"
        return f"SELECT domain, trim(v) AS raw, o * 100000 + i AS place FROM (SELECT domain, o, unnest({s}) AS v, generate_subscripts({s}, 1) AS i FROM r) WHERE trim(v) <> ''"

    return f"""
WITH r AS MATERIALIZED (SELECT coalesce(domain, '') AS domain, phones, emails, technologies, row_number() OVER (PARTITION BY coalesce(domain, '') ORDER BY crawled_at DESC NULLS LAST, id) AS o FROM contacts),
n AS (SELECT domain, raw, place, {_NATIONAL} AS n FROM ({split("phones", ",")})),
v AS (SELECT domain, CASE {_kind("n")} WHEN 'mobile' THEN 'phone' WHEN 'landline' THEN 'tel' END AS kind, CASE WHEN regexp_full_match(n, '9[0-9]{{9}}') THEN '0' || n WHEN regexp_full_match(n, '0[0-9]{{10}}') THEN n ELSE raw END AS value, place FROM n
  UNION ALL SELECT domain, 'email', raw, place FROM ({split("emails", ",")})
  UNION ALL SELECT domain, 'technology', trim(split_part(raw, '(', 1)), place FROM ({split("technologies", ";")}))
SELECT domain, kind, row_number() OVER (PARTITION BY domain, kind ORDER BY min(place))::INT AS pos, value FROM v WHERE kind IS NOT NULL AND value <> '' GROUP BY domain, kind, value"""


def _wide_sql() -> str:
    cells = _cells_sql().strip()
    ctes, select = cells.removeprefix("WITH r AS MATERIALIZED").split("\nSELECT domain, kind")
    return f"""
WITH {_SITES}, {_EVIDENCE},
cells AS MATERIALIZED (WITH r AS MATERIALIZED{ctes} SELECT domain, kind{select}),
places AS (SELECT value, row_number() OVER (ORDER BY coalesce(list_position([{", ".join(map(_q, TECHNOLOGY_ORDER))}], value), 1000), value) AS i FROM (SELECT DISTINCT value FROM cells WHERE kind = 'technology')),
long AS (SELECT domain, kind || '_' || pos AS col, value FROM cells WHERE kind <> 'technology' UNION ALL SELECT domain, 'technology_' || i, value FROM cells JOIN places USING (value) WHERE kind = 'technology'
  UNION ALL SELECT domain, 'social_' || network, profile FROM {_PROFILES} UNION ALL SELECT domain, 'evidence_pages_' || row_number() OVER (PARTITION BY domain ORDER BY place), value FROM ev_values WHERE field = 'page'
  UNION ALL SELECT domain, 'evidence_field_sources', '{{' || fields || '}}' FROM ev_fields UNION ALL SELECT domain, 'evidence_tel_links', t::VARCHAR FROM ev_sums WHERE t <> 0 UNION ALL SELECT domain, 'evidence_mailto_links', m::VARCHAR FROM ev_sums WHERE m <> 0
  UNION ALL SELECT domain, 'phone_1', '' FROM s)
SELECT one.*, p.* EXCLUDE (domain) FROM one JOIN (PIVOT long ON col USING coalesce(max(value), '') GROUP BY domain) p USING (domain)"""


@query(_wide_sql())
def export_wide(spark: SparkSession, d: str) -> DataFrame:
    """Every merged site as a row of single-value cells, with as many columns as the data needs."""
    return contacts.wide(contacts.sites(load(spark, d, "contacts")))


@query(_cells_sql())
def export_cells(spark: SparkSession, d: str) -> DataFrame:
    """Every number, e-mail and technology of the merged sites, one to a row."""
    return contacts.cells(contacts.sites(load(spark, d, "contacts")))


@query(f"""
SELECT id, array_to_string(list_distinct_ordered, ',') AS phones, CASE WHEN coalesce(title, '') <> '' THEN split_part(split_part(title, '-', 1), '|', 1) ELSE domain END AS name,
  {_lite_sql("coalesce(title, '') || ' ' || coalesce(address, '')", lite.LITE_CITIES, "''")} AS city, {_lite_sql("coalesce(title, '') || ' ' || coalesce(address, '')", lite.LITE_CATEGORIES, _q(GENERAL))} AS category
FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_ordered FROM (SELECT *, list_transform(regexp_extract_all(coalesce(phones, ''), {_q(lite.LITE_MOBILE)}, 1), lambda h: '0' || h) AS l FROM contacts))""")
def lite_extract(spark: SparkSession, d: str) -> DataFrame:
    """The reduced profile: mobile numbers by a loose pattern, a name from the title, the first city and category of its lists."""
    t, both = load(spark, d, "contacts"), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("address", F.lit("")))
    return t.select("id", F.array_join(lite.lite_phones(c("phones")), ",").alias("phones"), lite.lite_name(c("title"), c("domain")).alias("name"), lite.lite_city(both).alias("city"), lite.lite_category(both).alias("category"))


@query(f"""
WITH p AS (SELECT id, source_url, lower(trim(domain)) AS dom, {_blanked("coalesce(title, chr(32))")} AS title, {_blanked("coalesce(business_name, chr(32))")} AS given, {_VISIBLE} AS visible, regexp_replace(trim(regexp_replace(coalesce(address, ''), {_q(_SP)}, ' ', 'g')), '^[ ,;|]+|[ ,;|]+$', '', 'g') AS place, {_site_key("source_url")} AS site FROM contacts WHERE source_url IS NOT NULL),
t AS (SELECT *, {_PLAIN % "visible"} AS t, {_PLAIN % "visible || ' ' || site"} AS k FROM p)
SELECT id, source_url, site AS domain, title, {_MOBILE_OF.replace("as string", "as varchar")} AS phones, 'info' || id % 100 || '@mail.example.com' AS emails, CASE WHEN length(place) BETWEEN 8 AND 300 THEN place ELSE '' END AS address,
  {_detect("t", CITIES, "NULL")} AS city, {_detect("k", CATEGORIES, _q(GENERAL))} AS category, json_object('instagram', 'https://instagram.com/shop' || id % 9 || '?a=1&b=2')::VARCHAR AS socials FROM t""")
def page_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Contact rows extracted from the pages; technologies, names and scores have queries of their own."""
    rows = extract.at_rest(extract.extract(pages(spark, d).select(F.concat("url", F.lit("#"), "id").alias("url"), "html"), F.lit("2024-01-01").cast("timestamp")))
    at = F.substring_index("source_url", "#", -1).cast("bigint")
    return rows.select(at.alias("id"), F.regexp_replace("source_url", "#[0-9]+$", "").alias("source_url"), "domain", "title", "phones", "emails", "address", "city", "category", "socials")


@query("""
SELECT domain, row_number() OVER (PARTITION BY domain ORDER BY confidence DESC, technology, source_url)::INT AS place, technology, confidence, evidence_count, source_url FROM (
 SELECT domain, technology, max(confidence) AS confidence, sum(evidence_count)::BIGINT AS evidence_count, arg_min(source_url, first_seen || source_url) AS source_url FROM site_technology_evidence WHERE trim(domain) <> '' AND trim(technology) <> '' GROUP BY 1, 2)""")
def site_technologies(spark: SparkSession, d: str) -> DataFrame:
    """The technologies of each site, most certain first."""
    return contacts.site_technologies(contacts.technology_evidence(load(spark, d, "site_technology_evidence")))


@query("""
WITH c AS (SELECT coalesce(domain, '') AS domain, socials FROM contacts WHERE json_valid(socials) AND json_type(socials) = 'OBJECT'),
j AS (SELECT domain, 'social_' || e.key AS col, CASE WHEN e.type = 'VARCHAR' THEN e.value ->> '$' ELSE e.value::VARCHAR END AS profile FROM c, json_each(c.socials) e),
k AS (SELECT * FROM j WHERE trim(profile) <> '' UNION ALL SELECT domain, (SELECT min(col) FROM j WHERE trim(profile) <> ''), NULL FROM c)
SELECT * FROM (PIVOT k ON col USING coalesce(min(profile), '') GROUP BY domain)""")
def export_socials(spark: SparkSession, d: str) -> DataFrame:
    """One profile a site and network, a column for each network that occurs; ``export_profiles`` has all of them as rows."""
    rows = load(spark, d, "contacts").filter("try_parse_json(socials) is not null and socials like '{%'").select(F.coalesce("domain", F.lit("")).alias("domain"), "socials")
    return extract.wide_socials(rows)


@query("""
WITH r AS (SELECT coalesce(domain, '') AS domain, socials, row_number() OVER (ORDER BY crawled_at DESC NULLS LAST, id) AS o FROM contacts WHERE json_valid(socials) AND json_type(socials) = 'OBJECT'),
j AS (SELECT domain, o, e.key AS network, CASE WHEN e.type = 'ARRAY' THEN from_json(e.value, '["VARCHAR"]') ELSE [e.value ->> '$'] END AS l FROM r, json_each(r.socials) e),
k AS (SELECT domain, network, trim(v) AS profile, min(o * 1000 + i) AS place FROM (SELECT domain, o, network, unnest(l) AS v, generate_subscripts(l, 1) AS i FROM j) WHERE trim(v) <> '' GROUP BY ALL)
SELECT domain, network, row_number() OVER (PARTITION BY domain, network ORDER BY place)::INT AS pos, profile FROM k""")
def export_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Every profile of a site's JSON socials, of whatever network, one to a row."""
    rows = load(spark, d, "contacts").filter(F.try_parse_json("socials").isNotNull()).withColumn("domain", F.coalesce("domain", F.lit("")))
    return extract.profile_rows(rows)


@query(f"""
WITH {_EVIDENCE}
SELECT domain, field, row_number() OVER (PARTITION BY domain, field ORDER BY place)::INT AS pos, value FROM ev_values
UNION ALL SELECT domain, 'tel_links', 1, t::VARCHAR FROM ev_sums WHERE t <> 0 UNION ALL SELECT domain, 'mailto_links', 1, m::VARCHAR FROM ev_sums WHERE m <> 0""")
def evidence_sources(spark: SparkSession, d: str) -> DataFrame:
    """Every page of a site and every source of its fields, from the evidence of all rows."""
    rows = load(spark, d, "contacts").withColumn("domain", F.coalesce("domain", F.lit("")))
    return extract.evidence_rows(contacts.merged_evidence(rows, page="source_url", order=(contacts.latest_first(), c("id"))))


@query(f"WITH {_EVIDENCE} SELECT domain, evidence FROM {_EVIDENCE_JSON}")
def evidence_merge(spark: SparkSession, d: str) -> DataFrame:
    """The merged evidence of each site as stored."""
    rows = load(spark, d, "contacts").withColumn("domain", F.coalesce("domain", F.lit("")))
    return contacts.evidence_json(contacts.merged_evidence(rows, page="source_url", order=(contacts.latest_first(), c("id"))))


@query(f"""
WITH p AS ({PAGES}), m AS (SELECT id, lower(html || ' ' || url) AS h FROM p), n AS (SELECT id, [{", ".join(f"({_q(n)}, " + " + ".join(f"contains(h, {_q(m)})::INT" for m in ms) + f", {max(0.6 * len(ms), 1.0)!r})" for n, ms in lite.LITE_TECHNOLOGIES.items())}] AS l FROM m)
SELECT id, array_to_string(list_transform(list_filter(l, lambda x: x[2] > 0), lambda x: x[1] || '(' || regexp_replace((CASE WHEN round(least(x[2]::DOUBLE / x[3]::DOUBLE, 1.0), 2) < 0.35 THEN 0.5 ELSE round(least(x[2]::DOUBLE / x[3]::DOUBLE, 1.0), 2) END)::VARCHAR, '[.]0$', '') || ')'), ',') AS technologies FROM n""")
def lite_technologies(spark: SparkSession, d: str) -> DataFrame:
    """Technologies by the reduced profile's marks."""
    return pages(spark, d).select("id", F.array_join(lite.lite_technologies(c("html"), c("url")), ",").alias("technologies"))
