"""The link graph: edges of pages, folding repeated edges, states of targets, figures and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.functions.dicts import RESOURCE_TYPES, SKIP_EXTENSIONS
from kavosh.functions.jsonld import jsonld_blocks, jsonld_links
from kavosh.functions.text import attributes, decoded, value_of
from kavosh.functions.urls import canonical, crawlable, is_allowed, joined, site_key, url_priority
from kavosh.sources.tables import spread

# Elements that link, in the order in which they name a target's type; whether their targets may be crawled.
_TAGS = (
    ("anchor", "a", "href", "", True), ("canonical", "link", "href", r"(?=[^>]*\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b)", True),
    ("hreflang", "link", "href", r"(?=[^>]*\bhreflang\b)(?=[^>]*\brel\s*=\s*[\"']?[^\"'>]*\balternate\b)", True),
    ("script", "script", "src", "", False), ("image", "img", "src", "", False), ("iframe", "iframe", "src", "", False), ("frame", "frame", "src", "", False), ("video", "video", "src", "", False), ("audio", "audio", "src", "", False),
    ("source", "source", "src", "", False), ("object", "object", "data", "", False), ("form", "form", "action", "", False),
)
# Schemes that lead nowhere, what is cut from the ends of a link, and hosts of vocabularies.
_NOWHERE = r"^(#|javascript:|data:|blob:|mailto:|tel:)"
_TRIMMED = r"^[ \t\r\n.,;:!?)\]}'\"]+|[ \t\r\n.,;:!?)\]}'\"]+$"
_VOCABULARIES = ("schema.org", "w3.org", "json-schema.org", "purl.org", "xmlns.com", "ogp.me")
_UNFOLLOWED = tuple(kind for kind, *_, hint in _TAGS if not hint) + ("srcset",)


def _typed(values: Column, kind: str, order: int) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(order).alias("ord"), F.lit(kind).alias("link_type"), F.trim(v).alias("href")))


def _refreshes(html: Column) -> Column:
    """Targets of meta refreshes."""
    contents = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*\bhttp-equiv\b[^>]*>"), F.lit(0)), lambda t: value_of(t, "content"))
    return F.filter(F.transform(F.filter(contents, lambda x: x.rlike(r"^\s*\d+\s*;")), lambda x: F.regexp_extract(x, r"(?is);\s*url\s*=\s*(.+)$", 1)), lambda x: x != "")


def page_links(pages: DataFrame, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> DataFrame:
    """Edges of pages(url, html[, request_url, redirect_urls]): source_url, target_url, target_domain, external, crawlable, link_type.

    One edge per canonical target of a page, typed by the first way it is linked: anchor, canonical, hreflang,
    resources, srcset, meta refresh, JSON-LD, URLs written out anywhere in the page. Where pages say how they were reached, each step
    of a redirection is an edge of its own. Entities in attributes count as the characters they stand for; links that lead nowhere are dropped.
    """
    html = F.col("html")
    srcset = F.flatten(F.transform(attributes(html, r"\w+", "srcset"), lambda s: F.transform(F.split(s, ","), lambda x: F.split_part(F.trim(x), F.lit(" "), F.lit(1)))))
    found = [_typed(attributes(html, tag, name, where), kind, n) for n, (kind, tag, name, where, _) in enumerate(_TAGS)]
    found += [_typed(srcset, "srcset", 12), _typed(_refreshes(html), "meta_refresh", 13), _typed(explicit_urls(F.array_join(jsonld_links(jsonld_blocks(html)), "\n")), "jsonld", 14), _typed(explicit_urls(html), "text_or_script", 15)]
    rows = spread(pages.select("url", "html")).filter("html is not null").select(F.col("url").alias("source_url"), F.posexplode(F.concat(*found)).alias("pos", "l"))
    rows = rows.select("source_url", "pos", "l.ord", "l.link_type", F.trim(F.coalesce(decoded(F.when(F.col("l.ord") < 14, F.col("l.href"))), F.col("l.href"))).alias("href")).filter(f"href <> '' and not href rlike '{_NOWHERE}'")
    edges = rows.withColumn("target_url", canonical(joined(F.col("source_url"), F.regexp_replace("href", _TRIMMED, "")))).filter("target_url is not null")
    first = edges.groupBy("source_url", "target_url").agg(F.min_by("link_type", F.struct("ord", "pos")).alias("link_type"))
    domain, target = site_key(F.col("target_url")), F.col("target_url")
    external = domain != site_key(F.col("source_url"))
    out = first.select("source_url", "target_url", domain.alias("target_domain"), external.alias("external"), (~F.col("link_type").isin(*_UNFOLLOWED) & crawlable(target, seeds, tlds)).alias("crawlable"), "link_type")
    if "redirect_urls" not in pages.columns:
        return out
    chain = F.array_compact(F.transform(F.concat(F.array("request_url"), F.coalesce("redirect_urls", F.array().cast("array<string>")), F.array("url")), lambda u: canonical(u)))
    steps = pages.select(chain.alias("c")).select(F.explode(F.arrays_zip(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))).alias("source_url"), F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))).alias("target_url"))).alias("s"))
    hops = steps.select("s.*").filter("source_url <> target_url").distinct().filter(domain != "")
    allowed = is_allowed(domain, seeds, tlds) & ~F.lower(target).rlike(rf"[.]({'|'.join(SKIP_EXTENSIONS)})$")
    return out.unionByName(hops.select("source_url", "target_url", domain.alias("target_domain"), external.alias("external"), allowed.alias("crawlable"), F.lit("redirect").alias("link_type")))


def explicit_urls(text: Column) -> Column:
    """URLs written out in a text, trimmed of punctuation, each once; hosts of vocabularies left out."""
    hits = F.transform(F.regexp_extract_all(text, F.lit(r"(?i)https?://[^\s<>]+"), F.lit(0)), lambda u: F.regexp_replace(u, _TRIMMED, ""))
    return F.array_distinct(F.filter(hits, lambda u: ~site_key(u).isin("", *_VOCABULARIES)))


def followed(edges: DataFrame) -> DataFrame:
    """Edges to follow: resources are recorded, never followed."""
    return edges.filter(F.col("crawlable") & ~F.col("link_type").isin(*RESOURCE_TYPES))


def scheduled(edges: DataFrame, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> DataFrame:
    """(source_url, target_url, priority) of the edges a page's crawl goes on with: no resources, hosts and paths that may be crawled, the best pages first."""
    target = F.col("target_url")
    rows = edges.filter(~F.col("link_type").isin(*RESOURCE_TYPES) & crawlable(target, seeds, tlds))
    return rows.select("source_url", "target_url", url_priority(target).alias("priority")).distinct()


# How early requests come, by what asks for them; links of pages have priorities of their own.
REQUEST_PRIORITIES = {"seed": 50, "aux": 40, "robots_sitemap": 35, "nested_sitemap": 30, "sitemap": 15, "next_batch": 10}


def request_priority(kind: Column, url: Column) -> Column:
    """The priority of a request: by its kind, or by its URL where it comes from a page."""
    return F.coalesce(*[F.when(kind == k, p) for k, p in REQUEST_PRIORITIES.items()], url_priority(url))


def fold_links(edges: DataFrame, order: tuple[str, ...] = ("first_seen", "id")) -> DataFrame:
    """One row per (source_url, target_url): flags by maximum, link types in order of arrival, the rest from the first row.

    Types are first reduced to their earliest row per edge, so an edge repeated without end
    gathers no long list.
    """
    at = F.struct(*[F.col(c) for c in order], "pos")
    single = edges.select(*edges.columns, F.posexplode_outer(F.split("link_type", ",")).alias("pos", "kind"))
    kinds = single.groupBy("source_url", "target_url", "kind").agg(
        F.min(at).alias("at"), F.max("crawlable").alias("crawlable"), F.max("external").alias("external"), F.min_by("target_domain", at).alias("target_domain"), F.count("*").alias("n")
    )
    return kinds.groupBy("source_url", "target_url").agg(
        F.min_by("target_domain", "at").alias("target_domain"), F.max("external").alias("external"), F.max("crawlable").alias("crawlable"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "kind"))), lambda k: k["kind"]), ",").alias("link_type"), F.min("at")["first_seen"].alias("first_seen"),
    )


def merged_links(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored edges with a batch folded in: flags by maximum, types added in order of arrival, target_domain and first_seen of the first.

    Stored rows come before any of the batch, whatever their times; types come single or as comma sets.
    """
    both = stored.withColumns({"_late": F.lit(0), "_id": F.lit(0).cast("bigint")}).unionByName(batch.withColumns({"_late": F.lit(1), "_id": F.col("id").cast("bigint") if "id" in batch.columns else F.lit(0).cast("bigint")}), allowMissingColumns=True)
    return fold_links(both, ("_late", "first_seen", "_id"))


def latest_states(urls: DataFrame) -> DataFrame:
    """(url, s): the latest status and reason of each URL; NULL URLs are left out."""
    return urls.filter("url is not null").groupBy("url").agg(F.max_by(F.struct("status", "failure_reason"), F.struct("first_seen", "url_id")).alias("s"))


def target_state(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """Edges with the state of their target: a left join on the URL, one row per edge.

    A URL that occurs in several rows of ``urls`` counts with its latest. Catalyst picks the
    join; a target with many edges is split by AQE since the other side has one row.
    """
    status = F.col("s.status")
    state = (
        F.when(~F.coalesce("crawlable", F.lit(False)), "NON_CRAWLABLE").when(status == "crawled", "CRAWLED").when(status == "queued", "QUEUED").when((status == "failed") & F.col("s.failure_reason").ilike("robots%"), "ROBOTS_BLOCKED")
        .when(status == "failed", "FAILED").when(status == "retry_pending", "RETRY_PENDING").otherwise("DISCOVERED")
    )
    latest = latest_states(urls)
    return edges.join(latest, edges["target_url"] == latest["url"], "left").withColumn("crawl_status", state).drop("s", latest["url"])


#: Columns of the link list as people get it.
LINK_COLUMNS = ("source_url", "target_url", "target_domain", "external", "crawlable", "link_type", "first_seen", "crawl_status")


def link_list(edges: DataFrame, urls: DataFrame, query: str = "", crawlable_only: bool | None = None) -> DataFrame:
    """External edges with the state of their targets, in the columns of ``LINK_COLUMNS``."""
    return target_state(search_links(edges, query, crawlable_only), urls).select(*LINK_COLUMNS)


def search_links(edges: DataFrame, query: str = "", crawlable_only: bool | None = None) -> DataFrame:
    """External edges, optionally of one crawlability and with a text in source, target or domain."""
    out = edges.filter("external")
    if crawlable_only is not None:
        out = out.filter(F.col("crawlable") == crawlable_only)
    if query:
        like = f"%{query}%"
        out = out.filter(F.col("source_url").ilike(like) | F.col("target_url").ilike(like) | F.col("target_domain").ilike(like))
    return out


def crawlable_flag(status: str | None) -> bool | None:
    """What a list's status choice asks for: all, crawlable ones, or the others."""
    return None if status in (None, "", "all") else status == "allowed"


def page_of(df: DataFrame, page: int, per_page: int, *order: Column) -> DataFrame:
    """One page of an ordered list; pages count from 1."""
    page, per_page = max(1, page), max(1, per_page)
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def with_totals(df: DataFrame, page: int, per_page: int, *order: Column) -> DataFrame:
    """One page of an ordered list, each row with the list's total and its number of pages (at least 1)."""
    total = df.agg(F.count("*").alias("total"))  # one row
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / max(1, per_page))).cast("int")
    return page_of(df, page, per_page, *order).crossJoin(F.broadcast(total)).withColumn("total_pages", pages)


def crawl_figures(edges: DataFrame, urls: DataFrame) -> DataFrame:
    """One row of counts over edges and URL states."""
    e = edges.agg(F.count("*").alias("n_links"), F.count_distinct(F.when(F.col("external"), F.col("target_domain"))).alias("n_external_domains"), F.count_if("crawlable").alias("n_crawlable"))
    u = urls.agg(
        F.count_if(F.col("status") == "crawled").alias("n_crawled"), F.count_distinct(F.when(F.col("status") == "crawled", F.col("domain"))).alias("n_domains"), F.count_if(F.col("status").isin("failed", "retry_pending")).alias("n_failed"),
        F.count_if(F.col("failure_reason").ilike("robots%")).alias("n_robots"),
    )
    return e.crossJoin(u)  # one row each


def next_batch(edges: DataFrame, urls: DataFrame, budget: int = 20) -> DataFrame:
    """Up to ``budget`` crawlable targets of each domain, earliest seen first: those unknown and those that wait for another try.

    The anti join comes first and targets are made unique before the rank; Spark keeps only
    ``budget`` rows per domain and split before it shuffles (WindowGroupLimit), so a domain
    with most targets stays small.
    """
    known = latest_states(urls).filter("s.status is null or s.status <> 'retry_pending'").select("url")
    fresh = edges.filter("crawlable and target_domain is not null").groupBy("target_domain", "target_url").agg(F.min("first_seen").alias("first_seen")).join(known, F.col("target_url") == F.col("url"), "left_anti")
    rank = F.row_number().over(Window.partitionBy("target_domain").orderBy("first_seen", "target_url"))
    return fresh.withColumn("place", rank).filter(F.col("place") <= budget)
