"""From pages to contact rows: everything a page says about its owner, with where it was found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavosh.functions import classify, phones, text, urls
from kavosh.functions.jsonld import jsonld_blocks, jsonld_contacts
from kavosh.functions.dicts import SOCIAL_HOSTS
from kavosh.operators.contacts import latest_first, safe_name
from kavosh.sources.tables import spread

def linked(hrefs: Column, prefix: str) -> Column:
    """What links of a kind (tel:, mailto:) among targets point to, without parameters."""
    found = F.filter(hrefs, lambda h: F.lower(h).startswith(prefix))
    return F.transform(found, lambda h: F.coalesce(F.try_url_decode(F.regexp_replace(F.substr(h, F.lit(len(prefix) + 1)), r"\?.*$", "")), h))


def extract(pages: DataFrame, batch_time: Column | None = None) -> DataFrame:
    """Contact rows of pages(url, html[, headers]): typed columns, nothing joined to text yet.

    The page's text and lists are computed once in one projection, entities decoded in the next, and used in the
    third; the HTML itself is dropped on the way, so nothing wide travels on. Narrow throughout.
    """
    html, url = F.col("html"), F.col("url")
    headers = F.col("headers") if "headers" in pages.columns else F.lit("")
    parts = spread(pages.select("url", "html", headers.alias("headers"))).filter("html is not null").select(
        "url", urls.site_key(url).alias("domain"), text.page_title(html).alias("title"), text.visible_text(html, "\n").alias("lines"), text.hrefs(html).alias("hrefs"), text.name_candidates(html).alias("names"),
        text.address_candidates(html).alias("places"), F.array_join(jsonld_contacts(jsonld_blocks(html)), " ; ").alias("ld"), classify.detect_technologies(html, url, headers).alias("technologies"),
    )
    hrefs = F.col("hrefs")
    first = parts.select(
        "url", "domain", "title", F.replace("lines", F.lit("\n"), F.lit(" ")).alias("text"), F.array_join(linked(hrefs, "tel:"), " ; ").alias("tel"), F.size(linked(hrefs, "mailto:")).alias("n_mail"), F.array_join(linked(hrefs, "mailto:"), " ; ").alias("mail"), "ld",
        text.profiles(hrefs, url).alias("socials"), "technologies", text.best_name(F.col("names"), F.col("title"), F.col("domain")).alias("business_name"), text.best_address(F.col("places"), F.col("lines")).alias("address"),
    )
    everywhere = F.concat_ws(" ; ", "text", "tel", "mail", "ld")  # no number or address spans the marks between
    rows = first.select(
        "*", phones.extract_phones(everywhere).alias("phones"), text.extract_emails(everywhere).alias("emails"), text.detect_city(F.col("text")).alias("city"), text.detect_category(F.col("text"), F.col("domain")).alias("category"),
        F.size(phones.extract_phones(F.col("tel"))).alias("n_tel"),
    )
    here = lambda has: F.when(has, F.array("url")).otherwise(F.array().cast("array<string>"))
    has = {
        "phones": F.size("phones") > 0, "emails": F.size("emails") > 0, "address": F.col("address") != "", "business_name": F.col("business_name") != "", "city": F.col("city").isNotNull(),
        "category": F.col("category").isNotNull(), "socials": F.size("socials") > 0, "technologies": F.size("technologies") > 0,
    }
    evidence = F.struct(
        F.col("url").alias("page"), F.map_from_arrays(F.array(*[F.lit(k) for k in has]), F.array(*[here(h) for h in has.values()])).alias("field_sources"), has["address"].alias("address_detected"),
        F.col("n_tel").alias("tel_links"), F.col("n_mail").alias("mailto_links"), F.array_sort(F.map_keys("socials")).alias("socials"), F.transform("technologies", lambda t: t["name"]).alias("technologies"),
    )
    quality = classify.quality_score(has["phones"], has["emails"], has["socials"], has["technologies"], F.col("business_name"), F.col("domain"), F.col("city"), F.col("address"))
    return rows.select(
        F.col("url").alias("source_url"), "domain", "title", "phones", text.normalize_emails(F.col("emails")).alias("emails"), "address", text.clean_business_name(F.col("business_name"), F.col("domain")).alias("business_name"), "category", "city", "socials", "technologies",
        (batch_time if batch_time is not None else F.current_timestamp()).alias("crawled_at"), quality.alias("quality_score"), evidence.alias("evidence"),
    )


def at_rest(rows: DataFrame) -> DataFrame:
    """Contact rows as they are stored: lists as text, maps and structs as JSON, NULL lists as ''."""
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return rows.withColumns({
        "phones": joined("phones"), "emails": joined("emails"), "technologies": classify.format_technologies(F.col("technologies")), "socials": F.to_json("socials"), "evidence": F.to_json("evidence"),
        "crawled_at": F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss"),
    })


def profile_rows(rows: DataFrame, key: str = "domain", column: str = "socials") -> DataFrame:
    """(key, network, pos, profile): every profile of every network of a key, each once, in order of its first row (crawled_at, latest first, then id)."""
    pairs = rows.select(key, latest_first().alias("late"), "id", F.explode(F.from_json(column, "map<string,string>")).alias("network", "v")).filter("v is not null")
    several = F.coalesce(F.from_json(F.when(F.col("v").startswith("["), F.col("v")), "array<string>"), F.array("v"))
    each = pairs.select(key, "network", "late", "id", F.posexplode(several).alias("i", "profile")).withColumn("profile", F.trim("profile")).filter("profile <> ''")
    first = each.groupBy(key, "network", "profile").agg(F.min(F.struct("late", "id", "i")).alias("at"))
    lists = first.groupBy(key, "network").agg(F.array_sort(F.collect_list(F.struct("at", "profile"))).alias("l"))
    return lists.select(key, "network", F.posexplode("l").alias("pos", "x")).select(key, "network", (F.col("pos") + 1).alias("pos"), F.col("x.profile").alias("profile"))


def evidence_rows(merged: DataFrame, key: str = "domain") -> DataFrame:
    """(key, field, pos, value): all of merged evidence, one value to a row: each page, each source of each field, and counts of links that aren't 0."""
    count = lambda c: F.filter(F.array(F.col(c).cast("string")), lambda v: v != "0")
    own = F.create_map(F.lit("page"), F.col("pages"), F.lit("tel_links"), count("tel_links"), F.lit("mailto_links"), count("mailto_links"))
    lists = merged.select(key, F.explode(F.concat(F.map_entries(own), F.coalesce(F.map_entries("field_sources"), F.map_entries(F.map_filter(own, lambda k, v: F.lit(False)))))).alias("x"))
    return lists.select(key, F.col("x.key").alias("field"), F.posexplode("x.value").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def wide_socials(rows: DataFrame, key: str = "domain", column: str = "socials", networks: list[str] | None = None) -> DataFrame:
    """(key, social_<network>...): the first profile of each network per key, '' where there is none.

    Networks not given are those that occur, known ones first; only their names reach the driver.
    """
    pairs = rows.select(key, F.posexplode_outer(F.from_json(column, "map<string,string>")).alias("pos", "network", "profile"))
    if networks is None:
        seen = {r[0] for r in pairs.filter("trim(profile) <> ''").select("network").distinct().collect()}
        networks = [n for n in SOCIAL_HOSTS if n in seen] + sorted(seen - set(SOCIAL_HOSTS))
    cells = [F.coalesce(F.min(F.when((F.col("network") == n) & (F.trim("profile") != ""), F.col("profile"))), F.lit("")).alias(f"social_{safe_name(n)}") for n in networks]
    return pairs.groupBy(key).agg(*cells) if cells else pairs.select(key).distinct()


