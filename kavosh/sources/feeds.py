"""Seed lists, robots and sitemap bodies, settings, notes and logs."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kavosh.functions.urls import canonical, is_allowed, path_of, site_key

# Settings where a file says nothing else.
DEFAULTS = {"allowed_tlds": [".ir"], "layered_crawl": False, "cycle_delay": 300, "page_budget": 20}


def seeds(spark: SparkSession, path: str, tlds: tuple[str, ...] | None = None) -> DataFrame:
    """(place, url, site) of a seed list, one URL a line, numbered in order: blank lines and # comments skipped, https:// assumed, canonical, each once.

    Seeds pass whatever their suffix; with ``tlds`` the list is filtered as the reduced profile does.
    """
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("place"), F.trim("value").alias("line")).filter("line <> '' and not line like '#%'")
    url = F.when(F.col("line").contains("://"), F.col("line")).otherwise(F.concat(F.lit("https://"), F.col("line")))
    first = lines.select("place", canonical(url).alias("url")).filter("url is not null").groupBy("url").agg(F.min("place").alias("place"))
    out = first.select("place", "url", site_key(F.col("url")).alias("site")).filter("site <> ''")
    return out.filter(is_allowed(F.col("site"), (), tlds)) if tlds is not None else out


def has_seeds(path: str) -> bool:
    """Whether a seed list exists and names anything; lines that begin with # don't count."""
    try:
        return any(line.strip() and not line.startswith("#") for line in Path(path).read_text("utf-8").splitlines())
    except OSError:
        return False


def enqueued(queue: DataFrame, lines: DataFrame, tlds: tuple[str, ...] = (".ir",)) -> DataFrame:
    """What a reduced profile's seed lines(line) add to its queue(url, ...): (url, domain, depth, status), known URLs left out.

    The URL stays as written; how many are new is the result's count.
    """
    line = F.trim("line")
    url = F.when(line.rlike("(?i)^https?://"), line).otherwise(F.concat(F.lit("https://"), line))
    rows = lines.filter((line != "") & ~line.startswith("#")).select(url.alias("url")).distinct().withColumn("domain", site_key(F.col("url")))
    new = rows.filter((F.col("domain") != "") & is_allowed(F.col("domain"), (), tlds)).join(queue.select("url"), "url", "left_anti")
    return new.select("url", "domain", F.lit(0).alias("depth"), F.lit("pending").alias("status"))


# Lines of robots.txt that name sitemaps, and locations in sitemaps.
_SITEMAP_LINE = r"(?im)^\s*sitemap\s*:\s*(\S+)\s*$"
_LOCATION = r"(?is)<loc>\s*(.*?)\s*</loc>"


def _edges(found: DataFrame, kind: str, seeds: tuple[str, ...], tlds: tuple[str, ...]) -> DataFrame:
    target = found.select("url", canonical(F.col("to")).alias("target_url")).filter("target_url is not null").distinct()
    domain = site_key(F.col("target_url"))
    rows = target.select(F.col("url").alias("source_url"), "target_url", domain.alias("target_domain"), (domain != site_key(F.col("url"))).alias("external"), is_allowed(domain, seeds, tlds).alias("crawlable"), F.lit(kind).alias("link_type"))
    return rows.filter("target_domain <> ''")


def robots_sitemaps(bodies: DataFrame, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> DataFrame:
    """Edges of robots bodies(url, body) to the sitemaps they name; crawlable where the host is allowed."""
    return _edges(bodies.select("url", F.explode(F.regexp_extract_all("body", F.lit(_SITEMAP_LINE), F.lit(1))).alias("to")), "robots_sitemap", seeds, tlds)


def sitemap_locations(bodies: DataFrame, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> DataFrame:
    """Edges of sitemap bodies(url, body) to their locations, malformed XML included, with whether each is a sitemap itself (nested)."""
    bare = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]*>", ""))
    found = F.transform(F.regexp_extract_all("body", F.lit(_LOCATION), F.lit(1)), bare)
    rows = _edges(bodies.select("url", F.explode(found).alias("to")), "sitemap", seeds, tlds)
    low = F.lower("target_url")
    return rows.withColumn("nested", low.rlike(r"[.]xml([.]gz)?$") | F.lower(path_of(F.col("target_url"))).contains("sitemap"))


def settings(path: str | None) -> dict:
    """Defaults overlaid by a JSON file; a missing or broken file leaves the defaults, unknown keys are kept."""
    try:
        given = json.loads(Path(path).read_text("utf-8")) if path else {}
    except (OSError, ValueError):
        given = {}
    return DEFAULTS | (given if isinstance(given, dict) else {})


def save_settings(path: str, changes: dict) -> dict:
    out = settings(path) | changes
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2), "utf-8")
    return out


def noted(path: str, key: str, default: str = "") -> str:
    """The value of a key in a store of notes (one JSON file)."""
    return str(settings(path).get(key, default))


def note(path: str, key: str, value: str) -> None:
    """Keep a value under a key; the last one stays."""
    given = json.loads(Path(path).read_text("utf-8")) if Path(path).exists() else {}
    Path(path).write_text(json.dumps(given | {key: value}, ensure_ascii=False), "utf-8")


def tld_list(text: str) -> list[str]:
    """Suffixes of a comma list: lower case, with a leading dot, blanks dropped."""
    return [t if t.startswith(".") else f".{t}" for x in text.split(",") if (t := x.strip().lower())]


def log_tail(spark: SparkSession, path: str, n: int = 150) -> list[str]:
    """The last lines of a log."""
    return [r[0] for r in spark.read.text(path).tail(n)]
