"""One surviving record for each group of duplicate records, field by field.

Fields are unpivoted to long rows (site, field, value), unusable values are left out, votes are combined per normalised value, winners
are picked by ``max_by`` and pivoted back. Two ways of combining:

* ``voted``: a vote weighs the row's trust times a recency decay, votes of a value are summed, and the value with most votes
  survives in its most frequent spelling.
* ``best_rows``: the same with votes so steep that no number of lesser ones outweighs a better one: trust first, then recency, then the
  smaller id. Their sum is ruled by the largest, so the largest is kept; the surviving row is the one that cast it. It answers a
  definition in which the best row decides.

Both are plain aggregates with partial sums on the map side, so a site with a third of all
rows is reduced before it moves.

Results: NULL, blank, placeholder and garbled values never win; a field without a usable
value gives 0 (``best_rows``) or NULL (``voted``); NULL scores and times rank last; sites with
one row are left out of ``best_rows``; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavosh.functions.urls import host, site
from kavosh.llm.addresses import names_street
from kavosh.llm.garble import is_garbled

#: Values that stand for no value, and words that name a page rather than a business (lower case, letters only).
NO_VALUE = (
    "null", "none", "nil", "nan", "n/a", "na", "undefined", "unknown", "not set", "نامشخص", "ثبت نشده", "ندارد", "بدون نام", "نام شرکت", "تست", "test", "-", "—", "–", ".", "?", "...",
)
PAGE_WORDS = (
    "home", "homepage", "home page", "website", "site", "web site", "welcome", "index", "untitled", "about us", "about", "contact us", "contact", "blog", "faq", "products", "our services",
    "services", "portfolio", "branches", "price list", "order online", "buyer’s guide", "today’s offers", "خانه", "صفحه اصلی", "صفحه نخست", "وب سایت", "وبسایت", "سایت", "درباره ما", "تماس با ما", "وبلاگ",
    "محصولات", "خدمات", "خدمات ما", "نمونه کارها", "سوالات متداول", "راهنمای خرید", "قیمت روز", "فروش ویژه", "ثبت سفارش", "شعبه ها", "گارانتی و پشتیبانی", "فروشگاه", "شرکت",
)


def plain(text: Column) -> Column:
    """A value as it is compared: lower case, one kind of yeh and kaf, single spaces, no outer punctuation."""
    t = F.lower(F.translate(text, "يك‌ ", "یک  "))
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^[\s|:،,;.]+|[\s|:،,;]+$", ""))


def site_of(domain: Column, url: Column) -> Column:
    """The site a row stands for: its domain, or the host of its page where that is NULL or blank."""
    name = site(domain)
    return F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(host(url))


def usable_name(name: Column, at: Column) -> Column:
    """Whether a business name may survive: not blank, no placeholder or page word, not the host, not garbled."""
    p = plain(name)
    bare = F.regexp_replace(F.regexp_replace(p, r"^(?:https?://)?(?:www\.)?", ""), r"[./]+$", "")
    word = p.rlike(r"[\p{L}\p{N}]")
    return F.coalesce(name.isNotNull() & word & ~p.isin(*NO_VALUE, *PAGE_WORDS) & (bare != at) & ~is_garbled(name), F.lit(False))


@F.pandas_udf(T.BooleanType())
def _street(s: pd.Series) -> pd.Series:
    return s.map(lambda a: isinstance(a, str) and names_street(a))


def usable_word(value: Column, at: Column) -> Column:
    """Whether a category or city may survive: not blank, no placeholder, not garbled; words of pages are good categories."""
    p = plain(value)
    return F.coalesce(value.isNotNull() & p.rlike(r"[\p{L}\p{N}]") & ~p.isin(*NO_VALUE) & ~is_garbled(value), F.lit(False))


#: How each field's values are judged; other fields take ``usable_word``.
USABLE = {"business_name": usable_name, "address": lambda value, at: _street(value)}


def unpivoted(rows: DataFrame, fields: tuple[str, ...], kept: tuple[str, ...]) -> DataFrame:
    """(domain, *kept, field, value, ok): one row for each field of a row, with whether its value may survive."""
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), USABLE.get(f, usable_word)(F.col(f), F.col("domain")).alias("ok")) for f in fields])
    return rows.select("domain", *kept, F.explode(cells).alias("x")).select("domain", *kept, "x.field", "x.value", "x.ok")


def best_rows(df: DataFrame) -> DataFrame:
    """(domain, name_id, address_id) of each site with at least two rows; 0 where no row is usable."""
    rows = df.select("id", site_of(F.col("domain"), F.col("source_url")).alias("domain"), "business_name", "address", "quality_score", "crawled_at").filter("domain <> '' and id is not null")
    steep = F.struct(F.coalesce("quality_score", F.lit(float("-inf"))).alias("trust"), F.coalesce(F.unix_micros(F.col("crawled_at").try_cast("timestamp")), F.lit(-(2**62))).alias("recency"), (-F.col("id")).alias("cast_by"))
    fields = ("business_name", "address")
    long = unpivoted(rows, fields, ("id", "quality_score", "crawled_at")).withColumn("vote", F.when(F.col("ok"), steep))
    values = long.groupBy("domain", "field", F.xxhash64(F.when(F.col("ok"), plain(F.col("value")))).alias("key")).agg(F.count("*").alias("n"), F.max("vote").alias("votes"))
    won = values.groupBy("domain", "field").agg(F.sum("n").alias("n"), F.max_by(-F.col("votes.cast_by"), "votes").alias("winner"))
    wide = won.groupBy("domain").pivot("field", list(fields)).agg(F.max("winner").alias("winner"), F.max("n").alias("n"))
    ids = [F.coalesce(f"{f}_winner", F.lit(0)).cast("bigint").alias(name) for f, name in zip(fields, ("name_id", "address_id"))]
    return wide.filter("business_name_n >= 2").select("domain", *ids)


def voted(df: DataFrame, fields: tuple[str, ...] = ("business_name", "address", "category", "city"), half_life_days: float = 30.0) -> DataFrame:
    """(domain, one column per field): the value of each field with most weighted votes.

    A vote is the row's quality_score (0.1 where NULL) halved for every ``half_life_days``
    before the newest row of the table; a row without a time votes like one a year old.
    """
    rows = df.select(site_of(F.col("domain"), F.col("source_url")).alias("domain"), *fields, "quality_score", F.unix_timestamp(F.col("crawled_at").try_cast("timestamp")).alias("at")).filter("domain <> ''")
    newest = rows.agg(F.max("at")).collect()[0][0] or 0  # one number
    days = F.coalesce((F.lit(newest) - F.col("at")) / 86400.0, F.lit(365.0))
    vote = F.coalesce("quality_score", F.lit(0.1)) * F.pow(F.lit(0.5), days / half_life_days)
    long = unpivoted(rows.withColumn("vote", vote), fields, ("vote",)).withColumn("value", F.when(F.col("ok"), F.col("value")))
    spelt = long.groupBy("domain", "field", "value").agg(F.sum("vote").alias("votes"))
    values = spelt.groupBy("domain", "field", plain(F.col("value")).alias("key")).agg(F.sum("votes").alias("votes"), F.max_by("value", F.struct("votes", "value")).alias("value"))
    won = values.groupBy("domain", "field").agg(F.max_by(F.when(F.col("key").isNotNull(), F.col("value")), F.struct(F.col("key").isNotNull(), F.round("votes", 9), "key")).alias("value"))
    return won.groupBy("domain").pivot("field", list(fields)).agg(F.max("value"))
