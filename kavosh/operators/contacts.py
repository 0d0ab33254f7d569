"""Contact rows: what is new, what may be inserted, searching, and site views."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavosh.functions.dicts import TECHNOLOGY_ORDER
from kavosh.functions.phones import classify_phone, normalize_iranian
from kavosh.functions.text import stripped
from kavosh.operators.links import crawl_figures, with_totals
from kavosh.sources.tables import keep


def split_list(text: Column, by: str = ",") -> Column:
    """Values of a delimited text: trimmed, blanks dropped, each once, in order; NULL gives an empty array."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), by), lambda v: stripped(v)), lambda v: v != ""))


def newcomers(df: DataFrame, order: str = "id", by: str = ",") -> DataFrame:
    """Rows that bring something: a phone or e-mail not seen in an earlier row, any profile or technology, or a new domain.

    Set-based: the first row of each phone, e-mail and domain is found by a minimum with partial
    aggregates, so no key has to fit one task and no row order is walked.
    """
    keys = F.array_union(
        F.array(F.concat(F.lit("d:"), F.coalesce("domain", F.lit("")))),
        F.array_union(F.transform(split_list(F.col("phones"), by), lambda v: F.concat(F.lit("p:"), v)), F.transform(split_list(F.col("emails"), by), lambda v: F.concat(F.lit("e:"), v))),
    )
    first = df.select(order, F.explode(keys).alias("key")).groupBy("key").agg(F.min(order).alias(order)).select(order).distinct()
    has = lambda c: ~F.coalesce(F.trim(c), F.lit("")).isin("", "{}", "[]", "null")
    marked = df.join(first.withColumn("is_first", F.lit(True)), order, "left")
    return marked.filter(F.coalesce("is_first", F.lit(False)) | has("socials") | has("technologies")).drop("is_first")


def insert_ignore(existing: DataFrame, batch: DataFrame, keys: tuple[str, ...] = ("source_url", "phones"), order: str = "id") -> DataFrame:
    """The rows of a batch to append: the first of each key that isn't there yet. NULL is a value like others."""
    have = existing.select(*[F.coalesce(F.col(k), F.lit("")).alias(f"_{k}") for k in keys]).distinct()
    marked = batch
    for k in keys:
        marked = marked.withColumn(f"_{k}", F.coalesce(F.col(k), F.lit("")))
    rank = F.row_number().over(Window.partitionBy(*[f"_{k}" for k in keys]).orderBy(order))
    fresh = marked.withColumn("_n", rank).filter("_n = 1").join(have, [f"_{k}" for k in keys], "left_anti")
    return fresh.select(*batch.columns)


def search(df: DataFrame, q: str = "", tech: str = "", city: str = "") -> DataFrame:
    """Rows with a text in domain, phones, e-mails or name, one in the technologies, and an exact city; each optional."""
    if q:
        like = f"%{q}%"
        df = df.filter(F.col("domain").ilike(like) | F.col("phones").ilike(like) | F.col("emails").ilike(like) | F.col("business_name").ilike(like))
    if tech:
        df = df.filter(F.col("technologies").ilike(f"%{tech}%"))
    if city:
        df = df.filter(F.col("city") == city)
    return df


def merged_values(df: DataFrame, key: str, column: str, by: str, out: str, latest_first: tuple[Column, ...]) -> DataFrame:
    """(key, out): the distinct values of a delimited column per key, in order of their first row, joined again.

    Values are reduced to their first place per key before they are gathered, so a key with
    very many rows gathers its distinct values only.
    """
    at = F.struct(*latest_first, F.col("pos"))
    values = df.select(key, *[c for c in df.columns if c in ("crawled_at", "id")], F.posexplode(split_list(F.col(column), by)).alias("pos", "v"))
    first = values.groupBy(key, "v").agg(F.min(at).alias("at"))
    joiner = "; " if by == ";" else ","
    return first.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]), joiner).alias(out))


def latest_first(time_col: str = "crawled_at") -> Column:
    """An ascending key that puts later times first, NULL and unreadable ones last."""
    return F.lit(0) - F.coalesce(F.unix_micros(F.col(time_col).try_cast("timestamp")), F.lit(-(2**60)))


def sites(df: DataFrame) -> DataFrame:
    """One row per domain for export: unions of phones, e-mails, technologies and pages, the longest address, name, category and city,
    the best score, the latest time, the first title; rows in order of crawled_at, latest first, then id.

    Socials (first profile of each network) and evidence (pages, sources by field, counts of links) are merged JSON
    with sorted keys, for input that has those columns.
    """
    rows = df.withColumn("domain", F.coalesce("domain", F.lit("")))
    late = latest_first()
    order = (late, F.col("id"))
    at = F.struct(*order)

    def longest(c: str) -> Column:
        v = F.when(stripped(F.coalesce(F.col(c), F.lit(""))) != "", stripped(F.col(c)))
        return F.coalesce(F.max_by(v, F.when(v.isNotNull(), F.struct(F.length(v), late * -1, F.col("id") * -1))), F.lit("")).alias(c)

    single = rows.groupBy("domain").agg(
        *[longest(c) for c in ("address", "business_name", "category", "city")], F.coalesce(F.round(F.max("quality_score"), 2), F.lit(0.0)).alias("quality_score"), F.max("crawled_at").alias("crawled_at"),
        F.min_by(F.when(stripped(F.col("title")) != "", stripped(F.col("title"))), F.when(stripped(F.col("title")) != "", at)).alias("title"), F.count("*").alias("n_rows"),
    )
    out = single
    for column, by in (("phones", ","), ("emails", ","), ("technologies", ";"), ("source_url", "\n")):
        out = out.join(merged_values(rows, "domain", column, by, column, order), "domain", "left").withColumn(column, F.coalesce(column, F.lit("")))
    if "socials" in df.columns:
        first = merged_json(rows, "domain", "socials", order)
        merged = first.groupBy("domain").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("socials"))
        out = out.join(merged, "domain", "left").withColumn("socials", F.coalesce("socials", F.lit("{}")))
    if "evidence" in df.columns:
        merged = evidence_json(merged_evidence(rows, "domain", "evidence", "source_url", order))
        out = out.join(merged, "domain", "left").withColumn("evidence", F.coalesce("evidence", F.lit("{}")))
    return out


def panel_sites(df: DataFrame) -> DataFrame:
    """One row per site for lists: values of all rows in order, mobiles and landlines apart, last non-empty city and category, latest time, first page.

    Rows count in order of crawled_at, then id; blank domains are no site.
    """
    at = F.struct("crawled_at", "id")
    filled = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    rows = df.withColumn("site", F.lower(F.trim("domain"))).filter("site <> ''")
    single = rows.groupBy("site").agg(
        F.max_by(filled("city"), F.when(filled("city").isNotNull(), at)).alias("city"), F.max_by(filled("category"), F.when(filled("category").isNotNull(), at)).alias("category"),
        F.max("crawled_at").alias("crawled_at"), F.min_by(filled("source_url"), F.when(filled("source_url").isNotNull(), at)).alias("source_url"), F.count("*").alias("n_rows"),
    )
    out = single
    for column, by in (("phones", ","), ("emails", ","), ("technologies", ";")):
        out = out.join(merged_values(rows, "site", column, by, column, (F.col("crawled_at"), F.col("id"))), "site", "left").withColumn(column, F.coalesce(column, F.lit("")))
    of = lambda kind: F.array_join(F.filter(split_list(F.col("phones")), lambda p: classify_phone(p) == kind), ",")
    return out.withColumns({"mobiles": of("mobile"), "landlines": of("landline")})


def panel_page(df: DataFrame, q: str = "", tech: str = "", city: str = "", page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of the sites that rows found by ``search`` make, latest first, with their total and the number of pages."""
    return with_totals(panel_sites(search(df, q, tech, city)), page, per_page, F.col("crawled_at").desc_nulls_last(), F.col("site"))


def shown(df: DataFrame) -> DataFrame:
    """Columns as lists show them: times to the minute, lists with spaces, - for what is blank."""
    dash = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("-"))
    cells = {c: dash(F.substring(F.col(c), 1, 16)) for c in ("crawled_at", "first_seen") if c in df.columns}
    return df.withColumns(cells | {c: dash(F.regexp_replace(c, r"\s*,\s*", ", ")) for c in ("phones", "emails", "mobiles", "landlines") if c in df.columns})


def stats(df: DataFrame, edges: DataFrame, urls: DataFrame) -> DataFrame:
    """One row of all figures: sites and what they have, links, URLs."""
    return panel_figures(df).crossJoin(crawl_figures(edges, urls))  # one row each


def panel_figures(df: DataFrame) -> DataFrame:
    """One row of counts over sites."""
    rows = df.withColumn("site", F.lower(F.trim("domain"))).filter("site <> ''")
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    by = rows.groupBy("site").agg(
        F.max(filled("phones")).alias("phones"), F.max(filled("emails")).alias("emails"), F.max(F.coalesce(F.col("technologies").contains("WordPress"), F.lit(False))).alias("wp"),
        F.max(F.coalesce(F.col("technologies").contains("WooCommerce"), F.lit(False))).alias("woo"),
    )
    cities = rows.agg(F.count_distinct(F.when(filled("city"), F.col("city"))).alias("n_cities"))
    return by.agg(F.count("*").alias("n_sites"), F.count_if("phones").alias("n_with_phones"), F.count_if("emails").alias("n_with_emails"), F.count_if("wp").alias("n_wordpress"), F.count_if("woo").alias("n_woocommerce")).crossJoin(cities)


def merged_json(df: DataFrame, key: str, column: str, order: tuple[str | Column, ...] = ("id",)) -> DataFrame:
    """(key, name, value): the first non-empty value of each name over a key's JSON objects; broken JSON is ignored."""
    pairs = df.select(key, F.struct(*order).alias("at"), F.explode(F.from_json(F.when(F.try_parse_json(column).isNotNull(), F.col(column)), "map<string,string>")).alias("name", "value")).filter("trim(value) <> ''")
    return pairs.groupBy(key, "name").agg(F.min_by("value", F.struct("at", "value")).alias("value"))


# Keys of evidence that are no fields.
EVIDENCE_KEYS = ("page", "field_sources", "tel_links", "mailto_links")


def flat_sources(evidence: Column) -> Column:
    """Sources by field where evidence names the fields themselves, each with a list or a single source."""
    fields = F.map_filter(F.from_json(evidence, "map<string,string>"), lambda k, v: ~k.isin(*EVIDENCE_KEYS))
    return F.transform_values(fields, lambda k, v: F.when(v.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(F.when(v.startswith("["), v), "array<string>"), F.array(v))))


def _in_order(key: list[str], rows: DataFrame, value: str, out: str) -> DataFrame:
    """(key, out): distinct values in order of their first place, which is reduced before values are gathered."""
    first = rows.groupBy(*key, value).agg(F.min("at").alias("at"))
    listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("at", F.col(value).alias("v")))))
    return first.groupBy(*key).agg(F.transform(listed, lambda x: x["v"]).alias(out))


def merged_evidence(rows: DataFrame, key: str = "domain", column: str = "evidence", page: str | None = None, order: tuple[Column, ...] = ()) -> DataFrame:
    """(key, pages, field_sources, tel_links, mailto_links): a site's evidence, from JSON of its rows.

    Pages and sources are distinct, in order of their first row by ``order`` (then by value), and made so before they are gathered;
    fields without a source keep an empty list. Broken JSON counts as nothing. page: a column that names the page where the evidence doesn't.
    """
    schema = "page string, field_sources map<string,array<string>>, tel_links int, mailto_links int"
    e = F.from_json(F.coalesce(column, F.lit("{}")) if page else F.col(column), schema)
    parsed = rows.select(key, e.alias("e"), flat_sources(F.col(column)).alias("flat"), (F.col(page) if page else F.lit(None)).alias("p"), F.struct(*order, F.lit(0)).alias("row")).filter("e is not null")
    parsed = parsed.withColumn("e", F.struct(F.coalesce("e.page", "p").alias("page"), F.coalesce("e.field_sources", "flat").alias("field_sources"), "e.tel_links", "e.mailto_links"))
    sums = parsed.groupBy(key).agg(F.sum(F.greatest(F.coalesce("e.tel_links", F.lit(0)), F.lit(0))).alias("tel_links"), F.sum(F.greatest(F.coalesce("e.mailto_links", F.lit(0)), F.lit(0))).alias("mailto_links"))
    place = lambda i, v: F.struct("row", i, v).alias("at") if order else F.struct(v).alias("at")
    pages = _in_order([key], parsed.select(key, F.col("e.page").alias("u"), place(F.lit(0), F.col("e.page"))), "u", "pages")
    sources = parsed.select(key, "row", F.explode("e.field_sources").alias("field", "urls")).select(key, "row", "field", F.posexplode_outer("urls").alias("i", "u"))
    lists = _in_order([key, "field"], sources.select(key, "field", "u", place(F.col("i"), F.col("u"))), "u", "urls")
    maps = lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "urls")))).alias("field_sources"))
    return sums.join(pages, key).join(maps, key, "left")


def evidence_json(merged: DataFrame, key: str = "domain") -> DataFrame:
    """(key, evidence): merged evidence as JSON; what is empty or 0 is left out."""
    has = {"pages": F.size("pages") > 0, "field_sources": F.size("field_sources") > 0, "tel_links": F.col("tel_links") != 0, "mailto_links": F.col("mailto_links") != 0}
    return merged.select(key, F.to_json(F.struct(*[F.when(there, F.col(c)).alias(c) for c, there in has.items()])).alias("evidence"))


def technology_evidence(df: DataFrame, before: tuple[str, ...] = ()) -> DataFrame:
    """One row per (domain, technology): highest confidence, summed evidence, first and last sight, first source (in order of ``before``, then time)."""
    at = F.struct(*before, "first_seen", "source_url")
    return df.filter("trim(domain) <> '' and trim(technology) <> ''").groupBy("domain", "technology").agg(
        F.max("confidence").alias("confidence"), F.sum("evidence_count").alias("evidence_count"), F.min_by("source_url", at).alias("source_url"), F.min_by("first_seen", F.when(F.col("first_seen").isNotNull(), at)).alias("first_seen"), F.max("last_seen").alias("last_seen")
    )


def merged_technologies(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Stored evidence with a batch folded in: stored rows come first, whatever their times."""
    both = stored.withColumn("_late", F.lit(0)).unionByName(batch.withColumn("_late", F.lit(1)), allowMissingColumns=True)
    return technology_evidence(both, ("_late",))


def site_technologies(evidence: DataFrame) -> DataFrame:
    """Technologies of each site numbered by falling confidence, then name; a site has as many rows as technologies."""
    place = F.row_number().over(Window.partitionBy("domain").orderBy(F.col("confidence").desc(), "technology", "source_url"))
    return evidence.select("domain", place.alias("place"), "technology", "confidence", "evidence_count", "source_url")


def cells(sites_df: DataFrame) -> DataFrame:
    """(domain, kind, pos, value): every value of the wide export as a row, however many a site has.

    kind is phone, tel, email or technology, pos the place among the site's values of the kind. Long, as the widest
    site sets the number of columns of a wide table, and misspelt technologies are names of their own.
    """
    forms = F.array_distinct(F.transform(split_list(F.col("phones")), normalize_iranian))
    names = F.transform(split_list(F.col("technologies"), ";"), lambda t: F.trim(F.split_part(t, F.lit("("), F.lit(1))))
    of = lambda kind: F.filter("_p", lambda p: classify_phone(p) == kind)
    df = sites_df.select("domain", forms.alias("_p"), split_list(F.col("emails")).alias("email"), F.array_distinct(F.filter(names, lambda t: t != "")).alias("technology"))
    kinds = F.create_map(F.lit("phone"), of("mobile"), F.lit("tel"), of("landline"), F.lit("email"), F.col("email"), F.lit("technology"), F.col("technology"))
    lists = df.select("domain", F.explode(kinds).alias("kind", "values"))
    return lists.select("domain", "kind", F.posexplode("values").alias("pos", "value")).withColumn("pos", F.col("pos") + 1)


def safe_name(name: str) -> str:
    """A value as part of a column name."""
    return "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in name.lower()).strip("_") or "unknown"


def wide(sites_df: DataFrame) -> DataFrame:
    """Site rows with one value per cell, '' where there is none; what has no lists stays as it is, before the new columns.

    phone_1.., tel_1.., email_1.. and evidence_pages_1.. are as many as the longest list needs; technology_1.. has a column per
    technology that occurs (order of presentation, unknown ones sorted behind), social_.. one per network. Widths and names are
    found by one aggregate, so they alone reach the driver; ``cells`` is the long form for data of any width.
    """
    forms = F.array_distinct(F.transform(split_list(F.col("phones")), normalize_iranian))
    made = {
        "_phone": F.filter(forms, lambda p: classify_phone(p) == "mobile"), "_tel": F.filter(forms, lambda p: classify_phone(p) == "landline"), "_email": split_list(F.col("emails")),
        "_technology": F.filter(F.transform(split_list(F.col("technologies"), ";"), lambda t: F.trim(F.split_part(t, F.lit("("), F.lit(1)))), lambda t: t != ""),
    }
    if "socials" in sites_df.columns:
        made["_social"] = F.map_filter(F.coalesce(F.from_json("socials", "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>")), lambda k, v: F.trim(v) != "")
    if "evidence" in sites_df.columns:
        e = F.from_json("evidence", "pages array<string>, field_sources string, tel_links bigint, mailto_links bigint")
        made |= {"_evidence_pages": F.coalesce(e["pages"], F.array().cast("array<string>"))} | {f"_{k}": e[k].cast("string") for k in ("field_sources", "mailto_links", "tel_links")}
    lost = ("phones", "emails", "technologies", "socials", "evidence")
    df = keep(sites_df.withColumns(made).drop(*lost), "site-lists")  # read twice: for its widths and for its cells
    names = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c))))
    lists = [c for c in ("_phone", "_tel", "_email", "_evidence_pages") if c in made]
    found = [F.max(F.size(c)).alias(c) for c in lists] + [names(F.col("_technology")).alias("_technology")]
    found += [names(F.map_keys("_social")).alias("_social")] if "_social" in made else []
    found += [F.count_if(F.col(c).isNotNull()).alias(c) for c in ("_field_sources", "_mailto_links", "_tel_links") if c in made]
    seen = df.agg(*found, F.count("*").alias("_rows")).first()
    listed = {c: [f"{c[1:]}_{i + 1}" for i in range(seen[c] or 0)] for c in lists}
    technologies = [t for t in TECHNOLOGY_ORDER if t in seen["_technology"]] + [t for t in seen["_technology"] if t not in TECHNOLOGY_ORDER]
    placed = {"_technology": {t: f"technology_{i}" for i, t in enumerate(technologies, 1)}, "_social": {n: f"social_{safe_name(n)}" for n in seen["_social"]} if "_social" in made else {}}
    columns = [*listed["_phone"], *listed["_tel"], *listed["_email"], *placed["_technology"].values(), *placed["_social"].values()]
    if "_evidence_pages" in made:
        one = {c: [f"evidence{c}"] if seen[c] else [] for c in ("_field_sources", "_mailto_links", "_tel_links")}
        columns += one["_field_sources"] + one["_mailto_links"] + listed["_evidence_pages"] + one["_tel_links"]
        listed |= one
    plain = [c for c in sites_df.columns if c not in lost]
    if (cells := seen["_rows"] * (len(plain) + len(columns))) > TASK_CELLS:
        cores = sites_df.sparkSession.sparkContext.defaultParallelism
        df = df.repartition(-(-cells // (TASK_CELLS * cores)) * cores)
    return _in_columns(df, plain, columns, listed, placed)


#: Cells of a batch that goes back to the JVM, and of a task: what a Parquet row group of 128 MB holds, at 4 bytes a blank.
BATCH_CELLS, TASK_CELLS = 4_000_000, 32_000_000


def _in_columns(df: DataFrame, plain: list[str], columns: list[str], listed: dict[str, list[str]], placed: dict[str, dict[str, str]]) -> DataFrame:
    """``plain`` columns and a text column for each of ``columns``: the i-th value of a list goes to the i-th name listed for it, others where ``placed`` says.

    Nearly all cells are blank, and a blank column of a batch is one array for all of them; a plan with an expression a column would take longer than the work.
    A cell is never NULL and its column says so, which spares a writer a level for each of them.
    """
    free: dict[str, list[int]] = {}
    for i in reversed(range(len(columns))):  # names that come twice have columns of their own, in order
        free.setdefault(columns[i], []).append(i + len(plain))
    listed = {c: [free[n].pop() for n in names] for c, names in listed.items() if names}
    placed = {c: {v: free[n].pop() for v, n in names.items()} for c, names in placed.items() if names}
    schema = T.StructType([df.schema[c] for c in plain] + [T.StructField(c, T.StringType(), False) for c in columns])
    rows_at_once = max(BATCH_CELLS // max(len(schema), 1), 1)

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for whole in batches:
            for start in range(0, whole.num_rows, rows_at_once):
                part = whole.slice(start, rows_at_once)
                n, filled = part.num_rows, {}
                for c, to in listed.items():
                    for r, values in enumerate(part.column(c).to_pylist()):
                        for i, v in zip(to, values if isinstance(values, list) else [values]):
                            filled.setdefault(i, {})[r] = v
                for c, to in placed.items():
                    for r, values in enumerate(part.column(c).to_pylist()):
                        for k, v in values if c == "_social" else ((v, v) for v in values or ()):
                            if k in to:
                                filled.setdefault(to[k], {})[r] = v
                blank = pa.array([""] * n, pa.string())
                arrays = [part.column(c) for c in plain] + [pa.array([filled[i].get(r) or "" for r in range(n)], pa.string()) if i in filled else blank for i in range(len(plain), len(names))]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return df.select(*plain, *listed, *placed).mapInArrow(spread_out, schema)
