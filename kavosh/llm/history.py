"""Checking new batches against all that was accepted before: multi-key sorted-neighbourhood runs.

``AcceptedRuns`` keeps one entry per accepted record and sort order: its place (the sort key) and the id under which it was first
accepted. Places are cut into key ranges of about equally many entries; each batch leaves one sorted run, stored by range. What a
batch costs:

1. It is reduced to one entry per place before anything else (a partial aggregate on the map side, so a key with a third of
   the batch costs one row a task) and its ranges are looked up by binary search among the ranges' first places.
2. Of the stored runs only the ranges it touches are read (directories are pruned; with windows, the ranges beside them too).
   Without windows, an entry counts only if its place is in the batch: nearly all others are dropped where they are read, by bits
   of the batch's places, so history is scanned but neither shuffled nor sorted. With windows, a batch much smaller than these drops
   all entries that lie further than a window from every new one.
3. Entries are merged in order range by range, and only windows around new entries are compared: an equal place is the same
   record, one that shares at least ``LEAST`` of all words is a near-duplicate. Windows go on across the ends of ranges.
4. What is new is the next run. After ``compact_every`` runs all are merged into one and cut into ranges anew, their number following
   that of the entries. The note ``MANIFEST`` says what is valid: another session opens the store by its path.

Several sort orders of a record (a page by its path and by its parameters; by page and by numbers) are several places in
one store, so two records apart in one order may be neighbours in another. An order must be a rearrangement of the whole
record: equal places are equal records in every order.

Results: records whose key is NULL are never duplicates; ties go to the smaller id; a batch may be empty; a NULL batch number counts
as the last batch; repeated rows of one id give one case at most; near-duplicates have different keys, and a record is
compared with its ``window`` neighbours on each side in each order, as the method does, not with all.
"""

from __future__ import annotations

import json
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kavosh.functions.phones import number_set
from kavosh.functions.text import bound
from kavosh.functions.urls import page
from kavosh.sources.tables import load, read_note, remove, shared_folder, write_note

#: Entries of a range, neighbours compared on each side, and the least share of common words of near-duplicates.
RANGE_ENTRIES, WINDOW, LEAST = 1_000_000, 4, 0.8
MANIFEST = "manifest.json"
#: A batch is looked up where the runs are read if its places take less than this; else all touched ranges are merged.
LOOKUP_BYTES = 16 << 20
#: Words of bits that say which places a batch has, at most: they are broadcast (some 30 MB). Larger batches let more strangers through.
MOST_WORDS = 1 << 19
_ENTRY = "place string, first_id bigint, opens boolean, n bigint, new boolean, nearest struct<similarity:double,id:bigint>, side int, range int"
_SEP = "\u0001"


def places(space: Column, orders: Column) -> Column:
    """The places of a record, one per sort order; NULL orders have none."""
    return F.transform(F.filter(orders, lambda o: o.isNotNull()), lambda o, i: F.concat(space, F.lit(_SEP), i.cast("string"), F.lit(_SEP), o))


def _words(place: Column) -> Column:
    parted = F.translate(F.substring_index(place, _SEP, -1), "/?&,\t ", 6 * "\u0002")
    return F.array_distinct(F.array_remove(F.split(parted, "\u0002"), ""))


def _same_space(a: Column, b: Column) -> Column:
    return F.substring_index(a, _SEP, 2) == F.substring_index(b, _SEP, 2)


def around(entries: DataFrame, wanted: list[str], window: int) -> DataFrame:
    """The entries within ``window`` places of a wanted one, batch by batch of a sorted scan; a superset of what a merge would compare."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf.sort_values("place", ignore_index=True)
            own = pdf["place"].to_numpy(object)
            # of the wanted places before and after these entries, the nearest say as much as all
            near = np.array(wanted[max(bisect_left(wanted, own[0]) - 1, 0) : bisect_right(wanted, own[-1]) + 1], object)
            low, high = np.searchsorted(own, near, "left") - window, np.searchsorted(own, near, "right") + window
            marks = np.zeros(len(own) + 1, np.int64)
            np.add.at(marks, np.maximum(low, 0), 1)
            np.add.at(marks, np.minimum(high, len(own)), -1)
            yield pdf[np.cumsum(marks[:-1]) > 0]

    return entries.mapInPandas(walk, entries.schema)


def maybe_in(entries: DataFrame, fresh: DataFrame, n_fresh: int) -> DataFrame:
    """The entries whose place is among those of ``fresh``, and a few others: two bits of a word tell, both chosen by the place's hash."""
    words = min(1 << max(n_fresh // 8, 1).bit_length(), MOST_WORDS)
    bit = lambda at: f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(place), {at}) & 63 as int))"
    word, bits = F.expr(f"xxhash64(place) & {words - 1}L").alias("word"), F.expr(f"{bit(40)} | {bit(52)}").alias("bits")
    marks = fresh.select(word, bits).groupBy("word").agg(F.bit_or("bits").alias("seen"))
    return entries.select("*", word, bits).join(F.broadcast(marks), "word").filter("(bits & seen) = bits").select(*entries.columns)


class AcceptedRuns:
    """A store of sorted runs under ``path``; opens what is there, else begins an empty one."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, compact_every: int = 6, range_entries: int = RANGE_ENTRIES):
        self.spark, self.window, self.compact_every, self.range_entries = spark, window, compact_every, range_entries
        self.path = path or f"{shared_folder(spark)}/runs-{uuid.uuid4().hex}"
        said = json.loads(read_note(spark, f"{self.path}/{MANIFEST}") or '{"runs": [], "first": [], "entries": 0}')
        self.runs: list[str] = said["runs"]
        self.first: list[str] = said["first"]  # the first place of each range but the lowest
        self.entries: int = said["entries"]

    def _say(self) -> None:
        write_note(self.spark, f"{self.path}/{MANIFEST}", json.dumps({"runs": self.runs, "first": self.first, "entries": self.entries}))

    def history(self, ranges: list[int] | None = None) -> DataFrame | None:
        """(place, first_id, range) of all that was accepted, or of some ranges alone."""
        if not self.runs:
            return None
        out = self.spark.read.option("basePath", self.path).schema(_ENTRY).parquet(*[f"{self.path}/{r}" for r in self.runs])
        return (out if ranges is None else out.filter(F.col("range").isin(ranges))).filter("opens").select("place", "first_id", "range")

    def _range(self, place: Column) -> Column:
        """How many ranges begin at or before a place: binary search, in the JVM."""
        n = len(self.first)
        if not n:
            return F.lit(0)
        first, steps = F.array(*[F.lit(f) for f in self.first]), [1 << b for b in reversed(range(n.bit_length()))]
        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= n) & (F.get(first, at + s - 1) <= place), at + s).otherwise(at))

    def _cut(self, entries: DataFrame, n_entries: int) -> DataFrame:
        """``entries`` sorted into ranges of about equal size; ``range`` is their number."""
        n = max(self.spark.sparkContext.defaultParallelism, -(-8 * n_entries // self.range_entries))  # an eighth full, as stores grow; each range is a folder of each run
        return entries.repartitionByRange(n, "place").sortWithinPartitions("place").withColumn("range", F.spark_partition_id())

    def _begin_at(self, cut: DataFrame) -> None:
        lowest = cut.groupBy("range").agg(F.min("place").alias("place")).orderBy("range").collect()  # one row a range
        self.first = [r["place"] for r in lowest[1:]]

    def compact(self) -> None:
        """Merge all runs into one and cut the ranges anew."""
        merged = self.history()
        if merged is None:
            return
        run = f"run=r{uuid.uuid4().hex}"
        whole = merged.select("place", "first_id", F.lit(True).alias("opens"))
        self._cut(whole, self.entries).write.partitionBy("range").option("compression", "zstd").parquet(f"{self.path}/{run}")
        self.runs = [run]
        self._begin_at(self.spark.read.schema("place string, first_id bigint, range int").parquet(f"{self.path}/{run}"))
        self._say()

    def add(self, batch: DataFrame, near: bool = False) -> DataFrame:
        """Merge a batch of (places, id) in; returns (place, first_id, n, opens, near_id, similarity) of each of its places.

        n counts the batch's rows, opens says that the place is new, near_id the accepted record nearest to a new place (with ``near``).
        The result is stored, so reading it later doesn't depend on runs still to come.
        """
        spark, run = self.spark, f"run=r{uuid.uuid4().hex}"
        fresh_path = f"{self.path}/fresh-{uuid.uuid4().hex}"
        rows = batch.select("id", F.explode("places").alias("place")).groupBy("place").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
        rows = rows.withColumn("range", self._range(F.col("place"))) if self.entries else rows  # looked up once; the first batch makes the ranges
        rows.write.option("compression", "zstd").parquet(fresh_path)
        fresh = spark.read.schema(f"place string, first_id bigint, n bigint{', range int' if self.entries else ''}").parquet(fresh_path)
        if not self.entries:
            if n_first := fresh.count():
                self._begin_at(self._cut(fresh, n_first))
            fresh = fresh.withColumn("range", self._range(F.col("place")))
        fresh = fresh.withColumn("new", F.lit(True))
        by_range = fresh.groupBy("range").agg(F.count("*").alias("n"), F.sum(F.length("place")).alias("size")).collect()  # at most one row a range
        touched, n_fresh, size = {r["range"] for r in by_range}, sum(r["n"] for r in by_range), sum(r["size"] for r in by_range)
        read = sorted({r + d for r in touched for d in ((-1, 0, 1) if near else (0,))})
        merged, old = fresh, self.history(read)
        if old is not None:
            if not near:
                old = maybe_in(old, fresh, n_fresh)
            elif n_fresh * 16 * self.window < self.entries and size < LOOKUP_BYTES:
                old = around(old, [r[0] for r in fresh.select("place").orderBy("place").collect()], self.window)
            merged = old.withColumns({"new": F.lit(False), "n": F.lit(0).cast("bigint")}).unionByName(fresh)
        order = Window.partitionBy("range").orderBy("place", "new")
        same = F.lag("place").over(order) == F.col("place")
        columns = {"accepted": F.when(same, F.lag("first_id").over(order))}
        if near:
            beside = [f(F.struct("place", "first_id"), i).over(order) for i in range(1, self.window + 1) for f in (F.lag, F.lead)]
            at, count = F.row_number().over(order), F.count("*").over(Window.partitionBy("range"))
            side = F.when(at <= self.window, 1).otherwise(0) + F.when(count - at < self.window, 2).otherwise(0)  # 1, 2, 3: at the lower end, the upper, both
            columns |= {"beside": F.when(F.col("new"), F.array(*beside)), "side": side}
        else:
            columns |= {"side": F.lit(0)}
        merged = merged.withColumns(columns).filter("new or side > 0")
        nearest = self._nearest(F.col("beside")) if near else F.lit(None).cast("struct<similarity:double,id:bigint>")
        out = merged.select("place", F.least("accepted", "first_id").alias("first_id"), (F.col("new") & F.col("accepted").isNull()).alias("opens"), "n", "new", nearest.alias("nearest"), "side", "range")
        out.write.partitionBy("range").option("compression", "zstd").parquet(f"{self.path}/{run}")
        remove(spark, fresh_path)
        step = spark.read.option("basePath", self.path).schema(_ENTRY).parquet(f"{self.path}/{run}")
        self.runs.append(run)
        self.entries += step.filter("opens").count()
        if len(self.runs) > self.compact_every:
            self.compact()
        self._say()
        found = step.filter("new").select("place", "first_id", "n", "opens", (-F.col("nearest.id")).alias("near_id"), "nearest.similarity")
        return found.unionByName(self._across(step)) if near else found

    def _nearest(self, beside: Column) -> Column:
        """(similarity, id), the id negative, of the likest of some neighbours that came before; NULL without one of at least ``LEAST``."""
        before = F.filter(beside, lambda b: b.isNotNull() & (b["first_id"] < F.col("first_id")) & (b["place"] != F.col("place")) & _same_space(b["place"], F.col("place")))

        def likest(mine: Column) -> Column:
            words = F.transform(before, lambda b: F.struct(_words(b["place"]).alias("w"), (-b["first_id"]).alias("id")))
            common = F.transform(words, lambda b: F.struct(F.size(F.array_intersect(mine, b["w"])).alias("c"), F.size(b["w"]).alias("n"), b["id"].alias("id")))
            scored = F.transform(common, lambda b: F.struct((b["c"] / (F.size(mine) + b["n"] - b["c"])).alias("similarity"), b["id"].alias("id")))
            return F.array_max(F.filter(scored, lambda s: s["similarity"] >= LEAST))

        return bound(_words(F.col("place")), likest)

    def _across(self, step: DataFrame) -> DataFrame:
        """The same for windows across the ends of ranges: at most ``window`` entries on either side of each end meet."""
        ends = F.concat(F.when(F.col("side").isin(1, 3), F.array("range")).otherwise(F.array().cast("array<int>")), F.when(F.col("side").isin(2, 3), F.array(F.col("range") + 1)).otherwise(F.array().cast("array<int>")))
        order = Window.partitionBy("end").orderBy("place", "new")
        beside = [f(F.struct("place", "first_id"), i).over(order) for i in range(1, self.window + 1) for f in (F.lag, F.lead)]
        met = step.filter("side > 0").drop("nearest").withColumn("end", F.explode(ends)).withColumn("beside", F.array(*beside)).filter("opens")
        found = met.select("place", "first_id", "n", "opens", self._nearest(F.col("beside")).alias("nearest"))
        return found.select("place", "first_id", "n", "opens", (-F.col("nearest.id")).alias("near_id"), "nearest.similarity")


def page_batches(spark: SparkSession, sf_dir: str, orders: int = 1) -> DataFrame:
    """(space, key, id, batch_no, places) of crawl_urls and of contacts that bring numbers.

    The second order has what follows the page's host, or the numbers, before the rest.
    """
    urls = load(spark, sf_dir, "crawl_urls").select(F.lit("crawl_urls").alias("space"), page(F.col("url")).alias("key"), F.lit(None).cast("string").alias("numbers"), F.col("url_id").alias("id"), "batch_no")
    contacts = load(spark, sf_dir, "contacts").select(F.lit("contacts").alias("space"), page(F.col("source_url")).alias("key"), number_set(F.col("phones")).alias("numbers"), "id", "batch_no")
    rows = urls.unionByName(contacts)  # unfiltered: a filter would compute the keys a second time
    whole = F.when((F.col("space") == "crawl_urls") | F.col("numbers").isNotNull(), F.concat(F.col("key"), F.coalesce(F.concat(F.lit(" "), F.col("numbers")), F.lit(""))))
    turned = F.when(F.col("numbers").isNotNull(), F.concat_ws(" ", "numbers", "key")).otherwise(F.concat(F.regexp_extract("key", "^[^/?]*[/?]*(.*)$", 1), F.lit(" "), F.regexp_extract("key", "^[^/?]*[/?]*", 0)))
    return rows.select("space", whole.alias("key"), "id", "batch_no", places(F.col("space"), F.array(*[whole, turned][:orders])).alias("places"))


def _by_batch(records: DataFrame, near: bool, compact_every: int, window: int) -> tuple[DataFrame, DataFrame | None]:
    """The records as stored by batch, and what each batch's places were found to be."""
    spark = records.sparkSession
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    records.select("places", "id", F.coalesce("batch_no", F.lit(2**31 - 1)).alias("batch_no")).write.partitionBy("batch_no").parquet(folder)
    stored = spark.read.schema("places array<string>, id bigint, batch_no int").parquet(folder).filter("size(places) > 0 and id is not null")
    runs, found = AcceptedRuns(spark, window=window, compact_every=compact_every), None
    for b in sorted(r[0] for r in stored.select("batch_no").distinct().collect()):  # numbers of batches
        step = runs.add(stored.filter(F.col("batch_no") == b), near).withColumn("batch_no", F.lit(b))
        found = step if found is None else found.unionByName(step)
    return stored, found


def duplicates_by_batch(records: DataFrame, compact_every: int = 6) -> DataFrame:
    """(tab, first_id, dup_id) of each record whose key was accepted before, batch after batch.

    ``records``: (space, key, id, batch_no) or with their ``places``. Keys are computed once and stored by batch. Equal records are
    neighbours in every order, so one order is enough here. Only places that occurred before or repeatedly can have a case; a
    record finds its first id by joining with them, and a hot key's records are split by AQE, as the other side has one row.
    """
    if "places" not in records.columns:
        records = records.withColumn("places", F.when(F.col("key").isNotNull(), places(F.col("space"), F.array("key"))))
    stored, found = _by_batch(records, False, compact_every, WINDOW)
    if found is None:
        return stored.select(F.lit("").alias("tab"), F.col("id").alias("first_id"), F.col("id").alias("dup_id"))
    known = found.filter("n > 1 or not opens").select("place", "first_id", "batch_no")
    joined = stored.select("id", "batch_no", F.get("places", F.lit(0)).alias("place")).join(known, ["batch_no", "place"])
    return joined.filter("id <> first_id").select(F.substring_index("place", _SEP, 1).alias("tab"), "first_id", F.col("id").alias("dup_id")).distinct()


def near_duplicates_by_batch(records: DataFrame, compact_every: int = 6, window: int = WINDOW) -> DataFrame:
    """(tab, near_id, new_id, similarity): of each record new to the store, the likest one accepted before it among its neighbours.

    Records count by their first ids, one row per key; copies of a record share it (``duplicates_by_batch``).
    """
    stored, found = _by_batch(records, True, compact_every, window)
    if found is None:
        return stored.select(F.lit("").alias("tab"), F.col("id").alias("near_id"), F.col("id").alias("new_id"), F.lit(0.0).alias("similarity"))
    hits = found.filter("opens and near_id is not null").select(F.substring_index("place", _SEP, 1).alias("tab"), "first_id", "similarity", (-F.col("near_id")).alias("near"))
    best = hits.groupBy("tab", "first_id").agg(F.max(F.struct("similarity", "near")).alias("x"))
    return best.select("tab", (-F.col("x.near")).alias("near_id"), F.col("first_id").alias("new_id"), F.round("x.similarity", 6).alias("similarity"))
