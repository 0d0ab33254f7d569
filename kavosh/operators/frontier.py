"""States of URLs and of layered crawls: logs of operations folded into states, and steps of a crawl as joins.

A log has one row per operation: seq (unique), op, url, domain, source_url, reason, at. Operations are
``reserve`` (opens a URL that isn't there), ``reserve_seed`` (queues it whatever it was), ``crawled``, ``failed``
and, without a URL, ``reset`` (every failed URL may be tried again). Only the last operation of each kind decides a URL's
state, so the fold is one aggregate with partial sums on the map side: a URL with a third of the log leaves one row a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kavosh.functions.urls import site_key
from kavosh.operators.layers import finished_depth, lowest_open_layer

STATE = "url string, domain string, status string, source_url string, first_seen string, crawled_at string, failure_reason string"
OPENING = ("reserve", "reserve_seed")
OPEN = ("pending", "queued")


def _last(op: str, *columns: str) -> Column:
    return F.max(F.when(F.col("op") == op, F.struct("seq", *columns))).alias(op)


def url_states(ops: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The state of each URL after a log, in the columns of ``STATE``; ``known`` is the state before it.

    Marks of URLs that were never reserved do nothing. A seed is queued anew and loses its time of crawling but not the
    reason it once failed for; a failure keeps the time of crawling; blank reasons are NULL.
    """
    columns = [x.split()[0] for x in STATE.split(", ")]
    log = ops.filter("url is not null")
    if known is None:
        log = log.withColumns({f"was_{c}": F.lit(None).cast("string") for c in columns[1:]})
    else:
        before = known.select("url", F.lit("known").alias("op"), *[F.col(c).cast("string").alias(f"was_{c}") for c in columns[1:]])
        log = log.unionByName(before, allowMissingColumns=True)
    folded = log.groupBy("url").agg(
        F.min(F.when(F.col("op").isin(*OPENING), F.struct("seq", "domain", "source_url", "at"))).alias("opened"), _last("reserve_seed", "domain", "source_url", "at"), _last("crawled", "at"), _last("failed", "reason"),
        F.max(F.when(F.col("op") == "known", F.struct(*[f"was_{c}" for c in columns[1:]]))).alias("was"),
    )
    reset = ops.filter("op = 'reset'").agg(F.max("seq").alias("reset"))  # one row
    rows = folded.crossJoin(F.broadcast(reset)).filter("opened is not null or was is not null")
    since = F.when(F.col("was").isNull(), F.col("opened.seq"))  # NULL: the URL was there before the log
    live = lambda op: F.when(since.isNull() | (F.col(f"{op}.seq") > since), F.col(f"{op}.seq"))
    seeded, crawled, failed = F.col("reserve_seed.seq"), live("crawled"), live("failed")
    after = lambda x, *others: x.isNotNull() & F.forall(F.array(*others), lambda o: o.isNull() | (x > o))
    again = lambda seq: F.coalesce(F.col("reset") > seq, F.lit(False))
    status = (
        F.when(after(failed, seeded, crawled), F.when(again(failed), "retry_pending").otherwise("failed")).when(after(crawled, seeded, failed), "crawled").when(seeded.isNotNull() | F.col("was").isNull(), "queued")
        .when((F.col("was.was_status") == "failed") & F.col("reset").isNotNull(), "retry_pending").otherwise(F.col("was.was_status"))
    )
    origin = lambda c, was: F.when(seeded.isNotNull(), F.col(f"reserve_seed.{c}")).when(F.col("was").isNotNull(), F.col(f"was.was_{was}")).otherwise(F.col(f"opened.{c}"))
    reason = F.when(failed.isNotNull() & after(failed, crawled), F.nullif(F.trim("failed.reason"), F.lit(""))).when(crawled.isNull() & failed.isNull(), F.col("was.was_failure_reason"))
    crawled_at = F.when(after(crawled, seeded), F.col("crawled.at")).when(seeded.isNull() & crawled.isNull(), F.col("was.was_crawled_at"))
    return rows.select("url", origin("domain", "domain").alias("domain"), status.alias("status"), origin("source_url", "source_url").alias("source_url"), origin("at", "first_seen").alias("first_seen"), crawled_at.alias("crawled_at"), reason.alias("failure_reason"))


def reservations(ops: DataFrame) -> DataFrame:
    """(seq, url, granted) of each ``reserve``: granted to a URL that isn't there or waits for another try.

    The numbers of resets, one a crawl cycle, travel as one broadcast row.
    """
    resets = ops.filter("op = 'reset'").agg(F.array_sort(F.collect_list("seq")).alias("resets"))
    before = Window.partitionBy("url").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seq_of = lambda *names: F.when(F.col("op").isin(*names), F.col("seq"))
    rows = ops.filter("url is not null").select(
        "seq", "url", "op", F.min(seq_of(*OPENING)).over(before).alias("opened"), F.max(seq_of("failed")).over(before).alias("failed"), F.max(seq_of("crawled", "reserve_seed")).over(before).alias("other")
    )
    waits = (F.col("failed") > F.col("opened")) & (F.col("other").isNull() | (F.col("failed") > F.col("other"))) & F.exists("resets", lambda r: (r > F.col("failed")) & (r < F.col("seq")))
    return rows.filter("op = 'reserve'").crossJoin(F.broadcast(resets)).select("seq", "url", (F.col("opened").isNull() | F.coalesce(waits, F.lit(False))).alias("granted"))


def is_crawled(urls: DataFrame, states: DataFrame) -> DataFrame:
    """``urls`` with whether each url is known as crawled."""
    done = states.filter("status = 'crawled'").select("url").distinct().withColumn("is_crawled", F.lit(True))
    return urls.join(done, "url", "left").withColumn("is_crawled", F.coalesce("is_crawled", F.lit(False)))


def admitted(requests: DataFrame, states: DataFrame, budget: int = 20) -> DataFrame:
    """The requests (seq, url, seed) that a batch takes up: each URL once, none that is crawled, queued or failed unless it is a seed, up to ``budget`` a site."""
    budget = max(budget, 1)
    once = requests.groupBy("url").agg(F.min("seq").alias("seq"), F.max("seed").alias("seed"))
    taken = states.filter("status <> 'retry_pending'").select("url").distinct().withColumn("taken", F.lit(True))
    free = once.join(taken, "url", "left").filter(F.col("seed") | F.col("taken").isNull()).withColumn("site", site_key(F.col("url")))
    place = F.row_number().over(Window.partitionBy("site").orderBy("seq", "url"))
    return free.withColumn("place", place).filter(F.col("place") <= budget).select("url", "site", "seed", "place")


def failure_ops(failures: DataFrame) -> DataFrame:
    """Log rows of failed requests (seq, url, error, message, at): the reason is the error's name, or robots.txt where that forbade the page."""
    robots = (F.col("error") == "IgnoreRequest") & F.lower(F.coalesce("message", F.lit(""))).contains("robots.txt")
    none = F.lit(None).cast("string")
    return failures.select("seq", F.lit("failed").alias("op"), "url", none.alias("domain"), none.alias("source_url"), F.when(robots, "robots.txt").otherwise(F.col("error")).alias("reason"), "at")


# --- layered crawls: state(seed_url, url, depth, status, source_url, first_seen, crawled_at) -----


def queue_layered(state: DataFrame, found: DataFrame, states: DataFrame, now: str | None = None) -> DataFrame:
    """The layered state with found(seed_url, url, depth, source_url, first_seen) put in.

    New rows are pending, or crawled if the URL is known as such. A row that is there keeps its status and first source and takes
    the least depth; a seed itself at depth 0 starts a fresh traversal.
    """
    at = F.lit(now) if now else F.col("n_seen")
    depth = F.greatest(F.col("depth").cast("int"), F.lit(0))
    new = found.groupBy(F.col("seed_url"), F.col("url")).agg(
        F.min(depth).alias("n_depth"), F.min_by("source_url", F.when(F.col("source_url").isNotNull(), F.struct("first_seen", "source_url"))).alias("n_source"), F.min("first_seen").alias("n_seen"),
        F.max((F.col("seed_url") == F.col("url")) & (depth == 0)).alias("root"),
    )
    both = is_crawled(state.withColumn("is_old", F.lit(True)).join(new, ["seed_url", "url"], "full"), states)
    root, old = F.coalesce("root", F.lit(False)), F.col("is_old").isNotNull()
    status = F.when(root, "pending").when(old, F.col("status")).when(F.col("is_crawled"), "crawled").otherwise("pending")
    return both.select(
        "seed_url", "url", F.least("depth", "n_depth").alias("depth"), status.alias("status"), F.coalesce("source_url", "n_source").alias("source_url"), F.when(old & ~root, F.col("first_seen")).otherwise(F.col("n_seen")).alias("first_seen"),
        F.when(~root & old, F.col("crawled_at")).when(~root & F.col("is_crawled"), at).alias("crawled_at"),
    )


def mark_layered(state: DataFrame, urls: DataFrame, to: str, at: str | None = None) -> DataFrame:
    """The layered state with urls(url[, seed_url]) marked ``queued`` (if pending), ``crawled`` (if pending or queued) or ``failed`` (if queued)."""
    keys = [k for k in ("seed_url", "url") if k in urls.columns]
    hit = urls.select(*keys).distinct().withColumn("hit", F.lit(True))
    moved = F.coalesce("hit", F.lit(False)) & F.col("status").isin(*{"queued": ("pending",), "crawled": OPEN, "failed": ("queued",)}[to])
    marked = state.join(hit, keys, "left").withColumn("crawled_at", F.when(moved & (F.lit(to) == "crawled"), F.lit(at)).otherwise(F.col("crawled_at")))
    return marked.withColumn("status", F.when(moved, to).otherwise(F.col("status"))).select(*state.columns)


def next_layered_batch(state: DataFrame, limit: int = 20) -> DataFrame:
    """(seed_url, url, depth, place): up to ``limit`` pending URLs of each seed's lowest unfinished layer, earliest first."""
    place = F.row_number().over(Window.partitionBy("seed_url").orderBy("first_seen", "url"))
    return lowest_open_layer(state).withColumn("place", place).filter(F.col("place") <= max(limit, 1)).select("seed_url", "url", "depth", "place")


def children(parents: DataFrame, edges: DataFrame) -> DataFrame:
    """What parents(seed_url, url, depth) link to, one layer down, as ``queue_layered`` takes it."""
    out = edges.filter("crawlable and target_url is not null").select(F.col("source_url").alias("url"), "target_url", "first_seen")
    at = parents.select("seed_url", "url", (F.greatest("depth", F.lit(0)) + 1).alias("depth"))
    return at.join(out, "url").select("seed_url", F.col("target_url").alias("url"), "depth", F.col("url").alias("source_url"), "first_seen")


def advance_layered(state: DataFrame, edges: DataFrame, states: DataFrame, now: str | None = None) -> DataFrame:
    """The layered state with the links of every crawled page of each seed's lowest finished layer put in."""
    done = finished_depth(state).withColumnRenamed("depth", "done_depth")
    parents = state.join(done, "seed_url").filter("depth = done_depth and status = 'crawled'")
    return queue_layered(state, children(parents, edges), states, now)


def reconcile_layered(state: DataFrame, active: DataFrame, states: DataFrame, at: str | None = None) -> DataFrame:
    """The layered state with queued URLs that nobody works on crawled, if known as such, or pending again."""
    busy = active.select("seed_url", "url").distinct().withColumn("busy", F.lit(True))
    both = is_crawled(state.join(busy, ["seed_url", "url"], "left"), states)
    lost = (F.col("status") == "queued") & F.col("busy").isNull()
    out = both.withColumn("crawled_at", F.when(lost, F.when(F.col("is_crawled"), F.lit(at))).otherwise(F.col("crawled_at")))
    return out.withColumn("status", F.when(lost, F.when(F.col("is_crawled"), "crawled").otherwise("pending")).otherwise(F.col("status"))).select(*state.columns)


def idle_step(state: DataFrame, edges: DataFrame, states: DataFrame, active: DataFrame, limit: int = 20, at: str | None = None) -> tuple[DataFrame, DataFrame]:
    """What a layered crawl does when nothing is left to do: lost URLs found again, finished layers gone on from, and the next batch of each seed."""
    went_on = advance_layered(reconcile_layered(state, active, states, at), edges, states, at)
    return went_on, next_layered_batch(went_on, limit)


# --- the reduced profile's queue(id, url, domain, depth, status) ---------------------------------


def lite_jobs(queue: DataFrame, limit: int = 6) -> DataFrame:
    """The next jobs of the queue, first come first served; how many is the profile's setting."""
    return queue.filter("status = 'pending'").orderBy("id").limit(limit)


def lite_step(queue: DataFrame, results: DataFrame, links: DataFrame, max_depth: int = 2) -> DataFrame:
    """The queue after a batch: results(url, ok) set done or error, new links(source_url, url, domain) of good pages above ``max_depth`` pending at one level more.

    A URL that is queued already is left as it is; of several pages that link to one, the least depth counts. Ids go on from the highest.
    """
    marked = queue.join(results.groupBy("url").agg(F.max("ok").alias("ok")), "url", "left").withColumn("status", F.when(F.col("ok"), "done").when(~F.col("ok"), "error").otherwise(F.col("status")))
    parents = marked.filter(F.col("ok") & (F.col("depth") < max_depth)).select(F.col("url").alias("source_url"), (F.col("depth") + 1).alias("depth"))
    new = links.join(parents, "source_url").groupBy("url").agg(F.min("depth").alias("depth"), F.min("domain").alias("domain")).join(queue.select("url"), "url", "left_anti")
    top = queue.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    ids = F.col("top") + 1 + F.monotonically_increasing_id()
    fresh = new.crossJoin(F.broadcast(top)).select(ids.alias("id"), "url", "domain", "depth", F.lit("pending").alias("status"))
    return marked.select("id", "url", "domain", "depth", "status").unionByName(fresh)


def left_over(queue: DataFrame) -> DataFrame:
    """How many jobs of the queue are pending, in one row."""
    return queue.agg(F.count_if(F.col("status") == "pending").alias("left"))
