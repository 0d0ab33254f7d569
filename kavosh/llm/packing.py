"""Filling containers of a fixed token capacity with documents.

Cost-balanced packing: a document of t tokens costs t plus t squared over ``QUADRATIC`` (a
linear part and attention's quadratic part). In descending order each document goes to the
sequence of lowest cost that still has room for its tokens; where none has, the one it fits
is opened. The number of sequences starts from the least that could hold all tokens. Balancing
costs alone leaves a few per cent of small containers empty, so sequences that keep more than
``SLACK`` of their room are dissolved at the end and their documents placed by best fit.

Documents are packed in independent lots of some ``LOT_TOKENS`` tokens, by hash of the id, so a
lot is one task's work whatever the number of documents, and what a lot can lose is one partly
filled container among some hundreds.

Results: NULL and empty texts have no tokens and are placed like others, with 0 tokens; a text
longer than the capacity is split into full containers of its own and a rest, and only such a
text is; copies are packed each; ties go to the smaller id.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavosh.sources.tables import keep, spread

QUADRATIC = 4096.0
LOT_TOKENS = 6_000_000
#: Share of a sequence that may stay empty before its documents are placed anew.
SLACK = 0.005
#: Folder and name of the tokenizer's vocabulary, and its way of parting words.
TOKENIZERS = os.environ.get("KAVOSH_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, id_col: str = "doc_id", folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of each document; a narrow pass over whole texts."""
    path = f"{folder}/{vocabulary}"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(path).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["id"], "tokens": [len(encode(t)) if isinstance(t, str) and t else 0 for t in pdf["text"]]})

    return spread(documents.select(F.col(id_col).cast("bigint").alias("id"), "text").filter("id is not null")).mapInPandas(count, "doc_id bigint, tokens bigint")


def pack(ids: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container (from 0) of each item; no size exceeds the capacity."""
    if not len(ids):
        return np.empty(0, np.int64)
    order = np.lexsort((ids, -sizes))
    box = np.full(len(ids), -1, np.int64)
    n = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    left = []
    for i in order:
        s = sizes[i]
        fits = np.flatnonzero(room >= s)
        if not len(fits):
            left.append(i)
            continue
        j = fits[cost[fits].argmin()]
        box[i] = j
        room[j] -= s
        cost[j] += s + s * s / QUADRATIC
    # what found no room goes, with the sequences that have room left, by best fit
    loose = np.concatenate([np.array(left, np.int64), np.flatnonzero((room > SLACK * capacity)[box] & (box >= 0))])
    rooms: list[int] = []
    boxes: list[int] = []
    fresh = n
    for i in loose[np.lexsort((ids[loose], -sizes[loose]))]:
        at = bisect.bisect_left(rooms, sizes[i])
        if at < len(rooms):
            space, j = rooms.pop(at), boxes.pop(at)
        else:
            space, j, fresh = capacity, fresh, fresh + 1
        space -= int(sizes[i])
        at = bisect.bisect_left(rooms, space)
        rooms.insert(at, space)
        boxes.insert(at, j)
        box[i] = j
    return np.unique(box, return_inverse=True)[1]


def containers(counts: DataFrame, budgets: DataFrame, lot_tokens: int = LOT_TOKENS) -> DataFrame:
    """(budget_id, doc_id, piece, tokens, container) for each budget's capacity; container names are unique per budget."""
    total = counts.agg(F.sum("tokens")).collect()[0][0] or 0
    lots = max(1, -(-total // lot_tokens))
    rows = counts.groupBy("doc_id").agg(F.max("tokens").alias("tokens")).withColumn("lot", F.pmod(F.xxhash64("doc_id"), F.lit(lots)))
    each = rows.crossJoin(F.broadcast(budgets.filter("max_tokens > 0").select("budget_id", "max_tokens")))  # a fixed handful of capacities

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        capacity, lot = int(pdf["max_tokens"].iloc[0]), int(pdf["lot"].iloc[0])
        ids, tokens = pdf["doc_id"].to_numpy(np.int64), pdf["tokens"].to_numpy(np.int64)
        full = np.where(tokens > capacity, tokens // capacity, 0)
        rest = tokens - full * capacity
        live = (rest > 0) | (full == 0)
        box = pack(ids[live], rest[live], capacity)
        n_full = int(full.sum())
        whole = np.repeat(np.arange(len(ids)), full)
        piece = np.arange(n_full) - np.repeat(np.cumsum(full) - full, full)
        out = pd.DataFrame({
            "doc_id": np.concatenate([ids[whole], ids[live]]), "piece": np.concatenate([piece, full[live]]).astype(np.int32),
            "tokens": np.concatenate([np.full(n_full, capacity), rest[live]]), "container": np.concatenate([np.arange(n_full), box + n_full]) * lots + lot,
        })
        out.insert(0, "budget_id", pdf["budget_id"].iloc[0])
        return out

    return each.groupBy("budget_id", "lot").applyInPandas(fill, "budget_id int, doc_id bigint, piece int, tokens bigint, container bigint")


def packed(documents: DataFrame, budgets: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return containers(keep(token_counts(documents, id_col), "token-counts"), budgets)
