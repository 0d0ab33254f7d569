"""Per-key results where a few keys hold most rows.

Every input split (equal in bytes, whatever keys it holds) is reduced on its own to dense
arrays: its keys are dictionary-encoded to 0..n-1, counts come from ``numpy.bincount``,
minima and maxima from a scatter-reduce over those codes, and the earliest distinct partners
from one sort. A split leaves one entry per key it saw, at most ``k`` partners wide, so a key
with a third of all rows leaves as many entries as there are splits, not as it has rows. The
entries travel as array blocks (a key's block is its hash modulo the number of blocks, which grows with the
input), and each block is summed by one task.

Why ``k`` partners per split suffice for the k-th partner overall: one of the k earliest
partners of a key, first seen in split s, has fewer than k partners before it in s.

Defined results: rows whose key is NULL don't count for that key; a NULL partner is no
partner; NULL or unreadable times come after all others, then the smaller id; equal rows count
as rows but are one partner; an empty table gives no rows. Only the named columns are read, so
extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavosh.sources.tables import fanout, scan_bytes

_LATE = np.iinfo(np.int64).max
#: Input for which there is one block of keys; a block is summed in one call.
BLOCK_BYTES = 64 << 20
_BLOCK = "block int, field string, keys array<string>, n array<bigint>, flagged array<bigint>, first array<bigint>, last array<bigint>, pkey array<int>, partner array<string>, at array<bigint>, row array<bigint>"


def _earliest(key: np.ndarray, partner: np.ndarray, at: np.ndarray, row: np.ndarray, k: int) -> np.ndarray:
    """Places of the first rows of the ``k`` earliest distinct partners of each key."""
    order = np.lexsort((row, at))
    both = key[order].astype(np.int64) * (int(partner.max(initial=0)) + 1) + partner[order]
    _, first = np.unique(both, return_index=True)
    first.sort()
    kept = order[first]
    by_key = np.argsort(key[kept], kind="stable")
    kept, keys = kept[by_key], key[kept][by_key]
    starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1] if len(keys) else np.empty(0, np.int64)
    rank = np.arange(len(keys)) - np.repeat(starts, np.diff(np.r_[starts, len(keys)])) if len(keys) else keys
    return kept[rank < k]


class _Accumulator:
    """Dense arrays over the keys of one field.

    Sets of arrays are put aside and merged when they outgrow what is merged already, so each entry is merged a number of times
    that grows with the logarithm of the whole.
    """

    #: Keys put aside before a merge is worth it.
    LEAST = 20_000

    def __init__(self, k: int):
        self.k, self.keys, self.rows = k, np.empty(0, object), None
        self.sums: dict[str, np.ndarray] = {}
        self._aside: list[tuple] = []
        self._n = 0

    def add(self, *arrays: np.ndarray) -> None:
        """Put in keys, n, flagged, first, last (one per key) and pkey (places in keys), partner, at, row (one per partner)."""
        self._aside.append(arrays)
        self._n += len(arrays[0])
        if self._n > max(len(self.keys), self.LEAST):
            self.merge()

    def merge(self) -> None:
        """Everything put aside joins: one dictionary for all, counts by bincount, minima and maxima by scatter."""
        if not self._aside:
            return
        own = [(self.keys, *(self.sums[c] for c in ("n", "flagged", "first", "last")), *self.rows)] if len(self.keys) else []
        sets = own + self._aside
        self._aside, self._n = [], 0
        keys, n, flagged, first, last = (np.concatenate([s[i] for s in sets]) for i in range(5))
        code, uniques = pd.factorize(keys, use_na_sentinel=False)
        m = len(uniques)
        for name, x in (("n", n), ("flagged", flagged)):
            self.sums[name] = np.bincount(code, weights=x, minlength=m).astype(np.int64)
        for name, x, reduce, fill in (("first", first, np.minimum, _LATE), ("last", last, np.maximum, -1)):
            out = np.full(m, fill, np.int64)
            reduce.at(out, code, x)
            self.sums[name] = out
        begins = np.cumsum([0, *(len(s[0]) for s in sets)])[:-1]
        pkey = code[np.concatenate([s[5] + a for s, a in zip(sets, begins)]).astype(np.int64)]
        partner, at, row = (np.concatenate([s[i] for s in sets]) for i in (6, 7, 8))
        pcode = pd.factorize(partner)[0] if len(partner) else np.empty(0, np.int64)
        kept = _earliest(pkey, pcode, at, row, self.k)
        self.keys, self.rows = np.asarray(uniques, dtype=object), (pkey[kept], partner[kept], at[kept], row[kept])

    def blocks(self, field: str, blocks: int) -> Iterator[dict]:
        self.merge()
        if not len(self.keys):
            return
        h = (pd.util.hash_array(self.keys, categorize=False) % blocks).astype(np.int64)
        pblock = h[self.rows[0]]
        order, porder = np.argsort(h, kind="stable"), np.argsort(pblock, kind="stable")
        seen = np.unique(h)
        cut, pcut = np.searchsorted(h[order], [seen, seen + 1]), np.searchsorted(pblock[porder], [seen, seen + 1])
        local = np.empty(len(h), np.int64)
        for j, b in enumerate(seen):
            own, rows = order[cut[0][j] : cut[1][j]], porder[pcut[0][j] : pcut[1][j]]
            local[own] = np.arange(len(own))
            yield {
                "block": int(b), "field": field, "keys": self.keys[own], **{c: self.sums[c][own] for c in ("n", "flagged", "first", "last")},
                "pkey": local[self.rows[0][rows]].astype(np.int32), "partner": self.rows[1][rows], "at": self.rows[2][rows], "row": self.rows[3][rows],
            }


def key_profile(
    df: DataFrame, fields: dict[str, str], id_col: str = "id", time_col: str = "first_seen", flag_col: str | None = "external", k: int = 3
) -> DataFrame:
    """One row per value of each field: (field, key_value, n_rows, n_flagged, first_us, last_us, kth_id, kth_us).

    ``fields`` maps a key column to the column of its partners. ``kth_id`` is the row in which
    the k-th distinct partner first appears, NULL with fewer partners. Times are microseconds.
    """
    if not fields:
        raise ValueError("key_profile needs at least one field")
    blocks = max(fanout(df.sparkSession), 8, scan_bytes(df) // BLOCK_BYTES)
    columns = sorted({*fields, *fields.values()})
    flag = F.coalesce(F.col(flag_col).cast("int"), F.lit(0)) if flag_col else F.lit(0)
    narrow = df.select(
        *[F.col(c).cast("string").alias(f"c_{c}") for c in columns],
        F.col(id_col).cast("bigint").alias("_id"),
        F.coalesce(F.unix_micros(F.col(time_col).try_cast("timestamp")), F.lit(_LATE)).alias("_at"),
        flag.alias("_flag"),
    )

    def reduce_split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = {f: _Accumulator(k) for f in fields}
        for pdf in batches:
            at, row, flagged = (pdf[c].to_numpy() for c in ("_at", "_id", "_flag"))
            for field, other in fields.items():
                keys, partner = pdf[f"c_{field}"].to_numpy(object), pdf[f"c_{other}"].to_numpy(object)
                live = ~pd.isna(keys)
                code, uniques = pd.factorize(keys[live])
                m = len(uniques)
                if not m:
                    continue
                first, last = np.full(m, _LATE, np.int64), np.full(m, -1, np.int64)
                np.minimum.at(first, code, at[live])
                np.maximum.at(last, code, np.where(at[live] == _LATE, -1, at[live]))
                paired = ~pd.isna(partner[live])
                pcode, _ = pd.factorize(partner[live][paired])
                kept = _earliest(code[paired], pcode, at[live][paired], row[live][paired], k)
                sums[field].add(
                    np.asarray(uniques, dtype=object), np.bincount(code, minlength=m), np.bincount(code, weights=flagged[live], minlength=m), first, last,
                    code[paired][kept], partner[live][paired][kept], at[live][paired][kept], row[live][paired][kept],
                )
        out = [b for f in fields for b in sums[f].blocks(f, blocks)]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _BLOCK.split(", ")])

    def sum_block(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _Accumulator(k)
        for r in pdf.itertuples(index=False):
            total.add(
                np.asarray(r.keys, dtype=object), *(np.asarray(x, np.int64) for x in (r.n, r.flagged, r.first, r.last)),
                np.asarray(r.pkey, np.int64), np.asarray(r.partner, dtype=object), np.asarray(r.at, np.int64), np.asarray(r.row, np.int64),
            )
        total.merge()
        out = pd.DataFrame({"key_value": total.keys, "n_rows": total.sums["n"], "n_flagged": total.sums["flagged"], "first_us": total.sums["first"], "last_us": total.sums["last"]})
        kept = pd.DataFrame({"key": total.rows[0], "kth_us": total.rows[2], "kth_id": total.rows[3]})
        kept = kept[kept.groupby("key").cumcount() == k - 1].set_index("key")
        out = out.join(kept)
        out.insert(0, "field", pdf["field"].iloc[0])
        for c in ("first_us", "last_us", "kth_us"):
            out[c] = out[c].astype("Int64").mask((out[c] == _LATE) | (out[c] == -1))
        out["kth_id"] = out["kth_id"].astype("Int64")
        return out

    result = "field string, key_value string, n_rows bigint, n_flagged bigint, first_us bigint, last_us bigint, kth_us bigint, kth_id bigint"
    return narrow.mapInPandas(reduce_split, _BLOCK).groupBy("block", "field").applyInPandas(sum_block, result)


def third_partners(links: DataFrame) -> DataFrame:
    """(field, key_value, id) of each target_domain and source_url with at least three partners."""
    fields = {"target_domain": "source_url", "source_url": "target_url"}
    return key_profile(links, fields).filter("kth_id is not null").select("field", "key_value", F.col("kth_id").alias("id"))
