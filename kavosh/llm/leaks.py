"""Evaluation passages inside training documents.

Filter: the passages' overlapping character q-grams are looked up in a document's letters
(spaces, case, punctuation and misreadable letters folded), and hits are counted in
overlapping bands of diagonals (place in the document minus place in the passage). By the
q-gram lemma a stretch of L letters with at most k edits keeps L - q + 1 - kq q-grams within a
band at least k wide, so a band below that count, taken for the shortest stretch that counts
as a leak, can't hold one. Verification: words of the surviving band are aligned with the
passage's words in a band of word offsets; a document leaks a passage if a run of at least a
third of the passage's words stands in it in order.

The passages are a fixed, small set (their q-grams travel to the workers inside the task);
documents are never compared with each other, each is read once, whole, and nothing is
shuffled. NULL and empty texts give no rows; repeated documents count each; passages of no
words match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavosh.llm.subtitles import codes, spoken
from kavosh.sources.tables import spread

Q = 16
BAND = 32
EDITS = 2
#: Words by which an alignment may drift from its band: words are put in or left out, and short ones move it further.
SLACK = 10
#: Documents whose texts make up one batch string.
BATCH_CHARS = 4_000_000


def grams(y: np.ndarray) -> np.ndarray:
    """32-bit hashes of all q-grams of a letter sequence, by doubling."""
    h = y.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    size = 1
    while size < Q:
        h = h[:-size] * np.uint32(0x9E3779B1 + 2 * size) + (h[size:] ^ (h[size:] >> np.uint32(11)))
        size *= 2
    return h


class Passages:
    """Words and q-grams of the passages."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = np.array(ids, np.int64)
        self.words: list[list[str]] = []
        h, item, at, need, self.span = [], [], [], [], []
        for n, t in enumerate(texts):
            words, letters = word_list(codes(t or ""))
            self.words.append(words)
            self.span.append(len(letters))
            run = self.run(n)
            lengths = np.array([len(w) for w in words])
            shortest = int(np.convolve(lengths, np.ones(run, int), "valid").min()) if run and len(words) >= run else 0
            need.append(max(2, shortest - Q + 1 - EDITS * Q))
            if len(letters) >= Q:
                g = grams(letters)
                h.append(g)
                item.append(np.full(len(g), n))
                at.append(np.arange(len(g)))
        self.need = np.array(need or [0])
        h_all = np.concatenate(h) if h else np.empty(0, np.uint32)
        order = np.argsort(h_all, kind="stable")
        self.h = h_all[order]
        self.item = (np.concatenate(item) if item else np.empty(0, np.int64))[order]
        self.at = (np.concatenate(at) if at else np.empty(0, np.int64))[order]
        self.known = np.zeros(1 << 22, bool)
        self.known[self.h >> np.uint32(10)] = True

    def run(self, n: int) -> int:
        """Words in a row that make a leak of passage ``n``."""
        return math.ceil(len(self.words[n]) / 3)


def word_list(x: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The coded words of a coded text, and its letters without what parts them."""
    text = x.astype(np.uint16)
    cut = np.where(text > 3, text, 32).astype(np.uint16).tobytes().decode("utf-16-le", "replace")
    return cut.split(), text[text > 3]


def near(a: str, b: str) -> bool:
    """Whether two words differ by a misreading at most: one edit, two in long words."""
    if a == b:
        return True
    m, n = len(a), len(b)
    if m < 3 or n < 3 or abs(m - n) > 2:
        return False
    bound = 1 if max(m, n) < 8 else 2
    i = 0
    while i < min(m, n) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(m, n) - i and a[m - 1 - j] == b[n - 1 - j]:
        j += 1
    return max(m, n) - i - j <= bound


def plausible(doc: list[str], passage: list[str], offset: int, run: int, slack: int = SLACK) -> bool:
    """Whether enough of the passage's words stand near their places for a run of ``run`` words.

    Misread words are rarer than two in five, so three fifths must stand there as written.
    """
    where: dict[str, list[int]] = {}
    for j, w in enumerate(doc):
        where.setdefault(w, []).append(j)
    hits = [any(-slack <= j - i - offset <= slack for j in where.get(w, ())) for i, w in enumerate(passage)]
    if sum(hits) < 0.6 * run:
        return False
    total = np.concatenate([[0], np.cumsum(hits)])
    span = min(run + 2, len(hits))
    return bool((total[span:] - total[:-span]).max() >= 0.6 * run)


def longest_run(doc: list[str], passage: list[str], offset: int, slack: int = SLACK) -> int:
    """Words of the longest run of the passage in ``doc``, aligned within ``slack`` of ``offset``.

    A run may step over one odd word on either side (a mark that wasn't recognised) but such
    words don't count.
    """
    best, rows = 0, {}
    for i, w in enumerate(passage):
        row = {}
        lo, hi = max(0, i + offset - slack), min(len(doc), i + offset + slack + 1)
        for j in range(lo, hi):
            if near(w, doc[j]):
                before = 0
                for k in (1, 2):
                    prev = rows.get(i - k)
                    if prev:
                        before = max(before, prev.get(j - 1, 0), prev.get(j - 2, 0))
                row[j] = before + 1
                if row[j] > best:
                    best = row[j]
        rows[i] = row
    return best


def leaks_in(texts: list[str | None], passages: Passages) -> list[tuple[int, int, int]]:
    """(document's place, passage's place, words of the run) over a batch of texts."""
    x = codes(spoken(texts))
    y = x[(x > 3) | (x == 2)]
    if len(y) < Q or not len(passages.h):
        return []
    g = grams(y)
    maybe = np.flatnonzero(passages.known[g >> np.uint32(10)])
    left, right = np.searchsorted(passages.h, g[maybe], "left"), np.searchsorted(passages.h, g[maybe], "right")
    n = right - left
    maybe, left, n = maybe[n > 0], left[n > 0], n[n > 0]
    if not len(maybe):
        return []
    place = np.repeat(maybe, n)
    entry = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    item, diagonal = passages.item[entry], place - passages.at[entry] + BAND * 1024
    ends = np.flatnonzero(y == 2)
    inside = np.searchsorted(ends, place)  # hits of different documents never share a band
    width = (len(y) + BAND * 2048) // BAND + 2
    found: set[tuple[int, int, int]] = set()
    for shift in (0, BAND // 2):
        key = (item.astype(np.int64) * (len(ends) + 1) + inside) * width + (diagonal + shift) // BAND
        band, count = np.unique(key, return_counts=True)
        which = band // width // (len(ends) + 1)
        for at in np.flatnonzero(count >= passages.need[which]):
            found.add((int(which[at]), int(band[at] % width) * BAND - shift - BAND * 1024, int(band[at] // width % (len(ends) + 1))))
    if not found:
        return []
    xends = np.flatnonzero(x == 2)
    out: dict[tuple[int, int], int] = {}
    cache: dict[int, tuple[list[str], np.ndarray, int]] = {}
    for which, low, doc in found:
        if doc not in cache:
            a, b = (int(xends[doc - 1]) + 1 if doc else 0), (int(xends[doc]) if doc < len(xends) else len(x))
            words, _ = word_list(x[a:b])
            cache[doc] = (words, np.cumsum([0] + [len(w) for w in words]), int(ends[doc - 1]) + 1 if doc else 0)
        words, starts, origin = cache[doc]
        letter = low + BAND // 2 - origin  # where the passage would begin
        a = int(np.searchsorted(starts, max(letter - 8, 0), "right")) - 1
        b = int(np.searchsorted(starts, max(letter, 0) + passages.span[which] + 2 * BAND))
        segment = words[max(a - 8, 0) : b + 8]
        if letter >= 0:
            offset = int(np.searchsorted(starts, letter)) - max(a - 8, 0)
        else:  # the passage's beginning is cut off
            skipped = np.cumsum([0] + [len(w) for w in passages.words[which]])
            offset = -int(np.searchsorted(skipped, -letter))
        least = passages.run(which)
        if not plausible(segment, passages.words[which], offset, least):
            continue
        run = longest_run(segment, passages.words[which], offset)
        if run >= least:
            out[doc, which] = max(out.get((doc, which), 0), run)
    return [(d, w, r) for (d, w), r in out.items()]


def batches_of(pdf: pd.DataFrame, column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pd.DataFrame]:
    """Slices of a batch of some million characters each."""
    sizes = pdf[column].map(lambda t: len(t) if isinstance(t, str) else 0).cumsum().to_numpy()
    start = 0
    while start < len(pdf):
        base = sizes[start - 1] if start else 0
        end = max(int(np.searchsorted(sizes, base + chars, "right")), start + 1)
        yield pdf.iloc[start:end]
        start = end


def leaked(documents: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_words): each document that holds a passage and the words of its longest run."""
    rows = items.select("item_id", "text").collect()  # a fixed set of test passages
    passages = Passages([r[0] for r in rows], [r[1] for r in rows])

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in batches_of(whole):
                keys = pdf["id"].to_numpy()
                found = leaks_in([t if isinstance(t, str) else None for t in pdf["text"]], passages)
                yield pd.DataFrame([(keys[d], passages.ids[w], r) for d, w, r in found], columns=["doc_id", "item_id", "n_words"])

    narrow = documents.select(F.col(id_col).cast("bigint").alias("id"), "text").filter("text is not null")
    return spread(narrow).mapInPandas(look, "doc_id bigint, item_id bigint, n_words int")
