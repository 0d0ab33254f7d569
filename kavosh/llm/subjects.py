"""Subjects of documents, by propagating labels over a document-similarity graph.

Documents are similar if they share words that bear on a subject. The graph is kept in
factored form, document - word - document, since the edges between documents alone would be
quadratic: a document's neighbours are all documents that share such a word with it, an edge
being verified by the word itself. One round is two joins: scores of words are gathered from
the documents that hold them, scores of documents from the words they hold. Labelled documents
are seeds; they are clamped to their labels as long as their own words bear the labels out
(some labels are wrong), and documents keep several subjects.

After the last round a document has those subjects that reached it with at least a tenth of its score (words count once there, however
often they are said), and that are borne out by its cues: each cue is given to the subject its words speak for most, or to none, and a subject needs a fifth of the
cues given to any. Both are joined by document and subject; a subject that only the cues or only the graph name isn't one.

What is small here and why: the words considered occur in at least ``MIN_SHARE`` of the
documents, so there are at most (distinct words per document) / MIN_SHARE of them whatever the
number of documents; only that table is broadcast. Documents' scores are never gathered.

Results: documents without text or without a word bearing on a subject have no row; labels of
unknown documents and NULL labels are ignored; repeated documents count once per id; without
any labels the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavosh.llm.leaks import batches_of
from kavosh.llm.subtitles import codes, spoken, words
from kavosh.sources.tables import keep, spread

#: Words in fewer or more documents than this say too little; a subject may well take up a third of a corpus.
MIN_SHARE, MAX_SHARE = 0.0005, 0.5
ROUNDS = 2
#: Share of a document's subject-bearing cues that makes a subject its own.
LEAST = 0.2
#: Share of a document's propagated score without which a subject hasn't reached it.
REACHED = 0.1


def cue_words(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, words): the words of each document's cues as numbers, a 0 after each cue."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for pdf in batches_of(whole):
                h, doc, cue = words(codes(spoken(pdf["text"].tolist())))
                if not len(h):
                    continue
                last = np.flatnonzero(np.diff(cue)) + 1
                h, doc = np.insert(h, last, 0), np.insert(doc, last, doc[last - 1])
                cuts = np.searchsorted(doc, np.arange(len(pdf) + 1))
                rows = [h[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
                yield pd.DataFrame({"doc_id": pdf["id"].to_numpy(), "words": rows})

    narrow = documents.select(F.col(id_col).cast("bigint").alias("id"), "text").filter("text is not null and id is not null")
    return spread(narrow).mapInPandas(walk, "doc_id bigint, words array<int>")


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch and the place of their documents in it."""
    rows = pdf["words"].to_numpy()
    sizes = np.array([len(r) for r in rows], np.int64)
    return (np.concatenate(rows) if len(rows) else np.empty(0, np.int32)).astype(np.int32), np.repeat(np.arange(len(rows)), sizes)


def document_frequencies(lines: DataFrame) -> DataFrame:
    """(word, n): in how many documents each word occurs; split by split, then summed."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: pd.Series | None = None
        for pdf in batches:
            h, doc = _flat(pdf)
            pairs = np.unique((doc.astype(np.int64) << 32) | (h.astype(np.int64) & 0xFFFFFFFF))
            w, n = np.unique(pairs & 0xFFFFFFFF, return_counts=True)
            part = pd.Series(n, index=w)
            total = part if total is None else total.add(part, fill_value=0)
            if len(total) > 2_000_000:  # rather a second row for a word than a large table
                yield pd.DataFrame({"word": total.index.to_numpy().astype(np.uint32).view(np.int32), "n": total.to_numpy(np.int64)})
                total = None
        if total is not None and len(total):
            yield pd.DataFrame({"word": total.index.to_numpy().astype(np.uint32).view(np.int32), "n": total.to_numpy(np.int64)})

    return lines.mapInPandas(count, "word int, n bigint").filter("word <> 0").groupBy("word").agg(F.sum("n").alias("n"))


def terms_of(lines: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, terms): the distinct words of each document that are in a sorted vocabulary."""

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, doc = _flat(pdf)
            at = np.searchsorted(vocabulary, h)
            live = (at < len(vocabulary)) & (vocabulary[np.minimum(at, len(vocabulary) - 1)] == h) if len(vocabulary) else np.zeros(len(h), bool)
            pairs = np.unique((doc[live].astype(np.int64) << 32) | at[live])
            d, t = pairs >> 32, vocabulary[pairs & 0xFFFFFFFF] if len(vocabulary) else pairs
            cuts = np.searchsorted(d, np.arange(len(pdf) + 1))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "terms": [t[a:b] for a, b in zip(cuts[:-1], cuts[1:])]})

    return lines.mapInPandas(pick, "doc_id bigint, terms array<int>")


def _word_scores(edges: DataFrame, scores: DataFrame) -> DataFrame:
    """(term, subject, p, strength) from documents' (doc_id, subject, weight).

    p is the word's subject distribution corrected for how common the subjects are; strength is
    how far it is from saying nothing, shrunk where few documents speak.
    """
    size = scores.groupBy("subject").agg(F.sum("weight").alias("size"))
    n = edges.join(scores, "doc_id").select(F.explode("terms").alias("term"), "subject", "weight").groupBy("term", "subject").agg(F.sum("weight").alias("n"))
    rate = n.join(F.broadcast(size), "subject").withColumn("rate", (F.col("n") + 0.02) / (F.col("size") + 1.0))  # one row per subject
    total = rate.groupBy("term").agg(F.sum("rate").alias("all"), F.sum("n").alias("seen"))
    p = rate.join(total, "term").select("term", "subject", "seen", (F.col("rate") / F.col("all")).alias("p"))
    return p.filter("p >= 0.3 and seen >= 2").select("term", "subject", "p", (F.col("p") * F.col("p") * F.col("seen") / (F.col("seen") + 2.0)).alias("strength"))


def subjects(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, subject, share) of each subject that reached a document and has at least ``LEAST`` of its subject-bearing cues."""
    lines = keep(cue_words(documents, id_col), "cue-words")
    n_docs = lines.count()
    common = document_frequencies(lines).filter((F.col("n") >= max(2, MIN_SHARE * n_docs)) & (F.col("n") <= max(3, MAX_SHARE * n_docs)))
    vocabulary = np.sort(np.array([r[0] for r in common.select("word").collect()], np.int32))  # bounded by MIN_SHARE
    edges = keep(terms_of(lines, vocabulary), "terms")
    seeds = labels.filter("doc_id is not null and subject is not null").select("doc_id", "subject").distinct()
    seeds = keep(seeds.withColumn("weight", F.lit(1.0)), "seeds")
    scores, reached, strong = seeds, seeds, None
    for turn in range(rounds + 1):
        strong = keep(_word_scores(edges, scores), f"word-scores-{turn}")
        if turn == rounds:
            break
        votes = edges.select("doc_id", F.explode("terms").alias("term")).join(F.broadcast(strong), "term")  # bounded by the vocabulary
        sums = votes.groupBy("doc_id", "subject").agg(F.sum("strength").alias("s"))
        best = sums.groupBy("doc_id").agg(F.sum("s").alias("all"), F.collect_list(F.struct("subject", "s")).alias("by"))  # at most one entry per subject
        share = best.select("doc_id", F.explode("by").alias("x"), "all").select("doc_id", "x.subject", (F.col("x.s") / F.col("all")).alias("weight"))
        marked = share.join(seeds.select("doc_id", "subject", F.lit(1.0).alias("seed")), ["doc_id", "subject"], "left")
        # a seed stays clamped while its document's words give its subject a tenth at least
        reached = keep(marked.select("doc_id", "subject", F.when(F.col("seed").isNotNull() & (F.col("weight") >= 0.1), 1.0).otherwise(F.col("weight")).alias("weight")), f"scores-{turn}")
        scores = reached.filter(F.col("weight") >= LEAST)
    table = strong.collect()  # at most (words considered) x 3 rows
    names = sorted({r["subject"] for r in table})
    code = {s: i for i, s in enumerate(names)}
    term = np.array(sorted({r["term"] for r in table}), np.int32)
    weight = np.zeros((len(term) + 1, max(len(names), 1)), np.float32)
    for r in table:
        if r["p"] >= 0.5:
            weight[np.searchsorted(term, np.int32(r["term"])), code[r["subject"]]] = r["strength"]

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            h, doc = _flat(pdf)
            cue = np.concatenate([[0], np.cumsum(h == 0)[:-1]]) + doc if len(h) else doc
            at = np.searchsorted(term, h)
            live = np.flatnonzero((at < len(term)) & (term[np.minimum(at, len(term) - 1)] == h)) if len(term) else np.empty(0, np.int64)
            live = live[weight[at[live]].any(axis=1)]
            if not len(live):
                continue
            first = np.flatnonzero(np.r_[True, np.diff(cue[live]) > 0])
            votes = np.add.reduceat(weight[at[live]], first, axis=0)
            pairs = doc[live][first] * len(names) + votes.argmax(axis=1)
            counts = np.bincount(pairs, minlength=len(pdf) * len(names)).reshape(len(pdf), len(names))
            share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            d, s = np.nonzero(share >= LEAST)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[d], "subject": [names[i] for i in s], "share": share[d, s]})

    cues = lines.mapInPandas(judge, "doc_id bigint, subject string, share double")
    return cues.join(reached.filter(F.col("weight") >= REACHED).select("doc_id", "subject").distinct(), ["doc_id", "subject"], "left_semi")
