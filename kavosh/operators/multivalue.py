"""Several values packed in one field: a quote-aware finite-state tokenizer.

``split_values`` turns packed fields into one row per value, with the value's place.
The automaton walks a field once and knows three things: the open quote (a value may be quoted as a whole, or
hold a quoted part after white space), whether the last character was an escape, and the brackets that are open. A
delimiter ends a value only outside quotes and brackets and unescaped; which delimiters count depends on
the field (``KINDS``), as a slash parts phone numbers but not profile URLs, which may hold any of these.

Results in the odd cases: NULL, empty and blank fields, ``[]`` and ``{}`` give no row; empty
pieces are dropped and not counted; a value written twice gives two rows; a quote or bracket that never
closes is an ordinary character; broken JSON is tokenised by the same automaton without
decoding; very long fields are read whole, in linear time. Extra columns of the input are
ignored unless named in ``id_col`` or ``fields``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kavosh.sources.tables import spread


@dataclass(frozen=True)
class Kind:
    """How values of a field may be parted: a regex of delimiters, whether pieces are URLs, and whether white space parts addresses."""

    delimiter: str
    urls: bool = False
    spaces: bool = False


_ANY = r"[,;|\n\r\t،؛•]"
_WORDS = r"(?<=\s)(?:&|\+|و|یا|or|and)(?=\s)"

KINDS: dict[str, Kind] = {
    "phones": Kind(rf"{_ANY}|/|(?<=\s)-(?=\s)|{_WORDS}"),
    "emails": Kind(rf"{_ANY}|/|(?<=\s)-(?=\s)|{_WORDS}", spaces=True),
    "technologies": Kind(rf"{_ANY}|(?<=\s)[-/](?=\s)|{_WORDS}"),
    "socials": Kind(
        rf"(?<![:=\s,;|،؛•])(?:{_ANY}|\s|&&)+(?=\s*[\"']?(?:[\w.+-]+\s*[:=]\s*)?[\"']?(?:https?:)?//|\s*$)|(?<=\s)(?:&|\+|/|-|و|یا|or|and)\s+(?=[\"']?(?:[\w.+-]+\s*[:=]\s*)?(?:https?:)?//)",
        urls=True,
    ),
}

_CLOSES = {"{": "}", "[": "]"}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_NETWORK = re.compile(r"^(?!https?:)[\"']?[\w.+ -]+[\"']?\s*[:=]\s*(?=[\"']?(?:https?:)?//)")
#: Where a value may end or a guarded part begin: a delimiter character, a bracket, an escape, a quote, or the start of a parting word.
_STOP = re.compile(r"[,;|\n\r\t،؛•/<(\[{\\\"&]|\s|(?<=\s)\S")
_PAIRS = {"(": ")", "[": "]", "{": "}", "<": ">"}
_BRACKET = re.compile(r"[()\[\]{}<>]")
_ESCAPED = re.compile(r"\\([,;|،؛•/])")
_COMPILED = {name: re.compile(kind.delimiter) for name, kind in KINDS.items()}


def _decode(text: str, at: int, quote: str) -> tuple[str, int] | None:
    """The quoted string that opens at ``at``: its decoded text and the place after it; None if it never closes."""
    end = text.find(quote, at + 1)
    if end < 0:
        return None
    if text[end + 1 : end + 2] != quote and "\\" not in text[at + 1 : end]:
        return text[at + 1 : end], end + 1
    out, i, n = [], at + 1, len(text)
    while i < n:
        c = text[i]
        if c == "\\" and i + 1 < n:
            e = text[i + 1]
            if e == "u" and re.fullmatch(r"[0-9a-fA-F]{4}", text[i + 2 : i + 6]):
                out.append(chr(int(text[i + 2 : i + 6], 16)))
                i += 6
                continue
            out.append(_ESCAPES.get(e, e))
            i += 2
        elif c == quote:
            if text[i + 1 : i + 2] == quote and quote == '"':
                out.append(quote)
                i += 2
                continue
            s = "".join(out)
            if any("\ud800" <= c <= "\udfff" for c in s):  # two escapes for one character
                s = s.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            return s, i + 1
        else:
            out.append(c)
            i += 1
    return None


def _bracketed(text: str) -> list[str] | None:
    """Values of a JSON-like list or map (keys left out), or None if it isn't well formed."""
    out: list[str] = []
    stack: list[str] = []
    i, n, pending = 0, len(text), ""
    while i < n:
        c = text[i]
        if c in "{[":
            stack.append(_CLOSES[c])
            i += 1
        elif c in "}]":
            if pending.strip():
                out.append(pending.strip())
            pending = ""
            if not stack or stack.pop() != c:
                return None
            i += 1
            if not stack:
                return out if not text[i:].strip() else None
        elif c in "\"'" and not pending.strip():
            got = _decode(text, i, c)
            if got is None:
                return None
            value, i = got
            m = re.compile(r"\s*:").match(text, i)
            if m and stack and stack[-1] == "}":
                i = m.end()
            else:
                out.append(value.strip())
            pending = ""
        elif c == ",":
            if pending.strip():
                out.append(pending.strip())
            pending = ""
            i += 1
        else:
            pending += c
            i += 1
    return None


def _matching(text: str) -> dict[int, int]:
    """Where each bracket that closes is closed: one pass, brackets that fit no other are left out."""
    stack: list[int] = []
    out: dict[int, int] = {}
    for m in _BRACKET.finditer(text):
        c = m.group()
        if c in _PAIRS:
            stack.append(m.start())
        else:
            while stack and _PAIRS[text[stack[-1]]] != c:
                if c not in (_PAIRS[text[i]] for i in stack[-3:]):  # closes nothing near: an ordinary character
                    break
                stack.pop()
            else:
                if stack:
                    out[stack.pop()] = m.start()
    return out


class _Ahead:
    """The next place of a character at or after a place that only moves on."""

    def __init__(self, text: str, what: str):
        self.text, self.what, self.at = text, what, -1

    def __call__(self, i: int) -> int:
        if self.at < i:
            found = self.text.find(self.what, i)
            self.at = found if found >= 0 else len(self.text)
        return self.at


def _unquote(piece: str) -> str:
    """Without white space and without quotes around the whole value."""
    piece = piece.strip()
    if len(piece) > 1 and piece[0] in "\"'" and piece[-1] == piece[0]:
        got = _decode(piece, 0, piece[0])
        if got is not None and got[1] == len(piece):
            return got[0].strip()
    return _ESCAPED.sub(r"\1", piece) if "\\" in piece else piece


def _walk(text: str, kind: Kind, delimiter: re.Pattern) -> Iterator[str]:
    """The pieces between delimiters that stand outside quotes and brackets."""
    closed = {} if kind.urls else _matching(text)
    at, opens, closes = (_Ahead(text, c) for c in "@<>")
    start, i, n, fresh = 0, 0, len(text), True
    while i < n:
        if not fresh:
            stop = _STOP.search(text, i)
            if stop is None:
                break
            i = stop.start()
        c = text[i]
        if c in "\"'" and (fresh or (c == '"' and not kind.urls and text[i - 1].isspace())):
            quoted = _decode(text, i, c)
            if quoted is not None and (fresh or quoted[1] >= n or not text[quoted[1]].isalnum()):
                i, fresh = quoted[1], False
                continue
        if i in closed:
            i, fresh = closed[i] + 1, False
            continue
        if c == "\\" and not kind.urls and _ESCAPED.match(text, i):
            i, fresh = i + 2, False
            continue
        m = delimiter.match(text, i)
        end = m.end() if m else i
        # white space parts addresses, but not the name before one in angle brackets
        if end == i and kind.spaces and c.isspace() and (at(i) < min(opens(i), closes(i)) or min(opens(i), closes(i)) >= n):
            end = i + 1
        if end > i:
            yield text[start:i]
            i = start = end
            fresh = True
            continue
        if not c.isspace():
            fresh = False
        i += 1
    yield text[start:]


def tokenize(text: str | None, field: str) -> list[str]:
    """The values of one packed field in written order."""
    if text is None:
        return []
    kind, delimiter = KINDS[field], _COMPILED[field]
    text = text.strip()
    if not text:
        return []
    pieces: list[str] | None = None
    if text[0] in "{[":
        pieces = _bracketed(text)
    if pieces is None:
        pieces = [_unquote(p) for p in _walk(text, kind, delimiter)]
    if kind.urls:
        pieces = [_unquote(_NETWORK.sub("", p)) for p in pieces]
    return [p for p in pieces if p]


def split_values(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """One row per value: (id, field, pos, piece, n), n the number of values of that field.

    No shuffle: a narrow Arrow-batched map over four columns. A field longer than a batch is
    still one string of one task; nothing is collected.
    """
    fields = tuple(f for f in fields if f in df.columns)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for field in fields:
                for key, text in zip(pdf["_k"].tolist(), pdf[field].tolist()):
                    if not isinstance(text, str):
                        continue
                    values = tokenize(text, field)
                    out.extend((key, field, at, v, len(values)) for at, v in enumerate(values, 1))
            yield pd.DataFrame(out, columns=["id", "field", "pos", "piece", "n"])

    narrow = df.select(F.col(id_col).cast("bigint").alias("_k"), *[F.col(f).cast("string").alias(f) for f in fields])
    return spread(narrow).mapInPandas(walk, "id bigint, field string, pos int, piece string, n int")


def packed_values(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """The values of those fields alone that hold at least two: (id, field, pos, piece)."""
    return split_values(df, id_col, fields).filter("n >= 2").select("id", "field", "pos", "piece")
