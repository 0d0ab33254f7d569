"""Spoken lines of subtitle files, a batch at a time.

``spoken`` strips whole texts of everything that isn't spoken: cue numbers and times (also
broken ones), file headers, markup, speaker marks, sound descriptions, music signs, adverts
and credits. Wrong encodings are undone, line ends unified. The result of a batch is one
string, documents parted by ``DOC`` and cues by ``CUE``, so that the regexes and the numpy code
after it run over millions of characters at a time instead of once per document.
"""

from __future__ import annotations

import re

import numpy as np

from kavosh.llm.garble import _TABLES, _utf8_step, repaired

DOC, CUE = "\x1e", "\x1d"

_GARBLED = re.compile("[ÂÃâØÙÚÛ][\x80-\xbfŒœŠšŽžŸƒˆ˜‘’‚“”„†‡•…‰‹›€™]|[طظ][^\\s\x00-\x7f][طظ]")
_TO_BYTES = {ord(c): b for c, b in _TABLES["cp1252"].items()}
#: A time line with the cue number before it. Arrows and times may be broken. Each pattern
#: begins with a literal or one set of characters, which the regex engine can skip along to.
_TIME = re.compile(r"\n(?:[ \t]*\d{1,6}[ \t]*\n)?[ \t]*\d+:\d[^\n]*->[^\n]*")
_LONE_NUMBER = re.compile(r"\n(?:(?<=\n\n)|(?<=[\x1d\x1e]\n))[ \t]*\d{1,6}[ \t]*(?=\n*(?:[\x1d\x1e]|$))")
_MARKUP = re.compile(r"[<{][^<>{}\n\x1d\x1e]{1,200}[>}]")
_SOUNDS = re.compile(r"[(\[*][^()\[\]*\x1d\x1e]{1,120}[)\]*]")
_DASH = re.compile(r"\n[ \t]*(?:♪[ \t]*)?(?:-+|–|>>+)[ \t]+")
_SPEAKER = re.compile(r"\n[ \t]*[A-ZÀ-Þ][A-ZÀ-Þ.'’]{1,15}(?: [A-ZÀ-Þ.'’]{2,15})?(?: ?#?\d{1,2})?:(?=\s)")
#: Word marks of adverts and credits and ends of host names, in lower case, and what must stand there.
_ADVERT_MARKS = (".test", ".example", ".com", ".org", ".net", ".info", "subtitle", "untertitel", "subtítulos", "subtitulos", "زیرنویس", "sync", "presents", "webvtt")
_ADVERT = re.compile(
    r"\.(?:test|example|com|org|net|info)\b|subtitles?\s+(?:by|at|from)\b|download more subtitles|untertitel(?:\s+von)?\s*:|subt[ií]tulos\s+por\b|زیرنویس\s*:|sync(?:ed|hronized)?\s+(?:by|&|and)\s|~\s+presents|^webvtt", re.M
)


def unscrambled(text: str) -> str:
    """A document with its wrong encoding undone, if it has one."""
    for _ in range(4):
        if not any(c in text for c in "ÃÂâØÙطظ") or not _GARBLED.search(text):
            break
        try:
            turned = text.translate(_TO_BYTES).encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            turned = _utf8_step(text, "cp1252") or text
            if turned == text:
                turned = repaired(text)
        if turned == text:
            break
        text = turned
    return text


def spoken(texts: list[str | None]) -> str:
    """The spoken lines of a batch as one string; NULL counts as an empty text."""
    whole = f"{DOC}\n".join(unscrambled(t.replace(DOC, " ").replace(CUE, " ")) if t else "" for t in texts)
    whole = ("\n" + whole).replace("\r\n", "\n").replace("\r", "\n").replace("\ufeff", "")
    whole = _TIME.sub(f"{CUE}\n", whole)
    whole = _LONE_NUMBER.sub(CUE, whole)
    whole = _MARKUP.sub("", whole)
    whole = _without_adverts(whole)
    whole = _SOUNDS.sub(" ", whole)
    whole = _DASH.sub("\n", whole)
    return _SPEAKER.sub("\n", whole)


def _without_adverts(whole: str) -> str:
    """A batch string without the cues that advertise or give credits."""
    low = whole.lower()
    if len(low) != len(whole):  # a few letters change their length
        low = "".join(l if len(l := c.lower()) == 1 else c for c in whole)
    at = set()
    for mark in _ADVERT_MARKS:
        i = low.find(mark)
        while i >= 0:
            at.add(i)
            i = low.find(mark, i + len(mark))
    kept, last = [], 0
    for i in sorted(at):
        if i < last:
            continue
        a = max(low.rfind(CUE, last, i), low.rfind(DOC, last, i), last - 1) + 1
        b = low.find(DOC, i)
        b = len(low) if b < 0 else b
        c = low.find(CUE, i, b)
        b = b if c < 0 else c
        if _ADVERT.search(low[a:b]):
            kept.append(whole[last:a])
            last = b
    kept.append(whole[last:])
    return "".join(kept)


# --- words as numbers -------------------------------------------------------------------

#: Letters that character recognition takes for one another share a code, on all sides.
_ALIKE = ("il1|!íìïîıĺl", "o0óòôöõø", "cecéèêëç", "hb", "uvúùûüν", "aáàâäãå", "nñη", "yýÿ", "ss5", "z2", "g9q6")


def _letters() -> np.ndarray:
    """Code of every character of the basic plane: 0 no letter or digit, 1 a mark to skip, else its class."""
    table = np.zeros(0x10000, np.uint16)
    for i in range(0x10000):
        c = chr(i)
        if c.isalnum():
            low = c.lower()
            table[i] = ord(low[0]) if ord(low[0]) > 2 else 0
    for alike in _ALIKE:
        code = ord(alike[0])
        for c in alike:
            table[ord(c)] = code
            up = c.upper()
            if len(up) == 1:
                table[ord(up)] = code
    for c, to in zip("يكةۀأإآٱ", "یکههاااا"):
        table[ord(c)] = ord(to)
    for c in "‌­'’ً‍\u064b\u064c\u064d\u064e\u064f\u0650\u0651\u0652":
        table[ord(c)] = 1
    for i in range(10):
        table[0x06F0 + i] = table[0x0660 + i] = table[ord("0") + i]
    table[ord("ß")] = ord("s")
    table[ord(DOC)], table[ord(CUE)] = 2, 3
    return table


LETTERS = _letters()


def codes(whole: str) -> np.ndarray:
    """Class of every character of a batch string; two letters read as one are one here."""
    whole = whole.replace("rn", "m").replace("RN", "M").replace("vv", "w").replace("VV", "W")
    raw = np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)
    x = LETTERS[np.minimum(raw, 0xFFFF)]
    return x[x != 1]


def words(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, doc, cue) of every word of a coded batch; cues are counted through the batch."""
    letter = x > 3
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
    # a word's hash: sum of mixed (letter, place in word), so one cumulative sum serves all words
    at = np.arange(len(x), dtype=np.uint32)
    place = at - np.repeat(starts, np.diff(np.r_[starts, len(x)])).astype(np.uint32) if starts[0] == 0 else None
    if place is None:
        first = np.r_[0, starts]
        place = at - np.repeat(first, np.diff(np.r_[first, len(x)])).astype(np.uint32)
    mixed = (x.astype(np.uint32) + place * np.uint32(40503)) * np.uint32(2654435761)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(2246822519)
    total = np.concatenate([[0], np.cumsum(mixed, dtype=np.uint32)]).astype(np.uint32)
    h = (total[ends] - total[starts]).astype(np.uint32)
    h ^= h >> np.uint32(13)
    doc = np.searchsorted(np.flatnonzero(x == 2), starts)
    cue = np.searchsorted(np.flatnonzero((x == 2) | (x == 3)), starts)
    return (h | np.uint32(1)).view(np.int32), doc, cue
