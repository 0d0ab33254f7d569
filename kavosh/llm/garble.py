"""Text decoded with the wrong character encoding: finding it and restoring the original.

A garbled text is the bytes of an intended encoding read under a legacy one. ``repair``
undoes that by round trips: each maximal run of non-ASCII characters is re-encoded under a
candidate legacy encoding and strictly decoded as the intended one, again and again for
nested layers, and a step is kept only when the garbling cost of the text drops. Working on
runs restores a field that is garbled only in part. Bytes that an encoding leaves undefined
pass through as C1 controls, as lenient readers do.

Single-byte misreadings (Arabic-script bytes shown as Western letters) have no internal check
like UTF-8's, so they need a run that touches no ASCII letter and whose decoding is cheaper.
Their code page lacks the Persian yeh; where the bytes say the Arabic one, that is what was written,
and it is restored as such.

Results: NULL and clean text give no case; text with lost characters (replacement
characters, words of question marks) gives a case with the restored text ''; genuine foreign
letters (café, Über) are no case.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kavosh.sources.tables import spread

#: Legacy encodings a text may have been read under, likeliest first.
LEGACY = ("cp1252", "latin_1", "cp1256", "mac_roman", "cp1250", "cp1254", "cp437", "cp850")
MAX_LAYERS = 4

#: Java pattern of texts worth a closer look; anything else is clean.
SUSPICIOUS = r"[\x{80}-\x{ab}\x{ac}-\x{ba}\x{bc}-\x{24f}\x{2c6}-\x{2dc}\x{fffd}]|[\x{2018}-\x{203a}\x{20ac}\x{2122}\x{2200}-\x{25ff}]|\?\?"


def _table(encoding: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(encoding)] = b
        except UnicodeDecodeError:
            pass
        out.setdefault(chr(b), b) if b < 0xA0 else None
    return out


_TABLES = {e: _table(e) for e in LEGACY}
_ARABIC = {b: bytes([b]).decode("cp1256") for b in range(0x80, 0x100)}
_RUN = re.compile(r"[^\x00-\x7f]+")
_WESTERN_RUN = re.compile(r"[^\x00-\x7f؀-ۿ‌]+")
_STRANGE = re.compile(r"[ƀ-ƑƓ-ʯͰ-׿܀-῿⁥-⁯✀-\U0010ffff؀-؋ؐ-ؚ؜-؞ٮ-ٰٵ-ٽڀ-څڇڊ-ڍڏ-ڗڙ-ڨڪ-ڮڰ-ڽڿ-ۋۍ-ۯ]")
_LOOK = re.compile(r"[\x80-\xba\xbc-ɏˆ-˜�‘-›€™∀-◿]|\?\?")
_LOST = re.compile(r"�|(?:^|(?<=[\s«\"'(|]))\?{2,}(?=$|[\s»\"')|])")
_ODD = re.compile(r"[\x80-\x9f\xa1-\xa9\xac-\xb6\xb8-\xba\xbc-\xbfƒˆ-˜†-•‰‹›€™∀-◿�]")
_LETTER_RUN = re.compile(r"[\xc0-ɏ]{2,}")
_MIXED = re.compile(r"[a-z][؀-ۿ]|[؀-ۿ][a-z]|[\xc0-ɏ][؀-ۿ]|[؀-ۿ][\xc0-ɏ]", re.I)
_BAD_ARABIC = re.compile(r"(?:[طظعغآ][^\s\x00-\x7f]){2,}|[طظعغآأ][\xa0-\xbf–-›Œœƒˆ€™]")
_BAD_LATIN = re.compile(r"[\xc2-\xdf\xe0-\xef][\x80-\xbfŒ-˜–-›€™]|[√‚¬Γ├][\xa0-◿]")
_REAL_ODD = re.compile(r"\xa9|\xae|\xb0|\xa3|\xa7|\xbf|\xa1|\xab|\xbb|™|€|•")


def cost(text: str) -> float:
    """How garbled a text looks: 0 for clean text of any script."""
    odd = len(_ODD.findall(text))
    if odd:
        odd -= 0.9 * len(_REAL_ODD.findall(text))
    letters = sum(len(m) - 1 for m in _LETTER_RUN.findall(text))
    return 2 * len(_STRANGE.findall(text)) + odd + letters + len(_MIXED.findall(text)) + sum(len(m) / 2 for m in _BAD_ARABIC.findall(text)) + 2 * len(_BAD_LATIN.findall(text))


def _utf8_step(text: str, encoding: str) -> str | None:
    """Every garbled run that is strict UTF-8 under ``encoding`` decoded; None if there is none.

    For the Western code pages a run ends at an Arabic letter, so a genuine word may touch it.
    """
    hit, table = False, _TABLES[encoding]

    def turn(m: re.Match) -> str:
        nonlocal hit
        try:
            out = bytes(table[c] for c in m.group()).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return m.group()
        hit = True
        return out

    out = (_RUN if encoding == "cp1256" else _WESTERN_RUN).sub(turn, text)
    return out if hit else None


def _arabic_step(text: str) -> str | None:
    """Arabic-script bytes read as Western letters, decoded; None if no run qualifies."""
    hit = False
    table = _TABLES["cp1252"]

    def turn(m: re.Match) -> str:
        nonlocal hit
        run = m.group()
        a, b = m.start(), m.end()
        if (a and text[a - 1].isalpha() and text[a - 1].isascii()) or (b < len(text) and text[b].isalpha() and text[b].isascii()):
            return run
        try:
            out = "".join(_ARABIC[table[c]] for c in run)
        except KeyError:
            return run
        if not re.search(r"[؀-ۿ]", out):
            return run
        hit = True
        return out

    out = _RUN.sub(turn, text)
    return out if hit else None


def _search(text: str, level: float, layers: int) -> tuple[float, str]:
    """The cheapest text within so many layers of decoding, and its cost."""
    best = (level, text)
    if level <= 0 or not layers:
        return best
    tried = dict.fromkeys(t for e in LEGACY if (t := _utf8_step(text, e)) is not None)
    if (last := _arabic_step(text)) is not None:
        tried[last] = None
    for t in tried:
        c = cost(t)
        if c < 1.5 * level + 1:
            found = _search(t, c, layers - 1)
            if found[0] < best[0]:
                best = found
    return best


def repair(text: str | None) -> str | None:
    """None for clean text, '' where characters were lost, else the restored text."""
    if not text or not _LOOK.search(text):
        return None
    if _LOST.search(text):
        return ""
    best = _search(text, cost(text), MAX_LAYERS)[1]
    if best == text:
        return None
    return "" if _LOST.search(best) else best


def repaired(text: str) -> str:
    """The text to read: restored where that can be had, else as it stands."""
    return repair(text) or text


def garbled_fields(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("title", "business_name")) -> DataFrame:
    """(id, field, restored) of each garbled field; one narrow pass, no shuffle.

    Unpivots the fields, lets the JVM drop the texts without a suspicious character, and sends
    only the rest to Python in Arrow batches. Rows are judged alone, so skew can't arise.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("text")) for f in fields]))
    long = df.select(F.col(id_col).cast("bigint").alias("id"), pairs.alias("x")).select("id", "x.field", "x.text")
    look = long.filter(F.col("text").rlike(SUSPICIOUS))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(restored=[repair(t) for t in pdf["text"]])
            yield pdf.loc[pdf["restored"].notna(), ["id", "field", "restored"]]

    return spread(look).mapInPandas(judge, "id bigint, field string, restored string")


def is_garbled(text: Column) -> Column:
    """Whether a text is garbled (false for NULL)."""

    @F.pandas_udf("boolean")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: isinstance(t, str) and repair(t) is not None)

    return udf(F.when(text.rlike(SUSPICIOUS), text))  # other texts reach Python as NULL
