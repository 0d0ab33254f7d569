"""Phone numbers: digits, national form and classes, as Column builders and plain functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavosh.functions.dicts import AREA_CODES, MOBILE
from kavosh.functions.text import bound

# Persian and Arabic-Indic digits.
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
ASCII_DIGITS = "0123456789"

_TO_ASCII = str.maketrans(PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)
_EXTENSION = re.compile(r"[\s,;(]*(?:ext(?:ension)?\.?|int\.?|x|داخلی|داخلي)\s*:?\s*\d+\s*\)?\s*$", re.I)


def ascii_digits(text: Column) -> Column:
    """Persian and Arabic-Indic digits as ASCII ones; NULL becomes ''."""
    return F.translate(F.coalesce(text, F.lit("")), PERSIAN_DIGITS + ARABIC_DIGITS, ASCII_DIGITS * 2)


def number_key(piece: str) -> str:
    """One number whatever its notation: national digits without extension; '' if it isn't one."""
    digits = re.sub(r"\D", "", _EXTENSION.sub("", piece.translate(_TO_ASCII)))
    digits = re.sub(r"^(?:00)?98(?=\d{10}$)", "", digits).lstrip("0")
    return f"0{digits}" if len(digits) >= 7 else ""


#: Where one number ends in a packed field, its quotes and brackets included; extensions are cut out before.
_BETWEEN = r"""[,;|\n\r\t،؛•"'\[\]{}/]|(?<=\s)(?:-|&|\+|و|یا|or|and)(?=\s)"""
_JVM_EXTENSION = r"(?i)[\s,;(]*(?:ext(?:ension)?\.?|int\.?|x|داخلی|داخلي)\s*:?\s*\d+\s*\)?"


def number_set(text: Column) -> Column:
    """The distinct numbers of a packed phones field, sorted and comma-joined; NULL if it holds none.

    The same numbers as ``number_key`` over ``tokenize``, in JVM expressions: no quoted part of
    a phones field but an extension holds a delimiter.
    """
    return bound(F.coalesce(text, F.lit("")), _number_set)


# The delimiters of _BETWEEN that are single characters, what is no part of a number and can go at once, and what is in
# all extensions and around all delimiting words. Without these last, no pattern is needed.
_DELIMITERS, _LOST = ",;|\n\r\t،؛•\"'[]{}/", " -()+."
_TOLD_BY = ("x", "X", "int", "Int", "iNt", "inT", "INt", "InT", "iNT", "INT", "داخل", "- ", "& ", "+ ", "و ", "یا ", "or ", "and ", "\n", "\r", "\t", "\v", "\f")


def _number_set(text: Column) -> Column:
    told = text.contains(_TOLD_BY[0])
    for t in _TOLD_BY[1:]:
        told = told | text.contains(t)
    pieces = F.when(told, F.split(F.regexp_replace(ascii_digits(text), _JVM_EXTENSION, ""), _BETWEEN)).otherwise(
        F.split(F.translate(text, PERSIAN_DIGITS + ARABIC_DIGITS + _DELIMITERS + _LOST, ASCII_DIGITS * 2 + "," * len(_DELIMITERS)), ",")
    )
    digits = F.transform(pieces, lambda p: F.regexp_replace(p, "[^0-9]", ""))
    known = F.transform(digits, lambda d: F.when(d.startswith("98") | d.startswith("0098"), F.regexp_replace(d, r"^(?:00)?98(?=\d{10}$)", "")).otherwise(d))
    national = F.filter(F.transform(known, lambda d: F.ltrim(d, F.lit("0"))), lambda d: F.length(d) >= 7)
    keys = F.array_join(F.array_sort(F.array_distinct(F.transform(national, lambda d: F.concat(F.lit("0"), d)))), ",")
    return bound(keys, lambda k: F.when(k != "", k))


# --- single numbers, with the reference pipeline's rules ---------------------------------

_LANDLINE = f"0(?:{'|'.join(AREA_CODES)})[0-9]{{8}}"


def digits(text: Column) -> Column:
    """The digits of a text, as ASCII."""
    return F.regexp_replace(ascii_digits(text), "[^0-9]", "")


def _national(text: Column) -> Column:
    """Digits without a country prefix."""
    return F.regexp_replace(digits(text), "^(?:0098|98)", "")


def normalize_iranian(phone: Column) -> Column:
    """National form: eleven digits from 0; anything else is returned as written, trimmed."""
    d = _national(phone)
    d = F.when(d.rlike("^9[0-9]{9}$"), F.concat(F.lit("0"), d)).otherwise(d)
    return F.when(d.rlike("^0[0-9]{10}$"), d).otherwise(F.trim(F.coalesce(phone, F.lit(""))))


def classify_phone(phone: Column) -> Column:
    """'mobile', 'landline' or ''; mobile is tested first."""
    d = _national(phone)
    d = F.when(d.rlike("^[0-9]{10}$"), F.concat(F.lit("0"), d)).otherwise(d)
    return F.when(d.rlike(f"^{MOBILE}$"), "mobile").when(d.rlike(f"^{_LANDLINE}$"), "landline").otherwise("")


def normalize_phones(phones: Column) -> Column:
    """National forms of the valid numbers of an array, each once, in order."""
    valid = F.filter(F.array_distinct(phones), lambda p: classify_phone(p) != "")  # a national form has the kind of what it stands for
    return F.array_distinct(F.transform(valid, lambda p: normalize_iranian(p)))


# Forms of numbers in free text, compact and with separators.
_PREFIX = r"(?:\+?98|0098)"
_SPACED = r"[\s()-]*"
_CODES = "|".join(AREA_CODES)
PHONE_PATTERNS = (
    rf"(?<![0-9])(?:0|{_PREFIX})9(?:0[1-5]|1[0-9]|2[0-2]|3[0-9]|9[0-9])[0-9]{{7}}(?![0-9])",
    rf"(?<![0-9])(?:0|{_PREFIX})(?:{_CODES})[0-9]{{8}}(?![0-9])",
    rf"(?<![0-9])(?:{_PREFIX}{_SPACED}|0{_SPACED})9(?:{_SPACED}[0-9]){{9}}(?![0-9])",
    rf"(?<![0-9])(?:{_PREFIX}{_SPACED}|0{_SPACED})(?:{_CODES})(?:{_SPACED}[0-9]){{8}}(?![0-9])",
)


def extract_phones(text: Column) -> Column:
    """Sorted distinct valid numbers of a free text; prices, dates and article numbers don't match."""
    t = ascii_digits(text)
    hits = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in PHONE_PATTERNS])
    return F.array_sort(normalize_phones(hits))
