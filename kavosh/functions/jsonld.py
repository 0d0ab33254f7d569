"""Strings of linked data (JSON-LD) in pages, as Column builders over Arrow batches."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys of linked data that name URLs, and those that name ways of contact.
URL_KEYS = ("url", "@id", "sameAs", "mainEntityOfPage", "image", "logo")
CONTACT_KEYS = ("telephone", "phone", "email")


def walk(node: object, key: str | None = None) -> Iterator[tuple[str | None, str, bool]]:
    """Every string of a JSON value: the key it stands under, itself, and whether it is a member of a list."""
    stack = [(key, node, False)]
    while stack:
        k, n, listed = stack.pop()
        if isinstance(n, str):
            yield k, n, listed
        elif isinstance(n, dict):
            stack.extend((x, y, False) for x, y in reversed(list(n.items())))
        elif isinstance(n, list):
            stack.extend((k, x, True) for x in reversed(n))


def _loads(block: object) -> object:
    try:
        return json.loads(block) if isinstance(block, str) else None
    except (ValueError, RecursionError):
        return None


def jsonld_blocks(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>\s*(.*?)\s*</script>"), F.lit(1))


def _strings(wanted):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def udf(blocks: pd.Series) -> pd.Series:
        return blocks.map(lambda bs: [s for b in (bs if bs is not None else ()) for k, s, listed in walk(_loads(b)) if wanted(k, s, listed)])

    return udf


def jsonld_links(blocks: Column) -> Column:
    """Strings of linked data that may hold URLs: members of lists, values of ``URL_KEYS`` and what starts with http. Broken JSON gives none."""
    return _strings(lambda k, s, listed: listed or k in URL_KEYS or s.startswith(("http://", "https://")))(blocks)


def jsonld_contacts(blocks: Column) -> Column:
    """Strings under ``CONTACT_KEYS``; members of lists don't count."""
    return _strings(lambda k, s, listed: k in CONTACT_KEYS and not listed)(blocks)
