"""Column builders over text and HTML: visible text, titles, names, addresses, profiles, links."""

from __future__ import annotations

import html as _html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavosh.functions.dicts import CATEGORIES, CITIES, EMAIL_IN_TEXT, EMAIL_STORED, GENERAL, GENERIC_NAMES, PLATFORM_HOSTS, SOCIAL_HOSTS
from kavosh.functions.jsonld import jsonld_blocks


def plain(text: Column) -> Column:
    """One kind of yeh and kaf, joiners as spaces, lower case; NULL becomes ''."""
    return F.lower(F.translate(F.coalesce(text, F.lit("")), "يك‌", "یک "))


#: Spaces of all widths, as they stand around values.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def _first_best(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The key with most of its words in the text; the first of equals; NULL where none has any."""
    hits = [(k, sum((text.contains(w.lower()).cast("int") for w in words), F.lit(0))) for k, words in table.items()]
    best = F.greatest(*[n for _, n in hits])
    out = F.when(best == 0, None)
    for key, n in hits:
        out = out.when(n == best, key)
    return out


def detect_city(text: Column) -> Column:
    return _first_best(plain(text), CITIES)


def detect_category(text: Column, domain: Column) -> Column:
    both = plain(F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce(domain, F.lit(""))))
    return F.coalesce(_first_best(both, CATEGORIES), F.lit(GENERAL))


def extract_emails(text: Column) -> Column:
    """Sorted distinct e-mail addresses of a free text, in lower case."""
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), "​‌", ""), F.lit(EMAIL_IN_TEXT), F.lit(1))
    lower = F.transform(found, lambda e: F.lower(F.regexp_replace(e, r"^[.,;:()\[\]{}<>]+|[.,;:()\[\]{}<>]+$", "")))
    return F.array_sort(F.array_distinct(F.filter(lower, lambda e: ~e.contains("..") & (F.length(e) <= 254))))


def normalize_emails(emails: Column) -> Column:
    """The valid addresses of an array, lower case, each once, in order."""
    lower = F.transform(emails, lambda e: F.lower(F.trim(e)))
    return F.array_distinct(F.filter(lower, lambda e: e.rlike(EMAIL_STORED) & ~e.contains("..") & (F.length(e) <= 254)))


@F.pandas_udf(T.StringType())
def _unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda t: _html.unescape(t) if isinstance(t, str) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _all_unescaped(s: pd.Series) -> pd.Series:
    return s.map(lambda ts: None if ts is None else [_html.unescape(t) if isinstance(t, str) else None for t in ts])


def decoded(text: Column) -> Column:
    """HTML entities as the characters they stand for; only texts with an ampersand travel to Python."""
    return F.coalesce(_unescaped(F.when(text.contains("&"), text)), text)


def all_decoded(texts: Column) -> Column:
    """``decoded`` for each text of an array."""
    return F.coalesce(_all_unescaped(F.when(F.exists(texts, lambda t: t.contains("&")), texts)), texts)


_VALUE = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, r"""^["']|["']$""", "")


def value_of(tag: Column, name: str) -> Column:
    """An attribute's value in the text of a tag, quoted or not; '' without one."""
    return _bare(F.regexp_extract(tag, rf"(?is)(?<![\w-]){name}\s*=\s*{_VALUE}", 1))


def attributes(html: Column, tag: str, name: str, where: str = "") -> Column:
    """The values of an attribute of all elements of a kind, in order; entities are left as they are."""
    return F.transform(F.regexp_extract_all(html, F.lit(rf"(?is)<(?:{tag})\b{where}[^>]*?(?<![\w-]){name}\s*=\s*{_VALUE}"), F.lit(1)), _bare)


_HIDDEN = r"(?is)<!--.*?-->|<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>"
_BLANK = rf"^[\s{SPACES}]+|[\s{SPACES}]+$"


def text_nodes(html: Column) -> Column:
    """Visible text nodes of a page's body with entities decoded, trimmed, without blank ones."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)$", 1), F.lit("")), html)
    bare = F.regexp_replace(F.regexp_replace(body, _HIDDEN, "\u0001"), r"(?s)<[^>]*>", "\u0001")
    return F.filter(F.transform(F.split(decoded(bare), "\u0001"), lambda t: F.regexp_replace(t, _BLANK, "")), lambda t: t != "")


def visible_text(html: Column, by: str = " ") -> Column:
    return F.array_join(text_nodes(html), by)


def page_title(html: Column) -> Column:
    return F.regexp_replace(decoded(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), _BLANK, "")


def meta(html: Column, kind: str, key: str) -> Column:
    """Content of the first meta tag whose attribute of that kind has that value; '' without one; entities are left as they are."""
    tag = F.regexp_extract(html, rf"(?is)(<meta\b[^>]*(?<![\w-]){kind}\s*=\s*[\"']?{key}[\"'\s/>][^>]*>?)", 1)
    return F.trim(value_of(tag, "content"))


def name_candidates(html: Column) -> Column:
    """What a page's metadata call its business, best first: site name, application name, item name, the first name in linked data."""
    short = lambda v: bound(v, lambda x: F.when((x != "") & (F.length(x) <= 180), x))
    names = F.transform(jsonld_blocks(html), lambda b: F.trim(F.regexp_extract(b, r'"name"\s*:\s*"([^"]{2,180})"', 1)))
    given = [short(meta(html, k, n)) for k, n in (("property", "og:site_name"), ("name", "application-name"), ("itemprop", "name"))]
    return all_decoded(F.array_compact(F.array(*given, F.get(F.filter(names, lambda x: x != ""), F.lit(0)))))


def best_name(candidates: Column, title: Column, domain: Column) -> Column:
    """The first candidate, else the title's first part, else the domain."""
    return F.coalesce(F.get(candidates, F.lit(0)), bound(title, _first_part), domain)


def business_name(html: Column, domain: Column) -> Column:
    """A page's business: metadata first, then linked data, then the title's first part, then the domain."""
    return best_name(name_candidates(html), page_title(html), domain)


def _first_part(title: Column) -> Column:
    """A title up to the first mark that it has, marks tried in order; parts of one character don't count; NULL for an empty title."""
    out = F.when(title != "", F.substring(title, 1, 180))
    for mark in (" – ", " — ", " | ", " - "):
        part = F.trim(F.substring_index(title, mark, 1))
        out = F.when(title.contains(mark) & F.length(part).between(2, 180), part).otherwise(out)
    return F.nullif(out, F.lit(""))


def clean_business_name(value: Column, domain: Column) -> Column:
    """A name fit to show, or ''."""
    v = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "), r"^[ |:\-]+|[ |:\-]+$", "")
    low, host = F.lower(v), normal_host(domain)
    bad = (
        (F.length(v) < 2) | (F.length(v) > 120) | low.isin(*GENERIC_NAMES) | (low == host) | (F.regexp_replace(low, r"^www\.", "") == host) | low.contains("http://") | low.contains("https://")
        | low.contains("www.") | (F.size(F.split(v, " ")) > 14) | (F.regexp_count(v, F.lit(",")) > 4) | (F.regexp_count(v, F.lit(r"\|")) > 1) | (F.regexp_count(v, F.lit("[.!?]")) > 4)
    )
    return F.when(bad, "").otherwise(v)


def normal_host(value: Column) -> Column:
    """Host in lower case without www. and final dots, of a host name or a URL."""
    raw = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    raw = F.when(raw.contains("://"), F.regexp_extract(raw, r"://(?:[^/?#@]*@)?([^/:?#]*)", 1)).otherwise(raw)
    return F.regexp_replace(F.regexp_replace(raw, r"^www\.", ""), r"\.+$", "")


def is_platform(domain: Column) -> Column:
    """Whether a host is empty or belongs to a platform."""
    names = "|".join(h.replace(".", "[.]") for h in PLATFORM_HOSTS)
    host = normal_host(domain)
    return (host == "") | host.rlike(rf"(^|[.])({names})$")


# What may name an address in a page, and the form of labelled ones.
_PLACES = (r"<address\b[^>]*>(.*?)</address\s*>", r"""<\w+\b[^>]*\bitemprop\s*=\s*["']?(?:streetAddress|address|postalAddress)["'\s/>][^>]*>([^<]*)""")
_PLACE_METAS = (("property", "og:street-address"), ("name", "address"))
_LABELLED = r"(?i)(?:آدرس|نشانی|آدرس دفتر|نشانی دفتر|address|office address)\s*[:：\-]?\s*([^\n|]{8,300})"


def address_candidates(html: Column) -> Column:
    """Texts of a page's address elements, address items and metas, and streets in linked data."""
    within, items = (F.regexp_extract_all(html, F.lit("(?is)" + p), F.lit(1)) for p in _PLACES)
    # text of the element itself: what its own elements hold is not
    nodes = F.flatten(F.transform(within, lambda a: F.split(F.regexp_replace(a, r"(?is)<(\w+)\b[^>]*>.*?</\1\s*>|<[^>]*>", "\u0001"), "\u0001")))
    blocks = F.filter(jsonld_blocks(html), lambda b: F.lower(b).contains('"address"'))
    streets = F.flatten(F.transform(blocks, lambda b: F.transform(F.regexp_extract_all(b, F.lit(r'(?i)"streetAddress"\s*:\s*"([^"]{5,200})"'), F.lit(1)), lambda x: F.regexp_replace(x, r"\\u[0-9a-fA-F]{4}", " "))))
    return F.concat(all_decoded(F.concat(nodes, items, F.array(*[meta(html, k, n) for k, n in _PLACE_METAS]))), streets)


def best_address(candidates: Column, lines: Column) -> Column:
    """The longest of the candidates and the labelled addresses of a page's text, the first of equals; '' without one of 8 to 300 characters."""
    squeezed = F.transform(F.concat(F.coalesce(candidates, F.array().cast("array<string>")), F.regexp_extract_all(lines, F.lit(_LABELLED), F.lit(1))), lambda a: F.regexp_replace(F.regexp_replace(a, r"(?U)\s+", " "), r"^[ ,;|]+|[ ,;|]+$", ""))
    fit = F.filter(squeezed, lambda a: F.length(a).between(8, 300))
    return F.aggregate(fit, F.lit(""), lambda best, a: F.when(F.length(a) > F.length(best), a).otherwise(best))


def address(html: Column, lines: Column) -> Column:
    """The longest address-like text of a page, the first of equals; '' without one."""
    return best_address(address_candidates(html), lines)


def hrefs(html: Column) -> Column:
    """Targets of a page's anchors and links in order, entities decoded."""
    return F.transform(all_decoded(attributes(html, "a|link", "href")), lambda h: F.trim(h))


def _on(names: tuple[str, ...]):
    known = "|".join(n.replace(".", "[.]") for n in names)
    return lambda p: p["host"].rlike(rf"(^|[.])({known})$")


def bound(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` mentions it."""
    return F.get(F.transform(F.array(value), lambda x: f(x)), F.lit(0))


def profiles(links: Column, page: Column) -> Column:
    """Map of network to the first profile URL among a page's targets; relative ones stand on the page's own host."""
    origin = F.regexp_extract(page, r"(?i)^(https?://[^/?#]*)", 1)
    absolute = F.transform(
        F.filter(links, lambda h: (h != "") & ~h.rlike("(?i)^(mailto|tel|javascript):")),
        lambda h: F.when(h.rlike("(?i)^https?://"), h).when(h.startswith("//"), F.concat(F.lit("https:"), h)).when(h.startswith("/"), F.concat(origin, h)).otherwise(F.concat(origin, F.lit("/"), h)),
    )
    parts = F.transform(
        absolute,
        lambda h: F.struct(
            F.regexp_replace(F.lower(F.regexp_extract(h, r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]*)", 1)), r"^www\.", "").alias("host"),
            F.regexp_replace(F.regexp_extract(h, r"(?i)^https?://[^/?#]*([^#]*)", 1), r"\?$", "").alias("rest"),
        ),
    )

    def networks(parts: Column) -> Column:
        entries = []
        for network, names in SOCIAL_HOSTS.items():
            first = F.get(F.filter(parts, _on(names)), F.lit(0))
            entries.append(bound(first, lambda p, n=F.lit(network): F.when(p.isNotNull(), F.struct(n.alias("key"), F.concat(F.lit("https://"), p["host"], p["rest"]).alias("value")))))
        return F.array_compact(F.array(*entries))

    return F.map_from_entries(bound(parts, networks))


def socials(html: Column, page: Column | None = None) -> Column:
    """Map of network to the first profile URL a page links to."""
    return profiles(hrefs(html), page if page is not None else F.lit(""))
