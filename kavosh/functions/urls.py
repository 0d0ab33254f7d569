"""Column builders over URLs: parts, page identity, canonical form and classes."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kavosh.functions.dicts import OTHER_PRIORITY, PRIORITIES, SKIP_EXTENSIONS, TRACKING_PARAMS
from kavosh.functions.text import bound, is_platform

#: Query parameters that only track a visit or a campaign (lower case; a trailing * matches any rest).
VISIT_PARAMS = (
    "utm_*", "fbclid", "gclid", "yclid", "msclkid", "dclid", "gbraid", "wbraid", "igshid", "twclid", "ttclid", "li_fat_id", "mc_cid", "mc_eid", "_ga", "_gl", "_hsenc", "_hsmi",
    "phpsessid", "jsessionid", "aspsessionid*", "sessionid", "session_id", "sessid", "sid", "cfid", "cftoken", "zenid", "oly_anon_id", "oly_enc_id", "vero_id", "wickedid", "rb_clickid",
)


def _visit_pattern() -> str:
    names = "|".join(p[:-1] + "[^=]*" if p.endswith("*") else p for p in VISIT_PARAMS)
    return f"(?i)^(?:{names})(?:=.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#\s]*)", 1)


def host(url: Column) -> Column:
    """Host in lower case without port, a leading www. and a final dot; '' without one."""
    return site(F.regexp_replace(authority(url), r":\d*$", ""))


def site(name: Column) -> Column:
    """A host name as a site's key: trimmed, lower case, no leading www., no final dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"\.+$", ""), r"^www\.", "")


def _decoded(text: Column) -> Column:
    """Percent-decoded; left as it is where that fails."""
    return F.when(text.contains("%"), F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)).otherwise(text)


def _stripped_end(text: Column, end: str) -> Column:
    """Without what ``end`` finds at the end; most texts end in a letter or digit, and are not searched."""
    last = F.substring(text, -1, 1)
    return F.when(last.between("0", "z") | last.between("\u0600", "\u06ff"), text).otherwise(F.regexp_replace(text, end, ""))


def page(url: Column) -> Column:
    """What page a URL asks for, as one comparable string; NULL without a host.

    Host, path and remaining query parameters. Scheme, default port, case of the host, a
    leading www., final slashes, the fragment, percent-encoding, the order of parameters and
    parameters of ``VISIT_PARAMS`` make no difference. Each part is computed once, and searched
    only where a character says that there is something to find.
    """
    return bound(F.trim(url), lambda u: bound(_net_and_rest(u), lambda x: _page(u, x["net"], x["rest"])))


def _net_and_rest(url: Column) -> Column:
    """(net, rest): the authority without user, and what follows it; searched only in URLs not of the usual form."""
    prefix = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*"
    searched = F.struct(authority(url).alias("net"), F.substr(url, F.length(F.regexp_extract(url, prefix, 0)) + 1).alias("rest"))

    def cut(body: Column) -> Column:
        net = F.substring_index(F.substring_index(F.substring_index(body, "/", 1), "?", 1), "#", 1)
        return bound(net, lambda n: F.when(_has_any(n, "@", *_SPACES) | body.isNull(), searched).otherwise(F.struct(n.alias("net"), F.substr(body, F.length(n) + 1).alias("rest"))))

    return bound(F.when(url.startswith("https://"), F.substr(url, F.lit(9))).when(url.startswith("http://"), F.substr(url, F.lit(8))), cut)


# What \s finds.
_SPACES = (" ", "\t", "\n", "\v", "\f", "\r")


def _has_any(text: Column, *parts: str) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def _page(url: Column, net: Column, rest: Column) -> Column:
    has_port = net.contains(":")
    name = bound(F.lower(F.trim(F.when(has_port, F.regexp_replace(net, r":\d*$", "")).otherwise(net))), lambda n: _stripped_end(n, r"\.+$"))
    name = bound(name, lambda n: _stripped_end(F.when(n.startswith("www."), F.substr(n, F.lit(5))).otherwise(n), r"\.$"))
    port = F.regexp_extract(net, r":(\d+)$", 1)
    default = (port == "") | ((port == "80") & (scheme(url) == "http")) | ((port == "443") & (scheme(url).isin("https", "")))
    shown_port = F.when(has_port, F.when(default, "").otherwise(F.concat(F.lit(":"), port))).otherwise("")
    rest = F.when(rest.contains("#"), F.regexp_replace(rest, r"#.*$", "")).otherwise(rest)
    path = lambda r: bound(bound(F.substring_index(r, "?", 1), _decoded), lambda p: _stripped_end(p, r"/+$"))
    target = bound(rest, lambda r: F.concat(path(r), F.when(r.contains("?"), bound(_params(F.regexp_extract(r, r"\?(.*)$", 1)), lambda p: F.when(p != "", F.concat(F.lit("?"), p)).otherwise(""))).otherwise("")))
    return bound(name, lambda n: F.when(n != "", F.concat(n, shown_port, target)))


def _params(query: Column) -> Column:
    """The parameters that change a page, decoded, in order."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(_visit_pattern()))
    return F.array_join(F.array_sort(F.transform(kept, lambda p: bound(F.replace(p, F.lit("+"), F.lit("%20")), _decoded))), "&")


# --- canonical form and classes, with the reference pipeline's rules ----------------------


def _encoded(text: Column) -> Column:
    """Decoded and encoded again the form way."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical(url: Column) -> Column:
    """One spelling per URL; see ``_canonical``. The URL is computed once."""
    return bound(url, _canonical)


def _canonical(url: Column) -> Column:
    """One spelling per URL: no fragment, tracking parameters, path parameters or user info, sorted parameters, lower-case scheme and host.

    A path loses its final slashes, an empty one becomes /; an explicit port stays; a URL
    without http(s) scheme or host, or with a broken port, gives NULL.
    """
    url = F.trim(url)
    sch, net = scheme(url), F.regexp_replace(F.lower(authority(url)), ":$", "")
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?]*)", 1), ";[^/]*$", "")
    path = F.when(path.isin("", "/"), "/").otherwise(F.regexp_replace(path, r"/+$", ""))
    pairs = F.transform(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: p != ""), lambda p: F.struct(_encoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), _encoded(F.regexp_extract(p, "^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_PARAMS)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    out = F.concat(sch, F.lit("://"), net, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(sch.isin("http", "https") & net.rlike(r"^[^:]+(:[0-9]+)?$"), out)


def site_key(url: Column) -> Column:
    """Host in lower case without port and one leading www."""
    return F.regexp_replace(F.regexp_replace(F.lower(authority(url)), r":\d*$", ""), r"^www\.", "")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*([^?#]*)", 1)


def url_priority(url: Column) -> Column:
    """How early a page should be crawled, by words of its path as written."""
    path = F.lower(path_of(url))
    (value, words), *more = PRIORITIES
    out = F.when(path.rlike(words), value)
    for value, words in more:
        out = out.when(path.rlike(words), value)
    return out.otherwise(OTHER_PRIORITY)


def has_skipped_extension(url: Column) -> Column:
    return F.lower(path_of(url)).rlike(rf"[.]({'|'.join(SKIP_EXTENSIONS)})$")


# Hosts and paths of links that only share, and paths that are links to platforms gone wrong.
_SHARING = (("linkedin.com", "facebook.com", "twitter.com", "x.com"), "^/(share|sharer|intent)"), (("t.me", "telegram.me", "telegram.dog"), "^/share"), (("wa.me", "api.whatsapp.com"), "")
_MISLED = ("ble.ir", "t.me", "telegram.me", "facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com")


def is_share_link(url: Column) -> Column:
    """Links that share or message on a platform and lead to no content."""
    name, path = site_key(url), F.lower(path_of(url))
    out = path.rlike(f"^/({'|'.join(h.replace('.', '[.]') for h in _MISLED)})/")
    for hosts, start in _SHARING:
        out = out | (name.isin(*hosts) & path.rlike(start))
    return out


def is_allowed(domain: Column, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> Column:
    """Whether a host is a seed or ends in an allowed suffix; an empty list of suffixes allows all."""
    name = F.regexp_replace(F.lower(F.coalesce(domain, F.lit(""))), r"^www\.", "")
    ends = F.lit(True) if not tlds else F.lit(False)
    for t in tlds:
        ends = ends | name.endswith(t.lower())
    return (name != "") & (ends | (name.isin(*seeds) if seeds else F.lit(False)))


def crawlable(url: Column, seeds: tuple[str, ...] = (), tlds: tuple[str, ...] = (".ir",)) -> Column:
    return is_allowed(site_key(url), seeds, tlds) & ~has_skipped_extension(url) & ~is_platform(site_key(url)) & ~is_share_link(url)


def joined(base: Column, href: Column) -> Column:
    """A link's target against the page it stands on; dot segments are resolved in a second, rarer step."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "/")
    folder = F.when(folder.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(folder, F.lit("/"))).otherwise(folder)
    href = F.trim(href)
    out = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), href))
        .when((href == "") | href.startswith("#"), F.concat(F.regexp_replace(base, r"#.*$", ""), href))
        .otherwise(F.concat(folder, href))
    )
    dots = out.rlike(r"/\.{1,2}(/|$|\?|#)")
    return F.coalesce(_resolved(F.when(dots, base), F.when(dots, href)), out)


@F.pandas_udf(T.StringType())
def _resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([urljoin(b, h) if isinstance(b, str) and isinstance(h, str) else None for b, h in zip(base, href)])
