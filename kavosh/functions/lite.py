"""Column builders of the reduced profile: plain word marks, loose patterns, first hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kavosh.functions import urls
from kavosh.functions.dicts import EMAIL_LITE, GENERAL
from kavosh.functions.text import attributes, decoded, page_title

# Cities, categories and technologies of the reduced profile and the words that speak for them.
LITE_CITIES = {
    "تهران": ("تهران", "tehran"), "اصفهان": ("اصفهان", "isfahan", "esfahan"), "مشهد": ("مشهد", "mashhad"), "شیراز": ("شیراز", "shiraz"), "تبریز": ("تبریز", "tabriz"), "کرج": ("کرج", "karaj"), "اهواز": ("اهواز", "ahvaz"),
    "قم": ("قم", "qom"), "رشت": ("رشت", "rasht"), "یزد": ("یزد", "yazd"),
}
LITE_CATEGORIES = {
    "فروشگاه": ("فروشگاه", "shop", "store"), "رستوران": ("رستوران", "restaurant", "کافه"), "پزشکی": ("پزشک", "کلینیک", "clinic"), "املاک": ("املاک", "real estate"), "آموزش": ("آموزش", "آموزشگاه"), "فناوری": ("نرم‌افزار", "software"),
}
LITE_TECHNOLOGIES = {
    "WordPress": ("wp-content", "wp-includes", "wordpress"), "WooCommerce": ("woocommerce", "wc-add-to-cart", "wc-block"), "Joomla": ("joomla", "/components/com_"), "Drupal": ("drupal", "/sites/default/files"),
    "Shopify": ("cdn.shopify.com", "myshopify.com"), "Laravel": ("laravel",), "Next.js": ("_next/static", "__next_data__"), "Cloudflare": ("cloudflare",),
}
LITE_MOBILE = r"(?:\+98|98|0)?(9(?:0[1-5]|1[0-9]|2[0-2]|3[0-9]|9[0-9])[0-9]{7})"
LITE_SOCIALS = (("instagram", ("instagram.com",)), ("telegram", ("t.me", "telegram")), ("linkedin", ("linkedin.com",)))


def _first_hit(text: Column, table: dict[str, tuple[str, ...]], default: str) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    out = None
    for name, words in table.items():
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def lite_city(text: Column) -> Column:
    """The first city of the list that the text mentions; ''."""
    return _first_hit(text, LITE_CITIES, "")


def lite_category(text: Column) -> Column:
    """The first category of the list one of whose words stands in the text."""
    return _first_hit(text, LITE_CATEGORIES, GENERAL)


def lite_phones(text: Column) -> Column:
    """Mobile numbers anywhere in a text, in order of appearance, ASCII digits only; no look at what stands around them."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(LITE_MOBILE), F.lit(1)), lambda n: F.concat(F.lit("0"), n)))


def lite_emails(text: Column) -> Column:
    """Addresses by a loose pattern, lower case, in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL_LITE), F.lit(0)), lambda e: F.lower(e)))


def lite_technologies(html: Column, url: Column | None = None) -> Column:
    """Name(confidence) of each technology a page or its URL mentions."""
    low, out = F.lower(F.concat_ws(" ", html, url if url is not None else F.lit(""))), []
    for name, marks in LITE_TECHNOLOGIES.items():
        hits = sum((low.contains(m).cast("int") for m in marks), F.lit(0))
        share = F.round(F.least(hits / F.lit(max(0.6 * len(marks), 1.0)), F.lit(1.0)), 2)
        # numbers as short as they can be: 1, 0.5, 0.56
        shown = F.regexp_replace(F.when(share < 0.35, 0.5).otherwise(share).cast("string"), r"\.0$", "")
        out.append(F.when(hits > 0, F.concat(F.lit(f"{name}("), shown, F.lit(")"))))
    return F.array_compact(F.array(*out))


def lite_socials(html: Column) -> Column:
    """Map of network to the last target that mentions it."""
    links = attributes(html, r"\w+", "href")
    kind = lambda h: F.coalesce(*[F.when(h.rlike("(?i)" + "|".join(m.replace(".", "[.]") for m in marks)), name) for name, marks in LITE_SOCIALS])
    last = lambda name: F.element_at(F.filter(links, lambda h: kind(h) == name), F.when(F.exists(links, lambda h: kind(h) == name), -1))
    return F.map_from_entries(F.array_compact(F.array(*[F.when(last(n).isNotNull(), F.struct(F.lit(n).alias("key"), last(n).alias("value"))) for n, _ in LITE_SOCIALS])))


def lite_text(html: Column) -> Column:
    """All text of a page, scripts included, entities decoded."""
    return decoded(F.regexp_replace(html, r"(?s)<[^>]*>", ""))


def lite_name(title: Column, domain: Column) -> Column:
    """A title up to its first hyphen and bar, as it stands, or the domain."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.split_part(F.split_part(title, F.lit("-"), F.lit(1)), F.lit("|"), F.lit(1))).otherwise(domain)


def lite_absolute(page: Column, href: Column) -> Column:
    """A link's target, dot segments left in; NULL for what leads nowhere."""
    href, origin = F.trim(href), F.regexp_extract(page, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]+)", 1)
    folder = F.regexp_replace(F.coalesce(F.nullif(F.regexp_extract(page, r"(?i)^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1), F.lit("")), F.lit("/")), r"/[^/]*$", "/")
    there = F.when(href.rlike("(?i)^https?://"), href).when(origin == "", None).when(href.startswith("//"), F.concat(urls.scheme(page), F.lit(":"), href))
    return F.when((href != "") & ~href.rlike("^(#|javascript:|mailto:)"), there.when(href.startswith("/"), F.concat(origin, href)).otherwise(F.concat(origin, folder, href)))


def lite_same_host_links(page: Column, html: Column, limit: int = 30, tlds: tuple[str, ...] = (".ir",)) -> Column:
    """Targets on a page's own host among its first links; how many are looked at is the profile's setting."""
    first = F.slice(F.filter(attributes(html, r"\w+", "href"), lambda h: h != ""), 1, limit)
    absolute = F.transform(first, lambda h: lite_absolute(page, h))
    return F.array_distinct(F.filter(absolute, lambda u: u.isNotNull() & (urls.site_key(u) == urls.site_key(page)) & urls.is_allowed(urls.site_key(u), (), tlds)))


def lite_row(url: Column, html: Column, domain: Column) -> dict[str, Column]:
    """The columns of a contact row in the reduced profile; rows without number, address or technology are not kept (``lite_kept``)."""
    text, title = lite_text(html), page_title(html)
    return {
        "source_url": url, "domain": domain, "title": title, "phones": F.array_join(lite_phones(text), ","), "emails": F.array_join(lite_emails(text), ","), "business_name": lite_name(title, domain), "category": lite_category(text),
        "city": lite_city(text), "socials": F.to_json(lite_socials(html)), "technologies": F.array_join(lite_technologies(html, url), "; "),
    }


def lite_kept() -> Column:
    return (F.col("phones") != "") | (F.col("emails") != "") | (F.col("technologies") != "")
