"""Column functions against expected values and small models of their meaning."""

import html.parser
import re
from urllib.parse import parse_qsl, unquote_plus, urlencode, urljoin, urlparse

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kavosh.functions import classify, lite, phones, text, urls
from kavosh.functions.dicts import TRACKING_PARAMS
from kavosh.operators.links import explicit_urls
from kavosh.operators.multivalue import tokenize


def column(spark, values, *made, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [tuple(r)[1:] for r in df.select("i", *made).orderBy("i").collect()]


def one(spark, values, made, kind="string"):
    return [r[0] for r in column(spark, values, made, kind=kind)]


v = None


@pytest.fixture(autouse=True)
def _column(spark):
    globals()["v"] = F.col("v")


def test_phone_forms(spark):
    raw = ["09123456789", "+989123456789", "00989123456789", "۰۹۱۲۳۴۵۶۷۸۹", "02112345678", "+982112345678", "12345", None, "", "9123456789", "0912-345 6789"]
    norm = one(spark, raw, phones.normalize_iranian(v))
    assert norm == ["09123456789"] * 4 + ["02112345678", "+982112345678", "12345", "", "", "09123456789", "09123456789"]
    assert one(spark, raw, phones.classify_phone(v)) == ["mobile"] * 4 + ["landline"] * 2 + ["", "", "", "mobile", "mobile"]


def test_phone_extraction(spark):
    raw = [
        "call 0912 345 6789 or (021) 1234-5678", "+98 912-345-6789", "price 12,500,000 sku 98912345678901", "1.09123456789", "۰۹۱۲۳۴۵۶۷۸۹ و 02188776655", None, "0 9 1 2 3 4 5 6 7 8 9", "size 091234567 89x", "09123456789,09123456789",
    ]
    got = one(spark, raw, phones.extract_phones(v))
    assert got[0] == ["02112345678", "09123456789"] and got[1] == ["09123456789"] and got[2] == [] and got[4] == ["02188776655", "09123456789"]
    assert got[5] == [] and got[8] == ["09123456789"]


def test_number_sets_agree_with_the_tokenizer(spark):
    raw = ['["0912 345 6789", "021-12345678"]', '"02112345678, ext. 3";09123456789', "0912-3456789 - (021) 12345678", " '+۹۸ ۹۱۲ ۳۴۵ ۶۷۸۹' ", "", None, ",,", "021 1234 5678 و 09123456789/09123456789", '"+982143202404; int 39"']
    want = [",".join(sorted({k for p in tokenize(r, "phones") if (k := phones.number_key(p))})) or None for r in raw]
    assert one(spark, raw, phones.number_set(v)) == want
    assert want[0] == want[2] == want[7] == "02112345678,09123456789" and want[8] == "02143202404"


def test_emails(spark):
    raw = ["Info@Example.IR, foo..bar@example.com", "write to a.b+c@x.co.uk now", "none@", None, "x@y.ir x@y.ir", "a@b.c"]
    assert one(spark, raw, text.extract_emails(v)) == [["info@example.ir"], ["a.b+c@x.co.uk"], [], [], ["x@y.ir"], []]


def test_city_and_category(spark):
    raw = ["دفتر تهران tehran", "Kermanshah", "shop in Isfahan", "nothing", None, "كلينيك قم"]
    assert one(spark, raw, text.detect_city(v)) == ["تهران", "کرمان", "اصفهان", None, None, "قم"]
    assert one(spark, raw, text.detect_category(v, F.lit("store.ir")))[2] == "فروشگاه"
    assert one(spark, ["xyz"], text.detect_category(v, F.lit("q")))[0] == "عمومی"


def model_canonical(u):
    p = urlparse(u)
    q = sorted((k, x) for k, x in parse_qsl(p.query, keep_blank_values=True) if k.lower() not in TRACKING_PARAMS)
    return f"{p.scheme.lower()}://{p.netloc.rpartition('@')[2].lower()}{p.path.rstrip('/') if p.path not in ('', '/') else '/'}" + (f"?{urlencode(q)}" if q else "")


def test_canonical_urls(spark):
    raw = [
        "HTTPS://Example.IR/a/?b=2&a=1&utm_source=x#top", "http://x.ir", "https://x.ir:8080/p//", "https://u:p@x.ir/q?a=%D8%AA&b=~*", "https://x.ir/?gclid=1&q=a+b", "https://x.ir/a?c=&a=2&a=1", "http://a.ir/p;x=1/q;y=2?b=2", "https://x.ir//", "ftp://x.ir/", "no url", None, "https://x.ir:bad/",
    ]
    got = one(spark, raw, urls.canonical(v))
    assert got[:8] == [model_canonical(u) for u in raw[:8]] and got[8:] == [None] * 4
    assert one(spark, ["https://www.Example.ir:80/x", None], urls.site_key(v)) == ["example.ir", None]


def test_pages_are_the_same(spark):
    same = [
        "https://example.ir/a/b?x=1&y=2", "http://www.EXAMPLE.ir:80/a/b/?y=2&x=1#frag", "https://example.ir:443/%61/b?utm_campaign=q&x=1&y=2&PHPSESSID=3", "HTTPS://example.ir./a/b?y=2&_ga=1&x=1",
    ]
    other = ["https://example.ir/a/B?x=1&y=2", "https://example.ir:8080/a/b?x=1&y=2", "https://example.ir/a/b?x=1&y=3", "https://example.ir/a/b"]
    keys = one(spark, [*same, *other, None, "", "not a url", "https://example.ir/%zz"], urls.page(v))
    assert len(set(keys[:4])) == 1 and len({keys[0], *keys[4:8]}) == 5 and keys[8:11] == [None] * 3 and keys[11] == "example.ir/%zz"


def test_url_classes(spark):
    raw = ["https://x.ir/contact-us", "https://x.ir/about", "https://x.ir/shop/1", "https://x.ir/", "https://x.ir/تماس", "https://x.ir/a.PDF?x", "https://x.ir/%D8%AA%D9%85%D8%A7%D8%B3"]
    assert one(spark, raw, urls.url_priority(v)) == [30, 28, 20, 5, 30, 5, 5]
    assert one(spark, raw, urls.has_skipped_extension(v)) == [False] * 5 + [True, False]
    assert one(spark, ["https://t.me/share/url", "https://wa.me/98", "https://x.ir/", "https://facebook.com/sharer.php", "https://x.ir/ble.ir/a", "https://facebook.com/a/share", "https://m.facebook.com/sharer"], urls.is_share_link(v)) == [True, True, False, True, True, False, False]
    assert one(spark, ["a.ir", "www.b.com", "air", "", None], urls.is_allowed(v, ("b.com",))) == [True, True, False, False, False]
    assert one(spark, ["m.instagram.com", "notinstagram.com", "", "https://www.t.me/x"], text.is_platform(v)) == [True, False, True, True]


@pytest.mark.parametrize("href", ["/a", "b/c", "../d", "?q=1", "//h.ir/x", "https://z.ir", "", "#f", "./e", "/a/../b"])
def test_join(spark, href):
    base = "https://x.ir/p/q.html?z=1"
    got = spark.createDataFrame([(base, href)], "b string, h string").select(urls.joined(F.col("b"), F.col("h"))).first()[0]
    assert got.split("#")[0] == urljoin(base, href).split("#")[0]


class Nodes(html.parser.HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.skip, self.out, self.inside = 0, [], False

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "body"
        self.skip += tag in ("script", "style", "noscript", "template")

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "noscript", "template")

    def handle_data(self, data):
        if self.inside and not self.skip and data.strip():
            self.out.append(data.strip())


PAGE = """<html><head><title> A | B </title><meta property="og:site_name" content="Shop A"><style>x{}</style></head><body><p>one<b>two</b></p><script>var a="<p>no</p>"</script><!-- gone -->
<a href="https://www.instagram.com/acme?x=1">i</a><a href="//t.me/acme">t</a><address>Tehran, Street 5, No 12</address><a href="/contact">c</a><a href="/contact">again</a><a href="mailto:a@b.ir">m</a><img src="/i.png"></body></html>"""


def test_page_parts(spark):
    n = Nodes()
    n.feed(PAGE)
    got = column(spark, [PAGE, "", None], F.array_join(text.text_nodes(v), "|"), text.page_title(v), text.business_name(v, F.lit("d.ir")), text.address(v, text.visible_text(v)))
    assert got[0] == ("|".join(n.out), "A | B", "Shop A", "Tehran, Street 5, No 12")
    assert got[1][2] == "d.ir" and got[1][3] == ""
    assert one(spark, [PAGE], text.socials(v))[0] == {"instagram": "https://instagram.com/acme?x=1", "telegram": "https://t.me/acme"}
    page = "<title>Fish &amp; Chips – Nur</title><body>Fish &amp; Chips&nbsp;<p>&nbsp;</p>&lt;b&gt;<div>Address - 12 Foo street</div>"
    assert column(spark, [page], text.visible_text(v), text.page_title(v), text.business_name(v, F.lit("d.ir")), text.address(v, text.visible_text(v, "\n")))[0] == ("Fish & Chips <b> Address - 12 Foo street", "Fish & Chips – Nur", "Fish & Chips", "12 Foo street")
    places = ["<address>Tehran <b>not this one at all</b></address><meta name=address content='Bagh Street 5'>", '<span itemprop="streetAddress">Foo Lane 12, Qom</span>', '<p class="address">no address</p>', '<script type="application/ld+json">{"address": {"streetAddress": "Isfahan, Bagh, 10"}}</script>', None]
    assert one(spark, places, text.address(v, F.lit(""))) == ["Bagh Street 5", "Foo Lane 12, Qom", "", "Isfahan, Bagh, 10", ""]
    assert one(spark, ["<title>A - Nur Foods | x</title>", "<title>x</title><script type='application/ld+json'>{\"name\": \"Nur\"}</script>", "<p>\"name\": \"no\"</p>"], text.business_name(v, F.lit("d.ir"))) == ["A - Nur Foods", "Nur", "d.ir"]
    assert one(spark, ["<a href='https://t.me/x?a=1&amp;b=2'>", "<a href=/shop>", "<a href='mailto:a@t.me'>"], text.socials(v, F.lit("https://t.me/y"))) == [{"telegram": "https://t.me/x?a=1&b=2"}, {"telegram": "https://t.me/shop"}, {}]
    assert one(spark, ["see https://a.ir/x. and https://schema.org/y https://a.ir/x"], explicit_urls(v))[0] == ["https://a.ir/x"]


def test_reduced_profile(spark):
    assert one(spark, ["تلفن 09121234567 و +989351112233", "5000912345678", None], lite.lite_phones(v)) == [["09121234567", "09351112233"], [], []]
    assert one(spark, ["A@b.IR a@b.ir", None], lite.lite_emails(v)) == [["a@b.ir"], []]
    assert one(spark, ["Tehran یا قم", "کرمان", None], lite.lite_city(v)) == ["تهران", "", ""] and one(spark, ["my shop", "x"], lite.lite_category(v)) == ["فروشگاه", "عمومی"]
    assert one(spark, ["<a href=https://t.me/a><a href='https://x.ir/telegram'><a href='https://instagram.com/b'>", ""], lite.lite_socials(v)) == [{"instagram": "https://instagram.com/b", "telegram": "https://x.ir/telegram"}, {}]
    assert one(spark, ["wp-content", "wp-content wp-includes", ""], lite.lite_technologies(v)) == [["WordPress(0.56)"], ["WordPress(1)"], []]
    hrefs = ["https://z.ir/q", "//h.ir/a", "/b", "c", "#x", "mailto:a@b", "", "tel:09"]
    assert one(spark, hrefs, lite.lite_absolute(F.lit("https://x.ir:8/p/q?r=1"), v)) == ["https://z.ir/q", "https://h.ir/a", "https://x.ir:8/b", "https://x.ir:8/p/c", None, None, None, "https://x.ir:8/p/tel:09"]
    row = spark.createDataFrame([("<title>Nur - A | b</title><p>0912 09121234567 تهران</p>", "nur.ir")], "v string, d string").select(*[x.alias(n) for n, x in lite.lite_row(F.lit("https://nur.ir/"), F.col("v"), F.col("d")).items()])
    assert row.filter(lite.lite_kept()).first()["business_name"] == "Nur " and row.first()["city"] == "تهران"


def test_technologies(spark):
    pages = ["<link href=/wp-content/x>", "just wordpress here", "data-v-1", "_next/static __NEXT_DATA__", "", None]
    got = one(spark, pages, F.transform(classify.detect_technologies(v, F.lit("https://x.ir"), F.lit("CF-Ray: 1")), lambda t: t["name"]))
    assert got[0] == ["WordPress", "Cloudflare"] and got[1] == ["Cloudflare"] and got[2] == ["Cloudflare"] and got[3] == ["Next.js", "Cloudflare"] and got[5] == ["Cloudflare"]
    order = spark.range(1).select(classify.format_technologies(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("confidence")) for n, x in (("jQuery", 0.5), ("Zeta", 0.9), ("WordPress", 0.4), ("jQuery", 0.7))])))
    assert order.first()[0] == "WordPress; jQuery; Zeta"


def test_names(spark):
    raw = ["  Acme | ", "home", "x.ir", "www.x.ir", "see http://x", "a", None, "Fine Name-", "a,b,c,d,e,f"]
    assert one(spark, raw, text.clean_business_name(v, F.lit("www.X.ir."))) == ["Acme", "", "", "", "", "", "", "Fine Name", ""]


def model_tokens(pieces, by):
    return by.join(pieces)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.from_regex(r"0[0-9]{10}", fullmatch=True), min_size=1, max_size=6), st.sampled_from([",", ", ", ";", " | ", "\n", "\t", "،", " و ", " - ", "/", " & ", ",,"]), st.sampled_from(["", '"', "'"]))
def test_packed_phones_round_trip(values, by, quote):
    assert tokenize(by.join(f"{quote}{x}{quote}" for x in values), "phones") == values


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1, max_size=12).map(str.strip).filter(bool), min_size=1, max_size=5))
def test_packed_json_round_trip(values):
    import json

    assert tokenize(json.dumps(values), "technologies") == values
    assert tokenize(json.dumps(values, ensure_ascii=False), "technologies") == values


def test_unquote_matches_python(spark):
    raw = ["a%20b", "%D8%AA", "plain"]
    assert one(spark, raw, F.coalesce(F.try_url_decode(v), v)) == [unquote_plus(x) for x in raw]
    assert re.match("a", "a")
