"""Operators against brute force over small tables, with the odd cases."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kavosh.functions import jsonld, lite, text
from kavosh.operators import contacts, frontier, hotkeys, layers, links
from kavosh.operators.hotkeys import key_profile, third_partners
from kavosh.operators.multivalue import packed_values, split_values, tokenize
from kavosh.sources import feeds, sinks
from kavosh.streaming import flows

CASES = {
    "phones": {
        "09121111111, 09122222222": ["09121111111", "09122222222"], '"021-1, ext. 3", 0912': ["021-1, ext. 3", "0912"], "": [], "  ": [], ",;,": [], '["a", "b\\u06f1"]': ["a", "b۱"], "'x'،'y'": ["x", "y"], '"open, x': ['"open', "x"],
        "0912 345 و 021/5 - 7": ["0912 345", "021", "5", "7"],
    },
    "emails": {
        '"Sales, A" <a@x.ir>; b@x.ir': ['"Sales, A" <a@x.ir>', "b@x.ir"], '"""Office, B"" <b@y.ir>"; "c@y.ir"': ['"Office, B" <b@y.ir>', "c@y.ir"], "a@x.ir b@x.ir": ["a@x.ir", "b@x.ir"], 'Info "Sales, Tehran" <a@b.c>, d@e.f': ['Info "Sales, Tehran" <a@b.c>', "d@e.f"], "Sales Team <a@b.c> d@e.f": ["Sales Team <a@b.c>", "d@e.f"], "mailto:a@x.ir یا b@x.ir": ["mailto:a@x.ir", "b@x.ir"],
        '["\\"S, M\\" <h@m.ir>", "x@y.ir"]': ['"S, M" <h@m.ir>', "x@y.ir"],
    },
    "technologies": {"C++ Gateway + jQuery": ["C++ Gateway", "jQuery"], '"Player / HLS", "A ""B"" C";X (0.5)': ["Player / HLS", 'A "B" C', "X (0.5)"], "a • b": ["a", "b"], "Foo (a, b); Bar": ["Foo (a, b)", "Bar"], "A\\,B, C": ["A,B", "C"], "x (open, y": ["x (open", "y"], 'O"Neil, b': ['O"Neil', "b"], "a ) b, (c": ["a ) b", "(c"], "f[1; (2, 3)], g": ["f[1; (2, 3)]", "g"], "Asan-Pay; ; Vue.js": ["Asan-Pay", "Vue.js"]},
    "socials": {
        '{"a": ["https://x.ir/1", "https://x.ir/2"], "b": "https://y.ir?v=1;h=2"}': ["https://x.ir/1", "https://x.ir/2", "https://y.ir?v=1;h=2"], "{'t': 'https://t.ir/q?l=fa,en'}": ["https://t.ir/q?l=fa,en"], "{}": [], "None": ["None"],
        "a=https://x.ir/1?v=1;hl=fa;b=https://y.ir": ["https://x.ir/1?v=1;hl=fa", "https://y.ir"], "t: https://t.ir/a\ny: https://y.ir/b": ["https://t.ir/a", "https://y.ir/b"], "a=https://x.ir&&b=https://y.ir?s=1&id=2": ["https://x.ir", "https://y.ir?s=1&id=2"],
    },
}


@pytest.mark.parametrize(("field", "raw"), [(f, r) for f, cases in CASES.items() for r in cases])
def test_tokenizer(field, raw):
    assert tokenize(raw, field) == CASES[field][raw]


def test_tokenizer_is_linear():
    def seconds(n):
        began = time.perf_counter()
        tokenize(" ".join(f"a{i}@b.c" for i in range(n)), "emails"), tokenize("(" * n + ",a", "technologies"), tokenize("," * n, "socials"), tokenize('"' * n + "a", "phones"), tokenize("(a, b) " * n, "phones")
        return time.perf_counter() - began

    one, four = min(seconds(5_000) for _ in range(3)), min(seconds(20_000) for _ in range(3))
    assert four < 8 * one


def test_split_values(spark):
    rows = [(1, "a,b", None, "x", "1"), (2, None, "", None, "2"), (3, "c,c", "d@e.ir", "y;z", "3"), (3, "c,c", "d@e.ir", "y;z", "3"), (4, "," * 200_000 + "q", None, None, None)]
    df = spark.createDataFrame(rows, "id int, phones string, emails string, technologies string, piece string")
    got = sorted(tuple(r) for r in packed_values(df).collect())
    assert got == sorted([(1, "phones", 1, "a"), (1, "phones", 2, "b")] + 2 * [(3, "phones", 1, "c"), (3, "phones", 2, "c"), (3, "technologies", 1, "y"), (3, "technologies", 2, "z")])
    assert split_values(df).filter("id = 4").count() == 1 and split_values(df.limit(0)).count() == 0


def brute_profile(rows, key, partner, k):
    best, out = {}, {}
    for r in sorted(rows, key=lambda r: (r["t"] is None, r["t"] or "", r["id"])):
        if r[key] is None:
            continue
        seen = best.setdefault(r[key], [])
        if r[partner] is not None and r[partner] not in seen:
            seen.append(r[partner])
            if len(seen) == k:
                out[r[key]] = r["id"]
    return out


def test_key_profiles(spark):
    rng = random.Random(5)
    rows = [{"id": i, "a": rng.choice([None, "hot", "hot", "hot", *map(str, range(30))]), "b": rng.choice([None, *map(str, range(9))]), "t": rng.choice([None, "2024-01-01T00:00:05", f"2024-01-0{rng.randint(1, 9)}T00:00:00"]), "field": "x", "key": 1} for i in range(1500)]
    df = spark.createDataFrame(rows, "id bigint, a string, b string, t string, field string, key int").repartition(7)
    got = key_profile(df, {"a": "b", "b": "a"}, "id", "t", None, 3).collect()
    for key, partner in (("a", "b"), ("b", "a")):
        assert {r["key_value"]: r["kth_id"] for r in got if r["field"] == key and r["kth_id"] is not None} == brute_profile(rows, key, partner, 3)
        assert {r["key_value"]: r["n_rows"] for r in got if r["field"] == key} == {v: sum(r[key] == v for r in rows) for v in {r[key] for r in rows} - {None}}
    empty = spark.createDataFrame([], "id bigint, source_url string, target_url string, target_domain string, external boolean, first_seen string")
    assert third_partners(empty).count() == 0


def test_key_arrays_merge_in_linear_time():
    def seconds(n):
        total = hotkeys._Accumulator(3)
        sets = [(np.array([f"k{(i * 977 + j) % (n * 500)}" for j in range(5000)], object), *(np.ones(5000, np.int64) for _ in range(4)), np.arange(5000), np.array(["p"] * 5000, object), np.arange(5000), np.arange(5000)) for i in range(n)]
        began = time.perf_counter()
        for x in sets:
            total.add(*x)
        total.merge()
        assert total.sums["n"].sum() == 5000 * n
        return time.perf_counter() - began

    seconds(5)
    one, four = min(seconds(20) for _ in range(3)), min(seconds(80) for _ in range(2))
    assert four < 8 * one


def test_folded_links(spark):
    rows = [(1, "s", "t", "d", True, False, "script", "2024"), (2, "s", "t", "e", False, True, "anchor,script", "2025"), (3, "s", "u", None, None, None, None, None), (3, "s", "u", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, source_url string, target_url string, target_domain string, external boolean, crawlable boolean, link_type string, first_seen string")
    got = {r["target_url"]: r for r in links.fold_links(df).collect()}
    assert (got["t"]["link_type"], got["t"]["external"], got["t"]["crawlable"], got["t"]["target_domain"], got["t"]["first_seen"]) == ("script,anchor", True, True, "d", "2024")
    assert got["u"]["external"] is None and got["u"]["link_type"] == ""


def test_page_links(spark):
    html = '<head><link rel="canonical" href="/c"></head><body><a href="/x?utm_source=1">a</a><a href="/x">b</a><script src="/s.js"></script><img srcset="/i.png 1x, /j.png 2x">https://o.com/y.<a href="#z">n</a><a href="javascript:1">j</a></body>'
    got = {r["target_url"]: r for r in links.page_links(spark.createDataFrame([("https://x.ir/p", html), ("https://y.ir", None)], "url string, html string")).collect()}
    assert {u: r["link_type"] for u, r in got.items()} == {"https://x.ir/x": "anchor", "https://x.ir/c": "canonical", "https://x.ir/s.js": "script", "https://x.ir/i.png": "srcset", "https://x.ir/j.png": "srcset", "https://o.com/y": "text_or_script"}
    assert got["https://x.ir/x"]["crawlable"] and not got["https://x.ir/s.js"]["crawlable"] and got["https://o.com/y"]["external"]
    odd = """<a href="/p?a=1&amp;b=2">x</a><a href=/bare>y</a><script type="application/ld+json">{"url": "/rel", "sameAs": ["https:\\/\\/ld.ir\\/x" ], "d": {"logo": "https://ld.ir/y" }, "z": "see https://no.ir/q"}</script><a href="mailto:a@b.ir">m</a>"""
    page = spark.createDataFrame([("https://x.ir/p", odd, "http://x.ir/old", ["http://x.ir/mid", "http://x.ir/mid"]), ("https://y.ir/", None, "https://y.ir/", None)], "url string, html string, request_url string, redirect_urls array<string>")
    edges = {(r["source_url"], r["target_url"]): r["link_type"] for r in links.page_links(page).collect()}
    want = {("https://x.ir/p", u): k for u, k in {"https://x.ir/p?a=1&b=2": "anchor", "https://x.ir/bare": "anchor", "https://ld.ir/x": "jsonld", "https://ld.ir/y": "jsonld", "https://no.ir/q": "text_or_script"}.items()}
    assert edges == want | {("http://x.ir/old", "http://x.ir/mid"): "redirect", ("http://x.ir/mid", "https://x.ir/p"): "redirect"}
    assert links.followed(spark.createDataFrame([(True, "anchor"), (True, "script"), (False, "anchor")], "crawlable boolean, link_type string")).count() == 1


def test_layers_on_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None)], "source_url string, target_url string")
    got = {r["url"]: r["depth"] for r in layers.layers(edges, spark.createDataFrame([("a",)], "url string"), 9).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}


def test_layer_barrier(spark):
    state = spark.createDataFrame([("s", "a", 0, "crawled"), ("s", "b", 1, "queued"), ("s", "c", 1, "pending"), ("s", "d", 2, "pending"), ("r", "e", 0, "crawled")], "seed_url string, url string, depth int, status string")
    assert [r["url"] for r in layers.lowest_open_layer(state).collect()] == ["c"]
    assert {(r[0], r[1]) for r in layers.finished_depth(state).collect()} == {("s", 0), ("r", 0)}


def brute_new(rows):
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r[0]):
        keys = {("d", r[1] or "")} | {("p", x) for x in (r[2] or "").split(",") if x} | {("e", x) for x in (r[3] or "").split(",") if x}
        if keys - seen or (r[4] or "") or (r[5] or ""):
            out.append(r[0])
        seen |= keys
    return out


def test_newcomers(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "a", "b", "c"]), ",".join(rng.sample("1234567", rng.randint(0, 2))), rng.choice([None, "m", "n", "m,n"]), rng.choice([None, "", "", "{x}"]), None) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, domain string, phones string, emails string, socials string, technologies string")
    assert sorted(r["id"] for r in contacts.newcomers(df).collect()) == brute_new(rows)


def test_sites_and_wide(spark):
    rows = [
        (1, "x.ir", "u1", "T1", "09121111111,02112345678", "a@x.ir", "short", "Acme", None, None, "WordPress; Zeta (0.5)", 0.5, "2024-01-01T00:00:00"),
        (2, "x.ir", "u2", "T2", "09121111111,0912", "b@x.ir,a@x.ir", "a longer one", "Acne", "c", "q", "jQuery", 0.705, "2024-02-01T00:00:00"), (3, None, None, None, None, None, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, domain string, source_url string, title string, phones string, emails string, address string, business_name string, category string, city string, technologies string, quality_score double, crawled_at string")
    got = {r["domain"]: r for r in contacts.sites(df).collect()}
    assert got["x.ir"]["phones"] == "09121111111,0912,02112345678" and got["x.ir"]["emails"] == "b@x.ir,a@x.ir" and got["x.ir"]["address"] == "a longer one" and got["x.ir"]["business_name"] == "Acne" and got["x.ir"]["title"] == "T2"
    assert got[""]["quality_score"] == 0.0
    w = contacts.wide(contacts.sites(df)).filter("domain = 'x.ir'").first().asDict()
    assert (w["phone_1"], w["tel_1"], w["email_2"]) == ("09121111111", "02112345678", "a@x.ir") and [w[f"technology_{i}"] for i in (1, 2, 3)] == ["WordPress", "jQuery", "Zeta"]


def test_wide_has_no_expression_a_column(spark):
    names = [f"T{i:04d}" for i in range(3_000)]
    df = spark.createDataFrame([(f"s{i}.ir", None, None, ";".join(names[i * 100 : i * 100 + 101])) for i in range(30)], "domain string, phones string, emails string, technologies string")
    w = contacts.wide(df)
    assert len(w.columns) == 3_001 and len(w._jdf.queryExecution().optimizedPlan().expressions().mkString(",")) < 200_000 and "array_contains" not in w._jdf.queryExecution().optimizedPlan().toString()
    rows = {r[0]: {c: v for c, v in zip(w.columns[1:], r[1:]) if v} for r in w.collect()}
    assert rows["s2.ir"] == {f"technology_{i + 1}": names[i] for i in range(200, 301)} and rows["s29.ir"]["technology_3000"] == "T2999"
    assert all(v is not None for v in w.first())


def test_wide_tasks_follow_cells(spark, monkeypatch):
    df = spark.createDataFrame([(f"s{i}.ir", None, None, ";".join(f"T{i:02d}{k}" for k in range(10))) for i in range(60)], "domain string, phones string, emails string, technologies string").coalesce(1)
    whole = sorted(map(tuple, contacts.wide(df).collect()))
    monkeypatch.setattr(contacts, "TASK_CELLS", 5_000)  # of 36,060
    w = contacts.wide(df)
    sizes = [n for n in w.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) == 8 and max(sizes) * len(w.columns) <= 5_000 and sorted(map(tuple, w.collect())) == whole
    assert not any(f.nullable for f in w.schema.fields[1:])


def test_cells_keep_every_value(spark):
    mobiles, mails = [f"0912111110{i}" for i in range(6)], [f"m{i}@x.ir" for i in range(5)]
    rows = [(1, "x.ir", ",".join(mobiles[:3]), ",".join(mails), "jQuery; Asan-Pay"), (2, "x.ir", ",".join(mobiles[3:]) + ",02112345678", "m0@x.ir", "C++ Gateway (0.5);(0.1)"), (3, "y.ir", None, None, "Asan-Pay")]
    df = spark.createDataFrame(rows, "id int, domain string, phones string, emails string, technologies string").withColumns({x: F.lit(None).cast("string") for x in ("source_url", "title", "address", "business_name", "category", "city")} | {"crawled_at": F.lit("2024-01-01T00:00:00")} | {"quality_score": F.lit(1.0)})
    got = sorted(tuple(r) for r in contacts.cells(contacts.sites(df)).collect())
    want = [("x.ir", "phone", i + 1, v) for i, v in enumerate(mobiles)] + [("x.ir", "tel", 1, "02112345678")] + [("x.ir", "email", i + 1, v) for i, v in enumerate(mails)]
    assert got == sorted(want + [("x.ir", "technology", i + 1, v) for i, v in enumerate(["jQuery", "Asan-Pay", "C++ Gateway"])] + [("y.ir", "technology", 1, "Asan-Pay")])


def test_insert_ignore_and_stream(spark, tmp_path):
    schema = "id int, source_url string, phones string, crawled_at timestamp"
    batch = spark.createDataFrame([(1, "a", "1"), (2, "a", "1"), (3, "a", None), (4, "b", "1"), (5, "a", "")], "id int, source_url string, phones string").withColumn("crawled_at", F.timestamp_seconds(F.col("id") * 86400))
    folder, target = str(tmp_path / "in"), str(tmp_path / "out")
    batch.filter("id < 4").coalesce(1).write.parquet(folder)
    batch.filter("id >= 4").coalesce(1).write.mode("append").parquet(folder)
    flows.intake(flows.files(spark, folder, spark.createDataFrame([], schema)), target, str(tmp_path / "c")).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(target).collect()) == [1, 3, 4]
    q = flows.first_seen(flows.files(spark, folder, spark.createDataFrame([], schema)), "source_url", "id").writeStream.outputMode("update").format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    last = spark.sql("select key, min(first) f, max(n) n from firsts group by key").collect()
    assert {(r["key"], r["f"], r["n"]) for r in last} == {("a", 1, 4), ("b", 4, 1)}
    q = flows.windowed_counts(flows.files(spark, folder, spark.createDataFrame([], schema)), "crawled_at", "source_url").writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from windows").first()[0] == 5


def test_feeds_and_sinks(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text("# c\n\nwww.A.ir\nhttps://b.com/x/\na.ir\nhttps://www.a.ir\n", "utf-8")
    assert [r["url"] for r in feeds.seeds(spark, str(tmp_path / "seeds.txt")).orderBy("place").collect()] == ["https://www.a.ir/", "https://b.com/x", "https://a.ir/"]
    assert feeds.has_seeds(str(tmp_path / "seeds.txt")) and not feeds.has_seeds(str(tmp_path / "none.txt"))
    queue = feeds.enqueued(spark.createDataFrame([("https://a.ir",)], "url string"), spark.createDataFrame([("a.ir",), (" www.d.ir/x ",), ("# c",), ("",), ("b.com",), ("HTTP://e.ir",)], "line string"))
    assert {tuple(r) for r in queue.collect()} == {("https://www.d.ir/x", "d.ir", 0, "pending"), ("HTTP://e.ir", "e.ir", 0, "pending")}
    feeds.note(str(tmp_path / "kv.json"), "running", "0"), feeds.note(str(tmp_path / "kv.json"), "running", "1")
    assert feeds.noted(str(tmp_path / "kv.json"), "running") == "1" and feeds.noted(str(tmp_path / "kv.json"), "x", "d") == "d"
    got = {r["url"] for r in feeds.seeds(spark, str(tmp_path / "seeds.txt")).collect()}
    assert got == {"https://www.a.ir/", "https://b.com/x", "https://a.ir/"} and feeds.seeds(spark, str(tmp_path / "seeds.txt"), (".ir",)).count() == 2
    bodies = spark.createDataFrame([("u", "User-agent: *\nSitemap: https://a.ir/s.xml \n sitemap:https://a.ir/t"), ("v", None)], "url string, body string")
    assert {(r["target_url"], r["link_type"], r["crawlable"], r["external"]) for r in feeds.robots_sitemaps(bodies).collect()} == {("https://a.ir/s.xml", "robots_sitemap", True, True), ("https://a.ir/t", "robots_sitemap", True, True)}
    maps = spark.createDataFrame([("u", "<urlset><loc> https://a.ir/p </loc><LOC><![CDATA[https://a.ir/s2.xml.gz]]></LOC><loc></loc><loc>https://b.com/q/</loc><loc>ftp://c.ir/</loc>")], "url string, body string")
    assert {(r["target_url"], r["nested"], r["crawlable"]) for r in feeds.sitemap_locations(maps).collect()} == {("https://a.ir/p", False, True), ("https://a.ir/s2.xml.gz", True, True), ("https://b.com/q", False, False)}
    (tmp_path / "c.json").write_text('{"cycle_delay": 5, "z": 1}')
    assert feeds.settings(str(tmp_path / "c.json")) == feeds.DEFAULTS | {"cycle_delay": 5, "z": 1} and feeds.settings("/nowhere") == feeds.DEFAULTS
    assert json.loads((tmp_path / "c.json").read_text())["z"] == 1 and feeds.save_settings(str(tmp_path / "c.json"), {"z": 2})["z"] == 2
    assert feeds.tld_list(" IR, .com,,") == [".ir", ".com"] and feeds.log_tail(spark, str(tmp_path / "seeds.txt"), 2) == ["a.ir", "https://www.a.ir"]
    sinks.write_csv(spark.createDataFrame([("0912", None)], "p string, q string"), str(tmp_path / "csv"), True)
    assert next((tmp_path / "csv").glob("part*")).read_bytes().startswith("﻿p,q".encode())


def test_searches(spark):
    df = spark.createDataFrame([("GOL.ir", "1", None, None, "WordPress", "t"), ("x", "2", None, "golden", None, "t"), ("y", None, None, None, None, None)], "domain string, phones string, emails string, business_name string, technologies string, city string")
    assert contacts.search(df, "gol").count() == 2 and contacts.search(df, "gol", "wordp", "t").count() == 1 and contacts.search(df).count() == 3
    e = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "id int, external boolean").withColumns({"crawlable": F.lit(True), "source_url": F.lit("a"), "target_url": F.lit("b"), "target_domain": F.lit("c")})
    assert [r["id"] for r in links.page_of(links.search_links(e, "", True), 2, 2, F.col("id").desc()).collect()] == [4, 2]


RICH = """<html><head><title>Nur Foods | Home</title><script type="application/ld+json">{"@type": "Store", "telephone": "+98 21 8877 6655", "sameAs": ["https://t.me/nur"], "contactPoint": {"email": "ld@nur.ir"}}</script>
<script type="application/ld+json">{broken</script></head><body class="woocommerce"><p>تهران call 0912 345 6789</p><a href="tel:+989121112233">t</a><a href="mailto:Info@nur.ir?subject=x">m</a><a href="https://instagram.com/nur">i</a>
<address>Tehran, Bagh Street, No 12</address><a href="/contact">c</a><a href="https://other.ir/">o</a></body></html>"""


def test_extract(spark):
    from kavosh.operators import extract

    rows = extract.extract(spark.createDataFrame([("https://www.nur.ir/", RICH), ("https://x.ir/", "<p>nothing</p>"), ("https://y.ir/", None)], "url string, html string")).cache()
    got = {r["domain"]: r for r in rows.collect()}
    nur = got["nur.ir"]
    assert set(got) == {"nur.ir", "x.ir"}
    assert nur["phones"] == ["+98 21 8877 6655", "09121112233", "09123456789"] or nur["phones"] == ["02188776655", "09121112233", "09123456789"]
    assert nur["emails"] == ["info@nur.ir", "ld@nur.ir"] and nur["city"] == "تهران" and nur["business_name"] == "Nur Foods" and nur["address"] == "Tehran, Bagh Street, No 12"
    assert nur["quality_score"] == 1.0 and nur["evidence"]["tel_links"] == 1 and nur["evidence"]["mailto_links"] == 1 and [t["name"] for t in nur["technologies"]] == ["WooCommerce"]
    assert got["x.ir"]["phones"] == [] and got["x.ir"]["category"] == "عمومی"
    stored = extract.at_rest(rows)
    assert stored.filter("domain = 'nur.ir'").first()["emails"] == "info@nur.ir,ld@nur.ir"
    merged = {r["domain"]: r for r in contacts.merged_evidence(stored.unionByName(stored)).collect()}
    assert merged["nur.ir"]["tel_links"] == 2 and merged["nur.ir"]["pages"] == ["https://www.nur.ir/"] and merged["x.ir"]["field_sources"]["phones"] == []
    assert contacts.evidence_json(contacts.merged_evidence(stored)).count() == 2
    wide = {r["domain"]: r.asDict() for r in extract.wide_socials(stored).collect()}
    assert wide["nur.ir"]["social_instagram"] == "https://instagram.com/nur" and wide["x.ir"]["social_instagram"] == ""
    page = spark.createDataFrame([("https://www.nur.ir/", RICH)], "url string, html string")
    found = page.select(lite.lite_same_host_links(F.col("url"), F.col("html")), lite.lite_technologies(F.col("html")), jsonld.jsonld_links(jsonld.jsonld_blocks(F.col("html")))).first()
    assert found[0] == ["https://www.nur.ir/tel:+989121112233", "https://www.nur.ir/contact"] and found[1] == ["WooCommerce(0.56)"] and found[2] == ["https://t.me/nur"] and contacts.safe_name("a b!") == "a_b"


def test_evidence_keeps_every_page_and_source(spark):
    from kavosh.operators import extract

    rows = [
        ("x.ir", "u1", '{"phones": ["u1", "u2"], "address": "schema.org"}'), ("x.ir", "u3", '{"phones": ["u3"], "address": "address tag", "city": null}'), ("x.ir", "u2", None), ("x.ir", "u4", "{broken"), ("y.ir", None, "{}"),
        ("z.ir", "u5", '{"page": "p5", "field_sources": {"emails": ["p5"], "city": []}, "tel_links": 2, "technologies": ["React"]}'), ("z.ir", "u6", '{"field_sources": {"emails": ["p6"]}, "tel_links": 1}'),
    ]
    df = spark.createDataFrame(rows, "domain string, source_url string, evidence string")
    got = {}
    for r in sorted(extract.evidence_rows(contacts.merged_evidence(df, page="source_url")).collect()):
        got.setdefault((r["domain"], r["field"]), []).append((r["pos"], r["value"]))
    assert {k: [v for _, v in x] for k, x in got.items()} == {
        ("x.ir", "page"): ["u1", "u2", "u3", "u4"], ("x.ir", "phones"): ["u1", "u2", "u3"], ("x.ir", "address"): ["address tag", "schema.org"],
        ("z.ir", "page"): ["p5", "u6"], ("z.ir", "emails"): ["p5", "p6"], ("z.ir", "tel_links"): ["3"],
    }
    assert all([p for p, _ in x] == list(range(1, len(x) + 1)) for x in got.values())


def test_profiles_of_every_network(spark):
    from kavosh.operators import extract

    rows = [
        (1, "x.ir", "2024-01-01T00:00:00", '{"facebook": "f1", "linkedin": ["l1", "l2"], "aparat": "a1"}'), (2, "x.ir", "2024-02-01T00:00:00", '{"facebook": "f2", "linkedin": "l2", "twitter": " ", "youtube": null}'),
        (3, "y.ir", None, '["https://t.me/y"]'), (4, "y.ir", None, None), (5, "y.ir", None, "{}"),
    ]
    df = spark.createDataFrame(rows, "id int, domain string, crawled_at string, socials string")
    assert sorted(tuple(r) for r in extract.profile_rows(df).collect()) == [
        ("x.ir", "aparat", 1, "a1"), ("x.ir", "facebook", 1, "f2"), ("x.ir", "facebook", 2, "f1"), ("x.ir", "linkedin", 1, "l2"), ("x.ir", "linkedin", 2, "l1"),
    ]


def test_long_mailto_list(spark):
    from kavosh.operators import extract

    mails = [f"person{i}@long-host-name.ir" for i in range(200)]
    page = spark.createDataFrame([(f"<a href='MAILTO:{','.join(mails)}?subject=x'>m</a>",)], "html string")
    assert page.select(extract.linked(text.hrefs(F.col("html")), "mailto:")).first()[0] == [",".join(mails)]


OPS = "seq bigint, op string, url string, domain string, source_url string, reason string, at string"


def simulated(log, state=None):
    """What a log does to states, one operation after the other; and which reservations were granted."""
    state, granted = {u: dict(x) for u, x in (state or {}).items()}, {}
    for seq, op, url, domain, source, reason, at in log:
        row = state.get(url)
        if op == "reset":
            for x in state.values():
                x["status"] = "retry_pending" if x["status"] == "failed" else x["status"]
        elif op == "reserve":
            granted[seq] = row is None or row["status"] == "retry_pending"
            if row is None:
                state[url] = {"domain": domain, "status": "queued", "source_url": source, "first_seen": at, "crawled_at": None, "failure_reason": None}
        elif op == "reserve_seed":
            state[url] = {"domain": domain, "status": "queued", "source_url": source, "first_seen": at, "crawled_at": None, "failure_reason": row and row["failure_reason"]}
        elif row is not None and op == "crawled":
            row.update(status="crawled", crawled_at=at, failure_reason=None)
        elif row is not None:
            row.update(status="failed", failure_reason=(reason or "").strip() or None)
    return state, granted


def test_url_states_against_simulation(spark):
    rng, log = random.Random(8), []
    for seq in range(600):
        op = rng.choice(["reserve", "reserve", "reserve_seed", "crawled", "failed", "failed", "reset"])
        url = rng.choice(["hot", "hot", *map(str, range(40))])
        log.append((seq, "reset", None, None, None, None, None) if op == "reset" else (seq, op, url, f"d{seq}", f"s{seq}", rng.choice([None, " ", "robots.txt"]), f"2024-01-01T00:{seq // 60:02d}:{seq % 60:02d}"))
    ops = spark.createDataFrame(log, OPS)
    want, granted = simulated(log)
    key = lambda df: {r["url"]: {c: r[c] for c in ("domain", "status", "source_url", "first_seen", "crawled_at", "failure_reason")} for r in df.collect()}
    assert key(frontier.url_states(ops)) == want and {r["seq"]: r["granted"] for r in frontier.reservations(ops).collect()} == granted
    half, _ = simulated(log[:300])
    known = frontier.url_states(ops.filter("seq < 300"))
    assert key(known) == half and key(frontier.url_states(ops.filter("seq >= 300"), known)) == want
    assert frontier.url_states(ops.limit(0)).count() == 0 and key(frontier.url_states(ops.limit(0), known)) == half
    taken = frontier.admitted(spark.createDataFrame([(1, "https://x.ir/a", False), (2, "https://x.ir/a", False), (3, "https://x.ir/b", True), (4, "https://www.x.ir/c", False), (5, "https://y.ir/", False)], "seq int, url string, seed boolean"), spark.createDataFrame([("https://x.ir/b", "crawled"), ("https://y.ir/", "failed"), ("https://x.ir/a", "retry_pending")], "url string, status string"), 2)
    assert {(r["url"], r["place"]) for r in taken.collect()} == {("https://x.ir/a", 1), ("https://x.ir/b", 2)}
    failed = frontier.failure_ops(spark.createDataFrame([(1, "u", "IgnoreRequest", "Forbidden by robots.txt", "t"), (2, "v", "TimeoutError", None, "t")], "seq int, url string, error string, message string, at string"))
    assert [r["reason"] for r in failed.orderBy("seq").collect()] == ["robots.txt", "TimeoutError"]


def test_layered_crawl(spark):
    empty = spark.createDataFrame([], "seed_url string, url string, depth int, status string, source_url string, first_seen string, crawled_at string")
    states = spark.createDataFrame([("known", "crawled")], "url string, status string")
    found = "seed_url string, url string, depth int, source_url string, first_seen string"
    state = frontier.queue_layered(empty, spark.createDataFrame([("s", "s", 0, None, "1"), ("s", "a", 1, "s", "2"), ("s", "b", 1, "s", "3"), ("s", "deep", 2, "a", "4"), ("s", "known", 1, "s", "5"), ("s", "a", -3, None, "6")], found), states)
    rows = lambda df: {r["url"]: (r["depth"], r["status"]) for r in df.collect()}
    assert rows(state) == {"s": (0, "pending"), "a": (0, "pending"), "b": (1, "pending"), "deep": (2, "pending"), "known": (1, "crawled")}
    state = frontier.mark_layered(state, spark.createDataFrame([("s",), ("a",)], "url string"), "crawled", "t")
    assert [r["url"] for r in frontier.next_layered_batch(state).collect()] == ["b"]
    state = frontier.mark_layered(state, spark.createDataFrame([("s", "b")], "seed_url string, url string"), "queued")
    assert frontier.next_layered_batch(state).count() == 0  # the layer is still at work
    lost = frontier.reconcile_layered(state, spark.createDataFrame([], "seed_url string, url string"), states)
    assert rows(lost)["b"] == (1, "pending") and rows(frontier.reconcile_layered(state, spark.createDataFrame([("s", "b")], "seed_url string, url string"), states))["b"] == (1, "queued")
    assert rows(frontier.mark_layered(state, spark.createDataFrame([("b",)], "url string"), "failed"))["b"] == (1, "failed")
    edges = spark.createDataFrame([("s", "deep", True, "9"), ("a", "new", True, "9"), ("a", "known", True, "9"), ("a", "no", False, "9"), ("b", "later", True, "9")], "source_url string, target_url string, crawlable boolean, first_seen string")
    assert rows(frontier.advance_layered(state, edges, states)) == rows(state) | {"deep": (1, "pending"), "new": (1, "pending")}
    again = {r["url"]: tuple(r) for r in frontier.queue_layered(state, spark.createDataFrame([("s", "s", 0, "x", "7")], found), states).collect()}
    assert again["s"] == ("s", "s", 0, "pending", "x", "7", None)


def test_reduced_queue(spark):
    queue = spark.createDataFrame([(1, "a", "x.ir", 0, "pending"), (2, "b", "x.ir", 2, "pending"), (3, "c", "x.ir", 1, "pending"), (4, "d", "x.ir", 0, "done")], "id bigint, url string, domain string, depth int, status string")
    assert [r["url"] for r in frontier.lite_jobs(queue, 2).collect()] == ["a", "b"]
    links_ = spark.createDataFrame([("a", "e", "x.ir"), ("c", "e", "x.ir"), ("b", "f", "x.ir"), ("a", "d", "x.ir"), ("a", "e", "x.ir")], "source_url string, url string, domain string")
    got = {r["url"]: (r["depth"], r["status"]) for r in frontier.lite_step(queue, spark.createDataFrame([("a", True), ("b", True), ("c", False)], "url string, ok boolean"), links_).collect()}
    assert got == {"a": (0, "done"), "b": (2, "done"), "c": (1, "error"), "d": (0, "done"), "e": (1, "pending")}


def test_stored_edges_and_evidence(spark):
    schema = "source_url string, target_url string, target_domain string, external boolean, crawlable boolean, link_type string, first_seen string"
    stored, batch = spark.createDataFrame([("s", "t", "d", True, False, "script", "2025")], schema), spark.createDataFrame([("s", "t", "e", True, True, "anchor", "2024"), ("s", "t", "e", True, True, "script", "2024"), ("s", "u", None, None, None, None, None)], schema)
    got = {r["target_url"]: r for r in links.merged_links(stored, batch).collect()}
    assert (got["t"]["link_type"], got["t"]["crawlable"], got["t"]["target_domain"], got["t"]["first_seen"]) == ("script,anchor", True, "d", "2025") and got["u"]["link_type"] == ""
    e = "domain string, technology string, confidence double, evidence_count int, source_url string, first_seen string, last_seen string"
    row = contacts.merged_technologies(spark.createDataFrame([("x", "T", 0.5, 2, "u", "2025", "2025")], e), spark.createDataFrame([("x", "T", 0.9, 3, "v", "2024", "2026"), (" ", "T", 1.0, 1, "v", "1", "1")], e)).collect()
    assert [tuple(r) for r in row] == [("x", "T", 0.9, 5, "u", "2025", "2026")]
    urls = spark.createDataFrame([(1, "t", "failed", "robots.txt", "1"), (2, "u", "retry_pending", "x", "1"), (3, "v", "queued", None, "1"), (4, "v", "crawled", None, "2"), (5, "w", "blocked", None, "1")], "url_id int, url string, status string, failure_reason string, first_seen string")
    edges = spark.createDataFrame([("s", x, "d", True, x != "z", "anchor", "1") for x in "tuvwxz"], schema)
    assert {r["target_url"]: r["crawl_status"] for r in links.link_list(edges, urls).collect()} == {"t": "ROBOTS_BLOCKED", "u": "RETRY_PENDING", "v": "CRAWLED", "w": "DISCOVERED", "x": "DISCOVERED", "z": "NON_CRAWLABLE"}
    assert {r["target_url"] for r in links.next_batch(edges, urls).collect()} == {"u", "x"}
    shown = links.with_totals(edges, 2, 4, F.col("target_url")).collect()
    assert [(r["target_url"], r["total"], r["total_pages"]) for r in shown] == [("x", 6, 2), ("z", 6, 2)] and [links.crawlable_flag(x) for x in (None, "", "all", "allowed", "denied")] == [None, None, None, True, False]


def test_tables_replaced_by_version(spark, tmp_path):
    schema = "id int, source_url string, target_url string, target_domain string, external boolean, crawlable boolean, link_type string, first_seen string"
    target = f"file://{tmp_path}/edges"
    sinks.upsert_links(target, spark.createDataFrame([(1, "s", "t", "d", True, False, "script", "1"), (2, "s", "u", "d", True, True, None, "2")], schema))
    sinks.upsert_links(target, spark.createDataFrame([(3, "s", "t", "d", True, True, "anchor", "0"), (4, "s", "u", "d", True, True, "anchor", "0")], schema))
    edges = sinks.current(spark, target)
    assert {(r["target_url"], r["link_type"], r["crawlable"], r["first_seen"]) for r in edges.collect()} == {("t", "script,anchor", True, "1"), ("u", "anchor", True, "2")}
    assert sinks.current(spark, f"file://{tmp_path}/none") is None
    evidence = "domain string, technology string, confidence double, evidence_count int, source_url string, first_seen string, last_seen string"
    for c in (0.5, 0.7):
        out = sinks.upsert_technologies(f"file://{tmp_path}/tech", spark.createDataFrame([("x", "T", c, 1, "u", "1", "2")], evidence))
    assert [(r["confidence"], r["evidence_count"]) for r in out.collect()] == [(0.7, 2)]
    urls = spark.createDataFrame([(1, "t", "failed", "robots.txt", "1")], "url_id int, url string, status string, failure_reason string, first_seen string")
    assert sinks.export_links(edges.withColumn("crawlable", F.lit(False)), urls, f"{tmp_path}/csv") == 2
    lines = [x for f in (tmp_path / "csv").glob("part*") for x in f.read_text("utf-8").splitlines() if x]
    assert lines[0].lstrip("\ufeff") == ",".join(links.LINK_COLUMNS) and any(x.startswith("s,t,d,true,false,") for x in lines)
    assert sinks.newest(spark, f"file://{tmp_path}", "csv").endswith("csv")


def fetched(url):
    if "bad" in url:
        raise TimeoutError("too slow")
    return {"status": 200, "html": f"<a href='{url}x'>x</a>", "headers": {"Server": ["a", "b"]}, "url": url + "end", "redirect_urls": [url + "mid"]}


def test_pages_as_a_data_source(spark):
    from kavosh.sources import pages

    pages.register(spark)
    rows = spark.read.format("kavosh_pages").options(urls=json.dumps(["https://a.ir/", "https://bad.ir/"]), fetcher="test_operators:fetched", partitionSize="1").load()
    got = {r["request_url"]: r for r in rows.collect()}
    assert got["https://a.ir/"]["headers"] == {"Server": "a"} and got["https://bad.ir/"]["error"] == "TimeoutError" and got["https://bad.ir/"]["html"] is None
    edges = {(r["source_url"], r["target_url"], r["link_type"]) for r in links.page_links(rows).collect()}
    assert edges == {("https://a.ir/end", "https://a.ir/x", "anchor"), ("https://a.ir/", "https://a.ir/mid", "redirect"), ("https://a.ir/mid", "https://a.ir/end", "redirect")}
    failed = frontier.failure_ops(rows.filter("error is not null").select(F.lit(1).alias("seq"), F.col("request_url").alias("url"), "error", "message", F.lit("t").alias("at")))
    assert failed.first()["reason"] == "TimeoutError"


def test_url_states_of_a_stream(spark, tmp_path):
    schema = "seq bigint, cycle bigint, op string, url string, domain string, source_url string, reason string, at string"
    log = [(1, 0, "reserve", "a", "d", "s", None, "t1"), (2, 0, "failed", "a", None, None, " robots.txt ", "t2"), (3, 0, "crawled", "b", None, None, None, "t3"), (4, 1, "reserve_seed", "b", "d", None, None, "t4"), (5, 1, "reserve", "a", "d", "z", None, "t5"), (6, 1, "crawled", "a", None, None, None, "t6")]
    folder = str(tmp_path / "ops")
    for part in (log[:3], log[3:5], log[5:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken in order of their times
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = flows.url_states(flows.files(spark, folder, spark.createDataFrame([], schema))).writeStream.outputMode("update").format("memory").queryName("url_states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.unset(provider)
    seen = [(r["url"], r["status"], r["crawled_at"], r["failure_reason"]) for r in spark.table("url_states").collect()]
    assert set(seen) == {("a", "failed", None, "robots.txt"), ("b", "queued", None, None), ("a", "retry_pending", None, "robots.txt"), ("a", "crawled", "t6", None)}


def test_sql_functions(spark):
    from kavosh.functions import phones, sql, urls

    assert "kavosh_phone" in sql.register(spark)
    raw = ["+98 912 345 6789", "۰۲۱۱۲۳۴۵۶۷۸", "12", None, "9123456789"]
    df = spark.createDataFrame([(x, f"https://www.X.ir:80/{x}") for x in raw], "x string, u string")
    got = df.select(F.expr("kavosh_phone(x)"), F.expr("kavosh_phone_kind(x)"), F.expr("kavosh_site_key(u)"), phones.normalize_iranian(F.col("x")), phones.classify_phone(F.col("x")), urls.site_key(F.col("u"))).collect()
    assert all(tuple(r)[:3] == tuple(r)[3:] for r in got)


def test_panel(spark):
    rows = [(1, "X.ir", "u1", "09121111111, 02112345678", "a@x.ir", "Acme", "c1", "q1", "WordPress", "2024-01-02T10:11:12"), (2, "x.ir ", "u2", "09351112233,09121111111", None, None, "c2", " ", "jQuery; WordPress", "2024-01-03T00:00:00"), (3, None, "u", "1", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, domain string, source_url string, phones string, emails string, business_name string, category string, city string, technologies string, crawled_at string")
    r = contacts.panel_sites(df).first()
    assert (r["site"], r["mobiles"], r["landlines"], r["technologies"], r["city"], r["category"], r["source_url"]) == ("x.ir", "09121111111,09351112233", "02112345678", "WordPress; jQuery", "q1", "c2", "u1")
    page = contacts.panel_page(df, tech="wordp", page=1).first()
    assert (page["total"], page["total_pages"]) == (1, 1) and contacts.panel_page(df, q="nothing").count() == 0
    shown = contacts.shown(contacts.panel_sites(df)).first()
    assert shown["crawled_at"] == "2024-01-03T00:00" and shown["phones"] == "09121111111, 02112345678, 09351112233"
    e = spark.createDataFrame([("s", "https://x.ir/contact", "anchor"), ("s", "https://x.ir/a.js", "script"), ("s", "https://x.com/", "anchor"), ("s", "https://t.me/a", "anchor")], "source_url string, target_url string, link_type string")
    assert [tuple(r) for r in links.scheduled(e).collect()] == [("s", "https://x.ir/contact", 30)]
    assert [r[0] for r in spark.createDataFrame([("seed", "u"), ("page", "https://x.ir/about")], "k string, u string").select(links.request_priority(F.col("k"), F.col("u"))).collect()] == [50, 28]


def test_spreadsheet(spark, tmp_path, monkeypatch):
    import xml.etree.ElementTree as tree
    import zipfile

    monkeypatch.setattr(sinks, "SHEET_ROWS", 3)
    df = spark.createDataFrame([("09121111111", "a<b>&c\x01"), ("021", None), ("x", "تهران")], "phone_1 string, title string").coalesce(1)
    assert sinks.write_xlsx(df, str(tmp_path / "a.xlsx")) == 3 and sinks.write_xlsx(df.limit(0), str(tmp_path / "b.xlsx")) == 0
    with zipfile.ZipFile(tmp_path / "a.xlsx") as book:
        sheets = [[["".join(c.itertext()) for c in row] for row in tree.fromstring(book.read(f"xl/worksheets/sheet{i}.xml"))[0]] for i in (1, 2)]
        assert all(tree.fromstring(book.read(n)) is not None for n in book.namelist())
    assert sheets == [[["phone_1", "title"], ["09121111111", "a<b>&c"], ["021", ""]], [["phone_1", "title"], ["x", "تهران"]]]
