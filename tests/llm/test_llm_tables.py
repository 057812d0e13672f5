import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import htmlmain, sharding, topk, warc
from panelwright.llm.shared import opened, shared_folder


def test_shards_of_documents(documents, empty):
    rows = sharding.shard_documents(documents, 7).collect()
    texts = Counter((r.doc_id, 16 + len((r.text or "").encode()), zlib.crc32((r.text or "").encode())) for r in documents.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == texts
    slots, place, load = defaultdict(list), defaultdict(set), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
        place[r["size"], r.text_crc32].add(r.shard)
        assert r.law == "bytes" and 0 <= r.shard < 7 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for key, s in place.items() if key != (16, 0))  # null and empty look alike
    ordered = [r.doc_id or -1 for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if r.shard == 3]
    assert ordered == sorted(ordered)
    assert sharding.shard_documents(empty, 7).count() == 0


def plain_best_fit(sizes, capacity):
    room, placed = [], []
    for size in sizes:
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            b = min(fits)[1]
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= size
        placed.append(b)
    return placed


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_the_tightest_bin(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 100) for _ in range(300)), reverse=True)
    got = sharding.best_fit([(s, i) for i, s in enumerate(sizes)], 100)
    assert [got[i] for i in range(300)] == plain_best_fit(sizes, 100)
    most = max(got.values()) + 1
    assert sharding.best_fit([(s, i) for i, s in enumerate(sizes)], 100, most) == got
    assert sharding.best_fit([(s, i) for i, s in enumerate(sizes)], 100, most - 1) is None


def test_shards_are_even_beside_a_giant():
    rng = random.Random(1)
    items = [(10**6, "giant")] + [(rng.randint(1, 1000), i) for i in range(3000)]
    placed = sharding.into_shards(items, 10)
    load = Counter()
    for size, name in items:
        load[placed[name]] += size
    rest = [v for b, v in load.items() if b != placed["giant"]]
    assert load[placed["giant"]] == 10**6 and len(rest) == 9 and max(rest) - min(rest) <= 1000
    assert sharding.into_shards([], 3) == {} and len(set(sharding.into_shards([(5, "a"), (5, "b")], 4).values())) == 2


def test_top_k_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "TILE", 2)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 256]) for i in range(90)]
    rows += [(100, [0.1, 0.2]), (150, []), (151, None), (152, [1.0, None]), (153, [float("nan")]), (154, [float("inf")]), (None, [1.0] * 6)]
    rows += [(200, [0.01] * 6), (200, [0.01] * 6), (201, [4e7, 1.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, rank string").repartition(5)
    clean = frame.filter(topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.quantised(F.col("embedding"), 256).alias("w"))
    got = [tuple(r) for r in topk.top_k(clean, F.col("id") % 10 == 0, 5).collect()]
    usable = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for i, v in {i: v for i, v in usable if i % 10 == 0}.items():
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in usable if j != i))[:5]
        want += [(i, n, j, -s) for n, (s, j) in enumerate(scored, 1)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(clean.limit(0), F.col("id") % 10 == 0, 5).count() == 0


def test_top_k_sends_no_copies_of_the_queries_through_the_driver(spark):
    frame = spark.createDataFrame([(i, [i % 7, 0, i % 3]) for i in range(60)], "id long, w array<long>")
    found = topk.top_k(frame, F.col("id") % 10 == 0, 2, stripes=40)
    assert len(found.collect()) == 12
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_dense_and_thin_terms_give_the_same_scores():
    rng = np.random.default_rng(2)
    share = np.array([0.0, 0.02, 0.2, 0.25, 0.6, 1.0])
    table, queries = (rng.integers(1, 9, (n, 6)) * (rng.random((n, 6)) < share) for n in (200, 9))
    for kind in (np.float64, np.int64):
        assert (topk.scatter(queries, topk.postings(table, kind), 200, kind) == queries @ table.T).all()


def test_top_k_refuses_to_overflow(spark):
    frame = spark.createDataFrame([(0, [2**62]), (1, [2**62])], "id long, w array<long>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(frame, F.lit(True), 1).collect()


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 3}.example/{i}", "<p>%d</p>é" % rng.randint(0, 12) * rng.randint(1, 30), "x") for i in range(60)]
    rows += [(70, None, None, "x"), (71, "u\r\nv: w", "", "x"), (72, "http://h/1", "\r\n\r\nWARC/1.1\r\n\r\n", "x"), (73, "http://h/2", "z" * 300_000, "x")]
    rows += [(74, "http://h/3", "same", "x"), (74, "http://h/3", "same", "x"), (None, "http://h/4", "same", "x"), (None, "http://h/5", "alone", "x")]
    return spark.createDataFrame(rows, "page_id long, url string, html string, refers_to string").repartition(3)


def test_archives_round_trip(pages):
    rows = pages.collect()
    last = {}
    for r in rows:
        last.setdefault(r.html or "", []).append(-1 if r.page_id is None else r.page_id)
    want = []
    for r in rows:
        payload, top = (r.html or "").encode(), max(last[r.html or ""])
        again = top >= 0 and (r.page_id is None or r.page_id < top)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        want.append((r.page_id, len(payload), digest, "revisit" if again else "response", top if again else None))
    got = [tuple(r) for r in warc.archive_pages(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_small_payloads_are_never_revisits(pages):
    got = warc.archive_pages(pages, least_bytes=5).filter("payload_bytes < 5").collect()
    assert got and all(r.record_type == "response" for r in got)


def test_normaliser_gives_one_member_per_record(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 5000)
    monkeypatch.setattr(warc, "PIECE", 700)
    raw = warc.write_monolithic(warc.decide(pages), shared_folder(spark, "raw"))
    assert raw.count() > 3
    members = warc.normalise(raw, shared_folder(spark, "members"))
    index = warc.index_of(members)
    assert index.count() == pages.count() == members.agg(F.sum("n_records")).first()[0]
    payloads = warc.read_records(index, with_payload=True).filter("record_type = 'response'").collect()
    assert sorted({bytes(r.payload).decode() for r in payloads}) == sorted({r.html or "" for r in pages.collect()})
    one = raw.first().archive
    system, at = opened(one)
    with system.open_input_stream(at, compression=None) as stream:
        engine = zlib.decompressobj(31)
        engine.decompress(stream.read())
        assert engine.eof and not engine.unused_data  # a single stream


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a>menu</a></ul></nav><div id="cookieBanner">We use cookies</div>
<div class="content with-sidebar"><{0}><h1>Head &amp; line</h1><p>One <b>bo</b>ld&nbsp; &eacute;<br>two<p>Three <!-- no --> four
<div class="advert">buy</div><section class="comments"><p>nice</p></section><aside>more</aside><form><label>mail</label><input></form>
<p>Last {1}</{0}></div><div class="side-bar related">other</div><footer>&copy; 2020</footer></body></html>"""
MAIN = "Head & line One bold é two Three four Last "


@pytest.mark.parametrize("tag", ["article", "main", "div"])
def test_main_text_of_pages(spark, tag):
    rows = [(i, f"http://a.example/{i}", PAGE.format(tag, f"w{i}"), 1) for i in range(8)]
    rows += [(20, None, None, 1), (21, "x", "", 1), (22, "http://b.example", "plain  text &lt;b&gt;", 1), (0, rows[0][1], rows[0][2], 1)]
    rows.append((23, "http://a.example/cut", PAGE.format(tag, "")[: PAGE.format(tag, "").index("<p>Last")], 1))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = sorted(map(tuple, htmlmain.extract(frame).collect()))
    # without article or main, a heading that every page of the host has is the template's
    head = MAIN if tag != "div" else None
    for page_id, url, text, n_chars in got:
        assert n_chars == len(text)
        if page_id < 8 and head:
            assert text == head + f"w{page_id}"
        if page_id < 8 and not head:
            assert text.endswith(f"w{page_id}") and "buy" not in text and "menu" not in text
    texts = {r[0]: r[2] for r in got}
    assert texts[20] == texts[21] == "" and texts[22] == "plain text <b>"
    assert len(got) == len(rows)
    if head:
        assert texts[23] == "Head & line One bold é two Three four"
    assert htmlmain.extract(frame.limit(0)).count() == 0


def test_template_drops_constant_wording_and_link_slots(spark):
    body = "<body><div class=x><p>Welcome to our site</p></div><div class=y><a>one {0}</a> <a>two</a></div><div class=z><p>Story {0} is told.</p></div></body>"
    rows = [(i, f"http://c.example/{i}", body.format(i)) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in htmlmain.extract(frame).collect()} == {f"Story {i} is told." for i in range(6)}


@pytest.mark.parametrize("page", ["<", "<p", "<a href='", "<!--", "</", "<![CDATA[x & y", "<p>a<script>", "<ul><li>a<li>b</ul>c", "&#x110000; &bogus;"])
def test_broken_markup_does_not_crash(page):
    assert isinstance(htmlmain.main_text(page, set(), set(), set()), str)


def test_deep_nesting():
    page = "<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>end"
    assert htmlmain.main_text(page, set(), set(), set()) == "deep end"


def test_template_decides_on_pages_with_article(spark):
    body = (
        "<body><main><div class=lede><p>Lede {0} of it.</p></div><article><h1>Head {0}</h1><div class=x><p>Read it in our app</p></div>"
        "<p>Story {0} is told at length.</p><div class=y><a>one {0}</a> <a>two</a></div></article></main></body>"
    )
    rows = [(i, f"http://d.example/{i}", body.format(i)) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in htmlmain.extract(frame).collect():
        assert r.text == f"Lede {r.page_id} of it. Head {r.page_id} Story {r.page_id} is told at length."
    emptied = htmlmain.main_text(rows[3][2], set(), set(), set())
    assert "our app" in emptied and "one 3 two" in emptied


def test_names_only_rank_slots(spark):
    body = "<body><div class=social-studies><b>{0}</b></div><div class=z>Page {0:.1}</div><div class=ad>buy {0:.2}</div></body>"
    rows = [(i, f"http://e.example/{i}", body.format(f"{i} is a number of which much is to be told. " * 20)) for i in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in htmlmain.extract(frame).collect():
        assert r.text == (f"{r.page_id} is a number of which much is to be told. " * 20) + f"Page {r.page_id}"


def test_copies_are_not_template(spark):
    copy = "<body><div class=w><p>Once there was a copied page.</p><p>It had two paragraphs.</p></div></body>"
    text = "Once there was a copied page. It had two paragraphs."
    rows = [(i, f"http://f.example/{i}", copy) for i in range(6)] + [(5, "http://f.example/5", copy)]
    rows += [(i, f"http://g.example/{i}", copy) for i in range(6)]
    rows += [(i, f"http://g.example/{i}", f"<body><div class=w><p>Own text {i}.</p></div></body>") for i in range(6, 12)]
    near = "<body><div class=w><p>Once there was a copied page.</p><p>It had two paragraphs.</p><p>At {0}.</p></div></body>"
    rows += [(i, f"http://n.example/{i}", near.format(i)) for i in range(6)]
    got = htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    for r in got:
        if "n.example" in r.url:
            assert r.text == f"{text} At {r.page_id}."
        else:
            assert r.text == (text if r.page_id < 6 else f"Own text {r.page_id}.")


def test_each_layout_has_its_template(spark):
    body = (
        "<body><div class={0}><div class=x><p>Welcome to our {0} site</p></div><div class=y><a>one {1}</a> <a>two</a></div>"
        "<div class=z><p>Story {1} is told.</p></div></div></body>"
    )
    rows = [(i, f"http://l.example/{i}", body.format(("red", "green", "blue")[i % 3], i)) for i in range(18)]
    # the same elements in all layouts, other wording in each
    alike = "<body><div class=x><p>Welcome to our {0} site</p></div><div class=z><p>Story {1} is told.</p></div></body>"
    rows += [(i, f"http://k.example/{i}", alike.format(("red", "green", "blue")[i % 3], i)) for i in range(18)]
    # a line that a few articles share is no template
    quote = "<body><div class=z><p>Story {0} is told at some length.</p><p>{1}</p></div></body>"
    rows += [(i, f"http://q.example/{i}", quote.format(i, "So it goes." if i < 6 else f"End {i}.")) for i in range(18)]
    for r in htmlmain.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        story = f"Story {r.page_id} is told."
        if "q.example" in r.url:
            story = f"Story {r.page_id} is told at some length. " + ("So it goes." if r.page_id < 6 else f"End {r.page_id}.")
        assert r.text == story


@pytest.mark.parametrize("seed", range(4))
def test_classes_of_equal_sizes_fill_shards_as_single_items_do(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([0, 3, 7, 7, 20, rng.randint(1, 400)]) for _ in range(500)), reverse=True)
    for capacity in (401, 777, 2500):
        load, plain = Counter(), Counter()
        for size, b, count in sharding.best_fit_classes(sorted(Counter(sizes).items(), reverse=True), capacity):
            load[b] += size * count
        for size, b in zip(sizes, plain_best_fit(sizes, capacity)):
            plain[b] += size
        assert load == plain


def test_groups_of_one_size_and_a_hot_one(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT", 20)
    rows = [(f"k{i % 700}", 5) for i in range(700)] + [("hot", 5)] * 400 + [(None, 3)] * 2 + [("zero", 0)]
    df = spark.createDataFrame(rows, "name string, weight long").repartition(5)
    found = sharding.pack(df, "name", "weight", 6).collect()
    assert Counter((r.name, r.weight) for r in found) == Counter(rows)
    place, load, groups = defaultdict(set), Counter(), Counter()
    for r in found:
        place[r.name].add(r.shard)
        load[r.shard] += r.weight
    assert all(len(s) == 1 for s in place.values())
    for name, weight in rows:
        groups[name] += weight
    names = sharding.into_shards([(w, n) for n, w in groups.items()], 6)
    plain = Counter()
    for name, weight in groups.items():
        plain[names[name]] += weight
    assert sorted(load.values()) == sorted(plain.values())
