import hashlib
import random
import re

import pytest

from panelwright.llm import decontam
from panelwright.session import materialise

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, width):
    windows = {}
    for name, text in items:
        found = plain_words(text)
        if found and name is not None:
            for s in range(max(1, len(found) - width + 1)):
                windows.setdefault(tuple(found[s : s + width]), set()).add(str(name))
    out = []
    for name, text in docs:
        found, hit, ids = plain_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for s in range(len(found) - size + 1):
                if named := windows.get(tuple(found[s : s + size])):
                    ids |= named
                    hit |= set(range(s, s + size))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((name, len(found), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(found)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    pool = ["the", "of", "Ünd", "a1", "x"] * 4 + ["w%d" % i for i in range(200)]
    items = [(i, ". ".join(rng.choice(pool) for _ in range(rng.randint(1, 30)))) for i in range(25)]
    items += [(90, None), (91, ""), (92, "!!"), (None, items[3][1]), (1, items[1][1]), (2, "another text of item two"), (93, "solo")]
    docs = []
    for i in range(150):
        text = [rng.choice(pool) for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            found = (items[rng.randrange(25)][1] or "").split()
            low = rng.randrange(len(found))
            at = rng.randrange(len(text) + 1)
            text[at:at] = found[low : low + rng.randint(8, 30)]
        docs.append((i, " ".join(text).upper() if i % 7 == 0 else "\t".join(text)))
    docs += [(500, None), (501, ""), (502, " ; "), (None, items[0][1]), (503, items[5][1] * 1), (503, items[5][1] * 1)]
    docs.append((504, " ".join(["the of"] * 4000) + " " + items[7][1]))
    docs += [(600 + i, items[9][1]) for i in range(40)]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, words string").repartition(3)
    bench = spark.createDataFrame([(*b, 1) for b in items], "item_id long, text string, doc int")
    return docs, items, frame, bench


@pytest.mark.parametrize("width", [13, 4, 2])
def test_against_windows(case, width):
    docs, items, frame, bench = case
    got = decontam.contamination(frame, bench, width).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items, width)


def test_without_broadcasts(case, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    docs, items, frame, bench = case
    got = decontam.contamination(frame, bench).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, items, 13)


def test_empty_tables(case):
    docs, _, frame, bench = case
    assert decontam.contamination(frame.limit(0), bench).count() == 0
    got = decontam.contamination(frame, bench.limit(0)).collect()
    assert sorted(map(tuple, got), key=str) == plain(docs, [], 13)


def test_filter_keeps_columns_and_clean_rows(case):
    docs, items, frame, bench = case
    bad = {r[0] for r in plain(docs, items, 13) if r[5]}
    kept = decontam.keep_uncontaminated(frame, bench)
    assert kept.columns == frame.columns
    want = sorted((d[0] for d in docs if d[0] not in bad), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_proximity(spark, case):
    docs, _, frame, _ = case
    asked = spark.createDataFrame([("p", "w1"), ("p", "the"), ("q", "w2"), ("r", "w3"), ("r", "of"), ("r", "und")], "query string, term string")
    terms = asked.select("term").distinct()
    frequency = materialise(decontam.counts(frame, terms), "frequency")
    index = decontam.build_index(frame, terms)
    got = decontam.proximity(index, asked, frequency, 5)
    named = frame.select("doc_id", decontam.tag(frame.doc_id, frame.text).alias("doc")).distinct()
    rows = {(r["query"], r.doc_id, r.pos) for r in got.join(named, "doc").collect()}
    count = {r.term: r.n for r in frequency.collect()}
    want = set()
    for query, ts in (("p", ["w1", "the"]), ("q", ["w2"]), ("r", ["w3", "of", "und"])):
        rarest = min(ts, key=lambda t: (count[t], t))
        for name, text in docs:
            found = plain_words(text)
            for i, w in enumerate(found):
                near = found[max(0, i - 5) : i + 6]
                if w == rarest and all(t in near for t in ts):
                    want.add((query, name, i))
    assert rows == want


def test_no_python_in_the_plan(case):
    _, _, frame, bench = case
    plan = decontam.contamination(frame.select("doc_id", "text"), bench)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|MapIn", plan)
