import random
import re
from collections import Counter

import numpy as np
import pytest

from panelwright.llm import phrases


def plain_counts(rows):
    """Occurrences of all phrases and words per language."""
    out, n = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, 6):
                for i in range(len(words) - size + 1):
                    key = (lang, " ".join(words[i : i + size]))
                    out[key] = out.get(key, 0) + 1
    return out, n


def plain(rows, least, most):
    counts, n = plain_counts(rows)
    found = {k: a for k, a in counts.items() if a >= least}
    wide = {k: a for k, a in found.items() if " " in k[1]}
    ranked = {}
    for (lang, phrase), a in wide.items():
        words = phrase.split(" ")
        inside = any(
            k[0] == lang and 100 * b >= 100 * a and len(k[1].split(" ")) > len(words) and f" {phrase} " in f" {k[1]} "
            for k, b in wide.items()
        )
        if inside:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = found[lang, " ".join(words[:k])], found[lang, " ".join(words[k:])]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        ranked.setdefault(lang, []).append((-score, -a, phrase.encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, rows in ranked.items()
        for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])
    )


def table(seed, documents):
    rng = random.Random(seed)
    kinds = ["the", "The", "of", "and", "é", "x y", "new york city", "a b c d e f", "aa aa aa", "q　z", "\x00", "old"]
    rows = []
    for i in range(documents):
        text = "".join(rng.choice(kinds) + rng.choice([" ", " ", "\t", ", ", "\r\n", "!"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["en", "en", "de", None]), 0, "clash"))
    rows += [(1, rows[1][1], "en", 0, None), (None, None, "en", 0, None), (5, "", None, 0, None), (6, "new york city " * 2000, "und", 0, None)]
    return rows


SCHEMA = "doc_id long, text string, lang string, a long, phrase string"


@pytest.mark.parametrize("setting", ["plain", "no sample", "crowded filter", "small chunks"])
def test_against_plain_counts(spark, monkeypatch, setting):
    if setting == "no sample":  # every frequent phrase is a failure of the border at first
        monkeypatch.setattr(phrases, "LOWERED", 1e9)
    if setting == "crowded filter":
        monkeypatch.setattr(phrases.frequent, "__defaults__", (128,))
    if setting == "small chunks":
        monkeypatch.setattr(phrases, "CHUNK_BYTES", 300)
    rows = table(3, 150)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for least, most in ((20, 7), (60, 1000)):
        got = sorted(map(tuple, phrases.collocations(frame, least, most).collect()))
        assert got == plain([(r[2], r[1]) for r in rows], least, most)
        assert got


def test_all_frequent_phrases_are_counted_once(spark):
    rows = table(8, 60)
    got = phrases.frequent(spark.createDataFrame(rows, SCHEMA), 15).filter("size > 0").collect()
    counts, _ = plain_counts([(r[2], r[1]) for r in rows])
    assert sorted((r.lang, r.phrase, r.a) for r in got) == sorted((*k, a) for k, a in counts.items() if a >= 15)


def test_blocks_do_not_grow_with_the_tasks_that_add_them_up(spark, monkeypatch):
    rng = random.Random(2)
    rows = [("en", " ".join(f"w{rng.randint(0, 400)}" for _ in range(400))) for _ in range(10)]
    frame = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    held, add = [], phrases.added_up
    monkeypatch.setattr(phrases, "added_up", lambda blocks, tasks: held.append(blocks.count()) or add(blocks, tasks))
    everything = np.full(1 << 10, 2**64 - 1, dtype=np.uint64)
    counts, before = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for tasks in (2, 64):
            spark.conf.set("spark.sql.shuffle.partitions", tasks)
            counts.append(phrases.count_pass(frame, phrases.sent(frame, everything), None, False, 1).count())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert counts[0] == counts[1]
    assert held[0] == held[1]


def test_empty_tables(spark, documents, empty):
    assert phrases.collocations(empty, 2, 10).count() == 0
    assert phrases.collocations(documents, 10**9, 10).count() == 0


def test_hashes_agree_between_tables_and_texts():
    line = phrases.tokens([b"The quick, brown fox"])
    assert line == [b"the", b"quick", b".", b"brown", b"fox", b"."]
    single = phrases.word_hashes("en", line)
    assert phrases.phrase_hashes(["en"], ["brown fox"])[0] == phrases.longer_hash(single[3:4], single[4:5])[0]
    held = np.zeros(1 << 10, dtype=np.uint64)
    assert not phrases.holds(held, single).any() and phrases.holds(~held, single).all()


def test_products_beyond_64_bits(spark, monkeypatch):
    a, n = 10**11, 10**15
    found = [("en", 0, "", n), ("en", 1, "x", a + 1), ("en", 1, "y", a + 2), ("en", 2, "x y", a)]
    stored = spark.createDataFrame(found, "lang string, size int, phrase string, a long")
    monkeypatch.setattr(phrases, "frequent", lambda documents, least: stored)
    got = phrases.collocations(None, 100, 5).collect()
    assert [(r.l, r.r, r.score) for r in got] == [(a + 1, a + 2, 1000 * a * n // ((a + 1) * (a + 2)))]
