import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import runs


def plain_runs(words, least=24, exponent=3):
    """For every period the longest stretches of equal words, then those of a smallest period."""
    n, out = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, length, q) for (s, length), q in out.items())


def plain_digest(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    shape = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *shape, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def periodic(rng):
    """Words of few kinds with planted repetitions, some of them nested."""
    words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(0, 80))]
    for _ in range(rng.randint(0, 4)):
        at = rng.randint(0, len(words))
        part = words[at : at + rng.randint(1, 9)] or [1]
        words[at:at] = part * rng.randint(1, 12)
    return words


def test_the_cover_meets_every_difference():
    for i in range(runs.MODULUS):
        for gap in range(runs.MODULUS):
            d = runs.SHIFTS[i, gap]
            assert (i + d) % runs.MODULUS in runs.COVER and (i + gap + d) % runs.MODULUS in runs.COVER


@pytest.mark.parametrize("kinds", [1, 2, 30])
def test_extensions(kinds):
    rng = np.random.default_rng(kinds)
    w = np.append(rng.integers(0, kinds, 150), kinds + 1)
    e = runs.Extensions(w)
    a, b = np.triu_indices(len(w), 1)
    want = [next((t for t in range(len(w)) if w[min(i + t, 150)] != w[min(j + t, 150)] or j + t >= 150), 0) for i, j in zip(a, b)]
    assert e.common(a, b).tolist() == want
    assert e.common(b, a).tolist() == want


@pytest.mark.parametrize("places", [5, 1 << 21])
def test_runs_of_many_documents(places, monkeypatch):
    monkeypatch.setattr(runs, "PLACES", places)
    rng = random.Random(places)
    for _ in range(20):
        texts = [periodic(rng) for _ in range(rng.randint(1, 12))]
        texts += [texts[0], []]
        for least, exponent in ((24, 3), (4, 2)):
            got = runs.runs_of([np.array(t, dtype=np.int64) for t in texts], least, exponent)
            assert [list(map(tuple, g.tolist())) for g in got] == [plain_runs(t, least, exponent) for t in texts]


def test_documents_with_odd_rows(spark, documents, empty, monkeypatch):
    monkeypatch.setattr(runs, "CHUNK", 500)
    rng = random.Random(3)
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    rows += [(1000 + i, " ".join(map(str, periodic(rng)))) for i in range(80)]
    rows += [(2000, "a " * 3000), (2001, " 　 x\ty\x0bz " * 40), (2001, " 　 x\ty\x0bz " * 40)]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit("clash"))
    changed = odd.withColumn("text", runs.planted(F.col("doc_id"), F.col("text")))
    got = [tuple(r) for r in runs.digest(runs.detect(changed)).collect()]
    assert sorted(got, key=str) == sorted((plain_digest(*r) for r in rows), key=str)
    assert sum(zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in rows) > 5
    assert runs.digest(runs.detect(empty)).count() == 0
