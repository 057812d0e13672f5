import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from panelwright.llm import simhash


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, budget):
    """Smallest id by links between all pairs."""
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= budget:
                parent[top(i)] = top(j)
    lowest = {}
    for i, (name, _) in enumerate(prints):
        if name is not None:
            lowest[top(i)] = min(lowest.get(top(i), name), name)
    return [lowest.get(top(i)) for i in range(len(prints))]


def test_hash_is_the_one_of_spark(spark):
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()
    assert row.h == simhash.signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def test_documents_against_all_pairs(documents, empty):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in documents.collect()]
    want = sorted(((n, p, c) for (n, p), c in zip(rows, plain_components(rows, 4))), key=str)
    got = simhash.near_duplicates(documents, 4, 4).select("doc_id", "fp", "component_id").collect()
    assert sorted(((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got), key=str) == want
    assert simhash.near_duplicates(empty, 4, 4).count() == 0


def clustered(n, seed):
    """Values of which many lie close together, and one crowd shares its first half."""
    rng = random.Random(seed)
    values = {rng.getrandbits(64) for _ in range(n // 3)}
    for base in list(values)[:20]:
        for _ in range(n // 60):
            values.add(base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 6))) % (1 << 64))
    crowd = rng.getrandbits(32) << 32
    values |= {crowd | rng.getrandbits(32) for _ in range(n // 3)}
    return np.array(sorted(values), dtype=np.uint64)


def same_parts(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def linked(values, budget, within=lambda a, b: True):
    names = plain_components([(i, int(v)) for i, v in enumerate(values)], budget)
    return names


@pytest.mark.parametrize("whole", [0, 3, 4, 5])
def test_trie_join_of_one_side(whole):
    values = clustered(600, whole)
    root = simhash.trie_join(values, None, 0, whole)
    assert same_parts(root.tolist(), linked(values, whole))


@pytest.mark.parametrize("leading", [1, 2, 3])
def test_pieces_of_all_tries(leading, monkeypatch):
    """Any four errors leave the leading pieces of some trie alone; each trie holds every bit once."""
    monkeypatch.setattr(simhash, "CELL", 2)
    orders, found = simhash.tries(4, {1: 1, 2: 1 << 15, 3: 1 << 40}[leading])
    assert found == leading
    rng = random.Random(leading)
    value = rng.getrandbits(64)
    for order in orders:
        assert sum(width for _, width in order) == 64
        moved = simhash.gathered(np.array([value], dtype=np.uint64), order)[0]
        assert bin(int(moved)).count("1") == bin(value).count("1")
    for _ in range(300):
        wrong = rng.sample(range(64), 4)
        hit = [[any(low <= w < low + width for w in wrong) for low, width in order[:leading]] for order in orders]
        assert not all(map(any, hit))


@pytest.mark.parametrize("depth", [1, 3])
def test_spark_links_with_crowded_cells(spark, monkeypatch, depth):
    monkeypatch.setattr(simhash, "CELL", 32)
    values = clustered(900 if depth == 1 else 120, 9)
    frame = spark.createDataFrame([(simhash.signed(int(v)),) for v in values], "fp long")
    found = simhash.links(frame, 4, len(values) if depth == 1 else 1 << 60).collect()
    place = {simhash.signed(int(v)): i for i, v in enumerate(values)}
    forest = simhash.Forest(len(values))
    forest.join(np.array([place[r.a] for r in found]), np.array([place[r.b] for r in found]))
    assert same_parts(forest.root.tolist(), linked(values, 4))


def test_frontier_in_portions(monkeypatch):
    monkeypatch.setattr(simhash, "FRONTIER", 7)
    values = clustered(200, 3)
    few = simhash.trie_join(values, None, 0, 4)
    monkeypatch.undo()
    assert same_parts(few.tolist(), simhash.trie_join(values, None, 0, 4).tolist())


def test_one_of_each_group_stays(documents):
    rows = documents.collect()
    names = plain_components([(r.doc_id, plain_fingerprint(r.text)) for r in rows], 4)
    want = sorted({r.doc_id for r, c in zip(rows, names) if r.doc_id == c and c is not None})
    kept = simhash.keep_one(documents, 4, 4)
    assert kept.columns == documents.columns
    assert sorted(r.doc_id for r in kept.filter(F.col("doc_id").isNotNull()).collect()) == want
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


def test_a_repeated_row_stays_once(spark):
    rows = spark.createDataFrame([(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "q w r t z u", "y")], "doc_id long, text string, __n string")
    kept = simhash.keep_one(rows, 4, 4)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2]
