"""The registered queries at the smallest size, and the pipeline against its stages."""

import base64

import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from panelwright.llm.oracles import ORACLES
from panelwright.llm.queries import QUERIES
from panelwright.llm.queries import SHINGLE

SF = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert SHINGLE == 4


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_twin(spark, name):
    assert check.compare(spark, SF, name).startswith("ok")


def test_pipeline_by_hand(spark):
    """Each stage's rows follow from the operator run on all that the stage before kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns, name
        assert 0.6 * kept <= docs.count() <= kept, name
        kept = docs.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()))


def test_later_stages_against_plain_python(spark):
    """Near duplicates, decontamination and encoding by hand, on what the two models kept."""
    import hashlib

    import tiktoken
    from test_decontam import plain
    from test_dedup import plain_components, plain_fingerprint
    from test_encoding import PATTERN, RANKS, packed

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = stage(spark, docs, SF)
    docs = [(r.doc_id, r.text) for r in docs.collect()]
    parts = plain_components([(n, plain_fingerprint(t)) for n, t in docs], 4)
    assert len({n for n, _ in docs}) == len(docs) and None not in dict(docs)  # else rows stay by other rules
    firsts = [d for d, first in zip(docs, parts) if d[0] == first]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {row[0] for row in plain(firsts, items, 13) if row[-1]}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    known = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for name, text in firsts:
        if name not in bad:
            ids, text = known.encode_ordinary(text or ""), (text or "").encode()
            want.append((name, len(ids), hashlib.sha256(packed(ids)).hexdigest(), hashlib.sha256(text).hexdigest()))
    assert len(docs) > len(firsts) > len(want) > 0
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(want)
