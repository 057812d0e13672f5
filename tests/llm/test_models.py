import os
import random
import subprocess
import sys
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import gru, langid, toxicity


def plain_layer(table, gates, state, x):
    """One sequence, one unit at a time."""
    hidden = len(state)
    h, out = np.zeros(hidden), []
    for s in x:
        g = table[s].astype(float)
        a = g[: 2 * hidden] + h @ gates
        a = 0.5 + 0.5 * a / (1 + abs(a))
        z, r = a[:hidden], a[hidden:]
        c = g[2 * hidden :] + (r * h) @ state
        h = h + z * (c / (1 + abs(c)) - h)
        out.append(h)
    return np.array(out)


def test_layer_step_by_step():
    rng = np.random.default_rng(0)
    w = gru.initial(rng, 9, 4)
    x = rng.integers(0, 9, (7, 3))
    got = gru.forward(w["table"], w["gates"], w["state"], x)
    for n in range(3):
        assert np.allclose(got[:, n], plain_layer(w["table"], w["gates"], w["state"], x[:, n]), atol=1e-5)


def slopes(model, loss, names, step=1e-2):
    """Differences of the loss beside its gradients, at the largest gradient of each weight."""
    for k in model.weights:
        model.weights[k] = model.weights[k].astype(np.float64)
    _, grads = loss()
    for k in names:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        kept = model.weights[k][at]
        model.weights[k][at] = kept + step
        high, _ = loss()
        model.weights[k][at] = kept - step
        low, _ = loss()
        model.weights[k][at] = kept
        yield k, (high - low) / (2 * step), grads[k][at]


def test_gradients_of_language_network():
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], hidden=4)
    x, y = rng.integers(0, 256, (6, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    for k, want, got in slopes(model, lambda: model.gradients(x, y, np.ones((6, 5))), list(model.weights)):
        assert got == pytest.approx(want, rel=0.02, abs=1e-5), k


def test_gradients_of_toxicity_network():
    rng = np.random.default_rng(2)
    model, none = toxicity.Model(), toxicity.Evidence([], [], [])
    words, x = ["", "ab", "cde", "fghij"], rng.integers(0, 4, (6, 5))
    filled, y = np.array([6, 5, 4, 6, 1]), np.array([1, 0, 1, 0, 1.0])
    for k, want, got in slopes(model, lambda: model.gradients(x, filled, words, none, y, np.float32(0.2)), list(model.weights)):
        assert got == pytest.approx(want, rel=0.02, abs=1e-5), k


@pytest.mark.parametrize("size", [0, 1, 127, 128, 129, 256, 300])
def test_pieces_count_each_byte_once(size):
    text = bytes(range(97, 123)) * 20
    seen = b"".join(bytes(p[new:filled]) for p, new, filled in langid.cut(text[:size]))
    assert seen == text[:size]


def test_language_is_learned_and_held_out(spark, documents, empty, words, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 60)
    rows = {r.doc_id: r for r in langid.identify(documents, 4, 2).collect() if r.doc_id is not None}
    sure = [(i, r) for i, r in rows.items() if i < 120]
    right = sum(r.lang_pred == ("xx" if i % 2 else "yy") for i, r in sure)
    assert right >= 0.95 * len(sure)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    for i in (200, 201, 202, 203):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert langid.identify(empty).count() == 0
    nothing = documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(nothing).collect()} == {"und"}
    kept = langid.keep_identified(documents, 0.35)
    assert kept.columns == documents.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {200, 201, 202, 203} and set(range(120)) <= ids


def test_copies_do_not_fill_the_language_sample(spark, monkeypatch):
    taught = []
    monkeypatch.setattr(langid.Model, "train", lambda self, texts, langs: taught.append(list(zip(langs, texts))))
    rows = [(i, f"own text {i}", "xx" if i % 2 else "yy") for i in range(600)] + [(1000 + i, "copied text", "xx") for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (3, 5):
        langid.fit(frame.repartition(n), docs=80)
    assert taught[0] == taught[1] and len(set(taught[0])) == len(taught[0])
    assert [sum(lang == k for lang, _ in taught[0]) for k in ("xx", "yy")] == [40, 40]


def test_windows_hold_every_word():
    for n in range(1, 200):
        covered = {i for low in toxicity.starts(n) for i in range(low, min(n, low + toxicity.WINDOW))}
        assert covered == set(range(n))
        assert all(b - a == toxicity.STRIDE for a, b in zip(toxicity.starts(n), toxicity.starts(n)[1:]))


def test_grams_of_words():
    owner, hashes = toxicity.grams(["ab", "", "abc"])
    assert owner.tolist() == [0, 0, 0] + [2] * 6  # <ab ab> <ab> and <ab abc bc> <abc abc> <abc>
    assert len(set(hashes.tolist())) == 8  # "<ab" is shared
    assert len(toxicity.grams([])[0]) == 0


@pytest.fixture(scope="module")
def labelled(spark, words):
    rng = random.Random(6)
    one, _ = words
    bad = ["grumf", "zarkly", "plonk"]
    rows, labels = [], []
    for i in range(400):
        text = [rng.choice(one) for _ in range(rng.randint(10, 150))]
        toxic = i % 3 == 0
        for _ in range(3 * toxic):
            # a known word, or a new word on a known stem
            text.insert(rng.randrange(len(text)), rng.choice(bad) if i % 2 else "snorx" + rng.choice(one))
        rows.append((i, " ".join(text), "x"))
        labels.append((i, int(toxic), None))
    rows += [(900, None, "x"), (901, "", "x"), (None, "zarkly grumf plonk", "x"), (902, " ".join(one * 20) + " grumf zarkly plonk", "x")]
    labels += [(900, 1, 0), (901, 0, 0), (0, 1, 0), (None, 1, 0), (5, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int, quality int")


def test_toxicity_is_learned_and_held_out(labelled):
    docs, labels = labelled
    rows = {r.doc_id: r for r in toxicity.detect(docs, labels).collect()}
    held = [(i, r) for i, r in rows.items() if i is not None and i < 400 and r.held_out]
    assert len(held) > 80
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items() if i is not None)
    wrong = [i for i, r in held if r.predicted != (i % 3 == 0)]
    assert len(wrong) <= 0.05 * len(held)
    assert rows[902].predicted == 1  # the last window of a long text
    assert rows[None].predicted == 1 and not rows[None].held_out
    assert rows[900].score == rows[901].score and rows[901].predicted == 0
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if not r.predicted}


def test_toxic_documents_without_evidence_and_late_passages_are_shown(spark, words, monkeypatch):
    rng, shown, texts = random.Random(8), set(), []
    step, fit = toxicity.Model._step, toxicity.Model.train

    def spied(self, rng, bags, mine, evidence):
        shown.update(i for i, _, _ in mine[1])
        return step(self, rng, bags, mine, evidence)

    def noted(self, found, toxic):
        texts.extend(zip(found, toxic))
        fit(self, found, toxic)

    monkeypatch.setattr(toxicity.Model, "_step", spied)
    monkeypatch.setattr(toxicity.Model, "train", noted)
    rows = []
    for i in range(120):
        text = " ".join(rng.choice(words[0]) for _ in range(60))
        rows.append((i, text + " grumf plonk" * (i % 4 == 0), int(i % 2 == 0)))  # every second toxic one has no toxic word
    rows.append((200, " ".join(words[0] * 20) + " grumf plonk", 1))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), parts=1, held=1)
    assert {n for n, (_, toxic) in enumerate(texts) if toxic} == shown
    assert {t for t, _ in texts} == {t for _, t, _ in rows}


def test_toxicity_without_documents_or_labels(labelled):
    docs, labels = labelled
    assert toxicity.detect(docs.limit(0), labels).count() == 0
    assert toxicity.detect(docs, labels.limit(0)).filter("predicted = 1").count() == 0


def test_remembered_words_do_not_change_scores(monkeypatch):
    model = toxicity.Model()
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 120))) for _ in range(40)]
    whole = model.scores(texts)
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 5)
    monkeypatch.setattr(toxicity, "ROWS", 3)
    fresh = toxicity.Model()
    one_by_one = np.concatenate([fresh.scores([t]) for t in texts])
    assert np.allclose(whole, one_by_one, atol=1e-5)


def test_toxicity_model_travels_with_its_code(tmp_path):
    """The package is on the driver's path only: workers start elsewhere and cannot import it."""
    root = str(Path(__file__).resolve().parents[2])
    program = f"""
import sys
sys.path.insert(0, {root!r})
from panelwright.llm import toxicity
from panelwright.session import local_session
spark = local_session("2", memory="2g")
rows = spark.createDataFrame([(i, w) for i in range(40) for w in ("a nice day", "an awful brute")], "doc_id long, text string")
labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
print(toxicity.detect(rows, labels).filter("score between 0 and 1").count())
"""
    kept = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ended = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=kept, capture_output=True, text=True, timeout=300)
    assert ended.stdout.split()[-1:] == ["80"], ended.stderr[-2000:]


def test_toxicity_sample_takes_little_memory():
    """A word of the sample is one object, windows are cut when needed, n-grams of a document are not kept."""
    rng = np.random.default_rng(5)
    words = ["".join(chr(97 + c) for c in rng.integers(26, size=8)) for _ in range(2000)]
    texts = [" ".join(words[k] for k in rng.integers(2000, size=1500)) for _ in range(400)]
    tracemalloc.start()
    toxicity.Model().train(texts, [bool(n % 2) for n in range(400)], steps=0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 * 400 * 1500  # bytes a word


def test_toxicity_evidence_counted_in_portions():
    rng = np.random.default_rng(6)
    documents = [sorted({f"w{k}" for k in rng.integers(40, size=12)} | ({"bad"} if n % 3 == 0 else set())) for n in range(300)]
    parts = [np.unique(toxicity.grams(words)[1]) for words in documents]
    toxic = [n % 3 == 0 for n in range(300)]
    portions = [toxicity.Counted() for _ in range(4)]
    for n, (words, hashes) in enumerate(zip(documents, parts)):
        portions[n % 4].add(words, hashes, toxic[n])
    whole, summed = toxicity.Evidence(documents, parts, toxic), toxicity.Evidence.summed(portions)
    assert whole.words == summed.words and "bad" in whole.words
    assert np.array_equal(whole.hashes, summed.hashes) and np.array_equal(whole.odds, summed.odds) and len(whole.hashes)
