"""Language ID: a bidirectional gated recurrent network over bytes.

The network labels every byte of a text. Texts are cut into pieces of a fixed length; the last
piece of a text ends with the text and so overlaps the one before, whose bytes count once. The
probabilities of the bytes that are part of letters are averaged over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm import gru
from panelwright.llm.shared import releasing

PIECE = 128  # bytes the network sees at once
ROWS = 2048  # pieces in work at once
HIDDEN = 8  # units of each direction
DOCS = 4000  # documents to learn from, shared evenly by the languages: a bounded sample
STEPS, BATCH, RATE = 400, 128, 0.02
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


class Model:
    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.weights = {f"{side}_{k}": v for side in ("ahead", "back") for k, v in gru.initial(rng, 256, hidden).items()}
        for side in ("ahead", "back"):
            self.weights[f"{side}_out"] = (rng.normal(size=(hidden, len(langs))) * 0.3).astype(np.float32)
        self.weights["bias"] = np.zeros(len(langs), dtype=np.float32)

    def _run(self, side: str, x: np.ndarray, saved: list | None = None) -> np.ndarray:
        w = self.weights
        return gru.forward(w[f"{side}_table"], w[f"{side}_gates"], w[f"{side}_state"], x, saved)

    def labels(self, x: np.ndarray, saved: dict | None = None) -> np.ndarray:
        """Probabilities (T, N, languages) of every byte of the pieces in the columns of x."""
        w = self.weights
        keep = {"ahead": None, "back": None} if saved is None else saved
        ahead, back = self._run("ahead", x, keep["ahead"]), self._run("back", x[::-1], keep["back"])[::-1]
        scores = ahead @ w["ahead_out"]
        scores += back @ w["back_out"]
        scores += w["bias"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores /= scores.sum(axis=2, keepdims=True)
        if saved is not None:
            saved["states"] = ahead, back
        return scores

    def gradients(self, x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of the bytes, by weight (T, N), and its gradients, through time."""
        w, saved = self.weights, {"ahead": [], "back": []}
        p = self.labels(x, saved)
        weight = (weight / max(weight.sum(), 1)).astype(np.float32)
        right = np.take_along_axis(p, np.broadcast_to(target[None, :, None], (*x.shape, 1)), axis=2)[..., 0]
        loss = float(-(np.log(right + 1e-12) * weight).sum())
        d = p
        d[:, np.arange(len(target)), target] -= 1
        d *= weight[..., None]
        flat = d.reshape(-1, d.shape[2])
        grads = {"bias": flat.sum(axis=0)}
        for side, states, symbols in (("ahead", saved["states"][0], x), ("back", saved["states"][1], x[::-1])):
            hidden = states.shape[2]
            grads[f"{side}_out"] = np.ascontiguousarray(states).reshape(-1, hidden).T @ flat
            d_states = d @ w[f"{side}_out"].T
            if side == "back":
                d_states = d_states[::-1]
            rows, d_gates, d_state = gru.backward(w[f"{side}_gates"], w[f"{side}_state"], saved[side], d_states)
            grads[f"{side}_table"] = gru.gathered(256, symbols, rows)
            grads[f"{side}_gates"], grads[f"{side}_state"] = d_gates, d_state
        return loss, grads

    def train(self, texts: list[bytes], langs: list[str], steps: int = STEPS, rate: float = RATE, seed: int = 2) -> None:
        """Cross-entropy at every letter, languages in equal shares, Adam with a falling rate.

        All pieces of the whole texts are learned from; a step draws texts evenly and then a piece of
        each, so that a very long text does not stand for its language.
        """
        rng = np.random.default_rng(seed)
        pieces, ends, of = [], [], []
        for text, lang in zip(texts, langs):
            if text:
                pieces.extend(part for part, _, _ in cut(text))
                ends.append(len(pieces))
                of.append(self.langs.index(lang))
        x, y, ends = np.stack(pieces), np.array(of), np.array(ends)
        starts = np.concatenate([[0], ends[:-1]])
        groups = [np.flatnonzero(y == i) for i in range(len(self.langs))]
        groups = [g for g in groups if len(g)]
        adam = gru.Adam(self.weights, rate)
        for step in range(steps):
            adam.rate = rate * (1 - step / steps) + rate * 0.05
            rows = np.concatenate([rng.choice(g, max(1, BATCH // len(groups))) for g in groups])
            part = np.ascontiguousarray(x[rng.integers(starts[rows], ends[rows])].T)
            _, grads = self.gradients(part, y[rows], IS_LETTER[part])
            adam.step(grads)

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities (texts, languages) over the letters of whole texts."""
        sums, counts = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts))
        pieces, owner, fresh, filled = [], [], [], []
        for i, text in enumerate(texts):
            for part, new, size in cut(text):
                pieces.append(part), owner.append(i), fresh.append(new), filled.append(size)
            if len(pieces) >= ROWS or i + 1 == len(texts):
                for low in range(0, len(pieces), ROWS):
                    high = low + ROWS
                    self._pool(np.stack(pieces[low:high]), np.array(owner[low:high]), fresh[low:high], filled[low:high], sums, counts)
                pieces, owner, fresh, filled = [], [], [], []
        return sums / np.maximum(counts, 1)[:, None]

    def _pool(self, x, owner, fresh, filled, sums, counts) -> None:
        x = np.ascontiguousarray(x.T)
        places = np.arange(PIECE)[:, None]
        weight = (IS_LETTER[x] & (places >= np.array(fresh)) & (places < np.array(filled))).astype(np.float32)
        np.add.at(sums, owner, np.einsum("tnl,tn->nl", self.labels(x), weight))
        np.add.at(counts, owner, weight.sum(axis=0))


def cut(text: bytes) -> Iterator[tuple[np.ndarray, int, int]]:
    """Pieces of a text: bytes, first byte not in an earlier piece, number of bytes of the text.

    A text shorter than a piece is filled up with spaces, which are not counted.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    if len(data) < PIECE:
        if len(data):
            yield np.concatenate([data, np.full(PIECE - len(data), 32, dtype=np.uint8)]), 0, len(data)
        return
    for low in range(0, len(data) - PIECE + 1, PIECE):
        yield data[low : low + PIECE], 0, PIECE
    if rest := len(data) % PIECE:
        yield data[-PIECE:], PIECE - rest, PIECE


def may_learn(doc_id: Column, parts: int, held: int) -> Column:
    """Rows to learn from; rows without doc_id are not."""
    return F.coalesce(remainder(doc_id, parts) != held, F.lit(False))


def remainder(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def fit(documents: DataFrame, parts: int = 4, held: int = 2, docs: int = DOCS) -> Model | None:
    """Train on a bounded sample: at most docs / languages documents of each, whole texts.

    Copies of a text in a language count once, both in the language's share and in the sample,
    which are the texts with the smallest hashes. None if no row may be learned from.
    """
    rows = documents.filter(may_learn(F.col("doc_id"), parts, held) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text", F.lit(11)).alias("mark"))
    texts = rows.select("lang", "mark").distinct()
    sizes = {r["lang"]: r["n"] for r in texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    want = max(1, docs // len(sizes))
    # A few more than wanted by share, so that few rows are ranked.
    share = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1.0, (want * 1.2 + 64) / n))])
    drawn = F.pmod("mark", F.lit(1 << 40))
    found = rows.filter(drawn / float(1 << 40) < F.element_at(share, F.col("lang")))
    found = found.groupBy("lang", "mark").agg(F.min("text").alias("text"))
    found = found.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(drawn, "mark")))
    found = sorted((r["lang"], r["text"]) for r in found.filter(F.col("nth") <= want).collect())
    model = Model(sorted(sizes))
    if len(sizes) > 1:
        model.train([t.encode("utf-8") for _, t in found], [lang for lang, _ in found])
    return model


def predictor(model: Model | None):
    """A column function text -> (lang, score): `und` and 0 for null or without letters."""

    @F.pandas_udf("lang string, score double")
    @releasing
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [i for i, t in enumerate(batch) if isinstance(t, str) and LETTER.search(t)]
            langs, scores = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            if good and model is not None:
                pooled = model.pooled([batch.iloc[i].encode("utf-8") for i in good])
                langs[good] = [model.langs[k] for k in pooled.argmax(axis=1)]
                scores[good] = np.clip(pooled.max(axis=1), 0, 1)
            yield pd.DataFrame({"lang": langs, "score": scores})

    return predict


def identify(documents: DataFrame, parts: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row.

    lang_pred is `und` with score 0 for a text that is null or has no letters, and for all if
    there is nothing to learn from; with one language to learn every other text has that one.
    Rows without doc_id are not learned from and not held out. Repeated rows have equal results,
    an empty table none; other columns are not read.
    """
    told = predictor(fit(documents, parts, held))(F.col("text"))
    rows = documents.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), told.alias("__told"))
    return rows.select("doc_id", "held_out", F.col("__told.lang").alias("lang_pred"), F.col("__told.score").alias("score"))


def keep_identified(documents: DataFrame, least: float) -> DataFrame:
    """Documents whose language is told with at least that score, with all their columns."""
    told = predictor(fit(documents))(F.col("text"))
    return documents.filter((told["lang"] != UNKNOWN) & (told["score"] >= least))
