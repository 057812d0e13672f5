"""Toxicity: a bidirectional gated recurrent network with attention pooling, over all windows.

A text is a sequence of words, and a word enters by itself (an embedding of its own if it is frequent) and by its
characters (embeddings of its character n-grams, pooled); both also carry how much more often
they stand in toxic documents of the sample than in others. Overlapping windows of words run
through the network, attention pools the states of a window, and the score of a text is that of
its highest window. Training knows documents only: of a toxic one, the window with the most evidence is
the positive example or, where its words tell nothing, the one that the network finds highest; of
a clean one, every drawn window is negative.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import gru
from panelwright.llm.langid import may_learn, remainder
from panelwright.llm.shared import releasing

WINDOW, STRIDE = 32, 16  # words of a window, and between the starts of windows
ROWS = 4096  # windows in work at once
HIDDEN, EMBEDDING = 8, 6
WORDS, GRAM_SLOTS = 1 << 13, 1 << 14  # most frequent words with an embedding of their own; hashed n-grams
GRAMS = (3, 4, 5)
DOCS = 3000  # documents of each label to learn from: a bounded sample
STEPS, BATCH, RATE = 160, 64, 0.01
ECHO = 0.25  # share of clean windows that repeat a few of their words
LOOKS = (20, 50, 80, 110, 140)  # steps at which the highest windows of clean documents are found anew
FOLDS = 4
KEPT_WORDS = 100_000  # words whose inputs a task remembers before it starts anew
PORTION = 1 << 18  # hashed n-grams that a tally holds before it sums them up
WORD = regex.compile(r"\w+")
SMOOTH = 4.0  # documents of prior weight at the share that chance would give
CHANCE = 5.0  # standard deviations above chance that a word or n-gram must be
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FILL = ""  # the word that fills up a short window


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of words with start and end marked, and whose they are."""
    codes = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    owners, hashes = [], []
    for n in GRAMS:
        count = max(0, len(codes) - n + 1)
        inside = owner[:count] == owner[n - 1 : n - 1 + count]
        h = np.full(count, n, dtype=np.uint64)
        for j in range(n):
            h = h * MULTIPLIER + codes[j : j + count]
        h = h[inside] * MULTIPLIER
        hashes.append(h ^ (h >> np.uint64(31)))
        owners.append(owner[:count][inside])
    owner, h = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(owner, kind="stable")
    return owner[order], h[order]


class Evidence:
    """Log-odds of words and n-grams that stand in toxic documents clearly more often than chance."""

    def __init__(self, documents: Iterable[list[str]], parts: Iterable[np.ndarray], toxic: Iterable[bool]) -> None:
        """documents: the distinct words of each; parts: the distinct hashes of their n-grams."""
        counted = Counted()
        for found, hashes, bad in zip(documents, parts, toxic):
            counted.add(found, hashes, bad)
        self._weigh([counted])

    @classmethod
    def summed(cls, portions: list[Counted]) -> Evidence:
        """What documents tell that were counted in portions."""
        made = cls.__new__(cls)
        made._weigh(portions)
        return made

    def _weigh(self, portions: list[Counted]) -> None:
        n = (sum(c.documents[False] for c in portions), sum(c.documents[True] for c in portions))
        clean_words, bad_words = Counter(), Counter()
        for c in portions:
            clean_words.update(c.words[False])
            bad_words.update(c.words[True])
        keys = list(bad_words)
        bad = np.array([bad_words[k] for k in keys], dtype=float)
        odds = log_odds(bad, np.array([clean_words[k] for k in keys], dtype=float), *n)
        self.words = {k: float(v) for k, v in zip(keys, odds) if v > 0}
        hashes, bad = together([c.grams[True] for c in portions])
        others, counts = together([c.grams[False] for c in portions])
        at = np.minimum(np.searchsorted(others, hashes), max(0, len(others) - 1))
        clean = np.where(others[at] == hashes, counts[at], 0) if len(others) else np.zeros(len(hashes))
        odds = log_odds(bad.astype(float), clean.astype(float), *n)
        self.hashes, self.odds = hashes[odds > 0], odds[odds > 0]

    def of(self, words: list[str], owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Two inputs per word: its own log-odds, and the highest of its n-grams."""
        out = np.zeros((len(words), 2), dtype=np.float32)
        out[:, 0] = [self.words.get(w, 0.0) for w in words]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            np.maximum.at(out[:, 1], owner, np.where(self.hashes[at] == hashes, self.odds[at], 0).astype(np.float32))
        return out


class Counted:
    """By label, the number of documents, and of those that hold a word or a hashed n-gram."""

    def __init__(self) -> None:
        self.documents = [0, 0]
        self.words: tuple[Counter, Counter] = (Counter(), Counter())
        self.grams = (Tally(), Tally())

    def add(self, words: list[str], hashes: np.ndarray, toxic: bool) -> None:
        self.documents[toxic] += 1
        self.words[toxic].update(words)
        self.grams[toxic].add(hashes)


class Tally:
    """Counts of 64-bit numbers, summed up in bounded portions."""

    def __init__(self) -> None:
        self.keys, self.counts, self.open, self.size = np.empty(0, np.uint64), np.empty(0, np.int32), [], 0

    def add(self, keys: np.ndarray) -> None:
        self.open.append(keys)
        self.size += len(keys)
        if self.size > PORTION:
            self.total()

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        if self.open:
            self.keys, self.counts = merged([self.keys, *self.open], [self.counts, np.ones(self.size, np.int32)])
            self.open, self.size = [], 0
        return self.keys, self.counts


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def together(tallies: list[Tally]) -> tuple[np.ndarray, np.ndarray]:
    totals = [t.total() for t in tallies]
    return totals[0] if len(totals) == 1 else merged(*map(list, zip(*totals)))


def log_odds(bad: np.ndarray, clean: np.ndarray, n_clean: int, n_bad: int) -> np.ndarray:
    """Smoothed log of the ratio of shares, scaled to 0..2; 0 unless far above chance."""
    total = max(1, n_clean + n_bad)
    expected = (bad + clean) * n_bad / total
    z = (bad - expected) / np.sqrt(expected * max(n_clean, 1) / total + 1e-9)
    share = (bad + clean) / total
    ratio = (bad + SMOOTH * share) / (n_bad + SMOOTH) * (n_clean + SMOOTH) / (clean + SMOOTH * share)
    return np.where((z >= CHANCE) & (bad >= 3), np.clip(np.log(np.maximum(ratio, 1.0)), 0, 6) / 3, 0.0)


class Model:
    def __init__(self, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.inputs = 2 + 2 * EMBEDDING
        w = {
            "words": (rng.normal(size=(WORDS, EMBEDDING)) * 0.01).astype(np.float32),
            "grams": (rng.normal(size=(GRAM_SLOTS, EMBEDDING)) * 0.01).astype(np.float32),
        }
        for side in ("ahead", "back"):
            layer = gru.initial(rng, self.inputs, HIDDEN)
            w |= {f"{side}_in": layer["table"], f"{side}_gates": layer["gates"], f"{side}_state": layer["state"]}
            w[f"{side}_shift"] = np.zeros(3 * HIDDEN, dtype=np.float32)
        w["look"] = (rng.normal(size=2 * HIDDEN) * 0.3).astype(np.float32)
        w["out"] = (rng.normal(size=2 * HIDDEN) * 0.3).astype(np.float32)
        w["bias"] = np.array([-1.0], dtype=np.float32)
        self.weights = w
        self.evidence = Evidence([], [], [])
        self.vocabulary: dict[str, int] = {}  # rows of the words' embeddings; 0 is for all others
        self.forget()

    def forget(self) -> None:
        """Drop the remembered inputs of words."""
        self.known: dict[str, int] = {}
        self.rows: dict[str, np.ndarray] = {side: np.empty((0, 3 * HIDDEN), dtype=np.float32) for side in ("ahead", "back")}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.forget()

    def features(self, words: list[str], evidence: Evidence) -> tuple[np.ndarray, tuple]:
        """Inputs (words, D), and the slots that they come from."""
        w = self.weights
        owner, hashes = grams(words)
        flat = (hashes % np.uint64(GRAM_SLOTS)).astype(np.int64)
        own = np.array([self.vocabulary.get(word, 0) for word in words], dtype=np.int64)
        sizes = np.bincount(owner, minlength=len(words))
        pooled = np.zeros((len(words), EMBEDDING), dtype=w["grams"].dtype)
        some = np.flatnonzero(sizes)
        if len(some):
            first = np.cumsum(sizes) - sizes
            pooled[some] = np.add.reduceat(w["grams"][flat], first[some], axis=0) / sizes[some, None]
        told = evidence.of(words, owner, hashes)
        return np.concatenate([told, w["words"][own], pooled], axis=1).astype(np.float32), (own, flat, sizes)

    def table(self, features: np.ndarray, side: str) -> np.ndarray:
        return features @ self.weights[f"{side}_in"] + self.weights[f"{side}_shift"]

    def windows(self, x: np.ndarray, filled: np.ndarray, tables: dict[str, np.ndarray], saved: dict | None = None) -> np.ndarray:
        """Logit of each window: x (T, N) are rows of the tables, filled (N) the words that count."""
        w = self.weights
        keep = saved if saved is not None else {"ahead": None, "back": None}
        ahead = gru.forward(tables["ahead"], w["ahead_gates"], w["ahead_state"], x, keep["ahead"])
        back = gru.forward(tables["back"], w["back_gates"], w["back_state"], x[::-1], keep["back"])[::-1]
        states = np.concatenate([ahead, back], axis=2)
        looks = states @ w["look"]
        looks = np.where(np.arange(len(x))[:, None] < filled, looks, -1e9)
        looks = np.exp(looks - looks.max(axis=0))
        looks /= looks.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", looks, states)
        if saved is not None:
            saved["states"], saved["looks"], saved["pooled"] = states, looks, pooled
        return pooled @ w["out"] + w["bias"][0]

    def gradients(self, x, filled, words: list[str], evidence: Evidence, target, weight) -> tuple[float, dict]:
        """Weighted log loss of windows over the given words, and its gradients, through time."""
        w = self.weights
        features, (own, flat, sizes) = self.features(words, evidence)
        tables = {side: self.table(features, side) for side in ("ahead", "back")}
        saved: dict = {"ahead": [], "back": []}
        logit = self.windows(x, filled, tables, saved)
        p = 1 / (1 + np.exp(-logit))
        loss = float(-(weight * np.log(np.where(target > 0, p, 1 - p) + 1e-9)).sum())
        d = ((p - target) * weight).astype(np.float32)
        states, looks, pooled = saved["states"], saved["looks"], saved["pooled"]
        grads = {"out": pooled.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
        d_pooled = d[:, None] * w["out"]
        d_looks = looks * (np.einsum("nh,tnh->tn", d_pooled, states) - (d_pooled * pooled).sum(axis=1))
        grads["look"] = np.einsum("tn,tnh->h", d_looks, states)
        d_states = looks[..., None] * d_pooled + d_looks[..., None] * w["look"]
        d_features = np.zeros_like(features)
        for side, part, symbols in (("ahead", d_states[..., :HIDDEN], x), ("back", d_states[::-1, :, HIDDEN:], x[::-1])):
            rows, grads[f"{side}_gates"], grads[f"{side}_state"] = gru.backward(
                w[f"{side}_gates"], w[f"{side}_state"], saved[side], part
            )
            d_table = gru.gathered(len(words), symbols, rows)
            grads[f"{side}_in"], grads[f"{side}_shift"] = features.T @ d_table, d_table.sum(axis=0)
            d_features += d_table @ w[f"{side}_in"].T
        grads["words"], grads["grams"] = np.zeros_like(w["words"]), np.zeros_like(w["grams"])
        np.add.at(grads["words"], own, d_features[:, 2 : 2 + EMBEDDING])
        np.add.at(grads["grams"], flat, np.repeat(d_features[:, 2 + EMBEDDING :] / np.maximum(sizes, 1)[:, None], sizes, axis=0))
        return loss, grads

    def train(self, texts: list[str], toxic: list[bool], steps: int = STEPS, rate: float = RATE, seed: int = 2) -> None:
        """Evidence that a document is shown comes from the other folds of the sample.

        A toxic document shows its hottest window; one without any evidence in it shows the one that
        the network found highest when it last looked, from the first look on. A clean one shows
        its hottest, the one found highest, or any other.
        """
        rng = np.random.default_rng(seed)
        names: dict[str, str] = {}  # one object for each word, however often it stands
        split = [[names.setdefault(w, w) for w in tokens(t)] for t in texts]
        fold = np.array([xxhash.xxh64_intdigest(t.encode("utf-8"), 3) % FOLDS for t in texts])
        seen = [sorted(set(words)) for words in split]
        counted = [Counted() for _ in range(FOLDS)]
        for words, k, bad in zip(seen, fold, toxic):
            counted[k].add(words, np.unique(grams(words)[1]) if words else np.empty(0, np.uint64), bool(bad))
        self.evidence = Evidence.summed(counted)
        often = sorted(Counter(w for words in seen for w in words).items(), key=lambda x: (-x[1], x[0]))
        self.vocabulary = {w: i for i, (w, n) in enumerate(often[: WORDS - 1], 1) if n >= 3}
        others = [Evidence.summed([c for j, c in enumerate(counted) if j != k]) for k in range(FOLDS)]
        del names, counted, often
        bags = [Bag(words) for words in split]
        groups: list[tuple[list, list]] = [([], []) for _ in range(FOLDS)]
        bare: list[list] = [[] for _ in range(FOLDS)]  # toxic without evidence
        for i, words in enumerate(seen):
            if words:
                odds = dict(zip(words, others[fold[i]].of(words, *grams(words)).sum(axis=1)))
                heat = np.array([sum(odds[w] for w in window) for window in bags[i]])
                to = groups[fold[i]][bool(toxic[i])] if heat.max() > 0 or not toxic[i] else bare[fold[i]]
                to.append([i, int(heat.argmax()), int(heat.argmax())])
        told = any(mine[1] for mine in groups)
        adam = gru.Adam(self.weights, rate)
        for step in range(steps):
            adam.rate = rate * (1 - step / steps) + rate * 0.05
            for mine, unsure, evidence in zip(groups, bare, others):
                if step in LOOKS:
                    self._look(bags, mine[0], evidence)
                if step in LOOKS or not (step or told):  # without any evidence the first look is at once
                    self._look(bags, unsure, evidence)
                    for row in unsure:
                        row[1] = row[2]
                    if step == (LOOKS[0] if told else 0):
                        mine[1].extend(unsure)
                if mine[0] and mine[1]:
                    adam.step(self._step(rng, bags, mine, evidence))
        self.forget()

    def _look(self, bags: list, rows: list, evidence: Evidence) -> None:
        """Note the window of each document that the network finds highest now."""
        best = np.full(len(rows), -np.inf)
        every = [(n, at) for n, (i, _, _) in enumerate(rows) for at in range(len(bags[i]))]
        for low in range(0, len(every), ROWS):
            part = every[low : low + ROWS]
            x, filled, words = batch([bags[rows[n][0]][at] for n, at in part])
            features, _ = self.features(words, evidence)
            logits = self.windows(x, filled, {side: self.table(features, side) for side in ("ahead", "back")})
            for (n, at), logit in zip(part, logits):
                if logit > best[n]:
                    best[n], rows[n][2] = logit, at

    def _step(self, rng: np.random.Generator, bags: list, mine: tuple[list, list], evidence: Evidence) -> dict:
        picked: list[tuple[list[str], bool]] = [([], False)]  # nothing said is nothing toxic
        for bad in (False, True):
            for n in rng.integers(len(mine[bad]), size=BATCH // 2):
                i, hottest, highest = mine[bad][n]
                drawn = rng.random()
                at = hottest if bad or drawn < 0.25 else highest if drawn < 0.75 else int(rng.integers(len(bags[i])))
                window = bags[i][at]
                if not bad and rng.random() < ECHO:  # a few words over and over, as junk has them
                    low = int(rng.integers(len(window)))
                    window = (window[low : low + int(rng.integers(1, 4))] * WINDOW)[:WINDOW]
                picked.append((window, bad))
        x, filled, words = batch([window for window, _ in picked])
        target = np.array([bad for _, bad in picked], dtype=np.float32)
        return self.gradients(x, filled, words, evidence, target, np.float32(1 / len(picked)))[1]

    def _numbers(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.known)
        if not new:
            return
        if len(self.known) + len(new) > KEPT_WORDS:
            self.forget()
            new = sorted(words)
        for low in range(0, len(new), 20_000):
            part = new[low : low + 20_000]
            features, _ = self.features(part, self.evidence)
            for side in ("ahead", "back"):
                self.rows[side] = np.concatenate([self.rows[side], self.table(features, side)])
            for w in part:
                self.known[w] = len(self.known)

    def scores(self, texts: list[str]) -> np.ndarray:
        """The highest window's probability for each whole text; a text without words is one empty window."""
        best = np.full(len(texts), -np.inf)
        low = 0
        while low < len(texts):
            high, count, split = low, 0, []
            while high < len(texts) and (not split or count < ROWS * STRIDE):
                split.append(tokens(texts[high]))
                count, high = count + len(split[-1]), high + 1
            self._numbers({w for words in split for w in words} | {FILL})
            known, fill = self.known, self.known[FILL]
            columns, owner, filled = [], [], []
            for i, words in enumerate(split, low):
                ids = np.fromiter((known[w] for w in words), dtype=np.int64, count=len(words))
                firsts = np.array(starts(len(ids)) or [0])
                ids = np.concatenate([ids, np.full(max(0, firsts[-1] + WINDOW - len(ids)), fill)])
                columns.append(ids[firsts[:, None] + np.arange(WINDOW)])
                owner.append(np.full(len(firsts), i))
                filled.append(np.maximum(np.minimum(len(words) - firsts, WINDOW), 1))
            columns, owner, filled = np.concatenate(columns), np.concatenate(owner), np.concatenate(filled)
            for at in range(0, len(columns), ROWS):
                part = np.ascontiguousarray(columns[at : at + ROWS].T)
                np.maximum.at(best, owner[at : at + ROWS], self.windows(part, filled[at : at + ROWS], self.rows))
            low = high
        return 1 / (1 + np.exp(-best))


def batch(windows: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows as columns of numbers of the words that are in them."""
    words = sorted({w for window in windows for w in window} | {FILL})
    number = {w: n for n, w in enumerate(words)}
    x = np.full((WINDOW, len(windows)), number[FILL])
    for n, window in enumerate(windows):
        x[: len(window), n] = [number[w] for w in window]
    return x, np.array([max(1, len(window)) for window in windows]), words


class Bag:
    """The windows of a text, cut when they are asked for."""

    def __init__(self, words: list[str]) -> None:
        self.words = words

    def __len__(self) -> int:
        return len(starts(len(self.words)))

    def __getitem__(self, at: int) -> list[str]:
        low = starts(len(self.words))[at]
        return self.words[low : low + WINDOW]


def starts(n: int) -> range:
    """Where the overlapping windows of n words begin; together they hold every word."""
    return range(0, max(1, n - WINDOW + STRIDE) if n else 0, STRIDE)


def fit(documents: DataFrame, labels: DataFrame, parts: int = 3, held: int = 1, docs: int = DOCS) -> Model:
    """Train on a bounded sample: at most about docs documents of each label, whole.

    The sample is drawn from the labels by a hash; its ids are few, so the texts are not shuffled
    to find theirs. Rows without doc_id, label or text take no part.
    """
    told = labels.filter(F.col("toxic").isNotNull()).select("doc_id", (F.col("toxic") == 1).alias("toxic"))
    told = told.filter(may_learn(F.col("doc_id"), parts, held)).groupBy("doc_id").agg(F.bool_or("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in told.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    share = F.when(F.col("toxic"), F.lit(min(1.0, docs / max(1, sizes.get(True, 0))))).otherwise(
        F.lit(min(1.0, docs / max(1, sizes.get(False, 0))))
    )
    lowest = told.filter(drawn < share).orderBy(drawn, "doc_id").limit(3 * docs)
    chosen = F.broadcast(lowest)  # bounded by the limit
    rows = documents.filter(F.col("text").isNotNull()).select("doc_id", "text").join(chosen, "doc_id")
    # Repeated doc_ids can make the texts many more than the ids.
    found = rows.select("toxic", "text").orderBy(F.xxhash64("text", "toxic")).limit(4 * docs).collect()
    found = sorted((bool(r["toxic"]), r["text"]) for r in found)
    model = Model()
    model.train([t for _, t in found], [bad for bad, _ in found])
    return model


def scorer(spark, model: Model):
    """A column function text -> score; null is scored as an empty text."""
    # Bounded by the sample and the hashed tables; with its code, as executors may have no copy of it.
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    @releasing
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = cloudpickle.loads(sent.value)
        for batch in batches:
            yield pd.Series(model.scores([t if isinstance(t, str) else "" for t in batch]))

    return score


def detect(documents: DataFrame, labels: DataFrame, threshold: float = 0.7, parts: int = 3, held: int = 1) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row.

    A null text is scored as an empty one. Without toxic or without other labels the untrained
    network tells too little to pass the threshold by more than chance. Rows without doc_id are
    not learned from and not held out. Repeated rows have equal results, an empty table none;
    other columns are not read.
    """
    score = scorer(documents.sparkSession, fit(documents, labels, parts, held))(F.col("text"))
    rows = documents.select("doc_id", F.coalesce(remainder(F.col("doc_id"), parts) == held, F.lit(False)).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Documents that score below the threshold, with all their columns."""
    score = scorer(documents.sparkSession, fit(documents, labels))(F.col("text"))
    return documents.filter(score < threshold)
