"""Operator 3: toxicity by a support vector machine on a subsequence string kernel, with Nyström landmarks.

The kernel of two words weighs their common subsequences of three characters by LAM to the length
they span, gaps included, up to SPAN; it is normalised and cubed. So an insult with characters put
in between, left out or changed still meets its landmark. Words are folded first: case, accents,
digits in place of letters, characters between letters, letters set apart by blanks. A sentence
meets a landmark with its nearest word. Sentences mapped through the landmarks' kernel matrix
(to the power -1/2) train a squared-hinge machine; as labels are of documents, a toxic document
gives its worst sentence, chosen again after each fit. A document's score is the logistic of its
worst sentence's margin and its length, fitted on the same documents.

The machine is fitted on the driver on at most SAMPLE labelled documents, those with the least hash
of their id, and of these on texts of at most LEARN_BYTES; every text is scored whole. Values of the kernel under LEAST count as 0.
Letters that do not decompose to a to z have OTHERS codes, by their code point: those of one alphabet, as Greek or Cyrillic,
mostly have a code each, those of large scripts share them.

Defined results: null and empty texts get the score of a text without a suspect word; very long texts are scored whole; without
labels of both kinds every score is 0; documents of tied hashes are sampled, and words of tied rank taken, in ascending order; several labels of a document count as their largest, null
ones not at all; repeated rows get equal scores; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, doc_bucket

SAMPLE = 3_000
LEARN_BYTES = 1 << 16
LANDMARKS = 96
LAM = 0.6
SPAN = 5
LEAST = 0.45
POWER = 3
MEMO = 300_000

#: Words whose values are worked out at a time: a row of landmarks for each feature that they hit is held.
CHUNK = 2_000

#: Codes of other letters than a to z; a feature has three codes of BITS bits.
OTHERS = 37
BITS = 6
FEATURES = 1 << 3 * BITS

#: Words longer than this are seen through windows of it, moved by half.
WINDOW = 24

#: Digits and signs that stand for letters.
LEET = str.maketrans("0134578@$!|", "oieastbasii")

_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_FAST = re.compile(r"[a-z]+[.,;:!?]*")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def fold(word: str) -> str:
    """Letters a to z, and others as they are, of a word."""
    low = word.lower()
    if _FAST.fullmatch(low):
        return low.rstrip(".,;:!?")
    low = low.strip(".,;:!?\"'()[]|-").translate(LEET)
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    return "".join(c for c in low if c.isalpha())


def words_of(sentence: str) -> list[str]:
    """Words of a sentence; three or more single characters in a row become one."""
    found = sentence.split()
    if list(map(len, found)).count(1) < 3:
        return found
    out, run = [], []
    for w in [*found, "  "]:
        if len(w) == 1:
            run.append(w)
            continue
        out += ["".join(run)] if len(run) > 2 else run
        run = []
        out.append(w)
    return out[:-1]


def _code(word: str) -> list[int]:
    return [0, *[ord(c) - 96 if "a" <= c <= "z" else 27 + ord(c) % OTHERS for c in word], 0]


def _occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word's position, feature, weight) of all subsequences of three within SPAN characters."""
    coded = [_code(w) for w in words]
    flat = np.array([x for c in coded for x in c] + [0] * SPAN, np.int32)
    size = np.array([len(c) for c in coded])
    left = np.repeat(np.cumsum(size), size) - np.arange(int(size.sum()))
    of = np.repeat(np.arange(len(words)), size)
    at, keys, weights = [], [], []
    for a, b in _OFFSETS:
        ok = np.flatnonzero(left > b)
        at.append(of[ok])
        keys.append(flat[ok] << 2 * BITS | flat[ok + a] << BITS | flat[ok + b])
        weights.append(np.full(len(ok), LAM ** (b - 2), np.float32))
    return np.concatenate(at), np.concatenate(keys), np.concatenate(weights)


def _features(word: str) -> dict[int, float]:
    """The word's feature vector, of length 1."""
    got: dict[int, float] = defaultdict(float)
    for k, w in zip(*(x.tolist() for x in _occurrences([word])[1:]), strict=True):
        got[k] += w
    norm = math.sqrt(sum(x * x for x in got.values())) or 1.0
    return {k: v / norm for k, v in got.items()}


class Machine:
    """Landmarks, and weights of a sentence's values at them."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        used: dict[int, int] = {}
        feats = [_features(w) for w in landmarks]
        for f in feats:
            for k in f:
                used.setdefault(k, len(used))
        self.row = np.full(FEATURES, -1, np.int32)
        self.table = np.zeros((max(1, len(used)), len(landmarks)), np.float32)
        for j, f in enumerate(feats):
            for k, v in f.items():
                self.row[k] = used[k]
                self.table[used[k], j] = v
        self.top = self.table.max(axis=1, initial=0)
        self.beta, self.bias, self.slope = np.zeros(len(landmarks)), -1.0, (0.0, 0.0, -50.0)
        self.memo: dict[str, np.ndarray | None] = {}

    def __getstate__(self):
        return self.__dict__ | {"memo": {}}

    def kernel(self, words: list[str]) -> dict[str, np.ndarray]:
        """Values at the landmarks of the folded words that have one of LEAST or more."""
        out: dict[str, np.ndarray] = {}
        for i in range(0, len(words), CHUNK):
            some = words[i : i + CHUNK]
            of, keys, weights = _occurrences(some)
            squares = np.bincount(of, weights * weights, len(some))
            row = self.row[keys]
            hit = np.flatnonzero(row >= 0)
            hit = hit[np.argsort(of[hit], kind="stable")]
            if not len(hit):
                continue
            seen, first = np.unique(of[hit], return_index=True)
            most = np.add.reduceat(weights[hit] * self.top[row[hit]], first)
            able = most >= LEAST * np.sqrt(squares[seen])
            keep = np.repeat(able, np.diff(np.r_[first, len(hit)]))
            hit = hit[keep]
            if not len(hit):
                continue
            seen, first = np.unique(of[hit], return_index=True)
            sums = np.add.reduceat(self.table[row[hit]] * weights[hit][:, None], first, axis=0)
            near = sums.max(axis=1) >= LEAST * np.sqrt(squares[seen])
            for w, s in zip(seen[near], sums[near], strict=True):
                got = Counter()
                for k, x in zip(*(x.tolist() for x in _occurrences([some[w]])[1:]), strict=True):
                    got[k] += x
                value = s / math.sqrt(sum(x * x for x in got.values()))
                if value.max() >= LEAST:
                    out[some[w]] = np.where(value >= LEAST, value, 0) ** POWER
        return out

    def learn(self, raw: Iterable[str]) -> None:
        """Put raw words into the memo: their values, or None."""
        parts: dict[str, list[str]] = {}
        for w in raw:
            f = fold(w)
            parts[w] = [f] if len(f) <= WINDOW else [f[i : i + WINDOW] for i in range(0, len(f) - WINDOW // 2, WINDOW // 2)]
        found = self.kernel(list({p for ps in parts.values() for p in ps if len(p) > 1}))
        for w, ps in parts.items():
            near = [found[p] for p in ps if p in found]
            self.memo[w] = np.max(near, axis=0) if near else None

    def sentences(self, texts: list[str]) -> list[tuple[int, np.ndarray]]:
        """Of each text: its words' number, and a row of values for each sentence that has any."""
        claim(self.memo, self.memo.clear)
        if len(self.memo) > MEMO:
            self.memo.clear()
        split = [[words_of(s) for s in _SENTENCES.split(t)] for t in texts]
        new: set[str] = set()
        for text in split:
            for s in text:
                new.update([w for w in s if w not in self.memo])
        self.learn(new)
        memo, out = self.memo, []
        for text in split:
            rows = []
            for s in text:
                near = [x for x in [memo[w] for w in s] if x is not None]
                if near:
                    rows.append(np.max(near, axis=0))
            out.append((sum(map(len, text)), np.array(rows).reshape(len(rows), len(self.landmarks))))
        return out

    def margin(self, rows: np.ndarray) -> float:
        return float(max((rows @ self.beta).max() if len(rows) else 0.0, 0.0) + self.bias)

    def scores(self, texts: list[str]) -> list[float]:
        a, b, c = self.slope
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, a * self.margin(rows) + b * math.log1p(n) + c)))) for n, rows in self.sentences(texts)]


def _choose(texts: list[str], labels: list[int], count: int) -> list[str]:
    """Landmarks: words that tell toxic texts, by themselves or by the features they share with others, no two too near."""
    seen = [{f for s in _SENTENCES.split(t) for w in words_of(s) if 2 < len(f := fold(w)) <= WINDOW} for t in texts]
    df, bad = Counter(w for x in seen for w in x), Counter(w for x, y in zip(seen, labels, strict=True) if y for w in x)
    every, words = sorted(df), sorted(bad)
    rate = (sum(bad.values()) + 1) / (sum(df.values()) + 2)
    sure = lambda k, n: (k - rate * n) / np.sqrt(np.maximum(n, 1) * rate * (1 - rate))  # noqa: E731  the excess in standard deviations
    n_all, n_bad = np.zeros(FEATURES), np.zeros(FEATURES)
    for i in range(0, len(every), 10_000):
        some = every[i : i + 10_000]
        of, keys, _ = _occurrences(some)
        n_all += np.bincount(keys, np.array([df[w] for w in some], float)[of], FEATURES)
        n_bad += np.bincount(keys, np.array([bad.get(w, 0) for w in some], float)[of], FEATURES)
    excess = np.where(n_all >= 20, sure(n_bad, n_all), 0) * np.where(n_bad > 2 * rate * n_all, 1, 0)
    by_parts = np.zeros(len(words))
    for i in range(0, len(words), 10_000):
        of, keys, weights = _occurrences(some := words[i : i + 10_000])
        by_parts[i : i + 10_000] = np.bincount(of, excess[keys] * weights, len(some)) / np.bincount(of, weights, len(some))
    by_itself = sure(np.array([bad[w] for w in words], float), np.array([df[w] for w in words], float))
    by_itself *= np.array([bad[w] >= 5 and bad[w] > 3 * rate * df[w] for w in words])
    rank = np.maximum(by_itself, 2 * by_parts)
    chosen, feats = [], []
    for i in np.lexsort((np.arange(len(words)), -rank)):
        if rank[i] < 4 or len(chosen) >= count:
            break
        f = _features(words[i])
        if all(sum(v * g.get(k, 0) for k, v in f.items()) < 0.8 for g in feats):
            chosen.append(words[i])
            feats.append(f)
    return chosen or [w for w, _ in bad.most_common(count)]


def _hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge machine in the primal, by Newton steps on the examples inside the margin."""
    z = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.diag([*[1.0] * x.shape[1], 1e-3])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        inside = y * (z @ w) < 1
        a = z[inside] * cost[inside][:, None]
        new = np.linalg.solve(ridge + a.T @ z[inside], a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = 0.5 * w + 0.5 * new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 50) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = z.T @ (z * (p * (1 - p))[:, None]) + np.eye(z.shape[1]) * 1e-3
        w = w + np.linalg.solve(h, z.T @ (y - p) - 1e-3 * w)
    return w


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, rounds: int = 4) -> Machine:
    if len(set(labels)) < 2:
        return Machine([])
    machine = Machine(_choose(texts, labels, landmarks))
    if not machine.landmarks:
        return machine
    y = np.array(labels)
    got = []
    for i in range(0, len(texts), 200):
        got += machine.sentences(texts[i : i + 200])
        machine.memo.clear()
    zz = np.array([[machine.kernel([w]).get(w, np.zeros(len(machine.landmarks)))] for w in machine.landmarks])[:, 0, :]
    value, vector = np.linalg.eigh((zz + zz.T) / 2)
    root = vector @ np.diag(np.where(value > 1e-6, 1 / np.sqrt(np.maximum(value, 1e-6)), 0)) @ vector.T
    nothing = np.zeros((1, len(machine.landmarks)))
    bags = [np.vstack([rows, nothing]) @ root for _, rows in got]
    negative = np.vstack([b for b, t in zip(bags, y, strict=True) if not t])
    positive = np.vstack([b[:-1].sum(axis=0, keepdims=True) / max(1, len(b) - 1) if len(b) > 1 else b for b, t in zip(bags, y, strict=True) if t])
    for _ in range(rounds):
        x = np.vstack([positive, negative])
        sign = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
        cost = np.r_[np.full(len(positive), 1.0), np.full(len(negative), 3.0 * len(positive) / max(1, len(negative)))]
        w, bias = _hinge(x, sign, cost)
        positive = np.vstack([b[[int(np.argmax(b @ w))]] for b, t in zip(bags, y, strict=True) if t])
    machine.beta, machine.bias = root @ w, bias
    margins = np.array([machine.margin(rows) for _, rows in got])
    machine.slope = tuple(_logistic(np.c_[margins, [math.log1p(n) for n, _ in got]], y.astype(float)))
    machine.memo.clear()
    return machine


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """The machine, from at most `sample` labelled rows outside the held-out quarter."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (doc_bucket() != 2))
    known = known.select(F.col("doc_id").cast("long"), "toxic").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long"), "text").filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= LEARN_BYTES).join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = sorted(texts.collect())
    return train([r["text"] or "" for r in rows], [int(r["toxic"] > 0) for r in rows])


def scorer(spark: SparkSession, machine: Machine):
    """A function of text columns. Only texts go to Python and scores come back; the rows wait in the JVM."""
    held = spark.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            texts = [t or "" for t in texts]
            yield pd.Series([x for i in range(0, len(texts), 500) for x in held.value.scores(texts[i : i + 500])], dtype="float64")

    return score


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted."""
    score = scorer(docs.sparkSession, fit(docs, labels, sample))
    out = docs.select(F.col("doc_id").cast("long"), score("text").alias("score"))
    return out.select("doc_id", (doc_bucket() == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = 0.3) -> DataFrame:
    """docs without those that are predicted toxic."""
    score = scorer(docs.sparkSession, fit(docs, labels, sample))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), score("text").alias("_score"))
    return rows.filter(F.col("_score") < threshold).select("_row.*")
