"""Quality classifier by weak labels: EM estimates how far heuristic labellers are right, their posterior labels train a scorer.

Overlapping labellers vote good, bad or abstain on each text. The votes of all documents are counted by pattern in
Spark (at most 2 ** labellers rows come to the driver), and expectation-maximisation over the patterns gives each
labeller's rate of firing in either class and the posterior of a pattern. A hashed linear scorer (logistic
regression over hashed word shapes and hashed bins of the measures) is trained with the posteriors as soft labels on a
bounded sample (``TRAIN_ROWS``, chosen by a hash of id and text) and then scores every document.

Defined cases: null and empty texts have no words, all labellers abstain and they are kept; an empty table
gives none; repeated rows and ties score alike; ids may repeat or be null; other columns pass through ``scored``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import blocks, sampled

#: Documents that the scorer is trained on (expected number; equal rows count once), and its hashed features.
TRAIN_ROWS, FEATURES = 20_000, 1 << 12
EM_ROUNDS, EPOCHS, STEP, DECAY = 50, 300, 0.5, 1e-4
#: A text whose probability of being bad reaches this is rejected.
REJECT = 0.5
_SHAPES = 200_000

_SYMBOLS = b"#*$%&|<>"
_TEXTUAL = bytes(b"A"[0] if 65 <= c <= 90 else b"a"[0] if 97 <= c <= 122 or c >= 128 else b"9"[0] if 48 <= c <= 57 else c for c in range(256))


#: Letters of scripts without blanks between words: Thai and Lao, Tibetan, Burmese, Khmer, kana, Chinese, Yi; a text with this share of them is in one.
_NO_BLANKS = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\ua000-\ua48f\uf900-\ufaff\U00020000-\U0003ffff]")
MOSTLY = 0.3
#: The length of words that is taken where words cannot be told.
ORDINARY = 6.0


def _word_length(text: bytes, words: list[bytes]) -> tuple[float, bool]:
    """Mean code points of the words, and whether blanks tell them; if not, the labellers of length and variety abstain."""
    if text.isascii():
        return sum(map(len, words)) / len(words), True
    points = text.decode("utf-8", "replace")
    if len(_NO_BLANKS.findall(points)) > MOSTLY * sum(map(str.isalpha, points)):
        return ORDINARY, False
    # bytes of words less those that only carry on a code point
    return (sum(map(len, words)) - len(text) + len(points)) / len(words), True


def measures(text: bytes) -> tuple[dict[str, float], list[bytes]]:
    """What labellers look at, and the words."""
    words = text.split()
    n = len(words)
    if not n:
        return {}, words
    lines = [x for x in text.split(b"\n") if x.strip()]
    length, told = _word_length(text, words)
    fives = n - 4
    return {
        "symbols": sum(text.count(c) for c in _SYMBOLS) / n,
        "repeats": 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:]))) / fives if fives > 0 else 0.0,
        "upper": sum(map(bytes.isupper, words)) / n,
        "cries": text.count(b"!") / n,
        "variety": len(set(words)) / min(n, 400) if told else 1.0,
        "length": length,
        "lines": 1 - len(set(lines)) / len(lines),
        "pipes": text.count(b"|") / n,
    }, words


#: Labellers that vote bad: measure, and the threshold they fire above (below, where the sign is negative).
FAULTS = [
    ("symbols", 1, 0.3),
    ("repeats", 1, 0.6),
    ("upper", 1, 0.6),
    ("cries", 1, 0.5),
    ("variety", -1, 0.25),
    ("length", 1, 9.5),
    ("lines", 1, 0.7),
    ("pipes", 1, 0.3),
]
#: Labellers that vote good: they fire where all of their measures stay within these bounds.
VIRTUES = [
    [("variety", -1, 0.45), ("repeats", 1, 0.3)],
    [("symbols", 1, 0.1), ("pipes", 1, 0.1), ("cries", 1, 0.2), ("upper", 1, 0.3)],
]
LABELLERS = len(FAULTS) + len(VIRTUES)
#: What is assumed of them: a labeller of faults fires on at most this share of good texts, one of virtues on at most that share of bad ones.
FALSE_FAULT, FALSE_VIRTUE = 0.01, 0.7


def votes(m: dict[str, float]) -> list[bool]:
    """Which labellers fire; the others abstain."""
    if not m:
        return [False] * LABELLERS
    over = lambda name, sign, bound: sign * m[name] > sign * bound
    return [over(*f) for f in FAULTS] + [not any(over(*x) for x in virtue) for virtue in VIRTUES]


def pattern(v: list[bool]) -> int:
    return sum(1 << i for i, x in enumerate(v) if x)


def votes_of(pattern_: int) -> list[bool]:
    return [bool(pattern_ >> i & 1) for i in range(LABELLERS)]


def estimate(counts: dict[int, int]) -> dict[int, float]:
    """EM over counted vote patterns: the posterior probability of bad for each pattern.

    The hidden class is good or bad; each labeller's rate of firing in either class is estimated, within what is assumed of it.
    """
    if not counts:
        return {}
    v = np.array([votes_of(p) for p in counts], float)
    n = np.array(list(counts.values()), float)
    faults = v[:, : len(FAULTS)].any(axis=1)
    q = np.where(faults, 0.9, 0.05)
    most_good = np.array([FALSE_FAULT] * len(FAULTS) + [0.999] * len(VIRTUES))
    most_bad = np.array([0.999] * len(FAULTS) + [FALSE_VIRTUE] * len(VIRTUES))
    for _ in range(EM_ROUNDS):
        bad = np.clip(((n * q) @ v + 0.5) / ((n * q).sum() + 1), 1e-4, most_bad)
        good = np.clip(((n * (1 - q)) @ v + 0.5) / ((n * (1 - q)).sum() + 1), 1e-4, most_good)
        prior = np.clip((n * q).sum() / n.sum(), 0.01, 0.5)
        logit = np.log(prior / (1 - prior)) + v @ (np.log(bad) - np.log(good)) + (1 - v) @ (np.log(1 - bad) - np.log(1 - good))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-6:
            break
        q = new
    return dict(zip(counts, q.tolist()))


class Featurizer:
    """Hashed features of a text: shares of word shapes, and one bin of each measure."""

    def __init__(self, size: int = FEATURES):
        self.size, self.shapes = size, {}

    def shape(self, word: bytes) -> int:
        s = word.translate(_TEXTUAL)
        out = bytearray()
        for c in s:
            if not out or out[-1] != c:
                out.append(c)
        i = xxhash.xxh3_64_intdigest(bytes(out[:24])) % self.size
        if len(self.shapes) >= _SHAPES:
            self.shapes.clear()
        self.shapes[word] = i
        return i

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bool]]:
        m, words = measures(text)
        if not words:
            return np.zeros(0, np.int64), np.zeros(0), votes(m)
        known = self.shapes
        ids = [known[w] if w in known else self.shape(w) for w in words]
        at, counts = np.unique(np.array(ids), return_counts=True)
        bins = [xxhash.xxh3_64_intdigest(f"{name}:{min(20, int(value * (1 if name == 'length' else 20)))}") % self.size for name, value in m.items()]
        return np.concatenate([at, bins]), np.concatenate([counts / len(words), np.full(len(bins), 0.5)]), votes(m)


@dataclass
class Scorer:
    weights: np.ndarray
    bias: float

    def probability(self, at: np.ndarray, values: np.ndarray) -> float:
        """Of being bad; a text without words has none."""
        if not len(at):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.bias + (self.weights[at] * values).sum(), -30, 30))))

    def column(self, text: Column) -> Column:
        scorer = self

        @F.pandas_udf("double")
        def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            features = Featurizer(len(scorer.weights))
            for part in parts:
                yield pd.Series([scorer.probability(*features(t.encode("utf-8", "replace"))[:2]) for t in part], dtype="float64")

        return score(F.coalesce(text, F.lit("")))


def train(rows: list[tuple[np.ndarray, np.ndarray, float]], size: int = FEATURES) -> Scorer:
    """Logistic regression with soft labels: full gradient steps scaled by feature (Adagrad)."""
    if not rows:
        return Scorer(np.zeros(size), -5.0)
    at = np.concatenate([r[0] for r in rows])
    values = np.concatenate([r[1] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    w, b, sw, sb = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(EPOCHS):
        z = b + np.bincount(owner, w[at] * values, len(rows))
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        g = np.bincount(at, d[owner] * values, size) + DECAY * w
        sw += g * g
        sb += d.sum() ** 2
        w -= STEP * g / np.sqrt(sw)
        b -= STEP * d.sum() / np.sqrt(sb)
    return Scorer(w, b)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Scorer:
    """Counts vote patterns over all documents, estimates the labellers, and trains the scorer on a bounded sample."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        for _, texts in blocks(batches):
            for t in texts:
                p = pattern(votes(measures(t)[0]))
                seen[p] = seen.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["pattern", "n"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featurizer = Featurizer()
        for _, texts in blocks(batches):
            out = [featurizer(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([x[0].tolist() for x in out], pa.list_(pa.int32())), pa.array([x[1].tolist() for x in out], pa.list_(pa.float64())), pa.array([pattern(x[2]) for x in out], pa.int32())], names=["at", "value", "pattern"])

    counts = {r[0]: r[1] for r in rows.select("text").mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n")).collect()}
    posterior = estimate(dict(sorted(counts.items())))
    n = sum(counts.values())
    sample = sampled(rows, n, most, "id", "text") if n > most else rows
    taken = sample.select("text").mapInArrow(features, "at array<int>, value array<double>, pattern int").collect()
    return train([(np.array(r[0], np.int64), np.array(r[1]), posterior[r[2]]) for r in taken])


def scored(docs: DataFrame, scorer: Scorer, text_col: str = "text", names: tuple[str, str] = ("bad_probability", "kept")) -> DataFrame:
    """The rows with ``names``: the probability of being bad, and whether the row is kept. Input columns of these names are replaced."""
    probability, kept = names
    return docs.withColumn(probability, scorer.column(F.col(text_col))).withColumn(kept, F.col(probability) < REJECT)
