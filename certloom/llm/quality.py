"""Document quality without labels: votes of heuristics, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.shared import least_hashed
from certloom.shipping import by_value

#: Buckets of the scorer, rows it is trained on (those of least hash), words that a worker remembers.
BUCKETS = 1 << 11
TRAINED = 4_000
REMEMBERED = 1 << 19

_UPPER = bytes(range(65, 91))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#$%&*!|<>{}[]=~^_\\/@+"
_SENTENCE = re.compile(r"[.!?…。！？][\"'»”)]*\s*$")
_PLAIN = re.compile(r"[(\"'«“¿¡]?[^\W\d_]+(?:['’\-][^\W\d_]+)*[)\"'»”]?[.,;:!?…]?[)\"'»”]?")
LABELLERS = ("symbols", "plain_words", "separators", "capitals", "word_length", "repetition", "lines", "sentences", "digits", "runs")


class Plain(dict):
    """Word -> whether it is letters with at most a mark or two around; remembers a bounded number of words."""

    def __missing__(self, word: str) -> bool:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = value = _PLAIN.fullmatch(word) is not None
        return value


def votes(text: str, plain: Plain) -> list[int]:
    """What each heuristic says of a whole text: 1 good, -1 bad, 0 nothing."""
    raw, found = text.encode(), text.split()
    if not found:
        return [0, -1, 0, 0, 0, 0, 0, -1, 0, 0]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / len(raw)
    vote = lambda good, bad: 1 if good else -1 if bad else 0
    symbols, words = share(_SYMBOLS), len(found)
    clean = sum(map(plain.__getitem__, found)) / words
    alone = found.count("|") / words
    mean = (len(text) - words + 1) / words
    distinct = len(set(found)) / words**0.85  # long texts repeat more of their words
    rows = [line.strip() for line in text.split("\n") if line.strip()]
    ends = sum(_SENTENCE.search(line[-8:]) is not None for line in rows) / len(rows)
    repeated = 1 - len(set(rows)) / len(rows)
    runs = repeats(found) / words
    return [vote(False, symbols > 0.04), vote(clean > 0.9, clean < 0.6), vote(False, alone > 0.1), vote(False, share(_UPPER) > 0.3),
            vote(False, mean < 2 or mean > 9), vote(distinct > 0.55, distinct < 0.3) if words > 20 else 0,
            vote(False, repeated > 0.3) if len(rows) > 3 else 0, vote(ends > 0.6, ends < 0.2), vote(False, share(_DIGITS) > 0.2), vote(False, runs > 0.2)]


@dataclass
class LabelModel:
    """P(vote | class) of each heuristic and the share of good documents."""

    tables: np.ndarray  # heuristics x 2 classes x 3 votes (-1, 0, 1)
    good: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good) by pattern of votes (rows)."""
        each = np.arange(patterns.shape[1])
        logs = np.log(np.array([1 - self.good, self.good])) + np.log(self.tables[each, :, patterns + 1]).sum(axis=1)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        return p[:, 1] / p.sum(axis=1)


def fit_labels(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over the counted patterns of votes, from the majority of votes on.

    Tables are smoothed by one vote of a heuristic that is right more often than not, which also keeps the classes' sides.
    """
    good = np.clip(0.5 + 0.4 * np.sign(patterns.sum(axis=1)), 0.1, 0.9)
    prior = np.array([[0.5, 0.3, 0.2], [0.2, 0.3, 0.5]])
    model = LabelModel(np.repeat(prior[None], patterns.shape[1], axis=0), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        tables = np.empty_like(model.tables)
        for k, v in enumerate((-1, 0, 1)):
            tables[:, :, k] = ((patterns == v).T.astype(float) @ weight.T) + prior[:, k]
        model = LabelModel(tables / tables.sum(axis=2, keepdims=True), float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 1e-3, 1 - 1e-3)))
        good = model.posterior(patterns)
    return model


def _shape(word: str) -> str:
    return re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", re.sub(r"\d", "0", word)))


def buckets(word: str) -> tuple[int, int]:
    """A word's own bucket, and that of its shape: letters as a or A, digits as 0, runs as one."""
    return zlib.crc32(word.lower().encode()) % BUCKETS, zlib.crc32(b"shape " + _shape(word).encode()) % BUCKETS


#: Bucket of words that repeat the word before.
REPEAT = zlib.crc32(b"repeat") % BUCKETS


def repeats(found: list[str]) -> int:
    return sum(map(str.__eq__, found, found[1:]))


class Weights(dict):
    """Word -> its weight in the scorer, for a bounded number of words."""

    def __init__(self, weights: np.ndarray) -> None:
        super().__init__()
        self.weights = weights.tolist()

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        own, shape = buckets(word)
        self[word] = value = self.weights[own] + self.weights[shape]
        return value


@dataclass
class Model:
    labels: LabelModel | None = None
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0


def _votes(docs: DataFrame, text: str) -> DataFrame:
    def run(batches):
        plain = Plain()
        for batch in batches:
            found = [votes(x.as_py() or "", plain) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(["".join("-0+"[v + 1] for v in f) for f in found], pa.string())], names=["pattern"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "pattern string")


def _numbers(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns])


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rows: int = TRAINED) -> Model:
    """Heuristics' accuracies from the votes on all documents, and a scorer from the posteriors of `rows` of them.

    The votes are counted by pattern (3 to the number of heuristics at most), so the driver gets a
    table of bounded size whatever the number of documents. Without documents every score is 0.5.
    """
    counted = _votes(docs, text).groupBy("pattern").count().collect()
    model = Model()
    if not counted:
        return model
    counted.sort(key=lambda r: r["pattern"])
    model.labels = fit_labels(_numbers([r["pattern"] for r in counted]), np.array([float(r["count"]) for r in counted]))

    def run(batches):
        plain = Plain()
        for batch in batches:
            at, value, pattern = [], [], []
            for x in batch.column(0):
                text = x.as_py() or ""
                found = text.split()
                both = np.array([b for w in found for b in buckets(w)] + [REPEAT] * repeats(found), dtype=np.int64)
                where, n = np.unique(both, return_counts=True)
                at.append(where.tolist())
                value.append((n / max(len(found), 1)).tolist())
                pattern.append("".join("-0+"[v + 1] for v in votes(text, plain)))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.list_(pa.int64())), pa.array(value, pa.list_(pa.float64())), pa.array(pattern, pa.string())], names=["at", "value", "pattern"])

    chosen = least_hashed(docs.select(F.col(text).alias("text"), F.col(doc_id).alias("key")), rows, "key", "text").select("text")
    sample = chosen.mapInArrow(run, "at array<long>, value array<double>, pattern string").collect()
    x = np.zeros((len(sample), BUCKETS), dtype=np.float32)
    for i, r in enumerate(sample):
        x[i, r["at"]] = r["value"]
    y = model.labels.posterior(_numbers([r["pattern"] for r in sample]))
    w, b = np.zeros(BUCKETS), 0.0
    mean, square = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    for step in range(1, 251):  # Adam on the logistic loss against soft labels
        p = 1 / (1 + np.exp(-np.clip(x @ w.astype(np.float32) + b, -30, 30)))
        grad = np.append(x.T @ (p - y) / len(y) + 1e-6 * w, (p - y).mean())
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        move = 0.3 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds label_posterior (P(good) by the votes) and quality_score (the scorer's, 0 to 1).

    Null and empty texts are judged by their votes: no words, so bad, with the lowest score 0. Rows are independent. Other
    columns are kept; one named like a new column is an error.
    """
    if {"label_posterior", "quality_score"} & {c.lower() for c in docs.columns}:
        raise ValueError("a new column is there already")
    at, sent = docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        weights, plain = Weights(model.weights), Plain()
        for batch in batches:
            texts = [x.as_py() or "" for x in batch.column(at)]
            posterior = model.labels.posterior(np.array([votes(t, plain) for t in texts])).tolist() if model.labels and texts else [0.5] * len(texts)
            scores = []
            for t in texts:
                found = t.split()
                z = model.bias + (sum(map(weights.__getitem__, found)) + model.weights[REPEAT] * repeats(found)) / len(found) if found else 0.0
                scores.append(float(1 / (1 + np.exp(-max(z, -700.0)))) if found else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(posterior, pa.float64()), pa.array(scores, pa.float64())],
                                             names=[*batch.schema.names, "label_posterior", "quality_score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("label_posterior", T.DoubleType()), T.StructField("quality_score", T.DoubleType())]))


by_value(__name__)
