"""Toxic spans by a linear-chain conditional random field, and document scores out of its marginals.

Labels mark documents, so tokens are labelled at a distance: a token of a toxic
document is toxic if its word, or the beginning of its word, is far commoner in toxic than
in clean documents and stands there in many contexts (copies of one document give
many counts but one context).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.shared import least_hashed, written
from certloom.shipping import by_value

#: At most so many labelled rows, those of least hash, are learned from; the field itself from so many per class.
LABELLED = 20_000
FIELD_ROWS = 1_500
#: A feature is kept from this share of the toxic rows on, and if its odds are so many times those in clean rows.
SUPPORT = 0.005
LOG_ODDS = 3.0
#: Beginnings of words that are features, besides whole words (`=word`).
PREFIXES = (4, 5, 6)
#: Tokens of a training window; the numbers of a token: bias, log odds, whole word, beginning, neighbours listed.
WINDOW = 12
NUMBERS = 6
#: Words that a worker remembers.
REMEMBERED = 1 << 19

WORD = re.compile(r"[^\W\d_]+")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("marginal", T.DoubleType())]))


def features(word: str) -> list[str]:
    word = word.lower()
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) >= n)]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Listed(dict):
    """Word -> (log odds, by whole word, by beginning), or None; remembers a bounded number of words."""

    def __init__(self, odds: dict[str, float]) -> None:
        super().__init__()
        self.odds = odds

    def __missing__(self, word: str):
        found = [(f[0] == "=", self.odds[f]) for f in features(word) if f in self.odds]
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = got = (max(o for _, o in found), any(w for w, _ in found), any(not w for w, _ in found)) if found else None
        return got


@dataclass
class Model:
    """Odds of listed features, weights of the field (numbers, then transitions), calibration of a document."""

    odds: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(NUMBERS))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    scale: np.ndarray = field(default_factory=lambda: np.array([-6.0, 0.0, 0.0]))
    learned: bool = False


def numbers(listed: list) -> np.ndarray:
    """The numbers of each token; listed: what Listed says of it."""
    out = np.zeros((len(listed), NUMBERS))
    out[:, 0] = 1
    for i, got in enumerate(listed):
        if got:
            out[i, 1:4] = got[0] / 5, got[1], got[2]
            if i:
                out[i - 1, 5] = 1
            if i + 1 < len(listed):
                out[i + 1, 4] = 1
    return out


def _sums(scores: np.ndarray, moves: np.ndarray):
    """log Z, token marginals and pair marginals of equally long chains (chains x tokens x 2)."""
    n, length, _ = scores.shape
    fore, back = np.empty_like(scores), np.zeros_like(scores)
    fore[:, 0] = scores[:, 0]
    for t in range(1, length):
        fore[:, t] = np.logaddexp(fore[:, t - 1, :1] + moves[0], fore[:, t - 1, 1:] + moves[1]) + scores[:, t]
    for t in range(length - 2, -1, -1):
        ahead = back[:, t + 1] + scores[:, t + 1]
        back[:, t] = np.logaddexp(ahead[:, :1] + moves[:, 0], ahead[:, 1:] + moves[:, 1])
    total = np.logaddexp(fore[:, -1, 0], fore[:, -1, 1])
    single = np.exp(fore + back - total[:, None, None])
    pair = np.exp(fore[:, :-1, :, None] + moves + (scores + back)[:, 1:, None, :] - total[:, None, None, None])
    return total, single, pair


def train_field(x: np.ndarray, y: np.ndarray, steps: int = 150, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and transitions of most likelihood (Adam on the exact gradient). x: chains x tokens x numbers; y: 0/1."""
    theta = np.zeros(NUMBERS + 4)
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    pairs = np.stack([((y[:, :-1] == a) & (y[:, 1:] == b)).sum() for a in (0, 1) for b in (0, 1)]) / len(x)
    seen = (x * y[..., None]).sum(axis=(0, 1)) / len(x)
    for step in range(1, steps + 1):
        w, moves = theta[:NUMBERS], theta[NUMBERS:].reshape(2, 2)
        scores = np.stack([np.zeros(x.shape[:2]), x @ w], axis=-1)
        _, single, pair = _sums(scores, moves)
        grad = np.concatenate([seen - (x * single[..., 1:]).sum(axis=(0, 1)) / len(x), pairs - pair.sum(axis=(0, 1)).ravel() / len(x)]) - ridge * theta
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad * grad
        theta = theta + 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return theta[:NUMBERS], theta[NUMBERS:].reshape(2, 2)


def _run_power(model: Model):
    """k -> the k-th power of the transfer matrix of a token about which nothing is listed, scaled by its largest value."""
    step = np.exp(model.moves) * np.array([1.0, math.exp(model.weights[0])])
    values, vectors = np.linalg.eig(step)
    inverse = np.linalg.inv(vectors)
    values = values / np.abs(values).max()
    cache: dict[int, tuple] = {}

    def power(k: int):
        if k not in cache:
            if len(cache) > 4096:
                cache.clear()
            m = np.real((vectors * values**k) @ inverse)
            cache[k] = tuple(m.ravel().tolist())
        return cache[k]

    return power


def marginals(model: Model, power, words: list, at: list[int]) -> list[float]:
    """P(toxic) at the listed tokens of one chain: forward-backward in time proportional to the listed tokens.

    Between tokens that are listed or beside one, equal steps are taken in one by a matrix power.
    """
    near = sorted({i + d for i in at for d in (-1, 0, 1) if 0 <= i + d < len(words)})
    listed, here, w = set(at), {}, model.weights
    for i in near:
        got = words[i]
        e = w[0] + (w[1] * got[0] / 5 + w[2] * got[1] + w[3] * got[2] if got else 0.0) + w[4] * (i - 1 in listed) + w[5] * (i + 1 in listed)
        here[i] = math.exp(min(e, 50.0))
    (m00, m01), (m10, m11) = np.exp(model.moves).tolist()
    bias = math.exp(w[0])
    fore, last, a, b = {}, -1, 1.0, 0.0
    for i in near:
        gap = i - last - 1
        if last < 0 and gap:  # the chain begins with tokens about which nothing is listed
            a, b, gap = 1.0, bias, gap - 1
        if gap:
            p00, p01, p10, p11 = power(gap)
            a, b = a * p00 + b * p10, a * p01 + b * p11
        if i == 0:
            a, b = 1.0, here[i]
        else:
            a, b = a * m00 + b * m10, (a * m01 + b * m11) * here[i]
        total = a + b
        a, b = a / total, b / total
        fore[i], last = (a, b), i
    out, a, b, following = {}, 1.0, 1.0, len(words)
    for i in reversed(near):
        gap = following - i - 1
        if following < len(words):
            c, d = a, b * here[following]
            a, b = m00 * c + m01 * d, m10 * c + m11 * d
        if gap:
            p00, p01, p10, p11 = power(gap)
            a, b = p00 * a + p01 * b, p10 * a + p11 * b
        total = a + b
        a, b, following = a / total, b / total, i
        x, y = fore[i][0] * a, fore[i][1] * b
        out[i] = y / (x + y)
    return [out[i] for i in at]


def evidence(found: list[float]) -> tuple[float, float]:
    """A document's numbers: log odds of its most toxic token, and the log of the toxic tokens expected."""
    if not found:
        return -8.0, 0.0
    top = min(max(max(found), 1e-4), 1 - 1e-4)
    return math.log(top / (1 - top)), math.log1p(sum(found))


def score(model: Model, found: list[float]) -> float:
    z = float(model.scale @ np.array([1.0, *evidence(found)]))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _counts(rows: DataFrame, wanted=None) -> DataFrame:
    """Feature, rows that hold it, and a bit for each of 64 classes of the word before it."""

    def run(batches):
        keep = wanted.value if wanted is not None else None
        for batch in batches:
            n, bits = Counter(), {}
            for text in batch.column(0).to_pylist():
                seen: dict[str, int] = {}
                before = ""
                for word in WORD.findall(text or ""):
                    bit = 1 << (sum(before.encode()[:8]) * 37 + len(before)) % 64
                    for f in features(word):
                        if keep is None or f in keep:
                            seen[f] = seen.get(f, 0) | bit
                    before = word
                n.update(seen.keys())
                for f, x in seen.items():
                    bits[f] = bits.get(f, 0) | x
            names = list(n)
            signed = [bits[f] - (1 << 64) if bits[f] >> 63 else bits[f] for f in names]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([n[f] for f in names], pa.int64()), pa.array(signed, pa.int64())],
                                             names=["feature", "n", "bits"])

    return rows.select("text").mapInArrow(run, "feature string, n long, bits long").groupBy("feature").agg(
        F.sum("n").alias("n"), F.bit_count(F.bit_or("bits")).alias("contexts"))


def _odds(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Log odds of the features that are listed. Their number is bounded: each is in a fixed share of the toxic rows."""
    least = max(3, math.ceil(SUPPORT * n_toxic))
    expected = 64 * (1 - F.exp(-F.col("n") / 64))
    toxic = {r["feature"]: r["n"] for r in _counts(rows.where("toxic = 1")).where((F.col("n") >= least) & (F.col("contexts") >= 3)
                                                                                  & (F.col("contexts") >= 0.4 * expected)).collect()}
    wanted = rows.sparkSession.sparkContext.broadcast(frozenset(toxic))
    clean = {r["feature"]: r["n"] for r in _counts(rows.where("toxic = 0"), wanted).collect()}
    odds = {f: math.log((n + 0.5) / (n_toxic + 1)) - math.log((clean.get(f, 0) + 0.5) / (n_clean + 1)) for f, n in toxic.items()}
    return {f: o for f, o in odds.items() if o >= LOG_ODDS}


def _windows(words: list, toxic: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Training chains of one document: around its listed tokens, and its beginning."""
    at = [i for i, w in enumerate(words) if w]
    out = []
    for start in sorted({0, *(max(0, min(i - WINDOW // 2, len(words) - WINDOW)) for i in at[:8])}):
        part = words[start : start + WINDOW]
        if len(part) == WINDOW:
            out.append((numbers(part), np.array([int(bool(toxic and w)) for w in part])))
    return out


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", labelled: int = LABELLED) -> Model:
    """A model of at most `labelled` labelled rows outside the held-out third, those of least hash.

    Only the toxic label and the words are used. Without toxic or without clean rows
    nothing is learned and every score is the same low one.
    """
    chosen = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy(
        F.col("doc_id").cast("long").alias("known_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = written(least_hashed(chosen, labelled, "known_id"))  # of bounded size: it may be sent along
    rows = docs.select(F.col(doc_id).cast("long").alias("known_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "known_id")
    rows = written(rows)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    model = Model()
    if not n_toxic or not n_clean:
        return model
    model.odds = _odds(rows, n_toxic, n_clean)
    listed, chains, kept = Listed(model.odds), [], []
    for toxic, n in ((1, n_toxic), (0, n_clean)):
        part = least_hashed(rows.where(F.col("toxic") == toxic), FIELD_ROWS, "known_id").select("text")
        got = _listed_rows(part, listed.odds, toxic)
        for row in got:
            chains += [(np.array(x).reshape(WINDOW, NUMBERS), np.array(y)) for x, y in zip(row["x"], row["y"], strict=True)]
            kept.append((toxic, n / len(got), row["n"], row["at"], row["what"]))
    if chains:
        model.weights, model.moves = train_field(np.stack([x for x, _ in chains]), np.stack([y for _, y in chains]))
    power = _run_power(model)
    known, y, weight = [], [], []
    for toxic, w, n, at, what in kept:
        words: list = [None] * n
        for i, x in zip(at, what, strict=True):
            words[i] = (x[0], bool(x[1]), bool(x[2]))
        known.append([1.0, *evidence(marginals(model, power, words, at) if at else [])])
        y.append(toxic)
        weight.append(w)
    x, y, weight = np.array(known), np.array(y, dtype=float), np.array(weight) / np.sum(weight)
    scale = np.zeros(3)
    for _ in range(30):  # Newton's method, with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ scale, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        scale = scale + np.linalg.solve(hessian, x.T @ (weight * (y - p)) - 1e-4 * scale)
    model.scale, model.learned = scale, True
    return model


def _listed_rows(part: DataFrame, odds: dict[str, float], toxic: int) -> list:
    """Of a bounded number of rows: training chains, and the listed tokens."""

    def run(batches):
        listed = Listed(odds)
        for batch in batches:
            out = {"n": [], "at": [], "what": [], "x": [], "y": []}
            for text in batch.column(0).to_pylist():
                words = [listed[w] for w in WORD.findall(text or "")]
                at = [i for i, w in enumerate(words) if w]
                chains = _windows(words, toxic)
                for k, v in (("n", len(words)), ("at", at), ("what", [[float(z) for z in words[i]] for i in at]),
                             ("x", [c[0].ravel().tolist() for c in chains]), ("y", [c[1].tolist() for c in chains])):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["n"], pa.int64()), pa.array(out["at"], pa.list_(pa.int64())), pa.array(out["what"], pa.list_(pa.list_(pa.float64()))),
                                              pa.array(out["x"], pa.list_(pa.list_(pa.float64()))), pa.array(out["y"], pa.list_(pa.list_(pa.int64())))], names=list(out))

    return part.mapInArrow(run, "n long, at array<long>, what array<array<double>>, x array<array<double>>, y array<array<long>>").collect()


def tag(docs: DataFrame, model: Model, text: str = "text", score_name: str = "toxic_score", spans: str = "toxic_spans") -> DataFrame:
    """Adds a score from 0 to 1 and the toxic spans (start and end in characters, marginal of at least 0.5).

    A null or empty text has the score of a text without listed words and no spans. Rows are
    independent: repeated rows, ties and very long texts need nothing. All other columns are kept;
    one named like a new column is an error.
    """
    if {score_name.lower(), spans.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("a new column is there already")
    at = docs.columns.index(text)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))

    def run(batches):
        model = sent.value
        listed, power = Listed(model.odds), _run_power(model)
        for batch in batches:
            scores, found = [], []
            for value in batch.column(at):
                text = value.as_py() or ""
                words = [listed[w] for w in WORD.findall(text)]
                hits = [i for i, w in enumerate(words) if w]
                marks = marginals(model, power, words, hits) if hits else []
                scores.append(score(model, marks))
                toxic = {i: m for i, m in zip(hits, marks, strict=True) if m >= 0.5}
                found.append([{"start": m.start(), "end": m.end(), "marginal": toxic[i]} for i, m in enumerate(WORD.finditer(text)) if i in toxic] if toxic else [])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, score_name, spans])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_name, T.DoubleType()), T.StructField(spans, SPANS)]))


by_value(__name__)
