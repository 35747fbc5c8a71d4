"""Two tokenizations of one text, aligned by the bytes where tokens of both end.

The tokens of a batch of documents are two arrays of byte offsets, A's ends and B's ends. One state vector holds a
pointer into each for every document at once. A step compares the ends that the pointers are at: where they are
equal it emits a link and a cut, and it moves the pointer that lags behind, or both. Documents that are through are
compacted out of the state. A long document takes part as several stretches of its bytes, which start at the first
ends beyond their first byte, so that a batch needs as many steps as a stretch has tokens, not as its longest text.

Counts of linked ids are looked up once per distinct pair and batch of documents, not once per link: a batch writes
the list of its pairs and each document's links as positions in it.
"""

from __future__ import annotations

import hashlib
import itertools
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.llm.bpe import PIECES, _byte_of_char
from certloom.llm.shared import written
from certloom.shipping import by_value

#: Bytes of a stretch; characters of a text that is encoded at a time, and of the texts of a batch.
STRETCH = 1 << 10
PART = 1 << 16
BATCH = 1 << 21
#: In a pair of ids the first is above these bits.
LOW = 32
#: A single blank between non-blanks: both tokenizers begin a token there and none reaches across.
BETWEEN_WORDS = regex.compile(r"(?<=[!-~\p{L}\p{N}]) (?=[!-~\p{L}\p{N}])")


class Pair:
    """Both tokenizers, built from the contents of their files."""

    def __init__(self, byte_level: str, pieces: bytes) -> None:
        import sentencepiece
        import tiktoken

        of = _byte_of_char()
        model = json.loads(byte_level)["model"]
        ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if all(c in of for c in token)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        made = [model["vocab"][u + v] for u, v in merges]
        if made != sorted(made) or len(set(made)) < len(made):
            raise ValueError("the file's ids are not in the order of its merges")
        kept = set(made)  # special tokens' strings are plain text
        self.a = tiktoken.Encoding("bytes", pat_str=PIECES, mergeable_ranks={t: i for t, i in ranks.items() if len(t) == 1 or i in kept}, special_tokens={})
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.b = sentencepiece.SentencePieceProcessor(model_proto=pieces)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        # else a piece could reach across a cut between words
        self.cut = not any("▁" in p.lstrip("▁") for p in names)
        self.length_a, self.length_b = (np.array([len(x) for x in t]) for t in (self.bytes_a, self.bytes_b))
        # each id as text, with what can follow it inside the groups: A's , and | and B's , and ;
        self.printed = [f"{i}{after}".encode() for n, after in ((len(self.bytes_a), ","), (len(self.bytes_a), "|"), (len(self.bytes_b), ","), (len(self.bytes_b), ";")) for i in range(n)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text by A and of text by B, which adds the space; None where their bytes are not those of space + text.

        Long texts are encoded in parts, cut between words: each part's blank is the one before it, the text's own or the added one.
        """
        if not text:
            return None
        parts, at = [], 0
        while self.cut and len(text) - at > PART and (found := BETWEEN_WORDS.search(text, at + PART)):
            parts.append(text[at : found.start()])
            at = found.end()
        parts.append(text[at:])
        ids_a, ids_b = [], []
        for part in parts:
            a, b, whole = self.a.encode_ordinary(" " + part), self.b.encode(part), (" " + part).encode()
            if b"".join([self.bytes_a[i] for i in a]) != whole or b"".join([self.bytes_b[i] for i in b]) != whole:
                return None
            ids_a += a
            ids_b += b
        return np.array(ids_a, dtype=np.int64), np.array(ids_b, dtype=np.int64)


def ends(ids: list[np.ndarray], lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all documents one after another: where each token ends, in bytes from the first document's start; where each document's tokens begin."""
    flat = np.concatenate(ids) if ids else np.empty(0, dtype=np.int64)
    return np.cumsum(lengths[flat]), np.cumsum([0, *map(len, ids)])


def lockstep(end_a: np.ndarray, end_b: np.ndarray, stretch: int = STRETCH) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all tokens of A and B that end together, in order.

    end_a, end_b: strictly rising ends of the tokens of all documents in one numbering of bytes; both end alike. The
    state vector has a pair of pointers for each stretch of bytes; all of them advance by one step at a time.
    """
    if not len(end_a):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    edges = np.arange(0, int(end_a[-1]) + stretch, stretch)
    i, j = np.searchsorted(end_a, edges, side="right"), np.searchsorted(end_b, edges, side="right")
    i, last_i, j, last_j = i[:-1], i[1:], j[:-1], j[1:]
    found_i, found_j = [], []
    alive = (i < last_i) & (j < last_j)
    while True:
        if not alive.all():
            i, last_i, j, last_j = i[alive], last_i[alive], j[alive], last_j[alive]
        if not len(i):
            break
        a, b = end_a[i], end_b[j]
        together = a == b
        found_i.append(i[together])
        found_j.append(j[together])
        i, j = i + (a <= b), j + (b <= a)
        alive = (i < last_i) & (j < last_j)
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    order = np.argsort(i)
    return i[order], j[order]


def groups_order(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, of_a: int, of_b: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in the order in which groups are written, `a1,a2|b1;a3|b2,b3;`, as numbers of printed ids, and where each group of it ends.

    a, b: ids; i, j: the last tokens of the groups; of_a, of_b: sizes of the vocabularies.
    """
    group_a, group_b = np.searchsorted(i, np.arange(len(a))), np.searchsorted(j, np.arange(len(b)))
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    last_a[i], last_b[j] = True, True
    before_b = np.append(0, j + 1)  # B tokens of all groups before
    order = np.empty(len(a) + len(b), dtype=np.int64)
    order[np.arange(len(a)) + before_b[group_a]] = a + of_a * last_a
    order[np.arange(len(b)) + i[group_b] + 1] = b + 2 * of_a + of_b * last_b
    return order, i + j + 2


_ALIGNED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, batch long, links binary, pairs binary, times binary")
_TYPES = [pa.int64()] * 5 + [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _aligned(docs: DataFrame, tokenizers) -> DataFrame:
    """Each document's groups and links, and for each batch of documents a row without figures that lists its pairs of ids and how often each is linked."""

    def batch_rows(keys, coded, number: int, tables: Pair):
        some = [k for k, c in enumerate(coded) if c is not None]
        a, b = [coded[k][0] for k in some], [coded[k][1] for k in some]
        (end_a, from_a), (end_b, _) = ends(a, tables.length_a), ends(b, tables.length_b)
        i, j = lockstep(end_a, end_b)
        flat_a, flat_b = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (a, b))
        pairs, position, times = np.unique(flat_a[i] << LOW | flat_b[j], return_inverse=True, return_counts=True)
        cuts = np.searchsorted(i, from_a)
        order, group_ends = groups_order(flat_a, flat_b, i, j, len(tables.bytes_a), len(tables.bytes_b))
        order, group_ends = order.tolist(), np.append(0, group_ends)
        out = {name: [] for name in ("n_a", "n_b", "n_groups", "sha", "links")}
        of = dict(zip(some, range(len(some)), strict=True))
        for k in range(len(coded)):
            if k not in of:
                for name, value in (("n_a", 0), ("n_b", 0), ("n_groups", 0), ("sha", ""), ("links", b"")):
                    out[name].append(value)
                continue
            d = of[k]
            own = slice(cuts[d], cuts[d + 1])
            text = b"".join([tables.printed[x] for x in order[group_ends[cuts[d]] : group_ends[cuts[d + 1]]]])[:-1]
            out["n_a"].append(len(a[d]))
            out["n_b"].append(len(b[d]))
            out["n_groups"].append(cuts[d + 1] - cuts[d])
            out["sha"].append(hashlib.sha256(text).hexdigest())
            out["links"].append(position[own].astype("<u4").tobytes())
        n = len(coded)
        made = [keys, out["n_a"], out["n_b"], out["n_groups"], out["n_groups"], out["sha"], [number] * n, out["links"], [None] * n, [None] * n]
        listed = [None, None, None, None, None, None, number, None, pairs.astype("<i8").tobytes(), times.astype("<i8").tobytes()]
        names = [x.split()[0] for x in _ALIGNED.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([*column, x], t) for column, x, t in zip(made, listed, _TYPES, strict=True)], names=names)

    def run(batches):
        shared = tokenizers.value  # a worker keeps it from task to task, and so the tokenizers that it has built
        if "pair" not in shared:
            shared["pair"] = Pair(*shared["files"])
        tables = shared["pair"]
        number = itertools.count(TaskContext.get().partitionId() << 40)
        keys, coded, size = [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                keys.append(key)
                coded.append(tables.encode(text))
                size += len(text or "")
                if size >= BATCH:
                    yield batch_rows(keys, coded, next(number), tables)
                    keys, coded, size = [], [], 0
        if keys:
            yield batch_rows(keys, coded, next(number), tables)

    return docs.mapInArrow(run, _ALIGNED)


def _entries(aligned: DataFrame) -> DataFrame:
    """(batch, position, a, b, n): the pairs of ids of each batch and how often it links them."""

    def run(batches):
        for batch in batches:
            for number, pairs, times in zip(*(batch.column(i) for i in range(3)), strict=True):
                ids, n = np.frombuffer(pairs.as_py(), dtype="<i8"), np.frombuffer(times.as_py(), dtype="<i8")
                columns = [np.full(len(ids), number.as_py()), np.arange(len(ids), dtype=np.int32), (ids >> LOW).astype(np.int32), (ids & ((1 << LOW) - 1)).astype(np.int32), n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["batch", "position", "a", "b", "n"])

    return aligned.where("pairs IS NOT NULL").select("batch", "pairs", "times").mapInArrow(run, "batch long, position int, a int, b int, n long")


def pair_counts(entries: DataFrame) -> DataFrame:
    """(a, b, count, best): how many links of the corpus hold a pair of ids, and whether none of its B id has more."""
    counts = entries.groupBy("a", "b").agg(F.sum("n").alias("count"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def _scored(aligned: DataFrame, known: DataFrame) -> DataFrame:
    """The documents with n_best and count_sum. known: batch, position, count, best of each pair of a batch."""

    def score(documents: pa.Table, listed: pa.Table) -> pa.Table:
        count, best = (np.zeros(listed.num_rows, dtype=np.int64) for _ in range(2))
        at = listed["position"].to_numpy()
        count[at], best[at] = listed["count"].to_numpy(), listed["best"].to_numpy()
        own = [np.frombuffer(x.as_py(), dtype="<u4") for x in documents["links"]]
        sums = [pa.array([int(t[x].sum()) for x in own], pa.int64()) for t in (best, count)]
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.Table.from_arrays([*(documents[c] for c in kept), *sums, documents["groups_sha256"]], names=[*kept, "n_best", "count_sum", "groups_sha256"])

    documents = aligned.where("pairs IS NULL").drop("pairs", "times")
    return documents.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(
        score, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def align(docs: DataFrame, byte_level: str, pieces: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    byte_level, pieces: paths of tokenizer A (a byte-level BPE file; reads space + text) and B (a piece model, adds the
    space itself). Special tokens' strings are plain text. Byte offsets where tokens of both end cut a text into groups;
    the two tokens that end there are a link. count of a link: how many links of all documents hold its two ids;
    n_best of a document's links are as frequent as any of their B id, count_sum adds up all counts.
    groups_sha256 is the digest of the groups' ids. Null and empty texts, and texts that either tokenizer changes, have no
    tokens: zeros, and an empty digest. Rows that repeat are documents of their own; a null doc_id stays null; an empty
    table stays empty; other columns are not read.

    Pairs are looked up once per batch of about 2 MB of text; the list of a batch's pairs and its documents meet
    by the batch's number, so a task holds one batch (or one very long document) at a time.
    """
    with open(byte_level, encoding="utf-8") as f, open(pieces, "rb") as g:
        tables = docs.sparkSession.sparkContext.broadcast({"files": (f.read(), g.read())})
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    aligned = written(_aligned(rows, tables))
    entries = written(_entries(aligned))
    counts = pair_counts(entries)
    known = entries.join(counts, ["a", "b"]).select("batch", "position", "count", "best")
    return _scored(aligned, known)


by_value(__name__)
