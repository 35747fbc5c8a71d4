"""Near-duplicates by 64-bit SimHash fingerprints: pigeonhole blocks, then Hamming distances.

A fingerprint is cut into five blocks. Two fingerprints that differ in three bits at most agree in at least two of
them, so every pair that links meets under one of the ten pairs of blocks. Where very many fingerprints share such
a key, what is left of them is cut again: into four parts, of which three differing bits leave one alike, so each
goes under four longer keys. Keys that are hot even then hold fingerprints that agree nearly everywhere: these are
dealt to chunks, and every two chunks are compared by a task of their own.

Fingerprints are compared as numbers, never as rows: a task gives at most one row for a fingerprint that it holds,
its smallest linked one after the links in the task are followed, so no group becomes a list of pairs.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.llm.components import components
from certloom.llm.shared import written
from certloom.llm.shingles import words
from certloom.shipping import by_value

BITS = 64
#: Fingerprints that differ in so many bits link.
NEAR = 3
#: Fingerprints under one key that are compared at once; chunks of a hot key hold half as many.
CELL = 2048
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 14


def fingerprint(text: str | None, size: int = 3) -> int:
    """The SimHash of a text's shingles of `size` words, repeats included; 0 without words.

    Words are runs of anything but ASCII white space, with A-Z lowered; fewer than `size` are one shingle. A
    shingle's bits are those of its XXH64 (seed 42). A bit is 1 if it is in over half the shingles.
    """
    found = words(text)
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(found)
    if len(found) <= size:
        return digest(joined, 42)
    ends = list(itertools.accumulate([len(w) + 1 for w in found]))
    starts = [0, *ends[: len(found) - size]]
    total, counts = len(starts), np.zeros(BITS, dtype=np.int64)
    for i in range(0, total, COUNTED):
        part = [digest(joined[a : b - 1], 42) for a, b in zip(starts[i : i + COUNTED], ends[i + size - 1 : i + COUNTED + size - 1], strict=False)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3) -> DataFrame:
    """(doc_id, print): each row's fingerprint as a signed 64-bit number. Texts are read one by one."""

    def run(batches):
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), size) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "print"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, print long")


def _mask(low: int, high: int) -> int:
    """Bits low to high - 1, as a signed number."""
    m = ((1 << (high - low)) - 1) << low
    return m - (1 << BITS) if m >> (BITS - 1) else m


def block_masks(near: int = NEAR) -> list[tuple[int, int]]:
    """(kept, left): the bits of two of near + 2 blocks, and all others. Of any near differing bits some choice keeps none."""
    cuts = [BITS * i // (near + 2) for i in range(near + 3)]
    parts = [_mask(a, b) for a, b in itertools.pairwise(cuts)]
    return [(a | b, ~(a | b)) for a, b in itertools.combinations(parts, 2)]


def part_masks(left: int, near: int = NEAR) -> list[int]:
    """The bits of `left`, cut into near + 1 parts."""
    places = [i for i in range(BITS) if left >> i & 1]
    cuts = [len(places) * i // (near + 1) for i in range(near + 2)]
    masks = [sum(1 << i for i in places[a:b]) for a, b in itertools.pairwise(cuts)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def _keyed(prints: DataFrame, masks: list[int], name: str) -> DataFrame:
    """A row for each mask: `name` (number of the mask) and the fingerprint's bits under it."""
    chosen = F.array(*(F.struct(F.lit(i).alias("k"), F.col("print").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(masks)))
    return prints.withColumn("c", F.explode(chosen)).select(*prints.columns, F.col("c.k").alias(name), F.col("c.v").alias(f"{name}_bits"))


def _hot(keyed: DataFrame, names: list[str], cell: int) -> DataFrame:
    """Keys of more fingerprints than a cell: (names, n). At most one row for each `cell` rows."""
    return keyed.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > cell)


def _chunked(rows: DataFrame, cell: int) -> DataFrame:
    """Rows of hot keys (with n) under every pair of chunks that has theirs; low, high: the pair, side: which of it is the row's."""
    chunks = F.ceil(F.col("n") * 2 / cell).cast("long")
    own = F.pmod(F.xxhash64("print"), chunks)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    return rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least of each one's component under the links a, b."""
    at = np.arange(n)
    while True:
        low, high = np.minimum(at[a], at[b]), np.maximum(at[a], at[b])
        if (low == high).all():
            return at
        np.minimum.at(at, high, low)
        while (at[at] != at).any():
            at = at[at]


def linked(values: np.ndarray, starts: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links between equal keys: values are sorted by key, starts says where each key's group begins.

    Small groups are compared by shifts, all of a batch at once; a large one by rows of its matrix, each of which
    gives only the links to the least of every component seen so far, so that no list of all pairs is made.
    """
    sizes = np.diff(np.append(starts, len(values)))
    ends = np.repeat(starts + sizes, sizes)
    left, right = [], []
    small = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(small)
    shift = 1
    while len(at := at[at + shift < ends[at]]):
        close = np.bitwise_count(values[at] ^ values[at + shift]) <= near
        left.append(at[close])
        right.append(at[close] + shift)
        shift += 1
    for start, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        group = values[start : start + size]
        todo = np.ones(size, dtype=bool)
        while (waiting := np.flatnonzero(todo)).size:
            front = waiting[:1]
            todo[front] = False
            root = front[0]
            while len(front):
                rest = np.flatnonzero(todo)
                hit = np.zeros(len(rest), dtype=bool)
                for i in range(0, len(front), 256):
                    hit |= (np.bitwise_count(group[front[i : i + 256], None] ^ group[rest]) <= near).any(axis=0)
                front = rest[hit]
                todo[front] = False
                left.append(np.full(len(front), start + root))
                right.append(start + front)
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _compared(rows: DataFrame, names: list[str], near: int) -> DataFrame:
    """(a, b): fingerprints and the least that they reach inside their group; groups are the rows with equal `names`."""

    def run(batches):
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                now = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)])
                held = now if held is None else np.concatenate([held, now], axis=1)
            if held is None or not held.shape[1]:
                continue
            new = (held[1:, 1:] != held[1:, :-1]).any(axis=0)
            begins = np.concatenate([[0], np.flatnonzero(new) + 1])
            end = held.shape[1] if batch is None else int(begins[-1])  # the last group may go on in the next batch
            begins = begins[begins < end]
            if end:
                known, node = np.unique(held[0, :end], return_inverse=True)
                a, b = linked(held[0, :end].view(np.uint64), begins, near)
                root = roots(node[a], node[b], len(known))
                moved = np.flatnonzero(root != np.arange(len(known)))
                yield pa.RecordBatch.from_arrays([pa.array(known[moved]), pa.array(known[root[moved]])], names=["a", "b"])
            held = held[:, end:]

    return rows.select("print", *names).repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long")


def links(prints: DataFrame, near: int = NEAR, cell: int = CELL) -> DataFrame:
    """(a, b): links of fingerprints that connect all that differ in `near` bits at most. prints: one row per fingerprint, written.

    A key of the ten pairs of blocks with more than `cell` fingerprints is cut into longer keys, one of these with
    more than `cell` into chunks. Each fingerprint is sent ten times, and one under a hot key four times more.
    """
    masks = block_masks(near)
    keyed = _keyed(prints, [m for m, _ in masks], "pair")
    first = ["pair", "pair_bits"]
    hot = written(_hot(keyed, first, cell))
    cold = keyed.join(hot.select(*first), first, "left_anti")
    found = _compared(cold, first, near)
    if hot.isEmpty():
        return found
    warm = keyed.join(hot.select(*first), first, "left_semi")
    choices = [F.array(*(F.struct(F.lit(i).alias("k"), F.col("print").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(part_masks(left, near)))) for _, left in masks]
    parts = F.element_at(F.array(*choices), F.col("pair") + 1)
    deep = warm.withColumn("c", F.explode(parts)).select("print", *first, F.col("c.k").alias("part"), F.col("c.v").alias("part_bits"))
    second = [*first, "part", "part_bits"]
    hotter = written(_hot(deep, second, cell))
    found = found.unionByName(_compared(deep.join(hotter.select(*second), second, "left_anti"), second, near))
    if hotter.isEmpty():
        return found
    dealt = _chunked(deep.join(hotter, second), cell)
    return found.unionByName(_compared(dealt, [*second, "low", "high"], near))


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, near: int = NEAR, cell: int = CELL) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Two documents link if their fingerprints differ in `near` bits at most; component_id is the smallest doc_id
    reachable by links, the document's own included. Null and empty texts and texts of white space have the fingerprint
    zero and link like any other. Rows that repeat a doc_id stay as they are, rows without a doc_id have the class
    of their fingerprint, or null if it holds no doc_id. An empty table stays empty; other columns are not read.

    Equal fingerprints are one row from the start, whatever share of the corpus they hold; the documents are
    joined back by fingerprint, one row on the other side, so that adaptive execution can split a hot one.
    """
    if not 0 <= near <= 8:
        raise ValueError("near must be between 0 and 8")
    known = written(fingerprints(docs, doc_id, text, size))
    prints = written(known.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(links(prints.select("print"), near, cell)).select(F.col("node").alias("print"), "root")
    rooted = written(prints.join(found, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("print", "component_id")
    return known.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


by_value(__name__)
