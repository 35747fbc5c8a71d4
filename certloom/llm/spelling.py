"""Spelling variants: words one edit apart, found by dense tiles of padded code-point matrices.

A tile is a matrix of words by code points, padded to the longest, and another with the words set flush right. All
pairs of two tiles are compared at once, position by position: how long the common prefix and the common suffix of
each pair are. Where both together reach the longer length minus one, a single inserted, deleted or replaced code
point makes one word of the other.

Which tiles meet follows from the same two lengths. With the longer word cut in the middle, the edit is in its second
half, then both words share its first half as a prefix, or in its first half, then they share the second as a suffix.
So words are sorted into groups by (longer length, prefix or suffix, the half); small groups are packed into one tile,
large ones are dealt to several, of which every two are compared by a task.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from certloom.llm.shared import written
from certloom.shipping import by_value

# Runs that are words, and how occurrences are damaged.
RUNS = r"[A-Za-zÀ-ÿ]+"
EVERY = 31

#: Words of a tile; a group of more is dealt to tiles of half as many.
TILE = 512
#: Distinct words that a task counts before it passes them on.
COUNTED = 1 << 17

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def damaged(doc_id: int | None, run: str, every: int = EVERY) -> str:
    """The run, or the run without one code point if crc32 of `doc_id:run` is a multiple of `every`."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2, every: int = EVERY) -> DataFrame:
    """(word, n): the words of whole texts with `least` code points and `occurrences` occurrences at least.

    Counts are added up in each task, then over all. A null text has no words; a null doc_id counts as ''.
    """

    def run(batches):
        find = regex.compile(RUNS).findall
        total: Counter[str] = Counter()

        def passed_on():
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()

        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Counter(x.translate(_LOWER) if not x.islower() else x for x in find(value.as_py() or ""))
                for word, n in own.items():
                    if len(word) >= least:
                        word = damaged(key, word, every)
                        if len(word) >= least:
                            total[word] += n
                if len(total) >= COUNTED:
                    yield from passed_on()
        yield from passed_on()

    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def _grouped(counted: DataFrame) -> DataFrame:
    """Each word under its four groups: as long as the longer word of a pair or one shorter, by first and by second half."""
    size = F.char_length("word")
    halves = []
    for longer in (size, size + 1):
        half = F.floor(longer / 2).cast("int")
        halves += [F.struct(longer.alias("longer"), F.lit(False).alias("tail"), F.substring("word", F.lit(1), half).alias("half")),
                   F.struct(longer.alias("longer"), F.lit(True).alias("tail"), F.right("word", longer - half).alias("half"))]
    rows = counted.withColumn("g", F.explode(F.array(*halves)))
    return rows.select("word", "n", F.col("g.longer").alias("longer"), F.col("g.tail").alias("tail"), F.xxhash64("g.half").alias("half"))


@dataclass
class Tile:
    """Words with all that tiles are compared by: code points flush left and flush right, lengths and group."""

    words: list[str]
    n: np.ndarray
    longer: np.ndarray
    tail: np.ndarray
    group: np.ndarray

    def __post_init__(self) -> None:
        self.size = np.array([len(w) for w in self.words])
        self.width = int(self.size.max(initial=1))

    def matrix(self, width: int, right: bool, padding: int) -> np.ndarray:
        """Words by code points; padding is a number that is no code point."""
        texts = [w[::-1] for w in self.words] if right else self.words
        cells = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width).astype(np.int32)
        return np.where(np.arange(width) < self.size[:, None], cells, padding)


def shared_length(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For every row of a and of b in how many first columns they agree."""
    alive = np.ones((len(a), len(b)), dtype=bool)
    total = np.zeros((len(a), len(b)), dtype=np.int16)
    for column in range(a.shape[1]):
        alive &= a[:, column, None] == b[None, :, column]
        if not alive.any():
            break
        total += alive
    return total


def single_edits(a: Tile, b: Tile) -> np.ndarray:
    """Which words of a are one edit from which of b, as pairs of the group that both are in.

    A pair that both halves would find belongs to the first half.
    """
    width = max(a.width, b.width)
    front = shared_length(a.matrix(width, False, -1), b.matrix(width, False, -2))
    back = shared_length(a.matrix(width, True, -1), b.matrix(width, True, -2))
    longer, shorter = np.maximum.outer(a.size, b.size), np.minimum.outer(a.size, b.size)
    near = (front + back >= longer - 1) & (longer - shorter <= 1) & (front < longer)
    near &= (a.group[:, None] == b.group[None]) & (longer == a.longer[:, None]) & (longer == b.longer[None])
    return near & ((front < longer // 2) == a.tail[:, None])


def _compared(rows: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near_word): per tile and word how many are near, and the most frequent of them."""
    keys = ["longer", "tail", "half", "low", "high"]

    def best(tile: Tile, other: Tile, near: np.ndarray, out: list) -> None:
        """Per word of tile (rows of near) its near words of other."""
        order = sorted(range(len(other.words)), key=lambda i: (-other.n[i], other.words[i]))
        near = near[:, order]
        counts = near.sum(axis=1)
        for i in np.flatnonzero(counts).tolist():
            top = order[int(near[i].argmax())]
            out.append((tile.words[i], int(counts[i]), int(other.n[top]), other.words[top]))

    def tile(rows: list[tuple], groups: np.ndarray) -> Tile:
        return Tile([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] for r in rows], dtype=bool), groups)

    def compare(part: list[tuple], out: list) -> None:
        """Rows of whole groups: within a group of one tile all pairs, in one of two tiles those between them."""
        starts = [0, *(i for i in range(1, len(part)) if part[i][2:7] != part[i - 1][2:7])]
        number = np.repeat(np.arange(len(starts)), np.diff([*starts, len(part)]))
        first = [i for i, r in enumerate(part) if not r[7]]
        second = [i for i, r in enumerate(part) if r[7]]
        for left, right in ((first, first), (first, second)):
            if left is right and part[0][5] != part[0][6]:
                continue  # two different tiles; each one's own pairs are compared by another task
            if left and right:
                a, b = tile([part[i] for i in left], number[left]), tile([part[i] for i in right], number[right])
                near = single_edits(a, b)
                best(a, b, near, out)
                if left is not right:
                    best(b, a, near.T, out)

    def made(out: list):
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["word", "n_near", "near_n", "near_word"])

    def run(batches):
        rows = itertools.chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        held: list[tuple] = []
        out: list[tuple] = []
        for _, group in itertools.groupby(rows, key=lambda r: r[2:7]):
            members = list(group)
            if held and (len(held) + len(members) > TILE or members[0][5] != members[0][6] or held[0][5] != held[0][6]):
                compare(held, out)
                held = []
            held += members if len(members) > 1 else []
            if len(out) >= COUNTED:
                yield made(out)
                out = []
        if held:
            compare(held, out)
        yield made(out)

    kind = "word string, n_near long, near_n long, near_word string"
    return rows.select("word", "n", *keys, "second").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, kind)


def near_words(counted: DataFrame, tile: int = TILE) -> DataFrame:
    """(word, n_near, near_n, near_word) of each word with near ones. counted: word (distinct), n; written.

    near_word is the most frequent one, of equals the first in code-point order. A group of m words that are more
    than a tile makes (m / half a tile) rows of each, for tasks of a bounded size.
    """
    keys = ["longer", "tail", "half"]
    rows = _grouped(counted)
    hot = rows.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > tile)
    rows = rows.join(hot, keys, "left")
    tiles = F.when(F.col("size").isNull(), 1).otherwise(F.ceil(F.col("size") * 2 / tile)).cast("long")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), tiles)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    rows = rows.select("word", "n", *keys, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("second"))
    found = _compared(rows)
    top = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near_word").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("near_n"), F.col("top.word").alias("near_word"))


def rooted(formed: DataFrame, highest: int | None) -> DataFrame:
    """Adds root: the last word that forms lead to from each word. formed: word, form, form_n; written.

    Each form occurs ten times as often, so a chain is as long as the highest count has digits, and the lengths
    double: a few joins, of the words that have a form alone with one row per word.
    """
    moved = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    longest = max(1, int(math.log10(max(highest or 1, 1))) + 1)
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = moved.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(moved.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return formed.join(moved, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 7, occurrences: int = 2,
             ratio: int = 10, every: int = EVERY, tile: int = TILE) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    Words are the runs of letters of all whole texts, A-Z lowered, of `least` code points and `occurrences`
    occurrences at least, after one in `every` (document, run) has lost a code point. form is the most frequent
    word one edit away (the first in code-point order of equals) if it occurs `ratio` times as often, else null; root follows forms to
    the last. Null and empty texts have no words, a null doc_id counts as '', repeated rows count each, an empty
    table has no words. Only the two named columns are read, whatever others there are.
    """
    if ratio < 10:
        raise ValueError("ratio must be 10 or more: chains of forms are bounded by it")
    counted = written(words(docs, doc_id, text, least, occurrences, every))
    both = counted.join(near_words(counted, tile), "word", "left")
    is_form = F.col("near_n") >= F.col("n") * ratio
    formed = written(both.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                                 F.when(is_form, F.col("near_word")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    highest = formed.agg(F.max("n")).first()[0]
    return rooted(formed, highest).select("word", "form", "root", "n", "n_near", "form_n")


by_value(__name__)
