"""Exact Jaccard join of documents over word shingles, by regions of a metric space.

Jaccard distance is a metric, but documents that share no shingle are all at distance 1 from each other and from
any document chosen as a pivot. So the first pivots are the shingles themselves, ordered from rare to
common: a document's region is that of its first pivot, and as a document it links with may lack some
of its shingles, it is copied into the regions of as many of its next pivots as that may be. What
links meets in several regions.

In a region documents are measured against the one with the least of its own, a pivot document, a document against the pivots of a few of its
regions; those that link with a pivot are its Voronoi cell (each in that of its nearest pivot), known by their
distances to it, and one component. Cells of one region are compared by
their pivots alone: by the triangle inequality only members in the windows near each other's boundary can link. The windows
of a large cell and of all its smaller neighbours are a region one level down, of members in place of cells. A region is dealt to blocks, and every two of them are
compared in one task, which tells only the pairs that sizes, radii and parities leave: no table holds all pairs of a
region or of two windows. Those pairs are measured by their whole sets.

That gives the components. All links are within them, so links are counted component by component: its sets are
dealt to blocks by size and hash, and every two blocks whose sizes allow links are compared whole, by matrices.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from certloom.llm.components import components
from certloom.llm.shared import shuffles_removed, written
from certloom.llm.shingles import CHUNKS, COUNTERS, counters, node_of, parities, rarest, shingles
from certloom.operators.ordered import top_per_key
from certloom.shipping import by_value

#: Cells of a region are in blocks of about so many, and about so many pairs of cells are looked at in one go; members
#: of a pivot are dealt by so many; a document is first measured against so many pivots of its regions.
CELLS = 256
AT_ONCE = 1 << 17
DEALT = 256
TRIED = 3
#: Links are counted between blocks of about so many sets, over so many shingles at a time.
BLOCK = 256
COLUMNS = 1 << 13
#: Sets that a task remembers to have seen.
REMEMBERED = 1 << 17
#: Sets of more shingles than this have so many parities besides, as half of all short ones differ between any two long sets.
LONG = 512
WIDE = 1 << 12
#: Ids of documents that are sent to the tasks at most, to leave other texts out before a shuffle.
SENT = 1 << 20
#: Rounding of distances.
SLACK = 1e-9


@dataclass
class Join:
    """documents: doc_id, node (one number per set), n_shingles; roots: node, root (of nodes with links); links: a, b, as many as connect."""

    documents: DataFrame
    roots: DataFrame
    links: DataFrame


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """Each document's set in short; and from each task, in chunks, in how many of its distinct sets shingles of a counter are."""

    def run(batches):
        seen, counts = set(), np.zeros(COUNTERS, dtype=np.uint32)
        names = ["doc_id", "node", "n", "bits", "wide", "chunk", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.binary()]
        for batch in batches:
            out = {"node": [], "n": [], "bits": [], "wide": []}
            for text in batch.column(1):
                found = shingles(text.as_py(), size)
                node = node_of(found) if len(found) else None
                if node is not None and node not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(node)
                    counts[counters(found)] += 1
                out["n"].append(len(found))
                out["node"].append(node)
                out["bits"].append(parities(found) if len(found) else None)
                out["wide"].append(parities(found, WIDE) if len(found) > LONG else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in zip(names[1:5], types[1:5], strict=True)),
                                              pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        if seen:
            parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(CHUNKS, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(CHUNKS, t) for t in types[:5]), pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, node long, n long, bits array<long>, wide array<long>, chunk int, counts binary")


def _classes(sets: DataFrame) -> np.ndarray:
    """A byte per counter, the binary logarithm of its total over all tasks. COUNTERS bytes, whatever the corpus."""

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                totals[chunk] = totals.get(chunk, 0) + np.frombuffer(zlib.decompress(raw), dtype=np.uint32).astype(np.int64)
        made = [(c, np.ceil(np.log2(t + 1)).astype(np.uint8).tobytes()) for c, t in totals.items()]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in made], pa.int32()), pa.array([b for _, b in made], pa.binary())], names=["chunk", "classes"])

    out = np.zeros((CHUNKS, COUNTERS // CHUNKS), dtype=np.uint8)
    for row in sets.where("chunk IS NOT NULL").select("chunk", "counts").repartition("chunk").mapInArrow(run, "chunk int, classes binary").collect():
        out[row["chunk"]] = np.frombuffer(row["classes"], dtype=np.uint8)
    return out.ravel()


def _regions(docs: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """(region, node, n, inner, typical) of every distinct set; copies within a task are sent once.

    inner: the region is one that the set shares with linked sets of its size or larger. typical: how common
    the set's rarest shingle is, highest where a set has nothing of its own, as the original of many copies.
    """
    sent_classes = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches):
        seen, known = set(), sent_classes.value
        for batch in batches:
            keys, nodes, sizes, inner, typical = [], [], [], [], []
            for text in batch.column(0):
                found = shingles(text.as_py(), size)
                if not len(found) or (node := node_of(found)) in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(node)
                key, first = rarest(found, known, percent)
                keys.append(key.view(np.int64))
                nodes.append(np.full(len(key), node, dtype=np.int64))
                sizes.append(np.full(len(key), len(found), dtype=np.int32))
                inner.append(np.arange(len(key)) < first)
                typical.append(np.full(len(key), known[counters(key[:1])[0]] if len(key) else 0, dtype=np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, sizes, inner, typical)],
                                                 names=["region", "node", "n", "inner", "typical"])

    return docs.select("text").mapInArrow(run, "region long, node long, n int, inner boolean, typical int")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Texts by doc_id, with all of the documents in wanted: of SENT or fewer, no others, and those are left out where texts are read."""
    ids = wanted.select("doc_id").distinct()
    texts = docs.select("doc_id", "text")
    return texts.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= SENT else texts


def _measured(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """a, b, their distance by their whole sets, and whether they link.

    The texts that occur in pairs, which are shorter than their sets, are dealt by a, and by a salt if
    many are compared with one a, whose text then goes to each salt.
    """
    by_a = pairs.groupBy("a").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))
    member = pairs.join(by_a, "a").select(F.col("b").alias("node"), F.col("a").alias("at"), F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("member"))
    pivot = by_a.select(F.col("a").alias("node"), F.col("a").alias("at"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("member"))
    wanted = written(member.unionByName(pivot).join(nodes.select("node", "doc_id"), "node"))
    texts = wanted.join(_texts(docs, wanted), "doc_id").select("at", "part", "member", "node", "text")

    def compare(batches):
        where, own = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for at, part, member, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = shingles(text, size)
                if node != node_of(found):
                    continue  # another document of that id
                if not member:
                    where, own = (at, part), found
                elif where == (at, part):
                    shared = len(np.intersect1d(own, found, assume_unique=True))
                    either = len(own) + len(found) - shared
                    for column, value in zip(out, (at, node, 1 - shared / either, 100 * shared >= percent * either), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.bool_()), strict=True)],
                                             names=["a", "b", "far", "links"])

    dealt = texts.repartition("at", "part").sortWithinPartitions("at", "part", "member", "node")
    return written(dealt.mapInArrow(compare, "a long, b long, far double, links boolean").groupBy("a", "b").agg(F.min("far").alias("far"), F.max("links").alias("links")))


def _possible(pairs: DataFrame, nodes: DataFrame, least: Column, *more: str) -> DataFrame:
    """Pairs (and their other columns) that sizes and parities allow to have a similarity of `least` or more.

    Sets differ in at least as many elements as in parity bits; the wide ones count where both sets have them.
    more: columns of nodes that pairs get for a and for b.
    """
    side = lambda x: nodes.select(F.col("node").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "bits", "wide", *more)))
    differ = lambda bits: F.aggregate(F.zip_with(f"a_{bits}", f"b_{bits}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    low, high = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
    near = lambda bits: differ(bits) * (1 + least) <= (low + high) * (1 - least) + SLACK
    some = (low >= high * least - SLACK) & near("bits") & F.coalesce(near("wide"), F.lit(True))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(some).select(*pairs.columns, *(f"{x}_{c}" for c in more for x in "ab"))


def _with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    known = roots.withColumnRenamed("node", "root_of")
    return rows.join(known, rows["node"] == known["root_of"], "left").select(*rows.columns, F.coalesce("root", "node").alias("root"))


def _open(members: DataFrame) -> DataFrame:
    """Cells of the regions that hold more than one component, with the number of blocks that they are dealt to.

    members: region, cell, root, inner_n (the smallest set to which the region is an inner one), most_n (the largest set).
    """
    counts = members.groupBy("region").agg(F.ceil(F.count("*") / CELLS).cast("int").alias("parts"), F.count("inner_n").alias("inner"),
                                           F.min("root").alias("low"), F.max("root").alias("high"))
    return members.join(counts.where("low < high AND inner > 0").select("region", "parts"), "region").select(
        "region", "cell", "root", "inner_n", "most_n", "parts")


def _near(members: DataFrame, known: DataFrame, reach: float) -> DataFrame:
    """Pairs of cells (a, b) of one region, of different components, whose members may link by all that is known of their pivots.

    The region is an inner one of a set of one cell, and the other one has a set as large. known: cell, radius, n, bits
    (of its pivot); sets differ in at least as many elements as in parity bits. A cell goes to as many tasks as its
    region has blocks; a task holds two blocks.
    """
    key = ["region", "x", "y"]
    dealt = members.join(known, "cell").withColumn("block", F.pmod(F.xxhash64("cell"), F.col("parts")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "region", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), (F.col("block") > F.col("other")).cast("int").alias("side"),
        "cell", "root", F.coalesce("inner_n", F.lit((1 << 31) - 1)).alias("inner_n"), "most_n", "radius", "n", "bits")

    def told(rows, first, count):
        """Pairs of each row i with `count[i]` rows from `first[i]` on."""
        left = np.repeat(np.arange(len(count)), count)
        right = np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        cell, root, inner, most, radius, n = (rows[c] for c in ("cell", "root", "inner_n", "most_n", "radius", "n"))
        some = (root[left] != root[right]) & ((inner[left] <= most[right]) | (inner[right] <= most[left]))
        left, right = left[some], right[some]
        least = np.maximum(1 - (reach + radius[left] + radius[right]), 0.0)
        low, high = np.minimum(n[left], n[right]), np.maximum(n[left], n[right])
        some = low >= high * least - SLACK
        left, right, least, both = left[some], right[some], least[some], (low + high)[some]
        differ = np.bitwise_count(rows["bits"][left] ^ rows["bits"][right]).sum(axis=1, dtype=np.int64)
        some = differ * (1 + least) <= both * (1 - least) + SLACK
        ends = np.sort(np.stack([cell[left[some]], cell[right[some]]], axis=1), axis=1)
        ends = np.unique(ends, axis=0)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0], pa.int64()), pa.array(ends[:, 1], pa.int64())], names=["a", "b"])

    def compare(table):
        """All pairs of whole tasks, about AT_ONCE at a time."""
        rows = {c: table[c].combine_chunks().to_numpy(zero_copy_only=False) for c in (*key, "side", "cell", "root", "inner_n", "most_n", "radius", "n")}
        rows["bits"] = table["bits"].combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(table.num_rows, -1)
        at = np.arange(table.num_rows)
        new = np.r_[True, np.any([rows[c][1:] != rows[c][:-1] for c in key], axis=0)]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], table.num_rows]
        task = np.cumsum(new) - 1
        second = starts + np.add.reduceat(1 - rows["side"], starts)  # where the other block begins
        alone = rows["x"] == rows["y"]
        first = np.where(alone, at + 1, second[task])
        count = np.where(alone | (rows["side"] == 0), ends[task] - first, 0)
        turn = (np.cumsum(count) - count) // AT_ONCE
        for cut in np.split(at, np.flatnonzero(turn[1:] != turn[:-1]) + 1):
            every = np.zeros(table.num_rows, dtype=np.int64)
            every[cut] = count[cut]
            yield told(rows, first, every)

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*held, batch])
            last = [table[c][-1].as_py() for c in key]
            ends_here = np.all([table[c].to_numpy() == v for c, v in zip(key, last, strict=True)], axis=0)
            cut = table.num_rows - int(ends_here.sum())
            if cut:
                yield from compare(table.slice(0, cut))
            held = table.slice(cut).to_batches()
        if held:
            yield from compare(pa.Table.from_batches(held))

    return dealt.repartition(*key).sortWithinPartitions(*key, "side").mapInArrow(run, "a long, b long").distinct()


def _cells(measured: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, the pivot of its cell, its distance to it; a pivot, and what links with none, is its own."""
    linked = measured.where("links")
    pivots = linked.select(F.col("a").alias("pivot")).distinct()
    inside = linked.join(pivots, linked["b"] == pivots["pivot"], "left_anti").groupBy("b").agg(F.min(F.struct("far", "a")).alias("to"))
    return nodes.select("node").join(inside, F.col("node") == F.col("b"), "left").select(
        "node", F.coalesce("to.a", "node").alias("cell"), F.coalesce("to.far", F.lit(0.0)).alias("far"))


class _Space:
    """What is known of the nodes, and the comparing of cells by their pivots."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, cells: DataFrame, size: int, percent: int) -> None:
        self.docs, self.nodes, self.cells, self.size, self.percent = docs, nodes, cells, size, percent
        self.reach = 1 - percent / 100
        self.radius = written(cells.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("members")))

    def near(self, members: DataFrame) -> DataFrame:
        """Pairs of cells (a, b) of open regions whose pivots are near enough, by sizes and parities, for members to link."""
        known = self.radius.join(self.nodes.select(F.col("node").alias("cell"), "n", "bits"), "cell")
        return _near(members, known, self.reach)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Links between the members of pairs of cells (a, b), as many as connect them if there are any.

        A cell with fewer members is the guest of the other one. A hub's window holds its members near enough to
        any guest and is sent once, whatever the number of guests; a guest sends its window to each of its hubs.
        """
        nearest = F.greatest(1 - (self.reach + F.col("a_radius") + F.col("b_radius")), F.lit(0.0))
        known = self.radius.withColumnRenamed("cell", "node").join(self.nodes.select("node", "n", "bits", "wide"), "node")
        possible = written(_possible(pairs, known, nearest, "radius", "members"))
        apart = _measured(self.docs, self.nodes, possible.select("a", "b"), self.size, self.percent).join(possible, ["a", "b"])
        wide = lambda hub, guest: F.struct(F.col(hub).alias("hub"), F.col(guest).alias("guest"), F.col(f"{hub}_radius").alias("hub_radius"), F.col(f"{guest}_radius").alias("guest_radius"))
        boundary = written(apart.where(~F.col("links") & (F.col("far") <= self.reach + F.col("a_radius") + F.col("b_radius") + SLACK) & (F.col("a_radius") + F.col("b_radius") > 0)).select(
            F.when(F.col("a_members") >= F.col("b_members"), wide("a", "b")).otherwise(wide("b", "a")).alias("ends"), F.col("far").alias("apart")).select("ends.*", "apart"))
        # members too near their pivot can't reach the other cell
        inside = self.cells.select("cell", F.col("node").alias("member"), "far")
        hubs = boundary.groupBy("hub").agg(F.min(F.col("apart") - F.col("guest_radius")).alias("least"))
        own = hubs.join(inside, hubs["hub"] == inside["cell"]).where(F.col("far") >= F.col("least") - self.reach - SLACK)
        guests = boundary.join(inside, boundary["guest"] == inside["cell"]).where(F.col("far") >= F.col("apart") - F.col("hub_radius") - self.reach - SLACK)
        window = lambda rows, root: rows.select(F.col("hub").alias("region"), F.col("member").alias("cell"), F.lit(root).cast("long").alias("root"), F.lit(1).alias("inner_n"), F.lit(1).alias("most_n"))
        # a hub's boundary is a region of members, dealt to the same blocks one level down
        members = written(window(own, 0).unionByName(window(guests, 1)))
        known = self.nodes.select(F.col("node").alias("cell"), F.lit(0.0).alias("radius"), "n", "bits")
        near = written(_near(_open(members), known, self.reach))
        found = apart.where("links").select("a", "b")
        return found if near.isEmpty() else found.unionByName(_measured(self.docs, self.nodes, near, self.size, self.percent).where("links").select("a", "b"))


def join(docs: DataFrame, percent: int = 80, size: int = 5, doc_id: str = "doc_id", text: str = "text") -> Join:
    """Links between all documents whose shingle sets have a Jaccard similarity of percent / 100 or more.

    A set's shingles are the distinct runs of `size` words (ASCII white space
    parts them, A-Z are lowered), the whole of a shorter text. Documents without words, or null,
    have no set and no link. Documents with equal sets are one node; `links`
    holds enough links between different nodes to give every component, each of them exact.
    Rows that repeat doc_id and text stay rows; a row without doc_id has a node
    but is not the one whose text is fetched. Other columns are left aside; an empty table gives empty tables.
    Sets and shingles are known by 64-bit hashes.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    told = written(_sets(docs, size))
    sets = told.where("chunk IS NULL").select("doc_id", "node", "n", "bits", "wide")
    nodes = written(sets.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide")))
    regions = _regions(docs.where("doc_id IS NOT NULL"), _classes(told), size, percent)
    in_order = Window.partitionBy("region").orderBy(F.col("inner").desc(), F.col("typical").desc(), "node")
    known = regions.withColumn("pivot", F.first("node").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "shared", F.first("inner").over(in_order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("before", F.lag("node").over(in_order)).withColumn(
        "after", F.lead("node").over(in_order))
    one = F.col("node") != F.coalesce("before", F.lit(None).cast("long"))
    rows = written(known.where(F.col("shared") & (one | (F.col("before").isNull() & F.col("after").isNotNull()))).select("region", "pivot", "node", "n", "inner"))
    votes = rows.where("node <> pivot").groupBy("node", "pivot").agg(F.count("*").alias("n"))
    likely = _possible(votes.select(F.col("pivot").alias("a"), F.col("node").alias("b"), "n"), nodes, F.lit(percent / 100))
    first = top_per_key(likely, ["b"], [F.col("n").desc(), F.col("a")], TRIED, "rank").select("a", "b")
    measured = _measured(docs, nodes, written(first), size, percent)
    links = measured.where("links").select("a", "b")
    roots = components(links)
    cells = written(_with_root(_cells(measured, nodes), roots))
    space = _Space(docs, nodes, cells.drop("root"), size, percent)
    members = rows.join(cells.select("node", "cell", "root"), "node").groupBy("region", "cell", "root").agg(
        F.min(F.when(F.col("inner"), F.col("n"))).alias("inner_n"), F.max("n").alias("most_n"))
    pairs = written(space.near(_open(members)))
    if not pairs.isEmpty():
        links = written(links.unionByName(space.links(pairs)).distinct())
        roots = components(links)
    return Join(sets.select("doc_id", "node", F.col("n").alias("n_shingles")), roots, links)


def _linked(first: list[np.ndarray], second: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of the first list link with which of the second."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (first, second)]
    cut = int(sizes[0].sum())
    _, at, times = np.unique(np.concatenate([*first, *second]), return_inverse=True, return_counts=True)
    dense = np.cumsum(times > 1) - 1  # shingles of one set alone are shared by none
    kept = times[at] > 1
    owner = [np.repeat(np.arange(len(n)), n)[k] for n, k in zip(sizes, (kept[:cut], kept[cut:]), strict=True)]
    column = [dense[at[:cut][kept[:cut]]], dense[at[cut:][kept[cut:]]]]
    shared = np.zeros((len(first), len(second)), dtype=np.int64)
    for low in range(0, int((times > 1).sum()), COLUMNS):
        has = []
        for n, rows, columns in zip(sizes, owner, column, strict=True):
            some = (columns >= low) & (columns < low + COLUMNS)
            has.append(np.zeros((len(n), COLUMNS), dtype=np.float32))
            has[-1][rows[some], columns[some] - low] = 1
        shared += (has[0] @ has[1].T).astype(np.int64)
    return 100 * shared >= percent * (sizes[0][:, None] + sizes[1][None, :] - shared)


def degrees(docs: DataFrame, nodes: DataFrame, roots: DataFrame, size: int, percent: int) -> DataFrame:
    """node, linked: the number of documents of other nodes that a node links with, every link counted.

    nodes: node, doc_id, n, copies (its documents). A component of up to BLOCK sets is one block; of a larger one, sets
    are in bands of size, a band being so wide that links go to the next one at most, and in blocks of a band by hash.
    """
    width = max(-math.log(percent / 100), 1e-3) * (1 + 1e-6)
    inside = roots.join(nodes, "node")
    total = inside.groupBy("root").agg(F.count("*").alias("total"))
    banded = inside.join(total, "root").withColumn("band", F.when(F.col("total") <= BLOCK, 0).otherwise(F.floor(F.log("n") / width)).cast("int"))
    parts = banded.groupBy("root", "band").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    own = written(banded.join(parts, ["root", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    to = lambda low, high, x, y, side: F.struct("root", F.col(low).alias("low"), F.col(high).alias("high"), x.alias("x"), y.alias("y"), side.cast("int").alias("side")).alias("to")
    among = own.select("node", "root", "band", "block", every("parts")).select("node", to(
        "band", "band", F.least("block", "other"), F.greatest("block", "other"), F.col("block") > F.col("other")))
    beside = parts.select("root", F.col("band").alias("next"), F.col("parts").alias("others"))
    up = own.join(beside.withColumn("band", F.col("next") - 1), ["root", "band"]).select("node", "root", "band", "next", "block", every("others")).select(
        "node", to("band", "next", F.col("block"), F.col("other"), F.lit(0)))
    down = own.join(beside.withColumn("band", F.col("next") + 1), ["root", "band"]).select("node", "root", "band", "next", "block", every("others")).select(
        "node", to("next", "band", F.col("other"), F.col("block"), F.lit(1)))
    tasks = among.unionByName(up).unionByName(down).groupBy("node").agg(F.collect_list("to").alias("to"))
    wanted = tasks.join(nodes.select("node", "doc_id", "copies"), "node")
    key = ["root", "low", "high", "x", "y"]
    texts = wanted.join(_texts(docs, own), "doc_id").select("node", "copies", "text", *(F.col("to")[c].alias(c) for c in [*key, "side"]))
    types = [pa.int64(), *[pa.int32()] * 5]

    def spread(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                node, copies, text, *to = (c[i].as_py() for c in batch.columns)
                found = shingles(text, size)
                if node != node_of(found):
                    continue  # another document of that id
                for k in range(0, len(to[0]), 64):
                    part = [pa.array(values[k : k + 64], kind) for values, kind in zip(to, types, strict=True)]
                    m = len(part[0])
                    yield pa.RecordBatch.from_arrays([*part, pa.array([node] * m, pa.int64()), pa.array([copies] * m, pa.int64()), pa.array([found.tobytes()] * m, pa.binary())],
                                                     names=[*key, "side", "node", "copies", "found"])

    def count(batches):
        def told(where, held):
            alone = where[1] == where[2] and where[3] == where[4]
            sides = (held[0], held[0]) if alone else (held[0], held[1])
            if not sides[0] or not sides[1]:
                return
            first, second = ([np.frombuffer(raw, dtype=np.uint64) for _, raw in side.values()] for side in sides)
            links = _linked(first, second, percent)
            if alone:
                np.fill_diagonal(links, False)
            weights = [np.array([copies for copies, _ in side.values()], dtype=np.int64) for side in sides]
            done = [(list(sides[0]), links @ weights[1])] + ([] if alone else [(list(sides[1]), links.T @ weights[0])])
            for names, sums in done:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sums, pa.int64())], names=["node", "linked"])

        where, held = None, ({}, {})
        for batch in batches:
            for *now, side, node, copies, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != where:
                    if where is not None:
                        yield from told(where, held)
                    where, held = now, ({}, {})
                held[side][node] = (copies, raw)
        if where is not None:
            yield from told(where, held)

    sets = texts.mapInArrow(spread, "root long, low int, high int, x int, y int, side int, node long, copies long, found binary")
    dealt = sets.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def classes(docs: DataFrame, percent: int = 80, size: int = 5, doc_id: str = "doc_id", text: str = "text", count_links: bool = True) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, or its own), n_links.

    n_links counts all other documents (distinct doc_ids of a set) that it links with, copies with an equal set among
    them. Without count_links the column is left out, and so is the work for it.
    A row without doc_id has no component, and no link.
    """
    with shuffles_removed(docs.sparkSession):
        done = join(docs, percent, size, doc_id, text)
        named = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
        nodes = written(done.documents.where(named).groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.count_distinct("doc_id").alias("copies")))
        rooted = written(_with_root(nodes.withColumnRenamed("doc_id", "least"), done.roots))
        least = rooted.groupBy("root").agg(F.min("least").alias("component"))
        known = rooted.join(least, "root").select(F.col("node").alias("of"), "component", "copies")
        out = ["doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")]
        if count_links:
            texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
            linked = written(degrees(texts, nodes, done.roots, size, percent)).withColumnRenamed("node", "linked_of")
            known = known.join(linked, F.col("of") == F.col("linked_of"), "left").select("of", "component", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
            out.append(F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).alias("n_links"))
    rows = done.documents
    return rows.join(known, rows["node"] == known["of"], "left").select(*out)


by_value(__name__)
