from __future__ import annotations

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import pytest

from certloom.llm import components, jaccard, queries, shingles

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SF = "/root/testdata/sf0.001"


def shingle_set(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)])


def brute(rows):
    sets, parent, seen = [(i, shingle_set(t)) for i, t in rows], {i: i for i, _ in rows}, defaultdict(list)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, s) in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(seen[x])
            seen[x].append(k)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                a, b = root(i), root(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets}


def corpus(seed, small=False):
    """Copies, chains of edits, a passage in a third of all texts, short texts, ties at exactly four fifths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    passage, texts = [word() for _ in range(60)], []
    for i in range(60 if small else 160):
        base = [word() for _ in range(rng.choice([1, 2, 4, 5, 6, 9, 14, 30, 90, 200]))]
        if i % 3 == 0:
            at = rng.randrange(len(base) + 1)
            base = base[:at] + passage + base[at:]
        for _ in range(rng.choice([1, 1, 1, 2, 5])):
            texts.append(" ".join(base))
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 3])):
                base[rng.randrange(len(base))] = word()
    texts += ["", "  \n ", "One", "one", "ONE two"] + [" ".join(passage[:13])] * 40
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert len(got) == len(rows)


@pytest.mark.parametrize(("cells", "at_once"), [(256, 1 << 17), (3, 5), (1, 1)])
def test_large_regions_are_dealt_to_blocks(spark, monkeypatch, cells, at_once):
    """With tiny blocks every region of cells is dealt to several tasks; the result is the same."""
    monkeypatch.setattr(jaccard, "CELLS", cells)
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rng = random.Random(4)
    common = [f"c{i}" for i in range(30)]
    rows = [(i, " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(12)])) for i in range(14)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(3)]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op3(spark, SF).collect()}
    assert got == brute([(d["doc_id"], d["text"]) for d in docs])


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b c d e f", 3), (3, "a b c d e f", 3), (None, "a b c d e f", 4), (4, "A B C D E F", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    out = sorted(((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard.classes(docs).collect()), key=str)
    assert out == [(0, 2, None), (1, 0, 1), (2, 0, 2), (3, 2, 3), (3, 2, 3), (4, 2, 3)]
    assert jaccard.classes(docs.where("doc_id > 9")).count() == 0


def test_linked_sets_share_regions():
    import numpy as np

    rng = random.Random(3)
    classes = np.array([rng.randrange(4) for _ in range(1 << 12)] * (shingles.COUNTERS >> 12), dtype=np.uint8)
    for _ in range(400):
        n = rng.randint(3, 400)
        a = [rng.getrandbits(64) for _ in range(n)]
        b = a + [rng.getrandbits(64) for _ in range(rng.randint(0, n // 4))]
        while 100 * (len(set(a) & set(b)) - 1) >= 80 * len(set(a) | set(b)) and rng.random() < 0.97:
            b.pop(rng.randrange(n // 2 + 1))
        if set(a) == set(b) or 100 * len(set(a) & set(b)) < 80 * len(set(a) | set(b)):
            continue
        (x, x_inner), (y, y_inner) = (shingles.rarest(np.unique(np.array(s, dtype=np.uint64)), classes, 80) for s in sorted((a, b), key=len))
        assert set(x[:x_inner].tolist()) & set(y.tolist())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (103, 102), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_links(rows):
    """For each document, the other documents at a similarity of four fifths or more, equal sets among them."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    return {i: sum(1 for j, t in sets if j != i and s and t and 100 * len(s & t) >= 80 * len(s | t)) for i, s in sets}


@pytest.mark.parametrize("block", [256, 3])
def test_every_link_is_counted(spark, monkeypatch, block):
    """A group of near copies, links in chains, equal sets; with tiny blocks every component is dealt to several."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    group = [(1000 + i, " ".join([*base, *(f"x{rng.randrange(9)}" for _ in range(rng.randrange(12)))])) for i in range(40)]
    rows = corpus(5, small=True) + group
    got = {r["doc_id"]: r["n_links"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)
    assert max(got[i] for i, _ in group) == 39


def test_links_of_repeated_rows(spark):
    """Rows that repeat doc_id and text are one document; a row without doc_id has no link and gives none."""
    rows = [(3, "a b c d e f"), (3, "a b c d e f"), (4, "A B C D E F"), (None, "a b c d e f"), (5, "x"), (6, "")]
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["n_links"]) for r in got) == [(0, 0), (3, 1), (3, 1), (4, 1), (5, 0), (6, 0)]


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {f.name for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def test_shuffles_go_with_their_jobs(spark):
    """No job of the join leaves shuffle files behind; the caller's setting is the same before and after."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffle_files(spark), spark.conf.get(key, None)
    classes = jaccard.classes(spark.createDataFrame(corpus(6, small=True), "doc_id long, text string"))
    end = time.time() + 20  # files are removed a moment after the job
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(key, None) == setting
    assert classes.count() == len(corpus(6, small=True))


def test_texts_of_no_pair_are_left_out(spark, monkeypatch):
    """Before their shuffle only the texts of documents in pairs are left; with more ids than are sent, all, and the same classes."""
    docs = spark.createDataFrame(corpus(7, small=True), "doc_id long, text string")
    wanted = docs.where("doc_id IN (3, 8)").select("doc_id")
    assert sorted(r["doc_id"] for r in jaccard._texts(docs, wanted).collect()) == [3, 8]
    few = jaccard.classes(docs).collect()
    monkeypatch.setattr(jaccard, "SENT", 0)
    assert jaccard._texts(docs, wanted).count() == docs.count()
    assert sorted(jaccard.classes(docs).collect()) == sorted(few)


def test_long_sets_of_nothing_in_common_are_not_measured(spark, monkeypatch):
    """Texts too long for the short parities that share a passage in their regions, as counters of a large corpus are all alike:
    only the pair that links is measured, with the same classes."""
    import numpy as np

    monkeypatch.setattr(jaccard, "_classes", lambda sets: np.zeros(shingles.COUNTERS, dtype=np.uint8))
    rng = random.Random(12)
    passage = [f"p{i}" for i in range(30)]
    rows = [(i, " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(3000))])) for i in range(8)]
    rows.append((50, rows[5][1] + " end"))
    measured, measure = [], jaccard._measured

    def count(docs, nodes, pairs, *rest):
        measured.append(pairs.count())
        return measure(docs, nodes, pairs, *rest)

    monkeypatch.setattr(jaccard, "_measured", count)
    got = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
    assert sum(measured) == 1


def test_wide_parities_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(2)
    for n in (600, 5000):
        a = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 2, dtype=np.uint64)])
        for width in (512, jaccard.WIDE):
            bits = [np.unpackbits(np.array(shingles.parities(x, width)).view(np.uint8)) for x in (a, b)]
            assert len(bits[0]) == width
            assert (bits[0] != bits[1]).sum() <= len(set(a.tolist()) ^ set(b.tolist()))
