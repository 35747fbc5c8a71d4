"""Fingerprints and their classes against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from certloom.llm import simhash


def plain_print(text):
    """Bit by bit, as the definition says."""
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else " " if c in " \t\n\v\f\r" else c for c in text or "").split(" ") if w]
    if not found:
        return 0
    runs = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(rows):
    """(doc_id, hex, component) by comparing all pairs."""
    prints = [plain_print(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(i):
        while at[i] != i:
            i = at[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                at[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((key, f"{prints[i]:016x}", least.get(top(i))) for i, (key, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in simhash.classes(df, **options).collect()), key=str)


def corpus(n=160):
    rng = random.Random(5)
    vocabulary = ["w" + str(i) for i in range(300)] + ["Ärger", "日本", "ß", "naïve"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        base = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(base)))
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus() + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "ONE"), (905, "one two"), (906, "a\x85b c\xa0d e f"), (5, "repeated id"), (None, "one"), (None, "nothing like it at all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert found(df) == plain_classes(rows)


@pytest.mark.parametrize("cell", [2, 8])
def test_hot_keys_give_the_same(spark, cell):
    rows = corpus(200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, cell=cell) == plain_classes(rows)


def test_pigeonholes_cover_three_bits():
    rng = random.Random(1)
    masks = simhash.block_masks()
    whole = (1 << 64) - 1
    for _ in range(3000):
        differing = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3)))
        kept = [(k, left) for k, left in masks if not differing & k & whole]
        assert kept
        assert all(any(not differing & p & whole for p in simhash.part_masks(left)) for _, left in kept)
    assert all((k ^ left) & whole == whole for k, left in masks)


def test_links_of_a_dense_ball(spark):
    """All prints within two bits of one, and a chain of steps of three bits that leads away from it."""
    center = 0x0123456789ABCDEF
    ball = {center ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(i, 24)}
    chain = [center]
    for i in range(30, 60, 3):
        chain.append(chain[-1] ^ (7 << i))
    far = center ^ ((1 << 40) - 1) << 20
    prints = sorted({*ball, *chain, far & ((1 << 64) - 1)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "print long")
    pairs = simhash.links(df, cell=64).collect()
    number = {s: i for i, s in enumerate(signed)}
    got = simhash.roots(np.array([number[r["a"]] for r in pairs]), np.array([number[r["b"]] for r in pairs]), len(signed))
    values = np.array(prints, dtype=np.uint64)
    a, b = np.nonzero(np.bitwise_count(values[:, None] ^ values[None]) <= 3)
    assert (got == simhash.roots(a, b, len(signed))).all()
    assert len(pairs) <= 10 * 5 * 2 * len(signed)


def test_long_and_empty(spark):
    long = " ".join(f"token{i % 977}" for i in range(60_000))
    df = spark.createDataFrame([(1, long, "x"), (2, long, "y")], "doc_id long, text string, component_id string")
    assert found(df) == [(1, f"{plain_print(long):016x}", 1), (2, f"{plain_print(long):016x}", 1)]
    assert found(df.where(F.lit(False))) == []
