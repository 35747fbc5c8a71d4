"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from certloom.llm import spelling


def one_edit(a, b):
    """By trying every edit of a."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, found in near.items():
        if found and counts[best := min(found, key=lambda x: (-counts[x], x))] >= 10 * counts[w]:
            form[w] = best

    def last(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), last(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items()), key=str)


def corpus():
    """Words over few letters, of which many are near; Zipf counts, so that forms chain."""
    rng = random.Random(3)
    bases = ["".join(rng.choice("abcé") for _ in range(rng.randint(6, 11))) for _ in range(40)]
    words = []
    for base in bases:
        words += [base] * rng.choice([1, 3, 40])
        for _ in range(12):
            i, c = rng.randrange(len(base)), rng.choice("abcé÷")
            words += [rng.choice([base[:i] + c + base[i:], base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :]])] * rng.choice([1, 2, 2, 3])
    words += ["aaaaaaa"] * 2000 + ["aaaaaaaa"] * 200 + ["aaaaaaaaa"] * 20 + ["aaaaaaaaaa"] * 2
    rng.shuffle(words)
    return [(i, " ".join(words[i * 20 : i * 20 + 20]).upper() if i % 7 == 0 else "-".join(words[i * 20 : i * 20 + 20])) for i in range(len(words) // 20 + 1)]


def found(df, **options):
    return sorted((tuple(r) for r in spelling.variants(df, **options).collect()), key=str)


@pytest.mark.parametrize("tile", [512, 4])
def test_variants_equal_brute_force(spark, tile):
    rows = corpus() + [(None, "withoutid withoutid withoutidx"), (3, None), (4, ""), (5, "1234567 7654321"), (6, "Çavalière çavalière ÇAVALIÈRE")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert found(df, tile=tile) == plain(rows)


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    rows = [(1, "perhaps " * 30_000 + "perhpas " * 3), (1, "perhaps perhasp perhasp"), (1, "perhaps perhasp perhasp")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string")
    assert found(df) == plain(rows)
    assert found(df.where(F.lit(False))) == []


def test_single_edits_are_those_of_the_definition():
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 9))) for _ in range(150)})
    seen = set()
    for longer in range(7, 11):
        for tail in (False, True):
            t = spelling.Tile(words, np.ones(len(words)), np.full(len(words), longer), np.full(len(words), tail), np.zeros(len(words)))
            pairs = {(words[i], words[j]) for i, j in zip(*np.nonzero(spelling.single_edits(t, t)), strict=True)}
            assert not pairs & seen
            seen |= pairs
    assert seen == {(a, b) for a in words for b in words if one_edit(a, b)}
