"""Urel values of long texts."""

from __future__ import annotations

import random
import re

from certloom.operators import extract as ex


def test_urel_windows_one_per_urel(spark):
    rng = random.Random(3)
    bits = ["Urel=1.5%", "urel = 2", "Urel=", "电容", "校准", "\n", " ", "x" * 9, "y" * 31, "a" * 40]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", ex.urel_windows("t").alias("w")).collect()
    value = re.compile(r"urel\s*=\s*([+-]?\d+(?:\.\d+)?)\s*%?", re.IGNORECASE)
    every = re.compile(r"(?=([\s\S]{0,40}urel\s*=\s*[+-]?\d+(?:\.\d+)?\s*%?[\s\S]{0,40}))", re.IGNORECASE)

    def first(windows):
        return next((value.search(w)[1] for w in windows if "电容" in w), None)

    for row in rows:
        assert len(row["w"]) <= len(re.findall("urel", row["t"], re.IGNORECASE))
        assert first(row["w"]) == first(every.findall(row["t"]))
