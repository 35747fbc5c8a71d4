"""Patterns of word lists: few words are tried at a place, with the same hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from certloom import vocab
from certloom.functions import text as tx

TEXTS = ["", "a", "型号", "大型号码", "校准地点：", "证书编号", "mod", "xmodelx", "a.b", "a]b^c-d\\e", "Serial", "te", "tel", "😀ab", "x😀", "制造厂/商"]
WORDS = [[*tx.LABEL_TOKENS_LONGEST_FIRST], ["a.b", "]b^", "\\e", "-d"], ["😀a", "tel", "telephone"], ["", "x"], list(vocab.LABEL_LINE_MARKS)]


def test_hits_are_those_of_the_words(spark):
    frame = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for words in WORDS:
        found = frame.select("t", tx.any_of(F.col("t"), words).alias("in"), F.col("t").rlike("^" + tx._one_of_words(words) + "$").alias("is")).collect()
        for row in found:
            assert row["in"] == any(w in row.t for w in words), (row, words)
            assert row["is"] == (row.t in words), (row, words)


def test_a_place_is_left_at_its_first_character():
    pattern = tx._contains_any(["型号规格", "型号", "model", "manufacturer"])
    assert pattern == "(?=[型m])(?:型(?:号)|m(?:odel|anufacturer))"
    assert tx._POOR_LABEL.startswith("^$|(?=[")
