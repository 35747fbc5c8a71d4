"""Keywords of documents: counted and ranked inside a row."""

from __future__ import annotations

import re

import __spark_entry__ as entry
from certloom import vocab
from certloom.operators import matching

SF = "/root/testdata/sf0.001"


def test_a_row_passes_on_its_strongest_only(spark):
    found = entry.queries()["keyword_candidates"](spark, SF)
    plan = found._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Generate":
        plan = plan.children().head()
    made = plan.generator().sql()
    assert "slice" in made and "sort_array" in made


def test_documents_of_several_rows_and_none(spark):
    rows = [
        (1, "abc abc 110kV 12.5\nPage 1 of 2\n电缆"), (2, "zz yy"), (2, "yy\r\nyy xx"), (None, "nn mm"), (None, "mm"), (3, None), (4, "校准 9 99"),
        (5, " ".join(f"w{n:02d}" for n in range(30)))]
    out = matching.keyword_candidates(spark.createDataFrame(rows, "doc_id int, text string"), "doc_id", "text").orderBy("doc_id", "rank").collect()
    by_doc = {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append((r["rank"], r["token"], r["count"], r["boost"]))
    assert by_doc == {
        None: [(1, "mm", 2, 0), (2, "nn", 1, 0)],
        1: [(1, "110kV", 1, 1), (2, "电缆", 1, 1), (3, "abc", 2, 0)],
        2: [(1, "yy", 3, 0), (2, "xx", 1, 0), (3, "zz", 1, 0)],
        5: [(n + 1, f"w{n:02d}", 1, 0) for n in range(20)]}


def test_boosted_tokens_hold_a_sign():
    for token in ("110kV", "35KV", "220v", "10V", "kV", "电缆", "局放", "衰减"):
        assert any(re.search(p, token) for p in vocab.KEYWORD_BOOSTS)
        assert not token.isascii() or any(sign in token for sign in vocab.KEYWORD_BOOST_SIGNS)


def test_noise_patterns_hold_whole_lines():
    assert all(p.startswith("^") and p.endswith("$") and "|" not in p for p in vocab.KEYWORD_NOISE_LINES)
