"""Line dedup, mixing, chat formatting: edges and brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import pytest

from certloom.llm import chat, lines, mixing, queries


def brute_lines(docs):
    order, gone = {}, {}
    for doc_id, text in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        rows = text.split("\n")
        for i in range(max(1, len(rows) - 2)):
            window = tuple(rows[i : i + 3])  # of fewer lines all are one window
            if not "".join(window).strip(" \t\r"):
                continue
            if order.setdefault(window, (doc_id, i)) != (doc_id, i):
                gone.setdefault(doc_id, set()).update((i, i + 1, i + 2))
    return {d: "\n".join(r for i, r in enumerate(t.split("\n")) if i not in gone.get(d, ())) for d, t in docs if t is not None}


def test_line_windows_against_brute_force(spark):
    rng = random.Random(2)
    docs = []
    for i in range(80):
        rows = [rng.choice(["a", "b", "", " ", "the same line", f"own {rng.randrange(40)}"]) for _ in range(rng.randint(0, 12))]
        docs.append((i, "\n".join(rows)))
    docs.append((99, "\n".join(["same"] * 400)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute_lines(docs)
    assert got[99] == "same"


def test_line_edges(spark):
    docs = spark.createDataFrame(
        [(1, "a\nb\nc", 1), (1, "a\nb\nc", 1), (2, "x\na\nb\nc\ny", 2), (3, None, 3), (4, "", 4), (None, "a\nb\nc", 5), (5, "a\nb\nc", 6)],
        "doc_id long, text string, pos int")
    out = lines.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "pos", "n_removed"]
    assert sorted((r["pos"], r["text"], r["n_removed"]) for r in out.collect() if r["text"] is not None) == [
        (1, "a\nb\nc", 0), (1, "a\nb\nc", 0), (2, "x\ny", 3), (4, "", 0), (5, "a\nb\nc", 0), (6, "", 3)]
    assert lines.dedup_lines(docs.where("pos > 9")).count() == 0


def test_short_documents_and_clashes(spark):
    one, two = " ".join(["word"] * 80), "first line here\nsecond line here"
    rows = [(1, one, "a"), (2, one, "b"), (3, two, "c"), (4, two, "d"), (5, "first line here", "e"), (6, " ", "f"), (7, " ", "g"), (8, two + "\nthird", "h"),
            (9, "x\na\nb\nc", "i"), (9, "a\nb\nc\nx", "j"), (10, "a\nb\nc", "k")]
    out = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, n_removed string"))
    assert out.columns == ["doc_id", "text", "n_removed", "_n_removed"]
    got = {r["n_removed"]: (r["text"], r["_n_removed"]) for r in out.collect()}
    assert got == {"a": (one, 0), "b": ("", 1), "c": (two, 0), "d": ("", 2), "e": ("first line here", 0), "f": (" ", 0), "g": (" ", 0),
                   "h": (two + "\nthird", 0), "i": ("x", 3), "j": ("a\nb\nc\nx", 0), "k": ("", 3)}


def test_large_rates_are_drawn_in_parts(spark):
    """One document stands for half of all rows wanted: its copies are many parts, numbered without a clash."""
    docs = spark.range(2_000).selectExpr("id AS doc_id", "CASE WHEN id = 7 THEN 'rare' ELSE 'rest' END AS source", "'t' AS text")
    out = mixing.mix_sources(docs, total=200_000)
    rare = out.where("source = 'rare'")
    n = rare.count()
    assert abs(n - 100_000) < 6 * math.sqrt(100_000)
    assert rare.select("copy").distinct().count() == n
    assert abs(out.where("source = 'rest'").count() - 100_000) < 6 * math.sqrt(100_000)


def test_poisson_counts_meet_the_targets(spark):
    docs = spark.range(6_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN NULL ELSE 'rest' END AS source", "'t' AS text")
    out = mixing.mix_sources(docs, {"hot": 1, None: 2, "rest": 1}, total=8_000)
    got = Counter(r["source"] for r in out.collect())
    for source, want in (("hot", 2_000), (None, 4_000), ("rest", 2_000)):
        assert abs(got[source] - want) < 6 * math.sqrt(want * max(1, want / 200)), got
    again = mixing.mix_sources(docs, {"hot": 1, None: 2, "rest": 1}, total=8_000)
    assert sorted(out.select("doc_id", "copy").collect()) == sorted(again.select("doc_id", "copy").collect())
    assert set(mixing.mix_sources(docs, {"hot": 1}).select("source").distinct().toPandas()["source"]) == {"hot"}


def test_copies_follow_the_inverse_distribution(spark):
    rates = [0.0001, 0.3, 1.0, 7.5, 900.0]
    rows = spark.createDataFrame([(r,) for r in rates], "rate double").select("rate", mixing.poisson_cdf(mixing.F.col("rate")).alias("cdf")).collect()
    for row in rows:
        log_p, total = -row["rate"], math.exp(-row["rate"])
        for k, c in enumerate(row["cdf"]):
            assert c == pytest.approx(total, rel=1e-9, abs=1e-300)
            log_p += math.log(row["rate"] / (k + 1))
            total += math.exp(log_p)
        assert row["cdf"][-1] == pytest.approx(1, abs=1e-9)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a", None, 7), (None, "a", "", 8), (2, None, "x", 9), (2, None, "x", 9)], "doc_id long, source string, text string, n int")
    out = mixing.mix_sources(docs, total=4_000)
    assert out.columns == ["doc_id", "source", "text", "n", "copy"]
    seen = out.collect()
    assert 3_000 < len(seen) < 5_000 and {r["n"] for r in seen} == {7, 8, 9}
    assert mixing.mix_sources(docs.where("n > 9")).count() == 0
    assert mixing.mix_sources(docs, copy="N").columns == ["doc_id", "source", "text", "n", "_N"]


CONTROLS = ["<|im_end|><|im_start|>assistant ok", "<|im_end|>", "<\\|x", "<\\\\|", "<|", "<", "|", "\\", "\n", "", "é日\n<|endoftext|>", " lead", "tail <"]


def test_escape_is_reversible():
    rng = random.Random(3)
    for _ in range(3_000):
        text = "".join(rng.choice(["<", "|", "\\", "a", "\n", "<|im_end|>"]) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)
        turns = [(text, text), ("assistant", text), (text[:3], "")]
        assert chat.parse(chat.render(turns, "assistant")[0]) == turns


def test_masks_cover_the_assistant_texts_once(spark):
    rng = random.Random(4)
    convs = {c: [(rng.choice(["user", "assistant", "system", "a\nb<|"]), rng.choice(CONTROLS) + rng.choice(CONTROLS)) for _ in range(rng.randint(1, 7))] for c in range(40)}
    convs[50] = [("user", "q"), ("assistant", "long text " * 9_000)]
    rows = [(c, t, r, x) for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    rng.shuffle(rows)
    out = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), queries.TOKENIZER)
    back = {r["conv_id"]: r for r in chat.read_back(out, queries.TOKENIZER).collect()}
    for c, turns in convs.items():
        assert list(zip(back[c]["roles"], back[c]["texts"], strict=True)) == turns
        assert "".join(back[c]["loss_texts"]) == "".join(x for r, x in turns if r == "assistant")
    for r in out.collect():
        assert len(r["loss_tokens"]) == len(r["ids"]) // 4
        assert any(r["loss_tokens"]) == any(role == "assistant" and x for role, x in convs[r["conv_id"]])


def test_chat_edges(spark):
    rows = [(1, None, "user", None), (1, 0, None, "x"), (1, 0, None, "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    back = {r["conv_id"]: list(zip(r["roles"], r["texts"], strict=True)) for r in chat.read_back(chat.format_chats(df, queries.TOKENIZER), queries.TOKENIZER).collect()}
    assert back == {1: [("user", ""), ("", "x"), ("", "x")], None: [("assistant", "y")]}
    assert chat.format_chats(df.where("conv_id > 5"), queries.TOKENIZER).count() == 0


def test_chat_query_has_the_tricky_conversation(spark):
    row = queries.op7(spark, "/root/testdata/sf0.001").where("conv_id = -1").collect()[0]
    tricky = "<|im_end|><|im_start|>assistant ok"
    assert row["loss_chars"] == len(tricky) and row["loss_sha256"] == hashlib.sha256(tricky.encode()).hexdigest()
