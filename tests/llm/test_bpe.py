from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from certloom.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def codec():
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        return bpe.Codec(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(queries.TOKENIZER)


def ids_of(codec, texts):
    return [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(texts)]


TEXTS = [
    "", " ", "a", "a b", "  two  blanks ", "line\n\nline \n x", "it's we'll 12 345", "日本語 éè ñ", "<|endoftext|>", "x<|endoftext|> y<|endoftext|><|endoftext|>",
    "word " * 40_000, "\n word" * 30_000, "a" * 50_000, "ÃÂ" * 9_000, "-=" * 20_000, " " * 70_000, " x y​z\x85w",
]


def test_ids_are_the_library_s(codec, library):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400)))
                     for alphabet in ("ab", "a -=", "éè 1'sdt", "\n \t x", "-=*#", "的日a", "  a.\n") for _ in range(60)]
    want = library.encode_batch(texts, add_special_tokens=False)
    got = ids_of(codec, texts)
    assert got == [e.ids for e in want]
    packed = list(codec.encode(texts))
    assert ["".join(codec.decode(p)) for p in packed] == [library.decode(e.ids, skip_special_tokens=False) for e in want]


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(6)
    for _ in range(200):
        ids = [rng.randrange(50_257) for _ in range(40)]
        assert "".join(codec.decode(np.array(ids, dtype="<u4").tobytes())) == library.decode(ids, skip_special_tokens=False)


def test_stream_needs_only_the_lookahead(codec):
    rng = random.Random(7)
    for _ in range(30):
        data = "".join(rng.choice("etaoinsrhl") for _ in range(9_000)).encode()
        held = [i for part in codec.transduce(data[i : i + 700] for i in range(0, len(data), 700)) for i in part]
        assert held == codec.merge(data)
    assert 0 < codec.lookahead < 2_000


def test_lookahead_bounds_how_far_a_suffix_reaches_back(codec):
    rng = random.Random(8)
    for alphabet in ("etaoin", "ÃÂ", "-", " =", "aeh"):
        for _ in range(40):
            text = "".join(rng.choice(alphabet) for _ in range(1_500)).encode()
            cut = rng.randint(700, 1_400)
            a, b = codec.merge(text[:cut]), codec.merge(text)
            ends_a, ends_b = np.cumsum(codec.width[a]).tolist(), np.cumsum(codec.width[b]).tolist()
            final = cut - codec.lookahead
            assert [e for e in ends_a if e <= final] == [e for e in ends_b if e <= final]


def test_query(spark, library):
    rows = {r["doc_id"]: r for r in queries.op2(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        got = rows[d["doc_id"]]
        assert got["n_tokens"] == len(ids)
        assert got["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edges(spark, library):
    rows = [(1, None, "x"), (2, "", None), (3, "same text", "x"), (3, "same text", "x"), (None, "<|endoftext|>", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    out = bpe.decode(bpe.encode(docs, queries.TOKENIZER), queries.TOKENIZER, text="again").collect()
    assert sorted((r["doc_id"] or 0, r["again"], bytes(r["ids"]) == b"") for r in out) == [
        (0, "<|endoftext|>", False), (1, "", True), (2, "", True), (3, "same text", False), (3, "same text", False)]
    assert bpe.encode(docs.where("doc_id > 9"), queries.TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(docs, queries.TOKENIZER, ids="Decoded")
