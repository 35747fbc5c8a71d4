"""Aligned tokenizations against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from certloom.llm import align

A, B = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def tokens_of():
    a, b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}

    def run(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        whole = (" " + text).encode()
        return None if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole else (ids_a, bytes_a, ids_b, bytes_b)

    return run


def plain(rows):
    run, held, counts = tokens_of(), [], Counter()
    for _, text in rows:
        made = run(text) if text else None
        if made is None:
            held.append(None)
            continue
        ids_a, bytes_a, ids_b, bytes_b = made
        ends_a = {sum(map(len, bytes_a[: k + 1])): k for k in range(len(bytes_a))} if len(bytes_a) < 400 else dict(zip(np.cumsum([*map(len, bytes_a)]).tolist(), range(len(bytes_a)), strict=True))
        ends_b = dict(zip(np.cumsum([*map(len, bytes_b)]).tolist(), range(len(bytes_b)), strict=True))
        cuts = sorted(ends_a.keys() & ends_b.keys())
        links = [(ids_a[ends_a[c]], ids_b[ends_b[c]]) for c in cuts]
        counts.update(links)
        groups, x, y = [], 0, 0
        for c in cuts:
            i, j = ends_a[c] + 1, ends_b[c] + 1
            groups.append(",".join(map(str, ids_a[x:i])) + "|" + ",".join(map(str, ids_b[y:j])))
            x, y = i, j
        held.append((len(ids_a), len(ids_b), links, ";".join(groups)))
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for (key, _), made in zip(rows, held, strict=True):
        if made is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, text = made
            out.append((key, n_a, n_b, len(links), len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in align.align(df, A, B).collect()), key=str)


def test_alignment_equals_brute_force(spark):
    rng = random.Random(4)
    pool = ["the", "house", "Übermut", "日本語", "naïve", "🙂🙃", "don't", "1234567", "<|endoftext|>", "<s>", "<0x41>", "a\tb", "\n\n", "  ", "…", "x\x00y", "ﬁne", "é", "👩‍👩‍👧"]
    rows = [(i, rng.choice([" ", ""]).join(rng.choice(pool) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, " "), (503, "with ▁ inside"), (504, "   lead"), (505, "\n"), (7, "the house"), (7, "the house"), (None, "the house")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == plain(rows)


def test_very_long_texts_clashing_columns_and_empty_tables(spark):
    rng = random.Random(6)
    words = ["lorem", "ipsum", "dolor  sit", "amet,\n", "größer", "日本"]
    rows = [(1, " ".join(rng.choice(words) for _ in range(40_000))), (2, "x" * 3000 + " y"), (3, " ".join(["again"] * 20_000))]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, batch int, links string")
    assert found(df) == plain(rows)
    assert found(df.where(F.lit(False))) == []


def test_ids_are_those_of_the_file():
    """Every token's text, and runs of tokens that meet nowhere in prose, by the file's own library."""
    pair = align.Pair(open(A, encoding="utf-8").read(), open(B, "rb").read())
    own = tokenizers.Tokenizer.from_file(A)
    own.encode_special_tokens = True
    texts = [t.decode("utf-8", "replace") for t in pair.bytes_a]
    rng = random.Random(9)
    texts += ["".join(rng.choice(texts).strip() for _ in range(rng.randint(2, 5))) for _ in range(60_000)]
    texts += ["".join(rng.choice("aethrsin") for _ in range(rng.randint(1, 40))) for _ in range(20_000)]
    wanted = [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
    assert [pair.a.encode_ordinary(t) for t in texts] == wanted


@pytest.mark.parametrize("stretch", [1, 7, 64, 1 << 20])
def test_lockstep_finds_every_common_end(stretch):
    rng = np.random.default_rng(2)
    end = 5000
    a, b = (np.unique(np.append(rng.choice(np.arange(1, end), n, replace=False), end)) for n in (1700, 900))
    i, j = align.lockstep(a, b, stretch)
    both = np.intersect1d(a, b)
    assert (a[i] == both).all() and (b[j] == both).all()
    assert all(len(x) == 0 for x in align.lockstep(a[:0], b[:0], stretch))
