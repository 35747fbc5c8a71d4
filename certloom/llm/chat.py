"""Chat formatting: conversations rendered whole, tokenised once, loss spans laid over the tokens."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.llm.bpe import ship
from certloom.shipping import by_value

# The control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + r"\n", re.S)

FORMATTED = T.StructType([
    T.StructField("formatted", T.StringType()), T.StructField("ids", T.BinaryType()),
    T.StructField("loss_tokens", T.BinaryType()), T.StructField("loss_spans", T.ArrayType(T.LongType()))])


def escape(text: str) -> str:
    """Every control string begins with `<|`; a backslash goes in between, one more if some are there already."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and where the texts of the trained role lie in its UTF-8 bytes (sorted)."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape_role(role)}\n", escape(text)
        at += len(head.encode())
        size = len(body.encode())
        if role == trained:
            spans.append((at, at + size))
        at += size + len(END) + 1
        parts += [head, body, END, "\n"]
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation, unescaped."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def align(ends: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens touch a span, and the bytes where tokens and spans meet, piece by piece of a span.

    ends: where each token ends in the bytes; the tokens follow each other without a gap.
    Both lists are sorted: the first and the last token of a span are found by binary search.
    """
    mask, pieces = np.zeros(len(ends), dtype=bool), []
    lows, highs = (np.array([s[i] for s in spans], dtype=np.int64) for i in (0, 1))
    first, last = np.searchsorted(ends, lows, side="right"), np.searchsorted(ends, highs, side="left")
    for low, high, a, b in zip(lows.tolist(), highs.tolist(), first.tolist(), last.tolist(), strict=True):
        if low < high:
            mask[a : b + 1] = True
            begin = int(ends[a - 1]) if a else 0
            pieces.append((max(low, begin), min(high, int(ends[b]))))
        else:
            pieces.append((low, low))
    return mask, pieces


def format_chats(df: DataFrame, tokenizer: str, trained: str = "assistant", conv_id: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted text, packed token ids, and the loss mask twice.

    `loss_tokens` has a byte per token, 1 where it touches a text of the trained role;
    `loss_spans` has the begin and end of each such text in the UTF-8 bytes of `formatted`, one
    after the other, cut to the tokens: a token that also holds template characters counts
    with its share. Turns are ordered by (turn, role, text), so ties have a defined order and
    repeated rows are repeated turns; null roles and texts are empty, a null turn comes first,
    rows without conv_id form one conversation. Other columns are left aside. A conversation
    is one row, as its rendering has to be; nothing else is gathered.
    """
    tables = ship(df, tokenizer)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = df.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")))).alias("turns"))
    texts = turns.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches):
        codec = tables.value.get()
        for batch in batches:
            done = [render(list(zip(r, t, strict=True)), trained) for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            packed = list(codec.encode(f for f, _ in done))
            masks, spans = [], []
            for ids, (_, of) in zip(packed, done, strict=True):
                mask, pieces = align(np.cumsum(codec.width[np.frombuffer(ids, dtype="<u4")]), of)
                masks.append(mask.astype(np.uint8).tobytes())
                spans.append([x for p in pieces for x in p])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([f for f, _ in done], pa.string()), pa.array(packed, pa.binary()), pa.array(masks, pa.binary()),
                 pa.array(spans, pa.list_(pa.int64()))], names=["conv_id", *FORMATTED.fieldNames()])

    return texts.mapInArrow(run, T.StructType([T.StructField("conv_id", T.LongType()), *FORMATTED.fields]))


def read_back(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """conv_id, turns (role and text, parsed from `formatted`), the text under the loss mask, characters.

    The text under the mask comes out of the tokens: their bytes, cut by the loss spans, unescaped.
    """
    tables = ship(formatted, tokenizer)
    schema = "conv_id long, roles array<string>, texts array<string>, loss_texts array<string>, formatted_chars long"

    def run(batches):
        codec = tables.value.get()
        for batch in batches:
            turns = [parse(f) for f in batch.column(1).to_pylist()]
            losses = []
            for ids, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                raw = "".join(codec.decode(ids)).encode()
                losses.append([unescape(raw[a:b].decode()) for a, b in zip(spans[::2], spans[1::2], strict=True)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())),
                 pa.array([[x for _, x in t] for t in turns], pa.list_(pa.string())), pa.array(losses, pa.list_(pa.string())),
                 pa.array([len(f) for f in batch.column(1).to_pylist()], pa.int64())],
                names=["conv_id", "roles", "texts", "loss_texts", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "ids", "loss_spans").mapInArrow(run, schema)


by_value(__name__)
