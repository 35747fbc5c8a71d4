"""Byte-level BPE as a streaming transducer with bounded lookahead, and the decoder.

Two prefixes of a text can only differ in their last tokens. A merge (u, v)
across the end of the common tokens takes back one token u; the next merge that
takes back more needs a later rank and a right part that begins with u. The
longest such chain, in bytes, is the sufficient lookahead of a merge list:
tokens that end so many bytes before the end of what has been read are final,
whatever follows. The transducer emits those and keeps only the rest.
"""

from __future__ import annotations

import codecs
import heapq
import json
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from certloom.shipping import by_value

# Fixed value: how byte-level vocabularies of this family cut a text ahead of the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Blanks where a text can be cut, and texts that hold other blanks as well.
AFTER_BLANK = regex.compile(r"(?<=[^\s]) ")
BLANK_RUN = regex.compile(r"\s ")

NO_RANK = 1 << 30
#: Pieces of up to so many characters are merged at once and remembered; longer ones are streamed.
SHORT = 96
#: Characters of a text that are cut into pieces at a time.
CHUNK = 1 << 16
#: Words that are looked up together, and words whose ids a worker remembers.
GROUP = 1 << 17
REMEMBERED = 1 << 18


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in vocabulary files: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], width: dict[int, int]) -> int:
    """Bytes that the longest chain of merges across one boundary can take back.

    merges: pairs of token ids by rank; made: the token each gives; width: bytes by token id.
    """
    left = {new: pair[0] for pair, new in zip(merges, made, strict=True)}
    reach: dict[int, int] = {}
    most = 0
    for u, v in merges:
        before, t = 0, v
        while t is not None:  # the tokens that v can have begun as
            before = max(before, reach.get(t, 0))
            t = left.get(t)
        now = width[u] + before
        reach[u] = max(reach.get(u, 0), now)
        most = max(most, now)
    return most


class Codec:
    """Tables of a tokenizer file. One lives in each Python worker, with the pieces it remembers."""

    def __init__(self, spec: str) -> None:
        parsed = json.loads(spec)
        model, of_char = parsed["model"], _byte_of_char()
        byte_form = lambda token: bytes(of_char[c] for c in token)
        vocab = {byte_form(t): i for t, i in model["vocab"].items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        raw = [(byte_form(a), byte_form(b)) for a, b in pairs]
        merges = [(vocab[a], vocab[b]) for a, b in raw]
        self.made = [vocab[a + b] for a, b in raw]
        single = {vocab[bytes([b])] for b in range(256)}
        known = set(single)
        for (a, b), new in zip(merges, self.made, strict=True):
            if a not in known or b not in known or new in known:
                raise ValueError("merges must build each token once, out of earlier ones")
            known.add(new)
        self.ranks = {(a << 20) | b: rank for rank, (a, b) in enumerate(merges)}
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        self.added = {t["content"]: t["id"] for t in parsed.get("added_tokens", [])}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in [*vocab.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.bytes_of[i] = token
        self.width = np.array([len(t) for t in self.bytes_of], dtype=np.int64)
        self.lookahead = sufficient_lookahead(merges, self.made, {i: len(t) for t, i in vocab.items()})
        self.window = max(2048, 2 * self.lookahead)
        self.find = regex.compile(PIECES)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.byte_ids, self.made_ids = np.array(self.of_byte, dtype=np.int32), np.array(self.made, dtype=np.int32)
        self.pair_keys = np.array(sorted(self.ranks), dtype=np.int64)
        self.pair_ranks = np.array([self.ranks[k] for k in self.pair_keys.tolist()], dtype=np.int32)
        every = np.arange(256)
        self.byte_ranks = self._rank(self.byte_ids[every][:, None] + 0 * every, self.byte_ids[every][None, :] + 0 * every[:, None]).astype(np.int32)
        self.words: dict[str, bytes] = {}
        self.starts: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Token ids of some bytes: the earliest-ranked pair first, the leftmost of equals."""
        ids = [self.of_byte[b] for b in data]
        if len(ids) > 4 * SHORT:
            return self._merge_long(ids)
        get, made = self.ranks.get, self.made
        ranks = [get((a << 20) | b, NO_RANK) for a, b in zip(ids, ids[1:])]  # noqa: B905
        while ranks:
            rank = min(ranks)
            if rank == NO_RANK:
                break
            i = ranks.index(rank)
            ids[i] = made[rank]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get((ids[i] << 20) | ids[i + 1], NO_RANK)
            if i:
                ranks[i - 1] = get((ids[i - 1] << 20) | ids[i], NO_RANK)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of pairs over linked positions."""
        n, get = len(ids), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i] << 20) | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or get((ids[i] << 20) | ids[j]) != rank:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (r := get((ids[at] << 20) | ids[after[at]])) is not None:
                    heapq.heappush(heap, (r, at))
        return [x for x in ids if x >= 0]

    def transduce(self, chunks: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of one piece of any length out of its bytes; holds a window and the lookahead."""
        held = b""
        for chunk in chunks:
            held += chunk
            if len(held) < self.window + self.lookahead:
                continue
            ids = self.merge(held)
            ends = np.cumsum(self.width[ids])
            final = int(np.searchsorted(ends, len(held) - self.lookahead, side="right"))
            if final:
                yield ids[:final]
                held = held[int(ends[final - 1]):]
        if held:
            yield self.merge(held)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of many short pieces, as `merge` gives them: pieces of about one length a step of all at a time."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        low = 0
        for high in (4, 8, 12, 16, 24, 48):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            if len(rows):
                for row, ids in zip(rows.tolist(), self._merge_rows([pieces[i] for i in rows.tolist()], sizes[rows], high), strict=True):
                    out[row] = ids
        for row in np.flatnonzero(sizes > low).tolist():
            ids = self.merge(pieces[row])
            out[row] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, width: int) -> list[bytes]:
        raw = np.frombuffer(b"".join([p.ljust(width + 1, b"\0") for p in pieces]), dtype=np.uint8).reshape(len(pieces), width + 1)
        ids, cols = self.byte_ids[raw], np.arange(width + 1)
        ids[cols >= sizes[:, None]] = -1  # behind the end: in no pair
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        ranks[cols[:-1] >= sizes[:, None] - 1] = NO_RANK
        done_ids, done_n, left, rows = np.empty_like(ids), np.empty(len(ids), dtype=np.int64), sizes.copy(), np.arange(len(ids))
        while len(rows):
            at = ranks.argmin(axis=1)
            each = np.arange(len(rows))
            best = ranks[each, at]
            if (ended := best == NO_RANK).any():
                done_ids[rows[ended]], done_n[rows[ended]] = ids[ended], left[ended]
                going = ~ended
                ids, ranks, left, rows, at, best = ids[going], ranks[going], left[going], rows[going], at[going], best[going]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = self.made_ids[best]
            left -= 1
            ids[:, :-1] = np.where(cols[:-1] > at[:, None], ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            ranks[:, :-1] = np.where(cols[:-2] > at[:, None], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NO_RANK
            ranks[each, at] = self._rank(ids[each, at], ids[each, at + 1])
            some = np.flatnonzero(at > 0)
            before = at[some] - 1
            ranks[some, before] = self._rank(ids[some, before], ids[some, before + 1])
        keep = cols < done_n[:, None]
        flat, ends = done_ids[keep].astype("<u4").tobytes(), (4 * np.cumsum(done_n)).tolist()
        return [flat[i:j] for i, j in zip([0, *ends], ends)]  # noqa: B905

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (b >= 0), self.pair_ranks[at], NO_RANK)

    def _long(self, piece: str) -> bytes:
        parts = (piece[i : i + 1024].encode() for i in range(0, len(piece), 1024))
        return b"".join(struct.pack(f"<{len(ids)}I", *ids) for ids in self.transduce(parts))

    def _learn(self, known: dict[str, bytes], words: set[str], blank: str) -> None:
        """Adds what is new among words; each begins a text (blank: empty) or follows a blank."""
        new = words.difference(known)
        whole = [w for w in new if w.isalpha() and len(w) < SHORT]
        known.update(zip(whole, self.merge_many([(blank + w).encode() for w in whole]), strict=True))
        find = self.find.findall
        cut = {w: find(blank + w) for w in new if w not in known}
        pieces = list({p for found in cut.values() for p in found if len(p) <= SHORT})
        packed = dict(zip(pieces, self.merge_many([p.encode() for p in pieces]), strict=True))
        for word, found in cut.items():
            known[word] = b"".join([packed.get(p) or self._long(p) for p in found])

    def _chunks(self, text: str) -> Iterator[list[str] | bytes]:
        """A text's words by chunks of constant size, and packed ids of added tokens between them.

        A chunk ends before a blank that follows a non-blank, and so does a word: no piece crosses that.
        """
        at = 0
        for stop in [*self.split_added.finditer(text), None] if self.split_added and any(a in text for a in self.added) else [None]:
            n = stop.start() if stop else len(text)
            start = at
            while start < n:
                end = min(start + CHUNK, n)
                while end < n and not (text[end] == " " and not text[end - 1].isspace()):
                    end += 1
                part = text[start:end]
                follows = start > at  # then part begins with a blank that is no word's
                words = AFTER_BLANK.split(part[follows:]) if BLANK_RUN.search(part) or part[follows:][:1] == " " else part[follows:].split(" ")
                yield ["", *words] if follows else words
                start = end
            if stop:
                yield struct.pack("<I", self.added[stop.group()])
                at = stop.end()

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        waiting: list[tuple[bool, list[str] | bytes]] = []
        size = 0
        for text in texts:
            first = True
            for chunk in self._chunks(text):
                waiting.append((first, chunk))
                first, size = False, size + (len(chunk) if isinstance(chunk, list) else 1)
            if first:
                waiting.append((True, b""))
            if size > GROUP:
                yield from self._assemble(waiting)
                waiting, size = [], 0
        yield from self._assemble(waiting)

    def _assemble(self, waiting: list[tuple[bool, list[str] | bytes]]) -> Iterator[bytes]:
        chunks = [c for _, c in waiting if isinstance(c, list)]
        starts, words = {c[0] for c in chunks}, set().union(*(c[1:] for c in chunks))
        for known, seen, blank in ((self.starts, starts, ""), (self.words, words, " ")):
            self._learn(known, seen, blank)
        word, parts = self.words, []
        for first, chunk in waiting:
            if first and parts:
                yield b"".join(parts)
                parts = []
            parts += [chunk] if isinstance(chunk, bytes) else [self.starts[chunk[0]], *[word[w] for w in chunk[1:]]]
        if parts:
            yield b"".join(parts)
        if len(self.words) > REMEMBERED:
            self.words = {w: word[w] for w in words}
        self.starts = {}

    def decode(self, packed: bytes) -> Iterator[str]:
        """Text of packed ids, a chunk at a time: bytes of an unfinished character wait in the decoder's state.

        Bytes that are no UTF-8 become U+FFFD.
        """
        state = codecs.getincrementaldecoder("utf-8")("replace")
        ids, of = np.frombuffer(packed, dtype="<u4"), self.bytes_of
        for i in range(0, len(ids), CHUNK):
            yield state.decode(b"".join([of[x] for x in ids[i : i + CHUNK].tolist()]))
        yield state.decode(b"", final=True)


class Shipped:
    """A tokenizer file on its way to the workers; the tables are built once in each worker.

    The file is read where the job is written, so executors need no copy. A
    vocabulary has a fixed size, so the broadcast doesn't grow with the data.
    """

    def __init__(self, spec: str) -> None:
        self.spec, self.codec = spec, None

    def __getstate__(self):
        return self.spec

    def __setstate__(self, spec):
        self.spec, self.codec = spec, None

    def get(self) -> Codec:
        if self.codec is None:
            self.codec = Codec(self.spec)
        return self.codec


def ship(df: DataFrame, path: str):
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(Shipped(f.read()))


def with_column(df: DataFrame, name: str, kind: T.DataType, source: str, value) -> DataFrame:
    """df with one more column, computed batch by batch from the column `source` by value(list) -> list."""
    if source not in df.columns:
        raise ValueError(f"no column {source}")
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the column {name} is there already")
    at = df.columns.index(source)
    arrow_type = pa.binary() if isinstance(kind, T.BinaryType) else pa.string()

    def run(batches):
        for batch in batches:
            made = pa.array(value(batch.column(at)), type=arrow_type)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds `ids`: the whole text's token ids, packed as little-endian unsigned 32-bit integers (binary).

    A null or empty text has no ids (empty binary). Strings of added tokens in a text become their
    ids. Rows are independent: repeated rows, ties and hot sources need nothing, an empty table stays
    empty. All other columns are kept; a column already named `ids` is an error (give another name).
    """
    tables = ship(df, tokenizer)

    def values(column):
        codec = tables.value.get()
        return list(codec.encode(x.as_py() or "" for x in column))

    return with_column(df, ids, T.BinaryType(), text, values)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds `text`: the text of packed ids, special tokens included. Null ids give an empty text."""
    tables = ship(df, tokenizer)

    def values(column):
        codec = tables.value.get()
        return ["".join(codec.decode(x.as_py() or b"")) for x in column]

    return with_column(df, text, T.StringType(), ids, values)


def token_count(ids: str = "ids"):
    """Tokens of packed ids."""
    return (F.octet_length(ids) / 4).cast("long")


by_value(__name__)
