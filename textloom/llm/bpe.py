"""Byte-level BPE encoding and decoding over padded matrices.

The different pieces of a batch of texts are bucketed by length into padded
matrices of token ids.  Each round every row merges its leftmost pair of least
rank: pairs are looked up in a hash table, only the two pairs beside a merge are
looked up again, and rows that are done leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import small_batches, whole

# Pieces of up to so many bytes go through the matrices; a longer one is merged by itself with a heap.
MATRIX_BYTES = 256
_WIDTHS = (4, 8, 16, 32, 64, 128, MATRIX_BYTES)
_CELLS = 1 << 20
_CHARS_AT_ONCE = 1 << 20
_CACHED_PIECES = 100_000
_NONE = np.int32(np.iinfo(np.int32).max)
_EMPTY = np.uint64(np.iinfo(np.uint64).max)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file by rank: one base64 token and its rank in a line."""
    with open(path, "rb") as lines:
        ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    return [token for _, token in ranked]


def pair_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Open-addressed hash table (keys, ranks): every pair of tokens whose bytes together are a token."""
    rank = {token: i for i, token in enumerate(tokens)}
    keys, values = [], []
    for i, token in enumerate(tokens):
        for cut in range(1, len(token)):
            a, b = rank.get(token[:cut]), rank.get(token[cut:])
            if a is not None and b is not None:
                keys.append(a << 32 | b)
                values.append(i)
    size = 1 << max(4, (4 * len(keys)).bit_length())
    slots, ranks = np.full(size, _EMPTY), np.full(size, _NONE, dtype=np.int32)
    left, left_values = np.array(keys, dtype=np.uint64), np.array(values, dtype=np.int32)
    at = _home(left, size)
    while len(left):
        # Of the pairs that want one free slot the first gets it; the others go on.
        _, first = np.unique(at, return_index=True)
        first = first[slots[at[first]] == _EMPTY]
        slots[at[first]], ranks[at[first]] = left[first], left_values[first]
        rest = np.ones(len(left), dtype=bool)
        rest[first] = False
        left, left_values, at = left[rest], left_values[rest], (at[rest] + 1) & (size - 1)
    return slots, ranks


def _home(keys: np.ndarray, size: int) -> np.ndarray:
    return ((keys * _SPREAD) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


class Codec:
    """Encodes pieces, decodes ids; ``pattern`` cuts texts into pieces."""

    def __init__(self, tokens: list[bytes], slots: np.ndarray, ranks: np.ndarray, pattern: str):
        self.tokens, self.slots, self.ranks = tokens, slots, ranks
        self.rank = {token: i for i, token in enumerate(tokens)}
        self.bytes_id = np.array([self.rank.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.bytes_id < 0).any():
            raise ValueError("the vocabulary must hold every single byte")
        self.cut = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, _NONE where the pair is no token."""
        keys = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        at = _home(keys, len(self.slots))
        found = self.slots[at]
        out = np.where(found == keys, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & (len(self.slots) - 1)
            found = self.slots[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != _EMPTY)]
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """The ids of pieces of up to ``width`` bytes."""
        lengths = np.array([len(p) for p in pieces])
        held = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, dtype=np.int32)
        ids[held] = self.bytes_id[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        rank = np.full((len(pieces), width), _NONE, dtype=np.int32)
        rank[:, :-1][held[:, 1:]] = self.lookup(ids[:, :-1][held[:, 1:]], ids[:, 1:][held[:, 1:]])
        out: list[np.ndarray] = [None] * len(pieces)
        row_of = np.arange(len(pieces))
        columns = np.arange(width)
        while len(ids):
            at = rank.argmin(axis=1)
            rows = np.arange(len(ids))
            least = rank[rows, at]
            done = least == _NONE
            if done.any():
                for i in np.flatnonzero(done):
                    out[row_of[i]] = ids[i, :lengths[i]].copy()
                go = ~done
                ids, rank, lengths, row_of = ids[go], rank[go], lengths[go], row_of[go]
                at, least, rows = at[go], least[go], np.arange(int(go.sum()))
                if not len(ids):
                    break
            # The merged token replaces its pair; what follows moves up by one.
            behind = columns[None, :-1] > at[:, None]
            np.copyto(ids[:, :-1], ids[:, 1:].copy(), where=behind)
            np.copyto(rank[:, :-1], rank[:, 1:].copy(), where=behind)
            ids[:, -1], rank[:, -1] = -1, _NONE
            ids[rows, at] = least
            lengths = lengths - 1
            self._renew(ids, rank, rows, at, at + 1 < lengths)
            self._renew(ids, rank, rows, at - 1, at > 0)
        return out

    def _renew(self, ids: np.ndarray, rank: np.ndarray, rows: np.ndarray, at: np.ndarray, there: np.ndarray) -> None:
        """Look up the pairs that begin at ``at``; where there is none, clear the place itself."""
        r, c = rows[there], at[there]
        rank[r, c] = self.lookup(ids[r, c], ids[r, c + 1])
        gone = ~there & (at >= 0)
        rank[rows[gone], at[gone]] = _NONE

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The ids of one piece of any length: linked tokens and a heap of (rank, place)."""
        ids = self.bytes_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.lookup(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != _NONE]
        heapq.heapify(heap)
        current = first.tolist() + [int(_NONE)]
        pair = self._pair
        while heap:
            rank, i = heapq.heappop(heap)
            if ids[i] < 0 or current[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0:
                    right = after[left]
                    current[left] = pair(ids[left], ids[right]) if right < n else int(_NONE)
                    if current[left] != _NONE:
                        heapq.heappush(heap, (current[left], left))
        return np.array([i for i in ids if i >= 0], dtype=np.int32)

    def _pair(self, a: int, b: int) -> int:
        return self.rank.get(self.tokens[a] + self.tokens[b], int(_NONE))

    def learn(self, pieces: Iterable[str]) -> None:
        """Encode pieces into the cache of this task."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            raw = piece.encode()
            whole_id = self.rank.get(raw)
            if whole_id is not None:
                self.known[piece] = whole_id.to_bytes(4, "little")
            elif len(raw) > MATRIX_BYTES:
                self.known[piece] = self.merge_long(raw).astype("<u4").tobytes()
            else:
                width = next(w for w in _WIDTHS if len(raw) <= w)
                buckets.setdefault(width, []).append((piece, raw))
        for width, own in buckets.items():
            for at in range(0, len(own), _CELLS // width):
                part = own[at:at + _CELLS // width]
                for (piece, _), ids in zip(part, self.merge_rows([raw for _, raw in part], width)):
                    self.known[piece] = ids.astype("<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self.cut(text) for text in texts]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > _CACHED_PIECES:
            self.known.clear()
            new = set().union(*cut)
        self.learn(new)
        known = self.known
        return [b"".join([known[piece] for piece in pieces]) for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in ids.tolist()])


def portions(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Slices of about _CHARS_AT_ONCE characters, a text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > _CHARS_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def _shared(docs: DataFrame, vocabulary: str, pattern: str):
    """What tasks build their codec from; its size is that of the vocabulary."""
    tokens = read_ranks(vocabulary)
    return docs.sparkSession.sparkContext.broadcast((tokens, *pair_table(tokens), pattern))


def encode_texts(docs: DataFrame, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) per row, special tokens never made; null text counts as empty, without ids.

    Only the two named columns are read, repeated rows each keep their row, and a
    piece of any length is encoded whole.  ``vocabulary`` is a rank file the driver
    can read; executors get its content.
    """
    shared = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts):
                coded = [np.frombuffer(ids, dtype="<u4") for ids in codec.encode(texts[start:stop])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:stop], _lists(coded)], names=["_id", "ids"])

    return _mapped(docs, doc_id, whole(text), run, "ids array<int>")


def decode_ids(encoded: DataFrame, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, content binary) per row; null ids decode to no bytes.  An id outside the vocabulary is an error."""
    shared = _shared(encoded, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            content = [codec.decode(np.array(x.as_py() or [], dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(content, pa.binary())], names=["_id", "content"])

    return _mapped(encoded, doc_id, F.col(ids), run, "content binary")


def round_trip_digest(
    docs: DataFrame, vocabulary: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row: ``encode_texts`` and ``decode_ids`` in one pass.

    ``with_ids`` adds the ids themselves.
    """
    shared = _shared(docs, vocabulary, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in portions(texts):
                coded = codec.encode(texts[start:stop])
                numbers = [np.frombuffer(ids, dtype="<u4") for ids in coded]
                columns = {
                    "_id": batch.column(0)[start:stop],
                    "n_tokens": pa.array([len(n) for n in numbers], pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(ids).hexdigest() for ids in coded], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(codec.decode(n)).hexdigest() for n in numbers], pa.string()),
                }
                if with_ids:
                    columns["ids"] = _lists(numbers)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    ids = ", ids array<int>" if with_ids else ""
    return _mapped(docs, doc_id, whole(text), run, f"n_tokens long, ids_sha256 string, decoded_sha256 string{ids}")


def _lists(numbers: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(n) for n in numbers])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(numbers).astype(np.int32))


def _mapped(df: DataFrame, doc_id: str, value, run, columns: str) -> DataFrame:
    small_batches(df.sparkSession)
    rows = df.select(F.col(doc_id).alias("_id"), value.alias("_value"))
    kind = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"_id {kind}, {columns}").withColumnRenamed("_id", doc_id)
