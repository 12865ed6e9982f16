"""Packing token sequences: vector best-fit under several capacities.

Documents are tokenized and cut into pieces of at most one sequence.  A sequence has
a capacity of tokens, of documents and of attention cost (the squares of its pieces'
lengths, as attention stays inside a document).  Pieces are dealt by hash into shards
of bounded size; in a shard the longest comes first, and each goes into the open
sequence that fits under every capacity and scores best by what remains.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import kept, small_batches, whole

# So many pieces are packed together, so each shard wastes no more than its last sequences.
SHARD_PIECES = 1 << 14
# A word of more characters is encoded, but not remembered.
_CACHED_CHARS = 64
_CACHED_WORDS = 400_000
# Sequences with no room for the shortest piece leave the matrix after so many placements.
_COMPACT_EVERY = 256
_SHARD_BITS = 32
RULES = ("residual", "dot")
# ASCII without "<", which may begin a special token, and letters that composing and lower-casing leave one letter.
_PLAIN_TEXT = re.compile("[\t\n\r !-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u0152\u0153]*").fullmatch
_WORDS = re.compile("[^ \t\n\r]+").findall
# Fixed value: the pattern that tokenizers of this kind are published with.
_KNOWN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# The same for plain text in lower case.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+|[0-9]|[^\\s0-9a-z\u00df-\u00f6\u00f8-\u00ff\u0153]+").findall


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds at most; None is what the tokens alone allow.

    ``weights`` are those of tokens, documents and attention cost in the score:
    ``residual`` takes the sequence with the least weighted norm of what remains,
    ``dot`` the one whose room has the largest weighted product with the piece.
    """

    tokens: int
    documents: int | None = None
    cost: int | None = None
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "residual"

    def limits(self) -> np.ndarray:
        if self.rule not in RULES:
            raise ValueError(f"the rule must be one of {RULES}, not {self.rule!r}")
        limits = (self.tokens, self.documents or self.tokens, self.cost or self.tokens ** 2)
        if min(limits) < 1 or limits[2] < self.tokens ** 2 and limits[2] < 1:
            raise ValueError(f"capacities must be positive; they are {limits}")
        return np.array(limits, dtype=np.float64)

    def longest(self) -> int:
        """The longest piece that fits an empty sequence."""
        return min(self.tokens, int(self.cost ** 0.5 + 1e-9)) if self.cost else self.tokens


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece, taken in the order given; sequences count from 0.

    Every open sequence is scored for every piece, by one matrix of what remains.
    """
    limits, weights = capacity.limits(), np.asarray(capacity.weights, dtype=np.float64)[:, None]
    n = len(lengths)
    sequence, offset = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    if not n:
        return sequence, offset
    needs = np.stack([lengths, np.ones(n), np.square(lengths, dtype=np.float64)]).astype(np.float64)
    if (needs.max(axis=1) > limits).any():
        raise ValueError("a piece is longer than an empty sequence allows")
    scale = 1.0 / limits[:, None]
    least = needs.min(axis=1)[:, None]
    room, names, n_open, n_made = np.empty((3, 64)), np.empty(64, dtype=np.int64), 0, 0
    for i in range(n):
        need = needs[:, i:i + 1]
        left = room[:, :n_open] - need
        fits = (left >= 0).all(axis=0)
        if fits.any():
            if capacity.rule == "residual":
                score = (weights * np.square(left * scale)).sum(axis=0)
            else:
                score = -(weights * (room[:, :n_open] * scale) * (need * scale)).sum(axis=0)
            at = int(np.where(fits, score, np.inf).argmin())
        else:
            if n_open == room.shape[1]:
                room, names = np.concatenate([room, np.empty_like(room)], axis=1), np.concatenate([names, names])
            at, n_open, n_made = n_open, n_open + 1, n_made + 1
            room[:, at], names[at] = limits, n_made - 1
        sequence[i], offset[i] = names[at], limits[0] - room[0, at]
        room[:, at] -= need[:, 0]
        if i % _COMPACT_EVERY == _COMPACT_EVERY - 1:
            useful = (room[:, :n_open] >= least).all(axis=0)
            kept_now = int(useful.sum())
            room[:, :kept_now], names[:kept_now] = room[:, :n_open][:, useful], names[:n_open][useful]
            n_open = kept_now
    return sequence, offset


class _Remembered(dict):
    """What ``make`` gives for a text, made once and remembered while there is room."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        found = self.make(key)
        if len(key) <= _CACHED_CHARS:
            if len(self) >= _CACHED_WORDS:
                self.clear()
            self[key] = found
        return found


class WordEncoder:
    """Ids of whole texts by a tokenizer that never joins what white space parts.

    So each different word is encoded once; the ids of a text are those of its words.
    Plain letters, digits and marks need none of the library's Unicode normalising: if
    the tokenizer is defined by the steps expected here, they are lower-cased and cut by an
    equal pattern, and only the different parts go through the library's model.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.direct = _has_known_steps(json.loads(definition))
        parts = _Remembered(self._part)
        self.plain = _Remembered(lambda word: b"".join([parts[part] for part in _PARTS(word)]))
        self.other = _Remembered(self._word)

    def _part(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        plain, other = self.plain, self.other
        if self.direct and _PLAIN_TEXT(text):
            return b"".join([plain[word] for word in text.lower().split()])
        return b"".join([
            plain[word.lower()] if self.direct and _PLAIN_TEXT(word) else other[word] for word in _WORDS(text)
        ])


def _has_known_steps(definition: dict) -> bool:
    """Whether the tokenizer cuts plain text as ``_PARTS`` cuts its lower case."""
    steps = (definition.get("normalizer") or {}).get("normalizers", [])
    cuts = (definition.get("pre_tokenizer") or {}).get("pretokenizers", [])
    if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cuts] != ["Split", "ByteLevel"]:
        return False
    split, level = cuts
    shape = (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"])
    return shape == ("Removed", True, False, False) and split["pattern"] == {"Regex": _KNOWN_PATTERN}


def token_pieces(
    docs: DataFrame, tokenizer: str, longest: int, *, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) per piece of at most ``longest`` tokens of a document.

    A document is its text's ids, then ``end_id`` if there is one; null text counts as
    empty, and a document without any id has no piece.  Repeated rows each keep their
    pieces.  Only the two named columns are read.  ``tokenizer`` is a file the driver can
    read, of a tokenizer that drops white space; executors get its content.
    """
    with open(tokenizer, encoding="utf-8") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    small_batches(docs.sparkSession)
    end = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or WordEncoder(shared.value)
            row, start, cut = [], [], []
            for i, value in enumerate(batch.column(1)):
                raw = encoder.encode(value.as_py()) + end
                places = range(0, len(raw) // 4, longest)
                row += [i] * len(places)
                start += places
                cut += [raw[4 * at:4 * (at + longest)] for at in places]
            columns = {
                "_id": batch.column(0).take(pa.array(row, pa.int64())),
                "piece": pa.array([at // longest for at in start], pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array([len(c) // 4 for c in cut], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(c) for c in cut], pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array([np.frombuffer(c, dtype="<u4") for c in cut], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    cut = rows.mapInArrow(run, f"_id {kind}, piece int, start long, length long, ids_crc32 long{ids}")
    return cut.withColumnRenamed("_id", doc_id)


def place(pieces: DataFrame, capacity: Capacity, carried: Sequence[str], shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """The ``carried`` columns of each piece with its ``sequence_id`` and ``offset``.

    ``pieces`` is written already and has ``length`` and ``row``, a number of its own
    for each.  A piece that fills a sequence by itself is not dealt out.  Equal pieces
    are spread like any others, so no shard grows with their number; all pieces are placed.
    """
    full = F.col("length") == capacity.tokens
    alone = pieces.where(full).select(*carried, (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    open_ = pieces.where(~full)
    shards = max(1, -(-open_.count() // shard_pieces))
    dealt = open_.select(
        F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), F.col("row").alias("_row"), F.col("length").alias("_length"), *carried
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.select(*carried).schema)

    def run(shard: pa.Table) -> pa.Table:
        shard = shard.sort_by([("_length", "descending"), ("_row", "ascending")])
        sequence, offset = best_fit(shard.column("_length").to_numpy(), capacity)
        base = shard.column("shard")[0].as_py() << _SHARD_BITS
        out = shard.select(list(carried))
        return out.append_column("sequence_id", pa.array(sequence + base)).append_column("offset", pa.array(offset))

    packed = dealt.groupBy("shard").applyInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")
    return packed.unionByName(alone)


def _numbered(pieces: DataFrame) -> DataFrame:
    return kept(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: Capacity, *, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document.

    Texts are read once; what is written and dealt out is a few numbers a piece.  Null ids
    and repeated rows are documents like any others; an empty table gives no rows.  A long
    text becomes many pieces, which are placed apart from each other.
    """
    capacity.limits()
    pieces = _numbered(token_pieces(docs, tokenizer, capacity.longest(), end_id=end_id, doc_id=doc_id, text=text))
    return place(pieces, capacity, [doc_id, "piece", "start", "length", "ids_crc32"])


def packed_sequences(
    docs: DataFrame, tokenizer: str, capacity: Capacity, *, end_id: int | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The sequences themselves: (sequence_id, ids, lengths), the ids one piece after another and the pieces' lengths."""
    capacity.limits()
    pieces = _numbered(token_pieces(docs, tokenizer, capacity.longest(), end_id=end_id, doc_id=doc_id, text=text, with_ids=True))
    placed = place(pieces.drop("ids"), capacity, ["row"])
    # A sequence holds no more tokens than its capacity, so a group is bounded.
    whole_ = placed.join(pieces.select("row", "ids"), "row").groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p")
    )
    return whole_.select(
        "sequence_id", F.flatten("_p.ids").alias("ids"), F.transform("_p", lambda p: F.size(p["ids"])).alias("lengths")
    )
