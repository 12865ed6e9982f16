"""Packing: the tokenizer library's own ids, every capacity, and each piece placed once."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textloom.llm.packing import Capacity, WordEncoder, best_fit, pack_documents, packed_sequences, place
from textloom.llm.queries import END_ID, WORD_TOKENIZER, op12_packing

LIBRARY = Tokenizer.from_file(WORD_TOKENIZER)


def ids_of(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, END_ID], dtype="<u4")


def check_places(rows, capacity):
    """Every sequence gapless from 0 and within each capacity; returns how many there are."""
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:i]) for i in range(len(parts))]
        needs = (sum(n for _, n in parts), len(parts), sum(n * n for _, n in parts))
        assert (needs <= capacity.limits()).all()
    return len(held)


def random_text(draw):
    letters = "abcXYZ019'.,!-_ \n\t éÉßøŒæ×÷ªº²½·«»İıſḰ̀  ᰀ\x1c\x0bİ中文字한국🙂<|>ẞΣς"
    kind = draw.random()
    if kind < 0.4:
        return "".join(draw.choice(letters) for _ in range(draw.randint(0, 60)))
    words = ["it's", "'S", "don't", "<|endoftext|>", "a<|startoftext|>b", "<|EndOfText|>", "x" * 100, "été", "o'REly", "''ll", "A1b2", "--", "naïve", "Ünïcode"]
    return draw.choice([" ", "\n", "\r\n ", " ", "  "]).join(draw.choice(words) for _ in range(draw.randint(0, 12)))


def test_ids_are_the_librarys():
    draw = random.Random(8)
    texts = [random_text(draw) for _ in range(3000)] + ["", " ", "\n", "word " * 20000, "x" * 30000, "中" * 3000]
    with open(WORD_TOKENIZER, encoding="utf-8") as file:
        definition = file.read()
    encoder = WordEncoder(definition)
    assert encoder.direct
    for text in texts:
        assert encoder.encode(text) == ids_of(text)[:-1].tobytes(), text
    # Any other definition goes through the library alone.
    other = WordEncoder(definition.replace('"Lowercase"', '"Lowercase"', 1).replace('"NFC"', '"NFD"', 1))
    assert not other.direct
    assert other.encode("It's Plain") == encoder.encode("It's Plain") and other.encode("") == b""


def test_all_plain_characters_alone_and_in_words():
    encoder = WordEncoder(open(WORD_TOKENIZER, encoding="utf-8").read())
    chars = [chr(c) for c in range(0x180)]
    texts = chars + [f"a{c}b{c}" for c in chars] + [f"{c}'s{c}" for c in chars] + [f"'{c}e1" for c in chars]
    assert [encoder.encode(t) for t in texts] == [ids_of(t)[:-1].tobytes() for t in texts]


def test_what_is_remembered_is_bounded(monkeypatch):
    monkeypatch.setattr("textloom.llm.packing._CACHED_WORDS", 7)
    encoder = WordEncoder(open(WORD_TOKENIZER, encoding="utf-8").read())
    texts = [" ".join(f"w{i % k}x é{i}̀" for i in range(40)) for k in (3, 11, 40)]
    assert [encoder.encode(t) for t in texts] == [ids_of(t)[:-1].tobytes() for t in texts]
    assert len(encoder.plain) <= 7 and len(encoder.other) <= 7


def plain_best_fit(lengths, capacity):
    limits = [float(x) for x in capacity.limits()]
    rooms, out = [], []
    for n in lengths:
        need = (n, 1, n * n)
        scores = []
        for i, room in enumerate(rooms):
            if all(a >= b for a, b in zip(room, need)):
                if capacity.rule == "residual":
                    scores.append((sum(w * ((a - b) * (1 / c)) ** 2 for w, a, b, c in zip(capacity.weights, room, need, limits)), i))
                else:
                    scores.append((-sum(w * (a * (1 / c)) * (b * (1 / c)) for w, a, b, c in zip(capacity.weights, room, need, limits)), i))
        if scores:
            i = min(scores)[1]
        else:
            rooms.append(list(limits))
            i = len(rooms) - 1
        out.append((i, int(limits[0] - rooms[i][0])))
        rooms[i] = [a - b for a, b in zip(rooms[i], need)]
    return out


@pytest.mark.parametrize("capacity", [
    Capacity(100), Capacity(100, rule="dot"), Capacity(100, documents=3), Capacity(100, cost=4000), Capacity(100, 4, 6000, (1, 1, 1)),
    Capacity(100, 4, 6000, (1, 1, 1), "dot"),
])
def test_best_fit_equals_a_plain_one(capacity):
    draw = random.Random(9)
    lengths = np.array(sorted((draw.randint(1, capacity.longest()) for _ in range(700)), reverse=True))
    sequence, offset = best_fit(lengths, capacity)
    assert list(zip(sequence.tolist(), offset.tolist())) == plain_best_fit(lengths.tolist(), capacity)


def test_best_fit_refuses():
    with pytest.raises(ValueError):
        best_fit(np.array([101]), Capacity(100))
    with pytest.raises(ValueError):
        best_fit(np.array([1]), Capacity(100, rule="first"))
    assert len(best_fit(np.array([], dtype=int), Capacity(5))[0]) == 0


def test_query_on_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = op12_packing(spark, sf_dir).collect()
    want = {}
    for d in docs:
        ids = ids_of(d.text)
        for at in range(0, len(ids), 4096):
            want[d.doc_id, at // 4096] = (at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    n = check_places(rows, Capacity(4096))
    assert n <= -(-sum(v[1] for v in want.values()) // 4096) + 1


ODD = [(1, "Some words that are here"), (1, "Some words that are here"), (None, None), (None, ""), (4, "soup " * 3000), (5, "\n"), (None, "an orphan")]


def test_odd_rows_and_sequences(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").select("*", *[F.lit("x").alias(c) for c in ("row", "length", "piece", "shard", "_id", "_row")])
    capacity = Capacity(50, documents=3, cost=2500)
    rows = pack_documents(docs, WORD_TOKENIZER, capacity, end_id=END_ID).collect()
    check_places(rows, capacity)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for _, t in ODD)
    sequences = packed_sequences(docs, WORD_TOKENIZER, capacity, end_id=END_ID).collect()
    parts = sorted(tuple(part) for s in sequences for part in np.split(np.array(s.ids), np.cumsum(s.lengths)[:-1]))
    want = sorted(tuple(ids_of(t)[at:at + 50]) for _, t in ODD for at in range(0, len(ids_of(t)), 50))
    assert [tuple(map(int, p)) for p in parts] == [tuple(map(int, p)) for p in want]
    assert pack_documents(docs.limit(0), WORD_TOKENIZER, capacity, end_id=END_ID).collect() == []
    # Without an end, an empty document has no piece.
    assert pack_documents(docs.where("text = ''"), WORD_TOKENIZER, capacity).collect() == []


def test_equal_pieces_spread_over_shards(spark):
    pieces = spark.range(5000).select(F.col("id").alias("row"), F.lit(7).cast("long").alias("doc_id"), F.lit(30).cast("long").alias("length"))
    rows = place(pieces, Capacity(100), ["doc_id", "length"], shard_pieces=500).collect()
    assert len(rows) == 5000
    assert 5000 // 3 <= check_places(rows, Capacity(100)) <= 5000 // 3 + 11
    assert len({r.sequence_id >> 32 for r in rows}) == 10
