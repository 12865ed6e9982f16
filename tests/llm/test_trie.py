"""The prefix trie against a plain one, and against its SQL twin."""

import random
import zlib
from hashlib import sha256

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import twins
from textloom.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0), tie, (role, text)))
    convs = {c: [t[-1] for t in sorted(turns)] for c, turns in convs.items()}
    whole = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(convs.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, totals = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        words = len([w for w in node[-1][1].replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]) if node else 0
        totals[node] = (sum(totals[b][0] for b in below) or 1, (len(members[node]) - 1) * words + sum(totals[b][1] for b in below))
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if whole[c] == node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), *totals[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def table(seed, convs, choices=3, longest=6, copies=0):
    draw = random.Random(seed)
    texts = ["", None, "one two", "a\tb\n c", "é " * 50, "x"][:choices]
    rows = []
    for c in range(convs):
        if draw.random() < 0.1 and c % 20 == 0:
            continue
        for t in range(draw.randint(1, longest)):
            rows.append((c * 3 if seed % 2 else c, draw.choice([t, t, None]) if seed == 3 else t, draw.choice(["user", "bot", None]), draw.choice(texts)))
    rows += [(1000 + i, t, "user", "the same again") for i in range(copies) for t in range(4)]
    draw.shuffle(rows)
    return rows


CASES = [
    (table(1, 80), 128, 1 << 15), (table(2, 150, 2, 9, copies=300), 128, 40), (table(3, 60, 6), 2, 25), (table(4, 40, 2, 40), 3, 16),
    # A conversation with most of the rows, over many stretches; others share half of it.
    ([(40, t, "user", f"w {t % 7}") for t in range(700)] + [(c, t, "user", f"w {t % 7}") for c in (41, 47, 60) for t in range(350)], 8, 30),
    # Turnless by rebuilding, no conversation, one alone.
    ([(33, 0, "a", "b"), (None, 0, "a", "b"), (None, None, None, None), (-7, 1, "a", "b"), (-7, 1, "a", "b")] + [(c, 0, None, None) for c in range(60, 80)], 128, 99),
    ([], 128, 9),
]


@pytest.mark.parametrize("rows,width,shard_rows", CASES)
def test_equals_a_plain_trie_and_the_twin(spark, rows, width, shard_rows):
    conversations = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("at", "h", "base", "ids", "words", "depth")])
    found = prefix_trie(conversations, width=width, shard_rows=shard_rows)
    assert found.columns == NAMES
    got = sorted((tuple(r) for r in found.collect()), key=repr)
    want = plain(rows)
    assert got == want
    con = duckdb.connect()
    con.register("conversations", conversations.toArrow())
    assert sorted(con.sql(twins.PREFIX_TRIE).fetchall(), key=repr) == want
