"""Prefix trie against plain Python."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meshframe.llm import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows):
    """Rows (conv_id, turn, role, text) to the nodes of the trie, by the contract."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            step = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, step), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(int)
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else -10**9, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in nodes.items())


def ours(df, shards):
    rows = trie.prefix_trie(trie.rebuilt(trie.turns_of(df)), shards).collect()
    return sorted((r["conv_id"], r["depth"], -10**9 if r["parent_conv_id"] is None else r["parent_conv_id"], *tuple(r)[3:]) for r in rows)


SCHEMA = "conv_id long, turn long, role string, text string, shard int, path string"


def talk(seed, convs, most, kinds):
    rng = random.Random(seed)
    texts = [None, "", "  ", "one", "two words", "a\x0bb\tc", "é ▁"] + [f"text {i} x" for i in range(kinds)]
    rows = []
    for c in convs:
        for turn in range(rng.randint(1, most)):
            rows.append((c, rng.choice([turn, turn, turn, None, 0]), rng.choice(["user", "user", None, ""]), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("shards", [1, 7, 64])
def test_against_plain_python(spark, shards):
    rows = talk(shards, list(range(-30, 90)) + [10**12, 10**12 + 7], 6, 3)
    rows += [(None, 1, "user", "nobody's"), (None, None, None, None)] + rows[:40]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA).repartition(3)
    assert ours(df, shards) == plain(rows)


def test_a_large_group_of_copies_and_a_long_conversation(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 9000, 3) for t in range(3)]
    rows += [(c, t, "user", f"same {t % 3} {t // 3}") for c in (9001, 9002) for t in range(900)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    assert ours(df, 16) == plain(rows)


def test_long_splitters_are_cut(spark, monkeypatch):
    monkeypatch.setattr(trie, "SKELETON_TURNS", 64)
    rows = talk(9, range(150), 12, 1)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    paths = trie.rebuilt(trie.turns_of(df))
    assert all(len(b) <= trie.STEP * 1 for b in trie.splitters(trie.collapsed(paths), 16))
    assert ours(df, 16) == plain(rows)


def test_turnless_conversations_belong_to_the_root(spark):
    """Without their base, ids with a checksum of 1 to 3 lose as many first turns."""
    rows = [(c, 0, "user", "only") for c in range(1, 20)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    got = ours(df, 4)
    assert got == plain(rows)
    assert got[0][1] == 0 and got[0][3] == 19


def test_order_of_rows_and_number_of_shards_do_not_matter(spark):
    rows = talk(4, range(200), 5, 2)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    assert ours(df, 3) == ours(df.orderBy(F.rand(1)).repartition(5), 40)


def test_megabyte_texts(spark):
    rows = [(c, 0, "user", "w " * 500_000 + str(c // 2)) for c in (0, 20, 21, 40)]
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA)
    assert ours(df, 4) == plain(rows)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert ours(df, 4) == []
