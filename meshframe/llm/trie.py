"""Prefix trie of conversations: range-partitioned sorted shards under a broadcast skeleton of splitter paths."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import pin, table, words

# Bytes of a turn's digest in a path.
STEP = 16
# Sampled paths per shard, and turns of all sampled paths together: a bound of 8 MB on what the driver and a broadcast hold.
SAMPLES = 16
SKELETON_TURNS = 1 << 19
# Conversations with equal paths are put together by the upper bits of their ids: at most 4096 in a row.
ID_BITS = 12
_EMIT_ROWS = 20_000

_NODE = T.StructType([
    T.StructField("skeleton", T.LongType()), T.StructField("conv_id", T.LongType()), T.StructField("depth", T.LongType()),
    T.StructField("parent_conv_id", T.LongType()), T.StructField("under", T.LongType()), T.StructField("n_convs", T.LongType()),
    T.StructField("n_children", T.LongType()), T.StructField("n_leaves", T.LongType()), T.StructField("saved_tokens", T.LongType()),
    T.StructField("n_words", T.LongType()), T.StructField("ends_sha256", T.StringType()),
])
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(base, conv, turns): each conversation as one row of its turns in order, with a digest and the number of words for each.

    Rows lie by ``base``, the multiple of 20 below the conversation, so that rebuilding needs no further shuffle. Null role and
    text are empty; a null turn comes first; turns with equal numbers are ordered by their digests. Rows without a conversation
    are left out. Texts stay where they are: 30 bytes of each turn are shuffled, and a conversation takes as many of each of its turns.
    """
    clean = [F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role, text)]
    # The length tells role from text.
    digest = F.md5(F.concat(F.length(clean[0]).cast("string"), F.lit(":"), *clean).cast("binary"))
    rows = convs.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.unhex(digest).alias("step"),
        F.size(words(clean[1])).alias("n"))
    rows = rows.withColumn("base", F.col("conv") - F.col("conv") % 20).repartition("base")
    return rows.groupBy("base", "conv").agg(F.sort_array(F.collect_list(F.struct("turn", "step", "n"))).alias("turns"))


def rebuilt(listed: DataFrame) -> DataFrame:
    """(conv, path, n): the base conversation's first turns (as many as the id's checksum says), then the own ones after as many.

    ``path`` has the digests one after another, so that the order of paths is that of their bytes; ``n`` the words of each turn.
    """
    heads = listed.where("conv = base").select(F.col("base").alias("of"), F.slice("turns", 1, 3).alias("first"))
    rows = listed.withColumn("h", F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(4)).cast("int"))
    both = rows.join(heads, F.col("base") == F.col("of"), "left").select("conv", F.concat(
        F.slice(F.coalesce("first", F.slice("turns", 1, 0)), F.lit(1), F.col("h")),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))
    return both.select(
        "conv", F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["step"])), "")).alias("path"),
        F.transform("turns", lambda t: t["n"]).alias("n"))


def collapsed(paths: DataFrame) -> DataFrame:
    """(path, n, part, n_convs, conv_id, ids): conversations with equal paths, some 4096 ids at most in a row, in order."""
    return paths.groupBy("path", "n", F.shiftright("conv", ID_BITS).alias("part")).agg(
        F.count("*").alias("n_convs"), F.min("conv").alias("conv_id"),
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))


def splitters(rows: DataFrame, shards: int) -> list[bytes]:
    """Up to ``shards - 1`` paths in order that cut the rows into about equal ranges.

    They come from a sample of bounded size by the rows' hashes. Paths longer than the bound allows are cut to
    a prefix, which is as good a border. They decide where a node is worked out, not what it becomes.
    """
    most = SAMPLES * shards
    turns = max(1, SKELETON_TURNS // most)
    sample = rows.select(F.substring("path", 1, STEP * turns).alias("path"), F.xxhash64("path", "part").alias("at"))
    found = sorted(bytes(r["path"]) for r in sample.orderBy("at").limit(most).collect())
    return sorted({found[i * len(found) // shards] for i in range(1, shards)}) if found else []


class Skeleton:
    """The trie of all splitter paths: the only nodes whose members may lie in several shards."""

    def __init__(self, borders: list[bytes]):
        self.borders = borders
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in borders:
            at = 0
            for i in range(0, len(path), STEP):
                key = (at, path[i:i + STEP])
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]


class _Node:
    """An open node of the sweep."""

    __slots__ = ("number", "n_words", "n_convs", "conv_id", "n_children", "n_leaves", "saved", "ends", "waiting")

    def __init__(self, number: int, n_words: int):
        self.number, self.n_words = number, n_words
        self.n_convs = self.n_children = self.n_leaves = self.saved = 0
        self.conv_id = self.ends = None
        self.waiting: list[list] = []

    def add(self, n_convs: int, conv_id: int) -> None:
        self.n_convs += n_convs
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


def _common(a: bytes, b: bytes) -> int:
    """How many turns two paths share."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid * STEP] == b[:mid * STEP]:
            low = mid
        else:
            high = mid - 1
    return low


class Sweep:
    """Nodes of sorted paths, one stack of open nodes deep.

    A node is closed when a path leaves it. It waits at its parent until the parent's smallest member is
    known; under a skeleton node that is left to the join. Skeleton nodes give what this shard knows of them.
    """

    def __init__(self, skeleton: Skeleton):
        self.skeleton, self.path = skeleton, None
        self.stack: list[_Node] = []
        self.out: list[list] = []

    def close(self) -> None:
        node, depth = self.stack.pop(), len(self.stack)
        above = self.stack[-1] if self.stack else None
        if above:
            above.add(node.n_convs, node.conv_id)
        ends = node.ends.hexdigest() if node.ends else _NOTHING
        if node.number >= 0:
            self.out.append([node.number, node.conv_id, depth, None, None, node.n_convs, node.n_children, node.n_leaves, node.saved, node.n_words,
                             ends if node.ends else None])
            return
        leaves = node.n_leaves or 1
        saved = node.saved + (node.n_convs - 1) * node.n_words
        above.n_children += 1
        above.n_leaves += leaves
        above.saved += saved
        for row in node.waiting:
            row[3] = node.conv_id
        self.out += node.waiting
        row = [None, node.conv_id, depth, None, None, node.n_convs, node.n_children, leaves, saved, node.n_words, ends]
        if above.number >= 0:
            row[4] = above.number
            self.out.append(row)
        else:
            above.waiting.append(row)

    def take(self, path: bytes, n: list[int], n_convs: int, conv_id: int, ids: str) -> None:
        if path != self.path:
            if self.path is None:
                self.stack.append(_Node(0, 0))
                self.path = b""
            shared = _common(self.path, path)
            while len(self.stack) > shared + 1:
                self.close()
            for d in range(shared, len(n)):
                number = self.skeleton.child.get((self.stack[-1].number, path[d * STEP:(d + 1) * STEP]), -1)
                self.stack.append(_Node(number, n[d]))
            self.path = path
        node = self.stack[-1]
        node.add(n_convs, conv_id)
        if node.ends:
            node.ends.update(b",")
        else:
            node.ends = hashlib.sha256()
        node.ends.update(ids.encode())

    def rows(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        while last and self.stack:
            self.close()
        while len(self.out) >= (1 if last else _EMIT_ROWS):
            part, self.out = self.out[:_EMIT_ROWS], self.out[_EMIT_ROWS:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if f.name == "ends_sha256" else pa.int64()) for c, f in zip(zip(*part), _NODE)], names=_NODE.names)


def shard_nodes(rows: DataFrame, skeleton: Skeleton, shards: int) -> DataFrame:
    """Rows of ``collapsed`` to nodes: complete ones, and for skeleton nodes what each shard has of them (``skeleton`` is their number)."""
    shared = rows.sparkSession.sparkContext.broadcast(skeleton)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value.borders
        for batch in batches:
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()
            shard = pa.array([bisect_right(borders, p) for p in paths], pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, shard], names=[*batch.schema.names, "shard"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep(shared.value)
        for batch in batches:
            for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("path", "n", "n_convs", "conv_id", "ids"))):
                state.take(*row)
            yield from state.rows()
        yield from state.rows(last=True)

    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("shard", T.IntegerType())]))
    # Equal paths lie in one shard, whose sorted rows are read as a stream.
    return dealt.repartitionById(shards, "shard").sortWithinPartitions("path", "part").mapInArrow(sweep, _NODE)


def skeleton_nodes(nodes: DataFrame, skeleton: Skeleton) -> DataFrame:
    """The skeleton's nodes: partial aggregates of all shards reduced by node, then added up along the skeleton, bottom up.

    Its nodes are as many as ``splitters`` bounds, so one task takes them.
    """
    parent, depth = skeleton.parent, skeleton.depth
    parts = nodes.where("skeleton is not null").groupBy("skeleton").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("n_words").alias("n_words"), F.max("ends_sha256").alias("ends_sha256"))

    def roll_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = {r["skeleton"]: r for batch in batches for r in batch.to_pylist()}
        for i in sorted(of, reverse=True):
            node = of[i]
            node["n_leaves"] = node["n_leaves"] or 1
            node["saved_tokens"] += (node["n_convs"] - 1) * node["n_words"]
            if i:
                above = of[parent[i]]
                above["n_children"] += 1
                above["n_leaves"] += node["n_leaves"]
                above["saved_tokens"] += node["saved_tokens"]
        if of:
            rows = [{**node, "depth": depth[i], "parent_conv_id": of[parent[i]]["conv_id"] if i else None,
                     "ends_sha256": node["ends_sha256"] or _NOTHING, "under": None} for i, node in of.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[f.name] for r in rows], pa.string() if f.name == "ends_sha256" else pa.int64()) for f in _NODE], names=_NODE.names)

    return parts.coalesce(1).mapInArrow(roll_up, _NODE)


def prefix_trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """One row for each node of the trie of ``paths`` (columns conv, path, n): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. No rows make no node, not even a root.
    """
    shards = shards or int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = pin(collapsed(paths))
    skeleton = Skeleton(splitters(rows, shards))
    nodes = pin(shard_nodes(rows, skeleton, shards))
    top = pin(skeleton_nodes(nodes, skeleton))
    above = top.select(F.col("skeleton").alias("number"), F.col("conv_id").alias("above"))
    low = nodes.where("skeleton is null").join(F.broadcast(above), F.col("under") == F.col("number"), "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "above"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return low.select(columns).union(top.select(columns))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all rebuilt conversations. Null role and text are empty, null turns first, turns with equal
    numbers in the order of their digests, rows without conv_id left out; repeated rows are turns of their own."""
    return prefix_trie(rebuilt(turns_of(table(spark, sf_dir, "conversations"))))


OP11_SQL = r"""
WITH clean AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
said AS (
  SELECT c, turn, md5(length(r)::VARCHAR || ':' || r || x) AS step,
    len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n FROM clean),
numbered AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, step) AS i FROM said),
-- The checksum of the decimal id: eight shifts for each of its bytes.
checked AS (
  SELECT c, len, c - c % 20 AS p, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ord(d)::BIGINT)),
    lambda k, d: list_reduce(list_prepend(xor(k, d), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295) % 4 AS h
  FROM (SELECT c, count(*) AS len FROM numbered GROUP BY c)),
based AS (SELECT k.c, k.p, k.h, least(k.h, coalesce(b.len, 0)) AS had FROM checked k LEFT JOIN checked b ON b.c = k.p),
turns AS (
  SELECT b.c, n.i AS d, n.step, n.n FROM based b JOIN numbered n ON n.c = b.p AND n.i <= b.h
  UNION ALL
  SELECT b.c, b.had + n.i - b.h, n.step, n.n FROM based b JOIN numbered n ON n.c = b.c AND n.i > b.h),
steps AS (
  SELECT c, d, md5(string_agg(step, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)) AS k, n FROM turns
  UNION ALL SELECT c, 0, '', 0 FROM based),
linked AS (SELECT *, lag(k) OVER (PARTITION BY c ORDER BY d) AS up, lead(k) OVER (PARTITION BY c ORDER BY d) IS NULL AS last FROM steps),
nodes AS (
  SELECT d, k, any_value(up) AS up, min(c) AS m, count(*) AS members, any_value(n) AS n,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM linked GROUP BY d, k),
kids AS (SELECT up AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN kids USING (d, k)),
-- Every node reaches its ancestors along its smallest member.
sums AS (
  SELECT s.d, s.k, sum((f.n_children = 0)::INT) AS n_leaves, sum((f.members - 1) * f.n) AS saved
  FROM full_nodes f JOIN steps s ON s.c = f.m AND s.d <= f.d GROUP BY s.d, s.k)
SELECT f.m AS conv_id, f.d AS depth, p.m AS parent_conv_id, f.members AS n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_nodes f JOIN sums s USING (d, k) LEFT JOIN full_nodes p ON p.d = f.d - 1 AND p.k = f.up
"""
