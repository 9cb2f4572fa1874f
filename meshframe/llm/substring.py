"""Repeated passages across texts by difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import salted_join, table
from meshframe.llm.wordhash import chunks, mix, window_hashes, word_hashes, words

WIDTH = 35
# Perfect difference covers, period to positions. For any two places some shift
# below the period takes both to a position of the cover.
COVERS = {
    1: (0,),
    3: (0, 1),
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
}
_CHUNK_BYTES = 1 << 21
_SECOND = np.uint64(0x9FB21C651E98DF25)
# Anchors only nominate windows, so 48 bits of their hashes do; windows are told apart by 96.
_ANCHOR_BITS = np.uint64((1 << 48) - 1)


def cover(width: int) -> tuple[int, int]:
    """Period and anchor length for matches of ``width`` words: the longest period whose anchors, which
    are what any alignment leaves of a match, still have two fifths of it."""
    period = max(p for p in COVERS if (width - p + 1) * 5 >= width * 2)
    return period, width - period + 1


def _repeated(parts: list[np.ndarray]) -> np.ndarray:
    """Which of the concatenated numbers occur more than once."""
    all_ = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    _, back, times = np.unique(all_, return_inverse=True, return_counts=True)
    return times[back] > 1


def _rows(keys: dict[str, np.ndarray], k: np.ndarray, at: np.ndarray, k2: np.ndarray | None, known: np.ndarray) -> pa.RecordBatch:
    """Occurrences for the shuffle: the hash, the row's key k, and a number that holds the place, whether the
    occurrence is known to repeat (lowest bit) and, if given, k2 (upper half); -1 marks a marker.

    An occurrence that repeats within the slice needs no company: it goes by a key of its own, and a single
    marker tells the others, so a hot hash has one row per slice.
    """
    place = mix(k.view(np.uint64) + at.astype(np.uint64) * _SECOND)
    mark = np.flatnonzero(known)
    mark = mark[np.unique(keys["g"][mark], return_index=True)[1]]
    number = at.astype(np.int64) * 2 + known
    if k2 is not None:
        number |= k2.astype(np.int64) << 32
    columns = {}
    for name, key in keys.items():
        mine = (place >> np.uint64(64 - 8 * key.dtype.itemsize)).astype(key.dtype) if name != "g" else place
        columns[name] = np.concatenate([np.where(known, mine, key), key[mark]])
    columns["g"] = columns["g"].view(np.int64)
    columns["k"] = np.concatenate([k, np.zeros(len(mark), np.int64)])
    columns["p"] = np.concatenate([number, np.full(len(mark), -1)])
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _anchors(width: int):
    period, length = cover(width)
    on = np.zeros(period, bool)
    on[list(COVERS[period])] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
            keys = batch.column(batch.schema.get_field_index("k")).to_numpy(zero_copy_only=False)
            found, places, rows = [], [], []
            for k, t in zip(keys, texts):
                h = word_hashes(words(t))
                if len(h) < width:
                    continue
                anchors = window_hashes(h, length)
                at = np.flatnonzero(on[np.arange(len(anchors)) % period])
                found.append(anchors[at])
                places.append(at.astype(np.int32))
                rows.append(np.full(len(at), k, np.int64))
            if found:
                h = np.concatenate(found)
                yield _rows({"g": h & _ANCHOR_BITS}, np.concatenate(rows), np.concatenate(places), None, _repeated(found))

    return run


def _windows(width: int):
    _, length = cover(width)
    reach = width - length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            keys, seconds = col("k").to_numpy(zero_copy_only=False), col("k2").to_numpy(zero_copy_only=False)
            first, second, places, rows, rows2 = [], [], [], [], []
            for k, k2, t, anchors in zip(keys, seconds, texts, col("anchors")):
                h = word_hashes(words(t))
                last = len(h) - width
                near = np.zeros(last + 2, np.int64)
                p = np.asarray(anchors.values.to_numpy(zero_copy_only=False))
                np.add.at(near, np.clip(p - reach, 0, last + 1), 1)
                np.add.at(near, np.clip(p + 1, 0, last + 1), -1)
                at = np.flatnonzero(np.cumsum(near)[:last + 1] > 0)
                first.append(window_hashes(h, width)[at])
                second.append(window_hashes(h, width, _SECOND)[at])
                places.append(at.astype(np.int32))
                rows.append(np.full(len(at), k, np.int64))
                rows2.append(np.full(len(at), k2, np.int32))
            if first:
                a, b = np.concatenate(first), np.concatenate(second)
                yield _rows({"g": a, "g2": b.astype(np.uint32).view(np.int32)}, np.concatenate(rows), np.concatenate(places),
                            np.concatenate(rows2), _repeated([mix(a ^ mix(b))]))

    return run


def _kept(width: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
            counts, removed, kept = [], [], []
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            for t, starts, copied in zip(texts, col("starts"), col("copied").to_pylist()):
                found = words(t)
                counts.append(len(found))
                if copied and len(found) >= width:
                    found = []
                elif starts.is_valid:
                    at = starts.values.to_numpy(zero_copy_only=False)
                    edge = np.zeros(len(found) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + width, -1)
                    stay = np.cumsum(edge)[:-1] == 0
                    found = [found[i] for i in np.flatnonzero(stay)]
                removed.append(counts[-1] - len(found))
                kept.append(b" ".join(found))
            yield pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(n)) for n in names),
                pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()),
            ], names=[*names, "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Key, n_words, n_removed, kept_sha256 and kept_text of every row: the words outside repeated windows.

    A window of ``width`` words repeats if its words also start elsewhere, in this row or another; equal
    rows count as another. Null and empty texts have no words; shorter texts keep all; keys may repeat or be null.

    Words are hashed once per text, and anchors only at the positions of a difference cover: of two equal
    windows some shift takes both to cover positions, so they share an anchor. Anchors that occur once
    end there. Only windows around the others are hashed whole, in 96 bits, and counted, which extends every
    match to its full length. Of equal texts, whose windows all repeat, only the first goes through this, on behalf
    of all. Texts are shuffled once, by a hash of the row, and all joins with them use that layout; a hash
    that is frequent in a slice of texts is shuffled once for the slice.
    """
    rows = docs.select(F.col(key).alias(key), F.col(text).cast("binary").alias("text")).withColumns({
        "k": F.xxhash64(key, "text"), "k2": F.hash(key, "text"), "t1": F.xxhash64("text"), "t2": F.xxhash64("text", F.lit(1))})
    copies = rows.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("k").alias("first")).where("n > 1").drop("n")
    flags = (
        salted_join(rows.select("k", "k2", "t1", "t2"), copies, ["t1", "t2"], "k")
        .groupBy("k").agg(F.collect_set(F.struct("k2", (F.col("k") == F.col("first")).alias("first"))).alias("flags"))
    )
    own_flags = F.filter("flags", lambda x: x["k2"] == F.col("k2"))
    role = F.when(F.coalesce(F.size(own_flags), F.lit(-1)) < 1, "only").when(
        F.exists(own_flags, lambda x: x["first"]), "first").otherwise("copy")
    base = rows.select(key, "text", "k", "k2").repartition("k").join(flags.hint("shuffle_hash"), "k", "left").select(
        key, "text", "k", "k2", role.alias("role"))
    anchors = base.where("role <> 'copy'").mapInArrow(_anchors(width), "g long, k long, p long")
    company = lambda *keys: F.count(F.lit(1)).over(Window.partitionBy(*keys))
    shared = (
        anchors.withColumn("n", company("g")).where("p >= 0 and (n > 1 or p % 2 = 1)")
        .groupBy("k").agg(F.collect_set(F.shiftright("p", 1).cast("int")).alias("anchors"))
    )
    windows = base.where("role <> 'copy'").join(shared.hint("shuffle_hash"), "k").mapInArrow(
        _windows(width), "g long, g2 int, k long, p long")
    starts = (
        windows.withColumn("n", company("g", "g2")).where("p <> -1 and (n > 1 or p & 1 = 1)")
        .groupBy("k").agg(F.collect_set("p").alias("found"))
    )
    mine = F.transform(F.filter("found", lambda p: F.shiftright(p, 32) == F.col("k2")),
                       lambda p: F.shiftright(p.bitwiseAND(F.lit(0xFFFFFFFF)), 1).cast("int"))
    left = base.join(starts.hint("shuffle_hash"), "k", "left").select(
        key, "text", mine.alias("starts"), (F.col("role") != "only").alias("copied"))
    return left.mapInArrow(_kept(width, [key]), T.StructType([
        left.schema[key], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.BinaryType())]))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows.

    Null, empty and short texts have no window and keep their words. Equal rows repeat each other, so each loses its windows; ties do
    not arise, as windows are judged on the input. Texts of any length are one row; other columns are not read; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS t FROM w, unnest(range(1, len(ws) - 33)) u(s)),
dup AS (SELECT t FROM win GROUP BY t HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, s + k AS p FROM win JOIN dup USING (t), range(35) r(k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
         FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
