"""Alignment of two tokenizations of the same text: lockstep over all documents of a batch, corpus-wide link counts."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.bpe import encode_word, splitter
from meshframe.llm.common import pin, table
from meshframe.llm.tokens import byte_symbols
from meshframe.llm.wordhash import chunks

MODEL_A = "byte_bpe_50k.json"
MODEL_B = "piece_bpe_32k.model"
# Bytes of a stretch of one document that is advanced as a state of its own.
LANE_BYTES = 512
# Links of neighbouring documents whose pairs are counted together before they meet those of others.
SLICE_LINKS = 2_000_000
_CHUNK_BYTES = 1 << 20
_TALLY_ROWS = 100_000


# The merging library takes quadratic time for longer words.
_LONG = re.compile(r"\S{1000}|\s{1000}")


class ByteVocabulary:
    """A byte-level vocabulary: what each id stands for, and the ids of a text, in which special strings are ordinary."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        before = spec["pre_tokenizer"]
        if spec.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError("not a plain byte-level vocabulary")
        byte = {s: b for b, s in enumerate(byte_symbols())}
        vocab = spec["model"]["vocab"]
        special = {t["content"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(byte[c] for c in token)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("ids do not follow the order of the merges")
        self.rank = {b: i for i, b in enumerate(self.bytes) if b}
        self.split = splitter(public_tokenizers.PATTERN)
        self.library = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.rank, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if _LONG.search(text):
            return list(chain.from_iterable(encode_word(w.encode(), self.rank) for w in self.split(text)))
        return self.library.encode_ordinary(text)


class PieceVocabulary:
    """A SentencePiece vocabulary, likewise."""

    def __init__(self, raw: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=raw)
        size = self.library.get_piece_size()
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.library.is_byte(i)
            else b"" if self.library.is_control(i) or self.library.is_unknown(i) else piece.replace("\u2581", " ").encode()
            for i, piece in enumerate(self.library.id_to_piece(list(range(size))))]

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


class Pair:
    """Both vocabularies of a worker, with the tables that batches are joined with."""

    def __init__(self, raw_a: bytes, raw_b: bytes):
        self.sides = ByteVocabulary(raw_a), PieceVocabulary(raw_b)
        self.sizes = [np.fromiter(map(len, v.bytes), np.int64, len(v.bytes)) for v in self.sides]
        self.count = [len(v.bytes) for v in self.sides]
        #: Decimal ids with each mark that may follow: A with comma, A with bar, B with comma, B with semicolon.
        self.marked = [f"{i}{mark}" for n, marks in zip(self.count, (",|", ",;")) for mark in marks for i in range(n)]

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids by A of a space and the text, and by B of the text; none where their bytes are not those of a space and the text."""
        spaced = " " + (text or "")
        whole, out = spaced.encode(), []
        for vocabulary, t in zip(self.sides, (spaced, text or "")):
            ids = vocabulary.encode(t) if text else []
            if text and b"".join(map(vocabulary.bytes.__getitem__, ids)) != whole:
                ids = []
            out.append(np.array(ids, np.int32))
        return (out[0], out[1]) if len(out[0]) and len(out[1]) else (out[0][:0], out[1][:0])


@lru_cache(maxsize=2)
def pair(raw_a: bytes, raw_b: bytes) -> Pair:
    return Pair(raw_a, raw_b)


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of all tokens that end together.

    The ends lie on one line of bytes, document after document. Between each two ``bounds`` there is a state, a pointer
    into A and one into B. In every step all states move at once: the pointer whose token ends first, or both where
    they end together, which gives a link and a cut. Finished states leave the vectors.
    """
    at_a, at_b = (np.searchsorted(e, bounds[:-1], "right") for e in (ends_a, ends_b))
    stop_a, stop_b = (np.searchsorted(e, bounds[1:], "right") for e in (ends_a, ends_b))
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while True:
        live = np.flatnonzero((at_a < stop_a) & (at_b < stop_b))
        if len(live) < len(at_a):
            at_a, at_b, stop_a, stop_b = at_a[live], at_b[live], stop_a[live], stop_b[live]
        if not len(at_a):
            break
        x, y = ends_a[at_a], ends_b[at_b]
        met = np.flatnonzero(x == y)
        links_a.append(at_a[met])
        links_b.append(at_b[met])
        at_a = at_a + (x <= y)
        at_b = at_b + (y <= x)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a)
    return a[order], b[order]


def lanes(sizes: np.ndarray) -> np.ndarray:
    """Bounds of the stretches of documents of the given sizes in bytes, laid one after another."""
    ends = np.cumsum(sizes)
    return np.unique(np.concatenate([[0], ends, np.arange(0, ends[-1] if len(ends) else 0, LANE_BYTES)]))


def group_rows(a: np.ndarray, b: np.ndarray, link_a: np.ndarray, link_b: np.ndarray, count: list[int]) -> np.ndarray:
    """Places in ``Pair.marked`` of all tokens: by group, A before B."""
    last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    last_a[link_a], last_b[link_b] = 1, 1
    # B tokens in front of each A token are those of the groups before; A tokens in front of a B token also those of its group.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), np.int32)
    out[np.arange(len(a)) + np.concatenate([[0], link_b + 1])[group_a]] = a + count[0] * last_a
    out[np.arange(len(b)) + (link_a + 1)[group_b]] = b + 2 * count[0] + count[1] * last_b
    return out


def align(docs: DataFrame, path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """One row for every row of ``docs``, and rows with the tallies of link pairs.

    Document rows have ``row`` (a struct of the columns of ``docs`` but the text), ``slice``, ``n_a``, ``n_b``, ``n_groups``, ``groups``
    (ids of the groups in order, A before B: ``a1,a2|b1;a3|b2,b3``) and ``links`` (codes of the pairs of tokens
    that end together: id of A times the number of B ids, plus id of B). Tally rows have ``slice``, ``codes`` and ``times`` instead: how often each
    pair is linked in the documents of that slice. A slice is a stretch of neighbouring rows with some ``SLICE_LINKS`` links.

    Texts that are null, empty or differ from what the ids of A or B stand for have no tokens.
    """
    spark = docs.sparkSession
    raw = []
    for path in (path_a, path_b):
        with open(path, "rb") as f:
            raw.append(f.read())
    shared = spark.sparkContext.broadcast(raw)
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(None).alias("none")]).alias("row"), F.col(f"`{text}`").alias("text"))
    # Codes of most vocabularies fit 32 bits.
    small = _codes(*raw) <= 1 << 31
    codes, times = T.ArrayType(T.IntegerType() if small else T.LongType()), T.ArrayType(T.LongType())
    code_type = pa.int32() if small else pa.int64()
    schema = T.StructType([
        rows.schema["row"], T.StructField("slice", T.LongType()), T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()),
        T.StructField("n_groups", T.LongType()), T.StructField("groups", T.StringType()), T.StructField("links", codes),
        T.StructField("codes", codes), T.StructField("times", times)])
    schema["row"].nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = pair(*shared.value)
        part = TaskContext.get().partitionId() << 32
        seen, room = [], SLICE_LINKS
        row_type = None

        def tally() -> Iterator[pa.RecordBatch]:
            found, times = np.unique(np.concatenate(seen), return_counts=True) if seen else ((), ())
            for i in range(0, len(found), _TALLY_ROWS):
                columns = [pa.nulls(1, row_type), pa.array([part]), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.nulls(1, pa.string()),
                           pa.nulls(1, pa.list_(code_type)),
                           *(_one_list(x[i:i + _TALLY_ROWS], t) for x, t in ((found, code_type), (times, pa.int64())))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
            row_type = batch.schema.field("row").type
            ids = [both.encode(t) for t in texts]
            flat = [np.concatenate([x[k] for x in ids]) for k in (0, 1)]
            bounds_a, bounds_b = (np.cumsum([0, *(len(x[k]) for x in ids)]) for k in (0, 1))
            ends_a, ends_b = (np.cumsum(both.sizes[k][flat[k]]) for k in (0, 1))
            link_a, link_b = lockstep(ends_a, ends_b, lanes(np.diff(np.concatenate([[0], ends_a])[bounds_a])))
            bounds = np.searchsorted(link_a, bounds_a)
            placed = group_rows(*flat, link_a, link_b, both.count)
            ends = (bounds_a + bounds_b).tolist()
            groups = ["".join(map(both.marked.__getitem__, placed[lo:hi].tolist()))[:-1] for lo, hi in zip(ends[:-1], ends[1:])]
            code = (flat[0][link_a].astype(np.int64) * both.count[1] + flat[1][link_b]).astype(code_type.to_pandas_dtype())
            n = len(texts)
            yield pa.RecordBatch.from_arrays([
                batch.column(batch.schema.get_field_index("row")), pa.array(np.full(n, part)), pa.array(np.diff(bounds_a)), pa.array(np.diff(bounds_b)),
                pa.array(np.diff(bounds)), pa.array(groups, pa.string()),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(code)),
                pa.nulls(n, pa.list_(code_type)), pa.nulls(n, pa.list_(pa.int64()))], names=schema.names)
            seen.append(code)
            room -= len(code)
            if room <= 0:
                yield from tally()
                seen, room, part = [], SLICE_LINKS, part + 1
        yield from tally()

    return rows.mapInArrow(run, schema)


def _one_list(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _codes(raw_a: bytes, raw_b: bytes) -> int:
    """How many codes there can be."""
    return math.prod(pair(raw_a, raw_b).count)


def pair_counts(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """(slice, code, n, best) for every pair of each slice: how many links hold the pair corpus-wide, and whether no pair
    of the same B id has more. Slices have counted their own pairs, so a frequent pair comes once from each."""
    seen = aligned.where("codes is not null").select("slice", F.explode(F.arrays_zip("codes", "times")).alias("c")).select(
        "slice", F.col("c.codes").alias("code"), F.col("c.times").alias("times"))
    counts = seen.groupBy("code").agg(F.sum("times").alias("n"))
    of_b = F.col("code") % F.lit(n_b_ids)
    top = counts.groupBy(of_b.alias("b")).agg(F.max("n").alias("top"))
    judged = counts.withColumn("b", of_b).join(top, "b").select(F.col("code").alias("pair"), "n", (F.col("n") == F.col("top")).alias("best"))
    return seen.join(judged, F.col("code") == F.col("pair")).select("slice", "code", "n", "best")


def link_figures(aligned: DataFrame, n_b_ids: int) -> DataFrame:
    """Document rows of ``aligned`` with ``n_best`` (links whose pair is a best one of its B id) and ``count_sum`` (the pairs'
    corpus-wide counts over all links) in place of ``links``; ``aligned`` is read twice and should be written before.

    Documents meet the counts of their slice only, which are as many as the slice has different pairs.
    """
    keep = [f for f in aligned.schema.fields if f.name not in ("links", "codes", "times", "slice")]
    fields = T.StructType([*keep, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    docs = aligned.where("codes is null").select(*[f.name for f in keep], "links", F.col("slice").alias("home"))

    def look_up(docs: pa.Table, pairs: pa.Table) -> pa.Table:
        code, n, best = (pairs.column(c).to_numpy() for c in ("code", "n", "best"))
        order = np.argsort(code)
        links = docs.column("links").combine_chunks()
        links = links.chunk(0) if isinstance(links, pa.ChunkedArray) else links
        sizes = links.value_lengths().to_numpy(zero_copy_only=False)
        at = order[np.searchsorted(code, links.flatten().to_numpy(), sorter=order)] if len(code) else np.empty(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        out = [docs.column(f.name) for f in keep]
        for values in (best, n):
            total = np.concatenate([[0], np.cumsum(values[at].astype(np.int64))])
            out.append(pa.array(total[ends[1:]] - total[ends[:-1]]))
        return pa.Table.from_arrays(out, names=fields.names)

    return docs.groupBy("home").cogroup(pair_counts(aligned, n_b_ids).groupBy("slice")).applyInArrow(look_up, fields)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two tokenizations of all documents.

    Null and empty texts, and those with U+2581, have zeros and no groups. Repeated rows give equal rows, and
    all their links count. An empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path_b = public_tokenizers.path(MODEL_B)
    n_b_ids = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    aligned = pin(align(docs, public_tokenizers.path(MODEL_A), path_b).withColumn("groups_sha256", digest).drop("groups"))
    return link_figures(aligned, n_b_ids).select(
        "row.doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
