"""Byte-level BPE over a global shuffle of distinct words."""

from __future__ import annotations

import base64
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import table
from meshframe.llm.wordhash import chunks

RANKS = "byte_bpe_multi_50k.tiktoken"
# Neighbouring texts whose words are shuffled once for all of them: until they have so many bytes or different words.
SLICE_BYTES = 16 << 20
SLICE_WORDS = 1 << 19
# Ids of so many words are remembered within a bucket of words; a bucket with more encodes some of them again.
KNOWN_WORDS = 1 << 20
_CHUNK_BYTES = 1 << 21

# The splitting pattern knows letters, numbers and white space; the latter in Unicode's definition.
_WHITE = r"\t-\r\x20\x85\p{Z}"


def _ranges(category: str) -> str:
    """The characters below 0x10000 of a general category, as ranges of a character class."""
    out, start = [], None
    for code in range(0x10001):
        inside = code < 0x10000 and not 0xD800 <= code < 0xE000 and unicodedata.category(chr(code)).startswith(category)
        if inside and start is None:
            start = code
        elif not inside and start is not None:
            out.append(f"\\u{start:04x}-\\u{code - 1:04x}")
            start = None
    return "".join(out)


class Splitter:
    """Matches of the pattern in a text.

    Texts without characters beyond the basic plane go through the standard engine, which is twice as fast,
    with the same pattern in explicit classes.
    """

    def __init__(self, pattern: str):
        self.full = regex.compile(pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]"))
        letters, numbers, white = _ranges("L"), _ranges("N"), r"\t-\r\x20\x85" + _ranges("Z")
        basic = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]")
        basic = basic.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]")
        self.basic = re.compile(basic.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]"))
        self.beyond = re.compile("[\U00010000-\U0010ffff]")

    def __call__(self, text: str | None) -> list[str]:
        if not text:
            return []
        return (self.full if self.beyond.search(text) else self.basic).findall(text)


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


@lru_cache(maxsize=4)
def rank_table(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}


@lru_cache(maxsize=4)
def piece_table(raw: bytes) -> list[bytes]:
    """Bytes of each id."""
    ranks = rank_table(raw)
    out = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        out[rank] = piece
    return out


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: neighbours whose joint bytes have the lowest rank are joined, leftmost first."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    ends = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get(word[i:i + 2])
        if rank is not None:
            heap.append((rank, i, i + 2))
    heapify(heap)
    # ends[i] is where the part that starts at i ends, 0 once it has joined the part before.
    while heap:
        _, i, end = heappop(heap)
        j = ends[i]
        if not j or j >= n or ends[j] != end:
            continue
        ends[i], ends[j] = end, 0
        if end < n:
            before[end] = i
            rank = ranks.get(word[i:ends[end]])
            if rank is not None:
                heappush(heap, (rank, i, ends[end]))
        h = before[i]
        if h >= 0:
            rank = ranks.get(word[h:end])
            if rank is not None:
                heappush(heap, (rank, h, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:ends[i]]])
        i = ends[i]
    return out


def _pack(codes: np.ndarray) -> bytes:
    """Numbers in seven-bit groups, low ones first, so small ones take one byte."""
    size = np.ones(len(codes), np.int64)
    for g in range(1, 5):
        size += codes >= 1 << (7 * g)
    groups = int(size.max(initial=1))
    out = np.zeros((len(codes), groups), np.uint8)
    for g in range(groups):
        out[:, g] = (codes >> (7 * g)) & 127
    place = np.arange(groups)
    out |= ((place < size[:, None] - 1) << 7).astype(np.uint8)
    return out[place < size[:, None]].tobytes()


def _unpack(body: bytes) -> np.ndarray:
    raw = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(raw < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    codes = np.zeros(len(ends), np.int64)
    for g in range(int((ends - starts).max(initial=0)) + 1):
        at = starts + g
        on = at <= ends
        codes[on] |= (raw[at[on]].astype(np.int64) & 127) << (7 * g)
    return codes


class _Codes(dict):
    """Numbers of words in the order in which they first occur, so frequent words tend to get small ones."""

    def __missing__(self, word: str) -> int:
        out = self[word] = len(self)
        return out


class _Slice:
    """Neighbouring texts as numbers of words, and their different words by bucket."""

    def __init__(self, part: int):
        self.codes, self.bodies, self.bytes = _Codes(), [], 0
        # The id tells slices with other rows apart, should a lost task be run again over rows in another order.
        self.digest = xxhash.xxh3_64(part.to_bytes(8, "little"))

    def add(self, keys: pa.Array, texts: list[str | None], split: Splitter) -> None:
        found = [list(map(self.codes.__getitem__, split(t))) for t in texts]
        sizes = np.fromiter(map(len, found), np.int32, len(found))
        flat = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        self.bodies.append((keys, sizes, zlib.compress(_pack(flat), 6)))
        for t in texts:
            self.digest.update(b"-" if t is None else t.encode())
            self.bytes += len(t or "")

    @property
    def full(self) -> bool:
        return self.bytes >= SLICE_BYTES or len(self.codes) >= SLICE_WORDS

    def rows(self, buckets: int, key: str, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = ["k", "slice", key, "sizes", "body", "words"]
        number = self.digest.intdigest() - (1 << 63)
        for keys, sizes, body in self.bodies:
            yield pa.RecordBatch.from_arrays([
                pa.array([number]), pa.array([number]), _one(keys), _one(pa.array(sizes)), pa.array([body], pa.binary()),
                pa.nulls(1, pa.binary())], names=names)
        raw = [w.encode() for w in self.codes]
        bucket = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        used, first = np.unique(bucket[order], return_index=True)
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        blobs = []
        for codes in np.split(order, first[1:]) if len(used) else []:
            numbers = _pack(np.concatenate([[len(codes)], np.diff(codes, prepend=0), size[codes]]))
            blobs.append(zlib.compress(len(numbers).to_bytes(4, "little") + numbers + b"".join(map(raw.__getitem__, codes.tolist())), 6))
        n = len(blobs)
        if n:
            yield pa.RecordBatch.from_arrays([
                pa.array(used.astype(np.int64)), pa.array(np.full(n, number)), pa.nulls(n, pa.list_(key_type)), pa.nulls(n, pa.list_(pa.int32())),
                pa.nulls(n, pa.binary()), pa.array(blobs, pa.binary())], names=names)


def _one(values: pa.Array) -> pa.ListArray:
    """All values as one list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _split_docs(pattern: str, buckets: int, key: str, key_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, part = splitter(pattern), TaskContext.get().partitionId() << 32
        part_of = _Slice(part)
        for batch, texts in chunks(batches, "text", _CHUNK_BYTES):
            part_of.add(batch.column(batch.schema.get_field_index(key)), texts, split)
            if part_of.full:
                yield from part_of.rows(buckets, key, key_type)
                part += 1
                part_of = _Slice(part)
        if part_of.bodies:
            yield from part_of.rows(buckets, key, key_type)

    return run


def _encode_words(shared):
    """The different words of each slice that fall into a bucket: their numbers, how many ids each has, and the ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All slices' words of a bucket follow each other in this partition, so each word is encoded once.
        ranks, known, bucket = rank_table(shared.value), {}, None
        for batch in batches:
            col = lambda name, batch=batch: batch.column(batch.schema.get_field_index(name))
            slices, out = [], []
            for k, number, blob in zip(col("k").to_pylist(), col("slice").to_pylist(), col("words")):
                if not blob.is_valid:
                    continue
                if k != bucket or len(known) > KNOWN_WORDS:
                    known, bucket = {}, k
                raw = zlib.decompress(blob.as_py())
                at = 4 + int.from_bytes(raw[:4], "little")
                numbers = _unpack(raw[4:at])
                n = int(numbers[0])
                ids = []
                for size in numbers[1 + n:].tolist():
                    w = raw[at:at + size]
                    at += size
                    x = known.get(w)
                    if x is None:
                        x = known[w] = encode_word(w, ranks)
                    ids.append(x)
                counts = np.fromiter(map(len, ids), np.int64, n)
                flat = np.fromiter(chain.from_iterable(ids), np.int64, int(counts.sum()))
                slices.append(number)
                out.append(zlib.compress(_pack(np.concatenate([numbers[:1 + n], counts, flat])), 6))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(slices), pa.array(out, pa.binary())], names=["of", "found"])

    return run


def _assemble(shared, key: str, fields: T.StructType):
    def run(docs: pa.Table, words: pa.Table) -> pa.Table:
        bodies = [i for i, b in enumerate(docs.column("body")) if b.is_valid]
        if not bodies:
            return pa.Table.from_batches([], schema=pa.schema([
                pa.field(key, docs.schema.field(key).type.value_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())]))
        # Where each word's ids start in ``flat`` and how many they are, by the word's number.
        codes, counts, flats = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for blob in words.column("found"):
            numbers = _unpack(zlib.decompress(blob.as_py()))
            n = int(numbers[0])
            codes.append(np.cumsum(numbers[1:1 + n]))
            counts.append(numbers[1 + n:1 + 2 * n])
            flats.append(numbers[1 + 2 * n:])
        codes, counts, flat = map(np.concatenate, (codes, counts, flats))
        length, start = np.zeros((2, int(codes.max(initial=-1)) + 1), np.int64)
        length[codes], start[codes] = counts, np.cumsum(counts) - counts
        if len(codes) != len(length):
            raise RuntimeError("the words of a slice are not complete: its rows came in another order when a task was run again")
        pieces = piece_table(shared.value)
        piece_size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        piece_start, piece_bytes = np.cumsum(piece_size) - piece_size, np.frombuffer(b"".join(pieces), np.uint8)
        keys, out_ids, out_bytes = [], [], []
        for i in bodies:
            of = _unpack(zlib.decompress(docs.column("body")[i].as_py()))
            sizes = docs.column("sizes")[i].values.to_numpy(zero_copy_only=False)
            ids = flat[_spans(start[of], length[of])]
            # Decoding: a join of the ids with the table of token bytes.
            decoded = piece_bytes[_spans(piece_start[ids], piece_size[ids])]
            of_words = np.concatenate([[0], np.cumsum(length[of])])[np.concatenate([[0], np.cumsum(sizes)])]
            of_ids = np.concatenate([[0], np.cumsum(piece_size[ids])])[of_words]
            keys.append(docs.column(key)[i].values)
            out_ids.append(pa.ListArray.from_arrays(pa.array(of_words.astype(np.int32)), pa.array(ids.astype(np.int32))))
            out_bytes.append(pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(of_ids.astype(np.int32)), pa.py_buffer(decoded)]))
        return pa.Table.from_arrays([pa.chunked_array(keys), pa.chunked_array(out_ids), pa.chunked_array(out_bytes)], names=fields.names)

    return run


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each start on, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def encode_decode(docs: DataFrame, ranks_path: str, key: str = "doc_id", text: str = "text",
                  pattern: str = public_tokenizers.PATTERN, buckets: int | None = None) -> DataFrame:
    """Key, ids (array of int) and decoded (the bytes that the ids stand for) of every row.

    Null and empty texts have no ids; special strings are ordinary text; keys may repeat or be null, and equal
    rows give equal rows; no rows give none.

    Texts are cut into words by the pattern. Neighbouring texts form a slice, in which every different word has a number;
    a text is the row of its words' numbers, so positions stay with it. The different words of all slices are shuffled
    by the word: each goes once from a slice to the bucket of its hash, and each is encoded once there. Its
    ids are joined back to the slice, which has been shuffled in the same exchange, and put in place of the numbers. Decoding
    joins the ids with the table of token bytes, which has a fixed size and is sent to the workers.
    """
    spark = docs.sparkSession
    with open(ranks_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    buckets = buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(text).alias("text"), F.col(key).alias(key))
    key_field = rows.schema[key]
    from pyspark.sql.pandas.types import to_arrow_type

    schema = T.StructType([
        T.StructField("k", T.LongType()), T.StructField("slice", T.LongType()), T.StructField(key, T.ArrayType(key_field.dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("body", T.BinaryType()), T.StructField("words", T.BinaryType())])
    # Slices go by their own number, words by their bucket. Both readers below take all columns, so the exchange is one.
    parts = rows.mapInArrow(_split_docs(pattern, buckets, key, to_arrow_type(key_field.dataType)), schema).repartition("k")
    found = parts.sortWithinPartitions("k").mapInArrow(_encode_words(shared), "of long, found binary")
    fields = T.StructType([key_field, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())])
    return parts.groupBy("k").cogroup(found.groupBy("of")).applyInArrow(_assemble(shared, key, fields), fields)


def digests(encoded: DataFrame) -> DataFrame:
    """n_tokens and the digests of ids and bytes in place of ids and decoded."""
    return encoded.withColumns({
        "n_tokens": F.size("ids").cast("bigint"),
        "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }).drop("ids", "decoded")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(encode_decode(docs, public_tokenizers.path(RANKS)))
