"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import table

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
# Words whose counts a worker remembers; further words are merged anew each time.
CACHE_WORDS = 500_000
# White space as the tokenizer's patterns have it.
_SPACE = r"\t-\r\x20\x85\p{Z}"
_ID_BITS = 24


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (b for b in range(256) if b not in shown)
    moved = {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [moved.get(b) or chr(b) for b in range(256)]


class WordCounter(dict):
    """Tokens of each word, filled as words are asked for."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        ids = model["vocab"]
        symbols = byte_symbols()
        self.inner = [ids[s] for s in symbols]
        self.last = [ids[s + model["end_of_word_suffix"]] for s in symbols]
        self.merges = {
            ids[a] << _ID_BITS | ids[b]: (rank, ids[a + b]) for rank, (a, b) in enumerate(model["merges"])
        }
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.word = regex.compile(split.replace(r"\s", _SPACE))

    def merged(self, word: str) -> int:
        """Tokens of one word: its symbols less the merges that apply, lowest rank first, then leftmost."""
        raw = word.encode()
        n = len(raw)
        sym = [self.inner[b] for b in raw]
        sym[-1] = self.last[raw[-1]]
        merges = self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            pair = sym[i] << _ID_BITS | sym[i + 1]
            if pair in merges:
                heap.append((merges[pair][0], i, pair))
        heapify(heap)
        left = n
        while heap:
            _, i, pair = heappop(heap)
            j = after[i]
            # Entries of pairs that have changed since are stale. A merged right side is -1.
            if sym[i] < 0 or j >= n or sym[i] << _ID_BITS | sym[j] != pair:
                continue
            sym[i], sym[j] = merges[pair][1], -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                pair = sym[i] << _ID_BITS | sym[k]
                if pair in merges:
                    heappush(heap, (merges[pair][0], i, pair))
            h = before[i]
            if h >= 0:
                pair = sym[h] << _ID_BITS | sym[i]
                if pair in merges:
                    heappush(heap, (merges[pair][0], h, pair))
        return left

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(self) < CACHE_WORDS:
            self[word] = n
        return n

    def plain(self, text: str) -> int:
        # Lower case goes character by character, without the rule for a final sigma.
        folded = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return sum(map(self.__getitem__, self.word.findall(folded)))

    def count(self, text: str | None) -> int:
        """Special strings count one each, as the library takes them by default; the rest by words."""
        if not text:
            return 0
        if not self.special or not self.special.search(text):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


_COUNTERS: dict[bytes, WordCounter] = {}


def counter(raw: bytes) -> WordCounter:
    """One counter per vocabulary and worker process."""
    if raw not in _COUNTERS:
        _COUNTERS[raw] = WordCounter(raw)
    return _COUNTERS[raw]


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each text; null and empty texts have none.

    The vocabulary file has a fixed size and is sent to the workers; rows stay where they are. A column
    named ``out`` is replaced.
    """
    with open(tokenizer_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    df = df.drop(out)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = counter(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            counts = pa.array([words.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, out])

    return df.mapInArrow(count, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. Repeated rows count alike; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = count_tokens(docs, public_tokenizers.path(TOKENIZER))
    return sized.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"))
