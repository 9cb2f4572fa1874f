"""SentencePiece merge-type encoding by backtracking over longest matches, and decoding."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshframe.llm.common import table
from meshframe.llm.wordhash import chunks

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
# Stretches of text and pairs of pieces that a worker remembers; further ones are worked out anew each time.
CACHE_STRETCHES = 500_000
CACHE_PAIRS = 1_000_000
_CHUNK_BYTES = 1 << 21
# Kinds of pieces in the model file.
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
# The model type that merges pairs.
_MERGES = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        wire = tag & 7
        if wire == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(wire) or number()
        yield tag >> 3, raw[at:at + size]
        at += size


class PieceModel:
    """Pieces of a model file with their scores, and the encoding by them.

    Only models that merge pairs, spell unknown characters in bytes, put one space before the text and
    change it in no other way are taken.
    """

    def __init__(self, raw: bytes):
        parts: dict[int, list] = {}
        for number, value in _fields(raw):
            parts.setdefault(number, []).append(value)
        pieces = [dict(_fields(p)) for p in parts[1]]
        trainer, normal = dict(_fields(parts[2][0])), dict(_fields(parts[3][0]))
        if trainer.get(3) != _MERGES or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("not a merge model with byte fallback, a space put first and no further normalization")
        names = [p[1].decode() for p in pieces]
        kinds = [p.get(3, _NORMAL) for p in pieces]
        if set(kinds) - {_NORMAL, _UNKNOWN, 3, _BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.id = {n: i for i, n in enumerate(names) if kinds[i] == _NORMAL}
        self.score = {n: struct.unpack("<f", pieces[i][2])[0] if 2 in pieces[i] else 0.0 for n, i in self.id.items()}
        byte = {int(n[3:5], 16): i for i, n in enumerate(names) if kinds[i] == _BYTE}
        self.byte = [byte[b] for b in range(256)]
        #: What each id stands for, in bytes; nothing for control pieces.
        self.bytes = [
            n.replace(SPACE, " ").encode() if kind == _NORMAL else bytes([int(n[3:5], 16)]) if kind == _BYTE else b""
            for n, kind in zip(names, kinds)]
        # Single characters need no matcher: each is an option wherever it stands.
        self.matcher = ahocorasick.Automaton()
        for n in self.id:
            if len(n) > 1:
                self.matcher.add_word(n, n)
        self.matcher.make_automaton()
        # The next shorter piece that a piece starts with; a single character ends the chain.
        self.shorter = {n: next((n[:k] for k in range(len(n) - 1, 1, -1) if n[:k] in self.id), n[0]) for n in self.id if len(n) > 1}
        # No merge crosses two neighbours that no piece has. So where no piece has a space behind another character, texts
        # are cut there, and ASCII characters that are in no longer piece stand alone.
        if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in self.id):
            self.stretch = re.compile("(?s:.+)")
        else:
            joined = set().union(*self.shorter)
            alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in joined)
            self.stretch = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]")
        self.fit: dict[str, dict[str, str]] = {}
        self.fit_size = 0
        self.ids_of = _Known(self)

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: neighbours with the best joint score first, then leftmost."""
        n = len(text)
        score = self.score
        ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[text[i:i + 2]], i, i + 2) for i in range(n - 1) if text[i:i + 2] in score]
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
                whole = text[i:ends[end]]
                if whole in score:
                    heappush(heap, (-score[whole], i, ends[end]))
            h = before[i]
            if h >= 0:
                whole = text[h:end]
                if whole in score:
                    heappush(heap, (-score[whole], h, end))
        out, i = [], 0
        while i < n:
            out.append(text[i:ends[i]])
            i = ends[i]
        return out

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the joint text of two pieces gives these two again. ``left`` is empty at the start."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def fitting(self, left: str, option: str) -> str:
        """``option``, or the longest piece it starts with, that is compatible with the piece before; empty if none is."""
        row = self.fit.get(left)
        out = row.get(option) if row else None
        if out is not None:
            return out
        out = option
        while out and not self.compatible(left, out):
            out = self.shorter.get(out, "")
        if self.fit_size < CACHE_PAIRS:
            self.fit.setdefault(left, {})[option] = out
            self.fit_size += 1
        return out

    def split(self, text: str) -> list[str]:
        """Pieces of a text: the only row of pieces whose neighbours are all compatible.

        Goes forward by the longest piece that starts here and fits the piece before. Where none does, the piece
        before is taken back for a shorter one, and the place is marked in a bitfield: no row of compatible
        pieces that ends there leads on, so it is not entered again.
        """
        n = len(text)
        # The longest piece that starts at each place; shorter ones follow from it.
        longest = {last - len(piece) + 1: piece for last, piece in self.matcher.iter(text)}
        fit, nothing = self.fit, {}
        failed, marked = bytearray(n // 8 + 1), False
        out: list[str] = []
        at, left = 0, ""
        while at < n:
            first = longest.get(at) or text[at]
            option = fit.get(left, nothing).get(first)
            if option is None:
                option = self.fitting(left, first)
            while True:
                while marked and option and failed[(at + len(option)) >> 3] >> ((at + len(option)) & 7) & 1:
                    option = self.fitting(left, self.shorter.get(option, ""))
                if option:
                    break
                failed[at >> 3] |= 1 << (at & 7)
                marked = True
                last = out.pop()
                at -= len(last)
                left = out[-1] if out else ""
                option = self.fitting(left, self.shorter.get(last, ""))
            out.append(option)
            at += len(option)
            left = option
        return out

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return list(chain.from_iterable(map(self.ids_of.__getitem__, self.stretch.findall(marked))))

    def decode(self, ids: list[int]) -> bytes:
        """The text, in UTF-8, without the one space that the first piece starts with."""
        out = b"".join(map(self.bytes.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out


class _Known(dict):
    """Ids of each stretch, filled as stretches are asked for."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        out, model = [], self.model
        for piece in model.split(stretch):
            number = model.id.get(piece)
            out += [number] if number is not None else [model.byte[b] for b in piece.encode()]
        out = tuple(out)
        if len(self) < CACHE_STRETCHES:
            self[stretch] = out
        return out


@lru_cache(maxsize=2)
def piece_model(raw: bytes) -> PieceModel:
    """One model per file and worker process."""
    return PieceModel(raw)


def lists(flat: list[list[int]]) -> pa.ListArray:
    """Lists of ids as an Arrow array."""
    sizes = np.cumsum([0, *map(len, flat)])
    return pa.ListArray.from_arrays(
        pa.array(sizes.astype(np.int32)), pa.array(np.fromiter(chain.from_iterable(flat), np.int32, int(sizes[-1]))))


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ids and decoded text in place of the text; other columns of these two names are replaced.

    Null and empty texts have no ids and decode to the empty text; control strings are ordinary text. U+2581
    decodes to a space, as in the library. The model file has a fixed size and is sent to the workers; rows stay
    where they are, so a repeated row costs its own encoding only. A text is cut where no piece of the model spans, and a worker
    remembers a bounded number of stretches.
    """
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop(*({ids, decoded} - {text}))
    kept = [f for f in docs.schema.fields if f.name != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(shared.value)
        for batch, texts in chunks(batches, text, _CHUNK_BYTES):
            found = [model.encode(t) for t in texts]
            columns = [batch.column(batch.schema.get_field_index(f.name)) for f in kept]
            back = pa.array([model.decode(x).decode("utf-8", "replace") for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, lists(found), back], names=[*(f.name for f in kept), ids, decoded])

    return docs.mapInArrow(run, T.StructType([
        *kept, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())]))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to, as digests. Repeated rows give equal rows; an empty table none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, public_tokenizers.path(MODEL)).select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
