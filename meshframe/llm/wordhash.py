"""Words of texts as 64-bit numbers, in numpy; used where rows are handled in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than the six ASCII white-space ones, as bytes.split() cuts them."""
    return text.split() if text else []


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(hashes: np.ndarray, width: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of the ``width`` elements from each position on; none if there are fewer.

    Built by doubling: the hash of 2k elements is that of the first k times base ** k plus that of the
    next k, so a width costs its logarithm in passes.
    """
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    # Pieces of power-of-two sizes, joined from the left.
    out, done = None, 0
    piece, size = hashes, 1
    power = base
    with np.errstate(over="ignore"):
        while done < width:
            if width & size:
                part = piece[done:done + n]
                out = part.copy() if out is None else out * power + part
                done += size
            if done < width:
                piece = piece[:len(piece) - size] * power + piece[size:]
                size, power = size * 2, power * power
        return mix(out + np.uint64(width) * _ODD)


def chunks(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """The rows in slices of some ``most_bytes`` of text (one row at least), so that arrays stay small."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        start, size = 0, 0
        for i, t in enumerate(texts):
            if size > most_bytes:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t or b"")
        if start < len(texts):
            yield batch.slice(start), texts[start:]
