"""Byte-level BPE against the tiktoken library, and the round trip."""

import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from meshframe.llm import bpe

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.RANKS)
TEXTS = [
    None, "", " ", "  ", "a", " a  b\n\n c ", "it's I'll we've don't 'S ''t", "éÉ Straße ΣΑΣ", "12345 ٣٤ ²½ Ⅷ", "日本語 한국어", "😀😀 𝒜𝒷 𠀀",
    "<|endoftext|> x", "a\x1cb\x1fc\x85d\xa0e　f​g", "x" * 3000, "thisisaverylongword" * 300, "the cat " * 300, "\x00\x01﻿", "\r\n \t",
]


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(n: int) -> list[str]:
    rng = random.Random(4)
    alphabet = "abc THE ing'stve 12é😀\n\tß#-ωΣ日  "
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_words_and_ids(library):
    with open(PATH, "rb") as f:
        ranks = bpe.rank_table(f.read())
    split = bpe.splitter(public_tokenizers.PATTERN)
    for t in [x for x in TEXTS if x] + noise(3000):
        found = split(t)
        assert "".join(found) == t
        assert [i for w in found for i in bpe.encode_word(w.encode(), ranks)] == library.encode_ordinary(t), repr(t)


def test_packing():
    import numpy as np

    codes = np.array([0, 1, 127, 128, 16383, 16384, (1 << 18) + 5, (1 << 32) - 1, 0])
    assert bpe._unpack(bpe._pack(codes)).tolist() == codes.tolist()
    assert bpe._unpack(bpe._pack(codes[:0])).tolist() == []


def expected(library, pairs):
    return sorted((repr(k), library.encode_ordinary(t or ""), (t or "").encode()) for k, t in pairs)


def got(rows):
    return sorted((repr(r["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rows.collect())


@pytest.mark.parametrize("sizes", [(bpe.SLICE_BYTES, bpe.SLICE_WORDS, bpe.KNOWN_WORDS), (200, 1 << 19, 1 << 20), (1 << 24, 5, 3)])
@pytest.mark.parametrize("buckets", [None, 1, 1000])
def test_edge_texts(spark, library, sizes, buckets, monkeypatch):
    """Also with small slices, few or many buckets and next to no memory of words."""
    for name, value in zip(("SLICE_BYTES", "SLICE_WORDS", "KNOWN_WORDS"), sizes):
        monkeypatch.setattr(bpe, name, value)
    monkeypatch.setattr(bpe, "_CHUNK_BYTES", min(sizes[0], 500))
    texts = TEXTS + noise(100) + ["twice twice"] * 3
    pairs = [(i % 60 if i % 7 else None, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(*p, "clash") for p in pairs], "doc_id long, text string, ids string")
    assert got(bpe.encode_decode(df, PATH, buckets=buckets)) == expected(library, pairs)


def test_equal_rows_with_many_rare_words(spark, library):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(300))
    df = spark.createDataFrame([(None, text)] * 1000, "doc_id long, text string")
    rows = bpe.encode_decode(df, PATH).groupBy("doc_id", "ids", "decoded").count().collect()
    assert [(r["doc_id"], r["ids"], r["count"]) for r in rows] == [(None, library.encode_ordinary(text), 1000)]


def test_a_megabyte_and_struct_keys(spark, library):
    rng = random.Random(7)
    pairs = [(1, "word ing " * 200_000), (2, "".join(rng.choice("abc é1\n") for _ in range(1_000_000))), (3, None)]
    df = spark.createDataFrame(pairs, "doc_id long, text string").selectExpr("struct(doc_id, 'x' as note) as key", "text")
    rows = bpe.encode_decode(df, PATH, key="key").collect()
    assert sorted((repr(r["key"]["doc_id"]), r["ids"], bytes(r["decoded"])) for r in rows) == expected(library, pairs)


def test_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = bpe.op5_byte_bpe(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]
        ids = library.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_no_rows(spark):
    assert bpe.encode_decode(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
