"""Token counts against the tokenizers library."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from meshframe.llm import tokens

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "a", "A b  C", "it's I'LL we've don't 'S", "éÉ é ﬁ Straße İI ΣΑΣ ς", "12345 ٣٤ ²½ Ⅷ", "日本語テキスト 한국어",
    "<|endoftext|>", "x<|startoftext|>y<|endoftext|> z <|ENDOFTEXT|>", "a\x1cb\x1fc\x85d e f​g", "😀😀👩‍👩‍👧 _-_ #$%", "﻿bom",
    "a" * 3000, "thisisaverylongword" * 400, "\n\n\t x", "the cat sat on the mat " * 200, "\x00\x01",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def noise(n: int) -> list[str]:
    rng = random.Random(2)
    alphabet = "abc THE ing'stve 12é😀\n\tß#-<|endoftext|>ωΣ日"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(n)]


def test_counts_on_edge_texts(spark, library):
    texts = TEXTS + noise(800)
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    rows = tokens.count_tokens(df, public_tokenizers.path(tokens.TOKENIZER)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["n_tokens"] == len(library.encode(t or "", add_special_tokens=False).ids), repr(t)


def test_counts_of_given_documents(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = tokens.op3_token_count(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = len(library.encode(docs[r["doc_id"]] or "", add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((docs[r["doc_id"]] or "").encode()), want, want > 2048)


def test_no_rows(spark):
    assert tokens.count_tokens(spark.createDataFrame([], "text string"), public_tokenizers.path(tokens.TOKENIZER)).count() == 0
