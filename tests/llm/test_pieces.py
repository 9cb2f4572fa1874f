"""Backtracking encoder against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from meshframe.llm import pieces

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(pieces.MODEL)
TEXTS = [
    None, "", " ", "  ", "a", "<s>", "</s> <unk>", "<0x41>", "▁", "▁▁▁ ▁", " " * 100, "the" + " " * 37 + "cat", "    the", "a" * 5000,
    "\x00\x01", "日本語テキスト", "é́", "😀😀👩‍👩‍👧", "line\nline\r\n\tx", "thisisaverylongword" * 300, "a,b.c;d." * 50,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, "rb") as f:
        return pieces.PieceModel(f.read())


def noise(n: int, alphabet: str, seed: int) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 100))) for _ in range(n)]


def test_ids_and_text_as_the_library(model, library):
    texts = TEXTS + noise(2000, "abc the   ing▁ é😀\n\tß#<s>ωΣ日tion0x41", 1) + noise(1000, "▁ ab", 2)
    for t in texts:
        want = library.encode(t or "")
        assert model.encode(t) == want, repr(t)
        assert model.decode(want).decode() == library.decode(want), repr(t)


def test_one_stretch_of_a_megabyte(model, library):
    text = "".join(random.Random(3).choice("abcdeinrst") for _ in range(1_000_000))
    assert model.encode(text) == library.encode(text)


def test_a_whole_text_without_cuts(model, library):
    """The backtracking alone, across spaces: cutting texts first only saves time."""
    for t in noise(300, "the and of  in ing.", 4):
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        assert [model.id[p] for p in model.split(marked)] == library.encode(t)


def test_neighbours_are_compatible_and_others_are_taken_back(model):
    for t in noise(500, "etaoinshrdlu", 5):
        row = model.split(t)
        assert row == model.merged(t)
        assert all(model.compatible(a, b) for a, b in zip(["", *row], row))


def test_other_models_are_refused():
    with open(PATH, "rb") as f:
        raw = f.read()
    # Field 35 of the trainer (byte fallback) off.
    with pytest.raises(ValueError):
        pieces.PieceModel(raw.replace(b"\x98\x02\x01", b"\x98\x02\x00"))


def test_rows_with_clashing_columns_nulls_and_repeats(spark, library):
    rows = [(i % 5, t, "x", 1) for i, t in enumerate(TEXTS + TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    out = pieces.encode_decode(df, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out.collect())
    want = sorted((d, tuple(library.encode(t or "")), library.decode(library.encode(t or ""))) for d, t, _, _ in rows)
    assert got == want
    named = pieces.encode_decode(df.select("doc_id", df.text.alias("ids")), PATH, text="ids")
    assert sorted(tuple(r["ids"]) for r in named.collect()) == sorted(w[1] for w in want)


def test_query_on_given_documents(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = pieces.op12_sentencepiece(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_no_rows(spark):
    assert pieces.encode_decode(spark.createDataFrame([], "text string, doc_id long"), PATH).collect() == []
