"""Stages of the corpus pipeline against plain Python, each on its own input."""

import brute
import corpus_pipeline
import pytest

from meshframe.llm import minhash
from meshframe.llm.common import pin

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        result = pin(stage(spark, docs, SF))
        out.append((name, docs, result))
        docs = result
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns(stages):
    assert [n for n, *_ in stages] == ["quality_rules", "near_dedup", "personal_data", "mix_sources", "byte_bpe"]
    assert all(after.dtypes == before.dtypes for _, before, after in stages[:-1])


def test_quality_drops_what_fails_and_keeps_texts(stages):
    before, after = rows(stages[0][1]), rows(stages[0][2])
    assert all(after[i] == before[i] for i in after)
    failed = {i for i, r in before.items() if brute.quality(r["text"])["base_failed"]}
    assert failed and not failed & set(after)
    # 200 documents certify no cutoff, so nothing else goes.
    assert set(after) == set(before) - failed


def test_one_of_each_group_stays(stages):
    _, docs, kept = stages[1]
    classes = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"] for r in kept.collect()} == {r["class_id"] for r in classes}


def test_personal_data_is_gone(stages):
    before, after = rows(stages[2][1]), rows(stages[2][2])
    assert set(before) == set(after)
    for i, r in before.items():
        found = brute.pii(r["text"])["listed"]
        assert bool(found) <= (after[i]["text"] != r["text"])
        assert not brute.pii(after[i]["text"])["listed"]
        assert after[i]["n_chars"] == (len(after[i]["text"]) if after[i]["text"] != r["text"] else r["n_chars"])


def test_mix_takes_whole_documents(stages):
    before, after = rows(stages[3][1]), stages[3][2].collect()
    assert all(r == before[r["doc_id"]] for r in after)
    sizes: dict = {}
    for r in before.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORDS.findall(r["text"] or ""))
    want = brute.targets(sizes)
    for s in sizes:
        taken = sum(len(brute.WORDS.findall(r["text"] or "")) for r in after if r["source"] == s)
        largest = max(len(brute.WORDS.findall(r["text"] or "")) for r in before.values() if r["source"] == s)
        assert abs(taken - want[s]) <= largest / 2


def test_encoding_keeps_every_row(stages):
    import hashlib

    texts = {r["doc_id"]: r["text"] for r in stages[4][1].collect()}
    got = stages[4][2].collect()
    assert len(got) == stages[4][1].count()
    for r in got:
        assert r["n_tokens"] == len(r["token_ids"])
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()


def test_nulls_empties_and_no_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words string"
    edge = spark.createDataFrame([
        (None, None, None, None, None, "x", "y"), (1, "", "en", "s", 0, "x", "y"), (2, "word " * 3, None, "s", 15, "x", "y"),
        (3, " ".join(f"w{i}" for i in range(60)) + " mail a@b.co", None, None, 9, "x", "y"),
        (3, " ".join(f"w{i}" for i in range(60)) + " mail a@b.co", None, None, 9, "x", "y")], schema)
    for docs in (edge, edge.limit(0)):
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            result = pin(stage(spark, docs, SF))
            docs = result if i else docs
            if i < 4:
                assert result.columns == edge.columns, name
