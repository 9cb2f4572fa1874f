"""Corpus pipeline: quality rules, near-duplicates, personal data, mixing of sources, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from meshframe.llm import bpe, minhash, mixing, pii, quality
from meshframe.llm.common import pin, table, words


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a certified cutoff of their language rejects.

    Cutoffs come from the labelled ones among these documents. Null and empty texts fail the base rules. A null doc_id has no label
    and is judged like others; repeated rows are judged alike; without labels only the base rules reject; no documents give none.
    Columns of any names pass through, as the row travels in a struct.
    """
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    known = docs.select("doc_id", "lang", "text").join(labels.select("doc_id").distinct(), "doc_id", "left_semi")
    features = pin(quality.text_features(known).drop("text"))
    cutoffs = pin(quality.select_cutoffs(quality.labelled(features, labels), "lang", "quality"))
    rows = quality.text_features(docs.select(F.struct("*").alias("row"), "lang", "text"))
    return quality.judge(rows, cutoffs, "lang").where("kept").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, the one with the smallest id.

    Null and empty texts are no duplicates of others with another id; of rows equal in id and text one stays; no documents give none.
    Columns of any names pass through.
    """
    return minhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a tag in place of each span of personal data and n_chars as the text then has.

    A null text stays null and an empty one empty; texts without a span keep text and n_chars. Repeated rows stay and are treated
    alike; other columns pass through; no documents give none.
    """
    model = pin(pii.train(pin(pii.candidates(docs.select("text")).select("cands"))))
    found = pii.decide(pii.candidates(docs.select(F.struct("*").alias("row"), "text")), model)
    out = found.withColumn("redacted", pii.redact(F.col("text"), F.col("spans")))
    return out.select(*[
        {"text": F.col("redacted"), "n_chars": F.when(F.size("spans") > 0, F.length("redacted")).otherwise(F.col("row.n_chars"))}
        .get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns
    ])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: a row for each time.

    A null source is a source of its own; texts without words count 0 and are taken as their whole source is. Rows equal in id and text are
    taken alike; ties cannot arise, as the order is a digest's. Columns of any names pass through; no documents give none.
    """
    rows = docs.select(F.struct("*").alias("row"), "source", F.size(words("text")).alias("n"),
                       mixing.document_key("doc_id", "text").alias("key"))
    mixed = mixing.mix(rows, F.col("source"), F.col("n"), F.col("key"))
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, with the digests of ids and of the bytes they decode to.

    Null and empty texts have no ids. Keys may be null or repeat, and repeated rows give as many rows; no documents give none.
    """
    keyed = docs.select(F.struct("doc_id", "source", "lang").alias("key"), "text")
    encoded = bpe.encode_decode(keyed, public_tokenizers.path(bpe.RANKS), key="key")
    return bpe.digests(encoded.withColumn("token_ids", F.col("ids"))).select(
        "key.doc_id", "key.source", "key.lang", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("byte_bpe", byte_bpe),
]

# Probability MinHash, expectation-maximisation and BPE have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that the last stage makes of documents."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
