"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's documents. All but the last return the columns of documents. A stage's result must be written before the next stage
is called: that call deletes the scratch tables of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.llm import cotraining, exact_dedup, mixing, ngram_join, sentencepiece_codec
from wavemill.llm.common import discard, frees_scratch, materialize, table


@frees_scratch
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier scores below one half go; without labels of both classes none goes.

    Null and empty texts are scored like others. Repeated rows and ties score alike, so they go or stay together. An empty
    table stays empty. Columns are unchanged, also one that is named like a score of the classifier.
    """
    model = cotraining.fit_quality(docs, table(spark, sf_dir, "labels"))
    plain = {c: f"c{k}" for k, c in enumerate(docs.columns)}
    scored = cotraining.score_quality(docs.toDF(*plain.values()), model, plain["text"], plain["lang"], plain["source"])
    return scored.where("score >= 0.5").select(*(F.col(k).alias(c) for c, k in plain.items()))


@frees_scratch
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) the smallest doc_id stays, one row of repeated ones.

    Null and empty texts are equal to each other. A row without an id stays unless a row with one has its text. Very long
    texts are compared in whole, an empty table stays empty, columns may have any name.
    """
    return exact_dedup.drop_copies(docs)


@frees_scratch
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) the smallest doc_id stays.

    Null, empty and blank texts are in no group and stay. A row without an id stays only in a group without ids. Very long
    texts are compared in whole, an empty table stays empty.
    """
    return ngram_join.keep_one_of_each(docs, words=5, share=80)


@frees_scratch
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated and drawn to their target weights; a cut copy's n_chars is its own.

    Rows without words are not taken. A null source is a source. Ties are settled by id, size and text. Very long texts are
    counted in whole, an empty table stays empty, columns may have any name.
    """
    out = mixing.mix(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


@frees_scratch
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every kept copy, an end id each, and the digest of what they decode to; a null text gives the end id alone, an empty table nothing."""
    return sentencepiece_codec.encode(docs, outputs=("n_tokens", "ids", "decoded_sha256")).select("doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing sources", mixed), ("SentencePiece encoding", tokens)]
ORACLE_SQL = None  # a trained classifier is no SQL; the tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
