"""A corpus pipeline: each stage's rows are written as Parquet and read again as the documents of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tripleloom.llm import decontaminate, mixing, simhash, toxicity, wavelet
from tripleloom.llm.common import cut, read


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that a model, trained on the labelled documents of the corpus, finds toxic.

    Rows with null, empty or blank texts and rows without doc_id are judged by what text they have and stay if there is none; without labels of both classes all stay. Equal rows fare alike; very long texts are
    read whole; extra columns pass, whatever their names; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, toxicity.fit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, that of least doc_id.

    Rows are told apart by a number of their own: of repeated rows one stays, of different texts that share a doc_id both; rows without doc_id are compared like others; texts without words, null or empty, all
    stay. Very long texts are read whole; extra columns pass, whatever their names; an empty table stays empty.
    """
    return simhash.drop_copies(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents that are mostly benchmark go.

    Each row is judged by itself, also repeated rows and rows without doc_id; null and empty texts, and all texts where the benchmark is empty, stay as they are. Very long texts are scanned whole; extra columns
    pass, whatever their names; an empty table stays empty.
    """
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A balanced sample with the target shares of the sources, by documents and tokens.

    Each row is sampled by itself, also repeated rows, rows that share a doc_id and rows without one; null sources are a source; texts without tokens count by number only, and a source that has no tokens at
    all isn't sampled. Very long texts count all their tokens; extra columns pass, whatever their names; an empty table stays empty.
    """
    return mixing.keep_sampled(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Succinct shards of token ids, of every row, repeated ones too; null and empty texts are documents of no tokens, null doc_ids stay null. Long texts are packed whole, other columns left out; an empty table gives no shard."""
    return wavelet.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", remove_benchmark),
    ("mixing", mix_sources),
    ("token_shards", token_shards),
]

#: SQL can express neither the trained kernel machine nor the tokenizer; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
