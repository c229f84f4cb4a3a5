"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, embeddings, licenses, linededup, mixing, simhash, tokencounts, toxicity, wavelet


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_chat_masks": chat.query,
    "op3_embedding_near_dedup": embeddings.query,
    "op4_line_dedup": linededup.query,
    "op5_decontaminate": decontaminate.query,
    "op6_mix_sources": mixing.query,
    "op7_token_counts": tokencounts.query,
    "op8_simhash_dedup": simhash.query,
    "op9_license_scan": licenses.query,
    "op10_token_shards": wavelet.query,
    "pipeline": pipeline,
}

ORACLES = {
    "op3_embedding_near_dedup": embeddings.ORACLE,
    "op4_line_dedup": linededup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
}
