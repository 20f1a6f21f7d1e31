"""A training corpus from documents: STAGES in order, each on all that the one before kept.

In every stage null text counts as empty, equal rows are treated alike, texts of any length are read whole, an empty table
stays empty, and columns of any name pass through the first four stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.queries import word_bpe
from netloom.plans.loop import temporary_state


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the factorization machine doesn't reject. An empty text is scored by the labels' odds; a null id is never learned from."""
    from netloom.llm.toxicity import fold, score, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), where=fold(F.col("doc_id")) != 0)
    return score(docs, model, only_clean=True)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, that of the largest id; a null id is the smallest. Of rows equal in id and text one stays, null and empty texts are equal."""
    from netloom.llm.chunk_dedup import drop_exact

    return drop_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id; a null id comes last. Texts without words are one group."""
    from netloom.llm.order_minhash import drop_near

    return drop_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any window of a benchmark item. Texts without words are clean; so are all if the benchmark is empty."""
    from netloom.llm.decontaminate import flag_contaminated

    return flag_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), only_clean=True)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids: the last stage's output, in which texts are their ids and other columns are left behind. An empty text has no ids."""
    from netloom.llm.bpe import build_lexicon, round_trip_digests

    return round_trip_digests(docs, word_bpe(), build_lexicon(docs, word_bpe()), with_ids=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", bpe)]

#: A trained classifier and edit distances have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows written to the shared folder and read again; what a stage wrote besides goes when it has ended."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with temporary_state(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
