"""Token counts for every context limit, from one exact histogram of encoded lengths."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_column, written
from .word_ids import library_ids

#: Lengths to a block: sums run within blocks, and over one row for each block.
BLOCK = 256


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, n_docs) over all rows; null text has length 0; equal rows count each. An empty table has no rows.

    Each task counts its own lengths first, so that what moves is bounded by the number of distinct lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = library_ids(tokenizer), {}
        for batch in batches:
            lengths, n = np.unique(enc.encode(text_column(batch.column(0)))[1], return_counts=True)
            for x, k in zip(lengths.tolist(), n.tolist(), strict=True):
                seen[x] = seen.get(x, 0) + k
        yield pa.record_batch([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["length", "n"])

    counts = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "length long, n long")
    return written(counts.groupBy("length").agg(F.sum("n").alias("n_docs")), "lengths")


def with_limits(hist: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as a context limit.

    n_docs: documents of that length; docs_from, tokens_from: documents at least as long and their
    tokens (suffix sums); total_tokens: all; truncated_total: all tokens if longer documents are cut at
    this length; share: of documents at most as long.
    """
    hist = hist.withColumn("block", F.floor(F.col("length") / BLOCK)).withColumn("tokens", F.col("length") * F.col("n_docs"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    all_blocks = Window.partitionBy(F.lit(1))
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("bd"), F.sum("tokens").alias("bt"))
    blocks = blocks.select("block", F.coalesce(F.sum("bd").over(later), F.lit(0)).alias("docs_after"), F.coalesce(F.sum("bt").over(later), F.lit(0)).alias("tokens_after"), F.sum("bd").over(all_blocks).alias("total_docs"), F.sum("bt").over(all_blocks).alias("total_tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("length"))
    out = hist.join(blocks, "block").select(
        "length", "n_docs", "total_docs", "total_tokens", (F.sum("n_docs").over(own) + F.col("docs_after")).alias("docs_from"), (F.sum("tokens").over(own) + F.col("tokens_after")).alias("tokens_from")
    )
    return out.select(
        "length",
        "n_docs",
        "docs_from",
        "tokens_from",
        "total_tokens",
        (F.col("total_tokens") - F.col("tokens_from") + F.col("docs_from") * F.col("length")).alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_from") + F.col("n_docs")) / F.col("total_docs")).alias("share"),
    )


def truncated_totals(limits_df: DataFrame, limits: list[int]) -> DataFrame:
    """(context, total): tokens kept with documents cut at each asked limit, from with_limits() rows. A limit of an empty corpus gives 0."""
    asked = limits_df.sparkSession.createDataFrame([(int(x), 0) for x in dict.fromkeys(limits)], "length long, n_docs long")
    # An asked limit is one more length, of no documents: its suffix sums answer it.
    hist = limits_df.select("length", "n_docs").unionByName(asked).groupBy("length").agg(F.sum("n_docs").alias("n_docs"))
    return with_limits(hist).join(F.broadcast(asked.select("length")), "length", "left_semi").select(F.col("length").alias("context"), F.col("truncated_total").alias("total"))


def quantiles(limits_df: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least that share of documents doesn't exceed; none for an empty corpus."""
    asked = limits_df.sparkSession.createDataFrame([(float(x),) for x in shares], "asked double")
    return F.broadcast(asked).join(limits_df.select("length", "share"), F.col("share") >= F.col("asked")).groupBy("asked").agg(F.min("length").alias("length")).withColumnRenamed("asked", "share")
