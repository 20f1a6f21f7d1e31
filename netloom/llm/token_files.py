"""Token ids as Parquet lists, in ascending id order, for selective reads.

One file for each range of ids: metadata columns are delta-encoded, the list of ids is
dictionary-encoded, row groups and pages are small enough that the page index leads a reader to the
rows of a few ids, and a reader of metadata alone touches no token page.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts_for, ship, text_column, text_slices
from .word_ids import library_ids

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> None:
    """Encode each text with the tokenizers library, append end_id, and write id_col, part, first, n_tokens, ids to path.

    Rows are in ascending id order within a part and from part to part; null ids come first, equal ids
    lie next to each other. first is the number of ids before the row in its part. Null text counts as
    empty. Other columns aren't written. An empty table gives files without rows.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, first = library_ids(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = text_column(batch.column(1))
            for a, b in text_slices(texts, 4_000_000):
                flat, n = enc.encode(texts.slice(a, b - a))
                if end_id is not None:
                    flat = np.insert(flat, np.cumsum(n), np.uint32(end_id))
                    n = n + 1
                ends = np.cumsum(n)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.view(np.int32)))
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(first + ends - n), pa.array(n), ids], ["i", "part", "first", "n_tokens", "ids"])
                first += int(ends[-1])

    # Rows of one id may be many: they are spread by size, which costs nothing to take, and put in order by hash where they have arrived.
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).withColumn("size", F.octet_length("t"))
    ordered = rows.repartitionByRange(files or parts_for(rows), "i", "size").sortWithinPartitions("i", "size", F.xxhash64("t")).select("i", "t")
    tokens = ordered.mapInArrow(run, f"i {kind}, part int, first long, n_tokens long, ids array<int>").withColumnRenamed("i", id_col)
    tokens.write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, where: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """The rows of a token table; where (on id_col or n_tokens) and columns reach the Parquet reader."""
    df = spark.read.parquet(path)
    if where is not None:
        df = df.filter(where)
    return df.select(*columns) if columns else df


def part_starts(tokens: DataFrame) -> DataFrame:
    """(part, part_start): ids in all parts before. Reads two metadata columns; there is a row for each part."""
    totals = tokens.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def token_digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 of each row, from the ids as read."""
    ship(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            at = lists.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["i", "part", "first", "n", "crc"])

    rows = tokens.select(id_col, "part", "first", "ids").mapInArrow(run, f"i {kind}, part int, first long, n long, crc long")
    return rows.join(F.broadcast(part_starts(tokens)), "part").select(F.col("i").alias(id_col), (F.col("part_start") + F.col("first")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
