"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from netloom.plans.loop import drop_tables as drop_tables
from netloom.plans.loop import materialized
from netloom.plans.loop import shared_path as shared_path  # the operators take these from here
from netloom.plans.ship import ship as ship


def written(df: DataFrame, kind: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    return materialized(df, kind)


def mounted(path: str) -> str:
    """The file-system path of a shared path, for files that workers memory-map."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped files need a mounted shared folder (file: path), not {url.scheme}:")
    return url.path


def put_file(path: str, data: bytes | memoryview) -> None:
    """Write one whole file so that a repeated or lost task attempt can't leave a part of it."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, path)


class WordCodes(dict):
    """word -> code in order of first sight; words holds the same words by code.

    The number of words kept is bounded: reset() when over() says so, between slices.
    """

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.words: list = []
        self.most = most

    def __missing__(self, word):
        code = self[word] = len(self.words)
        self.words.append(word)
        return code

    def over(self) -> bool:
        return len(self.words) > self.most

    def reset(self) -> None:
        self.clear()
        self.words.clear()


def text_column(column: pa.Array) -> pa.Array:
    """A string column with null as empty."""
    return pc.fill_null(column.cast(pa.string()), "")


def text_slices(column: pa.Array, most: int = 5_000_000) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts of about `most` bytes in all, so that a batch of long texts needs bounded memory."""
    if len(column):
        at = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(at // most)) + 1, [len(column)]]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def coded_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, number of words of each text, words by code). Words lie between ASCII white space; some are empty."""
    lists = pc.ascii_split_whitespace(column)
    found = lists.flatten().dictionary_encode()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return found.indices.to_numpy(zero_copy_only=False), counts, found.dictionary


def joined(words: pa.Array) -> str:
    """The words with line ends between; no word has one."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py() if len(words) else ""


def coded(found: list) -> tuple[np.ndarray, list]:
    """(code of each item, items by code)."""
    d = pa.array(found, pa.string()).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary.to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that walk each run (start, start + length) in turn."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def run_sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sum of each run of values; runs may be empty."""
    total = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(31))
        x = x * np.uint64(0x9E3779B97F4A7C15)
        x = x ^ (x >> np.uint64(29))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(32))


def word_hashes(words: list) -> np.ndarray:
    """A 64-bit hash of each word (bytes or str), the same in every process."""
    import xxhash

    one = xxhash.xxh3_64_intdigest
    return np.fromiter((one(w) for w in words), np.uint64, len(words))


def column(name: str) -> Column:
    """The column of just this name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def kept_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose id and text's SHA-256 are in kept (_kept_id, _kept_sha as hex), one of each, all columns as they are.

    A row travels as one struct, so no column of docs can clash with the key. A null id is an id of its own. An empty table stays empty.
    """
    key = lambda i, sha: F.concat_ws(":", F.coalesce(F.concat(F.lit("="), i.cast("string")), F.lit("-")), sha)
    sha = F.sha2(F.coalesce(column(text_col).cast("string"), F.lit("")), 256)
    own = docs.select(key(column(id_col), sha).alias("key"), F.struct(*map(column, docs.columns)).alias("row"))
    wanted = kept.select(key(F.col("_kept_id"), F.col("_kept_sha")).alias("key"))
    one = Window.partitionBy("key").orderBy("key")
    rows = own.join(wanted, "key", "left_semi").withColumn("n", F.row_number().over(one)).filter("n = 1")
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """mapInArrow for tables with columns of any names: they go in and come out by place."""
    fields = StructType([StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)])
    places = fields.fieldNames()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(out.columns, places)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(placed, fields).toDF(*schema.fieldNames())


def parts_for(df: DataFrame, part_bytes: int = 32 << 20) -> int:
    """Partitions for a shuffle of df: the session's number, more if the plan's size in bytes (known without reading) asks for it."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else max(least, -(-size // part_bytes))  # an unknown size is given as a huge one
