"""Benchmark decontamination by Wu-Manber search over words.

The test strings are windows of consecutive words of the benchmark's items. Words are numbers; a block is
up to three of them. A table says, for the block that ends at a position, how far no window can end;
only where it says 0 does the block's bucket give windows that end so, and these are compared word by word. Texts
are searched many positions at a time, each lane skipping on its own.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import coded, coded_words, joined, map_batches, mounted, put_file, ragged, run_sums, shared_path, text_column, text_slices

#: Fixed value: what a word is, after A-Z are lower-cased.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+|\n")
#: Bytes of item text that are compiled and held at once; a larger benchmark is searched block by block.
BLOCK_BYTES = 16_000_000
#: Words that a lane of the search walks over.
LANE = 1024
TABLE_BITS = 20


def words_of(text: str | None) -> list[str]:
    return [w for w in WORD.findall(pc.ascii_lower(pa.array([text or ""]))[0].as_py()) if w != "\n"]


class Patterns:
    """Windows of one length: shift table, buckets by last block, and the items of each window."""

    def __init__(self, windows: np.ndarray, items: list[list[int]]):
        n, self.length = windows.shape
        self.block = min(3, self.length)
        self.windows = windows
        self.item_at = np.concatenate([[0], np.cumsum([len(x) for x in items])])
        self.items = np.array([i for x in items for i in x], np.int64)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.int8)
        for end in range(self.block - 1, self.length):
            h = self.hash([windows[:, end - self.block + 1 + k] for k in range(self.block)])
            np.minimum.at(self.shift, h, np.int8(self.length - 1 - end))
        h = self.hash([windows[:, self.length - self.block + k] for k in range(self.block)])
        self.order = np.argsort(h, kind="stable")
        self.bucket, first = np.unique(h, return_index=True) if n == 0 else np.unique(h[self.order], return_index=True)
        self.bucket_at = np.concatenate([first, [n]])

    def hash(self, words: list[np.ndarray]) -> np.ndarray:
        h = np.zeros(len(words[0]), np.uint64)
        with np.errstate(over="ignore"):
            for w in words:
                h = (h ^ w.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end position, window) of every occurrence."""
        size, b = len(text), self.block
        if size < self.length or not len(self.windows):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(self.length - 1, size, LANE, dtype=np.int64)
        stop = np.minimum(at + LANE, size)
        ends = []
        while len(at):
            h = self.hash([text[at - b + 1 + k] for k in range(b)])
            shift = self.shift[h].astype(np.int64)
            zero = shift == 0
            if zero.any():
                ends.append(np.stack([at[zero], h[zero]]))
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if ends:
            end, h = np.concatenate(ends, 1)
            k = np.minimum(np.searchsorted(self.bucket, h), len(self.bucket) - 1)
            end, k = end[self.bucket[k] == h], k[self.bucket[k] == h]
            many = self.bucket_at[k + 1] - self.bucket_at[k]
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(many) // 1_000_000)) + 1, [len(end)]]))
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                who = self.order[ragged(self.bucket_at[k[a:z]], many[a:z])]
                e = np.repeat(end[a:z], many[a:z])
                for j in range(self.length):  # direct comparison, a word at a time
                    same = text[e - self.length + 1 + j] == self.windows[who, j]
                    e, who = e[same], who[same]
                found.append((e, who))
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def compile_items(items: list[tuple[str, str | None]], width: int = 10) -> bytes:
    """One block of (item id, text), ready to search: pickled (vocabulary, patterns of each length, item ids)."""
    vocabulary: dict[str, int] = {}
    names = sorted({i for i, _ in items})
    number = {n: k for k, n in enumerate(names)}
    windows: dict[int, dict[tuple, set]] = {}
    for i, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        length = min(width, len(ids))
        for k in range(len(ids) - length + 1 if ids else 0):
            windows.setdefault(length, {}).setdefault(tuple(ids[k : k + length]), set()).add(number[i])
    patterns = [Patterns(np.array(list(w), np.int64).reshape(len(w), n), [sorted(x) for x in w.values()]) for n, w in sorted(windows.items())]
    return pickle.dumps((vocabulary, patterns, names), protocol=5)


def compile_benchmark(benchmark: DataFrame, width: int = 10, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files in the shared folder, one for each block of items. Items without an id are left out; null text has no words."""
    rows = benchmark.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    folder = mounted(shared_path(benchmark.sparkSession, "benchmark"))
    paths = []
    for b in range(blocks):
        part = [tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b).collect()]  # about block_bytes
        paths.append(f"{folder}/{b}.pickle")
        put_file(paths[-1], compile_items(part, width))
    return paths


class Scanner:
    """Compiled blocks -> what is hit in texts. A single block is kept in memory, several are read in turn."""

    def __init__(self, paths: list[str]):
        self.paths = paths
        self.one = self.load(paths[0]) if len(paths) == 1 else None

    @staticmethod
    def load(path: str):
        with open(path, "rb") as f:
            return pickle.load(f)

    def scan(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
        """(words, hit words, sorted ids of items) of each text."""
        codes, counts, distinct = coded_words(pc.ascii_lower(column))
        pieces = WORD.findall(joined(distinct)) + ["\n"] if len(distinct) else []
        at, found = coded(pieces)
        line = found.index("\n") if found else -1
        ends = np.flatnonzero(at == line)
        runs = np.diff(ends, prepend=-1) - 1
        starts, lens = (ends - runs)[codes], runs[codes]
        where = ragged(starts, lens)
        n_words = run_sums(lens, counts)
        # Texts one after another with a gap after each, so that no window reaches from one into the next.
        own = np.repeat(np.arange(len(counts)), n_words)
        put = np.arange(len(where)) + own
        hit = np.zeros(len(where) + len(counts) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(len(counts))]
        doc_ends = np.cumsum(n_words + 1)
        for path in self.paths:
            vocabulary, patterns, names = self.one or self.load(path)
            numbers = np.fromiter((vocabulary.get(w, 0) for w in found), np.int64, len(found))
            text = np.zeros(len(where) + len(counts), np.int64)
            text[put] = numbers[at[where]]
            for p in patterns:
                end, who = p.search(text)
                if not len(end):
                    continue
                np.add.at(hit, end - p.length + 1, 1)
                np.add.at(hit, end + 1, -1)
                doc = np.searchsorted(doc_ends, end, "right")
                many = p.item_at[who + 1] - p.item_at[who]
                pairs = np.unique(np.repeat(doc, many) * len(names) + p.items[ragged(p.item_at[who], many)])
                for d, i in zip((pairs // len(names)).tolist(), (pairs % len(names)).tolist(), strict=True):
                    items[d].add(names[i])
        covered = np.concatenate([(np.cumsum(hit[:-1]) > 0).astype(np.int64)])
        return n_words, run_sums(covered, n_words + 1), [sorted(x) for x in items]


def flag_contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", block_bytes: int = BLOCK_BYTES, only_clean: bool = False) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and contaminated; older columns of these names are replaced.

    A document's word is hit if it lies in an occurrence of a window of `width` consecutive item words, or of a
    whole item that has fewer. Null and empty texts have no words and are clean; so are all if the benchmark is
    empty. Repeated rows get the same result. only_clean: return the clean rows alone, with the columns of docs.
    """
    paths = compile_benchmark(benchmark, width, block_bytes=block_bytes)
    new = ["n_words", "n_hit", "items", "contaminated"]
    base = docs if only_clean else docs.drop(*new)
    at = base.columns.index(text_col)
    schema = base.schema if only_clean else StructType([*base.schema.fields, *StructType.fromDDL("n_words long, n_hit long, items array<string>, contaminated boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(paths)
        for batch in batches:
            texts = text_column(batch.column(at))
            for a, b in text_slices(texts):
                n_words, n_hit, items = scanner.scan(texts.slice(a, b - a))
                part = batch.slice(a, b - a)
                if only_clean:
                    yield part.filter(pa.array(n_hit == 0))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n_words), pa.array(n_hit), pa.array(items, pa.list_(pa.string())), pa.array(n_hit > 0)], [*part.schema.names, *new])

    return map_batches(base, run, schema)
