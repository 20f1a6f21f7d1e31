"""Language-model scoring with an interpolated modified Kneser-Ney bigram model.

Counting runs in Spark over all training texts. A task adds up its own n-grams before anything moves
and sends each bucket of hashes one sorted array, so a frequent n-gram is one entry a task, not a row
an occurrence. Reducers merge the arrays and write them, sorted by 64-bit hash, to the shared folder, where the
scoring tasks memory-map them and look up all n-grams of a batch by binary search.

P(w | u) = max(c(uw) - D(c(uw)), 0) / c(u.) + g(u) P1(w)
P1(w)    = max(N1+(.w) - D1(N1+(.w)), 0) / N1+(..) + g1 / (V + 1)

with three discounts by count (1, 2, 3 or more) for either order, N1+(.w) the number of different words
before w, and the uniform end of the chain counting one unknown word. A text's first word follows a start mark;
its end is a token. Contexts never seen give P1(w).
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import coded_words, map_batches, mix, mounted, put_file, run_sums, shared_path, ship, text_column, text_slices, word_hashes, written

#: Hashes of the start mark and the end token, which no word has but by chance.
START, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC2B2AE3D27D4EB4F)
#: Bytes of text that give a bucket; buckets grow in number with the corpus, and in size only past MOST_BUCKETS (2 TB).
BUCKET_BYTES = 8_000_000
MOST_BUCKETS = 1 << 18
#: Files that a scoring task keeps mapped at once.
OPEN_FILES = 4000
#: A word that starts more than this share of all bigrams has its own bigrams spread over the buckets; there are at most 1 / HOT such words.
HOT = 1 / 512
FLUSH = 1_600_000
U64 = np.uint64


def tokens_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of each token, tokens of each text with the end, hash of each code). Code 0 is the end, which closes each text."""
    codes, counts, words = coded_words(pc.ascii_lower(column))
    hashes = np.concatenate([[END], word_hashes(words.to_pylist())])
    empty = pc.index(words, "").as_py()
    kept = codes != empty
    per = run_sums(kept.astype(np.int64), counts)
    own = codes[kept].astype(np.int64) + 1
    return np.insert(own, np.cumsum(per), 0), per + 1, hashes


def bigrams_of(codes: np.ndarray, counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hash of the word before each token; the start mark before a text's first."""
    h = hashes[codes]
    before = np.concatenate([[START], h[:-1]]).astype(U64)
    before[np.cumsum(counts) - counts] = START
    return before


def gram(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a bigram: the top 20 bits are those of the word before, scrambled, so that buckets follow it."""
    with np.errstate(over="ignore"):
        low = mix(before * U64(0x9E3779B97F4A7C15) + word) >> U64(20)
    return (mix(before) & U64(0xFFFFF00000000000)) | low


def spread_gram(before: np.ndarray, word: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """As gram(), but bigrams that start with a hot word are spread over all buckets."""
    g = gram(before, word)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, before), len(hot) - 1)
        own = hot[at] == before
        if own.any():
            g[own] = mix(g[own] ^ U64(0x94D049BB133111EB))
    return g


def merged(keys: np.ndarray, counts: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys with summed counts, and the other columns of one row of each key."""
    if not len(keys):
        return keys, counts, *more
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts[order], at), *(m[order][at] for m in more)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the hash: buckets one after another are sorted as a whole. buckets is a power of two."""
    return (keys >> U64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(keys), np.int64)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts as compactly as they allow: mostly one byte each, then exceptions."""
    big = np.flatnonzero(counts >= 255)
    return np.concatenate([np.array([len(counts), len(big)], np.uint32).view(np.uint8), np.minimum(counts, 255).astype(np.uint8), big.astype(np.uint32).view(np.uint8), counts[big].astype(np.uint64).view(np.uint8)])


def unsmall(data: np.ndarray) -> np.ndarray:
    n, m = data[:8].copy().view(np.uint32).tolist()
    out = data[8 : 8 + n].astype(np.int64)
    out[data[8 + n : 8 + n + 4 * m].copy().view(np.uint32)] = data[8 + n + 4 * m : 8 + n + 12 * m].copy().view(np.uint64).astype(np.int64)
    return out


def packed(keys: np.ndarray, counts: np.ndarray, befores: np.ndarray | None = None, words: np.ndarray | None = None) -> bytes:
    """One bucket of a task: counts, then keys; with bigrams their two words instead, the first as number in the list of first words."""
    c = small(counts)
    head = np.array([len(c)], np.uint64).view(np.uint8)
    if befores is None:
        return np.concatenate([head, c, keys.view(np.uint8)]).tobytes()
    firsts, at = np.unique(befores, return_inverse=True)
    order = np.argsort(at, kind="stable")
    c = small(counts[order])
    head = np.array([len(c), len(firsts)], np.uint64).view(np.uint8)
    many = small(np.bincount(at, minlength=len(firsts)))
    size = np.array([len(many)], np.uint64).view(np.uint8)
    return np.concatenate([head, size, c, firsts.view(np.uint8), many, np.ascontiguousarray(words[order]).view(np.uint8)]).tobytes()


def unpacked_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n = int(raw[:8].copy().view(np.uint64)[0])
    return raw[8 + n :].copy().view(np.uint64), unsmall(raw[8 : 8 + n])


def unpacked_grams(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    n, m, k = raw[:24].copy().view(np.uint64).astype(np.int64).tolist()
    counts = unsmall(raw[24 : 24 + n])
    at = 24 + n
    firsts = raw[at : at + 8 * m].copy().view(np.uint64)
    at += 8 * m
    many = unsmall(raw[at : at + k])
    return np.repeat(firsts, many), raw[at + k :].copy().view(np.uint64), counts


def word_arrays(docs: DataFrame, buckets: int, text_col: str) -> DataFrame:
    """(bucket, data): each task's counts of its words, sorted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if keys:
                yield from by_bucket(buckets, *merged(np.concatenate(keys), np.concatenate(counts)))

        for batch in batches:
            column = text_column(batch.column(0))
            for a, b in text_slices(column):
                codes, _, hashes = tokens_of(column.slice(a, b - a))
                keys.append(hashes)
                counts.append(np.bincount(codes, minlength=len(hashes)))
                held += len(hashes)
                if held > FLUSH:
                    k, c = merged(np.concatenate(keys), np.concatenate(counts))
                    keys, counts, held = [k], [c], len(k)
                    if held > FLUSH // 2:
                        yield from flush()
                        keys, counts, held = [], [], 0
        yield from flush()

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, data binary")


def by_bucket(buckets: int, keys: np.ndarray, counts: np.ndarray, *words: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row for each bucket that has keys. Words by code may have count 0 and are left out."""
    kept = counts > 0
    if not kept.all():
        keys, counts, words = keys[kept], counts[kept], tuple(w[kept] for w in words)
    b = bucket_of(keys, buckets)
    cuts = np.searchsorted(b, np.arange(buckets + 1))
    for k in range(buckets):
        x, y = cuts[k], cuts[k + 1]
        if x < y:
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([packed(keys[x:y], counts[x:y], *(w[x:y] for w in words))], pa.binary())], ["bucket", "data"])


def gram_arrays(docs: DataFrame, buckets: int, hot: np.ndarray, text_col: str) -> DataFrame:
    """(bucket, data): each task's bigrams with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for batch in batches:
            column = text_column(batch.column(0))
            for a, b in text_slices(column):
                codes, counts, hashes = tokens_of(column.slice(a, b - a))
                before, word = bigrams_of(codes, counts, hashes), hashes[codes]
                k = spread_gram(before, word, hot)
                held.append(merged(k, np.ones(len(k), np.int64), before, word))
                size += len(held[-1][0])
                if size > FLUSH:
                    yield from by_bucket(buckets, *merged(*map(np.concatenate, zip(*held, strict=True))))
                    held, size = [], 0
        if held:
            yield from by_bucket(buckets, *merged(*map(np.concatenate, zip(*held, strict=True))))

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "bucket int, data binary")


def gathered(arrays: DataFrame, buckets: int, reduce, schema: str) -> DataFrame:
    """reduce(bucket, list of data) -> record batch, for each bucket. A task takes whole buckets, one after another."""
    tasks = min(buckets, int(arrays.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = -1, []
        for batch in batches:
            for b, d in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if b != bucket and held:
                    yield reduce(bucket, held)
                    held = []
                bucket = b
                held.append(d.as_py())
        if held:
            yield reduce(bucket, held)

    # Dealt out by hash: ranges would be found by counting everything once more. A bucket that nobody sent has no file.
    return arrays.repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


@dataclass
class Model:
    """Where the arrays lie, and the few numbers that belong to all of them."""

    folder: str
    word_buckets: int
    gram_buckets: int
    tokens: int = 0
    words: int = 0
    discounts: list[float] = field(default_factory=list)  # of bigrams
    low_discounts: list[float] = field(default_factory=list)  # of continuation counts
    low_total: int = 0
    low_gamma: float = 1.0
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.zeros((0, 4), np.int64))


def discounts_of(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams that occur 1, 2, 3, 4 times; where a number is 0, a plain half or what can be had."""
    n1, n2, n3, n4 = n
    if not n1 or not n2:
        return [0.5, 0.5, 0.5]
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.5]
    return [min(max(x, 0.05), top) for x, top in zip(d, (0.95, 1.95, 2.95), strict=True)]


def times(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def stats_of(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum, and how many are 1, 2, 3 or more, of each run that starts at `at`."""
    return np.stack([np.add.reduceat(x, at) for x in (counts, (counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts >= 3).astype(np.int64))], 1)


def power_of_two(n: float) -> int:
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def train(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot_share: float = HOT) -> Model:
    """Count all texts of docs. Null counts as empty: its end is a token all the same. Without rows the model knows nothing and is uniform."""
    spark = docs.sparkSession
    folder = mounted(shared_path(spark, "kneser-ney"))
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    model = Model(folder, min(MOST_BUCKETS, power_of_two(size / bucket_bytes / 4)), min(MOST_BUCKETS, power_of_two(size / bucket_bytes)))
    os.makedirs(folder, exist_ok=True)

    def words(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        keys, counts = merged(*map(np.concatenate, zip(*map(unpacked_words, parts), strict=True)))
        put_file(f"{folder}/words-{bucket}", np.concatenate([np.array([len(keys)], np.uint64).view(np.uint8), keys.view(np.uint8), counts.astype(np.uint64).view(np.uint8)]).tobytes())
        top = np.argsort(-counts, kind="stable")[: int(1 / hot_share) + 1]
        return pa.record_batch([pa.array([int(counts.sum())]), pa.array([len(keys)]), pa.array([keys[top].view(np.int64).tolist()]), pa.array([counts[top].tolist()])], ["n", "v", "top", "times"])

    sums = gathered(word_arrays(docs, model.word_buckets, text_col), model.word_buckets, words, "n long, v long, top array<long>, times array<long>")
    totals = written(sums, "words")
    n, v = totals.agg(F.sum("n"), F.sum("v")).first()
    model.tokens, model.words = n or 0, v or 0
    if not model.tokens:
        return model
    hot = totals.select(F.explode(F.arrays_zip("top", "times")).alias("x")).filter(F.col("x.times") > model.tokens * hot_share).select("x.top").collect()  # fewer than 1 / hot_share
    start = [START] if docs.count() > model.tokens * hot_share else []
    model.hot = np.unique(np.array([np.int64(r[0]) for r in hot], np.int64).view(np.uint64)) if hot else np.zeros(0, np.uint64)
    model.hot = np.unique(np.concatenate([model.hot, np.array(start, np.uint64)]))
    hot_words = model.hot

    def grams(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        before, word, counts = map(np.concatenate, zip(*map(unpacked_grams, parts), strict=True))
        keys, counts, before, word = merged(spread_gram(before, word, hot_words), counts, before, word)
        put_file(f"{folder}/grams-{bucket}", np.concatenate([np.array([len(keys)], np.uint64).view(np.uint8), keys.view(np.uint8), small(counts)]).tobytes())
        order = np.argsort(before, kind="stable")
        first = before[order]
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        first, stats = first[at], stats_of(counts[order], at)
        own = np.isin(first, hot_words)
        put_file(f"{folder}/contexts-{bucket}", np.concatenate([np.array([(~own).sum()], np.uint64).view(np.uint8), first[~own].view(np.uint8), np.ascontiguousarray(stats[~own].astype(np.uint32)).view(np.uint8).ravel()]).tobytes())
        # Different words before each word, as far as this bucket knows.
        order = np.argsort(word, kind="stable")
        w = word[order]
        at = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        low, low_counts = w[at], np.diff(np.append(at, len(w)))
        b = bucket_of(low, model.word_buckets)
        to, cuts = np.unique(b, return_index=True)  # parts that exist only: their number is bounded by the words, not by the buckets
        data = [{"bucket": int(k), "data": packed(low[x:y], low_counts[x:y])} for k, x, y in zip(to, cuts, [*cuts[1:], len(b)], strict=True)]
        k = pa.array([times(counts)], pa.list_(pa.int64()))
        own_stats = pa.array([[{"w": int(x), "s": s.tolist()} for x, s in zip(first[own].view(np.int64), stats[own], strict=True)]], pa.list_(pa.struct([("w", pa.int64()), ("s", pa.list_(pa.int64()))])))
        return pa.record_batch([k, own_stats, pa.array([data], pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())])))], ["k", "hot", "low"])

    found = written(gathered(gram_arrays(docs, model.gram_buckets, hot_words, text_col), model.gram_buckets, grams, "k array<long>, hot array<struct<w:long,s:array<long>>>, low array<struct<bucket:int,data:binary>>"), "grams")
    model.discounts = discounts_of(list(found.agg(*[F.sum(F.col("k")[i]) for i in range(4)]).first()))
    of_hot = found.select(F.explode("hot").alias("x")).groupBy("x.w").agg(*[F.sum(F.col("x.s")[i]).alias(f"s{i}") for i in range(4)]).collect()
    by_word = {int(np.int64(r[0]).view(np.uint64)): list(r)[1:] for r in of_hot}
    model.hot_stats = np.array([by_word.get(int(x), [0, 0, 0, 0]) for x in hot_words], np.int64).reshape(-1, 4)

    def low(bucket: int, parts: list[bytes]) -> pa.RecordBatch:
        keys, counts = merged(*map(np.concatenate, zip(*map(unpacked_words, parts), strict=True)))
        put_file(f"{folder}/low-{bucket}", np.concatenate([np.array([len(keys)], np.uint64).view(np.uint8), keys.view(np.uint8), small(counts)]).tobytes())
        return pa.record_batch([pa.array([[*times(counts), int(counts.sum()), int((counts == 1).sum()), int((counts == 2).sum()), int((counts >= 3).sum())]], pa.list_(pa.int64()))], ["k"])

    parts = found.select(F.inline("low"))
    lows = written(gathered(parts, model.word_buckets, low, "k array<long>"), "low")
    k = list(lows.agg(*[F.sum(F.col("k")[i]) for i in range(8)]).first())
    model.low_discounts, model.low_total = discounts_of(k[:4]), k[4]
    model.low_gamma = sum(d * n for d, n in zip(model.low_discounts, k[5:], strict=True)) / k[4]
    return model


class Sorted:
    """Sorted hashes in bucket files, memory-mapped when first asked for."""

    def __init__(self, folder: str, kind: str, buckets: int):
        self.folder, self.kind, self.buckets, self.open = folder, kind, buckets, {}

    def files(self, bucket: int):
        if bucket not in self.open:
            if len(self.open) >= OPEN_FILES:
                self.open.clear()
            path = f"{self.folder}/{self.kind}-{bucket}"
            self.open[bucket] = np.memmap(path, np.uint8, "r") if os.path.exists(path) else np.zeros(8, np.uint8)
        data = self.open[bucket]
        n = int(data[:8].view(np.uint64)[0])
        return data[8 : 8 + 8 * n].view(np.uint64), data[8 + 8 * n :]

    def find(self, keys: np.ndarray, buckets: np.ndarray, take) -> None:
        """For each bucket with asked keys (sorted): take(rows that are found, their places, the rest of the file)."""
        cuts = np.searchsorted(buckets, np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            x, y = cuts[b], cuts[b + 1]
            known, rest = self.files(int(b))
            if not len(known):
                continue
            at = np.minimum(np.searchsorted(known, keys[x:y]), len(known) - 1)
            ok = known[at] == keys[x:y]
            take(np.flatnonzero(ok) + x, at[ok], rest)


def small_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Some of the counts that small() wrote, read in place."""
    n, m = data[:8].view(np.uint32).tolist()
    out = data[8 + at].astype(np.int64)
    if m and (out == 255).any():
        big = data[8 + n : 8 + n + 4 * m].copy().view(np.uint32)
        real = data[8 + n + 4 * m : 8 + n + 12 * m].copy().view(np.uint64).astype(np.int64)
        own = np.flatnonzero(out == 255)
        out[own] = real[np.searchsorted(big, at[own])]
    return out


class Reader:
    def __init__(self, model: Model):
        m = self.model = model
        self.words, self.low = Sorted(m.folder, "words", m.word_buckets), Sorted(m.folder, "low", m.word_buckets)
        self.grams, self.contexts = Sorted(m.folder, "grams", m.gram_buckets), Sorted(m.folder, "contexts", m.gram_buckets)

    def word_counts(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, number of different words before) of each word."""
        order = np.argsort(hashes)
        asked = hashes[order]
        b = bucket_of(asked, self.model.word_buckets)
        counts, low = np.zeros(len(asked), np.int64), np.zeros(len(asked), np.int64)
        self.words.find(asked, b, lambda rows, at, rest: counts.__setitem__(rows, rest.view(np.uint64)[at].astype(np.int64)))
        self.low.find(asked, b, lambda rows, at, rest: low.__setitem__(rows, small_at(rest, at)))
        out = np.empty_like(counts), np.empty_like(low)
        out[0][order], out[1][order] = counts, low
        return out

    def context_stats(self, hashes: np.ndarray) -> np.ndarray:
        """(sum, ones, twos, more) of the bigrams that start with each word."""
        m = self.model
        out = np.zeros((len(hashes), 4), np.int64)
        bucket = bucket_of(mix(hashes), m.gram_buckets)
        order = np.lexsort((hashes, bucket))
        asked, found = hashes[order], np.zeros((len(hashes), 4), np.int64)
        self.contexts.find(asked, bucket[order], lambda rows, at, rest: found.__setitem__(rows, rest.view(np.uint32).reshape(-1, 4)[at].astype(np.int64)))
        out[order] = found
        if len(m.hot):
            at = np.minimum(np.searchsorted(m.hot, hashes), len(m.hot) - 1)
            own = m.hot[at] == hashes
            out[own] = m.hot_stats[at[own]]
        return out

    def gram_counts(self, keys: np.ndarray) -> np.ndarray:
        asked, back = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(asked), np.int64)
        self.grams.find(asked, bucket_of(asked, self.model.gram_buckets), lambda rows, at, rest: counts.__setitem__(rows, small_at(rest, at)))
        return counts[back]

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, model score) of each text."""
        m = self.model
        codes, counts, hashes = tokens_of(column)
        seen, low = self.word_counts(hashes)
        base = np.log10((seen + 0.5) / (m.tokens + 0.5 * (m.words + 1)))
        discount = np.array([0, *(m.low_discounts or [0, 0, 0])])
        p1 = np.maximum(low - discount[np.minimum(low, 3)], 0) / max(m.low_total, 1) + m.low_gamma / (m.words + 1)
        before = bigrams_of(codes, counts, hashes)
        stats = self.context_stats(np.append(hashes, START))
        total = np.maximum(stats[:, 0], 1)
        discount = np.array([0, *(m.discounts or [0, 0, 0])])
        gamma = np.where(stats[:, 0] > 0, stats[:, 1:] @ discount[1:] / total, 1.0)
        first = np.concatenate([[len(hashes)], codes[:-1]])
        first[np.cumsum(counts) - counts] = len(hashes)
        c = self.gram_counts(spread_gram(before, hashes[codes], m.hot)) if m.tokens else np.zeros(len(codes), np.int64)
        p = np.maximum(c - discount[np.minimum(c, 3)], 0) / total[first] + gamma[first] * p1[codes]
        return counts, run_sums((seen[codes] > 0).astype(np.int64), counts), run_sums(base[codes], counts), run_sums(np.log10(p), counts)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score, score, perplexity; older columns of these names are replaced.

    Null counts as empty: one token, the end. Repeated rows get the same scores.
    """
    new = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]
    ship(docs.sparkSession)
    base = docs.drop(*new)
    at = base.columns.index(text_col)
    schema = StructType([*base.schema.fields, *StructType.fromDDL("n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            texts = text_column(batch.column(at))
            for a, b in text_slices(texts):
                n, known, plain, own = reader.scores(texts.slice(a, b - a))
                more = [n, known, np.full(b - a, model.tokens), plain, own, 10 ** (-own / n)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, *map(pa.array, more)], [*batch.schema.names, *new])

    return map_batches(base, run, schema)


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text has this remainder; a null id has none and is trained on."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))
