"""Near-duplicate detection by Order MinHash, verified by banded alignment.

A text is its lower-cased words between white space. Its k-mers (pairs of words) are labelled by occurrence, so
that a repeated one counts as often as it occurs. Each of several sketches takes the k-mers of least hash
and keeps them in the order of the text, so two texts agree on a sketch as they agree in words and in their
order. Texts that agree on a sketch are candidates; a pair is a link if its edit similarity,
1 - (word edits) / (words of the longer), is at least the threshold. Groups are the connected parts.

Texts with equal words are one class throughout, known by a 128-bit hash of their words, and only classes are
compared; a pair whose counts of words by hash class rule a link out isn't aligned (see least_edits()). Words are their 64-bit hashes, as long as the text needs. A bucket of n classes gives about n candidates at first (each with the least of the bucket). Each class's best candidate is verified, then those of the others that lie in different groups yet.
In buckets that are still in several groups, as those of a shared template are, classes try a few neighbours more, and those that remain
go on exactly: two similar texts have one of their rarest pairs of words in common (or of their rarest words, see posted()), so all
pairs that do are verified, and no other can be a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import coded_words, drop_tables, kept_rows, mix, ragged, run_sums, text_column, text_slices, word_hashes, written

K, LEAST, SIMILARITY = 5, 2, 0.8
#: Sketches are of pairs of words, as an edit leaves few of the longer k-mers: with every fifth word edited (similarity 0.8) no 5-mer
#: is left but 3 in 5 of the pairs, and one of 80 sketches of three pairs agrees in 99.8 % of cases.
SKETCHES, SKETCH_K, SKETCH_LEAST = 80, 2, 3
#: Texts of at most SHORT[1] words are sketched by the least SHORT_LEAST pairs, those of more than SHORT[0] by the least
#: SKETCH_LEAST, so that two texts of like length share a kind.
SHORT, SHORT_LEAST = (40, 50), 2
#: K-mers that are sketched at a time, few enough for the cache.
BLOCK = 32_000
HOT_SHARE = 1 / 256
#: Bytes of the filter that keeps texts without candidates from being moved.
FILTER_BYTES = 16 << 20
#: Classes of a bucket that are sorted together.
PART = 2000
#: Most frequent tokens of a class that go with each of its rows in the exact finish, so that a pair is sent seldom more than once.
FIRST = 32
#: Turns in which classes of open buckets try neighbours, and neighbours of a class in each, before the exact finish.
TURNS, TRIES = 3, 4
#: A turn in which fewer than one in FEW pairs is a link is the last: the exact finish takes what is left anyway.
FEW = 100
#: Hash classes of words that go with each row of the exact finish, four bits each.
FINE = 2048
#: Hash classes of words that go with each row where partners are first looked for, four bits each.
SMALL = 256
#: Up to so many links are joined to groups in one task (32 bytes each).
LOCAL_LINKS = 1 << 20
#: From this many occurrences on, a pair of words is common: texts that share it must share one of their rarest words as well.
COMMON = 256
#: Bits of the greatest table by which pairs of words of open buckets are counted, to order them by rarity: one byte each, sent to all.
RARITY_BITS = 26
#: K-mers are ordered by the high bits of their hash, then by place. Up to LONG k-mers a place fits into the low bits.
LONG = 1 << 24
POSITION = np.uint64(LONG - 1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words of each text)."""
    codes, counts, words = coded_words(pc.utf8_lower(column))
    empty = pc.index(words, "").as_py()
    kept = codes != empty
    return word_hashes(words.to_pylist())[codes[kept]] if len(words) else np.zeros(0, np.uint64), run_sums(kept.astype(np.int64), counts)


def class_keys(words: np.ndarray, counts: np.ndarray) -> list[bytes]:
    import xxhash

    ends = np.cumsum(counts)
    return [xxhash.xxh3_128_digest(words[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]


def kmers(words: np.ndarray, counts: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(occurrence-labelled hash of each k-mer, k-mers of each text). A shorter text is one k-mer; an empty one has none."""
    ends = np.cumsum(counts)
    h = np.zeros(len(words), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            part = words[j:] if j else words
            h[: len(part)] = mix(h[: len(part)] + part)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    at = np.arange(int(n.sum()), dtype=np.int64) + np.repeat(ends - counts - (np.cumsum(n) - n), n)
    out = h[at]
    short = (counts > 0) & (counts < k)
    for i in np.flatnonzero(short):  # its own words only
        x = np.uint64(0)
        for w in words[ends[i] - counts[i] : ends[i]]:
            x = mix(np.array([(int(x) + int(w)) & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]
        out[(np.cumsum(n) - n)[i]] = x
    doc = np.repeat(np.arange(len(counts), dtype=np.uint64), n)
    with np.errstate(over="ignore"):
        own = mix(out + doc * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own)
    equal = own[order][1:] == own[order][:-1]
    if equal.any():
        again = order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]
        order = again[np.lexsort((again, own[again]))]  # repeated ones only, in the order of the text
        same = np.concatenate([[False], own[order][1:] == own[order][:-1]])
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        with np.errstate(over="ignore"):
            label = run[same].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
            out[order[same]] = mix(out[order[same]] + label)
    return out, n


def leasts(v: np.ndarray, least: int) -> np.ndarray:
    """Places of the least values, ties by place; for texts of any length. A text of more than LONG k-mers has enough of them."""
    at = np.flatnonzero(v <= np.partition(v, least - 1)[least - 1])
    return at[np.argsort(v[at], kind="stable")[:least]]


def sketches(grams: np.ndarray, n: np.ndarray, count: int = SKETCHES, least: int = LEAST, kind: int = 0) -> np.ndarray:
    """(texts, count): hash of the `least` k-mers of least hash, in text order, for each of `count` orders. Only for texts with k-mers."""
    starts = np.cumsum(n) - n
    cuts = np.flatnonzero(np.diff(starts // BLOCK)) + 1
    if len(cuts):
        return np.concatenate([sketches(g, x, count, least, kind) for g, x in zip(np.split(grams, starts[cuts]), np.split(n, cuts), strict=True)])
    long = int(n.max()) > LONG  # such a text is a block of its own
    place = (np.arange(len(grams), dtype=np.uint64) - np.repeat(starts, n).astype(np.uint64)) & POSITION
    out = np.zeros((len(n), count), np.uint64)
    rng = np.random.default_rng(20240229)
    seeds = rng.integers(1 << 63, size=(count, 2), dtype=np.uint64) | np.uint64(1)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    for c in range(count):
        with np.errstate(over="ignore"):
            v = grams * seeds[c, 0]
            v ^= v >> np.uint64(32)
            v *= seeds[c, 1]
        v &= ~POSITION
        if long:
            where = np.concatenate([leasts(v[a : a + m], least) + a for a, m in zip(starts, n, strict=True)]).reshape(-1, least)
        else:
            v |= place
            found = []
            for _ in range(least):
                low = np.minimum.reduceat(v, starts)
                at = starts + (low & POSITION).astype(np.int64)
                gone = low == top  # no k-mer is left
                found.append(np.where(gone, -1, at))
                v[at[~gone]] = top
            where = np.stack(found, 1)
        where = np.sort(where, 1)
        h = np.full(len(n), np.uint64(kind * count + c + 1))
        with np.errstate(over="ignore"):
            for j in range(least):
                own = where[:, j] >= 0
                h[own] = mix(h[own] * np.uint64(0x9E3779B97F4A7C15) + grams[where[own, j]])
        out[:, c] = h
    return out


# Alignment --------------------------------------------------------------------------------------


def banded(pairs: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    """Edit distance of each pair within `width` diagonals of the main one; exact if at most `width`. Pairs of like length go in step."""
    n, m = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    p, rows, band = len(pairs), int(n.max()), 2 * width + 1
    a, b = np.zeros((p, rows), np.int64), np.full((p, int(max(m.max(), rows)) + band + 1), -1, np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], b[i, width : width + len(y)] = x, y
    far = np.int32(1 << 28)
    k = np.arange(band, dtype=np.int32)
    d = np.where(k >= width, k - width, far)[None].repeat(p, 0).astype(np.int32)
    out = np.full(p, far, np.int32)
    final = m - n + width
    ok = (final >= 0) & (final < band)
    done = ok & (n == 0)
    out[done] = d[done, final[done]]
    for i in range(1, rows + 1):
        t = d + (b[:, i - 1 : i - 1 + band] != a[:, i - 1 : i])
        np.minimum(t[:, :-1], d[:, 1:] + 1, out=t[:, :-1])
        if i <= width:
            t[:, width - i] = i
            t[:, : width - i] = far
        t -= k
        np.minimum.accumulate(t, axis=1, out=t)
        t += k
        d = t.astype(np.int32, copy=False)
        end = ok & (n == i)
        if end.any():
            out[end] = d[end, final[end]]
    return out


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without common words at the ends, which an alignment can always pair."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
    tail = int(differ[0]) if len(differ) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Words in common, as often as both have them."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(n[i], m[j]).sum())


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], threshold: float = SIMILARITY) -> np.ndarray:
    """Whether each pair's edit similarity is at least the threshold, exactly.

    Bands are doubled until the distance fits or no fitting distance would do.
    """
    out = np.zeros(len(pairs), bool)
    limit = np.array([int(np.floor((1 - threshold) * max(len(a), len(b)) + 1e-9)) for a, b in pairs], np.int64)
    work: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > limit[i]:
            continue
        x, y = trimmed(a, b)
        if max(len(x), len(y)) <= limit[i]:
            out[i] = True
        elif max(len(x), len(y)) - in_common(x, y) <= limit[i]:
            work[i] = (x, y) if len(x) <= len(y) else (y, x)
    width = 8
    while work:
        left = sorted(work, key=lambda i: len(work[i][0]))
        again = {}
        k = 0
        while k < len(left):
            most = max(1, 400_000 // (2 * width + 1))
            part = [left[k]]
            while k + len(part) < len(left) and len(part) < most and len(work[left[k + len(part)]][0]) <= 1.25 * len(work[left[k]][0]) + 16:
                part.append(left[k + len(part)])
            k += len(part)
            d = banded([work[i] for i in part], width)
            for i, x in zip(part, d.tolist(), strict=True):
                if x <= min(width, limit[i]):
                    out[i] = True
                elif width < limit[i]:
                    again[i] = work[i]
        work, width = again, width * 2
    return out


# Groups -----------------------------------------------------------------------------------------


def sketched(docs: DataFrame, id_col: str, text_col: str, count: int, least: int, k: int) -> DataFrame:
    """(_id, _row, _sha, _key, _sketches) of each row; no sketches for a text without words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(3))
            for a, b in text_slices(texts, 4_000_000):
                words, counts = words_of(texts.slice(a, b - a))
                size, parts = np.zeros(b - a, np.int64), []
                for kind, (on, few) in enumerate(((counts > SHORT[0], least), ((counts > 0) & (counts <= SHORT[1]), SHORT_LEAST))):
                    if on.any():
                        own = words[ragged((np.cumsum(counts) - counts)[on], counts[on])]
                        parts.append((np.flatnonzero(on), sketches(*kmers(own, counts[on], k), count, few, kind)))
                        size[on] += count
                flat, at = np.zeros(int(size.sum()), np.uint64), np.cumsum(size) - size
                for on, own in parts:
                    flat[ragged(at[on], np.full(len(on), count))] = own.ravel()
                    at[on] += count
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat.view(np.int64)))
                yield pa.record_batch([*(batch.column(c).slice(a, b - a) for c in range(3)), pa.array(class_keys(words, counts), pa.binary()), lists], ["i", "r", "s", "k", "m"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("i"), F.monotonically_increasing_id().alias("r"), F.unhex(F.sha2(text, 256)).alias("s"), text.alias("t"))
    out = rows.mapInArrow(run, f"i {kind}, r long, s binary, k binary, m array<long>")
    return written(out.toDF("_id", "_row", "_sha", "_key", "_sketches"), "sketches")


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, n): pairs of classes, a > b, that agree on n sketches, each with the least of a bucket, all pairs in buckets of up to three; and (s, _key, size), the buckets.

    A group of near copies shares most of its buckets' leasts, so it gives few pairs a class; neighbours are only tried where groups still differ.
    Sketches are counted first, without keys; keys move only for those that a filter of the shared ones lets through.
    """
    sizes = classes.select(F.explode("_sketches").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = written(sizes, "sizes")
    sent = classes.sparkSession.sparkContext.broadcast(hash_filter(sizes.select("s")))

    def member(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, row = pc.list_flatten(batch.column(1)), pc.list_parent_indices(batch.column(1))
            on = pa.array(passes(filter_keys(s.to_numpy().view(np.uint64)), sent.value))
            yield pa.record_batch([batch.column(0).take(row.filter(on)), s.filter(on)], ["_key", "s"])

    bucket = classes.select("_key", "_sketches").mapInArrow(member, "_key binary, s long")
    # A large bucket is cut by hash into parts, so that no task sorts more than a part of it; the leasts of its parts are paired too.
    part = F.pmod(F.xxhash64("_key"), F.ceil(F.col("size") / PART))
    full = written(bucket.join(sizes, "s").withColumn("part", part), "buckets")
    ordered = Window.partitionBy("s", "part").orderBy("_key")
    beside = F.when(F.col("size") <= 3, F.lag("_key").over(ordered))
    near = full.select(F.col("_key").alias("a"), beside.alias("x"), F.first("_key").over(ordered).alias("y"))
    near = near.select("a", F.explode(F.array("x", "y")).alias("b")).filter("b != a")
    heads = full.filter(F.col("size") > PART).groupBy("s", "part").agg(F.min("_key").alias("a"))
    heads = heads.join(heads.groupBy("s").agg(F.min("a").alias("b")), "s").filter("a != b").select("a", "b")
    found = written(near.unionByName(heads).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), "candidates")
    drop_tables(sizes)
    return found, full


def rooted(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(s, size, k, root): the rows of buckets with their groups. In a bucket of up to three, candidates() gives all pairs."""
    rows = buckets.filter("size > 3").join(parts, F.col("_key") == F.col("k"), "left")
    return rows.select("s", "size", F.col("_key").alias("k"), F.coalesce("root", "_key").alias("root"))


def open_classes(buckets: DataFrame, parts: DataFrame) -> DataFrame:
    """(k, root): the classes of buckets that lie in several groups. Nothing reads the buckets after it: they are deleted."""
    rows = written(rooted(buckets, parts).select("s", "k", "root"), "rooted")
    drop_tables(buckets)
    several = rows.groupBy("s").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x != y").select("s")
    opened = written(rows.join(several, "s", "left_semi").select("k", "root").distinct(), "open")
    drop_tables(rows)
    return opened


def neighbours(buckets: DataFrame, parts: DataFrame, turn: int) -> DataFrame:
    """(a, b): pairs of different groups, a > b, that stand side by side when the rows of a bucket are shuffled; at most TRIES for a class as the later one.

    A turn takes an eighth of the buckets, its own one: a class with many links stands in many. It gives few pairs where one group holds nearly
    all of a bucket. It only saves work for the exact finish, which takes all buckets.
    """
    opened = rooted(buckets.filter(F.pmod(F.xxhash64("s"), F.lit(8)) == turn % 8), parts)
    shuffled = F.xxhash64("k", F.lit(turn + 1))
    ordered = Window.partitionBy("s", "part").orderBy(shuffled, "k")
    rows = opened.withColumn("part", F.pmod(shuffled, F.ceil(F.col("size") / PART)))
    rows = rows.select("k", "root", F.lag("k").over(ordered).alias("b"), F.lag("root").over(ordered).alias("other")).filter("root != other")
    pairs = rows.select("k", "b").distinct()
    rank = F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64("k", "b"), "b"))
    pairs = pairs.withColumn("rank", rank).filter(F.col("rank") <= TRIES)
    return pairs.select(F.greatest("k", "b").alias("a"), F.least("k", "b").alias("b")).distinct()


def labelled(words: list[np.ndarray], k: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of k words with its occurrence in its text, number of each text), so that those in common count as often as both have them."""
    counts = np.array([len(w) for w in words], np.int64)
    return kmers(mix(np.concatenate(words)), counts, k) if len(words) else (np.zeros(0, np.uint64), counts)


def slot(tokens: np.ndarray, bits: int) -> np.ndarray:
    """Where a token is counted, in a table of 2 ** bits."""
    return (tokens >> np.uint64(64 - bits)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: 0, 1, and 1 + floor(8 log2 n) beyond."""
    return np.where(counts > 0, 1 + np.floor(8 * np.log2(np.maximum(counts, 1)) + 1e-9), 0).astype(np.uint8)


def prefixes(tokens: np.ndarray, counts: np.ndarray, df: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Places of the `most` rarest tokens of each text, but for those alone in their slot, which meet none. df, by slot, only makes the order a good one."""
    seen = df[slot(tokens, len(df).bit_length() - 1)]
    text = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((tokens, seen, text))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(counts) - counts, counts)
    return order[(place < np.repeat(most, counts)) & (seen[order] > 1)]


def posted(words: list[np.ndarray], df: np.ndarray, threshold: float, common: int) -> tuple[np.ndarray, np.ndarray]:
    """(token, its text): similar texts have one of these in common. common: the level, in df, from which a pair of words is.

    An edit changes at most two pairs of neighbouring words, so similar texts of n <= m words have at least m - 1 - 2 floor((1 - threshold) m)
    of them in common, and in any one order of the pairs their prefixes of 2 floor((1 - threshold) (n + 1)) + 2 meet (the floors cost one
    more where m is n + 1). Likewise their prefixes of floor((1 - threshold) n) + 1 words meet. Where two texts meet in a common pair of words
    only, as those with a long template do, both have a common pair in their prefix: such texts send the rarest of their words instead of
    their common pairs, and words of the template are among these only if it makes most of the text.
    """
    counts = np.array([len(w) for w in words], np.int64)
    pairs, n = labelled(words)
    at = prefixes(pairs, n, df, 2 * np.floor((1 - threshold) * (n + 1) + 1e-9).astype(np.int64) + 2)  # a text of n words has n - 1 pairs
    text = np.repeat(np.arange(len(n)), n)[at]
    often = df[slot(pairs[at], len(df).bit_length() - 1)] >= common
    also = np.unique(text[often])
    if not len(also):
        return pairs[at], text
    singles, m = labelled([words[i] for i in also.tolist()], 1)
    of = prefixes(singles, m, df, np.floor((1 - threshold) * counts[also] + 1e-9).astype(np.int64) + 1)
    return np.concatenate([pairs[at[~often]], singles[of]]), np.concatenate([text[~often], np.repeat(also, m)[of]])


def token_counts(own: DataFrame, slices) -> np.ndarray:
    """How often pairs of words and words occur, by slot, as levels(): two slots a token or more, up to 2 ** RARITY_BITS of them in all.

    Tasks send what a slice of texts has, as one packed row for each of 256 ranges of slots; ranges are added up apart and sent to the driver as bytes.
    """
    total = own.agg(F.sum(F.octet_length("w"))).first()[0] // 4
    bits = int(np.clip(np.ceil(np.log2(max(total, 1))) + 1, 12, RARITY_BITS))
    low = bits - 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, words in slices(batch):
                tokens = np.concatenate([labelled(words, 2)[0], labelled(words, 1)[0]])
                at, n = np.unique(slot(tokens, bits), return_counts=True)
                cuts = np.searchsorted(at, np.arange(257) << low)
                f = [x for x in range(256) if cuts[x] < cuts[x + 1]]
                packed = [np.stack([at[cuts[x] : cuts[x + 1]] & ((1 << low) - 1), n[cuts[x] : cuts[x + 1]]]).astype(np.uint32).tobytes() for x in f]
                yield pa.record_batch([pa.array(f, pa.int32()), pa.array(packed, pa.binary())], ["f", "m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges: dict[int, np.ndarray] = {}
        for batch in batches:
            for f, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, n = np.frombuffer(m, np.uint32).reshape(2, -1)
                ranges.setdefault(f, np.zeros(1 << low, np.int64))[at] += n  # a slot is in a row once
        yield pa.record_batch([pa.array(list(ranges), pa.int32()), pa.array([levels(r).tobytes() for r in ranges.values()], pa.binary())], ["f", "m"])

    df = np.zeros((256, 1 << low), np.uint8)
    for f, m in own.mapInArrow(count, "f int, m binary").repartition("f").mapInArrow(add, "f int, m binary").collect():  # at most 256 rows, 2 ** RARITY_BITS bytes
        df[f] = np.frombuffer(m, np.uint8)
    return df.ravel()


def placed(tokens: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Tokens as numbers in order of place: the most frequent first, then by hash."""
    return (255 - df[slot(tokens, len(df).bit_length() - 1)].astype(np.int64) << 55) | (tokens >> np.uint64(9)).astype(np.int64)


def first_tokens(tokens: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """(texts, FIRST): the least tokens of each text, filled up with the greatest number."""
    out = np.full((texts, FIRST), np.iinfo(np.int64).max)
    order = np.lexsort((tokens, text))
    of = text[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    on = place < FIRST
    out[of[on], place[on]] = tokens[order][on]
    return out


def list_ends(token: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each row's token and block pair, end of its rows); rows stand in order of both."""
    new = np.concatenate([[True], (token[1:] != token[:-1]) | (block[1:] != block[:-1])])
    number = np.cumsum(new) - 1
    return number, np.append(np.flatnonzero(new)[1:], len(token))[number]


def like(x: np.ndarray, y: np.ndarray, block: np.ndarray, own: np.ndarray, root: np.ndarray, n: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows x and y, of one token and block pair, are to be paired there, lie in different groups and are of like length."""
    near = np.abs(n[x] - n[y]) <= np.floor((1 - threshold) * np.maximum(n[x], n[y]) + 1e-9)
    return (root[x] != root[y]).any(1) & near & ((own[x] != own[y]) | (block[x] % 65536 == block[x] // 65536))


def partnered(token: np.ndarray, block: np.ndarray, own: np.ndarray, root: np.ndarray, n: np.ndarray, small: np.ndarray, threshold: float) -> np.ndarray:
    """Whether each row has a partner: one that like() and small, (rows, SMALL / 2) fine_signatures(), don't rule out. Arguments as for meeting().

    In a large corpus most rows of a token have none, as unlike texts have a rare pair of words in common by chance.
    """
    out = np.zeros(len(token), bool)
    if not len(token):
        return out
    number, ends = list_ends(token, block)
    at, d = np.arange(len(token)), 1
    while len(at := at[at + d < ends[at]]):
        if d & (d - 1) == 0:  # now and then, lists are left in which all have one
            at = at[np.bincount(number, ~out)[number[at]] > 0]
        x = at[~(out[at] & out[at + d])]
        x = x[like(x, x + d, block, own, root, n, threshold)]
        for k in range(0, len(x), 10_000):  # some 10 MB of unpacked counts at a time
            p, q = x[k : k + 10_000], x[k : k + 10_000] + d
            ok = least_edits(unpacked(small[p]), unpacked(small[q]), n[p], n[q]) <= np.floor((1 - threshold) * np.maximum(n[p], n[q]) + 1e-9)
            out[p[ok]] = out[q[ok]] = True
        d += 1
    return out


def blocks(tokens: np.ndarray, row: np.ndarray, keys: np.ndarray, long: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(token, block, own part, text) of the rows to send. long: the tokens, as signed numbers in order, of lists that are cut into `parts`; keys: of the texts.

    A long list is cut by hash of the key, and each row goes to all pairs of its own part with another: all its pairs meet, some thousand rows at a time.
    """
    count = np.ones(len(tokens), np.int64)
    if len(long):
        at = np.minimum(np.searchsorted(long, tokens.view(np.int64)), len(long) - 1)
        count = np.where(long[at] == tokens.view(np.int64), parts[at], 1)
    h = keys.astype(np.uint64)
    own = (mix(h[:, 0] ^ mix(h[:, 1]))[row] % count.astype(np.uint64)).astype(np.int64)
    of = np.repeat(np.arange(len(tokens)), count)
    other = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    return tokens[of], np.minimum(own[of], other) * 65536 + np.maximum(own[of], other), own[of], row[of]


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in order of (t, block), the first two columns, as tables that hold all rows of each; the last list of a batch may go on in the next."""
    left: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([left, table]) if left is not None else table
        t, block = table.column(0).to_numpy(), table.column(1).to_numpy()
        change = np.flatnonzero((t[1:] != t[:-1]) | (block[1:] != block[:-1])) + 1
        at = int(change[-1]) if len(change) else 0
        if at:
            yield table.slice(0, at)
        left = table.slice(at)
    if left is not None:
        yield left


def meeting(token: np.ndarray, block: np.ndarray, own: np.ndarray, key: np.ndarray, root: np.ndarray, n: np.ndarray, sums: np.ndarray, place: np.ndarray, first: np.ndarray, threshold: float, fine: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b) of rows of one token and block pair, key of a > key of b, in different groups, of like length, and not ruled out by sums.

    Rows stand in order of token and block; of a pair of different blocks only rows of both are paired. key, root: (rows, 2) big-endian
    halves; sums: (rows, 256) signatures; place: of the token; first: (rows, FIRST), the
    least places of tokens of each row's class: a pair with a token of lesser place in common meets there too, and isn't given here. So texts that share a template but are no links meet here and nothing is sent.
    fine: (rows, FINE / 2) fine_signatures(), which rule out more of what the others leave, above all of long texts.
    """
    if not len(token):
        return
    ends = list_ends(token, block)[1]
    at, d = np.arange(len(token)), 1
    while len(at := at[at + d < ends[at]]):
        x, y = at, at + d
        ok = like(x, y, block, own, root, n, threshold)
        x, y = x[ok], y[ok]
        for k in range(0, len(x), 25_000):  # some 13 MB of signatures at a time
            part = slice(k, k + 25_000)
            ok[k : k + len(x[part])] = least_edits(sums[x[part]], sums[y[part]], n[x[part]], n[y[part]]) <= np.floor((1 - threshold) * np.maximum(n[x[part]], n[y[part]]) + 1e-9)
        x, y = x[ok[: len(x)]], y[ok[: len(x)]]
        for k in range(0, len(x), 25_000):
            p, q = first[x[k : k + 25_000], :, None], first[y[k : k + 25_000], None, :]
            ok[k : k + len(p)] = ~((p == q) & (p < place[x[k : k + 25_000], None, None])).any((1, 2))
        x, y = x[ok[: len(x)]], y[ok[: len(x)]]
        if fine is not None:
            for k in range(0, len(x), 2000):  # some 8 MB of unpacked counts at a time
                p, q = x[k : k + 2000], y[k : k + 2000]
                ok[k : k + len(p)] = least_edits(unpacked(fine[p]), unpacked(fine[q]), n[p], n[q]) <= np.floor((1 - threshold) * np.maximum(n[p], n[q]) + 1e-9)
            x, y = x[ok[: len(x)]], y[ok[: len(x)]]
        more = (key[x, 0] > key[y, 0]) | ((key[x, 0] == key[y, 0]) & (key[x, 1] > key[y, 1]))
        if len(x):
            yield np.where(more, x, y), np.where(more, y, x)
        d += 1


def open_pairs(opened: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs of open classes in different groups, a > b, that share a token of their prefixes and are of like length."""
    own = written(needed(words.select("k", "w"), opened, opened.count()).join(opened, "k").select("k", "root", "w"), "open-words")

    def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
        for a, b in text_slices(batch.column("w"), 4_000_000):
            part = batch.slice(a, b - a)
            yield part, [np.frombuffer(w.as_py(), np.uint64) for w in part.column("w")]

    sent = own.sparkSession.sparkContext.broadcast(token_counts(own, slices))
    common = int(levels(np.array([COMMON]))[0])

    def touch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                tokens, row = posted(words, sent.value, threshold, common)
                yield pa.record_batch([pa.array(tokens.view(np.int64)), part.column("root").take(pa.array(row))], ["t", "root"])

    # Roots go first, to find the tokens that several groups have; only rows of these send the rest.
    lists = own.select("root", "w").mapInArrow(touch, "t long, root binary").groupBy("t").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count(F.lit(1)).alias("size"))
    lists = written(lists.filter("x != y").select("t", F.ceil(F.col("size") / PART).alias("parts")), "lists")
    live = own.sparkSession.sparkContext.broadcast(hash_filter(lists.select(F.col("t").alias("s"))))

    cut = lists.filter("parts > 1").sort("t").toArrow()  # a PART-th of the rows above, at most
    long = own.sparkSession.sparkContext.broadcast((cut.column(0).to_numpy(), cut.column(1).to_numpy()))
    dealt = lambda posts: posts.repartition("t", "block").sortWithinPartitions("t", "block")

    halves = lambda c: np.frombuffer(b"".join(c.to_pylist()), ">u8").reshape(-1, 2)

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                tokens, row = posted(words, sent.value, threshold, common)
                on = passes(filter_keys(tokens), live.value)
                tokens, block, mine, row = blocks(tokens[on], row[on], halves(part.column("k")), *long.value)
                n = pa.array(np.array([len(w) for w in words], np.int64))
                small = pa.array([g.tobytes() for g in fine_signatures(words, SMALL)], pa.binary())
                for at in range(0, len(row), 20_000):
                    some = slice(at, at + 20_000)
                    rest = (c.take(pa.array(row[some])) for c in (part.column("k"), part.column("root"), n, small))
                    yield pa.record_batch([pa.array(tokens[some].view(np.int64)), pa.array(block[some]), pa.array(mine[some]), *rest], ["t", "block", "own", "k", "root", "n", "g"])

    def partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            t, block, own, k, root, n, g = (table.column(c).combine_chunks() for c in table.column_names)
            small = np.frombuffer(b"".join(g.to_pylist()), np.uint8).reshape(-1, SMALL // 2)
            on = pa.array(partnered(t.to_numpy(), block.to_numpy(), own.to_numpy(), halves(root), n.to_numpy(), small, threshold))
            yield pa.record_batch([t.filter(on), k.filter(on)], ["t", "k"])

    # Rows with a small signature go first; only those with a partner send the rest, which is ten times as much.
    sought = dealt(own.select("k", "root", "w").mapInArrow(seek, "t long, block long, own long, k binary, root binary, n long, g binary"))
    found = written(sought.mapInArrow(partner, "t long, k binary").groupBy("k").agg(F.collect_set("t").alias("ts")), "partners")
    # Merged, not broadcast, as in verified().
    mine = needed(own, found.select("k"), found.count()).join(found.hint("merge"), "k").select("k", "root", "w", "ts")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in slices(batch):
                tokens, row = posted(words, sent.value, threshold, common)
                ts = part.column("ts")
                pair = lambda t, r: mix(t ^ mix(r.astype(np.uint64)))
                on = np.isin(pair(tokens, row), pair(pc.list_flatten(ts).to_numpy().view(np.uint64), pc.list_parent_indices(ts).to_numpy()))
                tokens, row = tokens[on], row[on]
                n = pa.array(np.array([len(w) for w in words], np.int64))
                first = pa.array([f.tobytes() for f in first_tokens(placed(tokens, sent.value), row, len(words))], pa.binary())
                tokens, block, mine, row = blocks(tokens, row, halves(part.column("k")), *long.value)
                place = placed(tokens, sent.value)
                fine = pa.array([g.tobytes() for g in fine_signatures(words)], pa.binary())
                for at in range(0, len(row), 5000):
                    some = slice(at, at + 5000)
                    k, root, m, g, f = (c.take(pa.array(row[some])) for c in (part.column("k"), part.column("root"), n, fine, first))
                    yield pa.record_batch([pa.array(tokens[some].view(np.int64)), pa.array(block[some]), pa.array(mine[some]), k, root, m, g, pa.array(place[some]), f], ["t", "block", "own", "k", "root", "n", "g", "place", "first"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_lists(batches):
            t, block, own, k, root, n, g, place, first = (table.column(c).combine_chunks() for c in table.column_names)
            fine = np.frombuffer(b"".join(g.to_pylist()), np.uint8).reshape(-1, FINE // 2)
            least = np.frombuffer(b"".join(first.to_pylist()), np.int64).reshape(-1, FIRST)
            for a, b in meeting(t.to_numpy(), block.to_numpy(), own.to_numpy(), halves(k), halves(root), n.to_numpy(), coarse(fine), place.to_numpy(), least, threshold, fine):
                yield pa.record_batch([k.take(pa.array(a)), k.take(pa.array(b))], ["a", "b"])

    posts = dealt(mine.mapInArrow(post, "t long, block long, own long, k binary, root binary, n long, g binary, place long, first binary"))
    return posts.mapInArrow(pair, "a binary, b binary").distinct()


def keys_of(pairs: DataFrame) -> DataFrame:
    """(k): the keys of pairs (a, b), each once for a batch that has it: a key that is in many pairs isn't sent for each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.concat_arrays([batch.column("a"), batch.column("b")]).unique()], ["k"])

    return pairs.select("a", "b").mapInArrow(run, "k binary")


def needed(words: DataFrame, wanted: DataFrame, rows: int) -> DataFrame:
    """The rows of words that a filter of the wanted keys lets through, so that a join moves few others. wanted: (k, ...), at most about `rows` keys."""
    sent = words.sparkSession.sparkContext.broadcast(key_filter(wanted, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(batch.column("k").to_pylist(), sent.value)))

    return words.mapInArrow(run, words.schema)


def verified(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that are similar. pairs: a written table; words: (k, w), the words of each class, of which only those of the pairs move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False).astype(np.int64) + pc.binary_length(batch.column(3)).to_numpy(zero_copy_only=False)
            cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(np.cumsum(size) // 8_000_000)) + 1, [batch.num_rows]]))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = batch.slice(x, y - x)
                both = [(np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)) for a, b in zip(part.column(2), part.column(3), strict=True)]
                ok = pa.array(similar(both, threshold))
                yield pa.record_batch([part.column(0), part.column(1)], ["a", "b"]).filter(ok)

    own = needed(words.select("k", "w"), keys_of(pairs), 2 * pairs.count())
    one = own.select(F.col("k").alias("a"), F.col("w").alias("wa"))
    two = own.select(F.col("k").alias("b"), F.col("w").alias("wb"))
    # Merged, not broadcast: else a task would hold the filter's Python worker beside the aligning one.
    return pairs.select("a", "b").join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "wa", "wb").mapInArrow(run, "a binary, b binary")


def signatures(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """(texts, 256) bytes: how many of each text's words fall into each of 256 hash classes, at most 255."""
    text = np.repeat(np.arange(len(counts)), counts)
    return np.minimum(np.bincount(text * 256 + (words >> np.uint64(56)).astype(np.int64), minlength=256 * len(counts)), 255).astype(np.uint8).reshape(-1, 256)


def fine_signatures(words: list[np.ndarray], classes: int = FINE) -> np.ndarray:
    """(texts, classes / 2) bytes: how many of each text's words fall into each of the hash classes, at most 15: first class in the low half."""
    out = np.zeros((len(words), classes // 2), np.uint8)
    for k in range(0, len(words), 200):
        part = words[k : k + 200]
        text = np.repeat(np.arange(len(part)), [len(w) for w in part])
        place = (np.concatenate(part) >> np.uint64(65 - classes.bit_length())).astype(np.int64)
        n = np.minimum(np.bincount(text * classes + place, minlength=classes * len(part)), 15).astype(np.uint8)
        out[k : k + 200] = (n[::2] | (n[1::2] << 4)).reshape(-1, classes // 2)
    return out


def unpacked(fine: np.ndarray) -> np.ndarray:
    """(texts, classes) counts of fine_signatures(), in an order of their own."""
    return np.concatenate([fine & 15, fine >> 4], 1)


def coarse(fine: np.ndarray) -> np.ndarray:
    """(texts, 256) bytes: sums of neighbouring counts of fine_signatures(), which bound edits as they do, more loosely."""
    out = np.zeros((len(fine), 256), np.uint8)
    for k in range(0, len(fine), 2000):
        part = fine[k : k + 2000].reshape(-1, 256, FINE // 512)
        out[k : k + 2000] = (part & 15).sum(2, dtype=np.uint8) + (part >> 4).sum(2, dtype=np.uint8)  # at most 8 * 15
    return out


def least_edits(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A lower bound on the word edits of each pair from signatures and lengths: a replaced word changes two classes by one, a dropped one changes one."""
    return (np.abs(a.astype(np.int16) - b).sum(1, dtype=np.int64) + np.abs(n - m)) // 2


def plausible(pairs: DataFrame, words: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b, and other columns) that their signatures and lengths leave possible; whole texts move only for these."""
    names = pairs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 256) for c in ("ga", "gb"))
            n, m = (batch.column(c).to_numpy() for c in ("na", "nb"))
            ok = least_edits(a, b, n, m) <= np.floor((1 - threshold) * np.maximum(n, m) + 1e-9)
            yield batch.select(names).filter(pa.array(ok))

    of = lambda c: words.select(F.col("k").alias(c), F.col("g").alias(f"g{c}"), F.col("n").alias(f"n{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return both.select(*names, "ga", "gb", "na", "nb").mapInArrow(run, pairs.schema)


def parts_of_links(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
    """(key, the least key of its connected part) of the 16-byte keys that links (a, b) join."""
    found = pa.concat_arrays([a, b]).dictionary_encode()
    keys = np.frombuffer(b"".join(found.dictionary.to_pylist()), ">u8").reshape(-1, 2)
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    x, y = np.split(rank[found.indices.to_numpy()], 2)
    root = np.arange(len(order))
    while (root[x] != root[y]).any():
        u, v = root[x], root[y]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (root[root] != root).any():
            root = root[root]
    return found.dictionary.take(pa.array(order)), found.dictionary.take(pa.array(order[root]))


def components(links: DataFrame) -> DataFrame:
    """(k, root): the least key of each connected part. links: a written table.

    Up to LOCAL_LINKS of them are joined in one task; beyond, by least labels of neighbours and jumps to the label's label.
    """
    if links.count() <= LOCAL_LINKS:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if rows := list(batches):
                out = pa.record_batch(list(parts_of_links(*(pa.concat_arrays([r.column(c) for r in rows]) for c in ("a", "b")))), ["k", "root"])
                yield from (out.slice(at, 100_000) for at in range(0, out.num_rows, 100_000))

        return written(links.select("a", "b").coalesce(1).mapInArrow(run, "k binary, root binary"), "labels")
    both = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "links")
    labels = last = written(both.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("root")), "labels")
    while True:
        seen = both.join(labels, both["v"] == labels["k"]).groupBy("u").agg(F.min("root").alias("near"))
        step = labels.join(seen, labels["k"] == seen["u"]).select("k", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        step = written(step, "labels")
        drop_tables(last)
        jump = step.select(F.col("k").alias("j"), F.col("root").alias("far"))
        last = written(step.join(jump, step["root"] == jump["j"]).select("k", F.least("root", "far").alias("root"), "old"), "labels")
        drop_tables(step)
        labels = last.select("k", "root")
        if last.filter("root != old").isEmpty():
            drop_tables(both)
            return labels


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(k, root) with groups joined by more links: one link for each two groups is kept, and only the groups' roots go through components()."""
    of = lambda c: parts.select(F.col("k").alias(c), F.col("root").alias(f"root_{c}"))
    own = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    own = written(own.filter("a != b").distinct(), "links")
    joined = components(own).select(F.col("k").alias("old"), F.col("root").alias("new"))
    moved = parts.join(joined, parts["root"] == joined["old"], "left").select("k", F.coalesce("new", "root").alias("root"))
    alone = joined.join(parts, joined["old"] == parts["k"], "left_anti").select(F.col("old").alias("k"), F.col("new").alias("root"))
    out = written(moved.unionByName(alone), "labels")
    drop_tables(own)
    return out


def key_filter(wanted: DataFrame, rows: int) -> np.ndarray:
    """A Bloom filter of the keys, (256, bytes): one bitmap for each first byte, at most FILTER_BYTES in all.

    It only saves moving what is surely not wanted; a join decides. With more keys than it can tell apart it lets more through.
    """
    size = int(np.clip(2 ** np.ceil(np.log2(max(rows, 1) / 128)), 64, FILTER_BYTES // 256))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, 16)
            first, places = filter_places(keys, size)
            for f in np.unique(first):
                own = maps.setdefault(int(f), np.zeros(size * 8, bool))
                own[places[first == f].ravel()] = True
        yield pa.record_batch([pa.array(list(maps), pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], pa.binary())], ["f", "m"])

    first = F.conv(F.hex(F.substring("k", 1, 1)), 16, 10).cast("int")
    made = wanted.select("k", first.alias("f")).repartition("f").select("k").mapInArrow(run, "f int, m binary")
    out = np.zeros((256, size * 8), bool)
    for f, m in made.collect():  # at most 256 rows
        out[f] = np.unpackbits(np.frombuffer(m, np.uint8)).astype(bool)
    return np.packbits(out, axis=1)


def filter_places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, three bits in its bitmap) of each key."""
    h = np.ascontiguousarray(keys).view(np.uint64).reshape(-1, 2)
    bits = np.uint64(size * 8)
    return keys[:, 0].astype(np.int64), np.stack([(h[:, 0] >> np.uint64(8)) % bits, h[:, 1] % bits, (h[:, 1] >> np.uint64(24)) % bits], 1).astype(np.int64)


def filter_keys(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as keys of a filter, (hashes, 16) bytes."""
    one = mix(hashes)
    return np.stack([one, mix(one)], 1).view(np.uint8).reshape(-1, 16)


def hash_filter(wanted: DataFrame) -> np.ndarray:
    """key_filter() of 64-bit hashes; wanted: (s), a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = filter_keys(batch.column(0).to_numpy().view(np.uint64))
            yield pa.record_batch([pa.array([k.tobytes() for k in keys], pa.binary())], ["k"])

    return key_filter(wanted.mapInArrow(run, "k binary"), wanted.count())


def passes(keys: list[bytes] | np.ndarray, table: np.ndarray) -> np.ndarray:
    """Whether each of the keys, as bytes or (keys, 16) bytes, may be in the filter."""
    if not len(keys):
        return np.zeros(0, bool)
    if isinstance(keys, list):
        keys = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)
    first, places = filter_places(keys, table.shape[1])
    return ((table[first[:, None], places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1).all(1)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY, count: int = SKETCHES, least: int = SKETCH_LEAST, k: int = SKETCH_K) -> DataFrame:
    """One row per input row: id_col, group_id, group_size, kept, class_size, _row, _sha.

    group_id: the least id of the rows that are near-duplicates, directly or by way of others (null only if all their
    ids are). kept: true for one row of each group, that of least id (a null id last; of equal ids one of them).
    Texts without words (null, empty, white space) are one class and join no other. An empty table gives an empty result.
    A threshold below 0.7 is an error: similar texts needn't have a pair of words in common then.
    """
    if threshold < 0.7:
        raise ValueError("near_groups() takes thresholds of 0.7 or more")
    full = sketched(docs, id_col, text_col, count, least, k)
    classes = written(full.groupBy("_key").agg(F.first("_sketches").alias("_sketches")), "classes")
    rows = written(full.drop("_sketches"), "rows")
    drop_tables(full)
    found, buckets = candidates(classes)
    drop_tables(classes)
    wanted = written(found.select(F.explode(F.array("a", "b")).alias("k")).distinct(), "wanted")

    sent = docs.sparkSession.sparkContext.broadcast(key_filter(wanted, wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # a task sends a class once, however many copies it reads
        for batch in batches:
            texts = text_column(batch.column(0))
            for a, b in text_slices(texts, 3_000_000):
                words, counts = words_of(texts.slice(a, b - a))
                keys, ends = class_keys(words, counts), np.cumsum(counts)
                on = []
                for i in np.flatnonzero(passes(keys, sent.value)).tolist():
                    if keys[i] not in seen:
                        seen.add(keys[i])
                        on.append(i)
                for at in range(0, len(on), 2000):
                    part = np.array(on[at : at + 2000])
                    own = [words[ends[i] - counts[i] : ends[i]] for i in part.tolist()]
                    sums = signatures(np.concatenate(own), counts[part])
                    yield pa.record_batch([pa.array([keys[i] for i in part.tolist()], pa.binary()), pa.array([w.tobytes() for w in own], pa.binary()), pa.array([g.tobytes() for g in sums], pa.binary())], ["k", "w", "g"])

    text = docs.select(F.col(text_col).cast("string").alias("t"))
    words = text.mapInArrow(run, "k binary, w binary, g binary").groupBy("k").agg(F.first(F.struct("w", "g")).alias("x"))
    words = words.join(wanted, "k", "left_semi").select("k", "x.w", "x.g", F.expr("octet_length(x.w) DIV 8").alias("n"))
    words = written(words, "words")
    drop_tables(wanted)
    best = Window.partitionBy("a").orderBy(F.desc("n"), "b")
    ranked = found.withColumn("rank", F.row_number().over(best))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that are links, as a table."""
        left = written(plausible(pairs, words, threshold), "plausible")
        out = written(verified(left, words, threshold), "links")
        drop_tables(left)
        return out

    parts = components(confirmed(ranked.filter("rank = 1").select("a", "b")))
    of = lambda c: parts.select(F.col("k").alias(c), F.col("root").alias(f"root_{c}"))
    others = ranked.filter("rank > 1").join(of("a"), "a", "left").join(of("b"), "b", "left")
    others = others.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    more = confirmed(others.select("a", "b"))
    parts = merged(parts, more) if not more.isEmpty() else parts
    tried = found.select("a", "b")
    for turn in range(TURNS):
        some = written(neighbours(buckets, parts, turn).join(tried, ["a", "b"], "left_anti"), "neighbours")
        if some.isEmpty():
            continue
        more = confirmed(some)
        tried = tried.unionByName(some)
        linked = more.count()
        parts = merged(parts, more) if linked else parts
        if linked * FEW < some.count():
            break
    opened = open_classes(buckets, parts)
    if not opened.isEmpty():
        rest = written(open_pairs(opened, words, threshold).join(tried, ["a", "b"], "left_anti"), "rest")
        more = written(verified(rest, words, threshold), "links")
        parts = merged(parts, more) if not more.isEmpty() else parts
    drop_tables(words, found)

    sizes = rows.groupBy("_key").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("least"), F.count(F.lit(1)).alias("class_size"))
    sizes = sizes.join(parts, sizes["_key"] == parts["k"], "left").withColumn("root", F.coalesce("root", "_key"))
    sizes = written(sizes.filter("class_size > 1 OR k IS NOT NULL").select("_key", "root", "least", "class_size"), "classes")
    groups = written(sizes.groupBy("root").agg(F.min("least").alias("first"), F.sum("class_size").alias("group_size")), "groups")
    total = rows.count()
    large = F.broadcast(groups.filter(F.col("group_size") > total * HOT_SHARE))  # at most 1 / HOT_SHARE rows, as below
    own = sizes.select("_key", "root", "class_size")
    others = own.join(large.select("root"), "root", "left_anti").join(groups.filter(F.col("group_size") <= total * HOT_SHARE), "root")
    sizes = written(own.join(large, "root").unionByName(others), "classes")
    hot = F.broadcast(sizes.filter(F.col("class_size") > total * HOT_SHARE))
    base = rows.select("_id", "_row", "_sha", "_key")
    joined = base.join(hot, "_key").unionByName(base.join(hot.select("_key"), "_key", "left_anti").join(sizes.filter(F.col("class_size") <= total * HOT_SHARE), "_key", "left"))
    alone = F.col("first").isNull()
    return joined.select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("first._id")).alias("group_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("first._row") == F.col("_row"))).alias("kept"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        "_row",
        "_sha",
    )


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY) -> DataFrame:
    """One row of each group of near-duplicates, all columns as they are."""
    kept = near_groups(docs, id_col, text_col, threshold).filter("kept")
    return kept_rows(docs, kept.select(F.col(id_col).alias("_kept_id"), F.lower(F.hex("_sha")).alias("_kept_sha")), id_col, text_col)
