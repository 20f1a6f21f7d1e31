"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) for the terms of a text: besides its
own weight each term has a vector, so that pairs of terms count that are harmless one by one. It is
fitted on a bounded sample of labelled rows; the bound is a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import coded, coded_words, joined, map_batches, ragged, run_sums, ship, text_column, text_slices, word_hashes, written
from .order_minhash import kmers, words_of

BITS = 20
#: Labelled rows that a fit may take.
MOST_ROWS = 20_000
#: Hashed terms that have weights: those that tell the labels apart best in the sample.
MOST_TERMS = 2048
FACTORS = 8
WORD = re.compile(r"[^\W_]+|\n")
PREFIXES = (4, 5, 6)


def term_buckets(column: pa.Array, lookup: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashed terms of each text in turn, how many each has). lookup: bucket -> number, -1 to leave out.

    The terms of a word are itself and its first letters, which inflected forms share.
    """
    codes, counts, distinct = coded_words(pc.utf8_lower(column))
    at, found = coded(WORD.findall(joined(distinct)) + ["\n"] if len(distinct) else [])
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(column), np.int64)
    line = found.index("\n")
    ends = np.flatnonzero(at == line)
    forms = [found, *([f"{w[:k]}-" for w in found] for k in PREFIXES)]
    bucket = np.stack([(word_hashes(f) >> np.uint64(64 - BITS)).astype(np.int64) for f in forms], 1)
    size = np.fromiter(map(len, found), np.int64, len(found))
    number = lookup[bucket] if lookup is not None else bucket
    number[:, 1:][size[:, None] < np.array(PREFIXES)] = -1
    number[line] = -1
    piece = number[at].ravel()
    kept = np.flatnonzero(piece >= 0)
    word = np.searchsorted(ends, kept // len(forms))  # the word that each kept term is of
    runs = np.bincount(word, minlength=len(ends))
    starts = np.cumsum(runs) - runs
    terms = piece[kept][ragged(starts[codes], runs[codes])]
    doc = np.repeat(np.arange(len(counts)), run_sums(runs[codes], counts))
    size = max(int(number.max()) + 1, 1)
    pairs = np.unique(doc * size + terms)
    return pairs % size, np.bincount(pairs // size, minlength=len(counts))


@dataclass
class Model:
    terms: np.ndarray  # buckets that have weights
    w0: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        linear = run_sums(self.w[terms], counts)
        both = np.zeros(len(counts))
        for f in range(self.v.shape[1]):
            x = self.v[terms, f]
            both += run_sums(x, counts) ** 2 - run_sums(x * x, counts)
        return 1 / (1 + np.exp(-np.clip(self.w0 + linear + both / 2, -50, 50)))


def constant(positive: int, n: int, factors: int = FACTORS) -> Model:
    """The model for rows of one label, or none: the same score for all."""
    share = (positive + 0.5) / (n + 2)
    return Model(np.zeros(0, np.int64), float(np.log(share / (1 - share))), np.zeros(0), np.zeros((0, factors)))


def fit_machine(chosen: np.ndarray, col: np.ndarray, counts: np.ndarray, labels: np.ndarray, factors: int = FACTORS, steps: int = 600, pair_steps: int = 200, l2: float = 3e-4, l2_pairs: float = 3e-3, rate: float = 0.05, seed: int = 7) -> Model:
    """Adam over all rows at once: first the terms' own weights, then these and the pairs together.

    A term that tells by itself so gets its weight before pairs can take it over, and a text with one such term is known too;
    for the same reason w0 stays at the labels' own odds rather than learn that most texts have none.
    chosen: buckets with weights; col, counts: each row's distinct terms as places in chosen.
    """
    n, m = len(labels), len(chosen)
    rate_all = labels.mean()
    row = np.repeat(np.arange(n), counts)
    by_col = np.argsort(col, kind="stable")
    row_of, col_of = row[by_col], col[by_col]
    rng = np.random.default_rng(seed)
    w0, w, v = float(np.log(rate_all / (1 - rate_all))), np.zeros(m), rng.normal(0, 0.01, (m, factors))
    weight = np.where(labels == 1, 0.5 / rate_all, 0.5 / (1 - rate_all)) ** 0.5  # part of the way to balance
    weight /= weight.mean()
    per_col = np.bincount(col_of, minlength=m)
    state = [np.zeros(1), np.zeros(m), np.zeros((m, factors))], [np.zeros(1), np.zeros(m), np.zeros((m, factors))]
    for t in range(1, steps + pair_steps + 1):
        pairs = t > steps
        z = w0 + run_sums(w[col], counts)
        if pairs:
            sums = np.stack([run_sums(v[col, f], counts) for f in range(factors)], 1)
            squares = sum(run_sums(v[col, f] ** 2, counts) for f in range(factors))
            z = z + ((sums**2).sum(1) - squares) / 2
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / n
        e = err[row_of]
        gw = run_sums(e, per_col)
        grads = [None, gw + l2 * w]
        if pairs:
            grads.append(np.stack([run_sums(e * sums[row_of, f], per_col) for f in range(factors)], 1) - gw[:, None] * v + l2_pairs * v)
        for k, g in enumerate(grads[1:], 1):
            a, b = state[0][k], state[1][k]
            u = t if k < 2 else t - steps
            a += 0.1 * (g - a)
            b += 0.05 * (g * g - b)
            step = rate * (a / (1 - 0.9**u)) / (np.sqrt(b / (1 - 0.95**u)) + 1e-7)
            if k == 1:
                w = w - step
            else:
                v = v - step
    return Model(chosen, w0, w, v)


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, where: Column | None = None, most_rows: int = MOST_ROWS, most_terms: int = MOST_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on at most most_rows labelled rows (those of least hash), whole texts.

    where: which ids may be learned from. Labels that are null are left out; of several for one id the greatest counts.
    Documents with equal ids each count. Without labelled documents, or with one label only, the score is a constant.
    """
    given = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if where is not None:
        given = given.filter(where)
    picked = given.groupBy(F.col(id_col).alias("_i")).agg(F.max(label_col).cast("int").alias("_y")).orderBy(F.xxhash64("_i"), "_i").limit(most_rows)

    def with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_column(batch.column(2))
            for a, b in text_slices(texts, 2_000_000):
                terms, counts = term_buckets(texts.slice(a, b - a))
                yield pa.record_batch([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(family(texts.slice(a, b - a))), as_lists(terms, counts)], ["h", "y", "f", "terms"])

    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).cast("string").alias("_t")).join(F.broadcast(picked), "_i")
    rows = rows.select(F.xxhash64("_i", "_t").alias("h"), F.col("_y").alias("y"), F.col("_t").alias("t"))
    # Copies, also slightly changed ones, share words for no reason of their own: one of each family is learned from.
    found = rows.mapInArrow(with_terms, "h long, y int, f long, terms array<int>")
    sample = written(found.groupBy("f", "y").agg(F.min_by(F.struct("h", "terms"), "h").alias("x")).select("x.h", "y", "x.terms"), "sample")
    n = sample.count()
    if n > most_rows:  # ids that many documents share
        last = sample.select("h").orderBy("h").limit(most_rows).agg(F.max("h")).first()[0]
        sample = sample.filter(F.col("h") <= last)
    n, positive = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not 0 < positive < n:
        return constant(positive, n)
    # Terms that tell the labels apart: by chance as many documents would so agree for less than a tenth of a term
    # (a bound on the binomial tail). Counted in Spark, so that the driver sees those that are taken alone.
    share = positive / n
    counted = sample.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("y").alias("pos")).filter("df >= 3")
    counted = written(counted, "terms")
    part = lambda k, of: F.when(k > 0, k * F.log(k / (F.col("df") * of))).otherwise(0.0)
    sure = part(F.col("pos"), share) + part(F.col("df") - F.col("pos"), 1 - share)
    taken = counted.filter(sure >= float(np.log(10 * max(counted.count(), 1)))).orderBy(F.desc(sure), "term").limit(most_terms)
    chosen = np.sort(np.array([r.term for r in taken.select("term").collect()], np.int64))
    if not len(chosen):
        return constant(positive, n)

    def only_chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(chosen)
        for batch in batches:
            lists = batch.column(2)
            found = lookup[lists.flatten().to_numpy()]
            own = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), as_lists(found[found >= 0], run_sums((found >= 0).astype(np.int64), own))], ["h", "y", "terms"])

    got = sample.mapInArrow(only_chosen, "h long, y int, terms array<int>").orderBy("h").limit(most_rows).toArrow()  # at most most_rows * most_terms numbers
    lists = got.column("terms").combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    return fit_machine(chosen, lists.flatten().to_numpy().astype(np.int64), counts, got.column("y").to_numpy().astype(float))


def family(column: pa.Array) -> np.ndarray:
    """The least hash among the five-word runs of each text, which most near copies share and other texts don't; 0 without words."""
    words, counts = words_of(column)
    grams, n = kmers(words, counts)
    out = np.zeros(len(counts), np.int64)
    if len(grams):
        out[n > 0] = np.minimum.reduceat(grams, (np.cumsum(n) - n)[n > 0]).view(np.int64)
    return out


def as_lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values.astype(np.int32)))


def lookup_of(terms: np.ndarray) -> np.ndarray:
    """bucket -> place among the terms that have weights, or -1."""
    table = np.full(1 << BITS, -1, np.int64)
    table[terms] = np.arange(len(terms))
    return table


def score(docs: DataFrame, model: Model, text_col: str = "text", only_clean: bool = False) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); older columns of these names are replaced.

    Null counts as empty; an empty text gets the score of no terms. only_clean: the rows with predicted 0 alone,
    with the columns of docs.
    """
    ship(docs.sparkSession)
    new = ["score", "predicted"]
    base = docs if only_clean else docs.drop(*new)
    at = base.columns.index(text_col)
    schema = base.schema if only_clean else StructType([*base.schema.fields, *StructType.fromDDL("score double, predicted int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = lookup_of(model.terms)
        for batch in batches:
            texts = text_column(batch.column(at))
            for a, b in text_slices(texts):
                s = model.scores(*term_buckets(texts.slice(a, b - a), lookup))
                part = batch.slice(a, b - a)
                if only_clean:
                    yield part.filter(pa.array(s < 0.5))
                else:
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*part.schema.names, *new])

    return map_batches(base, run, schema)
