"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words are compiled, with their ids as output, into an automaton whose equal suffixes are
shared. Its arrays are one file that workers memory-map and walk for many words at a time. Words
outside it are merged exactly, also many at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded, coded_words, map_batches, mounted, put_file, ragged, shared_path, ship, text_column, text_slices, written, WordCodes
from .word_ids import PieceIds, Pieces, TextIds, byte_letters, specials_of

#: Words in the lexicon; the file has a bounded size whatever the corpus.
LEXICON_WORDS = 50_000
NO_RANK = np.int64(1 << 40)


class Merges:
    """Exact merging, as the vocabulary's ranked merges say: the pair of lowest rank first, the leftmost of equals."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        letters = byte_letters()
        self.first = np.array([vocab[chr(letters[b])] for b in range(256)], np.int64)
        self.last = np.array([vocab[chr(letters[b]) + end] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.into = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.pairs = {int(k): r for r, k in enumerate(keys)}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def one(self, word: bytes) -> list[int]:
        """A long word, by a heap over a linked list."""
        ids = [*self.first[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        n = len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.into[r]), -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (q := self.pairs.get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(heap, (q, x, ids[x], ids[y]))
        return [x for x in ids if x >= 0]

    def same_length(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids padded, number of ids) of words of one length. Rows still at work have all been merged equally often, so they stay one rectangle."""
        n, width = len(words), len(words[0])
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(n, width)
        ids = self.first[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        out, count, rows = np.zeros((n, width), np.int64), np.zeros(n, np.int64), np.arange(n)
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while True:
            best = ranks.min(1) if ids.shape[1] > 1 else np.full(len(rows), NO_RANK)
            done = best == NO_RANK
            if done.any():
                out[rows[done], : ids.shape[1]] = ids[done]
                count[rows[done]] = ids.shape[1]
                rows, ids, ranks, best = rows[~done], ids[~done], ranks[~done], best[~done]
            if not len(rows):
                return out, count
            at, each = ranks.argmin(1), np.arange(len(rows))
            ids[each, at] = self.into[best]
            cols = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            cols = cols[:-1]
            ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            if len(cols):
                after = np.minimum(at, len(cols) - 1)
                ok = at < len(cols)
                ranks[each[ok], after[ok]] = self.rank(ids[each[ok], after[ok]], ids[each[ok], after[ok] + 1])
                ok = at > 0
                ranks[each[ok], at[ok] - 1] = self.rank(ids[each[ok], at[ok] - 1], ids[each[ok], at[ok]])

    def __call__(self, words: list[bytes], block: int = 20_000, long: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, number of each word's ids)."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        lens = np.zeros(len(words), np.int64)
        order = np.argsort(size, kind="stable")
        rows, found = [], []
        for length in np.unique(size):
            own = order[np.searchsorted(size[order], length) : np.searchsorted(size[order], length, "right")]
            if length > long or length == 0:
                for i in own:
                    ids = np.array(self.one(words[i]) if length else [], np.uint32)
                    lens[i] = len(ids)
                    rows.append(np.array([i]))
                    found.append(ids)
                continue
            for k in range(0, len(own), block):
                part = own[k : k + block]
                ids, count = self.same_length([words[i] for i in part])
                lens[part] = count
                rows.append(part)
                found.append(ids[np.arange(ids.shape[1]) < count[:, None]].astype(np.uint32))
        flat, starts = np.zeros(int(lens.sum()), np.uint32), np.cumsum(lens) - lens
        for part, ids in zip(rows, found, strict=True):
            flat[ragged(starts[part], lens[part])] = ids
        return flat, lens


def compile_lexicon(words: list[bytes], flat: np.ndarray, lens: np.ndarray) -> bytes:
    """The minimal acyclic transducer of distinct words with their ids, as one file.

    Words are added in sorted order. Ids are pushed towards the start as far as words with a common
    prefix agree; a state that no later word can change is replaced by an equal one if there is one.
    """
    starts = np.cumsum(lens) - lens
    order = sorted(range(len(words)), key=words.__getitem__)
    states: list[tuple[bool, tuple, list]] = []  # (final, final output, [(byte, target, output)])
    known: dict[tuple, int] = {}
    # The states along the last word, open: [final, final output, arcs]; the last arc's target is the next open state.
    path: list[list] = [[False, (), []]]

    def close(down: int) -> None:
        while len(path) > down + 1:
            final, tail, arcs = path.pop()
            key = (final, tail, tuple(arcs))
            at = known.get(key)
            if at is None:
                at = known[key] = len(states)
                states.append((final, tail, arcs))
            byte, _, output = path[-1][2][-1]
            path[-1][2][-1] = (byte, at, output)

    before = b""
    for i in order:
        word, out = words[i], tuple(flat[starts[i] : starts[i] + lens[i]].tolist())
        if i != order[0] and word == before:
            continue
        same = 0
        while same < min(len(word), len(before)) and word[same] == before[same]:
            same += 1
        close(same)
        for k in range(same):  # what both words put out stays on the common arcs; the rest moves down
            byte, target, have = path[k][2][-1]
            n = 0
            while n < min(len(have), len(out)) and have[n] == out[n]:
                n += 1
            rest = have[n:]
            if rest:
                path[k][2][-1] = (byte, target, have[:n])
                below = path[k + 1]
                below[2][:] = [(b, t, rest + o) for b, t, o in below[2]]
                if below[0]:
                    below[1] = rest + below[1]
            out = out[n:]
        for k in range(same, len(word)):
            path[k][2].append((word[k], -1, out))
            path.append([False, (), []])
            out = ()
        path[-1][0], path[-1][1] = True, out
        before = word
    close(0)
    root = len(states)
    states.append(tuple(path[0]))
    pool: dict[tuple, int] = {(): 0}
    ids: list[int] = []

    def put(output: tuple) -> int:
        if output not in pool:
            pool[output] = len(ids)
            ids.extend(output)
        return pool[output]

    arcs = sorted((s << 8 | b, t, put(o), len(o)) for s, (_, _, own) in enumerate(states) for b, t, o in own)
    a = np.array(arcs, np.int64).reshape(-1, 4)
    ends = np.array([(f, put(o), len(o)) for f, o, _ in states], np.int64).reshape(-1, 3)
    head = np.array([root, len(arcs), len(states), len(ids)], np.int64)
    return b"".join(x.astype(np.int64).tobytes() for x in (head, a[:, 0], a[:, 1], a[:, 2], a[:, 3], ends[:, 0], ends[:, 1], ends[:, 2])) + np.array(ids, np.uint32).tobytes()


class Lexicon:
    """A compiled transducer, memory-mapped."""

    def __init__(self, path: str):
        data = np.memmap(path, np.uint8, "r")
        head = data[:32].view(np.int64)
        self.root, n_arcs, n_states, n_ids = map(int, head)
        at, got = 32, []
        for n in (n_arcs,) * 4 + (n_states,) * 3:
            got.append(data[at : at + 8 * n].view(np.int64))
            at += 8 * n
        self.key, self.target, self.out, self.out_len, self.final, self.end, self.end_len = got
        self.ids = data[at : at + 4 * n_ids].view(np.uint32)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, ids of the found words one after another, number of each word's ids, 0 if not found)."""
        n, size = len(words), np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        rows = np.flatnonzero((size > 0) & (size <= 255)) if len(self.key) else np.zeros(0, np.int64)
        state, found = np.full(n, self.root), np.zeros(n, bool)
        steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # (rows, start and length of output)
        k = 0
        while len(rows):
            key = state[rows] << 8 | raw[start[rows] + k]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = self.key[at] == key
            rows, at = rows[ok], at[ok]
            state[rows] = self.target[at]
            steps.append((rows, self.out[at], self.out_len[at]))
            k += 1
            over = size[rows] == k
            last = rows[over]
            last = last[self.final[state[last]] == 1]
            found[last] = True
            steps.append((last, self.end[state[last]], self.end_len[state[last]]))
            rows = rows[~over]
        lens = np.zeros(n, np.int64)
        for r, _, m in steps:
            lens[r] += m
        lens[~found] = 0
        flat, at = np.zeros(int(lens.sum()), np.uint32), np.cumsum(lens) - lens
        for r, o, m in steps:
            ok = found[r] & (m > 0)
            r, o, m = r[ok], o[ok], m[ok]
            flat[ragged(at[r], m)] = self.ids[ragged(o, m)]
            at[r] += m
        return found, flat, lens


def lexicon_pieces(merges: Merges, lexicon: Lexicon | None):
    """encode_pieces by the lexicon, and by exact merging where it has no such word."""

    def encode_pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces = [p.encode() for p in texts]
        if lexicon is None:
            return merges(pieces)
        found, flat, lens = lexicon(pieces)
        rest = np.flatnonzero(~found)
        if not len(rest):
            return flat, lens
        more, more_lens = merges([pieces[i] for i in rest])
        all_lens = lens.copy()
        all_lens[rest] = more_lens
        whole, starts = np.zeros(int(all_lens.sum()), np.uint32), np.cumsum(all_lens) - all_lens
        known = np.flatnonzero(found)
        whole[ragged(starts[known], lens[known])] = flat
        whole[ragged(starts[rest], more_lens)] = more
        return whole, all_lens

    return encode_pieces


def word_counts(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(word, count): how often the tokenizer's words occur in all texts. Each task adds up its own before any row moves."""

    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, text_ids = Pieces(tokenizer), TextIds(None, specials_of(tokenizer))
        codes, total = WordCodes(), np.zeros(0, np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            for k in range(0, len(codes.words), 50_000):
                yield pa.record_batch([pa.array(codes.words[k : k + 50_000], pa.string()), pa.array(total[k : k + 50_000])], ["word", "n"])

        for batch in batches:
            column = text_column(batch.column(0))
            for a, b in text_slices(column):
                words, _, distinct = coded_words(text_ids.without_specials(column.slice(a, b - a))[0])
                times = np.bincount(words, minlength=len(distinct))
                at, found = coded(pieces(distinct))
                runs = np.diff(np.flatnonzero(at == found.index("\n")), prepend=-1) if found else np.zeros(0, np.int64)
                n = np.bincount(at, np.repeat(times, runs), len(found)).astype(np.int64)
                where = np.fromiter(map(codes.__getitem__, found), np.int64, len(found))
                total = np.concatenate([total, np.zeros(len(codes.words) - len(total), np.int64)])
                total[where] += n
                if "\n" in codes:
                    total[codes["\n"]] = 0
                if codes.over():
                    yield from flush()
                    codes.reset()
                    total = np.zeros(0, np.int64)
        yield from flush()

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(count, "word string, n long").filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> list[bytes]:
    """The most frequent words of all texts: at most `most`, all that occur at least as often as some bound.

    The bound comes from a histogram of counts by powers of 2 ** (1/16), so that no task sends more to the
    driver than the words that are taken. If even the most frequent words are too many, those first in order are taken.
    """
    counts = written(word_counts(docs, tokenizer, text_col).withColumn("p", F.floor(F.log2("n") * 16).cast("int")), "words")
    total, bound = 0, None
    sizes = sorted(((r.p, r["count"]) for r in counts.groupBy("p").count().collect()), reverse=True)  # some hundred rows
    for p, n in sizes:
        if total + n > most:
            break
        total, bound = total + n, p
    taken = counts.filter(F.col("p") >= bound) if bound is not None else counts.filter(F.col("p") == sizes[0][0]).orderBy("word").limit(most) if sizes else counts
    return [r.word.encode() for r in taken.select("word").collect()]


def build_lexicon(docs: DataFrame, tokenizer: str, text_col: str = "text", most: int = LEXICON_WORDS) -> str:
    """Count the words, compile the frequent ones; the path of the file in the shared folder."""
    words = frequent_words(docs, tokenizer, text_col, most)
    path = f"{mounted(shared_path(docs.sparkSession, 'lexicon'))}/words.fst"
    put_file(path, compile_lexicon(words, *Merges(tokenizer)(words)))
    return path


@functools.lru_cache(maxsize=2)
def encoder(tokenizer: str, lexicon: str | None) -> TextIds:
    """A worker process keeps the last two."""
    return TextIds(PieceIds(Pieces(tokenizer), lexicon_pieces(Merges(tokenizer), Lexicon(lexicon) if lexicon else None)), specials_of(tokenizer))


def token_strings(tokenizer: str) -> list[str | None]:
    """id -> token."""
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    by_id = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [by_id.get(i) for i in range(max(by_id) + 1)]


def decode_ids(ids: list[int], strings: list[str | None]) -> str:
    """As the tokenizers library decodes without a decoder: tokens with spaces between; an unknown id gives nothing."""
    n = len(strings)
    return " ".join([s for i in ids if 0 <= i < n and (s := strings[i]) is not None])


def encode(docs: DataFrame, tokenizer: str, lexicon: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col array<int>. Null counts as empty and gives an empty list; an older column ids_col is replaced."""
    ship(docs.sparkSession)
    docs = docs.drop(ids_col)
    fields = docs.schema
    at = fields.fieldNames().index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, lexicon)
        for batch in batches:
            texts = text_column(batch.column(at))
            for a, b in text_slices(texts):
                flat, n = enc.encode(texts.slice(a, b - a))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], [*batch.schema.names, ids_col])

    return map_batches(docs, run, _with(fields, ids_col, "array<int>"))


def decode(df: DataFrame, tokenizer: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """df with text_col: the text of its ids; null ids count as none."""
    ship(df.sparkSession)
    df = df.drop(text_col)
    fields = df.schema
    at = fields.fieldNames().index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = token_strings(tokenizer)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [decode_ids(ids or [], strings) for ids in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*batch.schema.names, text_col])

    return map_batches(df, run, _with(fields, text_col, "string"))


def _with(fields, name: str, kind: str):
    from pyspark.sql.types import StructType

    return StructType([*fields.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])


def round_trip_digests(docs: DataFrame, tokenizer: str, lexicon: str | None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Each text encoded, and its ids decoded: id_col, n_tokens, ids_sha256, decoded_sha256, and ids if asked for; else they don't leave the task."""
    ship(docs.sparkSession)
    names, schema = ["i", "n", "s", "d"] + ["ids"] * with_ids, "n long, s string, d string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, strings = encoder(tokenizer, lexicon), token_strings(tokenizer)
        for batch in batches:
            texts = text_column(batch.column(1))
            for a, b in text_slices(texts):
                flat, n = enc.encode(texts.slice(a, b - a))
                ends = np.cumsum(n)
                rows = [flat[e - m : e] for e, m in zip(ends, n, strict=True)]
                ids = [hashlib.sha256(r.astype("<u4").tobytes()).hexdigest() for r in rows]
                decoded = [hashlib.sha256(decode_ids(r.tolist(), strings).encode()).hexdigest() for r in rows]
                out = [batch.column(0).slice(a, b - a), pa.array(n), pa.array(ids), pa.array(decoded)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat.view(np.int32))))
                yield pa.record_batch(out, names)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, {schema}")
    return out.withColumnsRenamed({"i": id_col, "n": "n_tokens", "s": "ids_sha256", "d": "decoded_sha256"})
