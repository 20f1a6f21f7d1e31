import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from .docs import ODD, table

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from netloom.llm import bpe, length_histogram, token_files, word_ids  # noqa: E402
from netloom.llm.common import shared_path  # noqa: E402

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TOK = Tokenizer.from_file(PATH)


def library(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def split(flat, n):
    return [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]


@pytest.fixture(scope="module")
def lexicon_file(tmp_path_factory):
    words = [b"the", b"same", b"text", b".", b"tests", b"test", b"testing", b"word", b"words", "été".encode()]
    path = tmp_path_factory.mktemp("lexicon") / "x.fst"
    path.write_bytes(bpe.compile_lexicon(words, *bpe.Merges(PATH)(words)))
    return str(path)


def test_ids_equal_the_library(lexicon_file):
    texts = [t or "" for _, t in ODD]
    texts += ["".join(map(chr, range(k, k + 64))) for k in range(0, 0x3100, 64)] + [" ".join(map(chr, range(k, k + 64))) for k in range(0, 0x3100, 64)]
    want = [library(t) for t in texts]
    for ids in (word_ids.library_ids(PATH), bpe.encoder(PATH, lexicon_file), bpe.encoder(PATH, None)):
        assert split(*ids.encode(pa.array(texts))) == want
        assert split(*ids.encode(pa.array(texts))) == want  # from its tables
    strings = bpe.token_strings(PATH)
    assert [bpe.decode_ids(w, strings) for w in want] == [TOK.decode(w, skip_special_tokens=False) for w in want]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert split(*bpe.encoder(PATH, None).encode(pa.array(texts))) == [library(t) for t in texts]


def test_lexicon_is_minimal_and_exact(tmp_path):
    words = sorted({a + b for a in (b"un", b"re", b"") for b in (b"doing", b"going", b"ing", b"do")})
    flat, lens = bpe.Merges(PATH)(words)
    path = tmp_path / "w.fst"
    path.write_bytes(bpe.compile_lexicon(words, flat, lens))
    lexicon = bpe.Lexicon(str(path))
    found, f, n = lexicon([*words, b"", b"d", b"undoingx", b"x"])
    assert found.tolist() == [True] * len(words) + [False] * 4
    assert n[: len(words)].tolist() == lens.tolist() and f.tolist() == flat.tolist()
    # no two states have the same arcs, targets and outputs
    states = {}
    for s in range(len(lexicon.final)):
        at = (lexicon.key >> 8) == s
        key = tuple(map(tuple, (lexicon.key[at] & 255, lexicon.target[at], lexicon.out[at], lexicon.out_len[at]))) + (lexicon.final[s], lexicon.end[s], lexicon.end_len[s])
        assert key not in states
        states[key] = s
    empty = tmp_path / "e.fst"
    empty.write_bytes(bpe.compile_lexicon([], np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    assert not bpe.Lexicon(str(empty))([b"a"])[0].any()


def test_frequent_words_and_round_trip(spark):
    docs = table(spark)
    counts = {r.word: r.n for r in bpe.word_counts(docs, PATH).collect()}
    assert counts["word"] == 30_000 and counts["same"] == 80 and "\n" not in counts
    path = bpe.build_lexicon(docs, PATH, most=5)
    rows = sorted(map(tuple, bpe.round_trip_digests(docs, PATH, path).collect()), key=str)
    want = []
    for i, t in ODD:
        ids = library(t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == sorted(want, key=str)
    out = bpe.decode(bpe.encode(docs, PATH, path), PATH).select("text", "ids", "decoded", "lang").collect()
    assert all(r.ids == library(r.text) and r.decoded == TOK.decode(r.ids, skip_special_tokens=False) for r in out)
    assert bpe.round_trip_digests(docs.limit(0), PATH, None).count() == 0


def test_token_files(spark):
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark), path, PATH, files=3)
    tokens = token_files.read_tokens(spark, path)
    rows = token_files.token_digests(tokens).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, *range(1, 13), 12]
    texts = dict(ODD)
    at = 0
    for r in rows:
        ids = [*library(texts[r.doc_id]), 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    one = token_files.read_tokens(spark, path, F.col("doc_id") == 8)
    plan = one._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,8)]" in plan and one.count() == 1
    meta = token_files.read_tokens(spark, path, columns=["doc_id", "n_tokens"])
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in meta._jdf.queryExecution().toString()
    empty = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark).limit(0), empty, PATH)
    assert token_files.token_digests(token_files.read_tokens(spark, empty)).count() == 0


def test_token_file_layout(spark, tmp_path):
    import pyarrow.parquet as pq

    token_files.write_tokens(table(spark), f"file://{tmp_path}/t", PATH, files=1)
    meta = pq.ParquetFile(next((tmp_path / "t").glob("part-*.parquet"))).metadata.row_group(0)
    kinds = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in kinds["ids.list.element"].encodings)
    assert "DELTA_BINARY_PACKED" in kinds["n_tokens"].encodings and kinds["doc_id"].has_column_index


def test_length_histogram(spark):
    docs = table(spark)
    hist = length_histogram.length_histogram(docs, PATH)
    lengths = sorted(len(library(t)) for _, t in ODD)
    limits = length_histogram.with_limits(hist)
    rows = {r.length: r for r in limits.collect()}
    assert sorted(rows) == sorted(set(lengths))
    for x, r in rows.items():
        longer = [y for y in lengths if y >= x]
        assert (r.n_docs, r.docs_from, r.tokens_from, r.total_tokens) == (lengths.count(x), len(longer), sum(longer), sum(lengths))
        assert r.truncated_total == sum(min(x, y) for y in lengths) and r.share == pytest.approx(sum(y <= x for y in lengths) / len(lengths))
    asked = [0, 1, 7, 1000, 10**9]
    assert {r.context: r.total for r in length_histogram.truncated_totals(limits, asked).collect()} == {c: sum(min(c, y) for y in lengths) for c in asked}
    assert {r.share: r.length for r in length_histogram.quantiles(limits, [0.5, 1.0]).collect()} == {0.5: lengths[(len(lengths) + 1) // 2 - 1], 1.0: lengths[-1]}
    assert length_histogram.with_limits(length_histogram.length_histogram(docs.limit(0), PATH)).count() == 0
