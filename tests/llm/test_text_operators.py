import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import chat, chunk_dedup, decontaminate, kneser_ney, order_minhash, personal_data, toxicity

from .docs import ODD, table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Exact deduplication -----------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 4])
def test_exact_groups(spark, bits):
    rng = random.Random(1)
    long = ["".join(rng.choice("ab .\n") for _ in range(rng.randint(0, 3000))) for _ in range(12)]
    rows = ODD + [(100 + k, long[k % 12]) for k in range(40)] + [(200, "😀" * 5000), (201, "😀" * 5000), (202, "😀" * 4999)]
    got = chunk_dedup.exact_groups(table(spark, rows), bits=bits).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    assert len(got) == len(rows)
    for r in got:
        (text,) = texts[r.doc_id]
        ids = groups[text]
        assert (r.keep_id, r.group_size) == (max((i for i in ids if i is not None), default=None), len(ids))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)  # one of each, of the repeated row too
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = chunk_dedup.drop_exact(table(spark, rows))
    assert kept.columns == table(spark, rows).columns and sorted((t or "") for t, in kept.select("text").collect()) == sorted(groups)
    assert chunk_dedup.exact_groups(table(spark).limit(0)).count() == 0 and chunk_dedup.drop_exact(table(spark).limit(0)).count() == 0


def test_chunks_follow_content(spark):
    rng = random.Random(0)
    text = " ".join("".join(rng.choice("abcdeinrstou") for _ in range(rng.randint(1, 9))) for _ in range(9000))
    df = spark.createDataFrame([(text,), ("a new start. " + text,)], "t string").select(chunk_dedup.chunks(F.col("t")).alias("c"))
    one, two = (r.c for r in df.collect())
    assert "".join(one) == text and len(set(one) & set(two)) > 0.9 * len(one) and max(map(len, one)) <= 4096


def test_no_python_on_native_paths(spark):
    plan = chunk_dedup.exact_groups(table(spark))._jdf.queryExecution().toString()
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    plan += chat.conversation_digests(chat.format_windows(rows))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# Chat windows -----------------------------------------------------------------------------------

TALK = [
    (1, 0, "system", "be <b>kind</b> [INST]"), (1, 1, "user", "hi \\ there"), (1, 2, "assistant", "x" * 900), (1, 3, "user", "and?"), (1, 4, "assistant", "\\l \\\\b <|im_end|>\n"), (1, 5, "user", None), (1, 6, "assistant", "ü" * 1500),
    (2, 0, "user", "one"), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (2, 3, "system", "late"), (2, 4, "assistant", "😀 ok"),
    (3, 0, "system", "alone"), (4, 0, None, None), (None, 0, "user", "no id"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    *((5, k, ("user", "assistant")[k % 2], f"turn {k} " * (k % 40)) for k in range(300)),
]


@pytest.mark.parametrize(("budget", "history"), [(1024, 256), (120, 40), (20, 0)])
def test_chat_round_trip(spark, budget, history):
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").withColumns({"window": F.lit("x"), "n": F.lit(1), "k": F.lit(1)}).repartition(5)
    windows = chat.format_windows(df, budget, history)
    got = {r.conv_id: r for r in chat.conversation_digests(windows).collect()}
    spans = windows.collect()
    by = collections.defaultdict(list)
    for c, t, r, x in TALK:
        by[c].append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        own = sorted((s for s in spans if s.conv_id == c), key=lambda s: s.window)
        assert [s.window for s in own] == list(range(len(own))) and r.formatted_chars == sum(len(s.text) for s in own)
        size = lambda x: -(-len(x.encode()) // 4) + chat.MARKS
        system = size(turns[0][2]) if turns[0][1] == "system" else 0
        for s, back in zip(own, sorted(chat.read_windows(windows).filter(F.col("conv_id").eqNullSafe(F.lit(c))).collect(), key=lambda x: x.window), strict=True):
            new = sum(size(t.text) for t in back.new) - (system if s.window == 0 else 0)
            assert s.over_budget or system + history + new <= max(budget, system + history + 1)
            assert "[INST]" not in s.text and (not system or s.text.startswith(f"{chat.START}system\n"))
            assert not s.over_budget or len(back.new) - (system > 0 and s.window == 0) == 1
    if budget == 120:
        assert max(s.window for s in spans if s.conv_id == 5) > 20 and any(s.repeated for s in spans if s.conv_id == 5)
    assert chat.conversation_digests(chat.format_windows(df.limit(0))).count() == 0


# Decontamination --------------------------------------------------------------------------------


def brute_contamination(texts, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        m = min(width, len(w))
        for k in range(len(w) - m + 1 if w and i is not None else 0):
            windows[tuple(w[k : k + m])].add(str(i))
    lengths = {len(x) for x in windows}
    out = []
    for t in texts:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit.update(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 60])
def test_contamination(spark, block_bytes):
    rng = random.Random(4)
    word = lambda: rng.choice(["a", "b", "C", "é", "the", "7"])
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 9, 10, 11, 25])))) for k in range(2, 30)] + [(30, None), (31, ""), (None, "a b"), (32, "z-Z_z"), (32, "q1 q2"), (33, items_text := "one two three four five six seven eight nine ten eleven")]
    texts = [" ".join(word() for _ in range(rng.choice([0, 5, 200, 3000]))) for _ in range(25)] + [None, "", "Z.z!Z", f"x {items_text.upper()}; y", "one two three four five six seven eight nine", "q1" * 3000, "seven " + items_text + " " + items_text]
    docs = table(spark, list(enumerate(texts)))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("i", F.lit(0))
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.flag_contaminated(docs, bench, block_bytes=block_bytes).collect()}
    want = brute_contamination(texts, items)
    assert [got[k] for k in range(len(texts))] == want
    clean = decontaminate.flag_contaminated(docs, bench, block_bytes=block_bytes, only_clean=True)
    assert sorted(r.doc_id for r in clean.collect()) == [k for k, x in enumerate(want) if not x[1]] and clean.columns == docs.columns
    none = decontaminate.flag_contaminated(docs, bench.limit(0))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts)
    assert decontaminate.flag_contaminated(docs.limit(0), bench).count() == 0


# Toxicity ---------------------------------------------------------------------------------------


def test_pairs_are_learned(spark):
    """A word that is toxic only next to another: no linear weights tell these apart."""
    rng = random.Random(3)
    rows, labels = [], []
    for k in range(1200):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        text = [rng.choice(["red", "green", "blue", "tree", "house"]) for _ in range(8)] + ["insultword"] * a + ["groupname"] * b
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        labels.append((k, int(a and b)))
    docs, given = table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, given, where=F.col("doc_id") < 800)
    out = toxicity.score(docs, model)
    right = sum(r.predicted == labels[r.doc_id][1] for r in out.collect() if r.doc_id >= 800)
    assert right > 395
    clean = toxicity.score(docs, model, only_clean=True)
    assert clean.columns == docs.columns and clean.count() == out.filter("predicted = 0").count()


def test_toxicity_edges(spark):
    docs = table(spark)
    for labels in ([], [(1, 0), (8, 0)], [(8, 1), (10, None), (None, 1)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert all(r.predicted == any(y == 1 and i for i, y in labels) for r in got)
    assert toxicity.score(docs.limit(0), model).count() == 0
    many = spark.createDataFrame([(7, "x y z insult"), (7, "x y z")] * 30, "doc_id long, text string")
    assert toxicity.train(many, spark.createDataFrame([(7, 1)], "doc_id long, toxic int"), most_rows=5).w0 > 0


# Personal data ----------------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    ok = {"email": lambda s: True, "ip": lambda s: all(int(p) <= 255 for p in s.split(".")), "card": lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and personal_data.luhn(d), "phone": lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15}
    return [(k, *m.span()) for k, p in BASE.items() for m in re.finditer(p, text) if ok[k](m[0])]


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    pieces = ["a", "@", ".", "b-c", "1", "255", "4111111111111111", " ", "+", "(", ")", "-", "é", "\n", "10.0.0.1", "x@y.z", "@@", "..", "+1 (555) 555-0100", "256", "00001"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert personal_data.base_spans(text) == plain_spans(text), text
    for text in ("a" * 200_000, "1" * 3_000, "1." * 20_000, "+1" * 20_000, "a@" * 20_000, "a.b@" + "c." * 5_000):
        personal_data.base_spans(text)  # in linear time


def test_viterbi_is_exact():
    field = personal_data.default_field()
    decoder = personal_data.Decoder(field)
    rng = random.Random(2)
    vocabulary = ["the", "ann", "at", "dot", "(at)", "com", "call", "555-0100", "(030)", "12", "$$$", "4111", "1111", "a@b.c", "10.0.0.1", "x.", "[dot]", "token=1a2b"]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    words = [t.split() for t in texts]
    counts = np.array([len(w) for w in words])
    got = decoder.labels(decoder.classes(pa.array([w for ws in words for w in ws])), counts)
    at = 0
    for ws in words:
        kinds = [personal_data.NONE, *map(personal_data.features, ws), personal_data.NONE]
        weight = lambda w, fs: sum((w[field.index[f]] for f in fs if f in field.index), np.zeros(len(personal_data.LABELS)))
        score = [weight(field.here, kinds[k + 1]) + weight(field.before, kinds[k]) + weight(field.after, kinds[k + 2]) for k in range(len(ws))]
        best = {(y,): score[0][y] for y in range(len(personal_data.LABELS))} if ws else {(): 0}
        for s in score[1:]:
            top = {}
            for path, v in best.items():
                for y in range(len(personal_data.LABELS)):
                    n = v + field.change[path[-1], y] + s[y]
                    if y not in top or n > top[y][1]:
                        top[y] = (path + (y,), n)
            best = dict(top.values())
        value = lambda p: sum(s[y] for s, y in zip(score, p, strict=True)) + sum(field.change[a, b] for a, b in zip(p, p[1:], strict=False))
        own = tuple(got[at : at + len(ws)].tolist())
        assert value(own) == pytest.approx(max(best.values()))
        at += len(ws)


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("phone", "555-123-4567, 555-987-6543", ["555-123-4567", "555-987-6543"]),
        ("phone", "(030) 555-0199 (030) 555-0142 (030) 555-0111", ["(030) 555-0199", "(030) 555-0142", "(030) 555-0111"]),
        ("email", "joe at mail dot org, ann at post dot net", ["joe at mail dot org", "ann at post dot net"]),
    ],
)
def test_finds_side_by_side(kind, text, want):
    labels = np.array([personal_data.LABELS.index(f"{'inside' if k else 'begin'}-{kind}") for w in want for k in range(len(w.split()))])
    said = lambda base: [text[a:z] for _, a, z in personal_data.added_spans(text, labels, base)]
    assert said([]) == want
    assert said([(kind, 0, len(want[0]))]) == want[1:]


def finds(labels):
    out = []
    for k, x in enumerate(labels):
        mark, _, kind = x.partition("-")
        if mark == "begin" or (kind and not (out and out[-1][0] == kind and out[-1][2] == k)):
            out.append([kind, k, k + 1])
        elif kind:
            out[-1][2] = k + 1
    return set(map(tuple, out))


def test_field_on_a_held_out_table():
    rows = personal_data.labelled_table(seed=99)
    said = {" ".join(w) for w, _ in personal_data.labelled_table()}
    rows = [r for r in rows if " ".join(r[0]) not in said]
    decoder = personal_data.Decoder(personal_data.default_field())
    counts = np.array([len(w) for w, _ in rows])
    labels = decoder.labels(decoder.classes(pa.array([w for ws, _ in rows for w in ws])), counts)
    ends = np.cumsum(counts)
    pairs = [(finds([personal_data.LABELS[y] for y in labels[e - n : e]]), finds(want)) for (_, want), e, n in zip(rows, ends, counts, strict=True)]
    for kind in personal_data.KINDS:
        own = [({x for x in a if x[0] == kind}, {x for x in b if x[0] == kind}) for a, b in pairs]
        right, found, all_ = (sum(map(len, z)) for z in ([a & b for a, b in own], [a for a, _ in own], [b for _, b in own]))
        assert right >= 0.95 * found and right >= 0.95 * all_ > 50, kind


def test_words_of_any_length():
    words = ["x" * 300 + "[at]" + "y" * 300 + "[dot]com", "7" * 200_000, "." * 200_000 + "a", "a" * 200_000 + "1"]
    kinds = [personal_data.features(w) for w in words]
    assert kinds[0] == personal_data.features("x[at]y[dot]com") and len(set(kinds)) == 4


def test_added_spans(spark):
    texts = ["write ann at mail dot example dot org please", "call me at (556) 555-7508 now", "bob[at]mail[dot]com is here", "nothing at all in 2020, see point 5.", "a@b.cd and +1 (555) 555-0100, 10.0.0.1; 4111 1111 1111 1111", None, "", "a" * 10_000, "At the dot com era. Licensed under CC BY-NC 4.0."]
    got = {r.doc_id: r for r in personal_data.personal_data(table(spark, list(enumerate(texts)))).collect()}
    said = {i: [(s.kind, texts[i][s.start : s.end]) for s in r.added] for i, r in got.items() if r.added}
    assert said == {0: [("email", "ann at mail dot example dot org")], 1: [("phone", "(556) 555-7508")], 2: [("email", "bob[at]mail[dot]com")]}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain_spans(t or "")
    digests = {r.doc_id: r for r in personal_data.span_digests(personal_data.personal_data(table(spark, list(enumerate(texts))))).collect()}
    base = plain_spans(texts[4])
    assert digests[4].base_sha256 == personal_data.digest(base) and digests[4].spans == ",".join(f"{k}:{a}:{z}" for k, a, z in base)
    assert (digests[4].n_email, digests[4].n_ip, digests[4].n_card, digests[4].n_phone) == (1, 1, 1, 1)
    assert digests[0].n_email == 0 and digests[0].spans == "email:6:37" and digests[5].spans == ""
    assert personal_data.mask(texts[4], base).startswith("<email> and <phone>, <ip>; <card>")
    assert personal_data.personal_data(table(spark).limit(0)).count() == 0


# Language model ---------------------------------------------------------------------------------


def brute_scores(train, texts):
    tok = lambda t: [w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = tok(t)
        uni.update(w)
        bi.update(zip([0, *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)

    def discounts(c):
        k = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        return [0, *kneser_ney.discounts_of(k)]

    low = collections.Counter(w for _, w in bi)
    d, e, total = discounts(bi), discounts(low), sum(low.values())
    context = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (u, _), c in bi.items():
        context[u][0] += c
        context[u][min(c, 3)] += 1
    g1 = sum(e[min(c, 3)] for c in low.values()) / total if total else 1

    def p(u, w):
        c = low.get(w, 0)
        p1 = max(c - e[min(c, 3)], 0) / max(total, 1) + g1 / (v + 1)
        if u not in context:
            return p1
        s, c = context[u], bi.get((u, w), 0)
        return max(c - d[min(c, 3)], 0) / s[0] + sum(d[k] * s[k] for k in (1, 2, 3)) / s[0] * p1

    out = []
    for t in texts:
        w = tok(t)
        base = sum(math.log10((uni.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(u, x)) for u, x in zip([0, *w[:-1]], w, strict=True))))
    return out


@pytest.mark.parametrize(("bucket_bytes", "hot"), [(kneser_ney.BUCKET_BYTES, kneser_ney.HOT), (500, 0.02)])
def test_kneser_ney(spark, bucket_bytes, hot):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    rows = ODD + [(100 + k, " ".join(rng.choice(words[: rng.choice([3, 20, 60])]) for _ in range(rng.randint(0, 80))).upper()) for k in range(60)] + [(300, "common pair " * 400)]
    docs = table(spark, rows)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    model = kneser_ney.train(docs.filter(~kneser_ney.held_out(F.col("doc_id"))), bucket_bytes=bucket_bytes, hot_share=hot)
    got = sorted(kneser_ney.score(docs, model).collect(), key=lambda r: (str(r.doc_id), str(r.text)))
    want = [x for _, x in sorted(zip(rows, brute_scores(train, [t for _, t in rows]), strict=True), key=lambda x: (str(x[0][0]), str(x[0][1])))]
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == pytest.approx(w[3:], abs=1e-6) and r.perplexity == pytest.approx(10 ** (-w[4] / w[0]))


def test_kneser_ney_without_training(spark):
    model = kneser_ney.train(table(spark).limit(0))
    rows = kneser_ney.score(table(spark), model).collect()
    assert len(rows) == len(ODD) and all(r.score <= 0 and r.n_known == 0 for r in rows)


# Near-duplicates --------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_similar_equals_plain_distance():
    rng = random.Random(9)
    pairs = []
    for _ in range(300):
        a = [rng.randint(0, 30) for _ in range(rng.randint(0, 60))]
        b = a[:]
        for _ in range(rng.randint(0, 25)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 2)] = [rng.randint(0, 30) for _ in range(rng.randint(0, 2))]
        pairs.append((a, b))
    got = order_minhash.similar([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs])
    assert got.tolist() == [edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9 for a, b in pairs]


def test_least_edits_is_a_bound():
    rng = random.Random(2)
    pairs = []
    for _ in range(300):
        a = [rng.randrange(1 << 64) for _ in range(rng.randint(1, 400))] * rng.choice([1, 1, 3])
        b = [w if rng.random() < rng.choice([0.5, 0.9]) else rng.randrange(1 << 64) for w in a if rng.random() < 0.9]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
    for a, b in pairs:
        n, m = np.array([len(a)]), np.array([len(b)])
        least = order_minhash.least_edits(order_minhash.signatures(a, n), order_minhash.signatures(b, m), n, m)[0]
        common = sum((collections.Counter(a.tolist()) & collections.Counter(b.tolist())).values())
        assert least <= max(len(a), len(b)) - common


@pytest.mark.parametrize("common", [250, 5, 2])  # no pair of words is common, some are, all are
@pytest.mark.parametrize("threshold", [0.7, 0.8, 0.9])
def test_prefixes_of_similar_texts_meet(threshold, common):
    rng = random.Random(int(threshold * 10))
    for _ in range(400):
        n = rng.randint(2, 60)
        a = [rng.randrange(30) for _ in range(n)]
        b = a[:]
        for _ in range(int((1 - threshold) * n + 1e-9)):
            k = rng.randrange(len(b))
            if (how := rng.randrange(3)) == 0 and len(b) > 1:
                del b[k]
            elif how == 1:
                b[k] = 100 + rng.randrange(10**6)
            else:
                b.insert(k, 100 + rng.randrange(10**6))
        pair = [np.array(a, np.uint64), np.array(b, np.uint64)]
        if a == b or not order_minhash.similar([tuple(x.astype(np.int64) for x in pair)], threshold)[0]:
            continue
        df = np.random.default_rng(1).integers(2, 9, 1 << 12).astype(np.uint8)  # any order will do
        tokens, text = order_minhash.posted(pair, df, threshold, common)
        assert set(tokens[text == 0].tolist()) & set(tokens[text == 1].tolist())


def test_near_groups(spark):
    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in "bcdfgh" for b in ("an", "er", "ion", "ish", "ock", "um")]
    text = lambda n: [rng.choice(vocabulary) + rng.choice(vocabulary) for _ in range(n)]
    rows, family = [], {}

    def put(words, f):
        family[len(rows)] = f
        rows.append((len(rows), " ".join(words)))

    shared = text(60)
    for f in range(12):
        base = text(rng.choice([12, 80, 400]))
        put(base, f)
        for _ in range(rng.choice([1, 2, 5])):
            copy = base[:]
            for _ in range(max(1, len(copy) // 20)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            put(copy, f)
        put(base, f)
        put([w.upper() for w in base], f)
    for f in range(12, 24):  # a passage of 60 words that is a third of the text: not near
        put(text(60) + shared + text(60), f)
    for f in range(24, 30):
        put(text(3), f)
    hub = text(200)
    for _ in range(150):
        copy = hub[:]
        for _ in range(6):
            copy[rng.randrange(200)] = rng.choice(vocabulary)
        put(copy, 99)
    odd = len(rows)
    rows += [(odd, None), (odd + 1, ""), (odd + 2, " \n"), (odd + 3, "twice"), (odd + 3, "twice"), (None, "no id at all here now")]
    out = order_minhash.near_groups(table(spark, rows))
    got = out.collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    want = collections.defaultdict(list)
    for i, f in family.items():
        want[f].append(i)
    for ids in want.values():
        assert {by[i].group_id for i in ids} == {min(ids)} and {by[i].group_size for i in ids} == {len(ids)}
        assert [i for i in ids if by[i].kept] == [min(ids)]
    assert {by[odd + k].group_id for k in range(3)} == {odd} and by[odd].group_size == 3
    assert sum(r.kept for r in got if r.doc_id == odd + 3) == 1
    kept = order_minhash.drop_near(table(spark, rows))
    assert kept.count() == sum(r.kept for r in got) and kept.columns == table(spark, rows).columns
    assert order_minhash.near_groups(table(spark).limit(0)).count() == 0


@pytest.mark.parametrize(("part", "common", "turns"), [(order_minhash.PART, order_minhash.COMMON, order_minhash.TURNS), (7, 16, 0)])
def test_near_pairs_under_a_template(spark, monkeypatch, part, common, turns):
    monkeypatch.setattr(order_minhash, "PART", part)
    monkeypatch.setattr(order_minhash, "COMMON", common)
    monkeypatch.setattr(order_minhash, "TURNS", turns)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**9)}"
    template = [word() for _ in range(234)]
    texts = [[word() for _ in range(66)] for _ in range(200)]
    for k in range(10):  # every other word differs, so that the texts agree on no sketch that the template doesn't give: similarity 0.89
        texts[2 * k + 1] = [w if j % 2 else word() for j, w in enumerate(texts[2 * k])]
    got = order_minhash.near_groups(table(spark, [(i, " ".join(template + x)) for i, x in enumerate(texts)])).collect()
    assert {r.doc_id: r.group_id for r in got} == {i: i - i % 2 if i < 20 else i for i in range(200)}


def test_near_copies_give_few_candidates(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**9)}"
    base = [word() for _ in range(300)]
    texts = []
    for _ in range(400):
        copy = base[:]
        for _ in range(4):
            copy[rng.randrange(300)] = word()
        texts.append(" ".join(copy))
    full = order_minhash.sketched(table(spark, list(enumerate(texts))), "doc_id", "text", order_minhash.SKETCHES, order_minhash.SKETCH_LEAST, order_minhash.SKETCH_K)
    found, _ = order_minhash.candidates(full.select("_key", "_sketches"))
    assert found.select("a").distinct().count() == 399  # all but the least
    assert found.count() < 10 * 400


def test_pairs_meet_once():
    rng = np.random.default_rng(6)
    texts, tokens = 60, [np.sort(rng.choice(40, 12, replace=False)) for _ in range(60)]
    text, token = np.repeat(np.arange(texts), 12), np.concatenate(tokens)
    first = order_minhash.first_tokens(token, text, texts)
    order = np.lexsort((text, token))
    text, token = text[order], token[order]
    key = np.stack([np.zeros(texts, np.int64), np.arange(texts)], 1)[text]
    zero = np.zeros(len(text), np.int64)
    got = [(int(text[x]), int(text[y])) for a, b in order_minhash.meeting(token, zero, zero, key, key, zero + 9, np.zeros((len(text), 256), np.uint8), token, first[text], 0.8) for x, y in zip(a, b, strict=True)]
    want = {(a, b) for a in range(texts) for b in range(a) if np.intersect1d(tokens[a], tokens[b]).size}
    assert set(got) == want and len(got) == len(want)


def test_fine_signatures_rule_out_long_texts():
    rng = np.random.default_rng(4)
    often = np.repeat(rng.integers(1 << 63, size=2, dtype=np.uint64) * np.uint64(2), 300)  # most of a text of 800 words is two words
    words = [np.concatenate([often, rng.integers(1 << 63, size=200, dtype=np.uint64) * np.uint64(2)]) for _ in range(40)]
    words += [np.concatenate([w[:-40], rng.integers(1 << 63, size=40, dtype=np.uint64)]) for w in words[:10]]  # 40 words edited: links
    fine, n = order_minhash.fine_signatures(words), np.array([len(w) for w in words])
    sums, key = order_minhash.signatures(np.concatenate(words), n), np.stack([np.zeros(50, np.int64), np.arange(50)], 1)
    assert (order_minhash.coarse(fine) <= sums).all()
    zero, first = np.zeros(50, np.int64), order_minhash.first_tokens(np.arange(50), np.arange(50), 50)
    meet = lambda *more: {(max(x, y), min(x, y)) for a, b in order_minhash.meeting(zero, zero, zero, key, key, n, sums, zero, first, 0.8, *more) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    links = {(40 + i, i) for i in range(10)}
    assert links <= meet(fine) and len(meet(fine)) < 100 < 1000 < len(meet())


def test_fine_signatures_bound_edits():
    rng = random.Random(3)
    for _ in range(200):
        a = [rng.randrange(1 << 64) for _ in range(rng.randint(1, 300))] * rng.choice([1, 1, 20])
        b = [w if rng.random() < rng.choice([0.5, 0.9]) else rng.randrange(1 << 64) for w in a if rng.random() < 0.9]
        n, fine = [len(a)], order_minhash.fine_signatures([np.array(a, np.uint64), np.array(b, np.uint64)])
        common = sum((collections.Counter(a) & collections.Counter(b)).values())
        for made in (order_minhash.unpacked(fine), order_minhash.coarse(fine)):
            assert order_minhash.least_edits(made[:1], made[1:], np.array(n), np.array([len(b)]))[0] <= max(len(a), len(b)) - common


def test_rows_without_a_partner_send_no_signatures(spark, monkeypatch):
    rng = np.random.default_rng(11)
    word = lambda n: rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2)
    rare, template = word(200).reshape(100, 2), word(70)
    texts = [np.concatenate([word(60), rare[i % 100]]) for i in range(300)]  # three unlike texts have a rare pair in common
    texts += [np.concatenate([template, word(30)]) for _ in range(30)]  # a list that PART cuts
    texts += [np.concatenate([t[:20], word(2), t[22:]]) for t in texts[:5] + texts[300:305]]
    key = lambda i: i.to_bytes(16, "big")
    words = spark.createDataFrame([(key(i), t.tobytes()) for i, t in enumerate(texts)], "k binary, w binary")
    kept, keep = {}, order_minhash.written
    monkeypatch.setattr(order_minhash, "written", lambda df, kind: kept.setdefault(kind, keep(df, kind)))
    monkeypatch.setattr(order_minhash, "PART", 8)
    got = [(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in order_minhash.open_pairs(words.select("k", F.col("k").alias("root")), words, 0.8).collect()]
    links = {(330 + i, j) for i, j in enumerate([*range(5), *range(300, 305)])}
    assert links <= set(got) and len(got) == len(set(got))
    sent = {int.from_bytes(r.k, "big") for r in kept["partners"].collect()}
    assert {x for pair in links for x in pair} <= sent and not sent & set(range(5, 300))
    assert kept["lists"].filter("parts > 1").count()


def test_partnered_rows_are_those_of_possible_pairs():
    rng = np.random.default_rng(12)
    words = [rng.integers(1 << 63, size=n, dtype=np.uint64) * np.uint64(2) for n in rng.integers(20, 60, 40)]
    words += [np.concatenate([w[:-2], rng.integers(1 << 63, size=2, dtype=np.uint64)]) for w in words[:12]]
    text = np.concatenate([np.sort(rng.choice(52, rng.integers(1, 30), replace=False)) for _ in range(30)])
    token = np.cumsum(np.diff(text, prepend=99) <= 0) - 1
    small, n = order_minhash.fine_signatures(words, order_minhash.SMALL), np.array([len(w) for w in words])
    root = np.stack([np.zeros(52, np.int64), np.where(np.arange(52) < 6, 0, np.arange(52))], 1)
    zero = np.zeros(len(text), np.int64)
    got = order_minhash.partnered(token, zero, zero, root[text], n[text], small[text], 0.8)
    full = order_minhash.unpacked(small)

    def fits(a: int, b: int) -> bool:
        edits = order_minhash.least_edits(full[[a]], full[[b]], n[[a]], n[[b]])[0]
        return bool((root[a] != root[b]).any()) and max(abs(n[a] - n[b]), edits) <= int(0.2 * max(n[a], n[b]) + 1e-9)

    want = [any(fits(a, b) for b in text[token == t] if a != b) for a, t in zip(text, token, strict=True)]
    assert got.tolist() == want and 0 < sum(want) < len(want)


def test_links_joined_in_one_task_equal_the_loop(spark, monkeypatch):
    rng = random.Random(7)
    keys = [rng.randbytes(16) for _ in range(300)]
    chain = sorted(keys[:40], reverse=True)
    rows = [rng.sample(keys[40:], 2) for _ in range(130)] + list(zip(chain[1:], chain[:-1], strict=True))
    links = order_minhash.written(spark.createDataFrame(rows, "a binary, b binary"), "links")
    tables = []
    keep = order_minhash.written
    monkeypatch.setattr(order_minhash, "written", lambda df, kind: tables.append(kind) or keep(df, kind))
    one = {bytes(r.k): bytes(r.root) for r in order_minhash.components(links).collect()}
    assert tables == ["labels"]
    monkeypatch.setattr(order_minhash, "LOCAL_LINKS", 0)
    assert one == {bytes(r.k): bytes(r.root) for r in order_minhash.components(links).collect()}
    assert {one[k] for k in chain} == {min(chain)} and len(one) == len({k for r in rows for k in r})
    monkeypatch.undo()
    assert order_minhash.components(links.limit(0)).count() == 0


def even_edits(rng, length, every, pairs):
    """Pairs of texts with each every-th word replaced, as hashes, in turn."""
    out = []
    for _ in range(pairs):
        a = rng.integers(1 << 62, size=length).astype(np.uint64)
        b = a.copy()
        b[every - 1 :: every] = rng.integers(1 << 62, size=length // every).astype(np.uint64)
        out += [a, b]
    return np.concatenate(out), np.full(2 * pairs, length)


@pytest.mark.parametrize("length", [20, 60, 100, 300, 1000])
@pytest.mark.parametrize("every", [5, 6, 7, 8])  # similarity 0.8, 0.833, 0.857, 0.875
def test_sketch_recall_down_to_the_threshold(every, length):
    words, counts = even_edits(np.random.default_rng(every), length, every, 300)
    pairs = [(words[2 * k * length : (2 * k + 1) * length], words[(2 * k + 1) * length : (2 * k + 2) * length]) for k in range(300)]
    assert order_minhash.similar(pairs).all()  # all are links
    least = order_minhash.SKETCH_LEAST if length > order_minhash.SHORT[1] else order_minhash.SHORT_LEAST
    s = order_minhash.sketches(*order_minhash.kmers(words, counts, order_minhash.SKETCH_K), order_minhash.SKETCHES, least)
    assert (s[::2] == s[1::2]).any(1).mean() >= 0.98


def test_sketches_of_very_long_texts(monkeypatch):
    rng = np.random.default_rng(1)
    grams, n = rng.integers(1 << 62, size=3000).astype(np.uint64), np.array([2500, 500])
    grams[100:200] = grams[0]  # ties go to the earlier place
    want = order_minhash.sketches(grams, n, 8, 3)
    monkeypatch.setattr(order_minhash, "LONG", 64)
    monkeypatch.setattr(order_minhash, "BLOCK", 2600)
    assert (order_minhash.sketches(grams, n, 8, 3) == want).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_near_groups_equal_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, (r.text or "").lower().split()) for r in docs.collect()]
    number = {}
    coded = [np.array([number.setdefault(w, len(number)) for w in words], np.int64) for _, words in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if min(len(coded[i]), len(coded[j])) >= 0.8 * max(len(coded[i]), len(coded[j]))]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), near in zip(pairs, order_minhash.similar([(coded[i], coded[j]) for i, j in pairs]), strict=True):
        if near and len(coded[i]) and len(coded[j]):
            root[top(i)] = top(j)
    empty = [i for i in range(len(rows)) if not len(coded[i])]
    for i in empty[1:]:
        root[top(i)] = top(empty[0])
    want = {}
    for i, (d, _) in enumerate(rows):
        want.setdefault(top(i), set()).add(d)
    got = {}
    for r in order_minhash.near_groups(docs).collect():
        got.setdefault(r.group_id, set()).add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_evenly_spread_edits_are_found(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**9)}"
    rows = []
    for _ in range(20):
        a = [word() for _ in range(400)]
        rows += [a, [w if j % 5 else word() for j, w in enumerate(a)]]
    got = order_minhash.near_groups(table(spark, [(i, " ".join(x)) for i, x in enumerate(rows)])).collect()
    assert {r.doc_id: r.group_id for r in got} == {i: i - i % 2 for i in range(40)}


def test_order_minhash_sees_order():
    rng = np.random.default_rng(0)
    words = rng.integers(1 << 62, size=400).astype(np.uint64)
    swapped = np.concatenate([words[200:], words[:200]])
    grams, n = order_minhash.kmers(np.concatenate([words, swapped, words]), np.array([400, 400, 400]))
    s = order_minhash.sketches(grams, n, count=64)
    assert (s[0] == s[2]).all() and 0.2 < (s[0] == s[1]).mean() < 0.8


def test_kmers_count_occurrences():
    w = np.array([5] * 12, np.uint64)
    grams, n = order_minhash.kmers(w, np.array([12]))
    assert n.tolist() == [8] and len(set(grams.tolist())) == 8
    short, m = order_minhash.kmers(np.array([1, 2, 3, 1, 2, 3], np.uint64), np.array([3, 0, 3]))
    assert m.tolist() == [1, 0, 1] and short[0] == short[1]


def test_key_filter_loses_nothing(spark):
    import os

    keys = [os.urandom(16) for _ in range(3000)]
    made = order_minhash.key_filter(spark.createDataFrame([(k,) for k in keys[:1500]], "k binary"), 1500)
    ok = order_minhash.passes(keys, made)
    assert ok[:1500].all() and ok[1500:].mean() < 0.1


def test_verified_moves_only_the_texts_of_its_pairs(spark):
    rng = np.random.default_rng(6)
    texts = rng.integers(1 << 62, size=(2000, 300), dtype=np.int64)
    texts[1, 3:] = texts[0, 3:]  # three edits in 300 words
    keys = [hashlib.md5(str(i).encode()).digest() for i in range(len(texts))]
    words = order_minhash.written(spark.createDataFrame([(k, t.tobytes()) for k, t in zip(keys, texts, strict=True)], "k binary, w binary"), "words")
    pairs = order_minhash.written(spark.createDataFrame([(keys[0], keys[1]), (keys[2], keys[3])], "a binary, b binary"), "pairs")
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty(30_000)
        return sum(x.totalShuffleWrite() for x in (found.apply(i) for found in [context.statusStore().executorList(False)] for i in range(found.size())))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = moved()
        got = [(bytes(r.a), bytes(r.b)) for r in order_minhash.verified(pairs, words, 0.8).collect()]
        assert got == [(keys[0], keys[1])]
        assert moved() - start < texts.nbytes // 20
        assert order_minhash.verified(pairs.limit(0), words, 0.8).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = {bytes(r.k) for r in order_minhash.needed(words, pairs.select(F.col("a").alias("k")), 2).collect()}
    assert {keys[0], keys[2]} <= kept and len(kept) < 50
    star = spark.createDataFrame([(k, keys[0]) for k in keys[1:]], "a binary, b binary").repartition(2)
    sent = [bytes(r.k) for r in order_minhash.keys_of(star).collect()]
    assert set(sent) == set(keys) and sent.count(keys[0]) <= 2
