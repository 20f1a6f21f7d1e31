import importlib.util
import os

import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="the driver's tables aren't here")

if importlib.util.find_spec("corpus_pipeline"):
    import corpus_pipeline
else:
    corpus_pipeline = None


def test_stages(spark):
    from netloom.llm import toxicity
    from netloom.llm.order_minhash import near_groups
    from netloom.llm.queries import word_bpe

    from .test_text_operators import brute_contamination

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SMALL).cache()
        kept.append((name, before, docs))
    assert [n for n, _, _ in kept] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    for _, before, after in kept[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()
    ids = [{r.doc_id: r.text for r in b.select("doc_id", "text").collect()} for _, b, _ in kept]
    last = {r.doc_id: r for r in kept[-1][2].collect()}
    # toxicity: what the operator predicts
    model = toxicity.train(kept[0][1], spark.read.parquet(f"{SMALL}/labels.parquet"), where=toxicity.fold(F.col("doc_id")) != 0)
    assert set(ids[1]) == {r.doc_id for r in toxicity.score(kept[0][1], model).collect() if not r.predicted}
    # exact: the largest id of each text
    top = {}
    for i, t in ids[1].items():
        top[t] = max(i, top.get(t, i))
    assert set(ids[2]) == set(top.values())
    # near: one of each group of its own input
    groups = near_groups(kept[2][1]).collect()
    assert set(ids[3]) == {r.doc_id for r in groups if r.kept}
    # contamination: brute force
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    order = sorted(ids[3])
    hits = brute_contamination([ids[3][i] for i in order], items)
    assert set(ids[4]) == {i for i, h in zip(order, hits, strict=True) if not h[1]} and set(last) == set(ids[4])
    # ids: the library
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_bpe())
    for i, r in last.items():
        assert r.ids == tok.encode(ids[4][i], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_registered_queries_agree_with_sql(spark):
    import duckdb

    import __spark_entry__

    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert {int(n[2:].split("_")[0]) for n in found if n.startswith("op")} == set(range(1, 11)) and "pipeline" in found
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in sql:
        if name.startswith("op"):
            df = found[name](spark, SMALL)
            got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)
            rel = con.execute(sql[name]).to_arrow_table()
            want = sorted(zip(*(rel.column(c).to_pylist() for c in sorted(rel.column_names)), strict=True), key=str)
            assert got == want, name
