"""One query for each operator, over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """Where the public tokenizer lies that the contracts name."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import shared_path
    from .token_files import read_tokens, token_digests, write_tokens

    path = shared_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, word_bpe())
    return token_digests(read_tokens(spark, path))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import build_lexicon, round_trip_digests

    docs = table(spark, sf_dir, "documents")
    return round_trip_digests(docs, word_bpe(), build_lexicon(docs, word_bpe()))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import flag_contaminated

    docs = flag_contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return docs.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .kneser_ney import held_out, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.filter(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import conversation_digests, format_windows

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(t AS BIGINT) AS turn, r AS role, '{said}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS v(t, r)")
    return conversation_digests(format_windows(rows.unionByName(extra)))


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .order_minhash import near_groups

    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "group_id", "group_size", "kept")


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .personal_data import personal_data, span_digests

    return span_digests(personal_data(table(spark, sf_dir, "documents")))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fold, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), where=fold(F.col("doc_id")) != 0)
    return score(docs, model).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op9_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .length_histogram import length_histogram, with_limits

    return with_limits(length_histogram(table(spark, sf_dir, "documents"), word_bpe()))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chunk_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


SQL_OP10 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW g AS (PARTITION BY t)
"""


SQL_OP3 = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL
), il AS (SELECT item_id, w, least(10, len(w)) AS m FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM il)),
lens AS (SELECT DISTINCT m FROM win),
dw AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), dwin AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM dw, lens WHERE len(w) >= m)),
occ AS (SELECT d.r, d.m, d.k, win.item_id FROM dwin d JOIN win ON d.m = win.m AND d.s = win.s),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + m)) AS p FROM (SELECT DISTINCT r, m, k FROM occ)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


SQL_OP5 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), k AS (SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 6 AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
s AS (
  SELECT *, k = 1 AND role = 'system' AS sys,
    length('<|im_start|>') + length(replace(replace(replace(role, '\', '\\'), '<', '\l'), '[', '\b')) + 1 + length(replace(replace(replace(text, '\', '\\'), '<', '\l'), '[', '\b')) + length('<|im_end|>') + 1 AS size
  FROM k
), b AS (
  SELECT *, max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_n, max(CASE WHEN sys THEN size ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_size,
    CAST(coalesce(sum(CASE WHEN sys THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM s
), p AS (SELECT *, greatest(1, 768 - sys_n) AS stride FROM b),
q AS (
  SELECT *, CASE WHEN sys THEN 0 ELSE before // stride * 2 + CASE WHEN before + n > (before // stride + 1) * stride THEN 1 ELSE 0 END END AS span,
    CAST(coalesce(sum(CASE WHEN sys THEN 0 ELSE size END) OVER (PARTITION BY conv_id ORDER BY before RANGE BETWEEN 256 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS history FROM p
), o AS (SELECT *, CASE WHEN sys THEN 0 WHEN lag(span) OVER w IS NULL OR lag(span) OVER w <> span OR lag(sys) OVER w THEN 1 ELSE 0 END AS opens FROM q WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
t AS (SELECT conv_id, sum(CASE WHEN sys THEN 0 ELSE size END + opens * history) + greatest(1, sum(opens)) * max(sys_size) AS chars FROM o GROUP BY conv_id)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(any_value(chars) AS BIGINT) AS formatted_chars
FROM k JOIN t USING (conv_id) GROUP BY conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_files, op2_bpe, op3_decontaminate, op4_kneser_ney, op5_chat_windows, op6_order_minhash, op7_personal_data, op8_toxicity, op9_length_histogram, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": SQL_OP3, "op5_chat_windows": SQL_OP5, "op10_exact_dedup": SQL_OP10}
