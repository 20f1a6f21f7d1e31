"""Small tables with the awkward cases that every operator must stand."""

from pyspark.sql import types as T

ODD = [
    (1, "It's a <|endoftext|> test, with 3 words & more; and <|startoftext|>"),
    (2, None),
    (3, ""),
    (4, "   \t\n "),
    (5, "Été ÀÉ İx ǅ ́e é Å Å Σς ΟΔΟΣ ȺȾ Ȿ"),
    (6, "日本 語。１２３ ½ ² Ⅷ a\x1cb\x0bc\x1fd\x85e\xa0f g　h᠎i​j"),
    (7, "x\x00y 😀 👩‍👩‍👧 a_b __ 's 't ''s"),
    (8, "the same text. " * 40),
    (9, "the same text. " * 40),
    (10, "word " * 30_000),
    (11, "a" * 5_000),
    (12, "ab" * 300 + " end"),
    (12, "ab" * 300 + " end"),
    (None, "a row without an id"),
]
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


def table(spark, rows=ODD, clash=True):
    """Columns of documents, with more columns under names that operators use themselves."""
    df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("ids", "n", "i", "t", "h", "part", "count", "_id", "_row", "keep_id", "score", "word", "key", "row", "_own_key", "_own_n", "a.b")}) if clash else df.repartition(3)
