"""Exact deduplication by content-defined chunk recipes, in DataFrame functions only.

A text is cut where its own content says so: a chunk ends at the first mark after `least` characters,
or after `most`. Each distinct chunk moves once, to be given an identifier that is
verified: a 64-bit hash, unless two different chunks have it, in which case the chunk's SHA-256 goes
along. A document is then the ordered list of its chunk identifiers (its recipe), some hundredths of the
text's size, and only recipes are grouped, compared and joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, written

#: Where a chunk ends: some letters or digits, a white space, some others.
MARK = r"[048bfjnvzBFJNVZéñß]\s(?=[159aeimquyAEIMQUYéö])"
#: A group with more than this share of the rows is joined back by broadcast; there are at most 1 / HOT_SHARE such groups.
HOT_SHARE = 1 / 256
#: Up to this many colliding hashes are named in the plan; beyond it every chunk carries its SHA-256.
NAMED_COLLISIONS = 10_000


def chunks(text: Column, least: int = 128, most: int = 4096) -> Column:
    """The chunks of a text, in order; put together they are the text. An empty text has none.

    The mark is a space between two letters or digits of certain classes, some hundredth of all spaces, so that
    chunks fall into step again after a place where two texts differ.
    """
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?{MARK}|.{{1,{most}}}"), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits >= 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 128, most: int = 4096, bits: int = 64) -> DataFrame:
    """(_id, _row, _recipe, _sha256, _digest) for each row: its verified chunk identifiers in order, and their digest.

    _row numbers the rows of one run apart, also equal ones. bits < 64 is for tests of collisions.
    """
    whole = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    cut = whole.withColumn("_chunks", chunks(F.col("_text"), least, most))
    distinct = cut.select(F.explode("_chunks").alias("c")).select(chunk_hash(F.col("c"), bits).alias("h"), "c").distinct()
    shared = distinct.groupBy("h").count().filter("count > 1").select("h").limit(NAMED_COLLISIONS + 1).collect()  # bounded
    if not shared:  # plain hashes: short to move and to compare
        recipe = F.transform("_chunks", lambda c: chunk_hash(c, bits))
        parts = F.transform("_recipe", lambda c: c.cast("string"))
    else:
        named = F.array(*[F.lit(r.h) for r in shared])
        doubtful = (lambda c: F.array_contains(named, chunk_hash(c, bits))) if len(shared) <= NAMED_COLLISIONS else (lambda c: F.lit(True))
        recipe = F.transform("_chunks", lambda c: F.struct(chunk_hash(c, bits).alias("h"), F.when(doubtful(c), F.sha2(c, 256)).otherwise("").alias("s")))
        parts = F.transform("_recipe", lambda c: F.concat_ws(":", c["h"].cast("string"), c["s"]))
    out = cut.select("_id", F.monotonically_increasing_id().alias("_row"), recipe.alias("_recipe"), F.sha2("_text", 256).alias("_sha256"))
    return written(out.withColumn("_digest", F.unhex(F.sha2(F.array_join(parts, ","), 256))), "recipes")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 128, most: int = 4096, bits: int = 64) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty. Of equal texts the row with the largest id
    stays (a null id counts as smallest; of rows that are the same in id and text exactly one stays).
    An empty table gives an empty result. Other columns of docs, whatever their names, aren't read.
    """
    rows = recipes(docs, id_col, text_col, least, most, bits)
    total = rows.count()
    groups = rows.groupBy("_digest", "_recipe").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = written(groups.drop("_recipe"), "groups")  # lists have been compared; their digests, of one size, lead back to the rows
    hot = F.broadcast(groups.filter(F.col("_size") > total * HOT_SHARE))
    rest = groups.filter(F.col("_size") <= total * HOT_SHARE)
    of_hot = rows.join(hot, "_digest").select("_id", "_row", "_sha256", "_keep", "_size")
    others = rows.join(hot.select("_digest"), "_digest", "left_anti").join(rest, "_digest", "left").select("_id", "_row", "_sha256", "_keep", "_size")
    alone = F.col("_keep").isNull()
    return of_hot.unionByName(others).select(
        F.col("_id").alias(id_col),
        F.when(alone, F.col("_id")).otherwise(F.col("_keep._id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_keep._row") == F.col("_row"))).alias("kept"),
        F.col("_sha256").alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, all columns as they are.

    Ids may repeat on different texts; of rows equal in id and text one stays.
    """
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    return kept_rows(docs, kept, id_col, text_col)
