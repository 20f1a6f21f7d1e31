"""Chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens place turns on a line that is ruled in strides; turns that lie within one
stride share a window, a turn across a rule has its own. So no window exceeds the budget unless a
single turn does, and the choice is one running sum, however long the conversation. Each window starts
with the conversation's leading system turn and repeats the last turns before it, within a budget of
their own; only assistant texts that are new in a window are under its loss mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's control strings. All control strings, also those of other common
# templates ([INST], <s>, <<SYS>>), start with one of the two letters that escape() removes.
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a turn's own marks are taken to cost.
MARKS = 6


def escape(text: Column) -> Column:
    """\\ -> \\\\, < -> \\l, [ -> \\b: no control string is left in the text."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    """Pairs of backslashes are found from the left, so what lies between them has single ones only."""
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("["))), "\\")


def estimated_tokens(text: Column) -> Column:
    """A token for four bytes, where the table has no counts of its own."""
    return F.ceil(F.octet_length(text) / 4)


def format_windows(conversations: DataFrame, budget: int = 1024, history: int = 256, tokens: Column | None = None) -> DataFrame:
    """Rows (conv_id, turn, role, text) -> (conv_id, window, text, loss, repeated, over_budget).

    window: from 0 in a conversation. text: the formatted window. loss: array of (start, end) in code
    points, the escaped assistant texts that are new here. repeated: turns at the window's start, the system turn
    counted in all windows but the first, that an earlier window has too.
    Turns are in the order of turn, then role, then text; equal rows all stay. Null role or text counts as empty, a null
    conv_id is a conversation of its own, a null turn comes first. tokens: count of a text (estimated if not given).
    An empty table has no windows. Other columns aren't read.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("n", (tokens if tokens is not None else estimated_tokens(F.col("text"))).cast("long") + MARKS)
    rows = rows.withColumn("k", F.row_number().over(in_order))
    leading = (F.col("k") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("is_system", leading)
    by_k = Window.partitionBy("conv_id").orderBy("k")
    whole_before = by_k.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("system_n", F.first(F.when(F.col("is_system"), F.col("n")).otherwise(0)).over(by_k.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.coalesce(F.sum(F.when(F.col("is_system"), 0).otherwise(F.col("n"))).over(whole_before), F.lit(0)))
    stride = F.greatest(F.lit(1), F.lit(budget - history) - F.col("system_n"))
    rows = rows.withColumn("stride", stride).withColumn("bin", F.floor(F.col("before") / F.col("stride")))
    across = F.when(F.col("before") + F.col("n") > (F.col("bin") + 1) * F.col("stride"), 1).otherwise(0)
    rows = rows.withColumn("span", F.when(F.col("is_system"), F.lit(0)).otherwise(F.col("bin") * 2 + across))
    # Turns as formatted, and the last ones before each within the history's budget (a bounded frame).
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit("\n"))
    rows = rows.withColumn("t", F.concat(head, escape(F.col("text")), F.lit(END + "\n"))).withColumn("from", F.length(head)).withColumn("size", F.length(escape(F.col("text"))))
    back = Window.partitionBy("conv_id").orderBy("before").rangeBetween(-history, -1)
    rows = rows.withColumn("earlier", F.collect_list(F.when(~F.col("is_system"), F.col("t"))).over(back))
    rows = rows.withColumn("system", F.first(F.when(F.col("is_system"), F.col("t")).otherwise("")).over(by_k.rowsBetween(Window.unboundedPreceding, 0)))
    last_span = F.lag("span").over(Window.partitionBy("conv_id").orderBy("k"))
    rows = rows.withColumn("opens", F.when(F.col("is_system"), 0).when(last_span.isNull() | (last_span != F.col("span")) | F.lag("is_system").over(by_k), 1).otherwise(0))
    rows = rows.withColumn("window", F.greatest(F.lit(1), F.sum("opens").over(by_k)) - 1)
    turns = F.array_sort(F.collect_list(F.when(~F.col("is_system"), F.struct("k", "t", "from", "size", "role", "n"))))
    spans = rows.groupBy("conv_id", "window").agg(
        turns.alias("turns"),
        F.min_by("earlier", F.when(~F.col("is_system"), F.col("k"))).alias("earlier"),
        F.max("system").alias("system"),
        F.max("stride").alias("stride"),
    )
    earlier = F.coalesce("earlier", F.array().cast("array<string>"))
    spans = spans.withColumn("prefix", F.concat(F.col("system"), F.array_join(earlier, "")))
    start = F.struct(F.length("prefix").cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("loss"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["t"])).alias("at"),
        F.when(x["role"] == "assistant", F.concat(acc["loss"], F.array(F.struct((acc["at"] + x["from"]).alias("start"), (acc["at"] + x["from"] + x["size"]).alias("end"))))).otherwise(acc["loss"]).alias("loss"),
    )
    spans = spans.withColumn("loss", F.aggregate("turns", start, step)["loss"])
    return spans.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.concat("prefix", F.array_join(F.col("turns.t"), "")).alias("text"),
        "loss",
        (F.size(earlier) + F.when((F.col("window") > 0) & (F.col("system") != ""), 1).otherwise(0)).alias("repeated"),
        (F.aggregate(F.col("turns.n"), F.lit(0).cast("long"), lambda a, x: a + x) > F.col("stride")).alias("over_budget"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """Formatted windows -> (conv_id, window, new, under_loss, chars).

    new: (role, text) of the turns that no earlier window has; under_loss: the texts under the mask;
    chars: code points of the window.
    """
    marked = F.filter(F.split(F.col("text"), r"<\|im_start\|>", -1), lambda x: x != "")
    turns = F.transform(
        marked,
        lambda x: F.struct(
            unescape(F.substring_index(x, "\n", 1)).alias("role"),
            unescape(F.substr(x, F.locate("\n", x) + 1, F.length(x) - F.locate("\n", x) - len(END) - 1)).alias("text"),
        ),
    )
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    new = F.slice(turns, F.col("repeated") + 1, F.greatest(F.size(turns), F.lit(1)))
    return windows.select("conv_id", "window", new.alias("new"), masked.alias("under_loss"), F.length("text").cast("long").alias("chars"))


def conversation_digests(windows: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the windows."""
    read = read_windows(windows).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "new", "under_loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    turns, loss = F.flatten(F.col("w.new")), F.flatten(F.col("w.under_loss"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.array_join(loss, "")
    return read.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        "formatted_chars",
    )
