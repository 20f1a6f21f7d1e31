"""Windowed degree counts of a stream of arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_degrees(arcs: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Arcs (ts, src, dst) -> (start, end, id, in_degree, out_degree): arcs by window of event time and vertex; later than `late` is left out.

    The same plan runs on a table or a stream; state is one row for a vertex and open window.
    """
    if arcs.isStreaming:
        arcs = arcs.withWatermark("ts", late)
    ends = F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    each = arcs.select("ts", F.explode(ends).alias("e")).select("ts", "e.*")
    sums = each.groupBy(F.window("ts", window), "id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return sums.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "id", "in_degree", "out_degree")
