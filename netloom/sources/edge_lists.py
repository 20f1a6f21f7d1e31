"""Edge-list files and ordered CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.graph import Graph


def _fields(lines: DataFrame, pattern: str) -> DataFrame:
    parts = F.split(F.trim("value"), pattern)
    weight = F.try_element_at(parts, F.lit(3)).try_cast("double")
    return lines.select(parts.alias("p"), weight.alias("weight")).filter("size(p) >= 2").select(F.trim(F.col("p")[0]).alias("src"), F.trim(F.col("p")[1]).alias("dst"), "weight").filter("src != '' AND dst != ''")


def read_konect(spark: SparkSession, path: str, directed: bool) -> Graph:
    """KONECT: lines that start with % are comments; columns between white space: from, to, weight if there is one. Ids are strings."""
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("%"))
    return Graph.from_edges(_fields(lines, r"\s+"), directed)


def read_snap(spark: SparkSession, path: str, directed: bool = True) -> Graph:
    """SNAP: lines that start with # are comments; columns between tabs."""
    lines = spark.read.text(path).filter(~F.ltrim("value").startswith("#"))
    return Graph.from_edges(_fields(lines, "\t"), directed)


def read_csv(spark: SparkSession, path: str, directed: bool = False, header: bool = True) -> Graph:
    """The first two columns of a CSV file."""
    df = spark.read.csv(path, header=header)
    src, dst = df.columns[:2]
    return Graph.from_edges(df.select(F.trim(F.col(f"`{src}`")).alias("src"), F.trim(F.col(f"`{dst}`")).alias("dst")), directed)


def literal_graph(spark: SparkSession, edges: list[tuple], directed: bool, vertices: list | None = None) -> Graph:
    """From (src, dst) or (src, dst, weight) tuples; ids are all strings or all integers."""
    sample = next(iter([e[0] for e in edges] + (vertices or [])), "")
    kind = "string" if isinstance(sample, str) else "long"
    rows = [(e[0], e[1], float(e[2]) if len(e) > 2 and e[2] is not None else None) for e in edges]
    ids = spark.createDataFrame([(v,) for v in vertices], f"id {kind}") if vertices else None
    return Graph.from_edges(spark.createDataFrame(rows, f"src {kind}, dst {kind}, weight double"), directed, ids)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def ordered(df: DataFrame, value: str, ascending: bool = False, id_col: str = "id") -> DataFrame:
    """Rows by value, ties by id, as a report lists them."""
    return df.orderBy(F.col(value).asc() if ascending else F.col(value).desc(), id_col)
