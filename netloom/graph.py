"""The graph value that operators take: two DataFrames and whether arcs have a direction."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """vertices(id), edges(src, dst, weight). An undirected edge is stored once, with src <= dst. Edges are distinct."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool

    @staticmethod
    def from_edges(edges: DataFrame, directed: bool, vertices: DataFrame | None = None) -> Graph:
        """Edges with a null end are dropped; of equal edges one stays, with the greatest weight.

        vertices: ids that may have no edge; the ends of edges are always vertices.
        """
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(None).cast("double")
        rows = edges.select("src", "dst", weight.alias("weight")).filter("src IS NOT NULL AND dst IS NOT NULL")
        if not directed:
            rows = rows.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
        rows = rows.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
        ends = rows.select(F.col("src").alias("id")).unionByName(rows.select(F.col("dst").alias("id")))
        if vertices is not None:
            ends = ends.unionByName(vertices.select("id").filter("id IS NOT NULL"))
        return Graph(ends.distinct(), rows, directed)

    def arcs(self, loops: bool = False) -> DataFrame:
        """(src, dst, weight), both ways for an undirected edge; without self-loops unless asked for."""
        rows = self.edges if loops else self.edges.filter("src != dst")
        if self.directed:
            return rows
        back = rows.filter("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return rows.unionByName(back)

    def undirected(self) -> Graph:
        return Graph.from_edges(self.edges, False, self.vertices) if self.directed else self

    def with_edges(self, edges: DataFrame) -> Graph:
        """The same vertices with other edges, which are taken to be normal."""
        return Graph(self.vertices, edges, self.directed)

    def materialized(self) -> Graph:
        """Both tables written to the shared folder and read back, for loops that use them again and again."""
        from netloom.plans.loop import materialized

        return Graph(materialized(self.vertices), materialized(self.edges), self.directed)
