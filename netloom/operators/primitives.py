"""Neighbourhoods, subgraphs, modularity, Laplacian, reach and priorities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.graph import Graph
from netloom.plans.ship import ship

from .matrix import LOCAL_ARCS

#: Reports that news travels between two cuts of the lineage.
HOPS_A_ROUND = 4


def neighbors(graph: Graph, node) -> DataFrame:
    """(id): successors, or neighbours of an undirected graph; the node itself if it has a loop."""
    return graph.arcs(loops=True).filter(F.col("src") == F.lit(node)).select(F.col("dst").alias("id")).distinct()


def predecessors(graph: Graph, node) -> DataFrame:
    return graph.arcs(loops=True).filter(F.col("dst") == F.lit(node)).select(F.col("src").alias("id")).distinct()


def non_neighbors(graph: Graph, node) -> DataFrame:
    """(id): vertices that aren't successors of the node, without itself."""
    return graph.vertices.join(neighbors(graph, node), "id", "left_anti").filter(F.col("id") != F.lit(node))


def out_degrees(graph: Graph) -> DataFrame:
    """(id, degree): out-degree of a directed graph; vertices without arcs have 0, a loop of an undirected graph counts 2."""
    ends = graph.edges.select(F.col("src").alias("id")) if graph.directed else graph.edges.select(F.explode(F.array("src", "dst")).alias("id"))
    counts = ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return graph.vertices.join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_of(graph: Graph, node) -> DataFrame:
    return out_degrees(graph).filter(F.col("id") == F.lit(node))


def existing(graph: Graph, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are arcs."""
    return pairs.join(graph.arcs(loops=True).select("src", "dst"), ["src", "dst"], "left_semi")


def subgraph(graph: Graph, ids: DataFrame) -> Graph:
    """The part induced by ids(id)."""
    keep = ids.select("id").distinct()
    edges = graph.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "weight")
    return Graph(graph.vertices.join(keep, "id", "left_semi"), edges, graph.directed)


def without_edges(graph: Graph, removed: DataFrame) -> Graph:
    """The graph without the edges (src, dst); of a directed graph, without both arcs of each."""
    ends = removed.select("src", "dst")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    return graph.with_edges(graph.edges.join(both, ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def with_added_edges(graph: Graph, added: DataFrame) -> Graph:
    more = added if "weight" in added.columns else added.withColumn("weight", F.lit(None).cast("double"))
    return Graph.from_edges(graph.edges.unionByName(more.select("src", "dst", "weight")), graph.directed, graph.vertices)


def modularity(graph: Graph, partition: DataFrame) -> DataFrame:
    """One row (modularity) of a partition (id, cluster): inside share of edges less its expectation. Null without edges."""
    of = lambda c: partition.select(F.col("id").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    edges = graph.edges.join(of("src"), "src").join(of("dst"), "dst")
    inside = edges.select(F.col("src_cluster").alias("cluster"), F.when(F.col("src_cluster") == F.col("dst_cluster"), 1.0).otherwise(0.0).alias("l"), F.lit(1.0).alias("o"), F.lit(0.0).alias("i"))
    other = edges.select(F.col("dst_cluster").alias("cluster"), F.lit(0.0).alias("l"), F.lit(0.0).alias("o"), F.lit(1.0).alias("i"))
    sums = inside.unionByName(other).groupBy("cluster").agg(F.sum("l").alias("l"), F.sum("o").alias("o"), F.sum("i").alias("i"))
    if graph.directed:
        total = graph.edges.agg(F.count(F.lit(1)).cast("double").alias("m"))
        term = F.col("l") / F.col("m") - F.col("o") * F.col("i") / (F.col("m") * F.col("m"))
    else:
        total = graph.edges.agg(F.count(F.lit(1)).cast("double").alias("m"))
        term = F.col("l") / F.col("m") - F.pow((F.col("o") + F.col("i")) / (2 * F.col("m")), F.lit(2.0))
    return sums.join(F.broadcast(total)).agg(F.sum(term).alias("modularity"))


def laplacian(graph: Graph, damping: float = 0.95, steps: int = 200) -> DataFrame:
    """(i, j, value): entries that aren't 0.

    Undirected: degrees less adjacency, without loops. Directed: I - (S + S') / 2 with S = F^1/2 P F^-1/2, P the walk
    that with probability 1 - damping goes anywhere, F its stationary distribution; a full matrix, so for graphs
    of bounded size.
    """
    if not graph.directed:
        arcs = graph.arcs()
        diagonal = graph.vertices.join(arcs.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left")
        return arcs.select(F.col("src").alias("i"), F.col("dst").alias("j"), F.lit(-1.0).alias("value")).unionByName(diagonal.filter("d IS NOT NULL").select(F.col("id").alias("i"), F.col("id").alias("j"), F.col("d").cast("double").alias("value")))
    from .matrix import directed_laplacian

    return directed_laplacian(graph, damping, steps)


def _closed(known: DataFrame, step: DataFrame) -> DataFrame:
    """(auction, bidder): known and all that reports lead to from there, each auction searched as arrays in one task."""
    rows = known.select("auction", "bidder", F.lit(None).cast(step.schema["reported"].dataType).alias("reported"), F.lit(True).alias("first"))
    rows = rows.unionByName(step.filter("auction IS NOT NULL AND bidder IS NOT NULL").select("auction", "bidder", "reported", F.lit(False).alias("first")))
    schema = known.schema

    def run(rows: pa.Table) -> pa.Table:
        first = rows.column("first").to_numpy()
        both = pa.concat_arrays([*rows.column("bidder").chunks, *rows.column("reported").cast(rows.column("bidder").type).chunks])
        code = both.dictionary_encode(null_encoding="encode")
        names = code.indices.to_numpy()
        src, dst = names[: len(first)][~first], names[len(first) :][~first]
        n = len(code.dictionary)
        start, target = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))]).tolist(), dst[np.argsort(src, kind="stable")].tolist()
        left = np.unique(names[: len(first)][first]).tolist()
        seen = set(left)
        while left:
            v = left.pop()
            for w in target[start[v] : start[v + 1]]:
                if w not in seen:
                    seen.add(w)
                    left.append(w)
        own = code.dictionary.take(pa.array(sorted(seen), pa.int64()))
        return pa.table({"auction": rows.column("auction").combine_chunks().take(pa.array(np.zeros(len(own), np.int64))), "bidder": own})

    ship(known.sparkSession)
    return rows.groupBy("auction").applyInArrow(run, schema)


def reached(seller: DataFrame, reports: DataFrame, max_hops: int | None = 2, plan: str | None = None) -> DataFrame:
    """(auction, bidder): those the seller's news can reach, over at most max_hops reports (None: any number).

    Any number: each auction of at most LOCAL_ARCS reports is searched in one task; if one has more (or plan="joins"), by joins of HOPS_A_ROUND hops.
    """
    from netloom.plans.loop import materialized

    known = seller.select("auction", "bidder").distinct()
    step = reports.select("auction", "bidder", "reported")
    if max_hops is not None:
        frontier = known
        for _ in range(max_hops):
            frontier = frontier.join(step, ["auction", "bidder"]).select("auction", F.col("reported").alias("bidder"))
            known = known.unionByName(frontier)
        return known.distinct()
    if plan != "joins" and (step.groupBy("auction").count().agg(F.max("count")).first()[0] or 0) <= LOCAL_ARCS:
        return _closed(known, step)
    frontier = known = materialized(known)
    while not frontier.isEmpty():
        found, ahead = None, frontier
        for _ in range(HOPS_A_ROUND):
            ahead = ahead.join(step, ["auction", "bidder"]).select("auction", F.col("reported").alias("bidder")).distinct()
            found = ahead if found is None else found.unionByName(ahead)
        frontier = materialized(found.distinct().join(known, ["auction", "bidder"], "left_anti"))
        known = materialized(known.unionByName(frontier))
    return known


def by_priority(df: DataFrame, *priority: Column | str, group: list[str] | None = None, take: int | None = None) -> DataFrame:
    """df with place: the order in which a queue would give its rows, least priority first, later columns breaking ties; per group if given. take: only so many."""
    if group is None and take is not None:
        first = df.orderBy(*priority).limit(take)
        return first.withColumn("place", F.row_number().over(Window.orderBy(*priority)).cast("long"))
    ranked = df.withColumn("place", F.row_number().over(Window.partitionBy(*(group or [F.lit(0)])).orderBy(*priority)).cast("long"))
    return ranked if take is None else ranked.filter(F.col("place") <= take)
