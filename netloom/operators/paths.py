"""Shortest paths from many sources, and the measures that come from them.

A graph of checked size is broadcast as compact arrays and each task searches from its own sources, so that only
sums leave a task. A larger graph stays a table: frontiers of all sources advance by one join a level.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import exponential_decay
from netloom.graph import Graph
from netloom.plans.loop import materialized

from .matrix import Compact, arrow_id, compact, fits, id_type, over_sources

LOCAL, JOINS = "local", "joins"


def plan_for(graph: Graph, plan: str | None) -> str:
    return plan or (LOCAL if fits(graph) else JOINS)


def source_numbers(c: Compact, sample: DataFrame | None) -> np.ndarray:
    """Numbers of the sample's ids (all vertices without one); ids that aren't vertices are left out."""
    if sample is None:
        return np.arange(c.n)
    ids = sample.select("id").distinct().toArrow().column("id").combine_chunks().cast(c.ids.type)
    found = pa.compute.index_in(ids, c.ids)
    return np.sort(found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))


def runs(start: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all arcs that leave `at`, the vertex of each)."""
    size = start[at + 1] - start[at]
    total = int(size.sum())
    ends = np.cumsum(size)
    return np.arange(total) + np.repeat(start[at] - (ends - size), size), np.repeat(at, size)


def search(c: Compact, s: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(distance of each vertex, -1 if not reached; the vertices of each level)."""
    far = np.full(c.n, -1, np.int32)
    far[s] = 0
    levels = [np.array([s])]
    while len(levels[-1]):
        place, _ = runs(c.start, levels[-1])
        near = c.target[place]
        near = np.unique(near[far[near] < 0])
        far[near] = len(levels)
        levels.append(near)
    return far, levels[:-1]


def search_weighted(c: Compact, weight: np.ndarray, s: int) -> np.ndarray:
    """Distances with arc lengths, infinite if not reached."""
    far = np.full(c.n, np.inf)
    far[s] = 0
    heap = [(0.0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        if d > far[u]:
            continue
        for k in range(c.start[u], c.start[u + 1]):
            v, e = int(c.target[k]), d + weight[k]
            if e < far[v]:
                far[v] = e
                heapq.heappush(heap, (e, v))
    return far


def path_counts(c: Compact, levels: list[np.ndarray], far: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """(number of shortest paths to each vertex, by level the arcs on them: place, from, to)."""
    sigma = np.zeros(c.n)
    sigma[levels[0]] = 1
    arcs = []
    for k, level in enumerate(levels):
        place, u = runs(c.start, level)
        v = c.target[place]
        on = far[v] == k + 1
        place, u, v = place[on], u[on], v[on]
        arcs.append((place, u, v))
        sigma += np.bincount(v, sigma[u], c.n)
    return sigma, arcs


def all_pairs(graph: Graph, sources: DataFrame | None = None, with_sigma: bool = False, plan: str | None = None) -> DataFrame:
    """(s, v, d[, sigma]): distance from each source to each vertex it reaches, itself included, and the number of shortest paths."""
    kind = id_type(graph)
    schema = f"s {kind}, v {kind}, d int" + (", sigma double" if with_sigma else "")
    if plan_for(graph, plan) == LOCAL:
        c = compact(graph)

        def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for s in part:
                    far, levels = search(c, int(s))
                    v = np.concatenate(levels)
                    cols = [arrow_id(c.ids, np.full(len(v), s)), arrow_id(c.ids, v), pa.array(far[v])]
                    if with_sigma:
                        cols.append(pa.array(path_counts(c, levels, far)[0][v]))
                    yield pa.record_batch(cols, ["s", "v", "d", "sigma"][: len(cols)])

        return over_sources(graph.vertices.sparkSession, c, source_numbers(c, sources), run, schema)
    arcs = graph.arcs().select(F.col("src").alias("v"), F.col("dst").alias("w"))
    start = graph.vertices if sources is None else graph.vertices.join(sources.select("id").distinct(), "id", "left_semi")
    frontier = seen = materialized(start.select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("sigma")))
    d = 0
    while not frontier.isEmpty():
        d += 1
        step = frontier.join(arcs, "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("sigma").alias("sigma"))
        frontier = materialized(step.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "sigma"))
        seen = seen.unionByName(frontier)
    return seen if with_sigma else seen.drop("sigma")


def closeness(graph: Graph, sample: DataFrame | None = None, plan: str | None = None) -> DataFrame:
    """(id, closeness): sum of distances to the vertices that are reached; lower is more central, 0 if none is."""
    if plan_for(graph, plan) == JOINS:
        return all_pairs(graph, sample, plan=JOINS).groupBy(F.col("s").alias("id")).agg(F.sum("d").cast("long").alias("closeness"))
    c = compact(graph)

    def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            total = [sum(k * len(x) for k, x in enumerate(search(c, int(s))[1])) for s in part]
            yield pa.record_batch([arrow_id(c.ids, part), pa.array(total, pa.int64())], ["id", "closeness"])

    return over_sources(graph.vertices.sparkSession, c, source_numbers(c, sample), run, f"id {id_type(graph)}, closeness long")


def diameter(graph: Graph, sample: DataFrame | None = None, on_disconnected: str = "null", plan: str | None = None) -> DataFrame:
    """One row (diameter): the greatest distance from a source.

    If some vertex isn't reached from a source: null, the greatest finite distance ("reachable"), or an error ("error").
    """
    if on_disconnected not in ("null", "reachable", "error"):
        raise ValueError(on_disconnected)
    if plan_for(graph, plan) == JOINS:
        each = all_pairs(graph, sample, plan=JOINS).groupBy("s").agg(F.max("d").alias("d"), F.count(F.lit(1)).alias("n"))
    else:
        c = compact(graph)

        def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                found = [search(c, int(s))[1] for s in part]
                yield pa.record_batch([pa.array([len(x) - 1 for x in found], pa.int32()), pa.array([sum(map(len, x)) for x in found], pa.int64())], ["d", "n"])

        each = over_sources(graph.vertices.sparkSession, c, source_numbers(c, sample), run, "d int, n long")
    total = graph.vertices.agg(F.count(F.lit(1)).alias("all"))
    out = each.agg(F.max("d").cast("long").alias("d"), F.min("n").alias("n")).join(F.broadcast(total))
    if on_disconnected == "reachable":
        return out.select(F.col("d").alias("diameter"))
    other = F.raise_error("the graph isn't connected").cast("long") if on_disconnected == "error" else F.lit(None).cast("long")
    return out.select(F.when(F.col("n") == F.col("all"), F.col("d")).otherwise(other).alias("diameter"))


def betweenness(graph: Graph, sample: DataFrame | None = None, plan: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges: src, dst, betweenness; nodes: id, betweenness).

    From each source every vertex sends one unit back along its shortest paths, split by their numbers. An edge (direction
    erased, src <= dst) has what passes over it, a vertex what passes through it and its own unit, except as a source. No scaling.
    """
    kind, spark = id_type(graph), graph.vertices.sparkSession
    if plan_for(graph, plan) == JOINS:
        return _betweenness_by_joins(graph, sample)
    c = compact(graph)

    def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        over, through = np.zeros(len(c.target)), np.zeros(c.n)
        for part in parts:
            for s in part:
                far, levels = search(c, int(s))
                sigma, arcs = path_counts(c, levels, far)
                flow = np.ones(c.n)
                for place, u, v in reversed(arcs):
                    passed = flow[v] * sigma[u] / sigma[v]
                    over[place] += passed
                    flow += np.bincount(u, passed, c.n)
                reached = np.concatenate(levels[1:]) if len(levels) > 1 else np.zeros(0, np.int64)
                through[reached] += flow[reached]
        e, v = np.flatnonzero(over), np.flatnonzero(through)
        src, dst = c.sources()[e], c.target[e]
        yield pa.record_batch([arrow_id(c.ids, np.minimum(src, dst)), arrow_id(c.ids, np.maximum(src, dst)), pa.array(over[e])], ["src", "dst", "b"])
        yield pa.record_batch([arrow_id(c.ids, v), pa.nulls(len(v), c.ids.type), pa.array(through[v])], ["src", "dst", "b"])

    parts = materialized(over_sources(spark, c, source_numbers(c, sample), run, f"src {kind}, dst {kind}, b double"))
    return _filled(graph, parts.filter("dst IS NOT NULL"), parts.filter("dst IS NULL").select(F.col("src").alias("id"), "b"))


def _filled(graph: Graph, over: DataFrame, through: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sums by edge and vertex, 0 where nothing passes."""
    keys = graph.edges.filter("src != dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    edges = keys.join(over.groupBy("src", "dst").agg(F.sum("b").alias("b")), ["src", "dst"], "left")
    nodes = graph.vertices.join(through.groupBy("id").agg(F.sum("b").alias("b")), "id", "left")
    return edges.select("src", "dst", F.coalesce("b", F.lit(0.0)).alias("betweenness")), nodes.select("id", F.coalesce("b", F.lit(0.0)).alias("betweenness"))


def _betweenness_by_joins(graph: Graph, sample: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    paths = materialized(all_pairs(graph, sample, with_sigma=True, plan=JOINS))
    arcs = graph.arcs().select(F.col("src").alias("v"), F.col("dst").alias("w"))
    below = paths.select("s", F.col("v").alias("w"), F.col("d").alias("dw"), F.col("sigma").alias("sw"))
    deepest = paths.agg(F.max("d")).first()[0] or 0
    flow = materialized(paths.filter(F.col("d") == deepest).select("s", "v", "d", F.lit(1.0).alias("flow")))
    all_flow, over = [flow], []
    for d in range(deepest - 1, -1, -1):
        # what the vertices one level down hand to those of level d
        down = flow.select("s", F.col("v").alias("w"), "flow").join(below.filter(F.col("dw") == d + 1), ["s", "w"])
        passed = materialized(paths.filter(F.col("d") == d).join(arcs, "v").join(down, ["s", "w"]).select("s", "v", "w", (F.col("flow") * F.col("sigma") / F.col("sw")).alias("b")))
        over.append(passed)
        gained = passed.groupBy("s", "v").agg(F.sum("b").alias("b"))
        flow = materialized(paths.filter(F.col("d") == d).join(gained, ["s", "v"], "left").select("s", "v", "d", (F.lit(1.0) + F.coalesce("b", F.lit(0.0))).alias("flow")))
        all_flow.append(flow)
    spark, kind = graph.vertices.sparkSession, id_type(graph)
    sums = spark.createDataFrame([], f"src {kind}, dst {kind}, b double")
    for p in over:
        sums = sums.unionByName(p.select(F.least("v", "w").alias("src"), F.greatest("v", "w").alias("dst"), "b"))
    through = spark.createDataFrame([], f"id {kind}, b double")
    for f in all_flow:
        through = through.unionByName(f.filter("s != v").select(F.col("v").alias("id"), F.col("flow").alias("b")))
    return _filled(graph, sums, through)


def drawn(seed: int, *cols: str) -> Column:
    """A digest of seed and columns: an order that is as good as random, the same in every run and on every engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols]))


def sample_vertices(graph: Graph, size: int, seed: int = 0, strata: int = 1) -> DataFrame:
    """(id): min(size, n) vertices without replacement, or so many from each of `strata` parts. The seed fixes the choice."""
    rows = graph.vertices.select("id", drawn(seed, "id").alias("h"))
    if strata <= 1:
        return rows.orderBy("h", "id").limit(size).select("id")
    rows = rows.withColumn("part", F.conv(F.substring(drawn(seed + 1, "id"), 1, 4), 16, 10).cast("long") % strata)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("h", "id"))).filter(F.col("k") <= size).select("id")


def sampled_betweenness(graph: Graph, sample_size: int = 20_000, seed: int = 0, strata: int = 1, rescale: bool = False, plan: str | None = None) -> tuple[DataFrame, DataFrame]:
    """betweenness() from sampled sources; with strata, sample_size from each part of the vertices. rescale: times n / sources."""
    sample = materialized(sample_vertices(graph, sample_size, seed, strata))
    edges, nodes = betweenness(graph, sample, plan)
    if not rescale:
        return edges, nodes
    factor = graph.vertices.count() / max(1, sample.count())
    return tuple(df.withColumn("betweenness", F.col("betweenness") * factor) for df in (edges, nodes))


def shapley_closeness(graph: Graph, sample: DataFrame | None = None, decay: Callable[[Column], Column] = exponential_decay, weighted: bool = False, plan: str | None = None) -> DataFrame:
    """(id, shapley): Shapley value of the game in which a set is worth the decayed closeness of all vertices to it.

    For a source, a vertices closer than distance d and b up to it: each vertex at d > 0 gets f(d) / b less the later
    levels' f(d')(1/a' - 1/b'), the source f(0) less all of them. weighted: arc weights are lengths (missing: 1).
    Summed over all sources the values add up to n f(0).
    """
    kind, spark = id_type(graph), graph.vertices.sparkSession
    if weighted or plan_for(graph, plan) == LOCAL:
        if weighted and not fits(graph):
            raise ValueError("weighted distances are for graphs of bounded size")
        c = compact(graph)
        if weighted:
            return _shapley_weighted(graph, c, sample, decay)
        f = np.array([r[0] for r in spark.range(0, c.n + 1).orderBy("id").select(decay(F.col("id").cast("double"))).collect()], float)  # at most LOCAL_VERTICES

        def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
            value = np.zeros(c.n)
            for part in parts:
                for s in part:
                    _, levels = search(c, int(s))
                    add = level_values(np.array([len(x) for x in levels]), f[: len(levels)])
                    for x, a in zip(levels, add, strict=True):
                        value[x] += a
            yield pa.record_batch([c.ids, pa.array(value)], ["id", "b"])

        parts = over_sources(spark, c, source_numbers(c, sample), run, f"id {kind}, b double")
        return parts.groupBy("id").agg(F.sum("b").alias("shapley"))
    pairs = materialized(all_pairs(graph, sample, plan=JOINS))
    level = pairs.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"))
    by_d = Window.partitionBy("s").orderBy("d")
    level = level.withColumn("b", F.sum("n").over(by_d)).withColumn("a", F.col("b") - F.col("n")).withColumn("f", decay(F.col("d").cast("double")))
    level = level.withColumn("t", F.when(F.col("d") > 0, F.col("f") * (1 / F.col("a") - 1 / F.col("b"))).otherwise(0.0))
    level = level.withColumn("later", F.coalesce(F.sum("t").over(by_d.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    level = level.select("s", "d", (F.col("f") / F.when(F.col("d") > 0, F.col("b")).otherwise(1) - F.col("later")).alias("value"))
    sums = pairs.join(level, ["s", "d"]).groupBy(F.col("v").alias("id")).agg(F.sum("value").alias("shapley"))
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("shapley", F.lit(0.0)).alias("shapley"))


def level_values(size: np.ndarray, f: np.ndarray) -> np.ndarray:
    """What each vertex of each level gets from one source; the first level is the source alone."""
    b = np.cumsum(size)
    a = b - size
    t = np.zeros(len(size))
    t[1:] = f[1:] * (1 / a[1:] - 1 / b[1:])
    later = t[::-1].cumsum()[::-1] - t
    own = f / b
    own[0] = f[0]
    return own - later


def _shapley_weighted(graph: Graph, c: Compact, sample: DataFrame | None, decay: Callable[[Column], Column]) -> DataFrame:
    """Levels are groups of equal length; the decay is applied by Spark, between the searches and the sums."""
    arcs = graph.arcs().select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("w")).toArrow()
    number = lambda x: pa.compute.index_in(x.combine_chunks(), c.ids).to_numpy(zero_copy_only=False).astype(np.int64)
    src, dst, w = number(arcs.column("src")), number(arcs.column("dst")), arcs.column("w").to_numpy()
    weight = w[np.lexsort((dst, src))]
    if len(weight) and weight.min() < 0:
        raise ValueError("lengths must not be negative")
    kind = id_type(graph)

    def run(c: Compact, parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for s in part:
                far = search_weighted(c, weight, int(s))
                v = np.flatnonzero(np.isfinite(far))
                yield pa.record_batch([arrow_id(c.ids, np.full(len(v), s)), arrow_id(c.ids, v), pa.array(far[v])], ["s", "v", "d"])

    pairs = materialized(over_sources(graph.vertices.sparkSession, c, source_numbers(c, sample), run, f"s {kind}, v {kind}, d double"))
    level = pairs.groupBy("s", "d").agg(F.count(F.lit(1)).alias("n"))
    by_d = Window.partitionBy("s").orderBy("d")
    level = level.withColumn("b", F.sum("n").over(by_d)).withColumn("a", F.col("b") - F.col("n")).withColumn("f", decay(F.col("d")))
    level = level.withColumn("t", F.when(F.col("a") > 0, F.col("f") * (1 / F.col("a") - 1 / F.col("b"))).otherwise(0.0))
    level = level.withColumn("later", F.coalesce(F.sum("t").over(by_d.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    level = level.select("s", "d", (F.col("f") / F.when(F.col("a") > 0, F.col("b")).otherwise(1) - F.col("later")).alias("value"))
    sums = pairs.join(level, ["s", "d"]).groupBy(F.col("v").alias("id")).agg(F.sum("value").alias("shapley"))
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("shapley", F.lit(0.0)).alias("shapley"))
