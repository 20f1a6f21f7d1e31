"""Triangles, clustering coefficients and the edge-scan estimate of the diameter."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.graph import Graph
from netloom.plans.loop import materialized

from .matrix import compact, fits, in_one_task
from .primitives import out_degrees


def triangles(graph: Graph) -> DataFrame:
    """(a, b, c, ab, ba, ac, ca, bc, cb): each triangle of the graph without directions once, and which arcs it has.

    Each edge points to its end of the greater (degree, id), so no vertex starts more than sqrt(2 m) of them and wedges stay
    below m ** 1.5 whatever the hubs. Loops are left out.
    """
    arcs = graph.arcs().select("src", "dst")
    pairs = arcs.groupBy(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).agg(F.max((F.col("src") < F.col("dst")).cast("int")).alias("f"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("r"))
    degree = pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ranked = pairs.join(degree.select(F.col("id").alias("x"), F.col("n").alias("nx")), "x").join(degree.select(F.col("id").alias("y"), F.col("n").alias("ny")), "y")
    up = F.struct("nx", "x") < F.struct("ny", "y")
    pick = lambda p, q: F.when(up, F.col(p)).otherwise(F.col(q))
    out = ranked.select(pick("x", "y").alias("u"), pick("y", "x").alias("v"), pick("ny", "nx").alias("nv"), pick("f", "r").alias("f"), pick("r", "f").alias("r"))
    one = out.select(F.col("u").alias("a"), F.col("v").alias("b"), F.col("nv").alias("nb"), F.col("f").alias("ab"), F.col("r").alias("ba"))
    two = out.select(F.col("u").alias("a"), F.col("v").alias("c"), F.col("nv").alias("nc"), F.col("f").alias("ac"), F.col("r").alias("ca"))
    wedges = one.join(two, "a").filter(F.struct("nb", "b") < F.struct("nc", "c")).drop("nb", "nc")
    last = out.select(F.col("u").alias("b"), F.col("v").alias("c"), F.col("f").alias("bc"), F.col("r").alias("cb"))
    return wedges.join(last, ["b", "c"]).select("a", "b", "c", "ab", "ba", "ac", "ca", "bc", "cb")


def _cycles() -> Column:
    return F.col("ab") * F.col("bc") * F.col("ca") + F.col("ac") * F.col("cb") * F.col("ba")


def _through(x: str, y: str, z: str) -> Column:
    """Whether x -> y -> z and x -> z."""
    return F.col(x + y) * F.col(y + z) * F.col(x + z)


def _middle(y: str) -> Column:
    x, z = (v for v in "abc" if v != y)
    return _through(x, y, z) + _through(z, y, x)


def _counted(graph: Graph) -> DataFrame:
    """triangles() with n: how often each counts by the rule for directed graphs with heavy vertices (out-degree at least sqrt(m))."""
    found = triangles(graph)
    total = graph.arcs().agg(F.count(F.lit(1)).alias("m"))
    heavy = out_degrees(Graph(graph.vertices, graph.edges.filter("src != dst"), True)).join(F.broadcast(total)).filter(F.col("degree") >= F.sqrt("m")).select("id")
    for v in "abc":
        found = found.join(heavy.select(F.col("id").alias(v), F.lit(1).alias(f"h{v}")), v, "left").withColumn(f"h{v}", F.coalesce(f"h{v}", F.lit(0)))
    all_heavy, cycles = F.col("ha") + F.col("hb") + F.col("hc"), _cycles()
    transitive = sum((_middle(v) for v in "bc"), _middle("a"))
    own_middle = sum(((1 - F.col(f"h{v}")) * _middle(v) for v in "bc"), (1 - F.col("ha")) * _middle("a"))
    light = (cycles > 0) | F.when(all_heavy == 2, transitive > own_middle).otherwise(transitive > 0)
    return found.withColumn("n", F.when(all_heavy == 3, cycles).otherwise(light.cast("int")))


def num_triangles(graph: Graph) -> DataFrame:
    """One row (triangles). Directed graphs follow the mixed rule: cycles among heavy vertices, else one for a cyclic or transitive triple."""
    if not graph.directed:
        return triangles(graph).agg(F.count(F.lit(1)).alias("triangles"))
    return _counted(graph).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("triangles"))


def cyclic_triangles(graph: Graph) -> DataFrame:
    """One row (triangles): directed cycles of three."""
    return triangles(graph).agg(F.coalesce(F.sum(_cycles()), F.lit(0)).cast("long").alias("triangles"))


def transitive_triads(graph: Graph) -> DataFrame:
    """One row (triads): (x, y, z) with x -> y -> z and x -> z."""
    return triangles(graph).agg(F.coalesce(F.sum(sum((_middle(v) for v in "bc"), _middle("a"))), F.lit(0)).cast("long").alias("triads"))


def clustering_coefficient(graph: Graph, semantics: str = "canonical") -> DataFrame:
    """(id, coefficient): undirected 2 T / (d (d - 1)).

    Directed: T over 2 (D (D - 1) - 2 R) with D = in + out, R arcs that go both ways and T all directed triangles at the vertex; or
    with semantics="reference" T / (2 D (D - 1) - 2 / D) and T by the rule of num_triangles. 0 where D is at most 1. Loops are left out.
    """
    if not graph.directed:
        found = triangles(graph).select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
        d = graph.arcs().groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        out = graph.vertices.join(d, "id", "left").join(found, "id", "left")
        c = 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))
        return out.select("id", F.when(F.col("d") > 1, c).otherwise(0.0).alias("coefficient"))
    arcs = graph.arcs().select("src", "dst")
    both = arcs.join(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("rec"))
    d = arcs.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    if semantics == "reference":
        weight, source = F.col("n"), _counted(graph)
        c = F.col("t") / (2 * F.col("d") * (F.col("d") - 1) - 2 / F.col("d"))
    elif semantics == "canonical":
        weight, source = 2 * (F.col("ab") + F.col("ba")) * (F.col("ac") + F.col("ca")) * (F.col("bc") + F.col("cb")), triangles(graph)
        room = F.col("d") * (F.col("d") - 1) - 2 * F.coalesce("rec", F.lit(0))
        c = F.when(room > 0, F.col("t") / (2 * room)).otherwise(0.0)
    else:
        raise ValueError(semantics)
    found = source.select(F.explode(F.array("a", "b", "c")).alias("id"), weight.alias("w")).groupBy("id").agg(F.sum("w").alias("t"))
    out = graph.vertices.join(d, "id", "left").join(found, "id", "left").join(both, "id", "left").withColumn("t", F.coalesce("t", F.lit(0)))
    return out.select("id", F.when(F.col("d") > 1, c).otherwise(0.0).cast("double").alias("coefficient"))


def average_clustering(graph: Graph, semantics: str = "canonical") -> DataFrame:
    return clustering_coefficient(graph, semantics).agg(F.avg("coefficient").alias("average"))


def stream_diameter(graph: Graph, plan: str | None = None) -> DataFrame:
    """One row (rounds): rounds until the greatest degree (in + out if directed) no longer spreads, the last, without change, counted.

    All vertices change at once; arcs work both ways. A graph of checked size is walked as arrays in one task, a larger one (or
    plan="joins") by a join a round.
    """
    if plan != "joins" and fits(graph):
        c = compact(graph, loops=True)

        def make() -> pa.RecordBatch:
            u, v = c.sources(), c.target
            loops = np.bincount(u[u == v], minlength=c.n)
            r = np.diff(c.start) + (np.bincount(v, minlength=c.n) if c.directed else loops)
            rounds, changed = 0, True
            while changed:
                new = r.copy()
                np.maximum.at(new, v, r[u])
                np.maximum.at(new, u, r[v])
                rounds, changed, r = rounds + 1, bool((new != r).any()), new
            return pa.record_batch([pa.array([rounds], pa.int64())], ["rounds"])

        return in_one_task(graph.vertices.sparkSession, make, "rounds long")
    arcs = graph.undirected().arcs().select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("r"))
    state = materialized(graph.vertices.join(ends, "id", "left").select("id", F.coalesce("r", F.lit(0)).alias("r")))
    rounds = 0
    while True:
        rounds += 1
        near = arcs.join(state, arcs["dst"] == state["id"]).groupBy("src").agg(F.max("r").alias("near"))
        new = materialized(state.join(near, state["id"] == near["src"], "left").select("id", F.col("r").alias("old"), F.greatest("r", "near").alias("r")))
        state = new.select("id", "r")
        if new.filter("r != old").isEmpty():
            break
    arcs.unpersist()
    return graph.vertices.sparkSession.createDataFrame([(rounds,)], "rounds long")


def stream_diameter_in_order(graph: Graph, order: DataFrame) -> DataFrame:
    """One row (rounds), edges scanned in the order of order(src, dst, pos), each setting both its ends at once. For graphs of checked size."""
    if not fits(graph):
        raise ValueError("an ordered scan is sequential; it is made for graphs of bounded size")
    rows = graph.edges.select("src", "dst").join(order, ["src", "dst"]).orderBy("pos").toArrow()
    src, dst = (rows.column(c).to_pylist() for c in ("src", "dst"))

    def make() -> pa.RecordBatch:
        ids = {v: k for k, v in enumerate(dict.fromkeys(src + dst))}
        u, v = np.array([ids[x] for x in src], int), np.array([ids[x] for x in dst], int)
        r = np.bincount(np.concatenate([u, v]), minlength=len(ids)).tolist() if ids else []
        rounds, changed = 0, True
        while changed:
            rounds, changed = rounds + 1, False
            for a, b in zip(u, v, strict=True):
                if r[a] != r[b]:
                    r[a] = r[b] = max(r[a], r[b])
                    changed = True
        return pa.record_batch([pa.array([rounds], pa.int64())], ["rounds"])

    return in_one_task(graph.vertices.sparkSession, make, "rounds long")
