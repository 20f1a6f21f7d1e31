"""Degree, Shapley degree and threshold values, PageRank, HITS and VoteRank."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.graph import Graph
from netloom.plans.loop import materialized

from .matrix import compact, fits, id_type, in_one_task
from .paths import runs

#: Arcs up to which VoteRank elects in one task: some 100 MB of arrays, and twice that on the driver.
VOTE_ARCS = 12_000_000
#: Steps of an iteration between two cuts of its lineage.
CUT = 5


def _of(df: DataFrame, sample: DataFrame | None) -> DataFrame:
    return df if sample is None else df.join(sample.select("id").distinct(), "id", "left_semi")


def _both_degrees(graph: Graph, loops: bool = True) -> DataFrame:
    """(id, in_degree, out_degree) of a directed graph: one pass over the arcs, summed before the shuffle."""
    arcs = graph.edges if loops else graph.edges.filter("src != dst")
    ends = arcs.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("i"), F.sum("o").alias("o"))
    return graph.vertices.join(sums, "id", "left").select("id", F.coalesce("i", F.lit(0)).cast("long").alias("in_degree"), F.coalesce("o", F.lit(0)).cast("long").alias("out_degree"))


def _degrees(graph: Graph) -> DataFrame:
    """(id, degree) of an undirected graph; a loop counts 2."""
    ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return graph.vertices.join(ends, "id", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))


def degree(graph: Graph, sample: DataFrame | None = None) -> DataFrame:
    """(id, degree), or (id, in_degree, out_degree) of a directed graph."""
    return _of(_both_degrees(graph) if graph.directed else _degrees(graph), sample)


def _neighbour_sum(graph: Graph, values: DataFrame, toward: str = "dst") -> DataFrame:
    """(id, total): sum of values(id, x) over successors, or over predecessors with toward="src"."""
    here = "src" if toward == "dst" else "dst"
    arcs = graph.arcs(loops=True).select(F.col(here).alias("at"), F.col(toward).alias("id"))
    return arcs.join(values, "id").groupBy(F.col("at").alias("id")).agg(F.sum("x").alias("total"))


def _with(base: DataFrame, totals: dict[str, DataFrame]) -> DataFrame:
    for name, df in totals.items():
        base = base.join(df.withColumnRenamed("total", name), "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return base


def shapley_degree(graph: Graph, sample: DataFrame | None = None) -> DataFrame:
    """(id, shapley): 1 / (1 + degree), of the vertex and summed over its neighbours.

    Directed: (id, in_shapley, out_shapley), with in- and with out-degrees, both summed over successors.
    """
    if not graph.directed:
        d = _degrees(graph)
        one = 1 / (1 + F.col("degree"))
        out = _with(d.select("id", one.alias("own")), {"more": _neighbour_sum(graph, d.select("id", one.alias("x")))})
        return _of(out.select("id", (F.col("own") + F.col("more")).alias("shapley")), sample)
    d = _both_degrees(graph)
    own = {k: 1 / (1 + F.col(f"{k}_degree")) for k in ("in", "out")}
    out = _with(d.select("id", own["in"].alias("i"), own["out"].alias("o")), {k: _neighbour_sum(graph, d.select("id", own[k].alias("x"))) for k in own})
    return _of(out.select("id", (F.col("i") + F.col("in")).alias("in_shapley"), (F.col("o") + F.col("out")).alias("out_shapley")), sample)


def shapley_threshold(graph: Graph, k: int = 2, sample: DataFrame | None = None, semantics: str = "canonical") -> DataFrame:
    """(id, shapley): value in the game in which a vertex counts once it has k neighbours in the set.

    min(1, k / (1 + degree)) and, over neighbours v, max(0, (d - k + 1) / d) / (1 + degree of v), where d is the degree of
    v (canonical) or of the vertex itself (semantics="reference"); 0 where that degree is 0. Directed: (id, in_shapley, out_shapley), over
    predecessors with in-degrees and over successors with out-degrees.
    """
    if semantics not in ("canonical", "reference"):
        raise ValueError(semantics)

    def one(d: DataFrame, toward: str) -> DataFrame:
        n = F.col("degree")
        share = F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (n - k + 1) / n))
        x = share / (1 + n) if semantics == "canonical" else 1 / (1 + n)
        out = _with(d, {"more": _neighbour_sum(graph, d.select("id", x.alias("x")), toward)})
        more = F.col("more") if semantics == "canonical" else share * F.col("more")
        return out.select("id", (F.least(F.lit(1.0), F.lit(float(k)) / (1 + n)) + more).alias("shapley"))

    if not graph.directed:
        return _of(one(_degrees(graph), "dst"), sample)
    d = _both_degrees(graph)
    into = one(d.select("id", F.col("in_degree").alias("degree")), "src").withColumnRenamed("shapley", "in_shapley")
    out = one(d.select("id", F.col("out_degree").alias("degree")), "dst").withColumnRenamed("shapley", "out_shapley")
    return _of(into.join(out, "id"), sample)


def _arcs_with_share(graph: Graph) -> DataFrame:
    """(src, dst, share): arcs with 1 / out-degree of the source, kept for a loop."""
    arcs = graph.arcs(loops=True).select("src", "dst")
    shares = arcs.groupBy("src").agg((1.0 / F.count(F.lit(1))).alias("share"))
    return arcs.join(shares, "src").repartition("src").persist(StorageLevel.MEMORY_AND_DISK)


def pagerank(graph: Graph, damping: float = 0.85, steps: int = 75, confidence: float = 0.0, semantics: str = "canonical", dangling: bool = False, plan: str | None = None) -> DataFrame:
    """(id, rank) after `steps` steps, or fewer if the ranks' absolute changes add up to at most confidence.

    rank = (1 - damping) / n + damping * (sum over arcs of rank / out-degree); semantics="reference" leaves the factor out, so that the mass
    grows. What vertices without arcs hold is dropped, or dealt to all with dangling=True. A confidence of 0 would stop at
    an exact fixed point only, where more steps change nothing; it isn't tested. A graph of checked size is iterated as arrays in
    one task, a larger one (or plan="joins") by a join a step.
    """
    if plan != "joins" and fits(graph):
        c = compact(graph, loops=True)
        factor = damping if semantics == "canonical" else 1.0

        def make() -> pa.RecordBatch:
            src, out = c.sources(), np.diff(c.start)
            rank = np.full(c.n, 1.0 / max(c.n, 1))
            for _ in range(steps if c.n else 0):
                lost = rank[out == 0].sum() / c.n if dangling else 0.0
                new = (1 - damping) / c.n + factor * (np.bincount(c.target, (rank / np.maximum(out, 1))[src], c.n) + lost)
                change, rank = np.abs(new - rank).sum(), new
                if 0 < confidence and change <= confidence:
                    break
            return pa.record_batch([c.ids, pa.array(rank)], ["id", "rank"])

        return in_one_task(graph.vertices.sparkSession, make, f"id {id_type(graph)}, rank double")
    vertices = materialized(graph.vertices)
    n = vertices.count()
    if not n:
        return vertices.select("id", F.lit(0.0).alias("rank"))
    arcs = _arcs_with_share(graph)
    factor = damping if semantics == "canonical" else 1.0
    ranks = vertices.select("id", F.lit(1.0 / n).alias("rank"))
    try:
        for step in range(1, steps + 1):
            sums = arcs.join(ranks, arcs["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("x"))
            base: Column | float = (1 - damping) / n
            new = vertices.join(sums, vertices["id"] == sums["dst"], "left")
            if dangling:
                lost = ranks.join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
                new, base = new.join(F.broadcast(lost)), base + F.lit(factor / n) * F.col("lost")
            new = new.select("id", (base + F.lit(factor) * F.coalesce("x", F.lit(0.0))).alias("rank"))
            if confidence > 0:
                both = materialized(new.join(ranks.withColumnRenamed("rank", "old"), "id"))
                ranks = both.select("id", "rank")
                if both.agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0] <= confidence:
                    break
            else:
                ranks = materialized(new) if step % CUT == 0 or dangling else new
        return materialized(ranks)
    finally:
        arcs.unpersist()


def hits(graph: Graph, steps: int = 75, confidence: float = 0.0, authority_weight: float = 0.5, hub_weight: float = 0.5, plan: str | None = None) -> DataFrame:
    """(id, score, hub, authority): both from the step before, each scaled to sum 1; score is the weighted sum of the two.

    A graph without arcs has zeros. Stops early if both measures' absolute changes add up to at most confidence (above 0). A graph of
    checked size is iterated as arrays in one task, a larger one (or plan="joins") by a join a step.
    """
    score = (authority_weight * F.col("authority") + hub_weight * F.col("hub")).alias("score")
    if plan != "joins" and fits(graph):
        c = compact(graph, loops=True)

        def make() -> pa.RecordBatch:
            src = c.sources()
            scaled = lambda x: x / x.sum() if x.sum() else np.zeros(c.n)
            hub = authority = np.full(c.n, 1.0 / max(c.n, 1))
            for _ in range(steps):
                new = scaled(np.bincount(src, authority[c.target], c.n)), scaled(np.bincount(c.target, hub[src], c.n))
                change = max(np.abs(new[0] - hub).sum(), np.abs(new[1] - authority).sum())
                hub, authority = new
                if 0 < confidence and change <= confidence:
                    break
            return pa.record_batch([c.ids, pa.array(hub), pa.array(authority)], ["id", "hub", "authority"])

        return in_one_task(graph.vertices.sparkSession, make, f"id {id_type(graph)}, hub double, authority double").select("id", score, "hub", "authority")
    vertices = materialized(graph.vertices)
    n = vertices.count()
    # Each arc carries a hub value ahead and an authority value back: one join and one exchange a step.
    ahead = graph.arcs(loops=True).select("src", "dst")
    both = ahead.select("src", "dst", F.lit(True).alias("ahead")).unionByName(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(False).alias("ahead")))
    both = both.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
    state = vertices.select("id", F.lit(1.0 / max(n, 1)).alias("hub"), F.lit(1.0 / max(n, 1)).alias("authority"))
    part = lambda x, t: F.coalesce(F.col(x) / F.when(F.col(t) != 0, F.col(t)), F.lit(0.0)).alias(x)
    try:
        for step in range(1, steps + 1):
            sent = both.join(state, both["src"] == state["id"])
            sums = sent.groupBy("dst").agg(F.sum(F.when(F.col("ahead"), F.col("hub")).otherwise(0.0)).alias("a"), F.sum(F.when(F.col("ahead"), 0.0).otherwise(F.col("authority"))).alias("h"))
            new = vertices.join(sums, vertices["id"] == sums["dst"], "left").select("id", F.coalesce("h", F.lit(0.0)).alias("hub"), F.coalesce("a", F.lit(0.0)).alias("authority"))
            # The step is linear, so the scale can wait for the next cut; it grows by at most the degrees until then.
            if confidence > 0 or step % CUT == 0 or step == steps:
                new = materialized(new)
                total = new.agg(F.sum("hub").alias("th"), F.sum("authority").alias("ta"))
                new = new.join(F.broadcast(total)).select("id", part("hub", "th"), part("authority", "ta"))
                if confidence > 0:
                    pair = materialized(new.join(state.select("id", F.col("hub").alias("oh"), F.col("authority").alias("oa")), "id"))
                    new = pair.select("id", "hub", "authority")
                    change = pair.agg(F.sum(F.abs(F.col("hub") - F.col("oh"))), F.sum(F.abs(F.col("authority") - F.col("oa")))).first()
                    if max(change[0] or 0, change[1] or 0) <= confidence:
                        state = new
                        break
            state = new
        state = materialized(state)
    finally:
        both.unpersist()
    return state.select("id", score, "hub", "authority")


def hits_both(graph: Graph, steps: int = 75, confidence: float = 0.0, authority_weight: float = 0.5, hub_weight: float = 0.5) -> DataFrame:
    return hits(graph, steps, confidence, authority_weight, hub_weight).select("id", "score")


def hits_hubbiness(graph: Graph, steps: int = 75, confidence: float = 0.0) -> DataFrame:
    return hits(graph, steps, confidence).select("id", "hub")


def hits_authority(graph: Graph, steps: int = 75, confidence: float = 0.0) -> DataFrame:
    return hits(graph, steps, confidence).select("id", "authority")


def vote_rank(graph: Graph, top_k: int | None = None, plan: str | None = None) -> DataFrame:
    """(id, rank): the first elected has rank n, the next n - 1, and so on; top_k: only the first so many.

    Each round the vertices not yet elected give their ability (1 at first) to their successors not yet elected; the one with
    the greatest sum, the least id among equals, is elected. Its ability is 0 from then on, and that of each vertex with an arc to it
    falls by 1 / (average out-degree), not below 0. Loops are left out. Elections follow one another, so a graph of checked size is elected
    in one task; a larger one by a join a round, for which top_k should be given.
    """
    n, m = graph.vertices.count(), graph.arcs().count()
    take = n if top_k is None else min(top_k, n)
    fall = n / m if m else 0.0
    kind, spark = id_type(graph), graph.vertices.sparkSession
    if plan != "joins" and fits(graph, VOTE_ARCS):
        c = compact(graph)

        def make() -> pa.RecordBatch:
            back = c.reverse()
            ability, free = np.ones(c.n), np.ones(c.n, bool)
            score = np.bincount(c.target, minlength=c.n).astype(float)
            shown = np.round(score, 9)  # -1 for the elected
            chosen = []
            for _ in range(take):
                v = int(np.argmax(shown))
                chosen.append(v)
                free[v], shown[v] = False, -1.0
                near = back.target[back.start[v] : back.start[v + 1]]
                near = near[free[near]]  # the elected have none left
                change = np.append(np.maximum(ability[near] - fall, 0) - ability[near], -ability[v])
                near = np.append(near, v)
                near, change = near[change != 0], change[change != 0]
                ability[near] += change
                place, _ = runs(c.start, near)
                hit = c.target[place]
                np.add.at(score, hit, np.repeat(change, c.start[near + 1] - c.start[near]))
                shown[hit] = np.where(free[hit], np.round(score[hit], 9), -1.0)
            return pa.record_batch([c.ids.take(pa.array(chosen, pa.int64())), pa.array(n - np.arange(take), pa.int64())], ["id", "rank"])

        return in_one_task(spark, make, f"id {kind}, rank long")
    arcs = graph.arcs().select("src", "dst").persist(StorageLevel.MEMORY_AND_DISK)
    state = materialized(graph.vertices.select("id", F.lit(1.0).alias("ability"), F.lit(None).cast("long").alias("rank")))
    for i in range(take):
        free = state.filter("rank IS NULL")
        sums = arcs.join(free.select(F.col("id").alias("src"), "ability"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("ability").alias("votes"))
        best = free.join(sums, "id", "left").select("id", F.round(F.coalesce("votes", F.lit(0.0)), 9).alias("votes")).orderBy(F.desc("votes"), "id").limit(1)
        chosen = best.first()["id"]
        hit = arcs.filter(F.col("dst") == F.lit(chosen)).select(F.col("src").alias("id"), F.lit(1).alias("hit"))
        ability = F.when(F.col("id") == F.lit(chosen), 0.0).when(F.col("hit") == 1, F.greatest(F.lit(0.0), F.col("ability") - fall)).otherwise(F.col("ability"))
        rank = F.when(F.col("id") == F.lit(chosen), F.lit(n - i).cast("long")).otherwise(F.col("rank"))
        state = materialized(state.join(hit, "id", "left").select("id", ability.alias("ability"), rank.alias("rank")))
    arcs.unpersist()
    return state.filter("rank IS NOT NULL").select("id", "rank")
