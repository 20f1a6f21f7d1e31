"""Influence bandits: arms are vertices, an arm's reward is how many arcs out of it are alive.

Arcs are alive or not for a whole simulation, by their weight. Simulations are rows like others; learners, which choose
by what they have seen, run as one group for each simulation.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.functions import epsilon_schedule
from netloom.graph import Graph
from netloom.plans.ship import ship

from .paths import drawn


def alive_arcs(graph: Graph, simulations: int, seed: int = 0) -> DataFrame:
    """(sim, src, dst): arcs that are alive in each simulation; an undirected edge is so both ways. A missing weight counts as 0.

    The draw is a hash of seed, simulation and edge, so a task that is run again draws the same.
    """
    edges = graph.edges.select("src", "dst", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sims = graph.edges.sparkSession.range(simulations).withColumnRenamed("id", "sim")
    share = F.conv(F.substring(drawn(seed, "sim", "src", "dst"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    alive = edges.join(F.broadcast(sims)).filter(share < F.col("weight")).select("sim", "src", "dst")
    if graph.directed:
        return alive
    return alive.unionByName(alive.filter("src != dst").select("sim", F.col("dst").alias("src"), F.col("src").alias("dst")))


def reachable(graph: Graph, node, simulations: int = 1, seed: int = 0) -> DataFrame:
    """(sim, id): ends of alive arcs from a vertex."""
    return alive_arcs(graph, simulations, seed).filter(F.col("src") == F.lit(node)).select("sim", F.col("dst").alias("id"))


def rewards(graph: Graph, simulations: int, seed: int = 0) -> DataFrame:
    """(sim, arm, reward) for every vertex and simulation."""
    sims = graph.edges.sparkSession.range(simulations).withColumnRenamed("id", "sim")
    counts = alive_arcs(graph, simulations, seed).groupBy("sim", F.col("src").alias("arm")).agg(F.count(F.lit(1)).alias("reward"))
    arms = graph.vertices.select(F.col("id").alias("arm")).join(F.broadcast(sims))
    return arms.join(counts, ["sim", "arm"], "left").select("sim", "arm", F.coalesce("reward", F.lit(0)).cast("long").alias("reward"))


def play_epsilon_greedy(reward: np.ndarray, horizon: int, eps: Callable[[int], float], rng: np.random.Generator) -> np.ndarray:
    """The arm of each step: a random one with probability eps(t), else that of the best average so far, the first among equals."""
    k = len(reward)
    times, total, mean = np.zeros(k), np.zeros(k), np.zeros(k)
    out = np.empty(horizon, np.int64)
    for t in range(horizon):
        a = int(rng.integers(k)) if rng.random() <= eps(t) else int(mean.argmax())
        times[a] += 1
        total[a] += reward[a]
        mean[a] = total[a] / times[a]
        out[t] = a
    return out


def play_ucb(reward: np.ndarray, horizon: int, known_horizon: bool) -> np.ndarray:
    """The arm of each step: that of the highest index, the first among equals; only the played arm's index is renewed."""
    k = len(reward)
    times, index = np.zeros(k), np.full(k, np.inf)
    out = np.empty(horizon, np.int64)
    for t in range(horizon):
        a = int(index.argmax())
        times[a] += 1
        index[a] = reward[a] + math.sqrt(2 * math.log(horizon if known_horizon else t + 1) / times[a])
        out[t] = a
    return out


def play(graph: Graph, simulations: int = 50, horizon: int = 5000, seed: int = 0, eps: Callable[[int], float] | None = None, known_horizon: bool = True) -> DataFrame:
    """(sim, learner, t, arm, reward, best) for learners "eps_greedy" and "ucb", t from 0; best: reward of the best arm."""
    ship(graph.vertices.sparkSession)
    kind = graph.vertices.schema["id"].dataType.simpleString()

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arm")
        arms, reward, sim = pdf["arm"].to_numpy(), pdf["reward"].to_numpy(float), int(pdf["sim"].iloc[0])
        chosen = {"eps_greedy": play_epsilon_greedy(reward, horizon, eps or epsilon_schedule(len(arms)), np.random.default_rng([seed, sim])), "ucb": play_ucb(reward, horizon, known_horizon)}
        return pd.concat([pd.DataFrame({"sim": sim, "learner": name, "t": np.arange(horizon), "arm": arms[a], "reward": reward[a].astype(np.int64), "best": int(reward.max())}) for name, a in chosen.items()])

    return rewards(graph, simulations, seed).groupBy("sim").applyInPandas(one, f"sim long, learner string, t long, arm {kind}, reward long, best long")


def regrets(played: DataFrame) -> DataFrame:
    """(sim, learner, t, regret): what the best arm would have gained so far, less what was gained."""
    so_far = Window.partitionBy("sim", "learner").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return played.select("sim", "learner", "t", F.sum(F.col("best") - F.col("reward")).over(so_far).alias("regret"))


def mean_regret(played: DataFrame) -> DataFrame:
    """(learner, t, regret), averaged over simulations."""
    return regrets(played).groupBy("learner", "t").agg(F.avg("regret").alias("regret"))


def reference_curves(spark, arms: int, horizon: int) -> DataFrame:
    """(t, eps_greedy, ucb): the growth that theory allows the two, t from 1."""
    t = F.col("t").cast("double")
    return spark.range(1, horizon + 1).withColumnRenamed("id", "t").select(
        "t",
        (F.pow(t, F.lit(2 / 3)) * F.pow(2.0 * arms * F.log(t), F.lit(1 / 3))).alias("eps_greedy"),
        F.sqrt(arms * t * math.log(horizon)).alias("ucb"),
    )
