"""One registered query for each operator, on graphs derived from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.functions import cluster_index, exponential_decay, inverse, power_law
from netloom.operators import auctions, bandits, centrality, community, components, mining, paths, primitives
from netloom.plans.loop import shared_path
from netloom.sources import edge_lists
from netloom.sources import tables as t
from netloom.streaming.degrees import windowed_degrees

Query = Callable[[SparkSession, str], DataFrame]

#: Items for sale in each auction.
ITEMS = 4


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on order; results are compared to six decimals."""
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def of_graph(make: Callable, op: Callable) -> Query:
    return lambda spark, d: rounded(op(make(spark, d).materialized()))


def _modularity(spark: SparkSession, d: str) -> DataFrame:
    graph = t.part_hot(spark, d).materialized()
    return rounded(primitives.modularity(graph, components.connected_components(graph)))


def _modularity_directed(spark: SparkSession, d: str) -> DataFrame:
    graph = t.user_next(spark, d).materialized()
    return rounded(primitives.modularity(graph, graph.vertices.select("id", (F.col("id") % 3).alias("cluster"))))


def _some(graph, size: int) -> DataFrame:
    """The argument of operators on a sample of vertices."""
    return paths.sample_vertices(graph, size, seed=1)


def _subgraph(graph) -> DataFrame:
    return primitives.subgraph(graph, _some(graph, 50)).edges.select("src", "dst")


def _existing(graph) -> DataFrame:
    pairs = graph.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return primitives.existing(graph, pairs)


def _without(graph) -> DataFrame:
    some = _some(graph, 20).withColumnRenamed("id", "src")
    return primitives.without_edges(graph, graph.edges.join(some, "src", "left_semi")).edges.select("src", "dst")


def _added(graph) -> DataFrame:
    return primitives.with_added_edges(graph, graph.vertices.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))).edges.select("src", "dst")


def _auction(op: Callable) -> Query:
    return lambda spark, d: rounded(op(*t.order_auctions(spark, d), ITEMS))


def _reached(hops: int | None) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        _, reports, seller = t.order_auctions(spark, d)
        return primitives.reached(seller, reports, hops)

    return run


def _priority(spark: SparkSession, d: str) -> DataFrame:
    bids, _, _ = t.order_auctions(spark, d)
    return primitives.by_priority(bids, F.desc("bid"), "bidder", group=["auction"], take=3)


def _scan(graph) -> DataFrame:
    return mining.stream_diameter_in_order(graph, graph.edges.select("src", "dst", (F.col("src") * 1_000_000 + F.col("dst")).alias("pos")))


def _weighted(spark: SparkSession, d: str):
    graph = t.nation_flow(spark, d)
    top = graph.edges.agg(F.max("weight").alias("top"))
    edges = graph.edges.join(F.broadcast(top)).select("src", "dst", (F.col("weight") / F.col("top")).alias("weight"))
    return graph.with_edges(edges).materialized()


def _regret(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bandits.mean_regret(bandits.play(_weighted(spark, d), simulations=50, horizon=5000, seed=1)))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("id").cast("double")
    return rounded(spark.range(0, 50).select("id", inverse(x).alias("inverse"), exponential_decay(x).alias("exponential"), power_law(x).alias("power"), cluster_index(F.array(F.col("id") % 2, F.col("id") % 3 % 2, F.lit(1))).alias("cluster")))


def _stream(spark: SparkSession, d: str) -> DataFrame:
    events = t.table(spark, d, "events").select("ts", F.col("user_id").alias("src"), (F.col("user_id") % 7).alias("dst"))
    return windowed_degrees(events, "1 day").select("start", "id", "in_degree", "out_degree")


def _text(df: DataFrame, comment: str, mark: str) -> str:
    """A text file of df's rows, columns with mark between, below a comment."""
    path = shared_path(df.sparkSession, "edge-list")
    lines = df.select(F.concat_ws(mark, *[F.col(c).cast("string") for c in df.columns]).alias("value"))
    df.sparkSession.createDataFrame([(comment,)], "value string").unionByName(lines).write.text(path)
    return path


def _konect(spark: SparkSession, d: str) -> DataFrame:
    path = _text(t.supp_hot(spark, d).edges.select("src", "dst"), "% sym unweighted", " ")
    return edge_lists.read_konect(spark, path, directed=False).edges.select("src", "dst")


def _konect_directed(spark: SparkSession, d: str) -> DataFrame:
    path = _text(t.nation_flow(spark, d).edges.select("src", "dst", "weight"), "% asym posweighted", " ")
    return rounded(edge_lists.read_konect(spark, path, directed=True).edges.select("src", "dst", "weight"))


def _snap(spark: SparkSession, d: str) -> DataFrame:
    path = _text(t.user_next(spark, d).edges.select("src", "dst"), "# FromNodeId\tToNodeId", "\t")
    return edge_lists.read_snap(spark, path).edges.select("src", "dst")


def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "edge-list")
    edge_lists.write_csv(t.supp_hot(spark, d).edges.select(F.col("src").alias("id_1"), F.col("dst").alias("id_2")), path)
    return edge_lists.read_csv(spark, path).edges.select("src", "dst")


def _literal(spark: SparkSession, d: str) -> DataFrame:
    demo = edge_lists.literal_graph(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("B", "D"), ("D", "E"), ("D", "F"), ("D", "G"), ("E", "F"), ("F", "G")], directed=False)
    return edge_lists.ordered(centrality.degree(demo), "degree")


def queries() -> dict[str, Query]:
    gn = community.girvan_newman
    found: dict[str, Query] = {
        "degree": of_graph(t.supp_hot, centrality.degree),
        "degree_directed": of_graph(t.user_next, centrality.degree),
        "degree_sample": of_graph(t.supp_hot, lambda g: centrality.degree(g, _some(g, 30))),
        "shapley_degree": of_graph(t.supp_hot, centrality.shapley_degree),
        "shapley_degree_directed": of_graph(t.user_next, centrality.shapley_degree),
        "shapley_threshold": of_graph(t.supp_hot, centrality.shapley_threshold),
        "shapley_threshold_directed": of_graph(t.part_dag, centrality.shapley_threshold),
        "shapley_threshold_reference": of_graph(t.supp_hot, lambda g: centrality.shapley_threshold(g, semantics="reference")),
        "pagerank": of_graph(t.user_next, lambda g: centrality.pagerank(g)),
        "pagerank_reference": of_graph(t.user_next, lambda g: centrality.pagerank(g, semantics="reference")),
        "pagerank_dangling": of_graph(t.part_dag, lambda g: centrality.pagerank(g, dangling=True)),
        "pagerank_converged": of_graph(t.user_next, lambda g: centrality.pagerank(g, confidence=1e-6)),
        "hits": of_graph(t.user_next, centrality.hits),
        "hits_both": of_graph(t.supp_hot, centrality.hits_both),
        "hits_hubbiness": of_graph(t.user_next, centrality.hits_hubbiness),
        "hits_authority": of_graph(t.user_next, centrality.hits_authority),
        "vote_rank": of_graph(t.supp_hot, lambda g: centrality.vote_rank(g, top_k=10)),
        "vote_rank_all": of_graph(t.user_next, centrality.vote_rank),
        "closeness": of_graph(t.supp_hot, paths.closeness),
        "closeness_directed": of_graph(t.part_dag, paths.closeness),
        "all_pairs": of_graph(t.supp_hot, lambda g: paths.all_pairs(g, with_sigma=True)),
        "diameter": of_graph(t.supp_hot, paths.diameter),
        "diameter_disconnected": of_graph(t.part_hot, lambda g: paths.diameter(g, on_disconnected="reachable")),
        "edge_betweenness": of_graph(t.supp_hot, lambda g: paths.betweenness(g)[0]),
        "node_betweenness": of_graph(t.supp_hot, lambda g: paths.betweenness(g)[1]),
        "edge_betweenness_sampled": of_graph(t.user_next, lambda g: paths.sampled_betweenness(g, 20, seed=1)[0]),
        "node_betweenness_stratified": of_graph(t.user_next, lambda g: paths.sampled_betweenness(g, 5, seed=1, strata=4)[1]),
        "shapley_closeness": of_graph(t.supp_hot, paths.shapley_closeness),
        "shapley_closeness_weighted": lambda spark, d: rounded(paths.shapley_closeness(_weighted(spark, d), weighted=True)),
        "triangles": of_graph(t.supp_hot, mining.num_triangles),
        "triangles_directed": of_graph(t.part_dag, mining.num_triangles),
        "triangles_directed_dense": of_graph(t.user_next, mining.num_triangles),
        "cyclic_triangles": of_graph(t.user_next, mining.cyclic_triangles),
        "transitive_triads": of_graph(t.user_next, mining.transitive_triads),
        "clustering_coefficient": of_graph(t.supp_hot, mining.clustering_coefficient),
        "clustering_coefficient_directed": of_graph(t.user_next, mining.clustering_coefficient),
        "clustering_coefficient_reference": of_graph(t.part_dag, lambda g: mining.clustering_coefficient(g, semantics="reference")),
        "average_clustering": of_graph(t.supp_hot, mining.average_clustering),
        "stream_diameter": of_graph(t.supp_hot, mining.stream_diameter),
        "stream_diameter_in_order": of_graph(t.supp_hot, _scan),
        "connected_components": of_graph(t.part_hot, components.connected_components),
        "strong_components": of_graph(t.user_next, components.connected_components),
        "strong_components_dag": of_graph(t.part_dag, components.connected_components),
        "modularity": _modularity,
        "modularity_directed": _modularity_directed,
        "laplacian": of_graph(t.supp_hot, primitives.laplacian),
        "laplacian_directed": of_graph(t.nation_flow, primitives.laplacian),
        "neighbors": of_graph(t.user_next, lambda g: primitives.neighbors(g, 3)),
        "predecessors": of_graph(t.user_next, lambda g: primitives.predecessors(g, 3)),
        "non_neighbors": of_graph(t.supp_hot, lambda g: primitives.non_neighbors(g, 3)),
        "out_degrees": of_graph(t.user_next, primitives.out_degrees),
        "subgraph": of_graph(t.supp_hot, _subgraph),
        "has_edge": of_graph(t.user_next, _existing),
        "remove_edges": of_graph(t.supp_hot, _without),
        "add_edges": of_graph(t.supp_hot, _added),
        "reached": _reached(2),
        "reached_closure": _reached(None),
        "priority_queue": _priority,
        "vcg": _auction(auctions.vcg),
        "vcg_canonical": _auction(lambda b, r, s, k: auctions.vcg(b, r, s, k, "canonical")),
        "mudan": _auction(auctions.mudan),
        "snca": _auction(lambda b, r, s, k: auctions.snca(b, r, s, k, start_price=5)),
        "girvan_newman": of_graph(t.supp_hot, gn),
        "girvan_newman_reference": of_graph(t.supp_hot, lambda g: gn(g, semantics="reference")),
        "girvan_newman_heuristic": of_graph(t.supp_hot, lambda g: gn(g, heuristic=True)),
        "girvan_newman_sampled": of_graph(t.supp_hot, lambda g: gn(g, sample_size=20, seed=1)),
        "girvan_newman_sampled_heuristic": of_graph(t.supp_hot, lambda g: gn(g, heuristic=True, sample_size=20, seed=1)),
        "girvan_newman_stratified": of_graph(t.supp_hot, lambda g: gn(g, sample_size=5, strata=4, seed=1)),
        "girvan_newman_stratified_heuristic": of_graph(t.supp_hot, lambda g: gn(g, heuristic=True, sample_size=5, strata=4, seed=1)),
        "spectral": of_graph(t.supp_hot, community.spectral),
        "spectral_multi_cluster": of_graph(t.supp_hot, community.spectral_multi_cluster),
        "spectral_multi_cluster_v2": of_graph(t.supp_hot, community.spectral_multi_cluster_v2),
        "hierarchical": of_graph(t.supp_hot, community.hierarchical),
        "hierarchical_reference": of_graph(t.supp_hot, lambda g: community.hierarchical(g, semantics="reference")),
        "two_means": of_graph(t.supp_hot, lambda g: community.two_means(g, [1, 2, 3])),
        "two_means_parts": of_graph(t.supp_hot, lambda g: community.two_means(g, [1, 2], parts=4)),
        "bandit_rewards": lambda spark, d: bandits.rewards(_weighted(spark, d), 50, seed=1),
        "bandit_reachable": lambda spark, d: bandits.reachable(_weighted(spark, d), 3, 50, seed=1),
        "bandit_regret": _regret,
        "bandit_curves": lambda spark, d: rounded(bandits.reference_curves(spark, 25, 5000)),
        "decay_functions": _functions,
        "streaming_degrees": _stream,
        "read_konect": _konect,
        "read_konect_directed": _konect_directed,
        "read_snap": _snap,
        "read_csv": _csv,
        "literal_graph": _literal,
        "ordered_report": of_graph(t.supp_hot, lambda g: edge_lists.ordered(centrality.degree(g), "degree")),
        "graph_user_next": lambda spark, d: t.user_next(spark, d).edges.select("src", "dst"),
        "graph_nation_flow": lambda spark, d: rounded(t.nation_flow(spark, d).edges),
        "graph_cust_supp": lambda spark, d: t.cust_supp(spark, d).edges.select("src", "dst"),
        "graph_page_links": lambda spark, d: t.page_links(spark, d).edges.select("src", "dst"),
    }
    return found
