import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.functions import inverse
from netloom.graph import Graph
from netloom.operators import auctions, bandits, centrality, community, components, mining, paths, primitives
from netloom.operators.matrix import compact, compact_arrays, least_vectors
from netloom.sources import edge_lists
from netloom.streaming.degrees import windowed_degrees

from .networks import BANDIT5, DEMO7, KARATE, RHESUS, TRI7, edges


def graph(spark, text, directed, vertices=None):
    return edge_lists.literal_graph(spark, edges(text), directed, vertices).materialized()


@pytest.fixture(scope="module")
def karate(spark):
    return graph(spark, KARATE, False)


@pytest.fixture(scope="module")
def rhesus(spark):
    return graph(spark, RHESUS, True)


def values(df, key="id", value=None):
    value = value or [c for c in df.columns if c != key][0]
    return {r[key]: r[value] for r in df.collect()}


# Sources ----------------------------------------------------------------------------------------


def test_readers(spark, tmp_path):
    (tmp_path / "k").write_text("% sym unweighted\n% 3 3\n1 2\n2 3 4.5\n3 2\n 3 1 \n")
    g = edge_lists.read_konect(spark, str(tmp_path / "k"), False)
    assert sorted(map(tuple, g.edges.collect()), key=str) == [("1", "2", None), ("1", "3", None), ("2", "3", 4.5)]
    assert edge_lists.read_konect(spark, str(tmp_path / "k"), True).edges.count() == 4
    (tmp_path / "s").write_text("# a\n# b\n10\t20\n20\t10\n")
    assert edge_lists.read_snap(spark, str(tmp_path / "s")).edges.count() == 2
    (tmp_path / "c.csv").write_text("id_1,id_2\n0,5\n5,0\n7,7\n")
    assert edge_lists.read_csv(spark, str(tmp_path / "c.csv")).edges.count() == 2
    out = edge_lists.ordered(spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "id string, v double"), "v")
    assert [r.id for r in out.collect()] == ["c", "a", "b"]
    edge_lists.write_csv(out, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 3


def test_empty_and_odd_graphs(spark):
    for directed in (False, True):
        empty = Graph.from_edges(spark.createDataFrame([], "src string, dst string"), directed)
        assert centrality.degree(empty).count() == 0
        assert centrality.pagerank(empty, steps=2).count() == 0
        assert centrality.hits(empty, steps=2).count() == 0
        assert mining.num_triangles(empty).first()[0] == 0
        assert paths.closeness(empty).count() == 0
        assert components.connected_components(empty).count() == 0
        assert centrality.vote_rank(empty).count() == 0
        odd = edge_lists.literal_graph(spark, [("a", "a"), ("aa", "b"), ("aa", "b"), ("b", "aa")], directed, ["lone", None])
        assert odd.vertices.count() == 4
        assert values(paths.closeness(odd))["lone"] == 0
        assert values(components.connected_components(odd), value="cluster") == {"a": "a", "aa": "aa", "b": "aa", "lone": "lone"}
        assert mining.num_triangles(odd).first()[0] == 0
        assert values(mining.clustering_coefficient(odd))["lone"] == 0
        assert paths.diameter(odd).first()[0] is None and paths.diameter(odd, on_disconnected="reachable").first()[0] == 1
        assert len(values(centrality.shapley_degree(odd))) == 4
    with pytest.raises(Exception, match="connected"):
        paths.diameter(odd, on_disconnected="error").collect()


# Centrality -------------------------------------------------------------------------------------


def test_karate_anchors(karate):
    assert values(centrality.degree(karate))["34"] == 17
    shapley = values(centrality.shapley_degree(karate))
    assert sum(shapley.values()) == pytest.approx(34) and shapley["34"] == pytest.approx(4.208669, abs=1e-6)
    assert sum(values(centrality.shapley_threshold(karate, k=1)).values()) == pytest.approx(34)
    pairs = paths.all_pairs(karate)
    assert pairs.count() == 1156 and pairs.agg(F.sum("d")).first()[0] == 2702
    assert sum(values(paths.closeness(karate)).values()) == 2702 and paths.diameter(karate).first()[0] == 5
    over, through = paths.betweenness(karate)
    top = over.orderBy(F.desc("betweenness")).first()
    assert {top.src, top.dst} == {"1", "32"} and top.betweenness == pytest.approx(142.785714, abs=1e-6)
    assert over.agg(F.sum("betweenness")).first()[0] == pytest.approx(2702)
    assert values(through)["1"] == pytest.approx(495.1429, abs=1e-4)
    close = values(paths.shapley_closeness(karate))
    assert sum(close.values()) == pytest.approx(34) and close["34"] == pytest.approx(1.298398, abs=1e-6)
    rank = values(centrality.pagerank(karate))
    assert sum(rank.values()) == pytest.approx(1) and rank["34"] == pytest.approx(0.100919, abs=1e-6)
    grown = values(centrality.pagerank(karate, semantics="reference"))
    assert sum(grown.values()) == pytest.approx(12.25) and grown["34"] == pytest.approx(1.325267, abs=1e-6)
    both = {r.id: r for r in centrality.hits(karate).collect()}
    assert both["34"].authority == pytest.approx(0.075003, abs=1e-6) and both["34"].hub == pytest.approx(0.075003, abs=1e-6)
    assert mining.num_triangles(karate).first()[0] == 45
    assert mining.average_clustering(karate).first()[0] == pytest.approx(0.570638, abs=1e-6)
    assert mining.stream_diameter(karate).first()[0] == 5


def test_rhesus_anchors(rhesus):
    pairs = paths.all_pairs(rhesus)
    assert pairs.count() == 256 and pairs.agg(F.max("d"), F.sum("d")).first()[:] == (4, 390)
    over, through = paths.betweenness(rhesus)
    top = over.orderBy(F.desc("betweenness")).first()
    assert {top.src, top.dst} == {"2", "4"} and top.betweenness == pytest.approx(20.5)
    assert values(through)["2"] == pytest.approx(47.9917, abs=1e-4)
    assert mining.num_triangles(rhesus).first()[0] == 131
    assert values(paths.shapley_closeness(rhesus))["2"] == pytest.approx(1.093086, abs=1e-6)
    assert values(centrality.pagerank(rhesus))["2"] == pytest.approx(0.127824, abs=1e-6)
    both = {r.id: r for r in centrality.hits(rhesus).collect()}
    assert both["3"].authority == pytest.approx(0.10601, abs=1e-5) and both["10"].hub == pytest.approx(0.092411, abs=1e-6)
    assert mining.stream_diameter(rhesus).first()[0] == 3


@pytest.mark.parametrize("name", ["karate", "rhesus"])
def test_both_plans_agree(name, request):
    g = request.getfixturevalue(name)
    for op in (paths.closeness, paths.shapley_closeness):
        one, two = values(op(g, plan="local")), values(op(g, plan="joins"))
        assert one == pytest.approx(two)
    assert paths.diameter(g, plan="joins").first() == paths.diameter(g, plan="local").first()
    sample = g.vertices.filter(F.col("id") < "2")
    for part in (None, sample):
        for one, two in zip(paths.betweenness(g, part, plan="local"), paths.betweenness(g, part, plan="joins"), strict=True):
            a, b = ({tuple(r)[:-1]: r.betweenness for r in df.collect()} for df in (one, two))
            assert a == pytest.approx(b)
    a, b = values(centrality.vote_rank(g, top_k=6)), values(centrality.vote_rank(g, top_k=6, plan="joins"))
    assert a == b and len(a) == 6


def test_sampled_betweenness(karate):
    full = paths.betweenness(karate)[0]
    assert values(paths.sampled_betweenness(karate, 100)[1]) == pytest.approx(values(paths.betweenness(karate)[1]))
    a, b = (paths.sampled_betweenness(karate, 5, seed=s)[0].agg(F.sum("betweenness")).first()[0] for s in (1, 1))
    assert a == b < full.agg(F.sum("betweenness")).first()[0]
    assert paths.sample_vertices(karate, 3, strata=4).count() == 12
    c = compact(karate)
    for strata in (1, 4):
        own = {c.ids[int(k)].as_py() for k in community.sampled_numbers(c, 3, 5, strata)}
        assert own == {r.id for r in paths.sample_vertices(karate, 3, 5, strata).collect()}
    assert paths.sample_vertices(karate, 7).count() == 7


def test_pagerank_options(spark):
    dag = graph(spark, "a-b b-c a-c", True)
    kept = values(centrality.pagerank(dag, steps=50, dangling=True))
    assert sum(kept.values()) == pytest.approx(1)
    lost = values(centrality.pagerank(dag, steps=50))
    assert lost["a"] == pytest.approx(0.05) and lost["c"] == pytest.approx(0.05 + 0.85 * (0.025 + 0.05 + 0.85 * 0.025), abs=1e-9)
    assert values(centrality.pagerank(dag, steps=500, confidence=1e-12)) == pytest.approx(lost)


def test_both_plans_of_iterations(spark, rhesus):
    dag = edge_lists.literal_graph(spark, [(1, 2), (2, 3), (1, 3), (3, 3), (5, 4)], True, [9])
    for g in (rhesus, dag):
        for more in ({"steps": 6}, {"steps": 4, "dangling": True}, {"steps": 8, "confidence": 2e-2}):
            assert values(centrality.pagerank(g, **more)) == pytest.approx(values(centrality.pagerank(g, plan="joins", **more)), abs=1e-12)
        for more in ({"steps": 6}, {"steps": 8, "confidence": 2e-2}):
            a, b = ({r.id: (r.hub, r.authority) for r in centrality.hits(g, plan=p, **more).collect()} for p in (None, "joins"))
            assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)
        assert mining.stream_diameter(g).first() == mining.stream_diameter(g, plan="joins").first()


def test_directed_spectrum_by_products(rhesus):
    c = compact(rhesus)
    whole, products = least_vectors(c, 3), least_vectors(c, 3, dense=0)
    assert products == pytest.approx(whole, abs=1e-6)


def test_vote_rank_order(karate):
    rank = values(centrality.vote_rank(karate))
    assert sorted(rank.values()) == list(range(1, 35))
    assert [k for k, _ in sorted(rank.items(), key=lambda x: -x[1])][:2] == ["34", "1"]


def test_shapley_closeness_is_a_shapley_value(spark):
    g = graph(spark, "a-b b-c c-d b-d", False)
    c = compact(g)
    ids = c.ids.to_pylist()
    far = {s: {v: d for v, d in [(r.v, r.d) for r in paths.all_pairs(g).filter(F.col("s") == s).collect()]} for s in ids}
    worth = lambda group: sum(math.exp(-0.1 * min(far[v][s] for s in group)) for v in ids) if group else 0
    want = dict.fromkeys(ids, 0.0)
    for order in itertools.permutations(ids):
        for k, v in enumerate(order):
            want[v] += (worth(order[: k + 1]) - worth(order[:k])) / math.factorial(len(ids))
    assert values(paths.shapley_closeness(g)) == pytest.approx(want)
    assert values(paths.shapley_closeness(g, weighted=True)) == pytest.approx(want)
    assert sum(values(paths.shapley_closeness(g, decay=inverse)).values()) == pytest.approx(4)


# Mining -----------------------------------------------------------------------------------------


def brute_directed(arcs):
    """The mixed rule, triple by triple."""
    nodes, s = sorted({v for a in arcs for v in a}), set(arcs)
    heavy = {v for v in nodes if sum(a[0] == v for a in arcs) >= math.sqrt(len(arcs))}
    total = 0
    for t in itertools.combinations(nodes, 3):
        cycles = sum((t[0], x) in s and (x, y) in s and (y, t[0]) in s for x, y in ((t[1], t[2]), (t[2], t[1])))
        if heavy.issuperset(t):
            total += cycles
            continue
        middles = {y for x, y, z in itertools.permutations(t) if (x, y) in s and (y, z) in s and (x, z) in s}
        out = set(t) - heavy
        total += bool(cycles or (middles - out if len(out) == 1 else middles))
    return total


def test_directed_triangles_by_brute_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        n = rng.randint(4, 9)
        arcs = [(f"v{a}", f"v{b}") for a in range(n) for b in range(n) if a != b and rng.random() < 0.45]
        g = edge_lists.literal_graph(spark, arcs, True)
        assert mining.num_triangles(g).first()[0] == brute_directed(arcs)
    tri = graph(spark, TRI7, True)
    assert mining.cyclic_triangles(tri).first()[0] == 3
    assert mining.stream_diameter_in_order(tri, tri.edges.withColumn("pos", F.monotonically_increasing_id())).first()[0] >= 1


# Communities ------------------------------------------------------------------------------------


def parts(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def test_components(spark):
    g = graph(spark, "a-b b-c c-a c-d d-e e-d f-f g-h", True)
    want = [["a", "b", "c"], ["d", "e"], ["f"], ["g"], ["h"]]
    assert parts(components.connected_components(g)) == want
    c = compact(g)
    labels = components.labels_of(c)
    assert sorted({tuple(sorted(c.ids[int(k)].as_py() for k in range(c.n) if labels[k] == x)) for x in labels}) == [tuple(x) for x in want]
    assert parts(components.weak_components(g)) == [["a", "b", "c", "d", "e"], ["f"], ["g", "h"]]


def test_girvan_newman(spark, karate):
    demo = graph(spark, DEMO7, False)
    want = [["A", "B", "C"], ["D", "E", "F", "G"]]
    assert parts(community.girvan_newman(demo)) == want
    assert parts(community.girvan_newman(demo, heuristic=True)) == want
    assert parts(community.girvan_newman(demo, semantics="reference")) == want
    assert parts(community.girvan_newman(demo, sample_size=7, strata=2)) == want
    assert len(parts(community.girvan_newman(karate, semantics="reference"))) == 1
    assert len(parts(community.girvan_newman(graph(spark, DEMO7, True)))) == 7


def test_modularity(spark):
    demo = graph(spark, DEMO7, False)
    one = community.girvan_newman(demo)
    assert primitives.modularity(demo, one).first()[0] == pytest.approx(3 / 9 - (7 / 18) ** 2 + 5 / 9 - (11 / 18) ** 2)
    c = compact(demo)
    assert community.quality(c, components.labels_of(c)) == pytest.approx(0)


def test_spectral(karate, spark):
    two = parts(community.spectral(karate))
    assert sorted(map(len, two)) == [15, 19]
    assert 2 < len(parts(community.spectral_multi_cluster(karate))) <= 4
    assert 2 < len(parts(community.spectral_multi_cluster_v2(karate, 4))) <= 4
    import numpy as np

    from netloom.operators import matrix

    c = compact(karate)
    dense = least_vectors(c, 2)
    limit, matrix.DENSE_ROWS = matrix.DENSE_ROWS, 5
    try:
        assert np.allclose(least_vectors(c, 2), dense, atol=1e-6)
    finally:
        matrix.DENSE_ROWS = limit
    lap = np.zeros((34, 34))
    number = {v: k for k, v in enumerate(c.ids.to_pylist())}
    for r in primitives.laplacian(karate).collect():
        lap[number[r.i], number[r.j]] = r.value
    assert np.linalg.eigvalsh(lap)[1] == pytest.approx(0.468525, abs=1e-6)
    walk = primitives.laplacian(graph(spark, "a-b b-c c-a", True))
    assert walk.count() == 9 and values(walk.filter("i = j").select("i", "value"), "i") == pytest.approx(dict.fromkeys("abc", 1 - 0.05 / 3))


def test_hierarchical_and_two_means(spark, karate):
    demo = graph(spark, DEMO7, False)
    assert sum(map(len, parts(community.hierarchical(demo)))) == 7
    assert sum(map(len, parts(community.hierarchical(karate, "reference")))) == 34
    rows = community.two_means(karate, [1, 2, 3])
    assert rows.groupBy("seed").agg(F.countDistinct("cluster").alias("n"), F.count(F.lit(1)).alias("m")).collect() and rows.filter("cluster IS NULL").isEmpty()
    assert sorted(map(tuple, community.two_means(karate, [1]).collect())) == sorted(map(tuple, rows.filter("seed = 1").collect()))
    apart = graph(spark, "a-b c-d e-f", False)
    assert community.two_means(apart, [0], parts=2).filter("cluster IS NULL").count() == 2


def test_linkage_of_many_vertices(spark):
    g = graph(spark, " ".join(f"{a}{k:04}-{b}{k:04}" for k in range(1700) for a, b in ("xy", "yz", "xz")), False)
    assert sorted(map(len, parts(community.hierarchical(g)))) == [3] * 1700
    assert sum(map(len, parts(community.hierarchical(g, "reference")))) == 5100


def test_growth_takes_time_by_arcs():
    import time

    import numpy as np
    import pyarrow as pa

    from netloom.operators.matrix import compact_arrays

    n = 40_000
    a, b = np.arange(n), (np.arange(n) + 1) % n
    c = compact_arrays(pa.array(range(n)), np.concatenate([a, b]), np.concatenate([b, a]), False)
    began = time.time()
    side = community._grow(c, 1, None)
    assert (side >= 0).all() and np.count_nonzero(np.diff(side)) <= 2 and time.time() - began < 20


def test_vote_rank_above_the_common_bound(spark, rhesus, monkeypatch):
    from netloom.operators import matrix

    want = [tuple(r) for r in centrality.vote_rank(rhesus, plan="joins").orderBy("rank").collect()]
    assert [tuple(r) for r in centrality.vote_rank(rhesus).orderBy("rank").collect()] == want
    asked = []
    monkeypatch.setattr(centrality, "fits", lambda graph, *bounds: asked.append(bounds) or True)
    centrality.vote_rank(rhesus)
    assert asked[0][0] >= 6 * 10**6 > matrix.LOCAL_ARCS  # a join a round doesn't end on 6 million arcs


def test_removal_counts_what_it_must(spark, monkeypatch):
    import numpy as np

    # Two rings of three joined by a bridge, a ring of five apart: the bridge is passed by 2 * 3 * 3 paths.
    g = graph(spark, "a-b b-c a-c c-d d-e e-f d-f p-q q-r r-s s-t p-t", False)
    c = compact(g)
    key, passed = community.bridges(c)
    assert key.tolist() == [2 * c.n + 3] and passed.tolist() == [18]
    flows = community.flows_from(c, np.arange(c.n))
    assert np.allclose(flows, community._flows_from(c, np.arange(c.n)))
    assert flows[np.isin(community.pair_keys(c), key)].sum() == 18
    assert not community.splits_nothing(c)
    asked = []
    count = community.arc_flows
    monkeypatch.setattr(community, "arc_flows", lambda graph, c, sources: asked.append(len(sources)) or count(graph, c, sources))
    assert parts(community.girvan_newman(g)) == [["a", "b", "c"], ["d", "e", "f"], ["p", "q", "r", "s", "t"]]
    assert asked[:2] == [11, 6] and max(asked[1:]) == 6  # then only the part that an edge was in
    asked.clear()
    ring = graph(spark, "p-q q-r r-s s-t p-t", False)
    assert len(parts(community.girvan_newman(ring, semantics="reference"))) == 1 and not asked


@pytest.mark.parametrize("directed", [False, True])
def test_searches_in_step_equal_searches_one_by_one(monkeypatch, directed):
    rng = np.random.default_rng(3)
    for n, share in ((1, 0), (9, 0.1), (40, 0.04), (40, 0.3)):
        near = np.triu(rng.random((n, n)) < share, 1)
        src, dst = np.nonzero(near if directed else near | near.T)
        c = compact_arrays(pa.array(range(n)), src, dst, directed)
        want = np.zeros(len(c.target))
        for s in range(n):
            far, levels = paths.search(c, s)
            sigma, arcs = paths.path_counts(c, levels, far)
            flow = np.ones(n)
            for place, u, v in reversed(arcs):
                want[place] += flow[v] * sigma[u] / sigma[v]
                flow += np.bincount(u, flow[v] * sigma[u] / sigma[v], n)
        for most in (1, 3 * (n + len(c.target)), 10**6):
            monkeypatch.setattr(community, "IN_STEP", most)
            assert np.allclose(community._flows_from(c, np.arange(n)), want)
        for key in {int(k) for k in community.pair_keys(c)[:3]}:
            keep = community.pair_keys(c) != key
            left, other = community.without(c, key), compact_arrays(c.ids, c.sources()[keep], c.target[keep].astype(np.int64), directed)
            assert (left.start == other.start).all() and (left.target == other.target).all()


@pytest.mark.parametrize("how", [{}, {"sample_size": 4, "seed": 1}, {"sample_size": 2, "strata": 3, "seed": 1}])
def test_removals_that_split_nothing_label_nothing(spark, karate, monkeypatch, how):
    c, levels, labelled = compact(karate), [], []
    monkeypatch.setattr(community, "no_better_parts", lambda c, label: False)
    remove, labels = community.without, community.labels_of
    monkeypatch.setattr(community, "without", lambda c, key: levels.append(remove(c, key)) or levels[-1])
    quality = community.quality
    monkeypatch.setattr(community, "quality", lambda c, label: labelled.append(1) or quality(c, label))
    got = parts(community.girvan_newman(karate, **how))
    assert len(levels) == len(c.target) // 2
    found = [labels(x) for x in [c, *levels]]
    assert len(labelled) <= len({tuple(x.tolist()) for x in found}) < len(levels)  # once for each labelling, not for each removal
    q = [quality(c, x) for x in found]
    best = found[next(k for k, x in enumerate(q) if x >= max(q) - 1e-12)]
    ids = c.ids.to_pylist()
    assert got == sorted(sorted(ids[i] for i in np.flatnonzero(best == k)) for k in np.unique(best))


def test_no_better_parts_against_all_partitions():
    def partitions(n):
        label = [0] * n
        while True:
            yield label
            k = n - 1
            while k > 0 and label[k] > max(label[:k]):
                k -= 1
            if k <= 0:
                return
            label = [*label[:k], label[k] + 1, *[0] * (n - k - 1)]

    rng, proved = np.random.default_rng(2), 0
    for turn in range(60):
        n = int(rng.integers(4, 8))
        near = np.triu(rng.random((n, n)) < rng.choice([0.3, 0.6, 0.9]), 1)
        near[: n // 2, n // 2 :] &= turn % 3 == 0
        src, dst = np.nonzero(near | near.T)
        c = compact_arrays(pa.array(range(n)), src, dst, False)
        label = components.labels_of(c) if turn % 2 else np.arange(n) * 2 // n
        if len(src) and community.no_better_parts(c, label):
            proved += len(np.unique(label)) < n
            q = community.quality(c, label)
            assert all(community.quality(c, label * n + np.array(x)) <= q + 1e-9 for x in partitions(n))
    assert proved > 5


@pytest.mark.parametrize("how", [{}, {"sample_size": 4, "seed": 1}, {"sample_size": 2, "strata": 3, "seed": 1}])
def test_girvan_newman_ends_where_nothing_can_be_gained(spark, monkeypatch, how):
    rng, sizes = np.random.default_rng(5), (12, 12, 12, 9)
    pairs = []
    for k, n in enumerate(sizes):
        near = np.triu(rng.random((n, n)) < 0.6, 1)
        near[np.arange(n - 1), np.arange(1, n)] = True
        pairs += [f"{k}{chr(97 + i)}-{k}{chr(97 + j)}" for i, j in zip(*np.nonzero(near), strict=True)]
    apart, turns = graph(spark, " ".join(pairs), False), []
    joined = graph(spark, " ".join([*pairs, "0a-1a", "1b-2b"]), False)
    count = community.arc_flows
    monkeypatch.setattr(community, "arc_flows", lambda *a: turns.append(1) or count(*a))
    assert list(map(len, parts(community.girvan_newman(apart, **how)))) == list(sizes) and not turns
    got, ended = parts(community.girvan_newman(joined, **how)), len(turns)
    monkeypatch.setattr(community, "no_better_parts", lambda c, label: False)
    assert got == parts(community.girvan_newman(joined, **how)) and len(turns) - ended > ended
    assert list(map(len, parts(community.girvan_newman(apart, **how)))) == list(sizes)


# Primitives, auctions, bandits ------------------------------------------------------------------


def test_primitives(spark):
    g = graph(spark, DEMO7, False)
    ids = lambda df: sorted(r.id for r in df.collect())
    assert ids(primitives.neighbors(g, "D")) == ["B", "E", "F", "G"] and ids(primitives.non_neighbors(g, "D")) == ["A", "C"]
    assert primitives.degree_of(g, "D").first().degree == 4
    assert primitives.subgraph(g, spark.createDataFrame([("A",), ("B",), ("C",)], "id string")).edges.count() == 3
    gone = spark.createDataFrame([("D", "B")], "src string, dst string")
    assert primitives.without_edges(g, gone).edges.count() == 8
    assert primitives.with_added_edges(g, spark.createDataFrame([("Z", "A")], "src string, dst string")).vertices.count() == 8
    queue = spark.createDataFrame([("x", 2, 0), ("y", 1, 1), ("z", 1, 0)], "id string, p int, seq int")
    assert [r.id for r in primitives.by_priority(queue, "p", "seq", take=2).orderBy("place").collect()] == ["z", "y"]


def auction(spark, bids, reports, seller):
    return (
        spark.createDataFrame([(1, b, float(x)) for b, x in bids.items()], "auction long, bidder string, bid double"),
        spark.createDataFrame([(1, b, o) for b, os in reports.items() for o in os], "auction long, bidder string, reported string"),
        spark.createDataFrame([(1, s) for s in seller], "auction long, bidder string"),
    )


def won(df):
    return {r.bidder: r.payment for r in df.collect() if r.allocated}


def test_auctions(spark):
    vcg = auction(spark, {"a": 10, "b": 109, "c": 368, "d": 12, "e": 56, "f": 25, "g": 104}, {"a": "bc", "b": "cd", "d": "efg", "e": "fg", "f": "g"}, "ab")
    assert won(auctions.vcg(*vcg, 4)) == {"c": 25, "b": 25, "g": 25, "e": 25}
    assert won(auctions.vcg(*vcg, 7)) == {} and len(won(auctions.vcg(*vcg, 7, semantics="canonical"))) == 7
    mudan = auction(spark, {"a": 3, "b": 1, "c": 1, "d": 6, "e": 4, "f": 7, "g": 5}, {"b": "c", "c": "de", "e": "f", "f": "g"}, "ab")
    assert won(auctions.mudan(*mudan, 4)) == {"b": 0, "c": 0, "e": 3, "f": 6}
    snca = auction(spark, {"a": 30, "b": 14, "c": 12, "d": 16, "e": 43, "f": 27, "g": 50}, {"b": "c", "c": "de", "e": "f", "f": "g"}, "abc")
    for price in (0, 20, 50):
        rows = auctions.snca(*snca, 6, start_price=price)
        assert rows.count() == 7 and len(won(rows)) <= 6
    assert won(auctions.snca(*snca, 6, seed=3)) == won(auctions.snca(*snca, 6, seed=3))
    # two auctions side by side, one without any reports
    other = spark.createDataFrame([(2, "q", 5.0)], "auction long, bidder string, bid double")
    both = auctions.mudan(mudan[0].unionByName(other), mudan[1], mudan[2], 4)
    assert both.filter("auction = 2").first().allocated is False and len(won(both.filter("auction = 1"))) == 4


def test_bandits(spark):
    g = edge_lists.literal_graph(spark, BANDIT5, True)
    reward = bandits.rewards(g, 40, seed=2)
    assert reward.count() == 200 and reward.agg(F.max("reward")).first()[0] <= 3
    mean = values(reward.groupBy("arm").agg(F.avg("reward").alias("r")), "arm")
    assert mean[1] == pytest.approx(1.0, abs=0.4) and mean[4] == pytest.approx(0.9, abs=0.2)
    played = bandits.play(g, 3, 60, seed=2)
    assert played.count() == 360 and sorted(map(tuple, played.collect())) == sorted(map(tuple, bandits.play(g, 3, 60, seed=2).collect()))
    regret = bandits.regrets(played)
    assert regret.filter("regret < 0").isEmpty() and bandits.mean_regret(played).count() == 120
    ucb = played.filter("learner = 'ucb' AND sim = 0 AND t < 5")
    assert sorted(r.arm for r in ucb.collect()) == [1, 2, 3, 4, 5]
    assert bandits.reference_curves(spark, 5, 10).count() == 10


def test_streaming_degrees(spark, tmp_path):
    rows = spark.sql("SELECT timestamp_seconds(id * 600) AS ts, id % 3 AS src, id % 2 AS dst FROM range(30)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_degrees(stream).writeStream.outputMode("complete").format("memory").queryName("degrees").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("degrees").collect())) == sorted(map(tuple, windowed_degrees(rows).collect()))


def test_best_level_equals_every_level():
    import numpy as np
    import pyarrow as pa

    from netloom.operators.matrix import compact_arrays

    rng = random.Random(1)
    for _ in range(30):
        n = rng.randint(3, 14)
        pairs = [(a, b) for a in range(n) for b in range(a) if rng.random() < 0.35] or [(1, 0)]
        src, dst = (np.array([p[k] for p in pairs] + [p[1 - k] for p in pairs]) for k in (0, 1))
        c = compact_arrays(pa.array(range(n)), src, dst, False)
        order = [int(k) for k in np.unique(community.pair_keys(c))]
        rng.shuffle(order)
        order = order[: rng.randint(1, len(order))]
        level, best = community.best_level(c, order)
        left, each = c, [community.quality(c, components.labels_of(c))]
        for k in order:
            left = community.without(left, k)
            each.append(community.quality(c, components.labels_of(left)))
        assert best == pytest.approx(max(each)) and each[level] == pytest.approx(best) and all(q < best - 1e-12 for q in each[:level])


def test_closure_of_long_chains(spark, monkeypatch):
    from netloom.plans import loop

    n = 3000
    seller = spark.createDataFrame([(1, "0"), (1, "0"), (2, None), (None, "x"), (4, "a")], "auction long, bidder string")
    reports = [(1, str(k), str(k + 1)) for k in range(n)] + [(1, "gone", "lost"), (3, "0", "1"), (None, "x", "y"), (1, None, "z"), (4, "a", None), (4, "a", "a"), (4, None, "b")]
    reports = spark.createDataFrame(reports, "auction long, bidder string, reported string")
    write, writes = loop.materialized, []
    monkeypatch.setattr(loop, "materialized", lambda df, *kind: writes.append(1) or write(df, *kind))
    got = sorted(map(tuple, primitives.reached(seller, reports, None).collect()), key=str)
    assert got == sorted([(1, str(k)) for k in range(n + 1)] + [(2, None), (None, "x"), (4, "a"), (4, None)], key=str)
    assert len(writes) < 20
    few = reports.filter("auction != 1 OR bidder IS NULL OR length(bidder) = 1")
    same = lambda plan: sorted(map(tuple, primitives.reached(seller, few, None, plan).collect()), key=str)
    assert same(None) == same("joins")
