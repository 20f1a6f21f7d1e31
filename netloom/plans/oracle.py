"""The same results in SQL, for the queries that SQL can express. Each stands alone over the driver's tables."""

from __future__ import annotations

HOT = """
  SELECT DISTINCT a.k AS src, b.k AS dst FROM
    (SELECT DISTINCT l_orderkey, {key} AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40) a
    JOIN (SELECT DISTINCT l_orderkey, {key} AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 40) b
    ON a.l_orderkey = b.l_orderkey AND a.k < b.k"""
#: e: edges as stored; a: arcs without loops, both ways for undirected edges; v: vertices.
UNDIRECTED = "e AS MATERIALIZED ({edges}), a AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
DIRECTED = "e AS MATERIALIZED ({edges}), a AS MATERIALIZED (SELECT src, dst FROM e WHERE src <> dst), v AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e)"
NEXT = "SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst FROM events) WHERE src IS NOT NULL AND dst IS NOT NULL"
FLOW = """
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, CAST(count(*) AS DOUBLE) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2"""

SUPP = UNDIRECTED.format(edges=HOT.format(key="l_suppkey"))
PART = UNDIRECTED.format(edges=HOT.format(key="l_partkey"))
DAG = DIRECTED.format(edges=HOT.format(key="l_partkey"))
USER = DIRECTED.format(edges=NEXT)

UD = "d AS MATERIALIZED (SELECT id, (SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id) AS n FROM v)"
DD = "d AS MATERIALIZED (SELECT id, (SELECT count(*) FROM e WHERE dst = id) AS i, (SELECT count(*) FROM e WHERE src = id) AS o FROM v)"

#: Undirected triangles with the directions of their arcs.
TRIANGLES = """
p AS MATERIALIZED (SELECT least(src, dst) AS x, greatest(src, dst) AS y, max(CAST(src < dst AS INT)) AS f, max(CAST(src > dst AS INT)) AS r FROM a GROUP BY 1, 2),
t AS MATERIALIZED (
  SELECT p1.x AS a, p1.y AS b, p2.y AS c, p1.f AS ab, p1.r AS ba, p2.f AS ac, p2.r AS ca, p3.f AS bc, p3.r AS cb
  FROM p p1 JOIN p p2 ON p1.x = p2.x AND p1.y < p2.y JOIN p p3 ON p3.x = p1.y AND p3.y = p2.y),
k AS (SELECT *, ab * bc * ca + ac * cb * ba AS cyc, ba * ac * bc + ca * ab * cb AS ma, ab * bc * ac + cb * ba * ca AS mb, ac * cb * ab + bc * ca * ba AS mc FROM t)"""
RULE = """
h AS (SELECT src AS id FROM a GROUP BY src HAVING count(*) >= sqrt((SELECT count(*) FROM a))),
w AS (SELECT *, CAST(a IN (SELECT id FROM h) AS INT) AS ha, CAST(b IN (SELECT id FROM h) AS INT) AS hb, CAST(c IN (SELECT id FROM h) AS INT) AS hc FROM k),
n AS MATERIALIZED (SELECT *, CASE WHEN ha + hb + hc = 3 THEN cyc WHEN cyc > 0 THEN 1
    WHEN ha + hb + hc = 2 THEN CAST(ma + mb + mc > (1 - ha) * ma + (1 - hb) * mb + (1 - hc) * mc AS INT) ELSE CAST(ma + mb + mc > 0 AS INT) END AS n FROM w)"""

#: Distances: least depth at which a vertex is reached.
BFS = "r AS (SELECT id AS s, id AS v, 0 AS d FROM v UNION SELECT r.s, a.dst, r.d + 1 FROM r JOIN a ON a.src = r.v WHERE r.d < {cap}), q AS MATERIALIZED (SELECT s, v, min(d) AS d FROM r GROUP BY s, v)"
SIGMA = "g AS (SELECT s, v, 0 AS d, 1.0::DOUBLE AS sigma FROM q WHERE d = 0 UNION ALL SELECT s, v, d, sum(x) FROM (SELECT g.s, a.dst AS v, g.d + 1 AS d, g.sigma AS x FROM g JOIN a ON a.src = g.v JOIN q ON q.s = g.s AND q.v = a.dst AND q.d = g.d + 1) GROUP BY s, v, d), m AS MATERIALIZED (SELECT * FROM g)"

AUCTION = """
b AS MATERIALIZED (SELECT CAST(c_nationkey AS BIGINT) AS auction, c_custkey AS bidder, CAST(CAST(floor(max(o_totalprice)) AS BIGINT) % 51 AS DOUBLE) AS bid
  FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2),
ch AS (SELECT auction, bidder, row_number() OVER x AS n, lead(bidder, 1) OVER x AS one, lead(bidder, 2) OVER x AS two FROM b WINDOW x AS (PARTITION BY auction ORDER BY bidder)),
rep AS MATERIALIZED (SELECT auction, bidder, one AS reported FROM ch WHERE one IS NOT NULL UNION ALL SELECT auction, bidder, two FROM ch WHERE two IS NOT NULL),
sel AS (SELECT auction, bidder FROM ch WHERE n <= 3)"""
HOPS = """
h1 AS (SELECT rep.auction, reported AS bidder FROM rep JOIN sel USING (auction, bidder)), h2 AS (SELECT rep.auction, reported AS bidder FROM rep JOIN h1 USING (auction, bidder)),
inside AS (SELECT auction, bidder FROM sel UNION SELECT * FROM h1 UNION SELECT * FROM h2)"""


def pagerank(steps: int, factor: str = "0.85", dangling: bool = False) -> str:
    lost = f"UNION ALL SELECT x.i, v.id, x.rank / n FROM pr x, v, nn WHERE x.i < {steps} AND x.id NOT IN (SELECT src FROM e)" if dangling else ""
    return f"""
o AS (SELECT src, count(*) AS o FROM e GROUP BY src), nn AS (SELECT count(*)::DOUBLE AS n FROM v),
pr AS (
  SELECT 0 AS i, id, 1.0 / n AS rank FROM v, nn
  UNION ALL
  SELECT i + 1, id, 0.15 / n + {factor} * sum(x) FROM (
    SELECT x.i AS i, e.dst AS id, x.rank / o.o AS x FROM pr x JOIN e ON e.src = x.id JOIN o ON o.src = x.id WHERE x.i < {steps}
    {lost}
    UNION ALL SELECT i, id, 0 FROM pr WHERE i < {steps}), nn GROUP BY i, id, n)"""


def hits(steps: int, arcs: str) -> str:
    return f"""
nn AS (SELECT count(*)::DOUBLE AS n FROM v), arcs AS (SELECT src, dst FROM {arcs}),
ht AS (
  SELECT 0 AS i, id, 1.0 / n AS hub, 1.0 / n AS authority FROM v, nn
  UNION ALL
  SELECT i + 1, id, sum(h) / sum(sum(h)) OVER (), sum(x) / sum(sum(x)) OVER () FROM (
    SELECT ht.i, arcs.dst AS id, 0.0 AS h, ht.hub AS x FROM ht JOIN arcs ON arcs.src = ht.id WHERE ht.i < {steps}
    UNION ALL SELECT ht.i, arcs.src, ht.authority, 0 FROM ht JOIN arcs ON arcs.dst = ht.id WHERE ht.i < {steps}
    UNION ALL SELECT i, id, 0, 0 FROM ht WHERE i < {steps}) GROUP BY i, id)"""


def r(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


#: Arcs of the weighted graph that are alive in each of fifty simulations.
ALIVE = f"f AS ({FLOW}), g AS (SELECT src, dst, weight / (SELECT max(weight) FROM f) AS weight FROM f), alive AS (SELECT sim, src, dst FROM g, range(0, 50) s(sim) WHERE CAST('0x' || substr(md5('1:' || sim || ':' || src || ':' || dst), 1, 8) AS BIGINT) / 4294967296.0 < weight)"


def oracle_sql() -> dict[str, str]:
    near = "coalesce((SELECT sum({x}) FROM {arcs} JOIN d w ON w.id = {end} WHERE {own} = d.id), 0)"
    loops = "(SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE src <> dst) z"
    und = lambda x: near.format(x=x, arcs=loops, end="z.dst", own="z.src")
    succ = lambda x: near.format(x=x, arcs="e z", end="z.dst", own="z.src")
    pred = lambda x: near.format(x=x, arcs="e z", end="z.src", own="z.dst")
    share = lambda n: f"CASE WHEN {n} = 0 THEN 0.0 ELSE greatest(0.0, ({n} - 1.0) / {n}) END"
    undirected_degree = "(SELECT src AS id, count(*) AS n FROM a GROUP BY src)"
    reach = "r AS (SELECT id AS s, id AS v FROM v UNION SELECT r.s, a.dst FROM r JOIN a ON a.src = r.v)"
    label = "c AS MATERIALIZED (SELECT s AS id, min(v) AS cluster FROM r GROUP BY s)"
    bfs = BFS.format(cap=12)
    vote = lambda rounds: f"""
nn AS (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM v)::DOUBLE / (SELECT count(*) FROM a) AS f),
vr AS (
  SELECT 0 AS i, id, 1.0::DOUBLE AS ability, CAST(NULL AS BIGINT) AS rank FROM v
  UNION ALL
  SELECT i + 1, id, CASE WHEN id = best THEN 0.0 WHEN id IN (SELECT src FROM a WHERE dst = best) THEN greatest(0.0, ability - f) ELSE ability END, CASE WHEN id = best THEN n - i ELSE rank END
  FROM (SELECT *, first_value(id) OVER (ORDER BY rank IS NOT NULL, round(votes, 9) DESC, id) AS best FROM (
    SELECT vr.i, vr.id, any_value(vr.ability) AS ability, any_value(vr.rank) AS rank, coalesce(sum(u.ability), 0) AS votes
    FROM vr LEFT JOIN a ON a.dst = vr.id LEFT JOIN vr u ON u.id = a.src AND u.rank IS NULL WHERE vr.i < {rounds} GROUP BY vr.i, vr.id)), nn)"""  # noqa: E731
    vcg = """
best AS (SELECT *, row_number() OVER (PARTITION BY auction ORDER BY bid DESC, bidder) AS place FROM b JOIN inside USING (auction, bidder)),
price AS (SELECT auction, bid AS price FROM best WHERE place = 5)"""
    found = {
        "degree": f"WITH {SUPP}, {UD} SELECT id, n AS degree FROM d",
        "degree_directed": f"WITH {USER}, {DD} SELECT id, i AS in_degree, o AS out_degree FROM d",
        "ordered_report": f"WITH {SUPP}, {UD} SELECT id, n AS degree FROM d",
        "literal_graph": "SELECT id, count(*) AS degree FROM (SELECT unnest([a, b]) AS id FROM (VALUES ('A', 'B'), ('A', 'C'), ('B', 'C'), ('B', 'D'), ('D', 'E'), ('D', 'F'), ('D', 'G'), ('E', 'F'), ('F', 'G')) x(a, b)) GROUP BY id",
        "read_konect": f"WITH {SUPP} SELECT least(src::VARCHAR, dst::VARCHAR) AS src, greatest(src::VARCHAR, dst::VARCHAR) AS dst FROM e",
        "read_csv": f"WITH {SUPP} SELECT least(src::VARCHAR, dst::VARCHAR) AS src, greatest(src::VARCHAR, dst::VARCHAR) AS dst FROM e",
        "read_konect_directed": f"SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, weight FROM ({FLOW})",
        "read_snap": f"SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM ({NEXT})",
        "stream_diameter_in_order": f"""WITH RECURSIVE {SUPP}, nr AS (SELECT id, row_number() OVER (ORDER BY id) AS k FROM v),
  el AS (SELECT list(u.k ORDER BY src * 1000000 + dst) AS u, list(w.k ORDER BY src * 1000000 + dst) AS w, count(*) AS m FROM e JOIN nr u ON u.id = src JOIN nr w ON w.id = dst),
  s AS (SELECT 0 AS step, list((SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id) ORDER BY k) AS r, true AS changed FROM nr
    UNION ALL SELECT step + 1, list_transform(r, lambda y, i: CASE WHEN i = p OR i = q THEN greatest(r[p], r[q]) ELSE y END), r[p] <> r[q] OR (changed AND step % m > 0)
    FROM (SELECT s.*, m, u[step % m + 1] AS p, w[step % m + 1] AS q FROM s, el) WHERE changed OR step % m > 0)
  SELECT max(step) // any_value(m) AS rounds FROM s, el""",
        "degree_sample": f"WITH {SUPP}, {UD} SELECT id, n AS degree FROM d ORDER BY md5('1:' || id), id LIMIT 30",
        "shapley_degree": f"WITH {SUPP}, {UD} SELECT id, {r('1.0 / (1 + n) + ' + und('1.0 / (1 + w.n)'), 'shapley')} FROM d",
        "shapley_degree_directed": f"WITH {USER}, {DD} SELECT id, {r('1.0 / (1 + i) + ' + succ('1.0 / (1 + w.i)'), 'in_shapley')}, {r('1.0 / (1 + o) + ' + succ('1.0 / (1 + w.o)'), 'out_shapley')} FROM d",
        "shapley_threshold": f"WITH {SUPP}, {UD} SELECT id, {r('least(1.0, 2.0 / (1 + n)) + ' + und('(' + share('w.n') + ') / (1 + w.n)'), 'shapley')} FROM d",
        "shapley_threshold_directed": f"WITH {DAG}, {DD} SELECT id, {r('least(1.0, 2.0 / (1 + i)) + ' + pred('(' + share('w.i') + ') / (1 + w.i)'), 'in_shapley')}, {r('least(1.0, 2.0 / (1 + o)) + ' + succ('(' + share('w.o') + ') / (1 + w.o)'), 'out_shapley')} FROM d",
        "shapley_threshold_reference": f"WITH {SUPP}, {UD} SELECT id, {r('least(1.0, 2.0 / (1 + n)) + (' + share('n') + ') * ' + und('1.0 / (1 + w.n)'), 'shapley')} FROM d",
        "pagerank": f"WITH RECURSIVE {USER}, {pagerank(75)} SELECT id, {r('rank', 'rank')} FROM pr WHERE i = 75",
        "pagerank_reference": f"WITH RECURSIVE {USER}, {pagerank(75, '1.0')} SELECT id, {r('rank', 'rank')} FROM pr WHERE i = 75",
        "pagerank_dangling": f"WITH RECURSIVE {DAG}, {pagerank(75, dangling=True)} SELECT id, {r('rank', 'rank')} FROM pr WHERE i = 75",
        "pagerank_converged": f"""WITH RECURSIVE {USER}, o AS (SELECT src, count(*) AS o FROM e GROUP BY src), nn AS (SELECT count(*)::DOUBLE AS n FROM v),
  pr AS (SELECT 0 AS i, id, 1.0 / n AS rank, 1.0::DOUBLE AS change FROM v, nn
    UNION ALL SELECT i, id, rank, sum(abs(rank - old)) OVER () FROM (
      SELECT i + 1 AS i, id, 0.15 / n + 0.85 * sum(x) AS rank, sum(old) AS old FROM (
        SELECT x.i AS i, e.dst AS id, x.rank / o.o AS x, 0.0 AS old FROM pr x JOIN e ON e.src = x.id JOIN o ON o.src = x.id WHERE x.i < 75 AND x.change > 1e-6
        UNION ALL SELECT i, id, 0, rank FROM pr WHERE i < 75 AND change > 1e-6), nn GROUP BY i, id, n))
  SELECT id, {r('rank', 'rank')} FROM pr WHERE i = (SELECT max(i) FROM pr)""",
        "hits": f"WITH RECURSIVE {USER}, {hits(75, 'e')} SELECT id, {r('0.5 * hub + 0.5 * authority', 'score')}, {r('hub', 'hub')}, {r('authority', 'authority')} FROM ht WHERE i = 75",
        "hits_both": f"WITH RECURSIVE {SUPP}, {hits(75, 'a')} SELECT id, {r('0.5 * hub + 0.5 * authority', 'score')} FROM ht WHERE i = 75",
        "hits_hubbiness": f"WITH RECURSIVE {USER}, {hits(75, 'e')} SELECT id, {r('hub', 'hub')} FROM ht WHERE i = 75",
        "hits_authority": f"WITH RECURSIVE {USER}, {hits(75, 'e')} SELECT id, {r('authority', 'authority')} FROM ht WHERE i = 75",
        "vote_rank": f"WITH RECURSIVE {SUPP}, {vote(10)} SELECT id, rank FROM vr WHERE i = 10 AND rank IS NOT NULL",
        "vote_rank_all": f"WITH RECURSIVE {USER}, {vote('(SELECT count(*) FROM v)')} SELECT id, rank FROM vr WHERE i = (SELECT count(*) FROM v)",
        "closeness": f"WITH RECURSIVE {SUPP}, {bfs} SELECT s AS id, CAST(sum(d) AS BIGINT) AS closeness FROM q GROUP BY s",
        "closeness_directed": f"WITH RECURSIVE {DAG}, {BFS.format(cap=60)} SELECT s AS id, CAST(sum(d) AS BIGINT) AS closeness FROM q GROUP BY s",
        "all_pairs": f"WITH RECURSIVE {SUPP}, {bfs}, {SIGMA} SELECT s, v, d, {r('sigma', 'sigma')} FROM m",
        "diameter": f"WITH RECURSIVE {SUPP}, {bfs} SELECT CASE WHEN count(*) = (SELECT count(*) * count(*) FROM v) THEN CAST(max(d) AS BIGINT) END AS diameter FROM q",
        "diameter_disconnected": f"WITH RECURSIVE {PART}, {BFS.format(cap=60)} SELECT CAST(max(d) AS BIGINT) AS diameter FROM q",
        "edge_betweenness": f"""WITH RECURSIVE {SUPP}, {bfs}, {SIGMA},
  x AS (SELECT least(a.src, a.dst) AS src, greatest(a.src, a.dst) AS dst, sum(p.sigma * t.sigma / st.sigma) AS b
    FROM a JOIN m p ON p.v = a.src JOIN m t ON t.s = a.dst JOIN m st ON st.s = p.s AND st.v = t.v AND st.d = p.d + 1 + t.d GROUP BY 1, 2)
  SELECT e.src, e.dst, {r('coalesce(b, 0)', 'betweenness')} FROM e LEFT JOIN x USING (src, dst)""",
        "node_betweenness": f"""WITH RECURSIVE {SUPP}, {bfs}, {SIGMA},
  x AS (SELECT p.v AS id, sum(p.sigma * t.sigma / st.sigma) AS b FROM m p JOIN m t ON t.s = p.v JOIN m st ON st.s = p.s AND st.v = t.v AND st.d = p.d + t.d WHERE p.s <> p.v GROUP BY 1)
  SELECT v.id, {r('coalesce(b, 0)', 'betweenness')} FROM v LEFT JOIN x USING (id)""",
        "edge_betweenness_sampled": f"""WITH RECURSIVE {USER}, {bfs}, {SIGMA}, picked AS (SELECT id FROM v ORDER BY md5('1:' || id), id LIMIT 20),
  x AS (SELECT least(a.src, a.dst) AS src, greatest(a.src, a.dst) AS dst, sum(p.sigma * t.sigma / st.sigma) AS b
    FROM a JOIN m p ON p.v = a.src AND p.s IN (SELECT id FROM picked) JOIN m t ON t.s = a.dst JOIN m st ON st.s = p.s AND st.v = t.v AND st.d = p.d + 1 + t.d GROUP BY 1, 2),
  u AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM a)
  SELECT src, dst, {r('coalesce(b, 0)', 'betweenness')} FROM u LEFT JOIN x USING (src, dst)""",
        "node_betweenness_stratified": f"""WITH RECURSIVE {USER}, {bfs}, {SIGMA},
  picked AS (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY CAST('0x' || substr(md5('2:' || id), 1, 4) AS BIGINT) % 4 ORDER BY md5('1:' || id), id) AS k FROM v) WHERE k <= 5),
  x AS (SELECT p.v AS id, sum(p.sigma * t.sigma / st.sigma) AS b FROM m p JOIN m t ON t.s = p.v JOIN m st ON st.s = p.s AND st.v = t.v AND st.d = p.d + t.d WHERE p.s <> p.v AND p.s IN (SELECT id FROM picked) GROUP BY 1)
  SELECT v.id, {r('coalesce(b, 0)', 'betweenness')} FROM v LEFT JOIN x USING (id)""",
        "shapley_closeness": f"""WITH RECURSIVE {SUPP}, {bfs},
  l AS (SELECT s, d, exp(-0.1 * d) AS f, sum(count(*)) OVER (PARTITION BY s ORDER BY d) AS b, sum(count(*)) OVER (PARTITION BY s ORDER BY d) - count(*) AS a0 FROM q GROUP BY s, d),
  y AS (SELECT *, CASE WHEN d > 0 THEN f * (1.0 / a0 - 1.0 / b) ELSE 0 END AS tt FROM l),
  z AS (SELECT s, d, CASE WHEN d > 0 THEN f / b ELSE f END - coalesce(sum(tt) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS val FROM y)
  SELECT q.v AS id, {r('sum(val)', 'shapley')} FROM q JOIN z ON z.s = q.s AND z.d = q.d GROUP BY q.v""",
        "shapley_closeness_weighted": f"""WITH RECURSIVE {DIRECTED.format(edges=FLOW)}, w AS MATERIALIZED (SELECT src, dst, weight / (SELECT max(weight) FROM e) AS w FROM e WHERE src <> dst),
  bf AS (SELECT 0 AS k, x.id AS s, y.id AS v, CASE WHEN x.id = y.id THEN 0.0 ELSE 'Infinity'::DOUBLE END AS d FROM v x, v y
    UNION ALL SELECT k + 1, s, v, min(d) FROM (SELECT bf.k, bf.s, w.dst AS v, bf.d + w.w AS d FROM bf JOIN w ON w.src = bf.v WHERE bf.k < 24 UNION ALL SELECT k, s, v, d FROM bf WHERE k < 24) GROUP BY k, s, v),
  q AS MATERIALIZED (SELECT s, v, d FROM bf WHERE k = 24 AND d < 'Infinity'::DOUBLE),
  l AS (SELECT s, d, exp(-0.1 * d) AS f, sum(count(*)) OVER (PARTITION BY s ORDER BY d) AS b, sum(count(*)) OVER (PARTITION BY s ORDER BY d) - count(*) AS a0 FROM q GROUP BY s, d),
  y AS (SELECT *, CASE WHEN a0 > 0 THEN f * (1.0 / a0 - 1.0 / b) ELSE 0 END AS tt FROM l),
  z AS (SELECT s, d, CASE WHEN a0 > 0 THEN f / b ELSE f END - coalesce(sum(tt) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS val FROM y)
  SELECT q.v AS id, {r('sum(val)', 'shapley')} FROM q JOIN z ON z.s = q.s AND z.d = q.d GROUP BY q.v""",
        "triangles": f"WITH {SUPP}, {TRIANGLES} SELECT count(*) AS triangles FROM t",
        "triangles_directed": f"WITH {DAG}, {TRIANGLES}, {RULE} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS triangles FROM n",
        "triangles_directed_dense": f"WITH {USER}, {TRIANGLES}, {RULE} SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS triangles FROM n",
        "cyclic_triangles": f"WITH {USER} SELECT CAST(count(*) / 3 AS BIGINT) AS triangles FROM a x JOIN a y ON y.src = x.dst JOIN a z ON z.src = y.dst AND z.dst = x.src",
        "transitive_triads": f"WITH {USER} SELECT count(*) AS triads FROM a x JOIN a y ON y.src = x.dst JOIN a z ON z.src = x.src AND z.dst = y.dst",
        "clustering_coefficient": f"WITH {SUPP}, {TRIANGLES}, c AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id) SELECT id, {r('CASE WHEN n > 1 THEN 2.0 * coalesce(t, 0) / (n * (n - 1)) ELSE 0.0 END', 'coefficient')} FROM {undirected_degree} d LEFT JOIN c USING (id)",
        "average_clustering": f"WITH {SUPP}, {TRIANGLES}, c AS (SELECT id, count(*) AS t FROM (SELECT unnest([a, b, c]) AS id FROM t) GROUP BY id) SELECT {r('avg(CASE WHEN n > 1 THEN 2.0 * coalesce(t, 0) / (n * (n - 1)) ELSE 0.0 END)', 'average')} FROM {undirected_degree} d LEFT JOIN c USING (id)",
        "clustering_coefficient_directed": f"""WITH {USER}, sym AS MATERIALIZED (SELECT src, dst, count(*) AS s FROM (SELECT src, dst FROM a UNION ALL SELECT dst, src FROM a) GROUP BY 1, 2),
  c AS (SELECT x.src AS id, CAST(sum(x.s * y.s * z.s) AS DOUBLE) AS t FROM sym x JOIN sym y ON y.src = x.dst JOIN sym z ON z.src = y.dst AND z.dst = x.src GROUP BY 1),
  g AS (SELECT src AS id, sum(s) AS n, sum(CAST(s = 2 AS INT)) AS rec FROM sym GROUP BY 1)
  SELECT v.id, {r('CASE WHEN n > 1 AND n * (n - 1) - 2 * rec > 0 THEN coalesce(t, 0) / (2.0 * (n * (n - 1) - 2 * rec)) ELSE 0.0 END', 'coefficient')} FROM v LEFT JOIN g USING (id) LEFT JOIN c USING (id)""",
        "clustering_coefficient_reference": f"""WITH {DAG}, {TRIANGLES}, {RULE}, c AS (SELECT id, CAST(sum(n) AS DOUBLE) AS t FROM (SELECT unnest([a, b, c]) AS id, n FROM n) GROUP BY id),
  g AS (SELECT id, count(*) AS n FROM (SELECT src AS id FROM a UNION ALL SELECT dst FROM a) GROUP BY id)
  SELECT v.id, {r('CASE WHEN g.n > 1 THEN coalesce(t, 0) / (2.0 * g.n * (g.n - 1) - 2.0 / g.n) ELSE 0.0 END', 'coefficient')} FROM v LEFT JOIN g USING (id) LEFT JOIN c USING (id)""",
        "stream_diameter": f"""WITH RECURSIVE {SUPP}, s AS (
    SELECT 0 AS i, id, (SELECT count(*) FROM a WHERE src = id) AS r, TRUE AS moved FROM v
    UNION ALL
    SELECT i + 1, id, r, bool_or(r <> old) OVER () FROM (SELECT s.i, s.id, any_value(s.r) AS old, greatest(any_value(s.r), max(u.r)) AS r FROM s JOIN a ON a.src = s.id JOIN s u ON u.id = a.dst WHERE s.moved GROUP BY s.i, s.id))
  SELECT CAST(max(i) AS BIGINT) AS rounds FROM s""",
        "connected_components": f"WITH RECURSIVE {PART}, {reach}, {label} SELECT id, cluster FROM c",
        "strong_components": f"WITH RECURSIVE {USER}, {reach}, rr AS MATERIALIZED (SELECT * FROM r) SELECT x.s AS id, min(x.v) AS cluster FROM rr x JOIN rr y ON y.s = x.v AND y.v = x.s GROUP BY 1",
        "strong_components_dag": f"WITH RECURSIVE {DAG}, {reach}, rr AS MATERIALIZED (SELECT * FROM r) SELECT x.s AS id, min(x.v) AS cluster FROM rr x JOIN rr y ON y.s = x.v AND y.v = x.s GROUP BY 1",
        "modularity": f"""WITH RECURSIVE {PART}, {reach}, {label}, m AS (SELECT count(*)::DOUBLE AS m FROM e),
  k AS (SELECT cluster, count(*) AS k FROM a JOIN c ON c.id = a.src GROUP BY 1), l AS (SELECT x.cluster, count(*) AS l FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst AND y.cluster = x.cluster GROUP BY 1)
  SELECT {r('sum(coalesce(l, 0) / m - (k / (2 * m)) ** 2)', 'modularity')} FROM k LEFT JOIN l USING (cluster), m""",
        "modularity_directed": f"""WITH {USER}, c AS (SELECT id, id % 3 AS cluster FROM v), m AS (SELECT count(*)::DOUBLE AS m FROM e),
  k AS (SELECT cluster, sum(o) AS o, sum(i) AS i, sum(l) AS l FROM (SELECT x.cluster, 1 AS o, 0 AS i, CAST(x.cluster = y.cluster AS INT) AS l FROM e JOIN c x ON x.id = e.src JOIN c y ON y.id = e.dst UNION ALL SELECT y.cluster, 0, 1, 0 FROM e JOIN c y ON y.id = e.dst) GROUP BY 1)
  SELECT {r('sum(l / m - o * i / (m * m))', 'modularity')} FROM k, m""",
        "laplacian": f"WITH {SUPP} SELECT src AS i, dst AS j, -1.0::DOUBLE AS value FROM a UNION ALL SELECT src, src, count(*)::DOUBLE FROM a GROUP BY src",
        "laplacian_directed": f"""WITH RECURSIVE {DIRECTED.format(edges=FLOW)}, nn AS (SELECT count(*)::DOUBLE AS n FROM v), o AS (SELECT src, count(*) AS o FROM a GROUP BY src),
  p AS MATERIALIZED (SELECT x.id AS i, y.id AS j, 0.05 / n + 0.95 * CASE WHEN o IS NULL THEN 1.0 / n WHEN a.src IS NULL THEN 0.0 ELSE 1.0 / o END AS p
    FROM v x CROSS JOIN v y CROSS JOIN nn LEFT JOIN o ON o.src = x.id LEFT JOIN a ON a.src = x.id AND a.dst = y.id),
  ph AS (SELECT 0 AS k, id, 1.0 / n AS f FROM v, nn UNION ALL SELECT ph.k + 1, p.j, sum(ph.f * p.p) FROM ph JOIN p ON p.i = ph.id WHERE ph.k < 200 GROUP BY ph.k, p.j),
  f AS (SELECT id, f FROM ph WHERE k = 200)
  SELECT x.i, x.j, {r('CASE WHEN x.i = x.j THEN 1.0 ELSE 0.0 END - (sqrt(s.f / t.f) * x.p + sqrt(t.f / s.f) * y.p) / 2', 'value')} FROM p x JOIN p y ON y.i = x.j AND y.j = x.i JOIN f s ON s.id = x.i JOIN f t ON t.id = x.j""",
        "neighbors": f"WITH {USER} SELECT DISTINCT dst AS id FROM e WHERE src = 3",
        "predecessors": f"WITH {USER} SELECT DISTINCT src AS id FROM e WHERE dst = 3",
        "non_neighbors": f"WITH {SUPP} SELECT id FROM v WHERE id <> 3 AND id NOT IN (SELECT dst FROM a WHERE src = 3)",
        "out_degrees": f"WITH {USER}, {DD} SELECT id, o AS degree FROM d",
        "subgraph": f"WITH {SUPP}, picked AS (SELECT id FROM v ORDER BY md5('1:' || id), id LIMIT 50) SELECT src, dst FROM e WHERE src IN (FROM picked) AND dst IN (FROM picked)",
        "has_edge": f"WITH {USER} SELECT x.dst AS src, x.src AS dst FROM e x JOIN e y ON y.src = x.dst AND y.dst = x.src",
        "remove_edges": f"WITH {SUPP}, picked AS (SELECT id FROM v ORDER BY md5('1:' || id), id LIMIT 20) SELECT src, dst FROM e WHERE src NOT IN (FROM picked)",
        "add_edges": f"WITH {SUPP} SELECT src, dst FROM e UNION SELECT id, id + 1 FROM v",
        "reached": f"WITH {AUCTION}, {HOPS} SELECT auction, bidder FROM inside",
        "reached_closure": f"WITH RECURSIVE {AUCTION}, inside AS (SELECT auction, bidder FROM sel UNION SELECT rep.auction, rep.reported FROM rep JOIN inside ON inside.auction = rep.auction AND inside.bidder = rep.bidder) SELECT auction, bidder FROM inside",
        "priority_queue": f"WITH {AUCTION} SELECT * FROM (SELECT auction, bidder, bid, row_number() OVER (PARTITION BY auction ORDER BY bid DESC, bidder) AS place FROM b) WHERE place <= 3",
        "vcg": f"WITH {AUCTION}, {HOPS}, {vcg} SELECT b.auction, b.bidder, place IS NOT NULL AND place <= 4 AND price IS NOT NULL AS allocated, {r('CASE WHEN place <= 4 THEN coalesce(price, 0) ELSE 0 END', 'payment')} FROM b LEFT JOIN best USING (auction, bidder) LEFT JOIN price ON price.auction = b.auction",
        "vcg_canonical": f"WITH {AUCTION}, {HOPS}, {vcg} SELECT b.auction, b.bidder, place IS NOT NULL AND place <= 4 AS allocated, {r('CASE WHEN place <= 4 THEN coalesce(price, 0) ELSE 0 END', 'payment')} FROM b LEFT JOIN best USING (auction, bidder) LEFT JOIN price ON price.auction = b.auction",
        "bandit_rewards": f"WITH {ALIVE}, v AS (SELECT src AS id FROM g UNION SELECT dst FROM g) SELECT sim, id AS arm, (SELECT count(*) FROM alive WHERE alive.sim = s.sim AND src = id) AS reward FROM v, range(0, 50) s(sim)",
        "bandit_reachable": f"WITH {ALIVE} SELECT sim, dst AS id FROM alive WHERE src = 3",
        "bandit_curves": f"SELECT t, {r('pow(t, 2.0 / 3) * pow(50.0 * ln(t), 1.0 / 3)', 'eps_greedy')}, {r('sqrt(25.0 * t * ln(5000))', 'ucb')} FROM range(1, 5001) x(t)",
        "decay_functions": f"SELECT t AS id, {r('CASE WHEN t = 0 THEN 1.0 ELSE 1.0 / t END', 'inverse')}, {r('exp(-0.1 * t)', 'exponential')}, {r('CASE WHEN t = 0 THEN 1.0 ELSE pow(t, -0.1) END', 'power')}, CAST(t % 2 + t % 3 % 2 * 2 + 4 AS BIGINT) AS cluster FROM range(0, 50) x(t)",
        "streaming_degrees": """WITH x AS (SELECT date_trunc('day', ts) AS start, user_id AS src, user_id % 7 AS dst FROM events)
  SELECT start, id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM (SELECT start, src AS id, 0 AS i, 1 AS o FROM x UNION ALL SELECT start, dst, 1, 0 FROM x) GROUP BY 1, 2""",
        "graph_user_next": NEXT,
        "graph_nation_flow": FLOW,
        "graph_cust_supp": "SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'",
        "graph_page_links": """SELECT DISTINCT src, dst FROM (SELECT src, regexp_replace(href, '^[a-z]+://[^/]+|^/+', '') AS dst FROM (
  SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS src, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)) WHERE src <> '' AND dst <> ''""",
    }
    return found
