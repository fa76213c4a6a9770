"""Graphs made from the tables: TRADE (nation to nation), PARTSUPP, NEXTPART (parts that follow in an order), KNN of the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import communities, graph, stats
from . import query, table

TRADE = """
WITH trade AS (
  SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
clusters AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS cluster FROM nation)"""
PARTS = "WITH parts AS (SELECT l_partkey AS src, l_suppkey + 1000000000 AS dst, count(*) AS w FROM lineitem GROUP BY ALL)"
NEXT = """
WITH n AS (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS dst FROM lineitem),
nxt AS (SELECT src, dst, count(*) AS w FROM n WHERE dst IS NOT NULL GROUP BY ALL)"""


def trade(spark, sf_dir) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    joined = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst")).agg(F.count("*").alias("w"))


def regions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_regionkey").alias("cluster"))


def partsupp(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1_000_000_000).alias("dst")).agg(F.count("*").alias("w"))


def nextpart(spark, sf_dir) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    n = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"))
    return n.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("w"))


@query("net_props", TRADE + """ SELECT (SELECT count(*) FROM (SELECT src FROM trade UNION SELECT dst FROM trade)) AS n, count(*) AS m, CAST(sum(w) AS BIGINT) AS total, count(*) FILTER (src = dst) AS loops, max(w) AS max_w,
  round_even(count(*) / (25.0 * 24), 6) AS density FROM trade""")
def net_props(spark, sf_dir):
    e = trade(spark, sf_dir)
    block = e.agg(F.sum("w").alias("total"), F.count_if(F.col("src") == F.col("dst")).alias("loops"), F.max("w").alias("max_w"))
    return graph.size(e).crossJoin(block).select("n", "m", "total", "loops", "max_w", F.bround(F.col("m") / (F.col("n") * (F.col("n") - 1)), 6).alias("density"))


@query("edge_weights", NEXT + " SELECT src, dst, CAST(w AS BIGINT) AS w FROM nxt")
def edge_weights(spark, sf_dir):
    e = nextpart(spark, sf_dir)
    return graph.weighted(e.select("src", "dst", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))).alias("w")))


@query("edge_clean", "SELECT l_partkey AS src, l_suppkey AS dst, CAST(CASE WHEN sum(l_linenumber - 4) <= 0 THEN 1 ELSE sum(l_linenumber - 4) END AS BIGINT) AS w FROM lineitem GROUP BY ALL HAVING NOT (max(l_linenumber) = 5 AND min(l_linenumber) = 5) UNION ALL SELECT l_partkey, l_suppkey, count(*) FROM lineitem GROUP BY ALL HAVING max(l_linenumber) = 5 AND min(l_linenumber) = 5")
def edge_clean(spark, sf_dir):
    return graph.cleaned(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_linenumber") - 4).alias("w")))


@query("edge_noloop", NEXT + " SELECT src, dst, w FROM nxt WHERE src <> dst")
def edge_noloop(spark, sf_dir):
    return graph.without_parallels(graph.without_loops(nextpart(spark, sf_dir)))


@query("edge_renumber", PARTS + ", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM parts UNION SELECT dst FROM parts)) SELECT a.k AS src, b.k AS dst, w FROM parts JOIN ids a ON src = a.id JOIN ids b ON dst = b.id")
def edge_renumber(spark, sf_dir):
    return graph.renumbered(partsupp(spark, sf_dir))


@query("edge_subsample", NEXT + " SELECT src, dst, w FROM nxt WHERE src < 100 AND dst < 100")
def edge_subsample(spark, sf_dir):
    return nextpart(spark, sf_dir).where("src < 100 and dst < 100")


DEGREES = ", d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM nxt UNION ALL SELECT dst FROM nxt) GROUP BY id)"


@query("net_degree", NEXT + DEGREES + " SELECT * FROM d")
def net_degree(spark, sf_dir):
    return graph.degrees(nextpart(spark, sf_dir))


@query("net_degree_hist", NEXT + DEGREES + " SELECT g.degree, coalesce(n, 0) AS n FROM (SELECT unnest(range(1, (SELECT max(degree) + 1 FROM d))) AS degree) g LEFT JOIN (SELECT degree, count(*) AS n FROM d GROUP BY degree) h USING (degree)")
def net_degree_hist(spark, sf_dir):
    return graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)))


@query("net_degree_hist_present", NEXT + DEGREES + " SELECT degree, count(*) AS n FROM d GROUP BY degree")
def net_degree_hist_present(spark, sf_dir):
    return graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)), filled=False)


@query("net_density", PARTS + ", s AS (SELECT count(*) AS n FROM (SELECT src FROM parts UNION SELECT dst FROM parts)) SELECT round_even(2.0 * (SELECT count(*) FROM parts) / (n * (n - 1)), 9) AS density FROM s")
def net_density(spark, sf_dir):
    return graph.density(partsupp(spark, sf_dir), directed=False).select(F.bround("density", 9).alias("density"))


@query("net_symmetry", TRADE + " SELECT bool_and(coalesce(a.w = b.w, false)) AS symmetric, bool_and(a.src <= a.dst) OR bool_and(a.src >= a.dst) AS one_triangle FROM trade a LEFT JOIN trade b ON a.src = b.dst AND a.dst = b.src")
def net_symmetry(spark, sf_dir):
    return graph.is_symmetric(trade(spark, sf_dir))


@query("net_symmetrize", TRADE + " SELECT src, dst, w FROM trade WHERE src <= dst UNION ALL SELECT dst, src, w FROM trade WHERE src < dst")
def net_symmetrize(spark, sf_dir):
    return graph.symmetrised(trade(spark, sf_dir))


@query("net_undirected", NEXT + " SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM nxt")
def net_undirected(spark, sf_dir):
    return graph.undirected(nextpart(spark, sf_dir))


@query("net_adjacency", TRADE + " SELECT dst AS i, src AS j, w FROM trade")
def net_adjacency(spark, sf_dir):
    return graph.adjacency(trade(spark, sf_dir))


@query("net_laplacian", TRADE + " SELECT i, j, CAST(sum(w) AS BIGINT) AS w FROM (SELECT dst AS i, dst AS j, w FROM trade UNION ALL SELECT dst, src, -w FROM trade) GROUP BY i, j HAVING sum(w) <> 0")
def net_laplacian(spark, sf_dir):
    return graph.laplacian(trade(spark, sf_dir))


@query("net_neighbors", TRADE + " SELECT src AS id, string_agg(dst || ':' || w, ' ' ORDER BY dst, w) AS list FROM trade GROUP BY src")
def net_neighbors(spark, sf_dir):
    n = graph.neighbours(trade(spark, sf_dir))
    return n.select("id", F.array_join(F.transform("neighbours", lambda x: F.concat(x["node"].cast("string"), F.lit(":"), x["w"].cast("string"))), " ").alias("list"))


@query("net_lookup", TRADE + " SELECT CAST(a.n_nationkey AS BIGINT) AS src, CAST(b.n_nationkey AS BIGINT) AS dst, coalesce(w, 0) AS w FROM nation a CROSS JOIN nation b LEFT JOIN trade ON src = a.n_nationkey AND dst = b.n_nationkey WHERE a.n_nationkey < b.n_nationkey")
def net_lookup(spark, sf_dir):
    ids = regions(spark, sf_dir).select("id")
    pairs = ids.select(F.col("id").alias("src")).join(ids.select(F.col("id").alias("dst")), F.col("src") < F.col("dst"))
    return graph.lookup(trade(spark, sf_dir), pairs).select("src", "dst", "w")


@query("net_weight_stats", TRADE + ", r AS (SELECT src, sum(w) AS s FROM trade GROUP BY src) SELECT (SELECT round_even(avg(s), 6) FROM r) AS mean_row, (SELECT round_even(var_pop(s), 4) FROM r) AS var_row, count(*) AS nnz, max(w) AS max_w, count(DISTINCT w) AS distinct_w FROM trade")
def net_weight_stats(spark, sf_dir):
    return graph.weight_stats(trade(spark, sf_dir)).select(F.bround("mean_row", 6).alias("mean_row"), F.bround("var_row", 4).alias("var_row"), "nnz", "max_w", "distinct_w")


@query("net_relation_types", TRADE + " SELECT greatest(max(w) + 1, 2) AS types, bool_or(src = dst) AS has_loops FROM trade")
def net_relation_types(spark, sf_dir):
    return graph.relation_types(trade(spark, sf_dir))


@query("net_pair_count", NEXT + ", s AS (SELECT count(*) AS n FROM (SELECT src FROM nxt UNION SELECT dst FROM nxt)) SELECT n * (n - 1) - 10 AS pairs FROM s")
def net_pair_count(spark, sf_dir):
    return graph.possible_pairs(nextpart(spark, sf_dir), tested=10)


SIMPLE = ", u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM nxt WHERE src <> dst), t AS (SELECT x.a, x.b, y.b AS c FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b), dg AS (SELECT id, count(*) AS d FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id)"


@query(
    "net_clustering",
    NEXT + SIMPLE + """, tn AS (SELECT id, count(*) AS t FROM (SELECT a AS id FROM t UNION ALL SELECT b FROM t UNION ALL SELECT c FROM t) GROUP BY id),
al AS (SELECT src AS id FROM nxt UNION SELECT dst FROM nxt)
SELECT round_even(avg(CASE WHEN d > 1 THEN 2.0 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END), 6) AS average_clustering, round_even(sum(coalesce(t, 0)) / sum(coalesce(d, 0) * (coalesce(d, 0) - 1) / 2.0), 6) AS transitivity
FROM al LEFT JOIN dg USING (id) LEFT JOIN tn USING (id)""",
)
def net_clustering(spark, sf_dir):
    return graph.clustering(nextpart(spark, sf_dir)).select(F.bround("average_clustering", 6).alias("average_clustering"), F.bround("transitivity", 6).alias("transitivity"))


@query("net_triangles", NEXT + SIMPLE + " SELECT count(*) AS n FROM t")
def net_triangles(spark, sf_dir):
    return graph.triangles(nextpart(spark, sf_dir)).agg(F.count("*").alias("n"))


TAGGED = TRADE + ", g AS (SELECT src, dst, w, a.cluster AS k, b.cluster AS l FROM trade JOIN clusters a ON src = a.id JOIN clusters b ON dst = b.id)"

for _name, _w, _flag in (("net_modularity", "1", False), ("net_modularity_weighted", "w", True)):
    query(
        _name,
        TAGGED + f""", m AS (SELECT sum({_w}) AS m FROM g), i AS (SELECT k AS c, sum({_w}) AS inside FROM g WHERE k = l GROUP BY k), e AS (SELECT c, sum(x) AS ends FROM (SELECT k AS c, {_w} AS x FROM g UNION ALL SELECT l, {_w} FROM g) GROUP BY c)
SELECT round_even(sum(coalesce(inside, 0) / m - pow(ends / (2.0 * m), 2)), 6) AS modularity FROM e LEFT JOIN i USING (c), m""",
    )(lambda spark, sf_dir, flag=_flag: graph.modularity(trade(spark, sf_dir), regions(spark, sf_dir), flag).select(F.bround("modularity", 6).alias("modularity")))


@query("net_blocks", TAGGED + " SELECT k, l, src AS id, count(*) AS n FROM g GROUP BY k, l, src")
def net_blocks(spark, sf_dir):
    return graph.block_degrees(trade(spark, sf_dir), regions(spark, sf_dir))


@query("net_block_order", "SELECT CAST(n_nationkey AS BIGINT) AS id, n_regionkey AS cluster, CAST(dense_rank() OVER (ORDER BY c DESC, n_regionkey DESC) - 1 AS INT) AS rank FROM (SELECT *, count(*) OVER (PARTITION BY n_regionkey) AS c FROM nation)")
def net_block_order(spark, sf_dir):
    return graph.by_cluster_size(regions(spark, sf_dir)).select("id", "cluster", "rank")


@query("net_one_hot", "SELECT CAST(n_nationkey AS BIGINT) AS id, " + ", ".join(f'CAST(n_regionkey = {i} AS BIGINT) AS "{i}"' for i in range(5)) + " FROM nation")
def net_one_hot(spark, sf_dir):
    return graph.one_hot(regions(spark, sf_dir), list(range(5)))


SIMILAR = ", z AS (SELECT sum(n * n) AS alike, sum(n) AS nodes FROM (SELECT count(*) AS n FROM clusters GROUP BY cluster))"


@query("net_homophily", TAGGED + SIMILAR + " SELECT round_even(count(*) FILTER (k = l AND src <> dst) / count(*), 6) AS observed, round_even((SELECT alike / (nodes * (nodes - 1)) FROM z), 6) AS expected FROM g")
def net_homophily(spark, sf_dir):
    return graph.homophily(trade(spark, sf_dir), regions(spark, sf_dir)).select(F.bround("observed", 6).alias("observed"), F.bround("expected", 6).alias("expected"))


@query("net_assortativity", TAGGED + SIMILAR + ", c AS (SELECT count(*) FILTER (k = l) AS a, count(*) FILTER (k <> l) AS b FROM g WHERE src <> dst) SELECT round_even((a + (nodes * (nodes - 1) - (alike - nodes) - b) - b - (alike - nodes - a)) / (nodes * (nodes - 1)), 6) AS assortativity FROM c, z")
def net_assortativity(spark, sf_dir):
    return graph.assortativity(trade(spark, sf_dir), regions(spark, sf_dir)).select(F.bround("assortativity", 6).alias("assortativity"))


DRAW = "md5(concat_ws('|', '0', src, dst))"


@query("net_split", NEXT + f", d AS (SELECT *, row_number() OVER (ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM nxt) * 0.2) AS BIGINT) AS is_test FROM nxt) SELECT src, dst, w, is_test FROM d")
def net_split(spark, sf_dir):
    return graph.test_split(nextpart(spark, sf_dir), 0.2).select("src", "dst", "w", "is_test")


@query("net_split_checks", NEXT + " SELECT CAST(floor(count(*) * 0.2) AS BIGINT) AS n_test, count(*) - CAST(floor(count(*) * 0.2) AS BIGINT) AS n_train, CAST(0 AS BIGINT) AS non_edges_that_are_edges, CAST(500 AS BIGINT) AS n_non_edges FROM nxt")
def net_split_checks(spark, sf_dir):
    e = nextpart(spark, sf_dir)
    none = graph.non_edges(e, 500)
    wrong = none.join(e, ["src", "dst"], "left_semi").agg(F.count("*").alias("non_edges_that_are_edges"))
    counts = graph.test_split(e, 0.2).agg(F.count_if("is_test").alias("n_test"), F.count_if(~F.col("is_test")).alias("n_train"))
    return counts.crossJoin(wrong).crossJoin(none.agg(F.count("*").alias("n_non_edges")))


CELLS = TRADE + ", c AS (SELECT src, dst, CASE WHEN w > 30 THEN 1 ELSE 0 END AS w FROM trade)"


def cells(spark, sf_dir):
    return trade(spark, sf_dir).select("src", "dst", F.when(F.col("w") > 30, 1).otherwise(0).alias("w"))


@query("net_mask_random", CELLS + f" SELECT src, dst, w, src = dst OR (src <> dst AND row_number() OVER (PARTITION BY src = dst ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM c) * 0.3) AS BIGINT)) AS masked FROM c")
def net_mask_random(spark, sf_dir):
    return graph.random_mask(cells(spark, sf_dir), 0.3).select("src", "dst", "w", "masked")


@query("net_mask_balanced", CELLS + f" SELECT src, dst, w, src <> dst AND row_number() OVER (PARTITION BY src = dst, w > 0 ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM c WHERE w > 0) * 0.1) AS BIGINT) AS masked FROM c")
def net_mask_balanced(spark, sf_dir):
    return graph.balanced_mask(cells(spark, sf_dir), 0.1).select("src", "dst", "w", "masked")


@query("net_mask_zeros", CELLS + " SELECT src, dst, w = 0 AS masked FROM c")
def net_mask_zeros(spark, sf_dir):
    return cells(spark, sf_dir).select("src", "dst", (F.col("w") == 0).alias("masked"))


def _drawn(seed: int, *key: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(key)})), 1, 15) AS BIGINT)"


def _non_edges(edges: str, n: str, seed: int) -> str:
    """CTEs ids, free: n pairs of NEXT's nodes without an edge, one drawn from each n-th part of all of them in order of ids."""
    return f""", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM (SELECT src AS id FROM nxt UNION SELECT dst FROM nxt)),
absent AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS r, count(*) OVER () AS every FROM (SELECT a.id AS src, b.id AS dst FROM ids a JOIN ids b ON a.id <> b.id) ANTI JOIN {edges} USING (src, dst)),
k AS (SELECT {n} AS n, (SELECT max(every) FROM absent) AS every),
t AS (SELECT t, CAST(CAST(t AS HUGEINT) * every // n AS BIGINT) AS lo, CAST(CAST(t + 1 AS HUGEINT) * every // n AS BIGINT) AS hi FROM (SELECT unnest(range(n)) AS t, every, n FROM k)),
free AS (SELECT src, dst FROM absent JOIN (SELECT lo + {_drawn(seed, 't', "'pair'")} % (hi - lo) AS r FROM t) USING (r))"""


@query("net_noise", NEXT + _non_edges("nxt", "2 * CAST(floor((SELECT count(*) FROM nxt) * 0.05) AS BIGINT)", 1) + f""", d AS (SELECT src, dst, w - CASE WHEN row_number() OVER (ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM nxt) * 0.05) AS BIGINT) THEN 1 ELSE 0 END AS w FROM nxt)
SELECT src, dst, w FROM d WHERE w > 0 UNION ALL SELECT src, dst, 1 FROM free""")
def net_noise(spark, sf_dir):
    return graph.add_noise(nextpart(spark, sf_dir), 0.05)


@query("net_full_split", NEXT + _non_edges("nxt", "CAST(floor(CAST(floor((SELECT count(*) FROM nxt) * (0.2 * 1.5)) AS BIGINT) * 0.5) AS BIGINT)", 1) + f""", d AS (SELECT *, row_number() OVER (ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM nxt) * (0.2 * 1.5)) AS BIGINT) AS held FROM nxt),
r AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '2', src, dst)), src, dst) AS k, count(*) OVER () AS n FROM d WHERE NOT held)
SELECT src, dst, w, 'test' AS part FROM d WHERE held UNION ALL SELECT src, dst, 0, 'test' FROM free UNION ALL SELECT src, dst, w, CASE WHEN k <= CAST(floor(n - 0.8 * n) AS BIGINT) THEN 'gone' ELSE 'train' END FROM r""")
def net_full_split(spark, sf_dir):
    return graph.full_split(nextpart(spark, sf_dir), 20, 50, 0.5, 80)


@query("net_inverted", NEXT + f" SELECT src, dst, w, row_number() OVER (ORDER BY {DRAW}, src, dst) > CAST(floor((SELECT count(*) FROM nxt) * 0.2) AS BIGINT) AS is_test FROM nxt")
def net_inverted(spark, sf_dir):
    return graph.inverted(graph.test_split(nextpart(spark, sf_dir), 0.2)).select("src", "dst", "w", "is_test")


def _minibatch_sql(sparse: bool) -> str:
    zero, link = ("(n - degree - 1) * 10", "n * degree") if sparse else ("3 * 10", "n * 3")
    return NEXT + f""", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM (SELECT src AS id FROM nxt UNION SELECT dst FROM nxt)),
u AS (SELECT batch, n, {_drawn(0, 'batch', "'node'")} % n AS place, ({_drawn(0, 'batch', "'set'")} % 1000000) / 1e6 AS u FROM (SELECT unnest(range(40)) AS batch, (SELECT max(n) FROM ids) AS n)),
s AS (SELECT batch, u.n, id AS node, unnest(CASE WHEN u < 0.5 THEN ['zeros out', 'zeros in'] WHEN u < 0.75 THEN ['out'] ELSE ['in'] END) AS part FROM u JOIN ids USING (place)),
ends AS (SELECT src AS node, 'out' AS way, dst AS other, w FROM nxt UNION ALL SELECT dst, 'in', src, w FROM nxt),
l AS (SELECT batch, n, part, node, way, other, w FROM (SELECT *, replace(part, 'zeros ', '') AS way FROM s) JOIN ends USING (node, way)),
g AS (SELECT batch, n, part, way, node, count(*) AS degree FROM l GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY batch, part ORDER BY place) - 1 AS k, count(*) OVER (PARTITION BY batch, part) AS free FROM (SELECT batch, part, way, node, id AS other, place FROM g, ids WHERE part LIKE 'zeros%' AND id <> node) ANTI JOIN ends USING (node, way, other)),
f AS (SELECT batch, part, way, node, other, 0 AS w FROM m WHERE k % 10 = {_drawn(0, 'batch', 'part', 'k // 10')} % least(10, free - k // 10 * 10)),
seen AS (SELECT batch, part, way, node, other, w FROM l WHERE part NOT LIKE 'zeros%' UNION ALL SELECT batch, part, way, node, other, w FROM f)
SELECT batch, part, 'scale' AS kind, node AS src, NULL AS dst, CAST(CASE WHEN part LIKE 'zeros%' THEN {zero} ELSE {link} END AS DOUBLE) AS w FROM g
UNION ALL SELECT batch, part, 'edge', CASE WHEN way = 'out' THEN node ELSE other END, CASE WHEN way = 'out' THEN other ELSE node END, CAST(w AS DOUBLE) FROM seen"""


for _name, _flag in (("net_minibatch", False), ("net_minibatch_sparse", True)):
    query(_name, _minibatch_sql(_flag))(lambda spark, sf_dir, flag=_flag: graph.minibatches(nextpart(spark, sf_dir), 40, sparse=flag))


@query(
    "net_components",
    """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, l_partkey + 10000000000 AS b FROM lineitem), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(id, component) USING KEY (id) AS (
  SELECT DISTINCT a, a FROM u
  UNION SELECT * FROM (SELECT u.b AS id, min(r.component) AS component FROM r JOIN u ON r.id = u.a GROUP BY u.b) n WHERE component < (SELECT o.component FROM recurring.r o WHERE o.id = n.id))
SELECT id, component FROM r""",
)
def net_components(spark, sf_dir):
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + 10_000_000_000).alias("dst")).distinct()
    return graph.components(edges)


@query(
    "net_diameter",
    TRADE.replace("WITH trade", "WITH RECURSIVE trade") + """, u AS (SELECT src AS a, dst AS b FROM trade WHERE src <> dst UNION SELECT dst, src FROM trade WHERE src <> dst),
r AS (SELECT DISTINCT a AS s, a AS id, 0 AS d FROM u UNION SELECT r.s, u.b, r.d + 1 FROM r JOIN u ON r.id = u.a WHERE r.d < 25),
m AS (SELECT s, id, min(d) AS d FROM r GROUP BY s, id), far AS (SELECT id FROM m WHERE s = 0 ORDER BY d DESC, id LIMIT 1)
SELECT (SELECT CASE WHEN count(*) = count(DISTINCT s) * count(DISTINCT s) THEN max(d) END FROM m) AS diameter, (SELECT max(d) FROM m WHERE s = (SELECT id FROM far)) AS pseudo""",
)
def net_diameter(spark, sf_dir):
    e = graph.without_loops(trade(spark, sf_dir))
    return spark.range(1).select(F.lit(graph.diameter(e)).cast("int").alias("diameter"), F.lit(graph.pseudo_diameter(e, 0)).cast("int").alias("pseudo"))


MATCHED = NEXT + """, o AS (SELECT src, row_number() OVER (ORDER BY md5(concat_ws('|', '0', 'out', src, dst)), src, dst) AS k FROM nxt), i AS (SELECT dst, row_number() OVER (ORDER BY md5(concat_ws('|', '0', 'in', src, dst)), src, dst) AS k FROM nxt),
gen AS (SELECT src, dst FROM o JOIN i USING (k))"""


def brands(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("cluster"))


@query("net_stub_matched", MATCHED + " SELECT src, dst FROM gen")
def net_stub_matched(spark, sf_dir):
    return graph.stub_matched(nextpart(spark, sf_dir))


@query("net_stub_matched_undirected", NEXT + """, e AS (SELECT src AS id, 'out' AS e, src, dst FROM nxt UNION ALL SELECT dst, 'in', src, dst FROM nxt), k AS (SELECT id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', e, src, dst)), src, dst, e) - 1 AS k FROM e)
SELECT a.id AS src, b.id AS dst FROM k a JOIN k b ON b.k = a.k + 1 WHERE a.k % 2 = 0""")
def net_stub_matched_undirected(spark, sf_dir):
    return graph.stub_matched(nextpart(spark, sf_dir), directed=False)


@query("net_assortativity_generated", MATCHED + """, brand AS (SELECT p_partkey AS id, p_brand AS c FROM part), p AS (SELECT a.id AS src, b.id AS dst, a.c = b.c AS s FROM brand a, brand b WHERE a.id <> b.id),
c AS (SELECT CASE WHEN s THEN 0 ELSE 1 END + CASE WHEN x.src IS NULL THEN 2 ELSE 0 END AS a, CASE WHEN s THEN 0 ELSE 1 END + CASE WHEN y.src IS NULL THEN 2 ELSE 0 END AS b, count(*) AS n
  FROM p LEFT JOIN nxt x USING (src, dst) LEFT JOIN (SELECT DISTINCT src, dst FROM gen) y USING (src, dst) GROUP BY ALL),
t AS (SELECT sum(n) AS t, sum(CASE WHEN a IN (0, 3) THEN n ELSE -n END) / sum(n) AS source, sum(CASE WHEN b IN (0, 3) THEN n ELSE -n END) / sum(n) AS learned FROM c),
r AS (SELECT a, sum(n) AS x FROM c GROUP BY a), q AS (SELECT b, sum(n) AS y FROM c GROUP BY b)
SELECT round_even(source, 9) AS source, round_even(learned, 9) AS learned, round_even(2 * (SELECT sum(n / t * ln(n * t / (x * y))) FROM c JOIN r USING (a) JOIN q USING (b), t) / ((SELECT -sum(x / t * ln(x / t)) FROM r, t) + (SELECT -sum(y / t * ln(y / t)) FROM q, t)), 6) AS nmi FROM t""")
def net_assortativity_generated(spark, sf_dir):
    edges = nextpart(spark, sf_dir)
    found = graph.assortativity_compared(edges, brands(spark, sf_dir), graph.stub_matched(edges))
    return found.select(F.bround("source", 9).alias("source"), F.bround("learned", 9).alias("learned"), F.bround("nmi", 6).alias("nmi"))


@query("net_louvain")
def net_louvain(spark, sf_dir):
    return communities.louvain(trade(spark, sf_dir))


@query("net_louvain_levels", TRADE + " SELECT count(*) AS nodes, true AS whole, true AS nested, true AS rising, true AS recomputed FROM (SELECT src FROM trade UNION SELECT dst FROM trade)")
def net_louvain_levels(spark, sf_dir):
    """What holds of any hierarchy: each level has every node, joins clusters of the one before, and has a higher modularity, which is that of its clusters."""
    edges = trade(spark, sf_dir)
    levels = communities.hierarchy(edges)
    values = [level.modularity for level in levels]
    again = [graph.modularity(edges, level.clusters, weighted=True).first()[0] for level in levels]
    counts = communities.as_table(levels).groupBy("level").agg(F.count_distinct("id").alias("n"), F.count("*").alias("rows"))
    split = [one.clusters.join(two.clusters.withColumnRenamed("cluster", "up"), "id").groupBy("cluster").agg(F.count_distinct("up").alias("n")).where("n > 1").isEmpty() for one, two in zip(levels, levels[1:], strict=False)]
    held = [F.lit(x).alias(n) for n, x in (("nested", all(split)), ("rising", all(a < b for a, b in zip(values, values[1:], strict=False))), ("recomputed", all(abs(a - b) < 1e-9 for a, b in zip(values, again, strict=True))))]
    return counts.agg(F.max("n").alias("nodes"), ((F.min("n") == F.max("n")) & (F.max("rows") == F.max("n"))).alias("whole")).select("nodes", "whole", *held)


@query("net_annealing_energy", TAGGED + """, s AS (SELECT cluster, count(*) AS size FROM clusters GROUP BY cluster), t AS (SELECT sum(size) AS k, count(*) AS c FROM s),
i AS (SELECT k AS cluster, sum(w) AS x FROM g WHERE k = l GROUP BY k), o AS (SELECT cluster, sum(w) AS y FROM (SELECT k AS cluster, w FROM g WHERE k <> l UNION ALL SELECT l, w FROM g WHERE k <> l) GROUP BY cluster),
r AS (SELECT c, coalesce(x, 0) / (size * size) AS i, coalesce(y, 0) / (2 * (k * size - size * size)) AS o FROM s LEFT JOIN i USING (cluster) LEFT JOIN o USING (cluster), t)
SELECT round_even((sum(i) - sum(o) * sum(o) / c) / c, 4) AS energy FROM r GROUP BY c""")
def net_annealing_energy(spark, sf_dir):
    return stats.annealing_energy(trade(spark, sf_dir), regions(spark, sf_dir)).select(F.bround("energy", 4).alias("energy"))


@query("net_annealed")
def net_annealed(spark, sf_dir):
    return stats.annealed(trade(spark, sf_dir).withColumn("g", F.lit(0)), "g", 4)


@query("net_bilinear", TAGGED + " SELECT src, dst, round_even(0.9 * 0.9 * CASE WHEN k = l THEN 0.5 ELSE 0.1 END, 9) AS likelihood FROM g")
def net_bilinear(spark, sf_dir):
    c = regions(spark, sf_dir)
    theta = c.select("id", F.col("cluster").alias("k"), F.lit(0.9).alias("p"))
    ks = c.select(F.col("cluster").alias("k")).distinct()
    phi = ks.crossJoin(ks.select(F.col("k").alias("l"))).withColumn("p", F.when(F.col("k") == F.col("l"), 0.5).otherwise(0.1))
    return graph.bilinear(trade(spark, sf_dir), theta, phi).select("src", "dst", F.bround("likelihood", 9).alias("likelihood"))


@query("net_dot", TRADE + " SELECT src || ' -> ' || dst || ' [weight=' || w || '];' AS line FROM trade")
def net_dot(spark, sf_dir):
    return graph.to_dot(trade(spark, sf_dir))


#: Queries: every vector whose id 20 divides, against all others of the table.
PAIRS = "WITH p AS (SELECT a.vec_id AS i, b.vec_id AS j, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0)"


def vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


for _how, _expr in (("dot", "round_even(list_inner_product(a, b), 5)"), ("cos", "round_even(list_cosine_similarity(a, b), 5)"), ("euclid", "CAST(list_distance(a, b) <= 5.0 AS DOUBLE)")):
    query(f"sim_{_how}", PAIRS + f" SELECT i, j, {_expr} AS similarity FROM p")(
        lambda spark, sf_dir, how=_how: graph.similarity_matrix((v := vectors(spark, sf_dir).select("id", "v")).where("id % 20 = 0"), v, how, 5.0, digits=5)
    )


for _how, _cond in (("old", "list_distance(a, b) <= 2.0 * 10 / 4"), ("abs", "abs(a[1] - b[1]) <= 5.0 OR abs(a[2] - b[2]) <= 5.0"), ("dist", "sqrt(2.0) * abs(a[1] - b[1]) <= 0.5")):
    query(f"sim_near_{_how}", PAIRS + f" SELECT i, j, CAST(CASE WHEN {_cond} THEN 1 ELSE -1 END AS DOUBLE) AS similarity FROM p")(
        lambda spark, sf_dir, how=_how: graph.near_similarity((v := vectors(spark, sf_dir)).where("id % 20 = 0"), v, 1.0 if how == "dist" else 10.0, 4, how)
    )


@query("sim_cluster", "SELECT a.vec_id AS i, b.vec_id AS j, CAST(CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS DOUBLE) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0")
def sim_cluster(spark, sf_dir):
    clusters = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))
    return graph.cluster_similarity(clusters.where("id % 20 = 0"), clusters)


NEAR = NEXT + ", e AS (SELECT src % 500 AS src, dst % 500 AS dst, CAST(sum(w) AS BIGINT) AS w FROM nxt GROUP BY ALL)"


@query("net_edge_similarity", NEAR + " SELECT src, dst, w, round_even(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM e JOIN embeddings a ON a.vec_id = src JOIN embeddings b ON b.vec_id = dst")
def net_edge_similarity(spark, sf_dir):
    edges = nextpart(spark, sf_dir).groupBy((F.col("src") % 500).alias("src"), (F.col("dst") % 500).alias("dst")).agg(F.sum("w").alias("w"))
    return graph.edge_similarity(edges, vectors(spark, sf_dir).select("id", "v")).select("src", "dst", "w", F.bround("similarity", 6).alias("similarity"))


@query("net_sparse_setup", NEXT + ", f AS (SELECT bool_or(m.src IS NULL) AND bool_or(a.src > a.dst) AND bool_or(a.src < a.dst) AS directed FROM nxt a LEFT JOIN nxt m ON a.src = m.dst AND a.dst = m.src WHERE a.src <> a.dst) SELECT src, dst, 2 * w + 2 AS w, directed FROM nxt, f WHERE src <> dst")
def net_sparse_setup(spark, sf_dir):
    edges, directed = graph.sparse_setup(nextpart(spark, sf_dir), shift="linear_2")
    return edges.withColumn("directed", F.lit(directed))


@query("net_dense_setup", CELLS + " SELECT src, dst, CAST(w <> 0 AS BIGINT) AS w FROM c")
def net_dense_setup(spark, sf_dir):
    return graph.dense_setup(cells(spark, sf_dir))


@query("net_from_matrix", TRADE + " SELECT least(src, dst) AS src, greatest(src, dst) AS dst, max(w) AS w, false AS directed FROM trade GROUP BY ALL")
def net_from_matrix(spark, sf_dir):
    t = trade(spark, sf_dir)
    both = t.union(t.select("dst", "src", "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))
    edges, directed = graph.from_matrix(both)
    return edges.withColumn("directed", F.lit(directed))


@query("net_without_vertices", NEXT + DEGREES + ", k AS (SELECT id FROM d WHERE degree >= 4) SELECT src, dst, w FROM nxt SEMI JOIN k a ON src = a.id SEMI JOIN k b ON dst = b.id")
def net_without_vertices(spark, sf_dir):
    return graph.without_vertices(nextpart(spark, sf_dir), 4)


@query("net_updated", PARTS + ", ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT src AS id FROM parts UNION SELECT dst FROM parts)) SELECT k AS id, p_size AS cluster FROM part JOIN ids ON p_partkey = ids.id")
def net_updated(spark, sf_dir):
    _, vertices = graph.updated(partsupp(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("cluster")))
    return vertices.select("id", "cluster")


@query("net_configured", NEXT + f""", x AS (SELECT src, dst, CAST(least(pow(2, w), 300) AS BIGINT) AS w FROM nxt),
k AS (SELECT id FROM (SELECT src AS id FROM x UNION SELECT dst FROM x) ORDER BY id LIMIT 150), s AS (SELECT src, dst, w FROM x SEMI JOIN k a ON src = a.id SEMI JOIN k b ON dst = b.id)
SELECT src, dst, w, row_number() OVER (ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM s) * 0.2) AS BIGINT) AS is_test FROM s""")
def net_configured(spark, sf_dir):
    return graph.configured(nextpart(spark, sf_dir), exponentiate=True, n=150, test_percent=20).select("src", "dst", "w", "is_test")


@query("net_annealing_degree", TRADE + " SELECT id, CAST(sum(w) AS BIGINT) AS degree FROM (SELECT src AS id, w FROM trade UNION ALL SELECT dst, w FROM trade WHERE src <> dst) GROUP BY id")
def net_annealing_degree(spark, sf_dir):
    return stats.annealing_degree(trade(spark, sf_dir))


@query("net_annealed_bounds")
def net_annealed_bounds(spark, sf_dir):
    return stats.annealed(trade(spark, sf_dir).withColumn("g", F.lit(0)), "g", 2, bounds=True)


@query(
    "stat_ami",
    """WITH j AS (SELECT p_size AS a, p_brand AS b, count(*) AS n FROM part GROUP BY ALL), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM j), r AS (SELECT a, CAST(sum(n) AS BIGINT) AS x FROM j GROUP BY a), c AS (SELECT b, CAST(sum(n) AS BIGINT) AS y FROM j GROUP BY b),
mi AS (SELECT sum(n / t * ln(n * t / (x * y))) AS mi FROM j JOIN r USING (a) JOIN c USING (b), t), ha AS (SELECT -sum(x / t * ln(x / t)) AS ha FROM r, t), hb AS (SELECT -sum(y / t * ln(y / t)) AS hb FROM c, t),
e AS (SELECT x, y, t, unnest(range(greatest(1, x + y - CAST(t AS BIGINT)), least(x, y) + 1)) AS n FROM r, c, t),
emi AS (SELECT sum(n / t * ln(t * n / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(x - n + 1) - lgamma(y - n + 1) - lgamma(t - x - y + n + 1))) AS emi FROM e)
SELECT round_even((mi - emi) / ((ha + hb) / 2 - emi), 6) AS ami FROM mi, ha, hb, emi""",
)
def stat_ami(spark, sf_dir):
    return graph.adjusted_mutual_information(table(spark, sf_dir, "part").select(F.col("p_size").alias("a"), F.col("p_brand").alias("b"))).select(F.bround("ami", 6).alias("ami"))


MASKED = CELLS + f", k AS (SELECT src, dst, w, src = dst OR (src <> dst AND row_number() OVER (PARTITION BY src = dst ORDER BY {DRAW}, src, dst) <= CAST(floor((SELECT count(*) FROM c) * 0.3) AS BIGINT)) AS masked FROM c)"


def masked(spark, sf_dir):
    return graph.random_mask(cells(spark, sf_dir), 0.3)


@query("net_observations", MASKED + " SELECT src, dst, w FROM k WHERE NOT masked AND src <= dst")
def net_observations(spark, sf_dir):
    return graph.observations(masked(spark, sf_dir), symmetric=True).select("src", "dst", "w")


@query("net_masked_sizes", MASKED + " SELECT id, count(*) AS seen FROM (SELECT src AS id FROM k WHERE NOT masked UNION ALL SELECT dst FROM k WHERE NOT masked AND src <> dst) GROUP BY id")
def net_masked_sizes(spark, sf_dir):
    return graph.masked_sizes(masked(spark, sf_dir))


@query("net_signed", MASKED + " SELECT src, dst, CASE WHEN masked THEN 0 WHEN w = 0 THEN -1 ELSE 1 END AS train, CASE WHEN NOT masked THEN 0 WHEN w = 0 THEN -1 ELSE 1 END AS test FROM k")
def net_signed(spark, sf_dir):
    return graph.signed(masked(spark, sf_dir))


@query("net_predict_masked", MASKED + """, p AS (SELECT w, CAST((CAST('0x' || substr(md5('0|' || src || '|' || dst), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 < 0.4 AS INT) AS y FROM k WHERE masked),
n AS (SELECT count(*) FILTER (w = 1 AND y = 1) AS tp, count(*) FILTER (w <> 1 AND y = 1) AS fp, count(*) FILTER (w = 1 AND y <> 1) AS fn, count(*) FILTER (w <> 1 AND y <> 1) AS tn FROM p)
SELECT tp, fp, fn, tn, tp / (tp + fp) AS prec, tp / (tp + fn) AS rec, (tp + tn) / (tp + fp + fn + tn) AS accuracy, (tp + fn) / (tp + fp + fn + tn) AS density FROM n""")
def net_predict_masked(spark, sf_dir):
    return stats.confusion(graph.predict_masked(masked(spark, sf_dir), F.lit(0.4)), "w", "predicted")


@query("net_mask_symmetric", CELLS + """, p AS (SELECT a, b, row_number() OVER (ORDER BY md5(concat_ws('|', '0', a, b)), a, b) <= CAST(floor((SELECT count(*) FROM c) * 0.3) AS BIGINT) // 2 AS hit FROM (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM c WHERE src <> dst))
SELECT src, dst, w, coalesce(hit, true) AS masked FROM c LEFT JOIN p ON a = least(src, dst) AND b = greatest(src, dst)""")
def net_mask_symmetric(spark, sf_dir):
    return graph.random_mask(cells(spark, sf_dir), 0.3, symmetric=True).select("src", "dst", "w", "masked")


@query("net_vertex_values", "SELECT CAST(k AS BIGINT) AS id, n_regionkey AS cluster FROM (SELECT unnest(range(0, 40, 3)) AS k) LEFT JOIN nation ON n_nationkey = k")
def net_vertex_values(spark, sf_dir):
    return graph.vertex_values(spark.range(0, 40, 3), regions(spark, sf_dir), "cluster")
