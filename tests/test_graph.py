"""Hand-derived graph and statistics cases."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import graph, results, search, stats, text


@pytest.fixture
def kite(spark):
    return spark.createDataFrame([(0, 1, 1), (0, 2, 1), (1, 2, 1), (2, 3, 1)], "src long, dst long, w long")


def test_kite(spark, kite):
    assert dict(map(tuple, graph.degrees(kite).collect())) == {0: 2, 1: 2, 2: 3, 3: 1}
    assert sorted(map(tuple, graph.degree_histogram(graph.degrees(kite)).collect())) == [(1, 1), (2, 2), (3, 1)]
    assert graph.density(kite, False).first()[0] == pytest.approx(2 / 3)
    c = graph.clustering(kite).first()
    assert c["average_clustering"] == pytest.approx(7 / 12) and c["transitivity"] == pytest.approx(0.6)
    assert graph.diameter(kite) == 2
    clusters = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 1)], "id long, cluster int")
    assert graph.modularity(kite, clusters).first()[0] == pytest.approx(-0.03125)
    assert {r["component"] for r in graph.components(kite).collect()} == {0}


def test_histogram_gaps(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 4)], "id long, degree long")
    assert sorted(map(tuple, graph.degree_histogram(d).collect())) == [(1, 2), (2, 0), (3, 0), (4, 1)]


def test_disconnected_has_no_diameter(spark):
    assert graph.diameter(spark.createDataFrame([(0, 1, 1), (2, 3, 1)], "src long, dst long, w long")) is None


def test_empty_graph(spark, kite):
    none = kite.where("false")
    assert graph.degrees(none).count() == graph.components(none).count() == 0


def test_cluster_histogram_order(spark):
    df = spark.createDataFrame([(x,) for x in (0, 0, 1, 1, 2)], "c int")
    assert [tuple(r) for r in stats.cluster_histogram(df, "c").collect()] == [(1, 2), (0, 2), (2, 1)]


def test_weighted_means(spark):
    m = stats.weighted_means(spark.createDataFrame([(1.0, 1.0), (4.0, 1.0)], "a double, w double"), "a", "w").first()
    assert tuple(m) == pytest.approx((2.0, 2.5, 1.6))


def test_power_law(spark):
    h = spark.createDataFrame([(1, 20), (2, 10), (3, 5), (4, 3), (5, 2)], "degree long, n long")
    assert stats.power_law(h).first()["alpha"] == pytest.approx(2.188169, abs=1e-6)


def test_zeta():
    import math

    assert stats.zeta(2.0, 1.0) == pytest.approx(math.pi**2 / 6, abs=1e-12)


def test_tokens(spark):
    df = spark.createDataFrame([("Hello, world! hello-World 42",), ("où élan",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.tokens_of(F.col("t"))).collect()] == [["hello", "world", "hello-world", "42"], ["o", "lan"], [], []]


def test_deltas(spark):
    log = spark.createDataFrame([(0, 3), (1, 5), (2, 4)], "it long, v long").withColumn("run", F.lit(1))
    assert [(r["v"], r["delta"]) for r in results.deltas(log, ["run"], ["it"], "v").orderBy("it").collect()] == [(3, 3), (5, 2), (4, -1)]


def test_repeats(spark):
    r = results.over_repeats(spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "v double").withColumn("x", F.lit(1)), ["x"], "v").first()
    assert (r["v"], r["std"]) == (2.333, 1.25)


def test_query_grammar():
    parts = search.parse('+must -not title:word "a phrase" wild* fuzzy~2 boost^3')
    assert [(p.text, p.field, p.sign, p.kind, p.boost, p.edits) for p in parts] == [
        ("must", None, "+", "term", 1.0, 0), ("not", None, "-", "term", 1.0, 0), ("word", "title", "", "term", 1.0, 0), ("a phrase", None, "", "phrase", 1.0, 0),
        ("wild*", None, "", "wild", 1.0, 0), ("fuzzy", None, "", "fuzzy", 1.0, 2), ("boost", None, "", "term", 3.0, 0),
    ]


def test_topics_are_assigned_once():
    assert text.assign_topics([[1, 9, 0], [8, 9, 2], [0, 3, 1]]) == [1, 0, 2]


def test_minibatch_count():
    assert graph.minibatch_count(25, 10, 0.5) == 125


def _shuffled(spark) -> int:
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_pairs_of_neighbours_are_not_shuffled(spark):
    """Two hundred nodes, all linked: 2.6 million pairs of neighbours of 19,900 edges."""
    edges = spark.range(200).select(F.col("id").alias("src")).crossJoin(spark.range(200).select(F.col("id").alias("dst"))).where("src < dst")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as with large tables
    try:
        before = _shuffled(spark)
        assert graph.triangles(edges).count() == 200 * 199 * 198 // 6
        assert tuple(graph.clustering(edges).first()) == (1.0, 1.0)
        assert _shuffled(spark) - before < 2_000_000, _shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


@pytest.mark.parametrize("small", [False, True])
def test_triangles_of_any_cells(spark, monkeypatch, small):
    """Hubs, loops, parallel and opposite edges, ids of any sign and size; lists that go on in the next batch."""
    import random

    if small:
        for name, value in (("CELL_EDGES", 40), ("CELL_ENDS", 20), ("CELL_PAIRS", 5)):
            monkeypatch.setattr(graph, name, value)
    draw = random.Random(4)
    ids = [-(2**62), -7, 0, 2**40, 2**62, *range(300, 335)]
    pairs = [(draw.choice(ids), draw.choice(ids)) for _ in range(260)] + [(ids[3], x) for x in ids[5:]] + [(ids[6], x) for x in ids[10:]] + [(77, 77), (78, 79), (79, 78)]
    linked = {frozenset(p) for p in pairs if p[0] != p[1]}
    near = {x: {y for p in linked if x in p for y in p - {x}} for x in {x for p in pairs for x in p}}
    want = {frozenset((x, y, z)) for x in near for y in near[x] for z in near[x] & near[y]}
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if small else held)
    try:
        edges = spark.createDataFrame([(*p, 1) for p in pairs], "src long, dst long, w long").repartition(3)
        got = [frozenset(r) for r in graph.triangles(edges).collect()]
        assert len(got) == len(want) > 50 and set(got) == want
        c = graph.clustering(edges.union(spark.createDataFrame([(None, 78, 1)], edges.schema))).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)
    closed = {x: sum(x in t for t in want) for x in near}
    full = {x: len(n) * (len(n) - 1) / 2 for x, n in near.items()}
    assert c["average_clustering"] == pytest.approx(sum(closed[x] / full[x] for x in near if full[x]) / (len(near) + 1))  # a null end is a node
    assert c["transitivity"] == pytest.approx(3 * len(want) / sum(full.values()))
