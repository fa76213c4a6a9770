import itertools
import random

import pytest

from gridloom.operators import communities as com
from gridloom.operators import graph


def frame(spark, pairs):
    return spark.createDataFrame([(*p, 1) if len(p) == 2 else p for p in pairs], "src long, dst long, w long")


def modularity(pairs, label, resolution=1.0):
    """By definition: a sum over all ordered pairs of nodes."""
    k, a = {}, {}
    for s, t, w in pairs:
        for pair in ((s, t), (t, s)):  # a loop has two ends at its node
            a[pair] = a.get(pair, 0) + w
    for (s, _), w in a.items():
        k[s] = k.get(s, 0) + w
    two_m = sum(k.values())
    return sum(resolution * a.get((i, j), 0) / two_m - k[i] * k[j] / two_m**2 for i, j in itertools.product(k, k) if label[i] == label[j])


def random_edges(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, 4)) for _ in range(m)]


@pytest.mark.parametrize(("n", "m", "resolution"), [(8, 14, 1.0), (20, 40, 0.5)])
def test_levels_rise_and_report_their_modularity(spark, n, m, resolution):
    pairs = random_edges(n, m, n)
    levels = com.hierarchy(frame(spark, pairs), resolution)
    before = -1.0
    for level in levels:
        label = dict(map(tuple, level.clusters.collect()))
        assert set(label) == {x for p in pairs for x in p[:2]}
        assert level.modularity == pytest.approx(modularity(pairs, label, resolution)) and level.modularity > before
        before = level.modularity


def test_best_partition_of_a_small_graph(spark):
    """Against all partitions of eight nodes: not far below the best, and no single move raises it."""
    pairs = random_edges(8, 13, 4)
    label = dict(map(tuple, com.louvain(frame(spark, pairs)).collect()))
    ids = sorted(label)
    best = max(modularity(pairs, dict(zip(ids, p, strict=True))) for p in itertools.product(range(4), repeat=len(ids)))
    mine = modularity(pairs, label)
    assert mine > best - 0.05
    assert all(modularity(pairs, label | {i: c}) <= mine + 1e-6 for i in ids for c in [*set(label.values()), 99])


def test_two_level_graph_is_recovered(spark):
    """Eight cliques of four, which pairs of them link more: cliques at the first level, pairs of cliques at the second."""
    pairs = [(4 * c + a, 4 * c + b, 6) for c in range(8) for a in range(4) for b in range(a)]
    pairs += [(8 * g + a, 8 * g + 4 + b, 2) for g in range(4) for a in range(4) for b in range(4)]
    pairs += [(8 * g, 8 * ((g + 1) % 4) + 4, 1) for g in range(4)]
    levels = com.hierarchy(frame(spark, pairs))
    label = [dict(map(tuple, level.clusters.collect())) for level in levels]
    groups = lambda one: {frozenset(i for i in one if one[i] == c) for c in one.values()}
    assert groups(label[-1]) == {frozenset(range(8 * g, 8 * g + 8)) for g in range(4)}
    for fine, coarse in zip(label, label[1:], strict=False):
        assert all(len({coarse[i] for i in fine if fine[i] == c}) == 1 for c in fine.values())
    assert com.as_table(levels).count() == 32 * len(levels)


def test_two_cliques(spark):
    pairs = [(a, b, 1) for k in (0, 10) for a in range(k, k + 5) for b in range(a + 1, k + 5)] + [(0, 10, 1)]
    label = dict(map(tuple, com.louvain(frame(spark, pairs)).collect()))
    assert len({label[i] for i in range(5)}) == len({label[i] for i in range(10, 15)}) == 1 and label[0] != label[10]


def test_moves_that_do_not_touch_add_up(spark):
    moves = spark.createDataFrame([(1, 1, 2, 0.3), (2, 2, 3, 0.2), (4, 4, 5, 0.1), (6, 6, 5, 0.05)], "id long, c long, to long, rise double")
    assert sorted(r["id"] for r in com._apart(moves).collect()) == [1, 4]


def test_rounds_without_end_are_an_error_and_no_edges_no_levels(spark):
    with pytest.raises(RuntimeError, match="still move"):
        com.hierarchy(frame(spark, random_edges(20, 40, 1)), most=1)
    assert com.hierarchy(frame(spark, [])) == [] and com.louvain(frame(spark, [])).count() == 0
    loop = com.louvain(frame(spark, [(3, 3, 2)])).collect()
    assert [tuple(r) for r in loop] == [(3, 0)]


@pytest.mark.parametrize("seed", [0, 3])
def test_diameter_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    n = 16
    pairs = [(i, rng.randrange(max(0, i - 4), i)) for i in range(1, n)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(seed * 4)]
    d = {(i, j): 0 if i == j else 99 for i in range(n) for j in range(n)}
    for a, b in pairs:
        if a != b:
            d[a, b] = d[b, a] = 1
    for k, i, j in itertools.product(range(n), repeat=3):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    assert graph.diameter(frame(spark, pairs)) == max(d.values())


def test_diameter_asks_for_few_sweeps(spark):
    """A long path with leaves: two sweeps bound all but a few nodes."""
    pairs = [(i, i + 1) for i in range(12)] + [(i, 100 + i) for i in range(12)]
    assert graph.diameter(frame(spark, pairs), most_sweeps=8) == 13
    with pytest.raises(RuntimeError):
        graph.diameter(frame(spark, pairs), most_sweeps=1)
    assert graph.diameter(frame(spark, [(0, 0)])) == 0 and graph.diameter(frame(spark, [])) is None


def test_absent_numbers_against_brute_force(spark):
    rng = random.Random(7)
    rows = {k: sorted(rng.sample(range(60), rng.randint(1, 50))) for k in range(12)}
    asked = [(k, j, f"row {k} {j} {t}") for k in [*rows, 99] for j in range(0, 40, 3) for t in range(2)]
    present = spark.createDataFrame([(k, p) for k, ps in rows.items() for p in ps], "key long, place long")
    got = graph.kth_absent(present, spark.createDataFrame(asked, "key long, k long, name string")).collect()
    assert len(got) == len(asked) and {r["name"] for r in got} == {a[2] for a in asked}
    for r in got:
        absent = [x for x in range(200) if x not in rows.get(r["key"], [])]
        assert r["place"] == absent[r["k"]]


def test_components_of_a_long_path_and_a_star(spark):
    """A path of 300 nodes in random order settles in few rounds."""
    order = list(range(300))
    random.Random(2).shuffle(order)
    pairs = list(itertools.pairwise(order)) + [(1000, 1000 + k) for k in range(1, 50)] + [(2000, 2000)]
    got = dict(map(tuple, graph.components(frame(spark, pairs), most=9).collect()))
    assert got == {i: 0 for i in range(300)} | {1000 + k: 1000 for k in range(50)} | {2000: 2000}
    with pytest.raises(RuntimeError):
        graph.components(frame(spark, pairs), most=1)
    assert graph.components(frame(spark, [])).count() == 0


def test_components_of_hot_nodes(spark, monkeypatch):
    """Nodes of many neighbours are broadcast to them, of many larger and of many smaller ones; the rows of a hot node meet in no join's shuffle."""
    rng = random.Random(5)
    pairs = [(0, k) for k in range(1, 60)] + [(500, k) for k in range(300, 340)] + [(rng.randrange(600, 900), rng.randrange(600, 900)) for _ in range(120)] + [(339, 50)]
    want = dict(map(tuple, graph.components(frame(spark, pairs)).collect()))
    monkeypatch.setattr(graph, "HOT_NODE", 3)
    assert dict(map(tuple, graph.components(frame(spark, pairs)).collect())) == want
    assert want[500] == 0 and want[59] == 0
    star = spark.range(1, 60).selectExpr("id as a", "0L as b")
    assert "hot" in graph._star(star, True)._jdf.queryExecution().optimizedPlan().toString()
    assert {tuple(r) for r in graph._star(star, True).collect()} == {(k, 0) for k in range(1, 60)}
