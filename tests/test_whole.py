"""Queries over whole tables against brute force."""

import os

import numpy as np
import pytest

from gridloom import catalogue

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("how", ["dot", "cos", "euclid"])
def test_similarities_reach_all_rows(spark, tmp_path, how):
    """Queries of ids over 99 too, and vectors on either side of them."""
    vectors = np.random.default_rng(3).normal(0, 0.45, (330, 64)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    rows.repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["i"], r["j"]): r["similarity"] for r in catalogue.queries()[f"sim_{how}"](spark, str(tmp_path)).collect()}
    assert got.keys() == {(i, j) for i in range(0, 330, 20) for j in range(330) if i != j}
    for (i, j), value in got.items():
        a, b = vectors[i].astype(float), vectors[j].astype(float)
        want = {"dot": a @ b, "cos": a @ b / np.sqrt((a @ a) * (b @ b)), "euclid": float(np.linalg.norm(a - b) <= 5)}[how]
        assert value == pytest.approx(want, abs=2e-5)


@needs_tables
def test_components_of_every_row(spark):
    rows = [(r[0], r[1] + 10_000_000_000) for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()]
    root = {x: x for row in rows for x in row}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in rows:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in catalogue.queries()["net_components"](spark, SF).collect()}
    assert got == {x: find(x) for x in root}


@needs_tables
@pytest.mark.parametrize("name", ["tnet2", "tnet5", "csv", "attributed", "dat"])
def test_edges_of_every_row(spark, name):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").selectExpr("count(*) as n", "sum(l_linenumber) as w").first()
    total = catalogue.queries()[f"edges_{name}"](spark, SF).selectExpr("sum(w)").first()[0]
    assert total == (lines["w"] if name in ("tnet5", "dat") else lines["n"])


@needs_tables
def test_triplets_and_cube_of_every_row(spark):
    assert catalogue.queries()["triplets"](spark, SF).count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    means = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").selectExpr("user_id % 500 as u", "event_type as y", "datediff(to_date(ts), date'2000-01-01') % 5 as rep", "value").collect():
        means.setdefault(tuple(r)[:3], []).append(r["value"])
    got = {(r["u"], r["y"], r["rep"]): r["value"] for r in catalogue.queries()["cube_nd"](spark, SF).collect()}
    assert len(got) == np.prod([len({k[i] for k in means}) for i in range(3)])
    assert all(v is None if k not in means else v == pytest.approx(np.mean(means[k]), abs=2e-6) for k, v in got.items())


def test_near_and_cluster_similarities_are_dealt_in_tiles(spark, monkeypatch):
    """No pair of a query with a row stands in a row with both vectors, and the bound itself is near, whatever the tiles; nulls are far from all."""
    from gridloom.operators import graph

    monkeypatch.setattr(graph, "TILE_QUERIES", 3)
    monkeypatch.setattr(graph, "TILE_VECTORS", 7)
    points = [[3.0 * (k % 5), 4.0 * (k // 5)] for k in range(40)] + [None, [3.0, None], [0.0]]
    rows = spark.createDataFrame([(k, v, None if k == 41 else k % 3) for k, v in enumerate(points)], "id long, v array<float>, cluster int").repartition(3)
    for how in ("old", "abs", "dist"):
        pairs = graph.near_similarity(rows.where("id % 4 = 0"), rows.select("id", "v"), 10.0, 4, how)
        assert "CartesianProduct" not in (plan := pairs._jdf.queryExecution().toString()) and "NestedLoop" not in plan
        got = {(r["i"], r["j"]): r["similarity"] for r in pairs.collect()}
        assert got.keys() == {(i, j) for i in range(0, 43, 4) for j in range(43) if i != j}
        for (i, j), value in got.items():
            a, b = points[i] or [], points[j] or []
            gap = [abs(x - y) if None not in (x, y) else float("nan") for x, y in zip(a, b, strict=False)] + [float("nan")] * (2 - min(len(a), len(b)))
            near = {"old": (gap[0] ** 2 + gap[1] ** 2) ** 0.5 <= 5, "abs": gap[0] <= 5 or gap[1] <= 5, "dist": 2**0.5 * gap[0] <= 5}[how]
            assert value == (1.0 if near else -1.0), (how, i, j)
    pairs = graph.cluster_similarity(rows.where("id % 4 = 0").select("id", "cluster"), rows.select("id", "cluster"))
    assert "Join" not in pairs._jdf.queryExecution().toString()
    got = {(r["i"], r["j"]): r["similarity"] for r in pairs.collect()}
    assert got == {(i, j): 1.0 if i % 3 == j % 3 and 41 not in (i, j) else -1.0 for i in range(0, 43, 4) for j in range(43) if i != j}


@pytest.mark.parametrize("size", ["1k", "7m"])
def test_sections_of_dat_files_reach_over_blocks(spark, tmp_path, size):
    """Files in blocks of a kilobyte: no task holds a whole file, and each line is of the section that the blocks before it end in."""
    from gridloom.sources import graphs
    from gridloom.streaming import logs as live

    want = {}
    for k in range(3):
        lines = ["1 2 3", "ROW LABELS:"] + ["5 6 7"] * 400 + ["DATA"]
        for n in range(900):
            lines += [f"{n % 20} {k} {n % 3}" if n % 2 else f" {n % 20}\t{k} ", "no edge", ""]
            want[n % 20, k] = want.get((n % 20, k), 0) + (n % 3 if n % 2 else 1)
        lines += ["*Vertices 3"] + ["8 9 1"] * 300 + ["*Arcs", "1e3 7 2.9"]
        want[1000, 7] = want.get((1000, 7), 0) + 2
        (tmp_path / f"f{k}.dat").write_text("\n".join(lines))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        if size == "1k":
            assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
        assert {(r["src"], r["dst"]): r["w"] for r in graphs.read_dat(spark, str(tmp_path)).collect()} == {k: w for k, w in want.items() if w}
        assert "wholetext" not in graphs.read_dat(spark, str(tmp_path))._jdf.queryExecution().toString().lower()
        live.drained(live.edge_weights(live.edge_stream(spark, str(tmp_path), "dat"), f"{tmp_path}-out", f"{tmp_path}-check"))
        assert {(r["src"], r["dst"]): r["w"] for r in live.edge_table(spark, f"{tmp_path}-out").collect()} == {k: w for k, w in want.items() if w}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)


@pytest.mark.parametrize("how", ["cos", "dot"])
def test_similarities_are_stored_in_few_bytes(spark, tmp_path, how):
    """A pair takes what tells its rounded similarity from the others, not a whole double."""
    vectors = np.random.default_rng(5).normal(0, 1, (3000, 64))
    vectors = (vectors / np.linalg.norm(vectors, axis=1)[:, None]).astype(np.float32)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    catalogue.queries()[f"sim_{how}"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 4 * 150 * 2999
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.select("i", "j").distinct().count() == 150 * 2999


def test_rounding_in_blocks(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import graph

    few = [0.0, -0.0, -1e-7, 5e-6, 1.5e-5, 2.5e-5, -2.5e-5, 0.123455, 0.123465, 1.000005, 1e9 + 0.123455, 1e12 + 0.123456, 123456789012.345675, 1e300, 4503599627370497.5, float("inf"), float("nan")]
    many = [*few, *(np.random.default_rng(1).normal(0, 1, 2000) * 10.0 ** np.arange(-7, 13).repeat(100)).tolist()]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in many], "x double").coalesce(1).select(F.bround("x", 5)).collect()]
    got = graph.rounded(np.array(many).reshape(1, -1), 5)[0].tolist()
    assert [repr(x) for x in got] == [repr(x) for x in want]
