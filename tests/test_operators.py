"""Operators without SQL, errors instead of cut results, and models on disk."""

import argparse
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import cli
from gridloom.operators import graph, results, search, stats, text
from gridloom.plans import runner, specs


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 1) for a, b in pairs], "src long, dst long, w long")


def test_non_edges_of_a_dense_graph(spark):
    """All pairs but three are edges: every free pair is found, and more than there are is an error."""
    every = [(a, b) for a in range(8) for b in range(8) if a != b]
    free = {(0, 1), (5, 2), (7, 6)}
    e = edges(spark, [p for p in every if p not in free])
    assert {(r["src"], r["dst"]) for r in graph.non_edges(e, 3).collect()} == free
    assert graph.non_edges(e, 2).count() == 2
    with pytest.raises(ValueError, match="there are 3"):
        graph.non_edges(e, 4)


@pytest.mark.parametrize("n", [5, 60])
def test_undirected_non_edges(spark, n):
    e = edges(spark, [(k, k + 1) for k in range(12)])
    got = [(r["src"], r["dst"]) for r in graph.non_edges(e, n, directed=False).collect()]
    assert len(set(got)) == n and all(a < b and b - a > 1 for a, b in got)


def test_full_split(spark):
    rng = random.Random(1)
    pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(400)} - {(a, a) for a in range(60)})
    rows = graph.full_split(edges(spark, pairs), 20, 50, 0.5, 50).collect()
    parts = {p: [(r["src"], r["dst"], r["w"]) for r in rows if r["part"] == p] for p in ("train", "test", "gone")}
    held = [x for x in parts["test"] if x[2]]
    assert len(held) == int(len(pairs) * 0.3) and len(parts["test"]) - len(held) == int(len(held) * 0.5)
    rest = len(pairs) - len(held)
    assert len(parts["gone"]) == int(rest - 0.5 * rest) and len(parts["train"]) == rest - len(parts["gone"])
    both = graph.full_split(edges(spark, [(a, b) for a, b in pairs if a < b]), 20, directed=False).where("part = 'test'").collect()
    assert {(r["src"], r["dst"]) for r in both} == {(r["dst"], r["src"]) for r in both}
    with pytest.raises(ValueError):
        graph.full_split(edges(spark, pairs), 0)


def test_steps_beyond_the_limit_raise(spark):
    e = edges(spark, [(k, k + 1) for k in range(9)])
    assert graph.distances(e, 0).count() == 10
    with pytest.raises(RuntimeError):
        graph.distances(e, 0, most=4)


def test_minibatches(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(120)}
    rows = graph.minibatches(edges(spark, sorted(pairs)), 60, zeros=3).collect()
    heads = {(r["batch"], r["part"]): r for r in rows if r["kind"] == "scale"}
    assert {p for _, p in heads} == {"zeros out", "zeros in", "out", "in"}
    n = len({x for p in pairs for x in p})
    for r in rows:
        head = heads[r["batch"], r["part"]]
        if r["kind"] == "scale":
            assert r["w"] == (9 if r["part"].startswith("zeros") else 3 * n)
        else:
            assert ((r["src"], r["dst"]) in pairs) == (r["w"] > 0) != r["part"].startswith("zeros")
            assert head["src"] == (r["src"] if r["part"].endswith("out") else r["dst"])
    free = lambda node, way: [x for x in {y for p in pairs for y in p} - {node} if ((node, x) if way == "out" else (x, node)) not in pairs]
    for (batch, part), head in heads.items():
        if part.startswith("zeros"):
            drawn = [(r["dst"] if part == "zeros out" else r["src"]) for r in rows if r["kind"] == "edge" and (r["batch"], r["part"]) == (batch, part)]
            left = sorted(free(head["src"], part[6:]))
            assert len(drawn) == len(set(drawn)) == -(-len(left) // 3) and sorted(left.index(x) // 3 for x in drawn) == list(range(len(drawn)))
        if part in ("out", "in"):
            assert sum(r["batch"] == batch and r["part"] == part for r in rows) - 1 == sum(p[part == "in"] == head["src"] for p in pairs)


def test_adjusted_mutual_information(spark):
    """Against the mean over all arrangements of one labelling."""
    from itertools import permutations

    a, b = [0, 0, 1, 1, 2, 2], [0, 0, 1, 1, 1, 0]
    h = lambda x: -sum(x.count(k) / 6 * math.log(x.count(k) / 6) for k in set(x))
    mi = lambda x, y: h(x) + h(y) - h(list(zip(x, y, strict=True)))
    expected = np.mean([mi(a, list(p)) for p in permutations(b)])
    want = (mi(a, b) - expected) / ((h(a) + h(b)) / 2 - expected)
    df = spark.createDataFrame(list(zip(a, b, strict=True)), "a int, b int")
    assert graph.adjusted_mutual_information(df).first()[0] == pytest.approx(want)


def test_setup_of_networks(spark):
    cells = spark.createDataFrame([(0, 1, 2), (1, 0, 2), (1, 2, 0), (2, 2, 1)], "src long, dst long, w long")
    made, directed = graph.from_matrix(cells)
    assert not directed and sorted(map(tuple, made.collect())) == [(0, 1, 2), (2, 2, 1)]
    assert sorted(r["w"] for r in graph.dense_setup(cells).collect()) == [0, 1, 1, 1]
    with pytest.raises(ValueError):
        graph.dense_setup(cells, "x")
    valued = spark.createDataFrame([(0, 1, 0.25), (1, 2, 0.5), (2, 0, 1.0), (2, 2, 3.0)], "src long, dst long, value double")
    got, directed = graph.sparse_setup(valued, value="value", shift="2")
    assert directed and sorted((r["src"], r["w"]) for r in got.collect()) == [(0, 5), (1, 7), (2, 12)]
    noisy = graph.configured(edges(spark, [(k, k + 1) for k in range(40)]), n="all", test_percent=50, noise=0.5)
    assert noisy.where("is_test").count() == 20 and noisy.where("not is_test").count() == 10 + 20


def test_energy_and_bounds():
    rng = np.random.default_rng(3)
    assert stats.boundary_cuts(0, 10, 2, rng).tolist() == [0, 5, 10]
    for _ in range(20):
        cuts = stats.boundary_cuts(1, 20, 4, rng)
        assert cuts[0] == 0 and cuts[-1] == 20 and (np.diff(cuts) >= 2).all()
    block = np.kron(np.eye(2), np.ones((6, 6)))
    label, energy = stats.boundary_annealing(block, steps=60)
    assert energy == pytest.approx(1.0) and len(set(label[:6])) == len(set(label[6:])) == 1 and label[0] != label[6]
    mixed = rng.permutation(12)
    again = stats.concentrated(block[np.ix_(mixed, mixed)], np.arange(12) // 6, 2, rng)
    assert stats.block_energy(block[np.ix_(mixed, mixed)], again, 2) >= stats.block_energy(block[np.ix_(mixed, mixed)], np.arange(12) // 6, 2)


def test_power_law_test(spark):
    """The gap against its definition value by value, and a p-value from as many sets as asked for."""
    rng = np.random.default_rng(5)
    drawn = np.sort(np.floor(0.5 * (1 - rng.random(4000)) ** (-1 / 1.5) + 0.5))
    values, counts = np.unique(drawn, return_counts=True)
    model = np.array([1 - stats.zeta(2.5, v) / stats.zeta(2.5, 1.0) for v in drawn])
    i = np.arange(len(drawn))
    assert stats.ks_distance(values, counts, 2.5, 1.0) == pytest.approx(max(((i + 1) / len(drawn) - model).max(), (model - i / len(drawn)).max()))
    hist = spark.createDataFrame([(int(v), int(c)) for v, c in zip(values, counts, strict=True)], "degree long, n long")
    row = stats.power_law_test(hist, 0.1).first()
    assert row["ks"] == pytest.approx(stats.ks_distance(values, counts, row["alpha"], row["x_min"])) and row["p_value"] * 25 == pytest.approx(round(row["p_value"] * 25))


def test_topics_row_by_row():
    assert text.assign_topics([[9, 1, 0], [2, 8, 0], [0, 3, 7]]) == [0, 1, 2]
    # The second row has more of class 1, the third more of class 0; the first comes last and keeps the class of its number.
    assert text.assign_topics([[1, 5, 0], [0, 9, 1], [4, 0, 0]]) == [0, 1, 0]


def test_corpus_size_is_checked(spark):
    docs = spark.range(5).withColumnRenamed("id", "doc_id")
    assert text.loaded_corpus(docs, 3).count() == 3 and text.loaded_corpus(docs, "all", shuffle=True).count() == 5
    with pytest.raises(ValueError):
        text.loaded_corpus(docs, 6)


def test_topic_model(spark):
    rows = [(k, t, 3) for k in range(12) for t in (("a", "b", "c") if k % 2 else ("x", "y", "z"))]
    bag = spark.createDataFrame(rows, "doc_id long, term string, cnt long")
    vocab = text.vocabulary(bag.withColumn("pos", F.ascii("term")))
    model, seen = text.topics(bag, vocab, 2)
    assert model.transform(seen).count() == 12 and model.vocabSize() == 6


def test_reserved_words_and_clean_up(spark):
    with pytest.raises(ValueError, match="reserved"):
        specs.SpecSet.of({"_expe_id": [1]})
    runs = specs.SpecSet.of({"a": ["x", "y"], "b": ["u", "v"]}).table(spark).withColumn("_net", F.lit(True))
    assert "_net" in specs.cleaned_runs(runs, "{a}-{b}", write=True).columns
    with pytest.raises(ValueError, match="leaves out b"):
        specs.cleaned_runs(runs, "{a}", write=True)


def test_requests():
    assert specs.plot_request("g1/g2:_entropy@r") == {"groups": ["g1", "g2"], "attribute": "_entropy", "repeat": "r"}
    assert specs.plot_request("_roc")["groups"] is None and specs.plot_request("")["groups"] == ["corpus"]
    assert specs.table_request("corpus:model:a-b", "m,n") == {"x": "corpus", "y": "model", "z": ["a", "b"], "groups": ["m", "n"], "split": "|"}


def test_differences_of_several_specs(spark):
    a, b, c = (specs.SpecSet.of({"k": v}).table(spark) for v in ([1, 2], [2, 3], [3, 4]))
    assert sorted((r["key"], r["value"]) for r in specs.diff_all([a, b, c]).collect()) == [("k", "1"), ("k", "4")]


@runner.script
class Everyone(runner.Script):
    def call(self, context):
        return context.run["k"]


class Held(runner.Model):
    """A model with plain attributes."""

    def fit(self, data):
        self.weight, self.note, self._measures, self.late = 3, "x", ["m"], lambda: 0
        return self


def test_every_run_is_called(spark):
    runs = specs.SpecSet.of({"k": list(range(30))}).table(spark)
    found, errors = runner.run_all(spark, runs, "everyone")
    assert found == list(range(30)) and not errors


def test_tables_are_whole_or_an_error(spark):
    assert runner.markdown(spark.range(1500)).count("\n") == 1501
    with pytest.raises(ValueError, match="more than 10 rows"):
        runner.latex(spark.range(11), most=10)


def test_models_on_disk(spark, tmp_path):
    runner.snapshot(Held({}).fit(None), f"{tmp_path}/one", purge=("note",))
    run = {"model": "ml.held"}
    back = runner.model_for(spark, run, f"{tmp_path}/one", load=True)
    assert back.weight == 3 and not hasattr(back, "note") and not hasattr(back, "late") and run["_measures"] == ["m"]
    assert isinstance(runner.model_for(spark, {"model": "held"}, ""), Held)
    with pytest.raises(FileNotFoundError, match="there are: one"):
        runner.load_model(spark, f"{tmp_path}/two")
    assert runner.is_abstract(runner.Model) and not runner.is_abstract(Held) and "gridloom.plans.specs" in runner.scan("gridloom.plans")


def test_options_of_plug_ins():
    more = argparse.ArgumentParser()
    more.add_argument("--alpha", type=float)
    assert cli.extended(cli.parser(), more).parse_args(["show", "--alpha", "2"]).alpha == 2
    more.add_argument("--refdir")
    with pytest.raises(ValueError, match="--refdir"):
        cli.extended(cli.parser(), more)


def test_running_totals_in_parts(spark, monkeypatch):
    monkeypatch.setattr(results, "PART", 7)
    df = spark.range(50).selectExpr("id as k", "id % 5 as n")
    got = {r["k"]: r["bound"] for r in results.running_bounds(df, "k", "n").collect()}
    assert [got[k] for k in range(50)] == np.cumsum([k % 5 for k in range(50)]).tolist()


def test_logs_with_different_headers(spark, tmp_path):
    from gridloom.sources import logs

    (tmp_path / "a.inf").write_text("#x y\n1 2\n# terminated\n")
    (tmp_path / "b.inf").write_text("#y x\n3 4\n5 6\n")
    got = {(r["path"][-5:], r["it"], r["measure"]): r["values"] for r in logs.read_log(spark, f"{tmp_path}/*.inf").collect()}
    assert got == {("a.inf", 0, "x"): ["1"], ("a.inf", 0, "y"): ["2"], ("b.inf", 0, "y"): ["3"], ("b.inf", 0, "x"): ["4"], ("b.inf", 1, "y"): ["5"], ("b.inf", 1, "x"): ["6"]}


def test_index_rebuilt_when_broken(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red house"), (2, "blue house house")], "doc_id long, text string")
    path = str(tmp_path / "index")
    rows = search.rebuild_if_broken(lambda: search.read(spark, path).postings, lambda: search.build(docs, ["text"], path))
    assert rows.count() == 4
    assert [r["doc_id"] for r in search.search(search.read(spark, path), "house", "text").collect()] == [2, 1]


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    import json

    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(cli, "HISTORY", tmp_path / "history")
    for name, grid in (("a", {"k": [1, 2], "m": ["x"]}), ("b", {"k": [2, 3], "m": ["x"]})):
        (tmp_path / f"{name}.json").write_text(json.dumps(grid))
    said = lambda *argv: (cli.main([*argv]), capsys.readouterr().out)[1].splitlines()
    assert len(said("show", "a.json", "b.json")) == 5
    assert said("show", "a.json", "1")[0].split("\t") and len(said("show", "a.json", "1")) == 2
    assert sorted(x.split("\t")[-1] for x in said("diff", "a.json", "b.json")[1:]) == ["1", "3"]
    assert "everyone.call" in "\n".join(said("list", "script")) and len(said("path", "a.json")) == 3
    assert said("doc", "everyone")[0].startswith("everyone: ")
    said("update")
    assert search.search(search.read(spark, f"{tmp_path}/data/.catalogue"), "held", "name").count() == 1
    assert said("hist") and said("init") == []


def _writers(path):
    """Numbers of the tasks that wrote the files below a folder."""
    return {p.name.split("-")[1] for p in path.rglob("part-*")}


def test_logs_of_many_runs_are_written_by_many_tasks_and_opened_once(spark, tmp_path):
    from gridloom.sources import logs

    log = spark.range(120).selectExpr("id % 40 as run", "id div 40 as it", "'click' as measure", "cast(id as double) as value")
    logs.write_text_log(log, f"{tmp_path}/logs", ["click"], "run", "it")
    assert len(_writers(tmp_path)) > 1
    back = logs.read_log(spark, f"{tmp_path}/logs/*")
    assert str(tmp_path) not in back._jdf.queryExecution().executedPlan().toString()
    assert sorted(float(r["values"][0]) for r in back.collect()) == [float(k) for k in range(120)]


def test_result_tree_is_written_by_many_tasks(spark):
    from pathlib import Path

    from gridloom.catalogue import queries
    from gridloom.operators.lineage import shared_folder

    root = Path(shared_folder(spark).removeprefix("file:"))
    before = set(root.glob("tree-*"))
    assert queries()["result_tree"](spark, "/root/testdata/sf0.001").count() > 0
    (tree,) = set(root.glob("tree-*")) - before
    assert len(_writers(tree)) > 1


def test_expected_information_is_dealt_to_many_tasks(spark):
    from gridloom.operators import graph

    sizes = spark.createDataFrame([(5000,), (7000,)], "n long").coalesce(1)
    plan = graph.expected_mutual_information(sizes, sizes, 12000)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning(4" in plan


def test_full_split_reads_its_edges_once(spark):
    from pyspark.sql import functions as F

    from gridloom.operators import graph

    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def same(x):
        seen.add(1)
        return x

    pairs = spark.range(60).select(same("id").alias("src"), ((F.col("id") * 7 + 1) % 60).alias("dst"), F.lit(1).cast("long").alias("w"))
    assert graph.full_split(pairs, 20, 50, 0.5, 50).count() == 69
    assert seen.value == 60
