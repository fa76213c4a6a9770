"""Hand-derived cases of the spec algebra, and properties."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.plans import runner, specs

GRID = {"K": [5, 10], "hyper": ["fix", "auto"], "lda__alpha": [0.1, 0.5], "model": ["ml.lda", "ml.hdp"]}


def rows(spark, rules=None):
    return specs.SpecSet.of(GRID, rules=rules).table(spark).orderBy("_expe_id").collect()


def test_models_are_outermost_and_own_their_parameters(spark):
    got = rows(spark)
    assert [r["_expe_id"] for r in got] == list(range(12))
    assert [r["model"] for r in got] == ["ml.lda"] * 8 + ["ml.hdp"] * 4
    assert (got[0]["K"], got[0]["hyper"], got[0]["lda__alpha"]) == (5, "fix", 0.1)
    assert (got[1]["K"], got[1]["hyper"], got[1]["lda__alpha"]) == (5, "fix", 0.5)
    assert all(r["lda__alpha"] is None for r in got[8:])


@pytest.mark.parametrize(("rule", "n"), [("lda.auto", 8), ("lda.!auto", 8), ("lda.K.5", 8), ("lda.K.!5", 8), ("lda.lda__alpha.0.1", 12)])
def test_rules(spark, rule, n):
    once = rows(spark, [rule])
    assert len(once) == n
    assert rows(spark, [rule, rule]) == once


def test_rule_on_a_missing_key_raises(spark):
    with pytest.raises(KeyError):
        rows(spark, ["lda.nothing.5"])


def test_gridded_keys_are_texts(spark):
    assert {r["key"] for r in specs.gridded_keys(specs.SpecSet.of(GRID).table(spark)).collect()} == {"hyper", "model"}


def test_null_removes_the_key(spark):
    s = specs.SpecSet.of({"K": [1], "hyper": ["fix", "_null"]})
    assert s.removed == ["hyper"] and s.table(spark).columns.count("hyper") == 0


def test_minus_keeps_repeats(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "v string")
    assert sorted(r[0] for r in specs.minus(one("abac"), one("b"), ["v"]).collect()) == ["a", "a", "c"]


def test_diff_marks_missing_keys(spark):
    a, b = specs.SpecSet.of({"x": [1, 2]}).table(spark), specs.SpecSet.of({"x": [2, 3], "y": [9]}).table(spark)
    assert sorted(map(tuple, specs.spec_diff(a, b).collect())) == [("x", "1"), ("x", "3"), ("y", "--"), ("y", "9")]


@pytest.mark.parametrize(("x", "text"), [(0.1, "0.1"), (2.0, "2"), (0.125, "0.12"), (1e-07, "1e-07"), (1234.5678, "1234.57")])
def test_display_of_floats(spark, x, text):
    assert spark.range(1).select(scalars.display_double(F.lit(x))).first()[0] == text


def test_hash_is_that_of_sorted_json(spark):
    import hashlib

    runs = specs.SpecSet.of({"b": ["x"], "a": [1.5], "c": [3]}).table(spark)
    want = hashlib.md5(json.dumps({"a": 1.5, "b": "x", "c": 3}, sort_keys=True).encode()).hexdigest()
    got = runs.select(specs.run_hash(runs).alias("h"), scalars.hash_mod(specs.run_hash(runs)).alias("m")).first()
    assert got["h"] == want and got["m"] == int(want, 16) % 10**8


def test_path(spark):
    runs = specs.SpecSet.of({"size": [42]}).table(spark).withColumns({"_refdir": F.lit("ref"), "_repeat": F.lit(3), "_expe_name": F.lit("myexpe")})
    assert runs.select(specs.output_path(runs, "{expe_name}-{size}")).first()[0] == "results/ref/3/myexpe-42"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from("abcde"), st.lists(st.integers(0, 9), min_size=1, max_size=4), min_size=1, max_size=4))
def test_expansion_has_the_product_of_lengths(spark, grid):
    s = specs.SpecSet.of(grid)
    n = 1
    for v in grid.values():
        n *= len(v)
    assert s.size() == n == s.table(spark).count()


def test_runner_isolates_errors(spark):
    @runner.script
    class Probe(runner.Script):
        def square(self, context):
            if context.run["K"] == 2:
                raise ValueError("two")
            return context.run["K"] ** 2, context.is_first, context.is_last

    runs = specs.SpecSet.of({"K": [1, 2, 3]}).table(spark)
    results, errors = runner.run_all(spark, runs, "square")
    assert results == [(1, True, False), (9, False, True)] and len(errors) == 1 and "two" in errors[0]
    out = runner.run_distributed(runs, lambda r: {"y": r["K"] * 2}, "y long", 2)
    assert sorted((r["_expe_id"], r["y"], r["error"]) for r in out.collect()) == [(0, 2, None), (1, 4, None), (2, 6, None)]


def test_measures_with_frequency():
    class Toy(runner.Model):
        def fit(self, data):
            return self

        def compute_value(self, times=1):
            return self.run["v"] * times

    m = Toy({"v": 3})
    t = runner.Tracker(m, ["value", "value@times=2&_freq=2"])
    assert t.step() == {"value": (3, 3), "value@times=2&_freq=2": (6, 6)}
    m.run["v"] = 5
    assert t.step() == {"value": (5, 2)}
    m.run["v"] = 4
    assert t.step() == {"value": (4, -1), "value@times=2&_freq=2": (8, 2)}
