"""Result cubes and measure logs over the events table: x is a bucket of users, y the event type, the repeat the day."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import results
from . import query, table

EVENTS = "WITH e AS (SELECT event_id, user_id, user_id % 10 AS x, event_type AS y, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) % 5 AS BIGINT) AS rep, value, ts FROM events)"


def mean12(x: str) -> str:
    """SQL of a mean in whole parts of 10**-12, by a sum of whole numbers: the same whatever the order of rows."""
    return f"((2 * sum(CAST(CAST({x} AS DECIMAL(24,12)) * 1000000000000 AS BIGINT)) + count({x})) // (2 * count({x})))"


def even(m: str, digits: int) -> str:
    """SQL of such a number rounded half to even."""
    d = 10 ** (12 - digits)
    return f"CAST(CASE WHEN ({m}) % {d} > {d // 2} OR (({m}) % {d} = {d // 2} AND (({m}) // {d}) % 2 = 1) THEN ({m}) // {d} + 1 ELSE ({m}) // {d} END AS DOUBLE) / 1e{digits}"


TYPES = ["click", "error", "purchase", "signup", "view"]


def events(spark, sf_dir):
    day = F.date_diff(F.to_date("ts"), F.lit("2000-01-01").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("user_id") % 10).alias("x"), F.col("event_type").alias("y"), (day % 5).cast("long").alias("rep"), "value", "ts")


@query("table_pivot_mean", EVENTS + " SELECT x, " + ", ".join(even(mean12(f"CASE WHEN y = '{t}' THEN value END"), 6) + f" AS {t}" for t in TYPES) + " FROM e GROUP BY x")
def table_pivot_mean(spark, sf_dir):
    t = results.pivot(events(spark, sf_dir), "x", "y", "value", how=results.exact_mean, values=TYPES)
    return t.select("x", *[F.bround(c, 6).cast("double").alias(c) for c in TYPES])


for _how, _sql in (("mean", "((2 * sum(v) + count(v)) // (2 * count(v)))"), ("rmax", "max(v)"), ("rmin", "min(v)")):
    query(
        {"mean": "table_repeat_mean_std"}.get(_how, f"table_{_how}"),
        EVENTS + f", r AS (SELECT x, y, rep, CAST({mean12("value")} AS BIGINT) AS v FROM e GROUP BY ALL) SELECT x, y, {even(_sql, 3)} AS v, round_even(stddev_pop(v / 1e12), 2) AS std FROM r GROUP BY x, y",
    )(lambda spark, sf_dir, how=_how: results.over_repeats(events(spark, sf_dir).groupBy("x", "y", "rep").agg(results.exact_mean("value").alias("v")), ["x", "y"], "v", how))


@query("table_highlight", EVENTS + ", c AS (SELECT x, y, " + even(mean12("value"), 3) + " AS v FROM e GROUP BY x, y) SELECT x, y, v, row_number() OVER (PARTITION BY x ORDER BY v DESC, y) = 1 AS best FROM c")
def table_highlight(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy("x", "y").agg(F.bround(results.exact_mean("value"), 3).cast("double").alias("v"))
    return results.best(cells, "x", "y", "v")


@query("table_merge", EVENTS + " SELECT x, rep || '|' || y AS header, " + even(mean12("value"), 6) + " AS v FROM e GROUP BY x, rep, y")
def table_merge(spark, sf_dir):
    cells = events(spark, sf_dir).groupBy("x", "y", F.col("rep").cast("string").alias("g")).agg(F.bround(results.exact_mean("value"), 6).cast("double").alias("v"))
    return results.merged(cells, "g", "x", "y", "v")


@query(
    "cube_nd",
    EVENTS + f""", b AS (SELECT user_id % 500 AS u, y, rep, value FROM e)
SELECT u, y, rep, v AS value FROM (SELECT * FROM (SELECT DISTINCT u FROM b), (SELECT DISTINCT y FROM b), (SELECT DISTINCT rep FROM b)) LEFT JOIN (SELECT u, y, rep, {even(mean12("value"), 6)} AS v FROM b GROUP BY ALL) USING (u, y, rep)""",
)
def cube_nd(spark, sf_dir):
    """Five hundred users, so that cells stay empty."""
    b = events(spark, sf_dir).withColumn("u", F.col("user_id") % 500)
    return results.cube(b, ["u", "y", "rep"], "value").select("u", "y", "rep", F.bround("value", 6).cast("double").alias("value"))


STEPS = EVENTS + ", l AS (SELECT user_id AS run, y AS measure, row_number() OVER (PARTITION BY user_id, y ORDER BY ts, event_id) - 1 AS it, value FROM e)"


def log(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "y").orderBy("ts", "event_id")
    return events(spark, sf_dir).select(F.col("user_id").alias("run"), F.col("y").alias("measure"), (F.row_number().over(w) - 1).cast("long").alias("it"), "value")


@query("log_delta", STEPS + " SELECT run, measure, it, value, round_even(value - coalesce(lag(value) OVER (PARTITION BY run, measure ORDER BY it), 0), 6) AS delta FROM l")
def log_delta(spark, sf_dir):
    return results.deltas(log(spark, sf_dir), ["run", "measure"], ["it"], "value").withColumn("delta", F.bround("delta", 6))


@query("log_freq", STEPS + ", k AS (SELECT * FROM l WHERE it % 2 = 0) SELECT run, measure, it, value, round_even(value - coalesce(lag(value) OVER (PARTITION BY run, measure ORDER BY it), 0), 6) AS delta FROM k")
def log_freq(spark, sf_dir):
    return results.deltas(results.every(log(spark, sf_dir), "it", 2), ["run", "measure"], ["it"], "value").withColumn("delta", F.bround("delta", 6))


@query("log_burn_in", STEPS + " SELECT run, measure, it, value FROM l WHERE it >= 1 AND (it - 1) % 2 = 0")
def log_burn_in(spark, sf_dir):
    return results.sampled_iterations(log(spark, sf_dir), "it", 1, 2)


@query("log_last", STEPS + " SELECT run, measure, max(it) AS last_step, arg_max(value, it) AS value FROM l GROUP BY run, measure")
def log_last(spark, sf_dir):
    return results.last_values(log(spark, sf_dir), ["run", "measure"], "it", "value")


@query("log_curve", STEPS + " SELECT it, " + ", ".join(f"max(CASE WHEN run = {r} THEN value END) AS \"{r}\"" for r in (1, 2, 3)) + " FROM l WHERE measure = 'click' AND run IN (1, 2, 3) GROUP BY it")
def log_curve(spark, sf_dir):
    return results.curve(log(spark, sf_dir).where("measure = 'click' and run in (1, 2, 3)"), "it", "run", "value", [1, 2, 3])


@query("log_positions", EVENTS + " SELECT event_id, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INT) AS x_pos, CAST(dense_rank() OVER (ORDER BY y) - 1 AS INT) AS y_pos FROM e")
def log_positions(spark, sf_dir):
    return results.axis_positions(events(spark, sf_dir).select("event_id", "x", "y"), ["x", "y"]).select("event_id", "x_pos", "y_pos")


@query("ordered_values", "SELECT DISTINCT p_type FROM part")
def ordered_values(spark, sf_dir):
    return results.ordered_values(table(spark, sf_dir, "part"), "p_type")


@query("running_bounds", "SELECT p_brand, n, CAST(sum(n) OVER (ORDER BY p_brand) AS BIGINT) AS bound FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand)")
def running_bounds(spark, sf_dir):
    return results.running_bounds(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n")), "p_brand", "n")


@query("first_last", "SELECT o_orderkey AS k, o_orderkey = min(o_orderkey) OVER () AS is_first, o_orderkey = max(o_orderkey) OVER () AS is_last FROM orders")
def first_last(spark, sf_dir):
    return results.first_last(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("order_perm", "SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS perm, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS sorted FROM part")
def order_perm(spark, sf_dir):
    from ..operators.lineage import numbered

    parts = numbered(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "place", F.col("p_partkey"))
    return results.sorted_perm(parts, F.desc("p_retailprice"), F.col("perm")).select("p_partkey", "perm", "sorted")


for _name, _fr, _to in (("order_moved_back", 10, 3), ("order_moved_on", 2, 17)):
    query(
        _name,
        f"WITH p AS (SELECT n_nationkey, CAST(row_number() OVER (ORDER BY n_name) - 1 AS BIGINT) AS place FROM nation) SELECT n_nationkey, CAST(CASE WHEN place = {_fr} THEN {_to} WHEN place BETWEEN {_to} AND {_fr} - 1 THEN place + 1 WHEN place BETWEEN {_fr} + 1 AND {_to} THEN place - 1 ELSE place END AS BIGINT) AS place FROM p",
    )(lambda spark, sf_dir, fr=_fr, to=_to: results.moved(_placed_nations(spark, sf_dir), fr, to).select("n_nationkey", "place"))


def _placed_nations(spark, sf_dir):
    from ..operators.lineage import numbered

    return numbered(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "place", F.col("n_name"))


@query("remap_values", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE l_returnflag WHEN 'A' THEN 'R' WHEN 'R' THEN 'A' ELSE l_returnflag END AS flag FROM lineitem WHERE l_tax <> 0")
def remap_values(spark, sf_dir):
    rows = results.without_zeros(table(spark, sf_dir, "lineitem"), "l_tax")
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", results.remapped(F.col("l_returnflag"), {"A": "R", "R": "A"}).alias("flag"))


@query("json_rows", "SELECT p_partkey, CAST(json_object('p_name', p_name, 'p_size', p_size, 'parts', [p_brand, p_type]) AS VARCHAR) AS json FROM part")
def json_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.array("p_brand", "p_type").alias("parts"))
    return results.as_json(rows, "p_partkey")


@query("legacy_columns", "SELECT k AS name, c AS position, CASE c WHEN 0 THEN 'Iteration' WHEN 1 THEN 'loglikelihood' WHEN 2 THEN 'loglikelihood' WHEN 3 THEN 'loglikelihood' END AS label FROM (VALUES ('Iteration', 0), ('Timeit', 1), ('loglikelihood', 2), ('likelihood', 2), ('perplexity', 2), ('loglikelihood_t', 3), ('likelihood_t', 3), ('perplexity_t', 3), ('K', 4), ('alpha', 5), ('gamma', 6), ('other', NULL)) AS v(k, c)")
def legacy_columns(spark, sf_dir):
    names = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in [*results.LEGACY_COLUMNS, "other"]])).alias("name"))
    return names.withColumn("position", results.legacy_column(F.col("name"))).withColumn("label", results.legacy_label(F.col("position")))
