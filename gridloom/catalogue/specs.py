"""Spec algebra: the grid takes its alternatives from the tables' own values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars, stirling
from ..operators.lineage import shared_folder
from ..plans import specs
from ..sources.tables import corpora, find_corpora
from . import query, table


def _values(spark: SparkSession, sf_dir: str, name: str, column: str) -> list:
    """Alternatives of one key: a design's vectors are small by nature, and its size is checked before it is expanded."""
    return [r[0] for r in table(spark, sf_dir, name).select(column).distinct().orderBy(column).collect()]


def grid(spark: SparkSession, sf_dir: str, rules: list[str] | None = None) -> specs.SpecSet:
    keys = {"brand": _values(spark, sf_dir, "part", "p_brand"), "size": _values(spark, sf_dir, "part", "p_size"), "event": _values(spark, sf_dir, "events", "event_type")}
    return specs.SpecSet.of(keys, rules=rules)


#: The same grid in SQL; rows are numbered from 0 in the order brand, event, size.
GRID = """
WITH b AS (SELECT DISTINCT p_brand AS brand FROM part), s AS (SELECT DISTINCT p_size AS size FROM part), e AS (SELECT DISTINCT event_type AS event FROM events),
grid AS (SELECT brand, event, CAST(size AS BIGINT) AS size FROM b, s, e)"""
KEPT = "SELECT CAST(row_number() OVER (ORDER BY brand, event, size) - 1 AS BIGINT) AS expe_id, brand, event, size FROM grid"


def _shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("_expe_id").alias("expe_id"), "brand", "event", "size")


@query("grid_expand", f"{GRID} {KEPT}")
def grid_expand(spark, sf_dir):
    return _shown(grid(spark, sf_dir).table(spark))


@query("grid_size", f"{GRID} SELECT count(*) AS n FROM grid")
def grid_size(spark, sf_dir):
    return spark.range(1).select(F.lit(grid(spark, sf_dir).size()).cast("long").alias("n"))


def _rule(name: str, rule: str, where: str):
    query(name, f"{GRID} {KEPT} WHERE {where}")(lambda spark, sf_dir: _shown(grid(spark, sf_dir, [rule]).table(spark)))


_rule("grid_bind_incl2", "Brand#11.click", "NOT (brand = 'Brand#11' AND event <> 'click')")
_rule("grid_bind_excl2", "Brand#11.!click", "NOT (brand = 'Brand#11' AND event = 'click')")
_rule("grid_bind_incl3", "view.size.5", "NOT (event = 'view' AND size <> 5)")
_rule("grid_bind_excl3", "view.size.!5", "NOT (event = 'view' AND size = 5)")
_rule("grid_bind_dotted", "view.size.0.5", "true")

MODELS = {"K": [5, 10], "hyper": ["fix", "auto"], "lda__alpha": [0.1, 0.5], "model": ["ml.lda", "ml.hdp"]}
MODELS_SQL = """
WITH k AS (SELECT unnest([5, 10]) AS k), h AS (SELECT unnest([['fix', '0'], ['auto', '1']]) AS h), a AS (SELECT unnest([0.1, 0.5]) AS alpha),
runs AS (
  SELECT 0 AS m, k, h[1] AS hyper, CAST(h[2] AS INT) AS hp, alpha, 'ml.lda' AS model FROM k, h, a
  UNION ALL SELECT 1, k, h[1], CAST(h[2] AS INT), NULL, 'ml.hdp' FROM k, h)
"""


def _models(spark, rules=None):
    return specs.SpecSet.of(MODELS, rules=rules).table(spark)


@query("grid_model_scope", MODELS_SQL + "SELECT row_number() OVER (ORDER BY m, k, hp, alpha) - 1 AS expe_id, CAST(k AS BIGINT) AS k, hyper, CAST(alpha AS DOUBLE) AS alpha, model FROM runs")
def grid_model_scope(spark, sf_dir):
    return _models(spark).select(F.col("_expe_id").alias("expe_id"), F.col("K").alias("k"), "hyper", F.col("lda__alpha").alias("alpha"), "model")


for _name, _bind, _where in (
    ("grid_model_bind", "lda.auto", "NOT (m = 0 AND hyper <> 'auto')"),
    ("grid_model_bind_not", "lda.!auto", "NOT (m = 0 AND hyper = 'auto')"),
    ("grid_model_bind_key", "lda.K.5", "NOT (m = 0 AND k <> 5)"),
):
    query(_name, MODELS_SQL + f"SELECT row_number() OVER (ORDER BY m, k, hp, alpha) - 1 AS expe_id, CAST(k AS BIGINT) AS k, hyper, model FROM runs WHERE {_where}")(
        lambda spark, sf_dir, bind=_bind: _models(spark, [bind]).select(F.col("_expe_id").alias("expe_id"), F.col("K").alias("k"), "hyper", "model")
    )


@query("grid_defaults", "SELECT row_number() OVER (ORDER BY k) - 1 AS expe_id, k, 'auto' AS hyper, CAST(7 AS BIGINT) AS seed FROM (SELECT CAST(unnest([5, 10]) AS BIGINT) AS k)")
def grid_defaults(spark, sf_dir):
    d = specs.Design.of({"K": [5, 10], "hyper": "auto"}).defaults({"hyper": "fix", "seed": 7})
    return specs.SpecSet.of(d).table(spark).select(F.col("_expe_id").alias("expe_id"), F.col("K").alias("k"), "hyper", "seed")


@query("grid_overlay", "SELECT row_number() OVER (ORDER BY k) - 1 AS expe_id, k, 'mean' AS hyper FROM (SELECT CAST(unnest([1, 2, 3]) AS BIGINT) AS k)")
def grid_overlay(spark, sf_dir):
    d = specs.Design.of({"K": [5, 10], "hyper": ["fix", "auto"]}).overlay({"K": [1, 2, 3], "hyper": "mean"})
    return specs.SpecSet.of(d).table(spark).select(F.col("_expe_id").alias("expe_id"), F.col("K").alias("k"), "hyper")


@query("grid_null", "SELECT row_number() OVER (ORDER BY k) - 1 AS expe_id, k, 'hyper' AS removed FROM (SELECT CAST(unnest([5, 10]) AS BIGINT) AS k)")
def grid_null(spark, sf_dir):
    s = specs.SpecSet.of({"K": [5, 10], "hyper": ["fix", specs.NULL]})
    return s.table(spark).select(F.col("_expe_id").alias("expe_id"), F.col("K").alias("k"), F.lit(",".join(s.removed)).alias("removed"))


def _two(spark, sf_dir):
    names = _values(spark, sf_dir, "nation", "n_name")
    events = _values(spark, sf_dir, "events", "event_type")
    a = specs.SpecSet.of({"nation": names[:10], "event": events})
    b = specs.SpecSet.of({"nation": names[5:12], "event": events[:3], "extra": ["x", "y"]})
    return a, b


TWO = """
WITH n AS (SELECT n_name AS nation, row_number() OVER (ORDER BY n_name) AS i FROM (SELECT DISTINCT n_name FROM nation)),
e AS (SELECT event_type AS event, row_number() OVER (ORDER BY event_type) AS j FROM (SELECT DISTINCT event_type FROM events)),
a AS (SELECT nation, event FROM n, e WHERE i <= 10), b AS (SELECT nation, event, extra FROM n, e, (SELECT unnest(['x', 'y']) AS extra) WHERE i BETWEEN 6 AND 12 AND j <= 3)"""


@query("grid_union", TWO + " SELECT row_number() OVER (ORDER BY t, event, extra, nation) - 1 AS expe_id, event, extra, nation FROM (SELECT 0 AS t, event, NULL AS extra, nation FROM a UNION ALL SELECT 1, event, extra, nation FROM b)")
def grid_union(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return a.concat(b).table(spark).select(F.col("_expe_id").alias("expe_id"), "event", "extra", "nation")


@query("grid_minus", TWO + " SELECT event, nation FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.event = b.event AND a.nation = b.nation)")
def grid_minus(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return specs.minus(a.table(spark), b.table(spark), ["event", "nation"]).select("event", "nation")


DIFF = """, la AS (SELECT 'nation' AS key, nation AS value FROM a UNION SELECT 'event', event FROM a), lb AS (SELECT 'nation' AS key, nation AS value FROM b UNION SELECT 'event', event FROM b UNION SELECT 'extra', extra FROM b)"""


@query("grid_diff", TWO + DIFF + " (SELECT * FROM la EXCEPT SELECT * FROM lb) UNION ALL (SELECT * FROM lb EXCEPT SELECT * FROM la) UNION ALL SELECT 'extra', '--'")
def grid_diff(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return specs.spec_diff(a.table(spark), b.table(spark)).select("key", "value")


@query("grid_nounique", f"{GRID} SELECT 'brand' AS key, count(DISTINCT brand) AS n_values FROM grid UNION ALL SELECT 'event', count(DISTINCT event) FROM grid")
def grid_nounique(spark, sf_dir):
    return specs.gridded_keys(grid(spark, sf_dir).table(spark))


@query("grid_constants", "SELECT 'hyper' AS key, 'auto' AS value UNION ALL SELECT 'seed', '7'")
def grid_constants(spark, sf_dir):
    return specs.constant_keys(specs.SpecSet.of({"K": [5, 10], "hyper": "auto", "seed": 7}, {"K": [3], "L": [1], "hyper": ["auto"], "seed": 7}).table(spark))


@query("grid_value_sets", f"{GRID} SELECT 'brand' AS key, brand AS value, count(*) AS n FROM grid GROUP BY brand UNION ALL SELECT 'event', event, count(*) FROM grid GROUP BY event UNION ALL SELECT 'size', CAST(size AS VARCHAR), count(*) FROM grid GROUP BY size")
def grid_value_sets(spark, sf_dir):
    return specs.value_sets(grid(spark, sf_dir).table(spark))


CANON = """'{"brand": "' || brand || '", "event": "' || event || '", "size": ' || size || '}'"""


@query("grid_hash", f"{GRID} SELECT brand, event, size, md5({CANON}) AS hash, CAST(('0x' || md5({CANON}))::UHUGEINT % 100000000 AS BIGINT) AS short FROM grid")
def grid_hash(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark)
    return runs.select("brand", "event", "size", specs.run_hash(runs).alias("hash")).withColumn("short", scalars.hash_mod(F.col("hash")))


@query("grid_dups", TWO + """ SELECT md5('{"event": "' || event || '", "nation": "' || nation || '"}') AS hash, CAST(2 AS BIGINT) AS n FROM a""")
def grid_dups(spark, sf_dir):
    a, _ = _two(spark, sf_dir)
    return specs.duplicates(a.concat(a).table(spark))


@query("grid_path", f"{GRID} SELECT brand, event, size, 'results/ref/3/' || brand || '-' || event || '-' || size || '.inf' AS path FROM grid")
def grid_path(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark).withColumns({"_refdir": F.lit("ref"), "_repeat": F.lit(3)})
    return runs.select("brand", "event", "size", specs.output_path(runs, "{brand}-{event}-{size}", ext=".inf").alias("path"))


@query("grid_path_default", f"{GRID} SELECT brand, event, size, 'results/' || md5({CANON}) || '-expe' AS path FROM grid")
def grid_path_default(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark)
    return runs.select("brand", "event", "size", specs.output_path(runs).alias("path"))


@query("grid_format_check", "SELECT 'event' AS key")
def grid_format_check(spark, sf_dir):
    return specs.unformatted_keys(grid(spark, sf_dir).table(spark), "{brand}-{size}")


@query("grid_unfinished", f"{GRID} SELECT brand, event, size FROM grid WHERE size > 10")
def grid_unfinished(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark)
    path = specs.output_path(runs, "{brand}-{event}-{size}")
    done = runs.where("size <= 10").select(path.alias("path"), F.lit(1).alias("size"))
    return specs.unfinished(runs, done, path).select("brand", "event", "size")


@query("run_select", f"{GRID}, r AS ({KEPT}) SELECT expe_id, brand, event, size, CAST(CASE expe_id WHEN 7 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS BIGINT) AS place FROM r WHERE expe_id IN (7, 3, 100)")
def run_select(spark, sf_dir):
    return specs.select_rows(grid(spark, sf_dir).table(spark), [7, 3, 100]).select(F.col("_expe_id").alias("expe_id"), "brand", "event", "size", F.col("_order").alias("place"))


@query("grid_pack", f"{GRID} SELECT event, CAST(count(DISTINCT brand) AS INT) AS brands, CAST(count(DISTINCT size) AS INT) AS sizes FROM grid GROUP BY event")
def grid_pack(spark, sf_dir):
    packed = specs.pack_rows(grid(spark, sf_dir).table(spark), ["event"])
    return packed.select("event", F.size("brand").alias("brands"), F.size("size").alias("sizes"))


@query("alias_project", "SELECT p_partkey AS id, CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE p_brand END AS brand FROM part")
def alias_project(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), specs.alias(F.col("p_brand"), {"Brand#11": "first", "Brand#12": "second"}).alias("brand"))


@query("model_names", "SELECT c_custkey AS id, lower('exp.' || c_mktsegment) AS model FROM customer")
def model_names(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), specs.model_name(F.col("c_mktsegment"), "exp").alias("model"))


@query(
    "corpus_prefix_lookup",
    "SELECT * FROM (VALUES ('manufacturing_v2', 'manufacturing', 'network', 167::BIGINT, 5784::BIGINT), ('BA2', 'BA', 'network', NULL, NULL), ('email-Enron', 'email-Enron', 'network', 36692, 367662), ('unknown', NULL, NULL, NULL, NULL)) t(wanted, name, data_type, nodes, edges)",
)
def corpus_prefix_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([("manufacturing_v2",), ("BA2",), ("email-Enron",), ("unknown",)], "wanted string")
    return find_corpora(corpora(spark), wanted).select("wanted", "name", "data_type", "nodes", "edges")


@query("scalar_display", "SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN CAST(CAST(l_extendedprice AS BIGINT) AS VARCHAR) ELSE CAST(l_extendedprice AS VARCHAR) END AS shown FROM lineitem WHERE l_extendedprice < 1000000")
def scalar_display(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_extendedprice < 1000000")
    return rows.select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), scalars.display_double(F.col("l_extendedprice")).alias("shown"))


@query("scalar_guess_type", "SELECT o_orderkey AS k, 'int' AS a, 'float' AS b, 'str' AS c FROM orders")
def scalar_guess_type(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    guess = lambda c: scalars.guess_type(F.col(c).cast("string"))
    return o.select(F.col("o_orderkey").alias("k"), guess("o_orderkey").alias("a"), guess("o_totalprice").alias("b"), guess("o_orderpriority").alias("c"))


@query("scalar_weights", "SELECT l_orderkey AS k, l_partkey AS p, l_suppkey AS s, CAST(ceil(l_discount * 10) AS BIGINT) AS c, l_quantity + 2 AS shift, l_quantity * 3 + 1 AS lin, least(pow(2.0, l_quantity), 300.0) AS ex FROM lineitem")
def scalar_weights(spark, sf_dir):
    w = scalars.WEIGHTS
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), w["ceil10"](F.col("l_discount")).alias("c"), w["shift"](q, 2).alias("shift"), w["linear"](q, 1, 3).alias("lin"), w["exp2"](q).alias("ex"))


@query("scalar_measure_spec", "SELECT event_id AS id, event_type AS name, CAST(user_id AS VARCHAR) AS freq FROM events")
def scalar_measure_spec(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name, options = scalars.measure_spec(F.concat("event_type", F.lit("@_freq="), F.col("user_id").cast("string"), F.lit("&k=2")))
    return e.select(F.col("event_id").alias("id"), name.alias("name"), F.element_at(options, "_freq").alias("freq"))


@query(
    "stirling_log",
    """
WITH RECURSIVE r AS (
  SELECT 1 AS n, [CAST(1.0 AS DOUBLE)] AS row
  UNION ALL
  SELECT n + 1, list_transform(range(1, n + 2), lambda m: coalesce(row[m - 1], 0) * CASE WHEN m > 1 THEN 1 ELSE 0 END + n * coalesce(row[m], 0)) FROM r WHERE n < 15)
SELECT CAST(n AS INT) AS n, CAST(m AS INT) AS m, round_even(ln(row[m]), 6) AS value FROM (SELECT n, row, unnest(range(1, n + 1)) AS m FROM r)""",
)
def stirling_log(spark, sf_dir):
    return scalars.log_stirling(spark, 15).select("n", "m", F.bround("value", 6).alias("value"))


@query(
    "stirling_stored",
    """
WITH RECURSIVE c AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS m FROM orders GROUP BY o_custkey),
r AS (
  SELECT 1 AS n, [CAST(1.0 AS DOUBLE)] AS row
  UNION ALL
  SELECT n + 1, list_transform(range(1, n + 2), lambda m: coalesce(row[m - 1], 0) * CASE WHEN m > 1 THEN 1 ELSE 0 END + n * coalesce(row[m], 0)) FROM r WHERE n < (SELECT max(n) FROM c))
SELECT o_custkey, c.n, m, round_even(ln(row[m]), 6) AS value FROM c JOIN r USING (n)""",
)
def stirling_stored(spark, sf_dir):
    """Ways to deal a customer's orders into as many cycles as they have priorities, from a stored table as large as the largest customer asks for."""
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_distinct("o_orderpriority").alias("m"))
    most = rows.agg(F.max("n")).first()[0]
    made = stirling.stored(spark, f"{shared_folder(spark)}/stirling", most)
    return stirling.looked_up(rows, made, "n", "m", "value").withColumn("value", F.bround("value", 6))



@query("scalar_softmax", "SELECT p_partkey AS id, round_even(exp(p_size - max(p_size) OVER w) / sum(exp(p_size - max_b)) OVER w, 9) AS p FROM (SELECT *, max(p_size) OVER (PARTITION BY p_brand) AS max_b FROM part) WINDOW w AS (PARTITION BY p_brand)")
def scalar_softmax(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.bround(scalars.softmax(F.col("p_size"), F.col("p_brand")), 9).alias("p"))


U = "(CAST('0x' || substr(md5('3|' || p_partkey), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0"


@query("scalar_draws", f"SELECT p_partkey, CAST(u < 0.3 AS INT) AS bernoulli, CASE WHEN u < 0.2 THEN 0 WHEN u < 0.5 THEN 1 ELSE 2 END AS categorical, CAST(floor(0.5 * pow(1 - u, -1 / 1.5) + 0.5) AS BIGINT) AS power, '0.2 0.06 0.03' AS sticks FROM (SELECT p_partkey, {U} AS u FROM part)")
def scalar_draws(spark, sf_dir):
    u = scalars.uniform(F.col("p_partkey"), seed=3)
    p = table(spark, sf_dir, "part")
    third = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    return p.select("p_partkey", scalars.draw_bernoulli(F.lit(0.3), u).alias("bernoulli"), scalars.draw_categorical(third, u).alias("categorical"), scalars.draw_powerlaw(F.lit(2.5), F.lit(1.0), u).alias("power"), F.array_join(F.transform(scalars.sticks(third), lambda x: F.bround(x, 4).cast("string")), " ").alias("sticks"))


@query("grid_vectors", GRID + " SELECT CAST(row_number() OVER (ORDER BY brand, i) - 1 AS BIGINT) AS expe_id, brand, size FROM b, (VALUES (0, 3), (1, 1), (2, 7)) AS v(i, size)")
def grid_vectors(spark, sf_dir):
    design = specs.with_vectors(specs.Design.of({"size": ["few", 7], "brand": _values(spark, sf_dir, "part", "p_brand")}), {"few": [3, 1]})
    return specs.SpecSet.of(design).table(spark).select(F.col("_expe_id").alias("expe_id"), "brand", "size")


@query("grid_measures", "SELECT * FROM (VALUES ('0', '_entropy'), ('1', 'K'), ('2', 'counts')) AS v(position, value)")
def grid_measures(spark, sf_dir):
    (words,) = specs.with_measures(specs.Design.of({"_measures": ["_entropy K counts"]})).keys["_measures"]
    return spark.range(1).select(F.explode(specs.positions(F.array(*[F.lit(w) for w in words]))).alias("p")).select("p.*")


@query("grid_tagged", f"{GRID} SELECT md5({CANON}) AS hash, 'the grid' AS alias FROM grid")
def grid_tagged(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark)
    return specs.tagged(runs, {"expe": "the grid"}).select(F.col("_expe_hash").alias("hash"), F.col("_alias").alias("alias"))


@query("grid_finished", f"{GRID} SELECT brand || '-' || event || '-' || size AS name FROM grid WHERE size <= 10")
def grid_finished(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark)
    path = specs.output_path(runs, "{brand}-{event}-{size}")
    done = runs.where("size <= 10").select(path.alias("path"), F.lit(1).alias("size"))
    return specs.finished(runs, done, path).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@query("grid_global", TWO + " SELECT key, string_agg(value, ' ' ORDER BY t, value) AS values FROM (SELECT DISTINCT 0 AS t, 'event' AS key, event AS value FROM a UNION ALL SELECT DISTINCT 0, 'nation', nation FROM a UNION ALL SELECT DISTINCT 1, 'event', event FROM b UNION ALL SELECT DISTINCT 1, 'extra', extra FROM b UNION ALL SELECT DISTINCT 1, 'nation', nation FROM b) GROUP BY key")
def grid_global(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return specs.global_tensor(a.concat(b), spark).select("key", F.array_join("values", " ").alias("values"))


@query("grid_cleaned", f"{GRID} SELECT brand, event, size FROM grid")
def grid_cleaned(spark, sf_dir):
    runs = grid(spark, sf_dir).table(spark).withColumns({"_net": F.lit(False), "_ignore_format_unique": F.lit("x")})
    return specs.cleaned_runs(runs, "{brand}-{event}-{size}", write=True).drop("_expe_id", "_expe_name")


@query("input_paths", "SELECT 'data/training/generator/Graph_' || n_name AS path FROM nation UNION ALL SELECT 'data/training/' || n_name || '.x' FROM nation UNION ALL SELECT 'data/training/generator/clique' || n_nationkey FROM nation")
def input_paths(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    names = F.array(F.concat(F.lit("graph_"), "n_name", F.lit(".gt")), F.concat("n_name", F.lit(".x")), F.concat(F.lit("clique"), F.col("n_nationkey").cast("string"), F.lit(".pk")))
    return n.select(F.explode(names).alias("c")).select(specs.input_path(F.col("c")).alias("path"))


@query("grid_locate", "SELECT e.event_type AS name, n.n_name AS module, n.n_regionkey AS object FROM (SELECT DISTINCT event_type FROM events) e LEFT JOIN nation n ON n.n_nationkey = length(e.event_type)")
def grid_locate(spark, sf_dir):
    """Event types as spec names, with nations (by the length of the name) as the modules that hold them."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct()
    known = names.join(table(spark, sf_dir, "nation"), F.length("name") == F.col("n_nationkey")).select("name", F.col("n_name").alias("module"), F.col("n_regionkey").alias("object"))
    return specs.locate(names, known)


@query("softmax_log", "SELECT p_partkey, round_even(exp(p_size / 10.0 - m) / sum(exp(p_size / 10.0 - m)) OVER (PARTITION BY p_brand), 9) AS p FROM (SELECT *, max(p_size / 10.0) OVER (PARTITION BY p_brand) AS m FROM part)")
def softmax_log(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.bround(scalars.log_softmax(F.col("p_size") / 10.0, F.col("p_brand")), 9).alias("p"))


@query("scalar_joined", "SELECT n_nationkey, concat_ws('_', nullif(n_name, 'None'), CASE WHEN n_regionkey > 2 THEN CAST(n_regionkey AS VARCHAR) END) AS joined, array_to_string(list_sort([n_name, CAST(n_regionkey AS VARCHAR), 'm']), '-') AS tags, printf('#%02x00%02x', CAST(floor(least(n_nationkey / 20.0, 1) * 255) AS INT), CAST(floor((1 - least(n_nationkey / 20.0, 1)) * 255) AS INT)) AS colour FROM nation")
def scalar_joined(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    part = F.when(F.col("n_regionkey") > 2, F.col("n_regionkey"))
    return n.select("n_nationkey", scalars.join_present(F.col("n_name"), part).alias("joined"), scalars.tags(F.col("n_name"), F.col("n_regionkey"), F.lit("m")).alias("tags"), scalars.colour(F.col("n_nationkey"), 0, 20).alias("colour"))


@query("grid_changed", GRID + " SELECT brand, CAST(9 AS BIGINT) AS size, 'new' AS note FROM b")
def grid_changed(spark, sf_dir):
    """One key replaced in every row, one removed, one added."""
    design = specs.Design.of({"brand": _values(spark, sf_dir, "part", "p_brand"), "size": [1, 2], "event": ["a", "b"]}).overlay({"size": 9, "note": "new"}).without("event")
    return specs.SpecSet.of(design).table(spark).select("brand", "size", "note")


@query("alias_rows", "SELECT CAST(n_nationkey AS VARCHAR) AS id, CASE n_name WHEN 'NATION_3' THEN 'third' ELSE n_name END AS name, CASE WHEN n_regionkey = 1 THEN 'None' ELSE CAST(n_regionkey AS VARCHAR) END AS region FROM nation")
def alias_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.when(F.col("n_regionkey") != 1, F.col("n_regionkey")).alias("region"))
    return specs.shown_rows(n, {"NATION_3": "third"})


@query("run_seeds", "SELECT n_nationkey, CAST((list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(list_reverse(string_split(n_name, '')), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, c: (a * 31 + c) % 4294967296) + n_regionkey) % 4294967296 AS BIGINT) AS seed FROM nation")
def run_seeds(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", specs.seed_column(F.col("n_name"), F.col("n_regionkey")).alias("seed"))


@query("minibatch_count", "SELECT CAST(floor(count(*) * 10 * 0.5) AS BIGINT) AS n FROM nation")
def minibatch_count(spark, sf_dir):
    from ..operators.graph import minibatch_count as count

    return spark.range(1).select(F.lit(count(table(spark, sf_dir, "nation").count(), 10, 0.5)).cast("long").alias("n"))
