"""Statistics over degree histograms, prices, labels and embeddings."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..operators import graph, stats
from ..plans.estimators import RunPipeline
from . import query, table
from .graphs import DEGREES, NEXT, PARTS, nextpart, partsupp

HIST = PARTS + ", d AS (SELECT dst AS id, count(*) AS degree FROM parts GROUP BY dst), h AS (SELECT degree, count(*) AS n FROM d GROUP BY degree)"


def histogram(spark, sf_dir):
    d = partsupp(spark, sf_dir).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    return graph.degree_histogram(d, filled=False)


@query("stat_wmeans", "SELECT round_even(exp(sum(p_size * ln(p_retailprice)) / sum(p_size)), 4) AS geometric, round_even(sum(p_size * p_retailprice) / sum(p_size), 4) AS arithmetic, round_even(sum(p_size) / sum(p_size / p_retailprice), 4) AS harmonic FROM part")
def stat_wmeans(spark, sf_dir):
    m = stats.weighted_means(table(spark, sf_dir, "part"), "p_retailprice", "p_size")
    return m.select(*[F.bround(c, 4).alias(c) for c in m.columns])


@query("stat_cluster_hist", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def stat_cluster_hist(spark, sf_dir):
    return stats.cluster_histogram(table(spark, sf_dir, "embeddings"), "label")


@query("stat_hist_bands", "WITH g AS (SELECT l_linenumber AS graph, l_suppkey, count(*) AS degree FROM lineitem GROUP BY ALL), h AS (SELECT graph, degree, count(*) AS n FROM g GROUP BY ALL) SELECT degree, round_even(avg(n), 6) AS mean, round_even(stddev_pop(n), 6) AS std FROM h GROUP BY degree")
def stat_hist_bands(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("graph"), "l_suppkey").agg(F.count("*").alias("degree")).groupBy("graph", "degree").agg(F.count("*").alias("n"))
    return stats.histogram_bands(g).select("degree", F.bround("mean", 6).alias("mean"), F.bround("std", 6).alias("std"))


@query("stat_powerlaw_alpha", NEXT + DEGREES + ", h AS (SELECT degree, count(*) AS n FROM d GROUP BY degree), x AS (SELECT min(degree) AS lo, sum(n) AS n, count(*) AS points FROM h) SELECT round_even(1 + max(x.n) / sum(h.n * ln(degree / (lo - 0.5))), 6) AS alpha, max(lo) AS x_min, CAST(max(x.n) AS BIGINT) AS n FROM h, x WHERE degree > lo AND x.n >= 25 AND points >= 5")
def stat_powerlaw_alpha(spark, sf_dir):
    h = graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)), filled=False)
    return stats.power_law(h).select(F.bround("alpha", 6).alias("alpha"), "x_min", "n")


@query("stat_ks")
def stat_ks(spark, sf_dir):
    return stats.power_law_test(graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)), filled=False), precision=0.03)


@query("stat_loglog_fit", NEXT + DEGREES + ", h AS (SELECT ln(degree) AS x, ln(count(*)) AS y FROM d GROUP BY degree) SELECT round_even(regr_slope(y, x), 6) AS slope, round_even(regr_intercept(y, x), 6) AS intercept FROM h")
def stat_loglog_fit(spark, sf_dir):
    h = graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)), filled=False)
    return stats.log_log_fit(h, "degree", "n").select(F.bround("slope", 6).alias("slope"), F.bround("intercept", 6).alias("intercept"))


@query("stat_logbins", NEXT + DEGREES + ", h AS (SELECT degree, count(*) AS n FROM d GROUP BY degree), x AS (SELECT log10(min(degree)) AS lo, log10(max(degree)) AS hi FROM h) SELECT CAST(least(floor((log10(degree) - lo) / ((hi - lo) / 34)), 33) AS INT) AS bin, round_even(sum(degree * n) / sum(n), 6) AS x, CAST(sum(n) AS BIGINT) AS y FROM h, x GROUP BY 1")
def stat_logbins(spark, sf_dir):
    h = graph.degree_histogram(graph.degrees(nextpart(spark, sf_dir)), filled=False)
    return stats.log_bins(h, "degree", "n").select("bin", F.bround("x", 6).alias("x"), "y")


VOTES = "WITH v AS (SELECT l.doc_id, quality, CAST(n_chars > 1500 AS INT) AS predicted, n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def votes(spark, sf_dir):
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("predicted", (F.col("n_chars") > 1500).cast("int"))


@query("stat_confusion", VOTES + ", c AS (SELECT count(*) FILTER (quality = 1 AND predicted = 1) AS tp, count(*) FILTER (quality <> 1 AND predicted = 1) AS fp, count(*) FILTER (quality = 1 AND predicted <> 1) AS fn, count(*) FILTER (quality <> 1 AND predicted <> 1) AS tn FROM v) SELECT *, round_even(tp / (tp + fp), 6) AS prec, round_even(tp / (tp + fn), 6) AS rec, round_even((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round_even((tp + fn) / (tp + fp + fn + tn), 6) AS density FROM c")
def stat_confusion(spark, sf_dir):
    c = stats.confusion(votes(spark, sf_dir), "quality", "predicted")
    return c.select("tp", "fp", "fn", "tn", *[F.bround(x, 6).alias(x) for x in ("prec", "rec", "accuracy", "density")])


@query("stat_auc", VOTES + ", r AS (SELECT quality, (rank() OVER (ORDER BY n_chars) + rank() OVER (ORDER BY n_chars) + count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS r FROM v), s AS (SELECT sum(r) FILTER (quality = 1) AS sr, count(*) FILTER (quality = 1) AS np, count(*) FILTER (quality <> 1) AS nn FROM r) SELECT round_even((sr - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM s")
def stat_auc(spark, sf_dir):
    return stats.auc(votes(spark, sf_dir), "quality", "n_chars").select(F.bround("auc", 6).alias("auc"))


@query("stat_nmi", "WITH l AS (SELECT lang AS a, source AS b FROM documents), t AS (SELECT count(*) AS t FROM l), j AS (SELECT a, b, count(*) AS n FROM l GROUP BY ALL), x AS (SELECT a, count(*) AS na FROM l GROUP BY a), y AS (SELECT b, count(*) AS nb FROM l GROUP BY b) SELECT round_even(2 * (SELECT sum(n / t * ln(n * t / (na * nb))) FROM j JOIN x USING (a) JOIN y USING (b), t) / ((SELECT -sum(na / t * ln(na / t)) FROM x, t) + (SELECT -sum(nb / t * ln(nb / t)) FROM y, t)), 6) AS nmi")
def stat_nmi(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("a"), F.col("source").alias("b"))
    return graph.mutual_information(d).select(F.bround("nmi", 6).alias("nmi"))


@query("ml_kmeans")
def ml_kmeans(spark, sf_dir):
    return stats.k_means(table(spark, sf_dir, "embeddings"), "embedding", 10).select("vec_id", "label", "cluster")


@query("ml_pipeline")
def ml_pipeline(spark, sf_dir):
    model, vectors = stats.estimator_pipeline(table(spark, sf_dir, "embeddings"), "embedding", 10)
    return model.transform(vectors).select("vec_id", "label", "cluster")


@query(
    "ml_run_pipeline",
    """WITH u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT k, avg(x) AS m, stddev_samp(x) AS s FROM u GROUP BY k),
z AS (SELECT vec_id, k, (x - m) / s AS z FROM u JOIN m USING (k)), n AS (SELECT vec_id, sum(abs(z)) AS n FROM z GROUP BY vec_id) SELECT vec_id, round_even(max(CASE WHEN k = 1 THEN z / n END), 6) AS first, round_even(sum(z / n), 6) AS total FROM z JOIN n USING (vec_id) GROUP BY vec_id""",
)
def ml_run_pipeline(spark, sf_dir):
    """A run's scoped, renamed and defaulted parameters: centred and scaled entries, then rows of absolute sum 1 after the fit."""
    run = {"scale__centre": True, "normalizer__p": 1.0, "other__p": 3.0}
    pipeline = RunPipeline(["pyspark.ml.feature.StandardScaler"], run, names=["scale"], specMap={"withMean": "centre"}, defaultSpec={"withStd": True}, postTransform=["pyspark.ml.feature.Normalizer"], inputCol="embedding", outputCol="out")
    e = table(spark, sf_dir, "embeddings")
    v = vector_to_array("out")
    return pipeline.fit(e).transform(e).select("vec_id", F.bround(v[0], 6).alias("first"), F.bround(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


ZETA = "(list_sum(list_transform(range(200), lambda k: pow({0} + k, -2.5))) + pow({0} + 200, -1.5) / 1.5 + 0.5 * pow({0} + 200, -2.5) + 2.5 / 12 * pow({0} + 200, -3.5))"


@query("stat_ks_distance", HIST + f", s AS (SELECT CAST(degree AS DOUBLE) AS x, n, sum(n) OVER (ORDER BY degree) AS b, sum(n) OVER () AS t FROM h), m AS (SELECT *, 1 - {ZETA.format('x')} / {ZETA.format('1.0')} AS model FROM s) SELECT round_even(max(greatest(b / t - model, model - (b - n) / t)), 9) AS ks FROM m")
def stat_ks_distance(spark, sf_dir):
    return stats.ks_of_histogram(histogram(spark, sf_dir), 2.5, 1.0).select(F.bround("ks", 9).alias("ks"))
