"""Statistics: means, histograms, power laws, agreement measures, clustering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fewest observations in the tail and fewest distinct values of a power-law fit.
LEAST_TAIL, LEAST_POINTS = 25, 5


def weighted_means(df: DataFrame, a: str, w: str) -> DataFrame:
    """One row: geometric, arithmetic and harmonic means."""
    return df.agg(
        F.exp(F.sum(F.col(w) * F.log(a)) / F.sum(w)).alias("geometric"), (F.sum(F.col(w) * F.col(a)) / F.sum(w)).alias("arithmetic"), (F.sum(w) / F.sum(F.col(w) / F.col(a))).alias("harmonic")
    )


def cluster_histogram(df: DataFrame, cluster: str) -> DataFrame:
    """Sizes of non-empty clusters in falling order, equal ones by falling label."""
    return df.groupBy(cluster).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc(cluster))


def histogram_bands(histograms: DataFrame) -> DataFrame:
    """Mean and deviation of counts over graphs, from (graph, degree, n)."""
    return histograms.groupBy("degree").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"))


def power_law(histogram: DataFrame) -> DataFrame:
    """One row (alpha, x_min, n) from (degree, n): alpha = 1 + n / sum ln(x / (x_min - 1/2)) over the tail above x_min; null where there is too little."""
    full = histogram.where("n > 0")
    low = full.agg(F.min("degree").alias("x_min"))
    tail = full.crossJoin(F.broadcast(low)).where("degree > x_min")
    logs = F.log(F.col("degree") / (F.col("x_min") - 0.5))
    every = full.agg(F.sum("n").alias("n"), F.count("*").alias("points"), F.min("degree").alias("x_min"))
    sums = tail.agg(F.sum(F.col("n") * logs).alias("s"), F.sum("n").alias("n_tail"))
    both = every.crossJoin(F.broadcast(sums))
    enough = (F.col("n") >= LEAST_TAIL) & (F.col("points") >= LEAST_POINTS)
    return both.select(F.when(enough, 1 + F.col("n") / F.col("s")).alias("alpha"), "x_min", "n")


def zeta(s: float, a: float, terms: int = 30) -> float:
    """The Hurwitz zeta function by Euler-Maclaurin summation."""
    head = sum((a + k) ** -s for k in range(terms))
    x = a + terms
    out = head + x ** (1 - s) / (s - 1) + 0.5 * x**-s
    # Bernoulli numbers of even order, and rising factors of s.
    factor = s * x ** (-s - 1)
    for k, bernoulli in enumerate((1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730, 7 / 6)):
        out += bernoulli / math.factorial(2 * k + 2) * factor
        factor *= (s + 2 * k + 1) * (s + 2 * k + 2) / x**2
    return out


def ks_distance(values: np.ndarray, counts: np.ndarray, alpha: float, x_min: float) -> float:
    """Largest gap between an empirical distribution and the discrete power law 1 - zeta(alpha, x) / zeta(alpha, x_min), on either side of each step."""
    order = np.argsort(values)
    values, counts = values[order], counts[order]
    after = np.cumsum(counts) / counts.sum()
    before = np.append(0.0, after[:-1])
    base = zeta(alpha, x_min)
    model = np.array([1 - zeta(alpha, v) / base for v in values.tolist()])
    return float(max((after - model).max(), (model - before).max()))


def power_law_test(histogram: DataFrame, precision: float = 0.03, seed: int = 0, histogram_limit: int = 1_000_000) -> DataFrame:
    """One row (alpha, x_min, ks, p_value): the part of synthetic sets, int(0.25 / precision**2) of them, at least as far from the fitted law as the data.

    Each set has as many values as the data: a binomial number of them drawn from the law's tail, the others from the data up to x_min. It is compared with the law fitted to the data.
    The histogram (one row per distinct degree) goes to the tasks; more than ``histogram_limit`` distinct degrees raise an error.
    """
    spark = histogram.sparkSession
    rows = histogram.where("n > 0").select("degree", "n").limit(histogram_limit + 1).toPandas()
    if len(rows) > histogram_limit:
        raise ValueError("too many distinct degrees")
    fit = power_law(histogram).first()
    if fit["alpha"] is None:
        return spark.createDataFrame([(None, fit["x_min"], None, None)], "alpha double, x_min long, ks double, p_value double")
    alpha, low, n_tail = fit["alpha"], float(fit["x_min"]), int(fit["n"])
    degree, count = rows["degree"].to_numpy(float), rows["n"].to_numpy(float)
    n, head = int(count.sum()), degree <= low
    ks = ks_distance(degree, count, alpha, low)
    sets = int(0.25 / precision**2)

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            worse = []
            for k in batch["id"]:
                rng = np.random.default_rng([seed, int(k)])
                tail = rng.binomial(n, n_tail / n)
                values, counts = np.unique(np.floor((low - 0.5) * (1 - rng.random(tail)) ** (-1 / (alpha - 1)) + 0.5), return_counts=True)
                if head.any():
                    again = rng.multinomial(n - tail, count[head] / count[head].sum())
                    values, at = np.unique(np.concatenate([values, degree[head]]), return_inverse=True)
                    counts = np.bincount(at, np.concatenate([counts, again]), len(values))
                    values, counts = values[counts > 0], counts[counts > 0]
                worse.append(float(ks_distance(values, counts, alpha, low) >= ks))
            yield pd.DataFrame({"worse": worse})

    part = spark.range(sets).repartition(min(sets, 8)).mapInPandas(one, "worse double").agg(F.avg("worse").alias("p_value"))
    return part.select(F.lit(alpha).alias("alpha"), F.lit(int(low)).cast("long").alias("x_min"), F.lit(ks).alias("ks"), "p_value")


def ks_of_histogram(histogram: DataFrame, alpha: float, x_min: float) -> DataFrame:
    """One row: the gap of ``ks_distance``, with the zeta function as a sum of its first terms and an integral for the rest (in SQL alone)."""
    law = lambda x: f"(aggregate(sequence(0, 199), 0.0D, (s, k) -> s + power({x} + k, -{alpha}D)) + power({x} + 200, 1 - {alpha}D) / ({alpha}D - 1) + 0.5 * power({x} + 200, -{alpha}D) + {alpha}D / 12 * power({x} + 200, -{alpha}D - 1))"
    from .results import running_bounds

    total = histogram.agg(F.sum("n").alias("total"))
    steps = running_bounds(histogram.where("n > 0"), "degree", "n").crossJoin(F.broadcast(total))
    model = F.expr(f"1 - {law('cast(degree as double)')} / {law(f'cast({x_min} as double)')}")
    gaps = steps.select(F.greatest(F.col("bound") / F.col("total") - model, model - (F.col("bound") - F.col("n")) / F.col("total")).alias("gap"))
    return gaps.agg(F.max("gap").alias("ks"))


def log_log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    both = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log(x).alias("x"), F.log(y).alias("y"))
    return both.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def log_bins(df: DataFrame, x: str, y: str, edges: int = 35) -> DataFrame:
    """(bin, x, y): weighted sums in bins of equal width in log10 x; the last bin is closed."""
    ends = df.where(F.col(x) > 0).agg(F.log10(F.min(x)).alias("lo"), F.log10(F.max(x)).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / (edges - 1)
    spot = F.least(F.floor((F.log10(x) - F.col("lo")) / width), F.lit(edges - 2))
    return df.where(F.col(x) > 0).crossJoin(F.broadcast(ends)).groupBy(spot.cast("int").alias("bin")).agg((F.sum(F.col(x) * F.col(y)) / F.sum(y)).alias("x"), F.sum(y).alias("y"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: the four counts and precision, recall, accuracy, density."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = F.col
    return counts.select(
        "*",
        (c("tp") / (c("tp") + c("fp"))).alias("prec"),
        (c("tp") / (c("tp") + c("fn"))).alias("rec"),
        ((c("tp") + c("tn")) / (c("tp") + c("fp") + c("fn") + c("tn"))).alias("accuracy"),
        ((c("tp") + c("fn")) / (c("tp") + c("fp") + c("fn") + c("tn"))).alias("density"),
    )


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties counted half: positives and negatives are summed per score first, then ordered by partition and offset."""
    from .lineage import numbered

    per = df.groupBy(score).agg(F.sum(F.col(truth)).alias("pos"), F.sum(1 - F.col(truth)).alias("neg"))
    ranked = numbered(per, "k", F.col(score))
    block = F.floor(F.col("k") / 65536)
    sums = ranked.groupBy(block.alias("block")).agg(F.sum("neg").alias("neg_in"))
    before = sums.select("block", F.expr("coalesce(sum(neg_in) over (order by block rows between unbounded preceding and 1 preceding), 0)").alias("neg_before"))
    inner = ranked.withColumn("block", block).withColumn("below", F.expr("coalesce(sum(neg) over (partition by block order by k rows between unbounded preceding and 1 preceding), 0)"))
    total = per.agg(F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    wins = inner.join(F.broadcast(before), "block").agg(F.sum(F.col("pos") * (F.col("neg_before") + F.col("below") + F.col("neg") / 2)).alias("wins"))
    return wins.crossJoin(total).select((F.col("wins") / (F.col("np") * F.col("nn"))).alias("auc"))


def annealing_energy(matrix: DataFrame, blocks: DataFrame) -> DataFrame:
    """Energy of a partition of a square matrix: mean inner density less the squared mean of outer density, over clusters; blocks(id, cluster)."""
    sizes = blocks.groupBy("cluster").agg(F.count("*").alias("size"))
    total = sizes.agg(F.sum("size").alias("k"), F.count("*").alias("c"))
    tagged = matrix.join(blocks.select(F.col("id").alias("src"), F.col("cluster").alias("a")), "src").join(blocks.select(F.col("id").alias("dst"), F.col("cluster").alias("b")), "dst")
    pair = tagged.groupBy("a", "b").agg(F.sum("w").alias("w"))
    inner = pair.where("a = b").select(F.col("a").alias("cluster"), F.col("w").alias("inner_sum"))
    outer = pair.where("a <> b").select(F.explode(F.array("a", "b")).alias("cluster"), "w").groupBy("cluster").agg(F.sum("w").alias("outer_sum"))
    rows = sizes.join(inner, "cluster", "left").join(outer, "cluster", "left").crossJoin(F.broadcast(total)).na.fill(0)
    room = 2 * (F.col("k") * F.col("size") - F.col("size") * F.col("size"))
    terms = rows.select("c", (F.col("inner_sum") / (F.col("size") * F.col("size"))).alias("i"), F.when(room > 0, F.col("outer_sum") / room).otherwise(0.0).alias("o"))
    return terms.groupBy("c").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).select(((F.col("i") - F.col("o") * F.col("o") / F.col("c")) / F.col("c")).alias("energy"))


def boundary_partition(matrix: np.ndarray, clusters: int, seed: int = 0, steps: int = 300, temperature: float = 1.0) -> tuple[np.ndarray, float]:
    """Labels of a square matrix's rows by annealing over cluster moves, and their energy. A dense matrix, in one task's memory.

    Each step proposes to move one row to the cluster that its weights favour most, or to a random one; a worse energy is accepted with probability exp(-gap / t * ln 1000).
    """
    n = len(matrix)
    rng = np.random.default_rng(seed)
    both = matrix + matrix.T
    label = np.arange(n) * clusters // n

    def energy(lab: np.ndarray) -> float:
        hot = np.eye(clusters)[lab]
        size = hot.sum(0)
        live = size > 0
        block = hot.T @ matrix @ hot
        inside = np.diag(block)
        out = block.sum(0) + block.sum(1) - 2 * inside
        room = 2 * (n * size - size**2)
        i = np.where(live, inside / np.maximum(size, 1) ** 2, 0).sum()
        o = np.where(room > 0, out / np.maximum(room, 1), 0).sum()
        c = live.sum()
        return float((i - o**2 / c) / c)

    now = energy(label)
    top, top_energy = label.copy(), now
    for step in range(steps):
        t = max(temperature * (1 - step / steps), 1e-3)
        row = int(rng.integers(n))
        hot = np.eye(clusters)[label]
        liking = both[row] @ hot / np.maximum(hot.sum(0), 1)
        new = label.copy()
        new[row] = int(liking.argmax()) if rng.random() < 0.8 else int(rng.integers(clusters))
        e = energy(new)
        if e > now or rng.random() < math.exp(-(now - e) / t * math.log(1000)):
            label, now = new, e
            if now > top_energy:
                top, top_energy = label.copy(), now
    return top, top_energy


def annealing_degree(matrix: DataFrame) -> DataFrame:
    """(id, degree): sum of a row and its column, the diagonal once."""
    ends = matrix.select(F.col("src").alias("id"), "w").union(matrix.where("src <> dst").select("dst", "w"))
    return ends.groupBy("id").agg(F.sum("w").alias("degree"))


def boundary_cuts(step: int, n: int, clusters: int, rng: np.random.Generator) -> np.ndarray:
    """Bounds of consecutive blocks: evenly spaced at step 0, else random even places, at least two apart."""
    if step == 0:
        return np.linspace(0, n, clusters + 1).astype(int)
    inner = rng.choice(np.arange(2, n - 1, 2), clusters - 1, replace=False)
    return np.concatenate([[0], np.sort(inner), [n]]).astype(int)


def block_energy(matrix: np.ndarray, label: np.ndarray, clusters: int) -> float:
    """Mean inner density less the squared mean of outer density, of non-empty clusters."""
    n, hot = len(matrix), np.eye(clusters)[label]
    size = hot.sum(0)
    block = hot.T @ matrix @ hot
    inside, room = np.diag(block), 2 * (n * size - size**2)
    out = block.sum(0) + block.sum(1) - 2 * inside
    live = (size > 0).sum()
    i = (inside / np.maximum(size, 1) ** 2).sum()
    o = (out / np.maximum(room, 1))[room > 0].sum()
    return float((i - o**2 / live) / live)


def concentrated(matrix: np.ndarray, label: np.ndarray, clusters: int, rng: np.random.Generator) -> np.ndarray:
    """Each row, in random order, goes to the cluster c of largest inside / size**2 - outside / (n - size)**2, counted with the row in it."""
    n, label = len(matrix), label.copy()
    both = matrix + matrix.T
    np.fill_diagonal(both, np.diag(matrix))
    degree = both.sum(1)
    for row in rng.permutation(n):
        hot = np.eye(clusters)[label]
        hot[row] = 0
        size = hot.sum(0) + 1
        inside = np.einsum("ic,ij,jc->c", hot, matrix, hot) + both[row] @ hot + matrix[row, row]
        ends = degree @ hot - 2 * np.einsum("ic,ij,jc->c", hot, matrix, hot)
        outside = ends - both[row] @ hot + degree[row] - both[row] @ hot - matrix[row, row]
        label[row] = int(np.argmax(inside / size**2 - outside / np.maximum(n - size, 1) ** 2))
    return label


def boundary_annealing(matrix: np.ndarray, steps: int = 200, clusters: int = 2, grow: int = 1, seed: int = 0) -> tuple[np.ndarray, float]:
    """Labels of the rows by annealing over the bounds of consecutive blocks, and their energy; while that grows, ``grow`` more clusters are tried.

    Bounds are drawn anew in each step and taken if better, or with probability exp(-gap / t ln 1000), t falling with the steps; every tenth step rows are reassigned
    and put in the order of their clusters.
    """
    n, rng = len(matrix), np.random.default_rng(seed)
    best, top = np.zeros(n, int), -math.inf
    while True:
        order, now, kept = np.arange(n), -math.inf, None
        for step in range(steps):
            label = np.empty(n, int)
            label[order] = np.repeat(np.arange(clusters), np.diff(boundary_cuts(step, n, clusters, rng)))
            if step % 10 == 9:
                label = concentrated(matrix, label, clusters, rng)
                order = np.argsort(label, kind="stable")
            e = block_energy(matrix, label, clusters)
            t = (steps - step) / (n**2 / clusters)
            if kept is None or rng.random() < math.exp(min(0.0, (e - now) / t * math.log(1000))):
                now, kept = e, label
        if now <= top:
            return best, top
        best, top = kept, now
        clusters += grow
        if not grow or clusters - 1 > len(range(2, n - 1, 2)):
            return best, top


def annealed(matrix: DataFrame, group: str, clusters: int, seed: int = 0, bounds: bool = False) -> DataFrame:
    """(group, id, cluster, energy): one annealing per group of (group, src, dst, w), by moves of rows or, with ``bounds``, by bounds of growing numbers of blocks; a group's square matrix is one task's work.

    Bounds need more than twice as many nodes as clusters in each group; fewer are an error.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        m = np.zeros((len(ids), len(ids)))
        np.add.at(m, (np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"])), pdf["w"])
        if bounds and len(ids) <= 2 * clusters:
            raise ValueError(f"bounds of {clusters} clusters among {len(ids)} nodes")
        label, energy = boundary_annealing(m, clusters=clusters, seed=seed) if bounds else boundary_partition(m, min(clusters, len(ids)), seed)
        return pd.DataFrame({group: pdf[group].iloc[0], "id": ids, "cluster": label, "energy": energy})

    kind = dict(matrix.dtypes)[group]
    return matrix.groupBy(group).applyInPandas(run, f"{group} {kind}, id long, cluster long, energy double")


def k_means(points: DataFrame, features: str, k: int, seed: int = 1) -> DataFrame:
    """points with a ``cluster`` column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = points.withColumn("__v", array_to_vector(F.col(features).cast("array<double>")))
    return KMeans(k=k, seed=seed, featuresCol="__v", predictionCol="cluster").fit(vectors).transform(vectors).drop("__v")


def estimator_pipeline(points: DataFrame, features: str, k: int, dims: int = 8, seed: int = 1):
    """A fitted pipeline: scale, reduce, cluster."""
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector

    vectors = points.withColumn("v", array_to_vector(F.col(features).cast("array<double>")))
    stages = [StandardScaler(inputCol="v", outputCol="scaled", withMean=True), PCA(k=dims, inputCol="scaled", outputCol="reduced"), KMeans(k=k, seed=seed, featuresCol="reduced", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(vectors), vectors
