"""Result cubes and measure logs: pivots, reduction over repeats, marks, merges, and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import numbered

#: Reduction over repeats by name.
REDUCERS = {"mean": F.avg, "rmax": F.max, "rmin": F.min}
#: Columns of a pivoted table.
MOST_COLUMNS = 10_000
#: Rows of a running total that one task adds up.
PART = 100_000


def ordered_values(df: DataFrame, key: str) -> DataFrame:
    """Distinct values of a key, nulls last."""
    return df.select(key).distinct().orderBy(F.asc_nulls_last(key))


def pivot(df: DataFrame, x: str, y: str, value: str, how=F.avg, values: list | None = None) -> DataFrame:
    """A row per x, a column per y. Without ``values`` the y are asked for first; more than ``MOST_COLUMNS`` are an error."""
    if values is None:
        values = [r[0] for r in df.select(y).distinct().limit(MOST_COLUMNS + 1).collect()]
        if len(values) > MOST_COLUMNS:
            raise ValueError(f"a table of more than {MOST_COLUMNS} columns")
        values.sort(key=lambda v: (v is None, v))
    return df.groupBy(x).pivot(y, values).agg(how(value))


def cube(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One cell per combination of the keys' values: the mean to twelve decimals, null where no row has it."""
    dims = [df.select(k).distinct() for k in keys]
    grid = dims[0]
    for d in dims[1:]:
        grid = grid.crossJoin(d)  # the axes of a table: their product is the result itself
    return grid.join(df.groupBy(*keys).agg(exact_mean(value).alias(value)), keys, "left")


def over_repeats(df: DataFrame, keys: list[str], value: str, how: str = "mean", digits: int = 3, spread: int = 2) -> DataFrame:
    """(keys, value, std): reduction over the remaining rows and their population deviation, rounded half to even.

    Sums are decimal, so they do not depend on the order of rows: a mean that lies between two roundings rounds to the even one every time.
    """
    exact = F.col(value).cast(EXACT)
    reduced = {"mean": exact_mean(value), "rmax": F.max(exact), "rmin": F.min(exact)}[how]
    return df.groupBy(*keys).agg(F.bround(reduced, digits).cast("double").alias(value), F.bround(F.stddev_pop(value), spread).alias("std"))


#: What values are summed as: twelve decimals.
EXACT = "decimal(24,12)"


def exact_mean(value: str) -> Column:
    """The mean to twelve decimals, by a decimal sum."""
    return (F.sum(F.col(value).cast(EXACT)).cast("decimal(32,12)") / F.count(value)).cast(EXACT)


def shown(value: Column, std: Column) -> Column:
    return F.concat(value.cast("string"), F.lit(" pm "), std.cast("string"))


def best(df: DataFrame, row: str, column: str, value: str, largest: bool = True) -> DataFrame:
    """Marks the best cell of each row; of equal ones the first column."""
    order = F.desc_nulls_last(value) if largest else F.asc_nulls_last(value)
    return df.withColumn("best", F.row_number().over(Window.partitionBy(row).orderBy(order, column)) == 1)


def merged(df: DataFrame, group: str, x: str, y: str, value: str) -> DataFrame:
    """Tables of several groups side by side, as a long form with headers group|y."""
    return df.select(x, F.concat_ws("|", group, y).alias("header"), value)


def axis_positions(df: DataFrame, keys: list[str]) -> DataFrame:
    """The position of each row's value on each axis, however many values it has."""
    for k in keys:
        axis = numbered(df.select(k).distinct(), f"{k}_pos", F.asc_nulls_last(k)).withColumn(f"{k}_pos", F.col(f"{k}_pos").cast("int"))
        df = df.join(axis, df[k].eqNullSafe(axis[k]), "left").drop(axis[k])
    return df


def deltas(log: DataFrame, run: list[str], step: list[str], value: str) -> DataFrame:
    """Each value with its change against the one before, the first against zero."""
    w = Window.partitionBy(*run).orderBy(*step)
    return log.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)))


def every(log: DataFrame, step: str, k: int) -> DataFrame:
    return log.where(F.pmod(F.col(step), F.lit(k)) == 0)


def sampled_iterations(log: DataFrame, step: str, burn_in: int = 0, thin: int = 1) -> DataFrame:
    return log.where((F.col(step) >= burn_in) & (F.pmod(F.col(step) - burn_in, F.lit(thin)) == 0))


def last_values(log: DataFrame, run: list[str], step: str, value: str) -> DataFrame:
    return log.groupBy(*run).agg(F.max(step).alias("last_step"), F.max_by(value, step).alias(value))


def running_bounds(sizes: DataFrame, order: str, size: str, by: str | None = None) -> DataFrame:
    """Cumulative boundaries of blocks in order (of each ``by``); without ``by`` no task holds them all: parts of the order are summed first."""
    if by:
        return sizes.withColumn("bound", F.sum(size).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
    ranked = numbered(sizes, "__rank", F.col(order)).withColumn("__part", F.floor(F.col("__rank") / PART))
    totals = ranked.groupBy("__part").agg(F.sum(size).alias("__sum"))
    before = totals.withColumn("__before", F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__sum")  # a row for PART rows
    inside = F.sum(size).over(Window.partitionBy("__part").orderBy("__rank").rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("bound", inside).join(before, "__part").withColumn("bound", F.col("bound") + F.col("__before")).drop("__rank", "__part", "__before")


def curve(log: DataFrame, step: str, run: str, value: str, runs: list) -> DataFrame:
    """Measure by iteration, one column per run."""
    return log.groupBy(step).pivot(run, runs).agg(F.first(value))


def first_last(runs: DataFrame, order: str) -> DataFrame:
    """Run numbers with flags of the first and the last, from the smallest and largest only."""
    ends = runs.agg(F.min(order).alias("lo"), F.max(order).alias("hi"))
    return runs.crossJoin(F.broadcast(ends)).select(*runs.columns, (F.col(order) == F.col("lo")).alias("is_first"), (F.col(order) == F.col("hi")).alias("is_last"))


def sorted_perm(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with ``perm``, their place before, by ``place``, and ``sorted``, their place in the order given."""
    return numbered(df.withColumnRenamed("place", "perm"), "sorted", *order)


def moved(df: DataFrame, fr: int, to: int, place: str = "place") -> DataFrame:
    """The row at place ``fr`` goes to ``to``; those between shift by one."""
    p = F.col(place)
    shifted = F.when(p == fr, to).when((p >= to) & (p < fr), p + 1).when((p > fr) & (p <= to), p - 1).otherwise(p)
    return df.withColumn(place, shifted.cast(dict(df.dtypes)[place]))


def remapped(c: Column, values: dict) -> Column:
    """Each value by the mapping, all at once, others as they are."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), c), c)


def without_zeros(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) != 0)


def as_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, json): the other columns of each row as a JSON object; arrays become lists, dates text."""
    rest = [c for c in df.columns if c not in keys]
    return df.select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("json"))


#: Columns of old measure logs by name, and axis labels by column: fixed values.
LEGACY_COLUMNS = {"Iteration": 0, "Timeit": 1, "loglikelihood": 2, "likelihood": 2, "perplexity": 2, "loglikelihood_t": 3, "likelihood_t": 3, "perplexity_t": 3, "K": 4, "alpha": 5, "gamma": 6}
LEGACY_LABELS = {0: "Iteration", 1: "loglikelihood", 2: "loglikelihood", 3: "loglikelihood"}


def legacy_column(name: Column) -> Column:
    """The position of a named column in an old log; null for other names."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in LEGACY_COLUMNS.items() for x in pair]), name)


def legacy_label(position: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LEGACY_LABELS.items() for x in pair]), position)
