"""Measure logs: their column grammar, reading, and writing."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut, parts

#: Rows that a log's writer gathers before it appends them.
BUFFER_ROWS = 20


def grammar(header: str) -> list[tuple[str, bool]]:
    """(name, is_list) of each column; a list's length is the number in the column before it."""
    return [(c.strip("{}"), c.startswith("{")) for c in header.lstrip("#").split()]


def parse_lines(lines: DataFrame, header: str) -> DataFrame:
    """(key columns..., measure, values array<string>) of rows (..., it, line): comments are skipped, white space collapses."""
    rows = lines.where("not ltrim(line) rlike '^[#%]' and trim(line) <> ''").withColumn("f", F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " "))
    at: Column = F.lit(1)
    parts, before = [], None
    for name, is_list in grammar(header):
        n = F.element_at("f", at - 1).cast("int") if is_list and before is not None else F.lit(1)
        parts.append(F.struct(F.lit(name).alias("measure"), F.slice("f", at, n).alias("values")))
        at, before = at + n, name
    keys = [c for c in lines.columns if c != "line"]
    return rows.select(*keys, F.explode(F.array(*parts)).alias("m")).select(*keys, "m.*")


#: Different headers that the logs of one read may have.
MOST_GRAMMARS = 100


def read_log(spark: SparkSession, path: str, iterations: int | None = None) -> DataFrame:
    """(path, it, measure, values) of .inf files; it counts the rows of a file from 0."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", "\n").alias("lines"))
    whole = whole.withColumn("header", F.get(F.filter("lines", lambda x: x.startswith("#") & ~x.startswith("# ")), F.lit(0)))
    whole = cut(whole)  # each file is opened once, for its header and for its rows
    grammars = [r[0] for r in whole.where("header is not null").select("header").distinct().orderBy("header").limit(MOST_GRAMMARS + 1).collect()]
    if not grammars or len(grammars) > MOST_GRAMMARS:
        raise ValueError(f"{path} has no log with a header" if not grammars else f"more than {MOST_GRAMMARS} different headers")
    body = whole.select("path", "header", F.posexplode(F.filter("lines", lambda x: ~x.rlike("^\\s*([#%]|$)"))).alias("it", "line"))
    body = body if iterations is None else body.where(F.col("it") < iterations)
    return functools.reduce(DataFrame.unionByName, [parse_lines(body.where(F.col("header") == h).drop("header"), h) for h in grammars])


def extract(spec: str, columns: dict[str, str]) -> Column:
    """A measure's text: ``name``, ``{list}`` (its length, then its items), ``{dict[key]}``, else ``_name``, else None. columns: name and Spark type."""
    found = re.fullmatch(r"\{(\w+)(?:\[(\w+)\])?\}|(\w+)", spec)
    if not found:
        return F.lit("None")
    name = found[1] or found[3]
    name = name if name in columns else f"_{name}"
    if name not in columns:
        return F.lit("None")
    c = F.col(name)
    if not found[1]:
        text = c.cast("string")
    elif found[2]:
        text = F.array_join(F.transform(F.map_values(c), lambda m: m[found[2]].cast("string")), " ")
    else:
        text = F.concat_ws(" ", F.size(c).cast("string"), F.array_join(F.transform(c, lambda x: x.cast("string")), " "))
    return F.coalesce(text, F.lit("None"))


#: Measures by name: aggregates that a run's log evaluates.
MEASURES: dict[str, Callable[..., Column]] = {}


def measure(name: str):
    def add(f: Callable[..., Column]) -> Callable[..., Column]:
        MEASURES[name] = f
        return f

    return add


@measure("mean")
def _mean(column: str = "value") -> Column:
    return F.avg(column)


@measure("entropy")
def _entropy(column: str = "value") -> Column:
    return -F.sum(F.col(column) * F.log(column))


def evaluate(df: DataFrame, keys: list[str], specs: list[str]) -> DataFrame:
    """One row per key with each measure ``name@option=value&...`` evaluated."""
    out = []
    for spec in specs:
        name, _, rest = spec.partition("@")
        options = dict(x.split("=", 1) for x in rest.split("&") if x)
        every = {k: v for k, v in options.items() if k != "_freq"}
        out.append(MEASURES[name](**every).alias(name))
    return df.groupBy(*keys).agg(*out)


def append_log(log: DataFrame, path: str) -> None:
    """Appends rows (_expe_id, it, measure, value), one folder per run."""
    log.write.mode("append").partitionBy("_expe_id").parquet(path)


def write_text_log(log: DataFrame, path: str, measures: list[str], run: str = "_expe_id", step: str = "it") -> None:
    """Text logs, a folder per run: a header, a row per iteration, and the closing comment."""
    rows = log.groupBy(run, step).pivot("measure", measures).agg(F.first("value"))
    body = rows.select(F.col(run), F.lit(1).alias("part"), F.col(step).alias("k"), F.concat_ws(" ", *[F.coalesce(F.col(f"`{m}`").cast("string"), F.lit("None")) for m in measures]).alias("value"))
    ends = rows.select(run).distinct()
    head = ends.select(F.col(run), F.lit(0).alias("part"), F.lit(0).alias("k"), F.lit("#" + " ".join(measures)).alias("value"))
    tail = ends.select(F.col(run), F.lit(2).alias("part"), F.lit(0).alias("k"), F.lit("# terminated").alias("value"))
    every = head.union(body).union(tail).repartition(parts(log.sparkSession), run).sortWithinPartitions(run, "part", "k")
    every.select(run, "value").write.mode("overwrite").partitionBy(run).text(path)


def failures(spark: SparkSession, rows: list[tuple[str, int, str, str]], path: str) -> None:
    """Appends failed runs (action, expe_id, path, trace) with their time."""
    spark.createDataFrame(rows, "action string, expe_id long, path string, trace string").withColumn("ts", F.current_timestamp()).write.mode("append").parquet(path)
