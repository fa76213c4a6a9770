"""Live measure logs, edge streams and index writers as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.graphs import EDGES, PARTS, dat_lines, dat_parts, settled

LOG = "run long, it long, measure string, value double"


def edge_stream(spark: SparkSession, path: str, form: str = "tnet", files_per_batch: int = 1) -> DataFrame:
    """(src, dst, w) of text files as they come, without edges of weight zero: tnet (2 or 5 fields), csv (; and a header), attributed (i;j lines) or dat (2 or 3 fields of the edge section).

    Lines stand for themselves but in dat files, where a section gives them their meaning: their rows are those of ``graphs.PARTS``, which ``edge_weights`` settles batch by batch, for a batch has whole files.
    """
    source = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if form == "dat":
        return dat_lines(source.text(path)).mapInArrow(dat_parts, PARTS)
    raw, line = source.text(path), F.trim(F.col("value"))
    if form in ("csv", "attributed"):
        f = F.split(line, ";")
        raw = raw.where(line.rlike(r"^\d+;\d+(;|$)" if form == "csv" else r"^\d+;\d+$"))
        weight = F.lit(1)
    elif form == "tnet":
        plain = F.regexp_replace(line, '"[^"]*" ', "")
        f = F.split(plain, r"\s+")
        raw = raw.where(plain.rlike(r"^\d+\s+\d+(\s+\d+)?$"))
        weight = F.coalesce(F.get(f, F.lit(2)).cast("long"), F.lit(1))
    else:
        raise ValueError(f"no edge stream of {form} files")
    return raw.select(f[0].cast("long").alias("src"), f[1].cast("long").alias("dst"), weight.cast("long").alias("w")).where("w <> 0")


def vertex_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """(id, features, cluster) of the vertex lines ``id;f1|f2;cluster`` of attributed files as they come."""
    f = F.split(F.trim(F.col("value")), ";")
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path).where(F.col("value").rlike(r"^\s*\d+;[^;]*;\s*\d+\s*$"))
    return rows.select(f[0].cast("long").alias("id"), F.split(f[1], r"\|").cast("array<double>").alias("features"), f[2].cast("int").alias("cluster"))


def log_stream(spark: SparkSession, path: str, schema: str = LOG, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def append_logs(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch, once even if a batch is tried again: its files lie under the batch's number, with rows in order of run, so a run's rows are found by the files' ranges."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).sort("run", "measure", "it").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_weights(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Sums of an edge stream: each batch adds a folder with its own sums (once, if a batch is tried again), and nothing is written anew. ``edge_table`` reads them."""

    def write(batch: DataFrame, number: int) -> None:
        edges = settled(batch) if "part" in batch.columns else batch
        summed = edges.groupBy("src", "dst").agg(F.sum("w").alias("w")).withColumn("batch", F.lit(number))
        summed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_table(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, w) of all batches that ``edge_weights`` has written by now."""
    return spark.read.schema(f"{EDGES}, batch int").parquet(path).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def _delta_state(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    before = state.get[0] if state.exists else 0.0
    parts = [f for f in frames if len(f)]
    if not parts:
        return
    rows = pd.concat(parts).sort_values(["it"], kind="stable")
    change = rows["value"].diff()
    change.iloc[0] = rows["value"].iloc[0] - before
    state.update((float(rows["value"].iloc[-1]),))
    yield pd.DataFrame({"run": key[0], "measure": key[1], "it": rows["it"], "value": rows["value"], "delta": change})


def measure_deltas(stream: DataFrame, every: int = 1) -> DataFrame:
    """(run, measure, it, value, delta) with the value before kept as state per run and measure. Iterations must reach a run in order."""
    gated = stream.where(F.pmod("it", F.lit(every)) == 0)
    return gated.groupBy("run", "measure").applyInPandasWithState(_delta_state, "run long, measure string, it long, value double, delta double", "before double", "append", "NoTimeout")


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events by type and window, closed when the watermark has passed."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))


def minibatch_stream(ticks: DataFrame, edges: DataFrame, n_nodes: int, seed: int = 0) -> DataFrame:
    """Each tick draws a node and a set of it: its out-links, or as many draws of nodes it has no link to (w 0). A stream joined with a table."""
    from ..operators.graph import drawn_int

    tick = F.col("value")
    drawn = ticks.withColumns({"src": drawn_int(tick, "node", seed=seed) % n_nodes, "links": drawn_int(tick, "set", seed=seed) % 2 == 0})
    met = drawn.join(edges, "src")
    some = met.where("links").select("value", "src", "dst", "w")
    other = met.where("not links").select("value", "src", (drawn_int(tick, F.col("dst"), seed=seed) % n_nodes).alias("dst"))
    return some.union(other.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").where("src <> dst").select("value", "src", "dst", F.lit(0).cast("long").alias("w")))


def minibatches_to(ticks: DataFrame, edges: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Stratified minibatches (headers, links in both directions, non-links by their prior) of a stream of numbers (column value), written as they come; options are those of ``graph.minibatches``."""
    from ..operators.graph import minibatches

    def write(batch: DataFrame, number: int) -> None:
        made = minibatches(edges, batch.select(F.col("value").alias("batch")), **options)
        made.withColumn("micro_batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("micro_batch").parquet(path)

    return ticks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_writer(docs: DataFrame, fields: list[str], path: str, checkpoint: str, merge: bool = True) -> StreamingQuery:
    """Adds documents to a search index, a segment for each batch (once, if a batch is tried again), and merges segments when enough of a size have come."""
    from ..operators import segments

    def write(batch: DataFrame, number: int) -> None:
        segments.add(batch, fields, path, batch=(checkpoint, number))
        if merge:
            segments.merge(batch.sparkSession, path)

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(query: StreamingQuery) -> None:
    """Waits until a query has read all that is there, and raises what ended it."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
