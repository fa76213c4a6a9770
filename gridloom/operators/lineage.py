"""Cutting lineage in loops, and row numbers without a single task."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; a temporary one only where none is set and all runs in one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gridloom-"))
    return sc.getCheckpointDir()


def parts(spark: SparkSession) -> int:
    """Partitions for rows that are few beside the work or the files that each of them makes, which adaptive execution would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


_written: dict[int, tuple[DataFrame, str]] = {}


def cut(df: DataFrame) -> DataFrame:
    """df with its rows written to the shared folder, so that later reads depend neither on what made them nor on its size estimates, which multiply from join to join.

    ``forget`` drops a table that a loop has replaced; the rest goes when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    if any(t == "void" for _, t in df.dtypes):  # Parquet has no such type
        return df.checkpoint()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = out, path
    return out


@atexit.register
def _forget_all() -> None:
    for df, _ in list(_written.values()):
        with contextlib.suppress(Exception):  # the session may have ended before
            forget(df)


def forget(*tables: DataFrame) -> None:
    """Removes what ``cut`` has written for these tables; nothing may read them, or what was made of them, any more."""
    for df in tables:
        _, path = _written.pop(id(df), (None, None))
        sc = df.sparkSession.sparkContext
        if path is not None and sc._jsc is not None:
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def numbered(df: DataFrame, name: str, *order: Column, start: int = 0) -> DataFrame:
    """df with consecutive row numbers in the order given: a range partitioning, counts of partitions, and an offset for each.

    Equal order keys are numbered in any order, so keys should be unique.
    """
    placed = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()))
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # One row per partition: small, but summed in one task as any running total of partitions is.
    before = counts.select("__part", F.expr("sum(__n) over (order by __part rows between unbounded preceding and 1 preceding)").alias("__before"))
    joined = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    return joined.withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + start).drop("__id", "__part", "__before")


def running_sum(df: DataFrame, name: str, value: Column, *order: Column) -> DataFrame:
    """df with the sum of a whole-number column over all rows up to each one, itself included, in an order without ties; no task sees more than its range."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)

    def cumulated(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        total, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            sums = np.cumsum(batch["__v"].to_numpy(zero_copy_only=False)) + total
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(sums, pa.int64()), pa.array(np.full(len(sums), part, np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "__sum", "__part"])

    placed = df.withColumn("__v", value.cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(placed.mapInArrow(cumulated, f"{kinds}, __v long, __sum long, __part int"))
    before = placed.groupBy("__part").agg(F.sum("__v").alias("__n")).select("__part", F.expr("sum(__n) over (order by __part rows between unbounded preceding and 1 preceding)").alias("__before"))
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.coalesce("__before", F.lit(0)) + F.col("__sum")).drop("__v", "__sum", "__part", "__before")


def first_rows(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The n rows that come first in an order without ties, however large n is: no task holds them all."""
    return numbered(df, "__rank", *order).where(F.col("__rank") < n).drop("__rank")
