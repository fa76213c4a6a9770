"""A stored table of logs of Stirling numbers of the first kind, made block by block, and its look-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a block.
BLOCK = 256
SCHEMA = "n long, logs array<double>, block int"


def _block(spark: SparkSession, last: DataFrame, first: int, stop: int) -> DataFrame:
    """(n, logs) for first <= n < stop from the row of first - 1: s(n + 1, m) = s(n, m - 1) + n s(n, m)."""
    step = """transform(sequence(1, size(acc.row) + 1), m ->
        case when m = 1 then ln(cast(k as double)) + acc.row[0]
             when m = size(acc.row) + 1 then acc.row[m - 2]
             else greatest(acc.row[m - 2], ln(cast(k as double)) + acc.row[m - 1]) + log1p(exp(-abs(acc.row[m - 2] - ln(cast(k as double)) - acc.row[m - 1]))) end)"""
    fold = f"""aggregate(sequence({first - 1}L, {stop - 2}L), named_struct('row', logs, 'rows', cast(array() as array<array<double>>)),
        (acc, k) -> transform(array({step}), r -> named_struct('row', r, 'rows', concat(acc.rows, array(r))))[0], acc -> acc.rows)"""
    return last.select(F.posexplode(F.expr(fold)).alias("i", "logs")).select((F.col("i") + first).cast("long").alias("n"), "logs")


def stored(spark: SparkSession, path: str, n: int, block: int = BLOCK) -> DataFrame:
    """(n, logs, block) for 1 .. n at least, logs[m - 1] being that of s(n, m). Blocks that are stored are read, not made again; a run that was stopped goes on after the last whole one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    whole = 0
    while whole * block < n:
        where = f"{path}/block={whole}"
        done = jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
        if not done.getFileSystem(conf).exists(done):
            first, stop = whole * block + 1, (whole + 1) * block + 1
            if whole:
                last = spark.read.schema("n long, logs array<double>").parquet(f"{path}/block={whole - 1}").where(F.col("n") == first - 1)
                rows = _block(spark, last, first, stop)
            else:
                one = spark.range(1).select(F.lit(1).cast("long").alias("n"), F.array(F.lit(0.0)).alias("logs"))
                rows = one if block == 1 else one.unionByName(_block(spark, one, 2, stop))
            rows.coalesce(1).write.mode("overwrite").parquet(where)
        whole += 1
    return spark.read.schema(SCHEMA).parquet(path)


def looked_up(rows: DataFrame, table: DataFrame, n: str, m: str, name: str) -> DataFrame:
    """rows with the log of s(n, m) by their columns n and m: infinity where m is above n or below 1, null where n or m is null or n is not in the table."""
    logs = table.select(F.col("n").alias("__n"), F.col("logs").alias("__logs"))
    value: Column = F.when((F.col(m) > F.col(n)) | (F.col(m) < 1), F.lit(float("inf"))).otherwise(F.get("__logs", (F.col(m) - 1).cast("int")))
    joined = rows.join(logs, rows[n] == logs["__n"], "left")
    return joined.withColumn(name, F.when(F.col("__n").isNotNull(), value)).drop("__n", "__logs")
