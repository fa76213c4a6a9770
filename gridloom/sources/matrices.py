"""Sparse matrices as coordinate files, a corpus as a matrix with its terms beside it, and the freshest of several stored forms."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First in order of name, so that a folder's files end to end are one valid file.
HEADER = "00-header.mtx"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_matrix(cells: DataFrame, path: str, rows: int, cols: int, kind: str = "integer") -> None:
    """Stores (row, col, value), from 0, as coordinate files: a header file and as many parts of lines ``row col value``, from 1, as there are partitions."""
    spark = cells.sparkSession
    line = F.concat_ws(" ", (F.col("row") + 1).cast("string"), (F.col("col") + 1).cast("string"), F.col("value").cast("string"))
    cells.select(line.alias("value")).write.mode("overwrite").text(path)
    n = spark.read.text(path).count()
    _, where, fs = _path(spark, f"{path}/{HEADER}")
    out = fs.create(where, True)
    out.write(bytearray(f"%%MatrixMarket matrix coordinate {kind} general\n{rows} {cols} {n}\n".encode()))
    out.close()


def header(spark: SparkSession, path: str) -> tuple[str, str]:
    """The banner and the size line: the first line, and the first that is no comment. Compressed files are read through their codec."""
    jvm, where, fs = _path(spark, path)
    if fs.getFileStatus(where).isDirectory():
        jvm, where, fs = _path(spark, f"{path}/{HEADER}")
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(where)
    stream = fs.open(where)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec is not None else stream, "UTF-8"))
    try:
        banner = line = reader.readLine()
        while line is not None and (line.startswith("%") or not line.strip()):
            line = reader.readLine()
    finally:
        reader.close()
    if line is None or not re.match(r"%%MatrixMarket\s+matrix\s+coordinate\s+(integer|real|pattern)\s+(general|symmetric)\s*$", banner, re.I):
        raise ValueError(f"{path} is no coordinate matrix")
    return banner.lower(), line.strip()


def read_matrix(spark: SparkSession, path: str) -> tuple[DataFrame, tuple[int, int, int]]:
    """Cells (row, col, value), from 0, of a file or folder, and (rows, cols, entries) of its header. A large file is read in byte ranges by many tasks.

    A range does not know whether it holds the size line. That line is known by its text; the one cell that may look the same is there if the text occurs twice. Of a symmetric matrix both triangles
    come. A pattern's value is 1.
    """
    banner, size = header(spark, path)
    rows, cols, n = (int(x) for x in size.split())
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '%')")
    f = F.split("line", r"\s+")
    kind = "long" if "integer" in banner else "double"
    value = F.lit(1).cast("long") if "pattern" in banner else f[2].cast(kind)
    cell = (f[0].cast("long") - 1, f[1].cast("long") - 1, value)
    names = ("row", "col", "value")
    body = lines.where(F.col("line") != size).select(*[c.alias(x) for c, x in zip(cell, names, strict=True)])
    twice = lines.where(F.col("line") == size).groupBy("line").agg(F.count("*").alias("n")).where("n > 1").select(*[c.alias(x) for c, x in zip(cell, names, strict=True)])
    cells = body.unionByName(twice)
    if "symmetric" in banner:
        cells = cells.unionByName(cells.where("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return cells, (rows, cols, n)


def write_corpus(bag: DataFrame, terms: DataFrame, path: str) -> None:
    """Stores a bag of words (doc_id, term_id, cnt) as a matrix and terms (term_id, term; ids 0, 1, ...) as lines in order of id."""
    size = bag.agg(F.max("doc_id").alias("d")).first()["d"]
    write_matrix(bag.select(F.col("doc_id").alias("row"), F.col("term_id").alias("col"), F.col("cnt").alias("value")), f"{path}/matrix", (size if size is not None else -1) + 1, terms.count())
    terms.orderBy("term_id").select("term").write.mode("overwrite").text(f"{path}/terms")


def read_corpus(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, term_id, cnt) and (term_id, term) of a stored corpus."""
    from .tables import read_vocabulary

    cells, _ = read_matrix(spark, f"{path}/matrix")
    return cells.toDF("doc_id", "term_id", "cnt"), read_vocabulary(spark, f"{path}/terms")


def freshest(spark: SparkSession, base: str, endings: tuple[str, ...] = (".parquet", ".mtx.gz", ".mtx", "")) -> str | None:
    """Of the stored forms base + ending the one written last, of equally old ones the first named; None if there is none."""
    found = []
    for i, ending in enumerate(endings):
        _, where, fs = _path(spark, base + ending)
        if fs.exists(where):
            found.append((-fs.getFileStatus(where).getModificationTime(), i, base + ending))
    return min(found)[2] if found else None
