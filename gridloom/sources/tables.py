"""Tables by extension, cached objects, existence tests, result trees, settings, and text corpora."""

from __future__ import annotations

import configparser
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """csv, json, parquet, orc, text and svmlight by extension; npy and npz arrays by way of the driver, for small files."""
    kind = path.rstrip("/").removesuffix(".gz").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return spark.read.csv(path, **({"header": True} | options))
    if kind in ("npy", "npz"):
        import numpy as np

        loaded = np.load(path, allow_pickle=False)
        array = loaded[loaded.files[0]] if kind == "npz" else loaded
        i, j = array.nonzero()
        return spark.createDataFrame(list(zip(i.tolist(), j.tolist(), array[i, j].tolist(), strict=True)), "i long, j long, value double")
    known = {"json": spark.read.json, "parquet": spark.read.parquet, "orc": spark.read.orc}
    if kind in known:
        return known[kind](path, **options)
    if kind in ("svm", "svmlight", "libsvm"):
        return spark.read.format("libsvm").load(path)
    return spark.read.text(path, **options)


def save(df: DataFrame, path: str, kind: str = "parquet", compression: str = "gzip") -> None:
    df.write.mode("overwrite").format(kind).option("compression", compression).save(path)


def cached(spark: SparkSession, path: str, make, force: bool = False) -> DataFrame:
    """What is stored at path, made and stored first if it is missing or force is set."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if force or not fs.exists(fs.makeQualified(fs_path).suffix("/_SUCCESS")):
        save(make(), path)
    return spark.read.parquet(path)


def outputs(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, empty): files below root; empty ones have no bytes or one comment line only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.trim(F.decode(F.substring("content", 1, 4096), "UTF-8"))
    comment = text.rlike(r"^[#%][^\n]*$")
    return files.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), ((F.col("length") == 0) | comment).alias("empty"))


def result_tree(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """(keys..., path, measure, value): JSON measures of each file, with the last path segments before it as properties; precision and recall also give f1."""
    from ..operators.stats import f1

    files = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,double>").alias("m"))
    parts = F.split("path", "/")
    named = files.select("path", "m", *[F.element_at(parts, -len(keys) - 1 + i).alias(k) for i, k in enumerate(keys)])
    p, r = F.element_at("m", F.lit("Precision")), F.coalesce(F.element_at("m", F.lit("Recall")), F.element_at("m", F.lit("Rappel")))
    full = F.when(p.isNotNull() & r.isNotNull(), F.map_concat("m", F.create_map(F.lit("f1"), f1(p, r)))).otherwise(F.col("m"))
    return named.select(*keys, "path", F.explode(full).alias("measure", "value"))


def dimension_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.agg(*[F.countDistinct(k).alias(k) for k in keys])


def slice_cube(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Cells of position columns ``key_pos``: ``*`` all, ``a:b`` a range, a number one position; other text a value of the key."""
    for key, what in wanted.items():
        text = str(what)
        if text == "*":
            continue
        if ":" in text:
            a, b = text.split(":")
            df = df.where((F.col(f"{key}_pos") >= int(a or 0)) & (F.col(f"{key}_pos") < (int(b) if b else 2**31)))
        elif isinstance(what, int):
            df = df.where(F.col(f"{key}_pos") == what)
        else:
            df = df.where(F.col(key).cast("string") == text)
    return df


def lines_of(spark: SparkSession, path: str, across: bool = False) -> DataFrame:
    """(file, line_no, line): lines numbered from 0 in their file; with ``across`` through all files in order of name, as parts of one text. Large files are read in blocks by many tasks."""
    from ..operators.lineage import numbered

    raw = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("at", F.monotonically_increasing_id())
    placed = numbered(raw, "n", F.col("file"), F.col("block"), F.col("at"))
    if across:
        return placed.select("file", F.col("n").alias("line_no"), "line")
    first = placed.groupBy("file").agg(F.min("n").alias("first"))
    return placed.join(first, "file").select("file", (F.col("n") - F.col("first")).alias("line_no"), "line")


def tail(spark: SparkSession, path: str, n: int, across: bool = False) -> DataFrame:
    """The last n lines of a file, or of a text in several files, in order."""
    return lines_of(spark, path, across).select("line_no", "line").orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def settings(path: str) -> dict[str, str]:
    """section.key and value of an ini file, with ~ and variables expanded in values."""
    parser = configparser.ConfigParser(interpolation=None)
    with open(path) as f:
        parser.read_file(f)
    return {f"{s}.{k}": os.path.expandvars(os.path.expanduser(v)) for s in parser.sections() for k, v in parser[s].items()}


def read_triplets(spark: SparkSession, path: str, header: int = 3, bodies: bool = False) -> DataFrame:
    """(doc_id, term_id, cnt) from lines ``doc term count`` (from 1) after ``header`` lines of each file; ids from 0.

    With ``bodies`` a header may begin anew inside a file (files laid end to end): lines that are not three numbers are passed over instead.
    """
    f = F.split(F.trim("line"), r"\s+")
    if bodies:
        rows = spark.read.text(path).withColumnRenamed("value", "line").where(F.size(f) == 3)
        return rows.select((f[0].cast("long") - 1).alias("doc_id"), (f[1].cast("long") - 1).alias("term_id"), f[2].cast("int").alias("cnt"))
    return lines_of(spark, path).where((F.col("line_no") >= header) & (F.trim("line") != "")).select((f[0].cast("long") - 1).alias("doc_id"), (f[1].cast("long") - 1).alias("term_id"), f[2].cast("int").alias("cnt"))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term_id, term) from a text of one word to a line, in one file or several in order of name."""
    return lines_of(spark, path, across=True).select(F.col("line_no").alias("term_id"), F.trim("line").alias("term"))


def read_corpus(spark: SparkSession, paths: list[str], vocabulary: str | None = None) -> DataFrame:
    """One file: (doc_id, term_id, cnt) and, with a vocabulary file, term. Several: (path, pos, term), the tokens of each file."""
    from ..operators.text import tokens_of

    if len(paths) == 1:
        rows = read_triplets(spark, paths[0])
        return rows if vocabulary is None else rows.join(read_vocabulary(spark, vocabulary), "term_id", "left")
    return read_texts(spark, paths).select("path", F.posexplode(tokens_of(F.col("text"))).alias("pos", "term"))


def read_texts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text), a document per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


#: The catalogue of known corpora: fixed values (name, type, source, directed, nodes, edges, density, weighted), None where unknown.
CORPORA = (
    ("clique", "network", "random", False, None, None, None, None),
    ("generator", "network", "random", False, 1000, None, None, None),
    ("graph", "network", "random", None, None, None, None, None),
    ("alternate", "network", "random", False, None, None, None, None),
    ("BA", "network", "random", None, None, None, None, None),
    ("manufacturing", "network", "web", True, 167, 5784, 0.209, True),
    ("fb_uc", "network", "web", True, 1899, 22195, 0.006, True),
    ("blogs", "network", "web", True, 1490, 19025, 0.009, False),
    ("emaileu", "network", "web", True, 1005, 25571, 0.025, False),
    ("propro", "network", "web", False, 2113, 1432, 0.001, False),
    ("euroroad", "network", "web", True, 1177, 1432, 0.001, False),
    ("astro-ph", "network", "gt", False, 16706, 121251, None, True),
    ("cond-mat", "network", "gt", False, 16726, 47594, None, True),
    ("hep-th", "network", "gt", False, 8361, 15751, None, True),
    ("netscience", "network", "gt", False, 1589, 2742, None, True),
    ("email-Enron", "network", "gt", False, 36692, 367662, None, False),
)
CORPUS_SCHEMA = "name string, data_type string, data_source string, directed boolean, nodes long, edges long, density double, weighted boolean"


def corpora(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CORPORA)], "position long, " + CORPUS_SCHEMA)


def find_corpora(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of each requested name the first catalogue row whose name begins it; the catalogue is a fixed small table."""
    hit = wanted.join(F.broadcast(catalogue), F.col("wanted").startswith(F.col("name")), "left")
    rest = [c for c in catalogue.columns if c != "position"]
    return hit.groupBy("wanted").agg(F.min_by(F.struct(*rest), "position").alias("c")).select("wanted", "c.*")
