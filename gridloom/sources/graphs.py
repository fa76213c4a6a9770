"""Graph files as edge and vertex tables. Lines are parsed with column expressions; where sections give lines their meaning, each block of a file is read on its own and told what the blocks before it end in."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EDGES = "src long, dst long, w long"


def _fields(lines: DataFrame, sep: str) -> DataFrame:
    return lines.select(F.split(F.trim("value"), re.escape(sep)).alias("f")).where("size(f) > 1")


def _number(field: Column) -> Column:
    return F.regexp_replace(field, '"', "").try_cast("long")


def shifted(edges: DataFrame) -> DataFrame:
    """Ids moved so that the smallest is 0."""
    low = edges.agg(F.least(F.min("src"), F.min("dst")).alias("low"))
    return edges.crossJoin(F.broadcast(low)).select((F.col("src") - F.col("low")).alias("src"), (F.col("dst") - F.col("low")).alias("dst"), "w")


def read_tnet(spark: SparkSession, path: str, sep: str = " ", shift: bool = True) -> DataFrame:
    """``i j`` lines counted, or quoted-date lines of five fields whose last three are i, j and a weight summed."""
    rows = _fields(spark.read.text(path), sep)
    five = F.size("f") >= 5
    at = lambda two, many: F.when(five, _number(F.get("f", F.lit(many)))).otherwise(_number(F.get("f", F.lit(two))))
    edges = rows.select(at(0, 2).alias("src"), at(1, 3).alias("dst"), F.when(five, _number(F.get("f", F.lit(4)))).otherwise(F.lit(1)).alias("w")).where("src is not null and dst is not null")
    summed = edges.groupBy("src", "dst").agg(F.sum("w").cast("long").alias("w"))
    return shifted(summed) if shift else summed


def read_csv(spark: SparkSession, path: str, sep: str = ";", shift: bool = True) -> DataFrame:
    """One header line, then edges in the first two fields, counted."""
    rows = spark.read.csv(path, sep=sep, header=True, inferSchema=False, enforceSchema=False)
    a, b = rows.columns[:2]
    edges = rows.select(_number(F.col(f"`{a}`")).alias("src"), _number(F.col(f"`{b}`")).alias("dst")).where("src is not null and dst is not null").groupBy("src", "dst").agg(F.count("*").alias("w"))
    return shifted(edges) if shift else edges


def read_attributed(spark: SparkSession, path: str, sep: str = ";", mirror: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, vertices) of a file with vertex lines ``id;f1|f2;cluster`` and edge lines ``i;j``; # and % begin comments."""
    rows = _fields(spark.read.text(path).where("not ltrim(value) rlike '^[#%]'"), sep)
    vertices = rows.where("size(f) >= 3").select(_number(F.col("f")[0]).alias("id"), F.split(F.col("f")[1], r"\|").cast("array<double>").alias("features"), _number(F.col("f")[2]).cast("int").alias("cluster"))
    edges = rows.where("size(f) = 2").select(_number(F.col("f")[0]).alias("src"), _number(F.col("f")[1]).alias("dst"), F.lit(1).cast("long").alias("w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    if mirror:
        edges = edges.union(edges.select("dst", "src", "w")).distinct()
    return edges, vertices


#: Rows of dat files before they are settled: edges, with true in ``inside`` where they stand in an edge section, else (null) with the number of the part of a file that begins without a section; and of each part one row without
#: edge, in which section it ends.
PARTS = f"{EDGES}, inside boolean, part long, file string, block long"


def _dat_lines(text: str, inside: bool | None, zeros: bool, edges: bool) -> Iterator[tuple[bool | None, tuple[int, int, int] | None]]:
    """Of the lines that begin a section whether it is one of edges, and of those that may be an edge, the edge; a row of two numbers has weight 1."""
    for line in text.splitlines():
        word = line.strip().lower()
        if word.startswith(("data", "*edges", "*arcs")):
            inside = True
            yield inside, None
        elif word.startswith(("row labels", "*vertices")):
            inside = False
            yield inside, None
        elif edges and inside is not False:
            parts = line.split()
            try:
                numbers = [int(float(x)) for x in parts[:3]]
            except (ValueError, OverflowError):
                continue
            if len(numbers) >= 2 and (len(numbers) == 2 or numbers[2] > 0 or zeros):
                yield inside, (numbers[0], numbers[1], numbers[2] if len(numbers) > 2 else 1)


def dat_parts(batches: Iterator[pa.RecordBatch], zeros: bool = False, edges: bool = True) -> Iterator[pa.RecordBatch]:
    """Lines (value, file, block) to rows of ``PARTS``, or without ``edges`` to the parts' ends alone. The lines of a part, which one task reads, follow each other; they go as soon as they are read."""
    from pyspark import TaskContext

    number, now, inside = TaskContext.get().partitionId() << 33, None, None
    names = [c.split()[0] for c in PARTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.int64()]
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    for batch in batches:
        rows = []
        for text, *place in zip(*(batch[c].to_pylist() for c in ("value", "file", "block")), strict=True):
            if place != now:
                if now is not None:
                    rows.append((None, None, None, inside, number, *now))
                number, now, inside = number + 1, place, None
            for inside, edge in _dat_lines(text, inside, zeros, edges):
                if edge is not None:
                    rows.append((*edge, inside, None if inside else number, None, None))
        if rows:
            yield packed(rows)
    if now is not None:
        yield packed([(None, None, None, inside, number, *now)])


def dat_lines(lines: DataFrame) -> DataFrame:
    """(value, file, block) of text files, streamed or not."""
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def settled(parts: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """Edges (src, dst, w) of rows of ``PARTS``: a part that begins without a section is in the one that the last part of its file with a section ends in."""
    ends = (parts if ends is None else ends).where("src is null").select("part", "file", "block", "inside")
    before = ends.select("part", F.expr("last(inside, true) over (partition by file order by block rows between unbounded preceding and 1 preceding)").alias("before")).where("before")
    found = parts.where("src is not null").join(F.broadcast(before), "part", "left")  # a row for each split of a file at most
    return found.where(F.coalesce("inside", "before")).select("src", "dst", "w")


def read_dat(spark: SparkSession, path: str, zeros: bool = False) -> DataFrame:
    """Files of a label section and an edge section. Large files are read in blocks by many tasks."""
    lines = dat_lines(spark.read.text(path))
    parts, ends = (lines.mapInArrow(functools.partial(dat_parts, zeros=zeros, edges=edges), PARTS) for edges in (True, False))
    return settled(parts, ends).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def assemble(edges: DataFrame, vertices: DataFrame | None = None, expected: tuple[int, int] | None = None):
    """Weights of repeated edges summed, vertices completed from edge ends, empty label and cluster columns dropped, vertex 0 dropped if no edge has it.

    Returns edges, vertices, and whether the counts are as the catalogue says (None without an expectation).
    """
    from ..operators.graph import nodes, weighted

    edges = weighted(edges)
    ends = nodes(edges)
    full = ends if vertices is None else ends.join(vertices, "id", "full_outer")
    for name, empty in (("label", F.col("label") == ""), ("cluster", F.col("cluster") == 0)) if vertices is not None else ():
        if name in full.columns and full.where(~F.coalesce(empty, F.lit(True))).isEmpty():
            full = full.drop(name)
    full = full.join(ends.select("id", F.lit(True).alias("used")), "id", "left").where("id <> 0 or used").drop("used")
    check = None if expected is None else (full.count(), edges.count()) == expected
    return edges, full, check


#: Copies that are followed at most; half of all ends are sources, where a chain ends.
CHAIN = 64


#: Generated corpora: a predicate over node pairs (i, j).
def generated(spark: SparkSession, kind: str, n: int, block: int = 5, seed: int = 0) -> DataFrame:
    """``uniform`` 0/1 cells, ``clique`` blocks, ``alternate`` stripes, or ``ba``: preferential attachment, each node with two links to earlier ones.

    The ends of all ba edges stand in one row, source and target in turn. A target is a copy of an end before it, drawn evenly, so nodes are met in proportion to their
    degree; where that is a target itself, its own copy is followed by drawing it anew. Each edge is found alone, without a join or a loop over the graph.
    """
    if kind == "ba":
        from ..operators.graph import drawn_int

        ends = spark.range(2 * n).select("id", (2 * F.col("id") + 1).alias("at"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(CHAIN)), F.col("at"), lambda at, _: F.when(at % 2 == 0, at).otherwise(drawn_int(at, seed=seed) % at))
        edges = ends.select(F.floor(F.col("id") / 2).alias("src"), F.floor(found / 4).alias("dst"), F.lit(1).cast("long").alias("w"))
        return edges.where("src <> dst").distinct()
    i, j = F.floor(F.col("id") / n), F.col("id") % n
    cells = spark.range(n * n).select(i.alias("src"), j.alias("dst"), "id")
    keep = {
        "uniform": F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(2)) == 0,
        "clique": F.floor(F.col("src") / block) == F.floor(F.col("dst") / block),
        "alternate": F.pmod(F.col("src") + F.col("dst"), F.lit(2)) == 0,
    }[kind]
    return cells.where(keep).select("src", "dst", F.lit(1).cast("long").alias("w"))


#: Readers by format; more can be added by name.
READERS = {"tnet": read_tnet, "csv": read_csv, "attributed": read_attributed, "dat": read_dat}
GENERATORS = ("uniform", "clique", "alternate", "ba")
#: First letters of corpus names and their format.
PREFIXES: dict[str, str] = {}


def register_reader(name: str, prefix: str | None = None):
    def add(f):
        READERS[name] = f
        if prefix:
            PREFIXES[prefix] = name
        return f

    return add


def load(spark: SparkSession, name: str, path: str | None = None, n: int = 100, **options):
    """A generated corpus by its name, else a file by the registered prefix of its name or by its extension."""
    for kind in GENERATORS:
        if name.startswith(kind):
            return generated(spark, kind, n, **options)
    if path is None:
        raise ValueError(f"no generator and no file for {name}")
    for prefix, kind in PREFIXES.items():
        if name.startswith(prefix):
            return READERS[kind](spark, path, **options)
    ending = path.rsplit(".", 1)[-1]
    return READERS[{"csv": "csv", "dat": "dat", "graph": "attributed"}.get(ending, "tnet")](spark, path, **options)
