"""A search index in segments: each addition is a folder of its own, deletions are tombstones, and a manifest says what counts.

A segment's postings (lists of entries, in folders by hash of term), lengths and vocabulary with its document frequencies are in ``path/<part>/segment=<name>``; ``path/tombstones/<name>`` the ids that
are deleted from all segments before it, and how much they take from each segment's frequencies; ``path/manifest/<number>.json`` lists both. Nothing is ever changed in place: a new manifest is written
beside the old ones, under a number that only one writer can take. So an addition costs its own documents, a reader keeps what it has opened, and of two writers
the later one starts again from the other's manifest. ``merge`` writes many small segments anew as one; ``vacuum`` removes folders that recent manifests no longer list.
"""

from __future__ import annotations

import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import begin_of, gathered_again, without

#: Segments of about one size that merge at a time; a size class spans this factor.
FAN_IN = 8
#: Deleted documents up to which a merge holds their ids in each task; more are taken out by a join.
HELD = 1_000_000
#: Times that a writer starts again from a manifest that another one has written meanwhile.
ATTEMPTS = 20
#: What an index without documents has.
PARTS = ("postings", "lengths", "vocabulary")
EMPTY = ("doc_id long, field string, term string, tf long, positions array<int>, bucket int", "doc_id long, field string, len long", "field string, term string, df long")


def _name() -> str:
    return f"s{uuid.uuid4().hex}"  # a letter first, so that no name reads as a number


class Conflict(RuntimeError):
    """Another writer took the next number."""


@dataclass(frozen=True)
class Segment:
    name: str
    order: int  # tombstones of a higher order apply
    postings: int
    documents: int


@dataclass(frozen=True)
class Tombstone:
    name: str
    order: int


@dataclass(frozen=True)
class Manifest:
    number: int = 0
    next_order: int = 0
    segments: tuple[Segment, ...] = ()
    tombstones: tuple[Tombstone, ...] = ()
    batches: tuple[tuple[str, int], ...] = ()  # of each writer the last batch it has added

    def of(self, segment: Segment) -> tuple[Tombstone, ...]:
        return tuple(t for t in self.tombstones if t.order > segment.order)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, path: str) -> list[int]:
    _, where, fs = _fs(spark, f"{path}/manifest")
    if not fs.exists(where):
        return []
    return sorted(int(m[1]) for s in fs.listStatus(where) if (m := re.fullmatch(r"(\d+)\.json", s.getPath().getName())))


def _read(spark: SparkSession, path: str, number: int) -> Manifest | None:
    """The manifest of a number; None while it is being written."""
    jvm, where, fs = _fs(spark, f"{path}/manifest/{number}.json")
    stream = fs.open(where)
    try:
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        d = json.loads(text)
    except ValueError:
        return None
    return Manifest(d["number"], d["next_order"], tuple(Segment(**s) for s in d["segments"]), tuple(Tombstone(**t) for t in d["tombstones"]), tuple((w, n) for w, n in d["batches"]))


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The newest whole manifest, None where there is no index."""
    return next((m for n in reversed(_numbers(spark, path)) if (m := _read(spark, path, n)) is not None), None)


def _commit(spark: SparkSession, path: str, change: Callable[[Manifest], Manifest]) -> Manifest:
    """Applies change to the newest manifest and writes the result under the next number."""
    from py4j.protocol import Py4JJavaError

    for _ in range(ATTEMPTS):
        numbers = _numbers(spark, path)
        old = _read(spark, path, numbers[-1]) if numbers else Manifest()
        if old is None:  # just being written
            time.sleep(0.2)
            continue
        new = replace(change(old), number=old.number + 1)
        _, where, fs = _fs(spark, f"{path}/manifest/{new.number}.json")
        try:
            out = fs.create(where, False)
        except Py4JJavaError as e:
            if fs.exists(where):
                continue
            raise e
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        return new
    raise Conflict(f"{ATTEMPTS} other writers came first at {path}")


def rows_of(lists: DataFrame) -> DataFrame:
    """A row (doc_id, tf, positions) for each entry of lists, with their other columns; arrays that are not asked for are not read."""
    others = [c for c in lists.columns if c not in ("n", "ids", "ends", "positions")]
    begin, end = begin_of(F.col("k")), F.get("ends", F.col("k"))
    entries = lists.select(*others, "ends", "positions", F.posexplode("ids").alias("k", "doc_id"))
    return entries.select(*others, "doc_id", (end - begin).cast("long").alias("tf"), F.slice("positions", begin + 1, end - begin).alias("positions"))


def _write(lists: DataFrame, lengths: DataFrame, path: str, name: str) -> tuple[int, int]:
    """Stores a segment, whose lists come sorted by bucket, field and term in each partition; how many postings and documents it has."""
    spark = lists.sparkSession
    where = {part: f"{path}/{part}/segment={name}" for part in PARTS}
    lists.write.mode("overwrite").partitionBy("bucket").parquet(where["postings"])
    lengths.write.mode("overwrite").parquet(where["lengths"])
    stored = spark.read.schema(lists.schema).parquet(where["postings"])  # a schema, for without rows there is no file
    frequencies = stored.groupBy("field", "term").agg(F.sum("n").alias("df"))
    frequencies.write.mode("overwrite").parquet(where["vocabulary"])
    postings = spark.read.schema(frequencies.schema).parquet(where["vocabulary"]).agg(F.sum("df")).first()[0] or 0
    return postings, spark.read.schema(lengths.schema).parquet(where["lengths"]).select("doc_id").distinct().count()


def _part(spark: SparkSession, path: str, part: str, names: list[str]) -> DataFrame:
    """Rows of a part of some segments, with the segment's name."""
    return spark.read.option("basePath", f"{path}/{part}").parquet(*[f"{path}/{part}/segment={n}" for n in names])


def add(docs: DataFrame, fields: list[str], path: str, fresh: bool = False, update: bool = False, batch: tuple[str, int] | None = None) -> Manifest:
    """Adds documents (doc_id and fields) as a segment. Documents without a token leave no trace.

    ``fresh`` begins a new index: older segments are no longer listed. ``update`` deletes documents of the same ids first. ``batch`` names a writer and a number that rises with its
    batches: a number that is not above the writer's last one is a batch that is tried again, and adds nothing.
    """
    from .search import lengths, lists

    spark, held = docs.sparkSession, manifest(docs.sparkSession, path)
    if batch and held and not fresh and dict(held.batches).get(batch[0], -1) >= batch[1]:
        return held
    own = _name()
    if update and held and not fresh:
        delete(docs.select("doc_id"), path)
    postings, documents = _write(lists(docs, fields), lengths(docs, fields), path, own)

    def change(old: Manifest) -> Manifest:
        new = (Segment(own, old.next_order, postings, documents),) if postings else ()
        last = dict(old.batches) | ({batch[0]: batch[1]} if batch else {})
        return replace(old, next_order=old.next_order + 1, segments=new if fresh else old.segments + new, tombstones=() if fresh else old.tombstones, batches=tuple(sorted(last.items())))

    return _commit(spark, path, change)


def delete(ids: DataFrame, path: str) -> Manifest:
    """Deletes documents (column doc_id) from what the index has by now.

    Their terms are looked up in the postings, so that document frequencies stay exact; additions that another writer commits meanwhile are looked up too.
    """
    spark, own = ids.sparkSession, _name()
    gone = ids.select("doc_id").distinct()
    where = f"{path}/tombstones/{own}"
    gone.write.mode("overwrite").parquet(f"{where}/ids")
    gone = spark.read.schema(gone.schema).parquet(f"{where}/ids")
    for _ in range(ATTEMPTS):
        held = manifest(spark, path)
        if held is None or not held.segments:
            return held or _commit(spark, path, lambda old: old)
        taken = _live(spark, path, held, "postings").join(gone, "doc_id", "left_semi")
        taken.groupBy("segment", "field", "term").agg((-F.count("*")).alias("df")).write.mode("overwrite").parquet(f"{where}/vocabulary")

        def change(old: Manifest, seen: Manifest = held) -> Manifest:
            if old.segments != seen.segments or old.tombstones != seen.tombstones:
                raise Conflict(path)
            return replace(old, next_order=old.next_order + 1, tombstones=(*old.tombstones, Tombstone(own, old.next_order)))

        try:
            return _commit(spark, path, change)
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} other writers came first at {path}")


def _live(spark: SparkSession, path: str, held: Manifest, part: str, only: set[str] | None = None, listed: bool = False) -> DataFrame:
    """Rows of a part (postings or lengths) of all segments, with the segment's name, without deleted documents; postings as lists (field, term, ids, ends, positions) if ``listed``."""
    groups: dict[tuple, list[str]] = {}
    for s in held.segments:
        if only is None or s.name in only:
            groups.setdefault(held.of(s), []).append(s.name)
    out = None
    for tombstones, names in groups.items():
        rows = _part(spark, path, part, names)
        gone = spark.read.parquet(*[f"{path}/tombstones/{t.name}/ids" for t in tombstones]).distinct() if tombstones else None
        if not listed:
            rows = rows_of(rows) if part == "postings" else rows
            rows = rows.join(gone, "doc_id", "left_anti") if tombstones else rows
        elif not tombstones:
            rows = rows.select("field", "term", "ids", "ends", "positions")
        else:
            rows = without(rows, gone) if gone.count() <= HELD else gathered_again(rows_of(rows).join(gone, "doc_id", "left_anti"))
        out = rows if out is None else out.unionByName(rows)
    return out


def _frequencies(spark: SparkSession, path: str, held: Manifest) -> DataFrame:
    """(field, term, df): the segments' document frequencies added up, less what tombstones take from segments that are still listed."""
    names = [s.name for s in held.segments]
    every = _part(spark, path, "vocabulary", names).select("field", "term", "df")
    if held.tombstones:
        taken = spark.read.parquet(*[f"{path}/tombstones/{t.name}/vocabulary" for t in held.tombstones])
        every = every.unionByName(taken.where(F.col("segment").isin(names)).select("field", "term", "df"))
    return every.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0")


def tables(spark: SparkSession, path: str, held: Manifest | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings, lengths and vocabulary as of a manifest (the newest by default)."""
    held = held or manifest(spark, path)
    if held is None:
        raise FileNotFoundError(f"no index at {path}")
    if not held.segments:
        return tuple(spark.createDataFrame([], schema) for schema in EMPTY)
    return _live(spark, path, held, "postings").drop("segment"), _live(spark, path, held, "lengths").drop("segment"), _frequencies(spark, path, held)


def verify(spark: SparkSession, path: str) -> None:
    """Reads how long the lists are in all files of the newest manifest's segments; an error where one is broken or rows are missing."""
    held = manifest(spark, path)
    if held is None:
        raise FileNotFoundError(f"no index at {path}")
    for s in held.segments:
        n = _part(spark, path, "postings", [s.name]).agg(F.sum("n")).first()[0]
        if n != s.postings:
            raise ValueError(f"segment {s.name} has {n} postings of {s.postings}")


def due(held: Manifest, fan_in: int = FAN_IN) -> list[Segment]:
    """The smallest segments of one size class (powers of fan_in) with at least fan_in of them; none if there is no such class."""
    classes: dict[int, list[Segment]] = {}
    for s in held.segments:
        size, k = max(1, s.postings), 0
        while size >= fan_in:
            size, k = size // fan_in, k + 1
        classes.setdefault(k, []).append(s)
    return next((classes[k] for k in sorted(classes) if len(classes[k]) >= fan_in), [])


def merge(spark: SparkSession, path: str, which: list[Segment] | None = None) -> Manifest | None:
    """Writes segments (those that are due, by default) anew as one, without deleted documents. Tombstones that no older segment is left for go."""
    from .search import dealt

    for _ in range(ATTEMPTS):
        held = manifest(spark, path)
        chosen = [s for s in held.segments if s in (which if which is not None else due(held))] if held else []
        if len(chosen) < 2 and not any(held.of(s) for s in chosen):
            return held
        names, own = {s.name for s in chosen}, _name()
        lists = dealt(_live(spark, path, held, "postings", only=names, listed=True))
        n, documents = _write(lists, _live(spark, path, held, "lengths", only=names).drop("segment"), path, own)

        def change(old: Manifest, seen: Manifest = held, names: set[str] = names, one: tuple = (own, n, documents)) -> Manifest:
            if old.tombstones != seen.tombstones or not names <= {s.name for s in old.segments}:
                raise Conflict(path)
            merged = Segment(one[0], seen.next_order - 1, one[1], one[2])  # all tombstones so far are applied
            rest = tuple(s for s in old.segments if s.name not in names)
            kept = (merged, *rest)
            return replace(old, segments=kept, tombstones=tuple(t for t in old.tombstones if any(s.order < t.order for s in kept)))

        try:
            return _commit(spark, path, change)
        except Conflict:
            continue
    raise Conflict(f"{ATTEMPTS} other writers came first at {path}")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Removes segments and tombstones that none of the newest ``keep`` manifests lists, and older manifests; readers of those lose their files. Not beside a running addition: its folder is not listed yet."""
    numbers = _numbers(spark, path)
    held = [m for n in numbers[-keep:] if (m := _read(spark, path, n)) is not None]
    listed = {(part, f"segment={s.name}") for m in held for s in m.segments for part in PARTS} | {("tombstones", t.name) for m in held for t in m.tombstones}
    gone = []
    for kind in (*PARTS, "tombstones"):
        _, where, fs = _fs(spark, f"{path}/{kind}")
        for status in fs.listStatus(where) if fs.exists(where) else []:
            if (kind, status.getPath().getName()) not in listed:
                fs.delete(status.getPath(), True)
                gone.append(f"{kind}/{status.getPath().getName()}")
    for n in numbers[:-keep]:
        _, where, fs = _fs(spark, f"{path}/manifest/{n}.json")
        fs.delete(where, False)
    return gone
