"""Mixing sources to target weights by Pfair scheduling; rows are handled by Spark expressions only.

Documents of a source form blocks of ``block_docs``. Time is cut into slots of one block each. With weight w of all weights' sum W, the i-th block of a source is released
at floor((i-1) W / w) and due at ceil(i W / w), over the whole schedule: weights are whole numbers (given ones as they are, others in 10**12 parts)
and nothing is rounded to a frame. Earliest deadline first fills the slots, so at each slot each source has had less than one block more or less than its exact share.

Frames. Slots are filled in frames of ``frame``, each a row whose slots a Spark expression fills. Which blocks come before a frame's border is decided border after border by the driver: at slot T
source s has had floor(w T / W) blocks or one more; those with one more are taken by deadline, as long as every stretch of slots before the border can hold the blocks that are released
and must be served in it. That is what earliest deadline first over all slots has served by then, so the frames together are that one schedule. The driver holds one row
for each source, and spends some 0.06 ms for each frame (8,000 documents) of 7 sources, 0.4 ms of 50; frames go to Spark ``CHUNK`` at a time.

Nothing is dropped: the schedule ends with the slot that serves the last block not yet served, and a source that ends
sooner is read again from its start (epoch 1, 2, ...), as weights larger than its part of the corpus ask.

Without given weights the target is the source's document count to the power ``temper``, normalised. A frame's work is its slots times the sources.

Cases: a null source is a source of its own (empty name, ``source_null`` true); a null text is a document like others; rows with
equal doc_id keep separate places. A given weight of zero or a missing source in given weights
raises an error, since dropping a source must be asked for by a filter. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, plain_name

#: Documents of one block, slots of a frame, flattening power of the default weights.
BLOCK_DOCS, FRAME, TEMPER = 8, 1000, 0.9
#: Ranks within a source are counted in buckets: at least so many, and one for about so many documents.
BUCKETS, BUCKET_DOCS = 64, 50_000
#: Parts of the weights' sum, frames that the driver hands over at a time.
PARTS, CHUNK = 10**12, 20_000


def _bucket(doc_id: Column, buckets: int) -> Column:
    """A hash of the id that SQL has too."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int")


def target(sizes: DataFrame, weights: dict[str, float] | None, temper: float) -> DataFrame:
    """sizes with the weight of each source."""
    if weights is None:
        return sizes.withColumn("weight", F.pow(F.col("n").cast("double"), F.lit(temper)))
    pairs = [x for s, w in weights.items() for x in (F.lit(s), F.lit(float(w)))]
    found = F.element_at(F.create_map(*pairs), F.col("s"))
    return sizes.withColumn("weight", F.when(found > 0, found).otherwise(F.raise_error(F.concat(F.lit("no target weight for source "), "s")).cast("double")))


def whole_weights(weights: list[float]) -> list[int]:
    if all(w == int(w) for w in weights) and sum(weights) <= PARTS:
        return [int(w) for w in weights]
    return [max(1, round(w / sum(weights) * PARTS)) for w in weights]


def borders(whole: list[int], slots: int, frames: int) -> Iterator[list[int]]:
    """Blocks of each source that earliest deadline first has served before frame 0, 1, ..., frames."""
    total, served, x = sum(whole), [0] * len(whole), np.arange(slots)
    yield served
    for f in range(1, frames + 1):
        share = [divmod(w * slots * f, total) for w in whole]
        now = [max(had, base) for had, (base, _) in zip(served, share, strict=True)]
        more = slots * f - sum(now)
        waiting = sorted((-((rest - total) // w), i) for i, (w, had, (base, rest)) in enumerate(zip(whole, served, share, strict=True)) if rest and had <= base)
        if more < len(waiting):
            # Slots from the x-th of the frame to the border, less the blocks that are released there and fall due by the border.
            room = slots - x
            for w, (base, _), (base0, rest0) in zip(whole, share, (divmod(w * slots * (f - 1), total) for w in whole), strict=True):
                room = room - np.maximum(0, base - base0 + (-rest0 - w * x) // total)
            chosen = []
            for _, i in waiting:
                released = slots + -share[i][1] // whole[i]
                if len(chosen) < more and (released < 0 or room[: released + 1].min() >= 1):
                    chosen.append(i)
                    room[: max(released + 1, 0)] -= 1
        else:
            chosen = [i for _, i in waiting]
        for i in chosen:
            now[i] += 1
        served = now
        yield served


def frame_picks(spark, whole: list[int], slots: int, frames: int) -> DataFrame:
    """(i, pick, slot): the source of each slot of the frames, and how many blocks of it were served before."""
    total, ends, made = sum(whole), borders(whole, slots, frames), []
    now = next(ends)
    # The state: blocks served so far of each source, and the picks. x is how far a source's next block is from its exact share at the frame's start.
    fold = f"""aggregate(sequence(0L, {slots - 1}L), named_struct('n', n1, 'picks', cast(array() as array<struct<i: int, pick: bigint, slot: bigint>>)),
      (acc, t) -> aggregate(array(array_min(filter(transform(transform(w, (v, i) -> (acc.n[i] - base[i]) * {total}L - rest[i]),
            (x, i) -> named_struct('due', (x + {total}L + w[i] - 1) div w[i], 'i', i, 'free', acc.n[i] < n2[i] and x < w[i] * (t + 1))), c -> c.free))), acc,
          (a, c) -> named_struct('n', transform(a.n, (k, i) -> if(i = c.i, k + 1, k)),
            'picks', concat(a.picks, array(named_struct('i', c.i, 'pick', a.n[c.i], 'slot', id * {slots} + t))))),
      acc -> acc.picks)"""
    for first in range(0, frames, CHUNK):
        rows = []
        for f in range(first, min(frames, first + CHUNK)):
            share = [divmod(w * slots * f, total) for w in whole]
            rows.append((f, now, [b for b, _ in share], [r for _, r in share], now := next(ends)))
        one = spark.createDataFrame(rows, "id long, n1 array<long>, base array<long>, rest array<long>, n2 array<long>").withColumn("w", F.array(*[F.lit(w).cast("long") for w in whole]))
        one = one.repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism)))
        made.append(materialise(one.select(F.explode(F.expr(fold)).alias("p")).select("p.*")))
    return functools.reduce(DataFrame.union, made) if made else spark.createDataFrame([], "i int, pick long, slot long")


def _sources(docs: DataFrame, known: list, whole: list[int]) -> DataFrame:
    rows = [F.struct(F.lit(r["s"]).alias("s"), F.lit(r["s_null"]).alias("s_null"), F.lit(i).alias("i"), F.lit(r["blocks"]).cast("long").alias("blocks")) for i, r in enumerate(known)]
    return docs.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schedule(docs: DataFrame, weights: dict[str, float] | None = None, block_docs: int = BLOCK_DOCS, frame: int = FRAME, temper: float = TEMPER, bucket_docs: int = BUCKET_DOCS, id_name: str = "doc_id", source_name: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document and epoch: doc_id, source, source_null, block, epoch, slot (long), place (in the block).

    ``carry`` names further columns of docs to keep; they must not clash with these. The sources are counted at once.
    """
    spark = docs.sparkSession
    src = F.col(f"`{source_name}`").cast("string")
    narrow = docs.select(F.col(f"`{id_name}`").cast("long").alias("doc_id"), F.coalesce(src, F.lit("")).alias("s"), src.isNull().alias("s_null"), *[F.col(f"`{c}`") for c in carry])
    sizes = narrow.groupBy("s", "s_null").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / block_docs))
    known = sorted(target(sizes, weights, temper).collect(), key=lambda r: (r["s"], r["s_null"]))
    if not known:
        known = [{"s": "", "s_null": True, "n": 0, "blocks": 0, "weight": 1.0}]
    whole = whole_weights([r["weight"] for r in known])
    frames = max(-(-r["blocks"] * sum(whole) // (w * frame)) for r, w in zip(known, whole, strict=True))
    blocks = F.array(*[F.lit(max(r["blocks"], 1)).cast("long") for r in known])
    picks = frame_picks(spark, whole, frame, frames).withColumn("blocks", F.get(blocks, "i")).selectExpr("i", "pick % blocks as block", "pick div blocks as epoch", "slot", "pick = blocks - 1 as once")
    # The slot at which every source has been read once ends the schedule.
    last = picks.where("once").agg(F.max("slot").alias("last"))
    served = picks.drop("once").crossJoin(F.broadcast(last)).where("slot <= last").drop("last")  # one row
    # Ranks within a source come from bucket counts, so that no source is ranked in one task.
    buckets = max(BUCKETS, -(-sum(r["n"] for r in known) // bucket_docs))
    keyed = narrow.withColumn("b", _bucket(F.col("doc_id"), buckets))
    counts = keyed.groupBy("s", "s_null", "b").agg(F.count("*").alias("in_bucket"))
    before = Window.partitionBy("s", "s_null").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))).drop("in_bucket")
    within = Window.partitionBy("s", "s_null", "b").orderBy("doc_id", *carry)
    ranked = keyed.withColumn("r", F.row_number().over(within) - 1).join(starts, ["s", "s_null", "b"]).withColumn("rank", F.col("before") + F.col("r"))
    placed = ranked.selectExpr("*", f"rank div {block_docs} as block", f"cast(rank % {block_docs} as long) as place").join(F.broadcast(_sources(docs, known, whole)), ["s", "s_null"])
    out = placed.join(served, ["i", "block"])
    return out.select("doc_id", F.col("s").alias("source"), F.col("s_null").alias("source_null"), "block", "epoch", "slot", "place", *[F.col(f"`{c}`") for c in carry])


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents in their mixed form: all columns of docs, a row for each epoch, partitions and rows in order of the schedule.

    Only ids, sources and two hashes of the whole row are scheduled; the rows join their slots afterwards, by id and both hashes. Rows equal in all columns are interchangeable.
    """
    key, other, slot, place = (plain_name(docs, x) for x in ("row_key", "row_other", "row_slot", "row_place"))
    keyed = docs.withColumns(dict(zip((key, other), _row_hashes(docs), strict=True)))
    ids = materialise(keyed.select(F.col("doc_id"), F.col("source"), F.col(key).alias("row_key"), F.col(other).alias("row_other")))
    slots = schedule(ids, carry=("row_key", "row_other"), **options).select(F.col("doc_id").alias("slot_id"), F.col("row_key").alias("slot_key"), F.col("row_other").alias("slot_other"), F.col("slot").alias(slot), F.col("place").alias(place))
    if not ids.groupBy("doc_id", "row_key", "row_other").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", key, other])
    same = (keyed[key] == slots["slot_key"]) & (keyed[other] == slots["slot_other"]) & keyed["doc_id"].cast("long").eqNullSafe(slots["slot_id"])
    return keyed.join(slots, same).repartitionByRange(slot).sortWithinPartitions(slot, place).select(*[keyed[f"`{c}`"] for c in docs.columns])


def _row_hashes(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of all columns, and of which of them are null, that begin with different seeds."""
    columns = [x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return F.xxhash64(*columns), F.xxhash64(F.lit("other"), *columns)
