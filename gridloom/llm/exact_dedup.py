"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes sorted runs of (digest, smallest identifier, count). The cells of a
hypercube then exchange runs: in each round a cell sends its entries to the cells that share its own
number but for one digit, which comes from the digest, and merges what it receives in one sweep over
sorted runs. After the last round all entries of a digest have met, each cell holds its share of the digests, and
no task has held more than its share. A digest that a third of all rows carry enters with one entry
per run, so it weighs no more than any other.

An entry is the SHA-256 of the normalised text. Entries merge when digest, byte length and an
independent 64-bit hash agree, at every level; entries that differ in one of them stay apart.

Cases: a null text is an empty text; all empty texts are equal. A null doc_id counts as larger than
every number and is reported as null. Of repeated rows with one doc_id and one text exactly one is kept.
Other columns are never read, and are passed through by ``drop_copies`` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, partitions, plain_name, tidy

#: Entries of one run before merging.
RUN_ROWS = 500_000
#: Runs that meet in one cell and round.
FAN_IN = 8
RUN = "cell int, digest binary, n_bytes long, check long, keep_id long, keep_row long, group_size long"
KEYS = ["digest", "n_bytes", "check"]
#: Rows of a group from which its entry is broadcast to them: there are at most rows / HOT_GROUP such groups (100 bytes each).
HOT_GROUP = 100_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _tag(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, tag, row, digest, n_bytes, check) of each row, written once: row tells repeated rows apart, tag a document's texts."""
    flat = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), _tag(text_col).alias("tag"), normalised(F.col(f"`{text_col}`")).alias("flat"))
    return materialise(flat.select("doc_id", "tag", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("flat", 256)).alias("digest"), F.octet_length("flat").cast("long").alias("n_bytes"), F.xxhash64("flat").alias("check")))


def _merged(table: pa.Table) -> pa.Table:
    """One entry for each key: the smallest (identifier, row), nulls last, and the sum of counts; sorted by digest."""
    order = pc.sort_indices(table, sort_keys=[(k, "ascending") for k in [*KEYS, "keep_id", "keep_row"]])
    table = table.take(order)
    first = np.ones(table.num_rows, bool)
    for i, k in enumerate(KEYS):
        column = table[k].combine_chunks() if table.num_rows else table[k]
        if table.num_rows > 1:
            same = pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
            first[1:] = ~same if i == 0 else first[1:] | ~same
    at = np.flatnonzero(first)
    total = np.add.reduceat(table["group_size"].to_numpy(), at) if len(at) else np.zeros(0, np.int64)
    return table.take(pa.array(at)).set_column(table.schema.get_field_index("group_size"), "group_size", pa.array(total, pa.int64()))


def _digit(digest: pa.ChunkedArray, level: int) -> np.ndarray:
    """The level-th octal digit of each digest; digests are spread evenly."""
    heads = np.frombuffer(b"".join(x[:8] for x in digest.to_pylist()), ">u8")
    return ((heads >> np.uint64(61 - 3 * level)) & np.uint64(FAN_IN - 1)).astype(np.int64)


def _goes_to(table: pa.Table, cell: np.ndarray, level: int, levels: int) -> pa.RecordBatch:
    if level < levels:
        place = FAN_IN**level
        cell = cell - cell // place % FAN_IN * place + _digit(table["digest"], level) * place
    return table.set_column(0, "cell", pa.array(cell.astype(np.int32)))


def _first_runs(levels: int):
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId() % FAN_IN**levels
        held, n = [], 0

        def flush():
            one = _merged(pa.Table.from_batches(held))
            return _goes_to(one, np.full(one.num_rows, here, np.int64), 0, levels).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= RUN_ROWS:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    return run


def _merge_runs(level: int, levels: int):
    """Sweeps rows sorted by cell and key; what may continue in the next batch is held back, one entry at most."""

    @tidy
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def one_cell_each(table: pa.Table) -> pa.Table:
            cells = table["cell"].to_numpy()
            cuts = np.flatnonzero(np.diff(cells)) + 1
            return pa.concat_tables([_merged(table.slice(a, b - a)) for a, b in zip([0, *cuts], [*cuts, len(cells)], strict=True)])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = one_cell_each(pa.concat_tables([rest, table]) if rest is not None else table)
            rest, table = table.slice(table.num_rows - 1), table.slice(0, table.num_rows - 1)
            if table.num_rows:
                yield from _goes_to(table, table["cell"].to_numpy().astype(np.int64), level, levels).combine_chunks().to_batches()
        if rest is not None:
            yield from _goes_to(rest, rest["cell"].to_numpy().astype(np.int64), level, levels).combine_chunks().to_batches()

    return merge


def merge_tree(rows: DataFrame) -> DataFrame:
    """Classes of equal texts: (digest, n_bytes, check, keep_id, keep_row, group_size) from ``digests``."""
    spark = rows.sparkSession
    levels = 1
    while FAN_IN**levels < partitions(spark):
        levels += 1
    entry = rows.select(F.lit(0).alias("cell"), *KEYS, F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.lit(1).cast("long").alias("group_size"))
    runs = entry.mapInArrow(_first_runs(levels), RUN)
    for level in range(1, levels + 1):
        runs = runs.repartition(partitions(spark), "cell").sortWithinPartitions("cell", *KEYS).mapInArrow(_merge_runs(level, levels), RUN)
    return runs.drop("cell")


def with_groups(rows: DataFrame) -> DataFrame:
    """rows with the entry of their group, null where it has no other row. A hot group's rows do not meet in one task."""
    groups = materialise(merge_tree(rows).where("group_size > 1"))
    hot, cold = (groups.where(x) for x in (F.col("group_size") > HOT_GROUP, F.col("group_size") <= HOT_GROUP))
    joined = rows.join(cold, KEYS, "left")
    if hot.isEmpty():
        return joined
    found = rows.join(F.broadcast(hot), KEYS)
    rest = rows.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti")
    return found.unionByName(rest.join(cold, KEYS, "left"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    joined = with_groups(digests(docs, id_col, text_col))
    alone = F.col("group_size").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows are lost by id and text; of rows equal in both one stays."""
    rows = with_groups(digests(docs, id_col, text_col)).where("group_size is not null")
    marked = materialise(rows.groupBy("doc_id", "tag").agg(F.max(F.col("row") == F.col("keep_row")).alias("kept"), F.count("*").alias("n")))
    key, tag = plain_name(docs, "key_id"), plain_name(docs, "key_tag")
    keyed = docs.withColumns({key: F.col(f"`{id_col}`").cast("long"), tag: _tag(text_col)})
    lost = marked.where("not kept").select(F.col("doc_id").alias(key), F.col("tag").alias(tag))
    kept = keyed.join(lost, keyed[key].eqNullSafe(lost[key]) & (keyed[tag] == lost[tag]), "left_anti")
    if not marked.where("kept and n > 1").isEmpty():
        kept = kept.dropDuplicates([key, tag])
    return kept.drop(key, tag)
