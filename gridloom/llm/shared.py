"""What the operators share: cut lineage, and array views of Arrow text columns."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Whitespace of all operators here: these six bytes and no others.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Documents are hashed in groups of about so many bytes, so that temporary arrays stay small.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, np.ndarray] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or (unset, as in tests) one of our own."""
    sc = spark.sparkContext
    now = sc.getCheckpointDir()
    if not now:
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gridloom-"))
        now = sc.getCheckpointDir()
    return now


#: While this is set, Spark deletes the shuffle files of an execution when it ends, instead of when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: later reads survive lost executors.

    The shuffle files behind df go at once, the Parquet files when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    if jvm is not None and spark.sparkContext._jsc is not None:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(task):
    """A task over Arrow batches that gives the memory it has freed back to the system when it ends: its worker lives on, beside those of other tasks."""

    @functools.wraps(task)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the n + 1 offsets of its rows; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes together; a longer row makes a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = last


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 4096)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:  # tables for rare giant texts are not kept
            _powers[base] = have
    return have[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Prefix:
    """Hashes of substrings of a byte array by one running sum: equal bytes give equal 64-bit hashes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, _INVERSE)

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def _long_hash(data: np.ndarray) -> np.uint64:
    """Prefix(data).hash of all of data, by pieces."""
    total, factor = 0, 1
    for a in range(0, len(data), CHUNK_BYTES):
        part = data[a : a + CHUNK_BYTES]
        total += int((_BYTE[part] * powers(len(part))).sum(dtype=np.uint64)) * factor
        factor = factor * pow(_BASE, len(part), 2**64) % 2**64
    return mix(np.array([(total + len(data) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Prefix(data).hash of words in order, with temporary arrays for about CHUNK_BYTES at a time whatever the text's length."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        last = max(k + 1, int(np.searchsorted(ends, starts[k] + CHUNK_BYTES, "right")))
        lo, hi = starts[k], ends[last - 1]
        if hi - lo <= CHUNK_BYTES:
            out[k:last] = Prefix(data[lo:hi]).hash(starts[k:last] - lo, ends[k:last] - lo)
        else:
            out[k] = _long_hash(data[lo:hi])
        k = last
    return out


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in data, and for each row the index of its first word (n + 1 values).

    A word is a run of bytes other than the six of SPACE; rows end words too.
    """
    inside = ~SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = inside[1:]
        cut = offsets[1:-1]
        after[cut[(cut > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(word_hash: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; the last n - 1 starts are missing."""
    m = len(word_hash) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total = total * _U(0xC2B2AE3D27D4EB4F) + word_hash[j : j + m]
    return mix(total + _U(n))


def plain_name(df: DataFrame, stem: str) -> str:
    """A column name like stem that df does not have (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


WORD = re.compile(rb"[^\x20\x09-\x0D]+")
