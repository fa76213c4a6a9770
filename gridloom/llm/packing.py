"""Packing by the sum-of-squares rule.

Each partition reads its documents once, online. The token ids of a document (and the end id) are cut into
full windows and one rest. The rest goes into the open window whose fill level makes the sum over
levels of squared counts of partially filled windows smallest; the counts are a level array of ``window`` numbers.
A rest may also open a window. At the partition's end the pieces of the windows still open are laid end to end and cut into full windows; what is left over (less than one window) is cut
by powers of two, so nothing is padded.

A partition never looks at another one: there is no shuffle, and a task that is run again gives the same sequences. Open windows hold four bytes
for each of their tokens, so even where no two rests fit together (all a little over half a window) a task holds no more than its own partition's text, whose size ``spark.sql.files.maxPartitionBytes`` sets. sequence_id holds the partition's number in its upper bits.

Cases: a null text is empty and packs as its end id alone; repeated rows are documents of their own; a null doc_id passes
through; a text of any length is read whole and cut. Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy

#: Tokens of a window, the id that ends a document.
WINDOW, END_ID = 1024, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ROWS = 4096


class Packer:
    """Open windows by fill level. A piece is (document index, start, ids)."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.open: list[list[list]] = [[] for _ in range(window)]  # by level: windows, each a list of pieces
        self.count = np.zeros(window + 1, np.int64)  # the level array: count[h] windows filled to h; window itself stays 0

    def add(self, piece) -> Iterator[list]:
        """Places a piece shorter than a window; yields windows that became full."""
        size, count = len(piece[2]), self.count
        # Filling a window at level h moves it to h + size: the sum of squares changes by this much.
        levels = np.flatnonzero(count[1 : self.window - size + 1]) + 1
        change = np.where(levels + size < self.window, 2 * count[levels + size] + 1, 0) - 2 * count[levels] + 1
        best = int(np.argmin(change)) if len(levels) else -1
        # A new window changes the sum by 2 * count[size] + 1; a tie goes to the fuller old window.
        if best < 0 or change[best] > 2 * count[size] + 1:
            level, target = size, [piece]
        else:
            low = int(levels[np.flatnonzero(change == change[best])[-1]])
            target = self.open[low].pop()
            count[low] -= 1
            target.append(piece)
            level = low + size
        if level == self.window:
            yield target
        else:
            self.open[level].append(target)
            count[level] += 1

    def lay_out(self) -> Iterator[list]:
        """Cuts the pieces of all open windows into full windows, the rest by powers of two."""
        pieces = [p for level in reversed(self.open) for target in level for p in target]
        total = sum(len(p[2]) for p in pieces)
        self.open = [[] for _ in range(self.window)]
        self.count[:] = 0
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        at = 0
        for size in sizes:
            target, room = [], size
            while room:
                doc, start, ids = pieces[at]
                take = min(room, len(ids))
                target.append((doc, start, ids[:take]))
                room -= take
                if take == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc, start + take, ids[take:])
            yield target


def _pack(encoder, window: int, end_id: int):
    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder()
        packer, number = Packer(window), TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def write(target):
            nonlocal number
            offset = 0
            for (doc, n), start, ids in target:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), n, number, offset))
                offset += len(ids)
            number += 1

        def flush():
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in PIECES.split(", ")])

        for batch in batches:
            for doc, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"]), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                key = (doc, len(ids))
                whole = len(ids) // window * window
                for start in range(0, whole, window):
                    write([(key, start, ids[start : start + window])])
                if whole < len(ids):
                    for target in packer.add((key, whole, ids[whole:].copy())):
                        write(target)
                if len(rows) >= ROWS:
                    yield flush()
        for target in packer.lay_out():
            write(target)
        yield flush()

    return pack


def packed(docs: DataFrame, encoder, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``encoder()`` gives, on the executor, a function from a text column to an iterator of uint32 arrays.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack(encoder, window, end_id), PIECES)
