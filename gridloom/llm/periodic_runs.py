"""Runs of repeated words, by Lyndon arrays over an ordered alphabet.

A run is a maximal stretch whose words recur at a smallest distance, its period. Every run of at least two periods begins a
longest Lyndon word in one of two orders of the alphabet, a given one or its reverse, and that word is as long as the period (Bannai et al.). So two Lyndon arrays give
all candidates, one for each position and order, and extending a candidate to both sides gives its run (Ellert and Fischer).

``Lyndon.edges`` goes through the words from right to left. The next smaller suffix of a position lies on the chain of next smaller suffixes
that starts one place further on, and three things that were matched before are used again:

* the extension stored with each link of the chain, which decides a comparison of other length without reading a word;
* the matched stretch of each distance: a later comparison at that distance reads up to the stretch and jumps to its end;
* inside a stretch of a distance, links whose whole extension lies in it are those one period on.

Both orders together compare below 5 words for each word of Fibonacci words, periodic and random sequences; on Thue-Morse words, where squares of
every size nest, 13 at 160,000 words and 0.75 more with each doubling: linear but for that.

Words are only compared. Their ranks come from sorting a text's words by length and bytes; there is no suffix array or tree and no hash.
A run of four periods needs each of its words four times, so rarer words cut a text into parts that are worked through one by one.

Rows stay in their partition: there is no shuffle. A task holds the words of about a megabyte of text, or of one longer text.

Cases: a null text has no words, no runs and an empty collapsed text; repeated rows are worked through one by one; a null doc_id passes through.
Of runs of equal exponent the first start counts, then the smaller period. Other columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, text_arrays, tidy, words

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of a word that are compared as two numbers; longer words are sorted as strings.
SHORT = 16
RUNS = "array<struct<start:long,length:long,period:long>>"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Lyndon:
    """Next smaller suffixes of one sequence; a suffix that ends is smaller than its continuation."""

    def __init__(self, x: list[int]):
        self.x, self.compared = x, 0
        self.stretch: dict[int, tuple[int, int]] = {}  # by distance d: x[k] == x[k + d] for k from the first to before the second, not at the second

    def extension(self, i: int, j: int, known: int) -> int:
        """How many words from i and from j on are equal; the first ``known`` are."""
        x, n, d, k = self.x, len(self.x), j - i, i + known
        first, last = self.stretch.get(d, (n, n))
        end = min(first, n - d)
        begin = k
        while k < end and x[k] == x[k + d]:
            k += 1
        self.compared += k - begin + 1
        if first <= k <= last:
            k = last
        self.stretch[d] = (i, k)
        return k - i

    def edges(self) -> tuple[list[int], list[int]]:
        """For each position its next smaller suffix and their common extension."""
        x, n, extension = self.x, len(self.x), self.extension
        smaller, common = [n] * n, [0] * n
        d = last = 0  # the stretch of distance d reaches from the position on the right to last
        for i in range(n - 1, -1, -1):
            v = x[i]
            if d:
                if i + d < n and x[i + d] == v:
                    far, l = smaller[i + d], common[i + d]
                    if far + l < last + d:
                        smaller[i], common[i] = far - d, l
                        continue
                else:
                    d = 0
            j, l = i + 1, 0
            while j < n:
                w = x[j]
                if w < v:
                    break
                if w > v:
                    j = smaller[j]
                    continue
                l = extension(i, j, l)
                if j + l == n or x[j + l] < x[i + l]:
                    break
                # The suffix at j is the larger one; what does its own link say of the next?
                r = common[j]
                while l < r:
                    j = smaller[j]
                    r = common[j] if j < n else 0
                j = smaller[j] if j < n else n
                if l > r:
                    l = r
                    break
            smaller[i] = j
            common[i] = l = l if j < n else 0
            if l and (not d or j + l > last + d):
                d, last = j - i, i + l
                self.stretch[d] = (i, last)
        return smaller, common


def runs_of(x: list[int], least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least so many words and periods (two or more), by start and period."""
    found = set()
    for y in (x, [-v for v in x]):
        smaller, common = Lyndon(y).edges()
        for i, (j, r) in enumerate(zip(smaller, common, strict=True)):
            p = j - i
            least = max(least_words, least_periods * p)
            if r + 2 * p <= least:  # at most p - 1 words before i
                continue
            left = 0
            while left < p and left < i and x[i - 1 - left] == x[j - 1 - left]:
                left += 1
            if left < p and left + p + r >= least:  # else an earlier root of the same run gives it
                found.add((i - left, left + p + r, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word its rank among all (row, word) pairs, words by length and bytes (longer ones than SHORT by bytes), and how often it occurs in its row."""
    size = ends - starts
    high, low = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for lane, begin in ((high, 0), (low, SHORT // 2)):
        for k in range(begin, begin + SHORT // 2):
            has = size > k
            lane <<= np.uint64(8)
            lane[has] |= data[starts[has] + k]
    long = np.flatnonzero(size > SHORT)
    if len(long):
        texts = [data[a:b].tobytes() for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
        order = sorted(range(len(long)), key=texts.__getitem__)
        place = np.cumsum([0] + [texts[a] != texts[b] for a, b in zip(order, order[1:], strict=False)])
        high[long[order]], low[long] = place.astype(np.uint64), 0
    kind = row * (SHORT + 2) + np.minimum(size, SHORT + 1)
    order = np.lexsort((low, high, kind))
    fresh = np.zeros(len(order), bool)
    for key in (kind, high, low):
        sorted_key = key[order]
        fresh[1:] |= sorted_key[1:] != sorted_key[:-1]
    group = np.cumsum(fresh)
    rank = np.empty(len(order), np.int64)
    rank[order] = group
    return rank, np.bincount(group, minlength=1)[rank] if len(rank) else rank


def _chunk(data: np.ndarray, offsets: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[list[tuple], bytes]]:
    """Runs and collapsed text of each row."""
    starts, ends, first = words(data, offsets)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    rank, times = ranks(data, starts, ends, row)
    # Parts: stretches of words, of one row, that are frequent enough to be in a run.
    often = times >= least_periods
    begins = np.flatnonzero(often & np.append(True, ~often[:-1] | (row[1:] != row[:-1]))) if len(often) else np.zeros(0, np.int64)
    stops = np.flatnonzero(often & np.append(~often[1:] | (row[1:] != row[:-1]), True)) + 1 if len(often) else begins
    long = stops - begins >= least_words
    runs: dict[int, list[tuple]] = {}
    for a, b in zip(begins[long].tolist(), stops[long].tolist(), strict=True):
        here = int(row[a])
        shift = a - int(first[here])
        found = runs_of(rank[a:b].tolist(), least_words, least_periods)
        if found:
            runs.setdefault(here, []).extend((s + shift, n, p) for s, n, p in found)
    for i in range(len(offsets) - 1):
        text = data[offsets[i] : offsets[i + 1]].tobytes().split()
        own = runs.get(i, [])
        if own:
            dropped = np.zeros(len(text) + 1, np.int64)
            for s, n, p in own:
                dropped[s + p] += 1
                dropped[s + n] -= 1
            text = [text[k] for k in np.flatnonzero(np.cumsum(dropped)[:-1] == 0).tolist()]
        yield own, b" ".join(text)


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start and period) and collapsed of each row: the words joined by one space, without those that a run has after its first period."""
    if least_periods < 2:
        raise ValueError("a run has two periods at least")

    @tidy
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            for a, b in chunks(offsets):
                out = list(_chunk(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], least_words, least_periods))
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for own, _ in out], _RUN)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(a, b - a), runs, pa.array([t.decode() for _, t in out], pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).mapInArrow(find, f"doc_id long, runs {RUNS}, collapsed string")


def longest(runs: Column) -> Column:
    """The run of greatest exact exponent; null if there is none."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent (start, length, period, exponent_milli), and digests of all runs and of the collapsed text."""
    found = periodic_runs(docs).withColumn("best", longest(F.col("runs")))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def with_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in texts whose hash of doc_id 10 divides, the words from one on repeat a stretch of them to the end."""
    digest = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    part = F.floor(digest / 10)

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = part % n
        p = 1 + F.floor((n - a) / (3 + part % 8))
        return F.when(n > 0, F.array_join(F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + (i - a) % p).cast("int")))), " ")).otherwise("")

    # The word list is a lambda's variable, so it is made once for each text.
    altered = F.get(F.transform(F.array(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))), tail), 0)
    return docs.select("doc_id", F.when(digest % 10 == 0, altered).otherwise(F.col("text")).alias("text"))
