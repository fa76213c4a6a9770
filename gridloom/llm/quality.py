"""Quality rules: counted rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed word 1- and 2-grams are counted over whole texts: the trusted target
(documents labelled of good quality) and the raw corpus (all documents). A document's verdict is the
mean over its n-grams of log(target / raw), both smoothed by pseudo-counts in the raw corpus's proportions, so that
n-grams with little evidence say little; it is kept at ``threshold`` or above. The mean does not
grow with length, and equal texts always get equal verdicts.

Both are counted over all their documents. The target's texts come from a shuffled semi-join of documents and labels (about one time the
texts on disk, dropped when counted), so that no id list has to fit anywhere. One vector of ``buckets`` numbers per side is all that reaches the driver.

Cases: a null or empty text has no words and fails the base rules; a null doc_id passes through; repeated rows
get equal rows; labels without a document, null labels and repeated labels (good if any is) have a defined effect: none, none, once.
With no trusted document at all the ratio is 0 for every document. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, materialise, shingles, text_arrays, tidy, word_hashes, words

#: Hash buckets of the n-grams, pseudo-count of each bucket (n-grams of the raw corpus), and the least mean log ratio (nats per n-gram) of a kept document.
BUCKETS, PSEUDO, THRESHOLD = 1 << 16, 20.0, -0.12
#: Fixed values of the base rules.
SYMBOLS, WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = b"#*$%&|<>", 8, 20, 30
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def ngram_buckets(hashes: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word 1- and 2-gram, and the row that it is in."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pair = shingles(hashes, 2)
    whole = row[1:] == row[:-1] if len(row) else np.zeros(0, bool)
    both = np.concatenate([hashes, pair[whole]])
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate([row, row[:-1][whole]] if len(row) else [row, row])


def repeated_words(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each row its words in windows that the row holds twice or more."""
    n_rows = len(first) - 1
    if len(hashes) < window:
        return np.zeros(n_rows, np.int64)
    h = shingles(hashes, window)
    row = np.repeat(np.arange(n_rows), np.diff(first))
    inside = row[: len(h)] == row[window - 1 :]
    at = np.flatnonzero(inside)
    order = at[np.lexsort((h[at], row[at]))]
    same = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, order[twice], 1)
    np.add.at(edge, order[twice] + window, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[:-1] > 0)])
    return covered[first[1:]] - covered[first[:-1]]


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _analyse(data: np.ndarray, offsets: np.ndarray):
    """Chunks of (row range, word hashes, first word of each row, base counts)."""
    for a, b in chunks(offsets):
        part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = words(part, at)
        yield a, b, part, at, starts, ends, first, word_hashes(part, starts, ends)


def base_counts(part: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    sums = lambda mask: (c := np.concatenate([[0], np.cumsum(mask)]))[at[1:]] - c[at[:-1]]
    from .shared import SPACE

    raw = part.tobytes()
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": sums(((part & 0xC0) != 0x80) & ~SPACE[part]),
        "n_symbols": sums(_SYMBOL[part]),
        "n_dup_lines": np.array([duplicate_lines(raw[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64),
        "n_repeat_words": repeated_words(hashes, first),
    }


def _counter(buckets: int, trusted: bool):
    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            for _, _, _, _, _, _, first, hashes in _analyse(data, offsets):
                total += np.bincount(ngram_buckets(hashes, first, buckets)[0], minlength=buckets)
        at = np.flatnonzero(total)
        n, none = pa.array(total[at], pa.int64()), pa.array(np.zeros(len(at), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *((n, none) if trusted else (none, n))], ["bucket", "good", "raw"])

    return count


def log_ratios(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log(target / raw) of each bucket, from counts over all documents and over all trusted ones."""
    good = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    # Always by a shuffle: the ids grow with the corpus, and hashing those of a partition needs no sort of texts.
    trusted = texts.where("id is not null and text is not null").join(good.hint("shuffle_hash"), "id", "left_semi")
    counted = [x.select("text").mapInArrow(_counter(buckets, t), "bucket long, good long, raw long") for x, t in ((texts, False), (trusted, True))]
    rows = materialise(counted[0].union(counted[1]).groupBy("bucket").agg(F.sum("good").alias("good"), F.sum("raw").alias("raw"))).collect()
    good_n, raw_n = np.zeros(buckets), np.zeros(buckets)
    for r in rows:
        good_n[r["bucket"]], raw_n[r["bucket"]] = r["good"], r["raw"]
    return smoothed(good_n, raw_n)


def smoothed(good: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target over raw probability of each bucket; 0 where nothing is known."""
    if not good.sum():
        return np.zeros(len(raw), np.float32)
    part = good.sum() / raw.sum()
    return np.log((good + PSEUDO * part) / ((raw + PSEUDO) * part)).astype(np.float32)


def _judge(ratio, threshold: float):
    @tidy
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            data, offsets = text_arrays(batch["text"])
            n = len(offsets) - 1
            out = {c: np.zeros(n, np.int64) for c in COUNTS}
            score = np.zeros(n)
            for a, b, part, at, starts, ends, first, hashes in _analyse(data, offsets):
                for c, v in base_counts(part, at, starts, ends, first, hashes).items():
                    out[c][a:b] = v
                bucket, row = ngram_buckets(hashes, first, len(table))
                size = np.bincount(row, minlength=b - a)
                score[a:b] = np.bincount(row, table[bucket].astype(np.float64), minlength=b - a) / np.maximum(size, 1)
            failed = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * out["n_words"])
            score = np.round(score, 6)
            kept = ~failed & (score >= threshold)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [*[batch[c] for c in names], *[pa.array(out[c]) for c in COUNTS], pa.array(failed), pa.array(score), pa.array(kept)], [*names, *COUNTS, "base_failed", "log_ratio", "kept"]
            )

    return judge


def quality(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the base counts, base_failed, log_ratio and kept of each document."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_judge(ratio, threshold), "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, log_ratio double, kept boolean")


def _filter(ratio, threshold: float):
    judge = _judge(ratio, threshold)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdict = next(judge(iter([batch.select(["text"])])))
            yield batch.filter(verdict["kept"])

    return keep


def drop_bad(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, buckets))
    return docs.mapInArrow(_filter(ratio, threshold), docs.schema)
