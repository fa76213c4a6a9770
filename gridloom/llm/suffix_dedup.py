"""Removal of repeated passages: anchors that the content chooses, and two sorted rounds over names of what surrounds them.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier (smaller doc_id, or same document and earlier start). Strings of
2k bytes are named by the pair of names of their halves; Spark sorts (name, position) rows, names held by one position leave,
and the rest are named anew at a larger offset, until unique or past ``LENGTH``.

Round 0, within a task: names of 1, 2, 4, ... ``GRAM`` bytes at all positions (hashes of pairs of names; equal strings have equal names).
Sampling: every string of ``LENGTH`` bytes keeps one position of its content's choosing, the one with the smallest ``GRAM``-byte name. Equal strings
choose alike, so comparing chosen positions (about one byte in 35) misses nothing.
Round 1, sorted by Spark: (GRAM name, name of the context up to ``REACH`` bytes around it, position). A unique GRAM name leaves: no string
around it is repeated. Equal contexts are past the threshold: all strings around all but the first occurrence go.
Round 2, sorted by Spark: for the first occurrences of the remaining (GRAM, context) pairs, the ``LENGTH``-byte strings around them. All but the first of
equal ones go. A GRAM name with more than ``HOT`` contexts is dealt out by the strings themselves instead of by itself.

A task drops what it can before the shuffle: of equal (GRAM, context) pairs in one block of its input only the first travels, so a passage that a
third of all documents share costs one row per block.

Cases: null and empty texts have no bytes; texts shorter than ``LENGTH`` lose nothing; matches never cross texts. A null doc_id orders after all others,
beside 2**63 - 1: between those two the earlier start counts, and both come out as they are.
Rows with one doc_id and one text are one document (equal results); rows with one doc_id and different texts are compared in order of start. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Prefix, chunks, materialise, mix, partitions, text_arrays, tidy

#: Bytes of a repeated string, bytes of the sampled names, bytes on either side that a string around a sampled one may reach.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Sampled positions that a task compares before sending them on, contexts of one name that a task takes, rows held for one name.
BLOCK, HOT, HELD = 1_000_000, 50_000, 200_000
#: Parts by hash in which a task compares the strings of many contexts, so that their arrays stay small.
PARTS = 8
NO_ID = 2**63 - 1
_U = np.uint64
_FIRST_NAMES = np.random.default_rng(77).integers(1, 2**63, 256, dtype=np.uint64)


def names(data: np.ndarray, length: int = GRAM) -> np.ndarray:
    """Name of the string of ``length`` (a power of two) bytes at each position: pairs of names of half the length."""
    h, k, factor = _FIRST_NAMES[data], 1, 0x9E3779B97F4A7C15
    while k < length and len(h) > k:
        h = h[:-k] * _U(factor) + h[k:]
        factor = factor * factor % 2**64
        k *= 2
    return mix(h) if k == length else np.zeros(0, np.uint64)


def _sliding(h: np.ndarray, size: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over each ``size`` neighbours, by doubling."""
    k = 1
    while 2 * k <= size:
        h = pick(h[:-k], h[k:])
        k *= 2
    return pick(h[: len(h) - (size - k)], h[size - k :]) if size > k else h


def sampled(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions chosen by any LENGTH-byte string of a row, and their names."""
    h = names(data)
    if len(h) < REACH + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A position whose GRAM bytes cross a row's end is never chosen; strings that cross do not choose.
    low = _sliding(h, REACH + 1, np.minimum)
    ok = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= LENGTH:
            ok[a : b - LENGTH + 1] = True
    low = np.where(ok, low, _U(0))
    # Position i is chosen if some string start p in [i - REACH, i] has its smallest name here.
    padded = np.concatenate([np.zeros(REACH, np.uint64), low, np.zeros(REACH, np.uint64)])
    best = _sliding(padded, REACH + 1, np.maximum)[: len(h)]
    at = np.flatnonzero((best == h) & (h != 0))
    return at, h[at]


def _spans(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[lo, hi) that the strings around each position cover; not yet clipped at the document's end."""
    return np.maximum(pos - REACH, 0), pos + GRAM + REACH


CANDIDATE = "kind int, gram long, context long, doc long, at long, stop int"


def _rows(kind, gram, context, doc, at, stop) -> pa.RecordBatch:
    n = len(doc)
    full = lambda x, t: np.full(n, x, t) if np.isscalar(x) else np.asarray(x).astype(t, copy=False)
    signed = lambda x: x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else full(x, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(full(kind, np.int32)), pa.array(signed(gram)), pa.array(signed(context)), pa.array(full(doc, np.int64)), pa.array(full(at, np.int64)), pa.array(full(stop, np.int32))], ["kind", "gram", "context", "doc", "at", "stop"])


def _merge(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, hi: np.ndarray):
    """Overlapping or touching spans of one document become one."""
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, hi = doc[order], tag[order], lo[order], hi[order]
    if not len(doc):
        return doc, tag, lo, hi
    new_doc = np.ones(len(doc), bool)
    new_doc[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])
    # Running largest end within a document: shift documents apart, then one running maximum serves all.
    shift = np.cumsum(new_doc) * (int(hi.max()) + 2)
    far = np.maximum.accumulate(hi + shift)
    fresh = new_doc.copy()
    fresh[1:] |= lo[1:] + shift[1:] > far[:-1]
    first = np.flatnonzero(fresh)
    return doc[first], tag[first], lo[first], np.maximum.reduceat(hi, first)


@tidy
def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def flush():
        gram, context, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((at, doc))
        gram, context, doc, at = gram[order], context[order], doc[order], at[order]
        once = np.ones(len(doc), bool)  # rows that are there twice are one document
        once[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])
        gram, context, doc, at = gram[once], context[once], doc[once], at[once]
        pair = mix(gram * _U(0xC2B2AE3D27D4EB4F) + context)
        order = np.argsort(pair, kind="stable")
        later = np.zeros(len(pair), bool)
        later[order[1:]] = pair[order[1:]] == pair[order[:-1]]
        yield _rows(0, gram[~later], context[~later], doc[~later], at[~later], 0)
        lo, hi = _spans(at[later] >> 32)
        doc, tag, lo, hi = _merge(doc[later], at[later] & 0xFFFFFFFF, lo, hi)
        if len(doc):
            yield _rows(1, mix(doc.view(np.uint64)), 0, doc, lo << 32 | tag, hi)

    for batch in batches:
        data, offsets = text_arrays(batch["text"])
        ids, tags = batch["doc"].to_numpy(), batch["tag"].to_numpy()
        for a, b in chunks(offsets):
            part, bounds = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            at, gram = sampled(part, bounds)
            if not len(at):
                continue
            row = np.searchsorted(bounds, at, "right") - 1
            start, end = bounds[row], bounds[row + 1]
            left, right = np.maximum(at - REACH, start), np.minimum(at + GRAM + REACH, end)
            context = mix(Prefix(part).hash(left, right) + (at - left).astype(np.uint64))
            held.append((gram, context, ids[a:b][row], (at - start) << 32 | tags[a:b][row]))
            n += len(at)
            if n >= BLOCK:
                yield from flush()
                held, n = [], 0
    if held:
        yield from flush()


@tidy
def _round_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (gram, context, doc, at). Out: kind 1 spans to remove, kind 2 positions for round two."""
    held: list[np.ndarray] | None = None
    going: tuple | None = None  # the last row of a long run whose earlier rows went out

    def distinct(gram, context, doc, at):
        """Without rows that are there twice: they are one document."""
        once = np.ones(len(doc), bool)
        once[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]) | (context[1:] != context[:-1]) | (gram[1:] != gram[:-1])
        if going is not None and len(doc):
            once[0] = (gram[0], context[0], doc[0], at[0]) != going
        return gram[once], context[once], doc[once], at[once]

    def solve(gram, context, doc, at):
        nonlocal going
        if not len(gram):
            return []
        new_gram = np.ones(len(gram), bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new = new_gram.copy()
        new[1:] |= context[1:] != context[:-1]
        run = np.cumsum(new_gram) - 1
        several = np.bincount(run, new) > 1
        if going is not None and gram[0] == going[0]:
            several[0] = True
            new[0] = context[0] != going[1]
        going = None
        lo, hi = _spans(at[~new] >> 32)
        marks = _merge(doc[~new], at[~new] & 0xFFFFFFFF, lo, hi)
        probe = new & several[run]
        out = []
        if len(marks[0]):
            out.append(_rows(1, 0, 0, marks[0], marks[2] << 32 | marks[1], marks[3]))
        if probe.any():
            out.append(_rows(2, gram[probe], 0, doc[probe], at[probe], 0))
        return out

    for batch in batches:
        kind = batch["kind"].to_numpy()
        if (kind == 1).any():
            yield batch.filter(pa.array(kind == 1))
            batch = batch.filter(pa.array(kind == 0))
        if not batch.num_rows:
            continue
        now = [batch[c].to_numpy() for c in ("gram", "context", "doc", "at")]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        now = distinct(*now)
        gram = now[0]
        if not len(gram):
            continue
        other = gram[::-1] != gram[-1]
        cut = len(gram) - int(np.argmax(other)) if other.any() else 0
        if cut:
            yield from solve(*[x[:cut] for x in now])
        held = [x[cut:] for x in now]
        if len(held[0]) > HELD:
            last = tuple(x[-1] for x in held)
            yield from solve(*held) if going is not None and going[0] == last[0] else solve_long(solve, held)
            going = last
            held = None
    if held is not None:
        yield from solve(*held)


def solve_long(solve, held):
    """A run too long to hold: its rows go out as if its name had several contexts. A spare probe changes nothing."""
    gram, context, doc, at = held
    new = np.ones(len(gram), bool)
    new[1:] = context[1:] != context[:-1]
    out = [x for x in solve(gram, context, doc, at) if x["kind"][0].as_py() == 1]
    return [*out, _rows(2, gram[new], 0, doc[new], at[new], 0)]


@tidy
def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their probes become rows for round two: whole contexts, or single strings of hot names."""
    schema = ["kind", "key", "doc", "at", "left", "bytes"]
    for batch in batches:
        out: list[tuple] = []
        for text, doc, tag, probes in zip(batch["text"], batch["doc"].to_pylist(), batch["tag"].to_pylist(), batch["probes"].to_pylist(), strict=True):
            raw = text.as_py().encode()
            for probe in probes:
                pos = probe["pos"]
                lo, hi = max(0, pos - REACH), min(len(raw), pos + GRAM + REACH)
                part = raw[lo:hi]
                if not probe["hot"]:
                    out.append((0, probe["gram"], doc, pos << 32 | tag, pos - lo, part))
                else:
                    k = np.arange(len(part) - LENGTH + 1)
                    for key, p in zip(Prefix(np.frombuffer(part, np.uint8)).hash(k, k + LENGTH).view(np.int64).tolist(), (lo + k).tolist(), strict=True):
                        out.append((1, key, doc, p << 32 | tag, 0, None))
            if len(out) > 20_000:
                yield _probe_rows(out, schema)
                out = []
        if out:
            yield _probe_rows(out, schema)


def _probe_rows(out, schema):
    columns = list(zip(*out, strict=True))
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], schema)


@tidy
def _round_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (kind, key, doc, at): of equal strings all but the first are spans to remove."""
    held: list[pa.RecordBatch] = []
    first: tuple | None = None  # of single strings: (key, doc, at) of the run's first row

    def solve(table: pa.Table):
        key, doc, at, left = (table[c].to_numpy() for c in ("key", "doc", "at", "left"))
        parts = table["bytes"].combine_chunks()
        data, bounds = text_arrays(parts)
        n = np.diff(bounds) - LENGTH + 1
        row = np.repeat(np.arange(len(n), dtype=np.int32), n)
        k = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        start = bounds[:-1][row] + k
        h = Prefix(data).hash(start, start + LENGTH) ^ mix(key.view(np.uint64))[row]
        del start
        for part in range(PARTS) if len(row) > 1_000_000 else (None,):
            some = slice(None) if part is None else np.flatnonzero(h % _U(PARTS) == part)
            yield from repeats(h[some], row[some], k[some], doc, at, left)

    def repeats(h, row, k, doc, at, left):
        doc, tag, p = doc[row], at[row] & 0xFFFFFFFF, (at >> 32)[row] - left[row] + k
        order = np.lexsort((tag, p, doc, h))
        h, doc, tag, p = h[order], doc[order], tag[order], p[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        origin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        gone = (doc != doc[origin]) | (p != p[origin]) | (tag != tag[origin])
        doc, tag, lo, hi = _merge(doc[gone], tag[gone], p[gone], p[gone] + LENGTH)
        if len(doc):
            yield _rows(1, 0, 0, doc, lo << 32 | tag, hi)

    for batch in batches:
        kind = batch["kind"].to_numpy()
        single = batch.filter(pa.array(kind == 1))
        whole = batch.filter(pa.array(kind == 0))
        if whole.num_rows:
            held.append(whole)
            key = whole["key"].to_numpy()
            rows = sum(x.num_rows for x in held)
            if rows >= 4096 and (key != key[-1]).any():
                table = pa.Table.from_batches(held)
                keys = table["key"].to_numpy()
                cut = len(keys) - int(np.argmax(keys[::-1] != keys[-1]))
                yield from solve(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
        if single.num_rows:
            key, doc, at = (single[c].to_numpy() for c in ("key", "doc", "at"))
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            gone = (doc != doc[begin]) | (at != at[begin])
            if first is not None and key[0] == first[0]:
                run = key == key[0]
                gone[run] = (doc[run] != first[1]) | (at[run] != first[2])
            else:
                first = None
            if first is None or key[-1] != first[0]:
                first = key[-1], doc[begin[-1]], at[begin[-1]]
            if gone.any():
                p = at[gone] >> 32
                d, t, lo, hi = _merge(doc[gone], at[gone] & 0xFFFFFFFF, p, p + LENGTH)
                yield _rows(1, 0, 0, d, lo << 32 | t, hi)
    if held:
        yield from solve(pa.Table.from_batches(held))


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what stays."""
    merged: list[list[int]] = []
    for lo, hi in sorted(spans):
        hi = min(hi, len(text))
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        elif lo < hi:
            merged.append([lo, hi])
    kept, at = [], 0
    for lo, hi in merged:
        kept.append(text[at:lo])
        at = hi
    kept.append(text[at:])
    return sum(hi - lo for lo, hi in merged), len(merged), b"".join(kept)


@tidy
def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for text, spans in zip(batch["text"], batch["spans"].to_pylist(), strict=True):
            raw = text.as_py().encode()
            removed, runs, kept = kept_bytes(raw, [(x["lo"], x["hi"]) for x in spans or ()])
            found.append((len(raw), removed, runs, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
        columns = list(zip(*found, strict=True)) if found else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (broken characters at cuts are replaced in it) of each document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # Both joins below read this with the same columns and keys, so Spark shuffles the texts once.
    none = F.col("doc_id").isNull()
    tagged = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text, none).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("tag"), none.alias("none"), text.alias("text"))
    deal = lambda df, *by: df.repartition(partitions(spark), by[0]).sortWithinPartitions(*by)
    candidates = tagged.mapInArrow(_scan, CANDIDATE)
    named = materialise(deal(candidates, "gram", "context", "doc", "at").mapInArrow(_round_one, CANDIDATE))
    probes = named.where("kind = 2").select("gram", "doc", "at").distinct()
    hot = probes.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("gram", F.lit(True).alias("hot"))
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    by_doc = probes.join(hot, "gram", "left").select("doc", low("at").alias("tag"), F.struct("gram", F.shiftright("at", 32).alias("pos"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("probe"))
    by_doc = by_doc.groupBy("doc", "tag").agg(F.collect_list("probe").alias("probes"))
    contexts = tagged.join(by_doc, ["doc", "tag"]).mapInArrow(_contexts, "kind int, key long, doc long, at long, left int, bytes binary")
    again = contexts.repartition(partitions(spark), "key").sortWithinPartitions("kind", "key", "doc", "at").mapInArrow(_round_two, CANDIDATE)
    spans = named.where("kind = 1").unionByName(again).select("doc", low("at").alias("tag"), F.struct(F.shiftright("at", 32).alias("lo"), F.col("stop").cast("long").alias("hi")).alias("span"))
    by_doc = spans.groupBy("doc", "tag").agg(F.collect_list("span").alias("spans"))
    return tagged.join(by_doc, ["doc", "tag"], "left").select(F.when(~F.col("none"), F.col("doc")).alias("doc_id"), "text", "spans").mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")


def repeat_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept_text")
