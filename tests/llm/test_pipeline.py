"""The pipeline against a brute-force version of every stage, on rows with nulls, empty and long texts, copies, near copies and clashing columns."""

import hashlib
import importlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from test_jaccard_join import brute, mutated

from gridloom.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus():
    rng = random.Random(11)
    good, junk = [f"good{k}" for k in range(400)], [f"junk{k}" for k in range(400)]
    rows = []
    for k in range(60):
        words = [rng.choice(junk if k % 6 == 0 else good) for _ in range(rng.randrange(60, 160))]
        rows.append((k, " ".join(words), f"src{k % 3}" if k % 5 else None))
        if k % 4 == 0:
            rows.append((100 + k, "  ".join(words), "src0"))  # an exact copy
        if k % 7 == 0:
            rows.append((200 + k, mutated(rng, words, 1), "src1"))  # a near copy
    rows += [(300, None, "src1"), (301, "", "src2"), (302, "too short", "src0"), (303, "again and again " * 40, "src0"), (304, " ".join(rng.choice(good) for _ in range(20000)), "src2")]
    rows += [rows[2], (None, " ".join(rng.choice(good) for _ in range(70)), "src1")]
    labels = [(k, int(k % 6 != 0), 0) for k in range(0, 60, 2)] + [(None, 1, 0), (999, 1, 1)]
    return rows, labels


def judged(rows, labels):
    """Rows that the rules keep, by n-grams that are not hashed."""
    grams = [(w := WORD.findall(t or "")) + list(zip(w, w[1:])) for _, t, _ in rows]
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    raw, target = Counter(g for x in grams for g in x), Counter(g for (i, _, _), x in zip(rows, grams, strict=True) if i in trusted for g in x)
    part = sum(target.values()) / sum(raw.values())
    out = []
    for row, x in zip(rows, grams, strict=True):
        w = WORD.findall(row[1] or "")
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeated = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        if len(w) < 20 or 100 * len(repeated) > 30 * len(w):
            continue
        score = np.mean([np.log((target[g] + quality.PSEUDO * part) / ((raw[g] + quality.PSEUDO) * part)) for g in x])
        assert abs(score - quality.THRESHOLD) > 0.02  # far from the threshold, so that shared buckets do not matter
        if score >= quality.THRESHOLD:
            out.append(row)
    return out


def without_copies(rows):
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r in sorted(rows, key=order):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    return list(first.values())


def without_near_copies(rows):
    groups = {i: c for i, _, c, _ in brute([(i, t) for i, t, _ in rows])}
    return [r for r in rows if groups[r[0]] == r[0]]


def served(rows):
    """How often each id is read: earliest deadline first until every block has been read once."""
    by = {}
    for i, _, s in rows:
        by.setdefault((s or "", s is None), []).append(i)
    key = lambda i: (int(hashlib.md5(str("" if i is None else i).encode()).hexdigest()[:8], 16) % mixing.BUCKETS, i is not None, i or 0)
    names = sorted(by)
    blocks = [[sorted(by[n], key=key)[k : k + mixing.BLOCK_DOCS] for k in range(0, len(by[n]), mixing.BLOCK_DOCS)] for n in names]
    whole = mixing.whole_weights([len(by[n]) ** mixing.TEMPER for n in names])
    total, had, t, times = sum(whole), [0] * len(names), 0, Counter()
    while any(h < len(b) for h, b in zip(had, blocks, strict=True)):
        pick = min((-(-(h + 1) * total // w), i) for i, (h, w) in enumerate(zip(had, whole, strict=True)) if h * total // w <= t)[1]
        times.update(blocks[pick][had[pick] % len(blocks[pick])])
        had[pick] += 1
        t += 1
    return times


@pytest.fixture
def folder(spark, tmp_path):
    rows, labels = corpus()
    full = [(i, t, "en", s, len(t or ""), "x", "y") for i, t, s in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, Slot string, name string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_against_brute_force(spark, folder):
    pytest.importorskip("public_tokenizers")
    pipeline = importlib.import_module("corpus_pipeline")
    rows, labels = corpus()
    kept = judged(rows, labels)
    single = without_copies(kept)
    last = without_near_copies(single)
    assert len(rows) > len(kept) > len(single) > len(last) > 30
    times = served(last)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").collect())
    for (_, stage), want in zip(pipeline.STAGES, (Counter(r[0] for r in kept), Counter(r[0] for r in single), Counter(r[0] for r in last), times), strict=False):
        docs = stage(spark, docs, folder)
        assert docs.columns == names and ids(docs) == want
    pieces = pipeline.run(spark, folder).collect()
    tokens = Counter()
    for p in pieces:
        tokens[p["doc_id"], p["doc_tokens"]] += p["length"]
    assert {i: n // size for (i, size), n in tokens.items()} == dict(times) and all(n % size == 0 for (_, size), n in tokens.items())


def test_empty_table(spark, folder, tmp_path):
    pytest.importorskip("public_tokenizers")
    pipeline = importlib.import_module("corpus_pipeline")
    none = f"{tmp_path}/none"
    for t in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{t}.parquet").where("false").write.parquet(f"{none}/{t}.parquet")
    assert pipeline.run(spark, none).count() == 0
