import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import packing, quality, tokens

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [
    None, "", "  \n\t", "one", "the same line\nthe same line\n\nother\nthe same line", "a b c d e f g h " * 4, "### $$$ %x% é|è <tag> & *", " ".join(f"w{k}" for k in range(40)),
    "x y z", "lead\x0bmid\x0cend", " ".join(["one two three four five six seven eight nine ten"] * 2 + [f"q{k}" for k in range(30)]), "long " * 30000,
]


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_against_brute_force(docs, labels):
    rows = list(enumerate(TEXTS)) + [(None, "null id")]
    got = {r["doc_id"]: r for r in quality.quality(docs(rows), labels([(7, 1, 0), (7, 1, 0), (None, 1, 0), (99, 1, 0), (1, None, 0)])).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        r, c = got[i], counts(t)
        assert tuple(r[x] for x in quality.COUNTS) == c
        assert r["base_failed"] == (c[0] < 20 or 100 * c[4] > 30 * c[0])
        assert not (r["base_failed"] and r["kept"])


def test_ratio_against_brute_force(docs, labels):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"{'good' if i % 3 else 'junk'}{rng.integers(30)}" for _ in range(60))) for i in range(60)]
    marks = labels([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)])
    got = {r["doc_id"]: r for r in quality.quality(docs(rows), marks).collect()}
    grams = {i: t.split() + list(zip(t.split(), t.split()[1:])) for i, t in rows}
    raw, good = Counter(g for x in grams.values() for g in x), Counter(g for i, x in grams.items() if i % 2 == 0 and i % 3 for g in x)
    part = sum(good.values()) / sum(raw.values())
    for i, x in grams.items():
        want = np.mean([np.log((good[g] + quality.PSEUDO * part) / ((raw[g] + quality.PSEUDO) * part)) for g in x])
        assert got[i]["log_ratio"] == pytest.approx(want, abs=0.03)  # n-grams that share a bucket
        assert got[i]["kept"] == (got[i]["log_ratio"] >= quality.THRESHOLD)
    assert quality.drop_bad(docs(rows), marks).count() == sum(r["kept"] for r in got.values())


def test_no_trusted_document_and_empty_table(docs, labels):
    assert [r["log_ratio"] for r in quality.quality(docs([(1, TEXTS[7])]), labels([])).collect()] == [0.0]
    assert quality.quality(docs([]), labels([])).count() == quality.drop_bad(docs([]), labels([])).count() == 0


def test_target_counts_every_trusted_document(spark):
    """With all documents trusted both multinomials are one, however many there are (once the target had 500,000 at most)."""
    docs = spark.range(600_000).selectExpr("id as doc_id", "concat('w', id % 40) as text")
    assert not quality.log_ratios(docs, docs.selectExpr("doc_id", "1 as quality")).any()


@pytest.fixture(scope="module")
def vocabulary():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizer(vocabulary):
    import pyarrow as pa
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    whole.encode_special_tokens = True
    rng = np.random.default_rng(4)
    alphabet = list("ab1 \n\t.,!é²٣ 　日́#'s\r")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 40))) for _ in range(3000)] + ["", "it's we'll", " 's", "<|endoftext|> x", "  lead", "tail  \n"]
    got = [x.tolist() for x in tokens._encode(pa.array(texts), vocabulary)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_packing_round_trip(docs, vocabulary):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "one"), (None, "null id")] + [(100 + k, " ".join(f"t{k}x{j}" for j in range(k * 7 % 300))) for k in range(150)]
    pieces = packing.packed(docs(rows), tokens.byte_bpe(vocabulary)).collect()
    encoding = tokens._encoding(vocabulary)
    want = Counter()
    for i, t in rows:
        want[i, tuple([*encoding.encode_ordinary(t or ""), 0])] += 1
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    for (i, ids), times in want.items():
        # Pieces of this text: each id lies in as many as there are rows of the document.
        own = [p for p in by_doc[i] if p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes())]
        held = Counter(k for p in own for k in range(p["start"], p["start"] + p["length"]))
        assert held == dict.fromkeys(range(len(ids)), times)
    assert sum(p["length"] for p in pieces) == sum(len(ids) * times for (_, ids), times in want.items())
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert at == 1024 or at < 1024 and at & (at - 1) == 0
    assert packing.packed(docs([]), tokens.byte_bpe(vocabulary)).count() == 0


def test_least_squares_rule():
    """Each placement leaves the smallest sum of squared counts among all levels and a new window."""
    rng = np.random.default_rng(2)
    packer = packing.Packer(16)
    for _ in range(400):
        size = int(rng.integers(1, 16))
        before = packer.count.copy()
        options = []
        for h in range(16 - size + 1):
            if h == 0 or before[h]:
                c = before.copy()
                if h:
                    c[h] -= 1
                if h + size < 16:
                    c[h + size] += 1
                options.append(int((c**2).sum()))
        list(packer.add((("d", size), 0, np.zeros(size, np.uint32))))
        assert int((packer.count**2).sum()) == min(options)


def test_windows_that_nothing_fills():
    """Rests of which no two fit together stay in open windows until the end."""
    packer, full = packing.Packer(16), []
    for k in range(200):
        full += list(packer.add(((k, 9), 0, np.full(9, k, np.uint32))))
    assert not full and packer.count[9] == 200
    full += list(packer.lay_out())
    sizes = [sum(len(p[2]) for p in w) for w in full]
    assert sum(sizes) == 1800 and all(s == 16 for s in sizes[:-3]) and all(s & (s - 1) == 0 for s in sizes)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the given tables are not here")
def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names, name
        assert out.count() > 0
        docs = out
    assert pipeline.run(spark, sf).count() > 0
