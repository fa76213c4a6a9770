import hashlib
import random

import pytest

from gridloom.llm import suffix_dedup

N = 100


def brute(rows):
    """Rows in order of doc_id; equal rows count as one document."""
    out, seen = {}, set()
    for i, t in sorted({(2**63 if i is None else i, t or "") for i, t in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - N + 1):
            w = b[p : p + N]
            if w in seen:
                gone[p : p + N] = b"\1" * N
            seen.add(w)
        runs = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return sorted([(i, *out[2**63 if i is None else i]) for i, _ in rows], key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(6)]
    rows = []
    for _ in range(40):
        parts = [rng.choice(passages)[rng.randrange(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(1, 6))]
        rows.append(" ".join(parts))
    rows += ["a" * 500, "a" * 350, "ab" * 200, "abc" * 150 + "x" + "abc" * 150, "", None, "short", passages[0][:99], passages[0][:100], rows[3], rows[3] + "!"]
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows))


def got(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(docs, seed):
    rows = corpus(seed)
    assert got(suffix_dedup.repeat_report(docs(rows))) == sorted(brute(rows), key=str)


def test_small_limits(docs, monkeypatch):
    """Blocks, held rows and hot names so small that every path is taken: the result is the same."""
    for name, value in (("BLOCK", 20), ("HOT", 2), ("HELD", 3)):
        monkeypatch.setattr(suffix_dedup, name, value)
    rows = corpus(3)
    assert got(suffix_dedup.repeat_report(docs(rows))) == sorted(brute(rows), key=str)


def test_edges(docs):
    assert suffix_dedup.repeat_report(docs([])).count() == 0
    rows = [(1, "z" * 99), (2, None), (None, "q" * 300), (5, "r" * 100 + "q" * 120), (5, "r" * 100 + "q" * 120)]
    assert got(suffix_dedup.repeat_report(docs(rows))) == sorted(brute(rows), key=str)
    # Without overlap between documents a passage is kept once and goes elsewhere.
    text = " ".join(f"word{k}" for k in range(60))
    again = suffix_dedup.remove_repeats(docs([(1, text), (2, "x " + text + " y")])).orderBy("doc_id").collect()
    assert again[0]["kept_text"] == text
    assert (again[1]["kept_text"], again[1]["n_spans"]) == ("x  y", 1)


def test_largest_id_beside_null(docs):
    """2**63 - 1 is an id like any other; of it and a null id the earlier start counts."""
    rows = [(2**63 - 1, "p" * 150), (None, "x" + "p" * 150), (7, "q" * 40)]
    out = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.repeat_report(docs(rows)).collect()}
    assert out == {2**63 - 1: (150, 149), None: (151, 150), 7: (40, 0)}


def test_very_long_text(docs):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(400_000))
    out = {r["doc_id"]: r for r in suffix_dedup.repeat_report(docs([(1, text), (2, text[1_000_000:1_000_400] + "!")])).collect()}
    assert out[1]["n_removed"] == 0 and (out[2]["n_bytes"], out[2]["n_removed"], out[2]["n_spans"]) == (401, 400, 1)
