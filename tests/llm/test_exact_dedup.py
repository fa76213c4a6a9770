import hashlib
import random
import re

from gridloom.llm import exact_dedup


def brute(rows):
    flat = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in flat:
        same = [j for j, u in flat if u == t]
        numbers = [j for j in same if j is not None]
        out.append((i, min(numbers) if numbers else None, len(same), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [(5, "a b"), (3, "a\t\n b"), (9, "a  b"), (2, None), (7, ""), (4, " "), (8, "\n"), (1, "é" * 70000), (6, "é" * 70000), (None, "a b"), (None, "only"), (11, "a b")]


def test_against_brute_force(docs):
    rng = random.Random(3)
    rows = CASES + [(100 + k, rng.choice(["x y", "x  y", "z", "w w"]) * rng.randrange(1, 3)) for k in range(200)]
    got = exact_dedup.exact_duplicates(docs(rows)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows)
    for r in got:
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_repeated_rows_keep_one(docs):
    rows = [(1, "a"), (1, "a"), (2, "a"), (1, "b")]
    got = exact_dedup.exact_duplicates(docs(rows)).collect()
    assert sorted((r["doc_id"], r["kept"]) for r in got) == [(1, False), (1, True), (1, True), (2, False)]
    kept = exact_dedup.drop_copies(docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a"), (1, "b")] and "Name" in kept.columns


def test_empty(docs):
    assert exact_dedup.exact_duplicates(docs([])).count() == exact_dedup.drop_copies(docs([])).count() == 0


def test_hot_groups_and_largest_id(docs, monkeypatch):
    """Entries of hot groups are broadcast; the largest number is an id like others, and null ids come after it."""
    monkeypatch.setattr(exact_dedup, "HOT_GROUP", 3)
    big = 2**63 - 1
    rows = [(k, "hot  text") for k in range(20, 40)] + [(big, "b"), (None, "b"), (None, "c"), (None, "c"), (big, "c"), (1, "alone")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(docs(rows)).collect()), key=str)
    want = [(k, 20, 20, k == 20) for k in range(20, 40)] + [(big, big, 2, True), (None, big, 2, False), (None, big, 3, False), (None, big, 3, False), (big, big, 3, True), (1, 1, 1, True)]
    assert got == sorted(want, key=str)
    kept = sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.drop_copies(docs(rows)).collect())
    assert kept == sorted([("20", "hot  text"), (str(big), "b"), (str(big), "c"), ("1", "alone")])
