import random
import re

import numpy as np
import pytest

from gridloom.llm import jaccard_join


def sets(rows):
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def brute(rows):
    s = sets(rows)
    root, links = list(range(len(s))), [0] * len(s)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(s)):
        for b in range(a):
            if s[a][1] and s[b][1] and 100 * len(s[a][1] & s[b][1]) >= 75 * len(s[a][1] | s[b][1]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    out = []
    for a, (i, items) in enumerate(s):
        ids = [s[b][0] for b in range(len(s)) if find(b) == find(a) and s[b][0] is not None]
        out.append((i, len(items), min(ids) if ids else None, links[a]))
    return sorted(out, key=str)


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed=5):
    rng = random.Random(seed)
    rows, passage = [], " ".join(f"p{k}" for k in range(60))
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([3, 6, 30, 120, 300]))]
        rows += [mutated(rng, base, k) for k in range(rng.choice([1, 2, 6]))]
        if rng.random() < 0.5:
            rows.append(passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90))))
    rows += [" ".join(base), "", None, " \n", "one two", "ONE  two", "one two three four five", "One two three four FIVE", passage, passage]
    return [(k * 3 % 101, t) for k, t in enumerate(rows)]


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in df.collect()), key=str)


def test_against_brute_force(docs):
    rows = corpus()
    assert got(jaccard_join.near_duplicates(docs(rows))) == brute(rows)


@pytest.mark.parametrize("rows_of_place, shingles_of_place", [(3, 10**6), (4096, 100)])
def test_places_in_blocks_and_frequent_shingles(docs, monkeypatch, rows_of_place, shingles_of_place):
    """Places dealt out as pairs of blocks, small portions, all shared shingles frequent: the result is the same."""
    monkeypatch.setattr(jaccard_join, "PLACE_ROWS", rows_of_place)
    monkeypatch.setattr(jaccard_join, "PLACE_SHINGLES", shingles_of_place)
    monkeypatch.setattr(jaccard_join, "OFTEN", 2)
    monkeypatch.setattr(jaccard_join, "PLAIN", 1)
    rows = corpus(9)
    assert got(jaccard_join.near_duplicates(docs(rows))) == brute(rows)


def test_empty_and_repeated(docs):
    assert jaccard_join.near_duplicates(docs([])).count() == 0
    rows = [(4, "a b c d e f g"), (4, "a b c d e f g"), (4, "other words entirely"), (None, "a b c d e f g"), (None, "x y")]
    assert got(jaccard_join.near_duplicates(docs(rows))) == brute(rows)
    assert jaccard_join.drop_near_copies(docs(rows[:1] + [(7, "A B c d e f g")])).count() == 1


def test_only_the_near_copy_of_an_id_is_dropped(docs):
    """Other texts of its id stay; a null id loses to any other, and one row of null ids stays."""
    rows = [(4, "a b c d e f g"), (7, "A b c d e f g"), (7, "other words entirely"), (None, "a b c d e f G"), (None, "p q r s t u"), (None, "P q r s t u"), (None, "x y"), (8, None), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.drop_near_copies(docs(rows)).collect()]
    assert sorted(map(str, kept)) == sorted(map(str, [rows[0], rows[2], *rows[6:], next(k for k in kept if k in rows[4:6])]))


@pytest.mark.parametrize("seed", range(5))
def test_tree_finds_every_pair_that_its_bounds_allow(seed):
    rng = np.random.default_rng(seed)
    points = rng.poisson(2.0, (300, jaccard_join.GROUPS)).astype(np.int32)
    points[150:] = points[:150] + (rng.random((150, jaccard_join.GROUPS)) < 0.05)
    sizes = points.sum(1).astype(np.int64)
    pairs = [(p, q) for x, y in jaccard_join.Tree(points, rng.integers(0, 40, 300)).pairs() for p, q in zip(x.tolist(), y.tolist(), strict=True)]
    assert len({(min(x), max(x)) for x in pairs}) == len(pairs)
    for p in range(300):
        fits = (4 * np.minimum(sizes, sizes[p]) >= 3 * np.maximum(sizes, sizes[p])) & (np.minimum(points, points[p]).sum(1) >= jaccard_join.need(sizes, sizes[p]))
        assert {q for q in np.flatnonzero(fits) if q != p} == {q for x in pairs if p in x for q in x if q != p}


@pytest.mark.parametrize("seed", range(20))
def test_linking_sets_share_an_early_couple(seed):
    """Sets made from one another with as much lost and added as a link allows, some shingles frequent."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(2, 60), dtype=np.uint64)
        lost, added = rng.integers(0, len(a) // 3 + 1), rng.integers(0, len(a) // 3 + 1)
        b = np.concatenate([a[lost:], rng.integers(0, 2**63, added, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        often = np.sort(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and len(a) != both:
            assert len(np.intersect1d(jaccard_join.couples(a, often), jaccard_join.couples(b, often)))


@pytest.mark.parametrize("seed", range(20))
def test_linking_sets_share_an_early_triple(seed):
    """In any order; of sets below nine shingles a couple will do."""
    rng = np.random.default_rng(seed)
    for _ in range(200):
        a = rng.integers(0, 2**63, rng.integers(2, 60), dtype=np.uint64)
        lost, added = rng.integers(0, len(a) // 3 + 1), rng.integers(0, len(a) // 3 + 1)
        b = np.concatenate([a[lost:], rng.integers(0, 2**63, added, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        often = np.sort(rng.choice(a, rng.integers(0, len(a) + 1), replace=False))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both) and len(a) != both:
            assert len(np.intersect1d(jaccard_join.triples(a, often, seed % 2), jaccard_join.triples(b, often, seed % 2)))


def flat(sets):
    return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])


@pytest.mark.parametrize("marks, marked", [(1, 1), (7, 1 << 11), (1 << 15, 3), (1 << 15, 1 << 11)])
def test_early_couples(monkeypatch, marks, marked):
    """Against sets of couples, with few and many marked at a time."""
    monkeypatch.setattr(jaccard_join, "MARKS", marks)
    monkeypatch.setattr(jaccard_join, "MARKED", marked)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 90, rng.integers(1, 40)).astype(np.uint64)) for _ in range(45)]
    times = {x: sum(x in y for y in sets) for x in range(90)}
    lists = [sorted(x.tolist(), key=lambda v: (times[v], v)) for x in sets]
    couples = [set(list(zip(x, x[1:], strict=False))[: len(x) // 2 + 1]) for x in lists]
    found = np.unpackbits(jaccard_join.early_couples(*flat(sets), 45), axis=1, bitorder="little")
    assert not found[:, 45:].any()
    for p in range(45):
        for q in range(p):
            assert found[p, q] == found[q, p] == bool(couples[p] & couples[q])


def test_tree_that_keeps_couples_finds_every_link():
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**63, rng.integers(2, 80), dtype=np.uint64)
        for _ in range(rng.integers(1, 12)):
            keep = base[rng.random(len(base)) > 0.1]
            sets.append(np.unique(np.concatenate([keep, base[:2], rng.integers(0, 2**63, rng.integers(0, 4), dtype=np.uint64)])))
    tree = jaccard_join.Tree(np.stack([jaccard_join.point_of(x) for x in sets]), np.array([x[0] for x in sets]))
    tree.keep(*flat(sets))
    pairs = {(min(a, b), max(a, b)) for x, y in tree.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    for p in range(len(sets)):
        for q in range(p):
            both = len(np.intersect1d(sets[p], sets[q]))
            if both >= jaccard_join.need(len(sets[p]), len(sets[q])) and both < max(len(sets[p]), len(sets[q])):
                assert (q, p) in pairs


def chained(n, shared=3, seed=0):
    """Texts of 240 words, ``shared`` passages of 20 words among them, every passage in about six texts."""
    rng = random.Random(seed)
    passages = [[f"q{rng.randrange(10**9)}" for _ in range(20)] for _ in range(n * shared // 6)]
    out = []
    for k in range(n):
        words = [f"u{rng.randrange(10**9)}" for _ in range(240 - 20 * shared)]
        for _ in range(shared):
            at = rng.randrange(len(words))
            words[at:at] = rng.choice(passages)
        out.append((k, " ".join(words)))
    return out


@pytest.mark.parametrize("shared", [3, 9])
def test_work_on_chained_passages_grows_with_the_documents(shared):
    """Pairs of points and nodes that are bounded, for texts that share passages without being near copies; none where passages are less than half of a text."""
    import pyarrow as pa

    work = []
    for n in (800, 1600, 3200):
        sets = list(jaccard_join.sets_of(pa.array([t for _, t in chained(n, shared)])))
        tree = jaccard_join.Tree(np.stack([jaccard_join.point_of(x) for x in sets]), np.array([x[0] for x in sets]))
        tree.keep(*flat(sets))
        assert not list(tree.pairs())
        work.append(tree.bounded)
    assert (shared == 3) == (work[0] == 0)
    assert work[1] <= 2.3 * work[0] and work[2] <= 2.3 * work[1]


def test_chained_places_are_split_before_they_are_dealt(spark, docs, monkeypatch):
    """A place of most documents falls apart; sets sent to the tasks at most double with the documents, and links inside it stay."""
    monkeypatch.setattr(jaccard_join, "PLACE_ROWS", 64)
    rows, sent = [], []
    split = jaccard_join.split

    def counted(*args):
        out = split(*args)
        sent.append((args[0].count(), out.count(), jaccard_join.crowded(out).count()))
        return out

    monkeypatch.setattr(jaccard_join, "split", counted)
    for n in (800, 1600):
        rows = chained(n)
        rng = random.Random(3)
        rows += [(n + k, mutated(rng, rows[k][1].split(), 3)) for k in range(0, 40, 4)]
        sent.clear()
        table = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs(rows)).collect()}
        for k in range(n):
            assert (table[k]["n_links"], table[k]["component_id"]) == (int(k < 40 and k % 4 == 0), k)
        assert len(sent) == 1 and sent[0][0] > n // 4 and sent[0][1] < sent[0][0] // 2 and sent[0][2] == 0


@pytest.mark.parametrize("columns", [64, 128, 1 << 14])
def test_overlaps(monkeypatch, columns):
    monkeypatch.setattr(jaccard_join, "COLUMNS", columns)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 700, rng.integers(1, 400)).astype(np.uint64)) for _ in range(30)]
    p, q = np.triu_indices(30, 1)
    found = jaccard_join.overlaps(np.concatenate(sets), np.repeat(np.arange(30), [len(x) for x in sets]), 30, p, q)
    assert found.tolist() == [len(np.intersect1d(sets[i], sets[j])) for i, j in zip(p, q, strict=True)]


def test_large_group_of_near_copies(spark, docs):
    """A row for each class leaves the places, however many pairs link; all links are counted."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(60)]
    rows = [(k, mutated(rng, base, 1)) for k in range(5000)]
    rows += [(5000 + k, t) for k, (_, t) in enumerate(rows[:10])]
    sets = [rows[k][1].split() for k in range(len(rows))]
    table = {(r["doc_id"]): r for r in jaccard_join.near_duplicates(docs(rows)).collect()}
    assert {r["component_id"] for r in table.values()} == {0}
    for k in (0, 7, 4999, 5003):
        mine = sets_of_words(sets[k])
        linked = sum(1 for j, x in enumerate(sets) if j != k and 100 * len(mine & (y := sets_of_words(x))) >= 75 * len(mine | y))
        assert table[k]["n_links"] == linked


def sets_of_words(w):
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def test_very_long_text(docs):
    """Texts beyond the pieces in which they are hashed, with one word longer than a piece."""
    rng = random.Random(2)
    words = [f"v{rng.randrange(10**6)}" for _ in range(300_000)] + ["x" * 1_500_000] + [f"v{k}" for k in range(200_000)]
    near = list(words)
    for k in range(0, len(near), 200):
        near[k] = "changed"
    rows = [(5, " ".join(words)), (3, " ".join(near)), (9, "short text of seven words in all")]
    assert got(jaccard_join.near_duplicates(docs(rows))) == brute(rows)


def test_rows_that_leave_the_places():
    """At most one row for each class of a place."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    import pyarrow as pa

    sets = list(jaccard_join.sets_of(pa.array([mutated(rng, base, 1) for _ in range(2000)])))
    one = pa.RecordBatch.from_pydict({"root": [1] * 2000, "i": [0] * 2000, "j": [0] * 2000, "side": [0] * 2000, "name": list(range(2000)), "copies": [1] * 2000, "items": pa.array([x.tobytes() for x in sets], pa.binary())})
    assert sum(x.num_rows for x in jaccard_join._places(iter([one]))) == 2000
