import hashlib
import random
import zlib

import numpy as np
import pytest

from gridloom.llm import periodic_runs as pr


def brute_runs(x, least_words, least_periods):
    n, out = len(x), set()
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if x[i] != x[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and x[i] == x[i + p]:
                i += 1
            length = i - s + p
            if length >= max(2 * p, least_words, least_periods * p) and not any(all(x[k] == x[k + q] for k in range(s, s + length - q)) for q in range(1, p)):
                out.add((s, length, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(count, seed):
    rng = random.Random(seed)
    for _ in range(count):
        n, k = rng.randint(0, 40), rng.choice([1, 2, 2, 3, 5])
        x = [rng.randrange(k) for _ in range(n)]
        if n > 3 and rng.random() < 0.5:
            a, p = rng.randrange(n), rng.randint(1, n // 2)
            x = [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]
        yield x


def test_next_smaller_suffixes_and_extensions():
    for x in sequences(4000, 1):
        smaller, common = pr.Lyndon(x).edges()
        for i in range(len(x)):
            j = next((j for j in range(i + 1, len(x)) if x[j:] < x[i:]), len(x))
            assert smaller[i] == j
            assert common[i] == next((k for k in range(len(x) - j) if x[i + k] != x[j + k]), len(x) - j)


@pytest.mark.parametrize("least", [(6, 4), (2, 2), (3, 3)])
def test_runs_against_brute_force(least):
    for x in sequences(4000, 2):
        assert pr.runs_of(x, *least) == brute_runs(x, *least)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


SHAPES = {
    "fibonacci": (fibonacci, 6), "one word": (lambda n: [1] * n, 6), "one word, then a larger": (lambda n: [1] * (n - 1) + [2], 6), "pairs inside a period": (lambda n: ([0, 0, 1] * n)[: n - 1] + [5], 6),
    "random": (lambda n: np.random.default_rng(0).integers(0, 2, n).tolist(), 8), "thue-morse": (lambda n: [i.bit_count() & 1 for i in range(n)], 10),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_words_compared_grow_with_the_text(shape):
    make, most = SHAPES[shape]
    for n in (5000, 40_000):
        for sign in (1, -1):
            lyndon = pr.Lyndon([sign * v for v in make(n)])
            lyndon.edges()
            assert lyndon.compared < most * n


def brute_report(words):
    runs = brute_runs(words, 6, 4)
    best = None
    for s, n, p in runs:
        if best is None or n * best[2] > best[1] * p:
            best = (s, n, p)
    dropped = {k for s, n, p in runs for k in range(s + p, s + n)}
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, digest("".join(f"{s},{n},{p}\n" for s, n, p in runs)), digest(kept))


def texts(count):
    rng = random.Random(9)
    out = []
    for k in range(count):
        n = rng.randint(0, 60)
        alphabet = rng.choice([["a", "b"], ["a", "a\x00", "b", "é"], ["longer than sixteen bytes".replace(" ", "-") + c for c in "xyz"] + ["s"], [f"w{i}" for i in range(200)]])
        w = [rng.choice(alphabet) for _ in range(n)]
        if k % 2 and n > 8:
            a, p = rng.randrange(n // 2), rng.randint(1, 5)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        out.append(rng.choice([" ", "\n", "\t \x0b", " "]).join(w) + rng.choice(["", " ", "\n"]))
    return out


def test_report_against_brute_force(docs):
    rows = [(k, t) for k, t in enumerate(texts(400))] + [(500, None), (501, ""), (502, " \n "), (None, "x " * 9), (503, "again " * 7), (503, "again " * 7)]
    got = sorted((r for r in pr.run_report(docs(rows)).collect()), key=lambda r: (r[0] is None, r[0] or 0))
    assert [tuple(r)[1:] for r in got] == [brute_report((t or "").split()) for _, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))]
    assert pr.run_report(docs([])).count() == 0


def test_ties_take_the_first_start_and_then_the_smaller_period(spark):
    runs = spark.sql("select array(named_struct('start', 9L, 'length', 8L, 'period', 2L), named_struct('start', 20L, 'length', 4L, 'period', 1L), named_struct('start', 30L, 'length', 13L, 'period', 3L)) as runs")
    assert tuple(runs.select(pr.longest(runs["runs"]).alias("b")).first()["b"]) == (30, 13, 3)
    two = runs.selectExpr("slice(runs, 1, 2) as runs")
    assert tuple(two.select(pr.longest(two["runs"]).alias("b")).first()["b"]) == (9, 8, 2)


def test_very_long_text(docs):
    rng = random.Random(3)
    w = [f"w{rng.randrange(50)}" for _ in range(120_000)] + ["p", "q", "r"] * 60_000
    found = pr.periodic_runs(docs([(1, " ".join(w)), (2, "y" * 3_000_000), (3, "z" * 100 + " " + " ".join(["z" * 100] * 6))])).orderBy("doc_id").collect()
    assert tuple(found[0]["runs"][-1]) == (120_000, 180_000, 3) and len(found[0]["collapsed"].split()) <= 120_003
    assert not found[1]["runs"] and found[1]["collapsed"] == "y" * 3_000_000
    assert [tuple(r) for r in found[2]["runs"]] == [(0, 7, 1)]


def test_query_on_repeated_tails_against_brute_force(docs):
    rows = [(k, t) for k, t in enumerate(texts(600))] + [(None, "no id " * 9)]
    want = {}
    for i, t in rows:
        w = t.split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want[i] = brute_report(w)
    got = {r["doc_id"]: tuple(r)[1:] for r in pr.run_report(pr.with_tails(docs(rows))).collect()}
    assert got == want
