import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from gridloom.llm import language, toxicity

WORDS = {"en": "the house of and in water that with from there", "fr": "la maison de et dans été que avec pour où", "de": "das haus und von für über nicht mit schön größe"}


def sample(seed, n, lang):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture
def corpus(spark):
    rows = [(k, sample(k, 40, lang), lang) for k, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(900, None, "en"), (901, "", "fr"), (902, "12 34 ,.", "de"), (903, "été", None), (904, "ж", "en"), (None, "the house", "en"), (905, "the " * 40000, None), (905, "the " * 40000, None)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)


def test_language(corpus):
    rows, df = corpus
    got = language.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t, lang in rows:
        held = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        assert by[i]["held_out"] == held
        if i is not None and i < 900:
            assert by[i]["lang_pred"] == lang and 0 <= by[i]["score"] <= 1
    assert [by[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and by[903]["lang_pred"] == "fr" and by[904]["lang_pred"] != "und" and by[905]["lang_pred"] == "en"


def test_code_lengths_against_brute_force(corpus, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(language, "PIECE", 7)
    names, gram, lang_of, n = language.train(df)
    trees = language.Trees(names, gram, lang_of, n)
    counts = [[defaultdict(Counter) for _ in range(4)] for _ in names]
    for i, t, lang in rows:
        if lang is None or t is None or i is None or zlib.crc32(str(i).encode()) % 4 == 2:
            continue
        s = [256, 256, 256, *t.encode()]
        for k in range(3, len(s)):
            for order in range(4):
                counts[names.index(lang)][order][tuple(s[k - order : k])][s[k]] += 1

    def cost(tree, context, symbol):
        if context is None:
            return 8.0
        c = tree[len(context)].get(tuple(context))
        shorter = context[1:] if context else None
        if not c:
            return cost(tree, shorter, symbol)
        total, kinds = sum(c.values()), len(c)
        return -math.log2(c[symbol] / (total + kinds)) if symbol in c else -math.log2(kinds / (total + kinds)) + cost(tree, shorter, symbol)

    texts = ["the house", "été à Zürich?", "größe", "", "xyz zzz", "日本 \x00", "t", "th", "the"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    bits = trees.bits(data, offsets)
    for row, t in enumerate(texts):
        s = [256, 256, 256, *t.encode()]
        for k, tree in enumerate(counts):
            assert bits[row, k] == pytest.approx(sum(cost(tree, s[j - 3 : j], s[j]) for j in range(3, len(s))), rel=1e-4, abs=1e-3)


def test_model_has_every_string_of_its_sample(spark):
    texts = {"en": "the cat sat", "de": "die katze saß", "fr": "le chat é"}
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    df = spark.createDataFrame([(ids[k], texts[lang] + str(k % 7), lang) for k, lang in enumerate(sorted(texts) * 20)], "doc_id long, text string, lang string")
    want = {}
    for _, text, lang in df.collect():
        s = [256] * 3 + list(text.encode())
        for k in range(3, len(s)):
            key = (s[k - 3] << 27 | s[k - 2] << 18 | s[k - 1] << 9 | s[k], lang)
            want[key] = want.get(key, 0) + 1
    names, gram, lang, n = language.train(df)
    assert {(g, names[x]): c for g, x, c in zip(gram.tolist(), lang.tolist(), n.tolist(), strict=True)} == want
    with pytest.raises(ValueError, match="lower per_language"):
        language.train(df, most_costs=3 * len({g for g, _ in want}) - 1)


def test_language_nothing_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in language.identify(df).collect()] == ["und"] and language.identify(df.where("false")).count() == 0


def test_toxicity(docs, labels):
    rng = random.Random(2)
    rows, marks = [], []
    for k in range(400):
        words = [f"w{rng.randrange(500)}" for _ in range(50)]
        toxic = k % 8 == 0
        if toxic:
            for w in rng.sample(["idiot", "scumlike", "blarghX", "blarghY", "vileness", "moron"], 3):
                words[rng.randrange(50)] = w
        rows.append((k, " ".join(words)))
        marks.append((k, 1, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "you idiot moron"), (1002, "w1 " * 50000)]
    marks += [(None, 1, 1), (5000, 1, 1), (0, 1, 0), (3, 1, None)]
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs(rows), labels(marks)).collect()}
    assert len(got) == len(rows)
    wrong = sum(got[k]["predicted"] != int(k % 8 == 0) for k in range(400))
    assert wrong <= 6
    for r in got.values():
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert got[1000]["predicted"] == got[1001]["predicted"] == got[1002]["predicted"] == 0 and got[None]["predicted"] == 1
    assert got[2]["held_out"] == (zlib.crc32(b"2") % 4 == 2)


def test_toxicity_nothing_to_learn(docs, labels):
    assert [r["predicted"] for r in toxicity.toxicity(docs([(1, "idiot")]), labels([])).collect()] == [0]
    assert toxicity.toxicity(docs([]), labels([(1, 1, 1)])).count() == 0


def test_patterns_against_brute_force():
    import pyarrow as pa

    from gridloom.llm.shared import Prefix, text_arrays

    texts = ["Some words, SOME wordsmith", "", "été-x9", "aaaa aaaaa"]
    data, offsets = text_arrays(pa.array(texts))
    row, key = toxicity.patterns(data, offsets)
    import re

    want = set()
    for i, t in enumerate(texts):
        for w in re.findall(rb"[0-9a-z\x80-\xff]+", t.lower().encode()):
            for size in (None, *toxicity.STEMS):
                if size is None or len(w) > size:
                    part = np.frombuffer(w[:size], np.uint8)
                    h = Prefix(part).hash(np.array([0]), np.array([len(part)]))[0] ^ np.uint64(size or 0)
                    want.add((i, int(h)))
    assert set(zip(row.tolist(), map(int, key))) == want and len(row) == len(want)


def test_label_model_recovers_rates():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.2
    rates = np.array([[0.6, 0.5, 0.4, 0.7], [0.02, 0.05, 0.01, 0.1]])
    votes = (rng.random((4000, 4)) < np.where(y[:, None], rates[0], rates[1])).astype(float)
    votes = np.hstack([votes, votes[:, :1]])  # the last voter only repeats the first
    start = np.vstack([np.full(5, 0.5), np.full(5, 0.05)])
    post, found, together = toxicity.label_model(votes, start, 0.2)
    assert ((post > 0.5) == y).mean() > 0.93 and together[0, 4] > 0.95 and abs(found[0, 3] - 0.7) < 0.12


def test_rows_by_open_addressing():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 36, 5000))
    rows = language.Rows(keys)
    assert rows.find(keys).tolist() == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(0, 1 << 36, 5000), keys)
    assert (rows.find(other) == -1).all() and language.Rows(keys[:0]).find(other).tolist() == [-1] * len(other)


def test_scripts_with_little_text_and_clashing_columns(spark):
    """Bytes that one language alone has tell it, however few its documents are; other columns do not matter."""
    rows = [(k, "the house of water " * 9, "en", "x", "y") for k in range(200)] + [(1000 + k, "дом и вода " * 3, "ru", "x", "y") for k in range(4)] + [(2000 + k, "בית ומים " * 3, "he", "x", "y") for k in range(4)]
    rows += [(5000, "вода дом", None, "x", "y"), (5001, "ומים בית", None, "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, held_out string, Gram string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(df).collect()}
    assert got[5000] == "ru" and got[5001] == "he"


def test_marks_against_brute_force():
    import re

    import pyarrow as pa

    from gridloom.llm.shared import text_arrays

    texts = ["You are a stupid man", "stupid you", "A du Trottel!!! b", "LOUD WORDS HERE now", "LOUD WORDS", "!!", "x !!! y", "", "pathetic scum you filthy pig", "no one", "!!!", "du a b c idiot", "you a b idiot"]
    data, offsets = text_arrays(pa.array(texts))
    row, key = toxicity.patterns(data, offsets)
    names = {int(toxicity.mark_key(n)): n for n in (*toxicity.LEXICONS, *toxicity.PATTERNS)}
    got = {(r, names[int(k)]) for r, k in zip(row.tolist(), key, strict=True) if int(k) in names}
    want, every = set(), {w for words in toxicity.LEXICONS.values() for w in words}
    for i, t in enumerate(texts):
        raw = re.findall(r"[0-9A-Za-z\x80-￿]+", t)
        words = [w.lower() for w in raw]
        want |= {(i, n) for n, lexicon in toxicity.LEXICONS.items() if set(words) & set(lexicon)}
        if any(w in every and set(words[max(0, k - 3) : k]) & set(toxicity.PERSONS) for k, w in enumerate(words)):
            want.add((i, "addressed"))
        if sum(len(w) >= 4 and w.isupper() for w in raw) >= 3:
            want.add((i, "shouted"))
        if "!!!" in t:
            want.add((i, "exclaimed"))
    assert got == want and {"addressed", "shouted", "exclaimed", "german"} <= {n for _, n in want}


def test_scores_against_brute_force(docs, labels):
    """Scores are the model's weights summed over distinct patterns; repeated rows and ties get equal scores, and held-out labels change nothing."""
    import pyarrow as pa

    from gridloom.llm.shared import text_arrays

    rng = random.Random(8)
    rows = [(k, " ".join(rng.choice(["w%d" % rng.randrange(90), "idiot" if k % 5 == 0 else "plain", "vilex"[: 5 if k % 5 == 0 else 2]]) for _ in range(30))) for k in range(300)]
    rows += [rows[10], rows[10], (999, rows[10][1]), (1000, None)]
    marks = [(k, 1, int(k % 5 == 0)) for k in range(300)]
    df = docs(rows)
    keys, w, bias = toxicity.train(df, labels(marks))
    assert len(keys) == len(w) <= toxicity.FEATURES and (np.diff(keys.astype(object)) > 0).all()
    got = toxicity.toxicity(df, labels(marks)).collect()
    weight = dict(zip(map(int, keys), w, strict=True))
    text = dict(rows)
    for r in got:
        data, offsets = text_arrays(pa.array([text[r["doc_id"]]], pa.string()))
        total = bias + sum(weight.get(int(k), 0.0) for k in toxicity.patterns(data, offsets)[1])
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-40, min(40, total)))), abs=2e-6)
    assert len({r["score"] for r in got if r["doc_id"] in (10, 999)}) == 1
    turned = [(i, q, 1 - t) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, q, t) for i, q, t in marks]
    again = toxicity.train(df, labels(turned))
    assert (again[0] == keys).all() and (again[1] == w).all()
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["doc_id"] < 300) > 290
