import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import bpe_tree

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_tree._ranks(PATH), special_tokens={})


@pytest.mark.parametrize("leaf", [1, 2, 5, 16])
@pytest.mark.parametrize("short", [0, 64])
def test_matches_against_the_library(library, leaf, short, monkeypatch):
    monkeypatch.setattr(bpe_tree, "SHORT", short)
    rng, tree = random.Random(leaf), bpe_tree.TokenTree(bpe_tree._ranks(PATH), leaf)
    for _ in range(1500):
        s = "".join(rng.choice(rng.choice(["ab", "aaab ", "éà日本", "theing", "0123456789abcdef", "=-_"])) for _ in range(rng.randint(1, 60)))
        assert tree.ids(s) == np.array(library._encode_single_piece(s.encode()), "<u4").tobytes()


def test_vocabulary_with_tokens_that_merges_do_not_reach():
    """A whole match in the vocabulary is one token; inside a longer match only merges count."""
    ranks = {bytes([c]): c for c in range(256)} | {b"bc": 256, b"abc": 257, b"ab": 300}
    for leaf in (1, 3, 16):
        tree = bpe_tree.TokenTree(ranks, leaf)
        read = lambda s: np.frombuffer(tree.ids(s), "<u4").tolist()
        assert read("abc") == [257] and read("ab") == [300] and read("abd") == [300, 100]
    ranks = {bytes([c]): c for c in range(256)} | {b"bc": 256, b"abcd": 257, b"ab": 300, b"cd": 301}
    for leaf in (1, 2, 16):
        tree = bpe_tree.TokenTree(ranks, leaf)
        assert np.frombuffer(tree.ids("abcd"), "<u4").tolist() == [257]
        assert np.frombuffer(tree.ids("abcde"), "<u4").tolist() == [97, 256, 100, 101]


@pytest.mark.parametrize("leaf", [1, 2, 3, 7])
def test_cuts_of_a_text_leave_its_matches(leaf):
    rng, tree = random.Random(leaf), bpe_tree.MatchTree(P.PATTERN, leaf=leaf)
    for _ in range(3000):
        s = "".join(rng.choice(["a", "b", " ", "  ", "\n", "'", "'l", "l", "1", "!", "é", "日", "r", "e", "t"]) for _ in range(rng.randint(0, 40)))
        assert tree.matches(s) == tree.find(s)


@pytest.mark.parametrize("text", ["a" * 30_000, "ab" * 15_000, "日本" * 6000, "=" * 29_999, "".join(random.Random(0).choice("abcdef0123456789") for _ in range(30_000))])
def test_work_on_one_long_match(library, text):
    """A match without a border costs a few merges per byte, whatever its length."""
    tree = bpe_tree.TokenTree(bpe_tree._ranks(PATH))
    assert tree.ids(text) == np.array(library._encode_single_piece(text.encode()), "<u4").tobytes()
    assert tree.merged < 6 * len(text.encode())


def test_report_against_the_library(docs, library):
    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, " \n\t  "), (4, "It's we'll  'ss  x\r\n"), (5, "<|endoftext|>"), (6, "a\x00b\x1c\x85 c"), (7, "🙂" * 300 + " é" * 50), (None, "null id"), (8, "twice"), (8, "twice")]
    rows += [(9, "".join(rng.choice(["word ", "x1 ", "  ", "'re", "日", "\n"]) for _ in range(60_000))), (10, "z" * 50_000)]
    want = []
    for i, t in rows:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i or -1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    report = bpe_tree.token_report(docs(rows), PATH, P.PATTERN)
    assert report.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r[0] or -1, *r[1:]) for r in report.collect()) == sorted(want)
    assert bpe_tree.token_report(docs([]), PATH, P.PATTERN).count() == 0


def test_table_of_matches_starts_anew(docs, library, monkeypatch):
    monkeypatch.setattr(bpe_tree, "MOST_MATCHES", 3)
    trees = (bpe_tree.TokenTree(bpe_tree._ranks(PATH)), bpe_tree.MatchTree(P.PATTERN), {})
    for k in range(20):
        text = f"text {k} of {k * 7} wordsies"
        assert bpe_tree._ids(text, trees) == np.array(library.encode_ordinary(text), "<u4").tobytes()


def test_decoding_of_null_and_unknown_ids(spark):
    ids = spark.sql("select 1 as doc_id, cast(null as binary) as ids")
    assert [bytes(r["data"]) for r in bpe_tree.decoded(ids, PATH).collect()] == [b""]
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_tree.decoded(ids.withColumn("ids", F.lit(b"\xff\xff\xff\x00")), PATH).collect()
