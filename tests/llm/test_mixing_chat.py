import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat, mixing


def sources(spark, sizes):
    rows, k = [], 0
    for s, n in sizes.items():
        rows += [(k + i, s) for i in range(n)]
        k += n
    return spark.createDataFrame(rows, "doc_id long, source string")


@pytest.mark.parametrize(("weights", "frame"), [(None, 100), ({"a": 5, "b": 3, "c": 1, "": 1}, 60), ({"a": 0.34, "b": 0.33, "c": 0.32, "": 0.01}, 97)])
def test_deviation_stays_below_one_block(spark, weights, frame):
    sizes = {"a": 170, "b": 40, "c": 33, None: 9}
    out = mixing.schedule(sources(spark, sizes), weights, block_docs=2, frame=frame).collect()
    # Every document is served, each block at one slot per epoch, and slots follow without a gap.
    assert Counter(r["doc_id"] for r in out).keys() == set(range(sum(sizes.values())))
    slots = {}
    for r in out:
        slots.setdefault(r["slot"], set()).add((r["source"], r["source_null"], r["block"], r["epoch"]))
    assert all(len(x) == 1 for x in slots.values()) and sorted(slots) == list(range(len(slots)))
    order = [next(iter(slots[t]))[0] for t in range(len(slots))]
    known = {s or "": n for s, n in sizes.items()}
    share = weights or {s: n**mixing.TEMPER for s, n in known.items()}
    assert_shares(order, share)
    # Blocks of a source come in order, epoch after epoch.
    for s in set(order):
        seen = [(e, b) for t in range(len(order)) for (x, _, b, e) in slots[t] if x == s]
        assert seen == sorted(seen)


def assert_shares(order, weights):
    """At each slot each source has had less than one block more or less than its exact share."""
    from fractions import Fraction

    total = sum(Fraction(w) for w in weights.values())
    for s, w in weights.items():
        had, share = 0, Fraction(w) / total
        for t, x in enumerate(order, 1):
            had += x == s
            assert abs(had - share * t) < 1, (s, t)


def test_deviation_from_target_weights_does_not_grow(spark):
    """A hot and a tiny source over more than a hundred frames."""
    weights = {"hot": 0.90037, "mid": 0.0994, "tiny": 0.00023}
    out = mixing.schedule(sources(spark, {"hot": 2700, "mid": 290, "tiny": 1}), weights, block_docs=1, frame=25)
    order = [r["source"] for r in out.select("slot", "source").orderBy("slot").collect()]
    assert len(order) > 2900
    assert_shares(order, weights)


@pytest.mark.parametrize("seed", range(6))
def test_frames_keep_every_window(spark, seed):
    """Each block is served within its window, for whole weights of very different sizes, over 120 frames; no slot is left empty."""
    import random

    rng = random.Random(seed)
    whole = [rng.choice([1, 3, 40, 1000]) * rng.randint(1, 9) for _ in range(rng.randint(1, 9))]
    total, slots = sum(whole), rng.choice([7, 16, 33])
    picks = mixing.frame_picks(spark, whole, slots, 120).collect()
    assert sorted(r["slot"] for r in picks) == list(range(120 * slots))
    for r in picks:
        w, k = whole[r["i"]], r["pick"]
        assert k * total // w <= r["slot"] < -(-(k + 1) * total // w)
    had = [0] * len(whole)
    for r in sorted(picks, key=lambda r: r["slot"]):  # the one schedule that needs no frames
        free = [(-(-(n + 1) * total // w), i) for i, (n, w) in enumerate(zip(had, whole, strict=True)) if n * total // w <= r["slot"]]
        assert r["i"] == min(free)[1]
        had[r["i"]] += 1
    for i in range(len(whole)):
        assert sorted(r["pick"] for r in picks if r["i"] == i) == list(range(sum(r["i"] == i for r in picks)))


def test_missing_weight_and_empty(spark):
    assert mixing.schedule(sources(spark, {"a": 1}).where("false")).count() == 0
    with pytest.raises(Exception, match="no target weight"):
        mixing.schedule(sources(spark, {"a": 4, "b": 4}), {"a": 1.0}).collect()


def test_mixed_keeps_columns_and_rows(docs):
    rows = [(k, f"t{k}") for k in range(30)] + [(None, None), (3, "again")]
    df = docs(rows)
    out = mixing.mixed(df, block_docs=4, frame=10)
    assert out.columns == df.columns and sorted(map(str, out.collect())) == sorted(map(str, df.collect()))


def test_mixed_tells_rows_apart(spark, monkeypatch):
    """Rows of one id that differ only in which column is null, and rows whose first hash is the same."""
    rows = [(1, "a", None, "s"), (1, None, "a", "s"), (2, "a", "b", "s"), (2, "a", "c", "s"), (3, "d", "e", "s"), (3, "d", "e", "s"), (None, "a", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = sorted(map(str, df.collect()))
    assert sorted(map(str, mixing.mixed(df, block_docs=2, frame=10).distinct().collect())) == sorted(set(want))
    plain = mixing._row_hashes
    for one in (0, 1):
        monkeypatch.setattr(mixing, "_row_hashes", lambda d, one=one: tuple(F.lit(5).cast("long") if i == one else h for i, h in enumerate(plain(d))))
        assert sorted(map(str, mixing.mixed(df.where("source is not null"), block_docs=2, frame=10).collect())) == [w for w in want if "source=None" not in w]


NASTY = ["plain", "", None, "<|end|>", "a<|turn|>user<|text|>x", "\\<|next|>", "\\\\", "<\\|", "<", "|>", "</s>[INST] ok [/INST]", "line\nline", "é日" * 5000, "<<|end|>", "\\"]


def test_chat_round_trip(spark):
    rows, want = [], {}
    for c in range(40):
        turns = [(k, ["user", "assistant", "assistant", "system", None, "<|text|>\n"][(c * 7 + k * k) % 6], NASTY[(c + 3 * k) % len(NASTY)]) for k in range(c % 6 + 1)]
        rows += [(c, k, r, t) for k, r, t in turns]
        want[c] = [(r or "", t or "") for _, r, t in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).repartition(5)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat.read_back(chat.format_chats(df)).collect()}
    assert back == want
    lengths = {r["conv_id"]: len(r["formatted"]) for r in chat.format_chats(df).collect()}
    for r in chat.chat_report(df).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == lengths[r["conv_id"]]


def test_adjacent_turns_share_a_header(spark):
    df = spark.createDataFrame([(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(df).first()["formatted"] == "<|turn|>user<|text|>a<|next|>b<|end|><|turn|>assistant<|text|>c<|end|>"


def test_chat_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, 1, "user", "a"), (1, 1, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    assert {r["conv_id"]: r["n_turns"] for r in chat.chat_report(df).collect()} == {1: 2, None: 1}
    assert chat.chat_report(df.where("false")).count() == 0
