"""What building and searching an index shuffles and reads."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import search, segments, text

TEXTS = ["", None, "abc", "Abc def", "ghi", " x", "x ", "É", "éa", "aé", "KK İi", "--", "_-_ a_B-c", "\x00\x7fa", "the The THE the", *["aB é-\n_0"[k % 9 :] * (k % 4) + " " * (k % 3) + "b😀a"[: k % 4] for k in range(60)], None, ""]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 50, 8 << 20])
def test_terms_are_gathered_as_tokens_are_cut(spark, monkeypatch, piece):
    monkeypatch.setattr(text, "PIECE", piece)
    docs = spark.createDataFrame([(k, t, TEXTS[-k]) for k, t in enumerate(TEXTS)], "doc_id long, text string, other string").coalesce(1)
    want, sizes = {}, {}
    for r in docs.select("doc_id", text.tokens_of(F.col("text")).alias("text"), text.tokens_of(F.col("other")).alias("other")).collect():
        for field in ("text", "other"):
            for pos, term in enumerate(r[field]):
                want.setdefault((r["doc_id"], field, term), []).append(pos)
                sizes[r["doc_id"], field] = len(r[field])
    got = search.index(docs, ["text", "other"]).collect()
    assert len(got) == len(want) and {(r["doc_id"], r["field"], r["term"]): r["positions"] for r in got} == want and all(r["tf"] == len(r["positions"]) for r in got)
    assert {(r["doc_id"], r["field"]): r["len"] for r in search.lengths(docs, ["text", "other"]).collect()} == sizes


def test_lists_and_not_tokens_are_shuffled(spark):
    docs = spark.range(300, numPartitions=2).select(F.col("id").alias("doc_id"), F.lit("red blue red").alias("text"))
    assert text.gathered(docs, ["text"]).count() == 2 * 2  # a row for each term and piece
    below = plan(search.index(docs, ["text"])).split("Exchange")[1]
    assert "MapInArrow" in below and "explode" not in below
    assert plan(search.index(docs, ["text"])).count("Exchange") == 1


def test_rows_of_one_id_are_one_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red sea"), (1, "red wind old"), (2, "sea"), (3, "red")], "doc_id long, text string").repartition(4)
    search.build(docs, ["text"], str(tmp_path / "index"))
    stored = search.read(spark, str(tmp_path / "index"))
    assert [(r["tf"], r["positions"]) for r in stored.postings.where("doc_id = 1 and term = 'red'").collect()] == [(2, [0, 0])]
    got = {r["doc_id"]: r["score"] for r in search.search(stored, "red", "text", None).collect()}
    idf = math.log(1 + (3 - 2 + 0.5) / (2 + 0.5))
    assert got == pytest.approx({d: idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / (7 / 3))) for d, tf, size in ((1, 2, 5), (3, 1, 1))})


def test_patterns_read_the_folders_of_their_terms(spark, tmp_path, monkeypatch):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.format_string("w%02d sea", "id").alias("text"))
    search.build(docs, ["text"], str(tmp_path / "index"))
    stored = search.read(spark, str(tmp_path / "index"))
    monkeypatch.setattr(search, "FEW", 10)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with a large vocabulary
    try:
        for query, ids in (("w0?", range(10)), ("w*", range(40)), ("w07~1", [*range(10), 17, 27, 37]), ("nothing*", [])):
            assert {r["doc_id"] for r in search.search(stored, query, "text", None).collect()} == set(ids)
        hits = plan(search._hits(stored, search.parse("w0?")[0], "text"))
        assert "SortMergeJoin" not in hits and re.search(r"PartitionFilters: \[[^\n]*bucket#\d+ IN", hits)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_merge_deals_a_common_term_to_several_tasks(spark, tmp_path, monkeypatch):
    path, docs = str(tmp_path / "index"), spark.range(400).select(F.col("id").alias("doc_id"), F.lit("sea").alias("text"))
    for k in range(2):
        segments.add(docs.where(F.col("doc_id") % 2 == k), ["text"], path)
    write, seen = segments._write, []
    monkeypatch.setattr(segments, "_write", lambda postings, *rest: seen.append(postings) or write(postings, *rest))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which puts small partitions together
    try:
        segments.merge(spark, path, list(segments.manifest(spark, path).segments))
        assert seen[0].groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert search.read(spark, path).postings.count() == 400


def test_text_ids_joins_lists_and_sorts_no_tokens(spark, tmp_path):
    from gridloom import catalogue

    docs = spark.createDataFrame([(7, "Sea red sea"), (3, "old wind"), (5, None), (3, "wind -- sea"), (-4, "old x")], "doc_id long, text string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    vocab = {r["term"]: r["term_id"] for r in catalogue.queries()["text_vocab"](spark, str(tmp_path)).collect()}
    assert [t for t in sorted(vocab, key=vocab.get) if t in ("x", "red")] == ["x", "red"] and vocab["old"] == 0 and set(vocab) == {"old", "x", "wind", "--", "sea", "red"}
    assert sorted(vocab.values()) == list(range(6))
    found = catalogue.queries()["text_ids"](spark, str(tmp_path))
    shown = plan(found)
    assert "SortAggregate" not in shown and "SortMergeJoin" not in shown and shown.count("ShuffledHashJoin") == 3 and "posexplode" not in shown
    want = {7: ["sea", "red", "sea"], 3: ["old", "wind", "wind", "--", "sea"], -4: ["old", "x"]}
    assert {r["doc_id"]: (r["id_sum"], r["n"]) for r in found.collect()} == {d: (sum(vocab[t] for t in w), len(w)) for d, w in want.items()}
