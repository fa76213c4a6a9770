import pytest
from pyspark.sql import functions as F

from gridloom.operators import search, segments, text

WORDS = ["red", "blue", "house", "old", "sea", "wind"]


@pytest.fixture
def docs(spark):
    return spark.range(60).select("id", *[F.element_at(F.array(*[F.lit(w) for w in WORDS]), (F.col("id") % k % 6 + 1).cast("int")).alias(f"w{k}") for k in (5, 7, 11)]).select(F.col("id").alias("doc_id"), F.concat_ws(" ", "w5", "w7", "w11").alias("text"))


def found(spark, path, query="red house^2 sea"):
    return [(r["doc_id"], round(r["score"], 9)) for r in search.search(search.read(spark, path), query, "text", None).collect()]


def fresh(spark, tmp_path, docs, query="red house^2 sea"):
    search.build(docs, ["text"], str(tmp_path / "whole"))
    return found(spark, str(tmp_path / "whole"), query)


def test_additions_deletions_and_merges_give_what_one_build_gives(spark, tmp_path, docs):
    path = str(tmp_path / "index")
    for k in range(4):
        segments.add(docs.where(F.col("doc_id") % 4 == k), ["text"], path)
    assert found(spark, path) == fresh(spark, tmp_path, docs)
    before = search.read(spark, path)
    segments.delete(docs.where("doc_id % 5 = 0").select("doc_id"), path)
    left = docs.where("doc_id % 5 <> 0")
    want = fresh(spark, tmp_path, left)
    assert found(spark, path) == want
    assert before.postings.select("doc_id").distinct().count() == 60  # a reader keeps what it has opened
    again = docs.where("doc_id = 10").withColumn("text", F.lit("sea sea"))
    segments.add(again, ["text"], path)
    want = fresh(spark, tmp_path, left.union(again))
    assert found(spark, path) == want  # the tombstone is older than the new document
    held = segments.manifest(spark, path)
    merged = segments.merge(spark, path, list(held.segments[:3]))
    assert len(merged.segments) == 3 and found(spark, path) == want
    merged = segments.merge(spark, path, list(merged.segments))
    assert len(merged.segments) == 1 and not merged.tombstones and found(spark, path) == want
    gone = segments.vacuum(spark, path, keep=1)
    assert len(gone) == 3 * 6 + 1 and found(spark, path) == want and segments.vacuum(spark, path, keep=1) == []
    segments.verify(spark, path)


def test_addition_writes_only_its_segment(spark, tmp_path, docs):
    path = tmp_path / "index"
    segments.add(docs.where("doc_id < 50"), ["text"], str(path))
    times = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    segments.add(docs.where("doc_id >= 50"), ["text"], str(path))
    assert {f: f.stat().st_mtime_ns for f in times} == times


def test_update_replaces_documents(spark, tmp_path, docs):
    path = str(tmp_path / "index")
    segments.add(docs, ["text"], path)
    new = docs.where("doc_id < 7").withColumn("text", F.lit("wind wind house"))
    segments.add(new, ["text"], path, update=True)
    assert found(spark, path, "wind house") == fresh(spark, tmp_path, docs.where("doc_id >= 7").union(new), "wind house")


def test_batches_count_once(spark, tmp_path, docs):
    path = str(tmp_path / "index")
    for number in (0, 1, 1, 0):
        segments.add(docs.where(F.col("doc_id") % 2 == number), ["text"], path, batch=("stream", number))
    segments.merge(spark, path, list(segments.manifest(spark, path).segments))
    segments.add(docs.where("doc_id % 2 = 1"), ["text"], path, batch=("stream", 1))  # after its segment was merged away
    assert found(spark, path) == fresh(spark, tmp_path, docs)


def test_writers_at_once(spark, tmp_path, docs, monkeypatch):
    """While one writer makes its segment another commits: both segments count, and a deletion looks at both."""
    path = str(tmp_path / "index")
    segments.add(docs.where("doc_id < 20"), ["text"], path)
    commit, other = segments._commit, [True]

    def later(spark, where, change):
        if other.pop() if other else False:
            segments.add(docs.where("doc_id between 20 and 39"), ["text"], path)
        return commit(spark, where, change)

    monkeypatch.setattr(segments, "_commit", later)
    segments.add(docs.where("doc_id >= 40"), ["text"], path)
    assert found(spark, path) == fresh(spark, tmp_path, docs)
    other.append(True)
    monkeypatch.setattr(segments, "_commit", lambda s, w, c: later(s, w, c))
    more = docs.where("doc_id between 20 and 39").withColumn("doc_id", F.col("doc_id") + 1000)
    docs2, docs_all = docs, docs.union(more)

    def add_more(spark, where, change):
        if other:
            other.clear()
            monkeypatch.setattr(segments, "_commit", commit)
            segments.add(more, ["text"], path)
        return commit(spark, where, change)

    monkeypatch.setattr(segments, "_commit", add_more)
    segments.delete(docs2.select(F.when(F.col("doc_id") < 30, F.col("doc_id")).otherwise(F.col("doc_id") + 1000).alias("doc_id")), path)
    left = docs_all.where("not (doc_id < 30 or doc_id >= 1030)")
    assert found(spark, path) == fresh(spark, tmp_path, left)


def test_size_classes():
    of = lambda *sizes: segments.Manifest(segments=tuple(segments.Segment(str(i), i, n, 1) for i, n in enumerate(sizes)))
    assert segments.due(of(*[5] * 7)) == [] and len(segments.due(of(*[5] * 8))) == 8
    assert segments.due(of(*[5] * 4, *[70] * 4)) == [] and [s.postings for s in segments.due(of(600, *[9] * 8, 3))] == [9] * 8


def test_no_documents(spark, tmp_path, docs):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        search.read(spark, path)
    segments.add(docs.limit(0), ["text"], path)
    assert found(spark, path) == []
    segments.add(docs.withColumn("text", F.lit(" ")), ["text"], path)
    segments.delete(docs.select("doc_id"), path)
    assert found(spark, path) == [] and segments.merge(spark, path).segments == ()
    segments.add(docs, ["text"], path)
    assert found(spark, path) == fresh(spark, tmp_path, docs)


def test_broken_segment_is_found(spark, tmp_path, docs):
    path = tmp_path / "index"
    search.build(docs, ["text"], str(path))
    part = sorted(path.rglob("bucket=*/*.parquet"))[-1]
    part.unlink()
    with pytest.raises(ValueError, match="postings of"):
        segments.verify(spark, str(path))


def test_stream_is_searched_while_it_grows(spark, tmp_path, docs):
    from gridloom.streaming import logs as live

    docs.repartition(10).write.parquet(str(tmp_path / "in"))
    stream = live.log_stream(spark, str(tmp_path / "in"), "doc_id long, text string")
    path, seen = str(tmp_path / "out"), []
    query = live.index_writer(stream, ["text"], path, str(tmp_path / "check"))
    while query.isActive:
        if segments.manifest(spark, path):
            seen.append(search.read(spark, path).lengths.count())
        query.awaitTermination(1)
    live.drained(query)
    assert seen == sorted(seen) and found(spark, path) == fresh(spark, tmp_path, docs)
    assert len(segments.manifest(spark, path).segments) < 10


@pytest.mark.parametrize("held", [0, 1_000_000])
def test_a_merge_takes_deleted_entries_out_of_lists(spark, tmp_path, docs, monkeypatch, held):
    """Lists are stored, dealt and merged: few rows for many entries, whichever way deleted documents leave them; no sort or shuffle sees an entry."""
    monkeypatch.setattr(segments, "HELD", held)
    monkeypatch.setattr(text, "ENTRIES", 4)
    path = str(tmp_path / "index")
    more = docs.union(docs.where("doc_id < 9").select((-F.col("doc_id") - 1).alias("doc_id"), F.lit("sea old sea sea").alias("text"))).coalesce(1)
    for k in range(3):
        segments.add(more.where(F.pmod("doc_id", F.lit(3)) == k), ["text"], path)
        if k == 1:
            segments.delete(more.where("doc_id % 5 = 0").select("doc_id"), path)
    segments.delete(more.where("doc_id % 4 = 1 or doc_id = -2").select("doc_id"), path)
    want = more.where("not (doc_id % 5 = 0 and pmod(doc_id, 3) < 2) and doc_id % 4 <> 1 and doc_id <> -2")
    search.build(want, ["text"], str(tmp_path / "whole"))
    merged = segments.merge(spark, path, list(segments.manifest(spark, path).segments))
    stored = segments._part(spark, path, "postings", [merged.segments[0].name])
    assert stored.count() < merged.segments[0].postings and stored.agg(F.max(F.size("ids"))).first()[0] == 4
    rows = lambda p: sorted((r["term"], r["doc_id"], r["tf"], r["positions"]) for r in search.read(spark, p).postings.collect())
    assert rows(path) == rows(str(tmp_path / "whole")) and found(spark, path) == found(spark, str(tmp_path / "whole"))
    lists = search.lists(more, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in lists and lists.count("Sort ") == 1
