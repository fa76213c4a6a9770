import gzip
import os

import pytest

from gridloom.sources import matrices


def cells(df):
    return sorted(map(tuple, df.collect()))


def test_size_line_and_the_cell_that_looks_like_it(spark, tmp_path):
    rows = [(0, 0, 7), (4, 4, 3), (2, 1, -5)]
    frame = spark.createDataFrame(rows, "row long, col long, value long")
    for name, kept in (("with", rows), ("without", rows[:1] + rows[2:])):
        path = str(tmp_path / name)
        matrices.write_matrix(frame.where("value <> 3 or " + ("true" if name == "with" else "false")).repartition(2), path, 5, 5)
        found, size = matrices.read_matrix(spark, path)
        assert cells(found) == sorted(kept) and size == (5, 5, len(kept))
        parts = [f for f in sorted(os.listdir(path)) if not f.startswith((".", "_"))]
        assert parts[0] == "00-header.mtx"


def test_single_files_and_their_kinds(spark, tmp_path):
    plain = tmp_path / "a.mtx"
    plain.write_text("%%MatrixMarket matrix coordinate real symmetric\n% a comment\n%\n3 3 2\n1 1 0.5\n3 1 -1e-3\n")
    found, size = matrices.read_matrix(spark, str(plain))
    assert cells(found) == [(0, 0, 0.5), (0, 2, -1e-3), (2, 0, -1e-3)] and size == (3, 3, 2)
    packed = tmp_path / "b.mtx.gz"
    packed.write_bytes(gzip.compress(b"%%MatrixMarket matrix coordinate pattern general\n2 9 2\n1 9\n2 3\n"))
    assert cells(matrices.read_matrix(spark, str(packed))[0]) == [(0, 8, 1), (1, 2, 1)]
    (tmp_path / "c.mtx").write_text("1 2 3\n")
    with pytest.raises(ValueError):
        matrices.read_matrix(spark, str(tmp_path / "c.mtx"))


def test_large_file_is_read_in_ranges(spark, tmp_path):
    n = 20_000
    path = tmp_path / "big.mtx"
    path.write_text(f"%%MatrixMarket matrix coordinate integer general\n{n} 1 {n}\n" + "".join(f"{k + 1} 1 {k}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found, _ = matrices.read_matrix(spark, str(path))
        assert found.rdd.getNumPartitions() > 5 and found.count() == n and found.agg({"value": "sum"}).first()[0] == n * (n - 1) // 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_corpus_and_freshest_form(spark, tmp_path):
    bag = spark.createDataFrame([(0, 1, 2), (3, 0, 1), (3, 1, 4)], "doc_id long, term_id long, cnt long")
    terms = spark.createDataFrame([(1, "blue"), (0, "red")], "term_id long, term string")
    matrices.write_corpus(bag, terms, str(tmp_path / "c"))
    back, names = matrices.read_corpus(spark, str(tmp_path / "c"))
    assert cells(back) == cells(bag) and dict(map(tuple, names.collect())) == {0: "red", 1: "blue"}
    base = str(tmp_path / "m")
    assert matrices.freshest(spark, base) is None
    for k, ending in enumerate((".mtx", ".mtx.gz", ".parquet")):
        (tmp_path / f"m{ending}").write_text("x")
        os.utime(tmp_path / f"m{ending}", (1000, 1000))
    assert matrices.freshest(spark, base) == f"{base}.parquet"
    os.utime(tmp_path / "m.mtx", (2000, 2000))
    assert matrices.freshest(spark, base) == f"{base}.mtx"
