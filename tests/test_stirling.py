import math

import pytest

from gridloom.functions import stirling


def numbers(n):
    row = [1]
    for k in range(1, n):
        row = [(row[m - 1] if m else 0) + (k * row[m] if m < k else 0) for m in range(k + 1)]
    return row


def test_stored_blocks_against_whole_numbers(spark, tmp_path):
    path = str(tmp_path / "table")
    table = stirling.stored(spark, path, 70, block=16)
    got = {r["n"]: r["logs"] for r in table.collect()}
    assert sorted(got) == list(range(1, 81))
    for n in (1, 2, 16, 17, 33, 70):
        assert got[n] == pytest.approx([math.log(x) for x in numbers(n)], rel=1e-12, abs=1e-12)


def test_second_run_reads_and_a_stopped_one_goes_on(spark, tmp_path):
    import shutil

    path = tmp_path / "table"
    stirling.stored(spark, str(path), 40, block=16)
    times = {f: f.stat().st_mtime_ns for f in path.rglob("*.parquet")}
    assert stirling.stored(spark, str(path), 33, block=16).count() == 48
    (path / "block=2" / "_SUCCESS").unlink()  # stopped while it wrote its last block
    again = {r["n"]: r["logs"] for r in stirling.stored(spark, str(path), 40, block=16).collect()}
    kept = {f: t for f, t in times.items() if "block=2" not in str(f)}
    assert {f: f.stat().st_mtime_ns for f in kept} == kept and again[40] == pytest.approx([math.log(x) for x in numbers(40)])
    shutil.rmtree(path)


def test_look_up(spark, tmp_path):
    table = stirling.stored(spark, str(tmp_path / "table"), 8, block=8)
    rows = spark.createDataFrame([(4, 2), (4, 5), (4, 0), (9, 1), (None, 1), (3, None)], "n long, m long")
    got = [r["log"] for r in stirling.looked_up(rows, table, "n", "m", "log").orderBy("n", "m").collect()]
    assert got == [None, None, math.inf, pytest.approx(math.log(11)), math.inf, None]


def test_large_row(spark, tmp_path):
    """Row 600: its numbers add up to 600!."""
    logs = stirling.stored(spark, str(tmp_path / "table"), 600, block=200).where("n = 600").first()["logs"]
    assert len(logs) == 600 and math.log(math.fsum(math.exp(x - max(logs)) for x in logs)) + max(logs) == pytest.approx(math.lgamma(601), rel=1e-12)
