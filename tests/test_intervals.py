import datetime as dt

import pytest
from conftest import clash
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chunkwise.operators import intervals as iv

T0 = dt.datetime(2025, 1, 1)
SCAN = "scan_id long, source string, content_hash string, status_code int, scanned_at timestamp"
LOG = "run_id long, source string, mtime long, content_hash string, ingest_time long"
RUNS = "run_id long, run_status string"


def rows(df):
    return sorted((r["lo"], r["hi"]) for r in df.collect())


def runs_of(numbers):
    out = []
    for n in sorted(numbers):
        if out and out[-1][1] == n - 1:
            out[-1][1] = n
        else:
            out.append([n, n])
    return [tuple(x) for x in out]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-9, 40), st.integers(0, 6)), max_size=12), st.lists(st.tuples(st.integers(-9, 40), st.integers(0, 6)), max_size=8))
def test_union_and_difference_against_sets(spark, a, b):
    left = spark.createDataFrame([(x, x + n) for x, n in a], iv.INTERVALS)
    right = spark.createDataFrame([(x, x + n) for x, n in b], iv.INTERVALS)
    have = {y for x, n in a for y in range(x, x + n + 1)}
    gone = {y for x, n in b for y in range(x, x + n + 1)}
    assert rows(iv.merge_intervals(left)) == runs_of(have)
    assert rows(iv.subtract_intervals(left, right)) == runs_of(have - gone)


def test_bad_intervals_are_ignored(spark):
    df = spark.createDataFrame([(None, 3), (5, None), (9, 7), (1, 2), (1, 2)], iv.INTERVALS)
    assert rows(iv.merge_intervals(df)) == [(1, 2)]
    assert rows(iv.merge_intervals(df.where("false"))) == []


def test_rows_in_keeps_clashing_columns(spark):
    df = clash(spark.createDataFrame([(1,), (5,), (None,), (70000,)], "n long"), "lo", "hi", "b")
    got = iv.rows_in(df, "n", spark.createDataFrame([(4, 70000)], iv.INTERVALS))
    assert sorted(r["n"] for r in got.collect()) == [5, 70000] and got.columns == ["n", "lo", "hi", "b"]


def changed(spark, scan, log, runs):
    a, b, c = spark.createDataFrame(scan, SCAN), spark.createDataFrame(log, LOG), spark.createDataFrame(runs, RUNS)
    return sorted(r["source"] for r in iv.changed_sources(clash(a, "c", "s", "lo"), clash(b, "s", "lo", "stored_source"), clash(c, "hi")).collect())


def test_changed_sources_cases(spark):
    at = lambda n: T0 + dt.timedelta(hours=n)
    scan = [
        (1, "new", "h", None, at(0)), (2, "same", "h", 200, at(0)), (3, "other", "h2", None, at(0)), (4, "nullhash", "h", None, at(0)),
        (5, "failed", "h2", 404, at(5)), (6, "failed", "h", 200, at(0)), (7, "late", "old", None, at(1)), (8, "late", "h", None, at(0)),
        (9, "badrun", "h", None, at(0)), (10, None, "h", None, at(0)), (11, "nohash", None, None, at(0)), (12, "tie", "x", None, at(0)), (13, "tie", "h", None, at(0)), (1, "new", "h", None, at(0)),
    ]
    log = [(1, s, 1, "h", 1) for s in ("same", "other", "failed", "late", "tie")] + [(1, "nullhash", 1, None, 1), (2, "badrun", 1, "h", 1), (2, "same", 1, "zzz", 1), (1, None, 1, "h", 1), (1, "same", 1, "h", 1)]
    runs = [(1, "ok"), (2, "failed"), (3, None)]
    assert changed(spark, scan, log, runs) == ["badrun", "late", "new", "nullhash", "other"]
    assert changed(spark, [], log, runs) == []
    assert changed(spark, scan[:1], [], []) == ["new"]


def test_processed_scans_are_not_read_again(spark):
    scan = spark.createDataFrame([(1, "a", "h", None, T0), (2, "b", "h", None, T0)], SCAN)
    log, runs = spark.createDataFrame([(1, "a", 1, "h", 1), (2, "b", 1, "h", 1)], LOG), spark.createDataFrame([(1, "ok"), (2, "failed")], RUNS)
    assert rows(iv.done_scans(scan, iv.stored_versions(log, iv.committed_runs(runs)))) == [(1, 1)]
    done = spark.createDataFrame([(1, 1)], iv.INTERVALS)
    got = iv.changed_sources(scan, spark.createDataFrame([], LOG), spark.createDataFrame([], RUNS), done)
    assert [r["source"] for r in got.collect()] == ["b"]


def test_ledger_survives_failure_and_takes_late_rows(spark, tmp_path):
    ledger = iv.IntervalLedger(spark, str(tmp_path))
    df = lambda *n: spark.createDataFrame([(x,) for x in n], "seq long")
    ledger.run(df(1, 2, 5), "seq", lambda d: d)
    with pytest.raises(RuntimeError):
        ledger.run(df(1, 2, 5, 6), "seq", lambda d: d, fail_before_commit=True)
    assert rows(ledger.intervals()) == [(1, 2), (5, 5)]
    ledger.run(df(1, 2, 3, 5, 6, 6), "seq", lambda d: d)
    assert rows(ledger.intervals()) == [(1, 3), (5, 6)]
    assert sorted(r["seq"] for r in ledger.output().collect()) == [1, 2, 3, 5, 6, 6]


def test_numbers_far_apart_and_long_intervals(spark):
    big = [(-(1 << 62), -(1 << 62) + 5), (0, 0), (1, 1 << 20), ((1 << 20) + 1, (1 << 20) + 1), (1 << 61, 1 << 61)]
    df = spark.createDataFrame(big, iv.INTERVALS)
    assert rows(iv.merge_intervals(df)) == [(-(1 << 62), -(1 << 62) + 5), (0, (1 << 20) + 1), (1 << 61, 1 << 61)]
    got = rows(iv.subtract_intervals(df, spark.createDataFrame([(100, 200_000)], iv.INTERVALS)))
    assert got == [(-(1 << 62), -(1 << 62) + 5), (0, 99), (200_001, (1 << 20) + 1), (1 << 61, 1 << 61)]


def test_rows_that_arrive_during_a_run_stay_pending(spark, tmp_path):
    feed = str(tmp_path / "feed")
    spark.createDataFrame([(1,), (2,)], "seq long").write.parquet(feed)
    source = spark.read.schema("seq long").parquet(feed)

    def late(todo):
        spark.createDataFrame([(3,)], "seq long").write.mode("append").parquet(feed)
        spark.catalog.refreshByPath(feed)
        return todo

    ledger = iv.IntervalLedger(spark, str(tmp_path / "l"))
    ledger.run(source, "seq", late)
    assert rows(ledger.intervals()) == [(1, 2)] and sorted(r["seq"] for r in ledger.output().collect()) == [1, 2]
    ledger.run(spark.read.parquet(feed), "seq", lambda d: d)
    assert rows(ledger.intervals()) == [(1, 3)] and sorted(r["seq"] for r in ledger.output().collect()) == [1, 2, 3]


def test_of_two_writers_none_is_lost(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,), (3,)], "seq long")
    first, second = iv.IntervalLedger(spark, str(tmp_path)), iv.IntervalLedger(spark, str(tmp_path))
    worked = []

    def slow(todo):
        if not worked:
            worked.append(1)
            second.run(df.where("seq < 3"), "seq", lambda d: d)  # commits while the first one works
        return todo

    first.run(df, "seq", slow)
    assert rows(first.intervals()) == [(1, 3)] and sorted(r["seq"] for r in first.output().collect()) == [1, 2, 3]


@pytest.mark.parametrize("at", ["process", "commit"])
def test_crash_at_each_step(spark, tmp_path, at):
    ledger = iv.IntervalLedger(spark, str(tmp_path))
    df = spark.createDataFrame([(1,), (4,)], "seq long")

    def dies(todo):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(df, "seq", dies) if at == "process" else ledger.run(df, "seq", lambda d: d, fail_before_commit=True)
    assert rows(ledger.intervals()) == [] and ledger.output() is None
    ledger.run(df, "seq", lambda d: d)
    assert sorted(r["seq"] for r in ledger.output().collect()) == [1, 4]
