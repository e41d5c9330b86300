"""Orphan references, Bloom filter, skew-safe lookup, incremental processing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from marginalia.operators import bloom, incremental, orphans, skew

T = dt.datetime(2025, 5, 1)
LATER = dt.datetime(2025, 6, 1)
CHUNK = "chunk_id string, note_path string, links array<string>, text string, mtime bigint, run_id int, indexed_at timestamp_ntz, key string, reason string"
FILE = "path string, mtime bigint, listed_at timestamp_ntz, removed_at timestamp_ntz, live string"


def chunk(i, path, links, text="x", mtime=1, run=1, at=T):
    return (i, path, links, text, mtime, run, at, "clash", "clash")


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    probes = spark.range(5000, 15000).select(F.concat(F.lit("k"), "id").alias("k"))
    f = bloom.build(keys, "k", 5000)
    assert f.probe(keys, "k").where("not maybe").count() == 0
    assert f.probe(probes, "k").where("maybe").count() < 200
    assert f.probe(spark.createDataFrame([(None,)], "k string"), "k").first()["maybe"] is False
    assert bloom.build(keys.limit(0), "k", 0).probe(probes, "k").where("maybe").count() == 0


def test_saturated_bloom_filter_changes_no_result(spark):
    keys = spark.range(200_000).select(F.col("id").cast("string").alias("k"))
    f = bloom.build(keys, "k", 200_000, max_blocks=1)
    assert f.blocks == 1
    assert f.probe(keys, "k").where("not maybe").count() == 0


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_join(spark, how):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(50)}" if rng.random() < 0.9 else None, i) for i in range(2000)]
    left = spark.createDataFrame(rows, "k string, i int")
    right = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(30)]], "k string, v int")
    want = sorted(map(str, left.join(right, "k", how).select("k", "i", "v").collect()))
    assert sorted(map(str, skew.lookup(left, right, "k", how, least_rows=100).select("k", "i", "v").collect())) == want
    assert skew.lookup(left.limit(0), right, "k", how).count() == 0


def test_orphans_reasons_and_edges(spark):
    files = spark.createDataFrame(
        [
            ("a/Live.md", 1, T, None, "x"),
            ("a/Gone.md", 1, T, None, "x"),
            ("a/Gone.md", 1, LATER, LATER, "x"),
            ("b/Late.md", 1, LATER, None, "x"),
            ("c/Back.md", 1, LATER, None, "x"),
            ("c/Back.md", 1, T, T, "x"),
            ("a/Live.md", 1, T, None, "x"),
            (None, 1, T, None, "x"),
        ],
        FILE,
    )
    rows = [
        chunk("1", "a/Live.md", ["live#x", "folder\\GONE.MD", " Late |y", "#only", "", None, "nowhere.md", "Back"]),
        chunk("1", "a/Live.md", ["live#x", "folder\\GONE.MD", " Late |y", "#only", "", None, "nowhere.md", "Back"]),
        chunk("2", "a/live.md", None),
        chunk("3", "b/Late.md", [], at=None),
        chunk(None, None, ["nowhere"]),
    ]
    got = {tuple(r) for r in orphans.orphans(spark.createDataFrame(rows, CHUNK), files).collect()}
    assert got == {
        ("links", "1", "folder\\GONE.MD", "deleted", "2025-05"),
        ("links", "1", " Late |y", "late", "2025-05"),
        ("links", "1", "nowhere.md", "missing", "2025-05"),
        ("note_path", "2", "a/live.md", "missing", "2025-05"),
        ("links", None, "nowhere", "missing", "2025-05"),
    }


def test_orphans_of_empty_tables(spark):
    chunks = spark.createDataFrame([chunk("1", "a.md", ["b"])], CHUNK)
    files = spark.createDataFrame([], FILE)
    assert {r["reason"] for r in orphans.orphans(chunks, files).collect()} == {"missing"}
    assert orphans.orphans(chunks.limit(0), files).count() == 0
    assert orphans.orphan_report(chunks, files).count() == 2


def test_interval_sets():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ({rng.randrange(30) for _ in range(rng.randrange(20))} for _ in range(2))
        sa, sb = (incremental.IntervalSet((x, x) for x in s) for s in (a, b))

        def values(s):
            return {v for lo, hi in s.intervals for v in range(lo, hi + 1)}

        assert values(sa.subtract(sb)) == a - b
        assert values(sa.union(sb)) == a | b
        assert all(p[1] + 1 < q[0] for p, q in zip(sa.intervals, sa.intervals[1:], strict=False))


def test_intervals_of_merges_across_blocks(spark):
    df = spark.createDataFrame([(i,) for i in [999_998, 999_999, 1_000_000, 1_000_001, 7, None, 7]], "s long")
    assert incremental.intervals_of(df, "s").intervals == ((7, 7), (999_998, 1_000_001))


def test_ledger_processes_each_number_once_through_failures_and_late_commits(spark, tmp_path):
    source = spark.createDataFrame([(i, i // 10) for i in range(60)] + [(99, None)], "id int, seq int")
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    first = source.where("seq in (0, 1, 4) or seq is null")
    assert ledger.run(first, "seq", lambda df: df.select("id")).intervals == ((0, 1), (4, 4))

    def broken(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        ledger.run(source, "seq", broken)
    assert ledger.processed().intervals == ((0, 1), (4, 4))
    assert ledger.run(source, "seq", lambda df: df.select("id")).intervals == ((2, 3), (5, 5))
    assert not ledger.run(source, "seq", broken)
    assert sorted(r[0] for r in ledger.output().collect()) == list(range(60))
    assert incremental.Ledger(spark, str(tmp_path / "ledger")).processed().intervals == ((0, 5),)


def test_ledger_refuses_a_second_commit_of_the_same_number(spark, tmp_path):
    source = spark.createDataFrame([(1, 1)], "id int, seq int")
    a, b = (incremental.Ledger(spark, str(tmp_path / "ledger")) for _ in range(2))

    def overtaken(df):
        b.run(source, "seq", lambda x: x)
        return df

    with pytest.raises(Exception):
        a.run(source, "seq", overtaken)
    assert a.output().count() == 1


def test_ledger_with_nothing_available_processes_nothing(spark, tmp_path):
    source = spark.createDataFrame([(1, 1)], "id int, seq int")
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    assert not ledger.run(source, "seq", lambda x: x, incremental.IntervalSet([])) and ledger.output() is None
    assert ledger.run(source, "seq", lambda x: x).intervals == ((1, 1),)


def test_ledger_keeps_numbers_without_rows_as_gaps(spark, tmp_path):
    """A number that is said to be available but arrives later is processed when it is there, once."""
    source = spark.createDataFrame([(i, i) for i in range(6)], "id int, seq int")
    ledger = incremental.Ledger(spark, str(tmp_path / "ledger"))
    told = incremental.IntervalSet([(0, 5)])
    assert ledger.run(source.where("seq <> 2"), "seq", lambda x: x, told).intervals == ((0, 1), (3, 5))
    assert not ledger.run(source.where("seq <> 2"), "seq", lambda x: x, told)
    assert ledger.run(source, "seq", lambda x: x, told).intervals == ((2, 2),)
    assert sorted(r[0] for r in ledger.output().collect()) == list(range(6))


def test_replayed_runs_with_late_numbers_and_a_death(spark, tmp_path):
    source = spark.createDataFrame([(i, i % 4) for i in range(12)] + [(99, None)], "id int, seq int")
    early = incremental.IntervalSet([(0, 1), (3, 3)])
    out = incremental.replayed(source, "seq", str(tmp_path / "ledger"), [(early, incremental.IntervalSet([(0, 3)]), False), (None, None, True), (None, None, False), (None, None, False)])
    assert sorted(r["id"] for r in out.collect()) == list(range(12))


def test_rows_of_many_intervals(spark):
    some = incremental.IntervalSet((3 * i, 3 * i + (i % 2)) for i in range(400))
    df = spark.range(2000).selectExpr("id AS s", "'x' AS lo").union(spark.createDataFrame([(None, "n")], "s long, lo string"))
    want = {v for lo, hi in some.intervals for v in range(lo, hi + 1)}
    assert {r["s"] for r in some.rows_of(df, "s").collect()} == want


def test_a_kept_ledger_reads_only_new_runs(spark, tmp_path):
    files = spark.createDataFrame([("a.md", 5, T, None, "x"), ("b.md", 6, T, None, "x")], FILE)
    chunks = spark.createDataFrame([chunk("a::0", "a.md", None, "hello", 5, 1), chunk("b::0", "b.md", None, "x", 6, 2)], CHUNK)
    cache = spark.createDataFrame([], "path string, mtime bigint, run_id int")
    vectors = spark.createDataFrame([("a::0", "5d41402abc4b2a76", 1)], "chunk_id string, h string, run_id int")

    def left(*succeeded):
        runs = spark.createDataFrame([(n, "succeeded") for n in succeeded], "run_id int, status string")
        return {r["record_key"] for r in incremental.unprocessed(files, chunks, cache, vectors, runs, str(tmp_path / "ledger")).collect()}

    assert left(2) == {"a.md", "a::0", "b::0"}
    assert left(1, 2) == {"b::0"}  # run 1 succeeds later than run 2
    assert incremental.Ledger(spark, str(tmp_path / "ledger")).processed().intervals == ((1, 2),)


def test_unprocessed(spark):
    files = spark.createDataFrame([("a.md", 5, T, None, "x"), ("b.md", 6, T, None, "x"), ("c.pdf", 7, T, None, "x"), ("d.pdf", 8, T, None, "x"), ("e.pdf", 8, T, T, "x"), ("f.md", None, T, None, "x")], FILE)
    chunks = spark.createDataFrame([chunk("a::0", "a.md", None, "hello", 5, 1), chunk("a::0", "a.md", None, "hello", 5, 1), chunk("b::0", "b.md", None, "x", 6, 2), chunk("n::0", "n.md", None, None)], CHUNK)
    cache = spark.createDataFrame([("c.pdf", 7, 1), ("d.pdf", 7, 1)], "path string, mtime bigint, run_id int")
    vectors = spark.createDataFrame([("a::0", "5d41402abc4b2a76", 1), ("b::0", "9dd4e461268c8034", 2)], "chunk_id string, h string, run_id int")
    runs = spark.createDataFrame([(1, "succeeded"), (2, "failed"), (3, "running")], "run_id int, status string")
    got = {tuple(r) for r in incremental.unprocessed(files, chunks, cache, vectors, runs).collect()}
    assert got == {("note", "b.md"), ("note", "f.md"), ("attachment", "d.pdf"), ("chunk", "b::0"), ("chunk", "n::0")}
    none = incremental.unprocessed(files.limit(0), chunks.limit(0), cache.limit(0), vectors.limit(0), runs.limit(0))
    assert none.count() == 0


def test_scratch_tables_are_swept(spark):
    import os

    from marginalia import session

    t = session.materialize(spark.range(3).toDF("x"), "t")
    assert os.path.isdir(t._scratch_path) and t._scratch_path.startswith(session.scratch_dir(spark)) and t.count() == 3
    session.release(t)
    assert not os.path.isdir(t._scratch_path)
