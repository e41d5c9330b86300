"""Limiters and debounce, in batch and as streams."""

import datetime as dt

from marginalia.streaming import limits as L

SCHEMA = "user string, ts timestamp_ntz, id int"


def events(spark, *rows):
    return spark.createDataFrame([(u, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=s), i) for i, (u, s) in enumerate(rows)] + [(None, None, 99)], SCHEMA)


def taken(df):
    return {r["id"] for r in df.collect() if r["accepted"]}


def test_cooldown(spark):
    e = events(spark, ("a", 0), ("a", 9), ("a", 12), ("a", 21), ("a", 22), ("b", 1))
    assert taken(L.limited(e, "user", "ts", "id", L.cooldown_step(10_000_000))) == {0, 2, 4, 5}
    assert L.limited(e.limit(0), "user", "ts", "id", L.cooldown_step(1)).count() == 0


def test_sliding_window(spark):
    e = events(spark, *[("a", 0)] * 4, ("a", 59), ("a", 60), ("a", 61))
    assert taken(L.limited(e, "user", "ts", "id", L.window_step(3, 60_000_000))) == {0, 1, 2, 5, 6}


def test_debounce(spark):
    e = events(spark, ("a", 0), ("a", 2), ("a", 4), ("a", 10), ("b", 0)).where("user is not null")
    assert sorted((r["user"], r["events"]) for r in L.debounced(e, "user", "ts", "2500 milliseconds").collect()) == [("a", 1), ("a", 3), ("b", 1)]


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_limiter_keeps_its_state_between_batches(spark, tmp_path):
    src = tmp_path / "in"
    one, two = events(spark, ("a", 0), ("a", 5)), events(spark, ("a", 8), ("a", 12))
    one.where("user is not null").coalesce(1).write.parquet(str(src / "1"))
    two.where("user is not null").selectExpr("user", "ts", "id + 10 as id").coalesce(1).write.parquet(str(src / "2"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    run(L.limited_stream(stream, "user", "ts", "id", L.cooldown_step(10_000_000)), "limited")
    got = {r["id"]: r["accepted"] for r in spark.table("limited").collect()}
    assert len(got) == 4 and sum(got.values()) == 2


def test_change_feed_applies_each_batch(spark, tmp_path):
    spark.range(4).write.parquet(str(tmp_path / "in"))
    seen = []
    q = L.change_feed(spark.readStream.schema("id long").parquet(str(tmp_path / "in")), lambda df: seen.append(df.count()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert sum(seen) == 4
