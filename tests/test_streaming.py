"""Streams agree with what batches give."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import functions as F

from gevel.operators.dedup import hourly
from gevel.sources.dealt import create_dealt, read_dealt, upsert_dealt
from gevel.streaming.views import hourly_stream, upsert_stream, weekly_counts

BEGIN = 1_700_000_000
VIEWS = "id long, property_id long, user_id long, session_id string, viewed_at timestamp"


def views(spark, rows):
    df = spark.createDataFrame(rows, "id long, property_id long, user_id long, session_id string, t long")
    return df.select("id", "property_id", "user_id", "session_id", F.timestamp_seconds(F.col("t") + BEGIN).alias("viewed_at"))


def plainly_counted(rows):
    """Ids of the views that count, one view after the other."""
    held, out = [], []
    for ident, prop, user, session, t in sorted(rows, key=lambda r: (r[4], r[0])):
        near = [h for h in held if h[0] == prop and t - h[3] < 3600]
        seen = any(h[1] == user for h in near) if user is not None else session is not None and any(h[2] == session for h in near)
        if not seen:
            held.append((prop, user, session, t))
            out.append(ident)
    return sorted(out)


def random_views(n, seed):
    r = random.Random(seed)
    return [(k, r.randrange(3), r.choice((None, None, 1, 2, 3)), r.choice((None, "a", "b", "c")), r.randrange(0, 40_000)) for k in range(n)]


def test_a_users_view_holds_back_its_session(spark):
    rows = [(1, 1, 7, "s", 0), (2, 1, None, "s", 600), (3, 1, None, "s", 3600), (4, 1, 7, "t", 3599), (5, 1, 8, "s", 3700), (6, 1, None, "s", 7290), (7, 1, None, "s", 7300), (8, 1, None, None, 1), (9, 1, None, None, 2), (10, 1, 8, "s", 3700)]
    assert sorted(r.id for r in hourly(views(spark, rows)).collect()) == plainly_counted(rows) == [1, 3, 5, 7, 8, 9]


def test_hourly_equals_going_through(spark):
    rows = random_views(400, 1)
    assert sorted(r.id for r in hourly(views(spark, rows)).collect()) == plainly_counted(rows)
    assert hourly(views(spark, rows).where("id < 0")).count() == 0


def streamed(spark, folder, parts, held=None):
    """Ids of the views that count in a stream of these parts, one after the other."""
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{folder}/in{k}")
        name = f"{folder}/in/{k}"
        spark.read.parquet(f"{folder}/in{k}").coalesce(1).write.parquet(name)
        source = spark.readStream.schema(VIEWS).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        hourly_stream(source, held=held).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination(180)
    return sorted(r.id for r in spark.read.parquet(f"{folder}/out").collect())


def test_hourly_stream_and_its_start_from_a_table(spark, tmp_path):
    rows = [r for r in random_views(300, 2) if r[2] is not None or r[3] is not None]
    end = [(9000 + p, 99, 1, "z", 200_000) for p in range(1)]
    early, late = [r for r in rows if r[4] < 20_000], [r for r in rows if r[4] >= 20_000]
    whole = plainly_counted(rows)
    table = lambda some: views(spark, some)
    # What comes within the lateness may come in any order.
    mixed = sorted(early, key=lambda r: r[4] // 500 * 500 + (r[0] * 7919) % 500)
    cut = len(mixed) // 2
    soon = [r for r in mixed[:cut] if r[4] < mixed[cut][4] + 500]
    assert streamed(spark, tmp_path / "whole", [table(soon), table([r for r in mixed if r not in soon]), table(late), table(end)]) == whole
    before = hourly(table(early))
    assert streamed(spark, tmp_path / "restart", [table(late), table(end)], held=before) == sorted(set(whole) - {r.id for r in before.collect()})


def files(path):
    return {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet") if "_batches" not in str(p)}


def test_upsert_stream(spark, tmp_path):
    create_dealt(spark.createDataFrame([(9, "z", 0)], "k int, v string, at int"), f"{tmp_path}/out", ["k"], 8)
    for rows in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 3), (2, "B", 2), (3, "d", 1)]):
        spark.createDataFrame(rows, "k int, v string, at int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(spark.readStream.schema("k int, v string, at int").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", ["k"], ["v", "at"], "at", 8, f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r.k, r.v) for r in read_dealt(spark, f"{tmp_path}/out").collect()) == [(1, "a"), (2, "c"), (3, "d"), (9, "z")]


def test_upserts_touch_only_their_parts(spark, tmp_path):
    path, parts = f"{tmp_path}/t", 50
    create_dealt(spark.range(20_000).selectExpr("id AS k", "id * 2 AS v", "'geo' AS place"), path, ["k"], parts)
    before = files(path)
    rows = spark.createDataFrame([(7, -1), (8, -2), (90_000, -3)], "k long, v long")
    upsert_dealt(rows, path, ["k"], ["v"], parts, "one")
    after = files(path)
    assert len(set(before) - set(after)) <= 3 and len(set(before) & set(after)) >= parts - 3
    assert sum(p.stat().st_size for p in set(after) - set(before)) < 0.2 * sum(p.stat().st_size for p in after)
    got = {r.k: (r.v, r.place) for r in read_dealt(spark, path).collect()}
    assert len(got) == 20_001 and got[7] == (-1, "geo") and got[8] == (-2, "geo") and got[90_000] == (-3, None) and got[9] == (18, "geo")
    # A batch that is marked changes nothing, though other batches have come since.
    upsert_dealt(spark.createDataFrame([(7, -10)], "k long, v long"), path, ["k"], ["v"], parts, "two")
    held = files(path)
    upsert_dealt(rows, path, ["k"], ["v"], parts, "one")
    assert files(path) == held and read_dealt(spark, path).where("k = 7").first().v == -10
    upsert_dealt(rows.where("k < 0"), path, ["k"], ["v"], parts, "none")
    assert files(path) == held


def test_weekly_counts(spark, tmp_path):
    df = views(spark, [(k, k % 2, None, None, 86_400 * k) for k in range(20)])
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = weekly_counts(spark.readStream.schema(VIEWS).parquet(f"{tmp_path}/in"), "property_id", "viewed_at")
    stream.writeStream.format("memory").queryName("weeks").outputMode("complete").trigger(availableNow=True).start().awaitTermination(120)
    batch = weekly_counts(df, "property_id", "viewed_at")
    assert sorted(map(tuple, spark.table("weeks").collect())) == sorted(map(tuple, batch.collect()))
    assert {r.n for r in batch.collect()} == {1, 2, 3, 4}
