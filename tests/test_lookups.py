"""Look-ups, pages by tokens, remote tables, sinks and the national grid."""

from __future__ import annotations

import json
import random
import sqlite3
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from gevel.functions.rd import from_rd, with_rd
from gevel.operators.cursors import By, cursor_page
from gevel.operators.substrings import first_held, first_holding
from gevel.plans import lookups, resolutions
from gevel.sources.remote import remote_table
from gevel.sources.sinks import append_batch, responses


def test_substrings_either_way(spark):
    r = random.Random(3)
    docs = [(k, "".join(r.choices("abcd", k=r.randrange(0, 25)))) for k in range(150)] + [(500, None), (501, "xyz" * 9)]
    asked = ["".join(r.choices("abcd", k=n)) for n in (0, 1, 2, 3, 4, 5, 6, 8, 30) for _ in range(12)] + ["q", "yzx", None, "zzz"]
    a, d = spark.createDataFrame([(t, 1) for t in asked], "t string, place int"), spark.createDataFrame(docs, "place int, d string")
    want = {t: min(k for k, x in docs if x is not None and t in x) for t in set(asked) - {None} if any(x is not None and t in x for _, x in docs)}
    found = first_holding(a, "t", d, "d", "place")
    assert {x.t: x.place for x in found.collect()} == want
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    parts = d.withColumn("d", F.substring("d", 1, 6))
    short = [(k, x[:6]) for k, x in docs if x is not None]
    want = {t: min(k for k, x in short if x in t) for t in set(asked) - {None} if any(x in t for _, x in short)}
    assert {x.t: x.place for x in first_held(a, "t", parts, "d", "place").collect()} == want
    assert first_holding(a, "t", d.where("place < 0"), "d", "place").count() == first_held(a, "t", d.where("place < 0"), "d", "place").count() == 0


def test_search_plan_has_no_nested_loop(spark):
    plan = lookups.address_matches(spark, SF)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


@pytest.mark.parametrize("order", [(By("a", down=True), By("b"), By("id")), (By("b"), By("a"), By("id", down=True))])
def test_pages_joined_are_the_whole(spark, order):
    r = random.Random(5)
    df = spark.createDataFrame([(k, r.choice((None, 1, 2, 3)), r.choice((None, "x", "y\'é")), 1.5) for k in range(53)], "id int, a int, b string, c double")
    whole, cursor = [], None
    while rows := cursor_page(df, order, 7, cursor).collect():
        whole += rows
        cursor = rows[-1].cursor
    assert [x.id for x in whole] == [x.id for x in df.orderBy(*(b.order for b in order)).collect()]
    plan = cursor_page(df, order, 7, whole[20].cursor)._jdf.queryExecution().toString()
    assert "Offset" not in plan
    # A row that has gone since still names its place.
    assert [x.id for x in cursor_page(df.where(f"id <> {whole[20].id}"), order, 7, whole[20].cursor).collect()] == [x.id for x in whole[21:28]]
    for wrong in ("no", "W10", "WzFd"):
        with pytest.raises(ValueError, match="cursor"):
            cursor_page(df, order, 7, wrong)


def test_times_and_numbers_in_tokens(spark):
    df = spark.range(40).select("id", F.timestamp_micros(F.col("id") * 1_234_567).alias("at"), (F.col("id") / 7).alias("x"))
    order = (By("at", down=True), By("x"), By("id"))
    first = cursor_page(df, order, 10).collect()
    assert [r.id for r in cursor_page(df, order, 10, first[-1].cursor).collect()] == list(range(29, 19, -1))


@pytest.fixture
def database(tmp_path):
    path = f"{tmp_path}/far.db"
    with sqlite3.connect(path) as con:
        con.execute("create table t (id integer, name text, price real)")
        con.executemany("insert into t values (?, ?, ?)", [(k, None if k % 10 == 0 else f"n{k % 7}", k * 1.5) for k in range(1, 501)] + [(None, "x", 1.0)])
    return path


def test_remote_table(spark, database):
    rows = remote_table(spark, "id bigint, name string, price double", "t", "id", database, "sqlite3", 4)
    assert rows.rdd.getNumPartitions() == 4
    assert rows.count() == 500 and sorted(r.id for r in rows.collect()) == list(range(1, 501))
    some = rows.where("price > 600 and name is not null and id <> 407 and name in ('n1', 'n2') and not name = 'n1' and length(name) = 2")
    plan = some._jdf.queryExecution().toString()
    pushed = next(x for x in plan.splitlines() if "PushedFilters" in x or "BatchScan" in x)
    assert "remote_table" in pushed
    assert sorted(r.id for r in some.collect()) == [k for k in range(401, 501) if k % 10 and k != 407 and k % 7 == 2]
    # Scans of one table with other filters, or none, don't get each other's.
    assert (rows.where("id < 50").count(), rows.count(), rows.where("id >= 50").count(), rows.count()) == (49, 500, 451, 500)
    assert rows.where("id < 0").count() == 0


def test_filters_reach_the_remote_scan(spark, capsys):
    lookups.mirror_prices(spark, SF).explain("formatted")
    plan = capsys.readouterr().out
    assert "BatchScan remote_table" in plan and "IsNotNull(postal_code)" in plan and "IsNotNull(price_cents)" in plan and "Not(EqualTo(postal_code,))" in plan


def test_batches_of_responses(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = responses(spark.range(5).withColumn("tags", F.array(F.lit("a"))), F.lit(5).alias("total"))
    append_batch(df, path, "one")
    append_batch(df.limit(2), path, "two")
    append_batch(df, path, "one")
    rows = spark.read.json(path)
    assert rows.count() == 7 and rows.where("batch = 'one'").count() == 5
    line = json.loads(next(x for p in Path(path).rglob("*.json") for x in p.read_text().splitlines()))
    assert set(line) == {"data", "meta"} and line["data"]["tags"] == ["a"] and line["meta"] == {"total": 5}


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    append_batch(spark.range(3), path, "one")
    bad = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("no")).cast("long")).otherwise(F.col("id")).alias("id"))
    for batch in ("one", "two"):
        with pytest.raises(Exception, match="no"):
            append_batch(bad, path, batch)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2]


def test_national_grid(spark):
    # A golden point of the aerial images: a house in Eindhoven.
    df = spark.createDataFrame([(1, 5.418135001687793, 51.46103902337281), (2, 5.387638888888889, 52.15616055555555), (3, 3.4, 50.8), (4, 7.2, 53.5), (5, None, 52.0)], "id int, lon double, lat double")
    out = with_rd(df).orderBy("id")
    (x, y), *_, last = [(r.rd_x, r.rd_y) for r in out.collect()]
    assert abs(x - 157076) < 0.01 and abs(y - 385753) < 0.01 and last == (None, None)
    back = from_rd(out, lon="lon2", lat="lat2").where("id < 5").collect()
    assert all(abs(r.lon - r.lon2) < 5e-9 and abs(r.lat - r.lat2) < 5e-9 for r in back)
    centre = from_rd(spark.createDataFrame([(155000.0, 463000.0)], "rd_x double, rd_y double")).first()
    assert abs(centre.lon - 5.3877) < 0.01 and abs(centre.lat - 52.155) < 0.01
    assert "Python" not in out._jdf.queryExecution().toString()
    assert lookups.property_grid(spark, SF).where("not back").count() == 0


def test_one_scan_for_all_zooms(spark):
    plan = resolutions.heat_map(spark, SF)
    plan.collect()
    final = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("ReusedExchange") >= resolutions.FINE
    assert "Cartesian" not in final and "NestedLoop" not in final
