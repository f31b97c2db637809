"""Which columns of a request are dealt on the way to its listings."""

from __future__ import annotations

from conftest import SF
from pyspark.sql import functions as F

from gevel.operators import chunks
from gevel.operators.chunks import after_chunks, chunk_fates
from gevel.plans import requests


def test_only_what_decides_a_rows_fate_is_numbered(spark, monkeypatch):
    seen, real = [], requests.numbered
    monkeypatch.setattr(requests, "numbered", lambda df, *a: seen.append(set(df.columns)) or real(df, *a))
    requests.ingest_upsert(spark, SF)
    assert seen == [{"row_id", *requests.KEYS, "source_url", "property_id", "first_seen_at"}]


def test_wide_columns_are_those_of_the_last_good_row(spark):
    old = spark.createDataFrame([("a", "ua", "kept", 0), (None, "ux", "kept", 0), ("b", "ub", "old", 0)], "k string, u string, w string, once int")
    rows = spark.createDataFrame([(10, 0, "b", "ub", 1), (11, 1, "c", "uc", 2), (12, 2, "c", "uc2", 3), (13, 3, "d", "ud", 4), (14, 4, "b", "uc2", 5), (15, 5, "e", "ue", 6)], "row_id long, place long, k string, u string, once int")
    wide = spark.createDataFrame([(i, k, f"w{i}") for i, k in ((10, "b"), (11, "c"), (12, "c"), (13, "d"), (14, "b"), (15, "e"), (16, "e"), (17, "z"))], "row_id long, k string, w string")
    fates = chunk_fates(old, rows, ["k"], "u", 2)
    got = sorted(map(str, (tuple(r) for r in after_chunks(old, fates, ["k"], ["u", "w"], wide=wide).collect())))
    want = [("a", "ua", "kept", 0, "kept"), (None, "ux", "kept", 0, "kept"), ("b", "ub", "w10", 0, "updated"), ("c", "uc2", "w12", 2, "inserted"), ("d", "ud", "w13", 4, "inserted")]
    assert got == sorted(map(str, want))


def test_a_value_twice_in_a_chunk_fails_it(spark, monkeypatch):
    sizes, kept = {}, chunks.kept
    monkeypatch.setattr(chunks, "kept", lambda df, name: sizes.setdefault(name, kept(df, name)))
    old = spark.createDataFrame([], "k string, u string")
    rows = spark.createDataFrame([(0, "a", "u"), (1, "b", "u"), (2, "c", "v"), (3, "c", "v"), (4, "d", "w"), (5, "e", "x")], "place long, k string, u string")
    out = {r.place: r.failed for r in chunk_fates(old, rows, ["k"], "u", 2).collect()}
    assert out == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False}
    assert sizes["shared"].where(F.col("_value") != "u").count() == 0
