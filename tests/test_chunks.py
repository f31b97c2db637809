"""Chunked upserts against writing row by row."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from gevel.operators.chunks import after_chunks, chunk_fates
from gevel.operators.kept import numbered

ROW = "place long, k string, u string, v int"


def plainly(table, rows, size):
    """Outcomes by place and the table after all chunks, one row after the other."""
    held = {k: (u, v) for k, u, v in table if k is not None}
    loose = {u for k, u, _ in table if k is None}
    outcomes = {}
    for at in range(0, len(rows), size):
        chunk, new, seen, failed = rows[at : at + size], dict(held), set(), False
        what = {}
        for place, k, u, v in chunk:
            if k in seen or u in loose or any(o != k and x[0] == u for o, x in new.items()):
                failed = True
                break
            seen.add(k)
            what[place] = "updated" if k in new else "inserted"
            new[k] = (u, v)
        outcomes |= {r[0]: "error" for r in chunk} if failed else what
        held = held if failed else new
    return outcomes, held


@pytest.mark.parametrize("seed", range(4))
def test_chunks(spark, seed):
    r = random.Random(seed)
    table = [(f"k{i}", f"u{i}", 0) for i in range(20)] + [(None, "u90", 0), (None, "u91", 0)]
    rows = [(p, f"k{(k := r.randrange(60))}", f"u{k if r.random() < 0.8 else r.randrange(60) if r.random() < 0.97 else 90}", p) for p in range(240)]
    size = 4
    want, after = plainly(table, rows, size)
    assert len(set(want.values())) == 3
    old, new = spark.createDataFrame(table, "k string, u string, v int"), spark.createDataFrame(rows, ROW)
    fates = chunk_fates(old, new, ["k"], "u", size)
    assert {x.place: x.outcome for x in fates.collect()} == want
    got = after_chunks(old, fates, ["k"], ["u", "v"]).collect()
    assert {x.k: (x.u, x.v) for x in got if x.k is not None} == after
    assert sum(x.k is None for x in got) == 2


def test_empty(spark):
    old, new = spark.createDataFrame([("a", "x", 1)], "k string, u string, v int"), spark.createDataFrame([], ROW)
    assert chunk_fates(old, new, ["k"], "u", 5).count() == 0
    assert chunk_fates(old.where("v < 0"), spark.createDataFrame([(0, "a", "x", 1)], ROW), ["k"], "u", 5).first().outcome == "inserted"


def test_numbered(spark):
    df = spark.range(1000).withColumn("x", F.pmod(F.xxhash64("id"), F.lit(97))).repartition(7)
    rows = numbered(df, "place", F.asc("x"), F.desc("id")).collect()
    assert [r.place for r in sorted(rows, key=lambda r: (r.x, -r.id))] == list(range(1000))
    assert numbered(df.where("id < 0"), "place", F.asc("x")).count() == 0
