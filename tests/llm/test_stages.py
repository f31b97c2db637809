"""Written tables leave the session as it was, and work gives memory back without changing what it yields."""

from __future__ import annotations

import pyarrow as pa
import pytest

from gevel.llm.stages import dropped, frugal, written

SETTINGS = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")


def batches(n):
    return [pa.RecordBatch.from_pydict({"x": [k] * 3}) for k in range(n)]


def test_frugal_yields_the_same():
    assert [b.to_pydict() for b in frugal(iter)(iter(batches(4)))] == [b.to_pydict() for b in batches(4)]
    assert list(frugal(iter)(iter([]))) == []


def test_frugal_ends_early_and_passes_errors_on():
    run = frugal(iter)(iter(batches(4)))
    next(run)
    run.close()

    def fails(given):
        yield from given
        raise ValueError("work")

    with pytest.raises(ValueError, match="work"):
        list(frugal(fails)(iter(batches(1))))


@pytest.mark.parametrize("rows_at_once", [None, 2])
def test_written_restores_the_session(spark, rows_at_once):
    before = [spark.conf.get(k, None) for k in SETTINGS]
    df = spark.range(10).mapInArrow(frugal(lambda given: given), "id long")
    out = written(df, "stages-test", rows_at_once)
    assert [spark.conf.get(k, None) for k in SETTINGS] == before
    assert sorted(r.id for r in out.collect()) == list(range(10))
    dropped(out)


def test_written_restores_the_session_when_work_fails(spark):
    before = [spark.conf.get(k, None) for k in SETTINGS]
    with pytest.raises(Exception, match="raise_error|no such row"):
        written(spark.range(3).selectExpr("raise_error('no such row') as x"), "stages-test", 2)
    assert [spark.conf.get(k, None) for k in SETTINGS] == before


def test_small_batches_leave_a_setting_alone(spark):
    from gevel.llm.stages import in_small_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.newSession()
    own.conf.set(key, "1m")
    in_small_batches(own)
    assert own.conf.get(key) == "1m"
    fresh = spark.newSession()
    in_small_batches(fresh)
    assert fresh.conf.get(key) == "4m"
    assert written(fresh.range(3).toDF("x"), "small").count() == 3 and fresh.conf.get(key) == "4m"
