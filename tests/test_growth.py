"""What must not grow with the tables: what goes to all tasks, what one task gets, what is dealt again."""

from __future__ import annotations

import re

from conftest import SF
from pyspark.sql import functions as F

from gevel.operators import chunks
from gevel.operators.spatial import nearest_within
from gevel.operators.substrings import first_holding
from gevel.plans import batches, ingest, lookups, valuation, writes
from gevel.sources import remote
from gevel.sources.domain import Tables


def plan_of(df) -> str:
    """The physical plan as it ran."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def below(plan: str, node: str) -> list[str]:
    """The text of each subtree under a node of that name."""
    lines = plan.splitlines()
    depth = [len(re.match(r"[ :+\-]*(\*\(\d+\) )?", x).group(0).replace("*", "").split("(")[0]) for x in lines]
    out = []
    for k, line in enumerate(lines):
        if re.match(rf"[ :+\-]*(\*\(\d+\) )?{node}\b", line):
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            out.append("\n".join(lines[k + 1 : end]))
    return out


def test_no_index_of_docs_goes_to_all_tasks(spark):
    docs = spark.range(300).select(F.col("id").alias("place"), F.concat(F.lit("street "), F.col("id")).alias("d"))
    asked = spark.range(2000).select(F.concat(F.lit("eet "), F.col("id")).alias("t"))
    found = first_holding(asked, "t", docs, "d", "place")
    sent = below(plan_of(found), "BroadcastExchange")
    assert sent and not any("Generate" in x for x in sent)
    assert found.count() == 300


def test_searches_send_no_table_of_places(spark):
    sent = below(plan_of(lookups.address_matches(spark, SF)), "BroadcastExchange")
    assert not any("Generate explode(array_distinct" in x or "p_retailprice" in x for x in sent) and not any(re.search(r"p_name.*part\.parquet|part\.parquet.*p_name", x, re.S) and "event_id" not in x for x in sent)


def test_rows_without_an_address_do_not_meet_in_one_task(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = ingest.matched(Tables(spark, SF)).groupBy(F.spark_partition_id()).agg(F.count("*").alias("count"), F.max("how"), F.max("property_id")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sizes = [r["count"] for r in parts]
    assert max(sizes) < sum(sizes) / 2


def test_places_at_one_position_meet_a_probe_once(spark):
    places = spark.range(1000).select("id", F.lit(5.0).alias("lon"), F.lit(52.0).alias("lat"))
    found = nearest_within(spark.createDataFrame([(1, 5.0004, 52.0)], "probe int, lon double, lat double"), "probe", places, "id", 0.001)
    assert [(r.probe, r.id) for r in found.collect()] == [(1, 0)]
    assert "partial_min(id" in plan_of(found)


def test_events_of_listings_are_not_dealt_once_made(spark):
    plan = plan_of(writes.price_event_writes(spark, SF))
    assert "Generate inline" in plan and not any("Generate inline" in x for x in below(plan, "Exchange"))


def test_outcomes_need_no_window(spark):
    assert "Window" not in plan_of(ingest.ingest_outcomes(spark, SF))


def test_turns_of_chunks_see_only_values_that_keys_share(spark, monkeypatch):
    sizes, kept = [], chunks.kept

    def seen(df, name):
        out = kept(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(chunks, "kept", seen)
    rows = spark.range(200).select(F.col("id").alias("place"), F.concat(F.lit("k"), F.col("id")).alias("k"), F.concat(F.lit("u"), F.when(F.col("id") == 150, 7).otherwise(F.col("id"))).alias("u"))
    fates = chunks.chunk_fates(spark.createDataFrame([("old", "v")], "k string, u string"), rows, ["k"], "u", 10)
    assert sorted(r.place for r in fates.where("failed").collect()) == list(range(150, 160))
    assert max(sizes) < 60


def test_the_remote_database_joins_nothing(spark, monkeypatch):
    tables, real = [], lookups.remote_table
    monkeypatch.setattr(lookups, "remote_table", lambda *a, **k: tables.append((a, k)) or real(*a, **k))
    assert lookups.mirror_prices(spark, SF).count() > 0
    assert len(tables) == 2 and not any("JOIN" in a[2].upper() for a, _ in tables) and all(k["setup"] == "SET threads TO 1" for _, k in tables)


def test_what_is_run_on_connecting():
    made = remote.RemoteReader.__new__(remote.RemoteReader)
    made.options = {"module": "duckdb", "database": ":memory:", "table": "(select current_setting('threads') as n)", "setup": "SET threads TO 1"}
    assert [x for some in made._rows("n", [], []) for x in some] == [(1,)]


def test_bodies_are_written_compressed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(batches, "files_path", lambda *_: f"{tmp_path}/bodies")
    assert batches.batch_files(spark, SF).count() > 0
    assert list(tmp_path.glob("bodies/part-*")) and all(x.name.endswith(".gz") for x in tmp_path.glob("bodies/part-*"))


def test_guesses_are_made_once(spark):
    assert "o_custkey" not in plan_of(valuation.consensus(spark, SF))
