"""Folds over time: what counts only some time after the last of its kind that counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600


def spaced_rows(rows: DataFrame, keys: Sequence[str], at: str, seconds: int, tie: str, always: Column | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Of rows, (keys, at, tie, carry, always) of those that count: the first of each key, and each later one that is so many seconds or more after the last that counted. Rows for which `always` holds count anyhow, and hold back those after them. Equal times are taken by `tie`. Keys must not be null.

    Rows are cut into runs at gaps of that length, where the next always counts; only within a run are they gone through in order, so no task holds more than one run of one key.
    """
    key = Window.partitionBy(*keys).orderBy(at, tie)
    micros = F.unix_micros(at)
    gap = micros - F.lag(micros).over(key)
    always = F.coalesce(always, F.lit(False)) if always is not None else F.lit(False)
    runs = rows.select(*keys, at, tie, *carry, always.alias("always")).withColumn("_begins", (gap.isNull() | (gap >= seconds * 1_000_000)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_begins").over(key))
    row = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col("always").alias("always"), *(F.col(c).alias(f"c{k}") for k, c in enumerate(carry)))
    kind = f"array<{runs.select(row.alias('r')).schema['r'].dataType.simpleString()}>"
    kept = F.aggregate(
        F.sort_array(F.collect_list(row)),
        F.array().cast(kind),
        lambda found, x: F.when(x["always"] | (F.size(found) == 0) | (F.unix_micros(x["at"]) - F.unix_micros(F.try_element_at(found, F.lit(-1))["at"]) >= seconds * 1_000_000), F.concat(found, F.array(x))).otherwise(found),
    )
    out = runs.groupBy(*keys, "_run").agg(kept.alias("_kept")).select(*keys, F.explode("_kept").alias("_r"))
    return out.select(*keys, F.col("_r.at").alias(at), F.col("_r.tie").alias(tie), *(F.col(f"_r.c{k}").alias(c) for k, c in enumerate(carry)), F.col("_r.always").alias("always"))


def spaced(rows: DataFrame, keys: Sequence[str], at: str, seconds: int) -> DataFrame:
    """The times (keys, at) that count, see spaced_rows."""
    return spaced_rows(rows.withColumn("_tie", F.lit(0)), keys, at, seconds, "_tie").select(*keys, at)


def hourly(views: DataFrame) -> DataFrame:
    """(id, property_id, viewer, viewed_at, user_id, session_id) of the views that count, of (id, property_id, user_id, session_id, viewed_at); equal times are taken by id.

    A view of a user counts if none of that user counted in the hour before it, whatever its session. A view of a session without a user counts if none of that session counted in that hour, be it a user's or not. So users' views are gone through first, and those that count hold back their sessions' views. Unknown viewers (neither user nor session) all count.
    """
    rows = views.select("id", "property_id", "user_id", "session_id", "viewed_at")
    users = spaced_rows(rows.where("user_id is not null"), ["property_id", "user_id"], "viewed_at", HOUR, "id", carry=["session_id"]).drop("always")
    known = rows.where("user_id is null and session_id is not null").withColumn("of_user", F.lit(False))
    blockers = users.where("session_id is not null").withColumn("of_user", F.lit(True))
    sessions = spaced_rows(known.unionByName(blockers), ["property_id", "session_id"], "viewed_at", HOUR, "id", F.col("of_user")).where("not always").drop("always")
    out = users.unionByName(sessions.withColumn("user_id", F.lit(None).cast(rows.schema["user_id"].dataType))).unionByName(rows.where("user_id is null and session_id is null"))
    return out.withColumn("viewer", F.coalesce(F.col("user_id").cast("string"), "session_id")).select("id", "property_id", "viewer", "viewed_at", "user_id", "session_id")
