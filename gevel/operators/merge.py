"""Writes that keep to keys, as DataFrames of what the table holds afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gevel.operators.rollups import first_of


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], overwrite: Sequence[str], null_keys: bool = True) -> DataFrame:
    """The table after rows are merged by key, with outcome: inserted, updated or kept. Of the columns, `overwrite` come from the row, all others stay; new rows bring what they have. Keys compare null to null as equal; without null_keys the rows' keys must not be null, and rows that are dealt by key already are not dealt again. Rows must have distinct keys."""
    old = table.withColumn("_old", F.lit(True))
    new = rows.withColumn("_new", F.lit(True))
    same = F.lit(True)
    for k in keys:
        same = same & (old[k].eqNullSafe(new[k]) if null_keys else old[k] == new[k])
    both = old.join(new, same, "full_outer")
    out = []
    for c in table.columns:
        if c in rows.columns:
            if c in overwrite or c in keys:
                out.append(F.when(new["_new"], new[c]).otherwise(old[c]).alias(c))
            else:
                out.append(F.when(old["_old"], old[c]).otherwise(new[c]).alias(c))
        else:
            out.append(old[c])
    outcome = F.when(old["_old"].isNull(), "inserted").when(new["_new"].isNull(), "kept").otherwise("updated")
    return both.select(*out, outcome.alias("outcome"))


def inserted_only(table: DataFrame, rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The rows whose key the table has not, one for each key."""
    return first_of(rows, list(keys), *order).join(table.select(*keys).distinct(), list(keys), "left_anti")
