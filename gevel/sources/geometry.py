"""Points written as text or as bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"


def wkt_point(text: Column) -> tuple[Column, Column]:
    """Longitude and latitude of POINT(x y), with or without a reference system before it; null for anything else."""
    pattern = rf"(?i)^(?:SRID=[0-9]+;)?\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)\s*$"
    return tuple(F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))


def point_text(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("SRID=4326;POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))


def read_point(data: str | None) -> tuple[float, float] | None:
    """Longitude and latitude of a hexadecimal point in either byte order, with or without a reference system; None for anything else."""
    try:
        raw = bytes.fromhex(data or "")
        order = "<" if raw[0] == 1 else ">"
        (kind,) = struct.unpack(order + "I", raw[1:5])
        at = 9 if kind & 0x20000000 else 5
        return struct.unpack(order + "dd", raw[at : at + 16]) if kind & 0xFF == 1 else None
    except (ValueError, IndexError, struct.error):
        return None


@F.pandas_udf(StructType([StructField("lon", DoubleType()), StructField("lat", DoubleType())]))
def hex_point(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """read_point() of a column, a batch at a time."""
    for part in parts:
        found = [read_point(x) or (None, None) for x in part]
        yield pd.DataFrame({"lon": [x for x, _ in found], "lat": [y for _, y in found]}, dtype=float)
