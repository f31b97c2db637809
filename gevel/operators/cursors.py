"""Pages that begin behind a row, named by an opaque token, for orders of several columns with nulls."""

from __future__ import annotations

import base64
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class By:
    """A column of an order; nulls come last either way."""

    name: str
    down: bool = False

    @property
    def order(self) -> Column:
        return F.desc_nulls_last(self.name) if self.down else F.asc_nulls_last(self.name)

    def behind(self, value: Column, null: bool) -> Column:
        """Whether a row comes behind a value in this column."""
        here = F.col(self.name)
        return F.lit(False) if null else here.isNull() | (here < value if self.down else here > value)

    def beside(self, value: Column, null: bool) -> Column:
        return F.col(self.name).isNull() if null else F.coalesce(F.col(self.name) == value, F.lit(False))


def token(order: Sequence[By]) -> Column:
    """The token that names each row, which goes on behind it."""
    return F.translate(F.base64(F.to_json(F.array(*(F.col(b.name).cast("string") for b in order))).cast("binary")), "+/\r\n", "-_")


def _values(cursor: str, order: Sequence[By]) -> list[str | None]:
    try:
        values = json.loads(base64.urlsafe_b64decode(cursor))
    except ValueError as wrong:
        raise ValueError(f"no cursor: {cursor!r}") from wrong
    if not isinstance(values, list) or len(values) != len(order):
        raise ValueError(f"no cursor of this order: {cursor!r}")
    return values


def behind(df: DataFrame, cursor: str, order: Sequence[By]) -> DataFrame:
    """The rows of df behind the row that a token names, whether or not that row is still there."""
    known, out = F.lit(True), F.lit(False)
    for b, v in zip(order, _values(cursor, order), strict=True):
        value = F.lit(v).cast(df.schema[b.name].dataType)
        out = out | (known & b.behind(value, v is None))
        known = known & b.beside(value, v is None)
    return df.where(out)


def cursor_page(df: DataFrame, order: Sequence[By], size: int = 20, cursor: str | None = None) -> DataFrame:
    """The first `size` rows of df, or of those behind a token, each with its own token (cursor). The order must be total. No row before the page is sorted or counted."""
    if not 1 <= size <= 100:
        raise ValueError(f"a page of {size}: pages hold 1 to 100 rows")
    rows = behind(df, cursor, order) if cursor else df
    return rows.orderBy(*(b.order for b in order)).limit(size).withColumn("cursor", token(order))
