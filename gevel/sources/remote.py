"""Tables of a remote database, read by ranges of a key, with filters sent along."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that are fetched at once.
FETCH = 10_000
_COMPARED = {ds.EqualTo: "=", ds.GreaterThan: ">", ds.GreaterThanOrEqual: ">=", ds.LessThan: "<", ds.LessThanOrEqual: "<="}


@dataclass
class KeyRange(ds.InputPartition):
    """Keys from `first` on and below `end`; no bound where there is none."""

    first: int | None
    end: int | None


def _name(column: str) -> str:
    return '"' + column.replace('"', '""') + '"'


def condition(f: ds.Filter) -> tuple[str, list] | None:
    """A filter as SQL with its values, None if it is not one that every database takes alike."""
    if isinstance(f, ds.Not):
        inner = condition(f.child)
        return inner and (f"NOT ({inner[0]})", inner[1])
    if len(getattr(f, "attribute", ())) != 1:
        return None
    column = _name(f.attribute[0])
    if isinstance(f, ds.IsNull | ds.IsNotNull):
        return f"{column} IS {'NOT ' if isinstance(f, ds.IsNotNull) else ''}NULL", []
    if isinstance(f, ds.In) and f.value:
        return f"{column} IN ({', '.join('?' * len(f.value))})", list(f.value)
    if type(f) in _COMPARED and isinstance(f.value, int | float | str):
        return f"{column} {_COMPARED[type(f)]} ?", [f.value]
    return None


class RemoteReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.columns, self.options = schema.names, options
        self.conditions: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            found = condition(f)
            if found is None:
                yield f
            else:
                self.conditions.append(found[0])
                self.values += found[1]

    def _rows(self, columns: str, conditions: list[str], values: list) -> Iterator[list[tuple]]:
        o = self.options
        connection = importlib.import_module(o["module"]).connect(o["database"])
        try:
            cursor = connection.cursor()
            if o.get("setup"):
                cursor.execute(o["setup"])
            cursor.execute(f"SELECT {columns} FROM {o['table']} AS t{' WHERE ' if conditions else ''}{' AND '.join(conditions)}", values)
            while some := cursor.fetchmany(FETCH):
                yield some
        finally:
            connection.close()

    def partitions(self) -> list[KeyRange]:
        """Ranges of the key of equal length; the outer ones are open, so rows that come meanwhile are read too."""
        key, n = _name(self.options["key"]), int(self.options.get("partitions", "8"))
        ((low, high),) = next(self._rows(f"min({key}), max({key})", self.conditions, self.values))
        if low is None or n < 2 or low == high:
            return [KeyRange(None, None)]
        cuts = sorted({low + (high + 1 - low) * k // n for k in range(1, n)} - {low})
        return [KeyRange(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, partition: KeyRange) -> Iterator[tuple]:
        key = _name(self.options["key"])
        conditions, values = list(self.conditions), list(self.values)
        if partition.first is not None:
            conditions.append(f"{key} >= ?")
            values.append(partition.first)
        if partition.end is not None:
            conditions.append(f"{key} < ?")
            values.append(partition.end)
        for some in self._rows(", ".join(map(_name, self.columns)), conditions, values):
            yield from some


class RemoteTable(ds.DataSource):
    """Options: module (of a DB-API driver with marks of the form ?), database (what its connect takes), table (a name, or a query in brackets), key (a whole-number column), partitions, setup (a statement that is run on each connection first)."""

    @classmethod
    def name(cls) -> str:
        return "remote_table"

    def reader(self, schema: StructType) -> RemoteReader:
        return RemoteReader(schema, dict(self.options))


def remote_table(spark: SparkSession, schema: str, table: str, key: str, database: str, module: str, partitions: int = 8, setup: str = "") -> DataFrame:
    """A remote table as a DataFrame of several partitions, without rows that have no key. Comparisons of its columns with constants, IN and tests for null are left to the database."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    # The source is made in a process of its own, which may not find this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(RemoteTable)
    rows = spark.read.format("remote_table").schema(schema).options(module=module, database=database, table=table, key=key, partitions=str(partitions), setup=setup).load()
    # Spark keeps the filters of a relation's last scan where the next one sends none, so each scan sends one.
    return rows.where(F.col(key).isNotNull())
