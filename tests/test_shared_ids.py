"""Guesses of different properties that share an id: id is the order's key times 100,000 and the property's key."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

import duckdb
from pyspark.sql import functions as F
from test_queries import plain

from gevel import plans

SF = "/root/testdata/sf0.001"


def test_consensus_of_guesses_that_share_an_id(spark, tmp_path):
    day = datetime(1995, 1, 1)
    orders = [(k, k % 7, day) for k in range(1, 30)]
    # Where the key of a part is divisible by 40 its guesses are of that part.
    lines = [(k, p, 1, price, day) for k in range(1, 30) for p, price in ((40, 20_000.0 + 400 * k), (100_040, 90_000.0 - 2_500 * k))]
    lines += [(30, 80, 1, 100.0, day), (31, 80, 1, -100.0, day), (31, 100_080, 1, -90.0, day)]
    orders += [(30, 1, day), (31, 2, day)]
    made = {
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp"),
        "lineitem": spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp").withColumns({"l_returnflag": F.lit("N"), "l_linestatus": F.lit("F")}),
        "part": spark.createDataFrame([(p, "street", "city", 5, price) for p, price in ((40, 900.0), (80, 1.0), (100_040, 2_000.0), (100_080, 1.0))], "p_partkey long, p_name string, p_type string, p_size int, p_retailprice double"),
    }
    for name, df in made.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    (tmp_path / "customer.parquet").symlink_to(f"{SF}/customer.parquet")
    got = plans.queries()["consensus"](spark, str(tmp_path))
    names = sorted(got.columns)
    rows = got.collect()
    con = duckdb.connect()
    for p in Path(tmp_path).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    result = con.execute(plans.oracle_sql()["consensus"])
    columns = [d[0] for d in result.description]
    want = sorted(tuple(plain(row[columns.index(c)]) for c in names) for row in result.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in rows) == want
    assert max(r["count"] for r in got.groupBy("id", "property_id").count().collect()) == 2
