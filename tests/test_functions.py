"""Rules of the domain on known pairs."""

from __future__ import annotations

import json
import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gevel.functions import address, geo, scoring
from gevel.operators.merge import inserted_only, upserted
from gevel.operators.rollups import page
from gevel.operators.spatial import nearest_within
from gevel.sources import files, mvt
from gevel.sources.geometry import hex_point, read_point, wkt_point


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("extra", "shown"), [(None, ""), ("", ""), ("A", "A"), ("1", "-1"), ("BIS", "-BIS"), ("a", "-a")])
def test_shown_addition(spark, extra, shown):
    assert one(spark, address.shown_addition(F.lit(extra).cast("string")))[0] == shown


@pytest.mark.parametrize(("text", "number", "suffix"), [("13A", 13, "A"), ("13 a", 13, "A"), ("13-bis", 13, "BIS"), ("7", 7, None), ("x", None, None)])
def test_house_numbers(spark, text, number, suffix):
    assert tuple(one(spark, address.house_number(F.lit(text)), address.house_suffix(F.lit(text)))) == (number, suffix)


def test_addresses(spark):
    parts = [F.lit(x) for x in ("Keizersgracht", 100, None, "1015AA", "Amsterdam")]
    parts[2] = parts[2].cast("string")
    assert one(spark, address.display_address(*parts))[0] == "Keizersgracht 100, 1015AA Amsterdam"
    parts[3] = F.lit(None).cast("string")
    assert one(spark, address.address(*parts))[0] is None
    assert one(spark, address.display_address(*parts))[0] == "Keizersgracht 100, Amsterdam"
    assert [one(spark, address.postal_code(F.lit(x)))[0] for x in (" 1016 gv ", "1016", "101 6GV1")] == ["1016GV", None, None]
    assert one(spark, address.collapsed(F.lit(" a \t b ")))[0] == "a b"


@pytest.mark.parametrize(("url", "clean", "site", "allowed"), [
    ("HTTPS://WWW.Funda.nl:443/koop/1/?a=b#c", "https://www.funda.nl/koop/1", "funda", True), ("http://pararius.com/x", "http://pararius.com/x", "pararius", False),
    ("https://notfunda.nl/", "https://notfunda.nl", "other", False), ("https://funda.nl.evil.com/", "https://funda.nl.evil.com", "other", False),
])
def test_urls(spark, url, clean, site, allowed):
    x = F.lit(url)
    assert tuple(one(spark, address.source_url(x), address.site(x), address.allowed_url(x))) == (clean, site, allowed)


def test_titles(spark):
    match = lambda title, street, n: one(spark, address.title_match(F.lit(title).cast("string"), F.lit(street), F.lit(n)))[0]
    assert [match("Te koop: Curaçaostraat 12", "curacaostraat", 12), match("Curaçaostraat 112", "Curacaostraat", 12), match("niets", "a b", 1), match(None, "a", 1)] == ["match", "partial", "mismatch", "no title"]
    html = '<meta content="A" property="og:title"><META name="og:image" content="B">'
    assert tuple(one(spark, address.meta_content(F.lit(html), "og:title"), address.meta_content(F.lit(html), "og:image"), address.meta_content(F.lit(html), "og:x"))) == ("A", "B", None)


def test_market_value(spark):
    value = lambda n, crowd, woz=400_000: one(spark, scoring.blended(scoring.confidence(F.lit(n)), F.lit(crowd).cast("long"), F.lit(woz).cast("long")))[0]
    assert [value(1, 500_000), value(2, 550_000), value(3, 550_000), value(10, 500_000), value(0, None), value(0, None, None), value(3, 9, None)] == [430_000, 445_000, 505_000, 500_000, 400_000, None, 9]
    assert one(spark, scoring.divergence(F.lit(392_000), F.lit(395_000)))[0] == -0.76


def test_levels(spark):
    assert [one(spark, scoring.detail_level(F.lit(v), F.lit(c), F.lit(g)))[0] for v, c, g in ((10, 3, 1), (11, 0, 0), (50, 0, 0), (51, 0, 0), (0, 4, 0), (0, 11, 0), (0, 0, 2), (0, 0, 6))] == ["cold", "warm", "warm", "hot", "warm", "hot", "warm", "hot"]
    now = F.lit("2024-01-08 00:00:00").cast("timestamp")
    assert [one(spark, scoring.recency_bonus(F.lit(t).cast("timestamp"), now))[0] for t in ("2024-01-07 23:30:00", "2024-01-07 23:00:00", "2024-01-02 00:00:00", "2024-01-01 00:00:00")] == [10, 5, 2, 0]
    assert [one(spark, scoring.is_meme(F.lit(g), F.lit(w).cast("int")))[0] for g, w in ((19, 100), (20, 100), (500, 100), (501, 100), (1, None), (1, 0))] == [True, False, False, True, False, False]
    assert [one(spark, scoring.half_up(F.lit(x)))[0] for x in (-1.5, -2.5, 2.5)] == [-1, -2, 3]


def spheroid_metres(lon1: float, lat1: float, lon2: float, lat2: float) -> float:
    """Vincenty's inverse formula, iterated."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    length = turn = math.radians(lon2 - lon1)
    for _ in range(100):
        side = math.hypot(math.cos(u2) * math.sin(turn), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(turn))
        if side == 0:
            return 0.0
        along = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(turn)
        arc = math.atan2(side, along)
        lean = math.cos(u1) * math.cos(u2) * math.sin(turn) / side
        flat = 1 - lean**2
        mid = along - 2 * math.sin(u1) * math.sin(u2) / flat if flat else 0.0
        c = f / 16 * flat * (4 + f * (4 - 3 * flat))
        turn = length + (1 - c) * f * lean * (arc + c * side * (mid + c * along * (2 * mid**2 - 1)))
    u = flat * (a * a - b * b) / (b * b)
    big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
    small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    shift = small * side * (mid + small / 4 * (along * (2 * mid**2 - 1) - small / 6 * mid * (4 * side**2 - 3) * (4 * mid**2 - 3)))
    return b * big * (arc - shift)


def test_distances_are_those_of_the_spheroid(spark):
    r = np.random.default_rng(8)
    near = [(x, y, x + dx, y + dy) for x, y, dx, dy in zip(r.uniform(3.5, 7.2, 60), r.uniform(50.7, 53.5, 60), r.uniform(-0.4, 0.4, 60), r.uniform(-0.3, 0.3, 60), strict=True)]
    far = [tuple(x) for x in np.column_stack([r.uniform(-60, 60, 40), r.uniform(-60, 60, 40), r.uniform(-60, 60, 40), r.uniform(-60, 60, 40)])]
    same = [(5.0, 52.0, 5.0, 52.0), (5.0, 52.0, 5.0, 52.1), (5.0, 52.0, 5.1, 52.0), (0.0, 0.0, 1.0, 0.0)]
    rows = [tuple(map(float, x)) for x in near + far + same]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [x[0] for x in df.select(geo.metres(*(F.col(c) for c in "abcd"))).collect()]
    by_sql = [duckdb.sql(f"SELECT {geo.metres_sql(*map(repr, x))}").fetchall()[0][0] for x in rows]
    want = [spheroid_metres(*x) for x in rows]
    assert np.allclose(got, by_sql, rtol=1e-9, atol=1e-6)
    # Of distances in a country, and of any.
    assert all(abs(g - w) <= 1e-5 * w + 1e-6 for g, w in zip(got[:60] + got[100:], want[:60] + want[100:], strict=True))
    assert all(abs(g - w) <= 3e-5 * w for g, w in zip(got[60:100], want[60:100], strict=True))
    inside = df.where(geo.near_box(F.col("c"), F.col("d"), 5.0, 52.0, 25_000)).count()
    assert inside >= sum(spheroid_metres(5.0, 52.0, x[2], x[3]) <= 25_000 for x in rows) > 0


def test_geography(spark):
    zoom, place = 12, (5.1, 52.1)
    west, south, east, north = geo.tile_box(zoom, *geo.tile_at(zoom, *place))
    assert west <= place[0] <= east and south <= place[1] <= north
    assert one(spark, geo.snapped(F.lit(2.5), 1.0), geo.snapped(F.lit(3.5), 1.0))[:] == (2, 4)


def test_points(spark):
    for order, kind in (("<", 1), (">", 1), ("<", 0x20000001)):
        raw = struct.pack(order + "BI", int(order == "<"), kind) + (struct.pack(order + "I", 4326) if kind > 1 else b"") + struct.pack(order + "dd", 4.5, 52.25)
        assert read_point(raw.hex()) == (4.5, 52.25)
    rows = spark.createDataFrame([(raw.hex(),), ("zz",), (None,)], "g string").select(hex_point("g").alias("p")).collect()
    assert [(r.p.lon, r.p.lat) for r in rows] == [(4.5, 52.25), (None, None), (None, None)]
    assert tuple(one(spark, *wkt_point(F.lit("SRID=4326;POINT(4.5 -52.25)")))) == (4.5, -52.25)
    assert tuple(one(spark, *wkt_point(F.lit("LINE(1 2)")))) == (None, None)


def test_vector_tile():
    tile = mvt.encoded("l", [(3, -2)], [{"a": True, "b": 5}])
    assert tile[0] == 0x1A and tile[1] == len(tile) - 2 and b"\x0a\x01l" in tile and b"\x09\x06\x03" in tile


def test_nearest_is_that_of_all_pairs(spark):
    import random

    r = random.Random(1)
    probes = [(i, r.uniform(4, 4.02), r.uniform(52, 52.02)) for i in range(80)] + [(900, None, 1.0)]
    places = [(i, r.uniform(4, 4.02), r.uniform(52, 52.02)) for i in range(200)] + [(901, 4.0, None)]
    p, q = spark.createDataFrame(probes, "i long, lon double, lat double"), spark.createDataFrame(places, "j long, lon double, lat double")
    for square in (False, True):
        found = {x.i: x.j for x in nearest_within(p, "i", q, "j", 0.001, square).collect()}
        want = {}
        for i, x, y in probes[:-1]:
            near = [(((u - x) ** 2 + (v - y) ** 2) ** 0.5, j) for j, u, v in places[:-1] if (max(abs(u - x), abs(v - y)) if square else ((u - x) ** 2 + (v - y) ** 2) ** 0.5) <= 0.001]
            if near:
                want[i] = min(near)[1]
        assert found == want
    assert "BroadcastNestedLoop" not in nearest_within(p, "i", q, "j", 0.001)._jdf.queryExecution().executedPlan().toString()


def test_merge(spark):
    table = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (None, "n", "z")], "k int, v string, kept string")
    rows = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z"), (None, "N", "W")], "k int, v string, kept string")
    got = {r.k: tuple(r)[1:] for r in upserted(table, rows, ["k"], ["v"]).collect()}
    assert got == {1: ("a", "x", "kept"), 2: ("B", "y", "updated"), 3: ("C", "Z", "inserted"), None: ("N", "z", "updated")}
    assert [r.k for r in inserted_only(table, rows.where("k is not null"), ["k"], F.asc("v")).collect()] == [3]


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        page(spark.range(3), F.asc("id"), number=0)
    assert [r.id for r in page(spark.range(30), F.desc("id"), number=2, size=10).collect()] == list(range(19, 9, -1))


def test_register_extracts_as_files(spark, tmp_path):
    row = ("POINT (4.5 52.2)", "R1", "77", "1999", "in \"gebruik\", nu", "Straat\nWeg", "12", "", "1", "1234 ab", "X")
    df = spark.createDataFrame([row, ("", *row[1:])], files.STAGING)
    files.write_staged(df, f"{tmp_path}/register")
    assert sorted(map(tuple, files.staged(spark, f"{tmp_path}/register").collect())) == sorted([row, ("", *row[1:])])


def test_bodies_of_listings(spark, tmp_path):
    good = {"sourceUrl": "https://www.funda.nl/1", "sourceName": "funda", "mirrorListingId": "m1", "askingPrice": None, "priceType": "sale", "address": {"postalCode": "1234AB", "houseNumber": 12}, "priceHistory": [{"price": 5, "priceDate": "2024-01-01", "eventType": "sold"}]}
    bodies = {
        "good": {"listings": [good, {**good, "status": "sold", "priceHistory": []}]}, "none": {"listings": []}, "source": {"listings": [good, {**good, "sourceName": "x"}]}, "status": {"listings": [{**good, "status": "x"}]},
        "address": {"listings": [{k: v for k, v in good.items() if k != "address"}]}, "event": {"listings": [{**good, "priceHistory": [{"price": 5}]}]}, "other": {"x": 1},
    }
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    (tmp_path / "broken.json").write_text("{")
    (tmp_path / "empty.json").write_text("")
    rows = files.listings_of(files.read_bodies(spark, f"{tmp_path}/*.json"), "path", "body")
    assert sorted((r.path.rsplit("/", 1)[-1], r.place, r.house_number, r.status, r.asking_price) for r in rows.collect()) == [("good.json", 0, "12", "active", None), ("good.json", 1, "12", "sold", None)]
    assert [tuple(r) for r in files.price_history_of(rows, "mirror_id").collect()] == [("m1", 5, "2024-01-01", "sold")]


def test_canonical_addresses(spark):
    rows = [
        (1, " Kerk \t straat ", " 13 -bis ", None, "1234 ab", "Den  Haag"), (2, None, "13bis", " c ", "1234\tAB", None), (3, "x", "nr 5", "a", "1234AB", "y"), (4, "x", " ", "a", "1234AB", "y"),
        (5, "x", None, None, "1234AB", "y"), (6, "x", "nr 5", None, "12 AB", "y"), (7, "x", "5", None, None, "y"), (8, "x", "-5", None, "1234AB", "y"), (9, "x", "99999999999", None, "1234AB", "y"), (10, "x", "5 / 2", "", "1234AB", "y"),
    ]
    df = spark.createDataFrame(rows, "id int, street string, number string, extra string, code string, city string")
    got = {r.id: tuple(r)[1:] for r in df.select("id", address.canonical(*(F.col(c) for c in df.columns[1:])).alias("x")).select("id", "x.*").collect()}
    none = (None,) * 5
    fault = lambda text: ("error", f"Invalid house number: {text}", *none)
    assert got == {
        1: ("ok", None, "Kerk straat", 13, "BIS", "1234AB", "Den Haag"), 2: ("ok", None, "", 13, "C", "1234AB", ""), 3: fault('"nr 5" does not start with a digit'), 4: fault("received empty string"), 5: fault("received empty string"),
        6: ("null", None, *none), 7: ("null", None, *none), 8: fault('"-5" does not start with a digit'), 9: fault('"99999999999" is out of range'), 10: ("ok", None, "x", 5, "2", "1234AB", "y"),
    }
    faults = spark.createDataFrame([(5.0,), (0.0,), (-1.0,), (2.5,), (float("nan"),), (None,)], "x double").select(address.whole_number_fault(F.col("x")).isNull().alias("ok")).collect()
    assert [r.ok for r in faults] == [True, True, False, False, False, False]
