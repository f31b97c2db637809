"""Every query with an oracle gives the rows that DuckDB gives for it."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import SF

from gevel import plans


def plain(value):
    return repr(round(value, 6)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = duck.execute(plans.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == names
    theirs = sorted(tuple(plain(row[columns.index(c)]) for c in names) for row in result.fetchall())
    assert ours == theirs


def test_every_query_but_tiles_and_samples_has_an_oracle():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"tile_bytes", "property_grid"}


def varints(data: bytes):
    value = shift = 0
    for b in data:
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            yield value
            value = shift = 0


def fields(data: bytes):
    """(field, value) of a protocol buffer message of numbers and blocks."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number()
            yield key >> 3, data[at : at + size]
            at += size


def decoded(tile: bytes) -> list[dict]:
    """The features of a tile's one layer, as marks with tile_x and tile_y."""
    ((_, layer),) = fields(tile)
    parts = list(fields(layer))
    signed = lambda n: n >> 1 ^ -(n & 1)
    keys = [v.decode() for f, v in parts if f == 3]
    values = [(v.decode() if f == 1 else signed(v) if f == 6 else bool(v)) for k, x in parts if k == 4 for f, v in fields(x)]
    out = []
    for k, x in parts:
        if k == 2:
            own = dict(fields(x))
            tags, (move, dx, dy) = list(varints(own[2])), varints(own[4])
            assert move == 9 and own[3] == 1
            out.append({**{keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}, "tile_x": signed(dx), "tile_y": signed(dy)})
    return out


def test_tiles_hold_what_clusters_and_points_say(spark):
    from gevel.plans import maps
    from gevel.sources.domain import Tables

    t = Tables(spark, SF)
    for zoom, rows, names in ((maps.ZOOM, maps.clusters, None), (maps.POINTS_FROM, maps.points, {"postal_code": "postalCode", "woz_value": "wozValue", "area": "oppervlakte", "built": "bouwjaar", "has_listing": "hasListing", "activity_score": "activityScore"})):
        tiles = {(r.x, r.y): r for r in maps.tiles(t, zoom).collect()}
        assert len(tiles) > 3 and all(len(decoded(r.tile)) == r.features for r in tiles.values())
        for x, y in [maps.TILE] if zoom == maps.ZOOM else sorted(tiles)[:2]:
            want = [{(names or {}).get(c, c): v for c, v in r.asDict().items() if c not in ("cell_x", "cell_y") and v is not None} for r in rows(t, zoom, x, y).collect()]
            assert sorted(map(repr, (sorted(m.items()) for m in want))) == sorted(map(repr, (sorted(m.items()) for m in decoded(tiles[x, y].tile))))


def test_pages_are_in_order(spark):
    for name in ("property_page", "saved_page", "comment_page", "guess_page"):
        rows = plans.queries()[name](spark, SF).collect()
        assert [r.place for r in rows] == list(range(1, len(rows) + 1)) and rows
        assert all(r.total_pages >= 1 and r.total >= len(rows) for r in rows)


def test_samples_are_rows(spark):
    from gevel.sources.domain import Tables

    streets = {r.street for r in Tables(spark, SF).properties.select("street").collect()}
    rows = plans.queries()["property_sample"](spark, SF).collect()
    assert len(rows) == 5 and {r.street for r in rows} <= streets
