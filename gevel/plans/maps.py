"""Properties on the map: nearest ones, taps, clusters and tiles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gevel.functions import address, geo
from gevel.operators.rollups import ACTIVITY_SQL, activity
from gevel.sources.domain import Tables, with_domain
from gevel.sources.mvt import encoded

#: From this zoom on, each property is shown for itself.
POINTS_FROM = 17
PLACE = (5.0, 52.0)
ZOOM = 7
TILE = geo.tile_at(ZOOM, *PLACE)


def _active(t: Tables) -> DataFrame:
    """Active properties with a position, their activity, and whether any listing is active: one row each."""
    listed = t.listings.where("status = 'active'").select(F.col("property_id").alias("id")).distinct().withColumn("has_listing", F.lit(True))
    rows = t.properties.where("status = 'active' and lon is not null and lat is not null")
    rows = rows.join(listed, "id", "left").join(activity(t).withColumnRenamed("property_id", "id"), "id", "left")
    return rows.withColumn("has_listing", F.coalesce("has_listing", F.lit(False))).withColumn("activity_score", F.coalesce("activity_score", F.lit(0)).cast("int"))


def _by_listing(t: Tables, box: tuple[float, float, float, float]) -> DataFrame:
    """As _active within a box, bounds inside, but one row for each active listing: a property with two counts twice, as map tiles have it."""
    west, south, east, north = box
    rows = t.properties.where("status = 'active'").where(F.col("lon").between(west, east) & F.col("lat").between(south, north))
    listed = t.listings.where("status = 'active'").select(F.col("property_id").alias("id"), F.col("id").alias("listing_id"))
    rows = rows.join(listed, "id", "left").join(activity(t).withColumnRenamed("property_id", "id"), "id", "left")
    return rows.withColumn("has_listing", F.col("listing_id").isNotNull()).withColumn("activity_score", F.coalesce("activity_score", F.lit(0)).cast("int"))


def _distance(lon: float, lat: float) -> Column:
    return geo.metres(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))


def nearby(t: Tables, lon: float, lat: float, zoom: int = 17, limit: int = 5) -> DataFrame:
    """The nearest active properties within 25 pixels of a zoom, nearest first, at most 20."""
    if not 0 <= zoom <= 22 or not 1 <= limit <= 20:
        raise ValueError("zoom 0 to 22, limit 1 to 20")
    reach = geo.tap_radius(zoom)
    near = F.col("lon").between(lon - reach, lon + reach) & F.col("lat").between(lat - reach, lat + reach) & (geo.degrees(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= reach)
    rows = _active(t).where(near).withColumn("distance", _distance(lon, lat))
    return rows.orderBy("distance", "id").limit(limit).select("id", "city", "woz_value", "has_listing", "activity_score", geo.rounded(F.col("distance"), 3).alias("distance_m"), "lon", "lat")


def map_nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearby(Tables(spark, sf_dir), *PLACE, zoom=8, limit=20)


def tapped(t: Tables, lon: float, lat: float, zoom: int) -> DataFrame:
    """What a tap on the map hits: one property (its id, point_count 1) or the active ones of its cell (point_count, ids by distance, centre); no row if nothing."""
    if zoom >= POINTS_FROM:
        return nearby(t, lon, lat, zoom, 1).select(F.lit(1).alias("point_count"), F.col("id").cast("string").alias("property_ids"), F.col("lon").alias("centre_lon"), F.col("lat").alias("centre_lat"), "distance_m")
    size = geo.cell_size(zoom)
    same = (geo.snapped(F.col("lon"), size) == geo.snapped(F.lit(lon), size)) & (geo.snapped(F.col("lat"), size) == geo.snapped(F.lit(lat), size))
    near = geo.degrees(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= 1.5 * size
    rows = _active(t).where(same & near & (F.col("has_listing") | (F.col("activity_score") > 0))).withColumn("distance", _distance(lon, lat))
    whole = rows.agg(F.count("*").cast("int").alias("point_count"), F.sort_array(F.collect_list(F.struct("distance", "id"))).alias("members"), F.avg("lon").alias("x"), F.avg("lat").alias("y"))
    ids = F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",")
    return whole.where("point_count > 0").select("point_count", ids.alias("property_ids"), geo.rounded(F.col("x"), 6).alias("centre_lon"), geo.rounded(F.col("y"), 6).alias("centre_lat"), geo.rounded(F.element_at("members", 1)["distance"], 3).alias("distance_m"))


def map_tap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tapped(Tables(spark, sf_dir), *PLACE, zoom=9)


def _cluster() -> tuple[Column, ...]:
    """What is known of the members of a grid cell."""
    return (
        F.count("*").cast("int").alias("point_count"), F.avg("lon").alias("lon"), F.avg("lat").alias("lat"), F.max("has_listing").alias("has_active_children"),
        F.sum("activity_score").cast("int").alias("total_activity"), F.max("activity_score").alias("max_activity"),
        F.sort_array(F.collect_list(F.struct((-F.col("activity_score")).alias("order"), "id"))).alias("members"),
    )


def _member_ids() -> Column:
    return F.array_join(F.transform("members", lambda m: m["id"].cast("string")), ",")


def clusters(t: Tables, zoom: int, x: int, y: int) -> DataFrame:
    """A tile's clusters of active properties: count, whether any is on offer, activity, ids by activity, and place on the tile."""
    box, size = geo.tile_box(zoom, x, y), geo.cell_size(zoom)
    rows = _by_listing(t, box).where(F.col("has_listing") | (F.col("activity_score") > 0))
    # Within a cell, ids are joined by an aggregation over its members: a cell of a tile is bounded by what a map shows.
    cells = rows.groupBy(geo.snapped(F.col("lon"), size).alias("cell_x"), geo.snapped(F.col("lat"), size).alias("cell_y")).agg(*_cluster())
    at_x, at_y = geo.on_tile(F.col("lon"), F.col("lat"), box)
    return cells.select("cell_x", "cell_y", "point_count", "has_active_children", "total_activity", "max_activity", _member_ids().alias("property_ids"), at_x.alias("tile_x"), at_y.alias("tile_y"))


def tile_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters(Tables(spark, sf_dir), ZOOM, *TILE)


def previews(t: Tables, zoom: int, x: int, y: int, most: int = 50) -> DataFrame:
    """What opens when a tile's clusters are tapped: of each the first properties of its list, at most `most`, in its order."""
    rows = _by_listing(t, geo.tile_box(zoom, x, y)).where(F.col("has_listing") | (F.col("activity_score") > 0))
    size = geo.cell_size(zoom)
    rows = rows.withColumn("cell_x", geo.snapped(F.col("lon"), size)).withColumn("cell_y", geo.snapped(F.col("lat"), size))
    # Tasks keep the first rows of each cell before they are dealt by cell, so a full one is no one's burden.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("cell_x", "cell_y").orderBy(F.desc("activity_score"), F.asc("id")))).where(F.col("place") <= most)
    line = F.concat(F.col("street"), F.lit(" "), F.col("house_number").cast("string"), address.shown_addition(F.col("house_number_addition")))
    return rows.select("cell_x", "cell_y", "place", "id", line.alias("address"), "city", "woz_value", "has_listing", "activity_score")


def cluster_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previews(Tables(spark, sf_dir), ZOOM, *TILE)


def points(t: Tables, zoom: int, x: int, y: int) -> DataFrame:
    """A tile's properties one by one, also those where nothing happens (ghosts)."""
    box = geo.tile_box(zoom, x, y)
    at_x, at_y = geo.on_tile(F.col("lon"), F.col("lat"), box)
    line = F.concat(F.col("street"), F.lit(" "), F.col("house_number").cast("string"), address.shown_addition(F.col("house_number_addition")))
    ghost = ~F.col("has_listing") & (F.col("activity_score") == 0)
    return _by_listing(t, box).select("id", line.alias("address"), "city", "postal_code", "woz_value", "area", "built", "has_listing", "activity_score", ghost.alias("is_ghost"), at_x.alias("tile_x"), at_y.alias("tile_y"))


def tile_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(Tables(spark, sf_dir), ZOOM, *TILE)


#: Every place there is.
WORLD = (-180.0, -85.0, 180.0, 85.0)


def _encoded(rows: DataFrame, zoom: int, names: dict[str, str]) -> DataFrame:
    """(zoom, x, y, features, tile) of rows (x, y, tile_x, tile_y, and the columns of names, which become marks by their names; null ones are left out)."""

    def encode(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["tile_x", "tile_y", *names], kind="stable")
        plain = {c: [None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in group[c]] for c in names}
        marks = [{names[c]: plain[c][k] for c in names if plain[c][k] is not None} for k in range(len(group))]
        marks = [{n: int(v) if isinstance(v, float) else v for n, v in m.items()} for m in marks]
        return pd.DataFrame({"zoom": [zoom], "x": [int(key[0])], "y": [int(key[1])], "features": [len(group)], "tile": [encoded("properties", list(zip(group["tile_x"], group["tile_y"], strict=True)), marks)]})

    return rows.select("x", "y", "tile_x", "tile_y", *names).groupBy("x", "y").applyInPandas(encode, "zoom int, x int, y int, features int, tile binary")


def tiles(t: Tables, zoom: int) -> DataFrame:
    """All vector tiles of a zoom: below POINTS_FROM of clusters, which are made first, so that a tile holds as many features as it has grid cells at most; from there on of single properties."""
    rows = _by_listing(t, WORLD)
    x, y = geo.tile_of(F.col("lon"), F.col("lat"), zoom)
    rows = rows.withColumn("x", x).withColumn("y", y)
    if zoom >= POINTS_FROM:
        at_x, at_y = geo.on_own_tile(F.col("lon"), F.col("lat"), zoom, F.col("x"), F.col("y"))
        line = F.concat(F.col("street"), F.lit(" "), F.col("house_number").cast("string"), address.shown_addition(F.col("house_number_addition")))
        rows = rows.withColumn("address", line).withColumn("is_ghost", ~F.col("has_listing") & (F.col("activity_score") == 0)).withColumn("tile_x", at_x).withColumn("tile_y", at_y)
        return _encoded(rows, zoom, {"id": "id", "address": "address", "city": "city", "postal_code": "postalCode", "woz_value": "wozValue", "area": "oppervlakte", "built": "bouwjaar", "has_listing": "hasListing", "activity_score": "activityScore", "is_ghost": "is_ghost"})
    size = geo.cell_size(zoom)
    cells = rows.where(F.col("has_listing") | (F.col("activity_score") > 0)).groupBy("x", "y", geo.snapped(F.col("lon"), size).alias("cell_x"), geo.snapped(F.col("lat"), size).alias("cell_y")).agg(*_cluster())
    at_x, at_y = geo.on_own_tile(F.col("lon"), F.col("lat"), zoom, F.col("x"), F.col("y"))
    cells = cells.withColumn("property_ids", _member_ids()).withColumn("tile_x", at_x).withColumn("tile_y", at_y)
    return _encoded(cells, zoom, {n: n for n in ("point_count", "has_active_children", "total_activity", "max_activity", "property_ids")})


def tile_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zoom, x, y, features, tile): vector tiles of the whole country, of clusters at a low zoom and of properties at the first zoom that shows them."""
    t = Tables(spark, sf_dir)
    return tiles(t, ZOOM).unionByName(tiles(t, POINTS_FROM))


_NEED = ("properties", "listings", "comments", "price_guesses")
_ACTIVE_SQL = f"""WITH a AS ({ACTIVITY_SQL}), q AS (SELECT p.*, EXISTS (SELECT 1 FROM listings l WHERE l.property_id = p.id AND l.status = 'active') AS has_listing, CAST(coalesce(a.activity_score, 0) AS INTEGER) AS activity_score
FROM properties p LEFT JOIN a ON a.property_id = p.id WHERE p.status = 'active' AND p.lon IS NOT NULL) """
_BOX = geo.tile_box(ZOOM, *TILE)
_BY_LISTING_SQL = f"""WITH a AS ({ACTIVITY_SQL}), q AS (SELECT p.*, l.id IS NOT NULL AS has_listing, CAST(coalesce(a.activity_score, 0) AS INTEGER) AS activity_score
FROM properties p LEFT JOIN listings l ON l.property_id = p.id AND l.status = 'active' LEFT JOIN a ON a.property_id = p.id
WHERE p.status = 'active' AND p.lon BETWEEN {geo.number(_BOX[0])} AND {geo.number(_BOX[2])} AND p.lat BETWEEN {geo.number(_BOX[1])} AND {geo.number(_BOX[3])}) """
_METRES = geo.metres_sql(*(str(x) for x in PLACE), "lon", "lat")
_SIZE = geo.cell_size(9)
_TX, _TY = geo.on_tile_sql("lon", "lat", _BOX)
_CX, _CY = geo.on_tile_sql("avg(lon)", "avg(lat)", _BOX)
_TILE_SIZE = geo.cell_size(ZOOM)

QUERIES = {f.__name__: f for f in (map_nearby, map_tap, tile_clusters, cluster_previews, tile_points, tile_bytes)}
ORACLE = {
    "map_nearby": with_domain(_ACTIVE_SQL + f"SELECT id, city, woz_value, has_listing, activity_score, {geo.rounded_sql(_METRES, 3)} AS distance_m, lon, lat FROM q WHERE sqrt(pow(lon - 5.0, 2) + pow(lat - 52.0, 2)) <= {geo.number(geo.tap_radius(8))} ORDER BY {_METRES}, id LIMIT 20", *_NEED),
    "map_tap": with_domain(
        _ACTIVE_SQL + f"SELECT CAST(count(*) AS INTEGER) AS point_count, string_agg(CAST(id AS VARCHAR), ',' ORDER BY {_METRES}, id) AS property_ids, {geo.rounded_sql('avg(lon)', 6)} AS centre_lon, {geo.rounded_sql('avg(lat)', 6)} AS centre_lat, {geo.rounded_sql(f'min({_METRES})', 3)} AS distance_m FROM q "
        f"WHERE (has_listing OR activity_score > 0) AND {geo.snapped_sql('lon', _SIZE)} = {geo.snapped_sql('5.0', _SIZE)} AND {geo.snapped_sql('lat', _SIZE)} = {geo.snapped_sql('52.0', _SIZE)} AND sqrt(pow(lon - 5.0, 2) + pow(lat - 52.0, 2)) <= {geo.number(1.5 * _SIZE)} HAVING count(*) > 0", *_NEED),
    "tile_clusters": with_domain(
        _BY_LISTING_SQL + f"SELECT {geo.snapped_sql('lon', _TILE_SIZE)} AS cell_x, {geo.snapped_sql('lat', _TILE_SIZE)} AS cell_y, CAST(count(*) AS INTEGER) AS point_count, bool_or(has_listing) AS has_active_children, CAST(sum(activity_score) AS INTEGER) AS total_activity, max(activity_score) AS max_activity, "
        f"string_agg(CAST(id AS VARCHAR), ',' ORDER BY activity_score DESC, id) AS property_ids, {_CX} AS tile_x, {_CY} AS tile_y FROM q WHERE has_listing OR activity_score > 0 GROUP BY 1, 2", *_NEED),
    "cluster_previews": with_domain(
        _BY_LISTING_SQL + f", c AS (SELECT {geo.snapped_sql('lon', _TILE_SIZE)} AS cell_x, {geo.snapped_sql('lat', _TILE_SIZE)} AS cell_y, * FROM q WHERE has_listing OR activity_score > 0) SELECT cell_x, cell_y, CAST(row_number() OVER (PARTITION BY cell_x, cell_y ORDER BY activity_score DESC, id) AS INTEGER) AS place, "
        f"id, {address.ADDRESS_SQL.split(" || ', '")[0].replace('p.', '')} AS address, city, woz_value, has_listing, activity_score FROM c QUALIFY place <= 50", *_NEED),
    "tile_points": with_domain(
        _BY_LISTING_SQL + f"SELECT id, {address.ADDRESS_SQL.split(" || ', '")[0].replace('p.', '')} AS address, city, postal_code, woz_value, area, built, has_listing, activity_score, NOT has_listing AND activity_score = 0 AS is_ghost, {_TX} AS tile_x, {_TY} AS tile_y FROM q", *_NEED),
}
