"""The feed of properties on offer, in four orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import address, geo, scoring
from gevel.functions.scoring import iso
from gevel.operators.rollups import LATEST_SQL, latest_active_listing, now, page, recent
from gevel.sources.domain import AS_OF, Tables, with_domain

RADIUS = 25_000


def _facts(t: Tables) -> DataFrame:
    """One row for each property with anything done to it: three facts in one union and one aggregation, so that each key is shuffled once."""
    comments = t.comments.select("property_id", "created_at", F.lit("c").alias("kind"), F.lit(None).cast("long").alias("price"))
    guesses = t.price_guesses.select("property_id", "created_at", F.lit("g").alias("kind"), F.col("guessed_price").alias("price"))
    likes = t.reactions.where("target_type = 'property' and reaction_type = 'like'").select(F.col("target_id").alias("property_id"), "created_at", F.lit("r").alias("kind"), F.lit(None).cast("long").alias("price"))
    views = t.property_views.select("property_id", F.lit(None).cast("timestamp").alias("created_at"), F.lit("v").alias("kind"), F.lit(None).cast("long").alias("price"))
    of = lambda k: F.count_if(F.col("kind") == k)
    week = lambda k: F.count_if((F.col("kind") == k) & recent(F.col("created_at")))
    return (
        comments.unionByName(guesses).unionByName(likes).unionByName(views).groupBy("property_id")
        .agg(
            of("c").alias("comments"), of("g").alias("guesses"), of("r").alias("likes"), of("v").alias("views"),
            F.max("created_at").alias("last"),
            F.when(of("g") >= 3, scoring.half_up(F.avg("price"))).alias("fmv"),
            F.stddev_samp("price").alias("spread"),
            (week("c") * 1.0 + week("g") * 2.0 + week("r") * 0.5).alias("score"),
        )
    )


def offered(t: Tables, lon: float | None = None, lat: float | None = None) -> DataFrame:
    """Active properties with a position and an active listing, with all that a feed shows; with lon and lat, those within 25 km."""
    p = t.properties.where("status = 'active' and lon is not null and lat is not null")
    if lon is not None and lat is not None:
        p = p.where(geo.near_box(F.col("lon"), F.col("lat"), lon, lat, RADIUS)).where(geo.metres(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat")) <= RADIUS)
    rows = p.join(latest_active_listing(t), F.col("id") == F.col("property_id")).drop("property_id").join(_facts(t), F.col("id") == F.col("property_id"), "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    score = F.coalesce("score", F.lit(0.0))
    last = F.coalesce("last", "listed_at")
    return rows.select(
        "id", address.address(F.col("street"), F.col("house_number"), F.col("house_number_addition"), F.col("postal_code"), F.col("city")).alias("address"),
        "city", "asking_price", "woz_value", count("comments").alias("comment_count"), count("guesses").alias("guess_count"), count("likes").alias("like_count"), count("views").alias("view_count"),
        "fmv", F.col("spread").alias("guess_stddev"), score.alias("trending_score"), last.alias("last_activity_at"), scoring.feed_level(score, last, now()).alias("activity_level"),
    )


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumn("last_activity_at", iso(F.col("last_activity_at"))).withColumn("guess_stddev", geo.rounded(F.col("guess_stddev"), 2))


def _filtered(t: Tables, kind: str, lon: float | None = None, lat: float | None = None) -> tuple[DataFrame, list[Column]]:
    """A feed's rows, and its order."""
    rows = offered(t, lon, lat)
    if kind == "recent":
        return rows, [F.desc("last_activity_at"), F.asc("id")]
    if kind == "controversial":
        return rows.where("guess_count >= 2"), [F.desc_nulls_last("guess_stddev"), F.asc("id")]
    if kind == "price-mismatch":
        return rows.where("asking_price is not null and fmv is not null"), [F.abs(F.col("asking_price") - F.col("fmv")).desc(), F.asc("id")]
    if kind != "trending":
        raise ValueError(f"no feed {kind!r}")
    return rows, [F.desc("trending_score"), F.desc("last_activity_at"), F.asc("id")]


def feed(t: Tables, kind: str, number: int = 1, size: int = 20, lon: float | None = None, lat: float | None = None) -> DataFrame:
    """A page of a feed: trending, recent, controversial or price-mismatch."""
    rows, order = _filtered(t, kind, lon, lat)
    return _shown(page(rows, *order, number=number, size=size))


def feed_trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(Tables(spark, sf_dir), "trending")


def feed_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(Tables(spark, sf_dir), "recent")


def feed_controversial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(Tables(spark, sf_dir), "controversial")


def feed_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(Tables(spark, sf_dir), "price-mismatch")


def feed_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feed(Tables(spark, sf_dir), "trending", size=100, lon=5.2, lat=52.1)


def feed_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every property on offer, unordered."""
    return _shown(offered(Tables(spark, sf_dir)))


def feed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each feed has, in one pass."""
    rows = offered(Tables(spark, sf_dir))
    whole = F.count("*").cast("int")
    return rows.agg(
        whole.alias("trending"), whole.alias("recent"), F.count_if(F.col("guess_count") >= 2).cast("int").alias("controversial"),
        F.count_if(F.col("asking_price").isNotNull() & F.col("fmv").isNotNull()).cast("int").alias("mismatch"),
    )


_NEED = ("properties", "listings", "comments", "price_guesses", "reactions", "property_views")
_ALL = f"""
WITH l AS ({LATEST_SQL}),
c AS (SELECT property_id, count(*) AS cnt, max(created_at) AS latest, count(*) FILTER (WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week FROM comments GROUP BY property_id),
g AS (SELECT property_id, count(*) AS cnt, max(created_at) AS latest, count(*) FILTER (WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week,
  CASE WHEN count(*) >= 3 THEN CAST(floor(avg(guessed_price) + 0.5) AS BIGINT) END AS fmv, stddev_samp(guessed_price) AS spread FROM price_guesses GROUP BY property_id),
r AS (SELECT target_id AS property_id, count(*) AS cnt, max(created_at) AS latest, count(*) FILTER (WHERE created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week FROM reactions WHERE target_type = 'property' GROUP BY target_id),
v AS (SELECT property_id, count(*) AS cnt FROM property_views GROUP BY property_id),
offered AS (SELECT p.id, {address.ADDRESS_SQL} AS address, p.city, l.asking_price, p.woz_value, p.lon, p.lat,
  CAST(coalesce(c.cnt, 0) AS INTEGER) AS comment_count, CAST(coalesce(g.cnt, 0) AS INTEGER) AS guess_count, CAST(coalesce(r.cnt, 0) AS INTEGER) AS like_count, CAST(coalesce(v.cnt, 0) AS INTEGER) AS view_count,
  g.fmv, g.spread, CAST(coalesce(c.week, 0) * 1.0 + coalesce(g.week, 0) * 2.0 + coalesce(r.week, 0) * 0.5 AS DOUBLE) AS trending_score,
  coalesce(greatest(c.latest, g.latest, r.latest), l.listed_at) AS last_at
  FROM l JOIN properties p ON p.id = l.property_id AND p.status = 'active' AND p.lon IS NOT NULL
  LEFT JOIN c ON c.property_id = p.id LEFT JOIN g ON g.property_id = p.id LEFT JOIN r ON r.property_id = p.id LEFT JOIN v ON v.property_id = p.id)
"""
_SHOWN = f"""SELECT id, address, city, asking_price, woz_value, comment_count, guess_count, like_count, view_count, fmv, {geo.rounded_sql("spread", 2)} AS guess_stddev, trending_score,
strftime(last_at, '%Y-%m-%dT%H:%M:%SZ') AS last_activity_at,
CASE WHEN trending_score >= 5 THEN 'hot' WHEN trending_score > 0 OR last_at >= TIMESTAMP '{AS_OF}' - INTERVAL 30 DAY THEN 'warm' ELSE 'cold' END AS activity_level FROM offered"""


def _sql(rest: str) -> str:
    return with_domain(_ALL.strip() + "\n" + rest, *_NEED)


QUERIES = {f.__name__: f for f in (feed_trending, feed_recent, feed_controversial, feed_mismatch, feed_near, feed_all, feed_counts)}
ORACLE = {
    "feed_trending": _sql(f"{_SHOWN} ORDER BY trending_score DESC, last_at DESC, id LIMIT 20"),
    "feed_recent": _sql(f"{_SHOWN} ORDER BY last_at DESC, id LIMIT 20"),
    "feed_controversial": _sql(f"{_SHOWN} WHERE guess_count >= 2 ORDER BY spread DESC NULLS LAST, id LIMIT 20"),
    "feed_mismatch": _sql(f"{_SHOWN} WHERE asking_price IS NOT NULL AND fmv IS NOT NULL ORDER BY abs(asking_price - fmv) DESC, id LIMIT 20"),
    "feed_near": _sql(f"{_SHOWN} WHERE {geo.metres_sql('5.2', '52.1', 'lon', 'lat')} <= {RADIUS} ORDER BY trending_score DESC, last_at DESC, id LIMIT 100"),
    "feed_all": _sql(_SHOWN),
    "feed_counts": _sql("SELECT CAST(count(*) AS INTEGER) AS trending, CAST(count(*) AS INTEGER) AS recent, CAST(count(*) FILTER (WHERE guess_count >= 2) AS INTEGER) AS controversial, CAST(count(*) FILTER (WHERE asking_price IS NOT NULL AND fmv IS NOT NULL) AS INTEGER) AS mismatch FROM offered"),
}
