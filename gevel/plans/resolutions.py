"""What sales decide about guesses, and where interest is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gevel.functions import scoring
from gevel.functions.geo import tile_of
from gevel.functions.scoring import iso
from gevel.operators.rollups import recent
from gevel.sources.domain import AS_OF, Tables, with_domain

#: The finest and the coarsest zoom of the heat map.
FINE, COARSE = 12, 0


def guess_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each guess with the first sale of its property on a later day (of one day's sales the smallest id, of these the lowest price): what it was off by, the points, and whether it is resolved.

    Guesses and sales are put together by property and time, and each guess takes the last sale seen on the way back, so no pairs are made and no frame is gone through twice.
    """
    t = Tables(spark, sf_dir)
    day = F.unix_date(F.to_date("created_at"))
    guesses = t.price_guesses.select("property_id", day.alias("day"), F.lit(0).alias("kind"), "id", "user_id", "guessed_price", "is_meme_guess", F.lit(None).cast("struct<id:bigint,price:bigint,day:int>").alias("sale"))
    sold = t.price_history.where("event_type = 'sold'").withColumn("day", F.unix_date("price_date"))
    sales = sold.select("property_id", "day", F.lit(1).alias("kind"), "id", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("long").alias("guessed_price"), F.lit(None).cast("boolean").alias("is_meme_guess"), F.struct("id", "price", "day").alias("sale"))
    # Backwards in time; on one day guesses come before sales, and sales by falling id and price.
    back = Window.partitionBy("property_id").orderBy(F.desc("day"), F.asc("kind"), F.desc("id"), F.desc("sale.price")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = guesses.unionByName(sales).withColumn("sale", F.last("sale", ignorenulls=True).over(back)).where("kind = 0")
    price = F.col("sale.price")
    off = F.when(price > 0, F.abs(F.col("guessed_price") - price) / price).otherwise(1.0)
    points = F.when(F.col("sale").isNull() | F.col("is_meme_guess"), 0).when(price > 0, scoring.accuracy_points(off)).otherwise(0)
    return rows.select("id", "property_id", "user_id", F.col("sale.id").alias("sale_id"), price.alias("sold_price"), (F.col("sale.day") - F.col("day")).alias("days"), scoring.guess_outcome(F.col("guessed_price"), price).alias("outcome"), points.cast("int").alias("points"))


def heat_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interest by tile at all zooms: views, guesses and comments of all time, of the last week and of the week before, and where that leads: rising, fading or steady.

    Facts are counted by property, then by tile of the finest zoom; each coarser zoom is the sum of four tiles of the one below, so rows are read once whatever the number of zooms.
    """
    t = Tables(spark, sf_dir)
    facts = t.property_views.select("property_id", F.col("viewed_at").alias("at")).unionByName(t.price_guesses.select("property_id", F.col("created_at").alias("at"))).unionByName(t.comments.select("property_id", F.col("created_at").alias("at")))
    new, old = recent(F.col("at")), recent(F.col("at"), 14)
    by_property = facts.groupBy("property_id").agg(F.count("*").alias("total"), F.count_if(new).alias("week"), F.count_if(old & ~new).alias("before"))
    x, y = tile_of(F.col("lon"), F.col("lat"), FINE)
    placed = t.properties.where("lon is not null and lat is not null").select(F.col("id").alias("property_id"), x.alias("x"), y.alias("y"))
    sums = [F.sum(c).alias(c) for c in ("total", "week", "before")]
    level = by_property.join(placed, "property_id").groupBy("x", "y").agg(*sums)
    out = level.withColumn("zoom", F.lit(FINE))
    for zoom in range(FINE - 1, COARSE - 1, -1):
        level = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(*sums)
        out = out.unionByName(level.withColumn("zoom", F.lit(zoom)))
    trend = F.when(F.col("week") > F.col("before"), "rising").when(F.col("week") < F.col("before"), "fading").otherwise("steady")
    return out.select("zoom", "x", "y", "total", "week", "before", trend.alias("trend"))


_RANK = "CASE WHEN is_meme_guess OR s.id IS NULL OR s.price <= 0 THEN 0 WHEN off <= 0.05 THEN 10 WHEN off <= 0.10 THEN 5 WHEN off <= 0.20 THEN 2 WHEN off <= 0.50 THEN 0 ELSE -3 END"
_LEVELS = " UNION ALL ".join(f"SELECT {z} AS zoom, CAST(floor((lon + 180) / 360 * {2**z}) AS INTEGER) AS x, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * {2**z}) AS INTEGER) AS y, seen FROM f" for z in range(COARSE, FINE + 1))
_NEW, _OLD = (f"seen > TIMESTAMP '{AS_OF}' - INTERVAL {d} DAY" for d in (7, 14))
QUERIES = {f.__name__: f for f in (guess_resolutions, heat_map)}
ORACLE = {
    "guess_resolutions": with_domain(
        f"""SELECT g.id, g.property_id, g.user_id, s.id AS sale_id, s.price AS sold_price, CAST(s.d - CAST(g.created_at AS DATE) AS INTEGER) AS days,
CASE WHEN s.price IS NULL THEN 'pending' WHEN off <= 0.05 THEN 'accurate' WHEN off <= 0.20 THEN 'close' ELSE 'inaccurate' END AS outcome, CAST({_RANK} AS INTEGER) AS points
FROM (SELECT g.*, s, CAST(abs(g.guessed_price - s.price) AS DOUBLE) / s.price AS off FROM (SELECT g.*, (SELECT min(struct_pack(d := h.price_date, id := h.id, price := h.price)) FROM price_history h WHERE h.event_type = 'sold' AND h.property_id = g.property_id AND h.price_date > CAST(g.created_at AS DATE)) AS s FROM price_guesses g) g) g""", "price_guesses", "price_history"),
    "heat_map": with_domain(
        f"""WITH f AS (SELECT p.lon, p.lat, e.seen FROM (SELECT property_id, viewed_at AS seen FROM property_views UNION ALL SELECT property_id, created_at FROM price_guesses UNION ALL SELECT property_id, created_at FROM comments) e JOIN properties p ON p.id = e.property_id WHERE p.lon IS NOT NULL AND p.lat IS NOT NULL),
c AS (SELECT zoom, x, y, count(*) AS total, count(*) FILTER (WHERE {_NEW}) AS week, count(*) FILTER (WHERE {_OLD} AND NOT {_NEW}) AS before FROM ({_LEVELS}) GROUP BY zoom, x, y)
SELECT *, CASE WHEN week > before THEN 'rising' WHEN week < before THEN 'fading' ELSE 'steady' END AS trend FROM c""", "properties", "property_views", "price_guesses", "comments"),
}
