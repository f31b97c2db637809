"""What comes in as text: batches of listings in JSON, points of a register extract; and a sample to look at."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.operators.kept import files_path
from gevel.sources import files
from gevel.sources.domain import Tables, with_domain
from gevel.sources.geometry import wkt_point


#: What the sample is drawn by.
SEED = 7


def bodies(t: Tables) -> DataFrame:
    """(batch, body): the incoming listings of ten row numbers each as one request's body."""
    number, far = F.col("row_id") % 3 == 0, F.col("row_id") % 4 == 0
    event = F.struct(F.col("asking_price").alias("price"), F.lit("2024-02-01").alias("priceDate"), F.lit("asking").alias("eventType"))
    earlier = F.struct((F.col("asking_price") + 500).alias("price"), F.lit("2024-01-01").alias("priceDate"), F.lit("listed").alias("eventType"))
    listing = F.struct(
        F.col("source_url").alias("sourceUrl"), F.col("source_name").alias("sourceName"), F.col("mirror_id").alias("mirrorListingId"), F.col("asking_price").alias("askingPrice"), F.when(far, "rent").otherwise("sale").alias("priceType"), F.when(far, "rented").alias("status"),
        F.struct(F.col("postal_code").alias("postalCode"), F.col("house_number").alias("houseNumber"), F.when(number, "\"A\"\n").alias("houseNumberAddition"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("address"),
        F.when(number, F.array(event, earlier)).alias("priceHistory"),
    )
    rows = t.incoming.groupBy(F.floor(F.col("row_id") / 10).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("row_id", listing.alias("x")))).alias("rows"))
    return rows.select("batch", F.to_json(F.struct(F.transform("rows", lambda r: r["x"]).alias("listings"))).alias("body"))


def batch_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of all bodies that count; a body with a source that isn't allowed counts for nothing."""
    rows = files.listings_of(bodies(Tables(spark, sf_dir)), "batch", "body")
    return rows.select("batch", F.col("place").cast("int").alias("place"), "source_url", "source_name", "mirror_id", "asking_price", "price_type", "status", "postal_code", "house_number", "house_number_addition", "lon", "lat")


def batch_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings by way of files: bodies written as lines of text, read again."""
    path = files_path(spark, "bodies")
    bodies(Tables(spark, sf_dir)).select("body").write.option("compression", "gzip").text(path)
    rows = files.listings_of(spark.read.text(path).withColumn("one", F.lit(1)), "one", "value")
    return rows.select("source_url", "mirror_id", "asking_price", "status", "house_number", "house_number_addition", F.coalesce(F.size("price_history"), F.lit(0)).cast("int").alias("events"))


def batch_price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files.listings_of(bodies(Tables(spark, sf_dir)), "batch", "body")
    return files.price_history_of(rows, "batch", "mirror_id")


def register_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each row of the register is, from its point as text."""
    lon, lat = wkt_point(F.col("geom"))
    return Tables(spark, sf_dir).register_rows.select("identification", lon.alias("lon"), lat.alias("lat"))


def property_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five properties at random, by a seed: those of the least digests of seed and id."""
    t = Tables(spark, sf_dir)
    return t.properties.orderBy(F.md5(F.concat(F.lit(f"{SEED}-"), F.col("id").cast("string")))).limit(5).select("id", "street", "house_number", F.coalesce("house_number_addition", F.lit("")).alias("house_number_addition"), F.coalesce("postal_code", F.lit("N/A")).alias("postal_code"), "city")


_GOOD = "SELECT *, CAST(floor(row_id / 10) AS BIGINT) AS batch FROM incoming WHERE source_name <> 'other'"

QUERIES = {f.__name__: f for f in (batch_listings, batch_files, batch_price_history, register_places, property_sample)}
ORACLE = {
    "batch_listings": with_domain(
        f"SELECT batch, CAST(row_number() OVER (PARTITION BY batch ORDER BY row_id) - 1 AS INTEGER) AS place, source_url, source_name, mirror_id, asking_price, CASE WHEN row_id % 4 = 0 THEN 'rent' ELSE 'sale' END AS price_type, CASE WHEN row_id % 4 = 0 THEN 'rented' ELSE 'active' END AS status, "
        f"postal_code, house_number, CASE WHEN row_id % 3 = 0 THEN '\"A\"' || chr(10) END AS house_number_addition, lon, lat FROM ({_GOOD})", "incoming"),
    "batch_files": with_domain(f"SELECT source_url, mirror_id, asking_price, CASE WHEN row_id % 4 = 0 THEN 'rented' ELSE 'active' END AS status, house_number, CASE WHEN row_id % 3 = 0 THEN '\"A\"' || chr(10) END AS house_number_addition, CASE WHEN row_id % 3 = 0 THEN 2 ELSE 0 END AS events FROM ({_GOOD})", "incoming"),
    "batch_price_history": with_domain(
        f"SELECT batch, mirror_id, asking_price AS price, '2024-02-01' AS price_date, 'asking' AS event_type FROM ({_GOOD}) WHERE row_id % 3 = 0 UNION ALL SELECT batch, mirror_id, asking_price + 500, '2024-01-01', 'listed' FROM ({_GOOD}) WHERE row_id % 3 = 0", "incoming"),
    "property_sample": with_domain(f"SELECT id, street, house_number, coalesce(house_number_addition, '') AS house_number_addition, coalesce(postal_code, 'N/A') AS postal_code, city FROM properties ORDER BY md5('{SEED}-' || id) LIMIT 5", "properties"),
    "register_places": with_domain(
        r"SELECT identification, TRY_CAST(regexp_extract(geom, '\(\s*(\S+)\s', 1) AS DOUBLE) AS lon, TRY_CAST(regexp_extract(geom, '\s(\S+)\s*\)', 1) AS DOUBLE) AS lat FROM register_rows", "register_rows"),
}
