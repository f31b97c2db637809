"""Files that rows come in and go out by: register extracts as CSV, batches of listings as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a register extract, all text until they are made clean, in the file's order.
STAGING = "geom string, identification string, area string, built string, status string, street string, house_number string, letter string, suffix string, postal_code string, city string"

#: A request's body of listings. House numbers may be numbers or text; numbers are read as their text.
BODY = (
    "listings array<struct<sourceUrl: string, sourceName: string, mirrorListingId: string, askingPrice: bigint, priceType: string, livingAreaM2: double, numRooms: int, energyLabel: string, thumbnailUrl: string, ogTitle: string, status: string, "
    "mirrorFirstSeenAt: string, mirrorLastChangedAt: string, mirrorLastSeenAt: string, address: struct<postalCode: string, houseNumber: string, houseNumberAddition: string, city: string, latitude: double, longitude: double>, "
    "priceHistory: array<struct<price: bigint, priceDate: string, eventType: string>>>>"
)
#: Values that a listing may have (fixed values).
SOURCES, PRICE_TYPES, STATES = ("funda", "pararius"), ("sale", "rent"), ("active", "sold", "rented", "withdrawn")


def staged(spark: SparkSession, path: str) -> DataFrame:
    """Register extracts with a header line, as text; empty fields are empty texts, not nulls."""
    return spark.read.schema(STAGING).option("header", True).option("escape", '"').option("multiLine", True).csv(path).na.fill("")


def write_staged(rows: DataFrame, path: str) -> None:
    """Writes rows as register extracts, one file for each partition."""
    names = [x.split()[0] for x in STAGING.split(", ")]
    rows.select(*names).write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def parsed(body: Column) -> Column:
    """The body as a structure; null for what is no JSON, has no list of listings, or has a listing that lacks a required field or has a value that is not allowed: then no listing of the body counts."""
    read = F.from_json(body, BODY, {"mode": "PERMISSIVE"})
    good = F.forall(
        read["listings"],
        lambda x: F.coalesce(
            x["sourceUrl"].isNotNull() & x["mirrorListingId"].isNotNull() & x["sourceName"].isin(*SOURCES) & x["priceType"].isin(*PRICE_TYPES) & (x["status"].isNull() | x["status"].isin(*STATES)) & x["address"]["postalCode"].isNotNull() & x["address"]["houseNumber"].isNotNull()
            & F.coalesce(F.forall(x["priceHistory"], lambda e: e["price"].isNotNull() & e["priceDate"].isNotNull() & e["eventType"].isNotNull()), F.lit(True)),
            F.lit(False),
        ),
    )
    return F.when(F.coalesce(good, F.lit(False)), read)


def listings_of(bodies: DataFrame, key: str, body: str) -> DataFrame:
    """(key, place from 0, then a column for each field of a listing) of all listings of the bodies that count. A status not given is 'active'."""
    rows = bodies.select(key, F.posexplode(parsed(F.col(body))["listings"]).alias("place", "x"))
    return rows.select(
        key, "place", F.col("x.sourceUrl").alias("source_url"), F.col("x.sourceName").alias("source_name"), F.col("x.mirrorListingId").alias("mirror_id"), F.col("x.askingPrice").alias("asking_price"), F.col("x.priceType").alias("price_type"),
        F.coalesce("x.status", F.lit("active")).alias("status"), F.col("x.address.postalCode").alias("postal_code"), F.col("x.address.houseNumber").alias("house_number"), F.col("x.address.houseNumberAddition").alias("house_number_addition"),
        F.col("x.address.city").alias("city"), F.col("x.address.longitude").alias("lon"), F.col("x.address.latitude").alias("lat"), F.col("x.livingAreaM2").alias("area"), F.col("x.numRooms").alias("rooms"), F.col("x.energyLabel").alias("energy_label"),
        F.col("x.thumbnailUrl").alias("thumbnail_url"), F.col("x.ogTitle").alias("og_title"), F.col("x.mirrorFirstSeenAt").alias("first_seen_at"), F.col("x.mirrorLastChangedAt").alias("last_changed_at"), F.col("x.mirrorLastSeenAt").alias("last_seen_at"), F.col("x.priceHistory").alias("price_history"),
    )


def price_history_of(listings: DataFrame, *keys: str) -> DataFrame:
    """(keys, price, price_date, event_type): a row for each event of each listing."""
    return listings.select(*keys, F.inline("price_history")).withColumnsRenamed({"priceDate": "price_date", "eventType": "event_type"})


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): each file whole, as one body."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))
