"""Loading listing mirrors: each row's property by canonical address, by raw address, or by position, and what becomes a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import address, texts
from gevel.operators.spatial import nearest_within
from gevel.sources.domain import Tables, with_domain

#: Half the side of the square around a row's position in which its property may lie, in degrees.
TOLERANCE = 0.001


def lookup_key(code: Column, number: Column, extra: Column) -> Column:
    """Postal code, number and addition in capitals, with bars between."""
    return F.concat_ws("|", F.upper(F.regexp_replace(code, r"\s", "")), number.cast("string"), F.upper(F.coalesce(extra, F.lit(""))))


def listing_status(x: Column) -> Column:
    """A mirror's status as a listing's; unknown ones count as active."""
    low = F.lower(x)
    return F.when(low.isin("sold", "rented", "withdrawn"), low).otherwise("active")


def located(t: Tables) -> DataFrame:
    """Mirror rows with how they were found (canonical, raw, position, none) and their property. Rows of one address share one look-up by position."""
    number, split = address.house_number(F.col("house_number")), address.house_suffix(F.col("house_number"))
    # An addition of its own goes before one that the number carries.
    canonical = F.when(address.postal_code(F.col("postal_code")).isNotNull() & number.isNotNull(), lookup_key(F.col("postal_code"), number, F.coalesce(address.addition(F.col("house_number_addition")), split)))
    raw = F.when(number.isNotNull(), lookup_key(F.col("postal_code"), number, F.col("house_number_addition")))
    rows = t.mirror_rows.withColumn("canonical", canonical).withColumn("raw", raw)
    known = t.properties.where("postal_code is not null").select(lookup_key(F.col("postal_code"), F.col("house_number"), F.col("house_number_addition")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("found"))
    rows = rows.join(known.select(F.col("key").alias("canonical"), F.col("found").alias("by_canonical")), "canonical", "left")
    rows = rows.join(known.select(F.col("key").alias("raw"), F.col("found").alias("by_raw")), "raw", "left")
    open_rows = rows.where("by_canonical is null and by_raw is null and raw is not null and lon is not null and lat is not null")
    probes = open_rows.groupBy("raw").agg(F.min_by(F.struct("lon", "lat"), "id").alias("p")).select("raw", "p.lon", "p.lat")
    near = nearest_within(probes, "raw", t.properties, "id", TOLERANCE, square=True).select("raw", F.col("id").alias("by_position"))
    rows = rows.join(near, "raw", "left")
    how = F.when(F.col("by_canonical").isNotNull(), "canonical").when(F.col("by_raw").isNotNull(), "raw").when(F.col("by_position").isNotNull(), "position").otherwise("none")
    return rows.withColumn("how", how).withColumn("property_id", F.coalesce("by_canonical", "by_raw", "by_position"))


def mirror_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(Tables(spark, sf_dir)).select("id", "canonical", "raw", "how", "property_id")


def mirror_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings that mirror rows with a property make: price in euros, title, first photo, status."""
    rows = located(Tables(spark, sf_dir)).where("how <> 'none'")
    photo = F.nullif(F.try_element_at(F.split("photo_urls", ","), F.lit(1)), F.lit(""))
    title = texts.listing_title(F.col("price_type"), F.col("street"), F.col("house_number"), F.nullif(F.col("house_number_addition"), F.lit("")), F.col("city"))
    return rows.select("id", "property_id", texts.euros(F.col("asking_price_cents")).alias("asking_price"), title.alias("og_title"), photo.alias("thumbnail_url"), listing_status(F.col("status")).alias("status"), F.coalesce("price_type", F.lit("sale")).alias("price_type"))


def register_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third block of 50 properties by id, as a walk through the table takes them; in one scan, as the ids are at hand."""
    return Tables(spark, sf_dir).properties.orderBy("id").offset(100).limit(50).select("id", "register_id", "city")


_NUMBER = r"TRY_CAST(regexp_extract(trim(house_number), '^(\d+)', 1) AS INTEGER)"
_CODE = r"upper(regexp_replace(postal_code, '\s', '', 'g'))"
_FOUND = rf"""WITH k AS (SELECT upper(regexp_replace(postal_code, '\s', '', 'g')) || '|' || house_number || '|' || upper(coalesce(house_number_addition, '')) AS key, min(id) AS found FROM properties WHERE postal_code IS NOT NULL GROUP BY 1),
s AS (SELECT *, {_NUMBER} AS number, CASE WHEN regexp_matches({_CODE}, '^\d{{4}}[A-Z]{{2}}$') AND {_NUMBER} IS NOT NULL THEN {_CODE} || '|' || {_NUMBER} || '|' || coalesce(nullif(upper(trim(house_number_addition)), ''), nullif(upper(trim(regexp_extract(trim(house_number), '^(\d+)\s*[-/]?\s*(.*)$', 2))), ''), '') END AS canonical,
CASE WHEN {_NUMBER} IS NOT NULL THEN {_CODE} || '|' || {_NUMBER} || '|' || upper(coalesce(house_number_addition, '')) END AS raw FROM mirror_rows),
j AS (SELECT s.*, c.found AS by_canonical, r.found AS by_raw FROM s LEFT JOIN k c ON c.key = s.canonical LEFT JOIN k r ON r.key = s.raw),
b AS (SELECT raw, arg_min(lon, id) AS lon, arg_min(lat, id) AS lat FROM j WHERE by_canonical IS NULL AND by_raw IS NULL AND raw IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY raw),
n AS (SELECT raw, id AS by_position FROM (SELECT b.raw, p.id, row_number() OVER (PARTITION BY b.raw ORDER BY sqrt(pow(p.lon - b.lon, 2) + pow(p.lat - b.lat, 2)), p.id) AS k FROM b JOIN properties p ON abs(p.lon - b.lon) <= 0.001 AND abs(p.lat - b.lat) <= 0.001) WHERE k = 1),
m AS (SELECT j.*, CASE WHEN by_canonical IS NOT NULL THEN 'canonical' WHEN by_raw IS NOT NULL THEN 'raw' WHEN by_position IS NOT NULL THEN 'position' ELSE 'none' END AS how, coalesce(by_canonical, by_raw, by_position) AS property_id FROM j LEFT JOIN n USING (raw)) """

QUERIES = {f.__name__: f for f in (mirror_matches, mirror_listings, register_keyset)}
ORACLE = {
    "mirror_matches": with_domain(_FOUND + "SELECT id, canonical, raw, how, property_id FROM m", "properties", "mirror_rows"),
    "mirror_listings": with_domain(
        _FOUND + "SELECT id, property_id, CAST(floor(TRY_CAST(asking_price_cents AS DOUBLE) / 100 + 0.5) AS BIGINT) AS asking_price, CASE WHEN price_type = 'rent' THEN 'Te huur' ELSE 'Te koop' END || ': ' || street || ' ' || house_number || coalesce(house_number_addition, '') || ', ' || city AS og_title, "
        "nullif(string_split(photo_urls, ',')[1], '') AS thumbnail_url, CASE WHEN lower(status) IN ('sold', 'rented', 'withdrawn') THEN lower(status) ELSE 'active' END AS status, coalesce(price_type, 'sale') AS price_type FROM m WHERE how <> 'none'", "properties", "mirror_rows"),
    "register_keyset": with_domain("SELECT id, register_id, city FROM properties ORDER BY id LIMIT 50 OFFSET 100", "properties"),
}
