"""What cards say of a price, and addresses as they come in with what is wrong with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import address
from gevel.plans.valuation import VALUES_SQL, values
from gevel.sources.domain import Tables, with_domain

#: Percent of the market value within which an asking price is called fair.
FAIR = 3


def price_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each property with a market value: by how many percent of it the asking price is above it (tenths, halves up), and what its card says. Without an asking price it says nothing."""
    rows = values(Tables(spark, sf_dir)).where("fmv > 0").select("property_id", "fmv", "asking_price")
    off = (F.nullif("asking_price", F.lit(0)) - F.col("fmv")) / F.col("fmv") * F.lit(100)
    rows = rows.withColumn("off", off).withColumn("tenths", F.floor(F.abs("off") * 10 + 0.5).cast("long"))
    shown = F.concat(F.expr("tenths div 10").cast("string"), F.lit("."), (F.col("tenths") % 10).cast("string"))
    above, below = F.concat(F.lit("Asking "), shown, F.lit("% above FMV")), F.concat(F.lit("Asking "), shown, F.lit("% below FMV"))
    said = F.when(F.col("off") > FAIR, above).when(F.col("off") < -FAIR, below).when(F.col("off").isNotNull(), "~Fair price")
    return rows.select("property_id", "fmv", "asking_price", (F.when(F.col("off") < 0, -F.col("tenths")).otherwise(F.col("tenths")) / F.lit(10.0)).alias("percent"), said.alias("label"))


def address_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All addresses as they come in, made canonical: status ok, null (no postal code, or a malformed one) or error (a house number that isn't one, and why)."""
    rows = Tables(spark, sf_dir).raw_addresses
    found = address.canonical(*(F.col(c) for c in ("street", "house_number", "house_number_addition", "postal_code", "city")))
    return rows.select("id", found.alias("found")).select("id", "found.*")


QUERIES = {f.__name__: f for f in (price_cards, address_checks)}
ORACLE = {
    "price_cards": with_domain(
        f"WITH v AS ({VALUES_SQL}), x AS (SELECT property_id, fmv, asking_price, CAST(nullif(asking_price, 0) - fmv AS DOUBLE) / fmv * 100 AS off FROM v WHERE fmv > 0), "
        "y AS (SELECT *, CAST(floor(abs(off) * 10 + 0.5) AS BIGINT) AS tenths FROM x) SELECT property_id, fmv, asking_price, CASE WHEN off < 0 THEN -tenths ELSE tenths END / CAST(10 AS DOUBLE) AS percent, "
        f"CASE WHEN off > {FAIR} THEN 'Asking ' || (tenths // 10) || '.' || (tenths % 10) || '% above FMV' WHEN off < -{FAIR} THEN 'Asking ' || (tenths // 10) || '.' || (tenths % 10) || '% below FMV' WHEN off IS NOT NULL THEN '~Fair price' END AS label FROM y",
        "properties",
        "users",
        "listings",
        "price_guesses",
    ),
    "address_checks": with_domain(
        r"WITH x AS (SELECT id, street, city, house_number_addition AS extra, upper(regexp_replace(postal_code, '\s', '', 'g')) AS code, regexp_replace(coalesce(house_number, ''), '^\s+|\s+$', '', 'g') AS n FROM raw_addresses), "
        r"y AS (SELECT *, CASE WHEN NOT coalesce(regexp_full_match(code, '[0-9]{4}[A-Z]{2}'), false) THEN 'null' WHEN NOT regexp_matches(n, '^[0-9]') THEN 'error' ELSE 'ok' END AS status FROM x) "
        r"""SELECT id, status, CASE WHEN status = 'error' THEN CASE n WHEN '' THEN 'Invalid house number: received empty string' ELSE 'Invalid house number: "' || n || '" does not start with a digit' END END AS error, """
        r"CASE WHEN status = 'ok' THEN trim(regexp_replace(coalesce(street, ''), '\s+', ' ', 'g')) END AS street, CASE WHEN status = 'ok' THEN TRY_CAST(regexp_extract(n, '^[0-9]+') AS INTEGER) END AS house_number, "
        r"CASE WHEN status = 'ok' THEN coalesce(nullif(upper(trim(extra)), ''), nullif(upper(regexp_replace(n, '^[0-9]+\s*[-/]?\s*', '')), '')) END AS house_number_addition, "
        r"CASE WHEN status = 'ok' THEN code END AS postal_code, CASE WHEN status = 'ok' THEN trim(regexp_replace(coalesce(city, ''), '\s+', ' ', 'g')) END AS city FROM y",
        "raw_addresses",
    ),
}
