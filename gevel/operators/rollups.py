"""Building blocks that several queries share: one row for each property or user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gevel.sources.domain import AS_OF, Tables


def now() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def recent(ts: Column, days: int = 7) -> Column:
    return ts > now() - F.expr(f"INTERVAL {days} DAYS")


def latest_active_listing(t: Tables) -> DataFrame:
    """(property_id, listing_id, asking_price, listed_at): each property's newest active listing, of equal ones the smallest id; by one aggregation, without a sort."""
    newest = F.max_by(F.struct("id", "asking_price", "created_at"), F.struct("created_at", (-F.col("id")).alias("order")))
    rows = t.listings.where("status = 'active'").groupBy("property_id").agg(newest.alias("l"))
    return rows.select("property_id", F.col("l.id").alias("listing_id"), F.col("l.asking_price").alias("asking_price"), F.col("l.created_at").alias("listed_at"))


LATEST_SQL = "SELECT property_id, id AS listing_id, asking_price, created_at AS listed_at FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC, id) AS k FROM listings WHERE status = 'active') WHERE k = 1"


def activity(t: Tables) -> DataFrame:
    """(property_id, activity_score): comments and guesses of all time."""
    both = t.comments.select("property_id").unionByName(t.price_guesses.select("property_id"))
    return both.groupBy("property_id").agg(F.count("*").alias("activity_score"))


ACTIVITY_SQL = "SELECT property_id, count(*) AS activity_score FROM (SELECT property_id FROM comments UNION ALL SELECT property_id FROM price_guesses) GROUP BY property_id"


def viewer(user_id: str = "user_id", session_id: str = "session_id", ident: str = "id") -> Column:
    """Who viewed: the user, else the session, else nobody known, who counts as one each time."""
    return F.coalesce(F.col(user_id).cast("string"), F.col(session_id), F.col(ident).cast("string"))


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in an order, which must be total to be repeatable."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def page(df: DataFrame, *order: Column, number: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered result; sorted without a full shuffle where it is near the front."""
    if number < 1 or not 1 <= size <= 100:
        raise ValueError(f"page {number} of size {size}: pages begin at 1 and hold 1 to 100 rows")
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def counted_page(df: DataFrame, *order: Column, number: int = 1, size: int = 20) -> DataFrame:
    """One page with the place of each row on it (place), and on each row what the whole result holds: total, total_pages, and has_more behind this page. The count is a scalar subquery, so no row meets another."""
    rows = page(df, *order, number=number, size=size)
    total = df.select(F.count("*")).scalar()
    rows = rows.withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("total", total)
    return rows.withColumn("total_pages", F.ceil(F.col("total") / size).cast("int")).withColumn("has_more", F.lit(number * size) < F.col("total"))
