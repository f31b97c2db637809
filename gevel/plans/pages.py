"""Pages of lists, in order, with what the whole list holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import scoring
from gevel.functions.scoring import iso
from gevel.operators.rollups import LATEST_SQL, counted_page, latest_active_listing, now
from gevel.plans.properties import listed
from gevel.plans.social import shown_name
from gevel.plans.valuation import VALUES_SQL, values
from gevel.sources.domain import AS_OF, Tables, with_domain

PROPERTY, USER = 0, 5
_META = ("total", "total_pages", "has_more")


def property_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a city's properties."""
    rows = counted_page(listed(Tables(spark, sf_dir), city="PROMO"), F.asc("created_at"), F.asc("id"), number=2, size=10)
    return rows.select("place", "id", "street", "house_number", "postal_code", "woz_value", *_META)


def saved_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first page of saved properties, newest first, with their asking prices."""
    t = Tables(spark, sf_dir)
    saved = t.saved_properties.where(F.col("user_id") == USER).select(F.col("id").alias("save_id"), "property_id", "created_at")
    rows = saved.join(t.properties.select(F.col("id").alias("property_id"), "street", "city"), "property_id").join(latest_active_listing(t), "property_id", "left")
    return counted_page(rows, F.desc("created_at"), F.asc("save_id"), size=3).select("place", "save_id", "property_id", "street", "city", "asking_price", iso(F.col("created_at")).alias("saved_at"), *_META)


def _likes(t: Tables) -> DataFrame:
    return t.reactions.where("target_type = 'comment' and reaction_type = 'like'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("int").alias("likes"))


def comment_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property's first page of top-level comments by popularity: author, likes, score, text, and how many replies each has. The replies of just these come from comment_replies."""
    t = Tables(spark, sf_dir)
    users = t.users.select(F.col("id").alias("user_id"), "username")
    rows = t.comments.where((F.col("property_id") == PROPERTY) & F.col("parent_id").isNull()).join(users, "user_id").join(_likes(t), "id", "left").withColumn("likes", F.coalesce("likes", F.lit(0)))
    rows = rows.withColumn("score", (F.col("likes") * 2 + scoring.recency_bonus(F.col("created_at"), now())).cast("int"))
    replies = t.comments.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").cast("int").alias("replies"))
    some = counted_page(rows, F.desc("score"), F.desc("created_at"), F.asc("id"), size=2)
    return some.join(replies, "id", "left").select("place", "id", "username", "likes", "score", F.coalesce("replies", F.lit(0)).alias("replies"), "content", *_META).orderBy("place")


def comment_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The replies to the comments of comment_page, oldest first in each."""
    t = Tables(spark, sf_dir)
    parents = comment_page(spark, sf_dir).select(F.col("id").alias("parent_id"), F.col("place").alias("parent_place"))
    users = t.users.select(F.col("id").alias("user_id"), shown_name().alias("name"))
    rows = t.comments.where("parent_id is not null").join(parents, "parent_id").join(users, "user_id").join(_likes(t), "id", "left")
    return rows.select("parent_place", "parent_id", "id", "name", F.coalesce("likes", F.lit(0)).alias("likes"), "content", iso(F.col("created_at")).alias("created_at")).orderBy("parent_place", "created_at", "id")


def guess_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A property's first page of guesses, oldest first, with their users' ranks, its fair value and how sure that is."""
    t = Tables(spark, sf_dir)
    users = t.users.select(F.col("id").alias("user_id"), shown_name().alias("name"), scoring.rank(F.greatest(F.lit(0), "karma")).alias("rank"))
    rows = t.price_guesses.where(F.col("property_id") == PROPERTY).join(users, "user_id")
    some = counted_page(rows, F.asc("created_at"), F.asc("id"), size=5)
    fair = values(t).select("property_id", "fmv", "confidence")
    return some.join(fair, "property_id", "left").select("place", "id", "name", "rank", "guessed_price", "is_meme_guess", iso(F.col("created_at")).alias("created_at"), "fmv", "confidence", *_META).orderBy("place")


def _page_sql(body: str, order: str, columns: str, number: int, size: int) -> str:
    meta = f"CAST(count(*) OVER () AS BIGINT) AS total, CAST(ceil(count(*) OVER () / {size}) AS INTEGER) AS total_pages, {number * size} < count(*) OVER () AS has_more"
    return f"SELECT {columns}, CAST(row_number() OVER (ORDER BY {order}) - {(number - 1) * size} AS INTEGER) AS place, {meta} FROM ({body}) ORDER BY {order} LIMIT {size} OFFSET {(number - 1) * size}"


_ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')"
_LIKES = "(SELECT count(*) FROM reactions r WHERE r.target_type = 'comment' AND r.reaction_type = 'like' AND r.target_id = c.id)"
_BONUS = f"CASE WHEN c.created_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 10 WHEN c.created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 5 WHEN c.created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 2 ELSE 0 END"
_NAME = "CASE WHEN coalesce(u.display_name, '') = '' THEN u.username ELSE u.display_name END"
_COMMENTS = _page_sql(
    f"SELECT c.*, u.username, CAST({_LIKES} AS INTEGER) AS likes, CAST({_LIKES} * 2 + {_BONUS} AS INTEGER) AS score, CAST((SELECT count(*) FROM comments x WHERE x.parent_id = c.id) AS INTEGER) AS replies FROM comments c JOIN users u ON u.id = c.user_id WHERE c.property_id = {PROPERTY} AND c.parent_id IS NULL",
    "score DESC, created_at DESC, id", "id, username, likes, score, replies, content", 1, 2)

QUERIES = {f.__name__: f for f in (property_page, saved_page, comment_page, comment_replies, guess_page)}
ORACLE = {
    "property_page": with_domain(_page_sql("SELECT * FROM properties WHERE city = 'PROMO'", "created_at, id", "id, street, house_number, postal_code, woz_value", 2, 10), "properties"),
    "saved_page": with_domain(f"WITH l AS ({LATEST_SQL}) " + _page_sql(f"SELECT s.id AS save_id, s.property_id, p.street, p.city, l.asking_price, s.created_at FROM saved_properties s JOIN properties p ON p.id = s.property_id LEFT JOIN l ON l.property_id = p.id WHERE s.user_id = {USER}", "created_at DESC, save_id", f"save_id, property_id, street, city, asking_price, {_ISO} AS saved_at", 1, 3), "properties", "listings", "saved_properties"),
    "comment_page": with_domain(_COMMENTS, "comments", "users", "reactions"),
    "comment_replies": with_domain(f"WITH t AS ({_COMMENTS}) SELECT t.place AS parent_place, c.parent_id, c.id, {_NAME} AS name, CAST({_LIKES} AS INTEGER) AS likes, c.content, strftime(c.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM comments c JOIN t ON t.id = c.parent_id JOIN users u ON u.id = c.user_id", "comments", "users", "reactions"),
    "guess_page": with_domain(_page_sql(f"SELECT g.*, {_NAME} AS name, {scoring.RANK_SQL.format(k='u.karma')} AS rank, f.fmv, f.confidence FROM price_guesses g JOIN users u ON u.id = g.user_id LEFT JOIN ({VALUES_SQL}) f ON f.property_id = g.property_id WHERE g.property_id = {PROPERTY}", "created_at, id", f"id, name, rank, guessed_price, is_meme_guess, {_ISO} AS created_at, fmv, confidence", 1, 5), "properties", "users", "listings", "price_guesses"),
}
