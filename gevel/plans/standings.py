"""Guesses against the median of their property, comments in each of the orders that a reader can ask for, and users after their karma is written back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gevel.functions.scoring import half_up
from gevel.operators.merge import upserted
from gevel.plans.valuation import KARMA_SQL, karma
from gevel.sources.domain import Tables, with_domain

#: What a guess is told (fixed values): the share shown and the message, near the median and away from it.
NEAR, AWAY = (85, "Your guess aligns with most predictors!"), (35, "Your guess differs from the consensus - care to share why?")
#: Nearer than this share of the median.
WITHIN = 0.15


def guess_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each guess with the number, the median and the rounded mean of all guesses of its property (memes too), whether it is less than 15 % of the median away, and what its user is told. A median of 0 is near to nothing."""
    guesses = Tables(spark, sf_dir).price_guesses.select("id", "property_id", "guessed_price")
    of_all = guesses.groupBy("property_id").agg(F.count("*").cast("int").alias("guess_count"), F.median("guessed_price").alias("median"), half_up(F.avg("guessed_price")).alias("mean"))
    near = F.coalesce(F.abs((F.col("guessed_price") - F.col("median")) / F.nullif("median", F.lit(0))) < WITHIN, F.lit(False))
    rows = guesses.join(of_all, "property_id").withColumn("aligned", near)
    told = lambda k: F.when(F.col("aligned"), NEAR[k]).otherwise(AWAY[k])
    return rows.select("id", "property_id", "guess_count", "median", "mean", "aligned", told(0).alias("percent"), told(1).alias("message"))


def comment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of each top-level comment among those of its property: newest, oldest, most liked, and popular and recent (a like weighs as much as a million seconds); ties by id."""
    t = Tables(spark, sf_dir)
    likes = t.reactions.where("target_type = 'comment' and reaction_type = 'like'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("int").alias("likes"))
    rows = t.comments.where("parent_id is null").select("id", "property_id", "created_at").join(likes, "id", "left").withColumn("likes", F.coalesce("likes", F.lit(0)))
    rows = rows.withColumn("score", F.col("likes") * F.lit(1000.0) + F.unix_millis("created_at") / 1e6)
    orders = {"newest": F.desc("created_at"), "oldest": F.asc("created_at"), "most_liked": F.desc("likes"), "popular_recent": F.desc("score")}
    places = (F.row_number().over(Window.partitionBy("property_id").orderBy(by, F.asc("id"))).alias(name) for name, by in orders.items())
    return rows.select("property_id", "id", "likes", *places)


def karma_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users after the karma of those with a scored guess is written back; all others, and all other columns, stay. The outcome tells which were updated."""
    t = Tables(spark, sf_dir)
    rows = karma(t).select(F.col("user_id").alias("id"), F.col("karma").cast("int").alias("karma"), "internal_karma")
    return upserted(t.users, rows, ["id"], ["karma", "internal_karma"])


QUERIES = {f.__name__: f for f in (guess_medians, comment_orders, karma_written)}
ORACLE = {
    "guess_medians": with_domain(
        "WITH m AS (SELECT property_id, CAST(count(*) AS INTEGER) AS guess_count, CAST(median(guessed_price) AS DOUBLE) AS median, CAST(floor(CAST(sum(guessed_price) AS DOUBLE) / count(*) + 0.5) AS BIGINT) AS mean FROM price_guesses GROUP BY property_id), "
        f"x AS (SELECT g.id, m.*, coalesce(abs((g.guessed_price - median) / nullif(median, 0)) < CAST({WITHIN} AS DOUBLE), false) AS aligned FROM price_guesses g JOIN m USING (property_id)) "
        f"SELECT *, CASE WHEN aligned THEN {NEAR[0]} ELSE {AWAY[0]} END AS percent, CASE WHEN aligned THEN '{NEAR[1]}' ELSE '{AWAY[1]}' END AS message FROM x",
        "price_guesses",
    ),
    "comment_orders": with_domain(
        "WITH l AS (SELECT target_id, count(*) AS n FROM reactions WHERE target_type = 'comment' AND reaction_type = 'like' GROUP BY target_id), "
        "c AS (SELECT property_id, id, created_at, CAST(coalesce(n, 0) AS INTEGER) AS likes FROM comments LEFT JOIN l ON target_id = id WHERE parent_id IS NULL) SELECT property_id, id, likes, "
        + ", ".join(f"CAST(row_number() OVER (PARTITION BY property_id ORDER BY {by}, id) AS INTEGER) AS {name}" for name, by in (("newest", "created_at DESC"), ("oldest", "created_at"), ("most_liked", "likes DESC"), ("popular_recent", "likes * CAST(1000 AS DOUBLE) + epoch_ms(created_at) / CAST(1000000 AS DOUBLE) DESC")))
        + " FROM c",
        "comments",
        "reactions",
    ),
    "karma_written": with_domain(
        f"WITH k AS ({KARMA_SQL}) SELECT u.id, username, display_name, CAST(coalesce(k.karma, u.karma) AS INTEGER) AS karma, coalesce(k.internal_karma, u.internal_karma) AS internal_karma, CASE WHEN k.user_id IS NULL THEN 'kept' ELSE 'updated' END AS outcome FROM users u LEFT JOIN k ON k.user_id = u.id",
        "users",
        "price_guesses",
        "price_history",
    ),
}
