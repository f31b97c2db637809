"""Comments, guesses, likes, views and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gevel.functions import address, scoring
from gevel.functions.scoring import iso
from gevel.operators.dedup import hourly
from gevel.operators.rollups import now, recent, viewer
from gevel.sources.domain import AS_OF, Tables, with_domain


def shown_name() -> Column:
    return F.when(F.coalesce("display_name", F.lit("")) == "", F.col("username")).otherwise(F.col("display_name"))


def threads(t: Tables, sort: str = "popular") -> DataFrame:
    """Top-level comments of all properties with their place, score and replies (oldest first), as nested rows."""
    likes = t.reactions.where("target_type = 'comment' and reaction_type = 'like'").groupBy(F.col("target_id").alias("id")).agg(F.count("*").cast("int").alias("likes"))
    users = t.users.select(F.col("id").alias("user_id"), "username")
    rows = t.comments.join(users, "user_id").join(likes, "id", "left").withColumn("likes", F.coalesce("likes", F.lit(0)))
    replies = rows.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("created_at", F.col("id").alias("reply_id"), "username", "likes"))).alias("replies"))
    top = rows.where("parent_id is null").withColumn("score", F.col("likes") * 2 + scoring.recency_bonus(F.col("created_at"), now()))
    order = [F.desc("score"), F.desc("created_at"), F.asc("id")] if sort == "popular" else [F.desc("created_at"), F.asc("id")]
    place = F.row_number().over(Window.partitionBy("property_id").orderBy(*order))
    return top.withColumn("place", place).join(replies, "id", "left")


def comment_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.coalesce(F.array_join(F.transform("replies", lambda r: r["reply_id"].cast("string")), ","), F.lit(""))
    return threads(Tables(spark, sf_dir)).select("property_id", "place", "id", "username", "likes", F.col("score").cast("int").alias("score"), iso(F.col("created_at")).alias("created_at"), ids.alias("reply_ids"))


def comments_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(Tables(spark, sf_dir), "recent").select("property_id", "place", "id", "likes", F.md5("content").alias("content_md5"))


def guess_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All guesses by property, oldest first, with their users' names and ranks; memes are listed too."""
    t = Tables(spark, sf_dir)
    users = t.users.select(F.col("id").alias("user_id"), shown_name().alias("name"), scoring.rank(F.greatest(F.lit(0), "karma")).alias("rank"))
    place = F.row_number().over(Window.partitionBy("property_id").orderBy("created_at", "id"))
    return t.price_guesses.withColumn("place", place).join(users, "user_id").select("property_id", "place", "id", "user_id", "name", "rank", "guessed_price", "is_meme_guess")


def my_guesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's guesses and how each turned out against the newest sale."""
    t = Tables(spark, sf_dir)
    newest = F.max_by("price", F.struct("price_date", (-F.col("id")).alias("order"), "price"))
    sold = t.price_history.where("event_type = 'sold'").groupBy("property_id").agg(newest.alias("sold_price"))
    rows = t.price_guesses.withColumnRenamed("id", "guess_id").join(t.properties.select(F.col("id").alias("property_id"), "city"), "property_id").join(sold, "property_id", "left")
    return rows.select("user_id", "guess_id", "property_id", "city", "guessed_price", "sold_price", scoring.guess_outcome(F.col("guessed_price"), F.col("sold_price")).alias("outcome"), iso(F.col("created_at")).alias("created_at"))


def like_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likes of each target, and whether user 5 is among them."""
    t = Tables(spark, sf_dir)
    return t.reactions.where("reaction_type = 'like'").groupBy("target_type", "target_id").agg(F.count("*").cast("int").alias("likes"), F.max(F.col("user_id") == 5).alias("liked"))


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, viewers and views of the last week of each property."""
    t = Tables(spark, sf_dir)
    return t.property_views.withColumn("viewer", viewer()).groupBy("property_id").agg(F.count("*").cast("int").alias("views"), F.countDistinct("viewer").cast("int").alias("viewers"), F.count_if(recent(F.col("viewed_at"))).cast("int").alias("views_7d"))


def views_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that count, by property and viewer."""
    kept = hourly(Tables(spark, sf_dir).property_views)
    return kept.groupBy("property_id", "viewer").agg(F.count("*").cast("int").alias("views"), iso(F.max("viewed_at")).alias("last"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's name, rank and counts of guesses, comments, saves and likes given."""
    t = Tables(spark, sf_dir)
    facts = None
    for name, df in (("guesses", t.price_guesses), ("comments", t.comments), ("saves", t.saved_properties), ("likes", t.reactions)):
        part = df.select("user_id", F.lit(name).alias("kind"))
        facts = part if facts is None else facts.unionByName(part)
    kinds = ("guesses", "comments", "saves", "likes")
    counts = facts.groupBy(F.col("user_id").alias("id")).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    rows = t.users.join(counts, "id", "left")
    return rows.select("id", shown_name().alias("name"), F.greatest(F.lit(0), "karma").alias("karma"), scoring.rank(F.greatest(F.lit(0), "karma")).alias("rank"), *(F.coalesce(k, F.lit(0)).cast("int").alias(k) for k in kinds))


def guess_cooldowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Until when each guess can't be changed (five days), and whether that is still so."""
    t = Tables(spark, sf_dir)
    until = F.col("created_at") + F.expr("INTERVAL 5 DAYS")
    return t.price_guesses.select("id", "user_id", "property_id", iso(until).alias("until"), (until > now()).alias("cooling"))


def saved_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each save, and how fresh it is: under 7 days hot, under 30 warm, else cold; a property with an active listing is warm at least."""
    t = Tables(spark, sf_dir)
    days = F.floor((F.unix_micros(now()) - F.unix_micros("created_at")) / 86_400_000_000).cast("int")
    listed = t.listings.where("status = 'active'").select("property_id", F.lit(True).alias("listed")).distinct()
    rows = t.saved_properties.join(listed, "property_id", "left").withColumn("has_listing", F.col("listed").isNotNull())
    return rows.select("id", "user_id", "property_id", days.alias("days"), "has_listing", F.when(days < 7, "hot").when((days < 30) | F.col("has_listing"), "warm").otherwise("cold").alias("level"))


_NAME = "CASE WHEN coalesce(display_name, '') = '' THEN username ELSE display_name END"
_THREADS = f"""WITH k AS (SELECT target_id AS id, count(*) AS n FROM reactions WHERE target_type = 'comment' GROUP BY 1),
c AS (SELECT c.*, u.username, CAST(coalesce(k.n, 0) AS INTEGER) AS likes FROM comments c JOIN users u ON u.id = c.user_id LEFT JOIN k ON k.id = c.id),
s AS (SELECT *, likes * 2 + CASE WHEN created_at > TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR THEN 10 WHEN created_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 5 WHEN created_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY THEN 2 ELSE 0 END AS score FROM c WHERE parent_id IS NULL),
r AS (SELECT parent_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id) AS ids FROM c WHERE parent_id IS NOT NULL GROUP BY parent_id) """
_HOURLY = """RECURSIVE u AS (SELECT *, row_number() OVER (PARTITION BY property_id, user_id ORDER BY viewed_at, id) AS k FROM property_views WHERE user_id IS NOT NULL),
uk AS (SELECT property_id, user_id, k, viewed_at AS last, true AS kept FROM u WHERE k = 1
UNION ALL SELECT u.property_id, u.user_id, u.k, CASE WHEN u.viewed_at >= uk.last + INTERVAL 1 HOUR THEN u.viewed_at ELSE uk.last END, u.viewed_at >= uk.last + INTERVAL 1 HOUR FROM uk JOIN u ON u.property_id = uk.property_id AND u.user_id = uk.user_id AND u.k = uk.k + 1),
held AS (SELECT u.* FROM u JOIN uk USING (property_id, user_id, k) WHERE kept),
s AS (SELECT *, row_number() OVER (PARTITION BY property_id, session_id ORDER BY viewed_at, id) AS k FROM (SELECT id, property_id, session_id, viewed_at, true AS blocks FROM held WHERE session_id IS NOT NULL UNION ALL SELECT id, property_id, session_id, viewed_at, false FROM property_views WHERE user_id IS NULL AND session_id IS NOT NULL)),
sk AS (SELECT property_id, session_id, k, viewed_at AS last, true AS kept FROM s WHERE k = 1
UNION ALL SELECT s.property_id, s.session_id, s.k, CASE WHEN s.blocks OR s.viewed_at >= sk.last + INTERVAL 1 HOUR THEN s.viewed_at ELSE sk.last END, s.blocks OR s.viewed_at >= sk.last + INTERVAL 1 HOUR FROM sk JOIN s ON s.property_id = sk.property_id AND s.session_id = sk.session_id AND s.k = sk.k + 1)
SELECT property_id, viewer, CAST(count(*) AS INTEGER) AS views, strftime(max(viewed_at), '%Y-%m-%dT%H:%M:%SZ') AS last FROM (SELECT property_id, CAST(user_id AS VARCHAR) AS viewer, viewed_at FROM held
UNION ALL SELECT s.property_id, s.session_id, s.viewed_at FROM s JOIN sk USING (property_id, session_id, k) WHERE kept AND NOT blocks UNION ALL SELECT property_id, NULL, viewed_at FROM property_views WHERE user_id IS NULL AND session_id IS NULL) GROUP BY 1, 2"""

QUERIES = {f.__name__: f for f in (comment_threads, comments_recent, guess_list, my_guesses, like_counts, view_counts, views_hourly, profiles, guess_cooldowns, saved_activity)}
ORACLE = {
    "comment_threads": with_domain(_THREADS + "SELECT s.property_id, CAST(row_number() OVER (PARTITION BY property_id ORDER BY score DESC, created_at DESC, id) AS INTEGER) AS place, s.id, username, likes, CAST(score AS INTEGER) AS score, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, coalesce(r.ids, '') AS reply_ids FROM s LEFT JOIN r ON r.parent_id = s.id", "users", "comments", "reactions"),
    "comments_recent": with_domain(_THREADS + "SELECT property_id, CAST(row_number() OVER (PARTITION BY property_id ORDER BY created_at DESC, id) AS INTEGER) AS place, id, likes, md5(content) AS content_md5 FROM s", "users", "comments", "reactions"),
    "guess_list": with_domain(f"SELECT g.property_id, CAST(g.place AS INTEGER) AS place, g.id, g.user_id, {_NAME} AS name, {scoring.RANK_SQL.format(k='u.karma')} AS rank, g.guessed_price, g.is_meme_guess FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY created_at, id) AS place FROM price_guesses) g JOIN users u ON u.id = g.user_id", "users", "price_guesses"),
    "my_guesses": with_domain(
        "WITH s AS (SELECT property_id, price AS sold_price FROM (SELECT *, row_number() OVER (PARTITION BY property_id ORDER BY price_date DESC, id, price DESC) AS k FROM price_history WHERE event_type = 'sold') WHERE k = 1) "
        "SELECT g.user_id, g.id AS guess_id, g.property_id, p.city, g.guessed_price, s.sold_price, CASE WHEN s.sold_price IS NULL THEN 'pending' WHEN CAST(abs(guessed_price - sold_price) AS DOUBLE) / sold_price <= 0.05 THEN 'accurate' WHEN CAST(abs(guessed_price - sold_price) AS DOUBLE) / sold_price <= 0.20 THEN 'close' ELSE 'inaccurate' END AS outcome, "
        "strftime(g.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM price_guesses g JOIN properties p ON p.id = g.property_id LEFT JOIN s ON s.property_id = g.property_id", "properties", "price_guesses", "price_history"),
    "like_counts": with_domain("SELECT target_type, target_id, CAST(count(*) AS INTEGER) AS likes, bool_or(user_id = 5) AS liked FROM reactions GROUP BY 1, 2", "reactions"),
    "view_counts": with_domain(f"SELECT property_id, CAST(count(*) AS INTEGER) AS views, CAST(count(DISTINCT coalesce(CAST(user_id AS VARCHAR), session_id, CAST(id AS VARCHAR))) AS INTEGER) AS viewers, CAST(count(*) FILTER (WHERE viewed_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS INTEGER) AS views_7d FROM property_views GROUP BY 1", "property_views"),
    "views_hourly": with_domain(_HOURLY, "property_views"),
    "profiles": with_domain(f"SELECT u.id, {_NAME} AS name, karma, {scoring.RANK_SQL.format(k='karma')} AS rank, " + ", ".join(f"CAST((SELECT count(*) FROM {table} x WHERE x.user_id = u.id) AS INTEGER) AS {name}" for name, table in (("guesses", "price_guesses"), ("comments", "comments"), ("saves", "saved_properties"), ("likes", "reactions"))) + " FROM users u", "users", "price_guesses", "comments", "saved_properties", "reactions"),
    "guess_cooldowns": with_domain(f"SELECT id, user_id, property_id, strftime(created_at + INTERVAL 5 DAY, '%Y-%m-%dT%H:%M:%SZ') AS until, created_at + INTERVAL 5 DAY > TIMESTAMP '{AS_OF}' AS cooling FROM price_guesses", "price_guesses"),
    "saved_activity": with_domain(f"WITH d AS (SELECT *, CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(created_at)) / 86400000000) AS INTEGER) AS days, EXISTS (SELECT 1 FROM listings l WHERE l.property_id = s.property_id AND l.status = 'active') AS has_listing FROM saved_properties s), v AS (SELECT *, CASE WHEN days < 7 THEN 'hot' WHEN days < 30 THEN 'warm' ELSE 'cold' END AS by_days FROM d) SELECT id, user_id, property_id, days, has_listing, CASE WHEN has_listing AND by_days = 'cold' THEN 'warm' ELSE by_days END AS level FROM v", "saved_properties", "listings"),
}
