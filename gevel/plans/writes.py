"""Writes that keep rules: guesses, likes and saves, submitted listings, comments, and price events; each row with what becomes of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gevel.functions import address, scoring, texts
from gevel.functions.scoring import iso
from gevel.operators.dedup import spaced
from gevel.plans.ingest import _MATCH, matched
from gevel.sources.domain import Tables, with_domain

#: Days until a guess may be changed.
COOLDOWN = 5


def _with_property(rows: DataFrame, t: Tables, *columns: str) -> DataFrame:
    """Rows with the columns named of the property that they name, and whether there is one (found)."""
    return rows.join(t.properties.select(F.col("id").alias("property_id"), *columns, F.lit(True).alias("found")), "property_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def guess_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submitted guess: created, updated (COOLDOWN days or more after the last that was taken), refused with the end of the wait, or of no property. At equal times the first id is taken."""
    t = Tables(spark, sf_dir)
    rows = _with_property(t.guess_submissions, t, "woz_value")
    key = ["user_id", "property_id"]
    first = rows.where("found").groupBy(*key, "submitted_at").agg(F.min("id").alias("id"))
    taken = first.join(spaced(first, key, "submitted_at", COOLDOWN * 86_400), [*key, "submitted_at"]).select("id", F.lit(True).alias("taken"))
    rows = rows.join(taken, "id", "left")
    so_far = Window.partitionBy(*key).orderBy("submitted_at", "id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("taken"), F.col("submitted_at")), ignorenulls=True).over(so_far)
    outcome = F.when(~F.col("found"), "not found").when(F.col("taken") & last.isNull(), "created").when(F.col("taken"), "updated").otherwise("refused")
    out = rows.select("*", outcome.alias("outcome"), last.alias("last"))
    wait = F.when(F.col("outcome") == "refused", iso(F.col("last") + F.expr(f"INTERVAL {COOLDOWN} DAYS")))
    meme = F.when(F.col("outcome").isin("created", "updated"), scoring.is_meme(F.col("guessed_price"), F.col("woz_value")))
    return out.select("id", "user_id", "property_id", "guessed_price", "outcome", meme.alias("is_meme"), wait.alias("wait_until"))


def guess_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The guesses that are held in the end: the last price taken, with the times of the first and the last."""
    t = Tables(spark, sf_dir)
    done = guess_writes(spark, sf_dir).where("outcome in ('created', 'updated')").join(t.guess_submissions.select("id", "submitted_at"), "id")
    order = F.struct("submitted_at", "id")
    return done.groupBy("user_id", "property_id").agg(F.max_by("guessed_price", order).alias("guessed_price"), F.max_by("is_meme", order).alias("is_meme"), iso(F.min("submitted_at")).alias("created_at"), iso(F.max("submitted_at")).alias("updated_at"))


def toggle_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every like, unlike, save and unsave: what it does after those before it, and how many users the property then has of that kind. A second like is a conflict, a second save changes nothing."""
    t = Tables(spark, sf_dir)
    own = Window.partitionBy("kind", "property_id", "user_id").orderBy("made_at", "id")
    rows = _with_property(t.toggles, t).withColumn("was", F.coalesce(F.lag(F.col("action") == "on").over(own), F.lit(False)))
    on = F.col("action") == "on"
    change = F.when(~F.col("found") | (on == F.col("was")), 0).when(on, 1).otherwise(-1)
    kept = Window.partitionBy("kind", "property_id").orderBy("made_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    same = F.when(on, F.when(F.col("kind") == "like", "conflict").otherwise("unchanged")).otherwise("not there")
    outcome = F.when(~F.col("found"), "not found").when(on == F.col("was"), same).when(on, "added").otherwise("removed")
    return rows.select("id", "kind", "property_id", "user_id", outcome.alias("outcome"), F.sum(change).over(kept).cast("int").alias("users"))


def listing_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submitted listing: created, of no property, or a duplicate by its clean URL of a listing or of an earlier submission."""
    t = Tables(spark, sf_dir)
    some = t.incoming.select(F.col("row_id").alias("id"), F.when(F.col("row_id") % 17 == 0, -1).otherwise(F.col("near_key")).alias("property_id"), address.source_url(F.col("source_url")).alias("url"), texts.site_by_part(F.col("source_url")).alias("site"))
    rows = _with_property(some, t)
    held = t.listings.where("id % 3 = 0").select(address.source_url(F.col("source_url")).alias("url"), F.lit(True).alias("held")).distinct()
    rows = rows.join(held, "url", "left")
    # Of the submissions that could be taken, the first of each URL is.
    order = F.row_number().over(Window.partitionBy("url", "found").orderBy("id"))
    rows = rows.withColumn("place", order)
    outcome = F.when(~F.col("found"), "not found").when(F.col("held") | (F.col("place") > 1), "duplicate").otherwise("created")
    return rows.select("id", "property_id", "url", "site", outcome.alias("outcome"))


def comment_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every submitted comment: created, of no property, a reply to none, or a reply to a reply, which cannot be. The parent's property is not asked for."""
    t = Tables(spark, sf_dir)
    parents = t.comments.select(F.col("id").alias("parent_id"), F.col("parent_id").isNotNull().alias("is_reply"))
    rows = _with_property(t.comment_submissions, t).join(parents, "parent_id", "left")
    outcome = F.when(~F.col("found"), "not found").when(F.col("parent_id").isNull(), "created").when(F.col("is_reply").isNull(), "no parent").when(F.col("is_reply"), "invalid parent").otherwise("created")
    return rows.select("id", "property_id", "parent_id", outcome.alias("outcome"))


def price_event_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price events that incoming listings bring for the properties that they match and that are not yet known by property, day, price and kind; one of equal ones."""
    t = Tables(spark, sf_dir)
    day = F.date_add(F.lit("1997-06-01").cast("date"), (F.col("row_id") % 28).cast("int"))
    new = matched(t).where("how in ('address', 'position')").select("property_id", "source_name", F.col("asking_price").alias("price"), day.alias("price_date"), F.lit(None).cast("string").alias("event_type"), F.lit(False).alias("known"))
    old = t.price_history.select("property_id", F.lit(None).cast("string").alias("source_name"), "price", "price_date", "event_type", F.lit(True).alias("known")).dropna(subset=["property_id", "price", "price_date", "event_type"])
    # A listing brings its events only where its property is, so they are not dealt again.
    rows = new.unionByName(old).repartition("property_id")
    brought = F.array(*(F.struct("price", F.date_add("price_date", k).alias("price_date"), F.lit(kind).alias("event_type")) for k, kind in ((0, "asking_price"), (7, "asking_price"), (7, "asking_price"), (30, "sold"))))
    held = F.array(F.struct("price", "price_date", "event_type"))
    rows = rows.select("property_id", "source_name", "known", F.inline(F.when(F.col("known"), held).otherwise(F.array_distinct(brought))))
    events = rows.groupBy("property_id", "price_date", "price", "event_type").agg(F.min("source_name").alias("source_name"), F.max("known").alias("known")).where("not known")
    return events.select("property_id", "price", F.date_format("price_date", "yyyy-MM-dd").alias("price_date"), "event_type", "source_name")


_WRITES = f"""RECURSIVE r AS (SELECT s.*, p.woz_value, p.id IS NOT NULL AS found, row_number() OVER (PARTITION BY s.user_id, s.property_id ORDER BY s.submitted_at, s.id) AS k FROM guess_submissions s LEFT JOIN properties p ON p.id = s.property_id),
f AS (SELECT id, user_id, property_id, k, submitted_at AS upto, CAST(NULL AS TIMESTAMP) AS last, true AS taken FROM r WHERE found AND k = 1
UNION ALL SELECT r.id, r.user_id, r.property_id, r.k, CASE WHEN r.submitted_at >= f.upto + INTERVAL {COOLDOWN} DAY THEN r.submitted_at ELSE f.upto END, f.upto, r.submitted_at >= f.upto + INTERVAL {COOLDOWN} DAY FROM f JOIN r ON r.user_id = f.user_id AND r.property_id = f.property_id AND r.k = f.k + 1 AND r.found),
w AS (SELECT r.id, r.user_id, r.property_id, r.guessed_price, r.submitted_at, CASE WHEN NOT r.found THEN 'not found' WHEN f.k = 1 THEN 'created' WHEN f.taken THEN 'updated' ELSE 'refused' END AS outcome,
CASE WHEN f.taken THEN coalesce(r.woz_value > 0 AND (r.guessed_price / r.woz_value < 0.2 OR r.guessed_price / r.woz_value > 5.0), false) END AS is_meme, CASE WHEN NOT f.taken THEN strftime(f.last + INTERVAL {COOLDOWN} DAY, '%Y-%m-%dT%H:%M:%SZ') END AS wait_until FROM r LEFT JOIN f ON f.id = r.id) """
_CLEAN_URL = r"regexp_replace('https://www.funda.nl' || substr(regexp_replace({0}, '[?#].*$', ''), 21), '/+$', '')"

QUERIES = {f.__name__: f for f in (guess_writes, guess_table, toggle_writes, listing_writes, comment_writes, price_event_writes)}
ORACLE = {
    "guess_writes": with_domain(_WRITES + "SELECT id, user_id, property_id, guessed_price, outcome, is_meme, wait_until FROM w", "guess_submissions", "properties"),
    "guess_table": with_domain(
        _WRITES + "SELECT user_id, property_id, arg_max(guessed_price, (submitted_at, id)) AS guessed_price, arg_max(is_meme, (submitted_at, id)) AS is_meme, strftime(min(submitted_at), '%Y-%m-%dT%H:%M:%SZ') AS created_at, strftime(max(submitted_at), '%Y-%m-%dT%H:%M:%SZ') AS updated_at "
        "FROM w WHERE outcome IN ('created', 'updated') GROUP BY user_id, property_id", "guess_submissions", "properties"),
    "toggle_writes": with_domain(
        "WITH s AS (SELECT t.*, p.id IS NOT NULL AS found, coalesce((SELECT x.action = 'on' FROM toggles x WHERE x.kind = t.kind AND x.property_id = t.property_id AND x.user_id = t.user_id AND (x.made_at, x.id) < (t.made_at, t.id) ORDER BY x.made_at DESC, x.id DESC LIMIT 1), false) AS was FROM toggles t LEFT JOIN properties p ON p.id = t.property_id) "
        "SELECT id, kind, property_id, user_id, CASE WHEN NOT found THEN 'not found' WHEN action = 'on' AND was THEN CASE kind WHEN 'like' THEN 'conflict' ELSE 'unchanged' END WHEN action = 'off' AND NOT was THEN 'not there' WHEN action = 'on' THEN 'added' ELSE 'removed' END AS outcome, "
        "CAST(sum(CASE WHEN NOT found OR (action = 'on') = was THEN 0 WHEN action = 'on' THEN 1 ELSE -1 END) OVER (PARTITION BY kind, property_id ORDER BY made_at, id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS users FROM s", "toggles", "properties"),
    "listing_writes": with_domain(
        f"WITH s AS (SELECT row_id AS id, CASE WHEN row_id % 17 = 0 THEN -1 ELSE near_key END AS property_id, {_CLEAN_URL.format('source_url')} AS url FROM incoming), f AS (SELECT s.*, EXISTS (SELECT 1 FROM properties p WHERE p.id = s.property_id) AS found FROM s) "
        "SELECT id, property_id, url, 'funda' AS site, CASE WHEN NOT found THEN 'not found' WHEN EXISTS (SELECT 1 FROM listings l WHERE l.id % 3 = 0 AND l.source_url = f.url) OR id > (SELECT min(g.id) FROM f g WHERE g.url = f.url AND g.found) THEN 'duplicate' ELSE 'created' END AS outcome FROM f", "incoming", "listings", "properties"),
    "comment_writes": with_domain(
        "SELECT s.id, s.property_id, s.parent_id, CASE WHEN p.id IS NULL THEN 'not found' WHEN s.parent_id IS NULL THEN 'created' WHEN c.id IS NULL THEN 'no parent' WHEN c.parent_id IS NOT NULL THEN 'invalid parent' ELSE 'created' END AS outcome "
        "FROM comment_submissions s LEFT JOIN properties p ON p.id = s.property_id LEFT JOIN comments c ON c.id = s.parent_id", "comment_submissions", "properties", "comments"),
    "price_event_writes": with_domain(
        _MATCH + ", e AS (SELECT property_id, source_name, asking_price AS price, DATE '1997-06-01' + CAST(row_id % 28 + k AS INTEGER) AS price_date, kind AS event_type FROM m, (VALUES (0, 'asking_price'), (7, 'asking_price'), (30, 'sold')) v(k, kind) WHERE how IN ('address', 'position')) "
        "SELECT property_id, price, strftime(price_date, '%Y-%m-%d') AS price_date, event_type, min(source_name) AS source_name FROM e WHERE NOT EXISTS (SELECT 1 FROM price_history h WHERE h.property_id = e.property_id AND h.price_date = e.price_date AND h.price = e.price AND h.event_type = e.event_type) GROUP BY property_id, price, e.price_date, event_type", "properties", "incoming", "price_history"),
}
