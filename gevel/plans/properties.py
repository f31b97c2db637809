"""Lists, look-ups and details of properties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from gevel.functions import address, geo, scoring
from gevel.functions.scoring import iso
from gevel.operators.rollups import ACTIVITY_SQL, LATEST_SQL, activity, latest_active_listing, page, recent, viewer
from gevel.plans.valuation import VALUES_SQL, values
from gevel.sources.domain import AS_OF, Tables, with_domain


def _address() -> Column:
    return address.address(F.col("street"), F.col("house_number"), F.col("house_number_addition"), F.col("postal_code"), F.col("city"))


def _ordered(key: str, *order: Column) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def _with_listing(t: Tables, rows: DataFrame) -> DataFrame:
    newest = latest_active_listing(t).withColumnRenamed("property_id", "id")
    return rows.join(newest, "id", "left").withColumn("has_listing", F.col("listing_id").isNotNull())


def listed(t: Tables, city: str | None = None, least: int | None = None, most: int | None = None, box: Sequence[float] | None = None, around: tuple[float, float] | None = None, radius: float = 1000) -> DataFrame:
    """Properties by city, tax value, box (west, south, east, north; bounds outside) and metres around a place. A box with a bound of 0 is no box."""
    p = t.properties
    if city is not None:
        p = p.where(F.col("city") == city)
    if least is not None:
        p = p.where(F.col("woz_value") >= least)
    if most is not None:
        p = p.where(F.col("woz_value") <= most)
    if box is not None and all(box):
        west, south, east, north = box
        p = p.where((F.col("lon") > west) & (F.col("lon") < east) & (F.col("lat") > south) & (F.col("lat") < north))
    if around is not None:
        p = p.where(geo.near_box(F.col("lon"), F.col("lat"), *around, radius)).where(geo.metres(F.lit(around[0]), F.lit(around[1]), F.col("lon"), F.col("lat")) <= radius)
    return p


def _list_rows(t: Tables, p: DataFrame) -> DataFrame:
    rows = _with_listing(t, p).join(activity(t).withColumnRenamed("property_id", "id"), "id", "left")
    return rows.select("id", _address().alias("address"), "city", "status", "woz_value", "asking_price", "has_listing", F.coalesce("activity_score", F.lit(0)).cast("int").alias("activity_score"), iso(F.col("created_at")).alias("created_at"))


def property_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a city's properties of some tax values, in the order of the list."""
    t = Tables(spark, sf_dir)
    return _list_rows(t, page(listed(t, city="PROMO", least=20_000, most=60_000), F.asc("created_at"), F.asc("id"), number=2, size=10)).orderBy("created_at", "id")


def property_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _list_rows(t, listed(t, box=(4.0, 51.0, 6.0, 53.0)))


def property_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return _list_rows(t, listed(t, around=(5.0, 52.0), radius=30_000))


def resolved(t: Tables, code: str, number: int, extra: str | None) -> DataFrame:
    """The property at an address; a missing position is 0, 0."""
    p = t.properties.where((F.col("postal_code") == address.postal_code(F.lit(code))) & (F.col("house_number") == number) & (F.coalesce("house_number_addition", F.lit("")) == F.coalesce(address.addition(F.lit(extra).cast("string")), F.lit(""))))
    rows = _with_listing(t, p.orderBy("id").limit(1))
    return rows.select("id", _address().alias("address"), "postal_code", "city", F.coalesce("lon", F.lit(0.0)).alias("lon"), F.coalesce("lat", F.lit(0.0)).alias("lat"), "woz_value", "has_listing")


def property_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every address of a look-up list against the register, by one join on its normalised parts."""
    t = Tables(spark, sf_dir)
    asked = t.incoming.select("row_id", address.postal_code(F.col("postal_code")).alias("code"), address.house_number(F.col("house_number")).alias("number"), F.coalesce(address.house_suffix(F.col("house_number")), F.lit("")).alias("extra"))
    p = t.properties.select("id", F.col("postal_code").alias("code"), F.col("house_number").alias("number"), F.coalesce("house_number_addition", F.lit("")).alias("extra"), F.coalesce("lon", F.lit(0.0)).alias("lon"), F.coalesce("lat", F.lit(0.0)).alias("lat"))
    found = asked.join(p, ["code", "number", "extra"]).groupBy("row_id").agg(F.min(F.struct("id", "lon", "lat")).alias("p"))
    return found.select("row_id", F.col("p.id").alias("property_id"), F.col("p.lon").alias("lon"), F.col("p.lat").alias("lat"))


def batch(t: Tables, ids: Sequence[int]) -> DataFrame:
    """Properties in the order of the ids, again for an id that is repeated; unknown ones are left out."""
    if not 1 <= len(ids) <= 50:
        raise ValueError("1 to 50 ids")
    asked = t.spark.range(1).select(F.posexplode(F.array(*(F.lit(int(i)).cast("long") for i in ids))).alias("position", "id"))
    rows = _with_listing(t, t.properties.where(F.col("id").isin([int(i) for i in ids])))
    return F.broadcast(asked).join(rows, "id").select("position", "id", _address().alias("address"), "asking_price", "has_listing").orderBy("position")


BATCH = (7, 3, 100, 3, 999_999_999, 55)


def property_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch(Tables(spark, sf_dir), BATCH)


def details(t: Tables, user_id: int) -> DataFrame:
    """All that a property's page shows, of every property, as one user sees it."""
    count = lambda df, name, *more: df.groupBy(F.col("property_id").alias("id")).agg(F.count("*").alias(name), *more)
    likes = t.reactions.where("target_type = 'property' and reaction_type = 'like'").withColumnRenamed("target_id", "property_id")
    rows = _with_listing(t, t.properties)
    for part in (
        count(t.comments, "comments"),
        count(t.price_guesses, "guesses"),
        count(likes, "likes", F.max(F.col("user_id") == user_id).alias("liked")),
        count(t.saved_properties, "saves", F.max(F.col("user_id") == user_id).alias("saved")),
        count(t.property_views.withColumn("viewer", viewer()), "views", F.countDistinct("viewer").alias("viewers"), F.count_if(recent(F.col("viewed_at"))).alias("week")),
        values(t).select(F.col("property_id").alias("id"), "fmv", "confidence", "divergence"),
    ):
        rows = rows.join(part, "id", "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return rows.select(
        "id", address.display_address(F.col("street"), F.col("house_number"), F.col("house_number_addition"), F.col("postal_code"), F.col("city")).alias("address"),
        "asking_price", "woz_value", "fmv", "confidence", "divergence", number("comments").alias("comment_count"), number("guesses").alias("guess_count"), number("likes").alias("like_count"),
        number("saves").alias("save_count"), number("views").alias("view_count"), number("viewers").alias("viewer_count"), number("week").alias("views_7d"), flag("liked").alias("is_liked"), flag("saved").alias("is_saved"),
        scoring.detail_level(number("week"), number("comments"), number("guesses")).alias("activity_level"),
    )


def property_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details(Tables(spark, sf_dir), 5)


def saved_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's saved properties, newest first by place."""
    t = Tables(spark, sf_dir)
    saved = t.saved_properties.select(F.col("id").alias("save_id"), "user_id", F.col("property_id").alias("id"), F.col("created_at").alias("saved_at"))
    rows = _with_listing(t, t.properties).join(saved, "id")
    place = F.row_number().over(_ordered("user_id", F.desc("saved_at"), F.asc("save_id")))
    return rows.select("user_id", place.alias("place"), "id", _address().alias("address"), "asking_price", "has_listing", iso(F.col("saved_at")).alias("saved_at"))


def listing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings of all properties, newest first by place."""
    t = Tables(spark, sf_dir)
    place = F.row_number().over(_ordered("property_id", F.desc("created_at"), F.asc("id")))
    return t.listings.select("property_id", place.alias("place"), "id", "source_name", "asking_price", "status", "price_type", iso(F.col("created_at")).alias("created_at"))


def price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price events of all properties, newest first by place."""
    t = Tables(spark, sf_dir)
    place = F.row_number().over(_ordered("property_id", F.desc("price_date"), F.asc("id"), F.asc("price")))
    return t.price_history.select("property_id", place.alias("place"), "id", "price", F.date_format("price_date", "yyyy-MM-dd").alias("price_date"), "event_type")


_LISTED = f"""WITH l AS ({LATEST_SQL}), a AS ({ACTIVITY_SQL})
SELECT p.id, {address.ADDRESS_SQL} AS address, p.city, p.status, p.woz_value, l.asking_price, l.listing_id IS NOT NULL AS has_listing, CAST(coalesce(a.activity_score, 0) AS INTEGER) AS activity_score,
strftime(p.created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM properties p LEFT JOIN l ON l.property_id = p.id LEFT JOIN a ON a.property_id = p.id """
_NEED = ("properties", "listings", "comments", "price_guesses")
_CODE = r"CASE WHEN regexp_matches(upper(regexp_replace(postal_code, '\s+', '', 'g')), '^\d{4}[A-Z]{2}$') THEN upper(regexp_replace(postal_code, '\s+', '', 'g')) END"
_NUMBER = r"TRY_CAST(regexp_extract(trim(house_number), '^(\d+)\s*[-/]?\s*(.*)$', 1) AS INTEGER)"
_SUFFIX = r"upper(trim(regexp_extract(trim(house_number), '^(\d+)\s*[-/]?\s*(.*)$', 2)))"
_DETAILS = f"""WITH l AS ({LATEST_SQL}),
c AS (SELECT property_id, count(*) AS n FROM comments GROUP BY 1), g AS (SELECT property_id, count(*) AS n FROM price_guesses GROUP BY 1),
r AS (SELECT target_id AS property_id, count(*) AS n, bool_or(user_id = 5) AS mine FROM reactions WHERE target_type = 'property' GROUP BY 1),
s AS (SELECT property_id, count(*) AS n, bool_or(user_id = 5) AS mine FROM saved_properties GROUP BY 1),
v AS (SELECT property_id, count(*) AS n, count(DISTINCT coalesce(CAST(user_id AS VARCHAR), session_id, CAST(id AS VARCHAR))) AS viewers, count(*) FILTER (WHERE viewed_at > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY) AS week FROM property_views GROUP BY 1),
w AS (SELECT p.*, l.asking_price, coalesce(c.n, 0) AS comments, coalesce(g.n, 0) AS guesses, coalesce(r.n, 0) AS likes, coalesce(s.n, 0) AS saves, coalesce(v.n, 0) AS views, coalesce(v.viewers, 0) AS viewers, coalesce(v.week, 0) AS week,
  coalesce(r.mine, false) AS liked, coalesce(s.mine, false) AS saved FROM properties p LEFT JOIN l ON l.property_id = p.id LEFT JOIN c ON c.property_id = p.id LEFT JOIN g ON g.property_id = p.id LEFT JOIN r ON r.property_id = p.id LEFT JOIN s ON s.property_id = p.id LEFT JOIN v ON v.property_id = p.id)
SELECT p.id, concat_ws(', ', {address.ADDRESS_SQL.split(" || ', '")[0]}, concat_ws(' ', p.postal_code, p.city)) AS address, p.asking_price, p.woz_value, f.fmv, f.confidence, f.divergence,
CAST(comments AS INTEGER) AS comment_count, CAST(guesses AS INTEGER) AS guess_count, CAST(likes AS INTEGER) AS like_count, CAST(saves AS INTEGER) AS save_count, CAST(views AS INTEGER) AS view_count, CAST(viewers AS INTEGER) AS viewer_count, CAST(week AS INTEGER) AS views_7d, liked AS is_liked, saved AS is_saved,
CASE WHEN week > 50 OR comments > 10 OR guesses > 5 THEN 'hot' WHEN week > 10 OR comments > 3 OR guesses > 1 THEN 'warm' ELSE 'cold' END AS activity_level FROM w p JOIN ({{values}}) f ON f.property_id = p.id"""


def _oracle() -> dict[str, str]:
    place = "SELECT {0}, CAST(row_number() OVER (PARTITION BY {1}) AS INTEGER) AS place, {2} FROM {3}"
    return {
        "property_list": with_domain(_LISTED + "WHERE p.city = 'PROMO' AND p.woz_value BETWEEN 20000 AND 60000 ORDER BY p.created_at, p.id LIMIT 10 OFFSET 10", *_NEED),
        "property_box": with_domain(_LISTED + "WHERE p.lon > 4.0 AND p.lon < 6.0 AND p.lat > 51.0 AND p.lat < 53.0", *_NEED),
        "property_radius": with_domain(_LISTED + f"WHERE {geo.metres_sql('5.0', '52.0', 'p.lon', 'p.lat')} <= 30000", *_NEED),
        "property_resolve": with_domain(
            f"SELECT row_id, id AS property_id, lon, lat FROM (SELECT i.row_id, p.id, coalesce(p.lon, 0.0) AS lon, coalesce(p.lat, 0.0) AS lat, row_number() OVER (PARTITION BY i.row_id ORDER BY p.id) AS k FROM (SELECT row_id, {_CODE} AS code, {_NUMBER} AS number, {_SUFFIX} AS extra FROM incoming) i "
            "JOIN properties p ON p.postal_code = i.code AND p.house_number = i.number AND coalesce(p.house_number_addition, '') = i.extra) WHERE k = 1", "properties", "incoming"),
        "property_batch": with_domain(f"WITH l AS ({LATEST_SQL}), q AS (SELECT unnest({list(BATCH)}) AS id, unnest(range({len(BATCH)})) AS position) SELECT CAST(q.position AS INTEGER) AS position, p.id, {address.ADDRESS_SQL} AS address, l.asking_price, l.listing_id IS NOT NULL AS has_listing FROM q JOIN properties p ON p.id = q.id LEFT JOIN l ON l.property_id = p.id", "properties", "listings"),
        "property_details": with_domain(_DETAILS.format(values=VALUES_SQL), "properties", "users", "listings", "comments", "price_guesses", "reactions", "saved_properties", "property_views"),
        "saved_list": with_domain(f"WITH l AS ({LATEST_SQL}) " + place.format("s.user_id", "s.user_id ORDER BY s.created_at DESC, s.id", f"p.id, {address.ADDRESS_SQL} AS address, l.asking_price, l.listing_id IS NOT NULL AS has_listing, strftime(s.created_at, '%Y-%m-%dT%H:%M:%SZ') AS saved_at", "saved_properties s JOIN properties p ON p.id = s.property_id LEFT JOIN l ON l.property_id = p.id"), "properties", "listings", "saved_properties"),
        "listing_history": with_domain(place.format("property_id", "property_id ORDER BY created_at DESC, id", "id, source_name, asking_price, status, price_type, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at", "listings"), "listings"),
        "price_events": with_domain(place.format("property_id", "property_id ORDER BY price_date DESC, id, price", "id, price, strftime(price_date, '%Y-%m-%d') AS price_date, event_type", "price_history"), "price_history"),
    }


QUERIES = {f.__name__: f for f in (property_list, property_box, property_radius, property_resolve, property_batch, property_details, saved_list, listing_history, price_events)}
ORACLE = _oracle()
