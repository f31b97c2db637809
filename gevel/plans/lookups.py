"""Look-ups by one of several keys, by parts of texts, at a remote database, and pages behind a token."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import address, texts
from gevel.functions.rd import from_rd, with_rd
from gevel.operators.cursors import By, cursor_page
from gevel.operators.merge import inserted_only
from gevel.operators.substrings import first_held, first_holding
from gevel.plans.mirrors import lookup_key
from gevel.sources.domain import DOMAIN, SHIFT, Tables, with_domain
from gevel.sources.remote import remote_table

#: Characters of an address that are enough to find it within a search.
HEAD = 20


def login_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each log-in with the account that has its id or its e-mail, by two equi-joins: of two accounts the one of the smaller id counts. The account is known, linked (it had no id yet), or to be made."""
    t = Tables(spark, sf_dir)
    a = t.accounts.select(F.col("id").alias("account_id"), F.col("google_id").alias("had"), "email")
    by_id = t.logins.select("id", "google_id").join(a.select("account_id", "had").where("had is not null"), F.col("google_id") == F.col("had"))
    by_mail = t.logins.select("id", "email").join(a, "email")
    both = by_id.select("id", "account_id", "had").unionByName(by_mail.select("id", "account_id", "had"))
    best = both.groupBy("id").agg(F.min(F.struct("account_id", "had")).alias("best"), F.countDistinct("account_id").cast("int").alias("accounts"))
    rows = t.logins.join(best, "id", "left")
    outcome = F.when(F.col("best").isNull(), "made").when(F.col("best.had").isNull(), "linked").otherwise("known")
    return rows.select("id", F.col("best.account_id").alias("account_id"), F.coalesce("accounts", F.lit(0)).alias("accounts"), outcome.alias("outcome"))


def _plain(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), r"\s+", "")


def searched(searches: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place_id, how) of searches (id, search) over places (id, street, house_number, postal_code, city): by postal code and number where both are named, else the first place whose text holds the search, or whose text's beginning the search holds."""
    asked = searches.select("id", _plain(F.col("search")).alias("text"))
    # What is found depends on the text alone, so each is looked up once.
    each = asked.select("text").where("text is not null").distinct()
    each = each.withColumn("code", F.upper(F.nullif(F.regexp_extract("text", "postcode:([a-z0-9]+)", 1), F.lit("")))).withColumn("number", F.nullif(F.regexp_extract("text", r"huisnummer:(\d+)", 1), F.lit("")))
    # Without white space "huisnummer" may follow the code, which then ends only at a sign that codes don't have.
    exact = places.groupBy(F.upper(F.regexp_replace("postal_code", r"\s+", "")).alias("code"), F.col("house_number").cast("string").alias("number")).agg(F.min("id").alias("exact"))
    exact = each.where("code is not null and number is not null").join(exact.hint("merge"), ["code", "number"]).select("text", "exact")
    shown = F.concat_ws(" ", F.coalesce("street", F.lit("")), F.col("house_number").cast("string"), F.coalesce("postal_code", F.lit("")), F.coalesce("city", F.lit("")))
    docs = places.select(F.col("id").alias("place"), _plain(shown).alias("doc")).withColumn("head", F.substring("doc", 1, HEAD))
    held = first_holding(each, "text", docs, "doc", "place").withColumnRenamed("place", "free")
    holds = first_held(each, "text", docs, "head", "place").withColumnRenamed("place", "free")
    found = exact.select("text", "exact", F.lit(None).cast("long").alias("free")).unionByName(held.unionByName(holds).withColumn("exact", F.lit(None).cast("long")))
    found = found.groupBy("text").agg(F.min("exact").alias("exact"), F.min("free").alias("free"))
    rows = asked.join(found, "text", "left")
    how = F.when(F.col("exact").isNotNull(), "exact").when(F.col("free").isNotNull(), "text").otherwise("none")
    return rows.select("id", F.coalesce("exact", "free").alias("place_id"), how.alias("how"))


def address_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches in free text with the property that each finds."""
    t = Tables(spark, sf_dir)
    return searched(t.address_searches, t.properties)


_EVENTS = f"""SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS address_id, CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % 37 = 0 THEN 'n/a' ELSE CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS VARCHAR) END AS price_cents,
CAST(l_shipdate + INTERVAL {SHIFT} DAY AS DATE) AS price_date, CASE l_returnflag WHEN 'N' THEN 'ASKING_PRICE' WHEN 'A' THEN 'Sold' ELSE 'Price_Drop' END AS status"""
_PRICES = _EVENTS + """, postal_code, house_number, house_number_addition
FROM {lineitem} l JOIN mirror_rows m ON m.id = l.l_partkey"""


def mirror_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price events that a mirror's database has more than we: read by ranges of ids, each of the property of its address as it should be written or else as it is; one of equal ones. Prices that can't be read, and addresses not known, are left out."""
    t = Tables(spark, sf_dir)
    files = {x: f"read_parquet('{sf_dir}/{x}.parquet')" for x in ("part", "lineitem")}
    # Each table streams through readers of one thread; they are joined here, as a join of the remote side would hold one of them in each reader.
    far = lambda schema, sql: remote_table(spark, schema, f"({sql.format(**files)})", "id", ":memory:", "duckdb", setup="SET threads TO 1")
    prices = far("id bigint, address_id bigint, price_cents string, price_date date, status string", _EVENTS + " FROM {lineitem} l")
    places = far("id bigint, postal_code string, house_number string, house_number_addition string", DOMAIN["mirror_rows"])
    prices = prices.where("price_cents is not null").withColumn("price", texts.euros(F.col("price_cents"))).where("price is not null")
    rows = places.where("postal_code is not null and postal_code <> ''").withColumnRenamed("id", "address_id")
    number, split = address.house_number(F.col("house_number")), address.house_suffix(F.col("house_number"))
    canonical = F.when(address.postal_code(F.col("postal_code")).isNotNull() & number.isNotNull(), lookup_key(F.col("postal_code"), number, F.coalesce(address.addition(F.col("house_number_addition")), split)))
    raw = F.when(number.isNotNull(), lookup_key(F.col("postal_code"), number, F.col("house_number_addition")))
    known = t.properties.where("postal_code is not null").select(lookup_key(F.col("postal_code"), F.col("house_number"), F.col("house_number_addition")).alias("key"), "id").groupBy("key").agg(F.min("id").alias("found"))
    rows = rows.withColumn("canonical", canonical).withColumn("raw", raw)
    for c in ("canonical", "raw"):
        rows = rows.join(known.select(F.col("key").alias(c), F.col("found").alias(f"by_{c}")), c, "left")
    rows = rows.select("address_id", F.coalesce("by_canonical", "by_raw").alias("property_id")).where("property_id is not null")
    events = prices.join(rows, "address_id").select("property_id", "price", "price_date", F.lower("status").alias("event_type"), "id")
    keys = ["property_id", "price_date", "price", "event_type"]
    return inserted_only(t.price_history, events, keys, F.asc("id")).select("property_id", "price", F.date_format("price_date", "yyyy-MM-dd").alias("price_date"), "event_type", F.lit("funda").alias("source"))


#: How a city's properties are paged: dearest first, those without a value last.
ORDER = (By("woz_value", down=True), By("built"), By("id"))


def property_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 15 properties, by the token of the last row of the first."""
    rows = Tables(spark, sf_dir).properties.where("city like 'P%'").select("id", "woz_value", "built", "city")
    first = cursor_page(rows, ORDER, 15).collect()
    return cursor_page(rows, ORDER, 15, first[-1]["cursor"] if first else None).drop("cursor")


def property_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties on the national grid, in whole decimetres, and how far the way back ends from where it began."""
    places = Tables(spark, sf_dir).properties.where("lon is not null and lat is not null").select("id", "lon", "lat")
    rows = from_rd(with_rd(places), lon="lon2", lat="lat2")
    return rows.select("id", F.floor(F.col("rd_x") * 10 + 0.5).cast("long").alias("x_dm"), F.floor(F.col("rd_y") * 10 + 0.5).cast("long").alias("y_dm"), ((F.abs(F.col("lon") - F.col("lon2")) < 1e-9 * 10) & (F.abs(F.col("lat") - F.col("lat2")) < 1e-9 * 10)).alias("back"))


_KEYS = r"""n AS (SELECT *, TRY_CAST(regexp_extract(trim(house_number), '^(\d+)', 1) AS INTEGER) AS number, upper(regexp_replace(postal_code, '\s', '', 'g')) AS code FROM r WHERE postal_code <> ''),
k AS (SELECT upper(regexp_replace(postal_code, '\s', '', 'g')) || '|' || house_number || '|' || upper(coalesce(house_number_addition, '')) AS key, min(id) AS found FROM properties WHERE postal_code IS NOT NULL GROUP BY 1),
e AS (SELECT coalesce(c.found, w.found) AS property_id, CAST(floor(TRY_CAST(price_cents AS DOUBLE) / 100 + 0.5) AS BIGINT) AS price, price_date, lower(status) AS event_type
FROM n LEFT JOIN k c ON c.key = CASE WHEN regexp_matches(code, '^\d{4}[A-Z]{2}$') AND number IS NOT NULL THEN code || '|' || number || '|' || coalesce(nullif(upper(trim(house_number_addition)), ''), nullif(upper(trim(regexp_extract(trim(house_number), '^(\d+)\s*[-/]?\s*(.*)$', 2))), ''), '') END
LEFT JOIN k w ON w.key = CASE WHEN number IS NOT NULL THEN code || '|' || number || '|' || upper(coalesce(house_number_addition, '')) END) """
QUERIES = {f.__name__: f for f in (login_matches, address_matches, mirror_prices, property_cursor, property_grid)}
ORACLE = {
    "login_matches": with_domain(
        "SELECT l.id, min(a.id) AS account_id, CAST(count(a.id) AS INTEGER) AS accounts, CASE WHEN min(a.id) IS NULL THEN 'made' WHEN arg_min(coalesce(a.google_id, ''), a.id) = '' THEN 'linked' ELSE 'known' END AS outcome FROM logins l LEFT JOIN accounts a ON a.google_id = l.google_id OR a.email = l.email GROUP BY l.id", "accounts", "logins"),
    "address_matches": with_domain(
        r"""WITH q AS (SELECT id, regexp_replace(lower(search), '\s+', '', 'g') AS text FROM address_searches),
p AS (SELECT id, regexp_replace(lower(coalesce(street, '') || ' ' || house_number || ' ' || coalesce(postal_code, '') || ' ' || coalesce(city, '')), '\s+', '', 'g') AS doc, upper(regexp_replace(postal_code, '\s+', '', 'g')) AS code, CAST(house_number AS VARCHAR) AS number FROM properties),
x AS (SELECT q.id, min(p.id) AS exact FROM q JOIN p ON p.code = upper(regexp_extract(text, 'postcode:([a-z0-9]+)', 1)) AND p.number = regexp_extract(text, 'huisnummer:(\d+)', 1) GROUP BY q.id),
f AS (SELECT text, min(p.id) AS free FROM (SELECT DISTINCT text FROM q) JOIN p ON contains(doc, text) OR contains(text, substr(doc, 1, 20)) GROUP BY text)
SELECT q.id, coalesce(exact, free) AS place_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN free IS NOT NULL THEN 'text' ELSE 'none' END AS how FROM q LEFT JOIN x ON x.id = q.id LEFT JOIN f ON f.text = q.text""", "properties", "address_searches"),
    "mirror_prices": with_domain(
        f"WITH r AS ({_PRICES.format(lineitem='lineitem')}), {_KEYS} SELECT DISTINCT property_id, price, strftime(price_date, '%Y-%m-%d') AS price_date, event_type, 'funda' AS source FROM e "
        "WHERE property_id IS NOT NULL AND price IS NOT NULL AND NOT EXISTS (SELECT 1 FROM price_history h WHERE h.property_id = e.property_id AND h.price_date = e.price_date AND h.price = e.price AND h.event_type = e.event_type)", "properties", "mirror_rows", "price_history"),
    "property_cursor": with_domain("SELECT id, woz_value, built, city FROM properties WHERE city LIKE 'P%' ORDER BY woz_value DESC NULLS LAST, built, id LIMIT 15 OFFSET 15", "properties"),
}
