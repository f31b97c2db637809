"""What users read: addresses, prices, times and standings in words, and what URLs and hosts are allowed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions import texts
from gevel.operators.rollups import now
from gevel.sources.domain import AS_OF, Tables, with_domain


def address_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties' addresses as written and as paths, what a path with those parts shows, and whether they lie in the country."""
    p = Tables(spark, sf_dir).properties
    house, c = F.col("house_number").cast("string"), F.col
    written = texts.written_address(c("street"), house, c("house_number_addition"), c("postal_code"), c("city"))
    path = texts.address_path(c("city"), F.coalesce("postal_code", F.lit("")), c("street"), house)
    placeholder = texts.is_placeholder(F.concat(F.when(c("id") % 7 == 0, "Bag pand ").otherwise("Pand "), "register_id"))
    return p.select(
        "id", written.alias("written"), texts.postal_code(c("postal_code")).alias("code"), path.alias("path"), texts.view_kind(c("city"), c("postal_code"), c("street"), house).alias("view_kind"),
        texts.truncated(written, 24).alias("short"), texts.area(c("area")).alias("area"), placeholder.alias("placeholder"), texts.in_country(c("lon"), c("lat")).alias("in_country"),
    )


def price_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All listings with a price: the price in words, its place on the slider and beside the tax value."""
    t = Tables(spark, sf_dir)
    rows = t.listings.where("asking_price is not null").select("id", "property_id", F.col("asking_price").alias("asked")).join(t.properties.where("woz_value > 0").select(F.col("id").alias("property_id"), F.col("woz_value").alias("woz")), "property_id")
    asked, woz = F.col("asked"), F.col("woz")
    low, high = F.least(asked, woz), F.greatest(asked, woz)
    place, woz_place = texts.slider_position(asked), texts.slider_position(woz)
    return rows.select(
        "id", texts.price(asked).alias("price"), texts.price(asked * 37, compact=True).alias("compact"), texts.price_range(low, high).alias("price_range"), texts.percentage((asked - woz) / woz, signed=True).alias("above"),
        F.round(place, 9).alias("place"), texts.slider_price(F.round(place, 2)).alias("slider_price"), F.round(texts.bar_position((low + high * 3) / 4, low, high), 6).alias("bar"), texts.is_near(place, woz_place).alias("near"),
    )


def karma_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users' points in words and the two standings that go by other ladders than profiles do."""
    points = F.col("karma") * F.lit(37)
    return Tables(spark, sf_dir).users.select("id", texts.karma(points).alias("points"), texts.standing(points).alias("standing"), texts.badge(F.col("karma")).alias("badge"))


def time_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long ago each guess was made, when it may be changed, and when its user may change their name had they done so then."""
    rows = Tables(spark, sf_dir).price_guesses
    made = F.col("created_at")
    return rows.select("id", texts.elapsed(made, now()).alias("elapsed"), texts.remaining(made + F.expr("INTERVAL 5 DAYS"), now()).alias("wait"), texts.remaining(made + F.expr("INTERVAL 30 DAYS"), now()).alias("name_wait"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's site by the rule for submissions and by that for fetching, also of look-alike hosts made from it."""
    pages = Tables(spark, sf_dir).raw("pages")
    hosts = F.array(*map(F.lit, ("https://www.funda.nl", "https://notfunda.nl", "http://funda.nl", "https://pararius.com", "https://www.pararius.nl:8443", "https://funda.nl.example.org", "https://example.org")))
    rows = pages.select("page_id", F.posexplode(F.transform(hosts, lambda h: F.concat(h, F.lit("/x/"), F.col("page_id").cast("string")))).alias("kind", "url"))
    rows = rows.unionByName(pages.select("page_id", F.lit(-1).alias("kind"), "url"))
    url = F.col("url")
    return rows.select("page_id", "kind", texts.site_by_part(url).alias("by_part"), texts.site_by_domain(url).alias("by_domain"), texts.may_be_fetched(url).alias("may_be_fetched"))


def private_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of hosts made from the events' ids, and whether they are private."""
    i = F.col("event_id")
    four = F.concat_ws(".", *(F.element_at(F.array(*map(F.lit, v)), (i % len(v) + 1).cast("int")).cast("string") for v in ((0, 9, 10, 127, 169, 172, 192, 8), (15, 16, 31, 32, 168, 254, 0), (1, 2, 3), (4, 5, 6, 7, 8))))
    ip = F.when(i % 11 == 0, "::1").when(i % 11 == 1, "fd12::1").when(i % 11 == 2, "FE80::1").when(i % 11 == 3, "2001:db8::1").when(i % 11 == 4, F.concat(F.lit("::ffff:"), four)).otherwise(four)
    return Tables(spark, sf_dir).raw("events").select("event_id", ip.alias("ip")).select("event_id", "ip", texts.is_private(F.col("ip")).alias("private"))


_DOTS = "replace(format('{{:,}}', CAST({0} AS BIGINT)), ',', '.')"
_TENTHS = "replace(regexp_replace(printf('%.1f', floor({0} * 10 + 0.5) / 10), '\\.0$', ''), '.', ',')"
_POSTAL = r"CASE WHEN length(upper(regexp_replace({0}, '\s', '', 'g'))) = 6 THEN substr(upper(regexp_replace({0}, '\s', '', 'g')), 1, 4) || ' ' || substr(upper(regexp_replace({0}, '\s', '', 'g')), 5) ELSE upper(regexp_replace({0}, '\s', '', 'g')) END"
_SLUG = r"regexp_replace(regexp_replace(strip_accents(lower({0})), '\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')"
_WRITTEN = f"street || ' ' || CAST(house_number AS VARCHAR) || coalesce(house_number_addition, '') || ', ' || concat_ws(' ', {_POSTAL.format('postal_code')}, city)"
_EURO = "'€' || chr(160) || "
_PLACE = "(ln(greatest(50000, least(2000000, {0}))) - ln(50000)) / (ln(2000000) - ln(50000))"
_AGO = "date_diff('second', created_at, TIMESTAMP '" + AS_OF + "')"
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]*)', 1))"
_LEFT = "(CAST({days} AS BIGINT) * 86400 - " + _AGO + ")"
_WAIT = (
    "CASE WHEN {s} <= 0 THEN 'now' WHEN {s} // 86400 > 0 THEN ({s} // 86400) || CASE WHEN {s} // 86400 = 1 THEN ' day' ELSE ' days' END WHEN {s} % 86400 // 3600 > 0 THEN ({s} % 86400 // 3600) || CASE WHEN {s} % 86400 // 3600 = 1 THEN ' hour' ELSE ' hours' END "
    "ELSE ({s} % 3600 // 60) || CASE WHEN {s} % 3600 // 60 = 1 THEN ' minute' ELSE ' minutes' END END"
)


def _elapsed_sql() -> str:
    arms = [f"WHEN s >= {least} THEN CASE s // {size} WHEN 0 THEN 'nu' WHEN 1 THEN '{last}' WHEN 2 THEN '{before}' ELSE (s // {size}) || ' {many} geleden' END" for least, size, last, before, many in reversed(texts.UNITS)]
    return f"CASE {' '.join(arms)} ELSE 'nu' END"


QUERIES = {f.__name__: f for f in (address_texts, price_texts, karma_texts, time_texts, url_rules, private_hosts)}
ORACLE = {
    "address_texts": with_domain(
        f"SELECT id, {_WRITTEN} AS written, {_POSTAL.format('postal_code')} AS code, '/' || {_SLUG.format('city')} || '/' || coalesce({_SLUG.format('postal_code')}, '') || '/' || {_SLUG.format('street')} || '/' || house_number AS path, "
        f"CASE WHEN postal_code IS NULL THEN 'city' ELSE 'property' END AS view_kind, CASE WHEN length({_WRITTEN}) <= 24 THEN {_WRITTEN} ELSE substr({_WRITTEN}, 1, 21) || '...' END AS short, {_DOTS.format('area')} || ' m²' AS area, id % 7 = 0 AS placeholder, "
        "lat BETWEEN 50.5 AND 53.7 AND lon BETWEEN 3.3 AND 7.3 AS in_country FROM properties", "properties"),
    "price_texts": with_domain(
        f"SELECT l.id, {_EURO}{_DOTS.format('l.asking_price')} AS price, {_EURO}CASE WHEN l.asking_price * 37 < 1000 THEN {_DOTS.format('l.asking_price * 37')} WHEN l.asking_price * 37 < 999950 THEN {_TENTHS.format('(l.asking_price * 37 / 1000)')} || 'K' ELSE {_TENTHS.format('(l.asking_price * 37 / 1000000)')} || chr(160) || 'mln.' END AS compact, "
        f"{_EURO}{_DOTS.format('least(l.asking_price, woz_value)')} || ' - ' || {_EURO}{_DOTS.format('greatest(l.asking_price, woz_value)')} AS price_range, CASE WHEN l.asking_price > woz_value THEN '+' ELSE '' END || printf('%.1f', floor((l.asking_price - woz_value) / woz_value * 1000 + 0.5) / 10) || '%' AS above, "
        f"round({_PLACE.format('l.asking_price')}, 9) AS place, CAST(floor(exp(ln(50000) + round({_PLACE.format('l.asking_price')}, 2) * (ln(2000000) - ln(50000))) / 1000 + 0.5) * 1000 AS BIGINT) AS slider_price, CASE WHEN l.asking_price = woz_value THEN 50.0 ELSE 75.0 END AS bar, "
        f"abs({_PLACE.format('l.asking_price')} - {_PLACE.format('woz_value')}) <= 0.03 AS near FROM listings l JOIN properties p ON p.id = l.property_id WHERE l.asking_price IS NOT NULL AND woz_value > 0", "properties", "listings"),
    "karma_texts": with_domain(
        f"SELECT id, CASE WHEN karma * 37 >= 10000 THEN printf('%.1f', floor(karma * 37 / 100 + 0.5) / 10) || 'K' ELSE {_DOTS.format('karma * 37')} END AS points, CASE WHEN karma * 37 >= 10000 THEN 'Legend' WHEN karma * 37 >= 5000 THEN 'Master' WHEN karma * 37 >= 1000 THEN 'Expert' WHEN karma * 37 >= 250 THEN 'Trusted' "
        "WHEN karma * 37 >= 50 THEN 'Regular' ELSE 'Newbie' END AS standing, CASE WHEN karma >= 500 THEN 'Legend' WHEN karma >= 101 THEN 'Expert' WHEN karma >= 51 THEN 'Trusted' WHEN karma >= 11 THEN 'Regular' ELSE 'Newbie' END AS badge FROM users", "users"),
    "time_texts": with_domain(f"SELECT id, {_elapsed_sql()} AS elapsed, {_WAIT.format(s=_LEFT.format(days=5))} AS wait, {_WAIT.format(s=_LEFT.format(days=30))} AS name_wait FROM (SELECT *, {_AGO} AS s FROM price_guesses)", "price_guesses"),
    "url_rules": f"""WITH h AS (SELECT unnest(['https://www.funda.nl', 'https://notfunda.nl', 'http://funda.nl', 'https://pararius.com', 'https://www.pararius.nl:8443', 'https://funda.nl.example.org', 'https://example.org']) AS head, unnest(range(7)) AS kind),
u AS (SELECT page_id, CAST(kind AS INTEGER) AS kind, head || '/x/' || page_id AS url FROM pages, h UNION ALL SELECT page_id, -1, url FROM pages)
SELECT page_id, kind, CASE WHEN contains({_HOST}, 'funda.nl') THEN 'funda' WHEN contains({_HOST}, 'pararius.nl') OR contains({_HOST}, 'pararius.com') THEN 'pararius' ELSE 'other' END AS by_part,
CASE WHEN {_HOST} = 'funda.nl' OR {_HOST} LIKE '%.funda.nl' THEN 'funda' WHEN {_HOST} = 'pararius.nl' OR {_HOST} LIKE '%.pararius.nl' THEN 'pararius' ELSE 'other' END AS by_domain,
url LIKE 'https://%' AND ({_HOST} IN ('funda.nl', 'pararius.nl') OR {_HOST} LIKE '%.funda.nl' OR {_HOST} LIKE '%.pararius.nl') AS may_be_fetched FROM u""",
    "private_hosts": """WITH e AS (SELECT event_id AS i, [0, 9, 10, 127, 169, 172, 192, 8][event_id % 8 + 1] AS a, [15, 16, 31, 32, 168, 254, 0][event_id % 7 + 1] AS b, [1, 2, 3][event_id % 3 + 1] AS c, [4, 5, 6, 7, 8][event_id % 5 + 1] AS d FROM events)
SELECT i AS event_id, CASE i % 11 WHEN 0 THEN '::1' WHEN 1 THEN 'fd12::1' WHEN 2 THEN 'FE80::1' WHEN 3 THEN '2001:db8::1' WHEN 4 THEN '::ffff:' || a || '.' || b || '.' || c || '.' || d ELSE a || '.' || b || '.' || c || '.' || d END AS ip,
CASE WHEN i % 11 < 3 THEN true WHEN i % 11 = 3 THEN false ELSE a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) END AS private FROM e""",
}
