"""The tables of the domain (properties, users, listings, guesses, comments, ...) as selections from the star-schema tables of a folder.

Each selection is SQL that Spark and other engines read alike, so that results can be held against another engine's. All times are moved onto one clock that ends at AS_OF.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: "Now" for every query; no query reads the wall clock.
AS_OF = "2024-01-31 00:00:00"
#: Days between the clock of orders and that of events.
SHIFT = 8217

DOMAIN: dict[str, str] = {
    "properties": """
SELECT p_partkey AS id, concat('R', lpad(CAST(p_partkey AS STRING), 9, '0')) AS register_id, p_name AS street, CAST(p_size AS INT) AS house_number,
  CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'BIS' WHEN 2 THEN '1' WHEN 3 THEN '' END AS house_number_addition,
  p_type AS city,
  CASE WHEN p_partkey % 23 = 7 THEN NULL ELSE concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey * 7 % 26 AS INT))) END AS postal_code,
  CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE CAST(3500 + p_partkey * 37 % 3700 AS DOUBLE) / 1000 END AS lon,
  CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE CAST(50750 + p_partkey * 91 % 2800 AS DOUBLE) / 1000 END AS lat,
  CAST(1900 + p_partkey % 120 AS INT) AS built, CAST(40 + p_partkey % 200 AS INT) AS area,
  CASE WHEN p_partkey % 29 = 5 THEN 'inactive' WHEN p_partkey % 31 = 6 THEN 'demolished' ELSE 'active' END AS status,
  CASE WHEN p_partkey % 19 = 4 THEN NULL ELSE CAST(floor(p_retailprice * 25) AS BIGINT) END AS woz_value,
  CAST(CAST('2020-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' DAY * CAST(p_partkey % 400 AS INT) AS TIMESTAMP) AS created_at
FROM {part}""",
    "users": """
SELECT c_custkey AS id, c_name AS username, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat(c_name, ' X') END AS display_name,
  CAST(greatest(0, floor(c_acctbal / 20)) AS INT) AS karma, CAST(floor(c_acctbal / 20) AS INT) AS internal_karma
FROM {customer}""",
    "listings": f"""
SELECT l_orderkey AS id, min(l_partkey) AS property_id, concat('https://www.funda.nl/koop/', CAST(l_orderkey AS STRING)) AS source_url,
  CASE l_orderkey % 3 WHEN 0 THEN 'funda' WHEN 1 THEN 'pararius' ELSE 'other' END AS source_name,
  CASE WHEN l_orderkey % 40 = 0 THEN NULL ELSE CAST(floor(max(l_extendedprice)) AS BIGINT) END AS asking_price,
  CASE max(l_returnflag) WHEN 'N' THEN 'active' WHEN 'A' THEN 'sold' ELSE CASE WHEN l_orderkey % 8 = 0 THEN 'rented' ELSE 'withdrawn' END END AS status,
  CASE WHEN l_orderkey % 20 = 0 THEN NULL ELSE concat('m', CAST(l_orderkey AS STRING)) END AS mirror_id,
  CASE WHEN l_orderkey % 12 = 0 THEN 'rent' ELSE 'sale' END AS price_type,
  CAST(max(l_shipdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS created_at,
  CAST(max(l_shipdate) + INTERVAL '{SHIFT + 1}' DAY AS TIMESTAMP) AS mirror_last_changed_at
FROM {{lineitem}} GROUP BY l_orderkey""",
    "price_guesses": f"""
SELECT min(l_orderkey) * 100000 + p_partkey AS id, p_partkey AS property_id, o_custkey AS user_id, CAST(floor(min(l_extendedprice)) AS BIGINT) AS guessed_price,
  CAST(min(o_orderdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS created_at,
  CASE WHEN min(l_extendedprice) < 0.2 * 25 * min(p_retailprice) OR min(l_extendedprice) > 5.0 * 25 * min(p_retailprice) THEN true ELSE false END AS is_meme_guess
FROM {{lineitem}} JOIN {{orders}} ON o_orderkey = l_orderkey JOIN {{part}} ON p_partkey = l_partkey - l_partkey % 40 + o_orderkey % (1 + l_partkey % 40)
GROUP BY p_partkey, o_custkey""",
    "price_history": f"""
SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_partkey AS property_id, CAST(floor(l_extendedprice) AS BIGINT) AS price,
  CAST(l_shipdate + INTERVAL '{SHIFT}' DAY AS DATE) AS price_date, CASE WHEN l_linestatus = 'F' AND l_orderkey % 9 = 0 THEN 'sold' ELSE 'asking_price' END AS event_type
FROM {{lineitem}}""",
    "comments": """
SELECT conv_id * 1000 + turn AS id, (conv_id * 131 + (CASE WHEN role = 'assistant' THEN turn - 1 ELSE turn END) * 17) % 200 AS property_id,
  (conv_id * 7 + turn) % 150 AS user_id, CASE WHEN role = 'assistant' THEN conv_id * 1000 + turn - 1 END AS parent_id, text AS content,
  CAST(CAST('2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * CAST((conv_id * 37 + turn * 5) % 720 AS INT) AS TIMESTAMP) AS created_at
FROM {conversations}""",
    "property_views": """
SELECT event_id AS id, event_id % 50 AS property_id, CASE WHEN event_id % 3 = 0 THEN user_id % 10 END AS user_id,
  CASE WHEN event_id % 3 = 1 OR event_id % 6 = 0 THEN concat('s', CAST(user_id % 10 AS STRING)) END AS session_id, CAST(ts AS TIMESTAMP) AS viewed_at
FROM {events} WHERE event_type IN ('view', 'purchase', 'signup')""",
    "reactions": """
SELECT min(event_id) AS id, CASE WHEN event_id % 4 = 0 THEN 'comment' ELSE 'property' END AS target_type,
  CASE WHEN event_id % 4 = 0 THEN (event_id % 100) * 1000 + event_id % 3 ELSE event_id % 150 END AS target_id, user_id, 'like' AS reaction_type, CAST(min(ts) AS TIMESTAMP) AS created_at
FROM {events} WHERE event_type = 'click' GROUP BY 2, 3, 4""",
    "saved_properties": """
SELECT min(event_id) AS id, event_id % 100 AS property_id, user_id, CAST(min(ts) AS TIMESTAMP) AS created_at
FROM {events} WHERE event_type = 'purchase' GROUP BY 2, 3""",
    "register_rows": """
SELECT concat('R', lpad(CAST(p_partkey * 2 AS STRING), 9, '0')) AS identification, concat('POINT (', CAST(3 + p_partkey % 4 AS STRING), '.', lpad(CAST(p_partkey * 37 % 1000 AS STRING), 3, '0'), ' 5', CAST(1 + p_partkey % 3 AS STRING), '.', lpad(CAST(p_partkey * 91 % 1000 AS STRING), 3, '0'), ')') AS geom,
  CAST(40 + p_partkey % 90 AS STRING) AS area, CAST(1950 + p_partkey % 70 AS STRING) AS built,
  CASE p_partkey % 4 WHEN 0 THEN 'Verblijfsobject in gebruik' WHEN 1 THEN 'Verblijfsobject ingetrokken' WHEN 2 THEN 'Verblijfsobject buiten gebruik' ELSE 'Pand gesloopt' END AS status,
  p_name AS street, CAST(p_size AS STRING) AS house_number, CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'bis' ELSE '' END AS letter, CASE p_partkey % 5 WHEN 2 THEN '1' ELSE '' END AS suffix,
  CASE WHEN p_partkey % 37 = 1 THEN '' ELSE lower(concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), ' ', chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey * 7 % 26 AS INT)))) END AS postal_code,
  lower(p_type) AS city
FROM {part}
UNION ALL
SELECT concat('R', lpad(CAST(p_partkey * 2 + 1 AS STRING), 9, '0')), CASE WHEN p_partkey % 41 = 0 THEN '' ELSE concat('POINT(4.', CAST(100 + p_partkey % 900 AS STRING), ' 52.2)') END, '77', '1999', 'Verblijfsobject in gebruik', p_name, CAST(p_size AS STRING), 'A', '',
  concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey * 7 % 26 AS INT))), 'X'
FROM {part}""",
    "raw_addresses": """
SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('  ', p_name, chr(9)) ELSE replace(p_name, ' ', concat(' ', chr(10), ' ')) END AS street,
  CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN concat('nr ', CAST(p_size AS STRING)) WHEN 2 THEN concat(' ', CAST(p_size AS STRING), ' -bis ') WHEN 3 THEN concat(CAST(p_size AS STRING), 'a') WHEN 4 THEN concat('-', CAST(p_size AS STRING)) WHEN 5 THEN concat(CAST(p_size AS STRING), ' / 2') WHEN 6 THEN NULL ELSE CAST(p_size AS STRING) END AS house_number,
  CASE p_partkey % 4 WHEN 0 THEN 'c' WHEN 1 THEN '' WHEN 2 THEN ' d ' END AS house_number_addition,
  CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN '12 ab' WHEN 2 THEN NULL ELSE lower(concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), chr(9), ' ', chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey * 7 % 26 AS INT)))) END AS postal_code,
  concat(' ', p_type, '  ') AS city
FROM {part}""",
    "incoming": """
SELECT l_orderkey * 10 + l_linenumber AS row_id, min(l_partkey) AS near_key, concat('m', CAST(l_orderkey - l_orderkey % 4 AS STRING)) AS mirror_id,
  CASE (l_orderkey - l_orderkey % 4) % 3 WHEN 0 THEN 'funda' WHEN 1 THEN 'pararius' ELSE 'other' END AS source_name,
  concat('HTTPS://WWW.Funda.nl/koop/', CAST(l_orderkey AS STRING), '/?utm=', CAST(l_linenumber AS STRING)) AS source_url,
  CAST(floor(max(l_extendedprice)) AS BIGINT) AS asking_price,
  CASE WHEN min(l_partkey) % 11 = 0 THEN 'bad' ELSE lower(concat(CAST(1000 + min(l_partkey) * 7 % 9000 AS STRING), ' ', chr(CAST(65 + min(l_partkey) % 26 AS INT)), chr(CAST(65 + min(l_partkey) * 7 % 26 AS INT)))) END AS postal_code,
  concat(CAST(min(p_size) AS STRING), CASE min(l_partkey) % 5 WHEN 0 THEN 'a' WHEN 1 THEN '-bis' WHEN 2 THEN '/1' ELSE '' END) AS house_number,
  CASE WHEN min(l_partkey) % 7 = 0 THEN NULL ELSE CAST(3500 + min(l_partkey) * 37 % 3700 AS DOUBLE) / 1000 + 0.0004 END AS lon,
  CASE WHEN min(l_partkey) % 7 = 0 THEN NULL ELSE CAST(50750 + min(l_partkey) * 91 % 2800 AS DOUBLE) / 1000 END AS lat
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber""",
    "requests": f"""
SELECT CAST(l_linenumber AS BIGINT) * 1000000000 + l_orderkey AS row_id, min(l_partkey) AS near_key, concat('m', CAST(l_orderkey - CASE WHEN l_orderkey % 1499 = 7 THEN 1 ELSE 0 END AS STRING)) AS mirror_id,
  CASE (l_orderkey - CASE WHEN l_orderkey % 1499 = 7 THEN 1 ELSE 0 END) % 3 WHEN 0 THEN 'funda' WHEN 1 THEN 'pararius' ELSE 'other' END AS source_name,
  concat('HTTPS://WWW.Funda.nl/', CASE WHEN l_linenumber = 1 AND l_orderkey % 1301 = 5 THEN 'koop/' ELSE 'mirror/' END,
    CAST(CASE WHEN l_linenumber = 1 AND l_orderkey % 1301 = 5 THEN l_orderkey + 1 WHEN l_linenumber = 2 AND l_orderkey % 1201 = 11 OR l_linenumber = 4 AND l_orderkey % 355 = 1 THEN l_orderkey - 1 ELSE l_orderkey END AS STRING),
    CASE WHEN l_linenumber >= 3 AND l_orderkey % 5 = 0 THEN '/new' ELSE '' END, '/?utm=', CAST(l_linenumber AS STRING)) AS source_url,
  CAST(floor(max(l_extendedprice)) AS BIGINT) AS asking_price, CASE WHEN l_orderkey % 12 = 0 THEN 'rent' ELSE 'sale' END AS price_type,
  CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE CAST(30 + l_orderkey % 150 + l_linenumber AS INT) END AS area, CAST(1 + l_orderkey % 7 AS INT) AS rooms, CASE WHEN l_orderkey % 8 = 0 THEN NULL ELSE chr(CAST(65 + (l_orderkey + l_linenumber) % 7 AS INT)) END AS energy_label,
  CASE WHEN l_orderkey % 4 = 0 THEN NULL ELSE concat('https://img.example/', CAST(l_orderkey AS STRING), '/', CAST(l_linenumber AS STRING), '.jpg') END AS thumbnail_url, min(p_name) AS og_title,
  CASE max(l_returnflag) WHEN 'N' THEN 'active' WHEN 'A' THEN 'sold' ELSE 'withdrawn' END AS status,
  CAST(max(l_shipdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS first_seen_at, CAST(max(l_shipdate) + INTERVAL '{SHIFT + 2}' DAY AS TIMESTAMP) AS last_changed_at, CAST(max(l_shipdate) + INTERVAL '{SHIFT + 3}' DAY AS TIMESTAMP) AS last_seen_at,
  CASE WHEN min(l_partkey) % 61 = 0 THEN 'bad' ELSE lower(concat(CAST(1000 + min(l_partkey) * 7 % 9000 AS STRING), ' ', chr(CAST(65 + min(l_partkey) % 26 AS INT)), chr(CAST(65 + min(l_partkey) * 7 % 26 AS INT)))) END AS postal_code,
  concat(CAST(min(p_size) AS STRING), CASE min(l_partkey) % 5 WHEN 0 THEN 'a' WHEN 1 THEN '-bis' WHEN 2 THEN '/1' ELSE '' END) AS house_number,
  CASE WHEN min(l_partkey) % 7 = 0 THEN NULL ELSE CAST(3500 + min(l_partkey) * 37 % 3700 AS DOUBLE) / 1000 + 0.0004 END AS lon,
  CASE WHEN min(l_partkey) % 7 = 0 THEN NULL ELSE CAST(50750 + min(l_partkey) * 91 % 2800 AS DOUBLE) / 1000 END AS lat
FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey GROUP BY l_orderkey, l_linenumber""",
    "held_listings": f"""
SELECT min(l_partkey) AS property_id, concat('https://www.funda.nl/koop/', CAST(l_orderkey AS STRING)) AS source_url, CASE l_orderkey % 3 WHEN 0 THEN 'funda' WHEN 1 THEN 'pararius' ELSE 'other' END AS source_name,
  CASE WHEN l_orderkey % 20 = 0 THEN NULL WHEN l_orderkey % 3 = 0 THEN concat('old', CAST(l_orderkey AS STRING)) ELSE concat('m', CAST(l_orderkey AS STRING)) END AS mirror_id, CAST(floor(min(l_extendedprice)) AS BIGINT) AS asking_price,
  CASE WHEN l_orderkey % 12 = 0 THEN 'rent' ELSE 'sale' END AS price_type, CAST(NULL AS INT) AS area, CAST(NULL AS INT) AS rooms, CAST(NULL AS STRING) AS energy_label, CAST(NULL AS STRING) AS thumbnail_url, CAST('as it was' AS STRING) AS og_title, 'active' AS status,
  CAST(min(l_shipdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS first_seen_at, CAST(min(l_shipdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS last_changed_at, CAST(min(l_shipdate) + INTERVAL '{SHIFT}' DAY AS TIMESTAMP) AS last_seen_at
FROM {{lineitem}} GROUP BY l_orderkey""",
    "accounts": """
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('g', CAST(c_custkey AS STRING)) END AS google_id, concat('u', CAST(c_custkey AS STRING), '@example.com') AS email, c_name AS username
FROM {customer}""",
    "logins": """
SELECT event_id AS id, CASE event_id % 4 WHEN 3 THEN concat('new', CAST(event_id AS STRING)) ELSE concat('g', CAST(user_id % 200 AS STRING)) END AS google_id,
  concat('u', CAST(CASE event_id % 5 WHEN 0 THEN user_id % 200 WHEN 1 THEN (user_id + 1) % 200 WHEN 2 THEN user_id * 7 % 400 ELSE user_id % 200 END AS STRING), CASE event_id % 5 WHEN 4 THEN '@example.org' ELSE '@example.com' END) AS email
FROM {events}""",
    "address_searches": """
SELECT event_id AS id, CASE event_id % 8
    WHEN 0 THEN concat('postcode:', postal_code, ', huisnummer:', CAST(house_number AS STRING)) WHEN 1 THEN upper(concat(street, ' ', CAST(house_number AS STRING))) WHEN 2 THEN concat('Find ', street, ' ', CAST(house_number AS STRING), ' ', postal_code, ' ', city, ', please')
    WHEN 3 THEN substr(concat(street, CAST(house_number AS STRING), postal_code), 3, 9) WHEN 4 THEN concat(postal_code, ' ', city) WHEN 5 THEN substr(city, 1, 2) WHEN 6 THEN concat('nowhere ', CAST(event_id % 50 AS STRING)) ELSE concat('postcode:', postal_code, ', huisnummer:9999') END AS search
FROM {events} JOIN (SELECT p_partkey AS key, p_name AS street, CAST(p_size AS INT) AS house_number, p_type AS city, concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), chr(CAST(65 + p_partkey % 26 AS INT)), chr(CAST(65 + p_partkey * 7 % 26 AS INT))) AS postal_code FROM {part}) AS places ON key = event_id % 190""",
    "preview_pages": """
SELECT page_id, property_id, concat(CASE WHEN page_id % 9 = 8 THEN 'http' ELSE 'https' END, '://www.', CASE page_id % 5 WHEN 0 THEN 'funda.nl' WHEN 1 THEN 'pararius.com' WHEN 2 THEN 'pararius.nl' WHEN 3 THEN 'Funda.nl' ELSE 'example.com' END, '/koop/', CAST(page_id AS STRING), '/?ref=1') AS url,
  replace(html, '</title>', concat('</title>', CASE page_id % 7
    WHEN 0 THEN concat('<meta property="og:title" content="Te koop: ', street, ' ', CAST(house_number AS STRING), '"/><meta property="og:image" content="https://img.example/', CAST(page_id AS STRING), '.jpg">')
    WHEN 1 THEN concat('<META content=', chr(39), upper(street), ' huis', chr(39), ' data-x=1 name=', chr(39), 'og:title', chr(39), '><meta name="og:description" content="So, a house">')
    WHEN 2 THEN concat('<meta name="og:title" content="Huis nummer ', CAST(house_number AS STRING), '">') WHEN 3 THEN '<meta property="og:title" content="Something else 99999">'
    WHEN 4 THEN '<meta property="og:title" content=""><meta property="og:image" content="">' WHEN 5 THEN concat('<meta property="og:title" content="', street, ' 9', CAST(house_number AS STRING), '9">') ELSE '<meta name="description" content="none of these">' END)) AS html
FROM {pages} JOIN (SELECT p_partkey AS property_id, p_name AS street, CAST(p_size AS INT) AS house_number FROM {part}) AS places ON property_id = page_id % 190""",
    "mirror_rows": """
SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 'rent' WHEN p_partkey % 6 = 1 THEN NULL ELSE 'sale' END AS price_type,
  CASE WHEN p_partkey % 13 = 2 THEN 'n/a' WHEN p_partkey % 13 = 3 THEN NULL ELSE CAST(CAST(floor(p_retailprice * 25000) AS BIGINT) + p_partkey % 100 AS STRING) END AS asking_price_cents,
  CASE p_partkey % 6 WHEN 0 THEN 'Available' WHEN 1 THEN 'SOLD' WHEN 2 THEN 'rented' WHEN 3 THEN 'withdrawn' WHEN 4 THEN 'under offer' ELSE 'available' END AS status,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE concat('https://img.example/', CAST(p_partkey AS STRING), '/1.jpg,https://img.example/', CAST(p_partkey AS STRING), '/2.jpg') END AS photo_urls,
  p_name AS street, CASE p_partkey % 3 WHEN 0 THEN concat(CAST(p_size AS STRING), CASE p_partkey % 5 WHEN 0 THEN 'a' WHEN 1 THEN '-bis' WHEN 2 THEN ' 1' ELSE '' END) ELSE CAST(p_size AS STRING) END AS house_number,
  CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 'a' WHEN p_partkey % 5 = 1 THEN 'bis' WHEN p_partkey % 5 = 2 THEN '1' ELSE '' END AS house_number_addition,
  CASE WHEN p_partkey % 10 = 9 THEN '9999 zz' ELSE concat(CAST(1000 + p_partkey * 7 % 9000 AS STRING), ' ', lower(chr(CAST(65 + p_partkey % 26 AS INT))), chr(CAST(65 + p_partkey * 7 % 26 AS INT))) END AS postal_code, p_type AS city,
  CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE CAST(3500 + p_partkey * 37 % 3700 AS DOUBLE) / 1000 + 0.0004 END AS lon, CASE WHEN p_partkey % 17 = 3 THEN NULL ELSE CAST(50750 + p_partkey * 91 % 2800 AS DOUBLE) / 1000 + 0.0004 END AS lat
FROM {part}""",
    "guess_submissions": """
SELECT event_id AS id, CASE WHEN event_id % 13 = 0 THEN -1 ELSE event_id % 7 END AS property_id, user_id % 10 AS user_id, 20000 + event_id % 97 * 1000 AS guessed_price, CAST(ts AS TIMESTAMP) AS submitted_at
FROM {events}""",
    "toggles": """
SELECT event_id AS id, CASE WHEN event_type IN ('view', 'click') THEN 'like' ELSE 'save' END AS kind, CASE WHEN event_type IN ('click', 'error') OR event_id % 7 < 3 THEN 'on' ELSE 'off' END AS action,
  event_id % 37 AS property_id, user_id % 10 AS user_id, CAST(ts AS TIMESTAMP) AS made_at
FROM {events}""",
    "comment_submissions": """
SELECT conv_id * 1000 + turn + 500 AS id, CASE WHEN conv_id % 19 = 4 THEN -1 ELSE (conv_id * 131 + turn * 17) % 200 END AS property_id, (conv_id * 7 + turn) % 150 AS user_id,
  CASE turn % 4 WHEN 0 THEN NULL WHEN 1 THEN conv_id * 1000 + turn WHEN 2 THEN conv_id * 1000 + turn - 1 ELSE conv_id * 1000 + turn + 400 END AS parent_id, text AS content
FROM {conversations}""",
}
RAW = ("part", "customer", "lineitem", "orders", "conversations", "events", "pages")


class Tables:
    """The domain's tables over a folder, built when first asked for, never run here."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in DOMAIN:
            raise AttributeError(name)
        if name not in self._made:
            sql = DOMAIN[name]
            self._made[name] = self.spark.sql(sql, **{t: self.raw(t) for t in set(re.findall(r"\{(\w+)\}", sql))})
        return self._made[name]


def with_domain(body: str, *names: str) -> str:
    """SQL over the raw tables in which these tables of the domain can be named."""
    parts = [f"{n} AS ({DOMAIN[n].format(**{t: t for t in RAW})})" for n in names]
    body = body.lstrip()
    for begin, head in (("RECURSIVE ", "WITH RECURSIVE "), ("WITH ", "WITH ")):
        if body.startswith(begin):
            return head + ",\n".join([*parts, body.removeprefix(begin)])
    return "WITH " + ",\n".join(parts) + "\n" + body
