"""A request of listings taken in: matched, upserted in chunks, counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gevel.functions.scoring import iso
from gevel.operators.chunks import after_chunks, chunk_fates
from gevel.operators.kept import kept, numbered
from gevel.plans.ingest import _MATCH, matched
from gevel.sources.domain import Tables, with_domain

#: Rows that are written in one statement, and so fail together.
CHUNK = 500
KEYS = ["source_name", "mirror_id"]
#: What a listing that is known already takes over from a request.
OVERWRITE = ["asking_price", "price_type", "area", "rooms", "energy_label", "thumbnail_url", "og_title", "status", "source_url", "last_changed_at", "last_seen_at"]
ONCE = ["property_id", "first_seen_at"]


def fates(t: Tables, columns: Sequence[str] = (*OVERWRITE, *ONCE), rows: DataFrame | None = None) -> DataFrame:
    """The matched rows of the request, with these of their columns, and their chunks and outcomes."""
    if rows is None:
        carry = [c for c in columns if c not in ("source_url", "asking_price", "property_id")]
        rows = matched(t, t.requests, carry)
    rows = rows.where("how in ('address', 'position')").select("row_id", *KEYS, *columns)
    return chunk_fates(t.held_listings, numbered(rows, "place", F.asc("row_id")), KEYS, "source_url", CHUNK)


def ingest_fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each matched row of the request: its chunk, its property and what became of it."""
    return fates(Tables(spark, sf_dir), ["source_url", "property_id"]).select("row_id", "chunk", "property_id", "source_url", "outcome")


def ingest_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listings after the request, all columns; which of them it has inserted or updated."""
    t = Tables(spark, sf_dir)
    requests = kept(t.requests, "requests")
    slim = ["source_url", *ONCE]
    out = after_chunks(t.held_listings, fates(t, slim, matched(t, requests, ["first_seen_at"])), KEYS, OVERWRITE, wide=requests)
    times = ("first_seen_at", "last_changed_at", "last_seen_at")
    return out.select(*KEYS, *(iso(F.col(c)).alias(c) if c in times else c for c in (*OVERWRITE, *ONCE)), "outcome")


def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the request is answered with: rows ingested, updated and skipped, and errors. A row whose address can't be read is an error and skipped; one whose chunk failed is an error only."""
    t = Tables(spark, sf_dir)
    rows = kept(matched(t, t.requests).select("row_id", *KEYS, "source_url", "how"), "matched")
    rest = rows.where("how in ('error', 'skipped')").select(F.col("how").alias("outcome"))
    each = fates(t, ["source_url"], rows).select(F.when(F.col("outcome") == "error", "chunk").otherwise(F.col("outcome")).alias("outcome")).unionByName(rest)
    count = lambda *kinds: F.count_if(F.col("outcome").isin(*kinds))
    return each.agg(count("inserted").alias("ingested"), count("updated").alias("updated"), count("skipped", "error").alias("skipped"), count("error", "chunk").alias("errors"))


_W = f"""RECURSIVE {_MATCH.removeprefix("WITH ").replace("FROM incoming", "FROM requests")},
q AS (SELECT (row_number() OVER (ORDER BY m.row_id)) - 1 AS place, m.row_id, m.property_id, m.source_url, r.* EXCLUDE (row_id, source_url, near_key, postal_code, house_number, lon, lat) FROM m JOIN requests r USING (row_id) WHERE how IN ('address', 'position')),
w AS (SELECT *, place // {CHUNK} AS chunk FROM q),
held AS (SELECT source_name, mirror_id, source_url, -1 AS chunk, -1 AS place FROM held_listings UNION ALL SELECT source_name, mirror_id, source_url, chunk, place FROM w),
doomed AS (SELECT chunk FROM (SELECT chunk FROM w GROUP BY chunk, source_name, mirror_id HAVING count(*) > 1 UNION SELECT chunk FROM w GROUP BY chunk, source_url HAVING count(*) > 1)),
pairs AS (SELECT row_number() OVER () AS pair, w.chunk, w.place, h.chunk AS since, h.place AS at, h.source_name, h.mirror_id FROM w JOIN held h ON h.source_url = w.source_url AND h.chunk < w.chunk AND (h.mirror_id IS NULL OR h.source_name <> w.source_name OR h.mirror_id <> w.mirror_id)),
moves AS (SELECT p.pair, b.chunk FROM pairs p JOIN w b ON b.source_name = p.source_name AND b.mirror_id = p.mirror_id AND b.place > p.at AND (b.chunk < p.chunk OR b.chunk = p.chunk AND b.place < p.place)),
f AS (SELECT CAST(-1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS failed
UNION ALL SELECT k + 1, CASE WHEN k + 1 IN (SELECT chunk FROM doomed) OR EXISTS (SELECT 1 FROM pairs p WHERE p.chunk = f.k + 1 AND NOT list_contains(f.failed, p.since) AND NOT EXISTS (SELECT 1 FROM moves b WHERE b.pair = p.pair AND (b.chunk = p.chunk OR NOT list_contains(f.failed, b.chunk)))) THEN list_append(failed, k + 1) ELSE failed END FROM f WHERE k + 1 <= (SELECT max(chunk) FROM w)),
bad AS (SELECT unnest(failed) AS chunk FROM (SELECT failed FROM f ORDER BY k DESC LIMIT 1)),
good AS (SELECT * FROM w WHERE chunk NOT IN (SELECT chunk FROM bad)),
fate AS (SELECT w.*, CASE WHEN w.chunk IN (SELECT chunk FROM bad) THEN 'error' WHEN EXISTS (SELECT 1 FROM held h WHERE h.source_name = w.source_name AND h.mirror_id = w.mirror_id AND h.place < w.place AND h.chunk NOT IN (SELECT chunk FROM bad)) THEN 'updated' ELSE 'inserted' END AS outcome FROM w) """


def _last(c: str) -> str:
    shown = f"strftime({{}}, '%Y-%m-%dT%H:%M:%SZ') AS {c}" if c.endswith("_at") else f"{{}} AS {c}"
    return shown.format(f"CASE WHEN l.place IS NOT NULL THEN l.{c} ELSE t.{c} END" if c in OVERWRITE else f"CASE WHEN t.source_url IS NOT NULL THEN t.{c} ELSE one.{c} END")


QUERIES = {f.__name__: f for f in (ingest_fates, ingest_upsert, ingest_counters)}
ORACLE = {
    "ingest_fates": with_domain(_W + "SELECT row_id, chunk, property_id, source_url, outcome FROM fate", "properties", "requests", "held_listings"),
    "ingest_upsert": with_domain(
        _W + ", l AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY source_name, mirror_id ORDER BY place DESC) = 1), one AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY source_name, mirror_id ORDER BY place) = 1) "
        f"SELECT coalesce(t.source_name, l.source_name) AS source_name, coalesce(t.mirror_id, l.mirror_id) AS mirror_id, {', '.join(map(_last, (*OVERWRITE, *ONCE)))}, CASE WHEN l.place IS NULL THEN 'kept' WHEN t.source_url IS NULL THEN 'inserted' ELSE 'updated' END AS outcome "
        "FROM held_listings t FULL JOIN l ON l.source_name = t.source_name AND l.mirror_id = t.mirror_id LEFT JOIN one ON one.source_name = l.source_name AND one.mirror_id = l.mirror_id", "properties", "requests", "held_listings"),
    "ingest_counters": with_domain(
        _W + "SELECT (SELECT count(*) FROM fate WHERE outcome = 'inserted') AS ingested, (SELECT count(*) FROM fate WHERE outcome = 'updated') AS updated, (SELECT count(*) FROM m WHERE how IN ('skipped', 'error')) AS skipped, "
        "(SELECT count(*) FROM fate WHERE outcome = 'error') + (SELECT count(*) FROM m WHERE how = 'error') AS errors", "properties", "requests", "held_listings"),
}
