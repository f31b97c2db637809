"""License scans: texts in a canonical form, looked up by digest among known licences."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal (fixed values): each word on the left is read as the one on the right.
SPELLINGS = {
    "acknowledgement": "acknowledgment", "acknowledgements": "acknowledgments", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization", "authorise": "authorize",
    "authorised": "authorized", "behaviour": "behavior", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog", "categorise": "categorize", "centre": "center",
    "colour": "color", "customised": "customized", "defence": "defense", "emphasised": "emphasized", "favour": "favor", "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "honour": "honor",
    "initialise": "initialize", "initialised": "initialized", "instalment": "installment", "judgement": "judgment", "labelled": "labeled", "labelling": "labeling", "labour": "labor", "licence": "license",
    "licenced": "licensed", "licences": "licenses", "licencing": "licensing", "maximise": "maximize", "merchantibility": "merchantability", "minimise": "minimize", "modelling": "modeling", "modernise": "modernize",
    "noncommercial": "non commercial", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize", "organised": "organized", "per cent": "percent", "practise": "practice",
    "programme": "program", "realise": "realize", "recognise": "recognize", "recognised": "recognized", "signalling": "signaling", "sublicence": "sublicense", "unauthorised": "unauthorized", "utilisation": "utilization",
    "utilise": "utilize", "whilst": "while", "wilful": "willful", "wilfull": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Known licences (fixed values): whole texts, and the notices that stand for them.
KNOWN = (
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("0BSD", "BSD Zero Clause License\n\n" + _ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
)
#: More whole texts, one JSON object (license_id, text) a line.
TEXTS = Path(__file__).with_name("license_texts.jsonl")
#: Known texts that are sent to all tasks; a larger table is joined by shuffling.
SENT_MOST = 50_000

#: Notices of the FSF and of the Regents are part of their licences' texts, whatever line they share (fixed values); so are the gaps to fill in of appendices, which are left out.
_OWNERS = r"copyright\s+(\(c\)|©)\s+([0-9]{4}[,\s-]+)*(free\s+software\s+foundation|the\s+regents\s+of)"
_GAPS = r"copyright\s+(\(c\)\s+)?(\[yyyy\]\s+\[name\s+of\s+copyright\s+owner\]|<year>\s+<[a-z\s]+>|(yyyy|year|(19|20)yy)\s+<?name\s+of\s+author>?)"
#: A line that begins as a notice: the sign, or the word or (c) with the sign or a year right behind.
_COPYRIGHT = r"(^|\n)[^\n\p{L}\p{N}]*(©[^\n]*|(copyright|\(c\))[^\n\p{L}\p{N}]*(\(c\)[^\n\p{L}\p{N}]*)?(©|[0-9]{4})[^\n]*|copyright\s*\(c\)[^\n]*)"
_OTHER = r"[^\p{L}\p{N}]+"
_OTHER_IN_LINE = r"[^\p{L}\p{N}\n]+"


def canonical_lines(text: Column) -> Column:
    """The text's lines in lower case, those of copyright empty, each run of other than letters and digits as one blank, and equivalent spellings alike; ends may be blank."""
    told = F.regexp_replace(F.regexp_replace(F.lower(text), _OWNERS, "owner"), _GAPS, " ")
    plain = F.regexp_replace(F.regexp_replace(told, _COPYRIGHT, "$1"), _OTHER_IN_LINE, " ")
    alike = plain
    for word, same in SPELLINGS.items():
        alike = F.regexp_replace(alike, rf"\b{word}\b", same)
    return F.split(F.when(plain.rlike(rf"\b({'|'.join(SPELLINGS)})\b"), alike).otherwise(plain), "\n")


def digest(lines: Column) -> Column:
    """SHA-256 of the canonical form that these lines make, null if that is empty."""
    form = F.array_join(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != ""), " ")
    return F.when(form != "", F.sha2(form, 256))


def known_digests(known: DataFrame, license_col: str = "license_id", text_col: str = "text") -> DataFrame:
    """(digest, license_id): one row for each distinct canonical text, with the first license id in order."""
    return known.select(digest(canonical_lines(F.col(text_col))).alias("digest"), F.col(license_col).alias("license_id")).where("digest is not null").groupBy("digest").agg(F.min("license_id").alias("license_id"))


def default_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text): KNOWN and the rows of TEXTS."""
    rows = [json.loads(x) for x in TEXTS.read_text(encoding="utf-8").splitlines()]
    known = [*KNOWN, *((r["license_id"], r["text"]) for r in rows)]
    pairs = F.array(*(F.struct(F.lit(k).alias("license_id"), F.lit(t).alias("text")) for k, t in known))
    return spark.range(1).select(F.inline(pairs))


def license_scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, unit, line int, digest, license_id): for each row of df one row of unit 'text', line 0, with the whole text's digest and the licence known by it, if any; and one row of unit 'line' for each line (numbered from 1) that is as a whole a known text.

    Texts that are null, empty or without a letter or digit have a null digest; texts of any length are digested whole. Known texts default to KNOWN and those of TEXTS; up to SENT_MOST of them are sent to all tasks. Repeated rows stay; an empty table gives an empty one.
    """
    digests = known_digests(default_licenses(df.sparkSession) if known is None else known)
    if len(digests.take(SENT_MOST + 1)) <= SENT_MOST:
        digests = F.broadcast(digests)
    rows = df.select(F.col(id_col).alias("id"), canonical_lines(F.col(text_col).cast("string")).alias("lines"))
    unit = F.struct(F.lit("text").alias("unit"), F.lit(0).alias("line"), digest(F.col("lines")).alias("digest"))
    by_line = F.transform("lines", lambda x, k: F.struct(F.lit("line").alias("unit"), (k + 1).alias("line"), digest(F.array(x)).alias("digest")))
    units = rows.select("id", F.inline(F.concat(F.array(unit), F.coalesce(F.filter(by_line, lambda x: x["digest"].isNotNull()), F.array().cast("array<struct<unit: string, line: int, digest: string>>")))))
    found = units.join(digests, "digest", "left").where("unit = 'text' or license_id is not null")
    return found.select(F.col("id").alias(id_col), "unit", "line", "digest", "license_id")


def _canonical_sql(text: str) -> str:
    told = f"regexp_replace(regexp_replace(lower({text}), '{_OWNERS}', 'owner', 'g'), '{_GAPS}', ' ', 'g')"
    plain = f"trim(regexp_replace(regexp_replace({told}, '{_COPYRIGHT}', chr(10), 'g'), '{_OTHER}', ' ', 'g'))"
    for word, same in SPELLINGS.items():
        plain = f"regexp_replace({plain}, '\\b{word}\\b', '{same}', 'g')"
    return plain


def _digest_sql(text: str) -> str:
    return f"CASE WHEN {_canonical_sql(text)} <> '' THEN sha256({_canonical_sql(text)}) END"


def oracle_sql() -> str:
    """The same over `documents`, for DuckDB."""
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in KNOWN)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (SELECT {_digest_sql("t.text")} AS digest, license_id FROM (VALUES {values}) t(license_id, text)) WHERE digest IS NOT NULL GROUP BY digest),
parts AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS content, unnest(range(1, len(parts) + 1)) AS line FROM parts),
found AS (SELECT doc_id, 'text' AS unit, CAST(0 AS INTEGER) AS line, {_digest_sql("text")} AS digest FROM documents)
SELECT f.doc_id, f.unit, f.line, f.digest, k.license_id FROM found f LEFT JOIN known k USING (digest)
UNION ALL
SELECT l.doc_id, 'line', CAST(l.line AS INTEGER), l.digest, k.license_id
FROM (SELECT doc_id, line, {_digest_sql("content")} AS digest FROM lines WHERE content <> '') l JOIN known k USING (digest)
"""
