"""Addresses, URLs and titles as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def collapsed(x: Column) -> Column:
    """White space as single blanks, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))


def addition(x: Column) -> Column:
    """A house number's addition in upper case, null if empty."""
    return F.nullif(F.upper(F.trim(x)), F.lit(""))


def house_number(x: Column) -> Column:
    """The number at the front of a house number such as 13-bis; null if there is none."""
    return F.regexp_extract(F.trim(x.cast("string")), r"^(\d+)\s*[-/]?\s*(.*)$", 1).try_cast("int")


def house_suffix(x: Column) -> Column:
    """What follows the number, as an addition."""
    return addition(F.regexp_extract(F.trim(x.cast("string")), r"^(\d+)\s*[-/]?\s*(.*)$", 2))


def postal_code(x: Column) -> Column:
    """A Dutch postal code without blanks in upper case, null if it isn't one."""
    bare = F.upper(F.regexp_replace(x, r"\s+", ""))
    return F.when(bare.rlike(r"^\d{4}[A-Z]{2}$"), bare)


def number_fault(x: Column) -> Column:
    """What is wrong with a house number as text; null if nothing is. Null counts as empty, digits beyond 32 bits as no number."""
    bare = F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")
    named = lambda what: F.concat(F.lit('Invalid house number: "'), bare, F.lit(f'" {what}'))
    return (
        F.when(bare == "", "Invalid house number: received empty string")
        .when(~bare.rlike(r"^\d"), named("does not start with a digit"))
        .when(house_number(bare).isNull(), named("is out of range"))
    )


def whole_number_fault(x: Column) -> Column:
    """What is wrong with a house number as a number: it must be whole and not negative."""
    ok = F.coalesce((x >= 0) & (x == F.floor(x)), F.lit(False))
    return F.when(~ok, F.concat(F.lit("Invalid house number: expected a positive integer, got "), F.coalesce(x.cast("string"), F.lit("null"))))


def canonical(street: Column, number: Column, extra: Column, code: Column, city: Column) -> Column:
    """An address in canonical form as a struct: status, error, street, house_number, house_number_addition, postal_code, city.

    Without a valid postal code the status is null, as text, and nothing more is looked at; else a faulty house number makes it error, with what is wrong. Then, too, all parts are null. An addition of its own goes before one in the house number.
    """
    bare = F.regexp_replace(F.coalesce(number, F.lit("")), r"^\s+|\s+$", "")
    fault = number_fault(number)
    status = F.when(postal_code(code).isNull(), "null").when(fault.isNotNull(), "error").otherwise("ok")
    parts = {"street": collapsed(street), "house_number": house_number(bare), "house_number_addition": F.coalesce(addition(extra), house_suffix(bare)), "postal_code": postal_code(code), "city": collapsed(city)}
    return F.struct(status.alias("status"), F.when(status == "error", fault).alias("error"), *(F.when(status == "ok", x).alias(name) for name, x in parts.items()))


def shown_addition(x: Column) -> Column:
    """A single capital as it is, anything else behind a hyphen."""
    return F.when(F.coalesce(x, F.lit("")) == "", "").when(x.rlike("^[A-Z]$"), x).otherwise(F.concat(F.lit("-"), x))


def address(street: Column, number: Column, extra: Column, code: Column, city: Column) -> Column:
    """The address on one line; null if any part is, but for the addition."""
    return F.concat(street, F.lit(" "), number.cast("string"), shown_addition(extra), F.lit(", "), code, F.lit(" "), city)


#: The same in SQL, over a table p of properties.
ADDRESS_SQL = (
    "p.street || ' ' || CAST(p.house_number AS VARCHAR) || CASE WHEN coalesce(p.house_number_addition, '') = '' THEN '' "
    "WHEN regexp_matches(p.house_number_addition, '^[A-Z]$') THEN p.house_number_addition ELSE '-' || p.house_number_addition END || ', ' || p.postal_code || ' ' || p.city"
)


def display_address(street: Column, number: Column, extra: Column, code: Column, city: Column) -> Column:
    """The address on one line without the parts that are missing."""
    line = F.concat_ws(" ", F.nullif(F.trim(street), F.lit("")), F.concat(number.cast("string"), shown_addition(extra)))
    place = F.concat_ws(" ", F.nullif(F.trim(code), F.lit("")), F.nullif(F.trim(city), F.lit("")))
    return F.concat_ws(", ", F.nullif(line, F.lit("")), F.nullif(place, F.lit("")))


def source_url(x: Column) -> Column:
    """A URL's origin and path, without query, fragment, default port and slash at the end; scheme and host in lower case."""
    bare = F.regexp_replace(F.trim(x), r"[?#].*$", "")
    head = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)", 1))
    head = F.regexp_replace(F.regexp_replace(head, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.regexp_replace(F.concat(head, F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")), r"/+$", "")


def host(x: Column) -> Column:
    return F.lower(F.regexp_extract(x, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def site(x: Column) -> Column:
    """Which site a URL is of, by its host."""
    at = host(x)
    return F.when(at.rlike(r"(^|\.)funda\.nl$"), "funda").when(at.rlike(r"(^|\.)pararius\.(nl|com)$"), "pararius").otherwise("other")


def allowed_url(x: Column) -> Column:
    """An https URL of a listing site."""
    return x.rlike("^(?i)https://") & (site(x) != "other")


def _marked() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters without: those that decompose into an ASCII letter and marks."""
    both = [(c, unicodedata.normalize("NFD", c)) for c in map(chr, (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)))]
    some = [(c, d[0]) for c, d in both if c == c.lower() and len(d) > 1 and d[0].isascii() and all(map(unicodedata.combining, d[1:]))]
    return "".join(c for c, _ in some), "".join(d for _, d in some)


MARKED, PLAIN = _marked()


def unmarked(x: Column) -> Column:
    """Lower case without marks, also without those that stand for themselves behind a letter."""
    return F.regexp_replace(F.translate(F.lower(x), MARKED, PLAIN), "[\u0300-\u036f]", "")


def comparable(x: Column) -> Column:
    return unmarked(x)


def title_match(title: Column, street: Column, number: Column) -> Column:
    """How a page's title and an address agree: match, partial, mismatch, or no title."""
    has_number = F.rlike(title, F.concat(F.lit("(?<![0-9])"), number.cast("string"), F.lit("(?![0-9])")))
    has_street = (F.trim(street) != "") & F.contains(comparable(title), comparable(F.trim(street)))
    both = F.coalesce(has_number, F.lit(False)).cast("int") + F.coalesce(has_street, F.lit(False)).cast("int")
    return F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "no title").when(both == 2, "match").when(both == 1, "partial").otherwise("mismatch")


def meta_content(html: Column, name: str) -> Column:
    """The content of a page's meta property, attributes in either order, empty if that is empty; null if there is none."""
    named, content = rf"(?:property|name)=[\"']{name}[\"']", r"content=[\"']([^\"']*)[\"']"
    out = F.lit(None).cast("string")
    for pattern in (rf"(?is)<meta[^>]*{content}[^>]*{named}", rf"(?is)<meta[^>]*{named}[^>]*{content}"):
        out = F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1)).otherwise(out)
    return out


def title_warning(found: Column) -> Column:
    """What is said about a title_match; nothing for a match."""
    return F.when(found == "no title", "Could not extract title from URL").when(found == "partial", "This listing may be for a different address").when(found == "mismatch", "This listing appears to be for a different address")
