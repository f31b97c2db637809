"""How prices, places, times and standings are written, and rules about URLs and addresses of hosts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gevel.functions.address import host, unmarked

#: Between a currency sign and its number.
HARD = " "
#: The range of the price slider (fixed values).
LEAST_PRICE, MOST_PRICE = 50_000, 2_000_000


def number(x: Column) -> Column:
    """A whole number with points between thousands."""
    return F.translate(F.format_number(x, 0), ",", ".")


def _tenths(x: Column) -> Column:
    """One digit behind a comma, left out if it is 0; halves up."""
    return F.translate(F.regexp_replace(F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10.0), r"\.0$", ""), ".", ",")


def price(x: Column, compact: bool = False) -> Column:
    """Whole euros; compact in thousands (K) and millions (mln.)."""
    if not compact:
        return F.concat(F.lit("€" + HARD), number(x))
    return F.concat(F.lit("€" + HARD), F.when(x < 1000, number(x)).when(x < 999_950, F.concat(_tenths(x / 1000), F.lit("K"))).otherwise(F.concat(_tenths(x / 1_000_000), F.lit(HARD + "mln."))))


def price_range(low: Column, high: Column) -> Column:
    return F.concat(price(low), F.lit(" - "), price(high))


def percentage(x: Column, signed: bool = False) -> Column:
    """A share in percent with one digit behind the point."""
    text = F.concat(F.format_string("%.1f", F.floor(x * 1000 + 0.5) / 10.0), F.lit("%"))
    return F.when(x > 0, F.concat(F.lit("+"), text)).otherwise(text) if signed else text


def area(x: Column) -> Column:
    return F.concat(number(x), F.lit(" m²"))


def karma(x: Column) -> Column:
    """Points, from ten thousand on in thousands."""
    return F.when(x >= 10_000, F.concat(F.format_string("%.1f", F.floor(x / 100 + 0.5) / 10.0), F.lit("K"))).otherwise(number(x))


def _ladder(x: Column, lowest: str, *steps: tuple[int, str]) -> Column:
    out = F.lit(lowest)
    for least, name in steps:
        out = F.when(x >= least, name).otherwise(out)
    return out


def standing(x: Column) -> Column:
    """The standing of karma points in shared texts (fixed values; profiles and badges have ladders of their own)."""
    return _ladder(x, "Newbie", (50, "Regular"), (250, "Trusted"), (1000, "Expert"), (5000, "Master"), (10_000, "Legend"))


def badge(x: Column) -> Column:
    """The badge beside a comment (fixed values)."""
    return _ladder(x, "Newbie", (11, "Regular"), (51, "Trusted"), (101, "Expert"), (500, "Legend"))


def truncated(x: Column, most: int) -> Column:
    return F.when(F.length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most - 3), F.lit("...")))


def postal_code(x: Column) -> Column:
    """Capitals, with a blank in the middle of one of six characters."""
    bare = F.upper(F.regexp_replace(x, r"\s", ""))
    return F.when(F.length(bare) == 6, F.concat(F.substring(bare, 1, 4), F.lit(" "), F.substring(bare, 5, 2))).otherwise(bare)


def written_address(street: Column, house: Column, extra: Column, code: Column, city: Column) -> Column:
    """Street, number and addition without a gap, then the code and city that are known."""
    some = lambda c: F.nullif(c, F.lit(""))
    place = F.concat_ws(" ", postal_code(some(code)), some(city))
    return F.concat(street, F.lit(" "), house, F.coalesce(extra, F.lit("")), F.when(place != "", F.concat(F.lit(", "), place)).otherwise(""))


def slug(x: Column) -> Column:
    """Lower case without marks, blanks as hyphens, nothing but letters, digits and hyphens."""
    return F.regexp_replace(F.regexp_replace(unmarked(x), r"\s+", "-"), "[^a-z0-9-]", "")


def address_path(city: Column, code: Column, street: Column, house: Column) -> Column:
    return F.concat(F.lit("/"), slug(city), F.lit("/"), slug(code), F.lit("/"), slug(street), F.lit("/"), house)


def view_kind(city: Column, code: Column, street: Column, house: Column) -> Column:
    """What an address path shows, by the parts that it has."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(~has(city), "invalid").when(~has(code), "city").when(~has(street) | ~has(house), "postcode").otherwise("property")


def is_placeholder(x: Column) -> Column:
    return x.rlike(r"(?i)^BAG\s*Pand\s*")


def in_country(lon: Column, lat: Column) -> Column:
    return lat.between(50.5, 53.7) & lon.between(3.3, 7.3)


def site_by_part(url: Column) -> Column:
    """Which site a submitted listing is of: a part of its host will do."""
    at = host(url)
    return F.when(F.contains(at, F.lit("funda.nl")), "funda").when(F.contains(at, F.lit("pararius.nl")) | F.contains(at, F.lit("pararius.com")), "pararius").otherwise("other")


def site_by_domain(url: Column) -> Column:
    """Which site a page to fetch is of: by its whole domain."""
    at = host(url)
    return F.when(at.rlike(r"(^|\.)funda\.nl$"), "funda").when(at.rlike(r"(^|\.)pararius\.nl$"), "pararius").otherwise("other")


def may_be_fetched(url: Column) -> Column:
    return url.rlike("^(?i)https://") & (site_by_domain(url) != "other")


def is_private(ip: Column) -> Column:
    """An address of a private, local or reserved network; also those in IPv6 form."""
    four = F.regexp_extract(F.lower(ip), r"^(?:::ffff:)?(\d+\.\d+\.\d+\.\d+)$", 1)
    a, b = (F.split_part(four, F.lit("."), F.lit(k)).try_cast("int") for k in (1, 2))
    inside = a.isin(0, 10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return F.when(four != "", F.coalesce(inside, F.lit(False))).otherwise((ip == "::1") | F.lower(ip).rlike("^(fd|fe80)"))


def listing_title(kind: Column, street: Column, house: Column, extra: Column, city: Column) -> Column:
    return F.concat(F.when(kind == "rent", "Te huur").otherwise("Te koop"), F.lit(": "), street, F.lit(" "), house, F.coalesce(extra, F.lit("")), F.lit(", "), city)


def euros(cents: Column) -> Column:
    """Whole euros of cents as text, halves up; null where they are no number."""
    return F.floor(cents.try_cast("double") / 100 + 0.5).cast("long")


def slider_position(x: Column) -> Column:
    """Where a price is on the slider, 0 to 1 in logarithms."""
    low, high = F.ln(F.lit(float(LEAST_PRICE))), F.ln(F.lit(float(MOST_PRICE)))
    return (F.ln(F.greatest(F.lit(LEAST_PRICE), F.least(F.lit(MOST_PRICE), x)).cast("double")) - low) / (high - low)


def slider_price(position: Column) -> Column:
    """The price at a place of the slider, in thousands."""
    low, high = F.ln(F.lit(float(LEAST_PRICE))), F.ln(F.lit(float(MOST_PRICE)))
    return (F.floor(F.exp(low + F.greatest(F.lit(0.0), F.least(F.lit(1.0), position)) * (high - low)) / 1000 + 0.5) * 1000).cast("long")


def bar_position(x: Column, low: Column, high: Column) -> Column:
    """Percent of the way from low to high, the middle if they are one."""
    return F.when(low == high, 50.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (x - low) / (high - low) * 100)))


def is_near(a: Column, b: Column, most: float = 0.03) -> Column:
    return F.abs(a - b) <= most


#: Units of elapsed time: from which number of seconds on, seconds in one, its names for the last one, the one before, one, and more (fixed values).
UNITS = (
    (0, 1, "1 seconde geleden", "2 seconden geleden", "seconden"), (60, 60, "1 minuut geleden", "2 minuten geleden", "minuten"), (3600, 3600, "1 uur geleden", "2 uur geleden", "uur"),
    (86_400, 86_400, "gisteren", "eergisteren", "dagen"), (604_800, 604_800, "vorige week", "2 weken geleden", "weken"), (2_592_000, 2_592_000, "vorige maand", "2 maanden geleden", "maanden"),
    (31_536_000, 31_536_000, "vorig jaar", "2 jaar geleden", "jaar"),
)


def elapsed(ts: Column, now: Column) -> Column:
    """How long ago a time was, in words."""
    seconds = F.unix_timestamp(now) - F.unix_timestamp(ts)
    out = F.lit("nu")
    for least, size, last, before, many in UNITS:
        n = F.floor(seconds / size)
        text = F.when(n == 0, "nu").when(n == 1, last).when(n == 2, before).otherwise(F.concat(n.cast("string"), F.lit(f" {many} geleden")))
        out = F.when(seconds >= least, text).otherwise(out)
    return out


def remaining(end: Column, now: Column) -> Column:
    """How long until a time, in its largest unit of days, hours and minutes."""
    seconds = F.unix_timestamp(end) - F.unix_timestamp(now)
    words = lambda n, name: F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n == 1, "").otherwise("s"))
    days, hours, minutes = F.floor(seconds / 86_400), F.floor(seconds % 86_400 / 3600), F.floor(seconds % 3600 / 60)
    return F.when(seconds <= 0, "now").when(days > 0, words(days, "day")).when(hours > 0, words(hours, "hour")).otherwise(words(minutes, "minute"))
