"""Personal data in texts, also where it is disguised.

Plain identifiers are found by patterns. A second pass writes the text anew through transducers (look-alike characters, spelled digits, at and dot in brackets or words), keeping for every character of the new text where it came from, finds identifiers there, and maps their spans back to the characters of the source.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.stages import frugal
from gevel.llm.words import parts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_DOMAIN = regex.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_IP_TAIL = re.compile(r"\.[0-9]++\.[0-9]++\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[Span]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from their at signs in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            free = domain.end()
            yield begin, free
        at = text.find("@", max(free, at + 1))


def ips(text: str) -> Iterator[Span]:
    for m in _IP.finditer(text) if _IP_TAIL.search(text) else ():
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
            yield m.span()


def luhn(digits: str) -> bool:
    """The digits' check sum is right."""
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def cards(text: str) -> Iterator[Span]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                yield m.span()


FINDERS: dict[str, Callable[[str], Iterator[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters of other scripts that look like these ASCII letters (fixed values).
LOOKALIKES = dict(zip("авеіјкмнорсѕтухԁԛԝАВЕІЈКМНОРСЅТХΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυ", "abeijkmhopcstyxdqwABEIJKMHOPCSTXABEZHIKMNOPTYXaivopu", strict=True))
LOOKALIKES |= dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("   ", " ") | dict.fromkeys("․·", ".")


def _plain(c: str) -> str | None:
    """What a character stands for, None if for itself: a look-alike, a compatibility form of one ASCII character, a digit of another script, or nothing (a format character)."""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if unicodedata.category(c) == "Cf":
        return ""
    if (digit := unicodedata.decimal(c, None)) is not None:
        return str(digit)
    form = unicodedata.normalize("NFKC", c)
    return form if form != c and len(form) == 1 and form.isascii() else None


PLAIN = {c: p for c in map(chr, range(128, 0x20000)) if not "\ud800" <= c <= "\udfff" and (p := _plain(c)) is not None}
_ODD = regex.compile("[" + "".join(map(regex.escape, PLAIN)) + "]")

#: Digits as words of the languages that texts come in (fixed values).
DIGITS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}
_NAMES = "|".join(sorted(DIGITS, key=len, reverse=True))
#: Three spelled digits in a row or more, with digits and a plus sign among them.
_SPELLED = regex.compile(rf"(?i)\b(?:(?:plus|\+)[ ]?)?(?:[0-9]+[ ,.-]{{0,2}})*+(?:(?:{_NAMES})\b[ ,-]{{0,2}}){{3}}(?:(?:(?:{_NAMES})\b|[0-9]+)[ ,-]{{0,2}})*")
_SPELLED_PART = regex.compile(rf"(?i)plus[ ]?|(?:{_NAMES})\b|,[ ]?|[ ]{{2}}|-[ ]| -")
_BRACKETS = re.compile(r"(?i)[\[({<][ ]?(?:at|@|a|dot|punkt|point|punto|\.)[ ]?[\])}>]")
_SIGN = re.compile(rf"(?i)[ ]?{_BRACKETS.pattern[4:]}[ ]?")
#: Signs as words or with blanks around, between what may be the parts of an address. After the word at, prose may name a host, so there a dot must be disguised too.
_AT = re.compile(r"[ ]+[aA][tT][ ]+|[ ]+@[ ]*|@[ ]+")
_HOST = regex.compile(r"(?i)[A-Z0-9-]++(?:(?P<dot>[ ]+dot[ ]+|[ ]+\.[ ]*|\.)[A-Z0-9-]++)+")
_SPELLED_HOST = regex.compile(r"(?i)[A-Z0-9-]++(?:\.[A-Z0-9-]++)*+(?:(?P<dot>[ ]+dot[ ]+)(?=[A-Z0-9-]*[A-Z])[A-Z0-9-]++(?:\.[A-Z0-9-]++)*+)+")
#: Last parts of hosts after the word at (fixed values).
_LAST = frozenset("ai app ar at au be biz br ca ch cl cn co com de dev dk edu es eu fi fr gov gr hu ie in info int io it jp kr me mil mx net nl no nz org pl pt ro ru se tr tv uk us za".split())
_MIXED = regex.compile(r"(?i)(?<=@[A-Z0-9.-]{1,255})[ ]+dot[ ]+(?=[A-Z]{2})")
#: References to characters, and signs as words between underscores or hyphens.
_REFERENCE = re.compile(r"(?i)&#0*64;|&#x0*40;|&commat;|&#0*46;|&#x0*2e;|&period;")
_JOINED = regex.compile(r"(?i)(?<=[A-Z0-9])(?P<gap>[_-])at(?P=gap)[A-Z0-9-]+?(?:(?P=gap)dot(?P=gap)[A-Z0-9]++)+")
_JOINED_SIGN = re.compile(r"(?i)[_-](at|dot)[_-]")
#: Four groups of up to three digits, spelled or not, with dots as words or signs between.
_GROUP = rf"(?:(?:{_NAMES})\b[ -]?|[0-9]){{1,3}}"
_SPELLED_IP = regex.compile(rf"(?i)\b{_GROUP}(?:[ ]*(?:dot|point|punkt|punto|\.)[ ]*{_GROUP}){{3}}")
_IP_PART = regex.compile(rf"(?i)[ ]*(?P<dot>\b(?:dot|point|punkt|punto)\b)[ ]*|(?P<digit>{_NAMES})\b(?:[ -](?=(?:{_NAMES})\b))?")
_DOT_WORD = re.compile(r"(?i)\b(?:dot|point|punkt|punto)\b")


def _spelled(text: str) -> bool:
    """Three spelled digits stand in a row somewhere."""
    return b"\1\1\1" in bytes([w in DIGITS for w in text.lower().replace(",", " ").replace("-", " ").split()])


class Rewritten:
    """A text and, for each of its characters, the span of the source that it came from."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.begins: np.ndarray | None = None

    def change(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces spans of the present text; they come in order and don't overlap."""
        if not edits:
            return
        if self.begins is None:
            self.begins = np.arange(len(self.text), dtype=np.int64)
            self.ends = self.begins + 1
            self.touched = np.zeros(len(self.text), bool)
        text, begins, ends, touched, at = [], [], [], [], 0
        bare, size = [], 0
        for a, b, new in edits:
            text += [self.text[at:a], new]
            n = len(new)
            begins += [self.begins[at:a], np.full(n, self.begins[a])]
            ends += [self.ends[at:a], np.full(n, self.ends[b - 1])]
            touched += [self.touched[at:a], np.ones(n, bool)]
            size += a - at + n
            if not n:
                bare.append(size)
            at = b
        self.text = "".join([*text, self.text[at:]])
        self.begins, self.ends, self.touched = (np.concatenate([*x, whole[at:]]) for x, whole in ((begins, self.begins), (ends, self.ends), (touched, self.touched)))
        # What was left out shows at the next character.
        self.touched[[k for k in bare if k < len(self.touched)]] = True

    def source(self, span: Span) -> Span | None:
        """The source's span, None if nothing in it was replaced."""
        a, b = span
        return (int(self.begins[a]), int(self.ends[b - 1])) if self.touched[a:b].any() else None


def rewritten(text: str) -> Rewritten:
    """The text through all transducers, one after the other."""
    out = Rewritten(text)
    if not text.isascii() and not PLAIN.keys().isdisjoint(set(text)):
        out.change([(*m.span(), PLAIN[m[0]]) for m in _ODD.finditer(text)])
    if "&" in out.text:
        out.change([(*m.span(), "@" if m[0].lower().lstrip("&#x0") in ("64;", "40;", "commat;") else ".") for m in _REFERENCE.finditer(out.text)])
    if _DOT_WORD.search(out.text):
        edits = []
        for m in _SPELLED_IP.finditer(out.text):
            for p in _IP_PART.finditer(out.text, *m.span()):
                edits.append((*p.span(), str(DIGITS[p["digit"].lower()]) if p["digit"] else "."))
        out.change(edits)
    if _spelled(out.text):
        edits = []
        for m in _SPELLED.finditer(out.text):
            for p in _SPELLED_PART.finditer(out.text, *m.span()):
                word = p[0].lower()
                edits.append((*p.span(), str(DIGITS[word]) if word in DIGITS else "+" if word.startswith("plus") else "-" if "-" in word else " "))
        out.change(edits)
    if _BRACKETS.search(out.text):
        out.change([(*m.span(), "@" if m[0].strip(" [](){}<>").lower() in ("at", "@", "a") else ".") for m in _SIGN.finditer(out.text)])
    if "at" in (low := out.text.lower()) and "dot" in low:
        edits = [(*p.span(), "@" if p[1].lower() == "at" else ".") for m in _JOINED.finditer(out.text) for p in _JOINED_SIGN.finditer(out.text, *m.span())]
        out.change(edits)
    edits, free = [], 0
    for m in _AT.finditer(out.text):
        host = (_HOST if "@" in m[0] else _SPELLED_HOST).match(out.text, m.end()) if m.start() > free and out.text[m.start() - 1] in _LOCAL else None
        # A dot with a blank behind it and a capital after that ends a sentence.
        if host and ("@" in m[0] or re.split(r"[. ]", host[0])[-1].lower() in _LAST) and not any(out.text[b - 1] == " " and out.text[a:b].strip() == "." and out.text[b].isupper() for a, b in host.spans("dot")):
            edits += [(*m.span(), "@"), *((*s, ".") for s in host.spans("dot"))]
            free = host.end()
    out.change(edits)
    if "@" in out.text:
        out.change([(*m.span(), ".") for m in _MIXED.finditer(out.text)])
    return out


def spans(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """By kind, the plain identifiers' spans, and those with the disguised ones, which don't overlap plain ones of their kind."""
    base = {kind: list(find(text)) for kind, find in FINDERS.items()}
    new = rewritten(text)
    if new.begins is None:
        return base, base
    every = {}
    for kind, find in FINDERS.items():
        found = [s for x in find(new.text) if (s := new.source(x))]
        # Base spans are in order and apart: of those that begin before a span ends, only the last can reach into it.
        begins = [a for a, _ in base[kind]]
        found = [s for s in found if not (k := bisect_left(begins, s[1])) or base[kind][k - 1][1] <= s[0]]
        every[kind] = sorted({*base[kind], *found})
    return base, every


def listed(found: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in found[kind])


def redacted(text: str, found: dict[str, list[Span]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, counts."""
    out, at = [], 0
    for a, minus, kind in sorted((a, -b, kind) for kind in KINDS for a, b in found[kind]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = -minus
    return "".join([*out, text[at:]])


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_base) of each row.

    spans lists all spans as kind:start:end in code points, end exclusive; the counts are of these, n_base of the plain ones alone, whose list base_sha256 is of. Null counts as empty, which has none; texts of any length are gone through whole; repeated rows stay; an empty table gives an empty one.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 1)):
            out: list[list] = [[] for _ in range(len(names) - 1)]
            for text in batch.column(1):
                base, every = spans(text.as_py())
                values = (*(len(every[k]) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), sum(map(len, base.values())))
                for column, x in zip(out, values, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.string() if n in ("base_sha256", "spans") else pa.int64()) for n, x in zip(names[1:], out, strict=True))], names)

    return rows.mapInArrow(frugal(work), f"id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long").withColumnRenamed("id", id_col)


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, with personal data in text_col replaced by [EMAIL], [IP], [CARD], [PHONE]; null stays null."""
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts = [None if t is None else redacted(t, spans(t)[1]) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]], batch.schema.names)

    return df.mapInArrow(frugal(work), df.schema)
