"""Pre-tokens of many texts at once: where they begin, one key each, and a store of what was worked out for each distinct one.

Texts become code points; a table gives each code point's class, so that runs, optional leading spaces and contractions are found with array operations. A pre-token is looked up by a 64-bit hash and then held against the code points that are stored under it, so equal hashes do no harm."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from tokenizers import Regex
from tokenizers.normalizers import Replace

from gevel.llm.words import hashed_points

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_classes: np.ndarray | None = None


def point_classes() -> np.ndarray:
    """The class of every code point, as the tokenizers library's patterns `\\p{L}`, `\\p{N}` and `\\s` have it."""
    global _classes
    if _classes is None:
        table = np.zeros(0x110000, np.uint8)
        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        place = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            # Only \ue000, a private character, may stand for itself: it is in none of the classes.
            marked = np.concatenate([np.frombuffer(Replace(Regex(pattern), "\ue000").normalize_str(every[k : k + 4096]).encode("utf-32-le"), np.uint32) for k in range(0, len(every), 4096)])
            table[place[(marked == 0xE000) & (place != 0xE000)]] = kind
        _classes = table
    return _classes


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins, one more at the end."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), starts


def _before(flags: np.ndarray) -> np.ndarray:
    out = np.zeros_like(flags)
    out[1:] = flags[:-1]
    return out


def contractions(cp: np.ndarray, at: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes at `at`, those that begin 's 't 'm 'd 're 've 'll, and the length of each."""
    n = len(cp)
    pad = np.concatenate([cp[:], np.zeros(2, np.uint32)])
    stop = np.concatenate([edge[:n], np.ones(2, bool)])
    one, two = pad[at + 1], np.where(stop[np.minimum(at + 2, n + 1)], 0, pad[np.minimum(at + 2, n + 1)])
    inside = ~stop[at + 1]
    short = inside & np.isin(one, [ord(c) for c in "stmd"])
    long = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
    return at[short | long], np.where(short, 2, 3)[short | long]


def byte_level_starts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Flags of the first code point of each pre-token of the pattern `'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`."""
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    kind = point_classes()[cp]
    solid = kind != SPACE
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    # A blank right before a run belongs to it, and any white space there is the last of its own run.
    last = np.zeros(n, bool)
    last[:-1] = ~solid[:-1] & solid[1:] & ~edge[1:n]
    blank = last & (cp == 32)
    begin |= last
    begin &= ~_before(blank)
    # An apostrophe that a match begins with, and that is not part of a longer run, may begin a contraction.
    at = np.flatnonzero((cp == 39) & begin)
    if len(at):
        at, long = contractions(cp, at, edge)
        begin[at + 1] = False
        after = at + long
        ok = after < n
        begin[after[ok]] = True
        three = at[long == 3]
        begin[three + 2] = False
    return begin


def word_starts(cp: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the matches of `'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+`."""
    n = len(cp)
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    kind = point_classes()[cp]
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    begin |= kind == NUMBER
    at = np.flatnonzero((cp == 39) & begin)
    if len(at):
        at, long = contractions(cp, at, edge)
        begin[at + 1] = False
        begin[at[long == 3] + 2] = False
        after = at + long
        begin[after[after < n]] = True
    first = np.flatnonzero(begin)
    ends = np.append(first[1:], n)
    keep = kind[first] != SPACE
    return first[keep], ends[keep]


class Store:
    """What was worked out for each distinct pre-token, as rows of a flat array; emptied when it holds `most` of them."""

    def __init__(self, work: Callable[[list[str]], list[np.ndarray]], dtype: type, most: int = 1_000_000) -> None:
        self.work, self.dtype, self.most = work, dtype, most
        self.clear()

    def clear(self) -> None:
        self.places: dict[int | str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, self.dtype), 0
        self.begins, self.sizes = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        #: The pre-tokens themselves, and where each one begins and ends.
        self.text, self.written = np.zeros(1 << 16, np.uint32), 0
        self.heads, self.tails = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _add(self, keys: list[int | str], words: list[str]) -> None:
        rows = self.work(words)
        spelled, edges = points(words)
        at, new = len(self.places), len(rows)
        self.flat = roomy(self.flat, self.used + sum(map(len, rows)))
        self.text = roomy(self.text, self.written + len(spelled))
        self.begins, self.sizes, self.heads, self.tails = (roomy(x, at + new) for x in (self.begins, self.sizes, self.heads, self.tails))
        self.text[self.written : self.written + len(spelled)] = spelled
        self.heads[at : at + new], self.tails[at : at + new] = self.written + edges[:-1], self.written + edges[1:]
        self.written += len(spelled)
        for key, row in zip(keys, rows, strict=True):
            self.places[key] = at
            self.begins[at], self.sizes[at] = self.used, len(row)
            self.flat[self.used : self.used + len(row)] = row
            self.used += len(row)
            at += 1

    def of(self, cp: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place in the store of each pre-token."""
        keys = hashed_points(cp, begins, ends)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.places) + len(distinct) > self.most and self.places:
            self.clear()
        word = lambda k: cp[begins[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass")
        places = list(map(self.places.get, distinct.tolist()))
        missing = [k for k, p in enumerate(places) if p is None]
        if missing:
            self._add(distinct[missing].tolist(), list(map(word, first[missing].tolist())))
            places = list(map(self.places.__getitem__, distinct.tolist()))
        found = np.array(places, np.int64)[inverse]
        # A pre-token that is not the one under its hash is looked up by itself.
        for k in np.flatnonzero(~self._same(cp, begins, ends, found)).tolist():
            if (spelled := word(k)) not in self.places:
                self._add([spelled], [spelled])
            found[k] = self.places[spelled]
        return found

    def _same(self, cp: np.ndarray, begins: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Whether each pre-token is the one at its place, code point for code point."""
        heads, sizes = self.heads[places], ends - begins
        same = sizes == self.tails[places] - heads
        full = np.flatnonzero(same & (sizes > 0))
        inside = np.cumsum(sizes[full]) - sizes[full]
        step = np.arange(int(sizes[full].sum())) - np.repeat(inside, sizes[full])
        differ = cp[np.repeat(begins[full], sizes[full]) + step] != self.text[np.repeat(heads[full], sizes[full]) + step]
        if differ.any():
            same[full] &= ~np.logical_or.reduceat(differ, inside)
        return same

    def rows(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of these places in a row, and how many each has."""
        sizes = self.sizes[places].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        index = np.arange(total) + np.repeat(self.begins[places] - (ends - sizes), sizes)
        return self.flat[index], sizes


def roomy(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n values at least."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(2 * n - len(x), x.dtype)])


def batches_of(texts: list[str], most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters; a longer text has a range of its own."""
    begin, size = 0, 0
    for k, t in enumerate(texts):
        if k > begin and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
