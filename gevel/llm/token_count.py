"""Token counts of texts: each distinct pre-token is counted once, and its count is joined to the frequencies of pre-tokens in each text."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.pretokens import Store, batches_of, points
from gevel.llm.tokenizer_files import pieces
from gevel.llm.words import parts, text_bytes

BLANK, MARK, LINE = 32, 0x2581, 10


#: Buckets of pre-tokens at least; no bucket should be more than a task can go through.
BUCKETS = 8192
#: Characters of a block of texts at most, but for longer texts, and of what is cut at once.
BLOCK, AT_ONCE = 16 << 20, 2 << 20
#: A pre-token in more than one of so many texts of a block is frequent there; frequent ones are dealt over as many buckets, by block.
SALTS = 64
#: Numbers of 16 bits.
NARROW = (1 << 16) - 1
#: Pre-tokens whose counts a task keeps.
KEPT = 1_000_000


@functools.cache
def counter(model: str) -> Callable[[list[str]], list[int]]:
    """Counts for pre-tokens of a SentencePiece model.

    No piece may hold a blank mark after another character, or a line feed; then no merge crosses where pre-tokens are cut.
    """
    processor = pieces(model)
    for k in range(processor.get_piece_size()):
        piece = processor.id_to_piece(k)
        if "\n" in piece or "▁" in piece.lstrip("▁"):
            raise ValueError(f"piece {piece!r} crosses a cut")

    def counts(words: list[str]) -> list[int]:
        # The library sets a mark before each text; a line feed keeps it apart from what follows.
        asked = [w[1:] if w[0] == "▁" else f"\n{w}" for w in words]
        extra = [0 if w[0] == "▁" else 2 for w in words]
        return [len(ids) - e if x else 1 for x, ids, e in zip(asked, processor.encode(asked, num_threads=1), extra, strict=True)]

    return counts


def cuts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin: at each run of blanks with the word behind it, and at line feeds."""
    begin = np.zeros(len(cp) + 1, bool)
    begin[starts] = True
    begin = begin[:-1]
    mark, line = cp == MARK, cp == LINE
    begin[1:] |= (mark[1:] & ~mark[:-1]) | (line[1:] != line[:-1])
    return np.flatnonzero(begin)


class Names(Store):
    """A store of the pre-tokens themselves, by place, and a hash of each."""

    def __init__(self) -> None:
        # It is emptied between blocks only.
        super().__init__(self.named, np.int64, most=1 << 62)

    def clear(self) -> None:
        super().clear()
        self.names: list[str] = []

    def named(self, words: list[str]) -> list[np.ndarray]:
        self.names.extend(words)
        return [np.array([xxhash.xxh3_64_intdigest(w.encode()) >> 2], np.int64) for w in words]


def frequencies(texts: list[str], names: Names) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pre-token (its place in names) occurs in which text how often, ordered by pre-token."""
    cp, starts = points(texts)
    if not len(cp):
        return (np.zeros(0, np.int64),) * 3
    cp = np.where(cp == BLANK, np.uint32(MARK), cp)
    begins = cuts(cp, starts)
    places = names.of(cp, begins, np.append(begins[1:], len(cp)))
    pairs, times = np.unique(places * len(texts) + np.searchsorted(starts, begins, "right") - 1, return_counts=True)
    return *np.divmod(pairs, len(texts)), times


def lists(values: np.ndarray | pa.Array, ends: np.ndarray) -> pa.Array:
    """Lists of the values up to each of the ends."""
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), values if isinstance(values, pa.Array) else pa.array(values))


def byte_places(held: np.ndarray, width: int) -> np.ndarray:
    """For the numbers of cells that hold so many each, where the bytes of each go: in a cell, all lowest bytes come first, so that high ones, mostly zeros, lie together and compress."""
    begins = np.cumsum(held) - held
    return (np.repeat(begins * (width - 1), held) + np.arange(int(held.sum())))[:, None] + np.arange(width) * np.repeat(held, held)[:, None]


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the numbers up to each of the ends."""
    width, offsets = data.itemsize, np.append(0, ends).astype(np.int64)
    raw = np.ascontiguousarray(data).view(np.uint8)
    if width > 1:
        raw, plain = np.empty_like(raw), raw.reshape(-1, width)
        raw[byte_places(np.diff(offsets), width)] = plain
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(raw)])


def numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all cells in a row, and how many each cell has."""
    raw, width = np.frombuffer(b"".join(column.to_pylist()), np.uint8), np.dtype(kind).itemsize
    held = pa.compute.binary_length(column).to_numpy().astype(np.int64) // width
    return (raw[byte_places(held, width)].reshape(-1).view(kind) if width > 1 else raw.view(kind)), held


def steps(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Of rising numbers in groups of so many each: the first of each group, and how much more each other one is than the one before."""
    out = np.diff(values, prepend=0)
    begins = (np.cumsum(held) - held)[held > 0]
    out[begins] = values[begins]
    return out


def risen(values: np.ndarray, held: np.ndarray) -> np.ndarray:
    """The numbers that steps() was made of."""
    total = np.cumsum(values, dtype=np.int64)
    before = np.append(0, total)[np.cumsum(held) - held]
    return total - np.repeat(before, held)


def kinds(wide: bool) -> tuple[type, ...]:
    """Of the bytes of words and the numbers in `sizes`, `lengths`, `texts` and `times`; narrow ones do for most blocks."""
    return (np.uint8, *(np.uint32,) * 4) if wide else (np.uint8, np.uint16, np.uint16, np.uint16, np.uint8)


def dealt(texts: list[str], names: Names, block: int, buckets: int) -> tuple[np.ndarray, bool, list[pa.Array]]:
    """The buckets of a block's pre-tokens, whether its numbers are wide, and for each bucket its pre-tokens, in how many texts each is, their bytes, in which texts, and how often."""
    found = [(a, *frequencies(texts[a:b], names)) for a, b in batches_of(texts, AT_ONCE)]
    place, text, times = (np.concatenate(x) for x in ([p for _, p, _, _ in found], [t + a for a, _, t, _ in found], [n for *_, n in found]))
    sort = np.argsort(place, kind="stable")
    place, text, times = place[sort], text[sort], times[sort]
    distinct, first, size = np.unique(place, return_index=True, return_counts=True)
    hashes, _ = names.rows(distinct)
    salt = np.where(size * SALTS > len(texts), block % SALTS + 1, 0)
    bucket = (hashes + salt * 0x9E3779B1) % buckets
    order = np.argsort(bucket, kind="stable")
    size = size[order]
    inside = np.repeat(first[order] - (np.cumsum(size) - size), size) + np.arange(len(place))
    found, begins = np.unique(bucket[order], return_index=True)
    ends = np.append(begins, len(order))[1:] if len(order) else begins
    words, bounds = text_bytes(pa.array([names.names[k] for k in distinct[order].tolist()], pa.large_string()))
    upto = np.append(0, np.cumsum(size))[ends]
    wide = len(texts) > NARROW or int(np.diff(bounds).max(initial=0)) > NARROW or int(times.max(initial=0)) > 255
    columns = (words, bounds[ends]), (size, ends), (np.diff(bounds), ends), (steps(text[inside], size), upto), (times[inside], upto)
    return found, wide, [cells(x.astype(kind), e) for kind, (x, e) in zip(kinds(wide), columns, strict=True)]


def token_counts(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) of each row.

    Tokens are those of the SentencePiece model without begin, end or added tokens; strings of special tokens are ordinary text. Texts are taken in blocks; the frequencies of a block's pre-tokens in its texts go to the bucket of each pre-token, where each distinct one is counted once and its count joined to the frequencies; the sums come back to the block. Pre-tokens that many texts of a block hold have a bucket for each of 64 groups of blocks, so none makes a large one. Ids are never kept. Null counts as empty, which has no tokens; texts of any length are whole; rows that repeat, or share an id, stay apart; an empty table gives an empty one; other columns of df play no part.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select(F.monotonically_increasing_id().alias("row"), "id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = rows.schema["id"].dataType.simpleString()
    buckets = max(BUCKETS, 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            texts = [f"▁{t}" if t else "" for t in batch.column(3).to_pylist()]
            for a, b in batches_of(texts, BLOCK):
                if len(names.names) > KEPT:
                    names.clear()
                block = batch.column(0)[a].as_py()
                found, wide, columns = dealt(texts[a:b], names, block, buckets)
                own = [lists(batch.column(k).slice(a, b - a), np.array([b - a])) for k in (1, 2)]
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(found), pa.array(np.full(n, wide)), *columns, *(pa.nulls(n, x.type) for x in own)], named)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([block % buckets]), pa.nulls(1, pa.bool_()), *(pa.nulls(1, x.type) for x in columns), *own], named)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            base = batch.filter(batch.column("ids").is_valid())
            if len(base):
                none = pa.nulls(len(base), pa.bool_()), *(pa.nulls(len(base), pa.binary()) for _ in range(2))
                yield pa.RecordBatch.from_arrays([base.column("block"), *none, base.column("ids"), base.column("bytes")], joined)
            for wide in (False, True):
                chosen = batch.filter(pa.compute.equal(batch.column("wide"), wide))
                for terms in parts(chosen, 3) if len(chosen) else ():
                    yield pa.RecordBatch.from_arrays([*(found := summed(terms, wide, known)), *(pa.nulls(len(found[0]), base.schema.field(c).type) for c in ("ids", "bytes"))], joined)

    def summed(terms: pa.RecordBatch, wide: bool, known: dict[str, int]) -> tuple[pa.Array, ...]:
        (data, _), (sizes, _), (lengths, _), (text, held), (times, _) = (numbers(terms.column(c), kind) for c, kind in zip(("words", "sizes", "lengths", "texts", "times"), kinds(wide), strict=True))
        bounds = np.append(0, np.cumsum(lengths, dtype=np.int64))
        words = pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).to_pylist()
        missing = list(set(words) - known.keys())
        if len(known) + len(missing) > KEPT:
            known.clear()
            missing = list(set(words))
        known.update(zip(missing, counter(model)(missing), strict=True))
        text = risen(text, sizes.astype(np.int64))
        n = np.repeat(np.fromiter(map(known.__getitem__, words), np.int64, len(words)), sizes)
        blocks, which = np.unique(terms.column("block").to_numpy(), return_inverse=True)
        span = int(text.max()) + 1
        keys, at = np.unique(np.repeat(which, held) * span + text, return_inverse=True)
        ends = np.searchsorted(keys, (np.arange(len(blocks)) + 1) * span)
        counts = np.bincount(at, n * times, len(keys)).astype(np.int64)
        broad = max(span - 1, int(counts.max(initial=0))) > NARROW
        texts = steps(keys % span, np.diff(ends, prepend=0))
        return pa.array(blocks), pa.array(np.full(len(blocks), broad)), *(cells(x.astype(np.uint64 if broad else np.uint16), ends) for x in (texts, counts))

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of each block, the row of its own comes first.
        ids, sizes, sums = None, None, np.zeros(0, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([ids, sizes, pa.array(sums), pa.array(sums > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])
        for batch in batches:
            for k in range(len(batch)):
                if batch.column("ids")[k].is_valid:
                    if ids is not None:
                        yield done()
                    ids, sizes = batch.column("ids")[k].values, batch.column("bytes")[k].values
                    sums = np.zeros(len(ids), np.int64)
                else:
                    kind = np.uint64 if batch.column("broad")[k].as_py() else np.uint16
                    (texts, held), (found, _) = (numbers(batch.column(c).slice(k, 1), kind) for c in ("texts", "sums"))
                    sums[risen(texts, held)] += found.astype(np.int64)
        if ids is not None:
            yield done()

    named, joined = ["block", "bucket", "wide", "words", "sizes", "lengths", "texts", "times", "ids", "bytes"], ["block", "broad", "texts", "sums", "ids", "bytes"]
    own = f"ids array<{kind}>, bytes array<long>"
    terms = rows.mapInArrow(split, f"block long, bucket long, wide boolean, words binary, sizes binary, lengths binary, texts binary, times binary, {own}").repartition("bucket").sortWithinPartitions("bucket")
    sums = terms.mapInArrow(join, f"block long, broad boolean, texts binary, sums binary, {own}").repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    return sums.mapInArrow(total, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
