"""Ranked lexical search: the best documents of each query by weights of its terms.

Documents are numbered as they are read, and their postings, of the terms that any query holds, are stored by windows of so many numbers: for each window, each term's places in it. A query goes through a window term by term and adds what each posting is worth at its place in an array of the window's size; a set of bits says which places any of its terms met. Only these are looked at then, and the best go into the query's heap.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gevel.llm.stages import dropped, written

#: Documents of a window, so that its array of scores stays in a core's cache (128 KB), and postings after which a window ends before that.
WINDOW, POSTINGS = 16_384, 2_000_000
#: Bytes of text that are cut into terms at once; bytes of queries that tasks get at once.
CHUNK, QUERIES = 4 << 20, 32 << 20
#: Parts of the tasks whose best are compared first.
SALTS = 64
#: Fixed values of the score.
SCALE, FLAT, STEEP = 1_000_000_000, 75, 25
#: Stands for a null id while ids are compared.
NO_ID = 2**63 - 1

#: Each byte that ends a term as a space, A to Z as a to z. Bytes of other signs than ASCII's stay, so terms are cut in UTF-8 as they would be in text.
_TERM_BYTES = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()

WINDOWS = "n_docs long, n_terms long, ids array<long>, lengths array<long>, terms array<int>, counts array<int>, places binary, wide int, times binary"


def term_counts(text: bytes) -> Counter[bytes]:
    """How often each term occurs in a whole text."""
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(text):
        end = at + CHUNK
        # The chunk ends where a term does.
        while end < len(text) and _TERM_BYTES[text[end]] != 32:
            end += 1
        found.update(text[at:end].translate(_TERM_BYTES).split())
        at = end
    return found


class _Builder:
    """Gathers documents until they fill a window."""

    def __init__(self, known: dict[bytes, int]) -> None:
        self.known = known
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.terms: list[int] = []
        self.times: list[int] = []
        self.ends: list[int] = []

    def add(self, doc: int | None, counts: Counter[bytes]) -> bool:
        """Adds a document; whether the window is full."""
        for term, times in counts.items():
            k = self.known.get(term)
            if k is not None:
                self.terms.append(k)
                self.times.append(times)
        self.ids.append(doc)
        self.lengths.append(counts.total())
        self.ends.append(len(self.terms))
        return len(self.ids) == WINDOW or len(self.terms) >= POSTINGS

    def window(self) -> pa.RecordBatch:
        terms, times = np.array(self.terms, np.int32), np.array(self.times, np.int64)
        places = np.repeat(np.arange(len(self.ids), dtype=np.uint16), np.diff(self.ends, prepend=0))
        order = np.argsort(terms, kind="stable")
        kinds, counts = np.unique(terms, return_counts=True)
        wide = 1 if not len(times) or times.max() < 256 else 8
        row = {
            "n_docs": [len(self.ids)], "n_terms": [sum(self.lengths)], "ids": [self.ids], "lengths": [self.lengths], "terms": [kinds], "counts": [counts.astype(np.int32)],
            "places": [places[order].tobytes()], "wide": [wide], "times": [times[order].astype(f"u{wide}").tobytes()],
        }
        kind = {"n_docs": pa.int64(), "n_terms": pa.int64(), "ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int64()), "terms": pa.list_(pa.int32()), "counts": pa.list_(pa.int32()), "places": pa.binary(), "wide": pa.int32(), "times": pa.binary()}
        self.clear()
        return pa.RecordBatch.from_pydict(row, pa.schema(kind))


@dataclass
class Block:
    """Some queries: their terms' numbers and how often each query has each; which query each is, and its id."""

    known: dict[bytes, int]
    queries: list[tuple[np.ndarray, np.ndarray]]
    ids: list[object]


def blocks(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The queries in blocks of a bounded size; a longer query is a block of its own. The driver holds one block."""
    block, size = Block({}, [], []), 0
    for r in queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").toLocalIterator(prefetchPartitions=False):
        counts = term_counts(r["text"].encode())
        if not counts:
            continue
        needs = sum(len(t) + 100 for t in counts)
        if block.queries and size + needs > QUERIES:
            yield block
            block, size = Block({}, [], []), 0
        size += needs
        block.queries.append((np.array([block.known.setdefault(t, len(block.known)) for t in counts]), np.array(list(counts.values()))))
        block.ids.append(r["id"])
    if block.queries:
        yield block


def postings(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Windows of all documents that have a term, with the postings of known terms."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = _Builder(shared.value)
        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                counts = term_counts(text.as_buffer().to_pybytes())
                if counts and builder.add(doc.as_py(), counts):
                    yield builder.window()
        if builder.ids:
            yield builder.window()

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).where("text is not null").mapInArrow(windows, WINDOWS)


class Heaps:
    """For each query the best documents so far, the worst of them on top."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.heaps = k, [[] for _ in range(n)]

    def add(self, query: int, scores: np.ndarray, ids: np.ndarray) -> None:
        heap = self.heaps[query]
        least = max(heap[0][0] if len(heap) == self.k else 1, int(np.partition(scores, -self.k)[-self.k]) if len(scores) > self.k else 1)
        for s, i in zip(scores[good := scores >= least].tolist(), ids[good].tolist(), strict=True):
            if len(heap) < self.k:
                heapq.heappush(heap, (s, -i))
            elif (s, -i) > heap[0]:
                heapq.heapreplace(heap, (s, -i))


def search_window(row: dict, weights: np.ndarray, n_docs: int, n_terms: int, queries: list[tuple[np.ndarray, np.ndarray]], heaps: Heaps) -> None:
    """All queries over one window."""
    size = len(row["ids"])
    ids = np.array([NO_ID if i is None else i for i in row["ids"]], np.int64)
    lengths = np.array(row["lengths"], np.int64)
    if STEEP * int(lengths.max()) * n_docs >= 2**63:
        lengths = lengths.astype(object)
    spread = (FLAT + STEEP * lengths * n_docs // n_terms).astype(np.int64)
    places = np.frombuffer(row["places"], np.uint16).astype(np.int64)
    times = np.frombuffer(row["times"], f"u{row['wide']}").astype(np.int64)
    worth = SCALE * times // (1000 * times + 12 * spread[places])
    ends = np.cumsum(row["counts"])
    at = np.full(len(weights), -1, np.int64)
    at[row["terms"]] = np.arange(len(ends))
    begins = ends - row["counts"]
    bits: dict[int, np.ndarray] = {}
    scores, met = np.zeros(size, np.int64), np.zeros((size + 7) // 8, np.uint8)
    for q, (terms, times_asked) in enumerate(queries):
        here = at[terms]
        if not (here >= 0).any():
            continue
        met[:] = 0
        for k, factor in zip(here[here >= 0].tolist(), (weights[terms] * times_asked)[here >= 0].tolist(), strict=True):
            span = slice(begins[k], ends[k])
            scores[places[span]] += factor * worth[span]
            if k not in bits:
                one = np.zeros(size, bool)
                one[places[span]] = True
                bits[k] = np.packbits(one)
            met |= bits[k]
        seen = np.flatnonzero(np.unpackbits(met, count=size))
        heaps.add(q, scores[seen], ids[seen])
        scores[seen] = 0


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, doc_id: str = "doc_id", doc_text: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The k documents of the highest scores above 0 for each query: query_id, rank (from 1), doc_id, score; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and of all other signs than ASCII's, A to Z in lower case, in whole texts. Null and empty texts, and those of other signs only, have none: such documents don't count, and such queries get no rows. Each row of docs is a document, each row of queries a query: rows that repeat an id are ranked each for itself. Documents with a null id count like others and come last among equal scores (so does the id 2^63 - 1, which comes back as null). Ids of documents are whole numbers; other columns don't matter.

    Queries are taken in blocks of 32 MB, and docs are read once for each block; benchmarks fit in one. A task holds one window, the block, and k documents for each of its queries. The windows are written to the shared folder while a block is answered; what stays is the best that each task found.
    """
    spark = docs.sparkSession
    kind = queries.schema[query_id].dataType.simpleString()
    out = spark.createDataFrame([], f"`{query_id}` {kind}, rank int, `{doc_id}` long, score long")
    for block in blocks(queries, query_id, query_text):
        windows = written(postings(docs, block.known, doc_id, doc_text), "windows")
        total = windows.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if total[0] is None:
            dropped(windows)
            continue
        n_docs, n_terms = total
        holding = windows.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
        weights = np.zeros(len(block.known), np.int64)
        for term, df in holding.collect():
            weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
        shared = spark.sparkContext.broadcast((weights, block.queries))

        def best(batches: Iterator[pa.RecordBatch], shared=shared, n_docs=n_docs, n_terms=n_terms) -> Iterator[pa.RecordBatch]:
            weights, queries = shared.value
            heaps = Heaps(len(queries), k)
            for b in batches:
                for i in range(len(b)):
                    search_window(b.slice(i, 1).to_pylist()[0], weights, n_docs, n_terms, queries, heaps)
            found = [(q, None if -i == NO_ID else -i, s) for q, heap in enumerate(heaps.heaps) for s, i in heap]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "doc", "score"])

        top = written(windows.mapInArrow(best, "query int, doc long, score long").withColumn("part", F.spark_partition_id() % SALTS), "best")
        dropped(windows)
        order = F.desc("score"), F.asc_nulls_last("doc")
        for keys in (("query", "part"), ("query",)):
            top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame([(q, i) for q, i in enumerate(block.ids)], f"query int, id {kind}")
        out = out.unionByName(top.join(names, "query").select(F.col("id").alias(query_id), "rank", F.col("doc").alias(doc_id), "score"))
    return out


def oracle_sql(k: int = 20) -> str:
    """The same in SQL."""
    letters = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
with words as (select doc_id, unnest({letters}) as term from documents where text is not null),
held as (select doc_id, term, count(*) as tf from words group by all),
sizes as (select doc_id, sum(tf)::bigint as n from held group by doc_id),
total as (select count(*) as big_n, sum(n)::bigint as big_l from sizes),
weights as (select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * count(*) + 1)::double))::bigint as w from held, total group by term, big_n),
spreads as (select doc_id, 75 + (25 * n * big_n) // big_l as m from sizes, total),
asked as (select item_id, term, count(*) as times from (select item_id, unnest({letters}) as term from benchmark where text is not null) group by all),
scored as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from asked join held using (term) join weights using (term) join spreads using (doc_id) group by all
)
select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from scored where score > 0
qualify rank <= {k}"""
