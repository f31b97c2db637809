"""Toxicity scores by logistic regression, learned with FTRL-proximal over hashed word n-grams.

Features are the presence of words and of their stems (first letters), of pairs of neighbouring words, and of pairs with one word between, each hashed to a place. Every place has its own learning rate; the L1 term keeps most weights at zero, so the model is a short list of places and weights that goes to every task (PLACES of them at the very most, 34 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from gevel.llm.stages import frugal, written
from gevel.llm.words import ALNUM, hashed, mixed, parts, slices, split_words, text_bytes

PLACES = 1 << 21
#: Labelled rows that the model is fitted on, at most (about; taken by a hash of the id), and passes over them.
SAMPLE, PASSES = 12_000, 4
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 1.0
#: What a toxic row weighs in learning, as such rows are few.
POSITIVE = 1.0
#: Bytes of a word that make a stem of it, if it is longer.
STEMS = (4, 5)
#: The bias where there is nothing to learn from: no text is toxic then.
NOTHING = -35.0


def features(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of every word, stem, pair and pair with a gap."""
    low, begins, ends, first = split_words(raw, starts, ALNUM)
    words = hashed(low, begins, ends)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places, texts = [words], [owner]
    for size in STEMS:
        long = ends - begins > size
        places.append(mixed(hashed(low, begins[long], begins[long] + size) + np.uint64(size)))
        texts.append(owner[long])
    for gap in (1, 2):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            places.append(mixed(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + words[gap:] + np.uint64(gap))[same])
            texts.append(owner[gap:][same])
    return (np.concatenate(places) & np.uint64(PLACES - 1)).astype(np.int64), np.concatenate(texts)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(places, weights, bias) after PASSES over rows of distinct places (numbers of 32 bits)."""
    z, n = np.zeros(PLACES + 1), np.zeros(PLACES + 1)

    def weights(at: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z[at]) <= L1, 0.0, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for x, y in zip(rows, labels, strict=True):
            at = np.append(x.astype(np.int64), PLACES)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y) * (POSITIVE if y else 1.0)
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange(PLACES + 1))
    kept = np.flatnonzero(every[:-1])
    return kept, every[kept], float(every[-1])


def fold(ident: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(ident.cast("string")) % parts


def train(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of the labelled rows; labels (id_col, label_col 0/1) are sampled to SAMPLE rows first, so only those texts go to the one task that fits it."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    share = min(1.0, SAMPLE / max(1, marked.count()))
    marked = marked.where(F.expr(f"(xxhash64(id) & {(1 << 53) - 1}) <= {share * (1 << 53)!r}")).limit(2 * SAMPLE)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(marked), "id").select("text", "y")

    def hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b in slices(batch.column(0)):
                place, text = features(*text_bytes(batch.column(0).slice(a, b - a)))
                ends = np.searchsorted(text[order := np.argsort(text, kind="stable")], np.arange(b - a + 1))
                found += [np.unique(place[order[i:j]]).astype("<u4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1)], ["x", "y"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = sorted({(x, y) for batch in batches for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}, key=lambda e: (hash_of(e[0]), e))
        if not examples:
            place, weight, bias = np.zeros(0, np.int64), np.zeros(0), NOTHING
        else:
            place, weight, bias = fit([np.frombuffer(x, "<u4") for x, _ in examples], np.array([y for _, y in examples]))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(place, -1)), pa.array(np.append(weight, bias))], ["place", "weight"])

    hashed_rows = written(rows.mapInArrow(frugal(hash_rows), "x binary, y int"), "examples")
    model = hashed_rows.repartition(1).mapInArrow(frugal(learn), "place long, weight double").toArrow()
    place, weight = model["place"].to_numpy(), model["weight"].to_numpy()
    return place[place >= 0], weight[place >= 0], float(weight[place < 0].sum())


def hash_of(x: bytes) -> int:
    """An order of examples that doesn't depend on how they arrive."""
    return int(mixed(np.array([len(x)], np.uint64) + np.frombuffer(x[:4] or b"\0\0\0\0", "<u4").astype(np.uint64))[0])


def score(df: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of df and, by the names given, (score double, predicted int): how likely the text is toxic, 1 from 0.5 on. A null text counts as empty, whose score is that of the bias. Repeated rows stay; columns of df with these names are replaced."""
    rest = [c for c in df.columns if c not in names]
    rows = df.select(*(F.col(f"`{c}`") for c in rest))
    at = rest.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, weight, bias = shared.value
        table = np.zeros(PLACES, np.float32)
        table[place] = weight
        for batch in (part for whole in batches for part in parts(whole, at)):
            texts = batch.column(at)
            totals = np.full(len(texts), bias)
            for a, b in slices(texts):
                places, owner = features(*text_bytes(texts.slice(a, b - a)))
                # Each feature counts once in a text; most have no weight.
                some = np.flatnonzero(table[places])
                pairs = np.unique(owner[some] * PLACES + places[some])
                totals[a:b] += np.bincount(pairs // PLACES, table[pairs % PLACES], b - a)
            p = 1 / (1 + np.exp(-np.clip(totals, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, *names])

    return rows.mapInArrow(frugal(work), StructType([*rows.schema.fields, StructField(names[0], DoubleType()), StructField(names[1], IntegerType())]))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] = (5, 0)) -> DataFrame:
    """(id_col, held_out, score, predicted) of each row of df.

    The model is learned from labels of rows whose crc32(id as text) modulo held_out[0] is not held_out[1]; held_out tells the others. Without any labelled row every score is about 0. A null id is held out of learning and has held_out null; an empty table gives an empty one.
    """
    parts, out = held_out
    model = train(df, labels.where(fold(F.col(id_col), parts) != out), id_col, text_col, label_col)
    scored = score(df.select(F.col(id_col).alias("id"), (fold(F.col(id_col), parts) == out).alias("held_out"), F.col(text_col).cast("string").alias("text")), model)
    return scored.select(F.col("id").alias(id_col), "held_out", "score", "predicted")
