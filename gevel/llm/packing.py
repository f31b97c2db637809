"""Packing of texts into training sequences by deficit round-robin over source queues.

Each source is a queue in a fixed pseudo-random order. A round adds to each queue's deficit its quantum (its share of a window's tokens) and serves the tokens that the deficit covers; what is left of one, below a token, is carried to the next round. Texts may be cut, so the tokens of round k are those from floor(k * quantum) to floor((k + 1) * quantum) of each queue, which prefix sums give without a sequential pass: counts within buckets of a queue, then over the buckets. A round is a window; within it the queues take turns in proportion. Windows follow each other without a gap and are cut every `length` tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gevel.llm.stages import frugal, written
from gevel.llm.tokenizer_files import byte_level
from gevel.llm.words import parts

#: Buckets of a queue, so that a source with most of the rows is no single group: as many as so many rows of all sources need, and these at least.
BUCKET_ROWS, BUCKETS = 1 << 16, 256
#: Groups of windows whose totals are added up at the end, at most.
BLOCKS = 4096


def tokenized(df: DataFrame, id_col: str, text_col: str, source_col: str, ranks: str) -> DataFrame:
    """(row, id, queue, n, ids): token ids of each text and the end id, as little-endian numbers of 16 bits, or 32 for large vocabularies."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("queue"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_level(ranks)
        end = encoding.n_vocab - 1
        dtype = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
        last = np.zeros(1, dtype)
        for batch in (part for whole in batches for part in parts(whole, 2)):
            ids, n = [], []
            for text in batch.column(2):
                found = encoding.encode(text.as_py() or "", allowed_special="all")
                n.append(len(found) + 1)
                ids.append(np.concatenate([np.array(found, dtype), last]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["id", "queue", "n", "ids"])

    return rows.mapInArrow(frugal(work), f"id {kind}, queue string, n long, ids binary").withColumn("row", F.monotonically_increasing_id())


def placed(sizes: DataFrame, window: int, shares: Mapping[str, float] | None) -> DataFrame:
    """(row, start, size, window_id, at): where in the packed stream which tokens of each row of sizes (row, queue, n) begin; a row has as many parts as windows that it reaches into."""
    if shares and min(shares.values()) <= 0:
        raise ValueError("shares must be above 0: each token has a place")
    total, rows = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    keyed = sizes.withColumn("bucket", F.expr(f"pmod(xxhash64(row), {max(BUCKETS, -(-rows // BUCKET_ROWS))})"))
    inside = F.sum("n").over(Window.partitionBy("queue", "bucket").orderBy("row"))
    queued = keyed.withColumn("upto", inside)
    buckets = keyed.groupBy("queue", "bucket").agg(F.sum("n").alias("tokens"))
    ahead = F.sum("tokens").over(Window.partitionBy("queue").orderBy("bucket")) - F.col("tokens")
    buckets = buckets.select("queue", "bucket", ahead.alias("ahead"), F.sum("tokens").over(Window.partitionBy("queue")).alias("all"))
    if shares:
        weights = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))
        quantum = F.coalesce(F.try_element_at(weights, F.col("queue")), F.lit(min(shares.values()))) / F.lit(sum(shares.values())) * window
    else:
        quantum = F.col("all") / F.lit(max(total, 1)) * window
    spans = queued.join(buckets, ["queue", "bucket"]).select("row", "queue", quantum.alias("quantum"), (F.col("ahead") + F.col("upto")).alias("upto"), "n")
    # A queue with less than a token for each window is served token by token, so a row has at most as many parts as tokens or windows.
    windows = "sequence(greatest(0L, cast(floor((upto - n) / quantum) as long) - 1), cast(floor(upto / quantum) as long) + 1)"
    many = F.expr(f"transform({windows}, w -> struct(w as window_id, greatest(upto - n, cast(floor(w * quantum) as long)) as first, least(upto, cast(floor((w + 1) * quantum) as long)) as end))")
    few = F.expr("transform(sequence(upto - n, upto - 1), t -> struct(cast(ceil((t + 1) / quantum) as long) - 1 as window_id, t as first, t + 1 as end))")
    spans = spans.withColumn("part", F.explode(F.when(F.col("quantum") >= 1, many).otherwise(few)))
    spans = spans.select("row", "queue", "quantum", "upto", "n", "part.window_id", "part.first", (F.col("part.end") - F.col("part.first")).alias("size"))
    # Queues take turns within a window: what stands as far into its queue's part of it is side by side.
    served = spans.where("size > 0").select("row", "queue", "window_id", F.expr("first - (upto - n)").alias("start"), "size", F.expr("(first + size) / quantum").alias("turn"))
    within = F.sum("size").over(Window.partitionBy("window_id").orderBy("turn", "queue", "row", "start")) - F.col("size")
    served = written(served.select("row", "start", "window_id", "size", within.alias("within")), "served")
    windows = served.groupBy("window_id").agg(F.sum("size").alias("tokens"))
    count = (windows.agg(F.max("window_id")).first()[0] or 0) + 1
    block = F.expr(f"window_id div {max(1, -(-count // BLOCKS))}")
    windows = windows.withColumn("block", block).withColumn("before", F.sum("tokens").over(Window.partitionBy("block").orderBy("window_id")) - F.col("tokens"))
    blocks = windows.groupBy("block").agg(F.sum("tokens").alias("size"))
    blocks = blocks.select("block", (F.sum("size").over(Window.orderBy("block")) - F.col("size")).alias("start"))
    windows = windows.join(blocks, "block").select("window_id", (F.col("start") + F.col("before")).alias("first"))
    return served.join(windows, "window_id").select("row", "start", "size", "window_id", (F.col("first") + F.col("within")).alias("at"))


def pack(
    df: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length: int = 1024, window: int = 1 << 16, shares: Mapping[str, float] | None = None
) -> DataFrame:
    """Pieces of texts in sequences: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id, ids).

    A text is its ids and the id 0; each id is in exactly one piece. All sequences hold `length` ids but the last, which is shorter only by what is missing at the end of the corpus. Texts are also cut where windows end. Windows of about `window` tokens hold each source in its share, as long as it has tokens, to the token: `shares` (a bounded setting; sources it lacks get the least of them), or, by default, its share of all tokens. Null and empty texts are one id; a null source is the queue ''; repeated rows and ids are packed each for itself; an empty table gives an empty one. `ids` are the piece's ids as unsigned 32-bit little-endian numbers.
    """
    tokens = written(tokenized(df, id_col, text_col, source_col, ranks), "tokens")
    places = placed(tokens.select("row", "queue", "n"), window, shares)
    width = F.expr("cast(octet_length(ids) div n as int)")
    part = F.substring("ids", F.col("start").cast("int") * width + 1, F.col("size").cast("int") * width)
    both = tokens.join(places, "row").select("id", "n", part.alias("ids"), "window_id", "at", "start", "size")
    kind = both.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole, 2)):
            rows: list[list] = [[] for _ in range(8)]
            index = []
            for k, (n, ids, window_id, at, start, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(1, 7)), strict=True)):
                wide = np.frombuffer(ids, f"<u{len(ids) // whole}").astype("<u4")
                begin = 0
                while begin < whole:
                    sequence, offset = divmod(at + begin, length)
                    size = min(whole - begin, length - offset)
                    piece = wide[begin : begin + size].tobytes()
                    index.append(k)
                    for values, x in zip(rows, (start + begin, size, zlib.crc32(piece), n, sequence, offset, window_id, piece), strict=True):
                        values.append(x)
                    begin += size
            arrays = [batch.column(0).take(pa.array(index, pa.int64())), *(pa.array(x, pa.int64()) for x in rows[:7]), pa.array(rows[7], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id", "ids"])

    out = both.mapInArrow(frugal(cut), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long, ids binary")
    return out.withColumnRenamed("id", id_col)
