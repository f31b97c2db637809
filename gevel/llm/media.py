"""Media columns: payloads under their digests in tar shards, and columns that are read from headers alone.

Each distinct payload is stored once for the whole table, in tar shards in a shared folder; a row keeps its digest and place. Texts that no other row can have go straight to the shards of the task that reads them; only those that may repeat are shuffled, to be made distinct. Payloads are grey 8-bit images (PNG), 576 samples wide. Columns of width, height and depth come from reading a range of 33 bytes; features from reading the stored bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gevel.llm.stages import new_path, written
from gevel.llm.words import parts

WIDTH, FILL = 576, 255
SHARD_BYTES = 256 << 20
HEADER = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Places that texts are hashed to; what shares its place with no other row can't repeat. Their bitmap has 8 MB.
SLOTS = 1 << 26


def payload(text: str) -> tuple[bytes, int]:
    """The text in UTF-8 filled up with bytes 255 to a positive multiple of 576, and its own length."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    return raw + bytes([FILL]) * (max(1, -(-n // WIDTH)) * WIDTH - n), n


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def image(samples: bytes) -> bytes:
    """A grey 8-bit PNG of 576 samples a row, without row filters."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(np.pad(rows, ((0, 0), (1, 0))).tobytes(), 6)) + _chunk(b"IEND", b"")


def header(stored: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first 33 bytes."""
    if stored[:8] != _SIGNATURE or stored[12:16] != b"IHDR":
        raise ValueError("not a stored image")
    return struct.unpack(">IIB", stored[16:25])


def samples(stored: bytes) -> bytes:
    """The samples of an image made by image()."""
    data, at = [], 8
    while at < len(stored):
        (n,) = struct.unpack(">I", stored[at : at + 4])
        if stored[at + 4 : at + 8] == b"IDAT":
            data.append(stored[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, WIDTH + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(values: bytes) -> str:
    """Mean, spread and entropy of the samples."""
    counts = np.bincount(np.frombuffer(values, np.uint8), minlength=256)
    share = counts[counts > 0] / len(values)
    x = np.arange(256)
    mean = float((counts * x).sum()) / len(values)
    spread = float((counts * (x - mean) ** 2).sum() / len(values)) ** 0.5
    return f"png {WIDTH}x{len(values) // WIDTH}x8 mean={mean:.3f} sd={spread:.3f} entropy={-(share * np.log2(share)).sum():.3f}"


class Shards:
    """Tar shards of one attempt of a task. They carry its number, so attempts don't touch each other's; which ones count is what the written index says."""

    def __init__(self, folder: str, task: int, attempt: int) -> None:
        self.store, self.folder = pafs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder, recursive=True)
        self.task, self.attempt, self.count, self.stream = task, attempt, 0, None

    def put(self, digest: str, stored: bytes) -> tuple[str, int, int]:
        """Shard, offset and length of a payload."""
        if self.stream is not None and self.at > SHARD_BYTES:
            self.close()
        if self.stream is None:
            self.name = f"part-{self.task:06d}-{self.attempt}-{self.count:04d}.tar"
            self.stream = self.store.open_output_stream(f"{self.folder}/{self.name}")
            self.at = 0
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(stored)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head + stored + bytes(-len(stored) % 512))
        place = (self.name, self.at + len(head), len(stored))
        self.at += len(head) + len(stored) + -len(stored) % 512
        return place

    def close(self) -> None:
        if self.stream is not None:
            self.stream.write(bytes(1024))
            self.stream.close()
            self.stream = None
            self.count += 1


def _may_repeat(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose texts no other row has, and those whose texts another row may have: hashes of texts that occur twice are marked in a bitmap."""
    slot = F.pmod(F.xxhash64("text"), F.lit(SLOTS)) + 1
    twice = rows.groupBy(slot.alias("slot")).agg(F.count("*").alias("n")).where("n > 1")
    marks = written(twice.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")), "media-marks")
    place = F.bitmap_bit_position(slot)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(marks), "bucket", "left").withColumn("twice", F.col("bits").isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1))
    return told.where(~F.coalesce("twice", F.lit(False))).select("id", "text"), told.where("twice").select("id", "text")


def _stored(df: DataFrame, folder: str, id_col: str, text_col: str, then: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Stores the payloads of df's texts; then() is applied to a table with a row for each payload, and the result has a row for each row of df."""
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "key", "n_bytes", "payload_bytes", "digest", "shard", "offset", "length"]
    alone, shared = _may_repeat(rows)
    key = F.sha2("text", 256)
    distinct = shared.select("text").distinct().select(F.lit(None).cast(kind).alias("id"), key.alias("key"), "text")
    every = alone.select("id", F.lit(None).cast("string").alias("key"), "text").unionAll(distinct)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shards = Shards(folder, context.partitionId(), context.taskAttemptId())
        for batch in (part for whole in batches for part in parts(whole, 2)):
            out: list[list] = [[] for _ in names[2:]]
            for text in batch.column(2):
                data, n = payload(text.as_py())
                digest = hashlib.sha256(data).hexdigest()
                for column, x in zip(out, (n, len(data), digest, *shards.put(digest, image(data))), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names)
        shards.close()

    index = written(every.mapInArrow(work, f"id {kind}, key string, n_bytes long, payload_bytes long, digest string, shard string, offset long, length long"), "media-index")
    single = then(index.where("key is null").drop("key"))
    copies = shared.select("id", key.alias("key")).join(then(index.where("key is not null").drop("id")), "key").select(single.columns)
    return single.unionAll(copies).withColumnRenamed("id", id_col)


def store_texts(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text's payload below folder (a URI that all executors reach): (id_col, n_bytes, payload_bytes, digest, shard, offset, length).

    digest is the payload's SHA-256; length counts the stored bytes. Rows of equal texts share one stored payload. Null counts as empty, which is 576 bytes of filling. Payloads are stored when this is called, not when the result is read.
    """
    return _stored(df, folder, id_col, text_col, lambda index: index)


def _reader(folder: str):
    """Reads ranges of shards, keeping the last few open."""
    store, root = pafs.FileSystem.from_uri(folder)
    held: OrderedDict[str, pa.NativeFile] = OrderedDict()

    def read(shard: str, offset: int, length: int) -> bytes:
        if shard not in held:
            if len(held) >= 4:
                held.popitem(last=False)[1].close()
            held[shard] = store.open_input_file(f"{root}/{shard}")
        return held[shard].read_at(length, offset)

    return read


def with_metadata(index: DataFrame, folder: str) -> DataFrame:
    """Adds (width int, height int, bits int) from each payload's header, by reading 33 bytes of it."""
    places = index.schema.names.index("shard"), index.schema.names.index("offset")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            found = [header(read(s, o, HEADER)) for s, o in zip(*(batch.column(c).to_pylist() for c in places), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x[k] for x in found], pa.int32()) for k in range(3))], [*batch.schema.names, "width", "height", "bits"])

    return index.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", width int, height int, bits int")


def with_features(index: DataFrame, folder: str) -> DataFrame:
    """Adds (payload_sha256, tail_crc32, media_bytes, media_sha256, feature), all from the stored bytes as read back."""
    names = index.schema.names
    at = [names.index(n) for n in ("shard", "offset", "length")]

    def of(stored: bytes) -> tuple[str, int, int, str, str]:
        values = samples(stored)
        return hashlib.sha256(values).hexdigest(), zlib.crc32(values[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _reader(folder)
        for batch in batches:
            found = [of(read(*place)) for place in zip(*(batch.column(c).to_pylist() for c in at), strict=True)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            added = [pa.array([x[k] for x in found], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in index.schema) + ", payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return index.mapInArrow(work, schema)


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores all texts as media, then (id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, digest, shard, offset, length, width, height, bits) of each row.

    Without a folder, a new one in the cluster's shared folder is used. Equal texts have equal values and share one stored payload, whose features are read once; repeated rows stay; texts of any length are stored whole; an empty table gives an empty one; other columns of df play no part.
    """
    folder = folder or new_path(df.sparkSession, "media")
    return _stored(df, folder, id_col, text_col, lambda index: with_features(with_metadata(index, folder), folder))
