"""Media payloads in content-defined chunks: gear hash cuts, chunks stored once by digest, media rebuilt from chunk lists.

The gear hash of the 32 bytes up to a place is the sum of a random number a byte, each doubled once a step. A chunk ends
where its upper CUT_BITS bits are 0, but holds at least LEAST and at most MOST bytes. The 32-byte window is summed up in five
vectorised doublings instead of byte by byte.

Storing moves only bytes that occur more than once. First all chunk digests are counted by Spark. Media none of whose
chunks occurs twice keep their chunks in their own row. The chunks of the others are dealt out by digest, kept once,
and joined to the ordered chunk lists when the media are read. Which media are which is told by a bounded hash filter; one
that it takes for shared wrongly only takes the longer way. Every chunk's digest and the whole's are verified on reading.

Defined results: a null text counts as empty; an empty text has a payload of 576 bytes of 255. Equal media share all their
chunks and are rebuilt once. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tidemark.llm.common import HashFilter, map_arrow, pieces, quoted, stored

WIDTH = 576  # samples in a row of the stored image
CUT_BITS, LEAST, MOST = 11, 512, 8192
#: The stored tables hold all payloads, so they are written small: a higher level, and pages that span many texts.
SMALL = {"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
_GEAR = np.random.default_rng(1997).integers(0, 1 << 32, 256, dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (max(WIDTH, -(-len(raw) // WIDTH) * WIDTH) - len(raw))


def to_media(payload: bytes) -> bytes:
    """A binary greyscale image (PGM) with 8-bit samples, WIDTH a row."""
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_media(media: bytes) -> bytes:
    magic, size, most, samples = media.split(b"\n", 3)
    width, height = map(int, size.split())
    if magic != b"P5" or most != b"255" or len(samples) != width * height:
        raise ValueError("not a stored image")
    return samples


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h = more
    ends, start, n = [], 0, len(data)
    for end in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            ends.append(start)
        if end - start >= LEAST:
            ends.append(end)
            start = end
    while n - start > MOST:
        start += MOST
        ends.append(start)
    return ends if start == n else [*ends, n]


def chunks_of(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends], ends)]


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _low(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<i8")


@dataclass
class MediaStore:
    """objects: id, key (digest of the media), n_bytes (of the text), shared, digests (in order), chunks (unless shared).
    chunks: digest, data; one row a digest."""

    objects: DataFrame
    chunks: DataFrame


def store(docs: DataFrame, text: str = "text", key: str = "doc_id") -> MediaStore:
    """Writes docs' texts as media; both tables lie in the shared folder."""
    given = docs.select(quoted(key).alias("id"), quoted(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text", 16 << 20):
            found = Counter(digest(c) for t in batch.column("_text").to_pylist() for c in chunks_of(to_media(payload_of(t))))
            names = list(found)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(_low(names), pa.int64()), pa.array(list(found.values()), pa.int64())], ["digest", "low", "n"])

    counted = given.select("_text").transform(map_arrow, count, "digest binary, low long, n long")
    shared = stored(counted.groupBy("digest", "low").agg(F.sum("n").alias("n")).where("n > 1").select("low"), "media-shared")
    sent = docs.sparkSession.sparkContext.broadcast(HashFilter.build(shared, "low"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, int, bool, list[bytes], list[bytes]]]]]:
        for batch in pieces(batches, "_text"):
            rows = []
            for t in batch.column("_text").to_pylist():
                media = to_media(payload_of(t))
                parts = chunks_of(media)
                names = [digest(c) for c in parts]
                rows.append((digest(media), len((t or "").encode("utf-8", "surrogatepass")), bool(sent.value.hits(_low(names)).any()), names, parts))
            yield batch, rows

    def objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows in split(batches):
            columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows])]
            columns += [pa.array([r[3] for r in rows], pa.list_(pa.binary())), pa.array([None if r[2] else r[4] for r in rows], pa.list_(pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "key", "n_bytes", "shared", "digests", "chunks"])

    def loose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in split(batches):
            found = {d: c for r in rows if r[2] for d, c in zip(r[3], r[4])}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], ["digest", "data"])

    head = given.schema["id"]
    schema = f"id {head.dataType.simpleString()}, key binary, n_bytes long, shared boolean, digests array<binary>, chunks array<binary>"
    kept = stored(given.transform(map_arrow, objects, schema), "media-objects", **SMALL)
    single = stored(given.select("_text").transform(map_arrow, loose, "digest binary, data binary").groupBy("digest").agg(F.any_value("data").alias("data")), "media-chunks", **SMALL)
    return MediaStore(kept, single)


def verified(key: bytes, digests: list[bytes], parts: list[bytes]) -> bytes:
    if len(digests) != len(parts) or any(digest(p) != d for p, d in zip(parts, digests)):
        raise ValueError(f"a chunk of {key.hex()} differs from its digest")
    media = b"".join(parts)
    if digest(media) != key:
        raise ValueError(f"{key.hex()} can't be rebuilt")
    return media


def read(kept: MediaStore, use: Callable[[bytes], tuple] = lambda media: (media,), fields: StructType = StructType([StructField("media", BinaryType())])) -> DataFrame:
    """id, n_bytes and what `use` makes of each rebuilt media (a tuple for `fields`; the media themselves unless given)."""
    names = fields.names

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.drop_columns([c for c in ("digests", "chunks") if c in batch.schema.names])
            rows = [use(verified(*r)) for r in zip(*(batch.column(c).to_pylist() for c in ("key", "digests", "chunks")))]
            columns = [[r[i] for r in rows] for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *(pa.array(c, k) for c, k in zip(columns, kinds))], [*rest.schema.names, *names])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    add = lambda df: df.transform(map_arrow, rebuild, StructType([*df.drop("digests", "chunks").schema.fields, *fields.fields]))
    own = add(kept.objects.where("not shared").select("id", "key", "n_bytes", "digests", "chunks")).drop("key")
    lists = kept.objects.where("shared").select("id", "key", "n_bytes", "digests")
    parts = lists.groupBy("key").agg(F.any_value("digests").alias("digests")).select("key", "digests", F.posexplode("digests").alias("place", "digest"))
    parts = parts.drop("digests").join(kept.chunks, "digest").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "data"))).alias("p"))
    rebuilt = add(parts.select("key", F.col("p.digest").alias("digests"), F.col("p.data").alias("chunks")))
    return own.unionByName(lists.drop("digests").join(rebuilt, "key").drop("key"))


def describe(media: bytes) -> tuple[int, str, int, int, str, str]:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (rows, sum and a 16-bin histogram)."""
    payload = from_media(media)
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16)
    feature = f"rows={len(samples) // WIDTH};sum={int(samples.sum(dtype=np.int64))};hist={','.join(map(str, bins.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


DESCRIBED = StructType([StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())])


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read(store(docs), describe, DESCRIBED).withColumnRenamed("id", "doc_id")
