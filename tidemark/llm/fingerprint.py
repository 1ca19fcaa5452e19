"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its lower-cased words with their counts. For each of SAMPLES positions and each term,
r and c are drawn from Gamma(2, 1) and b from the uniform distribution, all fixed by term and position alone. With weight S,
t = floor(ln S / r + b), ln y = r (t - b) and ln a = ln c - ln y - r; the term with the least a is sampled and (term, t) is
the sample. Two documents agree at a position with probability equal to their generalised Jaccard similarity
(sum of least over sum of greatest weights). Samples are kept as 16 bits, so unequal ones agree by chance once in 65,536.

The random numbers are made from the bits of three hashes of term and position, so each pair of these has draws of its own:
r and c are -ln of a product of two uniform numbers of 32 bits, b has 48 bits.

Defined results: a null text counts as empty; a text without words has the fingerprint of zeros, alike (1.0) to another
such one and to nothing else (0.0). Equal texts have equal fingerprints, and texts may be of any length. Rows with equal keys
follow each other by digest of their text, null keys are last; equal rows are interchangeable. Keys that aren't integers are
refused. An empty table gives an empty result. Columns of the input are kept by fingerprint(), whatever their names, but for
one named as the result; compare_with_edited() reads the key and text alone.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegralType, LongType, StringType, StructField, StructType

from tidemark.llm.common import CACHES, map_arrow, map_text, mix64, pieces, quoted, text_hash

SAMPLES = 64
BUCKET_BYTES = 8 << 20
MOST_BUCKETS = 100_000
_words = re.compile(r"\w+").findall
_LOW, _S16, _S32 = np.uint64(0xFFFF), np.uint64(16), np.uint64(32)
_R, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
AT_ONCE = 1024  # terms whose draws are made together


def gamma(bits: np.ndarray) -> np.ndarray:
    """Gamma(2, 1) numbers from 64 random bits each: -ln of the product of two uniform numbers."""
    return -np.log(((bits >> _S32) + 0.5) * ((bits & np.uint64(0xFFFFFFFF)) + 0.5) * 2.0**-64)


class Sampler:
    def __init__(self, samples: int = SAMPLES, most: int = 200_000) -> None:
        self.salts = mix64(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.samples, self.most = samples, most
        self.place: dict[tuple[str, int], int] = {}
        self.table = np.zeros((1024, samples), np.uint64)

    @staticmethod
    def ordered(ln_a: np.ndarray) -> np.ndarray:
        """32 bits that order as the numbers do, moved up by 16."""
        bits = ln_a.astype(np.float32).view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(16)

    def rows(self, terms: list[tuple[str, int]]) -> np.ndarray:
        """A row a term: per position ln a in order-keeping bits, above 16 bits that stand for (term, t)."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w, _ in terms), np.uint64, len(terms))
        weights = np.fromiter((n for _, n in terms), np.float64, len(terms))
        out = np.empty((len(terms), self.samples), np.uint64)
        for i in range(0, len(terms), AT_ONCE):
            self._draw(h[i : i + AT_ONCE], weights[i : i + AT_ONCE], out[i : i + AT_ONCE])
        return out

    def _draw(self, h: np.ndarray, weights: np.ndarray, out: np.ndarray) -> None:
        m = mix64(h[:, None] ^ self.salts[None, :])
        r, b = gamma(mix64(m + _R)), (m >> _S16) * 2.0**-48
        ln_a = np.log(gamma(mix64(m + _C))) + r * b - r  # weight 1: t is 0
        code = m & _LOW
        if len(more := np.flatnonzero(weights > 1)):
            t = np.floor(np.log(weights[more])[:, None] / r[more] + b[more])
            ln_a[more] -= r[more] * t
            code[more] = np.where(t == 0, m[more], mix64(m[more] + t.astype(np.int64).view(np.uint64))) & _LOW
        out[:] = self.ordered(ln_a) | np.maximum(code, np.uint64(1))

    def sign(self, text: str) -> np.ndarray:
        """SAMPLES numbers of 16 bits."""
        terms = list(Counter(_words(text.lower())).items())
        if not terms:
            return np.zeros(self.samples, np.uint16)
        if len(terms) > self.most // 2:  # beyond what is kept: in blocks
            least = [self.rows(terms[i : i + AT_ONCE]).min(axis=0) for i in range(0, len(terms), AT_ONCE)]
            return (np.min(least, axis=0) & _LOW).astype(np.uint16)
        place = self.place
        at = list(map(place.get, terms))
        if None in at:
            new = [t for t, i in zip(terms, at) if i is None]
            if len(place) + len(new) > self.most:
                place.clear()
                new = terms
            first = len(place)
            if first + len(new) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros((max(len(self.table), first + len(new) - len(self.table)), self.samples), np.uint64)))
            self.table[first : first + len(new)] = self.rows(new)
            place.update(zip(new, range(first, first + len(new))))
            at = list(map(place.__getitem__, terms))
        return (self.table.take(at, axis=0).min(axis=0) & _LOW).astype(np.uint16)


def text_of(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


_samplers: list[Sampler] = []


def _sampler() -> Sampler:
    if not _samplers:
        _samplers.append(Sampler())
        CACHES.append(_samplers[0].place)
    return _samplers[0]


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with their fingerprint as hexadecimal text; a column of that name is replaced."""
    make = lambda texts: [pa.array([text_of(_sampler().sign(t or "")) for t in texts.to_pylist()], pa.string())]
    return map_text(docs, text, [StructField(name, StringType())], make)


def edited(text: str, following: str) -> str:
    """The last half of text (rounded down) replaced by as much, or all, of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, text: str = "text", key: str = "doc_id", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (bucket, guest, _key, _h, key, _text) dealt out by `bucket`, in which each row is followed by its successor.

    The order is: descending key (an integer), null last, then by digest of the text; after the last row comes the first. Keys
    are cut into buckets at quantiles, and a key that takes several quantiles also by digest; a bucket ends with a guest, the
    first row of the bucket below (of the highest one, for the lowest). A bucket holds about bucket_bytes of text, more beyond
    MOST_BUCKETS of them; only cuts and one row's key and digest a bucket reach the driver.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise ValueError(f"{key} must be an integer")
    rows = docs.select(F.coalesce(quoted(key).cast("long"), F.lit(-(1 << 63))).alias("_key"), quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("_text"))
    size = rows.agg(F.sum(F.octet_length("_text")).alias("n")).first()["n"] or 0
    n = int(min(MOST_BUCKETS, max(1, size // bucket_bytes)))
    cuts = np.array(sorted(rows.agg(F.percentile_approx("_key", [i / n for i in range(1, n)], 10 * n + 1000).alias("q")).first()["q"] or []) if n > 1 else [], np.int64)
    keys, parts = np.unique(cuts, return_counts=True)  # a key that is `parts` quantiles has as many buckets
    first = np.concatenate(([0], np.cumsum(parts)))

    @F.pandas_udf(LongType())
    def bucket_of(key, part):
        import pandas as pd

        at = np.searchsorted(keys, key.to_numpy(), side="left")
        hit = np.append(keys, 0)[at] == key.to_numpy()
        more = np.append(parts, 1)[at]
        inside = np.where(hit & (at < len(keys)), more - 1 - part.to_numpy() * more // 65536, 0)
        return pd.Series((first[at] + inside).astype(np.int64))

    part = F.conv(F.hex(F.substring("_h", 1, 2)), 16, 10).cast("long")  # the least digests come first, so in the highest bucket
    rows = rows.withColumn("_h", text_hash(F.col("_text")))
    rows = rows.withColumn("bucket", bucket_of("_key", part) if len(cuts) else F.lit(0).cast("long"))
    highest = rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("_key").alias("k"), F.col("_h").alias("h"))).alias("s")).collect()  # the complement turns the order
    found = {r["bucket"]: (~r["s"]["k"], r["s"]["h"]) for r in highest}
    order = sorted(found)
    to = [(*found[b], order[(i + 1) % len(order)], i) for i, b in enumerate(order)]  # a head is the guest of the bucket above
    heads = docs.sparkSession.createDataFrame([(k, h, b) for k, h, b, _ in to], "_key long, _h binary, to long")
    columns = ["bucket", "guest", "_key", "_h", "key", "_text"]
    guests = rows.drop("bucket").join(F.broadcast(heads), ["_key", "_h"]).groupBy(F.col("to").alias("bucket"), "_key").agg(F.any_value(F.struct("key", "_text")).alias("v"))
    guests = guests.select("bucket", F.lit(1).alias("guest"), "_key", F.lit(None).cast("binary").alias("_h"), F.col("v.key").alias("key"), F.col("v._text").alias("_text"))
    dealt = rows.withColumn("guest", F.lit(0)).select(*columns).union(guests)
    return dealt.repartitionById(max(1, n), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "guest", F.col("_key").desc(), "_h")


def compare_with_edited(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row a document: key, n_chars, edited_sha256, both fingerprints, and likeness to the edited and to the next text."""
    ordered = in_order(docs, text, key)
    schema = StructType([
        StructField(key, docs.schema[key].dataType), StructField("n_chars", LongType()), StructField("edited_sha256", StringType()),
        StructField("fingerprint", StringType()), StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()), StructField("near_next", DoubleType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sign = _sampler().sign
        before = None  # bucket, key, text, signature
        for batch in pieces(batches, "_text"):
            out: list[tuple] = []
            for bucket, guest, key_, text_ in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "key", "_text"))):
                own = sign(text_)
                if before and before[0] == bucket:
                    changed = edited(before[2], text_)
                    other = before[3] if changed == before[2] else sign(changed)
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((before[1], len(before[2]), digest, text_of(before[3]), text_of(other), likeness(before[3], other), likeness(before[3], own)))
                before = None if guest else (bucket, key_, text_, own)
            if out:
                columns = list(zip(*out))
                kinds = [batch.schema.field("key").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], schema.names)

    return ordered.transform(map_arrow, run, schema)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
