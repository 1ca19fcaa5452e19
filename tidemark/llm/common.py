"""Helpers that several corpus operators share: the shared folder, stored tables, word hashes and bounded hash filters."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Multiplier and shifts of the 64-bit finaliser (splitmix64).
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see: spark.checkpoint.dir. A temporary one where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        sc.setCheckpointDir(path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet below the shared folder and read again: its lineage is cut and lost executors lose none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def drop_stored(*tables: DataFrame) -> None:
    """Deletes tables that stored() wrote; for those that nothing still to be run reads."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_path)
        path.getFileSystem(conf).delete(path, True)


def quoted(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(columns: Sequence[str], name: str) -> str:
    """name, or name with underscores after it, that no column has in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_hash(text: Column) -> Column:
    """16-byte digest of a text, null counting as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values."""
    x = (x ^ (x >> _S30)) * _MIX_A
    x = (x ^ (x >> _S27)) * _MIX_B
    return x ^ (x >> _S31)


#: What a worker process keeps between tasks of one stage; emptied when the next stage's function comes, so they don't add up.
CACHES: list = []
ROWS, BYTES = 1000, 8 << 20  # of an Arrow batch: texts are long, and both sides of the pipe hold whole batches
_owner: list[str] = [""]


def _clear() -> None:
    for cache in CACHES:
        cache.clear()


def give_back() -> None:
    """Returns freed memory of this process to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow in batches of at most ROWS rows and about BYTES bytes.

    The two limits are settings of the session; where they are higher there, they are lowered. A worker keeps its caches
    for the tasks of one call.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BYTES)):
        if not 0 < int(re.sub(r"\D+$", "", conf.get(name))) <= most:
            conf.set(name, str(most))
    owner = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _owner[0] != owner:
            _clear()
            give_back()
            _owner[0] = owner
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def map_text(docs: DataFrame, text: str, added: list[StructField], make: Callable[..., list[pa.Array]], keep: Sequence[str] | None = None, most_bytes: int = 4 << 20, also: Sequence[str] = ()) -> DataFrame:
    """docs (or its columns in `keep`) with the columns `added`, which `make` computes from a piece of the column `text`.

    make gets the columns `also` after the text; they are dropped, whether in `keep` or not. The text crosses to Python once, kept or not. Columns travel by position, so none of theirs can clash with one of docs;
    an added one replaces a column of the same name, in any case.
    """
    names = {f.name.lower() for f in added}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names and c not in also]
    sent = [*(kept if text in kept else [*kept, text]), *also]
    given = docs.select(*(quoted(c).alias(f"c{i}") for i, c in enumerate(sent)))
    fields = [*given.schema.fields[: len(kept)], *(StructField(f"a{i}", f.dataType) for i, f in enumerate(added))]
    at, out = sent.index(text), [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, f"c{at}", most_bytes):
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *make(batch.column(at), *batch.columns[len(sent) - len(also) :])], out)

    done = given.transform(map_arrow, run, StructType(fields))
    return done.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(kept)), *(F.col(f"a{i}").alias(f.name) for i, f in enumerate(added)))


class WordHashes(dict):
    """word -> 64-bit hash; emptied when it holds `most` words, so its memory is bounded."""

    def __init__(self, most: int = 100_000) -> None:
        super().__init__()
        self.most = most
        CACHES.append(self)

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a piece's `column` holds about most_bytes at most (one value at least)."""
    for batch in batches:
        sizes = _lengths(batch.column(column))
        start = 0
        total = np.cumsum(sizes)
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(total, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def _lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a text or bytes column, and of a list column of texts or numbers, about."""
    if pa.types.is_list(column.type):
        own = np.append(0, np.cumsum(_lengths(column.flatten()) if pa.types.is_string(column.type.value_type) else np.full(len(column.flatten()), 8)))
        n = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
        ends = np.cumsum(n)
        return own[ends] - own[ends - n]
    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


class HashFilter:
    """A set of 64-bit hashes as a bit table: no member is missed, others pass with probability members / bits.

    The table has 64 bits a member, so others pass alike at every size, up to 2**28 bits (32 MB) whatever the input's size; and
    `least` bits at least. It only decides which rows take the exact path; the exact join that follows settles them.
    """

    EACH, MOST_BITS = 64, 1 << 28

    def __init__(self, table: np.ndarray, bits: int) -> None:
        self.table, self.bits = table, bits

    @classmethod
    def build(cls, hashes: DataFrame, column: str, least: int = 1 << 10) -> HashFilter:
        """hashes: a LONG column of evenly spread hashes. Words of the table are OR-ed on the executors."""
        bits = max(least, min(cls.EACH * hashes.count(), cls.MOST_BITS))
        place = F.pmod(F.col(column), F.lit(bits))
        words = hashes.select(F.shiftright(place, 6).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int")).alias("b"))
        got = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        table = np.zeros(bits // 64 + 1, np.uint64)
        table[np.asarray(got["w"]).astype(np.int64)] = np.asarray(got["b"]).astype(np.int64).view(np.uint64)
        return cls(table, bits)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """hashes: 64 bits each, as signed or unsigned numbers."""
        place = np.ascontiguousarray(hashes).view(np.int64) % self.bits
        return (self.table[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
