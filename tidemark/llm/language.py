"""Language identification by rank-order n-gram profiles (out-of-place distance).

A text's profile is its most frequent n-grams (1 to 3 characters over lower-cased letters, every other run of characters
being one separator), most frequent first. A language's profile is the same over all training texts of that language.
The distance of a text to a language is the sum, over the text's n-grams, of how far each is out of place in the
language's profile; a missing one counts as far as the profile is long. The least distance wins, ties by language name.

Three letters of 21 bits fit one 64-bit number, so n-grams are counted exactly by sorting numbers, without hashing.

Defined results: a null or letterless text is ``und`` with score 0, as is any text where nothing was learned; rows with
null text or language are not learned from; repeated rows count as often as they occur in training and are judged alike.
Equally frequent n-grams rank by their code points, equally near languages by name. Texts may be of any length. An empty
table gives an empty result. Columns of the input are kept, whatever their names; the added ones replace columns of the same name.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField
from pyspark.sql.window import Window

from tidemark.llm.common import map_arrow, map_text, pieces, quoted

PROFILE = 400  # n-grams of a language's profile
MOST_N = 3
_SHIFT = np.int64(21)
_tables: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, 0 for what isn't a letter; made once a process from Python's own tables."""
    if not _tables:
        table = np.zeros(sys.maxunicode + 1, np.int32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _tables.append(table)
    return _tables[0]


def grams(text: str) -> np.ndarray:
    """All n-grams of a text as numbers; words are padded with a separator at both ends. Empty without letters."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = codes != 0
    if not letter.any():
        return np.empty(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a run of others leaves its first
    codes = np.concatenate(([0], codes[keep], [0])).astype(np.int64)
    if codes[1] == 0:
        codes = codes[1:]
    if codes[-2] == 0:
        codes = codes[:-1]
    # the separator counts as 1 within n-grams, so that shorter ones differ from longer ones
    codes[codes == 0] = 1
    one = codes[codes != 1]
    two = (codes[:-1] << _SHIFT) | codes[1:]
    three = (two[:-1] << _SHIFT) | codes[2:]
    return np.concatenate((one, two, three))


def counted(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1])))
    return numbers[first], np.diff(np.append(first, len(numbers)))


def top(numbers: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent, ties by number, in order of rank."""
    if len(numbers) > most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        numbers, counts = numbers[keep], counts[keep]
    return numbers[np.lexsort((numbers, -counts))[:most]]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed up over pieces of a few MB."""
    for batch in pieces(batches, "text"):
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            by.setdefault(lang, []).append(grams(text))
        for lang, found in by.items():
            numbers, counts = counted(np.concatenate(found)) if sum(map(len, found)) else (np.empty(0, np.int64), np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(numbers), pa.string()), pa.array(numbers), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"])


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> dict[str, list[int]]:
    """Language profiles from every row of docs. Only `size` numbers a language reach the driver."""
    given = docs.select(quoted(text).alias("text"), quoted(lang).alias("lang")).where("text is not null and lang is not null")
    counts = given.transform(map_arrow, _count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE) -> None:
        self.names, self.size = sorted(profiles), size
        known = np.unique(np.concatenate([np.asarray(p, np.int64) for p in profiles.values()])) if profiles else np.empty(0, np.int64)
        self.known = known
        self.ranks = np.full((len(self.names), len(known) + 1), -1, np.int32)  # the last column stands for unknown n-grams
        for row, name in zip(self.ranks, self.names):
            row[np.searchsorted(known, np.asarray(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: 1 - least distance / greatest possible one, as a share of all languages' such scores."""
        numbers = grams(text) if text else np.empty(0, np.int64)
        if not len(numbers) or not self.names:
            return "und", 0.0
        own = top(*counted(numbers), self.size)
        at = np.minimum(np.searchsorted(self.known, own), max(0, len(self.known) - 1))
        at = np.where(self.known[at] == own, at, len(self.known))
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(own))))
        far = away.sum(axis=1)
        best = int(far.argmin())
        near = 1.0 - far / float(self.size * len(own))
        total = float(near.sum())
        return self.names[best], float(near[best] / total) if total > 0 else 1.0 / len(self.names)


def detect(docs: DataFrame, profiles: dict[str, list[int]], text: str = "text", size: int = PROFILE, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns in `keep`) with lang_pred and score."""
    model: list[Classifier] = []

    def make(texts: pa.Array) -> list[pa.Array]:
        if not model:
            model.append(Classifier(profiles, size))
        found = [model[0].predict(t) for t in texts.to_pylist()]
        return [pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())]

    return map_text(docs, text, [StructField("lang_pred", StringType()), StructField("score", DoubleType())], make, keep, 8 << 20)


def held_out(key: Column, parts: int, rest: int) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts == rest


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = detect(docs, profiles, keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
