"""Mixing sources to target weights by systematic sampling.

Within a source the documents stand in a fixed order; every document is expected rate = target / source size times. The
running sum of these expectations plus one offset, drawn once from the seed, gives a document one copy for each integer
that it passes. Documents are ordered by size class (steps of 1/16 of a power of two), then by digests of their id and text,
so that the copies spread evenly over the sizes and a source's words come within about one long document of its target.

The running sum needs no task that sees a whole source: rows are counted by (source, size class, a hex digit of the digest
of the id and one of that of the text), at most 256 * 500 counts a source however long the tables are. These counts are summed
up in order, by class and within each class, and rows are numbered only within such a bucket. So an id that many rows share is split by their texts; rows
equal in both are numbered together by size class. The targets take one row a source in one task.

Defined results: a null text has size 0 and so has one without words; texts may be of any length; a null source is a source
of its own and sorts last; a source of size 0 has target 0 and no copies; repeated rows are separate documents, and of rows
equal in id and text any may get a copy; an empty table gives an empty one. Columns of the input are kept, whatever their
names; those added by mix() replace columns of the same name, mixed() adds none.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import quoted

SEED = 20240607


def offset(seed: int = SEED) -> float:
    """The one random offset, in [0, 1)."""
    return random.Random(seed).random()


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def size_class(size: Column) -> Column:
    return F.when(size < 16, size).otherwise(F.floor(F.log2(size.cast("double")) * 16)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """sizes: source, source_size. Adds target and rate.

    Sources take `weights` in turn by code point, null last, and share the whole of all sizes; none gets over `most`
    times its size, and what that leaves is shared by weight among the others. That is a water level: with sources
    ordered by size for weight, the capped ones come first, so one running sum finds the level exactly.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    given = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sizes.withColumn("weight", given.cast("long")).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    df = df.withColumn("full_at", F.col("cap") / F.col("weight"))
    everything = Window.partitionBy()
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    df = df.withColumn("place", F.row_number().over(by_level))
    left = F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    df = df.withColumn("level", left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("place", "level"))).over(everything)  # the first source that isn't full
    df = df.withColumn("level", first["level"])
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    df = df.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)))
    rate = F.when(F.col("source_size") <= 0, F.lit(0.0)).when(F.col("target") >= F.col("cap"), F.lit(float(most)))
    return df.select("source", "source_size", "target", rate.otherwise(F.col("target") / F.col("source_size")).alias("rate"))


ADDED = ("size", "source_size", "target", "copies", "taken")


def _copies(docs: DataFrame, keep: Sequence[str], text: str, source: str, key: str, weights: tuple[int, ...], most: float, seed: int) -> DataFrame:
    """row (the columns of docs in `keep`) and ADDED."""
    size = words(quoted(text))
    narrow = docs.select(quoted(source).alias("source"), size.alias("size"))
    totals = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    digest, other = F.md5(F.coalesce(quoted(key).cast("string"), F.lit(""))), F.md5(F.coalesce(quoted(text), F.lit("")))
    rows = docs.select(F.struct(F.lit(0).alias("_"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(keep))).alias("row"), F.struct(quoted(source).alias("source")).alias("of"), size.alias("size"), digest.alias("digest"), other.alias("other"))
    rows = rows.withColumn("class", size_class(F.col("size"))).withColumn("place", F.concat(F.substring("digest", 1, 1), F.substring("other", 1, 1)))
    bucket = ["of", "class", "place"]
    counts = rows.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n"))
    before = lambda by, order: F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.groupBy("of", "class").agg(F.sum("n").alias("n")).select("of", "class", before(["of"], "class").alias("first"))
    counts = counts.withColumn("start", before(["of", "class"], "place")).join(firsts, ["of", "class"]).withColumn("start", F.col("first") + F.col("start")).drop("n", "first")
    counts = counts.join(totals.select(F.struct("source").alias("of"), "source_size", "target", "rate"), "of")
    within = Window.partitionBy(*bucket).orderBy("digest", "size", "other")
    rows = rows.withColumn("rank", F.row_number().over(within)).join(counts, bucket)
    passed = lambda n: F.floor(n * F.col("rate") + F.lit(offset(seed)))
    rank = (F.col("start") + F.col("rank")).cast("double")
    return rows.withColumn("copies", (passed(rank) - passed(rank - 1)).cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select("row", *ADDED)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = SEED, keep: Sequence[str] | None = None) -> DataFrame:
    """docs (or its columns in `keep`) with size, source_size, target, copies and taken (copies * size)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ADDED]
    found = _copies(docs, kept, text, source, key, weights, most, seed)
    return found.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)), *ADDED)


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = SEED) -> DataFrame:
    """The mixture itself: docs' rows, each as often as it has copies."""
    taken = _copies(docs, docs.columns, text, source, key, weights, most, seed).where("copies > 0")
    copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return copies.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP2_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 3.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, row_number() OVER by_level AS place,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level
  FROM weighted WINDOW by_level AS (ORDER BY cap / weight, source ASC NULLS LAST),
       before AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shared AS (
  SELECT source, source_size, cap, CASE WHEN source_size > 0 THEN least(cap, weight * arg_min(own_level, place) FILTER (own_level <= cap / weight) OVER ()) ELSE 0 END::DOUBLE AS target
  FROM levels),
rated AS (
  SELECT sized.*, source_size, target, CASE WHEN source_size <= 0 THEN 0 WHEN target >= cap THEN 3.0 ELSE target / source_size END::DOUBLE AS rate,
         row_number() OVER (PARTITION BY sized.source ORDER BY CASE WHEN size < 16 THEN size ELSE floor(log2(size::DOUBLE) * 16) END,
                            md5(coalesce(doc_id::VARCHAR, ''))[1] || md5(coalesce(text, ''))[1], md5(coalesce(doc_id::VARCHAR, '')), size, md5(coalesce(text, '')))::DOUBLE AS k
  FROM sized JOIN shared ON sized.source IS NOT DISTINCT FROM shared.source),
copied AS (
  SELECT *, (floor(k * rate + {offset()!r}) - floor((k - 1) * rate + {offset()!r}))::BIGINT AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM copied
"""
