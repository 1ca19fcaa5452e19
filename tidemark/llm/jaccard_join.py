"""Similarity join of word n-gram sets by the chosen-path method.

A text's set holds its runs of NGRAM white-space words (all its words, if fewer). Two texts are linked if the Jaccard
similarity of their sets is at least `threshold`. The join works on classes of equal texts:

1. One pass makes each text's digest and a sketch: SKETCH min-wise samples of its set, which two sets share at a place
   with probability equal to their similarity. Equal texts become one class.
2. Every class starts at the roots of independent trees, each of which has one sketch place, different ones as long as there
   are; a set goes to the child of its own sample there. At a deeper node, sketch places are chosen at random, 1 / threshold of
   them on average, and a set goes to the child of each chosen place and its own sample there. Nodes with one class end. Nodes with
   few are compared by sketches. Large ones are split again, MOST_DEPTH times at most; what then is still large is
   compared in blocks. The number of roots follows from the wanted recall and the chance of a pair to stay together so deep.
3. Pairs alike by sketch (with a margin of four standard deviations) only give the edges of candidate groups. All pairs within
   a group are then compared exactly on whole sets, in blocks of classes, so a pair missed in every run is still found if
   other links connect it. Only sums per class and a spanning forest leave a block, never the pairs.

The pairs of a candidate group are all compared: a group of g different texts costs g squared comparisons, and each of its sets is
sent to g / BLOCK tasks. The number of links, which is exact, costs as much.

Defined results: null and empty texts, and those of white space only, have no set; they have no links and are classes of
their own row's text, so equal ones share a class. Repeated rows are copies of one text; texts may be of any length. Null ids
come after all others where the least id counts. An empty table gives an empty result. Only the key and text columns are
read, whatever the others are named.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import HashFilter, WordHashes, drop_stored, free_name, map_arrow, mix64, pieces, quoted, stored, text_hash
from tidemark.llm.components import components

NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.99
SKETCH, MOST_DEPTH, LEAF, BLOCK = 64, 4, 128, 512
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(4242)
_FACTORS = _rng.integers(0, 1 << 64, SKETCH, dtype=np.uint64) | np.uint64(1)
_ADDED = _rng.integers(0, 1 << 64, SKETCH, dtype=np.uint64)
_hashes = WordHashes()


def recall_of(roots: int, threshold: float, depth: int) -> float:
    """Chance that a pair at the threshold is alike by sketch and meets at some node of `depth`, with that many root places.

    The pair shares k of SKETCH samples, k being binomial. A child of a root keeps it with chance q(depth - 1), where
    q(0) = 1 and q(d) = 1 - (1 - chosen q(d - 1)) ** k; the roots' places are dealt in turn, so of the last, partial round it
    shares a hypergeometric number.
    """
    rounds, rest = divmod(roots, SKETCH)
    chosen, total = 1 / (threshold * SKETCH), 0.0
    for k in range(max(0, least_alike(threshold)), SKETCH + 1):
        q = 1.0
        for _ in range(depth - 1):
            q = 1 - (1 - chosen * q) ** k
        missed = sum(math.comb(k, j) * math.comb(SKETCH - k, rest - j) * (1 - q) ** j for j in range(min(k, rest) + 1)) / math.comb(SKETCH, rest)
        total += math.comb(SKETCH, k) * threshold**k * (1 - threshold) ** (SKETCH - k) * (1 - missed * (1 - q) ** (k * rounds))
    return total


def roots_for(recall: float, threshold: float, depth: int) -> int:
    """Least number of root places that reaches `recall`."""
    for roots in range(1, 64 * SKETCH):
        if recall_of(roots, threshold, depth) >= recall:
            return roots
    raise ValueError(f"recall {recall} is out of a sketch's reach")


def least_alike(threshold: float) -> int:
    """Equal samples from which a pair counts as alike: four standard deviations below the threshold."""
    return math.floor(SKETCH * (threshold - 4 * math.sqrt(threshold * (1 - threshold) / SKETCH)))


def ngram_set(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams."""
    words = (text or "").split()
    if not words:
        return np.empty(0, np.uint64)
    tokens = _hashes.of(words)
    size = min(n, len(tokens))
    h = np.full(len(tokens) - size + 1, size, np.uint64)
    for i in range(size):
        h = mix64(h * _STEP + tokens[i : i + len(h)])
    return np.unique(h)


def sketch(grams: np.ndarray) -> np.ndarray:
    """SKETCH samples of 32 bits; empty for an empty set."""
    if not len(grams):
        return np.empty(0, np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(least, (grams[i : i + 2048, None] * _FACTORS[None, :] + _ADDED[None, :]).min(axis=0), out=least)
    return (mix64(least) >> np.uint64(32)).astype(np.uint32)


def _low(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(k[:8] for k in keys), "<i8")


def classes(docs: DataFrame, text: str = "text", ngram: int = NGRAM) -> DataFrame:
    """A row a distinct text: key (digest), copies, sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_text"):
            counts: dict[str, int] = {}
            for t in batch.column("_text").to_pylist():
                counts[t or ""] = counts.get(t or "", 0) + 1
            keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in counts]
            found = [sketch(ngram_set(t, ngram)).tobytes() for t in counts]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(list(counts.values()), pa.int64()), pa.array(found, pa.binary())], ["key", "copies", "sketch"])

    rows = docs.select(quoted(text).alias("_text")).transform(map_arrow, run, "key binary, copies long, sketch binary")
    return stored(rows.groupBy("key").agg(F.sum("copies").alias("copies"), F.any_value("sketch").alias("sketch")), "join-classes")


def _matrix(sketches: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sketches), np.uint32).reshape(-1, SKETCH)


def _children(paths: np.ndarray, sketches: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows' chosen children: (index of the row, path)."""
    places = mix64(np.arange(1, SKETCH + 1, dtype=np.uint64) * _STEP)
    draw = mix64(paths[:, None] ^ places[None, :])
    row, place = np.nonzero(draw < np.uint64(int(2.0**64 / (threshold * SKETCH))))
    return row, mix64(draw[row, place] + sketches[row, place].astype(np.uint64))


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.RecordBatch]:
    """Runs of rows that are equal in `by`, each as one batch; rows come sorted."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(c).fill_null(-1)) for c in by]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if batch.num_rows > 1 else np.empty(0, np.int64)
        edges = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != held_key:
                yield _one(held)
                held = []
            held.append(batch.slice(a, b - a))
            held_key = key
    if held:
        yield _one(held)


def _one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.concat_batches(parts)


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph."""
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for a, b in zip(left.tolist(), right.tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _alike(sketches: np.ndarray, least: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, column) with at least `least` equal samples, row before column or in another block."""
    out_a, out_b = [], []
    for i in rows.tolist():
        later = columns[columns > i] if len(rows) == len(columns) and rows[0] == columns[0] else columns
        if len(later):
            hit = later[(sketches[later] == sketches[i]).sum(axis=1) >= least]
            out_a.append(np.full(len(hit), i))
            out_b.append(hit)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.empty(0, np.int64), np.empty(0, np.int64))


def _sides(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the two blocks that a group compares; the same twice within one block."""
    block = np.asarray(batch.column("block"))
    first = np.flatnonzero(block == block.min())
    i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
    return (first, first) if i == j else (np.flatnonzero(block == i), np.flatnonzero(block == j))


def _dealt(rows: DataFrame, by: str, size: str, block: int, key: str = "key") -> DataFrame:
    """Rows of large groups once for each pair of blocks that theirs is in; (by, i, j) are then the groups, `block` is their own."""
    n = F.ceil(F.col(size) / block).cast("int")
    own = F.pmod(F.xxhash64(key), n).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least("block", k).alias("i"), F.greatest("block", k).alias("j")))
    rows = rows.withColumn("n", n).withColumn("block", own).withColumn("pair", F.explode(pairs))
    return rows.select("*", "pair.i", "pair.j").drop("pair", "n")


def candidate_edges(found: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, depth: int = MOST_DEPTH, leaf: int = LEAF) -> DataFrame:
    """a, b: edges that connect the classes which are alike by sketch and met in some tree. found: classes()."""
    least = least_alike(threshold)
    roots = roots_for(recall, threshold, depth)
    places = np.arange(roots) % SKETCH  # samples at all places are alike, so any fixed order of them does
    draws = mix64(np.arange(1, roots + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    sets = found.where(F.octet_length("sketch") > 0).select("key", "sketch")

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                m = _matrix(part.column("sketch").to_pylist())
                for place, draw in zip(places.tolist(), draws):
                    path = mix64(draw + m[:, place].astype(np.uint64))
                    yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(path.view(np.int64))], ["key", "path"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 10_000):
                part = batch.slice(at, 10_000)
                row, path = _children(np.asarray(part.column("path")).view(np.uint64), _matrix(part.column("sketch").to_pylist()), threshold)
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(row)), pa.array(path.view(np.int64))], ["key", "path"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["path", "i", "j"]):
            keys, m = group.column("key").to_pylist(), _matrix(group.column("sketch").to_pylist())
            edges = _forest(len(keys), *_alike(m, least, *_sides(group)))
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([keys[a] for a, _ in edges], pa.binary()), pa.array([keys[b] for _, b in edges], pa.binary())], ["a", "b"])

    edges, level, before, parts = None, sets.transform(map_arrow, start, "key binary, path long"), [], []
    for d in range(1, depth + 1):
        level = stored(level.distinct() if d > 1 else level, f"join-level{d}")
        met = stored(level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), f"join-sizes{d}")  # stored, so that a join may split a large node
        rows = stored(level.join(met, "path"), f"join-met{d}")
        drop_stored(level, met, *before)
        before = [rows]
        last = d == depth
        small = _dealt(rows if last else rows.where(F.col("size") <= leaf), "path", "size", BLOCK).join(sets, "key")
        part = small.repartition("path", "i", "j").sortWithinPartitions("path", "i", "j").transform(map_arrow, compare, "a binary, b binary")
        part = stored(part.distinct(), f"join-edges{d}")
        parts.append(part)
        edges = part if edges is None else edges.union(part)
        if last or not (large := rows.where(F.col("size") > leaf)).limit(1).count():
            break
        level = large.select("key", "path").join(sets, "key").select("key", "path", "sketch").transform(map_arrow, deeper, "key binary, path long")
    found = stored(edges.distinct(), "join-edges")
    drop_stored(*before, *parts)
    return found


def jaccard_links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, ngram: int = NGRAM, recall: float = RECALL, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """A row a distinct text: key (its digest, as text_hash() gives), copies, class_key and n_links.

    class_key is the least key of the texts that links connect. n_links is the number of other rows that a row of the text
    is linked to, copies of itself among them.
    """
    found = classes(docs, text, ngram)
    edges = candidate_edges(found, threshold, recall, leaf=leaf)
    groups = components(edges)
    groups = stored(groups.withColumnRenamed("node", "key").join(found.select("key", "copies"), "key"), "join-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sent = docs.sparkSession.sparkContext.broadcast(HashFilter.build(groups.select(_low_column("key").alias("low")), "low"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole sets of the texts that are in a group, or seem so to the filter; the join settles it."""
        for batch in pieces(batches, "_text"):
            texts = list({t: None for t in batch.column("_text").to_pylist() if t})
            keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in texts]
            wanted = np.flatnonzero(sent.value.hits(_low(keys))).tolist() if keys else []
            grams = [ngram_set(texts[i], ngram).tobytes() for i in wanted]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in wanted], pa.binary()), pa.array(grams, pa.binary())], ["key", "grams"])

    whole = docs.select(quoted(text).alias("_text")).transform(map_arrow, sets, "key binary, grams binary").groupBy("key").agg(F.any_value("grams").alias("grams"))
    members = groups.join(sizes, "component").withColumn("group", F.xxhash64("component"))
    dealt = _dealt(members.join(whole, "key").select("group", "size", "key", "copies", "grams"), "group", "size", block)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _groups(batches, ["group", "i", "j"]):
            keys, copies = part.column("key").to_pylist(), np.asarray(part.column("copies"))
            links, left, right = exact_links([np.frombuffer(g, np.uint64) for g in part.column("grams").to_pylist()], copies, threshold, *_sides(part))
            near = dict(_nearest_edges(len(keys), left, right))
            at = np.flatnonzero(links > 0).tolist()
            to = [keys[near[i]] if i in near else None for i in at]
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), pa.array(links[at], pa.int64()), pa.array(to, pa.binary())], ["key", "links", "to"])

    checked = stored(dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").transform(map_arrow, verify, "key binary, links long, to binary"), "join-links")
    linked = components(checked.where("to is not null").select(F.col("key").alias("a"), F.col("to").alias("b")))
    counts = checked.groupBy("key").agg(F.sum("links").alias("links"))
    out = found.select("key", "copies").join(linked.withColumnRenamed("node", "key"), "key", "left").join(counts, "key", "left")
    empty = F.col("key") == text_hash(F.lit(""))
    n = F.coalesce("links", F.lit(0)) + F.when(empty, F.lit(0)).otherwise(F.col("copies") - 1)
    return out.select("key", "copies", F.coalesce("component", "key").alias("class_key"), n.cast("long").alias("n_links"))


def _low_column(key: str):
    """First eight bytes of a digest as a LONG, least byte first."""
    parts = [F.conv(F.hex(F.substring(F.col(key), i + 1, 1)), 16, 10).cast("long") for i in range(8)]
    out = parts[0]
    for i in range(1, 8):
        out = out.bitwiseOR(F.call_function("shiftleft", parts[i], F.lit(8 * i)))
    return out


def _nearest_edges(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest as one edge a node at most: each node points to its parent."""
    around: dict[int, list[int]] = {}
    for a, b in _forest(n, left, right):
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    seen: set[int] = set()
    out = []
    for first in around:
        if first not in seen:
            seen.add(first)
            todo = [first]
            while todo:
                x = todo.pop()
                for y in around[x]:
                    if y not in seen:
                        seen.add(y)
                        out.append((y, x))
                        todo.append(y)
    return out


def exact_links(sets: list[np.ndarray], copies: np.ndarray, threshold: float, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked rows of each set (weighted by copies) and the linked pairs, between two blocks or within one."""
    sizes = np.array([len(s) for s in sets], np.int64)
    links = np.zeros(len(sets), np.int64)
    out_a, out_b = [], []
    same = len(rows) == len(columns) and np.array_equal(rows, columns)
    if not len(rows) or not len(columns):
        return links, np.empty(0, np.int64), np.empty(0, np.int64)
    everything, ids = np.unique(np.concatenate([sets[i] for i in columns]), return_inverse=True)
    starts = np.concatenate(([0], np.cumsum(sizes[columns])[:-1]))
    inside = np.zeros(len(everything), np.int8)
    for k, i in enumerate(rows.tolist()):
        at = np.minimum(np.searchsorted(everything, sets[i]), len(everything) - 1)
        at = at[everything[at] == sets[i]]  # with another block, some of the set is nowhere in it
        inside[at] = 1
        common = np.add.reduceat(inside[ids], starts, dtype=np.int64)
        inside[at] = 0
        hit = common >= threshold * (sizes[i] + sizes[columns] - common) - 1e-9
        if same:
            hit[: k + 1] = False
        hit = columns[hit]
        links[i] += copies[hit].sum()
        links[hit] += copies[i]
        out_a.append(np.full(len(hit), i))
        out_b.append(hit)
    return links, np.concatenate(out_a), np.concatenate(out_b)


def with_classes(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs' keys with class_id (least key of the class; null if all are null) and n_links."""
    found = stored(jaccard_links(docs, text, **options), "join-found")
    rows = docs.select(quoted(key).alias("id"), text_hash(quoted(text)).alias("key")).join(found.select("key", "class_key", "n_links"), "key")
    ids = rows.groupBy("class_key").agg(F.min("id").alias("class_id"))
    return rows.join(ids, "class_key").select(F.col("id").alias(key), "class_id", "n_links")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each class: that with the least (key, digest of the text), null keys last. Rows equal in both
    count as one, whatever else they hold."""
    found = stored(jaccard_links(docs, text, **options).select("key", "class_key"), "join-found")
    rows = docs.select(quoted(key).alias("id"), text_hash(quoted(text)).alias("key")).join(found, "key")
    kept = rows.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("k"))
    digest = free_name(docs.columns, "digest")
    kept = kept.select(F.col("k.id").alias("_kept_id"), F.col("k.key").alias("_kept_key"))
    out = docs.withColumn(digest, text_hash(quoted(text))).alias("d")
    same = (F.col(f"d.{digest}") == F.col("k._kept_key")) & F.col("d.`" + key.replace("`", "``") + "`").eqNullSafe(F.col("k._kept_id"))
    return out.join(kept.alias("k"), same, "left_semi").dropDuplicates([digest, key]).drop(digest)


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
