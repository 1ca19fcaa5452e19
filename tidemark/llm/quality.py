"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is a weighted sum of features of its text; that a better document is preferred to a worse one has
the logistic probability of the difference of their strengths. Weights are learned from preference pairs (one labelled
1, one labelled 0) by Newton steps on the logistic loss of feature differences with a small ridge. The threshold is the
quantile of the training strengths at the share of rejected documents that gives the fewest training errors; scores are the
logistic of strength minus threshold, moved so that the threshold scores `cut`.

Learning uses a sample of at most MOST_ROWS labelled rows (the least by a hash of their id, then of their text), with whole
texts; each takes part in about PAIRS pairs. Scoring covers every row in one pass without a shuffle.

Defined results: a null text counts as empty; empty texts and texts without words have their own feature and get a score;
texts may be of any length. Labels other than 0 and 1, and those of a null id, teach nothing; where no pair can be formed every
score is `cut`. Repeated rows are scored alike; repeated labels and ids count as often, within the bound. Equal strengths have
equal scores. An empty table gives an empty result. Columns of the input are kept, whatever their names; only one named as
the added score (`name`) is replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from tidemark.llm.common import CACHES, map_arrow, map_text, pieces, quoted
from tidemark.llm.language import held_out

MOST_ROWS = 20_000
PAIRS = 12
CUT = 0.3
WINDOWS = 16  # a text's words are also judged in so many equal stretches, for texts that are bad in part

FEATURES = (
    "empty", "log_words", "log_lines", "upper", "digit", "symbol", "bang", "pipe", "punct", "other_control", "long_words",
    "mean_word", "symbol_words", "upper_words", "bare_bars", "one_letter", "distinct", "repeat_next", "top_word", "repeat_lines",
    "worst_symbol", "worst_upper", "worst_bar", "worst_repeat", "share_bad", "share_bad_square", "any_bad",
)

_CLASS = np.zeros(256, np.uint8)  # 0 letters, marks and bytes of other scripts
for _chars, _kind in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b"#$%&*@^~=<>{}[]\\/_+`", 3), (b"!?", 4), (b"|", 5), (b".,;:'\"()-", 6), (b" \t\n\r\x0b\x0c", 7), (bytes(range(9)) + bytes(range(14, 32)) + b"\x7f", 8)):
    _CLASS[list(_chars)] = _kind
_SYMBOLS = frozenset("#$%&*@^~=<>{}[]\\/_+`!?")


def _word_kind(word: str) -> int:
    """1 ends in two symbols, 2 in capitals, 3 a bare bar, 4 a single other character, 0 else."""
    if len(word) == 1:
        return 3 if word == "|" else 4
    if word[-1] in _SYMBOLS and word[-2] in _SYMBOLS:
        return 1
    return 2 if word.isupper() and len(word) > 1 else 0


class _Kinds(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = kind = _word_kind(word)
        return kind


_kinds = _Kinds()
CACHES.append(_kinds)


def features(text: str | None) -> list[float]:
    words = (text or "").split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * (len(FEATURES) - 1)
    raw = text.encode("utf-8", "surrogatepass")
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=9)
    chars = max(1, len(raw) - int(by[7]))
    kinds = np.fromiter(map(_kinds.__getitem__, words), np.uint8, n)
    counts = Counter(words)
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), np.bool_, n - 1) if n > 1 else np.zeros(0, np.bool_)
    lines = [x for x in text.split("\n") if x.strip()]
    edges = np.unique(np.linspace(0, n, min(WINDOWS, n) + 1).astype(np.int64))
    width = np.diff(edges)
    shares = [np.add.reduceat((kinds == k).astype(np.float64), edges[:-1]) / width for k in (1, 2, 3)]
    repeats = np.add.reduceat(np.append(same, False).astype(np.float64), edges[:-1]) / width
    bad = (shares[0] > 0.3) | (shares[1] > 0.5) | (shares[2] > 0.2) | (repeats > 0.3)
    share_bad = float((bad * width).sum() / n)
    kind = np.bincount(kinds, minlength=5) / n
    return [
        0.0, math.log1p(n), math.log1p(len(lines)), *(float(by[k]) / chars for k in (1, 2, 3, 4, 5, 6, 8)),
        sum(map(len, (w for w in counts if len(w) > 24))) / len(text), math.log(chars / n), *map(float, kind[1:5]),
        len(counts) / n ** 0.8, float(same.sum()) / n, max(counts.values()) / n, 1 - len(set(lines)) / max(1, len(lines)),
        *(float(s.max()) for s in shares), float(repeats.max()), share_bad, share_bad**2, float(bad.any()),
    ]


@dataclass
class Model:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    threshold: float
    cut: float = CUT

    def strength(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.asarray(self.mean)) / np.asarray(self.scale)) @ np.asarray(self.weights)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.strength(x) - self.threshold + math.log(self.cut / (1 - self.cut))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def fit_pairs(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, ridge: float = 1e-3, seed: int = 11, cut: float = CUT) -> Model:
    """Bradley-Terry by Newton's method on pairs drawn between the two classes; every row takes part."""
    d = x.shape[1]
    mean, scale = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(d), np.ones(d))
    scale = np.where(scale > 1e-9, scale, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return Model(mean.tolist(), scale.tolist(), [0.0] * d, 0.0, cut)
    z = (x - mean) / scale
    rng = np.random.default_rng(seed)
    a = np.concatenate([np.repeat(good, pairs), rng.choice(good, len(bad) * pairs)])
    b = np.concatenate([rng.choice(bad, len(good) * pairs), np.repeat(bad, pairs)])
    diff, w = z[a] - z[b], np.zeros(d)
    for _ in range(25):
        p = 1.0 / (1.0 + np.exp(np.clip(diff @ w, -40, 40)))  # that the worse one would be preferred
        grad = -(diff * p[:, None]).mean(axis=0) + ridge * w
        hess = (diff * (p * (1 - p))[:, None]).T @ diff / len(diff) + ridge * np.eye(d)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    s = z @ w
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    # errors if the k least are rejected: those of label 1 among them, those of label 0 above
    errors = np.concatenate(([0], np.cumsum(y[order] == 1))) + (len(bad) - np.concatenate(([0], np.cumsum(y[order] == 0))))
    edge = np.concatenate(([True], ranked[1:] > ranked[:-1], [True]))
    k = int(np.flatnonzero(edge)[np.argmin(errors[edge])])
    low, high = ranked[max(0, k - 1)], ranked[min(k, len(ranked) - 1)]
    return Model(mean.tolist(), scale.tolist(), w.tolist(), float((low + high) / 2), cut)


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text"):
        x = [features(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.select(["at", "tie", "label"]).columns, pa.array(x, pa.list_(pa.float64()))], ["at", "tie", "label", "x"])


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", most_rows: int = MOST_ROWS, cut: float = CUT) -> Model:
    """labels: key and label (0 or 1). At most most_rows labels are broadcast, and as many rows collected."""
    usable = labels.select(quoted(key).alias("key"), quoted(label).cast("int").alias("label")).where("key is not null and label in (0, 1)")
    sample = usable.withColumn("at", F.xxhash64("key")).orderBy("at", "key", "label").limit(most_rows)
    rows = docs.select(quoted(key).alias("key"), F.coalesce(quoted(text), F.lit("")).alias("text")).join(F.broadcast(sample), "key")
    rows = rows.select("at", F.xxhash64("text").alias("tie"), "label", "text")
    schema = StructType([StructField("at", LongType()), StructField("tie", LongType()), StructField("label", IntegerType()), StructField("x", ArrayType(DoubleType()))])
    got = rows.transform(map_arrow, _feature_batches, schema).orderBy("at", "tie", "label").limit(most_rows).toArrow()
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, len(FEATURES)) if got.num_rows else np.zeros((0, len(FEATURES)))
    y = np.asarray(got["label"]).astype(np.int64)
    order = np.lexsort((*x.T, y)) if len(y) else slice(None)  # the order in which rows arrive must not matter
    return fit_pairs(x[order], y[order], cut=cut)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None, name: str = "quality_score") -> DataFrame:
    """docs (or its columns in `keep`) with a column `name`."""

    def make(texts: pa.Array) -> list[pa.Array]:
        x = np.array([features(t) for t in texts.to_pylist()]).reshape(-1, len(FEATURES))
        return [pa.array(model.score(x))]

    return map_text(docs, text, [StructField(name, DoubleType())], make, keep)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id"), 5, 0))
    found = score(docs, learn(docs, labels), keep=["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= CUT, 1).otherwise(0).alias("predicted"))
