"""Mixing against targets that are shared out step by step."""

import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing


def shared_out(sizes: dict, weights=(1, 2, 3), most=3.0) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free = dict.fromkeys(names, 0.0), set(names)
    left = float(sum(sizes.values()))
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        full = {s for s in free if target[s] > most * sizes[s]}
        left = sum(target[s] - most * sizes[s] for s in full)
        for s in full:
            target[s] = most * sizes[s]
        free -= full
    return target


@pytest.mark.parametrize("counts", [{"a": 400, "b": 30, "c": 5, None: 200}, {"a": 50, "b": 50, "c": 50}, {"a": 1000, "b": 1, "c": 1, "d": 1}, {"z": 20}])
def test_targets_and_taken(spark, counts):
    rows, k = [], 0
    for source, n in counts.items():
        for i in range(n):
            rows.append((k, " ".join(["w"] * (1 + (i * 7) % 23)), source, "extra"))
            k += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size string")
    got = mixing.mix(docs).collect()
    sizes = {s: sum(r["size"] for r in got if r["source"] == s) for s in counts}
    want = shared_out(sizes)
    assert len(got) == len(rows)
    for s in counts:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in own) - want[s]) <= 3 * 24
        assert all(r["source_size"] == sizes[s] and 0 <= r["copies"] <= 3 for r in own)
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    assert mixing.mixed(docs).count() == sum(r["copies"] for r in got)


def test_nulls_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (None, "", "a"), (2, "x\ty  z", None), (2, "x\ty  z", None)], "doc_id long, text string, source string")
    got = sorted((r["size"] for r in mixing.mix(docs).collect()))
    assert got == [0, 0, 3, 3]
    assert mixing.mix(docs.where(F.lit(False))).count() == 0
    assert mixing.mix(docs.where("text is null")).collect()[0]["target"] == 0.0
