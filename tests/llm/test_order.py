"""The order of documents that op9 compares by, with buckets of a few bytes, hot keys and awkward rows."""

import hashlib
import random

import pytest

from tidemark.llm import fingerprint


def plain(rows):
    """(text, edited text, next text) of each row in order."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest()))
    texts = [r[1] or "" for r in order]
    return [(r[0], t, fingerprint.edited(t, texts[(i + 1) % len(texts)]), texts[(i + 1) % len(texts)]) for i, (r, t) in enumerate(zip(order, texts))]


@pytest.mark.parametrize("bucket", [40, 400, 1 << 20])
def test_successors(spark, monkeypatch, bucket):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 25)))
    rows = [(k, text(), "x") for k in range(60)] + [(7, text(), "y") for _ in range(90)] + [(None, text(), "z") for _ in range(40)] + [(70, None, "n"), (-(1 << 62), "", "e"), (71, "long " * 5000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _key string")
    whole = fingerprint.in_order
    monkeypatch.setattr(fingerprint, "in_order", lambda docs, text, key: whole(docs, text, key, bucket_bytes=bucket))
    got = fingerprint.compare_with_edited(docs).collect()
    sampler = fingerprint.Sampler()
    sign = lambda t: fingerprint.text_of(sampler.sign(t))
    want = sorted((str(k), len(t), hashlib.sha256(e.encode()).hexdigest(), sign(t), sign(e), fingerprint.likeness(sampler.sign(t), sampler.sign(e)), fingerprint.likeness(sampler.sign(t), sampler.sign(n))) for k, t, e, n in plain(rows))
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got)) == want


def test_empty_table_and_other_keys(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprint.compare_with_edited(docs).count() == 0
    with pytest.raises(ValueError):
        fingerprint.compare_with_edited(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
