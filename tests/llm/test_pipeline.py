"""The corpus pipeline and each of its stages against a plain version; learned models and disclosing terms are taken as found."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import bpe, mixing, pii, quality

SF = "/root/testdata/sf0.001"


def plain_classes(texts):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.split()) else set() for k, t in texts.items()}
    least = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and least[a] != least[b] and (texts[a] == texts[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    return set(least.values())


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    held = lambda name, given: sorted(map(tuple, stages[name](spark, spark.createDataFrame(given, docs.schema), SF).collect()))
    flat = lambda given: sorted(tuple(r[c] for c in docs.columns) for r in given)

    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = [r for r in rows.values() if model.score(np.array([quality.features(r["text"])]))[0] >= quality.CUT]
    assert 0 < len(good) < len(rows) and held("quality", list(rows.values())) == flat(good)

    kept = plain_classes({r["doc_id"]: r["text"] for r in good})
    one = [r for r in good if r["doc_id"] in kept]
    assert len(one) < len(good) and held("near duplicates", good) == flat(one)

    terms = {bytes(r["key"]): frozenset(r["terms"]) for r in pii.terms_of_texts(spark.createDataFrame(one, docs.schema)).collect()}
    clean = [r | {"text": (t := pii.replaced(r["text"], pii.spans_of(r["text"], terms.get(hashlib.md5(r["text"].encode()).digest())))), "n_chars": len(t)} for r in one]
    assert flat(clean) != flat(one) and held("personal data", one) == flat(clean)

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(clean))
    copies = {r.doc_id: int(r.copies) for r in con.sql(mixing.OP2_SQL).df().itertuples()}
    mixed = [r for r in clean for _ in range(copies.get(r["doc_id"], 0))]
    assert held("mixing", clean) == flat(mixed)

    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((r["doc_id"], r["source"], library.encode(r["text"], add_special_tokens=False).ids) for r in mixed)
    for out in (stages["encoding"](spark, spark.createDataFrame(mixed, docs.schema), SF), corpus_pipeline.run(spark, SF)):
        got = out.collect()
        assert sorted((r["doc_id"], r["source"], list(r["ids"])) for r in got) == want and all(r["n_tokens"] == len(r["ids"]) for r in got)
