"""Personal data against brute force: spans by the patterns as given, disclosure by loops over all documents."""

import hashlib
import math
import random
import re
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.llm import pii, registry

SF = "/root/testdata/sf0.01"
PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def digits(s):
    return re.sub("[^0-9]", "", s)


def plain_spans(t):
    email, ip, card, phone = PATTERNS
    found = [(0, *m.span()) for m in email.finditer(t)] + [(1, *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, *m.span()) for m in card.finditer(t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return found + [(3, *m.span()) for m in phone.finditer(t) if 9 <= len(digits(m[0])) <= 15]


def plain_pairs(texts, disclosure=pii.DISCLOSURE, chance=pii.CHANCE, window=pii.WINDOW):
    """(level, entity, term) -> share, by the definitions."""
    holds, near, where = defaultdict(set), defaultdict(set), defaultdict(set)
    for i, t in enumerate(texts):
        for w in set(re.findall(r"\w+", t.lower())):
            where[w].add(i)
        spans = pii.all_entities(t)
        words = [m for m in re.finditer(r"\w+", t)]
        inside = lambda m: any(a < m.end() and m.start() < b for _, a, b in spans)
        for kind, a, b in spans:
            before, after = [m for m in words if m.start() < a][-window:], [m for m in words if m.start() >= b]
            after = [m for m in words if m.start() >= b][:window]
            for level, e in enumerate(pii.levels(kind, t[a:b])):
                if e is not None:
                    holds[level, e].add(i)
                    for m in before + after:
                        if not inside(m):
                            near[level, e, m[0].lower()].add(i)
    out, n = {}, max(2, len(texts))
    for (level, e, w), docs in near.items():
        x, k = len(holds[level, e]) * len(where[w]) / n, len({texts[i] for i in docs})
        odds = k - x - k * math.log(k / x) if k > x else 0.0
        info = math.log2(n / len(holds[level, e]))
        share = math.log2(n * len(docs) / (len(holds[level, e]) * len(where[w]))) / info if info > 0 else 0.0
        if share >= disclosure and odds <= math.log(chance / len(near)):
            out[level, e, w] = share
    return out


def corpus():
    rng, vocabulary = random.Random(8), [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [f"{some(12)} zorblat {some(2)} bob@site.org mail {some(12)} zorblat" for _ in range(6)]
    texts += [f"{some(9)} dial +1 (555) 123-{1000 + i} {some(9)}" for i in range(12)]
    texts += [f"{some(9)} hush a1b2c3d4e5f6a7b8c9d0{i} {some(9)}" for i in range(9)]
    texts += [some(rng.randrange(5, 40)) for _ in range(900)] + ["zorblat alone " + some(5), "please dial now"]
    return texts + texts[:2]


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("ab1.2@-+ ()é٣%_3456789") for _ in range(rng.randint(0, 45)))
        assert pii.base_spans(t) == plain_spans(t)


def test_disclosing_pairs_equal_the_definition(spark):
    texts = corpus()
    want = plain_pairs(texts)
    pairs, _ = pii.disclosing_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {(r["level"], r["entity"], r["term"]): r["share"] for r in pairs.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {w for _, _, w in want} >= {"zorblat", "mail", "dial", "hush"} and {k[0] for k in want} == {0, 1, 2}


def test_terms_go_where_they_disclose(spark):
    texts = corpus()
    got = [r["text"] for r in pii.sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    kinds = {w for level, _, w in plain_pairs(texts) if level == 2}
    assert "dial" in kinds and "zorblat" not in kinds or "zorblat" in kinds
    for before, after in zip(texts, got):
        if not pii.all_entities(before) and not kinds & set(re.findall(r"\w+", before)):
            assert after == before
    assert "zorblat" not in got[0] and "<email>" in got[0] and "<phone>" in got[6] and "dial" not in got[6] and "<secret>" in got[18] and "hush" not in got[18]
    assert got[-3] == "please  now"


def test_registered_columns(spark):
    rows = {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    kinds = {w for level, _, w in plain_pairs(list(rows.values())) if level == 2}
    got = registry.QUERIES["op4_pii"](spark, SF).collect()
    assert len(got) == len(rows) and sum(r["n_secret"] for r in got) > 0
    for r in got:
        t = rows[r["doc_id"]]
        base = plain_spans(t)
        text = lambda spans: ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in base) for k in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text(base).encode()).hexdigest()
        parts = r["spans"].split(",") if r["spans"] else []
        assert parts[: len(base)] == [p for p in text(base).split(",") if p] and len(parts) == len(base) + r["n_secret"] + r["n_term"]
        assert all(t[int(a) : int(b)].lower() in kinds for k, a, b in (p.split(":") for p in parts) if k == "term")


@pytest.mark.parametrize("extra", ["pii_spans", "_text", "terms", "key", "c0"])
def test_awkward_rows_and_names(spark, extra):
    rows = [(1, None, 7), (2, "", None), (2, "", None), (None, "a@b.co " * 3, 1), (4, "x" * 100_000 + " 1.2.3.4", 2)]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, `{extra}` long")
    want = [(1, None, 7), (2, "", None), (2, "", None), (None, "<email> " * 3, 1), (4, "x" * 100_000 + " <ip>", 2)]
    by = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, pii.sanitise(docs).collect()), key=by) == sorted(want, key=by)
    assert sorted(len(r["pii_spans"]) for r in pii.find(docs).collect()) == [0, 0, 0, 1, 3]
    assert pii.sanitise(docs.where(F.lit(False))).count() == 0 and pii.find(docs.where(F.lit(False))).count() == 0
