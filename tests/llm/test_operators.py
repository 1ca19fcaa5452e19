"""The corpus operators against brute force, on the smallest tables and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemark.llm import bpe, fingerprint, html_text, jaccard_join, language, media, quality, registry, url_filter

SF = "/root/testdata/sf0.001"
DOCS = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (3, "word", "a"), (None, "  \n\t ", "a"), (4, "a b c d e f g " * 3000, "a"), (5, "ünï ☃ +1 (555) 123-4567 a@b.co", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_language_held_out(spark):
    got = registry.QUERIES["op1_language"](spark, SF).toPandas().set_index("doc_id")
    held = got[got.held_out]
    assert len(got) == len(DOCS)
    assert np.mean([DOCS[k]["lang"] == r.lang_pred for k, r in held.iterrows()]) > 0.97
    assert got.score.between(0, 1).all()


def test_language_awkward(spark, awkward):
    out = {(r["doc_id"], r["source"]): r["lang_pred"] for r in language.detect(awkward, {"aa": [ord("w")], "bb": [ord("x")]}).collect()}
    assert out[1, "x"] == out[2, None] == out[None, "a"] == "und" and out[3, "a"] == "aa"
    assert language.detect(awkward.limit(0), {}).count() == 0


def test_quality_held_out(spark):
    got = registry.QUERIES["op3_quality"](spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    want = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pylist()}
    assert np.mean([want[k] == r.predicted for k, r in got[got.held_out].iterrows() if k in want]) > 0.97


def test_quality_awkward(spark, awkward):
    model = quality.fit_pairs(np.zeros((0, len(quality.FEATURES))), np.zeros(0))
    assert all(abs(r["quality_score"] - 0.3) < 1e-9 for r in quality.score(awkward, model).collect())


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    own, lib = bpe.Bpe(bpe.load(bpe.default_path())), Tokenizer.from_file(bpe.default_path())
    texts = [r["text"] for r in DOCS.values()] + ["", "I'LL İstanbul éẽ <|endoftext|>x<|startoftext|> ΑΣ ½ \x1c \x85", "日本 🎉👍🏽 ​\xa0", "a" * 5000]
    for text, ids in zip(texts, own.encode_all(texts)):
        ids = np.frombuffer(ids, "<u4")
        want = lib.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want and own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_media_round_trip(spark, awkward):
    for docs, texts in ((spark.read.parquet(f"{SF}/documents.parquet"), [(k, r["text"]) for k, r in DOCS.items()]), (awkward, [(r[0], r[1]) for r in awkward.collect()])):
        got = sorted((str(r["id"]), r["n_bytes"], bytes(r["media"])) for r in media.read(media.store(docs)).collect())
        assert got == sorted((str(k), len((t or "").encode()), media.to_media(media.payload_of(t))) for k, t in texts)


def test_fingerprints(spark, awkward):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_fingerprint"](spark, SF).collect()}
    order, words, off = sorted(DOCS, reverse=True), re.compile(r"\w+").findall, []
    for i, k in enumerate(order):
        text, other = DOCS[k]["text"], DOCS[order[(i + 1) % len(order)]]["text"]
        changed = fingerprint.edited(text, other)
        assert got[k]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[k]["n_chars"] == len(text)
        a, b = Counter(words(text.lower())), Counter(words(changed.lower()))
        off.append(got[k]["near_edited"] - sum((a & b).values()) / max(1, sum((a | b).values())))
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    assert fingerprint.compare_with_edited(awkward).count() == awkward.count()


@pytest.mark.parametrize("rare", [20_000, 200_000])
def test_fingerprints_of_many_distinct_words(rare):
    found, sampler = [], fingerprint.Sampler(256, most=1000)
    common = [int(0.1 * rare / (i + 1)) for i in range(200)]  # shared; each text has rare words of its own
    for pair in range(2):
        shared = " ".join(f"f{pair}x{i} " * n for i, n in enumerate(common))
        a, b = (sampler.sign(shared + " ".join(f"{side}{pair}x{i}" for i in range(rare))) for side in "ab")
        found.append(fingerprint.likeness(a, b))
    assert abs(np.mean(found) - sum(common) / (sum(common) + 2 * rare)) < 0.06


def test_repeated_runs_of_open_pages(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    menu, foot, rows, want = some(14), some(20), [], {}
    for i in range(40):
        parts = [some(30) for _ in range(2)]
        rows.append((i, f"http://h{i % 2}.org/{i}", f"<div>{menu}</div><p>{parts[0]}</p>{parts[1]}<div>{foot}</div>"))
        want[i] = "\n".join(parts)
    rows += [(90, None, None), (91, "x", ""), (92, "http://h0.org", "<nav>menu</nav><article><h1>T&amp;t</h1><p>a <b>b<br><p>c</article><footer>f")]
    want |= {90: "", 91: "", 92: "T&t\na b\nc"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (200, 10**6):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages, shard=shard).collect()} == want


def test_section_menu_of_a_large_host(spark):
    menu, rows, want = " ".join(f"m{k}" for k in range(12)), [], {}
    for i in range(400):
        own = " ".join(f"p{i}w{k}" for k in range(30))
        rows.append((i, f"http://h.org/{i}", f"<div>{menu}</div><p>{own}</p>" if i % 20 == 0 else f"<p>{own}</p>"))  # on 5 % of the pages
        want[i] = own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shard in (3000, 10**6):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages, shard=shard).collect()} == want


def test_suffix_array_counts():
    rng = np.random.default_rng(1)
    streams = [rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(12)]
    want = defaultdict(set)
    for k, s in enumerate(streams):
        for h in html_text.run_hashes(s, 5).tolist():
            want[h].add(k)
    grams, n = html_text.repeated(streams, 5)
    assert dict(zip(grams.tolist(), n.tolist())) == {h: len(k) for h, k in want.items()}


def test_url_rules(spark):
    urls = [None, "no scheme", "HTTP://A.Example.NET/en/x?q#f", "http://net", "http://x.net/", "http://example.com/de/1", "http://notexample.com/de/1", "http://b.org/fr/", "http://m.spam-farm.example.org/es"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(urls)], "page_id long, url string, extra string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.url_filter(df, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {0: (None, "allow"), 1: (None, "allow"), 2: ("example.net/en/", "allow"), 3: (None, "allow"), 4: ("net/", "block"), 5: ("example.com/de/", "block"), 6: (None, "allow"), 7: ("org/fr/", "allow"), 8: (None, "allow")}


@pytest.mark.parametrize("leaf,block", [(128, 512), (3, 4)])
def test_jaccard_join_is_exact(spark, leaf, block):
    rng, rows = random.Random(4), [(k, r["text"]) for k, r in list(DOCS.items())[:80]]
    base = [f"v{rng.randrange(500)}" for _ in range(120)]
    for i in range(30):
        words = list(base)
        for _ in range(i % 4):
            words[rng.randrange(120)] = "new"
        rows.append((1000 + i, " ".join(words)))
    rows += [(2000, None), (2001, ""), (2002, "one two"), (2003, "one two"), (2004, "one  two")]
    sets = {k: frozenset(tuple((t or "").split()[i : i + 5]) for i in range(max(1, len((t or "").split()) - 4))) if (t or "").split() else frozenset() for k, t in rows}
    links, parent = Counter(), {k: k for k in sets}
    root = lambda x: x if parent[x] == x else root(parent[x])
    for a in sets:
        for b in sets:
            if a < b and (u := len(sets[a] | sets[b])) and len(sets[a] & sets[b]) / u >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[max(root(a), root(b))] = min(root(a), root(b))
    parent[2001] = 2000  # null and empty are one text
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard_join.with_classes(docs, leaf=leaf).collect()}
    assert got == {k: (root(k), links[k]) for k in sets}
    assert jaccard_join.one_of_each(docs).count() == len({root(k) for k in sets})
    found = {r["key"]: r["n_links"] for r in jaccard_join.jaccard_links(docs, leaf=leaf, block=block).collect()}
    assert all(found[hashlib.md5((t or "").encode()).digest()] == links[k] for k, t in rows)


def test_candidates_reach_the_recall_at_full_depth(spark):
    """Isolated pairs whose samples are equal with probability 0.8; leaf=1 splits every node that holds a pair to the last depth."""
    rng, n = np.random.default_rng(11), 3000
    left = rng.integers(0, 1 << 32, (n, jaccard_join.SKETCH), dtype=np.uint32)
    right = np.where(rng.random(left.shape) < 0.8, left, rng.integers(0, 1 << 32, left.shape, dtype=np.uint32))
    rows = [(bytes([side]) + i.to_bytes(15, "big"), bytearray(m[i].tobytes())) for side, m in enumerate((left, right)) for i in range(n)]
    found = spark.createDataFrame([(bytearray(k), s) for k, s in rows], "key binary, sketch binary")
    edges = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in jaccard_join.candidate_edges(found, leaf=1).collect()}
    assert all(len({k[1:] for k in e}) == 1 for e in edges) and len(edges) / n > 0.986  # 0.99 less two standard deviations


def test_exact_links_between_blocks():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
    sets = []
    for _ in range(40):
        own = rng.integers(0, 1 << 62, rng.integers(0, 9)).astype(np.uint64)
        sets.append(np.unique(np.concatenate([rng.choice(base, rng.integers(30, 41), replace=False), own])))
    rows, columns, copies = np.arange(0, 20), np.arange(20, 40), rng.integers(1, 4, 40)
    want = {(i, j) for i in rows.tolist() for j in columns.tolist() if len(x := np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) and len(x)}
    links, a, b = jaccard_join.exact_links(sets, copies, 0.8, rows, columns)
    assert set(zip(a.tolist(), b.tolist())) == want and 0 < len(want) < 400
    assert links.tolist() == [sum(int(copies[y if x == k else x]) for x, y in want if k in (x, y)) for k in range(40)]


def test_exact_links_ignore_ngrams_of_one_side():
    shared, own = np.arange(1, 21) << 40, (np.arange(1, 6) + 49_000) << 40  # own ones stand side by side before the other's last
    sets = [np.concatenate([shared, own]).astype(np.uint64), np.append(shared, 50_000 << 40).astype(np.uint64)]
    links, a, b = jaccard_join.exact_links(sets, np.array([1, 1]), 0.8, np.array([0]), np.array([1]))  # 20 of 26
    assert not links.any() and not len(a) and not len(b)


def test_crc_of_tail():
    assert media.describe(media.to_media(media.payload_of("")))[2] == zlib.crc32(b"\xff" * 32)
