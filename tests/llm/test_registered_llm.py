"""The registered corpus queries against plain versions on the smallest tables."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, fingerprint, language, media, quality, registry

SF = "/root/testdata/sf0.001"
DOCS = {r["doc_id"]: r for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
PAGES = pq.read_table(f"{SF}/pages.parquet").to_pylist()


def part(key, parts):
    return zlib.crc32(str(key).encode()) % parts


def plain_grams(text):
    """n-grams of 1 to 3 code points of words of lower-case letters between separators."""
    words = ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(r"[^\W\d_]+", "".join(c if c.isalpha() else " " for c in text))]
    line = "\x01" + "\x01".join(words) + "\x01"
    found = Counter()
    for n in (1, 2, 3):
        found.update(line[i : i + n] for i in range(len(line) - n + 1) if line[i : i + n] != "\x01")
    return found if words else Counter()


def ranked(counts, most):
    number = lambda g: sum(ord(c) << (21 * (len(g) - 1 - i)) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda p: (-p[1], number(p[0])))[:most]]


def test_language_equals_a_plain_version(spark):
    totals = defaultdict(Counter)
    for k, r in DOCS.items():
        if part(k, 4) != 2 and r["text"] is not None and r["lang"] is not None:
            totals[r["lang"]].update(plain_grams(r["text"]))
    profiles = {x: {g: i for i, g in enumerate(ranked(c, language.PROFILE))} for x, c in totals.items()}
    for r in registry.QUERIES["op1_language"](spark, SF).collect():
        own = ranked(plain_grams(DOCS[r["doc_id"]]["text"] or ""), language.PROFILE)
        assert r["held_out"] == (part(r["doc_id"], 4) == 2)
        if not own:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        far = {x: sum(abs(p[g] - i) if g in p else language.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
        near = {x: 1 - f / (language.PROFILE * len(own)) for x, f in far.items()}
        assert r["lang_pred"] == min(far, key=lambda x: (far[x], x))
        assert r["score"] == pytest.approx(near[r["lang_pred"]] / sum(near.values()))


def test_quality_equals_a_plain_version(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist() if part(r["doc_id"], 5)}
    rows = [(labels[k], quality.features(DOCS[k]["text"])) for k in labels if k in DOCS]
    x, y = np.array([f for _, f in rows]), np.array([q for q, _ in rows])
    z = (x - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    model = quality.fit_pairs(*(v[np.lexsort((*x.T, y))] for v in (x, y)))
    w = np.array(model.weights)
    a, b = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    loss = lambda v: float(np.mean([math.log1p(math.exp(-float(np.clip((z[i] - z[j]) @ v, -40, 40)))) for i in a[:40] for j in b[:40]]))
    assert len(a) and len(b) and loss(w) < loss(np.zeros(len(w))) / 3  # preferred ones come out stronger
    strength = z @ w
    errors = lambda t: int(((strength >= t) != (y == 1)).sum())
    assert errors(model.threshold) == min(errors(t) for t in (*strength, math.inf))  # the quantile with the fewest errors
    for r in registry.QUERIES["op3_quality"](spark, SF).collect():
        f = (np.array(quality.features(DOCS[r["doc_id"]]["text"])) - x.mean(0)) / np.where(x.std(0) > 1e-9, x.std(0), 1.0)
        want = 1 / (1 + math.exp(-max(-40, min(40, f @ w - model.threshold + math.log(0.3 / 0.7)))))
        assert r["score"] == pytest.approx(want, abs=1e-6) and r["held_out"] == (part(r["doc_id"], 5) == 0)
        assert r["predicted"] == (r["score"] >= 0.3) or abs(want - 0.3) < 1e-6


def test_media_equals_a_plain_version(spark):
    for r in registry.QUERIES["op5_media"](spark, SF).collect():
        raw = (DOCS[r["doc_id"]]["text"] or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        stored = b"P5\n576 %d\n255\n" % (len(payload) // 576) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-32:])
        bins = Counter(b >> 4 for b in payload)
        assert r["feature"] == f"rows={len(payload) // 576};sum={sum(payload)};hist={','.join(str(bins[i]) for i in range(16))}"


def test_cuts_equal_a_rolling_hash_byte_by_byte():
    rng = np.random.default_rng(3)
    for size in (0, 1, 600, 5000, 60_000):
        data = rng.integers(0, 256, size, dtype=np.uint8).tobytes() + bytes(20_000)
        h, ends, start = 0, [], 0
        for i, byte in enumerate(data, 1):
            h = ((h << 1) + int(media._GEAR[byte])) & 0xFFFFFFFF  # what is 32 bytes back has left the word
            if (h >> (32 - media.CUT_BITS) == 0 and i - start >= media.LEAST) or i - start == media.MOST:
                ends.append(i)
                start = i
        if start < len(data):
            ends.append(len(data))
        assert media.cuts(data) == ends


def test_chunks_are_stored_once(spark):
    shared = "".join(chr(97 + int(b) % 26) for b in np.random.default_rng(1).integers(0, 256, 50_000))
    docs = spark.createDataFrame([(i, f"{i} " * (i + 1) + shared) for i in range(6)] + [(10, shared), (11, shared), (12, "own")], "doc_id long, text string")
    store = media.store(docs)
    chunks = [r["digest"] for r in store.chunks.collect()]
    every = [d for r in store.objects.where("shared").collect() for d in r["digests"]]
    assert len(chunks) == len(set(chunks)) == len(set(map(bytes, every))) and len(every) > 3 * len(chunks)
    assert store.objects.where("not shared").count() == 1
    assert {r["id"]: bytes(r["media"]) for r in media.read(store).collect()} == {r["doc_id"]: media.to_media(media.payload_of(r["text"])) for r in docs.collect()}


class Plain(HTMLParser):
    """Text of article, a line a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines, self.line = 0, [], []

    def close_block(self):
        if words := "".join(self.line).split():
            self.lines.append(" ".join(words))
        self.line = []

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1", "h2", "div", "br", "li", "article"):
            self.close_block()

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "div", "li", "article"):
            self.close_block()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.line.append(data)


def test_pages_equal_a_plain_version(spark):
    got = {r["page_id"]: r for r in registry.QUERIES["op6_html"](spark, SF).collect()}
    assert len(got) == len(PAGES)
    for p in PAGES:
        plain = Plain()
        plain.feed(p["html"] or "")
        plain.close_block()
        assert got[p["page_id"]]["text"] == "\n".join(plain.lines) and got[p["page_id"]]["n_chars"] == len("\n".join(plain.lines)) and got[p["page_id"]]["url"] == p["url"]


def test_url_filter_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = sorted(map(str, con.sql(registry.SQL["op7_url_filter"]).fetchall()))
    got = registry.QUERIES["op7_url_filter"](spark, SF).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(str(tuple(r)) for r in got) == want


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = {r[0]: (r[1], r[2], r[4], r[5]) for r in con.sql(registry.SQL["op2_mixing"]).fetchall()}
    got = registry.QUERIES["op2_mixing"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], r["taken"], r["copies"]) for r in got} == want


def test_jaccard_equals_all_pairs(spark):
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r["text"] or "").split()) else set() for k, r in DOCS.items()}
    links, least = Counter(), {k: k for k in sets}
    for a in sets:
        for b in sets:
            if a < b and (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0):
                links[a] += 1
                links[b] += 1
                x, y = sorted((least[a], least[b]))
                least = {k: x if v == y else v for k, v in least.items()}
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in registry.QUERIES["op8_jaccard"](spark, SF).collect()}
    assert got == {k: (least[k], links[k]) for k in sets}


def test_fingerprint_likeness_of_the_next_text(spark):
    got = {r["doc_id"]: r for r in registry.QUERIES["op9_fingerprint"](spark, SF).collect()}
    order, words = sorted(DOCS, reverse=True), re.compile(r"\w+").findall
    off = []
    for i, k in enumerate(order):
        after = order[(i + 1) % len(order)]
        a, b = (Counter(words(DOCS[x]["text"].lower())) for x in (k, after))
        off.append(got[k]["near_next"] - sum((a & b).values()) / max(1, sum((a | b).values())))
        same = [x == y for x, y in zip(re.findall("....", got[k]["fingerprint"]), re.findall("....", got[after]["fingerprint"]))]
        assert got[k]["near_next"] == pytest.approx(np.mean(same)) and len(same) == fingerprint.SAMPLES
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08


def test_bpe_equals_the_library_through_spark(spark):
    library = Tokenizer.from_file(bpe.default_path())
    for r in registry.QUERIES["op10_bpe"](spark, SF).collect():
        ids = library.encode(DOCS[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_of_all_code_points_and_other_files():
    own, library = bpe.Bpe(bpe.checked(bpe.load(bpe.default_path()))), Tokenizer.from_file(bpe.default_path())
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "".join(f"x{c}{c}1 " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    for got, want in zip(own.encode_all(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, "<u4").tolist() == want.ids
    spec = bpe.load(bpe.default_path())
    for change in ({"normalizer": None}, {"decoder": {"type": "BPEDecoder"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": spec["model"] | {"byte_fallback": True}}):
        with pytest.raises(ValueError):
            bpe.checked(json.loads(json.dumps({k: v for k, v in spec.items() if k != "model"})) | {"model": spec["model"]} | change)
