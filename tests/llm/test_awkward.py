"""Every corpus operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables, and on extra
columns whose names clash with those used inside."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import bpe, fingerprint, html_text, jaccard_join, language, media, mixing, quality, url_filter

NAMES = ["_text", "_key", "key", "c0", "a0", "size", "rate", "row", "digest", "quality_score", "pii_spans", "ids", "copies", "_copy", "target"]
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [(1, None, "x"), (2, "", None), (2, "", None), (3, "word", "a"), (3, "word", "a"), (None, "  \n\t ", "a"), (4, LONG, "a"), (5, "ünï ☃ +1 (555) 123-4567 a@b.co", "b")]


def table(spark, extra=NAMES):
    schema = "doc_id long, text string, source string, lang string, n_chars long" + "".join(f", `{n}` string" for n in extra)
    return spark.createDataFrame([(*r, "xx", None if r[1] is None else len(r[1]), *(f"{n}!" for n in extra)) for r in ROWS], schema)


def kept(got, extra=NAMES, but=()):
    rows = got.collect()
    assert all(r[n] == f"{n}!" for r in rows for n in extra if n not in but)
    return rows


def test_language(spark):
    docs = table(spark)
    got = kept(language.detect(docs, {"bb": [ord("w")], "aa": [ord("w")]}))
    assert len(got) == len(ROWS) and {r["lang_pred"] for r in got if not (r["text"] or "").strip()} == {"und"}
    assert [r["lang_pred"] for r in got if r["text"] == "word"] == ["aa", "aa"]  # a tie goes to the first by name
    assert language.learn(docs.where(F.lit(False))) == {} and set(language.learn(docs)) == {"xx"}
    assert language.detect(docs.limit(0), {}).count() == 0


def test_quality(spark):
    docs = table(spark, [n for n in NAMES if n != "quality_score"])
    labels = spark.createDataFrame([(3, 1), (3, 1), (5, 0), (4, 0), (None, 1), (2, 7), (99, 0)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = kept(quality.score(docs, model), [n for n in NAMES if n != "quality_score"])
    assert len(got) == len(ROWS) and all(0 <= r["quality_score"] <= 1 for r in got)
    assert len({r["quality_score"] for r in got if r["text"] == "word"}) == 1
    assert quality.score(docs.limit(0), model).count() == 0
    bare = quality.learn(docs.limit(0), labels)
    assert all(abs(r["quality_score"] - quality.CUT) < 1e-9 for r in quality.score(docs, bare).collect())
    assert quality.learn(docs, labels, most_rows=2).weights is not None


def test_learning_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"good words here {i}") for i in range(50)] + [(2, "bad!! bad!! " * i) for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    fit = quality.fit_pairs
    try:
        quality.fit_pairs = lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k)
        quality.learn(docs, labels, most_rows=20)
    finally:
        quality.fit_pairs = fit
    assert seen == [20]


def test_mixing(spark):
    got = kept(mixing.mix(table(spark)), but=("size", "copies", "target"))
    assert len(got) == len(ROWS) and sorted(r["size"] for r in got)[:4] == [0, 0, 0, 0]
    mixed = kept(mixing.mixed(table(spark)))
    assert mixing.mixed(table(spark).limit(0)).count() == 0 and mixing.mix(table(spark).limit(0)).count() == 0
    assert len(mixed) == sum(r["copies"] for r in got)
    again = mixing.mixed(table(spark)).collect()
    assert sorted(map(str, mixed)) == sorted(map(str, again))


def test_mixing_of_one_id(spark):
    docs = spark.createDataFrame([(7, f"text {i} " + "w " * (i % 9), "s") for i in range(300)] + [(8, "other words", "t")], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    for s in "st":
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 3 * 12


def test_media(spark):
    got = media.read(media.store(table(spark))).collect()
    assert sorted(bytes(r["media"]) for r in got) == sorted(media.to_media(media.payload_of(t)) for _, t, _ in ROWS)
    assert media.read(media.store(table(spark).limit(0))).count() == 0


def test_html(spark):
    rows = [(1, None, None), (2, "http://h.org/a", ""), (3, "http://h.org/b", "<p>one<p>two"), (3, "http://h.org/b", "<p>one<p>two"), (4, "x", "<article>" + "<p>w v</p>" * 20_000 + "</article>")]
    names = ["site", "page", "html_", "row", "lines", "c0", "text_", "key"]
    pages = spark.createDataFrame([(*r, *(f"{n}!" for n in names)) for r in rows], "page_id long, url string, html string" + "".join(f", {n} string" for n in names))
    got = kept(html_text.extract(pages), names)
    assert sorted(r["text"] for r in got)[:4] == ["", "", "one\ntwo", "one\ntwo"] and max(len(r["text"]) for r in got) == 4 * 20_000 - 1
    assert html_text.extract(pages.limit(0)).count() == 0


def test_repeats_decide_before_structure(spark):
    """On a site whose pages share a menu and a footer, the same text comes out with and without the lists of names."""
    rng = np.random.default_rng(2)
    some = lambda n: " ".join(f"w{rng.integers(5000)}" for _ in range(n))
    menu, foot = [some(1) for _ in range(9)], some(12)
    rows, want = [], {}
    for i in range(30):
        own = some(40)
        rows.append((i, f"http://{'abc'[i % 3]}.site.org/{i}", f"<nav><ul>{''.join(f'<li>{m}</li>' for m in menu)}</ul></nav><div>{own}</div><footer>{foot} {i}</footer>"))
        want[i] = own
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for structure in (True, False):
        assert {r["page_id"]: r["text"] for r in html_text.extract(pages, structure=structure).collect()} == want


def test_url_filter(spark):
    names = ["own_url", "digest", "expr_host", "n", "best"]
    rows = [(1, None), (2, "http://a.b.org/fr/x"), (2, "http://a.b.org/fr/x"), (3, "http://" + "a." * 200 + "net/" + "p" * 20_000), (4, "://"), (5, "http://org/fr/")]
    pages = spark.createDataFrame([(*r, *(f"{n}!" for n in names)) for r in rows], "page_id long, url string" + "".join(f", {n} string" for n in names))
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = kept(url_filter.url_filter(pages, rules), names)
    assert sorted((r["page_id"], r["verdict"]) for r in got) == [(1, "allow"), (2, "allow"), (2, "allow"), (3, "block"), (4, "allow"), (5, "allow")]
    assert url_filter.url_filter(pages.limit(0), rules).count() == 0
    none = url_filter.url_filter(pages, rules.limit(0), default="block").collect()
    assert {r["verdict"] for r in none} == {"block"} and {r["rule"] for r in none} == {None}
    ties = url_filter.rule_table(spark, [("allow", "b.org", "/"), ("block", "b.org", "/"), ("block", "a.b.org", ""), ("allow", "org", "/fr/")])
    assert {r["rule"] for r in url_filter.url_filter(pages, ties).where("page_id = 2").collect()} == {"a.b.org"}  # of equal length the longer host


def test_jaccard(spark):
    docs = table(spark)
    got = jaccard_join.with_classes(docs).collect()
    by = {(r["doc_id"], r["class_id"], r["n_links"]) for r in got}
    assert len(got) == len(ROWS) and by == {(1, 1, 0), (2, 1, 0), (3, 3, 1), (None, None, 0), (4, 4, 0), (5, 5, 0)}
    one = kept(jaccard_join.one_of_each(docs))
    assert sorted(str(r["doc_id"]) for r in one) == ["1", "3", "4", "5", "None"]
    assert jaccard_join.with_classes(docs.limit(0)).count() == 0 and jaccard_join.one_of_each(docs.limit(0)).count() == 0


def test_fingerprint(spark):
    docs = table(spark)
    got = kept(fingerprint.fingerprint(docs))
    assert len({r["fingerprint"] for r in got}) == 4 and fingerprint.fingerprint(docs.limit(0)).count() == 0
    assert fingerprint.compare_with_edited(docs).count() == len(ROWS)


def test_bpe(spark):
    docs = table(spark, [n for n in NAMES if n != "ids"])
    ids = bpe.encode(docs, bpe.default_path())
    got = kept(bpe.decode(ids, bpe.default_path()), [n for n in NAMES if n != "ids"])
    assert len(got) == len(ROWS) and all((r["ids"] == []) == (not (r["text"] or "").strip()) for r in got)
    assert bpe.digests(docs.limit(0), bpe.default_path()).count() == 0 and bpe.encode(docs.limit(0), bpe.default_path()).count() == 0


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages(spark, empty):
    docs = table(spark).where(F.lit(not empty))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            kept(out)
        assert (out.count() == 0) == empty
        if not empty and name == "near duplicates":
            assert out.count() == 5
