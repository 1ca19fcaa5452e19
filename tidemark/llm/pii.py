"""Personal data: patterns find entities, corpus co-occurrence finds the terms that give them away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers; secrets (runs of SECRET characters or more
that look random) are entities too. An entity is known on three levels: its value, its group (mail domain, first half of
an address, issuer of a card, exchange of a phone) and its kind. Terms within WINDOW words of an entity may disclose it:
with n(c), n(t) and n(c, t) counted over the documents that hold entity c, term t anywhere, and t near c, the pointwise mutual
information log2(N n(c,t) / (n(c) n(t))) over the entity's information log2(N / n(c)) is the share of the entity that the
term reveals. A pair discloses if that share is at least DISCLOSURE and chance doesn't explain it: with x = n(c) n(t) / N
meetings expected, k different texts or more are as likely as exp(k - x - k ln(k / x)) at most (the bound on a Poisson
count), and this may be CHANCE at most after division among all pairs of the corpus that are tested. There is no least number
of texts: rare pairs pass where the corpus is large enough to tell.

Terms that disclose a kind are sanitised wherever they occur, for they show entities that no pattern finds. Terms that disclose
a value or a group are sanitised in the documents where they stand near it; documents without entities keep them. Entities
become their kind in brackets, disclosing numbers <number>, and other disclosing terms go.

Counts cover every document. A term's documents are first counted among those that hold entities; pairs that fail with these
alone fail with all, so the words of the whole corpus are counted only for the others' terms. A bounded hash filter (32 MB at
most) takes them out of the texts, and an exact join settles them. Terms reach documents by a join on the digest of the text, so
nothing that grows with the data is broadcast or collected.

Defined results: a null text counts as empty and has no spans; sanitising leaves a null text null. Texts may be of any
length. Repeated rows count as documents, but only different texts count for k, and equal texts have equal spans. Ties don't
matter. An empty table gives an empty result. Columns of the input are kept, whatever their names; an added one replaces one
of the same name.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tidemark.llm.common import HashFilter, WordHashes, free_name, map_arrow, map_text, pieces, quoted, stored, text_hash

WINDOW, DISCLOSURE, CHANCE, SECRET, BLOCK = 10, 0.8, 0.01, 20, 200_000
KINDS = ("email", "ip", "card", "phone", "secret", "term")
_SECRET, _TERM = 4, 5
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits that fails from its first digit fails from each later one, so starts within a run are skipped.
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])++").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_secret = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+={0,2}" % SECRET).finditer
_turns = re.compile(r"[0-9][A-Za-z]|[A-Za-z][0-9]").findall
_digit = re.compile(r"[0-9]").search
_word = re.compile(r"\w+")
Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """At each @ the longest local part before it, back to the last match, and the domain after it."""
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _domain(text, at + 1)):
            found.append((0, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[Span]:
    """Spans by kind, then start."""
    found = emails(text) if "@" in text else []
    if _digit(text):
        found += [(1, *m.span()) for m in _ip(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or 0) <= 255 for p in m[0].split("."))]
        for m in _card(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, *m.span()))
        if "+" in text:
            found += [(3, *m.span()) for m in _phone(text) if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return found


def random_looking(run: str) -> bool:
    """Letters and digits in turn, and characters of 3 bits of entropy or more."""
    if len(_turns(run)) < 4:
        return False
    return -sum(n / len(run) * math.log2(n / len(run)) for n in Counter(run).values()) >= 3.0


def secret_spans(text: str, base: list[Span]) -> list[Span]:
    """Secrets that touch no base span."""
    if not _digit(text):
        return []
    found = [(_SECRET, *m.span()) for m in _secret(text) if random_looking(m[0])]
    return [s for s in found if not any(a < s[2] and s[1] < b for _, a, b in base)] if found else []


def all_entities(text: str) -> list[Span]:
    base = base_spans(text)
    return base + secret_spans(text, base)


def _key(kind: int, level: str, value: str) -> str:
    return hashlib.sha256(f"{KINDS[kind]}:{level}:{value}".encode("utf-8", "surrogatepass")).hexdigest()[:24]


def levels(kind: int, text: str) -> tuple[str, str | None, str]:
    """Keys of an entity's value, group and kind; what is written differently but means the same is one."""
    digits = re.sub(r"[^0-9]", "", text)
    if kind == _SECRET:
        return _key(kind, "value", text), None, KINDS[kind]
    value = text.lower() if kind < 2 else digits
    group = (value.partition("@")[2], ".".join(value.split(".")[:2]), digits[:6], digits[:-4])[kind]
    return _key(kind, "value", value), _key(kind, "group", group), KINDS[kind]


def near_terms(text: str, spans: list[Span], window: int = WINDOW) -> set[tuple[str, str | None, str, str]]:
    """(value, group, kind, term) for the words within `window` words before and after each span, words in spans excepted."""
    words = [m.span() for m in _word.finditer(text)] if spans else []
    starts = [a for a, _ in words]
    covered = sorted((a, b) for _, a, b in spans)
    found = set()
    for kind, a, b in spans:
        keys = levels(kind, text[a:b])
        first, after = bisect_left(starts, a), bisect_left(starts, b)
        for x, y in words[max(0, first - window) : first] + words[after : after + window]:
            i = bisect_left(covered, (y, 0))
            if not (i and covered[i - 1][1] > x):
                found.add((*keys, text[x:y].lower()))
    return found


_hashes = WordHashes()
_NEAR = ("value", "group", "kind", "term", "key", "n")


def meetings(given: DataFrame, window: int = WINDOW) -> DataFrame:
    """value, group, kind, term, key (digest of the text), n (its rows): which terms stand near which entities. An empty term
    stands for the entity alone; an empty kind for the term's standing anywhere in a document with entities. given: one column
    `text`."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found: Counter = Counter()
            for t in batch.column("text").to_pylist():
                if t and (spans := all_entities(t)):
                    key = hashlib.md5(t.encode("utf-8", "surrogatepass")).digest()
                    alone = {(*levels(k, t[a:b]), "") for k, a, b in spans}
                    found.update((*m, key) for m in near_terms(t, spans, window) | alone)
                    found.update((None, None, "", w, None) for w in set(_word.findall(t.lower())))
            cols = [*zip(*found)] or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:4]), pa.array(cols[4], pa.binary()), pa.array(list(found.values()), pa.int64())], _NEAR)

    rows = given.transform(map_arrow, near, "value string, group string, kind string, term string, key binary, n long")
    return rows.groupBy("value", "group", "kind", "term", "key").agg(F.sum("n").alias("n"))


def _levels(met: DataFrame) -> DataFrame:
    """meetings() with one row a level: level (0 value, 1 group, 2 kind), entity, term, key, n."""
    each = F.array(*(F.struct(F.lit(i).alias("level"), F.col(c).alias("entity")) for i, c in enumerate(_NEAR[:3])))
    rows = met.select(F.explode(each).alias("at"), "term", "key", "n").select("at.*", "term", "key", "n").where("entity is not null")
    return rows.groupBy("level", "entity", "term", "key").agg(F.max("n").alias("n"))


def _hits(given: DataFrame, terms: DataFrame, count: bool) -> DataFrame:
    """Words of the texts that are one of `terms`: term, n_term (documents with it); or key, term, a row a text and term. A hash filter
    takes them out of the texts, an exact join settles them."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_hashes.of(batch.column("term").to_pylist()).view(np.int64))], ["low"])

    sent = given.sparkSession.sparkContext.broadcast(HashFilter.build(terms.transform(map_arrow, hashed, "low long"), "low", 1 << 22))

    def words_of(text: str | None) -> list[str]:
        words = list(set(_word.findall(text.lower()))) if text else []
        return [words[i] for i in np.flatnonzero(sent.value.hits(_hashes.of(words))).tolist()] if words else []

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Given out when BLOCK words have gathered."""
        total: Counter = Counter()
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
        for batch in pieces(batches, "text"):
            for t in batch.column("text").to_pylist():
                total.update(words_of(t))
            if len(total) >= BLOCK:
                yield rows()
                total.clear()
        yield rows()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            found = {t: words for t in batch.column("text").to_pylist() if (words := words_of(t))}
            keys = [hashlib.md5(t.encode("utf-8", "surrogatepass")).digest() for t in found]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, w in zip(keys, found.values()) for _ in w], pa.binary()), pa.array([x for w in found.values() for x in w], pa.string())], ["key", "term"])

    if count:
        return given.transform(map_arrow, counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term")).join(terms, "term", "left_semi")
    return given.transform(map_arrow, placed, "key binary, term string").join(terms, "term", "left_semi").select("key", "term")


def _by_chance(expected: Column) -> Column:
    """Log of the bound on the chance of so many texts, 0 where no more than expected met."""
    k = F.col("texts")
    return F.when(k > expected, k - expected - k * F.log(k / expected)).otherwise(F.lit(0.0))


def _share(n_term: Column, n: int) -> Column:
    information = F.lit(math.log2(n)) - F.log2("n_entity")
    return F.when(information > 0, (information + F.log2("n_near") - F.log2(n_term)) / information).otherwise(F.lit(0.0))


def _discloses(n_term: Column, n: int, disclosure: float, most: float) -> Column:
    """Whether a pair discloses if its term stands in n_term documents; true of no greater number if it isn't of this one."""
    return (_share(n_term, n) >= disclosure) & (_by_chance(F.col("n_entity") * n_term / F.lit(float(n))) <= most)


def disclosing_pairs(docs: DataFrame, text: str = "text", window: int = WINDOW, disclosure: float = DISCLOSURE, chance: float = CHANCE) -> tuple[DataFrame, DataFrame]:
    """The pairs that disclose (level, entity, term, n_near, n_entity, n_term, texts, share), and the meetings by level."""
    given = docs.select(quoted(text).alias("text"))
    raw = stored(meetings(given, window), "pii-met")
    met = stored(_levels(raw.where("kind <> ''")), "pii-levels")
    pairs = stored(met.groupBy("level", "entity", "term").agg(F.sum("n").alias("n_near"), F.count(F.lit(1)).alias("texts")), "pii-pairs")
    named, alone = pairs.where("term <> ''"), pairs.where("term = ''").select("level", "entity", F.col("n_near").alias("n_entity"))
    n_kind = F.lit(None).cast("long")  # a kind has a part of all terms, too many for one task of a join
    for r in alone.where("level = 2").collect():
        n_kind = F.when(F.col("entity") == r["entity"], r["n_entity"]).otherwise(n_kind)
    named = named.where("level < 2").join(alone.where("level < 2"), ["level", "entity"]).unionByName(named.where("level = 2").withColumn("n_entity", n_kind))
    n, tested = max(2, docs.count()), max(1, pairs.where("term <> ''").count())
    most = math.log(chance / tested)
    # with the documents that hold entities alone, a term already stands in n_least: pairs that fail so fail with all documents
    inside = raw.where("kind = ''").groupBy("term").agg(F.sum("n").alias("n_least"))
    able = stored(named.join(inside, "term").where(_discloses(F.greatest("n_least", "n_near"), n, disclosure, most)), "pii-able")
    counts = _hits(given, able.select("term").distinct(), True)
    joined = able.join(counts, "term").withColumn("n_term", F.greatest("n_term", "n_near"))
    passed = joined.withColumn("share", _share(F.col("n_term"), n)).where(_discloses(F.col("n_term"), n, disclosure, most))
    return stored(passed.drop("n_least"), "pii-disclosing"), met


def terms_of_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """key (digest of a text), terms: the terms to be sanitised in it; texts without any have no row."""
    pairs, met = disclosing_pairs(docs, text, **options)
    found = met.where("level < 2 and term <> ''").join(pairs.where("level < 2").select("level", "entity", "term"), ["level", "entity", "term"]).select("key", "term")
    kinds = pairs.where("level = 2").select("term").distinct()
    if kinds.limit(1).count():
        found = found.union(_hits(docs.select(quoted(text).alias("text")), kinds, False))
    return stored(found.groupBy("key").agg(F.collect_set("term").alias("terms")), "pii-terms")


SPANS = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def _with_text_terms(docs: DataFrame, text: str, options: dict) -> tuple[DataFrame, str]:
    """docs with the terms of each text in a column of a free name."""
    key = free_name(docs.columns, "key")
    name = free_name([*docs.columns, key], "terms")
    found = terms_of_texts(docs, text, **options).select(F.col("key").alias(key), F.col("terms").alias(name))
    return docs.withColumn(key, text_hash(quoted(text))).join(found, key, "left").drop(key), name


def spans_of(text: str | None, terms: list[str] | None) -> list[Span]:
    """All spans by kind, then start."""
    spans = all_entities(text or "")
    return with_terms(text, spans, frozenset(terms)) if text and terms else spans


def find(docs: DataFrame, text: str = "text", keep: list[str] | None = None, **options) -> DataFrame:
    """docs (or its columns in `keep`) with pii_spans: base spans, secrets and disclosing terms outside them."""
    given, name = _with_text_terms(docs, text, options)

    def make(texts: pa.Array, terms: pa.Array) -> list[pa.Array]:
        out = [spans_of(*r) for r in zip(texts.to_pylist(), terms.to_pylist())]
        ends = np.concatenate(([0], np.cumsum(list(map(len, out))))).astype(np.int32)
        flat = np.array([s for spans in out for s in spans], np.int32).reshape(-1, 3)
        values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], ["kind", "start", "end"])
        return [pa.ListArray.from_arrays(pa.array(ends), values)]

    return map_text(given, text, [StructField("pii_spans", SPANS)], make, keep=docs.columns if keep is None else keep, also=[name])


def with_terms(text: str, spans: list[Span], terms: frozenset[str]) -> list[Span]:
    """spans and the places of `terms` that touch no span."""
    if not terms or terms.isdisjoint(_word.findall(text.lower())):
        return spans
    covered = sorted((a, b) for _, a, b in spans)
    ends = np.maximum.accumulate([b for _, b in covered]).tolist() if covered else []
    added = []
    for m in _word.finditer(text):
        if m[0].lower() in terms:
            i = bisect_left(covered, (m.end(), 0))
            if not (i and ends[i - 1] > m.start()):
                added.append((_TERM, *m.span()))
    return spans + added


def replaced(text: str, spans: list[Span]) -> str:
    """Entities become their kind in brackets, disclosing numbers <number>; other disclosing terms go. Spans that meet are one."""
    out, at, end = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= end:
            out.append(text[at:a])
            out.append(f"<{KINDS[kind]}>" if kind < _TERM else "<number>" if text[a:b].isdigit() else "")
        end = at = max(end, b)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with `text` sanitised; all other columns as they are."""
    given, name = _with_text_terms(docs, text, options)

    def make(texts: pa.Array, terms: pa.Array) -> list[pa.Array]:
        return [pa.array([None if t is None else replaced(t, s) if (s := spans_of(t, w)) else t for t, w in zip(texts.to_pylist(), terms.to_pylist())], pa.string())]

    out = map_text(given, text, [StructField(text, StringType())], make, keep=docs.columns, also=[name])
    return out.select(*map(quoted, docs.columns))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find(docs, keep=["doc_id"])
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("pii_spans", lambda s: s["kind"] < _SECRET)
    of_kind = lambda k: lambda s: s["kind"] == k  # noqa: E731  one argument: a second one would be the index
    counts = [F.size(F.filter("pii_spans", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(len(KINDS))]
    return found.select("doc_id", *counts[:_SECRET], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("pii_spans")).alias("spans"), *counts[_SECRET:])
