"""Main text of web pages: a suffix array over each site's pages finds what repeats, page structure guards the rest.

A page is cut into blocks. Blocks inside article or main are content and never cut. The token streams of a site's pages
(a mark with the element's name for each block outside content, then its words) are concatenated, and an array of their
suffixes, ordered by their first RUN tokens, finds the substrings of RUN or more tokens that occur on LEAST_PAGES distinct
pages. Tokens that such substrings cover are boilerplate; a block that is covered by half or more goes as a whole, of others
the runs of unique tokens stay. What no repetition shows to be boilerplate is dropped all the same where structure tells
it: menus, headers, footers, sidebars, notices, adverts, forms, comments and the like by element name or class, and all that
stands outside the article of a page that has one (`structure`; both only matter for blocks that repeat too rarely).

A site is a host without its subdomains: the last two labels, three below a country's second level. One of any size is cut
into shards of at most SHARD tokens; each has its own array, and the pages of equal substrings are then summed up over
shards, which gives the counts of the whole site. Pages that are equal in all their text count as one, so copies of a page are
not taken for boilerplate. Pages are parsed once, into a stored table of their blocks.

Defined results: null or empty html gives an empty text; so does a page without visible content. A null URL belongs to the
site ''. Unclosed and misnested tags are closed by the next end tag that fits; a tag that never ends is dropped. Pages may
be of any length. Repeated rows get equal texts. An empty table gives an empty result. Columns of the input are kept, whatever
their names; one named as the result is replaced.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm.common import WordHashes, map_arrow, map_text, mix64, pieces, quoted, stored
from tidemark.llm.url_filter import host_and_path

RUN, LEAST_PAGES, SHARD = 8, 3, 200_000
CONTENT, OTHER, OPEN = 0, 1, 2

#: Elements that show no text of the page; element names, and words of class, id and role attributes, that mark what is
#: not main text.
_UNSEEN = frozenset("head title script style noscript template iframe svg math canvas object audio video".split())
_OUT = frozenset("nav header footer aside form button select textarea menu dialog".split())
_OUT_WORDS = frozenset("ad ads advert adverts advertisement advertisements banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog disclaimer disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo related reply replies search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr picture source".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())

_tag = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)(?:>|\Z))""", re.S)
_marks = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_hidden = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_part = re.compile(r"[a-z0-9]+").findall
_ends = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in _RAW}


def _is_out(name: str, attributes: str, structure: bool) -> bool:
    if name in _UNSEEN:
        return True
    if not structure:
        return bool(attributes and _hidden.search(attributes))
    if name in _OUT:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return bool(attributes and name == "article" and any(_OUT_WORDS.intersection(_part("".join(m).lower())) for m in _marks.findall(attributes)))
    return any(_OUT_WORDS.intersection(_part("".join(m).lower())) for m in _marks.findall(attributes)) or bool(_hidden.search(attributes))


def blocks(page: str | None, structure: bool = True) -> list[tuple[int, str, str]]:
    """(zone, element, text) of the blocks with text, in page order. Without structure only article and main tell zones."""
    found: list[tuple[int, str, str]] = []
    stack: list[tuple[str, int]] = []
    zone, text, at, content = OPEN, [], 0, False
    page = page or ""

    def close() -> None:
        if text:
            if words := entities.unescape("".join(text)).split():
                found.append((zone, stack[-1][0] if stack else "", " ".join(words)))
            text.clear()

    while (m := _tag.search(page, at)) is not None:
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            close()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    before = stack[i][1]
                    if before != zone:
                        close()
                    del stack[i:]
                    zone = before
                    break
        elif name not in _VOID:
            if m[3].endswith("/") and name in ("svg", "path", "g"):
                continue
            new = zone
            if zone != OTHER and _is_out(name, m[3], structure):
                new = OTHER
            elif zone == OPEN and name in ("article", "main"):
                new, content = CONTENT, True
            if name in _RAW:
                ended = _ends[name].search(page, at)
                at = ended.end() if ended else len(page)
                continue
            if new != zone:
                close()
            stack.append((name, zone))
            zone = new
    text.append(page[at:])
    close()
    # with an article, what stands outside it is no main text
    return [(OTHER if structure and content and z == OPEN else z, e, t) for z, e, t in found]


_hashes = WordHashes()
_STEP = np.uint64(0x9E3779B97F4A7C15)


def run_hashes(tokens: np.ndarray, run: int) -> np.ndarray:
    """Hash of the `run` tokens from each place on."""
    n = len(tokens) - run + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(run):
        h = mix64(h * _STEP + tokens[i : i + n])
    return h


def stream(found: list[tuple[int, str, str]]) -> np.ndarray:
    """Tokens outside content: for each block its words between two marks."""
    return _hashes.of([w for z, e, t in found if z != CONTENT for w in (f"\x00{e}", *t.split(" "), f"\x00/{e}")])


def site_of(host: Column) -> Column:
    two, three = F.substring_index(host, ".", -2), F.substring_index(host, ".", -3)
    return F.when(two.rlike(r"^[a-z]{2,3}\.[a-z]{2}$"), three).otherwise(two)


def repeated(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct substrings of `run` tokens of the streams, and on how many streams each occurs.

    The streams are concatenated, each with an end mark of its own; suffixes are ranked by 1, 2, 4 ... tokens (prefix
    doubling) and ordered by their first `run` ones. Neighbours of equal rank share a substring.
    """
    sizes = np.array([len(s) for s in streams], np.int64)
    text = np.concatenate([np.append(s, np.uint64(0)) for s in streams])
    owner = np.repeat(np.arange(len(streams)), sizes + 1)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64) + len(streams)
    rank[np.cumsum(sizes + 1) - 1] = np.arange(len(streams))  # end marks differ, so no substring crosses one
    n, width, base = len(text), 1, len(text) + len(streams) + 1
    base_rank = rank
    while width < run:
        step = min(width, run - width)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = base_rank[step:]
        base_rank = np.unique(base_rank * base + ahead + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    left = np.repeat(np.cumsum(sizes + 1) - 1, sizes + 1) - np.arange(n)  # tokens before the end mark
    inside = np.flatnonzero(left >= run)
    order = inside[np.lexsort((owner[inside], base_rank[inside]))]  # the suffix array
    if not len(order):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    new = np.concatenate(([True], base_rank[order][1:] != base_rank[order][:-1]))
    page = new | np.concatenate(([True], owner[order][1:] != owner[order][:-1]))
    first = np.flatnonzero(new)
    heads = order[first]
    windows = np.lib.stride_tricks.sliding_window_view(text, run)[heads]
    h = np.zeros(len(heads), np.uint64)
    for i in range(run):
        h = mix64(h * _STEP + windows[:, i])
    return h, np.add.reduceat(page.astype(np.int64), first)


def parsed(pages: DataFrame, url: str = "url", html: str = "html", keep: list[str] | None = None, name: str = "text", structure: bool = True) -> DataFrame:
    """A stored row a page: site, page (digest of its text), key (of its stream), tokens (of the stream), n (of them), row (the
    columns kept), text (of its content) and lines (all blocks, zone first; null if none is open)."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != name.lower()]
    given = pages.select(site_of(host_and_path(quoted(url))[0]).alias("site"), quoted(html).alias("html"), F.struct(F.lit(0).alias("c"), *(quoted(c).alias(f"c{i}") for i, c in enumerate(kept))).alias("row"))
    fields = StructType.fromDDL("page binary, key binary, tokens binary, n long, text string, lines array<string>").fields

    def make(texts: pa.Array) -> list[pa.Array]:
        rows = []
        for t in texts.to_pylist():
            found = blocks(t, structure)
            tokens = stream(found).tobytes()
            page = hashlib.md5("\n".join(x for _, _, x in found).encode("utf-8", "surrogatepass")).digest()
            opened = any(z == OPEN for z, _, _ in found)
            rows.append((page, hashlib.md5(tokens).digest(), tokens, len(tokens) // 8, "\n".join(x for z, _, x in found if z == CONTENT), [f"{z}{x}" for z, _, x in found] if opened else None))
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.list_(pa.string()))
        return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

    return stored(map_text(given, "html", fields, make, ["site", "row"]), "html-blocks")


def boilerplate(found: DataFrame, run: int = RUN, least_pages: int = LEAST_PAGES, shard: int = SHARD) -> DataFrame:
    """site, gram: the substrings (as hashes) on at least least_pages distinct pages of the site, however many it has. found: parsed()."""
    rows = found.where(F.col("n") >= run).groupBy("site", "page").agg(F.max(F.struct("key", "tokens", "n")).alias("s")).select("site", "page", "s.tokens", "s.n")
    sites = stored(found.groupBy("site").agg(F.ceil(F.sum("n") / shard).alias("shards")), "html-sites")  # stored, so that a join may split a large site
    dealt = rows.join(sites, "site").withColumn("shard", F.pmod(F.xxhash64("page"), F.col("shards"))).select("site", "shard", "tokens")

    def index(key: tuple, table: pa.Table) -> pa.Table:
        grams, n = repeated([np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()], run)
        return pa.table({"site": pa.array([key[0].as_py()] * len(grams), pa.string()), "gram": pa.array(grams.view(np.int64)), "n": pa.array(n)})

    counts = dealt.groupBy("site", "shard").applyInArrow(index, "site string, gram long, n long").groupBy("site", "gram").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least_pages).select("site", "gram")


def covered(found: DataFrame, grams: DataFrame, run: int = RUN) -> DataFrame:
    """site, key, places: where runs of boilerplate() begin in each distinct stream that has any. found: rows of parsed()."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "tokens", 1 << 20):
            own = [run_hashes(np.frombuffer(t, np.uint64), run) for t in batch.column("tokens").to_pylist()]
            at = np.repeat(np.arange(len(own)), [len(h) for h in own])
            place = np.concatenate([np.arange(len(h)) for h in own]) if own else np.empty(0, np.int64)
            every = np.concatenate(own).view(np.int64) if own else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("site").take(pa.array(at)), batch.column("key").take(pa.array(at)), pa.array(place.astype(np.int32)), pa.array(every)], ["site", "key", "place", "gram"])

    streams = found.groupBy("site", "key").agg(F.max("tokens").alias("tokens"))
    rows = streams.transform(map_arrow, places, "site string, key binary, place int, gram long")
    return rows.join(grams, ["site", "gram"]).groupBy("site", "key").agg(F.collect_set("place").alias("places"))


def extract(pages: DataFrame, url: str = "url", html: str = "html", run: int = RUN, least_pages: int = LEAST_PAGES, shard: int = SHARD, keep: list[str] | None = None, name: str = "text", structure: bool = True) -> DataFrame:
    """pages (or its columns in `keep`) with their main text in a column `name`."""
    kept = [c for c in (pages.columns if keep is None else keep) if c.lower() != name.lower()]
    found = parsed(pages, url, html, keep, name, structure)
    columns = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(kept)]
    done, opened = found.where("lines is null"), found.where("lines is not null")
    grams = stored(boilerplate(found, run, least_pages, shard), "html-boilerplate")
    joined = opened.select("site", "key", "row", "lines").join(covered(opened, grams, run), ["site", "key"], "left")

    def cut(lines: pa.Array, places: pa.Array) -> list[pa.Array]:
        return [pa.array([without_runs(x, p or [], run) for x, p in zip(lines.to_pylist(), places.to_pylist())], pa.string())]

    cut_out = map_text(joined, "lines", [StructField("text", StringType())], cut, ["row"], also=["places"])
    return done.select("row", "text").unionByName(cut_out).select(*columns, F.col("text").alias(name))


def without_runs(lines: list[str], starts: list[int], run: int) -> str:
    """Text of content blocks and of open blocks' tokens outside the runs that begin at `starts` of the page's stream."""
    zones, texts = [int(x[0]) for x in lines], [x[1:].split(" ") for x in lines]
    total = sum(2 + len(t) for z, t in zip(zones, texts) if z != CONTENT)
    covers = np.zeros(total + 1, np.int64)
    for s in starts:
        covers[s] += 1
        covers[min(total, s + run)] -= 1
    hit, at, out = np.cumsum(covers) > 0, 0, []
    for zone, words in zip(zones, texts):
        if zone != CONTENT:
            own = hit[at + 1 : at + 1 + len(words)]
            at += 2 + len(words)
            words = [w for w, h in zip(words, own) if not h] if zone == OPEN and 2 * own.sum() < len(words) else []
        if words:
            out.append(" ".join(words))
    return "\n".join(out)


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract(pages, keep=["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
