"""Main-text extraction with a suffix array for each host.

A page becomes blocks (text between block elements) and a stream of word symbols over all of them, article or not. The streams
of a host's pages are concatenated, each closed by a symbol of its own, and a suffix array (prefix doubling up to RUN symbols)
yields every run of RUN symbols with the number of distinct pages that hold it. Runs on at least max(2, one in TEMPLATE) of the
host's pages are boilerplate and cover their words:

* a block outside articles that is covered by half or more keeps only its uncovered words, other such blocks stay whole;
* a block of an article goes if runs on half of the host's pages (LEAST_ARTICLES at least) cover nine tenths of it, unless that
  would take more than half of the article: then the pages are copies, not a template.

Tags set block borders and give a prior for what no repetition can show, as it differs from page to page or as the host has one
page: adverts, comments, forms, menus and the like, by element and by class, id and role, are dropped; and if a page's article
holds at least half as many words as what is left beside it, that is dropped as well (else the article is only a teaser).

Page counts are of the whole host, however it is split: a host of more than PORTION bytes is dealt out in portions by the hash of
each page's stream. A run on T of N pages is on at least T * P / N of the P pages of some portion, so portions propose all runs
that can matter, and their pages are then counted over the host. Pages of equal streams are one page, so copies make no template.

Defined results: null and empty html give an empty text; what isn't closed ends with the page; a page without content has an empty
text; a null url is a host of its own; repeated rows are repeated results; a very long page is one stream; an empty table gives an
empty result; other columns, of whatever names, are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, pieces

RUN, TEMPLATE, LEAST_ARTICLES = 6, 20, 5
PORTION = 2 << 20
#: Hosts of more than a portion, and runs of all hosts, that a broadcast may carry; beyond these numbers they are joined.
BROADCAST_HOSTS, BROADCAST_RUNS = 100_000, 1_000_000
#: Elements by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "svg", "math", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
CONTENT = {"article", "main"}
JUNK = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "head", "datalist"}
#: Words of class, id and role attributes that mark an element without content.
JUNK_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie",
    "cookies", "consent", "gdpr", "notice", "notices", "alert", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "footer", "contentinfo", "complementary", "comment", "comments", "respond", "reply", "replies", "discussion", "disqus", "share", "sharing",
    "social", "related", "recommended", "newsletter", "subscribe", "subscription", "popup", "modal", "dialog", "pagination", "pager", "widget",
    "toolbar", "masthead", "topbar", "login", "signup", "search", "form", "paywall",
}
HEADER_WORDS = {"header"}
#: Words that are junk around an article but may name a part of one; words that only say what an element holds.
AMBIGUOUS, HOLDS = {"discussion", "search"}, {"has", "with", "no", "without", "is", "not"}
TAG = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?false)|display\s*:\s*none", re.I)
OTHER, KEPT, LOST, MARKED = 0, 1, 2, 3  # MARKED: lost by an attribute, unless it turns out to hold the article


def _attribute_words(attributes: str) -> set[str]:
    out: set[str] = set()
    for m in ATTRIBUTE.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").lower().split():
            parts = re.split(r"[^a-z0-9]+", name)
            if parts[0] not in HOLDS:
                out.update(parts)
    return out


def _role(name: str, attributes: str, inside: int, found: bool) -> int:
    """What an element makes of its text: LOST or MARKED, KEPT (article text) or as around it. found: an article came before."""
    if inside == LOST or name in JUNK or name == "header" and inside != KEPT:
        return LOST
    if name in ("html", "body"):
        return inside
    words = _attribute_words(attributes) if attributes else set()
    junk = words & JUNK_WORDS - (AMBIGUOUS if inside == KEPT else set())
    if inside == MARKED and (name not in CONTENT or found or junk):
        return MARKED
    if attributes:
        if HIDDEN.search(attributes):
            return LOST
        if name not in CONTENT and (junk or inside != KEPT and words & HEADER_WORDS):
            return MARKED
    return KEPT if name in CONTENT else inside


def blocks(page: str | None) -> list[tuple[int, str]]:
    """(role, text) of the page's blocks in order."""
    page = page or ""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []
    role, at, found = OTHER, 0, False

    def close() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            out.append((role, text))

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = (m[3] or m[6] or "").lower()
        if not name:
            continue
        ends, attributes = bool(m[2] or m[5]), m[4] or m[7] or ""
        if name in BLOCK:
            close()
        elif name in ("br", "td", "th"):
            parts.append(" ")
        if ends:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    changed = stack[i][1] != role
                    if changed:
                        close()
                    del stack[i:]
                    break
        elif name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        elif name in VOID or attributes.rstrip().endswith("/"):
            continue
        else:
            if name in ("p", "li", "dt", "dd", "tr", "option"):  # opening one closes an open one of its kind
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in (name, "ul", "ol", "table", "dl", "div", "section", "article", "main", "body"):
                        if stack[i][0] == name:
                            del stack[i:]
                        break
            inner = _role(name, attributes, stack[-1][1] if stack else OTHER, found)
            found = found or inner == KEPT
            stack.append((name, inner))
        now = stack[-1][1] if stack else OTHER
        if now != role:
            close()
            role = now
    close()
    return out


def code_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def stream_of(own: list[tuple[int, str]]) -> np.ndarray:
    """The word symbols of a page's blocks."""
    words = " ".join(t for _, t in own).split(" ") if own else []
    return np.fromiter(map(code_of, words), np.uint32, len(words))


def digest_of(stream: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(stream.tobytes(), digest_size=8).digest(), "little", signed=True)


def run_hashes(stream: np.ndarray) -> np.ndarray:
    """One number a run of RUN symbols, by its start."""
    n = max(0, len(stream) - RUN + 1)
    h = np.full(n, 7, np.uint64)
    for i in range(RUN):
        h = (h ^ stream[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def runs_by_page(symbols: np.ndarray, page: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """A start of each distinct run of ``run`` symbols, and on how many pages it is.

    page numbers each position's page; runs do not cross pages, as every page ends in a symbol of its own.
    """
    n = len(symbols)
    if n < run:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    width = 1
    while width < run:  # prefix doubling; the last step may overlap, so that exactly `run` symbols are ranked
        step = min(width, run - width)
        second = np.full(n, -1, np.int64)
        second[: n - step] = rank[step:]
        rank = np.unique(rank * (n + 2) + second + 1, return_inverse=True)[1].astype(np.int64)
        width += step
    order = np.lexsort((page, rank))  # the suffixes in order of their first `run` symbols, then of their page
    first = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
    another = first | np.concatenate([[True], page[order][1:] != page[order][:-1]])
    starts = np.flatnonzero(first)
    pages = np.add.reduceat(another.astype(np.int64), starts)
    start = order[starts]
    inside = start + run <= n
    inside[inside] &= page[start[inside]] == page[np.minimum(start[inside] + run - 1, n - 1)]
    return start[inside], pages[inside]


def host_runs(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Runs (as run_hashes) of distinct pages' streams and the number of pages of each, from the suffix array of all streams."""
    ends = -1 - np.arange(len(streams))
    symbols = np.concatenate([x for s, e in zip(streams, ends) for x in (s.astype(np.int64), [e])]) if streams else np.zeros(0, np.int64)
    sizes = np.array([len(s) + 1 for s in streams], np.int64)
    page = np.repeat(np.arange(len(streams)), sizes)
    start, pages = runs_by_page(symbols, page)
    whole = symbols[start + RUN - 1] >= 0  # a run that ends in a page's closing symbol is none
    start, pages = start[whole], pages[whole]
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return run_hashes(symbols[start[:, None] + np.arange(RUN)].astype(np.uint32).ravel())[::RUN], pages


def least_pages(n: int) -> int:
    """On so many of a host's n pages a run is boilerplate."""
    return max(2, -(-n // TEMPLATE))


def covered_by(hashes: np.ndarray, size: int, runs: np.ndarray) -> np.ndarray:
    """Which of a page's words lie in one of the runs (sorted)."""
    mark = np.zeros(size + 1, np.int64)
    if len(runs) and len(hashes):
        at = np.minimum(np.searchsorted(runs, hashes), len(runs) - 1)
        start = np.flatnonzero(runs[at] == hashes)
        np.add.at(mark, start, 1)
        np.add.at(mark, start + RUN, -1)
    return np.cumsum(mark[:-1]) > 0


def main_text(own: list[tuple[int, str]], runs: np.ndarray, pages: np.ndarray, n: int) -> str:
    """A page's text from its blocks and its host's boilerplate runs (sorted), their page counts and the number of pages."""
    stream = stream_of(own)
    hashes = run_hashes(stream)
    covered = covered_by(hashes, len(stream), runs)
    frequent = covered_by(hashes, len(stream), runs[pages >= max(LEAST_ARTICLES, -(-n // 2))]) if covered.any() else covered
    article, beside = [], []  # (place, text, words)
    gone: list[tuple[int, str, int]] = []
    at = 0
    for j, (role, text) in enumerate(own):
        words = text.split(" ")
        here, often = covered[at : at + len(words)], frequent[at : at + len(words)]
        at += len(words)
        if role == KEPT:
            (gone if 10 * often.sum() >= 9 * len(words) else article).append((j, text, len(words)))
        elif role == OTHER:
            if 2 * here.sum() >= len(words):
                words = [w for w, x in zip(words, here) if not x]
            if words:
                beside.append((j, " ".join(words), len(words)))
    if sum(x[2] for x in gone) > sum(x[2] for x in article):
        article = sorted(article + gone)
    size = sum(x[2] for x in article)
    if size and 2 * size >= sum(x[2] for x in beside):
        beside = []
    return "\n\n".join(t for _, t, _ in sorted(article + beside))


Runs = dict[str, tuple[int, np.ndarray, np.ndarray]]


def _look_up(batch: pa.RecordBatch, known: Runs | None) -> Callable[[int, str], tuple[int, np.ndarray, np.ndarray]]:
    """What gives a row's host's pages, sorted runs and their page counts: a broadcast table, or the row's last columns."""
    none = (0, np.zeros(0, np.int64), np.zeros(0, np.int64))
    if known is not None:
        return lambda i, host: known.get(host, none)
    n, runs, pages = (batch.column(batch.num_columns - 3 + k) for k in range(3))

    def of(i: int, host: str) -> tuple[int, np.ndarray, np.ndarray]:
        if not n[i].is_valid:
            return none
        return n[i].as_py(), np.array(runs[i].as_py(), np.int64), np.array(pages[i].as_py(), np.int64)

    return of


def _with_runs(rows: DataFrame, runs: DataFrame, large: DataFrame) -> tuple[DataFrame, Runs | None]:
    """The rows, and the hosts' runs (_host, n, runs, pages) as a table to broadcast if they are few, else as columns of the rows."""
    if runs.agg(F.coalesce(F.sum(F.size("runs")), F.lit(0))).first()[0] <= BROADCAST_RUNS:
        got = runs.toArrow()
        table = {h: (n, np.array(r, np.int64), np.array(p, np.int64)) for h, n, r, p in zip(*(got.column(c).to_pylist() for c in ("_host", "n", "runs", "pages")))}
        return rows, table
    # a large host's rows meet its runs in as many parts as it has portions
    parts = runs.join(large, F.col("_host") == F.col("_large"), "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_portions", F.lit(1)) - 1)))
    parts = parts.select(F.col("_host").alias("_h"), "_part", "n", "runs", "pages")
    own = F.pmod(F.xxhash64("_html", "_url"), "_portions")
    return rows.join(parts, (F.col("_host") == F.col("_h")) & (own == F.col("_part")), "left").drop("_h", "_part"), None


def boilerplate(rows: DataFrame, large: DataFrame) -> DataFrame:
    """_host, n (its distinct pages), runs (sorted), pages: of every host the runs on at least least_pages(n) pages."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # leaves a copy a task of each page
        for b in pieces(batches):
            out: list[tuple] = []
            if len(seen) > 200_000:
                seen.clear()
            for host, portions, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                stream = stream_of(blocks(page))
                digest = digest_of(stream)
                if (key := hash((host, digest))) not in seen:
                    seen.add(key)
                    out.append((host, digest % portions, portions, digest, stream.tobytes()))
            yield pa.record_batch([pa.array(list(x), t) for x, t in zip(zip(*out) if out else [[]] * 5, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["_host", "portion", "portions", "digest", "stream"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last, held = None, None, []

        def done() -> pa.RecordBatch:
            runs, pages = host_runs(held)
            n = len(held)
            several = key[2] > 1
            some = pages >= (max(1, -(-n // TEMPLATE)) if several else least_pages(n))
            runs, pages = runs[some], pages[some]
            k = len(runs) + 1  # the first row tells the number of pages
            return pa.record_batch([pa.array([key[0]] * k), pa.array([several] * k), pa.array([None, *runs.tolist()], pa.int64()), pa.array([n, *pages.tolist()], pa.int64())], ["_host", "several", "run", "pages"])

        for b in pieces(batches):
            for host, portion, portions, digest, stream in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (host, portion, portions) != key:
                    if held:
                        yield done()
                    key, last, held = (host, portion, portions), None, []
                if digest != last:
                    held.append(np.frombuffer(stream, np.uint32))
                    last = digest
        if held:
            yield done()

    sized = rows.join(large, F.col("_host") == F.col("_large"), "left").select("_host", F.coalesce("_portions", F.lit(1).cast("long")).alias("portions"), "_html")
    dealt = sized.mapInArrow(streams, "_host string, portion long, portions long, digest long, stream binary")
    dealt = dealt.repartition("_host", "portion").sortWithinPartitions("_host", "portion", "digest")
    found = materialize(dealt.mapInArrow(find, "_host string, several boolean, run long, pages long"), "host-runs")
    n = found.where("run IS NULL").groupBy("_host").agg(F.sum("pages").alias("n"))
    runs = found.where("run IS NOT NULL AND NOT several").select("_host", "run", "pages")
    proposed = found.where("run IS NOT NULL AND several").groupBy("_host").agg(F.sort_array(F.collect_set("run")).alias("runs"))
    proposed = materialize(proposed.withColumns({"n": F.lit(0).cast("long"), "pages": F.expr("array_repeat(0L, size(runs))")}).select("_host", "n", "runs", "pages"), "proposed-runs")
    own = rows.join(large, F.col("_host") == F.col("_large")).select("_host", "_url", "_html", "_portions")
    own, known = _with_runs(own, proposed, large)
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            look = _look_up(b, sent.value)
            hosts, digests, found_runs = [], [], []
            for i, (host, page) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                stream = stream_of(blocks(page))
                hit = np.intersect1d(run_hashes(stream), look(i, host)[1])
                hosts += [host] * len(hit)
                digests += [digest_of(stream)] * len(hit)
                found_runs += hit.tolist()
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(found_runs, pa.int64()), pa.array(digests, pa.int64())], ["_host", "run", "digest"])

    counted = own.mapInArrow(count, "_host string, run long, digest long").distinct().groupBy("_host", "run").agg(F.count(F.lit(1)).alias("pages"))
    least = F.greatest(F.lit(2), F.ceil(F.col("n") / TEMPLATE))
    runs = runs.unionByName(counted).join(n, "_host").where(F.col("pages") >= least)
    runs = runs.groupBy("_host", "n").agg(F.sort_array(F.collect_list(F.struct("run", "pages"))).alias("r"))
    return materialize(runs.select("_host", "n", F.col("r.run").alias("runs"), F.col("r.pages").alias("pages")), "boilerplate")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", cover: bool = True) -> DataFrame:
    """One row a page: page_id, url, text, n_chars. Without ``cover`` hosts are not compared."""
    kind = dict(pages.dtypes)[id_col]
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), host.alias("_host"), F.coalesce(F.col(html_col), F.lit("")).alias("_html"))
    large = rows.groupBy("_host").agg(F.ceil(F.sum(F.octet_length("_html")) / PORTION).alias("_portions")).where("_portions > 1")
    large = materialize(large.withColumnRenamed("_host", "_large"), "large-hosts")
    if large.count() <= BROADCAST_HOSTS:
        large = F.broadcast(large)
    own = rows.join(large, F.col("_host") == F.col("_large"), "left").select("_host", "_id", "_html", "_url", F.coalesce("_portions", F.lit(1).cast("long")).alias("_portions"))
    known: Runs | None = {}
    if cover:
        own, known = _with_runs(own, boilerplate(rows, large), large)
    sent = pages.sparkSession.sparkContext.broadcast(known)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            look = _look_up(b, sent.value)
            found = []
            for i, (h, page) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                n, runs, counts = look(i, h)
                found.append(main_text(blocks(page), runs, counts, n))
            yield pa.record_batch([b.column(1), b.column(3), pa.array(found, pa.string()), pa.array(list(map(len, found)), pa.int64())], [id_col, url_col, "text", "n_chars"])

    return own.mapInArrow(texts, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
