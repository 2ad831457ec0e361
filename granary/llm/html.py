"""Main text of web pages (operator 4).

A page is cut into blocks of text. Structure settles most of them: what lies in
a navigation, header, footer, aside, form, advert, notice or comment element is
boilerplate, and what lies in an element that marks the article (article, main,
role=main) is text. What structure leaves open, the blocks outside both, is
decided among the pages of the host: the token streams of its pages, articles
and boilerplate too, are concatenated and suffix-sorted, and substrings of RUN
tokens that occur on SEVERAL distinct pages are found. What they cover goes, as
does a whole block that is outside articles on SEVERAL pages; shorter and rarer
repeats stay. Every page is judged by them, and marks overrule them: an article
keeps its repeats (judged_text counts their words), boilerplate goes although
it is unique. Pages with the same blocks are one page, so that an article under
many urls is not lost.

The host's suffix array lies in buckets. A run's bucket is the least hash of its
parts of GRAM tokens, so equal runs share one wherever they are; neighbouring
runs of a bucket travel as one piece. Each bucket is sorted by the words
themselves. Buckets with pieces on fewer than SEVERAL pages can't hold a
repeated run, and those without a word of articles or open blocks cover none:
their pieces stay where they are, known by a bit map of SLOTS bits in which a
collision costs time only. So a bucket, and not a host, is gathered
in one task, and one of more than PAGES pieces is dealt again by whole runs.

Defined results: null and empty html have an empty text; rows that repeat are
each extracted, and are one page when repeats are counted; a null url, or one
without host, belongs to the host "". Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices
from granary.llm.urls import host_of
from granary.plans.staging import stage

#: Tokens of a repeated substring, block marks included, and the distinct pages that it must be on; pieces that are suffix-sorted as one bucket.
RUN, SEVERAL, PAGES = 30, 3, 20_000
#: What marks a count of pages one of which asks; buckets that are counted apart.
ASKED, KEYS = 1 << 32, 1 << 40
#: Tokens whose hashes choose a run's bucket; bits of the map of buckets, and of a part of it; characters of small buckets that are sorted at once.
GRAM, SLOTS, PART, CHUNK = 10, 1 << 27, 1 << 15, 1 << 20

# Elements by their part in a page, and the words that name boilerplate in class, id and role.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
DROPPED = {"head", "nav", "header", "footer", "aside", "form", "menu", "noscript", "template", "svg", "math", "button", "select", "dialog", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table",
    "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
BOILERPLATE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "header", "masthead", "menu", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "promo",
    "replies", "sidebar", "signup", "sponsor", "sponsored", "subscribe", "toolbar", "complementary", "contentinfo",
}
#: Words that name boilerplate outside of an article, and may name a part of one inside.
OUTSIDE = {"modal", "popup", "related", "search", "share", "sharing", "skip", "social", "widget"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_NAMES = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORDS = re.compile(r"[^a-z0-9]+")


def _role(tag: str, attrs: str, in_article: bool = False) -> int:
    """1 for an element that holds the article, -1 for boilerplate, else 0."""
    if tag in DROPPED:
        return -1
    main = tag in ("article", "main")
    if attrs and not attrs.isspace():
        for m in _NAMES.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return -1
            words = set(_WORDS.split(value))
            if name == "role" and value == "main":
                main = True
            elif not main and (words & BOILERPLATE or not in_article and words & OUTSIDE):
                return -1
    return int(main)


def parse(html: str | None) -> tuple[list[str], list[str], list[str], bool]:
    """(blocks of the article, open blocks, boilerplate blocks, whether the page marks its article)."""
    blocks, marked = parse_blocks(html)
    return *([b for z, b in blocks if z == zone] for zone in range(3)), marked


def parse_blocks(html: str | None) -> tuple[list[tuple[int, str]], bool]:
    """((zone, block) in the page's order, whether the page marks its article); zones: 0 article, 1 open, 2 boilerplate."""
    kept: list[tuple[int, str]] = []
    if not html:
        return kept, False
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    zone, marked, at, end = 1, False, 0, len(html)

    def flush() -> None:
        if text:
            block = " ".join(unescape("".join(text)).split())
            text.clear()
            if block:
                kept.append((zone, block))

    def state() -> int:
        roles = [r for _, r in stack if r]
        return 2 if -1 in roles else 0 if 1 in roles else 1

    match = _TOKEN.match
    while at < end:
        m = match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            got = m.group()
            if got[0] != "<" or got == "<":
                text.append(got)
            continue
        if html[at - 1] != ">":
            break  # a tag that the page's end cuts off
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if any(r for _, r in stack[i:]):
                        flush()
                        del stack[i:]
                        zone = state()
                    else:
                        del stack[i:]
                    break
                if stack[i][1] == 1 and tag != "body" and tag != "html":
                    break  # an end tag does not reach out of the article
            continue
        if tag in BLOCKS:
            flush()
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
            at = close.end() if close else end
            continue
        role = _role(tag, m[3], zone == 0)
        if tag == "body" and stack and stack[-1][0] == "head":
            stack.pop()  # a head that was not closed
            zone = state()
        stack.append((tag, role))
        if role:
            flush()
            zone = state()
            marked = marked or zone == 0
    flush()
    return kept, marked


def run_ranks(tokens: np.ndarray, segment: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a concatenated stream, the rank of its suffix by the first `length` tokens, and whether the segment holds so many.

    Prefixes are doubled, and no further than needed; none runs over the end of a segment.
    """
    n = len(tokens)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, bool)
    last = np.r_[np.flatnonzero(segment[1:] != segment[:-1]), n - 1]
    room = last[np.searchsorted(last, np.arange(n))] - np.arange(n) + 1
    rank, known = np.unique(tokens, return_inverse=True)[1].astype(np.int64), 1
    while known < length:
        step = min(known, length - known)
        later = np.full(n, -1, np.int64)
        later[: n - step] = rank[step:]
        later[room <= step] = -1
        key = rank * (n + 2) + later + 1
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        known += step
    return rank, room >= length


def repeated_runs(tokens: np.ndarray, page: np.ndarray, length: int = RUN, least: int = 2, segment: np.ndarray | None = None) -> np.ndarray:
    """For each position of a concatenated stream, whether the substring of `length` tokens from there occurs on `least` pages.

    A page is one segment unless `segment` cuts it into more.
    """
    n = len(tokens)
    rank, fits = run_ranks(tokens, page if segment is None else segment, length)
    if n == 0:
        return fits
    order = np.lexsort((page, rank))  # the suffix array, to a depth of `length` tokens
    r, p = rank[order], page[order]
    first = np.r_[True, r[1:] != r[:-1]]
    seen = np.cumsum(first | np.r_[True, p[1:] != p[:-1]])
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, n])
    count = np.zeros(n, np.int64)
    count[order] = np.repeat(seen[start + size - 1] - seen[start] + 1, size)
    return fits & (count >= least)


def _grams(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the `length` tokens from each position, where there are so many."""
    m = max(0, len(hashes) - length + 1)
    out = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(length):
            out = (out ^ hashes[i : m + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def buckets_of(hashes: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each position, the bucket of the run of RUN tokens from there, and whether the page holds that run.

    A bucket is the least hash of the run's parts of GRAM tokens, so equal runs share one, and most neighbours do.
    """
    n = len(hashes)
    least, known = _grams(hashes, GRAM), 1
    while known < RUN - GRAM + 1:
        step = min(known, RUN - GRAM + 1 - known)
        least = np.minimum(least[: max(0, len(least) - step)], least[step:])
        known += step
    m = len(least)
    fits = np.zeros(n, bool)
    fits[:m] = page[:m] == page[RUN - 1 : RUN - 1 + m]
    return np.r_[least, np.zeros(n - m, np.uint64)], fits


def _hashes(texts: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(texts, object)) if texts else np.zeros(0, np.uint64)


#: Block marks; a token holds no white space, so none is one of them.
_BEGIN, _END = "\t", "\n"


class _Pieces:
    """The pieces of a batch's distinct pages: stretches of neighbouring runs of one bucket, and whole short blocks outside articles."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        rows: dict[tuple[str, bytes], tuple[list[str], list[int]]] = {}
        for host, page, blocks, zones in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "blocks", "zones")), strict=True):
            rows.setdefault((host, page), (blocks, zones))
        self.pages = list(rows)
        self.tokens: list[str] = []
        sizes, zone, n_zone, short = [], [], [], []
        for i, (blocks, zones) in enumerate(rows.values()):
            begin = len(self.tokens)
            for block, z in zip(blocks, zones, strict=True):
                words = block.split()
                if z and len(words) + 2 < RUN:
                    short.append((block, i, len(self.tokens), len(words) + 2, z == 1))
                self.tokens += (_BEGIN, *words, _END)
                zone.append(z)
                n_zone.append(len(words) + 2)
            sizes.append(len(self.tokens) - begin)
        page = np.repeat(np.arange(len(sizes)), sizes)
        self.base = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        n_zone = np.array(n_zone, np.int64)
        text = np.repeat(np.array(zone, np.int64) < 2, n_zone)
        text[np.r_[np.cumsum(n_zone) - n_zone, np.cumsum(n_zone) - 1].astype(np.int64)] = False  # block marks
        place = np.arange(len(text))
        after = np.r_[np.minimum.accumulate(np.where(text, place, len(text))[::-1])[::-1], len(text)].astype(np.int64)
        before = np.r_[0, np.maximum.accumulate(np.where(text, place + 1, 0))].astype(np.int64)
        bucket, fits = buckets_of(_hashes(self.tokens), page)
        head = fits.copy()
        head[1:] &= ~(fits[:-1] & (bucket[1:] == bucket[:-1]) & (page[1:] == page[:-1]))
        starts = np.flatnonzero(head)
        n_runs = np.bincount(np.cumsum(head)[fits], minlength=len(starts) + 1)[1:]
        ends = starts + n_runs + RUN - 1
        of_host = _hashes([h for h, _ in self.pages])
        self.page = np.r_[page[starts], np.array([s[1] for s in short], np.int64)].astype(np.int64)
        keys = np.r_[bucket[starts], _hashes([s[0] for s in short]) ^ np.uint64(0x5851F42D4C957F2D)]
        self.key = (keys ^ of_host[self.page]).view(np.int64) if len(keys) else np.zeros(0, np.int64)
        self.start = np.r_[starts, np.array([s[2] for s in short], np.int64)].astype(np.int64)
        self.end = np.r_[ends, np.array([s[2] + s[3] for s in short], np.int64)].astype(np.int64)
        self.whole = np.r_[np.zeros(len(starts), bool), np.ones(len(short), bool)]
        # From the first to the last word of text in a piece; pieces without any are counted and do not ask.
        self.first, self.beyond = after[self.start], before[self.end]
        self.asks = np.r_[after[starts] < ends, np.array([s[4] for s in short], bool)].astype(bool)


def _count_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n): on how many of a batch's pages a bucket has pieces, and ASKED more if one of them asks."""
    for b in slices(batches, "blocks"):
        p = _Pieces(b)
        order = np.lexsort((p.page, p.key & (KEYS - 1)))
        key, page = p.key[order] & (KEYS - 1), p.page[order]
        first = np.r_[True, key[1:] != key[:-1]][: len(key)]
        new = first | np.r_[True, page[1:] != page[:-1]][: len(key)]
        at = np.flatnonzero(first)
        n = np.add.reduceat(new.astype(np.int64), at) + ASKED * np.maximum.reduceat(p.asks[order], at) if len(at) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key[at], pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


_PIECES = "key long, whole boolean, host string, content string, pages array<binary>, at array<struct<page: binary, start: int, first: int, beyond: int>>"
_ARROW = pa.schema([
    ("key", pa.int64()), ("whole", pa.bool_()), ("host", pa.string()), ("content", pa.string()), ("pages", pa.list_(pa.binary())), ("at", pa.list_(pa.struct([("page", pa.binary()), ("start", pa.int32()), ("first", pa.int32()), ("beyond", pa.int32())]))),
])


def _bit_map(slots: DataFrame) -> bytes:
    """The slots of a table with column slot as a packed map of SLOTS bits."""
    bits = bytearray(SLOTS // 8)
    for part, packed in slots.distinct().groupBy((F.col("slot") / PART).cast("int").alias("part")).applyInPandas(_packed, "part int, bits binary").collect():
        bits[part * (PART // 8) : (part + 1) * (PART // 8)] = packed
    return zlib.compress(bytes(bits), 1)


def _set(bits: np.ndarray, slot: np.ndarray) -> np.ndarray:
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8) & 1).astype(bool)


def _packed(pdf: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(PART, bool)
    bits[pdf["slot"].to_numpy() % PART] = True
    return pd.DataFrame({"part": [int(pdf["slot"].iloc[0]) // PART], "bits": [np.packbits(bits).tobytes()]})


def _written(bits: bytes):
    """A stage that writes the pieces whose bucket's bit is set: one row for equal pieces of a batch, with SEVERAL of their pages and all places that ask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(zlib.decompress(bits), np.uint8)
        for b in slices(batches, "blocks"):
            p, found = _Pieces(b), {}
            for i in np.flatnonzero(_set(on, p.key & (SLOTS - 1))).tolist():
                host, page = p.pages[p.page[i]]
                s, e = int(p.start[i]), int(p.end[i])
                row = found.setdefault((int(p.key[i]), bool(p.whole[i]), host, " ".join(p.tokens[s:e])), ([], []))
                if len(row[0]) < SEVERAL and page not in row[0]:
                    row[0].append(page)
                if p.asks[i]:
                    base = int(p.base[p.page[i]])
                    row[1].append({"page": page, "start": s - base, "first": int(p.first[i]) - base, "beyond": int(p.beyond[i]) - base})
            yield pa.RecordBatch.from_pylist([{"key": k, "whole": w, "host": h, "content": c, "pages": pages, "at": at} for (k, w, h, c), (pages, at) in found.items()], _ARROW)

    return run


def _cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of large buckets as their single runs, each in a bucket of its own."""
    for b in batches:
        rows = []
        for r in b.to_pylist():
            words = r["content"].split(" ")
            runs = [(r["content"], 0)] if r["whole"] else [(" ".join(words[i : i + RUN]), i) for i in range(len(words) - RUN + 1)]
            for (content, i), key in zip(runs, _hashes([f"{r['host']} {c}" for c, _ in runs]).view(np.int64).tolist(), strict=True):
                rows.append(r | {"key": key, "content": content, "at": [a | {"start": a["start"] + i} for a in r["at"]]})
                if len(rows) == 10000:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def covered_by(rows: list[dict]) -> list[tuple[str, bytes, list[int]]]:
    """(host, page, spans of covered tokens as begin, end, begin, ...) from all pieces of some buckets, where they hold words of text.

    The pieces' tokens are concatenated and suffix-sorted by their words; the
    bucket only brings together what can be equal.
    """
    pages: dict[tuple, dict[bytes, None]] = {}
    for r in rows:
        known = pages.setdefault((r["whole"], r["host"], r["content"]), {})
        for page in r["pages"]:
            if len(known) < SEVERAL:
                known[page] = None
    # A piece stands in the stream once for each of its pages, of which SEVERAL tell as much as all.
    stream, number, numbers = [(c, p) for c in pages if not c[0] for p in pages[c]], {}, {}
    words = [c[2].split(" ") for c, _ in stream]
    sizes = [len(w) for w in words]
    tokens = [number.setdefault((c[1], t), len(number)) for (c, _), w in zip(stream, words, strict=True) for t in w]
    page = [numbers.setdefault((c[1], p), len(numbers)) for c, p in stream]
    hit = repeated_runs(np.array(tokens, np.int64), np.repeat(np.array(page, np.int64), sizes), RUN, SEVERAL, np.repeat(np.arange(len(sizes)), sizes))
    spans: dict[tuple, list[tuple[int, int]]] = {c: [(0, len(c[2].split(" ")))] if len(p) >= SEVERAL else [] for c, p in pages.items() if c[0]}
    at = 0
    for (c, _), n in zip(stream, sizes, strict=True):
        if c not in spans:
            edge = np.flatnonzero(np.diff(np.r_[False, hit[at : at + n], False]))
            spans[c] = [(b, e + RUN - 1) for b, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        at += n
    got = []
    for r in rows:
        found = spans[(r["whole"], r["host"], r["content"])] if r["at"] else []
        for a in r["at"] if found else ():
            if own := [a["start"] + x for b, e in found if a["start"] + e > a["first"] and a["start"] + b < a["beyond"] for x in (b, e)]:
                got.append((r["host"], a["page"], own))
    return got


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """covered_by over whole buckets of a partition that is sorted by them, some CHUNK characters of pieces at a time."""

    def out(rows: list[dict]) -> pa.RecordBatch:
        got = covered_by(rows)
        host, page, spans = zip(*got, strict=True) if got else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page, pa.binary()), pa.array(spans, pa.list_(pa.int32()))], ["host", "page", "spans"])

    held: list[dict] = []
    for b in batches:
        held += b.to_pylist()
        if sum(len(r["content"]) for r in held) >= CHUNK:
            cut = next((i for i in range(len(held) - 1, 0, -1) if held[i]["key"] != held[i - 1]["key"]), 0)
            if cut:
                yield out(held[:cut])
                held = held[cut:]
    yield out(held)


def judged(blocks: list[str], zones: list[int], spans: list[int]) -> tuple[str, int]:
    """(text, how many of its words a host repeats): articles whole, of open blocks what no repeated run or block covers, no boilerplate."""
    size = sum(len(b.split()) + 2 for b in blocks) if spans else 0
    covered = np.zeros(size, bool)
    for b, e in zip(spans[::2], spans[1::2], strict=True):
        covered[b:e] = True
    texts, repeated, at = [], 0, 0
    for block, zone in zip(blocks, zones, strict=True):
        if spans:
            words = block.split()
            gone = covered[at + 1 : at + 1 + len(words)]
            at += len(words) + 2
            if zone == 0:
                repeated += int(gone.sum())
            elif zone == 1:
                block = " ".join(w for w, c in zip(words, gone, strict=True) if not c)
        if zone < 2 and block:
            texts.append(block)
    return " ".join(texts), repeated


def _parse_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        page, texts, zones = [], [], []
        for html in b.column("html").to_pylist():
            blocks, _ = parse_blocks(html)
            page.append(hashlib.md5("\u0001".join(f"{z}{t}" for z, t in blocks).encode("utf-8", "replace")).digest())
            texts.append([t for _, t in blocks])
            zones.append([z for z, _ in blocks])
        cols = [pa.array(page, pa.binary()), pa.array(texts, pa.list_(pa.string())), pa.array(zones, pa.list_(pa.int8()))]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), b.column("host"), *cols], ["id", "url", "host", "page", "blocks", "zones"])


def _split(bits: bytes, answered: bool):
    """A stage that keeps the pages that may have spans, or judges the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(zlib.decompress(bits), np.uint8)
        for b in batches:
            slot = np.frombuffer(b"".join(p[:4] for p in b.column("page").to_pylist()), ">u4").astype(np.int64) & (SLOTS - 1)
            kept = b.filter(pa.array(_set(on, slot) == answered))
            yield from [kept] if answered else _judge_pages([kept.append_column("spans", pa.nulls(kept.num_rows))])

    return run


def _judge_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        got = [judged(t, z, s or []) for t, z, s in zip(*(b.column(c).to_pylist() for c in ("blocks", "zones", "spans")), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["id", "url", "text", "n_repeated"])


def judged_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars, n_repeated) of every row of pages; n_repeated: words of the text, all in articles, that lie in runs which the host repeats."""
    rows = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url"), host_of(F.coalesce("url", F.lit(""))).alias("host"), F.col("html").cast("string").alias("html"))
    kind = rows.schema["id"].dataType.simpleString()
    parsed = stage(mapped(rows, _parse_pages, f"id {kind}, url string, host string, page binary, blocks array<string>, zones array<tinyint>"), "pages", "zstd")
    streams = parsed.select("host", "page", "blocks", "zones")
    # Only buckets with pieces on several pages, one of which asks, can cover a word of text; every task knows them by a bit map of fixed size.
    several = mapped(streams, _count_keys, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= ASKED) & (F.col("n") % ASKED >= SEVERAL))
    buckets = _bit_map(several.select(F.col("key").bitwiseAND(SLOTS - 1).cast("int").alias("slot")))
    pieces = stage(mapped(streams, _written(buckets), _PIECES), "pieces", "zstd")
    large = stage(pieces.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > PAGES).select("key"), "large")
    fine = pieces.join(large, "key", "left_anti").select(*pieces.columns).union(mapped(pieces.join(large, "key", "left_semi").select(*pieces.columns), _cut_up, _PIECES))
    found = mapped(fine.repartition("key").sortWithinPartitions("key"), _sorted_buckets, "host string, page binary, spans array<int>")
    spans = stage(found.groupBy("host", "page").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    # Pages that nothing covers are judged where they lie, the others where their spans are.
    touched = _bit_map(spans.select(F.conv(F.hex(F.substring("page", 1, 4)), 16, 10).cast("long").bitwiseAND(SLOTS - 1).cast("int").alias("slot")))
    kinds = f"id {kind}, url string, text string, n_repeated long"
    answered = mapped(parsed, _split(touched, True), parsed.schema).join(spans, ["host", "page"], "left").select("id", "url", "blocks", "zones", "spans")
    out = mapped(parsed, _split(touched, False), kinds).union(mapped(answered, _judge_pages, kinds))
    return out.select(F.col("id").alias(id_col), "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")


def main_text(pages: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, url, text, n_chars) of every row of pages."""
    return judged_text(pages, id_col).drop("n_repeated")


def op4_html(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
