"""Benchmark decontamination by pigeonhole edit matching (operator 8).

A test item of m characters may occur with up to k = floor(rate * m) edits. It
is split into k + 1 pieces, of which one at least must then occur unchanged.
All pieces of all items are found in one pass of an Aho-Corasick automaton over
the normalised text; each hit fixes where the item would lie, and Myers'
bit-parallel distance over that window decides.

Text is compared in lower case with runs of white space as one blank. Defined
results: null or blank items and texts match nothing; items that repeat are each
reported; a document is reported once with the sorted list of the item ids it
holds. Items are streamed to the driver in blocks of bounded size; each block is
broadcast for one pass over the documents, whose result is written before the
next block is read, so neither the driver nor a worker ever holds more than one
block, whatever the size of the benchmark. Further columns are not read.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import appended, unused
from granary.plans.staging import stage

#: Edits allowed for each character of an item.
RATE = 0.07
#: Characters of items that one pass over the documents looks for.
BLOCK_CHARS = 8_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece) of k + 1 pieces of nearly equal length."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def occurs(masks: dict[str, int], m: int, window: str, k: int) -> int | None:
    """Least edit distance (at most k) of a pattern to any substring of window, by Myers' bit vectors."""
    ones, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, now, best = ones, 0, m, None
    for i, c in enumerate(window):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (ones & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            now += 1
        elif mh & top:
            now -= 1
        if now <= k and (best is None or now < best):
            best = now
            if best == 0:
                return 0
        ph = (ph << 1) & ones
        mh = (mh << 1) & ones
        pv = mh | (ones & ~(xv | ph))
        mv = ph & xv
        if now - (len(window) - 1 - i) > k and best is None:
            return None
    return best


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, int(rate * len(t))) for i, x in items if (t := normal(x))]
        where = defaultdict(list)
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                where[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in where.items():
            self.automaton.add_word(piece, (len(piece), at))
        if where:
            self.automaton.make_automaton()
        self.any = bool(where)
        self._masks: dict[int, dict[str, int]] = {}

    def masks(self, n: int) -> dict[str, int]:
        if n not in self._masks:
            out: dict[str, int] = defaultdict(int)
            for i, c in enumerate(self.items[n][1]):
                out[c] |= 1 << i
            self._masks[n] = dict(out)
        return self._masks[n]

    def find(self, text: str | None) -> list[tuple[int, int]]:
        """(item id, distance) of the items that occur in text."""
        t = normal(text)
        if not t or not self.any:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (size, at) in self.automaton.iter(t):
            for n, offset in at:
                starts[n].add(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            item, pattern, k = self.items[n]
            m = len(pattern)
            best = None
            near = sorted(s for s in found if -k <= s <= len(t) - m + k)
            at = 0
            while at < len(near) and best != 0:
                first = last = near[at]
                while at < len(near) and near[at] - last <= k:  # windows that overlap are searched as one
                    last = near[at]
                    at += 1
                if t.startswith(pattern, max(first, 0)):
                    best = 0
                    break
                d = occurs(self.masks(n), m, t[max(0, first - k) : last + m + k], k)
                if d is not None and (best is None or d < best):
                    best = d
            if best is not None:
                out.append((item, best))
        return sorted(out)


def _blocks(items: DataFrame, id_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most block_chars characters (a longer item makes its own), streamed to the driver."""
    rows = items.where(F.trim(F.coalesce(F.col(text_col), F.lit(""))) != "").select(id_col, text_col)
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) > block_chars:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1])
    if block:
        yield block


#: The automaton of the block that a Python worker saw last, by the name of its pass; tasks of one pass share it.
_built: dict[str, Matcher] = {}


def _matcher(name: str, shared, rate: float) -> Matcher:
    if name not in _built:
        _built.clear()
        _built[name] = Matcher(shared.value, rate)
    return _built[name]


def _passes(docs: DataFrame, text_col: str, name: str, blocks: Iterator[list[tuple[int, str]]], rate: float, keep) -> DataFrame:
    """docs with column `name`, array<struct<item, distance>> of what the blocks' items hit, after one pass a block; keep(df) follows each pass."""
    kind = pa.list_(pa.struct([("item", pa.int64()), ("distance", pa.int32())]))
    block, out = next(blocks, []), docs
    while True:
        shared, one = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

        def found(texts: list[str | None], shared=shared, one=one) -> list[list[dict]]:
            m = _matcher(one, shared, rate)
            return [[{"item": i, "distance": d} for i, d in m.find(t)] for t in texts]

        out = keep(appended(out, text_col, name, "array<struct<item:bigint,distance:int>>", kind, found))
        block = next(blocks, None)
        if block is None:
            return out
        out = stage(out, "decontaminate")


def matches(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, items array<long>, distances array<int>), one row for each row of docs; both lists are empty where it is clean."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.array().cast("array<struct<item:bigint,distance:int>>").alias("all"))
    merge = lambda df: df.select("id", "text", F.concat("all", "hits").alias("all"))
    out = _passes(rows, "text", "hits", _blocks(items, item_col, item_text, block_chars), rate, merge)
    return out.withColumn("all", F.array_sort("all")).select(F.col("id").alias(id_col), F.col("all.item").alias("items"), F.col("all.distance").alias("distances"))


def without_items(docs: DataFrame, items: DataFrame, rate: float = RATE, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item."""
    name = unused(docs.columns, "_hits")
    return _passes(docs, text_col, name, _blocks(items, item_col, item_text, block_chars), rate, lambda df: df.where(F.size(name) == 0).drop(name))


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_items, items and the least distance; contaminated where n_items > 0."""
    out = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", F.size("items").alias("n_items"), "items", F.array_min("distances").alias("distance"), (F.size("items") > 0).alias("contaminated"))
