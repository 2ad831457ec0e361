"""License scans by patience alignment (operator 10).

A template is aligned with a stretch of text by the words that occur once in
both: the longest increasing run of them fixes the order, and the gaps between
two anchors are aligned in the same way. The share of the template's words that
the alignment covers tells whether the text holds it.

Stretches are the places where a template's rarest words stand close together;
all of a text is searched for them. Defined results: null and empty texts hold
no license; a license that occurs twice is counted twice; a template is reported
only where no better covered template lies over it; every row of the input gives
one row. Further columns are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices

WORD = re.compile(r"[^\W_]+")
#: Share of a template's words that must be covered.
COVERAGE = 0.8
# Notices that works carry, by their SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
}


def longest_run(numbers: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, x in enumerate(numbers):
        k = bisect_left(tops, x)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(x)
            at.append(i)
        else:
            tops[k], at[k] = x, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions of equal words, increasing in both, by patience: common ends, anchors, then the gaps between them."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:m])
        where = {w: p for p, w in enumerate(b[k:m], k) if once_b[w] == 1}
        both = [(p, where[w]) for p, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in where]
        anchors = [both[x] for x in longest_run([q for _, q in both])]
        if not anchors:
            continue
        out += anchors
        ends = [(i - 1, k - 1), *anchors, (j, m)]
        todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float = COVERAGE):
        self.coverage = coverage
        self.templates = {name: words for name, t in templates.items() if (words := [w.lower() for w in WORD.findall(t)])}
        spread = Counter(w for ws in self.templates.values() for w in set(ws))
        # A template's marks: so many of its least shared and longest words that an accepted alignment must hold one.
        self.marks: dict[str, set[str]] = {}
        for name, ws in self.templates.items():
            free = len(ws) - math.ceil(coverage * len(ws) - 1e-9) + 1
            ranked = sorted(set(ws), key=lambda w: (spread[w], -len(w), w))
            taken, n, count = set(), 0, Counter(ws)
            for w in ranked:
                if n >= free:
                    break
                taken.add(w)
                n += count[w]
            self.marks[name] = taken
        self.of_mark: dict[str, list[str]] = {}
        for name, ws in self.marks.items():
            for w in ws:
                self.of_mark.setdefault(w, []).append(name)
        self.hint = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, self.of_mark))) + r")(?![^\W_])") if self.of_mark else None

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first character, end) of every notice in text, in order."""
        if not text or self.hint is None:
            return []
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        if not self.hint.search(low):
            return []
        found = list(WORD.finditer(low))
        words = [m.group() for m in found]
        places: dict[str, list[int]] = {}
        for p, w in enumerate(words):
            for name in self.of_mark.get(w, ()):
                places.setdefault(name, []).append(p)
        hits = []
        for name, at in places.items():
            t = self.templates[name]
            reach = len(t)
            i = done = 0
            while i < len(at):
                # Words around the next mark; what an alignment took is not searched again.
                lo, hi = max(done, at[i] - reach), min(len(words), at[i] + 2 * reach)
                pairs = self._tightest(words, lo, hi, at[i], t)
                share = len(pairs) / len(t)
                if share >= self.coverage:
                    first, last = pairs[0][0], pairs[-1][0]
                    hits.append((name, share, first, last + 1))
                    done = last + 1
                i += 1  # the alignment may lie before the mark
                while i < len(at) and at[i] < done:
                    i += 1
        best = []
        for h in sorted(hits, key=lambda h: (-h[1], -len(self.templates[h[0]]), h[3] - h[2], h[2], h[0])):
            if all(h[3] <= x[2] or h[2] >= x[3] for x in best):
                best.append(h)
        return [(n, round(s, 4), found[a].start(), found[b - 1].end()) for n, s, a, b in sorted(best, key=lambda h: (h[2], h[0]))]

    @staticmethod
    def _tightest(words: list[str], lo: int, hi: int, mark: int, t: list[str]) -> list[tuple[int, int]]:
        """The best alignment over stretches round a mark: each start that puts the mark in its place of the template, then the whole stretch."""
        best: list[tuple[int, int]] = []
        # A long template may drift by as many words as it has quarters of, so wider stretches follow the tight one.
        drifts = sorted({2, len(t) // 8, len(t) // 4} - {0, 1})
        places = [q for q, w in enumerate(t) if w == words[mark]]
        near = [(max(lo, mark - q - d), min(hi, mark - q + len(t) + d)) for d in drifts for q in places]
        for a, b in [*near, (lo, hi)]:
            pairs = [(p + a, k) for p, k in align(words[a:b], t)]
            if len(pairs) > len(best):
                best = pairs
        return best


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, licenses array<struct(license, coverage, start, stop)>) of every row of docs."""
    scanner = Scanner(TEMPLATES if templates is None else templates, coverage)
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [[dict(zip(("license", "coverage", "start", "stop"), x, strict=True)) for x in scanner.scan(t)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(got, kind)], ["id", "licenses"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = f"id {rows.schema['id'].dataType.simpleString()}, licenses array<struct<license:string,coverage:double,start:long,stop:long>>"
    return mapped(rows, run, out).withColumnRenamed("id", id_col)


def op10_licenses(spark, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, how many notices it holds, the distinct licenses in order, and the best coverage."""
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.size("licenses").alias("n_notices"), F.array_sort(F.array_distinct("licenses.license")).alias("licenses"), F.coalesce(F.array_max("licenses.coverage"), F.lit(0.0)).alias("coverage"))


#: Notices of these tables are whole and unchanged, each on its own line.
ORACLE_SQL = """
with t(license, words) as (values
  ('MIT', 'released under the mit license'), ('Apache-2.0', 'licensed under the apache license version 2 0'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'), ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0')
), d as (
  select doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' as x from documents
), n as (
  select d.doc_id, t.license, (length(x) - length(replace(x, ' ' || words || ' ', ' '))) // (length(words) + 1) as k from d cross join t
)
select doc_id, cast(sum(k) as integer) as n_notices,
       coalesce(list_sort(list(license) filter (where k > 0)), []) as licenses,
       cast(case when sum(k) > 0 then 1.0 else 0.0 end as double) as coverage
from n group by doc_id
"""
