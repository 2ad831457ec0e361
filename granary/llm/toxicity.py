"""Toxicity scores (operator 3).

A lexicon trie holds whole terms and stems that labelled toxic documents use
and clean ones don't. Its product with Levenshtein automata is one automaton
whose states are built as words need them: a word ends in an exact term, a
term with one or two edits, a stem, or nowhere. Every hit is weighed in a
window of words around it: quotation marks and words of reporting speak for
quotation, second-person words for abuse. A logistic model over the sums of
these windows gives the score.

Defined results: null and empty texts have no hits and get the score of a
document without any; every row is scored, repeated rows too; with no usable
labels the lexicon is empty and every score is 0. Labels, language, source and
id are never inputs. Further columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices
from granary.llm.labelled import labelled_sample, remainder

WORD = re.compile(r"\w+")
#: Words either side of a hit that its window takes in.
WINDOW = 8
#: Labelled rows of each class that the lexicon and the weights are learned from.
PER_CLASS = 6_000
#: Documents a term must occur in, and the log-odds it must reach.
MIN_DOCS, MIN_ODDS = 4, 3.0
#: Letters of a prefix that may become a stem.
STEMS = range(4, 9)
#: Distinct words and automaton states that a Python worker remembers; both start anew beyond that, which changes no result.
REMEMBERED, MOST_STATES = 250_000, 50_000
# Marks and words that open a quotation or report speech, and words of address.
QUOTES = "\"'“”„«»‘’"
REPORTING = frozenset("said says wrote writes called calls quote quoted term word slur saying dit dijo sagte escribió écrit schrieb".split())
ADDRESS = frozenset("you your yours youre u tu toi vous te tú usted du dich dir sie".split())


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Lexicon:
    """Trie of terms and stems, and the automaton that accepts what is near them."""

    EXACT, STEM, FUZZY = 1, 2, 3
    EDITS = 4

    def __init__(self, terms: list[str], stems: list[str]):
        self.words = tuple(terms), tuple(stems)
        self.child: list[dict[str, int]] = [{}]
        self.term: dict[int, int] = {}
        self.stem: set[int] = set()
        self.most = [0]
        for t in terms:
            self.term[self._add(t, edits_allowed(t))] = edits_allowed(t)
        for t in stems:
            self.stem.add(self._add(t, 0))
        # An item is EDITS * node + edits, held once; a state is the sorted tuple of its items.
        self.item = list(range(self.EDITS * len(self.child)))
        self.start = self._closed({0})
        self.moves: dict[tuple, dict[str, tuple]] = {}
        self.ends: dict[tuple, int | None] = {}
        self.known: dict[str, int] = {}

    def __reduce__(self):
        """Sent as its words only; a Python worker builds the automaton once, not once a task."""
        return shared_lexicon, self.words

    def _add(self, word: str, edits: int) -> int:
        at = 0
        self.most[0] = max(self.most[0], edits)
        for c in word:
            if c not in self.child[at]:
                self.child[at][c] = len(self.child)
                self.child.append({})
                self.most.append(0)
            at = self.child[at][c]
            self.most[at] = max(self.most[at], edits)
        return at

    def _closed(self, items: set[int]) -> tuple[int, ...]:
        """With every state that skipping letters of the lexicon reaches."""
        todo = list(items)
        while todo:
            at, e = divmod(todo.pop(), self.EDITS)
            for nxt in self.child[at].values():
                x = self.EDITS * nxt + e + 1
                if e < self.most[nxt] and x not in items:
                    items.add(x)
                    todo.append(x)
        return tuple([self.item[x] for x in sorted(items)])

    def step(self, state: tuple[int, ...], c: str) -> tuple[int, ...]:
        moves = self.moves.get(state)
        if moves is None:
            moves = self.moves[state] = {}
        if c not in moves:
            out = set()
            for x in state:
                at, e = divmod(x, self.EDITS)
                for letter, nxt in self.child[at].items():
                    if letter == c:
                        out.add(self.EDITS * nxt + e)
                    elif e < self.most[nxt]:
                        out.add(self.EDITS * nxt + e + 1)
                if e < self.most[at]:
                    out.add(x + 1)
            moves[c] = self._closed(out)
        return moves[c]

    def outcome(self, word: str) -> int:
        """How word ends in the automaton: EXACT, STEM, FUZZY or 0."""
        found = self.known.get(word)
        if found is None:
            found = self._run(word)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(self.moves) > MOST_STATES:
                self.moves.clear()
                self.ends.clear()
            self.known[word] = found
        return found

    def _stemmed(self, word: str) -> bool:
        """Whether word starts with a stem; stems admit no edit, so the trie alone tells."""
        at = 0
        for c in word:
            at = self.child[at].get(c)
            if at is None:
                return False
            if at in self.stem:
                return True
        return False

    def _end(self, state: tuple[int, ...]) -> int | None:
        """Least number of edits with which a term ends in state."""
        if state not in self.ends:
            found = [divmod(x, self.EDITS) for x in state]
            self.ends[state] = min((e for at, e in found if at in self.term and e <= self.term[at]), default=None)
        return self.ends[state]

    def _run(self, word: str) -> int:
        state, moves, none = self.start, self.moves, {}
        for c in word:
            seen = moves.get(state, none).get(c)
            state = self.step(state, c) if seen is None else seen
            if not state:
                break
        end = self._end(state)
        if end == 0:
            return self.EXACT
        return self.STEM if self._stemmed(word) else 0 if end is None else self.FUZZY

    def features(self, text: str) -> list[float]:
        """Sums over the windows of the hits of one text."""
        low = text.lower()
        words = WORD.findall(low)
        known, hits = self.known, {}
        for w in set(words):
            k = known.get(w)
            if k is None:
                k = self.outcome(w)
            if k:
                hits[w] = k
        out = [0.0] * N_FEATURES
        if not hits:
            return out
        at = [m.span() for m in WORD.finditer(low)]
        total = 0.0
        for i in [i for i, w in enumerate(words) if w in hits]:
            kind = hits[words[i]]
            a, b = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            before, after = low[at[a][0] : at[i][0]], low[at[i][1] : at[b][1]]
            near = set(words[a : b + 1])
            opened = sum(before.count(q) for q in QUOTES if q != "'") % 2 or before.endswith("'")
            closed = any(q in after for q in QUOTES if q != "'") or after.startswith("'")
            quoted = bool(opened and closed) + bool(near & REPORTING)
            weight = (1.0, 0.4, 0.15)[quoted] * (1.2 if near & ADDRESS else 1.0)
            out[kind - 1] += weight
            out[3] += quoted > 0
            total += weight
        out[4] = total / len(words)
        return [float(np.log1p(x)) for x in out[:4]] + [min(1.0, 20 * out[4])]


N_FEATURES = 5


@functools.lru_cache(maxsize=1)
def shared_lexicon(terms: tuple[str, ...], stems: tuple[str, ...]) -> Lexicon:
    return Lexicon(list(terms), list(stems))


def build_lexicon(counts: list[tuple[str, bool, int, int]], n_pos: int, n_neg: int) -> tuple[list[str], list[str]]:
    """(terms, stems) of (string, is a whole word, toxic contexts, clean documents), as count_strings gives them.

    A prefix becomes a stem where it is pure and no single word explains it;
    words below a stem add nothing to it and are left out.
    """
    odds = lambda p, n: np.log((p + 0.5) / (n_pos + 1)) - np.log((n + 0.5) / (n_neg + 1))
    words = {w: (p, n) for w, whole, p, n in counts if whole and p >= MIN_DOCS and odds(p, n) >= MIN_ODDS}
    stems: list[str] = []
    pure = sorted((w, p) for w, whole, p, n in counts if not whole and n == 0 and p >= 3 * MIN_DOCS and odds(p, n) >= MIN_ODDS)
    for s, p in pure:
        if any(s.startswith(x) for x in stems):
            continue
        inside = [q for w, (q, _) in words.items() if w.startswith(s)]
        if not inside or max(inside) < 0.7 * p:
            stems.append(s)
    terms = [w for w in sorted(words, key=lambda w: (-words[w][0], w)) if not any(w.startswith(s) for s in stems)]
    return terms, stems


def count_strings(sample: DataFrame) -> list[tuple[str, bool, int, int]]:
    """(string, whole word, toxic, clean): how often words and their prefixes occur; only strings that toxic documents favour are returned.

    A clean document counts once. Toxic documents count once for each pair of
    neighbours that the string first stands between, so that what copies of one
    text share is seen once and only words that go from text to text add up. The
    sample's bound on rows bounds the result: each string is in MIN_DOCS of its
    toxic documents at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            s, whole, between, ys = [], [], [], []
            for text, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                found = ["", *WORD.findall(text.lower()), ""]
                words: dict[str, str] = {}
                for before, w, after in zip(found, found[1:], found[2:], strict=False):
                    if len(w) >= 3 and w not in words:
                        words[w] = f"{before} {after}" if y else ""
                stems: dict[str, str] = {}
                for w, at in words.items():
                    for k in STEMS:
                        if k <= len(w):
                            stems.setdefault(w[:k], at)
                s += [*words, *stems]
                between += [*words.values(), *stems.values()]
                whole += [True] * len(words) + [False] * len(stems)
                ys += [y] * (len(words) + len(stems))
            yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(whole, pa.bool_()), pa.array(between, pa.string()), pa.array(ys, pa.int32())], ["s", "whole", "at", "y"])

    seen = mapped(sample.select("text", "y"), run, "s string, whole boolean, at string, y int")
    seen = seen.groupBy("s", "whole", "y", F.xxhash64("at").alias("at")).agg(F.count("*").alias("n"))
    n = seen.groupBy("s", "whole").agg(F.count_if(F.col("y") == 1).alias("p"), F.coalesce(F.sum(F.when(F.col("y") == 0, F.col("n"))), F.lit(0)).alias("n"))
    rows = n.where(f"p >= {MIN_DOCS} and p > 4 * n").collect()
    return sorted((r.s, r.whole, r.p, r.n) for r in rows)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-3) -> np.ndarray:
    """Weights (bias last) of a class-balanced logistic model, by Newton steps."""
    if len(y) == 0:
        return np.r_[np.zeros(x.shape[1]), -8.0]
    a = np.c_[x, np.ones(len(x))]
    w, c = np.zeros(a.shape[1]), np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (c * (p - y)) + l2 * w
        h = (a * (c * p * (1 - p))[:, None]).T @ a + l2 * np.eye(len(w))
        d = np.linalg.solve(h, g)
        w -= d
        if np.abs(d).max() < 1e-8:
            break
    return w


def _features(sample: DataFrame, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    terms = lex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            got = [terms.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), b.column("y")], ["x", "y"])

    rows = mapped(sample.select("text", "y"), run, "x array<double>, y int").collect()
    return np.array([r.x for r in rows]).reshape(len(rows), N_FEATURES), np.array([r.y for r in rows])


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = PER_CLASS) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and weights from a bounded sample of the labelled rows that `usable` admits."""
    sample = labelled_sample(docs, labels, "toxic", usable, per_class)
    n = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    terms, stems = build_lexicon(count_strings(sample), n.get(1, 0), n.get(0, 0))
    x, y = _features(sample, Lexicon(terms, stems))
    return Lexicon(terms, stems), fit_logistic(x, y)


def scores(texts: list[str | None], lex: Lexicon, weights: np.ndarray) -> np.ndarray:
    x = np.array([lex.features(t or "") for t in texts]).reshape(len(texts), N_FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))


def score(docs: DataFrame, lex: Lexicon, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(scores(b.column("text").to_pylist(), lex, weights), pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return mapped(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); rows with crc32 remainder 0 of 5 are held out of learning."""
    lex, w = fit(docs, labels, remainder("doc_id", 5) != 0)
    out = score(docs, lex, w)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
