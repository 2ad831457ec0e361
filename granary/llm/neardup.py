"""Near-duplicate documents by DartMinHash (operator 6).

A document is the multiset of its five-word shingles. Hashed darts fall as a
Poisson process of unit density on the plane (weight, rank) of every shingle;
those under the shingle's count and below a rank that a document's size sets
are thrown, and each coordinate of the signature keeps the earliest. Two
documents share a coordinate with the probability of their weighted Jaccard
similarity. Bands of coordinates are joined; candidates are verified exactly.

Copies with the same words are folded first, so a group of any size is one
representative. The members of a band's bucket are compared with its most
central member, the one that meets the most others over all its buckets: the
text from which a group's copies were made meets more of them than they meet one
another, so one comparison a member finds nearly every class. What is left are
pairs across the classes of a bucket, and they are decided exactly: two sets as
alike as asked overlap so much that, with the shingles of each in order from
rare to common, the first one they share stands early in both. Only the early
shingles of sets in a bucket of several classes are joined, and a pair is made
only if what follows the shared one could still be overlap enough. So no link
between the members of a bucket is lost, no group's pairs are written, and the
same steps run at every size.

Defined results: words are runs of letters, digits and underscores in lower
case; a text of fewer than five words is one shingle; texts without words are
duplicates only if they are equal; a null text is a class of its own; rows that
share an id are one document; a null id gets a null class. Further columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.arrow import mapped, slices
from granary.operators.graph import connected_components
from granary.plans.staging import stage, unstage

WORDS, SIMILARITY = 5, 0.8
#: 25 bands of 5 coordinates: a pair of similarity 0.8 escapes all bands once in 20,000.
BANDS, ROWS = 25, 5
WORD = re.compile(r"\w+")
_SEED = np.uint64(0x2545F4914F6CDD1D)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over arrays."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has."""
    n = np.array([len(x) for x in lists], np.int64)
    flat = np.array([w for x in lists for w in x], object)
    return (pd.util.hash_array(flat) if len(flat) else np.empty(0, np.uint64)), n


def shingles(h: np.ndarray, n: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash) of every shingle of every text, in order."""
    with np.errstate(over="ignore"):
        text = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        start = place < count[text]
        at = np.flatnonzero(start)
        out = np.zeros(len(at), np.uint64)
        length = np.minimum(n, size)[text[at]]
        for i in range(size):
            take = length > i
            out[take] = (out[take] + h[at[take] + i]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i + 1)
        return text[at], mixed(out)


def dart_signatures(text: np.ndarray, item: np.ndarray, weight: np.ndarray, n_texts: int, k: int) -> np.ndarray:
    """Signatures [n_texts, k] of weighted sets given as parallel arrays (set number, item hash, whole weight).

    The region of an item is made of cells of unit weight; the ranks of a cell's
    darts are a Poisson process that its hash fixes, so a greater weight adds
    cells and changes none. The earliest dart of a coordinate is kept.
    """
    sig, best = np.zeros((n_texts, k), np.uint64), np.full((n_texts, k), np.inf)
    if len(item) == 0:
        return sig
    with np.errstate(over="ignore"):
        whole = np.zeros(n_texts)
        np.add.at(whole, text, weight)
        # As many darts as fill all coordinates of most texts; the others throw again, up to twice the rank.
        top = np.where(whole > 0, (k * np.log(k) + 2 * k) / np.maximum(whole, 1), 0.0)
        cell_text = np.repeat(text, weight)
        cell = np.arange(len(cell_text)) - np.repeat(np.cumsum(weight) - weight, weight)
        key = mixed(np.repeat(item, weight) ^ (cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        low = np.zeros(n_texts)
        while True:
            state, rank, where, m = key, np.zeros(len(key)), cell_text, 0
            while len(state):
                state = mixed(state + _SEED)
                rank = rank - np.log(((state >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53)
                keep = rank < top[where]
                state, rank, where = state[keep], rank[keep], where[keep]
                new = rank >= low[where]
                if new.any():
                    dart = mixed(state[new] ^ np.uint64(0x632BE59BD9B4E019))
                    slot = where[new] * k + (dart % np.uint64(k)).astype(np.int64)
                    r = rank[new]
                    order = np.lexsort((dart, r, slot))
                    slot, r, dart = slot[order], r[order], dart[order]
                    first = np.r_[True, slot[1:] != slot[:-1]]
                    slot, r, dart = slot[first], r[first], dart[first]
                    better = r < best.reshape(-1)[slot]
                    best.reshape(-1)[slot[better]] = r[better]
                    sig.reshape(-1)[slot[better]] = dart[better]
                m += 1
            open_texts = np.isinf(best).any(axis=1) & (whole > 0)
            if not open_texts.any():
                return sig
            again = open_texts[cell_text]
            key, cell_text = key[again], cell_text[again]
            low = np.where(open_texts, top, low)
            top = np.where(open_texts, top * 2, 0.0)


def weighted(text: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (set, item) with their counts, ordered by set."""
    order = np.lexsort((item, text))
    text, item = text[order], item[order]
    first = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (item[1:] != item[:-1])]) if len(text) else np.empty(0, np.int64)
    return text[first], item[first], np.diff(np.r_[first, len(text)])


def _lists(column) -> list[list[str]]:
    return [WORD.findall((t or "").lower()) for t in column.to_pylist()]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, size, bands): a key that equal word sequences share, the number of shingles, and a hash for each band."""
    for b in slices(batches, "text", 2 << 20):
        raw, lists = b.column("text").to_pylist(), _lists(b.column("text"))
        h, n = word_hashes(lists)
        sig = dart_signatures(*weighted(*shingles(h, n)), len(lists), BANDS * ROWS)
        with np.errstate(over="ignore"):
            band = np.zeros((len(lists), BANDS), np.uint64)
            for i in range(ROWS):
                band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + sig[:, i::ROWS][:, :BANDS])
            band = mixed(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
        ends = np.cumsum(n)
        keys = []
        for t, e, m in zip(raw, ends, n, strict=True):
            keys.append(None if t is None else hashlib.md5(h[e - m : e].tobytes() if m else b"raw" + t.encode("utf-8", "replace")).digest())
        bands = [band[i].view(np.int64).tolist() if n[i] else [] for i in range(len(lists))]
        size = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(keys, pa.binary()), pa.array(size, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["id", "key", "size", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, items): the shingles of a text as distinct numbers, the n-th time a shingle occurs being its own."""
    for b in slices(batches, "text", 2 << 20):
        lists = _lists(b.column("text"))
        text, item, count = weighted(*shingles(*word_hashes(lists)))
        with np.errstate(over="ignore"):
            nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            each = mixed(np.repeat(item, count) + nth.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).view(np.int64)
        size = np.bincount(np.repeat(text, count), minlength=len(lists))
        out = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(each, pa.int64()))
        yield pa.RecordBatch.from_arrays([b.column("id"), out], ["id", "items"])


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Staged (src, dst): the pairs (a, b) whose weighted Jaccard similarity is at least `similarity`."""
    left = sets.select(F.col("id").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(left, "a").join(right, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
    sim = F.col("n") / (F.size("x") + F.size("y") - F.col("n"))
    return stage(both.where(sim >= similarity).select(F.col("a").alias("src"), F.col("b").alias("dst")), "links")


def _led_pairs(reps: DataFrame, similarity: float) -> DataFrame:
    """Staged (a, b): every member of a bucket with the bucket's most central one, where their sizes admit a link.

    reps: (rep, size, met, buckets), met being how many rows share its buckets.
    """
    each = reps.select("rep", "size", "met", F.explode("buckets").alias("bucket"))
    lead = each.groupBy("bucket").agg(F.max_by(F.struct("rep", "size"), F.struct("met", "rep")).alias("lead"))
    both = each.select("bucket", "rep", "size").join(stage(lead, "leads"), "bucket").where(F.col("rep") != F.col("lead.rep"))
    fits = F.least("size", "lead.size") >= similarity * F.greatest("size", "lead.size")
    # A hub leads many members, so the first join of the comparison is on the members' side.
    return stage(both.where(fits).select(F.col("rep").alias("a"), F.col("lead.rep").alias("b")).distinct(), "pairs")


def _open_reps(reps: DataFrame, label: DataFrame) -> DataFrame:
    """Staged (rep, size, label) of those that share a bucket with a member of another class; classes of one are their own label."""
    named = reps.join(label, reps["rep"] == label["node"], "left").select("rep", "size", "buckets", F.coalesce("component", "rep").alias("label"))
    named = stage(named, "labels")
    each = named.select("rep", "label", F.explode("buckets").alias("bucket"))
    mixed = stage(each.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("bucket"), "mixed")
    found = each.join(mixed, "bucket").select("rep").distinct()
    return stage(named.drop("buckets").join(found, "rep"), "open")


def _rare_pairs(open_reps: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Staged (a, b): the pairs of different classes that may be alike enough by the rarest shingle they share.

    The shingles of each set are put in order from rare to common. Those that one set alone has come first and
    match nothing, so only their number is needed. `rest` is how many shingles don't precede one: what two sets
    have in common is no more than the lesser rest at the first that they share.
    """
    own = stage(sets.join(open_reps.select(F.col("rep").alias("id"), "label"), "id").select("id", "label", "items"), "open-sets")
    flat = own.select("id", F.explode("items").alias("item"))
    common = stage(flat.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "common")
    ranked = flat.join(common, "item").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("ranked"))
    # A set of n overlaps with its partner in similarity * n items at least, so the first of them is not after place n - similarity * n.
    early = F.size("ranked") - F.ceil(F.col("n") * similarity - 1e-6).cast("int") + 1
    placed = own.select("id", "label", F.size("items").alias("n")).join(ranked, "id").where(early > 0)
    placed = placed.select("id", "label", "n", F.size("ranked").alias("left"), F.posexplode(F.slice("ranked", 1, early)).alias("k", "of"))
    rows = stage(placed.select("id", "label", F.col("of.item").alias("item"), "n", (F.col("left") - F.col("k")).alias("rest")), "rare")
    unstage(own, common)
    share = similarity / (1 + similarity)
    x = rows.select("item", F.col("id").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("rest").alias("ra"))
    # The smaller of two sets needs at least its own size twice over in what follows.
    x = x.where(F.col("ra") >= F.ceil(2 * F.col("na") * share - 1e-6))
    y = rows.select("item", F.col("id").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("rest").alias("rb"))
    least = F.ceil((F.col("na") + F.col("nb")) * share - 1e-6)
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    fits = smaller & (F.col("la") != F.col("lb")) & (F.least("ra", "rb") >= least) & (F.col("na") >= similarity * F.col("nb"))
    pairs = stage(x.join(y, "item").where(fits).select("a", "b").distinct(), "pairs")
    unstage(rows)
    return pairs


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, kept, members) of every row of docs: class_id is the least id of those linked to it, kept tells whether it is its own, members counts the rows of the class."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = stage(mapped(rows, _sign, f"id {kind}, key binary, size long, bands array<long>"), "signed")
    folded = signed.where("key is not null and id is not null").groupBy("key")
    folded = stage(folded.agg(F.min("id").alias("rep"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.count("*").alias("members")), "folded")
    spread = folded.select("rep", "size", F.explode("bands").alias("bucket"))
    shared = stage(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    reps = spread.join(shared, "bucket").groupBy("rep", "size").agg(F.collect_list("bucket").alias("buckets"), F.sum("n").alias("met"))
    reps = stage(reps, "reps")  # a rep has BANDS buckets at most
    texts = rows.join(reps.select(F.col("rep").alias("id")).hint("shuffle_hash"), "id", "left_semi").select("id", "text")
    sets = stage(mapped(texts, _sets, f"id {kind}, items array<long>"), "sets")

    pairs = _led_pairs(reps, similarity)
    led = _verified(pairs, sets, similarity)
    open_reps = _open_reps(reps, stage(connected_components(led), "parts"))
    rare = _rare_pairs(open_reps, sets, similarity)
    links = led.union(_verified(rare, sets, similarity))
    parts = stage(connected_components(links), "parts")
    unstage(sets, reps, shared, pairs, rare)
    named = folded.join(parts, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("class_id"), "members")
    named = stage(named, "named")
    sizes = stage(named.groupBy("class_id").agg(F.sum("members").alias("members")), "sizes")
    named = named.select("key", "class_id").join(sizes, "class_id")
    out = signed.select("id", "key").join(stage(named, "classes"), "key", "left")
    out = out.select("id", F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"), F.coalesce("members", F.lit(1)).alias("members"))
    return out.select(F.col("id").alias(id_col), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"), "members")


def op6_neardup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
