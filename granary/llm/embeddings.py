"""Near-duplicate embeddings by collision-counting projections (operator 9).

Every vector is projected on many random lines. A table joins a few lines that
are cut into cells with one that is sorted; two vectors collide in a table if
they share its cell and the later lies in the window round the earlier one, the
query, on the sorted line. Collisions are counted over all tables; pairs that
reach the count are verified by their cosine in double precision. How many
lines a table has follows the number of vectors, so that the colliding pairs of
unlike vectors stay in proportion to it; how many tables there are follows from
the count, so that a pair at the threshold reaches it with probability RECALL.

The number of tables is fitted so that COUNT collisions reach the recall; the
count that a pair must then have is calibrated again from the tables there are.
Collisions on SIGNS further lines, cut into two halves each, are counted where
the pair meets in a window, by a count that misses one true pair in 100,000: so
pairs of unlike vectors are not written. Tables are shuffled in packed buckets
of about KEYS keys, each of which is sorted by itself.

Equal vectors are folded first and count with their number. Defined results:
vectors that are null, empty, zero or hold null or non-finite components link
with nothing; vectors of different lengths are compared within their length
only; rows that share an id are vectors of their own, each compared; a null id
links too but names no component, and its row is never kept; an empty table
gives none. Further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.operators.graph import connected_components
from granary.plans.staging import stage, unstage

COSINE, RECALL = 0.9, 0.999
#: Width of a cell and half-width of a window, in standard deviations of an unrelated vector's projection.
CELL, WINDOW = 2.4, 1.0
#: Collisions that the tables are fitted for.
COUNT = 2
SEED = 20_240_601
#: Lines cut in halves, the share of true pairs that their count may miss, and keys of a bucket.
SIGNS, MISSED, KEYS = 64, 1e-5, 1 << 17
#: A key of a table: its cell, place on the sorted line, node and signs.
_KEY = np.dtype([("cell", "<i8"), ("p", "<f4"), ("id", "<i8"), ("signs", "<u8")])


def _normal(x: float) -> float:
    return 0.5 * (1 + math.erf(x / math.sqrt(2)))


def collide(cosine: float) -> tuple[float, float]:
    """Chances that vectors of that cosine share a cell of one line, and lie in one window of a sorted line."""
    s = math.sqrt(max(2 - 2 * cosine, 1e-12))
    r = CELL / s
    cell = 1 - 2 * _normal(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return cell, 2 * _normal(WINDOW / s) - 1


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, count: int = COUNT) -> tuple[int, int]:
    """(lines cut into cells, tables) for n vectors."""
    far = collide(0.0)[0]
    lines = max(2, round(math.log(max(n, 2) / 8) / -math.log(far)))
    cell, window = collide(cosine)
    p, tables = cell**lines * window, count
    while sum(math.comb(tables, i) * p**i * (1 - p) ** (tables - i) for i in range(count)) > 1 - recall:
        tables += 1
    return lines, tables


def calibrated(tables: int, p: float, recall: float = RECALL) -> int:
    """The most collisions that a pair which collides in each table with chance p reaches with probability `recall`."""
    missed, count = 0.0, 0
    while count < tables:
        missed += math.comb(tables, count) * p**count * (1 - p) ** (tables - count)
        if missed > 1 - recall:
            break
        count += 1
    return max(1, count)


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dim, unit binary): unit vectors in double precision; null where a vector links with nothing."""
    for b in batches:
        column = b.column("v")
        dims = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
        start, out = np.cumsum(dims) - dims, np.full(len(dims), None, object)
        for dim in np.unique(dims[dims > 0]).tolist():
            rows = np.flatnonzero(dims == dim)
            x = flat[start[rows][:, None] + np.arange(dim)].astype(np.float64)
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            x = x[good] / np.abs(x[good]).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True)) + 0.0
            out[rows[good]] = [v.tobytes() for v in x]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "unit"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _project(lines: int, tables: int, buckets: int):
    """(bucket, keys binary): the keys of all tables, packed by the bucket of their cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                part = whole.slice(at, 2000)
                dims = np.asarray(part.column("dim"))
                for dim in np.unique(dims).tolist():
                    b = part.filter(pa.array(dims == dim))
                    if dim not in made:
                        rng = np.random.default_rng([SEED, dim])
                        a, shift = rng.standard_normal((dim, tables, lines + 1)), rng.uniform(0, CELL, tables * (lines + 1)).reshape(tables, lines + 1)
                        made[dim] = np.ascontiguousarray(a.transpose(2, 0, 1)), shift.T, rng.standard_normal((dim, SIGNS))
                    a, shift, halves = made[dim]
                    u = _matrix(b.column("unit"))
                    keys = np.empty((len(b), tables), _KEY)
                    with np.errstate(over="ignore"):
                        h = np.broadcast_to(np.arange(tables, dtype=np.uint64) * np.uint64(1_000_003) + np.uint64(dim), keys.shape).copy()
                        for i in range(lines):
                            cells = np.floor((u @ a[i] + shift[i]) / CELL).astype(np.int64).view(np.uint64)
                            h = (h ^ (h >> np.uint64(29)) ^ cells) * np.uint64(0x9E3779B97F4A7C15)
                        h ^= h >> np.uint64(32)
                    keys["cell"], keys["p"], keys["id"] = h.view(np.int64), u @ a[lines], np.asarray(b.column("id"))[:, None]
                    keys["signs"] = np.packbits(u @ halves > 0, axis=1).view("<u8")
                    keys, bucket = keys.reshape(-1), (h.reshape(-1) % np.uint64(buckets)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    keys, (name, first) = keys[order], np.unique(bucket[order], return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(name), pa.array([k.tobytes() for k in np.split(keys, first[1:])], pa.binary())], ["bucket", "keys"])

    return run


def _met(keys: np.ndarray, agree: int) -> Iterator[pa.RecordBatch]:
    """(a, b) for each pair of a bucket's keys that share a cell and a window, and `agree` halves."""
    order = np.lexsort((keys["p"], keys["cell"]))
    cell, p, ids, signs = (np.ascontiguousarray(keys[c])[order] for c in ("cell", "p", "id", "signs"))
    at, d, found, held = np.arange(len(cell)), 0, [], 0
    while len(at):
        d += 1
        at = at[: np.searchsorted(at, len(cell) - d)]
        at = at[(cell[at] == cell[at + d]) & (p[at + d] - p[at] <= WINDOW)]
        new = at[np.bitwise_count(signs[at] ^ signs[at + d]) <= SIGNS - agree]
        if len(new):
            found.append((ids[new], ids[new + d]))
            held += len(new)
        if held > 1 << 18 or held and not len(at):
            x, y = (np.concatenate(c) for c in zip(*found, strict=True))
            found, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])


def _windows(agree: int):
    """The pairs of each bucket; its rows lie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for bucket, keys in zip(b.column("bucket").to_pylist(), b.column("keys").to_pylist(), strict=True):
                if bucket != now and parts:
                    yield from _met(np.frombuffer(b"".join(parts), _KEY), agree)
                    parts = []
                now = bucket
                parts.append(keys)
        if parts:
            yield from _met(np.frombuffer(b"".join(parts), _KEY), agree)

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        ok = []
        for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
            ok.append(float(np.frombuffer(x) @ np.frombuffer(y)))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.float64())], ["a", "b", "cosine"])


def near_vectors(table: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row of table.

    A node is a distinct vector; its number is given where the folded table is
    written, so that a lost executor cannot change it.
    """
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    units = stage(rows.mapInArrow(_unit, "id long, dim int, unit binary"), "units")
    folded = units.where("unit is not null").groupBy("dim", "unit").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    folded = stage(folded.withColumn("node", F.monotonically_increasing_id()), "folded")
    n = folded.count()
    lines, tables = plan(n, cosine)
    cell, window = collide(cosine)
    count = calibrated(tables, cell**lines * window)
    agree = calibrated(SIGNS, 1 - math.acos(cosine) / math.pi, 1 - MISSED)
    buckets = max(64, n * tables // KEYS)
    keys = folded.select(F.col("node").alias("id"), "dim", "unit").mapInArrow(_project(lines, tables, buckets), "bucket long, keys binary")
    pairs = keys.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_windows(agree), "a long, b long").where("a <> b")
    pairs = stage(pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= count).select("a", "b"), "vec-pairs")
    x, y = folded.select(F.col("node").alias("a"), F.col("unit").alias("x")), folded.select(F.col("node").alias("b"), F.col("unit").alias("y"))
    links = pairs.join(x, "a").join(y, "b").mapInArrow(_cosines, "a long, b long, cosine double").where(F.col("cosine") >= cosine)
    links = stage(links.select("a", "b"), "vec-links")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    sizes = folded.select(F.col("node").alias("b"), "n")
    degree = stage(both.join(sizes, "b").groupBy("a").agg(F.sum("n").alias("linked")), "degree")
    parts = stage(connected_components(links, "a", "b").withColumnRenamed("node", "member"), "parts")
    known = folded.select("node", "rep", "n").join(degree, F.col("node") == F.col("a"), "left").join(parts, F.col("node") == F.col("member"), "left")
    known = stage(known.select("node", "rep", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("set")), "known")
    least = known.groupBy("set").agg(F.min("rep").alias("component_id"))
    classes = stage(known.join(stage(least, "least"), "set").select("node", "n_links", "component_id"), "classes")
    of_row = units.where("unit is not null").join(folded.select("dim", "unit", "node"), ["dim", "unit"]).select("id", "node")
    linked = of_row.join(classes, "node").select("id", "n_links", "component_id")
    alone = units.where("unit is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    unstage(pairs, known)
    out = linked.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id").union(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("id"), F.lit(False)).alias("kept"))


def op9_embeddings(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
