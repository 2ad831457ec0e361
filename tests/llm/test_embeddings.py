import numpy as np
import pyarrow as pa

from granary.llm import embeddings
from granary.llm.embeddings import calibrated, collide, near_vectors, plan


def brute(rows):
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    ids = sorted(good)
    near = {i: {j for j in ids if j != i and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.9} for i in ids}
    out = {}
    for i, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(near.get(i, ())), min(seen), min(seen) == i)
    return out


def test_links_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(40):
        base = rng.normal(size=24)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), (base + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.25, 0.33, 0.4])).tolist()))
    n = len(rows)
    rows += [(n, None), (n + 1, []), (n + 2, [0.0] * 24), (n + 3, [float("nan")] * 24), (n + 4, [None] + [1.0] * 23), (n + 5, rows[0][1]), (n + 6, [x * 3 for x in rows[1][1]]), (n + 7, [1.0, 2.0]), (n + 8, [1.0, 2.1])]
    table = spark.createDataFrame([(i, v, 1) for i, v in [*rows, rows[2]]], "vec_id long, embedding array<double>, n_links int")
    got = near_vectors(table).collect()
    assert len(got) == len(rows) + 1
    # rows[2] comes twice: two vectors under one id, each linked to the other
    want = brute([*rows, (len(rows), rows[2][1])])
    for r in got:
        n, least, _ = want[r.vec_id]
        assert (r.n_links, r.component_id, r.kept) == (n, least, r.vec_id == least)


def test_rows_that_share_an_id_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0]), (5, [0.0, 1.0]), (3, [0.05, 1.0]), (None, [1.0, 0.05]), (None, None), (9, [1e300, 0.0]), (9, None)]
    got = [(r.vec_id, r.n_links, r.component_id, r.kept) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()]
    want = [(5, 2, 5, True), (5, 1, 3, False), (3, 1, 3, True), (None, 2, 5, False), (None, 0, None, False), (9, 2, 5, False), (9, 0, 9, True)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_recall_of_planted_links(spark):
    """Links at the threshold among many unlike vectors: what brute force finds is found, and nothing else."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(700, 48))
    near = base[:250] + rng.normal(size=(250, 48)) * rng.uniform(0.2, 0.55, (250, 1))
    x = np.r_[base, near]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    found, true = sum(got.values()), int(link.sum())
    assert 100 < true and found <= true and found >= 0.99 * true
    assert all(got[i] <= link[i].sum() for i in got)


def test_unlike_vectors_are_not_written_as_pairs():
    """Of the pairs that meet in windows nearly all are unlike; few are written, and each planted one is."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 64))
    x[1500:] = x[:1500] + rng.normal(size=(1500, 64)) * 0.4
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lines, tables = plan(len(x))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(x))), pa.array([64] * len(x), pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], ["id", "dim", "unit"])
    packed = pa.Table.from_batches(embeddings._project(lines, tables, 9)([batch])).sort_by("bucket")
    assert packed.num_rows <= 2 * 9
    pairs = lambda agree: [(a, b) for r in embeddings._windows(agree)(packed.to_batches()) for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True)]
    agree = calibrated(embeddings.SIGNS, 1 - np.arccos(0.9) / np.pi, 1 - embeddings.MISSED)
    every, some = pairs(0), pairs(agree)
    near = {(i, i + 1500) for i in range(1500) if x[i] @ x[i + 1500] >= 0.9}
    assert len(near) > 900 and near & set(every) == near & set(some)
    assert len([p for p in some if p[1] - p[0] != 1500]) < 0.1 * len([p for p in every if p[1] - p[0] != 1500])


def test_the_count_is_the_most_that_keeps_the_recall():
    lines, tables = plan(50_000)
    cell, window = collide(0.9)
    assert calibrated(tables, cell**lines * window) == 2 and calibrated(tables * 4, cell**lines * window) > 8


def test_plan_grows_slowly():
    (a, b), (c, d) = plan(10_000), plan(1_000_000)
    assert a < c < 2 * a and b < d < 6 * b


def test_empty(spark):
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
