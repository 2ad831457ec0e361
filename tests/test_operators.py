import datetime as dt
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.operators import joins as J
from granary.operators import ml
from granary.operators import raster as R
from granary.operators import series as W
from granary.operators.sampling import few_labels
from granary.plans import catalogue
from granary.sources import io
from granary.streaming.windows import windowed_means

D0 = dt.date(2025, 1, 1)


def day(n):
    return D0 + dt.timedelta(days=n)


def series(spark, points, key="f"):
    return spark.createDataFrame([(key, day(n), v) for n, v in points], "k string, d date, v double")


def test_regularise_hits_gaps_and_ends(spark):
    s = series(spark, [(5, 1.0), (15, 2.0), (45, 5.0), (50, 4.0), (81, 0.0), (90, None)])
    got = {(r.day - D0).days: r.value for r in W.regularise(s, "k", "d", "v", "2025-01-01", "2025-04-11").collect()}
    assert got[0] is None and got[5] == 1.0 and got[10] == 1.5 and got[30] == pytest.approx(3.5)  # a gap of 30 days is filled
    assert got[50] == 4.0 and got[55] is None and got[80] is None and got[85] is None and len(got) == 21


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 99), st.floats(-1, 1), min_size=1, max_size=12))
def test_regularise_stays_within_its_neighbours(spark, points):
    got = W.regularise(series(spark, sorted(points.items())), "k", "d", "v", "2025-01-01", "2025-04-10").collect()
    for r in got:
        n = (r.day - D0).days
        if n in points:
            assert r.value == points[n]
        elif r.value is not None:
            a, b = max(p for p in points if p < n), min(p for p in points if p > n)
            assert b - a <= 30 and min(points[a], points[b]) - 1e-9 <= r.value <= max(points[a], points[b]) + 1e-9


def test_dips(spark):
    s = series(spark, [(0, 0.5), (5, 0.4), (10, 0.5), (15, 0.38), (20, 0.5), (40, 0.3), (61, 0.5), (65, 0.1)])
    got = [(r.d - D0).days for r in W.dips(s, "k", "d", "v").collect() if r.dip]
    assert got == [15]  # a drop of 0.1 is not one; 21 days are too far; ends never are


def test_hazy_days_need_enough_entities(spark):
    rows = [(f"f{i}", day(j), 0.6, 0.0061 if i < 5 - j else 0.0) for i in range(12) for j in range(3) if i < 5 - j or i > 8]
    df = spark.createDataFrame([r for r in rows if r[3] > 0], "f string, d date, n double, h double")
    got = W.hazy_days(df, "d", F.col("n") > 0.5, "h", F.col("f"), 0.006).collect()
    assert {r.d for r in got} == {day(0), day(1), day(2)}


def test_savgol_fits_polynomials_and_leaves_short_runs(spark):
    f = lambda x: 2 + 0.5 * x - 0.1 * x * x
    s = series(spark, [(i, f(i)) for i in range(9)] + [(9, None), (10, 3.0), (11, 7.0)])
    got = {(r.d - D0).days: r.smooth for r in W.savgol(s, "k", "d", "v", 5).collect()}
    assert all(abs(got[i] - f(i)) < 1e-9 for i in range(9)) and got[9] is None and (got[10], got[11]) == (3.0, 7.0)


def grid_series(spark, values, start=dt.date(2024, 11, 1)):
    return spark.createDataFrame([("f", start + dt.timedelta(days=5 * i), None if v is None else float(v)) for i, v in enumerate(values)], "k string, d date, v double")


def test_phenology_of_one_bell(spark):
    x = np.arange(0, 360, 5)
    v = 0.1 + 0.7 * np.exp(-(((x - 100) / 30.0) ** 2)) + 0.02 * np.exp(-x / 10.0)
    assert W.phenology(grid_series(spark, v[2:]), "k", "d", "v").where("season = 'rabi_2025'").first().note == ""
    assert W.phenology(grid_series(spark, v[10:]), "k", "d", "v").where("season = 'rabi_2025'").first().note == "start unseen"  # its base is at the edge
    rabi, kharif = sorted(W.phenology(grid_series(spark, v), "k", "d", "v").collect(), key=lambda r: r.season, reverse=True)
    assert rabi.peak == pytest.approx(0.8) and rabi.note == "" and 45 <= rabi.length_days <= 55 and rabi.value_days > 25
    assert kharif.peak is None and kharif.note == "peak outside"


def test_phenology_beside_gaps(spark):
    """A base that a gap parts from the peak, or that lies at the edge of the peak's run, gives no start."""
    up = [0.1, 0.1, None, None, 0.35, 0.45, 0.6, 0.8, 0.7, 0.5, 0.3, 0.15, 0.1, 0.12]
    r = W.phenology(grid_series(spark, up), "k", "d", "v").first()
    assert (r.start_day, r.note) == (None, "start unseen") and r.end_day is not None and r.length_days is None
    r = W.phenology(grid_series(spark, [0.1, 0.2, 0.8, None, 0.1]), "k", "d", "v").first()
    assert r.note == "beside gap; start unseen; end unseen"
    assert W.phenology(grid_series(spark, [0.4, 0.45, 0.5, 0.45]), "k", "d", "v").first().note == "flat"
    assert W.phenology(grid_series(spark, [None, None]), "k", "d", "v").first().note == "empty"


def test_peaks_without_a_drop_between_them_are_one(spark):
    """One crop over the turn of April: two seasons have its shoulder, the later and higher one keeps it."""
    x = np.arange(0, 420, 5)
    one = 0.1 + 0.6 * np.exp(-(((x - 160) / 25.0) ** 2)) + 0.65 * np.exp(-(((x - 205) / 20.0) ** 2))
    got = {r.season: r for r in W.phenology(grid_series(spark, one), "k", "d", "v").collect()}
    assert got["rabi_2025"].note == "in kharif_2025" and got["rabi_2025"].peak is None and got["kharif_2025"].peak > 0.7
    two = 0.1 + 0.02 * np.exp(-x / 10.0) + 0.02 * np.exp((x - 415) / 10.0) + 0.6 * np.exp(-(((x - 120) / 20.0) ** 2)) + 0.65 * np.exp(-(((x - 270) / 20.0) ** 2))
    got = {r.season: r for r in W.phenology(grid_series(spark, two), "k", "d", "v").collect()}
    assert got["rabi_2025"].note == "" and got["kharif_2025"].note == ""


def test_nearest_join_ties_and_tolerance(spark):
    t = lambda s: dt.datetime(2025, 1, 5) + dt.timedelta(seconds=s)
    left = spark.createDataFrame([(1, "a", t(0)), (2, "b", t(0)), (3, "c", t(0))], "id int, by string, t timestamp_ntz")
    right = spark.createDataFrame([("a", t(100), 1), ("a", t(-100), 2), ("b", t(3600), 3), ("c", t(3601), 4)], "by string, t timestamp_ntz, v int")
    assert {r.id: r.r_v for r in J.asof_nearest(left, right, "by", "t", 3600, ["v"]).collect()} == {1: 2, 2: 3}


def test_votes_scores_and_areas(spark):
    df = spark.createDataFrame([("x", 2), ("x", 1), ("y", 3)], "f string, code int")
    assert {r.f: (r.majority, r.agreement) for r in A.majority(df, ["f"], "code").collect()} == {"x": (1, 0.5), "y": (3, 1.0)}
    assert A.otsu(spark.createDataFrame([(float(i % 10 + (50 if i % 2 else 0)),) for i in range(400)], "v double"), "v").first().threshold < 50
    codes = spark.createDataFrame([(1, "one"), (7, "never")], "code int, name string")
    assert {r.name: r.pixels for r in A.class_areas(df, "code", codes).collect()} == {"one": 1, "never": 0}


def test_rasters_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((6, 7))
    g = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(7)], "r int, c int, v double")
    pad = np.pad(a, 1, mode="edge")
    mean = {(r.r, r.c): r.mean for r in R.focal_mean(g, "v", 6, 7).collect()}
    assert all(abs(mean[i, j] - pad[i : i + 3, j : j + 3].mean()) < 1e-9 for i in range(6) for j in range(7))
    mask = a > 0.55
    near = {(r.r, r.c) for r in R.dilate(g.where("v > 0.55"), 2, 6, 7).collect()}
    assert near == {(i, j) for i in range(6) for j in range(7) if mask[max(0, i - 2) : i + 3, max(0, j - 2) : j + 3].any()}
    assert R.dilate(g, 0, 6, 7).count() == 42 and R.opening(g, 6, 7).count() == 42


def test_proximity_groups_of_all_parts(spark):
    """Brute force over every pair of the whole table."""
    sf = "/root/testdata/sf0.01"
    ids = np.array(sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()), np.int64)
    x, y = ids * 7919 % 5000 / 10.0, ids * 104729 % 5000 / 10.0
    near = np.hypot(x[:, None] - x, y[:, None] - y) <= 20.0
    part = ids.copy()
    while True:
        least = np.where(near, part, ids.max() + 1).min(axis=1)
        if (least == part).all():
            break
        part = least
    got = catalogue.QUERIES["proximity_groups"](spark, sf).collect()
    assert sorted((r.id, r.component) for r in got) == list(zip(ids.tolist(), part.tolist()))


def test_proximity_groups_of_dense_and_odd_points(spark, monkeypatch):
    """The components of near_pairs, however points lie; 6,000 ids on 30 places make some hundred pairs of cells, not millions of points."""
    rng = np.random.default_rng(12)
    rows = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-300, 300, (500, 2)))]
    ring = [(600 + k, 1000 + 20 * float(np.cos(t)), 20 * float(np.sin(t))) for k, t in enumerate(np.linspace(0, 1.5, 80))]
    rows += [*ring, (700, 1000.0, 0.0), (701, 1000.0, 20.0), (702, 1000.0, 40.000001), (703, 980.0, 0.0)]
    rows += [(800, None, 1.0), (801, float("nan"), 1.0), (802, float("inf"), 1.0), (3, 5000.0, 0.0), (803, 5019.0, 0.0), (804, None, None), (804, 5100.0, 0.0), (805, 5110.0, 0.0)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    want = {r.node: r.component for r in J.connected_components(J.near_pairs(df.where("x is not null and x = x and x < 1e300"), "id", "x", "y", 20.0)).collect()}
    for direct in (0, 1 << 20):
        monkeypatch.setattr(J, "DIRECT", direct)
        got = J.proximity_groups(df, "id", "x", "y", 20.0).collect()
        assert sorted((r.id, r.component) for r in got) == sorted((i, want.get(i, i)) for i, _, _ in rows)
    made, close = [], J.connected_components
    monkeypatch.setattr(J, "connected_components", lambda e: made.append(e.count()) or close(e))
    many = spark.range(6000).selectExpr("id", "id % 30 * 9.0 as x", "0.0 as y")
    assert {r.component for r in J.proximity_groups(many, "id", "x", "y", 20.0).collect()} == {0} and made[0] < 100


def test_learning_queries_run_the_whole_job(spark, monkeypatch):
    """The reference's k, starts, sizes, draws and trees."""
    sf, asked = "/root/testdata/sf0.001", []
    monkeypatch.setattr(catalogue.ml, "best_kmeans", lambda df, ks, seeds: asked.append((list(ks), seeds)))
    monkeypatch.setattr(catalogue.ml, "few_label_curve", lambda df, cls, key, vec, sizes, draws: asked.append((sizes, draws)))
    monkeypatch.setattr(catalogue.ml, "cross_validate", lambda df, cls, strip, estimator, strips: asked.append(estimator.getNumTrees()) or spark.createDataFrame([(1, 1)], "truth int, pred int"))
    for name in ("kmeans_choice", "few_label_curve", "forest_scores"):
        catalogue.QUERIES[name](spark, sf)
    assert asked == [(list(range(3, 11)), 20), ([3, 6, 12, 24], 30), 500]


def test_few_label_curve_against_single_draws(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 200").cache()
    got = {r.labels: r["mean"] for r in ml.few_label_curve(e, "label", "vec_id", "embedding", [3, 12], 2).collect()}
    for n in (3, 12):
        each = []
        for d in range(2):
            train = few_labels(e, "label", "vec_id", n, str(d)).select("vec_id", F.lit(1).alias("t"))
            p = ml.centroid_predictions(e.join(train, "vec_id", "left").withColumn("strip", F.coalesce("t", F.lit(0))), "vec_id", "label", "embedding", "strip").where("strip = 0")
            each.append(A.scores(p, ["strip"], "truth", "pred").first().balanced)
        assert got[n] == pytest.approx(sum(each) / 2, abs=1e-9)


def test_component_reaches_far_cells(spark):
    """A snake of 1,205 steps, and a cell that is not linked."""
    snake = [(i, j) for i in range(0, 21, 2) for j in range(100)] + [(i, 99 if i % 4 == 1 else 0) for i in range(1, 20, 2)]
    snake += [(20, 99 + j) for j in range(1, 97)]
    mask = spark.createDataFrame([*snake, (40, 40), snake[0]], "r int, c int")
    assert sorted((r.r, r.c) for r in R.component_at(mask, 0, 0).collect()) == sorted(snake)
    assert R.component_at(mask, 40, 40).count() == 1 and R.component_at(mask, 50, 50).count() == 0


def test_polygon_predicates(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    f = spark.createDataFrame([("sq", ring)], "name string, ring array<struct<x:double,y:double>>")
    px = spark.createDataFrame([(2.0, 2.0), (0.5, 2.0), (5.0, 2.0)], "x double, y double")
    assert J.pixels_in_polygons(px, f, "x", "y").count() == 2 and J.pixels_in_polygons(px, f, "x", "y", 1.0).count() == 1
    assert f.select(J.ring_area(F.col("ring")).alias("a")).first().a == 16


def test_scalars(spark):
    r = spark.range(1).select(
        S.reflectance(F.lit(900), F.lit("05.00")).alias("r"), S.normalised_difference(F.lit(1.0), F.lit(-1.0)).alias("nd"), S.decibel(F.lit(0.0)).alias("db"), S.finite(F.lit(float("nan"))).alias("f"),
        S.normal_word(F.lit(" Winter Wheat ")).alias("w"), S.half_up_percent(F.lit(0.885)).alias("p"), S.season_of(F.lit("2024-11-01").cast("date")).alias("s"),
        S.map_code([F.lit(0.7), F.lit(0.2)], [1, 2], F.lit(9)).alias("m"), S.map_code([F.lit(0.5), F.lit(0.5)], [1, 2], F.lit(9)).alias("u"), S.map_code([F.lit(0.9), F.lit(0.1)], [1, 2], F.lit(7)).alias("z"),
    ).first()
    assert (r.r, r.nd, r.db, r.f, r.w, r.p, r.s, r.m, r.u, r.z) == (1e-4, None, None, None, "winter_wheat", 89, "rabi_2025", 1, 4, 0)
    assert S.bands_for(["ndvi", "evi"]) == ["B02", "B04", "B08"] and math.isclose(sum(W.savgol_weights(5, 0)), 1)


def test_files(spark, tmp_path):
    (tmp_path / "f.geojson").write_text('{"type":"FeatureCollection","features":[{"properties":{"name":"a","crop":"wheat"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}')
    f = io.read_geojson(spark, str(tmp_path / "f.geojson"), ["crop"])
    assert f.first().crop == "wheat" and '"Polygon"' in io.features(f).first().value
    io.write_csv(spark.createDataFrame([("a, \"b\"", 0.125)], "n string, v double"), str(tmp_path / "out"), {"v": 2})
    assert tuple(io.read_csv(spark, str(tmp_path / "out"), "n string, v double").first()) == ('a, "b"', 0.12)


def test_stream_windows(spark, tmp_path):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 1 + i), "a", float(i)) for i in range(12)], "t timestamp_ntz, k string, v double")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_means(s, "t", "k", "v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("w").agg(F.sum("n")).first()[0] == 12


def test_repeated_rows_are_kept_apart(spark):
    t = dt.datetime(2025, 1, 5)
    left = spark.createDataFrame([("a", t, {"k": 1}), ("a", t, {"k": 1}), ("a", t, {"k": 2})], "by string, t timestamp_ntz, m map<string,int>")
    right = spark.createDataFrame([("a", t, 7), ("a", t, 7)], "by string, t timestamp_ntz, v int")
    assert [r.r_v for r in J.asof_nearest(left, right, "by", "t", 60, ["v"]).collect()] == [7, 7, 7]
    ring = [(0.0, 0.0), (200.0, 0.0), (200.0, 200.0), (0.0, 200.0), (0.0, 0.0)]
    f = spark.createDataFrame([("sq", ring), ("zz", ring)], "name string, ring array<struct<x:double,y:double>>")
    px = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0), (150.0, 150.0), (-1.0, 3.0)], "x double, y double")
    assert [r["name"] for r in J.pixels_in_polygons(px, f, "x", "y").collect()] == ["zz"] * 3
    e = spark.createDataFrame([(1, 0, 0, [0.0]), (1, 0, 0, [0.1]), (2, 1, 1, [5.0]), (3, 0, 1, [0.2]), (4, 1, 0, [5.1])], "id int, label int, strip int, v array<double>")
    assert ml.centroid_predictions(e, "id", "label", "v", "strip").where("truth = pred").count() == 5


def test_models_on_parted_classes(spark):
    rng = np.random.default_rng(2)
    rows = [(i, i % 3, i % 4, (rng.normal(0, 0.3, 4) + np.eye(3, 4)[i % 3] * 4).tolist()) for i in range(96)]
    d = ml.vectors(spark.createDataFrame(rows, "id int, label int, strip int, v array<double>"), "v")
    for estimator in (ml.logistic(), ml.boosting(3), ml.perceptron([4, 6, 3])):
        p = ml.cross_validate(d, "label", "strip", estimator, [0, 1])
        assert p.where("truth = pred").count() > 0.9 * p.count()
    chosen = ml.nested_cross_validate(d, "label", "strip", {"strong": ml.logistic(1e-6), "weak": ml.logistic(10.0)}, [0, 1, 2])
    assert chosen.where("truth = pred").count() > 0.9 * chosen.count()
    assert {r.feature for r in ml.importance(d, "label", ml.forest(10)).limit(3).collect()} == {"f0", "f1", "f2"}
    assert {r.training for r in ml.label_ablation(d, "label", "strip", ml.logistic(), [0, 1], F.col("id") % 2 == 0).collect()} == {"all", "sure"}
    assert ml.parameter_count([16, 64, 64, 3]) == 5443
