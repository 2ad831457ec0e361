"""Joins that equality alone does not express, each turned into an equi-join first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.graph import connected_components
from granary.plans.staging import stage, unstage

#: Pairs of places that proximity groups join at once where boxes leave no more.
DIRECT = 1 << 20


def asof_nearest(left: DataFrame, right: DataFrame, by: str, time: str, tolerance_s: int, right_cols: list[str]) -> DataFrame:
    """For each left row the right row of the same entity that is nearest in time, at most tolerance_s seconds away; the earlier of two at one distance.

    Times are cut into cells of the tolerance: a left row meets the right rows of
    its own and the two neighbouring cells, so no entity's rows are all paired.
    Left rows that repeat are counted first and come out as often as they came;
    those without a right row near enough are left out. Columns of any type pass.
    """
    cell = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (tolerance_s * 1_000_000)).cast("long")
    once = left.groupBy(F.to_json(F.struct(*left.columns)).alias("_key")).agg(F.first(F.struct(*left.columns)).alias("_row"), F.count("*").cast("int").alias("_times"))
    l = once.select("_key", "_row", "_times", F.col(f"_row.{by}").alias("_lby"), F.col(f"_row.{time}").alias("_lt")).withColumn("_cell", F.explode(F.array(*(cell("_lt") + d for d in (-1, 0, 1)))))
    r = right.select(F.col(by).alias("_by"), F.col(time).alias("_t"), *(F.col(c).alias(f"r_{c}") for c in right_cols), cell(time).alias("_c"))
    gap = F.abs(F.unix_micros(F.col("_lt").cast("timestamp")) - F.unix_micros(F.col("_t").cast("timestamp")))
    met = l.join(r, (F.col("_lby") == F.col("_by")) & (F.col("_cell") == F.col("_c"))).where(gap <= tolerance_s * 1_000_000)
    best = met.groupBy("_key").agg(F.first("_row").alias("_row"), F.first("_times").alias("_times"), F.min(F.struct(gap.alias("gap"), F.col("_t").alias("r_time"), *(f"r_{c}" for c in right_cols))).alias("b"))
    return best.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*", F.col("b.r_time").alias("r_time"), *(F.col(f"b.r_{c}") for c in right_cols))


def near_pairs(points: DataFrame, id_col: str, x: str, y: str, limit: float) -> DataFrame:
    """(src, dst) of points at most limit apart: a grid of that cell size, neighbouring cells joined."""
    cx, cy = F.floor(F.col(x) / limit).cast("long"), F.floor(F.col(y) / limit).cast("long")
    a = points.select(F.col(id_col).alias("src"), F.col(x).alias("ax"), F.col(y).alias("ay"), cx.alias("cx"), cy.alias("cy"))
    b = points.select(F.col(id_col).alias("dst"), F.col(x).alias("bx"), F.col(y).alias("by"), F.explode(F.array(*(F.struct((cx + i).alias("i"), (cy + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("c"))
    met = a.join(b, (F.col("cx") == F.col("c.i")) & (F.col("cy") == F.col("c.j")) & (F.col("src") < F.col("dst")))
    return met.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= limit).select("src", "dst")


def _boxes(spots: DataFrame, side: float, *more: Column) -> DataFrame:
    """(i, j, x0, x1, y0, y1, n) and more aggregates: the box round the n spots of each cell of a grid."""
    cell = lambda c: F.floor(F.col(c) / side).cast("long")
    return spots.groupBy(cell("x").alias("i"), cell("y").alias("j")).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"), *more)


def _within(pairs: DataFrame, limit: float) -> DataFrame:
    """pairs of boxes a and b that have points at most limit apart, perhaps; `sure` where all their points are."""
    gap = lambda c: F.greatest(F.lit(0.0), F.col(f"b.{c}0") - F.col(f"a.{c}1"), F.col(f"a.{c}0") - F.col(f"b.{c}1"))
    span = lambda c: F.greatest(F.col(f"b.{c}1") - F.col(f"a.{c}0"), F.col(f"a.{c}1") - F.col(f"b.{c}0"))
    return pairs.where(F.hypot(gap("x"), gap("y")) <= limit).withColumn("sure", F.hypot(span("x"), span("y")) <= limit)


def linked_cells(spots: DataFrame, cells: DataFrame, side: float, limit: float, depth: int = 10) -> list[DataFrame]:
    """(src, dst) tables of the cells' reps: pairs of cells of which two spots are at most limit apart.

    Boxes round the spots settle most pairs; the cells of the others are cut in
    quarters, and the quarters again, as long as a pair is not linked and boxes
    are left that neither lie within limit nor beyond. The spots of what is left
    are joined as soon as they make DIRECT pairs at most, and after `depth` cuts,
    when the boxes' sides are about a thousandth of limit.
    """
    box = lambda: F.struct("i", "j", "x0", "x1", "y0", "y1", "n")
    steps = [(di, dj) for di in range(3) for dj in range(-2, 3) if di or dj > 0]
    a = cells.select(F.col("rep").alias("src"), box().alias("a"), F.col("i").alias("ci"), F.col("j").alias("cj"))
    b = cells.select(F.col("rep").alias("dst"), box().alias("b"), F.explode(F.array(*(F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")) for di, dj in steps))).alias("c"))
    found, met = [], stage(_within(a.join(b, (F.col("ci") == F.col("c.i")) & (F.col("cj") == F.col("c.j"))), limit).select("src", "dst", "a", "b", "sure"), "near-cells")
    for level in range(1, depth + 1):
        found.append(stage(met.where("sure").select("src", "dst").distinct(), "cell-links"))
        left = stage(met.where("not sure").join(found[-1], ["src", "dst"], "left_anti").select("src", "dst", *(F.col(f"{c}.{k}").alias(f"{c}{k}") for c in "ab" for k in "ijn")), "open-cells")
        unstage(met)
        pairs = left.agg(F.sum(F.col("an").cast("double") * F.col("bn"))).first()[0]
        if pairs is None:
            return found
        up = side / 2 ** (level - 1)
        asked = left.select(F.col("ai").alias("i"), F.col("aj").alias("j")).union(left.select("bi", "bj")).distinct()
        inner = spots.withColumn("i", F.floor(F.col("x") / up).cast("long")).withColumn("j", F.floor(F.col("y") / up).cast("long")).join(asked, ["i", "j"])
        if level == depth or pairs <= DIRECT:
            one = lambda c: inner.select(F.col("i").alias(f"{c}i"), F.col("j").alias(f"{c}j"), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"))
            last = left.join(one("a"), ["ai", "aj"]).join(one("b"), ["bi", "bj"]).where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) <= limit)
            found.append(stage(last.select("src", "dst").distinct(), "cell-links"))
            return found
        parts = stage(_boxes(inner.select("x", "y"), up / 2).select(F.shiftright("i", 1).alias("pi"), F.shiftright("j", 1).alias("pj"), box().alias("box")), "quarters")
        of = lambda c: parts.select(F.col("pi").alias(f"{c}i"), F.col("pj").alias(f"{c}j"), F.col("box").alias(c))
        met = stage(_within(left.drop("an", "bn").join(of("a"), ["ai", "aj"]).join(of("b"), ["bi", "bj"]), limit).select("src", "dst", "a", "b", "sure"), "near-cells")
        unstage(left, parts)
    return found


def proximity_groups(points: DataFrame, id_col: str, x: str, y: str, limit: float) -> DataFrame:
    """(id, component): groups of points linked by distances of at most limit; a lone point is its own.

    Points fall into cells so small that all of one are linked, and it is decided
    for cells, not for points, which of them are: equal points are one, and no
    pairs of points are made where they lie close. Distances are near_pairs's.
    Rows that share an id are one point in several places; null ids, and null or
    non-finite places, link with nothing. Coordinates are taken as doubles, up to
    10^12 times limit.
    """
    side = 0.7 * limit
    ok = F.col(id_col).isNotNull() & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    placed = points.where(ok).select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    spots = stage(placed.groupBy("x", "y").agg(F.min("id").alias("id")), "spots")
    cells = stage(_boxes(spots, side, F.min("id").alias("rep")), "cells")
    found = linked_cells(spots, cells, side, limit)
    rep = cells.select("i", "j", "rep")
    of_id = placed.select("id", F.floor(F.col("x") / side).cast("long").alias("i"), F.floor(F.col("y") / side).cast("long").alias("j"))
    several = of_id.groupBy("id").agg(F.min(F.struct("i", "j")).alias("lo"), F.max(F.struct("i", "j")).alias("hi")).where("lo <> hi").select("id")
    edges = of_id.join(several, "id").join(rep, ["i", "j"]).select(F.col("id").alias("src"), F.col("rep").alias("dst"))
    for links in found:
        edges = edges.union(links)
    parts = connected_components(edges)
    of_cell = stage(rep.join(parts, F.col("rep") == F.col("node"), "left").select("i", "j", F.coalesce("component", "rep").alias("component")), "of-cell")
    of_id = of_id.join(of_cell, ["i", "j"]).select(F.col("id").alias("node"), "component").distinct()
    return points.join(of_id, F.col(id_col) == F.col("node"), "left").select(id_col, F.coalesce("component", id_col).alias("component"))


def crossing_inside(px: Column, py: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring (array of struct x, y), by counting the edges to its right."""
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    hit = lambda e: ((e["a"]["y"] > py) != (e["b"]["y"] > py)) & (px < e["a"]["x"] + (py - e["a"]["y"]) * F.try_divide(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    return F.size(F.filter(edges, lambda e: F.coalesce(hit(e), F.lit(False)))) % 2 == 1


def edge_distance(px: Column, py: Column, ring: Column) -> Column:
    """Least distance of a point to the edges of a closed ring."""
    edges = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    def one(e):
        dx, dy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((px - e["a"]["x"]) * dx + (py - e["a"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        return F.hypot(px - e["a"]["x"] - t * dx, py - e["a"]["y"] - t * dy)

    return F.array_min(F.transform(edges, one))


def pixels_in_polygons(pixels: DataFrame, fields: DataFrame, x: str, y: str, buffer: float = 0.0, tile: float = 64.0) -> DataFrame:
    """(pixel columns, name) of the centres inside a polygon and more than buffer from its edge; of overlapping fields the last by name wins.

    Fields are gathered by the tiles that their boxes meet, and a pixel looks
    only at the fields of its tile: one equi-join, and each pixel row is kept
    apart however often it repeats. A tile should hold some tens of fields.
    """
    span = lambda axis: F.transform("ring", lambda p: F.floor(p[axis] / tile))
    f = fields.where(F.size("ring") > 0).select("name", "ring", F.explode(F.sequence(F.array_min(span("x")), F.array_max(span("x")))).alias("_tx"), span("y").alias("_ys"))
    f = f.select("name", "ring", "_tx", F.explode(F.sequence(F.array_min("_ys"), F.array_max("_ys"))).alias("_ty"))
    of_tile = f.groupBy("_tx", "_ty").agg(F.collect_list(F.struct("name", "ring")).alias("_fields"))
    met = pixels.withColumn("_tx", F.floor(F.col(x) / tile)).withColumn("_ty", F.floor(F.col(y) / tile)).join(of_tile, ["_tx", "_ty"])

    def holds(field: Column) -> Column:
        inside = crossing_inside(F.col(x), F.col(y), field["ring"])
        return inside & (edge_distance(F.col(x), F.col(y), field["ring"]) > buffer) if buffer > 0 else inside

    met = met.withColumn("name", F.array_max(F.transform(F.filter("_fields", holds), lambda field: field["name"])))
    return met.where(F.col("name").isNotNull()).select(*pixels.columns, "name")


def ring_area(ring: Column) -> Column:
    """Area of a closed ring by the shoelace sum."""
    two = F.zip_with(F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(two, F.lit(0.0), lambda s, v: s + v)) / 2.0


def label_merge(base: DataFrame, key: str, target: str, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """base with target, target_source: each source (name, (key, value)) in order of precedence fills what is still empty; nothing is overwritten."""
    out = base.withColumn("_have", F.nullif(F.col(target), F.lit(""))).withColumn(f"{target}_source", F.when(F.col("_have").isNotNull(), F.lit("given")))
    for i, (name, df) in enumerate(sources):
        s = df.groupBy(key).agg(F.max(F.nullif("value", F.lit(""))).alias(f"_v{i}"))
        out = out.join(s, key, "left")
        out = out.withColumn(f"{target}_source", F.when(F.col("_have").isNull() & F.col(f"_v{i}").isNotNull(), F.lit(name)).otherwise(F.col(f"{target}_source")))
        out = out.withColumn("_have", F.coalesce("_have", f"_v{i}")).drop(f"_v{i}")
    return out.withColumn(target, F.coalesce("_have", F.lit(""))).drop("_have")


def unmatched(right: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """Rows of right that no row of left takes: a plausibility query that should be empty."""
    return right.join(left.select(key).distinct(), key, "left_anti")


def best_per_group(df: DataFrame, group: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each group."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_rn = 1").drop("_rn")
