"""Rasters as rows (r, c, value): neighbourhoods by shifted equi-joins, never by a scan of the whole grid in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage


def _offsets(p: int) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(i).alias("dr"), F.lit(j).alias("dc")) for i in range(-p, p + 1) for j in range(-p, p + 1))))


def neighbours(grid: DataFrame, value: str, p: int = 1, edge: str = "none", rows: int = 0, cols: int = 0) -> DataFrame:
    """(r, c, v): a row for each cell and cell of its (2p+1)² window. edge: none leaves the outside out, replicate takes the nearest cell."""
    at = grid.select("r", "c", _offsets(p).alias("o")).select("r", "c", (F.col("r") + F.col("o.dr")).alias("nr"), (F.col("c") + F.col("o.dc")).alias("nc"))
    if edge == "replicate":
        at = at.withColumn("nr", F.least(F.greatest("nr", F.lit(0)), F.lit(rows - 1))).withColumn("nc", F.least(F.greatest("nc", F.lit(0)), F.lit(cols - 1)))
    v = grid.select(F.col("r").alias("nr"), F.col("c").alias("nc"), F.col(value).alias("v"))
    return at.join(v, ["nr", "nc"]).select("r", "c", "v")


def focal_mean(grid: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    return neighbours(grid, value, 1, "replicate", rows, cols).groupBy("r", "c").agg(F.avg("v").alias("mean"))


def focal_median(grid: DataFrame, value: str, rows: int, cols: int) -> DataFrame:
    """3x3 median where a value is; gaps count as the median of all values and stay gaps."""
    med = grid.agg(F.median(value).alias("m"))
    full = grid.join(F.broadcast(med), how="cross").withColumn("_f", F.coalesce(value, "m"))
    out = neighbours(full, "_f", 1, "replicate", rows, cols).groupBy("r", "c").agg(F.median("v").alias("median"))
    return out.join(grid.where(F.col(value).isNotNull()).select("r", "c"), ["r", "c"], "left_semi")


def dilate(mask: DataFrame, p: int, rows: int, cols: int) -> DataFrame:
    """Cells (r, c) within p of a cell of mask, inside the grid; p <= 0 leaves it."""
    if p <= 0:
        return mask.select("r", "c")
    out = mask.select("r", "c", _offsets(p).alias("o")).select((F.col("r") + F.col("o.dr")).alias("r"), (F.col("c") + F.col("o.dc")).alias("c"))
    return out.where(F.col("r").between(0, rows - 1) & F.col("c").between(0, cols - 1)).distinct()


def opening(mask: DataFrame, rows: int, cols: int) -> DataFrame:
    """Erosion by 3x3, then dilation."""
    m = mask.select("r", "c").withColumn("one", F.lit(1))
    core = neighbours(m, "one").groupBy("r", "c").agg(F.count("*").alias("n")).where("n = 9")
    return dilate(core, 1, rows, cols)


def speckle(grid: DataFrame, code: str) -> DataFrame:
    """(share): of cells that differ from the most frequent code of their 3x3 window, the least on ties."""
    n = neighbours(grid, code).groupBy("r", "c", "v").agg(F.count("*").alias("k"))
    top = n.groupBy("r", "c").agg(F.max(F.struct("k", (-F.col("v")).alias("m"))).alias("t")).select("r", "c", (-F.col("t.m")).alias("top"))
    return grid.join(top, ["r", "c"]).agg(F.avg((F.col(code) != F.col("top")).cast("double")).alias("share"))


def component_at(mask: DataFrame, row: int, col: int) -> DataFrame:
    """Cells of mask that are 4-connected to a seed; none where the seed is not in mask. However long the way to them is."""
    from granary.operators.geometry import components

    parts = stage(components(mask.select("r", "c").distinct()), "components")
    return parts.join(F.broadcast(parts.where((F.col("r") == row) & (F.col("c") == col)).select("component")), "component", "left_semi").select("r", "c")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(iou) of two cell sets."""
    both = a.select("r", "c").distinct().withColumn("a", F.lit(1)).join(b.select("r", "c").distinct().withColumn("b", F.lit(1)), ["r", "c"], "full")
    return both.agg((F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)) / F.count("*")).alias("iou"))


def overlap_curve(grid: DataFrame, value: str, inside: str, thresholds: list[float]) -> DataFrame:
    """(threshold, iou) of the cells above each threshold with those inside, in one pass over the grid."""
    at = grid.select(F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"), F.col(value).alias("v"), F.col(inside).alias("i"))
    a, b = F.col("v") > F.col("threshold"), F.col("i")
    return at.groupBy("threshold").agg(F.try_divide(F.count_if(a & b), F.count_if(a | b)).alias("iou"))


def flood(cube: DataFrame, value: str, reference: DataFrame, threshold: float, drop: float = 3.0) -> DataFrame:
    """cube (r, c, day, value) with water, flooded and dark_before, against a reference (r, c, ref)."""
    d = cube.join(reference, ["r", "c"])
    x, ref = F.col(value), F.col("ref")
    return d.select(*cube.columns, "ref", (x < threshold).alias("water"), ((x < threshold) & (x < ref - drop)).alias("flooded"), (ref < threshold).alias("dark_before"))
