"""Scenes and passes: search, windows, blocks, masks and their summaries, all over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.operators.joins import best_per_group


def search(scenes: DataFrame, box: tuple[float, float, float, float], start: str, stop: str, max_cloud: float) -> DataFrame:
    """The least cloudy scene of each day whose box (x0, y0, x1, y1) meets `box`, from start to stop (days, both in), below max_cloud; the least id on ties."""
    x0, y0, x1, y1 = box
    day = F.to_date("ts")
    hit = scenes.where((F.col("cloud") < max_cloud) & day.between(F.lit(start).cast("date"), F.lit(stop).cast("date")))
    hit = hit.where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    return best_per_group(hit, [day], [F.col("cloud"), F.col("id")])


def passes(scenes: DataFrame, orbit_state: str, relative_orbit: int) -> DataFrame:
    """The passes of one direction and track, with their number in time."""
    own = scenes.where((F.col("orbit_state") == orbit_state) & (F.col("relative_orbit") == relative_orbit))
    return own.withColumn("number", F.row_number().over(Window.partitionBy("orbit_state", "relative_orbit").orderBy("ts", "id")))


def windows_read(pixels: DataFrame, windows: DataFrame, tile: int = 16) -> DataFrame:
    """Pixels (r, c, ...) of each window (name, r0, c0, r1, c1), ends in, over an equi-join on tiles that a window spans."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile))
    w = windows.withColumn("_tr", F.explode(span("r0", "r1"))).withColumn("_tc", F.explode(span("c0", "c1")))
    p = pixels.withColumn("_tr", F.floor(F.col("r") / tile)).withColumn("_tc", F.floor(F.col("c") / tile))
    return p.join(w, ["_tr", "_tc"]).where(F.col("r").between(F.col("r0"), F.col("r1")) & F.col("c").between(F.col("c0"), F.col("c1"))).select("name", *pixels.columns)


def solar_day(ts: Column, lon: Column) -> Column:
    """The day at the place: four minutes a degree from Greenwich."""
    return F.to_date(ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (lon * 240).cast("decimal(18,6)")))


def with_halo(pixels: DataFrame, size: int, halo: int, rows: int, cols: int) -> DataFrame:
    """Pixels with their block (br, bc), and once more for each further block whose margin of `halo` cells they lie in."""
    last = lambda n: (n - 1) // size
    near = lambda c, n: F.sequence(F.greatest(F.floor((F.col(c) - halo) / size), F.lit(0)).cast("int"), F.least(F.floor((F.col(c) + halo) / size), F.lit(last(n))).cast("int"))
    out = pixels.withColumn("br", F.explode(near("r", rows))).withColumn("bc", F.explode(near("c", cols)))
    inside = (F.floor(F.col("r") / size) == F.col("br")) & (F.floor(F.col("c") / size) == F.col("bc"))
    return out.withColumn("is_halo", ~inside)


def resampled(grid: DataFrame, value: str, factor: int) -> DataFrame:
    """Means over factor x factor cells; what is missing doesn't count."""
    at = lambda c: F.floor(F.col(c) / factor).cast("int").alias(c)
    return grid.groupBy(at("r"), at("c")).agg(F.avg(value).alias(value))


def clearest_scene(scenes: DataFrame, start: str, stop: str) -> DataFrame:
    """The one scene with the least cloud from start to stop; the least id on ties."""
    return scenes.where(F.to_date("ts").between(F.lit(start).cast("date"), F.lit(stop).cast("date"))).orderBy("cloud", "id").limit(1)


def optical_water(green: Column, nir: Column, clear: Column) -> Column:
    """Whether a clear pixel is water by the sign of its index; null elsewhere."""
    return F.when(clear & ((green + nir) != 0), green > nir)


def older_than(scenes: DataFrame, baseline: str = "04.00") -> DataFrame:
    """Scenes of an older processing baseline: a plausibility query that should be empty."""
    return scenes.where(F.col("baseline") < baseline)


def bad_days(flags: DataFrame, day: str, flagged: Column, any_one: bool = False) -> DataFrame:
    """Days on which all observations are flagged, or with any_one at least one."""
    rule = F.bool_or(flagged) if any_one else F.bool_and(flagged)
    return flags.groupBy(day).agg(rule.alias("_bad")).where("_bad").select(day)


def monthly_best(scenes: DataFrame, bad: DataFrame, day: str) -> DataFrame:
    """The least cloudy scene of each month, the earliest on ties, days of `bad` left out."""
    left = scenes.join(bad, day, "left_anti")
    return best_per_group(left, [F.year(day), F.month(day)], [F.col("cloud"), F.col(day), F.col("id")])


def full_passes(cube: DataFrame, day: str, value: str, least: float = 0.9) -> DataFrame:
    """(day, share) of the days that more than `least` of the cells are measured on."""
    return cube.groupBy(day).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("share")).where(F.col("share") > least)


def nearest_day(days: DataFrame, day: str, to: str) -> DataFrame:
    """The one day nearest to a date, the earlier of two."""
    return days.select(day).distinct().orderBy(F.abs(F.datediff(day, F.lit(to).cast("date"))), day).limit(1)


def peak_day(cube: DataFrame, day: str, value: str) -> DataFrame:
    """(day, median) of the day with the least median, the first on ties."""
    return cube.groupBy(day).agg(F.median(value).alias("median")).orderBy("median", day).limit(1)


def masked_stats(cube: DataFrame, owners: DataFrame, day: str, value: str, least: int = 3, least_share: float = 0.8) -> DataFrame:
    """(name, day, n, mean): over the cells (r, c, name) of each field that are measured that day, if at least `least` and least_share of them are."""
    size = owners.groupBy("name").agg(F.count("*").alias("size"))
    n = cube.where(F.col(value).isNotNull()).join(owners, ["r", "c"]).groupBy("name", day).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return n.join(F.broadcast(size), "name").where(F.col("n") >= F.greatest(F.lit(float(least)), least_share * F.col("size"))).drop("size")


def monthly_wide(df: DataFrame, key: str, day: str, values: list[str], months: list[int]) -> DataFrame:
    """One row an entity, one column <value>_<month> with the month's mean."""
    out = df.groupBy(key).agg(*(F.avg(F.when(F.month(day) == m, F.col(v))).alias(f"{v}_{m}") for v in values for m in months))
    return out


def water_agreement(df: DataFrame, optical: str, radar: str) -> DataFrame:
    """(n, optical_share, radar_share, agreement, found, confirmed) over cells that both measure; found: of optical water, confirmed: of radar water."""
    o, r = F.col(optical), F.col(radar)
    share = lambda c: F.avg(c.cast("double"))
    both = df.where(o.isNotNull() & r.isNotNull())
    return both.agg(F.count("*").alias("n"), share(o).alias("optical_share"), share(r).alias("radar_share"), share(o == r).alias("agreement"), share(F.when(o, r)).alias("found"), share(F.when(r, o)).alias("confirmed"))


def clearest_days(df: DataFrame, day: str, entity: str, ok: Column, haze: str) -> DataFrame:
    """(clearest, latest): of the days on which every entity is seen and ok, the one with the least greatest haze, and the last."""
    n = df.agg(F.countDistinct(entity).alias("_all"))
    per = df.groupBy(day).agg(F.countDistinct(entity).alias("_n"), F.bool_and(ok).alias("_ok"), F.max(haze).alias("_haze"))
    good = per.join(F.broadcast(n), how="cross").where("_ok and _n = _all")
    return good.agg(F.min_by(day, F.struct("_haze", day)).alias("clearest"), F.max(day).alias("latest"))


def points_in_cells(cells: DataFrame, size: float, salt: str = "0") -> DataFrame:
    """Cells (r, c) with one point (x, y) each, spread evenly by a hash of the cell."""
    u = lambda axis: F.conv(F.substr(F.md5(F.concat_ws(":", "r", "c", F.lit(axis), F.lit(salt))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0
    return cells.select("r", "c", ((F.col("c") + u("x")) * size).alias("x"), ((F.col("r") + u("y")) * size).alias("y"))


def centre_and_bounds(points: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """(by, n, cx, cy, x0, y0, x1, y1) of each group of points."""
    return points.groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("cx"), F.avg(y).alias("cy"), F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def edge_retry(attempts: DataFrame, small: float, near: float) -> DataFrame:
    """Of the fields grown from a point (dx = dy = 0) and from places round it, the one to take.

    attempts: (point, dx, dy, area, clean, distance of the field to the point). The
    field at the point stays if it is as large as `small`; else the largest clean
    one that comes as near as `near`, the least shift on ties, if there is one.
    """
    home = (F.col("dx") == 0) & (F.col("dy") == 0)
    a = attempts.withColumn("_large", F.max(F.when(home, F.col("area") >= small)).over(Window.partitionBy("point")))
    fits = ~home & ~F.coalesce("_large", F.lit(False)) & F.col("clean") & (F.col("distance") <= near)
    rank = [F.when(fits, 0).otherwise(1), F.when(fits, -F.col("area")), F.hypot("dx", "dy"), F.col("dx"), F.col("dy")]
    return best_per_group(a.where(fits | home), [F.col("point")], rank).drop("_large")
