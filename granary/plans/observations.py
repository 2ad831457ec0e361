"""Further queries: scenes and passes, preparation for models, summaries and text rows. They register with the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.operators import geometry as G
from granary.operators import joins as J
from granary.operators import ml
from granary.operators import prepare as M
from granary.operators import raster as R
from granary.operators import sampling as P
from granary.operators import scenes as C
from granary.operators import series as W
from granary.plans.catalogue import _CELLS, _DAILY, _NEAR, cells, daily, query, table

_SCENES = """scenes as (select o_orderkey as id, o_orderdate as ts, cast(o_orderdate as date) as day, o_totalprice / 5000 as cloud, cast(o_custkey % 100 as double) as x0, cast(o_custkey % 100 as double) + 20 as x1, cast(o_orderkey % 100 as double) as y0, cast(o_orderkey % 100 as double) + 20 as y1,
  case when o_orderstatus = 'F' then 'ascending' else 'descending' end as orbit_state, cast(o_custkey % 7 as integer) as relative_orbit, case when o_orderkey % 9 = 0 then '03.01' else '05.09' end as baseline from orders)"""


def scenes(spark, sf):
    """orders as scenes."""
    x, y = (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 100).cast("double")
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("ts"), F.to_date("o_orderdate").alias("day"), (F.col("o_totalprice") / 5000).alias("cloud"), x.alias("x0"), (x + 20).alias("x1"), y.alias("y0"), (y + 20).alias("y1"),
        F.when(F.col("o_orderstatus") == "F", "ascending").otherwise("descending").alias("orbit_state"), (F.col("o_custkey") % 7).cast("int").alias("relative_orbit"), F.when(F.col("o_orderkey") % 9 == 0, "03.01").otherwise("05.09").alias("baseline"),
    )


@query(f"""with {_SCENES}, h as (select *, row_number() over (partition by day order by cloud, id) as n from scenes where cloud < 60 and day between date '1996-01-01' and date '1998-12-31' and x0 <= 40 and x1 >= 30 and y0 <= 40 and y1 >= 30)
  select id, day, round(cloud, 6) as cloud from h where n = 1""")
def scene_search(spark, sf):
    return C.search(scenes(spark, sf), (30, 30, 40, 40), "1996-01-01", "1998-12-31", 60).select("id", "day", F.round("cloud", 6).alias("cloud"))


@query(f"with {_SCENES} select id, day, cast(row_number() over (order by ts, id) as integer) as number from scenes where orbit_state = 'ascending' and relative_orbit = 3")
def radar_passes(spark, sf):
    return C.passes(scenes(spark, sf), "ascending", 3).select("id", "day", "number")


@query(f"""with {_SCENES}, n as (select relative_orbit, count(*) as n, min(ts) as first from scenes group by 1 order by n desc, first limit 1) select id, relative_orbit from scenes where relative_orbit = (select relative_orbit from n)""")
def dominant_orbit(spark, sf):
    from granary.sources.io import dominant_orbit as dominant

    return dominant(scenes(spark, sf)).select("id", "relative_orbit")


@query(f"""with {_CELLS}, w(name, r0, c0, r1, c1) as (values ('a', 0, 0, 15, 15), ('b', 10, 12, 29, 33), ('c', 14, 14, 17, 17)) select name, r, c, v from w join cells on r between r0 and r1 and c between c0 and c1""")
def windows_read(spark, sf):
    w = spark.createDataFrame([("a", 0, 0, 15, 15), ("b", 10, 12, 29, 33), ("c", 14, 14, 17, 17)], "name string, r0 int, c0 int, r1 int, c1 int")
    return C.windows_read(cells(spark, sf), w)


@query("""with e as (select *, cast(ts + to_microseconds(cast((user_id % 360 - 180) * 240 as bigint) * 1000000) as date) as day from events) select user_id, day, arg_min(event_id, struct_pack(ts := ts, id := event_id)) as first_event, count(*) as n from e group by 1, 2""")
def solar_days(spark, sf):
    e = table(spark, sf, "events").withColumn("day", C.solar_day(F.col("ts"), F.col("user_id") % 360 - 180))
    return e.groupBy("user_id", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first_event"), F.count("*").alias("n"))


@query(f"""with {_CELLS}, b as (select range as b from range(3)) select r, c, v, cast(x.b as integer) as br, cast(y.b as integer) as bc, not (r // 16 = x.b and c // 16 = y.b) as is_halo
  from cells, b x, b y where r between x.b * 16 - 2 and x.b * 16 + 17 and c between y.b * 16 - 2 and y.b * 16 + 17""")
def blocks_with_halo(spark, sf):
    return C.with_halo(cells(spark, sf), 16, 2, 40, 40).select("r", "c", "v", "br", "bc", "is_halo")


@query(f"with {_CELLS} select cast(r // 2 as integer) as r, cast(c // 2 as integer) as c, round(avg(v), 4) as v from cells group by 1, 2".replace("group by 1, 2\"", "group by 1, 2\"").replace("from cells group by 1, 2", "from cells group by cells.r // 2, cells.c // 2"))
def resample_mean(spark, sf):
    return C.resampled(cells(spark, sf), "v", 2).withColumn("v", F.round("v", 4))


@query(f"""with {_SCENES}, s as (select id from scenes where day between date '1997-03-01' and date '1997-06-30' order by cloud, id limit 1)
  select l_linenumber, l_orderkey, coalesce(cast(case when l_linenumber in (4, 5, 6) and l_quantity + l_tax * 500 <> 0 then l_quantity > l_tax * 500 end as integer), -1) as water from lineitem join s on l_orderkey % 50 = s.id % 50""")
def optical_water(spark, sf):
    best = C.clearest_scene(scenes(spark, sf), "1997-03-01", "1997-06-30").select((F.col("id") % 50).alias("scene"))
    px = table(spark, sf, "lineitem").withColumn("scene", F.col("l_orderkey") % 50).join(F.broadcast(best), "scene")
    return px.select("l_linenumber", "l_orderkey", F.coalesce(C.optical_water(F.col("l_quantity"), F.col("l_tax") * 500, F.col("l_linenumber").isin(4, 5, 6)).cast("int"), F.lit(-1)).alias("water"))


@query("""with b(band, wavelength_nm, gsd_m) as (values ('B02', 490, 10), ('B04', 665, 10), ('B08', 842, 10)) select l_orderkey, l_linenumber, band, wavelength_nm, gsd_m, case band when 'B02' then l_discount when 'B04' then l_tax else l_quantity end as value,
  case when l_linenumber = 4 then 'vegetation' when l_linenumber = 5 then 'bare soil' when l_linenumber = 6 then 'water' else 'unknown' end as scl from lineitem, b""")
def point_samples(spark, sf):
    bands = spark.createDataFrame([("B02", 490, 10), ("B04", 665, 10), ("B08", 842, 10)], "band string, wavelength_nm int, gsd_m int")
    px = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("B02"), F.col("l_tax").alias("B04"), F.col("l_quantity").alias("B08"), S.recode(F.col("l_linenumber").cast("string"), {"4": "vegetation", "5": "bare soil", "6": "water"}, "unknown").alias("scl"))
    return px.unpivot(["l_orderkey", "l_linenumber", "scl"], ["B02", "B04", "B08"], "band", "value").join(F.broadcast(bands), "band")


@query(f"with {_SCENES} select baseline, count(*) as n from scenes where baseline < '04.00' group by 1")
def baseline_guard(spark, sf):
    return C.older_than(scenes(spark, sf)).groupBy("baseline").agg(F.count("*").alias("n"))


_NORMAL = "round(case when {0} + {1} <> 0 then ({0} - {1}) / ({0} + {1}) end, 6)"


@query(f"""select l_orderkey, l_linenumber, {_NORMAL.format("l_quantity", "l_tax")} as ndwi, {_NORMAL.format("l_discount", "l_tax")} as ndmi, {_NORMAL.format("l_discount", "l_quantity")} as ndre,
  round(case when l_tax > 0 and l_discount > 0 then 10 * log10(l_discount / l_tax) end, 6) as ratio_db, round(case when l_tax + l_discount <> 0 then 4 * l_discount / (l_tax + l_discount) end, 6) as rvi, case when l_tax > 0 then round(l_quantity / l_tax, 6) end as finite,
  case when l_returnflag = 'R' then 'R' else 'not_R' end as binary, lower(l_returnflag) || '_' || lower(l_linestatus) as word,
  cast(case when l_quantity < 8 then 0 when greatest(l_discount * 10, l_tax * 10) < 0.6 then 4 when l_discount >= l_tax then 1 else 2 end as integer) as code from lineitem""")
def more_indices(spark, sf):
    li = table(spark, sf, "lineitem")
    q, t, d = F.col("l_quantity"), F.col("l_tax"), F.col("l_discount")
    b = {"B03": q, "B08": t, "B8A": d, "B11": t, "B05": q}
    ratio, rvi = S.radar_ratios(t, d)
    r6 = lambda c: F.round(c, 6)
    return li.select(
        "l_orderkey", "l_linenumber", r6(S.index("NDWI", b)).alias("ndwi"), r6(S.index("NDMI", b)).alias("ndmi"), r6(S.index("NDRE", b)).alias("ndre"), r6(ratio).alias("ratio_db"), r6(rvi).alias("rvi"),
        r6(S.finite(F.when(t == 0, float("inf")).otherwise(F.try_divide(q, t)))).alias("finite"), M.two_classes(F.col("l_returnflag"), "R").alias("binary"), S.normal_word(F.concat_ws(" ", "l_returnflag", "l_linestatus")).alias("word"),
        S.map_code([d * 10, t * 10], [1, 2], q).alias("code"),
    )


_SCL = "(r * 7 + c * 3) % 12"


@query(f"""with {_CELLS}, {_NEAR}, k as (select r, c, v, {_SCL} as scl from cells), cloud as (select distinct k.r + dr as r, k.c + dc as c from k cross join o where scl in (3, 8))
  select k.r, k.c, scl in (4, 5, 6) and cloud.r is null and v > 40000 as clear from k left join cloud on k.r = cloud.r and k.c = cloud.c""")
def clear_pixels(spark, sf):
    g = cells(spark, sf).withColumn("scl", (F.col("r") * 7 + F.col("c") * 3) % 12)
    grown = R.dilate(g.where(F.col("scl").isin(3, 8)), 1, 40, 40).withColumn("near", F.lit(True))
    return g.join(grown, ["r", "c"], "left").select("r", "c", S.clear(F.col("scl"), F.coalesce("near", F.lit(False)), [F.col("v") - 40000]).alias("clear"))


@query(f"""with {_DAILY}, l as (select user_id, day, case when v > 0.05 then v end as v from daily), u as (select count(distinct user_id) as n from l), h as (select * from l where v is not null),
  names as (select day from h, u group by day, u.n having count(*) >= u.n * 0.5 - 1e-9), h2 as (select h.* from h join names using (day)), keys as (select user_id from h2 group by 1 having count(*) >= (select count(*) from names) * 0.8 - 1e-9),
  h3 as (select h2.* from h2 join keys using (user_id)) select user_id, day, round(v, 6) as v from h3 where day in (select day from h3 group by 1 having count(*) = (select count(*) from keys))""")
def complete_matrix(spark, sf):
    d = daily(spark, sf).withColumn("v", F.when(F.col("v") > 0.05, F.col("v")))
    return M.complete_matrix(d, "user_id", "day", "v").select("user_id", "day", F.round("v", 6).alias("v"))


@query("""with m as (select avg(p_size) filter (p_partkey % 5 > 0) as a, stddev_pop(p_size) filter (p_partkey % 5 > 0) as s, median(p_retailprice) filter (p_partkey % 5 > 0 and p_partkey % 3 > 0) as md from part)
  select p_partkey, round(case when p_partkey % 4 > 0 then (p_size - a) / (s + 1e-6) else 0 end, 6) as size, round(case when p_partkey % 3 > 0 then p_retailprice else md end, 6) as price from part, m""".replace("filter (p_partkey % 5 > 0) as a", "filter (p_partkey % 5 > 0 and p_partkey % 4 > 0) as a").replace("filter (p_partkey % 5 > 0) as s", "filter (p_partkey % 5 > 0 and p_partkey % 4 > 0) as s"))
def scaled_and_imputed(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", F.when(k % 4 > 0, F.col("p_size").cast("double")).alias("size"), F.when(k % 3 > 0, F.col("p_retailprice")).alias("price"))
    out = M.imputed(M.standardised(p, ["size"], k % 5 > 0), ["price"], k % 5 > 0)
    return out.select("p_partkey", F.round("size", 6).alias("size"), F.round("price", 6).alias("price"))


@query(f"with {_DAILY} select day, bool_and(v > 0.002) as all_flagged, bool_or(v > 0.45) as any_flagged from daily group by 1 having bool_and(v > 0.002) or bool_or(v > 0.45)")
def bad_dates(spark, sf):
    d = daily(spark, sf)
    every, some = C.bad_days(d, "day", F.col("v") > 0.002).withColumn("all_flagged", F.lit(True)), C.bad_days(d, "day", F.col("v") > 0.45, any_one=True).withColumn("any_flagged", F.lit(True))
    return every.join(some, "day", "full").select("day", F.coalesce("all_flagged", F.lit(False)).alias("all_flagged"), F.coalesce("any_flagged", F.lit(False)).alias("any_flagged"))


@query(f"""with {_SCENES}, bad as (select day from scenes group by 1 having bool_or(cloud > 95)), s as (select *, row_number() over (partition by year(day), month(day) order by cloud, day, id) as n from scenes where day not in (select day from bad))
  select id, day, round(cloud, 6) as cloud from s where n = 1""")
def monthly_best(spark, sf):
    s = scenes(spark, sf)
    return C.monthly_best(s, C.bad_days(s, "day", F.col("cloud") > 95, any_one=True), "day").select("id", "day", F.round("cloud", 6).alias("cloud"))


_CUBE = "cube as (select cast(l_partkey % 20 as integer) as r, cast(l_suppkey % 5 as integer) as c, cast(year(l_shipdate) as integer) as y, make_date(cast(year(l_shipdate) as integer), 1 + cast(l_suppkey % 4 as integer) * 0, 1) as day, case when avg(l_quantity) > 9 then avg(l_quantity) - 30 end as db from lineitem group by 1, 2, 3, 4)"


def cube(spark, sf):
    """(r, c, day, db): yearly passes over a grid of 20 x 5, some cells missing."""
    li = table(spark, sf, "lineitem")
    q = F.avg("l_quantity")
    return li.groupBy(F.pmod("l_partkey", F.lit(20)).cast("int").alias("r"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("c"), F.trunc("l_shipdate", "YEAR").alias("day")).agg(F.when(q > 9, q - 30).alias("db"))


@query(f"with {_CUBE} select day, round(avg(cast(db is not null as integer)), 6) as share from cube group by 1 having avg(cast(db is not null as integer)) > 0.9")
def full_passes(spark, sf):
    return C.full_passes(cube(spark, sf), "day", "db").withColumn("share", F.round("share", 6))


@query(f"with {_DAILY} select day from (select distinct day from daily where v > 0.4) order by abs(date_diff('day', day, date '2024-01-15')), day limit 1")
def nearest_date(spark, sf):
    return C.nearest_day(daily(spark, sf).where("v > 0.4"), "day", "2024-01-15")


@query(f"with {_CUBE} select day, round(median(db), 6) as median from cube group by 1 order by median(db), day limit 1")
def peak_date(spark, sf):
    return C.peak_day(cube(spark, sf), "day", "db").withColumn("median", F.round("median", 6))


@query(f"""with {_CUBE}, own as (select distinct r, c, case when r < 7 then 'north' else 'south' end as name from cube where (r + c) % 3 > 0), size as (select name, count(*) as size from own group by 1)
  select name, day, count(db) as n, round(avg(db), 6) as mean from cube join own using (r, c) join size using (name) group by name, day, size having count(db) >= greatest(3, 0.8 * size)""")
def masked_stats(spark, sf):
    c = cube(spark, sf)
    own = c.where((F.col("r") + F.col("c")) % 3 > 0).select("r", "c", F.when(F.col("r") < 7, "north").otherwise("south").alias("name")).distinct()
    return C.masked_stats(c, own, "day", "db").select("name", "day", "n", F.round("mean", 6).alias("mean"))


@query(f"""with {_CELLS}, t(threshold) as (values (48000), (50000), (51000), (52000), (53000), (54000), (56000)) select threshold, round(count(*) filter (v > threshold and (r + c) % 3 > 0) / count(*) filter (v > threshold or (r + c) % 3 > 0), 9) as iou from cells, t group by 1""")
def iou_thresholds(spark, sf):
    return R.overlap_curve(cells(spark, sf).withColumn("inside", (F.col("r") + F.col("c")) % 3 > 0), "v", "inside", [48000, 50000, 51000, 52000, 53000, 54000, 56000]).withColumn("iou", F.round("iou", 9))


@query("select l_suppkey, " + ", ".join(f"round(avg(l_{v}) filter (month(l_shipdate) = {m}), 6) as {v}_{m}" for v in ("quantity", "tax") for m in (1, 4, 7, 10)) + " from lineitem group by 1")
def monthly_wide(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"))
    w = C.monthly_wide(li, "l_suppkey", "l_shipdate", ["quantity", "tax"], [1, 4, 7, 10])
    return w.select("l_suppkey", *(F.round(c, 6).alias(c) for c in w.columns[1:]))


@query("select cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month, round(avg(cast(l_linenumber in (4, 5, 6) as integer)), 6) as share, count(*) filter (l_linenumber in (4, 5, 6) and (month(l_shipdate) >= 10 or month(l_shipdate) <= 5)) as clear_dates from lineitem group by 1, 2")
def clear_share(spark, sf):
    ok = F.col("l_linenumber").isin(4, 5, 6)
    month = F.month("l_shipdate")
    return table(spark, sf, "lineitem").groupBy(F.year("l_shipdate").alias("year"), month.alias("month")).agg(F.round(F.avg(ok.cast("double")), 6).alias("share"), F.count_if(ok & ((F.month("l_shipdate") >= 10) | (F.month("l_shipdate") <= 5))).alias("clear_dates"))


@query("""with w as (select case when l_linenumber > 1 then l_quantity > 25 end as o, case when l_linenumber < 7 then l_tax > 0.04 end as r from lineitem)
  select count(*) as n, round(avg(cast(o as integer)), 6) as optical_share, round(avg(cast(r as integer)), 6) as radar_share, round(avg(cast(o = r as integer)), 6) as agreement, round(avg(cast(r as integer)) filter (o), 6) as found, round(avg(cast(o as integer)) filter (r), 6) as confirmed from w where o is not null and r is not null""")
def water_agreement(spark, sf):
    li = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") > 1, F.col("l_quantity") > 25).alias("o"), F.when(F.col("l_linenumber") < 7, F.col("l_tax") > 0.04).alias("r"))
    w = C.water_agreement(li, "o", "r")
    return w.select("n", *(F.round(c, 6).alias(c) for c in w.columns[1:]))


@query(f"""with {_DAILY} select count(distinct user_id) as entities, count(*) as observations, count(*) filter (v > 0.6) as flagged, count(distinct day) as dates, min(day) as first_day, max(day) as last_day, count(*) filter (user_id % 3 = 0) as third from daily""")
def dataset_report(spark, sf):
    return daily(spark, sf).agg(F.countDistinct("user_id").alias("entities"), F.count("*").alias("observations"), F.count_if(F.col("v") > 0.6).alias("flagged"), F.countDistinct("day").alias("dates"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count_if(F.col("user_id") % 3 == 0).alias("third"))


@query("""with o as (select o_custkey, min(cast(o_orderdate as date)) as a, max(cast(o_orderdate as date)) as b from orders group by 1), s as (select *, make_date(cast(year(a) - case when month(a) >= 8 then 0 else 1 end as integer), 9, 1) as start from o)
  select o_custkey, start, count(day) as n, max(day) as last_day from (select o_custkey, start, case when x <= b then cast(x as date) end as day from s left join lateral (select unnest(generate_series(start::timestamp, b::timestamp, interval 5 day)) as x) on true) group by 1, 2""")
def entity_grids(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return W.entity_grid(o, "o_custkey", "day").groupBy("o_custkey", "start").agg(F.count("grid_day").alias("n"), F.max("grid_day").alias("last_day"))


@query(f"""with {_DAILY}, e as (select user_id, day, round(abs(v - 0.5), 9) as error from daily union all select user_id, day, round(abs(v - 0.5), 9) from daily) select user_id, day, max(error) as error from e group by 1, 2 order by error desc, user_id, day limit 5""")
def worst_errors(spark, sf):
    e = daily(spark, sf).select("user_id", "day", F.round(F.abs(F.col("v") - 0.5), 9).alias("error"))
    return W.worst(e.union(e), ["user_id", "day"], "error", 5)


@query(f"""with {_DAILY}, p as (select user_id, max(v) as peak, arg_max(day, struct_pack(v := v, d := -epoch(day))) as peak_day from daily group by 1), k as (select *, lag(v) over o as pv, lag(day) over o as pd from daily window o as (partition by user_id order by day))
  select p.user_id, round(min(case when k.day <= p.peak_day and k.v >= p.peak / 2 and k.pv < p.peak / 2 then date_diff('day', k.day, p.peak_day) + (k.v - p.peak / 2) / (k.v - k.pv) * date_diff('day', k.pd, k.day) end), 6) as cross_days from p join k using (user_id) group by 1""")
def half_height_before(spark, sf):
    d = W.half_height(daily(spark, sf), "user_id", "day", "v", F.col("peak") / 2, before=True)
    return d.select("user_id", F.round("cross_days", 6).alias("cross_days"))


@query("""with p as (select c_nationkey, c_custkey * 7.3 as x, c_acctbal as y from customer) select c_nationkey, count(*) as n, round(avg(x), 4) as cx, round(avg(y), 4) as cy, floor(min(x) / 20) * 20 as x0, floor(min(y) / 20) * 20 as y0, ceil(max(x) / 20) * 20 as x1, ceil(max(y) / 20) * 20 as y1 from p group by 1""")
def snapped_bounds(spark, sf):
    p = table(spark, sf, "customer").select("c_nationkey", (F.col("c_custkey") * 7.3).cast("double").alias("x"), F.col("c_acctbal").alias("y"))
    b = C.centre_and_bounds(p, ["c_nationkey"], "x", "y").select("c_nationkey", "n", F.round("cx", 4).alias("cx"), F.round("cy", 4).alias("cy"))
    s = p.groupBy("c_nationkey").agg(G.snap_box(F.col("x"), F.col("y"), 20.0).alias("b"))
    return b.join(s, "c_nationkey").select("c_nationkey", "n", "cx", "cy", *(F.col(f"b.{c}").cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))


_RINGS = "f(name, k, x, y) as (values ('a', 1, 2.3, 3.1), ('a', 2, 20.2, 5.4), ('a', 3, 15.7, 25.3), ('a', 4, 2.3, 3.1), ('b', 1, 12.1, 12.2), ('b', 2, 36.4, 14.3), ('b', 3, 30.6, 37.8), ('b', 4, 10.9, 30.7), ('b', 5, 12.1, 12.2))"


@query(f"""with {_CELLS}, {_RINGS}, e as (select name, x::double as ax, y::double as ay, lead(x) over (partition by name order by k)::double as bx, lead(y) over (partition by name order by k)::double as by_ from f), g as (select * from e where bx is not null),
  q as (select r, c, name, ay, by_, ax, bx, least(1.0, greatest(0.0, ((c + 0.5 - ax) * (bx - ax) + (r + 0.5 - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) as t from cells, g),
  i as (select r, c, name, count(*) filter ((ay > r + 0.5) <> (by_ > r + 0.5) and c + 0.5 < ax + (r + 0.5 - ay) * (bx - ax) / (by_ - ay)) % 2 = 1 as inside, min(sqrt(pow(c + 0.5 - ax - t * (bx - ax), 2) + pow(r + 0.5 - ay - t * (by_ - ay), 2))) as dist from q group by 1, 2, 3)
  select r, c, max(name) as name from i where inside and dist > 2.0 group by 1, 2""")
def buffered_polygons(spark, sf):
    fields = spark.createDataFrame([("a", [(2.3, 3.1), (20.2, 5.4), (15.7, 25.3), (2.3, 3.1)]), ("b", [(12.1, 12.2), (36.4, 14.3), (30.6, 37.8), (10.9, 30.7), (12.1, 12.2)])], "name string, ring array<struct<x:double,y:double>>")
    px = cells(spark, sf).select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return J.pixels_in_polygons(px, fields, "x", "y", 2.0).select("r", "c", "name")


_HASHED = "('0x' || substr(md5(concat_ws(':', r, c, '{0}', '0')), 1, 8))::bigint / 4294967296"


@query(f"with {_CELLS} select r, c, round((c + {_HASHED.format('x')}) * 250, 6) as x, round((r + {_HASHED.format('y')}) * 250, 6) as y from cells")
def grid_points(spark, sf):
    p = C.points_in_cells(cells(spark, sf), 250.0)
    return p.select("r", "c", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("""with e as (select cast(ts as date) as day, event_type as t, value from events), n as (select count(distinct t) as n from e), d as (select day, count(distinct t) as k, bool_and(value < 488) as ok, max(value) as haze from e group by 1), g as (select day, haze from d, n where ok and k = n.n)
  select (select day from g order by haze, day limit 1) as clearest, (select max(day) from g) as latest""")
def clearest_dates(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return C.clearest_days(e, "day", "event_type", F.col("value") < 488, "value")


@query("select c_custkey, cast((row_number() over (partition by c_mktsegment order by c_custkey) - 1) // 9 as integer) as page, cast((row_number() over (partition by c_mktsegment order by c_custkey) - 1) % 9 as integer) as place from customer")
def sheet_pages(spark, sf):
    return M.pages(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), ["c_mktsegment"], ["c_custkey"], 9).drop("c_mktsegment")


@query("""with m as (select o_orderkey, cast(o_custkey % 4 as integer) as k, cast(o_orderdate as date) as day, o_totalprice as p from orders), cv as (select k, make_date(cast(year(day) as integer), cast(month(day) as integer), 1) as mo, max(p) as v from m group by 1, 2),
  t as (select k, arg_max(mo, struct_pack(v := v, d := -epoch(mo))) as d from cv group by 1), n as (select k, cast(row_number() over (order by d, k) - 1 as integer) as i from t) select o_orderkey, i as k from m join n using (k)""")
def cluster_numbers(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 4).cast("int").alias("k"), F.trunc("o_orderdate", "MM").alias("mo"), "o_totalprice")
    curves = o.groupBy("k", "mo").agg(F.max("o_totalprice").alias("v"))
    return M.renumbered(o.select("o_orderkey", "k"), "k", curves, "mo", "v")


@query("""with d as (select vec_id, label, md5(vec_id || ':0') as h from embeddings), f as (select *, row_number() over (partition by label order by h, vec_id) as c from d) select vec_id, label from f order by case when c = 1 then 0 else 1 end, h, vec_id limit 24""")
def few_labels(spark, sf):
    return P.few_labels(table(spark, sf, "embeddings"), "label", "vec_id", 24).select("vec_id", "label")


@query("select c_custkey from customer where c_acctbal > 0 intersect select o_custkey from orders where o_orderstatus = 'F'")
def names_in_both(spark, sf):
    return table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey").intersect(table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey"))


@query("select event_type, min(event_id) as event_id from events group by 1")
def distinct_in_order(spark, sf):
    return M.distinct_in_order(table(spark, sf, "events"), "event_type", ["event_id"])


@query("""with p as (select cast(vec_id % 5 as integer) as strip, label, count(*) as n from embeddings group by 1, 2), w as (select label, sum(n) as t from p group by 1), r as (select s.strip, w.label, t - coalesce(p.n, 0) as k from (select distinct strip from p) s cross join w left join p on p.strip = s.strip and p.label = w.label),
  b as (select *, row_number() over (partition by strip order by k desc, label) as i from r) select p.strip, p.label as truth, b.label as pred, p.n from p join b on p.strip = b.strip where i = 1""")
def majority_baseline(spark, sf):
    return M.majority_baseline(table(spark, sf, "embeddings").withColumn("strip", (F.col("vec_id") % 5).cast("int")), "label", "strip")


@query("""with e as (select vec_id, vec_id % 4 = 0 as labelled, abs(embedding[1]::double) as a, abs(embedding[2]::double) as b from embeddings), p as (select *, a / (a + b) as pa, b / (a + b) as pb from e where a + b > 0)
  select vec_id, case when pa >= pb then 0 else 1 end as pred, cast(0.3 as double) as weight from p where not labelled and greatest(pa, pb) >= 0.95""")
def pseudo_labels(spark, sf):
    a, b = (F.abs(F.col("embedding")[i].cast("double")) for i in (0, 1))
    e = table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4 == 0).alias("labelled"), a.alias("a"), b.alias("b")).where("a + b > 0")
    return ml.pseudo_labels(e.withColumn("prob", F.array(F.col("a") / (F.col("a") + F.col("b")), F.col("b") / (F.col("a") + F.col("b")))), "prob", "labelled").select("vec_id", "pred", "weight")


@query("select vec_id, cast(row_number() over (partition by label order by md5(vec_id::varchar), vec_id) % 5 as integer) as fold from embeddings")
def stratified_folds(spark, sf):
    return ml.stratified_folds(table(spark, sf, "embeddings"), "label", "vec_id", 5).select("vec_id", "fold")


_ESCAPED = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(f"""select p_partkey, '<Placemark><name>' || {_ESCAPED.format("p_name")} || '</name><description>' || {_ESCAPED.format("p_brand")} || '</description><Point><coordinates>' || printf('%.6f,%.6f', p_size * 1.5, p_retailprice / 100) || '</coordinates></Point></Placemark>' as kml,
  replace(p_brand, '#', '\\#') || ' & ' || p_size || ' \\\\' as latex, '<tr><td>' || {_ESCAPED.format("p_type")} || '</td><td>' || p_size || '</td></tr>' as html from part""")
def text_rows(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", M.placemark(F.col("p_name"), F.col("p_size") * 1.5, F.col("p_retailprice") / 100, F.col("p_brand")).alias("kml"), M.table_row([F.col("p_brand"), F.col("p_size")]).alias("latex"), M.sheet_row([F.col("p_type"), F.col("p_size")]).alias("html"))


@query("select l.doc_id from labels l where l.doc_id not in (select doc_id from documents where n_chars > 500)")
def unmatched_labels(spark, sf):
    return J.unmatched(table(spark, sf, "labels").select("doc_id"), table(spark, sf, "documents").where("n_chars > 500"), "doc_id")


@query("select d.doc_id, d.n_chars, cast(l.quality as varchar) as cls from documents d join labels l using (doc_id) where l.quality in (1)")
def property_matrix(spark, sf):
    props = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("cls"))
    return M.property_matrix(props, "doc_id", "cls", table(spark, sf, "documents").select("doc_id", "n_chars"), ["1"]).select("doc_id", "n_chars", "cls")


@query("""with a as (select l_partkey as point, l_linenumber - 4 as dx, cast(l_suppkey % 5 as integer) - 2 as dy, max(l_quantity) as area, max(l_discount) as distance, bool_and(l_returnflag <> 'R') as clean from lineitem group by 1, 2, 3),
  b as (select *, max(cast(dx = 0 and dy = 0 and area >= 30 as integer)) over (partition by point) = 1 as big, dx = 0 and dy = 0 as home from a), k as (select *, not home and not big and clean and distance <= 0.05 as fits from b),
  n as (select *, row_number() over (partition by point order by case when fits then 0 else 1 end, case when fits then -area end, sqrt(dx * dx + dy * dy), dx, dy) as i from k where fits or home) select point, dx, dy, area from n where i = 1""")
def edge_retry(spark, sf):
    li = table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_partkey").alias("point"), (F.col("l_linenumber") - 4).alias("dx"), ((F.col("l_suppkey") % 5).cast("int") - 2).alias("dy")).agg(F.max("l_quantity").alias("area"), F.max("l_discount").alias("distance"), F.bool_and(F.col("l_returnflag") != "R").alias("clean"))
    return C.edge_retry(a, 30.0, 0.05).select("point", "dx", "dy", "area")


def _embedded(spark, sf):
    return ml.vectors(table(spark, sf, "embeddings").withColumn("strip", (F.col("vec_id") % 5).cast("int")), "embedding")


@query()
def label_ablation(spark, sf):
    return ml.label_ablation(_embedded(spark, sf), "label", "strip", ml.logistic(), [0, 1, 2, 3, 4], F.col("vec_id") % 3 > 0)


@query()
def logistic_importance(spark, sf):
    return ml.importance(_embedded(spark, sf), "label", ml.logistic())
