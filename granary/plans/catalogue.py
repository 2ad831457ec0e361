"""The engine's operators as queries over the test tables, with the same results as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions import scalars as S
from granary.operators import aggregates as A
from granary.operators import geometry as G
from granary.operators import joins as J
from granary.operators import ml
from granary.operators import raster as R
from granary.operators import sampling as P
from granary.operators import series as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, day, v): the median of each user's values a day, scaled to 0..1; an irregular series."""
    e = table(spark, sf, "events")
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg((F.median("value") / 500.0).alias("v"))


_DAILY = "daily as (select user_id, cast(ts as date) as day, median(value) / 500.0 as v from events group by 1, 2)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(r, c, v): a 40 x 40 grid of mean prices."""
    li = table(spark, sf, "lineitem")
    r, c = F.pmod("l_partkey", F.lit(40)).cast("int"), F.pmod(F.floor(F.col("l_orderkey") / 7), F.lit(40)).cast("int")
    return li.groupBy(r.alias("r"), c.alias("c")).agg(F.round(F.sum("l_extendedprice") / F.count("*"), 6).alias("v"))


_CELLS = "cells as (select cast(l_partkey % 40 as integer) as r, cast((l_orderkey // 7) % 40 as integer) as c, round(sum(l_extendedprice) / count(*), 6) as v from lineitem group by 1, 2)"


@query("""select l_orderkey, l_linenumber, round(case when l_extendedprice + l_tax = 0 then null else (l_extendedprice - l_tax) / (l_extendedprice + l_tax) end, 6) as ndvi,
  round(2.5 * (l_extendedprice - l_tax) / nullif(l_extendedprice + 6.0 * l_tax - 7.5 * l_discount + 1.0, 0), 6) as evi,
  round(greatest((l_quantity * 100 - case when l_returnflag = 'A' then 0 else 1000 end) / 10000.0, 1e-4), 6) as reflectance,
  round(case when l_discount > 0 then 10 * log10(l_discount) end, 6) as db from lineitem""")
def index_registry(spark, sf):
    li = table(spark, sf, "lineitem")
    b = {"B08": F.col("l_extendedprice"), "B04": F.col("l_tax"), "B02": F.col("l_discount")}
    refl = S.reflectance(F.col("l_quantity") * 100, F.when(F.col("l_returnflag") == "A", "02.14").otherwise("05.09"))
    return li.select("l_orderkey", "l_linenumber", F.round(S.index("NDVI", b), 6).alias("ndvi"), F.round(S.index("EVI", b), 6).alias("evi"), F.round(refl, 6).alias("reflectance"), F.round(S.decibel(F.col("l_discount")), 6).alias("db"))


@query("""with s as (select user_id, cast(ts as date) as day, count(*) filter (event_type <> 'error') as used, count(*) filter (event_type <> 'error') / count(*) as share,
  avg(value) filter (event_type <> 'error') as m, median(value) filter (event_type <> 'error') as md, stddev_pop(value) filter (event_type <> 'error') as sd from events group by 1, 2)
  select user_id, day, used, round(share, 6) as share, round(m, 6) as value_mean, round(md, 6) as value_median, round(sd, 6) as value_std from s where used > 0 and share >= 0.8""")
def entity_day_stats(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    s = A.group_stats(e, ["user_id", "day"], ["value"], F.col("event_type") != "error", 0.8)
    return s.select("user_id", "day", "used", *(F.round(c, 6).alias(c) for c in ("share", "value_mean", "value_median", "value_std")))


@query(f"""with {_DAILY}, n as (select count(distinct user_id) as n from daily)
  select day, count(*) as n_dense, round(median(v), 6) as haze from daily, n where v > 0.1 group by day, n.n having count(*) >= least(5, greatest(1, n.n // 3)) and median(v) > 0.16""")
def hazy_dates(spark, sf):
    d = W.hazy_days(daily(spark, sf), "day", F.col("v") > 0.1, "v", F.col("user_id"), 0.16)
    return d.select("day", "n_dense", F.round("haze", 6).alias("haze"))


_DIPS = f"""{_DAILY}, w as (select *, lag(v) over o as pv, lead(v) over o as nv, lag(day) over o as pd, lead(day) over o as nd from daily window o as (partition by user_id order by day)),
  dips as (select user_id, day, v, coalesce(pv - v > 0.1 and date_diff('day', pd, day) <= 20 and nv - v > 0.1 and date_diff('day', day, nd) <= 20, false) as dip from w)"""


@query(f"with {_DIPS} select user_id, day, round(v, 6) as v, dip, case when v > 0.6 and dip then 'high+dip' when v > 0.6 then 'high' when dip then 'dip' else 'ok' end as flag from dips")
def dip_flags(spark, sf):
    d = W.dips(daily(spark, sf), "user_id", "day", "v")
    return d.select("user_id", "day", F.round("v", 6).alias("v"), "dip", W.flag_string(high=F.col("v") > 0.6, dip=F.col("dip")).alias("flag"))


_REGULAR = """g as (select u.user_id, cast(x as date) as day from (select distinct user_id from daily) u, generate_series(timestamp '2024-01-01', timestamp '2024-01-30', interval 2 day) t(x)),
  reg as (select g.user_id, g.day, case when a.day = g.day then a.v when date_diff('day', a.day, b.day) <= 6 then a.v + (b.v - a.v) * date_diff('day', a.day, g.day) / date_diff('day', a.day, b.day) end as value
    from g asof left join daily a on g.user_id = a.user_id and g.day >= a.day asof left join daily b on g.user_id = b.user_id and g.day <= b.day)"""


def regular(spark, sf):
    return W.regularise(daily(spark, sf), "user_id", "day", "v", "2024-01-01", "2024-01-30", 2, 6)


@query(f"with {_DAILY}, {_REGULAR} select user_id, day, round(value, 6) as value from reg")
def regular_series(spark, sf):
    return regular(spark, sf).select("user_id", "day", F.round("value", 6).alias("value"))


@query(f"""with {_DAILY}, k as (select user_id, day, case when v > 0.2 then v end as v from daily)
  select user_id, day, round(last_value(v ignore nulls) over (partition by user_id order by day rows between unbounded preceding and current row), 6) as last_valid,
  round(first_value(v ignore nulls) over (partition by user_id order by day rows between current row and unbounded following), 6) as next_valid from k""")
def last_next_valid(spark, sf):
    d = daily(spark, sf).withColumn("v", F.when(F.col("v") > 0.2, F.col("v")))
    return W.fills(d, "user_id", ["day"], "v").select("user_id", "day", F.round("last_valid", 6).alias("last_valid"), F.round("next_valid", 6).alias("next_valid"))


@query(f"""with {_DAILY}, k as (select * from daily where v > 0.1), w as (select *, lag(v) over o as pv, lead(v) over o as nv, lag(day) over o as pd, lead(day) over o as nd from k window o as (partition by user_id order by day))
  select user_id, day, round(v, 6) as v, coalesce(pv - v > 0.1 and date_diff('day', pd, day) <= 20 and nv - v > 0.1 and date_diff('day', day, nd) <= 20, false) as dip from w""")
def pixel_dips(spark, sf):
    return W.pixel_dips(daily(spark, sf), "user_id", "day", "v", F.col("v") > 0.1).select("user_id", "day", F.round("v", 6).alias("v"), "dip")


@query(f"""with {_DAILY}, n as (select *, row_number() over (partition by user_id order by day) as n from daily), i as (select *, n - row_number() over (partition by user_id order by day) as g from n where v > 0.3)
  select user_id, cast(min(n) as integer) as first_pos, count(*) as length from i group by user_id, g""")
def islands(spark, sf):
    return W.islands(daily(spark, sf), "user_id", ["day"], F.col("v") > 0.3)


@query(f"""with {_DAILY}, g as (select user_id, day as from_day, lead(day) over (partition by user_id order by day) as to_day from daily)
  select *, cast(date_diff('day', from_day, to_day) as integer) as gap_days from g where date_diff('day', from_day, to_day) > 3""")
def long_gaps(spark, sf):
    return W.long_gaps(daily(spark, sf), "user_id", "day", 3)


@query(f"""with {_DAILY}, {_REGULAR}, seg as (select user_id, day, value, lead(value) over (partition by user_id order by day) as nxt from reg), p as (select distinct user_id, date '2024-01-10' as at_day from daily)
  select p.user_id, p.at_day, round(case when s.day = p.at_day then s.value else s.value + (s.nxt - s.value) * date_diff('day', s.day, p.at_day) / 2 end, 6) as value
  from p left join seg s on p.user_id = s.user_id and p.at_day >= s.day and date_diff('day', s.day, p.at_day) < 2""")
def grid_value_at(spark, sf):
    at = daily(spark, sf).select(F.col("user_id")).distinct().withColumn("at_day", F.lit("2024-01-10").cast("date"))
    return W.value_at(regular(spark, sf), "user_id", "day", "value", at, "at_day", 2).withColumn("value", F.round("value", 6))


_SG = [round(x, 12) for x in W.savgol_weights(5, 2)]


@query(f"""with {_DAILY}, k as (select *, row_number() over o as n, count(*) over (partition by user_id) as m, lag(v, 2) over o as a, lag(v) over o as b, lead(v) over o as d, lead(v, 2) over o as e from daily window o as (partition by user_id order by day))
  select user_id, day, round({_SG[0]} * a + {_SG[1]} * b + {_SG[2]} * v + {_SG[3]} * d + {_SG[4]} * e, 6) as smooth from k where n > 2 and n <= m - 2""")
def savgol_interior(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    d = W.savgol(daily(spark, sf), "user_id", "day", "v", 5).withColumn("n", F.row_number().over(w.orderBy("day"))).withColumn("m", F.count("*").over(w))
    return d.where("n > 2 and n <= m - 2").select("user_id", "day", F.round("smooth", 6).alias("smooth"))


@query()
def savgol_series(spark, sf):
    return W.savgol(daily(spark, sf), "user_id", "day", "v", 5).select("user_id", "day", F.round("smooth", 6).alias("smooth"))


@query(f"""with {_DAILY}, n as (select *, row_number() over (partition by user_id order by day) as n, count(*) over (partition by user_id) as m from daily),
  h as (select *, (user_id + epoch(day) // 86400) % 10 = 0 and n > 1 and n < m as hid from n), shown as (select * from h where not hid),
  x as (select h.user_id, h.day, h.v, a.v + (b.v - a.v) * date_diff('day', a.day, h.day) / date_diff('day', a.day, b.day) as guess from h
    asof join shown a on h.user_id = a.user_id and h.day >= a.day asof join shown b on h.user_id = b.user_id and h.day <= b.day where h.hid and date_diff('day', a.day, b.day) <= 30)
  select count(*) as n, round(avg(abs(guess - v)), 6) as mae, round(max(abs(guess - v)), 6) as worst from x""")
def holdout_mae(spark, sf):
    hidden = F.pmod(F.col("user_id") + F.unix_date("day"), F.lit(10)) == 0
    e = W.holdout_errors(daily(spark, sf), "user_id", "day", "v", hidden)
    return e.agg(F.count("*").alias("n"), F.round(F.avg("error"), 6).alias("mae"), F.round(F.max("error"), 6).alias("worst"))


@query(f"""with {_DAILY} select user_id, round(avg(v) filter (day < date '2024-01-11'), 9) as early, round(avg(v) filter (day between date '2024-01-11' and date '2024-01-20'), 9) as middle,
  round(max(v), 9) as peak, arg_max(day, struct_pack(v := v, d := -epoch(day))) as peak_day, cast(5 * count(*) filter (v > 0.5) as integer) as days_above, round(min(v) filter (day > date '2024-01-20'), 9) as late_min from daily group by user_id""")
def season_features(spark, sf):
    d = daily(spark, sf)
    at = lambda c: F.when(c, F.col("v"))
    day = F.col("day")
    return d.groupBy("user_id").agg(
        F.round(F.avg(at(day < "2024-01-11")), 9).alias("early"), F.round(F.avg(at(day.between("2024-01-11", "2024-01-20"))), 9).alias("middle"), F.round(F.max("v"), 9).alias("peak"),
        F.max_by("day", F.struct("v", -F.unix_date("day"))).alias("peak_day"), (5 * F.count_if(F.col("v") > 0.5)).cast("int").alias("days_above"), F.round(F.min(at(day > "2024-01-20")), 9).alias("late_min"),
    )


@query("""with y as (select unnest(range(1995, 2003)) as y), s as (select 'rabi_' || y as season, make_date(y - 1, 11, 1) as a, make_date(y, 4, 30) as b from y union all select 'kharif_' || y, make_date(y, 5, 1), make_date(y, 10, 31) from y)
  select season, count(*) as orders, round(avg(o_totalprice), 4) as mean_price from orders join s on cast(o_orderdate as date) between a and b group by season""")
def season_windows(spark, sf):
    o = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    s = W.season_windows(1995, 2002, spark)
    m = o.join(F.broadcast(s), (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("stop")))
    return m.groupBy("season").agg(F.count("*").alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(f"""with {_DAILY}, p as (select user_id, max(v) as peak, arg_max(day, struct_pack(v := v, d := -epoch(day))) as peak_day from daily group by 1), k as (select *, lead(v) over o as nv, lead(day) over o as nd from daily window o as (partition by user_id order by day))
  select p.user_id, p.peak_day, round(p.peak, 6) as peak, round(min(case when k.day >= p.peak_day and k.v >= p.peak / 2 and k.nv < p.peak / 2 then date_diff('day', p.peak_day, k.day) + (k.v - p.peak / 2) / (k.v - k.nv) * date_diff('day', k.day, k.nd) end), 6) as cross_days
  from p join k using (user_id) group by 1, 2, 3""")
def half_height_crossing(spark, sf):
    d = W.half_height(daily(spark, sf), "user_id", "day", "v", F.col("peak") / 2)
    return d.select("user_id", "peak_day", F.round("peak", 6).alias("peak"), F.round("cross_days", 6).alias("cross_days"))


_SEASONS = """o as (select cast(o_custkey % 5 as bigint) as id, cast(o_orderdate as date) as day, median(o_totalprice) / 500000.0 as v from orders group by 1, 2),
  g as (select u.id, cast(x as date) as day from (select distinct id from o) u, generate_series(timestamp '1995-01-01', timestamp '2001-07-31', interval 10 day) t(x)),
  r as (select g.id, g.day, case when a.day = g.day then a.v when date_diff('day', a.day, b.day) <= 30 then a.v + (b.v - a.v) * date_diff('day', a.day, g.day) / date_diff('day', a.day, b.day) end as v
    from g asof left join o a on g.id = a.id and g.day >= a.day asof left join o b on g.id = b.id and g.day <= b.day)"""
_PHENOLOGY = f"""with recursive {_SEASONS},
  n as (select *, row_number() over (partition by id order by day) as i, count(*) over (partition by id) as len from r),
  k as (select *, case when v is null then i end as gap, case when month(day) >= 11 then 'rabi_' || (year(day) + 1) when month(day) <= 4 then 'rabi_' || year(day) else 'kharif_' || year(day) end as season,
    lag(v) over w as pv, lead(v) over w as nv, min(case when v is not null then struct_pack(v := v, i := i) end) over (w rows between 18 preceding and 1 preceding) as lo,
    min(case when v is not null then struct_pack(v := v, i := i) end) over (w rows between 1 following and 18 following) as hi from n window w as (partition by id order by day)),
  k2 as (select *, coalesce(max(gap) over (partition by id order by day), 0) + 1 as f, coalesce(min(gap) over (partition by id order by day rows between current row and unbounded following), len + 1) - 1 as l from k),
  top as (select *, row_number() over (partition by id, season order by v desc nulls last, i) as best, min(day) over (partition by id, season) as from_day from k2),
  p as (select *, case when v is null then 'empty' when coalesce(pv > v, false) or coalesce(nv > v, false) then 'peak outside' when greatest(coalesce(v - lo.v, 0), coalesce(v - hi.v, 0)) < 0.2 then 'flat' end as why from top where best = 1),
  q as (select *, case when why is null and lo.i > f and v - lo.v >= 0.2 then (lo.v + v) / 2 end as up_to, case when why is null and hi.i < l and v - hi.v >= 0.2 then (hi.v + v) / 2 end as down_to from p),
  s as (select q.id, q.season, arg_max(epoch(k.day) / 86400 - (k.v - up_to) / (k.v - k.pv) * 10, k.i) as s from q join k on q.id = k.id and k.i <= q.i and k.i > q.lo.i and k.v >= up_to and k.pv < up_to group by 1, 2),
  e as (select q.id, q.season, arg_min(epoch(k.day) / 86400 + (k.v - down_to) / (k.v - k.nv) * 10, k.i) as e from q join k on q.id = k.id and k.i >= q.i and k.i < q.hi.i and k.v >= down_to and k.nv < down_to group by 1, 2),
  x as (select q.*, s.s, e.e from q left join s using (id, season) left join e using (id, season)),
  area as (select x.id, x.season, sum((a.v + a.nv) / 2 * 10) as area from x join k a on a.id = x.id and epoch(a.day) / 86400 >= x.s and epoch(a.day) / 86400 + 10 <= x.e group by 1, 2),
  m as (select *, row_number() over (partition by id order by from_day) as ord from x where why is null),
  low as (select a.id, a.ord as oa, b.ord as ob, min(k.v) as low from m a join m b on a.id = b.id and a.ord < b.ord join k on k.id = a.id and k.i between a.i and b.i group by 1, 2, 3),
  walk(id, ord, up, gone, into_) as (
    select id, 1::bigint, 1::bigint, null::bigint, null::bigint from m where ord = 1
    union all
    select w.id, nx.ord, case when round(least(u.v, nx.v), 3) - low.low < 0.2 and round(u.v, 3) >= round(nx.v, 3) then w.up else nx.ord end,
      case when round(least(u.v, nx.v), 3) - low.low < 0.2 then case when round(u.v, 3) >= round(nx.v, 3) then nx.ord else w.up end end,
      case when round(least(u.v, nx.v), 3) - low.low < 0.2 then case when round(u.v, 3) >= round(nx.v, 3) then w.up else nx.ord end end
    from walk w join m nx on nx.id = w.id and nx.ord = w.ord + 1 join m u on u.id = w.id and u.ord = w.up join low on low.id = w.id and low.oa = w.up and low.ob = nx.ord),
  taken as (select w.id, g.season, t.season as into_ from walk w join m g on g.id = w.id and g.ord = w.gone join m t on t.id = w.id and t.ord = w.into_)
  select x.id, x.season, case when ok then x.day end as peak_day, case when ok then round(x.v, 3) end as peak, case when ok then cast(to_timestamp(floor(s) * 86400) at time zone 'UTC' as date) end as start_day,
    case when ok then cast(to_timestamp(floor(e) * 86400) at time zone 'UTC' as date) end as end_day, case when ok and s is not null then round_even(e - s, 0) end as length_days,
    case when ok and s is not null and e is not null then round(coalesce(area, 0), 1) end as value_days,
    case when taken.into_ is not null then 'in ' || taken.into_ when why is not null then why else concat_ws('; ', case when pv is null or nv is null then 'beside gap' end, case when s is null then 'start unseen' end, case when e is null then 'end unseen' end) end as note
  from (select x.*, t.into_ is null and why is null as ok from x left join taken t using (id, season)) x left join taken using (id, season) left join area using (id, season)"""


def seasonal(spark, sf):
    """(id, day, value): six years of prices on a grid of ten days; some gaps at the smallest size."""
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 5).alias("id"), F.to_date("o_orderdate").alias("day")).agg((F.median("o_totalprice") / 500000.0).alias("v"))
    return W.regularise(o, "id", "day", "v", "1995-01-01", "2001-07-31", 10, 30)


@query(_PHENOLOGY)
def phenology(spark, sf):
    return W.phenology(seasonal(spark, sf), "id", "day", "value", 10)


@query("""with a as (select event_id, user_id, ts from events where event_type = 'purchase'), b as (select event_id as r_event_id, user_id, ts as rt, value as r_value from events where event_type = 'view'),
  m as (select a.*, b.*, row_number() over (partition by a.event_id order by abs(epoch_us(a.ts) - epoch_us(rt)), rt, r_event_id) as n from a join b on a.user_id = b.user_id and abs(epoch_us(a.ts) - epoch_us(rt)) <= 86400000000)
  select event_id, a.user_id, r_event_id, round(r_value, 6) as r_value from m a where n = 1""".replace("a.*, b.*", "a.event_id, a.user_id, a.ts, b.r_event_id, b.rt, b.r_value"))
def asof_nearest(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    out = J.asof_nearest(a, e.where("event_type = 'view'"), "user_id", "ts", 86400, ["event_id", "value"])
    return out.select("event_id", "user_id", "r_event_id", F.round("r_value", 6).alias("r_value"))


@query("""select cast(o_orderdate as date) as day, o_orderkey, o_totalprice from (select *, row_number() over (partition by cast(o_orderdate as date) order by o_totalprice, o_orderkey) as n from orders where o_totalprice < 200000) where n = 1""")
def best_per_day(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice < 200000").withColumn("day", F.to_date("o_orderdate"))
    return J.best_per_group(o, [F.col("day")], [F.col("o_totalprice"), F.col("o_orderkey")]).select("day", "o_orderkey", "o_totalprice")


@query("""select d.doc_id, coalesce(case when l.quality = 0 then 'poor' when l.quality = 1 then 'good' end, case when d.n_chars < 500 then 'short' end, '') as cls,
  case when l.quality in (0, 1) then 'review' when d.n_chars < 500 then 'rule' end as cls_source from documents d left join labels l using (doc_id)""")
def label_merge(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "n_chars", F.lit("").alias("cls"))
    review = table(spark, sf, "labels").select("doc_id", S.recode(F.col("quality").cast("string"), {"0": "poor", "1": "good"}).alias("value"))
    rule = d.where("n_chars < 500").select("doc_id", F.lit("short").alias("value"))
    return J.label_merge(d, "doc_id", "cls", [("review", review), ("rule", rule)]).select("doc_id", "cls", "cls_source")


@query("""with a as (select c_custkey from customer where c_acctbal < 0 union select o_custkey from orders where o_orderstatus = 'P'), b as (select c_custkey from customer where c_mktsegment = 'BUILDING' and c_custkey not in (select c_custkey from a))
  select c_custkey, 'A' as priority from a union all select c_custkey, 'B' from b""")
def semi_anti_priority(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    a = c.where("c_acctbal < 0").select("c_custkey").union(o.where("o_orderstatus = 'P'").select("o_custkey")).distinct()
    b = c.where("c_mktsegment = 'BUILDING'").select("c_custkey").join(a, "c_custkey", "left_anti")
    return a.withColumn("priority", F.lit("A")).union(b.withColumn("priority", F.lit("B")))


@query()
def proximity_groups(spark, sf):
    """Over the whole of part, which is too much for a recursive SQL."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7919 % 5000 / 10.0).alias("x"), (F.col("p_partkey") * 104729 % 5000 / 10.0).alias("y"))
    return J.proximity_groups(p, "id", "x", "y", 20.0)


@query(f"""with {_CELLS}, f(name, k, x, y) as (values ('a', 1, 2.3, 3.1), ('a', 2, 20.2, 5.4), ('a', 3, 15.7, 25.3), ('a', 4, 2.3, 3.1), ('b', 1, 12.1, 12.2), ('b', 2, 36.4, 14.3), ('b', 3, 30.6, 37.8), ('b', 4, 10.9, 30.7), ('b', 5, 12.1, 12.2)),
  e as (select name, x as ax, y as ay, lead(x) over (partition by name order by k) as bx, lead(y) over (partition by name order by k) as by_ from f),
  i as (select r, c, name from cells, e where bx is not null and (ay > r + 0.5) <> (by_ > r + 0.5) and c + 0.5 < ax + (r + 0.5 - ay) * (bx - ax) / (by_ - ay) group by 1, 2, 3 having count(*) % 2 = 1)
  select r, c, max(name) as name from i group by 1, 2""")
def point_in_polygon(spark, sf):
    fields = spark.createDataFrame([("a", [(2.3, 3.1), (20.2, 5.4), (15.7, 25.3), (2.3, 3.1)]), ("b", [(12.1, 12.2), (36.4, 14.3), (30.6, 37.8), (10.9, 30.7), (12.1, 12.2)])], "name string, ring array<struct<x:double,y:double>>")
    px = cells(spark, sf).select("r", "c", (F.col("c") + 0.5).alias("x"), (F.col("r") + 0.5).alias("y"))
    return J.pixels_in_polygons(px, fields, "x", "y").select("r", "c", "name")


@query(f"with {_CELLS} select round(count(*) filter (v > 53000 and (r + c) % 3 > 0) / count(*) filter (v > 53000 or (r + c) % 3 > 0), 9) as iou from cells")
def raster_iou(spark, sf):
    g = cells(spark, sf)
    return R.overlap(g.where("v > 53000"), g.where("(r + c) % 3 > 0")).select(F.round("iou", 9).alias("iou"))


@query("""with n as (select l_partkey, l_linenumber, count(*) as k from lineitem group by 1, 2), m as (select *, row_number() over (partition by l_partkey order by k desc, l_linenumber) as i, sum(k) over (partition by l_partkey) as n from n)
  select l_partkey, l_linenumber as majority, cast(n as bigint) as n, round(k / n, 6) as agreement from m where i = 1""")
def majority_vote(spark, sf):
    return A.majority(table(spark, sf, "lineitem"), ["l_partkey"], "l_linenumber").withColumn("agreement", F.round("agreement", 6))


@query("""with c(code, name) as (values (0, 'none'), (1, 'one'), (2, 'two'), (9, 'never')) select c.code, c.name, count(l.l_orderkey) as pixels, round(count(l.l_orderkey) * 0.01, 1) as hectares, round(count(l.l_orderkey) / (select count(*) from lineitem), 3) as share
  from c left join lineitem l on l.l_linenumber % 3 = c.code group by 1, 2""")
def class_areas(spark, sf):
    codes = spark.createDataFrame([(0, "none"), (1, "one"), (2, "two"), (9, "never")], "code int, name string")
    return A.class_areas(table(spark, sf, "lineitem").withColumn("k", (F.col("l_linenumber") % 3).cast("int")), "k", codes)


@query("""with q as (select quantile_cont(l_extendedprice, 0.005) as lo, quantile_cont(l_extendedprice, 0.995) as hi from lineitem), b as (select least(cast(floor((l_extendedprice - lo) / (hi - lo) * 256) as integer), 255) as bin, lo, hi from lineitem, q where l_extendedprice between lo and hi),
  h as (select bin, lo + (bin + 0.5) * (hi - lo) / 256 as mid, count(*) as n from b group by bin, lo, hi), c as (select *, sum(n) over o as w0, sum(n * mid) over o as s0, sum(n) over () as w, sum(n * mid) over () as s from h window o as (order by bin rows unbounded preceding))
  select round(mid, 4) as threshold from c order by round(w0 * (w - w0) * power(s0 / w0 - (s - s0) / nullif(w - w0, 0), 2), 6) desc nulls last, bin limit 1""")
def otsu(spark, sf):
    return A.otsu(table(spark, sf, "lineitem"), "l_extendedprice").select(F.round("threshold", 4).alias("threshold"))


_NEAR = "o(dr, dc) as (select a - 1, b - 1 from range(3) t(a), range(3) u(b))"


@query(f"with {_CELLS}, {_NEAR} select a.r, a.c, round(avg(b.v), 4) as mean from cells a, o join cells b on b.r = least(greatest(a.r + dr, 0), 39) and b.c = least(greatest(a.c + dc, 0), 39) group by 1, 2".replace("from cells a, o join cells b", "from cells a cross join o join cells b"))
def focal_mean(spark, sf):
    return R.focal_mean(cells(spark, sf), "v", 40, 40).withColumn("mean", F.round("mean", 4))


@query(f"""with {_CELLS}, g as (select r, c, case when (r * 7 + c) % 11 > 0 then v end as v from cells), m as (select median(v) as m from g), f as (select r, c, coalesce(v, m) as v from g, m), {_NEAR}
  select a.r, a.c, round(median(b.v), 4) as median from g a cross join o join f b on b.r = least(greatest(a.r + dr, 0), 39) and b.c = least(greatest(a.c + dc, 0), 39) where a.v is not null group by 1, 2""")
def focal_median(spark, sf):
    g = cells(spark, sf).withColumn("v", F.when((F.col("r") * 7 + F.col("c")) % 11 > 0, F.col("v")))
    return R.focal_median(g, "v", 40, 40).withColumn("median", F.round("median", 4))


@query(f"with {_CELLS}, {_NEAR} select distinct a.r + dr as r, a.c + dc as c from cells a cross join o where v > 62000 and a.r + dr between 0 and 39 and a.c + dc between 0 and 39".replace("a.r + dr as r, a.c + dc as c", "cast(a.r + dr as integer) as r, cast(a.c + dc as integer) as c"))
def dilate(spark, sf):
    return R.dilate(cells(spark, sf).where("v > 62000"), 1, 40, 40)


@query(f"""with {_CELLS}, {_NEAR}, m as (select r, c from cells where v > 49000), e as (select a.r, a.c from m a cross join o join m b on b.r = a.r + dr and b.c = a.c + dc group by 1, 2 having count(*) = 9)
  select distinct cast(e.r + dr as integer) as r, cast(e.c + dc as integer) as c from e cross join o where e.r + dr between 0 and 39 and e.c + dc between 0 and 39""")
def opening(spark, sf):
    return R.opening(cells(spark, sf).where("v > 49000"), 40, 40)


@query(f"""with {_CELLS}, {_NEAR}, k as (select r, c, cast(v > 52000 as integer) + cast(v > 56000 as integer) as code from cells), n as (select a.r, a.c, a.code, b.code as x, count(*) as k from k a cross join o join k b on b.r = a.r + dr and b.c = a.c + dc group by 1, 2, 3, 4),
  t as (select *, row_number() over (partition by r, c order by k desc, x) as i from n) select round(avg(cast(code <> x as integer)), 6) as share from t where i = 1""")
def speckle(spark, sf):
    g = cells(spark, sf).withColumn("code", (F.col("v") > 52000).cast("int") + (F.col("v") > 56000).cast("int"))
    return R.speckle(g, "code").select(F.round("share", 6).alias("share"))


@query("""with recursive m as (select distinct cast(l_partkey % 12 as integer) as r, cast(l_suppkey % 12 as integer) as c from lineitem where (l_partkey % 12 + l_suppkey % 12 * 5) % 4 > 0),
  t(r, c) as (select r, c from m where r = 5 and c = 6 union select m.r, m.c from t join m on abs(m.r - t.r) + abs(m.c - t.c) = 1) select r, c from t""")
def component_at(spark, sf):
    r, c = F.pmod("l_partkey", F.lit(12)).cast("int"), F.pmod("l_suppkey", F.lit(12)).cast("int")
    return R.component_at(table(spark, sf, "lineitem").select(r.alias("r"), c.alias("c")).where("(r + c * 5) % 4 > 0"), 5, 6)


@query("""with cube as (select cast(l_partkey % 20 as integer) as r, cast(l_suppkey % 5 as integer) as c, cast(year(l_shipdate) as integer) as day, avg(l_quantity) - 30 as db from lineitem group by 1, 2, 3), ref as (select r, c, median(db) as ref from cube where day <= 1997 group by 1, 2)
  select day, round(count(*) filter (db < -5) * 0.01, 2) as water, round(count(*) filter (db < -5 and db < ref - 0.5) * 0.01, 2) as flooded, count(*) filter (ref < -5) as dark from cube join ref using (r, c) group by day""")
def flood_area(spark, sf):
    li = table(spark, sf, "lineitem")
    cube = li.groupBy(F.pmod("l_partkey", F.lit(20)).cast("int").alias("r"), F.pmod("l_suppkey", F.lit(5)).cast("int").alias("c"), F.year("l_shipdate").alias("day")).agg((F.avg("l_quantity") - 30).alias("db"))
    ref = cube.where("day <= 1997").groupBy("r", "c").agg(F.median("db").alias("ref"))
    d = R.flood(cube, "db", ref, -5.0, 0.5)
    return d.groupBy("day").agg(F.round(F.count_if("water") * 0.01, 2).alias("water"), F.round(F.count_if("flooded") * 0.01, 2).alias("flooded"), F.count_if("dark_before").alias("dark"))


@query("select quality as truth, count(*) filter (toxic = 0) as n_0, count(*) filter (toxic = 1) as n_1 from labels group by 1")
def confusion(spark, sf):
    return A.confusion(table(spark, sf, "labels"), "quality", "toxic", [0, 1])


@query("""with p as (select doc_id % 5 as strip, quality as t, cast(toxic = 0 as integer) as p from labels), r as (select strip, t, count(*) as k, sum(cast(t = p as integer)) as h from p group by 1, 2)
  select strip, cast(sum(k) as bigint) as n, round(sum(h) / sum(k), 6) as accuracy, round(avg(h / k), 6) as balanced, round(1.96 * sqrt(sum(h) / sum(k) * (1 - sum(h) / sum(k)) / sum(k)), 6) as margin, cast(floor(100 * sum(h) / sum(k) + 0.5 + 1e-9) as integer) as percent from r group by 1""")
def classifier_scores(spark, sf):
    d = table(spark, sf, "labels").select((F.col("doc_id") % 5).alias("strip"), F.col("quality").alias("t"), (F.col("toxic") == 0).cast("int").alias("p"))
    s = A.scores(d, ["strip"], "t", "p")
    return s.select("strip", "n", F.round("accuracy", 6).alias("accuracy"), F.round("balanced", 6).alias("balanced"), F.round(S.margin95(F.col("accuracy"), F.col("n")), 6).alias("margin"), S.half_up_percent(F.col("accuracy")).alias("percent"))


@query("select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as r_price, round(corr(l_quantity, l_discount), 6) as r_discount from lineitem group by 1")
def correlation(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r_price"), F.round(F.corr("l_quantity", "l_discount"), 6).alias("r_discount"))


@query("select year(o_orderdate) * 100 + month(o_orderdate) as ym, round(quantile_cont(o_totalprice, 0.25), 4) as q25, round(quantile_cont(o_totalprice, 0.5), 4) as q50, round(quantile_cont(o_totalprice, 0.75), 4) as q75 from orders group by 1".replace("year(o_orderdate) * 100 + month(o_orderdate)", "cast(year(o_orderdate) * 100 + month(o_orderdate) as integer)"))
def quartile_curves(spark, sf):
    o = table(spark, sf, "orders").withColumn("ym", F.year("o_orderdate") * 100 + F.month("o_orderdate"))
    return A.quartiles(o, ["ym"], "o_totalprice").select("ym", *(F.round(c, 4).alias(c) for c in ("q25", "q50", "q75")))


@query("select l_orderkey, l_linenumber, cast(floor(rank() over (partition by l_suppkey order by l_quantity) + (count(*) over (partition by l_suppkey, l_quantity) - 1) / 2) as integer) as rank_avg from lineitem")
def rank_average(spark, sf):
    return A.rank_average(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity").select("l_orderkey", "l_linenumber", "rank_avg")


@query("select word, count(*) as n from (select unnest(string_split(text, ' ')) as word from documents) group by 1")
def explode_count(spark, sf):
    return table(spark, sf, "documents").select(F.explode(F.split("text", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("select cast(year(o_orderdate) as integer) as year, round(avg(o_totalprice) filter (o_orderstatus = 'F'), 4) as f, round(avg(o_totalprice) filter (o_orderstatus = 'O'), 4) as o, round(avg(o_totalprice) filter (o_orderstatus = 'P'), 4) as p from orders group by 1")
def pivot_wide(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.year("o_orderdate").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.round(F.avg("o_totalprice"), 4))
    return o.select("year", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("select p_partkey, 'size' as name, cast(p_size as double) as value from part union all select p_partkey, 'price', p_retailprice from part")
def melt(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot(["p_partkey"], ["size", "price"], "name", "value")


@query("select c_custkey, c_mktsegment from (select *, row_number() over (partition by c_mktsegment order by md5(c_custkey || ':0'), c_custkey) as n from customer) where n <= 20")
def capped_sample(spark, sf):
    return P.capped(table(spark, sf, "customer"), ["c_mktsegment"], "c_custkey", 20).select("c_custkey", "c_mktsegment")


@query("select c_custkey, cast(c_custkey % 5 as integer) as strip, case when row_number() over (partition by c_custkey % 5 order by md5(c_custkey || ':0'), c_custkey) <= 6 then 'test' else 'train' end as role from customer")
def stratified_strips(spark, sf):
    return P.strips(table(spark, sf, "customer"), "c_custkey", 5, 6).select("c_custkey", "strip", "role")


@query("""with s as (select source, avg(cast(toxic = 0 as integer)) as score, count(*) as n from labels join documents using (doc_id) group by 1), t as (select max(score) as top from s where source <> 'src0')
  select source, round(score, 6) as score, n from s, t where source <> 'src0' and score >= top - sqrt(top * (1 - top) / 68) order by n, source limit 1""")
def one_se_choice(spark, sf):
    s = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.avg((F.col("toxic") == 0).cast("int")).alias("score"), F.count("*").alias("n"))
    return A.one_se_choice(s, "source", "score", "n", 68, "src0").select("source", F.round("score", 6).alias("score"), "n")


@query("""with l as (select d.doc_id, d.lang, case when l.quality = 1 then 'en' else '' end as a, case when d.n_chars > 2000 then d.lang else 'en' end as b from documents d left join labels l using (doc_id)), u as (select lang, 'a' as source, a as said from l union all select lang, 'b', b from l)
  select source, count(*) as fields, cast(sum(cast(said = lang as integer)) as bigint) as agree, round(avg(cast(said = lang as integer)), 6) as share from u where said <> '' and lang <> '' group by 1""")
def agreement_table(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    d = d.select("lang", F.when(F.col("quality") == 1, "en").otherwise("").alias("a"), F.when(F.col("n_chars") > 2000, F.col("lang")).otherwise("en").alias("b"))
    return A.agreement_table(d, ["a", "b"], "lang").withColumn("share", F.round("share", 6))


@query("select label, round((select count(*) from embeddings) / ((select count(distinct label) from embeddings) * count(*)), 6) as weight from embeddings group by 1")
def class_weights(spark, sf):
    return A.class_weights(table(spark, sf, "embeddings"), "label").withColumn("weight", F.round("weight", 6))


@query("""with l as (select vec_id, label, vec_id % 5 as strip, unnest(embedding) as x, generate_subscripts(embedding, 1) as d from embeddings), p as (select strip, label, d, sum(x::double) as s, count(*) as n from l group by 1, 2, 3), w as (select label, d, sum(s) as s, sum(n) as n from p group by 1, 2),
  m as (select h.strip, w.label, w.d, (w.s - coalesce(p.s, 0)) / (w.n - coalesce(p.n, 0)) as m from (select distinct strip from l) h cross join w left join p on p.strip = h.strip and p.label = w.label and p.d = w.d where w.n > coalesce(p.n, 0)),
  k as (select l.vec_id, l.strip, l.label as truth, m.label as pred, round(sum((l.x - m.m) * (l.x - m.m)), 9) as dist from l join m on l.strip = m.strip and l.d = m.d group by 1, 2, 3, 4), b as (select *, row_number() over (partition by vec_id order by dist, pred) as i from k)
  select strip, count(*) as n, round(avg(cast(truth = pred as integer)), 6) as accuracy from b where i = 1 group by 1""")
def strip_cv_centroid(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("strip", F.col("vec_id") % 5)
    return A.scores(ml.centroid_predictions(e, "vec_id", "label", "embedding", "strip"), ["strip"], "truth", "pred").select("strip", "n", F.round("accuracy", 6).alias("accuracy"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query()
def logistic_scores(spark, sf):
    e = ml.vectors(table(spark, sf, "embeddings").withColumn("strip", F.col("vec_id") % 5), "embedding")
    return A.scores(ml.cross_validate(e, "label", "strip", ml.logistic(), [0, 1, 2, 3, 4]).withColumn("model", F.lit("logistic")), ["model"], "truth", "pred")


@query()
def forest_scores(spark, sf):
    e = ml.vectors(table(spark, sf, "embeddings").withColumn("strip", F.col("vec_id") % 5), "embedding")
    return A.scores(ml.cross_validate(e, "label", "strip", ml.forest(500), [0, 1, 2, 3, 4]).withColumn("model", F.lit("forest")), ["model"], "truth", "pred")


@query()
def kmeans_choice(spark, sf):
    return ml.best_kmeans(ml.vectors(table(spark, sf, "embeddings"), "embedding").select("vec_id", "features"), range(3, 11), 20)


@query()
def few_label_curve(spark, sf):
    return ml.few_label_curve(table(spark, sf, "embeddings"), "label", "vec_id", "embedding", [3, 6, 12, 24], 30)


_N = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_ALPHA = [_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240]
_ECC, _RADIUS = 2 * _N**0.5 / (1 + _N), 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_SERIES = {k: " + ".join(f"{a!r}::double * {x}({2 * i} * xi) * {y}({2 * i} * eta)" for i, a in enumerate(_ALPHA, 1)) for k, x, y in (("e", "cos", "sinh"), ("n", "sin", "cosh"))}


@query(f"""with p as (select c_custkey, c_custkey % 360 - 179.5::double as lon, (c_nationkey * 6.5 - 78)::double as lat from customer),
  z as (select *, cast(floor((lon + 180) / 6) + 1 as integer) as zone from p), s as (select *, sin(radians(lat)) as q, radians(lon - (zone * 6 - 183)) as dl from z),
  t as (select *, sinh(atanh(q) - {_ECC!r}::double * atanh({_ECC!r}::double * q)) as t from s), x as (select *, atan2(t, cos(dl)) as xi, atanh(sin(dl) / sqrt(1 + t * t)) as eta from t)
  select c_custkey, zone, round(500000 + {_RADIUS!r}::double * (eta + {_SERIES["e"]}), 3) as easting, round(case when lat < 0 then 10000000 else 0 end + {_RADIUS!r}::double * (xi + {_SERIES["n"]}), 3) as northing from x""")
def utm_projection(spark, sf):
    lon, lat = F.pmod("c_custkey", F.lit(360)) - 179.5, (F.col("c_nationkey") * 6.5 - 78).cast("double")
    e, n = G.utm(lon, lat)
    return table(spark, sf, "customer").select("c_custkey", G.utm_zone(lon).alias("zone"), F.round(e, 3).alias("easting"), F.round(n, 3).alias("northing"))


def _rich(spark, sf):
    return cells(spark, sf).where("v > 36000").select("r", "c")


@query()
def raster_components(spark, sf):
    return G.components(_rich(spark, sf))


@query()
def fill_holes(spark, sf):
    return G.fill_holes(_rich(spark, sf), 40, 40)


@query()
def field_outlines(spark, sf):
    o = G.outlines(_rich(spark, sf))
    return o.select("component", F.size("ring").alias("corners"), J.ring_area(F.col("ring")).alias("area"), J.ring_area(G.convex_hull(F.col("ring"))).alias("hull_area"), F.size(G.simplify(F.col("ring"), 0.5)).alias("simple_corners"))


@query()
def grown_field(spark, sf):
    li = table(spark, sf, "lineitem")
    r, c = F.pmod("l_partkey", F.lit(40)).cast("int"), F.pmod(F.floor(F.col("l_orderkey") / 7), F.lit(40)).cast("int")
    cube = li.groupBy(r.alias("r"), c.alias("c"), F.month("l_shipdate").alias("month")).agg(F.avg("l_discount").alias("v"))
    _, quality, threshold = G.grow_with_retry(cube, 20, 20, 40, 40)
    return quality.withColumn("threshold", F.lit(threshold))


@query()
def visiting_tours(spark, sf):
    n = table(spark, sf, "nation").withColumn("x", (F.col("n_nationkey") * 7 % 25).cast("double")).withColumn("y", (F.col("n_nationkey") * 11 % 23).cast("double"))
    return G.tours(n, "n_regionkey", "n_nationkey", "x", "y")


from granary.plans import observations  # noqa: E402,F401  registers further queries
