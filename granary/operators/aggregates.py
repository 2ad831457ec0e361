"""Grouped summaries, votes, thresholds and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_stats(df: DataFrame, by: list[str], values: list[str], used: Column | None = None, least_share: float = 0.0) -> DataFrame:
    """Count, share of used rows, and mean, median and population deviation of each value over them."""
    used = F.lit(True) if used is None else used
    aggs = [F.count(F.when(used, 1)).alias("used"), (F.count(F.when(used, 1)) / F.count("*")).alias("share")]
    for v in values:
        x = F.when(used, F.col(v))
        aggs += [F.avg(x).alias(f"{v}_mean"), F.median(x).alias(f"{v}_median"), F.stddev_pop(x).alias(f"{v}_std")]
    return df.groupBy(*by).agg(*aggs).where((F.col("used") > 0) & (F.col("share") >= least_share))


def majority(df: DataFrame, by: list[str], code: str) -> DataFrame:
    """(by, majority, n, agreement): the most frequent code, the least on ties, and its share."""
    n = df.groupBy(*by, code).agg(F.count("*").alias("k"))
    out = n.groupBy(*by).agg(F.max(F.struct(F.col("k"), (-F.col(code)).alias("c"))).alias("m"), F.sum("k").alias("n"))
    return out.select(*by, (-F.col("m.c")).alias("majority"), "n", (F.col("m.k") / F.col("n")).alias("agreement"))


def class_areas(df: DataFrame, code: str, codes: DataFrame, area: float = 0.01) -> DataFrame:
    """Pixels, area and share of every code of codes (code, name), those without pixels too."""
    n = df.groupBy(F.col(code).alias("code")).agg(F.count("*").alias("pixels"))
    total = df.agg(F.count("*").alias("total"))
    out = codes.join(n, "code", "left").join(F.broadcast(total), how="cross").withColumn("pixels", F.coalesce("pixels", F.lit(0)).cast("long"))
    return out.select("code", "name", "pixels", F.round(F.col("pixels") * area, 1).alias("hectares"), F.round(F.try_divide(F.col("pixels"), F.col("total")), 3).alias("share"))


def otsu(df: DataFrame, value: str, bins: int = 256, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """(threshold): the centre of the bin that parts the values between two percentiles into the two most distant classes."""
    lim = df.agg(F.expr(f"percentile(`{value}`, {low})").alias("lo"), F.expr(f"percentile(`{value}`, {high})").alias("hi"))
    d = df.select(F.col(value).alias("v")).join(F.broadcast(lim), how="cross").where("v between lo and hi")
    b = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    hist = d.groupBy(b.alias("bin"), "lo", "hi").agg(F.count("*").alias("n"))
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    hist = hist.withColumn("mid", mid)
    # At most `bins` rows from here on.
    run = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    h = hist.withColumn("w0", F.sum("n").over(run)).withColumn("s0", F.sum(F.col("n") * F.col("mid")).over(run)).withColumn("w", F.sum("n").over(every)).withColumn("s", F.sum(F.col("n") * F.col("mid")).over(every))
    gap = F.col("s0") / F.col("w0") - F.try_divide(F.col("s") - F.col("s0"), F.col("w") - F.col("w0"))
    h = h.withColumn("between", F.col("w0") * (F.col("w") - F.col("w0")) * gap * gap)
    return h.orderBy(F.desc_nulls_last(F.round("between", 6)), "bin").limit(1).select(F.col("mid").alias("threshold"))


def quartiles(df: DataFrame, by: list[str], value: str) -> DataFrame:
    q = F.expr(f"percentile(`{value}`, array(0.25, 0.5, 0.75))")
    return df.groupBy(*by).agg(q.alias("q")).select(*by, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"))


def rank_average(df: DataFrame, by: list[str], value: str, out: str = "rank_avg") -> DataFrame:
    """Average rank of ties, cut to a whole number."""
    w = Window.partitionBy(*by)
    r = F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2
    return df.withColumn(out, F.floor(r).cast("int"))


def confusion(df: DataFrame, truth: str, pred: str, classes: list) -> DataFrame:
    """One row for each true class in the given order, one column n_<class> for each predicted one."""
    return df.groupBy(F.col(truth).alias("truth")).agg(*(F.count(F.when(F.col(pred) == c, 1)).alias(f"n_{c}") for c in classes))


def scores(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """(by, n, accuracy, balanced): balanced is the mean recall over the classes present in the truth."""
    hit = (F.col(truth) == F.col(pred)).cast("int")
    per = df.groupBy(*by, truth).agg(F.count("*").alias("k"), F.sum(hit).alias("h"))
    return per.groupBy(*by).agg(F.sum("k").alias("n"), (F.sum("h") / F.sum("k")).alias("accuracy"), F.avg(F.col("h") / F.col("k")).alias("balanced"))


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """n / (classes x count) of each class."""
    n = df.groupBy(cls).agg(F.count("*").alias("k"))
    t = n.agg(F.sum("k").alias("n"), F.count("*").alias("c"))
    return n.join(F.broadcast(t), how="cross").select(cls, (F.col("n") / (F.col("c") * F.col("k"))).alias("weight"))


def one_se_choice(table: DataFrame, name: str, score: str, size: str, n: int, baseline: str) -> DataFrame:
    """The smallest candidate whose score is within one standard error of the best; the baseline does not compete."""
    c = table.where(F.col(name) != baseline)
    top = c.agg(F.max(score).alias("top"))
    ok = c.join(F.broadcast(top), how="cross").where(F.col(score) >= F.col("top") - F.sqrt(F.col("top") * (1.0 - F.col("top")) / n))
    return ok.orderBy(size, name).limit(1).drop("top")


def agreement_table(df: DataFrame, columns: list[str], against: str) -> DataFrame:
    """(source, fields, agree, share) of each column against one, where both say something."""
    long = df.select(against, F.explode(F.array(*(F.struct(F.lit(c).alias("source"), F.col(c).alias("said")) for c in columns))).alias("x")).select(against, "x.*")
    long = long.where((F.coalesce(F.col("said"), F.lit("")) != "") & (F.coalesce(F.col(against), F.lit("")) != ""))
    return long.groupBy("source").agg(F.count("*").alias("fields"), F.sum((F.col("said") == F.col(against)).cast("int")).alias("agree"), F.avg((F.col("said") == F.col(against)).cast("double")).alias("share"))
