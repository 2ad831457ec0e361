"""Preparation of matrices and tables for models and reports: missing values, scaling, ordering, paging, text rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def complete_matrix(long: DataFrame, key: str, name: str, value: str, most_of_name: float = 0.5, most_of_key: float = 0.2) -> DataFrame:
    """(key, name, value) of a matrix without holes.

    Names missing for more than most_of_name of the entities go, then entities
    that miss more than most_of_key of the names left, then names that an entity
    left still misses. A missing value is a null or an absent row.
    """
    have = long.where(F.col(value).isNotNull()).select(key, name, value)
    everyone = long.select(key).distinct().agg(F.count("*").alias("_all"))

    def dense(rows: DataFrame, by: str, of: DataFrame, least: Column) -> DataFrame:
        return rows.groupBy(by).agg(F.count("*").alias("_n")).join(F.broadcast(of), how="cross").where(F.col("_n") >= least).select(by)

    names = dense(have, name, everyone, F.col("_all") * (1.0 - most_of_name) - 1e-9)
    have = have.join(names, name)
    n_names = names.agg(F.count("*").alias("_all"))
    keys = dense(have, key, n_names, F.col("_all") * (1.0 - most_of_key) - 1e-9)
    have = have.join(keys, key)
    whole = dense(have, name, keys.agg(F.count("*").alias("_all")), F.col("_all"))
    return have.join(whole, name).select(key, name, value)


def standardised(df: DataFrame, columns: list[str], train: Column, eps: float = 1e-6) -> DataFrame:
    """Columns less the mean of the training rows, over their population deviation plus eps; what is missing becomes 0."""
    stats = df.where(train).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    out = df.join(F.broadcast(stats), how="cross")
    return out.select(*(F.coalesce((F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + eps), F.lit(0.0)).alias(c) if c in columns else F.col(c) for c in df.columns))


def imputed(df: DataFrame, columns: list[str], train: Column) -> DataFrame:
    """Missing values of columns become the median of the training rows."""
    stats = df.where(train).agg(*(F.median(c).alias(f"_m_{c}") for c in columns))
    return df.join(F.broadcast(stats), how="cross").select(*(F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def two_classes(label: Column, one: str) -> Column:
    """The label where it is `one`, else not_<one>; null stays."""
    return F.when(label.isNull(), None).when(label == one, one).otherwise(f"not_{one}")


def pages(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """df with `page` from 0 and `place` on it from 0, in order within each group."""
    n = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return df.withColumn("page", F.floor(n / size).cast("int")).withColumn("place", (n % size).cast("int"))


def renumbered(members: DataFrame, cluster: str, curves: DataFrame, day: str, value: str) -> DataFrame:
    """members with their clusters numbered from 0 by the first day on which a cluster's curve is highest; curves: (cluster, day, value)."""
    top = curves.groupBy(cluster).agg(F.max_by(day, F.struct(F.col(value), -F.unix_date(F.col(day).cast("date")))).alias("_day"))
    # One row for each cluster.
    number = top.select(cluster, (F.row_number().over(Window.orderBy("_day", cluster)) - 1).alias("_number"))
    return members.join(F.broadcast(number), cluster).withColumn(cluster, F.col("_number")).drop("_number").select(members.columns)


def distinct_in_order(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """(value, first): each value with the order columns of the row that has it first."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("first")).select(value, *(F.col(f"first.{c}").alias(c) for c in order))


def majority_baseline(df: DataFrame, cls: str, strip: str) -> DataFrame:
    """(strip, truth, pred, n): each strip gets the most frequent class of the others, the least on ties."""
    part = df.groupBy(strip, cls).agg(F.count("*").alias("n"))
    whole = part.groupBy(cls).agg(F.sum("n").alias("t"))
    rest = part.select(strip).distinct().crossJoin(whole).join(part, [strip, cls], "left")  # strips x classes
    left = F.col("t") - F.coalesce("n", F.lit(0))
    pick = rest.groupBy(strip).agg(F.max_by(cls, F.struct(left, -F.col(cls))).alias("pred"))
    return part.join(pick, strip).select(strip, F.col(cls).alias("truth"), "pred", "n")


def placemark(name: Column, lon: Column, lat: Column, text: Column) -> Column:
    """One placemark of a KML document, for a text sink."""
    return F.concat(F.lit("<Placemark><name>"), escaped(name), F.lit("</name><description>"), escaped(text), F.lit("</description><Point><coordinates>"), F.format_string("%.6f,%.6f", lon, lat), F.lit("</coordinates></Point></Placemark>"))


def escaped(x: Column) -> Column:
    """Text with the characters that markup reserves as references; null as empty."""
    out = F.coalesce(x.cast("string"), F.lit(""))
    for c, name in (("&", "amp"), ("<", "lt"), (">", "gt"), ('"', "quot"), ("'", "#x27")):
        out = F.replace(out, F.lit(c), F.lit(f"&{name};"))
    return out


def table_row(cells: list[Column]) -> Column:
    """One row of a LaTeX table, for a text sink."""
    safe = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("--")), r"([&%$#_{}])", r"\\$1") for c in cells]
    return F.concat(F.concat_ws(" & ", *safe), F.lit(r" \\"))


def sheet_row(cells: list[Column]) -> Column:
    """One row of an HTML table, for a text sink."""
    return F.concat(F.lit("<tr>"), *(F.concat(F.lit("<td>"), escaped(c), F.lit("</td>")) for c in cells), F.lit("</tr>"))


def property_matrix(features: DataFrame, key: str, label: str, matrix: DataFrame, known: list[str]) -> DataFrame:
    """Rows of matrix whose entity has one of the known labels, with that label."""
    return matrix.join(features.where(F.col(label).isin(known)).select(key, label), key)
