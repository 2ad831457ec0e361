"""Samples whose draws are hashes of the rows, so that they repeat and need no order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(key: Column, seed: str | Column) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(":"), seed.cast("string") if isinstance(seed, Column) else F.lit(seed)))


def capped(df: DataFrame, group: list[str], key: str, most: int, seed: str = "0") -> DataFrame:
    """At most `most` rows of each group, without replacement."""
    w = Window.partitionBy(*group).orderBy(draw(F.col(key), seed), key)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def few_labels(df: DataFrame, cls: str, key: str, n: int, seed: str = "0") -> DataFrame:
    """n rows with one of each class at least, the rest by draw."""
    d = draw(F.col(key), seed)
    first = df.withColumn("_c", F.row_number().over(Window.partitionBy(cls).orderBy(d, key)))
    return first.orderBy(F.when(F.col("_c") == 1, 0).otherwise(1), d, key).limit(n).drop("_c")


def strips(df: DataFrame, key: str, n: int, test: int, seed: str = "0") -> DataFrame:
    """strip by key modulo n, and role: the first `test` rows of each strip by draw are test, the others train."""
    s = df.withColumn("strip", F.pmod(F.col(key), F.lit(n)).cast("int"))
    w = Window.partitionBy("strip").orderBy(draw(F.col(key), seed), key)
    return s.withColumn("role", F.when(F.row_number().over(w) <= test, "test").otherwise("train"))
