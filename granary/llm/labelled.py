"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.plans.staging import stage


def remainder(id_col: str, of: int) -> Column:
    """crc32 of an id as text, modulo `of`; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))) % of


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, usable: Column, per_class: int) -> DataFrame:
    """Staged (doc_id, text, y): up to per_class rows of each class, in the order of a hash of the id.

    Only rows of labels that `usable` admits and whose label is 0 or 1 count; an
    id with both labels counts as 1, and of rows that share an id one text (the
    greatest) is taken. The bound on the sample makes it safe to broadcast the ids.
    """
    known = labels.where(usable & F.col(target).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    order = [F.xxhash64(F.col("doc_id")), "doc_id"]
    picked = known.where("y = 0").orderBy(*order).limit(per_class).union(known.where("y = 1").orderBy(*order).limit(per_class))
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    return stage(texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("y").alias("y")), "labelled")
