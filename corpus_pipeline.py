"""A training corpus from documents: toxicity, near duplicates, decontamination, personal data, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. `run` writes each stage's result to the shared
folder and reads it again, so a lost executor costs one stage at most.

Defined results of every stage: an empty table gives an empty one; further
columns pass through whatever their names; null and empty texts and repeated
rows are documents like others unless a stage says otherwise; texts of any
length are read whole.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import bpe, decontaminate, neardup, pii, toxicity
from granary.llm.arrow import appended, unused
from granary.llm.labelled import remainder
from granary.plans.staging import stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under one half; learned from the labels of rows that are not held out.

    Rows without text or id are scored like a text without a term; at exactly one half a document goes.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lex, weights = toxicity.fit(docs, labels, remainder("doc_id", 5) != 0)
    name = unused(docs.columns, "_toxicity")
    scored = appended(docs, "text", name, "double", pa.float64(), lambda texts: toxicity.scores(texts, lex, weights))
    return scored.where(F.col(name) < 0.5).drop(name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least id; rows without id stay.

    Of rows that share the least id, the one with the greatest text stays; a null text is a class of its own.
    """
    classes = neardup.near_duplicates(docs)
    classes = stage(classes.where("doc_id is not null").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "classes")
    kept = docs.join(stage(classes.where("not kept").select("doc_id"), "dropped"), "doc_id", "left_anti").select(docs.columns)
    repeated = stage(classes.where("kept and n > 1").select("doc_id"), "repeated")
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, "doc_id", "left_anti")
    some = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), F.coalesce("text", F.lit(""))).alias("row")).select("row.*")
    return once.select(docs.columns).union(some.select(docs.columns))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark; rows without text hold none, and blank items are in none."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_items(docs, items)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data, and n_chars of the new text; a null text stays null, with n_chars null."""
    out = pii.rewrite(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document; a null text counts as empty."""
    import public_tokenizers

    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("personal_data", replace_personal_data),
    ("byte_bpe", encode),
]

#: Edit distance, components and trained models are not for SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, name)
    return docs
