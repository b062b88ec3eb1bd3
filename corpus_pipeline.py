"""The corpus pipeline: language identification, near-duplicate groups, repeated passages, benchmark passages, tokens.

Every stage works on all rows that the stage before kept; an empty table passes all of them. Other columns are kept,
whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoaccord.llm import bpe, decontaminate, jaccard, langid, substring
from geoaccord.llm.common import WORD_SPACE, fresh, materialize, packed, table
from geoaccord.llm.queries import learned_rows


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised: a letter, and a score of a half or more. Null and empty texts
    go; rows that repeat, and rows with a null id, are documents like others; the model learns from the rows with an id
    and a language that are not held out."""
    columns, name = docs.columns, fresh(docs, "language_of")
    named = langid.predict(docs, langid.fit(docs.where(learned_rows())), out_col=name)
    return named.where((F.col(f"{name}.lang_pred") != langid.UND) & (F.col(f"{name}.score") >= 0.5)).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate group, the one with the least id. Rows with a null id stay, and so do
    texts without a word. Different texts of one id are documents of their own: where an id repeats, rows are numbered
    in the order of id and text, and of equal rows one stays."""
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if again.isEmpty():
        return _without_copies(docs, "doc_id")
    name = fresh(docs, "row_number_of")
    none = docs.where("doc_id is null")
    ordered = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    numbered = materialize(ordered.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return _without_copies(numbered, name).drop(name).union(none)


def _without_copies(docs: DataFrame, key: str) -> DataFrame:
    gone = jaccard.join(docs, id_col=key).where("doc_id <> component_id").select(F.col("doc_id").alias("gone"))
    rows = packed(docs, key=F.col(key)).join(materialize(gone, "gone"), F.col("key") == F.col("gone"), "left_anti")
    return rows.select("row.*")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut later occurrences of repeated passages out of the texts; a text that loses all its words goes, and so does
    one that has none. Rows with a null id stay whole; rows that repeat id and text are one document and stay both; texts
    of one id are documents of their own."""
    cut = substring.remove(docs)
    return cut.where(F.translate("text", WORD_SPACE, "") != "").withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item within its error budget, whatever their id; a null text holds
    none."""
    name = fresh(docs, "contaminated")
    flagged = decontaminate.flag(docs, table(spark, sf_dir, "benchmark"), out_col=name)
    return flagged.where(~F.col(name)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts that remain, a row each; digests of the ids and of what they decode to (null: the empty text)."""
    return bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language),
    ("jaccard_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", benchmark_passages),
    ("byte_bpe", tokens),
]

#: Hashing, training and byte-pair merges are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written and read again before the next stage."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
