"""The registered queries of this package and their SQL."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, golden, jaccard, langid, linededup, quality, sharding, substring, tokenfiles, vectorcodes, warc, wordpiece
from .common import crc32_text, freed, materialize, scratch_path, table
from .oracles import ORACLE_SQL  # noqa: F401


def held_out_rows(doc_id="doc_id") -> F.Column:
    """Whether crc32(doc_id as text) mod 5 is 0; a null id is not held out and never learned from."""
    return F.coalesce(crc32_text(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def learned_rows(doc_id="doc_id") -> F.Column:
    """Rows that a language model may learn from: crc32(doc_id as text) mod 5 is not 0."""
    return crc32_text(F.col(doc_id).cast("string")) % 5 != 0


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), [1.0] * 8)


#: In the fixity drill of op3, one record of so many is damaged in the second replica.
DRILL = 41


def damaged(member: bytes) -> bytes:
    """The stored bytes of a record, in one of DRILL cases with a flipped bit in the middle."""
    if zlib.crc32(member) % DRILL:
        return member
    at = len(member) // 2
    return member[:at] + bytes([member[at] ^ 1]) + member[at + 1 :]


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages twice, flips bits in some stored records of the second replica, and audits the files. One row a page,
    with the place and hash of its record in the first replica and what the audit says of it; a row without page_id for each
    index record that is not intact."""
    paths = [scratch_path(spark, "replica") for _ in range(2)]
    warc.write(warc.archive(table(spark, sf_dir, "pages")), paths[0], dealt=True)
    freed(spark)
    warc.copy(spark, *paths, damaged)
    one, two = (materialize(warc.leaves(spark, path), "leaves") for path in paths)
    found = warc.audit(one, two).where("state <> 'extra'").select(F.col("file").alias("_f"), F.col("seq").alias("_s"), F.col("state").alias("_state"))
    joined = one.join(found, (F.col("file") == F.col("_f")) & (F.col("seq") == F.col("_s")), "left").withColumn("state", F.coalesce("_state", F.lit("intact")))
    joined = joined.where((F.col("record_id") != warc.INDEX_ID) | (F.col("state") != "intact"))
    return joined.select(F.expr("try_cast(record_id as bigint)").alias("page_id"), "file", "seq", "offset", "length", F.col("hash").alias("sha256"), "state")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = substring.passages(table(spark, sf_dir, "documents"))
    return spans.select("doc_id", "first_doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("first_start").cast("long").alias("first_start"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = docs.where(learned_rows())
    named = langid.predict(docs.select("doc_id", "text"), langid.fit(learned))
    return named.select("doc_id", held_out_rows().alias("held_out"), "language.lang_pred", "language.score")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfiles.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenfiles.read_checksums(spark, path)


def word_vocabulary() -> list[tuple[bytes, bool]]:
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).get_vocab()
    return wordpiece.word_end_vocabulary(list(tokens), wordpiece.byte_alphabet(), special=("<|startoftext|>", "<|endoftext|>"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), word_vocabulary())


def op11_golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = golden.golden(table(spark, sf_dir, "clients"), F.coalesce("master_id", "client_id"))
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("balance_cents")
    return records.select("cluster_id", "n_records", "n_stale", "name", "email", "segment", "city", "nation_id", cents, "name_from", "email_from", "segment_from", "balance_from", "address_from")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.remove(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "lines.n_lines", "lines.n_dropped", F.sha2(F.encode("lines.text", "UTF-8"), 256).alias("kept_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vectorcodes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_sharding, op3_warc_fixity, op4_substring_dedup, op5_language_id, op6_decontamination, op7_jaccard_join, op8_byte_bpe, op9_repair_files, op10_token_counts, op11_golden_records, op12_line_dedup, op13_vector_codes)}
