"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize, shared_dir
from panelweave.llm import alignment, bpe, exact_dedup, langid, line_dedup, mixing, ordinal, outliers, simhash, suffix_dedup, url_filter, vector_codes, warc
from panelweave.sources.tables import table


def op1_mcd_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdicts of all documents, judged within their language and source."""
    return outliers.judge(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents; those held out and rows without a language are not learned from."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.is_held_out()))
    found = langid.identify(docs.withColumn("_id", F.struct("doc_id", langid.is_held_out().alias("held_out"))), model, "_id")
    return found.select("_id.doc_id", F.coalesce("_id.held_out", F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents; the largest id stays."""
    return exact_dedup.group_texts(table(spark, sf_dir, "documents"), keep="largest")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the scores of a model of labelled urls, for every page."""
    return url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents are repeated, mixed and written; the result tells where each copy went."""
    mixed = materialize(mixing.replicate(table(spark, sf_dir, "documents")), "mixed")
    return mixed.select("doc_id", "source", *mixing.ADDED).withColumn("rate", F.round("rate", 9))


def op6_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 toxic, 1 of low quality, 2 neither; kept when more likely than not of grade 2."""
    ratings = table(spark, sf_dir, "labels").withColumn("grade", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2))
    docs = table(spark, sf_dir, "documents")
    return ordinal.grade_documents(docs, ordinal.fit(docs, ratings))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and the classes that links of three bits or fewer reach."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents before, and without, those that an earlier document holds."""
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents that a string of 100 bytes covers which also starts earlier."""
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents and what they decode to, as digests."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens of two tokenizers over all documents; groups as digests."""
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    return alignment.align(table(spark, sf_dir, "documents"), a, b, groups_as=digest).withColumnRenamed("groups", "groups_sha256")


def op12_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives, and what the archives say when they are read back."""
    path = f"{shared_dir(spark)}/panelweave/warc-{uuid.uuid4().hex}"
    warc.write_archives(table(spark, sf_dir, "pages"), path, min_bytes=0)
    records = warc.read_archives(spark, path, payloads=False)
    page, target = warc.row_id(F.col("record_id")).alias("page_id"), warc.row_id(F.col("refers_to")).alias("refers_to")
    return records.select(page, "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), target)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of all whole and finite vectors, by codebooks that all of them formed."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_mcd_outliers": op1_mcd_outliers,
    "op2_language_mixture": op2_language_mixture,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_url_filter": op4_url_filter,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_ordinal_quality": op6_ordinal_quality,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_token_alignment": op11_token_alignment,
    "op12_warc_zstd": op12_warc_zstd,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_poisson_mixing": mixing.ORACLE_SQL,
    "op8_line_dedup": line_dedup.ORACLE_SQL,
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op12_warc_zstd": warc.ORACLE_SQL,
    "op13_vector_codes": vector_codes.ORACLE_SQL,
}
