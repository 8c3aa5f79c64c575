"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cnvspark.llm import quality_rules, spelling, vector_codes
from cnvspark.llm.common import shared_path, table
from cnvspark.llm.decontamination import decontaminate
from cnvspark.llm.fingerprints import fingerprint_documents
from cnvspark.llm.html_extraction import extract_pages
from cnvspark.llm.labelled import held_out
from cnvspark.llm.near_dedup import near_duplicates
from cnvspark.llm.packing import pack_documents
from cnvspark.llm.pii import SECRET, TERM, count_kind, sanitize, span_text
from cnvspark.llm.quality import fit_quality, score_quality
from cnvspark.llm.sharding import shard_documents
from cnvspark.llm.token_files import read_token_files, with_starts, write_token_files
from cnvspark.llm.toxicity import fit_toxicity, score_toxicity
from cnvspark.llm.tokens import tokenizer_path


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens; one row for each piece."""
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "cost")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards whose row counts are at most one apart."""
    rows = shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = score_quality(docs.select("doc_id", "text"), fit_quality(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), F.when(F.col("quality_score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent weighted samples of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"), samples=32)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its overlaps with benchmark items."""
    rows = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "contaminated", F.size("items").alias("n_items"), F.transform("items", lambda x: x["item_id"]).alias("items"), "items.start", "items.end")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    rows = extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back."""
    manifest = write_token_files(table(spark, sf_dir, "documents"), shared_path(spark, "tokens"), tokenizer_path(), end_id=2)
    rows = with_starts(read_token_files(manifest), manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    rows = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).alias("predicted"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and terms that give it away, in every document."""
    rows = sanitize(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] < 4)
    return rows.select(
        "doc_id",
        *(count_kind(F.col("spans"), i).alias(f"n_{k}") for i, k in enumerate(("email", "ip", "card", "phone"))),
        F.sha2(span_text(base).cast("binary"), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        count_kind(F.col("spans"), SECRET).alias("n_secret"),
        count_kind(F.col("spans"), TERM).alias("n_term"),
    )


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the corpus that occur twice or more, with the form that each is a variant of."""
    return spelling.group_spellings(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every usable vector."""
    return vector_codes.quantise(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures of every document and the verdict of the rules on it."""
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *(F.col(f"rules.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_dedup": op2_near_dedup,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_fingerprints": op5_fingerprints,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_token_files": op8_token_files,
    "op9_toxicity": op9_toxicity,
    "op10_pii": op10_pii,
    "op11_spelling": op11_spelling,
    "op12_vector_codes": op12_vector_codes,
    "op13_quality_rules": op13_quality_rules,
}

#: DuckDB SQL where it can express the operator's own rows.
ORACLES: dict[str, str] = {"op11_spelling": spelling.sql(), "op12_vector_codes": vector_codes.sql(), "op13_quality_rules": quality_rules.sql()}
