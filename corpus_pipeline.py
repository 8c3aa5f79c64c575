"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``; the last returns the pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cnvspark.llm.common import free, importable, kept, scratch, table
from cnvspark.llm.decontamination import decontaminate
from cnvspark.llm.near_dedup import drop_near_duplicates
from cnvspark.llm.packing import pack_documents
from cnvspark.llm.pii import sanitize
from cnvspark.llm.tokens import tokenizer_path
from cnvspark.llm.toxicity import fit_toxicity, score_toxicity

#: Scores from here on are toxic.
TOXIC = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below :data:`TOXIC`; a null text is kept."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    (score,) = free(docs, "_toxicity")
    return score_toxicity(docs, model, score_col=score).where(F.col(score) < TOXIC).drop(score)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of least id."""
    importable(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verified overlap with a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), keep=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data generalised and terms that give it away removed; ``n_chars`` follows the text."""
    importable(spark)
    own = [c for c in docs.columns if c.lower() in ("spans", "clean")]  # columns of the table that the operator would replace
    aside = dict(zip(own, free(docs, *(f"_own_{c}" for c in own)), strict=True))
    rows = sanitize(docs.withColumnsRenamed(aside)).withColumn("text", F.col("clean")).drop("spans", "clean").withColumnsRenamed({v: k for k, v in aside.items()})
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    importable(spark)
    return pack_documents(docs, tokenizer_path(), capacity=1024, end_id=0)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark):
        for name, stage in STAGES:
            with scratch(spark):
                docs = kept(stage(spark, docs, sf_dir), name)
    return docs


#: The stages learn, align and encode in ways that SQL cannot express.
ORACLE_SQL = None
