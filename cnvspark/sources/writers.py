"""Writers: Parquet tables in fixed column orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import alias_key, blind_alias

# Column orders of the tables.
PROBE_COL = "chrom start pos prb_name is_na strand lrr baf as_in cn_in inf_in lrr_raw baf_raw hs as_out cn_out inf_out cnc loh".split()
SV_COL = "chrom start end sample sv_id strand lrr_mean lrr_sd zyg_mean zyg_sd as_in cn_in as_out cn_out cnc loh n_probes n_inf span mdl_ll sv_ll rel_ll cn_clc cn_p flank_start flank_end".split()
CMP_COL = [*SV_COL, *"region_id qrll min_trll max_trll min_trll_smp max_trll_smp ovlp_smp".split()]


def in_order(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of a table in its fixed order; missing ones are NULL, others are left out."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def round_svs(df: DataFrame, places: int = 3) -> DataFrame:
    """Means and SDs rounded for output."""
    return df.withColumns({c: F.round(c, places) for c in ("lrr_mean", "lrr_sd", "zyg_mean", "zyg_sd") if c in df.columns})


def write_probes(df: DataFrame, path: str) -> None:
    """Probe table by sample and chromosome, sorted by position in each file; both partition the folders."""
    extra = [c for c in ("sample", "log_ep") if c in df.columns]
    rows = in_order(df, PROBE_COL).columns
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in rows), *extra).repartition("sample", "chrom").sortWithinPartitions("sample", "chrom", "pos").write.mode("overwrite").partitionBy("sample", "chrom").parquet(path)


def write_svs(df: DataFrame, path: str) -> None:
    """Variant table."""
    round_svs(in_order(df, SV_COL)).write.mode("overwrite").parquet(path)


def write_compare(df: DataFrame, path: str) -> None:
    """Composite variant table, sorted by region and position."""
    round_svs(in_order(df, CMP_COL)).orderBy("region_id", "chrom", "start", "end").write.mode("overwrite").parquet(path)


def write_model(segments: DataFrame, bins: DataFrame, path: str) -> None:
    """Segments and bins of a depth model."""
    segments.write.mode("overwrite").parquet(f"{path}/segments")
    bins.write.mode("overwrite").parquet(f"{path}/bins")


def save_model(tables: dict[str, DataFrame], path: str) -> None:
    """Fitted tables, each as Parquet below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """Fitted tables."""
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def group_manifest(samples: DataFrame, seed: int, group: str | None = None) -> DataFrame:
    """Samples with their blinded aliases, which differ within a group (all samples, or those of equal ``group``): samples are
    numbered by the order of their seeded hashes. A group is the samples of an experiment.
    """
    by = [group] if group else []
    named = samples.select(*by, "sample").distinct().withColumn("_key", alias_key(F.col("sample").cast("string"), seed))
    numbered = named.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_key", "sample")) - 1)
    return numbered.select(*by, "sample", blind_alias(F.col("_n")).alias("alias"))


def write_group_manifest(samples: DataFrame, path: str, seed: int) -> None:
    """The samples of a group with their aliases."""
    group_manifest(samples, seed).write.mode("overwrite").parquet(path)
