"""Data sets for plots, as tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import signed_log10
from cnvspark.operators import gcbias, stats


def gc_scatter(df: DataFrame, n: int = 25_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """LRR and zygosity against GC, at most ``n`` probes of each copy number, and the fitted line."""
    some = stats.sample_cap(df.select("cn_in", "probe", "perc_gc", "lrr", "zyg"), ["cn_in"], ["probe"], n, seed)
    return some, gcbias.fit_gc(df)


def zyg_lrr_scatter(df: DataFrame, fits: DataFrame, n: int = 25_000, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Zygosity against LRR, at most ``n`` probes of each copy number, and boxes of two SDs around the states."""
    some = stats.sample_cap(df.select("cn_in", "probe", "lrr", "zyg"), ["cn_in"], ["probe"], n, seed)
    box = fits.select("*", *(e.alias(n) for n, e in (("lrr_low", F.col("lrr_mean") - 2 * F.col("lrr_sd")), ("lrr_high", F.col("lrr_mean") + 2 * F.col("lrr_sd")), ("zyg_low", F.col("zyg_mean") - 2 * F.col("zyg_sd")), ("zyg_high", F.col("zyg_mean") + 2 * F.col("zyg_sd")))))
    return some, box


def cn_transitions(df: DataFrame) -> DataFrame:
    """Unmasked probes by input and output copy number."""
    return df.where(~F.col("masked")).groupBy("cn_in", "cn_out").agg(F.count(F.lit(1)).alias("n"))


def depth_histogram(bins: DataFrame) -> DataFrame:
    """Bins by rounded count."""
    return bins.groupBy(F.rint("count").cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def depth_quantiles(called: DataFrame, by: str = "cn", quantiles: tuple[float, ...] = (0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(by, q, value): box-plot quantiles of the counts of called bins by copy number. Equal counts are merged first, and a quantile is
    the least count whose running share reaches it, so no task holds the bins of a copy number.
    """
    merged = called.groupBy(by, "count").agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(by).orderBy("count").rowsBetween(Window.unboundedPreceding, 0)
    rows = merged.withColumns({"_run": F.sum("_n").over(order), "_all": F.sum("_n").over(Window.partitionBy(by))})
    wanted = F.explode(F.array(*(F.lit(float(q)) for q in quantiles)))
    reached = F.col("_run") >= F.greatest(F.col("q") * F.col("_all"), F.lit(1))
    return rows.withColumn("q", wanted).where(reached).groupBy(by, "q").agg(F.min("count").alias("value"))


def depth_densities(bins: DataFrame, mix: list[tuple[float, float, float]]) -> DataFrame:
    """(bin, share, cn1, cn2, ..., total): the observed share of each rounded count, and each copy number's curve of the model (weight,
    mean, SD) and their sum on the same grid, from the least to the greatest count.
    """
    seen = depth_histogram(bins)
    span = seen.agg(F.min("bin").alias("low"), F.max("bin").alias("high"), F.sum("n").alias("all")).where("low is not null")
    grid = span.select(F.explode(F.sequence("low", "high")).alias("bin"), "all")  # a row for each count in range
    full = grid.join(seen, "bin", "left").select("bin", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))
    curve = lambda w, m, s: F.lit(w / (s * math.sqrt(2 * math.pi))) * F.exp(-0.5 * F.pow((F.col("bin") - m) / s, F.lit(2.0)))
    rows = full.withColumns({f"cn{k}": curve(*part) for k, part in enumerate(mix, 1)})
    return rows.withColumn("total", sum((F.col(f"cn{k}") for k in range(1, len(mix) + 1)), F.lit(0.0)))


def size_vs_score(svs: DataFrame) -> DataFrame:
    """Variants with probes and likelihood, and the lines of 10, 100 and 1000 times likelier a probe."""
    return svs.select("n_probes", "rel_ll", *((F.lit(math.log(10**i)) * F.col("n_probes")).alias(f"iso{i}") for i in (1, 2, 3)))


def uniqueness_scatter(scores: DataFrame) -> DataFrame:
    """Own against best other score, on a signed log scale."""
    return scores.select("sv", signed_log10(F.col("qrll")).alias("x"), signed_log10(F.col("max_trll")).alias("y"))
