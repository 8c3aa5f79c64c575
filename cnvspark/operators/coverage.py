"""Fragment coverage in bins, bin runs, and depth models."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import bin_prob_sql, flag_ok, proper_template


def filter_alignments(aln: DataFrame, *, require: int = 32, forbid: int = 3868, min_mapq: int = 0, max_tlen: int = 1000) -> DataFrame:
    """Alignments of proper templates."""
    return aln.where(flag_ok(F.col("flag"), F.col("mapq"), require, forbid, min_mapq) & proper_template(F.col("rnext"), F.col("tlen"), max_tlen))


def fragment_coverage(aln: DataFrame, bin_size: int = 5000) -> DataFrame:
    """(chrom, bin, count): a fragment adds 1 in total, shared between the bins that it covers by bases.

    ``bin`` counts from 0; counts are rounded to 0.01 and empty bins are left out. What a fragment carries past the
    last touched bin is kept, so the sum is the number of fragments.
    """
    first, last = F.floor((F.col("pos") - 1) / bin_size), F.floor((F.col("pos") + F.col("tlen") - 2) / bin_size)
    rows = aln.select(F.col("rname").alias("chrom"), F.col("pos"), F.col("tlen"), F.explode(F.sequence(first, last)).alias("bin"))
    low = F.greatest(F.col("pos") - 1, F.col("bin") * bin_size)
    high = F.least(F.col("pos") - 1 + F.col("tlen"), (F.col("bin") + 1) * bin_size)
    return rows.groupBy("chrom", "bin").agg(F.round(F.sum((high - low) / F.col("tlen")), 2).alias("count"))


_REGION = re.compile(r"^(?P<chrom>[^:]+):(?P<start>[0-9,]+)-(?P<end>[0-9,]+)(?:/(?P<cn>[0-9.]+))?$")


def parse_region(region: str) -> tuple[str, int, int, float]:
    """``chrom:start-end/cn`` as its parts; the copy number is 2 if left out."""
    m = _REGION.match(region)
    if not m:
        raise ValueError(f"not a region: {region!r}; expected chrom:start-end/cn")
    return m["chrom"], int(m["start"].replace(",", "")), int(m["end"].replace(",", "")), float(m["cn"] or 2)


def region_stats(bins: DataFrame, region: str, bin_size: int = 5000) -> DataFrame:
    """Mean and sample SD of the bins that lie wholly inside a region (one row)."""
    chrom, start, end, cn = parse_region(region)
    inside = bins.where((F.col("chrom") == chrom) & (F.col("bin") * bin_size + 1 >= start) & ((F.col("bin") + 1) * bin_size <= end))
    return inside.agg(F.count(F.lit(1)).alias("n"), F.avg("count").alias("mean"), F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("sd")).withColumn("cn", F.lit(cn))


def bin_runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows with ``run``: neighbouring bins of equal ``value`` within ``by``."""
    order = Window.partitionBy(*by).orderBy("bin")
    fresh = F.when((F.col("bin") - F.lag("bin").over(order) == 1) & F.col(value).eqNullSafe(F.lag(value).over(order)), 0).otherwise(1)
    return df.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def collapse_bins(df: DataFrame, by: list[str], value: str, bin_size: int = 5000) -> DataFrame:
    """Segments from runs of bins: bounds, value, bins, mean and SD of the counts."""
    return bin_runs(df, by, value).groupBy(*by, "run").agg((F.min("bin") * bin_size).alias("start"), ((F.max("bin") + 1) * bin_size).alias("end"), F.first(value).alias(value), F.count(F.lit(1)).alias("n_bins"), F.avg("count").alias("mean"), F.coalesce(F.stddev_samp("count"), F.lit(0.0)).alias("sd"))


def constrained_mixture(hist: DataFrame, k: int, a0: float, s0: float, iters: int = 30, tol: float = 1e-7) -> list[tuple[float, float, float]]:
    """(weight, mean, sd) of ``k`` Gaussians with means a, 2a, ... ka and free SDs, by EM on a (x, n) histogram.

    The histogram is distinct counts, however many bins there are; each step is one aggregation of it, and only the
    3k sums come to the driver.
    """
    hist = hist.select(F.col("x").cast("double"), F.col("n").cast("double")).cache()
    w, a, s = [1.0 / k] * k, a0, [s0 * (j + 1) for j in range(k)]
    total = hist.agg(F.sum("n")).first()[0] or 0.0
    for _ in range(iters if total else 0):
        dens = [F.lit(w[j] / s[j]) * F.exp(-0.5 * ((F.col("x") - a * (j + 1)) / s[j]) ** 2) for j in range(k)]
        whole = sum(dens[1:], dens[0]) + F.lit(1e-300)
        z = [F.col("n") * d / whole for d in dens]
        got = hist.agg(*(F.sum(z[j]).alias(f"z{j}") for j in range(k)), *(F.sum(z[j] * F.col("x")).alias(f"x{j}") for j in range(k)), *(F.sum(z[j] * F.col("x") ** 2).alias(f"q{j}") for j in range(k))).first()
        top = sum((j + 1) * got[f"x{j}"] / s[j] ** 2 for j in range(k))
        new_a = top / max(sum((j + 1) ** 2 * got[f"z{j}"] / s[j] ** 2 for j in range(k)), 1e-300)
        for j in range(k):
            m, zj = new_a * (j + 1), got[f"z{j}"]
            if zj > 1e-9:
                s[j] = max((max(got[f"q{j}"] - 2 * m * got[f"x{j}"] + m * m * zj, 0.0) / zj) ** 0.5, 1e-3)
            w[j] = zj / total
        done, a = abs(new_a - a) <= tol * max(1.0, abs(a)), new_a
        if done:
            break
    hist.unpersist()
    return [(w[j], a * (j + 1), s[j]) for j in range(k)]


def segment_cn_weights(bins: DataFrame, segments: DataFrame, mix: list[tuple[float, float]], by: list[str]) -> DataFrame:
    """Relative likelihood of each copy number for each segment, from the bin probabilities with an SD that is at least
    the segment's own. ``mix`` are (mean, sd) for 1, 2, ... copies.
    """
    rows = bins.join(segments.select(*by, "run", F.col("sd").alias("seg_sd")), [*by, "run"])
    out = rows
    logs = []
    for j, (mean, sd) in enumerate(mix, 1):
        out = out.withColumn(f"sd{j}", F.rint(F.greatest(F.lit(float(sd)), F.col("seg_sd"))))
        logs.append(F.sum(F.ln(F.expr(bin_prob_sql("count", repr(float(mean)), f"greatest(sd{j}, 1.0)")))).alias(f"ll{j}"))
    summed = out.groupBy(*by, "run").agg(*logs)
    best = F.greatest(*(F.col(f"ll{j}") for j in range(1, len(mix) + 1))) if len(mix) > 1 else F.col("ll1")
    return summed.select(*by, "run", *(F.exp(F.col(f"ll{j}") - best).alias(f"cn{j}") for j in range(1, len(mix) + 1)))


def sex_model(spark: SparkSession, chroms: list[str], sex: str, end: int = 275_000_000) -> DataFrame:
    """Whole-chromosome copy numbers of a male (M) or female (F) sample; chromosomes without copies are left out."""
    if sex not in ("M", "F"):
        raise ValueError("sex must be M or F")
    names = spark.createDataFrame([(c,) for c in chroms], "chrom string")
    return names.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(end).cast("long").alias("end"), sex_copies(F.col("chrom"), sex).alias("cn")).where("cn > 0")


def sex_copies(chrom: Column, sex: str) -> Column:
    """Copies of a chromosome by sex."""
    return F.when(chrom == "chrX", 1 if sex == "M" else 2).when(chrom == "chrY", 1 if sex == "M" else 0).otherwise(2)
