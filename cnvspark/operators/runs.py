"""Runs of anomalous probes and the variants made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cnvspark.functions import scalar as S
from cnvspark.operators import stats


def _order(by: list[str]):
    return Window.partitionBy(*by).orderBy("pos", "probe")


def derive_changes(df: DataFrame) -> DataFrame:
    """Copy-number change and loss of heterozygosity of each probe; NULL where masked."""
    inf_out = F.when(F.col("allelism_out") <= 1, F.lit(False)).otherwise(F.col("inf_in"))
    return df.withColumn("inf_out", inf_out).withColumn("cnc", F.when(~F.col("masked"), F.col("cn_out") - F.col("cn_in"))).withColumn("loh_probe", F.when(~F.col("masked"), F.col("inf_out") != F.col("inf_in")))


def flag_anomalous(df: DataFrame) -> DataFrame:
    """Rows with ``anomalous``: unmasked, and copy number changed or allelism lower than before."""
    return df.withColumn("anomalous", ~F.col("masked") & ((F.col("cn_out") != F.col("cn_in")) | (F.col("allelism_out") < F.col("allelism_in"))))


def usable_index(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``uidx``, the number of the usable probe within ``by``; NULL where masked."""
    n = F.sum(F.when(~F.col("masked"), 1).otherwise(0)).over(_order(by).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("uidx", F.when(~F.col("masked"), n))


def anomalous_runs(df: DataFrame, by: list[str]) -> DataFrame:
    """Anomalous rows with ``run``: a new one where usable probes lie between, or the output copy number changes."""
    rows, order = df.where("anomalous"), _order(by)
    fresh = F.when((F.col("uidx") - F.lag("uidx").over(order) == 1) & (F.col("cn_out") == F.lag("cn_out").over(order)), 0).otherwise(1)
    return rows.withColumn("_fresh", fresh).withColumn("run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def two_level_runs(df: DataFrame, by: list[str], max_gap: int = 100_000) -> DataFrame:
    """Anomalous rows with ``run`` (any gap or change) and ``merged`` (gap also beyond ``max_gap`` base pairs)."""
    rows, order = anomalous_runs(df, by), _order(by)
    far = F.when((F.col("pos") - F.lag("pos").over(order) <= max_gap) & (F.col("cn_out") == F.lag("cn_out").over(order)), 0).otherwise(1)
    return rows.withColumn("_fresh", far).withColumn("merged", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def sub_run_count(df: DataFrame, by: list[str]) -> DataFrame:
    """Fine runs in each merged run."""
    return df.groupBy(*by, "merged").agg(F.count_distinct("run").alias("n_sub"))


def _evidence() -> list[Column]:
    changed = (F.col("cn_out") != F.col("cn_in")) | (F.col("inf_in") & ~F.col("inf_out"))
    return [F.count_if(changed).alias("n_probes"), F.count_if(F.col("inf_in")).alias("n_inf")]


def _spans() -> list[Column]:
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(F.col(c).cast("string"))), ",").alias(c)
    return [F.min("pos").alias("start"), F.max("pos").alias("end"), (F.max("pos") - F.min("pos") + 1).alias("span"), joined("cn_in"), joined("cn_out"), joined("cnc"), F.bool_or(F.col("allelism_out") < F.col("allelism_in")).alias("loh_run")]


def _means() -> list[Column]:
    zyg = F.when(F.col("inf_in"), F.col("zyg"))
    return [F.avg("lrr").alias("lrr_mean"), F.coalesce(F.stddev_samp("lrr"), F.lit(0.0)).alias("lrr_sd"), F.avg(zyg).alias("zyg_mean"), F.stddev_samp(zyg).alias("zyg_sd")]


def run_evidence(df: DataFrame, by: list[str]) -> DataFrame:
    """``n_probes``: changed, or informative in the model and no more; ``n_inf``: informative in the model."""
    return df.groupBy(*by, "run").agg(*_evidence())


def run_table(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Evidence, spans, means and ``more`` of each run in one aggregation."""
    return df.groupBy(*by, "run").agg(*_spans(), *_evidence(), *_means(), *more)


def filter_runs(runs: DataFrame, min_probes: int = 5, min_evidence: int = 7, min_rel_ll: float = 10.0) -> DataFrame:
    """Runs with enough probes, enough evidence and, where it is known, enough relative likelihood."""
    out = runs.where((F.col("n_probes") >= min_probes) & (F.col("n_probes") + F.col("n_inf") >= min_evidence))
    return out.where(F.col("rel_ll") >= min_rel_ll) if "rel_ll" in runs.columns else out


def keep_runs(df: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Probes of the runs that are left."""
    return df.join(runs.select(*by, "run"), [*by, "run"], "left_semi")


def run_spans(df: DataFrame, by: list[str]) -> DataFrame:
    """Bounds, span, sorted distinct copy numbers and changes, and whether allelism fell anywhere."""
    return df.groupBy(*by, "run").agg(*_spans())


def run_means(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean and SD of LRR, and of zygosity over probes that are informative in the model."""
    return df.groupBy(*by, "run").agg(*_means())


def flanks(df: DataFrame, by: list[str], runs: DataFrame, n: int = 10) -> DataFrame:
    """Each run's flanks: the usable probe ``n`` before its first and ``n`` after its last, cut to the chromosome."""
    usable, order = df.where(~F.col("masked")), _order(by)
    whole = Window.partitionBy(*by)
    rows = usable.select(*by, "pos", "probe", F.coalesce(F.lag("pos", n).over(order), F.min("pos").over(whole)).alias("_before"), F.coalesce(F.lead("pos", n).over(order), F.max("pos").over(whole)).alias("_after"))
    return runs.select(*by, "pos", "probe", "run").join(rows, [*by, "pos", "probe"]).groupBy(*by, "run").agg(F.min(F.struct("pos", "probe", "_before"))["_before"].alias("flank_start"), F.max(F.struct("pos", "probe", "_after"))["_after"].alias("flank_end"))


def called_cn(all_probes: DataFrame, runs: DataFrame, by: list[str]) -> DataFrame:
    """Called copy number of each run: the median of 2·2^LRR, corrected by what the unchanged probes of the run's output copy
    number are off it; uncorrected where there are none.
    """
    calc = S.lrr_to_cn(F.col("lrr"))
    same = all_probes.where("not masked and cn_out = cn_in").select(F.col("cn_in").alias("cn_out"), calc.alias("_calc"))
    medians = stats.exact_medians(same, ["cn_out"], "_calc")  # nearly all unchanged probes have one copy number
    corr = medians.select("cn_out", (F.col("cn_out") / F.col("median")).alias("corr"))
    rows = runs.join(F.broadcast(corr), "cn_out", "left").withColumn("_c", calc * F.coalesce("corr", F.lit(1.0)))
    return rows.groupBy(*by, "run").agg(F.round(F.median("_c"), 2).alias("cn_clc")).withColumn("cn_p", F.lit(0.0))
