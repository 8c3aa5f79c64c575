"""Comparing variants between samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Base pairs of a home, where variants that start there meet the probes of all samples.
HOME = 10_000_000


def _met(svs: DataFrame, probes: DataFrame, mine: list[str], theirs: list[str], *, alone: bool = False) -> DataFrame:
    """Each probe (sv, sample, ``mine``) of each variant with that probe in every sample (target, ``theirs``); ``alone`` keeps those
    that no sample has.

    Rows are dealt by ``_home``, the stretch of the genome where the variant starts, and probes go once to each home that needs
    them. So pairs are made where they are summed, and are never shuffled: all groupings that begin with ``_home`` are
    local. Homes lie in many more partitions than other shuffles have, as pairs outnumber the rows they come from.
    """
    on = ["group", "probe"] if "group" in svs.columns and "group" in probes.columns else ["probe"]
    start = F.min("pos").over(Window.partitionBy("sample", "chrom", "sv"))
    placed = svs.withColumn("_home", F.xxhash64("chrom", F.floor(start / HOME)))
    needed = probes.join(placed.select("_home", *on).distinct(), on)
    left = placed.select("_home", *on, F.struct("sv", "sample", *mine).alias("_s"))
    both = left.unionByName(needed.select("_home", *on, F.struct("target", *theirs).alias("_t")), allowMissingColumns=True)
    parts = 16 * int(svs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = both.repartition(parts, "_home").groupBy("_home", *on).agg(F.collect_list("_s").alias("_s"), F.collect_list("_t").alias("_t"))
    rows = found.select("_home", F.explode("_s").alias("_s"), "_t")
    return rows.select("_home", "_s.*", (F.explode_outer if alone else F.explode)("_t").alias("_t")).select("_home", "sv", "sample", *mine, "_t.*")


def pair_scores(svs: DataFrame, probes: DataFrame) -> DataFrame:
    """(sv, sample, target, score, n): for each variant's path the relative log-likelihood in every sample, its own too. ``_home``
    says where rows lie.

    ``svs`` has a row for each (sv, sample, chrom, pos, probe, state); ``probes`` one for each (sample, probe) with ``log_ep``
    and the model's own ``model_state``; masked rows do not count. Samples meet on the probe's name, within homes
    (:func:`_met`). If both tables have ``group``, as the clones of a line do, samples are compared within it alone.
    """
    own = F.element_at("log_ep", F.col("model_state") + 1)
    usable = probes.where(~F.col("masked")).withColumn("target", F.col("sample")).withColumn("gains", F.transform("log_ep", lambda x: x - own))
    keep = [c for c in ("group", "probe") if c in probes.columns]
    rows = _met(svs, usable.select("target", *keep, "gains"), ["state"], ["gains"])
    return rows.groupBy("_home", "sv", "sample", "target").agg(F.sum(F.element_at("gains", F.col("state") + 1)).alias("score"), F.count(F.lit(1)).alias("n"))


def extreme_samples(scores: DataFrame) -> DataFrame:
    """Own score, and least and greatest score in other samples with the sample (the first in order on a tie)."""
    other = F.col("target") != F.col("sample")
    low = F.min(F.when(other, F.struct("score", "target")))
    high = F.min(F.when(other, F.struct((-F.col("score")).alias("score"), "target")))
    home = [c for c in scores.columns if c == "_home"]
    return scores.groupBy(*home, "sv", "sample").agg(F.max(F.when(~other, F.col("score"))).alias("qrll"), low["score"].alias("min_trll"), (-high["score"]).alias("max_trll"), low["target"].alias("min_trll_smp"), high["target"].alias("max_trll_smp")).drop("_home")


def overlap_samples(svs: DataFrame, probes: DataFrame) -> DataFrame:
    """Other samples that have a changed probe among those (sv, sample, chrom, pos, probe) of the variant, as a sorted list."""
    keep = [c for c in ("group", "probe") if c in probes.columns]
    changed = probes.where("changed and not masked").select(F.col("sample").alias("target"), *keep)
    other = F.collect_set(F.when(F.col("target") != F.col("sample"), F.col("target")))
    found = _met(svs, changed, [], [], alone=True).groupBy("_home", "sv", "sample").agg(F.sort_array(other).alias("_others"))
    return found.select("sv", "sample", F.array_join(F.transform("_others", lambda x: x.cast("string")), ",").alias("ovlp_smp"))


def unique_variants(svs: DataFrame, regions: DataFrame) -> DataFrame:
    """Variants in regions of one sample only; ``svs`` and ``regions`` share ``chrom`` and ``island``."""
    alone = regions.where("n_samples = 1").select("chrom", "island")
    return svs.join(alone, ["chrom", "island"], "left_semi")


def score_calls(hits: DataFrame, by: list[str], mu: float, sigma: float) -> DataFrame:
    """Called intervals with the number, mean and SD of their probes, log2 ratio and Z score."""
    agg = hits.groupBy(*by).agg(F.count("lrr").alias("n"), F.avg("lrr").alias("mean"), F.coalesce(F.stddev_samp("lrr"), F.lit(0.0)).alias("sd"))
    return agg.withColumn("z", F.abs(F.col("mean") - mu) * F.sqrt("n") / sigma)
