"""GC bias: which copy numbers and GC percents can be fitted, the fit, and its use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import probe_window
from cnvspark.operators import stats


def probe_windows(probes: DataFrame, half: int = 100) -> DataFrame:
    """(probe, chrom, start, end) of the window around each probe."""
    start, end = probe_window(F.col("pos"), half)
    return probes.select("probe", "chrom", start.alias("start"), end.alias("end"))


def slice_sequence(spans: DataFrame, fasta: DataFrame, chunk: int) -> DataFrame:
    """Spans with ``seq``, their part of the reference, from its chunks; a span over a border takes from both chunks."""
    rows = spans.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))))
    joined = rows.join(fasta.withColumnRenamed("contig", "chrom").withColumnRenamed("seq", "_seq"), ["chrom", "chunk_no"])
    low = F.greatest(F.col("start") - F.col("chunk_no") * chunk, F.lit(0))
    high = F.least(F.col("end") - F.col("chunk_no") * chunk, F.lit(chunk))
    part = joined.withColumn("_part", F.substr("_seq", (low + 1).cast("int"), (high - low).cast("int")))
    keys = [c for c in spans.columns]
    pieces = F.array_sort(F.collect_list(F.struct("chunk_no", "_part")))
    return part.groupBy(*keys).agg(F.array_join(F.transform(pieces, lambda x: x["_part"]), "").alias("seq"))


def fittable_cns(df: DataFrame, n: int = 25_000) -> DataFrame:
    """Positive copy numbers with at least ``n`` probes."""
    return df.where("cn_in > 0").groupBy("cn_in").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n)


def gc_limits(df: DataFrame, seed: int = 40, n: int = 25_000) -> DataFrame:
    """The range of GC percents around ``seed`` over all probes (one row): down and up to the first one with fewer than ``n``
    probes, which is the limit.
    """
    counts = df.groupBy("perc_gc").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(101).select(F.col("id").cast("int").alias("perc_gc"))
    full = grid.join(counts, "perc_gc", "left").withColumn("fail", F.coalesce("n", F.lit(0)) < n)
    low, high = (F.when(F.col("fail") & side, F.col("perc_gc")) for side in (F.col("perc_gc") <= seed, F.col("perc_gc") >= seed))
    return full.agg(F.coalesce(F.max(low), F.lit(0)).alias("gc_low"), F.coalesce(F.min(high), F.lit(100)).alias("gc_high"))


def within_limits(df: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows whose GC percent lies within the limits (one row), both included."""
    return df.join(F.broadcast(limits), F.col("perc_gc").between(F.col("gc_low"), F.col("gc_high"))).drop("gc_low", "gc_high")


#: A quadratic fit from sums n, g1..g4, y, gy, g2y, as SQL text that means the same in every engine.
_DET = "(n*(g2*g4-g3*g3) - g1*(g1*g4-g3*g2) + g2*(g1*g3-g2*g2))"
QUADRATIC = {
    "c0": f"((y*(g2*g4-g3*g3) - g1*(gy*g4-g3*g2y) + g2*(gy*g3-g2*g2y))/{_DET})",
    "c1": f"((n*(gy*g4-g3*g2y) - y*(g1*g4-g3*g2) + g2*(g1*g2y-gy*g2))/{_DET})",
    "c2": f"((n*(g2*g2y-gy*g3) - g1*(g1*g2y-gy*g2) + y*(g1*g3-g2*g2))/{_DET})",
}


def gc_sums(df: DataFrame, by: str, g: str, y: str) -> DataFrame:
    """What a quadratic fit needs, in one pass."""
    x, v = F.col(g), F.col(y)
    return df.groupBy(by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).alias("g1"), F.sum(x * x).alias("g2"), F.sum(x * x * x).alias("g3"), F.sum(x * x * x * x).alias("g4"), F.sum(v).alias("y"), F.sum(x * v).alias("gy"), F.sum(x * x * v).alias("g2y"))


def fit_gc(df: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(cn_in, perc_gc, offset): the fitted value at each GC percent less the median of the copy number."""
    rows = df.where("lrr is not null and frac_gc is not null")
    if limits is not None:
        rows = within_limits(rows, limits)
    sums = gc_sums(rows, "cn_in", "frac_gc", "lrr").join(F.broadcast(stats.exact_medians(rows, ["cn_in"], "lrr").drop("n")), "cn_in")
    coefs = sums.select("cn_in", "median", *(F.expr(e).alias(k) for k, e in QUADRATIC.items()))
    grid = coefs.withColumn("perc_gc", F.explode(F.sequence(F.lit(0), F.lit(100))))
    if limits is not None:
        grid = within_limits(grid, limits)
    g = F.col("perc_gc") / 100
    return grid.select("cn_in", "perc_gc", (F.col("c0") + F.col("c1") * g + F.col("c2") * g * g - F.col("median")).alias("offset"))


def apply_gc(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Rows with ``lrr_corr``; NULL where the copy number or the GC percent has no fit. The offsets are at most 101 a copy
    number, so they are broadcast.
    """
    return df.join(F.broadcast(offsets), ["cn_in", "perc_gc"], "left").withColumn("lrr_corr", F.col("lrr") - F.col("offset")).drop("offset")


def candidate_lrr(df: DataFrame, offsets: DataFrame, cns: list[int]) -> DataFrame:
    """(…, cn, lrr_cn): the LRR corrected as if each probe had each candidate copy number; one without a fit borrows that of the
    nearest fitted one (the lower of two), and CN 0 is not corrected.
    """
    fitted = offsets.select(F.col("cn_in").alias("fit_cn")).distinct()
    wanted = df.sparkSession.createDataFrame([(c,) for c in cns], "cn int")
    nearest = wanted.join(F.broadcast(fitted), how="cross").groupBy("cn").agg(F.min(F.struct(F.abs(F.col("fit_cn") - F.col("cn")), "fit_cn"))["fit_cn"].alias("fit_cn"))
    rows = df.join(F.broadcast(nearest), how="cross")
    table = offsets.select(F.col("cn_in").alias("fit_cn"), "perc_gc", "offset")
    return rows.join(F.broadcast(table), ["fit_cn", "perc_gc"], "left").withColumn("lrr_cn", F.when(F.col("cn") == 0, F.col("lrr")).otherwise(F.col("lrr") - F.col("offset"))).drop("offset", "fit_cn")


def candidate_offsets(offsets: DataFrame, max_cn: int) -> DataFrame:
    """(perc_gc, offsets): the offset of each copy number 0, 1, ... ``max_cn``; one without a fit borrows that of the nearest fitted one
    (the lower of two), and CN 0 is not corrected. At most 101 rows.
    """
    fitted = offsets.select(F.col("cn_in").alias("fit_cn")).distinct()
    wanted = offsets.sparkSession.range(1, max_cn + 1).select(F.col("id").cast("int").alias("cn"))
    nearest = wanted.join(F.broadcast(fitted), how="cross").groupBy("cn").agg(F.min(F.struct(F.abs(F.col("fit_cn") - F.col("cn")), "fit_cn"))["fit_cn"].alias("fit_cn"))
    each = offsets.select(F.col("cn_in").alias("fit_cn"), "perc_gc", "offset").join(F.broadcast(nearest), "fit_cn")
    table = each.groupBy("perc_gc").agg(F.array_sort(F.collect_list(F.struct("cn", "offset"))).alias("_o"))
    return table.select("perc_gc", F.concat(F.array(F.lit(0.0)), F.col("_o.offset")).alias("offsets"))


def candidate_values(df: DataFrame, offsets: DataFrame, max_cn: int) -> DataFrame:
    """Rows with ``lrr_cns``: the LRR corrected as if the probe had copy number 0, 1, ... ``max_cn``, without a row for each."""
    rows = df.join(F.broadcast(candidate_offsets(offsets, max_cn)), "perc_gc", "left")
    return rows.withColumn("lrr_cns", F.array(*(F.col("lrr") - F.coalesce(F.get("offsets", F.lit(c)), F.lit(0.0)) for c in range(max_cn + 1)))).drop("offsets")


def candidate_bins(df: DataFrame, offsets: DataFrame, max_cn: int, per_unit: int) -> DataFrame:
    """Rows with ``lrr_bins``, the bins of :func:`candidate_values`."""
    rows = candidate_values(df, offsets, max_cn)
    return rows.withColumn("lrr_bins", F.array(*(F.rint(F.get("lrr_cns", F.lit(c)) * per_unit).cast("int") for c in range(max_cn + 1)))).drop("lrr_cns")


def last_wins(gc: DataFrame, line: str = "line_no") -> DataFrame:
    """One GC value for each probe: that of the last line, without NULL, empty and ``0`` texts."""
    good = gc.where(F.col("frac_gc").isNotNull() & ~F.col("frac_gc").isin("", "NA", "0"))
    return good.groupBy("probe").agg(F.max_by("frac_gc", line).cast("double").alias("frac_gc"))
