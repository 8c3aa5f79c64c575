"""Grouped statistics, histograms and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def probe_medians(obs: DataFrame, by: list[str], *, values: tuple[str, ...] = ("lrr", "baf", "cn")) -> DataFrame:
    """Exact medians over samples; observations that miss a value are dropped."""
    return obs.dropna(subset=list(values)).groupBy(*by).agg(*(F.median(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"))


def mean_sd(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean and sample SD; the SD of one value is 0."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.count(x).alias("n"))


def trimmed_mean_sd(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """Mean and SD without one least and one greatest value; (0, 0) below three values. One pass of sums."""
    v = F.col(x)
    sums = df.where(v.isNotNull()).groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"), F.min(v).alias("lo"), F.max(v).alias("hi"))
    m = F.col("n") - 2
    mean = (F.col("s") - F.col("lo") - F.col("hi")) / m
    var = (F.col("q") - F.col("lo") ** 2 - F.col("hi") ** 2 - m * mean**2) / (m - 1)
    return sums.select(*by, F.when(F.col("n") >= 3, mean).otherwise(0.0).alias("mean"), F.when(F.col("n") >= 4, F.sqrt(F.greatest(var, F.lit(0.0)))).otherwise(0.0).alias("sd"))


def norm_histogram(df: DataFrame, by: list[str], x: str, per_unit: int, low: float, high: float) -> DataFrame:
    """Dense histogram over a fixed range: frequencies of the values in range, to 3 places, empty bins included."""
    first, last = round(low * per_unit), round(high * per_unit)
    counted = df.where(F.col(x).between(low, high)).groupBy(*by, F.rint(F.col(x) * per_unit).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    keys = counted.select(*by).distinct() if by else None
    bins = df.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("bin"))
    dense = keys.join(F.broadcast(bins), how="cross") if keys is not None else bins
    full = dense.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy())
    return full.withColumn("freq", F.round(share, 3))


def obs_histogram(df: DataFrame, by: list[str], bin_col: str, low: int, high: int) -> DataFrame:
    """Dense histogram of integer bins for each key, summing to 1."""
    counted = df.where(F.col(bin_col).between(low, high)).groupBy(*by, F.col(bin_col).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    keys = counted.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(low), F.lit(high))))
    full = keys.join(counted, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    """Counts of ``a`` by ``b``, 0 where none; give ``values`` of ``b`` to save a job that finds them."""
    return df.groupBy(a).pivot(b, values).count().na.fill(0)


def weighted_median(df: DataFrame, by: list[str], x: str, w: str) -> DataFrame:
    """The value where the running weight reaches half; the mid-point to the next one if it hits half exactly; 0 without
    weight.
    """
    order = Window.partitionBy(*by).orderBy(x)
    merged = df.groupBy(*by, F.col(x).alias("_x")).agg(F.sum(w).alias("_w")).withColumnRenamed("_x", x)
    live = merged.where("_w > 0")
    rows = live.withColumn("_run", F.sum("_w").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_half", F.sum("_w").over(Window.partitionBy(*by)) / 2).withColumn("_next", F.lead(x).over(order))
    hit = rows.where("_run >= _half and _run - _w < _half")
    value = F.when(F.col("_run") == F.col("_half"), (F.col(x) + F.col("_next")) / 2).otherwise(F.col(x))
    found = hit.select(*by, value.alias("weighted_median"))
    return df.select(*by).distinct().join(found, by, "left").withColumn("weighted_median", F.coalesce("weighted_median", F.lit(0.0)))


def running_cdf(df: DataFrame, by: list[str], bin_col: str, p: str) -> DataFrame:
    """Rows with ``cdf``, the running sum of ``p`` over bins."""
    return df.withColumn("cdf", F.sum(p).over(Window.partitionBy(*by).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, 0)))


def normalize(df: DataFrame, by: list[str], p: str) -> DataFrame:
    """``p`` scaled to sum 1 within each key."""
    return df.withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy(*by)))


def sample_cap(df: DataFrame, by: list[str], key: list[str], n: int, seed: int) -> DataFrame:
    """At most ``n`` rows of each key, drawn by a seeded hash of ``key``: the same rows on every run.

    Each of 64 parts of a key, by its hash, keeps its first ``n``, and the key those of its parts: no task sorts a whole key.
    """
    rows = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)).cast("binary"))).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(64)))
    for parts in ([*by, "_part"], by):
        rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*parts).orderBy("_h", *key))).where(F.col("_r") <= n).drop("_r")
    return rows.drop("_h", "_part")


def first_per_group(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in (*by, *order)]
    best = df.groupBy(*by).agg(F.min(F.struct(*order, *rest)).alias("_b"))
    return best.select(*by, "_b.*")


def exact_medians(df: DataFrame, by: list[str], x: str, per_unit: int = 1000, few: bool = True) -> DataFrame:
    """(by, median, n) over rows that have ``x``: the exact median of keys with very many rows.

    Rows are counted by bins of ``x``, and only those of the one or two bins that hold the middle ranks are looked at again, as
    counted values. So no buffer holds the values of a key. Keys without values do not come. Where keys are ``few`` (copy
    numbers) the bins of the middle are broadcast; else, as for the samples of a cohort, they are joined by key and bin.
    """
    rows = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x")).withColumn("_bin", F.floor(F.col("_x") * per_unit))
    key = Window.partitionBy(*by)
    counted = rows.groupBy(*by, "_bin").agg(F.count(F.lit(1)).alias("_n"))
    ranked = counted.withColumn("_total", F.sum("_n").over(key)).withColumn("_to", F.sum("_n").over(key.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)  # middle ranks, from 0
    holds = lambda n: ((F.col("_to") > low) & (F.col("_to") - F.col(n) <= low)) | ((F.col("_to") > high) & (F.col("_to") - F.col(n) <= high))
    hit = ranked.where(holds("_n")).select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), F.col("_bin").alias("_b"), "_total", (F.col("_to") - F.col("_n")).alias("_before"))
    on = F.col("_bin") == F.col("_b")
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    values = rows.join(F.broadcast(hit) if few else hit, on).groupBy(*by, "_bin", "_x").agg(F.count(F.lit(1)).alias("_n"), F.first("_total").alias("_total"), F.first("_before").alias("_before"))
    within = Window.partitionBy(*by, "_bin").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    values = values.withColumn("_to", F.col("_before") + F.sum("_n").over(within))
    at = lambda rank: F.min(F.when(F.col("_to") > rank, F.col("_x")))
    return values.groupBy(*by).agg((0.5 * at(low) + 0.5 * at(high)).alias("median"), F.first("_total").alias("n"))


def median_of_medians(df: DataFrame, key: str, x: str) -> DataFrame:
    """Median and weight (rows) of each key that has values."""
    return exact_medians(df, [key], x)


def fraction_changed(df: DataFrame) -> DataFrame:
    """Share of probes whose integral output copy number differs from the input (one row)."""
    whole = F.col("cn_out") == F.floor("cn_out")
    return df.where(whole).agg(F.avg((F.col("cn_out") != F.col("cn_in")).cast("double")).alias("fraction"))


def informative_fraction(df: DataFrame) -> DataFrame:
    """Share of informative probes among unmasked ones (one row)."""
    return df.where(~F.col("masked")).agg(F.avg(F.col("inf_in").cast("double")).alias("fraction"))


def sufficient(df: DataFrame, by: str, usable: Column, least: int) -> DataFrame:
    """(by, ok): whether there are at least ``least`` usable rows."""
    return df.groupBy(by).agg((F.count_if(usable) >= least).alias("ok"))


def avg_likelihood_hist(svs: DataFrame, width: float = 10.0, cap: float = 250.0) -> DataFrame:
    """Histogram of exp(rel_ll / n_probes), capped."""
    v = F.least(F.exp(F.col("rel_ll") / F.col("n_probes")), F.lit(cap))
    return svs.groupBy((F.floor(v / width) * width).alias("low")).agg(F.count(F.lit(1)).alias("n"))


def load_report(df: DataFrame, matched: Column, used: Column) -> DataFrame:
    """Total, matched and used rows (one row)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(matched).alias("matched"), F.count_if(matched & used).alias("used"))


def mode_window_mean(df: DataFrame, by: list[str], x: str, step: float = 0.01) -> DataFrame:
    """Mean of the values within half and one and a half times the most frequent value, truncated to ``step``. Of equally
    frequent values the least counts.
    """
    cell = F.floor(F.col(x) / step)
    counted = df.groupBy(*by, cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"))
    mode = counted.groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), "_cell"))["_cell"].alias("_mode"))
    near = df.join(mode, by).where(F.col(x).between(0.5 * F.col("_mode") * step, 1.5 * F.col("_mode") * step))
    return near.groupBy(*by).agg((F.first("_mode") * step).alias("mode"), F.avg(x).alias("mean"), F.count(F.lit(1)).alias("n"))
