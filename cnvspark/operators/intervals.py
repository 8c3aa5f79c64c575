"""Intervals: range joins by equal bins, unions, containment, exclusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(low: Column, high: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(low / width), F.greatest(F.floor(high / width), F.floor(low / width))))


def first_match(points: DataFrame, intervals: DataFrame, *, width: int, value: str, order: str = "ord", mode: str = "touch") -> DataFrame:
    """All rows of ``points`` (chrom, pos) with ``value`` of the interval that holds them; NULL if none does.

    Of several intervals the one of least ``order`` wins. ``touch`` counts both ends of an interval in, so abutting ones
    both match their border; ``half_open`` has one-based positions in (start, end]. Intervals are exploded into bins and joined
    on (chrom, bin), so that no pair of rows from different bins is made; points keep their multiplicity.
    """
    end_reach = F.col("end") + (1 if mode == "touch" else 0)
    low = F.col("start") if mode == "touch" else F.col("start") + 1
    binned = intervals.select(F.col("chrom").alias("_chrom"), _bins(F.col("start"), F.col("end") + 1, width).alias("_bin"), low.alias("_low"), end_reach.alias("_high"), F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("_best"))
    distinct = points.select("chrom", "pos").distinct().withColumn("_bin", F.floor(F.col("pos") / width))
    hit = distinct.join(binned, (F.col("chrom") == F.col("_chrom")) & (distinct["_bin"] == binned["_bin"]) & (F.col("pos") >= F.col("_low")) & (F.col("pos") <= F.col("_high")))
    best = hit.groupBy("chrom", "pos").agg(F.min("_best")["v"].alias(value))
    return points.join(best, ["chrom", "pos"], "left")


def overlap_all(spans: DataFrame, points: DataFrame, *, width: int, start: str = "start", end: str = "end", by: list[str] | None = None) -> DataFrame:
    """Every (span, point) with start <= pos <= end on one chromosome (or of equal ``by``)."""
    binned = spans.withColumn("_bin", _bins(F.col(start), F.col(end), width))
    placed = points.withColumn("_bin", F.floor(F.col("pos") / width))
    return binned.join(placed, [*(by or ["chrom"]), "_bin"]).where((F.col("pos") >= F.col(start)) & (F.col("pos") <= F.col(end))).drop("_bin")


def exclude(features: DataFrame, regions: DataFrame, *, width: int, skip: tuple[str, ...] = ()) -> DataFrame:
    """Features (chrom, start, end, half-open) that overlap no region and lie on no skipped chromosome."""
    left = features.where(~F.col("chrom").isin(*skip)) if skip else features
    keys = left.select("chrom", "start", "end").distinct().withColumn("_bin", _bins(F.col("start"), F.col("end") - 1, width))
    right = regions.select(F.col("chrom").alias("_c"), F.col("start").alias("_s"), F.col("end").alias("_e")).withColumn("_b", _bins(F.col("_s"), F.col("_e") - 1, width))
    bad = keys.join(right, (F.col("chrom") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & (F.col("_s") < F.col("end")) & (F.col("_e") > F.col("start")), "left_semi")
    return left.join(bad.select("chrom", "start", "end").distinct(), ["chrom", "start", "end"], "left_anti")


def interval_union(df: DataFrame, start: str, end: str, by: list[str], width: int = 1_000_000) -> DataFrame:
    """Rows with ``island``, the number of their union of touching intervals within ``by``.

    Rows are ordered within bins of ``start`` of ``width`` positions. How far the bins before a bin reach, and how many islands
    start in them, comes from tables of a row for each bin, so no task holds the intervals of a whole chromosome.
    """
    rows = df.withColumn("_bin", F.coalesce(F.floor(F.col(start) / width), F.lit(-1)))
    keys, before = [*by, "_bin"], Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)

    def with_bins_before(table: DataFrame, fold, value: str, name: str) -> DataFrame:
        bins = table.groupBy(*keys).agg(fold(value).alias("_v"))
        told = bins.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), fold("_v").over(before).alias(name))
        return table.join(told, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).drop(*(f"_k{i}" for i in range(len(keys))))

    order = Window.partitionBy(*keys).orderBy(start, end)
    rows = with_bins_before(rows, F.max, end, "_reach")
    reach = F.greatest("_reach", F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("_fresh", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0))
    rows = with_bins_before(rows, F.sum, "_fresh", "_islands")
    # Rows of equal bounds count together, as their order may have changed since.
    island = F.coalesce("_islands", F.lit(0)) + F.sum("_fresh").over(order.rangeBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("island", island).drop("_bin", "_reach", "_fresh", "_islands")


def collapse_regions(svs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Regions of touching flank spans: bounds, variants, samples and their sorted list."""
    by = by or ["chrom"]
    return region_table(interval_union(svs, "flank_start", "flank_end", by), by)


def region_table(rows: DataFrame, by: list[str]) -> DataFrame:
    """Regions of rows that bear the number of their ``island``."""
    return rows.groupBy(*by, "island").agg(F.min("flank_start").alias("start"), F.max("flank_end").alias("end"), F.count(F.lit(1)).alias("n_svs"), F.count_distinct("sample").alias("n_samples"), F.array_join(F.sort_array(F.collect_set("sample")), ",").alias("samples"))


def number_regions(regions: DataFrame, first: list[Column] | None = None) -> DataFrame:
    """Consecutive ids in order of size class (small first), chromosome and start. Regions are numbered within class and
    chromosome; the ids at which these begin come from their counts.
    """
    classes = [f"_o{i}" for i in range(len(first or []))]
    rows = regions.withColumns(dict(zip(classes, first or [], strict=True)))
    keys = [*classes, "chrom"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))  # a row for each class and chromosome
    offsets = counts.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*keys).orderBy("start")))
    placed = rows.join(F.broadcast(offsets), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return placed.withColumn("region_id", F.col("_before") + F.col("_at")).drop("_before", "_at", *classes, *(f"_k{i}" for i in range(len(keys))))


def contained(svs: DataFrame, regions: DataFrame, width: int = 1_000_000) -> DataFrame:
    """Variants with the region that holds their flank span, joined by chromosome and the bin of the span's start, which is one of
    the region's bins.
    """
    right = regions.select(F.col("chrom").alias("_chrom"), F.col("start").alias("r_start"), F.col("end").alias("r_end"), "region_id", _bins(F.col("start"), F.col("end"), width).alias("_bin"))
    left = svs.withColumn("_at", F.floor(F.col("flank_start") / width))
    hit = left.join(right, (F.col("chrom") == F.col("_chrom")) & (F.col("_at") == F.col("_bin")) & (F.col("flank_start") >= F.col("r_start")) & (F.col("flank_end") <= F.col("r_end")))
    return hit.drop("_chrom", "_bin", "_at")


def widen_by_rank(spans: DataFrame, probes: DataFrame, n: int = 10, width: int = 64, region: tuple[str, str] | None = None) -> DataFrame:
    """(sv, probe) for the probes of each span and ``n`` more on either side, by rank within sample and chromosome. Spans find their
    first and last rank by counting the probes before their ends, and meet probes in blocks of ``width`` ranks, so neither is
    repeated for each position. ``region`` names the columns of ``spans`` that bound what is added. Other columns of ``probes`` stay.
    """
    by, span = ["sample", "chrom"], ["sv", *(region or ())]
    ranked = probes.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("pos", "probe")))
    known = spans.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*by, *span, "start", "end")
    at = F.inline(F.array(F.struct(F.col("start").alias("pos"), F.lit(0).alias("_kind")), F.struct(F.col("end").alias("pos"), F.lit(2).alias("_kind"))))
    ends = known.select("*", at)  # at one position starts come before probes, and ends after them
    marks = ends.unionByName(probes.select(*by, "pos", F.lit(1).alias("_kind")), allowMissingColumns=True)
    before = F.count_if(F.col("_kind") == 1).over(Window.partitionBy(*by).orderBy("pos", "_kind").rowsBetween(Window.unboundedPreceding, 0))
    counted = marks.withColumn("_n", before).where("_kind <> 1")
    inside = counted.groupBy(*by, *span, "start", "end").agg((F.min(F.when(F.col("_kind") == 0, F.col("_n"))) + 1).alias("_low"), F.max(F.when(F.col("_kind") == 2, F.col("_n"))).alias("_high")).where("_low <= _high")
    bounds = inside.groupBy(*by, *span).agg((F.min("_low") - n).alias("_low"), (F.max("_high") + n).alias("_high"))
    wanted = bounds.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest("_low", F.lit(1)) / width), F.floor(F.col("_high") / width))))
    found = wanted.join(ranked.withColumn("_block", F.floor(F.col("rank") / width)), [*by, "_block"]).where(F.col("rank").between(F.col("_low"), F.col("_high")))
    if region:
        found = found.where(F.col("pos").between(F.col(region[0]), F.col(region[1])))
    return found.select("sv", *by, "probe", "pos", "rank", *(c for c in probes.columns if c not in (*by, "probe", "pos")))


def read_region(df: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """Rows of a region; on Parquet laid out by chromosome and position the filter reaches the scan."""
    return df.where((F.col("chrom") == chrom) & F.col("pos").between(start, end))
