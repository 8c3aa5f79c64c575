"""Whole jobs: samples, training of depth models, refinement of probe models, segmentation, comparison.

Every job works on a whole cohort at once, with samples and chromosomes as keys rather than as jobs of their own.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cnvspark.functions import scalar as S
from cnvspark.operators import compare, coverage, emissions, fitting, gcbias, hmm, intervals, runs, samples, stats
from cnvspark.operators.emissions import State, Tables
from cnvspark.session import written
from cnvspark.sources import readers

#: Penalties for states 1, 2, 3 and 4 copies away, and the chance of a change between neighbouring probes.
PENALTIES, CHANGE = [0.98, 0.9, 0.5, 0.1], 1e-4
# Log ratios that take part in fits, when refining and when segmenting.
REFINE_LRR, SEGMENT_LRR = (-1.5, 1.0), (-2.5, 2.5)
#: The fits of up to so many samples (some 50 KB each) are broadcast; those of more are joined by sample.
MANY_SAMPLES = 2000


def list_samples(spark: SparkSession, manifest: str, name_col: str = "DNA_ID") -> DataFrame:
    """Sample names of a manifest, in order, up to the first blank one."""
    return samples.list_samples(readers.read_manifest(spark, manifest, name_col), "row", "sample")


def index_samples(reports: DataFrame, path: str, partitions: int = 200, row_group: int = 8 << 20) -> DataFrame:
    """Probe rows (sample, chrom, pos, ...) of all samples as one Parquet table in order of chromosome and position, and each sample's
    histograms of LRR and BAF.

    Files are ranges of positions over all samples, each sorted, in row groups of about ``row_group`` bytes. Their statistics of
    chromosome and position let a region be read (``intervals.read_region``) from the row groups that hold it alone, and
    neither files nor tasks grow in number with the samples.
    """
    rows = reports.repartitionByRange(partitions, "chrom", "pos").sortWithinPartitions("chrom", "pos", "sample")
    rows.write.mode("overwrite").option("parquet.block.size", row_group).option("parquet.page.size", 64 << 10).parquet(path)
    return sample_histograms(reports.sparkSession.read.parquet(path))


def sample_histograms(rows: DataFrame) -> DataFrame:
    """(sample, value, bin, n, freq): LRR in twentieths from -1 to 1 and BAF in fiftieths from 0 to 1, of each sample."""
    lrr = stats.norm_histogram(rows, ["sample"], "lrr", 20, -1.0, 1.0).withColumn("value", F.lit("lrr"))
    return lrr.unionByName(stats.norm_histogram(rows, ["sample"], "baf", 50, 0.0, 1.0).withColumn("value", F.lit("baf")))


def index_reports(spark: SparkSession, reports: str, path: str, **options) -> DataFrame:
    """:func:`index_samples` of report files, whose names hold the samples."""
    rows = readers.read_final_reports(spark, reports)
    return index_samples(rows.withColumn("sample", F.regexp_extract("file", r"FinalReport_?(.*)\.txt$", 1)).drop("file"), path, **options)


def probe_gc(probes: DataFrame, chunks: DataFrame, chunk: int = 1 << 20, half: int = 100) -> DataFrame:
    """(probe, frac_gc): the share of G and C in the window around each probe (probe, chrom, pos), from the chunks of a reference
    sequence. A window is cut at the ends of its contig; a probe whose contig is missing, or ends before the window, has no row.
    """
    spans = gcbias.probe_windows(probes.select("probe", "chrom", "pos").distinct(), half)
    cut = gcbias.slice_sequence(spans, chunks, chunk).where(F.length("seq") > 0)
    return cut.select("probe", S.gc_fraction(F.col("seq")).alias("frac_gc"))


def train_depth(aln: DataFrame, region: str, *, bin_size: int = 5000, max_cn: int = 4, max_tlen: int = 1000, block: int | None = hmm.BLOCK) -> tuple[DataFrame, DataFrame]:
    """Segments and bins of copy number from read depth: coverage, a mixture with equally spaced means, decoded calls."""
    bins = coverage.fragment_coverage(coverage.filter_alignments(aln, max_tlen=max_tlen), bin_size)
    ref = coverage.region_stats(bins, region, bin_size).first()
    m1, s1 = ref["mean"] / ref["cn"], max(ref["sd"] / ref["cn"], 1e-3)
    used = bins.where(S.usable_depth(F.col("count"), m1, s1, max_cn))
    hist = used.groupBy(F.rint("count").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    mix = coverage.constrained_mixture(hist, max_cn, m1, s1)
    probs = F.array(*(F.expr(S.bin_prob_sql("count", repr(float(m)), repr(float(s)))) for _, m, s in mix))
    called = hmm.segment_sequence(used.withColumn("ep", probs), ["chrom"], ["bin"], "ep", z=0.1, p=0.995, states=max_cn, block=block)
    called = called.withColumn("cn", F.col("hs") + 1).drop("hs", "ep")
    segments = coverage.collapse_bins(called, ["chrom"], "cn", bin_size)
    weights = coverage.segment_cn_weights(coverage.bin_runs(called, ["chrom"], "cn"), segments, [(m, s) for _, m, s in mix], ["chrom"])
    return segments.join(weights, ["chrom", "run"]), called


class Baseline(NamedTuple):
    """What training gives: the copy-number model, and the GC content of the probes if it was asked for."""

    model: DataFrame
    gc: DataFrame | None = None


def train(spark: SparkSession, method: str, *, path: str | None = None, chroms: list[str] | None = None, reports: str | None = None, fasta: str | None = None, chunk: int = 1 << 20, **options) -> Baseline:
    """A baseline model: from alignments (``bam``, read as SAM text or Parquet), from intervals (``bed6``), or by sex (``M``, ``F``).
    With ``reports`` and ``fasta`` the GC content around the probes of the first report comes with it.
    """
    if method == "bam":
        model = train_depth(readers.read_alignments(spark, path), **options)[0]
    elif method == "bed6":
        model = readers.model_from_bed(readers.read_bed(spark, path))
    else:
        model = coverage.sex_model(spark, chroms or [f"chr{c}" for c in (*range(1, 23), "X", "Y")], method)
    if reports is None or fasta is None:
        return Baseline(model)
    return Baseline(model, probe_gc(readers.prototype_probes(readers.read_final_reports(spark, reports)), readers.read_fasta(spark, fasta, chunk), chunk))


def _states(max_cn: float, mosaics: bool = False, by_inf: bool = False) -> list[State]:
    """One state for each copy number and allelism, in order. With ``mosaics`` those between copy numbers too; with ``by_inf`` one
    state each for informative and other probes.
    """
    found: dict[tuple[float, str, bool], list] = {}
    for line in readers.STATES.strip().splitlines():
        name, cn, allelism, _, inf, mosaic, _ = line.split()
        if (mosaics or mosaic == "no") and float(cn) <= max_cn:
            state = found.setdefault((float(cn), name, by_inf and inf == "yes"), [int(allelism), False, mosaic == "yes"])
            state[1] |= inf == "yes"
    return [State(i, name, cn, a, mosaic, inf) for i, ((cn, name, _), (a, inf, mosaic)) in enumerate(sorted(found.items()))]


def _decode(rows: DataFrame, by: list[str], states: list[State], mode: str, change: float, block: int | None, informative: float | None = None) -> DataFrame:
    """Rows with log_ep, hs, as_out, cn_out and allelism_out from the hidden Markov model. Rows need lrr_cns, zyg, cn_in, allelism_in,
    inf_in, and the arrays ``lrr_table`` and ``zyg_table`` of their group's fit, which are dropped.
    """
    tables = Tables(F.col("lrr_table"), fitting.LRR_LOW, fitting.LRR_N, F.col("zyg_table"), fitting.ZYG_LOW, fitting.ZYG_N)
    top = int(max(s.cn for s in states))
    own = F.when(F.col("cn_in").between(0, top), F.get("lrr_cns", F.col("cn_in").cast("int"))).otherwise(F.get("lrr_cns", F.lit(0)))
    cns = F.array(*(fitting.lrr_bin(F.get("lrr_cns", F.lit(c))) for c in range(top + 1)))
    binned = rows.withColumns({"zyg_bin": fitting.zyg_bin(F.col("zyg")), "lrr_bins": cns, "lrr_fit": own})
    ep = emissions.log_emissions(binned, states, tables, PENALTIES, mode, informative, fitting.BAD).drop("lrr_table", "zyg_table", "lrr_bins", "zyg_bin", "lrr_cns")
    if "masked" in rows.columns:  # a masked probe says nothing
        ep = ep.withColumn("log_ep", F.when(F.col("masked"), F.array_repeat(F.lit(0.0), len(states))).otherwise(F.col("log_ep")))
    decoded = hmm.viterbi(ep, by, ["pos", "probe"], "log_ep", hmm.transitions(len(states), change), block=block)
    value = lambda values, kind: F.get(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col("hs"))
    return decoded.withColumns({"as_out": value([s.name for s in states], "string"), "cn_out": value([s.cn for s in states], "double"), "allelism_out": value([s.allelism for s in states], "int")})


class Model(NamedTuple):
    """A refined model: its probes, the GC offsets of its copy numbers (cn_in, perc_gc, offset; None: no correction), and its fitted
    states.
    """

    probes: DataFrame
    offsets: DataFrame | None = None
    fits: DataFrame | None = None


def refine(obs: DataFrame, intervals_: DataFrame, gc: DataFrame, *, max_cn: int = 5, min_probes: int = 25_000, min_gc: int | None = None, least: int = fitting.LEAST, rounds: int = 1, change: float = CHANGE, block: int | None = None, path: str | None = None) -> Model:
    """A refined model of probes from control samples: medians, input copy number, GC limits and correction for each candidate
    copy number, emission tables fitted to the probes, decoding weighted by how many probes are informative, rejection of
    gains. States go up to one above the highest copy number that can be fitted, and probes beyond are left out. ``min_gc`` is
    the least number of probes of a GC percent within the limits (``min_probes`` if not given), ``least`` that of a copy
    number whose table is fitted.

    In a second round the copy number comes from the first round's probes. Every step that others read is written: to ``path``,
    where a driver that starts again takes up the rounds that it finds, or else to the shared folder.
    """
    at = lambda k, what: None if path is None else f"{path}/round-{k}/{what}"
    probes = written(stats.probe_medians(obs, ["chrom", "pos", "probe"], values=("lrr", "baf")), "medians", at(0, "medians"))
    start = intervals.first_match(probes, intervals_, width=100_000, value="cn").select(*probes.columns, F.col("cn").cast("double").alias("cn_in"))
    model = None
    for k in range(1, rounds + 1):
        rows = start if model is None else probes.join(model.probes.select("probe", F.col("cn_out").alias("cn_in")), "probe")
        rows = written(samples.usable(samples.join_gc(rows, gc).withColumn("perc_gc", S.perc_gc(F.col("frac_gc"))), mode="discard", max_cn=max_cn), "usable", at(k, "usable"))
        rows = gcbias.within_limits(rows, gcbias.gc_limits(rows, n=min_probes if min_gc is None else min_gc))
        fittable = sorted(r["cn_in"] for r in gcbias.fittable_cns(rows, min_probes).collect())  # a handful
        if not fittable:
            raise ValueError(f"no copy number has {min_probes} probes within the GC limits")
        top = min(int(max(fittable)) + 1, max_cn)
        offsets = written(gcbias.fit_gc(rows.where(F.col("cn_in").isin(fittable))), "offsets", at(k, "offsets"))
        rows = gcbias.candidate_values(gcbias.apply_gc(rows.where(F.col("cn_in") <= top), offsets), offsets, top)
        rows = rows.withColumn("zyg", S.zygosity(F.col("baf"))).withColumn("inf_in", S.informative(F.col("zyg"))).withColumn("masked", F.lit(False))
        rows = written(rows.withColumn("allelism_in", F.when(F.col("cn_in") <= 1, F.col("cn_in").cast("int")).otherwise(2)), "corrected", at(k, "corrected"))
        share = stats.informative_fraction(rows).first()["fraction"] or 0.0
        states = _states(top, by_inf=True)
        tables = written(fitting.fit_tables(fitting.histogram(rows, [], *REFINE_LRR), [], states, least=least, span=REFINE_LRR[1] - REFINE_LRR[0]), "fits", at(k, "fits"))
        fit = tables.first()  # flat tables of a size that the bins fix
        if fit is None:
            raise ValueError("no probe has a log ratio within the limits of a fit")
        rows = rows.withColumns({"lrr_table": emissions.literal(fit["lrr"]), "zyg_table": emissions.literal(fit["zyg"])})
        out = hmm.reject_gains(runs.derive_changes(_decode(rows, ["chrom"], states, "refine", change, block, share)))
        names = ["chrom", "pos", "probe", "lrr", "baf", "cn_in", "perc_gc", "inf_in", "as_out", "cn_out", "allelism_out", "inf_out", "cnc"]
        model = Model(written(out.select(*names), "model", at(k, "model")), offsets, tables.select(F.inline("fits")))
    return model


def correct_samples(obs: DataFrame, model: Model, top: int) -> DataFrame:
    """Probes of all samples as a model sees them, masked where they or the model miss a value: LRR corrected for GC and for each
    candidate copy number, LRR and BAF on their ideal scale by lines fitted to each sample, and each probe shifted by what its
    own model median is off. A sample whose model has one copy number is shifted, not scaled.

    Needs (sample, chrom, pos, probe, lrr, baf); adds cn_in, as_in, allelism_in, inf_in, masked, lrr_corr, lrr_cns and zyg.
    """
    has, zyg = model.probes.columns, S.zygosity(F.col("baf"))
    # Without allelic states in the model they follow from copy number and zygosity.
    cn, likely = F.col("cn_out"), F.lit(None).cast("string")
    for copies, name, most in ((5, "CN5_14", 1.0), (5, "CN5_23", 0.7), (4, "CN4_13", 1.0), (4, "CN4_22", 0.625), (3, "CN3_12", 1.0), (2, "CN2_11", 1.0), (1, "CN1_1", 1.0)):
        likely = F.when((cn == copies) & (zyg <= most), name).otherwise(likely)
    base = model.probes.select("probe", F.col("lrr").alias("model_lrr"), F.col("baf").alias("model_baf"), F.col("cn_out").alias("cn_in"), F.col("allelism_out").alias("allelism_in"), F.coalesce("inf_out", F.lit(False)).alias("inf_in"), (F.col("as_out") if "as_out" in has else likely).alias("as_in"), (F.col("perc_gc") if "perc_gc" in has else F.lit(None).cast("int")).alias("perc_gc"))
    rows = obs.select("sample", "chrom", "pos", "probe", "lrr", "baf").join(base, "probe")
    if model.offsets is None:
        rows = rows.withColumns({"offset": F.lit(0.0), "lrr_cns": F.array(*(F.col("lrr") for _ in range(top + 1)))})
        gc_missing = F.lit(False)
    else:
        rows = gcbias.candidate_values(rows.join(F.broadcast(model.offsets), ["cn_in", "perc_gc"], "left"), model.offsets, top)
        gc_missing = F.col("perc_gc").isNull()
    ok = (F.col("cn_in") > 0) & (F.col("cn_in") <= top) & F.col("lrr").isNotNull() & F.col("baf").isNotNull() & ~gc_missing
    rows = rows.withColumns({"masked": ~F.coalesce(ok, F.lit(False)), "lrr_corr": F.col("lrr") - F.col("offset"), "model_lrr": F.col("model_lrr") - F.coalesce("offset", F.lit(0.0))}).drop("offset")
    rows = written(rows, "samples")
    few = rows.select("sample").distinct().count() <= MANY_SAMPLES  # then a row for each sample and copy number is broadcast
    told = F.broadcast if few else lambda x: x
    medians, lines = emissions.lrr_lines(rows, ["sample"], "model_lrr", shift=True, few=few)
    lines = lines.withColumnsRenamed({"slope": "_slope", "intercept": "_intercept", "shift": "_shift"})
    rows = rows.join(told(medians.drop("w")), ["sample", "cn_in"], "left").join(told(lines), "sample", "left")
    slope, moved = F.coalesce("_slope", F.lit(1.0)), F.coalesce(F.col("m") - F.col("model_lrr"), F.lit(0.0))
    ideal = lambda x: (x - F.coalesce("_shift", F.lit(0.0)) + moved) * slope + F.coalesce("_intercept", F.lit(0.0))
    rows = rows.withColumns({"lrr_corr": ideal(F.col("lrr_corr")), "lrr_cns": F.array(*(ideal(F.get("lrr_cns", F.lit(c))) for c in range(top + 1)))}).drop("m", "_slope", "_intercept", "_shift", "model_lrr")
    rows = emissions.rescale_baf(written(rows, "ratios"), ["sample"], shift=True, few=few)
    return rows.withColumn("zyg", F.coalesce("zyg", F.lit(1.0))).drop("target", "model_baf", "baf_rescaled", "baf_shifted")


def segment(obs: DataFrame, model: Model | DataFrame, *, max_cn: int = 5, mosaics: bool = True, change: float = CHANGE, least: int = fitting.LEAST, min_probes: int = 5, min_evidence: int = 7, min_rel_ll: float = 10.0, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Decoded probes and scored variants of all samples against a refined model, in one job.

    The model's output is the input here. Samples are corrected (:func:`correct_samples`), emission tables are fitted to each
    one, with states between copy numbers if ``mosaics``, and all are decoded together. A probe without values is masked and
    stays. Corrected and decoded probes are written to the shared folder, so each step is done once and a lost executor repeats
    little. Fits have a row for each sample; those of up to ``MANY_SAMPLES`` are broadcast.
    """
    by, model = ["sample", "chrom"], model if isinstance(model, Model) else Model(model)
    fitted = [r[0] for r in model.offsets.select("cn_in").distinct().collect()] if model.offsets is not None else [max_cn]
    states = _states(min(int(max(fitted)) + 1, max_cn), mosaics)
    top = int(max(s.cn for s in states))
    rows = written(correct_samples(obs, model, top), "corrected")
    targets = {cn: math.log2(cn / 2) for cn in range(1, top + 1)}
    tables = written(fitting.fit_tables(fitting.histogram(rows, ["sample"], *SEGMENT_LRR), ["sample"], states, targets=targets, least=least, span=SEGMENT_LRR[1] - SEGMENT_LRR[0]), "fits")
    fits = tables.select("sample", F.col("fits.cn").alias("_cns"), F.col("lrr").alias("lrr_table"), F.col("zyg").alias("zyg_table"))
    rows = rows.join(F.broadcast(fits) if fits.count() <= MANY_SAMPLES else fits, "sample")
    # Changes from a copy number that the sample gives no table of cannot be scored.
    rows = rows.withColumn("masked", F.col("masked") | ~F.array_contains("_cns", F.col("cn_in"))).drop("_cns")
    decoded = runs.usable_index(runs.flag_anomalous(runs.derive_changes(_decode(rows, by, states, "segment", change, block))), by)
    # The model's state: the first one of equal copy number and allelism; relative likelihood is the gain over it.
    first: dict[tuple[float, int], int] = {}
    for s in reversed(states):
        first[s.cn, s.allelism] = s.state
    own = F.col("hs")
    for (cn, allelism), state in first.items():
        own = F.when((F.col("cn_in") == cn) & (F.col("allelism_in") == allelism), state).otherwise(own)
    decoded = written(decoded.drop("lrr_corr", "lrr").withColumnRenamed("lrr_fit", "lrr").withColumn("model_state", own), "decoded")
    found = written(runs.anomalous_runs(decoded, by), "runs")
    total = lambda state: F.round(F.sum(F.element_at("log_ep", F.col(state) + 1)), 1)
    summed = runs.run_table(found, by, total("model_state").alias("mdl_ll"), total("hs").alias("sv_ll")).withColumn("rel_ll", F.round(F.col("sv_ll") - F.col("mdl_ll"), 1))
    kept = written(runs.filter_runs(summed, min_probes, min_evidence, min_rel_ll), "kept")
    found = runs.keep_runs(found, kept, by)
    svs = kept.join(runs.called_cn(decoded, found, by), [*by, "run"]).join(runs.flanks(decoded, by, found), [*by, "run"])
    decoded = decoded.join(found.select(*by, "probe", F.col("run").alias("sv_run")), [*by, "probe"], "left")
    return decoded, svs


def compare_samples(decoded: DataFrame, svs: DataFrame, threshold: int = 2_000_000, flank: int = 10, groups: DataFrame | None = None) -> DataFrame:
    """Variants of all samples with their regions by size class, and how well each fits every other sample.

    A variant is scored over its probes and ``flank`` more on either side, as far as its region goes. With ``groups`` (sample,
    group), as the clones of a line are, samples are compared within their group. Variants are written to the shared folder
    once, as regions and unions read them several times.
    """
    name = lambda run: F.concat_ws(":", F.col("sample").cast("string"), "chrom", F.col(run).cast("string")).alias("sv")
    sized = written(svs.withColumn("size", S.size_class(F.col("flank_start"), F.col("flank_end"), threshold)).withColumn("sv", name("run")), "variants")
    by = ["size", "chrom"]
    islands = written(intervals.interval_union(sized, "flank_start", "flank_end", by), "islands")
    regions = intervals.number_regions(intervals.region_table(islands, by), [F.when(F.col("size") == "small", 0).otherwise(1)])
    placed = written(islands.join(regions.select(*by, "island", "region_id", F.col("start").alias("region_start"), F.col("end").alias("region_end")), [*by, "island"]).drop("island"), "placed")
    probes = decoded.select("sample", "chrom", "pos", "probe", "masked", "hs", "log_ep", "model_state", (F.coalesce(F.col("cnc") != 0, F.lit(False)) | F.coalesce("loh_probe", F.lit(False))).alias("changed"))
    if groups is not None:
        probes = probes.join(groups.select("sample", "group"), "sample")
    more = ["group"] if groups is not None else []
    wide = intervals.widen_by_rank(placed, probes.select("sample", "chrom", "pos", "probe", F.col("hs").alias("state"), *more), n=flank, region=("region_start", "region_end"))
    wide = written(wide, "paths")
    best = compare.extreme_samples(compare.pair_scores(wide.select("sv", "sample", "chrom", "pos", "probe", "state", *more), probes))
    inside = wide.join(placed.select("sv", "start", "end"), "sv").where(F.col("pos").between(F.col("start"), F.col("end")))
    seen = compare.overlap_samples(inside.select("sv", "sample", "chrom", "pos", "probe", *more), probes)
    return placed.join(best, ["sv", "sample"], "left").join(seen, ["sv", "sample"], "left").drop("region_start", "region_end").orderBy("region_id", "chrom", "start", "end")


def fan_out(table: DataFrame, experiment: str) -> DataFrame:
    """Lines and clones of an experiment with their control and other samples, as keys of one job."""
    rows = table.where(F.col("Experiment") == experiment)
    control = F.upper("Control") == "YES"
    return rows.groupBy("Experiment", "Cell_Line", "Cell_Clone").agg(F.sort_array(F.collect_set(F.when(control, F.col("Sample_ID")))).alias("controls"), F.sort_array(F.collect_set("Sample_ID")).alias("samples"))
