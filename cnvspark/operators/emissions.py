"""Rescaling, emission tables and log emissions of the hidden Markov model."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cnvspark.functions.scalar import safe_log
from cnvspark.operators import stats

# BAF targets by allelic ratio, and stand-ins for copy numbers without data.
BAF_TARGETS = {"CN2_11": 0.5, "CN3_12": 0.33, "CN4_13": 0.25, "CN4_22": 0.5, "CN5_14": 0.2, "CN5_23": 0.4}
CN1_LRR = -0.33
CN3_ZYG, CN4_ZYG = 0.65, 0.72
#: Input copy numbers beyond this are as far from every state as can be.
MOST_COPIES = 12


def weighted_line(df: DataFrame, x: str, y: str, w: str, by: list[str] | None = None, shift: bool = False) -> DataFrame:
    """Slope and intercept of the weighted least-squares line of each group (``by``; else one row). Through fewer than two
    weighted points goes no line: an error, or with ``shift`` a line of slope 1 through their mean.
    """
    s = df.groupBy(*(by or [])).agg(F.sum(w).alias("sw"), F.sum(F.col(w) * F.col(x)).alias("sx"), F.sum(F.col(w) * F.col(y)).alias("sy"), F.sum(F.col(w) * F.col(x) * F.col(x)).alias("sxx"), F.sum(F.col(w) * F.col(x) * F.col(y)).alias("sxy"), F.count_distinct(F.when(F.col(w) > 0, F.col(x))).alias("points"))
    det = F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    none = F.lit(1.0) if shift else F.raise_error(F.lit("a rescale needs two copy numbers with probes")).cast("double")
    slope = F.when(F.col("points") >= 2, (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).otherwise(none)
    return s.select(*(by or []), slope.alias("slope"), ((F.col("sy") - slope * F.col("sx")) / F.col("sw")).alias("intercept"))


def lrr_lines(model: DataFrame, by: list[str], value: str = "lrr", shift: bool = False, few: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """(medians, lines) of log ratios: the exact median ``m`` and number ``w`` of each (by, cn_in) above copy number 0, and of each group
    the ``slope``, ``intercept`` and ``shift`` that bring copy number 2 to 0 and the medians to log2(CN/2). ``few`` is that of
    :func:`stats.exact_medians`; without groups keys are few.
    """
    medians = stats.exact_medians(model.where("cn_in > 0"), [*by, "cn_in"], value, few=not by if few is None else few).select(*by, "cn_in", F.col("median").alias("m"), F.col("n").cast("double").alias("w"))
    zero = medians.groupBy(*by).agg(F.coalesce(F.max(F.when(F.col("cn_in") == 2, F.col("m"))), F.lit(0.0)).alias("shift"))
    points = medians.join(zero, by) if by else medians.join(F.broadcast(zero), how="cross")
    points = points.select(*by, (F.col("m") - F.col("shift")).alias("x"), F.log2(F.col("cn_in") / 2).alias("y"), "w")
    line = weighted_line(points, "x", "y", "w", by, shift)
    return medians, line.join(zero, by) if by else line.join(zero, how="cross")


def rescale_lrr(model: DataFrame) -> DataFrame:
    """Model medians rescaled: shifted so that CN 2 has median 0, then mapped by the weighted line from the copy numbers'
    medians to log2(CN/2). Adds ``lrr_rescaled`` and keeps the line in ``slope``, ``intercept``, ``shift``.
    """
    _, line = lrr_lines(model, [])
    return model.join(F.broadcast(line), how="cross").withColumn("lrr_rescaled", (F.col("lrr") - F.col("shift")) * F.col("slope") + F.col("intercept"))


def shift_probes(df: DataFrame, fitted: DataFrame, value: str = "lrr", by: str = "cn_in", median: str = "model_lrr") -> DataFrame:
    """Values shifted by (fitted median of the copy number − the probe's own model median)."""
    return df.join(F.broadcast(fitted.select(by, F.col("median").alias("_m"))), by, "left").withColumn(f"{value}_shifted", F.col(value) + F.col("_m") - F.col(median)).drop("_m")


def baf_targets(df: DataFrame) -> DataFrame:
    """Rows with ``target``: the BAF that the allelic state should have, 0 if uninformative, mirrored from 0.5 on."""
    known = F.lit(0.0)
    for state, t in BAF_TARGETS.items():
        known = F.when(F.col("as_in") == state, t).otherwise(known)
    target = F.when(F.col("inf_in"), known).otherwise(0.0)
    return df.withColumn("target", F.when(F.col("model_baf") >= 0.5, 1 - target).otherwise(target))


def rescale_baf(df: DataFrame, by: list[str] | None = None, shift: bool = False, few: bool | None = None) -> DataFrame:
    """BAF mapped by the weighted line from the medians of the targets to the targets, then shifted probe by probe to where the
    line puts the median of the target, and with ``zyg`` computed anew. ``masked`` rows, if marked, take no part in the fit and
    are mapped but not shifted. With ``by`` each group has medians and a line of its own, all groups in one job; ``shift`` is
    that of :func:`weighted_line`. Groups that are ``few`` have their medians and lines broadcast, else they are joined.
    """
    by, rows = by or [], baf_targets(df)
    few = not by if few is None else few
    told = F.broadcast if few else lambda x: x
    masked = F.col("masked") if "masked" in df.columns else F.lit(False)
    medians = stats.exact_medians(rows.where(~masked), [*by, "target"], "model_baf", few=few).select(*by, "target", F.col("median").alias("_m"), F.col("n").cast("double").alias("w"))
    line = weighted_line(medians, "_m", "target", "w", by, shift)
    if by:
        out = rows.join(told(medians.drop("w")), [*by, "target"], "left").join(told(line), by, "left")
    else:
        out = rows.join(F.broadcast(medians.drop("w")), "target", "left").join(F.broadcast(line), how="cross")
    out = out.withColumn("baf_rescaled", F.col("baf") * F.col("slope") + F.col("intercept"))
    moved = F.when(masked, 0.0).otherwise((F.col("_m") - F.col("model_baf")) * F.col("slope"))
    out = out.withColumn("baf_shifted", F.col("baf_rescaled") + moved)
    return out.withColumn("zyg", F.abs(F.col("baf_shifted") - 0.5) + 0.5).drop("slope", "intercept", "_m")


def hist_moments(hist: DataFrame, by: list[str], per_unit: int) -> DataFrame:
    """Mean and SD of a normalised histogram."""
    x = F.col("bin") / per_unit
    return hist.groupBy(*by).agg(F.sum(x * F.col("p")).alias("mean"), F.sqrt(F.greatest(F.sum(x * x * F.col("p")) - F.pow(F.sum(x * F.col("p")), F.lit(2.0)), F.lit(0.0))).alias("sd"))


def near_peak(df: DataFrame, peaks: DataFrame, by: str, nsd: float = 1.5) -> DataFrame:
    """Probes within ``nsd`` SDs of their copy number's zygosity peak, to six places."""
    return df.join(F.broadcast(peaks.select(by, F.col("mean").alias("_m"), F.col("sd").alias("_s"))), by).where(F.round(F.abs(F.col("zyg") - F.col("_m")), 6) <= F.round(nsd * F.col("_s"), 6)).drop("_m", "_s")


def normalize_emission(df: DataFrame, by: list[str], f: float, bad: float) -> DataFrame:
    """(1 − f) p + f bad, scaled to sum 1."""
    mixed = df.withColumn("p", (1 - f) * F.col("p") + f * bad)
    return mixed.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy(*by)))


def mosaic(low: DataFrame, high: DataFrame, by: list[str]) -> DataFrame:
    """Emission of a state between two: max(0, 1 − max(1 − cdf_low, cdf_high)), normalised; ``low`` and ``high`` hold
    (…, bin, p), and their order matters.
    """
    order = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    a = low.select(*by, "bin", F.sum("p").over(order).alias("cl"))
    b = high.select(*by, "bin", F.sum("p").over(order).alias("ch"))
    raw = a.join(b, [*by, "bin"]).withColumn("p", F.greatest(F.lit(0.0), 1 - F.greatest(1 - F.col("cl"), F.col("ch"))))
    total = F.sum("p").over(Window.partitionBy(*by))
    return raw.select(*by, "bin", F.when(total > 0, F.col("p") / total).otherwise(0.0).alias("p"))


def fill_states(states: DataFrame, fits: DataFrame) -> DataFrame:
    """States with fitted means and SDs; those without are dropped."""
    return states.join(F.broadcast(fits), "cn").where("zyg_mean is not null and lrr_mean is not null")


def project_missing(fits: DataFrame) -> DataFrame:
    """Fits (cn, lrr_mean, lrr_sd, zyg_mean) with copy numbers 0, 1, 3 and 4 filled in where no data gave them: fixed LRR for
    CN 1, the line through CN 1 and CN 2 on the log scale for CN 3 and 4, fixed zygosities for CN 3 and 4, and for CN 0 the limit
    two SDs below CN 1, under which all log ratios are alike.
    """
    one = F.max(F.when(F.col("cn") == 1, F.col("lrr_mean")))
    two = F.max(F.when(F.col("cn") == 2, F.col("lrr_mean")))
    sd = F.max(F.when(F.col("cn") == 2, F.col("lrr_sd")))
    known = fits.agg(F.coalesce(one, F.lit(CN1_LRR)).alias("m1"), F.coalesce(two, F.lit(0.0)).alias("m2"), F.coalesce(sd, F.lit(0.2)).alias("s2"), F.max(F.when(F.col("cn") == 1, F.col("lrr_sd"))).alias("s1"))
    wanted = known.withColumn("cn", F.explode(F.array(*(F.lit(float(c)) for c in (0, 1, 2, 3, 4)))))
    none = F.col("cn") == 0
    line = F.when(none, F.col("m1") - 2 * F.coalesce("s1", "s2")).otherwise(F.col("m2") + (F.col("m2") - F.col("m1")) * F.log2(F.nullif(F.col("cn"), F.lit(0.0)) / 2))
    zyg = F.when(F.col("cn") == 1, 1.0).when(F.col("cn").isin(0.0, 2.0), 0.5).when(F.col("cn") == 3, CN3_ZYG).otherwise(CN4_ZYG)
    have = fits.withColumnRenamed("lrr_mean", "_l").withColumnRenamed("lrr_sd", "_s").withColumnRenamed("zyg_mean", "_z")
    return wanted.join(have, "cn", "left").select("cn", F.coalesce("_l", line).alias("lrr_mean"), F.coalesce("_s", F.when(none, 0.0).otherwise(F.col("s2"))).alias("lrr_sd"), F.coalesce("_z", zyg).alias("zyg_mean"))


class State(NamedTuple):
    """A hidden state: its number, allelic state, copy number, allelism, whether it is mosaic, whether its probes are informative."""

    state: int
    name: str
    cn: float
    allelism: int
    mosaic: bool
    informative: bool


class Tables(NamedTuple):
    """Emission tables as flat arrays of doubles: by state and bin, for log ratios and for zygosities, the latter with that of one
    allele after the last state. Each comes with its first bin and the number of bins.
    """

    lrr: Column
    lrr_low: int
    lrr_n: int
    zyg: Column
    zyg_low: int
    zyg_n: int


def literal(values: list[float]) -> Column:
    """An array of doubles as one literal of the plan."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def literal_tables(states: list[State], keys: list[str], lrr: DataFrame, zyg: DataFrame) -> Tables:
    """Tables from (cn, bin, p) and (zyg_key, bin, p), whose size the bins fix, for states with the zygosity keys ``keys``; the key
    ``1`` is that of one allele. Bins and states without a row have probability 0.
    """
    ratios = {(float(r["cn"]), r["bin"]): r["p"] for r in lrr.collect()}
    zygs = {(r["zyg_key"], r["bin"]): r["p"] for r in zyg.collect()}
    spans = [(min(b), max(b) - min(b) + 1) for b in ([k[1] for k in t] or [0] for t in (ratios, zygs))]
    flat = lambda table, names, low, n: literal([float(table.get((k, b), 0.0)) for k in names for b in range(low, low + n)])
    return Tables(flat(ratios, [s.cn for s in states], *spans[0]), *spans[0], flat(zygs, [*keys, "1"], *spans[1]), *spans[1])


def log_emissions(probes: DataFrame, states: list[State], tables: Tables, penalties: list[float], mode: str = "segment", informative: float | None = None, bad: float = 0.01) -> DataFrame:
    """Rows with ``log_ep``: the log emission of every state, in order of state number.

    ``probes`` need cn_in, allelism_in, inf_in, zyg_bin and lrr_bin, or lrr_bins, an array of the LRR's bin as corrected for copy number
    0, 1, ... When refining, ``informative`` is the share of probes that are so, which weighs informative states against
    others; ``bad`` is that of probes that seem informative with one allele. Each state is one expression of its own over two
    array look-ups, so all of it is generated code, and no row carries a table.
    """
    by_cn, k1 = "lrr_bins" in probes.columns, len(states)

    def adjust(s: State, cn_in: int, allelism_in: int) -> float:
        """What a state's probability is multiplied by, given the input copy number and allelism."""
        away = abs(s.cn - cn_in)
        weight = 1.0 if away == 0 else penalties[0] if s.mosaic else penalties[max(int(away), 1) - 1] if max(int(away), 1) <= len(penalties) else 0.0
        if mode == "segment":
            if s.allelism > allelism_in or (cn_in == 0 and s.cn >= 1):
                return 0.0
            return penalties[1] if away == 0 and s.allelism != allelism_in else weight
        if informative is None:
            return weight
        chance = bad if s.allelism == 1 else informative
        return weight * (0.5 if s.allelism == 0 else chance if s.informative else 1 - chance)

    def place(bin_: Column, low: int, n: int) -> Column:
        return F.when(bin_.between(low, low + n - 1), bin_ - low)

    # Places in the tables come first, as columns of their own; a state is then one product of three look-ups.
    cns = sorted({int(s.cn) for s in states}) if by_cn else [0]
    bins = {c: F.get("lrr_bins", F.lit(c)) if by_cn else F.col("lrr_bin") for c in cns}
    rows = probes.withColumns({"_in": F.col("cn_in").cast("int") * 3 + F.col("allelism_in"), "_z": place(F.col("zyg_bin"), tables.zyg_low, tables.zyg_n), "_known": F.coalesce(F.col("inf_in"), F.lit(False)), **{f"_l{c}": place(bins[c], tables.lrr_low, tables.lrr_n) for c in cns}})

    def one(s: State) -> Column:
        adj = F.get(literal([adjust(s, c, a) for c in range(MOST_COPIES + 1) for a in range(3)]), F.col("_in"))
        lp = F.get(tables.lrr, F.col(f"_l{int(s.cn) if by_cn else 0}") + s.state * tables.lrr_n)
        own, one_allele = s.state * tables.zyg_n, k1 * tables.zyg_n
        block = F.lit(one_allele) if mode != "segment" and not s.informative else F.when(F.col("_known"), own).otherwise(one_allele)
        return safe_log(adj * lp * F.get(tables.zyg, F.col("_z") + block))

    return rows.withColumn("log_ep", F.array(*map(one, states))).drop("_in", "_z", "_known", *(f"_l{c}" for c in cns))
