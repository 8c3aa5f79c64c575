"""Emission tables fitted to the probes of each model or sample: zygosity peaks, log ratios, copy number 0 and mosaics.

One aggregation counts probes by group, input copy number, informativity and the two bins; a group's counts are bounded by the
bins, however many probes it has. Groups are then fitted from their counts, many in one call: what the groups of a call ask
for next is fitted together, one numpy step for all curves of a form. So all samples of a cohort are fitted in one job, and none
of it passes the driver. The tables of a group come back as flat arrays by state and bin.
"""

from __future__ import annotations

import math
from collections.abc import Generator, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cnvspark.functions import scalar as S
from cnvspark.operators import hmm
from cnvspark.operators.emissions import CN1_LRR, CN3_ZYG, CN4_ZYG, State
from cnvspark.operators.peaks import MEANS, SD_RANGE, SD_START, UNINFORMATIVE

# Bins a unit, share of bad probes, probes from which a state is fitted, how many SDs from a zygosity peak its
# probes may be, and the starts of means inside their bounds.
LRR_BINS, ZYG_BINS, BAD, LEAST, NEAR_SD = 30, 150, 1e-3, 1000, 1.5
STARTS = {(0.49, 0.54): 0.50, (0.62, 0.72): 0.67, (0.72, 0.79): 0.75, (0.71, 0.79): 0.75, (0.59, 0.65): 0.62, (0.75, 0.82): 0.79, UNINFORMATIVE: 1.0}
#: All log ratios and zygosities are taken into these ranges.
LRR_RANGE, ZYG_RANGE = (-5.0, 3.0), (0.5, 1.2)
LRR_LOW, LRR_N = round(LRR_RANGE[0] * LRR_BINS), round((LRR_RANGE[1] - LRR_RANGE[0]) * LRR_BINS) + 1
ZYG_LOW, ZYG_N = round(ZYG_RANGE[0] * ZYG_BINS), round((ZYG_RANGE[1] - ZYG_RANGE[0]) * ZYG_BINS) + 1


class Peak(NamedTuple):
    """A bell curve: weight, mean and SD, each as (least, start, most)."""

    weight: tuple[float, float, float]
    mean: tuple[float, float, float]
    sd: tuple[float, float, float]


def lrr_bin(x):
    """The bin of a log ratio, within the range of the tables."""
    return S.bin_even(S.clamp(x, *LRR_RANGE), LRR_BINS)


def zyg_bin(x):
    """The bin of a zygosity, within the range of the tables."""
    return S.bin_even(S.clamp(x, *ZYG_RANGE), ZYG_BINS)


class Curve(NamedTuple):
    """What to fit: ``f``, the shares of bins of ``width`` around ``x``, by a sum of bounded bell curves."""

    x: np.ndarray
    f: np.ndarray
    peaks: list[Peak]
    width: float


#: Each curve's weight, mean and SD, and the sum of squared residuals.
Fitted = tuple[list[tuple[float, float, float]], float]
#: A fit in steps: it asks for curves, goes on with what they give, and returns its result.
Steps = Generator[list[Curve], list[Fitted]]


def fit_curve(x: np.ndarray, f: np.ndarray, peaks: list[Peak], width: float, steps: int = 200) -> Fitted:
    """Least-squares fit of one curve (:func:`fit_curves`)."""
    return fit_curves([Curve(x, f, peaks, width)], steps)[0]


def fit_curves(asked: list[Curve], steps: int = 200) -> list[Fitted]:
    """Least-squares fits. Damped Gauss-Newton steps, cut to the bounds, from the start as given and from narrower curves; the
    better end counts. Curves of as many bins and peaks go on together: each step is one array operation over those that are not done.
    """
    alike: dict[tuple[int, int], list[int]] = {}
    for i, c in enumerate(asked):
        alike.setdefault((len(c.x), len(c.peaks)), []).append(i)
    out: list[Fitted] = [([], 0.0)] * len(asked)
    for places in alike.values():
        some = [asked[i] for i in places]
        # curve x peak x (weight, mean, SD) x (least, start, most)
        bounds = np.array([c.peaks for c in some], float).reshape(len(some), -1, 3)
        low, start, high = (np.ascontiguousarray(bounds[..., k]) for k in range(3))
        narrow = start.copy()
        narrow[:, 2::3] *= 0.3
        twice = lambda a: np.concatenate([a, a])
        x, f, width = (np.array([getattr(c, k) for c in some], float) for k in ("x", "f", "width"))
        at, loss = _descend(twice(x), twice(f), twice(low), np.concatenate([start, narrow]), twice(high), twice(width), steps)
        for k, i in enumerate(places):
            k += len(some) * bool(loss[len(some) + k] < loss[k])
            out[i] = [tuple(p) for p in at[k].reshape(-1, 3).tolist()], float(loss[k])
    return out


def _descend(x: np.ndarray, f: np.ndarray, low: np.ndarray, at: np.ndarray, high: np.ndarray, width: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fit_curves` of one form, a curve a row, each from one start: where they end, and their residuals."""
    at = np.clip(at, low, high)
    m, n = at.shape
    loss, damp, taken = np.empty(m), np.ones(m), np.zeros(m, int)
    pull, square, free = np.empty((m, n)), np.empty((m, n, n)), np.zeros((m, n), bool)
    bits = 1 << np.arange(n)

    def curves(rows: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        s = v[:, 2::3, None]
        z = x[rows, None] - v[:, 1::3, None]
        z /= s
        g = -0.5 * z
        g *= z
        np.exp(g, out=g)
        g *= width[rows, None, None]
        g /= s * math.sqrt(2 * math.pi)
        rest = f[rows] - (v[:, 0::3, None] * g).sum(axis=1)
        return z, g, rest, (rest**2).sum(axis=1)

    def alike(rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Which of ``rows`` have the same values free, and which those are."""
        codes = free[rows] @ bits
        for code in set(codes.tolist()):
            yield np.flatnonzero(codes == code), np.flatnonzero(bits & code)

    def settle(rows: np.ndarray, v: np.ndarray, z: np.ndarray, g: np.ndarray, rest: np.ndarray, now: np.ndarray) -> None:
        """Takes curves to where they are better."""
        s, wg = v[:, 2::3, None], v[:, 0::3, None] * g
        slopes = np.empty((len(rows), n // 3, 3, x.shape[1]))
        slopes[:, :, 0] = g
        np.divide(wg * z, s, out=slopes[:, :, 1])
        np.divide(wg * (z * z - 1), s, out=slopes[:, :, 2])
        slopes = slopes.reshape(len(rows), n, x.shape[1])
        at[rows], loss[rows] = v, now
        pull[rows] = to = (slopes @ rest[..., None])[..., 0]
        free[rows] = (high[rows] > low[rows]) & ~((v <= low[rows]) & (to < 0)) & ~((v >= high[rows]) & (to > 0))
        for some, values in alike(rows):
            part = slopes[some[:, None], values]
            square[rows[some, None, None], values[:, None], values] = part @ part.copy().transpose(0, 2, 1)

    def step(live: np.ndarray) -> np.ndarray:
        """One trial of each curve; those that go on."""
        new = at[live]
        for some, values in alike(live):
            rows, own = live[some], np.arange(len(values))
            a = square[rows[:, None, None], values[:, None], values]
            a[:, own, own] += damp[rows, None] * np.maximum(a[:, own, own], 1e-12)
            new[some[:, None], values] += np.linalg.solve(a, pull[rows[:, None], values][..., None])[..., 0]
        new = np.clip(new, low[live], high[live])
        z, g, rest, now = curves(live, new)
        better = now < loss[live]
        rows, worse = live[better], live[~better]
        gain = loss[rows] - now[better]
        settle(rows, new[better], z[better], g[better], rest[better], now[better])
        damp[rows], damp[worse] = np.maximum(damp[rows] / 10, 1e-9), damp[worse] * 10
        taken[rows] += 1
        going = np.empty(len(live), bool)
        going[better] = (gain >= 1e-14 * np.maximum(loss[rows], 1e-14)) & (taken[rows] < steps) & free[rows].any(axis=1)
        going[~better] = damp[worse] < 1e12
        return live[going]

    # In blocks that stay near the processor.
    blocks = lambda rows: np.split(rows, range(128, len(rows), 128))
    for rows in blocks(np.arange(m)):
        settle(rows, at[rows], *curves(rows, at[rows]))
    live = np.flatnonzero(free.any(axis=1))
    while len(live):
        live = np.concatenate([step(rows) for rows in blocks(live)])
    return at, loss


def together(fits: list[Steps]) -> list:
    """What fits in steps return: the curves that all of them ask for at a time are fitted in one call."""
    results, waiting = [None] * len(fits), {}

    def go_on(i: int, given: list[Fitted] | None) -> None:
        try:
            waiting[i] = fits[i].send(given)
        except StopIteration as end:
            results[i] = end.value
            waiting.pop(i, None)

    for i in range(len(fits)):
        go_on(i, None)
    while waiting:
        asked = list(waiting.items())
        given = iter(fit_curves([c for _, curves in asked for c in curves]))
        for i, curves in asked:
            go_on(i, [next(given) for _ in curves])
    return results


def normal(low: int, n: int, per_unit: int, mean: float, sd: float) -> np.ndarray:
    """Normal probabilities of integer bins."""
    edges = (np.arange(low, low + n + 1) - 0.5) / per_unit
    return np.diff([0.5 * math.erfc(z) for z in (-(edges - mean) / (max(sd, 1e-6) * math.sqrt(2))).tolist()])


def with_bad(p: np.ndarray, bad_p: float, share: float = BAD) -> np.ndarray:
    """Probabilities of which bad probes take a little, equally in all bins, with sum 1."""
    mixed = (1 - share) * p + share * bad_p
    return mixed / mixed.sum()


def between(low: np.ndarray, high: np.ndarray, bad_p: float) -> np.ndarray:
    """The table of a state between two: what neither's running sum has reached; ``low`` is that of smaller values."""
    p = np.maximum(0.0, 1 - np.maximum(1 - np.cumsum(low), np.cumsum(high)))
    return with_bad(p / p.sum() if p.sum() > 0 else p, bad_p)


def _free(bounds: tuple[float, float], weight: float, sd: tuple[float, float, float] = (SD_RANGE[0], SD_START, SD_RANGE[1]), only: bool = False) -> Peak:
    return Peak((1.0, 1.0, 1.0) if only else (0.0, weight, 1.0), (bounds[0], STARTS[bounds], bounds[1]), sd)


def _held(mean: float, sd: float, weight: float) -> Peak:
    return Peak((0.0, weight, 1.0), (mean, mean, mean), (sd, sd, sd))


class Zygosity(NamedTuple):
    """What the zygosities of a group give: tables by key, the chosen form and peaks by copy number, and where the peaks of
    log-ratio filters lie.
    """

    tables: dict[str, np.ndarray]
    forms: dict[int, str]
    peaks: dict[int, list[tuple[float, float, float]]]
    windows: dict[int, list[tuple[float, float]]]


def choose_form(f: np.ndarray, simple: list[Peak], complex_: list[Peak] | None) -> Steps:
    """The form of a copy number's zygosities with the lesser residual, and its peaks (ties: complex)."""
    x = (ZYG_LOW + np.arange(ZYG_N)) / ZYG_BINS
    if complex_ is None:
        ((one, _),) = yield [Curve(x, f, simple, 1 / ZYG_BINS)]
        return "simple", one
    (one, its), (two, others) = yield [Curve(x, f, peaks, 1 / ZYG_BINS) for peaks in (simple, complex_)]
    return ("simple", one) if its < others else ("complex", two)


def fit_zygosities(counts: dict[int, np.ndarray], extreme: np.ndarray, least: int = LEAST, mosaics: bool = False) -> Zygosity:
    """Zygosity tables from ``counts`` of informative probes by copy number and of the others (``extreme``).

    Keys: ``0`` (flat), ``1`` (one allele), the biallelic allelic states, and with ``mosaics`` those between. A copy number of one
    peak has the observed table, one of several the fitted curve of each; copy number 3 is always there, 4 if it or 3 was
    seen, 5 if it was seen.
    """
    return together([zygosity_steps(counts, extreme, least, mosaics)])[0]


def zygosity_steps(counts: dict[int, np.ndarray], extreme: np.ndarray, least: int = LEAST, mosaics: bool = False) -> Steps:
    """:func:`fit_zygosities` in steps."""
    bad = 1 / (ZYG_BINS * 0.5)
    share = lambda n: n / max(n.sum(), 1)
    curve = lambda p: with_bad(normal(ZYG_LOW, ZYG_N, ZYG_BINS, p[1], p[2]), bad)
    seen = lambda cn: counts.get(cn, np.zeros(ZYG_N)).sum()
    f = {cn: share(counts.get(cn, np.zeros(ZYG_N))) for cn in (2, 3, 4, 5)}
    x = (ZYG_LOW + np.arange(ZYG_N)) / ZYG_BINS
    lone = [_free(UNINFORMATIVE, 1.0, only=True)]
    z1 = [(1.0, 1.0, SD_START)]
    if extreme.sum():
        ((z1, _),) = yield [Curve(x, share(extreme), lone, 1 / ZYG_BINS)]
    tables = {"0": np.full(ZYG_N, 1 / ZYG_N), "1": with_bad(share(extreme), bad) if extreme.sum() else curve(z1[0])}
    forms, peaks, windows = {1: "simple"}, {1: z1}, {}
    b2, b3, b4, b5 = MEANS[2]["complex"], MEANS[3]["complex"], MEANS[4]["complex"], MEANS[5]["complex"]
    alone2, alone3 = [_free(b2[0], 1.0, only=True)], [_free(b3[1], 1.0, only=True)]
    three = seen(3) >= least
    if seen(2):
        forms[2], z2 = yield from choose_form(f[2], alone2, [_free(b2[0], 0.75), _free(b2[1], 0.25)] if three else None)
        actual2 = with_bad(f[2], bad)
    else:
        forms[2], z2 = "projected", [(1.0, 0.5, SD_START)]
        actual2 = curve(z2[0])
    tables["CN2_11"] = curve(z2[0]) if forms[2] == "complex" else actual2
    windows[2] = [(0.0, z2[0][1] + NEAR_SD * z2[0][2])]
    at = lambda p: (p[1] - NEAR_SD * p[2], p[1] + NEAR_SD * p[2])
    if three:
        forms[3], z3 = yield from choose_form(f[3], alone3, [_held(z2[0][1], z2[0][2], 0.2), _free(b3[1], 0.6), _free(b3[2], 0.2)])
        actual3 = with_bad(f[3], bad)
        peak3 = z3[1] if forms[3] == "complex" else z3[0]
        tables["CN3_12"] = curve(peak3) if forms[3] == "complex" else actual3
    else:
        forms[3], z3 = "projected", [(1.0, CN3_ZYG, z2[0][2])]
        peak3 = z3[0]
        tables["CN3_12"] = actual3 = curve(peak3)
    z4 = z5 = None
    if seen(4) >= least:
        low4 = Peak((0.0, 0.5, 1.0), (b4[0][0], min(max(z2[0][1], b4[0][0]), b4[0][1]), b4[0][1]), (SD_RANGE[0], z2[0][2], SD_RANGE[1]))
        forms[4], z4 = yield from choose_form(f[4], [low4, _free(b4[2], 0.5)], [_held(z2[0][1], z2[0][2], 0.4), _held(peak3[1], peak3[2], 0.2), _free(b4[2], 0.4)])
        tables["CN4_22"], tables["CN4_13"] = curve(z4[0]), curve(z4[-1])
        windows[4] = [(0.0, z4[0][1] + NEAR_SD * z4[0][2]), at(z4[-1])]
    elif three:
        # Copy number 4 is projected from the single peaks of 2 and 3.
        ((z3, _),) = yield [Curve(x, f[3], alone3, 1 / ZYG_BINS)]
        peak3, forms[3], tables["CN3_12"] = z3[0], "simple", actual3
        forms[4], z4 = "projected", [(1.0, CN4_ZYG, peak3[2])]
        tables["CN4_13"], tables["CN4_22"] = curve(z4[0]), tables["CN2_11"]
    windows[3] = [at(peak3)]
    if seen(5) >= least:
        s = z4[-1][2] if z4 else SD_START
        wide = (0.5 * s, s, 1.5 * s)
        first4 = z4[0] if z4 else (1.0, 0.5, SD_START)
        last4 = z4[-1] if z4 else (1.0, 0.75, SD_START)
        forms[5], z5 = yield from choose_form(f[5], [_free(b5[1], 0.5, wide), _free(b5[3], 0.5, wide)], [_held(first4[1], first4[2], 0.1), _free(b5[1], 0.4, wide), _held(last4[1], last4[2], 0.1), _free(b5[3], 0.4, wide)])
        inner, outer = (z5[1], z5[3]) if forms[5] == "complex" else (z5[0], z5[1])
        tables["CN5_23"], tables["CN5_14"] = curve(inner), curve(outer)
        windows[5] = [at(inner)]
    if mosaics:
        tables["CN1.5_11"], tables["CN2.5_12"] = between(actual2, tables["1"], bad), between(actual2, actual3, bad)
    peaks |= {cn: z for cn, z in ((2, z2), (3, z3), (4, z4), (5, z5)) if z}
    return Zygosity(tables, forms, peaks, windows)


def ratio_steps(cells: dict[str, np.ndarray], zyg: Zygosity, targets: dict[int, float], least: int = LEAST, mosaics: bool = False, span: float = 2.5) -> Steps:
    """Log-ratio tables and (mean, SD) by copy number, from cells (cn, informative, zyg, lrr_bin, n), in steps.

    A copy number's table is the observed one of the probes near its zygosity peaks. Where these are too few, it is a bell
    curve at ``targets``, or else along the copy numbers before; 0 is even below two SDs under copy number 1.
    """
    bad = 1 / (LRR_BINS * span)
    x = (LRR_LOW + np.arange(LRR_N)) / LRR_BINS

    def probes(cn: int, mask: np.ndarray) -> np.ndarray:
        rows = (cells["cn"] == cn) & mask
        return np.bincount(cells["lrr_bin"][rows] - LRR_LOW, weights=cells["n"][rows], minlength=LRR_N).astype(float)

    def near(windows: list[tuple[float, float]]) -> np.ndarray:
        hit = np.zeros(len(cells["zyg"]), bool)
        for low, high in windows:
            hit |= (cells["zyg"] >= low) & (cells["zyg"] <= high)
        return hit

    tables: dict[float, np.ndarray] = {}
    fits: dict[float, tuple[float, float]] = {}

    def observed(cn: int, n: np.ndarray) -> Steps:
        f = n / n.sum()
        mean = float((f * x).sum())
        ((((_, m, s),), _),) = yield [Curve(x, f, [Peak((1.0, 1.0, 1.0), (float(x[0]), mean, float(x[-1])), (0.001, 0.1, 1.0))], 1 / LRR_BINS)]
        tables[cn], fits[cn] = with_bad(f, bad), (m, s)

    def projected(cn: int, mean: float, sd: float) -> None:
        tables[cn], fits[cn] = with_bad(normal(LRR_LOW, LRR_N, LRR_BINS, mean, sd), bad), (mean, sd)

    two = probes(2, near(zyg.windows[2]))
    if two.sum():
        yield from observed(2, two)
    else:
        projected(2, targets.get(2, 0.0), 0.2)
    one = probes(1, ~cells["informative"])
    if one.sum() >= least:
        yield from observed(1, one)
    else:
        projected(1, targets.get(1, CN1_LRR), fits[2][1])
    three = probes(3, near(zyg.windows[3]))
    full = three.sum() >= least
    if full:
        yield from observed(3, three)
    else:
        projected(3, targets.get(3, fits[2][0] + (fits[2][0] - fits[1][0]) * 0.5 / 0.67), fits[2][1])
    if 4 in zyg.peaks:
        four = probes(4, near(zyg.windows[4])) if 4 in zyg.windows else np.zeros(LRR_N)
        if four.sum() >= least:
            yield from observed(4, four)
        elif full:
            projected(4, targets.get(4, fits[3][0] + (fits[3][0] - fits[2][0]) * 0.67 / 0.75), fits[3][1])
    if 5 in zyg.windows and (five := probes(5, near(zyg.windows[5]))).sum() >= least:
        yield from observed(5, five)
    limit = fits[1][0] - 2 * fits[1][1]
    below = x < limit
    tables[0], fits[0] = with_bad(below / max(below.sum(), 1), bad), (limit, 0.0)
    if mosaics:
        for cn in (1, 2):
            tables[cn + 0.5], fits[cn + 0.5] = between(tables[cn], tables[cn + 1], bad), ((fits[cn][0] + fits[cn + 1][0]) / 2, 0.0)
    return tables, fits


def key_of(state: State) -> str:
    """The zygosity table of a state: flat without alleles, that of one allele, or its own."""
    return str(state.allelism) if state.allelism <= 1 else state.name


def histogram(rows: DataFrame, by: list[str], low: float, high: float) -> DataFrame:
    """Probes that may take part in a fit (unmasked, log ratio within limits), counted by group, input copy number,
    informativity and bins. Rows need cn_in, lrr_corr, zyg and masked.
    """
    ok = S.fittable(F.col("masked"), F.col("lrr_corr"), low, high)
    return rows.where(ok).groupBy(*by, F.col("cn_in").cast("int").alias("cn"), S.informative(F.col("zyg")).alias("informative"), zyg_bin(F.col("zyg")).alias("zyg_bin"), lrr_bin(F.col("lrr_corr")).alias("lrr_bin")).agg(F.count(F.lit(1)).alias("n"))


def fit_tables(hist: DataFrame, by: list[str], states: list[State], *, targets: dict[int, float] | None = None, least: int = LEAST, span: float = 2.5) -> DataFrame:
    """(by, fits, lrr, zyg), a row for each group: the fitted states, and tables as flat arrays by state and bin, with that of one
    allele after the last state's zygosities. A state that a group cannot model has zeros and is never taken.
    """
    mosaics, x = any(s.mosaic for s in states), (ZYG_LOW + np.arange(ZYG_N)) / ZYG_BINS
    parts = ["state:int", "name:string", "cn:double", "form:string", *(f"{k}_{m}:double" for k in ("lrr", "zyg") for m in ("mean", "sd"))]
    tables = StructType.fromDDL(f"fits array<struct<{','.join(parts)}>>, lrr array<double>, zyg array<double>")
    schema = StructType([*(hist.schema[c] for c in by), *tables])

    def steps(cells: dict[str, np.ndarray]) -> Steps:
        inf, rest = cells["informative"], ~cells["informative"]
        binned = lambda rows: np.bincount(cells["zyg_bin"][rows] - ZYG_LOW, weights=cells["n"][rows], minlength=ZYG_N).astype(float)
        zyg = yield from zygosity_steps({int(cn): binned(inf & (cells["cn"] == cn)) for cn in np.unique(cells["cn"][inf])}, binned(rest), least, mosaics)
        ratios, means = yield from ratio_steps(cells | {"zyg": cells["zyg_bin"] / ZYG_BINS}, zyg, targets or {}, least, mosaics, span)
        lrr_flat, zyg_flat, fits = [], [], []
        for s in states:
            known = s.cn in ratios and key_of(s) in zyg.tables
            lrr_flat.append(ratios[s.cn] if known else np.zeros(LRR_N))
            table = zyg.tables[key_of(s)] if known else np.zeros(ZYG_N)
            zyg_flat.append(table)
            if known:
                mean = float((table * x).sum())
                fits.append((s.state, s.name, s.cn, zyg.forms.get(int(s.cn), "projected") if s.cn == int(s.cn) else "mosaic", *means[s.cn], mean, math.sqrt(max(float((table * x * x).sum()) - mean * mean, 0.0))))
        zyg_flat.append(zyg.tables["1"])
        names = ("state", "name", "cn", "form", "lrr_mean", "lrr_sd", "zyg_mean", "zyg_sd")
        return [dict(zip(names, f, strict=True)) for f in fits], np.concatenate(lrr_flat), np.concatenate(zyg_flat)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in hmm.whole_groups(batches, by):
            columns = {c: table.column(c).to_numpy() for c in ("cn", "informative", "zyg_bin", "lrr_bin", "n")}
            ends = [*starts[1:], table.num_rows]
            found = together([steps({c: v[a:b] for c, v in columns.items()}) for a, b in zip(starts, ends, strict=True)])
            told = [table.column(c).take(pa.array(starts)) for c in by]
            fits, *flat = zip(*found, strict=True)
            arrays = [*told, pa.array(fits, to_arrow_type(schema["fits"].dataType)), *(pa.array(list(a), pa.list_(pa.float64())) for a in flat)]
            yield from pa.table(arrays, names=schema.names).to_batches(max_chunksize=100)

    rows = hist.repartition(*by).sortWithinPartitions(*by) if by else hist.repartition(1)
    return rows.select(*by, "cn", "informative", "zyg_bin", "lrr_bin", "n").mapInArrow(fit, schema)
