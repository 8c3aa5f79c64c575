"""Peaks of zygosity histograms: bounded Gaussians by EM over Spark aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranges of the peaks' means by copy number, simple and complex forms, and of their SDs.
UNINFORMATIVE = (0.95, 1.05)
MEANS = {
    2: {"simple": [(0.49, 0.54)], "complex": [(0.49, 0.54), (0.62, 0.72)]},
    3: {"simple": [(0.62, 0.72)], "complex": [(0.49, 0.54), (0.62, 0.72), (0.72, 0.79)]},
    4: {"simple": [(0.49, 0.54), (0.71, 0.79)], "complex": [(0.49, 0.54), (0.62, 0.72), (0.71, 0.79)]},
    5: {"simple": [(0.59, 0.65), (0.75, 0.82)], "complex": [(0.49, 0.54), (0.59, 0.65), (0.71, 0.79), (0.75, 0.82)]},
}
SD_RANGE, SD_START = (0.001, 0.1), 0.05


def fit_peaks(hist: DataFrame, bounds: list[tuple[float, float]], iters: int = 25) -> list[tuple[int, float, float, float]]:
    """(peak, weight, mean, sd) for peaks whose means stay within ``bounds``, from a histogram (x, n).

    The histogram has as many rows as there are bins; each step is one aggregation, of which 3 sums a peak come back.
    """
    hist = hist.select(F.col("x").cast("double"), F.col("n").cast("double")).cache()
    k = len(bounds)
    w, m, s = [1 / k] * k, [(a + b) / 2 for a, b in bounds], [SD_START] * k
    total = hist.agg(F.sum("n")).first()[0] or 0.0
    for _ in range(iters if total else 0):
        dens = [F.lit(w[j] / s[j]) * F.exp(-0.5 * ((F.col("x") - m[j]) / s[j]) ** 2) for j in range(k)]
        whole = sum(dens[1:], dens[0]) + F.lit(1e-300)
        z = [F.col("n") * d / whole for d in dens]
        got = hist.agg(*(F.sum(z[j]).alias(f"z{j}") for j in range(k)), *(F.sum(z[j] * F.col("x")).alias(f"x{j}") for j in range(k)), *(F.sum(z[j] * F.col("x") ** 2).alias(f"q{j}") for j in range(k))).first()
        for j, (low, high) in enumerate(bounds):
            zj = got[f"z{j}"]
            w[j] = zj / total
            if zj > 1e-9:
                m[j] = min(max(got[f"x{j}"] / zj, low), high)
                var = (got[f"q{j}"] - 2 * m[j] * got[f"x{j}"] + m[j] ** 2 * zj) / zj
                s[j] = min(max(max(var, 0.0) ** 0.5, SD_RANGE[0]), SD_RANGE[1])
    hist.unpersist()
    return [(j + 1, w[j], m[j], s[j]) for j in range(k)]
