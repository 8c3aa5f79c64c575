"""Scalar expressions on probes, alignments, sequences and intervals; all of them stay inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm_chrom(chrom: Column) -> Column:
    """A chromosome name with its ``chr`` prefix."""
    return F.when(chrom.startswith("chr"), chrom).otherwise(F.concat(F.lit("chr"), chrom))


def is_position(pos: Column) -> Column:
    """Whether a text is a position: digits alone."""
    return F.coalesce(pos.rlike("^[0-9]+$"), F.lit(False))


def null_failed(value: Column, other: Column) -> Column:
    """``value``, or NULL if it or ``other`` is not a number: a failed probe has neither."""
    return F.when(value.isNull() | other.isNull() | F.isnan(value) | F.isnan(other), F.lit(None)).otherwise(value)


def bed_point(pos: Column) -> tuple[Column, Column]:
    """(start, end) of a one-based position as a zero-based half-open interval."""
    return pos - 1, pos


def fittable(masked: Column, lrr: Column, low: float = -0.75, high: float = 0.5) -> Column:
    """Whether a probe may take part in a fit: unmasked, and its LRR within bounds."""
    return ~masked & lrr.between(low, high)


def size_within(start: Column, end: Column, least: int, most: int) -> Column:
    """Whether an interval's length lies within bounds, both included."""
    return (end - start).between(least, most)


def zygosity(baf: Column) -> Column:
    """How far an allele frequency is from balance, folded to [0.5, 1]."""
    return F.abs(baf - 0.5) + 0.5


def informative(zyg: Column, extreme: float = 0.85) -> Column:
    """Whether a zygosity tells alleles apart; NULL does not."""
    return F.coalesce(zyg < extreme, F.lit(False))


def bin_even(x: Column, n: int) -> Column:
    """The nearest of ``n`` bins a unit, halves to even, as an integer (so there is no negative zero)."""
    return F.rint(x * n).cast("int")


def round_away(x: Column, scalar: float = 1000.0) -> Column:
    """Rounding to 1/``scalar``, halves away from zero."""
    return F.signum(x) * F.floor(F.abs(x) * scalar + 0.5) / scalar


def flag_ok(flag: Column, mapq: Column, require: int = 32, forbid: int = 4 + 8 + 16 + 256 + 512 + 1024 + 2048, min_mapq: int = 0) -> Column:
    """Alignment flags: all required bits set, no forbidden one, and the mapping quality reached."""
    return (flag.bitwiseAND(F.lit(require)) == require) & (flag.bitwiseAND(F.lit(forbid)) == 0) & (mapq >= min_mapq)


def proper_template(rnext: Column, tlen: Column, max_tlen: int) -> Column:
    """Mate on the same contig and a template of positive length up to ``max_tlen``."""
    return (rnext == "=") & (tlen > 0) & (tlen <= max_tlen)


def probe_window(pos: Column, half: int = 100) -> tuple[Column, Column]:
    """(start, end) of the window around a probe, zero-based and half-open, cut at the contig's start."""
    return F.greatest(pos - (half + 1), F.lit(0)), pos + half


def perc_gc(frac: Column) -> Column:
    """GC percent by truncation."""
    return (frac * 100).cast("int")


def gc_fraction(seq: Column) -> Column:
    """Share of G and C in a sequence; NULL if it is empty."""
    upper = F.upper(seq)
    return (F.length(upper) - F.length(F.translate(upper, "GC", ""))) / F.nullif(F.length(upper), F.lit(0))


def revcomp(seq: Column) -> Column:
    """Reverse complement in capitals."""
    return F.translate(F.reverse(F.upper(seq)), "ACGT", "TGCA")


def lrr_to_cn(lrr: Column) -> Column:
    """Copy number that a log ratio stands for."""
    return 2 * F.pow(F.lit(2.0), lrr)


def scale_stats(mean: Column, sd: Column, ploidy: float, cn: float) -> tuple[Column, Column]:
    """Reference depth scaled from its ploidy to a copy number."""
    return mean / ploidy * cn, sd / ploidy * cn


def usable_depth(depth: Column, m1: float, s1: float, max_cn: int, nsd: float = 3.5) -> Column:
    """Whether a depth lies within the modelled range for 1 to ``max_cn`` copies."""
    return (depth >= m1 - nsd * s1) & (depth <= max_cn * (m1 + nsd * s1))


def safe_log(p: Column) -> Column:
    """Natural logarithm, with a floor for what is not positive."""
    return F.coalesce(F.ln(p), F.lit(-1e100))  # the logarithm of what is not positive is NULL


def signed_log10(x: Column) -> Column:
    """sign(x) log10(abs(x)); 0 for 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(F.signum(x) * F.log10(F.abs(x)))


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within limits."""
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def size_class(start: Column, end: Column, threshold: int = 2_000_000) -> Column:
    """``large`` beyond the threshold, else ``small``."""
    return F.when(end - start > threshold, "large").otherwise("small")


def alias_key(sample: Column, seed: int) -> Column:
    """The seeded hash of a sample's name, by whose order its group gives out aliases."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), sample).cast("binary"))


def blind_alias(number: Column) -> Column:
    """Two letters and two digits for a number from 0; numbers below 67,600 have aliases of their own, beyond that the digits are
    more. 40,503 and 67,600 have no common divisor, so neighbours are far apart and none meet.
    """
    number = number.cast("long")
    spread = F.when(number < 67_600, (number * 40_503) % 67_600).otherwise(number)
    letter = lambda x: F.char(F.lit(65) + x.cast("int"))
    digits = F.floor(spread / 676).cast("string")
    return F.concat(letter(spread % 26), letter(F.floor(spread / 26) % 26), F.lit("-"), F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))


#: The complementary error function by its classical Chebyshev fit, as SQL text that means the same in every engine.
_ERFC_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def erfc_sql(z: str) -> str:
    """SQL for erfc(z), absolute error below 2e-7."""
    t = f"(1.0/(1.0+0.5*abs({z})))"
    poly = f"({_ERFC_TERMS[-1]!r})"
    for c in reversed(_ERFC_TERMS[:-1]):
        poly = f"(({c!r}) + {t}*{poly})"
    body = f"({t}*exp(-({z})*({z}) + {poly}))"
    return f"(case when ({z}) >= 0 then {body} else 2.0 - {body} end)"


def phi_sql(x: str, mean: str, sd: str) -> str:
    """SQL for the normal distribution function."""
    return f"(0.5*{erfc_sql(f'(-(({x})-({mean}))/(({sd})*1.4142135623730951))')})"


def bin_prob_sql(x: str, mean: str, sd: str, half: float = 0.5, floor: float = 1e-99) -> str:
    """SQL for the normal probability of a bin around ``x``, with a floor."""
    return f"greatest({phi_sql(f'({x})+{half!r}', mean, sd)} - {phi_sql(f'({x})-{half!r}', mean, sd)}, {floor!r})"
