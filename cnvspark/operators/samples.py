"""Sample tables, joins of observations with models, and orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns of an experiment table that are listed without repeats.
HIERARCHY = ("Experiment", "Cell_Line", "Cell_Clone")


def select_samples(df: DataFrame, column: str, *, experiment: str | None = None, line: str | None = None, clone: str | None = None, control: bool | None = None) -> DataFrame:
    """Values of a column of the experiment table under filters; those of the hierarchy without repeats."""
    rows = df
    for name, value in zip(HIERARCHY, (experiment, line, clone), strict=True):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if control is not None:
        rows = rows.where((F.upper("Control") == "YES") == control)
    rows = rows.select(column)
    return rows.distinct() if column in HIERARCHY else rows


def list_samples(manifest: DataFrame, row: str, name: str) -> DataFrame:
    """Sample names in manifest order, up to the first blank one."""
    blank = manifest.where(F.col(name).isNull() | (F.trim(F.col(name)) == "")).agg(F.min(row).alias("_first"))
    return manifest.join(F.broadcast(blank), how="cross").where(F.col("_first").isNull() | (F.col(row) < F.col("_first"))).select(row, name).orderBy(row)


def join_model(obs: DataFrame, model: DataFrame) -> DataFrame:
    """Observations with their probe's model."""
    return obs.join(model, "probe")


def in_model(obs: DataFrame, model: DataFrame) -> DataFrame:
    """Observations whose probe is in the model."""
    return obs.join(model.select("probe"), "probe", "left_semi")


def join_gc(df: DataFrame, gc: DataFrame) -> DataFrame:
    """Rows with GC content; those without are dropped."""
    return df.join(gc, "probe")


def join_gc_keep(df: DataFrame, gc: DataFrame) -> DataFrame:
    """Rows with GC content; those without are kept and masked."""
    return df.join(gc, "probe", "left").withColumn("masked", F.col("masked") | F.col("perc_gc").isNull())


def usable(df: DataFrame, *, mode: str, max_cn: float) -> DataFrame:
    """The cascade of rules a probe must pass: input copy number, positive, values, GC content, and not above ``max_cn``.
    ``discard`` drops probes that fail; ``mask`` keeps them, marked, so that samples stay aligned.
    """
    ok = F.coalesce((F.col("cn_in") > 0) & F.col("lrr").isNotNull() & F.col("baf").isNotNull() & F.col("frac_gc").isNotNull() & (F.col("cn_in") <= max_cn), F.lit(False))
    return df.where(ok) if mode == "discard" else df.withColumn("masked", ~ok)


def union_svs(dfs: list[DataFrame]) -> DataFrame:
    """The variants of all samples."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sort_probes(df: DataFrame) -> DataFrame:
    """Global order by chromosome (as text), position and probe."""
    return df.orderBy("chrom", "pos", "probe")


def sort_by_start(df: DataFrame, partitions: int) -> DataFrame:
    """Range partitions by chromosome and start, each sorted: a large order without a last merge."""
    return df.repartitionByRange(partitions, "chrom", "start").sortWithinPartitions("chrom", "start")


def number_in_order(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Rows with their number in order within ``by``."""
    return df.withColumn("ord", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
