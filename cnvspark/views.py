"""Views in the shapes of the engine's inputs over the given star-schema tables, and the same views as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cnvspark.session import importable, size

#: Bytes of Parquet whose probes one partition takes, some 300,000 rows of the given tables.
PART = 4 << 20

#: name -> (table, SQL). The SQL runs unchanged in Spark and DuckDB.
BASE = {
    "v_probe": ("lineitem", "SELECT l_suppkey AS sample, concat('chr', CAST(l_partkey % 22 + 1 AS STRING)) AS chrom, l_partkey*1000+1 AS pos, l_partkey AS probe, (l_discount-0.05)*20 AS lrr, (l_quantity-1)/49.0 AS baf, l_orderkey, l_linenumber FROM lineitem"),
    "v_segment": ("orders", "SELECT o_orderkey AS ord, concat('chr', CAST(o_custkey % 22 + 1 AS STRING)) AS chrom, (o_orderkey*7 % 2000)*1000 AS start, (o_orderkey*7 % 2000)*1000 + CAST(floor(o_totalprice/10) AS BIGINT) + 1 AS \"end\", CAST(o_orderkey % 5 AS INT) AS cn FROM orders"),
    "v_fragment": ("events", "SELECT event_id, event_type AS rname, (event_id*97) % 200000 + 1 AS pos, CAST(floor(value) AS BIGINT) + 1 AS tlen, CAST(user_id % 60 AS INT) AS mapq, CAST((event_id*37) % 4096 AS INT) AS flag, CASE WHEN event_id % 7 = 0 THEN 'other' ELSE '=' END AS rnext FROM events"),
    "v_contig": ("documents", "SELECT CAST(doc_id AS STRING) AS contig, upper(replace(text, 'ß', 'ss')) AS seq FROM documents"),
    "v_series": ("events", "SELECT user_id AS g, event_id AS t, value AS x, event_type AS cat FROM events"),
    "v_span": ("lineitem", "SELECT l_suppkey AS sample, concat('chr', CAST(l_orderkey % 22 + 1 AS STRING)) AS chrom, l_partkey*1000 AS flank_start, l_partkey*1000 + CAST(l_quantity AS BIGINT)*100 AS flank_end FROM lineitem"),
}

#: Views over views: one row for each (sample, probe); a model; decoded probes; anomalous runs.
DERIVED = {
    "v_obs": "SELECT sample, chrom, pos, probe, round(median(lrr), 6) AS lrr, round(median(baf), 6) AS baf FROM v_probe GROUP BY sample, chrom, pos, probe",
    "v_model": "SELECT probe, chrom, pos, round(median(lrr), 6) AS lrr, round(median(baf), 6) AS baf, CAST(1 + probe % 3 AS DOUBLE) AS cn_in, (probe * 37 % 60 + 20) / 100.0 AS frac_gc, CAST(probe * 37 % 60 + 20 AS INT) AS perc_gc FROM v_probe GROUP BY probe, chrom, pos",
    "v_state": "SELECT sample, chrom, pos, probe, lrr, baf, abs(baf - 0.5) + 0.5 AS zyg, probe % 17 = 0 AS masked, CAST(2 AS INT) AS cn_in, CAST(CASE WHEN lrr < -0.5 THEN 1 WHEN lrr > 0.5 THEN 3 ELSE 2 END AS INT) AS cn_out, CAST(2 AS INT) AS allelism_in, CAST(CASE WHEN lrr < -0.5 OR baf > 0.9 THEN 1 ELSE 2 END AS INT) AS allelism_out, abs(baf - 0.5) + 0.5 < 0.85 AS inf_in FROM v_obs",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame."""
    importable(spark)
    if name in BASE:
        source, sql = BASE[name]
        select = sql.split(" FROM ", 1)[0].removeprefix("SELECT ").replace('"', "`")
        df = spark.read.parquet(f"{sf_dir}/{source}.parquet")
        if " WHERE " in sql:
            df = df.where(sql.split(" WHERE ", 1)[1])
        return df.selectExpr(*_split(select))
    if name == "v_obs":
        # Dealt by sample and chromosome, rows meet once: medians, runs and ranks after it need no shuffle of their own.
        # Partitions grow in number with the table beyond what shuffles have, so that no task holds more of a larger one.
        parts = -(-size(spark, f"{sf_dir}/lineitem.parquet") // PART)
        more = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []
        return view(spark, sf_dir, "v_probe").repartition(*more, "sample", "chrom").groupBy("sample", "chrom", "pos", "probe").agg(F.round(F.median("lrr"), 6).alias("lrr"), F.round(F.median("baf"), 6).alias("baf"))
    if name == "v_model":
        df = view(spark, sf_dir, "v_probe").groupBy("probe", "chrom", "pos").agg(F.round(F.median("lrr"), 6).alias("lrr"), F.round(F.median("baf"), 6).alias("baf"))
        return df.selectExpr("*", "CAST(1 + probe % 3 AS DOUBLE) AS cn_in", "(probe * 37 % 60 + 20) / 100.0D AS frac_gc", "CAST(probe * 37 % 60 + 20 AS INT) AS perc_gc")
    if name == "v_state":
        select = DERIVED[name].split(" FROM ", 1)[0].removeprefix("SELECT ")
        return view(spark, sf_dir, "v_obs").selectExpr(*_split(select))
    raise KeyError(name)


def _split(select: str) -> list[str]:
    """The items of a select list, cut at commas outside parentheses."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[last:i].strip())
            last = i + 1
    return [*out, select[last:].strip()]


def with_views(*names: str) -> str:
    """``WITH`` and the views that a query needs, in order."""
    needed: list[str] = []
    for n in names:
        for k in {"v_obs": ("v_probe",), "v_model": ("v_probe",), "v_state": ("v_probe", "v_obs")}.get(n, ()):
            if k not in needed:
                needed.append(k)
        if n not in needed:
            needed.append(n)
    return "WITH " + ", ".join(f"{n} AS ({BASE[n][1] if n in BASE else DERIVED[n]})" for n in needed)
