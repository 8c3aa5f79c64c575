"""The registered queries of the engine's own operators, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cnvspark.functions import scalar as S
from cnvspark.operators import compare, coverage, emissions, fitting, gcbias, hmm, intervals, peaks, runs, samples, stats
from cnvspark.plans import pipelines, plotdata
from cnvspark.session import shared_path, written
from cnvspark.sources import readers, writers
from cnvspark.views import DERIVED, view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Bins for range joins over the given tables.
WIDTH = 100_000
SC = ["sample", "chrom"]


def _query(name: str, sql: str | None = None, views: str = "v_probe"):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql if sql.lstrip().upper().startswith("WITH") else f"{with_views(*views.split())} {sql}"
        return f

    return add


def _r(c, places: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, places)


# --- projections -----------------------------------------------------------------------------------------------------


@_query("prj1_norm_chrom", "SELECT probe, CASE WHEN starts_with(c, 'chr') THEN c ELSE concat('chr', c) END AS chrom, l_orderkey, l_linenumber FROM (SELECT *, CASE WHEN probe % 2 = 0 THEN replace(chrom, 'chr', '') ELSE chrom END AS c FROM v_probe)")
def prj1(spark, d):
    c = F.when(F.col("probe") % 2 == 0, F.replace(F.col("chrom"), F.lit("chr"), F.lit(""))).otherwise(F.col("chrom"))
    return view(spark, d, "v_probe").select("probe", S.norm_chrom(c).alias("chrom"), "l_orderkey", "l_linenumber")


@_query("prj2_valid_rows", "SELECT sample, probe, chrom, CAST(p AS BIGINT) AS pos FROM (SELECT *, CASE WHEN probe % 5 = 0 THEN '0x1' ELSE CAST(pos AS STRING) END AS p FROM v_probe) WHERE chrom IN ('chr1','chr2','chr3') AND regexp_full_match(p, '[0-9]+')")
def prj2(spark, d):
    df = view(spark, d, "v_probe").withColumn("p", F.when(F.col("probe") % 5 == 0, "0x1").otherwise(F.col("pos").cast("string")))
    return df.where(F.col("chrom").isin("chr1", "chr2", "chr3") & S.is_position(F.col("p"))).select("sample", "probe", "chrom", F.col("p").cast("long").alias("pos"))


@_query("prj3_null_failed", "SELECT sample, probe, l_orderkey, l_linenumber, CASE WHEN probe % 7 = 0 THEN NULL ELSE round(lrr, 6) END AS lrr, CASE WHEN probe % 7 = 0 THEN NULL ELSE round(baf, 6) END AS baf FROM v_probe")
def prj3(spark, d):
    df = view(spark, d, "v_probe").withColumn("lrr", F.when(F.col("probe") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("lrr")))
    return df.select("sample", "probe", "l_orderkey", "l_linenumber", _r(S.null_failed(F.col("lrr"), F.col("baf"))).alias("lrr"), _r(S.null_failed(F.col("baf"), F.col("lrr"))).alias("baf"))


@_query("prj4_bed_point", "SELECT sample, probe, pos - 1 AS start, pos AS \"end\" FROM v_probe")
def prj4(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", *(c.alias(n) for c, n in zip(S.bed_point(F.col("pos")), ("start", "end"), strict=True)))


@_query("prj5_zygosity", "SELECT sample, probe, l_orderkey, l_linenumber, round(abs(baf - 0.5) + 0.5, 6) AS zyg FROM v_probe")
def prj5(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", _r(S.zygosity(F.col("baf"))).alias("zyg"))


@_query("prj6_informative", "SELECT sample, probe, l_orderkey, l_linenumber, coalesce(abs(baf - 0.5) + 0.5 < 0.85, false) AS inf FROM v_probe")
def prj6(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", S.informative(S.zygosity(F.col("baf"))).alias("inf"))


@_query("prj7_bin_even", "SELECT sample, probe, l_orderkey, l_linenumber, CAST(round_even((abs(baf - 0.5) + 0.5) * 150, 0) AS INT) AS zyg_bin, CAST(round_even(lrr * 30, 0) AS INT) AS lrr_bin FROM v_probe")
def prj7(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", S.bin_even(S.zygosity(F.col("baf")), 150).alias("zyg_bin"), S.bin_even(F.col("lrr"), 30).alias("lrr_bin"))


@_query("prj8_round_away", "SELECT sample, probe, l_orderkey, l_linenumber, CAST(sign(x) * floor(abs(x) * 8 + 0.5) AS BIGINT) AS eighths FROM (SELECT *, lrr * 0.37 AS x FROM v_probe)")
def prj8(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", (S.round_away(F.col("lrr") * 0.37, 8.0) * 8).cast("long").alias("eighths"))


@_query("prj9_flag_filter", "SELECT event_id, flag, mapq FROM v_fragment WHERE flag & 32 = 32 AND flag & 3868 = 0 AND mapq >= 20", "v_fragment")
def prj9(spark, d):
    df = view(spark, d, "v_fragment")
    return df.where(S.flag_ok(F.col("flag"), F.col("mapq"), min_mapq=20)).select("event_id", "flag", "mapq")


@_query("prj10_proper_template", "SELECT event_id, tlen FROM v_fragment WHERE rnext = '=' AND tlen > 0 AND tlen <= 60", "v_fragment")
def prj10(spark, d):
    return view(spark, d, "v_fragment").where(S.proper_template(F.col("rnext"), F.col("tlen"), 60)).select("event_id", "tlen")


@_query("prj11_probe_window", "SELECT probe, chrom, greatest(pos - 101, 0) AS start, pos + 100 AS \"end\" FROM v_model", "v_model")
def prj11(spark, d):
    return gcbias.probe_windows(view(spark, d, "v_model"))


@_query("prj12_perc_gc", "SELECT probe, CAST(trunc(f * 100) AS INT) AS perc FROM (SELECT probe, (probe % 97) / 97.0 AS f FROM v_model)", "v_model")
def prj12(spark, d):
    return view(spark, d, "v_model").select("probe", S.perc_gc(F.expr("(probe % 97) / 97.0D")).alias("perc"))


def _with_holes(spark, d) -> DataFrame:
    df = view(spark, d, "v_model")
    return df.withColumn("frac_gc", F.when(F.col("probe") % 11 != 0, F.col("frac_gc"))).withColumn("cn_in", F.col("probe") % 6)


_HOLES = "SELECT probe, CASE WHEN probe % 11 <> 0 THEN frac_gc END AS frac_gc, probe % 6 AS cn_in, lrr, baf FROM v_model"


@_query("prj13_usable_discard", f"SELECT probe, cn_in FROM ({_HOLES}) WHERE cn_in > 0 AND lrr IS NOT NULL AND baf IS NOT NULL AND frac_gc IS NOT NULL AND cn_in <= 4", "v_model")
def prj13(spark, d):
    return samples.usable(_with_holes(spark, d), mode="discard", max_cn=4).select("probe", "cn_in")


@_query("prj13_usable_mask", f"SELECT probe, NOT coalesce(cn_in > 0 AND lrr IS NOT NULL AND baf IS NOT NULL AND frac_gc IS NOT NULL AND cn_in <= 4, false) AS masked FROM ({_HOLES})", "v_model")
def prj13m(spark, d):
    return samples.usable(_with_holes(spark, d), mode="mask", max_cn=4).select("probe", "masked")


@_query("prj14_fittable", "SELECT sample, probe, NOT masked AND lrr BETWEEN -0.75 AND 0.5 AS fittable FROM v_state", "v_state")
def prj14(spark, d):
    return view(spark, d, "v_state").select("sample", "probe", S.fittable(F.col("masked"), F.col("lrr")).alias("fittable"))


@_query("prj15_usable_depth", "SELECT g, t FROM v_series WHERE x >= 20 - 3.5 * 4 AND x <= 3 * (20 + 3.5 * 4)", "v_series")
def prj15(spark, d):
    return view(spark, d, "v_series").where(S.usable_depth(F.col("x"), 20.0, 4.0, 3)).select("g", "t")


@_query("prj16_scale_stats", "SELECT g, round(avg(x) / 2 * 3, 6) AS mean, round(stddev_samp(x) / 2 * 3, 6) AS sd FROM v_series GROUP BY g", "v_series")
def prj16(spark, d):
    m, s = S.scale_stats(F.col("mean"), F.col("sd"), 2.0, 3.0)
    return stats.mean_sd(view(spark, d, "v_series"), ["g"], "x").select("g", _r(m).alias("mean"), _r(F.when(F.col("n") > 1, s)).alias("sd"))


@_query("prj17_lrr_to_cn", "SELECT sample, probe, l_orderkey, l_linenumber, round(2 * pow(2, lrr), 6) AS cn FROM v_probe")
def prj17(spark, d):
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", _r(S.lrr_to_cn(F.col("lrr"))).alias("cn"))


@_query("prj18_changes", "SELECT sample, probe, CASE WHEN NOT masked THEN cn_out - cn_in END AS cnc, CASE WHEN NOT masked THEN (CASE WHEN allelism_out <= 1 THEN false ELSE inf_in END) <> inf_in END AS loh FROM v_state", "v_state")
def prj18(spark, d):
    return runs.derive_changes(view(spark, d, "v_state")).select("sample", "probe", "cnc", F.col("loh_probe").alias("loh"))


@_query("prj19_anomalous", "SELECT sample, probe FROM v_state WHERE NOT masked AND (cn_out <> cn_in OR allelism_out < allelism_in)", "v_state")
def prj19(spark, d):
    return runs.flag_anomalous(view(spark, d, "v_state")).where("anomalous").select("sample", "probe")


@_query("prj20_size_class", "SELECT ord, CASE WHEN \"end\" - start > 15000 THEN 'large' ELSE 'small' END AS size FROM v_segment", "v_segment")
def prj20(spark, d):
    return view(spark, d, "v_segment").select("ord", S.size_class(F.col("start"), F.col("end"), 15_000).alias("size"))


_ALIAS = "SELECT sample, concat(chr(CAST(65 + h % 26 AS INT)), chr(CAST(65 + h // 26 % 26 AS INT)), '-', lpad(CAST(h // 676 AS STRING), 2, '0')) AS alias FROM (SELECT sample, (row_number() OVER (ORDER BY md5(concat('7:', CAST(sample AS STRING))), sample) - 1) * 40503 % 67600 AS h FROM (SELECT DISTINCT sample FROM v_probe))"


@_query("prj21_blind_alias", _ALIAS)
def prj21(spark, d):
    return writers.group_manifest(view(spark, d, "v_probe").select("sample").distinct(), 7)


@_query("prj22_revcomp", "SELECT contig, md5(translate(reverse(upper(seq)), 'ACGT', 'TGCA')) AS digest FROM v_contig", "v_contig")
def prj22(spark, d):
    return view(spark, d, "v_contig").select("contig", F.md5(S.revcomp(F.col("seq")).cast("binary")).alias("digest"))


@_query("prj23_safe_log", "SELECT sample, probe, l_orderkey, l_linenumber, CASE WHEN lrr > 0 THEN round(ln(lrr), 6) ELSE -1e100 END AS log_p FROM v_probe")
def prj23(spark, d):
    log = S.safe_log(F.col("lrr"))
    return view(spark, d, "v_probe").select("sample", "probe", "l_orderkey", "l_linenumber", F.when(log > -1e99, _r(log)).otherwise(log).alias("log_p"))


@_query("prj24_signed_log10", "SELECT sample, probe, l_orderkey, l_linenumber, CASE WHEN y = 0 THEN 0.0 ELSE round(sign(y) * log10(abs(y)), 6) END AS shown, greatest(least(y, 50.0), -50.0) AS clamped FROM (SELECT *, CAST(round(lrr * 100) AS DOUBLE) AS y FROM v_probe)")
def prj24(spark, d):
    df = view(spark, d, "v_probe").withColumn("y", F.round(F.col("lrr") * 100))
    return df.select("sample", "probe", "l_orderkey", "l_linenumber", _r(S.signed_log10(F.col("y"))).alias("shown"), S.clamp(F.col("y"), -50.0, 50.0).alias("clamped"))


@_query("prj26_size_bounds", "SELECT ord, \"end\" - start AS span FROM v_segment WHERE \"end\" - start BETWEEN 5000 AND 20000", "v_segment")
def prj26(spark, d):
    return view(spark, d, "v_segment").where(S.size_within(F.col("start"), F.col("end"), 5000, 20000)).select("ord", (F.col("end") - F.col("start")).alias("span"))


# --- joins -----------------------------------------------------------------------------------------------------------


@_query("jn1_first_match", "SELECT m.probe, m.chrom, m.pos, arg_min(s.cn, s.ord) AS cn FROM v_model m LEFT JOIN v_segment s ON s.chrom = m.chrom AND s.start <= m.pos AND s.\"end\" + 1 >= m.pos GROUP BY ALL", "v_model v_segment")
def jn1(spark, d):
    points = view(spark, d, "v_model").select("probe", "chrom", "pos")
    return intervals.first_match(points, view(spark, d, "v_segment"), width=WIDTH, value="cn").select("probe", "chrom", "pos", "cn")


@_query("jn1_first_match_half_open", "SELECT m.probe, m.chrom, m.pos, arg_min(s.cn, s.ord) AS cn FROM v_model m LEFT JOIN v_segment s ON s.chrom = m.chrom AND s.start < m.pos AND s.\"end\" >= m.pos GROUP BY ALL", "v_model v_segment")
def jn1h(spark, d):
    points = view(spark, d, "v_model").select("probe", "chrom", "pos")
    return intervals.first_match(points, view(spark, d, "v_segment"), width=WIDTH, value="cn", mode="half_open").select("probe", "chrom", "pos", "cn")


@_query("jn2_join_model", "SELECT o.sample, o.probe, o.lrr, m.lrr AS model_lrr, m.cn_in FROM v_obs o JOIN v_model m ON o.probe = m.probe", "v_obs v_model")
def jn2(spark, d):
    model = view(spark, d, "v_model").select("probe", F.col("lrr").alias("model_lrr"), "cn_in")
    return samples.join_model(view(spark, d, "v_obs").select("sample", "probe", "lrr"), model).select("sample", "probe", "lrr", "model_lrr", "cn_in")


@_query("jn3_in_model", "SELECT sample, probe, lrr FROM v_obs WHERE probe IN (SELECT probe FROM v_model WHERE cn_in = 2)", "v_obs v_model")
def jn3(spark, d):
    return samples.in_model(view(spark, d, "v_obs"), view(spark, d, "v_model").where("cn_in = 2")).select("sample", "probe", "lrr")


@_query("jn4_join_gc", "SELECT o.sample, o.probe, m.frac_gc FROM v_obs o JOIN (SELECT * FROM v_model WHERE probe % 11 <> 0) m ON o.probe = m.probe", "v_obs v_model")
def jn4(spark, d):
    gc = view(spark, d, "v_model").where("probe % 11 <> 0").select("probe", "frac_gc")
    return samples.join_gc(view(spark, d, "v_obs").select("sample", "probe"), gc).select("sample", "probe", "frac_gc")


@_query("jn5_join_gc_keep", "SELECT o.sample, o.probe, o.masked OR m.probe IS NULL AS masked FROM v_state o LEFT JOIN (SELECT * FROM v_model WHERE probe % 11 <> 0) m ON o.probe = m.probe", "v_state v_model")
def jn5(spark, d):
    gc = view(spark, d, "v_model").where("probe % 11 <> 0").select("probe", "perc_gc")
    return samples.join_gc_keep(view(spark, d, "v_state").select("sample", "probe", "masked"), gc).select("sample", "probe", "masked")


_FIT = """WITH {views}, s AS (SELECT cn_in, CAST(count(*) AS DOUBLE) n, sum(frac_gc) g1, sum(frac_gc*frac_gc) g2, sum(frac_gc*frac_gc*frac_gc) g3, sum(frac_gc*frac_gc*frac_gc*frac_gc) g4, sum(lrr) y, sum(frac_gc*lrr) gy, sum(frac_gc*frac_gc*lrr) g2y, median(lrr) AS med FROM v_model GROUP BY cn_in),
c AS (SELECT cn_in, med, {c0} AS c0, {c1} AS c1, {c2} AS c2 FROM s), fit AS (SELECT cn_in, CAST(p AS INT) AS perc_gc, c0 + c1*(p/100.0) + c2*(p/100.0)*(p/100.0) - med AS off FROM c, (SELECT unnest(range(0, 101)) AS p))"""


def _fit_sql(rest: str, *extra: str) -> str:
    return _FIT.format(views=with_views("v_model", *extra).removeprefix("WITH "), **gcbias.QUADRATIC) + " " + rest


@_query("mod1_fit_gc", _fit_sql("SELECT cn_in, perc_gc, round(off, 6) AS offset_ FROM fit"))
def mod1(spark, d):
    return gcbias.fit_gc(view(spark, d, "v_model")).select("cn_in", "perc_gc", _r("offset").alias("offset_"))


@_query("jn6_apply_gc", _fit_sql("SELECT o.sample, o.probe, round(o.lrr - f.off, 5) AS lrr_corr FROM v_obs o JOIN v_model m ON o.probe = m.probe LEFT JOIN fit f ON f.cn_in = m.cn_in AND f.perc_gc = m.perc_gc", "v_obs"))
def jn6(spark, d):
    model = view(spark, d, "v_model")
    obs = view(spark, d, "v_obs").select("sample", "probe", "lrr").join(model.select("probe", "cn_in", "perc_gc"), "probe")
    return gcbias.apply_gc(obs, gcbias.fit_gc(model)).select("sample", "probe", _r("lrr_corr", 5).alias("lrr_corr"))


@_query("jn7_candidate_lrr", _fit_sql("SELECT m.probe, k.cn, round(CASE WHEN k.cn = 0 THEN m.lrr ELSE m.lrr - f.off END, 5) AS lrr_cn FROM v_model m CROSS JOIN (SELECT unnest([0,1,2,3,4,5])::INT AS cn) k LEFT JOIN fit f ON f.cn_in = least(greatest(k.cn, 1), 3) AND f.perc_gc = m.perc_gc"))
def jn7(spark, d):
    model = view(spark, d, "v_model")
    return gcbias.candidate_lrr(model.select("probe", "lrr", "perc_gc"), gcbias.fit_gc(model), [0, 1, 2, 3, 4, 5]).select("probe", "cn", _r("lrr_cn", 5).alias("lrr_cn"))


def _states(spark, d) -> DataFrame:
    """``v_state`` for queries that read it several times: written once, so medians are not taken anew for each."""
    return written(view(spark, d, "v_state"), "states")


def _emission_tables(spark, d, states: DataFrame | None = None):
    rows = (view(spark, d, "v_state") if states is None else states).where("not masked").select("sample", "probe", F.col("cn_out").alias("cn"), S.bin_even(F.col("lrr"), 30).alias("lrr_bin"), S.bin_even(F.col("zyg"), 150).alias("zyg_bin"))
    return rows


@_query("jn8_emission_lookup", """SELECT r.sample, r.probe, round(e.p, 6) AS p FROM (SELECT sample, probe, cn_out, CAST(round_even(lrr*30,0) AS INT) AS b FROM v_state WHERE NOT masked) r
 LEFT JOIN (SELECT cn_out, b, count(*) / sum(count(*)) OVER (PARTITION BY cn_out) AS p FROM (SELECT cn_out, CAST(round_even(lrr*30,0) AS INT) AS b FROM v_state WHERE NOT masked) GROUP BY cn_out, b) e ON e.cn_out = r.cn_out AND e.b = r.b""", "v_state")
def jn8(spark, d):
    rows = _emission_tables(spark, d)
    table = stats.obs_histogram(rows, ["cn"], "lrr_bin", -40, 40).select("cn", F.col("bin").alias("lrr_bin"), "p")
    return rows.join(F.broadcast(table), ["cn", "lrr_bin"], "left").select("sample", "probe", _r("p").alias("p"))


@_query("jn9_state_attributes", None)
def jn9(spark, d):
    states = readers.load_states(spark, 5.0, True).groupBy("copy_number").agg(F.max("allelism").alias("allelism"))
    rows = view(spark, d, "v_state").select("sample", "probe", F.col("cn_out").cast("double").alias("copy_number"))
    return rows.join(F.broadcast(states), "copy_number")


ORACLES["jn9_state_attributes"] = f"{with_views('v_state')} SELECT sample, probe, CAST(cn_out AS DOUBLE) AS copy_number, CAST(CASE WHEN cn_out = 1 THEN 1 ELSE 2 END AS INT) AS allelism FROM v_state"


@_query("src14_load_states", "SELECT l_linenumber AS cn, count(*) AS n, CAST(max(CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 5 WHEN 5 THEN 5 END) AS BIGINT) AS states FROM lineitem WHERE l_linenumber <= 5 GROUP BY 1")
def src14(spark, d):
    states = readers.load_states(spark, 5.0, False).groupBy(F.col("copy_number").cast("int").alias("cn")).agg(F.count(F.lit(1)).alias("states"))
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_linenumber").alias("cn"))
    return rows.join(F.broadcast(states), "cn").groupBy("cn").agg(F.count(F.lit(1)).alias("n"), F.first("states").alias("states"))


@_query("jn10_combine_categories", "SELECT a, b, row_number() OVER (ORDER BY b, a) AS idx FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linestatus AS b FROM lineitem)")
def jn10(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return hmm.combine_categories([(li.select(F.col("l_returnflag").alias("a")).distinct(), "a"), (li.select(F.col("l_linestatus").alias("b")).distinct(), "b")])


@_query("jn11_index_observations", "SELECT l.l_returnflag AS a, l.l_linestatus AS b, idx, count(*) AS n FROM lineitem l JOIN (SELECT a, b, row_number() OVER (ORDER BY b, a) AS idx FROM (SELECT DISTINCT l_returnflag AS a FROM lineitem) CROSS JOIN (SELECT DISTINCT l_linestatus AS b FROM lineitem)) x ON x.a = l.l_returnflag AND x.b = l.l_linestatus GROUP BY ALL")
def jn11(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b"))
    return hmm.index_observations(li, jn10(spark, d), ["a", "b"]).groupBy("a", "b", "idx").agg(F.count(F.lit(1)).alias("n"))


_RUNS = """u AS (SELECT *, CASE WHEN NOT masked THEN sum(CASE WHEN NOT masked THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY pos, probe ROWS UNBOUNDED PRECEDING) END AS uidx FROM v_state),
a AS (SELECT * FROM u WHERE NOT masked AND (cn_out <> cn_in OR allelism_out < allelism_in)),
f AS (SELECT *, CASE WHEN uidx - lag(uidx) OVER w = 1 AND cn_out = lag(cn_out) OVER w THEN 0 ELSE 1 END AS fresh, CASE WHEN pos - lag(pos) OVER w <= 100000 AND cn_out = lag(cn_out) OVER w THEN 0 ELSE 1 END AS far FROM a WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos, probe)),
r AS (SELECT *, CAST(sum(fresh) OVER w AS BIGINT) AS run, CAST(sum(far) OVER w AS BIGINT) AS merged, CASE WHEN allelism_out <= 1 THEN false ELSE inf_in END AS inf_out FROM f WINDOW w AS (PARTITION BY sample, chrom ORDER BY pos, probe ROWS UNBOUNDED PRECEDING))"""


def _runs_sql(rest: str) -> str:
    return f"{with_views('v_state')}, {_RUNS} {rest}"


def _run_rows(spark, d, states: DataFrame | None = None) -> DataFrame:
    rows = runs.usable_index(runs.flag_anomalous(view(spark, d, "v_state") if states is None else states), SC)
    return runs.anomalous_runs(runs.derive_changes(rows), SC)


@_query("jn12_keep_runs", _runs_sql("SELECT sample, chrom, run, probe FROM r WHERE (sample, chrom, run) IN (SELECT (sample, chrom, run) FROM r GROUP BY sample, chrom, run HAVING count(*) >= 2)"))
def jn12(spark, d):
    rows = _run_rows(spark, d)
    kept = rows.groupBy(*SC, "run").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    return runs.keep_runs(rows, kept, SC).select("sample", "chrom", "run", "probe")


@_query("jn13_overlap_all", "SELECT s.ord, m.probe FROM v_segment s JOIN v_model m ON s.chrom = m.chrom AND m.pos BETWEEN s.start AND s.\"end\"", "v_segment v_model")
def jn13(spark, d):
    return intervals.overlap_all(view(spark, d, "v_segment"), view(spark, d, "v_model").select("probe", "chrom", "pos"), width=WIDTH).select("ord", "probe")


@_query("jn14_widen_by_rank", _runs_sql(""", k AS (SELECT sample, chrom, probe, pos, row_number() OVER (PARTITION BY sample, chrom ORDER BY pos, probe) AS rank FROM v_state), sv AS (SELECT sample, chrom, run, min(pos) AS s, max(pos) AS e FROM r GROUP BY sample, chrom, run),
b AS (SELECT sv.sample, sv.chrom, run, min(rank) - 10 AS lo, max(rank) + 10 AS hi FROM sv JOIN k ON k.sample = sv.sample AND k.chrom = sv.chrom AND pos BETWEEN s AND e GROUP BY ALL)
SELECT concat(CAST(b.sample AS STRING), ':', b.chrom, ':', CAST(run AS STRING)) AS sv, k.probe, CAST(rank AS INT) AS rank FROM b JOIN k ON k.sample = b.sample AND k.chrom = b.chrom AND rank BETWEEN lo AND hi"""))
def jn14(spark, d):
    spans = _run_rows(spark, d).groupBy(*SC, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    spans = spans.withColumn("sv", F.concat_ws(":", F.col("sample").cast("string"), "chrom", F.col("run").cast("string")))
    return intervals.widen_by_rank(spans, view(spark, d, "v_state").select(*SC, "probe", "pos")).select("sv", "probe", "rank")


@_query("jn14_widen_in_region", ORACLES["jn14_widen_by_rank"].replace("min(rank) - 10 AS lo, max(rank) + 10 AS hi FROM", "min(rank) - 10 AS lo, max(rank) + 10 AS hi, min(s) - 200000 AS from_, max(e) + 100000 AS to_ FROM") + " AND k.pos BETWEEN from_ AND to_")
def jn14_region(spark, d):
    spans = _run_rows(spark, d).groupBy(*SC, "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"))
    spans = spans.withColumns({"sv": F.concat_ws(":", F.col("sample").cast("string"), "chrom", F.col("run").cast("string")), "from_": F.col("start") - 200_000, "to_": F.col("end") + 100_000})
    return intervals.widen_by_rank(spans, view(spark, d, "v_state").select(*SC, "probe", "pos"), region=("from_", "to_")).select("sv", "probe", "rank")


_REGIONS = """i AS (SELECT *, max(flank_end) OVER (PARTITION BY chrom ORDER BY flank_start, flank_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_span),
j AS (SELECT *, CAST(sum(CASE WHEN reach IS NULL OR flank_start > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY flank_start, flank_end ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM i),
g AS (SELECT chrom, island, min(flank_start) AS start, max(flank_end) AS "end", count(*) AS n_svs, count(DISTINCT sample) AS n_samples, array_to_string(list_sort(list(DISTINCT sample)), ',') AS samples FROM j GROUP BY chrom, island)"""


def _regions_sql(rest: str) -> str:
    return f"{with_views('v_span')}, {_REGIONS} {rest}"


def _regions(spark, d) -> DataFrame:
    return intervals.collapse_regions(view(spark, d, "v_span"))


@_query("jn15_contained", _regions_sql(", n AS (SELECT *, row_number() OVER (ORDER BY chrom, start) AS region_id FROM g) SELECT s.sample, s.chrom, s.flank_start, s.flank_end, region_id FROM v_span s JOIN n ON n.chrom = s.chrom AND s.flank_start >= n.start AND s.flank_end <= n.\"end\""))
def jn15(spark, d):
    regions = written(intervals.number_regions(_regions(spark, d)), "regions")  # joined with the spans once, not worked out beside them
    return intervals.contained(view(spark, d, "v_span"), regions, WIDTH).select("sample", "chrom", "flank_start", "flank_end", "region_id")


_PAIRS = """e AS (SELECT sample, probe, masked, cn_out - 1 AS model_state, [-0.5*(lrr+0.5)*(lrr+0.5), -0.5*lrr*lrr, -0.5*(lrr-0.5)*(lrr-0.5)] AS ep FROM v_state),
sv AS (SELECT concat(CAST(sample AS STRING), ':', chrom, ':', CAST(run AS STRING)) AS sv, sample, probe, cn_out - 1 AS state FROM r),
p AS (SELECT sv.sv, sv.sample, e.sample AS target, sum(ep[sv.state + 1] - ep[e.model_state + 1]) AS score, count(*) AS n FROM sv JOIN e ON e.probe = sv.probe WHERE NOT e.masked GROUP BY ALL)"""


def _pair_inputs(spark, d):
    lrr, states = F.col("lrr"), _states(spark, d)
    probes = runs.derive_changes(states).select("sample", "probe", "masked", (F.col("cn_out") - 1).alias("model_state"), F.array(-0.5 * (lrr + 0.5) * (lrr + 0.5), -0.5 * lrr * lrr, -0.5 * (lrr - 0.5) * (lrr - 0.5)).alias("log_ep"), ((F.col("cnc") != 0) | F.col("loh_probe")).alias("changed"))
    svs = _run_rows(spark, d, states).select(F.concat_ws(":", F.col("sample").cast("string"), "chrom", F.col("run").cast("string")).alias("sv"), *SC, "pos", "probe", (F.col("cn_out") - 1).alias("state"))
    return svs, probes


@_query("jn16_pair_scores", _runs_sql(f", {_PAIRS} SELECT sv, sample, target, round(score, 5) AS score, n FROM p"))
def jn16(spark, d):
    return compare.pair_scores(*_pair_inputs(spark, d)).select("sv", "sample", "target", _r("score", 5).alias("score"), "n")


@_query("mod22_rescore", _runs_sql(f", {_PAIRS} SELECT sv, sample, round(max(CASE WHEN target = sample THEN score END), 5) AS qrll, round(min(CASE WHEN target <> sample THEN score END), 5) AS min_trll, round(max(CASE WHEN target <> sample THEN score END), 5) AS max_trll FROM p GROUP BY sv, sample"))
def mod22(spark, d):
    return compare.extreme_samples(compare.pair_scores(*_pair_inputs(spark, d))).select("sv", "sample", *(_r(c, 5).alias(c) for c in ("qrll", "min_trll", "max_trll")))


@_query("agg17_extreme_samples", _runs_sql(f", {_PAIRS}, q AS (SELECT sv, sample, target, round(score, 4) AS score FROM p) SELECT sv, sample, arg_min(target, (score, target)) FILTER (WHERE target <> sample) AS min_trll_smp, arg_min(target, (-score, target)) FILTER (WHERE target <> sample) AS max_trll_smp FROM q GROUP BY sv, sample"))
def agg17(spark, d):
    scores = compare.pair_scores(*_pair_inputs(spark, d)).withColumn("score", _r("score", 4))
    return compare.extreme_samples(scores).select("sv", "sample", "min_trll_smp", "max_trll_smp")


@_query("agg18_overlap_samples", _runs_sql(", k AS (SELECT sv, x.sample, list_sort(list(DISTINCT v.sample)) AS l FROM (SELECT concat(CAST(sample AS STRING), ':', chrom, ':', CAST(run AS STRING)) AS sv, sample, probe FROM r) x JOIN v_state v ON v.probe = x.probe AND v.sample <> x.sample AND (v.cn_out <> v.cn_in OR (v.allelism_out <= 1 AND v.inf_in)) AND NOT v.masked GROUP BY sv, x.sample) SELECT s.sv, s.sample, coalesce(array_to_string(l, ','), '') AS ovlp_smp FROM (SELECT DISTINCT concat(CAST(sample AS STRING), ':', chrom, ':', CAST(run AS STRING)) AS sv, sample FROM r) s LEFT JOIN k ON k.sv = s.sv AND k.sample = s.sample"))
def agg18(spark, d):
    return compare.overlap_samples(*_pair_inputs(spark, d))


@_query("jn17_weighted_counts", "SELECT g, round(sum(n * w), 6) AS loglik FROM (SELECT g, cat, count(*) AS n FROM v_series GROUP BY g, cat) JOIN (SELECT cat, avg(x) AS w FROM v_series GROUP BY cat) USING (cat) GROUP BY g", "v_series")
def jn17(spark, d):
    df = view(spark, d, "v_series")
    counts = df.groupBy("g", "cat").agg(F.count(F.lit(1)).alias("n"))
    return hmm.weighted_counts(counts, df.groupBy("cat").agg(F.avg("x").alias("w")), ["cat"]).select("g", _r("loglik").alias("loglik"))


@_query("jn18_slice_sequence", "SELECT contig AS chrom, 37 AS start, 237 AS \"end\", md5(substring(seq, 38, 200)) AS digest FROM v_contig WHERE length(seq) >= 237", "v_contig")
def jn18(spark, d):
    contigs = view(spark, d, "v_contig")
    spans = contigs.where("length(seq) >= 237").select(F.col("contig").alias("chrom"), F.lit(37).alias("start"), F.lit(237).alias("end"))
    cut = gcbias.slice_sequence(spans, readers.chunk_sequences(contigs, 100), 100)
    return cut.select("chrom", "start", "end", F.md5(F.col("seq").cast("binary")).alias("digest"))


@_query("jn19_exclude", "SELECT f.sample, f.chrom, f.flank_start, f.flank_end FROM v_span f WHERE f.chrom NOT IN ('chr21') AND NOT EXISTS (SELECT 1 FROM v_segment s WHERE s.chrom = f.chrom AND s.start < f.flank_end AND s.\"end\" > f.flank_start)", "v_span v_segment")
def jn19(spark, d):
    features = view(spark, d, "v_span").withColumnsRenamed({"flank_start": "start", "flank_end": "end"})
    left = intervals.exclude(features, view(spark, d, "v_segment"), width=WIDTH, skip=("chr21",))
    return left.select("sample", "chrom", F.col("start").alias("flank_start"), F.col("end").alias("flank_end"))


# --- aggregations ----------------------------------------------------------------------------------------------------


@_query("agg1_probe_medians", "SELECT probe, round(median(lrr), 6) AS lrr, round(median(baf), 6) AS baf, count(*) AS n FROM v_probe GROUP BY probe")
def agg1(spark, d):
    return stats.probe_medians(view(spark, d, "v_probe"), ["probe"], values=("lrr", "baf")).select("probe", _r("lrr").alias("lrr"), _r("baf").alias("baf"), "n")


@_query("agg2_mean_sd", "SELECT sample, chrom, round(avg(lrr), 6) AS mean, round(coalesce(stddev_samp(lrr), 0), 6) AS sd, count(lrr) AS n FROM v_probe GROUP BY sample, chrom")
def agg2(spark, d):
    return stats.mean_sd(view(spark, d, "v_probe"), SC, "lrr").select(*SC, _r("mean").alias("mean"), _r("sd").alias("sd"), "n")


@_query("agg3_trimmed", "SELECT sample, chrom, round(m, 5) AS mean, round(CASE WHEN n >= 2 THEN sqrt(greatest((q - n * m * m) / (n - 1), 0)) ELSE 0 END, 4) AS sd FROM (SELECT sample, chrom, count(*) - 2 AS n, CASE WHEN count(*) >= 3 THEN (sum(lrr) - min(lrr) - max(lrr)) / (count(*) - 2) ELSE 0 END AS m, sum(lrr * lrr) - min(lrr) * min(lrr) - max(lrr) * max(lrr) AS q FROM v_probe GROUP BY sample, chrom)")
def agg3(spark, d):
    return stats.trimmed_mean_sd(view(spark, d, "v_probe"), SC, "lrr").select(*SC, _r("mean", 5).alias("mean"), _r("sd", 4).alias("sd"))


@_query("agg4_norm_histogram", "SELECT k.sample, b.bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.sample), 3) AS freq FROM (SELECT DISTINCT sample FROM v_probe WHERE lrr BETWEEN -0.9 AND 0.9) k CROSS JOIN (SELECT CAST(unnest(range(-18, 19)) AS INT) AS bin) b LEFT JOIN (SELECT sample, CAST(round_even(lrr * 20, 0) AS INT) AS bin, count(*) AS n FROM v_probe WHERE lrr BETWEEN -0.9 AND 0.9 GROUP BY ALL) c ON c.sample = k.sample AND c.bin = b.bin")
def agg4(spark, d):
    return stats.norm_histogram(view(spark, d, "v_probe"), ["sample"], "lrr", 20, -0.9, 0.9)


@_query("agg5_obs_histogram", "SELECT k.cn_out AS cn, b.bin, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.cn_out), 6) AS p FROM (SELECT DISTINCT cn_out FROM v_state WHERE NOT masked) k CROSS JOIN (SELECT CAST(unnest(range(75, 151)) AS INT) AS bin) b LEFT JOIN (SELECT cn_out, CAST(round_even(zyg * 150, 0) AS INT) AS bin, count(*) AS n FROM v_state WHERE NOT masked GROUP BY ALL) c ON c.cn_out = k.cn_out AND c.bin = b.bin", "v_state")
def agg5(spark, d):
    return stats.obs_histogram(_emission_tables(spark, d), ["cn"], "zyg_bin", 75, 150).select("cn", "bin", _r("p").alias("p"))


_COVER = """c AS (SELECT rname AS chrom, bin, round(sum((least(pos - 1 + tlen, (bin + 1) * 500) - greatest(pos - 1, bin * 500)) / CAST(tlen AS DOUBLE)), 2) AS "count" FROM (SELECT rname, pos, tlen, unnest(range((pos - 1) // 500, (pos + tlen - 2) // 500 + 1)) AS bin FROM v_fragment WHERE rnext = '=') GROUP BY ALL)"""


def _cover(spark, d) -> DataFrame:
    return coverage.fragment_coverage(view(spark, d, "v_fragment").where("rnext = '='"), 500)


def _cover_sql(rest: str) -> str:
    return f"{with_views('v_fragment')}, {_COVER} {rest}"


@_query("agg6_fragment_coverage", _cover_sql('SELECT chrom, bin, "count" FROM c'))
def agg6(spark, d):
    return _cover(spark, d)


@_query("agg7_region_stats", _cover_sql('SELECT count(*) AS n, round(avg("count"), 5) AS mean, round(coalesce(stddev_samp("count"), 0), 5) AS sd, CAST(2 AS DOUBLE) AS cn FROM c WHERE chrom = \'click\' AND bin * 500 + 1 >= 10001 AND (bin + 1) * 500 <= 150000'))
def agg7(spark, d):
    return coverage.region_stats(_cover(spark, d), "click:10,001-150,000/2", 500).select("n", _r("mean", 5).alias("mean"), _r("sd", 5).alias("sd"), "cn")


@_query("agg8_gc_fraction", "SELECT contig, round((length(seq) - length(replace(replace(seq, 'G', ''), 'C', ''))) / CAST(nullif(length(seq), 0) AS DOUBLE), 6) AS frac FROM v_contig", "v_contig")
def agg8(spark, d):
    return view(spark, d, "v_contig").select("contig", _r(S.gc_fraction(F.col("seq"))).alias("frac"))


@_query("agg9_crosstab", "SELECT chrom, count(*) FILTER (WHERE cn_out = 1) AS \"1\", count(*) FILTER (WHERE cn_out = 2) AS \"2\", count(*) FILTER (WHERE cn_out = 3) AS \"3\" FROM v_state GROUP BY chrom", "v_state")
def agg9(spark, d):
    return stats.crosstab(view(spark, d, "v_state"), "chrom", "cn_out", [1, 2, 3])


_SEG = """b AS (SELECT *, CAST(least(floor("count" * 2), 3) AS INT) AS cn FROM c), w AS (SELECT *, CASE WHEN bin - lag(bin) OVER o = 1 AND cn IS NOT DISTINCT FROM lag(cn) OVER o THEN 0 ELSE 1 END AS fresh FROM b WINDOW o AS (PARTITION BY chrom ORDER BY bin)),
s AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY chrom ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM w)"""


def _called(spark, d) -> DataFrame:
    return _cover(spark, d).withColumn("cn", F.least(F.floor(F.col("count") * 2), F.lit(3)).cast("int"))


@_query("win3_bin_runs", _cover_sql(f", {_SEG} SELECT chrom, bin, run FROM s"))
def win3(spark, d):
    return coverage.bin_runs(_called(spark, d), ["chrom"], "cn").select("chrom", "bin", "run")


@_query("agg10_collapse_bins", _cover_sql(f', {_SEG} SELECT chrom, run, min(bin) * 500 AS start, (max(bin) + 1) * 500 AS "end", first(cn) AS cn, count(*) AS n_bins, round(avg("count"), 5) AS mean, round(coalesce(stddev_samp("count"), 0), 5) AS sd FROM s GROUP BY chrom, run'))
def agg10(spark, d):
    return coverage.collapse_bins(_called(spark, d), ["chrom"], "cn", 500).withColumn("mean", _r("mean", 5)).withColumn("sd", _r("sd", 5))


@_query("mod21_segment_weights", _cover_sql(f""", {_SEG}, q AS (SELECT chrom, run, coalesce(stddev_samp("count"), 0) AS seg_sd FROM s GROUP BY chrom, run),
l AS (SELECT s.chrom, s.run, sum(ln({S.bin_prob_sql('"count"', '1.0', 'greatest(round_even(greatest(0.5, seg_sd), 0), 1.0)')})) AS a, sum(ln({S.bin_prob_sql('"count"', '2.0', 'greatest(round_even(greatest(0.8, seg_sd), 0), 1.0)')})) AS b FROM s JOIN q ON q.chrom = s.chrom AND q.run = s.run GROUP BY ALL)
SELECT chrom, run, round(exp(a - greatest(a, b)), 5) AS cn1, round(exp(b - greatest(a, b)), 5) AS cn2 FROM l"""))
def mod21(spark, d):
    bins = coverage.bin_runs(_called(spark, d), ["chrom"], "cn")
    segs = coverage.collapse_bins(_called(spark, d), ["chrom"], "cn", 500)
    return coverage.segment_cn_weights(bins, segs, [(1.0, 0.5), (2.0, 0.8)], ["chrom"]).select("chrom", "run", _r("cn1", 5).alias("cn1"), _r("cn2", 5).alias("cn2"))


@_query("agg11_run_evidence", _runs_sql("SELECT sample, chrom, run, count(*) FILTER (WHERE cn_out <> cn_in OR (inf_in AND NOT inf_out)) AS n_probes, count(*) FILTER (WHERE inf_in) AS n_inf FROM r GROUP BY sample, chrom, run"))
def agg11(spark, d):
    return runs.run_evidence(_run_rows(spark, d), SC)


@_query("agg12_filter_runs", _runs_sql("SELECT sample, chrom, run, count(*) FILTER (WHERE cn_out <> cn_in OR (inf_in AND NOT inf_out)) AS n_probes, count(*) FILTER (WHERE inf_in) AS n_inf FROM r GROUP BY sample, chrom, run HAVING n_probes >= 2 AND n_probes + n_inf >= 3"))
def agg12(spark, d):
    return runs.filter_runs(runs.run_evidence(_run_rows(spark, d), SC), 2, 3)


@_query("agg13_run_spans", _runs_sql("SELECT sample, chrom, run, min(pos) AS start, max(pos) AS \"end\", max(pos) - min(pos) + 1 AS span, array_to_string(list_sort(list(DISTINCT CAST(cn_in AS STRING))), ',') AS cn_in, array_to_string(list_sort(list(DISTINCT CAST(cn_out AS STRING))), ',') AS cn_out, array_to_string(list_sort(list(DISTINCT CAST(cn_out - cn_in AS STRING))), ',') AS cnc, bool_or(allelism_out < allelism_in) AS loh_run FROM r GROUP BY sample, chrom, run"))
def agg13(spark, d):
    return runs.run_spans(_run_rows(spark, d), SC)


@_query("agg14_run_means", _runs_sql("SELECT sample, chrom, run, round(avg(lrr), 5) AS lrr_mean, round(coalesce(stddev_samp(lrr), 0), 5) AS lrr_sd, round(round(avg(CASE WHEN inf_in THEN zyg END), 9), 4) AS zyg_mean, round(round(stddev_samp(CASE WHEN inf_in THEN zyg END), 9), 4) AS zyg_sd FROM r GROUP BY sample, chrom, run"))
def agg14(spark, d):
    return runs.run_means(_run_rows(spark, d), SC).select(*SC, "run", *(_r(c, 5).alias(c) for c in ("lrr_mean", "lrr_sd")), *(_r(_r(c, 9), 4).alias(c) for c in ("zyg_mean", "zyg_sd")))


@_query("agg15_called_cn", _runs_sql(", k AS (SELECT cn_in, cn_in / median(2 * pow(2, lrr)) AS corr FROM v_state WHERE NOT masked AND cn_out = cn_in GROUP BY cn_in) SELECT sample, chrom, run, round(median(2 * pow(2, lrr) * coalesce(corr, 1)), 2) AS cn_clc, 0.0 AS cn_p FROM r LEFT JOIN k ON k.cn_in = r.cn_out GROUP BY sample, chrom, run"))
def agg15(spark, d):
    return runs.called_cn(view(spark, d, "v_state"), _run_rows(spark, d), SC)


@_query("agg16_collapse_regions", _regions_sql('SELECT chrom, island, start, "end", n_svs, n_samples, samples FROM g'))
def agg16(spark, d):
    return _regions(spark, d).select("chrom", "island", "start", "end", "n_svs", "n_samples", "samples")


@_query("agg19_fittable_cns", "SELECT cn_in, count(*) AS n FROM v_model WHERE cn_in > 0 GROUP BY cn_in HAVING count(*) >= 500", "v_model")
def agg19(spark, d):
    return gcbias.fittable_cns(view(spark, d, "v_model"), 500)


@_query("agg20_sufficient", "SELECT cn_out AS cn, count(*) FILTER (WHERE NOT masked AND lrr BETWEEN -0.75 AND 0.75) >= 100 AS ok FROM v_state GROUP BY cn_out", "v_state")
def agg20(spark, d):
    return stats.sufficient(view(spark, d, "v_state").withColumn("cn", F.col("cn_out")), "cn", S.fittable(F.col("masked"), F.col("lrr"), high=0.75), 100)


@_query("agg21_informative_fraction", "SELECT round(avg(CAST(inf_in AS INT)), 6) AS fraction FROM v_state WHERE NOT masked", "v_state")
def agg21(spark, d):
    return stats.informative_fraction(view(spark, d, "v_state")).select(_r("fraction").alias("fraction"))


@_query("agg22_median_of_medians", "SELECT cn_in, round(median(lrr), 6) AS median, count(lrr) AS n FROM v_model GROUP BY cn_in", "v_model")
def agg22(spark, d):
    return stats.median_of_medians(view(spark, d, "v_model"), "cn_in", "lrr").withColumn("median", _r("median"))


@_query("agg23_weighted_median", """, m AS (SELECT g, CAST(floor(x) AS BIGINT) AS x, sum(t % 4) AS w FROM v_series GROUP BY ALL), a AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY x ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY g) / 2.0 AS half, lead(x) OVER (PARTITION BY g ORDER BY x) AS nx FROM m WHERE w > 0)
 SELECT k.g, CAST(coalesce(CASE WHEN run = half THEN (x + nx) / 2.0 ELSE x END, 0) AS DOUBLE) AS weighted_median FROM (SELECT DISTINCT g FROM v_series) k LEFT JOIN a ON a.g = k.g AND run >= half AND run - w < half""", "v_series")
def agg23(spark, d):
    df = view(spark, d, "v_series").select("g", F.floor("x").alias("x"), (F.col("t") % 4).alias("w"))
    return stats.weighted_median(df, ["g"], "x", "w")


@_query("agg24_sub_runs", _runs_sql("SELECT sample, chrom, merged, count(DISTINCT run) AS n_sub FROM r GROUP BY sample, chrom, merged"))
def agg24(spark, d):
    rows = runs.two_level_runs(runs.usable_index(runs.flag_anomalous(view(spark, d, "v_state")), SC), SC)
    return runs.sub_run_count(rows, SC)


@_query("agg25_fraction_changed", "SELECT round(avg(CASE WHEN cn_out <> cn_in THEN 1.0 ELSE 0.0 END), 6) AS fraction FROM v_state", "v_state")
def agg25(spark, d):
    return stats.fraction_changed(view(spark, d, "v_state")).select(_r("fraction").alias("fraction"))


@_query("agg26_svs_per_chrom", "SELECT chrom, count(*) AS n FROM v_span GROUP BY chrom", "v_span")
def agg26(spark, d):
    return view(spark, d, "v_span").groupBy("chrom").agg(F.count(F.lit(1)).alias("n"))


@_query("agg27_likelihood_hist", "SELECT floor(v / 10) * 10 AS low, count(*) AS n FROM (SELECT least(round(exp((1 + ord % 40) / CAST(1 + ord % 7 AS DOUBLE)), 6), 250.0) AS v FROM v_segment) GROUP BY 1", "v_segment")
def agg27(spark, d):
    svs = view(spark, d, "v_segment").selectExpr("CAST(1 + ord % 40 AS DOUBLE) AS rel_ll", "CAST(1 + ord % 7 AS DOUBLE) AS n_probes")
    return stats.avg_likelihood_hist(svs).withColumn("low", F.col("low").cast("double"))


@_query("agg28_load_report", "SELECT count(*) AS total, count(*) FILTER (WHERE chrom = 'chr1') AS matched, count(*) FILTER (WHERE chrom = 'chr1' AND lrr > 0) AS used FROM v_probe")
def agg28(spark, d):
    return stats.load_report(view(spark, d, "v_probe"), F.col("chrom") == "chr1", F.col("lrr") > 0)


@_query("agg29_mode_window_mean", "SELECT c.g, c.mode, round(avg(x), 6) AS mean, count(*) AS n FROM v_series s JOIN (SELECT g, arg_min(cell, (-n, cell)) AS mode FROM (SELECT g, CAST(floor(x) AS BIGINT) AS cell, count(*) AS n FROM v_series GROUP BY ALL) GROUP BY g) c ON c.g = s.g WHERE x BETWEEN 0.5 * mode AND 1.5 * mode GROUP BY ALL", "v_series")
def agg29(spark, d):
    return stats.mode_window_mean(view(spark, d, "v_series"), ["g"], "x", 1.0).select("g", F.col("mode").cast("long").alias("mode"), _r("mean").alias("mean"), "n")


@_query("agg30_score_calls", "SELECT s.ord, count(m.lrr) AS n, round(avg(m.lrr), 5) AS mean, round(coalesce(stddev_samp(m.lrr), 0), 5) AS sd, round(abs(avg(m.lrr) - 0.1) * sqrt(count(m.lrr)) / 0.25, 4) AS z FROM v_segment s JOIN v_model m ON s.chrom = m.chrom AND m.pos BETWEEN s.start AND s.\"end\" GROUP BY s.ord", "v_segment v_model")
def agg30(spark, d):
    hits = intervals.overlap_all(view(spark, d, "v_segment"), view(spark, d, "v_model").select("probe", "chrom", "pos", "lrr"), width=WIDTH)
    return compare.score_calls(hits, ["ord"], 0.1, 0.25).select("ord", "n", _r("mean", 5).alias("mean"), _r("sd", 5).alias("sd"), _r("z", 4).alias("z"))


@_query("agg31_unique_variants", _regions_sql("SELECT j.sample, j.chrom, j.flank_start, j.flank_end FROM j JOIN g ON g.chrom = j.chrom AND g.island = j.island WHERE n_samples = 1"))
def agg31(spark, d):
    svs = intervals.interval_union(view(spark, d, "v_span"), "flank_start", "flank_end", ["chrom"])
    return compare.unique_variants(svs, _regions(spark, d)).select("sample", "chrom", "flank_start", "flank_end")


# --- windows ---------------------------------------------------------------------------------------------------------


@_query("win1_usable_index", _runs_sql("SELECT sample, chrom, probe, CAST(uidx AS BIGINT) AS uidx FROM u"))
def win1(spark, d):
    return runs.usable_index(view(spark, d, "v_state"), SC).select(*SC, "probe", F.col("uidx").cast("long").alias("uidx"))


@_query("win2_anomalous_runs", _runs_sql("SELECT sample, chrom, probe, run FROM r"))
def win2(spark, d):
    return _run_rows(spark, d).select(*SC, "probe", "run")


@_query("win4_interval_union", _regions_sql("SELECT sample, chrom, flank_start, flank_end, island FROM j"))
def win4(spark, d):
    return intervals.interval_union(view(spark, d, "v_span"), "flank_start", "flank_end", ["chrom"]).select("sample", "chrom", "flank_start", "flank_end", "island")


@_query("win5_number_regions", _regions_sql("SELECT chrom, start, n_svs, row_number() OVER (ORDER BY CASE WHEN \"end\" - start > 50000 THEN 1 ELSE 0 END, chrom, start) AS region_id FROM g"))
def win5(spark, d):
    big = (S.size_class(F.col("start"), F.col("end"), 50_000) == "large").cast("int")
    return intervals.number_regions(_regions(spark, d), [big]).select("chrom", "start", "n_svs", "region_id")


@_query("win6_flanks", _runs_sql(""", q AS (SELECT sample, chrom, pos, probe, coalesce(lag(pos, 10) OVER o, min(pos) OVER p) AS b, coalesce(lead(pos, 10) OVER o, max(pos) OVER p) AS e FROM u WHERE NOT masked WINDOW o AS (PARTITION BY sample, chrom ORDER BY pos, probe), p AS (PARTITION BY sample, chrom))
 SELECT r.sample, r.chrom, run, arg_min(b, (q.pos, q.probe)) AS flank_start, arg_max(e, (q.pos, q.probe)) AS flank_end FROM r JOIN q ON q.sample = r.sample AND q.chrom = r.chrom AND q.pos = r.pos AND q.probe = r.probe GROUP BY r.sample, r.chrom, run"""))
def win6(spark, d):
    return runs.flanks(view(spark, d, "v_state"), SC, _run_rows(spark, d))


@_query("win7_two_level_runs", _runs_sql("SELECT sample, chrom, probe, run, merged FROM r"))
def win7(spark, d):
    rows = runs.usable_index(runs.flag_anomalous(view(spark, d, "v_state")), SC)
    return runs.two_level_runs(rows, SC).select(*SC, "probe", "run", "merged")


_HIST = "h AS (SELECT cn_out AS cn, CAST(round_even(lrr * 10, 0) AS INT) AS bin, count(*) AS n FROM v_state GROUP BY ALL), p AS (SELECT cn, bin, n / sum(n) OVER (PARTITION BY cn) AS p FROM h)"


def _hist(spark, d) -> DataFrame:
    h = view(spark, d, "v_state").groupBy(F.col("cn_out").alias("cn"), S.bin_even(F.col("lrr"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("p"))
    return stats.normalize(h, ["cn"], "p")


@_query("win8_running_cdf", f", {_HIST} SELECT cn, bin, round(sum(p) OVER (PARTITION BY cn ORDER BY bin ROWS UNBOUNDED PRECEDING), 6) AS cdf FROM p", "v_state")
def win8(spark, d):
    return stats.running_cdf(_hist(spark, d), ["cn"], "bin", "p").select("cn", "bin", _r("cdf").alias("cdf"))


@_query("win9_normalize", f", {_HIST} SELECT cn, bin, round(p, 6) AS p FROM p", "v_state")
def win9(spark, d):
    return _hist(spark, d).select("cn", "bin", _r("p").alias("p"))


@_query("win10_gc_limits", "SELECT CAST(coalesce(max(perc) FILTER (WHERE fail AND perc <= 40), 0) AS INT) AS gc_low, CAST(coalesce(min(perc) FILTER (WHERE fail AND perc >= 40), 100) AS INT) AS gc_high FROM (SELECT p.perc, coalesce(n, 0) < 3 AS fail FROM (SELECT unnest(range(0, 101)) AS perc) p LEFT JOIN (SELECT perc_gc, count(*) AS n FROM v_model GROUP BY ALL) k ON k.perc_gc = p.perc)", "v_model")
def win10(spark, d):
    return gcbias.gc_limits(view(spark, d, "v_model"), 40, 3)


@_query("win11_prev_state", "SELECT g, t, CAST(floor(x) AS BIGINT) % 3 AS hs, lag(CAST(floor(x) AS BIGINT) % 3) OVER (PARTITION BY g ORDER BY t) AS prev_hs FROM v_series", "v_series")
def win11(spark, d):
    return hmm.prev_state(view(spark, d, "v_series").select("g", "t", (F.floor("x") % 3).alias("hs")), ["g"], "t")


# --- order, samples, sets --------------------------------------------------------------------------------------------


@_query("srt1_sort_probes", "SELECT chrom, pos, probe FROM v_model ORDER BY chrom, pos, probe", "v_model")
def srt1(spark, d):
    return samples.sort_probes(view(spark, d, "v_model").select("chrom", "pos", "probe"))


@_query("srt2_sort_by_start", "SELECT chrom, start, \"end\", ord FROM v_segment ORDER BY chrom, start", "v_segment")
def srt2(spark, d):
    return samples.sort_by_start(view(spark, d, "v_segment"), int(spark.conf.get("spark.sql.shuffle.partitions"))).select("chrom", "start", "end", "ord")


@_query("srt3_sort_composite", None)
def srt3(spark, d):
    rows = intervals.interval_union(view(spark, d, "v_span"), "flank_start", "flank_end", ["chrom"])
    return rows.select("chrom", "island", "flank_start", "flank_end", "sample").orderBy("chrom", "island", "flank_start", "flank_end", "sample")


ORACLES["srt3_sort_composite"] = _regions_sql("SELECT chrom, island, flank_start, flank_end, sample FROM j")


@_query("srt4_sample_cap", "SELECT sample, probe, cn_out FROM (SELECT *, row_number() OVER (PARTITION BY cn_out ORDER BY md5(concat('42:', CAST(sample AS STRING), ':', CAST(probe AS STRING))), sample, probe) AS r FROM v_state) WHERE r <= 500", "v_state")
def srt4(spark, d):
    return stats.sample_cap(view(spark, d, "v_state").select("sample", "probe", "cn_out"), ["cn_out"], ["sample", "probe"], 500, 42)


@_query("srt5_first_per_group", "SELECT sample, arg_min(probe, (pos, probe)) AS probe, min(pos) AS pos FROM v_obs GROUP BY sample", "v_obs")
def srt5(spark, d):
    return stats.first_per_group(view(spark, d, "v_obs").select("sample", "pos", "probe"), ["sample"], ["pos", "probe"])


@_query("set1_union_svs", "SELECT sample, chrom, flank_start, flank_end, 0 AS kind FROM v_span UNION ALL SELECT ord, chrom, start, \"end\", 1 FROM v_segment", "v_span v_segment")
def set1(spark, d):
    a = view(spark, d, "v_span").withColumn("kind", F.lit(0))
    b = view(spark, d, "v_segment").select(F.col("ord").alias("sample"), "chrom", F.col("start").alias("flank_start"), F.col("end").alias("flank_end"), F.lit(1).alias("kind"))
    return samples.union_svs([a, b]).select("sample", "chrom", "flank_start", "flank_end", "kind")


@_query("set2_select_samples", "SELECT DISTINCT c_mktsegment AS Cell_Line FROM customer WHERE c_custkey % 2 = 0")
def set2(spark, d):
    df = spark.read.parquet(f"{d}/customer.parquet").select(F.lit("exp1").alias("Experiment"), F.col("c_mktsegment").alias("Cell_Line"), F.col("c_nationkey").alias("Cell_Clone"), F.when(F.col("c_custkey") % 2 == 0, "Yes").otherwise("No").alias("Control"))
    return samples.select_samples(df, "Cell_Line", experiment="exp1", control=True)


@_query("set3_distinct_obs", "SELECT DISTINCT cn_out, allelism_out, inf_in FROM v_state", "v_state")
def set3(spark, d):
    return view(spark, d, "v_state").select("cn_out", "allelism_out", "inf_in").dropDuplicates()


_MANIFEST = "(SELECT o_orderkey AS k, CASE WHEN o_orderkey = (SELECT max(o_orderkey) FROM orders) - 100 THEN ' ' ELSE concat('s', CAST(o_custkey AS STRING)) END AS name FROM orders)"


@_query("set4_list_samples", f"SELECT k, name FROM {_MANIFEST} WHERE k < coalesce((SELECT min(k) FROM {_MANIFEST} WHERE trim(name) = ''), 9223372036854775807)")
def set4(spark, d):
    df = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_custkey")
    top = df.agg((F.max("k") - 100).alias("_top"))
    named = df.join(F.broadcast(top), how="cross").select("k", F.when(F.col("k") == F.col("_top"), " ").otherwise(F.concat(F.lit("s"), F.col("o_custkey").cast("string"))).alias("name"))
    return samples.list_samples(named, "k", "name")


# --- model jobs ------------------------------------------------------------------------------------------------------

_LINE = """k AS (SELECT cn_in, median(lrr) AS m, CAST(count(lrr) AS DOUBLE) AS w FROM v_model WHERE cn_in > 0 GROUP BY cn_in), s AS (SELECT coalesce(max(m), 0) AS shift FROM k WHERE cn_in = 2),
pt AS (SELECT m - shift AS x, log2(cn_in / 2) AS y, w FROM k, s), q AS (SELECT sum(w) sw, sum(w*x) sx, sum(w*y) sy, sum(w*x*x) sxx, sum(w*x*y) sxy FROM pt), ln_ AS (SELECT (sw*sxy - sx*sy)/(sw*sxx - sx*sx) AS slope, sw, sx, sy FROM q)"""


def _line_model(spark, d) -> DataFrame:
    """The model with medians that differ between copy numbers."""
    return view(spark, d, "v_model").withColumn("lrr", F.col("lrr") + F.col("cn_in") * 0.25)


@_query("mod3_rescale_lrr", f"{with_views('v_probe')}, v_model0 AS ({DERIVED['v_model']}), v_model AS (SELECT * REPLACE (lrr + cn_in * 0.25 AS lrr) FROM v_model0), {_LINE} SELECT probe, round((lrr - shift) * slope + (sy - slope * sx) / sw, 5) AS lrr_rescaled FROM v_model, s, ln_")
def mod3(spark, d):
    return emissions.rescale_lrr(_line_model(spark, d)).select("probe", _r("lrr_rescaled", 5).alias("lrr_rescaled"))


@_query("mod4_shift_probes", "SELECT o.sample, o.probe, round(o.lrr + k.m - m.lrr, 5) AS lrr_shifted FROM v_obs o JOIN v_model m ON m.probe = o.probe JOIN (SELECT cn_in, median(lrr) AS m FROM v_model GROUP BY cn_in) k ON k.cn_in = m.cn_in", "v_obs v_model")
def mod4(spark, d):
    model = view(spark, d, "v_model")
    obs = view(spark, d, "v_obs").select("sample", "probe", "lrr").join(model.select("probe", "cn_in", F.col("lrr").alias("model_lrr")), "probe")
    return emissions.shift_probes(obs, stats.median_of_medians(model, "cn_in", "lrr")).select("sample", "probe", _r("lrr_shifted", 5).alias("lrr_shifted"))


@_query("mod5_rescale_baf", """, m AS (SELECT probe, baf AS model_baf, cn_in, CASE WHEN baf >= 0.5 THEN 1 - CASE WHEN cn_in = 2 THEN 0.5 WHEN cn_in = 3 THEN 0.33 ELSE 0.0 END ELSE CASE WHEN cn_in = 2 THEN 0.5 WHEN cn_in = 3 THEN 0.33 ELSE 0.0 END END AS target FROM v_model),
 o AS (SELECT sample, m.*, v.baf, m.probe % 17 = 0 AS masked FROM v_obs v JOIN m ON m.probe = v.probe), k AS (SELECT target, median(model_baf) AS x, CAST(count(*) AS DOUBLE) AS w FROM o WHERE NOT masked GROUP BY target), q AS (SELECT sum(w) sw, sum(w*x) sx, sum(w*target) sy, sum(w*x*x) sxx, sum(w*x*target) sxy FROM k), z AS (SELECT (sw*sxy - sx*sy)/(sw*sxx - sx*sx) AS slope, sw, sx, sy FROM q)
 SELECT sample, probe, round(baf * slope + (sy - slope*sx)/sw + CASE WHEN masked THEN 0 ELSE (k.x - model_baf) * slope END, 5) AS baf_shifted FROM o LEFT JOIN k ON k.target = o.target, z""", "v_obs v_model")
def mod5(spark, d):
    model = view(spark, d, "v_model").select("probe", F.col("baf").alias("model_baf"), "cn_in")
    rows = view(spark, d, "v_obs").select("sample", "probe", "baf").join(model, "probe")
    rows = rows.withColumn("as_in", F.when(F.col("cn_in") == 2, "CN2_11").when(F.col("cn_in") == 3, "CN3_12").otherwise("CN1_1")).withColumn("inf_in", F.col("cn_in") >= 2).withColumn("masked", F.col("probe") % 17 == 0)
    return emissions.rescale_baf(rows).select("sample", "probe", _r("baf_shifted", 5).alias("baf_shifted"))


@_query("mod6_mixture")
def mod6(spark, d):
    hist = view(spark, d, "v_fragment").groupBy(F.col("tlen").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    fit = coverage.constrained_mixture(hist, 3, 20.0, 8.0, iters=12)
    rows = spark.createDataFrame([(j + 1, w, m, s) for j, (w, m, s) in enumerate(fit)], "cn int, weight double, mean double, sd double")
    return rows.select("cn", *(_r(c, 4).alias(c) for c in ("weight", "mean", "sd")))


@_query("mod7_zygosity_peaks")
def mod7(spark, d):
    hist = _emission_tables(spark, d).groupBy((F.col("zyg_bin") / 150).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    fit = peaks.fit_peaks(hist, [(0.49, 0.54), (0.62, 0.72), (0.95, 1.05)])
    return spark.createDataFrame(fit, "peak int, weight double, mean double, sd double").select("peak", *(_r(c, 4).alias(c) for c in ("weight", "mean", "sd")))


@_query("mod7_choose_form")
def mod7_choose(spark, d):
    hist = view(spark, d, "v_state").withColumn("lrr_corr", F.col("lrr")).withColumn("cn_in", F.col("cn_out"))
    hist = fitting.histogram(hist, ["sample"], -2.5, 2.5)
    fits = fitting.fit_tables(hist, ["sample"], pipelines._states(5, True), least=20)
    return fits.select("sample", F.inline("fits")).select("sample", "state", "name", "cn", "form", *(_r(c, 4).alias(c) for c in ("lrr_mean", "lrr_sd", "zyg_mean", "zyg_sd")))


@_query("mod8_lrr_moments", f", {_HIST} SELECT cn, round(sum(bin / 10.0 * p), 5) AS mean, round(sqrt(greatest(sum(bin / 10.0 * (bin / 10.0) * p) - pow(sum(bin / 10.0 * p), 2), 0)), 5) AS sd FROM p GROUP BY cn", "v_state")
def mod8(spark, d):
    return emissions.hist_moments(_hist(spark, d), ["cn"], 10).select("cn", _r("mean", 5).alias("mean"), _r("sd", 5).alias("sd"))


@_query("mod8_near_peak", ", k AS (SELECT cn_out, round(avg(zyg), 4) AS m, round(stddev_samp(zyg), 4) AS s FROM v_state WHERE NOT masked GROUP BY cn_out) SELECT v.sample, v.probe, v.cn_out FROM v_state v JOIN k ON k.cn_out = v.cn_out WHERE round(abs(zyg - m), 6) <= round(1.5 * s, 6)", "v_state")
def mod8_near(spark, d):
    rows = _states(spark, d)
    fits = rows.where("not masked").groupBy("cn_out").agg(_r(F.avg("zyg"), 4).alias("mean"), _r(F.stddev_samp("zyg"), 4).alias("sd"))
    return emissions.near_peak(rows, fits, "cn_out").select("sample", "probe", "cn_out")


@_query("mod9_bin_prob", f"SELECT t, round({S.bin_prob_sql('x', '20.0', '6.0')}, 6) AS p FROM v_series", "v_series")
def mod9(spark, d):
    return view(spark, d, "v_series").select("t", _r(F.expr(S.bin_prob_sql("x", "20.0", "6.0"))).alias("p"))


@_query("mod10_normalize_emission", f", {_HIST}, m AS (SELECT cn, bin, 0.98 * p + 0.02 * 0.025 AS p FROM p) SELECT cn, bin, round(p / sum(p) OVER (PARTITION BY cn), 6) AS p FROM m", "v_state")
def mod10(spark, d):
    return emissions.normalize_emission(_hist(spark, d), ["cn"], 0.02, 0.025).select("cn", "bin", _r("p").alias("p"))


@_query("mod11_mosaic", """, h AS (SELECT sample, CAST(round_even(baf * 10, 0) AS INT) AS bin, count(*) AS n FROM v_obs GROUP BY ALL), a AS (SELECT sample, bin, sum(n) OVER w / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS c FROM h WINDOW w AS (PARTITION BY sample ORDER BY bin ROWS UNBOUNDED PRECEDING)),
 r AS (SELECT a.sample, a.bin, greatest(0, 1 - greatest(1 - a.c, b.c)) AS p FROM a JOIN a b ON b.sample = a.sample % 10 + 1 AND b.bin = a.bin) SELECT sample, bin, round(CASE WHEN sum(p) OVER (PARTITION BY sample) > 1e-9 THEN p / sum(p) OVER (PARTITION BY sample) ELSE 0 END, 5) AS p FROM r""", "v_obs")
def mod11(spark, d):
    h = view(spark, d, "v_obs").groupBy("sample", S.bin_even(F.col("baf"), 10).alias("bin")).agg(F.count(F.lit(1)).alias("p"))
    h = stats.normalize(h, ["sample"], "p")
    names = h.select("sample").distinct().withColumn("other", F.col("sample") % 10 + 1)
    high = names.join(h.withColumnRenamed("sample", "other"), "other").select("sample", "bin", "p")
    return emissions.mosaic(h, high, ["sample"]).select("sample", "bin", _r("p", 5).alias("p"))


@_query("mod12_project_missing", f", {_HIST}, f AS (SELECT cn, sum(bin / 10.0 * p) AS m, sqrt(greatest(sum(bin / 10.0 * (bin / 10.0) * p) - pow(sum(bin / 10.0 * p), 2), 0)) AS s FROM p WHERE cn = 2 GROUP BY cn) SELECT CAST(k.cn AS DOUBLE) AS cn, round(CASE WHEN k.cn = 0 THEN -0.33 - 2 * s WHEN k.cn = 2 THEN m ELSE m + (m + 0.33) * log2(nullif(k.cn, 0) / 2.0) END, 5) AS lrr_mean, round(CASE WHEN k.cn = 0 THEN 0 ELSE s END, 5) AS lrr_sd, CAST(CASE k.cn WHEN 0 THEN 0.5 WHEN 1 THEN 1.0 WHEN 2 THEN 0.51 WHEN 3 THEN 0.65 ELSE 0.72 END AS DOUBLE) AS zyg_mean FROM (SELECT unnest([0,1,2,3,4]) AS cn) k, f", "v_state")
def mod12(spark, d):
    fits = emissions.hist_moments(_hist(spark, d).where("cn = 2"), ["cn"], 10).select(F.col("cn").cast("double").alias("cn"), F.col("mean").alias("lrr_mean"), F.col("sd").alias("lrr_sd"), F.lit(0.51).alias("zyg_mean"))
    return emissions.project_missing(fits).select("cn", _r("lrr_mean", 5).alias("lrr_mean"), _r("lrr_sd", 5).alias("lrr_sd"), "zyg_mean")


@_query("mod13_fill_states", f", {_HIST} SELECT s.state, s.cn, round(sum(bin / 10.0 * p), 5) AS lrr_mean FROM (SELECT * FROM (VALUES ('CN1_1', 1), ('CN2_02', 2), ('CN2_11', 2), ('CN3_03', 3), ('CN3_12', 3)) v(state, cn)) s JOIN p ON p.cn = s.cn GROUP BY ALL", "v_state")
def mod13(spark, d):
    fits = emissions.hist_moments(_hist(spark, d), ["cn"], 10).select("cn", F.col("mean").alias("lrr_mean"), F.lit(0.5).alias("zyg_mean"))
    states = readers.load_states(spark, 5.0, False).select(F.col("allelic_state").alias("state"), F.col("copy_number").cast("int").alias("cn")).distinct()
    return emissions.fill_states(states, fits).select("state", "cn", _r("lrr_mean", 5).alias("lrr_mean"))


#: The input copy number and allelism that the emission queries give a probe: 0 to 3 copies.
_CN_IN, _ALLELISM_IN = "CAST(probe % 4 AS INT)", "CAST(least(probe % 4, 2) AS INT)"


def _tables_of(base: DataFrame, states: list[emissions.State]) -> emissions.Tables:
    """Observed emission tables of the given states, each with the zygosities of its copy number."""
    lrr = stats.obs_histogram(base, ["cn"], "lrr_bin", -40, 40).select("cn", "bin", "p")
    zyg = stats.obs_histogram(base.withColumn("zyg_key", F.col("cn").cast("string")), ["zyg_key"], "zyg_bin", 75, 150).select("zyg_key", "bin", "p")
    return emissions.literal_tables(states, [str(int(s.cn)) for s in states], lrr, zyg)


def _long(rows: DataFrame) -> DataFrame:
    """A row for each probe and state."""
    out = rows.select("sample", "probe", F.posexplode("log_ep").alias("state", "log_p"))
    return out.select("sample", "probe", "state", F.when(F.col("log_p") > -1e99, _r("log_p", 5)).otherwise(F.col("log_p")).alias("log_p"))


@_query("mod14_log_emissions", f""", b AS (SELECT sample, probe, cn_out AS cn, {_CN_IN} AS cn_in, {_ALLELISM_IN} AS al_in, CAST(round_even(lrr*30,0) AS INT) AS lb, CAST(round_even(zyg*150,0) AS INT) AS zb FROM v_state WHERE NOT masked), l AS (SELECT cn, lb, count(*) / sum(count(*)) OVER (PARTITION BY cn) AS p FROM b GROUP BY cn, lb), z AS (SELECT cn, zb, count(*) / sum(count(*)) OVER (PARTITION BY cn) AS p FROM b GROUP BY cn, zb),
 e AS (SELECT b.sample, b.probe, s.state, CASE WHEN b.cn_in = 0 OR s.al > b.al_in THEN 0.0 WHEN s.cn = b.cn_in THEN CASE WHEN s.al = b.al_in THEN 1.0 ELSE 0.9 END ELSE CASE abs(s.cn - b.cn_in) WHEN 1 THEN 0.98 WHEN 2 THEN 0.9 ELSE 0.5 END END * coalesce(l.p, 0) * coalesce(CASE WHEN b.zb >= 128 THEN z1.p ELSE z.p END, 0) AS p FROM b CROSS JOIN (VALUES (0, 1, 1), (1, 2, 1), (2, 2, 2), (3, 3, 2)) s(state, cn, al) LEFT JOIN l ON l.cn = s.cn AND l.lb = b.lb LEFT JOIN z ON z.cn = s.cn AND z.zb = b.zb LEFT JOIN z z1 ON z1.cn = 1 AND z1.zb = b.zb)
 SELECT sample, probe, CAST(state AS INT) AS state, CASE WHEN p > 0 THEN round(ln(p), 5) ELSE -1e100 END AS log_p FROM e""", "v_state")
def mod14(spark, d):
    base = written(_emission_tables(spark, d), "bins")
    rows = base.select("sample", "probe", "lrr_bin", "zyg_bin", F.expr(_CN_IN).alias("cn_in"), F.expr(_ALLELISM_IN).alias("allelism_in"), (F.col("zyg_bin") < 128).alias("inf_in"))
    states = [emissions.State(0, "CN1_1", 1, 1, False, False), emissions.State(1, "CN2_02", 2, 1, False, False), emissions.State(2, "CN2_11", 2, 2, False, True), emissions.State(3, "CN3_12", 3, 2, False, True)]
    return _long(emissions.log_emissions(rows, states, _tables_of(base, states), pipelines.PENALTIES))


@_query("mod14_log_emissions_refine", f"""{_fit_sql('', 'v_obs', 'v_state')}, i AS (SELECT avg(CAST(inf_in AS INT)) AS f FROM v_state WHERE NOT masked), b AS (SELECT sample, probe, cn_out AS cn, {_CN_IN} AS cn_in, inf_in, CAST(round_even(lrr*30,0) AS INT) AS lb, CAST(round_even(zyg*150,0) AS INT) AS zb, lrr FROM v_state WHERE NOT masked), l AS (SELECT cn, lb, count(*) / sum(count(*)) OVER (PARTITION BY cn) AS p FROM b GROUP BY cn, lb), z AS (SELECT cn, zb, count(*) / sum(count(*)) OVER (PARTITION BY cn) AS p FROM b GROUP BY cn, zb),
 x AS (SELECT b.*, s.state, s.cn AS out, s.inf AS inf, CAST(round_even((b.lrr - coalesce(t.off, 0)) * 30, 0) AS INT) AS lbc FROM b JOIN v_model m ON m.probe = b.probe CROSS JOIN (VALUES (0, 1, false), (1, 2, false), (2, 2, true), (3, 3, true)) s(state, cn, inf) LEFT JOIN fit t ON t.cn_in = s.cn AND t.perc_gc = m.perc_gc),
 e AS (SELECT x.sample, x.probe, x.state, CASE abs(x.out - x.cn_in) WHEN 0 THEN 1.0 WHEN 1 THEN 0.98 WHEN 2 THEN 0.9 ELSE 0.5 END * CASE WHEN x.out = 1 THEN 0.99 WHEN x.inf THEN i.f ELSE 1 - i.f END * coalesce(l.p, 0) * coalesce(CASE WHEN NOT x.inf_in OR NOT x.inf THEN z1.p ELSE z.p END, 0) AS p FROM x CROSS JOIN i LEFT JOIN l ON l.cn = x.out AND l.lb = x.lbc LEFT JOIN z ON z.cn = x.out AND z.zb = x.zb LEFT JOIN z z1 ON z1.cn = 1 AND z1.zb = x.zb)
 SELECT sample, probe, CAST(state AS INT) AS state, CASE WHEN p > 0 THEN round(ln(p), 5) ELSE -1e100 END AS log_p FROM e""")
def mod14_refine(spark, d):
    model, state = view(spark, d, "v_model"), _states(spark, d).where("not masked")
    share = stats.informative_fraction(state).first()["fraction"]
    rows = state.select("sample", "probe", "lrr", "inf_in", S.bin_even(F.col("zyg"), 150).alias("zyg_bin"), F.expr(_CN_IN).alias("cn_in"), F.expr(_ALLELISM_IN).alias("allelism_in"))
    rows = gcbias.candidate_bins(rows.join(model.select("probe", "perc_gc"), "probe"), gcbias.fit_gc(model), 3, 30)
    states = [emissions.State(0, "CN1_1", 1, 1, False, False), emissions.State(1, "CN2_02", 2, 2, False, False), emissions.State(2, "CN2_11", 2, 2, False, True), emissions.State(3, "CN3_12", 3, 2, False, True)]
    return _long(emissions.log_emissions(rows, states, _tables_of(_emission_tables(spark, d, state), states), pipelines.PENALTIES, "refine", share))


def _series_ep(spark, d) -> DataFrame:
    x = F.col("x")
    return view(spark, d, "v_series").select("g", "t", F.array(*(_r(-0.5 * ((x - m) / 12.0) * ((x - m) / 12.0), 9) for m in (10.0, 30.0, 60.0))).alias("log_ep"))


def _viterbi_sql(ep: str, log_start: list[float], log_t: np.ndarray, views: str = "", source: str = "v_series") -> str:
    n = len(log_start)
    best = lambda j: "[" + ", ".join(f"v.d[{i + 1}] + CAST({log_t[i][j]!r} AS DOUBLE)" for i in range(n)) + "]"
    ds = ", ".join(f"list_max({best(j)}) + s.e[{j + 1}]" for j in range(n))
    bs = ", ".join(f"list_position({best(j)}, list_max({best(j)}))" for j in range(n))
    start = ", ".join(f"s.e[{j + 1}] + CAST({log_start[j]!r} AS DOUBLE)" for j in range(n))
    return f"""{(views or with_views('v_series')).replace('WITH ', 'WITH RECURSIVE ', 1)}, s AS MATERIALIZED (SELECT g, t, row_number() OVER (PARTITION BY g ORDER BY t) AS k, {ep} AS e FROM {source}),
 v AS MATERIALIZED (WITH RECURSIVE v AS (SELECT s.g, s.k, [{start}] AS d, CAST([{', '.join(['0'] * n)}] AS BIGINT[]) AS phi FROM s WHERE k = 1 UNION ALL SELECT s.g, s.k, [{ds}], CAST([{bs}] AS BIGINT[]) FROM v JOIN s ON s.g = v.g AND s.k = v.k + 1) SELECT * FROM v),
 l AS (SELECT g, max(k) AS k FROM v GROUP BY g), b AS (SELECT v.g, v.k, list_position(v.d, list_max(v.d)) AS st FROM v JOIN l ON l.g = v.g AND l.k = v.k UNION ALL SELECT p.g, p.k, c.phi[b.st] FROM b JOIN v c ON c.g = b.g AND c.k = b.k JOIN v p ON p.g = b.g AND p.k = b.k - 1)
 SELECT s.g, s.t, CAST(b.st - 1 AS INT) AS hs FROM b JOIN s ON s.g = b.g AND s.k = b.k"""


_T3, _START3 = hmm.transitions(3, 0.01), [float(-np.log(3))] * 3
_EP3 = "[" + ", ".join(f"round(-0.5*((x-{m})/12.0)*((x-{m})/12.0), 9)" for m in (10.0, 30.0, 60.0)) + "]"


@_query("mod15_viterbi", _viterbi_sql(_EP3, _START3, _T3.tolist()))
def mod15(spark, d):
    return hmm.viterbi(_series_ep(spark, d), ["g"], ["t"], "log_ep", _T3).select("g", "t", "hs")


@_query("mod15_viterbi_blocks", _viterbi_sql(_EP3, _START3, _T3.tolist()))
def mod15_blocks(spark, d):
    return hmm.viterbi(_series_ep(spark, d), ["g"], ["t"], "log_ep", _T3, block=16).select("g", "t", "hs")


_CATS = {"click": [0.1, 0.6], "view": [0.5, 0.2], "purchase": [0.2, 0.1], "signup": [0.1, 0.05], "error": [0.1, 0.05]}


def _cat_sql() -> str:
    return "CASE cat " + " ".join(f"WHEN '{k}' THEN [{', '.join(f'CAST({float(np.log(p))!r} AS DOUBLE)' for p in v)}]" for k, v in _CATS.items()) + " ELSE [CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)] END"


@_query("mod16_segment_sequence", _viterbi_sql(_cat_sql(), [float(np.log(0.9)), float(np.log(0.1))], hmm.persistence(2, 0.95, 0.9, True).tolist()))
def mod16(spark, d):
    df = view(spark, d, "v_series").select("g", "t", "cat")
    return hmm.segment_sequence(df, ["g"], ["t"], _CATS, z=0.9, p=0.95, weighted=True, block=hmm.BLOCK).select("g", "t", "hs")


def _depth_ep() -> str:
    return "[" + ", ".join(f"ln({S.bin_prob_sql('x', repr(m), repr(s))})" for m, s in _DEPTHS) + "]"


_DEPTHS = ((1.0, 0.8), (2.0, 1.1), (3.0, 1.4))
_DEPTH_PATH = _viterbi_sql(_depth_ep(), [float(x) for x in np.log([0.1, 0.45, 0.45])], hmm.persistence(3, 0.995, 0.1).tolist(), _cover_sql(""), """(SELECT chrom AS g, bin AS t, "count" AS x FROM c)""")


#: Emissions by type, state and observed state.
_TYPED = [[[0.7, 0.2, 0.1], [0.1, 0.3, 0.6]], [[0.5, 0.4, 0.1], [0.2, 0.2, 0.6]]]


def _typed_sql() -> str:
    logs = lambda t, k: "[" + ", ".join(f"CAST({float(np.log(_TYPED[t][k][o]))!r} AS DOUBLE)" for o in range(3)) + "]"
    return "[" + ", ".join(f"CASE WHEN t % 2 = 0 THEN {logs(0, k)}[CAST(floor(x) AS BIGINT) % 3 + 1] ELSE {logs(1, k)}[CAST(floor(x) AS BIGINT) % 3 + 1] END" for k in range(2)) + "]"


def _typed_rows(spark, d) -> DataFrame:
    return view(spark, d, "v_series").select("g", "t", (F.col("t") % 2).cast("int").alias("ot"), (F.floor("x") % 3).cast("int").alias("os"), (F.floor("x") % 2).cast("int").alias("hs_in"), (F.col("t") % 3 == 0).cast("int").alias("hs"))


@_query("mod16_typed_sequence", _viterbi_sql(_typed_sql(), [float(np.log(0.6)), float(np.log(0.4))], hmm.persistence(2, 0.9, 0.6).tolist()))
def mod16_typed(spark, d):
    return hmm.segment_sequence(_typed_rows(spark, d).select("g", "t", "ot", "os"), ["g"], ["t"], _TYPED, z=0.6, p=0.9).select("g", "t", "hs")


@_query("mod20_typed_loglik", f""", ep AS (SELECT * FROM (VALUES {', '.join(f'({t}, {k}, {o}, {_TYPED[t][k][o]})' for t in range(2) for k in range(2) for o in range(3))}) v(ot, s, o, p)),
 q AS (SELECT a.ot, a.s AS hs_in, b.s AS hs, b.p AS x, a.p AS w, b.o FROM ep a JOIN ep b ON b.ot = a.ot AND b.o = a.o), r AS (SELECT *, sum(w) OVER (PARTITION BY ot, hs_in, hs ORDER BY x, w ROWS UNBOUNDED PRECEDING) / sum(w) OVER (PARTITION BY ot, hs_in, hs) AS run, lead(x) OVER (PARTITION BY ot, hs_in, hs ORDER BY x, w) AS nx FROM q),
 m AS (SELECT ot, hs_in, hs, arg_min(CASE WHEN run > 0.5 THEN x ELSE (x + nx) / 2 END, run) AS wm FROM r WHERE run >= 0.5 GROUP BY ALL)
 SELECT g, round(sum(n * ln(wm)), 4) AS loglik FROM (SELECT g, t % 2 AS ot, CAST(floor(x) AS BIGINT) % 2 AS hs_in, CASE WHEN t % 3 = 0 THEN 1 ELSE 0 END AS hs, count(*) AS n FROM v_series GROUP BY ALL) c JOIN m USING (ot, hs_in, hs) GROUP BY g""", "v_series")
def mod20_typed(spark, d):
    return hmm.expected_loglik(_typed_rows(spark, d), ["g"], hmm.typed_weights(spark, _TYPED)).select("g", _r("loglik", 4).alias("loglik"))


@_query("mod17_bin_cn", _DEPTH_PATH.replace("SELECT s.g, s.t, CAST(b.st - 1 AS INT) AS hs FROM", "SELECT s.g AS chrom, s.t AS bin, CAST(b.st AS INT) AS cn FROM"))
def mod17(spark, d):
    bins = _cover(spark, d)
    probs = F.array(*(F.expr(S.bin_prob_sql("count", repr(m), repr(s))) for m, s in _DEPTHS))
    called = hmm.segment_sequence(bins.withColumn("ep", probs), ["chrom"], ["bin"], "ep", z=0.1, p=0.995, states=3, block=hmm.BLOCK)
    return called.select("chrom", "bin", (F.col("hs") + 1).alias("cn"))


@_query("mod18_path_loglik", f""", s AS (SELECT g, t, {_EP3} AS e, CAST(floor(x) AS BIGINT) % 3 AS hs FROM v_series), p AS (SELECT *, lag(hs) OVER (PARTITION BY g ORDER BY t) AS ph FROM s) SELECT g, round(sum(CASE WHEN ph IS NULL THEN {_START3[0]!r} WHEN ph = hs THEN {float(_T3[0][0])!r} ELSE {float(_T3[0][1])!r} END + e[hs + 1]), 4) AS loglik FROM p GROUP BY g""", "v_series")
def mod18(spark, d):
    rows = _series_ep(spark, d).join(view(spark, d, "v_series").select("g", "t", (F.floor("x") % 3).cast("int").alias("hs")), ["g", "t"])
    return hmm.path_loglik(rows, ["g"], "t", "hs", "log_ep", _T3, np.array(_START3)).select("g", _r("loglik", 4).alias("loglik"))


@_query("mod19_emission_loglik", f"SELECT g, round(round(sum(e[CAST(floor(x) AS BIGINT) % 3 + 1]), 5), 1) AS loglik FROM (SELECT g, x, {_EP3} AS e FROM v_series) GROUP BY g", "v_series")
def mod19(spark, d):
    rows = _series_ep(spark, d).join(view(spark, d, "v_series").select("g", "t", (F.floor("x") % 3).cast("int").alias("hs")), ["g", "t"])
    return hmm.emission_loglik(rows, ["g"], "hs", "log_ep")


@_query("mod20_expected_loglik", """, m AS (SELECT cat, CAST(floor(x) AS BIGINT) AS x, CAST(count(*) AS DOUBLE) AS w FROM v_series GROUP BY ALL), a AS (SELECT *, sum(w) OVER (PARTITION BY cat ORDER BY x ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY cat) / 2.0 AS half, lead(x) OVER (PARTITION BY cat ORDER BY x) AS nx FROM m), w AS (SELECT cat, CASE WHEN run = half THEN (x + nx) / 2.0 ELSE x END AS wm FROM a WHERE run >= half AND run - w < half)
 SELECT g, round(sum(n * wm), 4) AS loglik FROM (SELECT g, cat, count(*) AS n FROM v_series GROUP BY ALL) c JOIN w ON w.cat = c.cat GROUP BY g""", "v_series")
def mod20(spark, d):
    df = view(spark, d, "v_series")
    weights = stats.weighted_median(df.select("cat", F.floor("x").alias("x"), F.lit(1.0).alias("one")), ["cat"], "x", "one").withColumnRenamed("weighted_median", "w")
    return hmm.weighted_counts(df.groupBy("g", "cat").agg(F.count(F.lit(1)).alias("n")), weights, ["cat"]).select("g", _r("loglik", 4).alias("loglik"))


@_query("mod23_sex_model", "SELECT chrom, CAST(0 AS BIGINT) AS start, CAST(275000000 AS BIGINT) AS \"end\", CAST(CASE WHEN chrom = 'chrX' THEN 1 WHEN chrom = 'chrY' THEN 1 ELSE 2 END AS INT) AS cn FROM (SELECT DISTINCT CASE chrom WHEN 'chr21' THEN 'chrX' WHEN 'chr22' THEN 'chrY' ELSE chrom END AS chrom FROM v_probe)")
def mod23(spark, d):
    chroms = view(spark, d, "v_probe").select(F.when(F.col("chrom") == "chr21", "chrX").when(F.col("chrom") == "chr22", "chrY").otherwise(F.col("chrom")).alias("chrom")).distinct()
    return chroms.select("chrom", F.lit(0).cast("long").alias("start"), F.lit(275_000_000).cast("long").alias("end"), coverage.sex_copies(F.col("chrom"), "M").alias("cn")).where("cn > 0")


@_query("mod24_reject_gains", "SELECT sample, probe FROM (SELECT sample, probe, CASE WHEN masked THEN NULL ELSE cn_out - cn_in + CAST(probe % 2 AS INT) END AS cnc FROM v_state) WHERE coalesce(cnc <= 1, true)", "v_state")
def mod24(spark, d):
    rows = view(spark, d, "v_state").withColumn("cnc", F.when(~F.col("masked"), F.col("cn_out") - F.col("cn_in") + (F.col("probe") % 2).cast("int")))
    return hmm.reject_gains(rows).select("sample", "probe")


# --- sources ---------------------------------------------------------------------------------------------------------


@_query("src1_parse_reports", "SELECT sample, chrom, pos, CAST(probe AS STRING) AS probe, CASE WHEN probe % 9 = 0 THEN NULL ELSE lrr END AS lrr, CASE WHEN probe % 9 = 0 THEN NULL ELSE baf END AS baf FROM v_obs", "v_obs")
def src1(spark, d):
    obs = view(spark, d, "v_obs")
    rows = obs.select(F.col("sample").cast("string").alias("file"), F.concat_ws("\t", F.col("probe").cast("string"), F.replace("chrom", F.lit("chr"), F.lit("")), F.col("pos").cast("string"), F.when(F.col("probe") % 9 == 0, "NaN").otherwise(F.col("lrr").cast("string")), F.col("baf").cast("string")).alias("line"))
    heads = obs.select(F.col("sample").cast("string").alias("file")).distinct().withColumn("line", F.explode(F.array(F.lit("[Header]"), F.lit("Content\tx"), F.lit("[Data]"), F.lit("SNP Name\tChr\tPosition\tLog R Ratio\tB Allele Freq"))))
    files = view(spark, d, "v_probe").select("sample").distinct().count()
    got = readers.parse_reports(rows.unionByName(heads), files)
    return got.select(F.col("file").cast("long").alias("sample"), "chrom", "pos", "probe", "lrr", "baf")


@_query("src2_parse_manifest", "SELECT o_orderkey AS row, concat('s_', CAST(o_custkey AS STRING)) AS sample FROM orders")
def src2(spark, d):
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.lit("m").alias("file"), F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(F.lit("s "), F.col("o_custkey").cast("string")), F.lit("x")).alias("line"))
    heads = spark.range(1).select(F.lit("m").alias("file"), F.explode(F.array(F.lit("preamble"), F.lit("Row,DNA_ID,DNA_Name"))).alias("line"))
    return readers.parse_manifest(rows.unionByName(heads)).select("row", "sample")


@_query("src3_resolve_reports", "SELECT c_custkey AS row, concat('p_FinalReport', CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS STRING) WHEN c_custkey % 3 = 1 THEN concat('_', c_name) ELSE concat('_id', CAST(c_custkey AS STRING)) END, '.txt') AS file FROM customer")
def src3(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("sample"), F.col("c_name").alias("dna_name"), F.concat(F.lit("id"), F.col("c_custkey").cast("string")).alias("dna_id"))
    k = F.col("row") % 3
    files = c.select(F.concat(F.lit("p_FinalReport"), F.when(k == 0, F.col("row").cast("string")).when(k == 1, F.concat(F.lit("_"), "dna_name")).otherwise(F.concat(F.lit("_"), "dna_id")), F.lit(".txt")).alias("file"))
    return readers.resolve_reports(c, files).select("row", "file")


@_query("src4_prototype", "SELECT chrom, pos, CAST(probe AS STRING) AS probe FROM v_obs WHERE CAST(sample AS STRING) = (SELECT min(CAST(sample AS STRING)) FROM v_obs)", "v_obs")
def src4(spark, d):
    obs = view(spark, d, "v_obs").select(F.col("sample").cast("string").alias("file"), "chrom", "pos", F.col("probe").cast("string").alias("probe"))
    return readers.prototype_probes(obs)


@_query("src6_parse_bed", "SELECT ord, chrom, start, \"end\", concat('n', CAST(ord AS STRING)) AS name, CAST(cn AS DOUBLE) AS score, '+' AS strand FROM v_segment", "v_segment")
def src6(spark, d):
    seg = view(spark, d, "v_segment")
    rows = seg.select("ord", F.concat_ws("\t", "chrom", F.format_number("start", 0), F.col("end").cast("string"), F.concat(F.lit("n"), F.col("ord").cast("string")), F.col("cn").cast("string"), F.lit("+")).alias("line"))
    noise = spark.range(1).select(F.lit(-1).cast("long").alias("ord"), F.explode(F.array(F.lit("# comment"), F.lit(""))).alias("line"))
    return readers.model_from_bed(readers.parse_bed(rows.unionByName(noise)))


@_query("src8_parse_alignments", "SELECT CAST(event_id AS STRING) AS qname, flag, rname, pos, mapq, rnext, tlen FROM v_fragment", "v_fragment")
def src8(spark, d):
    f = view(spark, d, "v_fragment")
    rows = f.select(F.concat_ws("\t", F.col("event_id").cast("string"), F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), F.lit("50M"), "rnext", F.lit("1"), F.col("tlen").cast("string"), F.lit("*\t*")).alias("line"))
    return readers.parse_alignments(rows).select("qname", "flag", "rname", "pos", "mapq", "rnext", "tlen")


@_query("src9_chunk_sequences", "SELECT contig, n AS chunk_no, md5(substring(seq, n * 500 + 1, 500)) AS digest FROM (SELECT contig, seq, unnest(range(0, (length(seq) + 499) // 500)) AS n FROM v_contig)", "v_contig")
def src9(spark, d):
    return readers.chunk_sequences(view(spark, d, "v_contig"), 500).select("contig", "chunk_no", F.md5(F.col("seq").cast("binary")).alias("digest"))


@_query("src10_last_wins", "SELECT probe, CAST(arg_max(f, n) AS DOUBLE) AS frac_gc FROM (SELECT l_partkey AS probe, l_orderkey * 10 + l_linenumber AS n, CASE WHEN l_quantity = 7 THEN '0' WHEN l_quantity = 8 THEN 'NA' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS f FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber ORDER BY l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS r FROM lineitem) WHERE r = 1) WHERE f NOT IN ('0', 'NA') GROUP BY probe")
def src10(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    order = Window.partitionBy("l_partkey", "l_orderkey", "l_linenumber").orderBy("l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice")
    li = li.withColumn("r", F.row_number().over(order)).where("r = 1")
    rows = li.select(F.col("l_partkey").alias("probe"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_no"), F.when(F.col("l_quantity") == 7, "0").when(F.col("l_quantity") == 8, "NA").otherwise(F.col("l_quantity").cast("int").cast("string")).alias("frac_gc"))
    return gcbias.last_wins(rows)


@_query("src13_read_region", "SELECT sample, probe, pos FROM v_obs WHERE chrom = 'chr3' AND pos BETWEEN 100000 AND 900000", "v_obs")
def src13(spark, d):
    return intervals.read_region(view(spark, d, "v_obs"), "chr3", 100_000, 900_000).select("sample", "probe", "pos")


@_query("snk2_round_svs", _runs_sql("SELECT sample, chrom, run, round(round(avg(lrr), 6), 2) AS lrr_mean FROM r GROUP BY sample, chrom, run"))
def snk2(spark, d):
    return writers.round_svs(runs.run_means(_run_rows(spark, d), SC).select(*SC, "run", _r("lrr_mean").alias("lrr_mean")), 2)


# --- files written and read again ------------------------------------------------------------------------------------


def _experiment(spark, d) -> DataFrame:
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select(F.lit("exp1").alias("Experiment"), F.col("c_mktsegment").alias("Cell_Line"), F.col("c_nationkey").cast("string").alias("Cell_Clone"), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("No").alias("Control"), F.col("c_name").alias("Sample_ID"))


@_query("src5_read_samples", """SELECT 'exp1' AS "Experiment", c_mktsegment AS "Cell_Line", CAST(c_nationkey AS STRING) AS "Cell_Clone", CASE WHEN c_custkey % 2 = 0 THEN 'yes' ELSE 'No' END AS "Control", c_name AS "Sample_ID" FROM customer""")
def src5(spark, d):
    path = shared_path(spark, "samples")
    _experiment(spark, d).write.csv(path, header=True)
    return readers.read_samples(spark, path)


_BED = "SELECT chrom, start, \"end\", concat('n', CAST(ord AS STRING)) AS name, CAST(cn AS DOUBLE) AS score, '+' AS strand FROM v_segment"


def _bed_file(spark, d) -> str:
    path = shared_path(spark, "bed")
    line = F.concat_ws("\t", "chrom", F.format_number("start", 0), F.col("end").cast("string"), F.concat(F.lit("n"), F.col("ord").cast("string")), F.col("cn").cast("string"), F.lit("+"))
    view(spark, d, "v_segment").select(line.alias("value")).write.text(path)
    return path


@_query("src7_read_bed", _BED, "v_segment")
def src7(spark, d):
    return readers.read_bed(spark, _bed_file(spark, d)).drop("ord")


@_query("pipe4_train_intervals", _BED, "v_segment")
def pipe4(spark, d):
    return pipelines.train(spark, "bed6", path=_bed_file(spark, d)).model.drop("ord")


@_query("src10_read_probe_gc", "SELECT CAST(probe AS STRING) AS probe, frac_gc FROM v_model", "v_model")
def src10_file(spark, d):
    path = shared_path(spark, "gc")
    view(spark, d, "v_model").select("probe", "frac_gc").write.csv(path, sep="\t", header=True)
    return gcbias.last_wins(readers.read_probe_gc(spark, path))


@_query("src11_read_probe_model", "SELECT probe, lrr, baf, cn_in AS cn_out, 'CN2_11' AS as_out, true AS inf_out FROM v_model WHERE probe % 11 <> 0", "v_model")
def src11(spark, d):
    path = shared_path(spark, "model")
    model = view(spark, d, "v_model").select("probe", "lrr", "baf", F.col("cn_in").alias("cn_out"), F.when(F.col("probe") % 11 != 0, "CN2_11").alias("as_out"), F.lit(True).alias("inf_out"))
    model.write.parquet(path)
    return readers.read_probe_model(spark, path)


@_query("src12_read_svs", "SELECT sample, chrom, flank_start, flank_end, CAST(NULL AS INT) AS cn FROM v_span UNION ALL SELECT ord, chrom, start, \"end\", cn FROM v_segment", "v_span v_segment")
def src12(spark, d):
    a, b = shared_path(spark, "svs"), shared_path(spark, "svs")
    view(spark, d, "v_span").write.parquet(a)
    view(spark, d, "v_segment").select(F.col("ord").alias("sample"), "chrom", F.col("start").alias("flank_start"), F.col("end").alias("flank_end"), "cn").write.parquet(b)
    return readers.read_svs(spark, [a, b]).select("sample", "chrom", "flank_start", "flank_end", "cn")


@_query("snk1_write_probes", "SELECT CAST(cn_out AS BIGINT) AS sample, chrom, pos, concat(CAST(sample AS STRING), ':', CAST(probe AS STRING)) AS prb_name, lrr, baf, cn_in, cn_out FROM v_state", "v_state")
def snk1(spark, d):
    path = shared_path(spark, "probes")
    rows = view(spark, d, "v_state").withColumn("prb_name", F.concat_ws(":", F.col("sample").cast("string"), F.col("probe").cast("string")))
    writers.write_probes(rows.withColumn("sample", F.col("cn_out")), path)  # a folder for each copy number and chromosome
    return spark.read.parquet(path).select(F.col("sample").cast("long").alias("sample"), "chrom", "pos", "prb_name", "lrr", "baf", "cn_in", "cn_out")


@_query("snk3_write_model", ORACLES["agg10_collapse_bins"])
def snk3(spark, d):
    path = shared_path(spark, "depth")
    bins = _called(spark, d)
    writers.write_model(coverage.collapse_bins(bins, ["chrom"], "cn", 500), bins, path)
    return spark.read.parquet(f"{path}/segments").withColumn("mean", _r("mean", 5)).withColumn("sd", _r("sd", 5))


@_query("snk4_save_model", ORACLES["win9_normalize"])
def snk4(spark, d):
    path = shared_path(spark, "fitted")
    writers.save_model({"hist": _hist(spark, d)}, path)
    return writers.load_model(spark, path, ["hist"])["hist"].select("cn", "bin", _r("p").alias("p"))


@_query("snk5_write_compare", ORACLES["jn15_contained"])
def snk5(spark, d):
    path = shared_path(spark, "compared")
    writers.write_compare(jn15(spark, d).withColumns({"start": F.col("flank_start"), "end": F.col("flank_end")}), path)
    return spark.read.parquet(path).select("sample", "chrom", "flank_start", "flank_end", "region_id")


@_query("snk6_write_group_manifest", _ALIAS)
def snk6(spark, d):
    path = shared_path(spark, "group")
    writers.write_group_manifest(view(spark, d, "v_probe").select("sample").distinct(), path, 7)
    return spark.read.parquet(path)


@_query("pipe1_list_samples", ORACLES["src2_parse_manifest"])
def pipe1(spark, d):
    path = shared_path(spark, "manifest")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    orders.select(F.col("o_orderkey").alias("Row"), F.concat(F.lit("s "), F.col("o_custkey").cast("string")).alias("DNA_ID"), F.lit("x").alias("DNA_Name")).write.csv(path, header=True)
    return pipelines.list_samples(spark, path)


@_query("mod2_correct_model", _fit_sql("SELECT m.probe, round(m.lrr - f.off, 5) AS lrr_corr FROM v_model m LEFT JOIN fit f ON f.cn_in = m.cn_in AND f.perc_gc = m.perc_gc"))
def mod2(spark, d):
    model = view(spark, d, "v_model")
    return gcbias.apply_gc(model, gcbias.fit_gc(model)).select("probe", _r("lrr_corr", 5).alias("lrr_corr"))


def _refined(spark, d, rounds: int = 1) -> pipelines.Model:
    return pipelines.refine(view(spark, d, "v_probe").select("sample", "chrom", "pos", "probe", "lrr", "baf"), view(spark, d, "v_segment"), view(spark, d, "v_model").select("probe", "frac_gc"), min_probes=10, min_gc=1, least=100, rounds=rounds)


_GC_CHUNK = 300


@_query("src9_read_fasta", "SELECT contig, n AS chunk_no, md5(substring(upper(regexp_replace(seq, '\\s', '', 'g')), n * 300 + 1, 300)) AS digest FROM (SELECT contig, seq, unnest(range(0, (length(regexp_replace(seq, '\\s', '', 'g')) + 299) // 300)) AS n FROM v_contig)", "v_contig")
def src9_fasta(spark, d):
    return readers.read_fasta(spark, _fasta_file(spark, d), _GC_CHUNK).select("contig", "chunk_no", F.md5(F.col("seq").cast("binary")).alias("digest"))


def _fasta_file(spark, d) -> str:
    """All contigs as FASTA text in lines of 70 bases."""
    path = shared_path(spark, "fasta")
    bases = F.regexp_replace("seq", r"\s", "")
    record = F.concat(F.lit(">"), "contig", F.lit(" a contig\n"), F.trim(F.regexp_replace(bases, "(.{70})", "$1\n"), F.lit("\n")))
    view(spark, d, "v_contig").where(F.length(bases) > 0).select(record.alias("value")).write.text(path)
    return path


@_query("pipe4_train_gc", "SELECT contig AS probe, round((length(w) - length(translate(w, 'GC', ''))) / CAST(length(w) AS DOUBLE), 6) AS frac_gc FROM (SELECT contig, substring(upper(regexp_replace(seq, '\\s', '', 'g')), greatest(pos - 101, 0) + 1, pos + 100 - greatest(pos - 101, 0)) AS w FROM (SELECT contig, seq, CAST(contig AS BIGINT) * 7 % 500 + 1 AS pos FROM v_contig)) WHERE length(w) > 0", "v_contig")
def pipe4_gc(spark, d):
    contigs = view(spark, d, "v_contig")
    path = shared_path(spark, "reports")
    line = F.concat_ws("\t", F.col("contig"), F.col("contig"), (F.col("contig").cast("long") * 7 % 500 + 1).cast("string"), F.lit("0.1"), F.lit("0.5"))
    head = spark.range(1).select(F.lit("SNP Name\tChr\tPosition\tLog R Ratio\tB Allele Freq").alias("value"))
    head.unionByName(contigs.select(line.alias("value"))).coalesce(1).write.text(path)
    # The contigs' names are numbers, to which the reports' reader puts "chr".
    reports = readers.read_final_reports(spark, path).withColumn("chrom", F.regexp_replace("chrom", "^chr", ""))
    return pipelines.probe_gc(readers.prototype_probes(reports), readers.read_fasta(spark, _fasta_file(spark, d), _GC_CHUNK), _GC_CHUNK).select("probe", _r("frac_gc").alias("frac_gc"))


@_query("pipe2_index_samples", "SELECT k.sample, CAST(b.bin AS INT) AS bin, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY k.sample), 3) AS freq FROM (SELECT DISTINCT sample FROM v_obs WHERE lrr BETWEEN -1 AND 1) k CROSS JOIN (SELECT unnest(range(-20, 21)) AS bin) b LEFT JOIN (SELECT sample, CAST(round_even(lrr * 20, 0) AS INT) AS bin, count(*) AS n FROM v_obs WHERE lrr BETWEEN -1 AND 1 GROUP BY ALL) c ON c.sample = k.sample AND c.bin = b.bin", "v_obs")
def pipe2(spark, d):
    found = pipelines.index_samples(view(spark, d, "v_obs"), shared_path(spark, "index"), partitions=8)
    return found.where("value = 'lrr'").drop("value")


@_query("pipe2_read_region", ORACLES["src13_read_region"])
def pipe2_region(spark, d):
    path = shared_path(spark, "index")
    pipelines.index_samples(view(spark, d, "v_obs"), path, partitions=8)
    return intervals.read_region(spark.read.parquet(path), "chr3", 100_000, 900_000).select("sample", "probe", "pos")


@_query("pipe5_refine")
def pipe5(spark, d):
    return _refined(spark, d).probes


@_query("pipe5_refine_rounds")
def pipe5_rounds(spark, d):
    return _refined(spark, d, 2).probes


@_query("pipe5_refine_fits")
def pipe5_fits(spark, d):
    return _refined(spark, d).fits.select("state", "name", "cn", "form", *(_r(c, 4).alias(c) for c in ("lrr_mean", "lrr_sd", "zyg_mean", "zyg_sd")))


@_query("pipe6_segment")
def pipe6(spark, d):
    return pipelines.segment(view(spark, d, "v_obs"), _refined(spark, d), least=100)[1]


@_query("pipe7_compare")
def pipe7(spark, d):
    return pipelines.compare_samples(*pipelines.segment(view(spark, d, "v_obs"), _refined(spark, d), least=100))


@_query("plt3_cn_transitions", "SELECT cn_in, cn_out, count(*) AS n FROM v_state WHERE NOT masked GROUP BY ALL", "v_state")
def plt3(spark, d):
    return plotdata.cn_transitions(view(spark, d, "v_state"))


@_query("plt4_depth_histogram", _cover_sql('SELECT CAST(round_even("count", 0) AS INT) AS bin, count(*) AS n FROM c GROUP BY 1'))
def plt4(spark, d):
    return plotdata.depth_histogram(_cover(spark, d))


@_query("plt4_depth_quantiles", f"{_DEPTH_PATH.replace('SELECT s.g, s.t, CAST(b.st - 1 AS INT) AS hs FROM b', ', done AS (SELECT s.g, s.t, CAST(b.st AS INT) AS cn FROM b')}), d AS (SELECT cn, x AS v, count(*) AS n FROM done JOIN (SELECT chrom AS g, bin AS t, \"count\" AS x FROM c) USING (g, t) GROUP BY ALL), e AS (SELECT cn, v, sum(n) OVER (PARTITION BY cn ORDER BY v ROWS UNBOUNDED PRECEDING) AS run, sum(n) OVER (PARTITION BY cn) AS total FROM d) SELECT cn, CAST(q AS DOUBLE) AS q, round(min(v), 5) AS value FROM e, (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS q) WHERE run >= greatest(q * total, 1) GROUP BY cn, q")
def plt4_quantiles(spark, d):
    bins = _cover(spark, d)
    called = mod17(spark, d).join(bins, ["chrom", "bin"])
    return plotdata.depth_quantiles(called).withColumn("value", _r("value", 5))


@_query("plt4_depth_densities", _cover_sql(", h AS (SELECT CAST(round_even(\"count\", 0) AS INT) AS bin, count(*) AS n FROM c GROUP BY 1) SELECT g.bin, round(coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER () AS DOUBLE), 6) AS share, " + ", ".join(f"round({w / (s * (2 * np.pi) ** 0.5)!r} * exp(-0.5 * pow((g.bin - {m!r}) / {s!r}, 2)), 6) AS cn{k}" for k, (w, m, s) in enumerate(((0.5, 1.0, 0.8), (0.3, 2.0, 1.1), (0.2, 3.0, 1.4)), 1)) + " FROM (SELECT CAST(unnest(range((SELECT min(bin) FROM h), (SELECT max(bin) FROM h) + 1)) AS INT) AS bin) g LEFT JOIN h ON h.bin = g.bin"))
def plt4_densities(spark, d):
    rows = plotdata.depth_densities(_cover(spark, d), [(0.5, 1.0, 0.8), (0.3, 2.0, 1.1), (0.2, 3.0, 1.4)])
    return rows.select("bin", *(_r(c).alias(c) for c in ("share", "cn1", "cn2", "cn3")))


@_query("plt6_uniqueness", _runs_sql(f", {_PAIRS}, x AS (SELECT sv, round(max(CASE WHEN target = sample THEN score END), 4) AS q, round(max(CASE WHEN target <> sample THEN score END), 4) AS m FROM p GROUP BY sv, sample) SELECT sv, CASE WHEN q = 0 THEN 0.0 ELSE round(sign(q) * log10(abs(q)), 3) END AS x, CASE WHEN m = 0 THEN 0.0 ELSE round(sign(m) * log10(abs(m)), 3) END AS y FROM x"))
def plt6(spark, d):
    scores = compare.extreme_samples(compare.pair_scores(*_pair_inputs(spark, d)))
    return plotdata.uniqueness_scatter(scores.withColumn("qrll", _r("qrll", 4)).withColumn("max_trll", _r("max_trll", 4))).select("sv", _r("x", 3).alias("x"), _r("y", 3).alias("y"))


@_query("pipe3_train_depth")
def pipe3(spark, d):
    aln = view(spark, d, "v_fragment").withColumn("flag", F.lit(32))
    segments, _ = pipelines.train_depth(aln, "click:1-150000/2", bin_size=2000, max_cn=3)
    return segments.select("chrom", "run", "start", "end", "cn", "n_bins", *(_r(c, 4).alias(c) for c in ("mean", "sd", "cn1", "cn2", "cn3")))


@_query("pipe8_fan_out", "SELECT 'exp1' AS \"Experiment\", c_mktsegment AS \"Cell_Line\", CAST(c_nationkey AS STRING) AS \"Cell_Clone\", coalesce(array_to_string(list_sort(list(DISTINCT c_name) FILTER (WHERE c_custkey % 2 = 0)), ','), '') AS controls, array_to_string(list_sort(list(DISTINCT c_name)), ',') AS samples FROM customer GROUP BY ALL")
def pipe8(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    table = c.select(F.lit("exp1").alias("Experiment"), F.col("c_mktsegment").alias("Cell_Line"), F.col("c_nationkey").cast("string").alias("Cell_Clone"), F.when(F.col("c_custkey") % 2 == 0, "yes").otherwise("No").alias("Control"), F.col("c_name").alias("Sample_ID"))
    out = pipelines.fan_out(table, "exp1")
    return out.withColumn("controls", F.array_join("controls", ",")).withColumn("samples", F.array_join("samples", ","))


@_query("plt1_gc_scatter", _fit_sql("SELECT m.cn_in, m.probe, m.perc_gc, round(m.lrr, 5) AS lrr, round(m.zyg, 5) AS zyg, round(f.off, 5) AS line FROM (SELECT *, abs(baf - 0.5) + 0.5 AS zyg, row_number() OVER (PARTITION BY cn_in ORDER BY md5(concat('1:', CAST(probe AS STRING))), probe) AS r FROM v_model) m LEFT JOIN fit f ON f.cn_in = m.cn_in AND f.perc_gc = m.perc_gc WHERE r <= 300"))
def plt1(spark, d):
    some, line = plotdata.gc_scatter(view(spark, d, "v_model").withColumn("zyg", S.zygosity(F.col("baf"))), n=300)
    return some.join(F.broadcast(line), ["cn_in", "perc_gc"], "left").select("cn_in", "probe", "perc_gc", _r("lrr", 5).alias("lrr"), _r("zyg", 5).alias("zyg"), _r("offset", 5).alias("line"))


@_query("plt2_zyg_lrr_boxes", f", {_HIST}, f AS (SELECT cn, sum(bin / 10.0 * p) AS m, sqrt(greatest(sum(bin / 10.0 * (bin / 10.0) * p) - pow(sum(bin / 10.0 * p), 2), 0)) AS s FROM p GROUP BY cn) SELECT r.probe, round(r.lrr, 5) AS lrr, round(r.zyg, 5) AS zyg, round(m - 2 * s, 5) AS lrr_low, round(m + 2 * s, 5) AS lrr_high FROM (SELECT *, row_number() OVER (PARTITION BY cn_in ORDER BY md5(concat('1:', probe)), probe) AS n FROM (SELECT cn_in, lrr, zyg, concat(CAST(sample AS STRING), ':', CAST(probe AS STRING)) AS probe FROM v_state)) r LEFT JOIN f ON f.cn = r.cn_in WHERE r.n <= 25000", "v_state")
def plt2(spark, d):
    fits = emissions.hist_moments(_hist(spark, d), ["cn"], 10).select("cn", F.col("mean").alias("lrr_mean"), F.col("sd").alias("lrr_sd"), F.lit(0.5).alias("zyg_mean"), F.lit(0.05).alias("zyg_sd"))
    rows = view(spark, d, "v_state").select("cn_in", F.concat_ws(":", F.col("sample").cast("string"), F.col("probe").cast("string")).alias("probe"), "lrr", "zyg")
    some, boxes = plotdata.zyg_lrr_scatter(rows, fits)
    return some.join(F.broadcast(boxes), F.col("cn_in") == F.col("cn"), "left").select("probe", *(_r(c, 5).alias(c) for c in ("lrr", "zyg", "lrr_low", "lrr_high")))


@_query("plt5_size_vs_score", _runs_sql(", e AS (SELECT count(*) FILTER (WHERE cn_out <> cn_in OR (inf_in AND NOT inf_out)) AS n_probes, CAST(count(*) FILTER (WHERE inf_in) AS DOUBLE) AS rel_ll FROM r GROUP BY sample, chrom, run) SELECT n_probes, rel_ll, round(ln(10) * n_probes, 5) AS iso1, round(ln(100) * n_probes, 5) AS iso2, round(ln(1000) * n_probes, 5) AS iso3 FROM e"))
def plt5(spark, d):
    svs = runs.run_evidence(_run_rows(spark, d), SC).withColumn("rel_ll", F.col("n_inf").cast("double"))
    return plotdata.size_vs_score(svs).select("n_probes", "rel_ll", *(_r(c, 5).alias(c) for c in ("iso1", "iso2", "iso3")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which runs of probes deviate in which sample: medians, anomalies, runs, evidence and means, from built-ins alone."""
    return runs.run_table(_run_rows(spark, sf_dir), SC)
