import itertools
import random

import duckdb
import numpy as np
import pytest
from cnvspark import queries as q
from cnvspark.functions import scalar as S
from cnvspark.operators import coverage, emissions, fitting, hmm, intervals, peaks, samples, stats
from cnvspark.plans import pipelines
from cnvspark.sources import readers, writers
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import os

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


def rows_of(columns, rows):
    def plain(x):
        if x is None or isinstance(x, float) and np.isnan(x):
            return "null"
        if isinstance(x, float):
            return f"{round(x, 5) + 0.0:.5f}"
        return f"{float(x):.5f}" if isinstance(x, (int, np.integer)) and not isinstance(x, bool) else str(x)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


#: A query of each kind; all of them are compared by the driver.
SOME = ["prj7_bin_even", "prj13_usable_mask", "jn1_first_match", "jn7_candidate_lrr", "jn14_widen_by_rank", "jn18_slice_sequence", "agg6_fragment_coverage", "agg13_run_spans", "agg16_collapse_regions", "agg23_weighted_median", "win6_flanks", "mod1_fit_gc", "mod5_rescale_baf", "mod14_log_emissions", "mod15_viterbi", "mod15_viterbi_blocks", "mod16_segment_sequence", "mod21_segment_weights", "src1_parse_reports", "src6_parse_bed"]


@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, duck, name):
    df = q.QUERIES[name](spark, SF)
    want = duck.sql(q.ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(want.columns, want.fetchall())


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def brute_path(ep, log_t, start):
    n = ep.shape[1]
    score = lambda p: start[p[0]] + ep[0][p[0]] + sum(log_t[a][b] + ep[i + 1][b] for i, (a, b) in enumerate(zip(p, p[1:])))
    return max(score(p) for p in itertools.product(range(n), repeat=len(ep))), score


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    for n, t in itertools.product((1, 2, 3), range(1, 7)):
        ep, log_t, start = np.log(rng.random((t, n))), np.log(rng.dirichlet(np.ones(n), n)), np.log(rng.dirichlet(np.ones(n)))
        best, score = brute_path(ep, log_t, start)
        assert abs(score(tuple(hmm.decode(ep, log_t, start))) - best) < 1e-9


def test_blocks_equal_one_piece(spark):
    rng = random.Random(3)
    rows = [(g, t, [rng.gauss(0, 2) for _ in range(3)]) for g in range(3) for t in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "g int, t int, ep array<double>")
    log_t = hmm.transitions(3, 0.05)
    whole = {(r["g"], r["t"]): r["hs"] for r in hmm.viterbi(df, ["g"], ["t"], "ep", log_t).collect()}
    for block in (1, 4, 64):
        assert {(r["g"], r["t"]): r["hs"] for r in hmm.viterbi(df, ["g"], ["t"], "ep", log_t, block=block).collect()} == whole


def test_impossible_rows_are_neutral():
    ep = np.array([[0.0, -5.0], [-np.inf, -np.inf], [0.0, -5.0]])
    assert hmm.decode(ep, hmm.transitions(2, 0.1), np.log([0.5, 0.5])).tolist() == [0, 0, 0]


def test_coverage_keeps_mass(spark):
    rng = random.Random(2)
    rows = [("c", rng.randint(1, 5000), rng.randint(1, 900)) for _ in range(500)]
    df = spark.createDataFrame(rows, "rname string, pos long, tlen long")
    assert abs(coverage.fragment_coverage(df, 500).agg(F.sum("count")).first()[0] - 500) < 0.5


def test_interval_union_is_idempotent(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 3), "c", s, s + rng.randint(0, 30)) for s in (rng.randint(0, 900) for _ in range(200))]
    df = spark.createDataFrame(rows, "sample int, chrom string, flank_start long, flank_end long")
    once = intervals.collapse_regions(df)
    again = intervals.collapse_regions(once.select(F.lit(1).alias("sample"), "chrom", F.col("start").alias("flank_start"), F.col("end").alias("flank_end")))
    key = lambda d: sorted((r["start"], r["end"]) for r in d.collect())
    assert key(once) == key(again)


def test_interval_union_over_bins_equals_one_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), s, s + rng.choice([1, 40, 300])) for s in (rng.randrange(3000) for _ in range(300))] * 2
    got = intervals.interval_union(spark.createDataFrame(rows, "c string, s long, e long").repartition(3), "s", "e", ["c"], width=50)
    want, number, reach = [], {}, {}
    for c, s, e in sorted(rows):
        if c not in reach or s > reach[c]:
            number[c] = number.get(c, 0) + 1
        reach[c] = max(reach.get(c, e), e)
        want.append((c, s, e, number[c]))
    assert sorted((r["c"], r["s"], r["e"], r["island"]) for r in got.collect()) == want


def test_exact_medians_against_the_built_in(spark):
    rng = random.Random(6)
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0.5, rng.gauss(0, 1), -3.0, 1e-4])) for _ in range(2000)] + [(3, None), (4, 7.0)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    want = {r["k"]: (r["m"], r["n"]) for r in df.groupBy("k").agg(F.median("x").alias("m"), F.count("x").alias("n")).where("n > 0").collect()}
    got = {r["k"]: (r["median"], r["n"]) for r in stats.exact_medians(df, ["k"], "x").collect()}
    assert got.keys() == want.keys() and all(got[k][1] == want[k][1] and abs(got[k][0] - want[k][0]) < 1e-12 for k in want)
    assert stats.exact_medians(df.limit(0), ["k"], "x").count() == 0


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(500)))
    (tmp_path / "b.txt").write_text("x\r\n\ny")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["line_no"], r["line"]) for r in got if r["file"].endswith("a.txt")) == [(i, f"line {i}") for i in range(500)]
    assert sorted((r["line_no"], r["line"]) for r in got if r["file"].endswith("b.txt")) == [(0, "x"), (1, ""), (2, "y")]


def test_regions_are_numbered_in_order(spark):
    rows = [(c, s, s + random.Random(s).choice([5, 500])) for c in ("chr1", "chr10", "chr2") for s in range(0, 4000, 100)]
    big = S.size_class(F.col("start"), F.col("end"), 100) == "large"
    got = intervals.number_regions(spark.createDataFrame(rows, "chrom string, start long, end long").repartition(4), [big.cast("int")]).collect()
    want = sorted(rows, key=lambda r: (r[2] - r[1] > 100, r[0], r[1]))
    assert [(r["chrom"], r["start"], r["end"]) for r in sorted(got, key=lambda r: r["region_id"])] == want and {r["region_id"] for r in got} == set(range(1, len(rows) + 1))


def test_half_open_and_touch(spark):
    iv = spark.createDataFrame([(1, "c", 0, 10, 2), (2, "c", 10, 20, 3)], "ord int, chrom string, start long, end long, cn int")
    points = spark.createDataFrame([("c", p) for p in (1, 10, 11, 20, 21, 22)], "chrom string, pos long")
    got = lambda mode: {r["pos"]: r["cn"] for r in intervals.first_match(points, iv, width=7, value="cn", mode=mode).collect()}
    assert got("touch") == {1: 2, 10: 2, 11: 2, 20: 3, 21: 3, 22: None}
    assert got("half_open") == {1: 2, 10: 2, 11: 3, 20: 3, 21: None, 22: None}


def test_exclude(spark):
    f = spark.createDataFrame([("a", 0, 10), ("a", 10, 20), ("b", 0, 5), ("a", 25, 30)], "chrom string, start long, end long")
    r = spark.createDataFrame([("a", 15, 26)], "chrom string, start long, end long")
    assert sorted(tuple(x) for x in intervals.exclude(f, r, width=4, skip=("b",)).collect()) == [("a", 0, 10)]


def test_mixture_finds_spacing(spark):
    rng = np.random.default_rng(5)
    x = np.rint(np.concatenate([rng.normal(50 * k, 6, 2000 * k) for k in (1, 2, 3)]))
    v, n = np.unique(x, return_counts=True)
    hist = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "x double, n long")
    fit = coverage.constrained_mixture(hist, 3, 45.0, 8.0)
    assert abs(fit[0][1] - 50) < 1 and abs(fit[1][1] - 2 * fit[0][1]) < 1e-9 and all(4 < s < 9 for _, _, s in fit)


def test_peaks_stay_in_bounds(spark):
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(0.67, 0.02, 3000), rng.normal(1.0, 0.01, 3000)]), 2)
    v, n = np.unique(x, return_counts=True)
    hist = spark.createDataFrame([(float(a), int(b)) for a, b in zip(v, n)], "x double, n long")
    fit = peaks.fit_peaks(hist, [(0.62, 0.72), peaks.UNINFORMATIVE])
    assert abs(fit[0][2] - 0.67) < 0.01 and abs(fit[1][2] - 1.0) < 0.01 and abs(fit[0][1] - 0.5) < 0.05


def test_erfc(spark):
    import math

    xs = [x / 10 for x in range(-40, 41)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(F.expr(S.erfc_sql("x"))).collect()
    assert max(abs(r[0] - math.erfc(x)) for r, x in zip(got, xs)) < 2e-7


def test_text_readers(spark, tmp_path):
    (tmp_path / "p_FinalReport1.txt").write_bytes(b"[Header]\r\nContent\tx\r\n[Data]\r\nPosition\tSNP Name\tB Allele Freq\tChr\tLog R Ratio\textra\r\n100\trs1\t0.5\t1\t-0.1\tq\r\n0x\trs2\t0.5\t1\t0\tq\r\n200\trs3\t0.4\tchrX\tNaN\tq\r\n")
    got = {r["probe"]: r for r in readers.read_final_reports(spark, f"{tmp_path}/*FinalReport*").collect()}
    hist = pipelines.index_reports(spark, f"{tmp_path}/*FinalReport*", f"{tmp_path}/index", partitions=2)
    assert {r["sample"] for r in hist.collect()} == {"1"} and spark.read.parquet(f"{tmp_path}/index").count() == 2
    assert set(got) == {"rs1", "rs3"} and got["rs1"]["chrom"] == "chr1" and got["rs3"]["lrr"] is got["rs3"]["baf"] is None
    (tmp_path / "m.csv").write_text("x\nRow,DNA_ID,DNA_Name\n1,a b,n1\n2,c,n2\n3,,n3\n4,d,n4\n")
    assert [r["sample"] for r in pipelines.list_samples(spark, f"{tmp_path}/m.csv").collect()] == ["a_b", "c"]
    with pytest.raises(Exception, match="no column"):
        readers.read_manifest(spark, f"{tmp_path}/m.csv", "Nope").collect()
    (tmp_path / "i.bed").write_text("# c\n\nchr1\t1,000\t2,000\tn\t2\t+\r\nchr2\t5\t6\tm\tNA\t-\n")
    bed = readers.read_bed(spark, f"{tmp_path}/i.bed").orderBy("ord").collect()
    assert [(r["start"], r["score"]) for r in bed] == [(1000, 2.0), (5, None)]
    (tmp_path / "b.bed").write_text("chr1\tx\t2\n")
    with pytest.raises(Exception, match="bad start"):
        readers.read_bed(spark, f"{tmp_path}/b.bed").collect()
    (tmp_path / "g.fa").write_text(">c1 more\nACgtN\nAC\n>c2\nGG\n")
    fasta = {(r["contig"], r["chunk_no"]): r["seq"] for r in readers.read_fasta(spark, f"{tmp_path}/g.fa", 4).collect()}
    assert fasta == {("c1", 0): "ACGT", ("c1", 1): "NAC", ("c2", 0): "GG"}
    (tmp_path / "e.csv").write_text("Experiment,Cell_Line,Cell_Clone,Control,Sample_ID\ne,l,k,Yes,S1\ne,l,k,no,S2\n")
    table = readers.read_samples(spark, f"{tmp_path}/e.csv")
    assert [r[0] for r in samples.select_samples(table, "Sample_ID", control=True).collect()] == ["S1"]
    assert pipelines.fan_out(table, "e").first()["samples"] == ["S1", "S2"]
    assert pipelines.train(spark, "F", chroms=["chr1", "chrX", "chrY"]).model.count() == 2
    assert readers.load_states(spark, 5.0, True).count() == 24 and readers.load_states(spark, 2.0, False).count() == 5


def test_writers_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "chr1", 5, 0.12345), ("s2", "chr1", 3, 0.5)], "sample string, chrom string, start long, lrr_mean double")
    writers.write_svs(df, f"{tmp_path}/svs")
    back = readers.read_svs(spark, [f"{tmp_path}/svs"])
    assert back.columns == writers.SV_COL and sorted(r["lrr_mean"] for r in back.collect()) == [0.123, 0.5]
    regions = spark.createDataFrame([(k % 3, f"chr{k % 2}", (k * 7) % 11, k) for k in range(40)], "region_id int, chrom string, start long, end long").repartition(5)
    writers.write_compare(regions, f"{tmp_path}/cmp")
    order = [(r["region_id"], r["chrom"], r["start"], r["end"]) for r in spark.read.parquet(f"{tmp_path}/cmp").coalesce(1).collect()]
    assert order == sorted(order) and len(order) == 40
    writers.save_model({"a": df}, f"{tmp_path}/m")
    assert writers.load_model(spark, f"{tmp_path}/m", ["a"])["a"].count() == 2
    aliases = [r["alias"] for r in writers.group_manifest(df, 3).collect()]
    assert len(set(aliases)) == 2 and all(len(a) == 5 and a[2] == "-" for a in aliases)
    many = [r["alias"] for r in writers.group_manifest(spark.range(70_000).select(F.col("id").alias("sample")), 3).collect()]
    assert len(set(many)) == 70_000
    groups = writers.group_manifest(spark.range(600).select((F.col("id") % 2).alias("line"), (F.col("id") % 300).alias("sample")), 5, "line")
    assert groups.groupBy("line").agg(F.count_distinct("alias").alias("a"), F.count_distinct("sample").alias("s")).where("a <> s").count() == 0


def test_sample_cap_is_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 3)
    draw = lambda d: sorted(r["id"] for r in stats.sample_cap(d, ["k"], ["id"], 10, 1).collect())
    assert draw(df) == draw(df.repartition(7)) and len(draw(df)) == 30


def planted(rng, n=400, samples="abc"):
    model = [(p, "chr1", p * 1000, 0.0, 0.5, 2.0, 2, True) for p in range(n)]
    changes = {"a": (100, 160, 3), "b": (200, 260, 1)}
    rows = []
    for s in samples:
        for p in range(n):
            lo, hi, cn = changes.get(s, (0, 0, 2))
            k = cn if lo <= p < hi else 2
            baf = {1: rng.choice([0.0, 1.0]), 2: 0.5, 3: rng.choice([0.33, 0.67])}[k]
            rows.append((s, "chr1", p * 1000, p, float(np.log2(k / 2) + rng.normal(0, 0.15)), float(min(1, max(0, baf + rng.normal(0, 0.03))))))
    return changes, rows, model


@pytest.mark.parametrize("block", [None, 64])
def test_segment_finds_planted_changes(spark, block, monkeypatch):
    if block:
        monkeypatch.setattr(pipelines, "MANY_SAMPLES", 0)  # as for a cohort whose fits are too many to broadcast
    changes, rows, model = planted(np.random.default_rng(42))
    obs = spark.createDataFrame(rows, "sample string, chrom string, pos long, probe int, lrr double, baf double")
    mdl = spark.createDataFrame(model, "probe int, chrom string, pos long, lrr double, baf double, cn_out double, allelism_out int, inf_out boolean")
    decoded, svs = pipelines.segment(obs, mdl, mosaics=False, change=1e-4, block=block)
    got = {r["sample"]: r for r in svs.collect()}
    assert set(got) == {"a", "b"} and got["a"]["cnc"] == "1.0" and got["b"]["cnc"] == "-1.0"
    for s, (lo, hi, _) in changes.items():
        assert abs(got[s]["start"] / 1000 - lo) <= 3 and abs(got[s]["end"] / 1000 - hi) <= 3
    out = {r["sample"]: r for r in pipelines.compare_samples(decoded, svs).collect()}
    assert all(r["qrll"] > 0 > r["max_trll"] for r in out.values())
    groups = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "sample string, group int")
    within = {r["sample"]: r for r in pipelines.compare_samples(decoded, svs, groups=groups).collect()}
    assert within["a"]["max_trll"] is None and within["b"]["max_trll_smp"] == "c" and within["b"]["qrll"] == out["b"]["qrll"]


def test_segment_with_mosaics_masks_and_a_plan_of_bounded_size(spark):
    changes, rows, model = planted(np.random.default_rng(3))
    rng = np.random.default_rng(4)
    rows += [("m", "chr1", p * 1000, p, float((-0.45 if 50 <= p < 200 else 0.0) + rng.normal(0, 0.1)), float(0.5 + (rng.choice([-0.25, 0.25]) if 50 <= p < 200 else 0) + rng.normal(0, 0.02))) for p in range(400)]
    rows[5] = (*rows[5][:4], None, 0.5)
    obs = spark.createDataFrame(rows, "sample string, chrom string, pos long, probe int, lrr double, baf double")
    mdl = spark.createDataFrame(model, "probe int, chrom string, pos long, lrr double, baf double, cn_out double, allelism_out int, inf_out boolean")
    decoded, svs = pipelines.segment(obs, mdl, change=1e-4)
    assert decoded.count() == len(rows) and decoded.where("masked").count() == 1
    got = [r for r in svs.where("sample = 'm'").collect()]
    assert got and all(r["cn_out"] == "1.5" and 50_000 <= r["start"] and r["end"] < 200_000 for r in got) and sum(r["n_probes"] for r in got) > 100
    plan = svs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 30


# --- fits of emission tables ------------------------------------------------------------------------------------------


def share(values, low, n, per_unit):
    return np.bincount(np.clip(np.rint(values * per_unit).astype(int) - low, 0, n - 1), minlength=n).astype(float)


def test_curves_against_a_fine_search():
    rng = np.random.default_rng(9)
    x = (fitting.ZYG_LOW + np.arange(fitting.ZYG_N)) / fitting.ZYG_BINS
    f = share(rng.normal(0.66, 0.03, 40_000), fitting.ZYG_LOW, fitting.ZYG_N, fitting.ZYG_BINS)
    f /= f.sum()
    one = fitting.Peak((1, 1, 1), (0.62, 0.67, 0.72), (0.001, 0.05, 0.1))
    ((_, m, s),), loss = fitting.fit_curve(x, f, [one], 1 / fitting.ZYG_BINS)
    bell = lambda m, s: np.exp(-0.5 * ((x - m) / s) ** 2) / (s * np.sqrt(2 * np.pi)) / fitting.ZYG_BINS
    grid = min(((f - bell(a, b)) ** 2).sum() for a in np.linspace(0.62, 0.72, 101) for b in np.linspace(0.01, 0.1, 91))
    assert abs(m - 0.66) < 2e-3 and abs(s - 0.03) < 2e-3 and loss <= grid + 1e-12
    two = [fitting.Peak((0, 0.5, 1), (0.49, 0.5, 0.54), (0.001, 0.05, 0.1)), fitting.Peak((0, 0.5, 1), (0.62, 0.67, 0.72), (0.001, 0.05, 0.1))]
    g = 0.3 * bell(0.52, 0.02) + 0.7 * bell(0.7, 0.04)
    fit, loss = fitting.fit_curve(x, g, two, 1 / fitting.ZYG_BINS)
    assert loss < 1e-10 and np.allclose(fit, [(0.3, 0.52, 0.02), (0.7, 0.7, 0.04)], atol=1e-3)
    beyond, _ = fitting.fit_curve(x, bell(0.8, 0.03), [one], 1 / fitting.ZYG_BINS)
    assert beyond[0][1] == 0.72  # held at its bound


def test_forms_follow_the_data():
    rng = np.random.default_rng(10)
    z = lambda *parts: share(np.concatenate([0.5 + np.abs(rng.normal(m - 0.5, s, n)) for m, s, n in parts]), fitting.ZYG_LOW, fitting.ZYG_N, fitting.ZYG_BINS)
    ones = z((1.0, 0.01, 5000))
    pure = fitting.fit_zygosities({2: z((0.51, 0.015, 9000)), 3: z((0.67, 0.02, 4000)), 4: z((0.51, 0.015, 2000), (0.75, 0.02, 2000))}, ones, mosaics=True)
    assert set(pure.tables) == {"0", "1", "CN2_11", "CN3_12", "CN4_22", "CN4_13", "CN1.5_11", "CN2.5_12"}
    assert all(abs(t.sum() - 1) < 1e-9 and (t >= 0).all() for t in pure.tables.values())
    x = (fitting.ZYG_LOW + np.arange(fitting.ZYG_N)) / fitting.ZYG_BINS
    mean = lambda t: (t * x).sum()
    assert abs(mean(pure.tables["CN4_13"]) - 0.75) < 0.02 and mean(pure.tables["CN2_11"]) < mean(pure.tables["CN2.5_12"]) < mean(pure.tables["CN3_12"])
    mixed = fitting.fit_zygosities({2: z((0.51, 0.015, 6000), (0.67, 0.02, 4000)), 3: z((0.51, 0.015, 1500), (0.67, 0.02, 5000), (0.75, 0.01, 1500)), 4: z((0.51, 0.015, 2000), (0.75, 0.02, 2000))}, ones)
    assert mixed.forms[2] == "complex" and mixed.forms[3] == "complex"
    assert abs(mixed.peaks[2][0][1] - 0.51) < 0.01 and abs(mixed.peaks[3][1][1] - 0.67) < 0.01 and abs(mixed.peaks[3][2][1] - 0.75) < 0.01
    few = fitting.fit_zygosities({2: z((0.51, 0.015, 900)), 3: z((0.67, 0.02, 10))}, ones)
    assert few.forms == {1: "simple", 2: "simple", 3: "projected"} and "CN4_13" not in few.tables
    none = fitting.fit_zygosities({}, np.zeros(fitting.ZYG_N))
    assert none.forms[2] == "projected" and abs(none.tables["CN2_11"].sum() - 1) < 1e-9


def test_tables_of_samples_in_one_job(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s, shift in (("a", 0.0), ("b", 0.1)):
        for cn, lrr, baf, n in ((1, -0.5, 0.0, 1200), (2, 0.0, 0.5, 3000), (3, 0.4, 0.33, 1500), (2, 0.0, 1.0, 2000)):
            rows += [(s, cn, float(a + shift), float(abs(b - 0.5) + 0.5), False) for a, b in zip(rng.normal(lrr, 0.1, n), np.clip(rng.normal(baf, 0.02, n), 0, 1))]
    df = spark.createDataFrame(rows, "sample string, cn_in int, lrr_corr double, zyg double, masked boolean")
    states = pipelines._states(3, True)
    got = {r["sample"]: r for r in fitting.fit_tables(fitting.histogram(df, ["sample"], -2.5, 2.5), ["sample"], states).collect()}
    for s, shift in (("a", 0.0), ("b", 0.1)):
        fits = {f["name"]: f for f in got[s]["fits"]}
        assert set(fits) == {x.name for x in states}
        for name, lrr in (("CN1_1", -0.5), ("CN2_11", 0.0), ("CN3_12", 0.4)):
            assert abs(fits[name]["lrr_mean"] - lrr - shift) < 0.02 and 0.05 < fits[name]["lrr_sd"] < 0.15
        lrr = np.array(got[s]["lrr"]).reshape(len(states), fitting.LRR_N)
        assert np.allclose(lrr.sum(axis=1), 1)
        seen = share(np.array([r[2] for r in rows if r[0] == s and r[1] == 1 and r[3] >= 0.85]), fitting.LRR_LOW, fitting.LRR_N, fitting.LRR_BINS)
        assert np.allclose(lrr[next(x.state for x in states if x.name == "CN1_1")], fitting.with_bad(seen / seen.sum(), 1 / (30 * 2.5)))


def test_samples_are_rescaled_each_on_its_own(spark):
    rng = np.random.default_rng(12)
    rows = [(s, 1 + i % 3, float(a * (i % 3) + b + rng.normal(0, 0.01))) for s, a, b in (("a", 0.3, 0.2), ("b", 0.7, -0.1)) for i in range(600)]
    df = spark.createDataFrame(rows, "sample string, cn_in int, lrr double")
    medians, lines = emissions.lrr_lines(df, ["sample"])
    got = {r["sample"]: r for r in lines.collect()}
    for s in "ab":
        one, line = emissions.lrr_lines(df.where(F.col("sample") == s), [])
        want = line.first()
        assert all(abs(got[s][c] - want[c]) < 1e-9 for c in ("slope", "intercept", "shift"))
        assert {(r["cn_in"], round(r["m"], 9)) for r in medians.where(F.col("sample") == s).collect()} == {(r["cn_in"], round(r["m"], 9)) for r in one.collect()}
    alone = emissions.lrr_lines(df.where("cn_in = 2"), ["sample"], shift=True)[1].collect()
    assert [r["slope"] for r in alone] == [1.0, 1.0]
    with pytest.raises(Exception, match="two copy numbers"):
        emissions.lrr_lines(df.where("cn_in = 2"), ["sample"])[1].collect()


def test_many_sequences_at_once_equal_one_by_one():
    rng = np.random.default_rng(13)
    for n in (1, 2, 5):
        lengths = rng.integers(1, 30, 40)
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        ep, log_t, start = np.log(rng.random((lengths.sum(), n))), np.log(rng.dirichlet(np.ones(n), n)), np.log(rng.dirichlet(np.ones(n)))
        path = hmm.decode_all(ep, starts, log_t, start)
        for s, k in zip(starts, lengths):
            assert path[s : s + k].tolist() == hmm.decode(ep[s : s + k], log_t, start).tolist()


def test_refine_takes_up_written_rounds(spark, tmp_path):
    rng = np.random.default_rng(14)
    probes = [("chr1", p * 1000, p, 3 if 300 <= p < 500 else 2) for p in range(800)]
    obs = [(s, c, pos, p, float(np.log2(k / 2) + rng.normal(0, 0.1)), float(rng.choice([0.33, 0.67] if k == 3 else [0.5, 1.0]))) for s in "abc" for c, pos, p, k in probes]
    df = spark.createDataFrame(obs, "sample string, chrom string, pos long, probe int, lrr double, baf double")
    iv = spark.createDataFrame([(1, "chr1", 0, 299_500, 2), (2, "chr1", 299_500, 499_500, 3), (3, "chr1", 499_500, 900_000, 2)], "ord int, chrom string, start long, end long, cn int")
    gc = spark.createDataFrame([(p, 0.38 + 0.01 * (p % 5)) for p in range(800)], "probe int, frac_gc double")
    run = lambda: pipelines.refine(df, iv, gc, min_probes=50, min_gc=20, least=100, rounds=2, path=str(tmp_path))
    first = {r["probe"]: r for r in run().probes.collect()}
    assert len(first) > 700 and sum(r["cn_out"] == (3 if 300 <= p < 500 else 2) for p, r in first.items()) > 0.97 * len(first)
    stamp = (tmp_path / "round-1" / "model" / "_SUCCESS").stat().st_mtime_ns
    again = run()
    assert {r["probe"]: r for r in again.probes.collect()} == first and (tmp_path / "round-1" / "model" / "_SUCCESS").stat().st_mtime_ns == stamp
    assert {r["name"] for r in again.fits.collect()} >= {"CN2_11", "CN3_12"}


def test_fasta_over_blocks(spark, tmp_path):
    rng = random.Random(15)
    contigs = {f"c{i}": "".join(rng.choice("acgtN") for _ in range(rng.choice([0, 1, 59, 60, 61, 900, 4000]))) for i in range(12)}
    for k, part in enumerate((list(contigs)[:7], list(contigs)[7:])):
        text = "; no header yet\n" if k else ""
        for c in part:
            text += f">{c} note\r\n" + "".join(contigs[c][i : i + 60] + "\n" for i in range(0, len(contigs[c]), 60)) + ("\n" if rng.random() < 0.5 else "")
        (tmp_path / f"{k}.fa").write_text(text)
    want = {(c, n): s[n * 250 : (n + 1) * 250].upper() for c, s in contigs.items() for n in range(-(-len(s) // 250))}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", "700", before):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = readers.read_fasta(spark, str(tmp_path), 250).collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert {(r["contig"], r["chunk_no"]): r["seq"] for r in got} == want and len(got) == len(want)


def test_train_with_gc(spark, tmp_path):
    rng = random.Random(16)
    seq = "".join(rng.choice("ACGT") for _ in range(5000))
    (tmp_path / "g.fa").write_text(">chr1\n" + "\n".join(seq[i : i + 50] for i in range(0, 5000, 50)) + "\n")
    places = [1, 50, 101, 2500, 4990, 5090, 5200]
    rows = "".join(f"rs{p}\t1\t{p}\t0\t0.5\n" for p in places) + "rsx\t2\t10\t0\t0.5\n"
    (tmp_path / "s_FinalReport1.txt").write_text("SNP Name\tChr\tPosition\tLog R Ratio\tB Allele Freq\n" + rows)
    base = pipelines.train(spark, "M", chroms=["chr1"], reports=f"{tmp_path}/*FinalReport*", fasta=f"{tmp_path}/g.fa", chunk=400)
    want = {}
    for p in places:
        window = seq[max(p - 101, 0) : p + 100]
        if window:
            want[f"rs{p}"] = (window.count("G") + window.count("C")) / len(window)
    got = {r["probe"]: r["frac_gc"] for r in base.gc.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-12 for k, v in want.items()) and base.model.count() == 1


def test_index_reads_the_row_groups_of_a_region_alone(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = spark.range(200_000).select((F.col("id") % 10).cast("string").alias("sample"), F.concat(F.lit("chr"), (F.col("id") % 5 + 1).cast("string")).alias("chrom"), (F.col("id") * 37 % 1_000_000).alias("pos"), F.col("id").alias("probe"), (F.rand(1) - 0.5).alias("lrr"), F.rand(2).alias("baf"))
    path = str(tmp_path / "index")
    hist = pipelines.index_samples(rows, path, partitions=6, row_group=100_000)
    assert hist.groupBy("sample", "value").agg(F.sum("n").alias("n")).where("value = 'lrr' and n <> 20000").count() == 0
    groups = holding = files = 0
    for f in (tmp_path / "index").glob("*.parquet"):
        meta, files = pq.ParquetFile(f).metadata, files + 1
        for g in range(meta.num_row_groups):
            stats_of = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c).statistics for c in range(meta.num_columns)}
            groups += 1
            holding += stats_of["chrom"].min <= "chr3" <= stats_of["chrom"].max and not (stats_of["pos"].max < 100_000 or stats_of["pos"].min > 120_000)
    region = intervals.read_region(spark.read.parquet(path), "chr3", 100_000, 120_000)
    want = rows.where("chrom = 'chr3' and pos between 100000 and 120000").select("probe").collect()
    assert sorted(r["probe"] for r in region.select("probe").collect()) == sorted(r["probe"] for r in want)
    assert "PushedFilters: [IsNotNull(chrom)" in region._jdf.queryExecution().executedPlan().toString()
    assert files <= 6 and groups >= 12 and 1 <= holding <= groups // 4


def test_typed_weights_and_paths(spark):
    rng = np.random.default_rng(17)
    ep = [[rng.dirichlet(np.ones(4)).tolist() for _ in range(3)] for _ in range(2)]
    w = {(r["ot"], r["hs_in"], r["hs"]): r["w"] for r in hmm.typed_weights(spark, ep).collect()}
    for t, i, o in itertools.product(range(2), range(3), range(3)):
        pairs = sorted(zip(ep[t][o], ep[t][i]))
        run = np.cumsum([p[1] for p in pairs]) / sum(ep[t][i])
        assert abs(w[t, i, o] - np.log(pairs[int(np.argmax(run > 0.5))][0])) < 1e-12
    rows = [(0, k, int(rng.integers(2)), int(rng.integers(4)), int(rng.integers(3)), int(rng.integers(3))) for k in range(40)]
    df = spark.createDataFrame(rows, "g int, t int, ot int, os int, hs_in int, hs int")
    got = hmm.expected_loglik(df, ["g"], hmm.typed_weights(spark, ep)).first()["loglik"]
    assert abs(got - sum(w[ot, a, b] for _, _, ot, _, a, b in rows)) < 1e-9
    path = [r["hs"] for r in hmm.segment_sequence(df.drop("hs"), ["g"], ["t"], ep, z=0.4, p=0.8).orderBy("t").collect()]
    logs = np.log(np.array([[ep[ot][s][o] for s in range(3)] for _, _, ot, o, _, _ in rows]))
    assert path == hmm.decode(logs, hmm.persistence(3, 0.8, 0.4), np.log([0.4, 0.3, 0.3])).tolist()


def test_flanks_stay_within_their_region(spark):
    probes = spark.createDataFrame([("s", "c", 10 * k, k, k % 3) for k in range(100)], "sample string, chrom string, pos long, probe int, state int")
    spans = spark.createDataFrame([("a", "s", "c", 300, 350, 270, 500), ("b", "s", "c", 0, 20, 0, 990)], "sv string, sample string, chrom string, start long, end long, lo_ long, hi_ long")
    got = intervals.widen_by_rank(spans, probes, n=10, width=64, region=("lo_", "hi_"))
    by = {sv: sorted(r["probe"] for r in got.collect() if r["sv"] == sv) for sv in "ab"}
    assert by == {"a": list(range(27, 46)), "b": list(range(13))} and "state" in got.columns
