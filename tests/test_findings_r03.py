"""What the third review found: steps that grow faster than their input, and results that hang on where a sequence is cut."""

import random
import re
import tracemalloc
from types import SimpleNamespace

import numpy as np
from pyspark.sql import functions as F

from cnvspark import queries, session, views
from cnvspark.llm import common, toxicity
from cnvspark.operators import compare, fitting, hmm, intervals
from cnvspark.plans import pipelines


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_widening_meets_probes_in_blocks_of_ranks(spark):
    """a span takes a row for each block of ranks on its way to the join, not one for each rank."""
    probes = spark.range(3000).selectExpr("1 AS sample", "'chr1' AS chrom", "id AS probe", "id * 10 AS pos")
    spans = spark.createDataFrame([("a", 1, "chr1", 5000, 5009), ("b", 1, "chr1", 5001, 5009), ("c", 1, "chr1", 0, 29990)], "sv string, sample int, chrom string, start long, end long")
    got = intervals.widen_by_rank(spans, probes, n=1000)
    assert {r["sv"]: (r["n"], r["a"], r["b"]) for r in got.groupBy("sv").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()} == {"a": (1501, 1, 1501), "c": (3000, 1, 3000)}
    keys = re.findall(r"Join (\[.*?\], \[.*?\])", _plan(got))
    assert keys and not any("rank#" in k for k in keys)


def test_pairs_of_variants_and_samples_are_not_shuffled(spark):
    """F3, F4, F14 to F16: pairs are made where they are summed; no shuffle is keyed by the variant or the other sample."""
    probes = spark.range(40).selectExpr("id % 8 AS sample", "id div 8 AS probe", "id = 9 AS masked", "CAST(id % 3 AS INT) AS model_state", "array(id * 0.5D, id * -0.25D, 1D) AS log_ep", "id % 5 = 0 AS changed")
    svs = spark.createDataFrame([("a", 0, "chr1", 10, 0, 1), ("a", 0, "chr1", 30_000_000, 1, 1), ("b", 3, "chr1", 10, 0, 2), ("c", 5, "chr1", 50, 4, 0)], "sv string, sample long, chrom string, pos long, probe long, state int")
    plain = svs.join(probes.where("not masked").withColumnRenamed("sample", "target"), "probe").withColumn("gain", F.expr("log_ep[state] - log_ep[model_state]"))
    want = {(r[0], r[1], r[2]): (r[3], r[4]) for r in plain.groupBy("sv", "sample", "target").agg(F.sum("gain"), F.count("*")).collect()}
    scores = compare.pair_scores(svs, probes)
    assert {(r["sv"], r["sample"], r["target"]): (r["score"], r["n"]) for r in scores.collect()} == want
    changed = {(r["sv"], r["sample"]): [] for r in svs.collect()}
    for r in plain.where("changed and target <> sample").select("sv", "sample", "target").distinct().orderBy("target").collect():
        changed[r["sv"], r["sample"]].append(str(r["target"]))
    seen = compare.overlap_samples(svs, probes)
    assert {(r["sv"], r["sample"]): r["ovlp_smp"] for r in seen.collect()} == {k: ",".join(v) for k, v in changed.items()}
    for df in (compare.extreme_samples(scores), seen):
        keys = [line for line in _plan(df).splitlines() if "hashpartitioning" in line]
        assert keys and not any("sv#" in k.split("hashpartitioning")[1] and "chrom#" not in k.split("hashpartitioning")[1] for k in keys)
        assert not any("target#" in k.split("hashpartitioning")[1] for k in keys)


def test_pieces_of_a_sequence_keep_ties(spark, monkeypatch):
    """F8: a sequence that is decoded in pieces has the path of one piece, where sums that are equal but for rounding differ too."""
    monkeypatch.setattr(hmm, "HELD", 5)
    rng = random.Random(5)
    rows = [(g, t, [rng.choice((-0.1, -0.2, -0.3, -0.7)) for _ in range(3)]) for g in [None, *range(6)] for t in range(rng.randint(1, 90))]
    df = spark.createDataFrame(rows, "g int, t int, ep array<double>")
    log_t = np.array([[-0.1, -0.3, -0.2], [-0.2, -0.1, -0.3], [-0.3, -0.2, -0.1]])
    whole = {(r["g"], r["t"]): r["hs"] for r in hmm.viterbi(df, ["g"], ["t"], "ep", log_t).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for block in (1, 7, 1000):
            assert {(r["g"], r["t"]): r["hs"] for r in hmm.viterbi(df, ["g"], ["t"], "ep", log_t, block=block).collect()} == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_driver_gives_training_memory_back(monkeypatch):
    """The pipeline's check: what training took does not stay with the driver while it plans later steps."""
    given = []
    monkeypatch.setattr(toxicity, "training_rows", lambda *a: [("good day", 0), ("bad day", 1)])
    monkeypatch.setattr(toxicity, "give_back", lambda: given.append(1))
    toxicity.fit_toxicity(None, None)
    assert given


def test_medians_of_probes_are_taken_once(spark):
    """F16 to F18, F23: queries that read the states several times write them once, and do not take medians anew for each."""
    for name in ("agg18_overlap_samples", "mod14_log_emissions", "mod8_near_peak"):
        assert "ObjectHashAggregate(keys=[sample" not in _plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001")), name


def test_samples_are_fitted_together(spark, monkeypatch):
    """the fits of many samples are a few array operations, and give what each sample gives alone."""
    rng = np.random.default_rng(13)
    rows = [(s, cn, float(lrr), float(0.5 + abs(z - 0.5)), False) for s in [None, *range(30)] for cn, m, b, n in ((1, -0.5, 1.0, 40), (2, 0.0, 0.5, 60), (3, 0.4, 0.67, 50), (4, 0.6, 0.75, 40)) for lrr, z in zip(rng.normal(m, 0.1, n), rng.normal(b, 0.03, n), strict=True)]
    df = spark.createDataFrame(rows, "sample int, cn_in int, lrr_corr double, zyg double, masked boolean")
    states = pipelines._states(5, True)
    calls = []
    descend = fitting._descend
    monkeypatch.setattr(fitting, "_descend", lambda *a: calls.append(1) or descend(*a))
    curves = [fitting.Curve(np.arange(20) / 20, rng.random(20) / 20, [fitting.Peak((0.0, 0.5, 1.0), (0.2, 0.4, 0.6), (0.01, 0.05, 0.3))] * k, 0.05) for k in (1, 2) for _ in range(50)]
    many = fitting.fit_curves(curves)
    assert len(calls) == 2 and many == [fitting.fit_curve(*c) for c in curves]
    hist = fitting.histogram(df, ["sample"], -2.5, 2.5)
    got = {r["sample"]: (r["fits"], r["lrr"], r["zyg"]) for r in fitting.fit_tables(hist, ["sample"], states, least=20).collect()}
    assert set(got) == {None, *range(30)} and all(len(z) == (len(states) + 1) * fitting.ZYG_N for _, _, z in got.values())
    for s in (None, 0, 17):
        alone = fitting.fit_tables(hist.where(F.col("sample").eqNullSafe(F.lit(s))), [], states, least=20).first()
        assert (alone["fits"], alone["lrr"], alone["zyg"]) == got[s]


def test_partitions_of_probes_grow_with_the_table(spark, monkeypatch):
    """a larger table gives more tasks, not more rows to each; the rows stay the same."""
    d = "/root/testdata/sf0.001"
    rows = lambda: sorted(map(tuple, queries.QUERIES["agg24_sub_runs"](spark, d).collect()))
    want = rows()
    monkeypatch.setattr(views, "PART", session.size(spark, f"{d}/lineitem.parquet") // 9)
    assert views.view(spark, d, "v_state").rdd.getNumPartitions() in (9, 10)
    assert rows() == want


def test_packing_remembers_little():
    """The pipeline's check, packing: what a worker remembers is small beside an executor's memory."""
    from cnvspark.llm import packing, tokens

    made = tokens.TokenCoder(tokens.tokenizer_path(), packing.MEMO)
    tracemalloc.start()
    held = []
    for k in range(0, 180_000, 1000):
        made.encode([" ".join(f"{i:x}word" for i in range(k, k + 1000))])
        held.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(held) < 20e6


def test_memory_of_arrow_goes_back_too(monkeypatch):
    """The pipeline's check: a worker gives back what Arrow's pool keeps, not the C library's part alone."""
    given = []
    monkeypatch.setattr("pyarrow.default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: given.append(1)))
    common.give_back()
    assert given


def test_gates_of_new_words_are_not_copied():
    """The pipeline's check, toxicity: the table of gate inputs holds all words that are remembered, so it is not held twice while it grows."""
    model = toxicity.train([("good day", 0), ("bad day", 1)] * 20, rounds=1, epochs=1)
    scorer = toxicity.Scorer(model, memo=20_000)
    gates = scorer.gates
    scorer.scores([" ".join(f"w{i}" for i in range(k, k + 6000)) for k in range(0, 18_000, 6000)])
    assert len(scorer.ids) == 18_000 and scorer.gates is gates


def test_frequent_words_stay_remembered():
    """op1_packing's check: rare words that pass do not make the ids of frequent ones be worked out again."""
    from cnvspark.llm import tokens

    made = tokens.TokenCoder(tokens.tokenizer_path(), 2000)
    asked, make = [], made.memo.make
    made.memo.make = lambda runs: asked.extend([runs] if isinstance(runs, str) else runs) or make(runs)
    for k in range(0, 20_000, 500):
        made.encode([" ".join(["first", *("".join(chr(97 + int(d)) for d in f"{i:05}") for i in range(k, k + 500)), "often", "often"])])
    assert sum(run in ("often", b" often") for run in asked) == 1
    assert len(made.memo.known) <= 2000 < len(asked)
    made.encode(["x", "a " + "x" * 50_000])
    assert max(map(len, made.memo.known)) <= tokens.LONGEST


def test_texts_of_one_call_do_not_meet():
    """op1_packing's check: texts are cut into runs together, and each has the ids of the library for it alone."""
    from cnvspark.llm import tokens

    rng = random.Random(1)
    signs = [*" \n\n\ta\u00c0\u00d7\u00f7\u00ff'.1", " ", " ", "\n", "don't", "\u00e9t\u00e9", "ab", "\u0100", "\u6f22", "\x00", "\x01", "<|", "\u00c2"]
    made = tokens.TokenCoder(tokens.tokenizer_path(), 50)
    for _ in range(300):
        texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(rng.randint(1, 9))]
        assert made.encode(texts) == [np.array(made.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
