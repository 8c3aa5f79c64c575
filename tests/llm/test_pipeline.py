import corpus_pipeline
import pytest
from cnvspark.llm.common import kept, scratch
from cnvspark.llm.html_extraction import extract_pages
from cnvspark.llm.quality import fit_quality, score_quality
from cnvspark.llm.toxicity import fit_toxicity, score_toxicity
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    rows = [(i, f"plain document number {i} " + " ".join(f"word{(i * 7 + k) % 97}x{k}" for k in range(40)), "en", "src", 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "src", 0) for i in range(5)]
    rows += [(200, None, None, None, None), (None, "text without an id but with boss@corp.example inside", "en", "src", 3), (201, "", "en", "src", 0)]
    rows += [(202, "leading words " + " ".join(f"bench{k}" for k in range(20)) + " trailing words", "en", "src", 0)]
    rows += [(300 + i, f"you zorkwa person {i} zorkwing " + " ".join(f"tok{(i + k) % 31}" for k in range(30)), "en", "src", 0) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(300 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(20)))], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, folder), name)
        assert docs.columns == columns
        seen.append({r["doc_id"] for r in docs.collect()})
    toxic, near, bench, pii = seen
    assert not any(d and 300 <= d < 340 for d in toxic) and set(range(60)) <= toxic
    assert not any(d and 100 <= d < 105 for d in near) and set(range(60)) <= near and len({200, 201} & near) == 1
    assert bench == near - {202} and pii == bench
    texts = {r["doc_id"]: r for r in docs.collect()}
    assert texts[None]["text"] == "text without an id but with [EMAIL] inside" and texts[None]["n_chars"] == len(texts[None]["text"])


def test_run_packs_everything_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in rows} >= set(range(60)) and all(r["offset"] + r["length"] <= 1024 for r in rows)


def test_stages_keep_columns_of_their_own_names(spark, folder):
    docs = spark.createDataFrame([(1, "write to boss@corp.example", "s1", 5), (2, None, "s2", 6)], "doc_id long, text string, spans string, Clean long")
    rows = {r["doc_id"]: r for r in corpus_pipeline.pii(spark, docs, folder).collect()}
    assert [tuple(rows[k]) for k in (1, 2)] == [(1, "write to [EMAIL]", "s1", 5), (2, None, "s2", 6)]
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.decontamination, corpus_pipeline.pii):
        assert stage(spark, docs, folder).columns == docs.columns and stage(spark, docs, folder).count() == 2
        none = stage(spark, docs.limit(0), folder)
        assert none.columns == docs.columns and none.count() == 0


def test_first_and_last_stage_on_odd_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("toxicity", F.lit("own")).withColumn("_toxicity", F.lit(7))
    kept_docs = corpus_pipeline.toxicity(spark, docs, folder)
    assert kept_docs.columns == docs.columns and {r["toxicity"] for r in kept_docs.collect()} == {"own"}
    assert not any(r["doc_id"] and 300 <= r["doc_id"] < 340 for r in kept_docs.collect())
    none = corpus_pipeline.toxicity(spark, docs.limit(0), folder)
    assert none.columns == docs.columns and none.count() == 0
    clash = spark.createDataFrame([(1, "some words", 3, "x"), (2, None, 4, "y"), (None, "", 5, "z")], "doc_id long, text string, length long, sequence_id string")
    pieces = corpus_pipeline.packing(spark, clash, folder).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in pieces) == [(False, 1), (False, 2), (True, 0)]
    assert corpus_pipeline.packing(spark, clash.limit(0), folder).collect() == []


def test_scores_replace_columns_of_their_names(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    own = docs.withColumns({"quality_score": F.lit("own"), "toxicity": F.lit("own")})
    for scored, name in ((score_quality(own, fit_quality(docs, labels)), "quality_score"), (score_toxicity(own, fit_toxicity(docs, labels)), "toxicity")):
        assert sorted(scored.columns) == sorted(own.columns) and dict(scored.dtypes)[name] == "double" and scored.count() == docs.count()
        assert all(0 <= r[name] <= 1 for r in scored.collect())


def test_pages_keep_columns_that_clash(spark):
    rows = [(i, f"http://h.org/{i}", f"<html><body><nav>Home</nav><article><h1>T{i}</h1><p>Words of page {i} that vary.</p></article></body></html>", "a", "b") for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _wrapper string, _host string")
    got = extract_pages(pages)
    assert set(got.columns) == {*pages.columns, "main_text"} and {(r["_wrapper"], r["_host"]) for r in got.collect()} == {("a", "b")}
    assert all(f"Words of page {r['page_id']}" in r["main_text"] for r in got.collect())


def test_scratch_leaves_only_the_result(spark):
    with scratch(spark):
        first = kept(spark.range(3).toDF("x"), "a")
        last = kept(first, "b")
    assert last.count() == 3
    with pytest.raises(Exception, match="(?i)not.exist|not found"):
        spark.read.parquet(first.inputFiles()[0].rsplit("/", 1)[0]).count()
