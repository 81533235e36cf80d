"""Registered corpus queries: those with SQL against it, the others against brute force in test_small_tables; and the pipeline."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from landstream.llm import catalog, decontamination, language_id, mixing, ngram_join
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, catalog.QUERIES[name], catalog.ORACLES[name], connect(sf_dir)) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_returns_all_rows(spark, sf_dir, name):
    n = catalog.QUERIES[name](spark, sf_dir).count()
    table = "embeddings" if "embedding" in name else "pages" if "html" in name else "documents"
    assert n == spark.read.parquet(f"{sf_dir}/{table}.parquet").count() or name.startswith("op8")


def test_suffix_query_against_brute_force(spark, sf_dir):
    from tests.llm.test_small_tables import brute_repeats

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.QUERIES["op10_suffix_dedup"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == brute_repeats(docs, 200)


def test_ngram_query_against_brute_force(spark, sf_dir):
    from tests.llm.test_small_tables import brute_components

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = catalog.QUERIES["op2_ngram_join"](spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(docs)


def test_leaks_against_plain_search(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in catalog.QUERIES["op8_decontamination"](spark, sf_dir).where("distance = 0").collect()}
    assert exact and got >= exact


def test_pipeline_stage_by_stage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(90001, "... 123", "en", "src0", 7), (90002, None, None, None, None)], docs.schema))
    kept, columns = docs, docs.columns
    told = corpus_pipeline.tell_language(spark, kept, sf_dir).cache()
    assert told.columns == columns and told.where("doc_id > 90000").count() == 0 and told.count() >= 0.98 * docs.count()
    one = corpus_pipeline.drop_near_copies(spark, told, sf_dir).cache()
    groups = ngram_join.ngram_components(told.select("doc_id", "text"))
    assert sorted(r[0] for r in one.select("doc_id").collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    cut = corpus_pipeline.cut_repeats(spark, one, sf_dir).cache()
    assert cut.columns == columns and cut.count() == one.count() and cut.where(F.length("text") != F.col("n_chars")).join(one.select("doc_id", F.col("n_chars").alias("old")), "doc_id").where("n_chars != old").count() == 0
    clean = corpus_pipeline.drop_leaks(spark, cut, sf_dir).cache()
    leaks = decontamination.find_items(cut, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    assert clean.columns == columns and clean.count() == cut.count() - leaks.count()
    mixed = corpus_pipeline.mix(spark, clean, sf_dir)
    assert mixed.count() == mixing.emitted(clean).count() > 0 and mixed.agg(F.max("copy")).first()[0] <= 3


def test_pipeline_runs(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.run(spark, sf_dir).columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert language_id.UNKNOWN == "und"
