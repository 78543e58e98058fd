"""The corpus pipeline and the registered queries of the llm part."""

import re

import duckdb
import pytest
from test_nearcopies import kept_reference

import __spark_entry__
import corpus_pipeline
from tallyframe.llm import decontam, mixing, quality

SF = "/root/testdata/sf0.001"


def test_pipeline_is_its_stages_by_brute_force(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = quality.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").select("doc_id")
    texts = {r.doc_id: r.text for r in docs.join(good, "doc_id").collect()}
    ids = sorted(texts)
    keep = {ids[k] for k in kept_reference([texts[i] for i in ids])}
    plain = lambda t: re.sub(r"\s+", " ", t.lower())
    items = [plain(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i in keep if any(x in plain(texts[i]) for x in items)}
    found = {r.doc_id for r in decontam.contamination(docs.where(docs.doc_id.isin(keep)), spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert holds <= found
    mix = {r.doc_id: r.copies for r in mixing.mix(docs.where(docs.doc_id.isin(keep - found))).collect()}
    got = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {i: n for i, n in mix.items() if n}


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "benchmark decontamination", "mixing sources to target weights", "sharding"]


@pytest.mark.parametrize("name", ["op1_voronoi_knn", "op3_pareto_mix", "op8_warc_revisit"])
def test_twin(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = __spark_entry__.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    row = lambda values: tuple(round(v, 6) if isinstance(v, float) else v for v in values)
    a = sorted(repr(row(r[c] for c in names)) for r in got.collect())
    assert a == sorted(repr(row(r)) for r in want.fetchall())


def test_one_query_for_each_operator():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
