import os

import pytest

import corpus_pipeline as pipeline
from textweir.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


def test_stages_equal_their_parts(spark):
    """Every stage of a run, against what the operators' own queries say of its input."""
    from textweir.llm import common, decontamination, line_dedup, ngram_jaccard, quality

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda d: sorted(r[0] for r in d.select("doc_id").collect())
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    keeps = [
        lambda d: ids(quality.op8(d).where("keep = 1")),
        lambda d: ids(line_dedup.op5(d).where("n_removed = 0 or trim(text) <> ''")),
        lambda d: ids(ngram_jaccard.op3(d).where("doc_id = component_id")),
        lambda d: ids(decontamination.op10(d, bench).where("not contaminated")),
    ]
    columns = docs.columns
    for (name, stage), keep in zip(pipeline.STAGES, keeps):
        out = common.materialise(stage(spark, docs, SF), name)
        assert out.columns == columns and ids(out) == keep(docs), name
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r[0] for r in packed.select("doc_id").distinct().collect()} == set(ids(docs))
    assert pipeline.run(spark, SF).count() == packed.count()


def test_queries_and_sql():
    names = [n for n in queries.queries() if n.startswith("op")]
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.oracle_sql()) <= set(names) and len(names) == 10


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    import duckdb

    got = queries.queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name]).df()
    plain = lambda v: None if v is None or str(v) == "<NA>" or v != v else v.item() if hasattr(v, "item") else v
    rows = lambda f: sorted(repr([plain(x) for x in r]) for r in f[list(want.columns)].astype(object).itertuples(index=False))
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
