"""The pipeline's stages against brute force on its own input, and the registered queries against SQL."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as spark_entry
import corpus_pipeline
from check_queries import rows_of
from labelquarry.llm.queries import ORACLE, QUERIES
from . import test_bottom_k, test_suffix_search, test_superkmers

FOLDER = "/root/testdata/sf0.001"


def plain(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "substring_dedup", "decontaminate", "tokenize"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    columns = docs.columns

    clean = steps["toxicity"](spark, docs, FOLDER).cache()
    assert clean.columns == columns and 0 < clean.count() <= docs.count()

    rows = plain(clean)
    unique = steps["near_dedup"](spark, clean, FOLDER).cache()
    kept = [r[0] for r in test_bottom_k.brute(rows) if r[3]]
    assert unique.columns == columns and sorted(d for d, _ in plain(unique)) == sorted(kept)

    rows = plain(unique)
    cut = steps["substring_dedup"](spark, unique, FOLDER).cache()
    want = [(d, w[3] if w[1] else t) for (d, t), w in zip(rows, test_superkmers.brute([t for _, t in rows]))]
    assert cut.columns == columns and plain(cut) == sorted(want, key=str)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    rows = plain(cut)
    free = steps["decontaminate"](spark, cut, FOLDER).cache()
    want = [x for x, w in zip(rows, test_suffix_search.brute(rows, items)) if not w[5]]
    assert free.columns == columns and plain(free) == sorted(want, key=str)

    tokens = steps["tokenize"](spark, free, FOLDER)
    assert tokens.count() == free.count()


def test_run_and_registration(spark):
    assert spark_entry.queries()["pipeline"] is corpus_pipeline.run
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert out and all(len(r.ids) == r.n_tokens for r in out)
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) <= set(spark_entry.queries())


def test_stages_on_bad_rows(spark):
    rows = [(1, None, "en", "s", None), (None, "", None, "s", 0), (2, "some words of a text", "en", "s", 20), (2, "some words of a text", "en", "s", 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.count() == 4, name
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, FOLDER)
    cur = con.execute(ORACLE[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
