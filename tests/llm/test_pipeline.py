"""The corpus pipeline against its SQL, and what its stages promise."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")


def test_the_pipeline_gives_the_rows_of_its_sql(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(corpus_pipeline.ORACLE_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(str, got.select(*names).collect())) == sorted(str(r) for r in (got.sparkSession.createDataFrame(want.fetchall(), got.select(*names).schema)).collect())


def test_every_stage_takes_the_rows_of_the_one_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    extra = docs.withColumns({"_id": F.lit("a"), "rows": F.lit(1), "kept": F.lit(True)})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, extra, SF)
        assert out.count() == 0, name
        assert out.columns == extra.columns, name


def test_lines_of_the_quality_stage_leave_the_text_and_its_length(spark):
    own = lambda k: " ".join(f"w{chr(97 + k // 26)}{chr(97 + k % 26)}x{chr(97 + j)}" for j in range(26))
    rows = [(k, f"{own(k)}\nsubscribe to our letter", "en", "host", 0) for k in range(60)] + [(99, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert set(got) == set(range(60)) and all(r.text == own(k) and r.n_chars == len(own(k)) for k, r in got.items())
