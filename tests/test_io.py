"""Files, streams, and a sample of the catalog against DuckDB."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from treeloom.model import from_rows
from treeloom.operators import closure
from treeloom.plans import catalog
from treeloom.sources import files
from treeloom.streaming import ingest

REPO = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return from_rows(spark, [(0, 0.0), (1, 0.0), (2, 1.0)], [(0, 10, 2, 0), (0, 10, 2, 1)], 0, 10, [(7, 3.5, 0.5, None, 0, 2)])


def test_parquet_round_trip(spark, small, tmp_path):
    files.write_parquet(small.set_offset(5).set_chromosome(3), str(tmp_path / "g"))
    back = files.read_parquet(spark, str(tmp_path / "g"))
    assert (back.start, back.end, back.offset, back.chromosome) == (0, 10, 5, 3)
    for part in ("nodes", "edges", "mutations"):
        assert sorted(map(str, getattr(back, part).collect())) == sorted(map(str, getattr(small, part).collect()))
    assert files.validate(spark, str(tmp_path / "none")) == ["no header"]


def test_text_files(spark, tmp_path):
    (tmp_path / "n.txt").write_text("id\tis_sample\ttime\tpopulation\tindividual\tmetadata\n0\t1\t0\t0\t-1\t\n1\t1\t0\t0\t-1\t\n2\t0\t1.5\t0\t-1\t\n")
    (tmp_path / "e.txt").write_text("left\tright\tparent\tchild\n0\t8\t2\t0\n0\t8\t2\t1\n")
    g = files.read_text_tables(spark, str(tmp_path / "n.txt"), str(tmp_path / "e.txt"))
    assert (g.start, g.end) == (0, 8) and g.leaves.count() == 2
    (tmp_path / "p.txt").write_text("FID IID y\n1 10 0.5\n2 20 NA\n3 30 -1\n")
    (tmp_path / "s.sample").write_text("ID_1 ID_2 missing\n0 0 0\n20 20 0\n10 10 0\n")
    m = files.match_phenotypes(files.read_samples(spark, str(tmp_path / "s.sample")), files.read_phenotypes(spark, str(tmp_path / "p.txt")))
    assert sorted(map(tuple, m.collect())) == [(0, None), (1, 0.5)]
    with pytest.raises((RuntimeError, OSError)):
        files.read_hdf5(spark, str(tmp_path / "n.txt"))


def test_header_setters(small):
    with pytest.raises(ValueError):
        small.set_offset(-1)
    with pytest.raises(ValueError):
        small.set_chromosome(0)


def test_stream_of_mutations(spark, small, tmp_path):
    small.mutations.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(small.mutations.schema).parquet(str(tmp_path / "in"))
    q = ingest.stream_carriers(stream, closure.ancestry(small)).writeStream.format("memory").queryName("carriers").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("carriers").collect()] == [(7, 3.5, 0)]


@pytest.mark.parametrize("name", ["total_volume", "clades", "mrca_pair", "impute_new", "assoc_all", "grm_from_mutations", "trim_edges"])
def test_catalog_agrees_with_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders"):
        db.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = db.sql(catalog.ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall()
    assert sorted(map(str, map(tuple, df.select(cols).collect()))) == sorted(map(str, want))


def test_library_stands_without_the_training_data_part(tmp_path):
    import shutil

    shutil.copytree(REPO / "treeloom", tmp_path / "treeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'total_volume' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
