"""Random resolution, merging, quantiles and jobs."""

import numpy as np
import pytest

from treeloom.__main__ import main
from treeloom.functions.scalars import harrell_davis
from treeloom.model import from_rows
from treeloom.operators import closure, resolution
from treeloom.sources import files


@pytest.fixture(scope="module")
def star(spark):
    return from_rows(spark, [(k, 0.0) for k in range(8)] + [(8, 1.0)], [(0, 100, 8, c) for c in range(8)], 0, 100)


@pytest.fixture(scope="module")
def tournament(spark):
    nodes = [(k, 0.0) for k in range(8)] + [(8, 1.0), (9, 1.0), (10, 1.0), (11, 1.0), (12, 2.0), (13, 2.0), (14, 3.0)]
    return from_rows(spark, nodes, [(0, 100, p, c) for p, kids in ((8, (0, 1)), (9, (2, 3)), (10, (4, 5)), (11, (6, 7)), (12, (8, 9)), (13, (10, 11)), (14, (12, 13))) for c in kids], 0, 100)


def test_resolved_trees_are_binary_and_have_no_new_length(star):
    stabs = closure.golden_stabs(star, 3)
    e = resolution.resolve_randomly(resolution.trees_at(star, stabs), 4).collect()
    assert len(e) == 3 * 14
    for k in (1, 2, 3):
        kids = [x.parent for x in e if x.k == k]
        assert all(kids.count(p) == 2 for p in set(kids))
        assert sum(x.height_parent - x.height_child for x in e if x.k == k) == 8


def test_metrics_against_a_star(star, tournament):
    stabs = closure.golden_stabs(star, 2)
    merged = resolution.special_metrics(tournament, star, stabs, "heuristic_merge", fraction=1.0).first()
    assert merged.kc == 0 and merged.split == 0
    plain = resolution.special_metrics(tournament, star, stabs, "heuristic_merge", fraction=0.0).first()
    assert plain.kc == 24  # squared depths: 4 pairs at 2, 8 at 1
    assert resolution.special_metrics(tournament, tournament, stabs, "random_resolve").first().kc == 0
    with pytest.raises(ValueError):
        resolution.special_metrics(star, star, stabs, "other")


def test_overlap_counts_resolved_sets(star, tournament):
    stabs = closure.golden_stabs(star, 1)
    got = resolution.resolved_overlap(star, tournament, closure.ancestry(star), closure.ancestry(tournament), stabs, [1, 2, 3]).first()
    assert (got.n1, got.n2) == (3 * 14, 3 * 14) and 3 * 8 <= got.n_common <= 3 * 14 and got.len1 == 3 * 8


def test_quantile():
    x = np.random.default_rng(0).normal(size=2000)
    assert harrell_davis(list(x), 0.5) == pytest.approx(np.median(x), abs=0.02)
    assert harrell_davis([3.0, 1.0, 2.0], 0.5) == pytest.approx(2.0, abs=1e-3)


def test_jobs(spark, tournament, tmp_path):
    files.write_parquet(tournament, str(tmp_path / "g"))
    (tmp_path / "p").write_text("FID IID y\n" + "".join(f"{k} {k} {v}\n" for k, v in enumerate((1.0, 2.5, -1.0, 0.5))))
    (tmp_path / "s").write_text("ID_1 ID_2 missing\n0 0 0\n" + "".join(f"{k} {k} 0\n" for k in range(4)))
    main(["associate", "--genealogy", str(tmp_path / "g"), "--phenotypes", str(tmp_path / "p"), "--samples", str(tmp_path / "s"), "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), sep="\t", header=True).count() == 14
    main(["export", "--genealogy", str(tmp_path / "g"), "--out", str(tmp_path / "tables")])
    assert spark.read.csv(str(tmp_path / "tables/edges"), sep="\t", header=True).count() == 14


def test_jobs_round_an_association(spark, tournament, tmp_path, capsys):
    at = lambda name: str(tmp_path / name)
    files.write_parquet(tournament, at("g"))
    (tmp_path / "p").write_text("FID IID y\n" + "".join(f"{k} {k} {v}\n" for k, v in enumerate((1.0, 2.5, -1.0, 0.5))))
    (tmp_path / "c").write_text("FID IID score\n" + "".join(f"{k} {k} {v}\n" for k, v in enumerate((0.5, 0.0, 0.25, 0.0))))
    (tmp_path / "s").write_text("ID_1 ID_2 missing\n0 0 0\n" + "".join(f"{k} {k} 0\n" for k in range(4)))
    (tmp_path / "log").write_text("AvgPro calibration 2.0 (x)\nCalibration factor 4.0 ok\nend of calibration\n")
    read = lambda name: spark.read.csv(at(name), sep="\t", header=True).collect()
    main(["calibration", "--log", at("log")])
    assert capsys.readouterr().out.strip() == "0.25"
    main(["residual", "--phenotypes", at("p"), "--scores", at("c"), "--sites", "2", "--out", at("r")])
    y, b = np.array([1.0, 2.5, -1.0, 0.5]), -4 * np.array([0.5, 0.0, 0.25, 0.0])
    assert [float(r.RESIDUAL) for r in sorted(read("r"), key=lambda r: r.IID)] == pytest.approx(list(y - y.mean() - b + b.mean()))
    main(["associate", "--genealogy", at("g"), "--phenotypes", at("r"), "--samples", at("s"), "--out", at("a")])
    main(["tests", "--results", at("a"), "--part", "one", "--min-mafs", "0", "0.3", "--out", at("t")])
    found = read("a")
    for r in read("t"):
        kept = [float(x.CHISQ) for x in found if float(x.MAF) >= float(r.min_maf)]
        assert (int(r.tests), float(r.max_chi2)) == (len(kept), max(kept))
    main(["scaling", "--tests", at("t"), "--null-part", "one", "--out", at("x")])
    assert {float(r.scaling) for r in read("x")} == {1.0}
    for name in ("n", "again"):
        main(["null", "--genealogy", at("g"), "--replicates", "12", "--out", at(name)])
    null = [float(r.min_p) for r in read("n")]
    assert len(null) == 12 and sorted(null) == sorted(float(r.min_p) for r in read("again"))
    main(["threshold", "--null", at("n"), "--scaling", "0.5", "--out", at("h")])
    assert float(read("h")[0].threshold) == pytest.approx(0.5 * harrell_davis(null, 0.05))
    main(["relationship", "--genealogy", at("g"), "--out", at("m")])
    assert spark.read.text(at("m.grm.gz")).count() == 10
