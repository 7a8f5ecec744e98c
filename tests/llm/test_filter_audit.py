"""op11 against its definition, replayed document by document in plain Python."""

import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from treeloom.llm import filter_audit

WORDS = " ".join(f"word{k}" for k in range(250))


def brute(docs, labels):
    first = {}
    for i, t, _ in docs:
        i = 2**63 - 1 if i is None else i
        first[t or ""] = min(first.get(t or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = defaultdict(lambda: [0] * 6)
    shapley = defaultdict(int)
    for i, t, part in docs:
        t, part = t or "", part or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": (2**63 - 1 if i is None else i) > first[t],
        }
        for o in permutations("ABCDE"):
            at = next((k for k in range(5) if fails[o[k]]), 5)
            for k in range(5):
                row = out[part, "".join(o), k + 1]
                f = fails[o[k]]
                for j, c in enumerate([at > k, at == k, f and at < k, f and sum(fails.values()) == 1, at == k and i in good, at == k and i in toxic]):
                    row[j] += bool(c)
                shapley[part, o[k]] += at == k
    return {(p, o, s): (*row, shapley[p, o[s - 1]]) for (p, o, s), row in out.items()}


def rows_of(df):
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = [((r["part"], r["filter_order"], r["step"]), tuple(r[n] for n in names)) for r in df.collect()]
    assert len(found) == len(dict(found))
    return dict(found)


DOCS = [
    (1, WORDS, "a"), (2, WORDS, "b"), (2, WORDS, "b"), (3, None, "a"), (4, "", None), (5, "x " * 300, "a"), (6, "AB " * 90 + "cost $5", ""), (7, WORDS + " #", "b"),
    (None, WORDS, "a"), (None, WORDS, "a"), (None, "only without id", "a"), (8, " \t\n" * 50, "a"), (9, "É" * 400, "b"), (10, WORDS.upper() * 40, "a"), (11, "$ " * 300, "b"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (6, 1, 1), (None, 1, 1), (99, 1, 1), (9, 0, 0)]


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_replay_matches_the_definition(spark, monkeypatch, limit):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").select("*", F.lit("x").alias("part"), F.lit(3).alias("A"), F.lit(True).alias("good"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    monkeypatch.setattr(filter_audit, "BROADCAST_BYTES", limit)
    assert rows_of(filter_audit.audit(docs, labels)) == brute(DOCS, LABELS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    some = spark.createDataFrame(DOCS[:3], "doc_id long, text string, source string")
    assert rows_of(filter_audit.audit(some, labels)) == brute(DOCS[:3], [])


def test_other_filters(spark):
    flags = spark.createDataFrame([("p", True, None, True, False), ("p", False, True, False, True), ("p", True, True, False, False)], "part string, X boolean, Y boolean, good boolean, toxic boolean")
    got = rows_of(filter_audit.replay(flags, "XY"))
    assert got == {("p", "XY", 1): (1, 2, 0, 1, 1, 0, 3), ("p", "XY", 2): (0, 1, 1, 1, 0, 1, 3), ("p", "YX", 1): (1, 2, 0, 1, 0, 1, 3), ("p", "YX", 2): (0, 1, 1, 1, 1, 0, 3)}
    with pytest.raises(ValueError, match="different filters"):
        filter_audit.replay(flags, "ABCDEFG")
