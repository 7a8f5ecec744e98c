import itertools
import re

import numpy as np
import pytest

from treeloom.llm import shingles, superminhash

SCHEMA = "doc_id long, text string, extra string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """Components over all pairs; rows of one id are one document."""
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(r[0], shingle_set(r[1])) for r in rows]
    for i, _ in sets:
        parent.setdefault(i, i)
    for (a, s), (b, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return sorted((i, len(s), root(i), i == root(i)) for i, s in sets)


def test_word_and_shingle_hashes_follow_the_definition():
    texts = ["A b\tC d e f", "a B c D e f", "", None, " \n", "x", "É b c d e", "é b c d e", "a b c d e f" * 50]
    sets = list(shingles.shingle_sets(texts))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert (sets[0] == sets[1]).all()
    assert sets[6] != sets[7]  # only A to Z are lowered


def test_signature_estimates_similarity_and_stops_early():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(40):
        pool = rng.integers(0, 2**63, 900).astype(np.uint64)
        a, b = superminhash.signature(pool[:600]), superminhash.signature(pool[300:])
        errors.append((a == b).mean() - 300 / 900)
        assert a.max() < 6
    assert abs(np.mean(errors)) < 0.03
    small = superminhash.signature(np.array([7], dtype=np.uint64))
    assert sorted(np.floor(small)) == list(range(superminhash.SLOTS))  # one element serves every slot once


def test_groups_match_all_pairs(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, i = [(900, "", "x"), (901, None, "x"), (902, "one two", "x"), (903, "ONE\ttwo", None), (904, "one", "x")], 0
    for _ in range(12):
        base = list(rng.choice(vocabulary, 60))
        for _ in range(rng.integers(1, 14)):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(0, 60)] = str(rng.choice(vocabulary))
            rows.append((i, " ".join(copy), "x"))
            i += 1
    rows += [rows[8], rows[9]]
    got = sorted(map(tuple, superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)


def test_chain_through_middle_documents(spark):
    """Members that the leader is too far from are still linked through others."""
    base = [f"t{i}" for i in range(100)]
    rows = []
    for k in range(12):
        w = list(base)
        for j in range(k):
            w[3 + 8 * j] = f"new{j}"
        rows.append((k, " ".join(w), ""))
    got = sorted(map(tuple, superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()))
    assert got == brute(rows)


@pytest.mark.parametrize("rows", [[], [(None, "a b c d e f", "x"), (None, "a b c d e f", "y")], [(5, "a b c d e f g", "x"), (None, "a b c d e f g", "y")]])
def test_empty_table_and_null_ids(spark, rows):
    got = superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    if len(rows) == 2 and rows[0][0] == 5:
        assert sorted((r.doc_id is None, r.component_id, r.kept) for r in got) == [(False, 5, True), (True, 5, False)]


def test_kept_documents_leave_one_of_each_group(spark):
    rows = [(3, "a b c d e f g", "x"), (1, "a b c d e f g", "y"), (2, "z y x w v u", "z"), (4, "", "q")]
    got = superminhash.kept_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4]


def test_blocks_of_elements_do_not_change_a_signature(monkeypatch):
    pool = np.random.default_rng(9).integers(0, 2**63, 3000).astype(np.uint64)
    for n in (1, 2, 150, 3000):
        whole = superminhash.signature(pool[:n])
        monkeypatch.setattr(superminhash, "ELEMENTS", 7)
        cut = superminhash.signature(pool[:n])
        monkeypatch.undo()
        assert (whole == cut).all() and (whole == np.min([superminhash.signature(pool[k : k + 1]) for k in range(n)], axis=0)).all()


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'LongerWord' if k % 3 else 'w'}{k}" for k in rng.integers(0, 500, n)) for n in (3, 4, 5, 6, 40, 900)] + ["a" * 300, f"x {'b' * 400} y", "c d\n" * 90]
    whole = [set(s.tolist()) for s in shingles.shingle_sets(texts)]
    assert [len(s) for s in whole] == [len(shingle_set(t)) for t in texts]
    for size in (16, 64, 1000):
        monkeypatch.setattr(shingles, "CHUNK", size)
        assert [set(s.tolist()) for s in shingles.shingle_sets(texts)] == whole


def test_words_that_fool_polynomials_have_hashes_of_their_own():
    a, b = "a", "b"
    for _ in range(10):  # Thue-Morse words: equal under any polynomial over odd multipliers modulo 2^64
        a, b = a + b, b + a
    assert len(a) == 1024
    short = ["a", "a\0", "aa", "aaaaaaa", "aaaaaa\x07", "aaaaaaa\x07", "aaaaaaa\x01", "\x01", "\0"]
    hashes = shingles.word_hashes([x.encode() for x in [a, b, *short]])[0]
    assert len(set(hashes.tolist())) == 2 + len(short)


def test_hot_leaders_are_split(spark, monkeypatch):
    monkeypatch.setattr(superminhash, "PART", 3)
    base = [f"t{i}" for i in range(60)]
    rows = [(k, " ".join([f"new{k}" if j == k % 60 else w for j, w in enumerate(base)]), "") for k in range(40)]
    rows += [(100 + k, " ".join(f"own{k}x{j}" for j in range(30)), "") for k in range(5)] + [(7, rows[7][1], "again")]
    assert sorted(map(tuple, superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


@pytest.mark.parametrize("limit", [0, 32])
def test_grouping_does_not_depend_on_broadcasts(spark, monkeypatch, limit):
    monkeypatch.setattr(superminhash, "broadcast_if_small", lambda df, *a: df.hint("merge") if not limit else df)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(8):
        w = [f"g{g}w{j}" for j in range(40)]
        rows += [(10 * g + k, " ".join(w[:j] + ["x"] + w[j + 1 :]), "") for k, j in enumerate(rng.integers(0, 40, 6).tolist())]
    assert sorted(map(tuple, superminhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
