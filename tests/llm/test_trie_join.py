"""op12 against all pairs of sets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from treeloom.llm import trie_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} if w else set()


def brute(docs):
    """Rows (doc_id, n_shingles, component_id), null ids as one last document."""
    last = 2**63 - 1
    rows = [(last if i is None else i, shingles(t)) for i, t in docs]
    up = {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if i == j or (a and 100 * len(a & b) >= 85 * len(a | b)):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    out = lambda i: None if i == last else i
    return sorted(((out(i), len(s), out(find(i))) for i, s in rows), key=str)


def got(spark, docs, **more):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({k: F.lit(v) for k, v in more.items()})
    return sorted((tuple(r) for r in trie_join.jaccard_groups(df).collect()), key=str)


def corpus(seed):
    """Texts, near copies by chains of edits, and passages that many texts share."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(4000)}"
    passages = [[word() for _ in range(rnd.randrange(20, 40))] for _ in range(4)]
    docs = []
    for _ in range(60):
        base = [word() for _ in range(rnd.randrange(1, 150))]
        if rnd.random() < 0.6:
            at = rnd.randrange(len(base))
            base[at:at] = rnd.choice(passages)
        for _ in range(rnd.choice([1, 1, 1, 2, 3, 8])):
            docs.append(" ".join(base))
            base = list(base)
            for _ in range(rnd.randrange(4)):
                base[rnd.randrange(len(base))] = word()
    docs += [" ".join(rnd.choice(passages) + rnd.choice(passages)) for _ in range(12)]
    rnd.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("seed", "chunk"), [(1, 500), (2, 3), (3, 2)])
def test_groups_match_all_pairs(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(trie_join, "CHUNK", chunk)
    docs = corpus(seed)
    want = brute(docs)
    assert len({c for _, _, c in want}) < len(docs) - 20
    assert got(spark, docs) == want


def test_large_groups(spark, monkeypatch):
    """A third of the texts near copies of one another, and as many copies."""
    monkeypatch.setattr(trie_join, "CHUNK", 16)
    rnd = random.Random(5)
    base = [f"b{k}" for k in range(120)]
    docs = []
    for _ in range(120):
        near = list(base)
        for _ in range(rnd.randrange(5)):
            near[rnd.randrange(120)] = f"x{rnd.randrange(10**6)}"
        docs.append(" ".join(near))
    docs += [" ".join(base)] * 60 + [" ".join(f"r{rnd.randrange(10**6)}" for _ in range(90)) for _ in range(60)]
    rnd.shuffle(docs)
    docs = list(enumerate(docs))
    assert got(spark, docs) == brute(docs)


def test_edges(spark):
    long = " ".join(f"v{k}" for k in range(300))
    docs = [
        (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (7, "one two three four"), (8, "one two three four five"), (9, long), (9, "another text for the same id"),
        (10, "another text for the same id"), (11, long + " end"), (None, "lonely text without any id at all"), (None, long), (12, "É é"), (13, "é é"), (14, "x" * 3_000_000), (15, "x" * 3_000_000), (9, long),
    ]
    assert got(spark, docs, f1=1, rep="x", n=None, tokens=3) == brute(docs)
    assert got(spark, [(None, "a b c d"), (None, "e f g h")]) == brute([(None, "a b c d"), (None, "e f g h")])
    assert trie_join.jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_limit_is_inclusive(spark):
    """Sets of 17 and 20 with 17 in common: exactly 85 %."""
    words = [f"k{i}" for i in range(23)]
    docs = [(1, " ".join(words)), (2, " ".join(words[:20])), (3, " ".join(words[3:19]))]
    assert got(spark, docs) == brute(docs) == sorted([(1, 20, 1), (2, 17, 1), (3, 13, 3)], key=str)


def test_trie_finds_what_all_pairs_find():
    rnd = random.Random(9)
    for _ in range(30):
        sets = []
        for _ in range(40):
            s = sorted(rnd.sample(range(60), rnd.randrange(1, 40)))
            sets.append(s)
            if rnd.random() < 0.6:
                sets.append(sorted({x for x in s if rnd.random() < 0.95} | {rnd.randrange(60)}))
        trie, up = trie_join.Trie(), list(range(len(sets)))

        def find(x, up):
            while up[x] != x:
                x = up[x]
            return x

        links = []
        for k, s in enumerate(sets):
            links += [(k, o) for o in trie.probe(k, k, len(s), s)]
            trie.insert(k, k, len(s), s)
            for j in range(k):
                if 100 * len(set(s) & set(sets[j])) >= 85 * len(set(s) | set(sets[j])):
                    up[find(k, up)] = find(j, up)
        mine = list(range(len(sets)))
        for a, b in links:
            assert 100 * len(set(sets[a]) & set(sets[b])) >= 85 * len(set(sets[a]) | set(sets[b]))
            mine[find(a, mine)] = find(b, mine)
        for a in range(len(sets)):
            for b in range(a):
                assert (find(a, up) == find(b, up)) == (find(a, mine) == find(b, mine))
