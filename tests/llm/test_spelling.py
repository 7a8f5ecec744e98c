"""op13 against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from treeloom.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(docs):
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def rows(df):
    got = [(r["word"], (r["form"], r["root"], r["n"], r["n_near"], r["form_n"])) for r in df.collect()]
    assert len(got) == len(dict(got))
    return dict(got)


def random_words(seed, letters, size, lengths):
    """Few letters and many edits: dense neighbourhoods."""
    rnd = random.Random(seed)
    words = set()
    while len(words) < size:
        w = "".join(rnd.choice(letters) for _ in range(rnd.choice(lengths)))
        words.add(w)
        for _ in range(3):
            at, kind = rnd.randrange(len(w)), rnd.randrange(3)
            w = w[:at] + ("" if kind == 0 else rnd.choice(letters)) + w[at + (kind != 2) :]
            if len(w) >= 6:
                words.add(w)
    return {w: 5 ** rnd.randrange(1, 6) for w in sorted(words)}


@pytest.mark.parametrize(("letters", "hot"), [("ab", 50), ("ab", 2), ("abcé", 3), ("abcdefgh", 1)])
def test_variants_match_all_pairs(spark, monkeypatch, letters, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    n = random_words(len(letters) + hot, letters, 250, (6, 7, 8, 9, 13))
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    pairs = {tuple(r) for r in spelling.near_pairs(df, hot).collect()}
    assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in n for b in n if one_edit(a, b)} and len(pairs) == len({frozenset(p) for p in pairs})
    assert rows(spelling.variants(df)) == brute(n)


def test_common_ending(spark):
    """A segment that all words share."""
    n = {f"{a}{b}{c}ending": 5 for a in "abcdefg" for b in "abcdefg" for c in "abc"}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert rows(spelling.variants(df)) == brute(n)


def test_texts(spark):
    rnd = random.Random(3)
    known = ["lettering", "LETTERING", "éclairage", "Éclairage", "ÉCLAIRAGE", "x×y÷zabc", "abcdef", "letering", "short", "straße", "naïveté", "Ωmegaword"]
    docs = [(i, " ".join(rnd.choice(known) for _ in range(60))) for i in range(300)]
    docs += [(None, "lettering letering " * 3), (None, None), (5, ""), (5, docs[5][1]), (6, "a" * 2_000_000), (7, " ".join(["wordlike"] * 100_000))]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"word": F.lit("x"), "n": F.lit(1)})
    assert rows(spelling.spelling_variants(df)) == brute(count(docs))
    assert any(crc32(f"{i}:{w}".encode()) % 199 == 0 for i, _ in docs for w in ("lettering", "éclairage"))


def test_chains_and_empty(spark):
    n = {"aaaaaaaaa": 5, "aaaaaaaa": 25, "aaaaaaab": 125, "aaaaaabb": 625, "aaaaabbb": 3125, "aaaabbbb": 15625, "zzzzzzzz": 7}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    got = rows(spelling.variants(df))
    assert got == brute(n)
    assert got["aaaaaaaaa"][1] == "aaaabbbb"
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
