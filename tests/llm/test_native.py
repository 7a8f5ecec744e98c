"""Line dedup, line rules, decontamination and mixing on small tables with every odd case."""

import hashlib
import itertools
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from treeloom.llm import decontam, line_dedup, line_rules, mixing

# extra columns clash with internal and output names
SCHEMA = "doc_id long, text string, source string, _id string, n_words string, kept string, rows string, h string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], SCHEMA)


ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, "same long line here\nother", "a"),
    (4, "SAME long line here\t\nanother long line\nshort", "b"),
    (4, "SAME long line here\t\nanother long line\nshort", "b"),  # a repeated row
    (5, "another long line\nanother long line\nÉcole des Mines", "b"),
    (6, "école des Mines\n\n  Same Long Line Here", None),
    (None, "same long line here\nonly null", "a"),
    (None, "only null id line\nonly null id line", "a"),
    (7, "word " * 30000, "a"),
]


def expected_lines(rows):
    strip, low = (lambda x: x.strip(" \t\n\x0b\x0c\r")), (lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x))
    last = 1 << 63
    first = {}
    for i, t, _ in rows:
        for line in (t or "").split("\n"):
            k = low(strip(line))
            first[k] = min(first.get(k, last + 1), last if i is None else i)
    out = []
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(low(strip(x))) < 10 or first[low(strip(x))] == (last if i is None else i)]
        out.append((i or -1, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup(spark, monkeypatch, hot):
    if hot:  # every key goes the way of the hot ones
        monkeypatch.setattr(line_dedup, "hot_keys", lambda rows, n: [r.k1 for r in rows.select("k1").distinct().collect()])
    d = line_dedup.dedup_lines(frame(spark, ODD))
    got = d.select(F.coalesce("doc.doc_id", F.lit(-1)), "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got)) == expected_lines(ODD)


def test_long_documents_keep_their_bitmaps(spark):
    lines = [f"line number {k % 700}" for k in range(3000)]
    rows = [(1, "\n".join(lines[:650]), "a"), (2, "\n".join(lines), "a")]
    got = line_dedup.dedup_lines(frame(spark, rows)).select("doc.doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256)).collect()
    assert sorted(map(tuple, got)) == expected_lines(rows)


@pytest.mark.parametrize("run", [
    lambda d, b: line_dedup.dedup_lines(d), lambda d, b: line_rules.apply_rules(d), lambda d, b: mixing.mix(d),
    lambda d, b: decontam.contaminated(d, b), lambda d, b: line_rules.kept_documents(d), lambda d, b: decontam.clean_documents(d, b),
])
def test_empty_tables(spark, run):
    assert run(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_base_statistics(spark):
    def expected(t):
        t = t or ""
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        win = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {j for k in range(len(w) - 7) if win[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w))

    phrase = "a b c d e f g h"
    texts = [t for _, t, _ in ODD] + [f"{phrase} x {phrase} " + "one two three " * 1 + " ".join(f"w{k}" for k in range(60)), "# * $ <a> é😀 | x\n# y\n\n# y", " ".join("abcabcabcd")]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    d = line_rules.base_statistics(frame(spark, rows))
    got = {r.doc_id: tuple(r)[1:] for r in d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {k: expected(t) for k, t in enumerate(texts)}


def test_boilerplate_depletes_and_copies_do_not(spark):
    letter = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)  # noqa: E731  digits are made alike
    own = lambda k, n: " ".join(f"own{letter(k)}x{letter(j)}" for j in range(n))
    notice = " ".join(f"notice{j}" for j in range(25))
    rows = [(k, f"{own(k, 8)}\n{notice}\n{own(k, 4)}b", "host") for k in range(8)]  # mostly the notice
    rows += [(100 + k, f"{own(200, 40)}\n{notice}\n{own(300, 40)}", "copied") for k in range(30)]  # copies of one page
    rows += [(200 + k, f"{own(400 + k, 60)}\n{notice}", "other") for k in range(3)]  # rare on its host
    got = {r.doc.doc_id: r for r in line_rules.apply_rules(frame(spark, rows), max_docs=5).collect()}
    assert all(not got[k].kept and got[k].removed_words == 25 for k in range(8))
    assert all(got[k].kept for k in range(100, 130))
    assert all(got[k].kept and got[k].removed_words == 0 for k in range(200, 203))
    kept = line_rules.kept_documents(frame(spark, rows), max_docs=5)
    assert kept.columns == frame(spark, []).columns and kept.count() == 33


def test_every_line_of_a_block_in_many_documents_is_removed(spark):
    letter = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)
    own = lambda k, n: " ".join(f"own{letter(k)}x{letter(j)}" for j in range(n))
    block = "\n".join(" ".join(f"menu{letter(i)}{letter(j)}" for j in range(12)) for i in range(5))
    rows = [(k, f"{own(k, 10)}\n{block}", "end") for k in range(8)] + [(100 + k, f"{own(k, 10)}\n{block}\n{own(k, 9)}b", "middle") for k in range(8)]
    rows += [(200 + k, f"order {k}\n{block}", "digits") for k in range(8)]  # different texts, though their lines are made alike
    got = {r.doc.doc_id: r for r in line_rules.apply_rules(frame(spark, rows), max_docs=5).collect()}
    assert len(got) == 24 and all(not r.kept and r.removed_words == (62 if k >= 200 else 60) for k, r in got.items())  # "order 0" is common too


def test_copies_of_one_page_do_not_shield_a_line(spark):
    letter = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)
    own = lambda k, n: " ".join(f"own{letter(k)}x{letter(j)}" for j in range(n))
    notice = " ".join(f"notice{j}" for j in range(25))
    rows = [(k, f"{own(k, 12)}\n{notice}", "one hot") for k in range(8)] + [(100 + k, f"{own(50, 90)}\n{notice}", "one hot") for k in range(40)]
    rows += [(200 + k, f"{own(k // 3, 12)}\n{notice}", "each thrice") for k in range(24)]
    got = {r.doc.doc_id: r for r in line_rules.apply_rules(frame(spark, rows), max_docs=5).collect()}
    assert all(r.removed_words == 25 for r in got.values()) and len(got) == 72
    assert all(r.kept == (100 <= k < 140) for k, r in got.items())


def test_masks_find_every_window_with_two_substitutions():
    n = decontam.WINDOW
    for bad in itertools.combinations(range(n), decontam.MISSES):
        assert any(all(s + i not in bad for i, c in enumerate(m) if c == "1") for m in decontam.MASKS for s in range(n - len(m) + 1))


def test_short_items_are_found_with_any_one_substitution(spark):
    items = {n: [f"item{n}tok{k}" for k in range(n)] for n in range(8, 13)}
    rows = [(100 * n + k, "before it " + " ".join("changed" if j == k else w for j, w in enumerate(t)) + " after it", "a") for n, t in items.items() for k in range(n)]
    rows += [(100 * n + 50, " ".join(t[1:]), "a") for n, t in items.items()] + [(100 * n + 60, " ".join(["x", *t[1:-1], "y"]), "a") for n, t in items.items()]
    bench = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched_tokens, r.start) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(100 * n + k, n): (n - 1, 2) for n in items for k in range(n)} | {(100 * n + 50, n): (n - 1, -1) for n in items}


WAYS = [{}, {"BROADCAST_MB": 0}]  # by broadcast; by Bloom filter and shuffle


def plain_overlaps(rows, bench):
    """Every alignment of every text with every item, token by token."""
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    found = {}
    for i, t, *_ in rows:
        t = split(t)
        for j, b in bench:
            b = split(b)
            width = min(13, len(b))
            need = width - (0 if len(b) < 8 else width * 2 // 13)
            for shift in range(1 - len(b), len(t) if b else 0):
                equal = [0 <= shift + k < len(t) and t[shift + k] == w for k, w in enumerate(b)]
                if any(sum(equal[s : s + width]) >= need for s in range(len(b) - width + 1)):
                    key = (sum(equal), -shift)
                    found[i, j] = max(found.get((i, j), key), key)
    return {k: (n, -back) for k, (n, back) in found.items()}


@pytest.mark.parametrize("way", WAYS)
def test_every_item_length_against_all_alignments(spark, monkeypatch, way):
    for k, v in way.items():
        monkeypatch.setattr(decontam, k, v)
    items = {n: [f"item{n}tok{k}" for k in range(n)] for n in range(1, 15)}
    bench = [(n, " ".join(t)) for n, t in items.items()] + [(50, "これは空白のない文です"), (51, "!? .")]
    rows = []
    for n, t in items.items():
        for bad in itertools.chain([()], itertools.combinations(range(n), 1), itertools.combinations(range(n), 2) if n in (7, 8, 12, 13) else ()):
            rows.append((len(rows), "before it " + " ".join("changed" if k in bad else w for k, w in enumerate(t)) + " after it", "a"))
        rows.append((len(rows), " ".join(t[1:]), "a"))
    rows += [(len(rows), "x これは空白のない文です。 y", "a"), (len(rows) + 1, "これは空白のない", "a"), (len(rows) + 2, None, "a")]
    got = {(r.doc_id, r.item_id): (r.matched_tokens, r.start) for r in decontam.contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == plain_overlaps(rows, bench) and len(got) > 150


@pytest.mark.parametrize("way", WAYS)
def test_hot_seeds_and_long_texts(spark, monkeypatch, way):
    for k, v in way.items():
        monkeypatch.setattr(decontam, k, v)
    phrase = "in the beginning of the same old story that everybody knows by heart".split()
    bench = [(j, " ".join([*phrase, f"tail{j}a", f"tail{j}b"])) for j in range(6)]
    rows = [(k, " ".join([f"own{k}", *phrase, f"tail{k % 6}a"]), "a") for k in range(60)]
    rows += [(100, " ".join([f"w{k % 977}" for k in range(40000)] + phrase + [f"v{k % 977}" for k in range(40000)]), "a")]
    got = {(r.doc_id, r.item_id): (r.matched_tokens, r.start) for r in decontam.contaminated(frame(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == plain_overlaps(rows[:60], bench) | {(100, j): (13, 40000) for j in range(6)}


def test_decontamination(spark):
    item = [f"tok{k}" for k in range(30)]
    changed = list(item)
    changed[4], changed[11], changed[20] = "x", "y", "z"
    noise = " ".join(f"noise{k}" for k in range(200))
    rows = [
        (1, noise, "a"), (2, f"{noise} {' '.join(item).upper()}! {noise}", "a"), (3, " ".join(changed), "a"),
        (4, " ".join(item[:10]), "a"), (5, None, "a"), (6, "", "a"), (7, ", ".join(item[8:22]), "a"),
        (8, " ".join(w for k, w in enumerate(item) if k % 3), "a"), (None, " ".join(item), "a"), (2, "second text of two", "a"),
        (9, "the the the the the the the the the the the the the the", "a"),
    ]
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, "too short"), (10, " ".join(item)), (13, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.matched_tokens, r.start) for r in decontam.contaminated(frame(spark, rows), bench).collect()}
    assert got == {(2, 10): (30, 200), (3, 10): (27, 0), (7, 10): (14, -8), (None, 10): (30, 0)}
    clean = decontam.clean_documents(frame(spark, rows), bench)
    assert clean.columns == frame(spark, []).columns
    assert sorted((r.doc_id, (r.text or "")[:6]) for r in clean.collect()) == [(1, "noise0"), (2, "second"), (4, "tok0 t"), (5, ""), (6, ""), (8, "tok1 t"), (9, "the th")]


def test_mixing(spark):
    rows = [(k, "w " * (1 + k % 40), ("big" if k % 2 else "huge") if k % 10 else None if k % 20 else "tiny") for k in range(4000)]
    rows += [(9000, None, "nothing"), (9001, "", "nothing"), (17, "w w w", "big"), (17, "w w w", "big"), (None, "w w", None)]
    d = mixing.mix(frame(spark, rows)).cache()
    size = d.groupBy("doc.source").agg(F.sum("size").alias("s"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("source_size").alias("ss"), F.first("target").alias("t"), F.max("copies").alias("most")).collect()
    total = sum(r.s for r in size)
    by = {r.source: r for r in size}
    assert all(r.s == r.ss and r.most <= 3 and r.t <= 3 * r.s for r in size)
    assert abs(sum(r.t for r in size) - total) < 1e-6 * total
    assert by["nothing"].taken == 0 and by["tiny"].t == 3 * by["tiny"].s
    assert all(abs(r.taken - r.t) <= max(0.02 * r.t, 60) for r in size)
    again = mixing.mix(frame(spark, rows).repartition(3))
    assert sorted(map(str, d.select("doc.doc_id", "copies").collect())) == sorted(map(str, again.select("doc.doc_id", "copies").collect()))
    out = mixing.mixed_documents(frame(spark, rows))
    assert out.columns == frame(spark, []).columns and out.count() == d.agg(F.sum("copies")).first()[0]


@pytest.mark.parametrize("ids", [lambda k: 4096 * k, lambda k: None, lambda k: 5])
def test_mixing_spreads_ids_in_steps_shared_and_missing_ids(spark, ids):
    rows = [(ids(k), " ".join(f"t{k}w{j}" for j in range(1 + k % 30)), "ab"[k % 2]) for k in range(3000)]
    d = mixing.mix(frame(spark, rows), carry=("doc_id", "text")).cache()
    for r in d.groupBy("source_size", "target").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("most"), F.sum("size").alias("size")).collect():
        assert r.size == r.source_size and r.most <= 3 and abs(r.taken - r.target) <= 0.02 * r.target
    again = mixing.mix(frame(spark, rows).repartition(5), carry=("doc_id", "text"))
    assert sorted(map(str, d.select("doc", "copies").collect())) == sorted(map(str, again.select("doc", "copies").collect()))
    tie = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), "text"))
    chunks = frame(spark, rows).groupBy(F.substring(tie, 1, 3)).count().agg(F.max("count")).first()[0]
    assert chunks < 12  # no chunk gathers the rows


@pytest.mark.parametrize("mb", [0, 32])
def test_lines_above_the_limit_leave_the_texts(spark, monkeypatch, mb):
    monkeypatch.setattr(line_rules, "BROADCAST_MB", mb)
    letter = lambda k: chr(97 + k // 26 % 26) + chr(97 + k % 26)
    own = lambda k, n: " ".join(f"own{letter(k)}x{letter(j)}" for j in range(n))
    texts = {k: f"{own(k, 30)}\n\n  Shared   LINE {k}\n{own(k, 5)}b" for k in range(8)}
    rows = [(k, t, "host") for k, t in texts.items()] + [(50, texts[0], "other"), (0, texts[0], None), (0, texts[0], "host"), (60, None, "host"), (61, "too short", "host")]
    out = line_rules.kept_documents(frame(spark, rows), max_docs=5)
    assert out.columns == frame(spark, []).columns
    got = sorted((r.doc_id, r.source or "", r.text) for r in out.collect())
    cut = {k: f"{own(k, 30)}\n\n{own(k, 5)}b" for k in texts}
    assert got == sorted([(k, "host", t) for k, t in cut.items()] + [(0, "host", cut[0]), (50, "other", texts[0]), (0, "", texts[0])])


def test_hot_keys_grow_with_partitions(spark):
    rows = spark.range(60000).select(F.when(F.col("id") < 40000, F.col("id") % 20).otherwise(F.col("id")).alias("k1"))
    assert sorted(line_dedup.hot_keys(rows, 8)) == list(range(20))  # each holds 2000 rows of 60000, above 60000 / 64
