"""ZIP-packaged WARC archives and repeated-byte removal."""

import collections
import hashlib
import io
import random
import zipfile
import zlib

import pytest

from treeloom.llm import bwt, bwt_dedup, warc_zip


@pytest.mark.parametrize("always64", [False, True])
def test_zip_is_what_other_readers_read(always64):
    out = io.BytesIO()
    z = warc_zip.ZipWriter(out, always64)
    parts = {"a/b": b"x" * 1000, "é": b"", "c": bytes(range(256))}
    for name, data in parts.items():
        z.member(name, iter([data[:3], data[3:]]), len(data), zlib.crc32(data))
    z.close()
    if not always64:
        with zipfile.ZipFile(out) as other:
            assert other.testzip() is None and {n: other.read(n) for n in other.namelist()} == parts
    found = warc_zip.central_directory(out, len(out.getvalue()))
    assert {n: warc_zip.read_range(out, warc_zip.member_start(out, e), e[1]) for n, e in found.items()} == parts


def test_archives_of_others_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = b"PK\x05\x06 a misleading comment"
        z.writestr("data", b"stored")
        z.writestr("packed", b"z" * 100, zipfile.ZIP_DEFLATED)
    found = warc_zip.central_directory(out, len(out.getvalue()))
    assert warc_zip.read_range(out, warc_zip.member_start(out, found["data"]), 6) == b"stored"
    with pytest.raises(ValueError, match="stored"):
        warc_zip.member_start(out, found["packed"])
    with pytest.raises(ValueError):
        warc_zip.central_directory(io.BytesIO(b"no archive at all"), 17)


def test_round_trip(spark):
    big = "<p>é😀</p>" * 200
    rows = [(k, f"http://x/{k}", big if k % 3 == 0 else f"<b>{k}</b>" * (k % 7) * 40, "x") for k in range(60)]
    rows += [(100, None, None, "x"), (101, "u\r\nInjected: 1", "", "x"), (None, "u", big, "x"), (103, "u", "short", "x"), (104, "u", "short", "x"), (57, "again", big, "x")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string").repartition(3)
    got = warc_zip.package_and_read(d, archive_bytes=4000).collect()
    payloads = collections.defaultdict(list)
    for k, _, h, _ in rows:
        if k is not None:
            payloads[(h or "").encode()].append(k)
    want = []
    for k, _, h, _ in rows:
        b = (h or "").encode()
        to = max(payloads[b]) if k is not None and len(b) >= 1000 and max(payloads[b]) != k else None
        want.append((k or -1, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to or -1, b if to is None else b""))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1, bytes(r.payload)) for r in got) == sorted(want)
    assert warc_zip.package_and_read(d.limit(0)).count() == 0


def brute(texts, n):
    data = [(t or "").encode() for t in texts]
    c = collections.Counter(b[k : k + n] for b in data for k in range(len(b) - n + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if c[b[k : k + n]] > 1:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_intervals_expand_to_common_prefixes():
    r = random.Random(2)
    for n in (1, 2, 3, 5, 8):
        for _ in range(40):
            segs = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 6))]
            c = collections.Counter(s[k : k + n] for s in segs for k in range(len(s) - n + 1))
            assert [x.tolist() for x in bwt.repeated_starts(segs, n)] == [[k for k in range(len(s) - n + 1) if c[s[k : k + n]] > 1] for s in segs]


@pytest.mark.parametrize("hot", [bwt_dedup.HOT_SEGMENTS, 1])
def test_repeated_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(bwt, "PIECE", 700)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdeéü ") for _ in range(8))
    passage = "".join(word() for _ in range(60))
    texts = [None, "", "short", passage, passage[100:330], "x" * 199, "y" * 200, "z" * 201, "w" * 1000]
    texts += ["".join(word() for _ in range(20)) + passage[k * 20 : k * 20 + 260] + "".join(word() for _ in range(30)) for k in range(8)]
    base = "".join(word() for _ in range(120))
    texts += [base[:p] + "#" + base[p + 1 :] for p in (5, 300, 301, 700)] + [base, base]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(3, texts[3], "x"), (None, "only here " * 3, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string").repartition(4)
    got = bwt_dedup.remove_repeats(d, hot_segments=hot).collect()
    assert sorted((x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == brute([t for _, t, _ in rows], 200)
    assert all(hashlib.sha256(bytes(x.kept)).hexdigest() == x.kept_sha256 for x in got)


def test_no_text(spark):
    assert bwt_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_enter_blocks_once(spark):
    tail = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(230))
    row = (1, "first " + tail + " end of the first")
    d = spark.createDataFrame([row] * 40 + [(2, "second " + tail + " and then the second")] + [(None, row[1])] * 30, "doc_id long, text string")
    runs = bwt_dedup.window_runs(d, "doc_id", "text", bwt_dedup.LENGTH)
    cut = bwt_dedup._segments(d, runs.distinct(), "doc_id", "text", bwt_dedup.LENGTH)
    assert cut.count() == runs.distinct().count() < runs.count()
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in bwt_dedup.remove_repeats(d).collect()}
    assert got == {(1, len(row[1])): len(row[1]), (None, len(row[1])): len(row[1]), (2, 7 + 230 + 20): 232}
