"""Coordinates against bytes, and preflight of a harvest."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from brindle.operators import harvest as hv
from brindle.sources import ranges as rg

RANGE = "path string, start long, length long, sha256 string"
sha = lambda b: hashlib.sha256(b).hexdigest()


def test_packed_texts_are_where_their_coordinates_say(spark, tmp_path):
    texts = ["", "a", "é\nü", "x" * 5000, None, "same", "same", "\n", " 日本 ", "\r\n"] * 3
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "k long, text string")
    got = rg.pack(df, "k", "text", str(tmp_path / "pack"), file_bytes=4000)
    rows = got.collect()
    assert len({r.path for r in rows}) > 1
    read = sorted((r.k, open(r.path.removeprefix("file:"), "rb").read()[r.start : r.start + r.length].decode()) for r in rows)
    assert read == sorted((i // 2, t or "") for i, t in enumerate(texts))
    spans = sorted((r.path, r.start, r.length) for r in rows)
    assert all(a[0] != b[0] or a[1] + a[2] + 1 == b[1] for a, b in zip(spans, spans[1:]))
    assert {r.status for r in rg.check_ranges(got, stretch=100).collect()} == {"ok"}
    assert rg.pack(df.where("false"), "k", "text", str(tmp_path / "none")).count() == 0


def test_ranges_that_do_not_hold(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rg, "PIECE", 3)
    data = bytes(range(200))
    (at := tmp_path / "a file.bin").write_bytes(data)
    path = f"file:{at}"
    cases = [
        ((path, 10, 20, sha(data[10:30])), "ok", 0), ((path, 11, 20, sha(data[10:30])), "shifted", -1), ((path, 8, 20, sha(data[10:30])), "shifted", 2),
        ((path, 6, 20, sha(data[10:30])), "changed", None), ((path, 190, 20, sha(b"")), "beyond", None), ((path, 182, 20, sha(data[180:])), "shifted", -2),
        ((path, 200, 0, sha(b"")), "ok", 0), ((path, 201, 0, sha(b"")), "shifted", -1), ((path, 0, None, sha(data)), "ok", 0), ((path, 5, 5, None), "ok", 0),
        ((path, None, 5, sha(b"")), "invalid", None), ((path, -1, 5, sha(b"")), "invalid", None), ((path, 5, -5, sha(b"")), "invalid", None),
        ((path + "x", 0, 5, sha(b"")), "no_file", None), ((None, 0, 5, sha(b"")), "no_file", None), ((str(at), 10, 20, sha(data[10:30])), "ok", 0),
    ] * 2
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, " + RANGE)
    for stretch in (7, 1 << 30):
        got = rg.check_ranges(df, near=2, stretch=stretch).orderBy("i").collect()
        assert [(r.status, r["shift"]) for r in got] == [c[1:] for c in cases]
    assert rg.check_ranges(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        rg.check_ranges(df.withColumn("status", F.lit(1)))


def test_preflight(spark, tmp_path):
    body = {n: (n * 9).encode() for n in "abcdefgh"}
    for n, b in body.items():
        (tmp_path / n).write_bytes(b)
    p = lambda n: f"file:{tmp_path / n}"
    row = lambda n, url="u", digest=None, size=9, label="1", own="1", captured=None: (p(n), url, digest or sha(body.get(n, b"")), size, label, own, captured)
    entries = [
        row("a"), row("a", label="TITLE 1", captured="c1"), row("b"), row("b", url="v"), row("c", captured="x"), row("c", captured="y"), row("d", label="2"), row("d", label="3"),
        row("e", size=8), row("e", size=8), row("f", digest=sha(b"?")), row("gone"), row("g", label="2"), row("h", url=None), row("h", url=None),
    ]
    chunks = [(p("a"), 2, 3, sha(b"aaa")), (p("a"), 0, 0, sha(b"")), (p("g"), 0, 10, sha(b"")), (p("g"), 2, 3, sha(b"bad")), (p("stray"), 0, 1, sha(b"s")), (p("h"), None, 1, sha(b"h"))]
    e = spark.createDataFrame(entries, "path string, source_url string, sha256 string, n_bytes long, section_label string, rendered_label string, capture_sha256 string")
    files = hv.preflight(e, spark.createDataFrame(chunks, RANGE))
    got = {r.path.rsplit("/", 1)[1]: (r.entries, r.chunks, r.verified_bytes, r.failures) for r in files.collect()}
    assert got == {
        "a": (2, 2, 9, []), "b": (2, 0, 9, ["fields"]), "c": (2, 0, 9, ["captures"]), "d": (2, 0, 9, ["label"]), "e": (2, 0, None, ["bytes"]), "f": (1, 0, 9, ["digest"]),
        "gone": (1, 0, None, ["no_file"]), "stray": (0, 1, None, ["no_file", "no_entry"]), "g": (1, 2, 9, ["chunk_changed", "chunk_beyond"]), "h": (2, 1, 9, ["chunk_invalid"]),
    }
    proof = hv.preflight_proof(files).first()
    assert (proof.entries, proof.files, proof.files_verified, proof.bytes_verified, proof.passed) == (15, 10, 1, 9, False)
    none = hv.preflight_proof(hv.preflight(e.where("false"), spark.createDataFrame([], RANGE))).first()
    assert (none.files, none.chunks, none.passed) == (0, 0, True)
