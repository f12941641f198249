"""WARC packages: round trips, ZIP and ZIP64 directories, range reads, damaged and foreign packages."""
import base64
import gzip
import hashlib
import io
import json
import os
import random
import zipfile

import pytest

from threadlens.llm import archives as A

PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def brute(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by the rule, row by row."""
    out = []
    for key, _, html in rows:
        html = html or ""
        same = [k for k, _, h in rows if (h or "") == html and k is not None]
        owner = min(same) if same and len(html.encode()) >= least else None
        other = owner is not None and owner != key
        out.append((key, len(html.encode()), sha(html), "revisit" if other else "response", owner if other else None))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    shared = "<p>" + "x" * 3000 + "</p>"
    rows = [(i, f"http://h{i % 7}.example.com/p/{i}?q=ä b\r\n", "".join(rng.choice("ab é語\r\n\r\n") for _ in range(rng.randint(0, 400))))
            for i in range(60)]
    rows += [(100 + i, None, shared) for i in range(40)]
    rows += [(200, "u", None), (201, "u", ""), (None, "u", shared), (None, "u", "only a null id"), (202, "u", "twice"), (202, "u", "twice"),
             (203, "u", "twice"), (204, "", "WARC/1.1\r\n\r\n"), (205, "u", "y" * 300_000), (-5, "u", "negative")]
    return rows


@pytest.fixture(scope="module")
def pages(spark, rows):
    from pyspark.sql import functions as F
    from threadlens.session import ship_package

    ship_package(spark)
    df = spark.createDataFrame(rows, PAGES).repartition(3)
    return df.select("*", *(F.lit("z").alias(c) for c in ("payload", "sha1", "owner", "archive", "record_type", "refers_to")))


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip_is_the_rule(pages, rows, least):
    got = [tuple(r) for r in A.round_trip(pages, min_payload=least).collect()]
    assert sorted(got, key=repr) == brute(rows, least)


def test_text_ids_and_empty_table(spark, pages):
    named = spark.createDataFrame([("a b+c/é>", "u", "t"), ("", "u", "t"), (None, "u", "t")], "page_id string, url string, html string")
    got = sorted((tuple(r) for r in A.round_trip(named).collect()), key=repr)
    assert [(r[0], r[3], r[4]) for r in got] == [("", "response", None), ("a b+c/é>", "revisit", ""), (None, "revisit", "")]
    assert A.round_trip(pages.limit(0)).collect() == []


def test_payloads_small_packages_and_filtered_index(pages, rows):
    packages = A.write_archives(pages, archive_bytes=4_000)
    made = packages.collect()
    assert len(made) > 3 and sum(r["n_records"] for r in made) == len(rows)
    index = A.read_index(packages).cache()
    assert index.count() == len(rows)
    records = A.read_records(index, read_bytes=2_000).collect()
    assert all(r["digest_ok"] for r in records if r["record_type"] == "response")
    told = {(A.urn_key(r["record_id"]), r["payload"].decode()) for r in records if r["payload"] is not None}
    assert {(None if k is None else str(k), h or "") for k, _, h in rows} >= told
    assert {(str(k), h) for k, _, h in rows if k in range(60)} <= told
    some = A.read_records(index.where("url LIKE '%/p/17?%'")).collect()
    assert [A.urn_key(r["record_id"]) for r in some] == ["17"]
    assert some[0]["target_uri"].startswith("http://h3.example.com/p/17?q=%C3%A4%20b")


def package_bytes(raw):
    return A.Package(lambda at, n: raw[at:at + n], len(raw))


def stored(raw, package):
    return {m.name: raw[package.data(m):package.data(m) + m.packed] for m in package.members()}


def test_directory_zip_zip64_comment_and_prefix(monkeypatch):
    def build(n, comment=b"", big=False):
        if big:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for i in range(n):
                z.writestr(f"d/{i}é", f"content {i} " * (i % 5 + 1))
            z.comment = comment
        monkeypatch.undo()
        return out.getvalue()

    for raw in (build(7), build(7, b"a comment"), build(7, big=True), build(0), build(70_000)):
        known = zipfile.ZipFile(io.BytesIO(raw))
        want = {n: known.read(n) for n in known.namelist()[:200]}
        got = stored(raw, package_bytes(raw))
        assert {k: got[k] for k in want} == want and len(got) == len(known.namelist())
    # A comment that looks like an end record, which the standard library takes for one.
    raw = build(7, b"a comment PK\x05\x06 with a signature" + b"x" * 40)
    assert stored(raw, package_bytes(raw)) == stored(build(7), package_bytes(build(7)))
    for raw in (build(7), build(7, big=True)):
        shifted = b"#!/bin/sh\n" * 30 + raw
        assert stored(shifted, package_bytes(shifted)) == stored(raw, package_bytes(raw))


def test_refuses_what_cannot_be_read_by_range(tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.warc", "x" * 100)
    raw = out.getvalue()
    package = package_bytes(raw)
    with pytest.raises(ValueError, match="compressed"):
        package.data(next(package.members()))
    for damaged in (b"", b"nothing", raw[:-10], raw[:40] + raw[60:]):
        with pytest.raises(ValueError):
            list(package_bytes(damaged).members())
    with pytest.raises(ValueError):
        A.parse_record(b"HTTP/1.1 200 OK\r\n\r\n")
    with pytest.raises(ValueError):
        A.parse_record(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 10\r\n\r\nshort")


@pytest.mark.parametrize("kind", ["gzip index", "no index", "plain", "no index, plain"])
def test_foreign_packages(spark, tmp_path, kind):
    texts = [f"payload {i} " * (i + 1) for i in range(20)]
    plain = "plain" in kind
    name = "archive/x.warc" if plain else "archive/x.warc.gz"
    body, lines = b"", []
    for i, t in enumerate(texts):
        raw = A.page_record(i, f"http://a/{i}", t.encode(), sha(t), None, "2020-01-01T00:00:00Z")
        raw = raw if plain else gzip.compress(raw)
        lines.append(f"a)/{i} 2020 " + json.dumps({"url": f"http://a/{i}", "offset": str(len(body)), "length": str(len(raw)),
                                                     "filename": name.split("/")[1], "digest": "sha1:" + sha(t)}))
        body += raw
    path = str(tmp_path / "x.wacz")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        z.writestr(name, body)
        z.writestr("pages/pages.jsonl", "{}", compress_type=zipfile.ZIP_DEFLATED)
        if not kind.startswith("no"):
            z.writestr("indexes/index.cdx.gz", b"".join(gzip.compress(("\n".join(lines[i:i + 7]) + "\n").encode()) for i in range(0, 20, 7)))
    table = spark.createDataFrame([(path,), (None,)], "archive string")
    got = A.read_records(A.read_index(table)).collect()
    assert sorted(r["payload"].decode() for r in got) == sorted(texts)
    assert all(r["digest_ok"] and r["payload_digest"] == sha(r["payload"].decode()) for r in got)


def test_one_attempt_counts(pages, tmp_path):
    folder = str(tmp_path / "out")
    first = A.write_archives(pages, folder)
    A.write_archives(pages, folder)         # as an attempt that was repeated would: other files, in no table of the first
    assert len(os.listdir(folder)) == 2 * first.count()
    assert A.read_index(first).count() == pages.count()
