from __future__ import annotations

import base64
import hashlib
import io
import zipfile

import pytest

from gridloom.llm import archives as ar


def brute(rows):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, h in rows:
        p = (h or "").encode()
        f = first.get(h or "")
        again = f is not None and (i is None or i > f) and sum((x or "") == (h or "") for _, x in rows) > 1
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", f if again else None))
    return out


def test_query(spark, sf_dir):
    rows = [(5, "<p>a</p>"), (3, "<p>a</p>"), (9, None), (7, ""), (1, "é" * 100), (None, "<p>a</p>"), (None, "alone"), (3, "<p>a</p>"), (11, "x" * 3_000_000)]
    pages = spark.createDataFrame([(i, f"http://e.x/{i}\r\nX: y" if i != 7 else None, h) for i, h in rows], "page_id long, url string, html string")
    got = ar.op10_warc_zip(spark, sf_dir(pages=pages)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, brute(rows)))


def test_empty(spark, sf_dir):
    assert ar.op10_warc_zip(spark, sf_dir(pages=spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("wide", [False, True, None])
def test_zip_against_the_library(tmp_path, wide):
    members = [("a/b.bin", bytes(range(256)) * 10), ("é.txt", b""), ("c", b"PK\x05\x06 inside")]
    made = ar.write_zip(members, wide)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    path = tmp_path / "x.zip"
    path.write_bytes(made)
    read_at, size = ar.file_reader(str(path))
    assert {n: read_at(*at) for n, at in ar.zip_members(read_at, size).items()} == dict(members)


def test_other_zips(tmp_path):
    path = tmp_path / "y.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one", b"data")
        z.comment = b"a comment with PK\x05\x06 in it, longer than the record it imitates"
    read_at, size = ar.file_reader(str(path))
    at, n = ar.zip_members(read_at, size)["one"]
    assert read_at(at, n) == b"data"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("one", b"data" * 100)
    with pytest.raises(ValueError):
        ar.zip_members(*ar.file_reader(str(path)))
    with pytest.raises(ValueError):
        ar.zip_members(*ar.value_reader(b"no zip"))


def test_records_are_read_by_range(tmp_path):
    p = ar.Package()
    for k in range(20):
        body = f"page {k} ".encode() * 50
        p.add(str(k), ar.record_bytes(k, f"http://x/{k}", body, ar.digest_of(body), None))
    made = p.close(True)
    asked = []

    def read_at(at, n):
        asked.append(n)
        return made[at : at + n]

    got = [(f["warc-record-id"], payload) for f, _, payload in ar.records(read_at, len(made))]
    assert len(got) == 20 and got[7] == ("<urn:page:7>", b"page 7 " * 50) and len(asked) > 20


def test_short_payloads_never_revisit(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in ar.read_packages(ar.write_packages(pages, least=4)).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_packages_as_files_read_by_range(spark, stage, tmp_path):
    """Files in the shared folder give what values give, and a package is never read at once."""
    pages = spark.createDataFrame([(k, f"http://e.x/{k}", f"page {k % 50} " * 400) for k in range(300)], "page_id long, url string, html string")
    clash = pages.selectExpr("*", "'x' AS path", "1 AS told", "2 AS refers_to", "3 AS payload", "4 AS first_id")
    files = ar.store_packages(clash, stage, package_bytes=4000)
    assert files.count() > 1
    got, want = ar.read_packages(files), ar.read_packages(ar.write_packages(clash, package_bytes=4000))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    ar.check_revisits(got)
    read_at, size = ar.file_reader(files.first()["path"], 64)
    assert read_at(0, 4) == b"PK\x03\x04" and read_at(2, 2) == b"\x03\x04" and read_at(size - 22, 4) == b"PK\x05\x06"


def test_a_revisit_that_does_not_fit_is_told(spark):
    rows = [(1, 5, "D", "response", None), (2, 6, "D", "revisit", 1)]
    found = spark.createDataFrame(rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    with pytest.raises(ValueError):
        ar.check_revisits(found)


def test_session_settings_stay(spark, sf_dir):
    """No query leaves other Arrow settings behind."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.sql(f"SET {key}").first()["value"]
    ar.op10_warc_zip(spark, sf_dir(pages=spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))).count()
    assert spark.sql(f"SET {key}").first()["value"] == before


def test_same_as_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    got, want = ar.op10_warc_zip(spark, d), con.sql(ar.OP10_SQL)
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(str, want.select(*order).fetchall()))
