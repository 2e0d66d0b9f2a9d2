"""Round trips, and damaged archives."""

import glob
import gzip
import hashlib
import os

import pytest

from labelquarry.llm import warc_segments as warc


def pages(spark):
    body = "<p>ä€🙂 text</p>\r\n\r\nWARC/1.1\r\n" * 60
    rows = [
        (1, "http://a/1", body, "x"), (2, "http://a/2", body, "x"), (9, "http://a/9", body, "x"), (3, "http://a/3", "short", "x"), (4, None, "short", "x"),
        (5, "http://a/5", None, "x"), (6, "http://a/\r\nX: y", "", "x"), (7, "http://a/7", "long ü" * 40000, "x"), (None, "http://a/n", "y" * 2000, "x"),
        (8, "http://a/8", "rep" * 500, "x"), (8, "http://a/8", "rep" * 500, "x"),
    ]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(3)


def expected(rows):
    out = []
    for page, _, html, _ in rows:
        payload = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == payload and r[0] is not None]
        lead = max(same) if same and len(payload) >= 1000 else None
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if lead not in (None, page) else "response", lead if lead != page else None))
    return out


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_archives(df, f"{tmp_path}/w", segment=3000, chunk=700, records=4)
    got = warc.read_pages(spark, f"{tmp_path}/w", payloads=True).collect()
    assert len(got) == len(rows) and {r.status for r in got} == {"ok"}
    key = lambda r: str(r)
    want = expected(rows)
    want[-1] = (8, *want[-1][1:3], "revisit", 8)  # of the repeated row one refers to the other
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got], key=key) == sorted(want, key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    assert any(r.page_id == 7 and r.payload.decode() == "long ü" * 40000 for r in got)


def records_of(folder):
    return [r for f in sorted(glob.glob(f"{folder}/*.gz")) for r in warc.parse_records(gzip.open(f).read())]


def test_archives_are_cut_into_records(spark, tmp_path):
    _, df = pages(spark)
    warc.write_archives(df, f"{tmp_path}/w", segment=3000, chunk=700, records=4)
    records = records_of(f"{tmp_path}/w")
    assert max(len(b) for _, b in records) <= 3000
    last = [f for f, _ in records if b"warc-segment-total-length" in f]
    assert last and all(f[b"warc-type"] == b"continuation" for f in last)
    assert all(len(gzip.open(f).read()) < 5 * 4000 for f in glob.glob(f"{tmp_path}/w/*.gz"))


@pytest.mark.parametrize("damage", ["missing", "length", "framing", "digest"])
def test_damage_is_told(spark, tmp_path, damage):
    payload = b"0123456789" * 500
    made = warc.page_records(1, 0, "http://a", payload, None, 1500, 400)
    assert len(made) == 4
    if damage == "missing":
        del made[1]
    if damage == "length":
        made[-1] = made[-1].replace(b"Total-Length: ", b"Total-Length: 1")
    if damage == "framing":
        made[0] = made[0].replace(b"\r\n190\r\n", b"\r\n19z\r\n", 1)
    if damage == "digest":
        made[1] = made[1].replace(b"0123", b"0124", 1)
    os.mkdir(f"{tmp_path}/d")
    with open(f"{tmp_path}/d/a.warc", "wb") as file:
        file.write(b"".join(r + b"\r\n\r\n" for r in reversed(made)))
    (row,) = warc.read_pages(spark, f"{tmp_path}/d").collect()
    assert (row.page_id, row.status) == (1, {"missing": "incomplete", "length": "incomplete"}.get(damage, damage))


def test_orphans_and_empty_tables(spark, tmp_path):
    os.mkdir(f"{tmp_path}/o")
    with open(f"{tmp_path}/o/a.warc", "wb") as file:
        file.write(warc.page_records(1, 0, None, b"", (5, 5), 1000, 100)[0] + b"\r\n\r\n")
    (row,) = warc.read_pages(spark, f"{tmp_path}/o").collect()
    assert (row.record_type, row.status, row.payload_bytes) == ("revisit", "orphan", None)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archives(none, f"{tmp_path}/e")
    assert warc.read_pages(spark, f"{tmp_path}/e").count() == 0
