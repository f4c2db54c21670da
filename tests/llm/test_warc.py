import hashlib

import pytest

from broadloom.llm import warc
from broadloom.session import new_path

FORGED = "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nwrong\r\n\r\n"


def expected(rows):
    first = {}
    for i, _, p in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        if len((p or "").encode()) >= 100:
            first.setdefault(p, i)
    out = []
    for i, _, p in rows:
        b = (p or "").encode()
        f = first.get(p)
        again = f is not None and f != i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


PAGES = [
    (1, "http://a/", "x" * 150), (2, "http://b/WARC/1.0", "x" * 150), (3, None, None), (4, "http://c/\r\nWARC/1.0\r\n", ""),
    (5, "http://d/", "before" + FORGED + "after" * 40), (6, "http://e/", "WARC/1.0\r\n" + FORGED * 3), (None, "http://f/", "x" * 150),
    (7, "http://g/", "é€\r\n\r\n" * 50), (8, "http://h/", "short"), (9, "http://i/", "short"), (10, "http://j/", FORGED * 400),
    (11, "http://k/", "x" * 150), (12, "http://l/", "y" * 5000 + "\r\n\r\n"), (12, "http://l/", "y" * 5000 + "\r\n\r\n"), (13, "", FORGED * 400),
]


@pytest.mark.parametrize("split", ["128m", "3k", "700"])
def test_round_trip_with_marks_in_payloads(spark, split):
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "64")
    try:
        df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").coalesce(1)
        got = sorted((tuple(r) for r in warc.archive_round_trip(df).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(PAGES)


def test_empty_table_and_extra_columns(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, file string, value string")
    assert warc.archive_round_trip(df).collect() == []


def test_file_that_does_not_begin_with_a_record(spark):
    path = new_path(spark, "raw")
    spark.createDataFrame([("junk" + FORGED,)], "value string").coalesce(1).write.text(path)
    assert warc.read_warc(spark, path).collect() == []


def test_cut_off_record_is_kept_without_digest(spark):
    path = new_path(spark, "raw")
    spark.createDataFrame([("WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 999\r\n\r\nabc",)], "value string").coalesce(1).write.text(path)
    rows = warc.read_warc(spark, path).collect()
    assert [(r.offset, r.payload_digest) for r in rows] == [(0, None)]
