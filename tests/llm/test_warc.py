import base64
import hashlib
import io
import zlib

import pytest

from tracelake.llm import common, warc
from tracelake.llm.common import Workspace
from tracelake.llm.queries import op5_warc

ROWS = [
    (4, "http://a.example/", "<p>é same</p>", 1), (2, "http://b.example/x y\r\nz", "<p>é same</p>", 1), (9, None, "<p>é same</p>", None),
    (1, "http://c.example/", None, 1), (3, "http://c.example/", "", 1), (5, "http://d.example/", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", 1),
    (6, "http://e.example/", "x" * 300_000, 1), (7, "u", "\r\n\r\n", 1), (8, "u", "\x00\x01\n", 1),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, payload_digest int").repartition(3)


def brute(rows):
    first, found = {}, {}
    for page, _, html, *_ in sorted(rows, key=lambda r: r[0]):
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        found[page] = (len(data), digest, "revisit" if data in first else "response", first.get(data))
        first.setdefault(data, page)
    return found


def test_round_trip_equals_brute_force(pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    rows = op5_warc(pages.sparkSession, str(tmp_path)).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == brute(ROWS) and len(rows) == len(ROWS)


def test_transactions_hold_all_three_records(pages):
    work = Workspace(pages.sparkSession, "warc")
    rows = {r["metadata"]["page_id"]: r for r in warc.transactions(warc.write(warc.captures(pages, work), work)).collect()}
    assert len(rows) == len(ROWS)
    for page, url, html, _ in ROWS:
        r = rows[page]
        assert r["request"]["requested"] == r["target_uri"]
        if r["response"]["record_type"] == "response":
            assert bytes(r["response"]["payload"]) == (html or "").encode()
        else:
            first = rows[r["metadata"]["refers_to"]]
            assert r["response"]["refers_to_record"] == first["record_id"] and first["response"]["record_type"] == "response"


def test_small_payloads_stay_responses(pages, workspace):
    kinds = {r["page_id"]: r["refers_to"] for r in warc.captures(pages, workspace, min_revisit_bytes=5).collect()}
    assert kinds[3] is None and kinds[4] == 2


def test_repeated_rows_keep_their_own_records(spark):
    rows = [(1, "u", "x"), (1, "u", "x"), (2, "u", "x"), (None, "u", "x")]
    work = Workspace(spark, "warc")
    found = warc.transactions(warc.write(warc.captures(spark.createDataFrame(rows, "page_id long, url string, html string"), work), work)).collect()
    assert sorted((r["metadata"]["page_id"] or 0, r["response"]["record_type"]) for r in found) == [(0, "revisit"), (1, "response"), (1, "response"), (2, "revisit")]


def test_no_rows(spark, workspace):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.transactions(warc.write(warc.captures(none, workspace), workspace)).count() == 0


def test_records_are_gzip_members_and_archives_are_bounded(pages, workspace, monkeypatch):
    """Any record can be read from its own offset; archives close beyond a size; large ones are read in pieces."""
    monkeypatch.setattr(warc, "READ_BYTES", 7)
    data = [x for _, x in warc.transaction(4, "u", b"abc" * 50, None, "<urn:uuid:1>", None)]
    headers, block = next(warc.parse(zlib.decompress(data[1], 31)))
    assert headers["warc-type"] == "request" and headers["warc-concurrent-to"] == "<urn:uuid:1>" and block.startswith(b"GET u ")
    assert [next(warc.parse(m))[0]["warc-type"] for m in warc.members(io.BytesIO(b"".join(data)))] == ["response", "request", "metadata"]
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[0][:-3])))
    manifest = warc.write(warc.captures(pages, workspace), workspace)
    assert {r["kind"]: r["n"] for r in manifest.groupBy("kind").sum("records").withColumnRenamed("sum(records)", "n").collect()} == dict.fromkeys(("main", "request", "metadata"), len(ROWS))


def test_far_side_of_the_size_guard(pages, workspace, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    found = {r["page_id"]: r["refers_to"] for r in warc.captures(pages, workspace).collect()}
    assert found == {page: refers for page, (*_, refers) in brute(ROWS).items()}
