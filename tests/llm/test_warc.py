"""WARC bundles: format, round trip, index, revisits."""

import base64
import hashlib
import io

import pytest
import zstandard
from pyspark.sql import functions as F

from dosewise.llm import warc
from dosewise.llm.queries import QUERIES
from dosewise.session import scratch_dir

SF = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, record_type string, sha1 string"


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(rows, least=0):
    """page, bytes, digest, type and page referred to, by comparing payloads."""
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        first = min(same, default=None)
        alone = sum((h or "") == (html or "") for _, _, h, *_ in rows) < 2 or len(data) < least
        again = not alone and first is not None and page != first
        out.append((page, len(data), digest(data), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def got(df):
    rows = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    return sorted((tuple(r) for r in rows), key=repr)


ROWS = [
    (1, "http://a/x y", "same ü", "x", "x"), (2, "http://b/\r\nWARC-Type: no", "same ü", None, None), (3, None, "same ü", "x", "x"),
    (4, "u", None, "x", "x"), (5, "u", "", "x", "x"), (6, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x", "x"),
    (7, "u", "long " * 600_000, "x", "x"), (None, "u", "same ü", "x", "x"), (None, None, "no id", "x", "x"), (None, None, "no id", "x", "x"),
    (9, "u", "twice", "x", "x"), (9, "u", "twice", "x", "x"), (10, "u", "twice", "x", "x"), (11, "u", "\0\x1f", "x", "x"),
]


@pytest.mark.parametrize("least", [0, 6])
def test_round_trip(spark, least):
    path = scratch_dir(spark)
    warc.write_bundles(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, least_bytes=least)
    records = warc.read_bundles(spark, path)
    assert got(records) == expected(ROWS, least)
    kept = records.where("record_type = 'response'").select("page_id", "payload").collect()
    want = {(p, (h or "").encode()) for p, _, h, *_ in ROWS}
    assert {(r[0], bytes(r[1])) for r in kept} <= want
    assert {bytes(r[1]) for r in kept} == {x for _, x in want}  # no payload is lost
    assert all(r["payload"] is None for r in records.where("record_type = 'revisit'").collect())
    urls = {r["page_id"]: r["url"] for r in records.where("page_id in (1, 2, 3)").collect()}
    assert urls == {1: "http://a/x%20y", 2: "http://b/%0D%0AWARC-Type:%20no", 3: None}


def test_bundles_are_plain_zstandard_and_the_index_points_into_frames(spark, monkeypatch):
    path = scratch_dir(spark)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_bundles(pages, path)
    rows = warc.index(spark, path).collect()
    assert len(rows) == pages.count()
    fs, folder = warc.file_system(warc.full_uri(spark, f"{path}/bundles"))
    for name in {r["bundle"] for r in rows}:
        with fs.open_input_file(f"{folder}/{name}") as f:
            frames = warc.seek_table(f)
            parts = [warc.read_frame(f, x) for x in frames]
            f.seek(0)
            # a reader without the footer sees the frames one after the other
            whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
        assert whole == b"".join(parts)
        assert warc.parse(parts[0])[0].fields["WARC-Type"] == "warcinfo"
        for r in rows:
            if r["bundle"] == name:
                one, after = warc.parse(parts[r["frame"]], r["offset"])
                assert one.fields["WARC-Record-ID"] == r["record_id"] and after - r["offset"] == r["length"]
                assert one.fields.get("Page-ID") == str(r["page_id"])


def test_records_are_found_by_page(spark):
    path = scratch_dir(spark)
    warc.write_bundles(spark.createDataFrame(ROWS, SCHEMA), path)
    wanted = spark.createDataFrame([(7,), (1,), (1,), (99,)], "page_id long")
    found = {r["page_id"]: bytes(r["payload"]) for r in warc.find_records(spark, path, wanted).collect()}
    assert found == {1: "same ü".encode(), 7: b"long " * 600_000}


def test_frames_and_offsets():
    out = io.BytesIO()
    out.close = lambda: None
    writer = warc.BundleWriter(out)
    records = [bytes([65 + i]) * n for i, n in enumerate((10, warc.FRAME, 3, 4, 2 * warc.FRAME))]
    places = [writer.add(r) for r in records]
    writer.close()
    assert places == [(0, 0), (1, 0), (2, 0), (2, 3), (3, 0)]
    frames = warc.seek_table(out)
    assert [f.size for f in frames] == [10, warc.FRAME, 7, 2 * warc.FRAME]
    assert warc.read_frame(out, frames[2])[3:] == records[3]
    torn = io.BytesIO(out.getvalue().replace(out.getvalue()[frames[0].start + 8 : frames[0].start + 12], b"????", 1))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.read_frame(torn, frames[0])


def test_empty_table(spark):
    path = scratch_dir(spark)
    warc.write_bundles(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_bundles(spark, path).count() == 0
    assert warc.find_records(spark, path, spark.createDataFrame([(1,)], "page_id long")).count() == 0


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    df = QUERIES["op11_warc"](spark, SF)
    assert dict(df.dtypes)["payload_bytes"] == "bigint" and df.where(F.col("record_type") == "x").isEmpty()
    assert got(df) == expected(rows)
