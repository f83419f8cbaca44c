"""WARC archives: exact round trip, revisits, pushed filters and skipped payloads."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import warc

SCHEMA = "page_id long, url string, html string, payload int"
ROWS = [
    (1, "http://a/1", "<p>é</p>", 1), (2, "http://a/2", "<p>é</p>", 1), (3, None, None, None), (4, "http://b/4", "", 1), (0, "http://b/x\r\ny", "\r\n\r\nWARC/1.1\r\n\r\n", 1),
    (9, "http://b/9", "x" * 3_000_000, 1), (8, "http://b/8", "x" * 3_000_000, 1), (None, "http://n", "<p>é</p>", 1), (None, "http://n", "alone", 1),
]


def expected(least=0):
    out = []
    for page, _, html, _ in ROWS:
        body = (html or "").encode()
        same = [p for p, _, h, _ in ROWS if (h or "").encode() == body and p is not None]
        first = min(same) if same and len(body) >= least else page
        again = first != page
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("level,least", [(0, 0), (3, 0), (3, 8)])
def test_round_trip(spark, tmp_path, level, least):
    path = f"file://{tmp_path}/a"
    warc.write_pages(spark.createDataFrame(ROWS, SCHEMA).repartition(3), path, least, level)
    for payload in ("keep", "verify", "skip"):
        rows = warc.read(spark, path, payload).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to_page) for r in rows), key=repr) == expected(least)
    kept = {r.page_id: bytes(r.payload) for r in warc.read(spark, path).where("record_type = 'response' and page_id is not null").collect()}
    assert kept == {p: (h or "").encode() for p, _, h, _ in ROWS if p is not None and p in kept}
    ids = {r.page_id: r.record_id for r in rows}
    assert all(r.refers_to == ids[r.refers_to_page] for r in rows if r.record_type == "revisit")


def test_filters_are_pushed(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_pages(spark.createDataFrame(ROWS, SCHEMA), path)
    found = warc.read(spark, path, "skip").where((F.col("record_type") == "revisit") & F.col("target_uri").startswith("http://a"))
    assert [r.page_id for r in found.collect()] == [2]
    reader = warc.WarcReader({"path": path})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("page_id",), (2, 3)), GreaterThan(("payload_bytes",), 3)]))
    assert len(left) == 1 and len(reader.tests) == 2


def test_foreign_gzip_members_and_damage(spark, tmp_path):
    data = [warc.record(i, f"http://c/{i}", b"body %d" % i * 5000, "response", None) for i in range(3)]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(map(gzip.compress, data)))
    for payload in ("skip", "verify"):
        assert sorted(r.page_id for r in warc.read(spark, f"file://{tmp_path}", payload).collect()) == [0, 1, 2]
    (tmp_path / "x.warc.gz").unlink()
    (tmp_path / "y.warc").write_bytes(data[0].replace(b"body 0body", b"body 1body", 1))
    with pytest.raises(Exception, match="digest"):
        warc.read(spark, f"file://{tmp_path}", "verify").collect()


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/e"
    warc.write_pages(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0


def test_nulls_in_pushed_values_equal_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    warc.write_pages(spark.createDataFrame(ROWS, SCHEMA), path)
    read = warc.read(spark, path, "skip")
    assert [r.page_id for r in read.where("page_id in (1, null)").collect()] == [1]
    assert read.where("page_id = cast(null as long)").count() == 0
    assert read.where("page_id <=> cast(null as long)").count() == 2
    ids = [r.record_id for r in read.collect()]
    assert len(set(ids)) == len(ids)
