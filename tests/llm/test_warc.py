import gzip
import hashlib
import io

import duckdb
import pytest

from lattica.llm.common import new_path
from lattica.llm.warc import OP10_SQL, make_record, mark_revisits, op10_warc, read_archives, read_records, write_archives

DATE = "2024-01-01T00:00:00Z"


def records(*payloads):
    return b"".join(make_record(i, f"http://x/{i}", p, None, False, DATE) for i, p in enumerate(payloads))


def test_sequential_reader():
    payloads = [b"", b"a" * 300_000, b"line\r\n\r\nline", bytes(range(256)) * 50]
    data = records(*payloads)
    for step in (1 << 16, 7):
        stream = io.BytesIO(data)
        read = lambda n: stream.read(min(n, step))  # noqa: B023, E731
        found = list(read_records(read))
        assert [r.payload for r in found] == payloads
        assert [r.headers["X-Page-ID"] for r in found] == ["0", "1", "2", "3"]


def test_members_are_plain_gzip():
    text = gzip.decompress(records(b"one", b"two"))
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"two\r\n\r\n")


def test_faults_are_found():
    data = records(b"payload of one record")
    plain = gzip.decompress(data)
    for broken in (data[:-9], gzip.compress(plain.replace(b"payload of", b"Payload of")), gzip.compress(plain[:-3]), gzip.compress(b"not WARC" + plain), gzip.compress(b"no end of header")):
        with pytest.raises((EOFError, ValueError)):
            list(read_records(io.BytesIO(broken).read))


@pytest.fixture(scope="module")
def pages(spark):
    same, other = "s" * 100, "t" * 500
    rows = [(i, f"http://x/{i}", f"page {i} " * (i % 50), 0) for i in range(80)]
    rows += [(201, "u", same, 0), (200, "u", same, 0), (202, None, same, 0), (None, "u", same, 0), (200, "u", same, 0), (None, "u", other, 0), (None, "u", other, 0)]
    rows += [(300, "a\r\nb", None, 0), (301, "u", "", 0), (302, "u", "é" * 50, 0), (303, "u", "é" * 50, 0), (304, "u", "é" * 49, 0), (305, "u", "é" * 49, 0), (306, "u", "x" * 2_000_000, 0)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, digest int")


def test_round_trip(spark, pages):
    path = new_path(spark, "warc-test")
    manifest = write_archives(mark_revisits(pages), path, file_bytes=2000)
    found = read_archives(manifest, path).collect()
    assert manifest.count() > 4 and len(found) == pages.count()
    expected = sorted(((r["page_id"], len(b), hashlib.sha256(b).hexdigest()) for r in pages.collect() for b in [(r["html"] or "").encode()]), key=repr)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found), key=repr) == expected
    kinds = {}
    for r in found:
        kinds.setdefault(r["page_id"], []).append((r["record_type"], r["refers_to"]))
    assert kinds[200] == [("response", None)] * 2 and kinds[201] == kinds[202] == [("revisit", 200)]
    assert sorted(kinds[None], key=repr) == [("response", None), ("response", None), ("revisit", 200)]
    assert kinds[302] == [("response", None)] and kinds[303] == [("revisit", 302)] and kinds[305] == [("response", None)]
    assert [r["url"] for r in found if r["page_id"] == 300] == ["a b"]


def test_empty_table(spark, pages):
    path = new_path(spark, "warc-test")
    assert read_archives(write_archives(mark_revisits(pages.where("page_id < 0")), path), path).count() == 0


def test_query(spark, sf_dir):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, op10_warc(spark, sf_dir).select(*columns).collect())) == sorted(db.sql(f"SELECT {', '.join(columns)} FROM ({OP10_SQL})").fetchall())
