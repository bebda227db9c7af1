import gzip
import hashlib

from caselog.llm.queries import WARC_SQL, op5_warc
from caselog.llm.warc import parse, read_records, write_archive


def test_round_trip_and_selection(spark, testdata):
    pages = spark.read.parquet(f"{testdata}/sf0.001/pages.parquet")
    pages = pages.unionByName(pages.selectExpr("page_id + 1000 as page_id", "url", "html"))
    archive = write_archive(pages)
    assert archive.index.columns == ["page_id", "file", "offset", "length", "url", "payload_digest", "record_type"]
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    rows = read_records(archive).collect()
    assert len(rows) == len(html)
    for r in rows:
        assert r.payload_bytes == len(html[r.page_id])
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest()
        first = min(p for p, h in html.items() if h == html[r.page_id]) if len(html[r.page_id]) >= 100 else r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))
        assert r.payload == (bytearray(html[r.page_id]) if r.record_type == "response" else None)
    some = archive.index.filter("page_id % 7 = 0")
    assert {r.page_id for r in read_records(archive, some).collect()} == {p for p in html if p % 7 == 0}


def test_records_stand_alone(spark, testdata):
    archive = write_archive(spark.read.parquet(f"{testdata}/sf0.001/pages.parquet"))
    row = archive.index.orderBy("page_id").first()
    path = f"{archive.folder}/{row.file}".removeprefix("file://")
    with open(path, "rb") as file:
        whole = gzip.decompress(file.read())
        file.seek(row.offset)
        fields, block = parse(file.read(row.length))
    assert whole.startswith(b"WARC/1.1\r\n")
    assert fields["WARC-Target-URI"] == row.url and len(block) == int(fields["Content-Length"])


def test_query_equals_sql(spark, testdata):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{testdata}/sf0.001/pages.parquet'")
    assert sorted(map(tuple, op5_warc(spark, f"{testdata}/sf0.001").collect()), key=str) == \
        sorted(con.execute(WARC_SQL).fetchall(), key=str)


def test_edges(spark):
    long = "x" * 100
    rows = [(1, "http://a", long), (2, "http://b", long), (2, "http://b", long), (None, "http://c", long), (3, None, None),
            (4, "u\r\nv", ""), (5, "", "short"), (6, "d", "short"), (7, "e", "é" * 60), (8, "f", "é" * 60),
            (9, "g", "WARC/1.1\r\n\r\n" * 9)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows],
                                  "page_id long, url string, html string, offset string, payload string")
    found = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in read_records(write_archive(pages)).collect()),
                   key=str)
    assert found == sorted([
        (1, 100, "response", None), (2, 100, "revisit", 1), (2, 100, "revisit", 1), (None, 100, "revisit", 1),
        (3, 0, "response", None), (4, 0, "response", None), (5, 5, "response", None), (6, 5, "response", None),
        (7, 120, "response", None), (8, 120, "revisit", 7), (9, 108, "response", None)], key=str)
    assert read_records(write_archive(pages.limit(0))).collect() == []


def test_reads_take_a_stated_number_of_tasks(spark, testdata, monkeypatch):
    """Adaptive execution does not merge them by the few bytes of the index."""
    from caselog.llm import warc
    archive = write_archive(spark.read.parquet(f"{testdata}/sf0.001/pages.parquet").repartition(4))
    monkeypatch.setattr(warc, "TASK_BYTES", 1000)
    read = read_records(archive)
    size = archive.index.groupBy().sum("length").first()[0]
    assert read.rdd.getNumPartitions() == -(-size // 1000) and read.count() == archive.index.count()


def test_a_very_long_payload(spark):
    pages = spark.createDataFrame([(1, "u", "x" * 3_000_000), (2, None, "x" * 3_000_000), (3, "v", None)], "page_id long, url string, html string")
    rows = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in read_records(write_archive(pages)).collect()}
    assert rows == {1: (3_000_000, "response", None), 2: (3_000_000, "revisit", 1), 3: (0, "response", None)}
