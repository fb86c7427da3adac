import hashlib

from pyspark.sql import functions as F

from noticeflow.llm import storage, warc

PAGES = [
    (1, "http://a/1", "x" * 100),
    (2, "http://a/2\r\nX: y", "x" * 100),
    (3, None, "x" * 99),
    (4, "http://a/4", "x" * 99),
    (5, "http://a/5", None),
    (6, "http://a/6", ""),
    (7, "http://a/7", "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (8, "http://a/8", "é" * 60 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (9, "http://a/9", "y" * 300_000),
] + [(i, "http://copy", "z" * 500) for i in range(20, 60)]


def want():
    out = {}
    for i, _, html in PAGES:
        body = (html or "").encode()
        first = min(j for j, _, h in PAGES if (h or "").encode() == body)
        again = len(body) >= 100 and first != i
        out[i] = (len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None)
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3).withColumn("_first", F.lit("clash"))
    rows = warc.round_trip(df, storage.new_path(spark, "warc")).collect()
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows} == want()
    assert len(rows) == len(PAGES)


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([(1, "u", "h" * 200), (1, "u", "h" * 200), (None, None, None)], "page_id long, url string, html string")
    assert warc.round_trip(df.limit(0), storage.new_path(spark, "warc")).collect() == []
    rows = warc.round_trip(df, storage.new_path(spark, "warc")).collect()
    assert sorted((r.page_id or 0, r.record_type) for r in rows) == [(0, "response"), (1, "response"), (1, "response")]


def test_pushdown_skips_payloads(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = storage.new_path(spark, "warc")
    warc.write(df, path)
    back = warc.read(spark, path)
    assert back.where("record_type = 'revisit'").count() == 41
    assert back.where("page_id in (7, 9)").select(F.sha2("payload", 256)).count() == 2
    (text,) = [r.payload for r in back.where("page_id = 7").collect()]
    assert text.decode() == PAGES[6][2]
    reader = warc.WarcReader({"path": path})
    left = list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("block_bytes",), 3)]))
    assert reader.wanted == {"record_type": {"revisit"}} and len(left) == 1
    read = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(read) == 41 and all(r["payload"] is None for r in read)
    assert sum(len(p.paths) for p in reader.partitions()) >= 1
    assert warc.read(spark, path, payload=False).where("payload is not null").count() == 0
