"""Archives and their index: round trips, searches, odd pages."""

import hashlib

import pytest

import compare
from answergauge.llm import capture_index as ci
from answergauge.llm import queries
from answergauge.operators.layout import shared_path

FOLDER = "/root/testdata/sf0.001"
GAP = "\r\n\r\n"


def test_query_equals_sql(spark):
    con = compare.connect(FOLDER)
    assert compare.difference(queries.op9_capture_index(spark, FOLDER), con, queries.OP9_SQL) is None


@pytest.mark.parametrize(
    "url, key",
    [
        ("http://www.Example.com/a/b?c=d#e", "com,example,www)/a/b?c=d"),
        ("https://user:pw@example.com:8080", "com,example:8080)/"),
        ("https://example.com:443/x", "com,example)/x"),
        ("example.org?q", "org,example)/?q"),
        ("", ""),
        (None, ""),
        ("#top", ""),
        ("/only/path", ")/only/path"),
    ],
)
def test_keys(url, key):
    assert ci.surt(url) == key


def pages():
    long, other = "p" * 150 + "é", f"q{GAP}WARC/1.1\r\nContent-Length: 5{GAP}" * 5
    rows = [(5, "http://b.com/", long), (2, "http://b.com/", long), (9, "http://a.com/x\r\ny", long), (7, None, other)]
    rows += [(8, "http://a.com/x", other), (1, "http://c.com", "short"), (3, "http://c.com", "short"), (4, "d.com", None)]
    rows += [(6, "d.com", ""), (None, "e.com", long), (2, "http://b.com/", long), (10, "f.com", "x" * 100), (11, "f.com", "x" * 100)]
    rows += [(20 + i, "http://hot.com/", f"page {i}" * 30) for i in range(50)]
    return rows


def want(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(i, first.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        f = first.get(html) if i is not None else None
        again = f is not None and i != f
        out.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", f if again else None))
    return sorted(out, key=repr)


def figures(df):
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted(((str(r[columns[0]]), *(r[c] for c in columns[1:])) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def archive(spark):
    table = spark.createDataFrame([(*r, "x") for r in pages()], "page_id long, url string, html string, payload_digest string")
    folder = shared_path(spark)
    ci.write_archives(ci.with_revisits(table), folder)
    return table, ci.build_index(spark, folder, block_lines=4)


def test_all_pages_come_back(archive):
    table, index = archive
    assert figures(index.fetch(index.lookup(ci.keys_of(table)))) == want(pages())


def test_reading_whole_archives_gives_the_same(archive):
    table, index = archive
    assert figures(index._fetch_whole(index.lookup(ci.keys_of(table)))) == want(pages())


def test_lookups(spark, archive):
    _, index = archive
    keys = spark.createDataFrame([("com,b)/",), ("com,hot)/",), ("com,none)/",), ("zz",), ("",), (None,)], "key string")
    found = index.lookup(keys).groupBy("key").count().collect()
    assert {r["key"]: r["count"] for r in found} == {"com,b)/": 3, "com,hot)/": 50, "": 1}
    assert index.blocks.count() > 10


def test_payloads_and_urls(archive):
    table, index = archive
    rows = index.fetch(index.lookup(ci.keys_of(table))).collect()
    html = {r[0]: r[2] or "" for r in pages()}
    stored = [r for r in rows if r["record_type"] == "response"]
    assert all(r["payload"] == html[r["page_id"]] for r in stored)
    assert {r["url"] for r in rows if r["page_id"] in (9, 7)} == {"http://a.com/x%0D%0Ay", None}


def test_files_are_plain_warc(spark, archive):
    _, index = archive
    files = spark.read.format("binaryFile").load(index.folder).collect()
    records = [(f["content"], *r) for f in files for r in ci.records_of(bytes(f["content"]))]
    assert len(records) == len(pages())
    for content, offset, length, fields in records:
        record = bytes(content[offset : offset + length])
        assert record.startswith(b"WARC/1.1\r\n") and bytes(content[offset + length :]).startswith(b"\r\n\r\n")
        assert len(record.partition(b"\r\n\r\n")[2]) == int(fields["Content-Length"])


def test_empty_table(spark):
    table = spark.createDataFrame([], "page_id long, url string, html string")
    assert ci.archive_and_read(table).count() == 0
