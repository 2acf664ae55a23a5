import gzip
import hashlib
import zlib
from base64 import b32encode

from pyspark.sql import functions as F

from treelens.llm import warc

PAGE = """<!DOCTYPE html><html><head><meta charset="utf-8"><title> A &amp; B </title><style>p{}</style>
<script>var t="</p><a href='/no'>";</script></head><body><!-- <p>gone</p> --><h1>Head</h1><p>One <b>two</b>
three<br>four &lt;5<a href="/x?a=1&amp;b=2">link</a> <a href='http://other.org/'>o</a></p>3 < 4<div>last"""


def test_text_title_and_links():
    text, title, links = warc.html_text(PAGE)
    assert title == "A & B" and links == ["/x?a=1&b=2", "http://other.org/"]
    assert text == "Head\nOne two three\nfour <5link o\n3 < 4\nlast"
    assert warc.html_text("") == ("", "", []) and warc.html_text("<p>a<b")[0] == "a<b"
    assert warc.html_text("<script>never closed")[0] == "" and warc.html_text("a<!-- b")[0] == "a"
    assert len(warc.html_text("<p class='x>" * 20000 + "end")[0]) > 0


def response(payload, kind="text/html; charset=utf-8", more=""):
    return f"HTTP/1.1 200 OK\r\nContent-Type: {kind}\r\n{more}X-Own: kept\r\n\r\n".encode() + payload


def derived(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, headers map<string,string>, block binary, warc_type string")
    return warc.derive(df)


def test_records_are_linked_and_keep_headers_and_digests(spark):
    block = response(PAGE.encode())
    payload = "sha1:" + b32encode(hashlib.sha1(PAGE.encode()).digest()).decode()
    source = {"WARC-Record-ID": "<urn:uuid:1>", "WARC-Target-URI": "http://a.org/dir/p", "WARC-Date": "2020-01-02T03:04:05Z", "WARC-Payload-Digest": "sha1:WRONG"}
    rows = [(1, source, block, "x"), (2, {}, None, "x"), (3, None, response(b"\x89PNG", "image/png"), "x"), (None, {}, b"plain only", "x"), (1, source, block, "x")]
    got = derived(spark, rows).collect()
    assert len([r for r in got if r.page_id == 1]) == 4
    one = {r.warc_type: r for r in got if r.page_id == 1}
    head = {k: dict((h.name, h.value) for h in r.headers) for k, r in one.items()}
    for kind, r in one.items():
        h = head[kind]
        assert h["WARC-Refers-To"] == "<urn:uuid:1>" and h["WARC-Date"] == source["WARC-Date"] and h["WARC-Target-URI"] == source["WARC-Target-URI"]
        assert h["WARC-Source-Payload-Digest"] == "sha1:WRONG" and h["WARC-Source-Block-Digest"] == warc.digest(block)
        assert h["WARC-Block-Digest"] == warc.digest(bytes(r.block)) and h["Content-Length"] == str(len(r.block))
        assert h["WARC-Type"] == kind
    assert head["metadata"]["WARC-Record-ID"] != head["conversion"]["WARC-Record-ID"]
    meta = bytes(one["metadata"].block).decode().split("\r\n")
    assert "http-status-line: HTTP/1.1 200 OK" in meta and "http-header-x-own: kept" in meta and "title: A & B" in meta
    assert f"computed-warc-payload-digest: {payload}" in meta and "outlink: http://a.org/x?a=1&b=2" in meta
    assert bytes(one["conversion"].block).decode() == warc.html_text(PAGE)[0]
    assert sorted(r.warc_type for r in got if r.page_id == 2) == ["conversion", "metadata"]
    assert [r.warc_type for r in got if r.page_id == 3] == ["metadata"]
    assert [bytes(r.block) for r in got if r.page_id is None and r.warc_type == "conversion"] == [b"plain only"]


def test_encodings():
    chunked = b"4\r\nWiki\r\n5;x=y\r\npedia\r\n0\r\n\r\n"
    assert warc.body([("Transfer-Encoding", "chunked")], chunked) == b"Wikipedia"
    for data in (gzip.compress(b"abc"), zlib.compress(b"abc")):
        name = "gzip" if data[:1] == b"\x1f" else "deflate"
        assert warc.body([("content-encoding", name)], data) == b"abc"
    assert warc.body([("content-encoding", "gzip")], b"not gzip") == b"not gzip"
    assert warc.text_of("text/html; charset=iso-8859-1", b"\xe9") == "é" and warc.text_of("text/html; charset=nope", "é".encode()) == "é"
    assert warc.http_parts(b"HTTP/1.0 404 N\nA: b\n c\n\nrest") == ("HTTP/1.0 404 N", [("A", "b c")], b"rest")


def test_round_trip_through_a_file(spark, tmp_path):
    block = response(PAGE.encode())
    plain = warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:uuid:7>"), ("Content-Length", str(len(block)))], block)
    other = warc.to_bytes([("WARC-Type", "request"), ("Content-Length", "3")], b"GET")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.warc").write_bytes(plain + other + plain)
    (tmp_path / "in/b.warc.gz").write_bytes(gzip.compress(plain) + gzip.compress(other))
    source = warc.read(spark, str(tmp_path / "in"))
    assert [bytes(r.block) for r in source.collect()] == [block] * 3
    records = warc.serialised(warc.derive(source)).collect()
    assert len(records) == 6
    data = b"".join(bytes(r.record) for r in records)
    back = list(warc.parse(data))
    assert [b for _, b in back] == [bytes(r.block) for r in records]
    assert [h for h, _ in back] == [{x.name: x.value for x in r.headers} for r in records]


def test_query_rows_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "http://a/", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = warc.derive(warc.responses(pages)).select("page_id", "warc_type", warc.header("WARC-Refers-To").alias("to"), F.decode("block", "UTF-8").alias("t")).collect()
    assert sorted((r.page_id, r.warc_type) for r in got) == [(1, "conversion"), (1, "metadata"), (2, "conversion"), (2, "metadata")]
    assert len({r.to for r in got}) == 2
    assert warc.derive(warc.responses(pages.limit(0))).count() == 0


def test_broken_and_long_files(tmp_path, spark):
    records = [warc.to_bytes([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>"), ("Content-Length", str(n))], bytes([65 + i % 26]) * n) for i, n in enumerate((3, 0, 70_000, 12, 9_000_000, 5))]
    truth = [(f"<{i}>", n) for i, n in enumerate((3, 0, 70_000, 12, 9_000_000, 5))]
    shown = lambda data: [(h["WARC-Record-ID"], len(b)) for h, b in warc.parse(data)]
    plain, members, whole = b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))
    assert shown(plain) == shown(members) == shown(whole) == truth
    for piece in (1, 7, 1000):
        assert b"".join(warc.inflated(b"".join(map(gzip.compress, records[:3])), piece)) == b"".join(records[:3])
    # cut anywhere: all records before the cut, none that is not whole, no error
    few = b"".join(map(gzip.compress, records[:4]))
    for cut in range(0, len(few), 13):
        assert shown(few[:cut]) == truth[: len(shown(few[:cut]))]
    assert shown(members[:-6])[:5] == truth[:5] and shown(plain[:-20])[:5] == truth[:5] and len(shown(plain[:-12])) == 5
    assert shown(members + b"rubbish") == truth and shown(few[:20] + b"\x00" * 9 + few[29:])[1:] == []
    assert shown(b"") == [] == shown(b"\x1f\x8b") == shown(b"WARC/1.1\r\nContent-Length: x\r\n\r\n")
    for name, data in (("a.warc", plain), ("b.warc.gz", members), ("c.warc.gz", members[:-30]), ("d.warc.gz", b"")):
        (tmp_path / name).write_bytes(data)
    rows = warc.read(spark, str(tmp_path)).select(F.length("block").alias("n")).collect()
    assert sorted(r.n for r in rows) == sorted([n for _, n in truth] * 2 + [n for _, n in truth[:5]])


def test_every_record_has_a_date(spark):
    rows = [(1, {"WARC-Date": d} if d is not None else None, b"x", None) for d in (None, "", "yesterday", "2020-01-02T03:04:05Z", "2020-01-02T03:04:05.123Z", "2020")]
    said = [dict((h.name, h.value) for h in r.headers)["WARC-Date"] for r in derived(spark, rows).where("warc_type = 'metadata'").collect()]
    assert said == [warc.UNKNOWN] * 3 + ["2020-01-02T03:04:05Z", "2020-01-02T03:04:05.123Z", "2020"]
    pages = spark.createDataFrame([(1, "http://a", "<p>x")], "page_id long, url string, html string")
    assert warc.responses(pages, date="2021-05-06T07:08:09Z").first().headers["WARC-Date"] == "2021-05-06T07:08:09Z"
