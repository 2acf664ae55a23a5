"""Derivatives of WARC responses: a metadata and a plain-text conversion record for each.

Both refer to the response by its record id and keep its target, date and
digests; the metadata record also has the HTTP status line and headers, the
title and the links. Record ids are made from the response's id, so reruns give
the same records. All of it is a pass over the responses, without a shuffle.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import accumulate
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import col, row_of, unpacked, with_fields

NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # for URLs, by RFC 9562
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/<>]*)((?:[^'\"<>]|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>|<[!?/][^<>]*>")
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:\-]*)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)")
SPACE = re.compile(r"[ \t\r\n\f\v]+")
#: Elements whose content is no text, and those that begin a new line (fixed values).
SILENT = frozenset("script style noscript template iframe object svg textarea select".split())
LINES = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split())


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """An id that is a function of ``parts``."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(31).join(parts))}>"


def html_text(page: str) -> tuple[str, str, list[str]]:
    """Text (a line for each block), title and link targets of a page, in one pass; broken markup is text."""
    out: list[str] = []
    title: list[str] | None = None
    found, links, at, end = "", [], 0, len(page)
    lower = page.lower() if page.isascii() else None
    while at < end:
        start = page.find("<", at)
        if start < 0:
            start = end
        if start > at:
            said = page[at:start]
            said = html.unescape(said) if "&" in said else said
            (out if title is None else title).append(said.replace("\n", " "))
        if start == end:
            break
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        tag = TAG.match(page, start)
        if not tag:
            (out if title is None else title).append("<")
            at = start + 1
            continue
        at = tag.end()
        close, name, rest = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        if name in SILENT and not close and not rest.endswith("/"):
            shut = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(lower or page, at)
            at = shut.end() if shut else end
        elif name == "title":
            if close and title is not None:
                found, title = found or " ".join("".join(title).split()), None
            elif not close:
                title = []
        elif name in LINES:
            out.append("\n")
        if name in ("a", "area", "link") and not close:
            for attribute, value in ATTRIBUTE.findall(rest):
                if attribute.lower() == "href":
                    links.append(html.unescape(value.strip("\"'")).strip())
    if title is not None:
        found = found or " ".join("".join(title).split())
    lines = (" ".join(x.split()) for x in "".join(out).split("\n"))
    return "\n".join(x for x in lines if x), found, links


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload as sent; a block without a status line is all payload."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    ends = [(i, n) for sep, n in ((b"\r\n\r\n", 4), (b"\n\n", 2)) if (i := block.find(sep)) >= 0]
    i, n = min(ends, default=(len(block), 0))
    head = block[:i].decode("latin-1").replace("\r\n", "\n").split("\n")
    headers: list[tuple[str, str]] = []
    for line in head[1:]:
        if line[:1] in (" ", "\t") and headers:
            headers[-1] = (headers[-1][0], f"{headers[-1][1]} {line.strip()}")
        elif ":" in line:
            name, _, value = line.partition(":")
            headers.append((name.strip(), value.strip()))
    return head[0], headers, block[i + n :]


def _chunks(data: bytes) -> bytes:
    out, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        try:
            size = int(data[at:end].split(b";")[0], 16)
        except ValueError:
            return data if not out else b"".join(out)
        if size <= 0:
            break
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size
    return b"".join(out)


def body(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings; one that cannot be undone stays."""
    h = {k.lower(): v.lower() for k, v in headers}
    if "chunked" in h.get("transfer-encoding", ""):
        payload = _chunks(payload)
    try:
        if "gzip" in h.get("content-encoding", ""):
            return zlib.decompress(payload, 47)
        if "deflate" in h.get("content-encoding", ""):
            return zlib.decompress(payload, 15 if payload[:1] == b"\x78" else -15)
    except zlib.error:
        pass
    return payload


def text_of(kind: str, data: bytes) -> str:
    """Decoded by the header's charset, else the page's, else UTF-8; what cannot be decoded is marked."""
    name = re.search(r"charset=[\"']?([\w\-]+)", kind, re.I) or re.search(r"<meta[^>]{0,200}charset=[\"']?([\w\-]+)", data[:4096].decode("latin-1"), re.I)
    try:
        return data.decode(name[1] if name else "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _line(value: str) -> str:
    return SPACE.sub(" ", value).strip()


def derive_one(source: dict[str, str], block: bytes | None) -> list[tuple[str, list[tuple[str, str]], bytes]]:
    """Derived records (type, headers, block) of a response with WARC headers ``source``."""
    block = block or b""
    status, headers, payload = http_parts(block)
    rid, uri, date = source.get("WARC-Record-ID") or record_id("response", source.get("WARC-Target-URI", ""), digest(block)), source.get("WARC-Target-URI", ""), source.get("WARC-Date", "")
    date = date if DATE.fullmatch(date) else UNKNOWN
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    own = {"WARC-Block-Digest": digest(block), "WARC-Payload-Digest": digest(payload)}
    plain = body(headers, payload)
    is_html = "html" in kind.lower() or (not kind and b"<html" in plain[:1024].lower())
    is_text = is_html or kind.lower().startswith("text/") or (not kind and not headers)
    text, title, links = "", "", []
    if is_text:
        text = text_of(kind, plain)
        if is_html:
            text, title, links = html_text(text)
    fields = [("http-status-line", status)] * bool(status) + [(f"http-header-{k.lower()}", v) for k, v in headers]
    for name, value in own.items():
        said = source.get(name)
        fields.append((f"source-{name.lower()}", said or value))
        if said and said.lower().startswith("sha1:") and said.upper() != value.upper():
            fields.append((f"computed-{name.lower()}", value))
    fields += [("title", title)] * bool(title) + [("outlink", x) for x in absolute(uri, links)]
    data = "".join(f"{k}: {_line(v)}\r\n" for k, v in fields).encode()
    linked = [("WARC-Date", date)] + [("WARC-Target-URI", uri)] * bool(uri) + [("WARC-Refers-To", rid)]
    kept = [(f"WARC-Source-{k[5:]}", source.get(k) or v) for k, v in own.items()]

    def record(what: str, content: str, block: bytes):
        return what, [("WARC-Type", what), ("WARC-Record-ID", record_id(what, rid)), *linked, *kept, ("WARC-Block-Digest", digest(block)), ("Content-Type", content), ("Content-Length", str(len(block)))], block

    out = [record("metadata", "application/warc-fields", data)]
    if is_text:
        out.append(record("conversion", "text/plain; charset=utf-8", text.encode()))
    return out


def absolute(base: str, links: list[str]) -> list[str]:
    """Links as seen from a page; those that cannot be joined stay."""
    try:
        at = urlsplit(base)
    except ValueError:
        return links
    origin, out = f"{at.scheme}://{at.netloc}", []
    for link in links:
        plain = "/." not in link and at.netloc and at.scheme in ("http", "https")
        if link.startswith("/") and not link.startswith("//") and plain:
            out.append(origin + link)
            continue
        try:
            out.append(urljoin(base, link))
        except ValueError:
            out.append(link)
    return out


def to_bytes(headers: list[tuple[str, str]], block: bytes, version: str = "WARC/1.1") -> bytes:
    """A whole record as it stands in a file."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{version}\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def inflated(data: bytes, piece: int = 4 << 20) -> Iterator[bytes]:
    """What a file holds, piece by piece: gzip members one after the other, or as it is; ends where a member is broken or cut off."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at = 0
    while data[at : at + 2] == b"\x1f\x8b":
        unpack, fed = zlib.decompressobj(31), memoryview(data)[at:]
        try:
            while not unpack.eof:
                # a little at a time, as what follows the member is copied
                fresh = b"" if unpack.unconsumed_tail else fed[: min(piece, 1 << 16)].tobytes()
                fed = fed[len(fresh) :]
                part = unpack.decompress(unpack.unconsumed_tail or fresh, piece)
                if part:
                    yield part
                elif not fresh and not unpack.unconsumed_tail and not unpack.eof:
                    return  # cut off
        except zlib.error:
            return
        at = len(data) - len(unpack.unused_data) - len(fed)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a WARC file, plain or gzipped; stops where it is broken.

    A gzipped file is unpacked record by record, so no more than a record
    and a piece of it are unpacked at once. A record that is cut off is left out.
    """
    parts, held, at = inflated(data), b"", 0

    def more() -> bool:
        nonlocal held, at
        part = next(parts, None)
        if part is not None:
            held, at = held[at:] + part if at < len(held) else part, 0
        return part is not None

    while True:
        while (start := held.find(b"WARC/", at)) < 0 or (end := held.find(b"\r\n\r\n", start)) < 0:
            at = start if start >= 0 else max(at, len(held) - 4)
            if not more():
                return
        headers = {}
        for line in held[start:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip()] = value.strip()
        said = headers.get("Content-Length", "")
        if not (said.isascii() and said.isdigit()):
            return
        size, at = int(said), end + 4
        if len(held) - at < size:
            # a long block is put together once
            block = [held[at:]]
            missing = size - len(block[0])
            while missing > 0:
                if (part := next(parts, None)) is None:
                    return
                block.append(part)
                missing -= len(part)
            held, at = block[-1], len(block[-1]) + missing
            whole = b"".join(block)
            yield headers, whole[:size] if missing else whole
        else:
            yield headers, held[at : at + size]
            at += size


HEADERS = "map<string, string>"
#: Date of a record whose response has none that is valid; the format demands one, and reruns must agree.
UNKNOWN = "1970-01-01T00:00:00Z"
DATE = re.compile(r"\d{4}(-\d\d(-\d\d(T\d\d:\d\d(:\d\d(\.\d{1,9})?)?Z)?)?)?")
#: Bytes of blocks in one Arrow batch; a longer block stands alone.
BATCH = 8 << 20


def read(spark: SparkSession, path: str) -> DataFrame:
    """Response records of WARC files below ``path``: headers and block.

    A file is read by one task, which holds its bytes as they are stored and
    unpacks a record at a time. What follows a break in a file is left out.
    """

    def batch(found: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([list(h.items()) for h, _ in found], pa.map_(pa.string(), pa.string())), pa.array([b for _, b in found], pa.binary())], ["headers", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for content in x.column(0):
                found, size = [], 0
                for headers, block in parse(content.as_py()):
                    if headers.get("WARC-Type") == "response":
                        found.append((headers, block))
                        size += len(block)
                        if size >= BATCH:
                            yield batch(found)
                            found, size = [], 0
                if found:
                    yield batch(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(run, f"headers {HEADERS}, block binary")


def responses(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id", date: str = UNKNOWN) -> DataFrame:
    """``pages`` as responses, with the id column kept: headers and block as a server would have sent them; ``date`` is when they were fetched."""
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    said, url = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    block = F.encode(F.concat(F.lit(head), said), "UTF-8")
    names = [F.lit("WARC-Type"), F.lit("response"), F.lit("WARC-Target-URI"), url, F.lit("WARC-Date"), F.lit(date)]
    return pages.select(col(id_col), F.create_map(*names).alias("headers"), block.alias("block"))


RECORD = "warc_type string, headers array<struct<name: string, value: string>>, block binary"


def derive(source: DataFrame) -> DataFrame:
    """The derived records of responses (headers and block), with all other columns of ``source``.

    A null or empty block gives a metadata record and an empty conversion;
    a response without an id gets one from its target and content; other
    content than text has no conversion record. Repeated responses give
    repeated records. Columns named warc_type give way.
    """
    carry = [c for c in source.columns if c not in ("headers", "block", "warc_type")]
    rows = source.select("headers", "block", row_of(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                x = whole.slice(i, 256)
                out, row = [], []
                for j in range(x.num_rows):
                    found = derive_one({k: v or "" for k, v in x.column(0)[j].as_py() or ()}, x.column(1)[j].as_py())
                    out += found
                    row += [j] * len(found)
                pairs = [h for r in out for h in r[1]]
                each = pa.StructArray.from_arrays([pa.array([k for k, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], ["name", "value"])
                edge = pa.array([0, *accumulate(len(r[1]) for r in out)], pa.int32())
                cols = [pa.array([r[0] for r in out], pa.string()), pa.ListArray.from_arrays(edge, each), pa.array([r[2] for r in out], pa.binary())]
                yield pa.record_batch([x.column(2).take(pa.array(row, pa.int64())), *cols], ["row", "warc_type", "headers", "block"])

    return rows.mapInArrow(run, with_fields(rows.schema.fields[2:], RECORD)).select(*unpacked(carry), "warc_type", "headers", "block")


def header(name: str):
    """The first header of a record by that name."""
    return F.try_element_at(F.filter("headers", lambda h: h["name"] == name), F.lit(1))["value"]


def serialised(records: DataFrame) -> DataFrame:
    """Records with ``record``: the whole of it as it stands in a WARC file, a gzip member of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            names = x.schema.names
            h, b = x.column(names.index("headers")).to_pylist(), x.column(names.index("block")).to_pylist()
            out = [gzip.compress(to_bytes([(e["name"], e["value"]) for e in p], q or b""), mtime=0) for p, q in zip(h, b)]
            yield pa.record_batch([*x.columns, pa.array(out, pa.binary())], [*names, "record"])

    return records.drop("record").mapInArrow(run, with_fields([f for f in records.schema.fields if f.name != "record"], "record binary"))
