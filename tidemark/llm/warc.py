"""WARC derivatives: responses become linked metadata records and plain-text conversion records.

A response record is written for every page. The derivative builder reads the response files record by record, and
writes for each response a conversion record (plain text) and a metadata record, which keep in `WARC-Refers-To` the
response's record id, in `WARC-Refers-To-Target-URI` and `-Date` its address and date, and its source headers and
digests. Records are gzip members of their own, so each can be read by its offset.

Nulls: a null html is an empty body, a null url leaves the address out, a null page_id is kept null. Record ids are
derived from page_id, url and body, so a repeated task writes the same ids; rows that are equal in all three
give records of equal ids, one set for each row. Empty tables give no files. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import filesystem, fresh_path, written

VERSION = b"WARC/1.1"
#: The date that records carry when a page has none; a parameter, so that runs are repeatable.
DATE = "2024-01-01T00:00:00Z"
#: Bytes of derivatives that one task reads back, about, and such tasks at most.
PART_BYTES, MOST_READERS = 8 << 20, 50_000
#: Elements whose content is no text and holds no elements, one whose content is no text, and those that end a line of text; cells put a blank.
_RAW, _UNSEEN = {"script", "style", "noscript", "template"}, "head"
_BREAKS = set("address article aside blockquote br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
_SPACED = dict.fromkeys(_BREAKS, "\n") | dict.fromkeys(("td", "th"), " ")
#: Elements whose beginning says more than where text is.
_SPECIAL = _RAW | {_UNSEEN, "title", "a", "html"}
#: A comment's or declaration's beginning, or a whole tag: its attributes go on to the tag's end or the page's, and a quoted value may hold any
#: sign. No way is tried twice, so it takes time in proportion to the tag.
_TAG = re.compile(r"<(?:(!--)|([!?])|(/?)([a-zA-Z][^\s/>]*)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+'|))*+)(>|\Z))")
_VALUE = r"\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))"
_LANG, _HREF = (re.compile(rf"(?:^|[\s\"'/]){name}{_VALUE}", re.I) for name in ("lang", "href"))
_LANG_CODE = re.compile(r"[A-Za-z-]+")


class Page:
    """What a page holds, in one pass over its tags: text, title, declared language, addresses of its links.

    Each tag, comment and raw element is passed once, and an element that isn't closed is looked for once, so time grows with
    the page's length whatever it holds. What follows an unclosed comment, raw element or tag is no text.
    """

    def __init__(self, page: str) -> None:
        self.title: str | None = None
        self.lang: str | None = None
        self.links: list[str] = []
        text, at, seen, unclosed = [], 0, 0, set()  # text before `seen` is in the head
        search = _TAG.search
        while (m := search(page, at)) is not None:
            begin, end = m.span()
            if begin > seen:
                text.append(page[max(at, seen) : begin])
            comment, declared, closing, name, attributes, stop = m.groups()
            if name is None:
                end = page.find("-->" if comment else ">", end)
                text.append(" " if comment else "")
                at = len(page) if end < 0 else end + 3 if comment else end + 1
                continue
            at, name = end, name.lower()
            if not stop:  # the page ends within a tag
                break
            if closing or name not in _SPECIAL:
                if at > seen and name in _SPACED:
                    text.append(_SPACED[name])
                continue
            if name in _RAW:
                at = self._close(page, name, at, unclosed) or len(page)
                text.append(" ")
            elif name == _UNSEEN:
                seen = max(seen, self._close(page, name, at, unclosed) or 0)
                text.append(" ")
            elif name == "title" and self.title is None:
                end = self._close(page, name, at, unclosed)
                if end is not None:
                    inner = page[at:end]
                    self.title = inner[: inner.rindex("<")]
            elif name == "a" and (found := _HREF.search(attributes)):
                self.links.append(next(g for g in found.groups() if g is not None))
            elif name == "html" and self.lang is None and (found := _LANG.search(attributes)):
                code = _LANG_CODE.match(next(g for g in found.groups() if g is not None))
                self.lang = code[0] if code else None
        text.append(page[max(at, seen) :])
        self.text = "".join(text)

    @staticmethod
    def _close(page: str, name: str, at: int, unclosed: set[str]) -> int | None:
        """The place after the element's end tag; None if there is none, which is found out once."""
        if name in unclosed:
            return None
        end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
        if end is None:
            unclosed.add(name)
            return None
        return end.end()


def plain_text(page: str | Page) -> str:
    """The visible text: one line for each block, entities resolved, white space run together, empty lines left out."""
    text = (page if isinstance(page, Page) else Page(page)).text
    lines = (" ".join(x.split()) for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def digest(data: bytes) -> str:
    """A labelled digest as WARC writes it."""
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode().rstrip("=")


def record_id(*parts: bytes) -> str:
    """A URN that depends on the parts alone."""
    h = hashlib.sha256(b"".join(len(p).to_bytes(8, "big") + p for p in parts)).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=h[:16], version=4)}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1f\x7f]+", " ", value).strip()


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member of its own; headers without value are left out."""
    lines = [f"{k}: {_clean(v)}".encode() for k, v in headers if v is not None]
    head = b"\r\n".join([VERSION, *lines, b"Content-Length: %d" % len(block)])
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(head + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (by lower-case name) and block of one record; raises if it is cut short."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError("not a record")
    headers = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines)}
    n = int(headers["content-length"])
    if len(rest) != n + 4:
        raise ValueError("record cut short")
    return headers, rest[:n]


def members(file, size: int = 1 << 20):
    """offset, length and content of each gzip member of an open stream, one at a time."""
    at, begin, data, z, out = 0, 0, file.read(size), zlib.decompressobj(31), []
    while data:
        out.append(z.decompress(data))
        if z.eof:
            at += len(data) - len(z.unused_data)
            yield begin, at - begin, b"".join(out)
            begin, data, z, out = at, z.unused_data, zlib.decompressobj(31), []
            if not data:
                data = file.read(size)
        else:
            at += len(data)
            data = file.read(size)
    if out:
        raise ValueError("file cut short")


def response(page_id: int | None, url: str | None, page: str | None) -> bytes:
    """A response record: an HTTP reply whose body is the page."""
    body = (page or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    own = record_id(b"response", str(page_id).encode(), (url or "").encode(), body)
    return record(
        [("WARC-Type", "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Target-URI", url), ("WARC-Page-ID", None if page_id is None else str(page_id)),
         ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http)), ("Content-Type", "application/http; msgtype=response")],
        http,
    )


def derive(headers: dict[str, str], block: bytes) -> tuple[bytes, bytes]:
    """The conversion and the metadata record of a response."""
    http, _, body = block.partition(b"\r\n\r\n")
    page = Page(body.decode("utf-8", "replace"))
    text = plain_text(page).encode()
    own, url = headers["warc-record-id"], headers.get("warc-target-uri")
    linked = [("WARC-Date", headers["warc-date"]), ("WARC-Target-URI", url), ("WARC-Refers-To", own), ("WARC-Refers-To-Target-URI", url), ("WARC-Refers-To-Date", headers["warc-date"]),
              ("WARC-Source-Payload-Digest", headers.get("warc-payload-digest")), ("WARC-Source-Block-Digest", headers.get("warc-block-digest")), ("WARC-Page-ID", headers.get("warc-page-id"))]
    conversion_id, metadata_id = record_id(b"conversion", own.encode()), record_id(b"metadata", own.encode())
    title, links = page.title, [html.unescape(x) for x in page.links]
    fields = [("status", http.split(b"\r\n", 1)[0].decode()), *(("source-header", x.decode()) for x in http.split(b"\r\n")[1:]), ("title", None if title is None else " ".join(html.unescape(title).split())),
              ("declared-language", page.lang.lower() if page.lang else None), ("n-links", str(len(links))), *(("outlink", x) for x in links), ("text-bytes", str(len(text))), ("text-lines", str(text.count(b"\n") + bool(text)))]
    facts = b"".join(f"{k}: {_clean(v)}\r\n".encode() for k, v in fields if v is not None)
    return (
        record([("WARC-Type", "conversion"), ("WARC-Record-ID", conversion_id), *linked, ("WARC-Block-Digest", digest(text)), ("Content-Type", "text/plain")], text),
        record([("WARC-Type", "metadata"), ("WARC-Record-ID", metadata_id), ("WARC-Concurrent-To", conversion_id), *linked, ("WARC-Block-Digest", digest(facts)), ("Content-Type", "application/warc-fields")], facts),
    )


class _File:
    """A file that gets its final name when it is whole; each attempt has a name of its own."""

    def __init__(self, path: str, kind: str) -> None:
        self.system, self.folder = filesystem(path)
        self.system.create_dir(self.folder, recursive=True)
        self.name, self.at = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz", 0
        self.out = self.system.open_output_stream(f"{self.folder}/_{self.name}", buffer_size=1 << 20, compression=None)

    def add(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def done(self) -> str:
        self.out.close()
        self.system.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
        return self.name


def write_responses(pages: DataFrame, path: str) -> DataFrame:
    """Write every page as a response record; returns the files that count: file, n_records."""

    def run(batches):
        out, n = None, 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                out = out or _File(path, "response")
                out.add(response(*row))
                n += 1
        if out is not None:
            yield pa.record_batch({"file": [out.done()], "n_records": pa.array([n], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return written(rows.mapInArrow(run, "file string, n_records long"), "responses")


FIELDS = ["page_id", "url", "response_id", "payload_digest", "conversion_id", "metadata_id", "file", "conversion_offset", "conversion_length", "metadata_offset", "metadata_length"]


def build_derivatives(files: DataFrame, source: str, path: str) -> DataFrame:
    """Read response files and write a file of derivatives for each; returns an index, one row for each response."""
    schema = "page_id long, url string, response_id string, payload_digest string, conversion_id string, metadata_id string, file string, conversion_offset long, conversion_length long, metadata_offset long, metadata_length long"
    kinds = [pa.int64(), *[pa.string()] * 6, *[pa.int64()] * 4]

    def run(batches):
        system, folder = filesystem(source)
        for b in batches:
            for name in b.column(0).to_pylist():
                out, rows = _File(path, "derived"), []
                with system.open_input_stream(f"{folder}/{name}", compression=None) as f:
                    for _, _, raw in members(f):
                        headers, block = parse(raw)
                        if headers["warc-type"] != "response":
                            continue
                        if digest(block) != headers["warc-block-digest"]:
                            raise ValueError(f"damaged record {headers['warc-record-id']}")
                        own = headers["warc-record-id"]
                        text, facts = derive(headers, block)
                        page_id = headers.get("warc-page-id")
                        rows.append((None if page_id is None else int(page_id), headers.get("warc-target-uri"), own, headers["warc-payload-digest"], record_id(b"conversion", own.encode()), record_id(b"metadata", own.encode()), "", out.add(text), len(text), out.add(facts), len(facts)))
                done = out.done()
                for at in range(0, len(rows), 2000):
                    cols = [list(c) for c in zip(*rows[at : at + 2000], strict=True)]
                    cols[6] = [done] * len(cols[6])
                    yield pa.record_batch({k: pa.array(c, t) for k, c, t in zip(FIELDS, cols, kinds, strict=True)})

    return written(files.select("file").repartition("file").mapInArrow(run, schema), "derivatives")


def read_derivatives(index: DataFrame, path: str) -> DataFrame:
    """What the two records of each response hold, read from their files by offset, with all links checked.

    Records are dealt in the files' order, so many to a task that each reads about PART_BYTES.
    """
    size = index.agg(F.sum(F.col("conversion_length") + F.col("metadata_length"))).first()[0] or 0
    index = index.repartitionByRange(max(1, min(MOST_READERS, size // PART_BYTES + 1)), "file", "conversion_offset").sortWithinPartitions("file", "conversion_offset")
    schema = "page_id long, url string, response_id string, conversion_id string, metadata_id string, refers_to string, source_payload_digest string, text_digest string, metadata_digest string, n_links long, title string, declared_language string, text string"
    kinds = [pa.int64(), *[pa.string()] * 8, pa.int64(), *[pa.string()] * 3]
    names = [x.split()[0] for x in schema.split(", ")]

    def one(f, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        headers, block = parse(zlib.decompress(f.read_at(length, offset), 31))
        if digest(block) != headers["warc-block-digest"]:
            raise ValueError(f"damaged record {headers['warc-record-id']}")
        return headers, block

    def run(batches):
        system, folder = filesystem(path)
        name, f = None, None
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["file"] != name:
                    name, f = r["file"], system.open_input_file(f"{folder}/{r['file']}")
                text, body = one(f, r["conversion_offset"], r["conversion_length"])
                facts, lines = one(f, r["metadata_offset"], r["metadata_length"])
                if {text["warc-refers-to"], facts["warc-refers-to"]} != {r["response_id"]} or facts["warc-concurrent-to"] != text["warc-record-id"]:
                    raise ValueError(f"records of {r['response_id']} aren't linked")
                known = dict(x.split(": ", 1) for x in lines.decode().split("\r\n") if ": " in x)
                rows.append((r["page_id"], text.get("warc-target-uri"), r["response_id"], text["warc-record-id"], facts["warc-record-id"], text["warc-refers-to"], text["warc-source-payload-digest"], text["warc-block-digest"], facts["warc-block-digest"], int(known["n-links"]), known.get("title"), known.get("declared-language"), body.decode()))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.record_batch({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return index.mapInArrow(run, schema)


def derivative_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Pages to response files to derivative files, and what those hold, one row for each page."""
    source, path = fresh_path(spark, "responses"), fresh_path(spark, "derivatives")
    index = build_derivatives(write_responses(pages, source), source, path)
    return read_derivatives(index, path).withColumn("text_bytes", F.octet_length("text")).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text")
