"""WARC derivatives: metadata and plain-text conversion records for responses.

A response (a page with its URL) becomes three linked records. The response's record id is the page's own (column ``record_id``) or a
name-based UUID of its page_id, URI and payload, so a rerun gives the same ids and two captures of equal pages have two. Its block is the HTTP message
with the headers that the page came with (column ``http_headers``, a map), under ``application/http; msgtype=response``; the payload digest is that of the page. The metadata record
holds title, language and links; the conversion record holds the page's text. Both carry ``WARC-Refers-To`` (the response's id), the
target URI and date of the source (column ``warc_date``), every header of the source as ``WARC-Source-HTTP-...``, the source's
content type and payload digest, and digests of their own blocks. :func:`serialise` writes a record as WARC/1.1 bytes.

Pages are read in one pass from tag to tag; what a tag or comment lacks (its end) is looked for once, so the time is in proportion to the length.

Defined cases: a null page has an empty payload, no links and an empty conversion; a null URL stays null and its header is left out; a page without a
date of its own gets ``date``; an unclosed tag is text, an unclosed script shows its content; rows equal in page_id, URL and payload share a record
id (they are one capture); an empty table gives an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescope.llm.common import slices

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the fixed name space of URLs
DATE = "1970-01-01T00:00:00Z"
#: Elements whose content is not shown, and those that part lines.
HIDDEN = ("script", "style", "noscript", "template", "head")
BREAKS = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav blockquote pre hr".split())
NAME = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\b")
CLOSED = re.compile(rf"</({'|'.join(HIDDEN)})\s*+>", re.I)
HREF = re.compile(r"\bhref\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LANG = re.compile(r"\blang\s*+=\s*+[\"']?([A-Za-z-]+)", re.I)
TITLE_END = re.compile(r"</title\s*+>", re.I)
SCHEMA = "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, source_content_type string, source_digest string, block_digest string, headers map<string,string>, block string"


def digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw, usedforsecurity=False).digest()).decode()


def tags(page: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of every tag in order; name is lower-case, with a slash in front for an end tag, ``!`` for comments and declarations."""
    at, comments, closing = 0, True, True
    while (at := page.find("<", at)) >= 0:
        if comments and page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            if end >= 0:
                yield at, end + 3, "!"
                at = end + 3
                continue
            comments = False
        end = page.find(">", at) if closing else -1
        if end < 0:
            closing = False
            at += 1
            if not comments:
                return
            continue
        found = NAME.match(page, at, end)
        if found:
            yield at, end + 1, ("/" if page[at + 1] == "/" else "") + found[1].lower()
        else:
            yield at, end + 1, "!" if page.startswith("!", at + 1) else "?"
        at = end + 1


def plain(page: str) -> str:
    """The visible text: hidden parts dropped, block tags as line ends, entities decoded, white space folded."""
    ends: dict[str, list[tuple[int, int]]] = {n: [] for n in HIDDEN}
    for m in CLOSED.finditer(page):
        ends[m[1].lower()].append(m.span())
    nexts = dict.fromkeys(HIDDEN, 0)
    out, at = [], 0
    for start, end, name in tags(page):
        if start < at:  # inside a hidden part
            continue
        out.append(page[at:start])
        at = end
        if name in ends:
            held, k = ends[name], nexts[name]
            while k < len(held) and held[k][0] < end:
                k += 1
            nexts[name] = k
            if k < len(held):
                at = held[k][1]
                out.append(" ")
        elif name == "!":
            out.append(" ")
        elif name.lstrip("/") in BREAKS:
            out.append("\n")
    text = html.unescape("".join(out) + page[at:])
    return "\n".join(line for raw in text.split("\n") if (line := " ".join(raw.split())))


def facts(page: str, uri: str | None) -> str:
    """``application/warc-fields``: title, language and links in order of appearance, each once."""
    title = lang = None
    links = []
    for start, end, name in tags(page):
        if name == "title" and title is None:
            closed = TITLE_END.search(page, end)
            title = " ".join(html.unescape(page[end : closed.start()]).split()) if closed else ""
        elif name == "html" and lang is None and (found := LANG.search(page, start, end)):
            lang = found[1].lower()
        elif name == "a" and (found := HREF.search(page, start, end)):
            try:
                links.append(urljoin(uri or "", html.unescape(next(g for g in found.groups() if g is not None)).strip()))
            except ValueError:  # no URL at all
                continue
    lines = [f"title: {title}"] * bool(title) + [f"language: {lang}"] * bool(lang) + [f"outlink: {target}" for target in links]
    return "".join(f"{line}\r\n" for line in dict.fromkeys(lines))


def derive(page_id: int | None, uri: str | None, page: str | None, date: str = DATE, kind: str = "text/html", own_id: str | None = None, http: list[tuple[str, str]] | None = None) -> list[dict]:
    """The response's record and its two derivatives."""
    http = [(k, v) for k, v in http or () if v is not None] or [("Content-Type", kind)]
    kind = next((v for k, v in http if k.lower() == "content-type"), kind)
    payload = page or ""
    source = digest(payload.encode("utf-8", "replace"))
    message = "HTTP/1.1 200 OK\r\n" + "".join(f"{k}: {v}\r\n" for k, v in http) + "\r\n" + payload
    out, origin = [], None
    for record, content, block in (("response", "application/http; msgtype=response", message), ("metadata", "application/warc-fields", facts(payload, uri)), ("conversion", "text/plain", plain(payload))):
        raw = block.encode("utf-8", "replace")
        own = f"<urn:uuid:{uuid.uuid5(SPACE, f'{record} {page_id} {uri} {source}')}>"
        own = own_id or own if record == "response" else own
        origin = origin or own
        refers = None if record == "response" else origin
        headers = {"WARC-Type": record, "WARC-Record-ID": own, "WARC-Refers-To": refers, "WARC-Target-URI": uri, "WARC-Date": date, "Content-Type": content, "WARC-Block-Digest": digest(raw), "WARC-Payload-Digest": source if record == "response" else None, "WARC-Source-Content-Type": None if record == "response" else kind, "WARC-Source-Payload-Digest": None if record == "response" else source, "Content-Length": str(len(raw))}
        if record != "response":
            headers |= {f"WARC-Source-HTTP-{k}": v for k, v in http}
        out.append({"page_id": page_id, "record_type": record, "record_id": own, "refers_to": refers, "target_uri": uri, "date": date, "content_type": content, "source_content_type": kind, "source_digest": source, "block_digest": digest(raw), "headers": [(k, v) for k, v in headers.items() if v is not None], "block": block})
    return out


def serialise(headers: dict[str, str], block: str) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.1\r\n{head}\r\n".encode() + block.encode("utf-8", "replace") + b"\r\n\r\n"


def records(pages: DataFrame, responses: bool = True, date: str = DATE) -> DataFrame:
    """The records of every page (page_id, url, html; record_id, warc_date and http_headers where the table has them): three a page,
    or the two derivatives alone."""
    fields = [("page_id", pa.int64()), *((n, pa.string()) for n in ("record_type", "record_id", "refers_to", "target_uri", "date", "content_type", "source_content_type", "source_digest", "block_digest")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("page_id", "url", "html", "warc_date", "record_id", "http_headers"))
            rows = [r for p, u, h, d, i, k in zip(*columns, strict=True) for r in derive(p, u, h, d or date, own_id=i, http=k)[0 if responses else 1 :]]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    own = [F.col(c).cast(k).alias(c) if c in pages.columns else F.lit(None).cast(k).alias(c) for c, k in (("warc_date", "string"), ("record_id", "string"), ("http_headers", "map<string,string>"))]
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), *own).mapInArrow(run, SCHEMA)
