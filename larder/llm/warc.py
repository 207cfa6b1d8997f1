"""Derived WARC records: what a response gives rise to, linked back to it.

Each response record becomes a metadata record (its headers, digests, title and outlinks) and a
conversion record (its page as plain text). Both name the response they come from.
"""

from __future__ import annotations

import base64
import hashlib
import html
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE = "page_id long, record_id string, target_uri string, date string, headers string, block binary"
DERIVED = (
    "page_id long, record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, "
    "content_length long, block_digest string, source_payload_digest string, source_block_digest string, headers string, content string"
)
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs

_HIDDEN = "script|style|noscript|template|title|head"
_NAMES = "p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|aside|nav|header|footer|main|body|html|blockquote|pre|hr|form|figure"
_START = re.compile(rf"<(!--|(?:{_HIDDEN})\b)", re.I)
_END = re.compile(rf"</({_HIDDEN})\s*>", re.I)
_BLOCK_START = re.compile(rf"<(?:{_NAMES})\b", re.I)
_BLOCK = re.compile(rf"</?(?:{_NAMES})\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z!?][^>]*>")
_ANCHOR = re.compile(r"<a\b", re.I)
_HREF = re.compile(r"\bhref\s*=\s*", re.I)
_VALUE = re.compile(r"""("[^"]*"|'[^']*'|[^\s>"']+)""")
_CHUNK = re.compile(rb"[ \t]*([0-9a-fA-F]{1,16})[ \t]*(?:;[^\r\n]*)?\r\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    """A record's name, the same whenever it is made again from the same parts."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _head(fields: list[tuple[str, str]]) -> str:
    return "WARC/1.1\r\n" + "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in fields)


def _onward(page: str, mark: str) -> Callable[[int], int]:
    """find(i): the next place of `mark` from i on, -1 if there is none; i must not go back, and the page is
    walked once in all."""
    at = 0

    def find(i: int) -> int:
        nonlocal at
        if 0 <= at < i or not at:
            at = page.find(mark, i)
        return at

    return find


class Elements:
    """Where the comments and the hidden elements of a page lie. Marks are looked up, never searched for
    twice, so that a page costs what its length costs, whatever in it is left open."""

    def __init__(self, page: str):
        self.page, self.ends = page, {}
        for m in _END.finditer(page):
            self.ends.setdefault(m[1].lower(), []).append((m.start(), m.end()))
        #: (start, end, name, whether it ends by an end tag); a head's end is that of its start tag
        self.spans: list[tuple[int, int, str, bool]] = []
        self.title = None
        closed, arrow = _onward(page, ">"), _onward(page, "-->")
        for m in _START.finditer(page):
            name = m[1].lower()
            if name == "!--":
                end = arrow(m.end())
                self.spans.append((m.start(), end + 3 if end >= 0 else len(page), name, end >= 0))
                continue
            tag = closed(m.end())
            if tag < 0:
                continue  # no tag
            ends = self.ends.get(name, [])
            i = bisect_left(ends, (tag + 1,))
            if name == "head":
                self.spans.append((m.start(), tag + 1, name, False))
            elif i < len(ends):
                self.spans.append((m.start(), ends[i][1], name, True))
                if name == "title" and self.title is None:
                    self.title = page[tag + 1 : ends[i][0]]
            elif name in ("script", "style"):
                self.spans.append((m.start(), len(page), name, False))
        self.starts = [s for s, *_ in self.spans]
        whole = [(s, e) for s, e, _, good in self.spans if good]
        self.whole, self.whole_starts = whole, [s for s, _ in whole]
        self.blocks = [m.start() for m in _BLOCK_START.finditer(page)]
        self.head_end: tuple[int, int | None] | None = None

    def head_until(self, at: int) -> tuple[int, int | None]:
        """(start, end) of the end tag of a head that is open at `at`, outside of comments and hidden
        elements; or (start, None) of the block element that ends it, or of the page's end."""
        if self.head_end is not None and self.head_end[0] >= at:
            return self.head_end
        ends = self.ends.get("head", [])
        while True:
            i, j, k = bisect_left(self.whole_starts, at), bisect_left(ends, (at,)), bisect_left(self.blocks, at)
            n = len(self.page)
            raw = self.whole_starts[i] if i < len(self.whole) else n
            end, block = ends[j][0] if j < len(ends) else n, self.blocks[k] if k < len(self.blocks) else n
            if raw < min(end, block):
                at = self.whole[i][1]
                continue
            self.head_end = (end, ends[j][1]) if end < block else (block, None)
            return self.head_end


def _shown(page: str, found: Elements) -> str:
    """A page without comments, scripts, styles, noscript, templates and head. A head without an end tag
    ends at the body or the first block element; of one that is followed by text alone, the title goes.
    Comments, scripts and styles without an end go to the page's; of other elements without one the tags
    alone go."""
    out, at, titles = [], 0, 0  # titles before that place are a head's
    while (i := bisect_left(found.starts, at)) < len(found.spans):
        start, end, name, _ = found.spans[i]
        out.append(page[at:start])
        at = end
        if name == "title" and start >= titles:
            out.append(page[start:end])
            continue
        out.append(" ")
        if name == "head":
            start, end = found.head_until(at)
            if end is not None:
                at = end
            else:
                titles = start
    return "".join([*out, page[at:]])


def links(page: str) -> list[str]:
    """The targets of a page's anchors, as they stand."""
    places = [(m.start(), v) for m in _HREF.finditer(page) if (v := _VALUE.match(page, m.end()))]
    starts, closed = [s for s, _ in places], _onward(page, ">")
    out, at = [], 0
    for m in _ANCHOR.finditer(page):
        if m.start() < at:
            continue  # within the value of the link before
        end, i = closed(m.end()), bisect_left(starts, m.end())
        if i < len(places) and (starts[i] < end or end < 0):
            out.append(places[i][1][1])
            at = places[i][1].end()
    return out


def plain_text(page: str, found: Elements | None = None) -> str:
    """The text of a page: no comments, scripts, styles or head; a line per block element; white space,
    line breaks of the page's source among it, collapsed, empty lines left out."""
    text = " ".join(_shown(page, found or Elements(page)).split())
    last = text.rfind(">") + 1  # no tag ends after it
    text = _TAG.sub("", _BLOCK.sub("\n", text[:last])) + text[last:]
    lines = (" ".join(html.unescape(line).split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def responses(
    pages: DataFrame, date: str = "2024-01-01T00:00:00Z", page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """RESPONSE records of stored pages: an HTTP block with the page as its payload, named by id and URL.
    A null page is an empty payload, a null URL an empty target."""
    pages = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).cast("string").alias("html"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, at, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                at, payload = at or "", (text or "").encode()
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
                name = record_id("response", str(i), at)
                head = _head([
                    ("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Target-URI", at), ("WARC-Date", date),
                    ("Content-Type", "application/http; msgtype=response"), ("WARC-Block-Digest", digest(block)),
                    ("WARC-Payload-Digest", digest(payload)), ("Content-Length", str(len(block))),
                ])
                rows.append((i, name, at, date, head, block))
            columns = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), *[pa.string()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "record_id", "target_uri", "date", "headers", "block"])

    return pages.mapInArrow(of, RESPONSE)


def _fields(head: str) -> list[tuple[str, str]]:
    return [(k.strip(), v.strip()) for k, c, v in (line.partition(":") for line in head.split("\r\n")[1:]) if c]


def _unchunked(data: bytes) -> bytes:
    """A chunked body's bytes; what isn't chunked, or no longer, stays as it is."""
    out, at = [], 0
    while size := _CHUNK.match(data, at):
        n = int(size[1], 16)
        if n == 0:
            return b"".join(out)
        out.append(data[size.end() : size.end() + n])
        at = size.end() + n
        at += 2 * (data[at : at + 2] == b"\r\n")
    return b"".join([*out, data[at:]])


def _inflated(data: bytes, *windows: int) -> bytes:
    """What zlib gets out of `data`, all members of it, up to where it breaks off; `data` if that is nothing."""
    for bits in windows:
        out, rest = [], data
        try:
            while rest:
                z = zlib.decompressobj(bits)
                for at in range(0, len(rest), 1 << 16):  # so that a broken end doesn't take the rest along
                    out.append(z.decompress(rest[at : at + (1 << 16)]))
                    if z.eof:
                        rest = z.unused_data + rest[at + (1 << 16) :]
                        break
                else:
                    break
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return data


def _decoded(data: bytes, codings: str) -> bytes:
    """`data` without the codings that a header names, the last one first. Unknown ones stay."""
    for coding in reversed([x.strip().lower() for x in codings.split(",")]):
        if coding == "chunked":
            data = _unchunked(data)
        elif coding in ("gzip", "x-gzip"):
            data = _inflated(data, 31)
        elif coding == "deflate":
            data = _inflated(data, 15, -15)
        elif coding not in ("", "identity"):
            break
    return data


def derived(number: int | None, name: str, target: str, date: str, head: str, block: bytes) -> list[tuple]:
    """The metadata and the conversion record (rows of DERIVED) of one response.

    Digests that the response's headers state are kept; those that they lack are computed. Bytes that
    don't fit the charset become U+FFFD. A block without an HTTP head is all payload. Chunks, gzip and
    deflate that the HTTP head names are undone; the payload whose digest is computed has lost its chunks.
    """
    http, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    status, *lines = http.decode("latin-1").split("\r\n")
    source = {k.lower(): v for k, v in _fields(head)}
    fields = _fields("\r\n".join(["", *lines]))
    said = lambda name: ",".join(v for k, v in fields if k.lower() == name)
    kind = next((v for k, v in fields if k.lower() == "content-type"), "")
    payload = _decoded(payload, said("transfer-encoding"))
    body = _decoded(payload, said("content-encoding"))
    charset = _CHARSET.search(kind)
    try:
        page = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body.decode("utf-8", "replace")
    block_digest, payload_digest = source.get("warc-block-digest") or digest(block), source.get("warc-payload-digest") or digest(payload)
    found = Elements(page)
    targets = dict.fromkeys(html.unescape(x.strip("\"'")).strip() for x in links(page))
    out = []
    for record_type, content_type, content in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in [
            ("http-status", status), *((f"http-header-{k.lower()}", v) for k, v in fields),
            ("source-record-id", name), ("source-block-digest", block_digest), ("source-payload-digest", payload_digest),
            *([("title", html.unescape(found.title))] if found.title is not None else []), *(("outlink", _joined(target, x)) for x in targets if x),
        ])),
        ("conversion", "text/plain; charset=utf-8", plain_text(page, found)),
    ):
        data = content.encode("utf-8", "replace")
        own = record_id(record_type, name)
        named = [
            ("WARC-Type", record_type), ("WARC-Record-ID", own), ("WARC-Refers-To", name),
            ("WARC-Refers-To-Target-URI", target), ("WARC-Refers-To-Date", date), ("WARC-Target-URI", target), ("WARC-Date", date),
            *((k, source[k.lower()]) for k in ("WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type") if k.lower() in source),
            *([("WARC-Concurrent-To", record_id("conversion", name))] if record_type == "metadata" else []),
            ("Content-Type", content_type), ("WARC-Block-Digest", digest(data)), ("Content-Length", str(len(data))),
        ]
        out.append((number, record_type, own, name, target, date, content_type, len(data), digest(data), payload_digest, block_digest, _head(named), content))
    return out


def _joined(base: str, link: str) -> str:
    try:
        return urljoin(base, link)
    except ValueError:
        return link


def derive(records: DataFrame) -> DataFrame:
    """DERIVED rows, two for each row of `records` (RESPONSE). Null fields count as empty; an empty page
    gives an empty conversion. Repeated responses give repeated records, with the same names. An empty
    table gives an empty table."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                rows = [
                    x
                    for number, name, target, date, head, block in zip(*(c.to_pylist() for c in part.columns))
                    for x in derived(number, name or "", target or "", date or "", head or "", block or b"")
                ]
                columns = list(zip(*rows)) or [()] * 13
                kinds = [pa.int64(), *[pa.string()] * 6, pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in DERIVED.split(", ")])

    columns = [x.split()[0] for x in RESPONSE.split(", ")]
    return records.select(*columns).mapInArrow(of, DERIVED)


def serialised(headers: str, block: bytes) -> bytes:
    """A record as it stands in a WARC file."""
    return headers.encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], str, bytes]]:
    """(fields in lower case, head, block) of the records of a WARC file, given as what stands between
    its _BETWEEN. A block that holds _BETWEEN itself is put together again by its length; one that its
    file cuts short keeps what there is."""
    held, need = b"", 0
    for piece in pieces:
        if need > len(held) and not piece.startswith(b"WARC/"):  # which only a file begins with
            held += _BETWEEN + piece
        else:
            if held:
                yield _record(held)
            held = piece
        head = held.find(b"\r\n\r\n")
        size = re.search(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)", held[:head] if head >= 0 else held)
        need = head + 4 + int(size[1]) if size and head >= 0 else 0
    if held:
        yield _record(held)


_BETWEEN = b"\r\n\r\nWARC/1."


def _record(data: bytes) -> tuple[dict[str, str], str, bytes]:
    head, _, block = data.partition(b"\r\n\r\n")
    head = (b"" if head.startswith(b"WARC/") else b"WARC/1.") + head + b"\r\n"
    text = head.decode("utf-8", "replace")
    fields = {k.lower(): v for k, v in _fields(text)}
    size = fields.get("content-length", "")
    return fields, text, block[: int(size)] if size.isdigit() else block


def read_responses(spark, path: str) -> DataFrame:
    """RESPONSE records of WARC files, plain or compressed by a codec that Spark reads by the file's name.
    Files are read as a stream, record by record; large plain ones in several tasks.

    Header names may have any case. A record whose block holds the beginning of another record is whole
    in a compressed file; in a plain one it is cut where a task's share of the file ends in it.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.string()] * 4, pa.binary()))], names=[x.split()[0] for x in RESPONSE.split(", ")])

        rows, size = [], 0
        for f, head, block in parsed(x.as_py() for batch in batches for x in batch.column(0)):
            if f.get("warc-type", "").lower() != "response":
                continue
            rows.append((None, f.get("warc-record-id", ""), f.get("warc-target-uri", ""), f.get("warc-date", ""), head, block))
            size += len(block)
            if size > 1 << 24:
                yield table(rows)
                rows, size = [], 0
        yield table(rows)

    # a file's rows come in order, and a task's rows are parts of whole files or one part of a plain file
    pieces = spark.read.text(path, lineSep=_BETWEEN.decode()).select(F.col("value").cast("binary").alias("value"))
    return pieces.mapInArrow(of, RESPONSE)
