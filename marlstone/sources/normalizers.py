"""Bytes to evidence units: a table function by format, with limits and quarantine.

``normalize`` takes rows (source_id, filename, content) and gives a row a unit; a
document that breaks a limit or is unsafe gives one row with its quarantine code and no
units. Text and Markdown lines also have native operators (``line_units``,
``markdown_units``), which need no Python. The extractors' unit order and ids are this
package's own.
"""

from __future__ import annotations

import base64
import csv
import email
import email.policy
import hashlib
import html
import html.parser
import io
import json
import re
import resource
import signal
import threading
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import short_id
from marlstone.operators.spans import carried
from marlstone.operators.stage import spread
from marlstone.sources import pdf

# Limits of one document, and extensions and locator kinds by format.
LIMITS = {"source_bytes": 25_000_000, "expanded_bytes": 100_000_000, "pages": 500, "sheets": 100, "rows": 100_000, "slides": 500, "shapes": 50_000, "frames": 500, "depth": 256, "processing_ms": 30_000, "output_bytes": 50_000_000, "memory_bytes": 512 << 20}
FORMATS = {
    "markdown": ((".md",), ("line-range", "heading")), "text": ((".txt",), ("line-range",)), "csv": ((".csv",), ("row", "cell", "range")), "pdf": ((".pdf",), ("page", "page-bbox")),
    "docx": ((".docx",), ("part-paragraph", "part-table")), "xlsx": ((".xlsx",), ("sheet-cell", "sheet-range")), "pptx": ((".pptx",), ("slide", "slide-shape")), "vsdx": ((".vsdx",), ("visio-page", "visio-shape")),
    "drawio": ((".drawio",), ("diagram-cell",)), "gif": ((".gif",), ("frame", "time-range")), "html": ((".html", ".htm", ".xhtml"), ("dom-path",)), "msg": ((".msg",), ("header", "mime-part")), "eml": ((".eml",), ("header", "mime-part")),
}
SCHEMA = "source_id string, source_hash string, format string, status string, code string, unit_id string, `order` long, kind string, locator string, text string, structured_data string"
SAMPLE_ROWS = 1000


class Quarantine(Exception):
    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def sniff(raw: bytes, filename: str) -> str:
    """The format: content signatures come before the extension."""
    if raw[:5] == b"%PDF-":
        return "pdf"
    if raw[:6] in (b"GIF87a", b"GIF89a"):
        return "gif"
    if raw[:8] == bytes.fromhex("d0cf11e0a1b11ae1"):
        return "msg"
    if raw[:4] == b"PK\3\4":
        try:
            names = set(zipfile.ZipFile(io.BytesIO(raw)).namelist())
        except zipfile.BadZipFile:
            raise Quarantine("malformed") from None
        for part, fmt in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("visio/document.xml", "vsdx")):
            if part in names:
                return fmt
        raise Quarantine("unsupported")
    if re.match(rb"\s*<mxfile|\s*<mxGraphModel", raw):
        return "drawio"
    for fmt, (extensions, _) in FORMATS.items():
        if filename.lower().endswith(extensions):
            return fmt
    raise Quarantine("unsupported")


def utf8(raw: bytes) -> str:
    try:
        return raw.decode("utf-8-sig", "strict")
    except UnicodeDecodeError:
        raise Quarantine("malformed") from None


def lines(kind: str, start: int, end: int) -> dict:
    return {"kind": kind, "start_line": start, "end_line": end}


def text_units(raw: bytes) -> Iterator[tuple]:
    for i, line in enumerate(re.split(r"\r\n|\r|\n", utf8(raw)), 1):
        yield "line", lines("line-range", i, i), line, None


def markdown_units_of(raw: bytes) -> Iterator[tuple]:
    rows, heading, i = re.split(r"\r\n|\r|\n", utf8(raw)), None, 0
    if rows and rows[0] == "---" and "---" in rows[1:]:
        i = rows.index("---", 1) + 1
        yield "frontmatter", lines("line-range", 1, i), "\n".join(rows[1 : i - 1]), None
    while i < len(rows):
        if m := re.match(r"(#{1,6})\s+(.*?)\s*#*$", rows[i]):
            heading = m[2]
            yield "heading", {"kind": "heading", "line": i + 1, "text": heading}, heading, {"level": len(m[1])}
            i += 1
        elif m := re.match(r"\s*(`{3,}|~{3,})\s*(\S*)", rows[i]):
            end = next((j for j in range(i + 1, len(rows)) if re.match(rf"\s*{re.escape(m[1][0])}{{3,}}\s*$", rows[j])), len(rows))
            yield "code-fence", lines("line-range", i + 1, min(end + 1, len(rows))), "\n".join(rows[i + 1 : end]), {"language": m[2], "heading": heading}
            i = end + 1
        elif rows[i].strip():
            end = i
            while end < len(rows) and rows[end].strip() and not re.match(r"#{1,6}\s|\s*(`{3,}|~{3,})", rows[end]):
                end += 1
            block = rows[i:end]
            kind = "table" if len(block) > 1 and all("|" in r for r in block) else "paragraph"
            yield kind, lines("line-range", i + 1, end), "\n".join(block), {"heading": heading}
            i = end
        else:
            i += 1


def csv_units(raw: bytes, delimiter: str = ",") -> Iterator[tuple]:
    if len(delimiter) != 1:
        raise Quarantine("invalid-settings")
    rows = []
    for row in csv.reader(io.StringIO(utf8(raw)), delimiter=delimiter, strict=True):
        rows.append(row)
        if len(rows) > LIMITS["rows"]:
            raise Quarantine("limit-exceeded")
    kinds = [candidate([r[c] for r in rows[1:] if c < len(r)]) for c in range(len(rows[0]) if rows else 0)]
    yield "range", {"kind": "range", "start_row": 1, "end_row": len(rows)}, None, {"row_count": len(rows), "columns": rows[0] if rows else [], "types": kinds, "sample_rows": rows[1 : 1 + SAMPLE_ROWS], "partial": len(rows) - 1 > SAMPLE_ROWS}


def candidate(values: list[str]) -> str:
    for name, pattern in (("integer", r"[-+]?\d+"), ("number", r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"), ("boolean", r"(?i:true|false)"), ("date", r"\d{4}-\d\d-\d\d")):
        if values and all(re.fullmatch(pattern, v) for v in values):
            return name
    return "string"


class Page(html.parser.HTMLParser):
    """Headings, paragraphs, list items, table rows and safe links with their place in the tree."""

    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    SILENT = {"script", "style", "template", "noscript", "iframe", "object"}
    BLOCKS = {"p": "paragraph", "li": "list-item", **{f"h{i}": "heading" for i in range(1, 7)}}
    PHRASING = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
    # paragraphs and items may lack their end tags: the next one ends them, and what is open in them of these
    UNENDED = {"p": PHRASING, "li": PHRASING | {"p"}}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.counts, self.units, self.open, self.row, self.silent = [], [{}], [], [], None, 0
        self.title, self.language = None, None

    def path(self) -> str:
        return "/" + "/".join(f"{t}[{n}]" for t, n in self.stack)

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag in self.UNENDED and next((t for t, _ in reversed(self.stack) if t not in self.UNENDED[tag]), None) == tag:
            self.handle_endtag(tag)
        here = self.counts[-1]
        here[tag] = here.get(tag, 0) + 1
        if tag == "html":
            self.language = attrs.get("lang")
        if tag in self.VOID:
            return
        self.stack.append((tag, here[tag]))
        self.counts.append({})
        if len(self.stack) > LIMITS["depth"]:
            raise Quarantine("limit-exceeded")
        if tag in self.SILENT:
            self.silent += 1
        if tag in self.BLOCKS or tag in ("td", "th", "title"):
            self.open.append((tag, self.path(), []))
        if tag == "tr":
            self.row = (self.path(), [])
        if tag == "a" and (to := (attrs.get("href") or "").strip()):
            scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", re.sub(r"[\x00-\x20]", "", to))
            if not self.silent and (not scheme or scheme[1].lower() in ("http", "https", "mailto")):
                self.units.append(("link", self.path(), to, None))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self.VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == tag), None)
        if at is None:
            return
        for name, _ in reversed(self.stack[at:]):
            self.silent -= name in self.SILENT
            if self.open and self.open[-1][0] == name:
                _, path, parts = self.open.pop()
                text = " ".join("".join(parts).split())
                if name == "title":
                    self.title = text
                elif name in ("td", "th"):
                    if self.row:
                        self.row[1].append(text)
                elif text:
                    self.units.append((self.BLOCKS[name], path, text, {"level": int(name[1])} if name[0] == "h" else None))
            if name == "tr" and self.row:
                if self.row[1]:
                    self.units.append(("table-row", self.row[0], " | ".join(self.row[1]), {"cells": self.row[1]}))
                self.row = None
        del self.stack[at:], self.counts[at + 1 :]

    def handle_data(self, data):
        if not self.silent and self.open:
            self.open[-1][2].append(data)


def html_units(raw: bytes) -> Iterator[tuple]:
    page = Page()
    page.feed(utf8(raw))
    page.close()
    for tag, _ in reversed(list(page.stack)):
        page.handle_endtag(tag)
    if not page.units and not page.title:
        raise Quarantine("malformed")
    yield "html-metadata", {"kind": "dom-path", "path": "/html[1]"}, page.title, {"language": page.language}
    for kind, path, text, data in page.units:
        yield kind, {"kind": "dom-path", "path": path}, text, data


def eml_units(raw: bytes, depth: int = 0) -> Iterator[tuple]:
    if depth > 8:
        raise Quarantine("limit-exceeded")
    message = email.message_from_bytes(raw, policy=email.policy.default)
    if not message.keys():
        raise Quarantine("malformed")
    parts = [p for p in message.walk() if not p.is_multipart()]
    yield "email-structure", {"kind": "mime-part", "part": "0"}, None, {"parts": len(parts), "content_type": message.get_content_type()}
    for name in ("from", "to", "cc", "date", "subject", "message-id"):
        if message[name]:
            yield "email-header", {"kind": "header", "name": name}, str(message[name]), None
    for i, part in enumerate(parts, 1):
        body = part.get_payload(decode=True) or b""
        where = {"kind": "mime-part", "part": str(i)}
        if part.get_content_disposition() == "attachment" or part.get_filename():
            yield "email-attachment", where, part.get_filename(), {"content_type": part.get_content_type(), "byte_length": len(body), "content_hash": "sha256:" + hashlib.sha256(body).hexdigest()}
        elif part.get_content_maintype() == "text":
            text = body.decode(part.get_content_charset() or "utf-8", "replace")
            if part.get_content_subtype() == "html":
                text = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"(?is)<(script|style)\b.*?</\1>", " ", text)))
                text = " ".join(text.split())
            yield "email-body", where, text.strip(), {"content_type": part.get_content_type()}


def package(raw: bytes) -> zipfile.ZipFile:
    """An Office package within its limits, without macros and outside references."""
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        total = sum(i.file_size for i in z.infolist())
    except zipfile.BadZipFile:
        raise Quarantine("malformed") from None
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise Quarantine("encrypted")
    if total > LIMITS["expanded_bytes"] or any(i.file_size > 200 * max(i.compress_size, 1) and i.file_size > 1 << 20 for i in z.infolist()):
        raise Quarantine("limit-exceeded")
    if any("vbaProject" in n or n.endswith(".bin") and "embeddings" in n for n in z.namelist()):
        raise Quarantine("unsafe-active-content")
    if "[Content_Types].xml" not in z.namelist():
        raise Quarantine("malformed")
    for n in z.namelist():
        if n.endswith(".rels") and b'TargetMode="External"' in z.read(n):
            raise Quarantine("external-relationship")
    return z


def tree(raw: bytes) -> ET.Element:
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Quarantine("unsafe-active-content")
    try:
        return ET.fromstring(raw)
    except ET.ParseError:
        raise Quarantine("malformed") from None


def local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def texts(e: ET.Element, name: str = "t") -> str:
    return "".join(x.text or "" for x in e.iter() if local(x) == name)


def numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def docx_units(raw: bytes) -> Iterator[tuple]:
    body = next((e for e in tree(package(raw).read("word/document.xml")) if local(e) == "body"), None)
    if body is None:
        raise Quarantine("malformed")
    for i, e in enumerate(body, 1):
        if local(e) == "p" and texts(e):
            yield "paragraph", {"kind": "part-paragraph", "part": "word/document.xml", "index": i}, texts(e), None
        elif local(e) == "tbl":
            cells = [[texts(c) for c in r if local(c) == "tc"] for r in e if local(r) == "tr"]
            yield "table", {"kind": "part-table", "part": "word/document.xml", "index": i}, "\n".join(" | ".join(r) for r in cells), {"cells": cells}


def xlsx_units(raw: bytes) -> Iterator[tuple]:
    z = package(raw)
    shared = [texts(e) for e in tree(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    sheets = numbered(z, r"xl/worksheets/sheet(\d+)\.xml")
    if len(sheets) > LIMITS["sheets"]:
        raise Quarantine("limit-exceeded")
    for k, name in enumerate(sheets, 1):
        rows = [e for e in tree(z.read(name)).iter() if local(e) == "row"]
        if len(rows) > LIMITS["rows"]:
            raise Quarantine("limit-exceeded")
        for row in rows:
            for c in row:
                value = next((x.text for x in c if local(x) == "v"), None)
                value = texts(c) if c.get("t") == "inlineStr" else shared[int(value)] if c.get("t") == "s" and value is not None else value
                formula = next((x.text for x in c if local(x) == "f"), None)
                if value is not None:
                    yield "cell", {"kind": "sheet-cell", "sheet": k, "cell": c.get("r")}, value, {"formula": formula} if formula else None


def pptx_units(raw: bytes) -> Iterator[tuple]:
    z = package(raw)
    slides = numbered(z, r"ppt/slides/slide(\d+)\.xml")
    if len(slides) > LIMITS["slides"]:
        raise Quarantine("limit-exceeded")
    for k, name in enumerate(slides, 1):
        for j, e in enumerate((e for e in tree(z.read(name)).iter() if local(e) == "sp"), 1):
            if text := "\n".join(t for p in e.iter() if local(p) == "p" and (t := texts(p))):
                yield "shape", {"kind": "slide-shape", "slide": k, "shape": j}, text, None


def vsdx_units(raw: bytes) -> Iterator[tuple]:
    z = package(raw)
    for k, name in enumerate(numbered(z, r"visio/pages/page(\d+)\.xml"), 1):
        for e in tree(z.read(name)).iter():
            if local(e) == "Shape" and (text := "".join("".join(x.itertext()) for x in e if local(x) == "Text").strip()):
                yield "shape", {"kind": "visio-shape", "page": k, "shape": e.get("ID")}, text, None


def drawio_units(raw: bytes) -> Iterator[tuple]:
    root = tree(raw)
    for k, d in enumerate([e for e in root.iter() if local(e) == "diagram"] or [root], 1):
        if len(d) == 0 and (d.text or "").strip() and local(d) == "diagram":
            try:
                packed = zlib.decompressobj(-15)
                opened = packed.decompress(base64.b64decode(d.text), LIMITS["expanded_bytes"])
            except (ValueError, zlib.error):
                raise Quarantine("malformed") from None
            if packed.unconsumed_tail:
                raise Quarantine("limit-exceeded")
            d = tree(urllib.parse.unquote_to_bytes(opened))
        for c in d.iter():
            if local(c) in ("mxCell", "UserObject", "object"):
                label = c.get("value") or c.get("label") or ""
                if re.search(r"(?i)<script|javascript:|\bhref\s*=|on\w+\s*=", label) or re.search(r"(?i)^(javascript|https?):", c.get("link") or ""):
                    raise Quarantine("unsafe-active-content")
                where = {"kind": "diagram-cell", "diagram": k, "cell": c.get("id")}
                if c.get("edge") == "1":
                    yield "connector", where, label or None, {"source": c.get("source"), "target": c.get("target")}
                elif label:
                    yield "cell", where, html.unescape(re.sub(r"<[^>]*>", " ", label)).strip(), None


def gif_units(raw: bytes) -> Iterator[tuple]:
    if len(raw) < 13:
        raise Quarantine("malformed")
    at, frame, clock, delay = 13 + (3 * 2 ** ((raw[10] & 7) + 1) if raw[10] & 128 else 0), 0, 0, 0
    try:
        while raw[at] != 0x3B:
            if raw[at] == 0x21:
                if raw[at + 1] == 0xF9:
                    delay = int.from_bytes(raw[at + 4 : at + 6], "little") * 10
                at += 2
            elif raw[at] == 0x2C:
                frame += 1
                if frame > LIMITS["frames"]:
                    raise Quarantine("limit-exceeded")
                size = {"width": int.from_bytes(raw[at + 5 : at + 7], "little"), "height": int.from_bytes(raw[at + 7 : at + 9], "little")}
                yield "frame", {"kind": "frame", "frame": frame}, None, size
                yield "time-range", {"kind": "time-range", "start_ms": clock, "end_ms": clock + delay}, None, None
                clock += delay
                at += 10 + (3 * 2 ** ((raw[at + 9] & 7) + 1) if raw[at + 9] & 128 else 0) + 1
            else:
                raise Quarantine("malformed")
            while raw[at]:
                at += raw[at] + 1
            at += 1
    except IndexError:
        raise Quarantine("malformed") from None
    if not frame:
        raise Quarantine("malformed")


def msg_units(raw: bytes) -> Iterator[tuple]:
    """Streams of a compound file: the message's properties by their names."""
    import struct

    sector, mini = 1 << struct.unpack_from("<H", raw, 30)[0], 1 << struct.unpack_from("<H", raw, 32)[0]
    fat = []
    for s in struct.unpack_from("<109i", raw, 76):
        if s >= 0:
            fat += struct.unpack_from(f"<{sector // 4}i", raw, (s + 1) * sector)

    def chain(start: int, table: list, read) -> bytes:
        out, seen = [], set()
        while start >= 0:
            if start in seen or start >= len(table):
                raise Quarantine("malformed")
            seen.add(start)
            out.append(read(start))
            start = table[start]
        return b"".join(out)

    big = lambda s: raw[(s + 1) * sector : (s + 2) * sector]
    directory = chain(struct.unpack_from("<i", raw, 48)[0], fat, big)
    entries = []
    for k in range(0, len(directory), 128):
        e = directory[k : k + 128]
        if len(e) == 128 and (n := struct.unpack_from("<H", e, 64)[0]):
            entries.append((e[: n - 2].decode("utf-16-le"), e[66], *struct.unpack_from("<i", e, 116), struct.unpack_from("<I", e, 120)[0]))
    names = {e[0] for e in entries}
    if names & {"WordDocument", "Workbook", "Book", "PowerPoint Document"}:
        raise Quarantine("unsupported")
    root = next((e for e in entries if e[1] == 5), None)
    if root is None or not any(n.startswith("__substg1.0_") for n in names):
        raise Quarantine("malformed")
    first = struct.unpack_from("<i", raw, 60)[0]
    table = chain(first, fat, big) if first >= 0 else b""
    minifat = list(struct.unpack(f"<{len(table) // 4}i", table))
    store = chain(root[2], fat, big) if root[2] >= 0 else b""
    small = lambda s: store[s * mini : (s + 1) * mini]
    wanted = {"0037": "subject", "1000": "body", "0C1A": "from", "0E04": "to", "0E03": "cc"}
    yield "email-structure", {"kind": "mime-part", "part": "0"}, None, {"streams": sum(e[1] == 2 for e in entries)}
    for name, kind, start, size in entries:
        m = re.fullmatch(r"__substg1\.0_([0-9A-F]{4})(001F|001E)", name)
        if kind == 2 and m and m[1] in wanted:
            data = (chain(start, fat, big) if size >= 4096 else chain(start, minifat, small))[:size]
            text = data.decode("utf-16-le" if m[2] == "001F" else "cp1252", "replace").rstrip("\0")
            label = wanted[m[1]]
            yield ("email-body" if label == "body" else "email-header"), ({"kind": "mime-part", "part": "1"} if label == "body" else {"kind": "header", "name": label}), text, None


def pdf_units(raw: bytes) -> Iterator[tuple]:
    """A unit a page, and one a line of text with its place; encrypted, active and linking files are told apart, and filters without a reader are unsupported."""
    if b"/Encrypt" in raw:
        raise Quarantine("encrypted")
    if re.search(rb"/(URI|Launch|GoToR|SubmitForm)\b", raw):
        raise Quarantine("external-relationship")
    if re.search(rb"/(JavaScript|JS|OpenAction)\b", raw):
        raise Quarantine("unsafe-active-content")
    if b"%%EOF" not in raw[-2048:]:
        raise Quarantine("malformed")
    try:
        doc = pdf.Document(raw)
        pages = doc.pages()
        if len(pages) > LIMITS["pages"]:
            raise Quarantine("limit-exceeded")
        for i, page in enumerate(pages, 1):
            blocks = list(pdf.page_blocks(doc, page))
            yield "pdf-page", {"kind": "page", "page": i}, "\n".join(t for _, _, t in blocks), {"blocks": len(blocks)}
            for x, y, text in blocks:
                yield "block", {"kind": "page-bbox", "page": i, "x": x, "y": y}, text, None
    except pdf.Malformed as e:
        raise Quarantine("unsupported" if str(e).startswith("a filter") else "malformed") from None
    except OverflowError:
        raise Quarantine("limit-exceeded") from None


EXTRACTORS = {"markdown": markdown_units_of, "text": text_units, "csv": csv_units, "pdf": pdf_units, "docx": docx_units, "xlsx": xlsx_units, "pptx": pptx_units, "vsdx": vsdx_units, "drawio": drawio_units, "gif": gif_units, "html": html_units, "msg": msg_units, "eml": eml_units}


def tightened(limits: dict | None) -> dict:
    """The limits of a document, any of which may be made smaller and none larger."""
    out = dict(LIMITS)
    for k, v in (limits or {}).items():
        if k not in LIMITS or not isinstance(v, int) or not 0 < v <= LIMITS[k]:
            raise ValueError(f"the limit {k} can't be {v}")
        out[k] = v
    return out


@contextmanager
def restricted(limits: dict) -> Iterator[None]:
    """Time and memory for one document, where the worker runs it in its main thread; beyond them it is quarantined and the worker goes on."""
    if threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise Quarantine("limit-exceeded")

    before, kept = signal.signal(signal.SIGALRM, late), resource.getrlimit(resource.RLIMIT_DATA)
    have = int(Path("/proc/self/statm").read_text().split()[5]) * resource.getpagesize() if Path("/proc/self/statm").exists() else None
    signal.setitimer(signal.ITIMER_REAL, limits["processing_ms"] / 1000)
    try:
        if have is not None and (kept[0] == resource.RLIM_INFINITY or have + limits["memory_bytes"] < kept[0]):
            resource.setrlimit(resource.RLIMIT_DATA, (have + limits["memory_bytes"], kept[1]))
        yield
    except MemoryError:
        raise Quarantine("limit-exceeded") from None
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
        resource.setrlimit(resource.RLIMIT_DATA, kept)


def units_of(source_id: str, filename: str, raw: bytes | None, declared_hash: str | None = None, settings: dict | None = None, limits: dict | None = None) -> list[dict]:
    """All units of one document, or one quarantine row."""
    raw, limits = bytes(raw or b""), limits or LIMITS
    digest = "sha256:" + hashlib.sha256(raw).hexdigest()
    base = {"source_id": source_id, "source_hash": digest, "format": None, "status": "quarantined", "code": None, "unit_id": None, "order": None, "kind": None, "locator": None, "text": None, "structured_data": None}
    try:
        if len(raw) > limits["source_bytes"]:
            raise Quarantine("limit-exceeded")
        if declared_hash and declared_hash != digest:
            raise Quarantine("source-hash-mismatch")
        base["format"] = sniff(raw, filename or "")
        extra = {"delimiter": settings["delimiter"]} if base["format"] == "csv" and (settings or {}).get("delimiter") else {}
        out, size = [], 0
        with restricted(limits):
            for i, (kind, locator, text, data) in enumerate(EXTRACTORS[base["format"]](raw, **extra)):
                where = json.dumps(locator, sort_keys=True, ensure_ascii=False)
                more = None if data is None else json.dumps(data, sort_keys=True, ensure_ascii=False)
                size += len((text or "").encode("utf-8", "surrogatepass")) + len((more or "").encode("utf-8", "surrogatepass"))
                if size > limits["output_bytes"]:
                    raise Quarantine("limit-exceeded")
                key = hashlib.sha256(f"{digest}\0{i}\0{kind}\0{where}".encode("utf-8", "surrogatepass")).hexdigest()[:16]
                out.append(base | {"status": "partial" if (data or {}).get("partial") else "complete", "unit_id": f"unit_{key}", "order": i, "kind": kind, "locator": where, "text": text, "structured_data": more})
        return out
    except Quarantine as q:
        return [base | {"code": q.code}]
    except Exception:  # noqa: BLE001 - a document that an extractor can't read is a row, not a failed job
        return [base | {"code": "malformed"}]


COLUMNS = ("source_id", "source_hash", "format", "status", "code", "unit_id", "order", "kind", "locator", "text", "structured_data")
#: Units of one batch to Spark, at about: a batch ends with the document that reaches it.
BATCH_UNITS = 4096


def batched(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"order": pa.int64()}
    clean = lambda v: v.encode("utf-8", "replace").decode() if isinstance(v, str) else v
    return pa.RecordBatch.from_arrays([pa.array([clean(r[c]) for r in rows], kinds.get(c, pa.string())) for c in COLUMNS], list(COLUMNS))


def normalize(files: DataFrame, settings: dict | None = None, limits: dict | None = None) -> DataFrame:
    """Units of every file. files: source_id, filename, content, and declared_hash if it is there; limits (see LIMITS) can only be tightened."""
    declared = F.col("declared_hash") if "declared_hash" in files.columns else F.lit(None).cast("string")
    bounds = tightened(limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for b in batches:
            for r in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                out += units_of(*r, settings, bounds)
                if len(out) >= BATCH_UNITS:
                    yield batched(out)
                    out = []
        if out:
            yield batched(out)

    rows = files.select(F.col("source_id").cast("string").alias("source_id"), "filename", F.col("content").cast("binary").alias("content"), declared.alias("declared_hash"))
    return spread(rows, "source_id").mapInArrow(run, SCHEMA)


# The keys of a request line, and its largest size in bytes.
REQUEST_KEYS = ("id", "filename", "bytes_base64", "source_hash", "delimiter")
MOST_LINE = 40_000_000


def requests(lines: DataFrame) -> DataFrame:
    """Requests as JSON lines (value) to rows for normalize (source_id, filename, content, declared_hash) with error: malformed, unknown-key, too-long or null. A bad line is a row, never a failure."""

    def read(line: str | None) -> tuple:
        if line is None or len(line.encode("utf-8", "surrogatepass")) > MOST_LINE:
            return (None, None, None, None, "malformed" if line is None else "too-long")
        try:
            r = json.loads(line)
            if not isinstance(r, dict):
                raise ValueError("not an object")
            if set(r) - set(REQUEST_KEYS):
                return (str(r.get("id")), None, None, None, "unknown-key")
            return (str(r["id"]), str(r["filename"]), base64.b64decode(r["bytes_base64"], validate=True), r.get("source_hash"), None)
        except (ValueError, KeyError, TypeError):
            return (None, None, None, None, "malformed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [read(x) for x in b.column(0).to_pylist()]
            kinds = (pa.string(), pa.string(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["source_id", "filename", "content", "declared_hash", "error"])

    return lines.select("value").mapInArrow(run, "source_id string, filename string, content binary, declared_hash string, error string")


def descriptors(spark: SparkSession) -> DataFrame:
    """format, extension, locator_kind: what each format accepts and points with."""
    return spark.createDataFrame([(f, e, k) for f, (extensions, kinds) in FORMATS.items() for e in extensions for k in kinds], "format string, extension string, locator_kind string")


def sniffed(files: DataFrame) -> DataFrame:
    """source_id, format (null where none is known): signatures before extensions. Only archives are opened, in Python; the rest is decided on the first bytes."""

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(raw, name):
            try:
                return None if raw is None else sniff(raw, name or "")
            except Quarantine:
                return None

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([one(r, n) for r, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)], pa.string())], ["source_id", "format"])

    head = F.hex(F.substring("content", 1, 8))
    zipped = F.coalesce(head.startswith("504B0304"), F.lit(False))
    by_name = F.lit(None).cast("string")
    for f, (extensions, _) in FORMATS.items():
        for e in extensions:
            by_name = F.when(F.lower("filename").endswith(e), f).otherwise(by_name)
    start = F.regexp_replace(F.decode(F.substring("content", 1, 200), "ISO-8859-1"), r"^\s+", "")
    form = F.when(head.startswith("255044462D"), "pdf").when(head.startswith("474946383761") | head.startswith("474946383961"), "gif").when(head == "D0CF11E0A1B11AE1", "msg").when(start.startswith("<mxfile") | start.startswith("<mxGraphModel"), "drawio").otherwise(by_name)
    plain = files.where(~zipped).select(F.col("source_id").cast("string").alias("source_id"), form.alias("format"))
    return plain.union(files.where(zipped).select(F.col("source_id").cast("string").alias("source_id"), "content", "filename").mapInArrow(inside, "source_id string, format string"))


def portable_manifest(units: DataFrame) -> DataFrame:
    """source_id, source_hash, n_units, manifest_hash: the digest of a document's units in order, as they are written. A document's units are gathered as digests."""
    line = F.sha2(F.to_json(F.struct("kind", "locator", "order", "structured_data", "text", "unit_id")).cast("binary"), 256)
    g = units.where("unit_id is not null").groupBy("source_id", "source_hash").agg(F.array_sort(F.collect_list(F.struct("order", line.alias("d")))).alias("x"))
    return g.select("source_id", "source_hash", F.size("x").cast("long").alias("n_units"), F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform("x", lambda r: r["d"]), "\n").cast("binary"), 256)).alias("manifest_hash"))


def mutated(stored: DataFrame, units: DataFrame) -> DataFrame:
    """source_id, source_hash of stored manifests that the units now don't have: anything was changed, added or taken away."""
    now = portable_manifest(units).select("source_id", "source_hash", F.col("manifest_hash").alias("_now"))
    return stored.join(now, ["source_id", "source_hash"], "left").where(~F.col("manifest_hash").eqNullSafe(F.col("_now"))).select("source_id", "source_hash")


def manifest(units: DataFrame) -> DataFrame:
    """source_id, source_hash, format, status, code, emitted: a row a document."""
    return units.groupBy("source_id", "source_hash", "format").agg(F.min(F.when(F.col("status") == "complete", "z").otherwise(F.col("status"))).alias("s"), F.max("code").alias("code"), F.count("unit_id").alias("emitted")).select("source_id", "source_hash", "format", F.when(F.col("s") == "z", "complete").otherwise(F.col("s")).alias("status"), "code", "emitted")


def csv_whole(units: DataFrame, source: Column) -> DataFrame:
    """source_id, status, row_count, sampled: the range units of a table that is several files with a header each, as one. source: the table that a unit belongs to.

    A file in quarantine quarantines the table, whose counts are null then.
    """
    data = lambda p: F.get_json_object("structured_data", p)
    each = units.select(source.alias("source_id"), "status", (data("$.row_count").cast("long") - 1).alias("rows"), F.json_array_length(data("$.sample_rows")).alias("sample"))
    whole = each.groupBy("source_id").agg(F.bool_or(F.col("status") == "quarantined").alias("bad"), F.sum("rows").alias("rows"), F.sum("sample").alias("sample"))
    status = F.when(F.col("bad"), "quarantined").when(F.col("rows") > SAMPLE_ROWS, "partial").otherwise("complete")
    count = lambda c: F.when(~F.col("bad"), c)
    return whole.select("source_id", status.alias("status"), count(F.col("rows") + 1).alias("row_count"), count(F.least("sample", F.lit(SAMPLE_ROWS))).alias("sampled"))


def line_units(docs: DataFrame, source: str, text: str) -> DataFrame:
    """source_id, unit_id, line, text: a unit a line, with columns only."""
    rows = docs.select(F.col(source).cast("string").alias("source_id"), F.posexplode(F.split(F.regexp_replace(text, r"\r\n?", "\n"), "\n")).alias("p", "text"))
    return rows.select("source_id", short_id("unit", F.col("source_id"), F.col("p").cast("string")).alias("unit_id"), (F.col("p") + 1).alias("line"), "text")


def headings(units: DataFrame) -> DataFrame:
    """Each line unit with the last Markdown heading before it."""
    title = F.when(F.col("text").rlike(r"^#{1,6}\s"), F.regexp_replace("text", r"^#+\s+", ""))
    return carried(units, ["source_id"], ["line"], title, "heading")


def with_probabilistic(units: DataFrame, model_units: DataFrame, allowed: DataFrame) -> DataFrame:
    """Deterministic and model units in one frame with their mode; a model unit needs its model and an allowed locator kind (format, kind)."""
    good = model_units.where("model is not null").withColumn("locator_kind", F.get_json_object("locator", "$.kind")).join(F.broadcast(allowed.withColumnRenamed("kind", "locator_kind")), ["format", "locator_kind"], "left_semi").drop("locator_kind")
    return units.withColumn("mode", F.lit("deterministic")).withColumn("model", F.lit(None).cast("string")).unionByName(good.withColumn("mode", F.lit("probabilistic")), allowMissingColumns=True)


def write_portable(units: DataFrame, path: str) -> None:
    """Accepted units by source and hash as JSON lines; quarantined documents apart."""
    portable_manifest(units).write.mode("errorifexists").json(f"{path}/manifests")
    units.where("code is null").write.mode("errorifexists").partitionBy("source_id", "source_hash").json(f"{path}/normalized")
    units.where("code is not null").select("source_id", "source_hash", "format", "code").write.mode("errorifexists").json(f"{path}/quarantine")
