"""Small files of each format, built from table rows, so that what an extractor has to find is known."""

from __future__ import annotations

import base64
import io
import struct
import urllib.parse
import zipfile
import zlib
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame


def archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in {"[Content_Types].xml": "<Types/>", **parts}.items():
            z.writestr(zipfile.ZipInfo(name, (2026, 1, 1, 0, 0, 0)), text)
    return out.getvalue()


def docx(text: str) -> bytes:
    return archive({"word/document.xml": f'<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>'})


def xlsx(text: str) -> bytes:
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>'
    return archive({"xl/workbook.xml": "<w/>", "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": f"<sst><si><t>{escape(text)}</t></si></sst>"})


def pptx(text: str) -> bytes:
    return archive({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": f'<p:sld xmlns:p="p" xmlns:a="a"><p:sp><a:p><a:r><a:t>{escape(text)}</a:t></a:r></a:p></p:sp></p:sld>'})


def vsdx(text: str) -> bytes:
    return archive({"visio/document.xml": "<v/>", "visio/pages/page1.xml": f'<PageContents><Shapes><Shape ID="7"><Text>{escape(text)}</Text></Shape></Shapes></PageContents>'})


def drawio(text: str, packed: bool) -> bytes:
    cells = f'<mxGraphModel><root><mxCell id="1" value="{escape(text)}"/></root></mxGraphModel>'
    if not packed:
        return cells.encode()
    z = zlib.compressobj(9, zlib.DEFLATED, -15)
    body = base64.b64encode(z.compress(urllib.parse.quote(cells).encode()) + z.flush()).decode()
    return f"<mxfile><diagram>{body}</diagram></mxfile>".encode()


def gif(frames: int) -> bytes:
    frame = b"!\xf9\x04\x00\x0a\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00"
    return b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff" + frame * frames + b";"


def msg(properties: dict[str, str]) -> bytes:
    """A compound file of one message: properties by their number; short ones in the small store, those from 4,096 bytes on in sectors of their own."""
    streams = [(f"__substg1.0_{k}001F", v.encode("utf-16-le")) for k, v in properties.items()]
    store, minifat, entries, large = b"", [], [], []
    for name, data in streams:
        if len(data) >= 4096:
            large.append((name, data))
            continue
        n = max(1, -(-len(data) // 64))
        entries.append((name, 2, len(minifat), len(data)))
        minifat += [len(minifat) + i + 1 for i in range(n - 1)] + [-2]
        store += data.ljust(64 * n, b"\0")
    blocks: list[bytes] = []  # sectors after the first, which is the table of sectors
    fat = [-3]

    def put(data: bytes) -> int:
        at, n = len(fat), max(1, -(-len(data) // 512))
        blocks.append(data.ljust(512 * n, b"\0"))
        fat.extend([at + i + 1 for i in range(n - 1)] + [-2])
        return at

    small = put(struct.pack(f"<{len(minifat)}i", *minifat).ljust(512, b"\xff"))
    root = put(store)
    entries += [(name, 2, put(data), len(data)) for name, data in large]
    rows = b""
    for name, kind, start, size in [("Root Entry", 5, root, len(store)), *entries]:
        raw = name.encode("utf-16-le") + b"\0\0"
        rows += raw.ljust(64, b"\0") + struct.pack("<HBBiii", len(raw), kind, 1, -1, -1, -1) + bytes(36) + struct.pack("<iQ", start, size)
    directory = put(rows)
    head = bytes.fromhex("d0cf11e0a1b11ae1") + bytes(16) + struct.pack("<HHHHH6xiiiiIiiii", 0x3E, 3, 0xFFFE, 9, 6, 0, 1, directory, 0, 4096, small, 1, -2, 0) + struct.pack("<109i", 0, *[-1] * 108)
    return head + struct.pack(f"<{len(fat)}i", *fat).ljust(512, b"\xff") + b"".join(blocks)


def pdf(pages: list[list[str]], packed: bool, objects: bool = False) -> bytes:
    """Pages of lines; packed: Flate streams; objects: dictionaries in an object stream."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    dicts = {1: "<< /Type /Catalog /Pages 2 0 R >>", 2: f"<< /Type /Pages /Kids [{kids}] /Count {len(pages)} >>"}
    streams = {}
    for i, lines in enumerate(pages):
        dicts[3 + 2 * i] = f"<< /Type /Page /Parent 2 0 R /Contents {4 + 2 * i} 0 R >>"
        said = "".join(("(" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj 0 -14 Td\n") for t in lines)
        streams[4 + 2 * i] = f"BT /F1 12 Tf 72 700 Td\n{said}ET".encode("cp1252")
    out = bytearray(b"%PDF-1.7\n")

    def put(number: int, head: str, body: bytes | None = None) -> None:
        out.extend(f"{number} 0 obj\n{head}".encode())
        if body is not None:
            out.extend(b"\nstream\n" + body + b"\nendstream")
        out.extend(b"\nendobj\n")

    def stream(number: int, body: bytes, more: str = "") -> None:
        body = zlib.compress(body) if packed else body
        put(number, f"<< {more}/Length {len(body)}{' /Filter /FlateDecode' if packed else ''} >>", body)

    if objects:
        texts, heads = b"", []
        for k, v in dicts.items():
            heads += [str(k), str(len(texts))]
            texts += v.encode() + b" "
        first = (" ".join(heads) + " ").encode()
        stream(1000, first + texts, f"/Type /ObjStm /N {len(dicts)} /First {len(first)} ")
    else:
        for k, v in dicts.items():
            put(k, v)
    for k, v in streams.items():
        stream(k, v)
    return bytes(out + b"%%EOF\n")


def office_file(kind: str, text: str) -> bytes:
    return {"docx": docx, "xlsx": xlsx, "pptx": pptx, "vsdx": vsdx, "drawio": lambda t: drawio(t, False), "drawio-packed": lambda t: drawio(t, True), "pdf": lambda t: pdf([[t, "(second) line"], ["page two"]], False), "pdf-packed": lambda t: pdf([[t, "(second) line"], ["page two"]], True, True), "msg": lambda t: msg({"0037": t, "0C1A": "ann@example.org", "1000": f"Body of {t}"}), "msg-long": lambda t: msg({"0037": t, "0C1A": "ann@example.org", "1000": f"Body of {t}" + "x" * 3000})}[kind](text)


def built(rows: DataFrame) -> DataFrame:
    """source_id, filename, content of files of a kind that hold a text; rows: source_id, kind, text. The name tells nothing of the kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, texts = b.column(1).to_pylist(), b.column(2).to_pylist()
            content = [gif(int(t)) if k == "gif" else office_file(k, t) for k, t in zip(kinds, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["file.bin"] * len(kinds), pa.string()), pa.array(content, pa.binary())], ["source_id", "filename", "content"])

    return rows.select("source_id", "kind", "text").mapInArrow(run, "source_id string, filename string, content binary")
