"""A reader for the text of PDF files: objects, Flate streams, pages in order, and where their text stands.

Covers files whose objects stand in the open or in object streams, uncompressed or
Flate-compressed (with PNG predictors), and text in single-byte encodings or with a ToUnicode map.
Anything else is an error of the caller's choosing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b")
TOKEN = re.compile(rb"%[^\r\n]*|<<|>>|\[|\]|\{|\}|/[^\s()<>\[\]{}/%]*|\(|<[0-9A-Fa-f\s]*>|[^\s()<>\[\]{}/%]+")
ESCAPES = {ord("n"): 10, ord("r"): 13, ord("t"): 9, ord("b"): 8, ord("f"): 12}
MOST_EXPANDED = 100_000_000


class Malformed(Exception):
    pass


class Name(str):
    """A name, apart from an operator."""


class Ref(int):
    """A reference to an object."""


def literal(raw: bytes, at: int) -> tuple[bytes, int]:
    """The string that begins after a parenthesis, and the place behind it."""
    out, depth = bytearray(), 1
    while at < len(raw):
        c = raw[at]
        at += 1
        if c == 92 and at < len(raw):
            d = raw[at]
            at += 1
            if 48 <= d <= 55:
                m = re.compile(rb"[0-7]{1,3}").match(raw, at - 1)
                out.append(int(m[0], 8) & 255)
                at = m.end()
            elif d == 13 and raw[at : at + 1] == b"\n":
                at += 1
            elif d not in (10, 13):
                out.append(ESCAPES.get(d, d))
            continue
        depth += (c == 40) - (c == 41)
        if not depth:
            return bytes(out), at
        out.append(c)
    raise Malformed("a string does not end")


def tokens(raw: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """(token, place behind it): strings as bytes, names as Name, numbers, marks and operators as text."""
    while m := TOKEN.search(raw, at):
        word, at = m[0], m.end()
        if word == b"(":
            value, at = literal(raw, at)
        elif word[:1] == b"%":
            continue
        elif word[:1] == b"/":
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), word[1:]).decode("latin-1"))
        elif word[:1] == b"<" and word != b"<<":
            digits = re.sub(rb"\s", b"", word[1:-1])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif re.fullmatch(rb"[-+]?\d+", word):
            value = int(word)
        elif re.fullmatch(rb"[-+]?(\d+\.\d*|\.\d+)", word):
            value = float(word)
        else:
            value = word.decode("latin-1")
        yield value, at


def inner(stream: Iterator[tuple[object, int]], until: str, depth: int) -> tuple[list, int]:
    """The values up to a closing mark, and the place behind it."""
    if depth > 64:
        raise Malformed("nested too deeply")
    out: list = []
    at = 0
    for word, at in values(stream, depth):
        if type(word) is str and word == until:
            return out, at
        out.append(word)
    raise Malformed("a value does not end")


def values(stream: Iterator[tuple[object, int]], depth: int = 0) -> Iterator[tuple[object, int]]:
    """Whole values (dictionaries, arrays, references) and operators, each as soon as it is whole. Nesting has a bound."""
    held: list[tuple[int, int]] = []  # numbers that may turn out to begin a reference
    for word, at in stream:
        if type(word) is int:
            if len(held) == 2:
                yield held.pop(0)
            held.append((word, at))
            continue
        if type(word) is str and word == "R" and len(held) == 2:
            number = Ref(held[0][0])
            held.clear()
            yield number, at
            continue
        yield from held
        held.clear()
        if type(word) is str and word == "<<":
            flat, at = inner(stream, ">>", depth + 1)
            word = dict(zip(flat[::2], flat[1::2], strict=False))
        elif type(word) is str and word == "[":
            word, at = inner(stream, "]", depth + 1)
        yield word, at
    yield from held


class Document:
    """The objects of a file by number, read when they are asked for."""

    def __init__(self, raw: bytes):
        self.raw, self.known, self.packed, self.expanded = raw, {}, {}, 0
        self.places = {int(m[1]): m.end() for m in OBJECT.finditer(raw)}
        for number in list(self.places):
            d = self.get(number)
            if isinstance(d, tuple) and d[0].get("Type") == "ObjStm":
                body, first = self.stream(d), self.of(d[0].get("First"))
                heads = [v for v, _ in tokens(body[:first])]
                for k, offset in zip(heads[::2], heads[1::2], strict=False):
                    if k not in self.places:
                        self.packed[k] = next(values(tokens(body, first + offset)))[0]

    def get(self, number: int):
        """A value, or (dictionary, place) of a stream; None if it isn't there."""
        if number in self.packed:
            return self.packed[number]
        if number not in self.places:
            return None
        if number not in self.known:
            value, at = next(values(tokens(self.raw, self.places[number])), (None, 0))
            m = re.compile(rb"\s*stream(\r\n|\n|\r)").match(self.raw, at) if isinstance(value, dict) else None
            self.known[number] = (value, m.end()) if m else value
        return self.known[number]

    def of(self, v):
        """A value behind references."""
        for _ in range(16):
            if not isinstance(v, Ref):
                return v
            v = self.get(v)
        raise Malformed("references without an end")

    def stream(self, s: tuple) -> bytes:
        head, at = s
        size = self.of(head.get("Length"))
        if not isinstance(size, int) or self.raw[at + size : at + size + 20].lstrip()[:9] != b"endstream":
            size = self.raw.find(b"endstream", at) - at
        if size < 0:
            raise Malformed("a stream does not end")
        data = self.raw[at : at + size]
        filters, parms = ([x] if not isinstance(x, list) else x for x in (self.of(head.get("Filter", [])), self.of(head.get("DecodeParms", {}))))
        for i, f in enumerate(filters):
            if f not in ("FlateDecode", "Fl"):
                raise Malformed(f"a filter {f}")
            unpack = zlib.decompressobj()
            data = unpack.decompress(data, MOST_EXPANDED - self.expanded)
            self.expanded += len(data)
            if unpack.unconsumed_tail:
                raise OverflowError("the file expands beyond its limit")
            p = self.of(parms[i]) if i < len(parms) else {}
            if isinstance(p, dict) and p.get("Predictor", 1) >= 10:
                data = unpredicted(data, p.get("Columns", 1) * p.get("Colors", 1) * p.get("BitsPerComponent", 8) // 8)
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in the order of the page tree, with what they inherit."""
        roots = [d for k in {*self.places, *self.packed} if isinstance(d := self.get(k), dict) and d.get("Type") == "Catalog"]
        if not roots:
            raise Malformed("no catalog")
        out, todo, seen = [], [(roots[-1].get("Pages"), {})], set()
        while todo:
            ref, above = todo.pop()
            node = self.of(ref)
            if not isinstance(node, dict) or (isinstance(ref, Ref) and ref in seen):
                raise Malformed("a page tree that is none")
            seen.add(ref)
            own = above | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(k, own) for k in reversed(self.of(node["Kids"]))]
            else:
                out.append(own | node)
        return out


def unpredicted(data: bytes, width: int) -> bytes:
    """PNG rows of one byte a sample without their predictors."""
    out, above = bytearray(), bytes(width)
    for at in range(0, len(data) - width, width + 1):
        kind, row = data[at], bytearray(data[at + 1 : at + 1 + width])
        for i in range(width):
            left, up, corner = (row[i - 1] if i else 0), above[i], (above[i - 1] if i else 0)
            if kind == 4:
                p = left + up - corner
                best = min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]
            row[i] = (row[i] + {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: best if kind == 4 else 0}[kind]) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def to_unicode(cmap: bytes) -> dict[int, str]:
    """Codes of a ToUnicode map; ranges of it are followed."""
    out: dict[int, str] = {}
    text = lambda b: b.decode("utf-16-be", "replace")
    for kind, body in re.findall(rb"begin(bfchar|bfrange)(.*?)endbf", cmap, re.S):
        flat = [v for v, _ in values(tokens(body))]
        if kind == b"bfchar":
            out |= {int.from_bytes(a, "big"): text(b) for a, b in zip(flat[::2], flat[1::2], strict=False)}
            continue
        for a, b, c in zip(flat[::3], flat[1::3], flat[2::3], strict=False):
            lo, hi = int.from_bytes(a, "big"), int.from_bytes(b, "big")
            for i in range(min(hi - lo + 1, 65_536)):
                out[lo + i] = text(c[i]) if isinstance(c, list) else text((int.from_bytes(c, "big") + i).to_bytes(len(c), "big"))
    return out


def shown(raw: bytes, table: dict[int, str] | None) -> str:
    if not table:
        return raw.decode("cp1252", "replace")
    wide = 2 if max(table) > 255 else 1
    return "".join(table.get(int.from_bytes(raw[i : i + wide], "big"), "�") for i in range(0, len(raw), wide))


def page_blocks(doc: Document, page: dict) -> Iterator[tuple[float, float, str]]:
    """(x, y, text) of each line of a page, where a line is what is shown between moves to another baseline."""
    parts = doc.of(page.get("Contents"))
    parts = [doc.of(p) for p in (parts if isinstance(parts, list) else [parts] if parts else [])]
    body = b"\n".join(doc.stream(p) for p in parts if isinstance(p, tuple))
    fonts = doc.of((doc.of(page.get("Resources")) or {}).get("Font")) or {}
    tables: dict[str, dict | None] = {}
    for k, v in fonts.items():
        cmap = (doc.of(v) or {}).get("ToUnicode")
        tables[k] = to_unicode(doc.stream(doc.of(cmap))) if cmap is not None else None
    x = y = lead = 0.0
    table, line, at = None, [], None
    args: list = []
    for word, _ in values(tokens(body)):
        if type(word) is not str:
            args.append(word)
            continue
        move = None
        if word == "BT":
            x = y = 0.0
            move = (x, y)
        elif word == "Tf" and len(args) >= 2:
            table = tables.get(args[-2])
        elif word == "TL" and args:
            lead = float(args[-1])
        elif word in ("Td", "TD") and len(args) >= 2:
            lead = -float(args[-1]) if word == "TD" else lead
            move = (x + float(args[-2]), y + float(args[-1]))
        elif word == "Tm" and len(args) >= 6:
            move = (float(args[-2]), float(args[-1]))
        elif word in ("T*", "'", '"'):
            move = (x, y - lead)
        if move:
            if line and move[1] != y:
                yield (*at, "".join(line))
                line = []
            x, y = move
        if word in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
            said = shown(args[-1], table)
        elif word == "TJ" and args and isinstance(args[-1], list):
            said = "".join(shown(v, table) if isinstance(v, bytes) else " " if isinstance(v, (int, float)) and v < -200 else "" for v in args[-1])
        else:
            said = ""
        if said:
            at = at if line else (x, y)
            line.append(said)
        if word == "ET" and line:
            yield (*at, "".join(line))
            line = []
        args = []
