"""Text of office files: OOXML and HWPX out of their XML parts, PDF out of its content streams. Standard library only.

What cannot be read, or unpacks to more than ``MOST`` bytes, gives null: a damaged or hostile file costs its own text and no task.
Files are read a row at a time where they lie; extractors are functions of a column for ``operators.documents.extracted``.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that the parts of one file may unpack to.
MOST = 256 << 20


# XML in archives --------------------------------------------------------------------------------------------------------------


def _parts(raw: bytes, pattern: str) -> Iterator[bytes]:
    """Members whose name matches, in the order of the numbers in their names."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [i for i in z.infolist() if re.fullmatch(pattern, i.filename)]
        if sum(i.file_size for i in names) > MOST:
            raise ValueError("too large")
        for i in sorted(names, key=lambda i: [int(x) for x in re.findall(r"\d+", i.filename)]):
            yield z.read(i)


def _paragraphs(xml: bytes, block: str, text: str, marks: dict[str, str]) -> Iterator[str]:
    """The text of each ``block`` element, by local names; ``marks`` are elements that stand for characters. Parsed as a stream."""
    depth, out = 0, []
    for event, e in ElementTree.iterparse(io.BytesIO(xml), ("start", "end")):
        name = e.tag.rpartition("}")[2]
        if event == "start":
            if name == block:
                depth += 1
            continue
        if name == text and depth:
            out.append(e.text or "")
        elif name in marks and depth:
            out.append(marks[name])
        elif name == block:
            depth -= 1
            if not depth:
                yield "".join(out)
                out = []
                e.clear()


def docx(raw: bytes) -> str:
    """Paragraphs of the body as lines."""
    return "\n".join(p for xml in _parts(raw, r"word/document\.xml") for p in _paragraphs(xml, "p", "t", {"tab": "\t", "br": "\n", "cr": "\n"}))


def pptx(raw: bytes) -> str:
    """Paragraphs of the slides in order."""
    return "\n".join(p for xml in _parts(raw, r"ppt/slides/slide\d+\.xml") for p in _paragraphs(xml, "p", "t", {"br": "\n"}))


def hwpx(raw: bytes) -> str:
    """Paragraphs of the sections in order."""
    return "\n".join(p for xml in _parts(raw, r"Contents/section\d+\.xml") for p in _paragraphs(xml, "p", "t", {"lineBreak": "\n", "tab": "\t"}))


def xlsx(raw: bytes) -> str:
    """Rows of the sheets in order, a line each, cells between tabs; empty cells before a row's last one are kept."""
    shared = [s for xml in _parts(raw, r"xl/sharedStrings\.xml") for s in _paragraphs(xml, "si", "t", {})]
    lines = []
    for xml in _parts(raw, r"xl/worksheets/sheet\d+\.xml"):
        cells: dict[int, str] = {}
        for _, e in ElementTree.iterparse(io.BytesIO(xml)):
            name = e.tag.rpartition("}")[2]
            if name == "c":
                value = next((x.text or "" for x in e if x.tag.rpartition("}")[2] == "v"), "")
                if e.get("t") == "s" and value:
                    value = shared[int(value)]
                elif e.get("t") == "inlineStr":
                    value = "".join(x.text or "" for x in e.iter() if x.tag.rpartition("}")[2] == "t")
                letters = re.match(r"[A-Z]*", e.get("r", ""))[0]
                at = len(cells)
                if letters:
                    at = 0
                    for c in letters:
                        at = at * 26 + ord(c) - 64
                    at -= 1
                cells[at] = value
            elif name == "row":
                lines.append("\t".join(cells.get(k, "") for k in range(max(cells, default=-1) + 1)))
                cells = {}
                e.clear()
    return "\n".join(lines)


# PDF --------------------------------------------------------------------------------------------------------------------------

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _plain(body: bytes) -> bytes:
    """An object's stream, unpacked."""
    m = _STREAM.search(body)
    if not m:
        return b""
    if b"/FlateDecode" not in body[: m.start()]:
        return m[1]
    out = zlib.decompressobj()
    got = out.decompress(m[1], MOST)
    if out.unconsumed_tail:
        raise ValueError("too large")
    return got


def _objects(raw: bytes) -> dict[int, bytes]:
    """Objects by number, those packed into object streams too."""
    found = {int(m[1]): m[2] for m in _OBJECT.finditer(raw)}
    for body in list(found.values()):
        if re.search(rb"/Type\s*/ObjStm", body):
            first, data = int(re.search(rb"/First\s+(\d+)", body)[1]), _plain(body)
            head = list(map(int, data[:first].split()))
            at = [*head[1::2], len(data) - first]
            found |= {n: data[first + at[k] : first + at[k + 1]] for k, n in enumerate(head[::2]) if n not in found}
    return found


def _refs(body: bytes, key: bytes) -> list[int]:
    """Numbers of the objects that a key refers to, one or an array."""
    m = re.search(rb"/" + key + rb"\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
    return [int(x) for x in re.findall(rb"(\d+)\s+\d+\s+R", m[1])] if m else []


def _pages(objects: dict[int, bytes], number: int, seen: set[int], fonts: bytes = b"") -> Iterator[tuple[bytes, bytes]]:
    """(page, what holds its fonts) in order; resources are inherited."""
    if number in seen or number not in objects:
        return
    seen.add(number)
    body = objects[number]
    own = body if b"/Font" in body else b"".join(objects.get(n, b"") for n in _refs(body, b"Resources"))
    own = own if b"/Font" in own else fonts
    if re.search(rb"/Type\s*/Page\b", body):
        yield body, own
    for kid in _refs(body, b"Kids"):
        yield from _pages(objects, kid, seen, own)


def _unicode(cmap: bytes) -> tuple[int, dict[int, str]]:
    """(bytes of a code, code -> text) of a ToUnicode map."""
    said = lambda h: bytes.fromhex(re.sub(rb"\s", b"", h).decode()).decode("utf-16-be", "ignore")
    table, width = {}, 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, text in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f\s]+)>", block):
            table[int(code, 16)], width = said(text), len(code) // 2
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(<[0-9A-Fa-f\s]+>|\[[^\]]*\])", block):
            width, base = len(low) // 2, int(low, 16)
            many = re.findall(rb"<([0-9A-Fa-f\s]+)>", to)
            for k in range(min(int(high, 16) - base, 0xFFFF) + 1):
                text = said(many[k]) if to[:1] == b"[" and k < len(many) else said(many[0])
                table[base + k] = text if to[:1] == b"[" else text[:-1] + chr(ord(text[-1]) + k)
    return width, table


def _shown(token: bytes, font: tuple[int, dict[int, str]] | None) -> str:
    if token[:1] == b"<":
        h = re.sub(rb"\s", b"", token[1:-1])
        data = bytes.fromhex((h + b"0" * (len(h) % 2)).decode())
    else:
        data = re.sub(rb"\\(\r\n|[0-7]{1,3}|.)", lambda m: _ESCAPES.get(m[1], b"" if m[1] in (b"\n", b"\r", b"\r\n") else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1], flags=re.S)
    if font is None:
        return data.decode("cp1252", "replace")
    width, table = font
    return "".join(table.get(int.from_bytes(data[k : k + width]), "") for k in range(0, len(data), width))


def _text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    """What a content stream shows; operators that move to another line end one, wide gaps are blanks."""
    out: list[str] = []
    font, stack = None, []
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/-+.0123456789":
            stack.append(t)
            continue
        shows = t in (b"Tj", b"TJ", b"'", b'"')
        if t in (b"T*", b"'", b'"', b"ET") or t in (b"Td", b"TD") and len(stack) > 1 and float(stack[-1]) != 0 or t == b"Tm" and out:
            out.append("\n")
        if t == b"Tf" and len(stack) > 1:
            font = fonts.get(stack[-2][1:])
        elif shows:
            for x in stack:
                if x[:1] in b"(<":
                    out.append(_shown(x, font))
                elif t == b"TJ" and x[:1] == b"-" and float(x) < -200:
                    out.append(" ")
        stack = []
    return re.sub(r"\n+", "\n", "".join(out)).strip("\n")


def pdf(raw: bytes) -> str:
    """Pages in order, lines as they are written."""
    if not raw.lstrip()[:5] == b"%PDF-":
        raise ValueError("no PDF")
    objects = _objects(raw)
    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Catalog\b", b)]
    maps: dict[int, tuple[int, dict[int, str]]] = {}
    texts = []
    for root in roots[-1:]:
        for number in _refs(objects[root], b"Pages"):
            for page, holds in _pages(objects, number, set()):
                inner = re.search(rb"/Font\s*(?:<<(.*?)>>|(\d+)\s+\d+\s+R)", holds, re.S)
                listed = b"" if not inner else inner[1] if inner[1] is not None else objects.get(int(inner[2]), b"")
                fonts = {}
                for name, n in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", listed):
                    for to in _refs(objects.get(int(n), b""), b"ToUnicode"):
                        maps[to] = maps.get(to) or _unicode(_plain(objects.get(to, b"")))
                        fonts[name] = maps[to]
                texts.append(_text(b"\n".join(_plain(objects.get(n, b"")) for n in _refs(page, b"Contents")), fonts))
    return "\n".join(texts)


# columns ----------------------------------------------------------------------------------------------------------------------

READERS: dict[str, Callable[[bytes], str]] = {"docx": docx, "pptx": pptx, "xlsx": xlsx, "hwpx": hwpx, "pdf": pdf}


def office_text(kind: str) -> Callable[[Column], Column]:
    """A function of a file's content: its text, null where it cannot be read."""
    read = READERS[kind]

    def one(raw: bytes | None) -> str | None:
        try:
            return None if raw is None else read(bytes(raw))
        except Exception:  # noqa: BLE001  whatever a damaged file does is that file's own
            return None

    return lambda content: F.pandas_udf(lambda s: s.map(one), "string")(content)


#: Extractors by file ending, for ``operators.documents.extracted``.
EXTRACTORS: dict[str, Callable[[Column], Column]] = {kind: office_text(kind) for kind in READERS}
