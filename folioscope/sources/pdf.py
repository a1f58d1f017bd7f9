"""Text of PDF files without a library, page by page (SRC-02).

Reads plain and compressed streams and object streams, and the text operators of pages whose
fonts use Latin codes.  What it can't read (encrypted files, fonts with codes of their own,
images) comes out as blank pages, which are left to an OCR function, or as an error.  Another
extractor is a function of the file's bytes (``files.extract_pages``, ``--extractor``).
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)\bendstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TEXT = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|-?\d*\.?\d+|[A-Za-z'\"*]+|/\S+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_NAMED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}


def _unfilter(head: bytes, body: bytes) -> bytes:
    if b"/FlateDecode" in head:
        return zlib.decompressobj().decompress(body.lstrip(b"\r\n"))
    return body if b"/Filter" not in head else b""


def _objects(data: bytes) -> dict[int, tuple[bytes, bytes]]:
    """(dictionary, decoded stream) of every object by its number."""
    out: dict[int, tuple[bytes, bytes]] = {}
    for number, body in _OBJECT.findall(data):
        m = _STREAM.match(body)
        out[int(number)] = (m[1], _unfilter(m[1], m[2])) if m else (body, b"")
    for head, stream in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", head) and (first := re.search(rb"/First\s+(\d+)", head)):
            at = int(first[1])
            numbers = [int(x) for x in stream[:at].split()]
            places = [*numbers[1::2], len(stream) - at]
            for k, n in enumerate(numbers[::2]):
                out.setdefault(n, (stream[at + places[k] : at + places[k + 1]], b""))
    return out


def _string(token: bytes) -> str:
    if token[:1] == b"<":
        raw = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((raw + b"0" * (len(raw) % 2)).decode())
    else:
        raw = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _NAMED.get(m[1], m[1]), token[1:-1])
    return raw[2:].decode("utf-16-be", "replace") if raw[:2] == b"\xfe\xff" else raw.decode("cp1252", "replace")


def _page_text(content: bytes) -> str:
    out: list[str] = []
    held: list[bytes] = []
    for token in _TEXT.findall(content):
        if token[:1] in b"(<" or token in (b"[", b"]") or re.match(rb"-?\d*\.?\d+$", token):
            held.append(token)
            continue
        if token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                out.append("\n")
            for x in held:
                if x[:1] in b"(<":
                    out.append(_string(x))
                elif x[:1] == b"-" and float(x) < -180 and token == b"TJ":
                    out.append(" ")  # a wide gap between two strings
        elif token in (b"Td", b"TD") and len(held) >= 2 and float(held[-1]) != 0 or token in (b"T*", b"ET", b"Tm"):
            out.append("\n")
        held = []
    return re.sub(r"\n{2,}", "\n", "".join(out)).strip("\n")


def pdf_pages(data: bytes) -> list[str]:
    """The text of each page, in order of the page tree."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if b"/Encrypt" in data[-2048:]:
        raise ValueError("encrypted")
    objects = _objects(data)
    kind = lambda n, name: re.search(rb"/Type\s*/" + name + rb"\b", objects[n][0])
    pages: list[int] = []
    roots = [n for n in objects if kind(n, b"Pages") and not re.search(rb"/Parent\b", objects[n][0])]
    todo, seen = roots[::-1], set()
    while todo:
        n = todo.pop()
        if n in seen or n not in objects:
            continue
        seen.add(n)
        if kind(n, b"Pages"):
            kids = re.search(rb"/Kids\s*\[(.*?)\]", objects[n][0], re.S)
            todo += [int(x) for x in _REF.findall(kids[1])][::-1] if kids else []
        elif kind(n, b"Page"):
            pages.append(n)
    if not pages:
        raise ValueError("no pages")
    out = []
    for n in pages:
        m = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects[n][0], re.S)
        out.append(_page_text(b"\n".join(objects[int(x)][1] for x in _REF.findall(m[1]) if int(x) in objects)) if m else "")
    return out
