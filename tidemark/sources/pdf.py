"""PDF bytes to text: an installed ``pypdf`` if there is one, else a small reader of text operators.

The small reader handles plain and Flate-compressed content streams with literal or hexadecimal
strings in standard encodings. It raises on bytes that are no PDF.
"""

from __future__ import annotations

import io
import re
import zlib

try:
    import pypdf
except ImportError:
    pypdf = None

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n", re.S)
_TEXT_BLOCK = re.compile(rb"BT(.*?)ET", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|T\*|Td|TD|Tm|TJ|Tj|'|\"|-?\d*\.?\d+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(raw: bytes) -> str:
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1])
        data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    else:
        octal = lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], b"" if m[1] in b"\r\n" else m[1])
        data = re.sub(rb"\\([0-7]{1,3}|.)", octal, raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def _block_text(block: bytes) -> str:
    out: list[str] = []
    for m in _TOKEN.finditer(block):
        token = m[0]
        if token[:1] in b"(<":
            out.append(_literal(token))
        elif token in (b"T*", b"Td", b"TD", b"Tm", b"'", b'"') and out and out[-1] != "\n":
            out.insert(len(out) - (token in (b"'", b'"')), "\n")
    return "".join(out)


def _plain_text(data: bytes) -> str:
    if not data.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF")
    found: list[str] = []
    for m in _STREAM.finditer(data):
        end = data.find(b"endstream", m.end())
        if end < 0:
            raise ValueError("truncated PDF stream")
        body = data[m.end() : end]
        if b"FlateDecode" in m[1]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error as e:
                raise ValueError(f"damaged PDF stream: {e}") from e
        found += [_block_text(b) for b in _TEXT_BLOCK.findall(body)]
    return "\n".join(found)


def extract_text_from_bytes(data: bytes) -> str:
    if pypdf is not None:
        return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(data)).pages)
    return _plain_text(bytes(data))


def extract_text(path: str) -> str:
    with open(path, "rb") as f:
        return extract_text_from_bytes(f.read())
