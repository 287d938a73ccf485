"""PDF files: page texts, figures and metadata, and a plain writer.

``decoder`` may be any function from the bytes of a file to a ``Pdf``; the one here needs no library.  It reads
objects (also those packed in object streams), the page tree, text-showing operators and Flate streams.  Strings
are UTF-16 if they say so, else Latin; fonts with an encoding of their own give what their codes say.  Pictures with eight
bits a colour are read as pixels, others (such as JPEG) keep their size only.  A file that can't be read
gives no pages and an ``error``; no file stops a job.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most bytes a stream may unfold to.
LARGEST = 1 << 30
_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^\\()]|\\.)*\)|<[0-9A-Fa-f\s]*>|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|(.))", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


@dataclass
class Pdf:
    """What a file holds: ``pages`` (texts), ``figures`` (page, width, height, pixels or None), ``title``, ``error``."""

    pages: list[str] = field(default_factory=list)
    figures: list[tuple[int, int, int, bytes | None]] = field(default_factory=list)
    title: str = ""
    error: str | None = None


def _text(raw: bytes) -> str:
    """A string of either notation."""
    if raw[:1] == b"<":
        digits = re.sub(rb"\s", b"", raw[1:-1]).decode()
        body = bytes.fromhex(digits + "0" * (len(digits) % 2))
    else:
        body = _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _PLAIN.get(m[2], b"" if m[2] == b"\n" else m[2]), raw[1:-1])
    return body[2:].decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("cp1252", "replace")


def _unfolded(body: bytes) -> bytes | None:
    """The data of a stream object; None if it is packed in a way that is not read here."""
    opened = _STREAM.search(body)
    if not opened:
        return None
    end = body.rfind(b"endstream")
    data = body[opened.end() : end if end > 0 else len(body)]
    head = body[: opened.start()]
    if (length := re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head)) and int(length[1]) <= len(data):
        data = data[: int(length[1])]
    if b"/Filter" not in head:
        return data
    if b"FlateDecode" not in head or re.search(rb"/(?:DCT|JPX|LZW|CCITTFax|JBIG2|ASCII85|ASCIIHex|RunLength)", head) or re.search(rb"/Predictor\s+(?:[2-9]|1\d)", head):
        return None
    unpack = zlib.decompressobj()
    out = unpack.decompress(data, LARGEST)
    if unpack.unconsumed_tail:
        raise ValueError("a stream unfolds beyond bounds")
    return out


def _objects(content: bytes) -> dict[int, bytes]:
    out: dict[int, bytes] = {}
    at = 0
    while found := _OBJECT.search(content, at):
        end = content.find(b"endobj", found.end())
        end = len(content) if end < 0 else end
        out[int(found[1])] = content[found.end() : end]
        at = end
    for body in list(out.values()):
        head = body[: body.find(b"stream")]
        if re.search(rb"/Type\s*/ObjStm\b", head) and (data := _unfolded(body)) is not None:
            first, n = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", head)) else 0 for k in (b"First", b"N"))
            numbers = [int(x) for x in data[:first].split()[: 2 * n]]
            places = [*numbers[1::2], len(data) - first]
            for k, number in enumerate(numbers[::2]):
                out.setdefault(number, data[first + places[k] : first + places[k + 1]])
    return out


def _page_order(objects: dict[int, bytes]) -> list[int]:
    """Numbers of the page objects, in the order of the page tree where there is one."""
    is_page = lambda n: re.search(rb"/Type\s*/Page\b", objects.get(n, b"")) is not None
    kids = {n: [int(x) for x in _REF.findall(m[1])] for n, body in objects.items() if (m := re.search(rb"/Kids\s*\[([^\]]*)\]", body))}
    below = {k for found in kids.values() for k in found}
    ordered: list[int] = []
    seen: set[int] = set()
    waiting = [n for n in sorted(kids, reverse=True) if n not in below]
    while waiting:
        n = waiting.pop()
        if n in seen:
            continue
        seen.add(n)
        if n in kids:
            waiting += reversed(kids[n])
        elif is_page(n):
            ordered.append(n)
    return ordered or [n for n in objects if is_page(n)]


def _shown(data: bytes) -> str:
    """The text that a content stream shows, a line feed where it moves to another line."""
    lines: list[str] = []
    line: list[str] = []
    strings: list[bytes] = []
    for token in _TOKEN.findall(data):
        if token[:1] in b"(<":
            strings.append(token)
        elif token in (b"Tj", b"TJ", b"'", b'"'):
            if token in (b"'", b'"'):
                lines.append("".join(line))
                line = []
            line += map(_text, strings)
            strings = []
        elif token in (b"T*", b"Td", b"TD"):
            lines.append("".join(line))
            line = []
        elif token != b"TL":
            strings = []
    return "\n".join([*lines, "".join(line)]).removeprefix("\n") if lines else "".join(line)


def decode(content: bytes) -> Pdf:
    """A file read without any library."""
    out = Pdf()
    try:
        if b"%PDF-" not in content[:1024]:
            raise ValueError("no PDF")
        objects = _objects(content)
        for page, n in enumerate(_page_order(objects), 1):
            body = objects[n]
            named = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
            parts = [_unfolded(objects.get(int(x), b"")) or b"" for x in _REF.findall(named[1])] if named else []
            out.pages.append(_shown(b"\n".join(parts)))
            resources = body
            if held := re.search(rb"/Resources\s+(\d+)\s+\d+\s+R", body):
                resources += objects.get(int(held[1]), b"")
            if held := re.search(rb"/XObject\s+(\d+)\s+\d+\s+R", resources):
                resources += b"/XObject <<" + objects.get(int(held[1]), b"") + b">>"
            for x in dict.fromkeys(int(x) for part in re.findall(rb"/XObject\s*<<(.*?)>>", resources, re.S) for x in _REF.findall(part)):
                head = objects.get(x, b"")
                head = head[: head.find(b"stream")] if b"stream" in head else head
                if not re.search(rb"/Subtype\s*/Image\b", head):
                    continue
                width, height = (int(m[1]) if (m := re.search(rb"/" + k + rb"\s+(\d+)", head)) else 0 for k in (b"Width", b"Height"))
                pixels = _unfolded(objects[x]) if re.search(rb"/BitsPerComponent\s+8\b", head) else None
                if pixels is not None and re.search(rb"/DeviceGray\b", head) and len(pixels) == width * height:
                    pixels = bytes(v for p in pixels for v in (p, p, p))
                out.figures.append((page, width, height, pixels if pixels is not None and len(pixels) == width * height * 3 else None))
        if (info := re.search(rb"/Info\s+(\d+)\s+\d+\s+R", content)) and (title := re.search(rb"/Title\s*(\((?:[^\\()]|\\.)*\)|<[0-9A-Fa-f\s]*>)", objects.get(int(info[1]), b""), re.S)):
            out.title = _text(title[1])
    except Exception as problem:  # whatever a broken file brings
        return Pdf(error=f"{type(problem).__name__}: {problem}")
    return out


def encode(pages: list[str], title: str = "", figures: list[tuple[int, int, bytes]] | None = None) -> bytes:
    """A PDF with a page for each text; ``figures`` (width, height, RGB) are on the first page."""
    hexed = lambda s: b"<FEFF" + s.encode("utf-16-be", "replace").hex().encode() + b">"
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> int:
        packed = zlib.compress(data)
        return add(b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(packed), packed))

    root, tree, info = add(b""), add(b""), add(b"<< /Title " + hexed(title) + b" >>")
    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    images = [stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8" % (w, h), p) for w, h, p in figures or []]
    kids = []
    for k, text in enumerate(pages):
        shown = b"BT /F1 10 Tf 50 780 Td 12 TL " + b" T* ".join(hexed(line) + b" Tj" for line in text.split("\n")) + b" ET"
        held = b"/XObject << %s >>" % b" ".join(b"/I%d %d 0 R" % (x, x) for x in images) if images and not k else b""
        kids.append(add(b"<< /Type /Page /Parent %d 0 R /MediaBox [0 0 595 842] /Resources << /Font << /F1 %d 0 R >> %s >> /Contents %d 0 R >>" % (tree, font, held, stream(b"", shown))))
    objects[root - 1] = b"<< /Type /Catalog /Pages %d 0 R >>" % tree
    objects[tree - 1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % x for x in kids))
    out, places = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    begin = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root %d 0 R /Info %d 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, root, info, begin))


def _read(files: DataFrame, id_col: str, content: str, shape: str, rows: Callable[[Pdf], list[tuple]], decoder: Callable[[bytes], Pdf]) -> DataFrame:
    source = files.select(F.col(id_col).alias("_id"), F.col(content).alias("_content")).where("_content is not null")
    kind = source.schema["_id"].dataType.simpleString()
    names = [part.split()[0] for part in shape.split(", ")]
    arrow = {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    kinds = [arrow[part.split()[1]] for part in shape.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a file at a time: its pictures may be large
                got = rows(decoder(batch.column(1)[k].as_py()))
                if got:
                    ids = batch.column(0).take(pa.array([k] * len(got)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array([g[c] for g in got], t) for c, t in enumerate(kinds))], names=["_id", *names])

    return source.mapInArrow(run, f"_id {kind}, {shape}").withColumnRenamed("_id", id_col)


def documents(files: DataFrame, id_col: str = "path", content: str = "content", decoder: Callable[[bytes], Pdf] = decode) -> DataFrame:
    """``id_col``, ``page_count``, ``figure_count``, ``title`` (of the metadata), ``full_text`` (pages, a line feed between) and ``error``."""
    rows = lambda p: [(len(p.pages), len(p.figures), p.title, "\n".join(p.pages), p.error)]
    return _read(files, id_col, content, "page_count int, figure_count int, title string, full_text string, error string", rows, decoder)


def figures(files: DataFrame, id_col: str = "path", content: str = "content", decoder: Callable[[bytes], Pdf] = decode) -> DataFrame:
    """``id_col``, ``page_number``, ``figure_index`` (from 0 in the file), ``width``, ``height`` and ``pixels`` (RGB; null where they are not read)."""
    rows = lambda p: [(page, k, w, h, pixels) for k, (page, w, h, pixels) in enumerate(p.figures)]
    return _read(files, id_col, content, "page_number int, figure_index int, width int, height int, pixels binary", rows, decoder)
