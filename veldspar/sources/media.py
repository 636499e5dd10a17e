"""PDF texts and picture headers, read with the standard library, and a reader of any supported file.

The PDF reader handles plain and Flate-compressed streams, object streams, fonts with differences of their own or with a
map to Unicode, and counts pictures. What it cannot read (encrypted files, other filters, files without pages) is an
error, not an empty text. An installed extractor can be passed in instead.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.sources import files
from veldspar.sources.rendering import LETTERS

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_FONT = re.compile(rb"/([^\s/]+)\s+[-\d.]+\s+Tf")
_SHOW = re.compile(rb"(/[^\s/]+\s+[-\d.]+\s+Tf)|\[((?:\\.|\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|Td|TD|BT)", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)


# Names of letters that fonts put in other places.
_GLYPHS = {name: letter for letter, name in LETTERS.values()} | {"germandbls": "ß", "Euro": "€"}


class _Font:
    """How a font's bytes are letters: a map to Unicode by codes of some length, or Windows-1252 with differences."""

    def __init__(self, body: bytes = b"", to_unicode: bytes = b""):
        self.codes: dict[bytes, str] = {}
        self.other: dict[int, str] = {}
        text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
        for part in re.findall(rb"beginbfchar(.*?)endbfchar", to_unicode, re.S):
            for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                self.codes[bytes.fromhex(a.decode())] = text(b)
        for part in re.findall(rb"beginbfrange(.*?)endbfrange", to_unicode, re.S):
            for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                first = text(c)
                for n in range(min(int(b, 16) - int(a, 16), 65535) + 1):
                    self.codes[(int(a, 16) + n).to_bytes(len(a) // 2, "big")] = first[:-1] + chr(ord(first[-1]) + n)
        if found := re.search(rb"/Differences\s*\[(.*?)\]", body, re.S):
            at = 0
            for token in re.findall(rb"/[^\s/\]]+|\d+", found[1]):
                if token[:1] != b"/":
                    at = int(token)
                    continue
                name = token[1:].decode("latin-1")
                if letter := _GLYPHS.get(name) or (name if len(name) == 1 else None):
                    self.other[at] = letter
                at += 1

    def decode(self, data: bytes) -> str | None:
        """None where the font says nothing of its own."""
        if self.codes:
            n = max(map(len, self.codes))
            return "".join(self.codes.get(data[i : i + n], "") for i in range(0, len(data), n))
        if self.other:
            return "".join(self.other.get(b) or bytes([b]).decode("cp1252", "replace") for b in data)
        return None


def _plain(raw: bytes, digits: bytes, font: _Font) -> str:
    if digits:
        data = bytes.fromhex(re.sub(rb"\s", b"", digits).decode().ljust(len(digits) % 2, "0"))
        if (own := font.decode(data)) is not None:
            return own
        return data.decode("utf-16-be", "replace") if len(data) % 2 == 0 and data[:1] == b"\0" else data.decode("cp1252", "replace")
    short = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}
    data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else short.get(m[1], m[1]), raw, flags=re.S)
    own = font.decode(data)
    return data.decode("cp1252", "replace") if own is None else own


def _content(body: bytes) -> bytes:
    found = _STREAM.search(body)
    if not found:
        return b""
    head = body[: found.start()]
    if b"/Filter" not in head:
        return found[1]
    if filters := set(re.findall(rb"/(\w+Decode)\b", head)) - {b"FlateDecode"}:
        raise ValueError(f"streams of {', '.join(sorted(f.decode() for f in filters))} cannot be read")
    return zlib.decompressobj().decompress(found[1])


def _objects(content: bytes) -> dict[int, bytes]:
    """The objects of a file by their numbers, those in object streams too."""
    if not content.lstrip()[:5] == b"%PDF-":
        raise ValueError("not a PDF file")
    if re.search(rb"/Encrypt\b", content):
        raise ValueError("the PDF file is encrypted")
    out = {int(n): body for n, _, body in _OBJECT.findall(content)}
    for body in list(out.values()):
        if re.search(rb"/Type\s*/ObjStm\b", body):
            data = _content(body)
            first, n = (int(re.search(rb"/%s\s+(\d+)" % k, body)[1]) for k in (b"First", b"N"))
            places = list(map(int, data[:first].split()))[: 2 * n]
            ends = [*places[3::2], len(data) - first]
            for number, at, end in zip(places[::2], places[1::2], ends, strict=True):
                out.setdefault(number, data[first + at : first + end])
    return out


def _referred(objects: dict[int, bytes], body: bytes, name: bytes) -> bytes:
    """The value of a name in a dictionary, itself or what it refers to."""
    found = re.search(rb"/%s\s*(?:(\d+)\s+\d+\s+R|(<<.*))" % name, body, re.S)
    return b"" if not found else objects.get(int(found[1]), b"") if found[1] else found[2]


def _fonts(objects: dict[int, bytes], page: bytes) -> dict[bytes, _Font]:
    resources = _referred(objects, page, b"Resources")
    while not resources and (up := re.search(rb"/Parent\s+(\d+)\s+\d+\s+R", page)):
        page = objects.get(int(up[1]), b"")
        resources = _referred(objects, page, b"Resources")
    out = {}
    for name, number in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", _referred(objects, resources, b"Font").partition(b">>")[0]):
        body = objects.get(int(number), b"")
        coded = re.search(rb"/Encoding\s+(\d+)\s+\d+\s+R", body)
        map_at = re.search(rb"/ToUnicode\s+(\d+)\s+\d+\s+R", body)
        out[name] = _Font(body + (objects.get(int(coded[1]), b"") if coded else b""), _content(objects.get(int(map_at[1]), b"")) if map_at else b"")
    return out


def pdf_pages(content: bytes) -> list[str]:
    """The text of each page in order."""
    objects = _objects(content)

    def order(at: int) -> Iterator[int]:
        body = objects.get(at, b"")
        if kids := re.search(rb"/Kids\s*\[(.*?)\]", body, re.S):
            for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1]):
                yield from order(int(k))
        else:
            yield at

    roots = [n for n, b in objects.items() if re.search(rb"/Type\s*/Pages\b", b) and b"/Parent" not in b]
    pages = [p for r in roots for p in order(r)] or [n for n, b in objects.items() if re.search(rb"/Type\s*/Page\b(?!s)", b)]
    if not pages:
        raise ValueError("the PDF file has no pages")
    out = []
    for p in pages:
        refs = re.search(rb"/Contents\s*(\[.*?\]|\d+\s+\d+\s+R)", objects.get(p, b""), re.S)
        fonts, font, text = _fonts(objects, objects.get(p, b"")), _Font(), []
        for n in re.findall(rb"(\d+)\s+\d+\s+R", refs[1]) if refs else []:
            for chosen, many, one, move in _SHOW.findall(_content(objects.get(int(n), b""))):
                if chosen:
                    font = fonts.get(_FONT.match(chosen)[1], _Font())
                    continue
                text.append("\n" if move else "".join(_plain(a, b, font) for a, b in _STRING.findall(many or one)))
        out.append(re.sub(r"\n+", "\n", "".join(text)).strip())
    return out


def pdf_pictures(content: bytes) -> list[tuple[int, int]]:
    """Width and height of the pictures of a file."""
    size = lambda b, k: int(found[1]) if (found := re.search(rb"/%s\s+(\d+)" % k, b)) else 0
    heads = [b.partition(b"stream")[0] for b in _objects(content).values()]
    return [(size(b, b"Width"), size(b, b"Height")) for b in heads if re.search(rb"/Subtype\s*/Image\b", b)]


def text_tables(text: str) -> list[list[list[str]]]:
    """Tables that stand in a text as two or more lines of as many cells, which two spaces or a tab part."""
    out, held = [], []
    for line in [*text.split("\n"), ""]:
        cells = [c for c in re.split(r"\s{2,}|\t+", line.strip()) if c]
        if held and len(cells) != len(held[0]):
            if len(held) > 1:
                out.append(held)
            held = []
        if len(cells) > 1:
            held.append(cells)
    return out


def read_pdf_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, table, row, cells, error) of the tables in the pages' texts."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    rows = lambda c: [(p, t, i, r) for p, text in enumerate(pdf_pages(c), 1) for t, table in enumerate(text_tables(text)) for i, r in enumerate(table)]
    return files._parsed(found, "path string, page long, table long, row long, cells array<string>, error string", rows)


def read_pdf_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, picture, width, height, error) of the pictures in PDF files."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files._parsed(found, "path string, picture long, width long, height long, error string", lambda c: [(i, w, h) for i, (w, h) in enumerate(pdf_pictures(c))])


def read_pdf(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] = pdf_pages) -> DataFrame:
    """(path, page, text, error) of every page."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files._parsed(found, "path string, page long, text string, error string", lambda c: list(enumerate(extract(c), 1)))


def full_text(pages: DataFrame) -> DataFrame:
    """(path, text): pages joined by a blank line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("path").agg(F.array_join(F.filter(F.transform(ordered, lambda r: r["text"]), lambda t: t != ""), "\n\n").alias("text"))


def picture(content: bytes) -> tuple[str, int, int]:
    """(format, width, height) of a PNG, GIF, BMP or JPEG."""
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        return ("PNG", *struct.unpack(">II", content[16:24]))
    if content[:3] == b"GIF":
        return ("GIF", *struct.unpack("<HH", content[6:10]))
    if content[:2] == b"BM":
        w, h = struct.unpack("<ii", content[18:26])
        return "BMP", w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content):
            if content[at] != 0xFF:
                at += 1
                continue
            kind = content[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "JPEG", w, h
            at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    raise ValueError("not a picture of a known format")


def read_pictures(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height, error) of pictures."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(files.category_of(F.col("path")) == "image")
    return files._parsed(found, "path string, format string, width long, height long, error string", lambda c: [picture(c)])


def _docx_text(content: bytes) -> tuple[str, int]:
    return "\n".join(t for t, _, _ in files.docx_paragraphs(content)), 1


def _xlsx_text(content: bytes) -> tuple[str, int]:
    sheets = files.xlsx_sheets(content)
    return "\n\n".join(f"{s}\n" + "\n".join(" | ".join(r) for r in rows) for s, rows in sheets), len(sheets)


def _csv_text(content: bytes) -> tuple[str, int]:
    for encoding in files.ENCODINGS:
        try:
            return content.decode(encoding), 1
        except UnicodeDecodeError:
            continue
    return "", 1


def _pdf_text(content: bytes) -> tuple[str, int]:
    pages = pdf_pages(content)
    return "\n\n".join(filter(None, pages)), len(pages)


def _picture_text(content: bytes) -> tuple[str, int]:
    return "%s %dx%d" % picture(content), 1


#: From a file's bytes to its text and pages, by extension; pictures are read by their headers.
Reader = Callable[[bytes], tuple[str, int]]
READERS: dict[str, Reader] = {".pdf": _pdf_text, ".docx": _docx_text, ".xlsx": _xlsx_text, ".csv": _csv_text, **dict.fromkeys((".jpg", ".jpeg", ".png", ".gif", ".bmp"), _picture_text)}


def register(extension: str, reader: Reader) -> None:
    """Read files of an extension by a function, in place of any other."""
    READERS[extension.lower()] = reader


def supported_extensions() -> list[str]:
    return sorted(READERS)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """(path, category, text, pages, error): one row a file that has a category or a registered reader."""
    extension = F.lower(F.regexp_extract("path", r"\.[^./]*$", 0))
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).withColumn("category", files.category_of(F.col("path")))
    found = found.where((F.col("category") != "unknown") | extension.isin(supported_extensions()))
    readers = dict(READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, category, content in zip(batch["path"], batch["category"], batch["content"], strict=True):
                try:
                    reader = readers.get("." + path.rpartition(".")[2].lower())
                    if reader is None:
                        raise ValueError("no reader for files of this extension")
                    rows.append((path, category, *reader(bytes(content)), None))
                except Exception as e:
                    rows.append((path, category, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "category", "text", "pages", "error"])

    return found.select("path", "category", "content").mapInPandas(run, "path string, category string, text string, pages long, error string")


def aggregate(read: DataFrame) -> DataFrame:
    """One row: files, pages, errors, and all texts with their names, in order of the path."""
    name = F.element_at(F.split("path", "/"), -1)
    ordered = F.array_sort(F.collect_list(F.when(F.col("error").isNull(), F.struct("path", F.concat(F.lit("=== "), name, F.lit(" ===\n"), F.coalesce("text", F.lit(""))).alias("t")))))
    return read.agg(F.count(F.lit(1)).alias("files"), F.sum("pages").alias("pages"), F.count("error").alias("errors"), F.array_join(F.transform(ordered, lambda r: r["t"]), "\n\n").alias("text"))
