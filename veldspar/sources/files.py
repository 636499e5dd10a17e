"""Files as DataFrames: a listing with categories, CSV with an encoding probe, workbooks and text documents.

XLSX and DOCX are zip archives of XML, read with the standard library where optional packages are absent.
Broken files give a row with an error instead of failing the job.
"""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import constants as K

ENCODINGS = ("utf-8-sig", "cp1254", "latin-1")


def category_of(name: Column) -> Column:
    ext = F.lower(F.regexp_extract(name, r"\.[^.]*$", 0))
    out = F.lit("unknown")
    for category, extensions in K.FILE_CATEGORIES.items():
        out = F.when(ext.isin(extensions), category).otherwise(out)
    return out


def scan(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, extension, size, modified, category) of supported files under path. No content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    x = found.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    x = x.withColumn("extension", F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))).withColumn("category", category_of(F.col("name")))
    return x.where((F.col("category") != "unknown") & ~F.col("path").rlike(r"/\.")).orderBy("category", "name", "path")


def scan_stats(files: DataFrame) -> DataFrame:
    """Count and bytes by category, with a total in which category is null."""
    return files.rollup("category").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def _xml(archive: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(archive.read(name)) if name in archive.namelist() else None


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def xlsx_sheets(content: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of strings) of a workbook, in sheet order; empty cells are empty strings."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        shared_root = _xml(archive, "xl/sharedStrings.xml")
        shared = ["".join(t.text or "" for t in s.iter() if _tag(t) == "t") for s in (shared_root if shared_root is not None else [])]
        rels = {r.get("Id"): r.get("Target").lstrip("/") for r in _xml(archive, "xl/_rels/workbook.xml.rels")}
        out = []
        for sheet in (e for e in _xml(archive, "xl/workbook.xml").iter() if _tag(e) == "sheet"):
            target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root, rows = _xml(archive, target if target.startswith("xl/") else "xl/" + target), []
            for row in (e for e in root.iter() if _tag(e) == "row"):
                cells: dict[int, str] = {}
                for cell in (e for e in row if _tag(e) == "c"):
                    letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                    at = len(cells)
                    if letters:
                        at = 0
                        for c in letters:
                            at = at * 26 + ord(c) - 64
                        at -= 1
                    value = next((v.text or "" for v in cell if _tag(v) == "v"), None)
                    if cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    elif cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
                    cells[at] = value or ""
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            out.append((sheet.get("name"), rows))
        return out


def docx_paragraphs(content: bytes) -> list[tuple[str, str, int]]:
    """(text, style, heading level or 0) of the paragraphs that have text."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        out = []
        for p in (e for e in _xml(archive, "word/document.xml").iter() if _tag(e) == "p"):
            text = "".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip()
            style = next((v for e in p.iter() if _tag(e) == "pStyle" for k, v in e.attrib.items() if k.endswith("val")), "Normal")
            level = re.match(r"Heading\s*(\d+)", style)
            if text:
                out.append((text, style, int(level[1]) if level else 0))
        return out


def docx_tables(content: bytes) -> list[list[list[str]]]:
    """The tables of a text document, as rows of cell texts."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        out = []
        for table in (e for e in _xml(archive, "word/document.xml").iter() if _tag(e) == "tbl"):
            cell = lambda c: " ".join(x for p in c.iter() if _tag(p) == "p" if (x := "".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip()))
            out.append([[cell(c) for c in row if _tag(c) == "tc"] for row in table if _tag(row) == "tr"])
        return out


def docx_stats(content: bytes) -> tuple[int, int, int]:
    """Paragraphs with text, tables and pictures of a text document."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        pictures = sum(n.startswith("word/media/") for n in archive.namelist())
    return len(docx_paragraphs(content)), len(docx_tables(content)), pictures


def _parsed(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out += [(path, *r, None) for r in rows(bytes(content))]
                except Exception as e:  # a broken file is a row of its own
                    out.append((path, *[None] * (len(names) - 2), str(e)[:200]))
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, schema)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, cells, error) of every sheet row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").option("recursiveFileLookup", "true").load(path)
    return _parsed(files, "path string, sheet string, row long, cells array<string>, error string", lambda c: [(s, i, r) for s, rows in xlsx_sheets(c) for i, r in enumerate(rows)])


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, text, style, level, error) of every paragraph."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return _parsed(files, "path string, pos long, text string, style string, level int, error string", lambda c: [(i, *p) for i, p in enumerate(docx_paragraphs(c))])


def read_docx_tables(spark: SparkSession, path: str) -> DataFrame:
    """(path, table, row, cells, error) of every table row."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return _parsed(files, "path string, table long, row long, cells array<string>, error string", lambda c: [(t, i, r) for t, rows in enumerate(docx_tables(c)) for i, r in enumerate(rows)])


def read_docx_stats(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraphs, tables, pictures, error) of every text document."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    return _parsed(files, "path string, paragraphs long, tables long, pictures long, error string", lambda c: [docx_stats(c)])


def workbook_summary(rows: DataFrame) -> DataFrame:
    """(path, sheets, rows, columns, names) of the rows that read_xlsx gives; the first row of a sheet is its header."""
    by = rows.where("error is null").groupBy("path", "sheet").agg((F.count(F.lit(1)) - 1).alias("rows"), F.max(F.size("cells")).alias("columns"))
    return by.groupBy("path").agg(F.count(F.lit(1)).alias("sheets"), F.sum("rows").alias("rows"), F.max("columns").alias("columns"), F.array_sort(F.collect_list("sheet")).alias("names"))


def csv_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(path, encoding): of each file the first encoding that decodes it, found where the file is read."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for content in batch["content"]:
                for encoding in ENCODINGS:
                    try:
                        bytes(content).decode(encoding)
                        break
                    except UnicodeDecodeError:
                        continue
                out.append(encoding)
            yield pd.DataFrame({"path": batch["path"], "encoding": out})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(probe, "path string, encoding string")


# Where Windows-1254 differs from Latin-1 in letters.
_LATIN, _TURKISH = "ÐÝÞðýþ", "ĞİŞğış"


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """CSV files with a header and inferred types, each by its own encoding unless one is given."""
    if encoding:
        return _read_csv(spark, [path], encoding)
    found: dict[str, list[str]] = {}
    for r in csv_encodings(spark, path).orderBy("path").collect():
        found.setdefault(r.encoding, []).append(r.path)
    parts = [_read_csv(spark, paths, e) for e, paths in found.items()]
    if len({tuple(p.dtypes) for p in parts}) > 1:  # what one file's values are says nothing about another's
        parts = [p.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in p.columns)) for p in parts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def _read_csv(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Spark reads few encodings, so Windows-1254 is read as Latin-1 and the six letters that differ are replaced."""
    df = spark.read.csv(paths, header=True, inferSchema=True, encoding="UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1")
    if encoding != "cp1254":
        return df
    letters = str.maketrans(_LATIN, _TURKISH)
    return df.select(*[(F.translate(c, _LATIN, _TURKISH) if kind == "string" else F.col(c)).alias(c.translate(letters)) for c, kind in df.dtypes])


def text_by_heading(paragraphs: DataFrame) -> DataFrame:
    """Text under the heading last seen, paragraphs in order."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = paragraphs.withColumn("heading", F.coalesce(F.last(F.when(F.col("level") > 0, F.col("text")), ignorenulls=True).over(w), F.lit("Başlıksız"))).where("level = 0")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return x.groupBy("path", "heading").agg(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n").alias("text"))


def markdown_tables(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, table, headers, rows) of the Markdown tables of a text."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"(?m)^(\|[^\n]+\|)\s*\n\|[-:| ]+\|\s*\n((?:\|[^\n]+\|\s*(?:\n|\z))+)"), F.lit(0))
    cells = lambda line: F.filter(F.transform(F.split(line, r"\|"), lambda x: F.trim(x)), lambda c: c != "")
    x = docs.select(id_col, F.posexplode(found).alias("table", "raw"))
    lines = F.filter(F.split("raw", "\n"), lambda s: F.trim(s) != "")
    return x.select(id_col, "table", cells(lines[0]).alias("headers"), F.transform(F.slice(lines, 3, F.size(lines)), cells).alias("rows"))
