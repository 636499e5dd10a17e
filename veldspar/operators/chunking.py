"""Chunks of texts. Packing is sequential within a text, so each packer is a generator of strings that an
Arrow batch function applies; windows of fixed size are plain expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import constants as K
from veldspar.functions import text as X

_AFTER_MARK = re.compile(r"(?<=[.!?])\s+")
_BEFORE_LETTER = re.compile(r"(?<=[.!?])\s+(?=[A-Za-zçğıöşüÇĞİÖŞÜ])")
_HEADING = re.compile(r"(#{1,4})\s+(.+)")


def _fill(units: Iterable[str], size: int, add: Callable[[str, str], str], tail: Callable[[str], str]) -> Iterator[str]:
    """Units gathered while they fit; a full chunk hands its tail to the next one."""
    held = ""
    for unit in units:
        if len(held) + len(unit) <= size:
            held = add(held, unit)
        else:
            if held.strip():
                yield held.strip()
            held = add(tail(held), unit)
    if held.strip():
        yield held.strip()


def _sentence_tail(overlap: int) -> Callable[[str], str]:
    """The last characters of a chunk, from the first sentence that begins in them."""

    def tail(held: str) -> str:
        if len(held) <= overlap:
            return held
        cut = held[len(held) - overlap :]
        return cut.partition(". ")[2] if ". " in cut else cut

    return tail


def semantic_chunks(text: str, size: int = 1200, overlap: int = 240) -> Iterator[str]:
    """Paragraphs gathered to size, with an overlap of whole sentences; longer ones are cut by sentences."""
    tail, held = _sentence_tail(overlap), ""
    for block in filter(None, (b.strip() for b in re.split(r"\n\s*\n", text))):
        if len(block) > size:
            if held.strip():
                yield held.strip()
            held = ""
            yield from _fill((s for s in _BEFORE_LETTER.split(block) if s.strip()), size, lambda a, b: f"{a}{b} ", tail)
        elif len(held) + len(block) <= size:
            held = f"{held}\n\n{block}" if held else block
        else:
            if held.strip():
                yield held.strip()
            held = tail(held) + block
    if held.strip():
        yield held.strip()


def document_chunks(text: str, size: int = 500, overlap: int = 50) -> Iterator[str]:
    """Blocks between blank lines, long ones as sentences, gathered to size; the overlap is the last
    characters of a longer chunk."""

    def units() -> Iterator[tuple[str, str]]:
        for block in filter(None, (b.strip() for b in text.split("\n\n"))):
            if len(block) > size:
                yield from ((s, " ") for s in _AFTER_MARK.split(block) if s)
            else:
                yield block, "\n\n"

    held = ""
    for unit, end in units():
        if len(held) + len(unit) > size:
            if held.strip():
                yield held.strip()
            held = held[-overlap:] if len(held) > overlap else ""
        held += unit + end
    if held.strip():
        yield held.strip()


def recursive_chunks(text: str, size: int = 1200, overlap: int = 240, separators: Iterable[str] = K.SPLIT_SEPARATORS) -> Iterator[str]:
    """Cut at the coarsest separator present; parts are joined again while they fit, and parts that do not
    fit are cut by the finer ones. Without separators, windows that overlap."""
    separators = list(separators)
    if not text.strip():
        return
    if len(text) <= size:
        yield text
        return
    at = next((i for i, s in enumerate(separators) if s in text), None)
    if at is None:
        yield from (w for i in range(0, len(text), size - overlap) if (w := text[i : i + size]).strip())
        return
    mark, finer, runs = separators[at], separators[at + 1 :], []
    for part in (p for p in text.split(mark) if p.strip()):
        if runs and len(runs[-1]) + len(mark) + len(part) <= size:
            runs[-1] += mark + part
        else:
            runs.append(part)
    for run in runs:
        if len(run) > size and finer:
            yield from recursive_chunks(run, size, overlap, finer)
        else:
            yield run


def markdown_sections(text: str) -> Iterator[tuple[list[str], str]]:
    """(heading path, text) of the block of each heading of level one to four, and of what stands before."""
    path: list[str] = []
    lines: list[str] = []

    def block() -> Iterator[tuple[list[str], str]]:
        if joined := "\n".join(lines).strip():
            yield list(path), joined

    for line in text.split("\n"):
        if found := _HEADING.fullmatch(line):
            yield from block()
            lines.clear()
            del path[len(found[1]) - 1 :]
            path.append(found[2].strip())
        lines.append(line)
    yield from block()


PACKERS = {"semantic": semantic_chunks, "recursive": recursive_chunks, "document": document_chunks}


def chunks(docs: DataFrame, strategy: str = "semantic", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, pos, chunk); an unknown strategy is semantic. Ids of chunks are id and pos, so they are stable."""
    pack = PACKERS.get(strategy, semantic_chunks)

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(pack(t or "", **options)))

    return docs.select(F.col(id_col).alias("id"), F.posexplode(packed(F.col(text_col))).alias("pos", "chunk"))


class TextChunks:
    """The table function text_chunks(text, strategy, size, overlap): rows (pos, chunk). Null and blank texts have none."""

    def eval(self, text: str, strategy: str, size: int, overlap: int):
        pack = PACKERS.get(strategy, semantic_chunks)
        yield from enumerate(pack(text or "", size=size, overlap=overlap))


class MarkdownSections:
    """The table function markdown_sections(text): rows (pos, path, chunk)."""

    def eval(self, text: str):
        for pos, (path, chunk) in enumerate(markdown_sections(text or "")):
            yield pos, path, chunk


def register_functions(spark: SparkSession) -> None:
    """Make the chunkers table functions of the session, for SQL with LATERAL; rows travel in Arrow batches."""
    spark.udtf.register("text_chunks", F.udtf(TextChunks, returnType="pos int, chunk string", useArrow=True))
    spark.udtf.register("markdown_sections", F.udtf(MarkdownSections, returnType="pos int, path array<string>, chunk string", useArrow=True))


def enrich(made: DataFrame) -> DataFrame:
    """Flags, category and counts of (id, pos, chunk)."""
    c = F.col("chunk")
    return made.select(
        "*", F.length(c).alias("chars"), F.size(X.words(c)).alias("words"), X.content_type(c).alias("content_type"), c.rlike("[0-9]").alias("has_numbers"),
        c.rlike("[0-9]{4}").alias("has_dates"), c.rlike("[₺$€]|TL|USD|EUR").alias("has_currency"), X.chunk_category(c).alias("category"),
    )


def parent_child(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, parent_pos, parent, pos, chunk): chunks of 500 within chunks of 2000."""
    parents = chunks(docs, "semantic", id_col, text_col, size=2000, overlap=200).withColumnsRenamed({"pos": "parent_pos", "chunk": "parent"})

    @F.pandas_udf("array<string>")
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(semantic_chunks(t or "", 500, 100)))

    return parents.select("id", "parent_pos", "parent", F.posexplode(packed("parent")).alias("pos", "chunk"))


def parent_context(children: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, parent_pos, pos, chunk, parent): children with the text of their parent, null where it is missing."""
    return children.select("id", "parent_pos", "pos", "chunk").join(parents.select("id", "parent_pos", "parent"), ["id", "parent_pos"], "left")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, path, chunk) of Markdown heading blocks."""

    @F.pandas_udf("array<struct<path array<string>, chunk string>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"path": p, "chunk": c} for p, c in markdown_sections(t or "")])

    x = docs.select(F.col(id_col).alias("id"), F.posexplode(cut(F.col(text_col))).alias("pos", "s"))
    return x.select("id", "pos", F.col("s.path").alias("path"), F.col("s.chunk").alias("chunk"))


def windows(docs: DataFrame, size: int, step: int, id_col: str = "doc_id", text_col: str = "text", whole: Column | None = None) -> DataFrame:
    """(id, pos, chunk): windows of size characters every step characters, up to the one that reaches the
    end. Blank windows are dropped; where whole holds, the text is one window."""
    c = F.col(text_col)
    last = F.greatest(F.lit(0), F.ceil((F.length(c) - size) / step).cast("int"))
    last = last if whole is None else F.when(whole, 0).otherwise(last)
    one = F.substring(c, F.lit(1) + F.col("pos") * step, F.lit(size))
    x = docs.where(F.length(c) > 0).select(F.col(id_col).alias("id"), c, *([] if whole is None else [whole.alias("__whole")]), F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    chunk = one if whole is None else F.when(F.col("__whole"), c).otherwise(one)
    return x.select("id", "pos", chunk.alias("chunk")).where(F.trim("chunk") != "")
