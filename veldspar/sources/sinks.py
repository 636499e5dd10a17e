"""Sinks: vector tables, result tables with a lifetime, Markdown, DOCX and JSON reports."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.operators.relational import ordinal


_SPACES = (
    'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" '
    'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" '
    'xmlns:pic="http://schemas.openxmlformats.org/drawingml/2006/picture"'
)


def put_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file, such as a report, to any store that Spark writes to."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(content))
    out.close()


class VectorTable:
    """Documents with vectors in a Parquet folder. Ids are hashes of the text, so adding a text again can be
    seen; add appends, as a store without upserts does."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        """rows(text, embedding, meta map<string,string>)."""
        rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("id"), "text", F.col("embedding").cast("array<float>").alias("embedding"), "meta").write.mode("append").parquet(self.path)

    def replace(self, rows: DataFrame) -> None:
        rows.select(F.sha2(F.col("text").cast("binary"), 256).alias("id"), "text", F.col("embedding").cast("array<float>").alias("embedding"), "meta").write.mode("overwrite").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def count(self) -> int:
        return self.read().count()

    def stats(self) -> DataFrame:
        """One row: documents, distinct ones, and the length of their vectors."""
        return self.read().agg(F.count(F.lit(1)).alias("documents"), F.countDistinct("id").alias("distinct_documents"), F.max(F.size("embedding")).alias("dimension"))

    def drop(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def cache_key(query: Column, *params: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", F.lower(query), *params).cast("binary"), 256), 1, 16)


def fresh(cache: DataFrame, now: Column, hours: float) -> DataFrame:
    """Rows of cache(key, value, created) that have not run out; of one key, the last."""
    alive = cache.where(F.col("created") > now - F.make_dt_interval(hours=F.lit(int(hours))))
    return alive.groupBy("key").agg(F.max_by("value", "created").alias("value"))


def misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Keys that have to be computed."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def cache_stats(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: entries of cache(key), and of the keys asked for how many it had, had not, and their share."""
    found = asked.join(cache.select("key").distinct().withColumn("__hit", F.lit(1)), "key", "left")
    entries = cache.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    x = found.agg(F.count("__hit").alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))
    return x.select(entries.alias("entries"), "hits", "misses", F.coalesce(F.try_divide(F.col("hits"), F.col("hits") + F.col("misses")), F.lit(0.0)).alias("hit_rate"))


def write_metrics(timings: DataFrame, path: str) -> None:
    """(operation, seconds) as one JSON line an operation: calls, total, mean and longest."""
    x = timings.groupBy("operation").agg(F.count(F.lit(1)).alias("calls"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))
    x.write.mode("overwrite").json(path)


def evict(cache: DataFrame, most: int, share: float = 0.2) -> DataFrame:
    """Beyond `most` rows, the share least recently used goes."""
    n = cache.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return ordinal(cache, ["used", "key"], "__n").where((n <= most) | (F.col("__n") > F.floor(n * share))).drop("__n")


def markdown_report(sections: DataFrame) -> DataFrame:
    """(report_id, text): numbered sections in order."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "title", "level", "content")))
    lines = F.transform(ordered, lambda s, i: F.concat(F.repeat(F.lit("#"), s["level"]), F.lit(" "), (i + 1).cast("string"), F.lit(". "), s["title"], F.lit("\n\n"), F.coalesce(s["content"], F.lit(""))))
    return sections.groupBy("report_id").agg(F.array_join(lines, "\n\n").alias("text"))


def json_report(sections: DataFrame) -> DataFrame:
    """(report_id, json): nested sections."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "section_id", "title", "level", "content")))
    return sections.groupBy("report_id").agg(F.to_json(ordered).alias("json"))


def markdown_table(rows: DataFrame, columns: list[str], order: str, most: int = 50, width: int = 50) -> DataFrame:
    """One Markdown table of the first rows, cells cut to width, with a note of what is left out."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, width) for c in columns]), F.lit(" |"))
    n = rows.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    first = rows.orderBy(order).limit(most).select(F.col(order).alias("o"), cells.alias("line"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda r: r["line"]), "\n")
    head = "| " + " | ".join(columns) + " |\n|" + "---|" * len(columns) + "\n"
    more = F.when(n > most, F.concat(F.lit("\n… "), (n - most).cast("string"), F.lit(" more"))).otherwise("")
    return first.agg(F.concat(F.lit(head), body, more).alias("table"))


def docx_bytes(title: str, sections: list[tuple[str, int, str]], pictures: dict[str, bytes] | None = None) -> bytes:
    """A DOCX file of (title, level, content) sections: headings, bullets, Markdown tables, paragraphs, and a PNG picture
    after the section it is named by."""
    held = {name: data for name, data in (pictures or {}).items() if any(name == s[0] for s in sections)}

    def picture(n: int) -> str:
        size = '<wp:extent cx="4572000" cy="2857500"/>'
        fill = f'<pic:blipFill><a:blip r:embed="rIdP{n}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
        shape = '<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="4572000" cy="2857500"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr>'
        about = f'<pic:nvPicPr><pic:cNvPr id="{n}" name="p{n}.png"/><pic:cNvPicPr/></pic:nvPicPr>'
        graphic = f'<a:graphic><a:graphicData uri="http://schemas.openxmlformats.org/drawingml/2006/picture"><pic:pic>{about}{fill}{shape}</pic:pic></a:graphicData></a:graphic>'
        return f'<w:p><w:r><w:drawing><wp:inline>{size}<wp:docPr id="{n}" name="p{n}"/>{graphic}</wp:inline></w:drawing></w:r></w:p>'

    def paragraph(text: str, style: str = "") -> str:
        style = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(text)}</w:t></w:r></w:p>'

    def table(lines: list[str]) -> str:
        rows = [[c.strip() for c in x.strip().strip("|").split("|")] for x in lines if not set(x) <= set("|-: ")]
        return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{paragraph(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"

    body = [paragraph(title, "Title")]
    for n, (name, level, content) in enumerate(sections, 1):
        body.append(paragraph(f"{n}. {name}", f"Heading{min(max(level, 1), 9)}"))
        for block in (content or "").split("\n\n"):
            lines = [x for x in block.split("\n") if x.strip()]
            if block.count("|") >= 4 and len(lines) >= 2:
                body.append(table(lines))
                continue
            for x in lines:
                level = len(x) - len(x.lstrip("#"))
                body.append(paragraph(x[2:], "ListBullet") if x[:2] in ("- ", "* ", "• ") else paragraph(x[level:].strip(), f"Heading{level}") if 0 < level < 7 else paragraph(x))
        if name in held:
            body.append(picture(list(held).index(name) + 1))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<w:document {_SPACES}><w:body>{"".join(body)}</w:body></w:document>')
        links = "".join(f'<Relationship Id="rIdP{n}" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/image" Target="media/p{n}.png"/>' for n in range(1, len(held) + 1))
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for n, data in enumerate(held.values(), 1):
            z.writestr(f"word/media/p{n}.png", data)
    return out.getvalue()


def docx_reports(sections: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """(report_id, content): one DOCX file a report, made where its rows are, with the charts(report_id, title, kind,
    values) of its sections as pictures."""
    import pandas as pd

    from veldspar.sources.rendering import chart_png

    with_charts = charts is not None
    if charts is not None:
        first = charts.groupBy("report_id", "title").agg(F.min(F.struct("kind", "values")).alias("chart")).select("report_id", "title", "chart.*")
        sections = sections.join(first, ["report_id", "title"], "left")

    def make(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord")
        drawn = {t: chart_png(k, list(v)) for t, k, v in zip(rows["title"], rows["kind"], rows["values"], strict=True) if k} if with_charts else {}
        return pd.DataFrame({"report_id": [rows["report_id"].iloc[0]], "content": [docx_bytes(f"Rapor {rows['report_id'].iloc[0]}", list(zip(rows["title"], rows["level"], rows["content"], strict=True)), drawn)]})

    return sections.groupBy("report_id").applyInPandas(make, f"report_id {dict(sections.dtypes)['report_id']}, content binary")
