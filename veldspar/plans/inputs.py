"""Queries of files, settings and stores: small files are written to the shared folder and read from there."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from veldspar.operators.scratch import scratch_path
from veldspar.plans.registry import query, table, value_rows
from veldspar.sources import files as S
from veldspar.sources import media as M
from veldspar.sources import rendering as G
from veldspar.sources import rules as U
from veldspar.sources import sinks as Z

# A workbook, text documents, CSV texts and rule files.
SHEETS = [("Gelir", [["ay", "tutar"], ["Ocak", "10"], ["Şubat", "20"]]), ("Gider", [["ay", "tutar", "not"], ["Ocak", "5", "kira"]])]
PARTS = [("Giriş", 1, "İlk paragraf.\n\n- madde\n\n| Ad | Pay |\n|---|---|\n| Kara | 40 |\n| Deniz | 60 |"), ("Sonuç", 2, "Son söz.")]
RULES = {"01_limits.md": "## Limits\n- one\n- two\nword_count >= 500\nparagraph_count >= 3\n❌ copy\n", "02_sources.md": "## Sources\nTOPLAM RAPOR: 15\nToplam puan: **70**\n| tuik.gov.tr | x |\n"}


def workbook(sheets: list[tuple[str, list[list[str]]]]) -> bytes:
    """An XLSX file of sheets of strings."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets>' + "".join(f'<sheet name="{n}" r:id="rId{i}"/>' for i, (n, _) in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, (_, rows) in enumerate(sheets, 1):
            cells = lambda r: "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' for v in r)
            z.writestr(f"xl/worksheets/sheet{i}.xml", "<worksheet><sheetData>" + "".join(f"<row>{cells(r)}</row>" for r in rows) + "</sheetData></worksheet>")
    return out.getvalue()


def _folder(spark) -> str:
    path = scratch_path(spark, "files")
    drawn = {"Giriş": G.chart_png("pie", [40.0, 60.0])}
    given = {
        "a.xlsx": workbook(SHEETS), "b.docx": Z.docx_bytes("Belge", PARTS, drawn), "c.pdf": G.pdf_bytes("Rapor ığş", [("Özet", 1, "Kısa metin.\nAd   Pay\nKara   40\nDeniz   60")], {"Özet": G.chart_pixels("bar", [1.0, 2.0])}),
        "d.png": drawn["Giriş"], "e.csv": "ad,tutar\nçay,5\nsüt,7\n".encode("cp1254"), "f.csv": "ad,tutar\nkahve,9\n".encode(), "broken.pdf": b"nothing", "note.tmp": b"x",
    }
    for name, content in given.items():
        Z.put_file(spark, f"{path}/{name}", content)
    return path


def _name():
    return F.element_at(F.split("path", "/"), -1).alias("name")


@query("SELECT * FROM (VALUES ('word', 'b.docx'), ('excel', 'a.xlsx'), ('excel', 'e.csv'), ('excel', 'f.csv'), ('pdf', 'c.pdf'), ('pdf', 'broken.pdf'), ('image', 'd.png')) t(category, name)")
def files_found(spark, sf_dir):
    """The supported files of a folder."""
    return S.scan(spark, _folder(spark)).select("category", "name")


@query("SELECT * FROM (VALUES ('word', 1::BIGINT), ('excel', 3), ('pdf', 2), ('image', 1), (NULL, 7)) t(category, files)")
def files_by_category(spark, sf_dir):
    return S.scan_stats(S.scan(spark, _folder(spark))).select("category", "files")


@query("SELECT * FROM (VALUES ('Gelir', 0::BIGINT, 'ay|tutar'), ('Gelir', 1, 'Ocak|10'), ('Gelir', 2, 'Şubat|20'), ('Gider', 0, 'ay|tutar|not'), ('Gider', 1, 'Ocak|5|kira')) t(sheet, row, cells)")
def workbook_rows(spark, sf_dir):
    return S.read_xlsx(spark, _folder(spark)).select("sheet", "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT 'a.xlsx' AS name, 2::BIGINT AS sheets, 3::BIGINT AS rows, 3 AS columns, 'Gelir, Gider' AS names")
def workbook_summary(spark, sf_dir):
    return S.workbook_summary(S.read_xlsx(spark, _folder(spark))).select(_name(), "sheets", "rows", "columns", F.array_join("names", ", ").alias("names"))


@query("SELECT * FROM (VALUES ('çay', 5), ('süt', 7), ('kahve', 9)) t(ad, tutar)")
def csv_rows(spark, sf_dir):
    """Two CSV files, each in an encoding of its own."""
    return S.read_csv(spark, f"{_folder(spark)}/*.csv")


@query("SELECT * FROM (VALUES ('e.csv', 'cp1254'), ('f.csv', 'utf-8-sig')) t(name, encoding)")
def csv_encodings(spark, sf_dir):
    return S.csv_encodings(spark, f"{_folder(spark)}/*.csv").select(_name(), "encoding")


@query("SELECT * FROM (VALUES ('1. Giriş', 'İlk paragraf.' || chr(10) || 'madde' || chr(10) || 'Ad' || chr(10) || 'Pay' || chr(10) || 'Kara' || chr(10) || '40' || chr(10) || 'Deniz' || chr(10) || '60'), ('2. Sonuç', 'Son söz.'), ('Başlıksız', 'Belge')) t(heading, text)")
def word_text_by_heading(spark, sf_dir):
    return S.text_by_heading(S.read_docx(spark, _folder(spark))).select("heading", "text")


@query("SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 'Ad|Pay'), (0, 1, 'Kara|40'), (0, 2, 'Deniz|60')) t(\"table\", row, cells)")
def word_tables(spark, sf_dir):
    return S.read_docx_tables(spark, _folder(spark)).select("table", "row", F.array_join("cells", "|").alias("cells"))


@query("SELECT 12::BIGINT AS paragraphs, 1::BIGINT AS tables, 1::BIGINT AS pictures")
def word_statistics(spark, sf_dir):
    return S.read_docx_stats(spark, _folder(spark)).select("paragraphs", "tables", "pictures")


@query("SELECT * FROM (VALUES ('c.pdf', 1::BIGINT, 'Rapor ığş' || chr(10) || '1. Özet' || chr(10) || 'Kısa metin.' || chr(10) || 'Ad Pay' || chr(10) || 'Kara 40' || chr(10) || 'Deniz 60', NULL), ('broken.pdf', NULL, NULL, 'not a PDF file')) t(name, page, text, error)")
def pdf_pages(spark, sf_dir):
    """Pages of PDF files; what cannot be read is an error."""
    return M.read_pdf(spark, _folder(spark)).select(_name(), "page", "text", "error")


@query("SELECT 'c.pdf' AS name, 480::BIGINT AS width, 300::BIGINT AS height")
def pdf_pictures(spark, sf_dir):
    return M.read_pdf_pictures(spark, _folder(spark)).where("error is null").select(_name(), "width", "height")


@query("SELECT * FROM (VALUES (1, 0, 0, 'Ad|Pay'), (1, 0, 1, 'Kara|40'), (2, 0, 0, 'x|1'), (2, 0, 1, 'y|2'), (2, 1, 0, 'a|b|c'), (2, 1, 1, 'd|e|f')) t(id, \"table\", row, cells)")
def text_tables(spark, sf_dir):
    """Tables that stand in the text of a page."""
    rows = [(i, t, n, "|".join(r)) for i, text in ((1, "Intro\nAd   Pay\nKara\t40\nend"), (2, "x  1\ny  2\na  b  c\nd  e  f\none  line")) for t, found in enumerate(M.text_tables(text)) for n, r in enumerate(found)]
    return spark.createDataFrame(rows, "id int, table int, row int, cells string")


@query("SELECT 'd.png' AS name, 'PNG' AS format, 480::BIGINT AS width, 300::BIGINT AS height")
def picture_info(spark, sf_dir):
    return M.read_pictures(spark, _folder(spark)).select(_name(), "format", "width", "height")


@query("SELECT 7::BIGINT AS files, 7::BIGINT AS pages, 1::BIGINT AS errors")
def files_aggregated(spark, sf_dir):
    """All supported files as one text, with what they are."""
    return M.aggregate(M.read_any(spark, _folder(spark))).select("files", "pages", "errors")


def _rules(spark):
    path = scratch_path(spark, "rules")
    for name, text in RULES.items():
        Z.put_file(spark, f"{path}/{name}", text.encode())
    return U.read_rules(spark, path, sorted(RULES))


@query("SELECT 500 AS min_words, 3 AS min_paragraphs, 15 AS min_sources, 70 AS min_quality, 'tuik.gov.tr' AS domains, 'copy' AS forbidden")
def rule_thresholds(spark, sf_dir):
    return U.thresholds(_rules(spark)).withColumns({c: F.array_join(c, ", ") for c in ("domains", "forbidden")})


@query("SELECT * FROM (VALUES ('Limits', 'one, two', 0), ('Sources', '', 1)) t(title, bullets, n_rows)")
def rule_sections(spark, sf_dir):
    return U.sections(_rules(spark)).select("title", F.array_join("bullets", ", ").alias("bullets"), F.size("table_rows").alias("n_rows"))


@query(f"SELECT text FROM (VALUES {value_rows([(chr(10).join([*RULES.values()][0:1]).rstrip(chr(10)) + chr(10) * 3 + [*RULES.values()][1],)])}) t(text)")
def rule_prompt(spark, sf_dir):
    return U.prompt_text(_rules(spark))


@query(f"SELECT section, key, CASE WHEN key = 'chunk_size' THEN '500' ELSE value END AS value FROM (VALUES {value_rows([(s, k, str(v)) for s, k, v, _ in U.SETTINGS])}) t(section, key, value)")
def settings_rows(spark, sf_dir):
    """All settings, one of them given."""
    return U.settings_rows(spark, U.settings({"chunking": {"chunk_size": 500, "unknown": 1}}, {}))


@query("SELECT unnest(['chunking.chunk_overlap must be below chunk_size', 'chunking.chunk_size must be 50 to 10000', 'context.format_style must be one of numbered, markdown, simple', 'search weights do not add up to 1']) AS problem")
def settings_problems(spark, sf_dir):
    odd = U.settings({"chunking": {"chunk_size": 9}, "context": {"format_style": "odd"}}, {"RAG_SEMANTIC_WEIGHT": "0.9"})
    return spark.createDataFrame([(p,) for p in U.check_settings(odd)], "problem string")


@query("SELECT * FROM (VALUES (0, 9500), (5000, 4500), (20000, 0)) t(prompt_tokens, left_tokens)")
def token_budget(spark, sf_dir):
    return spark.createDataFrame([(n, U.budget(U.settings({}, {}), n)) for n in (0, 5000, 20000)], "prompt_tokens int, left_tokens int")


@query("SELECT 2 * count(*) AS documents, count(DISTINCT text) AS distinct_documents, 32 AS dimension FROM documents WHERE text IS NOT NULL")
def vector_table_stats(spark, sf_dir):
    """A vector table to which all documents are added twice."""
    from veldspar.functions import text as X

    store = Z.VectorTable(spark, scratch_path(spark, "vectors"))
    rows = table(spark, sf_dir, "documents").where("text is not null").select("text", X.hash_embedding(F.col("text")).alias("embedding"), F.create_map(F.lit("source"), "source").alias("meta"))
    store.add(rows)
    store.add(rows)
    return store.stats()


@query("SELECT count(*) AS entries, 2 * count(*) AS hits, 3::BIGINT AS misses, (2 * count(*)) / (2 * count(*) + 3)::DOUBLE AS hit_rate FROM (SELECT DISTINCT source FROM documents)")
def cache_stats(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select(F.col("source").alias("key")).distinct()
    asked = keys.unionByName(keys).unionByName(spark.createDataFrame([("x",), ("y",), ("x",)], "key string"))
    return Z.cache_stats(keys, asked)


@query("SELECT event_type AS operation, count(*) AS calls, round(sum(value), 6) AS total, round(max(value), 6) AS longest FROM events GROUP BY event_type")
def exported_metrics(spark, sf_dir):
    """Timings as JSON lines, read back."""
    path = scratch_path(spark, "metrics")
    Z.write_metrics(table(spark, sf_dir, "events").select(F.col("event_type").alias("operation"), F.col("value").alias("seconds")), path)
    made = spark.read.schema("operation string, calls long, total double, longest double").json(path)
    return made.select("operation", "calls", F.round("total", 6).alias("total"), F.round("longest", 6).alias("longest"))


TEMPLATE = """name: "Kısa Not"
sections:
  - id: "kapak_sayfasi"
    title: "Kapak"
    required: true
  - id: "sonuc"
    title: "Sonuç"
    level: 2
    min_words: 100
    max_words: 400
"""


@query("SELECT * FROM (VALUES ('kisa_not', 1, 'kapak_sayfasi', 'Kapak', true, 1, NULL, NULL), ('kisa_not', 2, 'sonuc', 'Sonuç', false, 2, 100, 400)) t(report_type, ord, section, title, required, level, least_words, most_words)")
def report_templates(spark, sf_dir):
    """Templates from YAML files; one that is broken gives no rows."""
    path = scratch_path(spark, "templates")
    Z.put_file(spark, f"{path}/kisa_not.yaml", TEMPLATE.encode())
    Z.put_file(spark, f"{path}/broken.yaml", b"a: [")
    return U.read_templates(spark, path)


@query("SELECT '- min_words: 500' || chr(10) || '- min_paragraphs: 3' || chr(10) || '- min_sources: 15' || chr(10) || '- min_quality: 70' || chr(10) || '- tuik.gov.tr' || chr(10) || '- copy' AS text")
def rules_summary(spark, sf_dir):
    return U.rules_summary(U.thresholds(_rules(spark)))
