"""Rule files, settings, PDF and picture readers, providers, sinks and caches."""

import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from veldspar.operators import providers as P
from veldspar.operators import rewriting as W
from veldspar.operators import validation as V
from veldspar.sources import dims, files, media, rendering, rules, sinks


def pdf(*pages: bytes, compress: bool = False) -> bytes:
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages)))
    out = [b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"2 0 obj << /Type /Pages /Kids [" + kids + b"] /Count %d >> endobj\n" % len(pages)]
    for i, text in enumerate(pages):
        data = zlib.compress(text) if compress else text
        kind = b" /Filter /FlateDecode" if compress else b""
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (10 + 2 * i, 11 + 2 * i))
        out.append(b"%d 0 obj << /Length %d%s >> stream\n%s\nendstream endobj\n" % (11 + 2 * i, len(data), kind, data))
    return b"".join(out) + b"%%EOF"


def test_pdf_pages():
    first, second = b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td [(Wor) -20 (ld)] TJ ET", b"BT <48692E> Tj ET"
    for compress in (False, True):
        assert media.pdf_pages(pdf(first, second, compress=compress)) == ["Hello (you)\nWorld", "Hi."]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", w, h) + b"\x08\0\0\0\0"


def test_pictures():
    assert media.picture(png(3, 4)) == ("PNG", 3, 4)
    assert media.picture(b"GIF89a" + struct.pack("<HH", 5, 6)) == ("GIF", 5, 6)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 8) + b"\x03" * 12
    assert media.picture(jpeg) == ("JPEG", 8, 7)
    with pytest.raises(ValueError):
        media.picture(b"text")


def test_any_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(b"BT (One) Tj ET", b"BT (Two) Tj ET"))
    (tmp_path / "b.png").write_bytes(png(3, 4))
    (tmp_path / "c.csv").write_text("x,y\n1,2")
    (tmp_path / "d.docx").write_bytes(b"broken")
    read = media.read_any(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert (got["a.pdf"].text, got["a.pdf"].pages) == ("One\n\nTwo", 2) and got["b.png"].text == "PNG 3x4"
    assert got["c.csv"].text == "x,y\n1,2" and got["d.docx"].error and got["d.docx"].text is None
    whole = media.aggregate(read).first()
    assert (whole.files, whole.errors, whole.pages) == (4, 1, 4) and whole.text.startswith("=== a.pdf ===\nOne")
    pages = media.read_pdf(spark, str(tmp_path))
    assert media.full_text(pages).first().text == "One\n\nTwo"
    assert [(r.format, r.width) for r in media.read_pictures(spark, str(tmp_path)).collect()] == [("PNG", 3)]


def test_rules(spark, tmp_path):
    (tmp_path / "01.md").write_text("# A\n## Limits\n- one\n- two\nword_count >= 500\nparagraph_count >= 3\n```py\nx\n```\n❌ copy\n", encoding="utf-8")
    (tmp_path / "02.md").write_text("## Sources\nTOPLAM RAPOR: 15\nToplam puan: **70**\n| tuik.gov.tr | x |\n", encoding="utf-8")
    r = rules.read_rules(spark, str(tmp_path), ["01.md"])
    with pytest.raises(FileNotFoundError):
        rules.read_rules(spark, str(tmp_path), ["03.md"])
    t = rules.thresholds(r).first()
    assert (t.min_words, t.min_paragraphs, t.min_sources, t.min_quality, t.domains, t.forbidden) == (500, 3, 15, 70, ["tuik.gov.tr"], ["copy"])
    s = {x.title: x for x in rules.sections(r).collect()}
    assert s["Limits"].bullets == ["one", "two"] and s["Limits"].code == ["x\n"] and s["Sources"].table_rows == ["| tuik.gov.tr | x |"]
    assert rules.prompt_text(r).first().text.startswith("# A")


def test_settings():
    s = rules.settings({"chunking": {"chunk_size": 500, "unknown": 1}, "mmr": {"lambda": 0.5}}, {"RAG_SEMANTIC_WEIGHT": "0.7", "RAG_RERANKING_ENABLED": "0"})
    assert (s.chunking.chunk_size, s.mmr.lambda_param, s.hybrid_search.semantic_weight, s.reranking.enabled) == (500, 0.5, 0.7, False)
    assert rules.check_settings(s) == ["search weights do not add up to 1"]
    assert rules.budget(rules.settings({}, {})) == 9500 and rules.check_settings(rules.settings({}, {})) == []


def test_pdf_fonts_and_object_streams():
    page = b"BT /F1 12 Tf <00410042> Tj /F2 9 Tf (\\360\\376x) Tj ET"
    cmap = b"2 beginbfchar <0041> <015F> <0043> <00000041> endbfchar 1 beginbfrange <0042> <0044> <0131> endbfrange"
    inner = [b"<< /Type /Font /Subtype /Type0 /ToUnicode 9 0 R >>", b"<< /Type /Font /Encoding << /Differences [240 /gbreve 254 /scedilla] >> >>"]
    head = b"5 0 6 %d " % len(inner[0])
    packed = zlib.compress(head + inner[0] + inner[1])
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [3 0 R] /Resources << /Font << /F1 5 0 R /F2 6 0 R >> >> >> endobj\n"
    out += b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj\n4 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(page), page)
    out += b"8 0 obj << /Type /ObjStm /N 2 /First %d /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n" % (len(head), len(packed), packed)
    out += b"9 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    assert media.pdf_pages(out) == ["şığşx"]
    for broken, message in ((b"text", "not a PDF"), (b"%PDF-1.4 trailer << /Encrypt 4 0 R >>", "encrypted"), (b"%PDF-1.4\n", "no pages"), (out.replace(b"/Length %d >> stream\nBT" % len(page), b"/Filter /LZWDecode >> stream\nBT"), "LZWDecode")):
        with pytest.raises(ValueError, match=message):
            media.pdf_pages(broken)


def test_reports_as_pdf_with_charts(spark):
    sections = spark.createDataFrame([(1, 1, "Özet", 1, "Çok ığşİĞŞ güzel (evet) \\ bitti.\n" * 80), (1, 2, "Sonuç", 2, None)], "report_id int, ord int, title string, level int, content string")
    charts = spark.createDataFrame([(1, "Özet", "bar", [1.0, 3.0])], "report_id int, title string, kind string, values array<double>")
    made = bytes(rendering.pdf_reports(sections, charts).first().content)
    pages = media.pdf_pages(made)
    assert len(pages) > 1 and pages[0].startswith("Rapor 1\n1. Özet\nÇok ığşİĞŞ güzel (evet) \\ bitti.") and "2. Sonuç" in pages[-1]
    assert media.pdf_pictures(made) == [(480, 300)]
    assert media.pdf_pictures(bytes(rendering.pdf_reports(sections).first().content)) == []


def test_registered_readers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(media, "READERS", dict(media.READERS))
    (tmp_path / "a.note").write_text("hello")
    (tmp_path / "b.doc").write_bytes(b"old")
    assert [r.error for r in media.read_any(spark, str(tmp_path)).collect()] == ["no reader for files of this extension"]
    media.register(".NOTE", lambda content: (content.decode().upper(), 1))
    assert ".note" in media.supported_extensions()
    assert {r.path.rpartition("/")[2]: r.text for r in media.read_any(spark, str(tmp_path)).collect()} == {"a.note": "HELLO", "b.doc": None}


def test_charts():
    bars = rendering.chart_pixels("bar", [1.0, 2.0, 0.0])
    painted = [(bars[:, 160 * i + 80] != 255).any(axis=1).sum() for i in range(3)]
    assert painted[1] == 280 and painted[0] == 140 and painted[2] == 0
    pie = rendering.chart_pixels("pie", [1.0, 3.0])
    share = (pie.reshape(-1, 3) == rendering.COLOURS[0]).all(axis=1).sum() / (pie.reshape(-1, 3) != 255).any(axis=1).sum()
    assert abs(share - 0.25) < 0.01
    assert (rendering.chart_pixels("pie", []) == 255).all() and media.picture(rendering.chart_png("pie", [1.0])) == ("PNG", 480, 300)


def test_providers(spark):
    rows = spark.createDataFrame([(i, f"p{i}") for i in range(70)], "id int, prompt string")
    got = P.generate(rows, F.col("prompt"), lambda ps: [p.upper() for p in ps]).where("id = 69").first()
    assert got.answer == "P69"
    assert len(P.embed(rows, F.col("prompt")).first().embedding) == 32
    assert P.embed(rows, F.col("prompt"), model=lambda ts: [[float(len(t))] for t in ts]).first().embedding == [len("passage: p0")]


def test_vector_table_and_caches(spark, tmp_path):
    t = sinks.VectorTable(spark, str(tmp_path / "v"))
    rows = spark.createDataFrame([("a", [1.0], {"k": "v"}), ("b", [2.0], {})], "text string, embedding array<float>, meta map<string,string>")
    t.add(rows)
    t.add(rows)
    assert t.count() == 4 and t.read().select("id").distinct().count() == 2
    t.replace(rows)
    assert t.count() == 2
    t.drop()
    assert not (tmp_path / "v").exists()
    made = spark.sql("SELECT * FROM VALUES ('a', 1, TIMESTAMP'2024-01-01 00:00:00'), ('a', 2, TIMESTAMP'2024-01-02 10:00:00'), ('b', 3, TIMESTAMP'2023-01-01 00:00:00') t(key, value, created)")
    now = F.lit("2024-01-02 12:00:00").cast("timestamp")
    assert [(r.key, r.value) for r in sinks.fresh(made, now, 24).collect()] == [("a", 2)]
    used = spark.createDataFrame([(f"k{i}", i) for i in range(10)], "key string, used int")
    assert sinks.evict(used, 5).count() == 8 and sinks.evict(used, 50).count() == 10


def test_reports(spark, tmp_path):
    sections = spark.createDataFrame([(1, "b", 2, "B", 2, "- x\n\n| a | b |\n|---|---|\n| 1 | 2 |"), (1, "a", 1, "A", 1, "text & more")], "report_id int, section_id string, ord int, title string, level int, content string")
    made = sinks.docx_reports(sections).first().content
    (tmp_path / "r.docx").write_bytes(made)
    assert [t for t, _, _ in files.docx_paragraphs(bytes(made))][:3] == ["Rapor 1", "1. A", "text & more"]
    assert zipfile.ZipFile(tmp_path / "r.docx").testzip() is None
    assert sinks.markdown_report(sections).first().text.startswith("# 1. A\n\ntext & more\n\n## 2. B")
    rows = spark.range(60).select("id", F.repeat(F.lit("y"), F.lit(80)).alias("t"))
    table = sinks.markdown_table(rows, ["id", "t"], "id").first().table.split("\n")
    assert len(table) == 2 + 50 + 1 and table[2] == "| 0 | " + "y" * 50 + " |" and table[-1] == "… 10 more"


def test_fixed_tables(spark):
    line = dims.statistics_table(spark).where("indicator = 'population'").first().line
    assert line == "| Türkiye nüfusu | 85.4M kişi | 2023 |"


def test_charts_are_capped(spark):
    charts = spark.createDataFrame([(d, "pie", [f"l{i}"], [1.0]) for d in range(8) for i in range(4)], "doc_id int, kind string, labels array<string>, values array<double>")
    assert W.top_charts(charts).count() == 10


def test_prefix_currency_and_units(spark):
    got = spark.createDataFrame([("₺1.234,56 ve 5 milyon TL ve $20",)], "t string").select(V.money(F.col("t")).alias("m")).first().m
    assert sorted(got) == [20.0, 1234.56, 5e6]
