"""Charts as pictures, and reports as PDF files, written with the standard library and NumPy."""

from __future__ import annotations

import re
import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT = 480, 300
#: Colours of bars and slices, in turn.
COLOURS = [(46, 134, 171), (162, 59, 114), (241, 143, 1), (199, 62, 29), (59, 31, 43), (106, 153, 78)]
PAGE, MARGIN = (595, 842), 50
# Where Windows-1254 differs from Windows-1252, with the names of the letters' shapes.
LETTERS = {208: ("Ğ", "Gbreve"), 221: ("İ", "Idotaccent"), 222: ("Ş", "Scedilla"), 240: ("ğ", "gbreve"), 253: ("ı", "dotlessi"), 254: ("ş", "scedilla")}


def chart_pixels(kind: str, values: list[float], width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """A bar or pie chart as rows of RGB pixels. Negative values count as zero."""
    out = np.full((height, width, 3), 255, np.uint8)
    shown = np.maximum(np.nan_to_num(np.array(values, float)), 0)
    if not len(shown) or shown.sum() <= 0:
        return out
    if kind == "pie":
        y, x = np.mgrid[:height, :width]
        y, x = y - height / 2, x - width / 2
        part = np.searchsorted(np.cumsum(shown) / shown.sum(), (np.arctan2(x, -y) / (2 * np.pi)) % 1.0, side="right").clip(0, len(shown) - 1)
        inside = np.hypot(x, y) < 0.45 * min(width, height)
        out[inside] = np.array(COLOURS, np.uint8)[part[inside] % len(COLOURS)]
        return out
    slot = width / len(shown)
    for i, v in enumerate(shown / shown.max()):
        left, right = int(slot * (i + 0.15)), max(int(slot * (i + 0.15)) + 1, int(slot * (i + 0.85)))
        out[height - 10 - int(v * (height - 20)) : height - 10, left:right] = COLOURS[i % len(COLOURS)]
    return out


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of RGB pixels."""
    height, width, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.concatenate((np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def chart_png(kind: str, values: list[float]) -> bytes:
    return png(chart_pixels(kind, values))


def chart_files(charts: DataFrame) -> DataFrame:
    """charts(kind, labels, values) with content, a PNG file, made where the rows are."""
    import pandas as pd

    def drawn(kind, values):
        return pd.Series([chart_png(k, list(v)) for k, v in zip(kind, values, strict=True)])

    # The annotations are set here, as pandas is only imported where it is used.
    drawn.__annotations__ = {"kind": pd.Series, "values": pd.Series, "return": pd.Series}
    return charts.withColumn("content", F.pandas_udf(drawn, "binary")("kind", "values"))


def chart_svg(labels: Column, values: Column, width: int = WIDTH, height: int = HEIGHT) -> Column:
    """A bar chart with labels as SVG text, in built-in functions."""
    most = F.greatest(F.array_max(values), F.lit(1e-9))
    slot = F.lit(float(width)) / F.size(values)
    whole = lambda x: F.round(x, 1).cast("string")
    safe = lambda s: F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def bar(v: Column, i: Column) -> Column:
        tall = F.greatest(v, F.lit(0.0)) / most * (height - 40)
        return F.concat(
            F.lit('<rect x="'), whole(slot * (i + F.lit(0.15))), F.lit('" y="'), whole(height - 20 - tall), F.lit('" width="'), whole(slot * 0.7), F.lit('" height="'), whole(tall), F.lit('"/><text x="'),
            whole(slot * (i + F.lit(0.5))), F.lit(f'" y="{height - 5}" text-anchor="middle">'), safe(F.coalesce(F.get(labels, i), F.lit(""))), F.lit("</text>"),
        )

    return F.concat(F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">'), F.array_join(F.transform(values, bar), ""), F.lit("</svg>"))


def _wrapped(text: str, size: int) -> list[str]:
    """Lines of a width that fits the page, by the letters' mean width."""
    most, out = int((PAGE[0] - 2 * MARGIN) / (0.5 * size)), []
    for line in text.split("\n"):
        held = ""
        for word in line.split():
            if held and len(held) + 1 + len(word) > most:
                out.append(held)
                held = ""
            held = f"{held} {word}" if held else word
            while len(held) > most:
                out.append(held[:most])
                held = held[most:]
        out.append(held)
    return out


def pdf_bytes(title: str, sections: list[tuple[str, int, str]], charts: dict[str, np.ndarray] | None = None) -> bytes:
    """A PDF file of (title, level, content) sections, with the pixels of a chart after the section it is named by."""
    items: list[tuple[str, int] | np.ndarray] = [(x, 18) for x in _wrapped(title, 18)]
    for n, (name, level, content) in enumerate(sections, 1):
        size = 14 if level <= 1 else 12
        items += [("", 10), *((x, size) for x in _wrapped(f"{n}. {name}", size)), *((re.sub(r"\*\*|^#+\s*", "", x), 10) for x in _wrapped(content or "", 10))]
        if charts and name in charts:
            items.append(charts[name])
    pages: list[tuple[list[bytes], list[np.ndarray]]] = [([], [])]
    y = PAGE[1] - MARGIN
    for item in items:
        tall = int(item[1] * 1.4) if isinstance(item, tuple) else item.shape[0]
        if y - tall < MARGIN and y < PAGE[1] - MARGIN:
            pages.append(([], []))
            y = PAGE[1] - MARGIN
        y -= tall
        out, pictures = pages[-1]
        if isinstance(item, tuple):
            text = "".join(chr(next((c for c, (x, _) in LETTERS.items() if x == ch), 0)) if any(ch == x for x, _ in LETTERS.values()) else ch for ch in item[0])
            raw = b"".join(bytes([ord(ch)]) if ord(ch) in LETTERS else ch.encode("cp1252", "replace") for ch in text)
            out.append(b"BT /F1 %d Tf %d %d Td (%s) Tj ET" % (item[1], MARGIN, y, re.sub(rb"([\\()])", rb"\\\1", raw)))
        else:
            out.append(b"q %d 0 0 %d %d %d cm /I%d Do Q" % (item.shape[1], item.shape[0], MARGIN, y, len(pictures)))
            pictures.append(item)
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    differences = b" ".join(b"%d /%s" % (c, name.encode()) for c, (_, name) in LETTERS.items())
    objects.append(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding << /Type /Encoding /BaseEncoding /WinAnsiEncoding /Differences [" + differences + b"] >> >>")
    kids = []

    def stream(data: bytes, about: bytes = b"") -> bytes:
        packed = zlib.compress(data)
        return b"<< /Length %d /Filter /FlateDecode %s>> stream\n%s\nendstream" % (len(packed), about, packed)

    for out, pictures in pages:
        names = []
        for k, p in enumerate(pictures):
            objects.append(stream(p.tobytes(), b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace /DeviceRGB /BitsPerComponent 8 " % (p.shape[1], p.shape[0])))
            names.append(b"/I%d %d 0 R" % (k, len(objects)))
        objects.append(stream(b"\n".join(out)))
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> /XObject << %s >> >> /Contents %d 0 R >>" % (*PAGE, b" ".join(names), len(objects)))
        kids.append(b"%d 0 R" % len(objects))
    objects[1] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(kids)
    made, places = b"%PDF-1.4\n", []
    for n, body in enumerate(objects, 1):
        places.append(len(made))
        made += b"%d 0 obj %s endobj\n" % (n, body)
    table = b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return made + table + b"trailer << /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF" % (len(objects) + 1, len(made))


def pdf_reports(sections: DataFrame, charts: DataFrame | None = None) -> DataFrame:
    """(report_id, content): one PDF file a report of sections(report_id, ord, title, level, content), with the charts
    (report_id, title, kind, values) of its sections."""
    import pandas as pd

    rows = sections.select("report_id", "ord", "title", "level", "content")
    if charts is not None:
        first = charts.groupBy("report_id", "title").agg(F.min(F.struct("kind", "values")).alias("chart")).select("report_id", "title", "chart.*")
        rows = rows.join(first, ["report_id", "title"], "left")
    else:
        rows = rows.withColumns({"kind": F.lit(None).cast("string"), "values": F.lit(None).cast("array<double>")})

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        drawn = {t: chart_pixels(k, list(v)) for t, k, v in zip(part["title"], part["kind"], part["values"], strict=True) if k}
        content = pdf_bytes(f"Rapor {part['report_id'].iloc[0]}", list(zip(part["title"], part["level"], part["content"], strict=True)), drawn)
        return pd.DataFrame({"report_id": [part["report_id"].iloc[0]], "content": [content]})

    return rows.groupBy("report_id").applyInPandas(make, f"report_id {dict(sections.dtypes)['report_id']}, content binary")
