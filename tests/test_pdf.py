"""The PDF reader: syntax, filters, layout, and screening of whole files."""

import base64
import zlib

import pytest
from pyspark.sql import functions as F

from veilsift.cli import main
from veilsift.plans.screen import Screen, default_registry
from veilsift.plans.model import ScreenConfig
from veilsift.sources import pdf, pdf_samples
from veilsift.sources.files import binary_documents
from veilsift.sources.pdf import parse_files, parsed, scan_files, screen_arriving
from veilsift.sources.pdf_fonts import glyph
from veilsift.sources.pdf_objects import Name, PdfFile, Ref, Stream, Syntax, Word, decoded
from veilsift.sources.pdf_samples import Page, of_lines, sample_files, write_samples, written

GOLDEN = {
    "clean": ("clean", 0),
    "dark_banner": ("clean", 0),
    "white_text": ("malicious", 78),
    "tiny_font": ("malicious", 78),
    "invisible_render_mode": ("malicious", 78),
    "offpage": ("malicious", 78),
    "metadata": ("malicious", 78),
    "annotation": ("malicious", 78),
    "visible_injection": ("malicious", 70),
}


def screen():
    return Screen(ScreenConfig(), default_registry())


def drawn(content, resources=b"", page=b"", more=b""):
    """A file of one page with this content stream."""
    return (
        b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"
        b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 200 100] >> endobj\n"
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F 5 0 R >> " + resources + b" >> " + page + b" >> endobj\n"
        b"4 0 obj << /Length " + str(len(content)).encode() + b" >> stream\n" + content + b"\nendstream endobj\n"
        b"5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica >> endobj\n" + more + b"trailer << /Root 1 0 R >>"
    )


def spans(*args, **named):
    row = parsed(drawn(*args, **named))
    assert row["error"] is None
    return row["spans"]


def words(*args, **named):
    return [s["text"] for s in spans(*args, **named)]


def test_syntax():
    s = Syntax(b"<< /A#20b 1 /B [1 0 R (a\\(b(c)\\101\\\nd) <414> -1.5 +2 .5 true null] >> % note\n Tj")
    assert s.value() == {"A b": 1, "B": [Ref(1), b"a(b(c)Ad", b"A@", -1.5, 2, 0.5, True, Word("null")]}
    assert s.value() == Word("Tj") and s.value() is s.END
    assert Syntax(b"[1 [2").value() == [1, [2]]
    assert Syntax(b"(never closed").value() == b"never closed"


def filtered(raw, **info):
    class Direct:
        get = staticmethod(lambda v: v)

    return decoded(Stream(info, raw, Direct))


def test_filters():
    data = bytes(range(256)) * 5
    flate = zlib.compress(data)
    assert filtered(flate, Filter=Name("FlateDecode")) == data
    assert filtered(flate[:-6], Filter=Name("FlateDecode"))[:1000] == data[:1000]
    assert filtered(b"3631>", Filter=[Name("ASCIIHexDecode")]) == b"61"
    assert filtered(base64.a85encode(data, adobe=True), Filter=Name("ASCII85Decode")) == data
    assert filtered(b"\x02abc\xfez\x80", Filter=Name("RunLengthDecode")) == b"abczzz"
    assert filtered(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01]), Filter=Name("LZWDecode")) == b"-----A---B"
    rows = b"".join(bytes([k]) + bytes([1, 2, 3, 4]) for k in (0, 1, 2, 3, 4))
    parms = {"Predictor": 12, "Columns": 4}
    assert filtered(zlib.compress(rows), Filter=Name("FlateDecode"), DecodeParms=parms)[:12] == bytes([1, 2, 3, 4, 1, 3, 6, 10, 2, 5, 9, 14])


def test_words_gaps_and_kerning():
    assert words(b"BT /F 10 Tf 10 50 Td [(Hel) -20 (lo) -400 (you)] TJ ET") == ["Hello you"]
    assert words(b"BT /F 10 Tf 10 50 Td (a) Tj 100 0 Td (b) Tj ET") == ["a", "b"]
    assert words(b"BT /F 10 Tf 12 TL 10 50 Td (a) Tj T* (b) Tj (c) ' ET") == ["a", "b", "c"]
    assert words(b"BT 10 50 Td (no font) Tj ET") == []
    assert words(b"BT /F 10 Tf (x) Td Tm (kept) Tj ET") == ["kept"]  # operators without operands do nothing


def test_looks():
    s = spans(b"1 1 1 rg BT /F 10 Tf 10 50 Td (w) Tj 0 g (b) Tj 3 Tr (i) Tj ET q 0 0 0 1 k BT /F 5 Tf 2 0 0 2 0 0 Tm 0 Tr (k) Tj ET Q")
    assert [(x["text"], x["color"], x["alpha"], round(x["size"], 3)) for x in s] == [("w", 0xFFFFFF, 255, 10), ("b", 0, 255, 10), ("i", 0, 0, 10), ("k", 0, 255, 10)]
    s = spans(b"/G gs BT /F 10 Tf (faint) Tj ET", b"/ExtGState << /G << /ca 0.05 >> >>")
    assert s[0]["alpha"] == 13


@pytest.mark.parametrize("turn", [0, 90, 180, 270])
def test_rotation_keeps_text_on_its_page(turn):
    row = parsed(drawn(b"BT /F 10 Tf 10 50 Td (here) Tj ET", page=b"/Rotate %d" % turn))
    page, span = row["pages"][0], row["spans"][0]
    assert (page["px1"], page["py1"]) == ((200, 100) if turn % 180 == 0 else (100, 200))
    assert 0 <= span["x0"] < span["x1"] <= page["px1"] and 0 <= span["y0"] < span["y1"] <= page["py1"]


def test_forms_inline_images_and_fills():
    form = b"6 0 obj << /Subtype /Form /Matrix [1 0 0 1 5 5] /Resources << /Font << /F 5 0 R >> /XObject << /X 6 0 R >> >> /Length 45 >> stream\nBT /F 10 Tf (in form) Tj ET /X Do             \nendstream endobj\n"
    found = words(b"BI /W 1 ID \x00(EI)\x01 EI /X Do", b"/XObject << /X 6 0 R >>", more=form)
    assert set(found) == {"in form"}  # a form that shows itself ends
    row = parsed(drawn(b"0.5 g 10 20 30 40 re f 1 0 0 rg 0 0 m 5 0 l 5 5 l h B /P cs /Q scn 0 0 9 9 re f", b""))
    assert [(f["x0"], f["y0"], f["x1"], f["y1"], f["r"]) for f in row["fills"]] == [(10, 40, 40, 80, 0.5), (0, 95, 5, 100, 1.0)]


def test_encodings():
    assert glyph("eacute") == "é" and glyph("Ccaron") == "Č" and glyph("uni0041") == "A" and glyph("fi") == "fi" and glyph("g17") == "�"
    font = b"5 0 obj << /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /Differences [65 /eacute /space /B] >> >> endobj\n"
    assert words(b"BT /F 10 Tf (AC) Tj ET", more=font) == ["éB"]  # the later of two objects of one number counts
    cmap = b"1 beginbfchar <41> <00660069> endbfchar 1 beginbfrange <42> <43> [<0058> <0059>] endbfrange"
    font = b"5 0 obj << /Type /Font /Subtype /Type1 /ToUnicode 7 0 R >> endobj 7 0 obj << /Length %d >> stream\n%s\nendstream endobj\n" % (len(cmap), cmap)
    assert words(b"BT /F 10 Tf (ABC) Tj ET", more=font) == ["fiXY"]


def test_object_streams():
    inner = b"1 0 2 36 << /Type /Catalog /Pages 2 0 R >>     << /Type /Pages /Kids [3 0 R] /MediaBox [0 0 9 9] >>"
    packed = zlib.compress(inner)
    data = (
        b"%%PDF-1.5\n9 0 obj << /Type /ObjStm /N 2 /First 9 /Filter /FlateDecode /Length %d >> stream\n%s\nendstream endobj\n"
        b"3 0 obj << /Type /Page >> endobj 8 0 obj << /Type /XRef /Root 1 0 R /Length 0 >> stream\n\nendstream endobj" % (len(packed), packed)
    )
    assert PdfFile(data).root["Pages"] == Ref(2)
    assert parsed(data)["pages"] == [{"page": 0, "px0": 0.0, "py0": 0.0, "px1": 9.0, "py1": 9.0}]


def test_bad_files_have_an_error_each():
    good = of_lines(["a line"])
    for bad in (None, b"", b"junk", b"%PDF-1.4", good.replace(b"/Pages", b"/Pagez"), good[:9] + b"(" * 5000, good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 3 0 R")):
        row = parsed(bad)
        assert row["error"] and row["spans"] == [] and row["xmp"] is None
    assert parsed(good[: good.rfind(b"xref")])["spans"][0]["text"] == "a line"  # no table is needed


def test_damaged_files_never_raise():
    import random

    rng = random.Random(5)
    good = written([Page()], {"title": "t" * 70}, "<x>" + "y" * 70 + "</x>") + of_lines(["some words", "привет"])
    for _ in range(300):
        data = bytearray(good)
        for _ in range(rng.randint(1, 30)):
            data[rng.randrange(9, len(data))] = rng.randrange(256)
        parsed(bytes(data))


def test_lines_come_back(spark):
    lines = ["plain", "it's (odd) \\ <x>", "привет мир", "日本 😀 é", "x" * 3000, "tab\there"]
    row = parsed(of_lines(lines * 30))
    assert [s["text"] for s in row["spans"]] == lines * 30
    assert len(row["pages"]) == 4
    assert row["extractions"][1]["text"] == "\n".join(lines * 30)


def test_samples_get_their_verdicts(spark):
    files = sample_files(spark)
    found = scan_files(files, screen()).join(files.select("doc_id", "technique"), "doc_id").collect()
    assert {r["technique"]: (r["verdict"], r["risk_score"]) for r in found} == GOLDEN
    assert all(r["pages"] == 1 and not r["errors"] for r in found)
    hidden = next(r for r in found if r["technique"] == "offpage")
    assert "pdf_structure.offpage" in {f["detector"] for f in hidden["findings"]}
    assert any(f["detector"].startswith("extractor_divergence") for f in hidden["findings"])


def test_odd_rows(spark):
    rows = [(1, None), (2, b"junk"), (None, of_lines(["x"]))]
    files = spark.createDataFrame(rows, "doc_id long, content binary").withColumn("error", F.lit("clash")).withColumn("spans", F.lit(1))
    found = {r["doc_id"]: r for r in parse_files(files).collect()}
    assert found[1]["error"] and found[2]["error"] and found[None]["spans"][0]["text"] == "x"
    assert parse_files(files.limit(0)).count() == 0
    broken = {r["doc_id"]: r for r in scan_files(files.where("doc_id is not null"), screen()).collect()}
    assert all(r["verdict"] == "suspicious" and r["risk_score"] == 0 and r["errors"] for r in broken.values())


def test_folder_stream_and_command_line(spark, tmp_path, capsys):
    write_samples(tmp_path / "in")
    files = binary_documents(spark, str(tmp_path / "in"))
    assert files.count() == 9
    screen_arriving(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), screen()).awaitTermination()
    streamed = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["risk_score"]) for r in streamed.collect()} == {(r["doc_id"], r["risk_score"]) for r in scan_files(files, screen()).collect()}

    assert main(["scan", str(tmp_path / "in" / "clean.pdf")], spark) == 0
    assert "clean" in capsys.readouterr().out
    report = tmp_path / "r.json"
    assert main(["scan", str(tmp_path / "in" / "white_text.pdf"), "--json", "-o", str(report)], spark) == 2
    assert '"malicious"' in report.read_text()
    assert main(["scan", str(tmp_path / "none.pdf")], spark) == 1
    assert main(["scan", str(tmp_path / "in" / "clean.pdf"), "-o", str(report)], spark) == 1
    assert main(["sanitize", str(tmp_path / "in" / "visible_injection.pdf")], spark) == 0
    assert "REDACTED" in capsys.readouterr().out
    assert main(["samples"], spark) == 0 and "dark_banner" in capsys.readouterr().out


def test_extractors_of_the_caller_and_their_errors(spark):
    def failing(content):
        raise RuntimeError("cannot")

    content = pdf_samples.samples()[0].content
    rows = pdf.parsed(content, {"mine": lambda b: f"{len(b)} bytes\ud800", "bad": failing})["extractions"]
    assert [r["extractor"] for r in rows][:2] == ["page", "unclipped"] and [r["extractor_ord"] for r in rows] == list(range(len(rows)))
    by = {r["extractor"]: r for r in rows}
    assert by["mine"]["text"].startswith(f"{len(content)} bytes") and by["mine"]["error"] is None
    assert (by["bad"]["text"], by["bad"]["error"]) == ("", "RuntimeError: cannot")
    files = spark.createDataFrame([(1, bytearray(content))], "doc_id long, content binary")
    held = pdf.pdf_relations(files, {"bad": failing}).extractions.where("extractor = 'bad'").first()
    assert held["error"] == "RuntimeError: cannot"
