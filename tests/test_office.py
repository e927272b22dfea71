"""Office files as other programs write them: nested, packed, damaged, hostile."""

import io
import zipfile
import zlib

from pyspark.sql import functions as F

from lectern.functions import office
from lectern.operators import documents
from lectern.plans.office_files import written


def _zip(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_ooxml():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    xml = f'<w:document {w}><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>한글 &amp; x</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:body></w:document>'
    assert office.docx(_zip({"word/document.xml": xml, "word/header1.xml": "<x/>"})) == "a\tb\nc\n한글 & x\n"
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>1</v></c><c r="C1"><v>3.5</v></c></row><row r="2"/><row r="3"><c r="AA3" t="inlineStr"><is><r><t>x</t></r><r><t>y</t></r></is></c></row></sheetData></worksheet>'
    got = office.xlsx(_zip({"xl/sharedStrings.xml": "<sst><si><t>no</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>", "xl/worksheets/sheet1.xml": sheet, "xl/worksheets/sheet10.xml": '<worksheet><row><c><v>z</v></c></row></worksheet>', "xl/worksheets/sheet2.xml": '<worksheet><row><c><v>2</v></c></row></worksheet>'}))
    assert got == "rich\t\t3.5\n\n" + "\t" * 26 + "xy\n2\nz"
    slide = lambda t: f'<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:sld>'
    assert office.pptx(_zip({f"ppt/slides/slide{k}.xml": slide(k) for k in (10, 2, 1)})) == "1\n2\n10"


def _pdf(objects, head=b"%PDF-1.4\n"):
    return head + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, b) for n, b in objects.items())


def test_pdf():
    content = rb"BT /F1 9 Tf 1 0 0 1 40 700 Tm (Plain \(nested (one)\) \101\tx) Tj 0 -12 Td [(wo) -20 (rd) -300 (gap)] TJ T* <e9> Tj (next) ' ET q (off) Do Q"
    base = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 9 0 R] >>", 4: b"<< /Length 9 >>\nstream\n" + content + b"\nendstream", 3: b"<< /Type /Page /Parent 2 0 R /Contents [4 0 R] /Resources 5 0 R >>", 5: b"<< /Font << /F1 6 0 R >> >>", 6: b"<< /Type /Font >>"}
    assert office.pdf(_pdf(base)) == "Plain (nested (one)) A\tx\nword gap\né\nnext"
    cmap = b"1 beginbfrange <0041> <0043> <AC00> endbfrange 1 beginbfrange <0050> <0051> [<0078> <00790079>] endbfrange"
    own = base | {6: b"<< /Type /Font /ToUnicode 7 0 R >>", 7: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(cmap) + b"\nendstream", 4: b"<< >>\nstream\nBT /F1 9 Tf <00410043 00500051> Tj ET\nendstream"}
    assert office.pdf(_pdf(own)) == "가각xyy".replace("각", chr(0xAC02))
    # objects in an object stream, a page tree that leads back to itself
    inner = b"2 0 3 %d " % len(own[2] + b" ")
    packed = own | {8: b"<< /Type /ObjStm /N 2 /First %d /Filter /FlateDecode >>\nstream\n" % len(inner) + zlib.compress(inner + own[2] + b" " + own[3]) + b"\nendstream", 9: b"<< /Type /Pages /Kids [2 0 R] >>"}
    del packed[2], packed[3]
    assert office.pdf(_pdf(packed)) == office.pdf(_pdf(own))


def test_files_that_cannot_be_read(spark, monkeypatch):
    monkeypatch.setattr(office, "MOST", 1 << 20)
    bomb = _zip({"word/document.xml": b" " * (2 << 20)})
    thick = _pdf({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Page /Contents 3 0 R >>", 3: b"<< /Filter /FlateDecode >>\nstream\n" + zlib.compress(b" " * (2 << 20)) + b"\nendstream"})
    rows = [(1, "docx", bytearray(written("a\nb", "docx"))), (2, "docx", bytearray(written("a", "docx")[:-30])), (3, "docx", bytearray(bomb)), (4, "pdf", bytearray(b"no")), (5, "pdf", bytearray(thick)), (6, "xlsx", None), (7, "xlsx", bytearray(_zip({"x": "y"}))), (8, "zip", bytearray(bomb)), (9, "docx", bytearray(_zip({"word/document.xml": "<a><b></a>"})))]
    df = spark.createDataFrame(rows, "id int, ext string, content binary").coalesce(1)
    for kind in office.READERS:
        read = office.READERS[kind]
        for _, ext, raw in rows:
            if ext == kind and raw is not None:
                try:
                    assert isinstance(read(bytes(raw)), str)
                except Exception as e:  # noqa: BLE001
                    assert not isinstance(e, MemoryError)
    got = {r.id: r.text for r in df.filter("id not in (3, 5)").select("id", documents.extracted(F.col("content"), F.col("ext"), office.EXTRACTORS).alias("text")).collect()}
    assert got == {1: "a\nb", 2: None, 4: None, 6: None, 7: "", 8: None, 9: None}
    for read, raw in ((office.docx, bomb), (office.pdf, thick)):
        try:
            read(raw)
            raise AssertionError("read")
        except ValueError as e:
            assert "too large" in str(e)
