"""Office files of each format, one written for each document and read back."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import office
from lectern.operators import documents
from lectern.plans import query
from lectern.sources.readers import table
from lectern.sources.shared import new_path, staged


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in parts.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + xml)
    return out.getvalue()


def _pdf(lines: list[str]) -> bytes:
    """A font of two-byte codes with a map to Unicode, forty lines a page, everything packed."""
    letters = sorted(set("".join(lines)))
    code = {c: k + 1 for k, c in enumerate(letters)}
    hexed = lambda s: s.encode("utf-16-be").hex()
    chars = [f"<{code[c]:04x}> <{hexed(c)}>" for c in letters]
    cmap = "\n".join(f"{len(chars[k : k + 100])} beginbfchar\n" + "\n".join(chars[k : k + 100]) + "\nendbfchar" for k in range(0, len(chars), 100))
    pages = [lines[k : k + 40] for k in range(0, len(lines), 40)]
    stream = lambda s: f"<< /Filter /FlateDecode >>\nstream\n".encode() + zlib.compress(s.encode()) + b"\nendstream"  # noqa: E731, F541
    show = lambda x: "<" + "".join(f"{code[c]:04x}" for c in x) + "> Tj"
    body = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type0 /ToUnicode 4 0 R >>", 4: stream(cmap)}
    for k, page in enumerate(pages):
        body[5 + 2 * k] = f"<< /Type /Page /Parent 2 0 R /Contents {6 + 2 * k} 0 R >>".encode()
        body[6 + 2 * k] = stream("BT /F1 12 Tf 40 800 Td " + " 0 -14 Td ".join(map(show, page)) + " ET")
    kids = " ".join(f"{5 + 2 * k} 0 R" for k in range(len(pages)))
    body[2] = f"<< /Type /Pages /Count {len(pages)} /Resources << /Font << /F1 3 0 R >> >> /Kids [{kids}] >>".encode()
    return b"%PDF-1.5\n" + b"".join(f"{n} 0 obj\n".encode() + b + b"\nendobj\n" for n, b in sorted(body.items())) + b"trailer << /Root 1 0 R >>"


def written(text: str, kind: str) -> bytes:
    """A small file of a kind whose lines are the text's."""
    lines = text.split("\n")
    if kind == "pdf":
        return _pdf(lines)
    runs = lambda ns, t="t": [f'<{ns}:p xml:space="preserve"><{ns}:r><{ns}:{t}>{escape(x)}</{ns}:{t}></{ns}:r></{ns}:p>' for x in lines]
    if kind == "docx":
        return _zipped({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{"".join(runs("w"))}</w:body></w:document>'})
    if kind == "hwpx":
        rows = runs("hp")
        return _zipped({f"Contents/section{k // 50}.xml": f'<hs:sec xmlns:hs="s" xmlns:hp="p">{"".join(rows[k : k + 50])}</hs:sec>' for k in range(0, len(rows), 50)})
    if kind == "pptx":
        rows = runs("a")
        return _zipped({f"ppt/slides/slide{k // 5 + 1}.xml": f'<p:sld xmlns:p="p" xmlns:a="a">{"".join(rows[k : k + 5])}</p:sld>' for k in range(0, len(rows), 5)})
    strings = "".join(f'<si><t xml:space="preserve">{escape(x)}</t></si>' for x in lines[::2])
    cells = [f'<c r="A{k + 1}" t="s"><v>{k // 2}</v></c>' if k % 2 == 0 else f'<c r="A{k + 1}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for k, x in enumerate(lines)]
    return _zipped({"xl/sharedStrings.xml": f"<sst>{strings}</sst>", "xl/worksheets/sheet1.xml": "<worksheet><sheetData>" + "".join(f"<row>{c}</row>" for c in cells) + "</sheetData></worksheet>"})


_KINDS = ("docx", "pptx", "xlsx", "hwpx", "pdf")
_NORMAL = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x09\x0b-\x1f]', '', 'g'), '\n+', chr(10), 'g'), chr(10))"


@query(f"SELECT doc_id, CASE doc_id % 5 {' '.join(f'WHEN {k} THEN {chr(39)}{x}{chr(39)}' for k, x in enumerate(_KINDS))} END AS kind, md5({_NORMAL}) AS text, length({_NORMAL})::BIGINT AS chars FROM documents")
def office_files(spark, d) -> DataFrame:
    """A file for each document, of five formats by turns, written to the shared folder and read from there."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("doc_id") % 5 + 1).cast("int"))
    plain = F.btrim(F.regexp_replace(F.regexp_replace("text", r"[\x00-\x09\x0b-\x1f]", ""), "\n+", "\n"), F.lit("\n"))
    made = F.pandas_udf(lambda t, k: pd.Series([written(x, y) for x, y in zip(t, k, strict=True)]), "binary")
    path = new_path(spark, "office")
    table(spark, d, "documents").select("doc_id", kind.alias("ext"), made(plain, kind).alias("content")).write.parquet(path)
    files = spark.read.parquet(path).withColumn("text", documents.extracted(F.col("content"), F.col("ext"), office.EXTRACTORS))
    out = staged(files.select("doc_id", F.col("ext").alias("kind"), "text"), "texts")
    return out.select("doc_id", "kind", F.md5("text").alias("text"), F.length("text").cast("long").alias("chars"))
