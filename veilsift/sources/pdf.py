"""PDF files as relations.

A file is read once: one row per file, with nested spans, fills, fields and so on, is written as
Parquet, and every relation is a column of that table.  A file that can't be read has its ``error``
and nothing else; no file fails the query.

The first two texts under ``extractions`` are modes of this one reader (``page``: what reaches into the page;
``unclipped``: everything).  Independent extractors follow: those of known libraries, where they are
installed, and functions that the caller gives.  One that fails has no text and an ``error``; the others stay.
"""

from __future__ import annotations

import importlib.util
import io
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.runtime import durable, ship_package
from ..operators.metadata import FIELDS
from ..plans.screen import Relations, Screen
from .pdf_objects import PdfError, PdfFile, Stream, text_string
from .pdf_page import Painter, page_content, pages_of, view

PAGE = "page:int,px0:double,py0:double,px1:double,py1:double"
SPAN = "page:int,span_ord:int,text:string,x0:double,y0:double,x1:double,y1:double,size:double,color:int,alpha:int,font:string"
FILL = "page:int,paint_ord:int,x0:double,y0:double,x1:double,y1:double,r:double,g:double,b:double"
PARSED = (
    f"doc_id long, error string, pages array<struct<{PAGE}>>, spans array<struct<{SPAN}>>, fills array<struct<{FILL}>>,"
    " fields array<struct<field:string,value:string>>, xmp string,"
    " annotations array<struct<page:int,annot_ord:int,annot_type:string,content:string>>,"
    " extractions array<struct<extractor:string,extractor_ord:int,text:string,error:string>>"
)
#: The text of a file, by any means.
Extractor = Callable[[bytes], str]
#: Files read before their rows are handed on.
FILES_AT_ONCE = 8
#: Annotations that are no notes: they show fields, links, or the window of another annotation.
_NO_NOTES = ("Popup", "Link", "Widget")


def _pypdf(content: bytes) -> str:
    import pypdf

    return "\n".join(page.extract_text() or "" for page in pypdf.PdfReader(io.BytesIO(content)).pages)


def _pdfminer(content: bytes) -> str:
    from pdfminer.high_level import extract_text

    return extract_text(io.BytesIO(content)) or ""


def installed_extractors() -> dict[str, Extractor]:
    """Extractors of libraries that are installed where this runs."""
    return {name: f for name, f in (("pypdf", _pypdf), ("pdfminer", _pdfminer)) if importlib.util.find_spec(name)}


def extracted(content: bytes, extractors: Mapping[str, Extractor], first: int) -> list[dict[str, Any]]:
    """A row of ``extractions`` for each extractor, numbered from ``first`` on."""
    out = []
    for place, (name, extract) in enumerate(extractors.items(), first):
        text, error = "", None
        try:
            text = _clean(extract(content))
        except Exception as problem:  # one extractor's failure is a row, not the end
            error = f"{type(problem).__name__}: {problem}"
        out.append({"extractor": name, "extractor_ord": place, "text": text, "error": error})
    return out


def parsed(content: bytes | None, extractors: Mapping[str, Extractor] | None = None) -> dict[str, Any]:
    """The row of one file, without its id."""
    empty: dict[str, Any] = {k: [] for k in ("pages", "spans", "fills", "fields", "annotations", "extractions")}
    try:
        row = {"error": None, **empty, **_read(content or b"")}
        row["extractions"] += extracted(content or b"", installed_extractors() | dict(extractors or {}), len(row["extractions"]))
        return row
    except PdfError as problem:
        return {"error": str(problem), "xmp": None, **empty}
    except Exception as problem:  # whatever a hostile file provokes is a property of the file
        return {"error": f"{type(problem).__name__}: {problem}", "xmp": None, **empty}


def _read(content: bytes) -> dict[str, Any]:
    file = PdfFile(content)
    fonts: dict = {}
    steps = [0]
    pages, spans, fills, notes, clipped, whole = [], [], [], [], [], []
    for number, page in enumerate(pages_of(file)):
        width, height, ctm = view(file, page)
        painter = Painter(file, fonts, steps)
        painter.page(page_content(file, page), file.dictionary(page.get("Resources")), ctm)
        pages.append({"page": number, "px0": 0.0, "py0": 0.0, "px1": width, "py1": height})
        spans += [{"page": number, "span_ord": i, **s} for i, s in enumerate(painter.spans)]
        fills += [{"page": number, **f} for f in painter.fills]
        inside = [s["text"] for s in painter.spans if s["x1"] >= 0 and s["y1"] >= 0 and s["x0"] <= width and s["y0"] <= height]
        clipped.append("\n".join(inside))
        whole.append("\n".join(s["text"] for s in painter.spans))
        for i, ref in enumerate(file.array(page.get("Annots"))):
            note = file.dictionary(ref)
            kind = str(file.get(note.get("Subtype")) or "")
            if note and kind not in _NO_NOTES:
                notes.append({"page": number, "annot_ord": i, "annot_type": kind, "content": _clean(text_string(file.get(note.get("Contents"))))})
    if not pages:
        raise PdfError("no page in the PDF file")
    about = file.dictionary(file.trailer.get("Info"))
    given = [{"field": f, "value": _clean(text_string(file.get(about.get(f.capitalize()))))} for f in FIELDS]
    xmp = file.get(file.root.get("Metadata"))
    texts = (("page", clipped), ("unclipped", whole))
    return {
        "pages": pages,
        "spans": spans,
        "fills": fills,
        "fields": [f for f in given if f["value"]],
        "xmp": _clean(xmp.data().decode("utf-8", "replace")) if isinstance(xmp, Stream) else None,
        "annotations": notes,
        "extractions": [{"extractor": n, "extractor_ord": i, "text": "\n".join(t), "error": None} for i, (n, t) in enumerate(texts)],
    }


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8")


def parse_files(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """A row of ``PARSED`` for every row of ``files`` (``doc_id, content``).

    Null and empty contents have an error.  Repeated ids give repeated rows, which ``relations`` does
    not expect.  Other columns are not read.
    """
    ship_package(files.sparkSession)
    schema = to_arrow_schema(StructType.fromDDL(PARSED))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES_AT_ONCE):
                part = batch.slice(at, FILES_AT_ONCE)
                rows = [{"doc_id": i.as_py(), **parsed(c.as_py(), extractors)} for i, c in zip(part.column(0), part.column(1))]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("content").cast("binary").alias("content")).mapInArrow(read, PARSED)


def relations(table: DataFrame) -> Relations:
    """The relations in a table of parsed files; each reads its own columns only."""

    def rows(column: str) -> DataFrame:
        return table.select("doc_id", F.inline(column))

    return Relations(
        documents=table.select("doc_id", "error"),
        spans=rows("spans"),
        pages=rows("pages"),
        fills=rows("fills"),
        fields=rows("fields"),
        xmp=table.where("xmp is not null").select("doc_id", F.col("xmp").alias("xml")),
        annotations=rows("annotations"),
        extractions=rows("extractions"),
    )


def pdf_relations(files: DataFrame, extractors: Mapping[str, Extractor] | None = None) -> Relations:
    """Relations of ``files``, which are read once, into a table in the shared folder."""
    return relations(durable(parse_files(files, extractors), "pdf"))


def scan_files(files: DataFrame, screen: Screen | None = None, extractors: Mapping[str, Extractor] | None = None) -> DataFrame:
    """Results of the screening of ``files`` (``doc_id, content``)."""
    return (screen or Screen()).scan(pdf_relations(files, extractors))


def screen_arriving(spark: SparkSession, path: str, out: str, checkpoint: str, screen: Screen | None = None) -> StreamingQuery:
    """Screen the PDF files that arrive under ``path``; a batch's results are ``out/batch=N``.

    A batch that is run again after a failure overwrites its own results.
    """
    arriving = (
        spark.readStream.format("binaryFile")
        .option("pathGlobFilter", "*.pdf")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .load(path)
        .select(F.xxhash64("path").alias("doc_id"), "content")
    )

    def run(batch: DataFrame, number: int) -> None:
        scan_files(batch, screen).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return arriving.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
