"""Document metadata and annotations as carriers of text.

``fields``: doc_id, field, value.  ``xmp``: doc_id, xml.  ``annotations``: doc_id, page, annot_ord,
annot_type, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..plans.model import FINDINGS, STAGES, finding

#: A value of fewer characters is ordinary metadata.
LONG = 60
# The fields, in order.
FIELDS = ("title", "subject", "keywords", "author", "creator", "producer")


def field_findings(fields: DataFrame) -> DataFrame:
    """Long fields: ``doc_id, part, pos, text, f``."""
    place = F.array_position(F.array(*map(F.lit, FIELDS)), F.col("field")).cast("long")
    long = fields.where(F.col("field").isin(*FIELDS)).withColumn("text", strip(F.coalesce("value", F.lit(""))))
    long = long.where(F.char_length("text") >= LONG).withColumn("pos", place)
    f = finding(
        F.concat(F.lit("pdf_metadata."), "field"),
        "metadata",
        "medium",
        F.concat(F.lit("Long text in the metadata field "), "field"),
        F.col("text"),
        (STAGES["metadata"], 1, 0, 0, F.col("pos")),
        field=F.col("field"),
    )
    return long.select("doc_id", F.lit(0).alias("part"), "pos", "text", f.alias("f"))


def xmp_texts(xmp: DataFrame) -> DataFrame:
    """Long XMP counts as text, raw and without a finding."""
    return xmp.where(F.char_length("xml") >= LONG).select(
        "doc_id", F.lit(1).alias("part"), F.lit(0).cast("long").alias("pos"), F.col("xml").alias("text"), F.lit(None).alias("f")
    )


def annotation_findings(annotations: DataFrame) -> DataFrame:
    """Every annotation with content is text; a long one is a finding too."""
    held = annotations.withColumn("text", strip(F.coalesce("content", F.lit("")))).where("text <> ''")
    place = F.col("page").cast("long") * 1_000_000 + F.col("annot_ord")
    f = finding(
        "pdf_metadata.annotation",
        "metadata",
        "medium",
        "Long text in an annotation.",
        F.col("text"),
        (STAGES["metadata"], 1, 1, F.col("page"), F.col("annot_ord")),
        page=F.col("page"),
        annot_type=F.col("annot_type"),
    )
    return held.select("doc_id", F.lit(2).alias("part"), place.alias("pos"), "text", F.when(F.char_length("text") >= LONG, f).alias("f"))


def metadata_layer(*parts: DataFrame) -> DataFrame:
    """``doc_id, metadata_text, metadata_findings`` from the parts above."""
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    lists = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "pos", "text", "f")), _by_place).alias("m"))
    found = F.filter(F.transform("m", lambda x: x["f"]), lambda f: f.isNotNull()).cast(FINDINGS)
    return lists.select(
        "doc_id", F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("metadata_text"), found.alias("metadata_findings")
    )


def _by_place(a: Column, b: Column) -> Column:
    x, y = F.struct(a["part"], a["pos"]), F.struct(b["part"], b["pos"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
