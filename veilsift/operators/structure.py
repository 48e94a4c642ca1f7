"""Which spans of a page a person can see.

``spans``: doc_id, page, span_ord, text, x0, y0, x1, y1, size, color, alpha, font.
``pages``: doc_id, page, px0, py0, px1, py1.  ``fills``: doc_id, page, paint_ord, x0, y0, x1, y1, r, g, b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, strip
from ..plans.model import FINDINGS, STAGES, ScreenConfig, finding

INVISIBLE_ALPHA = 25
# Severity of each reason, in the order in which reasons are asked.
REASONS = {"invisible_render": "critical", "tiny_font": "high", "offpage": "high", "low_contrast": "critical"}


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of sRGB channels between 0 and 1."""

    def linear(c: Column) -> Column:
        return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(r) + 0.7152 * linear(g) + 0.0722 * linear(b)


def packed_luminance(color: Column) -> Column:
    """Luminance of a packed 0xRRGGBB colour."""
    r, g, b = (F.shiftright(color, n).bitwiseAND(255) / 255.0 for n in (16, 8, 0))
    return luminance(r, g, b)


def with_background(spans: DataFrame, fills: DataFrame) -> DataFrame:
    """``spans`` with the luminance behind each: the last painted fill that holds it, else white.

    The spans and the fills of a page meet as two arrays in one row, so that neither is copied.
    """
    painted = F.struct("paint_ord", "x0", "y0", "x1", "y1", luminance(F.col("r"), F.col("g"), F.col("b")).alias("lum"))
    by_page = fills.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(painted)).alias("_fills"))
    own = [c for c in spans.columns if c not in ("doc_id", "page")]
    pages = spans.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*own)).alias("_spans")).join(by_page, ["doc_id", "page"], "left")

    def behind(s: Column) -> Column:
        holds = F.filter(
            "_fills",
            lambda f: (s["x0"] >= f["x0"] - 1) & (s["y0"] >= f["y0"] - 1) & (s["x1"] <= f["x1"] + 1) & (s["y1"] <= f["y1"] + 1),
        )
        return F.coalesce(F.try_element_at(holds, F.lit(-1))["lum"], F.lit(1.0))

    lit = F.transform("_spans", lambda s: F.struct(*(s[c].alias(c) for c in own), behind(s).alias("background")))
    return pages.select("doc_id", "page", F.explode_outer(lit).alias("_s")).select("doc_id", "page", "_s.*")


def classified(spans: DataFrame, pages: DataFrame, fills: DataFrame, config: ScreenConfig) -> DataFrame:
    """Non-blank spans with ``reason``: why a span is hidden, null if it is visible."""
    shown = with_background(spans.where(~is_blank(F.col("text"))), fills).join(pages, ["doc_id", "page"])
    off = (F.col("x1") < F.col("px0")) | (F.col("x0") > F.col("px1")) | (F.col("y1") < F.col("py0")) | (F.col("y0") > F.col("py1"))
    gap = F.abs(packed_luminance(F.col("color")) - F.col("background"))
    reason = (
        F.when(F.col("alpha") <= INVISIBLE_ALPHA, "invisible_render")
        .when(F.col("size") < config.tiny_font_pt, "tiny_font")
        .when(off, "offpage")
        .when(gap < config.min_luminance_gap, "low_contrast")
    )
    return shown.withColumn("reason", reason)


def structure_layer(spans: DataFrame, pages: DataFrame, fills: DataFrame, config: ScreenConfig) -> DataFrame:
    """``doc_id, visible_text, hidden_text, structure_findings``, a row per document with a span."""
    spotted = classified(spans, pages, fills, config)
    severity = F.create_map(*(F.lit(x) for pair in REASONS.items() for x in pair))[F.col("reason")]
    said = finding(
        F.concat(F.lit("pdf_structure."), "reason"),
        "hidden_text",
        severity,
        F.concat(F.lit("Text hidden from a person: "), "reason"),
        strip(F.col("text")),
        (STAGES["structure"], 0, 0, F.col("page"), F.col("span_ord")),
        page=F.col("page"),
        bbox=F.array("x0", "y0", "x1", "y1"),
        font_size=F.round("size", 2),
        alpha=F.col("alpha"),
        font=F.col("font"),
    )
    row = F.struct("page", "span_ord", "text", "reason", F.when(F.col("reason").isNotNull(), said).alias("f"))
    lists = spotted.groupBy("doc_id").agg(F.array_sort(F.collect_list(row), _by_place).alias("s"))

    def texts(hidden: bool) -> Column:
        part = F.filter("s", lambda x: x["reason"].isNotNull() if hidden else x["reason"].isNull())
        return F.array_join(F.transform(part, lambda x: x["text"]), " ")

    found = F.filter(F.transform("s", lambda x: x["f"]), lambda f: f.isNotNull()).cast(FINDINGS)
    return lists.select("doc_id", texts(False).alias("visible_text"), texts(True).alias("hidden_text"), found.alias("structure_findings"))


def _by_place(a: Column, b: Column) -> Column:
    x, y = F.struct(a["page"], a["span_ord"]), F.struct(b["page"], b["span_ord"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
