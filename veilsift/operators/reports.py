"""Reports over results, decisions on documents, and their places on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.model import SEVERITIES

MAX_UPLOAD = 15 << 20
MAX_RISK = 60
_RANK = {s: i for i, s in enumerate(reversed(SEVERITIES))}


def severity_rank(severity: Column) -> Column:
    """0 for the heaviest."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in _RANK.items() for x in pair)), severity)


def by_category(findings: DataFrame) -> DataFrame:
    """Groups by category, the worst first, then the largest: ``category, n, worst, place``."""
    groups = findings.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min(severity_rank(F.col("severity"))).alias("worst"))
    order = Window.orderBy("worst", F.desc("n"), "category")  # one row per category
    return groups.withColumn("place", F.row_number().over(order))


def detector_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("detector", "severity").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents"))


def verdict_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("verdict").agg(
        F.count(F.lit(1)).alias("n"), F.min("risk_score").alias("least"), F.max("risk_score").alias("most")
    )


def counts(results: DataFrame) -> DataFrame:
    """Concealing and instructing findings per document."""
    instructing = F.size(F.filter("findings", lambda f: f["category"] == "semantic_injection"))
    return results.select(
        "doc_id", (F.size("findings") - instructing).alias("concealed"), instructing.alias("instructing"), F.size("findings").alias("removed_count")
    )


def locatable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("bbox").isNotNull() & F.col("page").isNotNull())


def on_page(bbox: Column, width: Column, height: Column) -> Column:
    """Whether a box can be drawn: not left of or above the page, at most 2 points beyond it."""
    return (bbox[0] >= 0) & (bbox[1] >= 0) & (bbox[2] <= width + 2) & (bbox[3] <= height + 2)


def percent_box(bbox: Column, width: Column, height: Column) -> Column:
    return F.struct(
        (bbox[0] / width * 100).alias("left"),
        (bbox[1] / height * 100).alias("top"),
        ((bbox[2] - bbox[0]) / width * 100).alias("width"),
        ((bbox[3] - bbox[1]) / height * 100).alias("height"),
    )


def withheld_chars(visible: Column, hidden: Column, safe: Column) -> Column:
    return F.char_length(visible) + F.char_length(hidden) - F.char_length(safe)


def upload_reason(filename: Column, content: Column, most: int | None = MAX_UPLOAD) -> Column:
    """Why an upload is refused, null if it is not."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    reason = F.when(~F.coalesce(F.lower(filename).endswith(".pdf"), F.lit(False)), "not_pdf").when(size == 0, "empty")
    return reason if most is None else reason.when(size > most, "too_large")


def rejected(verdict: Column, score: Column, auto_reject: bool = True, max_risk: int = MAX_RISK, allow_suspicious: bool = True) -> Column:
    bad = (verdict == "malicious") | (score >= max_risk)
    if not allow_suspicious:
        bad = bad | (verdict == "suspicious")
    return bad if auto_reject else F.lit(False)


def rejection(verdict: Column, score: Column, findings: Column, refused: Column) -> Column:
    """What a refused sender is told, null for others: ``struct<error, verdict, risk_score, findings_count>``."""
    said = F.struct(
        F.lit("Refused: the document hides text or instructs its reader.").alias("error"),
        verdict.alias("verdict"),
        score.alias("risk_score"),
        F.size(findings).alias("findings_count"),
    )
    return F.when(refused, said)


class RejectedDocument(ValueError):
    """A malicious document among those to load; ``doc_ids`` names a few, ``results`` holds the results of all of them."""

    def __init__(self, doc_ids: list, results: DataFrame | None = None):
        super().__init__(f"malicious documents: {doc_ids}")
        self.doc_ids, self.results = doc_ids, results


def loaded(results: DataFrame, reject: bool = True, strict: bool = False) -> DataFrame:
    """``doc_id, page_content, metadata`` for a downstream reader.

    ``reject`` leaves malicious documents out; ``strict`` raises for them instead.  The metadata names
    verdict, score and number of findings, and source, file name and pages where the results know them.
    """
    if strict:
        bad = results.where("verdict = 'malicious'")
        if ids := [r["doc_id"] for r in bad.select("doc_id").take(5)]:
            raise RejectedDocument(ids, bad)
    about = [c for c in ("source", "filename", "pages") if c in results.columns]
    row = F.struct("doc_id", "verdict", "risk_score", F.size("findings").alias("findings_count"), "sanitized_text", *about)
    kept = F.col("verdict") != "malicious" if reject else F.lit(True)
    # Plain filters would be pushed into the plan below and evaluate the verdict's inputs anew.
    rows = results.select(F.explode_outer(F.array(F.when(kept, row))).alias("r")).where("r is not null").select("r.*")
    named = ("doc_id", "verdict", "risk_score", "findings_count", *about)
    metadata = F.map_filter(F.create_map(*(x for k in named for x in (F.lit(k), F.col(k).cast("string")))), lambda k, v: v.isNotNull())
    return rows.select("doc_id", F.col("sanitized_text").alias("page_content"), metadata.alias("metadata"))


def load_all(results: DataFrame, reject: bool = True, strict: bool = False) -> list:
    """The rows of ``loaded`` at once, for results that fit the driver."""
    return loaded(results, reject, strict).collect()


def grouped(findings: Column) -> Column:
    """Findings by category: ``array<struct<category, worst, n, findings>>``, the worst first, then the largest.

    Inside a category the heaviest come first, equal ones in emission order.
    """
    names = F.array_distinct(F.transform(findings, lambda f: f["category"]))

    def one(name: Column) -> Column:
        held = F.filter(findings, lambda f: f["category"] == name)
        ranked = F.array_sort(F.transform(held, lambda f, i: F.struct(severity_rank(f["severity"]).alias("rank"), i.alias("place"), f.alias("f"))), _by_rank)
        return F.struct(F.get(ranked, F.lit(0))["rank"].alias("worst"), F.size(held).alias("n"), name.alias("category"), F.transform(ranked, lambda r: r["f"]).alias("findings"))

    def order(a: Column, b: Column) -> Column:
        x, y = F.struct(a["worst"], -a["n"], a["category"]), F.struct(b["worst"], -b["n"], b["category"])
        return F.when(x < y, -1).when(x > y, 1).otherwise(0)

    return F.array_sort(F.transform(names, one), order)


def _by_rank(a: Column, b: Column) -> Column:
    x, y = F.struct(a["rank"], a["place"]), F.struct(b["rank"], b["place"])
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def evaluated(results: DataFrame, truth: DataFrame) -> DataFrame:
    """Per technique: documents, flagged ones, and whether all are as the truth says."""
    joined = results.join(truth, "doc_id")
    flagged = F.col("verdict") != "clean"
    return joined.groupBy("technique").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(flagged).alias("flagged"),
        F.count_if(flagged == F.col("is_poisoned")).alias("right"),
    )
