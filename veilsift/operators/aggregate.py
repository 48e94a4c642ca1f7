"""From findings to one verdict per document, inside the row: no shuffle, fit for streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import collapse, strip_invisible
from ..plans.model import CONCEALED_NOTE, FINDINGS, REDACTED, SEVERITIES

#: Characters of evidence that tell findings apart.
KEY_CHARS = 160
PER_CATEGORY = 8


def escalated(findings: Column) -> Column:
    """Instructions in concealed streams are critical."""

    def raise_one(f: Column) -> Column:
        hit = (f["category"] == "semantic_injection") & f["detail"]["source"].isin("hidden", "metadata") & (f["severity"] != "critical")
        return (
            f.withField("severity", F.when(hit, "critical").otherwise(f["severity"]))
            .withField("message", F.when(hit, F.concat(f["message"], F.lit(CONCEALED_NOTE))).otherwise(f["message"]))
        )

    return F.transform(findings, raise_one)


def dedupe_key(f: Column) -> Column:
    return F.struct(f["detector"], F.substring(collapse(F.lower(f["evidence"])), 1, KEY_CHARS))


def deduped(findings: Column) -> Column:
    """The first finding of each detector and evidence, in emission order."""
    # The keys are bound once; a lambda's free columns would be evaluated per element.
    pairs = F.transform(findings, lambda f: F.struct(f.alias("f"), dedupe_key(f).alias("k")))
    kept = F.aggregate(
        pairs,
        F.struct(F.array().cast(FINDINGS).alias("fs"), F.array().cast("array<struct<a:string,b:string>>").alias("ks")),
        lambda acc, p: F.when(F.array_contains(acc["ks"], p["k"].cast("struct<a:string,b:string>")), acc).otherwise(
            F.struct(
                F.concat(acc["fs"], F.array(p["f"])).alias("fs"),
                F.concat(acc["ks"], F.array(p["k"].cast("struct<a:string,b:string>"))).alias("ks"),
            )
        ),
        lambda acc: acc["fs"],
    )
    return kept


def in_order(*parts: Column) -> Column:
    """All findings in emission order."""
    return F.array_sort(F.concat(*parts), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0))


def risk_score(findings: Column) -> Column:
    """Heaviest severity, and a supplement for each further category."""
    weights = F.create_map(*(F.lit(x) for pair in SEVERITIES.items() for x in pair))
    worst = F.array_max(F.transform(findings, lambda f: F.element_at(weights, f["severity"])))
    categories = F.size(F.array_distinct(F.transform(findings, lambda f: f["category"])))
    return F.when(F.size(findings) == 0, 0).otherwise(F.least(F.lit(100), worst + PER_CATEGORY * (categories - 1)))


def decided(findings: Column, malicious: int = 60, suspicious: int = 15) -> Column:
    """``struct<verdict, risk_score>``."""
    score = risk_score(findings)
    concealed = F.exists(findings, lambda f: f["category"] != "semantic_injection")
    instructing = F.exists(findings, lambda f: f["category"] == "semantic_injection")
    critical = F.exists(findings, lambda f: f["severity"] == "critical")
    bad = critical | (concealed & instructing) | (score >= malicious)
    doubtful = (score >= suspicious) | concealed | instructing
    verdict = F.when(bad, "malicious").when(doubtful, "suspicious").otherwise("clean")
    final = F.when(bad, F.greatest(score, F.lit(malicious))).when(doubtful, F.greatest(score, F.lit(suspicious))).otherwise(score)
    return F.struct(verdict.alias("verdict"), final.alias("risk_score"))


def sanitized(visible: Column, findings: Column) -> Column:
    """Visible text without invisible characters, matched instructions redacted."""
    hits = F.filter(findings, lambda f: (f["category"] == "semantic_injection") & (f["detail"]["matched"] != ""))
    matched = F.transform(hits, lambda f: f["detail"]["matched"])
    return collapse(F.aggregate(matched, strip_invisible(visible), lambda acc, m: F.replace(acc, m, F.lit(REDACTED))))
