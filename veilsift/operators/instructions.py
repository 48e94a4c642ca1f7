"""Instructions addressed to an automated reader."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.matching import rule_spans, sql_text
from ..functions.text import around
from ..plans.model import FINDINGS, PHRASE_RULES, STAGES, Rule, finding


def pattern_findings(
    text: str,
    source: str,
    stream: int,
    rules: Sequence[Rule] = PHRASE_RULES,
    detector: str = "injection_patterns",
    category: str = "semantic_injection",
    stage: str = "instruction",
    reg: int = 5,
) -> Column:
    """Findings of ordered rules in the column ``text``, one stream; overlaps go to the earlier rule."""
    spans = rule_spans(text, [r.pattern for r in rules])
    severities = F.expr(f"array({', '.join(sql_text(r.severity) for r in rules)})")
    messages = F.expr(f"array({', '.join(sql_text(r.message) for r in rules)})")
    return F.transform(
        spans,
        lambda x: finding(
            detector,
            category,
            F.element_at(severities, x["rule"] + 1),
            F.element_at(messages, x["rule"] + 1),
            around(F.col(text), x["start"], x["end"]),
            (STAGES[stage], reg, stream, x["rule"], x["start"]),
            matched=x["matched"],
            source=F.lit(source),
        ),
    ).cast(FINDINGS)
