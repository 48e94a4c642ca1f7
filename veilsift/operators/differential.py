"""Does what was concealed change how a screener scores a document?

The screener is a function that the caller gives; nothing here calls a network.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import evaluated
from ..functions.text import collapse, is_blank
from ..plans.model import FINDINGS, STAGES, finding

SCREENER_CHARS = 12000
MATERIAL_DELTA = 15
REPLY = "struct<score:int,recommendation:string,reason:string>"


def parsed_reply(reply: Column) -> Column:
    """``struct<score, recommendation, reason>`` of the widest braces of a reply; numbers are cut to whole ones."""
    braces = F.regexp_extract(F.coalesce(reply, F.lit("")), "(?s)\\{.*\\}", 0)
    held = F.from_json(braces, "struct<score:double,recommendation:string,reason:string>")
    number = braces.rlike('(?s)"score"\\s*:\\s*-?[0-9]')
    return F.struct(
        F.when(number, held["score"].cast("int")).alias("score"),
        F.coalesce(held["recommendation"], F.lit("")).alias("recommendation"),
        F.coalesce(held["reason"], F.lit("")).alias("reason"),
    )


def longest_text(extractions: DataFrame) -> DataFrame:
    """``doc_id, raw_text``: the longest text that an extractor gave, the first of equal ones."""
    length = F.char_length(F.coalesce("text", F.lit("")))
    return extractions.groupBy("doc_id").agg(F.max_by(F.coalesce("text", F.lit("")), F.struct(length, -F.col("extractor_ord"))).alias("raw_text"))


def screener_from_env(screeners: Mapping[str, Callable], needs: Mapping[str, str], prefix: str = "VEILSIFT_") -> Callable | None:
    """The screener that ``<prefix>SCREENER`` names, else the first whose variable in ``needs`` is set."""
    named = os.environ.get(f"{prefix}SCREENER")
    if named is not None:
        return screeners.get(named)
    return next((load for name, load in screeners.items() if os.environ.get(needs.get(name, ""))), None)


def _asker(load: Callable[[], Callable[[str], str]]):
    @F.pandas_udf("reply string, problem string")
    def ask(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        screener = load()

        def one(text: str | None) -> tuple[str | None, str | None]:
            try:
                return (None if text is None else screener(text)), None
            except Exception as problem:  # a screener's failure must not end the scan
                return None, str(problem) or type(problem).__name__

        for batch in batches:
            yield pd.DataFrame([one(t) for t in batch], columns=["reply", "problem"], dtype=object)

    return ask


def screened_twice(results: DataFrame, raw_text: Column, load: Callable[[], Callable[[str], str]] | None, material: int = 15) -> DataFrame:
    """``results`` with ``differential``: how a screener scores a document before and after sanitizing.

    ``load()`` gives the screener, once per worker.  Where a comparison is not ``available`` its ``note``
    says why: no screener, too little text, equal texts, a call that failed, a reply without a score.
    """
    rows = evaluated(results, _raw=F.coalesce(raw_text, F.lit("")))
    blank = is_blank(F.col("_raw")) | is_blank(F.col("sanitized_text"))
    same = collapse(F.col("_raw")) == collapse(F.col("sanitized_text"))
    rows = evaluated(rows, _skip=F.when(F.lit(load is None), "No screener is set.").when(blank, "Too little text to screen.").when(same, "Sanitizing changed nothing."))
    if load is None:
        none = F.lit(None).cast("struct<reply:string,problem:string>")
        replies = none, none
    else:
        ask = _asker(load)
        replies = tuple(ask(F.when(F.col("_skip").isNull(), F.substring(c, 1, SCREENER_CHARS))) for c in ("_raw", "sanitized_text"))
    rows = rows.withColumns({"_before": replies[0], "_after": replies[1]})
    problem = F.coalesce("_before.problem", "_after.problem")
    rows = evaluated(rows, _x=parsed_reply(F.col("_before.reply")), _y=parsed_reply(F.col("_after.reply")))
    told = compared(F.col("_x.score"), F.col("_y.score"), F.col("_x.recommendation"), F.col("_y.recommendation"), material)
    scores = F.concat(F.lit("Scored "), F.col("_x.score").cast("string"), F.lit(" as it is and "), F.col("_y.score").cast("string"), F.lit(" sanitized"))
    note = (
        F.when(F.col("_skip").isNotNull(), F.col("_skip"))
        .when(problem.isNotNull(), F.concat(F.lit("The screener failed: "), problem))
        .when(~F.col("_told.available"), F.lit("A reply holds no score."))
        .when(F.col("_told.manipulated"), F.concat(scores, F.lit(": what was concealed changes the outcome.")))
        .otherwise(F.concat(scores, F.lit(": no material change.")))
    )
    rows = evaluated(rows, _told=told)
    outcome = F.struct(
        F.col("_told.available").alias("available"),
        note.alias("note"),
        F.col("_x.score").alias("raw_score"),
        F.col("_y.score").alias("sanitized_score"),
        F.col("_told.delta").alias("delta"),
        F.col("_x.recommendation").alias("raw_recommendation"),
        F.col("_y.recommendation").alias("sanitized_recommendation"),
        F.col("_told.manipulated").alias("manipulated"),
    )
    return evaluated(rows, differential=outcome).select(*results.columns, "differential")


def compared(raw_score: Column, clean_score: Column, raw_rec: Column, clean_rec: Column, material: int = MATERIAL_DELTA) -> Column:
    """``struct<available, delta, manipulated>``; unavailable without both scores."""
    delta = raw_score - clean_score
    other = (raw_rec != "") & (clean_rec != "") & (F.lower(raw_rec) != F.lower(clean_rec))
    both = raw_score.isNotNull() & clean_score.isNotNull()
    return F.struct(
        both.alias("available"),
        F.when(both, delta).alias("delta"),
        F.coalesce(both & ((F.abs(delta) >= material) | other), F.lit(False)).alias("manipulated"),
    )


def applied(results: DataFrame, malicious: int = 60) -> DataFrame:
    """A manipulated document is malicious, its score at least ``malicious``, with a finding that says why."""
    d = F.col("differential")
    f = finding(
        "differential.screening",
        "semantic_injection",
        "critical",
        d["note"],
        F.format_string(
            "as it is %s (%s), sanitized %s (%s)", *(d[c].cast("string") for c in ("raw_score", "raw_recommendation", "sanitized_score", "sanitized_recommendation"))
        ),
        (STAGES["post"], 0, 0, 0, 0),
        **{name: d[name] for name in ("raw_score", "sanitized_score", "delta", "raw_recommendation", "sanitized_recommendation")},
    )
    hit = d["manipulated"]
    return results.withColumns(
        {
            "verdict": F.when(hit, "malicious").otherwise(F.col("verdict")),
            "risk_score": F.when(hit, F.greatest("risk_score", F.lit(malicious))).otherwise(F.col("risk_score")),
            "findings": F.when(hit, F.concat("findings", F.array(f)).cast(FINDINGS)).otherwise(F.col("findings")),
        }
    )


def parse_reply_text(reply: str) -> tuple[int | None, str, str]:
    """The same for one reply in Python, the statement that tests hold the columns against."""
    found = re.search(r"\{.*\}", reply, re.DOTALL)
    try:
        data = json.loads(found.group(0)) if found else {}
    except json.JSONDecodeError:
        data = {}
    score = data.get("score")
    return (int(score) if isinstance(score, (int, float)) else None, str(data.get("recommendation", "")), str(data.get("reason", "")))
