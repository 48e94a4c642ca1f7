"""Text that reads one way and is encoded another."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import BIDI, ZERO_WIDTH, bound, collapse, count_of, first_of, has_non_ascii, holds_any, is_blank, names_of, strip_invisible
from ..plans.model import FINDINGS, STAGES, finding, no_findings

# Alarm levels and the scripts that imitate Latin letters.
ZERO_WIDTH_ALARM = 8
NFKC_ALARM = 12
SCRIPTS = {
    "armenian": "\\u0530-\\u058F",
    "cherokee": "\\u13A0-\\u13FF",
    "cyrillic": "\\u0400-\\u052F",
    "greek": "\\u0370-\\u03FF\\u1F00-\\u1FFF",
    "latin": "\\u0041-\\u024F\\u1E00-\\u1EFF",
}
#: All but Latin, as few ranges.
NOT_LATIN = "\\u0370-\\u058F\\u13A0-\\u13FF\\u1F00-\\u1FFF"
WORD = "[\\p{L}\\p{Nl}\\p{No}]{3,}"


def _window(text: Column, at: Column) -> Column:
    low = F.greatest(at - 40, F.lit(0))
    return F.translate(F.substring(text, low + 1, at + 40 - low), "\n", " ")


def unicode_findings(text: Column, source: str, stream: int) -> Column:
    """Runs of zero-width characters and any direction control."""
    text = F.coalesce(text, F.lit(""))
    out = []
    for rule, (name, chars, least) in enumerate((("zero_width", ZERO_WIDTH, ZERO_WIDTH_ALARM), ("bidi_override", BIDI, 1))):
        n = count_of(text, chars)
        f = finding(
            f"unicode.{name}",
            "unicode_trick",
            "high",
            F.concat(n.cast("string"), F.lit(" invisible control characters in the text.")),
            _window(text, first_of(text, chars)),
            (STAGES["encoding"], 3, stream, rule, 0),
            count=n,
            characters=F.array_join(names_of(text, chars), ","),
            source=F.lit(source),
        )
        out.append(F.when(n >= least, F.array(f)).otherwise(no_findings()))
    # A plain search rules most texts out; none of these characters is ASCII.
    held = has_non_ascii(text) & holds_any(text, ZERO_WIDTH | BIDI)
    return F.when(held, F.concat(*out)).otherwise(no_findings()).cast(FINDINGS)


def script_names(word: Column) -> Column:
    return F.array_compact(F.array(*(F.when(word.rlike(f"[{c}]"), F.lit(n)) for n, c in SCRIPTS.items())))


def mixed_words(text: Column) -> Column:
    """``array<struct<word, scripts>>`` of words of more than one script, in order."""
    # A word can mix scripts only if it leaves ASCII, a text only if it leaves Latin.
    words = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), has_non_ascii)
    named = F.transform(words, lambda w: F.struct(w.alias("word"), script_names(w).alias("scripts")))
    mixed = F.filter(named, lambda x: F.size(x["scripts"]) > 1)
    return F.when(has_non_ascii(text) & text.rlike(f"[{NOT_LATIN}]"), mixed).otherwise(F.array().cast("array<struct<word:string,scripts:array<string>>>"))


def _moved(text: str) -> int:
    if unicodedata.is_normalized("NFKC", text):
        return 0
    normal = unicodedata.normalize("NFKC", text)
    return sum(a != b for a, b in zip(text, normal)) + abs(len(text) - len(normal))


def _deltas(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: 0 if t is None else _moved(t)).astype("int32")


def _normal(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


# The functions are wrapped on the driver only: workers import this module without a session.
def _nfkc(text: Column) -> Column:
    return F.pandas_udf(_normal, "string")(text)


def nfkc_delta(text: Column) -> Column:
    """Characters that NFKC moves; only texts beyond ASCII are sent to Python."""
    return F.pandas_udf(_deltas, "int")(F.when(has_non_ascii(text), text))


def normalize_for_screening(text: Column) -> Column:
    return strip_invisible(F.coalesce(_nfkc(F.when(has_non_ascii(text), text)), text))


def normalization_findings(text: Column, source: str, stream: int) -> Column:
    text = F.coalesce(text, F.lit(""))

    def mixed(words: Column) -> Column:
        sample = F.transform(
            F.slice(words, 1, 5),
            lambda x: F.concat(F.lit("'"), x["word"], F.lit("' ("), F.array_join(x["scripts"], "+"), F.lit(")")),
        )
        f = finding(
            "normalization.mixed_script",
            "unicode_trick",
            "high",
            F.concat(F.size(words).cast("string"), F.lit(" words mix scripts.")),
            F.array_join(sample, ", "),
            (STAGES["encoding"], 4, stream, 0, 0),
            count=F.size(words),
            words=F.array_join(F.transform(F.slice(words, 1, 20), lambda x: x["word"]), ","),
            source=F.lit(source),
        )
        return F.when(F.size(words) > 0, F.array(f)).otherwise(no_findings())

    delta = nfkc_delta(text)
    moved = finding(
        "normalization.nfkc_divergence",
        "unicode_trick",
        "medium",
        F.concat(F.lit("Normalising moves characters: "), delta.cast("string")),
        collapse(F.substring(text, 1, 160)),
        (STAGES["encoding"], 4, stream, 1, 0),
        delta=delta,
        source=F.lit(source),
    )
    # ASCII mixes no scripts and is always normal.
    found = F.concat(
        F.when(has_non_ascii(text), bound(mixed_words(text), mixed)).otherwise(no_findings()),
        F.when(delta >= NFKC_ALARM, F.array(moved)).otherwise(no_findings()),
    )
    return F.when(is_blank(text), no_findings()).otherwise(found.cast(FINDINGS))
