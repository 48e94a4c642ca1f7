"""Quality rules as a short-circuit cascade, in built-in functions only.

Every rule is a boolean column.  A sample by hash over the whole table gives each rule's rejection rate
and its cost, that of the measures it reads included; rules are then asked in the order of
rejections per cost, and a ``CASE`` stops at the first that rejects.  The one costly measure, the
repeated words, is taken only of texts that no rule before it rejects.  Costs are counted work, not
seconds, so the same table always gives the same order; the order changes the work, never the verdict.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: Expected rows of the sample that costs and rejection rates are taken from.
SAMPLE_ROWS = 1000
#: Steps of the sample's hash; a table of more rows than this times ``SAMPLE_ROWS`` gives a larger sample.
HASH_STEPS = 1 << 40


@dataclass(frozen=True)
class Rule:
    """``rejects`` is SQL over the measures and over ``text`` and ``words``; ``work`` counts its steps.

    A step is a character read or written, or an element of a list moved.
    """

    name: str
    rejects: str
    work: str


#: Conservative limits: each describes junk that no prose comes near.
RULES = (
    Rule("symbols", "4 * n_symbols > n_words", "length(text)"),
    Rule("duplicate_lines", "100 * n_dup_lines > 30 * n_lines and n_dup_lines >= 3", "2 * length(text) + 4 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 15 * n_words", "1"),
    Rule("shouting", "5 * regexp_count(text, '!') > n_words", "length(text)"),
    Rule("bars", "5 * (size(split(text, '[|]', -1)) - 1) > n_words", "2 * length(text)"),
    Rule("letterless_words", "10 * size(filter(words, w -> w rlike r'\\p{L}')) < 6 * n_words", "4 * n_words"),
)

#: Fixed by the contract; they take part in the order as all others do.
BASE_RULES = (
    Rule("few_words", "n_words < 50", "1"),
    Rule("repeats", "100 * n_repeat_words > 50 * n_words", "n_words * (8 + 2 * log2(n_words + 1))"),
)
BASE_FAILED = " or ".join(r.rejects for r in BASE_RULES)
COSTLY = "n_repeat_words"

# Hashes of the 3-word windows, in order; none where they are not asked for.
_WINDOWS = """case when not ({asked}) or size(words) < 3 then array() else transform(array(words), w ->
    transform(sequence(0, size(w) - 3), i -> xxhash64(get(w, i), get(w, i + 1), get(w, i + 2))))[0] end"""

# Windows sorted by (hash, place): equal neighbours are repeats.  Their places, sorted
# again, are folded into the number of words that they cover.
_COVERED = """case when size(array_distinct(windows)) = size(windows) then 0L else
    transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))), s ->
        aggregate(
            sort_array(transform(filter(s, (x, k) -> x.h <=> get(s, k - 1).h or x.h <=> get(s, k + 1).h), x -> x.i)),
            struct(0L as total, 0 as until),
            (a, p) -> struct(a.total + p + 3 - greatest(p, a.until) as total, p + 3 as until)).total)[0] end"""


def measures(docs: DataFrame) -> DataFrame:
    """``doc_id, text, words`` and the measures that rules read; null text is empty.

    Linear in a text's length but for two sorts of its windows, so very long texts
    need no limit.
    """
    return _with_repeats(_light_measures(docs))


def _light_measures(docs: DataFrame) -> DataFrame:
    """All measures but the repeated words."""
    parts = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text")
    ).select("doc_id", "text", F.split("text", SPACES, -1).alias("parts"), F.split("text", "\n", -1).alias("all_lines"))
    words = parts.select(
        "doc_id",
        "text",
        F.array_remove("parts", "").alias("words"),
        (F.length("text") - F.size("parts") + 1).cast("long").alias("word_chars"),
        F.filter("all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return words.select(
        "doc_id",
        "text",
        "words",
        "word_chars",
        F.size("words").cast("long").alias("n_words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )


def _with_repeats(light: DataFrame, asked: str = "true") -> DataFrame:
    """``light`` and the repeated words, 0 where the condition ``asked`` does not hold."""
    windows = light.select("*", F.expr(_WINDOWS.format(asked=asked)).alias("windows"))
    return windows.select("*", F.expr(_COVERED).cast("long").alias(COSTLY)).drop("windows")


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, chosen by a hash of the id over the whole table; all of a small table."""
    total = max(1, docs.count())
    limit = min(HASH_STEPS, -(-HASH_STEPS * rows // total))
    return docs.where(F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(HASH_STEPS)) < limit)


def estimate(docs: DataFrame, rules: Sequence[Rule] = RULES, rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """``(rule, rejection rate, work per text)`` over a sample of about ``rows`` whole texts.

    The sample stays distributed; what reaches the driver is two numbers per rule.
    """
    hits = (F.coalesce(F.avg(F.expr(r.rejects).cast("double")), F.lit(0.0)).alias(f"hits_{r.name}") for r in rules)
    work = (F.coalesce(F.avg(F.expr(r.work).cast("double")), F.lit(0.0)).alias(f"work_{r.name}") for r in rules)
    known = measures(sampled(docs, rows)).agg(*hits, *work).first()
    return [(r, known[f"hits_{r.name}"], known[f"work_{r.name}"]) for r in rules]


def ordered(estimates: Sequence[tuple[Rule, float, float]]) -> list[Rule]:
    """Most rejections per work first; of equal ones the cheaper, then by name."""
    return [r for r, rate, cost in sorted(estimates, key=lambda e: (-e[1] / max(e[2], 1.0), e[2], e[0].name))]


def cascade(rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(F.expr(rule.rejects), F.lit(rule.name)).otherwise(out)
    return out


def quality(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: measures, ``base_failed`` and ``kept``.

    Null or empty text: zero measures, ``base_failed``.  Null and repeated ids: a row
    each, judged on its own text.  Other columns of ``docs`` are not read.
    """
    measured = measures(docs)
    order = ordered(estimate(docs, rules, sample_rows))
    failed = F.expr(BASE_FAILED)
    return measured.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        F.when(failed, F.lit(False)).otherwise(cascade(order).isNull()).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the rows that the rules reject, all columns as they were.

    Null, empty and short texts are rejected; null and repeated ids are judged row by row.
    """
    whole = docs.select(F.struct(*docs.columns).alias("doc_id"), "text")
    order = ordered(estimate(docs, BASE_RULES + tuple(rules), sample_rows))
    costly = next((i for i, r in enumerate(order) if COSTLY in r.rejects), len(order))
    light = _light_measures(whole).select("*", cascade(order[:costly]).alias("rejected_by"))
    kept = F.col("rejected_by").isNull() & cascade(order[costly:]).isNull()
    # A filter would be pushed below the measures and evaluate each of them anew for every rule;
    # nothing moves through an outer generator.
    measured = _with_repeats(light, "rejected_by is null")
    rows = measured.select(F.explode_outer(F.when(kept, F.array("doc_id"))).alias("row"))
    return rows.where("row is not null").select("row.*")
