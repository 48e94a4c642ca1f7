"""Where extractors of one document disagree.

``extractions``: doc_id, extractor, extractor_ord, text, error.  The texts of a document meet in one
row; its shingles are compared there, by hashed array functions that are linear in its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import evaluated
from ..functions.text import bound
from ..plans.model import FINDINGS, STAGES, finding

#: Words of reconstructed evidence.
EVIDENCE_WORDS = 120


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(words: Column, width: int) -> Column:
    """Distinct runs of ``width`` words, joined by spaces; none if there are fewer words.

    Words hold no character below the letters and digits, so joined runs sort as lists would.
    """

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - width + 1, F.lit(1)))
        found = F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, width), " ")))
        return F.when(F.size(w) >= width, found).otherwise(F.array().cast("array<string>"))

    return bound(words, runs)


def exploded(extractions: DataFrame, width: int) -> DataFrame:
    """``doc_id, extractor, extractor_ord, shingle``."""
    words = extractions.select("doc_id", "extractor", "extractor_ord", tokens(F.col("text")).alias("w"))
    return words.select("doc_id", "extractor", "extractor_ord", F.explode(shingles(F.col("w"), width)).alias("shingle"))


def by_document(extractions: DataFrame, width: int) -> DataFrame:
    """``doc_id, es, common`` of documents with two populated extractors or more.

    ``es``: the populated extractors in order, with their shingles; ``common``: the shingles that all of
    them gave.  Only texts are shuffled, once; shingles are made and compared inside the row.
    """
    entry = F.struct("extractor_ord", "extractor", F.col("text").alias("text"))
    rows = extractions.groupBy("doc_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    shingled = F.transform(
        "all", lambda e: F.struct(e["extractor_ord"].alias("extractor_ord"), e["extractor"].alias("extractor"), shingles(tokens(e["text"]), width).alias("s"))
    )
    rows = evaluated(rows, es=F.filter(shingled, lambda e: F.size(e["s"]) > 0))
    common = F.aggregate(F.transform("es", lambda e: e["s"]), F.get("es", F.lit(0))["s"], F.array_intersect)
    rows = evaluated(rows.select("doc_id", "es"), common=F.when(F.size("es") >= 2, common))
    return rows.where("common is not null")


def divergent(extractions: DataFrame, width: int) -> DataFrame:
    """``doc_id, divergent``: the shingles that some but not all populated extractors gave."""
    everything = F.array_distinct(F.flatten(F.transform("es", lambda e: e["s"])))
    rows = evaluated(by_document(extractions, width), divergent=F.array_except(everything, "common"))
    return rows.select("doc_id", "divergent").where(F.size("divergent") > 0)


def reconstruct(sorted_shingles: Column, width: int) -> Column:
    """A readable text from sorted shingles: each adds its last word if that is new nearby."""

    def add(acc: Column, shingle: Column) -> Column:
        last = F.substring_index(shingle, " ", -1)
        full = F.size(acc) >= EVIDENCE_WORDS
        return F.when(full | F.array_contains(F.slice(acc, -width, width), last), acc).otherwise(F.concat(acc, F.array(last)))

    first = F.split(F.element_at(sorted_shingles, 1), " ")
    return F.slice(F.aggregate(F.slice(sorted_shingles, F.lit(2), F.size(sorted_shingles)), first, add), 1, EVIDENCE_WORDS)


def divergence_layer(extractions: DataFrame, width: int = 8) -> DataFrame:
    """``doc_id, divergent_text, divergence_findings``, a row per document that diverges."""
    rows = by_document(extractions, width)
    own = F.transform(
        "es",
        lambda e: F.struct(
            e["extractor_ord"].alias("extractor_ord"),
            e["extractor"].alias("extractor"),
            F.array_sort(F.array_except(e["s"], F.col("common"))).alias("unique"),
        ),
    )

    def told(e: Column) -> Column:
        # Another populated extractor disagrees if it lacks one of these shingles.
        others = F.filter("es", lambda o: F.size(F.array_except(e["unique"], o["s"])) > 0)
        names = F.array_sort(F.transform(others, lambda o: o["extractor"]))
        return F.struct(
            e["extractor_ord"].alias("extractor_ord"),
            e["extractor"].alias("extractor"),
            F.size(e["unique"]).alias("n"),
            names.alias("others"),
            reconstruct(e["unique"], width).alias("words"),
        )

    apart = F.transform(F.filter("own", lambda e: F.size(e["unique"]) > 0), told)
    rows = evaluated(evaluated(rows, own=own).select("doc_id", "es", "own"), apart=apart).select("doc_id", "apart")

    def found(e: Column) -> Column:
        return finding(
            F.concat(F.lit("extractor_divergence."), e["extractor"]),
            "hidden_text",
            "high",
            "One extractor gives text that another does not.",
            F.array_join(e["words"], " "),
            (STAGES["divergence"], 2, 0, 0, e["extractor_ord"]),
            extractor=e["extractor"],
            divergent_shingles=e["n"],
            disagrees_with=F.array_join(F.slice(e["others"], 1, 4), ","),
        )

    long = F.filter("apart", lambda e: F.size(e["words"]) >= width)
    rows = evaluated(rows, divergence_findings=F.transform(long, found).cast(FINDINGS)).where(F.size("divergence_findings") > 0)
    return rows.select("doc_id", F.array_join(F.transform("divergence_findings", lambda f: f["evidence"]), " ").alias("divergent_text"), "divergence_findings")
