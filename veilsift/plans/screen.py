"""Detectors, their registry, and the screening plan.

A registry is a value: configuring it gives another one and leaves it as it was.  A detector that
is disabled is not part of the plan at all.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.runtime import ship_package
from ..functions.text import collapse, is_blank, joined_nonempty
from ..operators.aggregate import decided, deduped, escalated, in_order, sanitized
from ..operators.differential import applied, longest_text, screened_twice
from ..operators.divergence import divergence_layer
from ..operators.encoding import normalization_findings, normalize_for_screening, unicode_findings
from ..operators.instructions import pattern_findings
from ..operators.metadata import annotation_findings, field_findings, metadata_layer, xmp_texts
from ..operators.structure import structure_layer
from .model import FINDINGS, STAGES, Rule, ScreenConfig, finding, no_findings

#: Columns of a document row that detectors may read.
VISIBLE, HIDDEN, METADATA, DIVERGENT = "visible_text", "hidden_text", "metadata_text", "divergent_text"
TEXTS = (VISIBLE, HIDDEN, METADATA, DIVERGENT)
EXTRACTOR_CHARS = 4000

#: The same, normalised; such columns exist where the configuration asks to match normalised texts.
NORMAL = {c: f"normal_{c}" for c in TEXTS}

Builder = Callable[[int, ScreenConfig, Sequence[str]], Column]


@dataclass(frozen=True)
class Detector:
    """``build(slot, config, held)`` gives an array of findings over a document row.

    ``held`` names the text columns that can hold anything; nothing is built for others.

    Detectors whose findings come with the relations (structure, metadata, divergence) have no
    builder.
    """

    name: str
    stage: str = "custom"
    build: Builder | None = None
    enabled: bool = True


def concealed() -> Column:
    return joined_nonempty(F.col(HIDDEN), F.col(METADATA), F.col(DIVERGENT))


def _streams(visible: bool, hidden: bool, held: Sequence[str]) -> list[tuple[str, str, int]]:
    out = [(VISIBLE, "visible", 0)] if visible else []
    out += [(HIDDEN, "hidden", 1), (METADATA, "metadata", 2), (DIVERGENT, "hidden", 3)] if hidden else []
    return [x for x in out if x[0] in held]


def pattern_detector(
    name: str,
    rules: Sequence[Rule | tuple | str],
    category: str = "semantic_injection",
    stage: str = "instruction",
    scan_visible: bool = True,
    scan_concealed: bool = True,
) -> Detector:
    """Ordered patterns over each stream; overlaps are suppressed within a stream only."""
    fixed = [r if isinstance(r, Rule) else Rule(r) if isinstance(r, str) else Rule(*r) for r in rules]

    def build(slot: int, config: ScreenConfig, held: Sequence[str]) -> Column:
        each = [
            pattern_findings(NORMAL[c] if config.normalize_before_match else c, source, k, fixed, name, category, stage, slot)
            for c, source, k in _streams(scan_visible, scan_concealed, held)
        ]
        return F.concat(*each) if each else no_findings()

    return Detector(name, stage, build)


def row_detector(name: str, function: Callable[[], Column], stage: str = "custom") -> Detector:
    """``function()`` gives an array of findings from the text columns of a row."""
    return Detector(name, stage, lambda slot, config, held: function().cast(FINDINGS))


def python_detector(name: str, function: Callable[[dict], list[dict]], category: str = "semantic_injection", stage: str = "custom") -> Detector:
    """A Python rule per document, run in Arrow batches.

    It gets the texts of a document and returns findings as dicts with ``severity``, ``message``,
    ``evidence`` and optionally ``detail``.  An exception fails the query.
    """

    @F.pandas_udf("array<struct<severity:string,message:string,evidence:string,detail:map<string,string>>>")
    def call(rows: pd.DataFrame) -> pd.Series:
        def one(row) -> list:
            found = function(dict(zip(TEXTS, (t or "" for t in row))))
            return [
                {
                    "severity": f.get("severity", "high"),
                    "message": f.get("message", ""),
                    "evidence": f.get("evidence", ""),
                    "detail": {k: str(v) for k, v in f.get("detail", {}).items()},
                }
                for f in found
            ]

        return pd.Series([one(row) for row in zip(*(rows[c] for c in TEXTS))])

    def build(slot: int, config: ScreenConfig, held: Sequence[str]) -> Column:
        found = call(F.struct(*TEXTS))
        return F.transform(
            found,
            lambda x, i: finding(name, category, x["severity"], x["message"], x["evidence"], (STAGES[stage], slot, 0, i, 0)).withField(
                "detail", x["detail"]
            ),
        ).cast(FINDINGS)

    return Detector(name, stage, build)


def classifier_detector(
    name: str,
    load: Callable[[], Callable[[str], list[tuple[str, float]]]],
    threshold: float = 0.7,
    category: str = "semantic_injection",
    stage: str = "custom",
) -> Detector:
    """A classifier that ``load()`` gives once per worker; results from ``threshold`` on are findings.

    A classifier's exception is a finding of no weight; what it gave before that stays.
    """

    @F.pandas_udf("array<struct<label:string,score:double,error:string>>")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()

        def one(text: str | None) -> list:
            out: list[dict] = []
            try:
                for label, score in model(text) if text else ():
                    if score >= threshold:
                        out.append({"label": label, "score": float(score), "error": None})
            except Exception as problem:  # a broken model must not end the scan
                out.append({"label": None, "score": None, "error": str(problem)})
            return out

        for texts in batches:
            yield texts.map(one)

    def build(slot: int, config: ScreenConfig, held: Sequence[str]) -> Column:
        def stream(text: Column, source: str, k: int) -> Column:
            found = classify(F.when(~is_blank(text), text))
            return F.transform(
                found,
                lambda x, i: finding(
                    name,
                    category,
                    F.when(x["error"].isNotNull(), "info").otherwise("critical" if source == "hidden" else "high"),
                    F.coalesce(F.concat(F.lit("Classifier failed: "), x["error"]), F.concat(F.lit("Classified as "), x["label"])),
                    F.when(x["error"].isNull(), collapse(F.substring(text, 1, 120))).otherwise(""),
                    (STAGES[stage], slot, k, i, 0),
                    label=x["label"],
                    score=x["score"],
                    source=F.when(x["error"].isNull(), source),
                    error=x["error"],
                ),
            )

        parts = [stream(F.coalesce(F.col(VISIBLE), F.lit("")), "visible", 0)] if VISIBLE in held else []
        parts += [stream(concealed(), "hidden", 1)] if set(held) - {VISIBLE} else []
        return F.concat(no_findings(), *parts).cast(FINDINGS)

    return Detector(name, stage, build)


def _encoding(which: Callable[[Column, str, int], Column]) -> Builder:
    def build(slot: int, config: ScreenConfig, held: Sequence[str]) -> Column:
        parts = [which(F.col(VISIBLE), "visible", 0)] if VISIBLE in held else []
        parts += [which(concealed(), "hidden", 1)] if set(held) - {VISIBLE} else []
        return F.concat(no_findings(), *parts)

    return build


class Registry:
    """Detectors by name, in the order in which they were first registered."""

    def __init__(self, detectors: Sequence[Detector] = ()):
        self._by_name = {d.name: d for d in detectors}

    def register(self, detector: Detector) -> None:
        """A name that is known keeps its place."""
        self._by_name[detector.name] = detector

    def unregister(self, name: str) -> None:
        self._by_name.pop(name, None)

    def get(self, name: str) -> Detector | None:
        return self._by_name.get(name)

    def detectors(self) -> list[Detector]:
        return list(self._by_name.values())

    def clone(self) -> Registry:
        return Registry(self.detectors())

    def enabled(self, name: str) -> bool:
        found = self.get(name)
        return found is not None and found.enabled

    def configured(self, config: ScreenConfig) -> Registry:
        """A copy with the configured detectors off and the configured patterns on."""
        out = Registry([replace(d, enabled=d.enabled and d.name not in config.disabled_detectors) for d in self.detectors()])
        if config.custom_patterns:
            rules = [Rule(p["pattern"], p.get("severity", "high"), p.get("message", "A configured pattern matched.")) for p in config.custom_patterns]
            out.register(pattern_detector("config_custom_patterns", rules))
        return out


def default_registry() -> Registry:
    from .model import PHRASE_RULES

    return Registry(
        [
            Detector("pdf_structure", "structure"),
            Detector("pdf_metadata", "metadata"),
            Detector("extractor_divergence", "divergence"),
            Detector("unicode_tricks", "encoding", _encoding(unicode_findings)),
            Detector("normalization", "encoding", _encoding(normalization_findings)),
            pattern_detector("injection_patterns", PHRASE_RULES),
        ]
    )


@dataclass(frozen=True)
class Relations:
    """What an extractor knows of documents; ``documents`` has a row (doc_id, error) for each."""

    documents: DataFrame
    spans: DataFrame | None = None
    pages: DataFrame | None = None
    fills: DataFrame | None = None
    fields: DataFrame | None = None
    xmp: DataFrame | None = None
    annotations: DataFrame | None = None
    extractions: DataFrame | None = None


class Screen:
    """Screens documents: findings, verdict, score and safe text per document."""

    def __init__(self, config: ScreenConfig | None = None, registry: Registry | None = None):
        self.config = config or ScreenConfig.from_env()
        self.registry = (registry or default_registry()).configured(self.config)
        self.screener: Callable[[], Callable[[str], str]] | None = None

    # -- extension ------------------------------------------------------------

    def add_detector(self, detector: Detector) -> None:
        self.registry.register(detector)

    def add_pattern(self, pattern: str, severity: str = "high", message: str = "A configured pattern matched.", name: str | None = None, category: str = "semantic_injection") -> Detector:
        """The name of an unnamed pattern is the same in every process."""
        detector = pattern_detector(name or f"custom_pattern_{zlib.crc32(pattern.encode()) % 10000}", [Rule(pattern, severity, message)], category)
        self.registry.register(detector)
        return detector

    def add_rule(self, name: str, function: Callable[[dict], list[dict]] | None = None, category: str = "semantic_injection", stage: str = "custom"):
        """Register a Python rule, given or decorated."""

        def register(fn):
            self.registry.register(python_detector(name, fn, category, stage))
            return fn

        return register(function) if function is not None else register

    def add_classifier(self, name: str, load: Callable[[], Callable[[str], list[tuple[str, float]]]], threshold: float = 0.7, category: str = "semantic_injection") -> None:
        self.registry.register(classifier_detector(name, load, threshold, category))

    def disable_detector(self, name: str) -> None:
        if (found := self.registry.get(name)) is not None:
            self.registry.register(replace(found, enabled=False))

    def use_screener(self, load: Callable[[], Callable[[str], str]]) -> None:
        """What the differential screening asks; ``load()`` gives it once per worker."""
        self.screener = load

    # -- screening ------------------------------------------------------------

    def scan_texts(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """Screen documents that are one visible text each; row by row, so also a stream.

        Null texts are empty; other columns but ``doc_id`` are dropped.
        """
        nothing = F.lit("")
        rows = docs.select(
            "doc_id",
            F.coalesce(F.col(text), nothing).alias(VISIBLE) if self.registry.enabled("pdf_structure") else nothing.alias(VISIBLE),
            *(nothing.alias(c) for c in TEXTS[1:]),
            no_findings().alias("given"),
            F.lit(None).cast("string").alias("error"),
        )
        return self._compared(self.screened(rows, (VISIBLE,)), F.col(VISIBLE))

    def _compared(self, results: DataFrame, raw_text: Column) -> DataFrame:
        """With the differential screening, if it is enabled; it comes after all else."""
        if not self.config.enable_differential:
            return results
        return applied(screened_twice(results, raw_text, self.screener, self.config.material_delta), self.config.malicious_score)

    def assembled(self, r: Relations) -> DataFrame:
        """One row per document with its streams and the findings of the relations.

        Every relation is reduced by ``doc_id`` before it meets the documents.
        """
        rows = r.documents.select("doc_id", "error")
        on, given = self.registry.enabled, []
        if r.spans is not None and on("pdf_structure"):
            rows = rows.join(structure_layer(r.spans, r.pages, r.fills, self.config), "doc_id", "left")
            given.append("structure_findings")
        parts = []
        if on("pdf_metadata"):
            parts += [field_findings(r.fields)] if r.fields is not None else []
            parts += [xmp_texts(r.xmp)] if r.xmp is not None else []
            parts += [annotation_findings(r.annotations)] if r.annotations is not None else []
        if parts:
            rows = rows.join(metadata_layer(*parts), "doc_id", "left")
            given.append("metadata_findings")
        if r.extractions is not None and on("extractor_divergence"):
            rows = rows.join(divergence_layer(r.extractions, self.config.min_divergent_words), "doc_id", "left")
            given.append("divergence_findings")
        held = [c for c in TEXTS if c in rows.columns]
        texts = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in held else F.lit("").alias(c) for c in TEXTS]
        lists = [F.coalesce(F.col(g), no_findings()) for g in given]
        return rows.select("doc_id", *texts, (F.concat(*lists) if lists else no_findings()).alias("given"), "error")

    def scan(self, relations: Relations) -> DataFrame:
        rows = self.screened(self.assembled(relations))
        if relations.pages is not None:
            pages = relations.pages.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("pages"))
            rows = rows.join(pages, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.lit(0)))
        if relations.extractions is not None:
            entry = F.struct("extractor", F.substring(collapse(F.coalesce("text", F.lit(""))), 1, EXTRACTOR_CHARS))
            texts = relations.extractions.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(entry)).alias("extractor_texts"))
            rows = rows.join(texts, "doc_id", "left")
            if self.config.enable_differential:
                rows = rows.join(longest_text(relations.extractions), "doc_id", "left")
                return self._compared(rows, F.col("raw_text")).drop("raw_text")
        return self._compared(rows, F.col(VISIBLE))

    def screened(self, rows: DataFrame, held: Sequence[str] = TEXTS) -> DataFrame:
        """Findings, verdict and safe text of document rows (``doc_id``, texts, ``given``, ``error``).

        ``held`` names the texts that are not empty throughout.
        """
        ship_package(rows.sparkSession)
        if self.config.normalize_before_match:
            rows = rows.withColumns({NORMAL[c]: normalize_for_screening(F.col(c)) for c in held})
        raw = [F.col("given")] + [
            d.build(slot, self.config, held) for slot, d in enumerate(self.registry.detectors()) if d.enabled and d.build is not None
        ]
        found = rows.withColumn("raw", F.concat(*raw))
        found = found.withColumn("ordered", in_order(F.col("raw")))
        found = found.withColumn("findings", deduped(escalated(F.col("ordered"))))
        judged = found.withColumn("d", decided(F.col("findings"), self.config.malicious_score, self.config.suspicious_score))
        broken = F.col("error").isNotNull()
        return judged.select(
            "doc_id",
            F.when(broken, "suspicious").otherwise(F.col("d.verdict")).alias("verdict"),
            F.when(broken, 0).otherwise(F.col("d.risk_score")).alias("risk_score"),
            F.when(broken, no_findings()).otherwise(F.col("findings")).alias("findings"),
            collapse(F.col(VISIBLE)).alias("visible_text"),
            collapse(concealed()).alias("hidden_text"),
            sanitized(F.col(VISIBLE), F.col("findings")).alias("sanitized_text"),
            F.when(broken, F.array(F.col("error"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        )

    def sanitize(self, docs: DataFrame, text: str = "text") -> DataFrame:
        return self.scan_texts(docs, text).select("doc_id", "sanitized_text")


def findings_table(results: DataFrame) -> DataFrame:
    """One row per finding, ``pos`` its place in the document's list."""
    # Of a plain explode the optimizer infers a filter on the list, pushes it down to the texts and
    # has every detector run once more for it.
    rows = results.select("doc_id", F.posexplode_outer("findings").alias("pos", "f")).where("pos is not null")
    return rows.select("doc_id", "pos", "f.*")


def result_json(results: DataFrame) -> DataFrame:
    """``doc_id, json``: each result as one JSON text."""
    return results.select("doc_id", F.to_json(F.struct(*results.columns)).alias("json"))
