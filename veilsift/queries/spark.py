"""One query per operator of the engine, over whole tables with planted payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import rule_spans
from ..functions.runtime import durable, ship_package
from ..functions.text import around, strip_invisible
from ..operators import differential, divergence, encoding, metadata, reports, structure
from ..plans.model import PHRASE_RULES, ScreenConfig
from ..plans.screen import Relations, Screen, default_registry, findings_table, result_json
from ..sources import files, fixtures, pdf, pdf_samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PATTERNS = [r.pattern for r in PHRASE_RULES]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _screen(**config) -> Screen:
    return Screen(ScreenConfig(**config), default_registry())


def _only(detector: str) -> Screen:
    others = [d.name for d in default_registry().detectors() if d.name not in (detector, "pdf_structure")]
    return _screen(disabled_detectors=others)


def _scan(spark: SparkSession, sf_dir: str, **config) -> DataFrame:
    return _screen(**config).scan_texts(fixtures.planted(spark, sf_dir))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def _as_pdf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [pdf_samples.of_lines(t.as_py().split("\n")) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "content"])


def _spans(spark: SparkSession, sf_dir: str, suppress: bool, source=fixtures.planted) -> DataFrame:
    ship_package(spark)
    docs = source(spark, sf_dir)
    rows = docs.select("doc_id", "text", F.explode(rule_spans("text", PATTERNS, suppress)).alias("s"))
    return rows.select(
        "doc_id", "text", F.col("s.rule").alias("rule"), F.col("s.start").alias("first"), F.col("s.end").alias("last"), "s.matched"
    )


@query
def instruction_hits_by_rule(spark, sf_dir):
    hits = _spans(spark, sf_dir, False)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"))


@query
def instruction_spans(spark, sf_dir):
    return _spans(spark, sf_dir, False).drop("text")


@query
def overlap_suppressed_findings(spark, sf_dir):
    return _spans(spark, sf_dir, True).drop("text")


@query
def phrase_spans(spark, sf_dir):
    """All ten rules, each hit by some documents."""
    return _spans(spark, sf_dir, False, fixtures.phrased).drop("text")


@query
def phrase_findings(spark, sf_dir):
    """The same, where the earlier rule takes what several rules hit."""
    return _spans(spark, sf_dir, True, fixtures.phrased).drop("text")


@query
def phrase_hits_by_rule(spark, sf_dir):
    hits = _spans(spark, sf_dir, True, fixtures.phrased)
    return hits.groupBy("rule").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("doc_id").alias("documents"))


@query
def instruction_evidence(spark, sf_dir):
    spans = _spans(spark, sf_dir, True)
    return spans.select("doc_id", "rule", around(F.col("text"), F.col("first"), F.col("last")).alias("evidence"))


@query
def zero_width_findings(spark, sf_dir):
    scanned = _only("unicode_tricks").scan_texts(fixtures.planted(spark, sf_dir))
    found = findings_table(scanned).where("detector = 'unicode.zero_width'")
    return found.select("doc_id", "severity", F.col("detail")["count"].cast("long").alias("n"), F.col("detail")["characters"].alias("characters"), "evidence")


@query
def bidi_findings(spark, sf_dir):
    scanned = _only("unicode_tricks").scan_texts(fixtures.planted(spark, sf_dir))
    found = findings_table(scanned).where("detector = 'unicode.bidi_override'")
    return found.select("doc_id", "severity", F.col("detail")["count"].cast("long").alias("n"), F.col("detail")["characters"].alias("characters"), "evidence")


@query
def mixed_script_words(spark, sf_dir):
    docs = fixtures.planted(spark, sf_dir)
    words = docs.select("doc_id", F.explode(encoding.mixed_words(F.col("text"))).alias("w"))
    return words.select("doc_id", F.col("w.word").alias("word"), F.array_join("w.scripts", "+").alias("scripts"))


@query
def nfkc_divergence(spark, sf_dir):
    ship_package(spark)
    docs = fixtures.planted(spark, sf_dir).select("doc_id", encoding.nfkc_delta(F.col("text")).cast("long").alias("delta"))
    return docs.where("delta >= 12")


@query
def normalized_text(spark, sf_dir):
    ship_package(spark)
    docs = fixtures.planted(spark, sf_dir).select("doc_id", encoding.normalize_for_screening(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


@query
def mixed_script_caps(spark, sf_dir):
    """More mixed words than a finding shows or lists."""
    ship_package(spark)
    words = _pages(spark, sf_dir).select("page_id", F.repeat(F.lit("w\u03bfrd "), 25).alias("text"))
    found = words.select("page_id", F.explode(encoding.normalization_findings(F.col("text"), "visible", 0)).alias("f"))
    return found.select(
        F.col("page_id").alias("doc_id"), F.col("f.detail")["count"].cast("long").alias("n"), "f.evidence", F.col("f.detail")["words"].alias("words")
    )


@query
def strip_invisible_text(spark, sf_dir):
    docs = fixtures.planted(spark, sf_dir).select("doc_id", strip_invisible(F.col("text")).alias("t"))
    return docs.select("doc_id", F.char_length("t").cast("long").alias("n"), F.md5("t").alias("digest"))


def _layout(spark, sf_dir):
    docs = fixtures.planted(spark, sf_dir)
    spans = fixtures.spans(docs)
    return spans, fixtures.pages(spans), fixtures.fills(docs)


@query
def span_luminance(spark, sf_dir):
    spans, _, _ = _layout(spark, sf_dir)
    return spans.select("doc_id", "span_ord", F.round(structure.packed_luminance(F.col("color")), 6).alias("luminance"))


@query
def background_last_fill(spark, sf_dir):
    spans, _, fills = _layout(spark, sf_dir)
    return structure.with_background(spans, fills).select("doc_id", "span_ord", F.round("background", 6).alias("background"))


@query
def span_classification(spark, sf_dir):
    shown = structure.classified(*_layout(spark, sf_dir), ScreenConfig())
    return shown.groupBy(F.coalesce("reason", F.lit("visible")).alias("reason")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("documents")
    )


@query
def hidden_span_findings(spark, sf_dir):
    shown = structure.structure_layer(*_layout(spark, sf_dir), ScreenConfig())
    found = shown.select("doc_id", F.explode("structure_findings").alias("f")).select("doc_id", "f.*")
    return found.select("doc_id", "detector", "severity", F.col("ord.pos").alias("span_ord"), "page", F.md5("evidence").alias("digest"))


@query
def visible_hidden_streams(spark, sf_dir):
    shown = structure.structure_layer(*_layout(spark, sf_dir), ScreenConfig())
    return shown.select("doc_id", F.md5("visible_text").alias("visible"), F.md5("hidden_text").alias("hidden"))


@query
def metadata_field_findings(spark, sf_dir):
    found = metadata.field_findings(fixtures.fields(_pages(spark, sf_dir))).select("doc_id", "f.*")
    return found.select("doc_id", "detector", "severity", "evidence")


@query
def annotation_findings(spark, sf_dir):
    found = metadata.annotation_findings(fixtures.annotations(_pages(spark, sf_dir)))
    return found.select("doc_id", "text", F.col("f").isNotNull().alias("is_finding"))


@query
def metadata_stream(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    parts = metadata.field_findings(fixtures.fields(pages)), metadata.annotation_findings(fixtures.annotations(pages))
    return metadata.metadata_layer(*parts).select("doc_id", "metadata_text", F.size("metadata_findings").cast("long").alias("n"))


def _extractions(spark, sf_dir):
    return fixtures.extractions(fixtures.documents(spark, sf_dir))


@query
def extractor_tokens(spark, sf_dir):
    rows = _extractions(spark, sf_dir).withColumn("w", divergence.tokens(F.col("text")))
    return rows.select("doc_id", "extractor", F.size("w").cast("long").alias("n"))


@query
def extractor_shingles(spark, sf_dir):
    return divergence.exploded(_extractions(spark, sf_dir), 8).groupBy("doc_id", "extractor").agg(F.count(F.lit(1)).alias("n"))


@query
def divergent_shingles(spark, sf_dir):
    apart = divergence.divergent(_extractions(spark, sf_dir), 8)
    return apart.select("doc_id", F.size("divergent").cast("long").alias("n"))


@query
def divergence_findings(spark, sf_dir):
    found = divergence.divergence_layer(_extractions(spark, sf_dir), 8)
    rows = found.select("doc_id", F.explode("divergence_findings").alias("f")).select("doc_id", "f.*")
    detail = F.col("detail")
    return rows.select(
        "doc_id", "detector", detail["divergent_shingles"].cast("long").alias("n"), detail["disagrees_with"].alias("disagrees_with"), "evidence"
    )


@query
def divergent_streams(spark, sf_dir):
    found = divergence.divergence_layer(_extractions(spark, sf_dir), 8)
    return found.select("doc_id", F.md5("divergent_text").alias("digest"))


@query
def extractor_text_caps(spark, sf_dir):
    """What a result keeps of each extractor's text."""
    docs = fixtures.documents(spark, sf_dir)
    known = Relations(docs.select("doc_id", F.lit(None).cast("string").alias("error")), extractions=fixtures.extractions(docs))
    kept = _only("none").scan(known).select("doc_id", F.explode("extractor_texts").alias("extractor", "text"))
    return kept.select("doc_id", "extractor", F.char_length("text").cast("long").alias("n"), F.md5("text").alias("digest"))


def _carried(spark, sf_dir) -> DataFrame:
    """Documents whose payloads come through metadata only."""
    pages = _pages(spark, sf_dir)
    documents = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("page_id") % 10 == 9, "cannot open").alias("error"))
    relations = Relations(documents, fields=fixtures.fields(pages), annotations=fixtures.annotations(pages))
    return _screen().scan(relations)


@query
def escalated_findings(spark, sf_dir):
    found = findings_table(_carried(spark, sf_dir)).where("category = 'semantic_injection'")
    return found.select("doc_id", "severity", F.col("detail")["matched"].alias("matched"), F.col("detail")["source"].alias("source"))


@query
def deduped_findings(spark, sf_dir):
    """What is left of repeats, in stage order."""
    return findings_table(_carried(spark, sf_dir)).select("doc_id", F.col("pos").cast("long").alias("place"), "detector", "severity", "evidence")


@query
def grouped_findings(spark, sf_dir):
    groups = _carried(spark, sf_dir).select("doc_id", F.posexplode_outer(reports.grouped(F.col("findings"))).alias("place", "g")).where("g is not null")
    return groups.select(
        "doc_id",
        F.col("place").cast("long").alias("place"),
        F.col("g.category").alias("category"),
        F.col("g.worst").cast("long").alias("worst"),
        F.col("g.n").cast("long").alias("n"),
        F.get("g.findings", F.lit(0))["evidence"].alias("first_evidence"),
    )


@query
def result_json_fields(spark, sf_dir):
    """Results as JSON text, read back."""
    told = result_json(_carried(spark, sf_dir))
    return told.select(
        "doc_id",
        F.get_json_object("json", "$.verdict").alias("verdict"),
        F.get_json_object("json", "$.risk_score").cast("long").alias("risk_score"),
        F.md5(F.get_json_object("json", "$.hidden_text")).alias("hidden"),
    )


@query
def concealed_findings(spark, sf_dir):
    """Notes and XMP that conceal: every finding names the stream that it comes from."""
    pages = _pages(spark, sf_dir)
    documents = pages.select(F.col("page_id").alias("doc_id"), F.lit(None).cast("string").alias("error"))
    found = findings_table(_screen().scan(Relations(documents, annotations=fixtures.concealing_notes(pages), xmp=fixtures.xmp(pages))))
    return found.select("doc_id", "detector", "severity", F.col("detail")["source"].alias("source"), F.col("detail")["characters"].alias("characters"))


@query
def carried_results(spark, sf_dir):
    return _carried(spark, sf_dir).select(
        "doc_id", "verdict", F.col("risk_score").cast("long").alias("risk_score"), F.size("errors").cast("long").alias("errors"), F.md5("hidden_text").alias("hidden")
    )


@query
def verdicts(spark, sf_dir):
    return _scan(spark, sf_dir).select("doc_id", "verdict", F.col("risk_score").cast("long").alias("risk_score"), F.size("findings").cast("long").alias("findings"))


@query
def layered_scan_results(spark, sf_dir):
    docs = fixtures.planted(spark, sf_dir)
    spans = durable(fixtures.spans(docs), "spans")  # several layers read the layout
    known = Relations(
        docs.select("doc_id", F.lit(None).cast("string").alias("error")), spans, fixtures.pages(spans), fixtures.fills(docs), extractions=fixtures.extractions(docs)
    )
    results = _screen().scan(known)
    return results.select("doc_id", "verdict", F.col("risk_score").cast("long").alias("risk_score"), F.size("findings").cast("long").alias("findings"), F.col("pages").cast("long").alias("pages"))


@query
def sanitized_text(spark, sf_dir):
    safe = _screen().sanitize(fixtures.planted(spark, sf_dir))
    return safe.select("doc_id", F.char_length("sanitized_text").cast("long").alias("n"), F.md5("sanitized_text").alias("digest"))


CUSTOM = r"\b(apache|mit)\s+license\b"


@query
def custom_pattern_findings(spark, sf_dir):
    screen = _screen()
    screen.add_pattern(CUSTOM, "low", name="license_words")
    found = findings_table(screen.scan_texts(fixtures.documents(spark, sf_dir))).where("detector = 'license_words'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("detail")["matched"]).alias("matched"))


@query
def configured_pattern_findings(spark, sf_dir):
    config = ScreenConfig.from_dict({"custom_patterns": [{"pattern": CUSTOM, "severity": "low", "message": "a license"}]})
    found = findings_table(Screen(config, default_registry()).scan_texts(fixtures.documents(spark, sf_dir)))
    found = found.where("detector = 'config_custom_patterns'")
    return found.groupBy("doc_id", "severity").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("detail")["matched"]).alias("matched"))


@query
def disabled_detector_scan(spark, sf_dir):
    results = _scan(spark, sf_dir, disabled_detectors=["unicode_tricks", "normalization"])
    return results.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def threshold_override_scan(spark, sf_dir):
    results = _scan(spark, sf_dir, malicious_score=45, suspicious_score=30)
    return results.select("doc_id", "verdict", F.col("risk_score").cast("long").alias("risk_score"))


def _toy():
    """A stand-in for a model: sure of what looks like a token."""
    return lambda text: [("credential", 0.9 if "token =" in text else 0.1)]


@query
def classifier_findings(spark, sf_dir):
    screen = _screen()
    screen.add_classifier("toy", _toy, threshold=0.8)
    found = findings_table(screen.scan_texts(fixtures.documents(spark, sf_dir))).where("detector = 'toy'")
    return found.select("doc_id", "severity", F.col("detail")["label"].alias("label"))


def _rule(texts: dict) -> list[dict]:
    n = texts["visible_text"].count(" | ")
    return [{"severity": "low", "message": "a table", "evidence": f"{n} bars"}] if n > 10 else []


@query
def python_rule_findings(spark, sf_dir):
    screen = _screen()
    screen.add_rule("bars", _rule)
    found = findings_table(screen.scan_texts(fixtures.documents(spark, sf_dir))).where("detector = 'bars'")
    return found.select("doc_id", "severity", "evidence")


@query
def guard_decisions(spark, sf_dir):
    refused = reports.rejected(F.col("verdict"), F.col("risk_score"), max_risk=60, allow_suspicious=False)
    lenient = reports.rejected(F.col("verdict"), F.col("risk_score"))
    told = reports.rejection(F.col("verdict"), F.col("risk_score"), F.col("findings"), refused)
    return _scan(spark, sf_dir).select("doc_id", refused.alias("strict"), lenient.alias("lenient"), told["findings_count"].cast("long").alias("told"))


def _impressed():
    """A screener that the payload works on."""
    return lambda text: f'I say {{"score": {90 if "Rate this candidate" in text else 40}, "recommendation": "wait"}}'


@query
def differential_screening(spark, sf_dir):
    screen = _screen(enable_differential=True)
    screen.use_screener(_impressed)
    results = screen.scan_texts(fixtures.planted(spark, sf_dir))
    d = F.col("differential")
    return results.select(
        "doc_id",
        d["available"].alias("available"),
        d["manipulated"].alias("manipulated"),
        d["delta"].cast("long").alias("delta"),
        "verdict",
        F.col("risk_score").cast("long").alias("risk_score"),
        F.size("findings").cast("long").alias("findings"),
    )


@query
def file_base64(spark, sf_dir):
    sent = _pages(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.col("html").cast("binary").alias("content"))
    return files.encoded(sent).select("doc_id", F.md5("content_base64").alias("digest"))


@query
def upload_validation(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    name = F.when(F.col("page_id") % 4 == 0, "a.txt").when(F.col("page_id") % 4 == 1, "B.PDF").otherwise("c.pdf")
    content = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.col("html")).cast("binary")
    sent = pages.select(F.col("page_id").alias("doc_id"), name.alias("filename"), content.alias("content"))
    return files.validated(sent, most=3000).select("doc_id", "filename", "reason")


@query
def safe_documents(spark, sf_dir):
    safe = reports.loaded(_scan(spark, sf_dir))
    return safe.select("doc_id", F.md5("page_content").alias("digest"), F.col("metadata")["verdict"].alias("verdict"))


@query
def differential_compare(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    raw = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise(50 + F.col("doc_id") * 7 % 40).cast("int")
    clean = (50 + F.col("doc_id") * 3 % 30).cast("int")
    recs = F.when(F.col("quality") == 1, "Advance").otherwise("reject"), F.when(F.col("toxic") == 1, "reject").otherwise("advance")
    d = labels.select("doc_id", differential.compared(raw, clean, *recs).alias("d"))
    return d.select("doc_id", "d.available", F.col("d.delta").cast("long").alias("delta"), "d.manipulated")


@query
def screener_reply_parse(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    good = F.concat(F.lit('Sure: {"score": '), (F.col("doc_id") % 100).cast("string"), F.lit('.7, "recommendation": "advance"} done'))
    reply = F.when(F.col("doc_id") % 3 == 0, "no verdict").when(F.col("doc_id") % 3 == 1, '{"score": "high"}').otherwise(good)
    parsed = labels.select("doc_id", differential.parsed_reply(reply).alias("p"))
    return parsed.select("doc_id", F.col("p.score").cast("long").alias("score"), F.col("p.recommendation").alias("recommendation"))


@query
def findings_by_category(spark, sf_dir):
    return reports.by_category(findings_table(_scan(spark, sf_dir))).select("category", "n", F.col("worst").cast("long").alias("worst"), F.col("place").cast("long").alias("place"))


@query
def detector_summary(spark, sf_dir):
    return reports.detector_summary(findings_table(_scan(spark, sf_dir)))


@query
def verdict_distribution(spark, sf_dir):
    spread = reports.verdict_distribution(_scan(spark, sf_dir))
    return spread.select("verdict", "n", F.col("least").cast("long").alias("least"), F.col("most").cast("long").alias("most"))


@query
def finding_counts(spark, sf_dir):
    counted = reports.counts(_scan(spark, sf_dir))
    return counted.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("concealed", "instructing", "removed_count")))


@query
def withheld_chars(spark, sf_dir):
    kept = reports.withheld_chars(F.col("visible_text"), F.col("hidden_text"), F.col("sanitized_text"))
    return _scan(spark, sf_dir).select("doc_id", kept.cast("long").alias("withheld"))


@query
def locatable_findings(spark, sf_dir):
    shown = structure.structure_layer(*_layout(spark, sf_dir), ScreenConfig())
    found = reports.locatable(shown.select("doc_id", F.explode("structure_findings").alias("f")).select("doc_id", "f.*"))
    wide, high = F.lit(612.0), F.lit(792.0)
    return found.select(
        "doc_id",
        F.col("ord.pos").alias("span_ord"),
        reports.on_page(F.col("bbox"), wide, high).alias("drawable"),
        F.round(reports.percent_box(F.col("bbox"), wide, high)["top"], 4).alias("top"),
    )


@query
def technique_evaluation(spark, sf_dir):
    docs = fixtures.documents(spark, sf_dir)
    k = F.col("doc_id") % 10
    technique = F.when(F.col("doc_id") % 20 == 11, "few").otherwise(F.element_at(F.array(*map(F.lit, TECHNIQUES)), (k + 1).cast("int")))
    truth = docs.select("doc_id", technique.alias("technique")).withColumn("is_poisoned", ~F.col("technique").isin("few", "benign", "none"))
    return reports.evaluated(_scan(spark, sf_dir), truth)


TECHNIQUES = ("payload", "zero_width", "bidi", "address", "mixed", "benign", "wide", "none", "none", "none")


@query
def pdf_sample_scan(spark, sf_dir):
    made = pdf_samples.sample_files(spark)
    results = pdf.scan_files(made, _screen()).select("doc_id", "verdict", "risk_score", "pages")
    return results.join(made.select("doc_id", "technique", "is_poisoned"), "doc_id")


def _written(spark, sf_dir) -> DataFrame:
    ship_package(spark)
    texts = fixtures.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(_as_pdf, "doc_id long, content binary")


@query
def pdf_extractions(spark, sf_dir):
    """What the reader's own extractors give of every document written as a PDF file."""
    read = pdf.parse_files(_written(spark, sf_dir)).select("doc_id", F.explode("extractions").alias("e"))
    return read.where("e.extractor in ('page', 'unclipped')").select("doc_id", F.col("e.extractor").alias("extractor"), F.md5("e.text").alias("digest"))


@query
def pdf_round_trip(spark, sf_dir):
    """Every document written as a PDF file and read back."""
    read = pdf.parse_files(_written(spark, sf_dir))
    lines = F.array_join(F.transform("spans", lambda s: s["text"]), "\n")
    return read.select(
        "doc_id",
        F.size("pages").cast("long").alias("pages"),
        F.size("spans").cast("long").alias("lines"),
        F.md5(lines).alias("text_md5"),
        F.col("error").isNull().alias("readable"),
    )
