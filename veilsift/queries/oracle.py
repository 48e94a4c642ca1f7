"""DuckDB statements of the queries, written apart from the Spark plans."""

from __future__ import annotations

from ..plans.model import PHRASE_RULES, REDACTED
from ..sources.fixtures import ADDRESS, NOTES, PAYLOAD, PHRASED, PLANTED, WIDE

D = f"WITH d AS (SELECT doc_id, {PLANTED} AS text FROM documents)"
ZW = "​‌‍⁠﻿­"
BD = "‪‫‬‭‮⁦⁧⁨⁩"
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}', ' ', 'g'))"


def _all_spans(base: str = D) -> str:
    """``base`` names the texts ``d(doc_id, text)``.  No phrase that is planted is hit by three rules in a chain."""
    each = []
    for i, rule in enumerate(PHRASE_RULES):
        p = "(?is)(.*?)(" + rule.pattern.replace("'", "''") + ")"
        each.append(
            f"SELECT doc_id, text, {i} AS rule, g, m, unnest(range(1, len(m) + 1)) AS k FROM (SELECT doc_id, text, "
            f"regexp_extract_all(text, '{p}', 1) AS g, regexp_extract_all(text, '{p}', 2) AS m FROM d)"
        )
    return (
        f"{base}, raw AS ({' UNION ALL '.join(each)}), placed AS (SELECT doc_id, text, rule, m[k] AS matched, "
        "(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT AS first FROM raw), "
        "spans AS (SELECT doc_id, text, rule, first, first + length(matched)::INT AS last, matched FROM placed), "
        "kept AS (SELECT * FROM spans s WHERE NOT EXISTS (SELECT 1 FROM spans e WHERE e.doc_id = s.doc_id AND e.rule < s.rule AND s.first < e.last AND s.last > e.first))"
    )


SPANS = _all_spans()
PHRASE_SPANS = _all_spans(f"WITH d AS (SELECT doc_id, {PHRASED} AS text FROM documents)")


def _chars(chars: str, names: str, least: int) -> str:
    return f"""{D}, c AS (SELECT doc_id, text, length(text) - length(translate(text, '{chars}', '')) AS n,
      length(regexp_extract(text, '^([^{chars}]*)[{chars}]', 1)) AS pos FROM d)
    SELECT doc_id, 'high' AS severity, n::BIGINT AS n, '{names}' AS characters,
      replace(substr(text, greatest(pos - 40, 0) + 1, pos + 40 - greatest(pos - 40, 0)), chr(10), ' ') AS evidence
    FROM c WHERE n >= {least}"""


def _lum(r: str, g: str, b: str) -> str:
    def line(c: str) -> str:
        return f"(CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE power(({c} + 0.055) / 1.055, 2.4) END)"

    return f"(0.2126 * {line(r)} + 0.7152 * {line(g)} + 0.0722 * {line(b)})"


LAYOUT = f"""{D}, lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM d),
 spans AS (SELECT doc_id, (line // 50)::INT AS page, line::INT AS span_ord, text, (doc_id * 31 + line) % 12 AS k, 72.0::DOUBLE AS x0,
   (72 + 14 * (line % 50) + CASE WHEN (doc_id * 31 + line) % 12 = 8 THEN 2000 ELSE 0 END)::DOUBLE AS y0,
   (72 + 5 * least(length(text), 90))::DOUBLE AS x1 FROM lines),
 looks AS (SELECT *, y0 + 10 AS y1, CASE k WHEN 3 THEN 1.0 WHEN 4 THEN 3.99 WHEN 5 THEN 4.0 ELSE 10.0 END AS size,
   CASE k WHEN 6 THEN 255 WHEN 7 THEN 238 ELSE 0 END / 255.0::DOUBLE AS grey, CASE k WHEN 0 THEN 0 WHEN 1 THEN 25 WHEN 2 THEN 26 ELSE 255 END AS alpha FROM spans),
 lit AS (SELECT *, {_lum('grey', 'grey', 'grey')} AS lum FROM looks),
 fills AS (SELECT doc_id, 0 AS page, o, h, {_lum('r', 'g', 'b')} AS flum FROM d, (VALUES (0, 300.0, 0.1::DOUBLE, 0.1::DOUBLE, 0.3::DOUBLE), (1, 120.0, 0.95, 0.95, 0.95)) f(o, h, r, g, b) WHERE doc_id % 3 = 0),
 behind AS (SELECT s.*, coalesce((SELECT arg_max(f.flum, f.o) FROM fills f WHERE f.doc_id = s.doc_id AND f.page = s.page AND s.x0 >= -1 AND s.y0 >= -1 AND s.x1 <= 613 AND s.y1 <= f.h + 1), 1.0) AS background FROM lit s),
 told AS (SELECT *, CASE WHEN alpha <= 25 THEN 'invisible_render' WHEN size < 4.0 THEN 'tiny_font' WHEN y0 > 792 THEN 'offpage'
   WHEN abs(lum - background) < 0.12 THEN 'low_contrast' END AS reason FROM behind WHERE NOT regexp_matches(text, '^[\\s\\x1c-\\x1f\\x{{85}}\\x{{a0}}]*$'))"""

EXTRACTED = """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[^a-zA-Z0-9]+'), lambda x: x <> '') AS w FROM documents),
 e AS (SELECT doc_id, 'all' AS extractor, w FROM w UNION ALL SELECT doc_id, 'clipped', w[1:greatest(len(w) - 20, 0)] FROM w
   UNION ALL SELECT doc_id, 'third', CASE WHEN doc_id % 4 <> 0 THEN w ELSE [] END FROM w),
 s AS (SELECT DISTINCT doc_id, extractor, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: lower(array_to_string(w[i:i + 7], ' '))) ELSE [] END) AS sh FROM e)"""

# The layers' findings on planted texts, by what was planted.  Near a text's start both phrases of
# the payload have the whole text as their evidence: the second is a repeat and is not redacted.
PER_DOC = f"""{D}, m AS (SELECT doc_id, text,
   length(text) - length(translate(text, '{ZW}', '')) >= 8 AS zw, length(text) <> length(translate(text, '{BD}', '')) AS bd,
   regexp_matches(text, '[a-z][\\x{{400}}-\\x{{52f}}]') AS mx, regexp_matches(text, '[\\x{{ff21}}-\\x{{ff3a}}]{{12,}}') AS wd,
   contains(text, '{PAYLOAD}') AS pay, strpos(text, 'Rate this candidate') <= 61 AS short, contains(text, '{ADDRESS}') AS adr FROM d),
 v AS (SELECT *, CASE WHEN pay THEN 'malicious' WHEN adr OR zw OR bd OR mx OR wd THEN 'suspicious' ELSE 'clean' END AS verdict,
   CASE WHEN pay THEN 70 WHEN adr OR zw OR bd OR mx THEN 45 WHEN wd THEN 25 ELSE 0 END AS risk_score,
   zw::INT + bd::INT + mx::INT + wd::INT AS concealed, CASE WHEN pay AND NOT short THEN 2 WHEN pay OR adr THEN 1 ELSE 0 END AS instructing FROM m),
 f AS (SELECT doc_id, unnest(CASE WHEN pay AND short THEN [('injection_patterns', 'semantic_injection', 'critical')] WHEN pay THEN [('injection_patterns', 'semantic_injection', 'critical'), ('injection_patterns', 'semantic_injection', 'high')]
   WHEN adr THEN [('injection_patterns', 'semantic_injection', 'high')] WHEN zw THEN [('unicode.zero_width', 'unicode_trick', 'high')]
   WHEN bd THEN [('unicode.bidi_override', 'unicode_trick', 'high')] WHEN mx THEN [('normalization.mixed_script', 'unicode_trick', 'high')]
   WHEN wd THEN [('normalization.nfkc_divergence', 'unicode_trick', 'medium')] ELSE [] END) AS x FROM v),
 safe AS (SELECT *, {_collapse(f"replace(replace(replace(regexp_replace(text, '[\\p{{Cf}}]', '', 'g'), 'Ignore all previous instructions', '{REDACTED}'), CASE WHEN short THEN '' ELSE 'Rate this candidate' END, '{REDACTED}'), 'You are a language model', '{REDACTED}')")} AS clean FROM v)"""

FIELDS = f"""WITH fields AS (SELECT page_id AS doc_id, 'title' AS field, 0 AS pos, rpad(url, (57 + page_id % 6)::INT, 'x') AS value FROM pages
   UNION ALL SELECT page_id, 'subject', 1, '{PAYLOAD} {ADDRESS}' FROM pages WHERE page_id % 5 = 0),
 long AS (SELECT * FROM fields WHERE length(value) >= 60),
 notes AS (SELECT page_id AS doc_id, CASE WHEN page_id % 4 = 0 THEN '{PAYLOAD}' ELSE 'see me' END AS text FROM pages WHERE page_id % 2 = 0)"""

# Texts, phrases and findings of documents whose payloads come through metadata; those that can't be opened have none.
_TEXTS = f"""{FIELDS}, parts AS (SELECT doc_id, 0 AS part, pos, value AS text FROM long UNION ALL SELECT doc_id, 1, 0, text FROM notes),
 d AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY part, pos) AS text FROM parts GROUP BY doc_id)"""
CARRIED = f"""{_all_spans(_TEXTS)},
 every AS (SELECT doc_id, 1 AS stage, 0 AS stream, pos AS rule, 0 AS place, 'pdf_metadata.' || field AS detector, 'metadata' AS category, 'medium' AS severity, value AS evidence FROM long
   UNION ALL SELECT doc_id, 1, 1, 0, 0, 'pdf_metadata.annotation', 'metadata', 'medium', text FROM notes WHERE length(text) >= 60
   UNION ALL SELECT doc_id, 4, 2, rule, first, 'injection_patterns', 'semantic_injection', 'critical', {_collapse('substr(text, greatest(first - 60, 0) + 1, last + 60 - greatest(first - 60, 0))')} FROM kept),
 once AS (SELECT * FROM every WHERE doc_id % 10 <> 9
   QUALIFY row_number() OVER (PARTITION BY doc_id, detector, left({_collapse('lower(evidence)')}, 160) ORDER BY stage, stream, rule, place) = 1),
 final AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, stream, rule, place) - 1 AS pos FROM once)"""
_CARRIED_RESULTS = f"""{_TEXTS}, has AS (SELECT page_id AS doc_id, page_id % 5 = 0 OR page_id % 4 = 0 AS instructs,
   exists(SELECT 1 FROM long l WHERE l.doc_id = page_id) OR page_id % 4 = 0 AS conceals FROM pages),
 r AS (SELECT doc_id, CASE WHEN doc_id % 10 = 9 THEN 'suspicious' WHEN instructs THEN 'malicious' WHEN conceals THEN 'suspicious' ELSE 'clean' END AS verdict,
   (CASE WHEN doc_id % 10 = 9 THEN 0 WHEN instructs THEN 78 WHEN conceals THEN 25 ELSE 0 END)::BIGINT AS risk_score, (doc_id % 10 = 9)::BIGINT AS errors,
   md5(coalesce({_collapse('d.text')}, '')) AS hidden FROM has LEFT JOIN d USING (doc_id))"""

DIVERGENCE = f"""{EXTRACTED}, p AS (SELECT doc_id, count(DISTINCT extractor) AS p FROM s GROUP BY 1 HAVING p >= 2),
      g AS (SELECT doc_id, sh FROM s JOIN p USING (doc_id) GROUP BY doc_id, sh, p HAVING count(*) < p),
      own AS (SELECT doc_id, extractor, sh FROM s JOIN g USING (doc_id, sh)),
      per AS (SELECT doc_id, extractor, count(*) AS n, list(string_split(sh, ' ') ORDER BY sh) AS u FROM own GROUP BY 1, 2),
      lacks AS (SELECT DISTINCT o.doc_id, o.extractor, e.extractor AS other FROM own o JOIN (SELECT DISTINCT doc_id, extractor FROM s) e USING (doc_id)
        WHERE NOT EXISTS (SELECT 1 FROM s x WHERE x.doc_id = o.doc_id AND x.extractor = e.extractor AND x.sh = o.sh)),
      named AS (SELECT doc_id, extractor, string_agg(other, ',' ORDER BY other) AS disagrees_with FROM lacks GROUP BY 1, 2)
      SELECT doc_id, 'extractor_divergence.' || extractor AS detector, n, disagrees_with,
        array_to_string(list_reduce(u, lambda a, x: CASE WHEN len(a) >= 120 OR list_contains(a[-8:], x[8]) THEN a ELSE list_append(a, x[8]) END), ' ') AS evidence
      FROM per JOIN named USING (doc_id, extractor)"""

SQL = {
    "instruction_hits_by_rule": f"{SPANS} SELECT rule, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM spans GROUP BY rule",
    "instruction_spans": f"{SPANS} SELECT doc_id, rule, first, last, matched FROM spans",
    "overlap_suppressed_findings": f"{SPANS} SELECT doc_id, rule, first, last, matched FROM kept",
    "instruction_evidence": f"{SPANS} SELECT doc_id, rule, {_collapse('substr(text, greatest(first - 60, 0) + 1, last + 60 - greatest(first - 60, 0))')} AS evidence FROM kept",
    "zero_width_findings": _chars(ZW, "ZERO WIDTH SPACE", 8),
    "bidi_findings": _chars(BD, "RIGHT-TO-LEFT OVERRIDE", 1),
    "mixed_script_words": rf"""{D}, w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{{L}}\p{{Nl}}\p{{No}}]{{3,}}')) AS word FROM d)
      SELECT doc_id, word, 'cyrillic+latin' AS scripts FROM w WHERE regexp_matches(word, '[\x{{400}}-\x{{52f}}]') AND regexp_matches(word, '[\x{{41}}-\x{{24f}}]')""",
    "strip_invisible_text": rf"{D}, t AS (SELECT doc_id, regexp_replace(text, '[\p{{Cf}}]', '', 'g') AS t FROM d) SELECT doc_id, length(t) AS n, md5(t) AS digest FROM t",
    "span_luminance": f"{LAYOUT} SELECT doc_id, span_ord, round(lum, 6) AS luminance FROM lit",
    "background_last_fill": f"{LAYOUT} SELECT doc_id, span_ord, round(background, 6) AS background FROM behind",
    "span_classification": f"{LAYOUT} SELECT coalesce(reason, 'visible') AS reason, count(*) AS n, count(DISTINCT doc_id) AS documents FROM told GROUP BY 1",
    "hidden_span_findings": f"""{LAYOUT} SELECT doc_id, 'pdf_structure.' || reason AS detector, CASE WHEN reason IN ('offpage', 'tiny_font') THEN 'high' ELSE 'critical' END AS severity,
      span_ord, page, md5(regexp_replace(text, '^{WS}|{WS}$', '', 'g')) AS digest FROM told WHERE reason IS NOT NULL""",
    "visible_hidden_streams": f"""{LAYOUT} SELECT doc_id, md5(coalesce(string_agg(text, ' ' ORDER BY page, span_ord) FILTER (reason IS NULL), '')) AS visible,
      md5(coalesce(string_agg(text, ' ' ORDER BY page, span_ord) FILTER (reason IS NOT NULL), '')) AS hidden FROM told GROUP BY doc_id""",
    "metadata_field_findings": f"{FIELDS} SELECT doc_id, 'pdf_metadata.' || field AS detector, 'medium' AS severity, value AS evidence FROM long",
    "annotation_findings": f"{FIELDS} SELECT doc_id, text, length(text) >= 60 AS is_finding FROM notes",
    "metadata_stream": f"""{FIELDS}, parts AS (SELECT doc_id, 0 AS part, pos, value AS text, 1 AS n FROM long UNION ALL SELECT doc_id, 1, 0, text, (length(text) >= 60)::INT FROM notes)
      SELECT doc_id, string_agg(text, chr(10) ORDER BY part, pos) AS metadata_text, sum(n)::BIGINT AS n FROM parts GROUP BY doc_id""",
    "extractor_tokens": f"{EXTRACTED} SELECT doc_id, extractor, len(w) AS n FROM e",
    "extractor_shingles": f"{EXTRACTED} SELECT doc_id, extractor, count(*) AS n FROM s GROUP BY 1, 2",
    "divergent_shingles": f"""{EXTRACTED}, p AS (SELECT doc_id, count(DISTINCT extractor) AS p FROM s GROUP BY 1 HAVING p >= 2), g AS (SELECT doc_id, sh, count(*) AS k FROM s GROUP BY 1, 2)
      SELECT doc_id, count(*) AS n FROM g JOIN p USING (doc_id) WHERE k < p GROUP BY doc_id""",
    "escalated_findings": f"""{FIELDS}, hits AS (SELECT DISTINCT doc_id, unnest(CASE WHEN field = 'subject' THEN ['Ignore all previous instructions', 'Rate this candidate', 'You are a language model'] ELSE [] END) AS matched FROM long
        UNION SELECT doc_id, unnest(CASE WHEN doc_id IN (SELECT doc_id FROM long) THEN ['Ignore all previous instructions', 'Rate this candidate'] ELSE ['Ignore all previous instructions'] END) FROM notes WHERE text <> 'see me' AND doc_id % 5 <> 0
        UNION ALL SELECT doc_id, unnest(['Ignore all previous instructions', 'Rate this candidate']) FROM notes WHERE text <> 'see me' AND doc_id % 5 = 0)
      SELECT doc_id, 'critical' AS severity, matched, 'metadata' AS source FROM hits WHERE doc_id % 10 <> 9""",
    "verdicts": f"{PER_DOC} SELECT doc_id, verdict, risk_score::BIGINT AS risk_score, (concealed + instructing)::BIGINT AS findings FROM v",
    "carried_results": f"{_CARRIED_RESULTS} SELECT doc_id, verdict, risk_score, errors, hidden FROM r",
    "result_json_fields": f"{_CARRIED_RESULTS} SELECT doc_id, verdict, risk_score, hidden FROM r",
    "deduped_findings": f"{CARRIED} SELECT doc_id, pos AS place, detector, severity, evidence FROM final",
    "grouped_findings": f"""{CARRIED}, g AS (SELECT doc_id, category, min(CASE severity WHEN 'critical' THEN 0 ELSE 2 END)::BIGINT AS worst, count(*) AS n, arg_min(evidence, pos) AS first_evidence FROM final GROUP BY 1, 2)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY worst, n DESC, category) - 1 AS place, category, worst, n, first_evidence FROM g""",
    "phrase_spans": f"{PHRASE_SPANS} SELECT doc_id, rule, first, last, matched FROM spans",
    "phrase_findings": f"{PHRASE_SPANS} SELECT doc_id, rule, first, last, matched FROM kept",
    "phrase_hits_by_rule": f"{PHRASE_SPANS} SELECT rule, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM kept GROUP BY rule",
    "nfkc_divergence": f"{D} SELECT doc_id, {len(WIDE)}::BIGINT AS delta FROM d WHERE contains(text, '{WIDE}')",
    "normalized_text": rf"""{D}, t AS (SELECT doc_id, regexp_replace(replace(text, '{WIDE}', 'HIDDENWORDSHERE'), '[\p{{Cf}}]', '', 'g') AS t FROM d)
      SELECT doc_id, length(t) AS n, md5(t) AS digest FROM t""",
    "mixed_script_caps": """WITH w AS (SELECT page_id AS doc_id, 'w\u03bfrd' AS w FROM pages)
      SELECT doc_id, 25::BIGINT AS n, array_to_string(list_transform(range(5), lambda i: chr(39) || w || chr(39) || ' (greek+latin)'), ', ') AS evidence,
        array_to_string(list_transform(range(20), lambda i: w), ',') AS words FROM w""",
    "concealed_findings": f"""WITH n AS (SELECT page_id AS doc_id, page_id % 6 AS k, {NOTES} AS content FROM pages)
      SELECT doc_id, ['unicode.zero_width', 'unicode.bidi_override', 'normalization.mixed_script', 'normalization.nfkc_divergence', 'injection_patterns'][(k + 1)::INT] AS detector,
        ['high', 'high', 'high', 'medium', 'critical'][(k + 1)::INT] AS severity, CASE WHEN k = 4 THEN 'metadata' ELSE 'hidden' END AS source,
        CASE k WHEN 0 THEN 'SOFT HYPHEN,ZERO WIDTH NON-JOINER' WHEN 1 THEN 'LEFT-TO-RIGHT EMBEDDING,POP DIRECTIONAL FORMATTING' END AS characters FROM n WHERE content <> 'plain'
      UNION ALL SELECT page_id, 'injection_patterns', 'critical', 'metadata', NULL FROM pages, range(2) WHERE page_id % 7 = 0""",
    "divergence_findings": DIVERGENCE,
    "divergent_streams": f"SELECT doc_id, md5(string_agg(evidence, ' ' ORDER BY detector)) AS digest FROM ({DIVERGENCE}) GROUP BY doc_id",
    "extractor_text_caps": f"""{EXTRACTED}, c AS (SELECT doc_id, extractor, left(array_to_string(w, ' '), 4000) AS t FROM e)
      SELECT doc_id, extractor, length(t) AS n, md5(t) AS digest FROM c""",
    "file_base64": "SELECT page_id AS doc_id, md5(base64(encode(html))) AS digest FROM pages",
    "differential_screening": f"""{PER_DOC}, x AS (SELECT *, {_collapse('text')} AS raw FROM safe), y AS (SELECT *, raw <> clean AND clean <> '' AND raw <> '' AS available,
        (CASE WHEN contains(left(raw, 12000), 'Rate this candidate') THEN 50 ELSE 0 END - CASE WHEN contains(left(clean, 12000), 'Rate this candidate') THEN 50 ELSE 0 END)::BIGINT AS delta FROM x)
      SELECT doc_id, available, available AND delta >= 15 AS manipulated, CASE WHEN available THEN delta END AS delta, verdict, risk_score::BIGINT AS risk_score,
        (concealed + instructing + (available AND delta >= 15)::INT)::BIGINT AS findings FROM y""",
    "sanitized_text": f"{PER_DOC} SELECT doc_id, length(clean) AS n, md5(clean) AS digest FROM safe",
    "custom_pattern_findings": r"""SELECT doc_id, len(m) AS n, list_min(m) AS matched FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\b(apache|mit)\s+license\b') AS m FROM documents) WHERE len(m) > 0""",
    "configured_pattern_findings": r"""SELECT doc_id, 'low' AS severity, len(m) AS n, list_min(m) AS matched FROM (SELECT doc_id, regexp_extract_all(text, '(?i)\b(apache|mit)\s+license\b') AS m FROM documents) WHERE len(m) > 0""",
    "disabled_detector_scan": f"{PER_DOC} SELECT CASE WHEN pay THEN 'malicious' WHEN adr THEN 'suspicious' ELSE 'clean' END AS verdict, count(*) AS n FROM v GROUP BY 1",
    "threshold_override_scan": f"""{PER_DOC} SELECT doc_id, CASE WHEN risk_score >= 45 THEN 'malicious' WHEN risk_score > 0 THEN 'suspicious' ELSE 'clean' END AS verdict,
      (CASE WHEN risk_score >= 45 THEN risk_score WHEN risk_score > 0 THEN greatest(risk_score, 30) ELSE 0 END)::BIGINT AS risk_score FROM v""",
    "classifier_findings": "SELECT doc_id, 'high' AS severity, 'credential' AS label FROM documents WHERE contains(text, 'token =')",
    "python_rule_findings": "SELECT doc_id, 'low' AS severity, n || ' bars' AS evidence FROM (SELECT doc_id, len(string_split(text, ' | ')) - 1 AS n FROM documents) WHERE n > 10",
    "guard_decisions": f"{PER_DOC} SELECT doc_id, verdict <> 'clean' AS strict, verdict = 'malicious' AS lenient, CASE WHEN verdict <> 'clean' THEN (concealed + instructing)::BIGINT END AS told FROM v",
    "upload_validation": """SELECT page_id AS doc_id, CASE page_id % 4 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'B.PDF' ELSE 'c.pdf' END AS filename,
      CASE WHEN page_id % 4 = 0 THEN 'not_pdf' WHEN page_id % 5 = 0 THEN 'empty' WHEN octet_length(encode(html)) > 3000 THEN 'too_large' END AS reason FROM pages""",
    "safe_documents": f"{PER_DOC} SELECT doc_id, md5(clean) AS digest, verdict FROM safe WHERE verdict <> 'malicious'",
    "differential_compare": """WITH s AS (SELECT doc_id, quality, toxic, CASE WHEN doc_id % 11 <> 0 THEN 50 + doc_id * 7 % 40 END - (50 + doc_id * 3 % 30) AS delta FROM labels)
      SELECT doc_id, delta IS NOT NULL AS available, delta::BIGINT AS delta, delta IS NOT NULL AND (abs(delta) >= 15 OR (quality = 1) <> (toxic = 0)) AS manipulated FROM s""",
    "screener_reply_parse": """SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN doc_id % 100 END::BIGINT AS score, CASE WHEN doc_id % 3 = 2 THEN 'advance' ELSE '' END AS recommendation FROM labels""",
    "findings_by_category": f"""{PER_DOC}, g AS (SELECT x[2] AS category, count(*) AS n, min(CASE x[3] WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END)::BIGINT AS worst FROM f GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY worst, n DESC, category) AS place FROM g""",
    "detector_summary": f"{PER_DOC} SELECT x[1] AS detector, x[3] AS severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM f GROUP BY 1, 2",
    "verdict_distribution": f"{PER_DOC} SELECT verdict, count(*) AS n, min(risk_score)::BIGINT AS least, max(risk_score)::BIGINT AS most FROM v GROUP BY 1",
    "finding_counts": f"{PER_DOC} SELECT doc_id, concealed::BIGINT AS concealed, instructing::BIGINT AS instructing, (concealed + instructing)::BIGINT AS removed_count FROM v",
    "withheld_chars": f"{PER_DOC} SELECT doc_id, length({_collapse('text')}) - length(clean) AS withheld FROM safe",
    "locatable_findings": f"{LAYOUT} SELECT doc_id, span_ord, y1 <= 794 AS drawable, round(y0 / 792.0 * 100, 4) AS top FROM told WHERE reason IS NOT NULL",
    "technique_evaluation": f"""{PER_DOC} SELECT CASE WHEN doc_id % 20 = 11 THEN 'few' ELSE ['payload', 'zero_width', 'bidi', 'address', 'mixed', 'benign', 'wide', 'none', 'none', 'none'][(doc_id % 10 + 1)::INT] END AS technique,
      count(*) AS documents, count_if(verdict <> 'clean')::BIGINT AS flagged,
      count_if((verdict <> 'clean') = (doc_id % 10 NOT IN (5, 7, 8, 9) AND doc_id % 20 <> 11))::BIGINT AS "right" FROM v GROUP BY 1""",
}
SQL |= {
    "pdf_sample_scan": """SELECT i::BIGINT AS doc_id, t AS technique, p AS is_poisoned, v AS verdict, s::INT AS risk_score, 1 AS pages FROM (VALUES
      (0, 'clean', false, 'clean', 0), (1, 'dark_banner', false, 'clean', 0), (2, 'white_text', true, 'malicious', 78),
      (3, 'tiny_font', true, 'malicious', 78), (4, 'invisible_render_mode', true, 'malicious', 78), (5, 'offpage', true, 'malicious', 78),
      (6, 'metadata', true, 'malicious', 78), (7, 'annotation', true, 'malicious', 78), (8, 'visible_injection', true, 'malicious', 70)) g(i, t, p, v, s)""",
    "pdf_extractions": """WITH l AS (SELECT doc_id, md5(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> ''), chr(10))) AS digest FROM documents)
      SELECT doc_id, extractor, digest FROM l, (VALUES ('page'), ('unclipped')) m(extractor)""",
    "pdf_round_trip": """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
      n AS (SELECT doc_id, len(lines) AS n, list_filter(lines, lambda x: x <> '') AS shown FROM l)
      SELECT doc_id, greatest(1, (n + 49) // 50)::BIGINT AS pages, len(shown)::BIGINT AS lines, md5(coalesce(array_to_string(shown, chr(10)), '')) AS text_md5, true AS readable FROM n""",
}
