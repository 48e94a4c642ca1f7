"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what
any match must contain.  Each batch of texts gets an inverted index from the
trigrams that some rule asks for to the texts that hold them; the postings are
intersected and united as the query says, and only the candidates are verified
with the expression.  A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

#: Most strings that an exact part of an expression may stand for.
MAX_EXACT = 64


@dataclass(frozen=True)
class SecretRule:
    """Leftmost non-overlapping matches; those with group ``group`` under ``least`` fall."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds, fixed by the contract.
BASE_RULES = (
    SecretRule(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", 0, 20),
    SecretRule("hex", r"[0-9a-f]+", 0, 24),
)

#: Parts of private key blocks: their label, escaped characters of a block kept as a string, header lines.
_KEY = r"(?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?"
_ESCAPED = r"\\+(?:[nrt/\"\r\n]|u00[0-9A-Fa-f]{2})"
_GAP = rf"(?:[\s\"'+,]|{_ESCAPED})*"
_HEADERS = rf"(?:{_GAP}(?:Version|Comment|MessageID|Hash|Charset|Proc-Type|DEK-Info): (?:[^\r\n\\-]|-(?!----)|\\+[/\"])*+)*+"

#: What this operator adds: published shapes of credentials.
ADDED_RULES = (
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("github", r"github_pat_[A-Za-z0-9_]{22,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    # The whole block; a block that is cut off goes as far as its lines do.
    SecretRule(
        "private_key",
        rf"-----BEGIN {_KEY}-----{_HEADERS}"
        rf"(?:(?:[A-Za-z0-9+/=,:\s\"']|{_ESCAPED}|-(?!----))*-----END {_KEY}-----|(?:{_GAP}(?:[A-Za-z0-9+/=]|\\+/){{16,}})*)",
    ),
    SecretRule("url_login", r"[a-z]{3,8}://[A-Za-z0-9._-]+:[A-Za-z0-9._~%-]{3,}@"),
)

#: A query is a conjunction of clauses; a clause is a disjunction of trigram sets.
Query = tuple[tuple[frozenset[str], ...], ...]


def trigram_query(pattern: str) -> Query:
    """Trigrams (A-Z in lower case) that every match must hold; () if there are none."""

    def trigrams(s: str) -> frozenset[str]:
        return frozenset(s[i : i + 3] for i in range(len(s) - 2))

    def clause_of(strings: set[str]) -> list:
        if not strings or min(map(len, strings)) < 3:
            return []
        return [tuple(sorted({trigrams(s) for s in strings}, key=sorted))]

    def exact(op, arg) -> set[str] | None:
        """The strings that a node stands for, if they are few."""
        if op is sre.LITERAL:
            return {chr(arg).lower() if arg < 128 else chr(arg)}
        if op is sre.IN:
            chars = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    chars.add(chr(value).lower())
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
                else:
                    return None
            return chars if len(chars) <= 8 else None
        if op is sre.SUBPATTERN:
            return exact_all(arg[-1])
        if op is sre.BRANCH:
            sets = [exact_all(b) for b in arg[1]]
            return set().union(*sets) if all(s is not None for s in sets) else None
        if op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            inner = exact_all(body)
            if inner is None or high is sre.MAXREPEAT or high > 3:
                return None
            out, power = set(), {""}
            for n in range(high + 1):
                if n >= low:
                    out |= power
                power = {a + b for a in power for b in inner}
            return out
        return {""} if op is sre.AT else None

    def exact_all(nodes) -> set[str] | None:
        out = {""}
        for op, arg in nodes:
            one = exact(op, arg)
            if one is None or len(out) * len(one) > MAX_EXACT:
                return None
            out = {a + b for a in out for b in one}
        return out

    def clauses(nodes) -> list:
        found, run = [], {""}
        for op, arg in nodes:
            one = exact(op, arg)
            if one is not None and len(run) * len(one) <= MAX_EXACT:
                run = {a + b for a in run for b in one}
                continue
            found += clause_of(run)
            run = one if one is not None and len(one) <= MAX_EXACT else {""}
            if one is None:
                if op is sre.SUBPATTERN:
                    found += clauses(arg[-1])
                elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] >= 1:
                    found += clauses(arg[2])
                elif op is sre.BRANCH:
                    each = [clauses(b) for b in arg[1]]
                    if all(each):
                        found.append(tuple(t for c in each for t in min(c, key=len)))
        return found + clause_of(run)

    return tuple(clauses(sre_parser.parse(pattern)))


class TrigramScanner:
    """The rules with their queries and the table from trigram codes to postings."""

    def __init__(self, rules: tuple[SecretRule, ...]):
        self.rules = rules
        self.compiled = [re.compile(r.pattern, re.ASCII) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        asked = sorted({t for q in self.queries for c in q for s in c for t in s})
        self.slot = {t: i + 1 for i, t in enumerate(asked)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.slot.items():
            b = t.encode("latin-1")
            self.table[b[0] << 16 | b[1] << 8 | b[2]] = i

    def candidates(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each rule, the indices of the texts that its query leaves."""
        holds = np.zeros((len(self.slot) + 1, len(texts)), bool)
        ends = np.cumsum([len(t) + 1 for t in texts])
        joined = np.frombuffer(b"\0".join(texts).lower() + b"\0\0", np.uint8).astype(np.int32)
        codes = joined[:-2] << 16
        codes |= joined[1:-1] << 8
        codes |= joined[2:]
        slots = self.table[codes]
        at = np.flatnonzero(slots)
        holds[slots[at], np.searchsorted(ends, at, side="right")] = True
        out = []
        for query in self.queries:
            keep = np.ones(len(texts), bool)
            for clause in query:
                any_of = np.zeros(len(texts), bool)
                for needed in clause:
                    any_of |= holds[[self.slot[t] for t in needed]].all(axis=0)
                keep &= any_of
            out.append(np.flatnonzero(keep))
        return out

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text the spans ``(start, rule index, end)`` in code points, sorted."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        decoded: dict[int, str] = {}
        for r, docs in enumerate(self.candidates(texts)):
            rule, find = self.rules[r], self.compiled[r].finditer
            for d in docs.tolist():
                text = decoded.get(d)
                if text is None:
                    text = decoded[d] = texts[d].decode()
                for m in find(text):
                    low, high = m.span(rule.group)
                    if high - low >= rule.least:
                        found[d].append((m.start(), r, m.end()))
        for spans in found:
            spans.sort()
        return found


@lru_cache(maxsize=4)
def scanner(rules: tuple[SecretRule, ...]) -> TrigramScanner:
    return TrigramScanner(_bounded(rules))


def _bounded(rules: tuple[SecretRule, ...]) -> tuple[SecretRule, ...]:
    """A lone repeated class can ask for its least length itself: shorter runs fall anyway."""
    out = []
    for r in rules:
        body = re.fullmatch(r"(\[[^\[\]\\^]+\])\+", r.pattern)
        if body and r.group == 0 and r.least > 1:
            r = SecretRule(r.kind, f"{body[1]}{{{r.least},}}", 0, r.least)
        out.append(r)
    return tuple(out)


def find_secrets(docs: DataFrame, added: tuple[SecretRule, ...] = ADDED_RULES) -> DataFrame:
    """Spans of the base kinds and of ``added`` in every whole text.

    Returns ``doc_id, n_assign, n_access, n_hex, base_sha256, spans``.  Null and empty
    texts have no spans (the hash is that of the empty string).  Null or repeated ids:
    a row per input row.  Ties in ``start`` go by the order of the kinds.  Other columns
    of ``docs`` are not read.
    """
    rules = BASE_RULES + tuple(added)
    base = len(BASE_RULES)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, hashes, joined = [[], [], []], [], []
        for spans in scanner(rules).scan(batch.column(1).to_pylist()):
            said = [(r, f"{rules[r].kind}:{a}:{b}") for a, r, b in spans]
            for k in range(base):
                counts[k].append(sum(r == k for r, _ in said))
            hashes.append(hashlib.sha256(",".join(s for r, s in said if r < base).encode()).hexdigest())
            joined.append(",".join(s for _, s in said))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes), pa.array(joined, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()), fn, schema)


def redact_secrets(docs: DataFrame, added: tuple[SecretRule, ...] = ADDED_RULES, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found span in ``text`` replaced by ``mark``.

    Overlapping spans are one.  A column ``n_chars``, if there is one, follows the new
    text.  Null texts stay null; all rows and other columns stay.
    """
    rules = BASE_RULES + tuple(added)
    at = docs.columns.index("text")
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(at).to_pylist()
        found = scanner(rules).scan([(t or "").encode() for t in texts])
        changed = False
        for i, spans in enumerate(found):
            if spans:
                changed, text, out, done = True, texts[i], [], 0
                for a, _, b in spans:
                    if a >= done:
                        out += [text[done:a], mark]
                    done = max(done, b)
                texts[i] = "".join(out) + text[done:]
        if not changed:
            return batch
        columns = list(batch.columns)
        columns[at] = pa.array(texts, batch.schema.field(at).type)
        if length_at is not None:
            old = columns[length_at].to_pylist()
            new = [len(texts[i]) if s else old[i] for i, s in enumerate(found)]
            columns[length_at] = pa.array(new, batch.schema.field(length_at).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return map_batches(docs, fn, docs.schema)
