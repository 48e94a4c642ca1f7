"""All matches of ordered rules, with offsets, overlaps suppressed.

Spark finds all matches of a pattern but not their places.  Anchoring each match to the
end of the one before (``\\G``) and capturing the gap between gives them: a match starts
where the gaps and matches before it end.  Texts of ASCII alone stay in the JVM; others
go through Arrow to Python's ``re``, whose word characters are the standard here.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache
from re import _constants as sre
from re import _parser as sre_parser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import is_blank

SPAN = "struct<rule:int,start:int,end:int,matched:string>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"


def java_pattern(pattern: str) -> str:
    """The pattern for ASCII texts: Python's white space, Unicode-aware case folding."""
    return "(?iu)" + pattern.replace("\\s", "[\\t-\\r\\x1c-\\x20]")


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def needed_words(pattern: str) -> list[frozenset[str]]:
    """Sets of lower-case ASCII strings; every match, folded, holds a string of each of them.

    A set stands for a run of parts that a match must pass through, white space at its ends
    included; of an alternative that is no such run its most telling part counts.  Sets with strings of
    one character tell too little and are left out.
    """

    def times(run: set[str], one: set[str] | None) -> set[str] | None:
        return {a + b for a in run for b in one} if one is not None and len(run) * len(one) <= 64 else None

    def least(words: set[str]) -> int:
        return min(map(len, words))

    def whole(nodes) -> set[str] | None:
        """All strings that the nodes match, if those are few."""
        out: set[str] | None = {""}
        for op, arg in nodes:
            one = None
            if op is sre.LITERAL:
                one = {chr(arg).lower()}
            elif op is sre.SUBPATTERN:
                one = whole(arg[-1])
            elif op is sre.BRANCH:
                each = [whole(b) for b in arg[1]]
                one = None if None in each else set().union(*each)
            elif op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
                one = {chr(c).lower() for _, c in arg}
            elif op is sre.AT:
                one = {""}
            out = times(out, one)
            if out is None:
                return None
        return out

    def spaces(op, arg) -> bool:
        return op is sre.MAX_REPEAT and arg[0] > 0 and list(arg[2]) == [(sre.IN, [(sre.CATEGORY, sre.CATEGORY_SPACE)])]

    def runs(nodes, run: set[str]) -> list[set[str]]:
        out = []
        for op, arg in nodes:
            one = whole([(op, arg)])
            longer = times(run, one)
            if longer is not None:
                run = longer
            elif spaces(op, arg):
                out.append({r + " " for r in run})
                run = {" "}
            elif op is sre.SUBPATTERN:
                *before, run = runs(arg[-1], run)
                out += before
            elif op is sre.BRANCH:  # each alternative goes on from here
                out.append(set().union(*(max(runs(b, run), key=least) for b in arg[1])))
                run = {""}
            else:
                out.append(run)
                run = one or {""}
        return [*out, run]

    found = {frozenset(r) for r in runs(sre_parser.parse(pattern), {""}) if least(r) > 1 and all(w.isascii() for w in r)}
    return sorted(found, key=lambda words: (len(words), sorted(words)))


#: Characters beyond ASCII that Python's matching takes for ASCII letters when it ignores case.
LIKE_ASCII = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
FOLDS = LIKE_ASCII | {c: " " for c in map(chr, range(0x3001)) if c.isspace()}


# The expressions below are SQL text: built from columns, ten rules would take the driver tens of
# thousands of calls into the JVM, and longer than the data.


def folded(text: str) -> str:
    """Lower case, with spaces for white space: the needed words of a possible match can be looked up."""
    rare = " or ".join(f"contains({text}, {sql_text(c)})" for c in FOLDS if c not in "\n\t ")
    whole = f"translate({text}, {sql_text(''.join(FOLDS))}, {sql_text(''.join(FOLDS.values()))})"
    spaced = f"replace(replace({text}, '\\n', ' '), '\\t', ' ')"
    return f"lower(case when {rare} then {whole} else {spaced} end)"


def may_match(low: str, pattern: str) -> str:
    """Whether a folded text holds what the pattern needs; a plain search rules most texts out."""
    each = [" or ".join(f"contains({low}, {sql_text(w)})" for w in sorted(words)) for words in needed_words(pattern)]
    return " and ".join(f"({one})" for one in each) or "true"


def _native(text: str, low: str, patterns: Sequence[str]) -> str:
    """Spans of all rules in a text of ASCII: a match lies behind the gaps and matches before it."""
    found = []
    for rule, pattern in enumerate(patterns):
        regex = sql_text(f"\\G(?s:(.*?))({java_pattern(pattern)})")
        pairs = (
            f"zip_with(regexp_extract_all({text}, {regex}, 1), regexp_extract_all({text}, {regex}, 2),"
            " (g, m) -> struct(char_length(g) as gap, m as m))"
        )
        step = (
            "struct(acc.at + p.gap + char_length(p.m) as at, concat(acc.spans, array(named_struct("
            f"'rule', {rule}, 'start', acc.at + p.gap, 'end', acc.at + p.gap + char_length(p.m), 'matched', p.m))) as spans)"
        )
        spans = f"aggregate({pairs}, struct(0 as at, {NO_SPANS} as spans), (acc, p) -> {step}, acc -> acc.spans)"
        found.append(f"case when {may_match(low, pattern)} then {spans} else {NO_SPANS} end")
    return f"concat({', '.join(found)})" if found else NO_SPANS


@lru_cache(maxsize=64)
def _compiled(patterns: tuple[str, ...]) -> list[re.Pattern]:
    return [re.compile(p, re.IGNORECASE) for p in patterns]


def _arrow(text: Column, patterns: Sequence[str]) -> Column:
    fixed = tuple(patterns)

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(texts: pd.Series) -> pd.Series:
        rules = [(i, rule, needed_words(rule.pattern)) for i, rule in enumerate(_compiled(fixed))]
        same = str.maketrans(FOLDS)

        def one(t: str | None) -> list | None:
            if t is None:
                return None
            low = t.translate(same).lower()
            return [
                {"rule": i, "start": m.start(), "end": m.end(), "matched": m.group(0)}
                for i, rule, needed in rules
                if all(any(w in low for w in words) for words in needed)
                for m in rule.finditer(t)
            ]

        return texts.map(one)

    return spans(text)


def rule_spans(text: str, patterns: Sequence[str], suppress: bool = True) -> Column:
    """``array<struct<rule, start, end, matched>>`` of the column ``text``; blank texts have none.

    With ``suppress`` earlier rules come first: a span that overlaps an accepted one falls.
    """
    name = f"coalesce({text}, '')"
    beyond = f"octet_length({name}) <> char_length({name})"
    possible = " or ".join(f"({may_match('low', p)})" for p in patterns) or "false"
    # Only texts beyond ASCII that may match travel; a null costs nothing to send.
    sent = F.expr(f"case when {beyond} and transform(array({folded(name)}), low -> {possible})[0] then {name} end")
    native = F.expr(f"transform(array({folded(name)}), low -> {_native(name, 'low', patterns)})[0]")
    none = F.expr(NO_SPANS)
    spans = F.when(F.expr(beyond), F.coalesce(_arrow(sent, patterns), none)).otherwise(native)
    if suppress:
        spans = F.aggregate(
            spans,
            none,
            lambda kept, x: F.when(F.exists(kept, lambda y: (x["start"] < y["end"]) & (x["end"] > y["start"])), kept).otherwise(F.concat(kept, F.array(x))),
        )
    return F.when(is_blank(F.col(text)), none).otherwise(spans)
