"""Text columns: white space, invisible characters, contexts.

Java's ``\\s`` and ``trim`` differ from Unicode white space, so the class is spelled out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, are invisible, or turn direction.
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
WS_BUT_SPACE = WS.replace("\\x1c-\\x20", "\\x1c-\\x1f")
ZERO_WIDTH = {
    "​": "ZERO WIDTH SPACE",
    "‌": "ZERO WIDTH NON-JOINER",
    "‍": "ZERO WIDTH JOINER",
    "⁠": "WORD JOINER",
    "﻿": "ZERO WIDTH NO-BREAK SPACE",
    "­": "SOFT HYPHEN",
}
BIDI = {
    "‪": "LEFT-TO-RIGHT EMBEDDING",
    "‫": "RIGHT-TO-LEFT EMBEDDING",
    "‬": "POP DIRECTIONAL FORMATTING",
    "‭": "LEFT-TO-RIGHT OVERRIDE",
    "‮": "RIGHT-TO-LEFT OVERRIDE",
    "⁦": "LEFT-TO-RIGHT ISOLATE",
    "⁧": "RIGHT-TO-LEFT ISOLATE",
    "⁨": "FIRST STRONG ISOLATE",
    "⁩": "POP DIRECTIONAL ISOLATE",
}
#: Format characters, with those that Java 17's Unicode tables do not know yet.
FORMAT = "[\\p{Cf}\\x{890}\\x{891}\\x{13439}-\\x{1343F}]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often ``use`` names it.

    Inside a lambda a free expression would be evaluated for every element.
    """
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    # A lone space stays as it is, so it need not be replaced.
    return F.trim(F.regexp_replace(text, f"{WS}{{2,}}|{WS_BUT_SPACE}", " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


def is_blank(text: Column) -> Column:
    # A search for what is not white space ends at the first such character.
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{WS[1:]}")


def has_non_ascii(text: Column) -> Column:
    return F.octet_length(text) != F.char_length(text)


def strip_invisible(text: Column) -> Column:
    """``text`` without format characters; ASCII has none."""
    return F.when(has_non_ascii(text), F.regexp_replace(text, FORMAT, "")).otherwise(text)


def joined_nonempty(*texts: Column) -> Column:
    """The non-empty texts on lines of their own."""
    return F.concat_ws("\n", *(F.when(t != "", t) for t in texts))


def around(text: Column, start: Column, end: Column, window: int = 60) -> Column:
    """``window`` characters on either side of a 0-based span, collapsed."""
    low = F.greatest(start - window, F.lit(0))
    return collapse(F.substring(text, low + 1, end + window - low))


def holds_any(text: Column, chars: Iterable[str]) -> Column:
    """Whether a text holds one of the characters: searches for bytes, many times as fast as a class of a regex."""
    return reduce(or_, (text.contains(c) for c in chars))


def count_of(text: Column, chars: dict[str, str]) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, "".join(chars), ""))


def names_of(text: Column, chars: dict[str, str]) -> Column:
    """Sorted names of the characters that a text holds."""
    held = F.array(*(F.when(text.contains(c), F.lit(n)) for c, n in chars.items()))
    return F.array_sort(F.array_compact(held))


def first_of(text: Column, chars: dict[str, str]) -> Column:
    """0-based place of the first of the characters; meaningless if there is none."""
    chars_class = "".join(chars)
    return F.char_length(F.regexp_extract(text, f"^([^{chars_class}]*)[{chars_class}]", 1))
