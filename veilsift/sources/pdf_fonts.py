"""Fonts of PDF files: from the bytes of a shown string to characters and widths."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from .pdf_objects import Name, PdfFile, Stream, Syntax, Word

UNKNOWN = "�"
_USUAL_WIDTH = 0.556

# Advance widths of the characters 32..126 in two of the standard fonts.
_SANS = (
    "278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556 "
    "1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556 "
    "333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584"
)
_SERIF = (
    "250 333 408 500 500 833 778 180 333 333 500 564 250 333 250 278 500 500 500 500 500 500 500 500 500 500 278 278 564 564 564 444 "
    "921 722 667 667 722 611 556 722 722 333 389 722 611 889 722 722 556 722 667 556 611 722 722 944 722 722 611 333 278 333 469 500 "
    "333 444 500 444 500 444 333 500 500 278 278 500 278 778 500 500 500 500 333 389 278 500 500 722 500 500 444 480 200 480 541"
)

# Glyph names that are neither a letter nor a letter with an accent.
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&",
    "quotesingle": "'", "parenleft": "(", "parenright": ")", "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-",
    "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">",
    "question": "?", "at": "@", "bracketleft": "[", "backslash": "\\", "bracketright": "]", "asciicircum": "^",
    "underscore": "_", "grave": "`", "braceleft": "{", "bar": "|", "braceright": "}", "asciitilde": "~", "quoteleft": "‘",
    "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "endash": "–",
    "emdash": "—", "bullet": "•", "ellipsis": "…", "fi": "fi", "fl": "fl", "ff": "ff", "ffi": "ffi", "ffl": "ffl",
    "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "dotlessi": "ı",
    "exclamdown": "¡", "questiondown": "¿", "cent": "¢", "sterling": "£", "yen": "¥", "Euro": "€", "section": "§",
    "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "periodcentered": "·", "guillemotleft": "«",
    "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "paragraph": "¶", "dagger": "†", "daggerdbl": "‡",
    "multiply": "×", "divide": "÷", "plusminus": "±", "minus": "−", "nbspace": "\xa0", "nonbreakingspace": "\xa0",
    "sfthyphen": "\xad", "softhyphen": "\xad", "mu": "µ", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ",
}
_ACCENTS = {
    "acute": "ACUTE", "grave": "GRAVE", "circumflex": "CIRCUMFLEX", "dieresis": "DIAERESIS", "tilde": "TILDE", "ring": "RING ABOVE",
    "cedilla": "CEDILLA", "caron": "CARON", "macron": "MACRON", "breve": "BREVE", "ogonek": "OGONEK", "dotaccent": "DOT ABOVE",
    "hungarumlaut": "DOUBLE ACUTE",
}
_HEX_NAME = re.compile(r"(?:uni((?:[0-9A-F]{4})+)|u([0-9A-F]{4,6}))$")


def glyph(name: str) -> str:
    """The characters of a glyph name."""
    base = name.split(".")[0]
    if base in _GLYPHS or len(base) == 1:
        return _GLYPHS.get(base, base)
    if found := _HEX_NAME.match(base):
        digits, step = (found[1], 4) if found[1] else (found[2], 6)
        codes = [int(digits[i : i + step], 16) for i in range(0, len(digits), step)]
        return "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000) or UNKNOWN
    if base[1:] in _ACCENTS:
        case = "CAPITAL" if base[0].isupper() else "SMALL"
        try:
            return unicodedata.lookup(f"LATIN {case} LETTER {base[0].upper()} WITH {_ACCENTS[base[1:]]}")
        except KeyError:
            pass
    return UNKNOWN


def _units(raw: bytes) -> str:
    """UTF-16 code units, halves of pairs kept; pairs are joined once a run is whole."""
    return raw.decode("utf-16-be", "surrogatepass") if len(raw) % 2 == 0 else raw.decode("latin-1")


@dataclass
class CharacterMap:
    """Ranges ``(bytes of a code, first, last, text of the first or texts)`` and the code lengths."""

    single: dict[tuple[int, int], str]
    ranges: list[tuple[int, int, int, object]]
    spaces: list[tuple[int, int, int]]

    def text(self, size: int, code: int) -> str | None:
        found = self.single.get((size, code))
        if found is not None:
            return found
        for n, low, high, to in self.ranges:
            if n == size and low <= code <= high:
                if isinstance(to, list):
                    return _units(to[code - low]) if code - low < len(to) and isinstance(to[code - low], bytes) else None
                return _units((int.from_bytes(to) + code - low).to_bytes(max(len(to), 1) + 1)[1:])
        return None


def character_map(data: bytes) -> CharacterMap:
    out = CharacterMap({}, [], [])
    syntax, held = Syntax(data), []
    while (v := syntax.value()) is not syntax.END:
        if not isinstance(v, Word):
            held.append(v)
            continue
        if v == "endcodespacerange":
            pairs = [(a, b) for a, b in zip(held[::2], held[1::2]) if isinstance(a, bytes) and isinstance(b, bytes)]
            out.spaces += [(len(a), int.from_bytes(a), int.from_bytes(b)) for a, b in pairs]
        elif v == "endbfchar":
            for a, b in zip(held[::2], held[1::2]):
                if isinstance(a, bytes):
                    out.single[len(a), int.from_bytes(a)] = _units(b) if isinstance(b, bytes) else glyph(str(b))
        elif v == "endbfrange":
            for a, b, to in zip(held[::3], held[1::3], held[2::3]):
                if isinstance(a, bytes) and isinstance(b, bytes) and isinstance(to, (bytes, list)):
                    out.ranges.append((len(a), int.from_bytes(a), int.from_bytes(b), to))
        held = []
    return out


class Font:
    """``glyphs(raw)`` gives ``(text, advance in text space, whether word spacing applies)``."""

    def __init__(self, file: PdfFile, info: dict):
        get = file.get
        self.file, self.info = file, info
        self.composite = get(info.get("Subtype")) == "Type0"
        child = file.array(info.get("DescendantFonts"))
        self.child = file.dictionary(child[0]) if self.composite and child else info
        self.name = str(get(info.get("BaseFont")) or get(info.get("Name")) or "")
        about = file.dictionary(self.child.get("FontDescriptor"))
        up, down = (get(about.get(k)) for k in ("Ascent", "Descent"))
        self.ascent = up / 1000 if isinstance(up, (int, float)) and 0 < up <= 2000 else 0.8
        self.descent = down / 1000 if isinstance(down, (int, float)) and -2000 <= down < 0 else -0.2
        stream = get(info.get("ToUnicode"))
        self.map = character_map(stream.data()) if isinstance(stream, Stream) else None
        matrix = file.numbers(info.get("FontMatrix"), 6)
        self.scale = matrix[0] if matrix and get(info.get("Subtype")) == "Type3" else 0.001
        self.known: dict[tuple[int, int], tuple[str, float, bool]] = {}
        self.table: list[tuple[str, float, bool]] = []
        self._composite_widths(get, about) if self.composite else self._simple(get, about)

    def _simple(self, get, about: dict) -> None:
        encoding = get(self.info.get("Encoding"))
        base = get(encoding.get("BaseEncoding")) if isinstance(encoding, dict) else encoding
        codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
        self.texts = [bytes([i]).decode(codec, "replace") for i in range(256)]
        if base is None and "Symbol" not in self.name:
            self.texts[0x27], self.texts[0x60] = ("’", "‘") if about and get(about.get("Flags")) == 32 else ("'", "`")
        at = 0
        for item in self.file.array(encoding.get("Differences")) if isinstance(encoding, dict) else ():
            item = get(item)
            if isinstance(item, Name):
                if 0 <= at < 256:
                    self.texts[at] = glyph(item)
                at += 1
            elif isinstance(item, int):
                at = item
        missing = get(about.get("MissingWidth"))
        plain = _SERIF if "Times" in self.name else _SANS
        fallback = 0.6 if "Courier" in self.name else _USUAL_WIDTH
        self.widths = [missing * self.scale if isinstance(missing, (int, float)) and missing else fallback] * 256
        if "Courier" not in self.name:
            self.widths[32:127] = [int(w) / 1000 for w in plain.split()]
        first = get(self.info.get("FirstChar"))
        for i, w in enumerate(self.file.array(self.info.get("Widths"))):
            w, code = get(w), i + (first if isinstance(first, int) else 0)
            if 0 <= code < 256 and isinstance(w, (int, float)):
                self.widths[code] = w * self.scale

    def _composite_widths(self, get, about: dict) -> None:
        usual = get(self.child.get("DW"))
        self.usual = usual / 1000 if isinstance(usual, (int, float)) else 1.0
        self.by_code: dict[int, float] = {}
        self.spans: list[tuple[int, int, float]] = []
        items = [get(x) for x in self.file.array(self.child.get("W"))]
        at = 0
        while at + 1 < len(items):
            first, second = items[at], items[at + 1]
            if isinstance(first, int) and isinstance(second, list):
                widths = [get(w) for w in second]
                self.by_code.update({first + i: w / 1000 for i, w in enumerate(widths) if isinstance(w, (int, float))})
                at += 2
            elif at + 2 < len(items) and all(isinstance(x, (int, float)) for x in items[at : at + 3]):
                self.spans.append((first, second, items[at + 2] / 1000))
                at += 3
            else:
                at += 1
        encoding = get(self.info.get("Encoding"))
        self.coding = character_map(encoding.data()) if isinstance(encoding, Stream) else None
        self.unicode_codes = isinstance(encoding, Name) and ("UCS2" in encoding or "UTF16" in encoding)

    def _code(self, raw: bytes, at: int) -> int:
        """Bytes of the code of a composite font at ``at``."""
        for n, low, high in self.coding.spaces if self.coding else ():
            if low <= int.from_bytes(raw[at : at + n]) <= high and len(raw) - at >= n:
                return n
        return 2

    def glyphs(self, raw: bytes) -> list[tuple[str, float, bool]]:
        if not self.composite:
            if not self.table:
                self.table = [self._glyph(1, c) for c in range(256)]
            return [self.table[c] for c in raw]
        out, at, known = [], 0, self.known
        while at < len(raw):
            n = self._code(raw, at)
            code = int.from_bytes(raw[at : at + n])
            found = known.get((n, code))
            if found is None:
                found = known[n, code] = self._glyph(n, code)
            out.append(found)
            at += n
        return out

    def _glyph(self, n: int, code: int) -> tuple[str, float, bool]:
        text = self.map.text(n, code) if self.map else None
        if not self.composite:
            return self.texts[code] if text is None else text, self.widths[code], code == 32
        width = self.by_code.get(code)
        if width is None:
            width = next((w for low, high, w in self.spans if low <= code <= high), self.usual)
        if text is None:
            text = chr(code) if self.unicode_codes and n == 2 else UNKNOWN
        return text, width, n == 1 and code == 32
