"""What a PDF page paints: runs of text with their look and place, and filled shapes.

Places are points from the upper left corner of the page as it is shown.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace
from typing import Any

from .pdf_fonts import Font
from .pdf_objects import Name, PdfError, PdfFile, Stream, Syntax, Word

#: Operators and glyphs of one document; more is an error, as forms can multiply without end.
MAX_STEPS = 20_000_000
MAX_FORMS = 16
#: Gaps in ems: below the first, characters are of one word; below the second, of one run.
WORD_GAP, RUN_GAP = 0.2, 2.0
INVISIBLE = 3

Matrix = tuple[float, float, float, float, float, float]
IDENTITY: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def times(m: Matrix, n: Matrix) -> Matrix:
    """``m`` first, then ``n``."""
    return (
        m[0] * n[0] + m[1] * n[2],
        m[0] * n[1] + m[1] * n[3],
        m[2] * n[0] + m[3] * n[2],
        m[2] * n[1] + m[3] * n[3],
        m[4] * n[0] + m[5] * n[2] + n[4],
        m[4] * n[1] + m[5] * n[3] + n[5],
    )


def apply(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def box(points: list[tuple[float, float]]) -> tuple[float, float, float, float]:
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return min(xs), min(ys), max(xs), max(ys)


@dataclass
class Paint:
    """A colour, its alpha, and the number of components its space has."""

    rgb: tuple[float, float, float] | None = (0.0, 0.0, 0.0)
    alpha: float = 1.0
    subtractive: bool = False


@dataclass
class State:
    ctm: Matrix
    fill: Paint = field(default_factory=Paint)
    stroke: Paint = field(default_factory=Paint)
    font: Font | None = None
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    stretch: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Run:
    text: list[str]
    look: tuple
    start: tuple[float, float]
    end: tuple[float, float]
    direction: tuple[float, float]
    em: float
    corners: list[tuple[float, float]]


def color(values: list[float], subtractive: bool = False) -> tuple[float, float, float] | None:
    v = [min(1.0, max(0.0, float(x))) for x in values]
    if len(v) == 1:
        g = 1 - v[0] if subtractive else v[0]
        return g, g, g
    if len(v) == 3:
        return v[0], v[1], v[2]
    if len(v) == 4:
        r, g, b = ((1 - c) * (1 - v[3]) for c in v[:3])
        return r, g, b
    return None


class Painter:
    """Runs content streams of a page and collects ``spans`` and ``fills``."""

    def __init__(self, file: PdfFile, fonts: dict[int, Font], steps: list[int]):
        self.file, self.fonts, self.steps = file, fonts, steps
        self.spans: list[dict[str, Any]] = []
        self.fills: list[dict[str, Any]] = []
        self.run_now: Run | None = None

    def page(self, content: bytes, resources: dict, ctm: Matrix) -> None:
        self.content(content, resources, State(ctm), 0)
        self.flush()

    # -- content --------------------------------------------------------------

    def content(self, data: bytes, resources: dict, state: State, depth: int) -> None:
        syntax, stack, held = Syntax(data), [], []
        path: list[tuple[float, float]] = []
        text = line = IDENTITY
        while (v := syntax.value()) is not syntax.END:
            if not isinstance(v, Word):
                held.append(v)
                continue
            self.step(1)
            n, held = held, []
            try:
                if v == "q":
                    stack.append(replace(state, fill=replace(state.fill), stroke=replace(state.stroke)))
                elif v == "Q":
                    state = stack.pop() if stack else state
                elif v == "cm":
                    state.ctm = times(_matrix(n), state.ctm)
                elif v == "BT":
                    text = line = IDENTITY
                elif v in ("Td", "TD"):
                    if v == "TD":
                        state.leading = -n[1]
                    text = line = times((1, 0, 0, 1, n[0], n[1]), line)
                elif v == "Tm":
                    text = line = _matrix(n)
                elif v == "T*":
                    text = line = times((1, 0, 0, 1, 0, -state.leading), line)
                elif v == "Tj":
                    text = self.show([n[-1]], state, text)
                elif v == "TJ":
                    text = self.show(n[-1], state, text)
                elif v in ("'", '"'):
                    if v == '"':
                        state.word, state.char = n[0], n[1]
                    text = line = times((1, 0, 0, 1, 0, -state.leading), line)
                    text = self.show([n[-1]], state, text)
                elif v == "Tf":
                    state.font, state.size = self.font(resources, n[0]), float(n[1])
                elif v == "Tc":
                    state.char = float(n[0])
                elif v == "Tw":
                    state.word = float(n[0])
                elif v == "Tz":
                    state.stretch = n[0] / 100
                elif v == "TL":
                    state.leading = float(n[0])
                elif v == "Ts":
                    state.rise = float(n[0])
                elif v == "Tr":
                    state.mode = int(n[0])
                elif v in ("g", "rg", "k"):
                    state.fill = Paint(color(n), state.fill.alpha)
                elif v in ("G", "RG", "K"):
                    state.stroke = Paint(color(n), state.stroke.alpha)
                elif v in ("cs", "CS"):
                    self.space(resources, n[0], state.fill if v == "cs" else state.stroke)
                elif v in ("sc", "scn", "SC", "SCN"):
                    paint = state.fill if v[0] == "s" else state.stroke
                    paint.rgb = None if n and isinstance(n[-1], Name) else color(n, paint.subtractive)
                elif v == "gs":
                    self.graphics(self.resource(resources, "ExtGState", n[0]), state)
                elif v == "re":
                    x, y, w, h = map(float, n[:4])
                    path += [apply(state.ctm, *p) for p in ((x, y), (x + w, y), (x, y + h), (x + w, y + h))]
                elif v in ("m", "l", "c", "v", "y"):
                    path += [apply(state.ctm, float(n[i]), float(n[i + 1])) for i in range(0, len(n) - 1, 2)]
                elif v in ("f", "F", "f*", "B", "B*", "b", "b*"):
                    self.filled(path, state)
                    path = []
                elif v in ("n", "S", "s"):
                    path = []
                elif v == "Do":
                    self.form(resources, n[0], state, depth)
                elif v == "BI":
                    _skip_image(syntax)
            except (IndexError, TypeError, ValueError, OverflowError) as problem:
                if isinstance(problem, PdfError):
                    raise
                # Operands that make no sense: the operator does nothing, as in viewers.

    def step(self, n: int) -> None:
        self.steps[0] += n
        if self.steps[0] > MAX_STEPS:
            raise PdfError("a document with too many operations")

    def resource(self, resources: dict, kind: str, name: Any) -> Any:
        return self.file.get(self.file.dictionary(resources.get(kind)).get(str(name)))

    def font(self, resources: dict, name: Any) -> Font | None:
        info = self.resource(resources, "Font", name)
        if not isinstance(info, dict):
            return None
        if id(info) not in self.fonts:
            self.fonts[id(info)] = Font(self.file, info)
        return self.fonts[id(info)]

    def space(self, resources: dict, name: Any, paint: Paint) -> None:
        found = self.resource(resources, "ColorSpace", name)
        kind = self.file.get(found[0]) if isinstance(found, list) and found else name
        paint.subtractive = kind in ("Separation", "DeviceN")
        paint.rgb = None if kind == "Pattern" else (0.0, 0.0, 0.0)

    def graphics(self, given: Any, state: State) -> None:
        given = given if isinstance(given, dict) else {}
        for key, paint in (("ca", state.fill), ("CA", state.stroke)):
            alpha = self.file.get(given.get(key))
            if isinstance(alpha, (int, float)):
                paint.alpha = min(1.0, max(0.0, float(alpha)))
        font = self.file.array(given.get("Font"))
        if len(font) == 2:
            info, size = self.file.get(font[0]), self.file.get(font[1])
            if isinstance(info, dict) and isinstance(size, (int, float)):
                state.font = self.fonts.setdefault(id(info), Font(self.file, info))
                state.size = float(size)

    def filled(self, path: list[tuple[float, float]], state: State) -> None:
        if not path or state.fill.rgb is None:
            return
        x0, y0, x1, y1 = box(path)
        r, g, b = state.fill.rgb
        self.fills.append({"paint_ord": len(self.fills), "x0": x0, "y0": y0, "x1": x1, "y1": y1, "r": r, "g": g, "b": b})

    def form(self, resources: dict, name: Any, state: State, depth: int) -> None:
        found = self.resource(resources, "XObject", name)
        if not isinstance(found, Stream) or self.file.get(found.info.get("Subtype")) != "Form" or depth >= MAX_FORMS:
            return
        matrix = self.file.numbers(found.info.get("Matrix"), 6)
        inner = replace(state, fill=replace(state.fill), stroke=replace(state.stroke))
        inner.ctm = times(_matrix(matrix), state.ctm) if matrix else state.ctm
        own = self.file.dictionary(found.info.get("Resources"))
        self.content(found.data(), own or resources, inner, depth + 1)

    # -- text -----------------------------------------------------------------

    def show(self, parts: list, state: State, text: Matrix) -> Matrix:
        font, size = state.font, state.size
        if font is None:
            return text
        paint = state.stroke if state.mode in (1, 5) else state.fill
        rgb = paint.rgb or (0.0, 0.0, 0.0)
        packed = round(rgb[0] * 255) << 16 | round(rgb[1] * 255) << 8 | round(rgb[2] * 255)
        alpha = 0 if state.mode == INVISIBLE else round(paint.alpha * 255)
        to_page = times((size * state.stretch, 0, 0, size, 0, state.rise), times(text, state.ctm))
        points = math.sqrt(abs(to_page[0] * to_page[3] - to_page[1] * to_page[2]))
        look = (round(points, 3), packed, alpha, font.name)
        length = math.hypot(to_page[0], to_page[1]) or 1.0
        direction = (to_page[0] / length, to_page[1] / length)
        unit = size * state.stretch or 1.0
        tight = abs(state.char) + abs(state.word) <= 0.5 * WORD_GAP * abs(size)
        along = 0.0  # in text space
        for part in parts:
            if isinstance(part, (int, float)):
                along -= part / 1000 * unit
                continue
            if not isinstance(part, bytes):
                continue
            self.step(len(part))
            glyphs = font.glyphs(part)
            if tight:  # no glyph of the string can stand apart from the one before
                shown = "".join([g[0] for g in glyphs])
                length = sum([g[1] for g in glyphs]) * unit
                extra = (len(glyphs) * state.char + sum([g[2] for g in glyphs]) * state.word) * state.stretch
                if shown:
                    self.glyph(shown, look, direction, points or 1.0, to_page, along / unit, (along + length + extra) / unit, font)
                along += length + extra
                continue
            for char, width, spaced in glyphs:
                advance = width * unit
                if char:
                    a, b = along / unit, (along + advance) / unit
                    self.glyph(char, look, direction, points or 1.0, to_page, a, b, font)
                along += advance + (state.char + (state.word if spaced else 0.0)) * state.stretch
        return times((1, 0, 0, 1, along, 0), text)

    def glyph(self, chars: str, look: tuple, direction: tuple, em: float, m: Matrix, a: float, b: float, font: Font) -> None:
        start, end = apply(m, a, 0), apply(m, b, 0)
        corners = [apply(m, x, y) for x in (a, b) for y in (font.ascent, font.descent)]
        run = self.run_now
        if run is not None and run.look == look:
            dx, dy = start[0] - run.end[0], start[1] - run.end[1]
            gap = dx * direction[0] + dy * direction[1]
            off = abs(dx * direction[1] - dy * direction[0])
            turned = abs(direction[0] - run.direction[0]) + abs(direction[1] - run.direction[1])
            if off < 0.2 * em and turned < 0.01 and -0.5 * em < gap < RUN_GAP * em:
                if gap > WORD_GAP * em and chars[0] != " " and run.text[-1][-1] != " ":
                    run.text.append(" ")
                run.text.append(chars)
                run.end = end
                run.corners += corners
                if len(run.corners) > 64:
                    x0, y0, x1, y1 = box(run.corners)
                    run.corners = [(x0, y0), (x1, y1)]
                return
        self.flush()
        self.run_now = Run([chars], look, start, end, direction, em, corners)

    def flush(self) -> None:
        run, self.run_now = self.run_now, None
        if run is None:
            return
        text = "".join(run.text)
        if not text.isascii():
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        text = text.replace("\0", "�")
        x0, y0, x1, y1 = box(run.corners)
        size, packed, alpha, font = run.look
        span = {"text": text, "x0": x0, "y0": y0, "x1": x1, "y1": y1, "size": size, "color": packed, "alpha": alpha, "font": font}
        self.spans.append(span)


def _matrix(n: list) -> Matrix:
    a, b, c, d, e, f = (float(x) for x in n[-6:])
    return a, b, c, d, e, f


_IMAGE_END = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|$)")


def _skip_image(syntax: Syntax) -> None:
    while (v := syntax.value()) is not syntax.END and not (isinstance(v, Word) and v == "ID"):
        pass
    end = _IMAGE_END.search(syntax.data, syntax.at)
    syntax.at = end.end() if end else len(syntax.data)


# -- documents ----------------------------------------------------------------


def pages_of(file: PdfFile):
    """``(page dictionary with what it inherits)`` in order."""
    inherited = ("Resources", "MediaBox", "CropBox", "Rotate")
    seen: set[int] = set()
    todo = [(file.root.get("Pages"), {})]
    while todo:
        ref, above = todo.pop()
        node = file.dictionary(ref)
        if not node or id(node) in seen:
            continue
        seen.add(id(node))
        known = above | {k: node[k] for k in inherited if k in node}
        if "Kids" in node:
            todo += [(kid, known) for kid in reversed(file.array(node["Kids"]))]
        else:
            yield known | node


def view(file: PdfFile, page: dict) -> tuple[float, float, Matrix]:
    """Width, height and the way from user space to the shown page."""
    given = file.numbers(page.get("CropBox"), 4) or file.numbers(page.get("MediaBox"), 4) or [0.0, 0.0, 612.0, 792.0]
    x0, y0, x1, y1 = min(given[0], given[2]), min(given[1], given[3]), max(given[0], given[2]), max(given[1], given[3])
    turn = file.get(page.get("Rotate"))
    turn = turn % 360 if isinstance(turn, int) else 0
    w, h = x1 - x0, y1 - y0
    if turn == 90:
        return h, w, (0.0, 1.0, 1.0, 0.0, -y0, -x0)
    if turn == 180:
        return w, h, (-1.0, 0.0, 0.0, 1.0, x1, -y0)
    if turn == 270:
        return h, w, (0.0, -1.0, -1.0, 0.0, y1, x1)
    return w, h, (1.0, 0.0, 0.0, -1.0, -x0, y1)


def page_content(file: PdfFile, page: dict) -> bytes:
    found = file.get(page.get("Contents"))
    parts = found if isinstance(found, list) else [found]
    streams = [file.get(p) for p in parts]
    return b"\n".join(s.data() for s in streams if isinstance(s, Stream))
