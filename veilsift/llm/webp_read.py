"""Lossless WebP: the reader.

Decodes prefix codes (simple and normal, one or many groups), back-references and the colour
cache, and inverts the predictor, cross-colour, subtract-green and palette transforms.  Pixels are
``(height, width, 4)`` bytes in the order alpha, red, green, blue.

Prefix codes are decoded by array operations: what a symbol would be is looked up at **every** bit of a
window at once, with the bits it would take; then the chain of the symbols that really follow each other
is walked from the window's start.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Generator
from functools import lru_cache

import numpy as np

# Fixed values of the format: order of the code length code, and the places (x to the
# left, y up) of the 120 short distance codes.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
NEAR_PLACES = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
CACHE_FACTOR = 0x1E35A7BD


#: Predictor modes that need no pixel to the left, or it alone: a whole row is inverted at once.
ROW_MODES = (0, 1, 2, 3, 4, 8, 9)
BLACK = np.array([255, 0, 0, 0], np.uint8)
#: Bits decoded at once, and how far a symbol with its extra bits can reach beyond them.
WINDOW, REACH = 1 << 16, 128


class Bits:
    """Reads a byte string from the low bits up."""

    def __init__(self, data: bytes):
        self.data, self.pos = data, 0
        self.bytes = np.frombuffer(data, np.uint8)

    def read(self, n: int) -> int:
        at, shift = divmod(self.pos, 8)
        self.pos += n
        return (int.from_bytes(self.data[at : at + 8], "little") >> shift) & ((1 << n) - 1)

    def require(self) -> None:
        if self.pos > 8 * len(self.data):
            raise ValueError("the stream ends early")

    def words(self, n: int) -> np.ndarray:
        """The 32 bits from each of the next ``n`` bits on; zeros follow the end."""
        low, skip = divmod(self.pos, 8)
        need = (skip + n + 7) // 8
        held = self.bytes[low : low + need + 4]
        wide = np.zeros(need + 4, np.uint64)
        wide[: len(held)] = held
        five = wide[:need].copy()
        for i in range(1, 5):
            five |= wide[i : need + i] << np.uint64(8 * i)
        every = five[:, None] >> np.arange(8, dtype=np.uint64)
        return every.astype(np.uint32).reshape(-1)[skip : skip + n]


@lru_cache(maxsize=16)
def _turned(bits: int) -> np.ndarray:
    """All numbers of so many bits, read from the other end."""
    out = np.zeros(1 << bits, np.int64)
    for i in range(bits):
        out |= ((np.arange(1 << bits) >> i) & 1) << (bits - 1 - i)
    return out


class PrefixCode:
    """A canonical prefix code as a table over its longest length; a lone symbol takes no bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        if len(used) == 1:
            self.bits, self.symbols, self.taken = 0, used.astype(np.int32), np.zeros(1, np.int32)
            self.most = int(used[0])
        else:
            self.bits = int(lengths.max())
            order = used[np.argsort(lengths[used], kind="stable")]
            share = 1 << (self.bits - lengths[order])
            if share.sum() != 1 << self.bits:
                raise ValueError("an overfull or incomplete prefix code")
            turned = _turned(self.bits)
            self.symbols = np.repeat(order, share)[turned].astype(np.int32)
            self.taken = np.repeat(lengths[order], share)[turned].astype(np.int32)
            self.most = int(used[-1])
        self.mask = np.uint32((1 << self.bits) - 1)
        self.packed = self.symbols << 8 | self.taken

    @classmethod
    def of_table(cls, bits: int, packed: np.ndarray, symbols: np.ndarray, taken: np.ndarray, most: int) -> PrefixCode:
        code = cls.__new__(cls)
        code.bits, code.packed, code.symbols, code.taken, code.most = bits, packed, symbols, taken, most
        code.mask = np.uint32((1 << bits) - 1)
        return code


@lru_cache(maxsize=1024)
def _lone(size: int, symbol: int) -> PrefixCode:
    if symbol >= size:
        raise ValueError("a symbol beyond the alphabet")
    lengths = np.zeros(size, np.int64)
    lengths[symbol] = 1
    return PrefixCode(lengths)


#: Codes read before, by alphabet and first bits: the bits of their description and the code.
_KNOWN: dict[tuple[int, int], tuple[int, int, PrefixCode]] = {}
MOST_KNOWN = 256


def read_prefix_codes(bits: Bits, sizes: tuple[int, ...]) -> list[PrefixCode]:
    """Codes in a row; one whose description repeats a known one, bit by bit, is not built again."""
    out: list[PrefixCode] = []
    for size in sizes:
        at, shift = divmod(bits.pos, 8)
        begin = int.from_bytes(bits.data[at : at + 9], "little") >> shift & 0xFFFFFFFFFFFFFFFF
        if begin & 3 == 1:  # a lone symbol of one bit or eight
            wide = begin & 4
            bits.pos += 11 if wide else 4
            out.append(_lone(size, begin >> 3 & (255 if wide else 1)))
            continue
        key = size, begin
        if known := _KNOWN.get(key):
            n, value, code = known
            if int.from_bytes(bits.data[at : at + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1) == value:
                bits.pos += n
                out.append(code)
                continue
        start = bits.pos
        out.append(read_prefix_code(bits, size))
        n = bits.pos - start
        if len(_KNOWN) >= MOST_KNOWN:
            _KNOWN.clear()
        _KNOWN[key] = n, int.from_bytes(bits.data[at : at + (n + shift + 7) // 8], "little") >> shift & ((1 << n) - 1), out[-1]
    return out


def read_prefix_code(bits: Bits, size: int) -> PrefixCode:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise ValueError("a symbol beyond the alphabet")
        lengths[symbols] = 1
        return PrefixCode(lengths)
    own = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    pairs, mask = list(zip(code.symbols.tolist(), code.taken.tolist())), int(code.mask)
    data, pos = bits.data, bits.pos
    found: list[int] = []
    before = 8
    while len(found) < size and left > 0:
        left -= 1
        at = pos >> 3
        word = int.from_bytes(data[at : at + 4], "little") >> (pos & 7)
        s, n = pairs[word & mask]
        pos += n
        if s < 16:
            found.append(s)
            before = s or before
            continue
        word >>= n
        if s == 16:
            found += [before] * (3 + (word & 3))
            pos += 2
        elif s == 17:
            found += [0] * (3 + (word & 7))
            pos += 3
        else:
            found += [0] * (11 + (word & 127))
            pos += 7
    bits.pos = pos
    bits.require()
    if len(found) > size:
        raise ValueError("code lengths run over")
    lengths[: len(found)] = found
    return PrefixCode(lengths)


#: From so many streams on their codes are read side by side.
SIDE_BY_SIDE = 16
#: What the symbols of a code length code say: the least number of lengths, and the bits added to it.
_LEAST = np.array([1] * 16 + [3, 3, 11])
_MORE = np.array([0] * 16 + [2, 3, 7])


def _tables(code: np.ndarray, symbol: np.ndarray, length: np.ndarray, codes: int) -> tuple[np.ndarray, ...]:
    """Tables of canonical codes in a row, as in ``PrefixCode``: the bits of each, its start, whether it is whole, and the entries.

    ``code`` rises, and within a code ``symbol``.
    """
    many = np.bincount(code, minlength=codes)
    bits = np.zeros(codes, np.int64)
    np.maximum.at(bits, code, length)
    bits[many == 1] = 0
    length = np.where(many[code] == 1, 0, length)
    share = np.int64(1) << (bits[code] - length)
    whole = (np.bincount(code, share, minlength=codes) == 1 << bits) & (many > 0)
    kept = np.flatnonzero(whole[code])
    order = kept[np.argsort(code[kept] * 16 + length[kept], kind="stable")]
    ordered = np.repeat((symbol[order] << 8 | length[order]).astype(np.int32), share[order])
    size = np.where(whole, 1 << bits, 0)
    start = np.cumsum(size) - size
    packed = np.empty_like(ordered)
    for b in np.unique(bits[whole]).tolist():
        low = start[whole & (bits == b)][:, None]
        packed[low + np.arange(1 << b)] = ordered[low + _turned(b)]
    return bits, start, whole, packed


class _Streams:
    """Bits of many streams: the next 32 at any place of each, and others above them."""

    def __init__(self, streams: tuple[Bits, ...]):
        parts = [bits.data for bits in streams]
        held = b"".join([*(part + bytes(16) for part in parts), bytes(8)])
        sizes = np.array([len(part) for part in parts])
        self.base = 8 * (np.cumsum(sizes + 16) - sizes - 16)
        self.end = self.base + 8 * sizes
        self.pos = self.base + np.array([bits.pos for bits in streams])
        words = np.frombuffer(held, "<u4", len(held) // 4).astype(np.int64)
        self.wide = words[:-1] | words[1:] << 32

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.wide.take(pos >> 5, mode="clip") >> (pos & 31)


def _read_lengths(streams: _Streams, pos: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """Codes described by code lengths, side by side: used symbols as code, symbol and length; places behind; what is wrong."""
    n = len(pos)
    head = streams.at(pos)
    many = 4 + (head >> 1 & 15)
    own = np.zeros((n, 19), np.int64)
    own[:, CODE_LENGTH_ORDER] = (streams.at(pos + 5) & 0xFFFFFFFF | streams.at(pos + 37) << 32)[:, None] >> 3 * np.arange(19) & 7
    own[:, CODE_LENGTH_ORDER] *= np.arange(19) < many[:, None]
    pos = pos + 5 + 3 * many
    limited = streams.at(pos)
    field = 2 + 2 * (limited >> 1 & 7)
    few = limited & 1 == 1
    left = np.where(few, 2 + (limited >> 4 & (1 << field) - 1), size)
    pos += np.where(few, 4 + field, 1)
    code, symbol = np.nonzero(own)
    bits, start, whole, packed = _tables(code, symbol, own[code, symbol], n)
    mask = (1 << bits) - 1
    filled = np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, ...]] = []
    row = np.flatnonzero(whole)
    p, f, rest = pos[row], filled[row], left[row]
    low, m, most = start[row], mask[row], size[row]
    while len(row):
        word = streams.at(p)
        here = packed[low + (word & m)]
        s, taken = here >> 8, here & 255
        more = _MORE.take(s)
        times = _LEAST.take(s) + (word >> taken & (1 << more) - 1)
        out.append((row, f, times, s))
        p, f, rest = p + taken + more, f + times, rest - 1
        on = (f < most) & (rest > 0)
        if not on.all():
            pos[row], filled[row] = p, f
            row, p, f, rest, low, m, most = (x[on] for x in (row, p, f, rest, low, m, most))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none, pos, ~whole
    row, f, times, s = (np.concatenate(x) for x in zip(*out))
    some = np.flatnonzero((s > 0) & (s < 17))
    some = some[np.argsort(row[some], kind="stable")]
    row, f, times, s = row[some], f[some], times[some], s[some]
    # What is repeated is the last length before it, or 8 at first.
    last = np.maximum.accumulate(np.where(s < 16, np.arange(len(s)), -1))
    value = np.where((last >= 0) & (row[last] == row), s[last], 8)
    code = np.repeat(row, times)
    symbol = np.repeat(f - np.cumsum(times) + times, times) + np.arange(times.sum())
    return code, symbol, np.repeat(value, times), pos, ~whole | (filled > size)


def read_codes_of_all(asked: list[tuple[Bits, tuple[int, ...]]]) -> list[list[PrefixCode] | ValueError | IndexError]:
    """The codes of these alphabets that come next in each stream, or what is wrong; all streams are read side by side."""
    if len(asked) < SIDE_BY_SIDE:
        return [_attempt(read_prefix_codes, *x) for x in asked]
    streams, sizes = zip(*asked)
    held, n = _Streams(streams), len(streams)
    pos, wrong = held.pos, np.zeros(n, bool)
    out: list = [[] for _ in streams]
    for size in np.array(sizes).T:
        head = held.at(pos)
        two, wide = head >> 1 & 1, head >> 2 & 1
        first, at = head >> 3 & np.where(wide, 255, 1), np.where(wide, 11, 4)
        second = np.where(two, head >> at & 255, first)
        short = head & 1 == 1
        lone = short & (first == second)
        wrong |= short & (np.maximum(first, second) >= size)
        pos = np.where(short, pos + at + 8 * two, pos)
        rows = np.flatnonzero(~lone & ~wrong)
        listed = np.flatnonzero(~short[rows])
        code, symbol, length, after, bad = _read_lengths(held, pos[rows[listed]], size[rows[listed]])
        pos[rows[listed]] = after
        wrong[rows[listed]] |= bad
        pair = np.flatnonzero(short[rows])
        both = np.sort(np.stack([first, second], 1)[rows[pair]], axis=1)
        code = np.concatenate([listed[code], np.repeat(pair, 2)])
        symbol = np.concatenate([symbol, both.ravel()])
        length = np.concatenate([length, np.ones(both.size, np.int64)])
        order = np.argsort(code, kind="stable")
        code, symbol, length = code[order], symbol[order], length[order]
        bits, start, whole, packed = _tables(code, symbol, length, len(rows))
        wrong[rows[~whole]] = True
        most = np.zeros(len(rows), np.int64)
        np.maximum.at(most, code, symbol)
        symbols, taken = packed >> 8, packed & 255
        for r, b, a, m in zip(rows.tolist(), bits.tolist(), start.tolist(), most.tolist()):
            part = slice(a, a + (1 << b))
            out[r].append(PrefixCode.of_table(b, packed[part], symbols[part], taken[part], m))
        for r, s, k in zip(*(x[lone & ~wrong].tolist() for x in (np.arange(n), first, size))):
            out[r].append(_lone(k, s))
    wrong |= pos > held.end
    for i, (p, bad) in enumerate(zip((pos - held.base).tolist(), wrong.tolist())):
        if bad:  # read alone, it says what is wrong
            out[i] = _attempt(read_prefix_codes, *asked[i])
        else:
            streams[i].pos = p
    return out


def _attempt(read, *given):
    try:
        return read(*given)
    except (ValueError, IndexError) as problem:
        return problem


def joined(pixels: np.ndarray) -> np.ndarray:
    """Pixels as 32-bit ARGB numbers."""
    return np.ascontiguousarray(pixels).view(">u4")[..., 0].astype(np.uint32)


def split(argb: np.ndarray) -> np.ndarray:
    return argb.astype(">u4").view(np.uint8).reshape(*argb.shape, 4)


#: A reader that says what it needs next, as a function for many readers and its own arguments, and is sent it.
Reading = Generator[tuple[Callable[[list], list], tuple], list, object]
#: Extra bits behind the prefix of a length or of a distance, by prefix.
_EXTRA = np.array([0 if k < 4 else (k - 2) >> 1 for k in range(40)], np.int64)


def _span(words: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths or distance codes from their prefixes and the extra bits at ``at``."""
    return _span_of(words[at].astype(np.int64), prefix)


def _span_of(words: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Lengths or distance codes from their prefixes and the bits that follow."""
    extra = _EXTRA[prefix]
    return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + (words & (1 << extra) - 1) + 1)


class _Window:
    """What one group of codes would read at each of the first ``n`` bits of ``words``.

    Everywhere only the bits that a symbol would take are worked out, ``step``; its values are read where
    a symbol really begins.
    """

    def __init__(self, codes: list[PrefixCode], words: np.ndarray, n: int):
        green, red, blue, alpha, distance = codes
        self.codes, self.words = codes, words
        self.packed = green.packed.take((words[:n] & green.mask).astype(np.intp))
        step = self.packed.astype(np.uint8)
        others = [c for c in (red, blue, alpha) if c.bits]
        if others:
            end = np.arange(n) + step
            for code in others:
                end += code.taken.take((words.take(end) & code.mask).astype(np.intp))
            literal = (end - np.arange(n)).astype(np.uint8)
            step = literal if green.most < 256 else np.where(self.packed < 256 << 8, literal, step)
        if green.most > 255:
            ref = np.flatnonzero((self.packed >= 256 << 8) & (self.packed < 280 << 8))
            if len(ref):
                first = self.packed[ref]
                behind = (first & 255) + _EXTRA[(first >> 8) - 256]
                there = distance.packed[words[ref + behind] & distance.mask]
                step[ref] = behind + (there & 255) + _EXTRA[there >> 8]
        self.step = step.tobytes()
        self.steps = step

    def symbols(self, at: np.ndarray) -> np.ndarray:
        return self.packed[at] >> 8

    def literals(self, at: np.ndarray) -> np.ndarray:
        """ARGB of the literal symbols at these bits."""
        here = self.packed[at]
        argb, place = (here >> 8).astype(np.uint32) << np.uint32(8), at + (here & 255)
        for code, shift in zip(self.codes[1:4], (16, 0, 24)):
            if not code.bits:
                argb |= np.uint32(int(code.symbols[0]) << shift)
                continue
            there = self.words[place] & code.mask
            argb |= code.symbols[there].astype(np.uint32) << np.uint32(shift)
            place = place + code.taken[there]
        return argb

    def references(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and distance codes of the references at these bits."""
        distance, here = self.codes[4], self.packed[at]
        prefix, place = (here >> 8) - 256, at + (here & 255)
        length = _span(self.words, place, prefix)
        place = place + _EXTRA[prefix]
        there = distance.packed[self.words[place] & distance.mask]
        return length, _span(self.words, place + (there & 255), there >> 8)


def _chain(window: _Window, start: int, n: int) -> list[int]:
    """The bits at which symbols begin, from ``start`` on."""
    step, out, at = window.step, [], start
    append = out.append
    while at < n:
        append(at)
        at += step[at]
    return out


def _read_at(window: _Window, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Symbol, argb, run and distance code of the tokens at these bits."""
    symbol = window.symbols(at)
    argb, run, dist = np.zeros(len(at), np.uint32), np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
    literal = symbol < 256
    if literal.all():
        argb = window.literals(at)
    else:
        argb[literal] = window.literals(at[literal])
        ref = np.flatnonzero(~literal & (symbol < 280))
        run[ref], dist[ref] = window.references(at[ref])
    return symbol, argb, run, dist


def _tokens(bits: Bits, groups: list[list[PrefixCode]], group_of: list[int] | None, total: int):
    """Symbol, argb, run and distance code of every token of an image of ``total`` pixels."""
    done, parts = 0, []
    while done < total:
        bits.require()
        n = max(64, min(WINDOW, 64 * (total - done), 8 * len(bits.data) - bits.pos + 8))
        if group_of is None:
            window = _Window(groups[0], bits.words(n + REACH), n)
            at = np.array(_chain(window, 0, n))
            token = _read_at(window, at)
            ends = at + window.steps[at]
        else:
            n = min(n, max(64, WINDOW // len(groups)))
            words = bits.words(n + REACH)
            windows: dict[int, tuple] = {}
            chain, which, at, pixel = [], [], 0, done
            while at < n and pixel < total:
                g = group_of[pixel]
                if g not in windows:
                    window = _Window(groups[g], words, n)
                    windows[g] = window, window.step, _read_at(window, np.arange(n))[2].tolist()
                _, step, runs = windows[g]
                chain.append(at)
                which.append(g)
                pixel += runs[at]
                at += step[at]
            at, which = np.array(chain), np.array(which)
            token = tuple(np.zeros(len(at), t) for t in (np.int32, np.uint32, np.int64, np.int64))
            ends = at.copy()
            for g, (window, _, _) in windows.items():
                mine = np.flatnonzero(which == g)
                for whole, part in zip(token, _read_at(window, at[mine])):
                    whole[mine] = part
                ends[mine] += window.steps[at[mine]]
        run = token[2]
        after = done + np.cumsum(run)
        last = int(np.searchsorted(after, total))
        if last < len(after):
            if after[last] != total:
                raise ValueError("a reference leaves the image")
            token, ends, after = tuple(x[: last + 1] for x in token), ends[: last + 1], after[: last + 1]
        parts.append(token)
        done = int(after[-1])
        bits.pos += int(ends[-1])
    bits.require()
    return [np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts)]


#: So many images have their tokens read side by side; the longest ones, that are left in the end, go on one by one.
TOGETHER = 64


#: What is added to the symbols of distances where they share a table with the green ones.
FAR = 4096


def _stepping(code: PrefixCode, distance: PrefixCode) -> tuple[np.ndarray, int]:
    """The tables of green symbols and of distances behind each other, equally long; entries take their extra bits too."""
    size = max(len(code.packed), len(distance.packed))
    green, far = (np.tile(c.packed, size // len(c.packed)) for c in (code, distance))
    if code.most > 255:
        ref = np.flatnonzero((green >= 256 << 8) & (green < 280 << 8))
        green[ref] += _EXTRA[(green[ref] >> 8) - 256].astype(np.int32)
    far += (FAR << 8) + _EXTRA[far >> 8].astype(np.int32)
    return np.concatenate([green, far]), size


def _side_by_side(streams: tuple[Bits, ...], codes: tuple[list[PrefixCode], ...], totals: tuple[int, ...]) -> tuple[list[tuple], list[int]]:
    """The first tokens of many images with one group of codes each, as in ``_tokens``, and the pixels they give.

    One symbol of every image, with the samples behind a literal, is read at a time, until fewer than ``TOGETHER``
    images are left.  Which images are done is seen every few symbols; what was read beyond their ends falls.
    """
    held, n = _Streams(streams), len(streams)
    at = held.at
    stepping = [_stepping(c[0], c[4]) for c in codes]
    table = np.concatenate([t for t, _ in stepping])
    size = np.array([m for _, m in stepping])
    low = 2 * (np.cumsum(size) - size)
    tables, off, mask = [], [], []
    samples = any(code.bits for c in codes for code in c[1:4])
    for place in zip(*(c[1:4] for c in codes)) if samples else ():
        tables.append(np.concatenate([code.packed for code in place]))
        sizes = np.array([len(code.packed) for code in place])
        off.append(np.cumsum(sizes) - sizes)
        mask.append(sizes - 1)
    total, got = np.array(totals), np.zeros(n, np.int64)
    row, p, here, most = np.arange(n), held.pos.copy(), low, size - 1
    parts: list[tuple[np.ndarray, ...]] = []
    while len(row) >= TOGETHER:
        few: list[tuple[np.ndarray, ...]] = []
        for _ in range(8):
            word = at(p)
            g = table.take(here + (word & most))
            taken = g & 255
            after = p + taken
            if samples:
                red = tables[0].take(off[0] + (word >> taken & mask[0]))
                place = after + (red & 255)
                word = at(place)
                blue = tables[1].take(off[1] + (word & mask[1]))
                taken = blue & 255
                alpha = tables[2].take(off[2] + (word >> taken & mask[2]))
                after = np.where(g < 256 << 8, place + taken + (alpha & 255), after)
                few.append((g, after, red, blue, alpha))
            else:
                few.append((g, after))
            p = after
            ref = (g >= 256 << 8) & (g < 280 << 8)  # a distance follows
            here = low + ref * (most + 1)
        seen, ends, *rest = (np.stack(x) for x in zip(*few))
        argb = seen >> 8 << 8
        if rest:
            red, blue, alpha = (x >> 8 for x in rest)
            argb |= alpha << 24 | red << 16 | blue
        parts.append((np.tile(row.astype(np.int32), 8), seen.ravel(), ends.ravel(), argb.ravel()))
        run = np.ones(seen.shape, np.int64)
        run[seen >= FAR << 8] = 0
        refs = np.nonzero((seen >= 256 << 8) & (seen < 280 << 8))
        prefix = (seen[refs] >> 8) - 256
        run[refs] = _span_of(at(ends[refs] - _EXTRA[prefix]), prefix)
        got[row] += run.sum(axis=0)
        on = ((got[row] < total[row]) | ref) & (p <= held.end[row])
        if not on.all():
            row, p, here, low, most = (x[on] for x in (row, p, here, low, most))
            off, mask = [x[on] for x in off], [x[on] for x in mask]
    owner, g, ends, argb = (np.concatenate(x) for x in zip(*parts))
    parts.clear()
    order = np.argsort(owner.astype(np.uint16) if n < 1 << 16 else owner, kind="stable")
    owner, g, ends, argb = owner[order], g[order], ends[order], argb[order]
    symbol = g >> 8
    if not samples:  # the other samples have no bits
        rest = [sum(int(c.symbols[0]) << shift for c, shift in zip(own[1:4], (16, 0, 24))) for own in codes]
        argb |= np.array(rest, np.uint32).view(np.int32)[owner]
    argb = np.where(symbol < 256, argb, 0).view(np.uint32)
    far = symbol >= FAR
    run, dist = np.where(far, 0, 1), np.zeros(len(g), np.int64)
    ref = np.flatnonzero((symbol > 255) & (symbol < 280))
    prefix = symbol[ref] - 256
    run[ref] = _span_of(at(ends[ref] - _EXTRA[prefix]), prefix)
    before = np.cumsum(run) - run
    many = np.bincount(owner, minlength=n)
    before -= before[np.cumsum(many) - many][owner]
    kept = (before < total[owner]) & ~far
    paired = np.append(far[1:], False)[ref]
    kept[ref[~paired]] = False  # its distance was not read
    ref = ref[paired]
    prefix = symbol[ref + 1] - FAR
    dist[ref] = _span_of(at(ends[ref + 1] - _EXTRA[prefix]), prefix)
    ends[ref] = ends[ref + 1]
    owner, symbol, argb, run, dist, ends, before = (x[kept] for x in (owner, symbol, argb, run, dist, ends, before))
    cuts = np.cumsum(np.bincount(owner, minlength=n))
    for bits, end in zip(streams, (ends[cuts - 1] - held.base).tolist()):
        bits.pos = end
    return list(zip(*(np.split(x, cuts[:-1]) for x in (symbol, argb, run, dist)))), (before + run)[cuts - 1].tolist()


def tokens_of_all(asked: list[tuple[Bits, list[list[PrefixCode]], list[int] | None, int]]) -> list[list[np.ndarray] | ValueError | IndexError]:
    """What ``_tokens`` gives for each image, or what is wrong; images with one group of codes are read side by side."""
    out: list = [None] * len(asked)
    kinds: dict[bool, list[int]] = {}
    for i, (_, groups, group_of, _) in enumerate(asked):
        if group_of is None:
            kinds.setdefault(any(code.bits for code in groups[0][1:4]), []).append(i)
    for places in kinds.values():
        if len(places) < TOGETHER:
            continue
        tokens, done = _side_by_side(*zip(*((asked[i][0], asked[i][1][0], asked[i][3]) for i in places)))
        for i, token, n in zip(places, tokens, done):
            bits, groups, _, total = asked[i]
            try:
                bits.require()
                if n > total:
                    raise ValueError("a reference leaves the image")
                if n < total:
                    token = [np.concatenate(x) for x in zip(token, _tokens(bits, groups, None, total - n))]
                out[i] = list(token)
            except (ValueError, IndexError) as problem:
                out[i] = problem
    return [_attempt(_tokens, *x) if found is None else found for found, x in zip(out, asked)]


@lru_cache(maxsize=64)
def _places(width: int) -> np.ndarray:
    """Distances of the short codes from 1 on."""
    return np.array([0, *(max(1, x + y * width) for x, y in NEAR_PLACES)])


def read_image(bits: Bits, width: int, height: int, main: bool) -> Reading:
    """An entropy-coded image as 32-bit ARGB numbers, ``(height, width)``; asks for its codes and tokens."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    group_of, many = None, 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = (width + (1 << tile) - 1) >> tile
        down = (height + (1 << tile) - 1) >> tile
        numbers = ((yield from read_image(bits, across, down, False)) >> 8) & 0xFFFF
        many = int(numbers.max()) + 1
        group_of = numbers.repeat(1 << tile, 0).repeat(1 << tile, 1)[:height, :width].reshape(-1).tolist()
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [read_prefix_codes(bits, sizes) for _ in range(many)] if many > 1 else [(yield read_codes_of_all, (bits, sizes))]
    total = width * height
    if many == 1:
        group_of = None
        lone = groups[0][:4]
        if not any(c.bits for c in lone):  # no bits at all: one colour
            bits.require()
            green, red, blue, alpha = (int(c.symbols[0]) for c in lone)
            if 256 <= green < 280:
                raise ValueError("a reference leaves the image")
            # A place of the cache that nothing was put in is transparent black.
            return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue if green < 256 else 0, np.uint32)
    symbol, argb, run, dist = yield tokens_of_all, (bits, groups, group_of, total)
    short = _places(width)
    dist = np.where(dist > 120, dist - 120, short[np.minimum(dist, 120)])
    after = np.cumsum(run)
    start = after - run
    ref = np.flatnonzero((symbol > 255) & (symbol < 280))
    if (dist[ref] > start[ref]).any():
        raise ValueError("a reference leaves the image")
    if cache_bits:
        out = _through_cache(symbol, argb, run, dist, cache_bits)
    else:
        out = np.zeros(total, np.uint32)
        literal = symbol < 256
        out[start[literal]] = argb[literal]
        for s, n, d in zip(start[ref].tolist(), run[ref].tolist(), dist[ref].tolist()):
            out[s : s + n] = out[s - d : s - d + n] if d >= n else np.resize(out[s - d : s], n)
    return out.reshape(height, width)


def _through_cache(symbol: np.ndarray, argb: np.ndarray, run: np.ndarray, dist: np.ndarray, cache_bits: int) -> np.ndarray:
    """Pixels of tokens some of which name places of the colour cache."""
    shift, factor = 32 - cache_bits, CACHE_FACTOR
    keys = (argb * np.uint32(factor)) >> np.uint32(shift)
    cache, out = [0] * (1 << cache_bits), []
    append = out.append
    for s, pixel, key, n, d in zip(symbol.tolist(), argb.tolist(), keys.tolist(), run.tolist(), dist.tolist()):
        if s < 256:
            append(pixel)
            cache[key] = pixel
        elif s > 279:
            append(cache[s - 280])
            if not out[-1]:  # a place that was empty is filled by what it gave
                cache[0] = 0
        else:
            at = len(out) - d
            again = out[at : at + n] if d >= n else (out[at:] * (n // d + 1))[:n]
            out += again
            for pixel in again[-d:]:  # the last of each colour decides
                cache[((pixel * factor) & 0xFFFFFFFF) >> shift] = pixel
    return np.array(out, np.uint32)


def _average(a, b):
    return (a & b) + ((a ^ b) >> 1)


def _predict(mode: int, left, top, top_left, top_right):
    """Predicted channels; arguments are int arrays whose last axis is the channels."""
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        # Whichever of left and top is nearer to left + top - top_left.
        nearer = np.abs(top - top_left).sum(axis=-1) < np.abs(left - top_left).sum(axis=-1)
        return np.where(nearer[..., None], left, top)
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        mean = _average(left, top)
        return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int64), 0, 255)
    return np.broadcast_to(BLACK.astype(np.int64), left.shape)  # 0, and modes without a meaning


def predicted(pixels: np.ndarray, mode: int) -> np.ndarray:
    """What ``mode`` predicts for every pixel of an image that is known."""
    height, width, _ = pixels.shape
    known = pixels if mode in ROW_MODES else pixels.astype(np.int64)
    out = np.zeros_like(pixels)
    out[0, 0] = BLACK
    out[0, 1:] = pixels[0, :-1]
    out[1:, 0] = pixels[:-1, 0]
    if height > 1 and width > 1:
        # The last pixel of a row has the first of its own row to the top right.
        right = np.concatenate([known[:-1, 2:], known[1:, :1]], axis=1)
        out[1:, 1:] = _predict(mode, known[1:, :-1], known[:-1, 1:], known[:-1, :-1], right).astype(np.uint8)
    return out


def invert_predictor(residuals: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Pixels from residuals, by runs of one mode in a row."""
    height, width, _ = residuals.shape
    out = np.empty_like(residuals)
    np.add.accumulate(residuals[0], axis=0, dtype=np.uint8, out=out[0])
    out[0] += BLACK
    for low in range(0, height, 1 << tile):
        first, end = max(1, low), min(height, low + (1 << tile))
        row_modes = modes[low >> tile].tolist()
        runs = []
        for k, mode in enumerate(row_modes):
            if runs and runs[-1][2] == mode:
                runs[-1][1] = min(width, (k + 1) << tile)
            else:
                runs.append([max(1, k << tile), min(width, (k + 1) << tile), mode])
        runs = [r for r in runs if r[0] < r[1]]
        if all(r[2] == 0 for r in runs):
            if first < end:
                out[first:end, 1:] = residuals[first:end, 1:] + BLACK
                column = np.concatenate([out[first - 1 : first, 0], residuals[first:end, 0]])
                out[first:end, 0] = np.add.accumulate(column, axis=0, dtype=np.uint8)[1:]
            continue
        for y in range(first, end):
            above, row, given = out[y - 1], out[y], residuals[y]
            row[0] = given[0] + above[0]
            for x, e, mode in runs:
                if mode == 0:
                    row[x:e] = given[x:e] + BLACK
                elif mode == 1:
                    np.add.accumulate(np.concatenate([row[x - 1 : x], given[x:e]]), axis=0, dtype=np.uint8, out=row[x - 1 : e])
                elif mode in ROW_MODES:
                    right = above[x + 1 : e + 1] if e < width else np.concatenate([above[x + 1 :], row[:1]])
                    row[x:e] = given[x:e] + _predict(mode, None, above[x:e], above[x - 1 : e - 1], right)
                else:
                    wide = np.concatenate([above, row[:1]]).astype(np.int64)
                    left = row[x - 1].astype(np.int64)
                    for i in range(x, e):
                        left = (given[i] + _predict(mode, left, wide[i], wide[i - 1], wide[i + 1])) & 255
                        row[i] = left
    return out


def colour_delta(factor: np.ndarray, channel: np.ndarray) -> np.ndarray:
    return (factor.astype(np.int8).astype(np.int64) * channel.astype(np.int8).astype(np.int64)) >> 5


def cross_colour_transform(pixels: np.ndarray, factors: np.ndarray, tile: int, forward: bool) -> np.ndarray:
    """``factors`` hold red-to-blue, green-to-blue and green-to-red as red, green, blue."""
    height, width, _ = pixels.shape
    f = factors.repeat(1 << tile, 0).repeat(1 << tile, 1)[:height, :width]
    out = pixels.copy()
    green, sign = pixels[..., 2], -1 if forward else 1
    red = ((pixels[..., 1] + sign * colour_delta(f[..., 3], green)) & 255).astype(np.uint8)
    whole_red = pixels[..., 1] if forward else red
    blue = pixels[..., 3] + sign * (colour_delta(f[..., 2], green) + colour_delta(f[..., 1], whole_red))
    out[..., 1], out[..., 3] = red, (blue & 255).astype(np.uint8)
    return out


def subtract_green(pixels: np.ndarray, forward: bool) -> np.ndarray:
    out = pixels.copy()
    green = pixels[..., 2] if not forward else np.negative(pixels[..., 2])
    out[..., 1] += green
    out[..., 3] += green
    return out


def _bundle(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def _lossless_chunk(data: bytes) -> bytes:
    """The first VP8L chunk; chunks of colour profiles, metadata and unknown kinds are passed over."""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            (size,) = struct.unpack_from("<I", data, at + 4)
            if data[at : at + 4] == b"VP8L":
                return data[at + 8 : at + 8 + size]
            at += 8 + size + (size & 1)
    raise ValueError("not a lossless WebP file")


def decode(data: bytes) -> tuple[np.ndarray, bool]:
    """Pixels ``(height, width, 4)`` of a lossless WebP file, simple or extended (one still image), and its alpha hint."""
    (found,) = decode_all([data])
    if isinstance(found, Exception):
        raise found
    return found


#: Pixels of the files that are read together, bar a larger one.
MOST_TOGETHER = 1 << 21


def decode_all(files: list[bytes]) -> list[tuple[np.ndarray, bool] | ValueError | IndexError]:
    """What ``decode`` gives for each file, or the error it raises; about ``MOST_TOGETHER`` pixels are read together."""
    out, group, held = [], [], 0
    for data in files:
        pixels = _declared(data)
        if group and held + pixels > MOST_TOGETHER:
            out += _decode_group(group)
            group, held = [], 0
        group.append(data)
        held += pixels
    return out + _decode_group(group)


def _declared(data: bytes) -> int:
    """The pixels that a file says it has."""
    try:
        sides = int.from_bytes(_lossless_chunk(data)[1:5], "little")
    except ValueError:
        return 0
    return ((sides & 0x3FFF) + 1) * ((sides >> 14 & 0x3FFF) + 1)


def _decode_group(files: list[bytes]) -> list[tuple[np.ndarray, bool] | ValueError | IndexError]:
    """Files whose codes and tokens are read together."""
    out: list = [None] * len(files)
    going = [(i, _decoding(data), None) for i, data in enumerate(files)]
    while going:
        asked: dict = {}
        for i, reading, answer in going:
            try:
                needed, given = reading.throw(answer) if isinstance(answer, Exception) else reading.send(answer)
                asked.setdefault(needed, []).append((i, reading, given))
            except StopIteration as end:
                out[i] = end.value
            except (ValueError, IndexError) as problem:
                out[i] = problem
        going = []
        for needed, readers in asked.items():
            answers = needed([given for _, _, given in readers])
            going += [(i, reading, answer) for (i, reading, _), answer in zip(readers, answers)]
    return out


def _decoding(data: bytes) -> Reading:
    bits = Bits(_lossless_chunk(data))
    if bits.read(8) != 0x2F:
        raise ValueError("bad signature")
    width, height, alpha = bits.read(14) + 1, bits.read(14) + 1, bool(bits.read(1))
    if bits.read(3):
        raise ValueError("unknown version")
    undo, seen = [], set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform comes twice")
        seen.add(kind)
        if kind == PALETTE:
            colours = bits.read(8) + 1
            table = split((yield from read_image(bits, colours, 1, False)))[0]
            undo.append((kind, np.cumsum(table, axis=0, dtype=np.uint8), width))
            pack = _bundle(colours)
            width = (width + (1 << pack) - 1) >> pack
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, None, 0))
        else:
            tile = bits.read(3) + 2
            across, down = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            undo.append((kind, split((yield from read_image(bits, across, down, False))), tile))
    pixels = split((yield from read_image(bits, width, height, True)))
    for kind, table, n in reversed(undo):
        if kind == PALETTE:
            pack = _bundle(len(table))
            index, each = pixels[..., 2], 1 << pack
            if pack:
                depth = 8 >> pack
                parts = [(index >> (depth * i)) & ((1 << depth) - 1) for i in range(each)]
                index = np.stack(parts, -1).reshape(height, -1)[:, :n]
            inside = np.zeros((max(256, len(table)), 4), np.uint8)
            inside[: len(table)] = table
            pixels = inside[index]
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, False)
        elif kind == PREDICTOR:
            pixels = invert_predictor(pixels, table[..., 2], n)
        else:
            pixels = cross_colour_transform(pixels, table, n, False)
    return pixels, alpha
