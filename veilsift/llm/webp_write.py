"""Lossless WebP: the writer.

Streams are made as the pixels invite: transforms, back-references, a colour cache and prefix codes whose
lengths follow the counts.  Many images are written at once: their pixels lie in one row, so that every step is
one array operation for all of them, and what an image becomes doesn't depend on those beside it.  Python loops
over references only.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from .webp_read import (
    BLACK,
    CACHE_FACTOR,
    CODE_LENGTH_ORDER,
    CROSS_COLOUR,
    NEAR_PLACES,
    PALETTE,
    PREDICTOR,
    ROW_MODES,
    SUBTRACT_GREEN,
    _predict,
    colour_delta,
    joined,
    subtract_green,
)

MOST_LENGTH = 4096
MOST_DISTANCE = (1 << 20) - 120
#: Pixels among which references are sought, and of the images written at once.
MATCH_BLOCK = 1 << 20
CODE_BITS, LENGTH_CODE_BITS = 12, 7
#: More than any weight of a prefix code.
HEAVY = np.int64(1) << 60


class Layout:
    """Where the pixels of images lie in one row of all of them."""

    def __init__(self, widths: np.ndarray, heights: np.ndarray):
        self.widths, self.heights = widths, heights
        self.sizes = widths * heights
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.image = np.repeat(np.arange(len(widths)), self.sizes)
        self.place = np.arange(len(self.image)) - self.starts[self.image]
        self.width = widths[self.image]
        self.y = self.place // self.width
        self.x = self.place - self.y * self.width

    def tiles(self, tile: int) -> tuple["Layout", np.ndarray]:
        """The layout of the images' tiles, and the tile of each pixel."""
        under = Layout(-(-self.widths >> tile), -(-self.heights >> tile))
        return under, under.starts[self.image] + (self.y >> tile) * under.widths[self.image] + (self.x >> tile)


class Fields:
    """Bit fields of many images, gathered in order."""

    def __init__(self, images: int):
        self.images = images
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def put(self, values, n: int) -> None:
        """One field in every image."""
        values = np.broadcast_to(np.asarray(values, np.uint64), self.images)
        self.put_all(np.arange(self.images), values, np.full(self.images, n))

    def put_all(self, image: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        """Fields of up to 57 bits, those of one image in their order."""
        self.parts.append((image.astype(np.int32), values.astype(np.uint64), lengths.astype(np.int64)))

    def done(self) -> list[bytes]:
        """The bytes of every image, its fields from the low bits up."""
        image, values, lengths = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(image.astype(np.uint16) if self.images < 1 << 16 else image, kind="stable")
        image, values, lengths = image[order], values[order], lengths[order]
        ends = np.cumsum(lengths)
        last = np.searchsorted(image, np.arange(self.images), side="right") - 1
        ends_of = ends[last]
        bits = np.diff(ends_of, prepend=0)
        words = (bits + 63) // 64 + 1
        first = np.cumsum(words) - words
        at = ends - lengths + (64 * first - ends_of + bits)[image]
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros(int(words.sum()) + 1, np.uint64)
        high = np.where(shift > 0, values >> ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        starts = np.flatnonzero(np.diff(word, prepend=-1))
        out[word[starts]] |= np.bitwise_or.reduceat(values << shift, starts)
        out[word[starts] + 1] |= np.bitwise_or.reduceat(high, starts)
        held = out.tobytes()
        return [held[8 * a : 8 * a + (n + 7) // 8] for a, n in zip(first.tolist(), bits.tolist())]


def _depths(weights: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Depths of the leaves of trees of least cost: a column each of ``many`` weights in rising order, most of them first."""
    most, trees = weights.shape
    tree = np.arange(trees)
    leaf = np.concatenate([weights, np.full((2, trees), HEAVY)]).ravel()
    node = np.full((most + 2, trees), HEAVY)
    nodes, leaves = node.ravel(), np.zeros((most - 1, trees), np.int64)
    at_leaf, at_node = tree.copy(), tree.copy()  # where the lightest leaf and node of each tree lie
    alive = np.searchsorted(-many, -np.arange(2, most + 1), side="right").tolist()
    for step, n in enumerate(alive):
        a, b = at_leaf[:n], at_node[:n]
        x, y = leaf.take(a), nodes.take(b)
        u, v = leaf.take(a + trees), nodes.take(b + trees)
        # The two lightest: two leaves, one, or none.
        taken = leaves[step, :n]
        np.subtract((u <= y).view(np.int8), (v < x).view(np.int8), out=taken, casting="unsafe")
        taken += 1
        np.minimum(x + np.minimum(u, y), y + v, out=node[step, :n])
        taken = taken * trees
        a += taken
        b += 2 * trees - taken
    # A leaf's parent is the step that took it; so is a node's.
    steps = np.arange(most - 1)
    by_tree = leaves.T
    alive_at = steps < (many - 1)[:, None]
    owner, step = np.nonzero(alive_at)
    took = by_tree[alive_at]
    leaf_parent, node_parent = np.repeat(step, took), np.repeat(step, 2 - took)
    leaf_owner, node_owner = np.repeat(owner, took), np.repeat(owner, 2 - took)
    begin = np.cumsum(many) - many
    above = np.zeros((most, trees), np.int64)
    place = np.arange(len(node_owner)) - (np.cumsum(many - 2) - many + 2)[node_owner]
    above[place, node_owner] = node_parent * trees + node_owner
    depth = np.zeros((most, trees), np.int64)
    flat = depth.ravel()
    for k in range(most - 3, -1, -1):  # the last node of a tree is its root
        n = alive[k + 1]
        np.add(flat.take(above[k, :n]), 1, out=depth[k, :n])
    out = np.zeros((most, trees), np.int64)
    out[np.arange(len(leaf_owner)) - begin[leaf_owner], leaf_owner] = flat[leaf_parent * trees + leaf_owner] + 1
    return out


def _shortened(lengths: np.ndarray, most: int) -> np.ndarray:
    """Falling lengths of a whole code, with none above ``most``: the longest pairs move up, as in JPEG's annex K.3."""
    held = np.bincount(lengths).tolist()
    for n in range(len(held) - 1, most, -1):
        while held[n]:
            k = n - 2
            while not held[k]:
                k -= 1
            held[n] -= 2
            held[n - 1] += 1
            held[k + 1] += 2
            held[k] -= 1
    return np.repeat(np.arange(len(held)), held)[::-1]


def code_lengths(counts: np.ndarray, code: np.ndarray, codes: int, most: int) -> np.ndarray:
    """Lengths of prefix codes for positive counts of symbols, ``code`` rising; none is longer than ``most``."""
    out = np.ones(len(counts), np.int64)
    many = np.bincount(code, minlength=codes)
    order = np.argsort(counts + (code << 40), kind="stable")
    begin = np.cumsum(many) - many
    column = np.argsort(-many, kind="stable")
    column = column[many[column] > 2]
    if not len(column):
        return out
    n = many[column]
    rank = np.arange(n[0])[:, None]
    inside = rank < n
    where = (begin[column] + rank)[inside]
    weights = np.full(inside.shape, HEAVY)
    weights[inside] = counts[order[where]]
    depths = _depths(weights, n)
    for k in np.flatnonzero(depths[0] > most).tolist():  # the lightest is as deep as any
        depths[: n[k], k] = _shortened(depths[: n[k], k], most)
    out[order[where]] = depths[inside]
    return out


_BACK = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << 15)], np.uint64)


def codes_of(lengths: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray]:
    """Canonical codes of the symbols, ready to be written, and the bits each takes; a lone symbol takes none."""
    out, bits = np.zeros(len(lengths), np.uint64), np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(np.bincount(code, minlength=codes)[code] > 1)
    order = used[np.argsort(code[used] * 16 + lengths[used], kind="stable")]
    n = lengths[order]
    # Each code is the sum of the shares of those before it; the shares of a code fill it.
    share = np.int64(1) << (15 - n)
    first = ((np.cumsum(share) - share) & ((1 << 15) - 1)) >> (15 - n)
    out[order] = _BACK[first] >> (15 - n).astype(np.uint64)
    bits[order] = n
    return out, bits


def _descriptions(lengths: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code, value and length of the fields that describe the lengths of ``codes`` alphabets; ``lengths`` are ``(code, length)`` rows."""
    code, length = lengths
    # Runs: a length, then repeats of it (16) or of zero (17, 18).
    starts = np.flatnonzero((np.diff(length, prepend=-1) != 0) | (np.diff(code, prepend=-1) != 0))
    n, value, owner = np.diff(starts, append=len(length)), length[starts], code[starts]
    some = value > 0
    n = n - some
    most = np.where(some, 6, 138)
    whole, rest = n // most, n % most
    ends = np.where(rest >= 3, 1, rest)
    parts = some + whole + ends
    run = np.repeat(np.arange(len(n)), parts)
    at = np.arange(len(run)) - (np.cumsum(parts) - parts)[run] - some[run]
    take = np.where(at < 0, 1, np.where(at < whole[run], most[run], np.where(rest[run] >= 3, rest[run], 1)))
    value, owner = value[run], owner[run]
    plain = take < 3
    kind = np.where(value > 0, 0, np.where(take <= 10, 1, 2))
    symbol = np.where(plain, value, 16 + kind)
    extra = np.where(plain, 0, take - np.array([3, 3, 11])[kind])
    extra_n = np.where(plain, 0, np.array([2, 3, 7])[kind])
    counts = np.bincount(owner * 19 + symbol, minlength=19 * codes)
    used = np.flatnonzero(counts)
    own = np.zeros(19 * codes, np.int64)
    own[used] = code_lengths(counts[used], used // 19, codes, LENGTH_CODE_BITS)
    value_of, bits_of = np.zeros(19 * codes, np.uint64), np.zeros(19 * codes, np.int64)
    value_of[used], bits_of[used] = codes_of(own[used], used // 19, codes)
    ordered = own.reshape(codes, 19)[:, CODE_LENGTH_ORDER]
    many = np.maximum(4, 19 - np.argmax(ordered[:, ::-1] > 0, axis=1))
    heads, head_n = np.zeros((codes, 22), np.int64), np.zeros((codes, 22), np.int64)
    heads[:, 1], heads[:, 2:21] = many - 4, ordered
    head_n[:, 0], head_n[:, 1], head_n[:, 2:21] = 1, 4, 3 * (np.arange(19) < many[:, None])
    head_n[:, 21] = 1  # lengths for the whole alphabet
    at = owner * 19 + symbol
    body = value_of[at] | extra.astype(np.uint64) << bits_of[at].astype(np.uint64)
    return (
        np.concatenate([np.repeat(np.arange(codes), 22), owner]),
        np.concatenate([heads.ravel().astype(np.uint64), body]),
        np.concatenate([head_n.ravel(), bits_of[at] + extra_n]),
    )


def _put_codes(f: Fields, counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Describe the prefix codes of alphabets in a row, five an image; the codes of their symbols and the bits these take."""
    codes = len(sizes)
    first = np.cumsum(sizes) - sizes
    used = np.flatnonzero(counts)
    code = np.repeat(np.arange(codes), sizes)[used]
    length = code_lengths(counts[used], code, codes, CODE_BITS)
    values, bits = np.zeros(len(counts), np.uint64), np.zeros(len(counts), np.int64)
    values[used], bits[used] = codes_of(length, code, codes)
    many = np.bincount(code, minlength=codes)
    begin = np.cumsum(many) - many
    low, high = np.zeros(codes, np.int64), np.zeros(codes, np.int64)
    some = np.flatnonzero(many)
    low[some] = used[begin[some]] - first[some]
    high[some] = used[begin[some] + many[some] - 1] - first[some]
    simple = (many <= 2) & (high < 256)
    two = many == 2
    short = np.stack([np.ones_like(low), two, np.ones_like(low), low, np.where(two, high, 0)], 1)
    short_n = np.stack([np.full_like(low, n) for n in (1, 1, 1, 8, 8)], 1) * np.stack([np.ones_like(two)] * 4 + [two], 1)
    of = np.flatnonzero(simple)
    keys, vs, ns = [np.repeat(of, 5)], [short[of].ravel().astype(np.uint64)], [short_n[of].ravel()]
    of = np.flatnonzero(~simple)
    if len(of):
        whole = np.zeros(len(counts), np.int64)
        whole[used] = length
        mine = np.repeat(~simple, sizes)
        k, v, n = _descriptions((np.repeat(np.arange(len(of)), sizes[of]), whole[mine]), len(of))
        keys.append(of[k])
        vs.append(v)
        ns.append(n)
    key = np.concatenate(keys)
    order = np.argsort(key.astype(np.uint16) if codes < 1 << 16 else key, kind="stable")
    f.put_all(key[order] // 5, np.concatenate(vs)[order], np.concatenate(ns)[order])
    return values, bits


def _prefixes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, extra bits and their number of lengths or distance codes from 1 on."""
    x = values - 1
    high = np.maximum(np.frexp(x.astype(np.float64))[1] - 1, 0)
    small = x < 4
    n = np.where(small, 0, high - 1)
    symbol = np.where(small, x, 2 * high + ((x >> np.maximum(high - 1, 0)) & 1))
    return symbol, x & ((1 << n) - 1), n


@lru_cache(maxsize=64)
def _near(width: int) -> np.ndarray:
    """Short codes of distances, 0 where there is none."""
    found: dict[int, int] = {}
    for code, (x, y) in enumerate(NEAR_PLACES, 1):
        found.setdefault(max(1, x + y * width), code)
    out = np.zeros(max(found) + 2, np.int64)
    out[list(found)] = list(found.values())
    return out


def _last_equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places, and for each the last place before it with an equal key; of up to 2^20 places.

    Keys and places are sorted as one number, so keys are cut to 44 bits of a hash; what only these bits
    make equal falls, and then hides an equal key before it.
    """
    place = np.uint64((1 << 20) - 1)
    tagged = np.sort((keys * np.uint64(0x9E3779B97F4A7C15)) & ~place | np.arange(len(keys), dtype=np.uint64))
    again = (tagged[1:] ^ tagged[:-1]) <= place
    here, last = (tagged[1:][again] & place).astype(np.int64), (tagged[:-1][again] & place).astype(np.int64)
    same = keys[here] == keys[last]
    return here[same], last[same]


def _cached(pixels: np.ndarray, keys: np.ndarray, image: np.ndarray) -> np.ndarray:
    """Whether the colour cache holds each pixel: the last pixel before it with its key is the same."""
    order = np.sort(keys.astype(np.uint64) << np.uint64(40) | np.arange(len(keys), dtype=np.uint64))
    place = (order & np.uint64((1 << 40) - 1)).astype(np.int64)
    here, last = place[1:], place[:-1]
    hit = (keys[here] == keys[last]) & (pixels[here] == pixels[last]) & (image[here] == image[last])
    out = np.zeros(len(keys), bool)
    out[here[hit]] = True
    return out


def references(px: np.ndarray, at: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy starts, lengths and distances of repeats within the images: of 8 pixels at least, or 2 if not only green differs."""
    none = np.zeros(0, np.int64)
    green_only = np.bitwise_or.reduceat((px ^ px[at.starts[at.image]]) & np.uint32(0xFFFF00FF), at.starts) == 0
    least = np.where(green_only, 8, 2)
    key = np.zeros(len(px), np.uint64)
    wide = px.astype(np.uint64)
    if not green_only.all():
        key[:-1] = wide[:-1] | wide[1:] << np.uint64(32)
    if green_only.any():
        green = (wide >> np.uint64(8)) & np.uint64(255)
        eight = np.zeros(len(px) + 8, np.uint64)
        eight[: len(px)] = green
        for n in (1, 2, 4):  # 2, then 4, then 8 samples from each place on
            eight[: len(px)] |= eight[n : len(px) + n] << np.uint64(8 * n)
        key = eight[: len(px)] if green_only.all() else np.where(green_only[at.image], eight[: len(px)], key)
    inside = np.flatnonzero(at.place + least[at.image] <= at.sizes[at.image])
    found, last = [none], [none]
    for low in range(0, len(inside), MATCH_BLOCK):
        where = inside[low : low + MATCH_BLOCK]
        a, b = _last_equal(key[where])
        found.append(where[a])
        last.append(where[b])
    found, last = np.concatenate(found), np.concatenate(last)
    good = (at.image[found] == at.image[last]) & (found - last <= MOST_DISTANCE)
    found, last = found[good], last[good]
    if not len(found):
        return none, none, none
    order = np.argsort(found)
    found, distance = found[order], (found - last)[order]
    # A run of neighbours at one distance is one repeat.
    edge = np.flatnonzero((np.diff(found) != 1) | (np.diff(distance) != 0))
    run_ends = np.append(edge, len(found) - 1)
    ends = found[run_ends] + least[at.image[found[run_ends]]]
    ends = np.repeat(ends, np.diff(run_ends, prepend=-1))
    after, many = np.searchsorted(found, ends).tolist(), len(found)
    chain, k = [], 0
    while k < many:
        chain.append(k)
        k = after[k]
    start, length, distance = found[chain], ends[chain] - found[chain], distance[chain]
    parts = -(-length // MOST_LENGTH)
    if (parts > 1).any():
        which = np.repeat(np.arange(len(start)), parts)
        before = (np.arange(len(which)) - (np.cumsum(parts) - parts)[which]) * MOST_LENGTH
        start, distance = start[which] + before, distance[which]
        length = np.minimum(length[which] - before, MOST_LENGTH)
    return start, length, distance


def put_images(f: Fields, px: np.ndarray, at: Layout, cache_bits: np.ndarray | None, main: bool) -> None:
    """Entropy-coded images: literals, references and, with ``cache_bits``, places of the colour cache."""
    images = len(at.sizes)
    kind = np.zeros(len(px), np.uint8)  # 0 literal, 1 inside a reference, 2 its start, 3 in the cache
    green = ((px >> 8) & 255).astype(np.int64)
    f.put(int(cache_bits is not None), 1)
    sizes = np.tile([280, 256, 256, 256, 40], (images, 1))
    if cache_bits is not None:
        f.put(cache_bits, 4)
        sizes[:, 0] += 1 << cache_bits
        keys = (px * np.uint32(CACHE_FACTOR)) >> (32 - cache_bits).astype(np.uint32)[at.image]
        hit = _cached(px, keys, at.image)
        kind[hit] = 3
        green = np.where(hit, 280 + keys.astype(np.int64), green)
    start = np.zeros(0, np.int64)
    if main:
        f.put(0, 1)  # one group of codes
        start, length, distance = references(px, at)
    first = (np.cumsum(sizes) - sizes.ravel()).reshape(images, 5)
    if len(start):
        inside = np.repeat(start - np.cumsum(length) + length, length) + np.arange(length.sum())
        kind[inside] = 1
        kind[start] = 2
        code, width = distance + 120, at.width[start]
        for w in np.unique(width).tolist():
            near, mine = _near(w), np.flatnonzero(width == w)
            short = near[np.minimum(distance[mine], len(near) - 1)]
            code[mine] = np.where(short > 0, short, code[mine])
        len_symbol, len_extra, len_n = _prefixes(length)
        dist_symbol, dist_extra, dist_n = _prefixes(code)
        green[start] = 256 + len_symbol
        dist_symbol = dist_symbol + first[at.image[start], 4]
    token = np.flatnonzero(kind != 1)
    kinds, image = kind[token], at.image[token]
    symbols = green[token] + first[image, 0]
    literal = np.flatnonzero(kinds == 0)
    lit, owner = px[token[literal]], image[literal]
    channels = [((lit >> np.uint32(s)) & np.uint32(255)) + first[owner, k] for k, s in ((1, 16), (2, 0), (3, 24))]  # red, blue, alpha
    counts = np.bincount(np.concatenate([symbols, *channels, dist_symbol] if len(start) else [symbols, *channels]), minlength=int(sizes.sum()))
    # One code for two channels that both need one.
    red, blue = (first[:, k, None] + np.arange(256) for k in (1, 2))
    both = np.flatnonzero(np.minimum(np.count_nonzero(counts[red], axis=1), np.count_nonzero(counts[blue], axis=1)) > 8)
    counts[red[both]] += counts[blue[both]]
    counts[blue[both]] = counts[red[both]]
    codes, bits = _put_codes(f, counts, sizes.ravel())
    values, lengths = codes[symbols], bits[symbols]
    v, n = values[literal], lengths[literal]
    for channel in channels:
        v |= codes[channel] << n.astype(np.uint64)
        n = n + bits[channel]
    values[literal], lengths[literal] = v, n
    if len(start):
        where = np.flatnonzero(kinds == 2)
        v, n = values[where], lengths[where]
        for value, more in ((len_extra, len_n), (codes[dist_symbol], bits[dist_symbol]), (dist_extra, dist_n)):
            v |= value.astype(np.uint64) << n.astype(np.uint64)
            n = n + more
        values[where], lengths[where] = v, n
    f.put_all(image, values, lengths)


def _cheapest(candidates: list[np.ndarray], at: Layout, under: Layout, tile_of: np.ndarray) -> np.ndarray:
    """Per tile the number of the candidate whose samples cost least under a code for their image, the first of equal ones."""
    sums, tiles = [], len(under.image)
    low = (tile_of << 8)[:, None]
    for samples in candidates:
        held = np.bincount((low + samples.reshape(len(samples), -1)).ravel(), minlength=256 * tiles).reshape(tiles, 256)
        counts = np.add.reduceat(held, under.starts, axis=0) + 0.1
        # Whole 1/4096 bits: a sum is the same in any order.
        cost = np.rint(-4096 * np.log2(counts / counts.sum(axis=1)[:, None])).astype(np.int64)
        sums.append(np.einsum("ij,ij->i", held, cost[under.image]))
    return np.argmin(np.stack(sums), axis=0)


def with_predictor(pixels: np.ndarray, at: Layout, under: Layout, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Residuals and the modes of the tiles, each the cheapest of those that whole rows can invert."""
    argb = pixels.view(np.uint32)[:, 0]
    here = np.arange(len(argb))

    def behind(places) -> np.ndarray:
        return argb[np.maximum(here - places, 0)].view(np.uint8).reshape(-1, 4)

    # The last pixel of a row has the first of its own row to the top right.
    left, top, top_left, top_right = behind(1), behind(at.width), behind(at.width + 1), behind(at.width - 1)
    edge = np.flatnonzero((at.x == 0) | (at.y == 0))
    given = np.where((at.x[edge] == 0)[:, None], top[edge], left[edge])
    given[at.place[edge] == 0] = BLACK
    residuals = []
    for mode in ROW_MODES:
        guess = np.array(_predict(mode, left, top, top_left, top_right), np.uint8)
        guess[edge] = given
        residuals.append(pixels - guess)
    chosen = _cheapest(residuals, at, under, tile_of)
    by_pixel, out = chosen[tile_of], residuals[0]
    for k in range(1, len(ROW_MODES)):
        if len(mine := np.flatnonzero(by_pixel == k)):
            out[mine] = residuals[k][mine]
    return out, np.array(ROW_MODES, np.uint8)[chosen]


#: Factors tried by the cross-colour transform, in 1/32, and what each takes from a sample.
FACTORS = (0, 8, 32, 248)
_DELTAS = [colour_delta(np.full(256, x, np.uint8), np.arange(256).astype(np.uint8)).astype(np.uint8) for x in FACTORS]


def with_cross_colour(pixels: np.ndarray, at: Layout, under: Layout, tile_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels and the factors of the tiles: green to red, then green to blue, then red to blue."""
    factors = np.zeros((len(under.image), 4), np.uint8)
    factors[:, 0] = 255
    out = pixels.copy()
    for place, channel, by in ((3, 1, 2), (2, 3, 2), (1, 3, 1)):
        tried = [out[:, channel] - deltas[pixels[:, by]] for deltas in _DELTAS]
        chosen = _cheapest(tried, at, under, tile_of)
        factors[:, place] = np.array(FACTORS, np.uint8)[chosen]
        out[:, channel] = np.choose(chosen[tile_of], tried)
    return out, factors


def with_palette(f: Fields, pixels: np.ndarray, at: Layout) -> tuple[np.ndarray, Layout]:
    """Places in the images' palettes, which are described; small palettes put several into one pixel."""
    images = len(at.sizes)
    # Green, as the only sample that differs, needs no sorting.
    argb = joined(pixels)
    if ((argb ^ argb[0]) & np.uint32(0xFFFF00FF)).any():
        colours, index = np.unique(at.image.astype(np.uint64) << np.uint64(32) | argb, return_inverse=True)
        owner, colours = (colours >> np.uint64(32)).astype(np.int64), colours.astype(np.uint32)
    else:
        where = at.image << 8 | pixels[:, 2]
        held = np.bincount(where, minlength=256 * images) > 0
        index = (np.cumsum(held) - 1)[where]
        owner, green = np.divmod(np.flatnonzero(held), 256)
        colours = (argb[0] & np.uint32(0xFFFF00FF)) | (green << 8).astype(np.uint32)
    many = np.bincount(owner, minlength=images)
    if many.max() > 256:
        raise ValueError("a palette holds at most 256 colours")
    f.put(many - 1, 8)
    table = colours.astype(">u4").view(np.uint8).reshape(-1, 4)
    of = Layout(many, np.ones_like(many))
    steps = table.copy()
    steps[1:] -= table[:-1]
    steps[of.starts] = table[of.starts]
    put_images(f, joined(steps), of, None, False)
    index = index - of.starts[at.image]
    pack = np.select([many <= 2, many <= 4, many <= 16], [3, 2, 1], 0)
    if pack.any():
        held, by = Layout(-(-at.widths >> pack), at.heights), pack[at.image]
        where = held.starts[at.image] + at.y * held.widths[at.image] + (at.x >> by)
        index = np.bincount(where, index << ((8 >> by) * (at.x & ((1 << by) - 1)))).astype(np.uint8)
        at = held
    out = np.zeros((len(index), 4), np.uint8)
    out[:, 0], out[:, 2] = 255, index
    return out, at


def encode(pixels: np.ndarray, transforms: tuple[int, ...] = (), cache: bool = True, alpha: bool = True, tile: int = 5) -> bytes:
    """A lossless WebP file of ``(height, width, 4)`` bytes alpha, red, green, blue.

    ``transforms`` are applied in their order; a palette comes alone and holds at most 256 colours.
    """
    height, width, _ = pixels.shape
    return encode_all(pixels.reshape(-1, 4), np.array([width]), np.array([height]), transforms, cache, alpha, tile)[0]


def encode_all(
    pixels: np.ndarray, widths: np.ndarray, heights: np.ndarray, transforms: tuple[int, ...] = (), cache: bool = True, alpha: bool = True, tile: int = 5
) -> list[bytes]:
    """Files as ``encode`` makes them, of images of one kind whose pixels follow each other."""
    at, pixels = Layout(widths, heights), np.ascontiguousarray(pixels)
    f = Fields(len(widths))
    for value, n in ((0x2F, 8), (widths - 1, 14), (heights - 1, 14), (int(alpha), 1), (0, 3)):
        f.put(value, n)
    for kind in transforms:
        f.put(1, 1)
        f.put(kind, 2)
        if kind == PALETTE:
            pixels, at = with_palette(f, pixels, at)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            f.put(tile - 2, 3)
            under, tile_of = at.tiles(tile)
            pixels, table = (with_predictor if kind == PREDICTOR else with_cross_colour)(pixels, at, under, tile_of)
            if kind == PREDICTOR:
                modes, table = table, np.zeros((len(table), 4), np.uint8)
                table[:, 0], table[:, 2] = 255, modes
            put_images(f, joined(table), under, None, False)
    f.put(0, 1)
    bits = None
    if cache:
        bits = np.clip(np.frexp(at.sizes.astype(np.float64))[1] - 2, 1, 10)
    put_images(f, joined(pixels), at, bits, True)
    return [_file(chunk) for chunk in f.done()]


def _file(chunk: bytes) -> bytes:
    size = len(chunk)
    chunk += b"\0" * (size & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(chunk)) + b"WEBPVP8L" + struct.pack("<I", size) + chunk
