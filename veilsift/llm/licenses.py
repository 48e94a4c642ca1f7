"""License scans: MinHash bands over overlapping windows, then exact containment.

A template of ``L`` words is searched with windows of ``L + step`` words that start every
``step = max(1, L // 4)`` words, so that each stretch of ``L`` words lies whole in some window.
Such a stretch that holds ``least`` of the template's shingles makes their Jaccard
similarity at least ``floor_similarity``; with ``BANDS`` bands of one MinHash value the
window misses its template with probability ``(1 - s) ** BANDS`` only.  Every window and
template that share a band are verified on their exact shingles.

Words are runs of ASCII letters, digits and bytes beyond ASCII, so punctuation and comment marks
say nothing.  Windows are searched for the templates only of which the whole text has ``least``
shingles, found in one table of all templates' shingles: no window of another text can have them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes
from .license_texts import TEXTS
from .minhash import _WORDS, _mix, _odd

WIDTH = 5
NUM, DEN = 80, 100
#: Most chance that a window with enough of a template shares no band with it.
MISS = 1e-4
_U = np.uint64


#: A-Z in lower case; every ASCII byte but letters and digits parts words.
_PLAIN = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


@dataclass(frozen=True)
class Template:
    name: str
    text: str


#: Short notices and standard headers by which texts state a public licence.
NOTICES = (
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("MIT", "Released under the MIT License."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template(
        "Apache-2.0-header",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with'
        " the License. You may obtain a copy of the License at",
    ),
    Template(
        "MIT-grant",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        ' documentation files (the "Software"), to deal in the Software without restriction',
    ),
    Template(
        "BSD-grant",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
        " following conditions are met:",
    ),
    Template("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    *(
        Template(
            f"{name}-header",
            f"terms of the GNU {kind}General Public License as published by the Free Software Foundation, either version {version} of the License",
        )
        for name, kind, version in (
            ("GPL-2.0", "", "2"),
            ("GPL-3.0", "", "3"),
            ("LGPL-2.1", "Lesser ", "2.1"),
            ("LGPL-3.0", "Lesser ", "3"),
            ("AGPL-3.0", "Affero ", "3"),
        )
    ),
    Template("MPL-2.0-header", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

#: What stands after "under" or "terms of" in short notices.  With at most eight words, four shingles, a notice
#: has to be there word for word, so that no version passes for another.
NAMED = {
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "the Apache License v2.0"),
    "MIT": ("the MIT License", "the MIT licence", "an MIT license", "MIT license", "a MIT license"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License"),
    "CC-BY-4.0": ("CC BY 4.0", "the CC BY 4.0", "a Creative Commons Attribution 4.0", "the Creative Commons Attribution 4.0"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "the CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0", "the Creative Commons Attribution-ShareAlike 4.0"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "the CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0", "the Creative Commons Attribution-NonCommercial 4.0"),
    "GPL-2.0": ("the GNU General Public License, version 2", "the GNU General Public License v2", "the GNU GPL v2", "the GNU GPLv2", "the GPL version 2", "the GNU GPL version 2"),
    "GPL-3.0": ("the GNU General Public License, version 3", "the GNU General Public License v3", "the GNU GPL v3", "the GNU GPLv3", "the GPL version 3", "the GNU GPL version 3"),
    "MPL-2.0": ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "the Mozilla Public License, v. 2.0"),
}
LEADS = ("licensed", "released", "distributed", "available", "published", "provided", "licenced", "it", "code", "software", "project")


def _wordings() -> tuple[Template, ...]:
    out = []
    for name, phrases in NAMED.items():
        for phrase in phrases:
            for starts in ((f"under {phrase}", [f"{lead} under {phrase}" for lead in LEADS]), (f"of {phrase}", [f"terms of {phrase}", f"the terms of {phrase}"])):
                texts = [starts[0]] if len(words_of(starts[0].encode())) >= WIDTH else starts[1]
                out += [Template(name, t) for t in texts if len(words_of(t.encode())) >= WIDTH]
    return tuple(out)


TEMPLATES = NOTICES + _wordings() + tuple(Template(f"{name}-text", text) for name, text in TEXTS.items())


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """Hashes of the ``width``-word shingles in order; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_WORDS[w] for w in words], np.uint64)
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return acc


@dataclass(frozen=True)
class Size:
    """Templates of one number of shingles: their windows and band tables."""

    shingles: int
    step: int
    names: tuple[str, ...]
    sets: tuple[frozenset, ...]
    odd: np.ndarray
    values: np.ndarray  # (templates, bands)


def floor_similarity(shingle_count: int, step: int) -> float:
    """Least Jaccard of a template and a window that holds enough of it."""
    need = -(-NUM * shingle_count // DEN)
    return need / (shingle_count + step + shingle_count - need)


def bands_for(shingle_count: int, step: int, miss: float = MISS) -> int:
    """Bands of one value so that ``(1 - similarity) ** bands < miss``."""
    return int(np.ceil(np.log(miss) / np.log(max(1e-12, 1 - floor_similarity(shingle_count, step)))))


@lru_cache(maxsize=4)
def sizes(templates: tuple[Template, ...]) -> tuple[Size, ...]:
    by: dict[int, list] = {}
    for t in templates:
        s = shingles(t.text.encode())
        if len(s):
            by.setdefault(len(np.unique(s)), []).append((t.name, np.unique(s)))
    out = []
    for n, members in sorted(by.items()):
        step = max(1, n // 4)
        odd = _odd(41 + n, bands_for(n, step))
        values = np.array([(_mix(s)[:, None] * odd).min(axis=0) for _, s in members])
        out.append(Size(n, step, tuple(m[0] for m in members), tuple(frozenset(m[1].tolist()) for m in members), odd, values))
    return tuple(out)


@dataclass(frozen=True)
class Index:
    """All templates: their shingles in one sorted table, and who owns each."""

    sizes: tuple[Size, ...]
    table: np.ndarray
    starts: np.ndarray  # owners of table[i] are owner[starts[i] : starts[i + 1]]
    owner: np.ndarray
    least: np.ndarray

    def possible(self, s: np.ndarray) -> np.ndarray:
        """Which templates, in the order of ``sizes``, have enough shingles among ``s``."""
        if not len(self.table):
            return np.zeros(len(self.least), bool)
        at = np.searchsorted(self.table, s)
        at[at == len(self.table)] = 0
        held = np.unique(at[self.table[at] == s])
        if not len(held):
            return np.zeros(len(self.least), bool)
        owners = np.concatenate([self.owner[self.starts[i] : self.starts[i + 1]] for i in held.tolist()])
        return np.bincount(owners, minlength=len(self.least)) >= self.least


@lru_cache(maxsize=4)
def index(templates: tuple[Template, ...]) -> Index:
    by_size = sizes(templates)
    sets = [s for size in by_size for s in size.sets]
    least = np.array([-(-NUM * len(s) // DEN) for s in sets], np.int64)
    values = np.array([x for s in sets for x in s], np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    table, starts = np.unique(values[order], return_index=True)
    return Index(by_size, table, np.append(starts, len(values)), owner[order], least)


def _window_minima(hashes: np.ndarray, length: int) -> np.ndarray:
    """Minimum over each ``length`` rows in a row, by doubling."""
    span, low = 1, hashes
    while 2 * span <= length:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < length:
        low = np.minimum(low[: len(low) - (length - span)], low[length - span :])
    return low


def find(text: bytes, templates: tuple[Template, ...]) -> tuple[int, list[tuple[str, int, int, float]]]:
    """Windows decided, and per template found ``(name, first shingle, last shingle + 1, containment)``.

    Of a template's windows the one with most of its shingles counts, the first on a tie; of the
    templates of one name, the one found with the largest containment, then the longest, then the first.
    """
    return _find(text, index(templates))


def _windows(count: int, step: int, block: int) -> int:
    """How many of ``count`` starts are searched: every ``step``-th of each block, and the last."""
    whole, rest = divmod(count, block)
    if not rest:
        whole, rest = whole - 1, block
    return whole * -(-block // step) + -(-rest // step) + ((rest - 1) % step > 0)


def _find(text: bytes, known: Index) -> tuple[int, list[tuple[str, int, int, float]]]:
    s = shingles(text)
    searched, found = 0, []
    if not len(s):
        return 0, found
    possible, first = known.possible(s), 0
    mixed = _mix(s) if possible.any() else s
    block = 4096  # windows whose band values are held at once
    for size in known.sizes:
        length = min(len(s), size.shingles + size.step)
        searched += _windows(len(s) - length + 1, size.step, block)
        asked = np.flatnonzero(possible[first : first + len(size.names)]).tolist()
        first += len(size.names)
        if not asked:
            continue
        hits: dict[int, set[int]] = {}
        for at in range(0, len(s) - length + 1, block):
            part = mixed[at : at + block + length - 1, None] * size.odd
            low = _window_minima(part, length)
            starts = np.arange(0, len(low), size.step)
            if at + block >= len(s) - length + 1 and (len(low) - 1) % size.step:
                starts = np.append(starts, len(low) - 1)
            low = low[starts]
            for t in asked:
                same = (low == size.values[t]).any(axis=1)
                if same.any():
                    hits.setdefault(t, set()).update((at + starts[same]).tolist())
        for t, windows in sorted(hits.items()):
            best = None
            for w in sorted(windows):
                inside = len(size.sets[t].intersection(s[w : w + length].tolist()))
                if DEN * inside >= NUM * size.shingles and (best is None or inside > best[0]):
                    best = inside, w
            if best:
                found.append((size.names[t], best[1], best[1] + length, best[0] / size.shingles))
    best_of: dict[str, tuple[str, int, int, float]] = {}
    for f in found:
        old = best_of.get(f[0])
        if old is None or (-f[3], f[1] - f[2], f[1]) < (-old[3], old[1] - old[2], old[1]):
            best_of[f[0]] = f
    return searched, sorted(best_of.values())


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_windows, n_licenses, licenses, spans, containment`` of each whole text.

    ``licenses`` are the templates of which some window holds at least 80 % of the
    five-word shingles; ``spans`` gives ``name:first:end`` in shingles.  ``n_windows`` counts the
    windows decided: by the text's shingles as a whole or by bands.  A text or template of
    fewer than five words is one shingle.  Null and empty texts have no window.  Null and
    repeated ids: a row each.  Other columns are not read.
    """

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = index(templates)
        rows = [_find(t, known) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array([n for n, _ in rows], pa.int64()),
                pa.array([len(f) for _, f in rows], pa.int64()),
                pa.array([",".join(x[0] for x in f) for _, f in rows]),
                pa.array([",".join(f"{x[0]}:{x[1]}:{x[2]}" for x in f) for _, f in rows]),
                pa.array([max((x[3] for x in f), default=0.0) for _, f in rows], pa.float64()),
            ],
            ["doc_id", "n_windows", "n_licenses", "licenses", "spans", "containment"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        fn,
        "doc_id long, n_windows long, n_licenses long, licenses string, spans string, containment double",
    )
