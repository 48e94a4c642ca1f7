"""Best-fit packing planned on a histogram of lengths.

Texts become token pieces of at most ``capacity`` ids.  Best-fit decreasing runs on the
driver over the counts per length (``capacity`` numbers, whatever the corpus), placing
whole runs of equal pieces into runs of equal sequences.  Each piece then takes its
slot by its rank among the pieces of its length.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_batches, text_bytes, with_rank
from .tokens import _PLAIN_TEXT, byte_marks, load, vocabulary_path

PACK_VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 1024
END_ID = 2
#: Tasks over which the pieces of one length are dealt by hash.
SPREAD = 256


class TokenIds:
    """Ids as the library's defaults give them.

    Plain texts go through the same vocabulary and split pattern in a faster library;
    texts with special strings or with characters on which Unicode versions may differ go
    through the vocabulary's own.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        self.tokenizer = load(path)
        back = {c: b for b, c in byte_marks().items()}
        ranks = {bytes(back[c] for c in t): i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, specials)) or r"(?!)")

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN_TEXT.fullmatch(text) and not self.special.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def token_ids(path: str) -> TokenIds:
    return TokenIds(path)


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: each text's ids and the end id, cut.

    Only sequences longer than ``capacity`` are cut; the first piece takes the remainder.
    """
    path = path or vocabulary_path(PACK_VOCABULARY)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = token_ids(path)
        row, piece, start, length, crc = [], [], [], [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            ids = np.append(encode(text.decode()), END_ID).astype("<u4")
            raw, n = ids.tobytes(), len(ids)
            at, k = 0, 0
            while at < n:
                size = (n - at) % capacity or capacity
                row.append(i)
                piece.append(k)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                at, k = at + size, k + 1
        ids = batch.column(0).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
            ["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        fn,
        "doc_id long, piece int, start long, length long, ids_crc32 long",
    )


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    Returns runs ``(length, low, high, sequence, each, offset)``: the pieces of ``length``
    with rank ``low <= r < high`` go, ``each`` to a sequence, into the sequences from
    ``sequence`` on, at ``offset``, ``offset + length``, ...
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free space -> [(first sequence, sequences)]
    spaces: list[int] = []
    opened = 0
    runs = []

    def give(free: int, first: int, n: int) -> None:
        if free and n:
            if free not in room:
                room[free] = []
                insort(spaces, free)
            room[free].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(spaces, length)
            if at < len(spaces):
                free = spaces[at]
                first, n = room[free].pop()
                if not room[free]:
                    del room[free], spaces[at]
            else:
                free = capacity
                first, n = opened, -(-left // (capacity // length))
                opened += n
            each = free // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, rank + full * each, first, each, capacity - free))
                give(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < n:  # fewer pieces left than the next sequence takes
                runs.append((length, rank, rank + left, first + full, left, capacity - free))
                give(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            give(free, first + full, n - full)
    return runs


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack every text into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per
    piece.  Null and empty texts are their end id alone.  Null and repeated ids: every
    row is packed on its own.  Equal lengths go by id, then content; identical rows are
    interchangeable.  An empty table packs into nothing.  Other columns are not read.
    """
    spark = docs.sparkSession
    cut = durable(pieces(docs, path, capacity), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = best_fit(counts, capacity)
    # At most one row per length and free space: bounded by the capacity, not the data.
    plan = spark.createDataFrame(runs, "l long, low long, high long, sequence long, each long, at long")
    spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SPREAD))
    ranked = with_rank(cut, ["length"], [spread], [F.col("doc_id"), F.col("piece"), F.col("ids_crc32")])
    placed = ranked.join(F.broadcast(plan), F.expr("length = l and rank >= low and rank < high"))
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.expr("sequence + (rank - low) div each").alias("sequence_id"),
        F.expr("at + ((rank - low) % each) * length").alias("offset"),
    )
