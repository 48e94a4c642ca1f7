"""Language-model scoring by the likelihood of a subword lattice.

The pieces are those of an existing vocabulary and are never trained.  A departure from the method as
named: no unigram vocabulary with scores of its own is public here, so the scores start from the order of a
BPE vocabulary and are fitted to the training documents by expectation steps over all segmentations.  A word's probability is the sum over
**all** its segmentations into pieces, by a forward recursion in log space; a text's is the
product over its words and the end.

Corpus counts are joined to texts by blocks: a block's texts ask once for each of
their distinct words, so a word travels once per block and not once per occurrence, and no
task holds more than one block and its words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, durable, partitions_for, text_bytes
from .tokens import vocabulary_path

PIECES = "piece_bpe_32k.model"
HELD_OUT_EVERY = 10
BLOCK_BYTES = 24 << 20
#: Distinct words whose lattices one task builds, whatever the size of the corpus.
TASK_WORDS = 100_000
#: Expectation steps that fit the scores.
STEPS = 2
ADDED = 0.1
LOG10 = math.log(10)
#: Added to every piece's count.
PIECE_PRIOR = 0.1
#: Expected counts are summed as whole multiples of 1 / UNITS: the sum is the same in any order.
UNITS = 1 << 16
START = "▁"
END = "</s>"
_BYTE = re.compile("<0x[0-9A-F]{2}>")


def vocabulary(path: str) -> dict[str, float]:
    """Piece -> initial log score: pieces ranked by the vocabulary's scores, as 1 / rank.

    Byte pieces keep their names ``<0xNN>``; control pieces are left out.  The end of a
    text is the piece ``</s>``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    ranked = sorted(named, key=lambda i: (model.is_byte(i), -model.get_score(i), i))
    scores = {model.id_to_piece(i): -math.log(r + 10) for r, i in enumerate(ranked)}
    return scores | {END: -math.log(10)}


class Lattice:
    """All segmentations of a word over scored pieces.

    The names of the end and of byte pieces stand for themselves in a text, not for those pieces.
    """

    def __init__(self, scores: dict[str, float]):
        self.pieces = {p: s for p, s in scores.items() if p != END and not _BYTE.fullmatch(p)}
        self.single = frozenset(p for p in self.pieces if len(p) == 1)
        self.bytes = [scores[f"<0x{b:02X}>"] for b in range(256)]
        self.found = ahocorasick.Automaton()
        for piece, score in self.pieces.items():
            self.found.add_word(piece, (len(piece), score, piece))
        self.found.make_automaton()

    def _spelled(self, char: str) -> float:
        return sum(self.bytes[b] for b in char.encode())

    def arcs(self, word: str) -> list[list[tuple[int, float, str]]]:
        """``(length, score, piece)`` of the arcs that end with each character of ``START + word``, longest first.

        A character that is no piece has an arc of its bytes.
        """
        s = START + word
        at: list[list[tuple[int, float, str]]] = [[] for _ in s]
        for last, arc in self.found.iter(s):
            at[last].append(arc)
        if not self.single.issuperset(s):
            for char, here in zip(s, at):
                if char not in self.single:
                    here.append((1, self._spelled(char), ""))
        return at

    def forward(self, arcs: list[list[tuple[int, float, str]]]) -> tuple[list[float], list[list[float]]]:
        """Log of the summed probability of all ways to each place, and each arc's part of that sum.

        Parts are relative; their total stands behind them.
        """
        alpha, parts, exp, log, whole = [0.0], [], math.exp, math.log, [1.0, 1.0]
        for end, here in enumerate(arcs, 1):
            if len(here) == 1:
                alpha.append(alpha[end - 1] + here[0][1])
                parts.append(whole)
            else:
                terms = [alpha[end - n] + score for n, score, _ in here]
                top = max(terms)
                weights = [exp(t - top) for t in terms]
                total = sum(weights)
                alpha.append(top + log(total))
                weights.append(total)
                parts.append(weights)
        return alpha, parts

    def log_probability(self, word: str) -> float:
        return self.forward(self.arcs(word))[0][-1]

    def add_expected(self, word: str, weight: int, counts: dict[str, int]) -> None:
        """Add each piece's expected uses over all segmentations, ``weight`` times, to ``counts``.

        Going back from the end, a place hands its weight on to its arcs by their parts in the
        forward sum.  Uses are rounded to whole numbers; less than half a one falls.
        """
        arcs = self.arcs(word)
        parts = self.forward(arcs)[1]
        share = [0.0] * len(arcs) + [float(weight)]
        for end in range(len(arcs), 0, -1):
            here, part = share[end], parts[end - 1]
            if here < 0.5:
                continue
            here /= part[-1]
            for (n, _, piece), p in zip(arcs[end - 1], part):
                used = here * p
                if used >= 0.5:
                    share[end - n] += used
                    if piece:
                        counts[piece] += int(used + 0.5)
                    else:
                        for b in (START + word)[end - 1].encode():
                            counts[f"<0x{b:02X}>"] += int(used + 0.5)

    def best(self, word: str) -> list[str]:
        """The likeliest segmentation."""
        s, arcs = START + word, self.arcs(word)
        n = len(s)
        score, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
        for end in range(1, n + 1):
            for length, one, _ in arcs[end - 1]:
                if score[end - length] + one > score[end]:
                    score[end], back[end] = score[end - length] + one, end - length
        out, at = [], n
        while at:
            piece = s[back[at] : at]
            if piece in self.pieces:
                out.append(piece)
            else:
                out += [f"<0x{b:02X}>" for b in reversed(piece.encode())]
            at = back[at]
        return out[::-1]


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def split_words(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Where each text's words start, and the words of all texts in a row.

    Arrow's split keeps an empty string where a text begins or ends with a space, and one for an
    empty text, so that no text is without a place.
    """
    lower = pc.ascii_lower(texts.combine_chunks().cast(pa.large_string()))
    parts = pc.ascii_split_whitespace(lower)
    return parts.offsets.to_numpy()[:-1].astype(np.int64), parts.values


def _as_text(word: bytes) -> str:
    return word.decode()


def dealt_words(words: DataFrame, distinct: int) -> DataFrame:
    """``words`` over tasks of about ``TASK_WORDS``: a scan would put a table so narrow into few tasks."""
    return words.repartition(partitions_for(distinct, TASK_WORDS), "word")


def refitted_scores(words: DataFrame, ends: int, scores: dict[str, float]) -> dict[str, float]:
    """Log scores of the pieces after one expectation step over the training counts ``(word, c)``.

    Every distinct word's expected pieces count as often as the word.  What reaches the driver has a
    row per piece of the vocabulary.
    """
    sent = words.sparkSession.sparkContext.broadcast(scores)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, counts = Lattice(sent.value), dict.fromkeys(sent.value, 0)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lattice.add_expected(_as_text(word), c * UNITS, counts)
        counts = {p: n for p, n in counts.items() if n}
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["piece", "n"]
        )

    used = words.where("c > 0").select("word", "c").mapInArrow(fn, "piece string, n long")
    counts = {r["piece"]: r["n"] / UNITS for r in used.groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    counts[END] = ends
    total = math.log(math.fsum(counts.values()) + PIECE_PRIOR * len(scores))
    return {p: math.log(counts.get(p, 0) + PIECE_PRIOR) - total for p in scores}


def score(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, steps: int = STEPS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each text.

    Texts whose ``crc32(doc_id as text) % 10`` is 0 are held out; all others train.  Null and
    empty texts are their end alone.  A null id counts as the empty id text.  Repeated
    ids: a row each.  Without training texts the counts are 0.  Words beyond the vocabulary's
    characters are spelled in bytes, so every text has a score.  Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    path = path or vocabulary_path(PIECES)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    table = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.crc32(key.cast("binary")) % HELD_OUT_EVERY == 0).alias("held_out"),
        text_bytes(),
    )
    size, ends = table.agg(
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.coalesce(F.sum((~F.col("held_out")).cast("long")), F.lit(0))
    ).first()
    blocks = partitions_for(size, block_bytes)
    blocked = table.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))

    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, Counter] = {}
        for batch in batches:
            for block, held, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                counts = seen.setdefault(block, Counter())
                words = words_of(text)
                if held:
                    for w in words:
                        if w not in counts:
                            counts[w] = 0
                else:
                    counts.update(words)
        for block, counts in seen.items():
            words, ns = list(counts), list(counts.values())
            for at in range(0, len(words), 50_000):
                part = words[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * len(part), pa.int32()), pa.array(part, pa.binary()), pa.array(ns[at : at + 50_000], pa.int64())],
                    ["block", "word", "n"],
                )

    per_block = (
        blocked.select("block", "held_out", "text")
        .repartitionById(blocks, "block")
        .mapInArrow(distinct_words, "block int, word binary, n long")
    )
    asked = durable(per_block, "block-words")
    words = durable(asked.groupBy("word").agg(F.sum("n").alias("c")), "words")
    tokens, known, distinct = words.agg(
        F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0)), F.count(F.lit(1))
    ).first()
    total, types = tokens + ends, known + (ends > 0)
    dealt = dealt_words(words, distinct)
    scores = vocabulary(path)
    for _ in range(steps):
        scores = refitted_scores(dealt, ends, scores)
    model = spark.sparkContext.broadcast(scores)
    log_total = math.log10(total + ADDED * (types + 1))
    end_known, end_base, end_score = int(ends > 0), math.log10(ends + ADDED) - log_total, scores[END] / LOG10

    def lattice_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model.value)
        for batch in batches:
            logs = [lattice.log_probability(_as_text(w)) / LOG10 for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logs, pa.float64())], ["word", "c", "lp"])

    scored = dealt.mapInArrow(lattice_scores, "word binary, c long, lp double")
    answers = asked.select("block", "word").join(scored, "word")

    def per_text(texts: pa.Table, known: pa.Table) -> pa.Table:
        c = known.column("c").to_numpy()
        values = np.stack([np.ones(len(c)), c > 0, np.log10(c + ADDED) - log_total, known.column("lp").to_numpy()])
        ends_of_text = np.array([1, end_known, end_base, end_score])
        sums = np.empty((4, texts.num_rows))
        if texts.num_rows:
            starts, words = split_words(texts.column("text"))
            # An empty string stands where a text begins or ends with a space: no word, so worth nothing.
            place = pc.index_in(words, value_set=known.column("word").combine_chunks().cast(pa.large_string()))
            if place.null_count != pc.sum(pc.equal(pc.binary_length(words), 0)).as_py():
                raise ValueError("a word without a score")
            at = pc.fill_null(place, len(c)).to_numpy(zero_copy_only=False)
            for row, value in enumerate(np.pad(values, ((0, 0), (0, 1)))):
                sums[row] = np.add.reduceat(value[at], starts) + ends_of_text[row]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"),
                "held_out": texts.column("held_out"),
                "n_tokens": pa.array(sums[0].astype(np.int64)),
                "n_known": pa.array(sums[1].astype(np.int64)),
                "train_tokens": pa.array([total] * texts.num_rows, pa.int64()),
                "base_score": pa.array(sums[2]),
                "score": pa.array(sums[3]),
            }
        )

    # One block per task on both sides, however many partitions the session shuffles into.
    known_words = answers.select("block", "word", "c", "lp").repartitionById(blocks, "block")
    return (
        blocked.repartitionById(blocks, "block")
        .groupBy("block")
        .cogroup(known_words.groupBy("block"))
        .applyInArrow(
            per_text,
            "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )
