"""Token counts with a whole-token shortcut, and token ids.

Counting: it is proved once, on the driver, which vocabulary strings encode alone as
one token.  A pre-token among them counts one without any merging; only the rest goes
through the merges, each distinct one once while it is remembered.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, text_bytes

COUNT_VOCABULARY = "word_bpe_49k.json"
#: Distinct pre-tokens whose counts a worker remembers.
REMEMBERED = 400_000

#: Letters, digits and spaces on which Unicode versions and engines agree.  Texts
#: with other characters are normalised and split by the library itself.
_LATIN = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PLAIN_TEXT = re.compile("[\\t\\n\\r\\x20-\\x7E -ɏ‐-‧‰-⁞€]*")
#: The split of the vocabulary file, over plain texts.
_PLAIN_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LATIN}]+|[0-9²³¹¼-¾]|[^\\s{_LATIN}0-9²³¹¼-¾]+"
)


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=2)
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def byte_marks() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    marks = {b: chr(b) for b in plain}
    rest = (b for b in range(256) if b not in marks)
    return marks | {b: chr(256 + i) for i, b in enumerate(rest)}


def proved_single_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that, as a whole text, encode as just themselves.

    The candidates are the entries with the end-of-word mark that spell valid UTF-8;
    the proof runs the whole tokenizer on each.  The set is bounded by the vocabulary.
    """
    tokenizer = load(path)
    back = {c: b for b, c in byte_marks().items()}
    texts, ids = [], []
    for entry, i in tokenizer.get_vocab(with_added_tokens=False).items():
        if entry.endswith("</w>") and all(c in back for c in entry[:-4]):
            try:
                texts.append(bytes(back[c] for c in entry[:-4]).decode())
            except UnicodeDecodeError:
                continue
            ids.append(i)
    encoded = tokenizer.encode_batch(texts, add_special_tokens=False)
    # The text must also be one pre-token that normalising leaves alone.
    return frozenset(
        t for t, i, e in zip(texts, ids, encoded) if e.ids == [i] and tokenizer.normalizer.normalize_str(t) == t
    )


class TokenCounter:
    """Counts the tokens of texts exactly as the library with its defaults does."""

    def __init__(self, path: str, single: frozenset[str]):
        self.tokenizer, self.single = load(path), single
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.known: dict[str, int] = {}
        self.marks = byte_marks()

    def merged(self, pre: str) -> int:
        """Tokens of a pre-token by the vocabulary's merges."""
        n = self.known.get(pre)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            spelled = "".join([self.marks[b] for b in pre.encode()])
            n = self.known[pre] = len(self.tokenizer.model.tokenize(spelled))
        return n

    def pre_tokens(self, text: str) -> list[str]:
        if _PLAIN_TEXT.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return _PLAIN_SPLIT.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        back = {c: b for b, c in self.marks.items()}
        return [bytes(back[c] for c in p).decode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        if self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        rest = 0
        pres = self.pre_tokens(text)
        single, known, merged = self.single, self.known, self.merged
        for p in pres:
            if p not in single:
                rest += (known.get(p) or merged(p)) - 1
        return len(pres) + rest


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text.

    Null and empty texts have no tokens.  Null or repeated ids: a row per input row.
    Special strings in a text are what the library makes of them by default.  Other
    columns of ``docs`` are not read.
    """
    path = path or vocabulary_path(COUNT_VOCABULARY)
    single = docs.sparkSession.sparkContext.broadcast(proved_single_tokens(path))

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        key = path, len(single.value)
        if key not in _COUNTERS:
            _COUNTERS[key] = TokenCounter(path, single.value)
        count = _COUNTERS[key].count
        texts = batch.column(1).to_pylist()
        n = [count(t.decode()) for t in texts]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
            ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_batches(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes()),
        fn,
        "doc_id long, n_bytes long, n_tokens long, over_limit boolean",
    )
