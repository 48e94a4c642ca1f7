"""Mixing sources to target weights by systematic sampling.

Within a source every document expects ``target / source size`` copies.  The
prefix sum of expected copies is shifted by one random offset per source, and a document
is emitted once for each integer boundary that its stretch crosses.

Documents stand in order of size, so the words of a draw miss what is expected by no more than about its
largest document.  Large documents, by their share of the target, are therefore drawn first, in layers;
the documents of each further layer expect the copies that the words still missing ask for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, durable, with_rank

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix as a share of all words, and the most copies of a source.
SHARE = 1.5
MOST = 2
SEED = "mix"
#: Documents above these shares of their source's target are layers of their own; all others are the last.
LAYERS = (1 / 4, 1 / 16, 1 / 64, 1 / 256)
#: Hexadecimal digits of ``h`` by which documents of one source and size are dealt to tasks.
SPREAD_DIGITS = 2

#: Rows of sources, each of a name and a few numbers, that are sent to all tasks; more are joined by shuffles.
MOST_BROADCAST = 50_000

BY_SOURCE = ["has_source", "name"]


def _sizes(docs: DataFrame) -> dict[str, Column]:
    """``has_source, name, size, h``; ``h`` spreads documents by content."""
    text = F.coalesce("text", F.lit(""))
    parts = F.split(text, SPACES, -1)
    return {
        "has_source": F.col("source").isNotNull(),
        "name": F.coalesce("source", F.lit("")),
        "size": F.size(F.array_remove(parts, "")).cast("long"),
        "h": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)),
    }


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", *(c.alias(n) for n, c in _sizes(docs).items()))


def targets(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``has_source, name, source_size, target, shift`` of each source.

    ``least(most * size, level * weight)`` with the level at which the targets sum up to
    the share.  Going through the sources by the level at which they are full, the level
    that is left to the rest rises while the next source overflows and falls after that;
    so the level sought is the largest.
    """
    sources = docs.groupBy("has_source", "name").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.desc("has_source"), "name")  # one row per source
    number = (F.row_number().over(by_name) - 1) % len(weights)
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (number + 1).cast("int")))
    full = weighted.withColumn("most", F.col("source_size") * most)
    by_level = Window.orderBy(F.col("most") / F.col("weight"), F.desc("has_source"), "name")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0))
    levels = full.withColumn("level", left / F.sum("weight").over(after))
    filled = levels.withColumn("level", F.max("level").over(everything))
    target = F.least(F.col("most").cast("double"), F.col("level") * F.col("weight"))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), F.col("has_source").cast("int").cast("string"), F.lit(":"), "name")), 1, 8), 16, 10)
    return filled.select(
        "has_source",
        "name",
        "source_size",
        target.alias("target"),
        (draw.cast("long") / F.lit(float(1 << 32))).alias("shift"),
    )


def _crossed(rank: Column, copies: Column, shift: Column) -> Column:
    """Integer boundaries that a document's stretch of the prefix sum crosses."""
    return F.floor((rank + 1) * copies + shift) - F.floor(rank * copies + shift)


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with the columns of their source; the rows of one source never meet in one task for it."""
    if sources.count() <= MOST_BROADCAST:
        return rows.join(F.broadcast(sources), BY_SOURCE)
    digit = F.substring("h", 1, 1)
    sixteen = F.array(*(F.lit(f"{i:x}") for i in range(16)))
    salted = sources.withColumn("_digit", F.explode(sixteen)).repartition(*BY_SOURCE, "_digit")
    return rows.withColumn("_digit", digit).join(salted, [*BY_SOURCE, "_digit"]).drop("_digit")


def _layer(size: Column, target: Column) -> Column:
    layer = F.lit(len(LAYERS))
    for k in reversed(range(len(LAYERS))):
        layer = F.when(size > LAYERS[k] * target, k).otherwise(layer)
    return layer


def _ranked(rows: DataFrame, counted: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with their rank by size and ``h`` in the layer of their source."""
    bucket = [F.col("size"), F.substring("h", 1, SPREAD_DIGITS)]
    return with_rank(rows, [*BY_SOURCE, "layer"], bucket, [F.col("h"), F.col("doc_id"), *order], counted=counted)


def _expected(held: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """``sources`` with the copies that the documents of each layer expect, ``copies``."""
    large = held.where(F.col("layer") < len(LAYERS))
    # Few documents: each is more than the last of LAYERS of a target.
    large = durable(_ranked(large, large, []).select(*BY_SOURCE, "layer", "size", "rank"), "large")
    left, missing = F.col("_left"), F.col("target") - F.col("_taken")
    copies = F.when(left > 0, F.least(F.lit(float(most)), F.greatest(F.lit(0.0), missing / left))).otherwise(0.0)
    known = sources.withColumns({"_left": F.col("source_size"), "_taken": F.lit(0.0), "copies": F.array().cast("array<double>")})
    for k in range(len(LAYERS) + 1):
        known = known.withColumn("copies", F.concat("copies", F.array(copies)))
        if k == len(LAYERS):
            return durable(known.drop("_left", "_taken"), "layers")
        known = durable(known, "layers")
        drawn = large.where(F.col("layer") == k).join(known, BY_SOURCE)
        words = _crossed(F.col("rank"), F.col("copies")[k], F.col("shift")) * F.col("size")
        done = drawn.groupBy(*BY_SOURCE).agg(F.sum("size").alias("_size"), F.sum(words).alias("_words"))
        known = known.join(done, BY_SOURCE, "left").fillna(0, ["_size", "_words"])
        known = known.withColumns({"_left": left - F.col("_size"), "_taken": F.col("_taken") + F.col("_words")}).drop("_size", "_words")


def _drawn(rows: DataFrame, table: DataFrame, sources: DataFrame, most: int, order: list[Column]) -> DataFrame:
    """``rows`` with their source's ``source_size, target`` and ``copies_taken``.

    ``table``: the sizes of the same rows, from which all totals are taken.
    """
    layer = _layer(F.col("size"), F.col("target"))
    held = _with_source(table, sources).withColumn("layer", layer)
    known = _expected(held, sources, most)
    placed = _ranked(_with_source(rows, known).withColumn("layer", layer), held, order)
    copies = F.element_at("copies", F.col("layer") + 1)
    return placed.withColumn("copies_taken", _crossed(F.col("rank"), copies, F.col("shift")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken, copies_taken`` of every row.

    Null text has size 0; null sources are one source, after all others.  Null and
    repeated ids: a row each, identical rows interchangeable.  Ties of size go by hash, then
    id.  Empty tables mix into nothing; other columns are not read.  What is taken depends on the rows
    alone, not on how many tasks there are.
    """
    table = durable(sized(docs), "sized")
    drawn = _drawn(table, table, durable(targets(table, weights, share, most), "targets"), most, [])
    return drawn.select(
        "doc_id", "size", "source_size", "target", (F.col("copies_taken") * F.col("size")).alias("taken"), "copies_taken"
    )


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns as they were.

    Rows are drawn where they stand, so equal ids or texts in two sources never swap their takings;
    rows that agree in source, id and text go by their other columns.  Null texts, ids and sources
    as in ``mix``; an empty table gives an empty one.
    """
    table = durable(sized(docs), "sized")
    sources = durable(targets(table, weights, share, most), "targets")
    others = F.to_json(F.struct(F.lit(0), *(c for c in docs.columns if c not in ("doc_id", "text", "source"))))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", others.alias("_others"), *(c.alias(n) for n, c in _sizes(docs).items()))
    drawn = _drawn(rows, table, sources, most, [F.col("_others")])
    copies = F.sequence(F.lit(1), F.col("copies_taken").cast("int"))
    return drawn.where("copies_taken > 0").withColumn("_copy", F.explode(copies)).select("_row.*")
