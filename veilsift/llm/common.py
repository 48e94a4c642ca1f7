"""Shared helpers: Arrow batch plumbing, distributed ranks, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.runtime import durable, scratch_path, ship_package, spread

#: Word separators of every contract here: space and the five ASCII controls 9..13.
#: Java and DuckDB (RE2) read this text alike.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes handed to a Python worker at once.  Long texts make row counts
#: alone a poor bound on memory.
ARROW_ROWS = 1024
ARROW_BYTES = 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_limits(spark: SparkSession) -> None:
    """Ready Python workers: this package there, Arrow batches bounded by rows and bytes."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""
    arrow_limits(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def text_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of a text column, null read as empty."""
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias(name)


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-rows // per_partition))


def with_rank(
    df: DataFrame,
    within: Sequence[str],
    bucket: Sequence[Column],
    order: Sequence[Column],
    name: str = "rank",
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add a gapless 0-based long rank inside the groups of ``within``.

    A plain window over ``within`` would put a hot group into one task.  Here a
    group is cut into ordered buckets: their counts are pre-aggregated, the
    prefix sum runs over the small table of buckets, and only the rows of one
    bucket are sorted together.  ``within`` and ``bucket`` must not be null.
    ``order`` should be total up to identical rows, so that reruns agree.  ``counted`` has the
    columns of ``within`` and ``bucket`` of the same rows, if that is cheaper to count than ``df``.
    """
    marks = [f"_b{i}" for i in range(len(bucket))]
    marked = df.withColumns(dict(zip(marks, bucket)))
    keys = [*within, *marks]
    light = marked if counted is None else counted.withColumns(dict(zip(marks, bucket)))
    counts = light.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # A prefix sum per level of buckets, so that no task holds the buckets of a whole hot group.
    starts = None
    for depth in range(len(bucket)):
        group, mark = keys[: len(within) + depth], marks[depth]
        level = counts.groupBy(*group, mark).agg(F.sum("_n").alias("_n"))
        before = Window.partitionBy(*group).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
        level = level.select(*group, mark, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
        if starts is not None:
            level = level.join(starts, group).withColumn("_before", F.col("_before") + F.col("_start"))
        starts = level.select(*group, mark, F.col("_before").alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    ranked = marked.withColumn("_i", inside).join(starts, keys)
    return ranked.withColumn(name, F.col("_start") + F.col("_i") - 1).drop(*marks, "_i", "_start")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as ``(a long, b long)`` rows.

    Alternates large-star and small-star rewrites (Kiveris et al., 2014): every
    node points its neighbours at the smallest one it sees until only stars are
    left.  Each half step is an aggregation followed by a join on the node, so no
    neighbourhood is gathered in one task, and each round is written to the
    shared folder.  Returns ``(id, component)`` for the nodes that have an edge.
    """

    def toward_min(pairs: DataFrame, keep_larger: bool) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        joined = pairs.join(low, "u")
        if keep_larger:
            return joined.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.unionByName(low.where("u <> m").select("u", F.col("m").alias("v")))

    def state(df: DataFrame) -> tuple:
        return tuple(
            df.agg(
                F.count(F.lit(1)),
                F.coalesce(F.sum(F.xxhash64("u", "v") % F.lit(1 << 31)), F.lit(0)),
            ).first()
        )

    stars = durable(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    seen = state(stars)
    for _ in range(max_rounds):
        if seen[0] == 0:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = toward_min(both, keep_larger=True).distinct()
        stars = durable(toward_min(large, keep_larger=False).distinct(), name)
        now = state(stars)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    ids = stars.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ids.unionByName(roots)
