"""Minimum-cost-flow resharding.

The new capacities differ by one row at most.  A minimum-cost flow from blocks of the old shards to
the new shards, where staying is free and moving a row costs its bytes, says which rows go where.
Whoever gives rows away gives the lightest, so only three blocks of an old shard matter: the heaviest rows
up to the smaller capacity, the one row that the larger capacity still holds, and the rest.  All
rows of a block share one fate in a cheapest plan but where they fill up shards that gave nothing, so the
bytes moved are the fewest for single rows too.  Rows take their place by their rank by size in their old
shard; only shards that give or take rows are rewritten.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, durable, scratch_path, with_rank

OLD_SHARDS = 16
NEW_SHARDS = 24
#: Tasks over which rows of one old shard and size are dealt by hash.
SPREAD = 256
#: Bytes of rows that one file of a shard holds, about.
FILE_BYTES = 256 << 20
#: The old shard of rows without one: no number of a shard, so all of them move.
NOWHERE = -1


def min_cost_flow(n: int, arcs: list[tuple[int, int, int, float]], source: int, sink: int) -> list[int]:
    """Flow on each arc ``(tail, head, capacity, cost)`` of a cheapest maximum flow.

    Successive shortest paths with node potentials; costs must not be negative.
    """
    graph: list[list[int]] = [[] for _ in range(n)]
    head, room, cost = [], [], []
    for tail, to, capacity, price in arcs:
        for a, b, c, p in ((tail, to, capacity, price), (to, tail, 0, -price)):
            graph[a].append(len(head))
            head.append(b)
            room.append(c)
            cost.append(p)
    potential = [0.0] * n
    while True:
        distance, via = [float("inf")] * n, [-1] * n
        distance[source] = 0.0
        queue = [(0.0, source)]
        while queue:
            d, u = heapq.heappop(queue)
            if d > distance[u]:
                continue
            for e in graph[u]:
                if room[e] > 0:
                    new = d + max(0.0, cost[e] + potential[u] - potential[head[e]])
                    if new < distance[head[e]] - 1e-9:
                        distance[head[e]], via[head[e]] = new, e
                        heapq.heappush(queue, (new, head[e]))
        if via[sink] < 0:
            return [arcs[i][2] - room[2 * i] for i in range(len(arcs))]
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, distance)]
        push, v = float("inf"), sink
        while v != source:
            push = min(push, room[via[v]])
            v = head[via[v] ^ 1]
        v = sink
        while v != source:
            room[via[v]] -= push
            room[via[v] ^ 1] += push
            v = head[via[v] ^ 1]


def transfers(old: dict[int, list[tuple[int, int]]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Solve the block transfers.

    ``old``: for each old shard its blocks ``(rows, bytes)``, heaviest rows first.  Returns
    ``(old shard, low, high, new shard, slot)``: the rows of the old shard with rank ``low <= r < high`` go
    to the new shard, into the slots from ``slot`` on.
    """
    blocks = [(shard, rows, size) for shard in sorted(old) for rows, size in old[shard] if rows]
    total = sum(rows for _, rows, _ in blocks)
    # Every shard takes its base; of the odd rows that are left each takes one at most.
    base, odd = divmod(total, shards)
    source, hub, spare, first_new = 0, 1, 2, 3
    first_block = first_new + shards
    sink = first_block + len(blocks)
    arcs = []
    for i, (shard, rows, size) in enumerate(blocks):
        arcs.append((source, first_block + i, rows, 0.0))
        arcs.append((first_block + i, hub, rows, size / rows))
        if 0 <= shard < shards:
            arcs.append((first_block + i, first_new + shard, rows, 0.0))
    arcs += [(hub, first_new + s, total, 0.0) for s in range(shards)]
    arcs += [(first_new + s, sink, base, 0.0) for s in range(shards)]
    arcs += [(first_new + s, spare, 1, 0.0) for s in range(shards)]
    arcs.append((spare, sink, odd, 0.0))
    flow = min_cost_flow(sink + 1, arcs, source, sink)
    stays, takes = [0] * len(blocks), [0] * shards
    for (tail, to, _, _), f in zip(arcs, flow):
        if tail >= first_block and to >= first_new:
            stays[tail - first_block] = f
        elif tail == hub:
            takes[to - first_new] = f
    used, out, to = [0] * shards, [], 0
    rank: dict[int, int] = {}
    leaving = []
    for (shard, rows, _), stay in zip(blocks, stays):
        at = rank.get(shard, 0)
        rank[shard] = at + rows
        if stay:
            out.append((shard, at, at + stay, shard, used[shard]))
            used[shard] += stay
        if stay < rows:
            leaving.append((shard, at + stay, at + rows))
    for shard, at, end in leaving:
        while at < end:
            while not takes[to]:
                to += 1
            n = min(end - at, takes[to])
            out.append((shard, at, at + n, to, used[to]))
            used[to] += n
            takes[to] -= n
            at += n
    return out


def _facts(docs: DataFrame, old_shards: int, old_shard: str | None) -> dict[str, Column]:
    text = F.coalesce("text", F.lit(""))
    if old_shard:
        old = F.coalesce(F.col(old_shard).cast("int"), F.lit(NOWHERE))
    else:
        old = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(old_shards)).cast("int")
    return {
        "size": (F.octet_length(text) + 8).cast("long"),
        "text_crc32": F.crc32(text.cast("binary")),
        "old_shard": old,
        "spread": F.pmod(F.xxhash64("doc_id", "text"), F.lit(SPREAD)),
    }


def _ranked(table: DataFrame) -> DataFrame:
    """Rank in the old shard, the heaviest row first."""
    return with_rank(table, ["old_shard"], [-F.col("size"), F.col("spread")], [F.col("doc_id"), F.col("text_crc32")])


def _code(old_shard: Column, size: Column, spread: Column) -> Column:
    """One number that orders rows as their ranks do, up to rows of one shard, size and hash."""
    lighter = F.lit((1 << 32) - 1) - size
    return ((old_shard.cast("long") + 1) * F.lit(1 << 40) + lighter * F.lit(SPREAD) + spread).cast("long")


def _blocks(table: DataFrame, shards: int) -> dict[int, list[tuple[int, int]]]:
    """The three blocks of each old shard; a number of rows that depends on the shards alone reaches the driver."""
    base, rank = table.count() // shards, F.col("rank")
    part = F.when(rank < base, 0).when(rank == base, 1).otherwise(2)
    cut = _ranked(table).groupBy("old_shard", part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
    out: dict[int, list[tuple[int, int]]] = {}
    for shard, _, rows, size in sorted(cut.collect()):
        out.setdefault(shard, []).append((rows, size))
    return out


@dataclass(frozen=True)
class Plan:
    """``table``: the sizes of all rows; ``runs``: ``(old shard, low, high, shard, slot)`` as ``transfers`` gives them."""

    table: DataFrame
    runs: list[tuple[int, int, int, int, int]]
    facts: dict[str, Column]

    def changed(self) -> list[int]:
        """Shards that a row left or came to."""
        return sorted({s for o, _, _, to, _ in self.runs if o != to for s in (o, to) if s != NOWHERE})

    def placed(self) -> DataFrame:
        """Every row's place, without the row."""
        return self._dealt(_ranked(self.table))

    def whole_rows(self, docs: DataFrame, per_file: int) -> DataFrame:
        """The rows of ``docs`` as ``row``, each with its place, a file's rows in one task.

        A file is a range of ranks in one old shard, so its rows are known by where their code falls among
        the files' first codes, before anything is shuffled; rows of one code stay together.
        """
        spark = docs.sparkSession
        code = _code(F.col("old_shard"), F.col("size"), F.col("spread"))
        buckets = _ranked(self.table).groupBy("old_shard", code.alias("code")).agg(F.min("rank").alias("start"))
        cut = buckets.groupBy("old_shard", F.floor(F.col("start") / per_file)).agg(F.min("code").alias("code"), F.min("start").alias("start"))
        # A row per file.
        files = sorted((r["code"], r["start"]) for r in cut.collect())
        firsts = np.array([c for c, _ in files], np.int64)

        @F.pandas_udf("int")
        def file_of(codes: pd.Series) -> pd.Series:
            return pd.Series(np.searchsorted(firsts, codes.to_numpy(), side="right") - 1)

        arrow_limits(spark)
        others = F.to_json(F.struct(F.lit(0), *(c for c in docs.columns if c not in ("doc_id", "text"))))
        rows = docs.select("doc_id", F.struct(*docs.columns).alias("row"), others.alias("_others"), *(c.alias(n) for n, c in self.facts.items()))
        rows = rows.withColumn("code", code).withColumn("file", file_of("code")).repartitionById(max(1, len(files)), F.col("file"))
        inside = F.row_number().over(Window.partitionBy("file").orderBy("code", "doc_id", "text_crc32", "_others"))
        starts = spark.createDataFrame([(i, first) for i, (_, first) in enumerate(files)], "file int, start long")
        ranked = rows.withColumn("_inside", inside).join(F.broadcast(starts), "file")
        return self._dealt(ranked.withColumn("rank", F.col("start") + F.col("_inside") - 1))

    def _dealt(self, ranked: DataFrame) -> DataFrame:
        # A few runs per old and new shard, whatever the number of documents.
        runs = self.table.sparkSession.createDataFrame(self.runs, "o int, low long, high long, shard int, first long")
        dealt = ranked.join(F.broadcast(runs), F.expr("old_shard = o and rank >= low and rank < high"))
        return dealt.withColumn("slot", F.expr("first + rank - low"))


def planned(docs: DataFrame, old_shards: int = OLD_SHARDS, new_shards: int = NEW_SHARDS, old_shard: str | None = None) -> Plan:
    """The cheapest plan; the old shard is the column ``old_shard``, or else the id's crc32 modulo ``old_shards``."""
    facts = _facts(docs, old_shards, old_shard)
    table = durable(docs.select("doc_id", *(c.alias(n) for n, c in facts.items())), "sizes")
    return Plan(table, transfers(_blocks(table, new_shards), new_shards), facts)


def _described(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "old_shard",
    )


def reshard(docs: DataFrame, **options) -> DataFrame:
    """Places of ``docs`` in the new shards, law ``rows``; options as for ``planned``.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard``.

    Null text: size 8, checksum of the empty text; null id: as the empty id; null old shard: a row that is
    in no shard yet.  Repeated rows: a place each, identical ones interchangeable; ranks go by size, hash, id
    and checksum.  An empty table has no places.  Other columns are not read.
    """
    return _described(planned(docs, **options).placed())


def rewrite(docs: DataFrame, plan: Plan, out: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the shards that changed under ``out/shard=N``: whole rows in the order of their slots.

    Every row brings its own place, so null and repeated ids lose or gain nothing; rows that agree in id
    and text go by their other columns.  The files of unchanged shards stay where they are.  A shard is
    written in several files, each a range of slots.  Returns what was written: ``old_shard, slot, row, shard``.
    """
    total, size = plan.table.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_file = max(1, total * file_bytes // max(1, size))
    chosen = plan.whole_rows(docs, per_file).where(F.col("shard").isin(plan.changed())).select("old_shard", "slot", "row", "shard")
    chosen.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").option("compression", "zstd").parquet(out)
    return docs.sparkSession.read.schema(chosen.schema).parquet(out)


def resharded_files(docs: DataFrame, **options) -> DataFrame:
    """Reshard ``docs`` into files in the shared folder and describe every row from the files.

    The columns and cases of ``reshard``; sizes and checksums are those of the texts read back.  Rows of
    shards that did not change are described where they are.
    """
    plan = planned(docs, **options)
    changed = plan.changed()
    stayed = plan.placed().where(~F.col("shard").isin(changed))
    if not changed:
        return _described(stayed)
    read = rewrite(docs, plan, scratch_path(docs.sparkSession, "shards"))
    text = F.coalesce("row.text", F.lit(""))
    found = _described(
        read.select(
            "old_shard",
            "slot",
            "shard",
            F.col("row.doc_id").alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    whole = set(changed) >= {to for _, _, _, to, _ in plan.runs}
    return found if whole else found.unionByName(_described(stayed))
