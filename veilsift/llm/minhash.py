"""Near-duplicate detection by a multi-index Hamming join over b-bit MinHash signatures.

A text's set of word shingles becomes ``k`` MinHash values of ``b = 8`` bits.  Two
sets of Jaccard similarity ``s`` differ in each value with probability at most
``1 - s``.  ``signature_plan`` takes the distance ``T`` beyond which a linked pair
falls with probability below ``miss`` only.  The signature is cut into ``m`` chunks
of ``c`` values with ``T <= 2m - 1``: by the pigeonhole principle some chunk then has
at most one error, so a key per chunk and error position (the value there left
out) meets **every** pair within distance ``T``.  Pairs within ``T`` are confirmed on
their full shingle sets.

No bucket is expanded into all its pairs.  Equal sets are one class.  Round one
compares each bucket's members with its smallest, their head, only.  Round two looks at members
under one head that the confirmed links of round one left in different components, which is
all that connected components can still depend on: pairs within ``T`` are found block
against block and leave only the edges that span them; the clusters so spanned are then
compared on full sets, again block against block, and leave only the links that join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, components, durable, map_batches, text_bytes

MAX_HASHES = 96
#: Rows of a block; a task compares two blocks of a large group, by signatures or by full sets.
SIGNATURE_BLOCK = 1024
BLOCK = 256
#: Tasks over which more than ``SALTED`` members of one group and component are joined.
SALTS, SALTED = 16, 2048
CACHED_WORDS = 400_000
_U = np.uint64


@dataclass(frozen=True)
class SignaturePlan:
    """``hashes`` values in chunks of ``chunk``; pairs within ``distance`` are guaranteed."""

    hashes: int
    chunk: int
    distance: int


@lru_cache
def signature_plan(num: int, den: int, miss: float = 1e-4) -> SignaturePlan:
    """The longest chunk, then the shortest signature, that lose less than ``miss``.

    Longer chunks make keys more selective; ``MAX_HASHES`` bounds keys per text.
    """
    p = 1 - num / den
    for chunk in range(10, 1, -1):
        for m in range(2, MAX_HASHES // chunk + 1):
            k, most = m * chunk, 2 * m - 1
            kept = sum(comb(k, d) * p**d * (1 - p) ** (k - d) for d in range(min(most, k) + 1))
            if 1 - kept < miss:
                return SignaturePlan(k, chunk, most)
    return SignaturePlan(MAX_HASHES, 2, MAX_HASHES - 1)


def _odd(seed: int, n: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHashes(dict):
    """Word -> 64-bit hash; the memory of known words is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = _WordHashes()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles of a text.

    Lower-cases A-Z; words are runs without space and bytes 9..13.  With fewer words
    than ``width`` the whole sequence is the one shingle; without words the set is empty.
    """
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([_WORDS[w] for w in words], np.uint64)
    n = min(width, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix(acc * _U(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def signature(shingles: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """8 bits of the MinHash value under each multiplier of ``odd``."""
    low = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(low, (shingles[i : i + 2048, None] * odd).min(axis=0), out=low)
    return (_mix(low) >> _U(56)).astype(np.uint8)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def fingerprints(docs: DataFrame, width: int, plan: SignaturePlan) -> DataFrame:
    """``doc_id, n_shingles, f1, f2, sig``: set size, 128-bit set fingerprint, signature."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        odd = _odd(11, plan.hashes)
        n, f1, f2, sigs = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, width)
            d = xxhash.xxh3_128_intdigest(s.tobytes())
            n.append(len(s))
            f1.append(d >> 64)
            f2.append(d & 0xFFFFFFFFFFFFFFFF)
            sigs.append(signature(s, odd).tobytes() if len(s) else b"")
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), _signed(np.array(f1, np.uint64)), _signed(np.array(f2, np.uint64)), pa.array(sigs, pa.binary())],
            ["doc_id", "n_shingles", "f1", "f2", "sig"],
        )

    return map_batches(
        docs.select("doc_id", text_bytes()), fn, "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
    )


def chunk_keys(classes: DataFrame, plan: SignaturePlan) -> DataFrame:
    """``key, id, n``: for each chunk and each allowed error position, one key."""

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, plan.hashes)
        odd = _odd(23, plan.hashes * plan.chunk).reshape(plan.chunk, plan.hashes)
        keys = []
        for at in range(0, plan.hashes, plan.chunk):
            part = sig[:, at : at + plan.chunk].astype(np.uint64) + _U(1)
            for err in range(plan.chunk):
                weights = odd[err, at : at + plan.chunk].copy()
                weights[err] = 0
                keys.append(_mix((part * weights).sum(axis=1, dtype=np.uint64) + odd[err, at]))
        reps = len(keys)
        ids = np.tile(batch.column(0).to_numpy(zero_copy_only=False), reps)
        ns = np.tile(batch.column(1).to_numpy(zero_copy_only=False), reps)
        return pa.RecordBatch.from_arrays(
            [_signed(np.concatenate(keys)), pa.array(ids, pa.int64()), pa.array(ns, pa.int64())], ["key", "id", "n"]
        )

    return map_batches(classes.select("id", "n", "sig"), fn, "key long, id long, n long")


def _near(pairs: DataFrame, classes: DataFrame, plan: SignaturePlan) -> DataFrame:
    """Pairs ``(a, b)`` whose signatures differ in at most ``plan.distance`` values."""
    sigs = classes.select("id", "sig")
    both = pairs.join(sigs.toDF("a", "sa"), "a").join(sigs.toDF("b", "sb"), "b")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        sa, sb = (_matrix(batch.column(i), plan) for i in (2, 3))
        keep = pa.array((sa != sb).sum(axis=1) <= plan.distance)
        return batch.select(["a", "b"]).filter(keep)

    return map_batches(both.select("a", "b", "sa", "sb"), fn, "a long, b long")


def _matrix(column: pa.Array | pa.ChunkedArray, plan: SignaturePlan) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, plan.hashes)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables with the ``(start, end)`` of their groups, from rows sorted by ``keys``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        columns = [table.column(k).to_numpy() for k in keys]
        new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
        ends = (np.flatnonzero(new) + 1).tolist()
        if ends:
            yield table, list(zip([0, *ends[:-1]], ends))
        held = table.slice(ends[-1] if ends else 0)
    if held is not None and held.num_rows:
        yield held.combine_chunks(), [(0, held.num_rows)]


def _in_block_pairs(members: DataFrame, keys: list[str], member: str, size: int, load: DataFrame | None = None) -> DataFrame:
    """``members`` of mixed groups dealt to the pairs of their blocks, sorted by group and member.

    A component with more than ``size`` members of a group has blocks of its own, which meet the blocks of
    the others only; all smaller components share blocks, which meet each other and themselves.  So every
    pair of two components meets in some group ``(keys, lo, hi)``, no such group holds more than two blocks,
    and the members of a large component are not dealt to each other.  Groups of one component fall.
    ``load`` is joined by member before rows are multiplied.
    """
    parts = members.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.withColumn("_own", F.when(F.col("_n") > size, F.col("component")))  # null: the shared blocks
    owners = parts.groupBy(*keys, "_own").agg(F.ceil(F.sum("_n") / size).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_parts"))
    group = Window.partitionBy(*keys)
    before = group.orderBy("_own").rowsBetween(Window.unboundedPreceding, -1)
    owners = owners.withColumns(
        {
            "_start": F.coalesce(F.sum("_blocks").over(before), F.lit(0)).cast("int"),
            "_all": F.sum("_blocks").over(group).cast("int"),
            "_parts": F.sum("_parts").over(group),
            "_skip": F.when(F.col("_own").isNull(), 0).otherwise(F.col("_blocks")),
        }
    ).where("_parts > 1")
    same = [F.col(f"p.{k}") == F.col(f"o.{k}") for k in keys] + [F.col("p._own").eqNullSafe(F.col("o._own"))]
    placed = parts.alias("p").join(owners.alias("o"), same)
    placed = placed.select(*(f"p.{k}" for k in keys), "p.component", "_n", "_blocks", "_start", "_all", "_skip")
    rows = _joined_by_component(members, placed, keys, member)
    rows = rows if load is None else load.join(rows, member)
    others = F.transform(
        F.sequence(F.lit(0), F.col("_all") - F.col("_skip") - 1),
        lambda i: i + F.when(i >= F.col("_start"), F.col("_skip")).otherwise(0),
    )
    blk = (F.col("_start") + F.pmod(F.xxhash64(member), F.col("_blocks"))).cast("int")
    dealt = rows.withColumns({"blk": blk, "_other": F.explode(others)})
    dealt = dealt.withColumns({"lo": F.least("blk", "_other"), "hi": F.greatest("blk", "_other")})
    order = [*keys, "lo", "hi"]
    dealt = dealt.drop("_other", "_blocks", "_start", "_all", "_skip")
    return dealt.repartition(*order).sortWithinPartitions(*order, member)


def _salted(placed: DataFrame) -> DataFrame:
    """A row of ``placed`` once, or once for each salt where it has more than ``SALTED`` members."""
    last = F.when(F.col("_n") > SALTED, SALTS - 1).otherwise(0)
    return placed.withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))


def _joined_by_component(members: DataFrame, placed: DataFrame, keys: list[str], member: str) -> DataFrame:
    """``members`` with the row of ``placed`` of their group and component.

    Many members meet their row in several tasks.  Which members these are is looked up first, so copies are
    made of rows with more than ``SALTED`` members only: at most ``SALTS / SALTED`` for each member.
    """
    at = [*keys, "component", "_salt"]
    large = _salted(placed.where(F.col("_n") > SALTED).select(*keys, "component", "_n"))
    large = large.select(*at, F.lit(True).alias("_large")).repartition(*at)
    salted = members.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALTS)).cast("int")).join(large, at, "left")
    salted = salted.withColumn("_salt", F.when(F.col("_large"), F.col("_salt")).otherwise(0)).drop("_large")
    return salted.join(_salted(placed).repartition(*at), at).drop("_salt", "_n")


def _suspects(members: DataFrame, plan: SignaturePlan, num: int, den: int) -> DataFrame:
    """Edges ``(a, b)`` that span every pair of one bucket that may link two components.

    ``members``: ``head, id, n, component, sig``, each member once under the head of its buckets.  A
    suspect pair is within the signature distance and of fitting set sizes.  Per pair of blocks at
    most one edge per member comes out, to the smallest member that it is connected with.
    """
    dealt = _in_block_pairs(members, ["head"], "id", SIGNATURE_BLOCK)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _runs(batches, ["head", "lo", "hi"]):
            ids, ns, comps, blks = (table.column(c).to_numpy() for c in ("id", "n", "component", "blk"))
            sigs = _matrix(table.column("sig"), plan)
            a, b = [], []
            for s, e in groups:
                c, n, g, k = comps[s:e], ns[s:e], sigs[s:e], blks[s:e]
                open_pairs = np.triu(c[:, None] != c)
                if k.min() != k.max():  # pairs of one block meet in that block's own group
                    open_pairs &= k[:, None] != k
                open_pairs &= den * np.minimum(n[:, None], n) >= num * np.maximum(n[:, None], n)
                x, y = np.nonzero(open_pairs)
                if not len(x):
                    continue
                step = 1 << 16
                near = [(g[x[i : i + step]] != g[y[i : i + step]]).sum(axis=1) <= plan.distance for i in range(0, len(x), step)]
                near = np.concatenate(near)
                for u, v in _stars(e - s, x[near], y[near]):
                    a.append(ids[s + u])
                    b.append(ids[s + v])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select("head", "lo", "hi", "blk", "id", "n", "component", "sig").mapInArrow(fn, "a long, b long")


def _stars(size: int, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Edges from the first member of each component of the graph ``(x, y)`` to its others."""
    root = list(range(size))

    def find(u: int) -> int:
        while root[u] != u:
            root[u] = root[root[u]]
            u = root[u]
        return u

    for u, v in zip(x.tolist(), y.tolist()):
        p, q = find(u), find(v)
        if p != q:
            root[max(p, q)] = min(p, q)
    return [(find(u), u) for u in range(size) if root[u] != u]


def _texts_in_block_pairs(clusters: DataFrame, docs: DataFrame) -> DataFrame:
    texts = docs.select("doc_id", text_bytes().alias("t"))
    return _in_block_pairs(clusters.withColumnRenamed("id", "doc_id"), ["cluster"], "doc_id", BLOCK, texts)


def _links_in_clusters(clusters: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Confirmed links between different components inside each cluster.

    ``clusters``: ``cluster, id, component``.  All open pairs of a cluster are compared on their full
    sets, block against block; what comes out spans the components' links.
    """
    dealt = _texts_in_block_pairs(clusters, docs)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in _runs(batches, ["cluster", "lo", "hi"]):
            comps, blks = table.column("component").to_numpy(), table.column("blk").to_numpy()
            ids, texts = table.column("doc_id").to_numpy(), table.column("t")
            a, b = [], []
            for s, e in groups:
                c, k = comps[s:e], blks[s:e]
                open_pairs = np.triu(c[:, None] != c)
                if k.min() != k.max():  # pairs of one block meet in that block's own group
                    open_pairs &= k[:, None] != k
                if not open_pairs.any():
                    continue
                sets = [shingle_set(t, width) for t in texts.slice(s, e - s).to_pylist()]
                n = np.array([len(x) for x in sets])
                shared = _intersections(sets)
                x, y = np.nonzero(open_pairs & (shared > 0) & (den * shared >= num * (n[:, None] + n - shared)))
                names, at = np.unique(c, return_inverse=True)
                for u, v in _stars(len(names), at[x], at[y]):
                    a.append(names[u])
                    b.append(names[v])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return dealt.select("cluster", "lo", "hi", "blk", "doc_id", "component", "t").mapInArrow(fn, "a long, b long")


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, over the shingles that two sets or more hold."""
    values, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = count > 1
    number = np.cumsum(common) - 1
    keep = common[column]
    row, column = row[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    step = 4096
    for low in range(0, int(common.sum()), step):
        part = slice(np.searchsorted(column, low), np.searchsorted(column, low + step))
        held = np.zeros((len(sets), step), np.float32)
        held[row[part], column[part] - low] = 1
        out += held @ held.T
    return np.rint(out).astype(np.int64)


def _confirmed(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs with ``den * |A and B| >= num * |A or B|`` on their full shingle sets."""
    # Only texts that a pair names are shuffled with the pairs.
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = durable(docs.select("doc_id", text_bytes().alias("t")).join(named, "doc_id", "left_semi"), "pair-texts")
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, known = [], (None, None)
        for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if known[0] != ta:
                known = ta, shingle_set(ta, width)
            a, b = known[1], shingle_set(tb, width)
            inter = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(inter > 0 and den * inter >= num * (len(a) + len(b) - inter))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return map_batches(both.select("a", "b", "ta", "tb"), fn, "a long, b long").distinct()


def _repeated(prints: DataFrame, classes: DataFrame) -> DataFrame:
    """``doc_id, id``: the classes of each doc_id whose rows have different sets."""
    sets = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("f1", "f2")).alias("x"), F.max(F.struct("f1", "f2")).alias("y"))
    rows = prints.join(sets.where("x <> y").select("doc_id"), "doc_id", "left_semi")
    return rows.join(classes.select("f1", "f2", "id"), ["f1", "f2"]).select("doc_id", "id").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of texts linked at Jaccard ``>= num / den`` over ``width``-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept``, one row per input row.

    * null text, empty text, text without words: the empty set, linked with nothing;
    * null ``doc_id``: its own row, ``component_id`` null, ``kept`` true, linked with nothing;
    * repeated ``doc_id``: one vertex with all its texts, every row kept or not together;
    * ties: the smallest ``doc_id`` of a component is kept;
    * other columns of ``docs`` are not read, so their names can't clash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    arrow_limits(docs.sparkSession)
    plan = signature_plan(num, den)
    prints = durable(fingerprints(docs, width, plan), "fingerprints")
    classes = durable(
        prints.where("n_shingles > 0 and doc_id is not null")
        .groupBy("f1", "f2")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")),
        "classes",
    )
    keys = chunk_keys(classes, plan)
    heads = (
        keys.groupBy("key")
        # Of longs alone, so that it is a hash aggregation.
        .agg(F.min("id").alias("head"), F.min_by("n", "id").alias("head_n"), F.max("id").alias("last"))
        .where("head < last")
        .drop("last")
    )
    # Whoever shares a bucket shares its head, so a member need stand under each head once only.
    members = durable(keys.join(heads, "key").select("head", "head_n", "id", "n").distinct(), "members")
    fits = f"{den} * least(n, head_n) >= {num} * greatest(n, head_n)"
    first = members.where(f"id <> head and {fits}").select(F.col("head").alias("a"), F.col("id").alias("b"))
    near = durable(_near(first, classes, plan), "near")
    vertices = durable(_repeated(prints, classes), "repeated")
    same = vertices.where("id <> doc_id").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    links = durable(_confirmed(near, docs, width, num, den).unionByName(same), "links")
    labels = components(links)

    # What round one left in different components under one head is compared in blocks.
    labelled = members.select("head", "id", "n").join(labels, "id", "left").join(classes.select("id", "sig"), "id")
    open_rows = labelled.withColumn("component", F.coalesce("component", "id"))
    suspects = durable(_suspects(open_rows, plan, num, den).distinct(), "suspects")
    if not suspects.isEmpty():
        clusters = components(suspects).withColumnRenamed("component", "cluster")
        named = clusters.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
        more = durable(_links_in_clusters(named, docs, width, num, den), "links")
        labels = components(links.unionByName(more))

    # A class is named by its smallest doc_id; a label by its component.
    named = prints.join(classes.select("f1", "f2", "id"), ["f1", "f2"], "left")
    # An empty row goes with the other rows of its doc_id.
    of_id = vertices.groupBy("doc_id").agg(F.min("id").alias("_vertex"))
    named = named.join(of_id, "doc_id", "left").withColumn("id", F.coalesce("id", "_vertex"))
    out = named.join(labels, "id", "left")
    component = F.coalesce("component", "id", "doc_id")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group left, all its columns as they were.

    Repeated rows of one ``doc_id`` count as one document: the one with the longest text stays,
    of those the first by text, then by the other columns.  Rows with a null ``doc_id`` all stay.
    """
    kept = near_duplicates(docs, width, num, den).where("kept and doc_id is not null").select("doc_id").distinct()
    known = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    length = F.coalesce(F.length("text"), F.lit(-1))
    # Maps have no order; as JSON they do.
    rest = [F.to_json(F.struct(f.name)) if "map<" in f.dataType.simpleString() else F.col(f.name) for f in docs.schema.fields]
    order = Window.partitionBy("doc_id").orderBy(length.desc(), "text", *rest)
    known = known.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(*docs.columns)
    return known.unionByName(docs.where("doc_id is null"))
