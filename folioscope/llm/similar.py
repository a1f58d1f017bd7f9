"""Most similar vectors for every vector (problem 1).

Method: hierarchical navigable small-world graphs per shard, shard results merged.

1. Equal vectors are one class under their smallest id (128-bit hash of their bytes), merged
   before anything is shuffled by similarity, so a group of copies costs one vector.
2. Pivots are fitted on a bounded sample (``SAMPLE`` vectors in hash order); each class goes to
   the shards of its ``SPREAD`` nearest pivots, one for about ``SHARD_ROWS`` classes and at most
   ``MAX_PIVOTS``.  Two vectors are compared if they share a shard.  Many pivots are found through
   centres of pivots, so a vector is compared with some multiple of their square root.
3. A shard of more than ``MAX_SHARD`` rows is parted by pivots of its own, fitted in one task on
   ``LOCAL`` of its rows, again and again while that makes its parts smaller; so the work grows
   with the rows and not with their square.  What pivots can't part is cut by a hash; for every
   two parts a task holds the graph of one and the rows of the other: no pair is lost.
4. In each part the graph is built and every row searched (``hnsw``); the best ``k`` of each row
   over its shards are kept.
5. Classes are expanded: a row's neighbours are its copies first, then the members of the
   nearest classes by (cosine, id), ``k`` in all.  Only the ``k + 1`` smallest ids of a class
   can be anybody's neighbours, so groups of copies never give all pairs.

Edge cases: a vector is usable with ``DIM`` finite values that aren't all zero; others give and
receive nothing; ties are broken by id; fewer than two usable rows give no pair; repeated rows
of one id count once.  Recall against brute force is measured in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, hash_sample, lookup
from . import hnsw

DIM, K, MIN_COSINE = 64, 5, 0.90
SAMPLE, SHARD_ROWS, SPREAD, MAX_SHARD, MAX_PIVOTS, ROUNDS = 20_000, 1000, 2, 8192, 16_384, 6
#: Rows on which the pivots of an oversized shard are fitted, most of them, coarse centres that
#: are looked through, and times a shard is parted.
LOCAL, LOCAL_PIVOTS, COARSE, DEPTH = 4096, 256, 8, 5

_USABLE = T.StructType([T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("id", T.StringType()), T.StructField("v", T.BinaryType())])
_ROUTED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("part", T.IntegerType()), T.StructField("role", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("v", T.BinaryType())])
_NEAR = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("cosine", T.DoubleType())])


def _vectors(col: pa.Array) -> np.ndarray:
    """The float32 rows of a binary column."""
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int = DIM) -> DataFrame:
    """(h1, h2, id, v): unit vectors of the usable rows with the hash of the raw vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            b = b.filter(pa.compute.equal(pa.compute.list_value_length(lists), dim))
            lists = b.column(1)
            flat = lists.flatten()
            x = flat.to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim) + np.float32(0)
            norm = np.sqrt(np.einsum("ij,ij->i", x, x, dtype=np.float64))
            big = ~np.isfinite(norm) & np.isfinite(x).all(axis=1)
            norm[big] = np.linalg.norm(x[big].astype(np.float64), axis=1)
            good = np.isfinite(x).all(axis=1) & np.isfinite(norm) & (norm > 0)
            at = np.flatnonzero(good)
            h = np.array([xxhash.xxh3_128_intdigest(x[i].tobytes()) & ((1 << 126) - 1) for i in at], object)
            unit = (x[at] / norm[at, None]).astype(np.float32)
            ids = b.column(0).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array([int(v >> 63) for v in h], pa.int64()), pa.array([int(v & ((1 << 63) - 1)) for v in h], pa.int64()), ids, pa.array([u.tobytes() for u in unit], pa.binary())], names=_USABLE.names)

    return df.select(F.col(id_col).cast("string"), F.col(vector_col).cast("array<float>")).filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).mapInArrow(run, _USABLE)


#: What a row is to a task: a node of its graph that is searched too, a node only, a query only.
BOTH, NODE, QUERY = 2, 1, 0


def _routed(rows: list[tuple[int, int, int, str, bytes]]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=_ROUTED.names)


def fit_pivots(x: np.ndarray, count: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``count`` cells by spherical k-means; rows are in hash order."""
    count = max(1, min(count, len(x)))
    c = x[:count].copy()
    for _ in range(rounds if count > 1 else 0):
        own = np.concatenate([(x[lo : lo + 4096] @ c.T).argmax(axis=1) for lo in range(0, len(x), 4096)])
        order = np.argsort(own, kind="stable")
        cells, starts = np.unique(own[order], return_index=True)
        s = np.add.reduceat(x[order], starts, axis=0)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c[cells] = np.where(n > 0, s / np.maximum(n, 1e-12), c[cells])
    return c.astype(np.float32)


class Pivots:
    """Pivots with centres of pivots above them."""

    def __init__(self, x: np.ndarray):
        self.x = np.ascontiguousarray(x, np.float32)
        self.coarse, self.children = None, []
        if len(x) > 8 * COARSE**2:
            self.coarse = fit_pivots(self.x, int(len(x) ** 0.5))
            own = (self.x @ self.coarse.T).argmax(axis=1)
            self.children = [np.flatnonzero(own == c) for c in range(len(self.coarse))]

    def nearest(self, x: np.ndarray, spread: int) -> np.ndarray:
        """The ``spread`` nearest pivots of each row, nearest first."""
        spread = min(spread, len(self.x))
        parts = [self._nearest(x[lo : lo + 2048], spread) for lo in range(0, len(x), 2048)]
        return np.concatenate(parts) if parts else np.zeros((0, spread), int)

    def _nearest(self, x: np.ndarray, spread: int) -> np.ndarray:
        if self.coarse is None:
            return hnsw._top(x @ self.x.T, spread)
        cells = hnsw._top(x @ self.coarse.T, COARSE)
        ids = np.zeros((len(x), COARSE * spread), int)
        sims = np.full(ids.shape, -9, np.float32)
        for c in np.unique(cells):
            rows, place = np.nonzero(cells == c)
            if len(own := self.children[c]):
                s = x[rows] @ self.x[own].T
                top = hnsw._top(s, min(spread, len(own)))
                for j in range(top.shape[1]):
                    ids[rows, place * spread + j] = own[top[:, j]]
                    sims[rows, place * spread + j] = s[np.arange(len(rows)), top[:, j]]
        return np.take_along_axis(ids, hnsw._top(sims, spread), 1)


_SHARDED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("id", T.StringType()), T.StructField("v", T.BinaryType())])


def _sharded(ids: pa.Array, vs: pa.Array, shards: np.ndarray) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(len(ids)), shards.shape[1] if shards.ndim == 2 else 1))
    return pa.RecordBatch.from_arrays([pa.array(shards.reshape(-1).astype(np.int64)), ids.take(at), vs.take(at)], names=_SHARDED.names)


def _sizes(rows: DataFrame, least: int) -> DataFrame:
    return rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > least)


def parted(rows: DataFrame, big: DataFrame, spread: int, max_shard: int) -> DataFrame:
    """``rows`` (shard, id, v) of the oversized shards ``big`` (shard, n) in shards of their own."""
    order = Window.partitionBy("shard").orderBy(F.xxhash64("id"), "id")
    head = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= LOCAL)  # pruned before the shuffle
    head = lookup(head.select("shard", "v"), big, ["shard"], "inner")

    def fit(t: pa.Table) -> pa.Table:
        x = _vectors(t.column("v").combine_chunks())
        n = t.column("n")[0].as_py()
        own = fit_pivots(x, min(LOCAL_PIVOTS, -(-2 * spread * n // max_shard)))
        return pa.table({"shard": t.column("shard").slice(0, 1), "pivots": pa.array([own.tobytes()], pa.binary())})

    local = cut(head.groupBy("shard").applyInArrow(fit, "shard long, pivots binary"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            shards, x = b.column(0).to_numpy(), _vectors(b.column(2))
            for s in np.unique(shards):
                at = np.flatnonzero(shards == s)
                if s not in known:
                    if len(known) > 512:
                        known.clear()
                    known[s] = np.frombuffer(b.column(3)[at[0]].as_py(), np.float32).reshape(-1, x.shape[1])
                own = hnsw._top(x[at] @ known[s].T, min(spread, len(known[s])))
                new = np.array([xxhash.xxh3_64_intdigest(f"{s}/{k}") >> 1 for k in range(len(known[s]))], np.int64)
                yield _sharded(b.column(1).take(pa.array(at)), b.column(2).take(pa.array(at)), new[own])

    return lookup(rows, local, ["shard"], "inner").mapInArrow(route, _SHARDED)


def class_neighbours(classes: DataFrame, k: int = K, min_cosine: float = MIN_COSINE, shard_rows: int = SHARD_ROWS, spread: int = SPREAD, max_shard: int = MAX_SHARD) -> DataFrame:
    """(a, b, cosine): for each of ``classes`` (id, v) the best ``k`` others of at least
    ``min_cosine``."""
    spark = classes.sparkSession
    n = classes.count()
    first = hash_sample(classes.select("id", "v"), "id", SAMPLE, n).select("v").collect()  # bounded
    if n < 2:
        return spark.createDataFrame([], _NEAR)
    sample = np.frombuffer(b"".join(bytes(r[0]) for r in first), np.float32).reshape(len(first), -1)
    pivots = spark.sparkContext.broadcast(Pivots(fit_pivots(sample, min(MAX_PIVOTS, -(-n // shard_rows)))))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _sharded(b.column(0), b.column(1), pivots.value.nearest(_vectors(b.column(1)), spread))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots.value.x), np.int64)
        for b in batches:
            np.add.at(total, pivots.value.nearest(_vectors(b.column(0)), spread).reshape(-1), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["shard", "n"])

    rows = classes.select("id", "v").mapInArrow(route, _SHARDED)
    sizes = classes.select("v").mapInArrow(count, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    big = cut(sizes.filter(F.col("n") > max_shard))
    done = []
    for _ in range(DEPTH):
        if big.isEmpty():
            break
        done.append(lookup(rows, big.select("shard"), ["shard"], "left_anti"))
        over = cut(lookup(rows, big.select("shard"), ["shard"], "left_semi"))
        rows = cut(parted(over, big, spread, max_shard))
        largest = big.agg(F.max("n")).first()[0]
        big = cut(_sizes(rows, max_shard))
        if (big.agg(F.max("n")).first()[0] or 0) > 0.9 * largest:  # pivots don't part them
            break
    done.append(rows)
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    parts = big.select("shard", F.ceil(F.col("n") / max_shard).cast("int").alias("p"))
    whole = lookup(whole, parts, ["shard"]) if not big.isEmpty() else whole.withColumn("p", F.lit(None).cast("int"))

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(3).null_count == len(b):
                zero = pa.array(np.zeros(len(b), np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0), zero, pa.array(np.full(len(b), BOTH, np.int32)), b.column(1), b.column(2)], names=_ROUTED.names)
                continue
            out: list[tuple[int, int, int, str, bytes]] = []
            for c, i, v, p in zip(*(x.to_pylist() for x in b.columns)):
                p = p or 1
                mine = xxhash.xxh3_64_intdigest(i) % p if p > 1 else 0
                out.append((c, mine * p + mine, BOTH, i, v))
                for other in range(p):
                    if other != mine:
                        out += [(c, mine * p + other, NODE, i, v), (c, other * p + mine, QUERY, i, v)]
                if len(out) > 50_000:
                    yield _routed(out)
                    out = []
            yield _routed(out)

    def search(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("role", "descending"), ("id", "ascending")])
        ids = np.array(t.column("id").to_pylist(), object)
        x = np.frombuffer(b"".join(t.column("v").to_pylist()), np.float32).reshape(len(ids), -1)
        role = t.column("role").to_numpy()
        own = int(np.count_nonzero(role >= NODE))
        # the order of nodes is that of a hash of their ids
        order = np.argsort([xxhash.xxh3_64_intdigest(i) for i in ids[:own]], kind="stable")
        graph = hnsw.Graph(x[:own][order])
        names = ids[:own][order]
        a, b, c = [], [], []
        itself = (x[:own][order], names, np.arange(own)) if own and role[0] == BOTH else (x[:0], names[:0], None)
        for q, who, start in (itself, (x[own:], ids[own:], None)):
            if len(q) and own:
                near, sims = graph.search(q, k, start)
                r, j = np.nonzero((near >= 0) & (sims >= min_cosine - 1e-6))
                exact = np.einsum("ij,ij->i", q[r].astype(np.float64), graph.x[near[r, j]].astype(np.float64))
                fine = exact >= min_cosine - 1e-9
                a += list(who[r[fine]])
                b += list(names[near[r, j][fine]])
                c.append(exact[fine])
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string()), "cosine": pa.array(np.concatenate(c) if c else np.zeros(0), pa.float64())})

    near = whole.mapInArrow(spread_out, _ROUTED).groupBy("shard", "part").applyInArrow(search, _NEAR)
    best = near.groupBy("a", "b").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("a").orderBy(F.desc("cosine"), "b")
    return best.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")


def neighbours(df: DataFrame, id_col: str = "id", vector_col: str = "embedding", k: int = K, min_cosine: float = MIN_COSINE, dim: int = DIM, **sizes: int) -> DataFrame:
    """(id, other, cosine): the ``k`` most similar others of every usable row."""
    rows = usable(df, id_col, vector_col, dim)
    key = ["h1", "h2"]
    classes = cut(rows.groupBy(*key).agg(F.min("id").alias("id"), F.first("v").alias("v"), F.count("id").alias("n")))
    pairs = class_neighbours(classes.select("id", "v"), k, min_cosine, **sizes)
    multi = cut(classes.filter("n > 1").select(*key, F.col("id").alias("rep")))
    # members of the classes with copies: few in most data, so this is the only second look at ids
    members = cut(lookup(rows.select(*key, "id"), multi, key, "inner").select("rep", "id").distinct())
    order = Window.partitionBy("rep").orderBy("id")
    ranked = members.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1)  # pruned before the shuffle
    heads = cut(ranked.groupBy("rep").agg(F.array_sort(F.collect_list("id")).alias("heads")))  # k + 1 ids at most
    copies = lookup(members, heads, ["rep"], "inner").select("id", "rep", "heads", F.explode("heads").alias("other")).filter("id != other")
    inner = copies.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy("other"))).filter(F.col("_r") <= k).select("id", "other", F.lit(1.0).alias("cosine"))
    # neighbours in other classes fill what the copies leave
    left = heads.select(F.col("rep").alias("a"), F.col("heads").alias("a_heads"))
    right = heads.select(F.col("rep").alias("b"), F.col("heads").alias("b_heads"))
    wide = pairs.join(left, "a", "left").filter(f"a_heads is null or size(a_heads) <= {k}").join(right, "b", "left")
    outer = wide.select(F.explode(F.coalesce("a_heads", F.array("a"))).alias("id"), F.slice(F.coalesce("b_heads", F.array("b")), 1, k).alias("others"), "cosine", F.when(F.col("a_heads").isNotNull(), F.size("a_heads")).otherwise(1).alias("own"))
    outer = outer.select("id", F.explode("others").alias("other"), "cosine", "own")
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    outer = outer.withColumn("_r", rank).filter(F.col("_r") <= k - (F.col("own") - 1)).select("id", "other", "cosine")
    return inner.unionByName(outer)


def pairs(df: DataFrame, **options) -> DataFrame:
    """(id_a, id_b): each kept pair once, the smaller id first."""
    n = neighbours(df, **options)
    return n.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
