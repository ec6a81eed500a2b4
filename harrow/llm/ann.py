"""Approximate nearest neighbours: a forest of sorted hash-prefix arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harrow.llm.common import materialise

HITS = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("compared", pa.int64())])
HITS_DDL = "query_id long, vec_id long, score double, compared long"


class Forest:
    """Trees of random hyperplanes over the rows of a matrix: per tree, hash strings in sorted order.

    A string of ``bits`` bits is held as one integer, first bit highest, so a common prefix of x bits is a range
    of the sorted array. Search descends in every tree to the range of the longest matching prefix, then shortens
    the prefix in all trees at once, which adds the rows on both sides of each range.
    """

    def __init__(self, vectors: np.ndarray, trees: int, bits: int, seed: int):
        self.vectors, self.bits, self.trees = vectors, bits, trees
        self.center = vectors.mean(axis=0)
        self.planes = np.random.default_rng(seed).standard_normal((trees, vectors.shape[1], bits))
        self.rows, self.sorted = np.empty((trees, len(vectors)), np.int32), np.empty((trees, len(vectors)), np.int32)
        for t in range(trees):
            codes = self.codes(vectors, t)
            self.rows[t] = np.argsort(codes, kind="stable")
            self.sorted[t] = codes[self.rows[t]]
        self.seen = np.zeros(len(vectors), dtype=bool)

    def codes(self, vectors: np.ndarray, tree: int) -> np.ndarray:
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int32)
        return ((vectors - self.center) @ self.planes[tree] > 0) @ weights

    def ranges(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and end of the range of each query's prefix, by depth and tree."""
        shape = (len(queries), self.bits + 1, self.trees)
        low, high = np.empty(shape, np.int32), np.empty(shape, np.int32)
        for t in range(self.trees):
            own = self.codes(queries, t)
            for depth in range(self.bits + 1):
                first = own >> (self.bits - depth) << (self.bits - depth)
                low[:, depth, t] = np.searchsorted(self.sorted[t], first)
                high[:, depth, t] = np.searchsorted(self.sorted[t], first + (1 << (self.bits - depth)) - 1, "right")
        return low, high

    def search(self, query: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows compared and their distances.

        Two vectors at an angle a are on the same side of a plane with probability 1 - a / pi. The ascent ends at the
        depth at which a neighbour as far as the k-th of those found would have been missed by all trees with a
        probability of at most ``miss``: soon where neighbours are near, late where they are hardly nearer than others.
        """
        depth = int(np.flatnonzero((high - low).sum(axis=1) >= k)[-1]) if len(self.vectors) >= k else 0
        own = query - self.center
        length = math.sqrt(float(own @ own))
        all_rows, all_distances = np.zeros(0, np.int64), np.zeros(0)
        begin = end = None  # what the trees have given so far
        while True:
            parts = []
            for t in range(self.trees):
                if begin is None:
                    parts.append(self.rows[t, low[depth, t] : high[depth, t]])
                elif low[depth, t] < begin[t] or end[t] < high[depth, t]:
                    parts += [self.rows[t, low[depth, t] : begin[t]], self.rows[t, end[t] : high[depth, t]]]
            begin, end = low[depth], high[depth]
            new = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            new = np.unique(new[~self.seen[new]])
            self.seen[new] = True
            all_rows = np.concatenate((all_rows, new))
            all_distances = np.concatenate((all_distances, np.sqrt(((self.vectors[new] - query) ** 2).sum(axis=1))))
            if not depth:
                break
            if len(all_rows) >= k:
                near = all_rows[np.argpartition(all_distances, k - 1)[:k]]
                others = self.vectors[near] - self.center
                cosine = (others @ own) / np.maximum(np.sqrt((others**2).sum(axis=1)) * length, 1e-300)
                same = 1 - math.acos(min(1.0, max(-1.0, float(cosine.min())))) / math.pi
                if (1 - same**depth) ** self.trees <= miss:
                    break
            depth -= 1
        self.seen[all_rows] = False
        return all_rows, all_distances


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, trees: int, bits: int, miss: float, seed: int) -> Iterator[tuple]:
    """(query_id, vec_id, distance, rows compared) of each query's ``k`` nearest candidates in one shard.

    Equal vectors are one entry of the forest, with all ids that the shard has of them.
    """
    order = np.argsort(ids, kind="stable")
    distinct, place = np.unique(vectors[order], axis=0, return_inverse=True)
    place = place.reshape(-1)
    by_entry = np.argsort(place, kind="stable")  # within an entry by id
    entry_ids = ids[order][by_entry]
    begin = np.searchsorted(place[by_entry], np.arange(len(distinct) + 1))
    forest = Forest(distinct, trees, bits, seed)
    for at in range(0, len(queries), 200):
        low, high = forest.ranges(queries[at : at + 200])
        for i, (query_id, query) in enumerate(zip(query_ids[at : at + 200].tolist(), queries[at : at + 200], strict=True)):
            rows, distance = forest.search(query, low[i], high[i], min(k + 1, len(distinct)), miss)
            compared = len(rows)
            if len(rows) > 2 * (k + 1):  # ties with the last one stay in
                near = distance <= np.partition(distance, k)[k]
                rows, distance = rows[near], distance[near]
            hits = [(d, v) for d, r in zip(distance.tolist(), rows.tolist(), strict=True) for v in entry_ids[begin[r] : begin[r + 1]].tolist() if v != query_id]
            for d, v in sorted(hits)[:k]:
                yield query_id, v, d, compared


class Dealer:
    """Deals vectors to shards by a prefix of one hash string, and queries to the shards where near vectors most likely are.

    A vector's shard is named by the sides of ``bits`` planes that it is on. A query visits shards in order of the sum
    of its squared distances to the planes that part it from the shard: the wider a margin, the less likely a neighbour
    lies beyond.
    """

    def __init__(self, bits: int, centers: dict[int, np.ndarray], seed: int):
        self.bits, self.centers, self.seed = bits, centers, seed

    def sides(self, vectors: np.ndarray) -> np.ndarray:
        dim = vectors.shape[1]
        planes = np.random.default_rng([self.seed, dim]).standard_normal((dim, self.bits))
        return (vectors - self.centers.get(dim, np.zeros(dim))) @ planes

    def shard(self, vectors: np.ndarray) -> np.ndarray:
        return (self.sides(vectors) > 0) @ (1 << np.arange(self.bits, dtype=np.int64))

    def visits(self, vectors: np.ndarray, shards: int) -> np.ndarray:
        """The ``shards`` shards that each vector should visit, best first: one row per vector."""
        margins = self.sides(vectors) ** 2
        out = np.empty((len(vectors), min(shards, 1 << self.bits)), np.int64)
        home = self.shard(vectors)
        for i, row in enumerate(margins):
            cost, flips = np.zeros(1), np.zeros(1, np.int64)
            for bit in np.argsort(row):  # the best of a longer list of planes extend the best of a shorter one
                cost, flips = np.concatenate((cost, cost + row[bit])), np.concatenate((flips, flips | (1 << int(bit))))
                if len(cost) > shards:
                    best = np.argsort(cost, kind="stable")[:shards]
                    cost, flips = cost[best], flips[best]
            out[i] = home[i] ^ flips[np.argsort(cost, kind="stable")]
        return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def by_dimension(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of each dimension in each batch, and their vectors."""
    for batch in batches:
        sizes = batch.column("dim").to_numpy()
        for dim in np.unique(sizes):
            some = batch.take(pa.array(np.flatnonzero(sizes == dim)))
            yield some, matrix(some.column("embedding"))


def true_neighbours(index: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """query (number in ``asked``), embedding: the ``k`` nearest of all rows to each of a few vectors, by comparing all."""
    by_dim: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(asked):
        by_dim.setdefault(len(v), []).append(i)
    blocks = {dim: (np.array(some), np.array([asked[i][1] for i in some])) for dim, some in by_dim.items()}
    schema = pa.schema([("query", pa.int64()), ("distance", pa.float64()), ("embedding", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, vectors in by_dimension(batches):
            numbers, queries = blocks.get(vectors.shape[1], (np.zeros(0, np.int64), np.zeros((0, vectors.shape[1]))))
            found = []
            for number, query in zip(numbers.tolist(), queries, strict=True):
                distance = np.sqrt(((vectors - query) ** 2).sum(axis=1))
                for row in np.argsort(distance, kind="stable")[:k].tolist():
                    found.append((number, float(distance[row]), vectors[row].tolist()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    hits = index.select("dim", "embedding").mapInArrow(run, "query long, distance double, embedding array<double>")
    near = Window.partitionBy("query").orderBy("distance")
    return hits.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k).select("query", "embedding")


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 10, trees: int = 128, bits: int = 24, miss: float = 0.1, shard_rows: int = 25_000,
    query_rows: int = 20_000, sampled: int = 2_000, calibrated: int = 64, reach: float = 0.97, seed: int = 7, counted: bool = False,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest found by Euclidean distance in double precision.

    Both tables have vec_id and embedding. Every vector is in the index; equal ids are not each other's candidates.
    Ties go to the smaller vec_id; a query has fewer rows if there are fewer candidates. Vectors (or ids) that are
    null, all zero, empty, or hold null or non-finite components take no part; vectors are compared with those of the
    same dimension only. Repeated query ids are answered once, for the smallest of their vectors. Other columns are left
    out; an empty table gives no rows. With ``counted``, ``compared`` is how many vectors of the hit's shard the query met.

    Each vector goes to one shard by a hash prefix, so long that a shard has about ``shard_rows`` rows (:class:`Dealer`); a
    shard that has more is split, and its queries go to all its parts. A query visits as many shards as hold ``reach`` of the
    true neighbours of ``calibrated`` queries, which are compared with all rows. Each shard has a :class:`Forest`. Planes go
    through the mean of about ``sampled`` vectors. Of equal vectors only ``k`` + 1 smallest ids can be among the nearest, so
    no others are dealt. Queries with fewer than ``k`` hits, whose shards were too empty, visit all shards.
    """
    def valid(df: DataFrame) -> DataFrame:
        value = F.col("embedding").cast("array<double>")
        good = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(value, lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("embedding")).where(good & F.col("vec_id").isNotNull())

    copies = Window.partitionBy("embedding").orderBy("vec_id")
    index = valid(vectors).withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
    index = materialise(index.withColumn("dim", F.size("embedding")), "vectors")
    asked = valid(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    asked = materialise(asked.withColumn("dim", F.size("embedding")), "queries")
    count = index.count()
    prefix = max(0, math.ceil(math.log2(max(1, count) / shard_rows)))
    keep = min(1.0, sampled / max(1, count))
    some = index.where(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < math.ceil(keep * 1_000_000)).select("dim", "embedding").limit(4 * sampled).collect()
    centers = {dim: np.mean([r.embedding for r in some if r.dim == dim], axis=0) for dim in {r.dim for r in some}}
    dealer = Dealer(prefix, centers, seed)
    shards = 1
    if prefix:
        tried = [(r.vec_id, r.embedding) for r in asked.orderBy(F.xxhash64("vec_id")).limit(calibrated).collect()]
        ranks = []
        for r in true_neighbours(index, tried, k + 1).collect():
            order = dealer.visits(np.array([tried[r.query][1]]), 1 << prefix)[0]
            ranks.append(int(np.flatnonzero(order == dealer.shard(np.array([r.embedding]))[0])[0]) + 1)
        shards = int(np.quantile(ranks, reach, method="higher")) if ranks else 1

    row = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float64())), ("dim", pa.int32()), ("shard", pa.int64())])
    row_ddl = "vec_id long, embedding array<double>, dim int, shard long"

    def dealt(df: DataFrame, visited: int | None) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, values in by_dimension(batches):
                targets = dealer.visits(values, visited).T if visited else [dealer.shard(values)]
                for target in targets:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "embedding", "dim")), pa.array(target)], schema=row)

        return df.mapInArrow(run, row_ddl)

    keys = ["dim", "shard", "part", "block"]

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if len(left) and len(right):
            sides = [(t.column("vec_id").to_numpy(), matrix(t.column("embedding"))) for t in (left, right)]
            found = list(search_shard(*sides[0], *sides[1], k, trees, bits, miss, seed))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, HITS.types, strict=True)], schema=HITS)

    placed = materialise(dealt(index, None), "shards")
    sizes = placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("parts"))

    def hits_of(questions: DataFrame, visited: int) -> DataFrame:
        """Best hits by shard. A shard's rows are split into parts and its queries into blocks; all parts meet all blocks."""
        visits = materialise(dealt(questions, visited), "visits")
        loads = visits.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("blocks"))
        plan = materialise(sizes.join(loads, ["dim", "shard"]), "shard-sizes")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        one = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n)).cast("int")
        rows = placed.join(plan, ["dim", "shard"]).withColumn("part", one("parts")).withColumn("block", each("blocks"))
        asks = visits.join(plan, ["dim", "shard"]).withColumn("block", one("blocks")).withColumn("part", each("parts"))
        picked = ["vec_id", "embedding", *keys]
        found = rows.select(*picked).groupBy(*keys).cogroup(asks.select(*picked).groupBy(*keys)).applyInArrow(search, HITS_DDL)
        return materialise(found, "hits")

    hits = hits_of(asked, shards)
    if shards < 1 << prefix:
        full = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"))
        short = materialise(asked.join(full, "vec_id", "left_anti"), "queries")
        if not short.isEmpty():
            again = hits_of(short, 1 << prefix)
            hits = hits.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(again)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score", *(["compared"] if counted else []))
