"""Nearest neighbours by multi-index hashing over learned, rotated binary codes.

A rotation learnt on a bounded sample turns a vector into ``bits`` signs (principal axes, then the rotation that brings
them closest to their signs). Codes are cut into substrings, and each has an index of its own: the values present, and
the rows with each value. A code within radius r of a query agrees with it up to r // m bits in one of m substrings at
least, so looking up the values that near in every index retrieves every code within r. These are compared with the
whole code, and those within r are ranked by distance of the original vectors.

The radius is learnt as well: the one that holds ``hold`` of the true neighbours in the sample, whose neighbours are
farther than those among all rows. Every row is indexed, in shards of bounded size where the rows lie; queries come to
them in broadcast blocks of bounded size. A query for which fewer than k codes were within the radius is answered by
distances to all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fraudspark.llm.common import stored

BITS, SUBSTRINGS = 64, 4
SAMPLE_ROWS, SAMPLE_QUERIES = 20_000, 300  # bounds of what the index is fitted on
HOLD = 0.98
QUERIES_AT_ONCE = 20_000
SHARD_ROWS = 50_000


def usable(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the rows that take part: of ``size`` finite components, not all zero."""
    column = batch["embedding"]
    fits = pc.and_(pc.equal(pc.fill_null(pc.list_value_length(column), -1), size), pc.is_valid(batch["vec_id"]))
    rows = batch.filter(fits)
    vectors = rows["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    good = np.isfinite(vectors).all(axis=1) & (vectors != 0).any(axis=1)
    return rows["vec_id"].cast(pa.int64()).to_numpy(zero_copy_only=False)[good], vectors[good]


class Codes:
    """Centre, rotation and radius, from a sample."""

    def __init__(self, sample: np.ndarray, k: int, hold: float = HOLD, rounds: int = 25, seed: int = 5):
        rng = np.random.default_rng(seed)
        size = sample.shape[1]
        self.bits = min(BITS, size)
        self.centre = sample.mean(axis=0) if len(sample) else np.zeros(size)
        x = sample - self.centre
        _, axes = np.linalg.eigh(x.T @ x + 1e-12 * np.eye(size))
        axes = axes[:, ::-1][:, : self.bits]
        z = x @ axes
        turn = np.linalg.qr(rng.normal(size=(self.bits, self.bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
            turn = v.T @ u.T
        self.rotation = axes @ turn
        self.radius = self._radius(sample, k, hold, rng)

    def _radius(self, sample, k, hold, rng) -> int:
        if len(sample) < 2:
            return self.bits
        codes, seen = self.encode(sample), []
        for i in rng.permutation(len(sample))[:SAMPLE_QUERIES]:
            distance = ((sample - sample[i]) ** 2).sum(axis=1)
            distance[i] = np.inf
            near = np.argpartition(distance, min(k, len(sample) - 1) - 1)[:k]
            seen.append(np.bitwise_count(codes[near] ^ codes[i]))
        return int(np.ceil(np.quantile(np.concatenate(seen), hold)))

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        signs = (vectors - self.centre) @ self.rotation > 0
        padded = np.zeros((len(vectors), BITS), bool)
        padded[:, : self.bits] = signs
        return np.packbits(padded, axis=1, bitorder="little").view(np.uint64).ravel()


class MultiIndex:
    """The substrings' indexes over one shard of rows."""

    def __init__(self, codes: np.ndarray, substrings: int = SUBSTRINGS):
        self.codes, self.width = codes, BITS // substrings
        self.tables = []
        for j in range(substrings):
            part = self._part(codes, j)
            order = np.argsort(part, kind="stable")
            values, first = np.unique(part[order], return_index=True)
            self.tables.append((values, first, np.r_[first[1:], len(order)], order))

    def _part(self, codes: np.ndarray, j: int) -> np.ndarray:
        return (codes >> np.uint64(j * self.width)) & np.uint64((1 << self.width) - 1)

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Rows whose codes differ from ``code`` in ``radius`` bits at most.

        The radius is shared out: the first substrings take one bit more where it does not divide.
        """
        found = np.zeros(len(self.codes), bool)
        each, more = divmod(radius, len(self.tables))
        for j, (values, first, past, order) in enumerate(self.tables):
            near = np.flatnonzero(np.bitwise_count(values ^ self._part(code, j)) <= (each if j <= more else each - 1))
            if len(near):
                size = past[near] - first[near]
                place = np.repeat(first[near] - np.cumsum(size) + size, size) + np.arange(size.sum())
                found[order[place]] = True
        rows = np.flatnonzero(found)
        return rows[np.bitwise_count(self.codes[rows] ^ code) <= radius]


def best_rows(query: np.ndarray, own: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None, k: int):
    """The k nearest of some rows (None: all) by distance, then id; without rows of the query's id."""
    some, near = (ids, vectors) if rows is None else (ids[rows], vectors[rows])
    distance = np.sqrt(((near - query) ** 2).sum(axis=1))
    distance, some = distance[some != own], some[some != own]
    if len(some) > 4 * k:
        bound = np.partition(distance, k - 1)[k - 1]
        distance, some = distance[distance <= bound], some[distance <= bound]
    order = np.lexsort((some, distance))[:k]
    return some[order], distance[order]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, hold: float = HOLD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``queries`` its k nearest rows of ``vectors`` found.

    Both have vec_id and embedding. Rows whose vector is null, zero, holds a null or a component that is not finite, or
    has another length than most, take no part. A query is not its own neighbour; a repeated query row counts once.
    Fewer than k candidates: all of them. An empty table, or one without usable vectors, gives no rows.
    """
    spark = vectors.sparkSession
    kind = "query_id long, vec_id long, score double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sizes = rows.filter("embedding IS NOT NULL").groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").head()
    if sizes is None or not sizes["size"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = sizes["size"]
    sample = rows.filter(F.size("embedding") == size).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).toArrow()
    codes = Codes(np.concatenate([usable(b, size)[1] for b in sample.to_batches()] or [np.zeros((0, size))]), k, hold)

    def shards(batches):
        held, count = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(usable(batch, size))
                count += len(held[-1][0])
                if count >= SHARD_ROWS:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, count = [], 0
        if held:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def searched(block: pa.Table, exact: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast((*(np.concatenate(x) for x in zip(*[usable(b, size) for b in block.to_batches()], strict=True)), codes))

        def run(batches):
            query_ids, queried, own = shared.value
            query_codes = own.encode(queried)
            for ids, those in shards(batches):
                index = None if exact else MultiIndex(own.encode(those))
                out = []
                for i, q in enumerate(queried):
                    near, distance = best_rows(q, query_ids[i], ids, those, None if exact else index.within(query_codes[i], own.radius), k)
                    out.append((np.full(len(near), query_ids[i]), near, distance))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        return rows.mapInArrow(run, kind).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    def in_blocks(asked: DataFrame, exact: bool) -> DataFrame | None:
        """Union over blocks of ``QUERIES_AT_ONCE`` queries at most, each read and broadcast by itself."""
        blocks = -(-asked.count() // (QUERIES_AT_ONCE // 2))  # a block is a hash class of half that size on average
        out = None
        for number in range(blocks):
            block = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == number).toArrow()
            if block.num_rows and sum(len(usable(b, size)[0]) for b in block.to_batches()):
                part = searched(block, exact)
                out = part if out is None else out.unionByName(part)
        return out

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).dropDuplicates(["vec_id"])
    found = in_blocks(asked, exact=False)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = stored(found, "neighbours")
    full = found.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = in_blocks(asked.join(full, "vec_id", "left_anti"), exact=True)
    if short is not None:
        found = found.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(short)
    return found.select("query_id", "rank", "vec_id", "score")
