"""Centroid clustering: Lloyd's rounds in whole numbers over column blocks of the vectors.

Vectors are turned to integers and written once as a table of column blocks: a row holds ``block_columns`` columns of
up to ``CHUNK_ROWS`` vectors. In a round every block task needs only its own slice of the centroids: it gives exact
partial squared distances, which meet by chunk, are added, and give the nearest centroid. The numbers of the nearest
centroids go back to the blocks, and each block adds up and divides its own slice. The table is bucketed by chunk and
block, so vectors are shuffled once and never again; a round moves the partial distances and one number per vector
and block. The driver holds the centroids only: ``k`` times the dimension, whatever the number of vectors.

All sums are exact, so the result depends neither on partitions nor on a lost task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fraudspark.llm.common import stored
from fraudspark.session import scratch_path

CHUNK_ROWS = 4096
BLOCK_COLUMNS = 16


def usable(vectors: DataFrame, vector: str, dimension: int) -> DataFrame:
    """vec_id and vector (doubles) of rows with exactly ``dimension`` components, none null, NaN or infinite."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))

    values = F.col(vector).cast("array<double>")
    return vectors.select(F.col("vec_id"), values.alias("vector")).filter((F.size("vector") == dimension) & F.forall("vector", finite))


def first_centroids(kept: DataFrame, k: int, seed: int, scale: int) -> np.ndarray:
    """The ``k`` vectors whose ids have the smallest hashes, in that order; equal ids by their components, null ids last."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = kept.orderBy(mark.asc_nulls_last(), "vector").limit(k).select("vector").collect()
    return whole(np.array([r["vector"] for r in rows]).reshape(len(rows), -1 if rows else 0), scale)


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); an error where a squared distance could leave 64 bits."""
    numbers = np.floor(values * float(scale))
    if numbers.size and 4 * numbers.shape[1] * float(np.abs(numbers).max()) ** 2 >= 2.0**63:
        raise ValueError("a component is too large for squared distances of 64 bits")
    return numbers.astype(np.int64)


def column_blocks(kept: DataFrame, dimension: int, scale: int, columns: int, rows: int) -> tuple[DataFrame, str]:
    """(chunk, block, ids, data) and the name of its table, bucketed by chunk and block; ids only stand with block 0."""
    id_type = kept.schema["vec_id"].dataType.simpleString()
    starts = range(0, dimension, columns)

    def cut(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                values = whole(part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension), scale)
                data = [np.ascontiguousarray(values[:, s : s + columns]).tobytes() for s in starts]
                ids = pa.array([part["vec_id"].to_pylist(), *[None] * (len(data) - 1)], pa.list_(part["vec_id"].type))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([chunk] * len(data), pa.int64()), pa.array(range(len(data)), pa.int32()), ids, pa.array(data, pa.binary())],
                    names=["chunk", "block", "ids", "data"],
                )
                chunk += 1

    spark = kept.sparkSession
    buckets, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"column_blocks_{uuid.uuid4().hex}"
    blocks = kept.mapInArrow(cut, f"chunk long, block int, ids array<{id_type}>, data binary").repartition(buckets, "chunk", "block")
    blocks.write.option("path", scratch_path(spark, "column-blocks")).bucketBy(buckets, "chunk", "block").saveAsTable(name)
    return spark.table(name), name


def partial_distances(blocks: DataFrame, centroids: np.ndarray, columns: int) -> DataFrame:
    """(chunk, partial): per vector and centroid the squared distance within the block's columns."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                own = centroids[:, batch["block"][i].as_py() * columns :][:, :columns]
                data = np.frombuffer(batch["data"][i].as_buffer(), np.int64).reshape(-1, own.shape[1])
                out = np.empty((len(data), k), np.int64)
                for c in range(k):
                    gap = data - own[c]
                    out[:, c] = np.einsum("ij,ij->i", gap, gap)
                yield pa.RecordBatch.from_arrays([batch["chunk"].slice(i, 1), pa.array([out.tobytes()], pa.binary())], names=["chunk", "partial"])

    return blocks.select("chunk", "block", "data").mapInArrow(run, "chunk long, partial binary")


def nearest(blocks: DataFrame, centroids: np.ndarray, columns: int) -> DataFrame:
    """(chunk, labels, distances): partial distances added by chunk; the nearest centroid, ties to the smaller number."""
    k = len(centroids)

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch["partial"]:
                part = np.frombuffer(value.as_buffer(), np.int64).reshape(-1, k)
                total = part.copy() if total is None else np.add(total, part, out=total)
        label = total.argmin(axis=1)
        distance = total[np.arange(len(total)), label]
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int64()), pa.array([label.astype(np.int32).tobytes()], pa.binary()), pa.array([distance.tobytes()], pa.binary())],
            names=["chunk", "labels", "distances"],
        )

    return partial_distances(blocks, centroids, columns).groupBy("chunk").applyInArrow(add, "chunk long, labels binary, distances binary")


def moved(blocks: DataFrame, labels: DataFrame, centroids: np.ndarray, columns: int) -> np.ndarray:
    """The next centroids: each block's floor(sum / count) of its own columns; a centroid without vectors stays."""
    k, dimension = centroids.shape
    count = -(-dimension // columns)

    def sums(batches: Iterator[pa.RecordBatch]):
        totals, members = np.zeros((k, count * columns), np.int64), np.zeros((k, count), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch["block"][i].as_py()
                label = np.frombuffer(batch["labels"][i].as_buffer(), np.int32)
                data = np.frombuffer(batch["data"][i].as_buffer(), np.int64).reshape(len(label), -1)
                for c in np.unique(label):
                    mine = label == c
                    totals[c, block * columns :][: data.shape[1]] += data[mine].sum(axis=0)
                    members[c, block] += mine.sum()
        c, at = np.nonzero(np.repeat(members, columns, axis=1)[:, :dimension])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(totals[c, at]), pa.array(members[c, at // columns])],
            names=["cluster", "place", "total", "members"],
        )

    own = labels.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"), "labels")
    slices = (
        blocks.select("chunk", "block", "data").join(own, ["chunk", "block"])
        .mapInArrow(sums, "cluster int, place int, total long, members long")
        .groupBy("cluster", "place").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
        .select("cluster", "place", F.expr("(total - pmod(total, members)) div members").alias("value"))
    )
    out = centroids.copy()
    for row in slices.collect():  # at most k times the dimension
        out[row["cluster"], row["place"]] = row["value"]
    return out


def cluster(
    vectors: DataFrame, vector: str = "embedding", dimension: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3,
    block_columns: int = BLOCK_COLUMNS, chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or hold null or non-finite components are left out. Rows with the same id
    are vectors of their own; a null id can be in a cluster, and seeds one only if fewer than ``k`` ids are there. With
    fewer than ``k`` vectors there are as many clusters. An empty table gives no rows. Other columns are not read.
    A component of 2^27 or more after scaling (at 64 dimensions) is an error, since distances would not fit.
    """
    kept = usable(vectors, vector, dimension)
    spark, id_type = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    kinds = f"vec_id {id_type}, cluster int, distance long"
    centroids = first_centroids(kept, k, seed, scale)
    if not len(centroids):
        return spark.createDataFrame([], f"{kinds}, cluster_inertia long, inertia long, centroid_sha256 string")
    blocks, name = column_blocks(kept, dimension, scale, block_columns, chunk_rows)
    for _ in range(rounds):
        centroids = moved(blocks, nearest(blocks, centroids, block_columns), centroids, block_columns)

    def rows(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(batch.num_rows):
                label, distance = np.frombuffer(batch["labels"][i].as_buffer(), np.int32), np.frombuffer(batch["distances"][i].as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([batch["ids"][i].values, pa.array(label), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    members = blocks.filter("block = 0").select("chunk", "ids")
    found = stored(members.join(nearest(blocks, centroids, block_columns), "chunk").select("ids", "labels", "distances").mapInArrow(rows, kinds), "clusters")
    spark.sql(f"DROP TABLE {name}")
    inertia = {r["cluster"]: r["n"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("n")).collect()}  # a row per cluster
    digest = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(dimension: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3) -> str:
    """SQL for the rows of :func:`cluster`, one pair of common tables per round; ids are unique."""
    def assigned(i: int) -> str:
        return (
            f"gaps{i} AS MATERIALIZED (SELECT vec_id, cluster, sum((x - value) * (x - value)) AS distance FROM cells JOIN centroids{i} USING (place) GROUP BY ALL),\n"
            f"near{i} AS MATERIALIZED (SELECT vec_id, min_by(cluster, (distance, cluster)) AS cluster, min(distance) AS distance FROM gaps{i} GROUP BY vec_id)"
        )

    parts = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dimension})""",
        f"cells AS MATERIALIZED (SELECT vec_id, unnest(range({dimension})) AS place, unnest(v) AS x FROM kept)",
        f"seeds AS (SELECT v, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster FROM kept QUALIFY cluster < {k})",
        f"centroids0 AS MATERIALIZED (SELECT cluster, unnest(range({dimension})) AS place, unnest(v) AS value FROM seeds)",
    ]
    for i in range(rounds):
        parts += [
            assigned(i),
            f"means{i} AS MATERIALIZED (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM cells JOIN near{i} USING (vec_id) GROUP BY ALL)",
            f"""centroids{i + 1} AS MATERIALIZED (
  SELECT cluster, place, CASE WHEN n IS NULL THEN value ELSE (s - ((s % n) + n) % n) // n END AS value
  FROM centroids{i} LEFT JOIN means{i} USING (cluster, place))""",
        ]
    parts += [
        assigned(rounds),
        f"digests AS (SELECT cluster, sha256(string_agg(CAST(value AS VARCHAR), ',' ORDER BY place)) AS centroid_sha256 FROM centroids{rounds} GROUP BY cluster)",
    ]
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM near{rounds} JOIN digests USING (cluster)"""


ORACLE = oracle()
