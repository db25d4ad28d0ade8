"""Operators on embedding vectors: centroids, nearest seeds, nearest neighbours, principal components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.operators.catalogue import rank_within

#: Bytes of vectors in a block, in double precision; queries are dealt over all cores in blocks of fewer rows.
BLOCK_BYTES, LEAST_ROWS = 4 << 20, 256


def centroids(vectors: DataFrame, by: str, vector: str = "embedding") -> DataFrame:
    """``by, dim, value``: the mean vector of each group, by dimension; partial sums move, not vectors."""
    return vectors.select(by, F.posexplode(vector).alias("dim", "x")).groupBy(by, "dim").agg(F.avg(F.col("x").cast("double")).alias("value"))


def as_arrays(long: DataFrame, by: str) -> DataFrame:
    """``by, embedding`` from ``by, dim, value``."""
    return long.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("dim", "value"))).alias("v")).select(by, F.transform("v", lambda x: x["value"]).alias("embedding"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _packed(vectors: DataFrame, key: str, vector: str, parts: int, name: str) -> DataFrame:
    """``name, keys, rows``: the vectors in ``parts`` blocks by hash of their keys, one row for each that has any."""
    numbered = vectors.select(F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(name), F.struct(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).alias("p"))
    return numbered.groupBy(name).agg(F.collect_list("p").alias(f"{name}_rows")).withColumn("meet", F.lit(0))


def compared(
    queries: DataFrame, base: DataFrame, key: str, vector: str, found: Callable[..., Iterator[list[np.ndarray]]], schema: str
) -> DataFrame:
    """What ``found`` makes of the keys and vectors of a block of queries and of a block of ``base``: every two blocks meet
    once, in one task. Blocks are bounded in bytes, whatever the number of vectors, and never reach the driver; the planner
    broadcasts the blocks of ``base`` where they are few."""
    n, dim = base.agg(F.count("*"), F.max(F.size(vector))).head()
    parts = max(1, -(-(n * (dim or 0) * 8) // BLOCK_BYTES))
    n_queries = n if queries is base else queries.count()
    cores = queries.sparkSession.sparkContext.defaultParallelism
    query_parts = max(-(-(n_queries * (dim or 0) * 8) // BLOCK_BYTES), min(cores, -(-n_queries // LEAST_ROWS)), 1)
    meeting = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = _packed(queries, key, vector, query_parts, "q").withColumn("b", meeting).repartition(query_parts * parts if query_parts * parts < 10_000 else 10_000, "q", "b")
    pairs = left.join(_packed(base, key, vector, parts, "b").drop("meet"), "b").select("q_rows", "b_rows")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (k, x), (others, y) = (
                    (rows.field("k").to_numpy(zero_copy_only=False), matrix(rows.field("v"))) for rows in (batch.column(c).slice(i, 1).flatten() for c in (0, 1))
                )
                for columns in found(k, x, others, y):
                    yield pa.RecordBatch.from_arrays([pa.array(list(c) if c.ndim > 1 else c) for c in columns], names=names)

    return pairs.mapInArrow(run, schema)


def _ranked(keys: np.ndarray, sims: np.ndarray, others: np.ndarray, k: int, itself: bool) -> list[np.ndarray]:
    """For each key the k greatest similarities, rounded; of equals the lesser other."""
    sims = np.round(sims, 9)
    if not itself:
        sims[keys[:, None] == others[None, :]] = -np.inf
    order = np.lexsort((np.broadcast_to(others, sims.shape), -sims), axis=1)[:, :k]
    best = np.take_along_axis(sims, order, axis=1)
    rows = np.isfinite(best)
    return [np.repeat(keys, rows.sum(axis=1)), others[order][rows], best[rows]]


def nearest(queries: DataFrame, base: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = Settings.neighbours, itself: bool = False) -> DataFrame:
    """``key, rank, neighbour, sim``: the k vectors of ``base`` most like each query by cosine, itself left out unless it is
    asked for.

    Exact: blocks of queries meet blocks of ``base``, and what two blocks give is cut to k rows per query before it moves.
    Similarities are rounded to nine places so that ties fall to the lesser neighbour.
    """

    def found(keys: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[list[np.ndarray]]:
        y = unit(y)
        for a in range(0, len(keys), 512):
            yield _ranked(keys[a : a + 512], unit(x[a : a + 512]) @ y.T, others, k, itself)

    near = compared(queries, base, key, vector, found, "key long, neighbour long, sim double")
    return rank_within(near, "key", k, F.desc("sim"), "neighbour").select(F.col("key").alias(key), "rank", "neighbour", "sim")


def nearest_seed(vectors: DataFrame, seeds: DataFrame, key: str = "vec_id", seed_key: str = "seed") -> DataFrame:
    """``key, seed, sim``: the seed vector most like each vector, of equals the first by its key."""
    numbers = Window.orderBy(seed_key)  # one row per seed
    numbered = seeds.select((F.row_number().over(numbers)).cast("long").alias(key), F.col(seed_key), "embedding")
    best = nearest(vectors, numbered, key, k=1, itself=True)
    names = numbered.select(F.col(key).alias("neighbour"), seed_key)
    return best.join(names, "neighbour").select(key, seed_key, "sim")


def guided(vectors: DataFrame, seeds: DataFrame, key: str = "vec_id", seed_key: str = "seed") -> DataFrame:
    """``key, embedding``: vectors pulled a quarter of the way to the seed they are most like, unless the mean vector is more
    like them. ``seeds``: ``seed, embedding``, of a type that holds the empty string."""
    mean = as_arrays(centroids(vectors.withColumn(seed_key, F.lit("")), seed_key), seed_key)
    all_seeds = seeds.select(seed_key, F.col("embedding").cast("array<double>").alias("embedding")).unionByName(mean)
    near = nearest_seed(vectors.select(key, "embedding"), all_seeds, key, seed_key).where(F.col(seed_key) != "")
    near = near.join(seeds.select(seed_key, F.col("embedding").cast("array<double>").alias("pull")), seed_key).select(key, "pull")
    own = F.col("embedding").cast("array<double>")
    pulled = F.when(F.col("pull").isNull(), own).otherwise(F.zip_with(own, "pull", lambda x, y: (x * 3 + y) / 4))
    return vectors.select(key, "embedding").join(near, key, "left").select(key, pulled.alias("embedding"))


def components(vectors: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``key, pc``: centred principal components, as an array. The covariance is summed on the executors."""
    rows = vectors.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    dims = range(rows.select(F.size(vector_to_array("v"))).head()[0])
    means = vectors.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in dims]).head()
    centred = vectors.select(key, array_to_vector(F.zip_with(F.col(vector).cast("array<double>"), F.array(*[F.lit(m) for m in means]), lambda x, m: x - m)).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="p").fit(centred).transform(centred).select(key, vector_to_array("p").alias("pc"))


def rescaled(found: DataFrame, target: float = 1e-4) -> DataFrame:
    """Components scaled so that the first has the target as its population deviation."""
    deviation = found.agg(F.stddev_pop(F.col("pc")[0]).alias("sd"))
    return found.join(F.broadcast(deviation)).select(*[c for c in found.columns if c != "pc"], F.transform("pc", lambda x: x / (F.col("sd") / target)).alias("pc"))


def dimension(found: Column, i: int) -> Column:
    return F.element_at(found, i + 1)
