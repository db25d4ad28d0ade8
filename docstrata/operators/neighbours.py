"""Exact nearest neighbours among all vectors by an index of inverted lists.

Vectors are dealt into lists around centres that are learned on samples; a list that is too long is split again around
centres of its own. Each list is then one block with its centre, its radius as an angle, and what its own rows find among
themselves. By the triangle inequality for angles no row of another list is nearer to a row than the angle to the list's
centre less its radius, so only lists for which that is not far enough are looked at, first for whole lists, then for
single rows. What is left out is proven to hold no neighbour, so the result is that of comparing all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.operators.catalogue import rank_within
from docstrata.operators.vectors import BLOCK_BYTES, LEAST_ROWS, compared, matrix, unit
from docstrata.sources.shared import discard, materialise, owning

#: Rows of a list that its centres are learned on, on average; centres of a list at most; levels of lists.
SAMPLE_ROWS, BRANCH, LEVELS = 2048, 64, 8
#: Similarities are rounded to nine places; a bound must be below by more than that to leave a list out.
SLACK = 2e-9
#: Groups of columns whose greatest similarities bound the k-th of all from below.
GROUPS = 64


def spread_centres(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Up to ``k`` unit centres of unit rows: means of the rows that are nearest, begun with rows at equal steps."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = unit(np.where(np.bincount(near, minlength=len(centres))[:, None] > 0, sums, centres))
    return centres


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


def finite(vector: str) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _packed(rows: DataFrame, pieces: Column) -> DataFrame:
    """``list, piece, rows``: each list in pieces by hash of the keys."""
    return rows.groupBy("list", pieces.alias("piece")).agg(F.collect_list(F.struct("key", "v")).alias("rows"))


def _rows(batch: pa.RecordBatch, i: int, column: int) -> tuple[pa.Array, pa.Array]:
    """Keys and vectors of a block."""
    rows = batch.column(column).slice(i, 1).flatten()
    return rows.field("key"), rows.field("v")


def inverted_lists(vectors: DataFrame, key: str, vector: str, limit: int | None = None) -> tuple[DataFrame, int]:
    """``list, key, v`` of all finite vectors as a written table, and the rows that a block of a list may have.

    Begins with one list. Each list of more than ``limit`` rows (by default a block of 4 MB, less where cores would be idle)
    is split around centres learned on about SAMPLE_ROWS of its rows, chosen by hash, twice as many as blocks, BRANCH at
    most, until none is longer or a level of splitting changes nothing any more, as with equal vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.where(finite(vector)).select(F.lit(0).cast("long").alias("list"), F.col(key).cast("long").alias("key"), F.col(vector).alias("v"))
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).head()
    if limit is None:
        limit = max(1, min(BLOCK_BYTES // max(1, 8 * (dim or 1)), max(LEAST_ROWS, -(-n // spark.sparkContext.defaultParallelism))))

    def learned(sample: pd.DataFrame) -> pd.DataFrame:
        x = unit(np.array(sample["v"].tolist(), np.float64))
        x = x[np.any(x != 0, axis=1)]
        k = min(BRANCH, 2 * -(-int(sample["n"].iloc[0]) // limit))
        centres = spread_centres(x, k) if len(x) else np.zeros((0, dim))
        return pd.DataFrame({"list": [sample["list"].iloc[0]], "centres": [list(centres)]})

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, v = _rows(batch, i, 1)
                parent, centres = batch.column(0)[i].as_py(), batch.column(2)[i].values
                own = np.full(len(keys), parent)
                if centres is not None:
                    x = unit(matrix(v))
                    zero = ~np.any(x, axis=1)
                    near = (x @ matrix(centres).T).argmax(axis=1) if len(centres) else np.zeros(len(x), int)
                    own = parent * (BRANCH + 1) + 1 + np.where(zero, BRANCH, near)  # vectors of zeros have a list of their own
                yield pa.RecordBatch.from_arrays([pa.array(own), keys, v], names=["list", "key", "v"])

    kind = rows.schema["v"].dataType.simpleString()
    counted, known = [(0, n)] if n > limit else [], {}
    for level in range(LEVELS):
        if not counted:
            break
        sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
        long = materialise(sizes.where(F.col("n") > limit), "long")
        grain = 1 << 20
        chosen = F.pmod(F.xxhash64("key", F.lit(level)), F.lit(grain)) < F.lit(grain * SAMPLE_ROWS) / F.col("n")
        sample = rows.join(long, "list").where(chosen).select("list", "key", "v", "n")
        centres = materialise(sample.groupBy("list").applyInPandas(learned, "list long, centres array<array<double>>"), "centres")
        counts = rows.join(long, "list", "left").select("list", "key", "v", F.coalesce("n", F.lit(1)).alias("n"))
        packed = _packed(counts, F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / limit)))
        split = materialise(packed.drop("piece").join(centres, "list", "left").mapInArrow(dealt, f"list long, key long, v {kind}"), "lists")
        discard(long, centres, *([rows] if level else []))
        rows = split
        state = rows.groupBy("list").count().where(F.col("count") > limit).agg(F.count("*").alias("lists"), F.sum("count").alias("rows")).head()
        counted = [] if not state["lists"] or tuple(state) == known.get("state") else [state]
        known["state"] = tuple(state)
    return rows, limit


def _ranked(keys: np.ndarray, sims: np.ndarray, others: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each key the k greatest similarities, of equals those with the lesser others, but none below ``least``: rows of
    ``sims``, others and similarities, best first. A key's own column is left out."""
    own = np.flatnonzero(np.isin(keys, others))
    row, col = np.nonzero(keys[own, None] == others[None, :])
    sims[own[row], col] = -np.inf
    n, bound = sims.shape[1] // GROUPS * GROUPS, least - SLACK
    if n and k <= GROUPS:  # the k-th of the greatest of each group of columns is no more than the k-th of all
        most = sims[:, :n].reshape(len(sims), -1, GROUPS).max(axis=1)
        bound = np.maximum(bound, np.partition(most, -k, axis=1)[:, -k] - SLACK)
    row, col = np.nonzero(sims >= bound[:, None])
    sim = np.round(sims[row, col], 9)
    kept = (sim >= least[row]) & np.isfinite(sim)
    row, col, sim = row[kept], col[kept], sim[kept]
    order = np.lexsort((others[col], -sim, row))
    row, col, sim = row[order], col[order], sim[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], others[col][place < k], sim[place < k]


def _kth(row: np.ndarray, sims: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th similarity of each row, or -1 where there are fewer."""
    out, ends = np.full(n, -1.0), np.searchsorted(row, np.arange(n)) + k - 1
    full = (ends < len(row)) & (row[np.minimum(ends, len(row) - 1)] == np.arange(n)) if len(row) else np.zeros(n, bool)
    out[full] = sims[ends[full]]
    return out


def neighbours(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = Settings.neighbours, limit: int | None = None
) -> DataFrame:
    """``key, rank, neighbour, sim``: the k vectors most like each vector by cosine, itself (rows of its own key) left out.

    Similarities are rounded to nine places, ties fall to the lesser neighbour. A vector of zeros is like every other by 0.
    Rows with a null, empty or non-finite vector have no result and are none; an empty table gives an empty result. Keys
    are unique. When the result has been worked out, its ``comparisons.value`` is the number of pairs of rows compared.
    """
    comparisons = vectors.sparkSession.sparkContext.accumulator(0)
    lists, limit = inverted_lists(vectors, key, vector, limit)
    counted = lists.groupBy("list").agg(F.count("*").alias("n"))
    told = lists.join(counted, "list").select("list", "key", "v", "n")
    packed = _packed(told, F.pmod(F.xxhash64("key"), F.ceil(F.col("n") / limit))).drop("piece")
    numbered = packed.withColumn("id", F.monotonically_increasing_id())

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                names, v = _rows(batch, i, 1)
                keys, x = names.to_numpy(), unit(matrix(v))
                comparisons.add(len(keys) ** 2)
                parts = [[], [], []]
                for a in range(0, len(keys), 512):
                    row, other, sim = _ranked(keys[a : a + 512], x[a : a + 512] @ x.T, keys, k, np.full(min(512, len(keys) - a), -np.inf))
                    for p, c in zip(parts, (row + a, other, sim)):
                        p.append(c)
                row, other, sim = map(np.concatenate, parts)
                kth = _kth(row, sim, len(keys), k)
                centre = unit(x.sum(axis=0, keepdims=True))
                zero = ~np.any(x, axis=1)
                radius = float(np.where(zero, np.pi / 2 if not zero.all() else 0, angle(x @ centre[0])).max())
                found = pa.StructArray.from_arrays([pa.array(keys[row]), pa.array(other), pa.array(sim)], ["key", "neighbour", "sim"])
                rows = pa.StructArray.from_arrays([names, v, pa.array(kth)], ["key", "v", "kth"])
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                meta = pa.array([[*centre[0], radius, float(kth.min())]])
                yield pa.RecordBatch.from_arrays([batch.column(2).slice(i, 1), meta, one(rows), one(found)], names=["id", "meta", "rows", "found"])

    kind = lists.schema["v"].dataType.simpleString()
    schema = f"id long, meta array<double>, rows array<struct<key: long, v: {kind}, kth: double>>, found array<struct<key: long, neighbour: long, sim: double>>"
    blocks = materialise(numbered.select("list", "rows", "id").mapInArrow(inside, schema), "blocks")
    discard(lists)

    def near(ids: np.ndarray, x: np.ndarray, others: np.ndarray, y: np.ndarray) -> Iterator[list[np.ndarray]]:
        between = angle(x[:, :-2] @ y[:, :-2].T) - x[:, -2:-1] - y[None, :, -2]
        q, b = np.nonzero((np.cos(np.maximum(between, 0)) >= x[:, -1:] - SLACK) & (ids[:, None] != others[None, :]))
        yield [ids[q], others[b]]

    meta = blocks.select("id", "meta")
    pairs = materialise(compared(meta, meta, "id", "meta", near, "a long, b long"), "pairs")
    first = blocks.select(F.col("id").alias("a"), F.col("rows").alias("queries"))
    second = blocks.select(F.col("id").alias("b"), "rows", F.col("meta").alias("about"))
    met = pairs.join(first, "a").join(second, "b").select("queries", "rows", "about")

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                queries = batch.column(0).slice(i, 1).flatten()
                keys, x, kth = queries.field("key").to_numpy(), unit(matrix(queries.field("v"))), queries.field("kth").to_numpy()
                others, v = _rows(batch, i, 1)
                about = batch.column(2)[i].values.to_numpy()
                some = np.flatnonzero(np.cos(np.maximum(angle(x @ about[:-2]) - about[-2], 0)) >= kth - SLACK)
                y, others = unit(matrix(v)), others.to_numpy()
                comparisons.add(len(some) * len(others))
                for a in range(0, len(some), 512):
                    at = some[a : a + 512]
                    row, other, sim = _ranked(keys[at], x[at] @ y.T, others, k, kth[at])
                    yield pa.RecordBatch.from_arrays([pa.array(keys[at][row]), pa.array(other), pa.array(sim)], names=["key", "neighbour", "sim"])

    other = met.mapInArrow(outside, "key long, neighbour long, sim double")
    own = blocks.select(F.explode("found").alias("f")).select("f.key", "f.neighbour", "f.sim")
    ranked = rank_within(own.unionByName(other), "key", k, F.desc("sim"), "neighbour")
    result = owning(ranked.select(F.col("key").alias(key), "rank", "neighbour", "sim"), blocks, pairs)
    result.comparisons = comparisons
    return result
