"""Word vectors from the corpus alone: positive pointwise mutual information in windows, reduced by a randomised block
singular value decomposition of the distributed sparse matrix.

The vocabulary has at most MOST_WORDS words, so thin factors (a row of RANK + EXTRA numbers for each word) fit the driver and
every worker; counts and the matrix, whose size follows the corpus, stay tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.sources.shared import discard, materialise

#: Words of the vocabulary at most, the most frequent ones; times that a word occurs at least; words on either side of one.
MOST_WORDS, LEAST_TIMES, REACH = 1 << 15, 5, 2
#: Dimensions of vectors, further ones that only the decomposition has, multiplications that sharpen it, seed.
RANK, EXTRA, POWERS, SEED = 64, 16, 2, 42
#: Of a word as frequent as this, half the weight counts in the mean of a text.
COMMON = 1e-3


def vocabulary(texts: DataFrame, text: str, most: int = MOST_WORDS, least: int = LEAST_TIMES) -> list[tuple[str, int]]:
    """The most frequent words and how often they occur, of equals the first; at most ``most``."""
    counts = texts.select(F.explode(T.tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def meetings(texts: DataFrame, text: str, words: list[str], reach: int = REACH) -> DataFrame:
    """``i, j, n``: how often word j stands at most ``reach`` words before or after word i. Other words keep their places but are
    not counted. Pairs are counted in each batch, and added up before they move."""
    known = pa.array(words, pa.string())
    size = max(1, len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ids = pc.fill_null(pc.index_in(lists.flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            keys = []
            for d in range(1, reach + 1):
                a, b = ids[:-d], ids[d:]
                both = (owner[:-d] == owner[d:]) & (a >= 0) & (b >= 0)
                keys += [a[both] * size + b[both], b[both] * size + a[both]]
            found, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found // size), pa.array(found % size), pa.array(n)], names=["i", "j", "n"])

    tokens = texts.select(T.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    return tokens.mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))


def associations(counts: DataFrame) -> DataFrame:
    """``i, j, n, ppmi`` of ``i, j, n``: the logarithm of how much more often two words meet than by chance, where that is more
    than 0. ``counts``: a written table."""
    sums = counts.groupBy("i").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s").alias("all"))
    told = counts.join(sums.withColumnRenamed("s", "si"), "i").join(sums.select(F.col("i").alias("j"), F.col("s").alias("sj")), "j").join(F.broadcast(total))
    ppmi = F.log(F.col("n") * F.col("all") / (F.col("si") * F.col("sj")))
    return told.select("i", "j", "n", ppmi.alias("ppmi")).where(F.col("ppmi") > 0)


def times(matrix: DataFrame, x: np.ndarray) -> np.ndarray:
    """The product of a symmetric sparse matrix (``i, j, ppmi``) and a thin one. Rows come sorted from their table, so a task adds
    up most entries of a row before it sends their sum; a row that several tasks have comes in as many sums."""
    thin = matrix.sparkSession.sparkContext.broadcast(x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = -1, np.zeros(thin.value.shape[1])
        for batch in batches:
            i, j, v = (c.to_numpy() for c in batch.columns)
            for a in range(0, len(i), 1 << 15):
                rows, starts = np.unique(i[a : a + (1 << 15)], return_index=True)
                sums = np.add.reduceat(thin.value[j[a : a + (1 << 15)]] * v[a : a + (1 << 15), None], starts, axis=0)
                if rows[0] == last:
                    sums[0] += kept
                elif last >= 0:
                    yield out_of(np.array([last]), kept[None])
                last, kept = int(rows[-1]), sums[-1]
                if len(rows) > 1:
                    yield out_of(rows[:-1], sums[:-1])
        if last >= 0:
            yield out_of(np.array([last]), kept[None])

    def out_of(rows: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows), pa.array([r.tobytes() for r in sums], pa.binary())], names=["i", "row"])

    out = np.zeros_like(x)
    for r in matrix.select("i", "j", "ppmi").mapInArrow(run, "i long, row binary").toLocalIterator():
        out[r["i"]] += np.frombuffer(r["row"])
    thin.destroy()
    return out


def decomposed(matrix: DataFrame, n: int, rank: int = RANK, extra: int = EXTRA, powers: int = POWERS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The greatest singular values of a symmetric matrix of ``n`` rows, and the left singular vectors as columns, their
    greatest components positive. A random subspace is multiplied by the matrix and made orthonormal, again and again."""
    width = min(n, rank + extra)
    q = np.random.Generator(np.random.PCG64(seed)).standard_normal((n, width))
    if not width:
        return np.zeros(0), np.zeros((n, 0))
    for _ in range(powers + 1):
        q = np.linalg.qr(times(matrix, q))[0]
    small = q.T @ times(matrix, q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")[:rank]
    left = q @ vectors[:, order]
    signs = np.sign(left[np.abs(left).argmax(axis=0), np.arange(left.shape[1])])
    return np.abs(values[order]), left * np.where(signs == 0, 1, signs)


def word_associations(texts: DataFrame, text: str = "text", most: int = MOST_WORDS, least: int = LEAST_TIMES, reach: int = REACH) -> tuple[DataFrame, list[tuple[str, int]]]:
    """``associations`` of the words of all texts, sorted for products, as a written table, and the vocabulary."""
    words = vocabulary(texts, text, most, least)
    counts = materialise(meetings(texts, text, [w for w, _ in words], reach), "meetings")
    found = materialise(associations(counts).repartition("i").sortWithinPartitions("i", "j"), "associations")
    discard(counts)
    return found, words


def learn(texts: DataFrame, text: str = "text", rank: int = RANK, most: int = MOST_WORDS, least: int = LEAST_TIMES, reach: int = REACH) -> DataFrame:
    """``word, weight, vector``: a vector of each word of the vocabulary, its singular vectors' components times the roots of the
    singular values, and its weight in the mean of a text, which falls with its frequency. Null and empty texts have no words;
    without any word the table is empty. A corpus of fewer words than ``rank`` has vectors with zeros at the end."""
    matrix, words = word_associations(texts, text, most, least, reach)
    values, left = decomposed(matrix, len(words), rank)
    discard(matrix)
    vectors = np.zeros((len(words), rank))
    vectors[:, : len(values)] = left * np.sqrt(values)
    total = sum(n for _, n in words) or 1
    weights = [COMMON / (COMMON + n / total) for _, n in words]
    columns = [pa.array([w for w, _ in words], pa.string()), pa.array(weights, pa.float64()), pa.array(list(vectors), pa.list_(pa.float64()))]
    return texts.sparkSession.createDataFrame(pa.table(columns, names=["word", "weight", "vector"]))


def text_vectors(rows: DataFrame, vectors: DataFrame, *key: str, text: str = "text", rank: int = RANK) -> DataFrame:
    """``key..., embedding``: for each key that has a known word the weighted mean of the vectors of its words, repeats counted.
    Words are counted before they move."""
    counted = rows.select(*key, F.explode(T.tokens(F.col(text))).alias("word")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    met = counted.join(vectors, "word").withColumn("w", F.col("n") * F.col("weight"))
    sums = met.groupBy(*key).agg(F.sum("w").alias("whole"), *[F.sum(F.col("w") * F.col("vector")[i]).alias(f"v{i}") for i in range(rank)])
    return sums.select(*key, F.array(*[F.col(f"v{i}") / F.col("whole") for i in range(rank)]).alias("embedding"))
