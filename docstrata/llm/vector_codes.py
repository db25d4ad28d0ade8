"""Compression of vectors to short codes: codebooks of integers for parts of the vector, searched by partial distances.

A component becomes an integer, a vector a row of equal parts, and a part the number of the nearest entry of its position's
codebook. All distances are integers, so results are exact and the same on every machine.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches

#: Parts of a vector, entries of a codebook at most, rounds of learning, integers to a unit.
PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors compared at once, and dimensions between two looks for a better complete distance.
ROWS, STEP = 512, 4
#: Integers from here on are an error: sums of their squared differences could leave 64 bits.
MOST = 1 << 27


@dataclass(frozen=True)
class Codebooks:
    """``entries[part]``: one row of integers for each entry of the part's codebook."""

    entries: list[np.ndarray]

    @property
    def dim(self) -> int:
        return sum(e.shape[1] for e in self.entries)

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(str(v) for e in self.entries for v in e.ravel().tolist()).encode()).hexdigest()


def search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the nearest row of ``book`` by squared distance, of equals the first, and that distance.

    Dimensions come in the order of falling variance among the entries. The most promising entry of a row is completed
    every few dimensions, and an entry is dropped once what it has summed up is strictly more than the best complete
    distance so far, so that all entries at the least distance are still there at the end.
    """
    n, dims = x.shape
    reach = 2 * int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)))
    kind = np.int32 if dims * reach * reach < 1 << 31 else np.int64
    order = np.argsort(-book.var(axis=0), kind="stable")
    x, book = x[:, order].astype(kind), book[:, order].astype(kind)

    def complete(entry: np.ndarray) -> np.ndarray:
        return np.square(x - book[entry]).sum(axis=1, dtype=kind)

    total = np.zeros((n, len(book)), kind)
    for d in range(min(STEP, dims)):
        total += np.square(x[:, d, None] - book[None, :, d])
    best = complete(total.argmin(axis=1))
    row, entry = np.nonzero(total <= best[:, None])
    total = total[row, entry]
    for a in range(STEP, dims, STEP):
        for d in range(a, min(a + STEP, dims)):
            total = total + np.square(x[row, d] - book[entry, d])
            live = total <= best[row]
            row, entry, total = row[live], entry[live], total[live]
        best = np.minimum(best, complete(entry[_least(row, total, n)]))
    at = _least(row, total, n)
    return entry[at], total[at].astype(np.int64)


def _least(row: np.ndarray, total: np.ndarray, n: int) -> np.ndarray:
    """Where each row's least total stands first; rows ascend, and each occurs."""
    starts = np.searchsorted(row, np.arange(n))
    low = np.minimum.reduceat(total, starts)
    hits = np.flatnonzero(total == low[row])
    return hits[np.searchsorted(row[hits], np.arange(n))]


def well_formed(vector: str, dim: int | None = None) -> Column:
    """Not null, without null or non-finite components, and of length ``dim`` if that is given."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    found = F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))
    return found & (F.size(vector) == dim) if dim is not None else found


def integers(column: pa.Array, dim: int) -> np.ndarray:
    """Well-formed vectors as rows of integers."""
    scaled = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(len(column), dim)
    if np.abs(scaled).max(initial=0) >= MOST:
        raise ValueError(f"a component of {MOST // SCALE} or more")
    return scaled.astype(np.int64)


def nearest_entries(x: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance for each row and part."""
    width = books.dim // len(books.entries)
    entry, far = np.zeros((2, len(x), len(books.entries)), np.int64)
    for p, book in enumerate(books.entries):
        for a in range(0, len(x), ROWS):
            entry[a : a + ROWS, p], far[a : a + ROWS, p] = search(x[a : a + ROWS, p * width : (p + 1) * width], book)
    return entry, far


def _moved(df: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """Each entry replaced by the mean of its parts, rounded down; entries without parts stay. Tasks send one row of sums for
    each entry that they used; the means are as many as the entries, and the driver has them."""
    dim, width = books.dim, books.dim // len(books.entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(e.shape, np.int64) for e in books.entries]
        counts = [np.zeros(len(e), np.int64) for e in books.entries]
        for batch in batches:
            x = integers(batch.column(0), dim)
            for p, used in enumerate(nearest_entries(x, books)[0].T):
                order = np.argsort(used, kind="stable")
                codes, starts = np.unique(used[order], return_index=True)
                if len(codes):
                    sums[p][codes] += np.add.reduceat(x[order, p * width : (p + 1) * width], starts, axis=0)
                    counts[p] += np.bincount(used, minlength=len(counts[p]))
        rows = [(p, e, counts[p][e], sums[p][e].tolist()) for p in range(len(sums)) for e in np.flatnonzero(counts[p])]
        if rows:
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "sums"])

    told = df.select(vector).mapInArrow(run, "part int, entry int, n long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    new = [e.copy() for e in books.entries]
    for part, entry, n, *total in told.groupBy("part", "entry").agg(F.sum("n").alias("n"), *totals).collect():
        new[part][entry] = [t // n for t in total]
    return Codebooks(new)


def learn_codebooks(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks of the parts of all well-formed vectors.

    They begin with the parts of the ``entries`` rows with the smallest keys (null last; of equal keys by components), fewer
    where there are fewer rows. Each round assigns every part of every row to its nearest entry, of equals the first, and
    moves each entry to the mean of its parts, rounded down; entries without parts stay. Vectors have the length that most
    rows have, of equals the greater; rows of other lengths are left out. Without rows the codebooks have no entries. A
    length that ``parts`` does not divide, and a component of ``MOST / SCALE`` or more, is an error. The driver holds the
    first rows and the codebooks, whose size is given by the parameters.
    """
    bounded_batches(df.sparkSession)
    rows = df.where(well_formed(vector))
    length = rows.groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).head()
    dim = length["dim"] if length else 0
    if dim % parts:
        raise ValueError(f"vectors of length {dim} have no {parts} equal parts")
    rows = df.where(well_formed(vector, dim)).select(F.col(key).alias("k"), F.col(vector).alias("v"))
    first = rows.orderBy(F.col("k").asc_nulls_last(), "v").limit(entries).select("v").collect()
    x = integers(pa.array([r["v"] for r in first], pa.list_(pa.float64())), dim)
    books = Codebooks([part.copy() for part in np.split(x, parts, axis=1)])
    for _ in range(rounds if len(first) else 0):
        books = _moved(rows, "v", books)
    return books


def encode(df: DataFrame, books: Codebooks, *keep: str, vector: str = "embedding") -> DataFrame:
    """``keep..., entries, error``: for each well-formed vector of the codebooks' length the entry of each part (from 0), and
    the squared distance to them; other rows are left out. Nothing moves."""
    dim, names = books.dim, [f"k{i}" for i in range(len(keep))]
    rows = df.where(well_formed(vector, dim)).select(F.col(vector).alias("v"), *[F.col(c).alias(n) for c, n in zip(keep, names)])
    if not len(books.entries[0]):
        rows = rows.limit(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, far = nearest_entries(integers(batch.column(0), dim), books)
            out = [pa.array(list(entry.astype(np.int32)), pa.list_(pa.int32())), pa.array(far.sum(axis=1))]
            yield pa.RecordBatch.from_arrays([*out, *batch.columns[1:]], names=["entries", "error", *names])

    kinds = "".join(f", {n} {t}" for n, t in rows.dtypes[1:])
    found = rows.mapInArrow(run, f"entries array<int>, error long{kinds}")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "entries", "error")


def decode(coded: DataFrame, books: Codebooks, *keep: str) -> DataFrame:
    """``keep..., embedding``: the vectors that codes (``entries``) stand for."""
    names = [f"k{i}" for i in range(len(keep))]
    rows = coded.select(F.col("entries").alias("e"), *[F.col(c).alias(n) for c, n in zip(keep, names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            x = np.concatenate([book[e] for book, e in zip(books.entries, entry.T)], axis=1) / SCALE
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["embedding", *names])

    kinds = "".join(f", {n} {t}" for n, t in rows.dtypes[1:])
    found = rows.mapInArrow(run, f"embedding array<double>{kinds}")
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep)], "embedding")


def hex_code(entries: str = "entries", parts: int = PARTS) -> Column:
    """Two lower-case hexadecimal digits for each part."""
    return F.concat(*[F.lpad(F.lower(F.hex(F.get(entries, p))), 2, "0") for p in range(parts)])


def summed_by(found: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """``found`` with the sum of ``value`` over the rows that are equal in ``by``, nulls together. Sums are made before they
    move; joined with a written ``found``, rows of a hot value can be split among tasks."""
    sums = found.groupBy(F.col(by).alias("_by")).agg(F.sum(value).alias(name))
    return found.join(sums, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def vector_codes_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for the codes of all ``embeddings`` of one length, every entry compared with every part; integers are kept in
    doubles, where they are exact."""
    steps = [f"""kept AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT r, vec_id, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS x FROM kept, (SELECT unnest(generate_series(0, {parts - 1})) AS p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id, x) - 1 AS e, x FROM parts QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id, x) <= {entries}
)"""]
    for n in range(rounds + 1):
        steps.append(f"""a{n} AS MATERIALIZED (
  SELECT q.r, q.p, min(CAST(list_dot_product(q.x, q.x) - 2 * list_dot_product(q.x, b.x) + list_dot_product(b.x, b.x) AS HUGEINT) * {entries} + b.e) AS k
  FROM parts q JOIN b{n} b USING (p) GROUP BY q.r, q.p
)""")
        if n < rounds:
            steps.append(f"""m{n} AS (
  SELECT p, e, list(c ORDER BY i) AS x FROM (
    SELECT p, k % {entries} AS e, i, floor(sum(c) / count(*)) AS c FROM (SELECT q.p, k, unnest(x) AS c, unnest(generate_series(1, len(x))) AS i FROM parts q JOIN a{n} USING (r, p)) GROUP BY ALL
  ) GROUP BY p, e
), b{n + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)""")
    steps.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda c: CAST(c AS BIGINT)), ','), ',' ORDER BY p, e)) AS h FROM b{rounds}),
coded AS (
  SELECT r, string_agg(printf('%02x', CAST(k % {entries} AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(k // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r
)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), digest"""
