"""Exact deduplication by recipes of content-defined chunks.

A text, without its blanks and in UTF-8, is cut where a rolling hash of the last 32 bytes is small, so equal passages
give equal chunks wherever they stand. A chunk is known by a digest and its length. A text's recipe is the ordered list
of its chunks; texts are equal when their recipes are, once the chunks of recipes that occur more than once have been
verified: each is compared by its bytes, one copy per task, and chunks of equal digests but other bytes would be told
apart by a number. Long texts are read where they lie; recipes move, and of the texts only chunks that have copies.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import BLANKS, byte_texts, discard, materialise, owning, slabs, bounded_batches

#: Chunk sizes in bytes: least, mean beyond the least (a power of 2), most.
MIN_CHUNK, MEAN_CHUNK, MAX_CHUNK = 512, 2048, 16384
#: Bytes of a chunk's digest, beside four for its length; and bytes of chunks that a task remembers having passed on.
DIGEST_BYTES, SEEN_BYTES = 16, 8 << 20
#: Bits of the filter that tells tasks which chunks to pass on: 4 MB, whatever the number of chunks.
FILTER_BITS = 1 << 25
#: One random 32-bit number per byte value, from a fixed seed.
GEAR = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 32, 256, dtype=np.uint32)


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte, the sum over the last 32 bytes of their number shifted by their age, modulo 2**32."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def cut_points(candidates: np.ndarray, n: int) -> list[int]:
    """Ends of the chunks of a text of ``n`` bytes; candidates: sorted ends that the rolling hash proposes."""
    ends, at, i = [], 0, 0
    while n - at > MIN_CHUNK:
        i += int(np.searchsorted(candidates[i:], at + MIN_CHUNK))
        end = min(int(candidates[i]) if i < len(candidates) else n, at + MAX_CHUNK, n)
        ends.append(end)
        at = end
    if at < n:
        ends.append(n)
    return ends


def chunk_id(chunk: bytes | memoryview, digest_bytes: int = DIGEST_BYTES) -> bytes:
    """The beginning of a SHA-256, and the length."""
    return hashlib.sha256(chunk).digest()[:digest_bytes] + len(chunk).to_bytes(4, "big")


def chunks_of(texts: list[bytes]) -> Iterator[list[memoryview]]:
    """The chunks of each text, in UTF-8 and without blanks. The rolling hash runs over many texts at a time; it looks back
    32 bytes, less than the least chunk, so the text before never matters."""
    for a, b in slabs(map(len, texts)):
        joined = b"".join(texts[a:b])
        found = np.flatnonzero(rolling_hash(np.frombuffer(joined, np.uint8)) < np.uint32((1 << 32) // MEAN_CHUNK)) + 1 if joined else np.empty(0, np.int64)
        view, start = memoryview(joined), 0
        for text in texts[a:b]:
            end = start + len(text)
            own = found[np.searchsorted(found, start) : np.searchsorted(found, end, "right")] - start
            at, chunks = start, []
            for cut in cut_points(own, len(text)):
                chunks.append(view[at : start + cut])
                at = start + cut
            yield chunks
            start = end


def recipe_of(chunks: list[memoryview], known: dict[bytes, list[bytes]], digest_bytes: int = DIGEST_BYTES) -> bytes:
    """The identifiers of chunks, end to end: digest, length and a number, which is not 0 only for a chunk that shares
    both with others: its place among them in ``known``."""
    ids = []
    for chunk in chunks:
        name = chunk_id(chunk, digest_bytes)
        ids.append(name + (known[name].index(bytes(chunk)) if name in known else 0).to_bytes(2, "big"))
    return b"".join(ids)


def _normal(batch: pa.RecordBatch) -> list[bytes]:
    return [x.translate(None, BLANKS) for x in byte_texts(batch, "text")]


def chunk_recipes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: tuple[str, ...] = (), known: dict[bytes, list[bytes]] | None = None, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``doc_id, n_points, recipe, text_sha256`` of each row, and the columns ``row`` of type long, by place: ``row_0``..."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _normal(batch)
            found = [recipe_of(chunks, known or {}, digest_bytes) for chunks in chunks_of(texts)]
            shas = [hashlib.sha256(x).hexdigest() for x in texts]
            names = [c for c in batch.schema.names if c != "text"]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.binary()), pa.array(shas, pa.string())], names=[*names, "recipe", "text_sha256"])

    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.length(text_col), F.lit(0)).cast("long").alias("n_points"),
        *[F.col(c).cast("long").alias(f"row_{i}") for i, c in enumerate(row)],
        F.col(text_col).cast("string").alias("text"),
    )
    more = "".join(f"row_{i} long, " for i in range(len(row)))
    return rows.mapInArrow(run, f"doc_id long, n_points long, {more}recipe binary, text_sha256 string")


def recipe_chunks(recipes: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``chunk`` (digest and length), once for every time that one stands in a recipe."""
    size = digest_bytes + 6
    names = F.transform(
        F.sequence(F.lit(0), (F.length("recipe") / size).cast("int") - 1),
        lambda i: F.substring(F.col("recipe"), i * size + 1, F.lit(size - 2)),
    )
    return recipes.where(F.length("recipe") > 0).select(F.explode(names).alias("chunk"))


def chunk_dictionary(recipes: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """The distinct chunks of a table of recipes: ``chunk, n_bytes, copies``."""
    n_bytes = F.conv(F.hex(F.substring("chunk", digest_bytes + 1, 4)), 16, 10).cast("long")
    counted = recipe_chunks(recipes, digest_bytes).groupBy("chunk").agg(F.count("*").alias("copies"))
    return counted.select("chunk", n_bytes.alias("n_bytes"), "copies")


def chunk_filter(chunks: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of ``bits`` bits that lets every one of the chunks through: made on the executors, and fetched as one row
    for each 64 bits that hold any."""
    place = F.pmod(F.crc32("chunk"), F.lit(bits))
    words = chunks.groupBy(F.floor(place / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("m"))
    out = np.zeros(bits // 64, np.int64)
    got = words.toArrow()
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return out.view(np.uint64)


def chunk_bytes(df: DataFrame, text_col: str, wanted: np.ndarray, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``chunk, data`` of the chunks that a filter lets through; a task passes a chunk on once while it remembers it."""
    bounded_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(wanted)
    bits = len(wanted) * 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, bytes] = {}
        size = 0
        for batch in batches:
            names, data = [], []
            for chunks in chunks_of(_normal(batch)):
                for chunk in chunks:
                    name = chunk_id(chunk, digest_bytes)
                    at = zlib.crc32(name) % bits
                    if not int(shared.value[at >> 6]) >> (at & 63) & 1 or seen.get(name) == chunk:
                        continue
                    if size > SEEN_BYTES:
                        seen, size = {}, 0
                    seen[name] = bytes(chunk)
                    size += len(chunk)
                    names.append(name)
                    data.append(seen[name])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["chunk", "data"])

    return df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "chunk binary, data binary")


def colliding(df: DataFrame, text_col: str, recipes: DataFrame, digest_bytes: int = DIGEST_BYTES) -> dict[bytes, list[bytes]]:
    """The chunks that share digest and length with other bytes, of recipes that occur more than once: with a digest of
    128 bits none are expected, so what is fetched is empty. Every chunk of those recipes is compared by its bytes."""
    copied = recipes.groupBy("recipe").count().where("count > 1")
    wanted = materialise(recipe_chunks(copied, digest_bytes).distinct(), "chunks")
    data = chunk_bytes(df, text_col, chunk_filter(wanted), digest_bytes).join(wanted, "chunk", "left_semi").distinct()
    several = [r[0] for r in data.groupBy("chunk").count().where("count > 1").select("chunk").collect()]
    found: dict[bytes, list[bytes]] = {}
    if several:
        for chunk, content in data.where(F.col("chunk").isin(several)).orderBy("chunk", "data").collect():
            found.setdefault(bytes(chunk), []).append(bytes(content))
    discard(wanted)
    return found


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: tuple[str, ...] = (), digest_bytes: int = DIGEST_BYTES
) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after deleting ASCII blanks; null counts as empty, and empty texts form one group.
    Of equal texts the one with the most code points stays, then the one with the smallest id; a null id comes last.
    Rows that repeat an id and its text are one document to this operator: they count in ``group_size`` and share
    ``kept``, unless ``row`` names columns of type long that tell every row apart: then one row of each group is kept,
    of equals the first by ``row``, and ``row_0``... come back beside the rest. Other columns of ``df``, whatever their
    names, play no part. An empty table gives an empty result.

    The groups are pre-aggregated before their shuffle, so a group of copies of any size is one row per task. Only
    groups of two or more are joined back, from a written table, so that the adaptive planner can split hot keys.
    """
    recipes = materialise(chunk_recipes(df, id_col, text_col, row, None, digest_bytes), "recipes")
    known = colliding(df, text_col, recipes, digest_bytes)
    if known:
        discard(recipes)
        recipes = materialise(chunk_recipes(df, id_col, text_col, row, known, digest_bytes), "recipes")
    places = [f"row_{i}" for i in range(len(row))]
    best = F.max(F.struct("n_points", *[F.bitwise_not(c).alias(c) for c in ("doc_id", *places)])).alias("best")
    groups = recipes.groupBy("recipe").agg(best, F.count("*").alias("n")).where("n > 1")
    keep = [F.bitwise_not(f"best.{c}").alias(f"keep_{c}") for c in ("doc_id", *places)]
    groups = materialise(groups.select("recipe", *keep, "n"), "groups")
    joined = recipes.join(groups, "recipe", "left")
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_doc_id"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"keep_{c}")) for c in places or ["doc_id"]])
    found = joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | same).alias("kept"),
        "text_sha256",
        *places,
    )
    return owning(found, recipes, groups)
