"""Shared plumbing of the training-data operators: written tables, Arrow batches, bytes of texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.sources.shared import discard, free_name, materialise, new_path, owning, shared_dir  # noqa: F401

#: Bytes in one Arrow batch sent to Python, or one row where that is larger.
BATCH_BYTES = 1 << 20
#: Bytes of text that a Python worker handles at once, as one numpy array or one list of tokens.
SLAB_BYTES = 1 << 20
#: ASCII blanks that separate words.
BLANKS = b" \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the memory of Python workers by bytes. Every operator sets the same bound, so the order of calls, and that plans
    run later, change nothing."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def byte_texts(batch: pa.RecordBatch | pa.Array, column: str = "") -> list[bytes]:
    """The UTF-8 bytes of a string array, or of a column; null counts as empty."""
    array = batch.column(batch.schema.get_field_index(column)) if column else batch
    return [x or b"" for x in array.cast(pa.binary()).to_pylist()]


def slabs(sizes: Iterable[int], limit: int = SLAB_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges of at most ``limit`` bytes, or one item where that is larger."""
    first, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n
    if i >= first:
        yield first, i + 1


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, so that every engine agrees."""
    return F.translate(text, UPPER, LOWER)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that no classifier learns from; a null id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def with_row_key(df: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """``df`` with two columns of type long that tell its rows apart, repeated ones too, and their names: which file a row
    comes from, and its place there. Nothing is moved where ``df`` is files as they were read; any other frame is written
    first, since its rows need not be rows of a file."""
    if df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = materialise(df, "rows")
    found = df.metadataColumn("_metadata")
    names = (free_name(df, "_file"), free_name(df, "_place"))
    keys = (F.xxhash64(found["file_path"]), found["row_index"].cast("long"))
    return owning(df.select("*", *[k.alias(n) for k, n in zip(keys, names)]), df), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
