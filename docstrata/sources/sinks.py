"""Sinks: catalogue files, stored tables, report files, the model bundle."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.operators import catalogue
from docstrata.sources import readers
from docstrata.sources.shared import delete, discard, folders, free_name, materialise, owning


def write_overview(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A catalogue as one CSV file without row numbers, lists joined. It is written aside first, since the rows may come from
    the very files that it takes the place of."""
    rows = materialise(catalogue.to_overview(documents), "overview")
    rows.coalesce(1).write.mode(mode).option("header", True).option("escape", '"').csv(path)
    discard(rows)


def write_documents(documents: DataFrame, path: str, mode: str = "append") -> None:
    """Documents with paragraphs; those without are left out. Files follow the size of the data, not the number of keys."""
    catalogue.with_paragraphs(documents).write.mode(mode).parquet(path)


def write_table(rows: DataFrame, path: str, mode: str = "append") -> None:
    rows.write.mode(mode).parquet(path)


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` in an order, with their number from 0 as first column without name. Ranges are written once, each row with its
    range and its place there, and shifted by the sizes of the ranges before; one count per range reaches the driver."""
    part, place = free_name(rows, "_part"), free_name(rows, "_place")
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = materialise(ranged.withColumns({part: F.spark_partition_id(), place: within}), "ranged")
    shift, offsets = 0, []
    for p, n in stored.groupBy(part).count().orderBy(part).collect():
        offsets += [F.lit(p), F.lit(shift)]
        shift += n
    number = (F.create_map(*offsets)[F.col(part)] + F.col(place)) if offsets else F.lit(0)
    return owning(stored.select(number.cast("long").alias(""), *rows.columns), stored)


def write_report(rows: DataFrame, path: str, *order: str | Column, mode: str = "overwrite") -> None:
    """A report as CSV files with row numbers."""
    found = numbered(rows, *order)
    found.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    discard(found)


BUNDLE = ("assignments", "topic_words", "labels", "representatives", "distribution", "coordinates", "sizes")


def model_path(folder: str, num_topics: int = Settings.num_topics) -> str:
    return f"{folder.rstrip('/')}/t{num_topics}_model"


def _manifests(spark: SparkSession, base: str) -> list[tuple[str, list[str]]]:
    """Snapshots that were written whole, and their tables, the newest first."""
    try:
        found = readers.existing(lambda: spark.read.schema("version string, tables array<string>").json(f"{base}/manifests/*"), base)
    except FileNotFoundError:
        return []
    return [(r["version"], r["tables"]) for r in found.orderBy(F.desc("version")).collect()]


def save_model(tables: dict[str, DataFrame], folder: str, num_topics: int, keep: int = 2) -> str:
    """Write the tables of a model as a snapshot of its own, whose name is returned. Its manifest comes last, so a run that
    breaks off leaves the older snapshots as they were, and readers see one or the other whole. The last ``keep`` snapshots
    stay, since they may be read still; older ones go, and so does what broken runs have left before them. One run saves at a
    time."""
    spark, base = next(iter(tables.values())).sparkSession, model_path(folder, num_topics)
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    names = [n for n in BUNDLE if n in tables]
    for name in names:
        tables[name].write.parquet(f"{base}/snapshots/{version}/{name}")
    spark.createDataFrame([(version, names)], "version string, tables array<string>").coalesce(1).write.json(f"{base}/manifests/{version}")
    kept = {v for v, _ in _manifests(spark, base)[:keep]}
    for old in folders(spark, f"{base}/manifests") + folders(spark, f"{base}/snapshots"):
        name = old.rstrip("/").rsplit("/", 1)[-1]
        if name not in kept and name < version:
            delete(spark, old)
    return version


def load_model(spark: SparkSession, folder: str, num_topics: int) -> dict[str, DataFrame]:
    """The tables of the last snapshot that was saved whole; FileNotFoundError where there is none for this number of topics."""
    base = model_path(folder, num_topics)
    found = _manifests(spark, base)
    if not found:
        raise FileNotFoundError(f"{base} not found")
    version, names = found[0]
    return {name: readers.stored(spark, f"{base}/snapshots/{version}/{name}") for name in names}
