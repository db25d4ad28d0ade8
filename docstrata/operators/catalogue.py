"""Operators on the catalogue of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata import config
from docstrata.functions import text as T


def from_overview(rows: DataFrame) -> DataFrame:
    """Catalogue rows with their multi-valued cells split."""
    return rows.withColumns({c: T.split_list(F.col(c)) for c in ("author", "types")})


def from_textdf(rows: DataFrame) -> DataFrame:
    """The twelve columns of the second format, list literals parsed; ``md5_sum`` follows ``document_md5_sum``, and ``doc_id``
    is the row's label, where the frame has a column of that name (else ``document_id``)."""
    label = F.col("doc_id") if "doc_id" in rows.columns else F.col("document_id")
    lists = {c: T.parse_list_literal(F.col(c)) for c in ("author", "types")}
    found = rows.select(label.alias("doc_id"), *config.TEXTDF_COLUMNS)
    return found.withColumns(lists).withColumn("md5_sum", F.col("document_md5_sum"))


def to_overview(documents: DataFrame) -> DataFrame:
    """Flat rows: lists joined, path and paragraphs left out where present."""
    return documents.drop("path", "paragraphs").withColumns({c: T.join_list(F.col(c)) for c in ("author", "types")})


def without_names(documents: DataFrame, words: tuple[str, ...] = config.NAME_BLACKLIST) -> DataFrame:
    return documents.where(~T.name_has(F.col("name"), words))


def with_paragraphs(documents: DataFrame) -> DataFrame:
    return documents.where(F.size("paragraphs") > 0)


def load_from_store(overview: DataFrame, store: DataFrame) -> DataFrame:
    """Documents of the catalogue that the store has, with the store's attributes. A key listed twice comes twice."""
    return overview.select("md5_sum").join(store, "md5_sum")


def remaining(wanted: DataFrame, done: DataFrame, key: str = "md5_sum") -> DataFrame:
    """What has no result yet."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def duplicate_keys(documents: DataFrame, key: str = "md5_sum", order: str = "idx") -> DataFrame:
    """Every row whose key occurs more than once. Keys are counted before they move, and only repeated ones are joined."""
    repeated = documents.groupBy(key).count().where("count > 1").select(key)
    return documents.join(repeated, key, "left_semi").select(order, key)


def corpus_stats(paragraphs: DataFrame, *by: str, text: str = "paragraph") -> DataFrame:
    """Paragraphs, words and words per paragraph; no rows give a null mean."""
    counted = paragraphs.select(*by, T.n_words(F.col(text)).cast("long").alias("_n"))
    return counted.groupBy(*by).agg(
        F.count("*").alias("n_paragraphs"), F.coalesce(F.sum("_n"), F.lit(0)).cast("long").alias("n_words"), (F.sum("_n") / F.count("*")).alias("words_per_paragraph")
    )


def progress(wanted: DataFrame, done: DataFrame, key: str = "md5_sum") -> DataFrame:
    """One row: ``n_wanted, n_done``."""
    return wanted.agg(F.count("*").alias("n_wanted")).join(done.agg(F.countDistinct(key).alias("n_done")))


def sample(rows: DataFrame, key: str, n: int = 32) -> DataFrame:
    """``n`` rows in an order that looks random and is always the same."""
    return rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def number_paragraphs(documents: DataFrame, *keep: str) -> DataFrame:
    """One row per paragraph, with its place in the document."""
    return documents.select(*keep, F.posexplode("paragraphs").alias("paragraph_id", "paragraph"))


def attach_embeddings(paragraphs: DataFrame, embeddings: DataFrame, keys: tuple[str, ...] = ("document_md5", "paragraph_id")) -> DataFrame:
    return paragraphs.join(embeddings, list(keys))


def embedding_gaps(paragraphs: DataFrame, embeddings: DataFrame, key: str = "document_md5", place: str = "paragraph_id") -> DataFrame:
    """Documents whose paragraphs and embeddings are not the same places, each once: ``key, n_paragraphs, n_embeddings``."""
    both = paragraphs.select(key, place, F.lit(1).alias("p"), F.lit(0).alias("e")).unionByName(embeddings.select(key, place, F.lit(0).alias("p"), F.lit(1).alias("e")))
    places = both.groupBy(key, place).agg(F.sum("p").alias("p"), F.sum("e").alias("e"))
    found = places.groupBy(key).agg(F.sum("p").alias("n_paragraphs"), F.sum("e").alias("n_embeddings"), F.max((F.col("p") != F.col("e")).cast("int")).alias("gap"))
    return found.where("gap = 1").drop("gap")


def rank_within(rows: DataFrame, by: str, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1; the planner limits each group before it moves."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
