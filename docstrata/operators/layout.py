"""Operators on recognised words: lines and paragraphs of a page, in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.functions import text as T

PAGE = ("md5", "page_no")
LINE = (*PAGE, "block_num", "par_num", "line_num")


def fit_words(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Words that are not blank and sure enough."""
    return words.where(~T.is_blank(F.col("text")) & (F.col("conf") >= s.ocr_min_confidence))


def lines(words: DataFrame) -> DataFrame:
    """One row per line: its words in order, joined by blanks, and where it first stood. Words are collected per line."""
    gathered = words.groupBy(*LINE).agg(F.sort_array(F.collect_list(F.struct("word_no", "text"))).alias("w"), F.min("word_no").alias("first_word"))
    return gathered.select(*LINE, F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("line"), F.size("w").alias("n_words"), "first_word")


def numbered_lines(found: DataFrame) -> DataFrame:
    """Adds ``par_idx`` and ``line_idx``, dense from 1 in first-seen order within the page."""
    paragraph = Window.partitionBy(*PAGE, "block_num", "par_num")
    first = found.withColumn("_par_first", F.min("first_word").over(paragraph))
    return (
        first.withColumn("par_idx", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("_par_first")))
        .withColumn("line_idx", F.row_number().over(paragraph.orderBy("first_word")))
        .drop("_par_first")
    )


def paragraphs(numbered: DataFrame) -> DataFrame:
    """One row per paragraph of a page: its lines joined by blanks, their number, and ``row_index``, the row at which it
    starts if lines are rows and one row parts paragraphs."""
    whole = numbered.groupBy(*PAGE, "par_idx").agg(F.sort_array(F.collect_list(F.struct("line_idx", "line"))).alias("l"))
    before = Window.partitionBy(*PAGE).orderBy("par_idx").rowsBetween(Window.unboundedPreceding, -1)
    return whole.select(*PAGE, "par_idx", F.array_join(F.transform("l", lambda x: x["line"]), " ").alias("paragraph"), F.size("l").alias("n_lines")).withColumn(
        "row_index", F.coalesce(F.sum(F.col("n_lines") + 1).over(before), F.lit(0)).cast("long")
    )


def page_paragraphs(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """From words to ``md5, page_no, par_idx, paragraph, n_lines, row_index``. Lines move to their page once; numbers, paragraphs and
    rows are found where they are then."""
    return paragraphs(numbered_lines(lines(fit_words(words, s)).repartition(*PAGE)))
