"""Operators on the pages of a document: the body's page range, and the vote on its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.functions import text as T


def page_range(pages: DataFrame, fix_russian: bool = False) -> DataFrame:
    """``md5, toc_page, references_page``: the last page with a contents heading (0 without) and the last with a references
    heading (-1 without). ``pages``: ``md5, page_no, paragraphs``."""
    contents = F.exists("paragraphs", T.is_contents_heading)
    references = F.exists("paragraphs", lambda p: T.is_references_heading(p, fix_russian))
    return pages.groupBy("md5").agg(
        F.coalesce(F.max(F.when(contents, F.col("page_no"))), F.lit(0)).alias("toc_page"), F.coalesce(F.max(F.when(references, F.col("page_no"))), F.lit(-1)).alias("references_page")
    )


def trim_pages(pages: DataFrame, fix_russian: bool = False) -> DataFrame:
    """Pages from the contents up to, not including, the references. References on page 0 count for nothing; references
    before the contents leave no page."""
    found = pages.join(page_range(pages, fix_russian), "md5")
    kept = found.where((F.col("page_no") >= F.col("toc_page")) & ((F.col("references_page") <= 0) | (F.col("page_no") < F.col("references_page"))))
    return kept.select(*pages.columns)


def voting_blocks(blocks: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The longest blocks of the first pages, and of those the ones that may vote. ``blocks``: ``md5, page_no, block_no, text``."""
    longest = Window.partitionBy("md5").orderBy(F.length("text").desc(), "page_no", "block_no")
    first = blocks.where(F.col("page_no") < s.language_pages).withColumn("rank", F.row_number().over(longest))
    return first.where(F.col("rank") <= s.language_blocks).where(T.may_vote(F.col("text"), s))


def vote(votes: DataFrame, documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``md5, language, n_languages``: the commonest language, of equals the first by code; the default without votes.
    ``votes``: ``md5, lang``."""
    counted = votes.groupBy("md5", "lang").count()
    best = counted.groupBy("md5").agg(F.min(F.struct((-F.col("count")).alias("n"), "lang"))["lang"].alias("lang"), F.count("*").alias("n_languages"))
    joined = documents.select("md5").distinct().join(best, "md5", "left")
    return joined.select("md5", F.coalesce("lang", F.lit(s.default_language)).alias("language"), F.coalesce("n_languages", F.lit(0)).cast("long").alias("n_languages"))
