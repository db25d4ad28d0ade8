"""From candidate paragraphs to the paragraphs that are kept, within each row: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.functions import text as T
from docstrata.operators.boundaries import Boundaries


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds or replaces a column that is worked out once per row. A plain column would be substituted into every later
    filter and be worked out again in each; nothing is pushed through a generator's output."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def cleaned(candidates: DataFrame) -> DataFrame:
    """Candidates (column ``candidate``) cleaned, captions left out. Enumeration marks are looked for in a column, else each look
    would clean anew."""
    found = once(candidates, "candidate", T.drop_links(F.col("candidate")))
    return once(found, "candidate", T.drop_enumeration(F.col("candidate"))).where(~T.is_caption(F.col("candidate")))


def sentences(text: Column, language: str | None = None, learned: Boundaries | None = None) -> Column:
    """Sentences by rule, or by rule and learned boundaries, for which the language's column must be known."""
    spoken = F.col(language) if language else None
    return learned.sentences(text, spoken) if learned and language else T.sentences(text, spoken)


def split(candidates: DataFrame, language: str | None = None, learned: Boundaries | None = None) -> DataFrame:
    """Adds ``sentences``; a candidate of one sentence is left out."""
    return once(candidates, "sentences", sentences(F.col("candidate"), language, learned)).where(F.size("sentences") != 1)


def filtered(found: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Unfit sentences dropped; candidates with too few left are left out."""
    return once(found, "sentences", T.fit_sentences(F.col("sentences"), s)).where(F.size("sentences") >= s.min_sentences)


def kept_paragraphs(candidates: DataFrame, language: str | None = None, s: Settings = Settings(), learned: Boundaries | None = None) -> DataFrame:
    """The candidates that stay, with ``paragraph``, before packing."""
    return once(filtered(split(cleaned(candidates), language, learned), s), "paragraph", F.array_join("sentences", " "))


def packed_paragraphs(
    kept: DataFrame, language: str | None = None, s: Settings = Settings(), drop_empty: bool = False, learned: Boundaries | None = None
) -> DataFrame:
    """One row per final paragraph, with ``chunk_no``: long paragraphs are split anew into sentences and packed."""
    again = sentences(F.col("paragraph"), language, learned)
    chunks = F.when(F.col("_again").isNotNull(), T.pack(F.col("_again"), s, drop_empty)).otherwise(F.array("paragraph"))
    rest = [c for c in kept.columns if c not in ("candidate", "sentences", "paragraph")]
    return once(kept, "_again", F.when(T.n_words(F.col("paragraph")) > s.split_words, again)).select(*rest, F.posexplode(chunks).alias("chunk_no", "paragraph"))


def process(
    candidates: DataFrame, language: str | None = None, s: Settings = Settings(), drop_empty: bool = False, learned: Boundaries | None = None
) -> DataFrame:
    """From ``candidate`` (and other columns, kept) to final paragraphs."""
    return packed_paragraphs(kept_paragraphs(candidates, language, s, learned), language, s, drop_empty, learned)
