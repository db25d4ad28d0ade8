"""The corpus pipeline: stages that each work on all their predecessor kept.

Stages tell rows apart by where they lie in their files, not by id, so null and repeated ids are rows like any others. Only
the places of rows that go are joined with the documents: where they are few, documents are not moved at all. User columns,
whatever their names, come out as they went in. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import discard, free_name, materialise, owning, table, with_row_key
from docstrata.llm.decontam import with_contamination
from docstrata.llm.exact_dedup import exact_dedup
from docstrata.llm.mixing import mix
from docstrata.llm.simhash import SIMILAR, near_duplicates
from docstrata.llm.toxicity import toxicity_score


def _without(docs: DataFrame, row: tuple[str, str], judged: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judged`` does not keep. The planner broadcasts what goes if its written size is below
    its own threshold, and shuffles otherwise; no key is hot, since every row has its own."""
    gone = materialise(judged.where("not kept").select("row_0", "row_1"), "gone")
    discard(judged)
    same = (docs[row[0]] == gone["row_0"]) & (docs[row[1]] == gone["row_1"])
    return owning(docs.join(gone, same, "left_anti").drop(*row), gone)


def toxic_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a toxicity score below 0.5 stay; null and empty texts have the score of a text without any sign. Equal
    texts are judged alike. No row moves."""
    score, name = toxicity_score(docs, table(spark, sf_dir, "labels")), free_name(docs, "_score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) < 0.5).drop(name)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks one row stays: the longest, then that with the smallest id, a null id last, then
    the first by place. Null and empty texts are equal to each other."""
    keyed, row = with_row_key(docs)
    return _without(keyed, row, exact_dedup(keyed, row=row))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by a similarity of 0.8 of five-word shingles, one row stays: that with the smallest
    id, a null id last, then the first by place. Null, empty and blank texts are near-duplicates of each other."""
    keyed, row = with_row_key(docs)
    return _without(keyed, row, near_duplicates(keyed, row=row, **SIMILAR))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs stay; null and empty texts have no words and stay. No row
    moves."""
    name = free_name(docs, "_found")
    return with_contamination(docs, table(spark, sf_dir, "benchmark"), "text", name).where(F.col(name)["n_hit"] == 0).drop(name)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for every row: ``doc_id, size, source_size, target, taken``. Null and
    empty texts have size 0 and give nothing; documents without source are a source of their own."""
    return mix(docs)


STAGES = [
    ("toxicity", toxic_texts),
    ("exact dedup", exact_copies),
    ("SimHash near-dedup", near_copies),
    ("decontamination", benchmark_passages),
    ("mixing", mixture),
]

#: Hashing, components and the learned toxicity score have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``: rows of ``mixture``. Each stage's result is a written table; it and
    the tables that it was made from are deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        found = stage(spark, docs, sf_dir)
        kept = materialise(found, "stage")
        discard(found, docs)
        docs = kept
    return owning(STAGES[-1][1](spark, docs, sf_dir), docs)
