"""The shared tables as the model's tables, in Spark and in SQL.

Lines of a text stand for blocks, five lines for a page. What the texts never hold (headings, captions, enumeration
marks, urls) is put in by rules on document and line numbers, so that every operator has something to do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = ("* ", "Table ", "see http://a.b/c ", "me@a.org ", "cli- mate ", "Use coal, e.g. ", "", "")


#: Bytes of a stored table in one piece. A small file may be one row group, and so one task; a large one has tasks of 128 MB, and a
#: task that cuts texts into words or pairs of words makes many times what it reads.
PIECE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *by: str) -> DataFrame:
    """Rows over all cores, in pieces of a bounded size, however large the table is; dealt by keys if any are given, so that a join
    on them takes the pieces as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    known = int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return rows.repartition(max(cores, -(-known // PIECE_BYTES)), *by)


def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id", F.concat_ws("_", "source", F.col("doc_id").cast("string")).alias("name"), F.md5(F.col("text").cast("binary")).alias("md5_sum"), F.concat(F.lit("https://example.org/"), F.col("doc_id").cast("string")).alias("source_url"),
        F.concat_ws(";", "source", "lang").alias("author"), F.concat_ws(";", F.lit("submission"), "lang").alias("types"), F.col("lang").alias("language"),
    )


OVERVIEW = """overview AS (
  SELECT doc_id, concat_ws('_', source, CAST(doc_id AS VARCHAR)) AS name, md5(text) AS md5_sum, 'https://example.org/' || doc_id AS source_url,
         concat_ws(';', source, lang) AS author, concat_ws(';', 'submission', lang) AS types, lang AS language FROM documents
)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``md5, doc_id, lang, page_no, block_no, text``."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")).select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    return d.select(F.col("doc_id").cast("string").alias("md5"), "doc_id", "lang", F.floor(F.col("block_no") / 5).cast("int").alias("page_no"), "block_no", "text")


BLOCKS = """blocks AS (
  SELECT CAST(doc_id AS VARCHAR) AS md5, doc_id, lang, CAST(block_no // 5 AS INTEGER) AS page_no, CAST(block_no AS INTEGER) AS block_no, text FROM (
    SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS text, unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS block_no FROM documents)
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, lang, block_no, candidate``."""
    b = blocks(spark, sf_dir)
    prefix = F.element_at(F.array(*map(F.lit, PREFIXES)), ((F.col("doc_id") + F.col("block_no")) % len(PREFIXES) + 1).cast("int"))
    return b.select("doc_id", "lang", "block_no", F.concat(prefix, F.col("text")).alias("candidate"))


CANDIDATES = f"""{BLOCKS}, candidates AS (
  SELECT doc_id, lang, block_no, ([{", ".join(f"'{p}'" for p in PREFIXES)}])[(doc_id + block_no) % {len(PREFIXES)} + 1] || text AS candidate FROM blocks
)"""


def _heading(doc: Column, block: Column, text: Column) -> Column:
    return F.when((doc * 7 + block) % 37 == 0, F.lit("Contents")).when((doc * 5 + block) % 41 == 0, F.lit("References")).otherwise(text)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``md5, page_no, paragraphs``."""
    b = blocks(spark, sf_dir)
    headed = b.select("md5", "page_no", "block_no", _heading(F.col("doc_id"), F.col("block_no"), F.col("text")).alias("text"))
    return headed.groupBy("md5", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("block_no", "text"))), lambda x: x["text"]).alias("paragraphs"))


PAGES = f"""{BLOCKS}, pages_ AS (
  SELECT md5, page_no, list(CASE WHEN (doc_id * 7 + block_no) % 37 = 0 THEN 'Contents' WHEN (doc_id * 5 + block_no) % 41 = 0 THEN 'References' ELSE text END ORDER BY block_no) AS paragraphs
  FROM blocks GROUP BY md5, page_no
)"""


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``md5, page_no, word_no, block_num, par_num, line_num, conf, text``; every seventh word is a blank one."""
    w = blocks(spark, sf_dir).select("md5", "doc_id", "page_no", "block_no", F.posexplode(F.regexp_extract_all("text", F.lit("[^ ]+"), F.lit(0))).alias("i", "word"))
    return w.select(
        "md5", "page_no", (F.col("block_no").cast("long") * 1000000 + F.col("i")).alias("word_no"), F.floor(F.col("block_no") / 2).cast("int").alias("block_num"), F.col("block_no").alias("par_num"),
        F.floor(F.col("i") / 10).cast("int").alias("line_num"), (F.pmod(F.col("doc_id") * 31 + F.col("i"), F.lit(101)) - 1).cast("double").alias("conf"), F.when(F.col("i") % 7 == 6, F.lit("  ")).otherwise(F.col("word")).alias("text"),
    )


OCR_WORDS = f"""{BLOCKS}, ocr_words AS (
  SELECT md5, page_no, CAST(block_no AS BIGINT) * 1000000 + i AS word_no, CAST(block_no // 2 AS INTEGER) AS block_num, block_no AS par_num, CAST(i // 10 AS INTEGER) AS line_num,
         CAST((doc_id * 31 + i) % 101 - 1 AS DOUBLE) AS conf, CASE WHEN i % 7 = 6 THEN '  ' ELSE word END AS text FROM (
    SELECT *, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS i FROM (SELECT md5, doc_id, page_no, block_no, regexp_extract_all(text, '[^ ]+') AS w FROM blocks) WHERE len(w) > 0)
)"""


def topic_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, topic_nr, paragraph`` of the documents that have a vector; every seventh is an outlier."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.when(F.col("vec_id") % 7 == 0, F.lit(-1)).otherwise(F.col("label")).alias("topic_nr"))
    return e.join(spread(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("paragraph")), "doc_id"), "doc_id")


TOPIC_DOCS = """topic_docs AS (
  SELECT e.vec_id AS doc_id, CASE WHEN e.vec_id % 7 = 0 THEN -1 ELSE e.label END AS topic_nr, d.text AS paragraph FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id
)"""


def paragraph_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_md5, paragraph_id, paragraph, language``: the lines of each document."""
    b = blocks(spark, sf_dir)
    return b.select(F.col("md5").alias("document_md5"), F.col("block_no").alias("paragraph_id"), F.col("text").alias("paragraph"), F.col("lang").alias("language"))


def paragraph_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``document_md5, paragraph_id, embedding``: one vector in turn for the first two lines of each document."""
    e = table(spark, sf_dir, "embeddings")
    ids = e.select(F.col("vec_id"), "embedding").withColumn("paragraph_id", (F.col("vec_id") % 2).cast("int"))
    return ids.select(F.floor(F.col("vec_id") / 2).cast("long").cast("string").alias("document_md5"), "paragraph_id", "embedding")
