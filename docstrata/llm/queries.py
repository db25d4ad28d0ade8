"""Queries over the shared tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import materialise, owning, table
from docstrata.llm.conversations import damaged, repair, repair_sql
from docstrata.llm.decontam import contamination
from docstrata.llm.exact_dedup import exact_dedup
from docstrata.llm.licenses import license_scan, license_scan_sql
from docstrata.llm.mixing import mix
from docstrata.llm.packing import pack
from docstrata.llm.quality import quality
from docstrata.llm.secret_scan import scan_secrets
from docstrata.llm.simhash import near_duplicates
from docstrata.llm.toxicity import toxicity
from docstrata.llm.url_filters import filter_urls, filter_urls_sql
from docstrata.llm.vector_codes import encode, hex_code, learn_codebooks, summed_by, vector_codes_sql
from docstrata.llm.warc import archive_round_trip, archive_sql


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from its labels; columns and cases as for ``toxicity``."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from its labels; columns and cases as for ``quality``."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page; columns and cases as for ``filter_urls``."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies among all documents; columns and cases as for ``exact_dedup``."""
    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, normalised and read back; columns and cases as for ``archive_round_trip``."""
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all documents; columns and cases as for ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document; columns and cases as for ``scan_secrets``."""
    return scan_secrets(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document, items and their digest from ``contamination``; cases as there, but items
    without id are not counted, since they cannot be listed."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    named = F.array_compact("items")  # items without id hit words, but cannot be listed
    return found.select(
        "doc_id", "n_words", "n_hit", F.size(named).cast("long").alias("n_items"),
        F.sha2(F.array_join(named, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; columns and cases as for ``mix``."""
    return mix(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in every document; columns and cases as for ``license_scan``."""
    return license_scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of every well-formed vector, with its error and that of its label; cases as for ``learn_codebooks`` and
    ``encode``; rows of other lengths than most have none."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = learn_codebooks(rows)
    found = materialise(encode(rows, books, "vec_id", "label"), "codes")
    told = summed_by(found, "label", "error", "label_error")
    return owning(told.select("vec_id", hex_code().alias("code"), "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")), found)


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens; columns and cases as for ``pack``."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged as ``damaged`` says, and its cheapest repair; columns and cases as for ``repair``."""
    return repair(damaged(table(spark, sf_dir, "conversations")), gone="gone")


EXACT_DEDUP_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(length(text), 0) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)"""

DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), w AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
  FROM (SELECT *, unnest(generate_series(1, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)
), g AS (
  SELECT doc_id, i, n, array_to_string(words[i:i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)
), hits AS (
  SELECT doc_id, i, g.n, item FROM g JOIN w ON g.gram = w.gram AND g.n = w.n
), n_hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM hits) GROUP BY doc_id
), n_items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (doc_id) LEFT JOIN n_items USING (doc_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_toxicity, op2_quality, op3_url_filter, op4_exact_dedup, op5_warc, op6_simhash, op7_secret_scan, op8_decontamination, op9_mixing, op10_license_scan,
        op11_vector_codes, op12_packing, op13_conversation_repair,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": filter_urls_sql(),
        "op4_exact_dedup": EXACT_DEDUP_SQL,
        "op5_warc": archive_sql(),
        "op8_decontamination": DECONTAMINATION_SQL,
        "op10_license_scan": license_scan_sql(),
        "op11_vector_codes": vector_codes_sql(),
        "op13_conversation_repair": repair_sql(),
    }
