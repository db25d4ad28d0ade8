"""Settings, and literal tables as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Phrases of the guided topics.
SEED_TOPICS = {
    "Key 1": ["Paris Agreement", "climate action", " goal"],
    "Key 2": ["sustainable development", "SDG", "eradicate poverty", "mainstream"],
    "Key 3": ["systems transformations", " disruptive", "inclusion", "equity"],
    "Key 4": ["global emissions", "mitigation pathways", "global temperature goal", "commitment"],
    "Key 5": ["domestic mitigation", "national targets", "NDC", "GHG emissions"],
    "Key 6": ["net zero", "phasing out fossil fuels", "supply-side measures", "demand-side measures"],
    "Key 7": ["just transition", "equitable", "participatory", "human rights", "youth"],
    "Key 8": ["economic diversification", "different contexts", "green industrialization", "synergies"],
    "Key 9": ["adaptation", "reduce impacts", "threat of climate change"],
    "Key 10": ["adaptation plan", "adaptation action", "adaptation commitment"],
    "Key 11": ["local context", "local population", "transformational adaptation"],
    "Key 12": ["averting loss and damage", "addressing loss and damage", "limits to adaptation"],
    "Key 13": ["support for adaptation", "adaptation funding", "climate resilient development"],
    "Key 14": ["support for developing countries", "international public finance", "multilateral development banks"],
    "Key 15": ["financial flows", "investment", "public", "private", "international", "domestic"],
    "Key 16": ["cleaner technologies", "innovation", "development of new technologies", "technology transfer"],
    "Key 17": ["capacity-building", "country-led cooperation", "needs-based cooperation", "capacities are enhanced and retained"],
}

# Recogniser language codes, report language codes, sentence splitter languages.
TESSERACT_TO_UN = {"eng": "en", "spa": "es", "fra": "fr", "rus": "ru", "ara": "ar"}
UN_TO_TESSERACT = {"en": "eng", "es": "spa", "fr": "fra", "ru": "rus", "ar": "ara"}
UN_TO_SPLITTER = {"en": "english", "es": "spanish", "fr": "french", "ru": "russian", "ar": "arabic"}

# Headings that open the body of a report, and headings that end it. The Russian one for references is
# capitalised and compared with lower-cased text, so it never matches unless asked for.
CONTENTS_HEADINGS = ("table of contents", "contents", "tabla de contenido", "contenidos", "table des matières", "contenu", "оглавление")
REFERENCES_HEADINGS = ("references", "referencias", "références")
REFERENCES_HEADING_RU = "Рекомендации"

# Leading enumeration marks, openings of captions, words of document names to leave out.
ENUMERATION_MARKS = ("* ", "© ", "@ ", "+ ", "» ", "= ", '"*')
CAPTIONS_5, CAPTION_6 = ("table", "annex"), "figure"
NAME_BLACKLIST = ("archived", "cover letter", "table", "experts")

# Columns of the second catalogue format.
TEXTDF_COLUMNS = ("author", "author_is_party", "date", "document_id", "document_md5_sum", "document_name", "document_family_id", "document_source_url", "document_variant", "language", "types", "version")
OVERVIEW_COLUMNS = ("doc_id", "name", "md5_sum", "source_url", "family_id", "variant", "author", "author_is_party", "date", "language", "types", "version")

# Fixed value: the sentence model that embeddings come from where its library is installed.
EMBEDDING_MODEL = "sentence-transformers/distiluse-base-multilingual-cased-v1"


@dataclass(frozen=True)
class Settings:
    """Thresholds of the pipeline."""

    sentence_min_words: int = 8
    sentence_min_characters: int = 32
    sentence_max_words: int = 256
    min_sentences: int = 2
    split_words: int = 100
    max_digit_ratio: float = 0.1
    max_capital_ratio: float = 0.2
    ocr_min_confidence: float = 0.0
    language_pages: int = 50
    language_blocks: int = 128
    block_min_characters: int = 64
    block_min_words: int = 3
    default_language: str = "en"
    min_similarity: float = 0.08
    window: int = 5
    stride: int = 2
    neighbours: int = 16
    components: int = 15
    min_cluster_size: int = 30
    min_samples: int = 10
    num_topics: int = 72
    top_words: int = 10
    top_docs: int = 3
    label_words: int = 4
    max_image_width: int = 1024
    render_dpi: int = 300
    sample_size: int = 32
    seed: int = 42
    worker_documents: int = 32
    embedding_model: str = EMBEDDING_MODEL


def seed_topics(spark: SparkSession) -> DataFrame:
    """``key, seed_idx, phrase``; phrases keep their leading blanks."""
    rows = [(k, i, p) for k, phrases in SEED_TOPICS.items() for i, p in enumerate(phrases)]
    return spark.createDataFrame(rows, "key string, seed_idx int, phrase string")


def language_map(spark: SparkSession) -> DataFrame:
    """``tesseract, un, splitter``."""
    rows = [(t, u, UN_TO_SPLITTER[u]) for t, u in TESSERACT_TO_UN.items()]
    return spark.createDataFrame(rows, "tesseract string, un string, splitter string")
