"""Sources: catalogue files, stored tables, folders, the web, and, where their libraries are installed, PDF and OCR."""

from __future__ import annotations

import io
import time
import urllib.request
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import config
from docstrata.functions import text as T
from docstrata.operators import catalogue, languages, pages
from docstrata.sources.files import opened, replace

OVERVIEW_SCHEMA = ", ".join(f"{c} string" for c in config.OVERVIEW_COLUMNS)
TEXTDF_SCHEMA = ", ".join(f"{c} string" for c in config.TEXTDF_COLUMNS)
TIMEOUT_S, PAUSE_S = 30, 2
AGENT = "Mozilla/5.0 (X11; Linux x86_64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0 Safari/537.36"


def existing(read: Callable[[], DataFrame], path: str) -> DataFrame:
    """What ``read`` gives, or FileNotFoundError where the path does not exist."""
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} not found") from e
        raise


def _csv(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST")
    return existing(lambda: (reader.schema(schema) if schema else reader).csv(path), path)


def overview(spark: SparkSession, path: str, folder: str = "", schema: str | None = None) -> DataFrame:
    """A catalogue: multi-valued cells split, all else strings, with the path of each document's file. Without a schema,
    the file's own columns are taken, all as strings."""
    rows = catalogue.from_overview(_csv(spark, path, schema))
    return rows.withColumn("path", T.document_path(F.col("md5_sum"), folder)) if folder else rows


def textdf(spark: SparkSession, path: str, folder: str = "") -> DataFrame:
    """A catalogue of the second format: twelve columns, lists as bracketed literals."""
    rows = catalogue.from_textdf(_csv(spark, path, None))
    return rows.withColumn("path", T.document_path(F.col("md5_sum"), folder)) if folder else rows


def stored(spark: SparkSession, path: str) -> DataFrame:
    """A stored table: documents, embeddings or pages."""
    return existing(lambda: spark.read.parquet(path), path)


def stored_documents(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Stored documents; their file's path is that of this machine, whatever it was where they were written."""
    return stored(spark, path).withColumn("path", T.document_path(F.col("md5_sum"), folder))


def listing(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``key, path, length`` of the files of a folder, without their content; the key is the name up to its first dot."""
    found = existing(lambda: spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path), path)
    return found.select(T.stem(T.base_name(F.col("path"))).alias("key"), "path", "length")


def fetch(url: str, timeout: float = TIMEOUT_S) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=timeout) as response:
        return response.read()


def _fetched(url: str, get: Callable[[str], bytes]) -> tuple[bytes | None, str | None]:
    """Content and error: one more attempt if the first fails."""
    error = None
    for _ in range(2):
        try:
            return get(url), None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
    return None, error


def downloads(rows: DataFrame, key: str = "md5_sum", url: str = "source_url", get: Callable[[str], bytes] = fetch, pause: float = PAUSE_S, partitions: int = 4) -> DataFrame:
    """``key, ok, content, error``: each url fetched, once more if that fails, with a pause between. Few partitions, so that
    no server is pressed. One document's failure is its own row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, u in zip(batch["key"], batch["url"]):
                content, error = _fetched(u, get)
                out.append((k, error is None, content, error))
                time.sleep(pause)
            yield pd.DataFrame(out, columns=["key", "ok", "content", "error"])

    asked = rows.select(F.col(key).alias("key"), F.col(url).alias("url")).repartition(partitions)
    return asked.mapInPandas(run, "key string, ok boolean, content binary, error string")


def save_downloads(
    rows: DataFrame, folder: str, key: str = "md5_sum", url: str = "source_url", get: Callable[[str], bytes] = fetch, pause: float = PAUSE_S, partitions: int = 4
) -> DataFrame:
    """``downloads`` whose content is saved as ``folder/key.pdf`` (``folder``: a qualified path), a document at a time, so that
    a broken run keeps what it has: ``key, ok, path, length, error``. A file that is there already is written over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, u in zip(batch["key"], batch["url"]):
                path = f"{folder.rstrip('/')}/{k}.pdf"
                content, error = _fetched(u, get) if k and "/" not in k else (None, f"not a key: {k}")
                if error is None:
                    replace(path, content)
                out.append((k, error is None, None if error else path, None if error else len(content), error))
                time.sleep(pause)
            yield pd.DataFrame(out, columns=["key", "ok", "path", "length", "error"])

    asked = rows.select(F.col(key).alias("key"), F.col(url).alias("url")).repartition(partitions)
    return asked.mapInPandas(run, "key string, ok boolean, path string, length long, error string")


def n_downloaded(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum(F.col("ok").cast("int")), F.lit(0)).cast("long").alias("n_ok"), F.count("*").alias("n_asked"))


def _per_file(files: DataFrame, read: Callable[..., Iterator[tuple]], columns: list[str], schema: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows that ``read`` yields for each file's content (and its columns ``more``), or one row with its error. ``files``:
    ``key`` and either ``content`` or ``path``, in which case the file is opened where it is read."""
    source = "content" if "content" in files.columns else "path"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, given, *rest in batch.itertuples(index=False):
                try:
                    content = given
                    if source == "path":
                        system, at = opened(given)
                        with system.open_input_file(at) as f:
                            content = f.read()
                    out = [(k, *row, None) for row in read(content, *rest)]
                except Exception as e:
                    out = [(k, *[None] * len(columns), f"{type(e).__name__}: {e}"[:500])]
                yield pd.DataFrame(out, columns=["md5", *columns, "error"])

    return files.select("key", source, *more).mapInPandas(run, f"md5 string, {schema}, error string")


def text_blocks(content: bytes) -> Iterator[tuple[int, int, str]]:
    """Page, number and text of each block of a PDF file, in reading order. Needs PyMuPDF."""
    import fitz

    with fitz.open(stream=content, filetype="pdf") as doc:
        for page_no, page in enumerate(doc):
            for block_no, block in enumerate(page.get_text("blocks", sort=True)):
                yield page_no, block_no, block[4]


def pdf_blocks(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, int, str]]] = text_blocks) -> DataFrame:
    """``md5, page_no, block_no, text, error``: text blocks of PDF files in reading order."""
    return _per_file(files, read, ["page_no", "block_no", "text"], "page_no int, block_no int, text string")


def rendered(content: bytes, settings: config.Settings = config.Settings()) -> Iterator[tuple[int, int, int, bytes]]:
    """Page, width, height and PNG of each page of a PDF file: in grey, shrunk to the largest width, cut to black and white at
    127. Needs pypdfium2 and Pillow."""
    import pypdfium2

    for page_no, page in enumerate(pypdfium2.PdfDocument(content)):
        image = page.render(scale=settings.render_dpi / 72).to_pil()
        factor = min(1.0, settings.max_image_width / image.width)
        image = image.resize((int(factor * image.width), int(factor * image.height))).convert("L").point(lambda v: 255 if v > 127 else 0)
        out = io.BytesIO()
        image.save(out, "PNG")
        yield page_no, image.width, image.height, out.getvalue()


def pdf_images(files: DataFrame, settings: config.Settings = config.Settings(), render: Callable[..., Iterator[tuple[int, int, int, bytes]]] = rendered) -> DataFrame:
    """``md5, page_no, width, height, image, error``: the pages of PDF files as images."""
    return _per_file(files, partial(render, settings=settings), ["page_no", "width", "height", "image"], "page_no int, width int, height int, image binary")


WORD_COLUMNS = ("word_no", "block_num", "par_num", "line_num", "conf", "text")


def recognised(image: bytes, language: str) -> Iterator[tuple[int, int, int, int, float, str]]:
    """WORD_COLUMNS of each word of a page's image, in reading order. ``language``: a code of Tesseract, which it needs."""
    import pytesseract
    from PIL import Image

    found = pytesseract.image_to_data(Image.open(io.BytesIO(image)), lang=language, config="--oem 3 --psm 3", output_type=pytesseract.Output.DICT)
    for i in range(len(found["text"])):
        yield (i, found["block_num"][i], found["par_num"][i], found["line_num"][i], float(found["conf"][i]), found["text"][i])


def ocr_words(
    files: DataFrame,
    settings: config.Settings = config.Settings(),
    render: Callable[..., Iterator[tuple[int, int, int, bytes]]] = rendered,
    recognise: Callable[[bytes, str], Iterator[tuple]] = recognised,
) -> DataFrame:
    """Words of PDF files (``key``, ``content`` or ``path``, and ``language``, a UN code), page by page, without images that
    leave their worker: ``md5, language, page_no``, WORD_COLUMNS, ``error``. A document that was read whole ends with a row
    without page, so that one without any word is known to be done; one that failed has a row with its error only."""

    def read(content: bytes, language: str) -> Iterator[tuple]:
        code = config.UN_TO_TESSERACT.get(language, "eng")
        for page_no, _, _, image in render(content, settings=settings):
            for word in recognise(image, code):
                yield (language, page_no, *word)
        yield (language, None, *[None] * len(WORD_COLUMNS))

    schema = "language string, page_no int, word_no long, block_num int, par_num int, line_num int, conf double, text string"
    return _per_file(files, read, ["language", "page_no", *WORD_COLUMNS], schema, ("language",))


def file_languages(files: DataFrame, read: Callable[[bytes], Iterator[tuple[int, int, str]]] = text_blocks, settings: config.Settings = config.Settings()) -> DataFrame:
    """``md5, language, n_languages`` of PDF files, by vote of their text blocks; the default where none can be read."""
    found = pdf_blocks(files, read)
    voting = pages.voting_blocks(found.where("error is null"), settings)
    votes = voting.select("md5", languages.guess_language(F.col("text")).alias("lang")).where("lang is not null")
    return pages.vote(votes, files.select(F.col("key").alias("md5")), settings)


def in_small_tasks(files: DataFrame, settings: config.Settings = config.Settings()) -> DataFrame:
    """A listing dealt out so that a task has no more than a worker may read: recognisers leak memory, and a worker ends with
    its task where ``spark.python.worker.reuse`` is off. Paths move, not files."""
    n = files.count()
    return files.repartition(max(1, -(-n // settings.worker_documents)))
