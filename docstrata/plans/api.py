"""The document collection and the topic model as objects over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import config
from docstrata.config import Settings
from docstrata.operators import boundaries, catalogue, clustering, layout, pages, paragraphs, topics, vectors
from docstrata.plans.embedding import DIM, Embedder, HashedNgrams, embedded
from docstrata.sources import readers, sinks
from docstrata.sources.files import qualified
from docstrata.sources.shared import discard, materialise, owning

KEYS = ("document_md5", "paragraph_id")


class Collection:
    """Documents of a catalogue in a folder: ``overview.csv``, and beneath it ``pdfs``, ``docs``, ``embeddings``, ``ocr``."""

    def __init__(self, spark: SparkSession, folder: str, name: str = "overview.csv"):
        self.spark, self.folder, self.name = spark, folder.rstrip("/"), name
        self.documents = readers.overview(spark, f"{self.folder}/{name}", self.folder)

    def __len__(self) -> int:
        return self.documents.count()

    def __str__(self) -> str:
        return f"{len(self)} documents in {self.folder}"

    def load_documents(self) -> Collection:
        """Documents that have been stored, with what was stored."""
        store = readers.stored_documents(self.spark, f"{self.folder}/docs", self.folder)
        self.documents = catalogue.load_from_store(self.documents, store)
        return self

    def _stored(self, kind: str, key: str) -> DataFrame:
        """Keys of what a folder holds, as ``md5_sum``; none where there is no such folder."""
        try:
            found = readers.listing(self.spark, f"{self.folder}/{kind}") if kind == "pdfs" else readers.stored(self.spark, f"{self.folder}/{kind}")
            return found.select(F.col(key).alias("md5_sum"))
        except FileNotFoundError:
            return self.documents.select("md5_sum").limit(0)

    def download(self, **how) -> DataFrame:
        """Fetch and save the file of every document that has none yet: ``key, ok, path, length, error``."""
        rest = catalogue.remaining(self.documents, self._stored("pdfs", "key"))
        return materialise(readers.save_downloads(rest, qualified(self.spark, f"{self.folder}/pdfs"), **how), "downloads")

    def recognise(
        self, s: Settings = Settings(), blocks: Callable = readers.text_blocks, render: Callable = readers.rendered, recognise: Callable = readers.recognised
    ) -> DataFrame:
        """Read the words of every saved file that has not been read yet, each in the language that its text blocks vote for,
        and store them in ``ocr``. Documents that failed come back, as ``md5, error``, and are tried again next time."""
        files = readers.listing(self.spark, f"{self.folder}/pdfs", "*.pdf").withColumnRenamed("key", "md5_sum")
        rest = materialise(catalogue.remaining(files, self._stored("ocr", "md5")).withColumnRenamed("md5_sum", "key"), "files")
        spoken = materialise(readers.file_languages(readers.in_small_tasks(rest, s), blocks, s), "languages")
        told = rest.join(spoken.select(F.col("md5").alias("key"), "language"), "key")
        words = materialise(readers.ocr_words(readers.in_small_tasks(told, s), s, render, recognise), "words")
        sinks.write_table(words.where("error is null").drop("error"), f"{self.folder}/ocr")
        failed = materialise(words.where("error is not null").select("md5", "error"), "failed")
        discard(rest, spoken, words)
        return failed

    def extract_paragraphs(
        self, words: DataFrame | None = None, votes: DataFrame | None = None, s: Settings = Settings(), learn_boundaries: bool = False
    ) -> Collection:
        """From stored words, or from given words and language votes, to documents with paragraphs, stored. Documents that are
        stored already are left alone, so a broken run is simply run again. ``learn_boundaries``: sentences end as learned from
        the texts at hand."""
        if words is None:
            words = readers.stored(self.spark, f"{self.folder}/ocr")
        words = catalogue.remaining(words, self._stored("docs", "md5_sum").withColumnRenamed("md5_sum", "md5"), "md5")
        language = words.groupBy("md5").agg(F.min("language").alias("language")) if votes is None else pages.vote(votes, words, s)
        found = layout.page_paragraphs(words, s).groupBy("md5", "page_no").agg(F.transform(F.sort_array(F.collect_list(F.struct("par_idx", "paragraph"))), lambda x: x["paragraph"]).alias("paragraphs"))
        candidates = pages.trim_pages(found).select("md5", "page_no", F.posexplode("paragraphs").alias("block_no", "candidate")).join(language, "md5")
        learned = None
        if learn_boundaries:
            told = boundaries.learn(paragraphs.cleaned(candidates), "language", "candidate")
            learned = boundaries.Boundaries(told)
            discard(told)
        kept = paragraphs.process(candidates, "language", s, learned=learned)
        whole = kept.groupBy("md5", F.col("language")).agg(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "block_no", "chunk_no", "paragraph"))), lambda x: x["paragraph"]).alias("paragraphs"))
        declared = self.documents.withColumnRenamed("language", "language_declared")
        sinks.write_documents(declared.join(whole.withColumnRenamed("md5", "md5_sum"), "md5_sum"), f"{self.folder}/docs")
        return self

    def extract_all(self, s: Settings = Settings(), **how) -> DataFrame:
        """From saved files to stored paragraphs; the documents that have some are this collection's from then on. Returns the
        files that failed; ``how``: as for ``recognise``."""
        failed = self.recognise(s, **how)
        self.extract_paragraphs(s=s).load_documents()
        return failed

    def paragraph_frame(self) -> DataFrame:
        return catalogue.number_paragraphs(self.documents, F.col("md5_sum").alias("document_md5"), "language").select(*KEYS, "paragraph", "language")

    def paragraph_info(self) -> DataFrame:
        return catalogue.corpus_stats(self.paragraph_frame())

    def duplicates(self) -> DataFrame:
        """Rows of keys that occur more than once, by id of the catalogue."""
        return catalogue.duplicate_keys(self.documents, "md5_sum", "doc_id")

    def filter_by_name(self, words: tuple[str, ...] = config.NAME_BLACKLIST, path: str | None = None) -> Collection:
        """Leave out documents by words of their names, and write the catalogue that is left: in place, so that it is the one
        that is loaded next, or to another path."""
        left = catalogue.without_names(self.documents, words)
        sinks.write_overview(left, path or f"{self.folder}/{self.name}")
        # the files read so far are gone if they were written over
        self.documents = left if path else readers.overview(self.spark, f"{self.folder}/{self.name}", self.folder)
        return self

    def embed(self, embedder: Embedder = HashedNgrams(), dim: int = DIM) -> DataFrame:
        """Vectors of all paragraphs, stored by key."""
        found = self.paragraph_frame().select(*KEYS, embedded(F.col("paragraph"), embedder, dim).alias("embedding"))
        sinks.write_table(found, f"{self.folder}/embeddings", "overwrite")
        return self.load_embeddings()

    def load_embeddings(self) -> DataFrame:
        """Paragraphs with their vectors; an error where a document's numbers differ."""
        store, frame = readers.stored(self.spark, f"{self.folder}/embeddings"), self.paragraph_frame()
        gaps = catalogue.embedding_gaps(frame, store).count()
        if gaps:
            raise ValueError(f"{gaps} documents have other numbers of paragraphs than of embeddings")
        return catalogue.attach_embeddings(frame, store)


class TopicModel:
    """Topics of embedded paragraphs (``document_md5, paragraph_id, paragraph, embedding``)."""

    def __init__(self, rows: DataFrame, folder: str, settings: Settings = Settings(), embedder: Embedder = HashedNgrams()):
        self.spark, self.folder, self.s, self.embedder = rows.sparkSession, folder, settings, embedder
        self.rows = rows.withColumn("vec_id", F.xxhash64(*KEYS))
        self.tables: dict[str, DataFrame] = {}

    def _seed_vectors(self, dim: int) -> DataFrame:
        joined = config.seed_topics(self.spark).groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seed_idx", "phrase"))), lambda x: x["phrase"]), " ").alias("text"))
        return joined.select(F.col("key").alias("seed"), embedded(F.col("text"), self.embedder, dim).alias("embedding"))

    def guided(self) -> DataFrame:
        """Vectors pulled to the seed topics that they are like."""
        return vectors.guided(self.rows.select("vec_id", "embedding"), self._seed_vectors(self.dim))

    @cached_property
    def dim(self) -> int:
        """Dimensions of the vectors."""
        return self.rows.select(F.size("embedding")).head()[0]

    def run(self) -> TopicModel:
        """Reduce, cluster, merge topics, reassign outliers, describe, and save. Each step is a written table, which the
        next ones read, so that nothing is worked out twice and a lost executor costs one step at most."""
        s, rows, steps = self.s, self.rows, []

        def step(found: DataFrame, name: str) -> DataFrame:
            written = materialise(found, name)
            discard(found)  # the tables that it was made from
            steps.append(written)
            return written

        vecs = step(rows.select("vec_id", "embedding"), "vectors")
        placed = clustering.umap_layout(step(self.guided(), "guided"), dims=s.components, s=s)
        reduced = step(owning(placed.withColumnRenamed("coordinates", "embedding"), placed), "reduced")
        clustered = step(clustering.hdbscan(reduced, s=s), "clustered")
        means = vectors.as_arrays(vectors.centroids(vecs.join(clustered, "vec_id"), "topic_nr"), "topic_nr")
        merged = clustered.join(clustering.merge_topics(means, s.num_topics), "topic_nr").select("vec_id", F.col("merged_topic").alias("topic_nr"))
        docs = step(rows.select("vec_id", *KEYS, "paragraph").join(merged, "vec_id"), "merged")
        new = step(topics.reassigned(docs, "vec_id", s=s).select("vec_id", "new_topic"), "new")
        docs = step(docs.drop("topic_nr").join(new, "vec_id").withColumnRenamed("new_topic", "topic_nr"), "reassigned")
        sizes = step(topics.sizes_relabelled(docs), "sizes")
        number = sizes.select("topic_nr", F.col("new_topic").alias("t"))
        docs = step(docs.join(number, "topic_nr").select("vec_id", *KEYS, "paragraph", F.col("t").alias("topic_nr")), "topics")
        representatives = step(topics.representative_docs(docs, "vec_id", s=s), "representatives")
        weights = step(topics.ctfidf(step(topics.term_counts(docs, "topic_nr"), "counts")), "weights")
        words = step(self.reranked(weights, representatives), "words")
        laid = clustering.umap_layout(vecs, dims=2, s=s)
        flat = step(owning(laid.select("vec_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y")), laid), "coordinates")
        self.tables = {
            "assignments": docs.select("vec_id", *KEYS, "topic_nr"), "topic_words": words, "labels": topics.labels(words, s), "representatives": representatives,
            "distribution": self._distribution(docs, vecs), "sizes": sizes, "coordinates": flat,
        }
        sinks.save_model(self.tables, self.folder, s.num_topics)
        discard(*steps)
        return self.load()

    def reranked(self, weights: DataFrame, representatives: DataFrame, candidates: int = 50) -> DataFrame:
        """Of a topic's heaviest terms, those whose vectors are most like the mean vector of its representative documents."""
        some = topics.top_words(weights, Settings(top_words=candidates))
        rep = representatives.join(self.rows.select("vec_id", "embedding"), "vec_id")
        means = vectors.as_arrays(vectors.centroids(rep, "topic_nr"), "topic_nr").withColumnRenamed("embedding", "mean")
        return topics.reranked(some, means, self._embed, self.s)

    def _embed(self, text: Column) -> Column:
        return embedded(text, self.embedder, self.dim)

    def _distribution(self, docs: DataFrame, vecs: DataFrame) -> DataFrame:
        """Shares of topics by the vectors of windows, as the embedder gives them, and of topics."""
        means = vectors.as_arrays(vectors.centroids(vecs.join(docs.select("vec_id", "topic_nr"), "vec_id"), "topic_nr"), "topic_nr")
        return topics.embedded_distribution(docs, "vec_id", means, self._embed, s=self.s)

    def load(self) -> TopicModel:
        self.tables = sinks.load_model(self.spark, self.folder, self.s.num_topics)
        return self

    def store_results(self) -> None:
        """The four reports, each with row numbers."""
        t, n = self.tables, self.s.num_topics
        path = lambda name: f"{self.folder.rstrip('/')}/{n}_{name}_report.csv"
        base = self.rows.select("vec_id", *KEYS, "paragraph", *[c for c in ("language",) if c in self.rows.columns])
        placed = base.join(t["coordinates"], "vec_id").join(t["assignments"].select("vec_id", "topic_nr"), "vec_id").drop("vec_id")
        sinks.write_report(placed, path("reduced_embeddings_per_para"), *KEYS)
        wide = topics.words_wide(t["topic_words"], self.s)
        sinks.write_report(t["labels"].join(wide, "topic_nr"), path("representative_words"), "topic_nr")
        texts = t["representatives"].join(self.rows.select("vec_id", "paragraph"), "vec_id")
        sinks.write_report(topics.words_and_docs(wide, texts, "paragraph", self.s), path("representative_docs_per_topic"), "topic_nr")
        known = [r[0] for r in t["sizes"].where(F.col("new_topic") >= 0).select("new_topic").orderBy("new_topic").collect()]
        theta = topics.distribution_wide(t["distribution"], "vec_id", known)
        names = {str(r["topic_nr"]): r["label"] for r in t["labels"].collect()}
        theta = base.join(theta, "vec_id", "left").na.fill(0.0, [str(k) for k in known]).drop("vec_id")
        sinks.write_report(theta.withColumnsRenamed({str(k): names.get(str(k), str(k)) for k in known}), path("theta_embeddings"), *KEYS)
