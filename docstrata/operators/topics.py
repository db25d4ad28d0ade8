"""Topics from terms: class-based TF-IDF, labels, representative documents, reassignment of outliers, distributions.

Term tables are counted where they lie before they move. What topics make of a term is one row per term, which is written
once: joins with it have no more rows than they are given, and a common term is split among tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.functions import text as T
from docstrata.operators.catalogue import rank_within
from docstrata.operators.shares import term_distribution
from docstrata.sources.shared import discard, materialise, owning

OUTLIER = -1
#: Topics that windows are compared with at most, as one matrix.
MAX_TOPICS = 10_000


def term_counts(docs: DataFrame, *by: str, text: str = "paragraph") -> DataFrame:
    """``by..., term, n`` over words and pairs of neighbours."""
    words = docs.select(*by, T.tokens(F.col(text)).alias("_words"))
    return words.select(*by, F.explode(T.ngrams(F.col("_words"))).alias("term")).groupBy(*by, "term").agg(F.count("*").alias("n"))


def frequency(n: Column, total: Column) -> Column:
    """Share of a class's terms, with frequent words reduced."""
    return F.sqrt(n / total)


def term_idf(counts: DataFrame, by: str = "topic_nr") -> DataFrame:
    """``term, idf``: ln(1 + mean terms per class, cut to an integer, over the term's count)."""
    mean = counts.agg(F.floor(F.sum("n") / F.countDistinct(by)).alias("a"))
    return counts.groupBy("term").agg(F.sum("n").alias("f")).join(F.broadcast(mean)).select("term", F.log(1 + F.col("a") / F.col("f")).alias("idf"))


def weighted(counts: DataFrame, idf: DataFrame, *by: str) -> DataFrame:
    """``by..., term, n, weight`` of counts under given idf values."""
    totals = counts.groupBy(*by).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(by)).join(idf, "term").select(*by, "term", "n", (frequency(F.col("n"), F.col("total")) * F.col("idf")).alias("weight"))


def ctfidf(counts: DataFrame, by: str = "topic_nr") -> DataFrame:
    """``topic_nr, term, n, weight``, over a written table. Terms are counted once; what a class sums up to is one row for each class,
    which is broadcast, and the rows of a term, one for each class at most, meet by the term alone: no task has a whole class."""
    counts = materialise(counts, "counts")
    sums = counts.groupBy(by).agg(F.sum("n").alias("total"))
    named = F.collect_list(F.when(F.col(by).isNotNull(), F.struct(by, "total")))  # rows without a class count for the terms only
    whole = sums.agg(F.map_from_entries(named).alias("totals"), F.floor(F.sum("total") / F.count(by)).alias("a"))
    seen = counts.withColumn("f", F.sum("n").over(Window.partitionBy("term"))).where(F.col(by).isNotNull()).join(F.broadcast(whole))
    weight = frequency(F.col("n"), F.col("totals")[F.col(by)]) * F.log(1 + F.col("a") / F.col("f"))
    return owning(seen.select(by, "term", "n", weight.alias("weight")), counts)


def top_words(weights: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``topic_nr, rank, term, weight``: the heaviest terms, of equals (to nine places) the first."""
    return rank_within(weights.select("topic_nr", "term", "weight"), "topic_nr", s.top_words, F.desc(F.round("weight", 9)), "term").select("topic_nr", "rank", "term", "weight")


def labels(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``topic_nr, label``: the number and the first words."""
    first = words.where(F.col("rank") <= s.label_words).groupBy("topic_nr").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("w"))
    return first.select("topic_nr", F.concat_ws("_", F.col("topic_nr").cast("string"), F.transform("w", lambda x: x["term"])).alias("label"))


def words_wide(words: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per topic, outliers left out: ``topic_nr, word_1, word_2, ...``."""
    firsts = [F.max(F.when(F.col("rank") == k, F.col("term"))).alias(f"word_{k}") for k in range(1, s.top_words + 1)]
    return words.where(F.col("topic_nr") != OUTLIER).groupBy("topic_nr").agg(*firsts)


def sizes_relabelled(assigned: DataFrame, topic: str = "topic_nr") -> DataFrame:
    """``topic_nr, n, new_topic``: topics numbered from 0 by falling size; outliers stay apart."""
    sizes = assigned.groupBy(F.col(topic).alias("topic_nr")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.col("topic_nr") == OUTLIER).orderBy(F.desc("n"), "topic_nr")
    return sizes.select("topic_nr", "n", F.when(F.col("topic_nr") == OUTLIER, F.lit(OUTLIER)).otherwise(F.row_number().over(order) - 1).alias("new_topic"))


def term_table(docs: DataFrame, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``term, idf, topics``, over a written table: for each term its idf and a list of ``topic_nr, weight`` of the topics that have
    it, outliers among them, each weight over the length of its topic's whole vector, so that products are cosines."""
    counts = materialise(term_counts(docs, "topic_nr", text=text), "counts")
    sums = counts.groupBy("topic_nr").agg(F.sum("n").alias("total"))
    whole = sums.agg(F.map_from_entries(F.collect_list(F.struct("topic_nr", "total"))).alias("totals"), F.floor(F.sum("total") / F.count("*")).alias("a"))
    by_term = counts.groupBy("term").agg(F.sum("n").alias("f"), F.collect_list(F.struct("topic_nr", "n")).alias("in"))
    idf = F.log(1 + F.col("a") / F.col("f"))  # one row per topic makes the sums, so they are broadcast
    weights = F.transform("in", lambda x: F.struct(x["topic_nr"].alias("topic_nr"), (frequency(x["n"], F.col("totals")[x["topic_nr"]]) * F.col("idf")).alias("weight")))
    told = by_term.join(F.broadcast(whole)).withColumn("idf", idf).select("term", "idf", weights.alias("topics"))
    raw = materialise(told, "terms")
    each = raw.select(F.explode("topics").alias("t")).groupBy("t.topic_nr").agg(F.sqrt(F.sum(F.col("t.weight") * F.col("t.weight"))).alias("length"))
    lengths = materialise(each.agg(F.map_from_entries(F.collect_list(F.struct("topic_nr", "length"))).alias("lengths")), "lengths")
    scaled = F.transform("topics", lambda x: F.struct(x["topic_nr"].alias("topic_nr"), (x["weight"] / F.col("lengths")[x["topic_nr"]]).alias("weight")))
    discard(counts)
    return owning(raw.join(F.broadcast(lengths)).select("term", "idf", scaled.alias("topics")), raw, lengths)


def similarities(own: DataFrame, terms: DataFrame, *key: str) -> DataFrame:
    """``key..., topic_nr, sim``: cosines of the sparse term vectors of ``own`` (``key..., term, n``) and of topics that share a
    term with them, outliers left out. Everything after the join on terms stays where the first key is."""
    met = own.join(terms, "term").select(*key, (F.sqrt("n") * F.col("idf")).alias("w"), "topics").repartition(key[0])
    length = met.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = met.select(*key, "w", F.explode("topics").alias("t")).where(F.col("t.topic_nr") != OUTLIER)
    dots = dots.groupBy(*key, F.col("t.topic_nr").alias("topic_nr")).agg(F.sum(F.col("w") * F.col("t.weight")).alias("dot"))
    return dots.join(length, list(key)).select(*key, "topic_nr", (F.col("dot") / F.col("length")).alias("sim"))


def reassigned(docs: DataFrame, key: str, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``key, topic_nr, new_topic``: outliers go to the topic most like them, if any is like enough; of equals the least.
    ``docs``: ``key, topic_nr`` and a text."""
    terms = term_table(docs, text, s)
    own = term_counts(docs.where(F.col("topic_nr") == OUTLIER), key, text=text)
    near = similarities(own, terms, key).where(F.col("sim") >= s.min_similarity)
    best = near.groupBy(key).agg(F.min(F.struct((-F.col("sim")).alias("s"), "topic_nr"))["topic_nr"].alias("best"))
    found = docs.select(key, "topic_nr").join(best, key, "left").select(key, "topic_nr", F.coalesce("best", "topic_nr").alias("new_topic"))
    return owning(found, terms)


def representative_docs(docs: DataFrame, key: str, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``topic_nr, rank, key, sim``: the documents of a topic most like it, outliers left out."""
    terms = term_table(docs, text, s)
    own = term_counts(docs.where(F.col("topic_nr") != OUTLIER), key, "topic_nr", text=text)
    mine = F.filter("topics", lambda x: x["topic_nr"] == F.col("topic_nr"))[0]["weight"]
    met = own.join(terms, "term").select(key, "topic_nr", (F.sqrt("n") * F.col("idf")).alias("w"), mine.alias("t"))
    sims = met.groupBy(key, "topic_nr").agg((F.sum(F.col("w") * F.col("t")) / F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("sim"))
    ranked = rank_within(sims, "topic_nr", s.top_docs, F.desc(F.round("sim", 9)), key)
    return owning(ranked.select("topic_nr", "rank", key, "sim"), terms)


def words_and_docs(wide: DataFrame, representatives: DataFrame, key: str, s: Settings = Settings()) -> DataFrame:
    """Topic words beside representative documents, topics of either side kept."""
    docs = representatives.groupBy("topic_nr").agg(*[F.max(F.when(F.col("rank") == k, F.col(key))).alias(f"doc_{k}") for k in range(1, s.top_docs + 1)])
    return wide.join(docs, "topic_nr", "full_outer")


def token_windows(docs: DataFrame, key: str, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``key, window_no, window``: words of each window joined by blanks."""
    words = docs.select(key, T.tokens(F.col(text)).alias("_words"))  # a column of its own, else each window would find the words anew
    return words.select(key, F.posexplode(F.transform(T.windows(F.col("_words"), s), lambda w: F.array_join(w, " "))).alias("window_no", "window"))


def shares(sims: DataFrame, key: str, s: Settings = Settings()) -> DataFrame:
    """``key, topic_nr, weight``: similarities of windows to topics, small ones left out, summed and made to sum to one."""
    summed = sims.where(F.col("sim") >= s.min_similarity).groupBy(key, "topic_nr").agg(F.sum("sim").alias("w"))
    return summed.select(key, "topic_nr", (F.col("w") / F.sum("w").over(Window.partitionBy(key))).alias("weight"))


def topic_distribution(docs: DataFrame, key: str, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``key, topic_nr, weight`` by the terms of a document's windows. Only topics with a weight have a row."""
    return term_distribution(docs, key, text, s)


def embedded_distribution(docs: DataFrame, key: str, topics: DataFrame, embed: Callable[[Column], Column], text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``key, topic_nr, weight`` by the vectors of a document's windows. ``topics``: ``topic_nr, embedding``, outliers left out;
    they are few, and checked to be; each window is compared with all of them where it is."""
    known = topics.where(F.col("topic_nr") != OUTLIER).orderBy("topic_nr").limit(MAX_TOPICS + 1).collect()
    if len(known) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    if not known:
        return docs.select(key, F.lit(0).alias("topic_nr"), F.lit(0.0).alias("weight")).limit(0)
    matrix = np.array([r["embedding"] for r in known], np.float64)
    units = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<double>")
    def cosines(found: pd.Series) -> pd.Series:
        x = np.array(found.tolist(), np.float64).reshape(len(found), -1)
        return pd.Series(list((x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)) @ units.T))

    numbers = F.array(*[F.lit(r["topic_nr"]) for r in known])
    sims = token_windows(docs, key, text, s).select(key, cosines.asNondeterministic()(embed(F.col("window"))).alias("c"))  # worked out once, see embedded
    return shares(sims.select(key, F.posexplode("c").alias("at", "sim")).select(key, numbers[F.col("at")].alias("topic_nr"), "sim"), key, s)


def reranked(words: DataFrame, means: DataFrame, embed: Callable[[Column], Column] | DataFrame, s: Settings = Settings()) -> DataFrame:
    """``topic_nr, rank, term, weight``: of a topic's heaviest terms (``topic_nr, term``), those whose vectors are most like the
    mean vector of its representative documents (``topic_nr, mean``). ``embed``: a column function, or a table ``term, e``."""
    both = words.select("topic_nr", "term").join(means.select("topic_nr", "mean"), "topic_nr", "left")
    both = both.join(embed, "term", "left") if isinstance(embed, DataFrame) else both.withColumn("e", embed(F.col("term")))
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda t, x: t + x)
    dot = product("e", "mean") if not isinstance(embed, DataFrame) else product("e", "mean") / F.sqrt(product("e", "e"))
    return top_words(both.select("topic_nr", "term", F.coalesce(dot, F.lit(0.0)).alias("weight")), s)


def distribution_wide(distribution: DataFrame, key: str, topics: list[int]) -> DataFrame:
    """One column per topic, the topics given, so that no pass is spent on finding them."""
    return distribution.groupBy(key).pivot("topic_nr", topics).agg(F.sum("weight")).na.fill(0.0)
