"""Small cases of operators on tables."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.operators import catalogue, clustering, layout, pages, topics, vectors
from docstrata.plans import tables
from docstrata.plans.embedding import HashedNgrams, embedded


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()] if order else [tuple(r) for r in df.collect()]


def test_duplicates_and_stats(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx long, md5_sum string")
    assert rows(catalogue.duplicate_keys(d), "idx") == [(0, "a"), (2, "a")]
    assert rows(catalogue.corpus_stats(spark.createDataFrame([], "paragraph string"))) == [(0, 0, None)]


def test_store_join_follows_overview(spark):
    o = spark.createDataFrame([("a",), ("a",), ("z",)], "md5_sum string")
    s = spark.createDataFrame([("a", "stored")], "md5_sum string, name string")
    assert rows(catalogue.load_from_store(o, s)) == [("a", "stored")] * 2
    assert rows(catalogue.remaining(o, s)) == [("z",)]


def page_rows(spark, headings, n=10):
    return spark.createDataFrame([("d", i, [headings.get(i, "text"), "more"]) for i in range(n)], "md5 string, page_no int, paragraphs array<string>")


def test_page_ranges(spark):
    kept = lambda h, **k: [r[1] for r in rows(pages.trim_pages(page_rows(spark, h), **k), "page_no")]
    assert kept({1: "Contents", 3: "Contenu", 7: "References"}) == [3, 4, 5, 6]
    assert kept({0: "References"}) == list(range(10))
    assert kept({5: "Contents", 2: "References"}) == []
    assert kept({4: "Рекомендации"}) == list(range(10)) and kept({4: "Рекомендации"}, fix_russian=True) == [0, 1, 2, 3]


def test_row_indexes(spark):
    words, n = [], 0
    for par, lines in enumerate((2, 3, 1)):
        for line in range(lines):
            for w in ("a", "b", " "):
                words.append(("m", 0, n, 0, par, line, 5.0 if w != "b" else -1.0, w))
                n += 1
    df = spark.createDataFrame(words, "md5 string, page_no int, word_no long, block_num int, par_num int, line_num int, conf double, text string")
    assert [(r["paragraph"], r["n_lines"], r["row_index"]) for r in layout.page_paragraphs(df).orderBy("par_idx").collect()] == [("a a", 2, 0), ("a a a", 3, 3), ("a", 1, 7)]


def test_language_vote(spark):
    votes = spark.createDataFrame([("a", "fr"), ("a", "en"), ("b", "es"), ("b", "es"), ("b", "en")], "md5 string, lang string")
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "md5 string")
    assert rows(pages.vote(votes, docs), "md5") == [("a", "en", 2), ("b", "es", 2), ("c", "en", 0)]


def test_reassignment_never_moves_an_insider(spark):
    docs = spark.createDataFrame([(0, 1, "solar panels power"), (1, 2, "ocean fish water"), (2, -1, "solar panels everywhere"), (3, -1, "qq ww ee rr")], "k long, topic_nr int, paragraph string")
    assert rows(topics.reassigned(docs, "k"), "k") == [(0, 1, 1), (1, 2, 2), (2, -1, 1), (3, -1, -1)]


def test_theta_sums_to_one(spark):
    docs = spark.createDataFrame([(0, 1, "solar panels power the house"), (1, 2, "ocean fish swim in water")], "k long, topic_nr int, paragraph string")
    sums = topics.topic_distribution(docs, "k").groupBy("k").agg(F.sum("weight")).collect()
    assert len(sums) == 2 and all(abs(r[1] - 1) < 1e-9 for r in sums)


def vector_rows(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_neighbours_by_blocks_equal_those_at_once(spark, monkeypatch):
    x = np.random.default_rng(0).standard_normal((60, 8)).round(3)
    df = vector_rows(spark, x)
    once = rows(vectors.nearest(df, df, k=4), "vec_id", "rank")
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1000)
    assert rows(vectors.nearest(df, df, k=4), "vec_id", "rank") == once
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    assert [r[2] for r in once if r[0] == 0] == list(np.argsort(-s[0])[:4])


def test_components_match_svd(spark):
    x = np.random.default_rng(1).standard_normal((40, 6)).astype(np.float32)
    got = np.array([r[1] for r in rows(vectors.components(vector_rows(spark, x), 3), "vec_id")])
    c = x - x.mean(axis=0)
    u, s, _ = np.linalg.svd(c.astype(np.float64), full_matrices=False)
    assert np.allclose(np.abs(got), np.abs((u * s)[:, :3]), atol=1e-5)
    scaled = np.array([r[1] for r in rows(vectors.rescaled(vectors.components(vector_rows(spark, x), 3)), "vec_id")])
    assert abs(scaled[:, 0].std() - 1e-4) < 1e-12


def blobs():
    r = np.random.default_rng(2)
    return np.vstack([r.standard_normal((40, 4)) * 0.05 + c for c in np.eye(4)[:3] * 3] + [r.uniform(-6, 6, (12, 4))])


def test_leaf_clusters(spark):
    labels = clustering.leaf_clusters(blobs(), 30, 10)
    assert sorted(len({labels[i] for i in range(a, a + 40)} - {-1}) for a in (0, 40, 80)) == [1, 1, 1] and len(set(labels) - {-1}) == 3
    assert all((labels == t).sum() >= 30 for t in set(labels) - {-1})
    assert (clustering.leaf_clusters(blobs()[:40], 30, 10) == -1).all()


def test_clusters_beyond_the_fitted_rows(spark):
    found = dict(rows(clustering.hdbscan(vector_rows(spark, blobs()), s=Settings(min_cluster_size=15, min_samples=5), fit_rows=100)))
    assert len(found) == 132 and len({found[i] for i in range(40)} - {-1}) <= 2


def test_all_vectors_are_fitted_by_blocks(spark, monkeypatch):
    r = np.random.Generator(np.random.PCG64(8))
    x = np.vstack([r.standard_normal((n, 4)) * 0.05 + c for n, c in zip((60, 60, 20), np.eye(4)[:3] * 3)] + [r.uniform(-6, 6, (12, 4))])
    df, s = vector_rows(spark, x), Settings(min_cluster_size=15, min_samples=5)
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 2000)
    keys = np.arange(len(x))
    tree, whole = clustering.spanning_tree_by_blocks(df, "vec_id", "embedding", keys, 5), clustering.spanning_tree(clustering.mutual_reachability(x, 5))
    assert np.allclose(tree[:, 2], whole[:, 2], atol=1e-6)
    found = dict(rows(clustering.hdbscan(df, s=s, fit_rows=50)))
    assert len({found[i] for i in range(120, 140)} - {-1}) == 1 and sum(found[i] != -1 for i in range(120, 140)) >= 15
    got = dict(rows(clustering.umap_layout(df, fit_rows=50), "vec_id"))
    assert len(got) == len(x) == len({tuple(c) for c in got.values()})


def test_keys_may_repeat_and_components_must_be_numbers(spark):
    x, s = blobs(), Settings(min_cluster_size=15, min_samples=5)
    df = vector_rows(spark, x).withColumn("vec_id", F.floor(F.col("vec_id") / 2).cast("long"))
    found = clustering.hdbscan(df, s=s, fit_rows=50).collect()
    assert len(found) == len(x) and sum(r["vec_id"] == 3 for r in found) == 2
    with pytest.raises(ValueError, match="not a number"):
        clustering.hdbscan(vector_rows(spark, np.full((60, 4), np.nan)), s=s, fit_rows=50)


def test_merge_and_layout(spark):
    t = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    assert clustering.merged(t, 2).tolist() == [0, 0, 1, 1] and clustering.merged(t, 9).tolist() == [0, 1, 2, 3]
    df = vector_rows(spark, blobs())
    a, b = (rows(clustering.umap_layout(df), "vec_id") for _ in range(2))
    assert a == b and len(a) == 132


def test_shares_of_topics_by_vectors(spark):
    """Against a loop over windows, with vectors that can be worked out by hand."""
    import pandas as pd

    @F.pandas_udf("array<double>")
    def embed(text: pd.Series) -> pd.Series:
        return pd.Series([[float(t.count("a")), float(t.count("b")), 0.5] for t in text])

    docs = spark.createDataFrame([(1, "aa ba ab aaa bbb ab aa bb"), (2, "cc cc"), (3, ""), (4, "bb bb bb bb bb bb bb")], "k long, paragraph string")
    known = spark.createDataFrame([(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (-1, [0.0, 0.0, 9.0])], "topic_nr int, embedding array<double>")
    s = Settings(min_similarity=0.3)
    wanted = {}
    for k, text in docs.collect():
        w = text.split()
        sums = {}
        for i in range(0, max(1, len(w) - 4), 2) if w else []:
            t = " ".join(w[i : i + 5])
            v = np.array([t.count("a"), t.count("b"), 0.5])
            for topic in (0, 1):
                c = v[topic] / np.linalg.norm(v)
                if c >= 0.3:
                    sums[topic] = sums.get(topic, 0) + c
        wanted |= {(k, t): x / sum(sums.values()) for t, x in sums.items()}
    got = {(r["k"], r["topic_nr"]): r["weight"] for r in topics.embedded_distribution(docs, "k", known, embed, s=s).collect()}
    assert got.keys() == wanted.keys() and all(abs(got[x] - wanted[x]) < 1e-9 for x in got)
    assert topics.embedded_distribution(docs, "k", known.limit(0), embed, s=s).collect() == []
    words = spark.createDataFrame([(0, "aab"), (0, "bbb"), (0, "a"), (1, "bbb"), (1, "ab"), (2, "x")], "topic_nr int, term string")
    ranked = topics.reranked(words, known.withColumnRenamed("embedding", "mean"), embed, Settings(top_words=2)).collect()
    assert sorted((r["topic_nr"], r["rank"], r["term"], r["weight"]) for r in ranked) == [(0, 1, "aab", 2.0), (0, 2, "a", 1.0), (1, 1, "bbb", 3.0), (1, 2, "ab", 1.0), (2, 1, "x", 0.0)]


def test_neighbours_in_many_blocks(spark, monkeypatch):
    """Blocks of a few vectors give what one block gives."""
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.integers(-2, 3, 6)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, vectors.nearest(df, df, k=5).collect()))
    monkeypatch.setattr(vectors, "BLOCK_BYTES", 1000)
    assert sorted(map(tuple, vectors.nearest(df, df, k=5).collect())) == whole and len(whole) == 1500
    x = np.array([v for _, v in rows])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    sims = np.round(x @ x.T, 9)
    for i in range(300):
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-sims[i, j], j))[:5]
        assert [n for k, _, n, _ in whole if k == i] == order
    assert vectors.nearest(df, df.limit(0), k=5).collect() == [] and vectors.nearest(df.limit(0), df, k=5).collect() == []


def test_pieces_of_a_table_are_bounded(spark, tmp_path, monkeypatch):
    """A larger table has more pieces, not larger ones."""
    spark.range(20_000).write.parquet(f"{tmp_path}/t.parquet")
    rows = tables.table(spark, str(tmp_path), "t")
    monkeypatch.setattr(tables, "PIECE_BYTES", 1000)
    assert tables.spread(rows).rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism


def test_terms_meet_without_their_classes(spark):
    """No rows are moved by class, and terms without a class count for the others' idf only."""
    counts = spark.createDataFrame([(0, "a", 2), (0, "b", 6), (1, "a", 4), (None, "a", 9)], "topic_nr int, term string, n long")
    found = topics.ctfidf(counts)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(topic_nr" not in plan.split("BroadcastExchange")[0]
    got = {(x["topic_nr"], x["term"]): x["weight"] for x in found.collect()}
    idf = {"a": math.log(1 + 10 / 15), "b": math.log(1 + 10 / 6)}
    wanted = {(0, "a"): (2 / 8) ** 0.5 * idf["a"], (0, "b"): (6 / 8) ** 0.5 * idf["b"], (1, "a"): idf["a"]}
    assert got == pytest.approx(wanted)


def test_lines_move_to_their_page_once(spark):
    words = spark.createDataFrame([("m", 0, 1, 0, 0, 0, 9.0, "a")], "md5 string, page_no int, word_no long, block_num int, par_num int, line_num int, conf double, text string")
    assert layout.page_paragraphs(words)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2


def test_each_text_is_embedded_once(spark):
    """Inferred filters repeated the embedder, and moved it below the join with the documents that have a vector."""
    seen = spark.sparkContext.accumulator(0)

    class Counted:
        def embed(self, texts, dim):
            seen.add(len(texts))
            return np.ones((len(texts), dim))

    kept = spark.createDataFrame([(1,), (2,)], "k long")
    docs = kept.join(spark.createDataFrame([(i, "aa bb cc dd ee ff gg") for i in range(40)], "k long, paragraph string").repartition(2), "k")
    vectors.centroids(docs.select("k", embedded(F.col("paragraph"), Counted(), 4).alias("embedding")), "k").collect()
    assert seen.value == 2
    known = spark.createDataFrame([(0, [1.0, 1.0, 1.0, 1.0])], "topic_nr int, embedding array<double>")
    topics.embedded_distribution(docs, "k", known, lambda c: embedded(c, Counted(), 4)).collect()
    assert seen.value == 2 + 2 * 2


def test_hashed_ngrams_count_pieces():
    text = "One two two\n" * 9 + "\u00e9t\u00e9 " + "x" * 70
    row = np.zeros(8)
    for word in text.lower().split():
        for piece in (word, *(f"^{word}$"[i : i + 3] for i in range(len(word)))):
            h = zlib.crc32(piece.encode())
            row[h % 8] += 1 if h >> 16 & 1 else -1
    small = HashedNgrams()
    small.SLAB = 4
    for embedder in (HashedNgrams(), small):
        assert (embedder.embed(["", text, "one"], 8)[:2] == [np.zeros(8), row / np.linalg.norm(row)]).all()
    assert HashedNgrams().embed([], 8).shape == (0, 8)


def test_the_largest_component_is_not_compared_again(spark, monkeypatch):
    asked, plain = [], clustering._compared

    def counted(rows, key, vector, keys, found, schema, wanted=None):
        asked.append(sum(wanted(np.arange(len(keys)))) if wanted else len(keys))
        return plain(rows, key, vector, keys, found, schema, wanted)

    monkeypatch.setattr(clustering, "_compared", counted)
    x = blobs()
    tree = clustering.spanning_tree_by_blocks(vector_rows(spark, x), "vec_id", "embedding", np.arange(len(x)), 5)
    assert np.allclose(tree[:, 2], clustering.spanning_tree(clustering.mutual_reachability(x, 5))[:, 2], atol=1e-6)
    assert asked[:2] == [132, 132] and all(n < 132 for n in asked[2:])


def test_documents_are_dealt_once_by_their_key(spark, sf):
    """The join took pieces dealt at random and dealt them anew, into tasks of any size."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = tables.topic_docs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "RoundRobin" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_shares_of_topics_by_terms_in_small_blocks(spark, monkeypatch):
    """Against a loop over windows, with repeated keys, texts and topics that are missing, whatever the size of blocks. Windows' terms
    are not rows any more."""
    import math
    from collections import Counter, defaultdict

    from docstrata.operators import shares

    r = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in r.zipf(1.5, n) % 40 + 10) for n in r.integers(0, 60, 40)]
    data = [(i // 2 if i < 6 else i, [-1, 0, 1, 2, None][i % 5], t) for i, t in enumerate(texts)] + [(50, 1, None), (51, 0, "lone")]
    words = [(k, t, (text or "").split()) for k, t, text in data]
    terms = lambda w: w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    by_topic, of, wins = defaultdict(Counter), Counter(), defaultdict(Counter)
    for k, t, w in words:
        by_topic[t].update(terms(w))
        of.update(terms(w))
        for no, i in enumerate(range(0, max(len(w) - 5, 0) + 1, 2) if w else []):
            wins[k, no].update(terms(w[i : i + 5]))
    known = [t for t in by_topic if t is not None]
    idf = {x: math.log(1 + sum(of.values()) // len(known) / n) for x, n in of.items()}
    weight = {t: {x: math.sqrt(n / by_topic[t].total()) * idf[x] for x, n in by_topic[t].items()} for t in known}
    length = {t: math.sqrt(sum(v * v for v in weight[t].values())) for t in known}
    sums = defaultdict(lambda: defaultdict(float))
    for (k, _), c in wins.items():
        own = {x: math.sqrt(n) * idf[x] for x, n in c.items()}
        for t in known:
            sim = sum(v * weight[t].get(x, 0) for x, v in own.items()) / length[t] / math.sqrt(sum(v * v for v in own.values()))
            if t != -1 and sim >= 0.02:
                sums[k][t] += sim
    wanted = {(k, t): x / sum(of_key.values()) for k, of_key in sums.items() for t, x in of_key.items()}
    docs = spark.createDataFrame(data, "k long, topic_nr int, paragraph string")
    for sizes in ((1 << 18, 1 << 20, 1 << 18), (30, 50, 20)):
        for name, size in zip(("BLOCK_WORDS", "BUCKET_TERMS", "SLAB"), sizes):
            monkeypatch.setattr(shares, name, size)
        found = topics.topic_distribution(docs, "k", s=Settings(min_similarity=0.02))
        got = {(x["k"], x["topic_nr"]): x["weight"] for x in found.collect()}
        assert got.keys() == wanted.keys() and all(abs(got[x] - wanted[x]) < 1e-9 for x in got)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "window_no" not in plan
    nothing = topics.topic_distribution(docs.where("paragraph IS NULL"), "k")
    assert nothing.collect() == [] and nothing.columns == ["k", "topic_nr", "weight"]


def test_a_layout_takes_neighbours_from_lists_and_edges_in_slabs(spark, monkeypatch):
    """Whatever the size of slabs, the same bits; no block of vectors is compared with all others and sorted whole."""
    df = vector_rows(spark, np.random.default_rng(5).standard_normal((90, 6)))
    once = rows(clustering.umap_layout(df, fit_rows=50), "vec_id")
    assert all(len(c) == 5 for _, c in rows(clustering.umap_layout(df.limit(40), dims=5), "vec_id"))
    monkeypatch.setattr(clustering, "SLAB", 50)
    monkeypatch.setattr(vectors, "nearest", None)
    monkeypatch.setattr(clustering, "nearest", None, raising=False)
    assert rows(clustering.umap_layout(df, fit_rows=50), "vec_id") == once


def test_all_pairs_meet_without_a_shuffle_of_vectors(spark, monkeypatch):
    """Each block went through a shuffle once for each other one, in each round: disk by the square of the vectors. Vectors are compared
    again only where their shortest edges don't tell."""
    plans, asked, plain = [], [], clustering._compared

    def seen(rows, key, vector, keys, found, schema, wanted=None):
        out = plain(rows, key, vector, keys, found, schema, wanted)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        asked.append(sum(wanted(np.arange(len(keys)))) if wanted else len(keys))
        return out

    monkeypatch.setattr(clustering, "_compared", seen)
    x = np.random.default_rng(4).standard_normal((300, 3))
    tree = clustering.spanning_tree_by_blocks(vector_rows(spark, x), "vec_id", "embedding", np.arange(len(x)), 5)
    assert np.allclose(tree[:, 2], clustering.spanning_tree(clustering.mutual_reachability(x, 5))[:, 2], atol=1e-6)
    assert all("Exchange" not in plan and "CartesianProduct" in plan for plan in plans)
    assert asked[:2] == [300, 300] and sum(asked[2:]) < 300


@pytest.mark.parametrize(
    "kept,block,slab,scale,offset", [(16, 4 << 20, 32 << 20, 1, 0), (3, 1500, 2000, 1, 0), (1, 1500, 2000, 1, 1e7), (3, 1500, 2000, 1e-15, 0), (3, 1500, 2000, 1e20, 0)]
)
def test_edges_are_the_same_in_any_blocks(spark, monkeypatch, kept, block, slab, scale, offset):
    """As by all pairs in order of distance and places, with many equal vectors, far from zero, minute and huge ones."""
    r = np.random.default_rng(6)
    x = (np.vstack([r.standard_normal((60, 5)), np.ones((25, 5)), r.standard_normal((40, 5)) * 0.01 + 4, np.zeros((12, 5))]) + offset) * scale
    for name, value in (("KEPT", kept), ("BLOCK_BYTES", block), ("SLAB_BYTES", slab), ("LEAST_ROWS", 16), ("PAIRS", 100)):
        monkeypatch.setattr(clustering, name, value)
    n, d = len(x), np.sqrt(((x[:, None] - x[None, :]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, 4]
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    a, b = np.triu_indices(n, 1)
    parent, wanted = list(range(n)), set()
    for e in np.lexsort((a * n + b, reach[a, b])):
        i, j = parent[a[e]], parent[b[e]]
        if i != j:
            parent = [i if p == j else p for p in parent]
            wanted.add((a[e], b[e], reach[a[e], b[e]]))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    tree = clustering.spanning_tree_by_blocks(df, "vec_id", "embedding", np.arange(n), 5)
    assert {tuple(e) for e in tree} == wanted
