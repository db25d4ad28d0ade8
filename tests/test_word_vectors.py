"""Word vectors against counts by hand and a whole decomposition."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docstrata.operators import topics
from docstrata.operators import word_vectors as W
from docstrata.plans.embedding import LearnedWords, embedded
from docstrata.sources.shared import materialise

SCHEMA = "doc_id long, text string, word string, weight int"


def texts():
    r = random.Random(1)
    sea, land = ["ship", "wave", "sail", "harbour", "fish"], ["tree", "field", "horse", "plough", "barn"]
    out = [" ".join(r.choice(pool) for _ in range(30)) + ", the end" for pool in (sea, land) * 40]
    return [*out, None, "", "x", "once only words here", "Ship SHIP ship"]


def frame(spark):
    return spark.createDataFrame([(i, t, "z", 1) for i, t in enumerate(texts())], SCHEMA).repartition(5)


def by_hand(reach=2, least=5):
    tokens = [[w for w in (t or "").lower().replace(",", "").split() if len(w) > 1] for t in texts()]
    counts = Counter(w for t in tokens for w in t)
    words = sorted((w for w in counts if counts[w] >= least), key=lambda w: (-counts[w], w))
    n = Counter((a, b) for t in tokens for i, a in enumerate(t) for b in t[max(0, i - reach) : i] + t[i + 1 : i + reach + 1] if a in words and b in words)
    return words, counts, n


def test_associations_and_values(spark):
    words, counts, n = by_hand()
    matrix, known = W.word_associations(frame(spark))
    assert known == [(w, counts[w]) for w in words]
    total, sums = sum(n.values()), Counter()
    for (a, _), k in n.items():
        sums[a] += k
    whole = np.zeros((len(words), len(words)))
    for (a, b), k in n.items():
        whole[words.index(a), words.index(b)] = max(0, np.log(k * total / (sums[a] * sums[b])))
    got = np.zeros_like(whole)
    for r in matrix.collect():
        got[r["i"], r["j"]] = r["ppmi"]
        assert n[words[r["i"]], words[r["j"]]] == r["n"]
    assert np.allclose(got, whole)
    values, left = W.decomposed(matrix, len(words), rank=4, extra=4)
    wanted = np.sort(np.abs(np.linalg.eigvalsh(whole)))[::-1][:4]
    assert np.allclose(values, wanted, rtol=1e-6) and np.allclose(left.T @ left, np.eye(4), atol=1e-9)
    x = np.random.default_rng(1).standard_normal((len(words), 3))
    assert np.allclose(W.times(matrix, x), whole @ x)


def test_words_that_meet_are_alike(spark):
    known = materialise(W.learn(frame(spark), rank=6), "words")
    vector = {r["word"]: np.array(r["vector"]) for r in known.collect()}
    like = lambda a, b: vector[a] @ vector[b] / np.linalg.norm(vector[a]) / np.linalg.norm(vector[b])
    assert min(like("ship", "wave"), like("tree", "barn")) > max(like("ship", "tree"), like("fish", "plough")) + 0.3
    told = {r["doc_id"]: np.array(r["embedding"]) for r in W.text_vectors(frame(spark), known, "doc_id", rank=6).collect()}
    weight = {r["word"]: r["weight"] for r in known.collect()}
    own = Counter(w.strip(",").lower() for w in texts()[0].split())
    mean = sum(n * weight[w] * vector[w] for w, n in own.items()) / sum(n * weight[w] for w, n in own.items())
    assert np.allclose(told[0], mean) and set(told) == set(range(80)) | {84}
    learned = LearnedWords(known)
    some = frame(spark).where("doc_id in (0, 82)").orderBy("doc_id").select(embedded(F.col("text"), learned, 6).alias("e")).collect()
    assert np.allclose(some[0]["e"], mean / np.linalg.norm(mean), atol=1e-6) and some[1]["e"] == [0.0] * 6
    words = spark.createDataFrame([(0, "ship"), (0, "barn"), (0, "unknown"), (1, "ship")], "topic_nr int, term string")
    means = spark.createDataFrame([(0, told[0].tolist()), (1, told[1].tolist())], "topic_nr int, mean array<double>")
    terms = W.text_vectors(words.select("term").distinct(), known, "term", text="term", rank=6).withColumnRenamed("embedding", "e")
    ranked = {(r["topic_nr"], r["term"]): r["rank"] for r in topics.reranked(words, means, terms).collect()}
    assert ranked[0, "ship"] == 1 and len(ranked) == 4


def test_nothing_to_learn_from(spark):
    for rows in (frame(spark).limit(0), frame(spark).where("text = 'x'")):
        assert W.learn(rows, rank=3).collect() == []
