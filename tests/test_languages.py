"""Language identification against sums by hand, and its accuracy on texts that it was not learned from."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docstrata.operators import languages as L
from docstrata.plans import queries as Q

# As long as blocks that vote: shorter ones may fail.
SENTENCES = {
    "ar": ["تعمل الحكومات على خفض انبعاثات الغازات في المدن الكبيرة", "الماء مصدر الحياة على كوكب الأرض"],
    "de": ["Die Regierungen wollen den Ausstoß von Treibhausgasen in den Städten senken.", "Das Wasser ist die Quelle des Lebens auf der Erde."],
    "en": ["Governments are working to reduce greenhouse gas emissions in the large cities.", "Water is the source of life on this planet."],
    "es": ["Los gobiernos trabajan para reducir las emisiones de gases en las grandes ciudades.", "El agua es la fuente de la vida en este planeta, y sin ella no crecen las plantas."],
    "fr": ["Les gouvernements travaillent à réduire les émissions de gaz dans les grandes villes.", "L'eau est la source de la vie sur cette planète."],
    "ru": ["Правительства стремятся сократить выбросы парниковых газов в крупных городах.", "Вода является источником жизни на этой планете."],
}


def test_all_languages_of_the_recogniser(spark):
    rows = [(lang, s) for lang, found in SENTENCES.items() for s in found]
    nothing = [(None, None), (None, ""), (None, " 12 - .\n")]
    df = spark.createDataFrame(rows + nothing, "wanted string, text string")
    assert [r["text"] for r in df.withColumn("g", L.guess_language(F.col("text"))).collect() if r["wanted"] != r["g"]] == []


def grams(text):
    text = " " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " "
    return [text[i : i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1)]


def test_model_and_scores_by_hand(spark):
    rows = [("x", "ab abc"), ("x", "b"), ("y", "ba, ÄC"), ("y", None), (None, "zzz")]
    model = {(r["gram"], r["lang"]): r["weight"] for r in L.learn(spark.createDataFrame(rows, "lang string, text string")).collect()}
    counts = {lang: Counter(g for a, t in rows if a == lang and t for g in grams(t)) for lang in "xy"}
    every = {g for c in counts.values() for g in c}
    for lang, c in counts.items():
        for gram in every | {"#1", "#2", "#3"}:
            k = int(gram[1]) if gram[0] == "#" else len(gram)
            total = sum(n for g, n in c.items() if len(g) == k) + 0.5 * (sum(len(g) == k for g in every) + 1)
            assert model[gram, lang] == round(math.log((c[gram] + 0.5) / total) * 65536)
    assert len(model) == 2 * (len(every) + 3)
    texts = ["abc äba", "q", "ab " * 200_000, "b", "b", "bababa ca"]
    known = L.Model([(g, lang, w) for (g, lang), w in model.items()])
    plain = [" " + " ".join(t.split()) + " " for t in texts]
    for text, got in zip(texts, known.scores(plain).tolist()):
        assert got == [sum(model.get((g, lang), model[f"#{len(g)}", lang]) for g in grams(text)) for lang in "xy"]
    dense, L_DENSE = known.scores(plain).tolist(), L.DENSE
    try:
        L.DENSE = 8
        assert L.Model([(g, lang, w) for (g, lang), w in model.items()]).scores(plain).tolist() == dense
    finally:
        L.DENSE = L_DENSE
    assert L.Model([]).languages(["a"]) == [None]
    assert L.learn(spark.createDataFrame([], "lang string, text string")).collect() == []


@pytest.mark.parametrize("least, learned", [(0.99, True), (0.6, False)])
def test_held_out_documents(spark, sf, least, learned):
    d = Q.M.table(spark, sf, "documents").where("doc_id % 5 = 0 and length(text) > 64").select("lang", "text")
    guess = L.identifier(Q._language_model(spark, sf)) if learned else L.guess_language
    right = d.select((guess(F.col("text")) == F.col("lang")).cast("int").alias("r")).agg(F.avg("r")).head()[0]
    assert right >= least
