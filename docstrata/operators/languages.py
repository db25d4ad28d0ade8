"""Language identification by a naive Bayes model of character n-grams.

A text is lower-cased letters with one blank between words and at both ends. Its grams of one to three characters are counted
by language in DataFrame operations; a model is a table of weights, logarithms of smoothed shares in whole units, so that a
score is an exact integer and ties fall alike everywhere. A text is scored as it lies, in one pass over its characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest gram; units of a natural logarithm; what every count is greater by.
ORDER, UNIT, SMOOTHING = 3, 1 << 16, 0.5
#: Characters whose grams are looked up at once, entries of a table that is looked up by place, and rows to learn from.
SLICE, DENSE, SAMPLE_ROWS = 1 << 18, 1 << 24, 500

# The first six articles of the Universal Declaration of Human Rights, by language.
SEED_TEXTS = {
    "ar": (
        "يولد جميع الناس أحراراً متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميراً وعليهم أن يعامل بعضهم بعضاً بروح "
        "الإخاء. لكل إنسان حق التمتع بكافة الحقوق والحريات الواردة في هذا الإعلان، دون أي تمييز، كالتمييز بسبب العنصر أو "
        "اللون أو الجنس أو اللغة أو الدين أو الرأي السياسي أو أي رأي آخر، أو الأصل الوطني أو الاجتماعي أو الثروة أو "
        "الميلاد أو أي وضع آخر. لكل فرد الحق في الحياة والحرية وسلامة شخصه. لا يجوز استرقاق أو استعباد أي شخص، ويحظر "
        "الاسترقاق وتجارة الرقيق بكافة أوضاعهما. لا يعرض أي إنسان للتعذيب ولا للعقوبات أو المعاملات القاسية أو الوحشية أو"
        " الحاطة بالكرامة. لكل إنسان أينما وجد الحق في أن يعترف بشخصيته القانونية."
    ),
    "de": (
        "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und "
        "sollen einander im Geist der Brüderlichkeit begegnen. Jeder hat Anspruch auf die in dieser Erklärung verkündeten"
        " Rechte und Freiheiten ohne irgendeinen Unterschied, etwa nach Rasse, Hautfarbe, Geschlecht, Sprache, Religion, "
        "politischer oder sonstiger Überzeugung, nationaler oder sozialer Herkunft, Vermögen, Geburt oder sonstigem "
        "Stand. Jeder hat das Recht auf Leben, Freiheit und Sicherheit der Person. Niemand darf in Sklaverei oder "
        "Leibeigenschaft gehalten werden; Sklaverei und Sklavenhandel in allen ihren Formen sind verboten. Niemand darf "
        "der Folter oder grausamer, unmenschlicher oder erniedrigender Behandlung oder Strafe unterworfen werden. Jeder "
        "hat das Recht, überall als rechtsfähig anerkannt zu werden."
    ),
    "en": (
        "All human beings are born free and equal in dignity and rights. They are endowed with reason and conscience and "
        "should act towards one another in a spirit of brotherhood. Everyone is entitled to all the rights and freedoms "
        "set forth in this Declaration, without distinction of any kind, such as race, colour, sex, language, religion, "
        "political or other opinion, national or social origin, property, birth or other status. Everyone has the right "
        "to life, liberty and security of person. No one shall be held in slavery or servitude; slavery and the slave "
        "trade shall be prohibited in all their forms. No one shall be subjected to torture or to cruel, inhuman or "
        "degrading treatment or punishment. Everyone has the right to recognition everywhere as a person before the law."
    ),
    "es": (
        "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y "
        "conciencia, deben comportarse fraternalmente los unos con los otros. Toda persona tiene todos los derechos y "
        "libertades proclamados en esta Declaración, sin distinción alguna de raza, color, sexo, idioma, religión, "
        "opinión política o de cualquier otra índole, origen nacional o social, posición económica, nacimiento o "
        "cualquier otra condición. Todo individuo tiene derecho a la vida, a la libertad y a la seguridad de su persona. "
        "Nadie estará sometido a esclavitud ni a servidumbre; la esclavitud y la trata de esclavos están prohibidas en "
        "todas sus formas. Nadie será sometido a torturas ni a penas o tratos crueles, inhumanos o degradantes. Todo ser "
        "humano tiene derecho, en todas partes, al reconocimiento de su personalidad jurídica."
    ),
    "fr": (
        "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de "
        "conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Chacun peut se prévaloir de "
        "tous les droits et de toutes les libertés proclamés dans la présente Déclaration, sans distinction aucune, "
        "notamment de race, de couleur, de sexe, de langue, de religion, d'opinion politique ou de toute autre opinion, "
        "d'origine nationale ou sociale, de fortune, de naissance ou de toute autre situation. Tout individu a droit à la"
        " vie, à la liberté et à la sûreté de sa personne. Nul ne sera tenu en esclavage ni en servitude; l'esclavage et "
        "la traite des esclaves sont interdits sous toutes leurs formes. Nul ne sera soumis à la torture, ni à des peines"
        " ou traitements cruels, inhumains ou dégradants. Chacun a le droit à la reconnaissance en tous lieux de sa "
        "personnalité juridique."
    ),
    "ru": (
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны "
        "поступать в отношении друг друга в духе братства. Каждый человек должен обладать всеми правами и всеми "
        "свободами, провозглашенными настоящей Декларацией, без какого бы то ни было различия, как-то в отношении расы, "
        "цвета кожи, пола, языка, религии, политических или иных убеждений, национального или социального происхождения, "
        "имущественного, сословного или иного положения. Каждый человек имеет право на жизнь, на свободу и на личную "
        "неприкосновенность. Никто не должен содержаться в рабстве или в подневольном состоянии; рабство и работорговля "
        "запрещаются во всех их видах. Никто не должен подвергаться пыткам или жестоким, бесчеловечным или унижающим его "
        "достоинство обращению и наказанию. Каждый человек, где бы он ни находился, имеет право на признание его "
        "правосубъектности."
    ),
}


def letters(text: Column) -> Column:
    """Lower-cased words of letters with a blank before, between and after them."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), F.lit(" "))


def grams(text: Column) -> Column:
    """All grams of one to ORDER characters of ``letters``."""
    chars = F.split(letters(text), "")
    n = F.size(chars)
    shifted = lambda k: F.slice(chars, F.lit(k + 1), F.greatest(n - k, F.lit(0)))
    found = [chars]
    for k in range(1, ORDER):
        found.append(F.zip_with(F.slice(found[-1], F.lit(1), F.greatest(n - k, F.lit(0))), shifted(k), lambda a, b: F.concat(a, b)))
    return F.concat(*found)


def learn(labelled: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``gram, lang, weight``: for each language the weight of each gram that any language has, and of one that none has
    (``#1`` to ``#3``, by length). Rows without language or text are left out; the languages are few, and their totals known
    to the driver."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.explode(grams(F.col(text))).alias("gram"))
    counts = rows.groupBy("gram", "lang").agg(F.count("*").alias("n"))
    told = counts.groupBy("lang", F.length("gram").alias("k")).agg(F.sum("n").alias("n")).collect()
    totals, langs = {(r["lang"], r["k"]): r["n"] for r in told}, sorted({r["lang"] for r in told})
    if not langs:
        return labelled.sparkSession.createDataFrame([], "gram string, lang string, weight long")
    per_gram = counts.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)])
    kinds = {r["k"]: r["count"] for r in per_gram.groupBy(F.length("gram").alias("k")).count().collect()}
    none = per_gram.sparkSession.createDataFrame([(f"#{k}", *[0] * len(langs)) for k in kinds], per_gram.schema)
    k = F.when(F.col("gram").startswith("#"), F.substring("gram", 2, 1).cast("int")).otherwise(F.length("gram"))

    def weight(i: int, x: str) -> Column:
        total = F.lit(None)
        for n in kinds:
            total = F.when(k == n, F.lit(totals.get((x, n), 0) + SMOOTHING * (kinds[n] + 1))).otherwise(total)
        return F.round(F.log((F.col(f"n{i}") + SMOOTHING) / total) * UNIT).cast("long")

    each = F.explode(F.array(*[F.struct(F.lit(x).alias("lang"), weight(i, x).alias("weight")) for i, x in enumerate(langs)]))
    return per_gram.unionByName(none).select("gram", each.alias("e")).select("gram", "e.lang", "e.weight")


class Model:
    """Weights of a learned table, for scoring: as many as the distinct grams of the texts that it was learned from."""

    def __init__(self, rows: list[tuple[str, str, int]]):
        self.langs = sorted({lang for _, lang, _ in rows})
        weights: dict[str, list[int]] = {}
        for gram, lang, weight in rows:
            weights.setdefault(gram, [0] * len(self.langs))[self.langs.index(lang)] = weight
        known = [g for g in weights if not g.startswith("#")]
        chars = sorted({c for g in known for c in g})
        self.size = len(chars) + 2  # 0 parts texts, 1 is a letter that no gram has
        self.codes = np.ones(0x110000, np.uint16 if self.size < 1 << 16 else np.uint32)
        self.codes[[ord(c) for c in chars]] = np.arange(2, self.size)
        self.codes[ord("\n")] = 0
        self.tables = []
        for k in range(1, ORDER + 1):
            own = sorted((self._key([int(self.codes[ord(c)]) for c in g]), g) for g in known if len(g) == k)
            keys = np.array([a for a, _ in own], np.int64)
            values = np.array([[0] * len(self.langs), weights.get(f"#{k}", [0] * len(self.langs)), *[weights[g] for _, g in own]], np.int32)
            place = None
            if self.size**k <= DENSE:
                place = np.ones(self.size**k, np.int32)
                place[keys] = np.arange(2, len(keys) + 2)
            self.tables.append((keys, values, place))

    def _key(self, codes: list[int]) -> int:
        out = 0
        for c in codes:
            out = out * self.size + c
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Summed weights by text and language; ``texts``: as from ``letters``."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        codes = self.codes[np.frombuffer(("\n".join(texts) + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32)]
        out = np.zeros((len(texts), len(self.langs)), np.int64)
        for a in range(0, int(ends[-1]), SLICE):
            n = min(SLICE, int(ends[-1]) - a)
            owner = np.searchsorted(ends, np.arange(a, a + n), side="right")
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            key, wall = np.zeros(n, np.int64), np.zeros(n, bool)
            for k, (keys, values, place) in enumerate(self.tables):
                code = codes[a + k : a + k + n]
                key, wall = key * self.size + code, wall | (code == 0)
                if place is not None:
                    at = place[key]
                else:
                    near = np.searchsorted(keys, key)
                    at = np.where((near < len(keys)) & (keys[np.minimum(near, len(keys) - 1)] == key), near + 2, 1)
                at[wall] = 0
                out[owner[starts]] += np.add.reduceat(values[at], starts, axis=0, dtype=np.int64)
        return out

    def languages(self, texts: list[str | None]) -> list[str | None]:
        """The language with the greatest score, of equals the first by code; null without letters."""
        some = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip(" ")]
        out: list[str | None] = [None] * len(texts)
        if some and self.langs:
            for i, best in zip(some, self.scores([texts[i] for i in some]).argmax(axis=1)):
                out[i] = self.langs[best]
        return out


def identifier(model: DataFrame) -> Callable[[Column], Column]:
    """A column function that names the language of a text by a learned table, which the driver reads and sends to workers."""
    known = Model([tuple(r) for r in model.select("gram", "lang", "weight").collect()])

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(known.languages(list(texts)), dtype=object)

    return lambda text: run(letters(text))


@cache
def _seeded(spark: SparkSession) -> Callable[[Column], Column]:
    return identifier(learn(spark.createDataFrame(list(SEED_TEXTS.items()), "lang string, text string")))


def guess_language(text: Column) -> Column:
    """The language of a text by the model of SEED_TEXTS: Arabic, English, French, German, Russian or Spanish."""
    return _seeded(SparkSession.active())(text)


def labelled_sample(rows: DataFrame, key: str, n: int = SAMPLE_ROWS) -> DataFrame:
    """The first ``n`` rows by a digest of their key, for learning, dealt over all cores."""
    first = rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)
    return first.repartition(rows.sparkSession.sparkContext.defaultParallelism)
