"""Sentence boundaries learned from the corpus itself, without labels, after Kiss and Strunk (2006).

A full stop after an abbreviation, an initial or a number need not end a sentence. Which words are abbreviations shows in
how they keep company with full stops, which words begin sentences in how they follow certain ends, and which pairs belong
together in how often they meet; each is a ratio of log-likelihoods of counts over all texts of a language. All counts
come from one written table of neighbours, aggregated before it moves.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.functions import text as T
from docstrata.sources.shared import materialise, owning

#: Least scores of abbreviations, of words that begin sentences, of pairs; times that a pair must occur.
ABBREVIATION, STARTER, COLLOCATION, PAIR_TIMES = 0.3, 30.0, 7.88, 2
#: Rows of a learned table in one bucket, on average.
BUCKET_ROWS = 4
CORE = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.!?]+$"

#: All that ``core`` leaves of a text's tokens, but empty ones, in one pass: from a first letter or digit to the token's last one or its last end mark.
CORES = rf"[\p{{L}}\p{{N}}](?:{T.NON_BLANK}*[\p{{L}}\p{{N}}.!?])?"
#: The last word, from the end backwards; a search for a word at the end would try every letter before it.
LAST = f"(?s)^(?:.*{T.BLANK})?({T.NON_BLANK}+)$"


def core(token: Column) -> Column:
    """A token without signs before it, and without signs but end marks after it."""
    return F.regexp_replace(token, CORE, "")


def word_of(found: Column) -> Column:
    """The lower-cased word of a core, without end marks."""
    return F.lower(F.rtrim(found, F.lit(".!?")))


def neighbours_of(texts: DataFrame, lang: str, text: str) -> DataFrame:
    """``lang, before, word, dot, capital, inside, n``: words of all texts, counted. ``before``: the word before if it ends with
    a full stop; ``inside``: whether the word before ends without a mark; ``dot``: whether the word itself ends with a stop."""
    told = F.regexp_extract_all(F.col(text), F.lit(CORES), F.lit(0))
    rows = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(F.array(told)).alias("told")).where(F.size("told") > 0)
    earlier = F.concat(F.slice("told", F.lit(1), F.lit(1)), F.slice("told", F.lit(1), F.greatest(F.size("told") - 1, F.lit(0))))
    pairs = rows.select("lang", F.posexplode(F.arrays_zip(earlier.alias("p"), F.col("told").alias("t"))).alias("at", "z"))
    first, p, c = F.col("at") == 0, F.col("z.p"), F.col("z.t")
    return pairs.groupBy(
        "lang", F.when(~first & p.endswith("."), word_of(p)).alias("before"), word_of(c).alias("word"), c.endswith(".").alias("dot"),
        c.rlike(r"^\p{Lu}").alias("capital"), (~first & ~F.right(p, F.lit(1)).isin(".", "!", "?")).alias("inside"), (~first & F.right(p, F.lit(1)).isin("!", "?")).alias("marked"),
    ).agg(F.count("*").alias("n"))


def _times(n: Column, p: Column) -> Column:
    """n ln p, which is 0 where n is."""
    return F.when(n == 0, F.lit(0.0)).otherwise(n * F.log(p))


def association(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio that ``b`` of ``n`` words come as often after the ``a`` as elsewhere; ``both``: after them."""
    even, after, elsewhere = b / n, both / a, (b - both) / (n - a)
    alike = _times(both, even) + _times(a - both, 1 - even) + _times(b - both, even) + _times(n - a - b + both, 1 - even)
    apart = _times(both, after) + _times(a - both, 1 - after) + _times(b - both, elsewhere) + _times(n - a - b + both, 1 - elsewhere)
    return -2 * (alike - apart)


def learn(texts: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """``lang, kind, word, other, score``: what was learned of each language.

    ``abbreviation``: a word whose stops are part of it: it hardly occurs without one, is short, or has stops inside.
    ``starter``: a word that follows ends of sentences far more often than chance. ``collocation``: a number or an initial with
    a stop, and the word that follows it far more often than chance. ``opener``: a word that stands capitalised after an
    abbreviation or an initial, is written small elsewhere, and never has a capital inside a sentence. Null languages and
    texts are left out; empty tables give an empty result.
    """
    found = materialise(neighbours_of(texts, lang, text), "neighbours")
    dots = F.coalesce(F.sum(F.when(F.col("dot"), F.col("n"))), F.lit(0))
    types = found.groupBy("lang", "word").agg(
        F.sum("n").alias("n"), dots.alias("n_dot"), F.coalesce(F.sum(F.when(~F.col("capital"), F.col("n"))), F.lit(0)).alias("n_small"),
        F.coalesce(F.sum(F.when(F.col("capital") & F.col("inside"), F.col("n"))), F.lit(0)).alias("n_inside"),
    )
    totals = found.groupBy("lang").agg(F.sum("n").alias("all"), dots.alias("all_dot"))
    types = materialise(types.join(totals, "lang"), "types")
    share, length = F.col("all_dot") / F.col("all"), F.length(F.replace("word", F.lit("."), F.lit("")))
    bare = F.col("n") - F.col("n_dot")
    fit = -2 * (_times(F.col("n_dot"), share) + _times(bare, 1 - share) - F.col("n_dot") * F.log(F.lit(0.99)) - bare * F.log(F.lit(0.01)))
    score = fit * F.exp(-length) * (F.length("word") - length + 1) * F.pow(length, -bare)
    abbreviations = types.where((F.col("n_dot") > 0) & F.col("word").rlike(r"\p{L}") & ~F.col("word").rlike(r"^\p{L}$")).withColumn("score", score).where(F.col("score") >= ABBREVIATION)
    short = materialise(abbreviations.select("lang", F.lit("abbreviation").alias("kind"), "word", F.lit("").alias("other"), "score"), "abbreviations")

    known = short.select("lang", F.col("word").alias("before"), F.lit(True).alias("short"))
    after = found.join(known, ["lang", "before"], "left").withColumn("short", F.coalesce("short", F.lit(False)))
    open_ = F.col("before").rlike(r"^(\p{L}|\p{N}+)$")
    ends = after.where(F.col("marked") | (F.col("before").isNotNull() & ~F.col("short") & ~open_)).groupBy("lang", "word").agg(F.sum("n").alias("both"))
    n_ends = ends.groupBy("lang").agg(F.sum("both").alias("a"))
    starting = ends.join(n_ends, "lang").join(types, ["lang", "word"]).where(F.col("word").rlike(r"\p{L}") & (F.col("both") * F.col("all") > F.col("a") * F.col("n")))
    starters = starting.select("lang", F.lit("starter").alias("kind"), "word", F.lit("").alias("other"), association(F.col("a"), F.col("n"), F.col("both"), F.col("all")).alias("score"))
    starters = materialise(starters.where(F.col("score") >= STARTER), "starters")

    first = types.select("lang", F.col("word").alias("before"), F.col("n_dot").alias("a"))
    pairs = after.where(open_).groupBy("lang", "before", "word").agg(F.sum("n").alias("both")).where(F.col("both") >= PAIR_TIMES)
    met = pairs.join(first, ["lang", "before"]).join(types, ["lang", "word"]).where(F.col("both") * F.col("all") > F.col("a") * F.col("n"))
    met = met.join(starters.select("lang", "word"), ["lang", "word"], "left_anti")
    collocations = met.select(
        "lang", F.lit("collocation").alias("kind"), F.col("before").alias("word"), F.col("word").alias("other"), association(F.col("a"), F.col("n"), F.col("both"), F.col("all")).alias("score")
    ).where(F.col("score") >= COLLOCATION)
    followers = after.where(F.col("capital") & (F.col("short") | F.col("before").rlike(r"^\p{L}$"))).select("lang", "word").distinct()
    opening = followers.join(types, ["lang", "word"]).where((F.col("n_small") > 0) & (F.col("n_inside") == 0))
    openers = opening.select("lang", F.lit("opener").alias("kind"), "word", F.lit("").alias("other"), F.col("n_small").cast("double").alias("score"))
    return owning(short.unionByName(starters).unionByName(collocations).unionByName(openers), found, types, short, starters)


class Boundaries:
    """A learned table as column functions. Its rows go into the plan as one literal, however many they are: a text for each
    bucket by hash, so that a look-up reads one short text, and neither the plan nor its tasks have an expression for each row."""

    def __init__(self, learned: DataFrame):
        keys = learned.select(_key(F.col("kind"), _escaped(F.col("lang")), F.col("word"), F.col("other")).alias("key")).toArrow()["key"].to_pylist()
        self.n = -(-len(keys) // BUCKET_ROWS)
        buckets = [""] * self.n
        for key in keys:
            buckets[zlib.crc32(key.encode()) % self.n] += key
        self.packed = "\t".join(buckets)

    def _is(self, kind: str, known: Column, lang: Column, word: Column, other: Column | None = None) -> Column:
        """Whether the buckets hold a row; ``lang`` as from ``_escaped``."""
        if not self.n:
            return F.lit(False)
        asked = lambda key: F.get(known, F.pmod(F.crc32(key), F.lit(self.n)).cast("int")).contains(key)
        return F.coalesce(let(_key(F.lit(kind), lang, word, F.lit("") if other is None else other), asked), F.lit(False))

    def goes_on(self, piece: Column, after: Column, known: Column, lang: Column) -> Column:
        """Whether a piece of text that ends with a mark goes on in the piece after it; both as from ``_told``. ``known``: the buckets."""
        word, other, first = piece["word"], after["other"], after["first"]
        small, capital = first.rlike(r"^\p{Ll}"), first.rlike(r"^\p{Lu}")
        begins = capital & (self._is("starter", known, lang, other) | self._is("opener", known, lang, other))
        initial, number = word.rlike(r"^\p{L}$"), word.rlike(r"^\p{N}+$")
        short = self._is("abbreviation", known, lang, word) & ~begins
        name = initial & capital & ~begins
        together = (initial | number) & (small | self._is("collocation", known, lang, word, other))
        return piece["dot"] & (short | name | together)

    def sentences(self, text: Column, language: Column) -> Column:
        """Sentences as by ``text.sentences``, joined by a blank where a stop does not end one."""

        def parted(told: Column, known: Column, lang: Column) -> Column:
            after = F.slice(told, F.lit(2), F.greatest(F.size(told) - 1, F.lit(0)))
            sign = lambda a, b: F.concat(a["piece"], F.when(b.isNull(), F.lit("")).when(self.goes_on(a, b, known, lang), F.lit(" ")).otherwise(F.lit(T.MARK)))
            return F.split(F.array_join(F.zip_with(told, after, sign), ""), T.MARK)

        known = F.split(F.lit(self.packed), "\t")
        judged = lambda found: let(F.transform(found, _told), lambda told: let(known, lambda k: let(_escaped(language), lambda lang: parted(told, k, lang))))
        return let(T.sentences(text, language), lambda found: F.when(F.size(found) > 1, judged(found)).otherwise(found))


def _escaped(lang: Column) -> Column:
    """A language without the blanks that part rows and buckets, and still told from any other."""
    return F.replace(F.replace(F.replace(lang, F.lit("\\"), F.lit(r"\\")), F.lit("\n"), F.lit(r"\n")), F.lit("\t"), F.lit(r"\t"))


def _key(kind: Column, lang: Column, word: Column, other: Column) -> Column:
    """A learned row as text between line ends; words hold no blanks, so rows differ where their texts do."""
    return F.concat(F.lit("\n"), F.concat_ws(" ", kind, lang, word, other), F.lit("\n"))


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once: a plain column would be put in wherever ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _told(piece: Column) -> Column:
    """A piece with its last word, whether that has a stop, and the core and the word that it begins with."""
    last = core(F.regexp_extract(piece, LAST, 1))
    first = core(F.regexp_extract(piece, f"^({T.NON_BLANK}+)", 1))
    ends = lambda c: F.struct(c.endswith(".").alias("dot"), word_of(c).alias("word"))
    begins = lambda c: F.struct(c.alias("first"), word_of(c).alias("other"))
    whole = lambda e, b: F.struct(piece.alias("piece"), e["dot"].alias("dot"), e["word"].alias("word"), b["first"].alias("first"), b["other"].alias("other"))
    return let(let(last, ends), lambda e: let(let(first, begins), lambda b: whole(e, b)))
