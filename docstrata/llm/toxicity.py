"""Toxicity of text after noisy-channel deobfuscation.

A character trigram model is counted over all texts. Tokens that may be disguised (digits or signs for letters, letters
spread by blanks or marks, letters repeated) become lattices of what each character may stand for, with a cost for each
reading; Viterbi finds the likeliest reading under the model. The restored words are then scored by a logistic
regression on words and word beginnings, learned from labelled rows. A token that only admits one reading is that
reading; a plain word with doubled letters counts as it stands and as it is decoded. Neighbouring fragments of a few
characters count as one word, too, where the model finds that likelier than the blank between them.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import byte_texts, discard, held_out, materialise, slabs, bounded_batches

#: Labelled rows that the classifier learns from at most, those with the least hash of their id.
SAMPLE_ROWS = 6000
#: Words and word beginnings without any meaning that the classifier may look at, of all that the sample has.
CHANCE = 3
#: Character classes of the model: 0 break, 1-26 letters, 27 any byte of another script.
N_CLASSES = 28
CLASS_OF = np.array([0 if b < 128 and not 97 <= b <= 122 else b - 96 if b < 128 else 27 for b in range(256)], np.uint8)
#: What a digit or sign may stand for, besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Marks that may be put between letters to spread a word.
SPREADERS = " .-_*,'~/\\"
#: Cost, as a negative log-probability, of a substituted sign, of a dropped spreader, and of a squeezed repetition.
SUBSTITUTED, DROPPED, SQUEEZED = 1.0, 0.5, 0.5
#: Cost of leaving a sign or spreader as it is inside a disguised token.
KEPT = 4.0
EDGE = "".join(map(chr, range(33, 48))) + ":;<=>?[\\]^_`{|}~«»„“”‘’…"
PIECES = re.compile(r"[^\W\d_]+")
#: The signs at the edge of a token that cannot stand for a letter, and those that may but often are marks.
BARE_EDGE = "".join(c for c in EDGE if c not in LEET)
MARKS = "!|+("
RUNS = re.compile(r"(.)\1*", re.S)
REPEATED, REPEATS = re.compile(r"([^\W\d_])\1"), re.compile(r"(.)\1+", re.S)
#: Characters in a fragment of a word that a blank may have parted.
FRAGMENT = 5
#: Tokens that a worker remembers, and the characters of the longest of them: what is remembered is bounded in bytes.
MEMO_SIZE, MEMO_CHARACTERS = 30_000, 48


# --- the character model


def gram_counts(texts: Iterable[bytes]) -> np.ndarray:
    """Counts of class trigrams of the lower-cased texts, which are taken as parted by breaks."""
    texts = list(texts)
    total = np.zeros(N_CLASSES**3, np.int64)
    for a, b in slabs(map(len, texts)):
        c = CLASS_OF[np.frombuffer((b"  " + b"  ".join(texts[a:b]) + b" ").lower(), np.uint8)].astype(np.int32)
        total += np.bincount((c[:-2] * N_CLASSES + c[1:-1]) * N_CLASSES + c[2:], minlength=N_CLASSES**3)
    return total


def count_grams(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all rows: one row for each trigram and task is shuffled, at most 28**3 sums are fetched."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_CLASSES**3, np.int64)
        for batch in batches:
            total += gram_counts(byte_texts(batch, "text"))
        gram = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int32)), pa.array(total[gram])], names=["gram", "n"])

    counted = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "gram int, n long")
    total = np.zeros(N_CLASSES**3, np.int64)
    for gram, n in counted.groupBy("gram").agg(F.sum("n")).collect():
        total[gram] = n
    return total


def log_model(counts: np.ndarray) -> np.ndarray:
    """Log-probability of a class after two others, smoothed by those after one and after none."""
    n3 = counts.reshape(N_CLASSES, N_CLASSES, N_CLASSES).astype(np.float64)
    n2, n1 = n3.sum(axis=0), n3.sum(axis=(0, 1))
    p1 = (n1 + 1) / (n1.sum() + N_CLASSES)
    p2 = (n2 + 4 * p1) / (n2.sum(axis=1, keepdims=True) + 4)
    return np.log((n3 + 4 * p2) / (n3.sum(axis=2, keepdims=True) + 4)).astype(np.float32)


# --- the lattice


def _class(ch: str) -> int:
    return ord(ch) - 96 if "a" <= ch <= "z" else 27 if ch.isalpha() else 0


def lattice(token: str, lead: int = 0, trail: int = 0) -> list[list[tuple[str, float]]]:
    """For each run of a character in a lower-case token, its readings and their costs. The first ``lead`` and the last
    ``trail`` characters are signs at its edges, where those in ``MARKS`` may be breaks."""
    steps = []
    for run in RUNS.finditer(token):
        steps.append(_readings(run[1], run.end() - run.start(), run.start() < lead or run.end() > len(token) - trail))
    return steps


@lru_cache(1 << 14)
def _readings(ch: str, n: int, edge: bool) -> list[tuple[str, float]]:
    if ch.isalpha():
        return [(ch * min(n, 2), SQUEEZED * (n > 2))] + ([(ch, SQUEEZED)] if n > 1 else [])
    if ch in LEET:
        letters = [(x * m, SUBSTITUTED * n) for x in LEET[ch] for m in {1, min(n, 2)}]
        return [(ch * n, KEPT)] + letters + ([(" ", 0.0) if edge else ("", KEPT)] if ch in MARKS else [])
    return [(" ", KEPT), ("", DROPPED * n)] if ch in SPREADERS else [(" ", 0.0)]


def decode(token: str, model: np.ndarray | list[float], lead: int = 0, trail: int = 0) -> str:
    """The likeliest reading of a lower-case token. ``model``: as an array, or its values in a flat list."""
    flat = model if isinstance(model, list) else model.ravel().tolist()
    beam: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for step in [*lattice(token, lead, trail), [(" ", 0.0)]]:
        ahead: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, path) in beam.items():
            for text, cost in step:
                x, y, s = a, b, score - cost
                for ch in text:
                    c = _class(ch)
                    s += flat[(x * N_CLASSES + y) * N_CLASSES + c]
                    x, y = y, c
                if (x, y) not in ahead or s > ahead[x, y][0]:
                    ahead[x, y] = (s, (path, text))
        beam = ahead
    _, path = max(beam.values(), key=lambda v: v[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out)).rstrip(" ")


def squeezed(token: str, flat: list[float]) -> str:
    """``decode`` of a token of letters only. A repetition is followed by the same state in either reading, so that each is
    decided on its own: by the letter before it, the letter itself and the one after."""

    def reading(run: re.Match) -> str:
        c = _class(run[1])
        b = _class(token[run.start() - 1]) if run.start() else 0
        d = _class(token[run.end()]) if run.end() < len(token) else 0
        twice = flat[(b * N_CLASSES + c) * N_CLASSES + c] + flat[(c * N_CLASSES + c) * N_CLASSES + d] - SQUEEZED * (run.end() - run.start() > 2)
        return run[1] * 2 if twice >= flat[(b * N_CLASSES + c) * N_CLASSES + d] - SQUEEZED else run[1]

    return REPEATS.sub(reading, token)


NEVER, DISGUISED, ASK = N_CLASSES**2, N_CLASSES**2 + 1, 2


class FragmentCodes(dict):
    """For each token, its code as a left fragment, times 1,024, plus its code as a right one: the two classes beside the
    blank of a plain fragment, ``DISGUISED``, or ``NEVER``."""

    def left(self, t: str) -> int:
        return _class(t[-2]) * N_CLASSES + _class(t[-1]) if len(t) > 1 else _class(t)

    def right(self, t: str) -> int:
        return _class(t[0]) * N_CLASSES + (_class(t[1]) if len(t) > 1 else 0)

    def __missing__(self, token: str) -> int:
        core = token.rstrip(BARE_EDGE)
        left = right = NEVER
        if 0 < len(core) <= FRAGMENT:
            right = self.right(core) if core.isalpha() else DISGUISED
            if core == token:
                left = self.left(core) if core.isalpha() else DISGUISED
        if len(token) <= MEMO_CHARACTERS:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[token] = left << 10 | right
        return left << 10 | right


def link_table(model: np.ndarray) -> np.ndarray:
    """By the codes of a left and a right fragment: 1 where they are likelier without the blank between them, 0 where not,
    ``ASK`` where one is disguised. Beyond two characters on either side both readings are alike."""
    m, n = model, N_CLASSES
    whole = m[:, :, :, None] + m[None, :, :, :] - DROPPED
    parted = m[:, :, 0, None, None] + m[None, :, 0, :, None] + m[0][None, None, :, :]
    plain = whole > parted
    plain[0, :, :, 0] = False  # single characters
    out = np.zeros((n * n + 2, n * n + 2), np.uint8)
    out[: n * n, : n * n] = plain.reshape(n * n, n * n)
    out[DISGUISED, :] = out[:, DISGUISED] = ASK
    out[NEVER, :] = out[:, NEVER] = 0
    return out


class Restorer:
    """Turns texts into restored words; remembers what it has decoded. ``wanted``, if given: which words to return."""

    def __init__(self, model: np.ndarray, wanted: Callable[[str], bool] | None = None):
        self.flat, self.memo, self.links, self.codes, self.link_table = model.ravel().tolist(), {}, {}, FragmentCodes(), link_table(model)
        self.wanted = wanted

    def pieces(self, decoded: str) -> list[str]:
        found = PIECES.findall(decoded)
        return found if self.wanted is None else list(filter(self.wanted, found))

    def words(self, token: str) -> tuple[str, ...]:
        """The words of a lower-case token."""
        found = self.memo.get(token)
        if found is None:
            core, whole = token.strip(EDGE), token.strip(BARE_EDGE)
            plain = core.isalpha()
            words = self.pieces(core) if plain else []
            if plain and REPEATED.search(core):
                words += self.pieces(squeezed(core, self.flat))
            elif core and not plain:
                words += self.pieces(decode(core, self.flat))
            if whole != core:  # signs at the edges may stand for letters
                lead = len(whole) - len(whole.lstrip(EDGE))
                words += self.pieces(decode(whole, self.flat, lead, len(whole) - len(whole.rstrip(EDGE))))
            found = tuple(dict.fromkeys(words))
            if len(token) <= MEMO_CHARACTERS:
                if len(self.memo) >= MEMO_SIZE:
                    self.memo.clear()
                self.memo[token] = found
        return found

    def linked(self, a: str, b: str) -> bool:
        """Whether two neighbouring fragments, one of them disguised, are likelier without the blank between them; their
        likeliest readings decide."""
        if (a, b) not in self.links:
            x, y = (max(PIECES.findall(decode(t, self.flat)), key=len, default="") for t in (a, b))
            found = any(map(str.isalpha, a + b)) and x and y and self.link_table[self.codes.left(x), self.codes.right(y)]
            if len(self.links) >= MEMO_SIZE:
                self.links.clear()
            self.links[a, b] = bool(found)
        return self.links[a, b]

    def joined(self, tokens: list[str], index: np.ndarray, codes: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, str]]:
        """What runs of linked fragments are when joined, each with its text. Single characters beside each other are left
        to the lattice. Token i is ``tokens[index[i]]`` of text ``owner[i]``."""
        code = codes[index]
        found = self.link_table[code[:-1] >> 10, code[1:] & 1023] * (owner[:-1] == owner[1:])
        run, last = [], -2
        for i in np.flatnonzero(found).tolist():
            a, b = tokens[index[i]], tokens[index[i + 1]].rstrip(BARE_EDGE)
            if found[i] == ASK and (len(a) == 1 == len(b) or not self.linked(a, b)):
                continue
            if i != last + 1 or owner[i] != owner[last]:
                if run:
                    yield int(owner[last]), "".join(run)
                run = [a]
            run.append(b)
            last = i
        if run:
            yield int(owner[last]), "".join(run)

    def spread(self, tokens: list[str], index: np.ndarray, single: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, str]]:
        """Runs of three single characters or more, as the lattice reads them, each with its text."""
        on = np.flatnonzero(single[index])
        for run in np.split(on, np.flatnonzero((np.diff(on) > 1) | (np.diff(owner[on]) > 0)) + 1):
            if len(run) > 2:
                yield int(owner[run[0]]), " ".join(tokens[k][0] for k in index[run].tolist())

    def restored_texts(self, texts: list[bytes]) -> list[Counter[str]]:
        """The restored words of each text, and how often each stands there. The tokens of many texts are told apart at
        once, and each different one is restored once."""
        out: list[Counter[str]] = [Counter() for _ in texts]
        for first, last in slabs(map(len, texts)):
            lists = pc.utf8_split_whitespace(pc.utf8_lower(pa.array([t.decode("utf-8", "replace") for t in texts[first:last]], pa.large_string())))
            flat = lists.flatten().dictionary_encode()
            tokens, index = flat.dictionary.to_pylist(), flat.indices.to_numpy()
            owner = np.repeat(np.arange(first, last), pc.list_value_length(lists).to_numpy())
            words = list(map(self.words, tokens))
            at = np.flatnonzero(np.fromiter(map(bool, words), bool, len(words))[index]) if len(index) else index
            pairs, counts = np.unique(owner[at] * len(tokens) + index[at], return_counts=True)
            for pair, n in zip(pairs.tolist(), counts.tolist()):
                for word in words[pair % len(tokens)]:
                    out[pair // len(tokens)][word] += n
            if len(index) < 2:
                continue
            codes = np.fromiter(map(self.codes.__getitem__, tokens), np.int64, len(tokens))
            for text, token in self.joined(tokens, index, codes, owner):
                out[text].update(self.words(token))
            single = np.fromiter((len(t) == 1 or len(t) == 2 and t[1] in SPREADERS for t in tokens), bool, len(tokens))
            for text, spread in self.spread(tokens, index, single, owner):
                out[text].update(self.pieces(decode(spread, self.flat)))
        return out

    def restored(self, text: str) -> Counter[str]:
        return self.restored_texts([text.encode()])[0]


def features(words: Iterable[str]) -> set[str]:
    """Words, and beginnings of words of four letters or more."""
    out: set[str] = set()
    for w in words:
        out.add("=" + w)
        if len(w) > 3:
            out.update((w[:4], w[:5]))
    return out


def marking(chosen: Iterable[str]) -> Callable[[str], bool]:
    """Whether a word has one of the features that are looked at."""
    whole, starts = {f[1:] for f in chosen if f[0] == "="}, {f for f in chosen if f[0] != "="}
    return lambda w: w in whole or w[:4] in starts or w[:5] in starts


# --- the classifier


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by full-batch Adam steps."""
    base = (y.sum() + 0.5) / (len(y) + 2)
    w, bias = np.zeros(x.shape[1], np.float64), math.log(base / (1 - base))
    if not len(y) or not x.shape[1]:
        return w, bias
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        error = 1 / (1 + np.exp(-np.clip(x @ w + bias, -30, 30))) - y
        g = np.append(x.T @ error / len(y) + l2 * w, error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    return w, bias


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``y, text`` of at most ``rows`` labelled documents that are not held out, a written table. Their ids are chosen
    from the labels alone, by hash; at most ``rows`` ids are broadcast. Copies count once, so that no copied text leans on
    what is learned."""
    ids = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("_id"), "_id", "y").limit(rows)
    joined = docs.select(F.col("doc_id").alias("_d"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("_d") == F.col("_id"))
    return materialise(joined.groupBy("text").agg(F.max("y").alias("y")).select("y", "text"), "labelled")


def _feature_rows(model: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(model.value)
        for batch in batches:
            words = restorer.restored_texts(byte_texts(batch, "text"))
            counted = [[{"word": w, "n": n} for w, n in sorted(x.items())] for x in words]
            kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(features(x)) for x in words], pa.list_(pa.string())), pa.array(counted, kind)], names=["y", "features", "words"])

    return run


def leaning(a: Column, n: Column, pos: int, rows: int) -> Column:
    """Signed root of the likelihood-ratio statistic of a feature that stands in ``n`` of ``rows`` rows, ``a`` of them among
    the ``pos`` rows with label 1."""
    part = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    total, share = F.lit(float(rows)), F.lit(float(pos))
    inside = part(a) + part(n - a) + part(share - a) + part(total - share - n + a)
    g = 2 * (inside + part(total) - part(n) - part(total - n) - part(share) - part(total - share))
    return F.signum(a * total - n * share) * F.sqrt(F.greatest(g, F.lit(0.0)))


def learn(sample: DataFrame, model: Broadcast) -> tuple[dict[str, float], tuple[float, float], float]:
    """Feature weights, the weights of how many marks and how many different ones there are, and the intercept, from a
    table ``y, text`` of bounded size."""
    rows = materialise(sample.mapInArrow(_feature_rows(model), "y int, features array<string>, words array<struct<word:string,n:int>>"), "features")
    n, pos = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).head()
    counted = rows.select("y", F.explode("features").alias("f")).groupBy("f").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    # so far that of all features without any meaning CHANCE are expected to lean as much
    counted = materialise(counted.where("n > 1").withColumn("z", leaning(F.col("a"), F.col("n"), pos, n)), "leaning")
    least = NormalDist().inv_cdf(1 - CHANCE / max(2 * CHANCE, counted.count()))
    chosen = sorted(r[0] for r in counted.where(F.col("z") >= least).select("f").collect())
    discard(counted)
    place = {f: i for i, f in enumerate(chosen)}
    is_mark = lambda w: F.concat(F.lit("="), w["word"]).isin(chosen) | F.left(w["word"], F.lit(4)).isin(chosen) | F.left(w["word"], F.lit(5)).isin(chosen)
    kept = F.filter("words", is_mark) if chosen else F.slice("words", 1, 0)
    got = sorted((r[0], [(w[0], w[1]) for w in r[1]]) for r in rows.select("y", kept).collect())
    discard(rows)
    x, y = np.zeros((len(got), len(chosen) + 2)), np.array([r[0] for r in got], np.float64)
    for i, (_, found) in enumerate(got):
        x[i, [place[f] for f in features(w for w, _ in found) if f in place]] = 1
        x[i, -2:] = math.log1p(sum(k for _, k in found)), math.log1p(len(found))
    w, bias = fit_logistic(x, y)
    return dict(zip(chosen, map(float, w))), (float(w[-2]), float(w[-1])), bias


_restorers: dict[str, Restorer] = {}


def toxicity_score(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Callable[[Column], Column]:
    """Learn from a corpus and its labels; the result turns a text column into a score column, without moving a row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    model = spark.sparkContext.broadcast(log_model(count_grams(docs)))
    sample = labelled_sample(docs, labels, "toxic", sample_rows)
    weights = spark.sparkContext.broadcast(learn(sample, model))
    discard(sample)
    key = uuid.uuid4().hex

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        weight, (many, different), bias = weights.value
        if key not in _restorers:
            _restorers.clear()
            _restorers[key] = Restorer(model.value, marking(weight))
        for batch in texts:
            scores = []
            for found in _restorers[key].restored_texts(byte_texts(batch)):
                total = bias + sum(weight[f] for f in features(found) if f in weight)
                total += many * math.log1p(sum(found.values())) + different * math.log1p(len(found))
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, total)))))
            yield pa.array(scores, pa.float64())

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(score, "double").asNondeterministic()


def toxicity(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``. Other columns, whatever their names, play no part.
    ``held_out``: the fifth of the ids that nothing is learned from. Null and empty texts get the score of a text
    without any sign; a null id is scored like any other; repeated rows get equal scores; without labels, or with one
    class only, the score is the smoothed share of label 1. An empty table gives an empty result. All texts are counted
    for the character model and scored whole; only the classifier is fitted on at most ``sample_rows`` rows.
    """
    score = toxicity_score(docs, labels, sample_rows)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(F.col("text").cast("string")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
