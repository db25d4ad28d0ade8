"""Secret scans with patterns and character Markov models, with DataFrame operations only.

Fixed patterns find assigned values, access keys and long hexadecimal strings. Beyond them, every long run of key
characters is scored by two first-order Markov models, one of random strings and one of ordinary identifiers, both trained
here from labelled samples; a run is a secret where the log-likelihood ratio of its best stretch is high, so that a key at
the end of a long path is found.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm.common import held_out

_EITHER = lambda word: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = rf"""({"|".join(map(_EITHER, KEYWORDS))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run of these that is too short is dropped, and nothing within it is longer, so the length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
#: Runs that the models judge, and the log-likelihood ratio (in nats) of a stretch of one from which it is a secret.
RUN, LEAST_RATIO = r"[A-Za-z0-9+/_-]{20,}={0,2}", 10.0
#: The share of a character's own frequency in its probability after another one.
MIXED = 0.1
#: Characters from + to z are told apart by their codes.
FIRST, N_CODES = 43, 80
#: Random strings made for training, and labelled rows whose words make the ordinary identifiers.
RANDOM_ROWS, SAMPLE_ROWS = 4000, 500
#: Words of identifiers, so that there are some without any document; and how often each pair of them counts.
COMMON_WEIGHT = 2
WORDS = (
    "about", "above", "access", "account", "action", "active", "address", "after", "again", "agent", "amount",
    "another", "answer", "archive", "array", "attribute", "background", "balance", "before", "between", "body",
    "border", "branch", "buffer", "builder", "button", "cache", "category", "change", "channel", "chapter", "check",
    "child", "choice", "city", "class", "client", "cloud", "color", "column", "command", "company", "config",
    "connection", "content", "controller", "count", "country", "create", "current", "customer", "daily", "data",
    "date", "default", "delete", "device", "different", "display", "document", "domain", "download", "driver",
    "editor", "element", "email", "empty", "engine", "error", "event", "example", "exchange", "export", "external",
    "factory", "family", "field", "file", "filter", "first", "folder", "font", "format", "friday", "function",
    "general", "global", "group", "growth", "handler", "header", "health", "height", "history", "home", "house",
    "image", "import", "index", "info", "input", "instance", "internal", "item", "january", "journal", "july",
    "june", "keyboard", "knowledge", "label", "language", "layout", "length", "level", "library", "light", "limit",
    "list", "local", "machine", "manager", "market", "member", "message", "method", "model", "module", "month",
    "music", "name", "network", "node", "november", "number", "object", "office", "option", "order", "output",
    "package", "page", "parent", "parser", "path", "people", "photo", "picture", "player", "policy", "position",
    "price", "process", "product", "profile", "project", "property", "public", "quality", "query", "question",
    "random", "record", "region", "report", "request", "resource", "response", "result", "review", "school",
    "science", "search", "section", "server", "service", "session", "simple", "size", "source", "special", "state",
    "station", "status", "string", "student", "summary", "system", "table", "target", "template", "text", "thread",
    "title", "type", "update", "user", "value", "version", "view",
)


def random_strings(spark: SparkSession, rows: int = RANDOM_ROWS) -> DataFrame:
    """``token``: strings without structure, from digests of numbers, in the usual alphabets."""
    digest = F.unhex(F.sha2(F.concat(F.lit("random-"), F.col("id").cast("string")), 256))
    plain = F.base64(digest)
    alphabets = [F.translate(F.upper(plain), "+/=", "XYZ"), F.translate(plain, "+/=", "-_"), F.translate(plain, "+/=", "aB3")]
    return spark.range(rows).select(F.explode(F.array(plain, F.lower(F.hex(digest)), *alphabets)).alias("token"))


def ordinary_identifiers(docs: DataFrame | None, labels: DataFrame | None, spark: SparkSession, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``token, n``, the latter how often it counts: identifiers composed of common words, and of words of at most ``rows``
    labelled documents that are not held out, those with the least hash of their id."""
    common = F.split(F.lit(",".join(WORDS)), ",")
    shuffled = F.transform(common, lambda w, i: F.element_at(common, (i * (F.col("id") * 2 + 1) % len(WORDS) + 1).cast("int")))
    words = spark.range(len(WORDS)).select(shuffled.alias("words"), F.lit(COMMON_WEIGHT).alias("n"))
    if docs is not None and labels is not None:
        known = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"))
        ids = known.distinct().orderBy(F.xxhash64("_id"), "_id").limit(rows)
        own = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
        words = words.unionByName(own.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0)).alias("words"), F.lit(1).alias("n")))
    both = F.arrays_zip(F.col("words").alias("a"), F.slice("words", 2, 100_000_000).alias("b"))
    pairs = words.select("n", F.explode(both).alias("p")).where("p.b is not null")
    a, b = F.col("p.a"), F.col("p.b")
    n = F.pmod(F.xxhash64(a, b), F.lit(3000)).cast("string")
    joined = [F.concat(a, F.lit(mark), b, F.lit(mark), n) for mark in ("_", "-", "/")]
    capital = [F.concat(a, F.initcap(b), n), F.concat(F.initcap(a), F.initcap(b)), F.concat(F.upper(a), F.lit("_"), F.upper(b))]
    return pairs.select("n", F.explode(F.array(a, *joined, *capital)).alias("token"))


def learn(random: DataFrame, ordinary: DataFrame) -> list[float]:
    """For each pair of character codes, the log-ratio of its probabilities in random strings and in ordinary
    identifiers. The pairs are counted on the executors; at most 2 * 80 * 80 counts are fetched."""
    chars = F.split("token", "")
    code = lambda c: F.ascii(c) - FIRST
    steps = F.transform(F.sequence(F.lit(2), F.size("c")), lambda i: code(F.element_at("c", i - 1)) * N_CODES + code(F.element_at("c", i)))
    both = random.select("token", F.lit(1).alias("y"), F.lit(1).alias("n")).unionByName(ordinary.select("token", F.lit(0).alias("y"), "n"))
    pairs = both.where(r"token rlike '^[A-Za-z0-9+/=_-]{2,}$'").select("y", "n", chars.alias("c")).select("y", "n", F.explode(steps).alias("pair"))
    counts = [[0.0] * N_CODES**2, [0.0] * N_CODES**2]
    for y, pair, n in pairs.groupBy("y", "pair").agg(F.sum("n")).collect():
        counts[y][pair] += n

    def log_model(n: list[float]) -> list[float]:
        """Log-probability of a code after another, mixed with that of the code alone, so that a pair which was never seen
        is unlikely by no more than that mixture says; one of each code, so that none is impossible."""
        alone = [1 + sum(n[b::N_CODES]) for b in range(N_CODES)]
        whole, out = sum(alone), []
        for a in range(N_CODES):
            row = n[a * N_CODES : (a + 1) * N_CODES]
            seen = sum(row)
            mix = MIXED if seen else 1.0
            out += [math.log((1 - mix) * x / max(seen, 1) + mix * one / whole) for x, one in zip(row, alone)]
        return out

    return [r1 - r0 for r0, r1 in zip(*map(log_model, counts))]


def log_ratio(token: Column, table: list[float]) -> Column:
    """The greatest log-likelihood ratio of a stretch of a run, 0 at least: the sum over its pairs of characters starts anew
    wherever it falls below 0."""
    values = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")  # folded to a constant
    codes = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    # the state carries the code before, so a run is read once
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        gain = F.when(s["last"] < 0, F.lit(0.0)).otherwise(F.element_at(values, s["last"] * N_CODES + c + 1))
        total = F.greatest(s["sum"] + gain, F.lit(0.0))
        return F.struct(c.alias("last"), total.alias("sum"), F.greatest(s["best"], total).alias("best"))

    return F.aggregate(codes, start, step, lambda s: s["best"])


def running_sums(numbers: Column) -> Column:
    """The running sums of an array of integers. An array is only ever copied to grow by one, so it is cut into about as many
    parts as a part has numbers: n numbers cost n times the root of n steps, not n times n."""
    size = F.greatest(F.ceil(F.sqrt(F.size(numbers))).cast("int"), F.lit(1))
    n_parts = F.ceil(F.size(numbers) / size).cast("int")
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    parts = F.transform(F.sequence(F.lit(0), n_parts - 1), lambda i: F.slice(numbers, i * size + 1, size))
    whole = F.transform(parts, total)

    def within(part: Column, i: Column) -> Column:
        start = F.struct(total(F.slice(whole, F.lit(1), i)).alias("at"), F.array().cast("array<int>").alias("ends"))
        add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["ends"], F.array(s["at"] + x)).alias("ends"))
        return F.aggregate(part, start, add, lambda s: s["ends"])

    return F.when(F.size(numbers) > 0, F.flatten(F.transform(parts, within))).otherwise(F.array().cast("array<int>"))


def _spans(kind: str, matches: Column, ends: Column, keep: Column) -> Column:
    """Spans of matches, in code points, from where they end; those with a true ``keep``."""
    found = F.zip_with(matches, ends, lambda m, b: F.struct((b - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), b.alias("end")))
    return F.transform(F.filter(F.arrays_zip(found.alias("span"), keep.alias("keep")), lambda x: x["keep"]), lambda x: x["span"])


def _listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat_ws(":", F.element_at(kinds, x["kind_no"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    return F.array_join(F.transform(F.array_sort(spans), text), ",")


def scan_secrets(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans``.

    ``docs``: ``doc_id, text``; ``labels``, if given: ``doc_id`` of the documents whose words may train the model of
    ordinary identifiers. Other columns, whatever their names, play no part. Spans are in code points, end exclusive,
    and never overlap within a kind. Null and empty texts have none. Repeated rows are judged alike; an empty table
    gives an empty result. Texts are read where they lie and nothing of them is shuffled; a kind's matches are located
    only in texts that have one.
    """
    spark = docs.sparkSession
    table = learn(random_strings(spark), ordinary_identifiers(docs if labels is not None else None, labels, spark))
    patterns = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, RUN)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    none = F.array().cast("array<string>")
    lengths = lambda k, p: F.zip_with(F.slice(F.split("text", p, -1), F.lit(1), F.size(k)), F.col(k), lambda a, b: F.length(a) + F.length(b))
    located = rows.select(
        "doc_id", *KINDS, F.when(F.size("assign") > 0, F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))).otherwise(none).alias("value"),
        *[F.when(F.size(k) > 0, lengths(k, p)).otherwise(F.array().cast("array<int>")).alias(f"{k}_lengths") for k, p in patterns.items()],
    )
    # one generator for all, after which columns are plain: an expression that is used often would be worked out as often
    worked = located.select("doc_id", *KINDS, "value", F.explode(F.array(F.struct(*[f"{k}_lengths" for k in KINDS]))).alias("l"))
    ended = worked.select("doc_id", *KINDS, "value", F.explode(F.array(F.struct(*[running_sums(F.col(f"l.{k}_lengths")).alias(k) for k in KINDS]))).alias("ends"))
    keep = {k: F.transform(k, lambda _: F.lit(True)) for k in KINDS} | {
        "assign": F.transform("value", lambda v: F.length(v) >= ASSIGN_LEAST),
        "markov": F.transform("markov", lambda t: log_ratio(t, table) >= LEAST_RATIO),
    }
    spanned = ended.select("doc_id", *[_spans(k, F.col(k), F.col(f"ends.{k}"), keep[k]).alias(k) for k in KINDS])
    base = F.concat(*[F.col(k) for k in KINDS[:3]])
    return spanned.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.concat(*[F.col(k) for k in KINDS])).alias("spans"),
    )
