"""Column functions on text: all stay within the JVM and apply to batch and streaming frames alike."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from docstrata import config
from docstrata.config import Settings

#: Blanks as Unicode sees them, written so that Java and RE2 read the pattern alike.
BLANK = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NON_BLANK = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
MARK = "\u0001"


def n_words(text: Column) -> Column:
    """Words parted by Unicode blanks."""
    return F.regexp_count(text, F.lit(NON_BLANK + "+"))


def is_blank(text: Column) -> Column:
    """Empty, or blanks only."""
    return ~text.rlike(NON_BLANK)


def keep_hyphens(text: Column) -> Column:
    """``- `` becomes ``-``."""
    return F.replace(text, F.lit("- "), F.lit("-"))


def drop_urls(text: Column) -> Column:
    return F.regexp_replace(text, rf"http{NON_BLANK}+", "")


def drop_emails(text: Column) -> Column:
    return F.regexp_replace(text, rf"{NON_BLANK}+@{NON_BLANK}+(?:\.{NON_BLANK}+)+", "")


def drop_enumeration(text: Column) -> Column:
    """Without one leading enumeration mark of two characters."""
    return F.when(F.left(text, F.lit(2)).isin(*config.ENUMERATION_MARKS), F.substring(text, 3, 2147483647)).otherwise(text)


def is_caption(text: Column) -> Column:
    """Opens like a table, annex or figure; a leading blank defeats it."""
    return F.lower(F.left(text, F.lit(5))).isin(*config.CAPTIONS_5) | (F.lower(F.left(text, F.lit(6))) == config.CAPTION_6)


def drop_links(text: Column) -> Column:
    """Hyphens, urls and e-mail addresses, in this order. Only texts with the letters that an address must have are searched; the
    steps before add none of them."""
    whole = F.when(text.contains("http"), drop_urls(keep_hyphens(text))).otherwise(keep_hyphens(text))
    return F.when(text.contains("@"), drop_emails(whole)).otherwise(whole)


def clean(text: Column) -> Column:
    """Hyphens, urls, e-mail addresses and enumeration marks, in this order."""
    return drop_enumeration(drop_links(text))


def sentences(text: Column, language: Column | None = None) -> Column:
    """Sentences by rule: a blank after ``. ! ?`` ends one, except after ``e.g.`` and ``i.e.``. Arabic text is also cut at
    every full stop, which is dropped. Empty sentences are dropped."""
    marked = F.regexp_replace(text, rf"([.!?]){BLANK}+", "$1" + MARK)
    whole = F.split(F.regexp_replace(marked, rf"(e\.g\.|i\.e\.){MARK}", "$1 "), MARK)
    if language is not None:
        whole = F.when(language == "ar", F.split(F.replace(marked, F.lit(MARK), F.lit(".")), r"\.")).otherwise(whole)
    return F.filter(whole, lambda s: s != "")


def digit_ratio(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Nd}")) / F.length(text)


def capital_ratio(text: Column) -> Column:
    """ASCII capitals only."""
    return F.regexp_count(text, F.lit("[A-Z]")) / F.length(text)


def fit_sentences(found: Column, s: Settings = Settings()) -> Column:
    """Sentences with few digits and capitals, and neither too short nor too long."""
    return F.filter(
        found,
        lambda x: (digit_ratio(x) < s.max_digit_ratio) & (capital_ratio(x) < s.max_capital_ratio) & (F.length(x) >= s.sentence_min_characters)
        & (n_words(x) >= s.sentence_min_words) & (n_words(x) < s.sentence_max_words),
    )


def total_words(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda n, x: n + n_words(x))


def pack(found: Column, s: Settings = Settings(), drop_empty: bool = False) -> Column:
    """Sentences of a long paragraph packed greedily into chunks of fewer than ``split_words`` words.

    A last sentence without end mark is dropped, and if the rest then fits it is one chunk. A first sentence that is too
    long alone leaves an empty chunk before it; ``drop_empty`` removes it.
    """
    whole = F.right(F.element_at(found, -1), F.lit(1)).isin(".", "?", "!")
    rest = F.when(whole, found).otherwise(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        full = acc["n"] + n_words(x) >= s.split_words
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["cur"] == ""), x).otherwise(F.concat(acc["cur"], F.lit(" "), x)).alias("cur"),
            F.when(full, n_words(x)).otherwise(acc["n"] + n_words(x)).alias("n"),
        )

    packed = F.aggregate(rest, start, step, lambda acc: F.concat(acc["done"], F.array(acc["cur"])))
    chunks = F.when(~whole & (total_words(rest) <= s.split_words), F.array(F.array_join(rest, " "))).otherwise(packed)
    return F.filter(chunks, lambda c: c != "") if drop_empty else chunks


def is_contents_heading(text: Column) -> Column:
    return F.lower(text).isin(*config.CONTENTS_HEADINGS)


def is_references_heading(text: Column, fix_russian: bool = False) -> Column:
    extra = [config.REFERENCES_HEADING_RU.lower()] if fix_russian else []
    return F.lower(text).isin(*config.REFERENCES_HEADINGS, *extra)


def may_vote(text: Column, s: Settings = Settings()) -> Column:
    """Whether a text block may vote on its document's language."""
    return (F.length(text) > s.block_min_characters) & (n_words(text) > s.block_min_words) & text.rlike("[a-zA-Z]") & ~text.contains("http")


def name_has(name: Column, words: tuple[str, ...] = config.NAME_BLACKLIST) -> Column:
    """Whether the lower-cased name contains one of the words, taken as they are."""
    return reduce(lambda a, b: a | b, [F.lower(name).contains(w) for w in words], F.lit(False))


def split_list(text: Column) -> Column:
    return F.split(text, ";")


def join_list(values: Column) -> Column:
    return F.array_join(values, ";")


_ITEM = r"""'(?:[^'\\]|\\[\s\S])*'|"(?:[^"\\]|\\[\s\S])*"|None"""
_LIST = rf"^\s*\[\s*(?:(?:{_ITEM})\s*(?:,\s*(?:{_ITEM})\s*)*(?:,\s*)?)?\]\s*$"


def parse_list_literal(text: Column) -> Column:
    """A bracketed list of quoted strings as an array; ``None`` within it is null. Null stays null, anything else is an error.
    Nothing is evaluated: quotes are taken off, and a backslash before a quote, a backslash, ``n`` or ``t`` is read."""

    def value(item: Column) -> Column:
        inner = F.regexp_replace(F.substring(item, F.lit(2), F.length(item) - 2), r"\\\\", "\x00")
        for mark, by in ((r"\\n", "\n"), (r"\\t", "\t"), (r"\\(['\"])", "$1"), ("\x00", r"\\")):
            inner = F.regexp_replace(inner, mark, by)
        return F.when(item != "None", inner)

    fault = F.raise_error(F.concat(F.lit("not a bracketed list of strings: "), text))
    return F.when(text.isNull() | text.rlike(_LIST), F.transform(F.regexp_extract_all(text, F.lit(_ITEM), F.lit(0)), value)).otherwise(fault)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(name: Column) -> Column:
    """Up to the first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))


def document_path(md5: Column, folder: str, kind: str = "pdfs") -> Column:
    """Where a document's file of a kind (``pdfs`` or ``docs``) is, from its key."""
    return F.concat(F.lit(f"{folder.rstrip('/')}/{kind}/"), md5, F.lit(".pdf" if kind == "pdfs" else ".parquet"))


def mapped(code: Column, table: dict[str, str], default: str) -> Column:
    """A code looked up in a small literal map."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[code], F.lit(default))


def strict_bool(text: Column) -> Column:
    """``True`` and ``False`` only."""
    return F.when(text == "True", F.lit(True)).when(text == "False", F.lit(False)).otherwise(F.raise_error(F.concat(F.lit("not True or False: "), text)).cast("boolean"))


def resized(width: Column, height: Column, s: Settings = Settings()) -> tuple[Column, Column]:
    """Width and height of an image shrunk to the largest width, cut to integers."""
    factor = F.least(F.lit(1.0), F.lit(float(s.max_image_width)) / width)
    return (factor * width).cast("int"), (factor * height).cast("int")


def tokens(text: Column) -> Column:
    """Lower-case words of two or more word characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(words: Column) -> Column:
    """Words, then pairs of neighbours joined by a blank."""
    return F.concat(words, F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b)))


def windows(words: Column, s: Settings = Settings()) -> Column:
    """Windows of ``window`` words every ``stride``; full ones only, or the whole if it is shorter."""
    n = F.size(words)
    last = F.greatest(n - s.window, F.lit(0))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last, F.lit(s.stride)), lambda i: F.slice(words, i + 1, F.lit(s.window)))).otherwise(F.array().cast("array<array<string>>"))
