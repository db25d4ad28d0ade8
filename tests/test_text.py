"""Hand-worked cases of the column functions."""

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as T


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).head()[0]


@pytest.mark.parametrize(
    "function, before, after",
    [
        (T.keep_hyphens, "cli- mate", "cli-mate"), (T.drop_urls, "see http://a.b/c now", "see  now"), (T.drop_emails, "x me@a.org y", "x  y"), (T.drop_urls, "see http://a.b now", "see  now"),
        (T.drop_enumeration, "* item", "item"), (T.drop_enumeration, '"*item', "item"), (T.drop_enumeration, "- item", "- item"), (T.drop_enumeration, "* * item", "* item"),
        (T.is_caption, "Tableau 1", True), (T.is_caption, " Table 1", False), (T.is_caption, "FIGURE 2", True), (T.is_caption, "Figur", False), (T.n_words, " a b  c ", 3), (T.n_words, "", 0), (T.is_blank, "  \t", True),
        (T.capital_ratio, "ÉÉÉ", 0.0), (T.digit_ratio, "123456789٣", 1.0), (T.is_contents_heading, "Table of Contents", True), (T.is_references_heading, "Рекомендации", False),
        (lambda c: T.is_references_heading(c, True), "Рекомендации", True), (T.name_has, "Cover Letter X", True), (T.name_has, "Letter", False), (T.stem, "a.b.pdf", "a"), (T.base_name, "x/y/a.pdf", "a.pdf"), (T.strict_bool, "False", False),
    ],
)
def test_scalars(spark, function, before, after):
    assert one(spark, before, function) == after


def test_errors(spark):
    for function, bad in ((T.strict_bool, "true"), (T.parse_list_literal, "os.getcwd()")):
        with pytest.raises(Exception, match="not "):
            one(spark, bad, function)
    assert one(spark, "['a', 'b']", T.parse_list_literal) == ["a", "b"]


def test_sentences(spark):
    assert one(spark, "Use coal, e.g. lignite here. Next one.", T.sentences) == ["Use coal, e.g. lignite here.", "Next one."]
    assert one(spark, "One. ", T.sentences) == ["One."]
    assert one(spark, "", T.sentences) == []
    assert one(spark, "a b. c d.e", lambda c: T.sentences(c, F.lit("ar"))) == ["a b", "c d", "e"]


def words(n, end="."):
    return " ".join(["word"] * n) + end


@pytest.mark.parametrize(
    "sizes, last, expected",
    [((60, 50, 30), ".", [60, 80]), ((50, 50), ".", [50, 50]), ((120, 10), ".", [0, 120, 10]), ((60, 30, 40), "", [90]), ((60, 60, 40), "", [60, 60])],
)
def test_packing(spark, sizes, last, expected):
    found = [words(n) for n in sizes[:-1]] + [words(sizes[-1], last)]
    chunks = one(spark, found, T.pack, "array<string>")
    assert [len(c.split()) for c in chunks] == expected
    assert [len(c.split()) for c in one(spark, found, lambda c: T.pack(c, drop_empty=True), "array<string>")] == [n for n in expected if n]


def test_fit_sentences(spark):
    ok = "eight words that are long enough to stay"
    many = " ".join(["word"] * 256)
    assert one(spark, [ok, "a b c d e f g", "12345 " + ok, "ABCDEFGHIJKL " + ok, many], T.fit_sentences, "array<string>") == [ok]


def test_ngrams_and_windows(spark):
    assert one(spark, "A bb ccc dd", lambda c: T.ngrams(T.tokens(c))) == ["bb", "ccc", "dd", "bb ccc", "ccc dd"]
    assert one(spark, "bb", lambda c: T.ngrams(T.tokens(c))) == ["bb"] and one(spark, "", lambda c: T.ngrams(T.tokens(c))) == []
    assert one(spark, [str(i) for i in range(8)], T.windows, "array<string>") == [["0", "1", "2", "3", "4"], ["2", "3", "4", "5", "6"]]
    assert one(spark, ["a", "b"], T.windows, "array<string>") == [["a", "b"]] and one(spark, [], T.windows, "array<string>") == []
