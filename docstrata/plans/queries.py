"""Queries over the shared tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import config
from docstrata.config import Settings
from docstrata.functions import text as T
from docstrata.operators import boundaries, catalogue, clustering, languages, layout, pages, paragraphs, topics, vectors, word_vectors
from docstrata.operators.neighbours import neighbours
from docstrata.plans import tables as M
from docstrata.plans.embedding import DIM, HashedNgrams, embedded
from docstrata.sources.shared import discard, materialise, owning
from docstrata.sources.sinks import numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
S = Settings()
NB = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
BL = r"[\t-\r\x1c-\x20\x85\p{Z}]"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '{NB}+'))"


def _quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# --- catalogue


@query(f"WITH {M.OVERVIEW} SELECT doc_id, name, md5_sum, source_url, author, types, language, CAST(len(string_split(author, ';')) AS BIGINT) AS n_authors FROM overview")
def overview_multivalue_roundtrip(spark, sf):
    split = catalogue.from_overview(M.overview(spark, sf)).withColumn("n_authors", F.size("author").cast("long"))
    return catalogue.to_overview(split)


@query("SELECT doc_id, source AS author_1, CAST(2 AS BIGINT) AS n_authors, lang AS type_1, md5(text) AS md5_sum FROM documents")
def textdf_list_literal_parse(spark, sf):
    d = M.table(spark, sf, "documents")
    literal = lambda *c: F.concat(F.lit("['"), F.concat_ws("', '", *c), F.lit("']"))
    raw = d.select(
        literal("source", "lang").alias("author"), literal("lang").alias("types"), F.col("doc_id").alias("document_id"), F.md5(F.col("text").cast("binary")).alias("document_md5_sum"),
        *[F.lit("").alias(c) for c in config.TEXTDF_COLUMNS if c not in ("author", "types", "document_id", "document_md5_sum")],
    )
    parsed = catalogue.from_textdf(raw)
    return parsed.select(F.col("document_id").alias("doc_id"), F.col("author")[0].alias("author_1"), F.size("author").cast("long").alias("n_authors"), F.col("types")[0].alias("type_1"), "md5_sum")


@query(f"WITH {M.OVERVIEW} SELECT doc_id, name FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Cover Letter ' WHEN doc_id % 7 = 0 THEN 'Expert' ELSE '' END || name AS name FROM overview) WHERE NOT ({' OR '.join(f'contains(lower(name), {chr(39)}{w}{chr(39)})' for w in config.NAME_BLACKLIST)})")
def name_blacklist(spark, sf):
    o = M.overview(spark, sf)
    named = o.withColumn("name", F.concat(F.when(F.col("doc_id") % 5 == 0, F.lit("Cover Letter ")).when(F.col("doc_id") % 7 == 0, F.lit("Expert")).otherwise(F.lit("")), "name"))
    return catalogue.without_names(named).select("doc_id", "name")


@query(f"WITH {M.OVERVIEW} SELECT doc_id, md5_sum FROM (SELECT doc_id, md5_sum, count(*) OVER (PARTITION BY md5_sum) AS n FROM overview) WHERE n > 1")
def duplicate_keys(spark, sf):
    return catalogue.duplicate_keys(M.overview(spark, sf), "md5_sum", "doc_id")


STORE = f"{M.OVERVIEW}, store AS (SELECT md5_sum, min(name) AS name, min(doc_id) AS first_id FROM overview GROUP BY md5_sum HAVING min(doc_id) % 3 <> 0)"


def _store(spark, sf):
    return M.overview(spark, sf).groupBy("md5_sum").agg(F.min("name").alias("name"), F.min("doc_id").alias("first_id")).where("first_id % 3 <> 0")


@query(f"WITH {STORE} SELECT o.md5_sum, s.name, s.first_id FROM overview o JOIN store s ON o.md5_sum = s.md5_sum")
def doc_store_join(spark, sf):
    return catalogue.load_from_store(M.overview(spark, sf), _store(spark, sf))


@query(f"WITH {STORE} SELECT doc_id, md5_sum FROM overview WHERE md5_sum NOT IN (SELECT md5_sum FROM store)")
def todo_anti(spark, sf):
    return catalogue.remaining(M.overview(spark, sf), _store(spark, sf)).select("doc_id", "md5_sum")


@query(f"WITH {STORE} SELECT (SELECT count(*) FROM overview) AS n_wanted, (SELECT count(DISTINCT md5_sum) FROM store) AS n_done")
def extraction_progress(spark, sf):
    return catalogue.progress(M.overview(spark, sf), _store(spark, sf))


@query("SELECT lang, CASE lang WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' WHEN 'ru' THEN 'rus' WHEN 'ar' THEN 'ara' ELSE 'eng' END AS tesseract, count(*) AS n FROM documents GROUP BY lang")
def language_code_map(spark, sf):
    d = M.table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return d.select("lang", T.mapped(F.col("lang"), config.UN_TO_TESSERACT, "eng").alias("tesseract"), "n")


@query(f"WITH {M.OVERVIEW} SELECT doc_id, name FROM overview ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 32")
def sample_32(spark, sf):
    return catalogue.sample(M.overview(spark, sf), "doc_id", S.sample_size).select("doc_id", "name")


@query("SELECT doc_id, CAST(trunc(least(1.0::DOUBLE, 1024.0::DOUBLE / w) * w) AS INTEGER) AS width, CAST(trunc(least(1.0::DOUBLE, 1024.0::DOUBLE / w) * h) AS INTEGER) AS height FROM (SELECT doc_id, 500 + n_chars % 3000 AS w, 700 + n_chars % 4000 AS h FROM documents)")
def resize_dims(spark, sf):
    d = M.table(spark, sf, "documents").select("doc_id", (500 + F.col("n_chars") % 3000).alias("w"), (700 + F.col("n_chars") % 4000).alias("h"))
    width, height = T.resized(F.col("w"), F.col("h"))
    return d.select("doc_id", width.alias("width"), height.alias("height"))


@query("SELECT doc_id, regexp_extract('https://example.org/files/' || doc_id || '.v1.pdf', '[^/]+$') AS base_name, CAST(doc_id AS VARCHAR) AS stem, '/data/pdfs/' || doc_id || '.pdf' AS path FROM documents")
def path_keys(spark, sf):
    d = M.table(spark, sf, "documents").select("doc_id", F.concat(F.lit("https://example.org/files/"), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("url"))
    base = T.base_name(F.col("url"))
    return d.select("doc_id", base.alias("base_name"), T.stem(base).alias("stem"), T.document_path(F.col("doc_id").cast("string"), "/data").alias("path"))


@query("SELECT key, CAST(seed_idx AS INTEGER) AS seed_idx, phrase FROM (VALUES " + ", ".join(f"('{k}', {i}, '{p}')" for k, ps in config.SEED_TOPICS.items() for i, p in enumerate(ps)) + ") AS t(key, seed_idx, phrase)")
def seed_topic_table(spark, sf):
    return config.seed_topics(spark)


@query(f"WITH {M.OVERVIEW} SELECT row_number() OVER (ORDER BY source_url, doc_id) - 1 AS row_number, doc_id, name FROM overview")
def report_rows(spark, sf):
    rows = M.overview(spark, sf).select("doc_id", "name", "source_url")
    return numbered(rows, "source_url", "doc_id").toDF("row_number", "doc_id", "name", "source_url").drop("source_url")


# --- recognised words


FIT_WORDS = f"{M.OCR_WORDS}, fit AS (SELECT * FROM ocr_words WHERE regexp_matches(text, '{NB}') AND conf >= 0)"
LINES = f"{FIT_WORDS}, lines AS (SELECT md5, page_no, block_num, par_num, line_num, string_agg(text, ' ' ORDER BY word_no) AS line, CAST(count(*) AS INTEGER) AS n_words, min(word_no) AS first_word FROM fit GROUP BY ALL)"
NUMBERED = f"""{LINES}, firsts AS (SELECT *, min(first_word) OVER (PARTITION BY md5, page_no, block_num, par_num) AS par_first FROM lines),
numbered AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY md5, page_no ORDER BY par_first) AS INTEGER) AS par_idx, CAST(row_number() OVER (PARTITION BY md5, page_no, block_num, par_num ORDER BY first_word) AS INTEGER) AS line_idx FROM firsts)"""
PARAGRAPHS = f"{NUMBERED}, pars AS (SELECT md5, page_no, par_idx, string_agg(line, ' ' ORDER BY line_idx) AS paragraph, CAST(count(*) AS INTEGER) AS n_lines FROM numbered GROUP BY ALL)"


@query(f"WITH {FIT_WORDS} SELECT md5, page_no, count(*) AS n_words, sum(length(text))::BIGINT AS n_chars FROM fit GROUP BY ALL")
def ocr_word_filter(spark, sf):
    return layout.fit_words(M.ocr_words(spark, sf)).groupBy("md5", "page_no").agg(F.count("*").alias("n_words"), F.sum(F.length("text")).alias("n_chars"))


@query(f"WITH {LINES} SELECT md5, page_no, block_num, par_num, line_num, line, n_words FROM lines")
def ocr_lines(spark, sf):
    return layout.lines(layout.fit_words(M.ocr_words(spark, sf))).drop("first_word")


@query(f"WITH {PARAGRAPHS} SELECT md5, page_no, par_idx, paragraph, n_lines FROM pars")
def ocr_paragraphs(spark, sf):
    return layout.page_paragraphs(M.ocr_words(spark, sf)).drop("row_index")


@query(f"WITH {PARAGRAPHS} SELECT md5, page_no, par_idx, CAST(coalesce(sum(n_lines + 1) OVER (PARTITION BY md5, page_no ORDER BY par_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS row_index FROM pars")
def ocr_row_indexes(spark, sf):
    return layout.page_paragraphs(M.ocr_words(spark, sf)).select("md5", "page_no", "par_idx", "row_index")


# --- pages and languages


RANGES = f"""{M.PAGES}, ranges AS (
  SELECT md5, coalesce(max(CASE WHEN len(list_filter(paragraphs, lambda p: lower(p) IN ({_quoted(config.CONTENTS_HEADINGS)}))) > 0 THEN page_no END), 0) AS toc_page,
         coalesce(max(CASE WHEN len(list_filter(paragraphs, lambda p: lower(p) IN ({_quoted(config.REFERENCES_HEADINGS)}))) > 0 THEN page_no END), -1) AS references_page
  FROM pages_ GROUP BY md5
)"""


@query(f"WITH {RANGES} SELECT md5, page_no, CAST(len(paragraphs) AS INTEGER) AS n_paragraphs FROM pages_ JOIN ranges USING (md5) WHERE page_no >= toc_page AND (references_page <= 0 OR page_no < references_page)")
def page_range_trim(spark, sf):
    return pages.trim_pages(M.pages(spark, sf)).select("md5", "page_no", F.size("paragraphs").alias("n_paragraphs"))


@query(f"WITH {RANGES} SELECT md5, toc_page, references_page FROM ranges")
def page_ranges(spark, sf):
    return pages.page_range(M.pages(spark, sf))


VOTING = f"""{M.BLOCKS}, longest AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY length(text) DESC, page_no, block_no) AS rank FROM blocks WHERE page_no < 50),
voting AS (SELECT * FROM longest WHERE rank <= 128 AND length(text) > 64 AND {_words("text")} > 3 AND regexp_matches(text, '[a-zA-Z]') AND NOT contains(text, 'http'))"""


@query(f"WITH {VOTING} SELECT md5, page_no, block_no, CAST(rank AS INTEGER) AS rank FROM voting")
def language_blocks_top128(spark, sf):
    return pages.voting_blocks(M.blocks(spark, sf)).select("md5", "page_no", "block_no", "rank")


@query(f"""WITH {VOTING}, votes AS (SELECT md5, CASE WHEN block_no % 3 = 2 THEN 'en' ELSE lang END AS lang FROM voting),
counted AS (SELECT md5, lang, count(*) AS n FROM votes GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY n DESC, lang) AS r, count(*) OVER (PARTITION BY md5) AS k FROM counted)
SELECT d.md5, coalesce(r.lang, 'en') AS language, coalesce(r.k, 0) AS n_languages FROM (SELECT DISTINCT md5 FROM blocks) d LEFT JOIN ranked r ON d.md5 = r.md5 AND r.r = 1""")
def language_vote(spark, sf):
    b = M.blocks(spark, sf)
    votes = pages.voting_blocks(b).select("md5", F.when(F.col("block_no") % 3 == 2, F.lit("en")).otherwise(F.col("lang")).alias("lang"))
    return pages.vote(votes, b)


_GRAMS = """list_concat(list_concat(c, list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])), list_transform(generate_series(1, len(c) - 2), lambda i: c[i] || c[i + 1] || c[i + 2]))"""
_CHARS = "string_split(' ' || trim(regexp_replace(lower(text), '[^\\p{L}]+', ' ', 'g')) || ' ', '')"
_A = languages.SMOOTHING
LANGUAGE_MODEL = f"""sampled AS (SELECT lang, text FROM documents WHERE doc_id % 5 <> 0 ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {languages.SAMPLE_ROWS}),
counts AS (SELECT lang, gram, count(*) AS n FROM (SELECT lang, unnest({_GRAMS}) AS gram FROM (SELECT lang, {_CHARS} AS c FROM sampled WHERE lang IS NOT NULL)) GROUP BY ALL),
totals AS (SELECT lang, length(gram) AS k, sum(n) AS total FROM counts GROUP BY ALL), kinds AS (SELECT length(gram) AS k, count(DISTINCT gram) AS v FROM counts GROUP BY k),
model AS (
  SELECT g.gram, t.lang, CAST(round(ln((coalesce(c.n, 0) + {_A}) / (t.total + {_A} * (v + 1))) * {languages.UNIT}) AS BIGINT) AS weight
  FROM (SELECT DISTINCT gram, length(gram) AS k FROM counts UNION ALL SELECT '#' || k, k FROM kinds) g JOIN kinds USING (k) JOIN totals t USING (k) LEFT JOIN counts c ON c.gram = g.gram AND c.lang = t.lang
)"""


def _language_model(spark, sf):
    d = M.table(spark, sf, "documents").where(F.col("doc_id") % 5 != 0)
    return languages.learn(languages.labelled_sample(d.select("doc_id", "lang", "text"), "doc_id"))


@query(f"WITH {LANGUAGE_MODEL} SELECT gram, lang, weight FROM model")
def language_model(spark, sf):
    """Weights of grams by language, learned from a sample of four fifths of the ids."""
    return _language_model(spark, sf)


@query(f"""WITH {LANGUAGE_MODEL}, grams AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_GRAMS}) AS gram FROM (SELECT doc_id, {_CHARS} AS c FROM documents) WHERE len(c) > 2) GROUP BY ALL),
known AS (SELECT DISTINCT gram FROM model), scored AS (
  SELECT doc_id, lang, sum(n * weight) AS score FROM (SELECT doc_id, n, coalesce(known.gram, '#' || length(grams.gram)) AS gram FROM grams LEFT JOIN known USING (gram)) JOIN model USING (gram) GROUP BY ALL
), best AS (SELECT doc_id, lang FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) = 1)
SELECT doc_id, best.lang AS language FROM documents LEFT JOIN best USING (doc_id)""")
def language_guess(spark, sf):
    """The language of every document by the model of ``language_model``."""
    guess = languages.identifier(_language_model(spark, sf))
    return M.table(spark, sf, "documents").select("doc_id", guess(F.col("text")).alias("language"))


# --- paragraphs


def _split(x: str) -> str:
    marked = f"regexp_replace({x}, '([.!?]){BL}+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split(regexp_replace({marked}, '(e\\.g\\.|i\\.e\\.)' || chr(1), '\\1 ', 'g'), chr(1)), lambda s: s <> '')"


CLEANED = f"""{M.CANDIDATES}, washed AS (
  SELECT doc_id, lang, block_no, regexp_replace(regexp_replace(replace(candidate, '- ', '-'), 'http{NB}+', '', 'g'), '{NB}+@{NB}+(?:\\.{NB}+)+', '', 'g') AS c FROM candidates
), cleaned AS (
  SELECT * FROM (SELECT doc_id, lang, block_no, CASE WHEN left(c, 2) IN ({_quoted(config.ENUMERATION_MARKS)}) THEN substr(c, 3) ELSE c END AS candidate FROM washed)
  WHERE NOT (lower(left(candidate, 5)) IN ({_quoted(config.CAPTIONS_5)}) OR lower(left(candidate, 6)) = '{config.CAPTION_6}')
)"""
SPLIT = f"{CLEANED}, split AS (SELECT * FROM (SELECT *, {_split('candidate')} AS sentences FROM cleaned) WHERE len(sentences) <> 1)"
KEPT = f"""{SPLIT}, fit AS (
  SELECT doc_id, lang, block_no, list_filter(sentences, lambda x: len(regexp_extract_all(x, '\\p{{Nd}}')) / length(x) < 0.1 AND len(regexp_extract_all(x, '[A-Z]')) / length(x) < 0.2
    AND length(x) >= 32 AND {_words('x')} >= 8 AND {_words('x')} < 256) AS sentences FROM split
), kept AS (SELECT *, array_to_string(sentences, ' ') AS paragraph FROM fit WHERE len(sentences) >= 2)"""
PACKED = f"""{KEPT}, again AS (SELECT *, {_split('paragraph')} AS s FROM kept WHERE {_words('paragraph')} > 100),
cut AS (SELECT *, right(s[len(s)], 1) IN ('.', '?', '!') AS whole, CASE WHEN right(s[len(s)], 1) IN ('.', '?', '!') THEN s ELSE s[1:len(s) - 1] END AS rest FROM again),
folded AS (SELECT *, list_reduce(list_transform(rest, lambda x: {{'done': CAST([] AS VARCHAR[]), 'cur': x, 'n': CAST({_words('x')} AS BIGINT)}}), lambda a, x:
    CASE WHEN a.n + x.n >= 100 THEN {{'done': list_append(a.done, a.cur), 'cur': x.cur, 'n': x.n}}
         ELSE {{'done': a.done, 'cur': CASE WHEN a.cur = '' THEN x.cur ELSE a.cur || ' ' || x.cur END, 'n': a.n + x.n}} END,
    {{'done': CAST([] AS VARCHAR[]), 'cur': '', 'n': CAST(0 AS BIGINT)}}) AS f FROM cut),
long_chunks AS (SELECT doc_id, lang, block_no, CASE WHEN NOT whole AND len(regexp_extract_all(array_to_string(rest, ' '), '{NB}+')) <= 100 THEN [array_to_string(rest, ' ')] ELSE list_append(f.done, f.cur) END AS chunks FROM folded),
all_chunks AS (SELECT * FROM long_chunks UNION ALL SELECT doc_id, lang, block_no, [paragraph] FROM kept WHERE {_words('paragraph')} <= 100),
packed AS (SELECT doc_id, lang, block_no, CAST(unnest(generate_series(0, len(chunks) - 1)) AS INTEGER) AS chunk_no, unnest(chunks) AS paragraph FROM all_chunks)"""


@query(f"WITH {CLEANED} SELECT doc_id, block_no, candidate FROM cleaned")
def clean_candidates(spark, sf):
    return paragraphs.cleaned(M.candidates(spark, sf)).select("doc_id", "block_no", "candidate")


@query(f"WITH {SPLIT} SELECT doc_id, block_no, CAST(len(sentences) AS INTEGER) AS n_sentences, array_to_string(sentences, '|') AS sentences FROM split")
def sentence_split(spark, sf):
    found = paragraphs.split(paragraphs.cleaned(M.candidates(spark, sf)))
    return found.select("doc_id", "block_no", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("sentences"))


def _word(c: str) -> str:
    return f"lower(regexp_replace({c}, '[.!?]+$', ''))"


def _core(t: str) -> str:
    return f"regexp_replace({t}, '{boundaries.CORE}', '', 'g')"


def _association(a: str, b: str, both: str, n: str) -> str:
    """Dunning's ratio over four cells: -2 (sum of cells under one share - under two)."""
    cell = lambda k, p: f"(CASE WHEN {k} = 0 THEN 0 ELSE ({k}) * ln({p}) END)"
    cells = ((both, f"{b} / {n}", f"{both} / {a}"), (f"{a} - {both}", f"1 - {b} / {n}", f"1 - {both} / {a}"),
             (f"{b} - {both}", f"{b} / {n}", f"({b} - {both}) / ({n} - {a})"), (f"{n} - {a} - {b} + {both}", f"1 - {b} / {n}", f"1 - ({b} - {both}) / ({n} - {a})"))
    return f"-2 * ({' + '.join(cell(k, p) + ' - ' + cell(k, q) for k, p, q in cells)})"


LEARNED = f"""{CLEANED}, cored AS (
  SELECT lang, list_filter(list_transform(regexp_extract_all(candidate, '{NB}+'), lambda t: {_core('t')}), lambda c: {_word('c')} <> '') AS cores FROM cleaned WHERE lang IS NOT NULL
), near AS (SELECT lang, cores[i - 1] AS p, cores[i] AS c FROM (SELECT lang, cores, unnest(generate_series(1, len(cores))) AS i FROM cored)
), told AS (
  SELECT lang, CASE WHEN p LIKE '%.' THEN {_word('p')} END AS before, {_word('c')} AS word, c LIKE '%.' AS dot, regexp_matches(c, '^\\p{{Lu}}') AS capital,
         p IS NOT NULL AND NOT regexp_matches(p, '[.!?]$') AS inside, coalesce(regexp_matches(p, '[!?]$'), false) AS marked FROM near
), totals AS (SELECT lang, count(*)::DOUBLE AS total, count(*) FILTER (dot)::DOUBLE AS total_dot FROM told GROUP BY lang
), types AS (
  SELECT lang, word, count(*)::DOUBLE AS n, count(*) FILTER (dot)::DOUBLE AS n_dot, count(*) FILTER (NOT capital) AS n_small, count(*) FILTER (capital AND inside) AS n_inside,
         length(replace(word, '.', '')) AS len FROM told GROUP BY ALL
), fits AS (
  SELECT *, -2 * (n_dot * ln(total_dot / total) + (n - n_dot) * ln(1 - total_dot / total) - n_dot * ln(0.99::DOUBLE) - (n - n_dot) * ln(0.01::DOUBLE)) AS fit
  FROM types JOIN totals USING (lang) WHERE n_dot > 0 AND regexp_matches(word, '\\p{{L}}') AND NOT regexp_matches(word, '^\\p{{L}}$')
), short AS (
  SELECT lang, 'abbreviation' AS kind, word, '' AS other, fit * exp(-len) * (length(word) - len + 1) * pow(len::DOUBLE, n_dot - n) AS score FROM fits
  WHERE fit * exp(-len) * (length(word) - len + 1) * pow(len::DOUBLE, n_dot - n) >= {boundaries.ABBREVIATION}
), after AS (SELECT t.*, s.word IS NOT NULL AS short, coalesce(regexp_matches(before, '^(\\p{{L}}|\\p{{N}}+)$'), false) AS open FROM told t LEFT JOIN short s ON s.lang = t.lang AND s.word = t.before
), ends AS (SELECT lang, word, count(*)::DOUBLE AS k FROM after WHERE marked OR (before IS NOT NULL AND NOT short AND NOT open) GROUP BY ALL
), starters AS (
  SELECT lang, 'starter' AS kind, word, '' AS other, {_association('a', 'n', 'k', 'total')} AS score
  FROM ends JOIN (SELECT lang, sum(k) AS a FROM ends GROUP BY lang) USING (lang) JOIN types USING (lang, word) JOIN totals USING (lang) WHERE regexp_matches(word, '\\p{{L}}') AND k * total > a * n
), pairs AS (SELECT lang, before, word, count(*)::DOUBLE AS k FROM after WHERE open GROUP BY ALL HAVING count(*) >= {boundaries.PAIR_TIMES}
), collocations AS (
  SELECT p.lang, 'collocation' AS kind, p.before AS word, p.word AS other, {_association('f.n_dot', 't.n', 'k', 'total')} AS score
  FROM pairs p JOIN types f ON f.lang = p.lang AND f.word = p.before JOIN types t ON t.lang = p.lang AND t.word = p.word JOIN totals ON totals.lang = p.lang
  WHERE k * total > f.n_dot * t.n AND NOT EXISTS (SELECT 1 FROM starters s WHERE s.lang = p.lang AND s.word = p.word AND s.score >= {boundaries.STARTER})
), openers AS (
  SELECT DISTINCT t.lang, 'opener' AS kind, t.word, '' AS other, n_small::DOUBLE AS score FROM after a JOIN types t ON t.lang = a.lang AND t.word = a.word
  WHERE capital AND (short OR regexp_matches(before, '^\\p{{L}}$')) AND n_small > 0 AND n_inside = 0
), learned AS (
  SELECT * FROM short UNION ALL SELECT * FROM starters WHERE score >= {boundaries.STARTER} UNION ALL SELECT * FROM collocations WHERE score >= {boundaries.COLLOCATION} UNION ALL SELECT * FROM openers
)"""


def _learned(spark, sf):
    return boundaries.learn(paragraphs.cleaned(M.candidates(spark, sf)), "lang", "candidate")


@query(f"WITH {LEARNED} SELECT lang, kind, word, other, round(score, 6) AS score FROM learned")
def sentence_model(spark, sf):
    """Abbreviations, sentence starters, collocations and openers of each language, learned from all candidates."""
    found = _learned(spark, sf)
    return owning(found.withColumn("score", F.round("score", 6)), found)


def _has(kind: str, word: str, other: str = "''") -> str:
    return f"(lang, '{kind}', {word}, {other}) IN (SELECT (lang, kind, word, other) FROM learned)"


@query(f"""WITH {LEARNED}, pieces AS (SELECT doc_id, block_no, lang, {_split('candidate')} AS s FROM cleaned
), lone AS (SELECT doc_id, block_no, lang, i, s[i] AS piece, {_core(f"regexp_extract(s[i], '({NB}+)$', 1)")} AS last, {_core(f"regexp_extract(s[i + 1], '^({NB}+)', 1)")} AS following, i = len(s) AS ends
  FROM (SELECT *, unnest(generate_series(1, len(s))) AS i FROM pieces)
), words AS (SELECT *, {_word('last')} AS word, coalesce({_word('following')}, '') AS other, regexp_matches(following, '^\\p{{Ll}}') AS small, regexp_matches(following, '^\\p{{Lu}}') AS capital FROM lone
), judged AS (
  SELECT *, capital AND ({_has('starter', 'other')} OR {_has('opener', 'other')}) AS begins, regexp_matches(word, '^\\p{{L}}$') AS initial, regexp_matches(word, '^\\p{{N}}+$') AS number FROM words
), marked AS (
  SELECT *, CASE WHEN ends THEN '' WHEN last LIKE '%.' AND (({_has('abbreviation', 'word')} AND NOT begins) OR (initial AND capital AND NOT begins)
      OR ((initial OR number) AND (small OR {_has('collocation', 'word', 'other')}))) THEN ' ' ELSE chr(1) END AS sign FROM judged
), found AS (SELECT doc_id, block_no, string_split(string_agg(piece || sign, '' ORDER BY i), chr(1)) AS s FROM marked GROUP BY ALL)
SELECT doc_id, block_no, CAST(len(s) AS INTEGER) AS n_sentences, array_to_string(s, '|') AS sentences FROM found WHERE len(s) <> 1
UNION ALL SELECT doc_id, block_no, 0, '' FROM pieces WHERE len(s) = 0""")
def sentence_split_learned(spark, sf):
    """Sentences of all candidates, by learned boundaries."""
    told = _learned(spark, sf)
    learned = boundaries.Boundaries(told)
    discard(told)
    found = paragraphs.split(paragraphs.cleaned(M.candidates(spark, sf)), "lang", learned)
    return found.select("doc_id", "block_no", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("sentences"))


ARABIC = f"list_filter(string_split(replace(regexp_replace(candidate, '([.!?]){BL}+', '\\1' || chr(1), 'g'), chr(1), '.'), '.'), lambda s: s <> '')"


@query(f"WITH {CLEANED}, split AS (SELECT doc_id, block_no, {ARABIC} AS s FROM cleaned) SELECT doc_id, block_no, CAST(len(s) AS INTEGER) AS n_sentences, array_to_string(s, '|') AS sentences FROM split WHERE len(s) <> 1")
def sentence_split_arabic(spark, sf):
    found = paragraphs.split(paragraphs.cleaned(M.candidates(spark, sf)).withColumn("spoken", F.lit("ar")), "spoken")
    return found.select("doc_id", "block_no", F.size("sentences").alias("n_sentences"), F.array_join("sentences", "|").alias("sentences"))


@query(f"WITH {KEPT} SELECT doc_id, block_no, CAST(len(sentences) AS INTEGER) AS n_sentences FROM fit WHERE len(sentences) >= 2")
def sentence_filters(spark, sf):
    found = paragraphs.filtered(paragraphs.split(paragraphs.cleaned(M.candidates(spark, sf))))
    return found.select("doc_id", "block_no", F.size("sentences").alias("n_sentences"))


@query(f"WITH {KEPT} SELECT doc_id, block_no, paragraph FROM kept")
def kept_paragraphs(spark, sf):
    return paragraphs.kept_paragraphs(M.candidates(spark, sf)).select("doc_id", "block_no", "paragraph")


@query(f"WITH {PACKED} SELECT doc_id, block_no, chunk_no, paragraph FROM packed")
def paragraph_packing(spark, sf):
    return paragraphs.process(M.candidates(spark, sf)).select("doc_id", "block_no", "chunk_no", "paragraph")


@query(f"WITH {PACKED} SELECT count(*) AS n_paragraphs, CAST(coalesce(sum({_words('paragraph')}), 0) AS BIGINT) AS n_words, round(sum({_words('paragraph')}) / count(*), 6) AS words_per_paragraph FROM packed")
def corpus_stats(spark, sf):
    return catalogue.corpus_stats(paragraphs.process(M.candidates(spark, sf))).withColumn("words_per_paragraph", F.round("words_per_paragraph", 6))


@query(f"WITH {PACKED} SELECT lang, count(*) AS n_paragraphs, CAST(coalesce(sum({_words('paragraph')}), 0) AS BIGINT) AS n_words, round(sum({_words('paragraph')}) / count(*), 6) AS words_per_paragraph FROM packed GROUP BY lang")
def corpus_stats_by_lang(spark, sf):
    return catalogue.corpus_stats(paragraphs.process(M.candidates(spark, sf)), "lang").withColumn("words_per_paragraph", F.round("words_per_paragraph", 6))


PARAGRAPH_EMBEDDINGS = "pe AS (SELECT CAST(vec_id // 2 AS VARCHAR) AS document_md5, CAST(vec_id % 2 AS INTEGER) AS paragraph_id, embedding FROM embeddings)"


@query(f"WITH {M.BLOCKS}, {PARAGRAPH_EMBEDDINGS} SELECT md5 AS document_md5, block_no AS paragraph_id, text AS paragraph, lang AS language, CAST(len(embedding) AS INTEGER) AS n_dims FROM blocks JOIN pe ON pe.document_md5 = md5 AND pe.paragraph_id = block_no")
def paragraph_frame(spark, sf):
    found = catalogue.attach_embeddings(M.paragraph_frame(spark, sf), M.paragraph_embeddings(spark, sf))
    return found.select("document_md5", "paragraph_id", "paragraph", "language", F.size("embedding").alias("n_dims"))


@query(f"""WITH {M.BLOCKS}, {PARAGRAPH_EMBEDDINGS}, places AS (
  SELECT document_md5, paragraph_id, sum(p) AS p, sum(e) AS e FROM (
    SELECT md5 AS document_md5, block_no AS paragraph_id, 1 AS p, 0 AS e FROM blocks UNION ALL SELECT document_md5, paragraph_id, 0, 1 FROM pe) GROUP BY ALL)
SELECT document_md5, CAST(sum(p) AS BIGINT) AS n_paragraphs, CAST(sum(e) AS BIGINT) AS n_embeddings FROM places GROUP BY document_md5 HAVING bool_or(p <> e)""")
def embedding_integrity(spark, sf):
    return catalogue.embedding_gaps(M.paragraph_frame(spark, sf), M.paragraph_embeddings(spark, sf))


# --- topics


def _terms(source: str, key: str) -> str:
    """Terms of a table with a text column ``paragraph``: ``key, term``."""
    tok = r"regexp_extract_all(lower(paragraph), '[\p{L}\p{N}_]{2,}')"
    return f"""SELECT {key}, unnest(list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT {key}, {tok} AS t FROM {source})"""


CTFIDF = f"""{M.TOPIC_DOCS}, counts AS (SELECT topic_nr, term, count(*) AS n FROM ({_terms("topic_docs", "topic_nr")}) GROUP BY ALL),
totals AS (SELECT topic_nr, sum(n) AS total FROM counts GROUP BY topic_nr), mean AS (SELECT floor(sum(n) / count(DISTINCT topic_nr)) AS a FROM counts),
idf AS (SELECT term, ln(1 + (SELECT a FROM mean) / sum(n)) AS idf FROM counts GROUP BY term),
weights AS (SELECT topic_nr, term, n, sqrt(n / total) * idf AS weight FROM counts JOIN totals USING (topic_nr) JOIN idf USING (term))"""
TOP = f"{CTFIDF}, top AS (SELECT * FROM (SELECT topic_nr, term, weight, CAST(row_number() OVER (PARTITION BY topic_nr ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM weights) WHERE rank <= 10)"


def _weights(spark, sf):
    return topics.ctfidf(topics.term_counts(M.topic_docs(spark, sf), "topic_nr"))


def _top(spark, sf):
    weights = _weights(spark, sf)
    return owning(topics.top_words(weights), weights)


@query(f"WITH {CTFIDF} SELECT topic_nr, term, n FROM counts")
def ngram_counts(spark, sf):
    return topics.term_counts(M.topic_docs(spark, sf), "topic_nr")


@query(f"WITH {CTFIDF} SELECT topic_nr, term, round(weight, 6) AS weight FROM weights")
def ctfidf(spark, sf):
    found = _weights(spark, sf)
    return owning(found.select("topic_nr", "term", F.round("weight", 6).alias("weight")), found)


@query(f"WITH {TOP} SELECT topic_nr, rank, term, round(weight, 6) AS weight FROM top")
def topic_top_words(spark, sf):
    return _top(spark, sf).withColumn("weight", F.round("weight", 6))


@query(f"WITH {TOP} SELECT topic_nr, topic_nr || '_' || string_agg(term, '_' ORDER BY rank) AS label FROM top WHERE rank <= 4 GROUP BY topic_nr")
def topic_labels(spark, sf):
    return topics.labels(_top(spark, sf))


WIDE = ", ".join(f"max(CASE WHEN rank = {k} THEN term END) AS word_{k}" for k in range(1, 11))


@query(f"WITH {TOP} SELECT topic_nr, {WIDE} FROM top WHERE topic_nr <> -1 GROUP BY topic_nr")
def topic_words_wide(spark, sf):
    return topics.words_wide(_top(spark, sf))


@query(f"WITH {M.TOPIC_DOCS} SELECT topic_nr, n, CASE WHEN topic_nr = -1 THEN -1 ELSE CAST(row_number() OVER (PARTITION BY topic_nr = -1 ORDER BY n DESC, topic_nr) - 1 AS INTEGER) END AS new_topic FROM (SELECT topic_nr, count(*) AS n FROM topic_docs GROUP BY topic_nr)")
def topic_sizes_relabel(spark, sf):
    return topics.sizes_relabelled(M.topic_docs(spark, sf))


OWN = f"""own_counts AS (SELECT doc_id, topic_nr, term, count(*) AS n FROM ({_terms("topic_docs", "doc_id, topic_nr")}) GROUP BY ALL),
own AS (SELECT doc_id, topic_nr, term, sqrt(n / sum(n) OVER (PARTITION BY doc_id)) * idf AS weight FROM own_counts JOIN idf USING (term))"""
NORMS = "nt AS (SELECT topic_nr, sqrt(sum(weight * weight)) AS nt FROM weights GROUP BY topic_nr), nd AS (SELECT doc_id, sqrt(sum(weight * weight)) AS nd FROM own GROUP BY doc_id)"


@query(f"""WITH {CTFIDF}, {OWN}, {NORMS},
near AS (SELECT o.doc_id, w.topic_nr, sum(o.weight * w.weight) / any_value(nd) / any_value(nt) AS sim FROM own o JOIN weights w USING (term) JOIN nd ON nd.doc_id = o.doc_id JOIN nt ON nt.topic_nr = w.topic_nr
  WHERE o.topic_nr = -1 AND w.topic_nr <> -1 GROUP BY o.doc_id, w.topic_nr),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sim DESC, topic_nr) AS r FROM near WHERE sim >= 0.08) WHERE r = 1)
SELECT d.doc_id, d.topic_nr, coalesce(b.topic_nr, d.topic_nr) AS new_topic FROM topic_docs d LEFT JOIN best b USING (doc_id)""")
def outlier_reassign(spark, sf):
    return topics.reassigned(M.topic_docs(spark, sf), "doc_id")


REPRESENTATIVE = f"""{CTFIDF}, {OWN}, {NORMS},
inside AS (SELECT o.doc_id, o.topic_nr, sum(o.weight * w.weight) / any_value(nd) / any_value(nt) AS sim FROM own o JOIN weights w ON o.term = w.term AND o.topic_nr = w.topic_nr JOIN nd ON nd.doc_id = o.doc_id JOIN nt ON nt.topic_nr = w.topic_nr
  WHERE o.topic_nr <> -1 GROUP BY o.doc_id, o.topic_nr),
rep AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY topic_nr ORDER BY round(sim, 9) DESC, doc_id) AS INTEGER) AS rank FROM inside) WHERE rank <= 3)"""


@query(f"WITH {REPRESENTATIVE} SELECT topic_nr, rank, doc_id, round(sim, 6) AS sim FROM rep")
def representative_docs(spark, sf):
    return topics.representative_docs(M.topic_docs(spark, sf), "doc_id").withColumn("sim", F.round("sim", 6))


@query(f"""WITH {REPRESENTATIVE}, top AS (SELECT * FROM (SELECT topic_nr, term, CAST(row_number() OVER (PARTITION BY topic_nr ORDER BY round(weight, 9) DESC, term) AS INTEGER) AS rank FROM weights) WHERE rank <= 10),
wide AS (SELECT topic_nr, {WIDE} FROM top WHERE topic_nr <> -1 GROUP BY topic_nr),
docs AS (SELECT topic_nr, {", ".join(f"max(CASE WHEN rank = {k} THEN doc_id END) AS doc_{k}" for k in (1, 2, 3))} FROM rep GROUP BY topic_nr) SELECT * FROM wide FULL JOIN docs USING (topic_nr)""")
def words_and_docs(spark, sf):
    wide = topics.words_wide(_top(spark, sf))
    return topics.words_and_docs(wide, topics.representative_docs(M.topic_docs(spark, sf), "doc_id"), "doc_id")


WINDOWS = r"""win AS (SELECT doc_id, CAST(unnest(generate_series(0, len(w) - 1)) AS INTEGER) AS window_no, unnest(w) AS paragraph FROM (
  SELECT doc_id, list_transform(generate_series(0, greatest(len(t) - 5, 0), 2), lambda i: array_to_string(t[i + 1:i + 5], ' ')) AS w FROM (SELECT doc_id, regexp_extract_all(lower(paragraph), '[\p{L}\p{N}_]{2,}') AS t FROM topic_docs) WHERE len(t) > 0))"""


@query(f'WITH {M.TOPIC_DOCS}, {WINDOWS} SELECT doc_id, window_no, paragraph AS "window" FROM win')
def token_windows(spark, sf):
    return topics.token_windows(M.topic_docs(spark, sf), "doc_id")


THETA = f"""{CTFIDF}, {WINDOWS}, wc AS (SELECT doc_id, window_no, term, count(*) AS n FROM ({_terms("win", "doc_id, window_no")}) GROUP BY ALL),
ww AS (SELECT doc_id, window_no, term, sqrt(n) * idf AS weight FROM wc JOIN idf USING (term)), nw AS (SELECT doc_id, window_no, sqrt(sum(weight * weight)) AS nw FROM ww GROUP BY ALL),
nt AS (SELECT topic_nr, sqrt(sum(weight * weight)) AS nt FROM weights GROUP BY topic_nr),
sims AS (SELECT ww.doc_id, ww.window_no, w.topic_nr, sum(ww.weight * w.weight / nt) / any_value(nw) AS sim FROM ww JOIN weights w USING (term) JOIN nt ON nt.topic_nr = w.topic_nr JOIN nw ON nw.doc_id = ww.doc_id AND nw.window_no = ww.window_no
  WHERE w.topic_nr <> -1 GROUP BY ww.doc_id, ww.window_no, w.topic_nr),
theta AS (SELECT doc_id, topic_nr, sum(sim) / sum(sum(sim)) OVER (PARTITION BY doc_id) AS weight FROM sims WHERE sim >= 0.02 GROUP BY doc_id, topic_nr)"""
#: Sparse term vectors of five words are less like a topic's than embeddings are.
LOW = Settings(min_similarity=0.02)


@query(f"WITH {THETA} SELECT doc_id, topic_nr, round(weight, 6) AS weight FROM theta")
def topic_distribution(spark, sf):
    return topics.topic_distribution(M.topic_docs(spark, sf), "doc_id", s=LOW).withColumn("weight", F.round("weight", 6))


@query(f"WITH {THETA} SELECT doc_id, {', '.join(f'round(coalesce(sum(CASE WHEN topic_nr = {t} THEN weight END), 0), 6) AS topic_{t}' for t in range(10))} FROM theta GROUP BY doc_id")
def topic_distribution_wide(spark, sf):
    wide = topics.distribution_wide(topics.topic_distribution(M.topic_docs(spark, sf), "doc_id", s=LOW), "doc_id", list(range(10)))
    return wide.select("doc_id", *[F.round(F.col(str(t)), 6).alias(f"topic_{t}") for t in range(10)])


def _embed(text):
    return embedded(text, HashedNgrams(), DIM)


def _topic_vectors(spark, sf):
    """``topic_nr, embedding``: the mean vectors of the topics' documents."""
    found = M.topic_docs(spark, sf).select("topic_nr", _embed(F.col("paragraph")).alias("embedding"))
    return vectors.as_arrays(vectors.centroids(found, "topic_nr"), "topic_nr")


@query()
def topic_distribution_embedded(spark, sf):
    return topics.embedded_distribution(M.topic_docs(spark, sf), "doc_id", _topic_vectors(spark, sf), _embed, s=S)


@query()
def topic_words_reranked(spark, sf):
    """Top words by vectors learned from the topics' documents."""
    docs = M.topic_docs(spark, sf)
    known = materialise(word_vectors.learn(docs, "paragraph"), "words")
    told = word_vectors.text_vectors(docs, known, "topic_nr", "doc_id", text="paragraph")
    means = vectors.as_arrays(vectors.centroids(told, "topic_nr"), "topic_nr").withColumnRenamed("embedding", "mean")
    some = materialise(topics.top_words(_weights(spark, sf), Settings(top_words=50)), "top")
    terms = word_vectors.text_vectors(some.select("term").distinct(), known, "term", text="term").withColumnRenamed("embedding", "e")
    return owning(topics.reranked(some, means, terms), known, some)


@query(f"""WITH {M.TOPIC_DOCS}, tokens AS (SELECT doc_id, regexp_extract_all(lower(paragraph), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS t FROM topic_docs),
placed AS (SELECT doc_id, unnest(t) AS word, unnest(generate_series(1, len(t))) AS pos FROM tokens),
vocabulary AS (SELECT word FROM placed GROUP BY word HAVING count(*) >= {word_vectors.LEAST_TIMES} ORDER BY count(*) DESC, word LIMIT {word_vectors.MOST_WORDS}),
known AS (SELECT * FROM placed WHERE word IN (SELECT word FROM vocabulary)),
met AS (SELECT a.word, b.word AS other, count(*) AS n FROM known a JOIN (SELECT doc_id, word, pos, unnest([{", ".join(str(d) for d in range(-word_vectors.REACH, word_vectors.REACH + 1) if d)}]) AS d FROM known) b
  ON a.doc_id = b.doc_id AND a.pos = b.pos + b.d GROUP BY ALL),
sums AS (SELECT word, sum(n)::DOUBLE AS s FROM met GROUP BY word)
SELECT m.word, m.other, m.n, round(ln(m.n * (SELECT sum(s) FROM sums) / (a.s * b.s)), 6) AS ppmi FROM met m JOIN sums a ON a.word = m.word JOIN sums b ON b.word = m.other
WHERE ln(m.n * (SELECT sum(s) FROM sums) / (a.s * b.s)) > 0""")
def word_associations(spark, sf):
    """Which words of the topics' documents meet more often than by chance."""
    found, known = word_vectors.word_associations(M.topic_docs(spark, sf), "paragraph")
    names = spark.createDataFrame([(i, w) for i, (w, _) in enumerate(known)], "i long, word string")
    named = found.join(names, "i").join(names.select(F.col("i").alias("j"), F.col("word").alias("other")), "j")
    return owning(named.select("word", "other", "n", F.round("ppmi", 6).alias("ppmi")), found)


# --- vectors


VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"
CENTROIDS = f"{VEC}, c AS (SELECT label, CAST(dim AS INTEGER) AS dim, avg(x) AS value FROM (SELECT label, unnest(e) AS x, unnest(generate_series(0, len(e) - 1)) AS dim FROM v) GROUP BY label, dim)"


@query(f"WITH {CENTROIDS} SELECT label, dim, round(value, 6) AS value FROM c")
def topic_centroids(spark, sf):
    return vectors.centroids(M.table(spark, sf, "embeddings"), "label").withColumn("value", F.round("value", 6))


def _seeds(spark, sf):
    return vectors.as_arrays(vectors.centroids(M.table(spark, sf, "embeddings"), "label"), "label").withColumnRenamed("label", "seed")


@query(f"""WITH {CENTROIDS}, s AS (SELECT label AS seed, list(value ORDER BY dim) AS ce FROM c GROUP BY label),
r AS (SELECT vec_id, seed, round(list_dot_product(e, ce) / sqrt(list_dot_product(e, e) * list_dot_product(ce, ce)), 9) AS sim FROM v, s)
SELECT vec_id, seed, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, seed) AS k FROM r) WHERE k = 1""")
def nearest_seed(spark, sf):
    return vectors.nearest_seed(M.table(spark, sf, "embeddings"), _seeds(spark, sf))


@query(f"""WITH {VEC}, r AS (SELECT a.vec_id, b.vec_id AS neighbour, round(list_cosine_similarity(a.e, b.e), 9) AS sim FROM v a JOIN v b ON a.vec_id <> b.vec_id)
SELECT vec_id, CAST(rank AS INTEGER) AS rank, neighbour, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, neighbour) AS rank FROM r) WHERE rank <= 16""")
def knn16(spark, sf):
    return neighbours(M.table(spark, sf, "embeddings"))


GUIDED = f"""{CENTROIDS}, m AS (SELECT CAST(dim AS INTEGER) AS dim, avg(x) AS value FROM (SELECT unnest(e) AS x, unnest(generate_series(0, len(e) - 1)) AS dim FROM v) GROUP BY dim),
s AS (SELECT CAST(label AS VARCHAR) AS seed, list(value ORDER BY dim) AS ce FROM c GROUP BY label UNION ALL SELECT '', list(value ORDER BY dim) FROM m),
r AS (SELECT vec_id, e, seed, ce, round(list_dot_product(e, ce) / sqrt(list_dot_product(e, e) * list_dot_product(ce, ce)), 9) AS sim FROM v, s),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, seed) AS k FROM r) WHERE k = 1),
pulled AS (SELECT vec_id, unnest(e) AS x, unnest(ce) AS y, unnest(generate_series(0, len(e) - 1)) AS dim, seed FROM near)"""


@query(f"WITH {GUIDED} SELECT vec_id, CAST(dim AS INTEGER) AS dim, round(CASE WHEN seed = '' THEN x ELSE (x * 3 + y) / 4 END, 6) AS value FROM pulled")
def guided_vectors(spark, sf):
    seeds = _seeds(spark, sf).withColumn("seed", F.col("seed").cast("string"))
    found = vectors.guided(M.table(spark, sf, "embeddings"), seeds)
    return found.select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn("value", F.round("value", 6))


def _principal(k: int, squarings: int = 14) -> str:
    """CTEs ``pc1`` ... with the variance of each principal component: the covariance matrix is squared so often that only its
    first eigenvector is left, and freed of it for the next one."""
    steps = [f"""{VEC}, long AS (SELECT vec_id, unnest(e) AS x, unnest(generate_series(1, len(e))) AS dim FROM v),
centred AS (SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY dim) AS x FROM long),
col AS (SELECT dim AS i, list(x ORDER BY vec_id) AS r FROM centred GROUP BY dim),
c1 AS MATERIALIZED (SELECT a.i, list(list_dot_product(a.r, b.r) / (len(a.r) - 1) ORDER BY b.i) AS r FROM col a, col b GROUP BY a.i)"""]
    for j in range(1, k + 1):
        steps.append(f"m{j}_0 AS MATERIALIZED (SELECT * FROM c{j})")
        for q in range(1, squarings + 1):
            last = f"m{j}_{q - 1}"
            steps.append(f"""m{j}_{q} AS MATERIALIZED (SELECT i, list_transform(r, lambda x: x / f) AS r FROM {last}_sq, (SELECT max(sqrt(list_dot_product(r, r))) AS f FROM {last}_sq))""")
            steps.insert(len(steps) - 1, f"{last}_sq AS MATERIALIZED (SELECT a.i, list(list_dot_product(a.r, b.r) ORDER BY b.i) AS r FROM {last} a, {last} b GROUP BY a.i)")
        top = f"m{j}_{squarings}"
        steps.append(f"""e{j} AS MATERIALIZED (SELECT list_transform(r, lambda x: x / sqrt(list_dot_product(r, r))) AS w FROM {top} ORDER BY list_dot_product(r, r) DESC LIMIT 1)""")
        steps.append(f"""pc{j} AS MATERIALIZED (SELECT list_dot_product(list(list_dot_product(r, w) ORDER BY i), any_value(w)) AS variance FROM c{j}, e{j})""")
        steps.append(f"""c{j + 1} AS MATERIALIZED (SELECT i, list_transform(list_zip(r, w), lambda z: z[1] - variance * w[i] * z[2]) AS r FROM c{j}, e{j}, pc{j})""")
    return ",\n".join(steps)


@query(f"WITH {_principal(15)}, " + "all_pc AS (" + " UNION ALL ".join(f"SELECT CAST({j} AS INTEGER) AS component, variance FROM pc{j}" for j in range(1, 16)) + """)
SELECT component, round(sqrt(variance / (SELECT variance FROM pc1)), 5) AS scaled_deviation, round(variance, 5) AS variance FROM all_pc""")
def pca_rescaled(spark, sf):
    """Population deviations of all rescaled components, over the target, and the components' variances before."""
    whole = vectors.components(M.table(spark, sf, "embeddings"), S.components)
    spread_of = lambda rows, what: rows.select(F.posexplode("pc").alias("at", "x")).groupBy("at").agg(what.alias("x"))
    scaled = spread_of(vectors.rescaled(whole), F.stddev_pop("x") * 10_000)
    found = spread_of(whole, F.var_samp("x")).join(scaled.withColumnRenamed("x", "scaled"), "at")
    return found.select((F.col("at") + 1).alias("component"), F.round("scaled", 5).alias("scaled_deviation"), F.round("x", 5).alias("variance"))


@query()
def hdbscan_leaf(spark, sf):
    return clustering.hdbscan(M.table(spark, sf, "embeddings"))


@query()
def umap_2d(spark, sf):
    found = clustering.umap_layout(M.table(spark, sf, "embeddings"))
    return owning(found.select("vec_id", F.col("coordinates")[0].alias("x"), F.col("coordinates")[1].alias("y")), found)


@query()
def topic_merge(spark, sf):
    return clustering.merge_topics(_seeds(spark, sf).select(F.col("seed").alias("topic_nr"), "embedding"), 5)
