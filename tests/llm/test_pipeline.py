"""The pipeline's stages on rows of every kind, the whole of it against brute force, and what it leaves behind."""

import os
import re
from collections import Counter

import pytest

import corpus_pipeline
from docstrata.llm.common import discard, free_name, materialise, shared_dir, table, with_row_key
from docstrata.llm.toxicity import toxicity
from tests.llm.test_exact_near import brute_similar
from tests.llm.test_text_scans import words

STAGES = dict(corpus_pipeline.STAGES)
#: With columns whose names the stages use inside.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, _score double, _found string, kept boolean, row_0 long, "
    "_file string, _place string, size long, target long, fp long, first string, word string"
)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 0.9, "f", False, 7, "x", "y", 1, 2, 3, "z", None) for i, t, s in rows], SCHEMA)


def left(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/docstrata"
    return set(os.listdir(folder)) if os.path.exists(folder) else set()


ROWS = [
    (1, "aa bb cc", "a"), (1, "aa bb cc", "a"), (2, "aa bbcc", "a"), (None, "zz", None), (None, "zz", None), (None, "aa bb cc", "b"),
    (3, "unique one", "b"), (3, "aabbcc", "b"), (4, None, None), (5, "", "c"), (6, " \n", "c"), (7, "long " * 60_000, "c"), (8, "long  " * 60_000, "c"),
]


def test_one_row_of_each_group_stays(spark):
    """The ends of groups: equal texts, repeated rows, null ids, blank and very long texts."""
    kept = STAGES["exact dedup"](spark, frame(spark, ROWS), "")
    got = Counter((r["doc_id"], (r["text"] or "")[:12]) for r in kept.collect())
    assert got == Counter({(1, "aa bb cc"): 1, (None, "zz"): 1, (3, "unique one"): 1, (6, " \n"): 1, (8, "long  long  "): 1})
    assert kept.columns == frame(spark, []).columns and kept.dtypes == frame(spark, []).dtypes
    near = STAGES["SimHash near-dedup"](spark, frame(spark, ROWS), "")
    first: dict = {}
    for root, (i, t, _) in zip(brute_similar([t for _, t, _ in ROWS]), ROWS):
        first[root] = min(first.get(root, (True, 0)), (i is None, i or 0))
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in near.collect()) == Counter(first.values())
    assert near.columns == frame(spark, []).columns


@pytest.mark.parametrize("name", list(STAGES))
def test_every_stage_takes_every_row(spark, sf, name):
    stage = STAGES[name]
    assert stage(spark, frame(spark, []), sf).collect() == []
    every = ROWS + [(9, "A" * 300_000, "d"), (10, "\u0000 é 日本 😀", ""), (10, "\u0000 é 日本 😀", "")]
    found = stage(spark, frame(spark, every), sf)
    rows = found.collect()
    if name == "mixing":
        assert found.columns == ["doc_id", "size", "source_size", "target", "taken"] and len(rows) == len(every)
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t, _ in every)
    else:
        given = Counter(map(tuple, frame(spark, every).collect()))
        assert found.columns == frame(spark, []).columns and rows and not Counter(map(tuple, rows)) - given
    if name in ("toxicity", "decontamination"):
        assert len(rows) == len(every)


def test_pipeline_against_brute_force(spark, sf, tmp_path):
    """``run`` over the shared tables and planted rows, each step worked out again from all rows; nothing is left."""
    docs = table(spark, sf, "documents")
    item = table(spark, sf, "benchmark").where("length(text) > 80").head()["text"]
    planted = spark.createDataFrame(
        [(None, "no id at all", "en", None, 12), (None, "no  id at all", "en", None, 13), (900_001, f"Before. {item} After.", "en", "s", 9), (900_002, None, None, "s", 0)],
        docs.schema,
    )
    docs.unionByName(planted).write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("labels", "benchmark"):
        table(spark, sf, name).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = table(spark, str(tmp_path), "documents")
    toxic = {r["doc_id"] for r in toxicity(docs, table(spark, sf, "labels")).where("predicted = 1").collect()}
    rows = [r.asDict() for r in docs.collect() if r["doc_id"] not in toxic]
    order = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"] or ""), order(r))):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), r)
    rows = sorted(best.values(), key=order)
    rows = [rows[i] for i in sorted(set(brute_similar([r["text"] for r in rows])))]
    windows = set()
    for r in table(spark, sf, "benchmark").collect():
        w = words(r["text"])
        windows |= {tuple(w[i : i + min(10, len(w))]) for i in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(w) for w in windows}
    clean = lambda w: not any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))
    rows = [r for r in rows if clean(words(r["text"]))]
    before = left(spark)
    found = corpus_pipeline.run(spark, str(tmp_path))
    got = Counter((r["doc_id"], r["size"]) for r in found.collect())
    assert got == Counter((r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in rows)
    assert sum(i is None for i, _ in got.elements()) == 1 and 900_001 not in {i for i, _ in got}
    discard(found)
    assert left(spark) <= before


def test_row_keys(spark, tmp_path):
    spark.range(50).repartition(3).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df in (read, read.crossJoin(spark.range(2).withColumnRenamed("id", "_file")), read.limit(0)):
        keyed, row = with_row_key(df)
        assert keyed.drop(*row).columns == df.columns and keyed.select(*row).distinct().count() == df.count()
    assert free_name(read.withColumn("_X", read.id), "_x") == "_x_"
    assert materialise(read, "t").count() == 50
