"""Files, streams, and the whole course from words to reports."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docstrata.__main__ import arguments
from docstrata.config import Settings
from docstrata.plans.api import Collection, TopicModel
from docstrata.sources import readers, sinks
from docstrata.sources.shared import shared_dir
from docstrata.streaming import stateless

HEAD = "doc_id,name,md5_sum,source_url,family_id,variant,author,author_is_party,date,language,types,version\n"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "overview.csv").write_text(HEAD + "".join(f'{i},"Report, {i}",m{i},http://x/{i},f,v,A;B,True,2023,en,T1;T2,1\n' for i in range(3)) + "3,Cover letter,m3,http://x/3,f,v,A,True,2023,en,T1,1\n")
    return str(tmp_path)


def test_missing_paths(spark, tmp_path):
    for read in (lambda: readers.overview(spark, f"{tmp_path}/no.csv"), lambda: readers.stored(spark, f"{tmp_path}/no"), lambda: sinks.load_model(spark, str(tmp_path), 3)):
        with pytest.raises(FileNotFoundError):
            read()


def test_overview_round_trip(spark, folder):
    c = Collection(spark, folder)
    assert len(c) == 4 and c.documents.head()["author"] == ["A", "B"] and str(c).startswith("4 documents")
    assert len(Collection(spark, folder).filter_by_name(path=f"{folder}/other.csv")) == 3 and len(Collection(spark, folder)) == 4
    left = c.filter_by_name()
    assert len(left) == 3 == len(Collection(spark, folder))
    again = readers.overview(spark, f"{folder}/overview.csv")
    assert again.columns == HEAD.strip().split(",") and sorted(r["name"] for r in again.collect()) == [f"Report, {i}" for i in range(3)]


def test_downloads(spark, folder):
    tried = {}

    def get(url):
        if url.endswith("/1"):
            raise OSError("gone")
        return url.encode()

    found = Collection(spark, folder).download(get=get, pause=0)
    assert {r["key"]: r["ok"] for r in found.collect()} == {"m0": True, "m1": False, "m2": True, "m3": True}
    assert tuple(readers.n_downloaded(found).head()) == (3, 4)
    assert not tried
    assert sorted(os.listdir(f"{folder}/pdfs")) == ["m0.pdf", "m2.pdf", "m3.pdf"] and open(f"{folder}/pdfs/m0.pdf", "rb").read() == b"http://x/0"
    again = Collection(spark, folder).download(get=lambda url: b"late", pause=0)  # only what is missing
    assert [(r["key"], r["length"], r["error"]) for r in again.collect()] == [("m1", 4, None)]
    assert Collection(spark, folder).download(get=get, pause=0).count() == 0


TEXT = {
    "en": "The committee met in the capital and agreed on a common plan for the region. Members then discussed the budget of the next year in some detail and voted.",
    "es": "La comisión se reunió en la capital y acordó un plan común para la región con los países. Los miembros discutieron luego el presupuesto que la junta votó por la tarde.",
}


def test_files_to_paragraphs(spark, folder):
    """From saved files on, with readers that need no library: a page's image is its text."""
    seen = []

    def blocks(content):
        if content == b"broken":
            raise OSError("not a file of pages")
        return ((0, i, t) for i, t in enumerate(content.decode().split("\f")))

    def render(content, settings):
        assert settings.render_dpi == 300
        return ((i, 10, 10, t.encode()) for i, t in enumerate(content.decode().split("\f")))

    def recognise(image, language):
        if image == b"FAIL":
            raise RuntimeError("no memory")
        words = image.decode().split()
        words += [language] if words else []
        return ((i, 0, 0, i // 8, 90.0, w) for i, w in enumerate(words))

    os.makedirs(f"{folder}/pdfs")
    for name, content in (("m0", f"{TEXT['en']}\f{TEXT['en']}"), ("m1", TEXT["es"]), ("m2", f"{TEXT['en']}\fFAIL"), ("m3", "broken"), ("x9", " ")):
        open(f"{folder}/pdfs/{name}.pdf", "w").write(content)
    c = Collection(spark, folder)
    failed = c.extract_all(blocks=blocks, render=render, recognise=recognise)
    assert {r["md5"]: r["error"].split(":")[0] for r in failed.collect()} == {"m2": "RuntimeError"}
    found = {r["md5_sum"]: r for r in c.documents.collect()}
    assert {k: (r["language"], len(r["paragraphs"])) for k, r in found.items()} == {"m0": ("en", 2), "m1": ("es", 1)}
    stored = readers.stored(spark, f"{folder}/ocr")
    assert {(r["md5"], r["text"]) for r in stored.where("text in ('eng', 'spa')").collect()} == {("m0", "eng"), ("m1", "spa"), ("m3", "eng")}
    assert stored.where("page_no is null").count() == 4  # m0, m1, m3 and the empty x9 are done
    again = Collection(spark, folder).recognise(blocks=blocks, render=render, recognise=lambda image, language: iter([(0, 0, 0, 0, 1.0, "late")]))
    assert again.count() == 0 and stored.where("text = 'late'").count() == 0
    assert {r["md5"] for r in readers.stored(spark, f"{folder}/ocr").where("text = 'late'").collect()} == {"m2"}
    assert not seen and readers.in_small_tasks(spark.range(70)).rdd.getNumPartitions() == 3


def ocr_rows(spark):
    text = "The committee met in the capital and agreed on a common plan for the region. Members then discussed the budget of the next year in some detail."
    rows = []
    for d in range(3):
        for p in range(2):
            for i, w in enumerate(text.split()):
                rows.append((f"m{d}", p, i, 0, 0, i // 8, 90.0, w))
    return spark.createDataFrame(rows, "md5 string, page_no int, word_no long, block_num int, par_num int, line_num int, conf double, text string")


def test_words_to_reports(spark, folder, tmp_path):
    c = Collection(spark, folder)
    votes = spark.createDataFrame([(f"m{d}", "en") for d in range(3)], "md5 string, lang string")
    c.extract_paragraphs(ocr_rows(spark), votes)
    c.extract_paragraphs(ocr_rows(spark), votes)  # nothing is left to do
    c = Collection(spark, folder).load_documents()
    assert len(c) == 3 and c.documents.head()["path"].startswith(folder)
    assert c.paragraph_info().head()["n_paragraphs"] == 6 and c.duplicates().count() == 0
    assert c.embed().count() == 6
    assert c.load_embeddings().columns == ["document_md5", "paragraph_id", "paragraph", "language", "embedding"]

    r = np.random.default_rng(0)
    rows = []
    for i in range(120):
        topic = i % 3
        v = np.eye(8)[topic] + r.standard_normal(8) * 0.02
        words = [("solar", "wind", "energy", "grid"), ("ocean", "fish", "water", "coast"), ("forest", "tree", "soil", "land")][topic]
        rows.append((f"d{i:03d}", 0, " ".join(r.choice(words, 12)), "en", [float(x) for x in v]))
    df = spark.createDataFrame(rows, "document_md5 string, paragraph_id int, paragraph string, language string, embedding array<float>")
    s = Settings(num_topics=4, min_cluster_size=15, min_samples=5)
    out = str(tmp_path / "out")
    model = TopicModel(df, out, s).run()
    model.store_results()
    assigned = model.tables["assignments"]
    assert assigned.count() == 120 and assigned.where("topic_nr >= 0").count() > 100
    names = ("reduced_embeddings_per_para", "representative_words", "representative_docs_per_topic", "theta_embeddings")
    for name in names:
        files = glob.glob(f"{out}/4_{name}_report.csv/*.csv")
        assert files and open(files[0]).readline().startswith(('"",', ","))
    assert TopicModel(df, out, s).load().tables["labels"].count() == model.tables["labels"].count()


def test_numbers_of_rows(spark):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("x")).repartition(7)
    assert sorted((r[0], r[1]) for r in sinks.numbered(df, "x").collect()) == [(i, i) for i in range(100)]


def test_numbers_of_many_wide_rows(spark):
    """Beyond the sizes at which adaptive execution joins ranges, and with columns of the names used inside."""
    df = spark.range(400_000).select(F.xxhash64("id").alias("x"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("_part"), F.lit(1).alias("_place"))
    found = sinks.numbered(df, "x").toDF("n", "x", "_part", "_place")
    assert tuple(found.agg(F.count("n"), F.countDistinct("n"), F.min("n"), F.max("n")).head()) == (400_000, 400_000, 0, 399_999)
    assert found.orderBy("n").select("x").limit(1000).collect() == df.orderBy("x").select("x").limit(1000).collect()


def test_report_is_written_and_nothing_is_left(spark, tmp_path):
    folder = shared_dir(spark).removeprefix("file://") + "/docstrata"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    sinks.write_report(spark.range(10).toDF("x"), str(tmp_path / "r.csv"), "x")
    lines = [x for f in glob.glob(f"{tmp_path}/r.csv/*.csv") for x in open(f).read().split()[1:]]
    assert sorted(lines) == [f"{i},{i}" for i in range(10)]
    assert set(os.listdir(folder)) <= before


def test_listing_and_options(spark, tmp_path):
    (tmp_path / "a.b.pdf").write_bytes(b"x")
    assert [r["key"] for r in readers.listing(spark, str(tmp_path)).collect()] == ["a"]
    assert arguments(["f"]).num_topics == 72 and arguments(["f", "--load", "True"]).load is True
    with pytest.raises(SystemExit):
        arguments(["f", "--load", "true"])


def test_textdf(spark, tmp_path):
    cols = "author,author_is_party,date,document_id,document_md5_sum,document_name,document_family_id,document_source_url,document_variant,language,types,version"
    (tmp_path / "t.csv").write_text(cols + "\n" + "\"['A', 'B']\",True,2023,7,abc,n,f,u,v,en,\"['T']\",1\n")
    row = readers.textdf(spark, str(tmp_path / "t.csv"), "/data").head()
    assert row["author"] == ["A", "B"] and row["md5_sum"] == "abc" and row["path"] == "/data/pdfs/abc.pdf"


def test_stream(spark, tmp_path):
    text = "The committee met in the capital and agreed on a common plan for the region. Members then discussed the budget of the next year in some detail."
    spark.createDataFrame([(1, text), (2, "short")], "doc_id long, candidate string").write.parquet(str(tmp_path / "in"))
    stream = stateless.candidates(spark, str(tmp_path / "in"), "doc_id long, candidate string")
    stateless.to_paragraphs(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert [(r["doc_id"], r["paragraph"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(1, text)]


def test_a_broken_save_leaves_the_older_model_whole(spark, tmp_path):
    folder = str(tmp_path / "models")
    one = lambda i: {n: spark.createDataFrame([(i,)], "i int") for n in sinks.BUNDLE}
    seen = lambda: {r["i"] for t in sinks.load_model(spark, folder, 5).values() for r in t.collect()}
    sinks.save_model(one(1), folder, 5)
    held = sinks.load_model(spark, folder, 5)
    broken = one(2) | {"representatives": spark.range(1).select(F.raise_error(F.lit("broken")).alias("i"))}
    with pytest.raises(Exception, match="broken"):
        sinks.save_model(broken, folder, 5)
    assert seen() == {1} and set(sinks.load_model(spark, folder, 5)) == set(sinks.BUNDLE)
    sinks.save_model(one(3), folder, 5)
    assert seen() == {3} and {r["i"] for t in held.values() for r in t.collect()} == {1}
    sinks.save_model({"labels": one(4)["labels"]}, folder, 5)
    assert seen() == {4} and list(sinks.load_model(spark, folder, 5)) == ["labels"]
    left = os.listdir(f"{sinks.model_path(folder, 5)}/snapshots")
    assert len(left) == 2 and sorted(os.listdir(f"{sinks.model_path(folder, 5)}/manifests")) == sorted(left)
