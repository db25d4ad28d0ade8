"""Url filters, archives, mixing, the pipeline and its queries."""

import gzip
import hashlib
import html
import io
import os
import random
import zlib
from urllib.parse import urljoin, urlsplit

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.llm import mixing, queries, url_filters, warc
from docstrata.llm.common import discard, shared_dir
from docstrata.sources.files import opened


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "z", "z", "z") for i, u, h in rows], "page_id long, url string, html string, root string, digest string, best string")


def test_urls(spark):
    link = lambda to: f'<head><LINK href="{to}" rel="canonical"></head>'
    rows = [
        (0, "http://a.net/x", link("https://s.example.org/es/1")), (1, "http://b.net/y#top", '<meta http-equiv=refresh content="0; url=http://a.net/x">'), (2, "http://c.net/z", link("/w")), (3, "http://c.net/w", link("//q.com/de/1")),
        (4, "http://d.net/1", link("http://x.com/de/1")), (5, "http://d.net/2", link("http://d.net/1")), (6, "http://ok.org/", link("http://d.net/2")), (7, None, None), (8, "no scheme", None), (9, "http://S.Example.ORG/es/1?q", None),
        (10, "http://example.org/en/12", ""), (11, "http://example.org", None), (12, "http://notexample.org/es/", None), (13, "ftp://u@h.com:8/fr/", None), (None, "http://b.net/y", None), (1, "http://b.net/y#top", None), (14, "http://e.net/a/b", link("c")),
        (15, "http://e.net/a/c", link("http://com/de/")), (16, "http://y.com/fr/1", link("http://x.com/de/9")),
    ]
    got = {(r["page_id"], r["rule"], r["verdict"]) for r in url_filters.filter_urls(pages(spark, rows)).collect()}
    assert got == {
        (0, None, "block"), (1, None, "block"), (2, None, "block"), (3, None, "block"), (4, None, "allow"), (5, None, "allow"), (6, "org/", "allow"), (7, None, "allow"), (8, None, "allow"), (9, "example.org/es/", "block"),
        (10, "example.org/en/1", "block"), (11, None, "allow"), (12, "org/", "allow"), (13, None, "allow"), (None, None, "block"), (14, None, "block"), (15, None, "block"), (16, "com/fr/", "allow"),
    }
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    ours = sorted((tuple(r) for r in url_filters.filter_urls(pages(spark, rows)).collect()), key=str)
    assert sorted(con.sql(url_filters.filter_urls_sql()).fetchall(), key=str) == ours
    logged = spark.createDataFrame([("http://f.net/", "http://z.com/de/")], "from_url string, to_url string")
    assert url_filters.filter_urls(pages(spark, [(1, "http://f.net/", None)]), logged).head()["verdict"] == "block"
    assert url_filters.filter_urls(pages(spark, rows).limit(0)).collect() == []


def test_targets_as_the_standard_resolves_them(spark):
    """Against urllib, on every kind of reference."""
    bases = ["http://a.net", "http://a.net/b/c/d;p?q#f", "https://A.Net:443/x/", "http://u:p@b.org:8080/y?z=/../", "http://a.net/a/./b/../c/.."]
    targets = ["g", "./g", "g/", "/g", "//G.com/x", "?y", "g?y", "#s", "g#s", "", ".", "./", "..", "../", "../g", "../../../g", "g/./h/../i", "mailto:a@b", "HTTP://C.d:80/%7E", "g;x=1/../y", "a&amp;b", "a?x=1&#38;y"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string").withColumn("n", url_filters.node_of(F.col("b")))
    for r in url_filters.resolved(df, "n", "t", "v").collect():
        joined = urljoin(r["n"], html.unescape(r["t"]))
        assert r["v"] == (plain_node(joined) if "://" in joined else None), (r["n"], r["t"], r["v"], joined)
    assert url_filters.resolved(spark.createDataFrame([("none", "x"), ("none", "http://a/")], "n string, t string"), "n", "t", "v").select("v").collect() == [(None,), ("http://a/",)]


def test_pages_that_are_not_closed(spark):
    rows = [(1, "http://a.net/1", "<!-- " * 200_000 + "<link rel=canonical href=http://x.com/de/1>"), (2, "http://a.net/2", "<script>" + "<script " * 100_000 + "canonical"), (3, "http://a.net/3", "<p>" * 200_000 + "<link rel=canonical href=http://x.com/de/1>")]
    assert {r["page_id"]: r["verdict"] for r in url_filters.filter_urls(pages(spark, rows)).collect()} == {1: "allow", 2: "allow", 3: "block"}


def plain_node(url):
    p = urlsplit(url)
    host = p.netloc.rpartition("@")[2].lower()
    host = host.removesuffix({"http": ":80", "https": ":443"}.get(p.scheme, "-"))
    whole = urlsplit(urljoin(f"{p.scheme}://{p.netloc}/", p.path or "/")).path
    return f"{p.scheme}://{p.netloc[: len(p.netloc) - len(p.netloc.rpartition('@')[2])]}{host}{whole or '/'}" + (f"?{p.query}" if p.query else "")


def planted_pages(n):
    """Pages in chains, cycles and stars, written in many ways, some ending on a blocked or an allowed url."""
    r = random.Random(8)
    rows = []
    while len(rows) < n:
        size, shape = r.choice([1, 1, 2, 3, 5, 8]) if r.random() < 0.999 else 30, r.choice("chain cycle star".split())
        host = f"site{len(rows)}.net"
        end = r.choice([None, None, "http://x.com/de/1", "HTTP://X.COM:80/a/../de/2", "http://y.org/", "http://z.example.org/es/"])
        for i in range(size):
            to = (i + 1) % size if shape == "cycle" else 0 if shape == "star" else i + 1
            target = [f"http://{host}/p/{to}", f"HTTP://{host.upper()}:80/p/{to}#x", f"/p/./{to}", f"{to}", f"../p/{to}"][r.randrange(5)]
            if to == size or size == 1:
                target = end or "#"
            tag = f'<link rel="canonical" href="{target}">' if r.random() < 0.6 else f"<META http-equiv='refresh' content='3;URL={target}'>"
            noise = r.choice(["", "<!-- <link rel=canonical href=http://x.com/de/> -->", "<script>'<link rel=canonical href=http://x.com/de/>'</script>"])
            rows.append((len(rows), f"http://{host}/p/{i}" + r.choice(["", "", "#top"]), f"<html>{noise}{tag}</html>", end if to == size or size == 1 else f"http://{host}/p/{to}"))
    return rows


def test_planted_links(spark):
    """A hundred thousand pages against union-find and beside the SQL."""
    rows = planted_pages(100_000)
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for _, u, _, to in rows:
        if to:
            root[find(plain_node(u.partition("#")[0]))] = find(plain_node(to))
    said = {"x.com": "block", "y.org": "allow", "z.example.org": "block"}
    seen = {}
    for x in list(root):
        seen.setdefault(find(x), set()).add(said.get(urlsplit(x).netloc))
    blocked = {x for x in root if "block" in seen[find(x)] and "allow" not in seen[find(x)]}
    wanted = {i: "block" if plain_node(u.partition("#")[0]) in blocked else "allow" for i, u, _, _ in rows}
    assert 10_000 < sum(v == "block" for v in wanted.values()) < 80_000
    df = pages(spark, [r[:3] for r in rows]).repartition(4)
    got = url_filters.filter_urls(df).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == wanted
    con = duckdb.connect()
    con.register("rows", pa.table({"page_id": [r[0] for r in rows], "url": [r[1] for r in rows], "html": [r[2] for r in rows]}))
    con.sql("CREATE TABLE pages AS SELECT * FROM rows")
    assert sorted(con.sql(url_filters.filter_urls_sql()).fetchall()) == sorted(tuple(r) for r in got)


def test_archives(spark, tmp_path):
    big = "x é \r\n\r\nWARC/1.1\r\n" * 30_000
    rows = [(1, "http://a/", "same"), (5, "http://b/", "same"), (3, None, "same"), (2, "http://c/\nd", big), (4, "u", None), (6, "u", ""), (7, "u", "own"), (None, "u", "same"), (7, "u", "own")]
    got = sorted((tuple(r) for r in warc.archive_round_trip(pages(spark, rows).repartition(3)).collect()), key=str)
    assert got == sorted(
        [
            (i, len((h or "").encode()), warc.digest32((h or "").encode()), "revisit" if best is not None else "response", best)
            for i, h, best in [(1, "same", 5), (5, "same", None), (3, "same", 5), (2, big, None), (4, "", 6), (6, "", None), (7, "own", None), (7, "own", None), (None, "same", 5)]
        ],
        key=str,
    )
    assert warc.archive_round_trip(pages(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("members", [1, 3])
def test_normaliser(tmp_path, members):
    records = [warc.record(i, f"http://x/{i}", bytes([i]) * (i * 5000)) for i in range(60)]
    source, target = str(tmp_path / "in.warc.gz"), str(tmp_path / "out" / "out.warc.gz")
    source_uri, target_uri = f"file://{source}", f"file://{target}"
    n = len(records) // members
    with open(source, "wb") as f:
        for a in range(0, len(records), n):
            f.write(gzip.compress(b"".join(records[a : a + n])))
    index = warc.normalise(source_uri, target_uri)
    data = open(target, "rb").read()
    assert gzip.decompress(data) == b"".join(records)
    assert [gzip.decompress(data[a : a + k]) for _, a, k in index] == records
    assert [tuple(map(int, x.split())) for x in open(target + ".idx")] == index
    assert sorted(os.listdir(tmp_path / "out")) == ["out.warc.gz", "out.warc.gz.idx"]
    open(source, "wb").write(gzip.compress(b"".join(records)[:-9]))
    with pytest.raises(ValueError):
        warc.normalise(source_uri, f"file://{tmp_path}/out/again.warc.gz")
    assert sorted(os.listdir(tmp_path / "out")) == ["out.warc.gz", "out.warc.gz.idx"]  # no part of a file is left


def test_revisits_in_the_normaliser(tmp_path):
    records = [warc.record(i, "http://x/", b"same \r\n\r\n body") for i in range(3)]
    source, target = f"file://{tmp_path}/in.warc.gz", f"file://{tmp_path}/out.warc.gz"
    open(f"{tmp_path}/in.warc.gz", "wb").write(gzip.compress(b"".join(records)))
    index = warc.normalise(source, target, {0: 2, 1: 2})
    data = open(f"{tmp_path}/out.warc.gz", "rb").read()
    parsed = [warc.parse_record(gzip.decompress(data[a : a + n])) for _, a, n in index]
    assert [(f["warc-type"], f.get("warc-refers-to"), f["x-payload-length"], len(b)) for f, b in parsed] == [
        ("revisit", "<urn:page:2>", "14", 0), ("revisit", "<urn:page:2>", "14", 0), ("response", None, "14", 14),
    ]
    assert len({f["warc-payload-digest"] for f, _ in parsed}) == 1


def test_a_task_that_is_run_twice(spark, tmp_path):
    """A second attempt writes files of its own; what the first one left is not read."""
    rows = pages(spark, [(i, f"http://x/{i}", "page " * i) for i in range(20)]).repartition(2)
    folder = str(tmp_path / "w")
    first = warc.write_archives(rows, folder)
    again = warc.write_archives(rows, folder)
    paths = [{r[0] for r in t.select("path").distinct().collect()} for t in (first, again)]
    assert not paths[0] & paths[1] and len(os.listdir(folder)) == len(paths[0] | paths[1])
    for uri in ("relative/x", "/plain", "nowhere://x/y"):
        with pytest.raises(ValueError):
            opened(uri)
    assert opened("file:/a/b")[1] == "/a/b" and opened("file:///a")[1] == "/a"


def test_archives_leave_nothing(spark):
    folder = shared_dir(spark).removeprefix("file://") + "/docstrata"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    found = warc.archive_round_trip(pages(spark, [(1, "u", "x"), (2, "u", "x")]))
    assert found.count() == 2
    discard(found)
    assert set(os.listdir(folder)) <= before


def mix_rows(seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(3000):
        source = r.choice(["a", "a", "a", "a", "b", "c", "Z", None])
        rows.append((i, " ".join(["w"] * r.randrange(0, 60)), source))
    return rows + [(9001, None, "b"), (9002, "", "d"), (9003, "tiny one", "e"), (5, "again here", "a"), (None, "x y z", "c"), (9004, "w " * 30_000, "c")]


@pytest.mark.parametrize("pool_shards", [1024, 4])
def test_mixing(spark, pool_shards):
    rows = mix_rows()
    df = spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], "doc_id long, text string, source string, size int, target int, shard int")
    got = mixing.mix(df, shard_docs=100, pool_shards=pool_shards).withColumn("s", F.lit(0)).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5), shard_docs=100, pool_shards=pool_shards).withColumn("s", F.lit(0)).collect()))
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    sizes, target, taken = {}, {}, {}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    wanted = {s: 3 * sizes[s] if s in full else share[s] for s in names}
    by = {sizes[s]: s for s in names}
    for r in got:
        s = by[r["source_size"]]
        target[s], taken[s] = r["target"], taken.get(s, 0) + r["taken"]
    for s in names:
        assert target[s] == pytest.approx(wanted[s]) and taken[s] == pytest.approx(wanted[s], rel=0.02, abs=2)
    assert mixing.mix(df.limit(0)).collect() == []
    assert [r["taken"] for r in mixing.mix(df.where("doc_id = 9002")).collect()] == [0]


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_highest_quotients(spark, seats):
    r = random.Random(seats)
    votes = [r.choice([0, 5, r.randrange(1, 100), r.randrange(1, 5000)]) for _ in range(40)]
    df = spark.createDataFrame([("g", i, float(v), seats) for i, v in enumerate(votes)], "g string, u int, v double, s long")
    got = {x["u"]: x["quota"] for x in mixing.apportion(df, ["g"], "u", "v", "s").collect()}
    best = sorted(((-v / (2 * k - 1), i) for i, v in enumerate(votes) if v for k in range(1, seats + 1)))[:seats]
    assert got == {i: sum(j == i for _, j in best) for i in range(40)}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_beside_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.queries()[name](spark, sf)
    wanted = con.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    listed = sorted(tuple(map(str, (dict(zip(wanted.columns, r))[c] for c in columns))) for r in wanted.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in got.collect()) == listed


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_nothing_is_left(spark, sf, name):
    """A result that is no longer needed takes all tables of its making with it."""
    folder = shared_dir(spark).removeprefix("file://") + "/docstrata"
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    found = queries.queries()[name](spark, sf)
    assert found.count() > 0
    discard(found)
    assert set(os.listdir(folder) if os.path.exists(folder) else ()) <= before


def test_pipeline(spark, sf):
    """Each stage against what it must keep, worked out from its own input."""
    import corpus_pipeline
    from docstrata.llm.common import materialise, table
    from docstrata.llm.decontam import contamination
    from docstrata.llm.toxicity import toxicity

    docs = table(spark, sf, "documents")
    columns, ids = docs.columns, lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    for (name, stage), number in zip(corpus_pipeline.STAGES, (1, 4, 6, 8, 9)):
        after = materialise(stage(spark, docs, sf), "test")
        if number == 1:
            wanted = ids(toxicity(docs, table(spark, sf, "labels")).where("predicted = 0"))
        elif number == 4:
            best = {}
            for r in docs.collect():
                key = hashlib.sha256("".join((r["text"] or "").split(" ")).translate(str.maketrans("", "", "\t\n\v\f\r")).encode()).digest()
                best[key] = min(best.get(key, (0, 1 << 62)), (-len(r["text"] or ""), r["doc_id"]))
            wanted = sorted(i for _, i in best.values())
        elif number == 6:
            from tests.llm.test_exact_near import brute_similar

            rows = sorted(docs.select("doc_id", "text").collect())
            wanted = sorted(rows[i][0] for i in set(brute_similar([r[1] for r in rows])))
        elif number == 8:
            wanted = ids(contamination(docs, table(spark, sf, "benchmark")).where("n_hit = 0"))
        else:
            wanted = ids(docs)
            assert after.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert ids(after) == wanted, name
        assert number == 9 or after.columns == columns
        docs = after
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_cut_streams_are_errors():
    """Between two records, within a member, and within the checksum; whole ones of several members are none."""
    record = b"WARC/1.0\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    whole = gzip.compress(record * 3)
    for data in (whole, whole + gzip.compress(record), b""):
        assert len(list(warc.records_of(warc.inflated(io.BytesIO(data).read)))) in (3, 4, 0)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    between = z.compress(record) + z.flush(zlib.Z_FULL_FLUSH)
    for data in (between, whole[:-1], whole[:-8], whole[:20], whole + whole[:15]):
        with pytest.raises(ValueError, match="ends within"):
            list(warc.records_of(warc.inflated(io.BytesIO(data).read)))
