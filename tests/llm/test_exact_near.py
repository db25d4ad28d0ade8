"""Exact and near duplicates against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from docstrata.llm import simhash
from docstrata.llm.common import with_row_key
from docstrata.llm.components import components
from docstrata.llm.exact_dedup import (
    MAX_CHUNK,
    MIN_CHUNK,
    chunk_dictionary,
    chunk_recipes,
    chunks_of,
    colliding,
    cut_points,
    exact_dedup,
    recipe_of,
    rolling_hash,
)

SCHEMA = "doc_id long, text string, kept string, fp string, recipe string, n long"


def texts():
    r = random.Random(1)
    long = " ".join(f"w{r.randrange(10**6)}" for _ in range(9000))
    base = ["the quick brown fox jumps", "the quick  brown\tfox jumps", "thequickbrownfoxjumps", "", None, " \n", "é à ü", long, long.replace(" ", "\n"), long + " x", "a b", "ab", "x"]
    return [(i, t) for i, t in enumerate(base)] + [(7, long), (None, "ab"), (None, "only"), (12, "x")]


def frame(spark, rows, schema=SCHEMA):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "z", "z", "z", 5) for i, t in rows], schema)


def test_exact_against_brute_force(spark):
    rows = texts()
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i is None, i or 0, i))
    wanted = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])[3]
        wanted.append((i, keep, len(groups[norm]), i == keep, hashlib.sha256(norm.encode()).hexdigest()))
    got = [tuple(r) for r in exact_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)
    assert exact_dedup(frame(spark, rows).limit(0)).collect() == []


def test_chunks(spark):
    r = np.random.default_rng(3)
    data = r.integers(97, 123, 200_000, dtype=np.uint8)
    h = rolling_hash(data)
    assert h[5000] == rolling_hash(data[5000 - 31 : 5001])[-1]  # 32 bytes decide
    ends = cut_points(np.flatnonzero(h < (1 << 32) // 2048) + 1, len(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= MIN_CHUNK and sizes.max() <= MAX_CHUNK
    text = data.tobytes()
    a, b = (recipe_of(x, {}) for x in chunks_of([text, text[:100_000] + b"INSERTED" + text[100_000:]]))
    ids = lambda x: {x[i : i + 22] for i in range(0, len(x), 22)}
    assert len(ids(a) - ids(b)) <= 3
    alone = [recipe_of(next(chunks_of([x])), {}) for x in (b"short", text)]
    assert [recipe_of(x, {}) for x in chunks_of([b"short", text])] == alone and alone[1] == a  # the neighbour plays no part
    d = chunk_dictionary(chunk_recipes(frame(spark, [(1, "same"), (2, "sa me"), (3, "")]))).collect()
    assert [(x["n_bytes"], x["copies"]) for x in d] == [(4, 2)]


def test_chunks_of_equal_digests_are_told_apart(spark):
    """With digests of no and of one byte most chunks of a length collide; comparing bytes must still part them."""
    rows = [(i, f"text {i % 70:02d}") for i in range(140)] + [(200, "text 0 0"), (201, None), (202, "")]
    wanted = sorted(tuple(r) for r in exact_dedup(frame(spark, rows)).collect())
    assert len({r[1] for r in wanted}) == 71
    for size in (0, 1):
        assert colliding(frame(spark, rows), "text", chunk_recipes(frame(spark, rows), digest_bytes=size), size)
        assert sorted(tuple(r) for r in exact_dedup(frame(spark, rows), digest_bytes=size).collect()) == wanted
    assert not colliding(frame(spark, rows), "text", chunk_recipes(frame(spark, rows)))


def test_one_row_of_each_group(spark):
    rows = [(1, "aa bb cc"), (1, "aa bb cc"), (2, "aa bbcc"), (None, "zz"), (None, "zz"), (None, "aa bb cc"), (3, "unique one"), (3, "aabbcc")]
    keyed, row = with_row_key(frame(spark, rows))
    found = exact_dedup(keyed, row=row)
    kept = sorted(((r["doc_id"], r["group_size"]) for r in found.where("kept").collect()), key=str)
    assert kept == sorted([(1, 5), (None, 2), (3, 1)], key=str) and found.count() == 8
    assert found.select("row_0", "row_1").distinct().count() == 8


def brute_fingerprint(text):
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    if not words:
        return 0
    h = [xxhash.xxh64(b" ".join(words[i : i + 4]), seed=42).intdigest() for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """Least id reachable by links of at most four bits, over pairs (id, fingerprint)."""
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (k, _) in enumerate(fps):
        least[find(i)].append(k)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(len(fps))]


def roots_of(n, linked):
    """For each of n the least that it reaches by pairs of which ``linked`` says that they are links."""
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def shingles(text):
    """The five-word shingles of a text: strings, not hashes."""
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    """Jaccard similarity of 0.8 or more, in whole numbers; sets without shingles are alike."""
    return 5 * len(a & b) >= 4 * len(a | b) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) else False


def true_similar(texts):
    """For each text the least index reachable by true similarities, over all pairs."""
    sets = [shingles(t) for t in texts]
    return roots_of(len(sets), lambda i, j: alike(sets[i], sets[j]))


def brute_similar(texts):
    """The same over those pairs whose fingerprints are similar and share a table's bits."""

    def mix(h, salt):
        h = (h ^ salt) & (1 << 64) - 1
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        h = (h ^ h >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
        return h ^ h >> 31

    def wide(text):
        words = [w for w in re.split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if w]
        h = [xxhash.xxh64(b" ".join(words[i : i + 5]), seed=42).intdigest() for i in range(max(1, len(words) - 4))] if words else []
        out = 0
        for w in range(4):
            own = h if w == 0 else [mix(x, simhash.SALTS[w - 1]) for x in h]
            out |= sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > len(h)) << 64 * w
        return out

    fps = [wide(t) for t in texts]
    masks = [sum(x << 64 * w for w, x in enumerate(m)) for m in simhash.sampled_masks(4)]
    assert all(m.bit_count() == simhash.TABLE_BITS for m in masks)
    sets = [shingles(t) for t in texts]

    def linked(i, j):
        d = fps[i] ^ fps[j]
        return d.bit_count() <= simhash.SIMILAR["radius"] and any(d & m == 0 for m in masks) and alike(sets[i], sets[j])

    return roots_of(len(fps), linked)


def test_similar_against_brute_force(spark):
    r = random.Random(12)
    base = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(1, 150))] for _ in range(40)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(80):
        w = list(r.choice(base))
        for _ in range(r.randrange(1, 5)):
            w[r.randrange(len(w))] = f"new{k}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(5000, None), (5001, " \n"), (None, rows[3][1]), (3, rows[3][1]), (5002, "Long " * 40_000), (5003, "long " * 40_001)]
    rows += [(6000 + k, "again " * 3000 + " ".join(f"own{k}_{i}" for i in range(40))) for k in range(3)]  # one fingerprint, other shingles
    roots, true = brute_similar([t for _, t in rows]), true_similar([t for _, t in rows])
    assert all(true[i] == true[r] for i, r in enumerate(roots)) and len(set(true)) <= len(set(roots)) <= len(set(true)) + 5
    least = {}
    for root, (i, _) in zip(roots, rows):
        least[root] = min(least.get(root, (True, 0)), (i is None, i or 0))
    wanted = sorted(((i, least[root][1]) for root, (i, _) in zip(roots, rows)), key=str)
    got = simhash.near_duplicates(frame(spark, rows), **simhash.SIMILAR).select("doc_id", "component_id", "fingerprint").collect()
    assert sorted(((x[0], x[1]) for x in got), key=str) == wanted and all(len(x[2]) == 64 for x in got)
    assert simhash.near_duplicates(frame(spark, rows).limit(0), **simhash.SIMILAR).collect() == []


def test_no_similar_pair_is_missed(spark, monkeypatch):
    """Every pair of 0.8 and more is in one component, whatever the tables bring together, of common and own shingles alike."""
    r = random.Random(15)
    frame_of = lambda own: ["all"] * 25 + own
    rows = []
    for k in range(150):
        w = frame_of([f"w{r.randrange(5000)}" for _ in range(r.randrange(30, 200))])
        near = list(w)
        for at in range(30, len(w), 46):  # close above and below the threshold
            near[at] = f"new{k}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    rows += [(1000 + k, " ".join(f"all{i}" for i in range(45)) + f" own{k}" + " z" * (k % 7)) for k in range(40)]  # a hot key
    true = true_similar([t for _, t in rows])
    least = {}
    for root, (i, _) in zip(true, rows):
        least[root] = min(least.get(root, i), i)
    wanted = sorted((i, least[root]) for root, (i, _) in zip(true, rows))
    found = lambda: sorted(tuple(x) for x in simhash.near_duplicates(frame(spark, rows), **simhash.SIMILAR).select("doc_id", "component_id").collect())
    assert found() == wanted and 150 < len(set(true)) < 300
    monkeypatch.setattr(simhash, "SUB_BLOCK", 8)
    monkeypatch.setattr(simhash, "FIRST_TABLES", 1)  # nearly all is left to the exact search
    monkeypatch.setattr(simhash, "LANES", 16)
    assert found() == wanted


def test_what_the_search_lists_grows_with_a_family(spark, monkeypatch):
    """Texts that are all alike by less than 0.8, and a few more alike: pairs are not listed, and none of 0.8 is missed."""
    made, missed_links = [], simhash.missed_links

    def counted(*args):
        pairs, forests = missed_links(*args)
        made[-1] += pairs.count() + forests.count()
        return pairs, forests

    monkeypatch.setattr(simhash, "missed_links", counted)
    monkeypatch.setattr(simhash, "FIRST_TABLES", 1)
    monkeypatch.setattr(simhash, "FAMILY_HASHES", 4000)  # sub-blocks
    for m in (40, 160):
        r = random.Random(17)
        rows, frame_of = [], [f"all{i}" for i in range(200)]
        for k in range(m):
            own = [f"w{r.randrange(10**6)}" for _ in range(40)]
            rows.append((k, " ".join(frame_of + own)))
            if k % 20 == 0:
                rows.append((1000 + k, " ".join(frame_of + own[:-12] + [f"new{k}_{i}" for i in range(12)])))
        true = true_similar([t for _, t in rows])
        made.append(0)
        found = simhash.near_duplicates(frame(spark, rows), **simhash.SIMILAR).select("doc_id", "component_id").collect()
        assert sorted(tuple(x) for x in found) == sorted((i, rows[root][0]) for root, (i, _) in zip(true, rows))
        assert m <= len(set(true)) <= len(rows)
    assert 0 < made[1] < 6 * made[0]


def test_forests_of_possible_and_similar_sets():
    """They connect what all similar pairs do, with no more links than parts to join."""
    r = np.random.default_rng(18)
    sets = []
    for _ in range(6):
        base = np.unique(r.integers(0, 1 << 63, int(r.integers(5, 900)), dtype=np.uint64))
        for _ in range(12):
            kept = base[r.random(len(base)) < r.uniform(0.75, 1)]
            sets.append(np.union1d(kept, r.integers(0, 1 << 63, int(len(base) * r.uniform(0, 0.1)) + 1, dtype=np.uint64)))
    part = r.integers(100, 160, len(sets))
    true = np.array([[100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)) for b in sets] for a in sets])

    def joined(links):
        root = simhash._roots(part)
        simhash._merge(root, *np.array(list(links), int).reshape(-1, 2).T)
        return root

    wanted = joined(zip(*np.nonzero(true)))
    links = simhash.similar_links(part, sets, 80)
    assert (joined(links) == wanted).all() and len(links) == len(set(part)) - len(set(wanted)) and all(true[i, j] for i, j in links)
    n = np.array([len(s) for s in sets])
    wide = joined(simhash.possible_links(part, n, np.zeros(len(n), int), [simhash.parities(s) for s in sets], 80))
    assert all(wide[i] == wide[j] for i, j in zip(*np.nonzero(true)))


@pytest.mark.parametrize("n_common", [0, 300])
def test_prefixes_and_parities(n_common):
    """Similar sets share a hash of their prefixes, and differ in as many members as parities at least."""
    r = np.random.default_rng(16 + n_common)
    pool = np.unique(r.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2))
    known = np.sort(r.choice(pool, n_common, replace=False))
    common = known, r.integers(3, 9, n_common)
    similar = 0
    for step in range(400):
        a = np.sort(r.choice(pool, r.integers(1, 120 if step % 4 else 500), replace=False))
        b = np.unique(np.append(r.choice(a, max(1, len(a) - r.integers(0, len(a) // 8 + 2)), replace=False), r.choice(pool, r.integers(0, len(a) // 8 + 2))))
        shared = len(np.intersect1d(a, b))
        assert simhash.least_apart(simhash.parities(a), simhash.parities(b)) <= len(a) + len(b) - 2 * shared
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            similar += 1
            assert len(np.intersect1d(simhash.prefix_of(a, 80, common), simhash.prefix_of(b, 80, common)))
    assert similar > 100 and len(simhash.prefix_of(pool[:0], 80, common)) == 0


def test_similar_texts_are_found(spark):
    """Pairs of a similarity of 0.8 and more are linked, nine in ten at least; unrelated texts are not."""
    r = random.Random(13)
    rows, pairs = [], []
    for k in range(250):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 400))]
        near = list(w)
        for _ in range(r.randrange(1, max(2, len(w) // 45))):
            near[r.randrange(len(w))] = "changed"
        shingles = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (w, near)]
        if len(shingles[0] & shingles[1]) >= 0.8 * len(shingles[0] | shingles[1]):
            pairs.append((2 * k, 2 * k + 1))
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(near))]
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_duplicates(frame(spark, rows), **simhash.SIMILAR).collect()}
    assert len(pairs) > 150 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(got[i] in (i, i - i % 2) for i in got)


def test_similar_below_the_threshold_stay_apart(spark):
    """Texts within the radius of each other, of a similarity below 0.8, are all kept, also where a third lies between."""
    r = random.Random(14)
    rows = []
    for k in range(60):
        w = [f"w{r.randrange(5000)}" for _ in range(300)]
        step = 37 if k % 3 else 50  # a similarity of 0.76 or of 0.82
        near = [f"x{i}" if i % step == k % step else x for i, x in enumerate(w)]
        far = [f"y{i}" if i % 33 == 7 else x for i, x in enumerate(w)]
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    true = true_similar([t for _, t in rows])
    keyed, row = with_row_key(frame(spark, rows))
    kept = {x["doc_id"] for x in simhash.near_duplicates(keyed, row=row, **simhash.SIMILAR).where("kept").collect()}
    unverified = {**simhash.SIMILAR, "percent": 0}
    assert set(true) <= kept and len(kept - set(true)) <= 2 and len(set(true)) == 160  # nine in ten are found, no other goes
    assert len({x["component_id"] for x in simhash.near_duplicates(keyed, row=row, **unverified).collect()}) < len(kept) - 20


def test_closest_links():
    """Each row's three closest are among the links, which are no more than three for each row; links join what they should."""
    r = np.random.default_rng(4)
    fps = r.integers(0, 1 << 63, (1, 4), dtype=np.uint64).repeat(400, axis=0)
    for x in fps:
        for b in r.choice(256, r.integers(1, 40), replace=False):
            x[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    group = np.repeat([0, 1], 200)
    a, b = simhash.closest_links(fps, group, 46)
    pairs = {(min(x), max(x)) for x in zip(a.tolist(), b.tolist())}
    assert len(pairs) == len(a) <= 3 * 400 and (group[a] == group[b]).all()
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2).astype(int)
    assert (d[a, b] <= 46).all()
    d[group[:, None] != group[None, :]] = 1000
    np.fill_diagonal(d, 1000)
    for i in range(400):
        third = sorted(d[i])[2]
        assert {(min(i, j), max(i, j)) for j in np.flatnonzero((d[i] < third) & (d[i] <= 46)).tolist()} <= pairs
    assert [len(x) for x in simhash.closest_links(fps[:1], group[:1], 46)] == [0, 0]


def test_near_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"Wörd{i}" for i in range(500)]
    base = [[r.choice(vocabulary) for _ in range(r.randrange(1, 400))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(120):
        w = list(r.choice(base))
        w[r.randrange(len(w))] = "changed"
        rows.append((1000 - k, "\t".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (None, rows[3][1]), (None, "alone here"), (3, rows[3][1])]
    fps = [(i, brute_fingerprint(t)) for i, t in rows]
    wanted = sorted(zip((i for i, _ in rows), (format(f, "016x") for _, f in fps), brute_components(fps)), key=str)
    got = sorted((tuple(x) for x in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == wanted
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_slices(radius):
    r = np.random.default_rng(radius)
    a = r.integers(0, 1 << 63, 700, dtype=np.uint64) * np.uint64(2)
    for i in range(350, 700):  # near ones at every distance
        for b in r.choice(64, r.integers(0, 12), replace=False):
            a[i] ^= np.uint64(1) << np.uint64(b)
        a[i] = a[i - 350] ^ (a[i] & r.integers(0, 1 << 63, dtype=np.uint64) & r.integers(0, 1 << 63, dtype=np.uint64) & r.integers(0, 1 << 63, dtype=np.uint64))
    planes = simhash.bit_planes(a[:512])
    wanted = np.full((188, 8), simhash.ALL_BITS)
    got = np.unpackbits(simhash.within_radius(a[512:], planes, wanted, radius).view(np.uint8), axis=1, bitorder="little").astype(bool)
    assert (got == (np.bitwise_count(a[512:, None] ^ a[None, :512]) <= radius)).all()


@pytest.mark.parametrize("words, radius", [(2, 20), (4, 46), (4, 0), (3, 63)])
def test_wide_bit_slices(words, radius):
    r = np.random.default_rng(words * radius)
    a = r.integers(0, 1 << 63, (600, words), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for i in range(300, 600):
        flips = np.zeros(64 * words, np.uint8)
        flips[r.choice(64 * words, r.integers(0, 2 * radius + 2), replace=False)] = 1
        a[i] = a[i - 300] ^ np.packbits(flips, bitorder="little").view(np.uint64)
    wanted = np.full((88, 8), simhash.ALL_BITS)
    got = np.unpackbits(simhash.within_radius(a[512:], simhash.bit_planes(a[:512]), wanted, radius).view(np.uint8), axis=1, bitorder="little").astype(bool)
    assert (got == (np.bitwise_count(a[512:, None] ^ a[None, :512]).sum(axis=2) <= radius)).all() and got.any()


def test_forest_connects_what_links_connect():
    r = np.random.default_rng(9)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    fps = np.array([centre ^ sum((np.uint64(1) << np.uint64(b) for b in r.choice(64, 3, replace=False)), np.uint64(0)) for _ in range(1500)])
    group = np.repeat([0, 1], 750)
    root = simhash.spanning_links(fps, group)
    for g in (0, 1):
        rows = np.flatnonzero(group == g)
        wanted = brute_components([(int(i), int(fps[i])) for i in rows])
        assert root[rows].tolist() == wanted
    assert not set(root[:750]) & set(root[750:])


def test_hot_keys_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SUB_BLOCK", 8)
    test_near_against_brute_force(spark)


@pytest.mark.parametrize("n, blocks", [(10, 6), (10**6, 6), (10**9, 7), (10**11, 8)])
def test_tables_bring_all_pairs_together(n, blocks):
    assert simhash.plan_blocks(n, 4) == blocks
    r = random.Random(n)
    masks = simhash.block_masks(blocks, 4)
    for _ in range(200):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def test_components(spark):
    edges = [(i + 1, i) for i in range(40)] + [(100, 200), (200, 300), (300, 100), (7, 7), (None, 3), (500, 400), (400, 500)] + [(1000 + i, 999) for i in range(200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 200, 300)} | {400: 400, 500: 400} | {i: 999 for i in range(999, 1200)}
    assert components(spark.createDataFrame([], "u string, v string")).collect() == []
