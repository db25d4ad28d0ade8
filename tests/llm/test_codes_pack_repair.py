"""Vector codes, packing and conversation repair against brute force."""

import hashlib
import heapq
import itertools
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docstrata.llm import conversations as C
from docstrata.llm import packing as P
from docstrata.llm import vector_codes as V
from docstrata.llm.queries import oracle_sql, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_conversation_repair"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries()[name](spark, sf)
    columns = sorted(found.columns)
    wanted = con.sql(oracle_sql()[name]).select(*columns).fetchall()
    assert sorted(map(str, map(tuple, found.select(*columns).collect()))) == sorted(map(str, wanted))


# --- vector codes


def naive_codes(vectors, first, parts, rounds):
    """Entries and errors of integer vectors, every entry tried for every part; ``first``: the rows that entries begin with."""
    width = len(first[0]) // parts
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, p: min((far(v[p * width : (p + 1) * width], b), e) for e, b in enumerate(books[p]))
    for _ in range(rounds):
        found = [[near(v, p)[1] for p in range(parts)] for v in vectors]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for v, f in zip(vectors, found) if f[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    best = [[near(v, p) for p in range(parts)] for v in vectors]
    return [([e for _, e in b], sum(d for d, _ in b)) for b in best], books


def test_codes_against_brute_force(spark):
    r = random.Random(2)
    vector = lambda: [r.uniform(-1, 1) for _ in range(8)]
    rows = [(i, vector(), i % 3 or None) for i in range(60)]
    rows += [(100 + i, rows[i][1], 7) for i in range(20)] + [(3, vector(), 1), (3, vector(), 1), (None, vector(), None)]
    bad = [(200, None, 1), (201, [], 1), (202, [0.5] * 7, 1), (203, [None] * 8, 1), (204, [float("nan")] * 8, 1), (205, [float("-inf")] + [0.0] * 7, 1)]
    df = spark.createDataFrame([(*x, 5, "z") for x in rows + bad], "vec_id long, embedding array<float>, label int, error long, entries string").repartition(5)
    exact = [np.floor(np.float32(v).astype(float) * 1024).astype(int).tolist() for _, v, _ in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, [float(np.float32(x)) for x in rows[i][1]]))
    wanted, entries = naive_codes(exact, [exact[i] for i in order[:16]], 4, 4)
    books = V.learn_codebooks(df, entries=16)
    assert [b.tolist() for b in books.entries] == entries
    assert books.digest() == hashlib.sha256(",".join(str(x) for b in entries for e in b for x in e).encode()).hexdigest()
    found = V.encode(df, books, "vec_id", "label")
    got = Counter((x["vec_id"], x["label"], tuple(x["entries"]), x["error"]) for x in found.collect())
    assert got == Counter((rows[i][0], rows[i][2], tuple(e), d) for i, (e, d) in enumerate(wanted))
    sums = defaultdict(int)
    for (_, label, _, error), n in got.items():
        sums[label] += error * n
    told = V.summed_by(found, "label", "error", "total").withColumn("code", V.hex_code()).collect()
    assert all(x["total"] == sums[x["label"]] and bytes.fromhex(x["code"]) == bytes(x["entries"]) for x in told) and len(told) == len(rows)
    back = {x["vec_id"]: x["embedding"] for x in V.decode(found, books, "vec_id").collect()}
    e = next(x for x in told if x["vec_id"] == 9)["entries"]
    assert back[9] == [v / 1024 for p in range(4) for v in entries[p][e[p]]]
    none = V.learn_codebooks(df.limit(0))
    assert V.encode(df, none, "vec_id").collect() == []
    with pytest.raises(ValueError):
        V.learn_codebooks(df.where("vec_id = 202"))
    with pytest.raises(Exception, match="a component of"):
        V.encode(spark.createDataFrame([(1, [1e9] * 8)], "vec_id long, embedding array<double>"), books).collect()


@pytest.mark.parametrize("scale", [3, 1000, 1 << 26])
def test_partial_distances(scale):
    """Ties go to the first entry, and sums of large integers do not overflow."""
    r = np.random.default_rng(scale)
    for n, k, dims in ((50, 7, 5), (300, 256, 16), (3, 1, 1), (20, 4, 0), (0, 3, 4)):
        x, book = r.integers(-scale, scale, (n, dims)), r.integers(-scale, scale, (k, dims))
        book[k // 2] = book[0]
        all_of = np.square(x[:, None].astype(object) - book[None].astype(object)).sum(axis=2) if n and dims else np.zeros((n, k))
        entry, far = V.search(x, book)
        assert entry.tolist() == [int(np.argmin(row)) for row in all_of] and far.tolist() == [int(min(row)) for row in all_of]


# --- packing


def sums_of(counts):
    """All sums of a multiset of lengths."""
    found = {0}
    for n, c in counts.items():
        found = {s + n * k for s in found for k in range(c + 1)}
    return found


@given(st.dictionaries(st.integers(1, 24), st.integers(1, 4), max_size=6), st.sampled_from([16, 24, 32]))
@settings(max_examples=150, deadline=None)
def test_fillings_are_the_best(counts, capacity):
    """Each window holds its greatest length and fills as well as any multiset with it; all lengths are used up."""
    left = Counter({n: c for n, c in counts.items() if n <= capacity})
    for pattern, times in P.fillings(dict(left), capacity):
        seed = max(n for n, c in left.items() if c)
        rest = Counter(left)
        rest[seed] -= 1
        best = max(s for s in sums_of(rest) if s <= capacity - seed) + seed
        assert seed in pattern and sum(n * c for n, c in pattern.items()) == best
        for n, c in pattern.items():
            left[n] -= c * times
        assert min(left.values()) >= 0 and times > 0
    assert not +left


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=100, deadline=None)
def test_every_piece_has_its_place(counts):
    plan = P.plan(counts, 64)
    length = np.array([n for n, c in counts.items() for _ in range(c)], np.int64)
    number = np.array([i for c in counts.values() for i in range(c)], np.int64)
    piece, start, size, sequence, offset, _ = P.places(plan, length, number)
    covered, filled = defaultdict(list), defaultdict(list)
    for p, a, n, s, o in zip(piece, start, size, sequence, offset):
        covered[int(p)].append((int(a), int(n)))
        filled[int(s)].append((int(o), int(n)))
    for spans in (*covered.values(), *filled.values()):
        spans.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[0][0] == 0
    assert [sum(n for _, n in covered[i]) for i in range(len(length))] == length.tolist()
    assert sorted(filled) == list(range(len(filled)))
    assert all((n := sum(n for _, n in f)) <= 64 and n & (n - 1) == 0 for f in filled.values())


PIECES = ["<|endoftext|>", "<|EndOfText|>", "it's", "DON'T.", *" \t\n\x0b\x0c\r\x1c\x85\xa0\u2028\u1680\u3000'.,!1aAsSt\u0301İΑΣςéÉß"]


@given(st.lists(st.one_of(st.sampled_from(PIECES), st.characters(exclude_categories=["Cs"])), max_size=40).map("".join))
@settings(max_examples=600, deadline=None)
def test_words_have_the_ids_of_their_text(text):
    whole = P._words(PATH).tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(P.token_bytes(text, PATH), "<u4").tolist() == whole


@pytest.mark.parametrize("n", [0, 400])
def test_packed_documents_can_be_unpacked(spark, n):
    r = random.Random(4)
    word = lambda: "".join(r.choice("aeiounst") for _ in range(r.randrange(1, 7)))
    texts = [None, "", " \n", "<|endoftext|> x", "ä" * 3000, " ".join(word() for _ in range(9000))]
    texts += [" ".join(word() for _ in range(r.choice((3, 40, 300, 700)))) for _ in range(n)] + ["the same text again"] * n
    rows = [(i if i % 50 else None, t) for i, t in enumerate(texts[: n * 3])]
    df = spark.createDataFrame([(*x, 1, "z") for x in rows], "doc_id long, text string, start int, part string").repartition(7)
    found = P.pack(df, PATH).collect()
    assert P.pack(df.limit(0), PATH).columns == P.OUT
    ids = lambda t: [*P._words(PATH).tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    given = {(i, tuple(ids(t))) for i, t in rows}
    by_id = defaultdict(list)
    for i, t in given:
        by_id[i].append(t)
    filled, tokens = defaultdict(list), Counter()
    for x in found:
        filled[x["sequence_id"]].append((x["offset"], x["length"]))
        tokens[x["doc_id"]] += x["length"]
        mine = [t for t in by_id[x["doc_id"]] if len(t) == x["doc_tokens"]]
        assert any(crc(t[x["start"] : x["start"] + x["length"]]) == x["ids_crc32"] for t in mine)
    assert tokens == Counter({i: sum(len(ids(t)) for j, t in rows if j == i) for i, _ in rows})
    for spans in filled.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + m == b for (a, m), (b, _) in zip(spans, spans[1:]))
        total = sum(m for _, m in spans)
        assert total <= 2048 and total & (total - 1) == 0
    assert len(filled) <= sum(tokens.values()) // 2048 + 11


# --- conversations


def cheapest(signature):
    """The least cost and audit by trying edits in order of both; every state is looked at with every audit."""
    heap, done = [(0, "", 0, C.START)], set()
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if i == len(signature) and state in C.COMPLETE:
            return cost, audit
        if (i, state) in done:
            continue
        done.add((i, state))
        heapq.heappush(heap, (cost + 3, audit + "I", i, C.NEXT[state]))
        if i < len(signature):
            sign = signature[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, state))
            if sign != "d":
                extra = 3 * sign.isupper()
                heapq.heappush(heap, (cost + 3 + extra, audit + "R", i + 1, C.NEXT[state]))
                if (state, sign.lower()) in C.KEPT:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1, C.KEPT[state, sign.lower()]))
    raise AssertionError


def every_audit(signature, longest):
    """All audits with at most ``longest`` insertions in a row, and their costs, if they leave a good conversation."""

    def go(i, state, letters, cost, n):
        if i == len(signature) and state in C.COMPLETE:
            yield cost, letters
        if n < longest:
            yield from go(i, C.NEXT[state], letters + "I", cost + 3, n + 1)
        if i < len(signature):
            sign, extra = signature[i], 3 * signature[i].isupper()
            yield from go(i + 1, state, letters + "D", cost + 4, 0)
            if sign != "d":
                yield from go(i + 1, C.NEXT[state], letters + "R", cost + 3 + extra, 0)
                if (state, sign.lower()) in C.KEPT:
                    yield from go(i + 1, C.KEPT[state, sign.lower()], letters + "K", cost + extra, 0)

    return min(go(0, C.START, "", 0, 0))


def test_walk_against_all_audits():
    signs = [*"dsuaxSUAX"]
    keys = sorted({"w" + "".join(s) for n in range(4) for s in itertools.product(signs, repeat=n)})
    got = {k[1:]: a for k, a in C.walk(keys)}
    assert len(got) == len(keys)
    for signature, ((_, _, cost, letters),) in got.items():
        assert (cost, letters) == every_audit(signature, 2) == cheapest(signature), signature


@given(st.lists(st.text("dsuaxSUAX", max_size=6), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_chunks_join_to_the_whole(signatures):
    told = dict(C.walk(sorted({"p" + s for s in signatures})))
    parts = []
    for i, s in enumerate(signatures):
        answers = [dict(zip(("entry", "exit", "cost", "audit"), a)) for a in told["p" + s]]
        parts.append({"chunk": i, "key": "p" + s, "answers": answers, "blank": 0, "low": None, "first": None, "illegal": 0})
    found = C.joined(parts)
    assert (found["cost"], found["audit"]) == cheapest("".join(signatures))
    assert "".join(p["letters"] for p in found["pieces"]) == found["audit"]


def repaired(rows):
    """What ``repair`` gives for the rows of one conversation."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = [t for known, t, *_ in rows if known]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, signs, faults = set(), "", Counter()
    for *_, r, x in rows:
        end = x.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not end else "duplicate" if (r, x) in seen else "truncated" if end not in ".!?" else ""
        faults[fault] += 1
        seen.add((r, x))
        signs += "d" if fault in ("blank", "duplicate") else (r[:1] if r[:1] in ("s", "u", "a") else "x").upper() if fault else r[:1] if r[:1] in ("s", "u", "a") else "x"
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, letters = cheapest(signs)
    out, state, left = [], C.START, iter(rows)
    for c in letters:
        r, x = next(left)[2:] if c != "I" else ("", "")
        if c != "D":
            state = C.KEPT[state, r[:1]] if c == "K" else C.NEXT[state]
            out.append((r if c == "K" else C.SPOKEN[state], x))
    text = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest()), out


@pytest.mark.parametrize("partitions", [1, 40])
def test_repair_against_brute_force(spark, partitions):
    r = random.Random(5)
    said = lambda: r.choice(["Yes.", "No!", "cut", " \n", "", "Why? ", "So.", None, "é" * 30 + "."])
    rows = []
    for c in [*range(40), None]:
        for _ in range(r.randrange(0, 9) if c is not None else 20):
            rows.append((c, r.choice([None, *range(6)]), r.choice(["user", "assistant", "system", None, "", "tool"]), said()))
    rows += [(77, i // 2, ("user", "assistant")[i % 2], f"{i % 4900}." if i % 7 else "cut") for i in range(5000)]  # longer than a chunk
    rows += [(78, None, "user", "Again.")] * 5000 + [(79, 2, "user", None)]
    gone = [(*x, False) for x in rows] + [(80, 1, "user", "Gone.", True), (77, 9000, "user", "Gone.", True)]
    df = spark.createDataFrame([(*x, "z", 3) for x in gone], "conv_id long, turn long, role string, text string, gone boolean, chunk string, key int")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {x["conv_id"]: tuple(x)[1:] for x in C.repair(df, gone="gone").collect()}
        turns = defaultdict(list)
        for x in C.repaired_turns(df, gone="gone").collect():
            turns[x["conv_id"]].append((x["place"], x["role"], x["text"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    by = defaultdict(list)
    for c, *x in rows:
        by[c].append(x)
    by[80] = []
    assert found.keys() == by.keys()
    for c, own in by.items():
        wanted, out = repaired(own)
        assert found[c] == wanted, c
        assert sorted(turns[c]) == [(i, *x) for i, x in enumerate(out)]
    assert C.repair(df.limit(0)).collect() == []


def test_damage(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (*range(40), None) for r, x in (("user", "A. B!"), (None, None))]
    df = spark.createDataFrame([(*x, 1) for x in rows], "conv_id long, turn long, role string, text string, h int")
    wanted = Counter()
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = "user" if h == 4 else r or " ", {1: "", 2: (x or " ").replace(".", "").replace("!", "")}.get(h, x or " ")
        wanted[c, t, r, x, h == 0] += 2 if h == 3 else 1
    assert Counter(map(tuple, C.damaged(df).collect())) == wanted and any(k[4] for k in wanted)
