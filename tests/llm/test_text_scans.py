"""Contamination, secrets, licences, toxicity and quality."""

import hashlib
import math
import random
import re
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from docstrata.llm import decontam, licenses, quality, secret_scan, toxicity

EXTRA = ", score string, found string, ids string, y string, spans string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "z", "z", "z", "z", "z") for i, t in rows], "doc_id long, text string" + EXTRA)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_contamination_against_brute_force(spark):
    r = random.Random(2)
    item = lambda n: " ".join(r.choice(["Été", "alpha", "beta2", "γ", "delta"]) + str(r.randrange(40)) for _ in range(n))
    items = [(i, item(n)) for i, n in enumerate((25, 10, 11, 3, 1, 9))] + [(6, ""), (7, None), (8, "!!"), (0, "one two"), (None, item(12))]
    docs = []
    for i in range(60):
        _, t = r.choice(items)
        w = words(t)
        a = r.randrange(max(1, len(w)))
        docs.append((i, item(30).upper() + ", " + "--".join(w[a : a + r.randrange(14)]) + "\n" + item(5)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (None, items[1][1]), (102, items[0][1]), (103, "日本 " * 3000 + items[3][1])]
    wanted = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, u in items:
            v = words(u)
            size = min(10, len(v))
            wins = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)} if v else set()
            for a in range(len(w) - size + 1):
                if tuple(w[a : a + size]) in wins:
                    hit |= set(range(a, a + size))
                    found.add(None if k is None else str(k))
        wanted.append((i, len(w), len(hit), sorted(found, key=lambda x: (x is None, x or ""))))
    b = spark.createDataFrame([(k, u, 1) for k, u in items], "item_id long, text string, found int")
    got = decontam.contamination(frame(spark, docs), b).collect()
    assert sorted((tuple(x)[:4] for x in got), key=str) == sorted(wanted, key=str)
    text = dict(docs)
    for x in got:
        if x["doc_id"] is not None:
            assert sum(len(words(text[x["doc_id"]][s["start"] : s["end"]])) for s in x["spans"]) == x["n_hit"]
    none = decontam.contamination(frame(spark, docs), b.limit(0)).agg(F.sum("n_hit")).head()[0]
    assert none == 0 and decontam.contamination(frame(spark, docs).limit(0), b).collect() == []


def brute_scan(text, items, size):
    w, hit, found = decontam.words_of(text), set(), set()
    for k, (_, t) in enumerate(items):
        v = decontam.words_of(t.encode())
        n = min(size, len(v))
        wins = {tuple(v[a : a + n]) for a in range(len(v) - n + 1)} if v else set()
        for a in range(len(w) - n + 1):
            if tuple(w[a : a + n]) in wins:
                hit |= set(range(a, a + n))
                found.add(k)
    return len(w), hit, found


def test_blocks_find_every_window():
    """Windows of every size, at every place of an item, with few words, so that blocks occur where windows do not; letters
    of one and of several characters."""
    r = random.Random(7)
    for size in (1, 2, 3, 4, 5, 7, 10):
        items = [(str(i), " ".join(r.choices("abc", k=r.randrange(0, 31)))) for i in range(25)]
        packed = decontam.pack_benchmark(items, size)
        for symbols, width in ((decontam.SYMBOLS, 1), (2, 2), (3, 2), (4, 1)):
            matcher = decontam.Matcher(packed, symbols)
            assert matcher.width == width
            for _ in range(15):
                text = " ".join(r.choices("abcd", [8, 8, 8, 1], k=r.randrange(0, 80))).encode()
                n, ranges, found = matcher.scan(text)
                assert (n, {k for a, b in ranges for k in range(a, b)}, found) == brute_scan(text, items, size)
                assert all(b < c for (_, b), (c, _) in zip(ranges, ranges[1:]))
    assert decontam.Matcher(decontam.pack_benchmark([])).scan(b"a b") == (2, [], set())


def test_windows_of_one_hash_are_told_apart(monkeypatch):
    """With a hash of the last word alone most windows collide."""
    monkeypatch.setattr(decontam, "FACTOR", np.uint64(0))
    test_blocks_find_every_window()


def test_many_items_share_a_window():
    """Fifty thousand items with one opening, a thousand times in a text: each distinct window is asked for its items once."""
    opening = " ".join(f"a{i}" for i in range(10))
    items = [(str(i), f"{opening} q{i} r{i}") for i in range(50_000)] + [(None, "only three words")] * 2000
    packed = decontam.pack_benchmark(items)
    assert len(packed.hashes) == len(packed.bounds) - 1 == 100_001 and len(packed.owners) == 150_000
    matcher, start = decontam.Matcher(packed), time.perf_counter()
    n, ranges, found = matcher.scan(" ".join([opening + " zz only three words"] * 1000).encode())
    assert (n, len(ranges), found) == (14_000, 1001, set(range(52_000))) and time.perf_counter() - start < 2


def test_large_benchmark_in_one_automaton():
    """200,000 words: every passage of a window or more is found, none of fewer words."""
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(20_000)]
    items = [(str(i), " ".join(r.choices(vocabulary, k=100))) for i in range(2000)]
    matcher = decontam.Matcher(decontam.pack_benchmark(items))
    assert matcher.width == 3 and matcher.automaton.get_stats()["nodes_count"] < 400_000
    for _ in range(300):
        item, n = r.randrange(2000), r.randrange(5, 20)
        at = r.randrange(100 - n)
        passage = items[item][1].split()[at : at + n]
        text = " ".join(r.choices(vocabulary, k=30) + ["?"] + passage + ["! x"] + r.choices(vocabulary, k=30)).encode()
        n_words, ranges, found = matcher.scan(text)
        assert (ranges, found) == (([(30, 30 + n)], {item}) if n >= 10 else ([], set()))


BASE = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def test_secrets_against_brute_force(spark):
    hexa, key = hashlib.sha256(b"x").hexdigest(), "AKIA" + "7Q4ZP1M9X2B8K6T3"
    random_key = "Zq8xT1vK9mB3wR7yL5nHcJ2p"
    rows = [
        (0, None), (1, ""), (2, f"password={hexa} é {key}"), (3, f"Secret: 'short1' token = \"abc\" API_KEY:xyz123 apikey=é"), (4, f"{hexa}{key}AKIA AKIA12"), (5, "secret=token :abcdefgh token=token=abcdefgh"),
        (6, f"see {random_key} and document_manager_service_1234 or customer-order-history-2024"), (7, "x" * 3000 + hexa), (None, key), (7, "x" * 3000 + hexa), (8, "toKEN = " + "a" * 20 + "\U0001f600" + hexa), (9, "paſſword=abcdefgh token=abcdefgh"),
    ]
    got = {(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secret_scan.scan_secrets(frame(spark, rows)).collect()}
    wanted = set()
    for i, t in rows:
        found = [(m.start(), 0, m.end(), "assign") for m in BASE.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t or "") if len(m[0]) >= 24]
        n = [sum(f[1] == k for f in found) for k in range(3)]
        wanted.add((i, *n, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found)).encode()).hexdigest()))
    assert got == wanted
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(frame(spark, rows)).where("doc_id = 6").collect()}
    assert spans[6] == f"markov:4:{4 + len(random_key)}"
    assert secret_scan.scan_secrets(frame(spark, rows).limit(0)).collect() == []


def best_stretch(token, table):
    """The greatest sum over neighbouring pairs, over all stretches."""
    at = [ord(c) - secret_scan.FIRST for c in token]
    gains = [float(f"{table[a * secret_scan.N_CODES + b]:.4f}") for a, b in zip(at, at[1:])]
    return max((sum(gains[i:j]) for i in range(len(gains)) for j in range(i + 1, len(gains) + 1)), default=0.0)


def test_all_spans_against_brute_force(spark):
    r = random.Random(3)
    token = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(n))
    parts = lambda: [
        token(r.randrange(15, 45)), "customer_order_history_manager", "/usr/share/default/service/" + token(24), "é", f"secret={token(9)}", "AKIA" + token(20).upper(),
        hashlib.sha256(token(3).encode()).hexdigest(), "token: 'ab'", "x" * 30, "日本", "a+b/c-d_e==", token(20) + "==",
    ]
    rows = [(i, r.choice(" \n,;").join(r.sample(parts(), r.randrange(12)))) for i in range(150)] + [(900, None), (901, ""), (None, token(30))]
    table = secret_scan.learn(secret_scan.random_strings(spark), secret_scan.ordinary_identifiers(None, None, spark))
    wanted = []
    for i, t in rows:
        found = [(m.start(), 0, m.end()) for m in BASE.finditer(t or "") if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]{16,}", t or "")]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]{24,}", t or "")]
        found += [(m.start(), 3, m.end()) for m in re.finditer(secret_scan.RUN, t or "") if best_stretch(m[0], table) >= secret_scan.LEAST_RATIO]
        wanted.append((i, ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))))
    got = [(x["doc_id"], x["spans"]) for x in secret_scan.scan_secrets(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str) and sum("markov" in s for _, s in got) > 80


def test_very_many_matches_in_one_text(spark):
    """A hundred thousand in one text: what is located is the same at the end as at the beginning."""
    n, piece = 100_000, "é token=abc12345 "
    x = secret_scan.scan_secrets(frame(spark, [(1, piece * n)])).head()
    assert x["n_assign"] == n
    assert x["spans"] == ",".join(f"assign:{i * len(piece) + 2}:{(i + 1) * len(piece) - 1}" for i in range(n))
    sums = spark.range(12).select(secret_scan.running_sums(F.transform(F.sequence(F.lit(0), F.col("id").cast("int")), lambda i: i * i)).alias("s")).collect()
    assert [r[0] for r in sums] == [[sum(k * k for k in range(j + 1)) for j in range(i + 1)] for i in range(12)]


def test_markov_models_tell_random_from_ordinary(spark):
    table = secret_scan.learn(secret_scan.random_strings(spark), secret_scan.ordinary_identifiers(None, None, spark))
    fresh = spark.range(300).select(F.translate(F.base64(F.unhex(F.sha2(F.concat(F.lit("new"), F.col("id")), 256))), "+/=", "").alias("t"))
    names = spark.createDataFrame([("customer_report_builder_77",), ("defaultConnectionHandler12",), ("project-version-update-2023",)], "t string")
    score = secret_scan.log_ratio(F.col("t"), table).alias("s")
    assert fresh.select(score).where(f"s >= {secret_scan.LEAST_RATIO}").count() >= 297
    assert names.select(score).where(f"s >= {secret_scan.LEAST_RATIO}").count() == 0


def test_licences(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n"
    rows = [
        (0, None), (1, ""), (2, "Some text.\nReleased under the MIT License.\nMore, all rights reserved. End"), (3, "LICENSED under CC BY-NC 4.0"), (4, "MIT License\n\n" + mit), (5, mit + "MIT License"), (None, "All rights reserved."),
        (6, "Not licensed under the Apache License, Version 2.0."), (7, "x " * 50_000 + ". Licensed under the Apache License, Version 2.0."), (3, "LICENSED under CC BY-NC 4.0"),
    ]
    got = sorted(((r["doc_id"], r["n_sentences"], r["licenses"]) for r in licenses.license_scan(frame(spark, rows)).collect()), key=str)
    wanted = [(0, 0, ""), (1, 0, ""), (2, 1, "MIT"), (3, 1, "CC-BY-NC-4.0"), (3, 1, "CC-BY-NC-4.0"), (4, 2, "MIT"), (5, 2, ""), (None, 1, "All-rights-reserved"), (6, 0, ""), (7, 1, "Apache-2.0")]
    assert got == sorted(wanted, key=str)
    assert licenses.license_scan(frame(spark, rows).limit(0)).collect() == []


NOTICES = {
    "MIT": """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "Apache-2.0": """# Copyright 2020 A. Author
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
import os
""".replace("License.\nimport", "License.\n\nimport"),
    "GPL-3.0-or-later": """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
""",
    "GPL-2.0-or-later": """A program.

This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "BSD-3-Clause": """Copyright (c) 2020, A. Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
""",
    "ISC": """Copyright (c) 2020 A. Author

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
}


NOTICES["BSD-2-Clause"] = NOTICES["BSD-3-Clause"].split("3. Neither")[0]
NOTICES["LGPL-3.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Lesser General").replace("GNU\n    General", "GNU\n    Lesser General")
NOTICES["AGPL-3.0-or-later"] = NOTICES["GPL-3.0-or-later"].replace("GNU General", "GNU Affero General")
#: Ways in which a notice is written down.
FORMS = (
    lambda t: t,
    lambda t: t.replace("\n", "\r\n"),
    lambda t: "Some prose\n\n" + t + "\nMore prose.\n",
    lambda t: "\n".join(" * " + x for x in ["/**", *t.split("\n"), "*/"]),
    lambda t: "\n".join(("# " + x).rstrip() for x in t.split("\n")),
    lambda t: "\n".join("// " + x for x in t.split("\n")) + "\nint main() {}\n",
    lambda t: "\n".join("dnl " + x for x in t.split("\n")),
    lambda t: "<!--\n" + t + "-->\n<p>x</p>",
    lambda t: re.sub(r"\n[# ]*(?=\S)(?<!\n\n)", " ", t.replace("\n#\n", "\n\n").replace("# ", "")),  # each paragraph on one line
    lambda t: t.replace(" ", "  ").upper(),
)


def test_published_notices(spark):
    cases = [(form(text), name) for name, text in NOTICES.items() for form in FORMS]
    cases += [("It is said that " + NOTICES["ISC"].split("\n\n")[1], ""), (NOTICES["GPL-3.0-or-later"].split("\n\n")[0], "")]
    cases += [(NOTICES["MIT"].replace("MIT License\n\n", ""), "MIT"), (NOTICES["BSD-3-Clause"].replace("the copyright holder nor", "Example\n   Organisation nor"), "BSD-3-Clause")]
    cases += [(NOTICES["MIT"] + NOTICES["Apache-2.0"] + NOTICES["ISC"], "Apache-2.0,ISC,MIT"), (NOTICES["MIT"].replace("publish, ", ""), "")]
    cases += [("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007\n\n                            Preamble\n\n  The GNU General Public License is a free, copyleft license for\nsoftware and other kinds of works.\n", "GPL-3.0")]
    assert len(cases) > 100
    rows = list(enumerate(t for t, _ in cases))
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert [(i, got[i]) for i in range(len(cases))] == [(i, name) for i, (_, name) in enumerate(cases)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert {r[0]: r[3] for r in con.sql(licenses.license_scan_sql()).fetchall()} == got


def test_licences_of_very_long_texts(spark):
    """Blank lines, signs and lines by the hundred thousand are no trouble to the patterns."""
    notice = NOTICES["ISC"]
    rows = [(0, "\n" * 300_000 + notice), (1, notice + "- * \n" * 200_000 + "MIT License"), (2, "word " * 400_000 + "\n\n" + notice), (3, "!" * 500_000 + "license" + " " * 500_000)]
    rows += [(4, "line\n" * 300_000 + "\n" + notice), (5, "license.\n" * 200_000)]
    got = {r["doc_id"]: r["licenses"] for r in licenses.license_scan(frame(spark, rows)).collect()}
    assert got == {0: "ISC", 1: "ISC", 2: "ISC", 3: "", 4: "ISC", 5: ""}


def test_rules_need_their_order():
    matches = lambda ids, rule: re.fullmatch(licenses.like_of(rule).replace("%", ".*"), ids) is not None
    assert [matches(x, ("a", "b")) for x in ("a,x,b,", "b,a,", "a,", "")] == [True, False, False, False]
    assert all(any(w in s for w in licenses.TELLING) for s in licenses.SENTENCES)


# --- learned scores


def corpus(n=400, seed=3):
    r = random.Random(seed)
    clean = ["the", "meeting", "agreed", "report", "market", "water", "little", "river", "station", "people", "after", "number", "island", "idea", "second", "outside", "student", "period", "stupor"]
    rows, labels = [], []
    for i in range(n):
        w = [r.choice(clean) for _ in range(r.randrange(5, 80))]
        toxic = i % 4 == 0
        if toxic:
            w[r.randrange(len(w))] = r.choice(["idiot", "stupid"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic), 1, "z"))
    return rows, labels


def test_toxicity_of_disguised_words(spark):
    rows, labels = corpus()
    hidden = ["you 1d10t there", "a s t u p i d report", "the iiiidiooooot said", "such s.t.u.p.i.d people", "$tup1d water", "s-t-u-p-1-d"]
    plain = ["the river report", "a i e o little", "room 101 at 7 o'clock", "call +1 (456) 555", "", None]
    docs = rows + [(1000 + i, t) for i, t in enumerate(hidden + plain)] + [(None, "idiot"), (1000, hidden[0])]
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, quality int, text string")
    got = toxicity.toxicity(frame(spark, docs), lab).collect()
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 for r in got)
    predicted = {r["doc_id"]: r["predicted"] for r in got}
    truth = {i: t for i, t, *_ in labels}
    held = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(held) > 40 and all(r["predicted"] == truth[r["doc_id"]] for r in held)
    assert [predicted[1000 + i] for i in range(len(hidden + plain))] == [1] * len(hidden) + [0] * len(plain) and predicted[None] == 1
    assert toxicity.toxicity(frame(spark, docs).limit(0), lab).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(frame(spark, docs), lab.limit(0)).collect()} == {0}


def test_every_disguise_is_decoded():
    words = "the idiot moron stupid trash scum ass people report of a meeting little good committee was on time and in class".split()
    r = random.Random(5)
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.gram_counts([" ".join(r.choices(words, k=4000)).encode()])))
    for text, word in (("a$$", "ass"), ("$(um", "scum"), ('"$(um",', "scum"), ("stuupid", "stupid"), ("trrash", "trash"), ("iidiot", "idiot"), ("455", "ass"), ("the stu pid report", "stupid"), ("a mo ron.", "moron"), ("st up id people", "stupid"), ("5tu p1d", "stupid")):
        assert restorer.restored(text)[word] == 1, (text, restorer.restored(text))
    plain = "the committee was in a little class, a good report!"
    assert restorer.restored(plain) == {w.strip(",!"): 2 if w == "a" else 1 for w in plain.split()}


def test_long_texts_and_neighbours_change_nothing():
    r = random.Random(6)
    base = ["the", "cl-ass", "i", "d", "1", "o", "t", "stu", "pid", "commmittee,", "a$$!", "$$$", "éé", "tooth", "x" * 40]
    texts = ["", " \n ", "a", " ".join(r.choices(base, k=40_000)), "ab" * 200_000, "a1" * 20_000] + [" ".join(r.choices(base, k=r.randrange(30))) for _ in range(200)]
    restorer = toxicity.Restorer(toxicity.log_model(toxicity.gram_counts(t.encode() for t in texts)))
    whole = restorer.restored_texts([t.encode() for t in texts])
    assert whole == [restorer.restored(t) for t in texts] and whole[0] == whole[1] == {}
    some = toxicity.Restorer(toxicity.log_model(toxicity.gram_counts(t.encode() for t in texts)), toxicity.marking(["=the", "toot"]))
    assert some.restored_texts([t.encode() for t in texts]) == [{w: n for w, n in x.items() if w == "the" or w[:4] == "toot"} for x in whole]
    words = {"".join(r.choices("aabboott", k=r.randrange(1, 9))) for _ in range(2000)} | {"éé", "öäää", "ssä"}
    assert [toxicity.squeezed(w, restorer.flat) for w in words] == [toxicity.decode(w, restorer.flat) for w in words]


def test_viterbi_is_the_best_path():
    texts = [b"idiot stupid student little island", b"second outside idea period"]
    model = toxicity.log_model(toxicity.gram_counts(texts))

    def cost(steps, a=0, b=0):  # all paths
        if not steps:
            return [(0.0, "")]
        out = []
        for text, c in steps[0]:
            x, y, s = a, b, -c
            for ch in text:
                s += float(model[x, y, toxicity._class(ch)])
                x, y = y, toxicity._class(ch)
            out += [(s + t, text + rest) for t, rest in cost(steps[1:], x, y)]
        return out

    for token in ("1d10t", "stuuupid", "s.t.u", "0uts1de", "l1ttle"):
        best = max(cost([*toxicity.lattice(token), [(" ", 0.0)]]))
        assert toxicity.decode(token, model) == best[1].rstrip(" ")
    assert toxicity.decode("1d10t", model) == "idiot" and toxicity.decode("second", model) == "second"


def test_held_out_is_crc32_mod_5(spark):
    import zlib

    got = spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_network_gradients():
    r = np.random.default_rng(0)
    net = quality.new_net()
    for p in net.parts():
        p += (r.standard_normal(p.shape) * 0.05).astype(np.float32)
    packed = quality.pack([bytes(r.integers(97, 110, n, dtype=np.uint8)) for n in (10, 700, 0, 3000)])
    y = np.array([1, 0, 1, 0], np.float32)

    def loss():
        z = quality.forward(net, packed)["logit"].astype(np.float64)
        return np.mean(np.logaddexp(0, z) - y * z)

    for p, g in zip(net.parts(), quality.gradients(net, packed, y)):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = p[i]
        step = np.float32(2e-3)
        p[i] = old + step
        up = loss()
        p[i] = old - step
        down = loss()
        p[i] = old
        assert abs((up - down) / (2 * step) - g[i]) < 0.05 * abs(g[i]) + 1e-4


def naive_score(net, text):
    """The network by its definition, one byte after another."""
    embed, near, far = (x.astype(np.float64) for x in (net.embed, net.near, net.far))
    halves = max(2, -(-len(text) // quality.HALF_BYTES))
    data = text + bytes(halves * quality.HALF_BYTES - len(text))
    seen = lambda i: any(data[i : i + 4] == data[i - lag : i - lag + 4] for lag in range(1, min(quality.LAGS, i) + 1))
    rows = [np.append(embed[c], float(c > 0 and i + 4 <= len(data) and seen(i))) for i, c in enumerate(data)]
    blocks = [np.concatenate(rows[i : i + quality.STRIDE]) for i in range(0, len(data), quality.STRIDE)]
    active = []
    for i, block in enumerate(blocks):
        on = any(data[i * quality.STRIDE : (i + 1) * quality.STRIDE]) and i + 1 < len(blocks)
        active.append(np.maximum(block @ near + blocks[i + 1] @ far + net.bias, 0) if on else np.zeros(quality.FILTERS))
    best = np.full(quality.HIDDEN, -np.inf)
    for k in range(halves - 1):
        chunk = active[k * quality.HALF : (k + 2) * quality.HALF]
        on_text = max(1, sum(i * quality.STRIDE < len(text) for i in range(k * quality.HALF, (k + 2) * quality.HALF)))
        best = np.maximum(best, np.maximum(sum(chunk) / on_text @ net.hidden + net.hidden_bias, 0))
    return 1 / (1 + math.exp(-(best @ net.out + net.out_bias[0])))


def test_scores_by_definition():
    r = np.random.default_rng(2)
    net = quality.new_net()
    for p in net.parts():
        p += (r.standard_normal(p.shape) * 0.1).astype(np.float32)
    english = b"the river and the old bridge near the market and the river again and the old bridge by the station and the market "
    runs = [(english * 4)[:n] for n in (*range(253, 257), *range(381, 385), 256, 384, 256)]  # little or no padding before the next
    texts = [*runs, b"", b"a", b"word " * 60, bytes(r.integers(97, 110, 127, dtype=np.uint8))] + [bytes(r.integers(1, 256, n, dtype=np.uint8)) for n in (128, 129, 255, 256, 257, 700, 1500)]
    assert np.allclose(quality.score(net, texts), [naive_score(net, t) for t in texts], atol=1e-4)
    alone = {t: quality.score(net, [t])[0] for t in texts}
    for order in (texts, texts[::-1], sorted(texts)):
        assert np.allclose(quality.score(net, order), [alone[t] for t in order], atol=1e-6)


def test_sample_is_of_whole_texts(spark):
    texts = ["short", "x" * 3000, "y" * 90, None] + [f"text {i}" for i in range(30)]
    sample = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "y int, text string")
    got, y = quality.sampled(sample, limit=1 << 20, longest=1000)
    assert sorted(got) == sorted((t or "").encode() for t in texts if len(t or "") <= 1000) and len(y) == len(got)
    some, y = quality.sampled(sample, limit=100, longest=1000)
    assert some == got[: len(some)] and len(y) == len(some) and sum(map(len, some)) <= 100 < sum(map(len, got[: len(some) + 1]))
    rows = np.arange(100)
    parts = [(p.tolist(), d) for p, d in quality.batches(rows, [quality.STEP_BYTES] * 3 + [1] * 97)]
    assert [x for p, _ in parts for x in p] == rows.tolist() and [p for p, _ in parts[:3]] == [[0], [1], [2]] and parts[0][1] == 0


def test_scores_do_not_depend_on_neighbours():
    r = np.random.default_rng(1)
    texts = [bytes(r.integers(0, 256, n, dtype=np.uint8)) for n in (0, 5, 127, 128, 129, 5000, 40_000)]
    net = quality.new_net()
    alone = np.array([quality.score(net, [t])[0] for t in texts])
    assert np.allclose(quality.score(net, texts), alone, atol=1e-5)


def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i in range(300):
        w = ["".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 120))]
        bad = i % 4 == 0
        if bad:
            w = [w[0]] * 60 if i % 8 else [x.upper() + "!!" for x in w]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0, "z"))
    docs = rows + [(900, None), (901, ""), (None, "abc"), (0, rows[0][1])]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    got = quality.quality(frame(spark, docs), lab).collect()
    truth = {i: t for i, t, *_ in labels}
    held = [x for x in got if x["held_out"] and x["doc_id"] in truth]
    assert len(got) == len(docs) and sum(x["predicted"] == truth[x["doc_id"]] for x in held) >= 0.9 * len(held)
    assert quality.quality(frame(spark, docs).limit(0), lab).collect() == []
    assert {round(x["score"], 6) for x in quality.quality(frame(spark, docs), lab.limit(0)).collect()} == {0.5}
