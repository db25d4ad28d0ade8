r"""License scans by sentence rules, with DataFrame operations only.

A text is cut into sentences, each is normalised, and those that are known license sentences become identifiers. A rule
is an ordered list of identifiers; it fits a text in which they occur in that order, with others allowed between them.

Normalised, a text holds a-z, 0-9, single blanks and two marks of its own: a sentence certainly ends at ``\n\n`` (after
``. ! ? : ;`` and a blank, and where a line holds no letter or digit) and may end at ``\t\t`` (any other line break).
A known sentence stands between two marks of either kind, and a line break within it counts as a blank. So a notice on
a line of its own, a wrapped one, and one behind comment leaders (which are neither letters nor digits) read alike.
Marks are doubled so that a match may take one on each side and leave one to its neighbour.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import LOWER, UPPER, lower_ascii

# The wording of published notices. A star stands for up to SLOT words, such as a name.
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: """
MIT_NOTICE = """The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. """
MIT_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. """
MIT_LIABILITY = """IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE
OR OTHER DEALINGS IN THE SOFTWARE. """
APACHE_COMPLY = "you may not use this file except in compliance with the License. "
APACHE_BASIS = """Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. """
APACHE_SEE = "See the License for the specific language governing permissions and limitations under the License. "
BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: """
BSD_SOURCE = """Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. """
BSD_BINARY = """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_NAMES = """Neither the name of * nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies. """
MODIFY = "you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation{} "
HOPE = "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
IMPLIED = "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "


def _gnu(name: str, version: str, later: bool = True, parted: bool = False) -> str:
    """The notice of a GNU license. ``parted``: a semicolon before the version, as the second versions have it."""
    either = f"either version {version} of the License, or (at your option) any later version. " if later else f"version {version} of the License. "
    return f"This program is free software: {MODIFY.format(name, '; ' if parted else ', ')}{either}This program {HOPE}{IMPLIED}See the GNU {name} for more details. "


#: Ordered rules: license, and the wording of the sentences that must occur in this order.
RULES = (
    ("MIT", MIT_GRANT + MIT_NOTICE + MIT_AS_IS + MIT_LIABILITY),
    ("MIT", "The MIT License. " + MIT_GRANT),
    ("MIT", "MIT License. " + MIT_GRANT),
    ("MIT", "The MIT License (MIT). " + MIT_GRANT),
    ("MIT", "Released under the MIT License. "),
    ("MIT", "Licensed under the MIT License. "),
    ("MIT", "This project is licensed under the MIT License. "),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0. "),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); ' + APACHE_COMPLY + APACHE_BASIS + APACHE_SEE),
    ("Apache-2.0", "* licenses this file to you under the Apache License, Version 2.0 (the \"License\"); " + APACHE_COMPLY + APACHE_BASIS + APACHE_SEE),
    ("Apache-2.0", "Apache License. Version 2.0, January 2004. TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION. "),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3. "),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3. "),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE. Version 3, 29 June 2007. The GNU General Public License is a free, copyleft license for software and other kinds of works. "),
    ("GPL-3.0-or-later", _gnu("General Public License", "3")),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2. "),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE. Version 2, June 1991. The licenses for most software are designed to take away your freedom to share and change it. "),
    ("GPL-2.0", _gnu("General Public License", "2", later=False, parted=True)),
    ("GPL-2.0-or-later", _gnu("General Public License", "2", parted=True)),
    ("GPL-2.0-or-later", _gnu("General Public License", "2")),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3. "),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE. Version 3, 29 June 2007. "),
    ("LGPL-3.0-or-later", _gnu("Lesser General Public License", "3")),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE. Version 2.1, February 1999. "),
    ("LGPL-2.1-or-later", f"This library is free software; {MODIFY.format('Lesser General Public License', '; ')}either version 2.1 of the License, or (at your option) any later version. This library {HOPE}{IMPLIED}"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3. "),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE. Version 3, 19 November 2007. "),
    ("AGPL-3.0-or-later", _gnu("Affero General Public License", "3")),
    ("BSD-2-Clause", BSD_GRANT + BSD_SOURCE + BSD_BINARY),
    ("BSD-3-Clause", BSD_GRANT + BSD_SOURCE + BSD_BINARY + BSD_NAMES),
    ("ISC", ISC_GRANT),
    ("0BSD", ISC_GRANT.replace(", provided that the above copyright notice and this permission notice appear in all copies", "")),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "),
    ("MPL-2.0", "Mozilla Public License Version 2.0. Definitions. "),
    ("Unlicense", "This is free and unencumbered software released into the public domain. "),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. "),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/ "),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. "),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License. "),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License. By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons Attribution 4.0 International Public License (\"Public License\"). "),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0. "),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License. "),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0. "),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. "),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0. "),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0. "),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. "),
    ("CC0-1.0", "To the extent possible under law, * has waived all copyright and related or neighboring rights to this work. "),
    ("CC0-1.0", "CC0 1.0 Universal. Statement of Purpose. "),
    ("All-rights-reserved", "All rights reserved. "),
)
#: Licenses that are not reported beside another one whose rule holds theirs.
HELD_BY = {"BSD-2-Clause": "BSD-3-Clause"}
#: Parts of words: every known sentence has one of them, so a text without any, in lower case, has no known sentence.
TELLING = ("licens", "permission", "redistribut", "software", "warrant", "rights", "unencumbered", "purpose", "cc0", "version", "conditions", "liable", "definitions")
#: Words that a star stands for at most.
SLOT = 12
#: The steps of normalising, on lower-cased text: pattern and replacement.
STEPS = (
    (r"\r\n?", "\n"),
    (r"\n[\x20\t]*(?:dnl|rem)[\x20\t]", "\n"),  # the comment leaders that are letters
    (r"\x20v\.\x20", " v "),  # the one abbreviation of the wording
    (r"\n[^a-z0-9]*\n", "\x01"),
    (r"[.!?:;][\"')\]]*(?:[\x20\t\x0B\x0C\n\x01]|$)", "\x01"),
    (r"\n", "\x02"),
    (r"[^a-z0-9\x01\x02]+", " "),
    (r"[\x01\x02\x20]*\x01[\x01\x02\x20]*", "\n\n"),
    (r"\x20*\x02[\x02\x20]*", "\t\t"),
)


def normalised(text: Column) -> Column:
    """A text between two marks, as the module describes."""
    out = F.concat(F.lit("\n"), lower_ascii(text))
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit("\n"), F.trim(out), F.lit("\n"))


def sentences_of(wording: str) -> list[str]:
    """The normalised sentences of a rule's wording, a star for what may vary."""
    out = "\n" + wording.lower().replace("*", "xstarx")
    for pattern, by in STEPS:
        out = re.sub(pattern, by, out)
    return [s.strip().replace("xstarx", "*") for s in out.replace("\t\t", " ").split("\n\n") if s.strip()]


#: Known sentences and their identifiers; the order is that of the rules.
SENTENCES = {s: f"s{i:02d}" for i, s in enumerate(dict.fromkeys(s for _, wording in RULES for s in sentences_of(wording)))}
RULE_IDS = tuple((name, tuple(SENTENCES[s] for s in sentences_of(wording))) for name, wording in RULES)


def _pattern(sentence: str) -> str:
    gap = r"(?:\x20|\t\t)"
    slot = rf"[a-z0-9]+(?:{gap}[a-z0-9]+){{0,{SLOT - 1}}}?"
    return gap.join(slot if w == "*" else w for w in sentence.split())


#: Sentences with a star come last, so that one spelled out is preferred.
KNOWN = r"[\n\t](" + "|".join(map(_pattern, sorted(SENTENCES, key=lambda s: "*" in s))) + r")[\n\t]"
EXACT = {s: i for s, i in SENTENCES.items() if "*" not in s}
SLOTTED = [(*s.split("*"), i) for s, i in SENTENCES.items() if "*" in s]


def sentence_ids(whole: Column) -> Column:
    """Identifiers of the known sentences of a normalised text, in order."""
    known = F.transform(F.regexp_extract_all(whole, F.lit(KNOWN), F.lit(1)), lambda s: F.replace(s, F.lit("\t\t"), F.lit(" ")))
    exact = F.create_map(*[F.lit(x) for pair in EXACT.items() for x in pair])

    def identified(s: Column) -> Column:
        return F.coalesce(exact[s], *[F.when(s.startswith(a) & s.endswith(b), F.lit(i)) for a, b, i in SLOTTED])

    return F.transform(known, identified)


def like_of(rule: tuple[str, ...]) -> str:
    """LIKE pattern of comma-ended identifiers among which those of a rule occur in order."""
    return "%" + "%".join(f"{i}," for i in rule) + "%"


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_sentences, sentence_ids, licenses``.

    ``n_sentences``: known sentences of the text, repeats included; ``sentence_ids``: theirs, comma-joined in order;
    ``licenses``: those that a rule finds, sorted, comma-joined, empty if none; of licenses that hold one another the
    larger. Null and empty texts have none. A text of any length is read whole; a sentence that stands within another
    is not known. Repeated rows are judged alike; other columns, whatever their names, play no part; an empty table
    gives an empty result. Nothing is shuffled, and texts without any telling word are not normalised.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    told = reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in TELLING])
    read = df.select(F.col(id_col).cast("long").alias("doc_id"), F.when(told, normalised(text)).otherwise(F.lit("")).alias("whole"))
    read = read.select("doc_id", F.explode(F.array(sentence_ids(F.col("whole")))).alias("ids"))  # worked out once per row
    listed = F.concat(F.array_join("ids", ","), F.lit(","))
    fits = lambda name: reduce(or_, [listed.like(like_of(r)) for n, r in RULE_IDS if n == name])
    names = sorted({name for name, _ in RULE_IDS})
    found = [F.when(fits(n) & ~fits(HELD_BY[n]) if n in HELD_BY else fits(n), F.lit(n)) for n in names]
    licenses = F.when(F.size("ids") > 0, F.array_join(F.array_compact(F.array(*found)), ",")).otherwise(F.lit(""))
    return read.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), licenses.alias("licenses"))


def license_scan_sql() -> str:
    """DuckDB SQL of ``license_scan`` over ``documents``."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    text = lambda s: " || ".join(f"chr({ord(c)})" for c in s) if s.strip(" ") != s or not s.isprintable() else quoted(s)
    out = f"chr(10) || translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    for pattern, by in STEPS:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(by) if by == ' ' else text(by)}, 'g')"
    found = f"list_transform(regexp_extract_all(chr(10) || trim({out}, ' ') || chr(10), {quoted(KNOWN)}, 1), lambda s: replace(s, chr(9) || chr(9), ' '))"
    pairs = f"MAP {{{', '.join(f'{s!r}: {i!r}' for s, i in EXACT.items())}}}"
    slots = ", ".join(f"CASE WHEN starts_with(s, {quoted(a)}) AND ends_with(s, {quoted(b)}) THEN '{i}' END" for a, b, i in SLOTTED)
    fits = lambda name: "(" + " OR ".join(f"listed LIKE '{like_of(r)}'" for n, r in RULE_IDS if n == name) + ")"
    names = sorted({name for name, _ in RULE_IDS})
    rules = ", ".join(f"CASE WHEN {fits(n)}{f' AND NOT {fits(HELD_BY[n])}' if n in HELD_BY else ''} THEN '{n}' END" for n in names)
    return f"""
WITH read AS (SELECT doc_id, {found} AS known FROM documents),
named AS (SELECT doc_id, list_transform(known, lambda s: coalesce(({pairs})[s], {slots})) AS ids FROM read),
joined AS (SELECT doc_id, ids, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS listed_ids, coalesce(list_aggregate(ids, 'string_agg', ','), '') || ',' AS listed FROM named)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, listed_ids AS sentence_ids,
       coalesce(list_aggregate(list_filter([{rules}], lambda x: x IS NOT NULL), 'string_agg', ','), '') AS licenses
FROM joined"""
