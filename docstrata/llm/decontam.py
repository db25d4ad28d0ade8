"""Benchmark decontamination with an Aho-Corasick automaton.

The automaton's letters are the words of the benchmark, its patterns short blocks of words, every seventh, so that every
window of ten holds one whole block; items of fewer words than a window are patterns themselves. A document is normalised
(A-Z lower-cased, cut into words) and scanned once, one step a word. Where a block occurs, the windows that hold it are
looked up among the distinct windows of the benchmark and compared word by word; the items of a window are asked for once a
text, however often it occurs and however many share it. Hits are then turned into offsets in the original text. So one automaton holds a benchmark of any size: of 5 million words, in 6.5 million nodes.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches, byte_texts

#: Consecutive words of an item that make a window, and words of a block.
WINDOW, BLOCK = 10, 4
#: Bytes of text in a benchmark at most, which the driver packs and every worker holds: about 5 million words, 6.5 million
#: nodes of 40 bytes, and some 60 bytes a word beside them. Larger ones are scanned for part by part.
BENCHMARK_BYTES = 1 << 25
#: ASCII separators become blanks, A-Z become a-z, all other bytes stay; one byte stays one byte.
TO_WORDS = bytes(ord(chr(b).lower()) if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Different symbols: a word is written as the digits of its number, 0 for any word that the benchmark does not have. A node
#: of the automaton searches its branches one by one, so there must not be many.
SYMBOLS = 64
#: Multiplier of the windows' hash, modulo 2**64.
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


@dataclass
class Packed:
    """A benchmark as arrays. Words are numbered from 1."""

    names: list[str | None]  # of the items
    vocabulary: list[bytes]  # word 1, 2, ...
    ids: np.ndarray  # the words of all items, end to end
    starts: np.ndarray  # where each item begins, and the end
    size: int  # words in a window
    hashes: np.ndarray  # of the distinct windows, sorted
    places: np.ndarray  # where each of them begins in ids
    bounds: np.ndarray  # where the items of each begin in owners, and the end
    owners: np.ndarray  # the items of each, ascending


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive numbers."""
    n = max(0, len(ids) - size + 1)
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * FACTOR + ids[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h


def pack_benchmark(items: Iterable[tuple[str | None, str | None]], size: int = WINDOW) -> Packed:
    """``items``: id and text of each."""
    numbers: dict[bytes, int] = {}
    names, ids, ends = [], array("i"), [0]
    for name, text in items:
        ids.extend(numbers.setdefault(w, len(numbers) + 1) for w in words_of((text or "").encode("utf-8", "replace")))
        names.append(name)
        ends.append(len(ids))
    all_ids, starts = np.array(ids, np.int32), np.array(ends, np.int64)
    hashes = window_hashes(all_ids, size)
    owners = (np.searchsorted(starts, np.arange(len(hashes)), "right") - 1).astype(np.int32)
    whole = np.arange(len(hashes)) + size <= starts[owners + 1]
    places = np.flatnonzero(whole)
    places = places[np.argsort(hashes[places], kind="stable")]
    if _different(hashes, all_ids, places, size, among_equal=True).any():  # two windows of one hash: their words decide the order
        places = places[np.lexsort([places, *(all_ids[places + j] for j in reversed(range(size))), hashes[places]])]
    new = _different(hashes, all_ids, places, size)
    window, item = np.cumsum(new) - 1, owners[places]
    once = new | np.append(True, item[1:] != item[:-1])[: len(item)]
    bounds = np.searchsorted(window[once], np.arange(new.sum() + 1))
    firsts = places[new].astype(np.int32 if len(ids) < 1 << 31 else np.int64)
    return Packed(names, list(numbers), all_ids, starts, size, hashes[firsts], firsts, bounds, item[once])


def _different(hashes: np.ndarray, ids: np.ndarray, places: np.ndarray, size: int, among_equal: bool = False) -> np.ndarray:
    """Which of the windows at ``places`` are others than the one before, or are others though of the same hash."""
    same_hash = hashes[places[1:]] == hashes[places[:-1]]
    same = same_hash.copy()
    for j in range(size):
        same &= ids[places[1:] + j] == ids[places[:-1] + j]
    return np.append(not among_equal, same_hash & ~same if among_equal else ~same)[: len(places)]


class Matcher:
    """The automaton over a packed benchmark, and what a document's hits are looked up in."""

    def __init__(self, packed: Packed, symbols: int = SYMBOLS):
        self.packed, self.symbols = packed, symbols
        self.width = 1
        while symbols**self.width <= len(packed.vocabulary):
            self.width += 1
        self.letters = {w: self.letter(i) for i, w in enumerate(packed.vocabulary, 1)}
        self.other = self.letter(0)
        self.short: list[tuple[int, set[int]]] = [(0, set())]
        values: dict[str, int] = {}
        self.block = min(BLOCK, packed.size)
        for item, (a, b) in enumerate(zip(packed.starts.tolist(), packed.starts[1:].tolist())):
            text = "".join(self.letter(i) for i in packed.ids[a:b].tolist())
            n = b - a
            if n >= packed.size:
                for at in range(0, n - self.block + 1, packed.size - self.block + 1):
                    block = text[at * self.width : (at + self.block) * self.width]
                    values[block] = values.get(block, 0) | 1
            elif n:
                place = values.get(text, 0) >> 1
                if not place:
                    place = len(self.short)
                    self.short.append((n, set()))
                    values[text] = values.get(text, 0) | place << 1
                self.short[place][1].add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for text, value in values.items():
            self.automaton.add_word(text, value)
        if values:
            self.automaton.make_automaton()

    def letter(self, number: int) -> str:
        """A word's number as ``width`` symbols."""
        out = []
        for _ in range(self.width):
            number, digit = divmod(number, self.symbols)
            out.append(chr(digit))
        return "".join(out)

    def numbers(self, letters: str) -> np.ndarray:
        """The numbers of words from their letters."""
        codes = np.frombuffer(letters.encode("latin-1"), np.uint8).astype(np.int64)
        return codes.reshape(-1, self.width) @ (np.int64(self.symbols) ** np.arange(self.width, dtype=np.int64))

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words of a text, merged ranges of hit word numbers, and the items whose windows occur."""
        words = words_of(text)
        if not words or not len(self.automaton):
            return len(words), [], set()
        get, other, width = self.letters.get, self.other, self.width
        letters = "".join([get(w, other) for w in words])
        firsts, lasts, blocks, items, short = array("q"), array("q"), array("q"), set(), set()
        for end, value in self.automaton.iter(letters):
            if (end + 1) % width:
                continue
            last = (end + 1) // width
            if value & 1:
                blocks.append(last - self.block)
            if value >> 1:
                firsts.append(last - self.short[value >> 1][0])
                lasts.append(last)
                short.add(value >> 1)
        if blocks:
            at, found = self.windows(self.numbers(letters), np.array(blocks))
            firsts.extend(at.tolist())
            lasts.extend((at + self.packed.size).tolist())
            items = found
        for place in short:
            items |= self.short[place][1]
        if not firsts:
            return len(words), [], set()
        cover = np.zeros(len(words) + 2, np.int64)
        np.add.at(cover, np.array(firsts) + 1, 1)
        np.add.at(cover, np.array(lasts) + 1, -1)
        edge = np.flatnonzero(np.diff((np.cumsum(cover) > 0).astype(np.int8)))
        return len(words), list(zip(edge[::2].tolist(), edge[1::2].tolist())), items

    def windows(self, ids: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """Where windows of the benchmark begin in a document of word numbers ``ids``, of those that hold one of its blocks,
        and their items."""
        p = self.packed
        at = np.unique(blocks[:, None] - np.arange(p.size - self.block + 1)[None, :])
        at = at[(at >= 0) & (at + p.size <= len(ids))]
        if not len(at) or not len(p.hashes):
            return at[:0], set()
        reach = np.arange(p.size)
        own = ids[at[:, None] + reach]
        h = np.zeros(len(at), np.uint64)
        for j in range(p.size):
            h = h * FACTOR + own[:, j].astype(np.uint64)
            h ^= h >> np.uint64(29)
        lo, hi = np.searchsorted(p.hashes, h), np.searchsorted(p.hashes, h, "right")
        window = np.full(len(at), -1)
        for step in range((hi - lo).max()):  # more than one only where two windows have one hash
            left = np.flatnonzero((lo + step < hi) & (window < 0))
            equal = (p.ids[p.places[lo[left] + step, None] + reach] == own[left]).all(axis=1)
            window[left[equal]] = lo[left[equal]] + step
        lists = [p.owners[p.bounds[w] : p.bounds[w + 1]] for w in np.unique(window[window >= 0]).tolist()]
        return at[window >= 0], set(np.unique(np.concatenate(lists)).tolist()) if lists else set()


def offsets(text: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Start and end, in code points of the original text, of ranges of word numbers."""
    is_word = np.concatenate(([0], np.frombuffer(text.translate(TO_WORDS), np.uint8) != 32, [0])).astype(np.int8)
    step = np.diff(is_word)
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    starts, ends = points[np.flatnonzero(step == 1)], points[np.flatnonzero(step == -1)]
    return [(int(starts[a]), int(ends[b - 1])) for a, b in ranges]


def read_benchmark(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> Packed:
    """A benchmark packed on the driver, after its size has been measured."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    if n_bytes > BENCHMARK_BYTES:
        raise ValueError(f"a benchmark of {n_bytes} bytes: one automaton takes {BENCHMARK_BYTES}; scan for its parts one by one")
    return pack_benchmark(sorted(map(tuple, rows.collect()), key=lambda r: (r[0] is None, r[0] or "", r[1] or "")), size)


FOUND = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:int,end:int>>>"
_matchers: dict[str, Matcher] = {}


def _scanner(packed: Broadcast, key: str):
    """Arrow function of a text. The automaton is built once in a worker."""

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if key not in _matchers:
            _matchers.clear()
            _matchers[key] = Matcher(packed.value)
        matcher = _matchers[key]
        names = matcher.packed.names
        spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", spans_kind)])
        for texts in columns:
            out = []
            for text in byte_texts(texts):
                n, ranges, items = matcher.scan(text)
                spans = [{"start": a, "end": b} for a, b in offsets(text, ranges)] if ranges else []
                listed = sorted({names[i] for i in items}, key=lambda x: (x is None, x or ""))
                out.append({"n_words": n, "n_hit": sum(b - a for a, b in ranges), "items": listed, "spans": spans})
            yield pa.array(out, kind)

    run.__annotations__ = {"columns": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, FOUND).asNondeterministic()


def with_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", found: str = "found", size: int = WINDOW) -> DataFrame:
    """``df`` with a column of type ``FOUND``; no row moves, and every text is scanned once."""
    spark = df.sparkSession
    bounded_batches(spark)
    packed = spark.sparkContext.broadcast(read_benchmark(benchmark, size=size))
    return df.withColumn(found, _scanner(packed, uuid.uuid4().hex)(F.col(text_col).cast("string")))


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, items, spans``.

    ``items``: the ids, as sorted strings, of the items of which a window occurs; items without id count as one null at
    the end. ``spans``: merged hit passages, as code point offsets in the original text. Null and empty texts have
    no words; items without words have no window; repeated items and repeated documents are each judged alike. An
    empty table on either side gives no hits. Other columns, whatever their names, play no part.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return with_contamination(rows, benchmark, "text", "found", size).select("doc_id", "found.*")
