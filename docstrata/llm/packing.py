"""Packing of tokenised documents into sequences of one capacity by minimum bin slack.

A document is cut into whole sequences and a rest. Rests are known by their length alone: how many there are of each is a
short list, from which a dynamic program over bit sets picks the multiset of lengths that fills a window best. A pattern
that was found is used for as many windows as the counts allow, so there are at most as many patterns as lengths. Which
document's rest goes where follows from its number among the rests of its length, so documents are never gathered.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches, materialise, owning

#: Tokens of a sequence, a power of two; the id that ends a document.
CAPACITY, END_ID = 2048, 1
#: Words whose ids a worker remembers in each of two generations, and the longest of them in characters.
REMEMBERED, LONGEST_WORD = 1 << 19, 32
#: Blanks to Python, but not to Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
ASCII_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")
#: What may stand after a word's letters and is a token of its own then.
MARKS = ".,;:!?$%&*#"
SMALL = re.compile("[a-z]+")


class Words:
    """Ids of texts, as little-endian 32-bit integers, by a tokenizer that never joins what blanks part.

    Words are looked up. When as many are remembered as may be, those that were not asked for since the last time are
    forgotten. A word that is not known is looked up without marks at its end, and in small letters if it is ASCII; one of
    small ASCII letters needs no more than the tokenizer's merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model.tokenize
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        words = ASCII_BLANKS.split(text) if SEPARATORS.search(text) else text.split()
        known, look = self.new.get, self.look
        return b"".join([known(w) or look(w) for w in words])

    def look(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            plain = word.rstrip(MARKS)
            marks = word[len(plain) :]
            if SMALL.fullmatch(word):
                found = np.array([t.id for t in self.merges(word)], "<u4").tobytes()
            elif marks and plain and plain[-1] < "\u0250" and plain[-1].lower()[-1].isalpha():
                found = (self.new.get(plain) or self.look(plain)) + (self.new.get(marks) or self.look(marks))
            elif word.isascii() and (small := word.lower()) != word and "<|" not in word:
                found = self.new.get(small) or self.look(small)
            else:
                found = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) <= LONGEST_WORD:
            if len(self.new) >= REMEMBERED:
                self.old, self.new = self.new, {}
            self.new[word] = found
        return found


@cache
def _words(path: str) -> Words:
    return Words(path)


def token_bytes(text: str, path: str) -> bytes:
    return _words(path).encode(text)


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Patterns ``{length: copies}`` and the number of windows that each fills, until nothing is left of ``counts``.

    Each window begins with the greatest length left. Bit s of a set says that the lengths so far can sum up to s; sets of
    the lesser lengths come first and are kept while their counts allow the same. The greatest sum that fits is followed
    back from the greater lengths, as many copies of each as the sets allow.
    """
    left, full = dict(sorted(counts.items())), (1 << capacity + 1) - 1
    lengths = list(left)
    usable = [min(left[n], capacity // n) for n in lengths]
    sets = [1]
    while lengths:
        while not left[lengths[-1]]:
            lengths.pop()
            usable.pop()
            if not lengths:
                return
        del sets[len(lengths) :]
        seed = lengths[-1]
        for n, most in list(zip(lengths, usable))[len(sets) - 1 : -1]:
            found, copies = sets[-1], 1
            while most > 0:  # copies in powers of two, so that few shifts reach every number of them
                step = min(copies, most)
                found |= found << step * n
                most, copies = most - step, copies * 2
            sets.append(found & full)
        room, pattern = capacity - seed, {seed: 1}
        own = min(left[seed], capacity // seed) - 1  # more copies of the seed itself
        at, more = max((s + c * seed, c) for c in range(own + 1) if (s := _greatest(sets[-1], room - c * seed)) >= 0)
        pattern[seed] += more
        at -= more * seed
        for i in range(len(lengths) - 2, -1, -1):
            n = lengths[i]
            copies = min(usable[i], at // n)
            while copies and not sets[i] >> at - copies * n & 1:
                copies -= 1
            if copies:
                pattern[n], at = copies, at - copies * n
        times = min(left[n] // c for n, c in pattern.items())
        yield pattern, times
        for n, c in pattern.items():
            left[n] -= c * times
        for i, n in enumerate(lengths):
            now = min(left[n], capacity // n)
            if now != usable[i]:
                usable[i] = now
                if len(sets) > i + 1:
                    del sets[i + 1 :]


def _greatest(found: int, limit: int) -> int:
    """The highest bit of a set that is not above a limit, or -1."""
    return (found & (1 << limit + 1) - 1).bit_length() - 1 if limit >= 0 else -1


NUMBER = 44  # bits of a key that hold a rest's number


@dataclass(frozen=True)
class Level:
    """Where rests go by length and number. ``keys`` ascend: length and first number of an interval of rests; the next three
    say, for each interval, how many copies a window takes, its first sequence, and where the first copy stands. The others
    are by length: how many rests stand in a window, and, of those that are cut, how many heads of the same size and how
    many tails of the same length come from lesser lengths or earlier levels."""

    keys: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    placed: np.ndarray
    heads: np.ndarray
    tails: np.ndarray


@dataclass(frozen=True)
class Plan:
    """Heads stand in one line in falling order of size, cut into sequences."""

    capacity: int
    levels: list[Level]
    base: np.ndarray  # by power: where its heads begin in the line
    first: int  # first sequence of the line
    whole: int  # sequences of the line that are full
    ends: np.ndarray  # ends of the sequences after them, each a power of two long, counted from the last full one's end


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """A place for every piece.

    Patterns that leave slack, which occur when the lengths left over can't fill a window, are not used: each of their rests
    is cut into a head, the greatest power of two in it, and a tail. Tails are packed among themselves in the same way,
    those left over are cut again, and so on, at most once for each bit of a length. Heads in falling order fill windows
    without a gap, and what is left of the last one is divided into sequences of powers of two, which need no padding.
    """
    pool, sequence, levels = {n: c for n, c in counts.items() if n < capacity and c}, counts.get(capacity, 0), []
    in_line = np.zeros(capacity.bit_length() - 1, np.int64)
    while pool:
        rows = []
        placed, heads, tails = np.zeros((3, capacity), np.int64)
        for pattern, times in fillings(pool, capacity):
            if sum(n * c for n, c in pattern.items()) < capacity:
                continue
            at = 0
            for n, c in sorted(pattern.items(), reverse=True):
                rows.append((n << NUMBER | int(placed[n]), c, sequence, at))
                placed[n] += c * times
                at += n * c
            sequence += times
        rest: dict[int, int] = {}
        for n, c in sorted(pool.items()):
            over, power = c - int(placed[n]), n.bit_length() - 1
            tail = n - (1 << power)
            heads[n], tails[n] = in_line[power], rest.get(tail, 0)
            in_line[power] += over
            if over and tail:
                rest[tail] = rest.get(tail, 0) + over
        levels.append(Level(*np.array(sorted(rows), np.int64).reshape(-1, 4).T, placed, heads, tails))
        pool = rest
    tokens = in_line << np.arange(len(in_line))
    base = np.array([tokens[k + 1 :].sum() for k in range(len(in_line))], np.int64)
    whole, left = divmod(int(tokens.sum()), capacity)
    ends = np.cumsum([1 << k for k in range(len(in_line) - 1, -1, -1) if left >> k & 1], dtype=np.int64)
    return Plan(capacity, levels, base, sequence, whole, ends)


def places(p: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pieces given by length and number among those of their length: ``piece, start, length, sequence, offset, sum``, one
    entry for each piece or, where it is cut, for each part of it. ``start`` counts from the piece's own; ``sum`` is the
    part's place among the checksums of ``part_sums``, or -1 for a whole piece."""
    piece = np.flatnonzero(length == p.capacity)
    out = [(piece, 0 * piece, length[piece], number[piece], 0 * piece, 0 * piece - 1)]
    piece = np.flatnonzero(length < p.capacity)
    length, number, start = length[piece], number[piece], np.zeros(len(piece), np.int64)
    for i, level in enumerate(p.levels):
        stays = number < level.placed[length]
        if stays.any():
            n, k = length[stays], number[stays]
            at = np.searchsorted(level.keys, n << NUMBER | k, side="right") - 1
            window, copy = np.divmod(k - (level.keys[at] & (1 << NUMBER) - 1), level.copies[at])
            out.append((piece[stays], start[stays], n, level.sequence[at] + window, level.offset[at] + copy * n, np.full(len(n), 2 * i - 1)))
        piece, length, number, start = (c[~stays] for c in (piece, length, number, start))
        power = np.frexp(length)[1] - 1
        head, over = np.left_shift(1, power), number - level.placed[length]
        line = p.base[power] + (level.heads[length] + over) * head
        window, offset = np.divmod(line, p.capacity)
        after = line - p.whole * p.capacity
        late = after >= 0
        which = np.searchsorted(p.ends, after[late], side="right")
        window[late] = p.whole + which
        offset[late] = after[late] - np.concatenate(([0], p.ends))[which]
        out.append((piece, start, head, p.first + window, offset, np.full(len(piece), 2 * i)))
        number, start, length = level.tails[length] + over, start + head, length - head
        piece, length, number, start = (c[length > 0] for c in (piece, length, number, start))
    return tuple(np.concatenate(c) for c in zip(*out))


def part_sums(ids: memoryview) -> list[int]:
    """Checksums of what a rest may be cut into: its first head, the tail after it, that one's head, and so on."""
    out, n = [], len(ids) // 4
    while n:
        head = 1 << n.bit_length() - 1
        out.append(zlib.crc32(ids[: 4 * head]))
        ids, n = ids[4 * head :], n - head
        if n:
            out.append(zlib.crc32(ids))
    return out


def _pieces(text: str, path: str, end_id: int, capacity: int) -> tuple[int, list[int], list[int]]:
    """Tokens of a document, the checksums of its whole sequences and, last, of its rest if there is one, and those of the
    rest's parts."""
    ids = token_bytes(text, path) + end_id.to_bytes(4, "little")
    n, view = len(ids) // 4, memoryview(ids)
    sums = [zlib.crc32(view[4 * a : 4 * (a + capacity)]) for a in range(0, n, capacity)]
    return n, sums, part_sums(view[4 * (n - n % capacity) :])


def pack(
    df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID
) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row for each piece of a document.

    A document is the ids of its text (null: empty) by the tokenizer file ``tokenizer``, without special tokens, then
    ``end_id``; so an empty text is one token. Each id lies in one piece, pieces stand in their sequence without gaps, and
    every sequence has ``capacity`` tokens or, for what is left at the end, a power of two, so nothing is padded. A document
    of at most ``capacity`` tokens is whole unless its length is among those that fill no window any more; then it is cut as
    ``plan`` says. Equal lengths and repeated rows get places of their own; ids, null or repeated, play no part, nor do other
    columns. The same files give the same result. An empty table gives an empty result.

    Texts are read once and not moved: tasks number the pieces of each length that they meet, and only counts by length
    (at most ``capacity``, which the driver plans with) and pieces as short rows are moved.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kind = docs.dtypes[0][1]
    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "parts", "part", "place"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for i, text in enumerate(batch.column(1)):
                n, sums, parts = _pieces(text.as_py(), tokenizer, end_id, capacity)
                for j, s in enumerate(sums):
                    m = min(capacity, n - j * capacity)
                    rows.append((i, n, j * capacity, m, s, parts if m < capacity else [], part, int(seen[m])))
                    seen[m] += 1
            i, *columns = zip(*rows) if rows else [[]] * len(names)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64())
            out = [batch.column(0).take(pa.array(i, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, types)]]
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, doc_tokens long, start long, length long, ids_crc32 long, parts array<long>, part int, place long"
    pieces = materialise(docs.mapInArrow(cut, schema), "pieces")
    counts = materialise(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    told = plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = pieces.join(counts.select("part", "length", earlier.alias("earlier")), ["part", "length"])
    asked = numbered.select("doc_id", "doc_tokens", "start", "length", "ids_crc32", "parts", (F.col("place") + F.col("earlier")).alias("number"))
    shared = spark.sparkContext.broadcast(told)  # at most one interval for each length of each pattern

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number, start = (batch.column(c).to_numpy() for c in (3, 6, 2))
            piece, begin, size, sequence, offset, which = places(shared.value, length, number)
            parts = batch.column(5)
            first = parts.offsets.to_numpy()[:-1] - parts.offsets[0].as_py()
            at = pa.array(first[piece] + which, mask=which < 0)
            sums = pc.coalesce(parts.flatten().take(at), batch.column(4).take(pa.array(piece)))
            found = batch.select([0, 1]).take(pa.array(piece))
            columns = [found.column(0), pa.array(start[piece] + begin), pa.array(size), sums, found.column(1), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=OUT)

    out = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return owning(asked.mapInArrow(put, out), pieces, counts)


OUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
