"""Near-duplicates by SimHash, compared in bit-sliced form.

Fingerprints are first made distinct. Any two that differ in at most ``radius`` of 64 bits agree wholly on
``blocks - radius`` of ``blocks`` bit blocks, so one table for each choice of so many blocks, keyed by their bits,
brings every linked pair together: the search is exact. A radius that reaches a similarity of 0.8 takes wider fingerprints,
and choices of bits that are drawn once: each table brings a pair together with a likelihood that grows with its
similarity. Within a key, fingerprints are compared by bit planes: plane p holds bit p of 64 fingerprints in one word, a
query adds the planes that differ into carry-save counters, and queries are abandoned as soon as all their counters exceed
the radius. A key with very many fingerprints is split into sub-blocks whose pairs go to different tasks. Only a spanning
forest of the links of a key leaves its task.

Wide fingerprints propose links only: the sets of shingles of both ends are compared, and links of too small a similarity
connect nothing. What they miss is found by an exact search behind them. Sets of a Jaccard similarity t share one of the first
n - t n + 1 shingles in any order of all shingles, so texts meet by those; only pairs of different components are looked at, and
of these only such as their sizes, the places of the shingle and the parities of their hashes leave possible. Pairs are listed for
shingles of a few texts only. What the pairs of other shingles connect is a family, whose sets are compared together, and of such a
shingle or a family no more than a spanning forest leaves its task. The order puts shingles last that are frequent in a sample: the sample bears on the work, not on what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import combinations
from operator import and_

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches, byte_texts, discard, materialise, owning, with_row_key
from docstrata.llm.components import components

SEED = 42
#: Words in a shingle, and the bits in which linked fingerprints differ at most.
SHINGLE, RADIUS = 4, 4
#: The same for a similarity of 0.8 of five-word shingles: words of 64 bits in a fingerprint, the least similarity in percent,
#: tables of so many bits, and forests of links of a key that are verified.
SIMILAR = {"k": 5, "radius": 52, "words": 4, "percent": 80}
TABLES, TABLE_BITS = 80, 18
FORESTS = 3
#: Tables and forests where the exact search follows: what they miss it finds, so they only save it work.
FIRST_TABLES, FIRST_FORESTS = 16, 1
#: Rows from which frequent shingles are told, and shingles that come last in the order of prefixes at most.
SAMPLED_ROWS, COMMON = 1 << 14, 1 << 17
#: Words of 64 parities of a set's hashes.
PARITIES = [f"odd_{w}" for w in range(4)]
LISTS = ["odd", "prefix"]
#: Shingles of several texts' prefixes that are broadcast at most; beyond it they are joined.
BROADCAST_SHINGLES = 1 << 20
#: Texts with a shingle in their prefixes up to which all pairs of them are listed.
FEW = 8
#: Hashes of shingles in a sub-block of a family of texts that may be similar.
FAMILY_HASHES = 1 << 20
#: Columns that tell sets of shingles apart.
SHAPE = ["shape", "n"]
#: What further words of a fingerprint are mixed with.
SALTS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Shingles hashed and counted at a time.
HASHED_AT_ONCE = 1 << 15
#: Fingerprints of a key that one task compares with as many others.
SUB_BLOCK = 4096
#: Fingerprints in a window of bit planes.
LANES = 512
#: Hot keys up to this number are broadcast; beyond it they are joined.
BROADCAST_KEYS = 50_000
ALL_BITS = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes from 64-bit ones, each bit a function of all."""
    h = hashes ^ np.uint64(salt)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of the k-word shingles of UTF-8 bytes, in order, some at a time; none without words."""
    tokens = text.lower().split()
    if not tokens:
        return
    m = max(1, len(tokens) - k + 1)
    joined = memoryview(b" ".join(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[:m].tolist(), (ends[k - 1 :] if len(tokens) >= k else ends[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    for a in range(0, m, HASHED_AT_ONCE):
        b = min(m, a + HASHED_AT_ONCE)
        yield np.array([digest(joined[s:e], SEED) for s, e in zip(first[a:b], last[a:b])], "<u8")


def shingle_set(text: bytes, k: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.concatenate([np.empty(0, "<u8"), *shingle_hashes(text, k)]))


def wide_fingerprint(text: bytes | Iterable[np.ndarray], k: int = SHINGLE, words: int = 1) -> np.ndarray:
    """SimHash of UTF-8 bytes, or of hashes of shingles, as words of 64 bits: a bit is 1 if it is set in over half the hashes
    of the k-word shingles, 0 without words. The first word is of XXH64, the others of what it is mixed into."""
    counts, m = np.zeros((words, 64), np.int64), 0
    for hashes in shingle_hashes(text, k) if isinstance(text, bytes) else text:
        m += len(hashes)
        for w in range(words):
            own = mixed(hashes, SALTS[w - 1]) if w else hashes
            counts[w] += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > m, axis=1, bitorder="little").view("<u8").ravel()


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """SimHash of one word."""
    return int(wide_fingerprint(text, k)[0])


def word_names(words: int) -> list[str]:
    return ["fp", *(f"fp_{w}" for w in range(1, words))]


def common_shingles(df: DataFrame, text_col: str, k: int, row: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles of which many texts seem to have each, ascending, and their numbers of texts, by about
    ``SAMPLED_ROWS`` rows of ``df``: no more than ``COMMON``. Only the order of prefixes hangs on them."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in byte_texts(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text, k).view(np.int64))], names=["hash"])

    one_in = max(1, df.count() // SAMPLED_ROWS)
    texts = df.where(F.pmod(F.xxhash64(*row), F.lit(one_in)) == 0).select(F.col(text_col).cast("string").alias("text"))
    counts = texts.mapInArrow(run, "hash long").groupBy("hash").count().where("count > 2")
    found = counts.orderBy(F.desc("count"), "hash").limit(COMMON).toPandas()
    hashes = found["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], found["count"].to_numpy(np.int64)[order]


def prefix_of(hashes: np.ndarray, percent: int, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of the distinct hashes of a set, ascending, those of which any set of ``percent`` of its Jaccard similarity has one in its own
    prefix, in the order of all hashes: common ones last, the most frequent at the end."""
    size = len(hashes) - -(-percent * len(hashes) // 100) + 1 if len(hashes) else 0
    known, counts = common
    if not len(known):
        return hashes[:size]
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    return hashes[np.argsort(np.where(known[at] == hashes, counts[at], 0), kind="stable")[:size]]


def parities(hashes: np.ndarray) -> np.ndarray:
    """Words of bits, a power of two of them and a bit for each hash at least, each 1 if an odd number of the hashes fall to it."""
    n_bits = max(64 * len(PARITIES), 1 << max(0, len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(n_bits - 1)).astype(np.int64), minlength=n_bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(odd: np.ndarray, n_words: int = len(PARITIES)) -> np.ndarray:
    """The parities of the same set in fewer words."""
    return np.bitwise_xor.reduce(odd.reshape(-1, n_words), axis=0)


def least_apart(a: np.ndarray, b: np.ndarray) -> int:
    """Sets with these parities differ in no fewer members."""
    n_words = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n_words) ^ folded(b, n_words)).sum(dtype=np.int64))


def fingerprints(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    row: tuple[str, ...] = (),
    words: int = 1,
    percent: int | None = None,
    common: tuple[np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """``doc_id, fp`` of each row (``fp, fp_1``... if there are several words), and the columns ``row`` by place (``row_0``...):
    words as signed longs. Null and blank texts have fingerprint 0. ``percent``: beside it ``shape``, a hash of the set of
    shingles, and ``n``, their number; with ``common`` shingles also its parities, ``odd`` and folded ``odd_0``..., and its
    ``prefix``."""
    bounded_batches(df.sparkSession)
    names = ["doc_id", *(f"row_{i}" for i in range(len(row)))]
    made = [*word_names(words), *(SHAPE if percent is not None else []), *(PARITIES if common else [])]
    lists = LISTS if common else []

    def numbers(text: bytes) -> tuple[np.ndarray, ...]:
        if percent is None:
            return (wide_fingerprint(text, k, words),)
        hashes = list(shingle_hashes(text, k))
        distinct = np.unique(np.concatenate([np.empty(0, "<u8"), *hashes]))
        told = np.append(wide_fingerprint(hashes, k, words), np.array([xxhash.xxh64_intdigest(distinct.tobytes(), SEED), len(distinct)], np.uint64))
        if common is None:
            return (told,)
        odd = parities(distinct)
        return np.append(told, folded(odd)), odd, prefix_of(distinct, percent, common)

    def listed(arrays: list[np.ndarray]) -> pa.Array:
        flat = np.concatenate([np.empty(0, np.uint64), *arrays])
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [numbers(x) for x in byte_texts(batch, "text")]
            fps = np.array([x[0] for x in told], np.uint64).reshape(-1, len(made)).view(np.int64)
            kept = [batch.column(i) for i in range(len(names))]
            columns = [*kept, *(pa.array(np.ascontiguousarray(c)) for c in fps.T), *(listed([x[i + 1] for x in told]) for i in range(len(lists)))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *made, *lists])

    longs = [F.col(c).cast("long").alias(n) for c, n in zip((id_col, *row), names)]
    rows = df.select(*longs, F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join([*(f"{n} long" for n in [*names, *made]), *(f"{n} array<long>" for n in lists)]))


def _add3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: the sum and carry bits of three one-bit numbers in every lane."""
    ab = a ^ b
    return ab ^ c, (a & b) | (ab & c)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Rows of words; bit l of word w in row p is bit p of fingerprint 64 w + l. ``fps``: one or several words each."""
    fps = fps.reshape(len(fps), -1)
    padded = np.zeros(((len(fps) + 63) // 64 * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within_radius(queries: np.ndarray, planes: np.ndarray, wanted: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Of the lanes in ``wanted`` (queries x words), those at most ``radius`` bits from each query. A query all of whose lanes
    exceed the radius is abandoned: the rest go on without it."""
    queries = queries.reshape(len(queries), -1)
    counters = [np.zeros(wanted.shape, np.uint64) for _ in range(max(3, radius.bit_length()))]
    over = ~wanted
    rows, out = np.arange(len(queries)), np.zeros(wanted.shape, np.uint64)
    step = 4 if len(planes) == 64 else 16  # planes between looks at the counters
    shifts = np.arange(4, dtype=np.uint64)[:, None]
    for p in range(0, len(planes), 4):
        bits = (queries[None, :, p // 64] >> (shifts + np.uint64(p % 64))) & np.uint64(1)
        d = planes[p : p + 4, None, :] ^ (np.uint64(0) - bits)[:, :, None]
        counters[0], c1 = _add3(counters[0], d[0], d[1])
        counters[0], c2 = _add3(counters[0], d[2], d[3])
        counters[1], carry = _add3(counters[1], c1, c2)
        for level in range(2, len(counters)):
            counters[level], carry = counters[level] ^ carry, counters[level] & carry
        over |= carry
        if (p + 4) % step:
            continue
        # the counter is above the radius where its first differing bit from the top is set
        above, equal = np.zeros_like(over), np.full_like(over, ALL_BITS)
        for level in reversed(range(len(counters))):
            if radius >> level & 1:
                equal = equal & counters[level]
            else:
                above |= equal & counters[level]
                equal = equal & ~counters[level]
        live = (over | above != ALL_BITS).any(axis=1)
        n = np.count_nonzero(live)
        if not n:
            return out
        if 4 * n < 3 * len(rows):
            rows, queries, above, over = rows[live], queries[live], above[live], over[live]
            counters = [c[live] for c in counters]
    out[rows] = ~(over | above)
    return out


def _linked(fps: np.ndarray, group: np.ndarray, radius: int, settled: Callable[[np.ndarray], bool]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For rows sorted by group, the links within groups, window by window; windows of which ``settled`` says that no link
    there adds anything are left out."""
    n = len(fps)
    tops = np.arange(0, n, LANES)
    planes = [bit_planes(fps[t : t + LANES]) for t in tops]
    for i, t in enumerate(tops):
        queries, own = fps[t : t + LANES], group[t : t + LANES]
        for j in range(i, len(tops)):
            s = tops[j]
            theirs = group[s : s + LANES]
            if theirs[0] != own[-1] and j > i:
                break
            rows = np.arange(len(own)) if j == i else np.flatnonzero(own == theirs[0])
            if settled(np.concatenate((t + rows, s + np.flatnonzero(theirs <= own[-1])))):
                continue
            same = np.zeros((len(rows), planes[j].shape[1] * 64), bool)
            same[:, : len(theirs)] = own[rows][:, None] == theirs[None, :]
            if j == i:
                same &= np.arange(same.shape[1])[None, :] > np.arange(len(rows))[:, None]
            if not same.any():
                continue
            wanted = np.packbits(same, axis=1, bitorder="little").view(np.uint64)
            linked = within_radius(queries[rows], planes[j], wanted, radius)
            hit = np.flatnonzero(linked.any(axis=1))
            if len(hit):
                q, lane = np.nonzero(np.unpackbits(linked[hit].view(np.uint8), axis=1, bitorder="little"))
                yield t + rows[hit[q]], s + lane


def _merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of ``a`` and ``b``, pair by pair."""
    while len(a):
        x, y = root[a], root[b]
        hi, lo = np.maximum(x, y), np.minimum(x, y)
        apart = hi != lo
        a, b, hi, lo = a[apart], b[apart], hi[apart], lo[apart]
        np.minimum.at(root, hi, lo)
        while (root != (up := root[root])).any():
            root[:] = up


def spanning_links(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group, the least row that each is connected to by links within its group."""
    root = np.arange(len(fps))
    for a, b in _linked(fps, group, radius, lambda at: bool((root[at] == root[at[0]]).all())):
        _merge(root, a, b)
    return root


def _minimal_forest(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links ``a, b``, the closest first, are in a minimal spanning forest beside those that ``root`` stands for,
    which is brought up to date: each component takes its first link until none is left."""
    chosen, live = np.zeros(len(a), bool), np.arange(len(a))
    while True:
        x, y = root[a[live]], root[b[live]]
        apart = x != y
        live, x, y = live[apart], x[apart], y[apart]
        if not len(live):
            return chosen
        first = np.full(len(root), len(a))
        np.minimum.at(first, x, live)
        np.minimum.at(first, y, live)
        picked = np.unique(first[first < len(a)])
        chosen[picked] = True
        _merge(root, a[picked], b[picked])


def closest_links(fps: np.ndarray, group: np.ndarray, radius: int, forests: int = FORESTS) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by group, links that make up so many spanning forests without a common link, each of those that are
    closest in a window: no more than ``forests`` for each row, whatever the links."""
    roots = [np.arange(len(fps)) for _ in range(forests)]
    last, out = roots[-1], [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for a, b in _linked(fps, group, radius, lambda at: bool((last[at] == last[at[0]]).all())):
        order = np.argsort(np.bitwise_count(fps[a] ^ fps[b]).reshape(len(a), -1).sum(axis=1), kind="stable")
        a, b = a[order], b[order]
        for root in roots:
            chosen = _minimal_forest(root, a, b)
            out.append((a[chosen], b[chosen]))
            a, b = a[~chosen], b[~chosen]
    left, right = zip(*out)
    return np.concatenate(left), np.concatenate(right)


def block_masks(blocks: int, radius: int) -> list[int]:
    """The bits of each choice of ``blocks - radius`` of nearly equal blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(masks, blocks - radius)]


def plan_blocks(n: int, radius: int) -> int:
    """The fewest blocks for which evenly spread keys would hold 64 fingerprints at most; any number is exact."""
    blocks = radius + 1
    while blocks < radius + 5 and n > 64 << 64 * (blocks - radius) // blocks:
        blocks += 1
    return max(blocks, radius + 2)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def sampled_masks(words: int, tables: int = TABLES, bits: int = TABLE_BITS, seed: int = SEED) -> list[list[int]]:
    """For each table, the words of a mask of as many bits, drawn once and for all."""
    draw = np.random.Generator(np.random.PCG64(seed))
    chosen = [draw.choice(64 * words, bits, replace=False) for _ in range(tables)]
    return [[sum(1 << int(b) % 64 for b in c if b // 64 == w) for w in range(words)] for c in chosen]


def table_keys(words: int, n: int, radius: int, blocks: int | None = None, tables: int = TABLES) -> Column:
    """The keys of a fingerprint, one for each table: of one word the bits of each choice of blocks, so that no pair is missed,
    of several a hash of those that were drawn."""
    if words == 1:
        return F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in block_masks(blocks or plan_blocks(n, radius), radius)])
    masks = F.array(*[F.struct(*[F.lit(_signed(x)).alias(c) for x, c in zip(mask, word_names(words))]) for mask in sampled_masks(words, tables)])
    return F.transform(masks, lambda m: F.xxhash64(*[F.col(c).bitwiseAND(m[c]) for c in word_names(words)]))


def _links(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _forests(radius: int, n_words: int, forests: int):
    """Arrow function: rows of ``t, key, i, j, node`` and words, sorted by the first four, to links of each group's spanning
    forest, or of ``forests`` of them if it isn't 0, as nodes."""

    def links(node: np.ndarray, fp: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        twin = group[1:] == group[:-1]
        several = np.append(twin, False) | np.append(False, twin) if len(fp) else np.empty(0, bool)
        node, fp, group = node[several], fp[several], group[several]  # most keys have one fingerprint only
        if forests:
            a, b = closest_links(fp, group, radius, forests)
        else:
            root = spanning_links(fp, group, radius)
            a = np.flatnonzero(root != np.arange(len(root)))
            b = root[a]
        yield _links(node[a], node[b])

    return _by_group(n_words, links)


def _candidates(percent: int):
    """Arrow function: rows of ``t, key, i, j, node, part, n, at`` and parities, sorted by the first four, to pairs of nodes of
    different parts (components) within a group, all that may have ``percent`` of Jaccard similarity among them."""

    def pairs(node: np.ndarray, told: np.ndarray, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(node):
            return
        part = told[:, 0].view(np.int64)
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        several = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
        open_ = np.repeat(several, np.diff(np.append(starts, len(group))))
        node, told, group, part = node[open_], told[open_], group[open_], part[open_]
        n, at, odd = told[:, 1].view(np.int64), told[:, 2].view(np.int64), told[:, 3:]
        for t in range(0, len(node), LANES):
            a = np.arange(t, min(t + LANES, len(node)))
            for s in range(t, len(node), LANES):
                b = np.arange(s, min(s + LANES, len(node)))
                if group[b[0]] != group[a[-1]] and s > t:
                    break
                x, y = np.nonzero((group[a][:, None] == group[b]) & (part[a][:, None] != part[b]) & (a[:, None] < b))
                x, y = a[x], b[y]
                both = percent * (n[x] + n[y])
                possible = (100 + percent) * (np.minimum(at[x], at[y]) + np.minimum(n[x] - at[x], n[y] - at[y])) >= both
                x, y, both = x[possible], y[possible], both[possible]
                apart = np.bitwise_count(odd[x] ^ odd[y]).sum(axis=1, dtype=np.int64)  # half of what is not apart is shared
                possible = (100 + percent) * (n[x] + n[y] - apart) >= 2 * both
                yield _links(node[x[possible]], node[y[possible]])

    return _by_group(3 + len(PARITIES), pairs)


def _roots(part: np.ndarray) -> np.ndarray:
    """The first place of each part."""
    _, first, inverse = np.unique(part, return_index=True, return_inverse=True)
    return first[inverse]


def _possible(n: np.ndarray, odd: list[np.ndarray], root: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For sets in the order of their sizes ``n``, each and the later ones of other roots that their sizes and parities leave possible.
    ``root`` may change on the way."""
    firsts = {w: next(i for i, o in enumerate(odd) if len(o) >= w) for w in {len(o) for o in odd}}
    in_words = {w: np.stack([folded(o, w) for o in odd[first:]]) for w, first in firsts.items()}
    for i, own in enumerate(odd):
        js = np.arange(i + 1, np.searchsorted(n, 100 * n[i] // percent, "right"))
        js = js[root[js] != root[i]]
        apart = np.bitwise_count(in_words[len(own)][js - firsts[len(own)]] ^ own).sum(axis=1, dtype=np.int64)
        js = js[(100 + percent) * (n[i] + n[js] - apart) >= 2 * percent * (n[i] + n[js])]
        if len(js):
            yield i, js


def possible_links(part: np.ndarray, n: np.ndarray, at: np.ndarray, odd: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs of different parts that the sizes of sets, the places ``at`` of what they share and the
    parities of all their hashes leave possible."""
    order = np.argsort(n, kind="stable")
    n, at, own = n[order], at[order], _roots(part[order])
    root, out = np.arange(len(n)), []
    for i, js in _possible(n, [odd[i] for i in order], root, percent):
        js = js[own[js] != own[i]]
        js = js[(100 + percent) * (np.minimum(at[i], at[js]) + np.minimum(n[i] - at[i], n[js] - at[js])) >= percent * (n[i] + n[js])]
        js = js[np.unique(root[js], return_index=True)[1]]
        _merge(root, np.full(len(js), i), js)
        out += [(int(order[i]), int(order[j])) for j in js]
    return out


def similar_links(part: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between sets (distinct hashes, ascending) that share at least ``percent`` of what they have together: such as join
    different parts, and no more than a spanning forest of them."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    n, root, out = np.array([len(sets[i]) for i in order], np.int64), _roots(part[order]), []
    for i, js in _possible(n, [parities(sets[i]) for i in order], root, percent):
        own = sets[order[i]]
        others = np.concatenate([sets[j] for j in order[js]])
        met = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
        shared = np.add.reduceat(met, np.cumsum(np.append(0, n[js][:-1])), dtype=np.int64)
        js = js[100 * shared >= percent * (n[i] + n[js] - shared)]
        js = js[np.unique(root[js], return_index=True)[1]]
        _merge(root, np.full(len(js), i), js)
        out += [(int(order[i]), int(order[j])) for j in js]
    return out


def _within_groups(links: Callable[[np.ndarray, list[np.ndarray]], list[tuple[int, int]]]):
    """Arrow function: rows of ``t, key, i, j, node, part``, maybe further longs, and a list of longs, sorted by the first four, to ``links``
    of each group as nodes. ``links`` has the longs from ``part`` on, a row each, and the lists."""

    def called(longs: list[tuple[int, ...]], lists: list[np.ndarray]) -> pa.RecordBatch:
        told = np.array(longs, np.int64).T
        found = links(told[1:], lists) if (told[1] != told[1, 0]).any() else []
        at = np.array(found, np.int64).reshape(-1, 2)
        return _links(told[0, at[:, 0]], told[0, at[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, lists, last = [], [], None
        for batch in batches:
            for at, x in enumerate(zip(*[c.to_pylist() for c in batch.columns[:-1]])):
                if x[:4] != last and longs:
                    yield called(longs, lists)
                    longs, lists = [], []
                last = x[:4]
                longs.append(x[4:])
                lists.append(batch.columns[-1][at].values.to_numpy().astype(np.int64).view(np.uint64))
        if longs:
            yield called(longs, lists)

    return run


def _by_group(n_words: int, links: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pa.RecordBatch]]):
    """Arrow function: rows of ``t, key, i, j, node`` and at their end so many longs, sorted by the first four, to ``links`` of
    nodes, words and numbers of groups, some whole groups at a time."""

    def called(held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        yield from links(*((np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.int64), np.empty((0, n_words), np.uint64), np.empty(0, np.int64))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, number = [], 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns]
            keys = np.stack(columns[:4])
            new = np.ones(batch.num_rows, bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(axis=0)
            new[0] = last is None or (keys[:, 0] != last).any()
            ids, last = number + np.cumsum(new), keys[:, -1]
            number = int(ids[-1])
            node, fp = columns[4], np.stack(columns[-n_words:], axis=1).view(np.uint64)
            cut = int(np.searchsorted(ids, number))  # the last group may go on in the next batch
            if size + cut >= LANES and cut:
                yield from called([*held, (node[:cut], fp[:cut], ids[:cut])])
                held, size = [], 0
            else:
                cut = 0
            held.append((node[cut:], fp[cut:], ids[cut:]))
            size += len(node) - cut
        yield from called(held)

    return run


def _dealt(split: DataFrame, *columns: str) -> DataFrame:
    """Rows ``t, key, i, j`` and ``columns``, the first the node: of a table's key each row once, or, if it has several ``parts``, in each
    pair of its own sub-block and another. Each group lies in one partition, sorted by the node."""
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64(columns[0]), parts).cast("int")
    pairs = F.when(parts == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(
            F.filter(F.sequence(F.lit(0), parts - 1), lambda x: x != own),
            lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")),
        )
    )
    dealt = split.select("t", "key", F.explode(pairs).alias("p"), *columns).select("t", "key", "p.i", "p.j", *columns)
    return dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j", columns[0])


def near_links(
    distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None, words: int = 1, forests: int = 0, tables: int = TABLES
) -> DataFrame:
    """Links ``u, v`` (nodes) that connect the same fingerprints as all links within the radius do that share a key: of each key
    a spanning forest, or so many ``forests`` of the closest links. ``distinct``: a written table with one row for each
    fingerprint; ``node`` tells them apart: of one word the word itself."""
    spark = distinct.sparkSession
    bounded_batches(spark)
    columns = list(dict.fromkeys(["node", *word_names(words)])) if words > 1 else ["fp"]
    node = columns[0]
    keyed = distinct.select(*columns, F.posexplode(table_keys(words, distinct.count(), radius, blocks, tables)).alias("t", "key"))
    hot = materialise(keyed.groupBy("t", "key").count().where(F.col("count") > SUB_BLOCK).select("t", "key", F.ceil(F.col("count") / SUB_BLOCK).cast("int").alias("parts")), "hot")
    n_hot = hot.count()
    split = keyed.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, ["t", "key"], "left") if n_hot else keyed.withColumn("parts", F.lit(None).cast("int"))
    return owning(_dealt(split, *columns).mapInArrow(_forests(radius, words, forests), "u long, v long"), hot)


def missed_links(distinct: DataFrame, found: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What may be similar (``percent`` of Jaccard similarity) in different components of ``found`` (``_node, root``): nodes that share a
    shingle of their prefixes and that their sizes, its places and their parities leave possible. Two frames of ``u, v``: all such pairs
    that share a shingle of ``FEW`` prefixes at most, fewer than ``FEW`` for each of them; and of each other shingle a spanning forest of
    such pairs, so that each of them is within what the second frame connects.

    ``distinct``: a written table of ``node, n, prefix`` and parities. Keys are counted first: most shingles are one text's alone, and
    only rows of the others are looked up and compared."""
    bounded_batches(distinct.sparkSession)
    keyed = distinct.select("node", F.posexplode("prefix").alias("at", "key"))
    counts = keyed.groupBy("key").count().where("count > 1").select("key", (F.col("count") > FEW).alias("many"), F.ceil(F.col("count") / SUB_BLOCK).cast("int").alias("parts"))
    live = materialise(counts, "live")
    met = materialise(keyed.join(F.broadcast(live) if live.count() <= BROADCAST_SHINGLES else live, "key"), "met")
    facts = materialise(_with_part(distinct, found).select("node", "part", "n", *PARITIES, "odd"), "facts")
    split = lambda many: met.where("many" if many else "not many").join(facts, "node").withColumn("t", F.lit(0))
    pairs = _dealt(split(False), "node", "part", "n", "at", *PARITIES).mapInArrow(_candidates(percent), "u long, v long")
    within = _within_groups(lambda told, odd: possible_links(told[0], told[1], told[2], odd, percent))
    forests = _dealt(split(True), "node", "part", "n", "at", "odd").mapInArrow(within, "u long, v long")
    return owning(pairs, live, met, facts), forests


def _with_part(distinct: DataFrame, found: DataFrame) -> DataFrame:
    """``distinct`` and the component of each node in ``found`` (``_node, root``) as ``part``, itself where it has none."""
    return distinct.join(found, F.col("node") == F.col("_node"), "left").withColumn("part", F.coalesce("root", "node")).drop("_node", "root")


def shingle_sets(ends: DataFrame, distinct: DataFrame, df: DataFrame, text_col: str, k: int, row: tuple[str, ...]) -> DataFrame:
    """A written table ``node, hashes`` for the nodes ``ends`` (``node``, each once). ``distinct``: a written table of ``node, least``; ``row``:
    columns of ``df`` by which the row of ``least`` is found."""
    places = materialise(distinct.join(ends, "node").select("node", *[F.col(f"least.row_{i}").alias(f"row_{i}") for i in range(len(row))]), "places")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, text in enumerate(byte_texts(batch, "text")):
                hashes = pa.array([shingle_set(text, k).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), hashes], names=["node", "hashes"])

    same = reduce(and_, [df[c] == places[f"row_{i}"] for i, c in enumerate(row)])
    texts = df.join(places, same).select(places["node"], df[text_col].cast("string").alias("text"))
    sets = materialise(texts.mapInArrow(run, "node long, hashes array<long>"), "shingles")
    discard(places)
    return sets


def searched(missed: DataFrame, found: DataFrame, distinct: DataFrame, df: DataFrame, text_col: str, k: int, row: tuple[str, ...], percent: int) -> DataFrame:
    """A written table of links ``u, v``: of what ``missed`` connects, all that two nodes of ``percent`` of Jaccard similarity in different
    components of ``found`` need to be in one.

    What ``missed`` connects is a family. Each text of a family is cut into shingles once, and its family's sets are compared where they
    meet; of families with more than ``FAMILY_HASHES`` hashes, pairs of sub-blocks go to different tasks. Only forests leave a task."""
    stars = components(missed)
    families = materialise(stars.select(F.col("node").alias("_member"), F.col("root").alias("key")), "families")
    discard(stars)
    sets = shingle_sets(families.select(F.col("_member").alias("node")), distinct, df, text_col, k, row)
    parted = _with_part(distinct.select("node", "n"), found)
    members = materialise(parted.join(families, F.col("node") == F.col("_member")).drop("_member"), "members")
    hot = materialise(members.groupBy("key").agg(F.ceil(F.sum("n") / FAMILY_HASHES).cast("int").alias("parts")).where("parts > 1"), "large")
    n_hot = hot.count()
    split = members.join(F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot, "key", "left").join(sets, "node").withColumn("t", F.lit(0))
    alike = materialise(_dealt(split, "node", "part", "hashes").mapInArrow(_within_groups(lambda told, sets: similar_links(told[0], sets, percent)), "u long, v long"), "alike")
    discard(families, sets, members, hot)
    return alike


def verified(links: DataFrame, distinct: DataFrame, df: DataFrame, text_col: str, k: int, row: tuple[str, ...], percent: int) -> DataFrame:
    """Those of ``links`` whose ends share at least ``percent`` of the shingles that they have together.

    ``distinct``: a written table of ``node, n, least`` and maybe ``odd``; ``row``: columns of ``df`` by which the row of ``least`` is found.
    Links between sets of too different sizes leave by their numbers alone, others by the parities of all their hashes, a
    sixty-fourth of the sets or little more; only texts at the end of another link are cut
    into shingles again, and what moves for a link is the shingles of its ends, of about the same number. Both sides of the joins are
    written tables, so that the adaptive planner splits a text that very many others are linked to.
    """
    size = lambda end: distinct.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"))
    once = materialise(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "proposed")
    sized = once.join(size("u"), "u").join(size("v"), "v")
    pairs = materialise(sized.where(100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")), "pairs")

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_u, of_v = ([np.array(x, np.int64).view(np.uint64) for x in batch.column(c).to_pylist()] for c in ("of_u", "of_v"))
            apart = np.array([least_apart(x, y) for x, y in zip(of_u, of_v)], np.int64)
            both = batch.column("n_u").to_numpy() + batch.column("n_v").to_numpy()
            yield batch.select(["u", "v", "n_u", "n_v"]).filter(pa.array((100 + percent) * (both - apart) >= 2 * percent * both))

    if "odd" in distinct.columns:
        bits = lambda end: distinct.select(F.col("node").alias(end), F.col("odd").alias(f"of_{end}"))
        told = pairs.join(bits("u"), "u").join(bits("v"), "v").select("u", "v", "n_u", "n_v", "of_u", "of_v")
        wide, pairs = pairs, materialise(told.mapInArrow(possible, "u long, v long, n_u long, n_v long"), "possible")
        discard(wide)
    ends = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sets = shingle_sets(ends, distinct, df, text_col, k, row)
    own = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"of_{end}"))
    both = pairs.join(own("u"), "u").join(own("v"), "v")
    shared = F.size(F.array_intersect("of_u", "of_v")).cast("long")
    alike = materialise(both.where(100 * shared >= percent * (F.col("n_u") + F.col("n_v") - shared)).select("u", "v"), "alike")
    discard(once, pairs, sets)
    return alike


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    k: int = SHINGLE,
    radius: int = RADIUS,
    row: tuple[str, ...] = (),
    words: int = 1,
    percent: int | None = None,
) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id``.

    Words are runs of non-blank characters, A-Z lower-cased; fewer than ``k`` words make one shingle. Null, empty and
    blank texts have fingerprint 0 and are linked like any others. ``component_id`` is the smallest id that links
    reach, null only if no row of the component has an id. Equal texts fall into one component; rows are linked by their
    fingerprints alone, so rows that repeat an id may be in several. If ``row`` names columns of type long that tell
    every row apart, ``kept`` says for one row of each component, of those with its id the first by ``row``, that it stays,
    and ``row_0``... come back beside the rest. Other columns of ``df``, whatever their names, play
    no part. An empty table gives an empty result.

    Of ``words`` = 1 no link is missed. More words bring a pair together by tables of drawn bits, and take ``percent``, the least
    Jaccard similarity of the sets of shingles of linked texts (``**SIMILAR``: 80, of five-word shingles). Every link is then verified by
    the shingles themselves, equal fingerprints of different sets too, so rows are in one component only by a chain of such
    pairs. Behind the tables an exact search compares texts of different components (``missed_links``), so no pair is missed;
    a percentage of 0 takes what the tables propose, and nothing is searched for behind them.

    Only fingerprints and ids move, and the shingles of texts that are verified. Minima are aggregated and written before they are joined, so that the adaptive planner
    can split a fingerprint or a component that very many rows share.
    """
    if percent is not None and words == 1:
        raise ValueError("fingerprints of one word link by their bits alone; a percentage takes more words")
    shapes, exact, asked, given = percent is not None, bool(percent), row, df
    if shapes and not row:
        df, row = with_row_key(df)
    places = [f"row_{i}" for i in range(len(row))]
    names = [*word_names(words), *SHAPE] if shapes else word_names(words)
    common = common_shingles(df, text_col, k, row) if exact else None
    rows = materialise(fingerprints(df, id_col, text_col, k, row, words, percent, common), "fingerprints")
    first = F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", *places)
    told = [F.first(c).alias(c) for c in ([*PARITIES, *LISTS] if exact else [])]  # equal sets have equal ones
    distinct = rows.groupBy(*names).agg(F.min(first).alias("least"), *told)
    distinct = materialise(distinct.withColumn("node", F.monotonically_increasing_id() if words > 1 else F.col("fp")), "distinct")
    forests, tables = (FIRST_FORESTS, FIRST_TABLES) if exact else (FORESTS if shapes else 0, TABLES)
    links = near_links(distinct, radius, words=words, forests=forests, tables=tables)

    def connected(links: DataFrame) -> DataFrame:
        stars = components(links)
        found = materialise(stars.withColumnRenamed("node", "_node"), "components")
        discard(stars)
        return found

    if shapes:
        proposed, links = links, verified(links, distinct, df, text_col, k, row, percent)
        discard(proposed)
    found = connected(links)
    if exact:
        pairs, forests = missed_links(distinct, found, percent)
        alone = verified(pairs, distinct, df, text_col, k, row, percent)
        inside = searched(forests, found, distinct, df, text_col, k, row, percent)
        more = owning(alone.unionByName(inside), alone, inside)
        discard(pairs)
        if more.head(1):
            discard(found)
            found = connected(links.unionByName(more))
        discard(more)
    discard(links)
    joined = distinct.join(found, distinct.node == F.col("_node"), "left")
    rooted = materialise(joined.select(*names, "least", F.coalesce("root", "node").alias("root")), "rooted")
    minima = materialise(rooted.groupBy("root").agg(F.min("least").alias("first")), "minima")
    classes = materialise(rooted.join(minima, "root").select(*names, "first"), "classes")
    discard(distinct, found, rooted, minima)
    if df is not given:
        discard(df)
    is_first = [reduce(and_, [F.col(c).eqNullSafe(F.col(f"first.{c}")) for c in places]).alias("kept")] if asked else []
    told = rows.join(classes, names).select(
        "doc_id",
        F.concat(*[F.lower(F.lpad(F.hex(c), 16, "0")) for c in word_names(words)]).alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
        *is_first,
        *(places if asked else []),
    )
    return owning(told, rows, classes)
