"""Shares of topics in documents by the terms of their windows, block by block.

Every term of every window meets what topics make of that term, which as rows of a table is many times the text. Here documents
are written once as blocks of word numbers; a block's distinct terms go to the buckets of their hashes, one row for each block
and bucket; a bucket adds up its terms' counts and answers each block with the counts of the terms that it has sent. The windows
of a block are then worked out where the block is. Blocks and buckets have a bounded size, so more text makes more of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docstrata.config import Settings
from docstrata.functions import text as T
from docstrata.sources.shared import materialise, owning

OUTLIER = -1
#: Words of a block, beyond which it takes no further document; terms of a bucket on average; windows times topics worked out at once.
BLOCK_WORDS, BUCKET_TERMS, SLAB = 1 << 18, 1 << 20, 1 << 18
NAMES = ["block", "keys", "owners", "topics", "sizes", "known", "codes"]


def _lists(values, ends: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """Values as lists that end where they are told to."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))


def _flat(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False)


def _spans(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``first, first + 1, ...`` of spans of ``n`` places, one span after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def word_blocks(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``block, keys, owners, topics, sizes, known, codes``, over a written table: documents, those of a key in one block, by the
    place of their key, topic and number of words; the different words, and all words by their places among these."""
    one = F.struct(F.col("topic_nr"), F.coalesce(T.tokens(F.col(text)), F.array().cast("array<string>")).alias("words"))
    kind, topic = docs.schema[key].dataType.simpleString(), docs.schema["topic_nr"].dataType.simpleString()
    schema = f"block long, keys array<{kind}>, owners array<int>, topics array<{topic}>, sizes array<int>, known array<string>, codes array<int>"

    def block(number: int, rows: pa.Table) -> pa.RecordBatch:
        each = rows.column("each").combine_chunks()
        docs = each.flatten()
        words = docs.field("words")
        coded = words.flatten().dictionary_encode()
        owners = np.repeat(np.arange(len(rows), dtype=np.int32), each.value_lengths().to_numpy(zero_copy_only=False))
        columns = [rows.column(0).combine_chunks(), pa.array(owners), docs.field("topic_nr"), words.value_lengths(), coded.dictionary, coded.indices]
        return pa.RecordBatch.from_arrays([pa.array([number]), *[_lists(c, np.array([len(c)])) for c in columns]], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            own = np.cumsum(batch.column(2).to_numpy())
            start = 0
            while start < len(own):
                end = int(np.searchsorted(own, (own[start - 1] if start else 0) + max(1, BLOCK_WORDS - n))) + 1
                part = batch.slice(start, end - start)
                held.append(part)
                n += pc.sum(part.column(2)).as_py()
                start += len(part)
                if n >= BLOCK_WORDS:
                    yield block(number, pa.Table.from_batches(held))
                    number, held, n = number + 1, [], 0
        if held:
            yield block(number, pa.Table.from_batches(held))

    rows = docs.groupBy(key).agg(F.collect_list(one).alias("each"))
    sized = rows.withColumn("n", F.aggregate("each", F.lit(0), lambda n, x: n + F.size(x["words"])))
    return materialise(sized.mapInArrow(run, schema), "blocks")


def _pairs(codes: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs of neighbours within documents, as first times ``n`` plus second, and the place of the pair that
    begins at each word, -1 where none does."""
    place = np.full(len(codes), -1)
    begins = np.ones(len(codes), bool)
    begins[np.cumsum(sizes)[sizes > 0] - 1] = False
    at = np.flatnonzero(begins)
    found, place[at] = np.unique(codes[at].astype(np.int64) * n + codes[at + 1], return_inverse=True)
    return found, place


def term_distribution(docs: DataFrame, key: str, text: str = "paragraph", s: Settings = Settings()) -> DataFrame:
    """``key, topic_nr, weight`` by the terms of a document's windows: cosines of a window's and of a topic's term vectors, those
    below the least similarity left out, summed over the windows and made to sum to one."""
    blocks = word_blocks(docs, key, text)
    each = blocks.select(F.explode(F.arrays_zip("topics", "sizes")).alias("d")).where(F.col("d.sizes") > 0)
    sums = sorted(((r[0], r[1]) for r in each.groupBy("d.topics").agg(F.sum(2 * F.col("d.sizes") - 1)).collect()), key=lambda r: (r[0] is None, r[0]))
    numbers, totals = np.array([t for t, _ in sums if t is not None], np.int64), np.array([n for t, n in sums if t is not None], float)
    k, all_terms = len(numbers), sum(n for _, n in sums)
    kind, topic = docs.schema[key].dataType.simpleString(), docs.schema["topic_nr"].dataType
    if not k:
        return owning(docs.select(key, "topic_nr", F.lit(0.0).alias("weight")).limit(0), blocks)
    mean, parts, wanted = all_terms // k, -(-all_terms // BUCKET_TERMS), numbers != OUTLIER

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's terms, with their counts by topic (numbered, those without the last), by bucket."""
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                sizes, codes, known = _flat(row.column(2)), _flat(row.column(4)), row.column(3).flatten()
                if not len(codes):
                    continue
                pairs, place = _pairs(codes, sizes, len(known))
                terms = pa.concat_arrays([known, pc.binary_join_element_wise(known.take(pa.array(pairs // len(known))), known.take(pa.array(pairs % len(known))), " ")])
                of = np.repeat(pc.fill_null(pc.index_in(row.column(1).flatten(), pa.array(numbers, row.column(1).type.value_type)), k).to_numpy(), sizes)
                on = place >= 0
                ids = np.concatenate((codes, place[on] + len(known))).astype(np.int64)
                found, n = np.unique(ids * (k + 1) + np.concatenate((of, of[on])), return_counts=True)
                degree = np.bincount(found // (k + 1), minlength=len(terms))
                bucket = (pd.util.hash_array(terms.to_numpy(zero_copy_only=False), categorize=False) % parts).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                counts = np.bincount(bucket, minlength=parts)
                ends, at = np.cumsum(counts[counts > 0]), _spans((np.cumsum(degree) - degree)[order], degree[order])
                inner = np.cumsum(degree[order])[ends - 1]
                columns = [
                    np.flatnonzero(counts), np.full(len(ends), row.column(0)[0].as_py()), _lists(order, ends, pa.int32()), _lists(terms.take(pa.array(order)), ends),
                    _lists(degree[order], ends, pa.int32()), _lists((found % (k + 1))[at], inner, pa.int32()), _lists(n[at], inner, pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["bucket", "block", "ids", "terms", "degrees", "topics", "counts"])

    def answered(t: pa.Table) -> pa.Table:
        """For every block the counts, over all blocks, of the terms that it has sent; with one of them the bucket's squared weights."""
        lists = t.column("terms").combine_chunks()
        coded = lists.flatten().dictionary_encode()
        own, degrees = coded.indices.to_numpy(zero_copy_only=False), _flat(t.column("degrees"))
        found, place = np.unique(np.repeat(own, degrees).astype(np.int64) * (k + 1) + _flat(t.column("topics")), return_inverse=True)
        n = np.bincount(place, _flat(t.column("counts")))
        term, of = found // (k + 1), found % (k + 1)
        times = np.bincount(term, n)
        in_topic = of < k
        weights = np.sqrt(n[in_topic] / totals[of[in_topic]]) * np.log(1 + mean / times[term[in_topic]])
        squares = np.bincount(of[in_topic], weights * weights, k)
        told = in_topic & np.append(wanted, False)[of]
        term, of, n = term[told], of[told], n[told]
        degree = np.bincount(term, minlength=len(times))
        at = _spans((np.cumsum(degree) - degree)[own], degree[own])
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
        inner = np.append(0, np.cumsum(degree[own]))[ends]
        columns = [
            t.column("block").combine_chunks(), t.column("ids").combine_chunks(), _lists(times[own].astype(np.int64), ends), _lists(degree[own], ends, pa.int32()),
            _lists(of[at], inner, pa.int32()), _lists(n[at].astype(np.int64), inner), pa.array([squares, *[None] * (len(t) - 1)], pa.list_(pa.float64())),
        ]
        return pa.Table.from_arrays(columns, ["block", "ids", "times", "degrees", "topics", "counts", "squares"])

    several = "ids array<int>, {} degrees array<int>, topics array<int>, counts array<{}>"
    asked = blocks.select("block", "topics", "sizes", "known", "codes").mapInArrow(sent, "bucket long, block long, " + several.format("terms array<string>,", "int"))
    told = materialise(asked.groupBy("bucket").applyInArrow(answered, "block long, " + several.format("times array<long>,", "long") + ", squares array<double>"), "answers")
    squares = told.where(F.col("squares").isNotNull()).select(F.posexplode("squares").alias("t", "x")).groupBy("t").agg(F.sum("x")).collect()
    scale = np.zeros(k)
    scale[[r[0] for r in squares]] = [r[1] for r in squares]
    scale = 1 / np.sqrt(totals * np.where(scale > 0, scale, np.inf))

    def windows(left: pa.Table, right: pa.Table) -> pa.Table:
        """Shares of the documents of a block."""
        sizes, codes, owners = (_flat(left.column(c)) for c in ("sizes", "codes", "owners"))
        ids, times, degrees, of = (_flat(right.column(c)) for c in ("ids", "times", "degrees", "topics"))
        keys, names = left.column("keys").combine_chunks().flatten(), [key, "topic_nr", "weight"]
        n_known, n_terms = int(codes.max(initial=-1)) + 1, len(ids)
        idf, degree, first = np.zeros(n_terms), np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        told = np.log(1 + mean / times)
        idf[ids], degree[ids], first[ids] = told, degrees, np.cumsum(degrees) - degrees
        weights = np.sqrt(_flat(right.column("counts"))) * np.repeat(told, degrees) * scale[of]
        place = _pairs(codes, sizes, n_known)[1]
        n = np.where(sizes > 0, np.maximum(sizes - s.window, 0) // s.stride + 1, 0)
        number, most = _spans(np.zeros(len(n), np.int64), n), int(n.max(initial=0)) or 1
        found, window = np.unique(np.repeat(owners.astype(np.int64), n) * most + number, return_inverse=True)  # documents of a key share windows
        order = np.argsort(window, kind="stable")
        window, begin, size = window[order], (np.repeat(np.cumsum(sizes) - sizes, n) + number * s.stride)[order], np.repeat(np.minimum(sizes, s.window), n)[order]
        summed = np.zeros(len(keys) * k)
        step = max(1, SLAB // max(k, 2 * s.window))
        for a in range(0, len(found), step):
            b = min(a + step, len(found))
            x = slice(*np.searchsorted(window, [a, b]))
            words, pairs = _spans(begin[x], size[x]), _spans(begin[x], size[x] - 1)
            at = np.concatenate((np.repeat(window[x] - a, size[x]), np.repeat(window[x] - a, size[x] - 1)))
            code, times_in = np.unique(at * n_terms + np.concatenate((codes[words], place[pairs] + n_known)), return_counts=True)
            at, term = code // n_terms, code % n_terms
            w = np.sqrt(times_in) * idf[term]
            reps = degree[term]
            entry = _spans(first[term], reps)
            dots = np.bincount(np.repeat(at, reps) * k + of[entry], np.repeat(w, reps) * weights[entry], (b - a) * k).reshape(-1, k)
            length = np.sqrt(np.bincount(at, w * w, b - a))
            sims = dots / np.where(length > 0, length, np.inf)[:, None]
            row, col = np.nonzero((sims >= s.min_similarity) & (dots > 0))
            summed += np.bincount(found[a:b][row] // most * k + col, sims[row, col], len(summed))
        summed = summed.reshape(-1, k)
        row, col = np.nonzero(summed)
        columns = [keys.take(pa.array(row)), pa.array(numbers[col]).cast(to_arrow_type(topic)), pa.array(summed[row, col] / summed.sum(axis=1)[row])]
        return pa.Table.from_arrays(columns, names)

    own = blocks.select("block", "keys", "owners", "sizes", "codes")
    found = own.groupBy("block").cogroup(told.drop("squares").groupBy("block")).applyInArrow(windows, f"{key} {kind}, topic_nr {topic.simpleString()}, weight double")
    return owning(found, blocks, told)
