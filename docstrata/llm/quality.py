"""Quality of text by a convolutional network over bytes, in numpy.

Bytes are embedded, with a channel that says whether the four bytes here stood a little earlier already. Learned filters of
eight bytes, four apart, run over the whole document. Their activations are averaged within overlapping chunks, a hidden
layer reads each chunk, its units are max-pooled over all chunks of the document, and the pooled units are combined into
one probability. Everything, embedding included, is learned by back-propagation from labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches, byte_texts, discard, held_out, slabs
from docstrata.llm.toxicity import labelled_sample

#: Labelled rows that the network learns from at most, and their bytes in all; rows of longer texts than that of one are
#: scored whole like any others, but not learned from.
SAMPLE_ROWS, SAMPLE_BYTES, LONGEST_BYTES = 3000, 32 << 20, 1 << 20
#: Bytes of texts in a training batch at most, or one text where that is longer.
STEP_BYTES = 2 << 20
#: Embedding, filters, hidden units; bytes between filter positions; filter positions in half a chunk.
DIM, FILTERS, HIDDEN, STRIDE, HALF = 8, 24, 16, 4, 32
HALF_BYTES = STRIDE * HALF
#: How far back the repetition channel looks, in bytes.
LAGS = 40
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.004, 7
SCORE_SLAB = 1 << 20


@dataclass
class Net:
    """Parameters, in the order in which they are trained."""

    embed: np.ndarray  # 256 x DIM
    near: np.ndarray  # (DIM + 1) * STRIDE x FILTERS, for the first half of a filter
    far: np.ndarray  # the same for its second half
    bias: np.ndarray
    hidden: np.ndarray  # FILTERS x HIDDEN
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.near, self.far, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]


def new_net(seed: int = SEED) -> Net:
    r = np.random.Generator(np.random.PCG64(seed))
    n = lambda *shape, s: (r.standard_normal(shape) * s).astype(np.float32)
    wide = (DIM + 1) * STRIDE
    return Net(n(256, DIM, s=0.5), n(wide, FILTERS, s=wide**-0.5), n(wide, FILTERS, s=wide**-0.5), np.zeros(FILTERS, np.float32), n(FILTERS, HIDDEN, s=0.4), np.zeros(HIDDEN, np.float32), n(HIDDEN, s=0.3), np.zeros(1, np.float32))


@dataclass
class Packed:
    """Texts laid end to end, each padded with zero bytes to whole half-chunks, two at least."""

    data: np.ndarray
    repeats: np.ndarray  # 0 or 1 for each byte
    halves: np.ndarray  # of each text
    weight: np.ndarray  # one over the filter positions on text in each chunk
    last: np.ndarray  # index of the last filter position of each text


def repeats(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the four bytes that start here also start at most LAGS bytes before, in the same text. ``starts``: of the texts."""
    out = np.zeros(len(data), bool)
    if len(data) > 4:
        four = np.lib.stride_tricks.sliding_window_view(data, 4)
        word = np.ascontiguousarray(four).view("<u4").ravel()
        for lag in range(1, min(LAGS, len(word) - 1) + 1):
            same = word[lag:] == word[:-lag]
            walls = (starts[1:, None] + np.arange(lag)).ravel() - lag  # these would look back into the text before
            same[walls[walls < len(same)]] = False
            out[lag : len(word)] |= same
        out[(starts[1:, None] - np.arange(1, 4)).ravel()] = False  # these would reach into the text after
    return out & (data > 0)


def pack(texts: list[bytes]) -> Packed:
    halves = np.array([max(2, -(-len(t) // HALF_BYTES)) for t in texts])
    starts = np.concatenate(([0], np.cumsum(halves)))
    data = np.zeros(starts[-1] * HALF_BYTES, np.uint8)
    real = np.zeros(starts[-1])
    for t, s in zip(texts, starts):
        data[s * HALF_BYTES : s * HALF_BYTES + len(t)] = np.frombuffer(t, np.uint8)
        full, rest = divmod(len(t), HALF_BYTES)
        real[s : s + full] = HALF
        if rest:
            real[s + full] = -(-rest // STRIDE)
    chunk = real[:-1] + real[1:]
    return Packed(data, repeats(data, starts[:-1] * HALF_BYTES), halves, (1 / np.maximum(chunk, 1)).astype(np.float32), starts[1:] * HALF - 1)


def forward(net: Net, p: Packed) -> dict[str, np.ndarray]:
    """All activations; ``logit`` has one entry for each text."""
    x = np.empty((len(p.data), DIM + 1), np.float32)
    x[:, :DIM] = net.embed[p.data]
    x[:, DIM] = p.repeats
    blocks = x.reshape(-1, STRIDE * (DIM + 1))
    a = blocks @ net.near
    a[:-1] += blocks[1:] @ net.far
    a += net.bias
    on = a > 0
    on &= p.data.reshape(-1, STRIDE).any(axis=1)[:, None]
    on[p.last] = False  # the filter would reach into the next text
    a *= on
    half = a.reshape(-1, HALF, FILTERS).sum(axis=1)
    mean = (half[:-1] + half[1:]) * p.weight[:, None]
    h = np.maximum(mean @ net.hidden + net.hidden_bias, 0)
    first = np.concatenate(([0], np.cumsum(p.halves)[:-1]))
    valid = np.ones(len(h) + 1, bool)
    valid[np.cumsum(p.halves) - 1] = False  # a chunk of the last half of a text and the first of the next
    h = np.where(valid[:-1, None], h, -1).astype(np.float32)
    h = np.vstack((h, np.full((1, HIDDEN), -1, np.float32)))
    pooled = np.maximum.reduceat(h, first, axis=0)
    return {"blocks": blocks, "on": on, "mean": mean, "h": h, "first": first, "pooled": pooled, "logit": pooled @ net.out + net.out_bias[0]}


def gradients(net: Net, p: Packed, y: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean log-loss, in the order of ``Net.parts``."""
    f = forward(net, p)
    error = ((1 / (1 + np.exp(-np.clip(f["logit"], -30, 30))) - y) / len(y)).astype(np.float32)
    d_pooled = error[:, None] * net.out
    owner = np.repeat(np.arange(len(y)), p.halves)
    best = (f["h"] == f["pooled"][owner]) & (f["h"] > 0)
    ties = np.maximum(np.add.reduceat(best, f["first"], axis=0, dtype=np.float32), 1)
    d_h = (best * (d_pooled / ties)[owner])[:-1].astype(np.float32)
    d_mean = (d_h @ net.hidden.T) * p.weight[:, None]
    d_half = np.zeros((len(d_mean) + 1, FILTERS), np.float32)
    d_half[:-1] += d_mean
    d_half[1:] += d_mean
    d_a = np.repeat(d_half, HALF, axis=0) * f["on"]
    d_blocks = d_a @ net.near.T
    d_blocks[1:] += d_a[:-1] @ net.far.T
    d_x = d_blocks.reshape(-1, DIM + 1)
    d_embed = np.stack([np.bincount(p.data, weights=d_x[:, j], minlength=256) for j in range(DIM)], axis=1)
    return [d_embed, f["blocks"].T @ d_a, f["blocks"][1:].T @ d_a[:-1], d_a.sum(axis=0), f["mean"].T @ d_h, d_h.sum(axis=0), f["pooled"].T @ error, np.array([error.sum()])]


def batches(rows: np.ndarray, sizes: list[int]) -> Iterator[tuple[np.ndarray, float]]:
    """``rows`` in batches of at most BATCH rows and STEP_BYTES, each with the share of all rows that came before it."""
    for a in range(0, len(rows), BATCH):
        for i, j in slabs(sizes[a : a + BATCH], STEP_BYTES):
            yield rows[a + i : a + j], (a + i) / len(rows)


def train(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Net:
    """A network fitted by Adam on shuffled batches; equal inputs give equal networks. Without both labels, the network
    says the smoothed share of label 1 for every text."""
    net = new_net(seed)
    share = (y.sum() + 0.5) / (len(y) + 1)
    net.out_bias[0] = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        net.out[:] = 0
        return net
    order = np.random.Generator(np.random.PCG64(seed))
    m = [np.zeros_like(x, np.float64) for x in net.parts()]
    v = [np.zeros_like(x, np.float64) for x in net.parts()]
    t = 0
    for epoch in range(epochs):
        shuffled = order.permutation(len(texts))
        for rows, done in batches(shuffled, [len(texts[i]) for i in shuffled]):
            t += 1
            rate = RATE * (1 - (epoch + done) / epochs)
            for x, g, a, b in zip(net.parts(), gradients(net, pack([texts[i] for i in rows]), y[rows]), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


def score(net: Net, texts: list[bytes]) -> np.ndarray:
    """The probability of label 1 for each whole text."""
    out = np.empty(len(texts))
    for a, b in slabs(map(len, texts), SCORE_SLAB):
        out[a:b] = 1 / (1 + np.exp(-np.clip(forward(net, pack(texts[a:b]))["logit"].astype(np.float64), -500, 500)))
    return out


def _scores(net: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(net.value, byte_texts(batch, "text")), pa.float64())], names=["doc_id", "score"])

    return run


def sampled(sample: DataFrame, limit: int = SAMPLE_BYTES, longest: int = LONGEST_BYTES) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of a table ``y, text``, in the order of their hashes, as many as ``limit`` bytes hold."""
    texts, y, total = [], [], 0
    rows = sample.select("y", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= longest)
    for label, text in rows.orderBy(F.xxhash64("text"), "text", "y").toLocalIterator():
        texts.append(text.encode("utf-8", "replace"))
        total += len(texts[-1])
        if total > limit:
            texts.pop()
            break
        y.append(label)
    return texts, np.array(y, np.float32)


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, threshold: float = 0.3) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, quality``. Other columns, whatever their names, play no part.
    ``held_out``: the fifth of the ids that nothing is learned from. Null and empty texts get the network's value for a
    text without bytes; a null id is scored like any other; repeated rows get equal scores; without labels of both
    kinds the score is the smoothed share of label 1. An empty table gives an empty result. Every text is scored whole,
    in slabs of bounded size; the network is fitted on whole texts, at most ``sample_rows`` of them and SAMPLE_BYTES in
    all, which is what the driver fetches.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sample = labelled_sample(docs, labels, "quality", sample_rows)
    net = spark.sparkContext.broadcast(train(*sampled(sample)))
    discard(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(_scores(net), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
