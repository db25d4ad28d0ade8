"""Iterative steps without a Spark form: density clustering, layout, merging of topics.

All of them cover every vector. Up to a documented number of vectors one task has their distance matrix; beyond it
distances are worked out block by block on all cores, and one task has the spanning tree's edges or the neighbour graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.config import Settings
from docstrata.operators.neighbours import neighbours
from docstrata.operators.vectors import BLOCK_BYTES, LEAST_ROWS, components, matrix, rescaled, unit
from docstrata.sources.shared import discard, materialise, owning

#: Vectors that one task compares at once: their distance matrix takes 200 MB.
FIT_ROWS = 5000
#: Bytes of vectors that a task compares a block with; shortest edges of each vector that are kept; rows that meet a
#: block at once; pairs whose differences a task holds.
SLAB_BYTES, KEPT, ROWS, PAIRS = 32 << 20, 16, 256, 1 << 16
#: Edges of a layout's graph that are worked out at once, and on how many threads: the layout is its stage's only task.
SLAB, THREADS = 1 << 14, 4


# --- density clustering


def mutual_reachability(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Distances, no less than either point's distance to its ``min_samples``-th neighbour, itself counted."""
    squares = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    core = np.partition(d, min(min_samples, len(x)) - 1, axis=1)[:, min(min_samples, len(x)) - 1]
    return np.maximum(d, np.maximum(core[:, None], core[None, :]))


def spanning_tree(d: np.ndarray) -> np.ndarray:
    """Edges ``a, b, distance`` of a least spanning tree, by rising distance (Prim)."""
    n = len(d)
    best, source, inside = d[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    edges = []
    for _ in range(n - 1):
        j = int(np.argmin(np.where(inside, np.inf, best)))
        edges.append((source[j], j, best[j]))
        inside[j] = True
        closer = d[j] < best
        best, source = np.where(closer, d[j], best), np.where(closer, j, source)
    edges.sort(key=lambda e: e[2])
    return np.array(edges).reshape(-1, 3)


def leaf_clusters(x: np.ndarray, min_cluster_size: int, min_samples: int) -> np.ndarray:
    """Labels of the leaves of the condensed cluster tree; -1 for points in none."""
    return leaves(spanning_tree(mutual_reachability(x, min_samples)) if len(x) >= 2 * min_cluster_size else np.empty((0, 3)), len(x), min_cluster_size)


def leaves(tree: np.ndarray, n: int, min_cluster_size: int) -> np.ndarray:
    """``leaf_clusters`` of ``n`` points from the edges of their least spanning tree, by rising distance."""
    labels = np.full(n, -1)
    if n < 2 * min_cluster_size:
        return labels
    children: dict[int, tuple[int, int]] = {}
    sizes, top, parent = [1] * n, list(range(n)), list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b, _ in tree:
        a, b = find(int(a)), find(int(b))
        node = n + len(children)
        children[node] = (top[a], top[b])
        sizes.append(sizes[top[a]] + sizes[top[b]])
        parent[b], top[a] = a, node
    found, stack = 0, [(n + len(children) - 1, False)]
    while stack:
        node, split = stack.pop()
        start = node
        while node >= n:  # down to where a cluster of enough points parts into two such
            large = [c for c in children[node] if sizes[c] >= min_cluster_size]
            if len(large) != 1:
                break
            node = large[0]
        if node >= n and len(large) == 2:
            stack += [(c, True) for c in large]
        elif split:
            # of a leaf, the points that it has where it appears
            members, below = [], [start]
            while below:
                c = below.pop()
                if c < n:
                    members.append(c)
                else:
                    below += children[c]
            labels[members] = found
            found += 1
    return labels


def _packed(pairs: Iterator[tuple[np.ndarray, np.ndarray]], limit: int) -> Iterator[pa.RecordBatch]:
    """Places and vectors in blocks of ``limit`` rows, or less than twice as many."""
    held, n = [], 0

    def block() -> pa.RecordBatch:
        at, x = (np.concatenate(c) for c in zip(*held))
        return pa.RecordBatch.from_pydict({"at": [at.astype(np.int64).tobytes()], "x": [x.tobytes()], "kind": [x.dtype.str]})

    for at, x in pairs:
        for a in range(0, len(at), limit):
            held.append((at[a : a + limit], x[a : a + limit]))
            n += len(held[-1][0])
            if n >= limit:
                yield block()
                held, n = [], 0
    if n:
        yield block()


def _unpacked(batch: pa.RecordBatch, r: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    at, x, kind = (batch.column(first + c)[r].as_py() for c in range(3))
    at = np.frombuffer(at, np.int64)
    return at, np.frombuffer(x, np.dtype(kind)).reshape(len(at), -1)


def _blocked(vectors: DataFrame, key: str, vector: str, keys: np.ndarray) -> DataFrame:
    """``at, x, kind``: the vectors as a written table of blocks of bounded bytes: places in ``keys``, components, their type."""
    sc = vectors.sparkSession.sparkContext
    places, kind = sc.broadcast(keys), np.float32 if vectors.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    dim = vectors.agg(F.max(F.size(vector))).head()[0] or 1
    limit = max(1, min(BLOCK_BYTES // (8 * max(1, dim)), max(LEAST_ROWS, -(-len(keys) // sc.defaultParallelism))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(((np.searchsorted(places.value, b.column(0).to_numpy()), matrix(b.column(1)).astype(kind)) for b in batches if b.num_rows), limit)

    dealt = vectors.select(F.col(key).cast("long"), vector).repartition(-(-len(keys) // limit))
    return materialise(dealt.mapInArrow(run, "at binary, x binary, kind string"), "blocks")


def _compared(blocks: DataFrame, key: str, vector: str, keys: np.ndarray, found: Callable[..., tuple[np.ndarray, np.ndarray]], schema: str, asked: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """What ``found`` makes, one after another, of a block, or of those of its places that are ``asked`` for, and of all blocks of a
    slab: distances and edges of each place. Tasks read the written blocks anew for each slab and hold a slab beside one
    block. Only results are shuffled, so disk grows as the vectors do, though all pairs are compared."""
    columns, queries = [key, vector, "kind"], blocks
    rows, size = blocks.agg(F.max(F.octet_length(key)), F.sum(F.octet_length(vector))).head()

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (_unpacked(b, r) for b in batches for r in range(b.num_rows))
        yield from _packed(((i[on], x[on]) for i, x in read if (on := asked(i)).any()), rows // 8)

    if asked:
        queries = materialise(blocks.select(*columns).mapInArrow(chosen, blocks.schema), "asked")
    slabs = blocks.select(*[F.col(c).alias(f"other_{c}") for c in columns]).coalesce(-(-size // SLAB_BYTES))
    met = queries.select(*columns).hint("shuffle_replicate_nl").crossJoin(slabs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = i = x = best = None

        def told() -> pa.RecordBatch:
            w, e = best
            on = np.isfinite(w)
            near = pa.StructArray.from_arrays([pa.array(w[on]), pa.array(e[on])], ["w", "e"])
            ends = np.concatenate(([0], on.sum(axis=1).cumsum())).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(i), pa.ListArray.from_arrays(pa.array(ends), near)], names=["i", "near"])

        for batch in batches:
            for r in range(batch.num_rows):
                if (block := batch.column(0)[r].as_py()) != name:
                    if name is not None:
                        yield told()
                    name, best = block, None
                    i, x = _unpacked(batch, r)
                    x = x.astype(np.float64)
                j, y = _unpacked(batch, r, 3)
                best = found(i, x, j, y.astype(np.float64), best)
        if name is not None:
            yield told()

    return owning(met.mapInArrow(run, schema), *([queries] if asked else []))


def _nearest(i: np.ndarray, x: np.ndarray, j: np.ndarray, y: np.ndarray, best: tuple | None, k: int, n: int, core: np.ndarray, component: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``i`` the ``k`` least distances of mutual reachability and their edges (the lesser place times ``n``, plus the
    other), of equals the first edges, among ``best`` and the places in ``j``; with components, those of other ones only.

    Products give distances but for rounding, so they leave out what can't be among the least; the others are worked out
    from differences, which are the same bits in any block and from either end.
    """
    if best is None:
        best = np.full((len(i), k), np.inf), np.full((len(i), k), np.iinfo(np.int64).max)
    least, edge = best
    middle = y.mean(axis=0)
    y0 = y - middle
    squares = (y0 * y0).sum(axis=1)
    right = np.concatenate((y0.T, squares[None, :]))
    rights = {np.float32: right.astype(np.float32), np.float64: right}
    for a in range(0, len(i), ROWS):
        s = slice(a, a + ROWS)
        z, own, w, e = x[s], i[s], least[s], edge[s]
        z0 = z - middle
        length, left = (z0 * z0).sum(axis=1), np.concatenate((-2 * z0, np.ones((len(z), 1))), axis=1)
        for kind in (np.float32, np.float64):  # in single precision where its rounding bears on few pairs
            slack = 4 * len(right) * np.finfo(kind).eps * (length + squares.max())
            d = left.astype(kind) @ rights[kind]  # squares of distances, less those of lengths
            bound = w[:, -1].copy()
            for width in (2048, len(j)):
                new = np.flatnonzero(np.isinf(bound))
                if not len(new) or len(j) < k:
                    break
                reach = np.maximum(np.sqrt(np.maximum(d[new, :width] + (length + slack)[new, None], 0)), np.maximum(core[own[new], None], core[None, j[:width]]))
                if component is not None:
                    reach[component[own[new], None] == component[None, j[:width]]] = np.inf
                bound[new] = np.partition(reach, k - 1, axis=1)[:, k - 1] if reach.shape[1] >= k else np.inf
            far = bound * bound
            if np.mean((slack <= far / 100) & (far > 1e-20)) > 0.9 and length.max() + squares.max() < 1e30:
                break
        limit = (far - length + slack).astype(kind)
        at = np.flatnonzero(d <= np.nextafter(limit, kind(np.inf))[:, None])
        parts = [(np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))]
        for b in range(0, len(at), PAIRS):
            row, col = np.divmod(at[b : b + PAIRS], len(j))
            on = core[j[col]] <= bound[row]
            if component is not None:
                on &= component[own[row]] != component[j[col]]
            row, col = row[on], col[on]
            apart = z[row] - y[col]
            reach = np.maximum(np.sqrt((apart * apart).sum(axis=1)), np.maximum(core[own[row]], core[j[col]]))
            on = reach <= w[row, -1]
            row, col, reach = row[on], col[on], reach[on]
            parts = [_first(*(np.concatenate(c) for c in zip(*parts, (row, reach, np.minimum(own[row], j[col]) * n + np.maximum(own[row], j[col])))), k)]
        row, reach, code = parts[0]
        if len(row):
            some = np.unique(row)
            kept = np.isfinite(w[some])
            old = np.repeat(some, kept.sum(axis=1)), w[some][kept], e[some][kept]
            row, reach, code = _first(*(np.concatenate(c) for c in zip(old, (row, reach, code))), k)
            place = np.arange(len(row)) - np.searchsorted(row, row)
            w[row, place], e[row, place] = reach, code
    return best


def _first(row: np.ndarray, w: np.ndarray, e: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the ``k`` least, by rows."""
    order = np.lexsort((e, w, row))
    row, w, e = row[order], w[order], e[order]
    on = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[on], w[on], e[on]


def spanning_tree_by_blocks(vectors: DataFrame, key: str, vector: str, keys: np.ndarray, min_samples: int) -> np.ndarray:
    """``spanning_tree`` of the mutual reachability of all vectors (Boruvka): in each round every component finds its
    shortest edge to another, but for the largest, which the others' edges reach. ``keys``: theirs, sorted.

    The first pass over all pairs finds core distances, the second the KEPT shortest edges of each vector, a written table. Later
    ones compare only vectors whose own edges all stay within their component, unless what is known of them bounds any other
    edge from below by one that the component has. The driver holds a few numbers for each vector.
    """
    sc, n = vectors.sparkSession.sparkContext, len(keys)
    blocks, schema = _blocked(vectors, key, vector, keys), "i long, near array<struct<w: double, e: long>>"

    def least(k: int, core: np.ndarray, component: np.ndarray | None, asked: np.ndarray | None = None) -> DataFrame:
        state = sc.broadcast((core, component, asked))
        found = lambda i, x, j, y, best: _nearest(i, x, j, y, best, k, n, state.value[0], state.value[1])
        met = _compared(blocks, "at", "x", keys, found, schema, None if asked is None else lambda i: state.value[2][i])
        return owning(met.groupBy("i").agg(F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near")), met)

    def ends(found: DataFrame) -> tuple[np.ndarray, ...]:
        last = found.select("i", F.try_element_at("near", F.lit(-1)).alias("b")).where("b IS NOT NULL").select("i", "b.w", "b.e").toArrow()
        return tuple(last[c].to_numpy() for c in ("i", "w", "e"))

    most, core, edges = np.iinfo(np.int64).max, np.full(n, np.nan), []
    at, w, _ = ends(least(min(min_samples, n), np.zeros(n), None))
    core[at] = w
    if not np.isfinite(core).all():
        raise ValueError("some vectors have no distance to others: a component is not a number")
    component, kept = np.arange(n), min(KEPT, n - 1)
    lists = materialise(least(kept, core, component), "lists")
    # a vector's edges to other components that are neither in its list nor found later come after these
    bound, code = np.full(n, np.inf), np.full(n, most)
    if kept < n - 1:
        at, w, e = ends(lists)
        bound[at], code[at] = w, e
    near, via = np.full(n, np.inf), np.zeros(n, np.int64)

    while len(edges) < n - 1:
        largest = np.bincount(component).argmax() if edges else -1
        state = sc.broadcast(component)

        def leaving(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = batch.column(1).flatten()
                w, e = found.field("w").to_numpy(), found.field("e").to_numpy()
                c = state.value[np.repeat(batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy())]
                on = state.value[e // n] != state.value[e % n]
                c, w, e = _first(c[on], w[on], e[on], 1)
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(w), pa.array(e)], names=["c", "w", "e"])

        found = lists.mapInArrow(leaving, "c long, w double, e long").groupBy("c").agg(F.min(F.struct("w", "e")).alias("b")).select("c", "b.w", "b.e").toArrow()
        first, through = np.full(n, np.inf), np.full(n, most)

        def better(c: np.ndarray, w: np.ndarray, e: np.ndarray) -> None:
            c, w, e = _first(c, w, e, 1)
            on = (w < first[c]) | ((w == first[c]) & (e < through[c]))  # noqa: B023
            first[c[on]], through[c[on]] = w[on], e[on]  # noqa: B023

        better(*(found[c].to_numpy() for c in ("c", "w", "e")))
        known = np.flatnonzero(np.isfinite(near))
        known = known[component[via[known] // n] != component[via[known] % n]]
        better(component[known], near[known], via[known])
        asked = (component != largest) & ((bound < first[component]) | ((bound == first[component]) & (code < through[component])))
        if asked.any():
            met = least(1, core, component, asked)
            at, w, e = ends(met)
            discard(met)
            near[asked], bound[asked], code[asked] = np.inf, np.inf, most
            near[at], via[at], bound[at], code[at] = w, e, w, e
            better(component[at], w, e)
        on = np.isfinite(first) & (np.arange(n) != largest)
        parent = np.arange(n)

        def find(a: int) -> int:
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        order, before = np.lexsort((through[on], first[on])), len(edges)
        for w, e in zip(first[on][order].tolist(), through[on][order].tolist()):
            a, b = find(component[e // n]), find(component[e % n])
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((e // n, e % n, w))
        while (parent != parent[parent]).any():
            parent = parent[parent]
        component = parent[component]
        state.unpersist()
        if len(edges) == before:
            raise ValueError("some vectors have no distance to others: a component is not a number")
    discard(lists, blocks)
    edges.sort(key=lambda e: e[2])
    return np.array(edges).reshape(-1, 3)


def hdbscan(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", s: Settings = Settings(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key, topic_nr``: leaf clusters by density of all vectors, -1 for outliers. Beyond ``fit_rows`` vectors the distances
    are worked out by blocks, of rows with numbers of their own, since keys may occur more than once."""
    if vectors.count() > fit_rows:
        rows = materialise(vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v"), F.monotonically_increasing_id().alias("row")), "rows")
        named = rows.select("row", "key").toArrow()
        order = np.argsort(named.column(0).to_numpy())
        numbers = named.column(0).to_numpy()[order]
        labels = leaves(spanning_tree_by_blocks(rows, "row", "v", numbers, s.min_samples), len(numbers), s.min_cluster_size)
        discard(rows)
        return vectors.sparkSession.createDataFrame(pa.table({key: named.column(1).to_numpy()[order], "topic_nr": labels.astype(np.int32)}))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), -1)
        return pd.DataFrame({key: pdf[key].to_numpy(), "topic_nr": leaf_clusters(x, s.min_cluster_size, s.min_samples)})

    return vectors.select(key, vector).groupBy(F.lit("all")).applyInPandas(run, f"{key} long, topic_nr int")


# --- layout


def fuzzy_weights(distances: np.ndarray, k: int) -> np.ndarray:
    """Membership strengths of k nearest neighbours, rows summing to log2(k) by bisection of their bandwidth."""
    rho = distances[:, :1]
    low, high = np.zeros((len(distances), 1)), np.full((len(distances), 1), 1e3)
    for _ in range(64):
        sigma = (low + high) / 2
        over = np.exp(-np.maximum(distances - rho, 0) / sigma).sum(axis=1, keepdims=True) > np.log2(k)
        low, high = np.where(over, low, sigma), np.where(over, sigma, high)
    return np.exp(-np.maximum(distances - rho, 0) / ((low + high) / 2))


def umap(x: np.ndarray, init: np.ndarray, k: int, seed: int, epochs: int = 200) -> np.ndarray:
    """Layout of unit vectors by cosine, with least distance 0, from given coordinates."""
    n = len(x)
    k = min(k, n - 1)
    if k < 1:
        return init
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return layout(order, np.take_along_axis(d, order, axis=1), init, seed, epochs)


def fuzzy_union(order: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symmetric graph of k neighbours each and their memberships: heads, tails and memberships, by head and tail."""
    n, k = order.shape
    head = np.repeat(np.arange(n), k)
    codes = np.concatenate((head * n + order.ravel(), order.ravel() * n + head))
    found, place = np.unique(codes, return_inverse=True)
    there, back = np.zeros(len(found)), np.zeros(len(found))
    there[place[: n * k]], back[place[n * k :]] = w.ravel(), w.ravel()
    union = there + back - there * back
    found, union = found[union != 0], union[union != 0]
    return found // n, found % n, union


def layout(order: np.ndarray, distances: np.ndarray, init: np.ndarray, seed: int, epochs: int = 200) -> np.ndarray:
    """``umap`` from the k nearest neighbours of all points and their distances."""
    n, k = order.shape
    head, tail, w = fuzzy_union(order, fuzzy_weights(distances, k))
    a, b = 1.93, 0.79  # the curve for least distance 0 and spread 1
    p = w / w.max()
    r, y, pool = np.random.Generator(np.random.PCG64(seed)), (init * 1e4 * 10).T, ThreadPoolExecutor(THREADS)
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        on = r.random(len(p)) < p
        i, j = head[on], tail[on]
        moves = np.empty((len(y), len(i)))
        slabs = [slice(first, first + SLAB) for first in range(0, len(i), SLAB)]

        def pull(x: slice, y: np.ndarray = y) -> None:
            diff = y[:, i[x]] - y[:, j[x]]
            d2 = (diff * diff).sum(axis=0)
            moves[:, x] = np.clip(-2 * a * b * np.power(d2, b - 1, where=d2 > 0, out=np.zeros_like(d2)) / (1 + a * d2**b) * diff, -4, 4) * rate

        list(pool.map(pull, slabs))
        y = _added(_added(y, i, moves), j, -moves)

        def push(x: slice, far: np.ndarray, y: np.ndarray = y) -> None:
            diff = y[:, i[x], None] - y[:, far]
            d2 = (diff * diff).sum(axis=0)
            moves[:, x] = (np.clip(2 * b / ((0.001 + d2) * (1 + a * d2**b)) * diff, -4, 4) * rate).sum(axis=2)

        list(pool.map(push, slabs, [r.integers(0, n, (len(i[x]), 5)) for x in slabs]))
        y = _added(y, i, moves)
    pool.shutdown()
    return y.T


def _added(y: np.ndarray, at: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Points, a column each, after moves of those at some places, one after another."""
    order = np.concatenate((np.arange(y.shape[1]), at))
    return np.array([np.bincount(order, np.concatenate((c, m))) for c, m in zip(y, moves)])


def umap_layout(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 2, s: Settings = Settings(), fit_rows: int = FIT_ROWS) -> DataFrame:
    """``key, coordinates``: a layout of all vectors from rescaled principal components, seeded. Beyond ``fit_rows`` vectors
    neighbours come from inverted lists, components from sums, and one task lays the graph out."""
    n = vectors.count()
    if n > fit_rows:
        k = min(s.neighbours, n - 1)
        found = neighbours(vectors, key, vector, k)
        near = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "neighbour", "sim"))).alias("near"))
        begun = rescaled(components(vectors, dims, key, vector)).withColumnRenamed("pc", "begin")
        graph = near.join(begun, key).select(key, "begin", F.transform("near", lambda x: x["neighbour"]).alias("others"), F.transform("near", lambda x: 1 - x["sim"]).alias("far"))

        def run_graph(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key)
            keys = pdf[key].to_numpy()
            order, d, init = np.searchsorted(keys, np.array(pdf["others"].tolist())), np.array(pdf["far"].tolist()), np.array(pdf["begin"].tolist())
            return pd.DataFrame({key: keys, "coordinates": list(layout(order, d, init, s.seed))})

        return owning(graph.groupBy(F.lit("all")).applyInPandas(run_graph, f"{key} long, coordinates array<double>"), found)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        x = np.array(pdf[vector].tolist(), np.float64).reshape(len(pdf), -1)
        centred = x - x.mean(axis=0)
        u, sv, _ = np.linalg.svd(centred, full_matrices=False)
        pc = np.zeros((len(x), dims))
        pc[:, : min(dims, u.shape[1])] = (u * sv)[:, :dims]
        sd = pc[:, 0].std()
        y = umap(unit(x), pc / (sd * 10000) if sd else pc, s.neighbours, s.seed)
        return pd.DataFrame({key: pdf[key].to_numpy(), "coordinates": list(y)})

    return vectors.select(key, vector).groupBy(F.lit("all")).applyInPandas(run, f"{key} long, coordinates array<double>")


# --- merging of topics


def merged(topics: np.ndarray, n: int) -> np.ndarray:
    """For each topic vector the group that it falls into when the nearest two groups, by average cosine distance, are
    merged until ``n`` are left. Groups are numbered in order of their first topic."""
    groups = [[i] for i in range(len(topics))]
    d = 1 - unit(topics) @ unit(topics).T
    while len(groups) > max(n, 1):
        _, i, j = min((d[np.ix_(a, b)].mean(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    labels = np.zeros(len(topics), int)
    for g, members in enumerate(sorted(groups, key=min)):
        labels[members] = g
    return labels


def merge_topics(topics: DataFrame, n: int, topic: str = "topic_nr") -> DataFrame:
    """``topic_nr, merged_topic``. ``topics``: one vector per topic, a few hundred at most; outliers stay apart, and count
    as one of the ``n``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(topic)
        inside = pdf[pdf[topic] != -1]
        found = dict(zip(inside[topic], merged(np.array(inside["embedding"].tolist(), np.float64), n - (len(inside) < len(pdf))))) if len(inside) else {}
        return pd.DataFrame({"topic_nr": pdf[topic].to_numpy(), "merged_topic": [int(found.get(t, -1)) for t in pdf[topic]]})

    return topics.groupBy(F.lit("all")).applyInPandas(run, "topic_nr int, merged_topic int")
