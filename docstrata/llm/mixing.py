"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame operations only.

A source's target number of tokens is divided into blocks of equal tokens. Blocks are apportioned first to sources, then
to the pools of a source's shards, then to the hashed shards of a pool, by highest quotients: each next block goes to the largest ``votes / (2 seats + 1)``.
A document's id and text decide its shard, so that rows that share an id, or have none, are spread.
A shard's documents stand end to end in a seeded order; its quota is whole passes over the shard and, for the rest,
blocks picked evenly from a seeded start. What a document gives is the overlap of its tokens with the blocks picked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.common import discard, materialise, owning

#: Weights of sources in order of their names, repeating; passes over a source at most; seed.
WEIGHTS, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 3, 42
#: Documents in a shard, and shards in a pool, on average: a task ranks the quotients of one pool's shards, or of the pools of
#: one source.
SHARD_DOCS, POOL_SHARDS = 2048, 1024
#: A block has as many tokens as leave the smallest target this many blocks, between 1 and BLOCK_TOKENS.
LEAST_BLOCKS, BLOCK_TOKENS = 256, 64
WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to ``skey, weight, source_size``: shares of the total by weight, none above ``max_epochs`` times
    its source; what is above is reshared by weight among the others until none is above. ``sources``: a written table
    with one row per source; only sums of it reach the driver."""
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).head()[0] or 0
    full, per_weight = F.lit(False), 0.0
    n_full = -1
    while True:
        taken, weight, n = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.coalesce(F.sum(full.cast("long")), F.lit(0))
        ).head()
        if n == n_full or not weight:
            break
        n_full, per_weight = n, (total - taken) / weight
        full = cap <= F.col("weight") * per_weight
    return sources.withColumn("target", F.when(full, cap.cast("double")).otherwise(F.col("weight") * per_weight))


def apportion(units: DataFrame, group: list[str], unit: str, votes: str, seats: str) -> DataFrame:
    """Adds ``quota``: the ``seats`` of each group (a column, equal within it) go to its units by the highest quotients
    ``votes / (2 k - 1)``; ties go to the lesser ``unit``. Units without votes get none.

    With n units, rounding ``votes`` over the group's mean votes per seat is off by n / 2 seats in all, and by a
    unit's share of that plus one for each unit, so only that many quotients of a unit are ranked.
    """
    w = Window.partitionBy(*group)
    even = F.sum(votes).over(w) / F.col(seats)
    base = F.when((F.col(seats) > 0) & (F.col(votes) > 0), F.floor(F.col(votes) / even + 0.5)).otherwise(F.lit(0)).cast("long")
    reach = F.when(F.col(votes) > 0, F.ceil(F.col(votes) / F.sum(votes).over(w) * F.count("*").over(w) / 2) + 1).otherwise(F.lit(0)).cast("long")
    based = units.withColumn("_base", base).withColumn("_reach", reach).withColumn("_short", F.col(seats) - F.sum("_base").over(w))
    steps = F.when(F.col("_short") > 0, F.col("_reach")).when(F.col("_short") < 0, F.least("_reach", "_base")).otherwise(F.lit(0))
    ranked = based.withColumn("_k", F.explode_outer(F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps.cast("long")))))
    gain = F.when(F.col("_k").isNotNull() & (F.col("_short") > 0), F.col(votes) / (2 * (F.col("_base") + F.col("_k")) - 1))
    loss = F.when(F.col("_k").isNotNull() & (F.col("_short") < 0), F.col(votes) / (2 * (F.col("_base") - F.col("_k") + 1) - 1))
    order = [gain.desc_nulls_last(), loss.asc_nulls_last(), F.when(F.col("_short") > 0, F.col(unit)).asc_nulls_last(), F.col(unit).desc(), F.col("_k")]
    ranked = ranked.withColumn("_rank", F.row_number().over(w.orderBy(*order)))
    change = F.when(F.col("_k").isNotNull() & (F.col("_rank") <= F.abs("_short")), F.signum("_short")).otherwise(F.lit(0)).cast("long")
    keep = [c for c in units.columns if c not in (*group, unit)]
    return ranked.groupBy(*group, unit).agg(*[F.first(c).alias(c) for c in keep], (F.first("_base") + F.sum(change)).alias("quota"))


def _picked_before(x: Column, k: Column, n: Column, offset: Column, block: int) -> Column:
    """Tokens picked before token ``x`` of a shard of which ``k`` of ``n`` blocks, evenly from ``offset``, are picked.
    Block j is picked where floor((j + 1 + offset) k / n) exceeds floor((j + offset) k / n)."""
    j = F.floor(x / block)
    before = F.floor((j + offset) * k / n) - F.floor(offset * k / n)
    is_picked = F.floor((j + 1 + offset) * k / n) - F.floor((j + offset) * k / n)
    return before * block + is_picked * (x - j * block)


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED,
    shard_docs: int = SHARD_DOCS, pool_shards: int = POOL_SHARDS,
) -> DataFrame:
    """One row per input row: ``doc_id, size, source_size, target, taken``.

    ``size``: words of the text, 0 for null. Sources stand in code point order, null last as a source of its own, and
    take ``weights`` in turn; ``target`` is that of ``targets``. ``taken``: words that the mix takes from the row,
    repeats counted, at most ``max_epochs`` times its size; the words taken from a source differ from its target by a
    few blocks at most. The same input gives the same result; rows that repeat an id are distinct rows. Documents
    without words give none. Other columns of ``df``, whatever their names, play no part; an empty table gives an
    empty result.

    Documents are read once. Sources and shards are aggregated before each shuffle; windows run within a shard of
    about ``shard_docs`` rows, over one row per shard of a pool, per pool of a source, or per source.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col).cast("string"))).alias("skey"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col(id_col).cast("long"), F.col(text_col).cast("string")).alias("key"),
    )
    rows = materialise(rows, "sizes")
    sources = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    place = (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    weighed = materialise(sources.withColumn("weight", weight), "sources")
    sources = materialise(targets(weighed, max_epochs), "targets")
    least = sources.where("target > 0").agg(F.min("target"), F.sum("target")).head()
    block = max(1, min(BLOCK_TOKENS, int((least[0] or 0) // LEAST_BLOCKS)))
    seats = sources.withColumn("seats", F.lit(int((least[1] or 0) / block + 0.5)).cast("long")).withColumn("all", F.lit(0))
    quotas = apportion(seats, ["all"], "skey", "target", "seats")
    quotas = materialise(quotas.select("skey", "source_size", "target", "quota", F.ceil(F.col("n_docs") / shard_docs).cast("long").alias("n_shards")), "quotas")
    discard(weighed, sources)
    shard = F.pmod(F.xxhash64("key", F.lit(seed)), F.col("n_shards"))
    sharded = rows.join(quotas, "skey").withColumn("shard", shard)
    units = sharded.groupBy("skey", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("seats"), F.first("n_shards").alias("n_shards"))
    units = materialise(units.withColumn("pool", F.pmod("shard", F.ceil(F.col("n_shards") / pool_shards))).drop("n_shards"), "units")
    pools = units.groupBy("skey", "pool").agg(F.sum("shard_size").alias("votes"), F.first("seats").alias("seats"))
    pools = apportion(pools, ["skey"], "pool", "votes", "seats").select("skey", "pool", F.col("quota").alias("seats"))
    pooled = units.drop("seats").join(pools, ["skey", "pool"])
    found = apportion(pooled, ["skey", "pool"], "shard", "shard_size", "seats")
    shares = materialise(found.select("skey", "shard", "shard_size", F.col("quota").alias("shard_quota")), "shares")
    discard(units)
    w = Window.partitionBy("skey", "shard").orderBy(F.xxhash64("key", F.lit(seed + 1)), "doc_id", "size", "key")
    placed = sharded.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).join(shares, ["skey", "shard"])
    n_blocks = F.ceil(F.col("shard_size") / block)
    wanted = F.least(F.col("shard_quota") * block, F.col("shard_size") * max_epochs)
    passes = F.floor(wanted / F.col("shard_size"))
    k = F.least(F.floor((wanted - passes * F.col("shard_size")) / block + 0.5), n_blocks)
    offset = F.pmod(F.xxhash64("skey", "shard", F.lit(seed + 2)), n_blocks)
    part = _picked_before(F.col("end"), k, n_blocks, offset, block) - _picked_before(F.col("end") - F.col("size"), k, n_blocks, offset, block)
    taken = F.when(F.col("shard_size") > 0, passes * F.col("size") + part).otherwise(F.lit(0)).cast("long")
    found = placed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"))
    return owning(found, rows, quotas, shares)
