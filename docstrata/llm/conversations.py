"""Repair of the structure of conversations by the cheapest edits.

A conversation becomes a signature: a sign for each row that says who speaks and what is wrong. Sorted signatures are put
into a prefix trie, depth first: the layers of the dynamic program along the path from the root are kept, so a prefix that
signatures share is worked out once, and an answer is emitted where a signature ends. A conversation may be of any length:
it is sorted over all tasks and worked out in chunks, whose answers are joined by the states between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from docstrata.llm.common import BATCH_BYTES, bounded_batches, discard, materialise, owning

#: Costs of edits, and of a row that stays though it is truncated.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Bytes and rows of a chunk of a conversation at most, or one row where that is larger.
CHUNK_BYTES, CHUNK_ROWS = 1 << 18, 4096
BLANK_CHARS, ENDS = " \t\n\x0b\x0c\r", ".!?"

START, SYSTEM, USER, ASSISTANT = range(4)
#: States that a repaired conversation may end in.
COMPLETE = (START, ASSISTANT)
#: The state after a row by a user or an assistant, whichever is allowed after a state.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
SPOKEN = {USER: "user", ASSISTANT: "assistant"}
#: The state after a kept row, by state and initial of the role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = ("su", "ua", "au")


class Layer:
    """Cheapest audits of a prefix, by state.

    An audit is a trunk, which ends with what was done to the prefix's last row, and insertions after it. Trunks of one layer
    are no prefixes of one another, so their order, which is their number here, is that of all audits that begin with them.
    ``best[state]``: cost, trunk, insertions; ``back[trunk]``: trunk of the layer before, and the letters after it.
    """

    __slots__ = ("best", "back")

    def __init__(self, arrivals: dict[int, tuple[int, int, str]]):
        self.back = sorted({(trunk, word) for _, trunk, word in arrivals.values()})
        number = {b: i for i, b in enumerate(self.back)}
        self.best = {state: (cost, number[trunk, word], 0) for state, (cost, trunk, word) in arrivals.items()}
        todo = list(self.best)
        while todo:
            state = todo.pop()
            cost, trunk, n = self.best[state]
            found = (cost + INSERT, trunk, n + 1)
            if NEXT[state] not in self.best or found < self.best[NEXT[state]]:
                self.best[NEXT[state]] = found
                todo.append(NEXT[state])

    def after(self, sign: str) -> Layer:
        """The layer of the prefix that is longer by a row: ``d`` must go; else the role's initial, or ``x`` for one that has no
        place, in capitals if the row is truncated."""
        arrivals: dict[int, tuple[int, int, str]] = {}

        def arrive(state: int, cost: int, trunk: int, word: str) -> None:
            found = (cost, trunk, word)
            if state not in arrivals or found < arrivals[state]:
                arrivals[state] = found

        role, extra = sign.lower(), TRUNCATED if sign.isupper() else 0
        for state, (cost, trunk, n) in self.best.items():
            ins = "I" * n
            arrive(state, cost + DELETE, trunk, ins + "D")
            if role != "d":
                if (state, role) in KEPT:
                    arrive(KEPT[state, role], cost + extra, trunk, ins + "K")
                arrive(NEXT[state], cost + REROLE + extra, trunk, ins + "R")
        return Layer(arrivals)


def audit(path: list[Layer], state: int) -> str:
    """The letters that lead through the layers of a path to a state of the last one."""
    _, trunk, n = path[-1].best[state]
    words = ["I" * n]
    for layer in reversed(path):
        trunk, word = layer.back[trunk]
        words.append(word)
    return "".join(reversed(words))


def walk(keys: Iterable[str]) -> Iterator[tuple[str, list[tuple[int, int, int, str]]]]:
    """Of each key, in sorted order, its answers ``entry, exit, cost, audit``. A key is ``w`` (a whole conversation: from the
    start only) or ``p`` (a part: from each state) and a signature. Kept are the layers along the path to the last key."""
    path: list[dict[int, Layer]] = []
    last = ""
    for key in keys:
        shared = next((i for i, (a, b) in enumerate(zip(key, last)) if a != b), min(len(key), len(last)))
        del path[shared:]
        for sign in key[shared:]:
            if path:
                path.append({entry: layer.after(sign) for entry, layer in path[-1].items()})
            else:
                path.append({entry: Layer({entry: (0, 0, "")}) for entry in ((START,) if sign == "w" else range(4))})
        last, out = key, []
        for entry, layer in path[-1].items():
            ends = sorted(layer.best) if key[0] == "p" else [min((s for s in COMPLETE if s in layer.best), key=layer.best.__getitem__)]
            own = [layers[entry] for layers in path]
            out += [(entry, s, layer.best[s][0], audit(own, s)) for s in ends]
        yield key, out


def signed(rows: Iterable[tuple[str, str]]) -> tuple[str, list[bool]]:
    """The signature of rows ``role, text``, and which of them are blank."""
    seen, signs, blanks = set(), [], []
    for role, text in rows:
        end = text.rstrip(BLANK_CHARS)[-1:]
        again = (role, text) in seen
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        signs.append("d" if again or not end else initial if end in ENDS else initial.upper())
        blanks.append(not end)
    return "".join(signs), blanks


def edited(rows: Iterable[tuple[str, str]], letters: str, state: int) -> Iterator[tuple[str, str]]:
    """The rows that edits leave, from a state on."""
    rows = iter(rows)
    for letter in letters:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "K":
            state = KEPT[state, role[:1]]
        elif letter != "D":
            state = NEXT[state]
            role = SPOKEN[state]
        if letter != "D":
            yield role, text


CHUNK = (
    "conv {kind}, chunk long, roles array<string>, texts array<string>, low long, high long, n_turns long, blank long, signature string, "
    "firsts array<struct<place: int, key: binary>>, alone boolean"
)


def _chunk_rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Sorted rows ``conv, turn, role, text, gone`` as chunks of conversations. A chunk that may not be all of its conversation
    has a key for each row that is the first of its kind in it."""
    part, n_chunks = TaskContext.get().partitionId() << 33, 0
    out: list[tuple] = []
    rows: list[tuple[str, str]] = []
    turns: list[int] = []
    size, conv, begun, open_start = 0, None, False, True

    def close(alone: bool) -> None:
        nonlocal n_chunks, size
        signature, blanks = signed(rows)
        firsts = []
        if not alone:
            firsts = [{"place": i, "key": hashlib.blake2b(f"{len(r)}:{r}{t}".encode(), digest_size=16).digest()} for i, (r, t) in enumerate(rows) if signature[i] != "d"]
        low, high = (turns[0], turns[-1]) if turns else (None, None)
        roles, texts = [r for r, _ in rows], [t for _, t in rows]
        out.append((conv, part + n_chunks, roles, texts, low, high, len(set(turns)), sum(blanks), signature, firsts, alone))
        n_chunks += 1
        rows.clear()
        turns.clear()
        size = 0

    def batch() -> pa.RecordBatch:
        found = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        out.clear()
        return found

    written = 0
    for given in batches:
        for c, turn, role, text, gone in zip(*(column.to_pylist() for column in given.columns)):
            if not begun or c != conv:
                if begun:
                    close(not open_start)
                    open_start = False  # only the first conversation may go on from the task before
                conv, begun = c, True
            elif size >= CHUNK_BYTES or len(rows) >= CHUNK_ROWS:
                close(False)
                open_start = True  # so far as the rest of this conversation goes
            if not gone:
                rows.append((role, text))
                size += len(text) + len(role)
                written += len(text) + len(role)
                if turn is not None:
                    turns.append(turn)
            if written >= BATCH_BYTES or len(out) >= CHUNK_ROWS:
                if out:
                    yield batch()
                written = size
    if begun:
        close(False)
    if out:
        yield batch()


def _chunks(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """Conversations in order, in chunks, as a written table. Rows that are equal in all that orders them are equal, so an
    arbitrary number may part them."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    away = F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)
    rows = df.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"), away.alias("gone"))
    order = ["conv", "turn", "role", "text"]
    dealt = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(*order, "number").sortWithinPartitions(*order).drop("number")
    schema = CHUNK.format(kind=rows.dtypes[0][1])
    arrow = to_arrow_schema(dealt.sparkSession.createDataFrame([], schema).schema)
    return materialise(dealt.mapInArrow(lambda batches: _chunk_rows(batches, arrow), schema), "chunks")


def _resolved(chunks: DataFrame) -> DataFrame:
    """``chunk, conv, key`` and the counts of each chunk, rows that repeat one of an earlier chunk marked; a written table. Only
    keys of conversations that may have several chunks are moved, at most one of each kind from a chunk."""
    keys = chunks.where("not alone").select("conv", "chunk", F.explode("firsts").alias("f")).select("conv", "chunk", "f.place", "f.key")
    first = F.min("chunk").over(Window.partitionBy("conv", "key"))
    again = keys.withColumn("first", first).where("chunk > first").groupBy("chunk").agg(F.collect_list("place").alias("again"))
    several = chunks.where("not alone").groupBy("conv").agg((F.count("*") > 1).alias("several")).where("several")
    told = chunks.drop("texts", "firsts").join(again, "chunk", "left")
    told = told.join(several.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    initials = F.transform("roles", lambda r: F.substring(r, 1, 1))
    flat = told.select(
        "conv", "chunk", initials.alias("initials"), "low", "high", "n_turns", "blank", "signature",
        F.coalesce("again", F.array().cast("array<int>")).alias("again"), F.coalesce("several", F.lit(False)).alias("several"),
    )
    places = F.sequence(F.lit(0), F.length("signature") - 1)
    marked = F.when(F.size("again") == 0, F.col("signature")).otherwise(
        F.array_join(F.transform(places, lambda i: F.when(F.array_contains("again", i), F.lit("d")).otherwise(F.substring(F.col("signature"), i + 1, F.lit(1)))), "")
    )
    others = F.greatest(F.size("initials") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("initials", F.lit(1), others), F.slice("initials", F.lit(2), others), lambda a, b: F.concat(a, b))
    return materialise(
        flat.select(
            "conv", "chunk", "low", "high", "n_turns", "blank", F.concat(F.when(F.col("several"), F.lit("p")).otherwise(F.lit("w")), marked).alias("key"),
            F.get("initials", 0).alias("first"), F.get("initials", F.size("initials") - 1).alias("last"),
            F.size(F.filter(pairs, lambda x: ~x.isin(*LEGAL))).cast("long").alias("illegal"),
        ),
        "resolved",
    )


def _answers(resolved: DataFrame) -> DataFrame:
    """``key, answers`` of every distinct signature, as a written table; a task has a range of them and so a part of the trie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for key, found in walk(k for batch in batches for k in batch.column(0).to_pylist()):
            out.append((key, [dict(zip(("entry", "exit", "cost", "audit"), a)) for a in found]))
            size += sum(len(a[3]) for a in found) + 64 * len(found)
            if size >= BATCH_BYTES:
                yield batch_of(out)
                out, size = [], 0
        if out:
            yield batch_of(out)

    kind = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows]), pa.array([a for _, a in rows], kind)], names=["key", "answers"])

    keys = resolved.select("key").distinct().repartitionByRange("key").sortWithinPartitions("key")
    return materialise(keys.mapInArrow(run, "key string, answers array<struct<entry: int, exit: int, cost: long, audit: string>>"), "answers")


def joined(parts: list[dict]) -> dict:
    """The answer of a conversation from those of its chunks, in order: the cheapest way through the states between them, of
    equally cheap ones that with the least audit."""
    best, ways = {START: (0, "")}, []
    for part in parts:
        found: dict[int, tuple[int, str]] = {}
        way: dict[int, tuple[int, str]] = {}
        for a in part["answers"]:
            if a["entry"] in best:
                cost, letters = best[a["entry"]]
                new = (cost + a["cost"], letters + a["audit"])
                if a["exit"] not in found or new < found[a["exit"]]:
                    found[a["exit"]], way[a["exit"]] = new, (a["entry"], a["audit"])
        best = found
        ways.append(way)
    state = min((s for s in COMPLETE if s in best), key=best.__getitem__)
    cost, letters = best[state]
    pieces = []
    for part, way in zip(reversed(parts), reversed(ways)):
        entry, own = way[state]
        pieces.append({"chunk": part["chunk"], "state": entry, "letters": own, "at": 0})
        state = entry
    pieces.reverse()
    at = 0
    for piece in pieces:
        piece["at"] = at
        at += len(piece["letters"]) - piece["letters"].count("D")
    signs = "".join(p["key"][1:] for p in parts)
    blank = sum(p["blank"] for p in parts)
    turns = [(p["low"], p["high"], p["n_turns"]) for p in parts if p["low"] is not None]
    gaps = turns[-1][1] - turns[0][0] + 1 - sum(n for *_, n in turns) + sum(a[1] == b[0] for a, b in zip(turns, turns[1:])) if turns else 0
    full = [p for p in parts if p["first"] is not None]
    between = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(full, full[1:]))
    return {
        "gaps": gaps, "blank": blank, "duplicate": signs.count("d") - blank, "truncated": sum(map(str.isupper, signs)),
        "illegal": sum(p["illegal"] for p in parts) + between, "cost": cost, "audit": letters, "pieces": pieces,
    }


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PIECES = "pieces array<struct<chunk: long, state: int, letters: string, at: long>>"


def _repairs(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> tuple[DataFrame, DataFrame]:
    """Chunks with texts, and ``conv``, RESULT, PIECES of every conversation; both written."""
    bounded_batches(df.sparkSession)
    chunks = _chunks(df, conv, turn, role, text, gone)
    resolved = _resolved(chunks)
    answers = _answers(resolved)
    both = resolved.join(answers, "key")
    fields = ("chunk", "low", "high", "n_turns", "blank", "key", "first", "last", "illegal", "answers")
    grouped = both.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [joined(parts) for parts in batch.column(1).to_pylist()]
            columns = [pa.array([f[n] for f in found], t) for n, t in types.items()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["conv", *types])

    piece = pa.list_(pa.struct([("chunk", pa.int64()), ("state", pa.int32()), ("letters", pa.string()), ("at", pa.int64())]))
    types = {c.split()[0]: pa.string() if c.endswith("string") else pa.int64() for c in RESULT.split(", ")} | {"pieces": piece}
    found = materialise(grouped.mapInArrow(run, f"conv {grouped.dtypes[0][1]}, {RESULT}, {PIECES}"), "repairs")
    discard(resolved, answers)
    return chunks, found


def repaired_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """``conv, place, role, text``: the rows of repaired conversations, numbered from 0; those without any row have none."""
    chunks, found = _repairs(df, conv, turn, role, text, gone)
    pieces = found.select(F.explode("pieces").alias("p")).select("p.chunk", "p.state", "p.letters", "p.at")
    rows = chunks.select("chunk", "conv", "roles", "texts").join(pieces, "chunk").select("conv", "roles", "texts", "state", "letters", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (roles, texts, state, letters, at) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
                left = list(edited(zip(roles, texts), letters, state))
                columns = [pa.array([at + k for k in range(len(left))], pa.int64()), *(pa.array([r[j] for r in left], pa.string()) for j in (0, 1))]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(left), pa.int64())), *columns], names=["conv", "place", "role", "text"])

    found_rows = rows.mapInArrow(run, f"conv {rows.dtypes[0][1]}, place long, role string, text string")
    return owning(found_rows.withColumnRenamed("conv", conv), chunks, found)


def repair(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row per conversation: its id, ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    Rows stand by turn, nulls first, and rows of one turn by role and text in the order of code points. A null role or text
    counts as one space; null ids are one conversation. Rows for which the column ``gone`` is true count for nothing, but
    their conversation has a result: zeros, an empty audit and the digest of an empty string if it has no other row.
    Repeated rows are duplicates. ``gaps``: numbers missing between the least and the greatest turn, 0 without any turn.
    Edits: keep, give the role of a user or an assistant, delete, insert an empty row; blank rows and duplicates must go, and
    a truncated row that stays costs extra. ``audit``: initials of the cheapest edits that leave no row, or pairs of user and
    assistant after one system row at most; of equally cheap ones the least in ASCII. An empty table gives an empty result;
    other columns, whatever their names, play no part.

    No task has more than a range of sorted rows, a range of signatures, or what is told of a conversation in its own result;
    texts of a conversation with several chunks are hashed one after another.
    """
    chunks, found = _repairs(df, conv, turn, role, text, gone)
    names = [c.split()[0] for c in RESULT.split(", ")]
    told = F.struct(*names)
    last = F.size("pieces") - 1
    pieces = found.select("conv", told.alias("told"), last.alias("last"), F.posexplode("pieces").alias("nth", "p"))
    pieces = pieces.select("p.chunk", "p.state", "p.letters", (F.col("last") == 0).alias("only"), F.when(F.col("nth") == F.col("last"), F.col("told")).alias("told"))
    both = chunks.select("chunk", "conv", "roles", "texts").join(pieces, "chunk")
    text_kind = both.select("conv", "chunk", "only", "roles", "texts", "state", "letters", "told")

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for only, roles, texts, state, letters in zip(*(c.to_pylist() for c in batch.columns[2:7])):
                rows = [f"{r}:{t}" for r, t in edited(zip(roles, texts), letters, state)]
                said.append(hashlib.sha256("\n".join(rows).encode()).hexdigest() if only else "\n".join(rows) if rows else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(said, pa.string()), batch.column(7)], names=["conv", "chunk", "only", "said", "told"])

    kind = both.schema["conv"].dataType.simpleString()
    inner = ", ".join(c.replace(" ", ": ") for c in RESULT.split(", "))
    said = text_kind.mapInArrow(left, f"conv {kind}, chunk long, only boolean, said string, told struct<{inner}>")
    dealt = said.repartition("conv").sortWithinPartitions("conv", "chunk")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, begun = hashlib.sha256(), False
        for batch in batches:
            at, sums = [], []
            for i, (only, text, ends) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).is_valid().to_pylist())):
                if not only and text is not None:
                    digest.update(("\n" if begun else "").encode() + text.encode())
                    begun = True
                if ends:
                    at.append(i)
                    sums.append(text if only else digest.hexdigest())
                    digest, begun = hashlib.sha256(), False
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column(0), *kept.column(4).flatten(), pa.array(sums, pa.string())], names=["conv", *names, "repaired_sha256"])

    return owning(dealt.mapInArrow(hashed, f"conv {kind}, {RESULT}, repaired_sha256 string").withColumnRenamed("conv", conv), chunks, found)


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone`` of ``conv_id, turn, role, text``, some rows damaged by a checksum of conversation and
    turn, of which null is one space, as a null role or text is: gone, emptied, without end marks, repeated, or said to be a user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, F.lit("")).when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("h") == 3, F.lit(2)).otherwise(F.lit(1))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("h") == 0).alias("gone"), times.alias("_")).drop("_")


def repair_sql() -> str:
    """DuckDB SQL for all ``conversations`` with the damage of ``damaged``: every state row by row, with whole audits and texts.
    The CRC-32 of a key is worked out bit by bit."""
    keeps = [(a, "K", f"'{role}'", b, "NULL") for (a, role), b in KEPT.items()]
    others = [m for a, b in NEXT.items() for m in ((a, "D", "NULL", a, "NULL"), (a, "R", "NULL", b, f"'{SPOKEN[b]}'"))]
    moves = ", ".join(f"({a}, '{letter}', {initial}, {b}, {role})" for a, letter, initial, b, role in keeps + others)
    inserts = []
    for state in NEXT:
        at, said = state, "''"
        for n in range(3):
            inserts.append(f"({state}, {n}, {at}, {said})")
            at = NEXT[at]
            said += f" || chr(10) || '{SPOKEN[at]}:'"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""WITH RECURSIVE moves(state, letter, initial, next, said_by) AS (VALUES {moves}), inserts(state, n, next, said) AS (VALUES {", ".join(inserts)}),
convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (
  SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
  FROM conversations v JOIN convs ON v.conv_id IS NOT DISTINCT FROM convs.conv_id
), hashed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda x: [ord(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 20 AS h FROM keyed
), left_over AS (
  SELECT c, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(generate_series(1, CASE h WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
         right(rtrim(text, {blanks}), 1) AS mark FROM left_over
), judged AS (
  SELECT c, turn, i, role, text, left(role, 1) AS initial, left(lag(role) OVER (PARTITION BY c ORDER BY i), 1) || left(role, 1) AS pair,
         CASE WHEN mark = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen
), counted AS (
  SELECT c, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY c
), solved AS (
  SELECT c, 0::BIGINT AS i, s.next AS state, {INSERT} * n::BIGINT AS cost, repeat('I', n) AS audit, said FROM convs, inserts s WHERE s.state = {START}
  UNION ALL
  SELECT * FROM (
    SELECT s.c, s.i + 1, e.next, s.cost + CASE letter WHEN 'D' THEN {DELETE} WHEN 'R' THEN {REROLE} ELSE 0 END + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN {TRUNCATED} ELSE 0 END + {INSERT} * n AS cost,
           s.audit || letter || repeat('I', n) AS audit, s.said || CASE letter WHEN 'D' THEN '' ELSE chr(10) || coalesce(said_by, role) || ':' || text END || e.said
    FROM solved s JOIN judged j ON j.c = s.c AND j.i = s.i + 1
    JOIN moves m ON m.state = s.state AND (letter = 'D' OR fault NOT IN ('blank', 'duplicate')) AND (m.initial IS NULL OR m.initial = j.initial) JOIN inserts e ON e.state = m.next
  ) QUALIFY row_number() OVER (PARTITION BY c, next ORDER BY cost, audit) = 1
), ends AS (
  SELECT s.c, cost, audit, said FROM solved s LEFT JOIN counted n ON n.c = s.c WHERE s.i = coalesce(n.n, 0) AND state IN {COMPLETE}
  QUALIFY row_number() OVER (PARTITION BY s.c ORDER BY cost, audit) = 1
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(substr(said, 2)) AS repaired_sha256 FROM convs JOIN ends USING (c) LEFT JOIN counted USING (c)"""
