"""WARC archives: writing whole-file gzip streams, normalising them to one member per record, reading them back.

A whole-file stream cannot be entered in its middle. The normaliser inflates it once, in bounded pieces, writes every
record as a gzip member of its own, and a sidecar index of offsets; after that any record is one short read. Payloads that
occur more than once become revisits in the same pass: which ones is worked out from digests alone, so a payload goes from
its row to the archive and is never shuffled. Every attempt of a task writes files of its own names, and only those of the
attempt that succeeds are known to the next step, so lost executors leave nothing that is read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.common import bounded_batches, discard, materialise, new_path, owning
from docstrata.sources.files import new_file, opened, qualified, unique

#: Bytes of payload after which a writer starts a new archive; bytes inflated at a time; gzip level.
ARCHIVE_BYTES, PIECE, LEVEL = 64 << 20, 1 << 18, 3
#: Archives are normalised in as many tasks, up to this number.
MAX_TASKS = 20_000
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
GZIP = 31
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes) -> bytes:
    """A WARC/1.1 response record."""
    one_line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: {page_urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {one_line}", f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html", f"Content-Length: {len(payload)}",
    ]
    return "\r\n".join([*head, "", ""]).encode() + payload + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def as_revisit(data: bytes, refers_to: int | None) -> bytes:
    """A response record as a revisit of an equal payload: the same headers, without the payload."""
    head = data.partition(b"\r\n\r\n")[0].decode().split("\r\n")
    head = [x for x in head if not x.lower().startswith(("warc-type:", "content-length:"))]
    head[1:1] = ["WARC-Type: revisit"]
    head += [
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
        f"WARC-Refers-To: {page_urn(refers_to)}",
        "Content-Length: 0",
    ]
    return "\r\n".join([*head, "", ""]).encode() + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and body of one record; raises ValueError if it is not one whole record."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(fields["content-length"])
    if not first.startswith("WARC/") or not mark or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    return fields, rest[:n]


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from a stream of inflated pieces; holds one record and one piece at a time."""
    held, need = bytearray(), 0
    for piece in pieces:
        held += piece
        while True:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = next(int(x[15:]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
                need = end + 4 + length + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held.strip():
        raise ValueError("the stream ends within a record")


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """The bytes of a gzip stream, of one member or several, in bounded pieces. A stream that ends within a member, or within
    the checksum after it, is an error: a cut may fall between two records."""
    z = zlib.decompressobj(GZIP)
    left, within = b"", False
    while True:
        data = left or read(PIECE)
        left = b""
        if not data:
            break
        while data:
            yield z.decompress(data, PIECE)
            data, within = z.unconsumed_tail, True
            if z.eof:
                left, z, data, within = z.unused_data, zlib.decompressobj(GZIP), b"", False
    if within:
        raise ValueError("the stream ends within a gzip member")


def normalise(source: str, target: str, revisits: dict[int, int | None] | None = None) -> list[tuple[int, int, int]]:
    """Rewrite an archive, one member per record, with a sidecar ``target + '.idx'`` of ``number offset length`` lines, and
    return those numbers. The records whose numbers are in ``revisits`` become revisits of the page given there."""
    system, at = opened(source)
    index, offset = [], 0
    with system.open_input_stream(at, compression=None) as src, new_file(target) as out:
        for i, data in enumerate(records_of(inflated(src.read))):
            if revisits and i in revisits:
                data = as_revisit(data, revisits[i])
            z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
            member = z.compress(data) + z.flush()
            out.write(member)
            index.append((i, offset, len(member)))
            offset += len(member)
    with new_file(target + ".idx") as out:
        out.write("".join(f"{i} {a} {n}\n" for i, a, n in index).encode())
    return index


RECORDS = "path string, number long, page_id long, digest string, payload_bytes long"


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(rows, None)
        while row is not None:
            path, size, found = unique(f"{folder}/whole-{part:06d}.warc.gz"), 0, []
            with new_file(path) as out:
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                while row is not None and size < ARCHIVE_BYTES:
                    page_id, url, html = row
                    payload = html or b""
                    data = record(page_id, url, payload)
                    out.write(z.compress(data))
                    found.append((path, len(found), page_id, digest32(payload), len(payload)))
                    size, row = size + len(data), next(rows, None)
                out.write(z.flush())
            columns = list(zip(*found))
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in RECORDS.split(", ")])

    return run


def _normalise(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, revisits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                target = unique(f"{folder}/{path.rpartition('/')[2].replace('whole-', 'members-')}")
                index = normalise(path, target, {r["number"]: r["best"] for r in revisits or ()})
                yield pa.RecordBatch.from_arrays(
                    [pa.array([target] * len(index), pa.string()), *(pa.array([x[k] for x in index], pa.int64()) for k in range(3))],
                    names=["path", "number", "offset", "length"],
                )

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = lambda s: int(s[10:-1]) if len(s) > 11 else None  # noqa: E731  <urn:page:N>
    file, last = None, None
    try:
        for batch in batches:
            rows = []
            for path, offset, length in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if path != last:
                    if file:
                        file.close()
                    system, at = opened(path)
                    last, file = path, system.open_input_file(at)
                fields, body = parse_record(zlib.decompress(file.read_at(length, offset), GZIP))
                kind, said = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and digest32(body) != said:
                    raise ValueError(f"payload digest does not fit in {path} at {offset}")
                n = len(body) if kind == "response" else int(fields["x-payload-length"])
                rows.append((number(fields["warc-record-id"]), n, said, kind, number(fields.get("warc-refers-to", ""))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )
    finally:
        if file:
            file.close()


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a response record per row of ``page_id, url, html`` into whole-file gzip archives, each task its own; a written
    table of what stands where: ``path, number, page_id, digest, payload_bytes``. No row moves."""
    bounded_batches(pages.sparkSession)
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.encode(F.col("html").cast("string"), "UTF-8").alias("html"),
    )
    return materialise(rows.mapInArrow(_write(qualified(pages.sparkSession, folder)), RECORDS), "records")


def revisits(records: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Every archive of a table of records, and its records that are to be revisits: ``path, revisits``, the latter a list of
    ``number, best``. Of equal payloads of ``revisit_bytes`` or more the one with the largest id is the response. Only
    digests and numbers move; the largest ids are written before they are joined, so that a payload which very many
    records share is split."""
    large = records.where(F.col("payload_bytes") >= revisit_bytes)
    best = large.groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("copies")).where("copies > 1")
    best = materialise(best.select("digest", "best"), "best")
    found = large.join(best, "digest").where("not (page_id <=> best)").select("path", "number", "best")
    lists = found.groupBy("path").agg(F.collect_list(F.struct("number", "best")).alias("revisits"))
    return owning(records.select("path").distinct().join(lists, "path", "left"), best)


def normalise_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise the archives of a table ``path, revisits`` into ``folder``; a written table of the index: ``path, number,
    offset, length``. Each archive is a task's, and its index holds only as many rows as the archive has records."""
    spark = archives.sparkSession
    listed = materialise(archives, "archives")
    paths = listed.repartition(max(1, min(listed.count(), MAX_TASKS)), "path")
    index = paths.mapInArrow(_normalise(qualified(spark, folder)), "path string, number long, offset long, length long")
    found = materialise(index, "index")
    discard(listed)
    return found


def read_archives(index: DataFrame) -> DataFrame:
    """Each record of an index, by one short read: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.
    A response's digest is computed from what was read; a revisit's is the one it states."""
    return index.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_round_trip(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Write a record per page, normalise the archives and read them back; one row per input row.

    ``pages``: ``page_id, url, html``; other columns, whatever their names, play no part. Null html is an empty payload;
    a null url is an empty target. A null id is smaller than any other. Rows that repeat the id and payload of the
    response are responses too. An empty table gives no archives and an empty result. Records are held one at a time.
    """
    spark = pages.sparkSession
    whole, members = new_path(spark, "warc-whole"), new_path(spark, "warc-members")
    records = owning(write_archives(pages, whole), whole)
    marked = revisits(records, revisit_bytes)
    index = normalise_archives(marked, members)
    discard(marked, records)
    return owning(read_archives(index), index, members)


def archive_sql() -> str:
    """DuckDB SQL of ``archive_round_trip`` over ``pages``."""
    value = "(instr('0123456789abcdef', substr(hex, 5 * g + {}, 1)) - 1)"
    twenty = " + ".join(f"{value.format(i + 1)} * {16 ** (4 - i)}" for i in range(5))
    chars = " || ".join(f"substr('{BASE32}', 1 + CAST((({twenty}) // {32**k}) % 32 AS BIGINT), 1)" for k in (3, 2, 1, 0))
    return f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS best FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {chars}), '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> best THEN best END AS refers_to
FROM r"""
