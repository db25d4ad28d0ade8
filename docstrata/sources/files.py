"""Files that Python workers read and write by themselves, in the same file systems as Spark's tables."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme and the authority that Spark takes it to have: a plain one lies in the default file system,
    which workers would not know."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a qualified path, or a ValueError where pyarrow has no file system for its scheme."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        raise ValueError(f"not a qualified path: {uri}")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri = "s3:" + rest
    try:
        return fs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid as e:
        raise ValueError(f"no file system for {scheme}: use file, hdfs, s3, gs or abfs") from e


def unique(uri: str) -> str:
    """A name that no other attempt of a task uses: its number goes before the name's first dot. A lost task's files stay
    unknown, because only the rows of the attempt that succeeds are kept; nothing is renamed."""
    folder, slash, name = uri.rpartition("/")
    stem, dot, rest = name.partition(".")
    return f"{folder}{slash}{stem}-{uuid4().hex[:12]}{dot}{rest}"


@contextmanager
def new_file(uri: str) -> Iterator[BinaryIO]:
    """A file to write; it is deleted if writing fails."""
    system, at = opened(uri)
    system.create_dir(at.rsplit("/", 1)[0], recursive=True)
    try:
        with system.open_output_stream(at, compression=None) as out:
            yield out
    except BaseException:
        if system.get_file_info(at).type == fs.FileType.File:
            system.delete_file(at)
        raise


def replace(uri: str, data: bytes) -> None:
    """Write a whole file under its name, over an older one: aside first, so that readers see one or the other."""
    aside = unique(uri)
    with new_file(aside) as out:
        out.write(data)
    system, at = opened(uri)
    if system.get_file_info(at).type == fs.FileType.File:
        system.delete_file(at)
    system.move(opened(aside)[1], at)
