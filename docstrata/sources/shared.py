"""The shared folder of a cluster, and tables written there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset a local folder is made if all
    executors are in this process; on a cluster it is an error, since they would not see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="docstrata-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docstrata/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors, gives exact sizes."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._written_to = path
    return written


def owning(df: DataFrame, *tables: DataFrame | str) -> DataFrame:
    """``df``, which reads written tables (or folders of ``new_path``): ``discard`` of it deletes them too."""
    df._owned = [*getattr(df, "_owned", ()), *tables]
    return df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Paths of the folders within one; none where it does not exist."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in system.listStatus(hadoop) if f.isDirectory()] if system.exists(hadoop) else []


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables that ``materialise`` itself returned, and those that a frame owns, when nothing reads them
    any more; any other frame's files are left alone."""
    for df in frames:
        for part in getattr(df, "_owned", ()):
            if isinstance(part, str):
                delete(df.sparkSession, part)
            else:
                discard(part)
        path = getattr(df, "_written_to", None)
        if path:
            delete(df.sparkSession, path)
