"""What all parts need of the session: the shared folder, tables written to cut lineage, files of any store."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Lists of scratch folders made inside each open :func:`intermediates`.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where none is set a local session (a test) gets a temporary one; on a cluster that is an error, as a
    machine's own folder is not seen by the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
        folder = folder and folder.rsplit("/", 1)[0]
    if not folder:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="pathweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver's JVM ends or :func:`intermediates` does."""
    path = f"{shared_dir(spark)}/pathweave-{uuid.uuid4().hex}/{tag}"
    top = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(top)
    system.deleteOnExit(top)
    for made in _OPEN:
        made.append(path.rsplit("/", 1)[0])
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside at the end; results that read them must have been used by then."""
    made: list[str] = []
    _OPEN.append(made)
    try:
        yield
    finally:
        _OPEN.remove(made)
        for path in made:
            delete(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    An iteration that reads its own result this way has a plan of constant size, survives lost executors,
    and tells the optimizer how large the result is.
    """
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_output(uri: str):
    """A binary stream on a new file of any file system that Arrow knows; parents are made."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    return system.open_output_stream(path, compression=None)


def open_input(uri: str):
    """A seekable binary file."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)
    return system.open_input_file(path)
