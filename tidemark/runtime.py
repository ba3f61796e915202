"""What every operator needs from the session: code on the executors and shared storage."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Bytes of rows that go to Python at once, unless the session has a setting of its own.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"

#: Lets go of a write's shuffle files when it ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, and bound the batches that Python gets."""
    if not spark._jsparkSession.sessionState().conf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="tidemark-"), "tidemark.zip")
    with open(path, "wb") as f:
        f.write(buffer.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Only where that setting is absent and everything runs on one machine (tests) a
    local folder is made and set as the context's checkpoint folder. A cluster
    without the setting is an error, as its executors would write to folders of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors see")
        found = "file://" + tempfile.mkdtemp(prefix="tidemark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage: whoever reads the result no longer depends on the
    shuffle files of executors that may be lost. Inside a ``Scratch`` block the
    table goes when the block ends; else it stays until the folder is cleaned.
    """
    if Scratch.stack:
        return Scratch.stack[-1].table(df, name)
    return _written(df, shared_path(df.sparkSession, name))


def _written(df: DataFrame, path: str) -> DataFrame:
    """Write and read back. The shuffle files of the write go when the table is there, since nothing reads them any more."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN, None)
    conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.unset(CLEAN) if before is None else conf.set(CLEAN, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of the shared folder that are deleted when the ``with`` block ends.

    What a block returns must not read them any more: return ``result`` of it,
    which is a table of the enclosing block, or of nobody if there is none.
    """

    stack: list[Scratch] = []  # the blocks that are open, of the one thread that builds plans

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def table(self, df: DataFrame, name: str = "scratch") -> DataFrame:
        self.paths.append(shared_path(self.spark, name))
        return _written(df, self.paths[-1])

    def result(self, df: DataFrame, name: str = "result") -> DataFrame:
        path = shared_path(self.spark, name)
        at = self.stack.index(self)
        if at:
            self.stack[at - 1].paths.append(path)
        return _written(df, path)

    def drop(self) -> None:
        """Delete what there is so far."""
        while self.paths:
            remove(self.spark, self.paths.pop())

    def __enter__(self) -> Scratch:
        self.stack.append(self)
        return self

    def __exit__(self, *_) -> None:
        self.stack.remove(self)
        self.drop()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder through Spark's file systems."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
