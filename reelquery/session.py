"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reelquery")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_folder(spark: SparkSession) -> None:
    """Point the context at the folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a scratch folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` as a written table in the shared folder.

    A table is computed once (``DataFrame.checkpoint`` computes twice), survives lost executors, is
    read column-pruned, and has a known size, so Spark broadcasts it only when it really is small.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_RUN: ContextVar[str | None] = ContextVar("run_folder", default=None)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, for tables written between steps."""
    ensure_checkpoint_folder(spark)
    return f"{_RUN.get() or spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@contextmanager
def stored_tables(spark: SparkSession) -> Iterator[str]:
    """Owner of the tables a run stores between its steps: they go when the block ends.

    Results are lazy, so write or collect them inside the block.
    """
    ensure_checkpoint_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"
    token = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
