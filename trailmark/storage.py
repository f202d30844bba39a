"""Session set-up and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", app: str = "trailmark", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    settings = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables, as named by ``spark.checkpoint.dir``.

    Only a local session may fall back on a folder of its own: on a cluster a
    machine-local folder would lose the table together with its executor.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="trailmark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


_folder: ContextVar[str | None] = ContextVar("folder", default=None)


@contextmanager
def workspace(spark: SparkSession) -> Iterator[str]:
    """Intermediate tables of the code inside go to a folder of its own, which is removed at the end.

    Store results before leaving: what has not been computed by then cannot be any more.
    """
    folder = f"{shared_folder(spark)}/trailmark/run-{uuid.uuid4().hex}"
    token = _folder.set(folder)
    try:
        yield folder
    finally:
        _folder.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def in_few_files(frame: DataFrame) -> DataFrame:
    """``frame`` dealt to as many tasks as there are cores, or a 32nd of the shuffle partitions if that is more.

    Only where Spark is told not to merge small partitions after a shuffle: each of them would be a file.
    """
    spark = frame.sparkSession
    merging = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.coalescePartitions.enabled")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(spark.sparkContext.defaultParallelism, partitions // 32)
    if files >= partitions or all(spark.conf.get(key).lower() == "true" for key in merging):
        return frame
    return frame.repartition(files)


def materialize(frame: DataFrame, label: str, small: bool = False) -> DataFrame:
    """Write ``frame`` as Parquet to the shared folder and read it back.

    The copy cuts the lineage, survives lost executors, keeps column pruning
    for the readers, and gives the planner the table's true size, so that it
    broadcasts a join side only when that side is really small. It stays until
    its ``workspace`` is left or the folder's ``trailmark`` part is deleted.

    ``small`` says that the rows are short (names, places, links), so that a file
    for every partition would hold next to nothing: see ``in_few_files``.
    """
    spark = frame.sparkSession
    folder = _folder.get() or f"{shared_folder(spark)}/trailmark"
    path = f"{folder}/{label}-{uuid.uuid4().hex}"
    (in_few_files(frame) if small else frame).write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
