"""The folder that driver and executors share, for what has to be written between two steps."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset: a new temporary one if all runs on this machine, as in tests, else an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir isn't set: driver and executors need a folder that they share")
        context.setCheckpointDir(named or f"{tempfile.gettempdir()}/checkpoints/{uuid.uuid4().hex}")
    return named or context.getCheckpointDir()


#: Spark's setting for it.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession, **more: str) -> Iterator[None]:
    """Shuffle files of what is written in the meantime go when it is written: nothing reads them again. more: other settings for this time, with _ for each dot."""
    settings = {CLEANUP: "true"} | {k.replace("_", "."): v for k, v in more.items()}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def written_once(df: DataFrame) -> DataFrame:
    """The rows as they are now, in the partitions they are in, from the checkpoint folder; the shuffle files behind them go."""
    shared_folder(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # select: a plan made under the setting


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
