"""Session settings and the shared folder."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

from logweir.sources.storage import qualified


LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def configure(spark: SparkSession) -> SparkSession:
    """Settings the JSON functions and the line numbers rely on.

    Repeated keys in a JSON object are legal, the last one counts. The least number of scan
    partitions is pinned, so that two scans of one log are cut alike even when executors
    come and go in between.
    """
    # The few Python helpers travel to tasks by value: executors need no copy of the package.
    cloudpickle.register_pickle_by_value(sys.modules["logweir"])
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        parallelism = spark.sparkContext.defaultParallelism
        spark.conf.set("spark.sql.files.minPartitionNum", str(parallelism))
    if spark.conf.get(LISTING_TASKS, None) in (None, "10000"):
        # Not one task for every log of a folder.
        spark.conf.set(LISTING_TASKS, str(4 * spark.sparkContext.defaultParallelism))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session may go without one: there, one
    machine is all the cluster."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="logweir-")
        context.setCheckpointDir(folder)
    return qualified(spark, folder)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/logweir/{name}-{uuid.uuid4().hex}"


# Text per task of a shuffle.
TASK_BYTES = 128 * 1024 * 1024


def shuffle_width(spark: SparkSession, size: int) -> int | None:
    """Number of tasks for ``size`` bytes of text; None where the session's width, which AQE
    may still narrow, makes small enough tasks."""
    needed = -(-size // TASK_BYTES)
    return needed if needed > int(spark.conf.get("spark.sql.shuffle.partitions")) else None
