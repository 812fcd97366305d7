"""What a session needs beyond Spark's own settings: this package on the workers, a folder that all of them share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch, where the session has Spark's default of 10 000: whole documents are large rows. This setting,
#: and filter pushdown into Python sources by the WARC reader, are the two that stay changed in a caller's session: Spark
#: reads both when a plan runs.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: the driver serves it as a zip, once a context."""
    context = spark.sparkContext
    if spark.conf.get(BATCH[0], BATCH[1]) == BATCH[1]:
        spark.conf.set(BATCH[0], BATCH[2])
    if getattr(context, "_kinweave_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="kinweave-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    name = os.path.join(folder, "kinweave.zip")
    with zipfile.ZipFile(name, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.join("kinweave", os.path.relpath(os.path.join(folder, f), top)))
    context.addPyFile(name)
    context._kinweave_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and the master is local, one of
    our own, which goes when the process ends; on a cluster that raises, as executors wouldn't see a local folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context.getCheckpointDir()
        if held:
            found = held.rsplit("/", 1)[0]
        elif context.master.startswith("local") and not context.master.startswith("local-cluster"):
            own = tempfile.mkdtemp(prefix="kinweave-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            found = f"file://{own}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(found)
    return found


def scratch_dir(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_dir(spark)}/kinweave-{uuid.uuid4().hex}"


def tasks(spark: SparkSession) -> int:
    """Into how many tasks to deal rows of which each is much work: Spark merges partitions by their bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def together(*steps: Callable[[], Any]) -> list[Any]:
    """The results of steps that do not need each other, run side by side: cores that one leaves idle are another's."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: of a large one readers take only their columns, which a checkpoint has none of."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
