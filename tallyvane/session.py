"""Session helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, from spark.checkpoint.dir. A temporary one only where none is named and all tasks
    run in this process; on a cluster that is an error, as executors would not see it."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or os.path.join(tempfile.mkdtemp(prefix="spark-"), "checkpoints"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, for files that are written and read back."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def keep(df: DataFrame) -> DataFrame:
    """cut for many rows: as columns, of which later steps read those they need, in a fraction of the space."""
    path = scratch(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether df has at most that many rows, and may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def lean(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df for one side of a join: marked for broadcast if it is small, else as it is, to be shuffled."""
    return F.broadcast(df) if small(df, rows) else df


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and benches on one machine."""
    conf = {"spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"}
    return SparkSession.builder.master(f"local[{cores}]").config(map=conf).getOrCreate()
