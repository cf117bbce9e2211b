"""Session helpers shared by operators: table access and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Only in a single JVM (local mode), and only where that setting is absent, is a folder of our
    own used; a cluster without it is refused, since its machines share no temporary folder.
    """
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "strandframe-checkpoints"))
    return spark.sparkContext.getCheckpointDir()


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for files that another step reads."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def read_bytes(df: DataFrame) -> int:
    """Size of the files that a plan reads, known at planning time."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


#: Rows that a side measured for a broadcast may have.
BROADCAST_ROWS = 500_000


def measured(df: DataFrame) -> DataFrame:
    """A side of a join, for a broadcast if its measured size allows.

    If all that it reads is below the planner's broadcast threshold, the planner sees to it.
    Otherwise the side is computed once, written to the shared checkpoint folder and counted: up
    to BROADCAST_ROWS it is broadcast, beyond that the join shuffles both sides.
    """
    if read_bytes(df) <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return df
    fixed = shared_checkpoint(df)
    return F.broadcast(fixed) if fixed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else fixed
