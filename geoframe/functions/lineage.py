"""Cutting lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of a row a group that have no more rows are sent to all tasks.
FEW = 10_000


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, which executors share, and read from there.

    For tables that a job reads many times, or whose plan would be planned anew for
    each.  On a local master, where spark.checkpoint.dir is unset, a temporary folder serves.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a job's files beside the checkpoints, which all executors reach."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    """How many tasks a shuffle is dealt to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(df: DataFrame, groups: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """df with the rows of its group (one each, or some maps each).

    Groups are written down and counted first: where they are few, df stays where it
    is, and a large group is not sent to one task; where they are many, both are dealt by group.
    """
    return by_written_group(df, checkpointed(groups), by, how)


def by_written_group(df: DataFrame, groups: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """by_group() of groups that are cheap to read again."""
    return df.join(sent_if_few(groups), by, how)


def sent_if_few(groups: DataFrame) -> DataFrame:
    """Written groups, to be sent to all tasks where they are few."""
    return F.broadcast(groups) if groups.limit(FEW + 1).count() <= FEW else groups
