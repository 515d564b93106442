"""Cutting lineage in loops: written to the folder in spark.checkpoint.dir, so a lost executor costs one round at most."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: What Spark takes for a size that it doesn't know, in bytes.
LONGEST = 2**63 - 1


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local one, if driver and executors are one process; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext._jsc.sc()
        if context.getCheckpointDir().isDefined():
            return context.getCheckpointDir().get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="snapweave-")
    return found


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return _unknown_size(df.checkpoint(eager=True))


def _unknown_size(df: DataFrame) -> DataFrame:
    """A checkpointed df, of unknown size to the planner if its estimate is beyond a long.

    Checkpoints hand on the estimate of their plan, which for a join is the product of both sides. A loop over joins doubles its digits
    each round: after some 25 rounds one number takes most of the driver's heap, however few rows there are.
    """
    plan, spark = df._jdf.logicalPlan(), df.sparkSession
    if plan.stats().sizeInBytes() <= LONGEST:
        return df
    jvm = spark.sparkContext._jvm
    held = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, jvm.scala.Option.empty(), jvm.scala.Option.apply(plan.constraints()))
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, held), spark)
