"""Logs that grow while they are read, by Structured Streaming. Files land whole: one for each batch of entries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..sources.sinks import upsert

POLL = "2 seconds"


def entries(spark: SparkSession, folder: str) -> DataFrame:
    """New log entries as they arrive; broken and cut-off lines are none."""
    lines = spark.readStream.format("text").load(folder)
    return lines.select(F.from_json("value", schemas.TRAJECTORY).alias("v")).select("v.*").filter("task_id is not null")


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """The last progress of each run; run it in complete or update mode. The state is one row for each run."""
    rows = spark.readStream.schema(schemas.PROGRESS).json(folder)
    return rows.groupBy("run_id").agg(F.max_by(F.struct("phase", "completed", "total", "updated_at"), "updated_at").alias("p")).select("run_id", "p.*")


def passed_state(spark: SparkSession, folder: str) -> DataFrame:
    """Per program the first iteration whose gate passed and the last one seen. PASS absorbs, so a minimum and a maximum say it all, in any order of arrival; the state is two numbers a program."""
    rows = entries(spark, folder).withColumn("passed", F.coalesce(F.get_json_object("hidden", "$.passed").cast("boolean"), F.lit(False)))
    return rows.groupBy("run_id", "task_id").agg(F.min(F.when(F.col("passed"), F.col("iteration"))).alias("passed_at"), F.max("iteration").alias("last_iteration"))


def start(rows: DataFrame, target: str, checkpoint: str, mode: str = "append", once: bool = True, form: str = "parquet"):
    """Z3: to files, exactly once by the checkpoint: all that is there, or every ``POLL``."""
    writer = rows.writeStream.format(form).outputMode(mode).option("checkpointLocation", checkpoint).option("path", target)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def start_upsert(rows: DataFrame, target: str, checkpoint: str, key: list[str], partition: str, once: bool = True):
    """The changed rows of each batch replace those with their key; a batch that is written twice gives the same table."""
    writer = rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: upsert(batch, target, key, partition))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def output_tail(spark: SparkSession, folder: str, size: int = 200) -> DataFrame:
    """The last lines of output files, files as they were written, then places in them; a top-n over what has landed."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    return lines.orderBy(F.desc("modified"), F.desc("file"), F.desc("block"), F.desc("at")).limit(size).orderBy("modified", "file", "block", "at").select("value")
