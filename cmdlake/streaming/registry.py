"""The command fold on streams: the same latest-event fold as in batch, kept by Structured Streaming.

State is one row per target. Each batch's changed rows go to a table in the shared folder, a folder for each batch, so a batch that
runs again replaces its own; no agent goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..schemas import COMMAND_TYPES
from ..sources.fixtures import commands

EVENTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
    ]
)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster it must be named."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        found = f"file://{tempfile.mkdtemp(prefix='cmdlake-stream-')}"
    return found.rstrip("/")


def command_stream(spark: SparkSession, folder: str, glob: str = "events.parquet", files_per_batch: int = 1) -> DataFrame:
    """Commands as a stream of the event files that appear in folder."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch)
    return commands(reader.parquet(folder))


def live_agents(stream: DataFrame) -> DataFrame:
    """A row for each target with its last creation and deletion; state is one row per target."""
    at = F.struct("ts", "command_id")
    made, gone = (F.max(F.when(F.col("command_type") == k, at)) for k in ("create_agent", "delete_agent"))
    return stream.groupBy("target_id").agg(made.alias("made"), gone.alias("gone"))


def answers(stream: DataFrame) -> DataFrame:
    """(command_id, target_id, status, error) for each command; one that can't be handled fails by itself, and the stream goes on."""
    kind = F.col("command_type")
    error = F.when(kind.isNull() | ~kind.isin(*COMMAND_TYPES), F.concat(F.lit("Error processing command: unknown type "), F.coalesce(kind, F.lit("None")))).when(
        F.col("target_id").isNull() & ~kind.isin("create_agent", "list_agents", "get_system_status"), F.concat(F.lit("target_id is required for command type: "), kind)
    )
    return stream.select("command_id", "target_id", F.when(error.isNull(), "accepted").otherwise("failure").alias("status"), error.alias("error"))


def task_events(stream: DataFrame) -> DataFrame:
    """A row for each task with its making and its canceling, as far as the stream has gone; whether the agent was there is told by the batch fold."""
    task = F.when(F.col("command_type") == "execute_task", F.col("command_id")).when(F.col("command_type") == "cancel_task", F.col("task_ref"))
    rows = stream.where(F.col("command_type").isin("execute_task", "cancel_task")).withColumn("task_id", task)
    made = F.max(F.when(F.col("command_type") == "execute_task", F.col("target_id"))).alias("agent_id")
    return rows.groupBy("task_id").agg(made, F.max((F.col("command_type") == "cancel_task").cast("int")).alias("canceled"))


def to_table(rows: DataFrame, path: str, checkpoint: str, mode: str = "update", interval: str | None = None, route: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Writes each batch of rows below path; interval is the trigger's, else all that is there is read once.

    route, where given, changes a batch before it is written, for example to the responses that go back to their sources.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        (route(batch) if route else batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batch={batch_id:09}")

    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def latest(spark: SparkSession, path: str, key: str, schema: T.StructType) -> DataFrame:
    """The last written row of each key of a table of batches."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{path}/batch=*")
    values = F.struct(*[F.col(f.name) for f in schema.fields if f.name != key])
    return rows.groupBy(key).agg(F.max_by(values, "batch_id").alias("r")).select(key, "r.*")


def run_once(spark: SparkSession, folder: str, name: str, checkpoint: str, glob: str = "events.parquet") -> DataFrame:
    """Folds all that is in folder now, and returns the agents that exist."""
    folded = live_agents(command_stream(spark, folder, glob))
    path = f"{checkpoint}-{name}"
    to_table(folded, path, checkpoint).awaitTermination()
    rows = latest(spark, path, "target_id", folded.schema)
    return rows.where("made is not null and (gone is null or made > gone)").select(F.col("target_id").alias("id"), F.lit("running").alias("status"))


def run_answers(spark: SparkSession, folder: str, name: str, checkpoint: str, glob: str = "events.parquet", change: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Answers all commands that are in folder now, through the table that a source would read them from; change is applied to the commands first."""
    rows = answers(change(command_stream(spark, folder, glob)))
    path = f"{checkpoint}-{name}"
    to_table(rows, path, checkpoint, mode="append").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/batch=*").select(*rows.columns)


def run_tasks(spark: SparkSession, folder: str, name: str, checkpoint: str, glob: str = "events.parquet") -> DataFrame:
    """(task_id, agent_id, status) of all tasks asked for in folder: pending, or canceled once a cancel names them."""
    folded = task_events(command_stream(spark, folder, glob))
    path = f"{checkpoint}-{name}"
    to_table(folded, path, checkpoint).awaitTermination()
    rows = latest(spark, path, "task_id", folded.schema).where("agent_id is not null")
    return rows.select("task_id", "agent_id", F.when(F.col("canceled") == 1, "canceled").otherwise("pending").alias("status"))


def stop(*queries: StreamingQuery, seconds: int = 5) -> None:
    """Stops queries, waiting a bounded time for each."""
    for q in queries:
        q.stop()
        q.awaitTermination(seconds)
