"""The driver's tables as commands, tasks and workers (bindings of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.payload import last_wins

COMMAND_OF = {"signup": "create_agent", "click": "execute_task", "view": "get_agent_status", "purchase": "cancel_task", "error": "delete_agent"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(mapping: dict[str, str], c: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c]


def props_k(c: Column | str = "props") -> Column:
    return F.get_json_object(c, "$.k").cast("long")


def commands(events: DataFrame) -> DataFrame:
    """events as commands: the user is the target, a purchase cancels the task of event_id - k - 1."""
    kind = lookup(COMMAND_OF, F.col("event_type"))
    return events.select(
        F.col("event_id").alias("command_id"), "ts", kind.alias("command_type"), F.col("user_id").alias("target_id"),
        F.when(kind == "cancel_task", F.col("event_id") - props_k() - 1).alias("task_ref"),
        F.concat(F.lit("type"), (props_k() % 3).cast("string")).alias("agent_type"), F.col("props").alias("payload"),
    )


WORKER_STATUS = {"0": "idle", "1": "processing_task", "2": "error", "3": "mcp_tool_busy", "4": "initializing"}


def workers(supplier: DataFrame) -> DataFrame:
    """Suppliers as workers: every seventh is an orchestrator, the status goes by the key modulo five."""
    key = F.col("s_suppkey")
    return supplier.select(
        key.alias("worker_id"), lookup(WORKER_STATUS, (key % 5).cast("string")).alias("status"),
        F.when(key % 7 == 0, "orchestrator").otherwise("worker").alias("role"), (key % 7 == 0).alias("is_orchestrator"),
        key.alias("registered"), (key % 11 != 0).alias("has_queue"),
    )


def part_map(planted: bool = False) -> Column:
    """A part as a map; planted: every third brand is null, every fifth part lacks its type, every fourth has a second name key."""
    key = F.col("p_partkey")
    names = F.array(F.lit("p_name"), F.lit("p_brand"), F.lit("p_type"))
    values = F.array("p_name", "p_brand", "p_type")
    if not planted:
        # P_NAME falls together with p_name once keys change case
        return last_wins(F.concat(names, F.array(F.lit("P_Name"))), F.concat(values, F.array(F.concat(F.lit("second "), key.cast("string")))))
    brand = F.when(key % 3 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    full = F.map_from_arrays(names, F.array(F.col("p_name"), brand, F.col("p_type")))
    return F.when(key % 5 == 0, F.map_filter(full, lambda k, _: k != "p_type")).otherwise(full)
