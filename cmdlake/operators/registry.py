"""The command plane: a log of commands folded into agents and tasks.

The state that a command sees is what the commands before it left, in (ts, command_id) order. An agent exists
if its last creation comes after its last deletion; both are running maxima over the target's log, so the fold
needs no loop. The log of a target is cut into slices of time, each a window of its own that starts with what the slices
before it left, so a hot target is the work of many tasks. Tasks are keyed by the command that made them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _last(kind: str) -> Column:
    return F.max(F.when(F.col("command_type") == kind, F.struct("ts", "command_id")))


def _alive(made: Column, gone: Column) -> Column:
    return made.isNotNull() & (gone.isNull() | (made > gone))


def as_of(commands: DataFrame, unit: str = "hour") -> DataFrame:
    """commands with agent_exists: whether the target exists just before each. unit is the length of a slice of a target's log."""
    at = F.struct("ts", "command_id")
    made, gone = (F.when(F.col("command_type") == kind, at) for kind in ("create_agent", "delete_agent"))
    rows = commands.withColumns({"_slice": F.date_trunc(unit, "ts"), "_made": made, "_gone": gone})
    earlier = W.partitionBy("target_id").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    left = rows.groupBy("target_id", "_slice").agg(F.max("_made").alias("_made"), F.max("_gone").alias("_gone"))
    left = left.withColumns({c: F.max(c).over(earlier) for c in ("_made", "_gone")}).withColumn("_inherited", F.lit(True))
    # what a slice inherits is a row before its own: no join, and null targets and times are values like others
    rows = rows.withColumn("_inherited", F.lit(False)).unionByName(left, allowMissingColumns=True)
    before = W.partitionBy("target_id", "_slice").orderBy(F.desc("_inherited"), "ts", "command_id").rowsBetween(W.unboundedPreceding, -1)
    seen = rows.withColumn("agent_exists", _alive(F.max("_made").over(before), F.max("_gone").over(before)))
    return seen.where("not _inherited").select(*commands.columns, "agent_exists")


def outcomes(commands: DataFrame) -> DataFrame:
    """commands with status and error. cancel_task and get_task_status name their task in task_ref."""
    seen = as_of(commands)
    made = seen.where((F.col("command_type") == "execute_task") & F.col("agent_exists")).select(F.col("command_id").alias("task_ref"), F.col("ts").alias("made_ts"))
    seen = seen.join(made, "task_ref", "left")
    task_exists = F.col("made_ts").isNotNull() & (F.struct("made_ts", "task_ref") < F.struct(F.col("ts").alias("made_ts"), F.col("command_id").alias("task_ref")))
    kind = F.col("command_type")
    on_agent, on_task = kind.isin("execute_task", "delete_agent", "get_agent_status"), kind.isin("cancel_task", "get_task_status")
    free = kind.isin("create_agent", "list_agents", "get_system_status", "update_configuration")
    error = (
        F.when(on_agent & ~F.col("agent_exists"), F.concat(F.lit("Agent not found: "), F.coalesce(F.col("target_id").cast("string"), F.lit("None"))))
        .when(on_task & ~task_exists, F.concat(F.lit("Task not found: "), F.coalesce(F.col("task_ref").cast("string"), F.lit("None"))))
        .when(~(on_agent | on_task | free), F.concat(F.lit("Unknown command type: "), kind))
    )
    seen = seen.withColumn("error", error)
    return seen.withColumn("status", F.when(F.col("error").isNull(), "success").otherwise("failure")).drop("made_ts")


def responses(commands: DataFrame) -> DataFrame:
    """(command_id, status, message, error) of each command."""
    t, kind = F.col("target_id").cast("string"), F.col("command_type")
    message = (
        F.when(kind == "create_agent", F.concat(F.lit("Agent created with ID "), t))
        .when(kind == "execute_task", F.concat(F.lit("Task created on agent "), t))
        .when(kind == "cancel_task", F.concat(F.lit("Task "), F.col("task_ref").cast("string"), F.lit(" canceled")))
        .when(kind == "delete_agent", F.concat(F.lit("Agent "), t, F.lit(" deleted")))
        .when(kind == "update_configuration", F.lit("Configuration updated"))
    )
    return outcomes(commands).select("command_id", "status", F.when(F.col("status") == "success", message).alias("message"), "error")


def agents(commands: DataFrame) -> DataFrame:
    """The agents that exist at the end of the log: (id, type, status, config); config is what they were made with."""
    made = F.max(F.when(F.col("command_type") == "create_agent", F.struct("ts", "command_id", "agent_type", "payload"))).alias("made")
    last = commands.groupBy("target_id").agg(made, _last("delete_agent").alias("gone"))
    alive = _alive(F.struct("made.ts", "made.command_id"), F.col("gone"))
    return last.where(F.col("made").isNotNull() & alive).select(F.col("target_id").alias("id"), F.col("made.agent_type").alias("type"), F.lit("running").alias("status"), F.col("made.payload").alias("config"))


def tasks(commands: DataFrame) -> DataFrame:
    """The tasks at the end of the log: (task_id, agent_id, status). Deleting an agent leaves its tasks."""
    done = outcomes(commands)
    made = done.where("command_type = 'execute_task' and status = 'success'").select(F.col("command_id").alias("task_id"), F.col("target_id").alias("agent_id"))
    canceled = done.where("command_type = 'cancel_task' and status = 'success'").select(F.col("task_ref").alias("task_id")).distinct().withColumn("canceled", F.lit(True))
    return made.join(canceled, "task_id", "left").select("task_id", "agent_id", F.when(F.col("canceled"), "canceled").otherwise("pending").alias("status"))


def task_lookups(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked (task_id, ...) with status and error: the state of each task asked for."""
    rows = asked.join(known.select("task_id", "status"), "task_id", "left")
    return rows.withColumn("error", F.when(F.col("status").isNull(), F.concat(F.lit("Task not found: "), F.coalesce(F.col("task_id").cast("string"), F.lit("None")))))


def api_responses(commands: DataFrame) -> DataFrame:
    """(command_id, status, result, error, task_id, agent_id): result is JSON text, from which the ids are lifted; a status record nests twice."""
    t, kind, text = F.col("target_id").cast("string"), F.col("command_type"), F.col("message")
    rows = responses(commands).join(commands.select("command_id", "command_type", "target_id", "task_ref"), "command_id")
    body = (
        F.when(kind == "create_agent", F.to_json(F.struct(text.alias("message"), t.alias("agent_id"))))
        .when(kind == "execute_task", F.to_json(F.struct(text.alias("message"), F.col("command_id").cast("string").alias("task_id"))))
        .when(kind == "get_agent_status", F.to_json(F.struct(t.alias("agent_id"), F.struct(F.lit("running").alias("status")).alias("status"))))
        .otherwise(F.to_json(F.struct(text.alias("message"))))
    )
    rows = rows.withColumn("result", F.when(F.col("status") == "success", body))
    lifted = {c: F.get_json_object("result", f"$.{c}") for c in ("task_id", "agent_id")}
    return rows.withColumns(lifted).select("command_id", "status", "result", "error", "task_id", "agent_id")


def listing(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """A row for each caller of allowed (caller, error): the agents found, or an empty list beside the error."""
    every = found.agg(F.array_sort(F.collect_list(F.struct("id", "type", "status"))).alias("all"))  # the answer is one record by its nature
    rows = allowed.crossJoin(F.broadcast(every))
    empty = F.array().cast("array<struct<id:bigint,type:string,status:string>>")
    return rows.select("caller", F.coalesce(F.when(F.col("error").isNull(), F.col("all")), empty).alias("agents"), "error")


def system_status(commands: DataFrame) -> DataFrame:
    """One row: number of agents, number of tasks, and that the system runs."""
    made = as_of(commands).where((F.col("command_type") == "execute_task") & F.col("agent_exists"))  # canceled ones count too
    a, t = agents(commands).agg(F.count("*").alias("agents")), made.agg(F.count("*").alias("tasks"))
    return a.crossJoin(t).withColumn("status", F.lit("running"))  # two frames of one row each


def worker_table(log: DataFrame) -> DataFrame:
    """Workers after a log of (seq, worker_id, op, status, role): register is an upsert, unregister of none is silent."""
    last = log.groupBy("worker_id").agg(F.max_by(F.struct("op", "status", "role"), "seq").alias("r"))
    return last.where("r.op = 'register'").select("worker_id", "r.status", "r.role")
