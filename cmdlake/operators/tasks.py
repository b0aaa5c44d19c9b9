"""What an agent does with a task: dispatch by type, internal operations, runtime configuration updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.payload import flatten_text, lowercase_keys, missing_fields, uppercase_keys
from ..schemas import AGENT_STATUSES, RUNTIME_FIELDS, UNAVAILABLE

HANDLED = ("mcp_command", "internal_process", "status_update", "configuration_update")


def dispatch_error(task_type: Column) -> Column:
    return F.when(~task_type.isin(*HANDLED), F.concat(F.lit("Unsupported task type: "), task_type))


def _struct(status: str, error: Column | None = None, result: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(F.lit(status).alias("status"), (none if error is None else error).alias("error"), (none if result is None else result).alias("result"))


def internal_operation(operation: Column, data: Column, required: Column, transform: Column, echo: Column, nested: Column | None = None) -> Column:
    """struct<status, error, result> of an internal task; data is a map, nested its JSON text of any depth, result is JSON text."""
    empty = data.isNull() | (F.size(data) == 0)
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    lacking = missing_fields(data, F.coalesce(required, F.array().cast("array<string>")))
    wrap = lambda name, c: F.to_json(F.struct(c.alias(name)), {"ignoreNullFields": "false"})
    flat = flatten_text(F.when(transform == "flatten", F.to_json(data, {"ignoreNullFields": "false"}) if nested is None else nested))
    made = F.when(transform == "uppercase_keys", uppercase_keys(data)).when(transform == "lowercase_keys", lowercase_keys(data)).otherwise(data)
    return (
        F.when(blank(operation), _struct("failed", F.lit("Missing 'operation' in internal task payload")))
        .when(operation == "echo", _struct("completed", None, wrap("echo", echo)))
        .when((operation == "validate_data") & empty, _struct("failed", F.lit("Missing 'data' for validation operation")))
        .when((operation == "validate_data") & (F.size(lacking) > 0), _struct("failed", F.lit("Validation failed"), wrap("validation_errors", lacking)))
        .when(operation == "validate_data", _struct("completed", None, wrap("validation", F.lit("success"))))
        .when((operation == "transform_data") & empty, _struct("failed", F.lit("Missing 'data' for transform operation")))
        .when((operation == "transform_data") & blank(transform), _struct("failed", F.lit("Missing 'transform_type' for transform operation")))
        .when((operation == "transform_data") & ~transform.isin("uppercase_keys", "lowercase_keys", "flatten"), _struct("failed", F.concat(F.lit("Unsupported transform type: "), transform)))
        .when((operation == "transform_data") & (transform == "flatten"), _struct("completed", None, F.concat(F.lit('{"transformed_data":'), F.coalesce(flat, F.lit("{}")), F.lit("}"))))
        .when(operation == "transform_data", _struct("completed", None, wrap("transformed_data", made)))
        .otherwise(_struct("failed", F.concat(F.lit("Unsupported internal operation: "), operation)))
    )


def status_update(status: Column) -> Column:
    """struct<status, error, result>: the update is checked and reported; the agent's own status is restored after it."""
    blank = F.coalesce(status, F.lit("")) == ""
    return (
        F.when(blank, _struct("failed", F.lit("Missing 'status' in payload")))
        .when(~status.isin(*AGENT_STATUSES), _struct("failed", F.concat(F.lit("Invalid status value: "), status)))
        .otherwise(_struct("completed", None, F.to_json(F.struct(status.alias("status")))))
    )


def tool_payload_error(command: Column, args_is_list: Column) -> Column:
    """The reason to refuse a tool task: no command, or arguments that are no list."""
    return F.when(F.coalesce(command, F.lit("")) == "", F.lit("Missing 'command' in MCP task payload")).when(~args_is_list, F.lit("'args' must be a list"))


def may_update(target: Column, field: Column) -> Column:
    rules = F.lit(False)
    for t, fields in RUNTIME_FIELDS.items():
        rules = rules | ((target == t) & field.isin(*fields))
    return rules


def apply_updates(updates: DataFrame) -> DataFrame:
    """One row per task of updates (task_id, target, field, value): lists of fields in order, status, message, and whether the tool client is rebuilt.

    Updates of a task are listed with the tool's first, each in key order.
    """
    rows = updates.withColumn("ok", may_update(F.col("target"), F.col("field")))
    entry = F.struct(F.when(F.col("target") == "mcp", 0).otherwise(1).alias("o"), "field", "target", "ok")
    lists = rows.groupBy("task_id").agg(F.array_sort(F.collect_list(entry)).alias("all"))
    name = lambda x: F.concat_ws(".", x["target"], x["field"])
    lists = lists.select(
        "task_id",
        F.transform(F.filter("all", lambda x: x["ok"]), name).alias("applied"),
        F.transform(F.filter("all", lambda x: ~x["ok"]), name).alias("rejected"),
    )
    some, none = F.size("rejected") > 0, F.size("applied") == 0
    message = F.when(some & none, "All configuration updates were rejected").when(some, "Some configuration updates were applied, others rejected").otherwise("All configuration updates were applied successfully")
    return lists.select("task_id", "applied", "rejected", F.when(some & none, "failed").otherwise("completed").alias("status"), message.alias("message"), F.array_contains("applied", "mcp.enabled").alias("rebuild"))


def update_outcomes(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with applied, rejected (lists of target.field in order), status, error, message and client, from the JSON text payload.

    client is what becomes of the tool client: rebuilt, dropped or kept. Without updates the task fails; updates that name
    no field of either target are neither applied nor rejected, and the task is completed. Row by row, nothing is shuffled.
    """
    updates = F.get_json_object(payload, "$.updates")
    named = [F.coalesce(F.from_json(F.get_json_object(payload, f"$.updates.{t}"), "map<string,string>"), F.create_map().cast("map<string,string>")) for t in RUNTIME_FIELDS]

    def entry(target: str, fields: tuple[str, ...]):
        return lambda k: F.struct(F.concat(F.lit(f"{target}."), k).alias("name"), k.isin(*fields).alias("ok"))

    entries = F.concat(*[F.transform(F.map_keys(m), entry(*rule)) for rule, m in zip(RUNTIME_FIELDS.items(), named, strict=True)])
    valid = F.coalesce(updates.rlike(r"^\{") & (F.size(F.json_object_keys(updates)) > 0), F.lit(False))
    names = lambda c: F.transform(c, lambda e: e["name"])
    out = rows.withColumn("_valid", valid).withColumn("_all", F.when(F.col("_valid"), entries))
    out = out.withColumn("applied", names(F.filter("_all", lambda e: e["ok"]))).withColumn("rejected", names(F.filter("_all", lambda e: ~e["ok"])))
    some, none = F.size("rejected") > 0, F.size("applied") == 0
    enabled = F.lower(named[0]["enabled"])
    client = F.when(F.col("_valid") & F.array_contains("applied", "mcp.enabled"), F.when(enabled == "true", "rebuilt").otherwise("dropped")).otherwise("kept")
    error = F.when(~F.col("_valid"), "Missing or invalid 'updates' in configuration update payload").when(some & none, "All configuration updates were rejected")
    message = F.when(some & none | ~F.col("_valid"), None).when(some, "Some configuration updates were applied, others rejected").otherwise("All configuration updates were applied successfully")
    return out.withColumns({"error": error, "message": message, "client": client}).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("failed")).drop("_valid", "_all")


def config_state(updates: DataFrame) -> DataFrame:
    """(agent_id, target, field, value) after a log of updates (seq, agent_id, target, field, value): the last value of each allowed field."""
    allowed = updates.where(may_update(F.col("target"), F.col("field")))
    return allowed.groupBy("agent_id", "target", "field").agg(F.max_by("value", "seq").alias("value"))


def status_trail(before: Column, task_type: Column, has_client: Column) -> Column:
    """array<string>: the agent's statuses through a task, from the one before it to the one restored after it; of one that refuses, its own.

    A tool task makes a busy agent idle when it ends; what stood before the task is restored all the same.
    """
    busy = F.array(F.lit("mcp_tool_busy"), F.lit("idle"))
    during = F.when((task_type == "mcp_command") & has_client, busy).otherwise(F.array().cast("array<string>"))
    return F.when(before.isin(*UNAVAILABLE), F.array(before)).otherwise(F.concat(F.array(before, F.lit("processing_task")), during, F.array(before)))


def timed(rows: DataFrame, started: Column, seconds: Column) -> DataFrame:
    """rows with started_at and completed_at as ISO text in UTC."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return rows.withColumns({"started_at": F.date_format(started, iso), "completed_at": F.date_format(started + F.make_dt_interval(secs=seconds), iso)})
