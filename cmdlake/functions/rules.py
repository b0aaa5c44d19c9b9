"""Validation rules: conditions with messages, gathered into one array of errors per row.

A field may be absent, null or set. ``present`` columns tell the first two apart: a rule on a field that is
absent does not run, unless it says so.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import LOG_LEVELS

Rule = tuple[Column, Column | str]


def errors(*rules: Rule) -> Column:
    """array<string> of the messages whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, m if isinstance(m, Column) else F.lit(m)) for c, m in rules]))


def falsy(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def request_rules(command_type: Column, target: Column, present: Column) -> tuple[Rule, ...]:
    free = ("get_system_status", "list_agents", "create_agent")
    return ((present & target.isNull() & ~command_type.isin(*free), F.concat(F.lit("target_id is required for command type: "), command_type)),)


def response_rules(status: Column, error: Column, present: Column) -> tuple[Rule, ...]:
    return (
        (present & (status == "failure") & error.isNull(), "Error message is required when status is 'failure'"),
        (present & (status == "success") & error.isNotNull(), "Error message should not be set when status is 'success'"),
    )


def task_response_rules(status: Column, error: Column, present: Column) -> tuple[Rule, ...]:
    return (
        (present & (status == "failed") & error.isNull(), "Error message is required when status is 'failed'"),
        (present & (status == "completed") & error.isNotNull(), "Error message should not be set when status is 'completed'"),
    )


def timeout_rules(seconds: Column) -> tuple[Rule, ...]:
    return ((seconds < 1, "timeout_seconds must be at least 1"), (seconds > 300, "timeout_seconds must be at most 300"))


def log_level_rules(level: Column) -> tuple[Rule, ...]:
    return ((~F.upper(level).isin(*LOG_LEVELS), F.concat(F.lit("Invalid log level: "), level)),)


def role_of(role: Column, is_orchestrator: Column) -> Column:
    """struct<is_orchestrator, error>: the role sets the flag; the flag needs the role."""
    error = F.when(is_orchestrator & (role != "orchestrator"), F.lit("is_orchestrator requires role 'orchestrator'"))
    return F.struct((is_orchestrator | (role == "orchestrator")).alias("is_orchestrator"), error.alias("error"))


#: (command, action, field, does an empty value that is supplied fail with a lookup error instead of a message)
DESKTOP_FIELDS = (
    ("browser", ("open",), "url", False),
    ("browser", ("search",), "query", False),
    ("browser", ("screenshot",), "path", False),
    ("clipboard", ("write",), "text", False),
    ("system", ("notification",), "title", True),
    ("system", ("notification",), "message", True),
    ("system", ("speak",), "text", False),
    ("file", ("read", "write", "delete"), "path", False),
    ("file", ("write",), "content", False),
    ("file", ("copy", "move"), "source", True),
    ("file", ("copy", "move"), "destination", True),
)


def desktop_rules(command: Column, action: Column, kind: Column, params: Column) -> tuple[Rule, ...]:
    """Rules over params, a map of the fields that were supplied; kind names the parameters' own type."""
    rules: list[Rule] = [(kind != command, F.concat(F.lit("parameters don't match command "), command))]
    for name, actions, field, lookup in DESKTOP_FIELDS:
        supplied = (command == name) & action.isin(*actions) & F.map_contains_key(params, F.lit(field))
        value = F.try_element_at(params, F.lit(field))
        if lookup:
            rules.append((supplied, F.lit(f"KeyError: {field}")))
        else:
            rules.append((supplied & falsy(value), F.concat(F.lit(f"{field} is required for '"), action, F.lit("' action"))))
    return tuple(rules)


def payload_rules(command_type: Column, payload: Column) -> tuple[Rule, ...]:
    """What the payload, JSON text, of a task or a new agent must name; a key may stand there with null."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    need = (("execute_task", "task_type"), ("create_agent", "agent_type"))
    return tuple(((command_type == kind) & ~F.array_contains(keys, field), f"payload must contain '{field}'") for kind, field in need)


def body_agent_type(body: Column) -> Column:
    """The type of a new agent: agent_type of the body, JSON text, else its type, else a default."""
    return F.coalesce(F.get_json_object(body, "$.agent_type"), F.get_json_object(body, "$.type"), F.lit("default"))
