"""Queries of the command plane: the log folded into outcomes, agents and tasks, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import rules
from ..operators import registry, retry
from ..sources.fixtures import commands, props_k, table


def _log(spark: SparkSession, d: str) -> DataFrame:
    return commands(table(spark, d, "events"))


def command_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return registry.outcomes(_log(spark, d)).groupBy("command_type", "status").agg(F.count("*").alias("n"))


def command_responses(spark: SparkSession, d: str) -> DataFrame:
    return registry.responses(_log(spark, d))


def list_agents(spark: SparkSession, d: str) -> DataFrame:
    return registry.agents(_log(spark, d))


def system_status(spark: SparkSession, d: str) -> DataFrame:
    return registry.system_status(_log(spark, d))


def task_status_after_cancel(spark: SparkSession, d: str) -> DataFrame:
    return registry.tasks(_log(spark, d))


def agent_status_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every user's agent status, or the error of a lookup that finds none."""
    users = table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()
    found = users.join(registry.agents(_log(spark, d)).select("id", "status"), "id", "left")
    error = F.when(F.col("status").isNull(), F.concat(F.lit("Agent not found: "), F.col("id").cast("string")))
    return found.select("id", "status", error.alias("error"))


def streaming_agents(spark: SparkSession, d: str) -> DataFrame:
    """The same agents, folded by Structured Streaming from the folder of events."""
    import uuid

    from ..streaming import registry as stream

    name = f"agents_{uuid.uuid4().hex}"
    return stream.run_once(spark, d, name, f"{stream.shared_folder(spark)}/{name}")


def worker_fold(spark: SparkSession, d: str) -> DataFrame:
    """Users as workers: a signup registers them idle, an error unregisters, anything else registers them busy."""
    e = table(spark, d, "events")
    kind = F.col("event_type")
    log = e.select(
        F.col("event_id").alias("seq"), F.col("user_id").alias("worker_id"), F.when(kind == "error", "unregister").otherwise("register").alias("op"),
        F.when(kind == "signup", "idle").otherwise("processing_task").alias("status"), F.lit("worker").alias("role"),
    )
    return registry.worker_table(log)


def echo_payload(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.col("props").alias("echo"))


def parse_or_text(spark: SparkSession, d: str) -> DataFrame:
    """Every third output is plain text with white space around it, the others JSON."""
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("  "), F.col("event_type"), F.lit(" "))).otherwise(F.col("props"))
    e = table(spark, d, "events").select("event_id", P.json_or_stdout(raw).alias("o"))
    return e.select("event_id", F.get_json_object("o", "$.k").alias("k"), F.get_json_object("o", "$.stdout").alias("stdout"))


def error_text(spark: SparkSession, d: str) -> DataFrame:
    """The detail of an error body, with a fallback."""
    body = F.when(F.col("event_type") == "error", F.concat(F.lit('{"detail": "code '), F.col("user_id").cast("string"), F.lit('"}'))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.coalesce(F.get_json_object(body, "$.detail"), F.lit("Unknown error")).alias("error"))


def structured_log(spark: SparkSession, d: str) -> DataFrame:
    """A JSON line per event: timestamp, level, logger, message."""
    level = F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO")
    line = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), level.alias("level"), F.lit("cmdlake").alias("logger"), F.concat(F.col("event_type"), F.lit(" by "), F.col("user_id").cast("string")).alias("message"))
    return table(spark, d, "events").select("event_id", F.to_json(line).alias("line"))


_CODE = "case event_type when 'error' then 503 when 'purchase' then 429 when 'signup' then 400 else 200 end"


def retry_outcome(spark: SparkSession, d: str) -> DataFrame:
    """A user's events of one type are the attempts of a request: it ends at the first that isn't retryable, or after three retries."""
    e = table(spark, d, "events")
    attempts = e.select((F.floor(F.col("event_id") / 5)).cast("long").alias("request_id"), (F.col("event_id") % 5).cast("int").alias("attempt"), F.expr(_CODE).alias("code"))
    return retry.finished(attempts, 3, 0.5)


def backoff_schedule(spark: SparkSession, d: str) -> DataFrame:
    """The wait after each of four attempts; a server's whole number of seconds overrides it."""
    e = table(spark, d, "events").where("event_type = 'error'")
    after = F.when(props_k() % 4 == 0, props_k().cast("string")).when(props_k() % 4 == 1, F.lit("soon"))
    rows = e.select("event_id", after.alias("after"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("attempt"))
    return rows.select("event_id", "attempt", retry.wait(1.0, F.col("attempt"), F.col("after")).alias("delay"), (F.col("attempt") < 3).alias("again"))


def validate_requests(spark: SparkSession, d: str) -> DataFrame:
    """Targets are null for every fourth command and absent for every seventh."""
    c = _log(spark, d).withColumn("kind", F.when(F.col("command_id") % 6 == 0, "list_agents").otherwise(F.col("command_type")))
    target = F.when(F.col("command_id") % 4 != 0, F.col("target_id").cast("string"))
    found = rules.errors(*rules.request_rules(F.col("kind"), target, F.col("command_id") % 7 != 0))
    return c.select("command_id", F.try_element_at(found, F.lit(1)).alias("error"))


def _errors_of(spark: SparkSession, d: str, ok: str, bad: str, make) -> DataFrame:
    e = table(spark, d, "events")
    k = F.col("event_id")
    status = F.when(k % 3 == 0, bad).when(k % 3 == 1, ok).otherwise("pending")
    error = F.when(k % 2 == 0, F.lit("broken"))
    return e.select("event_id", F.try_element_at(rules.errors(*make(status, error, k % 5 != 0)), F.lit(1)).alias("error"))


def validate_responses(spark: SparkSession, d: str) -> DataFrame:
    return _errors_of(spark, d, "success", "failure", rules.response_rules)


def validate_task_responses(spark: SparkSession, d: str) -> DataFrame:
    return _errors_of(spark, d, "completed", "failed", rules.task_response_rules)


_ACTIONS = [a for c in (("browser", "open"), ("browser", "search"), ("browser", "screenshot"), ("clipboard", "write"), ("system", "notification"), ("system", "speak"), ("file", "read"), ("file", "write"), ("file", "copy"), ("file", "list")) for a in (c,)]


def validate_desktop_command(spark: SparkSession, d: str) -> DataFrame:
    """Ten commands by event_id; the supplied fields and their values go by its remainders."""
    k = F.col("event_id")
    at = (k % len(_ACTIONS)).cast("int") + 1
    command, action = (F.element_at(F.array(*[F.lit(x[i]) for x in _ACTIONS]), at) for i in (0, 1))
    value = F.when(k % 3 == 0, F.lit("x")).when(k % 3 == 1, F.lit(""))
    fields = ("url", "query", "path", "text", "title", "content", "source")
    given = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[value] * len(fields))), lambda f, _: (k % 4 != 0) | (f == "path"))
    kind = F.when(k % 17 == 0, F.lit("file")).otherwise(command)
    e = table(spark, d, "events").select("event_id", F.explode(F.array_distinct(rules.errors(*rules.desktop_rules(command, action, kind, given)))).alias("error"))
    return e


QUERIES = {f.__name__: f for f in (
    command_outcomes, command_responses, list_agents, system_status, task_status_after_cancel, agent_status_lookup, streaming_agents,
    worker_fold, echo_payload, parse_or_text, error_text, structured_log, retry_outcome, backoff_schedule,
    validate_requests, validate_responses, validate_task_responses, validate_desktop_command,
)}

FOLD = """
with c as (select event_id as command_id, ts, user_id as target_id,
    case event_type when 'signup' then 'create_agent' when 'click' then 'execute_task' when 'view' then 'get_agent_status'
      when 'purchase' then 'cancel_task' else 'delete_agent' end as command_type,
    (props->>'$.k')::bigint as k, props from events),
s as (select *, max(case when command_type = 'create_agent' then command_id end) over w as made,
    max(case when command_type = 'delete_agent' then command_id end) over w as gone
  from c window w as (partition by target_id order by ts, command_id rows between unbounded preceding and 1 preceding)),
x as (select command_id from s where command_type = 'execute_task' and coalesce(made, -1) > coalesce(gone, -1)),
o as (select s.*, case when command_type = 'cancel_task' then command_id - k - 1 end as task_ref,
    case when command_type = 'create_agent' then true when command_type = 'cancel_task' then command_id - k - 1 in (select command_id from x)
      else coalesce(made, -1) > coalesce(gone, -1) end as ok from s),
a as (select target_id as id, arg_max(k, command_id) filter (command_type = 'create_agent') as k, arg_max(props, command_id) filter (command_type = 'create_agent') as config,
    max(command_id) filter (command_type = 'create_agent') as made, max(command_id) filter (command_type = 'delete_agent') as gone
  from c group by target_id having coalesce(made, -1) > coalesce(gone, -1)),
t as (select command_id as task_id, target_id as agent_id,
    case when command_id in (select task_ref from o where command_type = 'cancel_task' and ok) then 'canceled' else 'pending' end as status
  from o where command_type = 'execute_task' and ok)
"""

ORACLES = {
    "command_outcomes": FOLD + "select command_type, case when ok then 'success' else 'failure' end as status, count(*) as n from o group by 1, 2",
    "command_responses": FOLD + """select command_id, case when ok then 'success' else 'failure' end as status,
      case when ok then case command_type when 'create_agent' then 'Agent created with ID ' || target_id when 'execute_task' then 'Task created on agent ' || target_id
        when 'cancel_task' then 'Task ' || task_ref || ' canceled' when 'delete_agent' then 'Agent ' || target_id || ' deleted' end end as message,
      case when not ok then case command_type when 'cancel_task' then 'Task not found: ' || task_ref else 'Agent not found: ' || target_id end end as error from o""",
    "list_agents": FOLD + "select id, 'type' || (k % 3) as type, 'running' as status, config from a",
    "system_status": FOLD + "select (select count(*) from a) as agents, (select count(*) from t) as tasks, 'running' as status",
    "task_status_after_cancel": FOLD + "select * from t",
    "agent_status_lookup": FOLD + """select u.id, case when a.id is not null then 'running' end as status, case when a.id is null then 'Agent not found: ' || u.id end as error
      from (select distinct user_id as id from events) u left join a using (id)""",
    "streaming_agents": FOLD + "select id, 'running' as status from a",
    "worker_fold": """select user_id as worker_id, case when arg_max(event_type, event_id) = 'signup' then 'idle' else 'processing_task' end as status, 'worker' as role
      from events group by 1 having arg_max(event_type, event_id) <> 'error'""",
    "echo_payload": "select event_id, props as echo from events",
    "parse_or_text": "select event_id, case when event_id % 3 <> 0 then props->>'$.k' end as k, case when event_id % 3 = 0 then event_type end as stdout from events",
    "error_text": "select event_id, case when event_type = 'error' then 'code ' || user_id else 'Unknown error' end as error from events",
    "structured_log": """select event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || case when event_type = 'error' then 'ERROR' else 'INFO' end
      || '","logger":"cmdlake","message":"' || event_type || ' by ' || user_id || '"}' as line from events""",
    "retry_outcome": f"""with a as (select event_id // 5 as request_id, (event_id % 5)::int as attempt, {_CODE} as code from events),
      e as (select request_id, min(attempt) as n, arg_min(code, attempt) as code from a where attempt <= 3 and (code not in (429, 502, 503, 504) or attempt >= 3) group by 1),
      r as (select distinct request_id from a where attempt <= 3)
      select request_id, n as attempts_before, code, code < 400 as ok, 0.5::double * (pow(2, n) - 1) as waited from r left join e using (request_id)""",
    "backoff_schedule": """select event_id, attempt::int as attempt, case when k % 4 = 0 then k::double else pow(2, attempt)::double end as delay, attempt < 3 as again
      from (select event_id, (props->>'$.k')::bigint as k, unnest(range(4)) as attempt from events where event_type = 'error')""",
    "validate_requests": """with c as (select event_id as command_id, case when event_id % 6 = 0 then 'list_agents' else case event_type when 'signup' then 'create_agent'
        when 'click' then 'execute_task' when 'view' then 'get_agent_status' when 'purchase' then 'cancel_task' else 'delete_agent' end end as kind from events)
      select command_id, case when command_id % 7 <> 0 and command_id % 4 = 0 and kind not in ('list_agents', 'create_agent')
        then 'target_id is required for command type: ' || kind end as error from c""",
    "validate_responses": """select event_id, case when event_id % 5 = 0 then null when event_id % 3 = 0 and event_id % 2 <> 0 then 'Error message is required when status is ''failure'''
      when event_id % 3 = 1 and event_id % 2 = 0 then 'Error message should not be set when status is ''success''' end as error from events""",
    "validate_task_responses": """select event_id, case when event_id % 5 = 0 then null when event_id % 3 = 0 and event_id % 2 <> 0 then 'Error message is required when status is ''failed'''
      when event_id % 3 = 1 and event_id % 2 = 0 then 'Error message should not be set when status is ''completed''' end as error from events""",
    "validate_desktop_command": """with a(i, command, action) as (values (0, 'browser', 'open'), (1, 'browser', 'search'), (2, 'browser', 'screenshot'), (3, 'clipboard', 'write'),
        (4, 'system', 'notification'), (5, 'system', 'speak'), (6, 'file', 'read'), (7, 'file', 'write'), (8, 'file', 'copy'), (9, 'file', 'list')),
      f(command, action, field, lookup) as (values ('browser', 'open', 'url', false), ('browser', 'search', 'query', false), ('browser', 'screenshot', 'path', false),
        ('clipboard', 'write', 'text', false), ('system', 'notification', 'title', true), ('system', 'speak', 'text', false), ('file', 'read', 'path', false),
        ('file', 'write', 'path', false), ('file', 'write', 'content', false), ('file', 'copy', 'source', true))
      select event_id, case when lookup then 'KeyError: ' || field else field || ' is required for ''' || action || ''' action' end as error
      from events join a on event_id % 10 = i join f using (command, action)
      where (event_id % 4 <> 0 or field = 'path') and (lookup or event_id % 3 <> 0)
      union all
      select event_id, 'parameters don''t match command ' || command from events join a on event_id % 10 = i where event_id % 17 = 0 and command <> 'file'""",
}
