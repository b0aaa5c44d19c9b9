"""Queries of the service around the planes: responses, listings, rules on payloads, state of agents, waiting, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import rules
from ..operators import registry, retry, routing, tasks
from ..schemas import TASK_TYPES
from ..sources.fixtures import commands, props_k, table, workers
from .command_plane import FOLD


def _log(spark: SparkSession, d: str) -> DataFrame:
    return commands(table(spark, d, "events"))


def task_lookups(spark: SparkSession, d: str) -> DataFrame:
    """Every cancel's task looked up once more at the end of the log."""
    log = _log(spark, d)
    asked = log.where("command_type = 'cancel_task'").select(F.col("command_id").alias("request_id"), F.col("task_ref").alias("task_id"))
    return registry.task_lookups(asked, registry.tasks(log)).select("request_id", "task_id", "status", "error")


def api_responses(spark: SparkSession, d: str) -> DataFrame:
    return registry.api_responses(_log(spark, d))


def list_response(spark: SparkSession, d: str) -> DataFrame:
    """Nations call with their region's name as key; only one key is right."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    key = r.select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("key"))
    callers = n.join(key, "n_regionkey").select(F.col("n_nationkey").alias("caller"), F.when(F.col("key") != "EUROPE", "Invalid API key").alias("error"))
    found = registry.listing(registry.agents(_log(spark, d)), callers)
    return found.select("caller", F.size("agents").cast("long").alias("n_agents"), F.coalesce(F.try_element_at("agents", F.lit(1))["id"], F.lit(-1)).alias("first_id"), "error")


def validate_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Payloads by the event's value: of another kind, with the needed key and null, and whole."""
    v, kind = F.col("value"), F.col("command_type")
    field = F.when(kind == "create_agent", "agent_type").otherwise("task_type")
    text = F.when(v < 30, F.lit('{"k":1}')).when(v < 60, F.concat(F.lit('{"'), field, F.lit('":null}'))).when(v < 80, F.lit("[]")).otherwise(F.concat(F.lit('{"'), field, F.lit('":"x"}')))
    rows = _log(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("command_id"), "value"), "command_id")
    return rows.select("command_id", F.try_element_at(rules.errors(*rules.payload_rules(kind, text)), F.lit(1)).alias("error"))


def agent_bodies(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).alias("agent_type"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("type")))
    return table(spark, d, "customer").select("c_custkey", rules.body_agent_type(body).alias("agent_type"))


UPDATES = (
    (10, "{}"), (20, '{"updates":{}}'), (25, '{"updates":{"other":{"a":1}}}'), (35, '{"updates":{"mcp":{"enabled":true,"api_key":"x"},"agent":{"name":"n"}}}'),
    (45, '{"updates":{"agent":{"agent_id":"z"}}}'), (49, '{"updates":{"mcp":{"enabled":false,"retry_count":2}}}'), (99, '{"updates":[1]}'),
)


def config_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Update payloads by the part's size: none, empty, of another target, mixed, refused, applied, and no object."""
    text = F.lit(None).cast("string")
    for below, t in reversed(UPDATES):
        text = F.when(F.col("p_size") < below, F.lit(t)).otherwise(text)
    rows = tasks.update_outcomes(table(spark, d, "part").select("p_partkey", text.alias("payload")))
    return rows.select("p_partkey", F.concat_ws(",", "applied").alias("applied"), F.concat_ws(",", "rejected").alias("rejected"), "status", "error", "message", "client")


def config_state(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a log of updates to the agent of their size; a field is named by the last digit of the brand."""
    digit = F.coalesce(F.right("p_brand", F.lit(1)).try_cast("int"), F.lit(0)) % 5
    field = F.element_at(F.array(*map(F.lit, ("enabled", "name", "timeout_seconds", "agent_id", "description"))), digit + 1)
    target = F.when(F.col("p_retailprice") > 1000, "mcp").otherwise("agent")
    log = table(spark, d, "part").select(F.col("p_partkey").alias("seq"), F.col("p_size").alias("agent_id"), target.alias("target"), field.alias("field"), F.col("p_name").alias("value"))
    return tasks.config_state(log)


def _workers(spark: SparkSession, d: str) -> DataFrame:
    return workers(table(spark, d, "supplier"))


def _task_type() -> "F.Column":
    return F.element_at(F.array(*map(F.lit, TASK_TYPES)), F.left("o_orderpriority", F.lit(1)).cast("int"))


def status_trails(spark: SparkSession, d: str) -> DataFrame:
    """The statuses that an order's worker goes through; the kind of task is its priority's."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 10 + 1).alias("worker_id"), _task_type().alias("task_type"))
    trail = tasks.status_trail(F.col("status"), F.col("task_type"), F.col("has_queue"))
    return o.join(_workers(spark, d), "worker_id").select("task_id", F.posexplode(trail).alias("step", "status"))


def task_handlers(spark: SparkSession, d: str) -> DataFrame:
    """Orchestrator 7 gets all orders; open ones name the customer's number as target."""
    known = _workers(spark, d).where("not is_orchestrator").select(F.col("worker_id").alias("target"), F.lit(True).alias("registered"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "O", F.col("o_custkey")).alias("target"))
    me = F.lit(7).cast("long")
    return o.join(known, "target", "left").select("task_id", routing.handled_by(me, F.col("target"), F.col("registered")).alias("handler"))


def await_responses(spark: SparkSession, d: str) -> DataFrame:
    """A day counts as a second: an order's first shipment is its response; urgent orders wait 30, high ones name no time."""
    o = table(spark, d, "orders")
    digit = F.left("o_orderpriority", F.lit(1))
    asked = o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("worker_id"), F.when(digit == "1", 30).when(digit == "2", 0).alias("timeout_seconds"), (F.col("o_orderstatus") == "P").alias("is_async"))
    first = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("at"), F.min("l_returnflag").alias("flag"))
    came = first.join(o.select("o_orderkey", "o_orderdate"), "o_orderkey")
    came = came.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("flag") == "N", "completed").otherwise("failed").alias("status"), F.datediff("at", "o_orderdate").alias("after"))
    return routing.awaited(asked, came).select("task_id", "status", "error", "waited")


def roster_start(spark: SparkSession, d: str) -> DataFrame:
    """The roster names a role for nations with a vowel in front and a description for the first regions."""
    n = table(spark, d, "nation")
    own = n.select(F.col("n_name").alias("agent_id"), F.lit("worker").alias("role"), F.lower("n_name").alias("name"), F.lit("from its document").alias("description"))
    listed = n.select(F.col("n_name").alias("agent_id"), F.when(F.left("n_name", F.lit(1)).isin(*"AEIOU"), "orchestrator").alias("role"), F.lit(None).cast("string").alias("name"), F.when(F.col("n_regionkey") < 2, "from the roster").alias("description"))
    return routing.started(listed, own)


def supervisor_counts(spark: SparkSession, d: str) -> DataFrame:
    return routing.counts(_workers(spark, d))


def roster_sizes(spark: SparkSession, d: str) -> DataFrame:
    """A roster document per region, as JSON, and the number of its agents."""
    rosters = table(spark, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("n_name").alias("agent_id"))).alias("agents"))).alias("body"))
    return rosters.select("n_regionkey", F.size(F.from_json("body", "agents array<struct<agent_id string>>")["agents"]).cast("long").alias("n_agents"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """A suite per order, its lines the steps: passed where all are."""
    passed = F.bool_and(F.col("l_returnflag") != "R")
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(passed.alias("passed"), F.count("*").alias("steps"))


def tool_outcome(spark: SparkSession, d: str) -> DataFrame:
    """Four events make a tool call's attempts; errors and purchases fail."""
    e = table(spark, d, "events")
    code = F.when(F.col("event_type").isin("error", "purchase"), 1).otherwise(0)
    rows = e.select(F.floor(F.col("event_id") / 4).cast("long").alias("call_id"), (F.col("event_id") % 4).cast("int").alias("attempt"), code.alias("exit_code"), F.concat(F.lit("  "), F.col("event_type"), F.lit(" ")).alias("output"))
    return retry.tool_outcome(rows, 2, 2.0)


def task_times(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), "o_orderdate", (F.floor("o_totalprice") % 3600).cast("decimal(18,6)").alias("seconds"))
    return tasks.timed(o, F.col("o_orderdate"), F.col("seconds")).select("task_id", "started_at", "completed_at")


def process_env(spark: SparkSession, d: str) -> DataFrame:
    """A tool's environment: the process's, over it the configured variables, and the key where there is one."""
    n = F.col("n_name")
    base = F.create_map(F.lit("HOME"), F.lit("/root"), F.lit("LANG"), F.lit("C"))
    configured = F.create_map(F.lit("LANG"), n, F.lit("REGION"), F.col("n_regionkey").cast("string"))
    key = F.when(F.col("n_regionkey") > 1, F.create_map(F.lit("MCP_API_KEY"), F.lower(n)))
    return table(spark, d, "nation").select("n_nationkey", F.explode(P.overlay(base, configured, key)).alias("key", "value"))


def redact(spark: SparkSession, d: str) -> DataFrame:
    """Customers' configuration for a log: the key is covered, all else stays."""
    found = F.create_map(F.lit("name"), F.col("c_name"), F.lit("api_key"), F.col("c_mktsegment"))
    return table(spark, d, "customer").select("c_custkey", F.explode(P.redact(found)).alias("key", "value"))


def flatten_operation(spark: SparkSession, d: str) -> DataFrame:
    """The flatten transform of an internal task, over an order's customer and nation."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    nation = F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region"))
    data = F.to_json(F.struct(F.col("c_name").alias("name"), nation.alias("nation"), F.array("c_custkey").alias("ids")))
    op, kind = F.lit("transform_data"), F.when(F.col("c_custkey") % 2 == 0, "flatten").otherwise("fold")
    r = tasks.internal_operation(op, F.create_map(F.lit("name"), F.col("c_name")), F.lit(None).cast("array<string>"), kind, F.lit(None).cast("string"), data)
    return rows.select("c_custkey", r.alias("r")).select("c_custkey", "r.status", "r.error", "r.result")


def service_info(spark: SparkSession, d: str) -> DataFrame:
    from ..api import ENDPOINTS, VERSION

    return spark.range(1).select(F.lit("ok").alias("health"), F.lit(VERSION).alias("version"), F.array_join(F.array(*map(F.lit, ENDPOINTS)), " ").alias("endpoints"))


def _stream_names(spark: SparkSession, kind: str) -> tuple[str, str]:
    import uuid

    from ..streaming.registry import shared_folder

    name = f"{kind}_{uuid.uuid4().hex}"
    return name, f"{shared_folder(spark)}/{name}"


def streaming_tasks(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import registry as stream

    return stream.run_tasks(spark, d, *_stream_names(spark, "tasks"))


def streaming_responses(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stream in which users' targets are missing for small payload numbers."""
    from ..streaming import registry as stream

    def broken(rows: DataFrame) -> DataFrame:
        return rows.withColumn("target_id", F.when(props_k("payload") >= 10, F.col("target_id")))

    return stream.run_answers(spark, d, *_stream_names(spark, "answers"), change=broken).withColumn("target_id", F.coalesce(F.col("target_id").cast("string"), F.lit("None")))


QUERIES = {f.__name__: f for f in (
    task_lookups, api_responses, list_response, validate_payloads, agent_bodies, config_outcomes, config_state, status_trails, task_handlers,
    await_responses, roster_start, supervisor_counts, roster_sizes, verdicts, tool_outcome, task_times, process_env, redact, flatten_operation,
    service_info, streaming_tasks, streaming_responses,
)}

_W = """with w as (select s_suppkey as worker_id, ['idle', 'processing_task', 'error', 'mcp_tool_busy', 'initializing'][(s_suppkey % 5 + 1)::int] as status,
  s_suppkey % 7 = 0 as boss, s_suppkey % 11 <> 0 as client from supplier) """
_KIND = "case event_type when 'signup' then 'create_agent' when 'click' then 'execute_task' when 'view' then 'get_agent_status' when 'purchase' then 'cancel_task' else 'delete_agent' end"

ORACLES = {
    "task_lookups": FOLD + """select o.command_id as request_id, o.task_ref as task_id, t.status, case when t.status is null then 'Task not found: ' || o.task_ref end as error
      from o left join t on t.task_id = o.task_ref where o.command_type = 'cancel_task'""",
    "api_responses": FOLD + """select command_id, case when ok then 'success' else 'failure' end as status,
      case when ok then case command_type when 'create_agent' then '{"message":"Agent created with ID ' || target_id || '","agent_id":"' || target_id || '"}'
        when 'execute_task' then '{"message":"Task created on agent ' || target_id || '","task_id":"' || command_id || '"}'
        when 'get_agent_status' then '{"agent_id":"' || target_id || '","status":{"status":"running"}}'
        when 'cancel_task' then '{"message":"Task ' || task_ref || ' canceled"}' else '{"message":"Agent ' || target_id || ' deleted"}' end end as result,
      case when not ok then case command_type when 'cancel_task' then 'Task not found: ' || task_ref else 'Agent not found: ' || target_id end end as error,
      case when ok and command_type = 'execute_task' then command_id::varchar end as task_id,
      case when ok and command_type in ('create_agent', 'get_agent_status') then target_id::varchar end as agent_id from o""",
    "list_response": FOLD + """select n_nationkey as caller, case when r_name = 'EUROPE' then (select count(*) from a) else 0 end as n_agents,
      case when r_name = 'EUROPE' then (select coalesce(min(id), -1) from a) else -1 end as first_id, case when r_name <> 'EUROPE' then 'Invalid API key' end as error
      from nation join region on r_regionkey = n_regionkey""",
    "validate_payloads": f"""select event_id as command_id, case when (value < 30 or value >= 60 and value < 80) then case {_KIND}
        when 'execute_task' then 'payload must contain ''task_type''' when 'create_agent' then 'payload must contain ''agent_type''' end end as error from events""",
    "agent_bodies": "select c_custkey, case when c_acctbal > 5000 then c_mktsegment when c_acctbal > 0 then c_name else 'default' end as agent_type from customer",
    "config_outcomes": """select p_partkey, case when p_size < 25 then '' when p_size < 35 then 'mcp.enabled,agent.name' when p_size < 45 then '' when p_size < 49 then 'mcp.enabled,mcp.retry_count' else '' end as applied,
      case when p_size >= 25 and p_size < 35 then 'mcp.api_key' when p_size >= 35 and p_size < 45 then 'agent.agent_id' else '' end as rejected,
      case when p_size < 20 or p_size >= 49 or p_size >= 35 and p_size < 45 then 'failed' else 'completed' end as status,
      case when p_size < 20 or p_size >= 49 then 'Missing or invalid ''updates'' in configuration update payload' when p_size >= 35 and p_size < 45 then 'All configuration updates were rejected' end as error,
      case when p_size >= 20 and p_size < 25 or p_size >= 45 and p_size < 49 then 'All configuration updates were applied successfully'
        when p_size >= 25 and p_size < 35 then 'Some configuration updates were applied, others rejected' end as message,
      case when p_size >= 25 and p_size < 35 then 'rebuilt' when p_size >= 45 and p_size < 49 then 'dropped' else 'kept' end as client from part""",
    "config_state": """with u as (select p_partkey as seq, p_size as agent_id, case when p_retailprice > 1000 then 'mcp' else 'agent' end as target,
        ['enabled', 'name', 'timeout_seconds', 'agent_id', 'description'][coalesce(try_cast(right(p_brand, 1) as int), 0) % 5 + 1] as field, p_name as value from part)
      select agent_id, target, field, arg_max(value, seq) as value from u
      where target = 'mcp' and field in ('enabled', 'timeout_seconds') or target = 'agent' and field in ('name', 'description') group by 1, 2, 3""",
    "status_trails": _W + """, t as (select o_orderkey as task_id, status, case when status in ('error', 'processing_task', 'mcp_tool_busy') then [status]
        when o_orderpriority like '1%' and client then [status, 'processing_task', 'mcp_tool_busy', 'idle', status] else [status, 'processing_task', status] end as trail
        from orders join w on worker_id = o_custkey % 10 + 1)
      select task_id, (unnest(range(len(trail))))::int as step, unnest(trail) as status from t""",
    "task_handlers": _W + "select o_orderkey as task_id, case when o_orderstatus = 'O' and o_custkey in (select worker_id from w where not boss) then o_custkey else 7 end as handler from orders",
    "await_responses": """with r as (select l_orderkey as k, min(l_shipdate) as shipped, min(l_returnflag) as flag from lineitem group by 1),
      x as (select *, date_diff('day', o_orderdate::date, shipped::date) as after, case when o_orderpriority like '1%' then 30 else 60 end as most from orders left join r on k = o_orderkey)
      select o_orderkey as task_id, case when o_orderstatus = 'P' then 'pending' when after <= most then case flag when 'N' then 'completed' else 'failed' end else 'failed' end as status,
        case when o_orderstatus <> 'P' and not coalesce(after <= most, false) then 'Failed to get response from worker ' || o_custkey end as error,
        case when o_orderstatus = 'P' then 0 when after <= most then after else most end::int as waited from x""",
    "roster_start": """select n_name as agent_id, case when left(n_name, 1) in ('A', 'E', 'I', 'O', 'U') then 'orchestrator' else 'worker' end as role, lower(n_name) as name,
      case when n_regionkey < 2 then 'from the roster' else 'from its document' end as description from nation""",
    "supervisor_counts": _W + "select count(*) as total, count(*) filter (boss) as orchestrators, count(*) filter (not boss) as workers from w",
    "roster_sizes": "select n_regionkey, count(*) as n_agents from nation group by 1",
    "verdicts": "select l_orderkey, bool_and(l_returnflag <> 'R') as passed, count(*) as steps from lineitem group by 1",
    "tool_outcome": """with a as (select event_id // 4 as call_id, (event_id % 4)::int as attempt, event_type in ('error', 'purchase') as bad, event_type from events where event_id % 4 <= 2),
      e as (select call_id, coalesce(min(attempt) filter (not bad or attempt >= 2), max(attempt)) as n from a group by 1)
      select call_id, n as retried, not bad as ok, case when not bad then event_type end as stdout, case when bad then 'MCP command failed with exit code 1: ' || event_type end as error, n * 2.0::double as waited
      from e join a using (call_id) where attempt = n""",
    "task_times": """select o_orderkey as task_id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as started_at,
      strftime(o_orderdate + to_seconds(floor(o_totalprice)::bigint % 3600), '%Y-%m-%dT%H:%M:%S') as completed_at from orders""",
    "process_env": """select n_nationkey, 'HOME' as key, '/root' as value from nation union all select n_nationkey, 'LANG', n_name from nation
      union all select n_nationkey, 'REGION', n_regionkey::varchar from nation union all select n_nationkey, 'MCP_API_KEY', lower(n_name) from nation where n_regionkey > 1""",
    "redact": "select c_custkey, 'name' as key, c_name as value from customer union all select c_custkey, 'api_key', 'REDACTED' from customer",
    "flatten_operation": """select c_custkey, case when c_custkey % 2 = 0 then 'completed' else 'failed' end as status, case when c_custkey % 2 <> 0 then 'Unsupported transform type: fold' end as error,
      case when c_custkey % 2 = 0 then '{"transformed_data":{"name":"' || c_name || '","nation.name":"' || n_name || '","nation.region.key":' || n_regionkey || ',"ids":[' || c_custkey || ']}}' end as result
      from customer join nation on c_nationkey = n_nationkey""",
    "service_info": "select 'ok' as health, '0.2.0' as version, '/ /health /command /tasks/{agent_id} /agents /agents/{agent_id} /ollama/models /ollama/models/pull' as endpoints",
    "streaming_tasks": """with x as (select distinct event_id - (props->>'$.k')::bigint - 1 as ref from events where event_type = 'purchase')
      select event_id as task_id, user_id as agent_id, case when ref is not null then 'canceled' else 'pending' end as status from events left join x on ref = event_id where event_type = 'click'""",
    "streaming_responses": f"""select event_id as command_id, case when k >= 10 then user_id::varchar else 'None' end as target_id, case when k < 10 and kind <> 'create_agent' then 'failure' else 'accepted' end as status,
      case when k < 10 and kind <> 'create_agent' then 'target_id is required for command type: ' || kind end as error
      from (select *, (props->>'$.k')::bigint as k, {_KIND} as kind from events)""",
}
