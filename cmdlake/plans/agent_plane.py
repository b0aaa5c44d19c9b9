"""Queries of the agent plane and of payloads and configuration, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payload as P
from ..functions import rules
from ..operators import routing, tasks
from ..sources.fixtures import lookup, part_map, table, workers
from ..schemas import AGENT_STATUSES, LLM_PROVIDERS, TASK_TYPES


def _workers(spark: SparkSession, d: str) -> DataFrame:
    return workers(table(spark, d, "supplier"))


def agent_status_record(spark: SparkSession, d: str) -> DataFrame:
    client = F.when(F.col("worker_id") % 4 != 0, F.col("worker_id"))
    return _workers(spark, d).select(*routing.status_record(F.col("worker_id"), F.col("role"), F.col("status"), F.col("worker_id") % 3 != 0, client))


def agent_init(spark: SparkSession, d: str) -> DataFrame:
    executable = F.when(F.col("worker_id") % 4 != 0, F.lit("/opt/tool"))
    return _workers(spark, d).select("worker_id", routing.initial_status(F.col("worker_id") % 3 != 0, executable).alias("status"))


def idle_workers(spark: SparkSession, d: str) -> DataFrame:
    return routing.idle(_workers(spark, d)).select("worker_id", "role")


def role_split(spark: SparkSession, d: str) -> DataFrame:
    boss, rest = routing.split_roles(_workers(spark, d))
    rows = boss.select(F.lit("orchestrator").alias("side")).unionAll(rest.select(F.lit("worker").alias("side")))
    return rows.groupBy("side").agg(F.count("*").alias("n"))


def register_pairs(spark: SparkSession, d: str) -> DataFrame:
    return routing.register_all(*routing.split_roles(_workers(spark, d)))


def publish_worker_status(spark: SparkSession, d: str) -> DataFrame:
    """Every worker's report goes to each orchestrator that knows it, as all do."""
    return routing.publish_status(register_pairs(spark, d), _workers(spark, d)).select("orchestrator_id", "worker_id", "status")


def delegate_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Every third order names its worker, at times one that isn't there or has no queue; the others are placed."""
    key = F.col("o_orderkey")
    orders = table(spark, d, "orders").select(key.alias("task_id"), F.when(key % 3 == 0, F.col("o_custkey") % 120).alias("wanted"))
    return routing.delegate(orders, _workers(spark, d), F.col("task_id") * 31).select("task_id", "target", "status", "error")


def route_responses(spark: SparkSession, d: str) -> DataFrame:
    responses = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 150).alias("source_id"), (F.col("o_orderkey") % 10).alias("agent_id"))
    return routing.route(responses, _workers(spark, d)).select("task_id", "source_id", "agent_id")


def availability_gate(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 10 + 1).alias("worker_id"))
    return orders.join(_workers(spark, d), "worker_id").select("task_id", routing.unavailable(F.col("status")).alias("error"))


def task_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Task types by order key; the last of them has no handler. The worker's status after a task is the one before it."""
    kind = F.element_at(F.array(*map(F.lit, TASK_TYPES)), (F.col("o_orderkey") % len(TASK_TYPES)).cast("int") + 1)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), (F.col("o_custkey") % 10 + 1).alias("worker_id"), kind.alias("task_type"))
    after = F.element_at(tasks.status_trail(F.col("status"), F.col("task_type"), F.col("has_queue")), -1)
    rows = rows.join(_workers(spark, d), "worker_id").select("task_id", "task_type", after.alias("status_after"))
    return rows.withColumn("error", tasks.dispatch_error(F.col("task_type")))


def status_updates(spark: SparkSession, d: str) -> DataFrame:
    names = (*AGENT_STATUSES, "asleep", "")
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names)).cast("int") + 1)
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), tasks.status_update(status).alias("r"))
    return rows.select("task_id", "r.status", "r.error", "r.result")


def tool_payloads(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    command = F.when(key % 4 == 1, F.lit("")).when(key % 4 != 0, F.lit("open"))
    return table(spark, d, "orders").select(key.alias("task_id"), tasks.tool_payload_error(command, key % 3 != 0).alias("error"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part")


def required_fields(spark: SparkSession, d: str) -> DataFrame:
    need = F.array(*map(F.lit, ("p_name", "p_brand", "p_type", "p_brand")))
    return _parts(spark, d).select("p_partkey", F.concat_ws("; ", P.missing_fields(part_map(planted=True), need)).alias("errors"))


def _entries(spark: SparkSession, d: str, f) -> DataFrame:
    return _parts(spark, d).select("p_partkey", F.explode(f(part_map())).alias("key", "value"))


def uppercase_keys(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d, P.uppercase_keys)


def lowercase_keys(spark: SparkSession, d: str) -> DataFrame:
    return _entries(spark, d, P.lowercase_keys)


def internal_operations(spark: SparkSession, d: str) -> DataFrame:
    """Operations by part key: an echo, a validation, two transforms, and four ways to go wrong."""
    k = F.col("p_partkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % 8).cast("int") + 1)
    operation = pick("echo", "validate_data", "transform_data", "transform_data", "validate_data", "transform_data", "sing", "")
    transform = pick(None, None, "uppercase_keys", "lowercase_keys", None, "rotate", None, None)
    data = F.when(k % 8 == 4, F.lit(None).cast("map<string,string>")).otherwise(F.create_map(F.lit("Id"), k.cast("string"), F.lit("brand"), F.when(k % 3 != 0, F.col("p_brand"))))
    required = F.array(F.lit("Id"), F.lit("brand"))
    r = tasks.internal_operation(operation, data, required, transform, F.col("p_name"))
    return _parts(spark, d).select("p_partkey", r.alias("r")).select("p_partkey", "r.status", "r.error", "r.result")


def flatten_payload(spark: SparkSession, d: str) -> DataFrame:
    """Orders with customer and nation as one nested record, flattened by its schema."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    nation = F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    customer = F.struct(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), nation.alias("nation"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    rows = rows.select(F.col("o_orderkey").alias("task_id"), F.struct(F.col("o_orderstatus").alias("status"), customer.alias("customer")).alias("data"))
    return P.flatten_rows(rows, "task_id", "data")


def flatten_open(spark: SparkSession, d: str) -> DataFrame:
    """JSON of any shape, flattened without a schema."""
    n = table(spark, d, "nation")
    data = F.to_json(F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key"), F.struct(F.lit(True).alias("deep")).alias("more")).alias("region"), F.array("n_nationkey").alias("ids")))
    return P.flatten_json(n.select("n_nationkey", data.alias("data")), "n_nationkey", "data")


def fill_template(spark: SparkSession, d: str) -> DataFrame:
    values = F.map_from_arrays(F.array(F.lit("role"), F.lit("text")), F.array("role", "text"))
    declared = F.array(F.lit("role"), F.lit("text"), F.lit("absent"))
    return table(spark, d, "conversations").select("conv_id", "turn", P.fill_template(F.lit("{role} says: {text} {absent} {other}"), declared, values).alias("prompt"))


def resolve_env_refs(spark: SparkSession, d: str) -> DataFrame:
    env = F.create_map(F.lit("HOST"), F.col("n_name"), F.lit("PORT"), F.col("n_regionkey").cast("string"))
    return table(spark, d, "nation").select("n_nationkey", P.resolve_env(F.lit("http://${HOST}:${PORT}/${MISSING}${bad-x}"), env).alias("url"))


def config_overlay(spark: SparkSession, d: str) -> DataFrame:
    """File and environment layers of each nation: the environment wins for tools, the file for the service."""
    key = F.col("n_nationkey")
    file = F.create_map(F.lit("host"), F.col("n_name"), F.lit("port"), key.cast("string"))
    env = P.env_layer(F.create_map(F.lit("MCP_HOST"), F.concat(F.lit("env-"), F.col("n_name")), F.lit("MCP_RETRY_COUNT"), F.col("n_regionkey").cast("string"), F.lit("PATH"), F.lit("/bin")), "MCP_")
    both = F.array(F.struct(F.lit("tool").alias("scope"), P.overlay(file, env).alias("m")), F.struct(F.lit("service").alias("scope"), P.overlay(env, file).alias("m")))
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(both).alias("x"))
    return rows.select("n_nationkey", "x.scope", F.explode("x.m").alias("key", "value"))


def bool_parse(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("true", "YES", "on", "1", "0", "off", "maybe"))), (F.col("n_nationkey") % 7) + 1)
    return table(spark, d, "nation").select("n_nationkey", P.parse_bool(text).alias("server"), P.parse_bool(text, ("true",)).alias("client"))


def int_parse(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    text = F.when(key % 3 == 0, F.col("s_name")).when(key % 3 == 1, F.concat(F.lit(" "), key.cast("string"))).otherwise(F.concat(F.lit("-"), key.cast("string")))
    return table(spark, d, "supplier").select("s_suppkey", P.parse_int(text).alias("r")).select("s_suppkey", F.col("r.value").cast("string").alias("value"), "r.valid")


def url_normalise(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = F.concat(F.when(key % 3 == 0, "https://").when(key % 3 == 1, "http://").otherwise(""), F.lit("host"), key.cast("string"), F.when(key % 2 == 0, "/").otherwise(""))
    return table(spark, d, "supplier").select("s_suppkey", P.normalise_url(raw).alias("url"))


def enum_cast(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("worker_id") % 9 == 0, F.lit("asleep")).otherwise(F.col("status"))
    return _workers(spark, d).select("worker_id", P.as_enum(status, AGENT_STATUSES).alias("r")).select("worker_id", "r.value", "r.error")


def provider_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Provider, in any case, to the name of its variable, to its value."""
    provider = F.element_at(F.array(*[F.lit(p.title()) for p in LLM_PROVIDERS]), (F.col("n_nationkey") % 4) + 1)
    names = {p: f"{p.upper()}_API_KEY" for p in LLM_PROVIDERS if p != "ollama"}
    env = F.create_map(F.lit("GEMINI_API_KEY"), F.col("n_name"), F.lit("OPENAI_API_KEY"), F.lit("k"))
    return table(spark, d, "nation").select("n_nationkey", F.try_element_at(env, lookup(names, F.lower(provider))).alias("api_key"))


def classify_updates(spark: SparkSession, d: str) -> DataFrame:
    """Four parts make one task's updates; fields go by the part's key."""
    k = F.col("p_partkey")
    target = F.when(k % 2 == 0, "mcp").otherwise("agent")
    field = F.element_at(F.array(*map(F.lit, ("enabled", "name", "timeout_seconds", "agent_id", "api_key", "description"))), (k % 6).cast("int") + 1)
    rows = _parts(spark, d).select(F.floor(k / 4).cast("long").alias("task_id"), target.alias("target"), field.alias("field"), F.col("p_name").alias("value"))
    out = tasks.apply_updates(rows)
    return out.select("task_id", F.concat_ws(",", "applied").alias("applied"), F.concat_ws(",", "rejected").alias("rejected"), "status", "message", "rebuild")


def timeout_bounds(spark: SparkSession, d: str) -> DataFrame:
    seconds = F.col("o_custkey") % 400 - 20
    return table(spark, d, "orders").select("o_orderkey", F.try_element_at(rules.errors(*rules.timeout_rules(seconds)), F.lit(1)).alias("error"))


def role_consistency(spark: SparkSession, d: str) -> DataFrame:
    flag = F.col("worker_id") % 2 == 0
    return _workers(spark, d).select("worker_id", rules.role_of(F.col("role"), flag).alias("r")).select("worker_id", "r.is_orchestrator", "r.error")


def model_rows(spark: SparkSession, d: str) -> DataFrame:
    """A server's list of models: size and time of change have defaults, the raw row is kept."""
    key = F.col("s_suppkey")
    raw = F.to_json(F.struct(F.col("s_name").alias("name"), F.when(key % 2 == 0, key * 1000).alias("size"), F.when(key % 3 == 0, F.lit("2024-01-01")).alias("modified_at")))
    listed = table(spark, d, "supplier").select(F.to_json(F.struct(F.array(F.from_json(raw, "name string, size long, modified_at string")).alias("models"))).alias("body"))
    rows = listed.select(F.explode(F.from_json("body", "models array<struct<name string, size long, modified_at string>>")["models"]).alias("m"))
    return rows.select("m.name", F.coalesce("m.size", F.lit(0)).alias("size"), F.coalesce("m.modified_at", F.lit("")).alias("modified_at"), F.to_json("m").alias("details"))


def generate_request(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of text generation calls; options that aren't given are left out."""
    key = F.col("s_suppkey")
    body = P.compact(model=F.col("s_name"), prompt=F.lit("hi"), system=F.when(key % 2 == 0, F.lit("be brief")), top_k=F.when(key % 3 == 0, key))
    return table(spark, d, "supplier").select("s_suppkey", body.alias("body"))


def roster_rows(spark: SparkSession, d: str) -> DataFrame:
    """A roster document per region, its agents exploded; those without an id are reported."""
    n = table(spark, d, "nation")
    agent = F.struct(F.when(F.col("n_nationkey") % 8 != 0, F.col("n_name")).alias("agent_id"), F.when(F.col("n_nationkey") % 5 == 0, "orchestrator").otherwise("worker").alias("role"), F.col("n_nationkey").alias("at"))
    rosters = n.groupBy("n_regionkey").agg(F.collect_list(agent).alias("agents"))
    rows = rosters.select("n_regionkey", F.explode("agents").alias("a"))
    return rows.select("n_regionkey", "a.at", "a.agent_id", "a.role", F.when(F.col("a.agent_id").isNull(), "agent_id is required").alias("error"))


QUERIES = {f.__name__: f for f in (
    agent_status_record, agent_init, idle_workers, role_split, register_pairs, publish_worker_status, delegate_tasks, route_responses,
    availability_gate, task_dispatch, status_updates, tool_payloads, required_fields, uppercase_keys, lowercase_keys, internal_operations,
    flatten_payload, flatten_open, fill_template, resolve_env_refs, config_overlay, bool_parse, int_parse, url_normalise, enum_cast,
    provider_key_lookup, classify_updates, timeout_bounds, role_consistency, model_rows, generate_request, roster_rows,
)}

_W = """with w as (select s_suppkey as worker_id, ['idle', 'processing_task', 'error', 'mcp_tool_busy', 'initializing'][(s_suppkey % 5 + 1)::int] as status,
  case when s_suppkey % 7 = 0 then 'orchestrator' else 'worker' end as role from supplier) """
_KEYS = """with e as (select p_partkey, p_name, p_brand, p_type from part)
  select p_partkey, {f}('p_name') as key, 'second ' || p_partkey as value from e union all select p_partkey, {f}('p_brand'), p_brand from e
  union all select p_partkey, {f}('p_type'), p_type from e"""

ORACLES = {
    "agent_status_record": _W + "select worker_id as agent_id, role, status, role = 'orchestrator' as is_orchestrator, worker_id % 3 <> 0 and worker_id % 4 <> 0 as mcp_enabled from w",
    "agent_init": "select s_suppkey as worker_id, case when s_suppkey % 3 <> 0 and s_suppkey % 4 = 0 then 'error' else 'idle' end as status from supplier",
    "idle_workers": _W + "select worker_id, role from w where status = 'idle'",
    "role_split": _W + "select role as side, count(*) as n from w group by 1",
    "register_pairs": _W + "select o.worker_id as orchestrator_id, k.worker_id, k.status, k.role from w o, w k where o.role = 'orchestrator' and k.role = 'worker'",
    "publish_worker_status": _W + "select o.worker_id as orchestrator_id, k.worker_id, k.status from w o, w k where o.role = 'orchestrator' and k.role = 'worker'",
    "delegate_tasks": _W + """, i as (select worker_id as idle_id, row_number() over (order by worker_id) - 1 as place, count(*) over () as n from w where status = 'idle'),
      t as (select o_orderkey as task_id, case when o_orderkey % 3 = 0 then o_custkey % 120 end as wanted from orders),
      c as (select task_id, coalesce(wanted, idle_id) as target from t left join i on (task_id * 31) % n = place)
      select task_id, target, case when s_suppkey is null or s_suppkey % 11 = 0 then 'failed' else 'pending' end as status,
        case when s_suppkey is null then 'Worker agent not found: ' || target when s_suppkey % 11 = 0 then 'Worker ' || target || ' has no task queue registered' end as error
      from c left join supplier on s_suppkey = target""",
    "route_responses": "select o_orderkey as task_id, o_custkey % 150 as source_id, o_orderkey % 10 as agent_id from orders where o_custkey % 150 in (select s_suppkey from supplier) and o_custkey % 150 <> o_orderkey % 10",
    "availability_gate": _W + "select o_orderkey as task_id, case when status in ('error', 'processing_task', 'mcp_tool_busy') then 'Agent is not available to process tasks (current status: ' || status || ')' end as error from orders join w on worker_id = o_custkey % 10 + 1",
    "task_dispatch": _W + """select task_id, task_type, status as status_after, case when task_type = 'llm_request' then 'Unsupported task type: llm_request' end as error from
      (select o_orderkey as task_id, o_custkey % 10 + 1 as worker_id, ['mcp_command', 'internal_process', 'status_update', 'configuration_update', 'llm_request'][(o_orderkey % 5 + 1)::int] as task_type from orders) join w using (worker_id)""",
    "status_updates": """select task_id, case when s in ('asleep', '') then 'failed' else 'completed' end as status,
      case s when '' then 'Missing ''status'' in payload' when 'asleep' then 'Invalid status value: asleep' end as error,
      case when s not in ('asleep', '') then '{"status":"' || s || '"}' end as result from
      (select o_orderkey as task_id, ['initializing', 'idle', 'processing_task', 'error', 'mcp_tool_busy', 'asleep', ''][(o_orderkey % 7 + 1)::int] as s from orders)""",
    "tool_payloads": "select o_orderkey as task_id, case when o_orderkey % 4 in (0, 1) then 'Missing ''command'' in MCP task payload' when o_orderkey % 3 = 0 then '''args'' must be a list' end as error from orders",
    "required_fields": """select p_partkey, concat_ws('; ', case when p_partkey % 3 = 0 then 'Missing required field: p_brand' end, case when p_partkey % 5 = 0 then 'Missing required field: p_type' end,
      case when p_partkey % 3 = 0 then 'Missing required field: p_brand' end) as errors from part""",
    "uppercase_keys": _KEYS.format(f="upper"),
    "lowercase_keys": _KEYS.format(f="lower"),
    "internal_operations": """select p_partkey, case when m in (4, 5, 6, 7) or m = 1 and p_partkey % 3 = 0 then 'failed' else 'completed' end as status,
      case m when 1 then case when p_partkey % 3 = 0 then 'Validation failed' end when 4 then 'Missing ''data'' for validation operation' when 5 then 'Unsupported transform type: rotate'
        when 6 then 'Unsupported internal operation: sing' when 7 then 'Missing ''operation'' in internal task payload' end as error,
      case m when 0 then '{"echo":"' || p_name || '"}' when 1 then case when p_partkey % 3 = 0 then '{"validation_errors":["Missing required field: brand"]}' else '{"validation":"success"}' end
        when 2 then '{"transformed_data":{"ID":"' || p_partkey || '","BRAND":' || b || '}}' when 3 then '{"transformed_data":{"id":"' || p_partkey || '","brand":' || b || '}}' end as result
      from (select *, p_partkey % 8 as m, case when p_partkey % 3 = 0 then 'null' else '"' || p_brand || '"' end as b from part)""",
    "flatten_payload": """with r as (select o_orderkey as task_id, o_orderstatus, c_custkey, c_name, n_nationkey, n_name from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
      select task_id, 'status' as path, o_orderstatus as value from r union all select task_id, 'customer.key', c_custkey::varchar from r union all select task_id, 'customer.name', c_name from r
      union all select task_id, 'customer.nation.key', n_nationkey::varchar from r union all select task_id, 'customer.nation.name', n_name from r""",
    "flatten_open": """select n_nationkey, 'name' as path, '"' || n_name || '"' as value from nation union all select n_nationkey, 'region.key', n_regionkey::varchar from nation
      union all select n_nationkey, 'region.more.deep', 'true' from nation union all select n_nationkey, 'ids', '[' || n_nationkey || ']' from nation""",
    "fill_template": "select conv_id, turn, replace(replace('{role} says: {text} {absent} {other}', '{role}', role), '{text}', text) as prompt from conversations",
    "resolve_env_refs": "select n_nationkey, 'http://' || n_name || ':' || n_regionkey || '/' || chr(36) || '{bad-x}' as url from nation",
    "config_overlay": """select n_nationkey, 'tool' as scope, 'host' as key, 'env-' || n_name as value from nation union all select n_nationkey, 'service', 'host', n_name from nation
      union all select n_nationkey, s, 'port', n_nationkey::varchar from nation, (values ('tool'), ('service')) v(s) union all select n_nationkey, s, 'retry_count', n_regionkey::varchar from nation, (values ('tool'), ('service')) v(s)""",
    "bool_parse": "select n_nationkey, n_nationkey % 7 < 4 as server, n_nationkey % 7 = 0 as client from nation",
    "int_parse": "select s_suppkey, case s_suppkey % 3 when 1 then s_suppkey::varchar when 2 then (-s_suppkey)::varchar end as value, s_suppkey % 3 <> 0 as valid from supplier",
    "url_normalise": "select s_suppkey, case when s_suppkey % 3 = 0 then 'https://' else 'http://' end || 'host' || s_suppkey as url from supplier",
    "enum_cast": _W + "select worker_id, case when worker_id % 9 <> 0 then status end as value, case when worker_id % 9 = 0 then 'Invalid status value: asleep' end as error from w",
    "provider_key_lookup": "select n_nationkey, case n_nationkey % 4 when 1 then n_name when 3 then 'k' end as api_key from nation",
    "classify_updates": """with u as (select p_partkey // 4 as task_id, case when p_partkey % 2 = 0 then 'mcp' else 'agent' end as target,
        ['enabled', 'name', 'timeout_seconds', 'agent_id', 'api_key', 'description'][(p_partkey % 6 + 1)::int] as field from part),
      c as (select *, target = 'mcp' and field in ('enabled', 'timeout_seconds') or target = 'agent' and field in ('name', 'description') as ok from u),
      g as (select task_id, coalesce(string_agg(target || '.' || field, ',' order by case target when 'mcp' then 0 else 1 end, field) filter (ok), '') as applied,
        coalesce(string_agg(target || '.' || field, ',' order by case target when 'mcp' then 0 else 1 end, field) filter (not ok), '') as rejected, bool_or(ok and target = 'mcp' and field = 'enabled') as rebuild from c group by 1)
      select task_id, applied, rejected, case when applied = '' and rejected <> '' then 'failed' else 'completed' end as status,
        case when applied = '' and rejected <> '' then 'All configuration updates were rejected' when rejected <> '' then 'Some configuration updates were applied, others rejected'
        else 'All configuration updates were applied successfully' end as message, rebuild from g""",
    "timeout_bounds": "select o_orderkey, case when s < 1 then 'timeout_seconds must be at least 1' when s > 300 then 'timeout_seconds must be at most 300' end as error from (select o_orderkey, o_custkey % 400 - 20 as s from orders)",
    "role_consistency": _W + "select worker_id, worker_id % 2 = 0 or role = 'orchestrator' as is_orchestrator, case when worker_id % 2 = 0 and role <> 'orchestrator' then 'is_orchestrator requires role ''orchestrator''' end as error from w",
    "model_rows": """select s_name as name, case when s_suppkey % 2 = 0 then s_suppkey * 1000 else 0 end as size, case when s_suppkey % 3 = 0 then '2024-01-01' else '' end as modified_at,
      '{"name":"' || s_name || '"' || case when s_suppkey % 2 = 0 then ',"size":' || s_suppkey * 1000 else '' end || case when s_suppkey % 3 = 0 then ',"modified_at":"2024-01-01"' else '' end || '}' as details from supplier""",
    "generate_request": """select s_suppkey, '{"model":"' || s_name || '","prompt":"hi"' || case when s_suppkey % 2 = 0 then ',"system":"be brief"' else '' end
      || case when s_suppkey % 3 = 0 then ',"top_k":' || s_suppkey else '' end || '}' as body from supplier""",
    "roster_rows": """select n_regionkey, n_nationkey as at, case when n_nationkey % 8 <> 0 then n_name end as agent_id, case when n_nationkey % 5 = 0 then 'orchestrator' else 'worker' end as role,
      case when n_nationkey % 8 = 0 then 'agent_id is required' end as error from nation""",
}
