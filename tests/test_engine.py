"""Edge cases of the command engine on literal rows, and the facade, sources and streams."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cmdlake.api import CommandCenter, CommandError
from cmdlake.functions import payload as P
from cmdlake.functions import rules
from cmdlake.operators import registry, retry, routing, tasks
from cmdlake.sources import config


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def m(**kw):
    return F.create_map(*[x for k, v in kw.items() for x in (F.lit(k), F.lit(v).cast("string"))])


def test_keys_that_fall_together(spark):
    row = one(spark, P.uppercase_keys(m(a="1", B="2", A="3")).alias("u"), P.lowercase_keys(m(X="1")).alias("l"), P.overlay(m(a="1", b="2"), m(b="3", c="4"), F.lit(None).cast("map<string,string>")).alias("o"))
    assert list(row["u"].items()) == [("A", "3"), ("B", "2")] and row["l"] == {"x": "1"} and row["o"] == {"a": "1", "b": "3", "c": "4"}


def test_missing_fields(spark):
    data = F.create_map(F.lit("a"), F.lit("x"), F.lit("b"), F.lit(None).cast("string"))
    row = one(spark, P.missing_fields(data, F.array(*map(F.lit, "abca"))).alias("e"), P.missing_fields(data, F.array().cast("array<string>")).alias("n"))
    assert row["e"] == ["Missing required field: b", "Missing required field: c"] and row["n"] == []


def test_templates_and_references(spark):
    row = one(
        spark,
        P.fill_template(F.lit("{a} {b} {c}"), F.array(F.lit("a"), F.lit("b")), m(a="{b}", b="x", c="y")).alias("t"),
        P.resolve_env(F.lit("x-${A}-${B}-${bad-x}-${A}"), m(A="va")).alias("e"),
        P.json_or_stdout(F.lit(" not json ")).alias("s"), P.json_or_stdout(F.lit('{"a":1}')).alias("j"),
        P.normalise_url(F.lit("host:1//")).alias("u"), P.parse_int(F.lit(" +12 ")).alias("i"), P.parse_int(F.lit("1.5")).alias("bad"), P.parse_bool(F.lit("ON")).alias("b"),
    )
    assert row["t"] == "x x {c}" and row["e"] == "x-va--${bad-x}-va"
    assert json.loads(row["s"]) == {"stdout": "not json"} and row["j"] == '{"a":1}' and row["u"] == "http://host:1"
    assert row["i"]["value"] == 12 and not row["bad"]["valid"] and row["b"]


def test_flatten_json_of_any_shape(spark):
    df = spark.createDataFrame([(1, '{"a":{"b":{"c":1},"e":{}},"d":[1,{"x":2}],"":{"z":3}}'), (2, "{}"), (3, "oops")], "id long, j string")
    got = {(r["id"], r["path"], r["value"]) for r in P.flatten_json(df, "id", "j").collect()}
    assert got == {(1, "a.b.c", "1"), (1, "d", '[1,{"x":2}]'), (1, "z", "3")}


def test_flatten_takes_a_million_rows_and_deep_objects(spark):
    rows = spark.range(1_000_000).select("id", F.format_string('{"a":{"b":%d},"c":"x"}', "id").alias("j"))
    assert P.flatten_json(rows, "id", "j").agg(F.count("*"), F.count_distinct("path")).first()[:] == (2_000_000, 2)
    deep = '{"k":' * 300 + "1" + "}" * 300
    got = P.flatten_json(spark.createDataFrame([(1, deep), (2, '{"a.b":1,"a":{"b":2}}'), (3, "[1]"), (4, None)], "id long, j string"), "id", "j").collect()
    assert {(r["id"], r["path"], r["value"]) for r in got} == {(1, ".".join("k" * 300), "1"), (2, "a.b", "2")}
    assert one(spark, P.flatten_text(F.lit('{"a":{"b":[{"c":1}]},"":{"z":null}}')).alias("f"))["f"] == '{"a.b":[{"c":1}],"z":null}'


def test_flatten_in_the_dispatcher(spark):
    r = tasks.internal_operation(F.lit("transform_data"), m(a="1"), F.lit(None).cast("array<string>"), F.lit("flatten"), F.lit(None).cast("string"), F.lit('{"a":{"b":1,"e":{}}}'))
    assert one(spark, r.alias("r"))["r"]["result"] == '{"transformed_data":{"a.b":1}}'


def test_status_trails_and_waiting(spark):
    row = one(
        spark, tasks.status_trail(F.lit("initializing"), F.lit("mcp_command"), F.lit(True)).alias("tool"), tasks.status_trail(F.lit("idle"), F.lit("mcp_command"), F.lit(False)).alias("none"),
        tasks.status_trail(F.lit("error"), F.lit("mcp_command"), F.lit(True)).alias("refused"), routing.handled_by(F.lit(1), F.lit(1), F.lit(True)).alias("me"), routing.handled_by(F.lit(1), F.lit(2), F.lit(None).cast("boolean")).alias("unknown"),
        routing.handled_by(F.lit(1), F.lit(2), F.lit(True)).alias("other"),
    )
    assert row["tool"] == ["initializing", "processing_task", "mcp_tool_busy", "idle", "initializing"]
    assert row["none"] == ["idle", "processing_task", "idle"] and row["refused"] == ["error"] and (row["me"], row["unknown"], row["other"]) == (1, 1, 2)
    asked = spark.createDataFrame([(1, 9, 5, False), (2, 9, None, False), (3, 9, 0, False), (4, 9, 5, True)], "task_id long, worker_id long, timeout_seconds int, is_async boolean")
    came = spark.createDataFrame([(1, "completed", 6), (2, "failed", 60), (4, "completed", 1)], "task_id long, status string, after int")
    got = {r["task_id"]: (r["status"], r["error"], r["waited"]) for r in routing.awaited(asked, came).collect()}
    late = "Failed to get response from worker 9"
    assert got == {1: ("failed", late, 5), 2: ("failed", None, 60), 3: ("failed", late, 60), 4: ("pending", None, 0)}


def test_fixed_delay_and_external_programs(spark):
    from cmdlake.operators import external

    rows = [(1, 0, 1, "a"), (1, 1, 0, " b "), (2, 0, 1, " c "), (2, 1, 2, "d"), (3, 0, 1, "x")]
    got = {r["call_id"]: r[1:] for r in retry.tool_outcome(spark.createDataFrame(rows, "call_id long, attempt int, exit_code int, output string"), 1, 2.0).collect()}
    assert got[1] == (1, True, "b", None, 2.0) and got[2] == (1, False, None, "MCP command failed with exit code 2: d", 2.0) and got[3][1] is False
    calls = spark.createDataFrame([(1, "-c", ['echo "{\\"a\\":1}"']), (2, "-c", ["echo $X"]), (3, "-c", ["echo bad >&2; exit 3"]), (4, "-c", ["sleep 5"])], "call_id long, command string, args array<string>")
    with pytest.raises(PermissionError):
        external.run_commands(calls, "/bin/sh")
    got = {r["call_id"]: r for r in external.run_commands(calls, "/bin/sh", {"X": "y"}, timeout=1, retries=1, delay=0, allow=True).collect()}
    assert json.loads(got[1]["output"]) == {"a": 1} and json.loads(got[2]["output"]) == {"stdout": "y"}
    assert got[3]["error"].endswith("exit code 3: bad") and got[3]["attempts"] == 2 and "timed out" in got[4]["error"]


def test_rules_tell_absent_from_null(spark):
    t, none = F.lit(True), F.lit(None).cast("string")
    row = one(
        spark,
        rules.errors(*rules.request_rules(F.lit("delete_agent"), none, t)).alias("null"), rules.errors(*rules.request_rules(F.lit("delete_agent"), none, ~t)).alias("absent"),
        rules.errors(*rules.request_rules(F.lit("list_agents"), none, t)).alias("free"), rules.errors(*rules.response_rules(F.lit("failure"), none, t)).alias("fail"),
        rules.errors(*rules.timeout_rules(F.lit(301))).alias("late"), rules.errors(*rules.timeout_rules(F.lit(300))).alias("ok"), rules.errors(*rules.log_level_rules(F.lit("loud"))).alias("level"),
        rules.role_of(F.lit("worker"), t).alias("role"), rules.role_of(F.lit("orchestrator"), ~t).alias("auto"),
    )
    assert row["null"] and not row["absent"] and not row["free"] and row["fail"] and row["late"] and not row["ok"] and row["level"]
    assert row["role"]["error"] and row["auto"]["is_orchestrator"]


def test_updates(spark):
    rows = [(1, "mcp", "enabled", "x"), (1, "agent", "agent_id", "x"), (2, "mcp", "api_key", "x"), (3, "agent", "name", "x")]
    got = {r["task_id"]: r for r in tasks.apply_updates(spark.createDataFrame(rows, "task_id long, target string, field string, value string")).collect()}
    assert (got[1]["status"], got[1]["rebuild"], got[1]["rejected"]) == ("completed", True, ["agent.agent_id"])
    assert got[2]["status"] == "failed" and got[3]["message"].startswith("All configuration updates were applied")


def test_delegation_without_idle_workers_takes_the_first(spark):
    w = spark.createDataFrame([(5, "error", 2, True), (7, "error", 1, True)], "worker_id long, status string, registered long, has_queue boolean")
    t = spark.createDataFrame([(1, None), (2, 9)], "task_id long, wanted long")
    got = {r["task_id"]: (r["target"], r["error"]) for r in routing.delegate(t, w, F.col("task_id")).collect()}
    assert got == {1: (7, None), 2: (9, "Worker agent not found: 9")}
    none = {r["task_id"]: r["error"] for r in routing.delegate(t, w.limit(0), F.col("task_id")).collect()}
    assert none[1] == "No worker agents registered"


def test_retries(spark):
    rows = [(1, 0, 503), (1, 1, 200), (2, 0, 400), (3, 0, 429), (3, 1, 429), (3, 2, 503)]
    got = {r["request_id"]: (r["attempts_before"], r["code"], r["ok"], r["waited"]) for r in retry.finished(spark.createDataFrame(rows, "request_id long, attempt int, code int"), 2, 1.0).collect()}
    assert got == {1: (1, 200, True, 1.0), 2: (0, 400, False, 0.0), 3: (2, 503, False, 3.0)}
    assert one(spark, retry.schedule(0.5, 4).alias("s"))["s"] == [0.5, 1.0, 2.0, 4.0]


def test_client(spark):
    c = CommandCenter(spark, api_key="k")
    a, b = c.create_agent("x"), c.create_agent()
    task = c.execute_task(a, job="j")
    assert c.task_status(task) == "pending"
    c.cancel_task(task)
    c.cancel_task(task)  # canceling again succeeds
    assert c.task_status(task) == "canceled" and [x["id"] for x in c.list_agents()] == sorted([a, b])
    c.delete_agent(a)
    with pytest.raises(CommandError, match="Agent not found"):
        c.execute_task(a)
    assert c.system_status() == {"agents": 1, "tasks": 1, "status": "running"}
    assert c.agent_status(b)["type"] == "default"
    with pytest.raises(PermissionError):
        c.send_command("list_agents", api_key="wrong")
    assert c.send_command("dance", api_key="k")["error"] == "Unknown command type: dance"
    assert c.send_command("create_agent", api_key="k")["error"] == "Agent type is required"


def test_service_answers_and_command_line(spark, tmp_path, capsys):
    from cmdlake import api

    c = CommandCenter(spark)
    a = c.create_from_body({"type": "x", "name": "n"})["agent_id"]
    b = c.create_from_body({"type": "x", "agent_type": "y"})["agent_id"]
    assert c.agent_status(a)["type"] == "x" and c.agent_status(b)["type"] == "y"
    assert json.loads(c.agent_response(a)["status"]["status"]["config"])["name"] == "n" and c.agent_response("none") == {"agent_id": "none", "error": "Agent not found: none"}
    assert len(c.agents_response()["agents"]) == 2 and "/health" in c.info()["endpoints"] and c.host()["system"]
    c.spark = None
    assert c.agents_response()["agents"] == [] and c.agents_response()["error"]
    body, task, raw, log = (str(tmp_path / x) for x in ("b.json", "t.json", "r.json", "log"))
    for path, text in ((body, '{"type": "z"}'), (task, '{"task_type": "t"}'), (raw, '{"command_id": "mine", "command_type": "get_system_status"}')):
        open(path, "w").write(text)
    assert api.main(["--log", log, "create-agent", body], spark) == 0
    agent = json.loads(capsys.readouterr().out)["agent_id"]
    assert api.main(["--log", log, "execute-task", agent, task], spark) == 0 and json.loads(capsys.readouterr().out)["task_id"] == 2
    assert api.main(["--log", log, "raw-command", raw], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["command_id"] == "mine" and out["result"] == {"agents": 1, "tasks": 1, "status": "running"}
    assert api.main(["--log", log, "agent-status", "nobody"], spark) == 1 and api.main(["execute-task", agent, "/nowhere"], spark) == 1
    assert api.main(["--log", log, "list-agents"], spark) == 0 and api.main(["health"], spark) == 0 and api.main([], spark) == 0


def test_models_through_a_transport():
    from cmdlake import api

    def server(method, path, body):
        if path == "/api/tags":
            return 200, '{"models":[{"name":"a"},{"name":"b","size":3}]}'
        if body == {"name": "slow"}:
            raise TimeoutError("late")
        if body == {"name": "off"}:
            raise ConnectionRefusedError("refused")
        return (404, '{"error":"no such model"}') if body["name"] == "x" else (200, "pulled")

    assert [(m["name"], m["size"]) for m in api.list_models(server)] == [("a", 0), ("b", 3)]
    assert api.pull_model(server, "ok", insecure=True) == {"text": "pulled"}
    for name, kind in (("slow", api.TimedOutError), ("off", api.UnreachableError), ("x", api.ApiError)):
        with pytest.raises(kind):
            api.pull_model(server, name)


def test_streams_answer_and_fold_over_several_batches(spark, tmp_path):
    from cmdlake.streaming import registry as stream

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    for k in range(3):
        e.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(folder)
    agents = stream.run_once(spark, folder, "a", str(tmp_path / "ca"), "*.parquet")
    assert sorted(r["id"] for r in agents.collect()) == sorted(r["id"] for r in registry.agents(stream.commands(e)).collect())
    answered = stream.run_answers(spark, folder, "b", str(tmp_path / "cb"), "*.parquet", change=lambda x: x.withColumn("command_type", F.when(F.col("command_id") % 10 > 0, F.col("command_type"))))
    assert answered.count() == e.count() and answered.where("error like 'Error processing command%'").count() == e.where("event_id % 10 = 0").count()
    assert stream.run_tasks(spark, folder, "c", str(tmp_path / "cc"), "*.parquet").count() == e.where("event_type = 'click'").count()
    live = stream.to_table(stream.answers(stream.command_stream(spark, folder, "*.parquet")), str(tmp_path / "live"), str(tmp_path / "cl"), "append", "1 second")
    stream.stop(live)
    assert not live.isActive


def test_config(tmp_path):
    (tmp_path / "a.YAML").write_text("mcp:\n  enabled: false\n  timeout_seconds: 5\n")
    (tmp_path / "b.json").write_text('{"api_key": "${KEY}", "hosts": ["${H}", {"x": "${H}"}, 3]}')
    (tmp_path / "r.yml").write_text("agents:\n  - agent_id: a\n  - agent_id: b\n")
    (tmp_path / "e.yml").write_text("")
    (tmp_path / ".env").write_text("# c\nA=1\nexport B='two'\n")
    env = {"MCP_TIMEOUT_SECONDS": "9", "MCP_ENV_FOO": "bar", "MCP_ENABLED": "Yes", "KEY": "k", "AGENT_NAME": "n", "AGENT_TOOL_X": "1", "AGENT_IS_ORCHESTRATOR": "on"}
    assert config.tool_config(str(tmp_path / "a.YAML"), env) == {"enabled": True, "timeout_seconds": 9, "environment_variables": {"foo": "bar"}}
    assert config.api_config(str(tmp_path / "b.json"), env, {"port": 1}) == {"port": 1, "api_key": "k", "hosts": ["", {"x": ""}, 3]}
    assert config.agent_config(None, env, "me") == {"name": "n", "is_orchestrator": True, "agent_id": "me"}
    assert config.load_document(str(tmp_path / "e.yml")) == {} and len(config.roster(str(tmp_path / "r.yml"))) == 2
    assert config.env_file(str(tmp_path / "none"), str(tmp_path / ".env")) == {"A": "1", "B": "two"}
    agent, tool = config.load_all(str(tmp_path / "a.YAML"), None, env, "me")
    assert agent["agent_id"] == "me" and tool["timeout_seconds"] == 9
    assert config.tool_ready({}) and config.tool_ready({"executable_path": "/none"}) and not config.tool_ready({"executable_path": "/bin/sh"}) and not config.tool_ready({"enabled": False})
    assert config.process_env({"environment_variables": {"A": "2"}, "api_key": "k"}, {"A": "1", "B": "1"}) == {"A": "2", "B": "1", "MCP_API_KEY": "k"}
    client = config.client_config(None, {"X_API_URL": "u", "X_API_KEY": "k", "X_VERIFY_SSL": "1", "X_TIMEOUT": "5"}, "X_")
    assert client == {"api_url": "u", "api_key": "k", "timeout": 5, "verify_ssl": False, "max_retries": 3, "retry_delay": 0.5}
    assert config.service_config(str(tmp_path / "b.json"), env)["port"] == 8000
    assert config.whole_env(str(tmp_path / ".env"), {"A": "own"}) == {"A": "own", "B": "two"}
    for bad in (lambda: config.load_all(None, None, {}), lambda: config.client_config(None, {"X_TIMEOUT": "soon"}, "X_"), lambda: config.client_config(None, {}, "X_"), lambda: config.load_document("x.txt"), lambda: config.roster(str(tmp_path / "a.YAML")), lambda: config.agent_config(None, {}), lambda: config.api_config(None, env)):
        with pytest.raises(config.ConfigError):
            bad()


def test_worker_fold_is_an_upsert(spark):
    log = [(1, 7, "register", "idle"), (2, 7, "register", "error"), (3, 8, "unregister", None), (4, 9, "register", "idle"), (5, 9, "unregister", None)]
    got = registry.worker_table(spark.createDataFrame([(*x, "worker") for x in log], "seq long, worker_id long, op string, status string, role string")).collect()
    assert [(r["worker_id"], r["status"]) for r in got] == [(7, "error")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_workers_find_the_package_wherever_the_session_starts(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = f"""import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from cmdlake import catalog
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", len(catalog.queries()["flatten_open"](spark, "/root/testdata/sf0.001").collect()))"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0


def test_a_log_cut_into_slices_folds_as_one(spark):
    """Against a plain walk over the log: a hot target over many slices, null targets and times, equal times."""
    import datetime
    import random

    rng, start = random.Random(3), datetime.datetime(2024, 1, 1)
    kinds = ("create_agent", "delete_agent", "execute_task")
    log = [(i, None if rng.random() < 0.05 else start + datetime.timedelta(minutes=30 * rng.randrange(40)), rng.choice((1, 1, 1, 2, 3, None)), rng.choice(kinds)) for i in range(300)]
    frame = spark.createDataFrame(log, "command_id long, ts timestamp_ntz, target_id long, command_type string")
    alive, want = {}, {}
    for i, _, target, kind in sorted(log, key=lambda r: (r[1] is not None, r[1] or start, r[0])):
        want[i] = alive.get(target, False)
        alive[target] = kind == "create_agent" or kind != "delete_agent" and want[i]
    for unit in ("hour", "day", "year"):
        assert {r["command_id"]: r["agent_exists"] for r in registry.as_of(frame, unit).collect()} == want
    assert registry.as_of(frame.limit(0)).columns == [*frame.columns, "agent_exists"] and registry.as_of(frame.limit(0)).count() == 0
