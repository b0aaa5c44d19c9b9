"""An in-process client: commands go to a log, answers and registries are folds of it.

The same calls as over the wire: create, execute, cancel, status, list, delete, and the raw envelope. Ids are
given by place in the log, so a run can be repeated.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import platform
import sys
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .operators import registry
from .schemas import COMMAND_TYPES


VERSION = "0.2.0"
#: The service's routes.
ENDPOINTS = ("/", "/health", "/command", "/tasks/{agent_id}", "/agents", "/agents/{agent_id}", "/ollama/models", "/ollama/models/pull")


class ServiceError(RuntimeError):
    """What a client may meet."""


class ApiError(ServiceError):
    """An answer with an HTTP status of failure."""

    def __init__(self, status: int, detail: str):
        super().__init__(f"{status}: {detail}")
        self.status, self.detail = status, detail


class CommandError(ServiceError):
    """A command that came back with status failure."""


class UnreachableError(ServiceError):
    """No connection to a server."""


class TimedOutError(UnreachableError):
    """A server that didn't answer in time."""


#: (method, path, body) -> (HTTP status, body): how a server of models is reached.
Transport = Callable[[str, str, "dict[str, Any] | None"], "tuple[int, str]"]


def asked(transport: Transport, method: str, path: str, body: dict[str, Any] | None = None) -> dict[str, Any]:
    """The JSON answer of a server; text that isn't JSON is wrapped. Failures come as this module's errors."""
    try:
        status, text = transport(method, path, body)
    except TimeoutError as e:
        raise TimedOutError(str(e)) from e
    except OSError as e:
        raise UnreachableError(str(e)) from e
    try:
        found = json.loads(text)
    except ValueError:
        found = {"text": text}
    if status >= 400:
        raise ApiError(status, str(found.get("error") or found.get("detail") or "Unknown error") if isinstance(found, dict) else "Unknown error")
    return found


def list_models(transport: Transport) -> list[dict[str, Any]]:
    """A server's models with defaults; the raw row stays as details."""
    rows = asked(transport, "GET", "/api/tags").get("models", [])
    return [{"name": r["name"], "size": r.get("size", 0), "modified_at": r.get("modified_at", ""), "details": r} for r in rows]


def pull_model(transport: Transport, name: str, insecure: bool = False) -> dict[str, Any]:
    return asked(transport, "POST", "/api/pull", {"name": name} | ({"insecure": True} if insecure else {}))


LOG = "command_id long, ts timestamp, command_type string, target_id string, task_ref long, agent_type string, payload string"


class CommandCenter:
    def __init__(self, spark: SparkSession, api_key: str | None = None):
        self.spark, self.api_key = spark, api_key
        self.log: list[tuple] = []

    def commands(self) -> DataFrame:
        return self.spark.createDataFrame(self.log, LOG)

    def send_command(self, command_type: str, target_id: str | None = None, payload: dict[str, Any] | None = None, api_key: str | None = None) -> dict[str, Any]:
        """The response record of one command."""
        if self.api_key is not None and api_key != self.api_key:
            raise PermissionError("Invalid API key")
        n, payload = len(self.log) + 1, payload or {}
        response: dict[str, Any] = {"command_id": n, "status": "success", "result": None, "error": None}
        if command_type not in COMMAND_TYPES:
            return response | {"status": "failure", "error": f"Unknown command type: {command_type}"}
        if command_type == "create_agent":
            if not payload.get("agent_type"):
                return response | {"status": "failure", "error": "Agent type is required"}
            target_id = f"agent-{n}"
        ref = payload.get("task_id")
        self.log.append((n, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n), command_type, target_id, ref, payload.get("agent_type"), json.dumps(payload)))
        row = registry.responses(self.commands()).where(f"command_id = {n}").first()
        response |= {"status": row["status"], "error": row["error"]}
        if row["status"] == "success":
            response["result"] = {"message": row["message"]} if row["message"] else self._result(command_type, target_id, ref)
            response |= {"agent_id": target_id} if command_type == "create_agent" else {"task_id": n} if command_type == "execute_task" else {}
        return response

    def _result(self, command_type: str, target_id: str | None, ref: Any) -> dict[str, Any]:
        log = self.commands()
        if command_type == "list_agents":
            return {"agents": [r.asDict() for r in registry.agents(log).orderBy("id").collect()]}
        if command_type == "get_agent_status":
            return {"agent_id": target_id, "status": registry.agents(log).where(registry.F.col("id") == target_id).first().asDict()}
        if command_type == "get_task_status":
            return {"task_id": ref, "status": registry.tasks(log).where(registry.F.col("task_id") == ref).first()["status"]}
        return registry.system_status(log).first().asDict()

    def _ok(self, response: dict[str, Any]) -> dict[str, Any]:
        if response["status"] != "success":
            raise CommandError(response["error"])
        return response

    def info(self) -> dict[str, Any]:
        """What the service is, without a key."""
        return {"name": "cmdlake", "version": VERSION, "endpoints": list(ENDPOINTS)}

    def host(self) -> dict[str, str]:
        return {"python": platform.python_version(), "system": platform.system(), "release": platform.release(), "machine": platform.machine(), "node": platform.node()}

    def agents_response(self, api_key: str | None = None) -> dict[str, Any]:
        """The listing; an empty one beside an error."""
        try:
            response = self.send_command("list_agents", api_key=api_key)
        except PermissionError:
            raise
        except Exception as e:  # noqa: BLE001 - the answer carries it
            return {"agents": [], "error": f"Error listing agents: {e}"}
        return {"agents": response["result"]["agents"]} if response["status"] == "success" else {"agents": [], "error": response["error"]}

    def agent_response(self, agent_id: str, api_key: str | None = None) -> dict[str, Any]:
        """An agent's status, nested as the service answers, or the error."""
        response = self.send_command("get_agent_status", agent_id, api_key=api_key)
        return {"agent_id": agent_id} | ({"status": response["result"]} if response["status"] == "success" else {"error": response["error"]})

    def create_from_body(self, body: dict[str, Any]) -> dict[str, Any]:
        """A new agent from a request's body: an agent_type given there wins over type, which defaults."""
        return self.send_command("create_agent", payload={"agent_type": body.get("type", "default"), **body}, api_key=self.api_key)

    def save(self, path: str) -> None:
        Path(path).write_text("".join(json.dumps([str(x) if isinstance(x, dt.datetime) else x for x in row]) + "\n" for row in self.log))

    def load(self, path: str) -> None:
        rows = (json.loads(x) for x in Path(path).read_text().splitlines()) if Path(path).exists() else ()
        self.log = [(r[0], dt.datetime.fromisoformat(r[1]), *r[2:]) for r in rows]

    def health_check(self) -> dict[str, str]:
        return {"status": "ok"}

    def create_agent(self, type: str = "default", **payload: Any) -> str:
        return self._ok(self.send_command("create_agent", payload={"agent_type": type, **payload}, api_key=self.api_key))["agent_id"]

    def execute_task(self, agent_id: str, **payload: Any) -> int:
        return self._ok(self.send_command("execute_task", agent_id, payload, self.api_key))["task_id"]

    def cancel_task(self, task_id: int) -> dict[str, Any]:
        return self._ok(self.send_command("cancel_task", payload={"task_id": task_id}, api_key=self.api_key))["result"]

    def task_status(self, task_id: int) -> str:
        return self._ok(self.send_command("get_task_status", payload={"task_id": task_id}, api_key=self.api_key))["result"]["status"]

    def list_agents(self) -> list[dict[str, Any]]:
        return self._ok(self.send_command("list_agents", api_key=self.api_key))["result"]["agents"]

    def agent_status(self, agent_id: str) -> dict[str, Any]:
        return self._ok(self.send_command("get_agent_status", agent_id, api_key=self.api_key))["result"]["status"]

    def delete_agent(self, agent_id: str) -> dict[str, Any]:
        return self._ok(self.send_command("delete_agent", agent_id, api_key=self.api_key))["result"]

    def system_status(self) -> dict[str, Any]:
        return self._ok(self.send_command("get_system_status", api_key=self.api_key))["result"]


def _document(path: str) -> Any:
    if not Path(path).exists():
        raise ServiceError(f"file not found: {path}")
    return json.loads(Path(path).read_text())


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Commands over a log that is kept in a file; answers are printed as JSON."""
    parser = argparse.ArgumentParser(prog="cmdlake", description=main.__doc__)
    parser.add_argument("--log", help="file of the command log, read before and written after")
    parser.add_argument("--api-key", help="key that the service asks for")
    sub = parser.add_subparsers(dest="command")
    for name, fields in (("health", ()), ("list-agents", ()), ("agent-status", ("agent_id",)), ("execute-task", ("agent_id", "task_file")), ("create-agent", ("config_file",)), ("raw-command", ("command_file",)), ("run", ("file",))):
        one = sub.add_parser(name)
        for field in fields:
            one.add_argument(field)
    given = parser.parse_args(args)
    if not given.command:
        parser.print_help()
        return 0
    if spark is None:
        from .session import build

        spark = build("local[2]")
    center = CommandCenter(spark, given.api_key)
    if given.log:
        center.load(given.log)

    def raw(c: dict[str, Any]) -> dict[str, Any]:
        """The answer to an envelope, under its own command_id where it has one."""
        answer = center.send_command(c.get("command_type", ""), c.get("target_id"), c.get("payload"), center.api_key)
        return answer | ({"command_id": c["command_id"]} if "command_id" in c else {})

    try:
        if given.command == "health":
            found: Any = center.health_check()
        elif given.command == "list-agents":
            found = center.agents_response(center.api_key)
        elif given.command == "agent-status":
            found = center.agent_response(given.agent_id, center.api_key)
        elif given.command == "execute-task":
            found = center.send_command("execute_task", given.agent_id, _document(given.task_file), center.api_key)
        elif given.command == "create-agent":
            found = center.create_from_body(_document(given.config_file))
        elif given.command == "raw-command":
            found = raw(_document(given.command_file))
        else:
            found = [raw(json.loads(x)) for x in Path(given.file).read_text().splitlines() if x.strip()]
    except ServiceError as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return 1
    print(json.dumps(found, indent=2))
    if given.log:
        center.save(given.log)
    return int(any(x.get("status") == "failure" or "error" in x and x["error"] for x in (found if isinstance(found, list) else [found])))


if __name__ == "__main__":
    sys.exit(main())
