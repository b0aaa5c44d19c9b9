"""Configuration documents: files by suffix, environment layers, and which of the two wins.

Documents are single small files that the driver reads; merged layers can be used on the driver as dicts or as
map columns through ``functions.payload``.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping
from pathlib import Path
from typing import Any

TRUE = ("true", "yes", "1", "on")
_REF = re.compile(r"\$\{([A-Za-z0-9_]+)\}")


class ConfigError(ValueError):
    """A document or a set of layers that can't be used."""


def load_document(path: str) -> dict[str, Any]:
    """A YAML or JSON document by suffix, in any case; an empty one is {}."""
    suffix = Path(path).suffix.lower()
    if suffix not in (".yml", ".yaml", ".json"):
        raise ConfigError(f"unsupported configuration format: {suffix}")
    try:
        text = Path(path).read_text()
        if suffix == ".json":
            return json.loads(text) if text.strip() else {}
        import yaml

        return yaml.safe_load(text) or {}
    except (OSError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from e
    except Exception as e:  # the YAML parser's own errors
        raise ConfigError(f"{path}: {e}") from e


def resolve(value: Any, env: Mapping[str, str] | None = None) -> Any:
    """value with ``${NAME}`` resolved in strings, in dicts, and in lists of dicts and strings; unset names are empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return _REF.sub(lambda m: env.get(m[1], ""), value)
    if isinstance(value, dict):
        return {k: resolve(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [resolve(v, env) if isinstance(v, dict | str) else v for v in value]
    return value


def env_layer(prefix: str, env: Mapping[str, str] | None = None, skip: str | None = None) -> dict[str, str]:
    env = os.environ if env is None else env
    own = {k[len(prefix) :].lower(): v for k, v in env.items() if k.startswith(prefix)}
    return {k: v for k, v in own.items() if not (skip and k.startswith(skip))}


def _number(text: str) -> int | str:
    return int(text) if re.fullmatch(r"\s*[+-]?\d+\s*", text) else text


def tool_config(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "MCP_") -> dict[str, Any]:
    """The tool's document, opened at ``mcp``, under the environment's layer. A document that can't be read is left out."""
    base: dict[str, Any] = {}
    if path:
        try:
            base = load_document(path)
        except ConfigError:
            base = {}
        base = base.get("mcp", base)
    layer: dict[str, Any] = {}
    nested: dict[str, str] = {}
    for k, v in env_layer(prefix, env).items():
        if k.startswith("env_"):
            nested[k[4:]] = v
        elif k == "enabled":
            layer[k] = v.lower() in TRUE
        elif k in ("timeout_seconds", "retry_count", "retry_delay_seconds"):
            layer[k] = _number(v)
        else:
            layer[k] = v
    return base | layer | ({"environment_variables": nested} if nested else {})


def agent_config(path: str | None = None, env: Mapping[str, str] | None = None, agent_id: str | None = None, prefix: str = "AGENT_") -> dict[str, Any]:
    """The agent's document, opened at ``agent``, under the environment's layer; agent_id only where there is none."""
    base = load_document(path) if path else {}
    layer: dict[str, Any] = env_layer(prefix, env, skip="tool_")
    if "is_orchestrator" in layer:
        layer["is_orchestrator"] = layer["is_orchestrator"].lower() in TRUE
    out = base.get("agent", base) | layer
    if agent_id and not out.get("agent_id"):
        out["agent_id"] = agent_id
    if not out.get("agent_id"):
        raise ConfigError("agent_id is required")
    return out


def load_all(tool_path: str | None = None, agent_path: str | None = None, env: Mapping[str, str] | None = None, agent_id: str | None = None) -> tuple[dict[str, Any], dict[str, Any]]:
    """(agent's, tool's) configuration; whatever goes wrong is a ConfigError."""
    try:
        return agent_config(agent_path, env, agent_id), tool_config(tool_path, env)
    except ConfigError:
        raise
    except Exception as e:
        raise ConfigError(f"failed to load configurations: {e}") from e


def tool_ready(found: Mapping[str, Any]) -> str | None:
    """Why an enabled tool can't be started: no executable, or none on disk."""
    if not found.get("enabled", True):
        return None
    path = found.get("executable_path")
    if not path:
        return "executable_path is required when the tool is enabled"
    return None if os.path.exists(path) else f"executable not found: {path}"


def process_env(found: Mapping[str, Any], env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment of a tool: the process's, over it the configured variables, and the key."""
    out = dict(os.environ if env is None else env) | dict(found.get("environment_variables") or {})
    return out | ({"MCP_API_KEY": found["api_key"]} if found.get("api_key") else {})


#: name, default, kind of the settings of the service and of its client
API_SETTINGS = (("host", "0.0.0.0", str), ("port", "8000", int), ("api_key", "", str), ("log_level", "INFO", str))
CLIENT_SETTINGS = (
    ("api_url", "", str), ("api_key", "", str), ("timeout", "30", int), ("verify_ssl", "true", lambda v: v.lower() == "true"),
    ("max_retries", "3", int), ("retry_delay", "0.5", float),
)


def env_defaults(settings: tuple, prefix: str, env: Mapping[str, str] | None = None) -> dict[str, Any]:
    """Settings from variables of a prefix, each with a default and a kind."""
    env = os.environ if env is None else env
    try:
        return {name: kind(env.get(f"{prefix}{name.upper()}", default)) for name, default, kind in settings}
    except ValueError as e:
        raise ConfigError(str(e)) from e


def client_config(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "CMDLAKE_") -> dict[str, Any]:
    return api_config(path, env, env_defaults(CLIENT_SETTINGS, prefix, env), ("api_url", "api_key"))


def service_config(path: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "CMDLAKE_") -> dict[str, Any]:
    return api_config(path, env, env_defaults(API_SETTINGS, prefix, env))


def api_config(path: str | None = None, env: Mapping[str, str] | None = None, defaults: Mapping[str, Any] | None = None, required: tuple[str, ...] = ("api_key",)) -> dict[str, Any]:
    """Defaults from the environment, under the document with its references resolved; required keys must not be empty."""
    out = dict(defaults or {}) | (resolve(load_document(path), env) if path else {})
    if lacking := [k for k in required if not out.get(k)]:
        raise ConfigError(f"required: {', '.join(lacking)}")
    return out


def roster(path: str) -> list[dict[str, Any]]:
    """The agents of a supervisor's document; each has an agent_id."""
    found = load_document(path)
    if not isinstance(found, dict) or not isinstance(found.get("agents"), list):
        raise ConfigError("a roster is an object with a list of agents")
    if any(not a.get("agent_id") for a in found["agents"]):
        raise ConfigError("every agent of a roster needs an agent_id")
    return found["agents"]


def env_file(*paths: str) -> dict[str, str]:
    """NAME=VALUE lines of the first file that exists; comments and blank lines aside, quotes removed."""
    for path in paths:
        if os.path.exists(path):
            rows = (x.strip().removeprefix("export ") for x in Path(path).read_text().splitlines())
            pairs = (x.split("=", 1) for x in rows if x and not x.startswith("#") and "=" in x)
            return {k.strip(): v.strip().strip("\"'") for k, v in pairs}
    return {}


def whole_env(path: str | None = None, env: Mapping[str, str] | None = None) -> dict[str, str]:
    """The environment with what a .env file adds: the one named, else the first in the working, home or package folder."""
    places = [path] if path else [str(x / ".env") for x in (Path.cwd(), Path.home(), Path(__file__).resolve().parents[2])]
    return env_file(*places) | dict(os.environ if env is None else env)
