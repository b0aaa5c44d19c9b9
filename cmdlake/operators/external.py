"""External programs as a source of rows. Off unless the caller allows it: it runs what the rows name."""

from __future__ import annotations

import json
import os
import subprocess
import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship

RESULT = "call_id long, ok boolean, output string, error string, attempts int"


def run_once(argv: list[str], env: dict[str, str], timeout: float, retries: int, delay: float) -> tuple[bool, str | None, str | None, int]:
    """(ok, output as JSON text, last error, attempts): a program is tried again when it fails or takes too long."""
    error = None
    for attempt in range(retries + 1):
        if attempt:
            time.sleep(delay)
        try:
            done = subprocess.run(argv, env=os.environ | env, capture_output=True, text=True, timeout=timeout, check=False)
        except subprocess.TimeoutExpired:
            error = f"MCP command timed out after {timeout:g} seconds"
            continue
        except OSError as e:
            error = f"Error executing MCP command: {e}"
            continue
        if done.returncode:
            error = f"MCP command failed with exit code {done.returncode}: {done.stderr.strip()}"
            continue
        try:
            json.loads(done.stdout)
            return True, done.stdout, None, attempt + 1
        except ValueError:
            return True, json.dumps({"stdout": done.stdout.strip()}), None, attempt + 1
    return False, None, f"MCP command failed after {retries} retries: {error}", retries + 1


def run_commands(calls: DataFrame, executable: str, env: dict[str, str] | None = None, timeout: float = 30, retries: int = 3, delay: float = 2, allow: bool = False) -> DataFrame:
    """RESULT for each of calls (call_id, command, args array<string>). A program may run again when a task does."""
    if not allow:
        raise PermissionError("running external programs must be allowed explicitly")
    ship(calls.sparkSession)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(c, *run_once([executable, name, *(args if args is not None else [])], env or {}, timeout, retries, delay)) for c, name, args in zip(frame["call_id"], frame["command"], frame["args"], strict=True)]
            yield pd.DataFrame(rows, columns=["call_id", "ok", "output", "error", "attempts"])

    return calls.select("call_id", "command", "args").mapInPandas(run, RESULT)
