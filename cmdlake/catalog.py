"""All queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from .plans import agent_plane, command_plane, service_plane


def queries() -> dict:
    return command_plane.QUERIES | agent_plane.QUERIES | service_plane.QUERIES


def oracle_sql() -> dict[str, str]:
    return command_plane.ORACLES | agent_plane.ORACLES | service_plane.ORACLES
