"""Record types and closed domains of the command and agent planes."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the records' string fields.
AGENT_ROLES = ("orchestrator", "worker")
AGENT_STATUSES = ("initializing", "idle", "processing_task", "error", "mcp_tool_busy")
TASK_TYPES = ("mcp_command", "internal_process", "status_update", "configuration_update", "llm_request")
TASK_STATUSES = ("pending", "in_progress", "completed", "failed", "canceled")
COMMAND_TYPES = (
    "execute_task", "cancel_task", "get_task_status", "create_agent", "delete_agent", "list_agents",
    "get_agent_status", "get_system_status", "update_configuration",
)
COMMAND_STATUSES = ("success", "failure", "pending", "in_progress", "canceled")
LLM_PROVIDERS = ("ollama", "gemini", "anthropic", "openai")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
UNAVAILABLE = ("error", "processing_task", "mcp_tool_busy")
RUNTIME_FIELDS = {"mcp": ("enabled", "timeout_seconds", "retry_count", "retry_delay_seconds"), "agent": ("name", "description")}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()

#: Payloads travel as JSON text; ``parse_json`` opens them where a plan needs their fields.
COMMAND = _struct(seq=T.LongType(), command_id=S, command_type=S, target_id=S, payload=S)
RESPONSE = _struct(command_id=S, status=S, result=S, error=S, task_id=S, agent_id=S)
TASK = _struct(task_id=S, task_type=S, created_at=T.TimestampType(), source_agent_id=S, target_agent_id=S, priority=I, payload=S, timeout_seconds=I)
TASK_RESPONSE = _struct(task_id=S, agent_id=S, status=S, started_at=T.TimestampType(), completed_at=T.TimestampType(), result_payload=S, error_message=S)
TOOL = _struct(tool_id=S, tool_type=S, enabled=B, config=S)
AGENT = _struct(agent_id=S, role=S, is_orchestrator=B, name=S, description=S, tools=T.ArrayType(TOOL))
REGISTRY = _struct(agent_id=S, type=S, status=S, config=S)
WORKER = _struct(worker_id=S, status=S, role=S)
ROSTER = _struct(mcp_config_path=S, agents=T.ArrayType(_struct(agent_id=S, role=S, name=S, description=S)))
