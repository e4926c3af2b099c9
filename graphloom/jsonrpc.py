"""JSON-RPC adapter over the graph questions: tool schemas, arguments, envelopes, a loop over lines."""

from __future__ import annotations

import json
import sys
from typing import Any, TextIO

from pyspark.sql import DataFrame

from graphloom.operators.api import GraphApi, GraphResult

PROTOCOL = "2024-11-05"
_TEXT, _DEPTH, _LIMIT, _LIST = {"type": "string"}, {"type": "integer", "minimum": 0, "maximum": 255}, {"type": "integer", "minimum": 1}, {"type": "array", "items": {"type": "string"}}
_SOME = _LIST | {"minItems": 1}
#: Fixed wire values: tools, their arguments (text, depth, limit, list, some: a list of one or more) and which are required (!).
TOOLS = {
    "find_symbol": "name! repo branch limit",
    "get_symbol": "id! branch",
    "get_callers": "id! depth branch",
    "get_callees": "id! depth branch",
    "get_references": "id! limit branch",
    "get_implementations": "id! limit branch",
    "get_dependencies": "id! limit branch",
    "get_dependents": "id! limit branch",
    "get_branch_context": "repo! branch!",
    "get_change_impact": "id! depth branch",
    "get_code_context": "ids paths depth branch",
    "compare_branch_state": "repo! branch_a! branch_b!",
    "get_deployment_state": "repo! env!",
    "get_implementation_status": "repo! capability! branches!",
    "get_architecture_context": "id! depth branch",
    "get_dependency_analytics": "id mode! depth limit branch",
}
KINDS = {"depth": _DEPTH, "limit": _LIMIT, "ids": _LIST, "paths": _LIST, "branches": _SOME}


def _error(request: Any, code: int, message: str) -> dict:
    return {"jsonrpc": "2.0", "id": request, "error": {"code": code, "message": message}}


def tool_list() -> list[dict]:
    out = []
    for name, text in TOOLS.items():
        params = text.split()
        props = {p.rstrip("!"): KINDS.get(p.rstrip("!"), _TEXT) for p in params}
        about = (getattr(GraphApi, name).__doc__ or name.replace("_", " ")).strip().split("\n")[0]
        out.append({"name": name, "description": about, "inputSchema": {"type": "object", "properties": props, "required": [p[:-1] for p in params if p.endswith("!")]}})
    return out


def arguments(name: str, given: Any) -> dict:
    """The arguments of a tool, checked against its schema; null means not given, what the schema doesn't name is ignored."""
    given = given if isinstance(given, dict) else {}
    out: dict[str, Any] = {}
    for param in TOOLS[name].split():
        key, needed = param.rstrip("!"), param.endswith("!")
        value, kind = given.get(key), KINDS.get(key, _TEXT)
        if value is None:
            if needed:
                raise ValueError(f"missing argument {key}")
            continue
        if kind["type"] == "string" and not isinstance(value, str):
            raise ValueError(f"argument {key} must be a string")
        if kind["type"] == "integer":
            most = 255 if key == "depth" else 2**32 - 1
            if isinstance(value, bool) or not isinstance(value, int) or not 0 <= value <= most:
                raise ValueError(f"argument {key} must be an integer from 0 to {most}")
        if kind["type"] == "array" and (not isinstance(value, list) or not all(isinstance(x, str) for x in value) or (kind is _SOME and not value)):
            raise ValueError(f"argument {key} must be an array of strings{', not empty' if kind is _SOME else ''}")
        out[key] = value
    return out


def _plain(value: Any, most: int) -> Any:
    if isinstance(value, DataFrame):
        return [r.asDict(recursive=True) for r in value.limit(most).collect()]  # never more than the budget's largest answer
    if isinstance(value, GraphResult):
        origin = value.provenance()
        return {"data": _plain(value.rows, most), **{k: _plain(v, most) for k, v in value.parts.items()}, "provenance": [] if origin is None else _plain(origin, most), "truncated": value.truncated}
    if isinstance(value, dict):
        return {k: _plain(v, most) for k, v in value.items()}
    return value


def _call(api: GraphApi, name: str, given: Any) -> dict:
    try:
        budget = api.budget
        answer = _plain(getattr(api, name)(**arguments(name, given)), 2 * max(budget.max_results, budget.branch_set_limit))
    except ValueError as e:
        return {"content": [{"type": "text", "text": str(e)}], "isError": True}
    answer = json.loads(json.dumps(answer, default=str))
    return {"content": [{"type": "text", "text": json.dumps(answer)}], "structuredContent": answer, "isError": False}


def handle(api: GraphApi, message: str) -> dict | None:
    """The answer to one message; None for a notification."""
    try:
        request = json.loads(message)
    except ValueError as e:
        return _error(None, -32700, f"parse error: {e}")
    if not isinstance(request, dict):
        return _error(None, -32600, "invalid request: expected object")
    if not isinstance(request.get("method"), str):
        return _error(request.get("id"), -32600, "invalid request: missing method")
    if "id" not in request:
        return None
    ident, method, params = request["id"], request["method"], request.get("params") or {}
    params = params if isinstance(params, dict) else {}
    if method == "initialize":
        said = params.get("protocolVersion")
        result: Any = {"protocolVersion": said if isinstance(said, str) else PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "graphloom", "version": "2"}}
    elif method in ("ping", "notifications/initialized", "notifications/cancelled"):
        result = {}
    elif method == "tools/list":
        result = {"tools": tool_list()}
    elif method == "tools/call":
        name = params.get("name")
        if not isinstance(name, str):
            return _error(ident, -32602, "tools/call requires params.name")
        if name not in TOOLS:
            return _error(ident, -32602, f"unknown tool: {name}")
        result = _call(api, name, params.get("arguments"))
    else:
        return _error(ident, -32601, f"method not found: {method}")
    return {"jsonrpc": "2.0", "id": ident, "result": result}


def serve(api: GraphApi, lines: TextIO = sys.stdin, out: TextIO = sys.stdout) -> None:
    """Answer one message a line until the input ends; blank lines are skipped."""
    for line in lines:
        if line.strip() and (answer := handle(api, line)) is not None:
            out.write(json.dumps(answer) + "\n")
            out.flush()
