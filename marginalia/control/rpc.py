"""The tool protocol over JSON-RPC 2.0: initialize, ping, tools/list, tools/call."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from marginalia.control.access import MOST_BATCH

#: Versions of the protocol that are understood (fixed values), the newest first.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
PARSE, REQUEST, METHOD, PARAMS, INTERNAL = -32700, -32600, -32601, -32602, -32603


@dataclass
class Tool:
    name: str
    description: str
    schema: dict
    run: Callable[[dict], str]


@dataclass
class Server:
    name: str = "marginalia"
    version: str = "0.1.0"
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def answer(self, message: Any) -> Any:
        """The reply to one message or a batch of them; None where none is due."""
        if isinstance(message, list):
            if not message or len(message) > MOST_BATCH:
                return _error(None, REQUEST, "empty or too large a batch")
            return [r for r in map(self._one, message) if r is not None] or None
        return self._one(message)

    def _one(self, m: Any) -> dict | None:
        if not isinstance(m, dict) or m.get("jsonrpc") != "2.0" or not isinstance(m.get("method"), str):
            return _error(m.get("id") if isinstance(m, dict) else None, REQUEST, "not a request")
        if "id" not in m:
            return None
        try:
            return {"jsonrpc": "2.0", "id": m["id"], "result": self._call(m["method"], m.get("params") or {})}
        except LookupError as x:
            return _error(m["id"], METHOD, str(x.args[0]))
        except (TypeError, ValueError) as x:
            return _error(m["id"], PARAMS, str(x))
        except Exception:
            return _error(m["id"], INTERNAL, "internal error")

    def _call(self, method: str, params: dict) -> dict:
        if method == "initialize":
            asked = params.get("protocolVersion")
            return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": self.name, "version": self.version}}
        if method == "ping":
            return {}
        if method == "tools/list":
            return {"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema} for t in self.tools.values()]}
        if method == "tools/call":
            tool = self.tools.get(str(params.get("name")))
            if tool is None:
                raise ValueError(f"unknown tool: {params.get('name')}")
            try:
                return {"content": [{"type": "text", "text": tool.run(params.get("arguments") or {})}], "isError": False}
            except ValueError as x:
                return {"content": [{"type": "text", "text": str(x)}], "isError": True}
        raise LookupError(f"unknown method: {method}")


def _error(i: Any, code: int, text: str) -> dict:
    return {"jsonrpc": "2.0", "id": i, "error": {"code": code, "message": text}}
