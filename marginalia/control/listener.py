"""The HTTP listener of the tool server: loopback only, one request a message or batch of messages."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from marginalia.control import access
from marginalia.control.rpc import PARSE, Server


def listener(server: Server, token: str, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A listener that is bound and not yet serving (``serve_forever``); port 0 takes a free one."""
    if not access.is_loopback(host) or (port and not access.valid_bind(host, port)):
        raise ValueError("only loopback addresses are served")

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, status: int, body: object = None) -> None:
            data = b"" if body is None else json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _any(self) -> None:
            length = self.headers.get("Content-Length", "")
            size = int(length) if length.isdigit() else 0
            status = access.refusal(self.command, dict(self.headers.items()), size, token)
            if status:
                self.close_connection = True
                return self._answer(status)
            try:
                message = json.loads(self.rfile.read(size))
            except ValueError:
                return self._answer(200, {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}})
            reply = server.answer(message)
            return self._answer(202) if reply is None else self._answer(200, reply)

        do_GET = do_POST = do_PUT = do_DELETE = do_PATCH = do_OPTIONS = do_HEAD = _any

        def log_message(self, *args: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
