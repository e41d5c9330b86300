"""Who may talk to the tool server: loopback only, own host names, one bearer token compared in constant time."""

from __future__ import annotations

import hmac
import ipaddress
from collections.abc import Mapping
from urllib.parse import urlsplit

MOST_BODY, MOST_BATCH = 1 << 20, 32


def is_loopback(host: str) -> bool:
    name = host.strip().strip("[]").lower()
    try:
        return name == "localhost" or ipaddress.ip_address(name).is_loopback
    except ValueError:
        return False


def valid_bind(host: str, port: int) -> bool:
    return is_loopback(host) and isinstance(port, int) and 1 <= port <= 65535


def host_of(value: str) -> str:
    return urlsplit(f"//{value}").hostname or ""


def refusal(method: str, headers: Mapping[str, str], length: int, token: str) -> int | None:
    """The status with which a request is refused, None if it may pass. Checked in the order 405, 403, 415, 401, 413."""
    h = {k.lower(): v for k, v in headers.items()}
    if method != "POST":
        return 405
    origin = h.get("origin")
    if not is_loopback(host_of(h.get("host", ""))) or (origin and not is_loopback(urlsplit(origin).hostname or "")):
        return 403
    if h.get("content-type", "").split(";")[0].strip().lower() != "application/json":
        return 415
    kind, _, given = h.get("authorization", "").partition(" ")
    if kind.lower() != "bearer" or not token or not hmac.compare_digest(given.strip().encode(), token.encode()):
        return 401
    return 413 if length > MOST_BODY else None
