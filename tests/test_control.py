"""Paths, settings, access, protocol, embedding answers."""

import pytest

from marginalia.control import access, paths, rpc, settings
from marginalia.operators import embed


def test_paths():
    assert paths.normal("a//b/./c/../d.md") == "a/b/d.md" and paths.join("a", "", "b/c") == "a/b/c"
    for bad in ("/etc", "C:\\x", "\\\\server\\x", "a/../../b", "a\x00b"):
        with pytest.raises(paths.UnsafePath):
            paths.normal(bad)
    assert paths.inside("a/b", "a") and not paths.inside("ab", "a") and not paths.inside("../a", "a")
    assert paths.resolve("root", "x.md") == "root/x.md"
    with pytest.raises(paths.UnsafePath):
        paths.resolve("root", "../x")


def test_settings():
    s = settings.Settings.read({"root": "M", "port": "x", "batch_size": 9999, "include_folders": ["a", 3, " "], "embedding_key": "k", "retrieval_mode": "odd", "direct_writes": 1})
    assert (s.root, s.port, s.batch_size, s.include_folders, s.retrieval_mode, s.direct_writes) == ("M", 7331, 512, ["a"], "lexical", False)
    assert s.backup()["embedding_key"] == "[redacted]" and settings.Settings.read(None) == settings.Settings()
    assert settings.what_changed(settings.Settings(), settings.Settings(root="x", exclude_tags=["t"])) == {"root", "scan"}
    assert settings.entries("a, b\nc,,") == ["a", "b", "c"]


def test_access():
    ok = {"Host": "localhost:1", "Content-Type": "application/json; charset=utf-8", "Authorization": "Bearer t"}
    assert access.refusal("POST", ok, 10, "t") is None
    assert access.refusal("GET", {}, 10, "t") == 405
    assert access.refusal("POST", ok | {"Host": "evil.example"}, 10, "t") == 403
    assert access.refusal("POST", ok | {"Origin": "https://evil.example"}, 10, "t") == 403
    assert access.refusal("POST", ok | {"Content-Type": "text/plain"}, 10, "t") == 415
    assert access.refusal("POST", ok, 10, "u") == 401 and access.refusal("POST", ok, 10, "") == 401
    assert access.refusal("POST", ok, 2 << 20, "t") == 413
    assert access.valid_bind("127.0.0.1", 80) and access.valid_bind("[::1]", 80) and not access.valid_bind("0.0.0.0", 80)


def test_protocol():
    server = rpc.Server()

    def run(args):
        if "x" not in args:
            raise ValueError("x is missing")
        return str(args["x"])

    server.add(rpc.Tool("echo", "says x", {"type": "object"}, run))

    def ask(method, params=None, **more):
        return server.answer({"jsonrpc": "2.0", "id": 1, "method": method, "params": params or {}} | more)

    assert ask("initialize", {"protocolVersion": "2024-11-05"})["result"]["protocolVersion"] == "2024-11-05"
    assert ask("ping")["result"] == {} and ask("tools/list")["result"]["tools"][0]["name"] == "echo"
    assert ask("tools/call", {"name": "echo", "arguments": {"x": 5}})["result"]["content"][0]["text"] == "5"
    assert ask("tools/call", {"name": "echo"})["result"]["isError"] and ask("tools/call", {"name": "no"})["error"]["code"] == rpc.PARAMS
    assert ask("other")["error"]["code"] == rpc.METHOD and server.answer("x")["error"]["code"] == rpc.REQUEST
    assert server.answer({"jsonrpc": "2.0", "method": "ping"}) is None and server.answer([])["error"]["code"] == rpc.REQUEST
    assert len(server.answer([{"jsonrpc": "2.0", "id": i, "method": "ping"} for i in range(3)])) == 3


def test_embedding_answers(spark):
    assert embed.in_order([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    for bad in ([[1.0]], [[1.0], [1.0, 2.0]], [[1.0], [float("nan")]], [[], []], [[1.0], ["x"]]):
        with pytest.raises(ValueError):
            embed.checked(bad, 2)
    df = spark.createDataFrame([("a", "hello"), ("b", None), ("c", "x")], "chunk_id string, text string")
    got = {r["chunk_id"]: r["v"] for r in embed.embedded(df, lambda texts: [[float(len(t)), 1.0] for t in texts], 1).collect()}
    assert got == {"a": [5.0, 1.0], "c": [1.0, 1.0]}
    v = {r["chunk_id"]: r["v"] for r in embed.hashed_words(df, "chunk_id", "text").collect()}
    assert sum(x * x for x in v["a"]) == pytest.approx(1) and v["c"] == [0.0] * 64
    assert embed.identity("p", "m", "e", "k") != embed.identity("p", "m", "e", "other")
