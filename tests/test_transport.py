import io
import json
import threading
import urllib.error
import urllib.request
from types import SimpleNamespace

import pytest

from lodeframe.plans import cli
from lodeframe.plans import transport as t
from lodeframe.plans.service import Cache
from lodeframe.sources import binder


class Fake:
    cache = Cache()
    registry = SimpleNamespace(get=lambda name: SimpleNamespace(project_id=name))

    def context(self, args):
        if not args.get("project_id"):
            raise ValueError("project_id is required")
        return {"functional_context": {"assembled_context": "café"}, "results": []}

    def list_projects(self):
        return {"projects": []}

    def readiness(self):
        return {"status": "ready"}

    def snapshot(self, args, folder):
        return f"{folder.name}:{args['part']}"


def call(name, id_=7, **args):
    return {"jsonrpc": "2.0", "id": id_, "method": "tools/call", "params": {"name": name, "arguments": args}}


@pytest.fixture
def dispatcher():
    return t.Dispatcher(Fake())


def text(answer):
    return answer["result"]["content"][0]["text"]


def test_answers(dispatcher):
    assert text(dispatcher.answer(call("rag_context", project_id="p"))) == "café"
    assert json.loads(text(dispatcher.answer(call("rag_context", project_id="p", format="json"))))["results"] == []
    assert json.loads(text(dispatcher.answer(call("list_projects")))) == {"projects": []}
    assert text(dispatcher.answer(call("get_project_snapshot", project_id="p", part="index"))) == "p:index"
    assert dispatcher.answer(call("rag_context"))["error"] == {"code": -32000, "message": "project_id is required"}
    assert dispatcher.answer(call("other"))["error"]["code"] == -32000
    assert dispatcher.answer([])["error"]["code"] == -32600
    assert dispatcher.answer({"id": 1, "method": "other"})["error"]["code"] == -32601
    assert dispatcher.answer({"method": "initialized"}) is None
    listed = dispatcher.answer({"id": 1, "method": "tools/list"})["result"]["tools"]
    assert [x["name"] for x in listed] == list(t.TOOLS) and len(listed) == 9
    assert dispatcher.answer({"id": 0, "method": "shutdown"}) == {"jsonrpc": "2.0", "id": 0, "result": None}


def test_every_tool_is_a_method_of_the_service():
    assert all(callable(getattr(t.Service, method)) for method, *_ in t.TOOLS.values())


@pytest.mark.parametrize("headers", [False, True])
def test_stdio(dispatcher, headers):
    bodies = [json.dumps(call("rag_context", project_id="p")).encode(), b'{"method": "initialized"}', b"{broken", b'{"id": 2, "method": "ping"}']
    sent = b"".join(b"Content-Length: %d\r\nOther: x\r\n\r\n%s" % (len(b), b) for b in bodies) if headers else b"\n".join([*bodies[:2], b"  ", *bodies[2:]])
    out = io.BytesIO()
    t.serve_stdio(dispatcher, io.BytesIO(sent), out, headers)
    out.seek(0)
    got = [json.loads(b) for b in (t.framed if headers else t.lines)(out)]
    assert [x["id"] for x in got] == [7, None, 2] and text(got[0]) == "café" and got[1]["error"]["code"] == -32700


@pytest.fixture
def url(dispatcher):
    served = t.server(dispatcher, port=0, token="secret", most=500, wait=0.05)
    threading.Thread(target=served.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{served.server_address[1]}"
    served.shutdown()
    served.server_close()


def send(url, body=None, method=None, **headers):
    data = body if body is None or isinstance(body, bytes) else json.dumps(body).encode()
    headers = {"Authorization": "Bearer secret"} | headers
    try:
        with urllib.request.urlopen(urllib.request.Request(url, data, headers, method=method), timeout=10) as r:
            got = r.read()
            return r.status, json.loads(got) if got else None
    except urllib.error.HTTPError as e:
        return e.code, None


def test_http(url):
    assert send(f"{url}/health") == (200, {"status": "ready", "query_cache": {"entries": 0, "max_entries": 500, "ttl_seconds": 1800}})
    assert text(send(f"{url}/rpc", call("rag_context", project_id="p"))[1]) == "café"
    assert text(send(f"{url}/rpc", {"query_text": "q", "project_id": "p"})[1]) == "café"
    assert text(send(f"{url}/mcp", call("rag_context", project_id="p"))[1]) == "café"
    assert send(f"{url}/rpc", {"method": "initialized"})[0] == 204 and send(f"{url}/mcp", {"method": "initialized"})[0] == 202
    for body in (b"{", {"top_k": True}, {"top_k": "1"}, {"odd": 1}, {"method": 3}, [1]):
        assert send(f"{url}/rpc", body)[0] == 400
    assert send(f"{url}/rpc", {"query_text": "x" * 600})[0] == 413
    assert send(f"{url}/mcp", method="DELETE")[0] == 200 and send(f"{url}/mcp")[0] == 405 and send(f"{url}/none")[0] == 404


def test_http_guards(url, dispatcher):
    assert send(f"{url}/health", Authorization="Bearer other")[0] == 401
    assert send(f"{url}/mcp", {"id": 1, "method": "ping"}, Host="evil.test")[0] == 403
    assert send(f"{url}/mcp", {"id": 1, "method": "ping"}, Origin="http://evil.test")[0] == 403
    assert send(f"{url}/mcp", {"id": 1, "method": "ping"}, Origin="http://localhost:3000")[0] == 200
    with pytest.raises(ValueError):
        t.server(dispatcher, host="0.0.0.0", port=0)


def test_event_stream(url):
    with urllib.request.urlopen(urllib.request.Request(f"{url}/sse", headers={"Authorization": "Bearer secret"}), timeout=10) as r:
        assert r.readline() == b"event: endpoint\n"
        feed = r.readline().decode().split(" ", 1)[1].strip()
        assert send(feed, {"id": 5, "method": "ping"})[0] == 202
        line = next(x for x in iter(r.readline, b"") if x.startswith(b"data: {"))
        assert json.loads(line[6:])["id"] == 5
    assert send(f"{url}/message?session_id=none", {"id": 5, "method": "ping"})[0] == 400


def test_proxy(url):
    out = io.BytesIO()
    sent = b'{"id": 1, "method": "ping"}\n{"method": "initialized"}\n'
    t.proxy(io.BytesIO(sent), out, f"{url}/rpc", "secret")
    t.proxy(io.BytesIO(sent), out, "http://127.0.0.1:9/rpc")
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [x["id"] for x in got] == [1, 1] and "result" in got[0] and got[1]["error"]["code"] == -32000


def test_numbered_placeholders():
    assert binder.bound("a = @Valore1 AND b = @Valore0 OR c = @Valore1", [5, "x"]) == ("a = :valore1 AND b = :valore0 OR c = :valore1", {"valore0": 5, "valore1": "x"})
    assert binder.bound("SELECT 1", []) == ("SELECT 1", {})
    for statement, values in (("@Valore1", [1]), ("@Valore0", []), ("SELECT 1", [1]), ("@Valore0 @Valore2", [1, 2])):
        with pytest.raises(ValueError):
            binder.bound(statement, values)


def test_placeholders_run(spark):
    rows = binder.run(spark, "SELECT @Valore0 AS a, @Valore1 + @Valore1 AS b", ["it's -- x", 2]).collect()
    assert [tuple(r) for r in rows] == [("it's -- x", 4)]


def test_command_line(monkeypatch, spark, tmp_path, url):
    out = io.BytesIO()
    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(b'{"id": 1, "method": "ping"}\n')))
    monkeypatch.setattr("sys.stdout", SimpleNamespace(buffer=out, write=lambda _: None, flush=lambda: None))
    monkeypatch.setenv("LODEFRAME_TOKEN", "secret")
    assert cli.main(["proxy", "--url", f"{url}/rpc"]) == 0
    monkeypatch.setattr("sys.stdin", SimpleNamespace(buffer=io.BytesIO(b'{"id": 2, "method": "tools/list"}\n')))
    assert cli.main(["--store", str(tmp_path), "serve-stdio"], spark) == 0
    assert [json.loads(x)["id"] for x in out.getvalue().splitlines()] == [1, 2]
