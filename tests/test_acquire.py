import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from lexgrid.sources import acquire
from lexgrid.sources.cursors import SparseCursor, place

DATA = bytes(range(256)) * 40


@pytest.fixture
def server():
    asked, failures = [], {"/flaky": 2}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers.get("Range")))
            if failures.get(self.path, 0):
                failures[self.path] -= 1
                self.send_response(503)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            if self.path == "/gone":
                self.send_error(404)
                return
            body, code = DATA, 200
            if bounds := self.headers.get("Range"):
                first, _, last = bounds.removeprefix("bytes=").partition("-")
                body, code = DATA[int(first) : int(last) + 1 if last else None], 206
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def part(url, name, **more):
    return acquire.Part(name, f"{url}/{name}", len(DATA), hashlib.sha256(DATA).hexdigest(), **more)


def test_resume_retry_and_reuse(server, tmp_path):
    url, asked = server
    (tmp_path / "a.part").write_bytes(DATA[:100])
    acquire.download(part(url, "a"), str(tmp_path / "a"))
    assert (tmp_path / "a").read_bytes() == DATA and asked[-1] == ("/a", "bytes=100-")
    waits = []
    acquire.download(part(url, "flaky"), str(tmp_path / "flaky"), waits.append)
    assert waits == [0.0, 0.0] and (tmp_path / "flaky").read_bytes() == DATA
    acquire.download(part(url, "b"), str(tmp_path / "b"), parallel_from=1000)
    assert (tmp_path / "b").read_bytes() == DATA and len({r for p, r in asked if p == "/b"}) == acquire.CONNECTIONS
    reused, fetched = acquire.acquire([part(url, "a"), part(url, "c")], str(tmp_path / "next"), str(tmp_path))
    assert (reused, fetched) == (["a"], ["c"]) and (tmp_path / "next" / "a").read_bytes() == DATA
    assert acquire.acquire([part(url, "a"), part(url, "c")], str(tmp_path / "next")) == (["a", "c"], [])


def test_wrong_digest_and_missing_file(server, tmp_path):
    url, _ = server
    with pytest.raises(ValueError, match="digest"):
        acquire.download(acquire.Part("x", f"{url}/x", len(DATA), "0" * 64), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists() and not (tmp_path / "x.part").exists()
    with pytest.raises(Exception, match="404"):
        acquire.download(part(url, "gone"), str(tmp_path / "gone"))


def test_waits():
    assert [acquire.wait_before(i, None) for i in range(3)] == [0.5, 1.0, 2.0]
    assert acquire.wait_before(0, "7") == 7.0 and acquire.wait_before(0, "900") == 60.0 and acquire.wait_before(20, "x") == 60.0


def test_sparse_cursor():
    c = SparseCursor.parse("", 50)
    c.complete(3)
    c.complete(1)
    assert str(c) == "v1:0:1,3" and c.done == 2
    c = SparseCursor.parse(str(c), 50)
    c.complete(0)
    assert str(c) == "v1:2:3" and c.completed(1) and not c.completed(2)
    c.complete(2)
    assert str(c) == "4" and c.done == 4
    c.complete(40)
    assert str(c) == "v1:4:14" and SparseCursor.parse("v1:4:14", 50).completed(40)
    assert SparseCursor.parse("7", 10).done == 7
    for bad in ("-1", "11", "v1:4:3", "v1:x:4", "v1:2:"):
        with pytest.raises(ValueError):
            SparseCursor.parse(bad, 10)
    assert place("", 2) == (0, 0) and place("f1:1:2:3", 3) == (1, 2, 3)
    with pytest.raises(ValueError):
        place("1:x", 2)
