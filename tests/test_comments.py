"""The comment sink against a server of its own: one comment for a pull request, whatever was repeated, lost or made twice."""

import json
import re
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from ripple.plans import report
from ripple.sources import comments


class Service:
    """Comments by pull request, in memory; ``lose`` requests are carried out, but answered with an error."""

    def __init__(self):
        self.kept, self.last, self.lose, self.lock = {}, 0, 0, threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def _answer(self):
                assert self.headers["Authorization"] == "Bearer secret"
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or "null")
                code, out = service.handle(self.command, self.path, body)
                data = json.dumps(out).encode()
                self.send_response(code)
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = do_PATCH = do_DELETE = _answer

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.api = f"http://127.0.0.1:{self.server.server_port}"

    def handle(self, method, path, body):
        with self.lock:
            if m := re.match(r"/repos/(.+)/issues/(\d+)/comments", path):
                mine = self.kept.setdefault((m[1], int(m[2])), {})
                if method == "GET":
                    page = int(re.search(r"&page=(\d+)", path)[1])
                    return 200, [{"id": k, "body": v} for k, v in sorted(mine.items())][100 * (page - 1) : 100 * page]
                self.last += 1
                mine[self.last] = body["body"]
                if self.lose:
                    self.lose -= 1
                    return 500, None
                return 200, {"id": self.last}
            k = int(path.rpartition("/")[2])
            mine = next((x for x in self.kept.values() if k in x), None)
            if mine is None:
                return 404, None
            if method == "DELETE":
                del mine[k]
            else:
                mine[k] = body["body"]
            return 200, None

    def marked(self):
        return {pull: [v for v in x.values() if report.MARKER in v] for pull, x in self.kept.items()}


@pytest.fixture
def service():
    s = Service()
    yield s
    s.server.shutdown()


def rows(spark, text, pulls=6):
    return spark.createDataFrame([("o/r", k, f"{text} {k}") for k in range(pulls)] + [("o/r", 1, None)], comments.SCHEMA).repartition(3)


def test_one_comment(spark, service):
    for k in range(250):  # the marker may be on any page
        service.handle("POST", "/repos/o/r/issues/2/comments", {"body": f"talk {k}"})
    for text in ("first", "second", "second"):
        comments.write(rows(spark, text), service.api, "secret")
        got = service.marked()
        assert set(got) == {("o/r", k) for k in range(6)} and all(len(v) == 1 and f"{text} {k}" in v[0] for (_, k), v in got.items())
    assert len(service.kept["o/r", 2]) == 251


def test_lost_answer(spark, service):
    """A task that fails after its comment was made fails the job; the next run leaves one comment, and so does one after attempts side by side."""
    service.lose = 1
    with pytest.raises(Exception, match="500"):
        comments.write(rows(spark, "lost"), service.api, "secret")
    assert sum(map(len, service.marked().values())) >= 1
    service.handle("POST", "/repos/o/r/issues/4/comments", {"body": report.pull_request_comment("by another attempt")})
    comments.write(rows(spark, "kept"), service.api, "secret")
    assert all(len(v) == 1 and f"kept {k}" in v[0] for (_, k), v in service.marked().items())


def test_last_of_several(spark, service):
    df = spark.createDataFrame([("o/r", 1, "a"), ("o/r", 1, "b"), (None, 1, "c")], comments.SCHEMA)
    comments.write(df, service.api, "secret")
    (only,) = service.marked()["o/r", 1]
    assert "\nb\n" in only and set(service.kept) == {("o/r", 1)}
