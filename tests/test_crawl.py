"""Nested sitemap indexes from a local server."""

from __future__ import annotations

import threading
import time
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from daybreak.sources import crawl


def index(*urls):
    return f"<sitemapindex xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>{''.join(f'<sitemap><loc>{u}</loc></sitemap>' for u in urls)}</sitemapindex>"


def pages(*urls):
    return f"<urlset>{''.join(f'<url><loc> {u} </loc></url>' for u in urls)}</urlset>"


@pytest.fixture
def server():
    asked, times = Counter(), []

    class Maps(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            times.append(time.monotonic())
            body = self.server.maps.get(self.path)
            if body is None or self.path == "/flaky" and asked[self.path] == 1:
                self.send_error(404 if body is None else 503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    running = ThreadingHTTPServer(("127.0.0.1", 0), Maps)
    running.base = f"http://127.0.0.1:{running.server_port}"
    running.asked, running.times = asked, times
    threading.Thread(target=running.serve_forever, daemon=True).start()
    yield running
    running.shutdown()


def test_nested_maps_are_read_once_and_in_document_order(spark, server):
    b = server.base
    server.maps = {
        "/root": index(f"{b}/a", f"{b}/deep", f"{b}/flaky", f"{b}/gone", f"{b}/broken", f"{b}/root"),
        "/a": pages("https://x.example/1", "https://x.example/2"),
        "/deep": index(f"{b}/b", f"{b}/a", f"{b}/deep"),
        "/b": pages("https://x.example/3"),
        "/flaky": pages("https://x.example/4"),
        "/broken": "<urlset",
        "/flat": pages(*(f"https://y.example/{k}" for k in range(30))),
        "/big": index(f"{b}/flat", f"{b}/never"),
        "/never": index(f"{b}/never2"),
        "/never2": pages("https://z.example/"),
    }
    roots = spark.createDataFrame([("one", f"{b}/root"), ("two", f"{b}/flat"), ("three", f"{b}/root"), ("four", f"{b}/big"), ("five", f"{b}/missing")], "source string, url string")
    out = crawl.crawl_sitemaps(roots)
    got = {}
    for r in sorted(out.pages.collect(), key=lambda r: (r.source, r.pos)):
        got.setdefault(r.source, []).append(r.url)
    assert got["one"] == got["three"] == [f"https://x.example/{k}" for k in (1, 2, 3, 4)]
    assert got["two"] == got["four"] == [f"https://y.example/{k}" for k in range(20)] and "five" not in got
    errors = {r.url.removeprefix(b): r.error for r in out.visited.collect()}
    assert len(errors) == out.visited.count() and errors["/flaky"] is None and "404" in errors["/gone"] and "404" in errors["/missing"]
    assert server.asked["/never2"] == 0 and {server.asked[p] for p in ("/root", "/a", "/deep", "/b", "/flat", "/broken")} == {1} and server.asked["/flaky"] == 2


def test_a_host_is_asked_with_pauses(spark, server):
    server.maps = {f"/{k}": pages() for k in range(4)}
    rows = crawl.polite(spark.createDataFrame([(f"{server.base}/{k}",) for k in range(4)], "url string").repartition(4), pause=0.3).collect()
    assert len(rows) == 4 and all(r.error is None for r in rows)
    assert all(b - a >= 0.28 for a, b in zip(server.times, server.times[1:]))


def test_no_roots(spark):
    out = crawl.crawl_sitemaps(spark.createDataFrame([], "source string, url string"))
    assert out.pages.count() == 0 and out.rounds == 0
