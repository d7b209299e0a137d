"""The REST reader's schedule, failures and filters, against a local server's log."""

import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from vitalgrain.sources import drug_classes


@pytest.fixture
def server():
    log = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            log.append((time.time(), self.path))
            self.send_response(500 if self.path.startswith("/bad") else 200)
            self.end_headers()
            self.wfile.write(b"x" + self.path.encode())

        def log_message(self, *_):
            pass

    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}", log
    found.shutdown()


def test_many_tasks_keep_one_pace(spark, server):
    base, log = server
    urls = [f"{base}/{i}" for i in range(24)] + [f"{base}/bad"]
    df = drug_classes.rest(spark, urls, delay=0.15, retries=1, per_host=8)
    assert df.rdd.getNumPartitions() == 8
    got = {r.url: r.body for r in df.collect()}
    assert got == {u: None if u.endswith("bad") else f"x/{u.rpartition('/')[2]}" for u in urls}
    times = sorted(t for t, _ in log)
    assert len(times) == 26 and times[-1] - times[0] > 0.15 * 24
    for a, b in zip(times, times[8:]):  # no burst, whatever a machine's pauses
        assert b - a > 0.15 * 6


def test_filters_reach_the_source(spark, server):
    base, log = server
    df = drug_classes.rest(spark, [f"{base}/{i}" for i in range(9)], delay=0.0)
    assert [r.body for r in df.where(F.col("url") == f"{base}/3").collect()] == ["x/3"] and len(log) == 1
    assert sorted(r.body for r in df.where(F.col("url").isin(f"{base}/1", f"{base}/2", "http://elsewhere/")).collect()) == ["x/1", "x/2"] and len(log) == 3
    assert df.where(F.col("url") == "nothing").count() == 0 and len(log) == 3
