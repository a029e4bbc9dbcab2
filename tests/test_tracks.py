"""Tracks from a server on this machine: batches, repeated tries, failed tracks as rows, missing marks."""

from __future__ import annotations

import gzip
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from tidewright.sources import tracks

ASKED: Counter = Counter()
LOCK = threading.Lock()
FILES = {
    "a1": "Time,Solar8000/ART_MBP\n0,80.5\n2,-nan(ind)\n4,\n6,nan\n8,91\n",
    "b2": "Time,HR\n1.5,60\nx,61\n",
    "empty": "Time,HR\n",
    "nothing": "",
    "slow start": "Time,RR\n0,12\n",
    "short": "Time,RR\n5\n",
}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self) -> None:  # noqa: N802
        name = self.path.lstrip("/").replace("%20", " ")
        with LOCK:
            ASKED[name] += 1
            times = ASKED[name]
        if name == "broken" or (name == "slow start" and times < 3):
            self.send_error(503)
        elif name not in FILES:
            self.send_error(404)
        else:
            body = FILES[name].encode()
            body = gzip.compress(body) if name == "b2" else body
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

    def log_message(self, *_: object) -> None:
        pass


@pytest.fixture(scope="module")
def server():
    found = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=found.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{found.server_port}/"
    found.shutdown()


def test_fetched(spark, server):
    """Values of all tracks that can be had; a 404 is asked for once, a 503 as often as allowed; later uses ask for nothing."""
    ASKED.clear()
    names = ["a1", "b2", "empty", "nothing", "slow start", "short", "gone", "broken"]
    listed = spark.createDataFrame([(k, f"n{k}, \"q\"", t) for k, t in enumerate(names)] + [(0, "n0, \"q\"", "a1"), (None, None, "b2")], "caseid int, tname string, tid string")
    values, failed = tracks.fetched(spark, listed, server, batch=3, tries=3, wait=0.01, timeout=10)
    assert values.rdd.getNumPartitions() >= 1 and values.columns == ["caseid", "tname", "tid", "t", "v"]
    got = {(x["caseid"], x["tid"], x["t"], x["v"]) for x in values.collect()}
    assert got == {
        (0, "a1", 0.0, 80.5), (0, "a1", 2.0, None), (0, "a1", 4.0, None), (0, "a1", 6.0, None), (0, "a1", 8.0, 91.0),
        (1, "b2", 1.5, 60.0), (1, "b2", None, 61.0), (None, "b2", 1.5, 60.0), (None, "b2", None, 61.0), (4, "slow start", 0.0, 12.0), (5, "short", 5.0, None),
    }
    assert {x["tname"] for x in values.where("caseid = 1").collect()} == {'n1, "q"'}
    assert sorted((x["tid"], x["error"]) for x in failed.collect()) == [("broken", "status 503"), ("gone", "status 404")]
    assert (ASKED["gone"], ASKED["broken"], ASKED["slow start"], ASKED["a1"]) == (1, 3, 3, 1)


def test_no_server_and_no_tracks(spark):
    listed = spark.createDataFrame([(1, "HR", "x")], "caseid int, tname string, tid string")
    values, failed = tracks.fetched(spark, listed, "http://127.0.0.1:9/", tries=2, wait=0.01, timeout=2)
    assert values.count() == 0 and failed.count() == 1 and failed.first()["error"]
    values, failed = tracks.fetched(spark, listed.limit(0), "http://127.0.0.1:9/")
    assert values.count() == 0 and failed.count() == 0


def test_partitions():
    reader = tracks.TracksReader({"url": "u", "tracks": "1,a,x\n2,b,y\n3,c,z\n", "batch": "2"})
    assert [len(p.tracks) for p in reader.partitions()] == [2, 1]
