import json
import socketserver
import threading

import pytest
from flows import line

from flowsieve.plans import session
from flowsieve.sources import capture, relay
from flowsieve.streaming import live


class Server(socketserver.ThreadingTCPServer):
    """A relay that holds events a node, filters them, notes what it is asked, and can break connections."""

    allow_reuse_address, daemon_threads = True, True

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.nodes, self.gone, self.asked, self.break_after = [[], []], [0, 0], [], None
        self.sent = []
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def address(self):
        return f"127.0.0.1:{self.server_address[1]}"

    def add(self, node, *lines):
        self.nodes[node] += [json.loads(x) for x in lines]


def meets(event, f):
    flow = event["flow"]
    space = lambda side: (flow.get(side) or {}).get("namespace")
    return all((k == "verdict" and flow["verdict"] in v) or (k != "verdict" and space(k.split("_")[0]) in v) for k, v in f.items())


class Handler(socketserver.StreamRequestHandler):
    def handle(self):
        s, asked = self.server, json.loads(self.rfile.readline())
        s.asked.append(asked)
        say = lambda x: self.wfile.write(json.dumps(x).encode() + b"\n")
        if asked["ask"] == "ends":
            return say({"begins": s.gone, "ends": [len(n) for n in s.nodes]})
        for i in range(asked["from"], asked["to"]):
            event = s.nodes[asked["node"]][i]
            if "flow" not in event or not asked["filters"] or any(meets(event, f) for f in asked["filters"]):
                if s.break_after is not None and len(s.sent) >= s.break_after:
                    s.break_after = None
                    return None  # the connection ends in the middle of the answer
                s.sent.append(i)
                say({"at": i, "event": event})
        return say({"done": asked["to"]})


@pytest.fixture
def server():
    made = Server()
    yield made
    made.shutdown()
    made.server_close()


def places(df):
    return sorted((r["node"], r["position"]) for r in df.collect())


def test_batch_filters_at_the_source(spark, server):
    server.add(0, line(0), line(1, verdict="FORWARDED"), line(2, own_ns="x", peer_ns="y"), '{"lost_events":{"num_events_lost":4}}')
    server.add(1, line(3, own_ns="z", peer_ns="prod"))
    assert places(relay.read(spark, server.address)) == [(0, 0), (0, 2), (0, 3), (1, 0)]
    server.asked.clear()
    rows = relay.read(spark, server.address, ["prod"])
    assert places(rows) == [(0, 0), (0, 3), (1, 0)]
    asked = [a for a in server.asked if a["ask"] == "read"]
    assert asked[0]["filters"] == [{"verdict": ["DROPPED"], "source_namespaces": ["prod"]}, {"verdict": ["DROPPED"], "destination_namespaces": ["prod"]}]
    parsed = capture.parse(capture.numbered(rows))
    assert capture.flows(parsed).count() == 2 and capture.lost_events(parsed).first()[0] == 4


def test_predicates_are_pushed_to_the_relay(spark, server):
    server.add(0, line(0), line(1, own_ns="other"), line(2, verdict="FORWARDED"))
    server.add(1, line(3))
    rows = relay.read(spark, server.address, verdicts="").filter("verdict = 'DROPPED' and destination_namespace in ('prod', 'q') and node = 0")
    assert places(rows) == [(0, 0)]
    read = [a for a in server.asked if a["ask"] == "read"]
    assert {a["node"] for a in read} == {0} and read[-1]["filters"] == [{"verdict": ["DROPPED"], "destination_namespaces": ["prod", "q"]}]
    assert server.sent == [0]


def test_a_broken_connection_is_taken_up_again(server):
    server.add(0, *[line(i) for i in range(20)])
    server.break_after = 7
    got = [at for at, _ in relay.Client(server.address).read(0, 0, 20, [])]
    assert got == list(range(20))
    reads = [a["from"] for a in server.asked]
    assert reads == [0, 7]


def test_a_relay_that_is_not_there():
    with pytest.raises(ConnectionError, match="doesn't answer"):
        relay.Client("127.0.0.1:1", 0.2, 1).ends()
    with pytest.raises(ValueError, match="host:port"):
        relay.Client("nowhere")


def follow(spark, server, place, **options):
    """What a stream gives from its checkpoint on until all is through."""
    got = []
    query = relay.stream(spark, server.address, **options).writeStream.foreachBatch(lambda df, n: got.append((n, places(df)))).option("checkpointLocation", str(place / "ck")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return got


def test_stream_goes_on_from_its_checkpoint(spark, server, tmp_path):
    server.add(0, line(0), line(1, verdict="FORWARDED"), line(2))
    server.add(1, line(3))
    first = follow(spark, server, tmp_path)
    assert sorted(x for _, rows in first for x in rows) == [(0, 0), (0, 2), (1, 0)]
    server.add(0, line(4))
    server.add(1, line(5), line(6))
    second = follow(spark, server, tmp_path)
    assert sorted(x for _, rows in second for x in rows) == [(0, 3), (1, 1), (1, 2)] and min(n for n, _ in second) > max(n for n, _ in first)
    assert follow(spark, server, tmp_path) == []


def test_what_the_buffer_lost_is_counted(spark, server, tmp_path):
    server.add(0, line(0), line(1))
    follow(spark, server, tmp_path)
    server.add(0, line(2), line(3), line(4))
    server.gone = [4, 0]
    rows = []
    query = relay.stream(spark, server.address).writeStream.foreachBatch(lambda df, n: rows.extend(capture.lost_events(capture.parse(df)).collect())).option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sum(r[0] for r in rows) == 2


def test_policies_from_a_relay(spark, server, tmp_path):
    server.add(0, line(0), line(1, port=8443), line(2, own_ns="x", own=["k8s:app=other"]))
    server.add(1, line(3, port=9090))
    options = session.Options(str(tmp_path / "out"), str(tmp_path / "ev"))
    results = []
    rows = relay.stream(spark, server.address, ["default"], starting="earliest")
    query = live.start(rows, options, str(tmp_path / "ck"), "1 second", results)
    try:
        query.processAllAvailable()
        server.add(0, line(5, port=1234))
        query.processAllAvailable()
    finally:
        query.stop()
    text = (tmp_path / "out/prod/server.yaml").read_text()
    assert all(f'port: "{p}"' in text for p in (8080, 8443, 9090, 1234))
    assert results[-1].stats["lines_read"] == 1 and sum(r.stats["flows_seen"] for r in results) == 5


def test_events_are_numbered_by_node_and_place(spark, server):
    server.add(0, line(0), line(1))
    server.add(1, line(2), line(3, verdict="FORWARDED"), line(4))
    rows = capture.numbered(relay.read(spark, server.address).repartition(3)).collect()
    assert sorted((r["seq"], json.loads(r["value"])["flow"]["time"][17:19]) for r in rows) == [(i, t) for i, t in enumerate(["00", "01", "02", "04"])]
