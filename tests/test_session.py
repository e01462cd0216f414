import json
import os
import shutil
import signal
import subprocess
import sys
import time

import pytest
from flows import dns, http, line

from flowsieve import cli
from flowsieve.operators.rules import ATOM_KEY, RULE
from flowsieve.plans import documents, render, session
from flowsieve.plans.files import Files
from flowsieve.plans.state import FAN, State, bucket
from flowsieve.sources import capture, stored
from flowsieve.streaming import live

LINES = [line(0), line(1, port=8443), line(2, l7=http("GET", "/a.b")), line(3, way="EGRESS", proto="UDP", port=53, peer=["reserved:world"], ip=("", "8.8.8.8"), l7=dns("x.org.")), line(4, reason="FIB_LOOKUP_FAILED")]


@pytest.fixture
def place(tmp_path, spark):
    (tmp_path / "c.jsonl").write_text("\n".join(LINES))
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield tmp_path
    spark.conf.set("spark.sql.shuffle.partitions", width)


def options(place, **more):
    return session.Options(str(place / "out"), str(place / "ev"), **more)


def table(spark, place, kind):
    """A table of the state as it stands."""
    state = State(spark, str(place / "out"))
    (name,) = [n for n in state.now["parts"] if n.split(":")[0] == kind]
    rows = spark.read.parquet(*[f"{p['folder']}/bucket={b}" for p in state.now["parts"][name] for b in p["buckets"]])
    return state.stored(name, rows.schema, RULE if kind == "rules" else ATOM_KEY)


def replay(spark, place, **more):
    return session.run(capture.read_flows(spark, str(place / "c.jsonl")), options(place, **more))


def test_documents(spark, place):
    got = replay(spark, place, l7=True, fail_on_infra_drops=True)
    text = (place / "out/prod/server.yaml").read_text()
    for part in ("kind: CiliumNetworkPolicy", "name: fs-server", 'port: "8080"', "method: GET", r"path: ^/a\.b$", "matchName: x.org", "k8s-app: kube-dns", "  # TCP/8080, TCP/8443 from app=client, io.kubernetes.pod.namespace=default"):
        assert part in text, part
    assert got.exit_code == 1 and "FIB_LOOKUP_FAILED" in got.health
    home = place / "ev" / session.output_hash(str(place / "out"))
    doc = json.loads((home / "prod/server.json").read_text())
    assert doc["schema_version"] == 2 and len(doc["rules"]) == 4 and doc["sessions"][0]["flows_ingested"] == 5
    assert json.loads((home / "cluster-health.json").read_text())["drops"][0]["by_node"] == {"node-1": 1}
    assert stored.read_evidence(spark, str(home / "prod/server.json")).count() == 4


def test_second_run_changes_nothing_but_evidence(spark, place):
    replay(spark, place, l7=True)
    before = (place / "out/prod/server.yaml").read_text()
    got = replay(spark, place, l7=True)
    assert got.written == [] and len(got.unchanged) == 1 and (place / "out/prod/server.yaml").read_text() == before
    home = place / "ev" / session.output_hash(str(place / "out"))
    doc = json.loads((home / "prod/server.json").read_text())
    assert len(doc["sessions"]) == 2 and {r["flow_count"] for r in doc["rules"]} == {2}


def test_dry_run_writes_nothing_and_shows_the_difference(spark, place):
    got = replay(spark, place, dry_run=True)
    assert not (place / "out").exists() and not (place / "ev").exists()
    assert len(got.diffs) == 1 and "+kind: CiliumNetworkPolicy" in got.diffs[0]


def test_merges_into_a_document_of_another_program(spark, place):
    pytest.importorskip("yaml")
    path = place / "out/prod/server.yaml"
    path.parent.mkdir(parents=True)
    path.write_text(
        "apiVersion: cilium.io/v2\nkind: CiliumNetworkPolicy\nmetadata: {name: fs-server, namespace: prod}\nspec:\n  endpointSelector: {matchLabels: {app: server}}\n  ingress:\n"
        "  - fromEndpoints: [{matchLabels: {'k8s:app': client, 'k8s:io.kubernetes.pod.namespace': default}}]\n    toPorts: [{ports: [{port: '1', protocol: TCP}, {port: '8080', protocol: TCP}]}]\n"
        "  - fromEntities: [host]\n    icmps: [{fields: [{family: IPv4, type: 8}]}]\n"
    )
    replay(spark, place)
    text = path.read_text()
    assert text.count("fromEndpoints") == 1 and "fromEntities" in text and "type: 8" in text
    for port in ("1", "8080", "8443"):
        assert text.count(f'port: "{port}"') == 1
    again = replay(spark, place)
    assert again.written == [] and path.read_text() == text


def test_live_policies_are_skipped(spark, place):
    from flowsieve.operators import disposition, rules

    flows = capture.read_flows(spark, str(place / "c.jsonl"))
    atoms = rules.atoms(rules.observations(disposition.dispose(flows), False))
    assert len(session.run(flows, options(place), atoms).skipped) == 1


def test_stream_equals_batch(spark, place):
    folder = place / "in"
    folder.mkdir()
    for i, x in enumerate(LINES):
        (folder / f"{i}.jsonl").write_text(x)
    whole = replay(spark, place, l7=True)
    want = table(spark, place, "rules")
    key = lambda df: sorted((r["rule_key"], r["flow_count"], r["first_seen"], r["last_seen"]) for r in df.collect())
    want, atoms = key(want), sorted(tuple(r)[:11] for r in table(spark, place, "atoms").collect())
    shutil.rmtree(place / "out")
    shutil.rmtree(place / "ev")
    results = []
    query = live.start(capture.stream_lines(spark, str(folder), 3), options(place, l7=True), str(place / "ck"), None, results)
    query.awaitTermination()
    assert len(results) == 2 and whole.written
    assert key(table(spark, place, "rules")) == want
    assert sorted(tuple(r)[:11] for r in table(spark, place, "atoms").collect()) == atoms


def stream(spark, place, folder, checkpoint, texts, **more):
    """Runs a stream over files of so many lines each, one file a batch; its results."""
    (place / folder).mkdir(exist_ok=True)
    for i, x in enumerate(texts):
        path = place / folder / f"{i:03d}.jsonl"
        path.write_text(x)
        os.utime(path, (1_700_000_000 + i,) * 2)  # files come in the order of their times
    results, run = [], session.Session.begin()
    made = options(place, l7=True, **more)
    live.start(capture.stream_lines(spark, str(place / folder), 1), made, str(place / checkpoint), None, results, run).awaitTermination()
    session.finish(spark, run, made)
    return results


def evidence_of(place):
    return json.loads((place / "ev" / session.output_hash(str(place / "out")) / "prod/server.json").read_text())


def test_another_stream_into_the_same_output(spark, place):
    stream(spark, place, "a", "ck1", [line(0), line(1), line(2)])
    stream(spark, place, "b", "ck2", [line(3, port=9999)])
    text = (place / "out/prod/server.yaml").read_text()
    assert 'port: "9999"' in text and 'port: "8080"' in text


def test_a_batch_that_failed_before_its_commit_counts_once(spark, place, monkeypatch):
    from flowsieve.plans.state import State

    commit = State.commit

    def fail(self, *a):
        raise RuntimeError("lost")

    monkeypatch.setattr(State, "commit", fail)
    with pytest.raises(Exception, match="lost"):
        stream(spark, place, "a", "ck", [line(0)])
    monkeypatch.setattr(State, "commit", commit)
    assert len(stream(spark, place, "a", "ck", [])) == 1
    assert [r["flow_count"] for r in evidence_of(place)["rules"]] == [1]
    assert stream(spark, place, "a", "ck", []) == []


def test_flushes_of_a_run_are_one_session(spark, place):
    results = stream(spark, place, "a", "ck", [line(i) for i in range(5)], sessions=3)
    doc = evidence_of(place)
    assert len(results) == 5 and len(doc["sessions"]) == 1 and doc["sessions"][0]["flows_ingested"] == 5
    assert doc["rules"][0]["flow_count"] == 5 and doc["rules"][0]["contributing_sessions"] == [doc["sessions"][0]["id"]]
    assert len(results[0].written) == 1 and all(len(r.skipped) == 1 for r in results[1:])  # equal to what the flush before made


def test_keys_are_new_once_in_the_life_of_a_stream(spark, place):
    odd = line(0, proto=None)
    host = line(1, own=["reserved:host"], own_ns="")
    results = stream(spark, place, "a", "ck", [odd, odd, odd + "\n" + host, host])
    assert [r.stats["keys_first_seen"] for r in results] == [1, 0, 2, 0]
    assert [r.stats["flows_unhandled"] for r in results] == [1, 1, 2, 1]


def test_warnings_are_given_once_in_the_life_of_a_stream(spark, place):
    host, new = line(1, own=["reserved:host"], own_ns=""), line(2, reason="BRAND_NEW")
    results = stream(spark, place, "a", "ck", [host, host + "\n" + new, new])
    assert [[w.split()[-1] if "reserved" in w else w.split()[2] for w in r.warnings] for r in results] == [["reserved:host/INGRESS"], ["BRAND_NEW"], []]
    (place / "a/999.jsonl").write_text(new + "\n" + line(3, reason="NEWER"))
    (again,) = stream(spark, place, "a", "ck", [])  # another run from the same checkpoint
    assert len(again.warnings) == 1 and "NEWER" in again.warnings[0]


def test_a_signal_ends_generate_after_what_has_come(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text(line(0))
    command = ["-m", "flowsieve", "generate", str(folder), "-o", str(tmp_path / "out"), "--evidence-dir", str(tmp_path / "ev"), "--checkpoint", str(tmp_path / "ck"), "--flush-interval", "1 second"]
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.sql.shuffle.partitions=1 --conf spark.ui.enabled=false pyspark-shell"}
    run = subprocess.Popen([sys.executable, *command], env=env, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
    try:
        until = time.time() + 240
        while not (tmp_path / "out/prod/server.yaml").exists() and time.time() < until:
            time.sleep(0.2)
        (folder / "b.jsonl").write_text("\n".join([line(1, port=1234), line(2, port=1234), "odd"]))
        run.send_signal(signal.SIGTERM)
        said, _ = run.communicate(timeout=240)
    finally:
        run.kill()
    assert run.returncode == 0 and 'port: "1234"' in (tmp_path / "out/prod/server.yaml").read_text()
    (home,) = (tmp_path / "ev").iterdir()
    (kept,) = json.loads((home / "prod/server.json").read_text())["sessions"]
    assert kept["flows_ingested"] == 3 and kept["ended_at"] > kept["started_at"]
    told = [json.loads(x) for x in said.splitlines() if x.startswith("{")]
    assert sum(x["lines_read"] for x in told) == 4 and sum(x["malformed"] for x in told) == 1


def test_generate_from_the_command_line(spark, place, capsys):
    folder = place / "in"
    folder.mkdir()
    (folder / "a.jsonl").write_text("\n".join(LINES))
    (folder / "b.jsonl").write_text(line(5, port=1234))
    where = ["generate", str(folder), "-o", str(place / "out"), "--evidence-dir", str(place / "ev"), "--checkpoint", str(place / "ck"), "--once", "--max-files", "1"]
    assert cli.main([*where, "--fail-on-infra-drops"]) == 1
    assert capsys.readouterr().out.count('"policies_written": 1') == 2
    pytest.importorskip("yaml")
    shutil.rmtree(place / "ck")
    (folder / "b.jsonl").unlink()
    shutil.copytree(place / "out", place / "live")
    shutil.rmtree(place / "out")
    (folder / "a.jsonl").write_text("\n".join([*LINES, line(5, port=1234)]))
    assert cli.main([*where, "--cluster-dedup", str(place / "live/prod/server.yaml")]) == 0
    assert '"policies_skipped": 1' in capsys.readouterr().out and not (place / "out/prod").exists()


def test_live_policies_from_documents(spark, place):
    meta = {"name": "fs-server", "namespace": "prod", "labels": {"app.kubernetes.io/managed-by": "flowsieve"}}
    spec = {"ingress": [{"fromEntities": ["host"], "toPorts": [{"ports": [{"port": "1", "protocol": "TCP"}]}]}]}
    other = {"metadata": meta | {"labels": {}, "name": "fs-x"}, "spec": spec}
    (place / "live.json").write_text(json.dumps({"items": [{"metadata": meta, "spec": spec}, other]}))
    rows = stored.live_atoms(spark, str(place / "live.json"), "flowsieve", "fs-").collect()
    assert [(r["namespace"], r["workload"], r["peer_key"], r["port"]) for r in rows] == [("prod", "server", "host", "1")]


def test_of_live_policies_with_equal_names_the_last_counts(spark, place):
    meta = {"name": "fs-server", "namespace": "prod", "labels": {"app.kubernetes.io/managed-by": "flowsieve"}}
    rule = lambda *ports: {"ingress": [{"fromEntities": ["host"], "toPorts": [{"ports": [{"port": p, "protocol": "TCP"} for p in ports]}]}]}
    (place / "live").mkdir()
    files = {"a": [{"metadata": meta, "spec": rule("1")}], "b": [{"metadata": meta, "spec": rule("2")}, {"metadata": meta, "spec": rule("3", "4", "3")}], "c": [{"metadata": meta | {"name": "fs-x"}, "spec": rule("5")}]}
    for name, items in files.items():
        (place / f"live/{name}.json").write_text(json.dumps({"items": items}))
    read = lambda: sorted((r["workload"], r["port"]) for r in stored.live_atoms(spark, str(place / "live/*.json"), "flowsieve", "fs-").collect())
    assert read() == [("server", "3"), ("server", "4"), ("x", "5")]
    (place / "live/d.json").write_text(json.dumps({"metadata": meta, "spec": {"endpointSelector": {}}}))
    assert read() == [("x", "5")]  # the last one allows nothing


def test_documents_are_written_by_tasks(spark, place, monkeypatch):
    write = Files.write

    def state_only(self, path, text):
        assert not path.endswith((".yaml", "server.json"))
        write(self, path, text)

    monkeypatch.setattr(Files, "write", state_only)
    owners = [["k8s:app=server", f"k8s:app=server-{i}"][i % 2 :][:1] if i < 2 else [f"k8s:app=server-{i}"] for i in range(40)]
    (place / "c.jsonl").write_text("\n".join(line(i, own=own) for i, own in enumerate(owners)))
    got = replay(spark, place)
    made = sorted(str(p) for p in (place / "out/prod").glob("*"))
    assert len(made) == 40 and got.written == made  # and nothing else is in the folder
    assert len(list((place / "ev").glob("*/prod/*.json"))) == 40


def test_a_write_that_fails_leaves_the_old_document(tmp_path, monkeypatch):
    store = documents.Store(f"file://{tmp_path}")
    store.write("n/w.yaml", "old")
    store.write("n/w.yaml", "newer")

    class Broken:
        def __getattr__(self, name):
            return getattr(inner, name)

        def move(self, *a):
            raise OSError("lost")

    inner, store.fs = store.fs, Broken()
    with pytest.raises(OSError, match="lost"):
        store.write("n/w.yaml", "half")
    assert [p.name for p in (tmp_path / "n").iterdir()] == ["w.yaml"] and store.read("n/w.yaml") == "newer" and store.read("n/x.yaml") == ""


def test_where_tasks_have_no_access_the_driver_writes(spark, place, monkeypatch):
    monkeypatch.setattr(documents, "SCHEMES", {})
    got = replay(spark, place)
    assert len(got.written) == 1 and 'port: "8443"' in (place / "out/prod/server.yaml").read_text()
    assert replay(spark, place).unchanged == got.written and len(evidence_of(place)["sessions"]) == 2


def test_a_stream_numbers_lines_by_file_and_place(spark, place):
    (place / "in").mkdir()
    (place / "in/a.jsonl").write_text(line(0, own=["k8s:app=server", "k8s:v=first"]))
    (place / "in/b.jsonl").write_text("\n".join(line(i % 60, own=["k8s:app=server", "k8s:v=late"]) for i in range(1, 51)))
    live.start(capture.stream_lines(spark, str(place / "in")), options(place), str(place / "ck"), None).awaitTermination()
    stored = table(spark, place, "atoms").agg({"first_seq": "max"}).first()[0]
    assert stored == 0 and "app: server" in (place / "out/prod/server.yaml").read_text()
    rows = sorted((r["seq"], r["value"]) for r in capture.lines(spark, str(place / "in")).collect())
    assert [n for n, _ in rows] == list(range(51)) and "first" in rows[0][1]


def test_losses_are_told_once_a_period_and_in_all(spark, place, monkeypatch):
    lost = lambda n: '{"lost_events":{"num_events_lost":%d}}' % n
    monkeypatch.setattr(session, "LOSS_PERIOD", 0.0)
    run = session.Session.begin()
    run.said -= 60
    assert run.count_lost(4, run.said + 10) == "" and "9 events lost lately, 9 in all" in run.count_lost(5, run.said + 31)
    assert run.count_lost(0, run.said + 31) == "" and "1 events lost lately, 10 in all" in run.count_lost(1, run.said + 62)
    results = stream(spark, place, "a", "ck", [line(0) + "\n" + lost(3) + "\n" + lost(2), line(1), line(2) + "\n" + lost(7)])
    assert [r.stats["lost_events"] for r in results] == [5, 0, 7] and [r.stats["lines_read"] for r in results] == [3, 1, 2]


def test_replay_tells_what_it_read(spark, place, capsys):
    (place / "c.jsonl").write_text("\n".join([*LINES, "", "odd", line(9, verdict="FORWARDED"), '{"lost_events":{"num_events_lost":3}}']))
    assert cli.main(["replay", str(place / "c.jsonl"), "-o", str(place / "out"), "--no-evidence"]) == 0
    said = capsys.readouterr()
    told = json.loads(said.out.splitlines()[0])
    assert {k: told[k] for k in ("lines_read", "flows_emitted", "non_dropped", "malformed", "lost_events")} == {"lines_read": 9, "flows_emitted": 5, "non_dropped": 1, "malformed": 2, "lost_events": 3}
    assert "3 events lost in all" in said.err


def test_a_state_table_that_is_gone_raises(spark, place):
    replay(spark, place)
    for folder in (place / "out/.state").glob("atoms-*/*"):
        shutil.rmtree(folder)
    with pytest.raises(FileNotFoundError, match="gone"):
        replay(spark, place)


def stored_atoms(spark, policies):
    return spark.range(policies * 3).selectExpr(
        "concat('ns-', id % 7) namespace", "concat('app-', id div 3) workload", "'ingress' direction", "'cidr' peer_type", "concat('10.0.0.', id % 3, '/32') peer_key", "'port' kind", "'80' port", "'TCP' protocol",
        "'' method", "'' path", "'' name", "id first_seq", "cast(null as string) selector",
    )


def test_a_flush_reads_and_writes_what_it_touches(spark, place):
    state = State(spark, str(place / "out"))
    many = stored_atoms(spark, 3000)
    state.add(many, "atoms", ATOM_KEY)
    state.commit()
    before = state.now["parts"]["atoms"]
    assert replay(spark, place).written
    after = State(spark, str(place / "out")).now["parts"]["atoms"]
    assert after[:1] == before and len(after) == 2 and len(after[1]["buckets"]) == 1  # one policy, so one bucket of one new part
    assert spark.read.parquet(after[1]["folder"]).count() == 3
    touched = spark.createDataFrame([("prod", "server")], "namespace string, workload string")
    files = State(spark, str(place / "out")).stored("atoms", many.schema, ATOM_KEY, touched).inputFiles()
    (own,) = {r[0] for r in touched.select(bucket()).collect()}
    assert len(files) == 2 and all(f"/bucket={own}/" in f for f in files)
    assert replay(spark, place).written == []
    assert State(spark, str(place / "out")).now["parts"]["atoms"] == after  # nothing new, no part


def test_parts_are_merged_and_the_newest_row_counts(spark, place):
    state, schema = State(spark, str(place / "out")), session.FINGERPRINTS
    for i in range(FAN + 3):
        state.add(spark.createDataFrame([("n", "always", f"v{i}"), ("n", f"w{i}", "x")], schema), "t", session.POLICY)
        state.commit()
    parts = State(spark, str(place / "out")).now["parts"]["t"]
    assert [p["level"] for p in parts] == [1, 0, 0, 0]
    rows = {r["workload"]: r["fingerprint"] for r in State(spark, str(place / "out")).stored("t", schema, session.POLICY).collect()}
    assert rows == {"always": f"v{FAN + 2}"} | {f"w{i}": "x" for i in range(FAN + 3)}
    left = {str(p.parent) for p in (place / "out/.state").glob("t-*/*/bucket=*")}
    assert left == {p["folder"] for p in parts}  # parts that were merged are gone


def test_health_without_evidence_goes_by_reason(spark, place):
    got = replay(spark, place, keep_evidence=False)
    assert "FIB_LOOKUP_FAILED: 1" in got.health and "by node" not in got.health and not (place / "ev").exists()


def test_command_line(spark, place, capsys):
    where = ["-o", str(place / "out"), "--evidence-dir", str(place / "ev")]
    assert cli.main(["replay", str(place / "c.jsonl"), "--l7", *where]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[0])["policies_written"] == 1
    assert cli.main(["explain", "prod/server", *where, "--http-method", "get"]) == 0
    said = capsys.readouterr().out
    assert r"requests GET ^/a\.b$" in said and "newest session" in said and "from replay, 5 flows" in said
    assert cli.main(["explain", "prod/server", *where, "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out)["sessions"]) == 1
    assert cli.main(["explain", str(place / "out/prod/server.yaml"), *where, "--port", "1"]) == 0
    assert "0 of 4 rules" in (said := capsys.readouterr().out) and said.count("not matched") == 4
    assert cli.main(["replay", "x", "--ignore-protocol", "foo"]) == 2


def test_intervals():
    assert cli.interval("1h30m") == "1 hours 30 minutes"
    with pytest.raises(ValueError, match="duration"):
        cli.interval("soon")


def test_yaml_scalars():
    assert [render.scalar(x) for x in ("TCP", "8080", "true", "a: b", "^/a$", "", 8)] == ["TCP", '"8080"', '"true"', '"a: b"', "^/a$", '""', "8"]
    assert render.unified("p", "a\n", "a\n") == ""
