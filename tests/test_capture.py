import gzip
import io

import pytest
from flows import line

from flowsieve.sources import capture


def counters(spark, text, tmp_path, name="c.jsonl", strict=False):
    path = tmp_path / name
    path.write_bytes(gzip.compress(text.encode()) if name.endswith(".gz") else text.encode())
    return capture.scan_counters(capture.parse(capture.lines(spark, str(path)), strict)).first().asDict()


def test_counters_of_a_mixed_capture(spark, tmp_path):
    text = "\n".join([line(0), "", "  ", line(1, verdict="FORWARDED"), "no json", '{"node_name":"n"}', '{"lost_events":{"num_events_lost":7}}', line(2)])
    want = {"lines_read": 8, "flows_emitted": 2, "non_dropped": 1, "malformed": 3}
    assert counters(spark, text, tmp_path) == want
    assert counters(spark, text, tmp_path, "c.jsonl.gz") == want


def test_empty_capture(spark, tmp_path):
    assert counters(spark, "", tmp_path) == {"lines_read": 0, "flows_emitted": 0, "non_dropped": 0, "malformed": 0}


def test_strict_rejects_unknown_fields(spark, tmp_path):
    odd = line(0)[:-1] + ', "other": 1}'
    assert counters(spark, odd, tmp_path)["flows_emitted"] == 1
    assert counters(spark, odd, tmp_path, strict=True)["malformed"] == 1


def test_missing_path_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        capture.lines(spark, str(tmp_path / "none.jsonl")).count()


def test_standard_input(spark, monkeypatch):
    monkeypatch.setattr("sys.stdin", io.StringIO(line(0) + "\n" + line(1) + "\n"))
    assert capture.read_flows(spark, "-").count() == 2


def test_lost_events(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"lost_events":{"num_events_lost":7}}\n{"lost_events":{"num_events_lost":2}}\n' + line(0))
    assert capture.lost_events(capture.parse(capture.lines(spark, str(path)))).first()[0] == 9


def test_namespace_filter(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join([line(0, own_ns="a", peer_ns="b"), line(1, own_ns="c", peer_ns="d"), line(2, peer=None, own_ns="b")]))
    flows = capture.read_flows(spark, str(path))
    assert flows.filter(capture.in_namespaces(["b"])).count() == 2
    assert flows.filter(capture.in_namespaces([])).count() == 3


def test_snapshot_keeps_the_later_of_equal_names(spark):
    schema = "namespace string, name string, managed_by string, v int"
    a = spark.createDataFrame([("n", "p", "me", 1), ("n", "q", "other", 1)], schema)
    b = spark.createDataFrame([("n", "p", "me", 2), ("m", "p", "me", 3)], schema)
    assert sorted(tuple(r) for r in capture.snapshot([a, b], "me").collect()) == [("m", "p", "me", 3), ("n", "p", "me", 2)]


@pytest.mark.parametrize("few", [50_000, 1])
def test_arrival_order_goes_by_file_name(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(capture, "SPLITS", few)
    monkeypatch.setattr(capture, "RUNS", 4)
    (tmp_path / "a.jsonl").write_text("first")
    (tmp_path / "b.jsonl").write_text("\n".join(f"{i:03d}" + "x" * 200 for i in range(50)))
    (tmp_path / "c.jsonl.gz").write_bytes(gzip.compress(b"p\nq\n"))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for most in (size, "1000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", most)
            rows = sorted((r["seq"], r["value"][:3]) for r in capture.lines(spark, str(tmp_path)).collect())
            assert rows == list(enumerate(["fir", *(f"{i:03d}" for i in range(50)), "p", "q"]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_counters_come_with_the_first_pass(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join([line(0), "", line(1, verdict="FORWARDED"), "no json", '{"lost_events":{"num_events_lost":7}}']))
    parsed, scan = capture.observed(capture.parse(capture.lines(spark, str(path))))
    assert capture.flows(parsed).count() == 1
    assert scan.get == {"lines_read": 5, "flows_emitted": 1, "non_dropped": 1, "malformed": 2, "lost_events": 7}


def test_long_and_wide_labels(spark):
    from pyspark.sql import functions as F

    from flowsieve.functions import labels

    long = "x" * 1_100_000
    rows = [([f"k8s:app={long}"],), (["k8s:b=" + "é" * 20, "k8s:a=" + "z" * 40],), (["k8s:a=" + "z" * 20, "k8s:b=" + "é" * 40],), (["k8s:a=" + "z" * 80],)]
    got = [r[0] for r in spark.createDataFrame(rows, "l array<string>").select(labels.workload_name(F.col("l"))).collect()]
    assert got == [long, "z" * 40 + "-" + "é" * 11, "z" * 20 + "-" + "é" * 20 + "é", "z" * 63]
