import pytest
from flows import OWN, dns, http, line

from flowsieve.functions import dropclass, flow, labels, suggest
from flowsieve.operators import disposition, evidence, health, merge, policies, rules
from flowsieve.sources import capture
from pyspark.sql import functions as F


def flows(spark, *lines):
    rows = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq long")
    return capture.flows(capture.parse(rows))


def keys(spark, *lines, l7=False):
    seen = rules.observations(disposition.dispose(flows(spark, *lines)), l7)
    return {r["rule_key"]: r["flow_count"] for r in rules.attribution(seen).collect()}


def fates(spark, *lines, **options):
    return [r[0] for r in disposition.dispose(flows(spark, *lines), **options).orderBy("seq").select("disposition").collect()]


def built(spark, *lines, l7=False):
    seen = rules.observations(disposition.dispose(flows(spark, *lines)), l7)
    return [r.asDict(recursive=True) for r in policies.rules(rules.atoms(seen)).orderBy("direction", "rule_no").collect()]


def test_dimension():
    assert len(dropclass.VALID_REASONS) == 76 and len(set(dropclass.VALID_REASONS)) == 76
    assert set(dropclass.HINTS) <= set(dropclass.INFRA)


def test_rule_keys(spark):
    got = keys(spark, line(0), line(1), line(2, port=8443), line(3, way="EGRESS", port=53, proto="UDP"), line(4, peer=["reserved:world"], ip=("1.2.3.4", "")), line(5, peer=["reserved:host"], peer_ns="", proto="ICMPv4", port=8))
    assert got == {"ingress:ep:app=client:TCP:8080": 2, "ingress:ep:app=client:TCP:8443": 1, "egress:ep:app=client:UDP:53": 1, "ingress:cidr:1.2.3.4/32:TCP:8080": 1, "ingress:entity:host:ICMPv4:8": 1}


def test_ipv6_world_peer_is_one_address(spark):
    assert list(keys(spark, line(0, peer=[], identity=2, ip=("2001:db8::1", "")))) == ["ingress:cidr:2001:db8::1/128:TCP:8080"]


def test_every_rejection(spark):
    got = fates(
        spark, line(0, way="OTHER"), line(1, own=None), line(2, own=["reserved:host"], own_ns=""), line(3, own_ns=""), line(4, proto=None), line(5, peer=None),
        line(6, way="EGRESS", peer=None), line(7, proto="SCTP"), line(8, peer=["reserved:world"]), line(9, verdict="FORWARDED"),
    )
    assert got == ["unknown_direction", "nil_endpoint", "reserved_identity", "empty_namespace", "no_l4", "nil_source", "nil_destination", "unknown_protocol", "world_no_ip"]


def test_gate_and_ignore_order(spark):
    lines = [line(0, reason="CT_MAP_INSERTION_FAILED"), line(1, reason="NAT_NOT_NEEDED"), line(2, reason="SOMETHING_NEW"), line(3), line(4, reason="POLICY_DENIED", proto="ICMPv4"), line(5, reason="STALE_OR_UNROUTABLE_IP")]
    assert fates(spark, *lines) == ["infra", "noise", "policy", "policy", "policy", "transient"]
    assert fates(spark, *lines, ignore_reasons=["ct_map_insertion_failed"], ignore_protocols=["icmpv4"]) == ["ignored_reason", "noise", "policy", "policy", "ignored_protocol", "transient"]


def test_argument_checks():
    with pytest.raises(ValueError, match="valid"):
        disposition.check_protocols(["tpc"])
    with pytest.raises(ValueError, match="POLICY_DENIED"):
        suggest.check_reasons(["POLICY_DENID"])
    assert suggest.check_reasons(["policy_denied"]) == (["POLICY_DENIED"], [])
    assert suggest.check_reasons(["CT_MAP_INSERTION_FAILED"])[1]


def test_unhandled_counts_and_distinct(spark):
    got = disposition.unhandled(disposition.dispose(flows(spark, line(0, peer=None), line(1, peer=None), line(2, peer=None, port=9)))).collect()
    assert [tuple(r) for r in got] == [("nil_source", 3, 2)]


def test_labels(spark):
    cases = {
        ("k8s:app=a", "k8s:app.kubernetes.io/name=b"): ("b", "app.kubernetes.io/name=b"),
        ("k8s:zone=z", "k8s:job-name=j", "any:x=y", "k8s:team=t"): ("t-z", "team=t,zone=z"),
        ("k8s:pod-template-hash=h",): ("unknown", ""),
        ("k8s:z=1", "k8s:z=2", "k8s:b"): ("-1-2", "b=,z=2"),
        (): ("unknown", ""),
    }
    df = spark.createDataFrame([(i, list(k)) for i, k in enumerate(cases)], "i int, l array<string>")
    got = df.select("i", labels.workload_name(F.col("l")), labels.label_key(F.col("l"))).orderBy("i").collect()
    assert [tuple(r)[1:] for r in got] == list(cases.values())


def test_paths_and_names(spark):
    df = spark.createDataFrame([("/a/b?x=1#y",), ("http://h/caf%C3%A9+1",), ("",), ("/a b?q",), (None,)], "u string")
    got = [r[0] for r in df.select(flow.anchored(flow.url_path(F.col("u")))).collect()]
    assert got == ["^/a/b$", r"^/café\+1$", "^/$", "^/a b$", "^/$"]
    names = spark.createDataFrame([(" a.b. ",), ("\t",), ("c..",)], "n string").select(flow.dns_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a.b", None, "c."]


def test_http_rules_split_ports(spark):
    got = built(spark, line(0, l7=http("get", "/x?y")), line(1, l7=http("GET", "/x")), line(2, port=9090), line(3, l7=http(" ", "/z")), l7=True)
    assert len(got) == 1 and got[0]["per_port"]
    assert [(p["port"], [(h["method"], h["path"]) for h in p["http"]]) for p in got[0]["ports"]] == [("8080", [("GET", "^/x$")]), ("9090", [])]
    assert keys(spark, line(0, l7=http("get", "/x?y")), line(1, l7=http(" ", "/z")), l7=True) == {"ingress:ep:app=client:TCP:8080:l7=proto=http,method=GET,path=^/x$": 1, "ingress:ep:app=client:TCP:8080": 1}


def test_dns_rules_and_companion(spark):
    lines = [line(i, way="EGRESS", proto="UDP", port=53, peer=["reserved:world"], ip=("", "8.8.8.8"), l7=dns(q)) for i, q in enumerate(["b.org.", "a.com", "b.org."])]
    got = built(spark, *lines, l7=True)
    assert [(r["form"], r["names"]) for r in got] == [("ports", None), ("fqdn", ["a.com", "b.org"]), ("companion", ["a.com", "b.org"])]
    assert [r["form"] for r in built(spark, *lines)] == ["ports"]
    own = [line(8 + i, way="EGRESS", proto=p, port=53, peer=["k8s:k8s-app=kube-dns"], peer_ns="kube-system") for i, p in enumerate(["UDP", "TCP"])]
    assert "companion" not in [r["form"] for r in built(spark, *lines, *own, l7=True)]
    assert "companion" in [r["form"] for r in built(spark, *lines, own[0], l7=True)]


def test_rule_order(spark):
    got = built(spark, line(0), line(1, proto="ICMPv4", port=8), line(2, peer=["reserved:world"], ip=("1.1.1.1", "")), line(3, peer=["reserved:host"]), line(4, port=7))
    assert [(r["form"], r["peer_type"]) for r in got] == [("ports", "entity"), ("ports", "cidr"), ("ports", "endpoint"), ("icmp", "endpoint")]
    assert [p["port"] for p in got[2]["ports"]] == ["8080", "7"]


def test_l7_off_is_the_same_as_no_l7(spark):
    assert built(spark, line(0, l7=http("GET", "/x"))) == built(spark, line(0))


def test_namespace_label_of_foreign_peers(spark):
    got = built(spark, line(0, peer_ns="prod"), line(1, peer=["k8s:app=b"], peer_ns="far"))
    assert [r["selector"] for r in got] == ["app=client", "app=b,io.kubernetes.pod.namespace=far"]


def atoms(spark, *lines, l7=True):
    return rules.atoms(rules.observations(disposition.dispose(flows(spark, *lines)), l7))


def test_merge_keeps_and_adds(spark):
    old, new = atoms(spark, line(0), line(1, port=1)), atoms(spark, line(0, port=2), line(1))
    both = merge.merge(old, new)
    assert [r["port"] for r in both.orderBy("first_seq").collect()] == ["8080", "1", "2"]
    assert [r["port"] for r in merge.added(old, both).collect()] == ["2"]
    again = merge.merge(both, new)
    assert merge.fingerprints(both).collect() == merge.fingerprints(again).collect()


def test_equal_policies_are_skipped(spark):
    a, b = merge.fingerprints(atoms(spark, line(0), line(1, port=1))), merge.fingerprints(atoms(spark, line(5, port=1), line(6)))
    none = a.limit(0)
    fate = lambda live, written: merge.dispositions(a, live, written).first()["disposition"]
    assert (fate(b, none), fate(none, b), fate(none, none)) == ("skip_live", "skip_written", "write")


def session(spark, name, *lines, n=10):
    seen = rules.observations(disposition.dispose(flows(spark, *lines)))
    return evidence.session_rules(rules.attribution(seen), rules.samples(seen, n), name)


def test_evidence_upsert(spark):
    one = session(spark, "s1", line(1), line(2), line(3), line(9, port=1))
    two = session(spark, "s2", line(21), line(22))
    rows = {r["port"]: r for r in evidence.upsert(one, two, 3).collect()}
    r = rows["8080"]
    assert (r["flow_count"], r["first_seen"].second, r["last_seen"].second, r["sessions"], [s["time"].second for s in r["samples"]]) == (5, 1, 22, ["s1", "s2"], [3, 21, 22])
    assert rows["1"]["sessions"] == ["s1"]


def test_samples_are_the_last_to_arrive(spark):
    assert [s["time"].second for s in session(spark, "s", *[line(i) for i in (5, 4, 3, 2)], n=2).first()["samples"]] == [3, 2]
    assert session(spark, "s", line(1), n=0).first()["samples"] == []


def test_session_cap(spark):
    schema = "namespace string, workload string, id string, started_at timestamp"
    make = lambda *ids: spark.createDataFrame([("n", "w", f"s{i}", None) for i in ids], schema).withColumn("started_at", F.expr("timestamp'2026-01-01' + make_interval(0,0,0,cast(substring(id,2) as int))"))
    assert sorted(r["id"] for r in evidence.upsert_sessions(make(1, 2), make(3), 2).collect()) == ["s2", "s3"]
    assert evidence.upsert_sessions(make(1, 2), make(2), 0).count() == 2


@pytest.mark.parametrize(("cidr", "wanted", "inside"), [("10.0.1.0/24", "10.0.0.0/8", True), ("192.168.0.0/16", "10.0.0.0/8", False), ("10.0.0.0/4", "10.0.0.0/8", False), ("2001:db8::1/128", "2001:db8::/32", True), ("2001:db9::1/128", "2001:db8::/32", False), ("10.0.0.1/32", "2001:db8::/32", False), ("::1/128", "0.0.0.0/0", False)])
def test_cidr_containment(spark, cidr, wanted, inside):
    assert spark.createDataFrame([(cidr,)], "c string").select(evidence.in_cidr(F.col("c"), wanted)).first()[0] is inside


def test_ipv6_ranges_as_the_standard_library_has_them(spark):
    import ipaddress
    import random

    rnd = random.Random(3)
    nets = [ipaddress.IPv6Network((rnd.getrandbits(128) >> (128 - n) << (128 - n), n)) for n in (0, 1, 7, 32, 45, 64, 99, 127, 128)]
    texts = ["", "x/64", "::/0", "1::2::3/64", "1:2:3/64", "::ffff:10.1.2.3/128", "2001:DB8::1/64", "fe80::1%eth0/64", "1:2:3:4:5:6:7:8:9/128", "12345::/32", "10.0.0.0/8", "::1", "::1/129"]
    for net in nets:
        for _ in range(12):
            address = ipaddress.IPv6Address(int(net.network_address) | rnd.getrandbits(max(1, 128 - net.prefixlen)) % (1 << (128 - net.prefixlen)) ^ (rnd.random() < 0.3) << rnd.randrange(128))
            texts.append(f"{rnd.choice([address.compressed, address.exploded])}/{rnd.randrange(129)}")
    rows = spark.createDataFrame([(x,) for x in texts], "c string").repartition(2)
    for net in nets:
        def inside(text):
            try:
                own = ipaddress.ip_interface(text)
            except ValueError:
                return False
            return "/" in text and own.version == 6 and own.ip in net and own.network.prefixlen >= net.prefixlen  # noqa: B023
        got = {r[0]: r[1] for r in rows.select("c", evidence.in_cidr(F.col("c"), str(net))).collect()}
        assert got == {x: inside(x) for x in texts}
    assert "Python" not in rows.select(evidence.in_cidr(F.col("c"), "2001:db8::/32"))._jdf.queryExecution().toString()


def test_fingerprints_hold_no_list(spark):
    other = {c: F.lit("x") for c in rules.ATOM_KEY if c not in ("namespace", "workload", "port")} | {"selector": F.lit(None).cast("string")}
    atoms = lambda numbers: spark.createDataFrame([("n", "w", f"{i}") for i in numbers], "namespace string, workload string, port string").withColumns(other)
    prints = [merge.fingerprints(atoms(x)).first()["fingerprint"] for x in (range(50), reversed(range(50)), range(49), [*range(49), 50])]
    assert prints[0] == prints[1] and len(set(prints)) == 3
    assert "collect_" not in merge.fingerprints(atoms([1]))._jdf.queryExecution().toString()


def test_closest_reasons_of_many_names(spark):
    typed = spark.createDataFrame([("POLICY_DENID",), ("zzzzzzzzzzzzzzzzzzzzzzzzzz",), ("",), ("NAT46",)], "typed string")
    got = [tuple(r) for r in suggest.closest(typed, n=2).orderBy("typed", "place").collect()]
    assert got == [("NAT46", "NAT46", 0, 1), ("NAT46", "NAT64", 2, 2), ("POLICY_DENID", "POLICY_DENIED", 1, 1), ("POLICY_DENID", "POLICY_DENY", 2, 2)]


def test_explain_filters_and_together(spark):
    seen = rules.observations(disposition.dispose(flows(spark, line(0, l7=http("GET", "/a")), line(1), line(2, way="EGRESS", proto="UDP", port=53, l7=dns("x.org")))), True)
    every = rules.attribution(seen)
    count = lambda **f: evidence.explain(every, **f).count()
    assert (count(), count(direction="ingress"), count(http_method="get"), count(http_method="GET", http_path="^/b$"), count(dns_pattern="x.org."), count(peer="app=client", port="53"), count(peer="app=other")) == (3, 2, 1, 0, 1, 1, 0)
    with pytest.raises(ValueError, match="KEY=VALUE"):
        count(peer="app")


def test_health_counts_and_ties(spark):
    nodes = [("n1", 10), ("n2", 5), ("n3", 5), ("n4", 5), ("n5", 1)]
    rows = [("R", "infra", "ns", "w", n) for n, k in nodes for _ in range(k)]
    events = spark.createDataFrame(rows, "reason string, class string, namespace string, workload string, node string")
    got = {r["dimension"]: r["top"] for r in health.top_text(health.contributors(events)).collect()}
    assert got == {"node": "n1 (10), n2 (5), n3 (5), n4 (5) (+1 more)", "workload": "ns/w (26)"}
    r = health.report(health.contributors(events), dropclass.reasons(spark)).first()
    assert (r["drops"], r["by_node"], r["by_workload"]) == (26, dict(nodes), {"ns/w": 26})


def test_drop_events_of_unknown_ends(spark):
    got = disposition.drop_events(disposition.dispose(flows(spark, line(0, reason="FIB_LOOKUP_FAILED", own=None, node_name=""), line(1, reason="FIB_LOOKUP_FAILED", own=OWN)))).orderBy("namespace").collect()
    assert [tuple(r)[3:] for r in got] == [("_unknown", "_unknown", "_unknown"), ("prod", "server", "node-1")]


def test_session_stats(spark):
    got = disposition.session_stats(disposition.dispose(flows(spark, line(0, l7=http("GET", "/")), line(1, reason="FIB_LOOKUP_FAILED"), line(2, reason="NAT_NOT_NEEDED"), line(3, own_ns=""), line(4, proto=None)))).first()
    assert (got["flows_seen"], got["l7_http_count"], got["infra_drop_total"], got["flows_unhandled"], got["workloads"]) == (3, 1, 1, 2, 1)
