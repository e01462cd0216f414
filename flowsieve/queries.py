"""Registered queries over the driver's tables, and the SQL that says the same.

The tables hold no flows, so ``event_flows`` makes them from ``events`` by fixed arithmetic on the event's number and user; the
SQL makes the same columns (``_FLOWS``). Every kind of peer, protocol, L7 record and rejection occurs.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dropclass, flow, labels, suggest
from .operators import disposition, evidence, health, merge, policies, rules
from .plans import session
from .plans.files import Files, shared_folder
from .sources import capture, stored

PREFIX = "fs-"
_NULL_ENDPOINT = "cast(null as struct<identity:bigint,namespace:string,labels:array<string>,pod_name:string>)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows (columns of ``capture.flow_schema``) made from events; seq is the event's number."""
    e = _table(spark, sf_dir, "events").selectExpr("event_id id", "cast(ts as timestamp) time", "user_id u", "event_type t")
    flat = e.selectExpr(
        "id seq", "time", "id", "u",
        "case when t = 'view' then 'FORWARDED' else 'DROPPED' end verdict",
        "case when t = 'error' and id % 3 = 0 then 'CT_MAP_INSERTION_FAILED' when t = 'error' and id % 3 = 1 then 'STALE_OR_UNROUTABLE_IP' when t = 'signup' and id % 17 = 0 then 'NAT_NOT_NEEDED' when t = 'click' and id % 11 = 0 then 'NEW_REASON' else 'POLICY_DENIED' end drop_reason",
        "case when id % 23 = 0 then 'TRAFFIC_DIRECTION_UNKNOWN' when id % 2 = 0 then 'INGRESS' else 'EGRESS' end direction",
        "case when id % 47 = 0 then '' else concat('node-', u % 5) end node_name",
        f"case when id % 29 = 0 then {_NULL_ENDPOINT} else named_struct('identity', 1000L, 'namespace', case when id % 31 = 0 then '' else concat('ns-', u % 4) end, 'labels', array(case when id % 93 = 0 then 'reserved:host' else concat('k8s:app=app-', u % 10) end, 'k8s:io.kubernetes.pod.namespace=x'), 'pod_name', concat('pod-', u % 7)) end tgt",
        f"case when id % 37 = 0 then {_NULL_ENDPOINT} when id % 13 = 0 then named_struct('identity', 1L, 'namespace', '', 'labels', array('reserved:host'), 'pod_name', '') when id % 7 = 0 then named_struct('identity', 2L, 'namespace', '', 'labels', array('reserved:world'), 'pod_name', '') else named_struct('identity', 2000L, 'namespace', concat('ns-', id % 3), 'labels', array(concat('k8s:app=peer-', id % 6), concat('k8s:pod-template-hash=h', id % 3)), 'pod_name', '') end pr",
        "case when id % 77 = 0 then '' else concat('10.0.', u % 3, '.', id % 5) end addr",
        "case when id % 41 = 0 then '' when id % 43 = 0 then 'sctp' when id % 19 = 0 then 'icmpv4' when id % 5 = 0 then 'udp' else 'tcp' end p",
    )
    return flat.selectExpr(
        "seq", "time", "verdict", "drop_reason", "direction", "node_name",
        "case when direction = 'EGRESS' then tgt else pr end source", "case when direction = 'EGRESS' then pr else tgt end destination",
        "named_struct('source', addr, 'destination', addr) ip",
        "case when p <> '' then named_struct('TCP', case when p = 'tcp' then named_struct('destination_port', 8000 + id % 4) end, 'UDP', case when p = 'udp' then named_struct('destination_port', 53L) end, 'ICMPv4', case when p = 'icmpv4' then named_struct('type', 8L) end, 'ICMPv6', cast(null as struct<type:bigint>), 'SCTP', case when p = 'sctp' then named_struct('destination_port', 7L) end) end l4",
        "case when p = 'tcp' and id % 3 = 0 or p = 'udp' and id % 4 <> 1 then named_struct('type', 'REQUEST', 'http', case when p = 'tcp' then named_struct('method', case when id % 2 = 0 then 'get' else ' POST ' end, 'url', concat('/api/v', u % 3, '/item.', id % 4, '?q=1')) end, 'dns', case when p = 'udp' then named_struct('query', concat('svc', u % 5, '.example.com.'), 'qtypes', array('A')) end) end l7",
    )


def _disposed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return disposition.dispose(event_flows(spark, sf_dir), **options)


def _observed(spark: SparkSession, sf_dir: str, l7: bool = False) -> DataFrame:
    return rules.observations(_disposed(spark, sf_dir), l7)


def _atoms(spark: SparkSession, sf_dir: str, l7: bool = True) -> DataFrame:
    return rules.atoms(_observed(spark, sf_dir, l7))


def rule_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribution(_observed(spark, sf_dir)).select(*rules.RULE, "flow_count", "first_seen", "last_seen")


def rule_attribution_l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribution(_observed(spark, sf_dir, True)).select(*rules.RULE, "flow_count", "first_seen", "last_seen")


def rule_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.samples(_observed(spark, sf_dir), 3).select(*rules.RULE, "seq", F.col("place").cast("long").alias("place"), F.col("sample.src.workload").alias("src_workload"), F.col("sample.drop_reason").alias("drop_reason"))


def dispositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disposed(spark, sf_dir).groupBy("disposition").agg(F.count(F.lit(1)).alias("flows"))


def dispositions_ignoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _disposed(spark, sf_dir, ignore_reasons=["new_reason"], ignore_protocols=["ICMPv4", "sctp"]).groupBy("disposition").agg(F.count(F.lit(1)).alias("flows"))


def ignored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposition.ignored(_disposed(spark, sf_dir, ignore_reasons=["NEW_REASON"], ignore_protocols=["icmpv4", "sctp"]))


def unhandled_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposition.unhandled(_disposed(spark, sf_dir))


def session_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposition.session_stats(_disposed(spark, sf_dir))


def drop_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = event_flows(spark, sf_dir).filter("verdict = 'DROPPED'")
    return dropclass.with_class(flows, F.col("drop_reason")).groupBy("drop_reason", "drop_class", "hint").agg(F.count(F.lit(1)).alias("flows"))


def class_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of known reasons, and what of them the flows have."""
    seen = event_flows(spark, sf_dir).filter("verdict = 'DROPPED'").groupBy(F.col("drop_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    known = dropclass.reasons(spark).join(seen, "reason", "left").groupBy("class")
    return known.agg(F.count(F.lit(1)).alias("reasons"), F.count("hint").alias("hints"), F.count("n").alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("flows"))


def _capture_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as lines (value, seq) of a capture."""
    named = event_flows(spark, sf_dir).withColumnsRenamed({"direction": "traffic_direction", "drop_reason": "drop_reason_desc", "ip": "IP"})
    return named.select(F.to_json(F.struct(F.struct([c for c in named.columns if c != "seq"]).alias("flow"))).alias("value"), "seq")


def capture_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows written as lines of a capture, some spoilt, some blank, some of lost events, and scanned again."""
    line = F.col("value")
    spoilt = F.when(F.col("seq") % 101 == 0, "not json").when(F.col("seq") % 103 == 0, "  ").when(F.col("seq") % 107 == 0, '{"lost_events":{"num_events_lost":3}}').otherwise(line)
    parsed = capture.parse(_capture_lines(spark, sf_dir).withColumn("value", spoilt))
    return capture.scan_counters(parsed).crossJoin(F.broadcast(capture.lost_events(parsed)))  # one row each


def _attributed(flows: DataFrame) -> DataFrame:
    return rules.attribution(rules.observations(disposition.dispose(flows))).select(*rules.RULE, "flow_count")


def capture_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _attributed(capture.flows(capture.parse(_capture_lines(spark, sf_dir))))


def capture_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows written as plain and as gzip files of one capture folder, and read from there."""
    folder, lines = shared_folder(spark, "capture"), _capture_lines(spark, sf_dir)
    lines.filter("seq % 2 = 0").select("value").write.text(folder)
    lines.filter("seq % 2 <> 0").select("value").write.mode("append").text(folder, compression="gzip")
    return _attributed(capture.read_flows(spark, folder))


def namespace_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_flows(spark, sf_dir).filter("verdict = 'DROPPED'").filter(capture.in_namespaces(["ns-1", "ns-3"])).groupBy("direction").agg(F.count(F.lit(1)).alias("flows"))


def lost_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = _table(spark, sf_dir, "events").filter("event_type = 'error'").selectExpr("cast(ts as timestamp) time", "event_id % 5 num_events_lost")
    return capture.lost_by_window(lost, width="1 hour")


def policy_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _atoms(spark, sf_dir).select(*rules.ATOM_KEY, "first_seq", "selector")


def policy_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.selectors(_disposed(spark, sf_dir)).withColumn("policy_name", policies.policy_name(F.col("workload"), PREFIX))


def policy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = policies.rules(_atoms(spark, sf_dir, False))
    ports = F.array_join(F.transform("ports", lambda p: F.concat(p["port"], F.lit("/"), p["protocol"])), ",")
    icmps = F.array_join(F.transform("icmps", lambda i: F.concat(i["family"], F.lit(":"), i["type"])), ",")
    return built.select("namespace", "workload", "direction", F.col("rule_no").cast("long").alias("rule_no"), "form", "peer_type", "peer_key", F.coalesce("selector", F.lit("")).alias("selector"), F.coalesce(ports, icmps, F.lit("")).alias("body"))


def policy_rules_l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = policies.rules(_atoms(spark, sf_dir))
    return built.groupBy("direction", "form", "per_port").agg(F.count(F.lit(1)).alias("rules"), F.coalesce(F.sum(F.size(F.coalesce("names", F.array().cast("array<string>")))), F.lit(0)).alias("names"), F.coalesce(F.sum(F.aggregate(F.coalesce("ports", F.array().cast(policies._PORTS)), F.lit(0), lambda n, p: n + F.size(p["http"]))), F.lit(0)).alias("http_rules"))


def dns_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = policies.rules(_atoms(spark, sf_dir)).filter("form in ('fqdn', 'companion')")
    return built.select("namespace", "workload", "form", F.when(F.col("form") == "fqdn", F.col("peer_key")).otherwise("").alias("peer_key"), F.array_join("names", ",").alias("names"))


def rule_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policies.comments(policies.rules(_atoms(spark, sf_dir, False))).select("namespace", "workload", "direction", "comment")


def peer_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _observed(spark, sf_dir).filter("peer_type = 'endpoint'").groupBy("namespace", "peer_key", "selector").agg(F.count(F.lit(1)).alias("flows"))


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    seen = _observed(spark, sf_dir, True)
    late = F.col("seq") % 3 == 0
    return rules.atoms(seen.filter(~late)), rules.atoms(seen.filter(late))


def merged_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge(*_halves(spark, sf_dir)).groupBy("namespace", "workload").agg(F.count(F.lit(1)).alias("atoms"), F.count_if(F.col("kind") == "http").alias("http"), F.count_if(F.col("kind") == "fqdn").alias("fqdn"))


def merge_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, fresh = _halves(spark, sf_dir)
    return merge.added(stored, merge.merge(stored, fresh)).select(*rules.ATOM_KEY)


def policy_dedup_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One namespace is live as it is, one with half of its flows' rules, one was written before; all of them grow with the flows."""
    seen = _observed(spark, sf_dir)
    live = seen.filter("namespace = 'ns-1' or (namespace = 'ns-2' and seq % 4 < 2)")
    written = seen.filter("namespace in ('ns-1', 'ns-3')")
    return merge.dispositions(*[merge.fingerprints(rules.atoms(x)) for x in (seen, live, written)]).select("namespace", "workload", "disposition")


def lifetime_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposition.lifetime_keys(_disposed(spark, sf_dir)).groupBy("kind").agg(F.count(F.lit(1)).alias("keys"))


def _documents(spark: SparkSession, flows: DataFrame, after: session.Options | None = None) -> session.Options:
    """A run over the flows that writes its documents to a new folder, or to that of the run before."""
    folder = shared_folder(spark, "run")
    options = after or session.Options(f"{folder}/policies", f"{folder}/evidence", samples=3)
    session.run(flows, options)
    return options


def _evidence_files(options: session.Options) -> str:
    return f"{options.evidence_dir}/{session.output_hash(options.output_dir)}/*/*.json"


def policy_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the policy documents that a run writes, by their comments, read back from the files."""
    options = _documents(spark, event_flows(spark, sf_dir))
    lines = spark.read.text(f"{options.output_dir}/*/*.yaml").select("value", F.col("_metadata.file_path").alias("path")).filter("value like '  # %'")
    part = lambda n: F.element_at(F.split("path", "/"), n)
    return lines.select(part(-2).alias("namespace"), F.replace(part(-1), F.lit(".yaml"), F.lit("")).alias("workload"), F.substr("value", F.lit(5)).alias("comment"))


def merged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy documents of two runs allow, read back from the files. The second run finds no state of the first, only its documents, as if
    another program had written them, and merges into them."""
    flows, late = event_flows(spark, sf_dir), F.col("seq") % 3 == 0
    folder = shared_folder(spark, "run")
    options = session.Options(f"{folder}/policies", f"{folder}/evidence", l7=True, keep_evidence=False)
    session.run(flows.filter(~late), options)
    Files(spark).delete(f"{options.output_dir}/.state")
    session.run(flows.filter(late), options)
    return stored.live_atoms(spark, f"{options.output_dir}/*/*.yaml", options.manager, options.prefix).select(*rules.ATOM_KEY)


def evidence_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the evidence documents that a run writes, read back from the files."""
    read = stored.read_evidence(spark, _evidence_files(_documents(spark, event_flows(spark, sf_dir))))
    return read.select(*rules.RULE, "flow_count", "first_seen", "last_seen", F.size("sessions").cast("long").alias("sessions"), F.size("samples").cast("long").alias("samples"), F.element_at("samples", -1)["time"].alias("last_sample"))


def latest_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest session of each evidence document after two runs, and how many the document names."""
    flows, late = event_flows(spark, sf_dir), F.col("seq") % 3 == 0
    options = _documents(spark, flows.filter(late), _documents(spark, flows.filter(~late)))
    read = stored.read_sessions(spark, _evidence_files(options)).groupBy("namespace", "workload")
    newest = lambda c: F.max_by(c, "place").alias(c)
    return read.agg(F.count(F.lit(1)).alias("sessions"), newest("flows_ingested"), newest("flows_unhandled"))


def _session(seen: DataFrame, name: str) -> DataFrame:
    return evidence.session_rules(rules.attribution(seen), rules.samples(seen, 2), name)


def evidence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen, late = _observed(spark, sf_dir), F.col("seq") % 3 == 0
    both = evidence.upsert(_session(seen.filter(~late), "s1"), _session(seen.filter(late), "s2"), 3)
    return both.select(*rules.RULE, "flow_count", "first_seen", "last_seen", F.array_join("sessions", ",").alias("sessions"), F.size("samples").cast("long").alias("samples"), F.element_at("samples", -1)["time"].alias("last_sample"))


def evidence_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = event_flows(spark, sf_dir).select(F.lit("ns").alias("namespace"), F.concat(F.lit("app-"), F.col("seq") % 10).alias("workload"), F.concat(F.lit("s-"), F.col("seq")).alias("id"), F.col("time").alias("started_at"))
    return evidence.upsert_sessions(named.filter("id not like '%7'"), named.filter("id like '%7'"), 4)


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribution(_observed(spark, sf_dir, True))


def explain_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.explain(_rules(spark, sf_dir), direction="ingress", port="8002", peer="app=peer-2").select(*rules.RULE, "flow_count")


def explain_cidr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.explain(_rules(spark, sf_dir), peer_cidr="10.0.1.0/24").select(*rules.RULE, "flow_count")


def explain_l7(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_path = evidence.explain(_rules(spark, sf_dir), http_method=" get ", http_path=r"^/api/v1/item\.0$")
    return by_path.unionByName(evidence.explain(_rules(spark, sf_dir), dns_pattern="svc2.example.com.")).select(*rules.RULE, "flow_count")


def explain_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.explain(_rules(spark, sf_dir), since="10 days", now=datetime(2024, 1, 20)).select(*rules.RULE, "last_seen")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disposition.drop_events(_disposed(spark, sf_dir))


def health_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.contributors(_events(spark, sf_dir))


def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = health.report(health.contributors(_events(spark, sf_dir)), dropclass.reasons(spark))
    return full.select("reason", "class", "drops", F.coalesce("remediation", F.lit("")).alias("remediation"), F.size("by_node").cast("long").alias("nodes"), F.size("by_workload").cast("long").alias("workloads"))


def health_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.top_text(health.contributors(_events(spark, sf_dir)))


def health_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.reasons_only(_disposed(spark, sf_dir))


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid reasons for the flows' reasons with one letter left out, another one by flow."""
    typed = event_flows(spark, sf_dir).filter("verdict = 'DROPPED'").select(F.expr("overlay(drop_reason placing '' from cast(seq % length(drop_reason) as int) + 1 for 1)").alias("typed"))
    return suggest.closest(typed.groupBy("typed").agg(F.count(F.lit(1)).alias("flows")), n=3)


def range_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address ranges of both versions made from events, and how many a wanted range of each version covers, by prefix length."""
    four = "concat('10.', user_id % 256, '.', event_id % 256, '.0/', if(event_id % 2 = 0, 24, 8))"
    six = "concat('2001:db8:', lower(hex(user_id % 4096)), if(event_id % 5 = 0, ':0:0:0:0:', '::'), lower(hex(event_id % 65536)), '/', case event_id % 3 when 0 then 128 when 1 then 64 else 32 end)"
    ranges = _table(spark, sf_dir, "events").selectExpr(f"explode(array({four}, {six})) range")
    covered = evidence.in_cidr(F.col("range"), "10.64.0.0/10") | evidence.in_cidr(F.col("range"), "2001:db8:a00::/39")
    length = F.substring_index("range", "/", -1).cast("int")
    return ranges.groupBy(F.contains("range", F.lit(":")).alias("v6"), length.alias("length")).agg(F.count(F.lit(1)).alias("ranges"), F.count_if(covered).alias("covered"))


def label_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of workloads whose labels have no priority key, a denied one, or repeats."""
    rows = _table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.array(F.lit("k8s:zone=b"), F.concat(F.lit("k8s:team="), "n_name"), F.lit("k8s:job-name=j"), F.lit("k8s:zone=a"), F.lit("any:x=y")).alias("l"))
    return rows.select("k", labels.workload_name(F.col("l")).alias("workload"), labels.label_key(F.col("l")).alias("selector"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "pages").select("page_id", flow.anchored(flow.url_path(F.col("url"))).alias("path"))


def output_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = F.substring(F.sha2(F.lit("/policies"), 256), 1, 12)
    return policies.selectors(_disposed(spark, sf_dir)).select("namespace", "workload", F.concat_ws("/", where, "namespace", F.concat("workload", F.lit(".json"))).alias("path"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rule_attribution, rule_attribution_l7, rule_samples, dispositions, dispositions_ignoring, ignored_flows, unhandled_flows, session_stats, drop_classes,
        class_sizes, capture_counters, capture_round_trip, capture_files, namespace_filter, lost_by_window, policy_atoms, policy_selectors, policy_rules, policy_rules_l7, dns_rules,
        rule_comments, peer_selectors, merged_policies, merge_added, policy_dedup_live, lifetime_keys, policy_documents, merged_documents, evidence_documents, latest_sessions, evidence_upsert, evidence_sessions, explain_port, explain_cidr, explain_l7, explain_since,
        health_counts, health_report, health_top, health_reasons, suggestions, range_matches, label_names, page_paths, output_paths,
    )
}
