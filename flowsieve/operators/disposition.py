"""What becomes of each flow: one CASE in the order of the checks, which the counters show."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dropclass, flow
from ..functions.labels import workload_name

SEEN = ["infra", "transient", "policy", "no_l4", "nil_source", "nil_destination", "unknown_protocol", "world_no_ip"]
REJECTS = ["unknown_direction", "nil_endpoint", "reserved_identity", "empty_namespace", "no_l4", "nil_source", "nil_destination", "unknown_protocol", "world_no_ip"]


def check_protocols(names: Sequence[str]) -> list[str]:
    """Lower-cased names of protocols to ignore; raises for one that is none."""
    low = [n.strip().lower() for n in names]
    wrong = [n for n in low if n not in flow.IGNORABLE]
    if wrong:
        raise ValueError(f"unknown protocol {wrong[0]!r}; valid: {', '.join(flow.IGNORABLE)}")
    return low


def dispose(flows: DataFrame, ignore_reasons: Sequence[str] = (), ignore_protocols: Sequence[str] = ()) -> DataFrame:
    """``flows`` with drop_class, the target's namespace and workload, the rule parts, and disposition:

    non_dropped, ignored_reason, ignored_protocol, infra, transient, noise, one of REJECTS, or policy."""
    tgt, other = flow.target(), flow.peer()
    typed = dropclass.with_class(flows, F.col("drop_reason")).withColumns({"target": tgt, "peer": other, "l4_name": flow.l4_name(), "protocol": flow.protocol(), "port": flow.port(), "peer_ip": F.coalesce(flow.peer_ip(), F.lit(""))})
    ns = F.coalesce(F.col("target.namespace"), F.lit(""))
    entity, world = flow.entity(F.col("peer.labels")), flow.is_world(F.col("peer"))
    known = (F.col("verdict") == "DROPPED") & (F.col("drop_reason") != dropclass.UNSET)
    case = (
        F.when(F.col("verdict") != "DROPPED", "non_dropped")
        .when(F.col("drop_reason").isin([r.upper() for r in ignore_reasons]) if ignore_reasons else F.lit(False), "ignored_reason")
        .when(F.col("l4_name").isin(check_protocols(ignore_protocols)) if ignore_protocols else F.lit(False), "ignored_protocol")
        .when(known & F.col("drop_class").isin("infra", "transient", "noise"), F.col("drop_class"))
        .when(~F.col("direction").isin(flow.INGRESS, flow.EGRESS), "unknown_direction")
        .when(F.col("target").isNull(), "nil_endpoint")
        .when((ns == "") & flow.is_actionable(F.col("target.labels")), "reserved_identity")
        .when(ns == "", "empty_namespace")
        .when(F.col("l4").isNull(), "no_l4")
        .when(F.col("peer").isNull(), F.when(F.col("direction") == flow.INGRESS, "nil_source").otherwise("nil_destination"))
        .when(F.col("protocol").isNull(), "unknown_protocol")
        .when(entity.isNull() & world & (F.col("peer_ip") == ""), "world_no_ip")
        .otherwise("policy")
    )
    return typed.withColumns({"namespace": ns, "workload": workload_name(F.col("target.labels")), "entity": entity, "disposition": case, "world": world})


def flow_key() -> Column:
    """What makes a rejected flow distinct: its ends, port, protocol, direction and reason."""
    name = F.coalesce(F.col("protocol"), F.lit("unknown"))
    number = F.when(F.col("protocol").isNull(), F.lit("0")).otherwise(F.col("port").cast("string"))
    return F.concat_ws("|", flow.endpoint_id(F.col("source")), flow.endpoint_id(F.col("destination")), number, name, F.col("direction"), F.col("disposition"))


def unhandled(disposed: DataFrame) -> DataFrame:
    """reason, flows and distinct_flows of the rejected flows (see ``flow_key``)."""
    return disposed.filter(F.col("disposition").isin(REJECTS)).groupBy(F.col("disposition").alias("reason")).agg(F.count(F.lit(1)).alias("flows"), F.count_distinct(flow_key()).alias("distinct_flows"))


def reserved_key() -> Column:
    """First reserved label of a target and the direction: a warning of reserved identities is given once for each."""
    return F.concat(F.get(F.filter("target.labels", lambda x: x.startswith("reserved:")), F.lit(0)), F.lit("/"), F.col("direction"))


def lifetime_keys(disposed: DataFrame) -> DataFrame:
    """Distinct (kind, key) that a stream reports once in its life: unhandled flows, warnings of reserved identities, workloads."""
    rows = disposed.filter(F.col("disposition").isin(REJECTS)).select(F.lit("unhandled").alias("kind"), flow_key().alias("key"))
    warned = disposed.filter("disposition = 'reserved_identity'").select(F.lit("reserved").alias("kind"), reserved_key().alias("key"))
    reached = disposed.filter("disposition = 'policy'").select(F.lit("workload").alias("kind"), F.concat_ws("/", "namespace", "workload").alias("key"))
    return rows.unionByName(warned).unionByName(reached).distinct()


def unknown_reasons(disposed: DataFrame) -> DataFrame:
    """Distinct (kind, key) of drop reasons that aren't in the dimension."""
    return disposed.filter("verdict = 'DROPPED' and drop_class = 'unknown'").select(F.lit("unknown_reason").alias("kind"), F.col("drop_reason").alias("key")).distinct()


def warnings(keys: DataFrame, most: int = 20) -> list[str]:
    """What to say of new keys: reserved identities and unknown reasons, the first ``most`` of them."""
    rows = keys.filter("kind in ('reserved', 'unknown_reason')").orderBy("kind", "key").limit(most + 1).collect()
    said = [f"drop reason {r['key']} isn't known; its flows count as denied by policy" if r["kind"] == "unknown_reason" else f"no policy for a reserved identity: {r['key']}" for r in rows[:most]]
    return [*said, *(["and more"] if len(rows) > most else [])]


def session_stats(disposed: DataFrame) -> DataFrame:
    """One row of a session's counters. L7 records count before any flow is ignored, whether or not L7 rules are made."""
    dropped = F.col("verdict") == "DROPPED"
    count = lambda test, name: F.count_if(test).alias(name)
    kind = lambda *names: F.col("disposition").isin(*names)
    return disposed.agg(
        count(kind(*SEEN), "flows_seen"),
        count(dropped & F.col("l7.http").isNotNull(), "l7_http_count"),
        count(dropped & F.col("l7.dns").isNotNull(), "l7_dns_count"),
        count(kind("ignored_reason"), "ignored_by_reason"),
        count(kind("ignored_protocol"), "ignored_by_protocol"),
        count(kind("infra", "transient"), "infra_drop_total"),
        count(kind(*REJECTS), "flows_unhandled"),
        F.count_distinct(F.when(kind("policy", "no_l4", "nil_source", "nil_destination", "unknown_protocol", "world_no_ip"), F.concat_ws("/", "namespace", "workload"))).alias("workloads"),
    )


def ignored(disposed: DataFrame) -> DataFrame:
    """kind (reason or protocol), name and flows of what the ignore lists took out."""
    hit = disposed.filter(F.col("disposition").isin("ignored_reason", "ignored_protocol"))
    by_reason = F.col("disposition") == "ignored_reason"
    return hit.groupBy(F.when(by_reason, "reason").otherwise("protocol").alias("kind"), F.when(by_reason, F.col("drop_reason")).otherwise(F.col("l4_name")).alias("name")).agg(F.count(F.lit(1)).alias("flows"))


def drop_events(disposed: DataFrame) -> DataFrame:
    """reason, class, namespace, workload and node of each infrastructure or transient drop; ``_unknown`` for what is not known."""
    known = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("_unknown"))
    named = F.when(F.size(F.coalesce(F.col("target.labels"), F.array().cast("array<string>"))) > 0, F.col("workload"))
    return disposed.filter(F.col("disposition").isin("infra", "transient")).select(
        F.col("drop_reason").alias("reason"), F.col("drop_class").alias("class"), "hint", known(F.col("namespace")).alias("namespace"), known(named).alias("workload"), known(F.col("node_name")).alias("node"),
    )
