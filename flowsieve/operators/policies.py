"""From rule atoms to policies: rules in order, DNS rules and the rule that lets workloads resolve names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_key
from .rules import TYPE_RANK

POLICY = ["namespace", "workload"]
# The cluster's name service.
DNS_SELECTOR = "io.kubernetes.pod.namespace=kube-system,k8s-app=kube-dns"
DNS_LABELS = ["io.kubernetes.pod.namespace=kube-system", "k8s-app=kube-dns"]
_PORTS = "array<struct<seq:bigint,port:string,protocol:string,http:array<struct<method:string,path:string>>>>"


def policy_name(workload: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), workload)


def selectors(disposed: DataFrame) -> DataFrame:
    """POLICY and selector of every workload with a flow that reached it, rules or not; the labels are those of its first flow."""
    reached = disposed.filter(F.col("disposition").isin("policy", "no_l4", "nil_source", "nil_destination", "unknown_protocol", "world_no_ip"))
    return reached.groupBy(*POLICY).agg(label_key(F.min_by("target.labels", "seq")).alias("selector"))


def rules(atoms: DataFrame) -> DataFrame:
    """One row per rule in order: POLICY, direction, rule_no, form (ports, icmp, fqdn, companion), the peer, and ports, icmps or names.

    Order: entities, address ranges, endpoints, each by first flow with ports before ICMP; then DNS rules; then the companion.
    Ports are one entry unless one of them has HTTP rules (``per_port``). One aggregation by peer and port gathers a port's HTTP rules,
    a second one the ports of each peer, so the work grows with the rules and not with ports times rules."""
    peer = [*POLICY, "direction", "peer_type", "peer_key"]
    only_kind = lambda kind, c: F.when(F.col("kind") == kind, c)
    entries = atoms.groupBy(*peer, "port", "protocol").agg(
        F.min("first_seq").alias("first"), F.min_by("selector", "first_seq").alias("selector"),
        F.min(only_kind("port", F.col("first_seq"))).alias("p"), F.min(only_kind("icmp", F.col("first_seq"))).alias("i"),
        F.array_sort(F.collect_list(only_kind("http", F.struct("first_seq", "method", "path")))).alias("h"), F.collect_set(only_kind("fqdn", F.col("name"))).alias("n"),
    )
    http = F.transform("h", lambda x: F.struct(x["method"].alias("method"), x["path"].alias("path")))
    gathered = lambda seq, *parts: F.array_sort(F.collect_list(F.when(F.col(seq).isNotNull(), F.struct(F.col(seq).alias("seq"), *parts))))
    by = entries.groupBy(*peer).agg(
        F.min("first").alias("begun"), F.min_by("selector", "first").alias("selector"),
        gathered("p", "port", "protocol", http.alias("http")).alias("p"), gathered("i", "protocol", "port").alias("i"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("n")))).alias("n"),
    )
    ports = F.col("p")
    icmps = F.transform("i", lambda x: F.struct(F.when(x["protocol"] == "ICMPv6", "IPv6").otherwise("IPv4").alias("family"), x["port"].alias("type")))
    forms = F.array_compact(F.array(*[F.when(F.size(held) > 0, F.lit(form)) for form, held in (("ports", "p"), ("icmp", "i"), ("fqdn", "n"))]))
    only = lambda form, c: F.when(F.col("form") == form, c)
    found = by.withColumn("form", F.explode(forms)).select(*peer, "begun", "form", F.when(F.col("form") != "fqdn", F.col("selector")).alias("selector"), only("ports", ports).alias("ports"), only("icmp", icmps).alias("icmps"), only("fqdn", F.col("n")).alias("names"))
    every = found.unionByName(_companions(found), allowMissingColumns=True)
    rank = F.when(F.col("form") == "companion", 8).when(F.col("form") == "fqdn", F.lit(4) + _type_rank()).otherwise(_type_rank())
    order = Window.partitionBy(*POLICY, "direction").orderBy(rank, "begun", "peer_key", F.when(F.col("form") == "icmp", 1).otherwise(0))
    return every.withColumn("rule_no", F.row_number().over(order)).withColumn("per_port", F.exists(F.coalesce("ports", F.array().cast(_PORTS)), lambda p: F.size(p["http"]) > 0))


def _type_rank() -> Column:
    return F.when(F.col("peer_type") == "entity", TYPE_RANK["entity"]).when(F.col("peer_type") == "cidr", TYPE_RANK["cidr"]).otherwise(TYPE_RANK["endpoint"])


def _companions(found: DataFrame) -> DataFrame:
    """The rule towards the name service for policies with DNS rules and without one of their own that allows both protocols."""
    both = lambda proto: F.exists("ports", lambda p: (p["port"] == "53") & (p["protocol"] == proto))
    asks = (F.col("form") == "ports") & (F.col("direction") == "egress") & (F.col("peer_type") == "endpoint") & both("UDP") & both("TCP")
    for label in DNS_LABELS:
        asks = asks & F.array_contains(F.split("selector", ","), label)
    by = found.groupBy(*POLICY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"), F.bool_or(F.coalesce(asks, F.lit(False))).alias("has"))
    return by.filter("size(names) > 0 and not has").drop("has").withColumns({"direction": F.lit("egress"), "peer_type": F.lit("endpoint"), "peer_key": F.lit(DNS_SELECTOR), "selector": F.lit(DNS_SELECTOR), "form": F.lit("companion"), "begun": F.lit(None).cast("long")})


def traffic_text() -> Column:
    """What a rule lets through, in words."""
    ports = F.transform("ports", lambda p: F.concat(p["protocol"], F.lit("/"), p["port"]))
    icmps = F.transform("icmps", lambda i: F.concat(i["family"], F.lit("(type="), i["type"], F.lit(")")))
    named = F.when(F.col("form").isin("fqdn", "companion"), F.lit("UDP/53, TCP/53"))
    return F.coalesce(named, F.nullif(F.array_join(F.concat(F.coalesce(ports, F.array().cast("array<string>")), F.coalesce(icmps, F.array().cast("array<string>"))), ", "), F.lit("")), F.lit("all traffic"))


def peer_text() -> Column:
    way = F.when(F.col("direction") == "ingress", "from").otherwise("to")
    what = F.when(F.col("form") == "fqdn", "any").when(F.col("peer_type") == "entity", F.concat(F.lit("entity "), "peer_key")).when(F.col("peer_type") == "cidr", F.concat(F.lit("CIDR "), "peer_key"))
    return F.concat(way, F.lit(" "), F.coalesce(what, F.nullif(F.replace("selector", F.lit(","), F.lit(", ")), F.lit("")), F.lit("any")))


def comments(rules: DataFrame) -> DataFrame:
    """POLICY, direction, rule_no and the comment that stands before the rule."""
    return rules.select(*POLICY, "direction", "rule_no", F.concat(traffic_text(), F.lit(" "), peer_text()).alias("comment"))
