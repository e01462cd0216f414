"""From flows to rule atoms (what is allowed) and attribution (which flows asked for it).

An atom is one allowed thing of one peer: a port, an ICMP type, an HTTP method and path on a port, or a DNS name. All
later steps (policies, merging, equality) are set operations on atoms, so no list of raw flows is ever held.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import flow
from ..functions.labels import label_key, peer_selector, workload_name

ATOM_KEY = ["namespace", "workload", "direction", "peer_type", "peer_key", "kind", "port", "protocol", "method", "path", "name"]
TYPE_RANK = {"entity": 0, "cidr": 1, "endpoint": 2}


def observations(disposed: DataFrame, l7: bool = False) -> DataFrame:
    """One row per flow that makes a rule, with the rule's parts, its key and the flow's sample.

    With ``l7``, HTTP and (on egress) DNS records name the rule more closely, and the plain key is not used for those flows."""
    ok = disposed.filter("disposition = 'policy'")
    labels, kind = F.col("peer.labels"), F.when(F.col("entity").isNotNull(), "entity").when(F.col("world"), "cidr").otherwise("endpoint")
    key = F.when(F.col("peer_type") == "entity", F.col("entity")).when(F.col("peer_type") == "cidr", flow.cidr(F.col("peer_ip"))).otherwise(label_key(labels))
    prefix = F.when(F.col("peer_type") == "entity", "entity:").when(F.col("peer_type") == "cidr", "cidr:").otherwise("ep:")
    method = flow.http_method(F.col("l7.http.method")) if l7 else F.lit(None).cast("string")
    http = F.col("l7.http").isNotNull()
    name = F.when(~http & (F.col("side") == "egress"), flow.dns_name(F.col("l7.dns.query"))) if l7 else F.lit(None).cast("string")
    rows = ok.withColumns({"side": F.lower("direction"), "peer_type": kind}).withColumns({
        "peer_key": key,
        "selector": F.when(F.col("peer_type") == "endpoint", peer_selector(labels, F.col("peer.namespace"), F.col("namespace"))),
        "port": F.col("port").cast("string"),
        "method": method,
        "name": name,
    }).withColumn("path", F.when(F.col("method").isNotNull(), flow.anchored(flow.url_path(F.col("l7.http.url")))))
    base = F.concat(F.col("side"), F.lit(":"), prefix, F.col("peer_key"), F.lit(":"), F.col("protocol"), F.lit(":"), F.col("port"))
    deep = F.when(F.col("method").isNotNull(), F.concat(F.lit(":l7=proto=http,method="), F.col("method"), F.lit(",path="), F.col("path"))).when(F.col("name").isNotNull(), F.concat(F.lit(":l7=proto=dns,dns="), F.col("name")))
    end = lambda e: F.struct(F.coalesce(e["namespace"], F.lit("")).alias("namespace"), F.when(e.isNotNull(), workload_name(e["labels"])).otherwise("").alias("workload"), F.coalesce(e["pod_name"], F.lit("")).alias("pod"))
    sample = F.struct("time", end(F.col("source")).alias("src"), end(F.col("destination")).alias("dst"), F.col("port").cast("long").alias("port"), "protocol", "verdict", "drop_reason")
    return rows.select(
        "seq", "time", "namespace", "workload", F.col("side").alias("direction"), "peer_type", "peer_key", "selector", "port", "protocol", "method", "path", "name",
        F.concat(base, F.coalesce(deep, F.lit(""))).alias("rule_key"), sample.alias("sample"),
    )


def atoms(observed: DataFrame) -> DataFrame:
    """ATOM_KEY, selector and first_seq of every distinct atom. An atom's selector is that of the first flow of its peer."""
    text = lambda v: F.lit(v).cast("string")
    atom = lambda kind, port, proto, method, path, name: F.struct(F.lit(kind).alias("kind"), port.alias("port"), proto.alias("protocol"), method.alias("method"), path.alias("path"), name.alias("name"))
    none, port, proto = text(""), F.col("port"), F.col("protocol")
    made = F.array_compact(F.array(
        F.when(flow.is_icmp(proto), atom("icmp", port, proto, none, none, none)).otherwise(atom("port", port, proto, none, none, none)),
        F.when(F.col("method").isNotNull(), atom("http", port, proto, F.col("method"), F.col("path"), none)),
        F.when(F.col("name").isNotNull(), atom("fqdn", text("53"), text("ANY"), none, none, F.col("name"))),
    ))
    peer = ["namespace", "workload", "direction", "peer_type", "peer_key"]
    each = observed.select(*peer, "selector", "seq", F.explode(made).alias("a")).select(*peer, "a.*", "selector", "seq")
    return each.groupBy(*ATOM_KEY).agg(F.min("seq").alias("first_seq"), F.min_by("selector", "seq").alias("selector"))


def newest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key by ``order`` (descending columns), as column place (1 = last). n <= 0 keeps all.

    Spark thins every key to ``n`` rows a task before the shuffle (WindowGroupLimit), so no task gets a key with a third of all rows."""
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return placed if n <= 0 else placed.filter(F.col("place") <= n)


RULE = ["namespace", "workload", "rule_key"]


def attribution(observed: DataFrame) -> DataFrame:
    """RULE, its parts, flow_count, first_seen and last_seen. Flows without a time count and leave the times alone."""
    parts = ["direction", "peer_type", "peer_key", "port", "protocol", "method", "path", "name"]
    return observed.groupBy(*RULE).agg(*[F.first(p).alias(p) for p in parts], F.count(F.lit(1)).alias("flow_count"), F.min("time").alias("first_seen"), F.max("time").alias("last_seen"))


def samples(observed: DataFrame, n: int = 10) -> DataFrame:
    """The last ``n`` flows of each rule by arrival: RULE, seq, sample and place (1 = last)."""
    rows = observed.select(*RULE, "seq", "sample")
    return newest(rows if n > 0 else rows.limit(0), RULE, [F.desc("seq")], n)
