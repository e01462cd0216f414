"""Derived columns of a flow record (the columns of ``sources.capture.FLOW``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import workload_name

INGRESS, EGRESS = "INGRESS", "EGRESS"
# Reserved identities that are peers by name, in their order, and those that a cluster-wide policy can name.
ENTITIES = ["kube-apiserver", "host", "remote-node", "health"]
ACTIONABLE = ["reserved:health", "reserved:host", "reserved:remote-node", "reserved:kube-apiserver", "reserved:ingress"]
WORLD_IDENTITY = 2
IGNORABLE = ["icmpv4", "icmpv6", "sctp", "tcp", "udp"]
BLANK = r"^\s+|\s+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, BLANK, "")


def target(side: str = "direction") -> Column:
    """The endpoint a policy is for."""
    return F.when(F.col(side) == INGRESS, F.col("destination")).when(F.col(side) == EGRESS, F.col("source"))


def peer(side: str = "direction") -> Column:
    return F.when(F.col(side) == INGRESS, F.col("source")).when(F.col(side) == EGRESS, F.col("destination"))


def peer_ip() -> Column:
    return F.when(F.col("direction") == INGRESS, F.col("ip.source")).when(F.col("direction") == EGRESS, F.col("ip.destination"))


def l4_name() -> Column:
    """tcp, udp, icmpv4, icmpv6 or sctp; empty without a known protocol."""
    l4 = F.col("l4")
    return F.coalesce(
        F.when(l4["TCP"].isNotNull(), "tcp"), F.when(l4["UDP"].isNotNull(), "udp"), F.when(l4["ICMPv4"].isNotNull(), "icmpv4"),
        F.when(l4["ICMPv6"].isNotNull(), "icmpv6"), F.when(l4["SCTP"].isNotNull(), "sctp"), F.lit(""),
    )


def protocol() -> Column:
    """Name of the protocol in rules, null where rules cannot name it (SCTP, none)."""
    name = l4_name()
    return F.when(name == "tcp", "TCP").when(name == "udp", "UDP").when(name == "icmpv4", "ICMPv4").when(name == "icmpv6", "ICMPv6")


def port() -> Column:
    """Destination port, or the type of an ICMP message; 0 where the record leaves it out."""
    l4, name = F.col("l4"), l4_name()
    value = F.when(name == "tcp", l4["TCP"]["destination_port"]).when(name == "udp", l4["UDP"]["destination_port"]).when(name == "icmpv4", l4["ICMPv4"]["type"]).when(name == "icmpv6", l4["ICMPv6"]["type"])
    return F.when(protocol().isNotNull(), F.coalesce(value, F.lit(0)))


def is_icmp(proto: Column) -> Column:
    return proto.isin("ICMPv4", "ICMPv6")


def entity(labels: Column) -> Column:
    """Name of the first label that is a reserved peer; null if none is."""
    hit = F.get(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.isin([f"reserved:{e}" for e in ENTITIES])), F.lit(0))
    return F.replace(hit, F.lit("reserved:"), F.lit(""))


def is_world(endpoint: Column) -> Column:
    return (F.coalesce(endpoint["identity"], F.lit(0)) == WORLD_IDENTITY) | F.array_contains(F.coalesce(endpoint["labels"], F.array().cast("array<string>")), "reserved:world")


def is_actionable(labels: Column) -> Column:
    return F.arrays_overlap(F.coalesce(labels, F.array().cast("array<string>")), F.array(*[F.lit(x) for x in ACTIONABLE]))


def cidr(ip: Column) -> Column:
    """One address as a range: /128 where it is IPv6, else /32."""
    return F.concat(ip, F.when(F.contains(ip, F.lit(":")), "/128").otherwise("/32"))


def http_method(method: Column) -> Column:
    """Upper case and stripped; null if nothing is left."""
    return F.nullif(F.upper(strip(method)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of a URL or bare path, percent-decoded; of text that is no URL, what stands before ``#`` and ``?``."""
    parsed = F.try_parse_url(url, F.lit("PATH"))
    decoded = F.try_url_decode(F.replace(parsed, F.lit("+"), F.lit("%2B")))
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), "#.*$", ""), r"\?.*$", "")
    return F.coalesce(decoded, bare)


def anchored(path: Column) -> Column:
    """A pattern for exactly this path; an empty one means ``/``."""
    full = F.when(F.coalesce(path, F.lit("")) == "", F.lit("/")).otherwise(path)
    return F.concat(F.lit("^"), F.regexp_replace(full, r"([\\.+*?()|\[\]{}^$])", r"\\$1"), F.lit("$"))


def dns_name(query: Column) -> Column:
    """Stripped, without one dot at the end; null if nothing is left."""
    return F.nullif(strip(F.regexp_replace(strip(query), r"\.$", "")), F.lit(""))


def endpoint_id(endpoint: Column) -> Column:
    """How an endpoint is named in reports of flows without a policy."""
    ns, labels = F.coalesce(endpoint["namespace"], F.lit("")), endpoint["labels"]
    name = F.when(ns != "", F.concat(ns, F.lit("/"), workload_name(labels))).otherwise(F.coalesce(F.get(labels, F.lit(0)), F.lit("<unknown>")))
    return F.when(endpoint.isNull(), F.lit("<nil>")).otherwise(name)
