"""Drop reasons: their class and, for some, a link that helps."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Every known drop reason by class.
POLICY = ["POLICY_DENIED", "DENIED_BY_LB_SRC_RANGE_CHECK", "POLICY_DENY", "AUTH_REQUIRED"]
TRANSIENT = [
    "DROP_REASON_UNKNOWN", "STALE_OR_UNROUTABLE_IP", "NO_MATCHING_LOCAL_CONTAINER_FOUND", "NO_CONFIGURATION_AVAILABLE_TO_PERFORM_POLICY_DECISION",
    "INVALID_IDENTITY", "UNKNOWN_SENDER", "TTL_EXCEEDED", "DROP_HOST_NOT_READY", "DROP_EP_NOT_READY",
]
NOISE = ["NAT_NOT_NEEDED", "IS_A_CLUSTERIP", "IGMP_HANDLED", "IGMP_SUBSCRIBED", "MULTICAST_HANDLED", "DROP_PUNT_PROXY"]
INFRA = [
    "INVALID_SOURCE_MAC", "INVALID_DESTINATION_MAC", "INVALID_SOURCE_IP", "INVALID_PACKET_DROPPED", "CT_TRUNCATED_OR_INVALID_HEADER",
    "CT_MISSING_TCP_ACK_FLAG", "CT_UNKNOWN_L4_PROTOCOL", "CT_CANNOT_CREATE_ENTRY_FROM_PACKET", "UNSUPPORTED_L3_PROTOCOL", "MISSED_TAIL_CALL",
    "ERROR_WRITING_TO_PACKET", "UNKNOWN_L4_PROTOCOL", "UNKNOWN_ICMPV4_CODE", "UNKNOWN_ICMPV4_TYPE", "UNKNOWN_ICMPV6_CODE", "UNKNOWN_ICMPV6_TYPE",
    "ERROR_RETRIEVING_TUNNEL_KEY", "ERROR_RETRIEVING_TUNNEL_OPTIONS", "INVALID_GENEVE_OPTION", "UNKNOWN_L3_TARGET_ADDRESS",
    "ERROR_WHILE_CORRECTING_L3_CHECKSUM", "ERROR_WHILE_CORRECTING_L4_CHECKSUM", "CT_MAP_INSERTION_FAILED", "INVALID_IPV6_EXTENSION_HEADER",
    "IP_FRAGMENTATION_NOT_SUPPORTED", "SERVICE_BACKEND_NOT_FOUND", "NO_TUNNEL_OR_ENCAPSULATION_ENDPOINT", "FAILED_TO_INSERT_INTO_PROXYMAP",
    "REACHED_EDT_RATE_LIMITING_DROP_HORIZON", "UNKNOWN_CONNECTION_TRACKING_STATE", "LOCAL_HOST_IS_UNREACHABLE", "UNSUPPORTED_L2_PROTOCOL",
    "NO_MAPPING_FOR_NAT_MASQUERADE", "UNSUPPORTED_PROTOCOL_FOR_NAT_MASQUERADE", "FIB_LOOKUP_FAILED", "ENCAPSULATION_TRAFFIC_IS_PROHIBITED",
    "FIRST_LOGICAL_DATAGRAM_FRAGMENT_NOT_FOUND", "FORBIDDEN_ICMPV6_MESSAGE", "SOCKET_LOOKUP_FAILED", "SOCKET_ASSIGN_FAILED",
    "PROXY_REDIRECTION_NOT_SUPPORTED_FOR_PROTOCOL", "VLAN_FILTERED", "INVALID_VNI", "INVALID_TC_BUFFER", "NO_SID", "MISSING_SRV6_STATE", "NAT46",
    "NAT64", "CT_NO_MAP_FOUND", "SNAT_NO_MAP_FOUND", "INVALID_CLUSTER_ID", "UNSUPPORTED_PROTOCOL_FOR_DSR_ENCAP", "NO_EGRESS_GATEWAY",
    "UNENCRYPTED_TRAFFIC", "NO_NODE_ID", "DROP_RATE_LIMITED", "DROP_NO_EGRESS_IP",
]
# Public documentation of the network plugin, by reason.
HINTS = {
    "CT_MAP_INSERTION_FAILED": "https://docs.cilium.io/en/stable/operations/troubleshooting/#handling-drop-ct-map-insertion-failed",
    "SERVICE_BACKEND_NOT_FOUND": "https://docs.cilium.io/en/stable/operations/troubleshooting/#service-backend-not-found",
    "FIB_LOOKUP_FAILED": "https://docs.cilium.io/en/stable/operations/troubleshooting/#fib-lookup-failed",
    "UNENCRYPTED_TRAFFIC": "https://docs.cilium.io/en/stable/operations/encryption/",
    "NO_EGRESS_GATEWAY": "https://docs.cilium.io/en/stable/network/egress-gateway/egress-gateway-troubleshooting/",
    "DROP_NO_EGRESS_IP": "https://docs.cilium.io/en/stable/network/egress-gateway/egress-gateway-troubleshooting/",
}
#: The reason that stands for none; it is never classified.
UNSET = "DROP_REASON_UNKNOWN"

CLASS_OF = {r: name for name, reasons in (("policy", POLICY), ("transient", TRANSIENT), ("noise", NOISE), ("infra", INFRA)) for r in reasons}
VALID_REASONS = sorted(CLASS_OF)


def reasons(spark: SparkSession) -> DataFrame:
    """The dimension (reason, class, hint): 76 rows, fixed, so it may be broadcast."""
    names = sorted(CLASS_OF)
    table = pa.table({"reason": pa.array(names, pa.string()), "class": pa.array([CLASS_OF[n] for n in names], pa.string()), "hint": pa.array([HINTS.get(n) for n in names], pa.string())})
    return spark.createDataFrame(table)  # a local relation: no task makes it


def with_class(flows: DataFrame, reason: Column) -> DataFrame:
    """``flows`` with drop_class (``unknown`` for reasons not in the dimension) and hint."""
    dim = F.broadcast(reasons(flows.sparkSession).withColumnsRenamed({"reason": "__r", "class": "__c", "hint": "hint"}))
    return flows.join(dim, reason == F.col("__r"), "left").withColumn("drop_class", F.coalesce("__c", F.lit("unknown"))).drop("__r", "__c")


def class_rank(name: Column) -> Column:
    """Order of classes in summaries: infra before transient."""
    return F.when(name == "infra", 1).when(name == "transient", 2).otherwise(3)
