"""Stored evidence of rules: upserts with caps, and the filters that explain a rule."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rules import RULE

SCHEMA_VERSION = 2
PARTS = ["direction", "peer_type", "peer_key", "port", "protocol", "method", "path", "name"]


def session_rules(attributed: DataFrame, samples: DataFrame, session: str) -> DataFrame:
    """Rules of one session as evidence rows: RULE, PARTS, flow_count, first_seen, last_seen, sessions, samples (oldest first)."""
    lists = samples.groupBy(*RULE).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "sample"))), lambda x: x["sample"]).alias("samples"))
    none = lists.schema["samples"].dataType.simpleString()
    return attributed.join(lists, RULE, "left").withColumns({"sessions": F.array(F.lit(session)), "samples": F.coalesce("samples", F.array().cast(none))}).select(*RULE, *PARTS, "flow_count", "first_seen", "last_seen", "sessions", "samples")


def cap_samples(samples: Column, n: int) -> Column:
    """The newest ``n`` by time, oldest first; all for n <= 0. Equal times keep their order."""
    placed = F.array_sort(F.transform(samples, lambda s, i: F.struct(s["time"].alias("t"), i.alias("i"), s.alias("s"))))
    plain = F.transform(placed, lambda x: x["s"])
    return plain if n <= 0 else F.slice(plain, F.greatest(F.size(plain) - n + 1, F.lit(1)), n)


def upsert(stored: DataFrame, fresh: DataFrame, max_samples: int = 10) -> DataFrame:
    """Stored and fresh rules by key: counts add up, times widen, sessions join without repeats, samples stay capped; stored rules that do not recur stay."""
    tagged = stored.withColumn("__n", F.lit(0)).unionByName(fresh.withColumn("__n", F.lit(1)))
    in_order = lambda c: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("__n", F.col(c).alias("v")))), lambda x: x["v"]))
    merged = tagged.groupBy(*RULE).agg(
        *[F.min_by(p, "__n").alias(p) for p in PARTS],
        F.sum("flow_count").alias("flow_count"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.array_distinct(in_order("sessions")).alias("sessions"),
        cap_samples(in_order("samples"), max_samples).alias("samples"),
    )
    return merged.select(*RULE, *PARTS, "flow_count", "first_seen", "last_seen", "sessions", "samples")


def upsert_sessions(stored: DataFrame, session: DataFrame, max_sessions: int = 10) -> DataFrame:
    """Sessions (namespace, workload, id, started_at, ...) with equal ids replaced; over the cap, the newest by start stay."""
    kept = stored.join(session.select("namespace", "workload", "id"), ["namespace", "workload", "id"], "left_anti").unionByName(session)
    if max_sessions <= 0:
        return kept
    place = F.row_number().over(Window.partitionBy("namespace", "workload").orderBy(F.desc("started_at"), F.desc("id")))
    return kept.withColumn("__k", place).filter(F.col("__k") <= max_sessions).drop("__k")


def ordered(rules: DataFrame) -> DataFrame:
    return rules.orderBy("namespace", "workload", "direction", "rule_key")


def _ipv4(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda n, o: n * 256 + F.coalesce(o.try_cast("long"), F.lit(0)))


def _ipv6(address: Column) -> Column:
    """The 32 hex digits of an IPv6 address; null for what is none."""
    bare = F.lower(F.substring_index(address, "%", 1))
    octets = F.transform(F.split(F.substring_index(bare, ":", -1), r"\."), lambda o: o.try_cast("int"))
    pair = lambda i: F.hex((F.get(octets, F.lit(i)) * 256 + F.get(octets, F.lit(i + 1))).cast("long"))
    plain = F.when(F.contains(bare, F.lit(".")), F.concat(F.regexp_replace(bare, r"[^:]*$", ""), F.lower(pair(0)), F.lit(":"), F.lower(pair(2)))).otherwise(bare)
    sides = F.split(plain, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(side, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.get(sides, F.lit(0))), groups(F.get(sides, F.lit(1)))
    missing = F.lit(8) - F.size(left) - F.size(right)
    whole = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    good = F.when(F.size(sides) == 1, missing == 0).otherwise((F.size(sides) == 2) & (missing >= 1)) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def in_cidr(rule_cidr: Column, wanted: str) -> Column:
    """The rule's range starts in ``wanted`` and is no wider; false for what is no range of the same version. Expressions only."""
    import ipaddress

    net = ipaddress.ip_network(wanted, strict=False)
    address, length = F.substring_index(rule_cidr, "/", 1), F.substring_index(rule_cidr, "/", -1).try_cast("int")
    if net.version == 4:
        shift = 32 - net.prefixlen
        inside = F.shiftright(_ipv4(address), shift) == (int(net.network_address) >> shift)
        return F.coalesce(address.rlike(r"^\d{1,3}(\.\d{1,3}){3}$") & inside & length.between(net.prefixlen, 32), F.lit(False))
    digits, (whole, bits), want = _ipv6(address), divmod(net.prefixlen, 4), f"{int(net.network_address):032x}"
    inside = F.substring(digits, 1, whole) == want[:whole] if whole else digits.isNotNull()
    if bits:
        inside = inside & (F.shiftright(F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int"), 4 - bits) == int(want[whole], 16) >> (4 - bits))
    return F.coalesce(F.contains(rule_cidr, F.lit(":")) & inside & length.between(net.prefixlen, 128), F.lit(False))


def explain(
    rules: DataFrame, direction: str | None = None, port: str | None = None, peer: str | None = None, peer_cidr: str | None = None, since: str | None = None,
    now: datetime | None = None, http_method: str | None = None, http_path: str | None = None, dns_pattern: str | None = None,
) -> DataFrame:
    """Rules that meet every filter given. ``peer`` is KEY=VALUE; ``since`` an interval such as ``10 minutes`` before ``now``; rules never seen pass it.
    Rules without L7 parts do not meet an L7 filter."""
    tests: list[Column] = []
    if direction:
        tests.append(F.col("direction") == direction)
    if port:
        tests.append(F.col("port") == port)
    if peer:
        if "=" not in peer:
            raise ValueError("a peer is KEY=VALUE")
        tests.append((F.col("peer_type") == "endpoint") & F.array_contains(F.split("peer_key", ","), peer))
    if peer_cidr:
        tests.append((F.col("peer_type") == "cidr") & in_cidr(F.when(F.col("peer_type") == "cidr", F.col("peer_key")), peer_cidr))
    if since:
        at = F.lit(now) if now else F.current_timestamp()
        tests.append(F.col("last_seen").isNull() | (F.col("last_seen") >= at - F.expr(f"INTERVAL {since}")))
    if http_method:
        tests.append(F.col("method") == http_method.strip().upper())
    if http_path:
        tests.append(F.col("path") == http_path)
    if dns_pattern:
        tests.append(F.col("name") == dns_pattern.strip().removesuffix("."))
    for t in tests:
        rules = rules.filter(t)
    return rules


def check_version(versions: Sequence[int]) -> None:
    wrong = [v for v in versions if v != SCHEMA_VERSION]
    if wrong:
        raise ValueError(f"evidence of schema version {wrong[0]} is not supported (want {SCHEMA_VERSION})")
