"""Workload labels: which of an endpoint's labels select it, and the name they give it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys and key prefixes that never select, and the keys that select alone, best first.
DENIED_KEYS = [
    "pod-template-hash", "controller-revision-hash", "statefulset.kubernetes.io/pod-name", "job-name", "batch.kubernetes.io/job-name",
    "batch.kubernetes.io/controller-uid", "apps.kubernetes.io/pod-index",
]
DENIED_PREFIXES = ["io.cilium.k8s.", "io.kubernetes.pod.namespace", "io.cilium.k8s.policy."]
PRIORITY_KEYS = ["app.kubernetes.io/name", "app.kubernetes.io/component", "app"]
NAMESPACE_KEY = "io.kubernetes.pod.namespace"
SOURCE = "k8s:"
NAME_LIMIT = 63


def _pairs(labels: Column) -> Column:
    """Key and value of labels that may select, in order; a label without ``=`` has an empty value."""
    own = F.transform(F.filter(F.coalesce(labels, F.array().cast("array<string>")), lambda x: x.startswith(SOURCE)), lambda x: F.substring(x, F.lit(len(SOURCE) + 1), F.length(x)))
    cut = F.transform(own, lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.when(F.instr(x, "=") > 0, F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise("").alias("value")))

    def allowed(p: Column) -> Column:
        keep = ~p["key"].isin(DENIED_KEYS)
        for prefix in DENIED_PREFIXES:
            keep = keep & ~p["key"].startswith(prefix)
        return keep

    return F.filter(cut, allowed)


def _first(pairs: Column, key: str) -> Column:
    return F.get(F.filter(pairs, lambda p: p["key"] == key), F.lit(0))


def _once(value: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of a value that is worked out once a row, however often ``made`` names it."""
    return F.get(F.transform(F.array(value), made), F.lit(0))


def _selected(pairs: Column) -> Column:
    best = F.coalesce(*[_first(pairs, k) for k in PRIORITY_KEYS])
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.when(best.isNotNull(), F.array(best)).otherwise(F.array_sort(last))


def selected_pairs(labels: Column) -> Column:
    """(key, value) that select the endpoint, sorted by key: the first label of the best priority key, else all (the last of a repeated key)."""
    return _once(_pairs(labels), _selected)


def join_pairs(pairs: Column) -> Column:
    """``k=v`` of each, joined by commas."""
    return F.array_join(F.transform(pairs, lambda p: F.concat(p["key"], F.lit("="), p["value"])), ",")


def label_key(labels: Column) -> Column:
    """The selecting labels as text; empty if none selects. A peer's namespace is no part of it."""
    return join_pairs(selected_pairs(labels))


def workload_name(labels: Column) -> Column:
    """Value of the best priority key, else all values sorted and joined by ``-``, else ``unknown``. Joined values are cut to 63 bytes of UTF-8,
    or to the last whole character before that."""
    first = lambda name, n: F.substring(name.cast("binary"), 1, n).cast("string")
    cut = lambda name: F.when(F.octet_length(name) <= NAME_LIMIT, name).otherwise(F.coalesce(*[F.when(F.is_valid_utf8(first(name, n)), first(name, n)) for n in range(NAME_LIMIT, NAME_LIMIT - 4, -1)]))
    joined = lambda pairs: _once(F.array_join(F.array_sort(F.transform(pairs, lambda p: p["value"])), "-"), cut)
    best = lambda pairs: F.coalesce(*[_first(pairs, k)["value"] for k in PRIORITY_KEYS], joined(pairs))
    return _once(_pairs(labels), lambda pairs: F.when(F.size(pairs) == 0, F.lit("unknown")).otherwise(best(pairs)))


def peer_selector(labels: Column, peer_namespace: Column, namespace: Column) -> Column:
    """Selecting labels as text for a policy: with the peer's namespace where it is not the policy's own."""
    other = F.array(F.struct(F.lit(NAMESPACE_KEY).alias("key"), F.coalesce(peer_namespace, F.lit("")).alias("value")))
    own = F.coalesce(peer_namespace, F.lit("")) == namespace
    return _once(selected_pairs(labels), lambda pairs: join_pairs(F.when(own, pairs).otherwise(F.array_sort(F.concat(pairs, other)))))
