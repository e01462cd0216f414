"""Evidence and policy documents read back as rules and atoms, and targets of explain."""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.labels import NAMESPACE_KEY
from ..operators import evidence
from ..operators.policies import DNS_SELECTOR, POLICY
from ..operators.rules import ATOM_KEY

_END = "struct<namespace:string,workload:string,pod:string,ip:string>"
EVIDENCE = (
    "schema_version int, policy struct<name:string,namespace:string,workload:string>,"
    "sessions array<struct<id:string,started_at:timestamp,ended_at:timestamp,source:map<string,string>,flows_ingested:bigint,flows_unhandled:bigint>>,"
    "rules array<struct<key:string,direction:string,peer:struct<type:string,labels:map<string,string>,cidr:string,entity:string>,port:string,protocol:string,"
    "l7:struct<protocol:string,http_method:string,http_path:string,dns_matchname:string>,flow_count:bigint,first_seen:timestamp,last_seen:timestamp,"
    f"contributing_sessions:array<string>,samples:array<struct<time:timestamp,src:{_END},dst:{_END},port:bigint,protocol:string,verdict:string,drop_reason:string>>>>"
)


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Rules of evidence documents, one row each, under the operators' names. Raises for another schema version."""
    docs = spark.read.schema(EVIDENCE).option("multiLine", True).json(path)
    evidence.check_version([r[0] for r in docs.select("schema_version").distinct().limit(2).collect()])
    r = docs.select("policy.namespace", "policy.workload", F.explode("rules").alias("r"))
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("r.peer.labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    http = F.col("r.l7.protocol") == "http"
    return r.select(
        "namespace", "workload", F.col("r.key").alias("rule_key"), "r.direction", F.col("r.peer.type").alias("peer_type"),
        F.coalesce("r.peer.cidr", "r.peer.entity", labels, F.lit("")).alias("peer_key"), "r.port", "r.protocol",
        F.when(http, F.col("r.l7.http_method")).alias("method"), F.when(http, F.col("r.l7.http_path")).alias("path"), F.col("r.l7.dns_matchname").alias("name"),
        "r.flow_count", "r.first_seen", "r.last_seen", F.col("r.contributing_sessions").alias("sessions"), "r.samples",
    )


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of evidence documents, one row each with its place in the document."""
    docs = spark.read.schema(EVIDENCE).option("multiLine", True).json(path)
    return docs.select("policy.namespace", "policy.workload", F.posexplode("sessions").alias("place", "s")).select("namespace", "workload", "place", "s.*")


def target(text: str, prefix: str) -> tuple[str, str]:
    """(namespace, workload) of ``NAMESPACE/WORKLOAD`` or of a policy file that this program wrote."""
    if text.endswith((".yaml", ".yml")):
        body = Path(text).read_text(encoding="utf-8")
        name = re.search(r"^  name: \"?([^\"\n]+)", body, re.M)
        space = re.search(r"^  namespace: \"?([^\"\n]+)", body, re.M)
        if not name or not name[1].startswith(prefix):
            raise ValueError(f"{text} is no policy of this program")
        return (space[1] if space else ""), name[1][len(prefix) :]
    parts = text.split("/")
    if len(parts) != 2 or not all(parts):
        raise ValueError("a target is NAMESPACE/WORKLOAD or a policy file")
    return parts[0], parts[1]


#: Fixed value: the label that names a policy's managing program.
MANAGED_BY = "app.kubernetes.io/managed-by"
ATOMS = ", ".join(f"{k} string" for k in ATOM_KEY) + ", first_seq long, selector string"
ATOM_COLUMNS = [*ATOM_KEY, "first_seq", "selector"]


def _yaml(text: str, path: str) -> list[Any]:
    """Documents of a YAML text. That needs PyYAML; without it this raises, so that nothing stored is overwritten unread."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} was not written from a stored table; reading it needs PyYAML") from e
    return list(yaml.load_all(text, getattr(yaml, "CSafeLoader", yaml.SafeLoader)))


def parse_policy(text: str, path: str) -> dict[str, Any]:
    """A policy document."""
    return next(iter(_yaml(text, path)), None) or {}


def _owned(text: str, path: str, manager: str, prefix: str) -> Iterator[tuple]:
    """Rows of ATOMS for the policies in a file that ``manager`` owns, with the policy's place in the file; one without atoms for a policy that has none."""
    docs = [json.loads(text)] if path.endswith(".json") else _yaml(text, path)
    for place, doc in enumerate(x for d in docs if d for x in (d.get("items") or []) + ([d] if d.get("spec") else [])):
        meta = doc.get("metadata") or {}
        if (meta.get("labels") or {}).get(MANAGED_BY) == manager and str(meta.get("name", "")).startswith(prefix):
            key = meta.get("namespace", ""), meta["name"][len(prefix) :]
            for atom in policy_atoms(doc, *key) or [dict.fromkeys(ATOM_COLUMNS) | dict(zip(POLICY, key, strict=True))]:
                yield *(atom[c] for c in ATOM_COLUMNS), path, place


def live_atoms(spark: SparkSession, path: str, manager: str, prefix: str) -> DataFrame:
    """Atoms of the policies in a cluster that ``manager`` owns: from policy documents (YAML or JSON, single ones or lists, as the cluster's
    own client prints them; a path with wildcards names many, and tasks parse them), or from a Parquet table of atoms. Of policies with equal
    names the last one counts, by file name and place."""
    if not path.endswith((".yaml", ".yml", ".json")):
        return spark.read.parquet(path)
    columns = f"{ATOMS}, file string, place long"
    schema = to_arrow_schema(spark.createDataFrame([], columns).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rows = _owned(row["value"], row["file"], manager, prefix)
                while some := list(itertools.islice(rows, 1000)):
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in some], schema)

    found = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file")).mapInArrow(parse, columns)
    last = F.max(F.struct("file", "place")).over(Window.partitionBy(*POLICY))
    return found.withColumn("__last", last).filter((F.col("__last.file") == F.col("file")) & (F.col("__last.place") == F.col("place")) & F.col("kind").isNotNull()).select(*ATOM_COLUMNS)


def _selectors(endpoints: list[dict[str, Any]]) -> list[str]:
    bare = lambda k: re.sub("^(any|k8s):", "", k)
    return [",".join(sorted(f"{bare(k)}={v}" for k, v in (e.get("matchLabels") or {}).items())) for e in endpoints]


def policy_atoms(doc: dict[str, Any], namespace: str, workload: str) -> list[dict[str, Any]]:
    """Atoms of a policy document, in its order, each once. The rule towards the name service that goes with DNS rules is made anew, so it is left out."""
    out: dict[tuple, dict[str, Any]] = {}
    spec = doc.get("spec") or {}
    for way, side in (("ingress", "from"), ("egress", "to")):
        rules = spec.get(way) or []
        dns = any(r.get("toFQDNs") for r in rules)
        for rule in rules:
            peers = [("entity", e, None) for e in rule.get(f"{side}Entities") or []] + [("cidr", c, None) for c in rule.get(f"{side}CIDR") or []]
            for text in _selectors(rule.get(f"{side}Endpoints") or []):
                peers.append(("endpoint", ",".join(p for p in text.split(",") if not p.startswith(f"{NAMESPACE_KEY}=")), text))
            if dns and any(text == DNS_SELECTOR for _, _, text in peers) and any((p.get("rules") or {}).get("dns") for p in rule.get("toPorts") or []):
                continue
            parts = [("fqdn", "53", "ANY", "", "", f["matchName"]) for f in rule.get("toFQDNs") or []]
            if parts:
                peers = [("endpoint", "", None)]
            else:
                for entry in rule.get("toPorts") or []:
                    for p in entry.get("ports") or []:
                        port = (str(p["port"]), p.get("protocol", "ANY"))
                        parts.append(("port", *port, "", "", ""))
                        parts += [("http", *port, h.get("method", ""), h.get("path", ""), "") for h in (entry.get("rules") or {}).get("http") or []]
                for block in rule.get("icmps") or []:
                    parts += [("icmp", str(f["type"]), "ICMPv6" if f.get("family") == "IPv6" else "ICMPv4", "", "", "") for f in block.get("fields") or []]
            for kind, key, selector in peers:
                for part in parts:
                    values = (namespace, workload, way, kind, key, *part, len(out), selector)
                    out.setdefault(values[: len(ATOM_KEY)], dict(zip(ATOM_COLUMNS, values, strict=True)))
    return list(out.values())
