"""A whole run over a capture: policies, evidence and health, written next to what is stored.

Everything up to the documents is a DataFrame, and the tasks that hold a policy's rows write its documents (``plans.documents``); the driver gets one line of outcome for each.
State lives in Parquet tables beside the documents (``plans.state``); documents and tables may be on any file system that Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterable, Sequence
from contextlib import ExitStack
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dropclass
from ..operators import disposition, evidence, health, merge, policies, rules
from ..operators.policies import POLICY
from ..operators.rules import ATOM_KEY, RULE
from ..sources import stored
from . import documents, render
from .files import Files
from .state import State


@dataclass(frozen=True)
class Options:
    output_dir: str = "./policies"
    evidence_dir: str = "./evidence"
    l7: bool = False
    dry_run: bool = False
    keep_evidence: bool = True
    samples: int = 10
    sessions: int = 10
    ignore_reasons: Sequence[str] = ()
    ignore_protocols: Sequence[str] = ()
    fail_on_infra_drops: bool = False
    manager: str = "flowsieve"
    prefix: str = "fs-"
    color: bool = False
    source: dict[str, str] = field(default_factory=dict)


#: Seconds between two reports of lost events.
LOSS_PERIOD = 30.0


@dataclass
class Result:
    stats: dict[str, Any] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    diffs: list[str] = field(default_factory=list)
    health: str = ""
    warnings: list[str] = field(default_factory=list)
    exit_code: int = 0


@dataclass
class Session:
    """One run: a replay, or all flushes of a stream. Counters are of the whole run."""

    name: str
    started: datetime
    flows_seen: int = 0
    flows_unhandled: int = 0
    lost: int = 0
    lost_lately: int = 0
    said: float = field(default_factory=time.monotonic)

    def count_lost(self, events: int, now: float | None = None, period: float = LOSS_PERIOD) -> str:
        """Adds events that the source lost; what to say of them, once a period and only if there are any."""
        self.lost, self.lost_lately, now = self.lost + events, self.lost_lately + events, time.monotonic() if now is None else now
        if now - self.said < period:
            return ""
        lately, self.lost_lately, self.said = self.lost_lately, 0, now
        return f"{lately} events lost lately, {self.lost} in all; a larger buffer at the source may help" if lately else ""

    @classmethod
    def begin(cls) -> Session:
        now = datetime.now(UTC)
        return cls(f"{now:%Y-%m-%dT%H:%M:%SZ}-{hashlib.sha256(os.urandom(8)).hexdigest()[:4]}", now)

    def document(self, source: dict[str, str]) -> dict[str, Any]:
        return {"id": self.name, "started_at": self.started.isoformat(), "ended_at": datetime.now(UTC).isoformat(), "source": source, "flows_ingested": self.flows_seen, "flows_unhandled": self.flows_unhandled}


@dataclass(frozen=True)
class Batch:
    """A flush of a stream: which one it is, and the run that it belongs to."""

    stream: str
    number: int
    session: Session


def output_hash(folder: str) -> str:
    """Names an output folder among evidence: twelve digits of its absolute path's SHA-256."""
    return hashlib.sha256((folder if "://" in folder else os.path.abspath(folder)).encode()).hexdigest()[:12]


def _with_documents(tabled: DataFrame, out: str, chosen: DataFrame) -> DataFrame:
    """Stored atoms and those of policy documents that no stored table knows, as another program may have written them. Tasks look for a
    document of each unknown policy and read it."""
    unknown = chosen.select(*POLICY).join(tabled.select(*POLICY).distinct(), POLICY, "left_anti")

    def read(store: Any, namespace: str, workload: str, rows: list[dict[str, Any]]) -> Iterable[tuple]:
        if text := store.read(name := f"{namespace}/{workload}.yaml"):
            for atom in stored.policy_atoms(stored.parse_policy(text, name), namespace, workload):
                yield tuple(atom[c] for c in stored.ATOM_COLUMNS)

    return tabled.unionByName(documents.by_policy(unknown, out, read, stored.ATOMS).select(*tabled.columns))


FINGERPRINTS = T.StructType([T.StructField(c, T.StringType()) for c in (*POLICY, "fingerprint")])


def run(flows: DataFrame, options: Options, live: DataFrame | None = None, batch: Batch | None = None, scan: Observation | None = None) -> Result:
    """Flows to documents. ``live`` has the atoms of policies in the cluster; equal ones are not written again. In a ``batch`` of a stream,
    a policy equal to the one that the stream made last is left alone as well, and keys that the stream saw before count as old. ``scan`` are the counters of
    the lines (``capture.observed``) that the flows come from; the run's first pass fills them."""
    with ExitStack() as held:

        def keep(df: DataFrame) -> DataFrame:
            held.callback(df.unpersist)
            return df.persist()

        return _run(flows, options, live, batch, scan, keep)


def _run(flows: DataFrame, options: Options, live: DataFrame | None, batch: Batch | None, scan: Observation | None, keep: Callable[[DataFrame], DataFrame]) -> Result:
    spark, result = flows.sparkSession, Result()
    session = batch.session if batch else Session.begin()
    out, home = options.output_dir, f"{options.evidence_dir}/{output_hash(options.output_dir)}"
    state = State(spark, out)
    disposed = keep(disposition.dispose(flows, options.ignore_reasons, options.ignore_protocols))
    result.stats = disposition.session_stats(disposed).first().asDict() | (scan.get if scan else {})
    if lost := session.count_lost(result.stats.get("lost_events", 0)):
        result.warnings.append(lost)
    keys = disposition.lifetime_keys(disposed).unionByName(disposition.unknown_reasons(disposed))
    if batch and not options.dry_run:
        keys = keys.join(state.seen(), ["kind", "key"], "left_anti")
        result.stats["keys_first_seen"] = state.add_seen(keys)
    if result.stats.get("keys_first_seen", 1):
        result.warnings += disposition.warnings(keys)
    seen = rules.observations(disposed, options.l7)
    fresh = keep(rules.atoms(seen))
    chosen = keep(policies.selectors(disposed))
    tabled = state.stored("atoms", fresh.schema, ATOM_KEY, chosen)
    merged = keep(merge.merge(keep(_with_documents(tabled, out, chosen)), fresh))  # of the policies that flows reached
    if not options.dry_run:
        state.add(merge.added(tabled, merged), "atoms", ATOM_KEY)
    prints = keep(merge.fingerprints(fresh))
    last = f"written:{batch.stream}" if batch else ""
    written = state.stored(last, FINGERPRINTS, POLICY, chosen)
    fates = merge.dispositions(prints, merge.fingerprints(live if live is not None else fresh.limit(0)), written)
    built = policies.rules(merged)
    full = built.join(policies.comments(built), [*POLICY, "direction", "rule_no"])
    every = chosen.withColumnRenamed("selector", "own_selector").join(fates.select(*POLICY, "disposition"), POLICY, "left").join(full, POLICY, "left")
    made = documents.by_policy(every, out, _policy_document(options), "outcome string, path string, diff string", ["direction", "rule_no"])
    for outcome, path, diff in sorted(made.collect(), key=lambda r: r["path"]):  # a line for each policy
        {"skipped": result.skipped, "unchanged": result.unchanged, "diff": result.diffs, "written": result.written}[outcome].append(diff or path)
    if batch and not options.dry_run:
        state.add(prints.select(*POLICY, "fingerprint"), last, POLICY)
    session.flows_seen += result.stats["flows_seen"]
    session.flows_unhandled += result.stats["flows_unhandled"]
    if options.keep_evidence and not options.dry_run:
        _write_evidence(seen, home, options, session, state, keep)
    _report_health(spark, disposed, home, options, session, result, Files(spark))
    result.exit_code = int(options.fail_on_infra_drops and result.stats["infra_drop_total"] > 0)
    if not options.dry_run:
        state.commit(*(batch.stream, batch.number) if batch else ())
    return result


def _policy_document(options: Options) -> documents.Work:
    """Writes a policy's document where it is to be written and differs; what became of it, and in a dry run the difference."""

    def work(store: Any, namespace: str, workload: str, rows: list[dict[str, Any]]) -> Iterable[tuple]:
        name = f"{namespace}/{workload}.yaml"
        path = f"{options.output_dir}/{name}"
        if (rows[0]["disposition"] or "write") != "write":
            return [("skipped", path, None)]
        own = sorted((r for r in rows if r["rule_no"] is not None), key=lambda r: r["rule_no"])
        text = "\n".join(render.to_yaml(render.policy(namespace, workload, rows[0]["own_selector"], own, options.manager, options.prefix))) + "\n"
        old = render.strip_comments(store.read(name))
        if old == text:
            return [("unchanged", path, None)]
        if options.dry_run:
            return [("diff", path, render.unified(path, old, text, options.color))]
        store.write(name, render.annotate(text, {way: [r["comment"] for r in own if r["direction"] == way] for way in ("ingress", "egress")}))
        return [("written", path, None)]

    return work


def _report_health(spark: SparkSession, disposed: DataFrame, home: str, options: Options, session: Session, result: Result, files: Files) -> None:
    """The summary of drops that no policy causes; by reason alone where no evidence is kept, and written where it is."""
    where, hints = f"{home}/cluster-health.json", dropclass.reasons(spark)
    if not options.keep_evidence:
        alone = health.reasons_only(disposed).join(F.broadcast(hints.select("reason", F.col("hint").alias("remediation"))), "reason", "left")
        result.health = render.health_text([r.asDict() for r in health.summary_order(alone).toLocalIterator()], {}, where, False)
        return
    drops = health.contributors(disposition.drop_events(disposed)).persist()
    summary = [r.asDict(recursive=True) for r in health.summary_order(health.report(drops, hints)).toLocalIterator()]
    tops = {(r["reason"], r["dimension"]): r["top"] for r in health.top_text(drops).toLocalIterator()}
    result.health = render.health_text(summary, tops, where, not options.dry_run)
    if summary and not options.dry_run:
        listed = [{"reason": r["reason"], "class": r["class"], "count": r["drops"], **({"remediation": r["remediation"]} if r["remediation"] else {}), "by_node": r["by_node"], "by_workload": r["by_workload"]} for r in sorted(summary, key=lambda r: r["reason"])]
        about = {"started": session.started.isoformat(), "ended": datetime.now(UTC).isoformat(), "flows_seen": result.stats["flows_seen"], "infra_drops_total": result.stats["infra_drop_total"]}
        files.write(where, json.dumps({"schema_version": 1, "session": about, "drops": listed}, indent=2) + "\n")
    drops.unpersist()


def _with_session(known: list[dict[str, Any]], session: dict[str, Any], most: int) -> list[dict[str, Any]]:
    sessions = sorted([s for s in known if s["id"] != session["id"]] + [session], key=lambda s: s["started_at"])
    return sessions[-most:] if most > 0 else sessions


def _document_text(doc: dict[str, Any]) -> str:
    return json.dumps(doc, indent=2, ensure_ascii=False) + "\n"


def _write_evidence(seen: DataFrame, home: str, options: Options, session: Session, state: State, keep: Callable[[DataFrame], DataFrame]) -> None:
    fresh = evidence.session_rules(rules.attribution(seen), rules.samples(seen, options.samples), session.name)
    name = f"rules:{home}"
    full = keep(evidence.upsert(state.stored(name, fresh.schema, RULE, fresh), fresh, options.samples))  # all rules of the policies that flows reached
    state.add(full.join(fresh.select(*RULE), RULE, "left_semi"), name, RULE, home)
    now, most, prefix = session.document(options.source), options.sessions, options.prefix

    def work(store: Any, namespace: str, workload: str, rows: list[dict[str, Any]]) -> Iterable[tuple]:
        file = f"{namespace}/{workload}.json"
        known = json.loads(store.read(file) or '{"sessions": []}')["sessions"]
        about = {"name": prefix + workload, "namespace": namespace, "workload": workload}
        listed = [_rule_json(r) for r in sorted(rows, key=lambda r: (r["direction"], r["rule_key"]))]
        store.write(file, _document_text({"schema_version": evidence.SCHEMA_VERSION, "policy": about, "sessions": _with_session(known, now, most), "rules": listed}))
        return [(1,)]

    documents.by_policy(full, home, work, "documents int", ["direction", "rule_key"]).count()


#: The part of stored rules that says which sessions they come from.
NAMED = T.StructType([*(T.StructField(c, T.StringType()) for c in RULE), T.StructField("sessions", T.ArrayType(T.StringType()))])


def finish(spark: SparkSession, session: Session, options: Options) -> str:
    """Gives every evidence document of a run the run's last counters: those of policies with a stored rule that names the run. What to say of events lost in all."""
    home = f"{options.evidence_dir}/{output_hash(options.output_dir)}"
    if options.keep_evidence and not options.dry_run and session.flows_seen:
        rows = State(spark, options.output_dir).stored(f"rules:{home}", NAMED, RULE).filter(F.array_contains("sessions", session.name))
        now, most = session.document(options.source), options.sessions

        def work(store: Any, namespace: str, workload: str, rows: list[dict[str, Any]]) -> Iterable[tuple]:
            doc = json.loads(store.read(file := f"{namespace}/{workload}.json"))
            doc["sessions"] = _with_session(doc["sessions"], now, most)
            store.write(file, _document_text(doc))
            return [(1,)]

        documents.by_policy(rows.select(*POLICY).distinct(), home, work, "documents int").count()
    return f"{session.lost} events lost in all" if session.lost else ""


def _time(t: datetime | None) -> str | None:
    return None if t is None else (t.astimezone(UTC) if t.tzinfo else t.replace(tzinfo=UTC)).isoformat().replace("+00:00", "Z")


def _rule_json(r: dict[str, Any]) -> dict[str, Any]:
    kind = r["peer_type"]
    peer: dict[str, Any] = {"type": kind}
    if kind == "endpoint":
        peer["labels"] = dict(p.split("=", 1) for p in r["peer_key"].split(",") if p)
    else:
        peer[kind] = r["peer_key"]
    doc: dict[str, Any] = {"key": r["rule_key"], "direction": r["direction"], "peer": peer, "port": r["port"], "protocol": r["protocol"]}
    if r["method"]:
        doc["l7"] = {"protocol": "http", "http_method": r["method"], "http_path": r["path"]}
    elif r["name"]:
        doc["l7"] = {"protocol": "dns", "dns_matchname": r["name"]}
    samples = [{**s, "time": _time(s["time"])} for s in r["samples"]]
    return doc | {"flow_count": r["flow_count"], "first_seen": _time(r["first_seen"]), "last_seen": _time(r["last_seen"]), "contributing_sessions": r["sessions"], "samples": samples}
