"""Command line: replay a capture, follow a folder of captures, explain a policy."""

from __future__ import annotations

import argparse
import json
import re
import signal
import sys
import threading

from pyspark.sql import DataFrame, SparkSession

from .functions import suggest
from .operators import disposition, evidence
from .plans import render, session
from .sources import capture, relay, stored
from .streaming import live


def _spark() -> SparkSession:
    return SparkSession.builder.appName("flowsieve").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _common(p: argparse.ArgumentParser) -> None:
    where = p.add_mutually_exclusive_group()
    where.add_argument("-n", "--namespace", action="append", default=[], help="only flows from or to these namespaces")
    where.add_argument("-A", "--all-namespaces", action="store_true")
    p.add_argument("-o", "--output-dir", default="./policies")
    p.add_argument("--evidence-dir", default="./evidence")
    p.add_argument("--no-evidence", action="store_true")
    p.add_argument("--evidence-samples", type=int, default=10)
    p.add_argument("--evidence-sessions", type=int, default=10)
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--no-diff", action="store_true")
    p.add_argument("--l7", action="store_true")
    p.add_argument("--ignore-protocol", action="append", default=[])
    p.add_argument("--ignore-drop-reason", action="append", default=[])
    p.add_argument("--fail-on-infra-drops", action="store_true")
    p.add_argument("--cluster-dedup", metavar="PATH", help="live policies: documents (.yaml or .json, as the cluster's client lists them) or a Parquet table of atoms")
    p.add_argument("--strict", action="store_true", help="envelopes with unknown fields are malformed")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="flowsieve", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("replay", help="policies from a capture file, folder or - for standard input")
    p.add_argument("capture")
    _common(p)
    p = sub.add_parser("generate", help="policies from flows as they come: from a relay, or captures in a folder")
    p.add_argument("folder", nargs="?")
    p.add_argument("--server", metavar="HOST:PORT", help="a live relay instead of a folder; it is asked for dropped flows of the namespaces only")
    p.add_argument("--flush-interval", default="5 seconds")
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--max-files", type=int, help="files that one flush takes at most")
    p.add_argument("--once", action="store_true", help="stop when all that is in the folder is through")
    _common(p)
    p = sub.add_parser("explain", help="why a policy has its rules")
    p.add_argument("target")
    p.add_argument("-o", "--output-dir", default="./policies")
    p.add_argument("--evidence-dir", default="./evidence")
    way = p.add_mutually_exclusive_group()
    way.add_argument("--ingress", action="store_true")
    way.add_argument("--egress", action="store_true")
    for name in ("--port", "--peer", "--peer-cidr", "--http-method", "--http-path", "--dns-pattern", "--since"):
        p.add_argument(name)
    p.add_argument("--samples-limit", type=int, default=10)
    p.add_argument("--json", action="store_true")
    p.add_argument("--format", choices=["text", "json", "yaml"], default="text")
    return top


def interval(text: str) -> str:
    """``90m`` or ``1h30m`` as an interval of Spark's."""
    names = {"d": "days", "h": "hours", "m": "minutes", "s": "seconds"}
    parts = re.findall(r"(\d+)([dhms])", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"{text!r} is no duration")
    return " ".join(f"{n} {names[u]}" for n, u in parts)


def _options(a: argparse.Namespace, source: dict[str, str]) -> session.Options:
    protocols = disposition.check_protocols(a.ignore_protocol)
    reasons, warnings = suggest.check_reasons(a.ignore_drop_reason)
    for w in warnings:
        print(f"warning: {w}", file=sys.stderr)
    return session.Options(a.output_dir, a.evidence_dir, a.l7, a.dry_run, not a.no_evidence, a.evidence_samples, a.evidence_sessions, reasons, protocols, a.fail_on_infra_drops, color=sys.stdout.isatty(), source=source)


def _show(result: session.Result, diffs: bool) -> int:
    for d in result.diffs if diffs else ():
        print(d, end="")
    print(json.dumps({**result.stats, "policies_written": len(result.written), "policies_skipped": len(result.skipped), "policies_unchanged": len(result.unchanged), "policies_would_write": len(result.diffs)}))
    print(result.health, end="")
    for w in result.warnings:
        print(f"warning: {w}", file=sys.stderr)
    return result.exit_code


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        if a.command == "explain":
            return _explain(a)
        options = _options(a, {"type": "replay", "file": a.capture} if a.command == "replay" else {"type": "live", "server": a.server or a.folder})
        if a.command == "generate" and bool(a.folder) == bool(a.server):
            raise ValueError("generate follows a folder or --server, one of them")
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    spark = _spark()
    known = stored.live_atoms(spark, a.cluster_dedup, options.manager, options.prefix).persist() if a.cluster_dedup else None
    if a.command == "generate":
        return _generate(spark, a, options, known)
    parsed, scan = capture.observed(capture.parse(capture.lines(spark, a.capture), a.strict))
    result = session.run(capture.flows(parsed).filter(capture.in_namespaces(a.namespace)), options, known, scan=scan)
    code = _show(result, not a.no_diff)
    if result.stats["lost_events"]:
        print(f"warning: {result.stats['lost_events']} events lost in all", file=sys.stderr)
    return code


def _generate(spark: SparkSession, a: argparse.Namespace, options: session.Options, known: DataFrame | None) -> int:
    """Follows a relay or folder until a signal to stop; then the batch on its way ends, what has come meanwhile is flushed, and the session is closed."""
    asked, codes, run = threading.Event(), [0], session.Session.begin()
    lines = relay.stream(spark, a.server, a.namespace) if a.server else capture.stream_lines(spark, a.folder, a.max_files)
    more = {"session": run, "live": known, "namespaces": a.namespace, "strict": a.strict}
    show = lambda r: codes.append(_show(r, not a.no_diff))
    before = {s: signal.signal(s, lambda *_: asked.set()) for s in (signal.SIGINT, signal.SIGTERM)} if threading.current_thread() is threading.main_thread() else {}
    try:
        query = live.start(lines, options, a.checkpoint, None if a.once else a.flush_interval, show=show, **more)
        while query.isActive and not asked.is_set():
            query.awaitTermination(0.5)
        if query.isActive:
            live.stop_after_batch(query)
            live.start(lines, options, a.checkpoint, None, show=show, **more).awaitTermination()
        elif query.exception():
            raise query.exception()
        if lost := session.finish(spark, run, options):
            print(f"warning: {lost}", file=sys.stderr)
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
    return max(codes)


def _explain(a: argparse.Namespace) -> int:
    namespace, workload = stored.target(a.target, session.Options().prefix)
    since = interval(a.since) if a.since else None
    spark = _spark()
    path = f"{a.evidence_dir}/{session.output_hash(a.output_dir)}/{namespace}/{workload}.json"
    every = stored.read_evidence(spark, path)
    direction = "ingress" if a.ingress else "egress" if a.egress else None
    found = evidence.explain(every, direction, a.port, a.peer, a.peer_cidr, since, None, a.http_method, a.http_path, a.dns_pattern)
    matched = [r.asDict(recursive=True) for r in evidence.ordered(found).toLocalIterator()]
    form = "json" if a.json else a.format
    sessions = [r.asDict(recursive=True) for r in stored.read_sessions(spark, path).orderBy("place").toLocalIterator()]
    if form == "text":
        listed = [r.asDict(recursive=True) for r in evidence.ordered(every).toLocalIterator()]
        print(render.explain_text(f"{namespace}/{workload}", listed, matched, a.samples_limit, sessions), end="")
        return 0
    doc = {"policy": {"namespace": namespace, "workload": workload}, "sessions": json.loads(json.dumps(sessions, default=str)), "matched_rules": json.loads(json.dumps(matched, default=str))}
    if form == "json":
        print(json.dumps(doc, indent=2, ensure_ascii=False))
    else:
        nulls = lambda v: {k: nulls(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [nulls(x) for x in v] if isinstance(v, list) else v
        print("\n".join(render.to_yaml(nulls(doc))))
    return 0


if __name__ == "__main__":
    sys.exit(main())
