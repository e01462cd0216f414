"""Builders of capture lines for tests."""

import json

PEER, OWN = ["k8s:app=client", "k8s:pod-template-hash=x1"], ["k8s:app=server", "k8s:io.kubernetes.pod.namespace=prod"]


def line(n=0, way="INGRESS", port=8080, proto="TCP", own=OWN, own_ns="prod", peer=PEER, peer_ns="default", ip=("", ""), verdict="DROPPED", reason=None, identity=0, l7=None, **extra):
    mine = None if own is None else {"labels": own, "namespace": own_ns, "pod_name": "p"}
    other = None if peer is None else {"labels": peer, "namespace": peer_ns, "identity": identity}
    l4 = None if proto is None else {proto: {"type" if proto.startswith("ICMP") else "destination_port": port}}
    flow = {"time": f"2026-01-01T00:00:{n:02d}Z", "verdict": verdict, "traffic_direction": way, "IP": {"source": ip[0], "destination": ip[1]}, "node_name": "node-1"}
    flow |= {"source": other, "destination": mine} if way != "EGRESS" else {"source": mine, "destination": other}
    flow |= {k: v for k, v in (("l4", l4), ("l7", l7), ("drop_reason_desc", reason)) if v is not None} | extra
    return json.dumps({"flow": flow})


def http(method, url):
    return {"type": "REQUEST", "http": {"method": method, "url": url}}


def dns(query):
    return {"type": "REQUEST", "dns": {"query": query, "qtypes": ["A"]}}
