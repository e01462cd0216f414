"""SQL for DuckDB that returns the rows of each query in ``queries.py``."""

from __future__ import annotations

from .functions.dropclass import CLASS_OF, HINTS

#: The known reasons as rows: reason, class, hint.
_KNOWN = ", ".join(f"('{r}', '{c}', " + (f"'{HINTS[r]}'" if r in HINTS else "null") + ")" for r, c in sorted(CLASS_OF.items()))

_FLOWS = r"""
with e as (select event_id id, ts, user_id u, event_type t from events),
f as (select id, ts, u,
  case when t = 'view' then 'FORWARDED' else 'DROPPED' end verdict,
  case when t = 'error' and id % 3 = 0 then 'CT_MAP_INSERTION_FAILED' when t = 'error' and id % 3 = 1 then 'STALE_OR_UNROUTABLE_IP' when t = 'signup' and id % 17 = 0 then 'NAT_NOT_NEEDED' when t = 'click' and id % 11 = 0 then 'NEW_REASON' else 'POLICY_DENIED' end reason,
  case when id % 23 = 0 then 'TRAFFIC_DIRECTION_UNKNOWN' when id % 2 = 0 then 'INGRESS' else 'EGRESS' end direction,
  case when id % 47 = 0 then '_unknown' else 'node-' || (u % 5) end node,
  id % 29 = 0 no_target, id % 37 = 0 no_peer,
  case when id % 31 = 0 then '' else 'ns-' || (u % 4) end ns0,
  case when id % 93 = 0 then 'unknown' else 'app-' || (u % 10) end workload,
  case when id % 13 = 0 then 'entity' when id % 7 = 0 then 'cidr' else 'endpoint' end peer_type,
  case when id % 13 = 0 then 'host' when id % 7 = 0 then '10.0.' || (u % 3) || '.' || (id % 5) || '/32' else 'app=peer-' || (id % 6) end peer_key,
  case when id % 13 = 0 then 'entity:' when id % 7 = 0 then 'cidr:' else 'ep:' end peer_prefix,
  case when id % 41 = 0 then '' when id % 43 = 0 then 'sctp' when id % 19 = 0 then 'icmpv4' when id % 5 = 0 then 'udp' else 'tcp' end l4
  from e),
c as (select *,
  case reason when 'CT_MAP_INSERTION_FAILED' then 'infra' when 'STALE_OR_UNROUTABLE_IP' then 'transient' when 'NAT_NOT_NEEDED' then 'noise' when 'POLICY_DENIED' then 'policy' else 'unknown' end class,
  case when no_target or direction like 'TRAFFIC%' then '' else ns0 end ns,
  case l4 when 'tcp' then 'TCP' when 'udp' then 'UDP' when 'icmpv4' then 'ICMPv4' end proto,
  case l4 when 'tcp' then (8000 + id % 4)::varchar when 'udp' then '53' when 'icmpv4' then '8' end port,
  case when l4 = 'tcp' and id % 3 = 0 then case when id % 2 = 0 then 'GET' else 'POST' end end method,
  case when l4 = 'tcp' and id % 3 = 0 then '^/api/v' || (u % 3) || '/item\.' || (id % 4) || '$' end path,
  l4 = 'udp' and id % 4 <> 1 is_dns,
  case when l4 = 'udp' and id % 4 <> 1 and direction = 'EGRESS' then 'svc' || (u % 5) || '.example.com' end name
  from f),
d0 as (select *,
  case when direction like 'TRAFFIC%' then 'unknown_direction' when no_target then 'nil_endpoint' when ns = '' and id % 93 = 0 then 'reserved_identity' when ns = '' then 'empty_namespace'
    when l4 = '' then 'no_l4' when no_peer then case when direction = 'INGRESS' then 'nil_source' else 'nil_destination' end when proto is null then 'unknown_protocol'
    when peer_type = 'cidr' and id % 77 = 0 then 'world_no_ip' else 'policy' end key_check
  from c),
d as (select *, case when verdict <> 'DROPPED' then 'non_dropped' when class in ('infra', 'transient', 'noise') then class else key_check end disposition from d0),
o as (select id, ts, ns as namespace, workload, lower(direction) direction, peer_type, peer_key, proto protocol, port, method, path, name, reason,
  case when peer_type = 'endpoint' then peer_key || case when 'ns-' || (id % 3) = ns then '' else ',io.kubernetes.pod.namespace=ns-' || (id % 3) end end selector,
  lower(direction) || ':' || peer_prefix || peer_key || ':' || proto || ':' || port base,
  coalesce(':l7=proto=http,method=' || method || ',path=' || path, ':l7=proto=dns,dns=' || name, '') deep
  from d where disposition = 'policy'),
r as (select *, base as rule_key from o),
r7 as (select *, base || deep as rule_key from o)
"""

_ATOMS = _FLOWS + r""",
a0 as (select namespace, workload, direction, peer_type, peer_key, case when protocol like 'ICMP%' then 'icmp' else 'port' end kind, port, protocol, '' method, '' path, '' name, id, selector from o
  union all select namespace, workload, direction, peer_type, peer_key, 'http', port, protocol, method, path, '', id, selector from o where method is not null
  union all select namespace, workload, direction, peer_type, peer_key, 'fqdn', '53', 'ANY', '', '', name, id, selector from o where method is null and name is not null),
atoms as (select namespace, workload, direction, peer_type, peer_key, kind, port, protocol, method, path, name, min(id) first_seq, arg_min(selector, id) selector from a0 group by all)
"""
_KEY = "namespace, workload, direction, peer_type, peer_key, kind, port, protocol, method, path, name"

_RULES = _ATOMS + r""",
pk as (select namespace, workload, direction, peer_type, peer_key, min(first_seq) begun, arg_min(selector, first_seq) selector from atoms where kind in ('port', 'icmp') group by all),
pr as (select namespace, workload, direction, peer_type, peer_key, case kind when 'port' then 'ports' else 'icmp' end form,
  string_agg(case kind when 'port' then port || '/' || protocol else 'IPv4:' || port end, ',' order by first_seq) body,
  string_agg(case kind when 'port' then protocol || '/' || port else 'IPv4(type=' || port || ')' end, ', ' order by first_seq) words
  from atoms where kind in ('port', 'icmp') group by all),
rl as (select pr.*, pk.selector, row_number() over (partition by namespace, workload, direction order by case peer_type when 'entity' then 0 when 'cidr' then 1 else 2 end, begun, peer_key, case form when 'icmp' then 1 else 0 end) rule_no
  from pr join pk using (namespace, workload, direction, peer_type, peer_key))
"""

_EXPLAIN = _FLOWS + ", x as (select namespace, workload, rule_key, direction, peer_type, peer_key, port, method, path, case when method is null then name end name, count(*)::bigint flow_count, max(ts) last_seen from r7 group by all)"
_DROPS = _FLOWS + r""",
h as (select reason, class, node, case when ns = '' then '_unknown' else ns end || '/' || case when no_target or direction like 'TRAFFIC%' then '_unknown' else workload end workload from d where disposition in ('infra', 'transient')),
hc as (select reason, class, 'reason' dimension, '' as name, count(*)::bigint drops from h group by all
  union all select reason, class, 'node', node, count(*) from h group by all
  union all select reason, class, 'workload', workload, count(*) from h group by all)
"""
_POLICY_LIKE = "('policy', 'no_l4', 'nil_source', 'nil_destination', 'unknown_protocol', 'world_no_ip')"
_REJECTS = "('unknown_direction', 'nil_endpoint', 'reserved_identity', 'empty_namespace', 'no_l4', 'nil_source', 'nil_destination', 'unknown_protocol', 'world_no_ip')"
_OTHER = "case when no_peer then '<nil>' when peer_type = 'entity' then 'reserved:host' when peer_type = 'cidr' then 'reserved:world' else 'ns-' || (id % 3) || '/peer-' || (id % 6) end"
_OWN = "case when no_target then '<nil>' when ns0 <> '' then ns0 || '/' || workload when id % 93 = 0 then 'reserved:host' else 'k8s:app=' || workload end"
_IGNORED = _FLOWS + r""",
g as (select *, case when verdict <> 'DROPPED' then 'non_dropped' when reason = 'NEW_REASON' then 'ignored_reason' when l4 in ('icmpv4', 'sctp') then 'ignored_protocol' else disposition end g from d)
"""


def _attribution(source: str) -> str:
    return _FLOWS + f"select namespace, workload, rule_key, count(*)::bigint flow_count, min(ts) first_seen, max(ts) last_seen from {source} group by all"


def _prints(where: str) -> str:
    return f"select distinct namespace, workload, string_agg(namespace || peer_type || peer_key || direction || coalesce(selector, '') || kind || port || protocol, ';' order by direction, peer_type, peer_key, kind, port, protocol, selector) p from (select namespace, workload, direction, peer_type, peer_key, case when protocol like 'ICMP%' then 'icmp' else 'port' end kind, port, protocol, arg_min(selector, id) selector from o where {where} group by all) group by namespace, workload"


SQL: dict[str, str] = {
    "rule_attribution": _attribution("r"),
    "rule_attribution_l7": _attribution("r7"),
    "rule_samples": _FLOWS + r"""select namespace, workload, rule_key, id seq, row_number() over (partition by namespace, workload, rule_key order by id desc)::bigint place,
  case when direction = 'ingress' then case peer_type when 'endpoint' then 'peer-' || (id % 6) else 'unknown' end else workload end src_workload, reason drop_reason
  from r qualify place <= 3""",
    "dispositions": _FLOWS + "select disposition, count(*)::bigint flows from d group by all",
    "dispositions_ignoring": _IGNORED + "select g disposition, count(*)::bigint flows from g group by all",
    "ignored_flows": _IGNORED + "select case g when 'ignored_reason' then 'reason' else 'protocol' end kind, case g when 'ignored_reason' then reason else l4 end as name, count(*)::bigint flows from g where g like 'ignored%' group by all",
    "unhandled_flows": _FLOWS + f"select disposition reason, count(*)::bigint flows, count(distinct concat_ws('|', case when direction = 'EGRESS' then {_OWN} else {_OTHER} end, case when direction = 'EGRESS' then {_OTHER} else {_OWN} end, coalesce(port, '0'), coalesce(proto, 'unknown'), direction))::bigint distinct_flows from d where disposition in {_REJECTS} group by all",
    "session_stats": _FLOWS + f"select (count(*) filter (where disposition in ('infra', 'transient') or disposition in {_POLICY_LIKE}))::bigint flows_seen, (count(*) filter (where verdict = 'DROPPED' and method is not null))::bigint l7_http_count, (count(*) filter (where verdict = 'DROPPED' and is_dns))::bigint l7_dns_count, 0::bigint ignored_by_reason, 0::bigint ignored_by_protocol, (count(*) filter (where disposition in ('infra', 'transient')))::bigint infra_drop_total, (count(*) filter (where disposition in {_REJECTS}))::bigint flows_unhandled, count(distinct case when disposition in {_POLICY_LIKE} then ns || '/' || workload end)::bigint workloads from d",
    "drop_classes": _FLOWS + "select reason drop_reason, class drop_class, case reason when 'CT_MAP_INSERTION_FAILED' then 'https://docs.cilium.io/en/stable/operations/troubleshooting/#handling-drop-ct-map-insertion-failed' end hint, count(*)::bigint flows from d where verdict = 'DROPPED' group by all",
    "class_sizes": _FLOWS + f"select v.class, count(*)::bigint reasons, count(v.hint)::bigint hints, count(n)::bigint seen, coalesce(sum(n), 0)::bigint flows from (values {_KNOWN}) v(reason, class, hint) left join (select reason, count(*) n from d where verdict = 'DROPPED' group by reason) using (reason) group by v.class",
    "capture_counters": _FLOWS + "select count(*)::bigint lines_read, (count(*) filter (where id % 101 <> 0 and id % 103 <> 0 and id % 107 <> 0 and verdict = 'DROPPED'))::bigint flows_emitted, (count(*) filter (where id % 101 <> 0 and id % 103 <> 0 and id % 107 <> 0 and verdict <> 'DROPPED'))::bigint non_dropped, (count(*) filter (where id % 101 = 0 or (id % 103 <> 0 and id % 107 = 0)))::bigint malformed, (3 * count(*) filter (where id % 101 <> 0 and id % 103 <> 0 and id % 107 = 0))::bigint lost_events from d",
    "capture_round_trip": _FLOWS + "select namespace, workload, rule_key, count(*)::bigint flow_count from r group by all",
    "capture_files": _FLOWS + "select namespace, workload, rule_key, count(*)::bigint flow_count from r group by all",
    "namespace_filter": _FLOWS + "select direction, count(*)::bigint flows from d where verdict = 'DROPPED' and ((not no_target and ns0 in ('ns-1', 'ns-3')) or (not no_peer and peer_type = 'endpoint' and id % 3 = 1)) group by all",
    "lost_by_window": "with w as (select time_bucket(interval '1 hour', ts) window_start, sum(event_id % 5)::bigint lost from events where event_type = 'error' group by 1 having lost > 0) select window_start, lost, (sum(lost) over (order by window_start))::bigint running_total from w",
    "policy_atoms": _ATOMS + f"select {_KEY}, first_seq, selector from atoms",
    "policy_selectors": _FLOWS + f"select ns as namespace, workload, case workload when 'unknown' then '' else 'app=' || workload end selector, 'fs-' || workload policy_name from d where disposition in {_POLICY_LIKE} group by all",
    "policy_rules": _RULES + "select namespace, workload, direction, rule_no, form, peer_type, peer_key, coalesce(selector, '') selector, body from rl",
    "policy_rules_l7": _ATOMS + r""",
p as (select namespace, workload, direction, peer_type, peer_key from atoms where kind = 'port' group by all),
h as (select namespace, workload, direction, peer_type, peer_key, count(*) n from atoms where kind = 'http' group by all),
fq as (select namespace, workload, peer_type, peer_key, count(*) n from atoms where kind = 'fqdn' group by all),
co as (select namespace, workload, count(distinct name) n from atoms where kind = 'fqdn' group by all)
select direction, 'ports' form, h.n is not null per_port, count(*)::bigint rules, 0::bigint as names, coalesce(sum(h.n), 0)::bigint http_rules from p left join h using (namespace, workload, direction, peer_type, peer_key) group by all
union all select direction, 'icmp', false, count(*), 0, 0 from (select distinct namespace, workload, direction, peer_type, peer_key from atoms where kind = 'icmp') group by all
union all select 'egress', 'fqdn', false, count(*), sum(n)::bigint, 0 from fq having count(*) > 0
union all select 'egress', 'companion', false, count(*), sum(n)::bigint, 0 from co having count(*) > 0""",
    "dns_rules": _ATOMS + "select namespace, workload, 'fqdn' form, peer_key, string_agg(name, ',' order by name) as names from atoms where kind = 'fqdn' group by namespace, workload, direction, peer_type, peer_key union all select namespace, workload, 'companion', '', string_agg(distinct name, ',' order by name) from atoms where kind = 'fqdn' group by namespace, workload",
    "rule_comments": _RULES + "select namespace, workload, direction, words || case direction when 'ingress' then ' from ' else ' to ' end || case peer_type when 'entity' then 'entity ' || peer_key when 'cidr' then 'CIDR ' || peer_key else replace(selector, ',', ', ') end as comment from rl",
    "peer_selectors": _FLOWS + "select namespace, peer_key, selector, count(*)::bigint flows from o where peer_type = 'endpoint' group by all",
    "merged_policies": _ATOMS + "select namespace, workload, count(*)::bigint atoms, (count(*) filter (where kind = 'http'))::bigint http, (count(*) filter (where kind = 'fqdn'))::bigint fqdn from atoms group by all",
    "merge_added": _ATOMS + f"select {_KEY} from a0 group by all having count(*) filter (where id % 3 <> 0) = 0",
    "policy_dedup_live": _FLOWS + f", al as ({_prints('true')}), li as ({_prints("namespace = 'ns-1' or (namespace = 'ns-2' and id % 4 < 2)")}), wr as ({_prints("namespace in ('ns-1', 'ns-3')")}) select al.namespace, al.workload, case when li.p is not null then 'skip_live' when wr.p is not null then 'skip_written' else 'write' end disposition from al left join li on al.namespace = li.namespace and al.workload = li.workload and al.p = li.p left join wr on al.namespace = wr.namespace and al.workload = wr.workload and al.p = wr.p",
    "lifetime_keys": _FLOWS + f"""select 'unhandled' kind, count(*)::bigint keys from (select distinct disposition, concat_ws('|', case when direction = 'EGRESS' then {_OWN} else {_OTHER} end, case when direction = 'EGRESS' then {_OTHER} else {_OWN} end, coalesce(port, '0'), coalesce(proto, 'unknown'), direction) k from d where disposition in {_REJECTS}) having count(*) > 0
  union all select 'reserved', count(distinct direction) from d where disposition = 'reserved_identity' having count(*) > 0
  union all select 'workload', count(distinct ns || '/' || workload) from d where disposition = 'policy' having count(*) > 0""",
    "policy_documents": _RULES + "select namespace, workload, words || case direction when 'ingress' then ' from ' else ' to ' end || case peer_type when 'entity' then 'entity ' || peer_key when 'cidr' then 'CIDR ' || peer_key else replace(selector, ',', ', ') end as comment from rl",
    "merged_documents": _ATOMS + "select distinct namespace, workload, direction, case kind when 'fqdn' then 'endpoint' else peer_type end peer_type, case kind when 'fqdn' then '' else peer_key end peer_key, kind, port, protocol, method, path, name from atoms",
    "evidence_documents": _FLOWS + """,
n as (select *, row_number() over (partition by namespace, workload, rule_key order by id desc) place from r)
select namespace, workload, rule_key, count(*)::bigint flow_count, min(ts) first_seen, max(ts) last_seen, 1::bigint sessions, least(count(*), 3)::bigint samples, max(ts) filter (where place <= 3) last_sample from n group by all""",
    "latest_sessions": _FLOWS + f""",
s as (select id % 3 = 0 late, (count(*) filter (where disposition in ('infra', 'transient') or disposition in {_POLICY_LIKE}))::bigint seen, (count(*) filter (where disposition in {_REJECTS}))::bigint un from d group by all),
w as (select namespace, workload, count(distinct id % 3 = 0)::bigint sessions, bool_or(id % 3 = 0) late from o group by all)
select namespace, workload, sessions, seen flows_ingested, un flows_unhandled from w join s using (late)""",
    "evidence_upsert": _FLOWS + r""",
k as (select *, case when id % 3 = 0 then 2 else 1 end s from r),
n as (select *, row_number() over (partition by namespace, workload, rule_key, s order by id desc) place from k),
t as (select namespace, workload, rule_key, max(ts) last_sample, least(count(*), 3)::bigint samples from n where place <= 2 group by all)
select namespace, workload, rule_key, count(*)::bigint flow_count, min(ts) first_seen, max(ts) last_seen, case when count(distinct s) = 2 then 's1,s2' when max(s) = 1 then 's1' else 's2' end sessions, any_value(t.samples) samples, any_value(t.last_sample) last_sample
from k join t using (namespace, workload, rule_key) group by namespace, workload, rule_key""",
    "evidence_sessions": "select 'ns' as namespace, 'app-' || (event_id % 10) workload, 's-' || event_id id, ts started_at from events qualify row_number() over (partition by event_id % 10 order by ts desc, id desc) <= 4",
    "explain_port": _EXPLAIN + " select namespace, workload, rule_key, flow_count from x where direction = 'ingress' and port = '8002' and peer_type = 'endpoint' and peer_key = 'app=peer-2'",
    "explain_cidr": _EXPLAIN + " select namespace, workload, rule_key, flow_count from x where peer_type = 'cidr' and peer_key like '10.0.1.%'",
    "explain_l7": _EXPLAIN + r" select namespace, workload, rule_key, flow_count from x where (method = 'GET' and path = '^/api/v1/item\.0$') or name = 'svc2.example.com'",
    "explain_since": _EXPLAIN + " select namespace, workload, rule_key, last_seen from x where last_seen >= timestamp '2024-01-10'",
    "health_counts": _DROPS + "select * from hc",
    "health_report": _DROPS + "select reason, class, max(drops) filter (where dimension = 'reason')::bigint drops, case reason when 'CT_MAP_INSERTION_FAILED' then 'https://docs.cilium.io/en/stable/operations/troubleshooting/#handling-drop-ct-map-insertion-failed' else '' end remediation, (count(*) filter (where dimension = 'node'))::bigint nodes, (count(*) filter (where dimension = 'workload'))::bigint workloads from hc group by reason, class",
    "health_top": _DROPS + r""",
k as (select *, rank() over (partition by reason, dimension order by drops desc) k, count(*) over (partition by reason, dimension) n from hc where dimension <> 'reason')
select reason, dimension, string_agg(name || ' (' || drops || ')', ', ' order by drops desc, name) || case when max(n) > count(*) then ' (+' || (max(n) - count(*)) || ' more)' else '' end top from k where k <= 3 group by reason, dimension""",
    "health_reasons": _DROPS + "select reason, class, drops from hc where dimension = 'reason'",
    "suggestions": _FLOWS + f""",
t as (select reason[1:(id % length(reason))::bigint] || reason[(id % length(reason) + 2)::bigint:] typed, count(*)::bigint flows from d where verdict = 'DROPPED' group by 1),
n as (select typed, flows, v.reason as name, levenshtein(typed, v.reason)::int distance from t, (values {_KNOWN}) v(reason, class, hint)),
k as (select *, (row_number() over (partition by typed order by distance, name))::int place from n where distance <= least(10, length(typed) // 2 + 2))
select * from k where place <= 3""",
    "range_matches": """
with e as (select event_id id, user_id u from events),
r as (select false v6, case when id % 2 = 0 then 24 else 8 end length, ((u % 256) >> 6) = 1 inside, 10 least_length from e
  union all select true, case id % 3 when 0 then 128 when 1 then 64 else 32 end, ((u % 4096) >> 9) = 5, 39 from e)
select v6, length::int length, count(*)::bigint ranges, (count(*) filter (where inside and length >= least_length))::bigint covered from r group by v6, length""",
    "label_names": "select n_nationkey k, case when least('a', 'b') = 'a' then array_to_string(list_sort(['a', 'b', n_name]), '-') end workload, 'team=' || n_name || ',zone=a' selector from nation",
    "page_paths": r"select page_id, '^' || regexp_replace(case when p = '' then '/' else p end, '([\\.+*?()|\[\]{}^$])', '\\\1', 'g') || '$' path from (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*$', '') p from pages)",
    "output_paths": _FLOWS + f"select ns as namespace, workload, substr(sha256('/policies'), 1, 12) || '/' || ns || '/' || workload || '.json' path from d where disposition in {_POLICY_LIKE} group by all",
}
