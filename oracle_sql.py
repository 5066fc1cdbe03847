"""DuckDB oracle for the fixture capture.

The oracle never sees bytes: it derives each packet's frame length and label
candidate from the fixture columns, then walks every flow packet by packet
with a recursive CTE (the engine's sequential state machine), independent of
the window form the Spark side uses.
"""

from __future__ import annotations

from netsift.plans.catalog import FILE_PACKETS, RULE_CHANGES
from netsift.plans.fixture import FIXTURE_SQL, URL_HOST_RX
from netsift.schema import HOST_KEYWORDS

# Rules of the fixture (same text as FIXTURE_RULES_TEXT), as SQL predicates.
IP_RULES = ("10.0.0.5",)
PORT_RULES: tuple[int, ...] = ()
APP_RULES = ("GitHub",)
EXACT_DOMAINS = ("www.youtube.com", "www.facebook.com")
PATTERN_RESTS = ("ads.example.org",)

# Extra rules used by the single-rule queries (blocked_by_*, rule_verdict).
EXTRA_IP_RULES = ("10.0.0.5", "10.0.1.7")
EXTRA_PORT_RULES = (8080,)
EXTRA_APP_RULES = ("GitHub", "Twitter/X")
EXTRA_EXACT_DOMAINS = ("www.youtube.com", "mail.google.com")
EXTRA_PATTERN_RESTS = ("ads.example.org", "example.net")


def _in(col: str, values) -> str:
    if not values:
        return "FALSE"
    return f"{col} IN ({', '.join(repr(v) if isinstance(v, str) else str(v) for v in values)})"


def host_app_sql(h: str) -> str:
    parts = " ".join(f"WHEN strpos(lower({h}), '{k}') > 0 THEN '{a}'" for k, a in HOST_KEYWORDS)
    return f"(CASE WHEN {h} IS NULL THEN 'Unknown' {parts} ELSE 'Unknown' END)"


def domain_hit_sql(d: str, exact=EXACT_DOMAINS, rests=PATTERN_RESTS) -> str:
    wild = " OR ".join(f"(lower({d}) = '{r}' OR ends_with(lower({d}), '.{r}'))" for r in rests) or "FALSE"
    return f"(COALESCE({d}, '') <> '' AND ({_in(d, exact)} OR {wild}))"


def packets_cte(key_extra: str = "", idle_s: int | None = None, max_flows: int | None = None) -> str:
    """CTEs ``fx`` (fixture columns) and ``pk`` (with lengths and candidate)."""
    fx = FIXTURE_SQL.strip()
    cand_route = ("CASE WHEN payload_kind = 'tls' THEN 'TLS' WHEN payload_kind = 'http' THEN 'HTTP' "
                  "WHEN payload_kind = 'dns' THEN 'DNS' "
                  "WHEN payload_kind = 'opaque' AND dest_port IN (80, 443) THEN 'PORT' END")
    return f"""
fx AS ({fx}),
pk0 AS (
  SELECT *,
    CAST(CASE payload_kind WHEN 'tls' THEN 61 + strlen(host) WHEN 'http' THEN 26 + strlen(host)
         WHEN 'dns' THEN 18 + strlen(host) WHEN 'opaque' THEN 8 ELSE 0 END AS INTEGER) AS payload_length,
    {cand_route} AS cand_route,
    epoch_us(ts) AS ts_us{key_extra}
  FROM fx),
pk AS (
  SELECT *,
    CAST(CASE WHEN protocol = 17 THEN 42 ELSE 54 END + payload_length AS INTEGER) AS frame_length,
    CASE WHEN cand_route IN ('TLS', 'HTTP') THEN host WHEN cand_route = 'DNS' THEN host
         WHEN cand_route = 'PORT' THEN '' END AS cand_sni,
    CASE WHEN cand_route IN ('TLS', 'HTTP') THEN {host_app_sql('host')} WHEN cand_route = 'DNS' THEN 'DNS'
         WHEN cand_route = 'PORT' AND dest_port = 80 THEN 'HTTP' WHEN cand_route = 'PORT' THEN 'HTTPS' END AS cand_app
  FROM pk0){_instances(idle_s)}{_table(max_flows)}"""


def _instances(idle_s: int | None) -> str:
    if not idle_s:
        return ""
    k = "src_ip, dest_ip, src_port, dest_port, protocol"
    return f""",
pk_i AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {k} ORDER BY packet_no) > {idle_s * 1_000_000}
                        THEN 1 ELSE 0 END AS gap FROM pk),
pk_j AS (SELECT * EXCLUDE (gap), CAST(sum(gap) OVER (PARTITION BY {k} ORDER BY packet_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS flow_instance FROM pk_i)"""


def _table(n: int | None) -> str:
    """A table of n flows: a flow was pushed out if n others were seen since its last
    packet, each counted by the first packet it has after that one."""
    if not n:
        return ""
    k = "src_ip, dest_ip, src_port, dest_port, protocol"
    return f""",
pk_p AS (SELECT *, lag(packet_no) OVER (PARTITION BY {k} ORDER BY packet_no) AS prev FROM pk),
pk_o AS (SELECT p.packet_no, count(*) AS others FROM pk_p p JOIN pk_p o
         ON o.packet_no > p.prev AND o.packet_no < p.packet_no AND coalesce(o.prev, -1) < p.prev GROUP BY p.packet_no),
pk_j AS (SELECT pk_p.* EXCLUDE (prev), CAST(sum(CASE WHEN coalesce(others, 0) >= {n} THEN 1 ELSE 0 END) OVER (
           PARTITION BY {k} ORDER BY packet_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS flow_instance
         FROM pk_p LEFT JOIN pk_o USING (packet_no))"""


def fixed_rules(app: str, sni: str) -> list[tuple[str, str, str]]:
    """(kind, detail, predicate) of the fixture's rules, in the order they are checked."""
    return [("IP", "src_ip", _in("src_ip", IP_RULES)), ("PORT", "CAST(dest_port AS VARCHAR)", _in("dest_port", PORT_RULES)),
            ("APP", app, _in(app, APP_RULES)), ("DOMAIN", sni, domain_hit_sql(sni))]


def changing_rules(app: str, sni: str) -> list[tuple[str, str, str]]:
    """The same under RULE_CHANGES: each value with the seconds of the capture in which it is a rule."""
    first = [("IP", v) for v in IP_RULES] + [("APP", v) for v in APP_RULES] + [("DOMAIN", v) for v in EXACT_DOMAINS] + [("DOMAIN", f"*.{r}") for r in PATTERN_RESTS]
    spans = {rule: [[None, None]] for rule in first}
    for s, op, kind, value in RULE_CHANGES:
        mine = spans.setdefault((kind, value), [])
        if op == "add" and not (mine and mine[-1][1] is None):
            mine.append([s, None])
        elif op == "remove" and mine and mine[-1][1] is None:
            mine[-1][1] = s
    out = {"IP": [], "PORT": [], "APP": [], "DOMAIN": []}
    for (kind, value), times in spans.items():
        same = {"IP": f"src_ip = '{value}'", "PORT": f"dest_port = {value}" if kind == "PORT" else "", "APP": f"{app} = '{value}'",
                "DOMAIN": domain_hit_sql(sni, (), (value[2:],)) if value.startswith("*.") else f"{sni} = '{value}'"}[kind]
        for lo, hi in times:
            out[kind].append(f"({same}" + (f" AND rel_us >= {lo}000000" if lo is not None else "") + (f" AND rel_us < {hi}000000" if hi is not None else "") + ")")
    detail = {"IP": "src_ip", "PORT": "CAST(dest_port AS VARCHAR)", "APP": app, "DOMAIN": sni}
    return [(k, detail[k], "(" + (" OR ".join(p) or "FALSE") + ")") for k, p in out.items()]


REL_US = ",\n    epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM fx) AS rel_us"


def walk_cte(key: str = "src_ip, dest_ip, src_port, dest_port, protocol", source: str = "pk", changing: bool = False,
             closes: bool = False) -> str:
    """CTEs ``seq`` and ``walk``: the per-flow sequential state machine. Under
    changing rules a blocked flow keeps the reason it was blocked for.

    ``walk`` has one row per packet (pos >= 1) with the flow state after it.
    """
    keys = [k.strip() for k in key.split(",")]
    on = " AND ".join(f"n.{k} = w.{k}" for k in keys)
    wk = ", ".join(f"w.{k}" for k in keys)
    tcp = "n.protocol = 6"
    A = f"({tcp} AND (n.tcp_flags & 16) <> 0)"
    S = f"({tcp} AND (n.tcp_flags & 2) <> 0)"
    Fn = f"({tcp} AND (n.tcp_flags & 1) <> 0)"
    R = f"({tcp} AND (n.tcp_flags & 4) <> 0)"
    rules = (changing_rules if changing else fixed_rules)("app2", "sni2")
    kept = "WHEN blocked_now THEN {} " if changing else ""
    kind_of = " ".join(f"WHEN {hit} THEN '{kind}'" for kind, _, hit in rules)
    detail_of = " ".join(f"WHEN {hit} THEN {detail}" for _, detail, hit in rules)
    any_hit = " OR ".join(hit for _, _, hit in rules)
    rel = "n.rel_us" if changing else "0 AS rel_us"
    state = "(CASE WHEN n.pos > 1 AND n.called THEN 'CLOSED' ELSE w.state END)" if closes else "w.state"
    return f"""
seq AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY packet_no) AS pos FROM {source}),
walk AS (
  SELECT {key}, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS packet_no,
         'NEW' AS state, 'Unknown' AS app_type, '' AS sni, FALSE AS syn, FALSE AS sa, FALSE AS fin,
         CAST(NULL AS VARCHAR) AS action, CAST(NULL AS VARCHAR) AS drop_cause,
         CAST(NULL AS VARCHAR) AS reason_type, CAST(NULL AS VARCHAR) AS reason_detail,
         FALSE AS assigned, FALSE AS rule_block, FALSE AS inspected, CAST(NULL AS VARCHAR) AS route,
         CAST(0 AS BIGINT) AS flow_bytes, CAST(NULL AS BIGINT) AS ts_us, 0 AS frame_length,
         CAST(NULL AS VARCHAR) AS cand_app
  FROM (SELECT DISTINCT {key} FROM {source})
  UNION ALL
  SELECT {key}, pos, packet_no,
         CASE WHEN blocked_now OR rule_hit THEN 'BLOCKED' ELSE s2 END AS state,
         app2 AS app_type, sni2 AS sni, syn, sa, fin,
         CASE WHEN blocked_now OR rule_hit THEN 'DROP' ELSE 'FORWARD' END AS action,
         CASE WHEN rule_hit THEN 'RULE' WHEN blocked_now THEN 'STATE' END AS drop_cause,
         CASE WHEN blocked_now OR rule_hit THEN rtype END AS reason_type,
         CASE WHEN blocked_now OR rule_hit THEN rdetail END AS reason_detail,
         assign AS assigned, rule_hit AS rule_block, inspect AS inspected, route,
         flow_bytes, ts_us, frame_length, cand_app
  FROM (
    SELECT *,
      CASE {kept.format('prev_rt')}{kind_of} END AS rtype,
      CASE {kept.format('prev_rd')}{detail_of} END AS rdetail,
      (NOT blocked_now AND ({any_hit})) AS rule_hit
    FROM (
      SELECT *,
        CASE WHEN assign THEN 'CLASSIFIED' ELSE s1 END AS s2,
        CASE WHEN assign THEN cand_app ELSE prev_app END AS app2,
        CASE WHEN assign THEN cand_sni ELSE prev_sni END AS sni2,
        CASE WHEN assign THEN cand_route END AS route
      FROM (
        SELECT *,
          (inspect AND cand_route IS NOT NULL) AS assign
        FROM (
          SELECT *,
            (s1 = 'BLOCKED') AS blocked_now,
            (s1 <> 'BLOCKED' AND s1 <> 'CLASSIFIED' AND payload_length > 0) AS inspect
          FROM (
            SELECT {wk}, n.pos, n.packet_no, n.payload_length, n.cand_route, n.cand_app, n.cand_sni,
              w.app_type AS prev_app, w.sni AS prev_sni, w.reason_type AS prev_rt, w.reason_detail AS prev_rd, {rel},
              w.syn OR ({S} AND NOT {A}) AS syn,
              w.sa OR ({S} AND {A}) AS sa,
              w.fin OR {Fn} AS fin,
              CASE WHEN {R} OR ((w.fin OR {Fn}) AND {A}) THEN 'CLOSED'
                   WHEN {tcp} AND {state} = 'NEW' AND (w.syn OR ({S} AND NOT {A})) AND (w.sa OR ({S} AND {A})) AND {A}
                     THEN 'ESTABLISHED'
                   ELSE {state} END AS s1,
              w.flow_bytes + n.frame_length AS flow_bytes, n.ts_us, n.frame_length
            FROM walk w JOIN seq n ON {on} AND n.pos = w.pos + 1
          ) a
        ) b
      ) c
    ) d
  ) e
),
v AS (SELECT * FROM walk WHERE pos > 0)"""


#: Payload bytes of a fixture packet, from its kind and host alone.
_PAYLOAD_BLOB = """(CASE payload_kind
  WHEN 'tls' THEN unhex('160301' || printf('%04X', length(host) + 56) || '01' || printf('%06X', length(host) + 52) || '0303'
    || repeat('00', 32) || '00' || '00021301' || '0100' || printf('%04X', length(host) + 9) || '0000' || printf('%04X', length(host) + 5)
    || printf('%04X', length(host) + 3) || '00' || printf('%04X', length(host)) || hex(host))
  WHEN 'http' THEN unhex(hex('GET / HTTP/1.1' || chr(13) || chr(10) || 'Host: ' || host || chr(13) || chr(10) || chr(13) || chr(10)))
  WHEN 'dns' THEN unhex('000101000001000000000000' || array_to_string(list_transform(string_split(host, '.'),
    lambda x: printf('%02X', length(x)) || hex(x)), '') || '0000010001')
  WHEN 'opaque' THEN unhex(repeat('00', 8)) ELSE unhex('') END)"""

K5 = "src_ip, dest_ip, src_port, dest_port, protocol"


def with_walk(body: str, key_extra: str = "", key: str = K5, idle_s: int | None = None, max_flows: int | None = None,
              changing: bool = False, closes: bool = False) -> str:
    source = "pk_c" if closes else "pk_j" if idle_s or max_flows else "pk"
    return (f"WITH RECURSIVE {packets_cte(key_extra, idle_s, max_flows)}{CLOSES if closes else ''},"
            f"{walk_cte(key, source, changing, closes)}\n{body}")


def with_packets(body: str, key_extra: str = "") -> str:
    return f"WITH {packets_cte(key_extra)}\n{body}"


#: The operator's close calls, and whether any lies between a packet and the one before it in its flow.
CLOSES = f""",
span AS (SELECT {K5}, min(packet_no) AS lo, max(packet_no) AS hi FROM pk GROUP BY ALL),
calls AS (SELECT {K5}, (lo + hi) // 2 + 1 AS call_no FROM span
          UNION ALL SELECT {K5}, hi + 1 FROM span WHERE dest_port = 80),
pk_l AS (SELECT *, lag(packet_no) OVER (PARTITION BY {K5} ORDER BY packet_no) AS prev FROM pk),
pk_c AS (SELECT p.* EXCLUDE (prev), EXISTS (SELECT 1 FROM calls c WHERE c.src_ip = p.src_ip AND c.dest_ip = p.dest_ip
           AND c.src_port = p.src_port AND c.dest_port = p.dest_port AND c.protocol = p.protocol
           AND c.call_no > p.prev AND c.call_no <= p.packet_no) AS called FROM pk_l p)"""


LAST_ROW = "row_number() OVER (PARTITION BY {k} ORDER BY pos DESC) = 1"


def _final(key: str = K5) -> str:
    return f"""fl AS (SELECT {key}, state, app_type, sni, count(*) OVER w AS packets_out,
                 CAST(sum(frame_length) OVER w AS BIGINT) AS bytes_out,
                 ts_us AS last_seen_us, pos, max(pos) OVER w AS last_pos
               FROM v WINDOW w AS (PARTITION BY {key})),
f AS (SELECT * FROM fl WHERE pos = last_pos)"""


def _app_breakdown(key: str = K5) -> str:
    return f""", {_final(key)},
a AS (SELECT app_type, count(*) AS flows FROM f WHERE state <> 'CLOSED' GROUP BY app_type)
SELECT app_type, flows, round(100.0 * flows / sum(flows) OVER (), 1) AS share_pct FROM a"""


def _flag_names() -> str:
    parts = ", ".join(f"CASE WHEN (tcp_flags & {b}) <> 0 THEN '{n}' END"
                      for n, b in (("SYN", 2), ("ACK", 16), ("FIN", 1), ("RST", 4), ("PSH", 8), ("URG", 32)))
    return f"CASE WHEN concat_ws(' ', {parts}) = '' THEN 'none' ELSE concat_ws(' ', {parts}) END"


def _ip_long(c: str) -> str:
    return " | ".join(f"(CAST(split_part({c}, '.', {i + 1}) AS BIGINT) << {8 * i})" for i in range(4))


def _reason(ips, ports, apps, exact, rests, app: str, dom: str) -> tuple[str, str]:
    t = (f"CASE WHEN {_in('src_ip', ips)} THEN 'IP' WHEN {_in('dest_port', ports)} THEN 'PORT' "
         f"WHEN {_in(app, apps)} THEN 'APP' WHEN {domain_hit_sql(dom, exact, rests)} THEN 'DOMAIN' END")
    d = (f"CASE WHEN {_in('src_ip', ips)} THEN src_ip WHEN {_in('dest_port', ports)} THEN CAST(dest_port AS VARCHAR) "
         f"WHEN {_in(app, apps)} THEN {app} WHEN {domain_hit_sql(dom, exact, rests)} THEN {dom} END")
    return t, d


def _rules_values(rows) -> str:
    vals = ", ".join(f"('{t}', '{v}', {'TRUE' if p else 'FALSE'})" for t, v, p in rows)
    return f"SELECT * FROM (VALUES {vals}) AS r(rule_type, value, is_pattern)"


FIXTURE_RULE_ROWS = [("IP", "10.0.0.5", False), ("APP", "GitHub", False),
                     ("DOMAIN", "www.youtube.com", False), ("DOMAIN", "www.facebook.com", False),
                     ("DOMAIN", "*.ads.example.org", True)]

_MAC_SRC, _MAC_DST = "02:00:00:00:00:01", "0a:1b:2c:3d:4e:5f"
_RV_T, _RV_D = _reason(EXTRA_IP_RULES, EXTRA_PORT_RULES, EXTRA_APP_RULES, EXTRA_EXACT_DOMAINS,
                       EXTRA_PATTERN_RESTS, "cand_app", "cand_sni")


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}
    q["packet_totals"] = with_packets(
        "SELECT count(*) AS total_packets, CAST(sum(frame_length) AS BIGINT) AS total_bytes, "
        "count_if(protocol = 6) AS tcp_packets, count_if(protocol = 17) AS udp_packets FROM pk")
    q["action_totals"] = with_walk(
        "SELECT count_if(action = 'FORWARD') AS forwarded, count_if(action = 'DROP') AS dropped FROM v")
    q["drop_rate"] = with_walk(
        "SELECT count(*) AS total_packets, count_if(action = 'DROP') AS dropped, "
        "round(100.0 * count_if(action = 'DROP') / count(*), 2) AS drop_rate FROM v")
    q["admitted_packets"] = with_packets(
        f"SELECT packet_no, ts_us, {K5}, CASE WHEN protocol = 6 THEN tcp_flags END AS tcp_flags, 64 AS ttl, "
        f"'{_MAC_SRC}' AS src_mac, '{_MAC_DST}' AS dest_mac, frame_length, payload_length, "
        "CASE WHEN payload_length > 0 THEN frame_length - payload_length ELSE 0 END AS payload_offset FROM pk")
    q["flow_keys"] = with_packets(f"SELECT {K5}, min(packet_no) AS first_packet_no FROM pk GROUP BY ALL")
    q["flow_counters"] = with_packets(
        f"SELECT {K5}, count(*) AS packets, CAST(sum(frame_length) AS BIGINT) AS bytes, "
        "min(ts_us) AS first_seen_us, max(ts_us) AS last_seen_us FROM pk GROUP BY ALL")
    q["running_counters"] = with_walk("SELECT packet_no, pos AS flow_packets, flow_bytes FROM v")
    q["protocol_names"] = with_packets(
        "SELECT protocol, CASE protocol WHEN 1 THEN 'ICMP' WHEN 6 THEN 'TCP' WHEN 17 THEN 'UDP' "
        "ELSE 'Unknown(' || protocol || ')' END AS protocol_name, count(*) AS packets FROM pk GROUP BY protocol")
    q["tcp_flag_names"] = with_packets(
        f"SELECT tcp_flags, {_flag_names()} AS flag_names, count(*) AS packets FROM pk WHERE protocol = 6 "
        "GROUP BY tcp_flags")
    q["ip_to_long"] = with_packets(f"SELECT DISTINCT src_ip, {_ip_long('src_ip')} AS ip_long FROM pk")
    q["long_to_ip"] = with_packets("SELECT DISTINCT dest_ip, dest_ip AS ip_text FROM pk")
    q["host_app"] = with_packets(
        "SELECT DISTINCT cand_sni AS host, cand_app AS app FROM pk WHERE cand_route IN ('TLS', 'HTTP')")
    q["packet_candidates"] = with_packets(
        "SELECT packet_no, cand_app, cand_sni, cand_route FROM pk WHERE cand_route IS NOT NULL")
    q["tls_sni"] = with_packets("SELECT packet_no, host AS sni FROM pk WHERE payload_kind = 'tls'")
    q["quic_sni"] = with_packets("SELECT packet_no, host AS sni FROM pk WHERE payload_kind = 'tls'")
    q["http_host"] = with_packets("SELECT packet_no, host FROM pk WHERE payload_kind = 'http'")
    q["dns_name"] = with_packets("SELECT packet_no, host AS name FROM pk WHERE payload_kind = 'dns'")
    q["blocked_by_ip"] = with_packets(
        f"SELECT src_ip, count(*) AS packets FROM pk WHERE {_in('src_ip', EXTRA_IP_RULES)} GROUP BY src_ip")
    q["blocked_by_port"] = with_packets(
        f"SELECT dest_port, count(*) AS packets FROM pk WHERE {_in('dest_port', EXTRA_PORT_RULES)} GROUP BY dest_port")
    q["blocked_by_app"] = with_packets(
        f"SELECT cand_app, count(*) AS packets FROM pk WHERE cand_route IS NOT NULL "
        f"AND {_in('cand_app', EXTRA_APP_RULES)} GROUP BY cand_app")
    q["blocked_by_domain"] = with_packets(
        f"SELECT cand_sni, count(*) AS packets FROM pk WHERE cand_route IS NOT NULL "
        f"AND {domain_hit_sql('cand_sni', EXTRA_EXACT_DOMAINS, EXTRA_PATTERN_RESTS)} GROUP BY cand_sni")
    q["rule_verdict"] = with_packets(
        f"SELECT packet_no, {_RV_T} AS reason_type, {_RV_D} AS reason_detail FROM pk "
        f"WHERE cand_route IS NOT NULL AND ({_RV_T}) IS NOT NULL")
    q["packet_verdicts"] = with_walk(
        f"SELECT packet_no, {K5}, state, action, app_type, sni, drop_cause, reason_type, reason_detail FROM v")
    q["stream_verdicts"] = with_walk(
        f"SELECT ts_us, {K5}, state, action, app_type, sni, drop_cause, reason_type, reason_detail FROM v")
    q["stream_growing_verdicts"] = q["stream_verdicts"]
    q["stream_totals"] = q["packet_totals"]
    q["tcp_states"] = with_walk("SELECT state, count(*) AS packets FROM v GROUP BY state")
    q["split_flow_verdicts"] = with_walk(
        f"SELECT packet_no, {K5}, state, action, app_type, sni, drop_cause, reason_type, reason_detail, "
        "pos AS flow_packets, flow_bytes FROM v")
    q["block_events"] = with_walk(
        f"SELECT packet_no, {K5}, reason_type, reason_detail FROM v WHERE drop_cause = 'RULE'")
    q["final_flows"] = with_walk(f", {_final()}\nSELECT {K5}, state, app_type, sni, packets_out, bytes_out FROM f")
    q["closed_override"] = with_walk(
        f", {_final()}\nSELECT {K5}, CASE WHEN protocol = 17 THEN 'CLOSED' ELSE state END AS state FROM f")
    q["closed_verdicts"] = with_walk(
        f"SELECT packet_no, {K5}, state, action, app_type, sni, drop_cause, rule_block, reason_type, reason_detail FROM v", closes=True)
    q["closed_flows"] = with_walk(
        f", {_final()}\nSELECT {K5}, CASE WHEN dest_port = 80 OR last_called THEN 'CLOSED' ELSE state END AS state, app_type, sni, "
        f"packets_out, bytes_out FROM f JOIN (SELECT {K5}, (lo + hi) // 2 + 1 > hi AS last_called FROM span) USING ({K5})", closes=True)
    q["flow_totals"] = with_walk(
        f", {_final()}\nSELECT (SELECT count_if(state <> 'CLOSED') FROM f) AS active_flows, "
        "(SELECT count(*) FROM f) AS total_seen, count_if(assigned) AS classified, "
        "count_if(rule_block) AS blocked FROM v")
    q["app_breakdown"] = with_walk(_app_breakdown())
    q["top_domains"] = with_walk(
        f", {_final()}\nSELECT sni, CASE WHEN length(sni) > 35 THEN substr(sni, 1, 32) || '...' ELSE sni END "
        "AS label, count(*) AS flows FROM f WHERE state <> 'CLOSED' AND sni <> '' GROUP BY sni "
        "ORDER BY flows DESC, sni LIMIT 20")
    q["top_domains_pages"] = (
        "WITH h AS (SELECT regexp_extract(url, '" + URL_HOST_RX + "', 1) AS sni FROM pages) "
        "SELECT sni, CASE WHEN length(sni) > 35 THEN substr(sni, 1, 32) || '...' ELSE sni END AS label, "
        "count(*) AS flows FROM h WHERE sni <> '' GROUP BY sni ORDER BY flows DESC, sni LIMIT 20")
    q["inspection_metrics"] = with_walk(
        "SELECT count(*) AS processed, count_if(action = 'FORWARD') AS forwarded, "
        "count_if(action = 'DROP') AS dropped, count_if(assigned AND route = 'TLS') AS sni_extractions, "
        "count_if(assigned AND ((route = 'TLS' AND cand_app NOT IN ('Unknown', 'HTTPS')) "
        "OR (route = 'HTTP' AND cand_app NOT IN ('Unknown', 'HTTP')))) AS classification_hits FROM v")
    q["recent_flows"] = with_walk(
        f", {_final()}\nSELECT {K5}, last_seen_us FROM f ORDER BY last_seen_us DESC, {K5} LIMIT 100")
    q["idle_split_flows"] = with_walk(
        f", {_final(K5 + ', flow_instance')}\nSELECT {K5}, flow_instance, state, app_type, sni, packets_out FROM f",
        key=K5 + ", flow_instance", idle_s=300)
    q["evicting_verdicts"] = with_walk(
        f"SELECT packet_no, {K5}, flow_instance, state, action, app_type, sni, drop_cause, pos AS flow_packets FROM v",
        key=K5 + ", flow_instance", max_flows=60)
    q["versioned_rule_verdicts"] = with_walk(
        f"SELECT packet_no, {K5}, state, action, app_type, sni, drop_cause, reason_type, reason_detail FROM v",
        key_extra=REL_US, changing=True)
    q["stream_versioned_rules"] = with_walk(
        f"SELECT ts_us, {K5}, state, action, app_type, sni, drop_cause, reason_type, reason_detail FROM v",
        key_extra=REL_US, changing=True)
    q["evicted_flows"] = f"WITH {packets_cte(max_flows=60)} SELECT {K5}, max(flow_instance) AS returns FROM pk_j GROUP BY ALL"
    q["merged_captures"] = q["app_breakdown"]  # each flow's protocol puts it in one of the two captures
    q["split_capture_scan"] = with_packets(
        f"SELECT row_number() OVER (ORDER BY packet_no) - 1 AS packet_no, ts_us, {K5}, "
        "CASE WHEN protocol = 6 THEN tcp_flags END AS tcp_flags, frame_length, sha256(" + _PAYLOAD_BLOB + ") AS payload_sha256 FROM pk")
    q["stream_idle_flows"] = with_walk(
        f"SELECT ts_us, {K5}, state, action, app_type, sni, drop_cause, pos AS flow_packets, flow_bytes FROM v",
        key=K5 + ", flow_instance", idle_s=300)
    q["pages_blocked_by_wildcard"] = (
        "WITH h AS (SELECT page_id, regexp_extract(url, '" + URL_HOST_RX + "', 1) AS host FROM pages), "
        "n AS (SELECT page_id, unnest([upper(host), 'a.b.' || host, 'x' || host]) AS name FROM h WHERE host <> '') "
        "SELECT page_id, name, EXISTS (SELECT 1 FROM h WHERE host <> '' AND (lower(name) = lower(host) "
        "OR ends_with(lower(name), '.' || lower(host)))) AS blocked FROM n")
    q["rule_rejected_values"] = with_packets(
        ", h AS (SELECT DISTINCT regexp_extract(url, '" + URL_HOST_RX + "', 1) AS v FROM pages), "
        "i AS (SELECT DISTINCT src_ip AS v FROM pk) "
        "SELECT 'APP' AS rule_type, v AS raw_value, 'unknown application' AS error FROM h WHERE v <> '' UNION ALL "
        "SELECT 'PORT', v, 'not a port number' FROM h WHERE v <> '' UNION ALL "
        "SELECT 'IP', v, 'not an IPv4 address' FROM h WHERE v <> '' UNION ALL "
        "SELECT 'APP', v, 'unknown application' FROM i")
    q["rules_clear"] = ("SELECT rule_type, CAST(0 AS BIGINT) AS rule_count "
                        "FROM (VALUES ('IP'), ('APP'), ('DOMAIN'), ('PORT')) AS t(rule_type)")
    q["forwarded_packets"] = with_walk("SELECT packet_no, frame_length FROM v WHERE action = 'FORWARD'")
    # One file for each chunk; the magic is a little-endian file's first four bytes read big-endian, d4c3b2a1.
    q["capture_headers"] = with_walk(
        "SELECT 3569595041 AS magic, 2 AS version_major, 4 AS version_minor, 0 AS thiszone, 0 AS sigfigs, "
        "65535 AS snaplen, 1 AS link_type, 'little' AS byte_order, NULL AS error "
        f"FROM (SELECT DISTINCT packet_no // {FILE_PACKETS} FROM v WHERE action = 'FORWARD')")
    q["capture_roundtrip"] = with_walk(
        f"SELECT v.ts_us, v.src_ip, v.dest_ip, v.src_port, v.dest_port, v.protocol, "
        "CASE WHEN v.protocol = 6 THEN pk.tcp_flags END AS tcp_flags, v.frame_length "
        "FROM v JOIN pk USING (packet_no) WHERE v.action = 'FORWARD'")
    q["stream_forwarded"] = q["capture_roundtrip"]
    q["reverse_lookup"] = with_walk(
        f", {_final()}\nSELECT dest_ip AS src_ip, src_ip AS dest_ip, dest_port AS src_port, src_port AS dest_port, "
        "protocol, 'reverse' AS match, app_type, packets_out FROM f UNION ALL "
        f"SELECT {K5}, 'forward' AS match, app_type, packets_out FROM f WHERE protocol = 17")
    q["bidirectional_flows"] = with_packets(
        f"SELECT {K5}, count(*) AS packets_out, CAST(sum(frame_length) AS BIGINT) AS bytes_out, "
        "count(*) AS packets_in, CAST(sum(frame_length) AS BIGINT) AS bytes_in FROM pk GROUP BY ALL")
    q["flow_sessions"] = with_packets(
        f", g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER (PARTITION BY {K5} ORDER BY ts_us) >= 300000000 "
        f"THEN 1 ELSE 0 END AS brk FROM pk), "
        f"s AS (SELECT *, sum(brk) OVER (PARTITION BY {K5} ORDER BY ts_us ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS sid FROM g) "
        f"SELECT {K5}, min(ts_us) AS first_seen_us, max(ts_us) + 300000000 AS session_end_us, count(*) AS packets, "
        f"CAST(sum(frame_length) AS BIGINT) AS bytes FROM s GROUP BY {K5}, sid")
    q["stream_flow_sessions"] = (f"WITH s AS ({q['flow_sessions']}) SELECT * FROM s WHERE session_end_us <= "
                                 "(SELECT max(epoch_us(ts)) // 1000 * 1000 - 3600000000 FROM events)")
    q["stream_window_totals"] = with_packets(
        ", d AS (SELECT *, ts_us // 86400000000 * 86400000000 AS window_start_us FROM pk) "
        "SELECT window_start_us, window_start_us + 86400000000 AS window_end_us, count(*) AS packets, CAST(sum(frame_length) AS BIGINT) AS bytes, "
        "count_if(protocol = 6) AS tcp_packets, count_if(protocol = 17) AS udp_packets FROM d "
        "GROUP BY window_start_us HAVING window_start_us + 86400000000 <= (SELECT max(ts_us) // 1000 * 1000 - 86400000000 FROM pk)")
    q["callback_block_events"] = with_walk(f"SELECT ts_us, {K5}, reason_type, reason_detail FROM v WHERE drop_cause = 'RULE'")
    q["visited_flows"] = with_walk(
        f", {_final()}\nSELECT state, count(*) AS flows, CAST(sum(packets_out) AS BIGINT) AS packets FROM f GROUP BY state")
    dr = with_packets(
        ", ev AS (SELECT * FROM events), pg AS (SELECT page_id, regexp_extract(url, '" + URL_HOST_RX + "', 1) AS h "
        "FROM pages), dr0 AS (" + _rules_values(FIXTURE_RULE_ROWS) + " UNION "
        "SELECT 'DOMAIN', h, FALSE FROM pg WHERE h <> '' UNION "
        "SELECT 'DOMAIN', '*.' || h, TRUE FROM pg WHERE h <> '' UNION "
        "SELECT 'IP', pk.src_ip, FALSE FROM pk UNION "
        "SELECT 'PORT', CAST(event_id % 40 + 1000 AS VARCHAR), FALSE FROM ev) "
        "SELECT rule_type, value, is_pattern FROM dr0")
    q["rule_counts"] = (f"WITH d AS ({dr}), k AS (SELECT * FROM (VALUES ('IP'), ('APP'), ('DOMAIN'), ('PORT')) "
                        "AS t(rule_type)) SELECT k.rule_type, CAST(count(d.value) AS BIGINT) AS rule_count "
                        "FROM k LEFT JOIN d USING (rule_type) GROUP BY k.rule_type")
    q["rules_add"] = (f"SELECT * FROM ({dr}) UNION SELECT * FROM (VALUES ('IP', '10.0.0.9', FALSE), "
                      "('DOMAIN', '*.example.net', TRUE), ('DOMAIN', 'www.youtube.com', FALSE)) AS t(rule_type, value, is_pattern)")
    q["rules_remove"] = (f"SELECT * FROM ({dr}) d WHERE NOT (d.rule_type = 'DOMAIN' AND (d.value = 'www.facebook.com' "
                         "OR d.value IN (SELECT regexp_extract(url, '" + URL_HOST_RX + "', 1) FROM pages "
                         "WHERE starts_with(url, 'https:'))))")
    change = ", ".join(f"({s}, {op == 'add'}, '{k}', '{v}')" for s, op, k, v in RULE_CHANGES)
    q["versioned_rule_spans"] = (
        f"WITH c AS (SELECT * FROM (VALUES {change}) AS t(at_s, is_on, rule_type, value)), "
        "n AS (SELECT at_s, row_number() OVER (ORDER BY at_s)::INTEGER AS version FROM (SELECT DISTINCT at_s FROM c)), "
        f"e AS (SELECT rule_type, value, 0 AS version, TRUE AS is_on FROM ({dr}) UNION ALL SELECT rule_type, value, version, is_on FROM c JOIN n USING (at_s)), "
        "t AS (SELECT *, coalesce(lag(is_on) OVER w, FALSE) AS was FROM e WINDOW w AS (PARTITION BY rule_type, value ORDER BY version)), "
        "s AS (SELECT *, lead(version) OVER (PARTITION BY rule_type, value ORDER BY version) AS nxt FROM t WHERE is_on <> was) "
        "SELECT rule_type, value, version AS lo, coalesce(nxt, (SELECT count(*) FROM n) + 1)::INTEGER AS hi FROM s WHERE is_on")
    q["rules_list"] = f"SELECT value, is_pattern FROM ({dr}) WHERE rule_type = 'DOMAIN'"
    q["rules_roundtrip"] = dr
    return q
