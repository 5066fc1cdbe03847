"""Per-packet label candidate (G4) with its rule check.

A candidate is what inspecting one packet would assign to its flow:
``struct(app, sni, route)`` from, in order, the TLS SNI, the HTTP Host, the
DNS question, or the destination-port fallback (80 -> HTTP, 443 -> HTTPS with
an empty name). It is a pure function of the packet, computed before the flow
shuffle, and its payload is dropped right after, so only narrow rows travel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.functions.hosts import candidate_gate, candidate_udf
from netsift.functions.names import host_app
from netsift.operators.rules import RuleTables, label_reason, mark_app_domain


def with_candidates(packets: DataFrame) -> DataFrame:
    """Adds the candidate as flat columns ``cand_app``, ``cand_sni``, ``cand_route``.

    Native gates pick the payloads that can yield a name (ClientHello, HTTP
    request, DNS query); only those cross to Python, where one Arrow-batched
    parser returns ``(sni, route)``. The port fallback and the keyword ->
    application mapping are native. ``cand_route`` is NULL without a candidate.
    """
    dport, sport, n = F.col("dest_port"), F.col("src_port"), F.col("payload_length")
    present = (n > 0) & F.col("payload").isNotNull()                              # C3
    df = packets.withColumn("_head", F.when(present, F.col("payload").substr(1, 6)))
    gate = candidate_gate(F.col("_head"), n, dport, sport)                          # C4-C9
    df = df.withColumn("_gated", F.when(gate, F.col("payload")))
    df = df.withColumn("_x", candidate_udf(F.col("_gated"), dport, sport))
    fallback = F.when(present & (dport == 80), "HTTP").when(present & (dport == 443), "HTTPS")
    route = F.coalesce(F.col("_x.route"), F.when(fallback.isNotNull(), "PORT"))
    name = F.coalesce(F.col("_x.sni"), F.when(fallback.isNotNull(), ""))
    app = (F.when(F.col("_x.route").isin("TLS", "HTTP"), host_app(F.col("_x.sni")))
           .when(F.col("_x.route") == "DNS", "DNS").otherwise(fallback))
    return (df.withColumns({"cand_route": route, "cand_sni": name, "cand_app": app})
            .drop("_head", "_gated", "_x"))


def check_candidates(df: DataFrame, rt: RuleTables) -> DataFrame:
    """Adds ``cand_blk`` (E3 or E4 hit on the candidate) and ``cand_reason``."""
    df = mark_app_domain(df, rt, "cand_app", "cand_sni", "c_")
    has = F.col("cand_route").isNotNull()
    reason = label_reason(F.col("c_app_hit"), F.col("c_domain_hit"), F.col("cand_app"), F.col("cand_sni"))
    return (df.withColumn("cand_reason", F.when(has, reason))
            .withColumn("cand_blk", has & (F.col("c_app_hit") | F.col("c_domain_hit")))
            .drop("c_app_hit", "c_domain_hit"))
