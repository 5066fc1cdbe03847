"""Report tables.

Totals are global aggregates (partial per task, one tiny final merge). Group
reports aggregate first and only then order/limit, so no step holds more than
the grouped rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netsift.functions.names import domain_label, percent
from netsift.operators.flowstate import state_left
from netsift.schema import FLOW_KEY, TOP_DOMAINS_N


def packet_totals(packets: DataFrame) -> DataFrame:
    """Admitted packets, captured bytes, TCP and UDP packets (F1)."""
    return packets.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.coalesce(F.sum("frame_length"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if("has_tcp").alias("tcp_packets"),
        F.count_if(~F.col("has_tcp") & F.col("has_udp")).alias("udp_packets"),
    )


def action_totals(verdicts: DataFrame) -> DataFrame:
    """Forwarded and dropped packets (F2)."""
    return verdicts.agg(F.count_if(F.col("action") == "FORWARD").alias("forwarded"),
                        F.count_if(F.col("action") == "DROP").alias("dropped"))


def packet_stats(verdicts: DataFrame) -> DataFrame:
    """The packet report: F1, F2 and the drop rate (F3, 2 decimals, NULL when no packets)."""
    t = verdicts.agg(
        F.count(F.lit(1)).alias("total_packets"),
        F.coalesce(F.sum("frame_length"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.count_if("has_tcp").alias("tcp_packets"),
        F.count_if(~F.col("has_tcp") & F.col("has_udp")).alias("udp_packets"),
        F.count_if(F.col("action") == "FORWARD").alias("forwarded"),
        F.count_if(F.col("action") == "DROP").alias("dropped"),
    )
    return t.withColumn("drop_rate", percent("dropped", "total_packets", 2, zero_as_null=True))


def active_flows(flows: DataFrame) -> DataFrame:
    """Flows still in the table at the end: CLOSED flows are removed."""
    return flows.where(F.col("state") != "CLOSED")


def flow_stats(verdicts: DataFrame) -> DataFrame:
    """Active flows, flows seen, label assignments and block transitions.

    One pass over the verdicts: a flow is seen at its first packet and is
    active when its last packet leaves it in a state other than CLOSED.
    """
    return verdicts.agg(
        F.count_if(F.col("last_in_flow") & (state_left(verdicts) != "CLOSED")).alias("active_flows"),
        F.count_if(F.col("flow_packets") == 1).alias("total_seen"),
        F.count_if("assigned").alias("classified"),
        F.count_if("rule_block").alias("blocked"),
    )


def app_breakdown(flows: DataFrame) -> DataFrame:
    """Active flows per application with share in percent, 1 decimal."""
    counts = active_flows(flows).groupBy("app_type").agg(F.count(F.lit(1)).alias("flows"))
    # At most one row per application label: the global window is tiny.
    total = F.sum("flows").over(Window.partitionBy())
    return (counts.withColumn("share_pct", percent(F.col("flows"), total, 1, zero_as_null=False))
            .orderBy(F.desc("flows"), "app_type"))


def domain_counts(flows: DataFrame) -> DataFrame:
    """Active flows per non-empty name, case kept."""
    named = active_flows(flows).where(F.col("sni").isNotNull() & (F.col("sni") != ""))
    return named.groupBy("sni").agg(F.count(F.lit(1)).alias("flows"))


def top_domains(flows: DataFrame, n: int = TOP_DOMAINS_N) -> DataFrame:
    """Top ``n`` names by flow count, ties by name, with the report label (H1, H3)."""
    top = domain_counts(flows).orderBy(F.desc("flows"), "sni").limit(n)
    return top.select("sni", domain_label("sni").alias("label"), "flows")


def inspection_metrics(verdicts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Processed, forwarded, dropped, SNI extractions, classification hits."""
    aggs = [F.count(F.lit(1)).alias("processed"),
            F.count_if(F.col("action") == "FORWARD").alias("forwarded"),
            F.count_if(F.col("action") == "DROP").alias("dropped"),
            F.count_if("sni_extraction").alias("sni_extractions"),
            F.count_if("classification_hit").alias("classification_hits")]
    return verdicts.groupBy(*by).agg(*aggs) if by else verdicts.agg(*aggs)


def block_events(verdicts: DataFrame) -> DataFrame:
    """One event per packet that newly blocked its flow."""
    return (verdicts.where(F.col("drop_cause") == "RULE")
            .select(*FLOW_KEY, "packet_no", "ts", "ts_us",
                    F.col("block_reason.type").alias("reason_type"),
                    F.col("block_reason.detail").alias("reason_detail")))
