"""Rule matching (E1-E5) and rule maintenance.

Rule tables are user-authored and small, so every lookup is a broadcast
equi-join on the packet side (no shuffle of packets). Each broadcast side is
size-checked first (:func:`_fits`); beyond the bound the join is left to the
planner (shuffle join, or AQE's runtime broadcast).

Wildcard domain rules (``*.rest``) match a name equal to ``rest`` or ending in
``.rest`` (both lower-cased): the name's last k labels are ``rest``, where k is
the number of labels of ``rest``. There are few such k among the rules, so each
is an equi-join of the name's last k labels with the rests of that depth: no
explode, no list of patterns, no cross join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Largest rule table broadcast without question.
MAX_BROADCAST_RULES = 2_000_000


def _fits(df: DataFrame, limit: int = MAX_BROADCAST_RULES) -> bool:
    """True when ``df`` has at most ``limit`` rows (checked, not estimated)."""
    return df.limit(limit + 1).count() <= limit


@dataclass
class RuleTables:
    """Lookup tables derived from one rules table."""

    ips: DataFrame           # (rule_ip string)
    ports: DataFrame         # (rule_port int)
    apps: DataFrame          # (rule_app string)
    domains: DataFrame       # (rule_domain string)
    patterns: DataFrame      # (depth int, rule_rest string 'depth:rest')
    depths: list             # the depths that occur
    unknown_blocked: bool    # is the initial label ('Unknown', '') blocked?
    small: bool = True       # every table fits the broadcast bound

    def side(self, df: DataFrame) -> DataFrame:
        """A lookup table as a join side: broadcast when the bound was checked."""
        return F.broadcast(df) if self.small else df


def rule_tables(rules: DataFrame, materialize: bool = True) -> RuleTables:
    """Lookup tables of a rules table.

    With ``materialize`` the rules are checkpointed once (to the shared
    checkpoint folder), so the five lookup tables and their broadcasts read a
    stored copy instead of re-running the rules-file parse each. Streaming
    passes ``False``: the lookup tables are then re-derived from the rules
    source in every micro-batch, so rule edits reach the next batch.
    """
    if materialize:
        rules = rules.checkpoint(eager=True)
    t = F.col("rule_type")
    ips = rules.where(t == "IP").select(F.col("value").alias("rule_ip")).distinct()
    ports = rules.where(t == "PORT").select(F.col("value").try_cast("int").alias("rule_port")).distinct()
    apps = rules.where(t == "APP").select(F.col("value").alias("rule_app")).distinct()
    domains = (rules.where((t == "DOMAIN") & ~F.col("is_pattern"))
               .select(F.col("value").alias("rule_domain")).distinct())
    rests = (rules.where((t == "DOMAIN") & F.col("is_pattern") & F.col("value").startswith("*."))
             .select(F.lower(F.expr("substr(value, 3)")).alias("rest")))
    # The depth is part of the key and the table stands by itself (stored, small): with filters in sight
    # the planner builds runtime filters for these joins, each with the whole decode inlined.
    depth = F.size(F.split("rest", r"\.", -1))
    patterns = rests.select(depth.alias("depth"), F.concat_ws(":", depth.cast("string"), "rest").alias("rule_rest")).distinct().checkpoint(eager=True)
    depths = sorted(r.depth for r in patterns.select("depth").distinct().collect())  # a name has at most 127 labels
    unknown_blocked = apps.where(F.col("rule_app") == "Unknown").limit(1).count() > 0
    small = _fits(rules)
    return RuleTables(ips, ports, apps, domains, patterns, depths, unknown_blocked, small)


def _flag(df: DataFrame, rt: RuleTables, lookup: DataFrame, left: Column, right: str, flag: str) -> DataFrame:
    """Left join on a precomputed key column; ``flag`` = key found in ``lookup``."""
    k = f"_{flag}_k"
    marked = rt.side(lookup.select(F.col(right).alias(k), F.lit(True).alias(flag)))
    df = df.withColumn(k, left)
    joined = df.join(marked, k, "left").drop(k)
    return joined.withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def mark_ip_port(df: DataFrame, rt: RuleTables, src_ip: str = "src_ip", dest_port: str = "dest_port") -> DataFrame:
    """Adds ``ip_hit`` (E1, source address only) and ``port_hit`` (E2, destination port only)."""
    df = _flag(df, rt, rt.ips, F.col(src_ip), "rule_ip", "ip_hit")
    return _flag(df, rt, rt.ports, F.col(dest_port), "rule_port", "port_hit")


def mark_app_domain(df: DataFrame, rt: RuleTables, app: str, domain: str, prefix: str) -> DataFrame:
    """Adds ``{prefix}app_hit`` (E3) and ``{prefix}domain_hit`` (E4) for a label."""
    d = F.col(domain)
    usable = d.isNotNull() & (d != "")
    dk = f"_{prefix}dom"
    df = df.withColumn(dk, F.when(usable, d))
    df = _flag(df, rt, rt.apps, F.col(app), "rule_app", f"{prefix}app_hit")
    df = _flag(df, rt, rt.domains, F.col(dk), "rule_domain", f"{prefix}domain_hit")
    for k in rt.depths:
        hit = f"_{prefix}wild{k}"
        last = F.concat(F.lit(f"{k}:"), F.substring_index(F.lower(F.col(dk)), ".", -k))
        df = _flag(df, rt, rt.patterns, last, "rule_rest", hit)
        df = df.withColumn(f"{prefix}domain_hit", F.col(f"{prefix}domain_hit") | F.col(hit)).drop(hit)
    return df.drop(dk)


def const_reason(ip_hit: Column, port_hit: Column, src_ip: Column, dest_port: Column) -> Column:
    """Reason from the per-flow constant rules: IP before PORT (E5, first half)."""
    return (F.when(ip_hit, F.struct(F.lit("IP").alias("type"), src_ip.alias("detail")))
            .when(port_hit, F.struct(F.lit("PORT").alias("type"), dest_port.cast("string").alias("detail"))))


def label_reason(app_hit: Column, domain_hit: Column, app: Column, domain: Column) -> Column:
    """Reason from a flow label: APP before DOMAIN (E5, second half)."""
    return (F.when(app_hit, F.struct(F.lit("APP").alias("type"), app.alias("detail")))
            .when(domain_hit, F.struct(F.lit("DOMAIN").alias("type"), domain.alias("detail"))))


def verdict(df: DataFrame, rt: RuleTables, src_ip: str = "src_ip", dest_port: str = "dest_port",
            app: str = "app_type", domain: str = "sni") -> DataFrame:
    """Combined verdict for rows carrying a label (E5): ``block_reason`` struct or NULL."""
    df = mark_ip_port(df, rt, src_ip, dest_port)
    df = mark_app_domain(df, rt, app, domain, "")
    reason = F.coalesce(const_reason(F.col("ip_hit"), F.col("port_hit"), F.col(src_ip), F.col(dest_port)),
                        label_reason(F.col("app_hit"), F.col("domain_hit"), F.col(app), F.col(domain)))
    return df.withColumn("block_reason", reason)


# ---------------------------------------------------------------------------
# Rule maintenance (I1-I4) and counts.
# ---------------------------------------------------------------------------

def add_rules(rules: DataFrame, new: DataFrame) -> DataFrame:
    """Set insert (I1); a domain containing ``*`` is a pattern."""
    new = new.select("rule_type", "value",
                     ((F.col("rule_type") == "DOMAIN") & F.col("value").contains("*")).alias("is_pattern"))
    return rules.unionByName(new).distinct()


def remove_rules(rules: DataFrame, gone: DataFrame) -> DataFrame:
    """Set remove."""
    return rules.join(gone.select("rule_type", "value"), ["rule_type", "value"], "left_anti")


def clear_rules(rules: DataFrame) -> DataFrame:
    """Empty rules table."""
    return rules.limit(0)


def list_rules(rules: DataFrame, rule_type: str) -> DataFrame:
    """Values of one type (I4); domains list exact names and patterns."""
    return rules.where(F.col("rule_type") == rule_type).select("value", "is_pattern")


def rule_counts(rules: DataFrame) -> DataFrame:
    """Rules per type (F10); domains count exact names plus patterns."""
    kinds = rules.sparkSession.createDataFrame([(k,) for k in ("IP", "APP", "DOMAIN", "PORT")], "rule_type string")
    counts = rules.groupBy("rule_type").agg(F.count("*").alias("rule_count"))
    return (kinds.join(counts, "rule_type", "left")
            .select("rule_type", F.coalesce("rule_count", F.lit(0)).cast("bigint").alias("rule_count")))
