"""Rules that change while a capture runs (J6): each packet is checked against the
rules that are valid at its time, and so is the label its flow got earlier.

``changes`` has (valid_from_us, op, rule_type, value): from that time on the value
is a rule (op 'add') or isn't any more ('remove'); rules that are there from the
beginning come as a rules table. What counts is the packet's own time, so packets
out of order find the rules of their time. Of changes of one value at one time an
addition wins.

The distinct change times number the versions. A rule value then has spans of
versions in which it is valid, and one row; a packet looks up its address, port and
label by equi-joins, as with constant rules, and gets their spans.

A flow is blocked at the first packet of an epoch at which its address, its port or
the label in force is blocked, and stays so to the epoch's end, whatever is
removed. A label can be refused because the flow was already blocked by the label
before it, at the times of the packets between; that depends on the label before,
and so on. Only epochs' summaries take part in that: for each epoch with a
candidate the versions of the packets before it, and the candidate's spans. They
are walked in order, one row held at a time; packets never are.
"""

from __future__ import annotations

import json
import sys
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netsift.operators.candidates import with_candidates
from netsift.operators.flowstate import INIT_APP, INIT_SNI, _Scan, epochs, verdict_rows, with_closes
from netsift.operators.rules import MAX_BROADCAST_RULES, _fits, const_reason
from netsift.schema import FLOW_KEY
from netsift.session import scratch_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPANS = "array<struct<lo:int,hi:int,kind:int>>"
APP_KIND, DOMAIN_KIND = 0, 1
NARROW = ("packet_no", "ts", "ts_us", "frame_length", "payload_length", "tcp_flags", "has_tcp", "has_udp",
          "cand_app", "cand_sni", "cand_route", "cand_spans", "version", "ip_hit", "port_hit")


@dataclass
class RuleVersions:
    times: list[int]          # when versions 1, 2, ... begin
    spans: DataFrame          # (rule_type, value, spans): versions in which a value is a rule
    depths: list[int]         # label counts of wildcard rules
    initial: list[tuple]      # spans in which flows without a label are blocked
    small: bool               # the table fits the broadcast bound

    def version(self, ts: Column) -> Column:
        """The number of change times up to ``ts``: first among blocks of times, then in one of them."""
        if not self.times:
            return F.lit(0)
        size = isqrt(len(self.times)) + 1
        blocks = [self.times[at:at + size] for at in range(0, len(self.times), size)]
        upto = lambda a: F.size(F.filter(a, lambda t: t <= ts))
        begun = upto(F.from_json(F.lit(json.dumps([b[0] for b in blocks])), "array<bigint>"))
        inside = F.element_at(F.from_json(F.lit(json.dumps(blocks)), "array<array<bigint>>"), begun)
        return F.when(begun == 0, 0).otherwise((begun - 1) * size + upto(inside)).cast("int")

    def attach(self, df: DataFrame, kind: str, value: Column, key: Column, name: str, only: Column | None = None) -> DataFrame:
        """``df`` with the spans of the rules of one kind whose ``value`` is the row's ``key``."""
        own = self.spans.where((F.col("rule_type") == kind) & (F.lit(True) if only is None else only))
        own = (own.select(value.alias(f"_k_{name}"), "spans").where(F.col(f"_k_{name}").isNotNull()).groupBy(f"_k_{name}")
               .agg(F.flatten(F.collect_list("spans")).alias(name)).checkpoint(eager=True))
        return (df.withColumn(f"_k_{name}", key).join(F.broadcast(own) if self.small else own, f"_k_{name}", "left")
                .drop(f"_k_{name}"))


def valid(spans: Column, version: Column) -> Column:
    return F.coalesce(F.exists(spans, lambda s: (s["lo"] <= version) & (version < s["hi"])), F.lit(False))


def rule_versions(rules: DataFrame, changes: DataFrame) -> RuleVersions:
    """Spans of versions for every rule value of the first rules and the changes."""
    changes = changes.select("valid_from_us", "op", "rule_type", "value")
    # One number for each distinct time of a change, which are as few as rules are.
    times = [r[0] for r in changes.select("valid_from_us").distinct().orderBy("valid_from_us").collect()]
    numbers = changes.sparkSession.createDataFrame([(t, n) for n, t in enumerate(times, 1)], "valid_from_us bigint, version int")
    events = (rules.select("rule_type", "value", F.lit(0).alias("version"), F.lit(True).alias("on"))
              .unionByName(changes.join(numbers, "valid_from_us").select("rule_type", "value", "version", (F.col("op") == "add").alias("on"))))
    events = events.groupBy("rule_type", "value", "version").agg(F.max("on").alias("on"))
    w = Window.partitionBy("rule_type", "value").orderBy("version")
    turns = events.withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False))).where(F.col("on") != F.col("was"))
    ends = turns.withColumn("hi", F.coalesce(F.lead("version").over(w), F.lit(len(times) + 1))).where("on")
    kind = F.when(F.col("rule_type") == "APP", APP_KIND).otherwise(DOMAIN_KIND)
    spans = (ends.groupBy("rule_type", "value")
             .agg(F.collect_list(F.struct(F.col("version").alias("lo"), "hi", kind.alias("kind"))).cast(SPANS).alias("spans")).checkpoint(eager=True))
    wild = spans.where(_wild()).select(F.size(F.split(_rest(), r"\.", -1)).alias("depth")).distinct()
    first = spans.where((F.col("rule_type") == "APP") & (F.col("value") == INIT_APP)).select("spans").first()
    return RuleVersions(times, spans, sorted(r.depth for r in wild.collect()),
                        [tuple(s) for s in first.spans] if first else [], _fits(spans, MAX_BROADCAST_RULES))


def _wild() -> Column:
    return (F.col("rule_type") == "DOMAIN") & F.col("value").startswith("*.")


def _rest() -> Column:
    return F.lower(F.expr("substr(value, 3)"))


def versioned_packets(packets: DataFrame, rv: RuleVersions) -> DataFrame:
    """Packets with candidates, the version of their time, ``ip_hit`` and ``port_hit`` in
    it, and ``cand_spans``, the versions in which the candidate label is blocked."""
    df = with_candidates(packets).withColumn("version", rv.version(F.col("ts_us")))
    df = rv.attach(df, "IP", F.col("value"), F.col("src_ip"), "_ip")
    df = rv.attach(df, "PORT", F.col("value").try_cast("int"), F.col("dest_port"), "_port")
    df = rv.attach(df, "APP", F.col("value"), F.col("cand_app"), "_app")
    name = F.when(F.col("cand_sni") != "", F.col("cand_sni"))
    df = rv.attach(df, "DOMAIN", F.col("value"), name, "_dom", ~F.col("value").contains("*"))
    found = ["_app", "_dom"]
    for k in rv.depths:
        last = F.concat(F.lit(f"{k}:"), F.substring_index(F.lower(name), ".", -k))
        depth = F.size(F.split(_rest(), r"\.", -1))
        rest = F.when(depth == k, F.concat_ws(":", depth.cast("string"), _rest()))
        df = rv.attach(df, "DOMAIN", rest, last, f"_wild{k}", _wild())
        found.append(f"_wild{k}")
    none = F.array().cast(SPANS)
    spans = F.when(F.col("cand_route").isNotNull(), F.concat(*[F.coalesce(F.col(c), none) for c in found]))
    return (df.withColumns({"ip_hit": valid(F.col("_ip"), F.col("version")), "port_hit": valid(F.col("_port"), F.col("version")), "cand_spans": spans})
            .drop("_ip", "_port", *found))


def label_reason_at(spans: Column, version: Column, app: Column, sni: Column) -> Column:
    """Why a label is blocked in a version: application before domain; null if it isn't."""
    now = F.filter(spans, lambda s: (s["lo"] <= version) & (version < s["hi"]))
    kind = F.array_min(F.transform(now, lambda s: s["kind"]))
    return (F.when(kind == APP_KIND, F.struct(F.lit("APP").alias("type"), app.alias("detail")))
            .when(kind == DOMAIN_KIND, F.struct(F.lit("DOMAIN").alias("type"), sni.alias("detail"))))


def _walk(key: list[str], initial: list[tuple]):
    """The epochs whose candidate doesn't become the label, from summaries in flow and epoch order."""
    def run(batches):
        flow, held = None, initial
        for batch in batches:
            refused = []
            flows = list(zip(*(batch.column(c).to_pylist() for c in key)))
            rest = zip(*(batch.column(c).to_pylist() for c in ("pre", "pre_const", "label")))
            for n, (own, (pre, const, label)) in enumerate(zip(flows, rest)):
                if own != flow:
                    flow, held = own, initial
                if const or any(lo <= v < hi for v in pre for lo, hi, _ in held):
                    refused.append(n)
                else:
                    held = [(s["lo"], s["hi"], s["kind"]) for s in label["cand_spans"]]
            yield batch.select([*key, "_epoch"]).take(pa.array(refused, pa.int64()))
    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versioned_verdicts(packets: DataFrame, rules: DataFrame, changes: DataFrame, key: list[str] | None = None,
                       chunk_size: int | None = None, closes: DataFrame | None = None) -> DataFrame:
    """``packet_verdicts`` under rules that change. A dropped packet's reason is the one
    its flow was blocked for. ``chunk_size`` as there (flows of very many packets);
    ``closes`` as in ``with_closes``."""
    key = list(key or FLOW_KEY)
    rv, sc = rule_versions(rules, changes), _Scan(key, chunk_size)
    rows = versioned_packets(packets, rv).select(*key, *[c for c in NARROW if c not in key])
    if closes is not None:
        rows = with_closes(rows, closes, key, chunk_size)
    df = _stored(epochs(rows, sc), "rule-epochs")
    # What an epoch with a candidate tells: the versions of its packets before the candidate, and the candidate's spans.
    early = (F.col("_ccount") - F.col("_epoch_base")) == 0
    told = (df.groupBy(*key, "_epoch")
            .agg(F.collect_set(F.when(early, F.col("version"))).alias("pre"), F.coalesce(F.max(F.when(early, F.col("_const"))), F.lit(False)).alias("pre_const"),
                 F.first(F.when(F.col("_eff"), F.struct("cand_spans")), ignorenulls=True).alias("label")).where(F.col("label").isNotNull()))
    schema = ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in [*key, "_epoch"])
    refused = told.repartition(*key).sortWithinPartitions(*key, "_epoch").mapInArrow(_walk(key, rv.initial), schema)
    refused = _stored(refused, "refused").withColumn("_refused", F.lit(True))
    df = df.join(F.broadcast(refused) if _fits(refused) else refused, [*key, "_epoch"], "left")
    label = F.struct(F.col("cand_app").alias("app"), F.col("cand_sni").alias("sni"), F.col("cand_spans").alias("spans"))
    spans = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(s, ("lo", "hi", "kind"))]) for s in rv.initial]).cast(SPANS)
    first = F.struct(F.lit(INIT_APP).alias("app"), F.lit(INIT_SNI).alias("sni"), spans.alias("spans"))
    df = sc.apply(df, {"_label": ("last", F.when(F.col("_eff") & F.col("_refused").isNull(), label))})
    df = df.withColumn("_carry", F.coalesce(F.col("_label"), first))
    reason = F.coalesce(const_reason(F.col("ip_hit"), F.col("port_hit"), F.col("src_ip"), F.col("dest_port")),
                        label_reason_at(F.col("_carry.spans"), F.col("version"), F.col("_carry.app"), F.col("_carry.sni")))
    df = df.withColumn("_reason", reason)
    df = sc.apply(df, {"_blk": ("max", F.when(F.col("_reason").isNotNull(), F.struct(
        F.col("_epoch").alias("epoch"), (-F.col("packet_no")).alias("neg_no"), F.col("_reason").alias("reason"))))})
    df = df.withColumn("_drop", F.coalesce(F.col("_blk.epoch") == F.col("_epoch"), F.lit(False)))
    return verdict_rows(df, sc, F.col("_blk.reason"))
