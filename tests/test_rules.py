"""Rules file parse, rejects, sink round trip, maintenance."""

import os
import tempfile

from netsift.operators import rules as R
from netsift.sources.rules import load_rules, parse_rules_text, rule_rejects, rules_from_text, save_rules

TEXT = """[BLOCKED_IPS]
 10.0.0.5
10.0.0.0/8

[BLOCKED_APPS]
GitHub
Nope
[BLOCKED_DOMAINS]
www.youtube.com
*.ads.example.org
ads*
[BLOCKED_PORTS]
8080
http
[OTHER]
x
"""


def test_parse_and_rejects(spark):
    rules = {tuple(r) for r in rules_from_text(spark, TEXT).collect()}
    assert rules == {("IP", "10.0.0.5", False), ("APP", "GitHub", False), ("DOMAIN", "www.youtube.com", False),
                     ("DOMAIN", "*.ads.example.org", True), ("DOMAIN", "ads*", True), ("PORT", "8080", False)}
    rej = {(r["raw_value"], r["error"]) for r in rule_rejects(parse_rules_text(spark, TEXT)).collect()}
    assert rej == {("10.0.0.0/8", "not an IPv4 address"), ("Nope", "unknown application"),
                   ("http", "not a port number"), ("x", "value outside a known section")}


def test_save_load_roundtrip(spark):
    rules = rules_from_text(spark, TEXT)
    d = os.path.join(tempfile.mkdtemp(prefix="rules-", dir="/tmp"), "r")
    save_rules(rules, d)
    text = "".join(open(os.path.join(d, f)).read() for f in sorted(os.listdir(d)) if f.startswith("part-"))
    assert text.startswith("[BLOCKED_IPS]\n10.0.0.5\n\n[BLOCKED_APPS]\nGitHub\n\n[BLOCKED_DOMAINS]\n")
    assert {tuple(r) for r in load_rules(spark, d).collect()} == {tuple(r) for r in rules.collect()}


def test_maintenance_and_counts(spark):
    rules = rules_from_text(spark, TEXT)
    new = spark.createDataFrame([("PORT", "22"), ("DOMAIN", "*.x.org")], "rule_type string, value string")
    added = R.add_rules(rules, new)
    assert added.count() == 8
    gone = R.remove_rules(added, spark.createDataFrame([("PORT", "8080")], "rule_type string, value string"))
    assert {r["value"] for r in R.list_rules(gone, "PORT").collect()} == {"22"}
    counts = {r["rule_type"]: r["rule_count"] for r in R.rule_counts(rules).collect()}
    assert counts == {"IP": 1, "APP": 1, "DOMAIN": 3, "PORT": 1}
    assert R.clear_rules(rules).count() == 0


def test_wildcard_and_precedence(spark):
    rt = R.rule_tables(rules_from_text(spark, TEXT))
    df = spark.createDataFrame(
        [("10.0.0.5", 8080, "GitHub", "www.youtube.com"), ("1.1.1.1", 8080, "GitHub", "x"),
         ("1.1.1.1", 1, "GitHub", "ads.example.org"), ("1.1.1.1", 1, "Zoom", "CDN.Ads.Example.org"),
         ("1.1.1.1", 1, "Zoom", "badads.example.org"), ("1.1.1.1", 1, "Zoom", "WWW.youtube.com"),
         ("1.1.1.1", 1, "Zoom", "adsx")],
        "src_ip string, dest_port int, app_type string, sni string")
    got = [None if r["block_reason"] is None else tuple(r["block_reason"])
           for r in R.verdict(df, rt).orderBy("sni").collect()]
    by_sni = dict(zip(sorted(["www.youtube.com", "x", "ads.example.org", "CDN.Ads.Example.org",
                              "badads.example.org", "WWW.youtube.com", "adsx"]), got))
    assert by_sni["www.youtube.com"] == ("IP", "10.0.0.5")
    assert by_sni["x"] == ("PORT", "8080")
    assert by_sni["ads.example.org"] == ("APP", "GitHub")
    assert by_sni["CDN.Ads.Example.org"] == ("DOMAIN", "CDN.Ads.Example.org")
    assert by_sni["badads.example.org"] is None
    assert by_sni["WWW.youtube.com"] is None
    assert by_sni["adsx"] is None
