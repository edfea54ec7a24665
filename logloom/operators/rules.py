"""Detection rules as boolean columns, and the preservation score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .normalize import has_any


@dataclass(frozen=True)
class Rule:
    id: str
    name: str
    mandatory: bool
    severity: str
    predicate: Callable[[Callable[[str], Column]], Column]


def _set(c: Column) -> Column:
    return c != ""


def _auth(t) -> Column:
    return has_any(t("action"), "auth", "login", "logon")


# The ten rules. t(name) is a field's lower-case text, '' if missing; numbers through _number.
_number = lambda t, n: F.coalesce(t(n).try_cast("double"), F.lit(0.0))
RULES = (
    Rule("DET-001", "authentication failure", True, "CRITICAL", lambda t: _auth(t) & t("outcome").isin("failure", "fail", "denied") & (_set(t("user_name")) | _set(t("src_ip")))),
    Rule("DET-002", "blocked connection", True, "CRITICAL", lambda t: (has_any(t("action"), "block", "drop", "deny") | t("outcome").isin("failure", "deny", "drop")) & (_set(t("src_ip")) | _set(t("dst_ip")))),
    Rule("DET-003", "authentication success", True, "HIGH", lambda t: _auth(t) & (t("outcome") == "success") & _set(t("user_name"))),
    Rule("DET-004", "policy deny", True, "CRITICAL", lambda t: has_any(t("action"), "deny", "reject") | (t("outcome") == "failure") | has_any(t("event_class"), "security", "policy")),
    Rule("DET-005", "name lookup", False, "MEDIUM", lambda t: _set(t("query_name")) | (_set(t("query_type")) & ((t("event_class") == "dns") | has_any(t("event_class"), "network")))),
    Rule("DET-006", "proxy deny", False, "MEDIUM", lambda t: (t("http_status").isin("401", "403") | t("outcome").isin("failure", "denied")) & _set(t("url"))),
    Rule("DET-007", "lateral movement", True, "HIGH", lambda t: t("dst_port").isin("445", "3389", "22", "5985", "135") & _set(t("src_ip")) & _set(t("dst_ip")) & (has_any(t("action"), "allow", "accept", "connect") | (t("outcome") == "success"))),
    Rule("DET-008", "privilege escalation", True, "CRITICAL", lambda t: (t("user_name").isin("root", "administrator", "system") | has_any(t("user_name"), "admin")) & (has_any(t("action"), "elevat", "sudo", "runas") | has_any(t("event_class"), "privilege"))),
    Rule("DET-009", "exfiltration", False, "HIGH", lambda t: (F.when(_number(t, "bytes_out") > 0, _number(t, "bytes_out")).otherwise(_number(t, "bytes")) >= 10_000_000) & ((t("event_class") == "network") | _set(t("dst_ip")))),
    Rule("DET-010", "ransomware", True, "CRITICAL", lambda t: (t("event_class").isin("file", "filesystem") | has_any(t("event_class"), "storage")) & has_any(t("action"), "encrypt", "ransom", "delete", "bulk_modify") & t("outcome").isin("success", "")),
)


def predicate(rule: Rule, columns: list[str]) -> Column:
    text = lambda n: F.lower(F.trim(F.coalesce(F.col(n).cast("string"), F.lit("")))) if n in columns else F.lit("")
    return rule.predicate(text)


def flags(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Events with one boolean column for each rule, such as det_001; no row is multiplied."""
    return events.select("*", *(predicate(r, events.columns).alias(r.id.lower().replace("-", "_")) for r in rules))


def hits(events: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule_id, n_hits) in one pass: a sum for each rule, then unpivoted."""
    sums = events.agg(*(F.count_if(predicate(r, events.columns)).alias(r.id) for r in rules))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.col(f"`{r.id}`").alias("n_hits")) for r in rules))).alias("x")).select("x.*")


def preservation(results: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row from (rule_id, matched, expected): total, preserved, dps, mandatory_dps, certified."""
    mandatory = F.col("rule_id").isin(*(r.id for r in rules if r.mandatory))
    kept = F.col("matched") == F.col("expected")
    sums = results.agg(F.count("*").alias("total"), F.count_if(kept).alias("preserved"), F.count_if(mandatory).alias("mandatory"), F.count_if(mandatory & kept).alias("mandatory_preserved"))
    score = lambda a, b: F.round(F.try_divide(F.col(a), F.col(b)), 4)
    out = sums.withColumn("dps", score("preserved", "total")).withColumn("mandatory_dps", F.coalesce(score("mandatory_preserved", "mandatory"), F.lit(1.0)))
    return out.withColumn("certified", F.coalesce((F.col("mandatory") == F.col("mandatory_preserved")) & (F.col("dps") >= 0.95), F.lit(False)))
