"""Onboarding of a source and repair of a drifted one: the gates computed from data, the decision, the registry."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..plans import spec as sp
from . import drift, mapping, normalize, rules, shadow, source_profile


def candidate_hash(spec: dict) -> str:
    """Hash of a candidate specification's sorted JSON."""
    return "sha256-" + hashlib.sha256(json.dumps(spec, sort_keys=True).encode()).hexdigest()


def schema_gate(spec) -> tuple[bool, str]:
    """Whether a candidate has the parts that a specification needs."""
    if not isinstance(spec, dict):
        return False, "specification is no object"
    if not isinstance(spec.get("parser"), dict) or not {"id", "version"} <= spec["parser"].keys():
        return False, "parser has no id and version"
    if not isinstance(spec.get("fields"), dict):
        return False, "fields are missing"
    return True, "specification is complete"


def _canonical(samples: DataFrame, spec: dict, raw: str) -> DataFrame:
    return normalize.normalize(sp.apply(samples, spec, raw), parser=spec["parser"])


_FIELDS = ["src_ip", "src_port", "dst_ip", "dst_port", "action", "outcome", "user_name", "protocol", "event_class"]


def gates(samples: DataFrame, active: dict, candidate: dict, key: str, raw: str = "raw") -> DataFrame:
    """One row of gates from both specifications run over the samples (key, raw).

    Extraction is the share of the active side's fields that the candidate fills,
    semantics the share with equal values, the score that of detections.
    """
    a, c = _canonical(samples, active, raw), _canonical(samples, candidate, raw)
    pairs = shadow.field_pairs(a, c, key, _FIELDS)
    share = lambda x: F.round(F.coalesce(F.avg(x.cast("double")), F.lit(0.0)), 4)
    accuracy = pairs.where("a is not null").agg(share(F.col("c").isNotNull()).alias("extraction_accuracy"), share(F.coalesce(F.col("a") == F.col("c"), F.lit(False))).alias("semantic_accuracy"))
    verdicts = lambda d, n: d.select(key, F.array(*(rules.predicate(r, d.columns) for r in rules.RULES)).alias(n))
    kept = verdicts(a, "x").join(verdicts(c, "y"), key).select(F.explode(F.arrays_zip("x", "y")).alias("z"))
    dps = kept.agg(share(F.col("z.x") == F.col("z.y")).alias("dps"))
    unknown = lambda d: d.select(key, "unknown", F.transform(F.coalesce("fields", parse.empty()), lambda e: e["v"]).alias("values"))
    kept_unknown = shadow.retention(unknown(a).select(key, "unknown"), unknown(c), key)
    delta = drift.shadow_dps(a, c).select("dps_delta")
    parts = [accuracy, dps, kept_unknown, delta, shadow.match_rate(pairs), shadow.critical_divergence(pairs, key), samples.agg(F.lit(1.0).alias("raw_retention"))]
    out = parts[0].withColumn("_one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def repair(samples: DataFrame, active: dict, candidate: dict, key: str, raw: str = "raw", automatic: bool = False, isolated: bool = True) -> DataFrame:
    """One row: the gates, the shadow's verdict, refusals and decision for a candidate specification."""
    ok, details = schema_gate(candidate)
    if ok:
        found = gates(samples, active, candidate, key, raw)
    else:
        zero = {"extraction_accuracy": 0.0, "semantic_accuracy": 0.0, "dps": 0.0, "unknown_retention": 1.0, "dps_delta": -1.0, "match_rate": 0.0, "critical_divergence": 1.0, "raw_retention": 1.0}
        found = samples.sparkSession.createDataFrame([tuple(zero.values())], ", ".join(f"{k} double" for k in zero))
    valid = (F.col("extraction_accuracy") >= 0.9) & (F.col("semantic_accuracy") >= 0.9) & (F.col("dps") >= 1)
    state = shadow.verdict(F.lit(isolated), F.col("dps_delta"), F.col("critical_divergence"), F.col("unknown_retention"), F.col("match_rate"), F.lit(0.0), F.lit(0.0))
    out = found.withColumn("schema_passed", F.lit(ok)).withColumn("schema_details", F.lit(details)).withColumn("validation_passed", F.lit(ok) & valid).withColumn("shadow_state", F.when(F.lit(ok), state).otherwise("FAILED"))
    out = out.withColumn("shadow_passed", F.col("shadow_state") == "PASSED").withColumn("isolated", F.lit(isolated))
    out = shadow.promotion(out, automatic).withColumn("candidate_hash", F.lit(candidate_hash(candidate)))
    return out.withColumn("applied_by", F.when(F.col("decision") == "PROMOTED", "POLICY_ENGINE").when(F.col("decision") == "REJECTED", "POLICY_REFUSAL_ENGINE").otherwise("OPERATOR_ESCALATION"))


def deployed(registry: DataFrame, source: str, spec: dict, report: DataFrame) -> DataFrame:
    """The registry (source, revision, status, spec) with a new active revision if the report promotes the candidate."""
    last = registry.where(F.col("source") == source).agg(F.coalesce(F.max("revision"), F.lit(0)).alias("last"))
    new = report.where("decision = 'PROMOTED'").select(F.lit(1).alias("_one")).join(last.withColumn("_one", F.lit(1)), "_one")
    return registry.unionByName(new.select(F.lit(source).alias("source"), (F.col("last") + 1).cast("int").alias("revision"), F.lit("ACTIVE").alias("status"), F.lit(json.dumps(spec, sort_keys=True)).alias("spec")))


def onboard(lines: DataFrame, raw: str = "raw", order: str = "line") -> DataFrame:
    """(field, path, score, status, source_format, package_status): a new source's mapping; fields without a sure one get the assistant's proposal and make the package wait for review."""
    clean = source_profile.nonblank(lines, raw)
    found = source_profile.detect(clean, raw, order)
    parsed = source_profile.records(source_profile.body(clean, found, raw, order), found, raw)
    best = mapping.score_fields(source_profile.field_profile(parsed, order)).where("rank = 1")
    path, score = mapping.assist(F.col("field"))
    open_ = F.col("status") != "AUTO_ACCEPTED"
    out = best.select("field", F.when(open_, path).otherwise(F.col("path")).alias("path"), F.when(open_, score).otherwise(F.col("score")).alias("score"), "status")
    waiting = best.agg(F.when(F.count_if(open_) > 0, "READY_FOR_REVIEW").otherwise("AUTO_APPROVED")).scalar()
    return out.withColumn("source_format", F.lit(found.name)).withColumn("package_status", waiting)


# What lineage may hold.
LOCATORS = ("key", "json_pointer", "offset", "regex_group")
EXTRACTORS = ("key_value", "json_pointer", "regex_capture", "cef_parse", "leef_parse", "syslog_parse", "kv", "csv_parse", "csv")
TRANSFORMATIONS = ("trim", "lowercase", "uppercase", "integer", "float", "boolean", "ip", "timestamp", "enum_map", "split", "join", "substring")
EVIDENCE = ("alias_match", "type_match", "event_family_context", "schema_description_similarity", "value_profile")
REVIEWS = ("AUTO_ACCEPTED", "HUMAN_APPROVED", "ABSTAINED", "REJECTED")


def lineage_violations(x: Column) -> Column:
    """Violations of one lineage entry."""
    within = lambda c, names: F.coalesce(F.forall(c, lambda t: t.isin(*names)), F.lit(False))
    one_of = lambda c, names: F.coalesce(c.isin(*names), F.lit(False))
    checks = {
        "normalized_path is no dotted identifier": F.coalesce(x["normalized_path"].rlike(r"^[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)*$"), F.lit(False)),
        "locator type is unknown": one_of(x["locator_type"], LOCATORS), "locator value is empty": F.coalesce(F.trim(x["locator_value"]), F.lit("")) != "",
        "extractor is unknown": one_of(x["extractor"], EXTRACTORS), "transformation is unknown": within(x["transformations"], TRANSFORMATIONS),
        "mapping_score is out of range": F.coalesce(x["mapping_score"].between(0, 1), F.lit(False)),
        "evidence is missing": F.coalesce(F.size(x["mapping_evidence"]) > 0, F.lit(False)), "evidence is unknown": within(x["mapping_evidence"], EVIDENCE),
        "review status is unknown": one_of(x["review_status"], REVIEWS),
    }
    return F.filter(F.array(*(F.when(~ok, F.lit(what)) for what, ok in checks.items())), lambda v: v.isNotNull())
