"""Structural and semantic drift between a baseline and a current set of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds.
TYPE_RATE, UNKNOWN_RATIO, PARSE_RATE, KEY_DISTANCE, DIVERGENCE = 0.02, 0.05, 0.005, 0.15, 0.20
CRITICAL_MAPPING, ENUM_DRIFT, FAMILY_DRIFT, DPS_REGRESSION = 0.0, 0.05, 0.10, 0.0


def tvd(baseline: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """One row: total variation distance of the key's distributions, from one conditional count per side."""
    both = baseline.select(F.col(key).alias("k"), F.lit(1).alias("b"), F.lit(0).alias("c")).unionByName(current.select(F.col(key).alias("k"), F.lit(0).alias("b"), F.lit(1).alias("c")))
    counts = both.groupBy("k").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    total = lambda side: counts.agg(F.sum(side)).scalar()
    out = counts.agg((F.sum(F.abs(F.try_divide(F.col("b"), total("b")) - F.try_divide(F.col("c"), total("c")))) / 2).alias("tvd"))
    return out.select(F.round(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "tvd")), F.lit(0.0)), 4).alias("tvd"))


def key_sets(baseline: DataFrame, current: DataFrame, key: str = "field") -> DataFrame:
    """One row: shared, new and dropped keys, Jaccard distance and share of new keys."""
    a, b = (d.select(F.col(key).alias("k")).distinct().withColumn(n, F.lit(1)) for d, n in ((baseline, "b"), (current, "c")))
    sums = a.join(b, "k", "full_outer").agg(F.count_if(F.col("b").isNotNull() & F.col("c").isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("new_keys"), F.count_if(F.col("c").isNull()).alias("dropped_keys"))
    every = F.col("shared") + F.col("new_keys") + F.col("dropped_keys")
    return sums.select("shared", "new_keys", "dropped_keys", F.round(F.coalesce(1 - F.try_divide("shared", every), F.lit(0.0)), 4).alias("jaccard_distance"), F.round(F.coalesce(F.try_divide("new_keys", F.col("shared") + F.col("new_keys")), F.lit(0.0)), 4).alias("unknown_ratio"))


def type_violations(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: share of shared fields whose type (field, inferred_type) changed; null types agree with any."""
    joined = baseline.select("field", F.col("inferred_type").alias("b")).join(current.select("field", F.col("inferred_type").alias("c")), "field").where("b != 'null' and c != 'null'")
    return joined.agg(F.round(F.coalesce(F.avg((F.col("b") != F.col("c")).cast("double")), F.lit(0.0)), 4).alias("type_violation_rate"))


def structural_state(type_rate: Column, parse_rate: Column, distance: Column, unknown: Column, divergence: Column) -> Column:
    drifted = (type_rate > TYPE_RATE) | (parse_rate > PARSE_RATE) | (distance > KEY_DISTANCE)
    return F.when(drifted, "DRIFTED").when((unknown > UNKNOWN_RATIO) | (divergence > DIVERGENCE), "SUSPECTED").otherwise("STABLE")


def critical_mapping(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row from two mappings (path, raw): share of the baseline's critical paths dropped or remapped."""
    joined = baseline.join(candidate.select("path", F.col("raw").alias("other")), "path", "left")
    return joined.agg(F.round(F.coalesce(F.avg((F.col("other").isNull() | (F.col("other") != F.col("raw"))).cast("double")), F.lit(0.0)), 4).alias("critical_mapping_drift"))


def enum_drift(vocabulary: DataFrame, current: DataFrame, field: str, value: str) -> DataFrame:
    """One row: share of current values (field, value) that the vocabulary doesn't know."""
    known = vocabulary.select(field, value).distinct().withColumn("known", F.lit(True))
    return current.join(known, [field, value], "left").agg(F.round(F.coalesce(F.avg(F.col("known").isNull().cast("double")), F.lit(0.0)), 4).alias("enum_drift"))


def inverted(baseline: dict[str, str], candidate: dict[str, str]) -> bool:
    """Whether the candidate gives a raw action another meaning."""
    return any(candidate.get(raw) not in (None, "", meaning) for raw, meaning in baseline.items())


def action_drift(baseline: dict[str, str], candidate: dict[str, str], events: DataFrame, action: str = "action") -> DataFrame:
    """One row: 1 if a meaning is inverted, else the share of events whose action neither vocabulary knows."""
    known = sorted({*baseline.values(), *candidate.values()})
    unknown = F.coalesce((F.col(action) != "") & ~F.col(action).isin(*known), F.lit(False)) if known else F.lit(False)
    share = F.coalesce(F.avg(unknown.cast("double")), F.lit(0.0)) if baseline else F.lit(0.0)
    return events.agg(F.round(F.lit(1.0) if inverted(baseline, candidate) else share, 4).alias("enum_drift"))


def parse_failure_rate(corrupted: Column, total: Column) -> Column:
    return F.round(corrupted / F.greatest(total, F.lit(1)), 4)


def _blocks() -> tuple[Column, Column]:
    """Whether an event is a block, and whether it is one that still has an endpoint."""
    text = lambda n: F.lower(F.coalesce(F.col(n), F.lit("")))
    block = F.contains(text("action"), F.lit("deny")) | F.contains(text("action"), F.lit("block")) | F.contains(text("action"), F.lit("drop")) | F.contains(text("outcome"), F.lit("denied"))
    return block, block & ((F.coalesce("src_ip", F.lit("")) != "") | (F.coalesce("dst_ip", F.lit("")) != ""))


def _block_counts(events: DataFrame, side: str) -> DataFrame:
    block, kept = _blocks()
    return events.select(block.alias("b"), kept.alias("k")).agg(F.count_if("b").alias(f"{side}_expected"), F.count_if("k").alias(f"{side}_preserved"), F.lit(1).alias("_one"))


def dps_regression(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: by how much the candidate preserves fewer blocks, both as shares of what the baseline expected."""
    both = _block_counts(baseline, "base").join(_block_counts(candidate, "cand"), "_one")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("base_expected")), F.lit(1.0))
    return both.select(F.round(F.greatest(F.lit(0.0), share("base_preserved") - share("cand_preserved")), 4).alias("dps_regression"))


def shadow_dps(active: DataFrame, candidate: DataFrame) -> DataFrame:
    """One row: preservation score of each side by its own expectations, and their difference."""
    both = _block_counts(active, "active").join(_block_counts(candidate, "candidate"), "_one")
    dps = lambda s: F.round(F.coalesce(F.try_divide(F.col(f"{s}_preserved"), F.col(f"{s}_expected")), F.lit(1.0)), 4)
    return both.select(dps("active").alias("active_dps"), dps("candidate").alias("candidate_dps")).withColumn("dps_delta", F.round(F.col("candidate_dps") - F.col("active_dps"), 4))


def family(event_class: Column, action: Column, user: Column, http: Column, dns: Column, endpoint: Column) -> Column:
    """Event family: the class, else by action, user, and which parts are there."""
    a = F.coalesce(action, F.lit(""))
    return (
        F.when(F.coalesce(event_class, F.lit("")) != "", F.lower(event_class)).when(F.contains(a, F.lit("auth")) | F.contains(a, F.lit("login")) | user.isNotNull(), "auth")
        .when(http.isNotNull(), "http").when(dns.isNotNull(), "dns").when(endpoint.isNotNull(), "network").otherwise("general")
    )


def semantic_state(mapping: Column, enum: Column, families: Column, dps: Column) -> Column:
    """A lost detection or critical mapping is drift; vocabulary or families beyond their threshold are suspected."""
    return F.when((mapping > CRITICAL_MAPPING) | (dps > DPS_REGRESSION), "DRIFTED").when((enum > ENUM_DRIFT) | (families > FAMILY_DRIFT), "SUSPECTED").otherwise("STABLE")
