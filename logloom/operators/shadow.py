"""Active against candidate parser output, validation, promotion and the spec registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse

CRITICAL = ("src_ip", "dst_ip", "src_port", "dst_port", "action", "outcome", "user_name")


def field_pairs(active: DataFrame, candidate: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field, a, c) of events that both have; each event is joined once, fields come from an array."""
    side = lambda d, n: d.select(key, F.struct(*(F.col(f).cast("string").alias(f) for f in fields)).alias(n))
    joined = side(active, "a").join(side(candidate, "c"), key)
    return joined.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a.{f}").alias("a"), F.col(f"c.{f}").alias("c")) for f in fields))).alias("x")).select(key, "x.*")


def kind(a: Column, c: Column, type_a: Column | None = None, type_c: Column | None = None) -> Column:
    """How a field differs; with types, values of different types are told from others."""
    out = F.when(a.isNull() & c.isNotNull(), "NEW_FIELD_IN_CANDIDATE").when(c.isNull(), "FIELD_MISSING_IN_CANDIDATE")
    if type_a is not None:
        out = out.when(type_a != type_c, "TYPE_MISMATCH")
    return out.when(a != c, "VALUE_MISMATCH")


def isolated(bus: DataFrame, flag: Column) -> DataFrame:
    """One row: whether no event on the bus is a shadow's."""
    return bus.agg((F.count_if(F.coalesce(flag, F.lit(False))) == 0).alias("isolated"))


def flat_pairs(active: DataFrame, candidate: DataFrame, key: str, document: str) -> DataFrame:
    """(key, field, a, c, type_a, type_c) of JSON events (key, document) that both have, flattened at run time."""
    side = lambda d, n: d.select(key, F.explode(parse.flat_event(F.col(document))).alias("e")).select(key, F.col("e.k").alias("field"), F.col("e.v").alias(n), F.col("e.t").alias(f"type_{n}"))
    shared = active.select(key).join(candidate.select(key), key, "left_semi")
    keep = lambda d: d.join(shared, key, "left_semi")
    return side(keep(active), "a").join(side(keep(candidate), "c"), [key, "field"], "full_outer")


def divergences(pairs: DataFrame, key: str) -> DataFrame:
    """(field, compared, matched, first_kind) of each field; first_kind is of the first event that differs."""
    types = (F.col("type_a"), F.col("type_c")) if "type_a" in pairs.columns else ()
    same = (F.col("a") == F.col("c")) & (types[0] == types[1] if types else F.lit(True))
    some = pairs.where("a is not null or c is not null").withColumn("kind", kind(F.col("a"), F.col("c"), *types))
    return some.groupBy("field").agg(F.count_if(F.col("a").isNotNull()).alias("compared"), F.count_if(same).alias("matched"), F.min_by("kind", F.when(F.col("kind").isNotNull(), F.col(key))).alias("first_kind"))


def match_rate(pairs: DataFrame) -> DataFrame:
    some = F.col("a").isNotNull()
    return pairs.agg(F.round(F.coalesce(F.try_divide(F.count_if(some & (F.col("a") == F.col("c"))), F.count_if(some)), F.lit(1.0)), 4).alias("match_rate"))


def critical_divergence(pairs: DataFrame, key: str, critical: tuple[str, ...] = CRITICAL) -> DataFrame:
    """Share of events with a differing critical field; action and outcome ignore case."""
    a, c = (F.coalesce(F.when(F.col("field").isin("action", "outcome"), F.lower(x)).otherwise(F.col(x)), F.lit("")) for x in "ac")
    events = pairs.groupBy(key).agg(F.max((F.col("field").isin(*critical) & (a != c)).cast("int")).alias("d"))
    return events.agg(F.round(F.coalesce(F.avg("d"), F.lit(0.0)), 4).alias("critical_divergence"))


def retention(unknown: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """Share of the active side's unknown entries (key, unknown) that the candidate keeps as entries or among its values (key, unknown, values)."""
    rows = unknown.select(key, F.explode("unknown").alias("e")).join(candidate.select(key, F.col("unknown").alias("own"), "values"), key, "left")
    kept = F.exists("own", lambda x: x["k"] == F.col("e.k")) | F.array_contains("values", F.col("e.v"))
    return rows.agg(F.round(F.coalesce(F.avg(F.coalesce(kept, F.lit(False)).cast("double")), F.lit(1.0)), 4).alias("unknown_retention"))


def verdict(isolated: Column, dps_delta: Column, critical: Column, kept: Column, rate: Column, p95_active: Column, p95_candidate: Column) -> Column:
    slower = p95_candidate - p95_active
    failed = ~isolated | (dps_delta < 0) | (critical > 0) | (kept < 1) | (rate < 0.9)
    suspected = (rate < 0.98) | ((slower > 1.0) & (F.coalesce(F.try_divide(slower, p95_active), F.lit(0.0)) > 0.5))
    return F.when(failed, "FAILED").when(suspected, "SUSPECTED").otherwise("PASSED")


#: Rows that are ordered in one task at most.
FEW = 10_000


def ranked(samples: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The samples of these ranks from 0, exactly, of numbers that are not null.

    Approximate percentiles bracket a rank; what lies between them is kept, until
    few distinct values are left to count in order.
    """
    out = []
    for rank in ranks:
        rows, at, slack = samples.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")), rank, 1e-3
        while (n := rows.count()) > FEW:
            share = (at + 0.5) / n
            low, high = rows.select(F.percentile_approx("v", F.array(F.lit(max(share - slack, 0.0)), F.lit(min(share + slack, 1.0))), F.lit(10_000))).first()[0]
            below, upto = rows.agg(F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high)).first()
            if not below <= at < upto:
                slack *= 4
                continue
            if low == high or upto - below == n:
                break
            rows, at = rows.where(F.col("v").between(low, high)), at - below
        counts = rows.groupBy("v").agg(F.count("*").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
        out.append(low if n > FEW and low == high else upto.where(F.col("upto") > at).agg(F.min("v")).first()[0])
    return out


def p95_rank(samples: DataFrame, value: str) -> DataFrame:
    """One row: the sample of rank floor(0.95 n) from 0."""
    n = samples.where(F.col(value).isNotNull()).count()
    p95 = ranked(samples, value, [min(n * 95 // 100, n - 1)])[0] if n else None
    return samples.sparkSession.createDataFrame([(p95,)], "p95 double")


def latency(samples: DataFrame, value: str) -> DataFrame:
    """One row: interpolated percentiles and extremes, rounded as reports have them."""
    n = samples.where(F.col(value).isNotNull()).count()
    spark, places = samples.sparkSession, [(n - 1) * p for p in (0.5, 0.9, 0.99)]
    ends = sorted({int(x) for x in places} | {min(int(x) + 1, n - 1) for x in places}) if n else []
    got = dict(zip(ends, ranked(samples, value, ends), strict=True))
    between = [got[int(x)] + (got[min(int(x) + 1, n - 1)] - got[int(x)]) * (x - int(x)) if n else None for x in places]
    points = spark.createDataFrame([tuple(between)], "p50 double, p90 double, p99 double").select(*(F.round(c, 4).alias(c) for c in ("p50", "p90", "p99")))
    rest = samples.agg(F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    side = lambda df: df.withColumn("_one", F.lit(1))
    return side(points).join(side(rest), "_one").drop("_one")


def validation(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """One row from (key, path, value) tables: extraction accuracy (path there) and semantic accuracy (value equal), and passed."""
    joined = expected.join(actual.select(key, "path", F.col("value").alias("got"), F.lit(True).alias("there")), [key, "path"], "left")
    rate = lambda c: F.round(F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)), 4)
    out = joined.agg(F.count("*").alias("expected"), rate(F.col("there")).alias("extraction_accuracy"), rate(F.col("got") == F.col("value")).alias("semantic_accuracy"))
    return out.withColumn("passed", (F.col("extraction_accuracy") >= 0.9) & (F.col("semantic_accuracy") >= 0.9))


def refusals(g) -> Column:
    """Numbers of the refusal conditions that gates meet; g gives a gate by name."""
    met = {
        1: ~g("schema_passed"), 2: ~g("validation_passed") | (g("extraction_accuracy") < 0.9) | (g("semantic_accuracy") < 0.9), 3: (g("dps") < 1) | (g("dps_delta") < 0),
        4: (g("raw_retention") < 1) | (g("unknown_retention") < 1), 5: ~g("shadow_passed") | (g("shadow_state") != "PASSED") | ~g("isolated"),
    }
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in met.items())), lambda x: x.isNotNull())


def promotion(gates: DataFrame, automatic: bool = False) -> DataFrame:
    """Gates with refusals and decision."""
    out = gates.withColumn("refusals", refusals(F.col))
    return out.withColumn("decision", F.when(F.size("refusals") > 0, "REJECTED").otherwise("PROMOTED" if automatic else "ESCALATED_FOR_APPROVAL"))


def certified(scores: list[Column], passed: Column) -> Column:
    """Certified only from passed, complete and finite evidence in 0 to 1."""
    ok = passed
    for s in scores:
        ok = ok & s.isNotNull() & ~F.isnan(s) & s.between(0, 1)
    return F.when(F.coalesce(ok, F.lit(False)), "CERTIFIED").otherwise("NOT YET MEASURED")


def mutation(line: Column, number: Column) -> Column:
    """Fuzz: by number mod 4 drop the first pair, empty the first value, add noise, or nothing."""
    return F.when(number % 4 == 0, F.regexp_replace(line, r"^\S+\s+", "")).when(number % 4 == 1, F.regexp_replace(line, r"^([^=\s]+=)\S*", "$1")).when(number % 4 == 2, F.concat(line, F.lit(" noise_field=garbage"))).otherwise(line)


def active_specs(registry: DataFrame) -> DataFrame:
    """The latest active revision of each source of an append-only registry (source, revision, status, spec)."""
    return registry.where("status = 'ACTIVE'").groupBy("source").agg(F.max("revision").alias("revision"), F.max_by("spec", "revision").alias("spec"))


def rolled_back(registry: DataFrame, source: str) -> DataFrame:
    """The registry with the source's latest active revision set aside."""
    last = F.max(F.when((F.col("source") == source) & (F.col("status") == "ACTIVE"), F.col("revision"))).over(Window.partitionBy("source"))
    return registry.withColumn("status", F.when(F.col("revision") == last, "ROLLED_BACK").otherwise(F.col("status")))
