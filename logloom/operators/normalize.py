"""Canonical events, their validation, and the ECS and OCSF projections.

Canonical events are flat here: ``event_class``, ``action``, ``src_ip`` and so
on; the projections nest what their schemas nest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import as_map, empty, entries, last_wins, once
from ..functions.text import IPV6
from ..functions.coerce import IPV4
from ..plans.spec import column

# Canonical fields and the paths they come from, in order of preference.
FIELDS = {
    "src_ip": ("src.ip",), "src_port": ("src.port",), "dst_ip": ("dst.ip",), "dst_port": ("dst.port",), "protocol": ("network.transport", "network.protocol"),
    "user_name": ("user.name",), "hostname": ("host.name",), "http_method": ("http.request.method",), "http_status": ("http.response.status_code",), "url": ("http.url",),
    "alert_severity": ("alert.severity",), "alert_name": ("alert.name",), "query_name": ("dns.query_name",), "query_type": ("dns.query_type",), "response_code": ("dns.response_code",),
}
INTEGERS = ("src_port", "dst_port", "http_status")
ULID, UUID7 = r"^[0-7][0-9A-HJKMNP-TV-Z]{25}$", r"^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
OUTCOMES, QUALITY = ("success", "failure", "unknown"), ("VERIFIED", "REVIEW_REQUIRED", "ABSTAINED")
SEMVER, RFC3339 = r"^\d+\.\d+\.\d+$", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"
EMPTY_SHA, FALLBACK_ID = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "01J9A0K0P0Z3R3M5WQ6F7H8J9K"


def has_any(c: Column, *words: str) -> Column:
    return F.coalesce(c.rlike("|".join(words)), F.lit(False))


def outcome_of(action: Column) -> Column:
    a = F.lower(action)
    return F.when(has_any(a, "block", "deny", "drop", "fail"), "failure").when(has_any(a, "allow", "permit", "success", "login"), "success").otherwise("unknown")


def normalize(parsed: DataFrame, source: str = "generic_source", is_cef: bool = False, time: str | None = None, parser: dict | None = None) -> DataFrame:
    """Canonical events of parsed ones (columns x_<path>, unknown); parser has the id and version of their specification."""
    have = set(parsed.columns)
    get = lambda *paths: F.coalesce(*(F.nullif(F.col(column(p)), F.lit("")) for p in paths if column(p) in have), F.lit(None).cast("string"))
    out = parsed
    for name, paths in FIELDS.items():
        value = get(*paths)
        out = out.withColumn(name, value.try_cast("int") if name in INTEGERS else value)
    out = out.withColumn("url", F.coalesce("url", F.when(F.col("http_status").isNotNull() | F.col("http_method").isNotNull(), F.try_element_at(F.filter("unknown", lambda e: e["k"] == "uri"), F.lit(-1))["v"])))
    action = F.coalesce(get("event.action"), F.lit("unknown"))
    event_class = F.coalesce(
        get("event.class"),
        F.when(F.col("http_status").isNotNull() | F.col("http_method").isNotNull(), "WEB_ACCESS").when(F.col("user_name").isNotNull(), "AUTHENTICATION")
        .when(F.col("alert_severity").isNotNull() | F.col("alert_name").isNotNull() | F.lit(is_cef), "MALWARE_ALERT")
        .when(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull(), "NETWORK_CONNECTION").otherwise("SECURITY_EVENT"),
    )
    fallback = F.col(time).cast("string") if time else F.lit(None).cast("string")
    return (
        out.withColumn("action", action).withColumn("outcome", outcome_of(F.col("action"))).withColumn("event_class", event_class)
        .withColumn("event_time", F.coalesce(get("event.timestamp"), fallback, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")))
        .withColumn("vendor", F.coalesce(get("observer.vendor"), F.lit("unknown"))).withColumn("product", F.coalesce(get("observer.product"), F.lit(source)))
        .withColumn("device_id", F.coalesce(get("host.name"), F.lit(source))).withColumn("mapping_score", F.lit(0.98)).withColumn("quality_status", F.lit("VERIFIED"))
        .withColumn("schema_version", F.lit("1.0")).withColumn("parser_id", F.lit((parser or {}).get("id", "generic_parser"))).withColumn("parser_version", F.lit((parser or {}).get("version", "1.0.0")))
        .withColumn("extensions", as_map(F.coalesce("unknown", empty())))
    )


#: Canonical fields that violations() reads.
_JUDGED = ("schema_version", "event_id", "event_class", "action", "outcome", "event_time", "vendor", "product", "device_id", "src_ip", "dst_ip", "src_port", "dst_port", "parser_id", "parser_version", "raw_sha256", "raw_ref", "mapping_score", "quality_status", "extensions")


def violations(c) -> Column:
    """Violations of a canonical event; c gives a column by name, or null for one that is not there."""
    blank = lambda n: F.coalesce(F.trim(c(n)), F.lit("")) == ""
    bad_ip = lambda n: c(n).isNotNull() & ~c(n).rlike(f"^{IPV4}$") & ~c(n).rlike(IPV6)
    bad_port = lambda n: c(n).isNotNull() & ~c(n).between(0, 65535)
    checks = {
        "schema_version is not 1.0": ~F.coalesce(c("schema_version") == "1.0", F.lit(False)),
        "event_id is not a ULID or UUIDv7": ~F.coalesce(c("event_id").rlike(ULID) | c("event_id").rlike(UUID7), F.lit(False)),
        "event.class is empty": blank("event_class"), "event.action is empty": blank("action"),
        "event.outcome is unknown to the schema": ~F.coalesce(c("outcome").isin(*OUTCOMES), F.lit(False)),
        "event.time is not RFC 3339": ~F.coalesce(c("event_time").rlike(RFC3339) & F.try_to_timestamp(c("event_time")).isNotNull(), F.lit(False)),
        "source.vendor is empty": blank("vendor"), "source.product is empty": blank("product"), "source.device_id is empty": blank("device_id"),
        "src.ip is invalid": bad_ip("src_ip"), "dst.ip is invalid": bad_ip("dst_ip"), "src.port is out of range": bad_port("src_port"), "dst.port is out of range": bad_port("dst_port"),
        "parser.id is empty": blank("parser_id"), "parser.version is no version": ~F.coalesce(c("parser_version").rlike(SEMVER), F.lit(False)),
        "raw.sha256 is invalid": ~F.coalesce(c("raw_sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False)), "raw.ref is empty": blank("raw_ref"),
        "quality.mapping_score is out of range": ~F.coalesce(c("mapping_score").between(0, 1), F.lit(False)),
        "quality.status is unknown to the schema": ~F.coalesce(c("quality_status").isin(*QUALITY), F.lit(False)),
        "extensions are missing": c("extensions").isNull(),
    }
    return F.filter(F.array(*(F.when(bad, F.lit(what)) for what, bad in checks.items())), lambda x: x.isNotNull())


def _event_column(name: str) -> Column:
    return F.col("envelope_id" if name == "event_id" else name)


def judged(events: DataFrame) -> DataFrame:
    """Sealed canonical events with their violations; these are found once, on columns that are made once."""
    seen = once(events, _judged=F.struct(*(_event_column(n).alias(n) for n in _JUDGED)))
    return once(seen, violations=violations(lambda n: F.col("_judged")[n])).drop("_judged")


def admission(events: DataFrame) -> DataFrame:
    """All events with their violations and whether exporters take them, in one pass."""
    return judged(events).withColumn("admitted", F.size("violations") == 0)


def admitted(events: DataFrame) -> DataFrame:
    """The events that exporters take: those without violations."""
    return admission(events).where("admitted").drop("violations", "admitted")


def refused(events: DataFrame) -> DataFrame:
    """The others, with their violations."""
    return admission(events).where("NOT admitted").drop("admitted")


def to_json(events: DataFrame) -> DataFrame:
    """(value) one JSON document for each canonical event."""
    return events.select(F.to_json(F.struct("*")).alias("value"))


def from_json(documents: DataFrame, schema, value: str = "value") -> DataFrame:
    """Canonical events of documents with their violations; a malformed document has only those."""
    return judged(documents.select(F.from_json(F.col(value), schema).alias("e")).select("e.*"))


def _provenance(events: DataFrame, *names: str, more: tuple = ()) -> Column:
    """Provenance and further entries as a map; the source's own extensions win over both."""
    have = [(n, F.col(n)) for n in names if n in events.columns]
    return F.map_from_entries(last_wins(F.concat(entries(*have, *more), F.coalesce(F.map_entries("extensions"), F.array()).cast("array<struct<k:string,v:string>>"))))


def ecs_category(event_class: Column) -> Column:
    u = F.upper(event_class)
    out = F.lit("configuration")
    for words, name in reversed(((("NETWORK",), "network"), (("AUTH", "IDENTITY"), "authentication"), (("HTTP", "WEB"), "web"), (("ALERT", "INCIDENT"), "threat"), (("PROCESS", "ENDPOINT"), "process"), (("FILE",), "file"))):
        out = F.when(has_any(u, *words), name).otherwise(out)
    return out


def ecs_type(action: Column, outcome: Column) -> Column:
    a = F.lower(action)
    return F.when((outcome == "failure") | a.isin("block", "blocked", "deny", "denied"), "denied").when((outcome == "success") | a.isin("allow", "allowed"), "allowed").otherwise("info")


def some(*fields: tuple[str, Column]) -> Column:
    """A struct of fields, null if all are null."""
    present = F.coalesce(*(c.cast("string") for _, c in fields)).isNotNull()
    return F.when(present, F.struct(*(c.alias(n) for n, c in fields)))


def to_ecs(events: DataFrame) -> DataFrame:
    """ECS 8.11.0 documents of canonical events, as nested columns; to_json leaves the null ones out."""
    c = F.col
    event = F.struct(
        F.lit("event").alias("kind"), F.array(ecs_category(c("event_class"))).alias("category"), F.array(ecs_type(c("action"), c("outcome"))).alias("type"), c("action"), c("outcome"), c("alert_name").alias("reason"),
    )
    return events.select(
        c("event_time").alias("@timestamp"), F.struct(F.lit("8.11.0").alias("version")).alias("ecs"), event.alias("event"),
        some(("ip", c("src_ip")), ("port", c("src_port"))).alias("source"), some(("ip", c("dst_ip")), ("port", c("dst_port"))).alias("destination"),
        some(("transport", F.lower("protocol"))).alias("network"), some(("name", c("user_name"))).alias("user"), some(("hostname", c("hostname"))).alias("host"),
        F.when(c("http_method").isNotNull() | c("http_status").isNotNull(), F.struct(F.struct(c("http_method").alias("method")).alias("request"), F.struct(c("http_status").alias("status_code")).alias("response"))).alias("http"),
        some(("original", c("url"))).alias("url"), F.struct(c("vendor"), c("product"), c("device_id").alias("name")).alias("observer"),
        _provenance(events, "raw_ref", "raw_sha256", "parser_id", "parser_version", "quality_status").alias("labels"),
    )


def ocsf_class(event_class: Column) -> tuple[Column, Column]:
    """(class_uid, category_uid)"""
    u = F.upper(event_class)
    uid, category = F.lit(1001), F.lit(1)
    for words, a, b in ((("ALERT", "INCIDENT", "FINDING"), 2001, 2), (("HTTP", "WEB"), 6003, 6), (("AUTH", "IDENTITY"), 3002, 3), (("NETWORK",), 4001, 4)):
        uid, category = F.when(has_any(u, *words), a).otherwise(uid), F.when(has_any(u, *words), b).otherwise(category)
    return uid, category


def ocsf_activity(class_uid: Column, action: Column) -> Column:
    a = F.lower(action)
    return (
        F.when(class_uid == 4001, F.when(has_any(a, "open", "start"), 1).when(has_any(a, "close", "end"), 2).when(has_any(a, "deny", "block", "drop"), 6).otherwise(99))
        .when(class_uid == 3002, F.when(has_any(a, "login", "logon", "auth"), 1).when(has_any(a, "logout", "logoff"), 2).otherwise(99))
        .when(class_uid == 6003, F.when(has_any(a, "connect", "get", "post"), 1).otherwise(99))
        .when(class_uid == 2001, 1).otherwise(99)
    )


def to_ocsf(events: DataFrame) -> DataFrame:
    """OCSF 1.1.0 records of canonical events."""
    c = F.col
    uid, category = ocsf_class(c("event_class"))
    out = events.withColumn("class_uid", uid).withColumn("category_uid", category).withColumn("activity_id", ocsf_activity(c("class_uid"), c("action")))
    status = F.when(c("outcome") == "success", 1).when(c("outcome") == "failure", 2).otherwise(0)
    name = F.when(c("outcome") == "success", "Success").when(c("outcome") == "failure", "Failure").otherwise("Unknown")
    return out.select(
        "class_uid", "category_uid", "activity_id", (c("class_uid") * 100 + c("activity_id")).alias("type_uid"), F.unix_millis(F.to_timestamp("event_time")).alias("time"),
        status.alias("status_id"), name.alias("status"), some(("ip", c("src_ip")), ("port", c("src_port"))).alias("src_endpoint"), some(("ip", c("dst_ip")), ("port", c("dst_port"))).alias("dst_endpoint"),
        some(("protocol_name", F.upper("protocol"))).alias("connection_info"), some(("name", c("user_name"))).alias("actor_user"), F.struct(F.lit("1.1.0").alias("version"), c("vendor").alias("vendor_name"), c("product").alias("product_name")).alias("metadata"),
        _provenance(events, "raw_ref", "raw_sha256", "parser_id", "quality_status", more=(("dns", F.when(c("query_name").isNotNull() | c("query_type").isNotNull(), F.to_json(F.struct("query_name", "query_type", "response_code")))),)).alias("unmapped"),
    )
