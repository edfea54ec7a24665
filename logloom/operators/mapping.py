"""Semantic mapping of raw fields to canonical ones, with abstention."""

from __future__ import annotations

import difflib
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AUTO, REVIEW = 0.95, 0.80
SCHEMA = "place int, path string, types array<string>, critical boolean, families array<string>, aliases array<string>, transform string"

@dataclass(frozen=True)
class Field:
    """A canonical field."""

    path: str
    types: tuple[str, ...]
    critical: bool
    families: tuple[str, ...]
    transform: str
    aliases: tuple[str, ...]


# Event families, canonical fields, and the paths that an assistant may propose.
FAMILIES = ("NETWORK_CONNECTION", "FIREWALL_POLICY", "AUTHENTICATION", "DNS_ACTIVITY", "WEB_SESSION", "SECURITY_ALERT", "GENERIC_NETWORK_EVENT")
FIELDS = (
    Field("src.ip", types=("ipv4", "ipv6", "ip"), critical=True, families=FAMILIES, transform="parse_ip", aliases=("src", "src_ip", "source_ip", "srcip", "source_address", "s_ip", "source", "client_ip", "clientip", "c_ip", "src_addr", "sourceaddress", "initiator_ip", "sender_ip", "sourceipaddress")),
    Field("dst.ip", types=("ipv4", "ipv6", "ip"), critical=True, families=FAMILIES, transform="parse_ip", aliases=("dst", "dst_ip", "destination_ip", "dest_ip", "destip", "destination_address", "d_ip", "destination", "server_ip", "serverip", "dst_addr", "destaddress", "target_ip", "responder_ip", "destinationipaddress")),
    Field("src.port", types=("integer",), critical=True, families=("NETWORK_CONNECTION", "FIREWALL_POLICY", "WEB_SESSION", "GENERIC_NETWORK_EVENT"), transform="to_integer", aliases=("spt", "src_port", "source_port", "srcport", "s_port", "sport", "client_port", "sourceport")),
    Field("dst.port", types=("integer",), critical=True, families=("NETWORK_CONNECTION", "FIREWALL_POLICY", "DNS_ACTIVITY", "WEB_SESSION", "GENERIC_NETWORK_EVENT"), transform="to_integer", aliases=("dpt", "dst_port", "destination_port", "dest_port", "destport", "d_port", "dport", "server_port", "destinationport", "service_port")),
    Field("event.action", types=("string",), critical=True, families=("NETWORK_CONNECTION", "FIREWALL_POLICY", "AUTHENTICATION", "SECURITY_ALERT", "GENERIC_NETWORK_EVENT"), transform="trim", aliases=("act", "action", "activity", "decision", "status_action", "disposition", "rule_action", "filter_action", "event_action")),
    Field("event.outcome", types=("string", "boolean"), critical=True, families=("AUTHENTICATION", "NETWORK_CONNECTION", "FIREWALL_POLICY", "SECURITY_ALERT"), transform="trim", aliases=("outcome", "result", "status", "res", "success", "session_status", "auth_result", "login_status", "status_code_name")),
    Field("event.time", types=("timestamp", "integer", "float"), critical=True, families=FAMILIES, transform="parse_timestamp", aliases=("timestamp", "time", "ts", "event_time", "datetime", "date_time", "occurred_at", "received_at", "eventtime", "generation_time", "log_time", "device_time")),
    Field("event.class", types=("string",), critical=True, families=FAMILIES, transform="trim", aliases=("event_class", "class", "event_type", "type", "category", "cat", "device_event_class_id", "event_id", "signature_id")),
    Field("network.protocol", types=("string",), critical=False, families=("NETWORK_CONNECTION", "FIREWALL_POLICY", "GENERIC_NETWORK_EVENT"), transform="lowercase", aliases=("proto", "protocol", "transport", "network_proto", "app_proto", "ip_protocol", "proto_name")),
    Field("network.bytes_in", types=("integer",), critical=False, families=("NETWORK_CONNECTION", "WEB_SESSION", "GENERIC_NETWORK_EVENT"), transform="to_integer", aliases=("bytes_in", "in_bytes", "bytes_rcvd", "rcvd_bytes", "inbytes", "bytes_received", "bytesin", "rcvdbyte", "rx_bytes")),
    Field("network.bytes_out", types=("integer",), critical=False, families=("NETWORK_CONNECTION", "WEB_SESSION", "GENERIC_NETWORK_EVENT"), transform="to_integer", aliases=("bytes_out", "out_bytes", "bytes_sent", "sent_bytes", "outbytes", "bytes_transmitted", "bytesout", "sentbyte", "tx_bytes")),
    Field("network.packets", types=("integer",), critical=False, families=("NETWORK_CONNECTION", "FIREWALL_POLICY", "GENERIC_NETWORK_EVENT"), transform="to_integer", aliases=("packets", "pkts", "packet_count", "total_packets", "pkt_count")),
    Field("user.name", types=("string",), critical=True, families=("AUTHENTICATION", "WEB_SESSION", "SECURITY_ALERT"), transform="trim", aliases=("user", "username", "user_name", "account", "login", "usr", "actor", "account_name", "src_user", "source_username", "duser", "suser")),
    Field("user.id", types=("string", "integer"), critical=True, families=("AUTHENTICATION", "WEB_SESSION"), transform="trim", aliases=("uid", "user_id", "userid", "account_id", "actor_id")),
    Field("user.email", types=("email", "string"), critical=False, families=("AUTHENTICATION", "WEB_SESSION"), transform="lowercase", aliases=("email", "user_email", "mail", "user_mail", "sender_email")),
    Field("user.domain", types=("string",), critical=False, families=("AUTHENTICATION",), transform="trim", aliases=("domain", "user_domain", "realm", "account_domain", "nt_domain")),
    Field("http.method", types=("string",), critical=False, families=("WEB_SESSION",), transform="uppercase", aliases=("method", "http_method", "request_method", "verb")),
    Field("http.status_code", types=("integer",), critical=False, families=("WEB_SESSION",), transform="to_integer", aliases=("status_code", "http_status", "http_code", "response_code", "resp_code", "statuscode")),
    Field("http.url", types=("url", "string"), critical=False, families=("WEB_SESSION", "SECURITY_ALERT"), transform="trim", aliases=("url", "request_url", "uri", "request_uri", "path", "http_url")),
    Field("http.user_agent", types=("string",), critical=False, families=("WEB_SESSION",), transform="trim", aliases=("user_agent", "useragent", "agent", "http_user_agent", "cs_user_agent")),
    Field("dns.query_name", types=("string",), critical=False, families=("DNS_ACTIVITY",), transform="lowercase", aliases=("query", "qname", "query_name", "dns_query", "question")),
    Field("dns.query_type", types=("string", "integer"), critical=False, families=("DNS_ACTIVITY",), transform="uppercase", aliases=("qtype", "query_type", "record_type", "dns_type")),
    Field("dns.response_code", types=("string", "integer"), critical=False, families=("DNS_ACTIVITY",), transform="trim", aliases=("rcode", "response_code", "dns_rcode")),
    Field("device.hostname", types=("string",), critical=False, families=FAMILIES, transform="lowercase", aliases=("hostname", "host", "device_name", "device_hostname", "dhost", "shost", "devname", "node")),
    Field("device.ip", types=("ipv4", "ipv6", "ip"), critical=False, families=FAMILIES, transform="parse_ip", aliases=("device_ip", "dev_ip", "dvc_ip", "sensor_ip", "agent_ip", "dvchost")),
)
REGISTRY = (
    "src.ip", "src.port", "src.mac", "src.host", "dst.ip", "dst.port", "dst.mac", "dst.host", "dest.ip", "dest.port", "dest.mac", "dest.host",
    "event.action", "event.category", "event.outcome", "event.type", "user.name", "user.id", "user.domain", "user.email", "user.role",
    "http.request.method", "http.request.url", "http.response.status_code", "process.name", "process.pid", "process.parent.pid", "process.command_line",
    "network.protocol", "network.bytes_in", "network.bytes_out", "network.packets", "file.path", "file.name", "file.size", "file.hash.sha256",
)


def knowledge(spark: SparkSession) -> DataFrame:
    """The canonical fields, one row each: a table of fixed size."""
    return spark.createDataFrame([(i, f.path, list(f.types), f.critical, list(f.families), list(f.aliases), f.transform) for i, f in enumerate(FIELDS)], SCHEMA)


def normal(c):
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def by_alias(fields: DataFrame, field: str = "field") -> DataFrame:
    """(field, path): the last canonical field with this path or alias, by an equi-join on normalised names."""
    names = knowledge(fields.sparkSession).select("place", "path", F.explode(F.concat("aliases", F.array("path"))).alias("name"))
    index = names.groupBy(normal(F.col("name")).alias("name")).agg(F.max_by("path", "place").alias("path"))
    # the knowledge base has a fixed number of rows
    return fields.join(F.broadcast(index), normal(F.col(field)) == F.col("name"), "left").select(F.col(field).alias("field"), "path")


def similarity(raw: str, target: str) -> float:
    """1 if equal, 0.9 if one ends with the other, else the matching-blocks ratio."""
    a, b = (re.sub("[^a-z0-9]", "", x.lower()) for x in (raw, target))
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    return 0.9 if a.endswith(b) or b.endswith(a) else round(difflib.SequenceMatcher(None, a, b).ratio(), 3)


def score_fields(profile: DataFrame, family: str | None = None, top: int = 3) -> DataFrame:
    """The best candidates of each profiled field (field, inferred_type, is_ip, is_timestamp, is_enum).

    Every field meets the fixed 25 canonical ones as an array, not as a join.
    """
    spark = profile.sparkSession

    @F.pandas_udf("array<double>")
    def lexical(names: pd.Series) -> pd.Series:
        return names.map(lambda n: [max(similarity(n.strip().lower(), x) for x in (f.path.split(".")[-1], *f.aliases)) for f in FIELDS])

    sims = profile.withColumn("sims", lexical(F.col("field")))
    rows = sims.select("*", F.posexplode_outer("sims").alias("place", "sim")).join(F.broadcast(knowledge(spark)), "place")
    raw, t, types = F.lower(F.trim("field")), F.col("inferred_type"), F.col("types")
    is_in = lambda *x: F.arrays_overlap(types, F.array(*map(F.lit, x)))
    wants_ip = is_in("ip", "ipv4", "ipv6")
    conflict = (
        (is_in("integer") & t.isin("string", "ipv4", "ipv6", "timestamp", "email", "url", "json", "array")) | (wants_ip & (t.isin("boolean", "float", "array", "json") | ((t == "string") & ~F.col("is_ip"))))
        | (is_in("timestamp") & t.isin("boolean", "array", "json", "ipv4", "ipv6"))
    )
    # one column after the other, so that no expression holds another twice
    rows = rows.withColumn("_path", raw == F.col("path")).withColumn("_alias", F.array_contains("aliases", raw) | F.exists("aliases", lambda a: normal(a) == normal(raw)) | (normal(raw) == normal(F.col("path"))))
    rows = rows.withColumn("_fits", (t == "null") | F.array_contains(types, t) | (wants_ip & t.isin("ipv4", "ipv6", "ip")) | (is_in("float") & t.isin("integer", "float"))).withColumn("conflict", ~F.col("_fits") & conflict)
    sim, fits = F.col("sim"), F.col("_fits")
    rows = rows.withColumn("_base", F.when(F.col("_path"), 1.0).when(F.col("_alias"), 0.98).otherwise(sim * F.when(sim >= 0.75, 0.88).when(sim >= 0.5, 0.6).otherwise(0.4)))
    base, one = F.col("_base"), F.lit(1.0)
    bonus = lambda c, cond, x: F.least(one, c + F.when(cond, x).otherwise(0.0))
    s = F.when(F.col("conflict"), F.least(base - 0.35, F.lit(0.65))).when(fits, F.least(one, base + F.when(t.isin("ipv4", "ipv6", "timestamp", "email", "url"), 0.02).otherwise(0.0))).otherwise(base - 0.15)
    s = bonus(s, F.col("is_ip") & is_in("ip", "ipv4"), 0.03)
    s = bonus(s, F.col("is_timestamp") & is_in("timestamp"), 0.03)
    s = bonus(s, F.col("is_enum") & F.col("path").isin("event.action", "event.outcome", "network.protocol"), 0.03)
    if family:
        s = bonus(s, F.array_contains("families", F.lit(family)), 0.02)
    scored = rows.withColumn("score", F.round(F.greatest(F.lit(0.0), s), 4))
    status = F.when(~F.col("conflict") & (F.col("score") >= AUTO), "AUTO_ACCEPTED").when(F.col("score") >= REVIEW, "HUMAN_REVIEW").otherwise("ABSTAIN")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy(F.desc("score"), "place"))).where(F.col("rank") <= top)
    out = ranked.withColumn("status", status)
    evidence = F.filter(F.array(F.when(F.col("_path"), "exact_canonical_path_match").when(F.col("_alias"), "exact_alias_match").otherwise("lexical_similarity"), F.when(F.col("conflict"), "hard_type_conflict").when(fits, "datatype_compatible").otherwise("datatype_mismatch")), lambda x: x.isNotNull())
    return out.select("field", F.col("rank").cast("int").alias("rank"), "path", "score", "status", "critical", "conflict", F.when(F.col("status") == "ABSTAIN", F.concat(F.lit("extensions.source."), "field")).otherwise(F.col("path")).alias("destination"), F.array_join(evidence, ",").alias("evidence"))


def summary(chosen: DataFrame) -> DataFrame:
    """One row of counts from the first-ranked candidates."""
    n = lambda x: F.count_if(F.col("status") == x)
    return chosen.where("rank = 1").agg(F.count("*").alias("fields"), n("AUTO_ACCEPTED").alias("auto_accepted"), n("HUMAN_REVIEW").alias("human_review"), n("ABSTAIN").alias("abstained"), F.count_if((F.col("status") == "AUTO_ACCEPTED") & F.col("critical")).alias("critical_mapped"))


def assist(field):
    """The offline proposal: (path, score) as columns, null without one or if the path isn't one that may be proposed."""
    low = F.lower(field)
    src, dst, act = F.contains(low, F.lit("src")) & F.contains(low, F.lit("ip")), F.contains(low, F.lit("dst")) | F.contains(low, F.lit("dest")), F.contains(low, F.lit("act"))
    path = F.when(src, "src.ip").when(dst, "dest.ip").when(act, "event.action")
    return registered(path), F.when(registered(path).isNotNull(), F.when(src, 0.88).when(dst, 0.85).when(act, 0.9))


def registered(path):
    """The path if it may be proposed, else null."""
    return F.when(path.isin(*REGISTRY), path)


def sanitized(text):
    """Untrusted text for a prompt: backslashes and double quotes escaped, without NUL."""
    out = F.coalesce(text, F.lit(""))
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\x00", "")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def well_formed(candidate) -> bool:
    """Whether an assistant's answer has the structure asked for."""
    if not isinstance(candidate, dict):
        return False
    kinds = {"candidate_id": str, "source_format": str, "mapped_fields": list, "unmapped_fields": list}
    if not all(isinstance(candidate.get(k), kind) for k, kind in kinds.items()):
        return False
    wanted = {"raw_field", "canonical_field", "confidence", "reasoning"}
    return all(isinstance(f, dict) and wanted <= f.keys() and isinstance(f["confidence"], (int, float)) for f in candidate["mapped_fields"])
