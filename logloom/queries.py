"""Registered queries over the test tables, with DuckDB SQL for the same rows.

The tables hold no security logs, so parser queries render events as log lines
and parse them back; their SQL derives the same fields from the columns.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coerce, parse
from .functions import text as tx
from .operators import drift, firewall, lifecycle, mapping, normalize, profile, rules, shadow, source_profile
from .plans import spec as sp
from .session import shared_dir
from .sources import logs
from .streaming import live

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Events as logs.events() derives them.
EV = """WITH ev AS (SELECT event_id, ts, event_type, value, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso,
 '10.' || (user_id // 65536 % 256) || '.' || (user_id // 256 % 256) || '.' || (user_id % 256) AS src,
 '172.16.' || (event_id // 256 % 256) || '.' || (event_id % 256) AS dst, [22, 80, 443, 445, 3389][event_id % 5 + 1] AS dpt,
 CASE WHEN event_type IN ('click', 'view') THEN 'allow' WHEN event_type IN ('purchase', 'signup') THEN 'login' ELSE 'deny' END AS act,
 CASE WHEN event_id % 2 = 0 THEN 'tcp' ELSE 'udp' END AS proto, CAST(round(value * 100) AS BIGINT) * 1000 AS bytes,
 CASE WHEN event_type IN ('purchase', 'signup') THEN 'user ' || user_id END AS usr FROM events)
"""
#: Canonical events of those.
CANON = EV + """, canon AS (SELECT *, CASE WHEN usr IS NOT NULL THEN 'AUTHENTICATION' ELSE 'NETWORK_CONNECTION' END AS event_class,
 CASE act WHEN 'deny' THEN 'failure' ELSE 'success' END AS outcome FROM ev)
"""

#: The raw line that logs.as_kv() renders.
_KV_RAW = """'ts=' || iso || ' src=' || src || ' dst=' || dst || ' dpt=' || dpt || ' action=' || act || ' proto=' || proto || ' bytes=' || bytes || coalesce(' user="' || usr || '"', '') || ' sid=s' || event_id"""

KV_SPEC = sp.load(json.dumps({
    "dsl_version": "1.0", "parser": {"id": "kv_gate", "version": "1.0.0"}, "match": {"format": "key_value", "body_contains": ["src="]},
    "body_parser": {"type": "key_value", "pair_separator": " ", "key_value_separator": "="},
    "fields": {
        "ts": {"type": "timestamp", "map_to": "event.timestamp"}, "src": {"type": "ip", "map_to": "src.ip"}, "DST": {"type": "ip", "map_to": "dst.ip"}, "dpt": {"type": "integer", "map_to": "dst.port"},
        "action": {"type": "string", "map_to": "event.action", "enum": {"permit": "allow"}}, "proto": {"type": "string", "map_to": "network.transport", "transformations": ["trim", "uppercase"]},
        "bytes": {"type": "integer", "map_to": "network.bytes_out"}, "user": {"type": "string", "map_to": "user.name"},
    },
    "unknown_fields": {"policy": "preserve"}, "raw": {"preserve": True},
}))


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_dir(spark)}/{uuid.uuid4().hex}"


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events rendered as key-value lines, sealed, parsed by the specification, and normalised."""
    lines = logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()).withColumn("source_id", F.lit("gate"))
    sealed = firewall.seal(lines, "raw", "source_id", "ts")
    out = normalize.normalize(sp.apply(sealed, KV_SPEC), source="gate", time="iso", parser=KV_SPEC["parser"])
    return out.withColumn("bytes_out", F.col("x_network_bytes_out").cast("long"))


# --- gates and envelopes ----------------------------------------------------


@query("SELECT doc_id, sha256(text) AS raw_sha256, CAST(strlen(text) AS BIGINT) AS raw_length_bytes, 'raw/2024/01/02/' || source || '/' || doc_id AS raw_ref FROM documents")
def envelope_seal(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("raw_sha256"), F.octet_length("text").cast("long").alias("raw_length_bytes"), tx.raw_ref(F.lit("2024-01-02").cast("date"), F.col("source"), F.col("doc_id").cast("string")).alias("raw_ref"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 8192 THEN 'ERR_OVERSIZED' ELSE 'OK' END AS code FROM documents")
def firewall_size_utf8(spark, sf_dir):
    code = firewall.violation(F.col("text"), firewall.Limits(8192, 1 << 30, 1 << 30, 1 << 30))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(code, F.lit("OK")).alias("code"))


@query("""WITH k AS (SELECT doc_id, strlen(text) AS n, list_filter(list_transform(string_split_regex(text, '[\\s\\x0b]+'), lambda t: CASE WHEN contains(t, '=') THEN string_split(t, '=')[1] WHEN contains(t, ':') THEN string_split(t, ':')[1] END), lambda x: x IS NOT NULL AND x <> '') AS keys FROM documents)
SELECT doc_id, CASE WHEN n > 65536 THEN 'ERR_OVERSIZED' WHEN len(list_filter(keys, lambda x: length(x) > 4)) > 0 AND (len(keys) <= 2 OR list_position(list_transform(keys, lambda x: length(x) > 4), true) <= 3) THEN 'ERR_KEY_TOO_LONG' WHEN len(keys) > 2 THEN 'ERR_FIELD_LIMIT_EXCEEDED' ELSE 'OK' END AS code FROM k""")
def firewall_kv_limits(spark, sf_dir):
    limits = firewall.Limits(max_key=4, max_fields=2)
    code = F.when(F.octet_length("text") > limits.max_bytes, "ERR_OVERSIZED").otherwise(F.coalesce(firewall.kv_violation(F.col("text"), limits), F.lit("OK")))
    return table(spark, sf_dir, "documents").select("doc_id", code.alias("code"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'ERR_NESTING_EXCEEDED' ELSE 'OK' END AS code FROM events")
def firewall_json_limits(spark, sf_dir):
    nested = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"a":[{"b":'), "props", F.lit("}]}"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(firewall.violation(nested, firewall.Limits(max_depth=2)), F.lit("OK")).alias("code"))


@query("SELECT CASE WHEN strlen(text) > 8192 THEN 'quarantined_events' ELSE 'raw_events' END AS topic, count(*) AS n FROM documents GROUP BY 1")
def firewall_route_counts(spark, sf_dir):
    judged = firewall.inspect(table(spark, sf_dir, "documents"), "text", firewall.Limits(8192, 1 << 30, 1 << 30, 1 << 30))
    return judged.groupBy("topic").agg(F.count("*").alias("n"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&#39;'), '<', '&lt;'), '>', '&gt;'), '"', '&#34;') AS safe FROM pages""")
def safe_render(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", tx.safe_render(F.col("html")).alias("safe"))


@query("SELECT doc_id, CASE WHEN contains(text, 'DROP TABLE') THEN 'QUARANTINED' ELSE 'ACCEPTED' END AS status FROM documents")
def listener_gate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", firewall.listener_gate(F.col("text")).alias("status"))


# --- parsers ----------------------------------------------------------------

_KV = ("ts", "src", "dst", "dpt", "action", "proto", "bytes", "user", "sid")
_KV_SQL = EV + "SELECT event_id, iso AS f_ts, src AS f_src, dst AS f_dst, CAST(dpt AS VARCHAR) AS f_dpt, act AS f_action, proto AS f_proto, CAST(bytes AS VARCHAR) AS f_bytes, usr AS f_user, 's' || event_id AS f_sid FROM ev"


def _fields(df: DataFrame, found, names) -> DataFrame:
    return df.withColumn("_e", found).select("event_id", *(parse.value(F.col("_e"), n).alias(f"f_{n}") for n in names))


@query(_KV_SQL)
def parse_kv_strict(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.kv_strict(logs.as_kv()), _KV)


@query(_KV_SQL)
def parse_kv_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.kv_profile(logs.as_kv()), _KV)


_CEF_SQL = EV + "SELECT event_id, 'Acme' AS f_device_vendor, 'Wall|One' AS f_device_product, event_type AS f_name, '5' AS f_severity, src AS f_src, dst AS f_dst, CAST(dpt AS VARCHAR) AS f_dpt, act AS f_act, {usr} AS f_usr FROM ev"
_CEF = ("device_vendor", "device_product", "name", "severity", "src", "dst", "dpt", "act", "usr")


@query(_CEF_SQL.format(usr="CASE WHEN usr IS NULL THEN 'none' ELSE 'user' END"))
def parse_cef_strict(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.cef_strict(logs.as_cef()), _CEF)


@query(_CEF_SQL.format(usr="coalesce(usr, 'none')"))
def parse_cef_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.cef_profile(logs.as_cef()), _CEF)


_LEEF_SQL = EV + "SELECT event_id, 'Gate' AS f_product, CAST(event_id AS VARCHAR) AS f_event_id, src AS f_src, dst AS f_dst, CAST(dpt AS VARCHAR) AS f_dpt, act AS f_act, coalesce(usr, 'none') AS f_usr FROM ev"
_LEEF = ("product", "event_id", "src", "dst", "dpt", "act", "usr")


@query(_LEEF_SQL)
def parse_leef1_strict(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.leef_strict(logs.as_leef(1)), _LEEF)


@query(_LEEF_SQL)
def parse_leef2_strict(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.leef_strict(logs.as_leef(2)), _LEEF)


@query(_LEEF_SQL)
def parse_leef1_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.leef_profile(logs.as_leef(1)), _LEEF)


@query(_LEEF_SQL)
def parse_leef2_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.leef_profile(logs.as_leef(2)), _LEEF)


@query(EV + "SELECT event_id, CAST(event_id % 192 // 8 AS VARCHAR) AS f_facility, CAST(event_id % 192 % 8 AS VARCHAR) AS f_severity, iso AS f_timestamp, 'fw-01' AS f_hostname, CAST(event_id AS VARCHAR) AS f_proc_id, 'meta seq=\"' || event_id || '\"' AS f_structured_data, src AS f_src, act AS f_act FROM ev")
def parse_syslog5424_strict(spark, sf_dir):
    head, body = parse.syslog_strict(logs.as_syslog())
    return _fields(logs.events(spark, sf_dir), F.concat(head, parse.kv_strict(body)), ("facility", "severity", "timestamp", "hostname", "proc_id", "structured_data", "src", "act"))


@query(EV + "SELECT event_id, CAST(event_id % 192 // 8 AS VARCHAR) AS f_facility, strftime(ts, '%b %d %H:%M:%S') AS f_timestamp, 'gate' AS f_app_name, CAST(event_id AS VARCHAR) AS f_proc_id, src AS f_src, act AS f_act FROM ev")
def parse_syslog3164_strict(spark, sf_dir):
    head, body = parse.syslog_strict(logs.as_syslog(3164))
    return _fields(logs.events(spark, sf_dir), F.concat(head, parse.kv_strict(body)), ("facility", "timestamp", "app_name", "proc_id", "src", "act"))


@query(EV + "SELECT event_id, CAST(event_id % 192 % 8 AS VARCHAR) AS f_severity, iso AS f_timestamp, 'ID47' AS f_msgid, CAST(event_id AS VARCHAR) AS f_sd_meta_seq, 'src=' || src || ' dst=' || dst || ' dpt=' || dpt || ' act=' || act || ' usr=' || coalesce(usr, 'none') AS f_message FROM ev")
def parse_syslog5424_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.syslog_profile(logs.as_syslog()), ("severity", "timestamp", "msgid", "sd_meta_seq", "message"))


@query(EV + "SELECT event_id, strftime(ts, '%b %d %H:%M:%S') AS f_timestamp, 'gate' AS f_tag, CAST(event_id AS VARCHAR) AS f_pid, 'src=' || src || ' dst=' || dst || ' dpt=' || dpt || ' act=' || act || ' usr=' || coalesce(usr, 'none') AS f_message FROM ev")
def parse_syslog3164_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.syslog_profile(logs.as_syslog(3164)), ("timestamp", "tag", "pid", "message"))


_JSON_SQL = EV + ", j AS (SELECT event_id, unnest([{parents}struct_pack(k := 'net.src.ip', v := src), struct_pack(k := 'net.dst.ip', v := dst), struct_pack(k := 'net.dst.port', v := CAST(dpt AS VARCHAR)), struct_pack(k := 'action', v := act), struct_pack(k := 'tags', v := '[\"' || proto || '\",\"' || event_type || '\"]')]) AS e FROM ev) SELECT event_id, e.k AS path, e.v AS leaf FROM j"
_IP = '{{"ip":"' + "' || {} || '" + '"}}'


@query(_JSON_SQL.format(parents=""))
def parse_json_leaves(spark, sf_dir):
    e = logs.events(spark, sf_dir).select("event_id", F.explode(parse.json_flat(logs.as_json(), parents=False)).alias("e"))
    return e.select("event_id", F.col("e.k").alias("path"), F.col("e.v").alias("leaf"))


_SRC, _DST = """'{"ip":"' || src || '"}'""", """'{"ip":"' || dst || '","port":' || dpt || '}'"""
_PARENTS = f"""struct_pack(k := 'net', v := '{{"src":' || {_SRC} || ',"dst":' || {_DST} || '}}'), struct_pack(k := 'net.src', v := {_SRC}), struct_pack(k := 'net.dst', v := {_DST}), """


@query(_JSON_SQL.replace("{parents}", _PARENTS))
def parse_json_strict(spark, sf_dir):
    e = logs.events(spark, sf_dir).select("event_id", F.explode(parse.json_flat(logs.as_json(), parents=True)).alias("e"))
    return e.select("event_id", F.col("e.k").alias("path"), F.col("e.v").alias("leaf"))


@query(EV + "SELECT event_id, iso AS f_time, src AS f_src, dst AS f_dst, CAST(dpt AS VARCHAR) AS f_port, act || ', \"' || proto || '\"' AS f_col4 FROM ev")
def parse_csv_strict(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.csv_strict(logs.as_csv(), ["time", "src", "dst", "port"]), ("time", "src", "dst", "port", "col4"))


@query(EV + "SELECT event_id, iso AS f_column_1, act || ', \"' || proto || '\"' AS f_column_5 FROM ev")
def parse_csv_profile(spark, sf_dir):
    return _fields(logs.events(spark, sf_dir), parse.csv_profile(logs.as_csv(), ["a", "b"]), ("column_1", "column_5"))


@query("SELECT '|' AS delimiter, CAST(50 AS BIGINT) AS n_rows, 6 AS n_columns")
def csv_delimiter_detect(spark, sf_dir):
    lines = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand", "p_type", F.col("p_size").cast("string"), F.col("p_retailprice").cast("string")).alias("raw"))
    return profile.csv_delimiter(lines, order="p_partkey").select("delimiter", F.col("rows").alias("n_rows"), F.col("columns").alias("n_columns"))


def mixed(spark, sf_dir) -> DataFrame:
    e = logs.events(spark, sf_dir)
    line = F.element_at(F.array(logs.as_cef(), logs.as_leef(), logs.as_syslog(), logs.as_syslog(3164), logs.as_json(), logs.as_kv(), F.col("event_type")), (F.col("event_id") % 7).cast("int") + 1)
    return e.select("event_id", line.alias("raw"))


_FORMATS = "['CEF','LEEF','SYSLOG_RFC5424','SYSLOG_RFC3164','JSON','KEY_VALUE','TEXT'][event_id % 7 + 1]"


@query(f"SELECT event_id, {_FORMATS} AS format FROM events")
def detect_format(spark, sf_dir):
    return mixed(spark, sf_dir).select("event_id", parse.detect_format(F.col("raw")).alias("format"))


@query(f"WITH c AS (SELECT {_FORMATS} AS format, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) SELECT format, n, round(n / (SELECT count(*) FROM events), 4) AS share, row_number() OVER (ORDER BY n DESC, f) = 1 AS dominant FROM c")
def format_vote(spark, sf_dir):
    return profile.format_vote(mixed(spark, sf_dir), order="event_id")


@query("SELECT event_id, ['cef','leef','syslog','syslog','json','kv',NULL][event_id % 7 + 1] AS parser_id FROM events")
def parser_match(spark, sf_dir):
    make = lambda name, kind: {"parser": {"id": name}, "match": {"format": kind, "body_contains": []}, "body_parser": {"type": kind}}
    specs = [make("cef", "cef"), make("leef", "leef"), make("syslog", "syslog"), make("json", "json"), make("kv", "key_value")]
    return sp.route(mixed(spark, sf_dir), specs).select("event_id", "parser_id")


# --- coercions ----------------------------------------------------------------

_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"SELECT {_LINE}, CAST(trunc(l_extendedprice) AS BIGINT) AS from_float, l_orderkey AS from_text, CAST(NULL AS BIGINT) AS from_word FROM lineitem")
def coerce_integer(spark, sf_dir):
    i = coerce.to_integer
    return table(spark, sf_dir, "lineitem").select(*_LINE.split(", "), i(F.concat(F.lit(" "), F.format_string("%.2f", "l_extendedprice"), F.lit("\t"))).alias("from_float"), i(F.col("l_orderkey").cast("string")).alias("from_text"), i(F.concat("l_returnflag", F.lit("5d"))).alias("from_word"))


@query(f"SELECT {_LINE}, round(l_extendedprice, 2) AS from_text, CAST(NULL AS DOUBLE) AS from_suffix FROM lineitem")
def coerce_float(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(*_LINE.split(", "), coerce.to_float(F.format_string("%.2f", "l_extendedprice")).alias("from_text"), coerce.to_float(F.lit("5d")).alias("from_suffix"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN true WHEN event_type = 'error' THEN false END AS allowed FROM events")
def coerce_boolean(spark, sf_dir):
    return logs.events(spark, sf_dir).select("event_id", coerce.to_boolean(F.concat(F.lit(" "), F.upper("act"))).alias("allowed"))


@query(EV + "SELECT event_id, src AS v4, CAST(NULL AS VARCHAR) AS bad, CASE WHEN event_id % 50 = 0 THEN src END AS mapped FROM ev")
def coerce_ip(spark, sf_dir):
    return logs.events(spark, sf_dir).select("event_id", coerce.to_ipv4(F.concat("src", F.lit(" "))).alias("v4"), coerce.to_ipv4(F.concat("src", F.lit(".1"))).alias("bad"), coerce.to_ip(F.when(F.col("event_id") % 50 == 0, F.concat(F.lit("::ffff:"), "src"))).alias("mapped"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS blank, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS epoch, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS millis, CASE WHEN strftime(o_orderdate, '%m-%d') = '02-29' THEN strftime(o_orderdate, '2023-03-01T%H:%M:%SZ') ELSE strftime(o_orderdate, '2023-%m-%dT%H:%M:%SZ') END AS yearless FROM orders")
def coerce_timestamp(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate").cast("timestamp")
    t = lambda c: coerce.timestamp_text(c, 2023)
    return o.select("o_orderkey", t(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("iso"), t(F.date_format(at, "yyyy-MM-dd HH:mm:ss")).alias("blank"), t(F.unix_seconds(at).cast("string")).alias("epoch"), t(F.unix_millis(at).cast("string")).alias("millis"), t(F.date_format(at, "MMM dd HH:mm:ss")).alias("yearless"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS loose, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END AS exact FROM orders")
def enum_map(spark, sf_dir):
    words = {"F": "finished", "o": "open"}
    return table(spark, sf_dir, "orders").select("o_orderkey", coerce.enum_map(F.col("o_orderstatus"), words).alias("loose"), coerce.enum_map(F.col("o_orderstatus"), words, loose=False).alias("exact"))


# --- specifications, lineage, canonical events --------------------------------


@query(EV + "SELECT event_id, iso AS event_time, src AS src_ip, dst AS dst_ip, CAST(dpt AS VARCHAR) AS dst_port, act AS action, upper(proto) AS protocol, CAST(bytes AS VARCHAR) AS bytes_out, usr AS user_name FROM ev")
def spec_parse(spark, sf_dir):
    parsed = sp.apply(logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()), KV_SPEC)
    names = {"event_time": "event.timestamp", "src_ip": "src.ip", "dst_ip": "dst.ip", "dst_port": "dst.port", "action": "event.action", "protocol": "network.transport", "bytes_out": "network.bytes_out", "user_name": "user.name"}
    return parsed.select("event_id", *(F.col(sp.column(p)).alias(n) for n, p in names.items()))


@query("SELECT event_id, 'sid' AS unknown_key, 's' || event_id AS unknown_value FROM events")
def unknown_fields(spark, sf_dir):
    parsed = sp.apply(logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()), KV_SPEC).select("event_id", F.explode("unknown").alias("u"))
    return parsed.select("event_id", F.col("u.k").alias("unknown_key"), F.col("u.v").alias("unknown_value"))


@query(EV + ", p AS (SELECT event_id, unnest(CASE WHEN usr IS NULL THEN ['event.timestamp','src.ip','dst.ip','dst.port','event.action','network.transport','network.bytes_out'] ELSE ['event.timestamp','src.ip','dst.ip','dst.port','event.action','network.transport','network.bytes_out','user.name'] END) AS normalized_path FROM ev) SELECT event_id, normalized_path, 'key' AS locator_type, 'key_value' AS extractor, 1.0::DOUBLE AS mapping_score, 'AUTO_ACCEPTED' AS review_status FROM p")
def field_lineage(spark, sf_dir):
    parsed = sp.apply(logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()), KV_SPEC)
    return parsed.select("event_id", F.inline("lineage")).select("event_id", "normalized_path", "locator_type", "extractor", "mapping_score", "review_status")


@query("SELECT doc_id, CASE WHEN instr(text, source) > 0 THEN strlen(left(text, instr(text, source) - 1)) ELSE -1 END::BIGINT AS token_start, CASE WHEN instr(text, lang) > 0 THEN strlen(left(text, instr(text, lang) - 1)) + strlen(lang) ELSE -1 END::BIGINT AS lang_end FROM documents")
def lineage_byte_span(spark, sf_dir):
    a, _ = tx.byte_span(F.col("text"), F.col("source"))
    _, b = tx.byte_span(F.col("text"), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", a.cast("long").alias("token_start"), b.cast("long").alias("lang_end"))


@query(CANON + "SELECT event_id, event_class, act AS action, outcome, iso AS event_time, src AS src_ip, dst AS dst_ip, dpt AS dst_port, upper(proto) AS protocol, usr AS user_name, 'unknown' AS vendor, 'gate' AS product FROM canon")
def normalize_events(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", "event_class", "action", "outcome", "event_time", "src_ip", "dst_ip", "dst_port", "protocol", "user_name", "vendor", "product")


@query(CANON + "SELECT event_class, outcome, count(*) AS n FROM canon GROUP BY 1, 2")
def normalize_outcomes(spark, sf_dir):
    return canonical(spark, sf_dir).groupBy("event_class", "outcome").agg(F.count("*").alias("n"))


@query(CANON + "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'src.ip is invalid' WHEN 1 THEN 'dst.port is out of range' WHEN 2 THEN 'event.outcome is unknown to the schema' ELSE '' END AS violations FROM canon")
def ir_violations(spark, sf_dir):
    k = F.col("event_id") % 4
    bad = canonical(spark, sf_dir).withColumn("src_ip", F.when(k == 0, "999.1.1.1").otherwise(F.col("src_ip"))).withColumn("dst_port", F.when(k == 1, 70000).otherwise(F.col("dst_port"))).withColumn("outcome", F.when(k == 2, "maybe").otherwise(F.col("outcome")))
    get = lambda n: F.col("envelope_id" if n == "event_id" else n)
    return bad.select("event_id", F.array_join(normalize.violations(get), ";").alias("violations"))


@query(CANON + "SELECT event_id, iso AS event_time, CASE WHEN usr IS NULL THEN 'network' ELSE 'authentication' END AS category, CASE outcome WHEN 'failure' THEN 'denied' ELSE 'allowed' END AS event_type, src AS source_ip, dst AS destination_ip, dpt AS destination_port, proto AS transport, usr AS user_name FROM canon")
def export_ecs(spark, sf_dir):
    e = canonical(spark, sf_dir)
    out = normalize.to_ecs(e.withColumn("hostname", F.col("event_id").cast("string")))
    return out.select(F.col("host.hostname").cast("long").alias("event_id"), F.col("`@timestamp`").alias("event_time"), F.col("event.category")[0].alias("category"), F.col("event.type")[0].alias("event_type"), F.col("source.ip").alias("source_ip"), F.col("destination.ip").alias("destination_ip"), F.col("destination.port").alias("destination_port"), F.col("network.transport").alias("transport"), F.col("user.name").alias("user_name"))


@query(CANON + ", o AS (SELECT *, CASE WHEN usr IS NULL THEN 4001 ELSE 3002 END AS class_uid, CASE WHEN usr IS NOT NULL THEN 1 WHEN act = 'deny' THEN 6 ELSE 99 END AS activity_id FROM canon) SELECT dst AS dst_ip, src AS src_ip, class_uid, CASE class_uid WHEN 4001 THEN 4 ELSE 3 END AS category_uid, activity_id, class_uid * 100 + activity_id AS type_uid, epoch_ms(date_trunc('second', ts)) AS time, CASE outcome WHEN 'success' THEN 1 ELSE 2 END AS status_id FROM o")
def export_ocsf(spark, sf_dir):
    out = normalize.to_ocsf(canonical(spark, sf_dir))
    return out.select(F.col("dst_endpoint.ip").alias("dst_ip"), F.col("src_endpoint.ip").alias("src_ip"), "class_uid", "category_uid", "activity_id", "type_uid", "time", "status_id")


def _own_quality(spark, sf_dir) -> DataFrame:
    """Canonical events of lines whose own field quality_status clashes with the provenance in every third."""
    line = F.concat(logs.as_kv(), F.when(F.col("event_id") % 3 == 0, " quality_status=own").otherwise(""))
    lines = logs.events(spark, sf_dir).withColumn("raw", line).withColumn("source_id", F.lit("gate"))
    return normalize.normalize(sp.apply(firewall.seal(lines, "raw", "source_id", "ts"), KV_SPEC), source="gate", time="iso", parser=KV_SPEC["parser"])


_OWN = EV + f", o AS (SELECT event_id, sha256({_KV_RAW} || CASE WHEN event_id % 3 = 0 THEN ' quality_status=own' ELSE '' END) AS sha, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE 'VERIFIED' END AS quality FROM ev) SELECT event_id, 's' || event_id AS sid, 'kv_gate' AS parser_id, sha AS raw_sha256, quality AS quality_status FROM o"


def _labelled(events: DataFrame, exported: DataFrame, column: str) -> DataFrame:
    """The entries of a projection's label map; the source's own id is among them."""
    got = lambda k: F.try_element_at(column, F.lit(k)).alias(k)
    return exported.select(F.regexp_extract(F.try_element_at(column, F.lit("sid")), r"(\d+)", 1).cast("long").alias("event_id"), *map(got, ("sid", "parser_id", "raw_sha256", "quality_status")))


@query(_OWN)
def export_ecs_labels(spark, sf_dir):
    e = _own_quality(spark, sf_dir)
    return _labelled(e, normalize.to_ecs(e), "labels")


@query(_OWN)
def export_ocsf_unmapped(spark, sf_dir):
    e = _own_quality(spark, sf_dir)
    return _labelled(e, normalize.to_ocsf(e), "unmapped")


def _broken(spark, sf_dir) -> DataFrame:
    k = F.col("event_id") % 5
    e = canonical(spark, sf_dir)
    e = e.withColumn("parser_version", F.when(k == 0, "one").otherwise(F.col("parser_version"))).withColumn("event_time", F.when(k == 1, "yesterday").otherwise(F.col("event_time")))
    return e.withColumn("device_id", F.when(k == 2, "").otherwise(F.col("device_id"))).withColumn("schema_version", F.when(k == 3, "2.0").otherwise(F.col("schema_version")))


@query("SELECT event_id, ['parser.version is no version', 'event.time is not RFC 3339', 'source.device_id is empty', 'schema_version is not 1.0', ''][event_id % 5 + 1] AS violations FROM events")
def ir_more_violations(spark, sf_dir):
    return normalize.judged(_broken(spark, sf_dir)).select("event_id", F.array_join("violations", ";").alias("violations"))


@query("SELECT event_id, event_id % 5 = 4 AS exported FROM events")
def export_admission(spark, sf_dir):
    return normalize.admission(_broken(spark, sf_dir)).select("event_id", F.col("admitted").alias("exported"))


@query(CANON + "SELECT event_id, act AS action, src AS src_ip, dpt AS dst_port, 's' || event_id AS sid, CAST(0 AS INTEGER) AS n_violations FROM canon")
def ir_json_round_trip(spark, sf_dir):
    names = ("event_id", "envelope_id", "schema_version", "event_class", "action", "outcome", "event_time", "vendor", "product", "device_id", "src_ip", "src_port", "dst_ip", "dst_port", "parser_id", "parser_version", "raw_sha256", "raw_ref", "mapping_score", "quality_status", "extensions")
    e = canonical(spark, sf_dir).select(*names)
    back = normalize.from_json(normalize.to_json(e), e.schema)
    return back.select("event_id", "action", "src_ip", "dst_port", F.try_element_at("extensions", F.lit("sid")).alias("sid"), F.size("violations").alias("n_violations"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'extractor is unknown' WHEN 1 THEN 'evidence is missing;review status is unknown' ELSE '' END AS violations FROM events")
def lineage_violations(spark, sf_dir):
    """The first lineage entry of each event, broken in two of three."""
    parsed = sp.apply(logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()), KV_SPEC).select("event_id", F.get("lineage", F.lit(0)).alias("x"))
    k = F.col("event_id") % 3
    x = F.col("x").withField("extractor", F.when(k == 0, "guess").otherwise(F.col("x.extractor"))).withField("mapping_evidence", F.when(k == 1, F.array().cast("array<string>")).otherwise(F.col("x.mapping_evidence"))).withField("review_status", F.when(k == 1, "MAYBE").otherwise(F.col("x.review_status")))
    return parsed.select("event_id", x.alias("x")).select("event_id", F.array_join(lifecycle.lineage_violations(F.col("x")), ";").alias("violations"))


@query(EV + ", p AS (SELECT event_id, unnest([struct_pack(k := 'event.time', v := iso), struct_pack(k := 'src.ip', v := src), struct_pack(k := 'event.action', v := CASE act WHEN 'deny' THEN 'denied' ELSE act END), struct_pack(k := 'sid', v := 's' || event_id)]) AS e FROM ev) SELECT event_id, e.k AS path, e.v AS value FROM p")
def project_structured(spark, sf_dir):
    """Events that are structured already: known keys renamed, enums applied, others under their own names."""
    fields = {"ts": {"map_to": "event.time"}, "src": {"map_to": "src.ip"}, "act": {"map_to": "event.action", "enum": {"deny": "denied"}}}
    found = parse.entries(("ts", F.col("iso")), ("src", F.col("src")), ("act", F.col("act")), ("sid", F.concat(F.lit("s"), F.col("event_id").cast("string"))))
    return logs.events(spark, sf_dir).select("event_id", F.explode(parse.project(found, fields)).alias("e")).select("event_id", F.col("e.k").alias("path"), F.col("e.v").alias("value"))


_NESTED = """'{"net":{"src":"' || src || '","port":' || dpt || ',"_private":1},"ok":true,"ratio":0.5,"tags":["a"],"empty":{},"none":null,"unknown_fields":{"x":1}}'"""


def _nested(c=F.col) -> object:
    return F.concat(F.lit('{"net":{"src":"'), c("src"), F.lit('","port":'), c("dpt").cast("string"), F.lit(',"_private":1},"ok":true,"ratio":0.5,"tags":["a"],"empty":{},"none":null,"unknown_fields":{"x":1}}'))


@query(EV + ", p AS (SELECT event_id, unnest([struct_pack(k := 'net.src', v := src, t := 'string'), struct_pack(k := 'net.port', v := CAST(dpt AS VARCHAR), t := 'integer'), struct_pack(k := 'ok', v := 'true', t := 'boolean'), struct_pack(k := 'ratio', v := '0.5', t := 'float'), struct_pack(k := 'tags', v := '[\"a\"]', t := 'array'), struct_pack(k := 'none', v := NULL, t := 'null')]) AS e FROM ev) SELECT event_id, e.k AS path, e.v AS value, e.t AS kind FROM p")
def flatten_event(spark, sf_dir):
    e = logs.events(spark, sf_dir).select("event_id", F.explode(parse.flat_event(_nested())).alias("e"))
    return e.select("event_id", F.col("e.k").alias("path"), F.col("e.v").alias("value"), F.col("e.t").alias("kind"))


@query("SELECT event_id, ['integer', 'float', 'string', 'boolean', 'null', 'array', 'json'][event_id % 7 + 1] AS kind FROM events")
def json_native_types(spark, sf_dir):
    texts = ("42", "4.5", '"42"', "true", "null", "[1]", '{"a":1}')
    value = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 7).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", parse.json_type(value).alias("kind"))


_JSON_BAD = ("[,,:]", '{"a" 1 2}', '{"a":1,}', "[1,]", '{"a":1 "b":2}', '{"a":{"b":[1,{"c":null}]}}', '[1] [2]', '{1:2}', '{"a":tru}', '{"a":1e999}', "[true, false]", '{"a":"\x01"}')
_JSON_CODES = ("ERR_INVALID_ENCODING",) * 5 + ("OK", "OK") + ("ERR_INVALID_ENCODING",) * 3 + ("OK", "ERR_INVALID_ENCODING")


@query(f"SELECT event_id, {list(_JSON_CODES)}[event_id % {len(_JSON_BAD)} + 1] AS code FROM events")
def firewall_json_syntax(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, _JSON_BAD)), (F.col("event_id") % len(_JSON_BAD)).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(firewall.violation(raw), F.lit("OK")).alias("code"))


@query("SELECT event_id, ['ERR_INVALID_ENCODING', 'OK'][event_id % 2 + 1] AS code FROM events")
def firewall_encoding(spark, sf_dir):
    raw = F.when(F.col("event_id") % 2 == 0, F.unhex(F.lit("613DE282"))).otherwise(F.unhex(F.lit("613DE282AC")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(firewall.violation(raw), F.lit("OK")).alias("code"))


@query("SELECT event_id, ['source_id is empty', 'transport is unknown', 'raw is empty', ''][event_id % 4 + 1] AS violations FROM events")
def envelope_violations(spark, sf_dir):
    k = F.col("event_id") % 4
    found = firewall.envelope_violations(F.when(k == 0, " ").otherwise("gate"), F.when(k == 1, "pigeon").otherwise("syslog"), F.when(k == 2, "").otherwise(F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(found, ";").alias("violations"))


@query("SELECT event_id, CAST(event_id % 192 // 8 AS VARCHAR) AS f_facility, 'plain body ' || event_id AS body FROM events")
def parse_syslog_bare(spark, sf_dir):
    head, body = parse.syslog_strict(F.concat(F.lit("<"), (F.col("event_id") % 192).cast("string"), F.lit("> plain body "), F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", parse.value(head, "facility").alias("f_facility"), body.alias("body"))


_ODD_KV = ('src=1.2.3.4 msg="open', "SRC=1.2.3.4 src=5.6.7.8", "bare src=1.2.3.4", "src = 1.2.3.4", 'src="1.2.3.4" x=\'y z\' w', "=v src=1.2.3.4", "src=", "")
_ODD_STRICT = ("1.2.3.4", "5.6.7.8", None, None, "1.2.3.4", "1.2.3.4", "", None)
_ODD_PROFILE = ("1.2.3.4", "5.6.7.8", "1.2.3.4", "1.2.3.4", "1.2.3.4", "1.2.3.4", None, None)


@query("SELECT event_id, [" + ", ".join("NULL" if x is None else f"'{x}'" for x in _ODD_STRICT) + "][event_id % 8 + 1] AS strict_src, [" + ", ".join("NULL" if x is None else f"'{x}'" for x in _ODD_PROFILE) + "][event_id % 8 + 1] AS profile_src FROM events")
def parse_kv_malformed(spark, sf_dir):
    """Truncated, repeated, mixed-case, bare and empty pairs in both dialects."""
    raw = F.element_at(F.array(*map(F.lit, _ODD_KV)), (F.col("event_id") % 8).cast("int") + 1)
    return table(spark, sf_dir, "events").select("event_id", parse.value(parse.kv_strict(raw), "src").alias("strict_src"), parse.value(parse.kv_profile(raw), "src").alias("profile_src"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'field \"ts\" type conversion error' WHEN 1 THEN 'field \"dpt\" type conversion error' ELSE '' END AS errors FROM events")
def spec_errors(spark, sf_dir):
    k = F.col("event_id") % 3
    raw = F.concat(F.lit("ts="), F.when(k == 0, "never").otherwise(F.col("iso")), F.lit(" src="), F.col("src"), F.lit(" dpt="), F.when(k == 1, "http").otherwise(F.col("dpt").cast("string")))
    return sp.apply(logs.events(spark, sf_dir).withColumn("raw", raw), KV_SPEC).select("event_id", F.array_join("errors", ";").alias("errors"))


_WEB_SPEC = sp.load(json.dumps({
    "dsl_version": "1.0", "parser": {"id": "web", "version": "1.0.0"}, "match": {"format": "key_value", "body_contains": ["status="]}, "body_parser": {"type": "key_value"},
    "fields": {"status": {"type": "integer", "map_to": "http.response.status_code"}, "method": {"type": "string", "map_to": "http.request.method"}},
    "unknown_fields": {"policy": "preserve"}, "raw": {"preserve": True},
}))


@query("SELECT event_id, 'WEB_ACCESS' AS event_class, 'unknown' AS action, CAST(200 + event_id % 300 AS INTEGER) AS http_status, 'GET' AS http_method, '/item/' || event_id AS url FROM events")
def normalize_web(spark, sf_dir):
    raw = F.concat(F.lit("status="), (200 + F.col("event_id") % 300).cast("string"), F.lit(" method=GET uri=/item/"), F.col("event_id").cast("string"))
    e = normalize.normalize(sp.apply(table(spark, sf_dir, "events").withColumn("raw", raw), _WEB_SPEC))
    return e.select("event_id", "event_class", "action", "http_status", "http_method", "url")


# --- detection ------------------------------------------------------------------

_PRED = {
    "DET-001": "false", "DET-002": "act = 'deny'", "DET-003": "act = 'login'", "DET-004": "act = 'deny'", "DET-005": "false", "DET-006": "false",
    "DET-007": "dpt IN (445, 3389, 22) AND outcome = 'success'", "DET-008": "false", "DET-009": "bytes >= 10000000", "DET-010": "false",
}


@query(CANON + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE {p}) AS n_hits FROM canon" for k, p in _PRED.items()))
def det_rule_hits(spark, sf_dir):
    return rules.hits(canonical(spark, sf_dir))


@query(CANON + "SELECT src AS src_ip, count(*) AS blocked FROM canon WHERE act = 'deny' GROUP BY 1")
def blocked_by_source(spark, sf_dir):
    rule = next(r for r in rules.RULES if r.id == "DET-002")
    e = canonical(spark, sf_dir)
    # the count takes the rule as a column: a filter would be pushed below the parser and repeat it
    counted = e.select("src_ip", rules.predicate(rule, e.columns).alias("hit")).groupBy("src_ip").agg(F.count_if("hit").alias("blocked"))
    return counted.where("blocked > 0")


#: Events of twelve kinds on which every rule fires: action, outcome, class, user, source, destination, port, bytes, status, url, query.
_KINDS = (
    ("login", "failure", "AUTHENTICATION", "u", "10.0.0.1", None, None, 0, None, None, None), ("block", "unknown", "NETWORK_CONNECTION", None, "10.0.0.1", None, 80, 5, None, None, None),
    ("logon", "success", "AUTHENTICATION", "u", None, None, None, 0, None, None, None), ("reject", "unknown", "X", None, None, None, None, 0, None, None, None),
    ("query", "success", "DNS", None, None, None, None, 0, None, None, "a.example"), ("get", "denied", "WEB", None, None, None, None, 0, 403, "/x", None),
    ("allow", "success", "NETWORK_CONNECTION", None, "10.0.0.1", "10.0.0.2", 445, 0, None, None, None), ("sudo", "success", "X", "root", None, None, None, 0, None, None, None),
    ("copy", "success", "NETWORK", None, None, "10.0.0.2", None, 20000000, None, None, None), ("encrypt", "success", "FILE", None, None, None, None, 0, None, None, None),
    ("auth", "denied", "X", None, "10.0.0.1", None, None, 0, None, None, None), ("view", "unknown", "X", None, None, None, None, 0, None, None, None),
)
_KIND_COLUMNS = ("action", "outcome", "event_class", "user_name", "src_ip", "dst_ip", "dst_port", "bytes_out", "http_status", "url", "query_name")
_KIND_SQL = "kinds(k, action, outcome, class, usr, src, dst, dpt, bytes, status, url, query) AS (VALUES " + ", ".join("(" + ", ".join(["NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in (k, *row)]) + ")" for k, row in enumerate(_KINDS)) + ")"
_RULES_SQL = {
    "DET-001": "regexp_matches(action, 'auth|login|logon') AND outcome IN ('failure', 'fail', 'denied') AND (usr <> '' OR src <> '')",
    "DET-002": "(regexp_matches(action, 'block|drop|deny') OR outcome IN ('failure', 'deny', 'drop')) AND (src <> '' OR dst <> '')",
    "DET-003": "regexp_matches(action, 'auth|login|logon') AND outcome = 'success' AND usr <> ''",
    "DET-004": "regexp_matches(action, 'deny|reject') OR outcome = 'failure' OR regexp_matches(lower(class), 'security|policy')",
    "DET-005": "query <> ''",
    "DET-006": "(status IN (401, 403) OR outcome IN ('failure', 'denied')) AND url <> ''",
    "DET-007": "dpt IN (445, 3389, 22, 5985, 135) AND src <> '' AND dst <> '' AND (regexp_matches(action, 'allow|accept|connect') OR outcome = 'success')",
    "DET-008": "(lower(usr) IN ('root', 'administrator', 'system') OR lower(usr) LIKE '%admin%') AND (regexp_matches(action, 'elevat|sudo|runas') OR lower(class) LIKE '%privilege%')",
    "DET-009": "bytes >= 10000000 AND (lower(class) = 'network' OR dst <> '')",
    "DET-010": "(lower(class) IN ('file', 'filesystem') OR lower(class) LIKE '%storage%') AND regexp_matches(action, 'encrypt|ransom|delete|bulk_modify') AND outcome IN ('success', '')",
}


def _all_kinds(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % len(_KINDS)).alias("k"))
    schema = "k long, action string, outcome string, event_class string, user_name string, src_ip string, dst_ip string, dst_port int, bytes_out long, http_status int, url string, query_name string"
    # twelve rows
    return e.join(F.broadcast(spark.createDataFrame([(k, *row) for k, row in enumerate(_KINDS)], schema)), "k")


@query("WITH " + _KIND_SQL + ", e AS (SELECT * FROM events JOIN kinds ON event_id % 12 = k) " + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE coalesce({p}, false)) AS n_hits FROM e" for k, p in _RULES_SQL.items()))
def det_rules_all(spark, sf_dir):
    return rules.hits(_all_kinds(spark, sf_dir))


@query("WITH " + _KIND_SQL + ", e AS (SELECT * FROM events JOIN kinds ON event_id % 12 = k), r AS (" + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, {k not in ('DET-005', 'DET-006', 'DET-009')} AS mandatory, {'event_id % 97 <> 0' if k in ('DET-008', 'DET-009') else 'true'} AS same FROM e" for k in _RULES_SQL) + ") SELECT count(*) AS total, count(*) FILTER (WHERE same) AS preserved, round(count(*) FILTER (WHERE same) / count(*), 4) AS dps, bool_and(same OR NOT mandatory) AS mandatory_kept, bool_and(same OR NOT mandatory) AND round(count(*) FILTER (WHERE same) / count(*), 4) >= 0.95 AS certified FROM r")
def dps_report(spark, sf_dir):
    """All ten rules; a mandatory one and another are lost for some events."""
    e = _all_kinds(spark, sf_dir)
    one = lambda r: F.struct(F.lit(r.id).alias("rule_id"), rules.predicate(r, e.columns).alias("matched"))
    rows = e.select("event_id", F.explode(F.array(*map(one, rules.RULES))).alias("x")).select("event_id", "x.*")
    lost = F.col("rule_id").isin("DET-008", "DET-009") & (F.col("event_id") % 97 == 0)
    report = rules.preservation(rows.withColumn("expected", F.when(lost, ~F.col("matched")).otherwise(F.col("matched"))))
    return report.select("total", "preserved", "dps", (F.col("mandatory") == F.col("mandatory_preserved")).alias("mandatory_kept"), "certified")


# --- profiles -------------------------------------------------------------------


@query("SELECT c_custkey, CASE WHEN c_custkey = 0 OR c_custkey > 0 THEN 'integer' END AS t_key, 'string' AS t_name, CASE WHEN regexp_matches(CAST(c_acctbal AS VARCHAR), '^-?[0-9]+\\.[0-9]+$') THEN 'float' ELSE 'string' END AS t_balance, 'mac_address' AS t_mac, 'ipv4' AS t_ip, 'email' AS t_mail, 'url' AS t_url, 'timestamp' AS t_time, 'json' AS t_json, 'null' AS t_null, 'boolean' AS t_bool FROM customer")
def infer_types(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    made = {"t_key": key, "t_name": F.col("c_name"), "t_balance": F.format_string("%.2f", "c_acctbal"), "t_mac": F.lit("00:1b:2C:3d:4e:5f"), "t_ip": F.concat(F.lit("10.0.0."), (F.col("c_custkey") % 256).cast("string")), "t_mail": F.concat(F.lit("u"), key, F.lit("@example.org")), "t_url": F.concat(F.lit("https://example.org/"), key), "t_time": F.lit("2024-01-02T03:04:05Z"), "t_json": F.concat(F.lit('{"k": '), key, F.lit("}")), "t_null": F.lit("N/A"), "t_bool": F.lit("Yes")}
    return c.select("c_custkey", *(tx.infer_type(v).alias(k) for k, v in made.items()))


_TYPED = (("ts", "iso", "timestamp"), ("src", "src", "ipv4"), ("dst", "dst", "ipv4"), ("dpt", "CAST(dpt AS VARCHAR)", "integer"), ("action", "act", "string"), ("proto", "proto", "string"), ("bytes", "CAST(bytes AS VARCHAR)", "integer"), ("user", "usr", "string"), ("sid", "'s' || event_id", "string"))
_ROWS = EV + ", f AS (SELECT event_id AS line, unnest([" + ", ".join(f"struct_pack(k := '{k}', v := {v}, t := '{t}')" for k, v, t in _TYPED) + "]) AS e FROM ev), g AS (SELECT line, e.k AS field, e.v AS v, e.t AS t FROM f WHERE e.v IS NOT NULL)"


@query(_ROWS + """, n AS (SELECT count(*) AS total FROM ev), p AS (
SELECT field, min(t) AS inferred_type, (SELECT total FROM n) - count(*) AS null_count, least(count(DISTINCT v), 500) AS distinct_count, round(count(*) / (SELECT total FROM n), 4) AS presence_ratio, count(*) >= 2 AND least(count(DISTINCT v), 500) <= least(25, greatest(2, count(*) // 2)) AND min(t) IN ('string', 'integer') AS is_enum, CASE WHEN min(t) = 'integer' THEN min(CAST(CASE WHEN t = 'integer' THEN v END AS DOUBLE)) END AS min_number, CASE WHEN min(t) = 'string' THEN max(v) END AS max_text, list_sort(list(DISTINCT v)) AS every FROM g GROUP BY field)
SELECT * EXCLUDE (every), CASE WHEN is_enum THEN array_to_string(every[1:25], ',') END AS enum_values FROM p""")
def profile_fields(spark, sf_dir):
    parsed = logs.events(spark, sf_dir).select("event_id", parse.kv_profile(logs.as_kv()).alias("fields"))
    out = source_profile.field_profile(parsed, "event_id").withColumn("enum_values", F.array_join("enum_values", ","))
    return out.select("field", "inferred_type", "null_count", "distinct_count", "presence_ratio", "is_enum", "min_number", "max_text", "enum_values")


@query(_ROWS + ", v AS (SELECT field, v AS value, min(line) AS line FROM g GROUP BY 1, 2), r AS (SELECT field, row_number() OVER (PARTITION BY field ORDER BY line, value) AS rank, value FROM v) SELECT field, CAST(rank AS INTEGER) AS rank, value FROM r WHERE rank <= 5")
def profile_samples(spark, sf_dir):
    parsed = logs.events(spark, sf_dir).select("event_id", parse.kv_profile(logs.as_kv()).alias("fields"))
    return profile.samples(profile.long_form(parsed, "event_id"))


def _source(spark, sf_dir) -> DataFrame:
    """A CEF source with other formats, broken headers and blank lines among its lines."""
    k = F.col("event_id") % 10
    line = F.when(k == 0, logs.as_json()).when(k == 1, F.concat(F.lit("CEF:0|broken|"), F.col("event_id").cast("string"))).when(k == 2, logs.as_kv()).when(k == 3, "  \t").otherwise(logs.as_cef())
    return source_profile.nonblank(logs.events(spark, sf_dir).select(F.col("event_id").alias("line"), line.alias("raw")))


_LINES = "WITH l AS (SELECT event_id AS line, event_id % 10 AS k FROM events WHERE event_id % 10 <> 3), first AS (SELECT * FROM l ORDER BY line LIMIT 1000)"


@query(_LINES + " SELECT 'CEF' AS format, (SELECT round(avg(CASE WHEN k IN (0, 2) THEN 0.0 ELSE 1.0 END), 4) FROM first) AS confidence, CAST(NULL AS VARCHAR) AS delimiter, false AS has_header, count(*) AS total_records, count(*) FILTER (WHERE k <> 1) AS valid_records, count(*) FILTER (WHERE k = 1) AS corrupted_records, round(count(*) FILTER (WHERE k = 1) / count(*), 4) AS parse_failure_rate FROM l")
def source_summary(spark, sf_dir):
    lines = _source(spark, sf_dir)
    found = source_profile.detect(lines)
    return source_profile.summary(lines, source_profile.records(lines, found), found)


@query(_LINES + " SELECT line, CASE WHEN k = 0 THEN 'JSON' WHEN k = 2 THEN 'KEY_VALUE' WHEN k <> 1 THEN 'CEF' END AS format, CASE WHEN k = 1 THEN 0 WHEN k = 0 THEN 5 WHEN k = 2 THEN 8 + CAST(event_type IN ('purchase', 'signup') AS INTEGER) ELSE 12 END AS n_fields FROM l JOIN events ON event_id = line")
def source_records(spark, sf_dir):
    lines = _source(spark, sf_dir)
    parsed = source_profile.records(lines, source_profile.detect(lines))
    return parsed.select("line", "format", F.coalesce(F.size("fields"), F.lit(0)).alias("n_fields"))


@query(_LINES + ", m AS (SELECT line, k, CASE WHEN k = 0 THEN '{\"net\":{\"src\":{\"ip\":\"<STR>' WHEN k = 2 THEN 'ts' ELSE event_type END AS head FROM l JOIN events ON event_id = line WHERE k <> 1) SELECT CASE WHEN k IN (0, 2) THEN '' ELSE head END AS name, count(*) AS n FROM m GROUP BY 1")
def source_templates(spark, sf_dir):
    """Names of the CEF records are their own templates; those of other lines are gathered under ''."""
    lines = _source(spark, sf_dir)
    parsed = source_profile.records(lines, source_profile.detect(lines))
    mined = source_profile.templates(parsed, most=None)
    return mined.groupBy(F.when(F.length("template") < 12, F.col("template")).otherwise("").alias("name")).agg(F.sum("n").alias("n"))


def _csv_source(spark, sf_dir) -> DataFrame:
    """Parts as delimited lines under a header."""
    p = table(spark, sf_dir, "part")
    rows = p.select(F.col("p_partkey").cast("long").alias("line"), F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name", "p_brand", F.col("p_size").cast("string")).alias("raw"))
    return rows.unionByName(spark.createDataFrame([(-1, "key|name|brand|size")], "line long, raw string"))


@query("SELECT 'CSV' AS format, 0.95::DOUBLE AS confidence, '|' AS delimiter, true AS has_header, count(*) + 1 AS total_records, count(*) AS valid_records, CAST(0 AS BIGINT) AS corrupted_records, 0.0::DOUBLE AS parse_failure_rate FROM part")
def source_csv_summary(spark, sf_dir):
    lines = _csv_source(spark, sf_dir)
    found = source_profile.detect(lines)
    return source_profile.summary(lines, source_profile.records(source_profile.body(lines, found), found), found)


@query("SELECT CAST(p_partkey AS BIGINT) AS line, CAST(p_partkey AS VARCHAR) AS f_key, p_name AS f_name, p_brand AS f_brand, CAST(p_size AS VARCHAR) AS f_size FROM part")
def source_csv_records(spark, sf_dir):
    lines = _csv_source(spark, sf_dir)
    found = source_profile.detect(lines)
    parsed = source_profile.records(source_profile.body(lines, found), found)
    return parsed.select("line", *(parse.value(F.col("fields"), n).alias(f"f_{n}") for n in ("key", "name", "brand", "size")))


@query(EV + """, m AS (SELECT 'user=' || coalesce(replace(usr, ' ', '='), 'none') || ' from <IP> port <NUM> ' || act || ' at <TIMESTAMP>' AS raw, event_id FROM ev), t AS (SELECT regexp_replace(raw, '\\b[0-9]+\\b', '<NUM>', 'g') AS template, event_id FROM m) SELECT template, count(*) AS n, min(event_id) AS first_line, CAST(len(regexp_extract_all(template, '<[A-Z]+>')) AS BIGINT) AS n_variables, 'tpl_' || format('{:08x}', list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(template, ''), lambda c: unicode(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296)::BIGINT) AS template_id FROM t GROUP BY template""")
def template_mine(spark, sf_dir):
    c = F.col
    text = F.concat(F.lit("user="), F.coalesce(F.replace("usr", F.lit(" "), F.lit("=")), F.lit("none")), F.lit(" from "), c("src"), F.lit(" port "), c("dpt").cast("string"), F.lit("  "), c("act"), F.lit(" at "), c("iso"))
    out = profile.mine_templates(logs.events(spark, sf_dir).withColumn("m", text), "m", "event_id", None)
    return out.select("template", "n", "first_line", "n_variables", "template_id")


# --- mapping --------------------------------------------------------------------

_NAMES = ("src_ip", "Source-IP", "dpt", "ACT", "user_name", "response_code", "bytes_sent", "qname", "hostname", "zzz_field")


@query("SELECT * FROM (VALUES ('src_ip', 'src.ip'), ('Source-IP', 'src.ip'), ('dpt', 'dst.port'), ('ACT', 'event.action'), ('user_name', 'user.name'), ('response_code', 'dns.response_code'), ('bytes_sent', 'network.bytes_out'), ('qname', 'dns.query_name'), ('hostname', 'device.hostname'), ('zzz_field', NULL)) t(field, path)")
def map_fields_alias(spark, sf_dir):
    return mapping.by_alias(spark.createDataFrame([(n,) for n in _NAMES], "field string"))


def _profiled(spark, sf_dir) -> DataFrame:
    e = logs.events(spark, sf_dir)
    return profile.profile_fields(profile.long_form(e.select("event_id", parse.kv_profile(logs.as_kv()).alias("fields")), "event_id"), e.count())


@query("SELECT * FROM (VALUES ('src', 'src.ip', 'AUTO_ACCEPTED'), ('dst', 'dst.ip', 'AUTO_ACCEPTED'), ('dpt', 'dst.port', 'AUTO_ACCEPTED'), ('action', 'event.action', 'AUTO_ACCEPTED'), ('proto', 'network.protocol', 'AUTO_ACCEPTED'), ('ts', 'event.time', 'AUTO_ACCEPTED'), ('user', 'user.name', 'AUTO_ACCEPTED'), ('bytes', 'network.bytes_in', 'ABSTAIN'), ('sid', 'event.class', 'ABSTAIN')) t(field, path, status)")
def map_fields_best(spark, sf_dir):
    best = mapping.score_fields(_profiled(spark, sf_dir)).where("rank = 1")
    return best.select("field", "path", "status")


@query()
def map_fields_scored(spark, sf_dir):
    return mapping.score_fields(_profiled(spark, sf_dir), "NETWORK_CONNECTION")


@query("SELECT CAST(9 AS BIGINT) AS fields, CAST(7 AS BIGINT) AS auto_accepted, CAST(0 AS BIGINT) AS human_review, CAST(2 AS BIGINT) AS abstained, CAST(6 AS BIGINT) AS critical_mapped")
def map_fields_summary(spark, sf_dir):
    return mapping.summary(mapping.score_fields(_profiled(spark, sf_dir)))


@query("SELECT * FROM (VALUES ('src_ip', 'src.ip', 0.88::DOUBLE), ('dest_host', 'dest.ip', 0.85), ('action', 'event.action', 0.9), ('misc', NULL, NULL)) t(field, path, score)")
def map_assist(spark, sf_dir):
    path, score = mapping.assist(F.col("field"))
    return spark.createDataFrame([(n,) for n in ("src_ip", "dest_host", "action", "misc")], "field string").select("field", path.alias("path"), score.alias("score"))


# --- drift ----------------------------------------------------------------------

_HALF = "ts < TIMESTAMP '2024-01-16'"


def _halves(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("ts < '2024-01-16'"), df.where("ts >= '2024-01-16'")


_TVD = f"c AS (SELECT event_type AS k, count(*) FILTER (WHERE {_HALF}) AS b, count(*) FILTER (WHERE NOT {_HALF}) AS c FROM events GROUP BY 1), tv AS (SELECT round(sum(abs(b / (SELECT sum(b) FROM c) - c / (SELECT sum(c) FROM c))) / 2, 4) AS tvd FROM c)"


@query(f"WITH {_TVD} SELECT tvd FROM tv")
def drift_tvd(spark, sf_dir):
    return drift.tvd(*_halves(table(spark, sf_dir, "events")), "event_type")


def _keys(df: DataFrame, line) -> DataFrame:
    return df.select(F.explode(parse.kv_profile(line)).alias("e")).select(F.col("e.k").alias("field"))


@query("SELECT CAST(8 AS BIGINT) AS shared, CAST(1 AS BIGINT) AS new_keys, CAST(1 AS BIGINT) AS dropped_keys, 0.2::DOUBLE AS jaccard_distance, 0.1111::DOUBLE AS unknown_ratio")
def drift_jaccard(spark, sf_dir):
    a, b = _halves(logs.events(spark, sf_dir))
    return drift.key_sets(_keys(a, logs.as_kv()), _keys(b, F.regexp_replace(logs.as_kv(), "sid=", "session=")))


@query(f"WITH {_TVD}, p AS (SELECT round(count(*) FILTER (WHERE event_id % 200 = 0) / count(*), 4) AS rate FROM events WHERE NOT {_HALF}) SELECT tvd, 0.125::DOUBLE AS type_violation_rate, rate AS parse_failure_rate, 0.2::DOUBLE AS jaccard_distance, 0.1111::DOUBLE AS unknown_ratio, 'DRIFTED' AS state FROM tv, p")
def drift_structural(spark, sf_dir):
    """All five signals from data: the second half has a key renamed, a port that is text, and some lines without pairs."""
    a, b = _halves(logs.events(spark, sf_dir))
    changed = F.regexp_replace(F.regexp_replace(logs.as_kv(), "sid=", "session="), "dpt=", "dpt=p")
    parsed = lambda d, line: d.select("event_id", parse.kv_profile(line).alias("fields"))
    old, new = parsed(a, logs.as_kv()), parsed(b, F.when(F.col("event_id") % 200 == 0, "garbage").otherwise(changed))
    types = lambda d: profile.profile_fields(profile.long_form(d, "event_id"), d.agg(F.count("*")).scalar())
    keys = lambda d: d.select(F.explode("fields").alias("e")).select(F.col("e.k").alias("field"))
    failures = new.agg(drift.parse_failure_rate(F.count_if(F.size("fields") == 0), F.count("*")).alias("parse_failure_rate"))
    sets = drift.key_sets(keys(old), keys(new)).select("jaccard_distance", "unknown_ratio")
    out = drift.tvd(a, b, "event_type").withColumn("_one", F.lit(1))
    for part in (drift.type_violations(types(old), types(new)), failures, sets):
        out = out.join(part.withColumn("_one", F.lit(1)), "_one")
    c = F.col
    return out.drop("_one").withColumn("state", drift.structural_state(c("type_violation_rate"), c("parse_failure_rate"), c("jaccard_distance"), c("unknown_ratio"), c("tvd")))


@query("SELECT 0.5::DOUBLE AS critical_mapping_drift, 'DRIFTED' AS state")
def drift_semantic(spark, sf_dir):
    make = lambda rows: spark.createDataFrame(rows, "path string, raw string")
    base = make([("src.ip", "src"), ("dst.ip", "dst"), ("src.port", "spt"), ("dst.port", "dpt")])
    out = drift.critical_mapping(base, make([("src.ip", "src"), ("dst.ip", "target"), ("dst.port", "dpt")]))
    return out.withColumn("state", drift.semantic_state(F.col("critical_mapping_drift"), F.lit(0.0), F.lit(0.0), F.lit(0.0)))


@query(f"SELECT round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 4) AS enum_drift FROM events WHERE NOT {_HALF}")
def drift_enum(spark, sf_dir):
    a, b = _halves(table(spark, sf_dir, "events").withColumn("field", F.lit("event_type")))
    return drift.enum_drift(a.where("event_type != 'error'"), b, "field", "event_type")


@query(CANON + f", f AS (SELECT CASE WHEN usr IS NULL THEN 'network' ELSE 'auth' END AS k, {_HALF} AS h FROM canon), c AS (SELECT k, count(*) FILTER (WHERE h) AS b, count(*) FILTER (WHERE NOT h) AS c FROM f GROUP BY 1) SELECT round(sum(abs(b / (SELECT sum(b) FROM c) - c / (SELECT sum(c) FROM c))) / 2, 4) AS tvd FROM c")
def drift_family(spark, sf_dir):
    none = F.lit(None).cast("string")
    e = canonical(spark, sf_dir).withColumn("family", drift.family(none, F.col("action"), F.col("user_name"), none, none, F.col("src_ip")))
    return drift.tvd(*_halves(e), "family")


# --- shadow, validation, promotion ------------------------------------------------

_SHADOW = ["src_ip", "dst_port", "action", "user_name"]


def _pairs(spark, sf_dir) -> DataFrame:
    a = canonical(spark, sf_dir)
    k = F.col("event_id") % 20
    c = a.withColumn("action", F.when(k == 0, "other").otherwise(F.upper("action"))).withColumn("action", F.when(k == 1, F.col("action")).when(k == 0, "other").otherwise(F.lower("action"))).withColumn("user_name", F.when(k == 2, None).otherwise(F.col("user_name"))).withColumn("src_ip", F.col("src_ip"))
    return shadow.field_pairs(a, c, "event_id", _SHADOW)


_SH = CANON + ", s AS (SELECT *, event_id % 20 AS k FROM canon)"


@query(_SH + " SELECT round((count(*) * 3 - count(*) FILTER (WHERE k IN (0, 1)) + count(*) FILTER (WHERE usr IS NOT NULL AND k <> 2)) / (count(*) * 3 + count(usr)), 4) AS match_rate FROM s")
def shadow_match_rate(spark, sf_dir):
    return shadow.match_rate(_pairs(spark, sf_dir))


@query(_SH + " SELECT 'src_ip' AS field, count(*) AS compared, count(*) AS matched, CAST(NULL AS VARCHAR) AS first_kind FROM s UNION ALL SELECT 'dst_port', count(*), count(*), NULL FROM s UNION ALL SELECT 'action', count(*), count(*) FILTER (WHERE k > 1), 'VALUE_MISMATCH' FROM s UNION ALL SELECT 'user_name', count(usr), count(usr) FILTER (WHERE k <> 2), CASE WHEN count(usr) FILTER (WHERE k = 2) > 0 THEN 'FIELD_MISSING_IN_CANDIDATE' END FROM s")
def shadow_field_divergence(spark, sf_dir):
    return shadow.divergences(_pairs(spark, sf_dir), "event_id")


@query(_SH + " SELECT round(avg(CASE WHEN k = 0 OR (k = 2 AND usr IS NOT NULL) THEN 1.0 ELSE 0.0 END), 4) AS critical_divergence FROM s")
def shadow_critical(spark, sf_dir):
    return shadow.critical_divergence(_pairs(spark, sf_dir), "event_id")


@query("SELECT round(avg(CASE WHEN event_id % 10 = 0 THEN 0.0 ELSE 1.0 END), 4) AS unknown_retention FROM events")
def shadow_retention(spark, sf_dir):
    parsed = sp.apply(logs.events(spark, sf_dir).withColumn("raw", logs.as_kv()), KV_SPEC).select("event_id", "unknown", "x_src_ip")
    k = F.col("event_id") % 10
    value = F.transform("unknown", lambda e: e["v"])
    candidate = parsed.select("event_id", F.when(k < 5, parse.empty()).otherwise(F.col("unknown")).alias("unknown"), F.when(k.between(1, 4), value).otherwise(F.array("x_src_ip")).alias("values"))
    return shadow.retention(parsed.select("event_id", "unknown"), candidate, "event_id")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'FAILED' WHEN 1 THEN 'SUSPECTED' WHEN 2 THEN 'SUSPECTED' ELSE 'PASSED' END AS state FROM events")
def shadow_verdict(spark, sf_dir):
    k = F.col("event_id") % 4
    one = F.lit(1.0)
    state = shadow.verdict(F.lit(True), F.when(k == 0, -0.1).otherwise(0.0), F.lit(0.0), one, F.when(k == 1, 0.95).otherwise(1.0), one, F.when(k == 2, 9.0).otherwise(1.0))
    return table(spark, sf_dir, "events").select("event_id", state.alias("state"))


@query("WITH q AS (SELECT l_extendedprice AS v FROM lineitem) SELECT round(quantile_cont(v, 0.5), 4) AS p50, round(quantile_cont(v, 0.9), 4) AS p90, round(quantile_cont(v, 0.99), 4) AS p99, min(v) AS min, max(v) AS max FROM q")
def latency_percentiles(spark, sf_dir):
    return shadow.latency(table(spark, sf_dir, "lineitem"), "l_extendedprice").drop("mean")


@query("WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem) SELECT v AS p95 FROM r WHERE i = least(CAST(floor(n * 0.95) AS BIGINT), n - 1)")
def latency_p95_rank(spark, sf_dir):
    return shadow.p95_rank(table(spark, sf_dir, "lineitem"), "l_extendedprice")


@query("SELECT count(*) * 2 AS expected, round((count(*) * 2 - count(*) FILTER (WHERE event_id % 10 = 0)) / (count(*) * 2), 4) AS extraction_accuracy, round((count(*) * 2 - count(*) FILTER (WHERE event_id % 10 = 0) - count(*) FILTER (WHERE event_id % 25 = 1)) / (count(*) * 2), 4) AS semantic_accuracy, true AS passed FROM events")
def validation_metrics(spark, sf_dir):
    e = canonical(spark, sf_dir)
    rows = lambda d: d.select("event_id", F.explode(F.array(F.struct(F.lit("src.ip").alias("path"), F.col("src_ip").alias("value")), F.struct(F.lit("event.action").alias("path"), F.col("action").alias("value")))).alias("x")).select("event_id", "x.*")
    got = rows(e.withColumn("action", F.when(F.col("event_id") % 25 == 1, "wrong").otherwise(F.col("action")))).where("not (event_id % 10 = 0 and path = 'src.ip')")
    return shadow.validation(rows(e), got, "event_id")


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'REJECTED' ELSE 'ESCALATED_FOR_APPROVAL' END AS decision, CASE event_id % 3 WHEN 0 THEN '2,3' ELSE '' END AS refusals FROM events")
def promotion_decision(spark, sf_dir):
    bad = F.col("event_id") % 3 == 0
    one, yes = F.lit(1.0), F.lit(True)
    gates = table(spark, sf_dir, "events").select("event_id", yes.alias("schema_passed"), yes.alias("validation_passed"), F.when(bad, 0.5).otherwise(1.0).alias("extraction_accuracy"), one.alias("semantic_accuracy"), F.when(bad, 0.9).otherwise(1.0).alias("dps"), F.lit(0.0).alias("dps_delta"), one.alias("raw_retention"), one.alias("unknown_retention"), yes.alias("shadow_passed"), F.lit("PASSED").alias("shadow_state"), yes.alias("isolated"))
    return shadow.promotion(gates).select("event_id", "decision", F.array_join("refusals", ",").alias("refusals"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'CERTIFIED' ELSE 'NOT YET MEASURED' END AS certification FROM events")
def passport_row(spark, sf_dir):
    score = F.when(F.col("event_id") % 2 == 0, 0.99).otherwise(F.when(F.col("event_id") % 4 == 1, F.lit(float("nan"))))
    return table(spark, sf_dir, "events").select("event_id", shadow.certified([score, F.lit(1.0)], F.lit(True)).alias("certification"))


@query("SELECT 'gate' AS source, CAST(2 AS INTEGER) AS revision, 'b' AS spec UNION ALL SELECT 'wall', 1, 'x'")
def spec_registry(spark, sf_dir):
    rows = [("gate", 1, "ACTIVE", "a"), ("gate", 2, "ACTIVE", "b"), ("gate", 3, "ACTIVE", "c"), ("wall", 1, "ACTIVE", "x"), ("wall", 2, "DRAFT", "y")]
    return shadow.active_specs(shadow.rolled_back(spark.createDataFrame(rows, "source string, revision int, status string, spec string"), "gate"))


@query("SELECT round(avg(CASE WHEN event_id % 4 IN (2, 3) THEN 1.0 ELSE 0.0 END), 4) AS full_rate, round(avg(1.0), 4) AS parse_rate FROM events")
def fuzz_success(spark, sf_dir):
    found = parse.kv_strict(shadow.mutation(logs.as_kv(), F.col("event_id")))
    e = logs.events(spark, sf_dir).select(found.alias("e")).select((parse.value(F.col("e"), "ts") != "").alias("ts"), (F.size("e") > 0).alias("any"))
    return e.agg(F.round(F.avg(F.coalesce("ts", F.lit(False)).cast("double")), 4).alias("full_rate"), F.round(F.avg(F.col("any").cast("double")), 4).alias("parse_rate"))


def _sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Events with actions and endpoints, and a candidate's that loses some."""
    e = logs.events(spark, sf_dir).select("event_id", F.col("act").alias("action"), F.lit("unknown").alias("outcome"), F.col("src").alias("src_ip"), F.col("dst").alias("dst_ip"))
    k = F.col("event_id") % 10
    lost = e.withColumn("action", F.when(k == 0, "other").otherwise(F.col("action"))).withColumn("src_ip", F.when(k == 1, None).otherwise(F.col("src_ip"))).withColumn("dst_ip", F.when(k == 1, "").otherwise(F.col("dst_ip")))
    return e, lost


_DENY = "WITH d AS (SELECT event_id % 10 AS k FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup'))"


@query(_DENY + " SELECT round(greatest(0, 1 - count(*) FILTER (WHERE k > 1) / count(*)), 4) AS dps_regression FROM d")
def drift_dps_regression(spark, sf_dir):
    return drift.dps_regression(*_sides(spark, sf_dir))


@query(_DENY + " SELECT 1.0::DOUBLE AS active_dps, round(count(*) FILTER (WHERE k > 1) / count(*) FILTER (WHERE k > 0), 4) AS candidate_dps, round(round(count(*) FILTER (WHERE k > 1) / count(*) FILTER (WHERE k > 0), 4) - 1, 4) AS dps_delta FROM d")
def shadow_preservation(spark, sf_dir):
    return drift.shadow_dps(*_sides(spark, sf_dir))


@query("SELECT round(avg(CASE WHEN event_type IN ('click', 'view', 'purchase', 'signup') THEN 0.0 ELSE 1.0 END), 4) AS enum_drift FROM events UNION ALL SELECT 1.0")
def drift_action_enum(spark, sf_dir):
    """Against a vocabulary without 'deny', and against one that inverts a meaning."""
    e = logs.events(spark, sf_dir).withColumnRenamed("act", "action")
    base = {"permit": "allow", "in": "login"}
    return drift.action_drift(base, base, e).unionByName(drift.action_drift(base, {"permit": "deny"}, e))


@query(EV + ", c AS (SELECT event_id % 5 AS k FROM ev) SELECT f AS field, CASE f WHEN 'extra' THEN 0 ELSE count(*) END AS compared, CASE f WHEN 'net.port' THEN count(*) FILTER (WHERE k <> 0) WHEN 'net.src' THEN count(*) FILTER (WHERE k <> 1) WHEN 'extra' THEN 0 ELSE count(*) END AS matched, CASE f WHEN 'net.port' THEN 'TYPE_MISMATCH' WHEN 'net.src' THEN 'FIELD_MISSING_IN_CANDIDATE' WHEN 'extra' THEN 'NEW_FIELD_IN_CANDIDATE' END AS first_kind FROM c, (VALUES ('net.port'), ('net.src'), ('extra'), ('ok')) t(f) GROUP BY f")
def shadow_flat_divergence(spark, sf_dir):
    """Nested events flattened at run time: a changed type, a missing and a new field."""
    c = F.col
    doc = lambda src, port, more: F.concat(F.lit('{"net":{'), src, F.lit('"port":'), port, F.lit('},"ok":true'), more, F.lit("}"))
    src, port, k = F.concat(F.lit('"src":"'), c("src"), F.lit('",')), c("dpt").cast("string"), c("event_id") % 5
    e = logs.events(spark, sf_dir)
    active = e.select("event_id", doc(src, port, F.lit("")).alias("doc"))
    quoted = F.when(k == 0, F.concat(F.lit('"'), port, F.lit('"'))).otherwise(port)
    candidate = e.select("event_id", doc(F.when(k == 1, "").otherwise(src), quoted, F.when(k == 2, ',"extra":1').otherwise("")).alias("doc"))
    return shadow.divergences(shadow.flat_pairs(active, candidate, "event_id", "doc"), "event_id")


@query("SELECT count(*) FILTER (WHERE event_type = 'error') = 0 AS isolated FROM events")
def shadow_isolation(spark, sf_dir):
    return shadow.isolated(table(spark, sf_dir, "events"), F.col("event_type") == "error")


def _specs() -> tuple[dict, dict]:
    """The active specification and a candidate that reads the user no more and upper-cases the action's raw value."""
    candidate = json.loads(json.dumps(KV_SPEC))
    candidate["parser"]["version"] = "1.1.0"
    del candidate["fields"]["user"]
    return KV_SPEC, candidate


@query(CANON + "SELECT round(count(*) * 7 / (count(*) * 7 + count(usr)), 4) AS extraction_accuracy, 'FAILED' AS shadow_state, 'REJECTED' AS decision, 'POLICY_REFUSAL_ENGINE' AS applied_by FROM canon")
def heal_refusal(spark, sf_dir):
    """A candidate that loses the user, so that rules and a critical field change."""
    active, candidate = _specs()
    e = logs.events(spark, sf_dir).select("event_id", logs.as_kv().alias("raw"))
    return lifecycle.repair(e, active, candidate, "event_id").select("extraction_accuracy", "shadow_state", "decision", "applied_by")


@query("SELECT 1.0::DOUBLE AS extraction_accuracy, 1.0::DOUBLE AS semantic_accuracy, 1.0::DOUBLE AS dps, 'PASSED' AS shadow_state, 'PROMOTED' AS decision, 'POLICY_ENGINE' AS applied_by, 2 AS revision FROM (SELECT 1)")
def heal_promotion(spark, sf_dir):
    """A candidate that reads the same is promoted and becomes the source's next revision."""
    active = KV_SPEC
    candidate = json.loads(json.dumps(active)) | {"parser": {"id": "kv_gate", "version": "1.1.0"}}
    e = logs.events(spark, sf_dir).select("event_id", logs.as_kv().alias("raw"))
    report = lifecycle.repair(e, active, candidate, "event_id", automatic=True)
    registry = spark.createDataFrame([("gate", 1, "ACTIVE", "{}")], "source string, revision int, status string, spec string")
    latest = shadow.active_specs(lifecycle.deployed(registry, "gate", candidate, report)).select(F.lit(1).alias("_one"), "revision")
    return report.withColumn("_one", F.lit(1)).join(latest, "_one").select("extraction_accuracy", "semantic_accuracy", "dps", "shadow_state", "decision", "applied_by", "revision")


@query("SELECT field, path, source_format, package_status FROM (VALUES ('src', 'src.ip'), ('dst', 'dst.ip'), ('dpt', 'dst.port'), ('action', 'event.action'), ('proto', 'network.protocol'), ('ts', 'event.time'), ('user', 'user.name')) t(field, path), (SELECT 'KEY_VALUE' AS source_format, 'READY_FOR_REVIEW' AS package_status)")
def onboard_source(spark, sf_dir):
    """A new source's fields: those that map surely; the others wait for review with the assistant's proposal, or none."""
    lines = logs.events(spark, sf_dir).select(F.col("event_id").alias("line"), logs.as_kv().alias("raw"))
    return lifecycle.onboard(lines).where("status = 'AUTO_ACCEPTED'").select("field", "path", "source_format", "package_status")


@query("SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '\"', '\\\"'), chr(0), '') AS clean FROM documents")
def assist_sanitized(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", mapping.sanitized(F.col("text")).alias("clean"))


# --- sources and sinks ------------------------------------------------------------


def _load_sql(kind: str) -> str:
    lines = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in logs.TEMPLATES[kind]) + "]"
    text = f"{lines}[i % {len(logs.TEMPLATES[kind])} + 1]"
    for name, value in (("{i}", "i % 250 + 1"), ("{j}", "i // 250 % 250 + 1"), ("{spt}", "1024 + i % 60000"), ("{sec}", "lpad(CAST(i % 60 AS VARCHAR), 2, '0')")):
        text = f"replace({text}, '{name}', CAST({value} AS VARCHAR))"
    return f"SELECT '{kind}' AS kind, i AS line, {text} AS raw FROM range(3000) t(i)"


@query(" UNION ALL ".join(_load_sql(k) for k in logs.TEMPLATES))
def load_generate(spark, sf_dir):
    parts = [logs.load(spark, 3000, k).select(F.lit(k).alias("kind"), "line", "raw") for k in logs.TEMPLATES]
    return functools.reduce(DataFrame.unionByName, parts)


@query("SELECT i AS id, n_name FROM range(100) t(i) JOIN nation ON n_nationkey = i % (SELECT count(*) FROM nation)")
def load_replay(spark, sf_dir):
    return logs.replay(table(spark, sf_dir, "nation"), 100, "n_nationkey").select("id", "n_name")


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def ring_recent(spark, sf_dir):
    return logs.recent(table(spark, sf_dir, "events"), "event_id", 500).select("event_id", "event_type")


#: Sealed events with their ULID: 48 bits of time and 80 of a hash in base 32.
_BASE32 = "list_aggregate(list_transform(range({n}), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(({x} >> (5 * ({n} - 1 - i))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '')"
_HEX = "CAST('0x' || substr(digest, {at}, 10) AS BIGINT)"
_SEALED = CANON + f""", raw AS (SELECT *, sha256({_KV_RAW}) AS sha FROM canon), dig AS (SELECT *, sha256(sha || '|gate|' || CAST(ts AS VARCHAR)) AS digest, epoch_us(ts) // 1000 AS ms FROM raw),
 sealed AS (SELECT *, {_BASE32.format(n=10, x="ms")} || {_BASE32.format(n=8, x=_HEX.format(at=1))} || {_BASE32.format(n=8, x=_HEX.format(at=11))} AS ulid FROM dig)
"""


@query(_SEALED + "SELECT event_id, '[' || iso || '] ID=' || ulid || ' ACTION=' || upper(act) || ' SRC=' || src || ' DST=' || dst || ':' || dpt || ' PROTO=' || upper(proto) || ' SHA256=' || left(sha, 16) || '... DPS=1.00' AS line FROM sealed")
def sink_text_lines(spark, sf_dir):
    return canonical(spark, sf_dir).select("event_id", logs.text_line().alias("line"))


@query(_SEALED + "SELECT iso AS \"timestamp\", ulid AS event_id, event_class, act AS event_action, outcome, 'unknown' AS source_vendor, 'gate' AS source_product, src AS src_ip, CAST(NULL AS INTEGER) AS src_port, dst AS dst_ip, CAST(dpt AS INTEGER) AS dst_port, upper(proto) AS protocol, 'kv_gate' AS parser_id, sha AS raw_sha256, 0.98::DOUBLE AS mapping_score FROM sealed")
def sink_csv_rows(spark, sf_dir):
    return logs.csv_rows(canonical(spark, sf_dir))


@query(CANON + """SELECT '{"event_id":' || event_id || ',"event_class":"' || event_class || '","action":"' || act || '","src_ip":"' || src || '","dst_port":' || dpt || coalesce(',"user_name":"' || usr || '"', '') || '}' AS value FROM canon""")
def sink_ndjson(spark, sf_dir):
    return logs.json_lines(canonical(spark, sf_dir).select("event_id", "event_class", "action", "src_ip", "dst_port", "user_name"))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def sink_ring_snapshot(spark, sf_dir):
    """The ring written as JSON lines and read back."""
    at = _folder(spark)
    logs.snapshot(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", at, 500)
    return spark.read.schema("event_id long, event_type string").json(at)


@query("SELECT event_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'AUTHENTICATION' END AS event_class FROM events WHERE event_type IN ('purchase', 'signup')")
def sink_by_type(spark, sf_dir):
    """Only one class reaches the sink; two writes append."""
    at = _folder(spark)
    e = canonical(spark, sf_dir).select("event_id", "event_class")
    logs.sink(e, "ndjson", at, event_class="AUTHENTICATION")
    logs.sink(e.limit(0), "ndjson", at)
    return spark.read.schema("event_id long, event_class string").json(at)


@query("SELECT count(*) AS events_received, CAST(sum(strlen(props)) AS BIGINT) AS bytes_ingested, count(*) FILTER (WHERE strlen(props) > 9) AS quarantined, least(count(*), 5000) AS ring_buffer_count, round(count(*) / 60, 2) AS eps_rate FROM events")
def ring_statistics(spark, sf_dir):
    judged = firewall.inspect(table(spark, sf_dir, "events"), "props", firewall.Limits(max_bytes=9)).withColumn("size", F.octet_length("props"))
    return logs.ring_stats(judged, "size", "ingest_status", 60.0).drop("ring_buffer_capacity", "dps_ratio")


@query("SELECT event_id, sha256(props) AS raw_sha256 FROM events")
def raw_store(spark, sf_dir):
    """Events written once though offered twice, then read by their references."""
    at = _folder(spark)
    e = table(spark, sf_dir, "events").withColumn("source_id", F.lit("gate"))
    sealed = firewall.seal(e, "props", "source_id", "ts").withColumn("day", F.to_date("ts")).select("event_id", "raw_ref", "raw_sha256", "day", "source_id")
    for _ in range(2):
        logs.write_once(sealed, at, "raw_ref")
    return logs.stored(spark, at, sealed.select("raw_ref")).select("event_id", "raw_sha256")


@query("SELECT event_id, event_type AS raw FROM events")
def source_lines(spark, sf_dir):
    """A text file's lines, blank ones dropped."""
    at = _folder(spark)
    e = table(spark, sf_dir, "events")
    e.select(F.explode(F.array(F.concat(F.col("event_id").cast("string"), F.lit(" "), "event_type"), F.lit("  "))).alias("value")).write.text(at)
    return logs.read_lines(spark, at).select(F.split("raw", " ")[0].cast("long").alias("event_id"), F.split("raw", " ")[1].alias("raw"))


@query("SELECT count(*) AS n, count(*) AS ids, count(*) AS valid FROM events")
def envelope_ids(spark, sf_dir):
    return canonical(spark, sf_dir).agg(F.count("*").alias("n"), F.count_distinct("envelope_id").alias("ids"), F.count_if(F.col("envelope_id").rlike(normalize.ULID)).alias("valid"))


# --- streaming --------------------------------------------------------------------


def _stream(spark, sf_dir) -> DataFrame:
    """Events as a stream of files."""
    # a file stream reads a folder; the table is its only match
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


@query("SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windowed(spark, sf_dir):
    out = live.drain_totals(live.windowed(_stream(spark, sf_dir), "ts", "event_type"), ["window_start", "event_type"], _folder(spark))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT event_id, CASE WHEN strlen(props) > 9 THEN 'quarantined_events' ELSE 'raw_events' END AS topic FROM events")
def stream_routing(spark, sf_dir):
    routed = live.routed(_stream(spark, sf_dir), "props", firewall.Limits(max_bytes=9))
    return live.drain(routed.select("event_id", "topic"), _folder(spark))


@query("SELECT event_id FROM events")
def stream_dedupe(spark, sf_dir):
    twice = _stream(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")).withColumn("_", F.explode(F.array(F.lit(1), F.lit(2))))
    return live.drain(live.deduplicated(twice, "at", "event_id", "40 days").select("event_id"), _folder(spark))


@query("SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def stream_ring(spark, sf_dir):
    return live.ring(_stream(spark, sf_dir).select("event_id", "event_type"), "event_id", _folder(spark), 500)


@query("SELECT event_id, CASE WHEN strlen(props) > 9 THEN 'quarantined_events' ELSE 'raw_events' END AS topic FROM events")
def stream_topics(spark, sf_dir):
    """One stream, one table for each topic."""
    at = _folder(spark)
    routed = live.routed(_stream(spark, sf_dir), "props", firewall.Limits(max_bytes=9)).select("event_id", "topic")
    topics = {t: f"{at}/{t}" for t in firewall.TOPICS.values()}
    live.route_to(routed, topics, f"{at}/state").awaitTermination()
    parts = [spark.read.schema("event_id long, topic string").parquet(p) for p in topics.values()]
    return functools.reduce(DataFrame.unionByName, parts)
