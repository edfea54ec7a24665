"""Safety gates over raw events, envelopes and routing."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parse import trim_space
from ..functions.text import raw_ref, ulid

ACCEPTED, QUARANTINED, REJECTED = "ACCEPTED", "QUARANTINED", "REJECTED"
TRANSPORTS = ("syslog", "http", "kafka", "file", "tcp", "udp")
TOPICS = {ACCEPTED: "raw_events", QUARANTINED: "quarantined_events", REJECTED: "rejected_events"}


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 65_536
    max_depth: int = 32
    max_key: int = 256
    max_fields: int = 512


def kv_violation(text: Column, limits: Limits) -> Column:
    """Keys of blank-separated tokens (before the first = or else :): too many, or one too long; the earlier in the text wins."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    key = lambda t: F.when(F.contains(t, F.lit("=")), F.substring_index(t, "=", 1)).when(F.contains(t, F.lit(":")), F.substring_index(t, ":", 1))
    keys = F.filter(F.transform(tokens, key), lambda k: k.isNotNull() & (k != ""))
    long_at = F.array_position(F.transform(keys, lambda k: F.length(k) > limits.max_key), F.lit(True))
    many = F.size(keys) > limits.max_fields
    return F.when((long_at > 0) & (~many | (long_at <= limits.max_fields + 1)), "ERR_KEY_TOO_LONG").when(many, "ERR_FIELD_LIMIT_EXCEEDED")


_TOKEN = re.compile(r'\s*("(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|[{}\[\],:]|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null)\s*')

#: What may come next, by state: in an object a first key, a key, a colon, a value, the rest; in an array a first value, a value, the rest; between documents a value.
_FIRST_KEY, _KEY, _COLON, _MEMBER, _AFTER_MEMBER, _FIRST_ITEM, _ITEM, _AFTER_ITEM, _TOP = range(9)
_AFTER_VALUE = {_MEMBER: _AFTER_MEMBER, _FIRST_ITEM: _AFTER_ITEM, _ITEM: _AFTER_ITEM, _TOP: _TOP}
_MARKS = {(_COLON, ":"): _MEMBER, (_AFTER_MEMBER, ","): _KEY, (_AFTER_ITEM, ","): _ITEM}
_ENDS = {(_FIRST_KEY, "}"), (_AFTER_MEMBER, "}"), (_FIRST_ITEM, "]"), (_AFTER_ITEM, "]")}


def _json_violation(text: str, limits: Limits) -> str | None:
    """First violation in token order of a text of JSON documents; what is missing at its end is none."""
    states, fields, at = [_TOP], 0, 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            return "ERR_INVALID_ENCODING"
        at, t, state = m.end(), m[1], states[-1]
        if (state, t) in _MARKS:
            states[-1] = _MARKS[state, t]
        elif (state, t) in _ENDS:
            states.pop()
            states[-1] = _AFTER_VALUE[states[-1]]
        elif t[0] == '"' and state in (_FIRST_KEY, _KEY):
            fields += 1
            if len(json.loads(t)) > limits.max_key:
                return "ERR_KEY_TOO_LONG"
            if fields > limits.max_fields:
                return "ERR_FIELD_LIMIT_EXCEEDED"
            states[-1] = _COLON
        elif state not in _AFTER_VALUE or t in "}],:":
            return "ERR_INVALID_ENCODING"
        elif t in "{[":
            if len(states) > limits.max_depth:
                return "ERR_NESTING_EXCEEDED"
            states.append(_FIRST_KEY if t == "{" else _FIRST_ITEM)
        else:
            if t[0] in "-0123456789" and abs(float(t)) == float("inf"):
                return "ERR_INVALID_ENCODING"
            states[-1] = _AFTER_VALUE[state]
    return None


def json_violation(text: Column, limits: Limits) -> Column:
    """The order of violations needs the token order, so this one gate is an Arrow function."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _json_violation(t, limits))

    return of(text)


def violation(raw: Column, limits: Limits = Limits()) -> Column:
    """Code of the first gate that an event (text or bytes) fails, in the order size, encoding, structure; else null."""
    text = raw.cast("string")
    t = trim_space(text)
    is_json = t.startswith("{") | t.startswith("[")
    return (
        F.when(F.octet_length(raw) > limits.max_bytes, "ERR_OVERSIZED")
        .when(~F.is_valid_utf8(text), "ERR_INVALID_ENCODING")
        .when(is_json, json_violation(F.when(is_json, t), limits))
        .otherwise(kv_violation(text, limits))
    )


def inspect(events: DataFrame, raw: str = "raw", limits: Limits = Limits()) -> DataFrame:
    """Events with violation_code, ingest_status and topic."""
    judged = events.withColumn("violation_code", violation(F.col(raw), limits))
    status = F.when(F.col("violation_code").isNull(), ACCEPTED).otherwise(QUARANTINED)
    return judged.withColumn("ingest_status", status).withColumn("topic", topic(F.col("ingest_status")))


def listener_gate(raw: Column) -> Column:
    """The listener's own rule: NUL characters and table drops are quarantined."""
    return F.when(F.contains(raw, F.lit("\x00")) | F.contains(raw, F.lit("DROP TABLE")), QUARANTINED).otherwise(ACCEPTED)


def topic(status: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in TOPICS.items():
        out = F.when(status == k, v).otherwise(out)
    return out


def seal(events: DataFrame, raw: str, source: str, time: str, transport: str = "syslog") -> DataFrame:
    """Events with their envelope: id, length, SHA-256 and reference; deterministic for the same input."""
    body = F.col(raw).cast("binary")
    sha = F.sha2(body, 256)
    at = F.col(time).cast("timestamp")
    event = ulid(F.unix_millis(at), F.concat_ws("|", sha, F.col(source), F.col(time).cast("string")))
    return (
        events.withColumn("raw_sha256", sha).withColumn("raw_length_bytes", F.octet_length(body).cast("long")).withColumn("envelope_id", event)
        .withColumn("raw_ref", raw_ref(at, F.col(source), F.col("envelope_id"))).withColumn("transport", F.lit(transport))
    )


def envelope_violations(source: Column, transport: Column, raw: Column) -> Column:
    checks = (
        F.when(F.coalesce(trim_space(source), F.lit("")) == "", "source_id is empty"),
        F.when(~F.coalesce(transport.isin(*TRANSPORTS), F.lit(False)), "transport is unknown"),
        F.when(F.coalesce(F.octet_length(raw), F.lit(0)) == 0, "raw is empty"),
    )
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def unseen(events: DataFrame, stored: DataFrame, key: str = "event_id") -> DataFrame:
    """Write-once: events whose id is not in the store yet; equal bytes under other ids stay."""
    return events.join(stored.select(key), key, "left_anti").dropDuplicates([key])
