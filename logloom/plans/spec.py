"""Parser specifications: validation, and compilation into columns."""

from __future__ import annotations

import hashlib
import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import coerce, parse

# The vocabulary of specifications.
FORMATS = ("syslog", "json", "cef", "leef", "key_value", "csv")
BODY_TYPES = ("key_value", "json", "cef", "leef", "syslog", "csv")
FIELD_TYPES = ("string", "integer", "float", "boolean", "ip", "timestamp")
OPERATIONS = ("trim", "lowercase", "uppercase", "enum_map", *FIELD_TYPES[1:])
#: Allowed in specifications, without effect.
INERT = ("split", "join", "substring", "regex_extract", "json_pointer", "key_value", "cef_parse", "leef_parse", "syslog_parse", "csv_parse")
KEYS = {
    "": ("dsl_version", "parser", "match", "body_parser", "fields", "unknown_fields", "raw"),
    "parser": ("id", "version"),
    "match": ("format", "body_contains"),
    "body_parser": ("type", "pair_separator", "key_value_separator", "delimiter", "headers"),
    "unknown_fields": ("policy",),
    "raw": ("preserve",),
}
FIELD_KEYS = ("type", "map_to", "enum", "transformations")


def load(text: str) -> dict[str, Any]:
    """A specification from JSON; unknown keys and violations raise."""
    spec = json.loads(text)
    found = violations(spec)
    if found:
        raise ValueError("; ".join(found))
    return spec


def violations(spec: Any) -> list[str]:
    if not isinstance(spec, dict):
        return ["a specification is an object"]
    out = []
    for part, allowed in KEYS.items():
        have = spec if not part else spec.get(part, {})
        out += [f"unknown key {part + '.' if part else ''}{k}" for k in have if k not in allowed]
    need = lambda ok, what: None if ok else out.append(what)
    need(spec.get("dsl_version") == "1.0", "dsl_version must be 1.0")
    need(spec.get("parser", {}).get("id"), "parser.id is missing")
    need(spec.get("parser", {}).get("version"), "parser.version is missing")
    need(spec.get("match", {}).get("format") in FORMATS, "match.format is unknown")
    need(spec.get("body_parser", {}).get("type") in BODY_TYPES, "body_parser.type is unknown")
    need(spec.get("fields"), "fields are missing")
    need(spec.get("unknown_fields", {}).get("policy") == "preserve", "unknown_fields.policy must be preserve")
    need(spec.get("raw", {}).get("preserve") is True, "raw.preserve must be true")
    for name, f in (spec.get("fields") or {}).items():
        out += [f"unknown key fields.{name}.{k}" for k in f if k not in FIELD_KEYS]
        need(f.get("type") in FIELD_TYPES, f"fields.{name}.type is unknown")
        need(f.get("map_to"), f"fields.{name}.map_to is missing")
        out += [f"fields.{name}: unknown operation {o}" for o in f.get("transformations") or () if o not in OPERATIONS + INERT]
    return out


def spec_hash(source: str, code: str) -> str:
    return hashlib.sha256(f"{source}:{code}".encode()).hexdigest()[:16]


def merge_overrides(deterministic: dict, assist: dict | None = None, reviewer: dict | None = None) -> dict:
    """Field mappings: assist fills gaps only, the reviewer decides all."""
    return {**(assist or {}), **deterministic, **(reviewer or {})}


def guess_type(path: str) -> str:
    """Type of a canonical path by parts of its name."""
    if "ip" in path.split(".")[-1]:
        return "ip"
    if "port" in path or "status_code" in path:
        return "integer"
    if "time" in path:
        return "timestamp"
    return "boolean" if "is_" in path or "enabled" in path else "string"


def generate(source: str, kind: str, mapping: dict[str, str]) -> dict[str, Any]:
    """A specification from a mapping of raw fields to canonical paths."""
    return {
        "dsl_version": "1.0", "parser": {"id": f"{source}_parser", "version": "1.0.0"}, "match": {"format": kind, "body_contains": []},
        "body_parser": {"type": kind}, "fields": {k: {"type": guess_type(v), "map_to": v, "transformations": ["trim"]} for k, v in mapping.items()},
        "unknown_fields": {"policy": "preserve"}, "raw": {"preserve": True},
    }


def emitted(target: str, source: str, kind: str, mapping: dict[str, str]) -> str:
    """A mapping of raw fields to canonical paths as text: a specification, SQL over a table of raw fields, a remap program, or JSON."""
    if target == "spec":
        return json.dumps(generate(source, kind, mapping), indent=2)
    if target == "sql":
        return "SELECT " + ", ".join(f"`{raw}` AS `{path}`" for raw, path in mapping.items()) + f" FROM `{source}`"
    if target == "remap":
        return "\n".join(f".{path} = delete(.{raw})" for raw, path in mapping.items())
    if target == "json":
        return json.dumps(mapping, indent=2)
    raise ValueError(f"unknown target {target}")


def matches(spec: dict, raw: Column) -> Column:
    """Whether a line is one for this specification."""
    t = parse.trim_space(raw)
    kind = spec["match"]["format"]
    ok = {
        "syslog": lambda: t.startswith("<"),
        "json": lambda: t.startswith("{") & t.endswith("}"),
        "cef": lambda: t.startswith("CEF:"),
        "leef": lambda: t.startswith("LEEF:"),
        "key_value": lambda: F.contains(raw, F.lit("=")),
        "csv": lambda: F.contains(raw, F.lit(spec["body_parser"].get("delimiter") or ",")),
    }[kind]()
    for token in spec["match"].get("body_contains") or ():
        ok = ok & F.contains(raw, F.lit(token))
    return F.coalesce(ok & (raw != ""), F.lit(False))


def raw_fields(spec: dict, raw: Column) -> Column:
    """Entries of a line by the body parser (strict dialect); null where it cannot be parsed."""
    body = spec["body_parser"]
    kind, pair, sep = body["type"], body.get("pair_separator") or " ", body.get("key_value_separator") or "="
    if kind == "key_value" and spec["match"]["format"] == "syslog":
        head, rest = parse.syslog_strict(raw)
        both = F.concat(head, parse.kv_strict(rest, pair, sep))
        return F.when(parse.trim_space(raw).startswith("<"), both).otherwise(parse.kv_strict(raw, pair, sep))
    if kind == "syslog":
        head, rest = parse.syslog_strict(raw)
        return F.concat(head, parse.entries(("message", rest)))
    return {
        "key_value": lambda: parse.kv_strict(raw, pair, sep),
        "json": lambda: parse.json_flat(raw, parents=True),
        "cef": lambda: parse.cef_strict(raw),
        "leef": lambda: parse.leef_strict(raw),
        "csv": lambda: parse.csv_strict(raw, body.get("headers") or [], body.get("delimiter") or ","),
    }[kind]()


def _field(c: Column, field: dict, year: int) -> tuple[Column, Column]:
    """Coerced value and whether coercion failed."""
    enum = field.get("enum") or {}
    for op in field.get("transformations") or ():
        if op == "trim":
            c = parse.trim_space(c)
        elif op == "lowercase":
            c = F.lower(c)
        elif op == "uppercase":
            c = F.upper(c)
        elif op == "enum_map":
            c = coerce.enum_map(c, enum) if enum else c
        elif op in FIELD_TYPES:
            c = F.coalesce(coerce.coerce(c, op, year), c)
    if field["type"] == "string":
        return (coerce.enum_map(c, enum) if enum else c), F.lit(False)
    value = coerce.coerce(c, field["type"], year)
    return value, c.isNotNull() & value.isNull()


def extractor(kind: str) -> str:
    """Canonical name of a body parser in lineage."""
    return {"syslog": "syslog_parse", "cef": "cef_parse", "leef": "leef_parse", "json": "json_pointer", "csv": "csv_parse", "key_value": "key_value"}.get(kind, "key_value")


def apply(events: DataFrame, spec: dict, raw: str = "raw", year: int = 2024) -> DataFrame:
    """Events with fields (entries), one column x_<path> per canonical path, unknown (entries), errors and lineage.

    Catalyst prunes whatever of these is not asked for.
    """
    out = parse.once(events, fields=raw_fields(spec, F.col(raw)))
    found_by_place = [parse.lookup(F.col("fields"), name).alias(f"f{k}") for k, name in enumerate(spec["fields"])]
    out = parse.once(out, _found=F.struct(*found_by_place)) if found_by_place else out
    by_path: dict[str, list[Column]] = {}
    errors, lineage = [], []
    low = F.lower(F.col(raw))
    kind = spec["body_parser"]["type"]
    for k, (name, field) in enumerate(spec["fields"].items()):
        value, failed = _field(F.col("_found")[f"f{k}"], field, year)
        by_path.setdefault(field["map_to"], []).append(value)
        errors.append(F.when(failed, F.lit(f'field "{name}" type conversion error')))
        located = F.lit(True) if kind in ("json", "csv") else F.contains(low, F.lit(name.lower())) | F.contains(low, F.lower(value))
        evidence = F.array(F.lit("alias_match"), F.lit("type_match"), F.lit("event_family_context"))
        locator = F.lit("/" + name.replace(".", "/")) if kind == "json" else F.lit(name)
        approved = [o for o in field.get("transformations") or () if o in OPERATIONS]
        lineage.append(
            F.when(value.isNotNull() & located, F.struct(
                F.lit(field["map_to"]).alias("normalized_path"), F.lit("json_pointer" if kind == "json" else "key").alias("locator_type"), locator.alias("locator_value"), F.lit(extractor(kind)).alias("extractor"),
                F.array(*map(F.lit, approved)).cast("array<string>").alias("transformations"), F.lit(1.0).alias("mapping_score"), evidence.alias("mapping_evidence"), F.lit("AUTO_ACCEPTED").alias("review_status"),
            ))
        )
    for path, values in by_path.items():
        out = out.withColumn(column(path), F.coalesce(*reversed(values)))
    used = [n.lower() for n in spec["fields"]]
    present = lambda x: x.isNotNull()
    return (
        out.withColumn("unknown", F.filter(parse.last_wins(F.coalesce("fields", parse.empty())), lambda e: ~F.lower(e["k"]).isin(*used)))
        .withColumn("errors", F.filter(F.array(*errors), present))
        .withColumn("lineage", F.filter(F.array(*lineage), present))
        .drop("_found")
    )


def column(path: str) -> str:
    """Column that holds a canonical path."""
    return "x_" + path.replace(".", "_")


def route(events: DataFrame, specs: list[dict], raw: str = "raw") -> DataFrame:
    """Events with parser_id: the first specification that matches."""
    out = F.lit(None).cast("string")
    for spec in reversed(specs):
        out = F.when(matches(spec, F.col(raw)), spec["parser"]["id"]).otherwise(out)
    return events.withColumn("parser_id", out)
