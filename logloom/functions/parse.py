"""Format parsers as column expressions.

A parser turns a raw line into *entries*, an array of (k, v) strings in the
order of appearance, where a later entry with the same key wins.  Entries keep
duplicate keys out of Spark's map constructors and need no session setting.

Two dialects exist on purpose: ``strict`` is that of the ingest runtime, and
``profile`` that of the source profiler; they differ in quoting, bare words,
header rules and key names.
"""

from __future__ import annotations

import json
import re
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRIES = "array<struct<k:string,v:string>>"

# Patterns of the formats.
SYSLOG_5424 = r"(?s)^<(\d+)>(\d+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(?:\[(.*?)\]|-)\s*(.*)$"
SYSLOG_3164 = r"(?s)^<(\d+)>([A-Za-z]{3}\s+\d+\s+\d+:\d+:\d+)\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
PROFILE_5424 = r"(?s)^<(\d{1,3})>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)(?:\s+(.*))?$"
PROFILE_3164 = r"(?s)^<(\d{1,3})>([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([^:\[\s]+)(?:\[(\d+)\])?:\s*(.*)$"
_PART = r"([^\\|]*(?:\\.[^\\|]*)*)"
PROFILE_CEF = r"(?s)^CEF:\s*(\d+)\s*\|" + rf"{_PART}\|" * 6 + r"(.*)$"
PROFILE_LEEF = r"(?s)^LEEF:\s*([0-9.]+)\s*\|" + rf"{_PART}\|" * 3 + _PART + r"(?:\|(.*))?$"
PROFILE_KV = r"""([a-zA-Z0-9_.\-/]+)\s*=\s*("[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'|[^\s,;]+)"""
CEF_PAIR = r"(?s)([a-zA-Z0-9_.\-]+)\s*=\s*(.*?)(?=\s+[a-zA-Z0-9_.\-]+\s*=|$)"


#: Characters with the Unicode property White_Space.
WHITE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def trim_space(c: Column) -> Column:
    """Without white space at both ends, beyond the blanks that trim() takes."""
    return F.btrim(c, F.lit(WHITE))


def empty() -> Column:
    return F.array().cast(ENTRIES)


def entry(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("k"), value.cast("string").alias("v"))


def entries(*pairs: tuple[str, Column]) -> Column:
    """Entries of fixed keys; null values are left out."""
    return F.filter(F.array(*(entry(k, v) for k, v in pairs)), lambda e: e["v"].isNotNull())


def zipped(keys: Column, values: Column) -> Column:
    return F.transform(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: F.struct(e["k"].alias("k"), e["v"].alias("v"))).cast(ENTRIES)


def let(value: Column, body) -> Column:
    """The body of a value that is evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are evaluated once, however many later columns and filters name them: no projection is merged with a generator."""
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    made = F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    return rows.select(*kept, made)


def groups(text: Column, pattern: str, n: int) -> Column:
    """All groups of a pattern that the whole text matches, by one match; a text with the mark itself is matched group by group."""
    mark = "\x1f"
    one = F.split(F.regexp_replace(text, pattern, mark.join(f"${k}" for k in range(1, n + 1))), mark, n)
    return F.when(F.contains(text, F.lit(mark)), F.array(*(F.regexp_extract(text, pattern, k) for k in range(1, n + 1)))).otherwise(one)


def last_wins(found: Column) -> Column:
    """One entry for each key, the last."""
    return F.filter(found, lambda e, i: ~F.exists(F.slice(found, i + 2, F.greatest(F.size(found) - i - 1, F.lit(0))), lambda x: x["k"] == e["k"]))


def lookup(found: Column, key: str) -> Column:
    """Value of the last entry with this key, else of the last whose key differs in case only, else null."""
    exact = F.try_element_at(F.filter(found, lambda e: e["k"] == key), F.lit(-1))["v"]
    loose = F.try_element_at(F.filter(found, lambda e: F.lower(e["k"]) == key.lower()), F.lit(-1))["v"]
    return F.coalesce(exact, loose)


def value(found: Column, key: str) -> Column:
    """Value of the last entry with exactly this key."""
    return F.try_element_at(F.filter(found, lambda e: e["k"] == key), F.lit(-1))["v"]


def as_map(found: Column) -> Column:
    return F.map_from_entries(last_wins(found))


def _class(chars: str) -> str:
    return "".join(re.escape(c) if c not in "\t\n\r" else {"\t": r"\t", "\n": r"\n", "\r": r"\r"}[c] for c in chars)


def kv_strict(text: Column, pair: str = " ", sep: str = "=") -> Column:
    """Pairs from the start on, until the first bare token; quotes group, escapes stay."""
    p, k = _class(pair or " "), _class((sep or "=")[0])
    one = rf"""(?s)\G[{p} \t]*([^{k}{p}]*){k}("(?:\\.|[^"\\]|\\$)*+"?|'(?:\\.|[^'\\]|\\$)*+'?|[^{p}]*)"""
    keys = F.transform(F.regexp_extract_all(text, F.lit(one), 1), trim_space)
    raw = F.regexp_extract_all(text, F.lit(one), 2)
    double, single = r'(?s)^"((?:\\.|[^"\\]|\\$)*+)"?$', r"(?s)^'((?:\\.|[^'\\]|\\$)*+)'?$"
    values = F.transform(raw, lambda v: F.when(v.startswith('"'), F.regexp_extract(v, double, 1)).when(v.startswith("'"), F.regexp_extract(v, single, 1)).otherwise(trim_space(v)))
    return F.filter(zipped(keys, values), lambda e: e["k"] != "")


def _unescape(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def kv_profile(text: Column) -> Column:
    """All key=value pairs; bare words are skipped; quoted values are unescaped."""
    raw = F.regexp_extract_all(text, F.lit(PROFILE_KV), 2)
    inner = lambda v: F.substring(v, F.lit(2), F.length(v) - 2)
    quoted = lambda v: F.length(v) >= 2
    bare = lambda v: F.when(quoted(v) & ((v.startswith('"') & v.endswith('"')) | (v.startswith("'") & v.endswith("'"))), inner(v)).otherwise(v)
    values = F.transform(raw, lambda v: _unescape(bare(v), (('\\"', '"'), ("\\'", "'"), ("\\\\", "\\"), ("\\=", "="))))
    return zipped(F.regexp_extract_all(text, F.lit(PROFILE_KV), 1), values)


def _or_null(c: Column, null: str = "") -> Column:
    return F.when(c != null, c)


def _pri(pri: Column) -> list[tuple[str, Column]]:
    n = pri.cast("int")
    return [("prival", n), ("facility", F.floor(n / 8)), ("severity", n % 8)]


def syslog_strict(raw: Column) -> tuple[Column, Column]:
    """Header entries and body: RFC 5424, else RFC 3164, else a bare priority, else all body."""
    t = trim_space(raw)
    a = lambda i: F.regexp_extract(t, SYSLOG_5424, i)
    b = lambda i: F.regexp_extract(t, SYSLOG_3164, i)
    bare = r"(?s)^<(\d{1,3})>(.*)$"
    head = (
        F.when(t.rlike(SYSLOG_5424), entries(*_pri(a(1)), ("syslog_version", a(2).cast("int")), ("timestamp", a(3)), ("hostname", a(4)), ("app_name", a(5)), ("proc_id", a(6)), ("msg_id", a(7)), ("structured_data", _or_null(a(8)))))
        .when(t.rlike(SYSLOG_3164), entries(*_pri(b(1)), ("timestamp", b(2)), ("hostname", b(3)), ("app_name", b(4)), ("proc_id", _or_null(b(5)))))
        .when(t.rlike(bare), entries(*_pri(F.regexp_extract(t, bare, 1))))
        .otherwise(empty())
    )
    body = F.when(t.rlike(SYSLOG_5424), a(9)).when(t.rlike(SYSLOG_3164), b(6)).when(t.rlike(bare), trim_space(F.regexp_extract(t, bare, 2))).otherwise(t)
    return head, body


def syslog_profile(raw: Column) -> Column:
    """RFC 5424 (version 1, dashes are null, structured data flattened) or RFC 3164."""
    t = trim_space(raw)
    a = lambda i: F.regexp_extract(t, PROFILE_5424, i)
    b = lambda i: F.regexp_extract(t, PROFILE_3164, i)
    rest = a(7)
    data = F.regexp_extract(rest, r'(?s)^((?:\[(?:[^\]"]|"(?:\\.|[^"\\])*")*\])+)', 1)
    message = trim_space(F.when(data != "", F.substring(rest, F.length(data) + 1, F.length(rest))).when(rest.startswith("-"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest))
    blocks = F.regexp_extract_all(data, F.lit(r'(?s)\[((?:[^\]"]|"(?:\\.|[^"\\])*")*)\]'), 1)
    pair = r'(?s)([^\s=\]"]+)="((?:\\.|[^"\\])*)"'

    def flat(block: Column) -> Column:
        name = F.regexp_extract(block, r"^(\S+)", 1)
        found = zipped(F.transform(F.regexp_extract_all(block, F.lit(pair), 1), lambda k: F.concat(F.lit("sd_"), name, F.lit("_"), k)), F.transform(F.regexp_extract_all(block, F.lit(pair), 2), lambda v: F.regexp_replace(v, r'\\(["\\\]])', "$1")))
        return found

    header = entries(*_pri(a(1)), ("version", F.lit(1)), ("timestamp", _or_null(a(2), "-")), ("hostname", _or_null(a(3), "-")), ("app_name", _or_null(a(4), "-")), ("procid", _or_null(a(5), "-")), ("msgid", _or_null(a(6), "-")))
    modern = F.concat(header, F.flatten(F.transform(blocks, flat)), entries(("message", _or_null(message))))
    old = entries(*_pri(b(1)), ("timestamp", b(2)), ("hostname", b(3)), ("tag", b(4)), ("pid", _or_null(b(5))), ("message", b(6)))
    return F.when(t.rlike(PROFILE_5424), modern).when(t.rlike(PROFILE_3164), old)


CEF_KEYS = ("device_vendor", "device_product", "device_version", "device_event_class_id", "name", "severity")


def cef_strict(raw: Column) -> Column:
    """Seven header fields at unescaped bars (only bars are unescaped), then strict pairs; null if malformed."""
    t = trim_space(raw)
    body = F.substring(t, F.lit(5), F.length(t))
    parts = F.split(body, r"(?<!\\)\|", 8)
    part = lambda i: F.replace(F.get(parts, F.lit(i)), F.lit("\\|"), F.lit("|"))
    head = entries(("cef_version", F.coalesce(F.get(parts, F.lit(0)).try_cast("int"), F.lit(0))), *((k, part(i + 1)) for i, k in enumerate(CEF_KEYS)))
    return F.when(t.startswith("CEF:") & (F.size(parts) >= 7), F.concat(head, kv_strict(F.coalesce(F.get(parts, F.lit(7)), F.lit("")))))


def _cef_text(c: Column) -> Column:
    return _unescape(c, (("\\=", "="), ("\\|", "|"), ("\\\\", "\\"), ("\\n", "\n"), ("\\r", "\r")))


def cef_profile(raw: Column) -> Column:
    """Seven unescaped bars; extension values may hold blanks; null if malformed."""
    t = trim_space(raw)

    def record(g: Column) -> Column:
        head = entries(("cef_version", g[0]), *((k, _cef_text(trim_space(g[i + 1]))) for i, k in enumerate(CEF_KEYS)))
        return F.concat(head, let(trim_space(g[7]), pairs))

    def pairs(rest: Column) -> Column:
        return zipped(F.regexp_extract_all(rest, F.lit(CEF_PAIR), 1), F.transform(F.regexp_extract_all(rest, F.lit(CEF_PAIR), 2), lambda v: _cef_text(trim_space(v))))

    return F.when(t.rlike(PROFILE_CEF), let(groups(t, PROFILE_CEF, 8), record))


def leef_strict(raw: Column) -> Column:
    """Plain bars; version 2.0 names its delimiter (x20, x09 or itself); null if malformed.

    The delimiter is data, so the scan runs for the blank, the tab and, as
    character class, any other single character through a translated text.
    """
    t = trim_space(raw)
    parts = F.split(F.substring(t, F.lit(6), F.length(t)), r"\|")
    part = lambda i: F.get(parts, F.lit(i))
    modern = part(0).startswith("2.0")
    named = F.when(modern, F.coalesce(part(5), F.lit(""))).otherwise("")
    rest = F.when(modern, F.array_join(F.slice(parts, 7, F.greatest(F.size(parts), F.lit(1))), "|")).otherwise(F.array_join(F.slice(parts, 6, F.greatest(F.size(parts), F.lit(1))), "|"))
    own = (named != "") & ~named.isin("x20", "x09", " ", "\t")
    # any other delimiter becomes the unit separator, a character that logs do not hold
    pairs = F.when((named == "x20") | (named == " "), kv_strict(rest, " ")).when(own, kv_strict(F.call_function("translate", rest, named, F.repeat(F.lit("\x1f"), F.length(named).cast("int"))), "\x1f")).otherwise(kv_strict(rest, "\t"))
    head = entries(("leef_version", part(0)), ("vendor", part(1)), ("product", part(2)), ("version", part(3)), ("event_id", part(4)))
    return F.when(t.startswith("LEEF:") & (F.size(parts) >= 5), F.concat(head, pairs))


def leef_profile(raw: Column) -> Column:
    """Escaped bars; any hex or literal delimiter; tokens split at their first equals sign; null if malformed."""
    t = trim_space(raw)

    def record(g: Column) -> Column:
        rest = g[5]
        named = F.regexp_extract(rest, r"(?s)^([^|]*)\|", 1)
        modern = g[0].startswith("2") & rest.rlike(r"(?s)^[^|]{0,6}\|")
        code = F.regexp_extract(named, r"^(?:0?x)([0-9a-fA-F]{1,2})$", 1)
        mark = F.when(~modern | (named == "") | (named == "\\t"), F.lit("\t")).when(code != "", F.call_function("char", F.conv(code, 16, 10).cast("long"))).otherwise(named)
        ext = F.when(modern, F.regexp_replace(rest, r"(?s)^[^|]*\|", "")).otherwise(rest)
        tokens = F.filter(F.call_function("split", ext, F.concat(F.lit(r"\Q"), mark, F.lit(r"\E"))), lambda x: F.contains(x, F.lit("=")))
        head = entries(("leef_version", g[0]), ("vendor", g[1]), ("product", g[2]), ("version", g[3]), ("event_id", g[4]))
        return F.concat(head, let(tokens, pairs))

    def pairs(tokens: Column) -> Column:
        found = zipped(F.transform(tokens, lambda x: trim_space(F.substring_index(x, "=", 1))), F.transform(tokens, lambda x: trim_space(F.substring(x, F.instr(x, "=") + 1, F.length(x)))))
        return F.filter(found, lambda e: e["k"] != "")

    return F.when(t.rlike(PROFILE_LEEF), let(groups(t, PROFILE_LEEF, 6), record))


def csv_record(raw: Column, delimiter: str = ",") -> Column:
    """Cells of one record; quotes as RFC 4180."""
    d = _class(delimiter)
    cell = rf'(?s)(?:^|{d})("(?:[^"]|"")*"|[^{d}]*)'
    cells = F.regexp_extract_all(trim_space(raw), F.lit(cell), 1)
    return F.transform(cells, lambda c: F.when(c.startswith('"') & c.endswith('"') & (F.length(c) >= 2), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def csv_strict(raw: Column, headers: list[str], delimiter: str = ",") -> Column:
    """Cells under their headers; those beyond are col<i>."""
    cells = csv_record(raw, delimiter)
    names = F.array(*map(F.lit, headers)) if headers else F.array().cast("array<string>")
    key = lambda i: F.coalesce(_or_null(F.get(names, i)), F.concat(F.lit("col"), i.cast("string")))
    return F.transform(cells, lambda c, i: F.struct(key(i).alias("k"), c.alias("v"))).cast(ENTRIES)


def csv_profile(raw: Column, headers: list[str] | None, delimiter: str = ",") -> Column:
    """Cells under their headers if there are as many, else under column_<i> from 1."""
    cells = csv_record(raw, delimiter)
    by_place = F.transform(cells, lambda c, i: F.struct(F.concat(F.lit("column_"), (i + 1).cast("string")).alias("k"), c.alias("v"))).cast(ENTRIES)
    if not headers:
        return by_place
    return F.when(F.size(cells) == len(headers), csv_strict(raw, headers, delimiter)).otherwise(by_place)


def _members(text: Column) -> Column:
    """Members of a JSON object; nested values as JSON text."""
    # from_json keeps nested objects and arrays as text
    return F.map_entries(F.from_json(text, "map<string,string>"))


class _Number(str):
    """A JSON number as it is written."""

    def inner(self) -> str:
        """As from_json writes it below the top: fractions as Java's doubles."""
        if not set(self) & set(".eE"):
            return str(self)
        x = float(self)
        if abs(x) == float("inf"):
            return "Infinity" if x > 0 else "-Infinity"
        if x == 0 or 1e-3 <= abs(x) < 1e7:
            return repr(x)
        sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
        text = "".join(map(str, digits))
        return f"{'-' * sign}{text[0]}.{text[1:] or '0'}E{exponent + len(text) - 1}"


class _Object(list):
    """Members of a JSON object in order, repeated keys kept."""


def _quoted(text: str) -> str:
    """A JSON string as from_json writes it: upper-case escapes, also of what is beyond 16 bits."""
    pair = lambda m: "".join(f"\\u{m[0].encode('utf-16-be')[k : k + 2].hex().upper()}" for k in (0, 2))
    return re.sub(r"[\U00010000-\U0010ffff]", pair, re.sub(r"\\(\\|u[0-9a-f]{4})", lambda m: "\\" + m[1][0] + m[1][1:].upper(), json.dumps(text, ensure_ascii=False)))


def _json_text(v, inner: bool) -> str | None:
    """A value as text, without blanks between tokens; null if it is null."""
    if isinstance(v, _Number):
        return v.inner() if inner else str(v)
    if isinstance(v, str) or v is None:
        return v
    out, todo = [], [(v, True)]
    while todo:
        x, is_value = todo.pop()
        if not is_value:
            out.append(x)
        elif isinstance(x, _Number):
            text = x.inner()
            out.append(_quoted(text) if text.endswith("y") else text)
        elif isinstance(x, (_Object, list)):
            ends = "{}" if isinstance(x, _Object) else "[]"
            todo.append((ends[1], False))
            for k in range(len(x) - 1, -1, -1):
                todo.append((x[k][1] if isinstance(x, _Object) else x[k], True))
                if isinstance(x, _Object):
                    todo.append((_quoted(x[k][0]) + ":", False))
                if k:
                    todo.append((",", False))
            out.append(ends[0])
        else:
            out.append(_quoted(x) if isinstance(x, str) else json.dumps(x))
    return "".join(out)


def _flat(text: str | None, parents: bool) -> list[dict] | None:
    try:
        top = json.loads(text, object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_Number) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, _Object):
        return None
    out, todo = [], [(k, v, False) for k, v in reversed(top)]
    while todo:
        k, v, below = todo.pop()
        inner = isinstance(v, _Object) and len(v) > 0
        if parents or not inner:
            out.append({"k": k, "v": _json_text(v, below)})
        if inner:
            todo += [(f"{k}.{name}", x, True) for name, x in reversed(v)]
    return out


def _json_deep(text: Column, parents: bool) -> Column:
    @F.pandas_udf(ENTRIES)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: _flat(x, parents))

    return of(text)


def json_flat(raw: Column, parents: bool, levels: int = 4) -> Column:
    """Dotted entries of a JSON object, to any depth; parents keeps each object under its own key too (strict); null if no object.

    Columns open the given number of levels; only texts with more braces reach Python.
    """
    t = trim_space(raw)
    is_object = lambda v: v.startswith("{") & v.endswith("}") & (F.size(F.json_object_keys(v)) > 0)

    def opened(found: Column, left: int) -> Column:
        if not left:
            return found

        def one(e: Column) -> Column:
            own = F.array(F.struct(e["k"].alias("k"), e["v"].alias("v"))).cast(ENTRIES)
            inner = F.transform(F.coalesce(_members(e["v"]), F.array().cast("array<struct<key:string,value:string>>")), lambda m: F.struct(F.concat(e["k"], F.lit("."), m["key"]).alias("k"), m["value"].alias("v"))).cast(ENTRIES)
            deeper = opened(inner, left - 1)
            return F.when(F.coalesce(is_object(e["v"]), F.lit(False)), F.concat(own, deeper) if parents else deeper).otherwise(own)

        return F.flatten(F.transform(found, one))

    top = F.transform(_members(t), lambda m: F.struct(m["key"].alias("k"), m["value"].alias("v"))).cast(ENTRIES)
    ok = t.startswith("{") & t.endswith("}") & F.json_object_keys(t).isNotNull()
    deep = F.length(t) - F.length(F.replace(t, F.lit("{"), F.lit(""))) > levels + 1
    return F.when(ok, F.coalesce(_json_deep(F.when(ok & deep, t), parents), opened(top, levels)))


def json_type(value: Column) -> Column:
    """Tag of a JSON value's text, native types kept: a quoted number is a string."""
    t = F.schema_of_variant(F.try_parse_json(value))
    return (
        F.when(t == "VOID", "null").when(t == "BOOLEAN", "boolean").when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.when(t.endswith(",0)"), "integer").otherwise("float"))
        .when(t == "STRING", "string").when(t.startswith("ARRAY"), "array").when(t.startswith("OBJECT"), "json")
    )


def flat_event(raw: Column) -> Column:
    """Leaves (k, v, t) of a JSON event by dotted key with the tags of their types, without private and unknown parts.

    Arrays are leaves; so are empty objects, which the flat form of an event drops.
    """

    @F.pandas_udf("array<struct<k:string,v:string,t:string>>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(_flat_typed)

    return of(raw)


def _tag(v) -> str:
    for kind, name in ((_Number, "number"), (bool, "boolean"), (str, "string"), (_Object, "json"), (list, "array")):
        if isinstance(v, kind):
            return ("float" if set(v) & set(".eE") else "integer") if name == "number" else name
    return "null"


def _flat_typed(text: str | None) -> list[dict] | None:
    try:
        top = json.loads(text, object_pairs_hook=_Object, parse_int=_Number, parse_float=_Number, parse_constant=_Number) if text is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, _Object):
        return None
    out, todo = {}, [("", top)]
    while todo:
        prefix, members = todo.pop()
        for k, v in members:
            if k.startswith("_") or k == "unknown_fields":
                continue
            if isinstance(v, _Object):
                todo.append((f"{prefix}{k}.", v))
            else:
                out[prefix + k] = {"k": prefix + k, "v": _json_text(v, True), "t": _tag(v)}
    return list(out.values())


def project(found: Column, fields: dict) -> Column:
    """Entries of an event that is structured already: known keys under their canonical path, enums applied, all others as they are."""
    keys = F.create_map(*(F.lit(x) for k, f in fields.items() for x in (k, f.get("map_to", k))))

    def one(e: Column) -> Column:
        v = e["v"]
        for k, f in fields.items():
            for raw, meaning in (f.get("enum") or {}).items():
                v = F.when((e["k"] == k) & (e["v"] == raw), meaning).otherwise(v)
        return F.struct(F.coalesce(F.try_element_at(keys, e["k"]), e["k"]).alias("k"), v.alias("v"))

    return F.transform(found, one).cast(ENTRIES)


FORMATS = ("CEF", "LEEF", "SYSLOG_RFC5424", "SYSLOG_RFC3164", "JSON", "KEY_VALUE", "TEXT")
CONFIDENCE = {"CEF": 1.0, "LEEF": 1.0, "SYSLOG_RFC5424": 1.0, "SYSLOG_RFC3164": 0.95, "JSON": 1.0, "KEY_VALUE": 0.9, "TEXT": 0.5}


def is_kv(text: Column) -> Column:
    """At least two pairs that cover 35 % of the text, or three; no other format's prefix."""
    t = trim_space(text)
    n = F.regexp_count(t, F.lit(PROFILE_KV))
    covered = F.aggregate(F.regexp_extract_all(t, F.lit(f"({PROFILE_KV})"), 1), F.lit(0), lambda s, x: s + F.length(x))
    other = t.startswith("CEF:") | t.startswith("LEEF:") | t.startswith("<") | (t.startswith("{") & t.endswith("}"))
    return ~other & (n >= 2) & ((covered >= 0.35 * F.length(t)) | (n >= 3))


def detect_format(raw: Column) -> Column:
    """One line's format, in fixed order."""
    t = trim_space(raw)
    is_json = t.startswith("{") & t.endswith("}") & F.json_object_keys(t).isNotNull()
    return (
        F.when(t.startswith("CEF:"), "CEF").when(t.startswith("LEEF:"), "LEEF").when(t.rlike(PROFILE_5424), "SYSLOG_RFC5424")
        .when(t.rlike(PROFILE_3164), "SYSLOG_RFC3164").when(is_json, "JSON").when(is_kv(raw), "KEY_VALUE").otherwise("TEXT")
    )
