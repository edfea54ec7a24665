"""Identifiers, rendering, type tags and templates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .coerce import IPV4
from .parse import trim_space

# --- identifiers -----------------------------------------------------------

CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(millis: Column, seed: Column) -> Column:
    """A ULID of a time and a seed: 48 bits of time, 80 of SHA-256; the same for the same input."""
    time = F.lpad(F.conv(millis.cast("string"), 10, 32), 10, "0")
    digest = F.sha2(seed.cast("binary"), 256)
    part = lambda at: F.lpad(F.conv(F.substring(digest, at, 10), 16, 32), 8, "0")
    return F.translate(F.concat(time, part(1), part(11)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", CROCKFORD)


def raw_ref(time: Column, source: Column, event: Column) -> Column:
    return F.concat_ws("/", F.lit("raw"), F.date_format(time, "yyyy/MM/dd"), source, event)


def byte_span(text: Column, token: Column) -> tuple[Column, Column]:
    """First and last byte offset (exclusive) of a token's first occurrence; -1 twice if absent."""
    at = F.call_function("instr", text, token)
    start = F.octet_length(F.call_function("left", text, at - 1))
    found = (at > 0) & (F.length(token) > 0)
    return F.when(found, start).otherwise(-1), F.when(found, start + F.octet_length(token)).otherwise(-1)


def template_id(pattern: Column) -> Column:
    """tpl_ and the polynomial hash (base 31, 32 bits) of the code points."""
    codes = F.transform(F.filter(F.split(pattern, ""), lambda c: c != ""), F.ascii)
    h = F.aggregate(codes, F.lit(0).cast("long"), lambda s, c: (s * 31 + c).bitwiseAND(4294967295))
    return F.concat(F.lit("tpl_"), F.lower(F.lpad(F.hex(h), 8, "0")))


# --- rendering -------------------------------------------------------------


def safe_render(c: Column) -> Column:
    """Without terminal escapes; control characters as \\xNN; HTML escaped."""
    c = F.regexp_replace(c, r"\x1b\[[0-9;]*[A-Za-z]", "")
    for code in (*range(9), 11, 12, *range(14, 32), 127):
        c = F.replace(c, F.lit(chr(code)), F.lit(f"\\x{code:02x}"))
    for a, b in (("&", "&amp;"), ("'", "&#39;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


# --- type tags -------------------------------------------------------------

# Patterns of the types, in order.
_HEX4 = "[0-9a-fA-F]{1,4}"
IPV6 = "^(?:" + "|".join([f"(?:{_HEX4}:){{7}}{_HEX4}", f"(?:{_HEX4}:){{1,7}}:", *(f"(?:{_HEX4}:){{1,{7 - n}}}(?::{_HEX4}){{1,{n}}}" for n in range(1, 7)), f":(?:(?::{_HEX4}){{1,7}}|:)", f"::(?:[fF]{{4}}:)?{IPV4}", f"(?:{_HEX4}:){{6}}{IPV4}"]) + ")$"
TYPES = (
    ("null", r"(?i)^(?:null|none|nil|n/a|na|-)$"),
    ("boolean", r"(?i)^(?:true|false|yes|no|on|off)$"),
    ("integer", r"^[+-]?(?:0|[1-9]\d*)$"),
    ("float", r"^[+-]?(?:\d+\.\d+|\d+(?:\.\d+)?[eE][+-]?\d+)$"),
    ("mac_address", r"^(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}$"),
    ("ipv4", f"^{IPV4}$"),
    ("ipv6", IPV6),
    ("uuid", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"),
    ("email", r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"),
    ("url", r"(?i)^(?:https?|ftp|sftp|ws|wss)://[^\s/$.?#].[^\s]*$"),
    ("timestamp", r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?$"),
    ("timestamp", r"^[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?$"),
    ("timestamp", r"^\d{2}/[A-Za-z]{3}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}$"),
)


def infer_type(c: Column) -> Column:
    """The tag of one value's text; null and blank are 'null'."""
    t = trim_space(c)
    tag = F.when(c.isNull() | (t == ""), "null")
    for name, pattern in TYPES:
        tag = tag.when(t.rlike(pattern), name)
    tag = tag.when(t.startswith("{") & t.endswith("}") & F.json_object_keys(t).isNotNull(), "json")
    return tag.when(t.startswith("[") & t.endswith("]") & F.json_array_length(t).isNotNull(), "array").otherwise("string")


# --- templates -------------------------------------------------------------

# Masks, in order.
_MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
MASKS = (
    (r"(?i)\b(?:https?|ftp|sftp)://[^\s]+", "<URL>"),
    (r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b", "<EMAIL>"),
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<TIMESTAMP>"),
    (rf"\b\d{{2}}/{_MONTH}/\d{{4}}:\d{{2}}:\d{{2}}:\d{{2}}\s+[+-]\d{{4}}\b", "<TIMESTAMP>"),
    (rf"\b{_MONTH}\s+\d{{1,2}}\s+\d{{2}}:\d{{2}}:\d{{2}}\b", "<TIMESTAMP>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b", "<MAC>"),
    (rf"\b{IPV4}\b", "<IP>"),
    (r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b|\b(?:[0-9a-fA-F]{1,4}:){1,7}:|:(?::[0-9a-fA-F]{1,4}){1,7}\b", "<IP>"),
    (r"""\b[a-zA-Z]:\\(?:[^\\/:*?"<>|\r\n]+\\)*[^\\/:*?"<>|\r\n]*""", "<PATH>"),
    (r"(?:/[a-zA-Z0-9_.-]+){2,}", "<PATH>"),
    (r"\b0x[0-9a-fA-F]+\b|\b[0-9a-fA-F]{16,64}\b", "<HEX>"),
    (r""""[^"\\]*(?:\\.[^"\\]*)*"|'[^'\\]*(?:\\.[^'\\]*)*'""", '"<STR>"'),
    (r"\b\d+\.\d+\b|\b\d+\b", "<NUM>"),
)


def mask(c: Column) -> Column:
    """The template of a message: variable parts masked, white space collapsed."""
    for pattern, name in MASKS:
        c = F.regexp_replace(c, pattern, name)
    return trim_space(F.regexp_replace(c, r"(?U)\s+", " "))


def variables(template: Column) -> Column:
    return F.regexp_count(template, F.lit("<[A-Z]+>"))
