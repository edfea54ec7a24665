"""Type coercions of text columns; null where a value cannot be coerced."""

from __future__ import annotations

import ipaddress
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .parse import trim_space

# Words, layouts and limits.
TRUE_WORDS = ("true", "t", "1", "yes", "y", "enable", "enabled", "allow", "allowed")
FALSE_WORDS = ("false", "f", "0", "no", "n", "disable", "disabled", "deny", "denied", "block", "blocked")
OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{OCTET}(?:\.{OCTET}){{3}}"
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
ZONED = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX",)
LAYOUTS = ("yyyy-MM-dd HH:mm:ss[.SSS]", "MMM d HH:mm:ss yyyy", "MMM dd HH:mm:ss yyyy", "dd MMM yyyy HH:mm:ss z", "dd MMM yyyy HH:mm:ss Z")
YEARLESS = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d{2}:\d{2}:\d{2})$"
VALIDATOR_LAYOUTS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss Z", "MMM d HH:mm:ss yyyy")


def to_float(c: Column) -> Column:
    """Decimal numbers; the suffixes that a plain cast would take (5d, 5f) are none."""
    t = trim_space(c)
    words = F.lower(t)
    inf = words.rlike(r"^[+-]?(?:inf|infinity)$")
    return F.when(t.rlike(NUMBER), t.try_cast("double")).when(words == "nan", F.lit(float("nan"))).when(inf, F.when(words.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))


def to_integer(c: Column) -> Column:
    """Decimal 64-bit integers, else numbers cut towards zero."""
    t = trim_space(c)
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    return F.coalesce(whole, to_float(c).try_cast("bigint"))


def to_boolean(c: Column) -> Column:
    w = F.lower(trim_space(c))
    return F.when(w.isin(*TRUE_WORDS), True).when(w.isin(*FALSE_WORDS), False)


def _ipv6(c: Column) -> Column:
    def one(x):
        try:
            a = ipaddress.IPv6Address(x)
        except (ValueError, TypeError):
            return None
        return str(a.ipv4_mapped or a)

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return of(c)


def to_ip(c: Column) -> Column:
    """IPv4 as it is, IPv6 in its short form, mapped IPv4 as IPv4.  Only texts with a colon reach Python."""
    t = trim_space(c)
    return F.when(t.rlike(f"^{IPV4}$"), t).when(F.contains(t, F.lit(":")), _ipv6(F.when(F.contains(t, F.lit(":")), t)))


def to_ipv4(c: Column) -> Column:
    """IPv4 only, without Python."""
    t = trim_space(c)
    return F.when(t.rlike(f"^{IPV4}$"), t)


def to_timestamp(c: Column, year: int) -> Column:
    """An instant from epoch seconds, milliseconds or nanoseconds, or one of the layouts; year completes those without."""
    t = trim_space(c)
    n = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    epoch = F.when(n > 10**18, F.timestamp_micros(F.floor(n / 1000).cast("bigint"))).when(n > 10**11, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n))
    # the weekday of RFC 1123 says nothing more, and Spark's parser takes none
    short = F.regexp_replace(F.regexp_replace(t, r"^[A-Z][a-z]{2}, ", ""), r" +", " ")
    layouts = [F.try_to_timestamp(t, F.lit(p)) for p in ZONED] + [F.try_to_timestamp(short, F.lit(p)) for p in LAYOUTS]
    dated = lambda day: F.try_to_timestamp(F.concat(day, F.lit(f" {year}")), F.lit("MMM d HH:mm:ss yyyy"))
    # as in the reference, 29 February is 1 March in a year without it
    leap = dated(F.regexp_replace(short, "^Feb 29 ", "Feb 28 ")) + F.expr("INTERVAL 1 DAY")
    yearless = F.when(t.rlike(YEARLESS), F.when(short.startswith("Feb 29 "), leap).otherwise(dated(short)))
    return F.coalesce(epoch, *layouts, yearless)


def rfc3339(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def timestamp_text(c: Column, year: int) -> Column:
    """RFC 3339 in UTC (of a UTC session)."""
    return rfc3339(to_timestamp(c, year))


def validator_timestamp(c: Column) -> Column:
    """Five layouts; anything else stays as it is."""
    t = trim_space(c)
    return F.coalesce(rfc3339(F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in VALIDATOR_LAYOUTS))), c)


def enum_map(c: Column, values: dict[str, str], loose: bool = True) -> Column:
    """The mapped value: exact, else (loose) by lower case with the first definition, else the text itself."""
    out = c
    if loose:
        out = reduce(lambda rest, kv: F.when(F.lower(c) == kv[0].lower(), kv[1]).otherwise(rest), reversed(values.items()), out)
    return reduce(lambda rest, kv: F.when(c == kv[0], kv[1]).otherwise(rest), values.items(), out)


def coerce(c: Column, kind: str, year: int) -> Column:
    """A value of a declared type, as text."""
    return {
        "string": lambda: c,
        "integer": lambda: to_integer(c).cast("string"),
        "float": lambda: to_float(c).cast("string"),
        "boolean": lambda: to_boolean(c).cast("string"),
        "ip": lambda: to_ip(c),
        "timestamp": lambda: timestamp_text(c, year),
    }[kind]()
