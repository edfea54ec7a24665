"""A whole source's profile: format, header, parsed records with fallback, field statistics and templates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import infer_type
from . import profile

#: Lines that decide the format.
SAMPLE_LINES = 1000
#: Share of otherwise structured lines from which a delimiter counts no more, and the confidence in CSV.
STRUCTURED, CSV_CONFIDENCE = 0.2, 0.95


@dataclass(frozen=True)
class Format:
    name: str
    confidence: float
    delimiter: str | None = None
    headers: tuple[str, ...] | None = None


def nonblank(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Lines without those that are blank, trimmed."""
    return parse.once(lines, **{raw: parse.trim_space(F.col(raw))}).where(F.col(raw) != "")


def detect(lines: DataFrame, raw: str = "raw", order: str = "line") -> Format:
    """The format of the first lines: CSV if a delimiter splits them evenly and few are structured otherwise, else the vote's winner."""
    some = lines.orderBy(order).limit(SAMPLE_LINES).select(order, raw)
    # a few rows at most: the delimiters, then the formats
    delimiters = profile.csv_delimiter(some, raw, order).collect()
    structured = parse.detect_format(F.col(raw)).isin("CEF", "LEEF", "SYSLOG_RFC5424", "JSON")
    if delimiters and (some.agg(F.avg(structured.cast("double"))).first()[0] or 0) < STRUCTURED:
        delimiter = delimiters[0]["delimiter"]
        return Format("CSV", CSV_CONFIDENCE, delimiter, header(lines, delimiter, raw, order))
    votes = profile.format_vote(some, raw, order).where("dominant").collect()
    return Format(votes[0]["format"], votes[0]["share"]) if votes else Format("UNKNOWN", 0.0)


def header(lines: DataFrame, delimiter: str, raw: str = "raw", order: str = "line") -> tuple[str, ...] | None:
    """The first row's cells if they are all plain text and the second row's, as many, are not."""
    cells = parse.csv_record(F.col(raw), delimiter)
    rows = lines.orderBy(order).limit(2).select(cells.alias("cells"), F.transform(cells, infer_type).alias("types")).collect()
    if len(rows) < 2 or len(rows[0]["cells"]) != len(rows[1]["cells"]):
        return None
    plain = all(t == "string" for t in rows[0]["types"]) and any(t != "string" for t in rows[1]["types"])
    return tuple(c.strip() for c in rows[0]["cells"]) if plain else None


def parse_as(name: str, raw: Column, delimiter: str | None = None, headers: tuple[str, ...] | None = None) -> Column:
    """Entries of a line by one format's parser; null where it fails."""
    t = parse.trim_space(raw)
    if name == "CSV":
        return parse.csv_profile(raw, list(headers) if headers else None, delimiter) if delimiter else F.lit(None).cast(parse.ENTRIES)
    return {
        "JSON": lambda: parse.json_flat(raw, parents=False),
        "CEF": lambda: parse.cef_profile(raw),
        "LEEF": lambda: parse.leef_profile(raw),
        "SYSLOG_RFC5424": lambda: F.when(t.rlike(parse.PROFILE_5424), parse.syslog_profile(raw)),
        "SYSLOG_RFC3164": lambda: F.when(t.rlike(parse.PROFILE_3164), parse.syslog_profile(raw)),
        "KEY_VALUE": lambda: parse.kv_profile(raw),
        "TEXT": lambda: parse.entries(("message", t)),
    }[name]()


def records(lines: DataFrame, found: Format, raw: str = "raw") -> DataFrame:
    """Lines with format and fields: by the source's format, else by the line's own if that isn't plain text; null fields are corrupted lines."""
    filled = lambda c: F.when(F.size(c) > 0, c)
    own = F.lit(None).cast(parse.ENTRIES)
    for name in parse.FORMATS:
        if name not in ("TEXT", found.name):
            own = F.when(F.col("_own") == name, parse_as(name, F.col(raw))).otherwise(own)
    # each parsed once for a line
    out = parse.once(lines, _hinted=parse_as(found.name, F.col(raw), found.delimiter, found.headers)).withColumn("_hinted", filled(F.col("_hinted")))
    out = parse.once(out, _own=F.when(F.col("_hinted").isNull(), parse.detect_format(F.col(raw))))
    out = parse.once(out, _fallback=own).withColumn("_fallback", filled(F.col("_fallback")))
    out = out.withColumn("fields", F.coalesce("_hinted", "_fallback"))
    return out.withColumn("format", F.when(F.col("_hinted").isNotNull(), found.name).when(F.col("_fallback").isNotNull(), F.col("_own"))).drop("_hinted", "_own", "_fallback")


def body(lines: DataFrame, found: Format, raw: str = "raw", order: str = "line") -> DataFrame:
    """The lines without a header."""
    return lines.join(lines.agg(F.min(order).alias(order)), order, "left_anti") if found.headers else lines


def summary(lines: DataFrame, parsed: DataFrame, found: Format) -> DataFrame:
    """One row: format, confidence, delimiter, lines in all, parsed and corrupted ones, and the share of failures."""
    from .drift import parse_failure_rate

    total = lines.agg(F.count("*")).scalar()
    valid = F.count_if(F.col("fields").isNotNull())
    out = parsed.agg(valid.alias("valid_records"), F.count_if(F.col("fields").isNull()).alias("corrupted_records"))
    out = out.select(F.lit(found.name).alias("format"), F.lit(found.confidence).alias("confidence"), F.lit(found.delimiter).cast("string").alias("delimiter"), F.lit(found.headers is not None).alias("has_header"), total.alias("total_records"), "valid_records", "corrupted_records")
    return out.withColumn("parse_failure_rate", parse_failure_rate(F.col("corrupted_records"), F.col("total_records")))


def message(fields: Column, raw: Column) -> Column:
    """What templates are mined from: the message, else the name, else the line."""
    return F.coalesce(F.nullif(parse.value(fields, "message"), F.lit("")), F.nullif(parse.value(fields, "name"), F.lit("")), raw)


def field_profile(parsed: DataFrame, order: str = "line") -> DataFrame:
    """Statistics of each field of the valid records, with the sorted first values of enumerations."""
    valid = parsed.where("fields is not null")
    rows = profile.long_form(valid, order)
    stats = profile.profile_fields(rows, valid.agg(F.count("*")).scalar())
    values = rows.where("type != 'null'").join(stats.where("is_enum").select("field"), "field", "left_semi").groupBy("field").agg(F.slice(F.array_sort(F.collect_set("value")), 1, profile.ENUM_MOST).alias("enum_values"))
    return stats.join(values, "field", "left")


def templates(parsed: DataFrame, raw: str = "raw", order: str = "line", most: int | None = profile.TEMPLATES) -> DataFrame:
    """The most frequent templates of the valid records, with their share."""
    valid = parse.once(parsed.where("fields is not null"), _message=message(F.col("fields"), F.col(raw)))
    mined = profile.mine_templates(valid, "_message", order, most)
    return mined.withColumn("frequency_ratio", F.round(F.col("n") / F.greatest(valid.agg(F.count("*")).scalar(), F.lit(1)), 4))
