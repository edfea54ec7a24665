"""Source profiles: field statistics, format votes and templates as aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parse
from ..functions.text import infer_type, mask, template_id, variables

ENUM_MOST, SAMPLES, DISTINCT_CAP, TEMPLATES = 25, 5, 500, 50


def long_form(parsed: DataFrame, line: str, entries: str = "fields") -> DataFrame:
    """(line, field, value, type) of parsed records; the last value of a field counts."""
    rows = parsed.select(F.col(line).alias("line"), F.explode(parse.last_wins(F.col(entries))).alias("e"))
    return rows.select("line", F.col("e.k").alias("field"), F.col("e.v").alias("value")).withColumn("type", infer_type(F.col("value")))


def profile_fields(rows: DataFrame, n_records) -> DataFrame:
    """Statistics of each field of long-form rows; n_records counts all parsed records (a number or a one-row query's column).

    Two aggregations over (field, type) and (field, value) feed the result, so a
    field that holds a third of all rows is combined before it is shuffled.
    """
    some = F.col("type") != "null"
    number = F.when(F.col("type").isin("integer", "float"), F.col("value").try_cast("double"))
    text = F.when(F.col("type") == "string", F.col("value"))
    by_value = rows.groupBy("field", "type", "value").agg(F.count("*").alias("n"), F.min("line").alias("first"))
    by_type = by_value.where(some).groupBy("field", "type").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    dominant = by_type.groupBy("field").agg(F.max_by("type", F.struct("n", -F.col("first"))).alias("inferred_type"))
    weighted = lambda c: F.sum(F.when(some, c * F.col("n")))
    stats = by_value.groupBy("field").agg(
        F.sum("n").alias("present"), F.sum(F.when(~some, F.col("n")).otherwise(0)).alias("nulls"), F.count_if(some).alias("distinct"),
        (weighted(F.length("value")) / weighted(F.lit(1))).alias("avg_length"), F.min(number).alias("min_number"), F.max(number).alias("max_number"), F.min(text).alias("min_text"), F.max(text).alias("max_text"),
    )
    out = stats.join(dominant, "field", "left").withColumn("inferred_type", F.coalesce("inferred_type", F.lit("null")))
    total = n_records if not isinstance(n_records, int) else F.lit(n_records)
    out = out.withColumn("non_null", F.col("present") - F.col("nulls")).withColumn("null_count", total - F.col("non_null")).withColumn("distinct_count", F.least("distinct", F.lit(DISTINCT_CAP)).cast("long"))
    enum = (F.col("non_null") >= 2) & (F.col("distinct_count") <= F.least(F.lit(ENUM_MOST), F.greatest(F.lit(2), F.floor(F.col("non_null") / 2)))) & F.col("inferred_type").isin("string", "integer", "boolean")
    return out.select(
        "field", "inferred_type", "null_count", "distinct_count", "non_null", F.round("avg_length", 2).alias("avg_length"), "min_number", "max_number", "min_text", "max_text",
        (F.col("null_count") > 0).alias("is_nullable"), F.round(F.col("non_null") / F.greatest(total, F.lit(1)), 4).alias("presence_ratio"), enum.alias("is_enum"),
        F.col("inferred_type").isin("ipv4", "ipv6").alias("is_ip"), (F.col("inferred_type") == "timestamp").alias("is_timestamp"),
    )


def samples(rows: DataFrame, n: int = SAMPLES) -> DataFrame:
    """(field, rank, value): the first n distinct values of each field in line order."""
    first = rows.where("type != 'null'").groupBy("field", "value").agg(F.min("line").alias("line"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("field").orderBy("line", "value")))
    return ranked.where(F.col("rank") <= n).select("field", "rank", "value")


def format_vote(lines: DataFrame, raw: str = "raw", order: str = "line") -> DataFrame:
    """(format, n, share) of all lines; the winner has the most lines, ties go to the first seen."""
    counts = lines.groupBy(parse.detect_format(F.col(raw)).alias("format")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    total = F.sum("n").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "first"))
    return counts.select("format", "n", F.round(F.col("n") / total, 4).alias("share"), (rank == 1).alias("dominant"))


def csv_delimiter(lines: DataFrame, raw: str = "raw", order: str = "line", sample: int = 50) -> DataFrame:
    """(delimiter, rows, columns) of those that split the first lines evenly, in order of preference."""
    some = lines.orderBy(order).limit(sample).select(raw).where(~(F.col(raw).startswith("CEF:") | F.col(raw).startswith("LEEF:") | F.col(raw).startswith("<")))
    marks = [",", "\t", "|", ";"]
    widths = some.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(d).alias("delimiter"), F.size(parse.csv_record(F.col(raw), d)).alias("width")) for i, d in enumerate(marks)))).alias("x")).select("x.*").where("width > 1")
    by_width = widths.groupBy("place", "delimiter", "width").agg(F.count("*").alias("n"))
    best = by_width.groupBy("place", "delimiter").agg(F.sum("n").alias("rows"), F.max("n").alias("most"), F.max_by("width", "n").alias("columns"))
    return best.where((F.col("rows") >= 2) & (F.col("most") >= 0.85 * F.col("rows"))).orderBy("place").select("delimiter", "rows", "columns")


def mine_templates(messages: DataFrame, text: str, order: str, most: int | None = TEMPLATES) -> DataFrame:
    """Templates with their counts, first samples and variables; the most frequent, as the report has them."""
    counts = messages.where(F.col(text) != "").groupBy(mask(F.col(text)).alias("template")).agg(F.count("*").alias("n"), F.min(order).alias("first_line"), F.min_by(text, order).alias("sample"))
    out = counts.withColumn("template_id", template_id(F.col("template"))).withColumn("n_variables", variables(F.col("template")).cast("long"))
    return out.orderBy(F.desc("n"), "first_line").limit(most) if most else out
