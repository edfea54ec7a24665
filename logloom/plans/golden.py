"""Golden fixtures: a folder with a raw event, what is expected of it, and its specification."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parse
from ..operators import shadow
from . import spec as sp

#: Files of a fixture.
PARTS = {"metadata": "metadata.json", "raw": "raw/events.raw", "expected": "expected/events.json", "spec": "parser/parser_spec.json"}


def load(folder: str) -> dict:
    """A fixture's parts; raises if one is missing."""
    missing = [f for f in PARTS.values() if not (Path(folder) / f).exists()]
    if missing:
        raise FileNotFoundError(f"{folder} lacks {', '.join(missing)}")
    text = {k: (Path(folder) / f).read_text(encoding="utf-8") for k, f in PARTS.items()}
    return {"raw": text["raw"].strip(), "spec": sp.load(text["spec"])} | {k: json.loads(text[k]) for k in ("metadata", "expected")}


def validate(spark: SparkSession, fixture: dict) -> DataFrame:
    """One row: accuracies of the specification on the fixture's event, retention of its unknown fields, and passed."""
    expected = fixture["expected"]
    want = spark.createDataFrame([(0, p, str(v)) for p, v in expected.get("extracted", {}).items()], "event int, path string, value string")
    event = sp.apply(spark.createDataFrame([(0, fixture["raw"])], "event int, raw string"), fixture["spec"])
    paths = sorted({f["map_to"] for f in fixture["spec"]["fields"].values()})
    rows = event.select("event", F.explode(F.array(*(F.struct(F.lit(p).alias("path"), F.col(sp.column(p)).cast("string").alias("value")) for p in paths))).alias("x")).select("event", "x.*").where("value is not null")
    unknown = expected.get("unknown_fields", {})
    kept = F.size(F.filter(F.array(*(F.lit(k) for k in unknown)).cast("array<string>"), lambda k: F.exists("unknown", lambda e: e["k"] == k))) if unknown else F.lit(0)
    out = shadow.validation(want, rows, "event").withColumn("_one", F.lit(1)).join(event.select(F.lit(1).alias("_one"), (kept / F.lit(max(len(unknown), 1)) if unknown else F.lit(1.0)).alias("unknown_retention")), "_one").drop("_one")
    least = fixture["metadata"].get("min_extraction_accuracy", 0.95)
    return out.withColumn("passed", (F.col("extraction_accuracy") >= least) & (F.col("semantic_accuracy") >= least) & (F.col("unknown_retention") >= 1))


def entries_of(spark: SparkSession, fixture: dict) -> DataFrame:
    """The fixture's event as parsed entries."""
    return spark.createDataFrame([(fixture["raw"],)], "raw string").select(F.explode(parse.last_wins(sp.raw_fields(fixture["spec"], F.col("raw")))).alias("e")).select("e.k", "e.v")
