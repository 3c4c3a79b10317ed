"""Factor values that are stored with what they were made of, and used again only where all of it is the same.

The key of a stored value is its content: the factors' definitions, the settings, and the files of the input range with their sizes
and times. A stored value also holds for a shorter range that ends earlier. Values are written under a new name and then
announced by a metadata row, so a reader never meets half a write.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Mapping
from datetime import date, datetime, timezone
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from quantloom.plans import registry, scan
from quantloom.sources import tables

#: Raised whenever stored values made by earlier code must not be used.
PIPELINE = "1"


class Served(NamedTuple):
    values: DataFrame
    reused: bool
    path: str


def digest(x) -> str:
    return hashlib.sha256(json.dumps(x, sort_keys=True, default=str).encode()).hexdigest()


def input_digest(spark: SparkSession, path: str, p: scan.ScanPlan) -> str:
    """A hash of the files that the plan reads: a row per file is hashed on the executors, one row comes back."""
    files = scan.inputs(spark, path, p)
    row = files.agg(F.count("*"), F.sum(F.xxhash64("file", "size", "changed").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("size", "file", "changed"))).first()
    return digest([str(x) for x in row])


def validity(spark: SparkSession, path: str, names: Iterable[str], settings: Mapping, p: scan.ScanPlan) -> dict[str, str]:
    """The keys that must all be equal for a stored value to be used."""
    return {
        "source": digest([registry.fingerprint(n) for n in names]),
        "settings": digest(dict(settings)),
        "start": p.start.isoformat(),
        "fields": ",".join(p.fields),
        "inputs": input_digest(spark, path, p),
        "pipeline": PIPELINE,
    }


def _stored(spark: SparkSession, store: str, factor_key: str) -> dict | None:
    rows = tables.read_table(spark, tables.METADATA, f"{store}/metadata").filter(F.col("key") == factor_key)
    newest = rows.agg(F.max_by("value", "updated_at")).first()[0]
    return json.loads(newest) if newest else None


def serve(spark: SparkSession, path: str, store: str, names: Iterable[str], start: date, end: date, settings: Mapping | None = None) -> Served:
    """Values of some factors from start to end: the stored ones where source, settings, range and inputs match, else computed
    and stored. The inputs of a stored value are compared over the range that it was made for."""
    names = sorted(names)
    key = digest(names)
    held = _stored(spark, store, key)
    if held and held["keys"]["start"] == start.isoformat() and date.fromisoformat(held["end"]) >= end:
        made_for = scan.plan(names, start, date.fromisoformat(held["end"]))
        if held["keys"] == validity(spark, path, names, settings or {}, made_for):
            values = spark.read.parquet(f"{store}/{held['at']}")
            return Served(values.filter(F.col("date") <= F.lit(end)), True, held["at"])
    p = scan.plan(names, start, end)
    keys = validity(spark, path, names, settings or {}, p)
    at = f"values-{uuid.uuid4().hex}"
    scan.evaluate(spark, path, names, start, end).write.parquet(f"{store}/{at}")
    row = [(key, json.dumps({"keys": keys, "end": end.isoformat(), "at": at}), datetime.now(timezone.utc).replace(tzinfo=None))]
    spark.createDataFrame(row, tables.METADATA.schema).write.mode("append").parquet(f"{store}/metadata")
    return Served(spark.read.parquet(f"{store}/{at}"), False, at)
