"""K1: the report sink. Several views are committed together, or not at all.

Layout under the report folder:

* ``data/<attempt>/<view>/``: the views of one attempt, never overwritten
* ``manifest/audit_date=<date>/``: one JSON line for each view of a committed attempt

An attempt writes its views first and its manifest last. Readers follow the manifest of the latest committed attempt of a date,
so that an attempt that failed half-way leaves the report before it whole, and two writers don't mix.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "audit_date date, attempt string, committed_at bigint, view string, folder string, format string, rows bigint, columns string"


def write_report(views: dict[str, DataFrame], path: str, audit_date: str, fmt: str = "parquet") -> str:
    """Write every view and commit them as the report of ``audit_date``; returns the attempt's name."""
    spark = next(iter(views.values())).sparkSession
    attempt = uuid.uuid4().hex
    rows = []
    for name, df in views.items():
        folder = f"data/{attempt}/{name}"
        df.write.format(fmt).save(f"{path}/{folder}")
        n = spark.read.format(fmt).schema(df.schema).load(f"{path}/{folder}").count()
        rows.append((attempt, time.time_ns(), name, folder, fmt, n, df.schema.json()))
    committed = max(r[1] for r in rows)
    lines = spark.createDataFrame([(a, committed, *rest) for a, _, *rest in rows],
                                  "attempt string, committed_at bigint, view string, folder string, format string, rows bigint, columns string")
    lines.coalesce(1).write.mode("append").json(f"{path}/manifest/audit_date={audit_date}")
    return attempt


def report_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The views of the latest committed attempt of each date."""
    lines = spark.read.schema(MANIFEST).json(f"{path}/manifest")
    last = lines.groupBy("audit_date").agg(F.max_by("attempt", F.struct("committed_at", "attempt")).alias("attempt"))
    return lines.join(last, ["audit_date", "attempt"])


def read_report(spark: SparkSession, path: str, audit_date: str) -> dict[str, DataFrame]:
    """The committed views of a date by name; none if nothing was committed."""
    entries = report_manifest(spark, path).filter(F.col("audit_date") == F.lit(audit_date).cast("date")).collect()   # one row a view
    return {e["view"]: spark.read.format(e["format"]).schema(StructType.fromJson(json.loads(e["columns"])))
            .load(f"{path}/{e['folder']}") for e in entries}
