"""Sinks: metric records, sections that replace their like, and short reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def record(metrics: DataFrame, experiment: str, predictor: str, extra: dict[str, str] | None = None) -> DataFrame:
    """A one-row frame of metrics as (exp_id, predictor, json): keys in order, ready for a text or JSON writer."""
    columns = sorted(metrics.columns)
    more = F.create_map(*(F.lit(x) for kv in sorted((extra or {}).items()) for x in kv)) if extra else F.create_map().cast("map<string,string>")
    return metrics.select(F.lit(experiment).alias("exp_id"), F.lit(predictor).alias("predictor"), F.to_json(F.struct(more.alias("extra"), F.struct(*columns).alias("metrics"))).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def merge_section(path: str, section: str, rows: DataFrame) -> None:
    """Put rows (key, value) in place of one section of the JSON table at path, and leave the others.  Each section is a folder of
    its own, which alone is replaced: no other section is read or written, and nothing is collected.  Rows of none
    leave the section as it was."""
    new = rows.select(F.lit(section).alias("section"), F.col("key").cast("string"), F.col("value").cast("string"))
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("section").json(path)


def sections(**tables: DataFrame) -> DataFrame:
    """One row with a JSON text of several one-row tables, each under its name."""
    out = None
    for name, t in tables.items():
        one = t.select(F.struct(*t.columns).alias(name))
        out = one if out is None else out.crossJoin(one)
    return out.select(F.to_json(F.struct(*tables)).alias("json"))


def report(rows: DataFrame, percent: list[str]) -> DataFrame:
    """rows with shares shown as per cent."""
    return rows.withColumns({c: F.concat(F.format_number(F.col(c) * 100, 2), F.lit("%")) for c in percent})
