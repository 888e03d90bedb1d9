"""Sources: catalog rows, requests, dictionaries, JSON documents and cached tables, each with a schema fixed in code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.functions.labels import json_strings, truthy
from siftmark.functions.text import descriptive

#: The raw catalog, as it is stored: lists are JSON texts, flags numbers.
MODELS = T.StructType([
    T.StructField("id", T.StringType(), False), T.StructField("task_type", T.StringType()), T.StructField("pipeline_tag", T.StringType()), T.StructField("short_description", T.StringType()),
    T.StructField("payload_json", T.StringType()), T.StructField("domains", T.StringType()), T.StructField("specialties", T.StringType()), T.StructField("capability_families", T.StringType()),
    T.StructField("open_source", T.IntegerType()), T.StructField("deployable", T.IntegerType()), T.StructField("parameters", T.LongType()), T.StructField("context_window", T.LongType()),
    T.StructField("likes", T.LongType()), T.StructField("downloads", T.LongType()), T.StructField("proprietary", T.StringType()),
])
PROMPTS = "ord bigint, prompt string, expected_task_type array<string>, expected_domains array<string>, expected_specialties array<string>, model string, url string"


def clean_models(raw: DataFrame) -> DataFrame:
    """Raw rows as typed ones: lists parsed (anything else is empty), flags as booleans (null is false), missing likes 0,
    parameters and context_window null where unknown; task0 is the first label, text the descriptive text."""
    tasks = json_strings(F.col("task_type"))
    return raw.select(
        "id", F.get(tasks, 0).alias("task0"), tasks.alias("task_types"), "pipeline_tag", F.coalesce("short_description", F.lit("")).alias("short_description"),
        F.get_json_object("payload_json", "$.card_text").alias("card_text"), json_strings(F.col("domains")).alias("domains"), json_strings(F.col("specialties")).alias("specialties"),
        json_strings(F.col("capability_families")).alias("capability_families"), *(F.coalesce(F.col(c) != 0, F.lit(False)).alias(c) for c in ("open_source", "deployable")),
        "parameters", "context_window", F.coalesce("likes", F.lit(0)).alias("likes"), "downloads", truthy(F.col("proprietary")).alias("proprietary"),
    ).withColumn("text", F.coalesce(descriptive(F.col("card_text"), F.col("short_description")), F.lit("")))


def load_models(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """The catalog from Parquet; only the columns asked for are read.  Order is left to those who rank: all orders end in id."""
    rows = clean_models(spark.read.schema(MODELS).parquet(path))
    return rows.select(*fields) if fields else rows


def labels(models: DataFrame) -> DataFrame:
    return models.select(F.col("task0").alias("label")).where("label IS NOT NULL").distinct()


def lookup(models: DataFrame, task: str, domains: list[str], k: int = 5) -> DataFrame:
    """The k most popular rows of a task (any of their labels), those of a wanted domain first."""
    match = F.coalesce(F.arrays_overlap("domains", F.lit(domains)), F.lit(False)) if domains else F.lit(False)
    rows = models.where(F.array_contains("task_types", task)).withColumn("domain_match", match)
    zero = lambda c: F.desc(F.coalesce(F.col(c), F.lit(0)))
    return rows.orderBy(F.desc("domain_match"), zero("downloads"), zero("likes"), "id").limit(k)


def link(models: DataFrame, prefix: str) -> DataFrame:
    """models with url: null for proprietary rows."""
    return models.withColumn("url", F.when(~F.col("proprietary"), F.concat(F.lit(prefix), "id")))


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROMPTS).parquet(path)


def prompt_rows(spark: SparkSession, texts: list[str]) -> DataFrame:
    """Requests typed by hand as the rows of a batch; blank ones go."""
    rows = [(i, t) for i, t in enumerate(texts) if t.strip()]
    return spark.createDataFrame(rows, "ord bigint, prompt string")


def described(texts: DataFrame) -> DataFrame:
    """label, text of JSON objects {label: {label, description}} in `value`; entries that aren't objects and those whose name
    starts with an underscore go."""
    entries = texts.select(F.explode(F.from_json("value", "map<string,string>")).alias("label", "entry"))
    parsed = entries.select("label", F.from_json("entry", "struct<label:string,description:string>").alias("e")).where(~F.col("label").startswith("_"))
    return parsed.where("e.label IS NOT NULL OR e.description IS NOT NULL").select("label", F.concat_ws(" ", "e.label", "e.description").alias("text"))


def descriptions(spark: SparkSession, path: str) -> DataFrame:
    """The same of a JSON file."""
    return described(spark.read.text(path, wholetext=True))


def dictionary(spark: SparkSession, entries: dict[str, object], facet: str) -> DataFrame:
    """facet, term, ord of a configured vocabulary: keys, texts, and the keys and texts one container deeper; stripped, the
    first of equal terms stands."""
    found: list[str] = []

    def texts(value: object, deeper: bool) -> None:
        if isinstance(value, str):
            found.append(value.strip())
        elif deeper and isinstance(value, dict):
            for k, v in value.items():
                texts(k, False)
                texts(v, False)
        elif deeper and isinstance(value, (list, tuple, set, frozenset)):
            for v in value:
                texts(v, False)

    for key, value in entries.items():
        texts(key, False)
        texts(value, True)
    rows = [(facet, t, i) for i, t in enumerate(dict.fromkeys(found)) if t]
    return spark.createDataFrame(rows, "facet string, term string, ord bigint")


HOLDOUT = "task string, domain string, modality string, dataset_provided boolean, classes string"


def holdout(rows: DataFrame) -> DataFrame:
    """rows(instruction, output) with `answer`, the flat JSON object that ends the prose; null where there is none."""
    last = F.concat(F.lit("{"), F.substring_index(F.substring_index("output", "{", -1), "}", 1), F.lit("}"))
    return rows.withColumn("answer", F.when(F.contains("output", F.lit("{")), F.from_json(last, HOLDOUT)))


def vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id string, task string, vector array<float>").parquet(path)


def cached(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, built and written there first if it isn't there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # a table that can't be read isn't one that isn't there
            raise
        build().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)
