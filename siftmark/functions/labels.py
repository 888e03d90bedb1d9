"""Label families and JSON-list columns."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a label that tell a modality; two or more modalities make a label multimodal.
MODALITY_NEEDLES = {
    "text": ("text", "question", "answering"),
    "image": ("image", "visual"),
    "audio": ("audio",),
    "video": ("video",),
}
#: Families by parts of a label, the first that fits.
FAMILY_NEEDLES = (
    ("audio", ("audio", "speech", "voice")),
    ("video", ("video",)),
    ("3d", ("3d",)),
    ("image", ("image", "visual")),
    ("tabular", ("tabular", "series", "graph")),
    ("text", ("text", "token", "translation", "summarization", "sentence", "question", "fill", "ranking", "retrieval", "classification", "choice", "answering")),
    ("image", ("depth", "mask", "keypoint", "object", "segmentation")),
)


def family(label: Column) -> Column:
    """The family of a label; `other` where nothing fits, null for null."""
    holds = lambda needles: reduce(or_, (F.contains(label, F.lit(n)) for n in needles))
    modalities = reduce(add, (holds(n).cast("int") for n in MODALITY_NEEDLES.values()))
    out = F.when(label.isNull(), F.lit(None).cast("string")).when(modalities >= 2, "multimodal")
    for name, needles in FAMILY_NEEDLES:
        out = out.when(holds(needles), name)
    return out.otherwise("other")


def json_strings(column: Column) -> Column:
    """A JSON list in a text as an array of strings: items are cast, blank ones go, anything else is an empty list."""
    parsed = F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))
    return F.filter(parsed, lambda x: x.isNotNull() & (F.btrim(x) != ""))


def json_strings_only(column: Column) -> Column:
    """As json_strings, but items that aren't strings go."""
    parsed = F.filter(F.from_json(column, "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(parsed, lambda v: F.variant_get(v, "$", "string")), F.array().cast("array<string>"))


def truthy(column: Column) -> Column:
    """A column of mixed types as a boolean: numbers but 0, and nothing else."""
    return F.coalesce(column.cast("string").try_cast("double") != 0, F.lit(False))


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))
