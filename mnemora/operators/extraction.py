"""Extracted memories: recovering JSON from model responses and flattening it to one table. The model itself is
an injected column-to-column function; `default_extractor` is deterministic and works offline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Arrays of a response with the fields that name, describe and weigh an item; None: the type's fixed confidence.
TYPES = (
    ("preferences", "preference", "topic", "preference", None),
    ("entities", "entity", "name", "description", 0.9),
    ("events", "event", "title", "summary", 0.8),
    ("cases", "case", "title", "problem", 0.9),
    ("personal_info", "personal_info", "category", "content", None),
    ("work_history", "work_history", "company", "description", None),
    ("relationships", "relationship", "person", "context", None),
    ("goals", "goal", "goal", "timeline", None),
)


def _schema() -> str:
    parts = []
    for name, _, key, value, _ in TYPES:
        fields = dict.fromkeys((key, value)) | {"confidence": None}
        parts.append(f"{name}: ARRAY<STRUCT<{', '.join(f'{f}: ' + ('DOUBLE' if f == 'confidence' else 'STRING') for f in fields)}>>")
    return f"STRUCT<{', '.join(parts)}>"


def json_of(response: Column) -> Column:
    """The JSON object within a response: the whole, or from the first brace to the last; null without one."""
    t = F.trim(response)
    return F.nullif(F.when(t.startswith("{"), t).otherwise(F.regexp_extract(t, r"(?s)(\{.*\})", 1)), F.lit(""))


def flattened(responses: DataFrame) -> DataFrame:
    """One row per extracted item: session, memory_type, key_name, content, confidence, ordinal.

    responses: session, response. Missing arrays, unparsable and empty responses give no rows; items without
    a key are left out.
    """
    d = responses.select("session", F.from_json(json_of(F.col("response")), _schema()).alias("d"))
    each = []
    for name, kind, key, value, fixed in TYPES:
        x = d.select("session", F.posexplode(f"d.{name}").alias("ordinal", "x"))
        sure = F.lit(fixed) if fixed is not None else F.coalesce("x.confidence", F.lit(0.5))
        each.append(x.select("session", F.lit(kind).alias("memory_type"), F.lower(F.trim(f"x.{key}")).alias("key_name"), F.col(f"x.{value}").alias("content"), sure.alias("confidence"), "ordinal"))
    out = each[0]
    for e in each[1:]:
        out = out.unionByName(e)
    return out.where("key_name <> ''")


def default_extractor(text: Column) -> Column:
    """A deterministic response: the capitalised words of a text as entities, its first sentence as their description."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(\p{Lu}\p{L}{3,})\b"), 1)))
    first = F.regexp_extract(text, r"(?s)^(.{0,200}?[.!?。！？]|.{0,200})", 1)
    return F.to_json(F.struct(F.transform(names, lambda n: F.struct(n.alias("name"), first.alias("description"))).alias("entities")))


def memory_id(prefix: Column, *key: Column) -> Column:
    """A stable id: the type's prefix and eight hexadecimal digits of the key's hash."""
    return F.concat(prefix, F.lit("_"), F.left(F.sha2(F.concat_ws("\u0001", *key), 256), F.lit(8)))


def vector_id(uri: Column, layer: Column) -> Column:
    """A stable id of a layer's vector: injective in (uri, layer)."""
    suffix = F.when(layer == "L0", "#/L0").when(layer == "L1", "#/L1").otherwise("")
    return F.left(F.sha2(F.concat(uri, suffix), 256), F.lit(32))
