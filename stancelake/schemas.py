"""Schemas of the records the engine reads and writes, and checks of their closed vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

_S, _L = T.StringType(), T.LongType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _strings(*names: str) -> T.StructType:
    return _struct(**{n: _S for n in names})


TARGET = _strings("predicate", "target", "stance_type")
SUPPORT = _strings("type", "content")
COUNTRY = _strings("name", "code")
POSITION = T.StructType([*_strings("stakeholder", "position", "stance", "sentiment", "emotion", "context").fields, *_struct(support=SUPPORT, targets=T.ArrayType(TARGET), country=COUNTRY).fields])
ARTICLE = _strings("id", "title", "author", "source", "summary", "body", "@timestamp")
REPORT = T.StructType([
    *_strings("id", "title", "author", "summary", "body", "timestamp", "political_issue").fields,
    *_struct(is_about_event=T.BooleanType(), positions=T.ArrayType(POSITION)).fields])
ANCHOR = _struct(normalized_anchor_text=_S, target_item_id=_L, target_page_id=_L, target_page_views=_L)
KB_ITEM = _struct(item_id=_L, main_label=_S, labels=T.ArrayType(_S), description=_S, aliases=T.ArrayType(_S), en_aliases=T.ArrayType(_S))
GOLD = T.ArrayType(T.ArrayType(_S))
_ARGUMENTS = _struct(title=_S, items=T.ArrayType(_S))
SUMMARY = _struct(
    title=_S, key_points=T.ArrayType(_strings("point", "explanation")), important_stakeholders_per_country=T.MapType(_S, T.ArrayType(_strings("name", "explanation"))),
    arguments_for=_ARGUMENTS, arguments_against=_ARGUMENTS, time_analysis=_S, timeline=T.ArrayType(_strings("date", "person", "event")))
EVENT = _strings("key", "name", "description", "topic", "search_period")

# The closed vocabularies of the report schema.
VOCABULARY = {
    "stance": ("Pro", "Con", "Neutral"),
    "sentiment": ("Positive", "Negative", "Neutral"),
    "context": ("Geographic", "Social", "Political", "Economic", "Not provided"),
}
EMOTIONS = ("Anger", "Fear", "Joy", "Sadness", "Disgust", "Surprise")  # asked for, not enforced
STANCE_TYPES = ("Positive", "Negative", "Neutral")


def from_json_schema(schema: dict) -> T.DataType:
    """The Spark type of a JSON Schema: objects, arrays and simple types, also where ``type`` allows null; ``$ref`` points into ``$defs``."""
    root = schema

    def typ(s: dict) -> T.DataType:
        while "$ref" in s:
            node = root
            for part in s["$ref"].lstrip("#/").split("/"):
                node = node[part]
            s = node
        kind = s.get("type") or next((x.get("type") for x in s.get("anyOf", ()) if x.get("type") != "null"), "string")
        if isinstance(kind, list):
            kind = next((k for k in kind if k != "null"), "string")
        if kind == "object":
            if "properties" not in s and isinstance(s.get("additionalProperties"), dict):
                return T.MapType(_S, typ(s["additionalProperties"]))
            return T.StructType([T.StructField(k, typ(v)) for k, v in s.get("properties", {}).items()])
        if kind == "array":
            return T.ArrayType(typ(s.get("items", {})))
        return {"integer": _L, "number": T.DoubleType(), "boolean": T.BooleanType()}.get(kind, _S)

    return typ(schema)


def read_json_schema(path: str) -> T.DataType:
    """The Spark type of a JSON Schema file, bare or wrapped as ``{"schema": ...}``."""
    import json
    from pathlib import Path

    s = json.loads(Path(path).read_text())
    return from_json_schema(s.get("schema", s) if isinstance(s.get("schema", s), dict) else s)


def conforms(col: str, schema: dict) -> Column:
    """Whether a struct column fits an object of a JSON Schema: required fields set, closed vocabularies kept; null structs do not fit."""
    ok = F.col(col).isNotNull()
    for name in schema.get("required", ()):
        ok = ok & F.col(col)[name].isNotNull()
    for name, s in schema.get("properties", {}).items():
        if "enum" in s:
            ok = ok & (F.col(col)[name].isNull() | F.col(col)[name].isin(*[v for v in s["enum"] if v is not None]))
        if s.get("type") == "object":
            ok = ok & (F.col(col)[name].isNull() | conforms(f"{col}.{name}", s))
    return F.coalesce(ok, F.lit(False))


def vocabulary_violations(positions: DataFrame, vocabulary: dict[str, tuple[str, ...]] = VOCABULARY) -> DataFrame:
    """``(field, value, n)``: values outside the closed vocabularies; null values are no violation."""
    parts = [F.struct(F.lit(f).alias("field"), F.col(f).alias("value"), (F.col(f).isNotNull() & ~F.col(f).isin(*vs)).alias("bad")) for f, vs in vocabulary.items()]
    rows = positions.select(F.explode(F.array(*parts)).alias("x")).where("x.bad")
    return rows.groupBy(F.col("x.field").alias("field"), F.col("x.value").alias("value")).agg(F.count("*").alias("n"))


def with_missing(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` in its order; absent ones are null, extra ones follow."""
    have = set(df.columns)
    cols = [F.col(f"`{f.name}`") if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*cols, *[F.col(f"`{c}`") for c in df.columns if c not in set(schema.fieldNames())])
