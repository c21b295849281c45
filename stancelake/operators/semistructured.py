"""Deeply nested records of varying shape -> related flat tables.

The payload is text.  One Arrow-batched pass per partition finds the outermost
JSON value, checks it strictly and brings every array level into one canonical
shape (a list of objects); an aggregate over all records infers the merged
schema; from there everything is JVM-side ``from_json`` and ``posexplode``, one
child table per array level, each row carrying its parent's surrogate key and
its ordinal.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..session import materialize


@dataclass(frozen=True)
class Level:
    """An array level: its field, and the field that a bare (non-object) member fills."""

    name: str
    bare: str


@dataclass(frozen=True)
class NestedSpec:
    """Shape of the records: fields that mark the root, wrappers around it, array levels from the outside in."""

    levels: tuple[Level, ...]
    root_fields: frozenset[str] = field(default_factory=frozenset)
    wrappers: tuple[str, ...] = ("report", "result", "data", "response", "output")


REPORT_SPEC = NestedSpec(
    levels=(Level("positions", "stakeholder"), Level("targets", "target")),
    root_fields=frozenset({"positions", "political_issue", "is_about_event", "title", "summary", "author", "body", "timestamp", "id"}),
)


def _refuse(word: str) -> None:
    raise ValueError(f"{word} is not JSON")


def _object(pairs: list[tuple[str, object]]) -> dict:
    """Field names are told apart without case; of names given twice the first value that is not empty holds."""
    out: dict = {}
    for k, v in pairs:
        k = k.lower()
        if k not in out or _empty(out[k]):
            out[k] = v
    return out


_BLANKS = re.compile(r"[ \t\r\n]*")
_DECODER = json.JSONDecoder(parse_constant=_refuse, object_pairs_hook=_object)


def outermost_json(text: str | None) -> object:
    """The outermost JSON object or array of ``text``; raises ValueError if it is incomplete or not strict.

    Text before the first bracket and after the matching one is ignored.  A bracketed
    word in the text before (``[draft]``) opens no JSON value and is passed over.
    """
    if not text:
        raise ValueError("empty")
    at = 0
    while True:
        starts = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not starts:
            raise ValueError("no JSON value")
        at = min(starts)
        first = text[_BLANKS.match(text, at + 1).end() :][:1]
        opens = text[at] == "{" and (not first or first in '"}') or text[at] == "[" and (not first or first in '{["]')
        try:
            return _DECODER.raw_decode(text, at)[0]
        except (ValueError, RecursionError):
            if opens or text[at] == "{":
                raise ValueError("broken JSON") from None
            at += 1


def _empty(x: object) -> bool:
    return x is None or x == {} or x == [] or isinstance(x, str) and not x.strip()


def _text_value(x: object) -> object:
    """A string that itself holds a JSON object or array is that value."""
    if isinstance(x, str) and x.lstrip()[:1] in ("[", "{"):
        try:
            return _DECODER.decode(x)
        except (ValueError, RecursionError):
            return x
    return x


def members(x: object, names: frozenset[str] | set[str]) -> Iterator[object]:
    """Members of an array level whatever shape it is given in, in the order of the text.

    A list is walked, lists inside it too; an object whose values are all members (an index
    map such as ``{"0": {...}}``) is walked by value; any other object, and a bare value, is
    one member.  Null and empty members are passed over.
    """
    x = _text_value(x)
    if _empty(x):
        return
    if isinstance(x, list):
        for y in x:
            yield from members(y, names)
    elif isinstance(x, dict) and not (names & x.keys()) and all(_index(k) for k in x):
        for k in sorted(x, key=lambda k: int(k.strip())):
            yield from members(x[k], names)
    else:
        yield x


def _index(k: str) -> bool:
    return k.strip().isdecimal()


def canonical(value: object, spec: NestedSpec) -> dict | None:
    """The record in canonical shape, or None if ``value`` holds no record."""
    value = _text_value(value)
    if isinstance(value, list):
        parts = [canonical(v, spec) for v in value if not _empty(v)]
        parts = [p for p in parts if p is not None]
        if not parts:
            inner = spec.levels[1].name if len(spec.levels) > 1 else ""
            if value and all(isinstance(v, dict) and (inner in v or spec.levels[0].bare in v) for v in value):
                return canonical({spec.levels[0].name: value}, spec)
            return None
        out = dict(parts[0])
        for p in parts[1:]:
            out[spec.levels[0].name] = out[spec.levels[0].name] + p[spec.levels[0].name]
        return out
    if not isinstance(value, dict):
        return None
    if spec.root_fields & value.keys():
        return _canonical_level(value, spec, 0)
    for w in spec.wrappers:
        if w in value:
            found = canonical(value[w], spec)
            if found is not None:
                return found
    return None


def _canonical_level(record: dict, spec: NestedSpec, depth: int) -> dict:
    if depth == len(spec.levels):
        return record
    level = spec.levels[depth]
    inner = {level.bare} | {lv.name for lv in spec.levels[depth + 1 :]}
    out = {k: v for k, v in record.items() if k != level.name}
    rows = []
    for m in members(record.get(level.name), inner):
        if not isinstance(m, dict):
            m = {level.bare: m if isinstance(m, str) else json.dumps(m)}
        rows.append(_canonical_level(m, spec, depth + 1))
    out[level.name] = rows
    return out


def canonical_records(df: DataFrame, key: str, payload: str, spec: NestedSpec = REPORT_SPEC) -> DataFrame:
    """``(key, canon)``: the canonical JSON text of each payload, null where there is no complete strict record.

    Null, empty and very long payloads are ordinary input; repeated keys stay repeated.
    """
    kt = df.schema[key].dataType

    def run(batches: Iterable) -> Iterator:
        import pandas as pd

        for pdf in batches:
            out = []
            for text in pdf["payload"]:
                try:
                    rec = canonical(outermost_json(text), spec)
                except ValueError:
                    rec = None
                out.append(None if rec is None else json.dumps(rec, ensure_ascii=False))
            yield pd.DataFrame({"key": pdf["key"], "canon": pd.Series(out, dtype=object, index=pdf.index)})

    schema = T.StructType([T.StructField("key", kt), T.StructField("canon", T.StringType())])
    return df.select(F.col(key).alias("key"), F.col(payload).alias("payload")).mapInPandas(run, schema)


def merged_schema(records: DataFrame, canon: str = "canon", spec: NestedSpec = REPORT_SPEC) -> T.StructType:
    """The merged schema of all records: the union of their fields at every depth.

    One aggregate over the whole table; fields whose type varies become strings.  The array
    levels of ``spec`` are always present, also for an empty table.
    """
    found = records.select(F.schema_of_variant_agg(F.try_parse_json(canon)).alias("s")).first()["s"]
    st = _variant_type(found or "VOID")
    return _with_levels(st if isinstance(st, T.StructType) else T.StructType(), spec.levels)


def _with_levels(st: T.StructType, levels: tuple[Level, ...]) -> T.StructType:
    if not levels:
        return st
    have = {f.name: f.dataType for f in st.fields}
    el = have.get(levels[0].name)
    el = el.elementType if isinstance(el, T.ArrayType) and isinstance(el.elementType, T.StructType) else T.StructType()
    if levels[0].bare not in el.fieldNames():
        el = T.StructType([*el.fields, T.StructField(levels[0].bare, T.StringType())])
    have[levels[0].name] = T.ArrayType(_with_levels(el, levels[1:]))
    return T.StructType([T.StructField(k, v) for k, v in have.items()])


def _variant_type(s: str) -> T.DataType:
    """Spark's text form of a variant's schema -> DataType (objects to structs; void and mixed to string)."""
    pos = 0

    def typ() -> T.DataType:
        nonlocal pos
        if s.startswith("OBJECT<", pos):
            pos += 7
            fields = []
            while s[pos] != ">":
                fields.append(T.StructField(name(), typ()))
                if s.startswith(", ", pos):
                    pos += 2
            pos += 1
            return T.StructType(fields)
        if s.startswith("ARRAY<", pos):
            pos += 6
            el = typ()
            pos += 1
            return T.ArrayType(el)
        end = pos
        depth = 0
        while end < len(s) and (depth or s[end] not in ",>"):
            depth += (s[end] == "(") - (s[end] == ")")
            end += 1
        word, pos = s[pos:end], end
        if word == "BIGINT":
            return T.LongType()
        if word == "BOOLEAN":
            return T.BooleanType()
        if word == "DOUBLE" or word.startswith("DECIMAL"):
            return T.DoubleType()
        return T.StringType()

    def name() -> str:
        nonlocal pos
        if s[pos] == "`":
            end = pos + 1
            while s[end] != "`" or s.startswith("``", end):
                end += 2 if s.startswith("``", end) else 1
            word, pos = s[pos + 1 : end].replace("``", "`"), end + 3
            return word
        end = s.index(": ", pos)
        word, pos = s[pos:end], end + 2
        return word

    return typ()


def flatten_records(df: DataFrame, key: str, payload: str, spec: NestedSpec = REPORT_SPEC,
                    records: DataFrame | None = None, schema: T.StructType | None = None) -> dict[str, DataFrame]:
    """One flat table per level: ``{"root": ..., level.name: ..., ...}``.

    Every table carries ``root_key``; a table of level i carries the ordinals ``<level>_no`` of
    levels 1..i (from 0), its own surrogate key ``<level>_key`` and ``parent_key``.  Structs are
    flattened to ``a_b`` columns.  The root table has one row per payload with ``is_record``
    false where there is no complete record.  Records without members have no child rows.  The payloads
    are parsed once: their canonical form is written to the shared folder and read for schema and tables.
    """
    recs = materialize(canonical_records(df, key, payload, spec), "records") if records is None else records
    schema = merged_schema(recs, spec=spec) if schema is None else schema
    base = recs.select(F.col("key").alias("root_key"), F.col("canon").isNotNull().alias("is_record"), F.from_json("canon", schema).alias("r"))
    out = {"root": base.select("root_key", "is_record", *_flat("r", schema, skip={spec.levels[0].name}))}
    cur, st, keys, parent = base.where("is_record"), schema, [F.col("root_key")], F.col("root_key").cast("string")
    ords: list[str] = []
    for i, lv in enumerate(spec.levels):
        el = st[lv.name].dataType.elementType
        src = "r" if i == 0 else "m"
        cur = cur.select("root_key", *ords, parent.alias("parent_key"), F.posexplode(F.col(src)[lv.name]).alias(f"{lv.name}_no", "m2"))
        cur = cur.withColumnRenamed("m2", "m")
        ords = [*ords, f"{lv.name}_no"]
        own = F.concat_ws("/", F.col("root_key").cast("string"), *ords)
        skip = {spec.levels[i + 1].name} if i + 1 < len(spec.levels) else set()
        out[lv.name] = cur.select(own.alias(f"{lv.name}_key"), "parent_key", "root_key", *ords, *_flat("m", el, skip))
        st, parent = el, own
    return out


def _flat(prefix: str, st: T.StructType, skip: set[str]) -> list[Column]:
    cols: list[Column] = []
    used: dict[str, int] = {"root_key": 1, "parent_key": 1, "is_record": 1}

    def add(c: Column, name: str) -> None:
        low = name.lower()
        n = used.get(low, 0)
        used[low] = n + 1
        cols.append(c.alias(name if not n else f"{name}_{n + 1}"))

    for f in st.fields:
        if f.name in skip:
            continue
        c = F.col(prefix)[f.name]
        if isinstance(f.dataType, T.StructType):
            for g in f.dataType.fields:
                add(c[g.name] if not isinstance(g.dataType, (T.StructType, T.ArrayType)) else F.to_json(c[g.name]), f"{f.name}_{g.name}")
        elif isinstance(f.dataType, T.ArrayType):
            add(F.to_json(c), f.name)
        else:
            add(c, f.name)
    return cols


def member_ordinals(df: DataFrame, key: str, payload: str, spec: NestedSpec = REPORT_SPEC) -> DataFrame:
    """``(root_key, <level>_no ...)`` from the flat tables: one row per innermost member, -1 where a level has none, -2 where there is no record.

    Payloads under one key count as one; each of their rows is given once.
    """
    tables = flatten_records(df, key, payload, spec)
    cur = tables["root"].select("root_key", F.col("is_record").alias("ok"), F.col("root_key").cast("string").alias("own")).distinct()
    ords: list[str] = []
    for lv in spec.levels:
        n = f"{lv.name}_no"
        child = tables[lv.name].select(F.col("parent_key").alias("own"), F.col(f"{lv.name}_key").alias("below"), n).distinct()
        cur = cur.join(child, "own", "left").select("root_key", "ok", *ords, n, F.col("below").alias("own"))
        ords.append(n)
    return cur.select("root_key", *[F.when(~F.col("ok"), -2).otherwise(F.coalesce(F.col(n), F.lit(-1))).cast("int").alias(n) for n in ords])
