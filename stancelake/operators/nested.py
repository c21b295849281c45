"""Positions and targets: explode with ordinals, flatten, filter, regroup."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def explode_positions(reports: DataFrame, keys: list[str], outer: bool = False) -> DataFrame:
    """One row per position with its ordinal ``pos_no`` and flattened fields (``support_type``, ``country_code`` ...).

    Reports without positions vanish unless ``outer``.
    """
    ex = F.posexplode_outer if outer else F.posexplode
    p = reports.select(*keys, ex("positions").alias("pos_no", "p"))
    return flatten_struct(p, "p")


def flatten_struct(df: DataFrame, col: str, sep: str = "_") -> DataFrame:
    """The fields of a struct column as columns, inner structs as ``outer_inner``; arrays stay whole.

    A field whose name is taken already gets a number.
    """
    cols = [F.col(f"`{c}`") for c in df.columns if c != col]
    used = {c.lower() for c in df.columns if c != col}

    def name(n: str) -> str:
        out, i = n, 2
        while out.lower() in used:
            out, i = f"{n}{sep}{i}", i + 1
        used.add(out.lower())
        return out

    def walk(c, st: T.StructType, prefix: str) -> None:
        for f in st.fields:
            if isinstance(f.dataType, T.StructType):
                walk(c[f.name], f.dataType, f"{prefix}{f.name}{sep}")
            else:
                cols.append(c[f.name].alias(name(prefix + f.name)))

    walk(F.col(col), df.schema[col].dataType, "")
    return df.select(*cols)


def with_members(df: DataFrame, array_col: str) -> DataFrame:
    """Rows whose array has members; null arrays have none."""
    return df.where(F.size(F.coalesce(array_col, F.array().cast(df.schema[array_col].dataType))) > 0)


def explode_targets(positions: DataFrame, keys: list[str]) -> DataFrame:
    return flatten_struct(positions.select(*keys, F.posexplode("targets").alias("target_no", "t")), "t")


def regroup(df: DataFrame, keys: list[str], order: str, fields: list[str], name: str = "targets") -> DataFrame:
    """Rows back into one list of records per key, in the order of ``order`` (the inverse of exploding)."""
    rows = F.sort_array(F.collect_list(F.struct(order, *fields)))
    return df.groupBy(*keys).agg(F.transform(rows, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))


def relevant(df: DataFrame) -> DataFrame:
    """Rows about politics if such a flag exists, else about the event, else all; null flags are dropped."""
    for flag in ("is_about_politics", "is_about_event"):
        if flag in df.columns:
            return df.where(F.col(flag))
    return df
