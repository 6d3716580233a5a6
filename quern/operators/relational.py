"""Relational operators that Spark does not have under one name, as DataFrame compositions.

Filters, projections, sorts, limits, inner and outer joins, unions and grouping are Spark's own; Catalyst chooses broadcast,
shuffled-hash or sort-merge joins by size and adaptive execution splits skewed ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import SQLError


def on_keys(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], null_safe: bool = False) -> Column:
    """Equality of key pairs; null keys match only where asked to."""
    out = F.lit(True)
    for a, b in keys:
        out = out & (left[a].eqNullSafe(right[b]) if null_safe else left[a] == right[b])
    return out


def exists(outer: DataFrame, inner: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    """Rows of ``outer`` with a partner: EXISTS as a semi join."""
    return outer.join(inner, on_keys(outer, inner, keys), "left_semi")


def not_exists(outer: DataFrame, inner: DataFrame, keys: list[tuple[str, str]]) -> DataFrame:
    return outer.join(inner, on_keys(outer, inner, keys), "left_anti")


def exists_flag(outer: DataFrame, inner: DataFrame, keys: list[tuple[str, str]], name: str) -> DataFrame:
    """``outer`` with a boolean column: EXISTS in a select list. The inner keys are made distinct first, so no row is repeated."""
    marks = inner.select(*[F.col(b).alias(f"_k{i}") for i, (_, b) in enumerate(keys)]).distinct().withColumn("_hit", F.lit(True))
    cond = F.lit(True)
    for i, (a, _) in enumerate(keys):
        cond = cond & (outer[a] == marks[f"_k{i}"])
    return outer.join(marks, cond, "left").select(*[outer[c] for c in outer.columns], F.coalesce("_hit", F.lit(False)).alias(name))


def load_by_keys(rows: DataFrame, keys: DataFrame, pk: list[str]) -> DataFrame:
    """The rows with these primary keys, once each; missing keys are skipped."""
    return rows.join(keys.select(*pk).distinct(), pk, "left_semi")


def scalar(rows: DataFrame, column: str):
    """The one value of a one-column query: null of no row, 21000 of more than one."""
    got = rows.select(column).limit(2).collect()
    if len(got) > 1:
        raise SQLError("21000")
    return got[0][0] if got else None


def default_on_empty(rows: DataFrame, default: dict) -> DataFrame:
    """The rows, or one row of defaults if there is none."""
    one = rows.sparkSession.range(1).select(*[F.lit(default.get(f.name)).cast(f.dataType).alias(f.name) for f in rows.schema])
    flagged = rows.withColumn("_there", F.lit(True))
    seen = rows.limit(1).select(F.lit(True).alias("_seen"))
    return flagged.drop("_there").unionByName(one.join(seen, F.lit(True), "left_anti"))


def first_or_default(rows: DataFrame, order: list[Column], default: dict) -> DataFrame:
    """The first row in an order, or the defaults."""
    return default_on_empty(rows.orderBy(*order).limit(1), default)


def merge_union(branches: list[DataFrame], keys: list[str], distinct: bool = False) -> DataFrame:
    """Ordered union by position; with ``distinct``, one row for each key."""
    out = branches[0]
    for b in branches[1:]:
        out = out.union(b)
    if distinct:
        out = out.dropDuplicates(keys)
    return out.orderBy(*[F.col(k).asc_nulls_first() for k in keys])


def intersection(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the first branch whose keys stand in all others."""
    out = branches[0]
    for b in branches[1:]:
        out = out.join(b.select(*keys).distinct(), keys, "left_semi")
    return out


def zip_aggregates(branches: list[DataFrame], keys: list[str]) -> DataFrame:
    """Aggregates of the same groups side by side; groups that are missing in one are left out."""
    out = branches[0]
    for b in branches[1:]:
        out = out.join(b, keys)
    return out


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    """By position, names of the first branch; 42F64 and 42F65 for branches that do not fit."""
    if len(a.columns) != len(b.columns):
        raise SQLError("42F64")
    kinds = lambda df: ["number" if t in ("int", "bigint", "float", "double") else t for _, t in df.dtypes]
    if kinds(a) != kinds(b):
        raise SQLError("42F65")
    return a.union(b)


def unnest(rows: DataFrame, array: str, element: str, ordinal: str | None = None, outer: bool = False) -> DataFrame:
    """A row for each element of an array; the ordinal is 1-based."""
    if ordinal is None:
        return rows.select("*", (F.explode_outer if outer else F.explode)(array).alias(element))
    split = (F.posexplode_outer if outer else F.posexplode)(array)
    return rows.select("*", split.alias("_at", element)).withColumn(ordinal, F.col("_at").cast("long") + 1).drop("_at")


def type_filter(rows: DataFrame, *types: str) -> DataFrame:
    """Rows of these record types in a stream of several (column ``_type``)."""
    return rows.where(F.col("_type").isin(*types))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two plans give the same bag of rows."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def strict_extreme(rows: DataFrame, column: str) -> None:
    """MIN and MAX take numbers only in strict mode."""
    kind = dict(rows.dtypes)[column]
    if kind not in NUMERIC and not kind.startswith("decimal"):
        raise SQLError("42804", f"MIN/MAX of {kind}")
