"""Recursive queries: level order, cycle-safe fixpoints, and depth-first orders.

Each round joins only the newest level with the edges and writes it to the shared folder, so lineage stays short and lost executors
cost one round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import SQLError
from quern.operators.indexes import running
from quern.sources.tables import cut

#: Rounds after which a recursion is taken for endless.
MOST_LEVELS = 1000

Step = Callable[[DataFrame], DataFrame]


def level_order(seed: DataFrame, step: Step, most: int = MOST_LEVELS) -> DataFrame:
    """UNION ALL recursion: all levels, first to last. 54F01 after ``most`` rounds."""
    levels, frontier = [], cut(seed, "level")
    while not frontier.isEmpty():
        levels.append(frontier)
        if len(levels) > most:
            raise SQLError("54F01")
        frontier = cut(step(frontier), "level")
    return _union(levels, seed)


def distinct_fixpoint(seed: DataFrame, step: Step, most: int = MOST_LEVELS) -> DataFrame:
    """UNION recursion: rows that were seen before do not recur, so cycles end. Nulls count as equal."""
    frontier = cut(seed.distinct(), "level")
    levels = []
    while not frontier.isEmpty():
        levels.append(frontier)
        if len(levels) > most:
            raise SQLError("54F01")
        seen = _union(levels, seed)
        new = step(frontier).distinct()
        fresh = new.join(seen, _all_equal(new, seen), "left_anti")
        frontier = cut(fresh, "level")
    return _union(levels, seed)


def _all_equal(a: DataFrame, b: DataFrame):
    out = F.lit(True)
    for x, y in zip(a.columns, b.columns, strict=True):
        out = out & a[x].eqNullSafe(b[y])
    return out


def _union(levels: list[DataFrame], seed: DataFrame) -> DataFrame:
    out = levels[0] if levels else seed.limit(0)
    for x in levels[1:]:
        out = out.union(x)
    return out


def tree(rows: DataFrame, key: str, parent: str, order: str | None = None, most: int = MOST_LEVELS) -> DataFrame:
    """The rows reachable from the roots (null parent), with ``depth`` and ``path`` (the sort keys from the root on)."""
    by = order or key
    start = rows.where(F.col(parent).isNull()).withColumn("depth", F.lit(0)).withColumn("path", F.array(F.col(by)))

    def step(frontier: DataFrame) -> DataFrame:
        up = frontier.select(F.col(key).alias("_up"), F.col("depth").alias("_depth"), F.col("path").alias("_path"))
        down = rows.join(up, rows[parent] == up["_up"])
        return down.select(*rows.columns, (F.col("_depth") + 1).alias("depth"), F.concat("_path", F.array(F.col(by))).alias("path"))

    return level_order(start, step, most)


def pre_order(reached: DataFrame) -> DataFrame:
    """A tree's rows with ``visit``: every node before its children, siblings by their key."""
    return _visit(reached, F.col("path"))


def post_order(reached: DataFrame) -> DataFrame:
    """Every node after its children: its path, ended by something greater than any key."""
    marked = F.concat(F.transform("path", lambda x: F.struct(F.lit(0).alias("last"), x.alias("k"))), F.array(F.struct(F.lit(1).alias("last"), F.element_at("path", -1).alias("k"))))
    return _visit(reached, marked)


def _visit(reached: DataFrame, key) -> DataFrame:
    """Number rows from 1 by a sort key."""
    return running(reached.withColumn("_key", key), F.col("_key").asc(), F.lit(1).cast("long"), "visit").withColumn("visit", F.col("visit") + 1).drop("_key")
