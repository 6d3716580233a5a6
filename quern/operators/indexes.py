"""Index-defined computations as derived tables: each is a function from rows to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import SQLError
from quern.sources.tables import cut


def value_index(rows: DataFrame, keys: list[str], pk: list[str], where: Column | None = None, fan_out: str | None = None) -> DataFrame:
    """(keys, primary key); filtered by a predicate, one entry for each element of ``fan_out``."""
    if where is not None:
        rows = rows.where(where)
    if fan_out:
        rows = rows.withColumn(fan_out, F.explode(fan_out))
    return rows.select(*keys, *[c for c in pk if c not in keys])


def check_unique(rows: DataFrame, keys: list[str]) -> None:
    """23505 if a key without nulls occurs twice."""
    full = rows.dropna(subset=keys)
    if not full.groupBy(*keys).count().where("count > 1").isEmpty():
        raise SQLError("23505", ", ".join(keys))


def counts(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def counts_not_null(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(column).alias("n"))


def sums(rows: DataFrame, by: list[str], column: str, clear_when_zero: bool = False) -> DataFrame:
    out = rows.groupBy(*by).agg(F.sum(column).alias("total"))
    return out.where("total <> 0") if clear_when_zero else out


def count_updates(log: DataFrame, by: list[str]) -> DataFrame:
    """Saves ever made in each group, of a change log (column ``op``: insert, update, delete)."""
    return log.where(F.col("op") != "delete").groupBy(*by).agg(F.count(F.lit(1)).alias("n_updates"))


def ever(log: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Extremes ever saved, which later deletes do not take back; of one column or of a tuple."""
    value = F.col(columns[0]) if len(columns) == 1 else F.struct(*columns)
    return log.where(F.col("op") != "delete").groupBy(*by).agg(F.min(value).alias("min_ever"), F.max(value).alias("max_ever"))


def max_ever_version(log: DataFrame, by: list[str], version: str) -> DataFrame:
    return log.groupBy(*by).agg(F.max(version).alias("max_version"))


def version_feed(log: DataFrame, version: str, after, limit: int | None = None) -> DataFrame:
    """Changes after a version, oldest first."""
    out = log.where(F.col(version) > F.lit(after)).orderBy(version)
    return out if limit is None else out.limit(limit)


def permuted(rows: DataFrame, prefix: list[str], suffix: list[str], value: str, largest: bool) -> DataFrame:
    """The extreme of each (prefix, suffix) group, in the order of (prefix, value, suffix)."""
    best = F.max(value) if largest else F.min(value)
    return rows.groupBy(*prefix, *suffix).agg(best.alias(value)).orderBy(*prefix, value, *suffix)


def running(rows: DataFrame, order: Column, amount: Column, name: str) -> DataFrame:
    """The sum of ``amount`` over all rows before each one, without gathering them in one task.

    A range sort, a window inside each range, and the ranges' own sums (one number each) added up on the driver.
    """
    ranged = cut(rows.withColumn("_amount", amount).orderBy(order).withColumn("_part", F.spark_partition_id()), "running")
    sums = sorted((r["_part"], r["s"]) for r in ranged.groupBy("_part").agg(F.sum("_amount").alias("s")).collect())
    before, total = [], 0
    for part, s in sums:
        before.append((part, total))
        total += s
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    inside = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(offsets, "_part").withColumn(name, F.coalesce(F.sum("_amount").over(inside), F.lit(0)) + F.col("_before")).drop("_part", "_amount", "_before")


def ranks(rows: DataFrame, by: list[str], score: str, count_duplicates: bool = False, high_first: bool = False) -> DataFrame:
    """``rank`` from 0 of each row's score in its group; ties share it, and push later ones down only with ``count_duplicates``.

    Scores are first made distinct with their counts, so the window sorts one row for each score of a group. Without groups the scores are
    sorted by range, and each range starts where the ones before it end (``running``).
    """
    order = F.col(score).desc() if high_first else F.col(score).asc()
    per = rows.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    if not by:
        table = running(per, order, F.col("_n") if count_duplicates else F.lit(1).cast("long"), "rank").drop("_n")
        right = table.select(F.col(score).alias(f"_{score}"), "rank")
        return rows.join(right, rows[score].eqNullSafe(right[f"_{score}"])).drop(f"_{score}")
    window = Window.partitionBy(*by).orderBy(order)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("_n").over(before), F.lit(0)) if count_duplicates else F.row_number().over(window).cast("long") - 1
    table = per.withColumn("rank", rank).drop("_n")
    cond = F.lit(True)
    right = table.select(*[F.col(c).alias(f"_{c}") for c in [*by, score]], "rank")
    for c in [*by, score]:
        cond = cond & rows[c].eqNullSafe(right[f"_{c}"])
    return rows.join(right, cond).drop(*[f"_{c}" for c in [*by, score]])


def score_for_rank(rows: DataFrame, by: list[str], score: str, rank: int, high_first: bool = False) -> DataFrame:
    """The score at a rank (ties share ranks) in each group; groups with fewer scores are left out."""
    order = F.col(score).desc() if high_first else F.col(score).asc()
    per = rows.select(*by, score).distinct()
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order)).cast("long") - 1).where(F.col("rank") == rank)


def rank_for_score(rows: DataFrame, by: list[str], score: str, value) -> DataFrame:
    """The rank that a score has, or would have, in each group."""
    return rows.select(*by, score).distinct().groupBy(*by).agg(F.count(F.when(F.col(score) < F.lit(value), 1)).alias("rank"))


#: Days of windows that travel to the rows; more of them meet the rows in a shuffle.
BROADCAST_WINDOW_DAYS = 100_000


def counts_distinct(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Distinct values of a column in each group: first one row for each value, so that a hot group is counted in parts."""
    return rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.lit(1).alias("_one")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def score_for_rank_else_skip(rows: DataFrame, by: list[str], score: str, rank: int, high_first: bool = False) -> DataFrame:
    """Every group with the score at a rank; null where the group has fewer scores."""
    found = score_for_rank(rows, by, score, rank, high_first).select(*by, score)
    groups = rows.select(*by).distinct()
    cond = F.lit(True)
    right = found.select(*[F.col(c).alias(f"_{c}") for c in by], F.col(score))
    for c in by:
        cond = cond & groups[c].eqNullSafe(right[f"_{c}"])
    return groups.join(right, cond, "left").drop(*[f"_{c}" for c in by])


def leaderboard(rows: DataFrame, key: str, score: str, ts: str, windows: DataFrame | None, high_first: bool = True) -> DataFrame:
    """Best score of each key in each window [start, end) (column ``name``), ranked from 0; one all-time window if none is given.

    Windows may overlap and may be many: rows meet only the windows of their own day, by an equi-join on days.
    """
    if windows is None:
        inside = rows.withColumn("name", F.lit("all time"))
    else:
        days = F.explode(F.sequence(F.to_date("start"), F.to_date("end")))
        w = windows.where("start < end").select("name", F.col("start").alias("_start"), F.col("end").alias("_end"), days.alias("_day"))
        if w.limit(BROADCAST_WINDOW_DAYS + 1).count() <= BROADCAST_WINDOW_DAYS:  # no shuffle, so no hot day
            w = F.broadcast(w)
        inside = rows.withColumn("_day", F.to_date(F.col(ts))).join(w, "_day").where((F.col(ts) >= F.col("_start")) & (F.col(ts) < F.col("_end")))
    best = inside.groupBy("name", key).agg((F.max if high_first else F.min)(score).alias("best"))
    return ranks(best, ["name"], "best", count_duplicates=True, high_first=high_first)


def sliding_windows(rows: DataFrame, ts: str, size: str, slide: str) -> DataFrame:
    """Rows with each overlapping half-open window that they fall in (``start``, ``end``)."""
    return rows.withColumn("_w", F.window(F.col(ts), size, slide)).withColumns({"start": F.col("_w.start"), "end": F.col("_w.end")}).drop("_w")


#: Positions of one bitmap.
BITMAP_BITS = 10_000


def bitmaps(rows: DataFrame, by: list[str], position: str, bits: int = BITMAP_BITS) -> DataFrame:
    """by, offset (start of the aligned bucket), bitmap, n_bits: one bit for each position that occurs."""
    at = F.col(position).cast("long")
    offset = at - F.pmod(at, F.lit(bits))
    bit = F.pmod(at, F.lit(bits))
    return rows.where(at.isNotNull()).groupBy(*by, offset.alias("offset")).agg(F.bitmap_construct_agg(bit).alias("bitmap")).withColumn("n_bits", F.bitmap_count("bitmap"))


def bitmap_or(maps: DataFrame, by: list[str]) -> DataFrame:
    """Bitmaps of several groups united."""
    return maps.groupBy(*by, "offset").agg(F.bitmap_or_agg("bitmap").alias("bitmap")).withColumn("n_bits", F.bitmap_count("bitmap"))


def z_key(columns: list[str], low: list[float], high: list[float], bits: int = 16) -> Column:
    """Interleaved bits of the scaled columns: near points have near keys."""
    cells = [F.least(F.greatest(((F.col(c) - a) / (b - a) * ((1 << bits) - 1)).cast("long"), F.lit(0)), F.lit((1 << bits) - 1)) for c, a, b in zip(columns, low, high, strict=True)]
    out = F.lit(0).cast("long")
    for bit in range(bits):
        for k, c in enumerate(cells):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c, bit).bitwiseAND(F.lit(1).cast("long")), bit * len(cells) + k))
    return out


def box(rows: DataFrame, bounds: dict[str, tuple]) -> DataFrame:
    """Rows inside an n-dimensional box; a bound of None is open, nulls are outside any bounded dimension."""
    for c, (low, high) in bounds.items():
        if low is not None:
            rows = rows.where(F.col(c) >= F.lit(low))
        if high is not None:
            rows = rows.where(F.col(c) <= F.lit(high))
    return rows


def spatial_layout(rows: DataFrame, columns: list[str], low: list[float], high: list[float], partitions: int) -> DataFrame:
    """Rows dealt out by ranges of their interleaved key, so that a box touches few files and row groups."""
    return rows.repartitionByRange(partitions, z_key(columns, low, high)).sortWithinPartitions(z_key(columns, low, high))
