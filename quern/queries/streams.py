"""Streams over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.queries.registry import Tables, query
from quern.streaming import events as E


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def incremental_counts(t: Tables) -> DataFrame:
    stream = E.counts(E.source(t.spark, f"{t.sf_dir}/events.parquet"), ["event_type"])
    kept = E.Latest(t.spark, ["event_type"])
    E.run(stream, "update", "counts", kept)
    return kept.rows.select("event_type", "n", F.round("total", 4).alias("total"))


@query("""SELECT start, user_id, best, rank() OVER (PARTITION BY start ORDER BY best DESC) - 1 AS rank FROM
(SELECT s AS start, user_id, max(value) AS best FROM (SELECT user_id, value, ts, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1, 2)""")
def window_leaderboard_stream(t: Tables) -> DataFrame:
    stream = E.windowed(E.source(t.spark, f"{t.sf_dir}/events.parquet"), "ts", "2 days", "1 day", "1 hour", ["user_id"])
    kept = E.Latest(t.spark, ["start", "end", "user_id"])
    E.run(stream, "update", "leaderboard", kept)
    return E.leaderboard(kept.rows).select("start", "user_id", "best", "rank")
