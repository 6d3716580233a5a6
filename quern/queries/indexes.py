"""Index-defined computations: ranks, leaderboards, permuted extremes, bitmaps, versions, text and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import indexes as I
from quern.operators import text as X
from quern.queries.registry import Tables, query


@query("SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders WHERE o_orderpriority LIKE '1%'")
def index_value_filtered(t: Tables) -> DataFrame:
    return I.value_index(t.orders, ["o_orderstatus", "o_totalprice"], ["o_orderkey"], F.col("o_orderpriority").startswith("1"))


@query("SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey FROM part")
def index_value_fan_out(t: Tables) -> DataFrame:
    return I.value_index(t.part.withColumn("word", F.split("p_name", " ")), ["word"], ["p_partkey"], fan_out="word")


@query("SELECT count(*) AS n FROM nation")
def index_unique(t: Tables) -> DataFrame:
    I.check_unique(t.nation, ["n_name"])
    return t.nation.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def index_count(t: Tables) -> DataFrame:
    return I.counts(t.events, ["event_type"])


@query("SELECT event_type, count(CASE WHEN user_id % 3 <> 0 THEN value END) AS n FROM events GROUP BY 1")
def index_count_not_null(t: Tables) -> DataFrame:
    return I.counts_not_null(t.events.withColumn("v", F.when(F.col("user_id") % 3 != 0, F.col("value"))), ["event_type"], "v")


@query("SELECT k, CAST(sum(v) AS BIGINT) AS total FROM (SELECT event_id % 50 AS k, CAST(event_id % 3 - 1 AS BIGINT) AS v FROM events) GROUP BY k HAVING sum(v) <> 0")
def index_sum_clear_zero(t: Tables) -> DataFrame:
    return I.sums(t.events.select((F.col("event_id") % 50).alias("k"), (F.col("event_id") % 3 - 1).alias("v")), ["k"], "v", clear_when_zero=True)


def log(t: Tables) -> DataFrame:
    """A change log: every event saves its user, every tenth deletes it."""
    e = F.col("event_id")
    return t.events.select("event_id", "user_id", "event_type", "value", F.when(e % 10 == 0, "delete").when(e % 3 == 0, "insert").otherwise("update").alias("op"))


@query("SELECT user_id, count(*) AS n_updates FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def index_count_updates(t: Tables) -> DataFrame:
    return I.count_updates(log(t), ["user_id"])


@query("SELECT user_id, min(value) AS min_ever, max(value) AS max_ever FROM events WHERE event_id % 10 <> 0 GROUP BY 1")
def index_ever(t: Tables) -> DataFrame:
    return I.ever(log(t), ["user_id"], ["value"])


@query("SELECT user_id, a.event_type AS type, a.event_id AS id FROM (SELECT user_id, max(struct_pack(event_type := event_type, event_id := event_id)) AS a FROM events WHERE event_id % 10 <> 0 GROUP BY 1)")
def index_ever_tuple(t: Tables) -> DataFrame:
    return I.ever(log(t), ["user_id"], ["event_type", "event_id"]).select("user_id", F.col("max_ever.event_type").alias("type"), F.col("max_ever.event_id").alias("id"))


@query("SELECT user_id, max(event_id) AS max_version FROM events GROUP BY 1")
def index_max_ever_version(t: Tables) -> DataFrame:
    return I.max_ever_version(log(t), ["user_id"], "event_id")


@query("SELECT event_id, user_id FROM events WHERE event_id > 100 ORDER BY event_id LIMIT 60")
def index_version_feed(t: Tables) -> DataFrame:
    return I.version_feed(t.events.select("event_id", "user_id"), "event_id", 100, 60)


@query("SELECT event_type, user_id, max(value) AS value FROM events GROUP BY 1, 2")
def index_permuted_max(t: Tables) -> DataFrame:
    return I.permuted(t.events, ["event_type"], ["user_id"], "value", largest=True).select("event_type", "user_id", "value")


@query("SELECT event_type, user_id, min(value) AS value FROM events GROUP BY 1, 2")
def index_permuted_min(t: Tables) -> DataFrame:
    return I.permuted(t.events, ["event_type"], ["user_id"], "value", largest=False).select("event_type", "user_id", "value")


@query("SELECT s_suppkey, s_nationkey, dense_rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) - 1 AS rank FROM supplier")
def rank_of_score(t: Tables) -> DataFrame:
    return I.ranks(t.supplier.select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("score")), ["s_nationkey"], "score").select("s_suppkey", "s_nationkey", "rank")


@query("SELECT s_suppkey, rank() OVER (PARTITION BY s_nationkey ORDER BY floor(s_acctbal / 1000)) - 1 AS rank FROM supplier")
def rank_count_duplicates(t: Tables) -> DataFrame:
    return I.ranks(t.supplier.select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("score")), ["s_nationkey"], "score", count_duplicates=True).select("s_suppkey", "rank")


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice DESC) - 1 AS rank FROM orders")
def rank_global(t: Tables) -> DataFrame:
    return I.ranks(t.orders.select("o_orderkey", "o_totalprice"), [], "o_totalprice", count_duplicates=True, high_first=True).select("o_orderkey", "rank")


@query("SELECT c_nationkey, c_acctbal FROM (SELECT c_nationkey, c_acctbal, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) - 1 AS r FROM customer) WHERE r = 3 GROUP BY 1, 2")
def score_for_rank(t: Tables) -> DataFrame:
    return I.score_for_rank(t.customer, ["c_nationkey"], "c_acctbal", 3, high_first=True).select("c_nationkey", "c_acctbal")


@query("SELECT c_nationkey, count(DISTINCT CASE WHEN c_acctbal < 2500 THEN c_acctbal END) AS rank FROM customer GROUP BY 1")
def rank_for_score(t: Tables) -> DataFrame:
    return I.rank_for_score(t.customer, ["c_nationkey"], "c_acctbal", 2500)


@query("""SELECT name, user_id, best, rank() OVER (PARTITION BY name ORDER BY best DESC) - 1 AS rank FROM
(SELECT w.name, e.user_id, max(e.value) AS best FROM events e JOIN (VALUES ('early', TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-11'), ('middle', TIMESTAMP '2024-01-06', TIMESTAMP '2024-01-21')) w(name, s, e) ON e.ts >= w.s AND e.ts < w.e GROUP BY 1, 2)""")
def leaderboard_windows(t: Tables) -> DataFrame:
    windows = t.spark.sql("SELECT * FROM VALUES ('early', TIMESTAMP_NTZ '2024-01-01', TIMESTAMP_NTZ '2024-01-11'), ('middle', TIMESTAMP_NTZ '2024-01-06', TIMESTAMP_NTZ '2024-01-21') AS w(name, start, end)")
    return I.leaderboard(t.events, "user_id", "value", "ts", windows)


@query("SELECT 'all time' AS name, user_id, best, rank() OVER (ORDER BY best) - 1 AS rank FROM (SELECT user_id, min(value) AS best FROM events GROUP BY 1)")
def leaderboard_all_time(t: Tables) -> DataFrame:
    return I.leaderboard(t.events, "user_id", "value", "ts", None, high_first=False)


@query("SELECT date_trunc('day', ts) AS day, user_id, max(value) AS best FROM events GROUP BY 1, 2")
def leaderboard_daily(t: Tables) -> DataFrame:
    return I.sliding_windows(t.events, "ts", "1 day", "1 day").groupBy(F.col("start").alias("day"), "user_id").agg(F.max("value").alias("best"))


@query("SELECT event_type, b AS offset, count(DISTINCT user_id) AS n_bits FROM (SELECT event_type, user_id, user_id - user_id % 64 AS b FROM events) GROUP BY 1, 2")
def bitmap_counts(t: Tables) -> DataFrame:
    return I.bitmaps(t.events, ["event_type"], "user_id", 64).select("event_type", "offset", "n_bits")


@query("SELECT user_id - user_id % 64 AS offset, count(DISTINCT user_id) AS n_bits FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1")
def bitmap_union(t: Tables) -> DataFrame:
    maps = I.bitmaps(t.events.where("event_type IN ('click', 'purchase')"), ["event_type"], "user_id", 64)
    return I.bitmap_or(maps, []).select("offset", "n_bits")


@query("SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size <= 20 AND p_retailprice >= 950 AND p_retailprice <= 1200.5")
def spatial_box(t: Tables) -> DataFrame:
    return I.box(t.part, {"p_size": (10, 20), "p_retailprice": (950, 1200.5)}).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size <= 3 AND p_retailprice > 0")
def spatial_open_box(t: Tables) -> DataFrame:
    laid_out = I.spatial_layout(t.part, ["p_size", "p_retailprice"], [1, 900], [50, 2100], 8)
    return I.box(laid_out, {"p_size": (None, 3), "p_retailprice": (0.0001, None)}).select("p_partkey")


TOKENS = "tok AS (SELECT doc_id, token, i - 1 AS pos FROM (SELECT doc_id, unnest(ts) AS token, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ts FROM documents)))"


def index(t: Tables) -> DataFrame:
    return X.tokens(t.documents, "doc_id", "text")


@query(f"WITH {TOKENS} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tok WHERE starts_with(token, 'thi') GROUP BY 1")
def text_postings(t: Tables) -> DataFrame:
    per = index(t).where(F.col("token").startswith("thi")).groupBy("token", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("token").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE token IN ('moron', 'worthless')")
def text_any(t: Tables) -> DataFrame:
    return X.contains_any(index(t), "doc_id", ["moron", "worthless"])


@query(f"WITH {TOKENS} SELECT doc_id FROM tok WHERE token IN ('the', 'that', 'with') GROUP BY 1 HAVING count(DISTINCT token) = 3")
def text_all(t: Tables) -> DataFrame:
    return X.contains_all(index(t), "doc_id", ["the", "that", "with"])


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE starts_with(token, 'wor')")
def text_prefix(t: Tables) -> DataFrame:
    return X.contains_prefix(index(t), "doc_id", "wor")


@query(f"WITH {TOKENS} SELECT DISTINCT doc_id FROM tok WHERE starts_with(token, 'mor') OR starts_with(token, 'clow')")
def text_any_prefix(t: Tables) -> DataFrame:
    return X.contains_any_prefix(index(t), "doc_id", ["mor", "clow"])


@query(f"WITH {TOKENS} SELECT doc_id FROM tok GROUP BY 1 HAVING bool_or(starts_with(token, 'th')) AND bool_or(starts_with(token, 'wit'))")
def text_all_prefixes(t: Tables) -> DataFrame:
    return X.contains_all_prefixes(index(t), "doc_id", ["th", "wit"])


@query(f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the'")
def text_phrase(t: Tables) -> DataFrame:
    return X.phrase(index(t), "doc_id", ["of", "the"])


@query(f"WITH {TOKENS} SELECT DISTINCT a.doc_id FROM tok a JOIN tok b ON a.doc_id = b.doc_id AND abs(b.pos - a.pos) < 4 WHERE a.token = 'with' AND b.token = 'from'")
def text_within(t: Tables) -> DataFrame:
    return X.all_within(index(t), "doc_id", ["with", "from"], 4)


@query("SELECT o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1")
def index_count_distinct(t: Tables) -> DataFrame:
    return I.counts_distinct(t.orders, ["o_custkey"], "o_orderstatus")


@query("SELECT n_nationkey AS c_nationkey, max(CASE WHEN r = 20 THEN c_acctbal END) AS c_acctbal FROM (SELECT c_nationkey AS n_nationkey, c_acctbal, dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) - 1 AS r FROM customer) GROUP BY 1")
def score_for_rank_else_skip(t: Tables) -> DataFrame:
    """The score at rank 20 of every group; null where it has fewer."""
    return I.score_for_rank_else_skip(t.customer, ["c_nationkey"], "c_acctbal", 20, high_first=True)
