"""Key expressions, collation, user-defined functions and plan tools."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import relational as R
from quern.plans.engine import Engine
from quern.queries.registry import Tables, query


@query("SELECT p_partkey AS k, p_size + 7 AS a, p_size - 7 AS s, p_size * 3 AS m, p_size // 4 AS d, p_size % 4 AS r, p_size & 12 AS x, p_size | 12 AS o, xor(p_size, 12) AS e, ~p_size AS n FROM part")
def key_functions(t: Tables) -> DataFrame:
    s = F.col("p_size")
    return t.part.select(F.col("p_partkey").alias("k"), (s + 7).alias("a"), (s - 7).alias("s"), (s * 3).alias("m"), F.expr("cast(p_size div 4 AS int)").alias("d"), (s % 4).alias("r"), s.bitwiseAND(12).alias("x"), s.bitwiseOR(12).alias("o"), s.bitwiseXOR(12).alias("e"), F.bitwise_not(s).alias("n"))


@query("SELECT user_id, CAST(user_id % 64 AS BIGINT) AS bit, CAST(user_id - user_id % 64 AS BIGINT) AS bucket FROM events")
def key_bitmap_position(t: Tables) -> DataFrame:
    u = F.col("user_id")
    return t.events.select("user_id", F.pmod(u, F.lit(64)).cast("long").alias("bit"), (u - F.pmod(u, F.lit(64))).cast("long").alias("bucket"))


@query("SELECT lower(c_mktsegment) AS segment, count(*) AS n FROM customer GROUP BY 1")
def collation_group(t: Tables) -> DataFrame:
    """Upper and lower case are one group under a case-insensitive collation."""
    mixed = t.customer.withColumn("seg", F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")))
    return mixed.groupBy(F.collate("seg", "UTF8_LCASE").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.min(F.lower("seg")).alias("m")).select(F.col("m").cast("string").alias("segment"), "n")


@query("SELECT p_partkey AS k, CAST(length(p_name) * 2 + p_size AS BIGINT) AS v FROM part")
def udf_scalar(t: Tables) -> DataFrame:
    """A user's function of batches, called from SQL."""

    def twice(names, sizes):
        return names.str.len() * 2 + sizes

    Engine(t.spark).function("quern_twice", twice, "long")
    t.part.createOrReplaceTempView("quern_part")
    return t.spark.sql("SELECT p_partkey AS k, quern_twice(p_name, p_size) AS v FROM quern_part")


@query("SELECT n_nationkey AS k, CAST(unnest(range(0, n_regionkey + 1)) AS INTEGER) AS i FROM nation")
def udtf_lateral(t: Tables) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="i: int")
    class UpTo:
        def eval(self, n: int):
            for i in range(n + 1):
                yield (i,)

    t.spark.udtf.register("quern_up_to", UpTo)
    t.nation.createOrReplaceTempView("quern_nation")
    return t.spark.sql("SELECT n_nationkey AS k, i FROM quern_nation, LATERAL quern_up_to(n_regionkey)")


@query("SELECT 0 AS differences")
def plan_comparator(t: Tables) -> DataFrame:
    """Two plans of one question give the same rows."""
    a = R.exists(t.customer, t.orders, [("c_custkey", "o_custkey")]).select("c_custkey")
    b = t.customer.join(t.orders.groupBy("o_custkey").count(), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey")
    return t.spark.range(1).select(F.lit(0 if R.same_rows(a, b) else 1).alias("differences"))


@query("SELECT o_custkey AS k, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY 1")
def index_aggregate_view(t: Tables) -> DataFrame:
    """An index defined by a grouped query."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    e.execute("CREATE DATABASE /d")
    e.execute("CREATE SCHEMA TEMPLATE o CREATE TABLE o (k BIGINT NOT NULL, c BIGINT, p DOUBLE, PRIMARY KEY (k)) CREATE INDEX by_c AS SELECT c, COUNT(*) AS n, SUM(p) AS s FROM o GROUP BY c")
    e.execute("CREATE SCHEMA /d/s WITH TEMPLATE o")
    rows = e.schema.tables["ORDERS"]
    e.use("/d", "s")
    e.schema.tables["ORDERS"] = rows
    e.execute("INSERT INTO o SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
    return e.index("by_c").select(F.col("C").alias("k"), F.col("N").alias("n"), F.round("S", 2).alias("s"))


@query("SELECT event_id, CAST(r AS BIGINT) AS session FROM (SELECT event_id, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM (SELECT event_id, user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 6 HOUR, FALSE) AS gap FROM events))")
def ext_sessions(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.coalesce((F.col("ts") - F.lag("ts").over(w)) > F.expr("INTERVAL 6 HOURS"), F.lit(False))
    flagged = t.events.withColumn("gap", gap)
    return flagged.select("event_id", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(w).alias("session"))


@query("SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON e.user_id = p.user_id AND e.ts >= p.ts")
def ext_as_of_join(t: Tables) -> DataFrame:
    """For each purchase the user's latest click: both sides in one ordered pass for each user, nothing is paired."""
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    kind = F.when(F.col("event_type") == "click", 0).otherwise(1)
    w = Window.partitionBy("user_id").orderBy("ts", kind, "event_id").rowsBetween(Window.unboundedPreceding, 0)
    both = t.events.where("event_type IN ('purchase', 'click')").withColumn("b", F.last(click, ignorenulls=True).over(w))
    return both.where("event_type = 'purchase'").select("event_id", F.col("b.event_id").alias("before"))


@query("SELECT 'scan filter' AS what, true AS holds UNION ALL SELECT 'same plan', true UNION ALL SELECT 'other plan', false")
def explain_and_plan_hash(t: Tables) -> DataFrame:
    """EXPLAIN names the scan and the pushed filter; the fingerprint of a plan does not depend on spelling, but on the question."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    plan = e.rows("EXPLAIN SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")[0][0]
    a, b, c = (e.plan_hash(x) for x in ("SELECT o_orderkey FROM orders WHERE o_totalprice > 1", "select O_ORDERKEY from ORDERS where (o_totalprice) > 1", "SELECT o_orderkey FROM orders WHERE o_totalprice > 2"))
    return t.spark.createDataFrame([("scan filter", "PushedFilters" in plan and "GreaterThan(o_totalprice" in plan), ("same plan", a == b), ("other plan", a == c)], "what string, holds boolean")


@query("SELECT o_custkey AS k, count(*) AS n, CAST(max(floor(o_totalprice / 1000)) AS DOUBLE) AS top FROM orders WHERE o_totalprice > 50000 GROUP BY 1")
def sql_view_and_function(t: Tables) -> DataFrame:
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    e.execute("CREATE VIEW dear AS SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 50000; CREATE FUNCTION thousands (IN x DOUBLE) RETURNS DOUBLE AS FLOOR(x / 1000.0)")
    return e.query('SELECT k AS "k", COUNT(*) AS "n", MAX(thousands(p)) AS "top" FROM dear GROUP BY k')


@query("SELECT c_custkey AS k, o_orderkey AS o FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000")
def sql_table_function(t: Tables) -> DataFrame:
    e = Engine(t.spark).register_folder(t.sf_dir, "orders", "customer")
    e.execute("CREATE FUNCTION above (IN low DOUBLE) AS SELECT o_custkey AS who, o_orderkey AS o FROM orders WHERE o_totalprice > low")
    return e.query('SELECT c_custkey AS "k", a.o AS "o" FROM customer, above(100000.0) a WHERE a.who = c_custkey')


@query("SELECT p_partkey AS k, p_type LIKE '%' || substr(p_brand, 1, 1) || '%' AS a, p_name || '_x%' LIKE replace(replace(p_name, '%', ''), '_', '') || '!_x!%' ESCAPE '!' AS b FROM part")
def sql_like_of_columns(t: Tables) -> DataFrame:
    """Patterns that are computed, with and without an escape."""
    e = Engine(t.spark).register_folder(t.sf_dir, "part")
    return e.query("SELECT p_partkey AS \"k\", p_type LIKE CONCAT('%', SUBSTRING(p_brand, 1, 1), '%') AS \"a\", p_name + '_x%' LIKE p_name + '!_x!%' ESCAPE '!' AS \"b\" FROM part")


@query("SELECT n_nationkey AS k, CASE WHEN n_regionkey = 0 THEN 'nan' ELSE CAST(CAST(n_nationkey % n_regionkey AS DOUBLE) AS VARCHAR) END AS m FROM nation")
def sql_mod_by_zero(t: Tables) -> DataFrame:
    """MOD of doubles by zero is not a number, as % is."""
    e = Engine(t.spark).register_folder(t.sf_dir, "nation")
    out = e.query("SELECT n_nationkey AS k, MOD(CAST(n_nationkey AS DOUBLE), CAST(n_regionkey AS DOUBLE)) AS m FROM nation")
    return out.select(F.col("K").alias("k"), F.when(F.isnan("M"), "nan").otherwise(F.col("M").cast("string")).alias("m"))


@query("SELECT vec_id AS id FROM (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN vec_id % 7 END AS d FROM embeddings) ORDER BY d DESC NULLS FIRST, vec_id LIMIT 5")
def sql_qualify_null_order(t: Tables) -> DataFrame:
    """QUALIFY without groups: the first rows in an explicit order of nulls."""
    e = Engine(t.spark).register_folder(t.sf_dir, "embeddings")
    return e.query('SELECT vec_id AS "id" FROM (SELECT vec_id, CASE WHEN vec_id % 3 > 0 THEN vec_id % 7 END AS d FROM embeddings) x QUALIFY ROW_NUMBER() OVER (ORDER BY d DESC NULLS FIRST, vec_id) <= 5')
