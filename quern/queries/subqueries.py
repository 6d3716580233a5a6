"""EXISTS, scalar subqueries, derived tables, common table expressions and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import recursive as rec
from quern.operators import relational as R
from quern.plans.engine import Engine
from quern.queries.registry import Tables, query


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
def semi_exists(t: Tables) -> DataFrame:
    return R.exists(t.customer, t.orders.where("o_totalprice > 150000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 150000)")
def anti_not_exists(t: Tables) -> DataFrame:
    return R.not_exists(t.customer, t.orders.where("o_totalprice > 150000"), [("c_custkey", "o_custkey")]).select("c_custkey")


@query("SELECT c_custkey FROM customer c WHERE c_acctbal > 9000 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
def exists_or(t: Tables) -> DataFrame:
    return R.exists_flag(t.customer, t.orders.where("o_totalprice > 200000"), [("c_custkey", "o_custkey")], "hit").where("c_acctbal > 9000 OR hit").select("c_custkey")


@query("SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic FROM documents d")
def projected_exists(t: Tables) -> DataFrame:
    return R.exists_flag(t.documents.select("doc_id"), t.labels.where("toxic = 1"), [("doc_id", "doc_id")], "toxic")


@query("SELECT n_nationkey FROM nation n WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n.n_nationkey AND EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 220000))")
def exists_nested(t: Tables) -> DataFrame:
    rich = R.exists(t.customer, t.orders.where("o_totalprice > 220000"), [("c_custkey", "o_custkey")])
    return R.exists(t.nation, rich, [("n_nationkey", "c_nationkey")]).select("n_nationkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def scalar_subquery(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("quern_orders")
    return t.spark.sql("SELECT o_orderkey FROM quern_orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM quern_orders)")


@query("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') AS top FROM customer c")
def correlated_scalar(t: Tables) -> DataFrame:
    top = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("top"))
    return t.customer.select("c_custkey").join(top, "c_custkey", "left")


@query("SELECT n_name, (SELECT min(s_suppkey) FROM supplier WHERE s_acctbal < -99999999) AS none FROM nation")
def scalar_subquery_empty(t: Tables) -> DataFrame:
    t.nation.createOrReplaceTempView("quern_nation")
    t.supplier.createOrReplaceTempView("quern_supplier")
    return t.spark.sql("SELECT n_name, (SELECT min(s_suppkey) FROM quern_supplier WHERE s_acctbal < -99999999) AS none FROM quern_nation")


@query("SELECT y, max(n) AS busiest FROM (SELECT CAST(year(o_orderdate) AS INTEGER) AS y, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY y")
def derived_table(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y"), "o_custkey").agg(F.count(F.lit(1)).alias("n")).groupBy("y").agg(F.max("n").alias("busiest"))


@query("WITH big AS (SELECT o_custkey AS k, o_totalprice AS p FROM orders WHERE o_totalprice > 120000), per AS (SELECT k, count(*) AS n FROM big GROUP BY k) SELECT per.k, per.n, round(sum(big.p), 2) AS total FROM per JOIN big ON per.k = big.k GROUP BY 1, 2")
def chained_cte(t: Tables) -> DataFrame:
    big = t.orders.where("o_totalprice > 120000").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("p"))
    return big.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p"), 2).alias("total"))


def hierarchy(t: Tables) -> DataFrame:
    """All parts as a binary tree: the parent of k is floor(k / 2), 1 is the root."""
    k = F.col("p_partkey")
    return t.part.select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).cast("long").alias("parent"))


TREE = "h AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent FROM part)"


@query(f"WITH RECURSIVE {TREE}, r AS (SELECT id, parent, 0 AS depth FROM h WHERE parent IS NULL UNION ALL SELECT h.id, h.parent, r.depth + 1 FROM h JOIN r ON h.parent = r.id) SELECT id, parent, CAST(depth AS INTEGER) AS depth FROM r")
def rcte_level(t: Tables) -> DataFrame:
    return rec.tree(hierarchy(t), "id", "parent").select("id", "parent", "depth")


@query(f"WITH RECURSIVE {TREE}, r AS (SELECT id, parent, [id] AS path FROM h WHERE parent IS NULL UNION ALL SELECT h.id, h.parent, list_append(r.path, h.id) FROM h JOIN r ON h.parent = r.id) SELECT id, row_number() OVER (ORDER BY path) AS visit FROM r")
def rcte_pre_order(t: Tables) -> DataFrame:
    return rec.pre_order(rec.tree(hierarchy(t), "id", "parent")).select("id", "visit")


@query(f"WITH RECURSIVE {TREE}, r AS (SELECT id, parent, [id] AS path FROM h WHERE parent IS NULL UNION ALL SELECT h.id, h.parent, list_append(r.path, h.id) FROM h JOIN r ON h.parent = r.id) SELECT id, row_number() OVER (ORDER BY list_append(path, 9999999)) AS visit FROM r")
def rcte_post_order(t: Tables) -> DataFrame:
    return rec.post_order(rec.tree(hierarchy(t), "id", "parent")).select("id", "visit")


@query("WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey FROM nation), r AS (SELECT 2 AS node UNION SELECT e.b FROM e JOIN r ON e.a = r.node) SELECT CAST(node AS INTEGER) AS node FROM r")
def rcte_distinct_cycle(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    edges = t.nation.select(k.alias("a"), ((k * 3 + 1) % 25).cast("int").alias("b")).union(t.nation.select(k, "n_regionkey"))
    seed = t.spark.range(1).select(F.lit(2).alias("node"))
    return rec.distinct_fixpoint(seed, lambda f: f.join(edges, F.col("node") == F.col("a")).select(F.col("b").alias("node")))


@query("WITH RECURSIVE r AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM r WHERE n < 40) SELECT n_name AS name, count(*) AS n, CAST(sum(n) AS BIGINT) AS total FROM r JOIN nation ON n_nationkey = n % 25 GROUP BY 1")
def rcte_count(t: Tables) -> DataFrame:
    """The engine's own recursion, level by level, aggregated and joined with a table afterwards."""
    e = Engine(t.spark).register_folder(t.sf_dir, "region", "nation")
    return e.query('WITH RECURSIVE r AS (SELECT n_nationkey + 1 AS n FROM nation WHERE n_nationkey = 0 UNION ALL SELECT r.n + 1 FROM r WHERE r.n < 40) SELECT x.n_name AS "name", COUNT(*) AS "n", SUM(r.n) AS "total" FROM r JOIN nation x ON x.n_nationkey = r.n % 25 GROUP BY x.n_name')
