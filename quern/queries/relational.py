"""Scans, predicates, joins, aggregates, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.operators import relational as R
from quern.queries.registry import Tables, query
from quern.sources import tables as T

NULLED = "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderstatus END"


def nulled(t: Tables) -> DataFrame:
    """Orders whose status is null for every seventh key."""
    return t.orders.withColumn("status", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))


@query("""SELECT n.n_name AS nation, c.c_mktsegment AS segment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS revenue, round(avg(o.o_totalprice), 2) AS mean_price
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE o.o_orderdate >= TIMESTAMP '1996-01-01' AND o.o_totalprice > 1000 GROUP BY 1, 2 HAVING count(*) >= 2""")
def flagship(t: Tables) -> DataFrame:
    o = t.orders.where((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_totalprice") > 1000))
    # customers shrink the fact side to two keys before the names are looked up
    per = o.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("s"))
    out = per.where("n_orders >= 2").join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "n_orders", F.round("s", 2).alias("revenue"), F.round(F.col("s") / F.col("n_orders"), 2).alias("mean_price"))


@query("SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity < 10 AND l_shipdate < TIMESTAMP '1997-01-01'")
def scan_filter_project(t: Tables) -> DataFrame:
    return T.scan(t.spark, f"{t.sf_dir}/lineitem.parquet", ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"], "l_quantity < 10 AND l_shipdate < TIMESTAMP_NTZ '1997-01-01'")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 50")
def scan_reverse(t: Tables) -> DataFrame:
    return T.scan(t.spark, f"{t.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"], reverse_by=["o_orderkey"], limit=50)


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 40")
def keyset_page(t: Tables) -> DataFrame:
    return T.page(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], 40, (500,))


@query("SELECT c_nationkey, c_custkey FROM customer WHERE c_nationkey > 5 OR (c_nationkey = 5 AND c_custkey > 100) ORDER BY c_nationkey, c_custkey LIMIT 40")
def keyset_page_composite(t: Tables) -> DataFrame:
    return T.page(t.customer.select("c_nationkey", "c_custkey"), ["c_nationkey", "c_custkey"], 40, (5, 100))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (1, 5, 77, 99999999)")
def load_by_keys(t: Tables) -> DataFrame:
    keys = t.spark.createDataFrame([(1,), (5,), (77,), (77,), (99999999,)], "c_custkey long")
    return R.load_by_keys(t.customer.select("c_custkey", "c_name"), keys, ["c_custkey"])


@query("SELECT 'orders' AS _type, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'nation', count(*) FROM nation")
def record_counts(t: Tables) -> DataFrame:
    return T.record_counts({n: getattr(t, n) for n in ("orders", "customer", "nation")})


@query("SELECT _type, key FROM (SELECT 'supplier' AS _type, s_suppkey AS key FROM supplier UNION ALL SELECT 'customer', c_custkey FROM customer UNION ALL SELECT 'part', p_partkey FROM part) WHERE _type IN ('supplier', 'part')")
def type_filter(t: Tables) -> DataFrame:
    one = lambda df, name, key: df.select(F.lit(name).alias("_type"), F.col(key).alias("key"))
    return R.type_filter(one(t.supplier, "supplier", "s_suppkey").union(one(t.customer, "customer", "c_custkey")).union(one(t.part, "part", "p_partkey")), "supplier", "part")


# predicates


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {NULLED} AS status FROM orders) WHERE NOT (status = 'F')")
def kleene_not(t: Tables) -> DataFrame:
    return nulled(t).where(~(F.col("status") == "F")).select("o_orderkey")


@query(f"SELECT CAST(sum(CASE WHEN p THEN 1 ELSE 0 END) AS BIGINT) AS n_true, CAST(sum(CASE WHEN NOT p THEN 1 ELSE 0 END) AS BIGINT) AS n_false, CAST(sum(CASE WHEN p IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unknown FROM (SELECT ({NULLED}) = 'O' OR o_totalprice > 200000 AS p FROM orders)")
def kleene_or_counts(t: Tables) -> DataFrame:
    p = (F.col("status") == "O") | (F.col("o_totalprice") > 200000)
    return nulled(t).select(p.alias("p")).agg(F.count(F.when(F.col("p"), 1)).alias("n_true"), F.count(F.when(~F.col("p"), 1)).alias("n_false"), F.count(F.when(F.col("p").isNull(), 1)).alias("n_unknown"))


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23)")
def in_list(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_size").isin(1, 7, 23)).select("p_partkey", "p_size")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {NULLED} AS status FROM orders) WHERE status NOT IN ('F', 'P')")
def not_in_list(t: Tables) -> DataFrame:
    return nulled(t).where(~F.col("status").isin("F", "P")).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE p_retailprice BETWEEN 950 AND 1100 AND NOT (p_size BETWEEN 10 AND 20)")
def between(t: Tables) -> DataFrame:
    return t.part.where(S.between("p_retailprice", F.lit(950), F.lit(1100)) & ~S.between("p_size", F.lit(10), F.lit(20))).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 20 AND 10")
def between_reversed(t: Tables) -> DataFrame:
    return t.part.where(S.between("p_size", F.lit(20), F.lit(10))).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a_e%' AND p_type NOT LIKE 'S%'")
def like(t: Tables) -> DataFrame:
    return t.part.where(S.like("p_name", "%a_e%") & ~S.like("p_type", "S%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '50%' WHEN p_size % 3 = 1 THEN '50x' ELSE '5_\\x' END AS s FROM part) WHERE s LIKE '50!%' ESCAPE '!' OR s LIKE '5!_\\_' ESCAPE '!'")
def like_escape(t: Tables) -> DataFrame:
    s = t.part.withColumn("s", F.when(F.col("p_size") % 3 == 0, "50%").when(F.col("p_size") % 3 == 1, "50x").otherwise("5_\\x"))
    return s.where(S.like("s", "50!%", "!") | S.like("s", "5!_\\_", "!")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE starts_with(p_brand, 'Brand#1')")
def starts_with(t: Tables) -> DataFrame:
    return t.part.where(F.col("p_brand").startswith("Brand#1")).select("p_partkey")


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, {NULLED} AS status, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'F' END AS other FROM orders) WHERE status IS DISTINCT FROM other")
def is_distinct(t: Tables) -> DataFrame:
    return nulled(t).withColumn("other", F.when(F.col("o_orderkey") % 3 != 0, "F")).where(S.is_distinct("status", "other")).select("o_orderkey")


@query(f"SELECT count(*) AS n_null, count(s) AS n_not_null FROM (SELECT {NULLED} AS s FROM orders) WHERE s IS NULL OR s IS NOT NULL AND s <> 'P' ", name="is_null_counts")
def is_null(t: Tables) -> DataFrame:
    return nulled(t).where(F.col("status").isNull() | (F.col("status").isNotNull() & (F.col("status") != "P"))).agg(F.count(F.lit(1)).alias("n_null"), F.count("status").alias("n_not_null"))


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 150000) <> (o_orderstatus = 'O')")
def xor(t: Tables) -> DataFrame:
    return t.orders.where(S.xor(F.col("o_totalprice") > 150000, F.col("o_orderstatus") == "O")).select("o_orderkey")


@query("SELECT o_orderkey, big FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice > 100000 END AS big FROM orders) WHERE big IS NOT TRUE")
def is_not_true(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") > 100000).alias("big"))
    return rows.where(~F.col("big").eqNullSafe(F.lit(True)))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 100000", name="bare_boolean")
def bare_boolean(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (F.col("o_totalprice") > 100000).alias("flag")).where("flag").select("o_orderkey")


# joins


@query("SELECT c.c_name, o.o_orderkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000")
def join_inner(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 100000"), F.col("c_custkey") == F.col("o_custkey")).select("c_name", "o_orderkey")


@query("SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 200000 GROUP BY 1")
def join_left(t: Tables) -> DataFrame:
    # grouped before the join: one row for each customer travels instead of each order
    n = t.orders.where("o_totalprice > 200000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n"))
    return t.customer.select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("SELECT d.doc_id, d.lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality = 0")
def join_left_where_right(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left").where("quality = 0").select("doc_id", "lang")


@query("SELECT l.toxic, d.doc_id FROM (SELECT * FROM labels WHERE doc_id % 4 = 0) l RIGHT JOIN documents d ON d.doc_id = l.doc_id")
def join_right(t: Tables) -> DataFrame:
    return t.labels.where("doc_id % 4 = 0").join(t.documents.select("doc_id"), "doc_id", "right").select("toxic", "doc_id")


@query("SELECT a.k AS ak, b.k AS bk FROM (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 3 = 0) a FULL JOIN (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 5 = 0) b ON a.k = b.k")
def join_full(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("ak"))
    b = t.orders.where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("bk"))
    return a.join(b, F.col("ak") == F.col("bk"), "full")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t: Tables) -> DataFrame:
    return t.region.select("r_name").crossJoin(t.nation.select("n_name"))


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t: Tables) -> DataFrame:
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("SELECT n.n_nationkey, s.s_suppkey FROM nation n JOIN supplier s ON n.n_nationkey > s.s_nationkey AND s.s_acctbal > 5000 AND n.n_regionkey = 1")
def join_theta(t: Tables) -> DataFrame:
    return t.nation.where("n_regionkey = 1").join(t.supplier.where("s_acctbal > 5000"), F.col("n_nationkey") > F.col("s_nationkey")).select("n_nationkey", "s_suppkey")


@query("SELECT a.k AS ak, b.k AS bk, a.i, b.j FROM (SELECT n_nationkey AS i, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) a JOIN (SELECT r_regionkey AS j, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS k FROM region) b ON a.k IS NOT DISTINCT FROM b.k")
def join_null_safe(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("i"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("ak"))
    b = t.region.select(F.col("r_regionkey").alias("j"), F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("bk"))
    return a.join(b, R.on_keys(a, b, [("ak", "bk")], null_safe=True)).select("ak", "bk", "i", "j")


@query("SELECT a.i, b.j FROM (SELECT n_nationkey AS i, CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE n_regionkey END AS k FROM nation) a JOIN (SELECT r_regionkey AS j, CASE WHEN r_regionkey = 0 THEN NULL ELSE r_regionkey END AS k FROM region) b ON a.k = b.k")
def join_null_keys(t: Tables) -> DataFrame:
    a = t.nation.select(F.col("n_nationkey").alias("i"), F.when(F.col("n_nationkey") % 4 != 0, F.col("n_regionkey")).alias("ak"))
    b = t.region.select(F.col("r_regionkey").alias("j"), F.when(F.col("r_regionkey") != 0, F.col("r_regionkey")).alias("bk"))
    return a.join(b, R.on_keys(a, b, [("ak", "bk")])).select("i", "j")


@query("SELECT r.r_name, count(*) AS n FROM region r JOIN nation n ON r.r_regionkey = n.n_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY 1")
def join_four_way(t: Tables) -> DataFrame:
    small = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT s.s_suppkey, c.c_custkey FROM supplier s JOIN customer c ON s.s_nationkey = c.c_nationkey AND s.s_suppkey = c.c_custkey")
def join_composite(t: Tables) -> DataFrame:
    return t.supplier.join(t.customer, (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_suppkey") == F.col("c_custkey"))).select("s_suppkey", "c_custkey")


@query("SELECT p.p_partkey, CAST(e.event_id AS BIGINT) AS event_id FROM part p JOIN events e ON CAST(p.p_size AS DOUBLE) = e.value")
def join_cross_type(t: Tables) -> DataFrame:
    return t.part.join(t.events, F.col("p_size").cast("double") == F.col("value")).select("p_partkey", F.col("event_id").cast("long").alias("event_id"))


@query("SELECT n.n_nationkey AS k, u.v, CAST(u.i AS BIGINT) AS i FROM nation n, (SELECT n_nationkey AS id, unnest([n_regionkey, n_nationkey, 7]) AS v, unnest([1, 2, 3]) AS i FROM nation) u WHERE u.id = n.n_nationkey")
def lateral_unnest(t: Tables) -> DataFrame:
    rows = t.nation.select(F.col("n_nationkey").alias("k"), F.array("n_regionkey", "n_nationkey", F.lit(7)).alias("a"))
    return R.unnest(rows, "a", "v", "i").select("k", "v", "i")


# aggregates


@query("SELECT count(*) AS n, count(l_quantity) AS nq, round(sum(l_quantity), 2) AS s, round(min(l_quantity), 2) AS lo, round(max(l_quantity), 2) AS hi, round(avg(l_quantity), 6) AS a FROM lineitem WHERE l_quantity < -1")
def agg_global_empty(t: Tables) -> DataFrame:
    return t.lineitem.where("l_quantity < -1").agg(F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("nq"), F.round(F.sum("l_quantity"), 2).alias("s"), F.round(F.min("l_quantity"), 2).alias("lo"), F.round(F.max("l_quantity"), 2).alias("hi"), F.round(F.avg("l_quantity"), 6).alias("a"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def agg_group(t: Tables) -> DataFrame:
    price, disc, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base"), F.round(F.sum(price * (1 - disc)), 2).alias("sum_disc"), F.round(F.sum(price * (1 - disc) * (1 + tax)), 2).alias("sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count(F.lit(1)).alias("n"))
    )


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY 1")
def agg_by_expression(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS f, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS o, round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END), 2) AS p FROM orders GROUP BY 1")
def agg_case(t: Tables) -> DataFrame:
    s = F.col("o_orderstatus")
    return t.orders.groupBy("o_custkey").agg(F.count(F.when(s == "F", 1)).alias("f"), F.count(F.when(s == "O", 1)).alias("o"), F.round(F.sum(F.when(s == "P", F.col("o_totalprice")).otherwise(0.0)), 2).alias("p"))


@query(f"SELECT ({NULLED}) AS status, count(*) AS n FROM orders GROUP BY 1")
def agg_null_group(t: Tables) -> DataFrame:
    return nulled(t).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 HAVING count(*) > 12 AND sum(o_totalprice) > 1000000")
def having(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("s")).where("n > 12 AND s > 1000000").select("o_custkey", "n", F.round("s", 2).alias("total"))


@query("SELECT count(*) AS n FROM orders HAVING count(*) > 1000000000")
def having_no_group(t: Tables) -> DataFrame:
    return t.orders.agg(F.count(F.lit(1)).alias("n")).where("n > 1000000000")


@query(f"SELECT count(*) AS n_star, count(s) AS n_col, count(1) AS n_const FROM (SELECT {NULLED} AS s FROM orders)")
def count_star_vs_col(t: Tables) -> DataFrame:
    return nulled(t).agg(F.count(F.lit(1)).alias("n_star"), F.count("status").alias("n_col"), F.count(F.lit(1)).alias("n_const"))


@query("SELECT l_suppkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, max(l_quantity) AS q FROM lineitem GROUP BY 1")
def min_max(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_suppkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"), F.max("l_quantity").alias("q"))


@query("SELECT a.o_custkey, a.n, b.top FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON a.o_custkey = b.o_custkey")
def zip_aggregates(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    b = t.orders.where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    return R.zip_aggregates([a, b], ["o_custkey"])


# distinct, sorts, limits, set operations


@query("SELECT DISTINCT o_orderstatus FROM orders")
def distinct(t: Tables) -> DataFrame:
    return t.orders.select("o_orderstatus").distinct()


@query(f"SELECT DISTINCT ({NULLED}) AS status, o_orderpriority FROM orders")
def distinct_compound(t: Tables) -> DataFrame:
    return nulled(t).select("status", "o_orderpriority").distinct()


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey) AS r FROM lineitem) WHERE r = 1")
def distinct_by_key(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber").dropDuplicates(["l_orderkey", "l_linenumber"])


@query(f"SELECT o_orderkey, status FROM (SELECT o_orderkey, {NULLED} AS status FROM orders) ORDER BY status ASC NULLS FIRST, o_orderkey LIMIT 30")
def order_nulls_first(t: Tables) -> DataFrame:
    return nulled(t).select("o_orderkey", "status").orderBy(F.col("status").asc(), "o_orderkey").limit(30)


@query(f"SELECT o_orderkey, status FROM (SELECT o_orderkey, {NULLED} AS status FROM orders) ORDER BY status DESC NULLS LAST, o_orderkey LIMIT 30")
def order_desc_nulls_last(t: Tables) -> DataFrame:
    return nulled(t).select("o_orderkey", "status").orderBy(F.col("status").desc(), "o_orderkey").limit(30)


@query(f"SELECT o_orderkey, status FROM (SELECT o_orderkey, {NULLED} AS status FROM orders) ORDER BY status ASC NULLS LAST, o_orderkey DESC LIMIT 30")
def order_nulls_override(t: Tables) -> DataFrame:
    return nulled(t).select("o_orderkey", "status").orderBy(F.col("status").asc_nulls_last(), F.desc("o_orderkey")).limit(30)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 + o_custkey, o_orderkey LIMIT 20 OFFSET 15")
def limit_offset(t: Tables) -> DataFrame:
    return t.orders.orderBy(F.col("o_totalprice") * 2 + F.col("o_custkey"), "o_orderkey").offset(15).limit(20).select("o_orderkey")


@query("SELECT o_orderkey FROM orders LIMIT 0")
def limit_zero(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey").limit(0)


@query("SELECT o_custkey FROM orders GROUP BY o_custkey ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 10")
def order_by_aggregate(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("s")).orderBy(F.desc("s"), "o_custkey").limit(10).select("o_custkey")


@query("SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_all(t: Tables) -> DataFrame:
    return R.union_all(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")), t.supplier.select("s_suppkey", "s_acctbal"))


@query("SELECT DISTINCT k FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)")
def merge_union_distinct(t: Tables) -> DataFrame:
    return R.merge_union([t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select("s_nationkey")], ["k"], distinct=True)


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def intersection_by_key(t: Tables) -> DataFrame:
    key = F.col("o_custkey").alias("c_custkey")
    return R.intersection([t.customer.select("c_custkey", "c_name"), t.orders.where("o_orderstatus = 'P'").select(key), t.orders.where("o_totalprice > 150000").select(key)], ["c_custkey"])


@query("SELECT CAST(range AS BIGINT) AS id FROM range(3, 40, 7)")
def table_function_range(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT id FROM range(3, 40, 7)")


@query("SELECT 1 AS a, 'x' AS b, CAST(NULL AS BIGINT) AS c")
def values_row(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit(1).alias("a"), F.lit("x").alias("b"), F.lit(None).cast("long").alias("c"))


@query("SELECT CAST(-1 AS BIGINT) AS o_orderkey, CAST('none' AS VARCHAR) AS o_orderstatus")
def default_on_empty(t: Tables) -> DataFrame:
    return R.default_on_empty(t.orders.where("o_totalprice < 0").select("o_orderkey", "o_orderstatus"), {"o_orderkey": -1, "o_orderstatus": "none"})


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def first_or_default(t: Tables) -> DataFrame:
    top = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    return R.first_or_default(top, [F.desc("o_totalprice"), F.asc("o_orderkey")], {"o_orderkey": -1}).drop("o_totalprice")


# extensions beyond the dialect


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 7000")
def ext_except(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_nationkey").alias("k")).subtract(t.supplier.where("s_acctbal > 7000").select("s_nationkey"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
def ext_count_distinct(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_rollup(t: Tables) -> DataFrame:
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t: Tables) -> DataFrame:
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM events")
def ext_window_frame(t: Tables) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return t.events.select("event_id", F.round(F.sum("value").over(w), 4).alias("moving"))
