"""Queries written in the dialect itself, through the SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.plans.engine import Engine
from quern.queries.registry import Tables, query


def dialect(name: str, tables: str, text: str, oracle: str) -> None:
    """Register ``sql_name``: a text of the dialect over these tables, against ordinary SQL."""

    @query(oracle, name=f"sql_{name}")
    def run(t: Tables) -> DataFrame:
        return Engine(t.spark).register_folder(t.sf_dir, *tables.split()).query(text)


dialect("flat_arithmetic", "nation", 'SELECT n_nationkey AS "k", 2 + n_nationkey * 4 - 1 AS "v", n_nationkey & 6 | 1 AS "b" FROM nation', "SELECT n_nationkey AS k, CAST((2 + n_nationkey) * 4 - 1 AS BIGINT) AS v, CAST((n_nationkey & 6) | 1 AS BIGINT) AS b FROM nation")
dialect("flat_logic", "orders", "SELECT o_orderkey AS \"k\" FROM orders WHERE o_orderstatus = 'F' OR o_orderstatus = 'O' AND o_totalprice > 150000", "SELECT o_orderkey AS k FROM orders WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND o_totalprice > 150000")
dialect("integer_division", "lineitem", 'SELECT l_linenumber / 2 AS "h", COUNT(*) AS "n" FROM lineitem GROUP BY l_linenumber / 2', "SELECT CAST(l_linenumber // 2 AS BIGINT) AS h, count(*) AS n FROM lineitem GROUP BY 1")
dialect("join_group_having", "orders customer", 'SELECT c.c_mktsegment AS "seg", COUNT(*) AS "n", ROUND(SUM(o.o_totalprice), 2) AS "total" FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000 GROUP BY c.c_mktsegment HAVING COUNT(*) > 10', "SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 10")
dialect("join_using", "documents labels", 'SELECT doc_id AS "d", lang AS "lang", quality AS "q" FROM documents LEFT JOIN labels USING (doc_id)', "SELECT doc_id AS d, lang, quality AS q FROM documents LEFT JOIN labels USING (doc_id)")
dialect("exists_or", "customer orders", 'SELECT c_custkey AS "k" FROM customer c WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)', "SELECT c_custkey AS k FROM customer c WHERE c_acctbal > 9500 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 200000)")
dialect("projected_exists", "nation supplier", 'SELECT n_name AS "n", EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 6000) AS "rich" FROM nation n', "SELECT n_name AS n, EXISTS (SELECT 1 FROM supplier s WHERE s.s_nationkey = n.n_nationkey AND s.s_acctbal > 6000) AS rich FROM nation n")
dialect("correlated_scalar", "customer orders", 'SELECT c_custkey AS "k", (SELECT MAX(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS "top" FROM customer c', "SELECT c_custkey AS k, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c")
dialect("chained_cte", "orders", 'WITH a (k, p) AS (SELECT o_custkey, o_totalprice FROM orders WHERE o_totalprice > 50000), b AS (SELECT k, COUNT(*) AS n FROM a GROUP BY k) SELECT k AS "k", n AS "n" FROM b WHERE n >= 5', "SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY 1 HAVING count(*) >= 5")
dialect("derived", "orders", 'SELECT d.s AS "s", MAX(d.n) AS "m" FROM (SELECT o_orderstatus AS s, o_custkey, COUNT(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) d GROUP BY d.s', "SELECT s, max(n) AS m FROM (SELECT o_orderstatus AS s, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY s")
dialect("union_all", "customer supplier", 'SELECT c_nationkey AS "k", c_acctbal AS "v" FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier', "SELECT c_nationkey AS k, c_acctbal AS v FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_nationkey, s_acctbal FROM supplier")
dialect("order_limit", "orders", 'SELECT o_orderkey AS "k", o_totalprice AS "p" FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5', "SELECT o_orderkey AS k, o_totalprice AS p FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5")
dialect("case_like", "part", "SELECT p_partkey AS \"k\", CASE WHEN p_name LIKE '%a%' THEN 'A' WHEN p_size BETWEEN 10 AND 20 THEN 'M' ELSE 'Z' END AS \"c\" FROM part", "SELECT p_partkey AS k, CASE WHEN p_name LIKE '%a%' THEN 'A' WHEN p_size BETWEEN 10 AND 20 THEN 'M' ELSE 'Z' END AS c FROM part")
dialect("is_distinct", "orders", "SELECT COUNT(*) AS \"n\" FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END IS DISTINCT FROM 'F'", "SELECT count(*) AS n FROM orders WHERE CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END IS DISTINCT FROM 'F'")
dialect("count_constant", "orders", 'SELECT COUNT(NULL) AS "n", COUNT(*) AS "m", COUNT(1) AS "o" FROM orders', "SELECT count(*) AS n, count(*) AS m, count(*) AS o FROM orders")
dialect("functions", "part", "SELECT p_partkey AS \"k\", CONCAT(UPPER(p_brand), NULL, '-', p_size) AS \"c\", LENGTH(p_name) AS \"n\", SUBSTRING(p_type, 2, 3) AS \"t\", CAST(p_retailprice AS BIGINT) AS \"i\", GREATEST(p_size, 25) AS \"g\" FROM part", "SELECT p_partkey AS k, concat(upper(p_brand), '-', p_size) AS c, CAST(length(p_name) AS BIGINT) AS n, substring(p_type, 2, 3) AS t, CAST(floor(p_retailprice + 0.5) AS BIGINT) AS i, CAST(greatest(p_size, 25) AS BIGINT) AS g FROM part")
dialect("full_join", "nation region", 'SELECT n.n_name AS "n", r.r_name AS "r" FROM (SELECT * FROM nation WHERE n_regionkey > 1) n FULL OUTER JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n.n_regionkey = r.r_regionkey', "SELECT n.n_name AS n, r.r_name AS r FROM (SELECT * FROM nation WHERE n_regionkey > 1) n FULL OUTER JOIN (SELECT * FROM region WHERE r_regionkey < 3) r ON n.n_regionkey = r.r_regionkey")
dialect("recursive_level", "part", 'WITH RECURSIVE r AS (SELECT p_partkey AS id, 0 AS depth FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, r.depth + 1 FROM part p JOIN r ON p.p_partkey / 2 = r.id) SELECT id AS "id", depth AS "depth" FROM r', "WITH RECURSIVE r AS (SELECT p_partkey AS id, CAST(0 AS BIGINT) AS depth FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, r.depth + 1 FROM part p JOIN r ON p.p_partkey // 2 = r.id) SELECT id, depth FROM r")
dialect("recursive_distinct", "nation", 'WITH RECURSIVE r AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey = 2 UNION SELECT (n.n_nationkey * 3 + 1) % 25 FROM nation n JOIN r ON n.n_nationkey = r.k) SELECT k AS "k" FROM r', "WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation WHERE n_nationkey = 2 UNION SELECT (n.n_nationkey * 3 + 1) % 25 FROM nation n JOIN r ON n.n_nationkey = r.k) SELECT k FROM r")
dialect("qualify_knn", "embeddings", f'SELECT vec_id AS "id", label AS "label" FROM embeddings QUALIFY ROW_NUMBER() OVER (PARTITION BY label ORDER BY euclidean_distance(embedding, [{", ".join(["0.5"] * 64)}])) <= 2', f"SELECT id, label FROM (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY list_distance(CAST(embedding AS DOUBLE[]), [{', '.join(['0.5'] * 64)}]::DOUBLE[])) AS r FROM embeddings) WHERE r <= 2")
dialect("text_plus_and_ieee", "region", "SELECT r_name + '!' AS \"n\", CASE WHEN 1.0 / (r_regionkey - r_regionkey) > 1000.0 THEN 'inf' END AS \"x\" FROM region", "SELECT r_name || '!' AS n, 'inf' AS x FROM region")
TREE_SQL = "WITH RECURSIVE r AS (SELECT p_partkey AS id, [p_partkey] AS path FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey, list_append(r.path, p.p_partkey) FROM part p JOIN r ON p.p_partkey // 2 = r.id)"
TREE = "WITH RECURSIVE r AS (SELECT p_partkey AS id FROM part WHERE p_partkey = 1 UNION ALL SELECT p.p_partkey FROM part p JOIN r ON p.p_partkey / 2 = r.id) TRAVERSAL ORDER"
dialect("recursive_pre_order", "part", TREE + ' pre_order SELECT id AS "id" FROM r', TREE_SQL + " SELECT id FROM r ORDER BY path")
dialect("recursive_post_order", "part", TREE + ' post_order SELECT id AS "id" FROM r', TREE_SQL + " SELECT id FROM r ORDER BY list_append(path, 99999999999)")
