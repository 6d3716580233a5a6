"""What the dialect rejects, with the code of each refusal, and the rules of statements that change data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.errors import SQLError
from quern.plans.engine import Engine
from quern.queries.dml import FILL, engine
from quern.queries.registry import Tables, query
from quern.sources import tables as sources

# Statements and the codes that the dialect gives them.
REJECTED = {
    "in_subquery": ("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)", "0AF00"),
    "empty_in": ("SELECT n_name FROM nation WHERE n_regionkey IN ()", "42601"),
    "row_value": ("SELECT n_name FROM nation WHERE (n_nationkey, n_regionkey) = (1, 2)", "0AF00"),
    "ilike": ("SELECT n_name FROM nation WHERE n_name ILIKE 'x'", "42601"),
    "regexp": ("SELECT n_name FROM nation WHERE n_name REGEXP 'x'", "42601"),
    "or_of_text": ("SELECT n_name FROM nation WHERE 's' || 't' = 'st'", "42804"),
    "text_for_number": ("SELECT n_name FROM nation WHERE n_nationkey = '5'", "42804"),
    "not_grouped": ("SELECT n_regionkey, n_name FROM nation GROUP BY n_regionkey", "42803"),
    "nested_aggregates": ("SELECT SUM(SUM(n_nationkey)) FROM nation", "0A000"),
    "row_number_selected": ("SELECT ROW_NUMBER() OVER (ORDER BY n_name) FROM nation", "42883"),
    "rank": ("SELECT RANK() OVER (ORDER BY n_name) FROM nation", "42883"),
    "sum_over": ("SELECT SUM(n_nationkey) OVER (PARTITION BY n_regionkey) FROM nation", "42883"),
    "ordinal_too_high": ("SELECT n_name FROM nation ORDER BY 3", "22023"),
    "group_ordinal_too_high": ("SELECT n_name FROM nation GROUP BY 7", "22023"),
    "ordered_twice": ("SELECT n_name FROM nation ORDER BY n_name, n_name", "42701"),
    "union_distinct": ("SELECT n_name FROM nation UNION SELECT r_name FROM region", "0AF00"),
    "intersect": ("SELECT n_name FROM nation INTERSECT SELECT r_name FROM region", "42601"),
    "except": ("SELECT n_name FROM nation EXCEPT SELECT r_name FROM region", "42601"),
    "union_arity": ("SELECT n_name FROM nation UNION ALL SELECT r_name, r_regionkey FROM region", "42F64"),
    "union_types": ("SELECT n_nationkey FROM nation UNION ALL SELECT r_name FROM region", "42F65"),
    "not_recursive": ("WITH RECURSIVE r AS (SELECT n_name FROM nation) SELECT * FROM r", "0A000"),
    "now": ("SELECT NOW() FROM nation", "42883"),
    "lpad": ("SELECT LPAD(n_name, 5, 'x') FROM nation", "42883"),
    "repeat": ("SELECT REPEAT(n_name, 2) FROM nation", "42883"),
    "nullif": ("SELECT NULLIF(n_name, 'x') FROM nation", "42883"),
    "minus_of_expression": ("SELECT -(n_nationkey) FROM nation", "42601"),
    "null_safe_sign": ("SELECT n_nationkey <=> n_regionkey FROM nation", "42601"),
    "ambiguous": ("SELECT n_name FROM nation x, nation y", "42702"),
    "alias_in_group": ("SELECT n_name AS x FROM nation GROUP BY x", "42703"),
    "alias_in_where": ("SELECT n_regionkey AS x FROM nation WHERE x = 1", "42703"),
    "negative_limit": ("SELECT n_name FROM nation LIMIT -1", "42601"),
    "two_column_scalar": ("SELECT (SELECT n_name, n_nationkey FROM nation) FROM region", "42601"),
    "many_row_scalar": ("SELECT r_name FROM region WHERE r_regionkey = (SELECT n_regionkey FROM nation)", "21000"),
    "divided_by_zero": ("SELECT n_nationkey / (n_regionkey - n_regionkey) FROM nation", "22012"),
    "too_large": ("SELECT 9223372036854775807 + r_regionkey FROM region WHERE r_regionkey = 1", "22003"),
    "no_such_table": ("SELECT x FROM nowhere", "42F01"),
    "no_such_column": ("SELECT nope FROM nation", "42703"),
    "change_as_query": ("DELETE FROM nation", "0A000"),
}
REJECTED_CHANGES = {
    "key_taken": ("INSERT INTO copy SELECT o_orderkey, 'x', 0.0 FROM orders", "23505"),
    "key_missing": ("INSERT INTO copy (status) VALUES ('q')", "23502"),
    "too_few_values": ("INSERT INTO copy VALUES (-9, 'q')", "42601"),
    "text_for_number": ("INSERT INTO copy VALUES (-9, 5, 1.0)", "22000"),
    "undefined_column": ("UPDATE copy SET nope = 1", "42703"),
    "key_column": ("UPDATE copy SET k = 9", "0A000"),
    "default": ("UPDATE copy SET price = DEFAULT", "0AF00"),
    "delete_limit": ("DELETE FROM copy LIMIT 1", "0AF00"),
    "query_as_change": ("SELECT k FROM copy", "0A000"),
}


def states(cases: dict[str, tuple[str, str]], run: Callable, t: Tables) -> DataFrame:
    """what, state: the code with which each statement is refused, null for one that is taken."""
    rows = []
    for what, (text, _) in cases.items():
        try:
            run(text)
            rows.append((what, None))
        except SQLError as e:
            rows.append((what, e.state))
    return t.spark.createDataFrame(rows, "what string, state string")


def stated(cases: dict[str, tuple[str, str]]) -> str:
    return "SELECT what, state FROM (VALUES " + ", ".join(f"('{what}', '{state}')" for what, (_, state) in cases.items()) + ") v(what, state)"


@query(stated(REJECTED))
def sql_rejected(t: Tables) -> DataFrame:
    return states(REJECTED, Engine(t.spark).register_folder(t.sf_dir, "nation", "region").rows, t)


@query(stated(REJECTED_CHANGES))
def dml_rejected(t: Tables) -> DataFrame:
    """Statements that break a rule are refused and leave the table alone."""
    e = engine(t)
    e.execute(FILL)
    found = states(REJECTED_CHANGES, e.execute, t)
    if e.rows("SELECT COUNT(*) FROM copy") != e.rows("SELECT COUNT(*) FROM orders"):
        raise AssertionError("a refused statement has changed the table")
    return found


@query("SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 120000.5 AND o_orderstatus <> 'F'")
def sql_parameters(t: Tables) -> DataFrame:
    """Values for question marks."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    return e.query('SELECT o_orderkey AS "k" FROM orders WHERE o_totalprice > ? AND o_orderstatus != ?', [120000.5, "F"])


@query("SELECT l_orderkey AS k, l_linenumber AS n, CAST(l_partkey // 7 AS BIGINT) AS d, CAST(l_partkey % 7 AS BIGINT) AS m, (l_partkey % 2 = 0) <> (l_suppkey % 2 = 0) AS x FROM lineitem")
def sql_keyword_operators(t: Tables) -> DataFrame:
    """DIV, MOD and XOR as words."""
    e = Engine(t.spark).register_folder(t.sf_dir, "lineitem")
    return e.query('SELECT l_orderkey AS "k", l_linenumber AS "n", l_partkey DIV 7 AS "d", l_partkey MOD 7 AS "m", (l_partkey MOD 2 = 0) XOR (l_suppkey MOD 2 = 0) AS "x" FROM lineitem')


@query("SELECT 'never' AS what, count(*) AS n FROM (SELECT 1 WHERE FALSE) UNION ALL SELECT 'other aggregate', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) > 100000) UNION ALL SELECT 'scalar', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING max(o_totalprice) > (SELECT avg(o_totalprice) FROM orders))")
def sql_having_rules(t: Tables) -> DataFrame:
    """HAVING of a constant, of an aggregate that is not selected and of a scalar subquery."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    texts = {
        "never": "SELECT COUNT(*) AS c FROM orders HAVING FALSE",
        "other aggregate": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > 100000",
        "scalar": "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING MAX(o_totalprice) > (SELECT AVG(o_totalprice) FROM orders)",
    }
    counts = [e.query(text).select(F.lit(what).alias("what")) for what, text in texts.items()]
    found = counts[0].union(counts[1]).union(counts[2]).groupBy("what").agg(F.count("*").alias("n"))
    every = t.spark.createDataFrame([(what,) for what in texts], "what string")
    return every.join(found, "what", "left").select("what", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT 'small' = 'small ' AS padded, 'a' = 'A' AS folded, 'Z' < 'a' AS ordered, count(*) AS n FROM part WHERE p_name >= 'b' AND p_name < 'm'")
def sql_text_comparison(t: Tables) -> DataFrame:
    """Strings compare by code points: no padding, no folding."""
    e = Engine(t.spark).register_folder(t.sf_dir, "part")
    return e.query("""SELECT 'small' = 'small ' AS "padded", 'a' = 'A' AS "folded", 'Z' < 'a' AS "ordered", COUNT(*) AS "n" FROM part WHERE p_name >= 'b' AND p_name < 'm'""")


@query("SELECT count(*) + 2 * count(*) FILTER (o_orderstatus = 'F') AS changed, count(*) - count(*) FILTER (o_orderstatus = 'F') AS kept FROM orders")
def dml_batch_counts(t: Tables) -> DataFrame:
    """A batch of statements: each is published by itself, their affected rows add up."""
    e = engine(t)
    n = e.execute(f"{FILL}; UPDATE copy SET price = 0.0 - k WHERE status = 'F'; DELETE FROM copy WHERE status = 'F'")
    kept = e.query('SELECT COUNT(*) AS "kept" FROM copy')
    return kept.select(F.lit(n).cast("long").alias("changed"), "kept")


@query("SELECT o_orderkey AS k, NULL::VARCHAR AS code FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'c' || o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def dml_unique_nulls(t: Tables) -> DataFrame:
    """A unique index takes any number of nulls, and an update to a row's own value."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders")
    e.execute("CREATE DATABASE /d; CREATE SCHEMA TEMPLATE o CREATE TABLE coded (k BIGINT NOT NULL, code STRING, PRIMARY KEY (k)) CREATE UNIQUE INDEX by_code ON coded (code); CREATE SCHEMA /d/s WITH TEMPLATE o")
    e.schema.tables["CODED"] = e.databases["/D"]["S"].tables["CODED"]
    e.execute("INSERT INTO coded SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN CONCAT('c', o_orderkey) END FROM orders; UPDATE coded SET code = code")
    return e.query('SELECT k AS "k", code AS "code" FROM coded')


@query("SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'O'")
def sink_partitioned(t: Tables) -> DataFrame:
    """A sink in folders by status; reading one status prunes the others."""
    path = f"{sources.shared_dir(t.spark)}/quern/sink-{uuid.uuid4().hex}"
    sources.write(t.orders.select("o_orderkey", "o_orderstatus"), path, ["o_orderstatus"])
    return t.spark.read.parquet(path).where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))


@query("SELECT CAST(0.1::FLOAT AS DOUBLE) AS f, 0.1::DOUBLE AS d")
def sql_float_precision(t: Tables) -> DataFrame:
    """FLOAT keeps 32 bits."""
    e = Engine(t.spark)
    e.execute("CREATE DATABASE /d; CREATE SCHEMA TEMPLATE o CREATE TABLE n (k BIGINT NOT NULL, f FLOAT, d DOUBLE, PRIMARY KEY (k)); CREATE SCHEMA /d/s WITH TEMPLATE o")
    e.use("/d", "s").execute("INSERT INTO n VALUES (1, 0.1, 0.1)")
    return e.query('SELECT CAST(f AS DOUBLE) AS "f", d AS "d" FROM n')
