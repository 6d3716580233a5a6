"""Data changes: each query makes tables, changes them and returns what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quern.errors import SQLError
from quern.plans.engine import Engine
from quern.queries.registry import Tables, query


def engine(t: Tables) -> Engine:
    """An engine with an empty table (k, status, price) beside the test tables."""
    e = Engine(t.spark).register_folder(t.sf_dir, "orders", "customer")
    e.execute("CREATE DATABASE /d")
    e.execute("CREATE SCHEMA TEMPLATE o CREATE TABLE copy (k BIGINT NOT NULL, status STRING, price DOUBLE, PRIMARY KEY (k)) CREATE UNIQUE INDEX by_key ON copy (k, price)")
    e.execute("CREATE SCHEMA /d/s WITH TEMPLATE o")
    e.schema.tables["COPY"] = e.databases["/D"]["S"].tables["COPY"]
    return e


def result(e: Engine) -> DataFrame:
    """What RETURNING asked for."""
    return e.last_returning


FILL = "INSERT INTO copy SELECT o_orderkey, o_orderstatus, o_totalprice + o_orderkey FROM orders"
COPY = "SELECT o_orderkey AS k, o_orderstatus AS status, round(o_totalprice + o_orderkey, 2) AS price FROM orders"
READ = 'SELECT k AS "k", status AS "status", ROUND(price, 2) AS "price" FROM copy'


@query(COPY)
def dml_insert_select(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    return e.query(READ)


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', 1.5::DOUBLE), (2, NULL, 3.0), (3, 'c', NULL)) v(k, status, price)")
def dml_insert_values(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute("INSERT INTO copy (k, status, price) VALUES (1, 'a', 1.5), (1 + 1, NULL, 3); INSERT INTO copy (k, status) VALUES (3, 'c')")
    return e.query(READ)


@query(f"SELECT k, CASE WHEN status = 'F' THEN 'done' ELSE status END AS status, CASE WHEN k % 3 = 0 THEN round(price * 2, 2) ELSE price END AS price FROM ({COPY})")
def dml_update_case(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("UPDATE copy SET status = CASE WHEN status = 'F' THEN 'done' ELSE status END")
    e.execute("UPDATE copy SET price = price * 2 WHERE k % 3 = 0")
    return e.query(READ)


@query(f"SELECT * FROM ({COPY}) WHERE NOT (status = 'O' AND k > 50)")
def dml_delete_where(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("DELETE FROM copy WHERE status = 'O' AND k > 50")
    return e.query(READ)


@query(f"SELECT * FROM ({COPY}) WHERE k NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 150000)")
def dml_delete_exists(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("DELETE FROM copy WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = copy.k AND o.o_totalprice > 150000)")
    return e.query(READ)


@query(COPY)
def dml_rollback(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("START TRANSACTION; DELETE FROM copy; INSERT INTO copy VALUES (1, 'x', 0.5); ROLLBACK")
    return e.query(READ)


@query(COPY)
def dml_dry_run(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("DELETE FROM copy WHERE k > 0 OPTIONS (DRY RUN)")
    return e.query(READ)


@query("SELECT * FROM (VALUES ('23502'), ('23505'), ('42601'), ('42703'), ('22000')) v(state)")
def dml_constraints(t: Tables) -> DataFrame:
    """The codes of statements that break a rule; none of them leaves a trace."""
    e = engine(t)
    e.execute("INSERT INTO copy VALUES (1, 'a', 1.0)")
    states = []
    for text in ("INSERT INTO copy (status) VALUES ('x')", "INSERT INTO copy VALUES (2, 'b', 2.0), (1, 'b', 3.0)", "INSERT INTO copy VALUES (2)", "UPDATE copy SET nope = 1", "INSERT INTO copy VALUES (2, 5, 2.0)"):
        try:
            e.execute(text)
        except SQLError as error:
            states.append((error.state,))
    if e.rows("SELECT COUNT(*) FROM copy") != [(1,)]:
        states.append(("changed",))
    return t.spark.createDataFrame(states, "state string")


@query("SELECT * FROM (VALUES ('K', 'BIGINT', 'NO'), ('STATUS', 'STRING', 'YES'), ('PRICE', 'DOUBLE', 'YES')) v(name, type, nullable)")
def catalog_columns(t: Tables) -> DataFrame:
    return engine(t).query("SELECT column_name AS \"name\", data_type AS \"type\", is_nullable AS \"nullable\" FROM information_schema.columns WHERE table_name = 'COPY' AND table_catalog = '/D'")


@query(f"SELECT k, round(price * 2, 2) AS doubled FROM ({COPY}) WHERE k % 3 = 0")
def dml_returning(t: Tables) -> DataFrame:
    """Rows that a DELETE over several parts of a table removes, projected."""
    e = engine(t)
    e.execute(FILL + " WHERE o_orderkey % 2 = 0")
    e.execute(FILL + " WHERE o_orderkey % 2 = 1")
    e.execute('DELETE FROM copy WHERE k % 3 = 0 RETURNING k AS "k", ROUND(price * 2, 2) AS "doubled"')
    return result(e)


@query(f"SELECT k, round(price + 1, 2) AS price FROM ({COPY}) WHERE status = 'F'")
def dml_update_returning(t: Tables) -> DataFrame:
    e = engine(t)
    e.execute(FILL)
    e.execute("UPDATE copy SET price = price + 1 WHERE status = 'F' RETURNING k AS \"k\", ROUND(price, 2) AS \"price\"")
    return result(e)


@query(f"SELECT count(*) AS n, (SELECT count(*) FROM ({COPY})) AS parts FROM ({COPY})")
def dml_many_inserts(t: Tables) -> DataFrame:
    """Twelve INSERTs: their parts are merged as they come."""
    e = engine(t)
    for i in range(12):
        e.execute(FILL + f" WHERE o_orderkey % 12 = {i}")
    assert len(e.schema.tables["COPY"].parts) < 12
    return e.query('SELECT COUNT(*) AS "n", (SELECT COUNT(*) FROM copy) AS "parts" FROM copy')


@query("SELECT * FROM (VALUES ('inside', 3::BIGINT), ('meanwhile', 2), ('after', 3), ('lost', 40001), ('undone', 3)) v(what, n)")
def transaction_isolation(t: Tables) -> DataFrame:
    """Two sessions over one catalog: what one has not committed the other does not see; of two changes to one table the later commit fails."""
    a = engine(t)
    b = a.session()
    n = lambda e: e.rows("SELECT COUNT(*) FROM copy")[0][0]
    a.execute("INSERT INTO copy VALUES (1, 'a', 1.0), (2, 'b', 2.0)")
    a.execute("START TRANSACTION; INSERT INTO copy VALUES (3, 'c', 3.0)")
    out = [("inside", n(a)), ("meanwhile", n(b))]
    a.execute("COMMIT")
    out.append(("after", n(b)))
    a.execute("START TRANSACTION; DELETE FROM copy")
    b.execute("UPDATE copy SET status = 'z'")
    try:
        a.execute("COMMIT")
    except SQLError as error:
        out.append(("lost", int(error.state)))
    a.execute("START TRANSACTION; DROP SCHEMA /d/s; ROLLBACK")
    return t.spark.createDataFrame([*out, ("undone", len(a.databases["/D"]["S"].tables) + 2)], "what string, n long")
