import math

import pytest

from quern.errors import SQLError
from quern.plans.engine import Engine


@pytest.fixture(scope="module")
def db(spark):
    e = Engine(spark)
    e.execute("CREATE DATABASE /testdb")
    e.execute("""CREATE SCHEMA TEMPLATE t1
        CREATE TABLE t (id BIGINT NOT NULL, a BIGINT, b BIGINT, f DOUBLE, s STRING, flag BOOLEAN, PRIMARY KEY (id))
        CREATE TABLE kid (id BIGINT NOT NULL, parent BIGINT, PRIMARY KEY (id))
        CREATE TABLE u (id BIGINT NOT NULL, code STRING, n INTEGER, PRIMARY KEY (id))
        CREATE UNIQUE INDEX u_code ON u (code)""")
    e.execute("CREATE SCHEMA /testdb/s WITH TEMPLATE t1")
    e.use("/testdb", "s")
    e.execute("INSERT INTO t (id, a, b, f, s, flag) VALUES (1, 6, 2, 1.5, 'x%y', TRUE), (2, 4, 0, 0.0, 'b', FALSE), (3, NULL, 3, NULL, NULL, NULL)")
    e.execute("INSERT INTO kid VALUES (1, NULL), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3)")
    return e


def one(db, expr, where="id = 1"):
    return db.rows(f"SELECT {expr} FROM t WHERE {where}")[0][0]


# Results that the dialect's own tests pin.
@pytest.mark.parametrize(
    ("expr", "want"),
    [
        ("2 + 3 * 4", 20), ("2 + (3 * 4)", 14), ("6 & 3 | 1", 3), ("6 | 1 & 3", 3), ("6 + 1 & 3", 7), ("6 ^ 3", 5), ("7 DIV 2", 3), ("7 MOD 3", 1), ("7 / 2", 3), ("-7 / 2", -3), ("-5 % 3", -2), ("7.0 / 2", 3.5),
        ("TRUE XOR TRUE", False), ("TRUE OR TRUE AND FALSE", False), ("NOT FALSE AND TRUE", True), ("'a' + 'b'", "ab"), ("CONCAT('a', NULL, 'b')", "ab"), ("GREATEST(1, NULL, 3)", None), ("LEAST(3, 1, 2)", 1),
        ("CAST(2.5 AS BIGINT)", 3), ("CAST(-2.5 AS BIGINT)", -2), ("CAST(' 12 ' AS BIGINT)", 12), ("CAST('true' AS BOOLEAN)", True), ("CAST(1 AS BOOLEAN)", True), ("COALESCE(NULL, 5)", 5), ("REPLACE('abc', 'b', NULL)", "ac"),
        ("SUBSTRING('hello', 2, 3)", "ell"), ("POSITION('l', 'hello')", 3), ("LENGTH('é')", 1), ("OCTET_LENGTH('é')", 2), ("ROUND(2.5)", 3.0), ("ROUND(125, -1)", 130), ("FLOOR(-1.5)", -2.0), ("LOG(2, 8)", 3.0), ("CARDINALITY([1, 2])", 2), ("[5, 6][2]", 6),
        ("CASE a WHEN 6 THEN 'six' ELSE 'no' END", "six"), ("CASE WHEN a > 100 THEN 1 ELSE 2.5 END", 2.5), ("a = 6 AND s LIKE 'x%'", True), ("s LIKE 'x!%y' ESCAPE '!'", True), ("'x.y' LIKE 'x_y'", True), ("'xzy' LIKE 'x.y'", False), ("'a%b' LIKE CONCAT('a', '!%', 'b') ESCAPE '!'", True), ("'axb' LIKE CONCAT('a', '!%', 'b') ESCAPE '!'", False), ("'a!b' LIKE CONCAT('a!!', 'b') ESCAPE '!'", True), ("'a' + s LIKE 'a' + s", True), ("CONCAT('a', '%') LIKE CONCAT('a', '|%') ESCAPE '|'", True), ("'x' LIKE CONCAT('!', 'x') ESCAPE '!'", True), ("MOD(7, 3)", 1), ("MOD(7.5, 2)", 1.5), ("5 BETWEEN 9 AND 1", False), ("a IS DISTINCT FROM NULL", True),
    ],
)
def test_expressions(db, expr, want):
    got = one(db, expr)
    assert got == pytest.approx(want) if isinstance(want, float) else got == want


def test_ieee_division(db):
    assert math.isinf(one(db, "1.0 / 0.0")) and math.isnan(one(db, "0.0 / 0.0"))
    assert math.isnan(one(db, "MOD(5.0, 0.0)")) and math.isnan(one(db, "5.0 % 0.0")) and math.isinf(one(db, "LOG(1, 8)"))


# The codes that the dialect's own tests pin.
@pytest.mark.parametrize(
    ("sql", "state"),
    [
        ("SELECT 1", "0AF00"), ("SELECT -(a) FROM t", "42601"), ("SELECT a <=> b FROM t", "42601"), ("SELECT 6 >> 1 FROM t", "42883"), ("SELECT id FROM t WHERE a = '5'", "42804"), ("SELECT id FROM t WHERE 's' || 't' = 'st'", "42804"), ("SELECT id FROM t WHERE a IN (1, NULL)", "42809"),
        ("SELECT id FROM t WHERE a IN ()", "42601"), ("SELECT id FROM t WHERE a IN (SELECT a FROM t)", "0AF00"), ("SELECT id FROM t WHERE (a, b) = (1, 2)", "0AF00"), ("SELECT nope FROM t", "42703"), ("SELECT id FROM nope", "42F01"), ("SELECT id FROM t x, t y", "42702"), ("SELECT NOW() FROM t", "42883"),
        ("SELECT a, COUNT(*) FROM t", "42803"), ("SELECT a, b FROM t GROUP BY a", "42803"), ("SELECT COUNT(DISTINCT a) FROM t", "0A000"), ("SELECT MAX(s) FROM t", "42804"), ("SELECT SUM(SUM(a)) FROM t", "0A000"), ("SELECT ROW_NUMBER() OVER (ORDER BY a) FROM t", "42883"), ("SELECT a FROM t UNION SELECT b FROM t", "0AF00"),
        ("SELECT a FROM t UNION ALL SELECT a, b FROM t", "42F64"), ("SELECT a FROM t UNION ALL SELECT s FROM t", "42F65"), ("SELECT a FROM t INTERSECT SELECT b FROM t", "42601"), ("SELECT a FROM t ORDER BY 3", "22023"), ("SELECT a FROM t ORDER BY a, a", "42701"), ("SELECT a FROM t LIMIT -1", "42601"), ("SELECT a AS x FROM t GROUP BY x", "42703"),
        ("SELECT SQRT(a - 100) FROM t WHERE id = 1", "22023"), ("SELECT a / b FROM t WHERE id = 2", "22012"), ("SELECT 9223372036854775807 + 1 FROM t", "22003"), ("SELECT CAST('x' AS BIGINT) FROM t", "22F3H"), ("SELECT CAST('yes' AS BOOLEAN) FROM t", "22F3H"), ("SELECT NULLIF(a, b) FROM t", "42883"), ("SELECT id FROM t WHERE a ILIKE 'x'", "42601"),
        ("SELECT id FROM t WHERE a = (SELECT a FROM t)", "21000"), ("SELECT (SELECT a, b FROM t) FROM t", "42601"), ("SELECT id FROM t WHERE a IS UNKNOWN", "42601"), ("WITH RECURSIVE r AS (SELECT id FROM t) SELECT * FROM r", "0A000"), ("SELECT TRIM(BOTH 'x' FROM s) FROM t", "0AF00"), ("SELECT id FROM t GROUP BY 7", "22023"), ("SELECT id FROM t OFFSET 2", "42601"), ("SELECT wrong.* FROM t", "42F01"), ("SELECT x'0' FROM t", "22F03"), ("SELECT COUNT(*) FROM t GROUP BY a AS x, b AS x", "42702"), ("SELECT id WHERE id = 2 FROM t", "42601"), ("SELECT 1e400 FROM t", "22003"), ("SELECT id FROM t WHERE s LIKE CONCAT('x', '!') ESCAPE '!'", "22023"), ("SELECT MOD(a, 0) FROM t", "22012"), ("EXPLAIN SELECT nope FROM t", "42703"), ("WITH c (x, y) AS (SELECT id FROM t) SELECT x FROM c", "42F10"), ("WITH c AS (SELECT id FROM t), c AS (SELECT a FROM t) SELECT * FROM c", "42712"),
    ],
)
def test_errors(db, sql, state):
    with pytest.raises(SQLError) as e:
        db.rows(sql)
    assert e.value.state == state


def test_kleene_and_joins(db):
    assert db.rows("SELECT id FROM t WHERE NOT (a = 4)") == [(1,)]
    assert db.rows("SELECT id FROM t WHERE flag") == [(1,)]
    assert sorted(db.rows("SELECT p.id, c.id FROM kid p JOIN kid c ON c.parent = p.id")) == [(1, 2), (1, 3), (2, 4), (2, 5), (3, 6)]
    assert len(db.rows("SELECT * FROM kid a LEFT JOIN kid b ON a.id = b.parent WHERE b.id IS NULL")) == 3
    assert sorted(db.rows("SELECT id FROM kid k WHERE NOT EXISTS (SELECT 1 FROM kid c WHERE c.parent = k.id)")) == [(4,), (5,), (6,)]
    assert sorted(db.rows("SELECT id, EXISTS (SELECT 1 FROM kid c WHERE c.parent = k.id) FROM kid k")) == [(1, True), (2, True), (3, True), (4, False), (5, False), (6, False)]
    assert db.rows("SELECT COUNT(*), COUNT(a), SUM(a), AVG(a), COUNT(NULL) FROM t") == [(3, 2, 10, 5.0, 3)]
    assert db.query("SELECT id, \"a\" FROM (SELECT id, a AS \"a\" FROM t) d").columns == ["ID", "a"]
    assert db.rows("SELECT id FROM t WHERE id = ? AND s = ?", [1, "x%y"]) == [(1,)]


def test_order_and_limits(db):
    assert db.rows("SELECT a FROM t ORDER BY a") == [(None,), (4,), (6,)]
    assert db.rows("SELECT a FROM t ORDER BY a DESC") == [(6,), (4,), (None,)]
    assert db.rows("SELECT a AS z FROM t ORDER BY z DESC NULLS FIRST LIMIT 2 OFFSET 1") == [(6,), (4,)]
    assert db.rows("SELECT parent FROM kid GROUP BY parent HAVING SUM(id) > 2 ORDER BY SUM(id) * 2 DESC") == [(2,), (3,), (1,)]
    assert db.rows("SELECT b FROM t ORDER BY b + 1, b + 1") == [(0,), (2,), (3,)] and db.rows("SELECT GREATEST(a) FROM t WHERE id = 1") == [(6,)]
    assert db.rows("SELECT id FROM t WHERE id = 1 AND b64'yv4=' = x'cafe'") == [(1,)]
    assert db.rows("SELECT COUNT(NULLIF(a, 6)), SUM(NULLIF(b, 0)) FROM t") == [(1, 5)]
    assert db.rows("SELECT up, COUNT(*) FROM kid GROUP BY parent AS up ORDER BY up") == [(None, 1), (1, 2), (2, 2), (3, 1)]
    assert db.rows("SELECT CURRENT_TIMESTAMP = LOCALTIME, CURRENT_USER, YEAR(CURRENT_DATE) > 2000, CURRENT_DATE IS NULL FROM t WHERE id = 1") == [(True, "", True, False)]
    assert db.rows("SELECT DISTINCT x.a FROM t AS x ORDER BY x.a DESC") == [(6,), (4,), (None,)]
    assert db.rows("SELECT parent, COUNT(*) FROM kid GROUP BY parent HAVING COUNT(*) > 1 ORDER BY COUNT(*) DESC, parent") == [(1, 2), (2, 2)]


def test_recursion(db):
    walk = "WITH RECURSIVE r AS (SELECT id, parent FROM kid WHERE parent IS NULL UNION ALL SELECT c.id, c.parent FROM kid c JOIN r ON c.parent = r.id) {} SELECT id FROM r"
    down = "WITH RECURSIVE r AS (SELECT id, parent FROM kid WHERE parent IS NULL UNION ALL SELECT c.id, c.parent FROM kid c JOIN r ON c.parent = r.id) TRAVERSAL ORDER {} SELECT id FROM r"
    assert sorted(db.rows(walk.format(""))) == [(i,) for i in range(1, 7)]
    assert db.rows(down.format("pre_order")) == [(1,), (2,), (4,), (5,), (3,), (6,)]
    assert db.rows(down.format("post_order")) == [(4,), (5,), (2,), (6,), (3,), (1,)]
    assert sorted(db.rows("WITH RECURSIVE r AS (SELECT 1 AS n FROM t WHERE id = 1 UNION SELECT 1 + n % 3 FROM r) SELECT n FROM r")) == [(0,), (1,), (2,)]  # (1 + n) % 3
    assert db.rows("WITH c (x, y) AS (SELECT id, a FROM t), d AS (SELECT x FROM c WHERE y > 4) SELECT x FROM d") == [(1,)]


def test_changes(db):
    assert db.execute("INSERT INTO u VALUES (1, 'a', 10), (2, NULL, 20), (3, NULL, 30)") == 3
    for sql, state in [("INSERT INTO u VALUES (1, 'z', 1)", "23505"), ("INSERT INTO u VALUES (9, 'a', 1)", "23505"), ("INSERT INTO u (code) VALUES ('q')", "23502"), ("INSERT INTO u VALUES (9, 'q', 3000000000)", "22003"), ("INSERT INTO u VALUES (9, 5, 1)", "22000"), ("INSERT INTO u VALUES (9, 'q', 1.5)", "22000"), ("INSERT INTO u VALUES (9, 'q')", "42601"), ("UPDATE u SET nope = 1", "42703"), ("UPDATE u SET id = 9", "0A000"), ("UPDATE u SET code = 'a' WHERE id > 1", "23505"), ("UPDATE u SET n = DEFAULT", "0AF00"), ("DELETE FROM u LIMIT 1", "0AF00"), ("SELECT id FROM u", "0A000")]:
        with pytest.raises(SQLError) as e:
            db.execute(sql)
        assert e.value.state == state, sql
    assert sorted(db.rows("SELECT * FROM u")) == [(1, "a", 10), (2, None, 20), (3, None, 30)]
    assert db.execute("UPDATE u SET n = n + 1, code = CASE WHEN id = 2 THEN 'b' ELSE code END WHERE n >= 20") == 2
    assert db.execute("DELETE FROM u WHERE id = 3 OPTIONS (DRY RUN)") == 1 and len(db.rows("SELECT id FROM u")) == 3
    db.execute("START TRANSACTION; DELETE FROM u; ROLLBACK")
    assert sorted(db.rows("SELECT id, code, n FROM u")) == [(1, "a", 10), (2, "b", 21), (3, None, 31)]
    assert db.execute("WITH big AS (SELECT id FROM u WHERE n > 20) DELETE FROM u WHERE EXISTS (SELECT 1 FROM big WHERE big.id = u.id)") == 2
    assert db.execute("INSERT INTO u SELECT id + 10, s, 7 FROM t") == 3
    assert db.execute("INSERT INTO u VALUES (20, 'sum', 1 + 1)") == 1 and db.execute("DELETE FROM u WHERE id = 20") == 1
    assert db.execute("DELETE FROM u WHERE id > 10; INSERT INTO u VALUES (5, 'e', 5)") == 4
    assert sorted(db.rows("SELECT id FROM u")) == [(1,), (5,)]


def test_catalog(db):
    assert ("/TESTDB", "S", "U", "CODE", "STRING", "YES", 2) in db.rows("SELECT * FROM INFORMATION_SCHEMA.COLUMNS")
    assert ("T1",) in db.rows("SHOW SCHEMA TEMPLATES") and ("/TESTDB",) in db.rows("SHOW DATABASES")
    with pytest.raises(SQLError) as e:
        db.execute("CREATE DATABASE /testdb")
    assert e.value.state == "42F04"


def test_qualify_and_vectors(spark):
    e = Engine(spark)
    e.register("docs", spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "a", [0.0, 1.0]), (3, "b", [0.9, 0.1]), (4, "b", [5.0, 5.0])], "id long, zone string, v array<double>"))
    assert sorted(e.rows("SELECT id FROM docs QUALIFY ROW_NUMBER() OVER (ORDER BY euclidean_distance(v, [1.0, 0.0])) <= 2")) == [(1,), (3,)]
    assert sorted(e.rows("SELECT id FROM docs QUALIFY ROW_NUMBER() OVER (PARTITION BY zone ORDER BY euclidean_distance(v, [1.0, 0.0])) < 2")) == [(1,), (3,)]
    assert e.rows("SELECT id FROM docs WHERE zone = 'b' QUALIFY ROW_NUMBER() OVER (ORDER BY cosine_distance(v, [0.0, 1.0])) = 1") == [(4,)]
    assert e.rows("SELECT id FROM docs QUALIFY ROW_NUMBER() OVER (ORDER BY euclidean_distance(v, [1.0, 0.0])) <= 0") == []


def test_unnest(spark):
    e = Engine(spark)
    e.register("o", spark.createDataFrame([(1, [7, 8]), (2, [])], "id long, items array<long>"))
    assert sorted(e.rows("SELECT o.id, x, i FROM o, o.items AS x AT i")) == [(1, 7, 1), (1, 8, 2)]


def test_views_and_functions(db):
    db.execute("CREATE VIEW v AS SELECT id AS k, a + 1 AS x FROM t WHERE a > 0; CREATE FUNCTION twice (IN n BIGINT) RETURNS BIGINT AS n * 2; CREATE FUNCTION from_id (low BIGINT) AS SELECT id, s FROM t WHERE id >= low")
    assert sorted(db.rows("SELECT k, twice(x) FROM v")) == [(1, 14), (2, 10)]
    assert sorted(db.rows("SELECT f.id FROM from_id(2) f")) == [(2,), (3,)] and db.rows("SELECT id FROM t WHERE twice(id) = 4") == [(2,)]
    for sql, state in [("CREATE VIEW v AS SELECT id FROM t", "42F07"), ("CREATE VIEW w AS SELECT nope FROM t", "42703"), ("CREATE FUNCTION twice (n BIGINT) RETURNS BIGINT AS n", "42723"), ("CREATE FUNCTION @@@", "42601"), ("DROP VIEW w", "42F01")]:
        with pytest.raises(SQLError) as e:
            db.execute(sql)
        assert e.value.state == state, sql
    for sql, state in [("SELECT twice(1, 2) FROM t", "42601"), ("SELECT twice('x') FROM t", "42804")]:
        with pytest.raises(SQLError) as e:
            db.rows(sql)
        assert e.value.state == state, sql
    with pytest.raises(SQLError) as e:
        db.execute("CREATE VIEW p AS SELECT id FROM t WHERE id = ?", [1])
    assert e.value.state == "42601"
    db.execute("DROP VIEW v; DROP FUNCTION twice; DROP FUNCTION from_id")
    with pytest.raises(SQLError):
        db.rows("SELECT k FROM v")


def test_explain_and_fingerprints(db):
    assert "Scan" in db.explain("SELECT id FROM t WHERE a > 1") and db.query("EXPLAIN SELECT id FROM t").columns == ["PLAN"]
    assert db.plan_hash("SELECT id FROM t WHERE a > 1") == db.plan_hash("select ID from T where (a > 1)") != db.plan_hash("SELECT id FROM t WHERE a > 2")


def test_sessions_and_definitions_in_transactions(spark):
    a = Engine(spark)
    a.execute("CREATE DATABASE /x; CREATE SCHEMA TEMPLATE m CREATE TABLE t (id BIGINT NOT NULL, PRIMARY KEY (id)) CREATE VIEW big AS SELECT id FROM t WHERE id > 1; CREATE SCHEMA /x/s WITH TEMPLATE m")
    a.use("/x", "s")
    b = a.session().use("/x", "s")
    a.execute("INSERT INTO t VALUES (1), (2)")
    a.execute("START TRANSACTION; DROP SCHEMA /x/s; CREATE SCHEMA /x/other WITH TEMPLATE m")
    assert b.rows("SELECT COUNT(*) FROM t") == [(2,)] and b.rows("SELECT id FROM big") == [(2,)]
    a.execute("ROLLBACK")
    assert a.rows("SELECT COUNT(*) FROM t") == [(2,)] and set(a.databases["/X"]) == {"S"}
    a.execute("START TRANSACTION; CREATE SCHEMA /x/other WITH TEMPLATE m; DELETE FROM t WHERE id = 1")
    assert b.rows("SELECT COUNT(*) FROM t") == [(2,)]
    a.execute("COMMIT")
    assert b.rows("SELECT id FROM t") == [(2,)] and set(b.databases["/X"]) == {"S", "OTHER"}
    a.execute("START TRANSACTION; DELETE FROM t")
    b.execute("INSERT INTO t VALUES (7)")
    with pytest.raises(SQLError) as e:
        a.execute("COMMIT")
    assert e.value.state == "40001" and sorted(a.rows("SELECT id FROM t")) == [(2,), (7,)]


def test_returning_and_many_parts(spark):
    e = Engine(spark)
    e.execute("CREATE DATABASE /r; CREATE SCHEMA TEMPLATE m CREATE TABLE t (id BIGINT NOT NULL, n BIGINT, PRIMARY KEY (id)); CREATE SCHEMA /r/s WITH TEMPLATE m")
    e.use("/r", "s")
    for i in range(12):
        e.execute(f"INSERT INTO t VALUES ({i}, {i * 10}) RETURNING id")
        assert [tuple(r) for r in e.last_returning.collect()] == [(i,)]
    assert len(e.schema.tables["T"].parts) < 12 and e.rows("SELECT COUNT(*), SUM(n) FROM t") == [(12, 660)]
    e.execute("UPDATE t SET n = n + 1 WHERE id >= 9 RETURNING id, n + 1 AS m")
    assert sorted(map(tuple, e.last_returning.collect())) == [(9, 92), (10, 102), (11, 112)]
    assert e.execute("DELETE FROM t WHERE id % 2 = 0 RETURNING n") == 6
    assert sorted(r[0] for r in e.last_returning.collect()) == [0, 20, 40, 60, 80, 101]
    with pytest.raises(SQLError) as x:
        e.execute("INSERT INTO t VALUES (3, 1)")
    assert x.value.state == "23505"


def test_vector_index(spark):
    e = Engine(spark)
    e.execute("CREATE DATABASE /v; CREATE SCHEMA TEMPLATE m CREATE TABLE d (id BIGINT NOT NULL, v DOUBLE ARRAY, PRIMARY KEY (id)) CREATE VECTOR INDEX near USING HNSW ON d (v); CREATE SCHEMA /v/s WITH TEMPLATE m")
    e.use("/v", "s")
    e.execute("INSERT INTO d VALUES (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [5.0, 5.0])")
    first = e.vector_index("near")
    assert [r["id" if "id" in r else "ID"] for r in first.search([1.0, 0.0], 2, probes=8, epsilon=9.0).orderBy("row_number").collect()] == [1, 3]
    assert e.vector_index("near") is first
    e.execute("INSERT INTO d VALUES (5, [1.0, 0.01])")
    assert [r["ID"] for r in e.vector_index("near").search([1.0, 0.0], 2, probes=8, epsilon=9.0).orderBy("row_number").collect()] == [1, 5]
