"""The SQL engine: a catalog of versioned tables, queries in the dialect, and data changes with their constraints.

A table is a list of parts (scans over files in the shared folder). INSERT adds a part; UPDATE and DELETE rewrite only the parts that hold
affected rows. A statement checks everything before it publishes, so it happens as a whole or not at all; a transaction keeps
a private copy of the part lists.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.errors import SQLError, of_spark
from quern.operators import recursive as rec
from quern.operators import vectors
from quern.operators.indexes import running
from quern.plans import syntax as S
from quern.plans.binder import INTEGERS, Binder, Column, Expr, Scope, Table, family, q, spark_type
from quern.sources.tables import cut


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@dataclass
class Stored:
    """A table's definition and its current parts."""

    name: str
    columns: list[tuple[str, str, bool]]
    pk: list[str]
    unique: list[list[str]] = field(default_factory=list)
    parts: list[DataFrame] = field(default_factory=list)
    version: int = 0

    def frame(self, spark: SparkSession) -> DataFrame:
        if not self.parts:
            return spark.createDataFrame([], ", ".join(f"{q(n)} {spark_type(k)}" for n, k, _ in self.columns))
        return union(self.parts)


@dataclass
class Schema:
    template: str
    tables: dict[str, Stored]
    indexes: list[dict] = field(default_factory=list)
    views: dict[str, S.Query] = field(default_factory=dict)
    functions: dict[str, dict] = field(default_factory=dict)


@dataclass
class Catalog:
    """What sessions share: databases with their schemas, and schema templates."""

    databases: dict[str, dict[str, Schema]] = field(default_factory=lambda: {"/": {"S": Schema("", {})}})
    templates: dict[str, dict] = field(default_factory=dict)

    def copy(self) -> tuple[Catalog, dict[int, tuple[Stored, Stored]]]:
        """A private copy for a transaction, and (shared, private) of every table by the private one's identity."""
        own: dict[int, Stored] = {}

        def table(t: Stored) -> Stored:  # a table that stands in two schemas stays one
            if id(t) not in own:
                own[id(t)] = replace(t, parts=list(t.parts))
            return own[id(t)]

        shared = {id(t): t for ss in self.databases.values() for x in ss.values() for t in x.tables.values()}
        databases = {d: {s: replace(x, tables={n: table(t) for n, t in x.tables.items()}, indexes=list(x.indexes), views=dict(x.views), functions=dict(x.functions)) for s, x in ss.items()} for d, ss in self.databases.items()}
        return Catalog(databases, dict(self.templates)), {id(mine): (shared[k], mine) for k, mine in own.items()}


SPARK_ERRORS = (PySparkException, Py4JJavaError)
KINDS = {"timestamp": "timestamp_ntz"}


#: Parts of at most so many rows are merged once a table has more than MANY of them.
SMALL, MANY = 1_000_000, 8


class Engine:
    """One session: ``query`` for SELECT and EXPLAIN, ``execute`` for the rest, ``rows`` for results with the dialect's errors.

    Sessions made by ``session`` share a catalog. A transaction works on a private copy of it; COMMIT publishes the tables
    it has changed, and fails with 40001 if another session has changed one of them meanwhile.
    """

    def __init__(self, spark: SparkSession, strict: bool = True, catalog: Catalog | None = None):
        self.spark, self.strict = spark, strict
        if spark.conf.get("spark.sql.ansi.enabled") != "true":  # Spark's default; the dialect's errors rest on it
            spark.conf.set("spark.sql.ansi.enabled", "true")
        self.shared = catalog or Catalog()
        self.private: Catalog | None = None
        self.copies: dict[int, tuple[Stored, Stored]] = {}
        self.began: dict[int, int] = {}
        self.at = ("/", "S")
        self.last_returning: DataFrame | None = None
        self.built: dict[tuple, tuple] = {}

    def session(self) -> Engine:
        """Another session over the same catalog."""
        return Engine(self.spark, self.strict, self.shared)

    @property
    def databases(self) -> dict[str, dict[str, Schema]]:
        return (self.private or self.shared).databases

    @property
    def templates(self) -> dict[str, dict]:
        return (self.private or self.shared).templates

    # catalog

    @property
    def schema(self) -> Schema:
        return self.databases[self.at[0]][self.at[1]]

    def use(self, database: str, schema: str) -> Engine:
        d, s = database.upper(), schema.upper()
        if s not in self.databases.get(d, {}):
            raise SQLError("42F01", f"{database}/{schema}")
        self.at = (d, s)
        return self

    def register(self, name: str, rows: DataFrame, pk: list[str] | None = None) -> None:
        """Make existing rows a table; names fold to upper case as in the dialect."""
        columns = [(c.upper(), KINDS.get(k, k), True) for c, k in rows.dtypes]
        self.schema.tables[name.upper()] = Stored(name.upper(), columns, [c.upper() for c in pk or []], parts=[rows.toDF(*[c for c, _, _ in columns])])

    def register_folder(self, folder: str, *names: str) -> Engine:
        for n in names:
            self.register(n, self.spark.read.parquet(f"{folder}/{n}.parquet"))
        return self

    def table(self, path: list[str]) -> Stored:
        t = self.schema.tables.get(path[-1])
        if t is None:
            raise SQLError("42F01", ".".join(path))
        return t

    def lookup(self, path: list[str]) -> Table | None:
        if path[0] == "INFORMATION_SCHEMA":
            return self.system(path[-1])
        view = self.schema.views.get(path[-1])
        if view is not None and len(path) <= 2:
            binder = self.binder()
            sql, columns = binder.query(view)
            return Table(f"({binder.relabel(sql, columns)})", columns)
        t = self.schema.tables.get(path[-1])
        if t is None or len(path) > 2:
            return None
        view = f"quern_{id(self)}_{self.at[0].replace('/', '_')}_{self.at[1]}_{t.name}_{t.version}"
        t.frame(self.spark).createOrReplaceTempView(q(view))
        return Table(q(view), t.columns)

    def system(self, name: str) -> Table | None:
        """SCHEMATA, TABLES, COLUMNS and INDEXES of all databases."""
        schemas = [(d, s, x) for d, ss in sorted(self.databases.items()) for s, x in sorted(ss.items())]
        if name == "SCHEMATA":
            rows, cols = [(d, s, x.template) for d, s, x in schemas], ["CATALOG_NAME", "SCHEMA_NAME", "TEMPLATE_NAME"]
        elif name == "TABLES":
            rows, cols = [(d, s, t) for d, s, x in schemas for t in sorted(x.tables)], ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME"]
        elif name == "COLUMNS":
            rows = [(d, s, t.name, c, k.upper(), "YES" if null else "NO", i) for d, s, x in schemas for t in x.tables.values() for i, (c, k, null) in enumerate(t.columns, 1)]
            cols = ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "COLUMN_NAME", "DATA_TYPE", "IS_NULLABLE", "ORDINAL_POSITION"]
        elif name == "INDEXES":
            rows = [(d, s, i.get("table", ""), i["name"], i["unique"]) for d, s, x in schemas for i in x.indexes]
            cols = ["TABLE_CATALOG", "TABLE_SCHEMA", "TABLE_NAME", "INDEX_NAME", "IS_UNIQUE"]
        else:
            return None
        kind = {"ORDINAL_POSITION": "bigint", "IS_UNIQUE": "boolean"}
        columns = [(c, kind.get(c, "string"), True) for c in cols]
        view = f"quern_{id(self)}_system_{name}"
        self.spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k, _ in columns)).createOrReplaceTempView(view)
        return Table(view, columns)

    # queries

    def binder(self) -> Binder:
        return Binder(self.lookup, self.strict, self.recursion, self.schema.functions)

    def sql_of(self, text: str, args: list | None = None) -> str:
        """The Spark SQL that a query of the dialect becomes."""
        return self._bound(text, args)[0]

    def _bound(self, text: str, args: list | None):
        parsed = S.parse(S.substitute(text, args or []))
        if len(parsed) != 1 or not isinstance(parsed[0], S.Query):
            if len(parsed) == 1 and parsed[0].kind == "show":
                return self.show(parsed[0].parts["what"])
            raise SQLError("0A000", "query() takes one SELECT")
        return self.binder().query(parsed[0])

    def show(self, what: str):
        names = sorted(self.databases) if what == "DATABASES" else sorted(self.templates) if what == "TEMPLATES" else None
        if names is None:
            raise SQLError("42601", f"SHOW {what}")
        column = "DATABASE_ID" if what == "DATABASES" else "TEMPLATE_NAME"
        self.spark.createDataFrame([(n,) for n in names], f"{column} string").createOrReplaceTempView("quern_show")
        return "SELECT * FROM quern_show", [(column, "string", False)]

    def query(self, text: str, args: list | None = None) -> DataFrame:
        parsed = S.parse(S.substitute(text, args or []))
        if len(parsed) == 1 and not isinstance(parsed[0], S.Query) and parsed[0].kind == "explain":
            return self._frame("EXPLAIN FORMATTED " + self.binder().query(parsed[0].parts["query"])[0]).toDF("PLAN")
        sql, columns = self._bound(text, args)
        return self._frame(sql)

    def explain(self, text: str, args: list | None = None) -> str:
        """The physical plan of a query, without running it."""
        return self.query("EXPLAIN " + text, args).first()[0]

    def plan_hash(self, text: str, args: list | None = None) -> int:
        """A fingerprint of the analysed plan: equal for queries that differ in spelling alone."""
        return self.query(text, args).semanticHash()

    def _frame(self, sql: str) -> DataFrame:
        try:
            return self.spark.sql(sql)
        except SPARK_ERRORS as e:
            raise (of_spark(e) or e) from e

    def rows(self, text: str, args: list | None = None) -> list[tuple]:
        """All rows of a query, for small results."""
        try:
            return [tuple(r) for r in self.query(text, args).collect()]
        except SPARK_ERRORS as e:
            raise (of_spark(e) or e) from e

    # recursion

    def recursion(self, binder: Binder, cte: dict) -> tuple[str, list]:
        body, name = cte["query"].body, cte["name"]
        if isinstance(body, (S.Select, S.Query)):
            raise SQLError("0A000", "a recursive query is a union of a seed and a step")
        _, whole, seed, step = body
        if binder.mentions(seed, name):
            raise SQLError("0A000", "the seed reads from itself")
        sql, columns, _ = binder.body(seed, None, [])
        columns = [(n, "bigint" if k == "int" else k, True) for n, k, _ in binder.renamed(columns, cte["columns"])]
        listed = [F.col(q(n)).cast(spark_type(k)).alias(n) for n, k, _ in columns]
        to = lambda df: df.toDF(*[n for n, _, _ in columns], *df.columns[len(columns) :])
        start = to(self._frame(sql)).select(*listed)
        order = cte["traversal"]
        deep = order in ("pre_order", "post_order")
        extra = [("_PATH", "array<bigint>", True)] if deep else []
        alias = self._alias_of(step, name) if deep else None
        if deep:
            step.items.append((S.Node("column", ((alias, "_PATH"),)), "_PATH"))

        def numbered(df: DataFrame, by: list) -> DataFrame:
            return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*[q(n) for n, _, _ in columns])).cast("long"))

        def round_(frontier: DataFrame) -> DataFrame:
            view = f"quern_{id(self)}_{binder.fresh()}"
            frontier.createOrReplaceTempView(view)
            binder.ctes.append(dict(binder.ctes[-1]))
            binder.ctes[-1][name] = Table(view, columns + extra)
            try:
                sql, got, _ = binder.body(step, None, [])
            finally:
                binder.ctes.pop()
            if len(got) != len(columns) + len(extra):
                raise SQLError("42F64")
            out = to(self._frame(sql)).select(*listed, *[F.col(n) for n, _, _ in extra])
            if deep:
                out = numbered(out, ["_PATH"]).withColumn("_PATH", F.concat("_PATH", F.array("_n"))).drop("_n")
            return out

        try:
            if deep:
                start = running(start, F.struct(*[q(n) for n, _, _ in columns]).asc(), F.lit(1).cast("long"), "_n")
                start = start.select(*listed, F.array(F.col("_n") + 1).alias("_PATH"))
                reached = rec.level_order(start, round_)
                key = F.col("_PATH") if order == "pre_order" else F.concat("_PATH", F.array(F.lit(2**62)))
                found = reached.orderBy(key).drop("_PATH")
            else:
                found = rec.level_order(start, round_) if whole else rec.distinct_fixpoint(start, round_)
        except SPARK_ERRORS as e:
            raise (of_spark(e) or e) from e
        view = f"quern_{id(self)}_{binder.fresh()}"
        found.createOrReplaceTempView(view)
        return view, columns

    def _alias_of(self, step, name: str) -> str:
        def find(s):
            if s[0] == "table" and s[1] == [name]:
                return s[2] or name
            return (find(s[2]) or find(s[3])) if s[0] == "join" else None

        if not isinstance(step, S.Select):
            raise SQLError("0A000", "traversal of this step")
        return find(step.source)

    # statements

    def execute(self, text: str, args: list | None = None) -> int:
        """Run statements one after another; the number of rows they affected in all."""
        total = 0
        for s in S.parse(S.substitute(text, args or [])):
            if args and not isinstance(s, S.Query) and s.kind in ("create_view", "create_function", "create_template"):
                raise SQLError("42601", "a definition takes no parameters")
            if isinstance(s, S.Query) or s.kind in ("show", "explain"):
                raise SQLError("0A000", "execute() takes no query")
            try:
                total += getattr(self, f"do_{s.kind}")(**s.parts) or 0
            except SPARK_ERRORS as e:
                raise (of_spark(e) or e) from e
        return total

    def do_begin(self):
        if self.private is not None:
            raise SQLError("0A000", "a transaction is open")
        self.private, self.copies = self.shared.copy()
        self.began = {k: shared.version for k, (shared, _) in self.copies.items()}
        self.names = {(d, s) for d, ss in self.shared.databases.items() for s in ss}, set(self.shared.databases), dict(self.shared.templates)

    def do_commit(self):
        if self.private is None:
            return
        changed = [(shared, mine, self.began[k]) for k, (shared, mine) in self.copies.items() if mine.version != self.began[k]]
        if any(shared.version != version for shared, _, version in changed):
            self.private = None
            raise SQLError("40001", "another session has changed the table")
        for shared, mine, _ in changed:
            shared.parts, shared.version = mine.parts, mine.version
        schemas, databases, templates = self.names
        mine, ours = self.private, self.shared
        for d in set(mine.databases) - databases:
            ours.databases.setdefault(d, {})
        for d, s in {(d, s) for d, ss in mine.databases.items() for s in ss} - schemas:
            ours.databases[d][s] = mine.databases[d][s]
        for d, s in schemas - {(d, s) for d, ss in mine.databases.items() for s in ss}:
            ours.databases.get(d, {}).pop(s, None)
        for d in databases - set(mine.databases):
            ours.databases.pop(d, None)
        for d, s in schemas:
            if s in mine.databases.get(d, {}) and s in ours.databases.get(d, {}):
                ours.databases[d][s].views, ours.databases[d][s].functions = mine.databases[d][s].views, mine.databases[d][s].functions
        for n in templates.keys() - mine.templates.keys():
            ours.templates.pop(n, None)
        ours.templates.update({n: x for n, x in mine.templates.items() if templates.get(n) is not x})
        self.private = None

    def do_rollback(self):
        self.private = None

    def do_create_view(self, name, body):
        if name in self.schema.views or name in self.schema.tables:
            raise SQLError("42F07", name)
        self.binder().query(body)  # names and types must hold now
        self.schema.views[name] = body

    def do_drop_view(self, name):
        if self.schema.views.pop(name, None) is None:
            raise SQLError("42F01", name)

    def do_create_function(self, name, body):
        if name in self.schema.functions:
            raise SQLError("42723", name)
        self.schema.functions[name] = body

    def do_drop_function(self, name):
        if self.schema.functions.pop(name, None) is None:
            raise SQLError("42883", name)

    def do_create_database(self, path):
        if path in self.databases:
            raise SQLError("42F04", path)
        self.databases[path] = {}

    def do_drop_database(self, path):
        if self.databases.pop(path, None) is None:
            raise SQLError("42F01", path)

    def do_create_template(self, name, tables, indexes, views, functions):
        for i in indexes:
            if "table" in i and i["table"] not in tables:
                raise SQLError("42F01", i["table"])
        self.templates[name] = {"tables": tables, "indexes": indexes, "views": views, "functions": functions}

    def do_drop_template(self, name):
        if self.templates.pop(name, None) is None:
            raise SQLError("42F01", name)

    def do_create_schema(self, path, template):
        database, _, name = path.rpartition("/")
        if database not in self.databases:
            raise SQLError("42F01", database)
        if template not in self.templates:
            raise SQLError("42F01", template)
        if name in self.databases[database]:
            raise SQLError("42F06", path)
        t = self.templates[template]
        tables = {}
        for n, x in t["tables"].items():
            pk = set(x["pk"])
            unknown = pk - {c for c, _, _ in x["columns"]}
            if unknown:
                raise SQLError("42703", ", ".join(unknown))
            unique = [i["columns"] for i in t["indexes"] if i.get("table") == n and i["unique"]]
            tables[n] = Stored(n, [(c, k, null and c not in pk) for c, k, null in x["columns"]], x["pk"], unique)
        self.databases[database][name] = Schema(template, tables, t["indexes"], dict(t["views"]), dict(t["functions"]))

    def do_drop_schema(self, path):
        database, _, name = path.rpartition("/")
        if self.databases.get(database, {}).pop(name, None) is None:
            raise SQLError("42F01", path)

    # data changes

    def _with(self, binder: Binder, ctes: list) -> Binder:
        for c in ctes:
            binder.cte(c, False, None)
        return binder

    def _fit(self, name: str, column: tuple[str, str, bool], x: Expr) -> str:
        """An expression as a column's value; widening is allowed, anything else is a type error."""
        n, kind, null = column
        if x.kind == "null":
            if not null:
                raise SQLError("23502", f"{name}.{n}")
            return f"cast(NULL AS {spark_type(kind)})"
        if family(x.kind) != family(kind) and not (x.kind == "string" and kind in ("date", "timestamp_ntz")) and not (x.kind.startswith("array") and kind.startswith("array")):
            raise SQLError("22000", f"{x.kind} for {n} {kind}")
        if kind in INTEGERS and x.kind in ("double", "float"):
            raise SQLError("22000", f"{x.kind} for {n} {kind}")
        if kind == "int" and x.kind == "bigint":
            return f"(CASE WHEN {x.sql} NOT BETWEEN -2147483648L AND 2147483647L THEN cast(raise_error('[SQLSTATE=22003] out of range of INTEGER') AS int) ELSE cast({x.sql} AS int) END)"
        if kind == "uuid":
            return f"lower({x.sql})"
        return f"cast({x.sql} AS {spark_type(kind)})"

    def _check(self, t: Stored, new: DataFrame, others: list[DataFrame]) -> None:
        """NOT NULL, primary key and unique indexes of new rows, among themselves and against the other parts."""
        must = [n for n, _, null in t.columns if not null]
        if must:
            bad = new.agg(*[F.count(F.when(F.col(q(n)).isNull(), 1)).alias(n) for n in must]).first().asDict()
            for n in must:
                if bad[n]:
                    raise SQLError("23502", f"{t.name}.{n}")
        for keys in [t.pk, *t.unique]:
            if not keys:
                continue
            full = new.select(*[q(k) for k in keys]).dropna()
            if not full.groupBy(*[q(k) for k in keys]).count().where("count > 1").isEmpty():
                raise SQLError("23505", f"{t.name}({', '.join(keys)})")
            if others and not union(others).join(full, keys, "left_semi").isEmpty():
                raise SQLError("23505", f"{t.name}({', '.join(keys)})")

    def _publish(self, t: Stored, parts: list[DataFrame], affected: DataFrame | None, items: list | None) -> None:
        """The table's new parts, small ones merged when there are many; what RETURNING asks for of the affected rows."""
        small = [p for p in parts if getattr(p, "quern_rows", SMALL + 1) <= SMALL]
        if len(small) > MANY:
            n = sum(p.quern_rows for p in small)
            merged = cut(union(small).coalesce(-(-n // SMALL) or 1), "merged")
            merged.quern_rows = n
            parts = [*[p for p in parts if not any(p is x for x in small)], merged]
        t.parts, t.version = parts, t.version + 1
        self.last_returning = affected
        if items is not None and affected is not None:
            view = f"quern_{id(self)}_{t.name}_affected"
            affected.createOrReplaceTempView(q(view))
            own = lambda path: Table(q(view), t.columns) if path == [t.name] else self.lookup(path)
            sql, _, _ = Binder(own, self.strict, self.recursion, self.schema.functions).select(S.Select(items, ("table", [t.name], None, None)), None, [])
            self.last_returning = self._frame(sql)

    def do_insert(self, table, columns, rows=None, query=None, returning=None, dry=False, ctes=()):
        t, binder = self.table(table), self._with(self.binder(), list(ctes))
        if rows is not None:
            names = columns or [n for n, _, _ in t.columns]
            for n in names:
                if n not in [c for c, _, _ in t.columns]:
                    raise SQLError("42703", n)
            if len(set(names)) != len(names):
                raise SQLError("42701")
            lines = []
            for r in rows:
                if len(r) != len(names):
                    raise SQLError("42601", "as many values as columns")
                given = dict(zip(names, r, strict=True))
                lines.append("(" + ", ".join(self._fit(t.name, c, binder.expr(given[c[0]], Scope()) if c[0] in given else Expr("NULL", "null")) for c in t.columns) + ")")
            names = ", ".join(q(n) for n, _, _ in t.columns)
            if "raise_error" in "".join(lines):  # not for inline tables, which are evaluated as they are read
                sql = f"SELECT * FROM ({' UNION ALL '.join(f'SELECT {line[1:-1]}' for line in lines)}) AS v({names})"
            else:
                sql = f"SELECT * FROM VALUES {', '.join(lines)} AS v({names})"
        else:
            inner, got = binder.query(query)
            if len(got) != len(t.columns):
                raise SQLError("42601", "as many columns as the table has")
            listed = ", ".join(f"_c{i}" for i in range(len(got)))
            fitted = ", ".join(f"{self._fit(t.name, c, Expr(f'_c{i}', k if k != 'null' else c[1]))} AS {q(c[0])}" for i, (c, (_, k, _)) in enumerate(zip(t.columns, got, strict=True)))
            sql = f"SELECT {fitted} FROM ({inner}) AS s({listed})"
        new = cut(self._frame(sql), "insert")
        self._check(t, new, t.parts)
        n = new.count()
        if not dry:
            new.quern_rows = n
            self._publish(t, [*t.parts, new], new, returning)
        return n

    def _touched(self, t: Stored, alias: str | None, where, binder: Binder):
        """For each part: a scope over it and the condition's text."""
        for k, part in enumerate(t.parts):
            view = f"quern_{id(self)}_{t.name}_part_{t.version}_{k}"
            part.createOrReplaceTempView(q(view))
            scope = Scope([Column(alias or t.name, n, kind, f"_r.{q(n)}", null) for n, kind, null in t.columns])
            cond = binder.boolean(where, scope, aggregates=False).sql if where is not None else "TRUE"
            yield part, q(view), scope, cond

    def _kept(self, part: DataFrame, view: str, cond: str, n: int) -> DataFrame:
        """What a change leaves of a part."""
        out = cut(self._frame(f"SELECT * FROM {view} AS _r WHERE NOT coalesce({cond}, FALSE)"), "kept")
        if hasattr(part, "quern_rows"):
            out.quern_rows = part.quern_rows - n
        return out

    def do_update(self, table, alias, sets, where, returning=None, dry=False, ctes=()):
        t, binder = self.table(table), self._with(self.binder(), list(ctes))
        kinds = {n: (n, k, null) for n, k, null in t.columns}
        for c, _ in sets:
            if c not in kinds:
                raise SQLError("42703", c)
            if c in t.pk:
                raise SQLError("0A000", "a primary key cannot be changed")
        if len({c for c, _ in sets}) != len(sets):
            raise SQLError("42701")
        parts, changed, total = [], [], 0
        for part, view, scope, cond in self._touched(t, alias, where, binder):
            new = {c: self._fit(t.name, kinds[c], binder.expr(e, scope)) for c, e in sets}
            listed = ", ".join(f"{new.get(n, f'_r.{q(n)}')} AS {q(n)}" for n, _, _ in t.columns)
            hit = cut(self._frame(f"SELECT {listed} FROM {view} AS _r WHERE {cond}"), "update")
            n = hit.count()
            if not n:
                parts.append(part)
                continue
            total += n
            changed.append(hit)
            parts += [self._kept(part, view, cond, n), hit]
            hit.quern_rows = n
        if changed:
            new = union(changed)
            self._check(t, new, [p for p in parts if not any(p is c for c in changed)])
        if not dry:
            self._publish(t, parts, None if not changed else new, returning)
        return total

    def do_delete(self, table, alias, where, returning=None, dry=False, ctes=()):
        t, binder = self.table(table), self._with(self.binder(), list(ctes))
        parts, gone, total = [], [], 0
        for part, view, _, cond in self._touched(t, alias, where, binder):
            hit = self._frame(f"SELECT * FROM {view} AS _r WHERE {cond}")
            n = hit.count()
            if not n:
                parts.append(part)
                continue
            total += n
            gone.append(hit)
            if where is not None:
                parts.append(self._kept(part, view, cond, n))
        if not dry:
            self._publish(t, parts, union(gone) if gone else None, returning)
        return total

    # indexes

    def index(self, name: str) -> DataFrame:
        """The derived rows of an index of this schema: (keys, primary key), or the grouped aggregate it is defined by."""
        from quern.operators.indexes import check_unique, value_index

        found = [i for i in self.schema.indexes if i["name"] == name.upper()]
        if not found:
            raise SQLError("42F01", name)
        i = found[0]
        if "query" in i:
            return self._frame(self.binder().query(i["query"])[0])
        t = self.table([i["table"]])
        for c in i["columns"]:
            if c not in [n for n, _, _ in t.columns]:
                raise SQLError("42703", c)
        rows = t.frame(self.spark)
        if i["vector"]:
            return self.vector_index(name).table
        if i["unique"]:
            check_unique(rows, i["columns"])
        return value_index(rows, i["columns"] + i.get("partition", []), t.pk).orderBy(*i["columns"])

    def vector_index(self, name: str) -> vectors.Clustered:
        """A vector index of this schema, built over its table as it is now and kept until the table changes."""
        i = next((i for i in self.schema.indexes if i["name"] == name.upper() and i["vector"]), None)
        if i is None:
            raise SQLError("42F01", name)
        t = self.table([i["table"]])
        key = (name.upper(), id(t))
        if key not in self.built or self.built[key][0] != t.version:
            self.built[key] = (t.version, vectors.Clustered.build(t.frame(self.spark).select(t.pk[0], *i.get("partition", []), i["columns"][0]), i["columns"][0], t.pk[0]))
        return self.built[key][1]

    # functions

    def function(self, name: str, run, kind: str) -> None:
        """Register a scalar function of batches (a pandas UDF) under a name of Spark SQL's."""
        from pyspark.sql.functions import PandasUDFType, pandas_udf

        self.spark.udf.register(name, pandas_udf(run, kind, PandasUDFType.SCALAR))
