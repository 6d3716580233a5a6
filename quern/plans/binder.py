"""From the dialect's tree to Spark SQL: names are resolved, types checked, and every operator gets its exact meaning.

The text handed to Spark is fully parenthesised, so Spark's own precedence plays no part; Catalyst plans and optimises it as any
other query.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from quern.errors import SQLError
from quern.plans.syntax import Node, Query, Select

INTEGERS = ("int", "bigint")
NUMBERS = (*INTEGERS, "float", "double")
AGGREGATES = ("COUNT", "SUM", "MIN", "MAX", "AVG")
CLOCK = ("CURRENT_DATE", "CURRENT_TIMESTAMP", "CURRENT_TIME", "LOCALTIME", "LOCALTIMESTAMP", "CURRENT_USER")
#: Qualifier of the names that GROUP BY gives to its keys.
KEYS = "\0"
DISTANCES = {"EUCLIDEAN_DISTANCE": "euclidean", "EUCLIDEAN_SQUARE_DISTANCE": "euclidean_square", "COSINE_DISTANCE": "cosine", "DOT_PRODUCT_DISTANCE": "dot_product"}


@dataclass
class Expr:
    """Spark SQL text, its type, and whether an aggregate stands in it."""

    sql: str
    kind: str
    aggregate: bool = False


@dataclass
class Column:
    qualifier: str | None
    name: str
    kind: str
    sql: str
    null: bool = True


@dataclass
class Scope:
    """Columns that names are looked up in, innermost first."""

    columns: list[Column] = field(default_factory=list)
    outer: Scope | None = None
    items: dict[str, str] = field(default_factory=dict)  # labels of what the select list computes
    extra: list[str] = field(default_factory=list)  # sort keys of a grouped query that it does not return
    hidden: set[str] = field(default_factory=set)  # USING columns of the right side: only by their qualifier

    def find(self, path: tuple[str, ...]) -> tuple[Column, tuple[str, ...]]:
        if len(path) > 1:
            hit = [c for c in self.columns if c.qualifier == path[0] and c.name == path[1]]
            if hit:
                return hit[0], path[2:]
        hit = [c for c in self.columns if c.name == path[0] and f"{c.qualifier}.{c.name}" not in self.hidden]
        if len(hit) > 1:
            raise SQLError("42702", path[0])
        if hit:
            return hit[0], path[1:]
        if self.outer:
            return self.outer.find(path)
        raise SQLError("42703", ".".join(path))


@dataclass
class Table:
    """What the binder knows of a table: the view that holds it and its columns (name, type, nullable)."""

    view: str
    columns: list[tuple[str, str, bool]]


def q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text(v: str) -> str:
    return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"


def fail(state: str, why: str, kind: str) -> str:
    return f"cast(raise_error('[SQLSTATE={state}] {why}') AS {spark_type(kind)})"


def spark_type(kind: str) -> str:
    return {"uuid": "string", "null": "void"}.get(kind, kind).replace("array<uuid>", "array<string>")


def family(kind: str) -> str:
    return "number" if kind in NUMBERS else "text" if kind in ("string", "uuid") else kind


def unify(kinds: list[str]) -> str:
    """The one type of several branches."""
    known = [k for k in kinds if k != "null"]
    if not known:
        return "null"
    dates = [k for k in known if k in ("date", "timestamp_ntz")]
    if dates and set(known) == {"string", dates[0]}:
        return dates[0]
    if len({family(k) for k in known}) > 1:
        raise SQLError("42804", " and ".join(sorted(set(known))))
    if family(known[0]) == "number":
        return "double" if "double" in known or "float" in known else "bigint" if "bigint" in known else "int"
    return "string" if family(known[0]) == "text" else known[0]


class Binder:
    """Binds queries against tables found by ``lookup``; ``strict``: what the dialect rejects is rejected here."""

    def __init__(self, lookup: Callable[[list[str]], Table | None], strict: bool = True, recursion: Callable | None = None, functions: dict[str, dict] | None = None):
        self.lookup, self.strict, self.recursion, self.functions = lookup, strict, recursion, functions or {}
        self.names, self.ctes = 0, [{}]
        self.inner = 0  # depth of ON conditions and aggregate arguments

    def fresh(self) -> str:
        self.names += 1
        return f"_t{self.names}"

    # queries

    def query(self, query: Query, outer: Scope | None = None, nested: bool = False) -> tuple[str, list[tuple[str, str, bool]]]:
        """(Spark SQL, output columns)."""
        if nested and self.strict and (query.limit or query.offset) and nested == "subquery":
            raise SQLError("0AF00", "LIMIT in a subquery")
        self.ctes.append(dict(self.ctes[-1]))
        try:
            if len({c["name"] for c in query.ctes}) < len(query.ctes):
                raise SQLError("42712", "a name stands twice in WITH")
            for cte in query.ctes:
                self.cte(cte, query.recursive, outer)
            sql, columns, scope = self.body(query.body, outer, query.order)
            if scope is not None and scope.extra:
                sql = f"SELECT {', '.join(q(n) for n, _, _ in columns)} FROM ({sql}) AS {self.fresh()}"
            if query.order:
                sql += " ORDER BY " + ", ".join(self.order(query.order, columns, scope))
            if query.limit is not None:
                sql += f" LIMIT {self.count(query.limit)}"
            if query.offset is not None:
                sql += f" OFFSET {self.count(query.offset)}"
            return sql, columns
        finally:
            self.ctes.pop()

    def count(self, n: Node) -> int:
        if n.kind != "number" or not n.parts[0].isdigit():
            raise SQLError("22023", "a count must be a whole number")
        return int(n.parts[0])

    def cte(self, cte: dict, recursive: bool, outer: Scope | None) -> None:
        own = self.mentions(cte["query"], cte["name"])
        if own and not recursive:
            raise SQLError("42F01", cte["name"])
        if recursive and own:
            if self.recursion is None:
                raise SQLError("0A000", "recursion here")
            view, columns = self.recursion(self, cte)
            self.ctes[-1][cte["name"]] = Table(view, columns)
            return
        if recursive and not own and self.strict:
            raise SQLError("0A000", "RECURSIVE without recursion")
        sql, columns = self.query(cte["query"], None)
        columns = self.renamed(columns, cte["columns"])
        self.ctes[-1][cte["name"]] = Table(f"({self.relabel(sql, columns)})", columns)

    def renamed(self, columns, names):
        if names is None:
            return columns
        if len(names) != len(columns):
            raise SQLError("42F10", "column list")
        return [(n, k, null) for n, (_, k, null) in zip(names, columns, strict=True)]

    def relabel(self, sql: str, columns) -> str:
        names = ", ".join(q(n) for n, _, _ in columns)
        return f"SELECT * FROM ({sql}) AS {self.fresh()}({names})"

    def mentions(self, query, name: str) -> bool:
        """Whether a query reads from this name."""
        found = False

        def source(s):
            nonlocal found
            if s is None:
                return
            if s[0] == "table":
                found |= s[1] == [name]
            elif s[0] == "derived":
                body(s[1])
            elif s[0] == "join":
                source(s[2])
                source(s[3])

        def body(b):
            if isinstance(b, Query):
                body(b.body)
                for c in b.ctes:
                    body(c["query"])
            elif isinstance(b, Select):
                source(b.source)
                for e in [x for x, _ in b.items] + [b.where, b.having]:
                    for n in e.walk() if e else []:
                        if n.kind in ("exists", "scalar"):
                            body(n.parts[0])
            else:
                body(b[2])
                body(b[3])

        body(query)
        return found

    def body(self, b, outer, order):
        if isinstance(b, Query):
            sql, columns = self.query(b, outer)
            return f"({sql})", columns, None
        if isinstance(b, Select):
            return self.select(b, outer, order)
        _, whole, left, right = b
        if not whole and self.strict:
            raise SQLError("0AF00", "UNION without ALL")
        ls, lc, _ = self.body(left, outer, [])
        rs, rc, _ = self.body(right, outer, [])
        if len(lc) != len(rc):
            raise SQLError("42F64")
        columns = []
        for (n, a, x), (_, c, y) in zip(lc, rc, strict=True):
            try:
                columns.append((n, unify([a, c]), x or y))
            except SQLError:
                raise SQLError("42F65", f"{n}: {a} and {c}") from None
        return f"SELECT * FROM ({ls} UNION {'ALL ' if whole else ''}{rs}) AS {self.fresh()}", columns, None

    def select(self, s: Select, outer: Scope | None, order) -> tuple[str, list, Scope]:
        source, scope = self.source(s.source, outer)
        items: list[tuple[str, Expr, bool]] = []
        labels: set[str] = set()
        named = [alias for _, alias in s.group if alias]
        if len(set(named)) < len(named):
            raise SQLError("42702", "a name stands twice in GROUP BY")
        for e, alias in s.group:
            if alias:
                x = self.expr(e, scope)
                scope.columns.append(Column(KEYS, alias, x.kind, x.sql))
        for e, alias in s.items:
            if e.kind == "star":
                cols = [c for c in scope.columns if c.qualifier != KEYS and (e.parts[0] is None or c.qualifier == e.parts[0]) and (e.parts[0] or f"{c.qualifier}.{c.name}" not in scope.hidden)]
                if not cols:
                    raise SQLError("42F01", f"{e.parts[0]}.*")
                items += [(c.name, Expr(c.sql, c.kind), c.null) for c in cols]
            else:
                x = self.expr(e, scope)
                items.append((alias or self.label(e, len(items)), x, True))
                if alias:
                    labels.add(alias)
        sql = f"FROM {source}"
        if s.where is not None:
            sql += f" WHERE {self.boolean(s.where, scope, aggregates=False).sql}"
        grouped = bool(s.group) or s.having is not None or any(x.aggregate for _, x, _ in items)
        keys = []
        for e, _ in s.group:
            if e.kind == "number":
                k = int(e.parts[0]) if e.parts[0].isdigit() else 0
                if not 1 <= k <= len(items):
                    raise SQLError("22023", "GROUP BY position")
                keys.append(items[k - 1][1].sql)
            else:
                keys.append(self.expr(e, scope).sql)
        if grouped and not s.group:
            self.only_aggregates(s, scope)
        if keys:
            sql += " GROUP BY " + ", ".join(keys)
        if s.having is not None:
            sql += f" HAVING {self.boolean(s.having, scope).sql}"
        names = self.distinct_names([n for n, _, _ in items])
        scope.items = {x.sql: n for n, (_, x, _) in reversed(list(zip(names, items, strict=True)))}
        head = ", ".join(f"{x.sql} AS {q(n)}" for n, (_, x, _) in zip(names, items, strict=True))
        columns = [(n, x.kind, null) for n, x, null in items]
        if grouped and not s.distinct and s.qualify is None:
            for e, _, _ in order:
                if e.kind == "number" or e.kind == "column" and e.parts[0][-1] in names:
                    continue
                x = self.expr(e, self.with_labels(scope, columns))
                if x.aggregate and x.sql not in scope.items:
                    scope.items[x.sql] = f"_o{len(scope.extra)}"
                    head += f", {x.sql} AS {q(scope.items[x.sql])}"
                    scope.extra.append(scope.items[x.sql])
        if s.qualify is not None:
            return self.qualified(s, scope, head, sql, names, columns)
        word = "SELECT DISTINCT" if s.distinct else "SELECT"
        if names != [n for n, _, _ in items]:
            self.twice = True
        return f"{word} {head} {sql}", [(n, k, null) for n, (_, k, null) in zip(names, columns, strict=True)], scope

    def distinct_names(self, names: list[str]) -> list[str]:
        """Labels as they are; a repeated one gets a number, since Spark could not tell them apart in a derived table."""
        seen: dict[str, int] = {}
        out = []
        for n in names:
            seen[n] = seen.get(n, 0) + 1
            out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
        return out

    def only_aggregates(self, s: Select, scope: Scope) -> None:
        """A query with aggregates and no keys must not read plain columns outside of them."""

        def free(n: Node) -> bool:
            if n.kind == "call" and n.parts[0] in AGGREGATES or n.kind in ("scalar", "exists"):
                return False
            if n.kind == "column":
                return True
            return any(free(x) for p in n.parts for x in self.nodes(p))

        for e, _ in s.items:
            if e.kind == "star" or free(e):
                raise SQLError("42803")

    def nodes(self, p):
        if isinstance(p, Node):
            yield p
        elif isinstance(p, (list, tuple)):
            for x in p:
                yield from self.nodes(x)

    def qualified(self, s: Select, scope: Scope, head: str, sql: str, names, columns):
        """QUALIFY ROW_NUMBER() OVER (... ORDER BY distance) < <= = k: rank the rows that WHERE keeps, then cut."""
        e = s.qualify
        if not (e.kind == "compare" and e.parts[0] in ("<", "<=", "=") and e.parts[1].kind == "over" and e.parts[1].parts[0] == "ROW_NUMBER"):
            raise SQLError("0AF00", "QUALIFY takes ROW_NUMBER() OVER (...) and a bound")
        _, _, by, order = e.parts[1].parts
        bound = self.expr(e.parts[2], scope)
        if bound.kind not in INTEGERS:
            raise SQLError("42804", "bound")
        keys = ", ".join(self.expr(x, scope).sql for x in by)
        sort = []
        for x, down, first in order:
            nulls = (not down) if first is None else first
            sort.append((self.expr(x, scope).sql, f"{'DESC' if down else 'ASC'} NULLS {'FIRST' if nulls else 'LAST'}"))
        out, name = ", ".join(map(q, names)), self.fresh()
        if not keys and e.parts[2].kind == "number" and bound.sql.rstrip("L").isdigit():  # the first rows of all, without gathering the others
            most = int(bound.sql.rstrip("L")) - (e.parts[0] == "<")
            head += "".join(f", {x} AS _s{i}" for i, (x, _) in enumerate(sort))
            by_sort = ", ".join(f"_s{i} {how}" for i, (_, how) in enumerate(sort))
            inner = f"SELECT *, row_number() OVER (ORDER BY {by_sort}) AS _rn FROM (SELECT {head} {sql} ORDER BY {by_sort} LIMIT {max(most, 0)}) AS {self.fresh()}"
        else:
            by_sort = ", ".join(f"{x} {how}" for x, how in sort)
            inner = f"SELECT {head}, row_number() OVER ({'PARTITION BY ' + keys if keys else ''} ORDER BY {by_sort}) AS _rn {sql}"
        return f"SELECT {out} FROM ({inner}) AS {name} WHERE _rn {e.parts[0]} {bound.sql}", columns, None

    def label(self, e: Node, at: int) -> str:
        if e.kind == "column":
            return e.parts[0][-1]
        if e.kind == "paren":
            return self.label(e.parts[0], at)
        return f"_{at}"

    def order(self, keys, columns, scope: Scope | None) -> list[str]:
        out, seen = [], set()
        for e, down, first in keys:
            labels = [n for n, _, _ in columns]
            if e.kind == "number":
                k = int(e.parts[0]) if e.parts[0].isdigit() else 0
                if not 1 <= k <= len(columns):
                    raise SQLError("22023", "ORDER BY position")
                sql = q(labels[k - 1])
            elif e.kind == "column" and len(e.parts[0]) == 1 and e.parts[0][0] in labels:
                sql = q(e.parts[0][0])
            elif scope is not None:
                sql = self.expr(e, self.with_labels(scope, columns)).sql
                if sql in scope.items:
                    sql = q(scope.items[sql])
            else:
                raise SQLError("42703", "ORDER BY")
            if e.kind == "column":
                if sql in seen:
                    raise SQLError("42701", sql)
                seen.add(sql)
            nulls = (not down) if first is None else first
            out.append(f"{sql} {'DESC' if down else 'ASC'} NULLS {'FIRST' if nulls else 'LAST'}")
        return out

    def with_labels(self, scope: Scope, columns) -> Scope:
        return Scope([Column(None, n, k, q(n)) for n, k, _ in columns if not any(c.name == n for c in scope.columns)], outer=scope)

    # FROM

    def source(self, s, outer: Scope | None) -> tuple[str, Scope]:
        kind = s[0]
        if kind == "join":
            return self.join(s, outer)
        scope = Scope(outer=outer)
        if kind == "derived":
            _, query, alias, names = s
            sql, columns = self.query(query, outer if self.correlated else None)
            columns = self.renamed(columns, names)
            name = self.fresh()
            listed = ", ".join(q(n) for n, _, _ in columns)
            scope.columns = [Column(alias, n, k, f"{name}.{q(n)}", null) for n, k, null in columns]
            return f"({sql}) AS {name}({listed})", scope
        if kind == "function":
            _, fn, args, alias = s
            own = self.functions.get(fn)
            if own is not None and own["returns"] is None:
                sql, columns = self.query(own["body"], self.parameters(fn, own, [self.expr(a, scope) for a in args]))
                name = self.fresh()
                scope.columns = [Column(alias or fn, n, k, f"{name}.{q(n)}", null) for n, k, null in columns]
                return f"({sql}) AS {name}({', '.join(q(n) for n, _, _ in columns)})", scope
            if fn != "RANGE":
                raise SQLError("42883", fn)
            name = self.fresh()
            scope.columns = [Column(alias, "ID", "bigint", f"{name}.id", False)]
            return f"range({', '.join(self.expr(a, scope).sql for a in args)}) AS {name}", scope
        _, path, alias, ordinal = s
        found = self.ctes[-1].get(path[0]) if len(path) == 1 else None
        found = found or self.lookup(path)
        if found is None:
            raise SQLError("42F01", ".".join(path))
        name = self.fresh()
        scope.columns = [Column(alias or path[-1], n, k, f"{name}.{q(n)}", null) for n, k, null in found.columns]
        return f"{found.view} AS {name}", scope

    correlated = True

    def join(self, s, outer: Scope | None) -> tuple[str, Scope]:
        _, kind, left, right, on, using = s
        lsql, lscope = self.source(left, outer)
        if right[0] == "table" and (len(right[1]) > 1 or right[3]) and (unnest := self.unnest(right, lscope, outer)):
            sql, column, ordinal = unnest
            scope = Scope(lscope.columns + [column] + ([ordinal] if ordinal else []), outer, lscope.hidden)
            return f"{lsql} {sql}", scope
        rsql, rscope = self.source(right, outer)
        scope = Scope(lscope.columns + rscope.columns, outer, lscope.hidden | rscope.hidden)
        names = [c.qualifier for c in lscope.columns]
        for c in rscope.columns:
            if c.qualifier in names and any(x.qualifier == c.qualifier and x.name == c.name for x in lscope.columns):
                raise SQLError("42702", f"{c.qualifier} stands twice in FROM")
        if kind == "cross":
            return f"{lsql} CROSS JOIN {rsql}", scope
        if using:
            parts = []
            for n in using:
                a, b = lscope.find((n,))[0], rscope.find((n,))[0]
                parts.append(self.comparison("=", Expr(a.sql, a.kind), Expr(b.sql, b.kind)).sql)
                scope.hidden = scope.hidden | {f"{b.qualifier}.{b.name}"}
            cond = " AND ".join(parts)
        else:
            self.inner += 1
            try:
                cond = self.boolean(on, scope, aggregates=False).sql
            finally:
                self.inner -= 1
        word = {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "full": "FULL"}[kind]
        return f"{lsql} {word} JOIN {rsql} ON {cond}", scope

    def unnest(self, right, lscope: Scope, outer):
        """t.items AS x AT i: a row for each element of an array of the left side."""
        _, path, alias, ordinal = right
        try:
            column, rest = lscope.find(tuple(path))
        except SQLError:
            return None
        if not column.kind.startswith("array<"):
            return None
        name, item = self.fresh(), column.kind[6:-1]
        element = Column(alias or path[-1], alias or path[-1], item, f"{name}.v")
        at = Column(ordinal, ordinal, "bigint", f"(cast({name}.p AS bigint) + 1)") if ordinal else None
        return f"LATERAL VIEW posexplode({column.sql}) {name} AS p, v", element, at

    # expressions

    def boolean(self, e: Node, scope: Scope, aggregates: bool = True) -> Expr:
        x = self.expr(e, scope)
        if x.aggregate and not aggregates:
            raise SQLError("42803", "an aggregate here")
        if x.kind == "null":
            return Expr("cast(NULL AS boolean)", "boolean", x.aggregate)
        if x.kind != "boolean":
            raise SQLError("42804", f"{x.kind} where a condition is asked for")
        return x

    def expr(self, e: Node, scope: Scope) -> Expr:
        return getattr(self, f"on_{e.kind}")(scope, *e.parts)

    def on_paren(self, scope, e):
        x = self.expr(e, scope)
        return Expr(f"({x.sql})", x.kind, x.aggregate)

    def on_number(self, scope, v):
        if v.lstrip("-").isdigit():
            n = int(v)
            if not -(2**63) <= n < 2**63:
                raise SQLError("22003", v)
            return Expr(f"{n}L" if n != -(2**63) else f"(-{2**63 - 1}L - 1L)", "int" if -(2**31) <= n < 2**31 else "bigint")
        if float(v) in (float("inf"), float("-inf")):
            raise SQLError("22003", v)
        return Expr(f"{v}D", "double")

    def on_text(self, scope, v):
        return Expr(text(v), "string")

    def on_bytes(self, scope, v):
        if len(v) % 2 or not all(c in "0123456789abcdefABCDEF" for c in v):
            raise SQLError("22F03", "not hexadecimal")
        return Expr(f"x'{v}'", "binary")

    def on_null(self, scope):
        return Expr("NULL", "null")

    def on_bool(self, scope, v):
        return Expr(v, "boolean")

    def on_array(self, scope, items):
        xs = [self.expr(i, scope) for i in items]
        kind = unify([x.kind for x in xs]) if xs else "null"
        kind = "bigint" if kind == "int" else kind
        return Expr(f"array({', '.join(x.sql for x in xs)})", f"array<{kind}>", any(x.aggregate for x in xs))

    def on_column(self, scope, path):
        try:
            c, rest = scope.find(path)
        except SQLError as e:
            if e.state == "42703" and len(path) == 1 and path[0] in CLOCK:
                return Expr(*self.function(path[0], []))
            raise
        return Expr(c.sql + "".join(f".{q(r)}" for r in rest), c.kind if not rest else "string")

    def on_star(self, scope, _):
        raise SQLError("42601", "* here")

    def on_logic(self, scope, op, a, b):
        x, y = self.boolean(a, scope), self.boolean(b, scope)
        sql = f"({x.sql} <> {y.sql})" if op == "XOR" else f"({x.sql} {op} {y.sql})"
        return Expr(sql, "boolean", x.aggregate or y.aggregate)

    def on_not(self, scope, a):
        x = self.boolean(a, scope)
        return Expr(f"(NOT {x.sql})", "boolean", x.aggregate)

    def comparison(self, op: str, x: Expr, y: Expr) -> Expr:
        if x.kind != "null" and y.kind != "null" and family(x.kind) != family(y.kind) and not {x.kind, y.kind} & {"date", "timestamp_ntz"} & {k for k in (x.kind, y.kind) if "string" in (x.kind, y.kind)}:
            raise SQLError("42804", f"{x.kind} {op} {y.kind}")
        return Expr(f"({x.sql} {op} {y.sql})", "boolean", x.aggregate or y.aggregate)

    def on_compare(self, scope, op, a, b):
        return self.comparison(op, self.expr(a, scope), self.expr(b, scope))

    def on_distinct(self, scope, a, b, is_):
        x = self.comparison("=", self.expr(a, scope), self.expr(b, scope))
        sql = f"({self.expr(a, scope).sql} <=> {self.expr(b, scope).sql})"
        return Expr(f"(NOT {sql})" if is_ else sql, "boolean", x.aggregate)

    def on_is_null(self, scope, a, no):
        x = self.expr(a, scope)
        return Expr(f"({x.sql} IS {'NOT ' if no else ''}NULL)", "boolean", x.aggregate)

    def on_is_truth(self, scope, a, v, no):
        x = self.boolean(a, scope)
        return Expr(f"({x.sql} IS {'NOT ' if no else ''}{v})", "boolean", x.aggregate)

    def on_in(self, scope, a, items, no):
        x, ys = self.expr(a, scope), [self.expr(i, scope) for i in items]
        for y in ys:
            if y.kind == "null" and self.strict:
                raise SQLError("42809", "NULL in an IN list")
            self.comparison("=", x, y)
        return Expr(f"({x.sql} {'NOT ' if no else ''}IN ({', '.join(y.sql for y in ys)}))", "boolean", x.aggregate)

    def on_between(self, scope, a, low, high, no):
        x, lo, hi = (self.expr(e, scope) for e in (a, low, high))
        sql = f"({self.comparison('>=', x, lo).sql} AND {self.comparison('<=', x, hi).sql})"
        return Expr(f"(NOT {sql})" if no else sql, "boolean", x.aggregate or lo.aggregate or hi.aggregate)

    def on_like(self, scope, a, pattern, escape, no):
        x, p = self.expr(a, scope), self.expr(pattern, scope)
        if x.kind not in ("string", "null") or p.kind not in ("string", "null"):
            raise SQLError("42804", "LIKE takes strings")
        if pattern.kind != "text":
            return Expr(f"({x.sql} {'NOT ' if no else ''}LIKE {computed_pattern(p.sql, self.escape(escape))})", "boolean", x.aggregate or p.aggregate)
        e = self.escape(escape)
        out, i, p = "", 0, pattern.parts[0]
        while i < len(p):
            if e and p[i] == e:
                i += 1
                if i == len(p):
                    raise SQLError("22023", "the pattern ends in its escape")
                out += "\\" + p[i] if p[i] in "%_\\" else p[i]
            else:
                out += "\\\\" if p[i] == "\\" else p[i]
            i += 1
        return Expr(f"({x.sql} {'NOT ' if no else ''}LIKE {text(out)})", "boolean", x.aggregate)

    def escape(self, e: Node | None) -> str | None:
        if e is not None and (e.kind != "text" or len(e.parts[0]) != 1):
            raise SQLError("22023", "an escape is one character")
        return e.parts[0] if e is not None else None

    def on_arith(self, scope, op, a, b):
        return self.arith(op, self.expr(a, scope), self.expr(b, scope))

    def arith(self, op: str, x: Expr, y: Expr) -> Expr:
        agg = x.aggregate or y.aggregate
        if op == "+" and "string" in (x.kind, y.kind):
            if {x.kind, y.kind} <= {"string", "null"}:
                return Expr(f"concat({x.sql}, {y.sql})", "string", agg)
        for z in (x, y):
            if z.kind not in NUMBERS and z.kind != "null":
                raise SQLError("42804", f"{z.kind} in arithmetic")
        kind = "double" if {x.kind, y.kind} & {"float", "double"} else "bigint"
        sx, sy = (f"cast({z.sql} AS {kind})" if z.kind != kind else z.sql for z in (x, y))
        if op in "+-*":
            return Expr(f"({sx} {op} {sy})", kind, agg)
        if kind == "bigint":
            return Expr(f"({sx} {'div' if op in ('/', 'DIV') else '%'} {sy})", kind, agg)
        if op == "%":
            return Expr(f"(CASE WHEN {sx} IS NULL OR {sy} IS NULL THEN NULL WHEN {sy} = 0D THEN double('NaN') ELSE {sx} % nullif({sy}, 0D) END)", kind, agg)
        special = f"CASE WHEN {sx} = 0D OR isnan({sx}) THEN double('NaN') WHEN {sx} > 0D THEN double('Infinity') ELSE double('-Infinity') END"
        value = f"(CASE WHEN {sx} IS NULL OR {sy} IS NULL THEN NULL WHEN {sy} = 0D THEN {special} ELSE {sx} / nullif({sy}, 0D) END)"
        if op == "DIV":
            return Expr(f"cast({value} AS bigint)", "bigint", agg)
        return Expr(value, kind, agg)

    def on_bits(self, scope, op, a, b):
        x, y = self.expr(a, scope), self.expr(b, scope)
        for z in (x, y):
            if z.kind not in INTEGERS and z.kind != "null":
                raise SQLError("42804", f"{z.kind} in a bit operation")
        return Expr(f"(cast({x.sql} AS bigint) {op} cast({y.sql} AS bigint))", "bigint", x.aggregate or y.aggregate)

    def on_subscript(self, scope, a, i):
        x, y = self.expr(a, scope), self.expr(i, scope)
        if not x.kind.startswith("array<") or y.kind not in INTEGERS:
            raise SQLError("42804", "subscript")
        return Expr(f"try_element_at({x.sql}, cast({y.sql} AS int))", x.kind[6:-1], x.aggregate)

    def on_case(self, scope, operand, whens, other):
        head = self.expr(operand, scope) if operand is not None else None
        parts, kinds, agg = [], [], False
        for c, v in whens:
            if head is not None:
                y = self.expr(c, scope)
                cond = self.comparison("=", head, y)
            else:
                cond = self.boolean(c, scope)
            x = self.expr(v, scope)
            parts.append((cond, x))
            kinds.append(x.kind)
            agg |= cond.aggregate or x.aggregate
        last = self.expr(other, scope) if other is not None else Expr("NULL", "null")
        kind = unify([*kinds, last.kind])
        to = lambda x: f"cast({x.sql} AS {spark_type(kind)})" if kind != "null" else x.sql
        return Expr("(CASE " + " ".join(f"WHEN {c.sql} THEN {to(x)}" for c, x in parts) + f" ELSE {to(last)} END)", kind, agg or last.aggregate)

    def on_cast(self, scope, e, kind):
        x = self.expr(e, scope)
        s, k = x.sql, x.kind
        if kind in INTEGERS:
            if k in ("double", "float"):
                bad = f"isnan({s}) OR abs({s}) = double('Infinity') OR {s} >= 9.223372036854776E18D OR {s} < -9.223372036854776E18D"
                s = f"(CASE WHEN {bad} THEN {fail('22F3H', 'no integer for this value', 'bigint')} ELSE cast(floor({s} + 0.5D) AS bigint) END)"
            elif k == "string":
                s = f"cast(trim({s}) AS bigint)"
            elif k not in (*INTEGERS, "boolean", "null"):
                raise SQLError("42804", f"CAST({k} AS {kind})")
            if kind == "int":
                s = f"(CASE WHEN cast({s} AS bigint) NOT BETWEEN -2147483648L AND 2147483647L THEN {fail('22F3H', 'out of range', 'int')} ELSE cast({s} AS int) END)"
            else:
                s = f"cast({s} AS bigint)"
        elif kind == "boolean":
            if k == "string":
                s = f"(CASE WHEN {s} IS NULL THEN NULL WHEN lower(trim({s})) IN ('true', '1') THEN TRUE WHEN lower(trim({s})) IN ('false', '0') THEN FALSE ELSE {fail('22F3H', 'not a boolean', 'boolean')} END)"
            else:
                s = f"cast({s} AS boolean)"
        elif kind == "uuid":
            s = f"(CASE WHEN {s} IS NULL THEN NULL WHEN lower(trim({s})) RLIKE '^[0-9a-f]{{8}}-([0-9a-f]{{4}}-){{3}}[0-9a-f]{{12}}$' THEN lower(trim({s})) ELSE {fail('22F3H', 'not a UUID', 'string')} END)"
        elif kind == "date" and k in INTEGERS:
            s = f"date_from_unix_date(cast({s} AS int))"
        elif kind == "timestamp_ntz" and k in INTEGERS:
            s = f"cast(timestamp_millis({s}) AS timestamp_ntz)"
        else:
            s = f"cast({s} AS {spark_type(kind)})"
        return Expr(s, kind, x.aggregate)

    def on_exists(self, scope, query):
        sql, _ = self.query(query, scope, nested="subquery")
        return Expr(f"EXISTS ({sql})", "boolean")

    def on_scalar(self, scope, query):
        sql, columns = self.query(query, scope, nested="subquery")
        if len(columns) != 1:
            raise SQLError("42601", "a scalar subquery has one column")
        return Expr(f"({sql})", columns[0][1])

    def on_over(self, scope, name, args, by, order):
        raise SQLError("42883", f"{name} OVER")

    def on_call(self, scope, name, args, distinct):
        if name in AGGREGATES:
            return self.aggregate(scope, name, args, distinct)
        xs = [self.expr(a, scope) for a in args]
        agg = any(x.aggregate for x in xs)
        own = self.functions.get(name)
        if own is not None and own["returns"] is not None:
            x = self.expr(own["body"], self.parameters(name, own, xs))
            if family(x.kind) != family(own["returns"]) and x.kind != "null":
                raise SQLError("42804", f"{name} returns {x.kind}")
            return Expr(f"cast({x.sql} AS {spark_type(own['returns'])})", own["returns"], agg)
        out = self.function(name, xs)
        return Expr(out[0], out[1], agg)

    def parameters(self, name: str, own: dict, xs: list[Expr]) -> Scope:
        """The arguments of a call under the names of a function's parameters: its body sees nothing else."""
        if len(xs) != len(own["params"]):
            raise SQLError("42601", f"arguments of {name}")
        columns = []
        for x, (param, kind) in zip(xs, own["params"], strict=True):
            if x.kind != "null" and family(x.kind) != family(kind):
                raise SQLError("42804", f"{param} of {name}: {x.kind} for {kind}")
            columns.append(Column(None, param, kind, f"cast({x.sql} AS {spark_type(kind)})"))
        return Scope(columns)

    def aggregate(self, scope, name, args, distinct):
        if distinct and self.strict:
            raise SQLError("0A000", f"{name}(DISTINCT)")
        if name == "COUNT" and (args == ["*"] or args and args[0].kind in ("number", "text", "null", "bool")):
            return Expr("count(1)", "bigint", True)
        if len(args) != 1 or args == ["*"]:
            raise SQLError("42601", f"arguments of {name}")
        self.inner += 1
        try:
            x = self.expr(args[0], scope)
        finally:
            self.inner -= 1
        if x.aggregate:
            raise SQLError("0A000", "nested aggregates")
        word = "DISTINCT " if distinct else ""
        if name == "COUNT":
            return Expr(f"count({word}{x.sql})", "bigint", True)
        if x.kind not in NUMBERS and x.kind != "null" and (self.strict or name in ("SUM", "AVG")):
            raise SQLError("42804", f"{name} of {x.kind}")
        if name == "SUM":
            return Expr(f"sum({word}{x.sql})", "double" if x.kind in ("float", "double") else "bigint", True)
        if name == "AVG":
            return Expr(f"avg({word}cast({x.sql} AS double))", "double", True)
        return Expr(f"{name.lower()}({x.sql})", x.kind, True)

    def function(self, name: str, xs: list[Expr]) -> tuple[str, str]:
        s, k = [x.sql for x in xs], [x.kind for x in xs]

        def arity(*ok: int) -> None:
            if len(xs) not in ok:
                raise SQLError("42601", f"arguments of {name}")

        def want(which: str, *at: int) -> None:
            for i in at:
                if k[i] != "null" and family(k[i]) != which:
                    raise SQLError("42804", f"{name} of {k[i]}")

        if name in ("COALESCE", "IFNULL"):
            kind = unify(k)
            if kind in ("date", "timestamp_ntz"):
                s = [f"cast({x} AS {kind})" for x in s]
            return f"coalesce({', '.join(s)})", kind
        if name == "NULLIF":
            arity(2)
            if self.strict and not self.inner:  # the dialect knows it in ON and inside aggregates alone
                raise SQLError("42883", name)
            return f"nullif({s[0]}, {s[1]})", k[0]
        if name in ("GREATEST", "LEAST"):
            kind = unify(k)
            if len(s) == 1:
                return s[0], kind
            nothing = " OR ".join(f"{x} IS NULL" for x in s)
            return f"(CASE WHEN {nothing} THEN NULL ELSE {name.lower()}({', '.join(s)}) END)", kind
        if name in ("UPPER", "LOWER", "REVERSE", "TRIM", "LTRIM", "RTRIM"):
            arity(1)
            want("text", 0)
            return f"{name.lower()}({s[0]})", "string"
        if name in ("LENGTH", "LEN", "CHAR_LENGTH", "CHARACTER_LENGTH", "OCTET_LENGTH"):
            arity(1)
            return f"cast({'octet_length' if name == 'OCTET_LENGTH' else 'char_length'}({s[0]}) AS bigint)", "bigint"
        if name in ("SUBSTRING", "SUBSTR"):
            arity(2, 3)
            want("text", 0)
            return f"substring({s[0]}, {', '.join(f'cast({x} AS int)' for x in s[1:])})", "string"
        if name in ("LEFT", "RIGHT"):
            arity(2)
            return f"{name.lower()}({s[0]}, cast({s[1]} AS int))", "string"
        if name == "POSITION":
            arity(2)
            return f"cast(position({s[0]}, {s[1]}) AS bigint)", "bigint"
        if name == "REPLACE":
            arity(3)
            return f"replace({s[0]}, {s[1]}, coalesce({s[2]}, ''))", "string"
        if name == "CONCAT":
            return "concat_ws('', " + ", ".join(f"cast({x} AS string)" for x in s) + ")", "string"
        if name == "CONCAT_WS":
            return f"concat_ws({s[0]}, " + ", ".join(f"cast({x} AS string)" for x in s[1:]) + ")", "string"
        if name == "STARTS_WITH":
            arity(2)
            return f"startswith({s[0]}, {s[1]})", "boolean"
        if name in ("ABS", "SIGN", "FLOOR", "CEIL", "CEILING", "SQRT", "EXP", "LN"):
            arity(1)
            want("number", 0)
            if name == "ABS":
                return f"abs({s[0]})", k[0]
            if name == "SIGN":
                return f"cast(signum(cast({s[0]} AS double)) AS bigint)", "bigint"
            if name in ("FLOOR", "CEIL", "CEILING"):
                kind = "double" if k[0] in ("float", "double") else "bigint"
                return f"cast({'floor' if name == 'FLOOR' else 'ceil'}({s[0]}) AS {kind})", kind
            if name == "SQRT":
                return f"(CASE WHEN {s[0]} < 0 THEN {fail('22023', 'square root of a negative number', 'double')} ELSE sqrt(cast({s[0]} AS double)) END)", "double"
            return f"{name.lower()}(cast({s[0]} AS double))", "double"
        if name == "ROUND":
            arity(1, 2)
            n = s[1] if len(s) > 1 else "0"
            kind = "double" if k[0] in ("float", "double") else "bigint"
            return f"cast(round({s[0]}, cast({n} AS int)) AS {kind})", kind
        if name in ("POWER", "POW"):
            arity(2)
            return f"power(cast({s[0]} AS double), cast({s[1]} AS double))", "double"
        if name == "LOG":
            arity(2)
            return self.arith("/", *[Expr(f"ln(cast({x} AS double))", "double") for x in (s[1], s[0])]).sql, "double"
        if name == "MOD":
            arity(2)
            x = self.arith("%", *xs)
            return x.sql, x.kind
        if name == "PI":
            return "pi()", "double"
        if name in ("YEAR", "MONTH", "DAY", "DAYOFMONTH", "HOUR", "MINUTE", "SECOND", "DAYOFWEEK", "DAYOFYEAR"):
            arity(1)
            x = f"cast({s[0]} AS timestamp_ntz)" if k[0] == "string" else f"timestamp_millis({s[0]})" if k[0] in INTEGERS else s[0]
            return f"cast({name.lower()}({x}) AS bigint)", "bigint"
        if name in ("CURRENT_DATE", "CURRENT_TIMESTAMP", "LOCALTIME", "CURRENT_TIME", "LOCALTIMESTAMP"):
            return ("current_date()", "date") if name == "CURRENT_DATE" else ("localtimestamp()", "timestamp_ntz")
        if name == "CURRENT_USER":
            return "''", "string"
        if name == "CARDINALITY":
            arity(1)
            return f"cast(size({s[0]}) AS bigint)", "bigint"
        if name == "ARRAY_DISTINCT":
            arity(1)
            return f"array_distinct({s[0]})", k[0]
        if name in DISTANCES:
            arity(2)
            return distance_sql(DISTANCES[name], *s), "double"
        raise SQLError("42883", name)


#: Stands before a character that an escape has made literal while a computed pattern is rewritten; no character of any text.
MARK = "\ufdd0"


def computed_pattern(p: str, escape: str | None) -> str:
    """A LIKE pattern that is only known at run time, with Spark's own escape in place of the dialect's."""
    backslash, two = text("\\"), text("\\\\")
    if escape is None:
        return f"replace({p}, {backslash}, {two})"
    e = "\\" + escape if not escape.isalnum() else escape
    marked = f"regexp_replace({p}, {text(e + '([\\s\\S])')}, {text(MARK + '$1')})"
    doubled = f"replace({marked}, {backslash}, {two})"
    done = f"replace(regexp_replace({doubled}, {text(MARK + '([%_])')}, {text(chr(92) * 2 + '$1')}), {text(MARK)}, '')"
    open_end = f"regexp_like({marked}, {text('(^|[^' + MARK + '])' + e + '$')})"
    return f"(CASE WHEN {open_end} THEN {fail('22023', 'the pattern ends in its escape', 'string')} ELSE {done} END)"


def distance_sql(metric: str, a: str, b: str) -> str:
    x, y = f"cast({a} AS array<double>)", f"cast({b} AS array<double>)"
    dot = lambda u, v: f"aggregate(zip_with({u}, {v}, (p, r) -> p * r), 0D, (t, p) -> t + p)"
    square = f"aggregate(zip_with({x}, {y}, (p, r) -> (p - r) * (p - r)), 0D, (t, p) -> t + p)"
    norms = f"(sqrt({dot(x, x)}) * sqrt({dot(y, y)}))"
    cosine = f"(CASE WHEN {norms} = 0D THEN 1D ELSE 1D - greatest(-1D, least(1D, {dot(x, y)} / nullif({norms}, 0D))) END)"
    return {"euclidean": f"sqrt({square})", "euclidean_square": square, "cosine": cosine, "dot_product": f"(-{dot(x, y)})"}[metric]
