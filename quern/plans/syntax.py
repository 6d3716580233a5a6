"""The dialect's grammar: text to a tree.

Operators of one class have one precedence and associate to the left: bitwise binds tightest, then arithmetic (so 2 + 3 * 4 is
20), then comparison, then logic (so a OR b AND c is (a OR b) AND c). There is no unary minus but in number literals. Names fold
to upper case unless quoted.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass, field
from typing import Any

from quern.errors import SQLError

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*)|(?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<bytes>(?:[xX]|[bB]64)'[^']*')|(?P<text>'(?:[^']|'')*')|(?P<quoted>"(?:[^"]|"")*")|(?P<name>[A-Za-z_][A-Za-z0-9_$]*)
    |(?P<op><=>|<>|!=|<=|>=|<<|>>|\|\||&&|[-+*/%&|^=<>(),.\[\]?;~!:@])""",
    re.X,
)


@dataclass
class Token:
    kind: str
    value: str
    at: int

    def is_(self, *words: str) -> bool:
        return self.kind == "name" and self.value.upper() in words or self.kind == "op" and self.value in words


def lex(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SQLError("42601", f"unexpected {text[at]!r}")
        if m.lastgroup != "space":
            out.append(Token(m.lastgroup, m.group(), at))
        at = m.end()
    return [*out, Token("end", "", at)]


@dataclass
class Node:
    """An expression: its kind and parts."""

    kind: str
    parts: tuple = ()

    def walk(self):
        yield self
        for p in self.parts:
            for x in p if isinstance(p, (list, tuple)) else [p]:
                if isinstance(x, Node):
                    yield from x.walk()
                elif isinstance(x, tuple):
                    for y in x:
                        if isinstance(y, Node):
                            yield from y.walk()


@dataclass
class Select:
    items: list[tuple[Node, str | None]]
    source: Any = None
    where: Node | None = None
    group: list[tuple[Node, str | None]] = field(default_factory=list)
    having: Node | None = None
    qualify: Node | None = None
    distinct: bool = False


@dataclass
class Query:
    body: Any  # Select, or ("union", all, left, right)
    order: list[tuple[Node, bool, bool | None]] = field(default_factory=list)
    limit: Node | None = None
    offset: Node | None = None
    ctes: list[dict] = field(default_factory=list)
    recursive: bool = False


@dataclass
class Statement:
    kind: str
    parts: dict


# Words that end an expression or a table reference, so that they are no aliases.
RESERVED = set(
    "SELECT FROM WHERE GROUP BY HAVING QUALIFY ORDER LIMIT OFFSET UNION ALL DISTINCT JOIN INNER LEFT RIGHT FULL OUTER CROSS ON USING AND OR XOR NOT IS IN BETWEEN LIKE ESCAPE CASE WHEN THEN ELSE END AS NULL TRUE FALSE EXISTS CAST SET VALUES INTO DIV MOD ASC DESC NULLS INTERSECT EXCEPT WITH RETURNING OPTIONS AT OVER PARTITION TRAVERSAL NATURAL".split()
)


class Parser:
    def __init__(self, text: str):
        self.tokens, self.i = lex(text), 0

    @property
    def now(self) -> Token:
        return self.tokens[self.i]

    def at(self, *words: str) -> bool:
        return self.now.is_(*words)

    def follows(self, *words: str) -> bool:
        return all(t.is_(w) for t, w in zip(self.tokens[self.i :], words, strict=False)) and len(self.tokens) - self.i > len(words)

    def take(self, *words: str) -> bool:
        if self.follows(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        for w in words:
            if not self.take(w):
                self.wrong(f"expected {w}")

    def wrong(self, message: str = "", state: str = "42601"):
        raise SQLError(state, f"{message} near {self.now.value!r}".strip())

    def name(self) -> str:
        t = self.now
        if t.kind == "quoted":
            self.i += 1
            return t.value[1:-1].replace('""', '"')
        if t.kind != "name" or t.value.upper() in RESERVED:
            self.wrong("expected a name")
        self.i += 1
        return t.value.upper()

    def list_of(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # queries

    def query(self) -> Query:
        ctes, recursive = [], False
        if self.take("WITH"):
            recursive = self.take("RECURSIVE")
            ctes = self.list_of(self.cte)
        body = self.branch()
        while self.at("UNION", "INTERSECT", "EXCEPT"):
            if not self.take("UNION"):
                self.wrong("not in the dialect:")
            whole = self.take("ALL")
            if not whole:
                self.take("DISTINCT")
            body = ("union", whole, body, self.branch())
        out = Query(body, ctes=ctes, recursive=recursive)
        if self.take("ORDER", "BY"):
            out.order = self.list_of(self.order_key)
        if self.take("LIMIT"):
            out.limit = self.count()
            if self.take("OFFSET"):
                out.offset = self.count()
        elif self.at("OFFSET"):
            self.wrong("OFFSET follows LIMIT")
        return out

    def count(self) -> Node:
        if self.at("-"):
            self.wrong("a negative count")
        return self.primary()

    def order_key(self) -> tuple[Node, bool, bool | None]:
        e = self.expression()
        down = self.take("DESC") or (self.take("ASC") and False)
        first = None
        if self.take("NULLS", "FIRST"):
            first = True
        elif self.take("NULLS", "LAST"):
            first = False
        return e, bool(down), first

    def cte(self) -> dict:
        name, columns = self.name(), None
        if self.take("("):
            columns = self.list_of(self.name)
            self.need(")")
        self.need("AS", "(")
        body = self.query()
        self.need(")")
        order = None
        if self.take("TRAVERSAL", "ORDER"):
            order = self.name().lower()
            if order not in ("level_order", "pre_order", "post_order"):
                self.wrong("unknown traversal order")
        return {"name": name, "columns": columns, "query": body, "traversal": order}

    def branch(self):
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        return self.select()

    def select(self) -> Select:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        out = Select(self.list_of(self.item), distinct=distinct)
        if not self.take("FROM"):
            whole = self.now.kind == "end" or self.at(")", ";", "UNION", "ORDER", "LIMIT")
            self.wrong("a query needs FROM", "0AF00" if whole else "42601")
        out.source = self.sources()
        if self.take("WHERE"):
            out.where = self.expression()
        if self.take("GROUP", "BY"):
            out.group = self.list_of(self.group_key)
        if self.take("HAVING"):
            out.having = self.expression()
        if self.take("QUALIFY"):
            out.qualify = self.expression()
        return out

    def group_key(self) -> tuple[Node, str | None]:
        e = self.expression()
        return e, self.name() if self.take("AS") else None

    def item(self) -> tuple[Node, str | None]:
        if self.take("*"):
            return Node("star", (None,)), None
        if self.now.kind in ("name", "quoted") and self.tokens[self.i + 1].is_(".") and self.tokens[self.i + 2].is_("*"):
            q = self.name()
            self.need(".", "*")
            return Node("star", (q,)), None
        e = self.expression()
        if self.take("AS"):
            return e, self.name()
        return e, self.name() if self.now.kind == "quoted" or self.now.kind == "name" and self.now.value.upper() not in RESERVED else None

    def sources(self):
        left = self.joined()
        while self.take(","):
            left = ("join", "cross", left, self.joined(), None, None)
        return left

    def joined(self):
        left = self.source()
        while True:
            kind = None
            if self.at("NATURAL"):
                self.wrong("not in the dialect:")
            if self.take("CROSS", "JOIN"):
                left = ("join", "cross", left, self.source(), None, None)
                continue
            if self.take("INNER", "JOIN") or self.take("JOIN"):
                kind = "inner"
            else:
                for word in ("LEFT", "RIGHT", "FULL"):
                    if self.take(word, "OUTER", "JOIN") or self.take(word, "JOIN"):
                        kind = word.lower()
            if kind is None:
                return left
            right = self.source()
            if self.take("ON"):
                left = ("join", kind, left, right, self.expression(), None)
            elif self.take("USING"):
                self.need("(")
                left = ("join", kind, left, right, None, self.list_of(self.name))
                self.need(")")
            elif kind == "inner":
                left = ("join", "cross", left, right, None, None)
            else:
                self.wrong("an outer join needs ON")

    def source(self):
        if self.take("("):
            q = self.query() if self.at("SELECT", "WITH", "(") else self.wrong("expected a query")
            self.need(")")
            self.take("AS")
            alias = self.name()
            columns = None
            if self.take("("):
                columns = self.list_of(self.name)
                self.need(")")
            return ("derived", q, alias, columns)
        path = [self.name()]
        if self.take("("):
            args = [] if self.at(")") else self.list_of(self.expression)
            self.need(")")
            return ("function", path[0], args, self.alias() or path[0])
        while self.take("."):
            path.append(self.name())
        alias = self.alias()
        ordinal = self.name() if self.take("AT") else None
        return ("table", path, alias, ordinal)

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        return self.name() if self.now.kind == "quoted" or self.now.kind == "name" and self.now.value.upper() not in RESERVED else None

    # expressions

    def expression(self) -> Node:
        left = self.negated()
        while self.at("AND", "OR", "XOR", "&&", "||"):
            op = {"&&": "AND", "||": "OR"}.get(self.now.value, self.now.value.upper())
            self.i += 1
            left = Node("logic", (op, left, self.negated()))
        return left

    def negated(self) -> Node:
        if self.take("NOT") or self.take("!"):
            return Node("not", (self.negated(),))
        return self.predicate()

    def predicate(self) -> Node:
        left = self.arithmetic()
        while True:
            if self.at("<=>"):
                self.wrong("not in the dialect:")
            if self.at("=", "<>", "!=", "<", "<=", ">", ">="):
                op = self.now.value
                self.i += 1
                left = Node("compare", ("<>" if op == "!=" else op, left, self.arithmetic()))
            elif self.take("IS"):
                no = self.take("NOT")
                if self.take("NULL"):
                    left = Node("is_null", (left, no))
                elif self.at("TRUE", "FALSE"):
                    left = Node("is_truth", (left, self.now.value.upper(), no))
                    self.i += 1
                elif self.take("DISTINCT", "FROM"):
                    left = Node("distinct", (left, self.arithmetic(), not no))
                else:
                    self.wrong()
            elif self.at("NOT", "IN", "BETWEEN", "LIKE"):
                no = self.take("NOT")
                if self.take("IN"):
                    self.need("(")
                    if self.at("SELECT", "WITH"):
                        self.wrong("IN with a query; write EXISTS", "0AF00" if self.at("SELECT") else "42601")
                    if self.at(")"):
                        self.wrong("an empty list")
                    left = Node("in", (left, self.list_of(self.expression), no))
                    self.need(")")
                elif self.take("BETWEEN"):
                    low = self.arithmetic()
                    self.need("AND")
                    left = Node("between", (left, low, self.arithmetic(), no))
                elif self.take("LIKE"):
                    pattern = self.arithmetic()
                    left = Node("like", (left, pattern, self.arithmetic() if self.take("ESCAPE") else None, no))
                else:
                    self.wrong()
            else:
                return left

    def arithmetic(self) -> Node:
        left = self.bits()
        while self.at("+", "-", "*", "/", "%", "DIV", "MOD"):
            op = {"MOD": "%"}.get(self.now.value.upper(), self.now.value.upper())
            self.i += 1
            left = Node("arith", (op, left, self.bits()))
        return left

    def bits(self) -> Node:
        left = self.postfix()
        while self.at("&", "|", "^", "<<", ">>"):
            op = self.now.value
            if op in ("<<", ">>"):
                self.wrong("no shifts", "42883")
            self.i += 1
            left = Node("bits", (op, left, self.postfix()))
        return left

    def postfix(self) -> Node:
        e = self.primary()
        while self.take("["):
            e = Node("subscript", (e, self.expression()))
            self.need("]")
        return e

    def primary(self) -> Node:
        t = self.now
        if t.kind == "number":
            self.i += 1
            return Node("number", (t.value,))
        if self.at("-", "+") and self.tokens[self.i + 1].kind == "number":
            self.i += 2
            return Node("number", (("-" if t.value == "-" else "") + self.tokens[self.i - 1].value,))
        if t.kind == "text":
            self.i += 1
            return Node("text", (t.value[1:-1].replace("''", "'"),))
        if t.kind == "bytes":
            self.i += 1
            if t.value[0] in "bB":
                try:
                    return Node("bytes", (base64.b64decode(t.value[4:-1], validate=True).hex(),))
                except ValueError:
                    raise SQLError("22F03", "not base 64") from None
            return Node("bytes", (t.value[2:-1],))
        if self.take("NULL"):
            return Node("null")
        if self.at("TRUE", "FALSE"):
            self.i += 1
            return Node("bool", (t.value.upper(),))
        if self.take("("):
            if self.at("SELECT", "WITH"):
                q = self.query()
                self.need(")")
                return Node("scalar", (q,))
            e = self.expression()
            if self.at(","):
                self.wrong("row values", "0AF00")
            self.need(")")
            return Node("paren", (e,))
        if self.take("["):
            items = [] if self.at("]") else self.list_of(self.expression)
            self.need("]")
            return Node("array", (items,))
        if self.take("EXISTS"):
            self.need("(")
            q = self.query()
            self.need(")")
            return Node("exists", (q,))
        if self.take("CASE"):
            return self.case()
        if self.take("CAST"):
            self.need("(")
            e = self.expression()
            self.need("AS")
            kind = self.type_name()
            self.need(")")
            return Node("cast", (e, kind))
        if t.kind in ("name", "quoted"):
            following = self.tokens[self.i + 1]
            if t.kind == "name" and t.value.upper() == "ARRAY" and following.is_("["):
                self.i += 1
                return self.primary()
            if t.kind == "name" and following.is_("(") and (t.value.upper() not in RESERVED or t.value.upper() in ("LEFT", "RIGHT", "MOD")):
                return self.call()
            path = [self.name()]
            while self.take("."):
                path.append(self.name())
            return Node("column", (tuple(path),))
        self.wrong()

    def case(self) -> Node:
        operand = None if self.at("WHEN") else self.expression()
        whens = []
        while self.take("WHEN"):
            c = self.expression()
            self.need("THEN")
            whens.append((c, self.expression()))
        if not whens:
            self.wrong()
        other = self.expression() if self.take("ELSE") else None
        self.need("END")
        return Node("case", (operand, whens, other))

    def call(self) -> Node:
        name = self.now.value.upper()
        self.i += 1
        self.need("(")
        if self.take("*"):
            self.need(")")
            return Node("call", (name, ["*"], False))
        distinct = self.take("DISTINCT")
        if name == "TRIM" and self.at("BOTH", "LEADING", "TRAILING"):
            self.wrong("keyword form", "0AF00")
        args = [] if self.at(")") else self.list_of(self.expression)
        if self.at("FROM", "IN", "FOR"):
            self.wrong("keyword form", "0AF00")
        self.need(")")
        if self.take("OVER"):
            return self.over(name, args)
        if name == "POSITION" and len(args) == 1:
            raise SQLError("0AF00", "keyword form")
        return Node("call", (name, args, distinct))

    def over(self, name: str, args: list[Node]) -> Node:
        self.need("(")
        by, order = [], []
        if self.take("PARTITION", "BY"):
            by = self.list_of(self.expression)
        if self.take("ORDER", "BY"):
            order = self.list_of(self.order_key)
        self.need(")")
        return Node("over", (name, args, by, order))

    def type_name(self) -> str:
        words = [self.name()]
        if self.take("("):
            while not self.take(")"):
                self.i += 1
        kind = TYPES.get(words[0])
        if kind is None:
            self.wrong(f"unknown type {words[0]}")
        return f"array<{kind}>" if self.take("ARRAY") else kind

    # statements

    def statement(self) -> Statement | Query:
        t = self.now
        if self.at("SELECT", "(") or self.at("WITH"):
            start = self.i
            if self.at("WITH"):
                depth = 0
                for k in range(self.i, len(self.tokens)):
                    depth += self.tokens[k].is_("(") - self.tokens[k].is_(")")
                    if depth == 0 and self.tokens[k].is_("INSERT", "UPDATE", "DELETE"):
                        self.take("WITH")
                        self.take("RECURSIVE")
                        ctes = self.list_of(self.cte)
                        out = self.change()
                        out.parts["ctes"] = ctes
                        return out
            self.i = start
            return self.query()
        if self.at("INSERT", "UPDATE", "DELETE"):
            return self.change()
        if self.take("START", "TRANSACTION") or self.take("BEGIN"):
            return Statement("begin", {})
        if self.take("COMMIT"):
            return Statement("commit", {})
        if self.take("ROLLBACK"):
            return Statement("rollback", {})
        if self.take("SHOW"):
            what = self.name()
            if what == "SCHEMA":
                self.need("TEMPLATES")
                what = "TEMPLATES"
            return Statement("show", {"what": what})
        if self.take("EXPLAIN"):
            return Statement("explain", {"query": self.query()})
        if self.take("CREATE"):
            return self.create()
        if self.take("DROP"):
            return self.drop()
        self.wrong(f"unknown statement {t.value}")

    def change(self) -> Statement:
        if self.take("INSERT"):
            self.need("INTO")
            parts: dict = {"table": self.table_name(), "columns": None}
            if self.take("("):
                parts["columns"] = self.list_of(self.name)
                self.need(")")
            if self.take("VALUES"):
                parts["rows"] = self.list_of(self.row)
            else:
                if parts["columns"]:
                    self.wrong("a column list before a query", "0AF00")
                parts["query"] = self.query()
            out = Statement("insert", parts)
        elif self.take("UPDATE"):
            parts = {"table": self.table_name(), "alias": self.alias()}
            self.need("SET")
            parts["sets"] = self.list_of(self.assignment)
            parts["where"] = self.expression() if self.take("WHERE") else None
            out = Statement("update", parts)
        else:
            self.need("DELETE", "FROM")
            parts = {"table": self.table_name(), "alias": self.alias(), "where": self.expression() if self.take("WHERE") else None}
            if self.at("LIMIT"):
                self.wrong("DELETE takes no LIMIT", "0AF00")
            out = Statement("delete", parts)
        if self.take("RETURNING"):
            out.parts["returning"] = self.list_of(self.item)
        if self.take("OPTIONS"):
            self.need("(", "DRY", "RUN", ")")
            out.parts["dry"] = True
        return out

    def row(self) -> list[Node]:
        self.need("(")
        out = self.list_of(self.expression)
        self.need(")")
        return out

    def assignment(self) -> tuple[str, Node]:
        c = self.name()
        while self.take("."):
            c = self.name()
        self.need("=")
        if self.at("DEFAULT"):
            self.wrong("SET ... = DEFAULT", "0AF00")
        return c, self.expression()

    def table_name(self) -> list[str]:
        path = [self.name()]
        while self.take("."):
            path.append(self.name())
        return path

    def path(self) -> str:
        """A database path such as /a/b."""
        if self.now.kind == "quoted":
            return self.name()
        out = ""
        while self.take("/"):
            out += "/" + self.name()
        return out or self.name()

    def create(self) -> Statement:
        if self.take("DATABASE"):
            return Statement("create_database", {"path": self.path()})
        if self.take("SCHEMA", "TEMPLATE"):
            name, tables, indexes, views, functions = self.name(), {}, [], {}, {}
            while self.take("CREATE"):
                if self.take("VIEW"):
                    n, body = self.view_definition()
                    views[n] = body
                elif self.take("FUNCTION"):
                    n, body = self.function_definition()
                    functions[n] = body
                elif self.take("TABLE"):
                    t = self.table_definition()
                    if t["name"] in tables:
                        self.wrong("the table is there", "42F07")
                    tables[t["name"]] = t
                else:
                    indexes.append(self.index_definition())
            return Statement("create_template", {"name": name, "tables": tables, "indexes": indexes, "views": views, "functions": functions})
        if self.take("VIEW"):
            name, body = self.view_definition()
            return Statement("create_view", {"name": name, "body": body})
        if self.take("FUNCTION"):
            name, body = self.function_definition()
            return Statement("create_function", {"name": name, "body": body})
        if self.take("SCHEMA"):
            path = self.path()
            self.need("WITH", "TEMPLATE")
            return Statement("create_schema", {"path": path, "template": self.name()})
        self.wrong()

    def view_definition(self) -> tuple[str, Query]:
        name = self.name()
        self.need("AS")
        return name, self.query()

    def function_definition(self) -> tuple[str, dict]:
        """name([IN] parameter type, ...) RETURNS type AS expression, or AS query for a table function."""
        name, params = self.name(), []
        self.need("(")
        while not self.take(")"):
            self.take("IN")
            params.append((self.name(), self.type_name()))
            if not self.at(")"):
                self.need(",")
        returns = self.type_name() if self.take("RETURNS") else None
        self.need("AS")
        return name, {"params": params, "returns": returns, "body": self.expression() if returns is not None else self.query()}

    def table_definition(self) -> dict:
        name = self.name()
        self.need("(")
        columns, pk = [], None
        while True:
            if self.take("PRIMARY", "KEY"):
                self.need("(")
                pk = self.list_of(self.name)
                self.need(")")
            else:
                c = self.name()
                kind = self.type_name()
                null = True
                if self.take("NOT", "NULL"):
                    null = False
                elif self.take("NULL"):
                    pass
                if any(c == x for x, _, _ in columns):
                    self.wrong("the column is there", "42701")
                columns.append((c, kind, null))
            if not self.take(","):
                break
        self.need(")")
        if not columns or not pk:
            self.wrong("a table needs columns and a primary key")
        return {"name": name, "columns": columns, "pk": pk}

    def index_definition(self) -> dict:
        unique, vector = self.take("UNIQUE"), self.take("VECTOR")
        self.need("INDEX")
        out: dict = {"name": self.name(), "unique": unique, "vector": vector}
        if self.take("AS"):
            out["query"] = self.query()
            return out
        if self.take("USING"):
            out["using"] = self.name()
        self.need("ON")
        out["table"] = self.name()
        self.need("(")
        out["columns"] = self.list_of(self.name)
        self.need(")")
        if self.at("INCLUDE"):
            self.wrong("no covering columns", "0A000")
        if self.take("PARTITION", "BY"):
            self.need("(")
            out["partition"] = self.list_of(self.name)
            self.need(")")
        if self.take("OPTIONS"):
            depth = 0
            while not (depth == 1 and self.at(")")):
                depth += self.at("(") - self.at(")")
                self.i += 1
            self.i += 1
        return out

    def drop(self) -> Statement:
        if self.take("DATABASE"):
            return Statement("drop_database", {"path": self.path()})
        if self.take("SCHEMA", "TEMPLATE"):
            return Statement("drop_template", {"name": self.name()})
        if self.take("SCHEMA"):
            return Statement("drop_schema", {"path": self.path()})
        if self.take("VIEW"):
            return Statement("drop_view", {"name": self.name()})
        if self.take("FUNCTION"):
            return Statement("drop_function", {"name": self.name()})
        self.wrong()


# SQL names of column types, and Spark's.
TYPES = {
    "BOOLEAN": "boolean",
    "INTEGER": "int",
    "INT": "int",
    "BIGINT": "bigint",
    "FLOAT": "float",
    "DOUBLE": "double",
    "DECIMAL": "double",
    "STRING": "string",
    "BYTES": "binary",
    "UUID": "uuid",
    "DATE": "date",
    "TIMESTAMP": "timestamp_ntz",
}


def parse(text: str) -> list[Statement | Query]:
    """The statements of a text, separated by semicolons."""
    p, out = Parser(text), []
    while p.take(";"):
        pass
    while p.now.kind != "end":
        out.append(p.statement())
        if p.now.kind != "end" and not p.take(";"):
            p.wrong()
        while p.take(";"):
            pass
    return out


def substitute(text: str, args: list) -> str:
    """``?`` markers replaced by literals, in order."""
    out, last, rest = [], 0, list(args)
    for t in lex(text):
        if t.kind == "op" and t.value == "?":
            if not rest:
                raise SQLError("42601", "too few parameters")
            out += [text[last : t.at], literal(rest.pop(0))]
            last = t.at + 1
    if rest:
        raise SQLError("42601", "too many parameters")
    return "".join([*out, text[last:]])


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, (bytes, bytearray)):
        return f"x'{bytes(v).hex()}'"
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"
