"""Scalar functions and expression values, each over a table with nulls and edge rows made from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import scalar as S
from quern.queries.registry import Tables, query

#: k, a and b (integers with nulls and negatives), x and y (doubles with nulls and zeros), s (text with nulls and blanks), ts.
BASE = """(SELECT p_partkey AS k,
 CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_size - 25 AS BIGINT) END AS a,
 CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE CAST(p_partkey % 9 - 4 AS BIGINT) END AS b,
 CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice - 1000.5 END AS x,
 CASE WHEN p_partkey % 5 = 0 THEN 0.0 ELSE CAST(p_size AS DOUBLE) / 4 END AS y,
 CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE concat('  ', p_name, CASE WHEN p_partkey % 2 = 0 THEN ' é ' ELSE '' END) END AS s FROM part) AS base"""


def base(t: Tables) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return t.part.select(
        k.alias("k"),
        F.when(k % 11 != 0, (size - 25).cast("long")).alias("a"),
        F.when(k % 13 != 0, (k % 9 - 4).cast("long")).alias("b"),
        F.when(k % 7 != 0, F.col("p_retailprice") - 1000.5).alias("x"),
        F.when(k % 5 == 0, F.lit(0.0)).otherwise(size.cast("double") / 4).alias("y"),
        F.when(k % 17 != 0, F.concat(F.lit("  "), F.col("p_name"), F.when(k % 2 == 0, " é ").otherwise(""))).alias("s"),
    )


def scalar(name: str, sql: str, columns: Callable[[], dict[str, Column]]) -> None:
    """Register ``fn_name``: k and these columns, against the SQL's."""
    query(f"SELECT k, {sql} FROM {BASE}", name=f"fn_{name}")(lambda t: base(t).select("k", *[x.alias(n) for n, x in columns().items()]))


c = F.col
scalar("add_sub_mul", "a + b AS p, a - b AS m, a * b AS t", lambda: dict(p=c("a") + c("b"), m=c("a") - c("b"), t=c("a") * c("b")))
scalar("int_div", "CASE WHEN b = 0 THEN NULL ELSE CAST(trunc(a / b) AS BIGINT) END AS d", lambda: dict(d=F.when(c("b") != 0, S.int_div("a", "b"))))
scalar("double_div", "CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN y = 0 AND x > 0 THEN 'inf' WHEN y = 0 AND x < 0 THEN '-inf' WHEN y = 0 THEN 'nan' ELSE CAST(CAST(round(x / y, 3) * 1000 AS BIGINT) AS VARCHAR) END AS d", lambda: dict(d=F.when(F.isnan(S.double_div("x", "y")), "nan").when(S.double_div("x", "y") == float("inf"), "inf").when(S.double_div("x", "y") == float("-inf"), "-inf").otherwise((F.round(S.double_div("x", "y"), 3) * 1000).cast("decimal(30,0)").cast("string"))))
scalar("mod", "CASE WHEN b = 0 THEN NULL ELSE a % b END AS m, CASE WHEN y = 0 THEN NULL ELSE round(x % y, 6) END AS z", lambda: dict(m=F.when(c("b") != 0, S.int_mod("a", F.nullif(c("b"), F.lit(0)))), z=F.when(c("y") != 0, F.round(S.double_mod("x", "y"), 6))))
scalar("text_plus", "s || 'x' AS t", lambda: dict(t=S.plus_text("s", F.lit("x"))))
scalar("bitwise", "a & b AS i, a | b AS o, xor(a, b) AS e", lambda: dict(i=c("a").bitwiseAND(c("b")), o=c("a").bitwiseOR(c("b")), e=c("a").bitwiseXOR(c("b"))))
scalar("cast_double_to_bigint", "CAST(floor(x * 2.5 + 0.5) AS BIGINT) AS i", lambda: dict(i=S.to_bigint(c("x") * 2.5)))
scalar("cast_text_to_bigint", "CAST(trim(' ' || CAST(a AS VARCHAR) || ' ') AS BIGINT) AS i", lambda: dict(i=F.when(c("a").isNotNull(), S.text_to_bigint(F.concat(F.lit(" "), F.coalesce(c("a"), F.lit(0)).cast("string"), F.lit(" "))))))
scalar("cast_to_text", "CAST(a AS VARCHAR) AS i, CAST(a > b AS VARCHAR) AS f", lambda: dict(i=S.to_text("a", "bigint"), f=S.to_text(c("a") > c("b"), "boolean")))
scalar("cast_boolean", "b <> 0 AS f, CASE WHEN a % 2 = 0 THEN TRUE WHEN a IS NULL THEN NULL ELSE FALSE END AS g", lambda: dict(f=c("b").cast("boolean"), g=S.text_to_boolean(F.when(c("a") % 2 == 0, "TRUE").when(c("a").isNotNull(), "0"))))
scalar("case_searched", "CASE WHEN a > 10 THEN 'high' WHEN a > 0 THEN 'low' ELSE 'none' END AS g", lambda: dict(g=F.when(c("a") > 10, "high").when(c("a") > 0, "low").otherwise("none")))
scalar("case_simple", "CASE b WHEN 1 THEN 'one' WHEN NULL THEN 'never' ELSE 'other' END AS g", lambda: dict(g=F.when(c("b") == 1, "one").otherwise("other")))
scalar("case_types", "CASE WHEN a > 0 THEN CAST(a AS DOUBLE) ELSE y END AS v", lambda: dict(v=F.when(c("a") > 0, c("a").cast("double")).otherwise(c("y"))))
scalar("coalesce", "coalesce(a, b, 99) AS v", lambda: dict(v=F.coalesce("a", "b", F.lit(99).cast("long"))))
scalar("nullif", "nullif(a, b) AS v", lambda: dict(v=F.nullif("a", "b")))
scalar("greatest_least", "CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE greatest(a, b, CAST(0 AS BIGINT)) END AS g, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE least(a, b) END AS l", lambda: dict(g=S.greatest("a", "b", F.lit(0).cast("long")), l=S.least("a", "b")))
scalar("case_letters", "upper(s) AS u, lower(s) AS l", lambda: dict(u=F.upper("s"), l=F.lower("s")))
scalar("lengths", "CAST(length(s) AS INTEGER) AS n, CAST(octet_length(encode(s)) AS INTEGER) AS o", lambda: dict(n=F.char_length("s"), o=F.octet_length("s")))
scalar("substring", "substring(s, 3, 4) AS a3, substring(s, 5) AS a5, left(s, 5) AS l, right(s, 3) AS r", lambda: dict(a3=F.substring("s", 3, 4), a5=F.expr("substring(s, 5)"), l=F.left(c("s"), F.lit(5)), r=F.right(c("s"), F.lit(3))))
scalar("position", "CAST(strpos(s, 'a') AS INTEGER) AS p", lambda: dict(p=F.position(F.lit("a"), c("s"))))
scalar("reverse_replace", "reverse(s) AS r, replace(s, 'a', '') AS d, replace(s, 'e', 'E') AS u", lambda: dict(r=F.reverse("s"), d=S.replace("s", F.lit("a"), F.lit(None).cast("string")), u=S.replace("s", F.lit("e"), F.lit("E"))))
scalar("trim", "trim(s) AS t, ltrim(s) AS l, rtrim(s) AS r", lambda: dict(t=F.trim("s"), l=F.ltrim("s"), r=F.rtrim("s")))
scalar("concat", "concat(s, '-', a) AS v, concat_ws('/', s, a, b) AS w", lambda: dict(v=S.concat("s", F.lit("-"), "a"), w=F.concat_ws("/", c("s"), c("a").cast("string"), c("b").cast("string"))))
scalar("abs_sign", "abs(a) AS v, CAST(sign(a) AS BIGINT) AS g", lambda: dict(v=F.abs("a"), g=F.signum("a").cast("long")))
scalar("floor_ceil", "floor(x) AS f, ceil(x) AS e", lambda: dict(f=S.floor("x"), e=S.ceil("x")))
scalar("round", "round(x, 1) AS r, CAST(round(a, -1) AS BIGINT) AS t", lambda: dict(r=F.round("x", 1), t=F.round("a", -1).cast("long")))
scalar("roots_powers", "round(sqrt(abs(x)), 6) AS q, round(power(y, 2), 6) AS p", lambda: dict(q=F.round(S.sqrt(F.abs("x")), 6), p=F.round(F.pow(c("y"), F.lit(2.0)), 6)))
scalar("logs", "round(exp(y / 10), 6) AS e, round(ln(y + 1), 6) AS n, round(ln(y + 1) / ln(2.0), 6) AS l, round(pi(), 8) AS pi", lambda: dict(e=F.round(F.exp(c("y") / 10), 6), n=F.round(F.ln(c("y") + 1), 6), l=F.round(S.log(F.lit(2.0), c("y") + 1), 6), pi=F.round(F.pi(), 8)))
scalar("arrays", "CAST(len([a, b, 3]) AS INTEGER) AS n, [a, b, 3][2] AS second, CAST(len(list_distinct([b, 1, 1, 2])) AS INTEGER) + CASE WHEN b IS NULL THEN 1 ELSE 0 END AS d", lambda: dict(n=F.cardinality(F.array("a", "b", F.lit(3).cast("long"))), second=S.subscript(F.array("a", "b", F.lit(3).cast("long")), F.lit(2)), d=F.cardinality(F.array_distinct(F.array("b", F.lit(1).cast("long"), F.lit(1).cast("long"), F.lit(2).cast("long"))))))
scalar("first_or_default", "coalesce(CASE WHEN a > 0 THEN a END, CAST(-1 AS BIGINT)) AS v", lambda: dict(v=S.first_or_default(F.filter(F.array("a"), lambda v: v > 0), F.lit(-1).cast("long"))))
scalar("pick", "CASE WHEN a > 10 THEN 'A' WHEN a > 0 THEN 'B' END AS v", lambda: dict(v=S.pick(S.condition_selector(c("a") > 10, c("a") > 0), F.lit("A"), F.lit("B"))))


@query(f"SELECT k, a, rank() OVER (ORDER BY a ASC NULLS FIRST) AS up, rank() OVER (ORDER BY a DESC NULLS LAST) AS down FROM {BASE}", name="fn_ordered_bytes")
def ordered_bytes(t: Tables) -> DataFrame:
    from quern.operators.indexes import ranks

    rows = base(t).withColumns({"u": S.ordered_bytes("a"), "d": S.ordered_bytes("a", descending=True, nulls_last=True)})
    up = ranks(rows, [], "u", count_duplicates=True).withColumnRenamed("rank", "up")
    both = ranks(up, [], "d", count_duplicates=True)
    return both.select("k", S.from_ordered_bytes("u").alias("a"), (F.col("up") + 1).alias("up"), (F.col("rank") + 1).alias("down"))


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS mo, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(dayofweek(ts) + 1 AS INTEGER) AS w, CAST(dayofyear(ts) AS INTEGER) AS yd FROM events")
def fn_date_parts(t: Tables) -> DataFrame:
    ts = F.col("ts")
    return t.events.select("event_id", F.year(ts).alias("y"), F.month(ts).alias("mo"), F.dayofmonth(ts).alias("d"), F.hour(ts).alias("h"), F.minute(ts).alias("mi"), F.second(ts).alias("s"), F.dayofweek(ts).alias("w"), F.dayofyear(ts).alias("yd"))


@query("SELECT TRUE AS same, '' AS who")
def fn_statement_clock(t: Tables) -> DataFrame:
    now = F.current_timestamp()
    return t.spark.range(1).select((now == F.current_timestamp()).alias("same"), F.lit("").alias("who"))


@query("SELECT n_nationkey AS k, lower(printf('%08x-0000-4000-8000-%012x', n_nationkey, n_regionkey)) AS u FROM nation")
def fn_uuid(t: Tables) -> DataFrame:
    text = F.format_string("%08X-0000-4000-8000-%012X", F.col("n_nationkey"), F.col("n_regionkey"))
    return t.nation.select(F.col("n_nationkey").alias("k"), S.uuid_text(text).alias("u"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.page') AS VARCHAR) AS page FROM events")
def ext_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.page").alias("page"))
