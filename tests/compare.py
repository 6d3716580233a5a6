"""Run queries against their SQL on DuckDB and compare rows as bags: columns by name, doubles to nine digits."""

import sys
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v + 0.0:.9g}" if v not in (float("inf"), float("-inf")) else str(v)
    if isinstance(v, Decimal):
        return plain(float(v))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return str(v) if v is not None else None


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(str(plain(r[i])) for i in order) for r in rows))


def differs(df, con, sql):
    """What is different, or nothing."""
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return f"columns {got_names} for {want_names}"
    if want != got:
        extra = [r for r in got if r not in set(want)][:2]
        less = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows for {len(want)}; only here {extra}, only there {less}"
    return ""


if __name__ == "__main__":
    import time

    import __spark_entry__ as entry
    from quern.session import session

    sf = sys.argv[1]
    spark = session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name, f in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = f(spark, sf)
            says = differs(df, con, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            says = f"{type(e).__name__}: {str(e)[:300]}"
        if says:
            bad += not says.startswith("no SQL")
            print(name, round(time.time() - t, 1), says[:600], flush=True)
    print("bad:", bad)
