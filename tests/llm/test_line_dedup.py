import random

import duckdb

from quern.llm import line_dedup
from tests.conftest import SF, frame


def brute(rows):
    """rows: (id, text) with distinct ids."""
    first, out = {}, {}
    for i, t in sorted(rows):
        if t is None:
            out[i] = None
            continue
        lines, gone = t.split("\n"), set()
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if "".join(w).strip(" ") and first.setdefault(w, (i, k)) != (i, k):
                gone |= {k, k + 1, k + 2}
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_against_brute_force(spark):
    g = random.Random(5)
    rows = [(i, "\n".join(g.choice("abcd") for _ in range(g.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "x\n" * 500), (104, "one line"), (105, "\n".join(map(str, range(3000)))), (106, "\n".join(map(str, range(3000))))]
    docs = frame(spark, [(i, t, 1) for i, t in rows], "doc_id long, text string, starts int").repartition(4)
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == brute(rows)


def test_repeats_ties_and_nulls(spark):
    t = "a\nb\nc\nd"
    rows = [(1, t), (1, t), (None, t), (2, t + "\ne")]
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in line_dedup.clean(frame(spark, rows, "doc_id long, text string")).collect()))
    assert got == [(0, t), (1, ""), (1, ""), (2, "e")]
    assert line_dedup.clean(frame(spark, [], "doc_id long, text string")).count() == 0


def test_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(line_dedup.SQL).fetchall())
    got = sorted(map(tuple, line_dedup.report(spark.read.parquet(f"{SF}/documents.parquet")).collect()))
    assert got == want and any(r[2] for r in want)


def test_columns_with_the_names_used_inside(spark):
    names = "row key lines starts out doc mark at _key _lines _starts _out _n_lines n_lines".split()
    rows = [(i, "a\nb\nc\nd", *[f"{n}{i}" for n in names]) for i in (1, 2)]
    docs = frame(spark, rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.clean(docs)
    assert out.columns == docs.columns and sorted(map(tuple, out.collect())) == [rows[0], (2, "", *rows[1][2:])]
