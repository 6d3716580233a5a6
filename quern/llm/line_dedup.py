"""Line dedup by overlapping windows of three lines.

Every run of three consecutive lines of a text is hashed (128 bits). A window that occurs more than once in the corpus
keeps its first occurrence, in the order of (doc_id, hash of the text, line); every later one covers
its three lines, and the union of the covered lines is removed. A line that is removed has an equal line earlier
that stays. Windows of three blank lines do not count.

Windows are hashed once and written. Hot ones are counted with partial aggregates, and only repeated windows are joined back; that join's
two sides are plain exchanges, so that adaptive execution can split a window that stands in very many
texts. All steps are JVM-side.

Nulls: a null text stays null and has no lines. Texts of fewer than three lines have no window and stay as
they are. Rows with the same id and text count as one document and get the same result. Null doc_ids come first. Other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, packed, unpacked

WINDOW = 3


def lines_of(text):
    return F.split(text, "\n", -1)


def windows(documents: DataFrame) -> DataFrame:
    """doc, mark, at, k1, k2: every window of three lines that are not all blank."""
    at = F.expr(f"sequence(0, size(_lines) - {WINDOW})")
    rows = (
        documents.where("text is not null")
        .select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("mark"), lines_of("text").alias("_lines"))
        .where(F.size("_lines") >= WINDOW)
        .select("doc", "mark", "_lines", F.explode(at).alias("at"))
    )
    three = [F.get(F.col("_lines"), F.col("at") + i) for i in range(WINDOW)]
    blank = F.length(F.trim(F.concat(*three))) == 0
    return rows.where(~blank).select("doc", "mark", "at", F.xxhash64(*three).alias("k1"), F.xxhash64(F.lit(7), *three[::-1]).alias("k2"))


def covered(documents: DataFrame) -> DataFrame:
    """doc, mark, starts: where later occurrences of repeated windows begin in each document."""
    found = cut(windows(documents), "windows")
    place = F.struct("doc", "mark", "at")
    repeated = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    later = found.join(repeated, ["k1", "k2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc", "mark").agg(F.collect_set("at").alias("starts"))


def dedup(documents: DataFrame) -> DataFrame:
    """row (the caller's columns), text without the covered lines, n_lines, n_removed."""
    rows = packed(documents).withColumn("key", F.xxhash64("row.text"))
    starts = covered(documents)
    joined = rows.join(starts, (F.col("key") == F.col("mark")) & F.col("row.doc_id").eqNullSafe(F.col("doc")), "left")
    lines = joined.select("row", "starts", lines_of(F.col("row.text")).alias("lines"))
    out = F.array_distinct(F.flatten(F.transform("starts", lambda s: F.sequence(s, s + (WINDOW - 1)))))
    lines = lines.withColumn("out", F.when(F.col("starts").isNull(), F.lit(None)).otherwise(out))
    kept = F.transform(F.array_except(F.expr("sequence(0, size(lines) - 1)"), F.col("out")), lambda i: F.get(F.col("lines"), i))
    text = F.when(F.col("out").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return lines.select("row", text.alias("text"), count("lines").alias("n_lines"), count("out").alias("n_removed"))


def clean(documents: DataFrame) -> DataFrame:
    """``documents``, same columns, without repeated three-line passages."""
    return unpacked(dedup(documents), documents, text=F.col("text"))


def report(documents: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, text."""
    return dedup(documents.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_removed", "text")


#: The same in SQL, over whole lines instead of hashes.
SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i, ls[i] AS a, ls[i + 1] AS b, ls[i + 2] AS c FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l WHERE len(ls) >= 3) AS x),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS n FROM w WHERE length(trim(concat(a, b, c))) > 0),
o AS (SELECT DISTINCT doc_id, i + k AS j FROM r, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1),
e AS (SELECT doc_id, j, ls[j] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS j FROM l) AS y),
k AS (SELECT e.doc_id, string_agg(e.line, chr(10) ORDER BY e.j) AS text, count(*) AS n FROM e LEFT JOIN o ON e.doc_id = o.doc_id AND e.j = o.j WHERE o.j IS NULL GROUP BY e.doc_id)
SELECT l.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l.ls), 0) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""
