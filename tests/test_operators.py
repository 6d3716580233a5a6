import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.errors import SQLError
from quern.functions import scalar as S
from quern.operators import indexes as I
from quern.operators import recursive as rec
from quern.operators import relational as R
from quern.operators import text as X
from quern.operators import vectors as V
from quern.queries import QUERIES
from quern.sources import tables as T
from tests.conftest import SF, frame


def test_scalar_subquery_rules(spark):
    rows = frame(spark, [(1,), (2,)], "a long")
    assert R.scalar(rows.where("a > 5"), "a") is None and R.scalar(rows.where("a = 2"), "a") == 2
    with pytest.raises(SQLError, match="21000"):
        R.scalar(rows, "a")


def test_default_on_empty(spark):
    rows = frame(spark, [(1, "x")], "a long, b string")
    assert R.default_on_empty(rows, {"a": 9}).collect() == rows.collect()
    assert [tuple(r) for r in R.default_on_empty(rows.where("a > 5"), {"a": 9}).collect()] == [(9, None)]


def test_union_rules(spark):
    a, b = frame(spark, [(1, "x")], "a long, b string"), frame(spark, [(1,)], "a long")
    with pytest.raises(SQLError, match="42F64"):
        R.union_all(a, b)
    with pytest.raises(SQLError, match="42F65"):
        R.union_all(a.select("a"), a.select("b"))


def test_endless_recursion(spark):
    with pytest.raises(SQLError, match="54F01"):
        rec.level_order(spark.range(1), lambda f: f, most=5)


def test_unique_and_running(spark):
    rows = frame(spark, [(1, 5), (2, None), (3, None), (4, 7)], "k long, v long")
    I.check_unique(rows, ["v"])
    with pytest.raises(SQLError, match="23505"):
        I.check_unique(rows.union(rows), ["v"])
    got = I.running(rows.repartition(3), F.col("k").asc(), F.col("k"), "before").orderBy("k").collect()
    assert [r["before"] for r in got] == [0, 1, 3, 6]


def test_text_tokens_fold(spark):
    rows = frame(spark, [(1, "Élan, naïve CAFÉ ﬁne_x 3")], "id long, t string")
    assert [r["token"] for r in X.tokens(rows, "id", "t", "unicode").orderBy("pos").collect()] == ["elan", "naive", "cafe", "fine", "x", "3"]
    X.register("commas", lambda c: F.split(c, ","))
    assert X.tokens(rows, "id", "t", "commas").count() == 2


def test_ordered_bytes(spark):
    values = [None, -(2**63), -5, 0, 3, 2**63 - 1]
    rows = frame(spark, [(v,) for v in reversed(values)], "v long").withColumn("b", S.ordered_bytes("v"))
    assert [r["v"] for r in rows.orderBy("b").collect()] == values
    assert {r["v"]: r["w"] for r in rows.withColumn("w", S.from_ordered_bytes("b")).collect()} == {v: v for v in values}
    down = rows.withColumn("b", S.ordered_bytes("v", descending=True, nulls_last=True))
    assert [r["v"] for r in down.orderBy("b").collect()] == [2**63 - 1, 3, 0, -5, -(2**63), None]


@pytest.mark.parametrize(("column", "state"), [(lambda: S.to_bigint(F.lit(float("nan"))), "22F3H"), (lambda: S.text_to_boolean(F.lit("yes")), "22F3H"), (lambda: S.sqrt(F.lit(-1.0)), "22023"), (lambda: S.uuid_text(F.lit("x")), "22F3H")])
def test_failing_functions(spark, column, state):
    with pytest.raises(Exception, match=f"SQLSTATE={state}"):
        spark.range(1).select(column()).collect()


def test_paging_covers_all(spark):
    rows, seen, after = spark.read.parquet(f"{SF}/orders.parquet").select("o_custkey", "o_orderkey"), [], None
    while page := [tuple(r) for r in T.page(rows, ["o_custkey", "o_orderkey"], 400, after).collect()]:
        seen += page
        after = page[-1]
    assert seen == sorted(map(tuple, rows.collect()))


def test_scans_push_down(spark):
    plan = T.scan(spark, f"{SF}/lineitem.parquet", ["l_orderkey"], "l_quantity < 10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), LessThan(l_quantity,10.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_inverted_file_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    ivf = V.InvertedFile.build(rows, "embedding", "vec_id", 8)
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))
    got = {(r["query_id"], r["vec_id"]) for r in ivf.search_many(queries, "query_id", 10, 4).collect()}
    want = set()
    for r in queries.collect():
        want |= {(r["query_id"], x["vec_id"]) for x in V.nearest(rows, "embedding", r["target"], 10).collect()}
    assert len(got & want) >= 0.9 * len(want)
    one = ivf.search([float(x) for x in queries.first()["target"]], 3, 8)
    assert one.count() == 3


def test_inverted_file_recall_of_the_query(spark):
    """With the registered query's own cells and probes, on more vectors."""
    sf = SF.replace("0.001", "0.01")
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    ids, points = rows["vec_id"].to_numpy(), np.array(rows["embedding"].tolist(), np.float64)
    got = {(r["query_id"], r["vec_id"]) for r in QUERIES["knn_inverted_file"](spark, sf).collect()}
    want = set()
    for i, p in zip(ids[ids % 20 == 0], points[ids % 20 == 0], strict=True):
        want |= {(i, j) for j in ids[np.argsort(((points - p) ** 2).sum(axis=1), kind="stable")[:10]]}
    assert len(got & want) >= 0.9 * len(want)


def test_spatial_keys_are_local(spark):
    rows = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    keyed = rows.withColumn("z", I.z_key(["x", "y"], [0, 0], [7, 7], bits=3))
    assert sorted(r["z"] for r in keyed.collect()) == list(range(64))
    assert {(r["x"], r["y"]) for r in keyed.where("z < 4").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_three_valued_partition(spark):
    """WHERE p, WHERE NOT p and WHERE p IS NULL part the rows."""
    rows = spark.read.parquet(f"{SF}/orders.parquet").withColumn("s", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus"))).withColumn("v", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice")))
    n = rows.count()
    for p in [F.col("s") == "F", (F.col("s") == "F") | (F.col("v") > 100000), S.xor(F.col("s") == "O", F.col("v") < 50000), S.between("v", F.lit(1000), F.lit(90000)), ~S.like("s", "_")]:
        assert rows.where(p).count() + rows.where(~p).count() + rows.where(p.isNull()).count() == n


def test_aggregate_join_consistency(spark):
    """The same question by a join, a semi join and a group gives one answer."""
    o, c = spark.read.parquet(f"{SF}/orders.parquet"), spark.read.parquet(f"{SF}/customer.parquet")
    semi = R.exists(c, o, [("c_custkey", "o_custkey")]).select("c_custkey")
    joined = c.join(o, c["c_custkey"] == o["o_custkey"]).select("c_custkey").distinct()
    assert R.same_rows(semi, joined)


def test_a_stream_goes_on_where_it_ended(spark, tmp_path):
    from quern.streaming import events as E

    folder, state, marks = (f"file://{tmp_path}/{n}" for n in ("in", "state", "marks"))
    for rows in ([("a", 1.0), ("b", 2.0), (None, 5.0)], [("a", 3.0), ("c", 4.0), (None, 1.0)]):
        spark.createDataFrame(rows, "kind string, value double").coalesce(1).write.mode("append").parquet(folder)
        E.run(E.counts(E.source(spark, folder), ["kind"]), "update", "t", E.Latest(spark, ["kind"], state), marks)
    got = {r["kind"]: (r["n"], r["total"]) for r in E.Latest(spark, ["kind"], state).rows.collect()}
    assert got == {"a": (2, 4.0), "b": (1, 2.0), "c": (1, 4.0), None: (2, 6.0)}
    again = E.Latest(spark, ["kind"], state)
    again(spark.createDataFrame([("a", 9, 9.0)], "kind string, n long, total double"), 0)  # delivered again: nothing changes
    assert {r["kind"]: r["n"] for r in again.rows.collect()}["a"] == 2


def test_words_in_a_span_of_a_long_text(spark):
    from quern.operators import text as T

    rows = [(1, "a x x b x c"), (2, "a b x x x x c"), (3, "c b a"), (4, "a " * 5000 + "b " * 5000), (5, "a a b"), (6, "b")]
    index = T.tokens(spark.createDataFrame(rows, "k long, t string"), "k", "t")
    for words, distance in ((["a", "b", "c"], 3), (["a", "b", "c"], 6), (["a", "b"], 2), (["a"], 1), (["a", "a", "b"], 2)):
        def fits(t):
            w = t.split()
            return any(set(words) <= set(w[i : i + distance]) for i in range(len(w)))

        assert {r["k"] for r in T.all_within(index, "k", words, distance).collect()} == {k for k, t in rows if fits(t)}


def test_clustered_vectors(spark):
    import numpy as np

    from quern.operators import vectors as V

    g = np.random.default_rng(3)
    x = g.normal(size=(3000, 16))
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(5000, None, 0), (5001, [0.0] * 16, 1)], "id long, v array<double>, zone int")
    queries = rows.where("id % 20 = 0 and v is not null").selectExpr("id as q", "v as target")
    for metric in ("euclidean", "cosine"):
        true = {(r["q"], r["id"]) for r in V.exact_many(rows, "v", "id", queries, "q", 10, metric).collect()}
        at = x[40]
        if metric == "euclidean":
            want = np.argsort(((x - at) ** 2).sum(1), kind="stable")[:10]
            assert {i for q, i in true if q == 40} == set(want.tolist())
        index = V.Clustered.build(rows, "v", "id", metric=metric)
        found = {(r["q"], r["id"]) for r in index.search_many(queries, "q", 10, probes=20, epsilon=2.0).collect()}
        assert len(found) == len(true) and len(found & true) >= 0.9 * len(true)
    one = index.search(x[40].tolist(), 5, probes=20).collect()
    assert one[0]["id"] == 40 or 40 in {r["id"] for r in one}
    assert all(i % 3 == 1 for i in (r["id"] for r in V.Clustered.build(rows, "v", "id").search(x[1].tolist(), 4, where=F.col("zone") == 1).collect() if r["id"] < 3000))
    assert V.Clustered.build(rows.limit(0), "v", "id").search([0.0] * 16, 3).count() == 0


def test_distance_to_a_vector_of_zeros(spark):
    from quern.operators import vectors as V
    from quern.plans.engine import Engine

    rows = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert {r["id"]: r["d"] for r in rows.select("id", V.distance("cosine", "v", V.vector([3.0, 0.0])).alias("d")).collect()} == {1: 1.0, 2: 0.0}
    e = Engine(spark)
    e.register("z", rows)
    assert sorted(e.rows("SELECT id, cosine_distance(v, [3.0, 0.0]) FROM z")) == [(1, 1.0), (2, 0.0)]


def moved(spark) -> int:
    """Bytes that executors have written to shuffles so far."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    all_of = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(all_of.apply(i).totalShuffleWrite() for i in range(all_of.size()))


def planted(spark, n=3000, copies=400):
    """Vectors without clusters, one of them many times over."""
    g = np.random.default_rng(5)
    x = g.normal(size=(n, 16)).astype(np.float32).astype(float)
    x[g.choice(n, copies, replace=False)] = x[0]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, None)], "id long, v array<double>")
    return x, rows, rows.where("id % 20 = 0").selectExpr("id as q", "v as target")


def brute(x, k, metric="euclidean"):
    """(query, place, row) with ties by row."""
    out = set()
    for q in range(0, len(x), 20):
        far = {"euclidean": lambda: np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1]), "dot_product": lambda: -np.cumsum(x * x[q], axis=1)[:, -1]}[metric]()
        out |= {(q, p + 1, int(i)) for p, i in enumerate(np.lexsort((np.arange(len(x)), far))[:k])}
    return out


def test_inverted_file_moves_no_pairs(spark):
    """Neighbours are found where rows are read: what is shuffled doesn't grow with queries times rows, and copies tie by key."""
    x, rows, queries = planted(spark)
    rows = rows.repartition(3).localCheckpoint()
    ivf = V.InvertedFile.build(rows, "v", "id", 16)
    before = moved(spark)
    some = {(r["q"], r["row_number"], r["id"]) for r in ivf.search_many(queries, "q", 10, 4).collect()}
    assert moved(spark) - before < x.nbytes
    want = brute(x, 10)
    assert len({(q, i) for q, _, i in some} & {(q, i) for q, _, i in want}) >= 0.9 * len(want)
    assert {(r["q"], r["row_number"], r["id"]) for r in ivf.search_many(queries, "q", 10, 16).collect()} == want
    apart = V.InvertedFile.build(rows, "v", "id", 16, spread=1.0)
    cell = {r["id"]: set(r["c"]) for r in rows.where("v is not null").select("id", V._cells(V.doubles("v"), apart.centroids, 1.0).alias("c")).collect()}
    own = apart.search_many(queries, "q", 10, 1).collect()
    assert own and all(cell[r["q"]] & cell[r["id"]] for r in own)


def test_exact_neighbours_in_any_batches(spark, monkeypatch):
    x, rows, queries = planted(spark)
    monkeypatch.setattr(V, "BLOCK_QUERIES", 64)
    for metric in ("euclidean", "dot_product"):
        for parts in (1, 5):
            got = V.exact_many(rows.repartition(parts), "v", "id", queries, "q", 10, metric).collect()
            assert {(r["q"], r["row_number"], r["id"]) for r in got} == brute(x, 10, metric)
    named = rows.selectExpr("concat('n', lpad(id, 5, '0')) as id", "v")
    got = V.exact_many(named, "v", "id", queries.selectExpr("concat('n', q) as q", "target"), "q", 10).collect()
    assert {(int(r["q"][1:]), r["row_number"], int(r["id"][1:])) for r in got} == brute(x, 10)


def test_clustered_index_keeps_a_row_once(spark):
    """Neither the index nor a search grows with cells times rows or queries times rows; its candidates are those of all cells a row is in."""
    x, rows, queries = planted(spark)
    rows = rows.repartition(3).localCheckpoint()
    before = moved(spark)
    index = V.Clustered.build(rows, "v", "id", 32)
    assert index.table.count() == index.table.select("id").distinct().count() == len(x)
    found = {(r["q"], r["row_number"], r["id"]) for r in index.search_many(queries, "q", 10, probes=32, epsilon=9.0).collect()}
    assert moved(spark) - before < 4 * x.nbytes
    want = brute(x, 10)
    assert len({(q, i) for q, _, i in found} & {(q, i) for q, _, i in want}) >= 0.99 * len(want)
    copies = {q for q in range(0, len(x), 20) if (x[q] == x[0]).all()}
    assert {t for t in found if t[0] in copies} == {t for t in want if t[0] in copies}


def test_clustered_search_reads_what_cells_can_hold(spark):
    """Of vectors in clusters a search reads few cells' files, and finds what it finds in all of them."""
    g = np.random.default_rng(2)
    x = g.normal(size=(20, 8))[g.integers(0, 20, 2000)] * 20 + g.normal(size=(2000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    index = V.Clustered.build(rows, "v", "id", 20)
    members = V._members(x, np.array(index.fine), index.spread)
    home = {r["id"]: r["cell"] for r in index.table.select("id", "cell").collect()}
    for q in (1, 7, 90):
        probed = np.flatnonzero(index.asked(x[q : q + 1], 3, 1.0)[0])
        homes = index.homes(probed)
        assert {home[i] for i in np.flatnonzero(members[:, probed].any(1)).tolist()} <= set(homes) and len(homes) < 20
        inside = np.flatnonzero(members[:, probed].any(1))
        want = inside[np.argsort(((x[inside] - x[q]) ** 2).sum(1), kind="stable")[:5]]
        assert [r["id"] for r in index.search(x[q].tolist(), 5, probes=3).orderBy("row_number").collect()] == want.tolist()
