"""Nearest neighbours over the embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import vectors as V
from quern.queries.registry import Tables, query

TARGET = "(SELECT CAST(embedding AS DOUBLE[]) AS g FROM embeddings WHERE vec_id = 7)"


def target(t: Tables) -> list[float]:
    return t.embeddings.where("vec_id = 7").first()["embedding"]


def knn(name: str, metric: str, sql: str) -> None:
    @query(f"SELECT vec_id, round({sql}, 6) AS distance FROM embeddings, {TARGET} ORDER BY {sql}, vec_id LIMIT 10", name=f"knn_{name}")
    def run(t: Tables) -> DataFrame:
        return V.nearest(t.embeddings, "embedding", target(t), 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))


E = "CAST(embedding AS DOUBLE[])"
knn("euclidean", "euclidean", f"list_distance({E}, g)")
knn("euclidean_square", "euclidean_square", f"pow(list_distance({E}, g), 2)")
knn("cosine", "cosine", f"(1 - list_cosine_similarity({E}, g))")
knn("dot_product", "dot_product", f"(-list_inner_product({E}, g))")


@query(f"SELECT vec_id, label, r AS row_number FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY list_distance({E}, g), vec_id) AS r FROM embeddings, {TARGET}) WHERE r <= 3")
def knn_partitioned(t: Tables) -> DataFrame:
    return V.nearest_each(t.embeddings, "embedding", target(t), 3, ["label"]).select("vec_id", "label", "row_number")


@query(f"SELECT vec_id FROM embeddings, {TARGET} WHERE label = 2 ORDER BY list_distance({E}, g), vec_id LIMIT 5")
def knn_filtered(t: Tables) -> DataFrame:
    return V.nearest(t.embeddings, "embedding", target(t), 5, where=F.col("label") == 2).select("vec_id")


@query("SELECT vec_id FROM embeddings WHERE 1 = 0")
def knn_zero(t: Tables) -> DataFrame:
    return V.nearest(t.embeddings, "embedding", target(t), 0).select("vec_id")


@query()
def knn_inverted_file(t: Tables) -> DataFrame:
    """Ten neighbours of every twentieth vector by probing 4 of 16 cells."""
    ivf = V.InvertedFile.build(t.embeddings.select("vec_id", "embedding"), "embedding", "vec_id", 16)
    queries = t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))
    return ivf.search_many(queries, "query_id", 10, 4)


@query(f"SELECT vec_id, CAST(1.0 AS DOUBLE) AS distance FROM embeddings")
def knn_cosine_of_zeros(t: Tables) -> DataFrame:
    """A vector of zeros is at distance 1 from all."""
    return t.embeddings.select("vec_id", V.distance("cosine", "embedding", V.vector([0.0] * 64)).alias("distance"))


def twentieth(t: Tables) -> DataFrame:
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("target"))


@query(f"SELECT query_id, vec_id, row_number FROM (SELECT q.vec_id AS query_id, e.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), e.vec_id) AS row_number FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE row_number <= 10")
def knn_exact_many(t: Tables) -> DataFrame:
    """The ten neighbours of every twentieth vector against all, in blocks."""
    return V.exact_many(t.embeddings, "embedding", "vec_id", twentieth(t), "query_id", 10).select("query_id", "vec_id", "row_number")


@query("SELECT true AS recall_of_nine_tenths")
def knn_clustered(t: Tables) -> DataFrame:
    """The two-level index finds nine of ten true neighbours of every twentieth vector."""
    index = V.Clustered.build(t.embeddings.select("vec_id", "embedding"), "embedding", "vec_id")
    found = index.search_many(twentieth(t), "query_id", 10, probes=16)
    true = V.exact_many(t.embeddings, "embedding", "vec_id", twentieth(t), "query_id", 10)
    hits = true.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hits.agg((F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("recall_of_nine_tenths"))
