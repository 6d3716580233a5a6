"""Nearest neighbours: exact, filtered and partitioned, and an inverted-file index for approximate search.

Distances are higher-order functions over arrays of doubles, inside Catalyst.
"""

from __future__ import annotations

from itertools import islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.sources.tables import cut


def doubles(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def squared(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def distance(metric: str, a, b) -> Column:
    """euclidean, euclidean_square, cosine (1 - similarity, 1 for a vector of zeros) or dot_product (the negative product: near means large)."""
    x, y = doubles(a), doubles(b)
    if metric == "euclidean":
        return F.sqrt(squared(x, y))
    if metric == "euclidean_square":
        return squared(x, y)
    if metric == "cosine":
        norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
        return F.when(norms == 0, 1.0).otherwise(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / F.nullif(norms, F.lit(0.0)))))
    if metric == "dot_product":
        return -dot(x, y)
    raise ValueError(metric)


def vector(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def nearest(rows: DataFrame, embedding: str, target, k: int, metric: str = "euclidean", key: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest matching rows of one target: the predicate comes first, ties go to the smaller key; no row for k <= 0."""
    if where is not None:
        rows = rows.where(where)
    goal = target if isinstance(target, Column) else vector(target)
    return rows.withColumn("distance", distance(metric, embedding, goal)).orderBy("distance", key).limit(max(k, 0))


def nearest_each(rows: DataFrame, embedding: str, target, k: int, by: list[str], metric: str = "euclidean", key: str = "vec_id") -> DataFrame:
    """The k nearest rows of every partition, with their ``row_number``."""
    goal = target if isinstance(target, Column) else vector(target)
    ranked = rows.withColumn("distance", distance(metric, embedding, goal))
    return ranked.withColumn("row_number", F.row_number().over(Window.partitionBy(*by).orderBy("distance", key)).cast("long")).where(F.col("row_number") <= k)


def _members(points, centroids, spread: float):
    """Rows by cells: whether a cell's centroid is at most ``spread`` times as far as the nearest one's."""
    import numpy as np

    far = np.maximum((points * points).sum(1)[:, None] + (centroids * centroids).sum(1) - 2 * points @ centroids.T, 0)
    return far <= far.min(1, keepdims=True) * spread**2 + 1e-12


def _cells(column, centroids: list[list[float]], spread: float) -> Column:
    """The cells that each vector is in; the centroids, a parameter's number of them, travel with the task."""
    import numpy as np
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    c = np.array(centroids)

    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([np.flatnonzero(m).astype(np.int32) for m in _members(_points(batch), c, spread)])

    run.__annotations__ = {"batch": pd.Series, "return": pd.Series}
    return pandas_udf(run, "array<int>")(column)


class InvertedFile:
    """Rows by their nearest centroid; a query probes the nearest cells only and ranks their rows exactly.

    ``spread``: a row also enters cells whose centroid is nearly as near (within this factor), which raises recall at cell borders.
    Vectors without clusters are in most cells, so a row is kept once and its cells are found where it is read.
    """

    def __init__(self, centroids: list[list[float]], rows: DataFrame, embedding: str, key: str, metric: str, spread: float):
        self.centroids, self.rows, self.embedding, self.key, self.metric, self.spread = centroids, rows, embedding, key, metric, spread

    @classmethod
    def build(cls, rows: DataFrame, embedding: str, key: str, n_cells: int, metric: str = "euclidean", seed: int = 7, spread: float = 1.1) -> InvertedFile:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = rows.where(F.col(embedding).isNotNull())
        data = rows.select(array_to_vector(doubles(embedding)).alias("_v"))
        model = KMeans(k=n_cells, seed=seed, featuresCol="_v", maxIter=15).fit(data)
        return cls([[float(x) for x in c] for c in model.clusterCenters()], rows, embedding, key, metric, spread)

    def search(self, target: list[float], k: int, probes: int) -> DataFrame:
        order = sorted(range(len(self.centroids)), key=lambda c: sum((x - y) ** 2 for x, y in zip(self.centroids[c], target, strict=True)))
        probed = F.array(*[F.lit(c) for c in order[:probes]])
        found = self.rows.where(F.arrays_overlap(_cells(doubles(self.embedding), self.centroids, self.spread), probed)).dropDuplicates([self.key])
        return nearest(found, self.embedding, target, k, self.metric, self.key)

    def search_many(self, queries: DataFrame, query_key: str, k: int, probes: int) -> DataFrame:
        """query_key, key, distance, row_number of a stated query set (column ``target``), in blocks that travel to the rows."""
        import numpy as np

        centroids, spread = np.array(self.centroids), self.spread

        def asked(targets):
            far = distances("euclidean_square", targets, centroids)
            asks = np.zeros(far.shape, bool)
            np.put_along_axis(asks, np.argsort(far, axis=1, kind="stable")[:, :probes], True, axis=1)
            return asks

        found = _in_blocks(self.rows, self.embedding, self.key, queries, query_key, k, self.metric, _Cells(centroids, spread, asked))
        once = found.repartition(query_key).groupBy(query_key, self.key).agg(F.min("distance").alias("distance"))
        return once.withColumn("row_number", F.row_number().over(Window.partitionBy(query_key).orderBy("distance", self.key)).cast("long")).where(F.col("row_number") <= k)


def exact_many(rows: DataFrame, embedding: str, key: str, queries: DataFrame, query_key: str, k: int, metric: str = "euclidean") -> DataFrame:
    """query_key, key, distance, row_number: the exact neighbours of a stated query set (column ``target``), in blocks.

    The query set travels to the rows BLOCK_QUERIES at a time; every task keeps the k nearest of its own rows for each
    query, so k rows for each query and task are all that is shuffled.
    """
    found = _in_blocks(rows, embedding, key, queries, query_key, k, metric)
    return found.withColumn("row_number", F.row_number().over(Window.partitionBy(query_key).orderBy("distance", key)).cast("long")).where(F.col("row_number") <= k)


class _Cells:
    """What restricts a block's pairs: ``asked`` gives the cells that targets probe (a matrix), ``reads`` the rows to read for them."""

    def __init__(self, centroids, spread: float, asked, reads=None):
        self.centroids, self.spread, self.asked, self.reads = centroids, spread, asked, reads


def _in_blocks(rows: DataFrame, embedding: str, key: str, queries: DataFrame, query_key: str, k: int, metric: str, cells: _Cells | None = None, code: bool = False) -> DataFrame:
    """query_key, key, distance: for each task and query the k nearest rows of those in a probed cell (``code``: nearest by their codes, with ``about``)."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    double = [T.StructField("about", T.DoubleType())] * code + [T.StructField("distance", T.DoubleType())]
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, rows.schema[key].dataType), *double])
    rows = rows.where(F.col(embedding).isNotNull())
    found = rows.sparkSession.createDataFrame([], schema)
    goals = queries.select(query_key, "target").where("target is not null").toLocalIterator()
    while block := list(islice(goals, BLOCK_QUERIES)):
        ids, targets = [r[query_key] for r in block], np.array([r["target"] for r in block], float)
        asks = cells.asked(targets) if cells else None
        places = (cells.centroids, cells.spread) if cells else None

        def run(batches, ids=ids, targets=targets, asks=asks, places=places):
            best = _Best(targets, k, metric, code, once=asks is not None)
            step = max(64, (1 << 21) // max(len(ids), 0 if places is None else len(places[0])))
            for batch in batches:
                if not len(batch):
                    continue
                keys, points = batch[key].to_numpy(), _points(batch[embedding])
                few = _few_copies(keys, points, k, once=asks is not None)
                keys, points = keys[few], points[few]
                shown = np.frombuffer(b"".join(batch["code"].iloc[few]), np.int8).reshape(points.shape) * batch["scale"].to_numpy()[few, None] if code else points
                for at in range(0, len(keys), step):
                    part = slice(at, at + step)
                    best.add(keys[part], shown[part], points[part], None if places is None else _members(points[part], *places), asks)
            names = np.array(ids, object) if isinstance(ids[0], str) else np.array(ids)
            yield pd.DataFrame({query_key: names[best.of], key: best.keys, **({"about": best.about} if code else {}), "distance": best.distance})

        held = cells.reads(rows, asks) if cells and cells.reads else rows
        held = held.select(key, embedding, *["code", "scale"][: 2 * code]).coalesce(rows.sparkSession.sparkContext.defaultParallelism)
        found = found.unionByName(held.mapInPandas(run, schema))
    return found


class _Best:
    """The k nearest rows of each target among those added, by (value, key).

    A matrix product rules pairs out, with room for its rounding; pairs that are left get values that are summed in
    order, pair by pair, as Catalyst does, so that copies of a vector tie wherever they lie.
    """

    #: Pairs that are summed at once.
    PAIRS = 16384

    def __init__(self, targets, k: int, metric: str, code: bool = False, once: bool = False):
        """code: rows are ranked by what is shown of them (squares for euclidean); once: one row for each key."""
        import numpy as np

        self.targets, self.k, self.metric, self.once = targets, k, metric, once
        self.rank = "euclidean_square" if code and metric == "euclidean" else metric
        self.square = (targets * targets).sum(1)
        self.bound = np.full(len(targets), np.inf)
        self.of, self.keys, self.about, self.distance = np.zeros(0, int), None, np.zeros(0), np.zeros(0)

    def add(self, keys, shown, points, members=None, asks=None) -> None:
        """members: rows by cells, asks: targets by cells; a pair counts if it shares a cell."""
        import numpy as np

        pairs = [self._near(shown, *piece) for piece in self._pieces(len(keys), members, asks)]
        of, row = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, int) for i in (0, 1))
        if not len(of):
            return
        value, far = np.empty(len(of)), np.empty(len(of))
        for at in range(0, len(of), self.PAIRS):
            part = slice(at, at + self.PAIRS)
            t = self.targets[of[part]]
            value[part] = paired(self.rank, t, shown[row[part]])
            far[part] = value[part] if points is shown else paired(self.metric, t, points[row[part]])
        self._merge(of, keys[row], value, far)

    def _pieces(self, n: int, members, asks):
        """(targets, rows, mask): what is compared by one product; by cell where that is less than all pairs."""
        import numpy as np

        if members is None:
            return [(slice(None), slice(None), None)]
        if (members.sum(0) * asks.sum(0)).sum() >= n * len(asks):
            return [(slice(None), slice(None), asks.astype(np.float32) @ members.T.astype(np.float32) > 0)]
        return [(np.flatnonzero(asks[:, c]), np.flatnonzero(members[:, c]), None) for c in np.flatnonzero(members.any(0) & asks.any(0))]

    def _near(self, shown, of, rows, mask):
        """(target, row) of pairs that can be among the k nearest."""
        import numpy as np

        t, x = self.targets[of], shown[rows]
        rough = distances("euclidean_square" if self.rank == "euclidean" else self.rank, t, x)
        if mask is not None:
            rough[~mask] = np.inf
        size = (x * x).sum(1).max(initial=0)
        room = (t.shape[1] + 8) * 4.5e-16 * (1 if self.rank == "cosine" else self.square[of] + size)
        bound = self.bound[of] ** 2 if self.rank == "euclidean" else self.bound[of].copy()
        if (new := np.isinf(bound)).any() and rough.shape[1] > self.k > 0:
            bound[new] = np.partition(rough[new], self.k - 1, axis=1)[:, self.k - 1] + np.broadcast_to(room, bound.shape)[new]
        a, b = np.nonzero((rough <= (bound + room)[:, None]) & (rough < np.inf))
        return np.arange(len(self.targets))[of][a], np.arange(len(shown))[rows][b]

    def _merge(self, of, keys, value, far) -> None:
        import numpy as np

        if self.keys is not None:
            of, keys, value, far = (np.concatenate(x) for x in ((self.of, of), (self.keys, keys), (self.about, value), (self.distance, far)))
        if self.once:
            order = np.lexsort((far, value, keys, of))
            again = (of[order][1:] == of[order][:-1]) & (keys[order][1:] == keys[order][:-1])
            first = order[np.concatenate([[True], ~again])]
            of, keys, value, far = of[first], keys[first], value[first], far[first]
        order = np.lexsort((keys, value, of))
        order = order[_place(of[order]) < self.k]
        self.of, self.keys, self.about, self.distance = of[order], keys[order], value[order], far[order]
        ends = np.cumsum(np.bincount(self.of, minlength=len(self.targets)))
        full = np.diff(ends, prepend=0) >= max(self.k, 1)
        self.bound[full] = self.about[ends[full] - 1]


def _place(groups):
    """The place of each item in its group, of sorted groups."""
    import numpy as np

    return np.arange(len(groups)) - np.searchsorted(groups, groups)


def _few_copies(keys, points, k: int, once: bool):
    """Places of the rows, without copies of a vector that k copies with smaller keys rule out: they tie for every target."""
    import numpy as np

    bits = np.ascontiguousarray(points).view(np.uint64)
    mixed = (bits ^ (bits >> np.uint64(29))) * (np.arange(1, 2 * bits.shape[1], 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if len(np.unique(mixed.sum(1))) == len(keys):
        return np.arange(len(keys))
    group = np.unique(np.ascontiguousarray(points).view(np.dtype((np.void, points.shape[1] * 8))).ravel(), return_inverse=True)[1]
    order = np.lexsort((keys, group))
    if once:
        again = (group[order][1:] == group[order][:-1]) & (keys[order][1:] == keys[order][:-1])
        order = order[np.concatenate([[True], ~again])]
    return np.sort(order[_place(group[order]) < k])


def _points(batch):
    import numpy as np

    return np.stack(batch.to_numpy()).astype(float) if len(batch) else np.zeros((0, 1))


def paired(metric: str, a, b):
    """Distances row by row (numpy matrices), summed in order."""
    import numpy as np

    def total(x):
        return np.cumsum(x, axis=1)[:, -1:].sum(1)

    if metric == "dot_product":
        return -total(a * b)
    if metric == "cosine":
        norms = np.sqrt(total(a * a)) * np.sqrt(total(b * b))
        return np.where(norms == 0, 1.0, 1 - np.clip(total(a * b) / np.where(norms == 0, 1, norms), -1, 1))
    square = total((a - b) * (a - b))
    return square if metric == "euclidean_square" else np.sqrt(square)


#: Queries that travel to the rows at once.
BLOCK_QUERIES = 1024


def distances(metric: str, a, b):
    """Distances of all rows of ``a`` and ``b`` (numpy matrices)."""
    import numpy as np

    dots = a @ b.T
    if metric == "dot_product":
        return -dots
    if metric == "cosine":
        norms = np.sqrt((a * a).sum(1))[:, None] * np.sqrt((b * b).sum(1))
        return np.where(norms == 0, 1.0, 1 - np.clip(dots / np.where(norms == 0, 1, norms), -1, 1))
    square = np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * dots, 0)
    return square if metric == "euclidean_square" else np.sqrt(square)


class Clustered:
    """A vector index in two levels: coarse cells hold fine cells, a fine cell its rows as quantised codes.

    A query ranks the coarse centroids, the fine centroids of the nearest ones, and the codes of the nearest fine cells; a cell whose
    centroid is more than ``1 + epsilon`` times as far as the nearest one's is pruned. The nearest RERANK * k codes are
    ranked again by their exact vectors. A row lies once, in the files of its nearest cell; the cells nearly as near that it is
    also in are found where it is read. ``radius``: how far the rows of a cell are from its centroid at most; a query reads the
    cells that can hold a row of one that it probes.
    """

    RERANK = 4
    #: Rows that the cells are learnt from, for each cell.
    SAMPLE = 256

    def __init__(self, table: DataFrame, fine: list, coarse: list, of: list[int], radius: dict[int, float], spread: float, embedding: str, key: str, metric: str):
        self.table, self.fine, self.coarse, self.of, self.radius, self.spread, self.embedding, self.key, self.metric = table, fine, coarse, of, radius, spread, embedding, key, metric

    @classmethod
    def build(cls, rows: DataFrame, embedding: str, key: str, n_cells: int | None = None, metric: str = "euclidean", seed: int = 7, spread: float = 1.15) -> Clustered:
        """Cells are learnt from SAMPLE rows for each (a hash of the key picks them); every row is indexed, also in cells nearly as near."""
        import numpy as np
        import pandas as pd
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        rows = rows.where(F.col(embedding).isNotNull())
        n = rows.count()
        n_cells = max(2, n_cells or min(4096, int(n**0.5 / 2)))
        share = max(1, n // (cls.SAMPLE * n_cells))
        sample = rows.where(F.pmod(F.xxhash64(key), F.lit(share)) == 0).select(array_to_vector(doubles(embedding)).alias("v"))
        fine = [[float(x) for x in c] for c in KMeans(k=n_cells, seed=seed, featuresCol="v", maxIter=15).fit(sample).clusterCenters()] if n else []
        coarse, of = _grouped(np.array(fine), max(1, int(len(fine) ** 0.5)), seed) if fine else ([], [])
        centroids = np.array(fine)

        def quantise(batch: pd.Series) -> pd.DataFrame:
            x = _points(batch)
            scale = np.maximum(np.abs(x).max(axis=1, initial=0), 1e-30) / 127
            far = distances("euclidean", x, centroids) if len(x) else np.zeros((0, 1))
            return pd.DataFrame({"code": [c.tobytes() for c in np.round(x / scale[:, None]).astype(np.int8)], "scale": scale, "cell": far.argmin(1).astype(np.int32), "away": far.min(1)})

        from pyspark.sql.functions import pandas_udf

        quantise.__annotations__ = {"batch": pd.Series, "return": pd.DataFrame}
        coded = rows.withColumn("_q", pandas_udf(quantise, "code binary, scale double, cell int, away double")(doubles(embedding)))
        celled = coded.withColumns({c: F.col(f"_q.{c}") for c in ("cell", "code", "scale", "away")}).drop("_q")
        table = cut(celled.repartition("cell"), "vectors", ["cell"])
        radius = {r["cell"]: r["far"] for r in table.groupBy("cell").agg(F.max("away").alias("far")).collect()}
        return cls(table, fine, coarse, of, radius, spread, embedding, key, metric)

    def asked(self, targets, probes: int, epsilon: float):
        """Targets by fine cells: of the nearest coarse cells, the nearest fine ones that are not pruned."""
        import numpy as np

        asks = np.zeros((len(targets), len(self.fine)), bool)
        if not self.fine or probes < 1:
            return asks
        near = np.argsort(distances("euclidean", targets, np.array(self.coarse)), axis=1, kind="stable")[:, :probes]
        held = np.zeros((len(targets), len(self.coarse)), bool)
        np.put_along_axis(held, near, True, axis=1)
        far = np.where(held[:, self.of], distances("euclidean", targets, np.array(self.fine)), np.inf)
        order = np.argsort(far, axis=1, kind="stable")[:, :probes]
        found = np.take_along_axis(far, order, axis=1)
        np.put_along_axis(asks, order, (found <= found[:, :1] * (1 + epsilon) + 1e-12) & (found < np.inf), axis=1)
        return asks

    def homes(self, cells) -> list[int]:
        """The cells whose files can hold rows of the given ones: a row is at most ``spread`` times as far from them as from its own."""
        import numpy as np

        if not len(cells):
            return []
        fine = np.array(self.fine)
        apart, room = distances("euclidean", fine[cells], fine).min(0), 1e-6 * (1 + np.abs(fine).max())
        return [h for h, far in self.radius.items() if not apart[h] > (1 + self.spread) * far + room]  # a radius that is no number rules nothing out

    def search(self, target: list[float], k: int, probes: int = 8, epsilon: float = 1.0, where: Column | None = None) -> DataFrame:
        """The k nearest rows of one target; only files that can hold rows of the probed cells are read."""
        queries = self.table.sparkSession.createDataFrame([(0, [float(x) for x in target])], "query_id long, target array<double>")
        return self._ranked(self.table if where is None else self.table.where(where), queries, "query_id", k, probes, epsilon).drop("query_id")

    def search_many(self, queries: DataFrame, query_key: str, k: int, probes: int = 8, epsilon: float = 1.0) -> DataFrame:
        """query_key, key, distance, row_number of a stated query set (column ``target``), in blocks that travel to the rows."""
        return self._ranked(self.table, queries, query_key, k, probes, epsilon)

    def _ranked(self, table: DataFrame, queries: DataFrame, query_key: str, k: int, probes: int, epsilon: float) -> DataFrame:
        import numpy as np

        def reads(rows: DataFrame, asks) -> DataFrame:
            homes = self.homes(np.flatnonzero(asks.any(0)))
            return rows if len(homes) == len(self.radius) else rows.where(F.col("cell").isin(*homes))

        cells = _Cells(np.array(self.fine), self.spread, lambda targets: self.asked(targets, probes, epsilon), reads)
        rough = _in_blocks(table, self.embedding, self.key, queries, query_key, self.RERANK * k, self.metric, cells, code=True)
        once = rough.repartition(query_key).groupBy(query_key, self.key).agg(F.min(F.struct("about", "distance")).alias("_m")).select(query_key, self.key, "_m.*")
        kept = once.withColumn("r", F.row_number().over(Window.partitionBy(query_key).orderBy("about", self.key))).where(F.col("r") <= self.RERANK * k)
        return kept.withColumn("row_number", F.row_number().over(Window.partitionBy(query_key).orderBy("distance", self.key)).cast("long")).where(F.col("row_number") <= k).select(query_key, self.key, "distance", "row_number")


def _grouped(points, k: int, seed: int, rounds: int = 20) -> tuple[list, list[int]]:
    """(centroids, group of each point) of a few thousand points at most, by k-means."""
    import numpy as np

    g = np.random.default_rng(seed)
    centroids = points[g.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        own = distances("euclidean", points, centroids).argmin(1)
        centroids = np.array([points[own == c].mean(0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
    return centroids.tolist(), distances("euclidean", points, centroids).argmin(1).tolist()
