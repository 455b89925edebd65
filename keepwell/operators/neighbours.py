"""Exact nearest neighbours by squared Euclidean distance.

A corpus of checked size travels to the queries: each batch of queries finds its
k nearest in place and nothing is shuffled. A larger corpus is cut into cells
around pivots; the triangle inequality rules out cells that cannot hold a nearest
vector, and queries meet the remaining cells in tiles of bounded size. Tasks only
ever emit k rows per query and tile.

Vectors of few components are searched once per distinct vector, against at most k
copies of one vector: of equal vectors, the k lowest ids alone can be among the
nearest. Within a task they lie in ``Blocks``, of which a query meets those that its
nearest found so far cannot rule out.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from keepwell.session import settle

MAX_SHIPPED_BYTES = 64 * 1024 * 1024
MAX_QUESTION_BYTES = 16 * 1024 * 1024
TILE_ROWS = 50_000
MAX_PIVOTS = 256
#: Vectors of at most so many components are narrow: boxes around them rule out nearly all others.
NARROW = 4
MAX_NARROW_PIVOTS = 2048
DIGITS = 6
BLOCK_CELLS = 4_000_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.empty((0, 0))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def top_k(queries: np.ndarray, corpus: np.ndarray, k: int):
    """Row numbers of queries, of their k nearest, and distances; corpus in id order.

    Candidates come from one matrix product; their distances are then taken from
    the differences, rounded, and equal ones go to the lower row number.
    """
    k = min(k, len(corpus))
    found = []
    step = max(1, BLOCK_CELLS // max(len(corpus), 1))
    for start in range(0, len(queries) if k else 0, step):
        block = queries[start:start + step]
        d = _squares(block, corpus)
        slack = 2.0 * 10.0 ** -DIGITS + 1e-12 * d.max(initial=0.0)
        limit = np.partition(d, k - 1, axis=1)[:, k - 1] + slack
        rows, cols = np.nonzero(d <= limit[:, None])
        exact = np.round(((block[rows] - corpus[cols]) ** 2).sum(1), DIGITS)
        order = np.lexsort((cols, exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        at = np.arange(len(rows)) - np.searchsorted(rows, rows)
        keep = at < k
        found.append((rows[keep] + start, cols[keep], exact[keep]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(part) for part in zip(*found))


class Blocks:
    """Narrow vectors in boxes of about the square root of their number; ``search`` gives what ``top_k`` gives.

    Rows are parted along the widest side, so that every box holds k rows or all of them. ``compared`` counts the distances taken.
    """

    def __init__(self, corpus: np.ndarray, k: int):
        self.corpus, self.k, self.compared = corpus, min(k, len(corpus)), 0
        rows = max(128, 4 * k, math.isqrt(len(corpus)))
        self.parts, waiting = [], [np.arange(len(corpus))] if len(corpus) else []
        while waiting:
            part = waiting.pop()
            inside = corpus[part]
            sides = inside.max(0) - inside.min(0)
            if len(part) <= rows or not sides.any():
                self.parts.append(np.sort(part))
                continue
            side, middle = inside[:, sides.argmax()], len(part) // 2
            order = np.argpartition(side, middle)
            # equal values go to one side, else boxes overlap; unless that leaves a side of fewer than k rows
            under = [side < side[order[middle]], side <= side[order[middle]]]
            under = max(under, key=lambda u: min(u.sum(), len(u) - u.sum()))
            if min(under.sum(), len(under) - under.sum()) < k:
                under = np.zeros(len(part), bool)
                under[order[:middle]] = True
            waiting += [part[under], part[~under]]
        self.inside = [np.ascontiguousarray(corpus[p].T) for p in self.parts]
        self.low, self.high = (np.array([f(x, axis=1) for x in self.inside]) for f in (np.min, np.max))

    def _distances(self, queries: np.ndarray, b: int) -> np.ndarray:
        self.compared += len(queries) * len(self.parts[b])
        return sum((queries[:, a, None] - side[None, :]) ** 2 for a, side in enumerate(self.inside[b]))

    def search(self, queries: np.ndarray):
        found = []
        step = max(1, BLOCK_CELLS // max(len(self.parts), 1))
        for start in range(0, len(queries) if self.k else 0, step):
            rows, cols = self._candidates(queries[start:start + step])
            exact = np.round(((queries[rows + start] - self.corpus[cols]) ** 2).sum(1), DIGITS)
            order = np.lexsort((cols, exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
            found.append((rows[keep] + start, cols[keep], exact[keep]))
        if not found:
            return np.empty(0, int), np.empty(0, int), np.empty(0)
        return tuple(np.concatenate(part) for part in zip(*found))

    def _candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of queries and of the corpus that may be among the k nearest: no more is ruled out."""
        off = sum(np.maximum(np.maximum(self.low[None, :, a] - queries[:, a, None], queries[:, a, None] - self.high[None, :, a]), 0.0) ** 2
                  for a in range(queries.shape[1]))
        home = off.argmin(1)
        limit = np.empty(len(queries))
        for b, mine in _runs(home, np.arange(len(queries))):
            limit[mine] = np.partition(self._distances(queries[mine], b), self.k - 1, axis=1)[:, self.k - 1]
        limit = limit * (1 + 1e-9) + 2.0 * 10.0 ** -DIGITS
        asking, blocks = np.nonzero(off <= limit[:, None])
        out = []
        for b, mine in _runs(blocks, asking):
            rows, cols = np.nonzero(self._distances(queries[mine], b) <= limit[mine, None])
            out.append((mine[rows], self.parts[b][cols]))
        return tuple(np.concatenate(part) for part in zip(*out)) if out else (np.empty(0, int), np.empty(0, int))


def _runs(keys: np.ndarray, values: np.ndarray):
    """(key, its values) of every key."""
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=-1))
    return zip(keys[order][starts], np.split(values[order], starts[1:]))


def searcher(corpus: np.ndarray, k: int):
    """A function from queries to what ``top_k`` gives."""
    if 0 < corpus.shape[1] <= NARROW and np.isfinite(corpus).all():
        return Blocks(corpus, k).search
    return lambda queries: top_k(queries, corpus, k)


def _hits(q: pd.DataFrame, c_ids: np.ndarray, search) -> pd.DataFrame:
    rows, cols, distance = search(_matrix(q["vector"]) if len(q) else np.empty((0, 0)))
    return pd.DataFrame({"query_id": q["query_id"].to_numpy()[rows], "neighbour_id": c_ids[cols],
                         "distance": distance})


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "id", corpus_id: str = "id",
            vector: str = "vector", max_bytes: int = MAX_SHIPPED_BYTES,
            tile_rows: int = TILE_ROWS) -> DataFrame:
    """(query_id, neighbour_id, distance, position) of the k nearest per query.

    Ties go to the lower id. Only sizes, pivots and cell totals (and a corpus within
    ``max_bytes``) reach the driver.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    c = corpus.select(F.col(corpus_id).alias("neighbour_id"), F.col(vector).cast("array<double>").alias("vector"))
    schema = StructType([q.schema["query_id"], c.schema["neighbour_id"], StructField("distance", DoubleType())])
    q, c = (t.where(F.col("vector").isNotNull()) for t in (q, c))
    first = c.select(F.size("vector").alias("n")).first()
    if first is None:
        return q.sparkSession.createDataFrame([], schema).withColumn("position", F.lit(1))
    narrow = 0 < first.n <= NARROW
    asked = q
    if narrow:
        copy = F.row_number().over(Window.partitionBy("vector").orderBy("neighbour_id"))
        c = settle(c.withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"))
        asked = settle(q.select(F.col("vector").alias("query_id"), "vector").distinct())
        schema = StructType([asked.schema["query_id"], *schema.fields[1:]])
    row_bytes = max(1, first.n) * 8 + 32
    fits = max_bytes // row_bytes
    if c.limit(fits + 1).count() <= fits:
        hits = _against_shipped(asked, c, k, schema)
    else:
        hits = _against_tiles(asked, c, k, schema, tile_rows, MAX_NARROW_PIVOTS if narrow else MAX_PIVOTS)
    best = _ranked(hits, k)
    if not narrow:
        return best
    return q.join(best.withColumnRenamed("query_id", "vector"), "vector").drop("vector")


def nearest_to_few(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "id", corpus_id: str = "id",
                   vector: str = "vector", max_bytes: int = MAX_QUESTION_BYTES) -> DataFrame:
    """(query_id, neighbour_id, distance, position) of a few queries against a corpus of any size.

    The queries travel, behind a check of their size (beyond it ``nearest`` is taken).
    Every task reads its part of the corpus once and gives its k best per query, so
    k rows per query and task are merged and the corpus is neither shuffled nor collected.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector"))
    c = corpus.select(F.col(corpus_id).alias("neighbour_id"), F.col(vector).cast("array<double>").alias("vector"))
    q, c = (t.where(F.col("vector").isNotNull()) for t in (q, c))
    schema = StructType([q.schema["query_id"], c.schema["neighbour_id"], StructField("distance", DoubleType())])
    width = q.agg(F.max(F.size("vector"))).first()[0]
    if width is None:
        return q.sparkSession.createDataFrame([], schema).withColumn("position", F.lit(1))
    fits = max_bytes // (8 * width + 32)
    if q.limit(fits + 1).count() > fits:
        return nearest(queries, corpus, k, query_id, corpus_id, vector)
    asked = q.toPandas()
    sent = q.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(), _matrix(asked["vector"])))

    def search(batches):
        names, matrix = sent.value
        best = None
        for batch in batches:
            if len(batch):
                batch = batch.sort_values("neighbour_id", kind="stable")
                rows, cols, distance = top_k(matrix, _matrix(batch["vector"]), k)
                found = pd.DataFrame({"row": rows, "neighbour_id": batch["neighbour_id"].to_numpy()[cols], "distance": distance})
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["row", "distance", "neighbour_id"]).groupby("row", sort=False).head(k)
        if best is not None:
            yield pd.DataFrame({"query_id": names[best["row"].to_numpy()], "neighbour_id": best["neighbour_id"].to_numpy(),
                                "distance": best["distance"].to_numpy()})

    return _ranked(c.mapInPandas(search, schema), k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy("distance", "neighbour_id")
    return hits.withColumn("position", F.row_number().over(best)).where(F.col("position") <= k)


def _against_shipped(q: DataFrame, c: DataFrame, k: int, schema: StructType) -> DataFrame:
    table = c.toPandas().sort_values("neighbour_id", kind="stable")
    shipped = q.sparkSession.sparkContext.broadcast(
        (table["neighbour_id"].to_numpy(), _matrix(table["vector"])))

    def search(batches):
        ids, matrix = shipped.value
        find = searcher(matrix, k)
        for batch in batches:
            if len(batch):
                yield _hits(batch, ids, find)

    return q.mapInPandas(search, schema)


def _against_tiles(q: DataFrame, c: DataFrame, k: int, schema: StructType, tile_rows: int, most: int = MAX_PIVOTS) -> DataFrame:
    total = c.count()
    n_pivots = min(most, max(1, math.ceil(total / tile_rows)))
    chosen = c.orderBy(F.xxhash64(F.col("neighbour_id").cast("string")), "neighbour_id").limit(n_pivots)
    pivots = _matrix(chosen.toPandas()["vector"])

    def assign(batches):
        for batch in batches:
            if len(batch):
                d = _squares(_matrix(batch["vector"]), pivots)
                cell = d.argmin(1)
                yield batch.assign(cell=cell.astype("int32"), radius=np.sqrt(d[np.arange(len(d)), cell]))

    placed = c.mapInPandas(assign, StructType([*c.schema.fields, *_fields("cell int, radius double")]))
    cells = placed.groupBy("cell").agg(
        F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).toPandas()
    size, low, high = (np.zeros(n_pivots) for _ in range(3))
    size[cells.cell], low[cells.cell], high[cells.cell] = cells.n, cells.low, cells.high
    used = np.flatnonzero(size)

    def reach(vectors: np.ndarray) -> np.ndarray:
        """Which used cells can hold one of the k nearest of each query."""
        d = np.sqrt(_squares(vectors, pivots[used]))
        far = d + high[used]
        by_far = np.argsort(far, axis=1)
        enough = (np.cumsum(size[used][by_far], axis=1) >= min(k, total)).argmax(1)
        bound = far[np.arange(len(far)), by_far[np.arange(len(far)), enough]]
        near = np.maximum(np.maximum(d - high[used], low[used] - d), 0.0)
        return near <= bound[:, None] + 1e-6

    def route(batches):
        for batch in batches:
            if len(batch):
                rows, cols = np.nonzero(reach(_matrix(batch["vector"])))
                yield batch.iloc[rows].assign(cell=used[cols].astype("int32"))

    def count_routes(batches):
        for batch in batches:
            if len(batch):
                hit = reach(_matrix(batch["vector"])).sum(0)
                yield pd.DataFrame({"cell": used.astype("int32"), "n": hit.astype("int64")})

    asked = q.mapInPandas(count_routes, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    tiles = [max(1, math.ceil(n / tile_rows)) for n in size]
    blocks = [0] * n_pivots
    for row in asked.itertuples():
        blocks[row.cell] = math.ceil(row.n / tile_rows)

    def parts(counts: list[int]) -> Column:
        return F.element_at(F.array(*[F.lit(n) for n in counts]), F.col("cell") + 1)

    def bucket(column: str, counts: list[int]) -> Column:
        return F.pmod(F.xxhash64(F.col(column).cast("string")), parts(counts)).cast("int")

    keys = ["cell", "tile", "block"]
    right = (
        placed.drop("radius").withColumn("tile", bucket("neighbour_id", tiles)).where(parts(blocks) > 0)
        .withColumn("block", F.explode(F.sequence(F.lit(0), parts(blocks) - 1)))
    )
    left = (
        q.mapInPandas(route, StructType([*q.schema.fields, *_fields("cell int")]))
        .withColumn("block", bucket("query_id", blocks))
        .withColumn("tile", F.explode(F.sequence(F.lit(0), parts(tiles) - 1)))
    )

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": a["query_id"][:0], "neighbour_id": b["neighbour_id"][:0],
                                 "distance": np.empty(0)})
        b = b.sort_values("neighbour_id", kind="stable")
        return _hits(a, b["neighbour_id"].to_numpy(), searcher(_matrix(b["vector"]), k))

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, schema)


def _fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl).fields)


def cap_by_kind(hits: DataFrame, kinds: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Keeps the nearest few per kind, after the k cut: hits beyond k never move up.

    ``kinds`` is (neighbour_id, kind). At most k rows per query are ranked.
    """
    rank = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy("position"))
    allowed = F.lit(0)
    for kind, cap in caps.items():
        allowed = F.when(F.col("kind") == kind, F.lit(cap)).otherwise(allowed)
    return hits.join(kinds, "neighbour_id").withColumn("kind_position", rank).where(
        F.col("kind_position") <= allowed)


def first_of_kind(hits: DataFrame, kinds: DataFrame, kind: str) -> DataFrame:
    """The nearest hit of one kind per query, among the hits given."""
    return cap_by_kind(hits, kinds.where(F.col("kind") == kind), {kind: 1})
