"""Nearest neighbours by inner product through an inverted multi-index.

Both halves of a vector are quantised on their own, by codebooks of k centroids, so a cell
is a pair of centroids: k * k cells from 2 * k centroids. A query visits centroid pairs in
order of their summed distance, which is the negative inner product here, with a heap over
the two sorted lists; it stops when the cells visited hold ``visit`` vectors. The entries
of those cells are reranked exactly.

* ``distinct_vectors``: equal vectors are one entry that names its smallest identifiers; a
  list of n nearest cannot need more than n + 1 of them. Every row is indexed this way.
* ``fit`` learns the codebooks from a sample of about ``SAMPLE`` distinct vectors, the
  smallest hashes. All else covers all rows.
* ``measured_visit`` finds how many entries have to be visited: about ``PROBES`` distinct
  query vectors are searched exhaustively in one scan, and ``visit`` is what would have
  found ``RECALL`` of their true neighbours. What a table without structure needs is a
  fixed share of it; structure makes that share small.
* ``search`` deals the entries into shards of whole cells, or parts of large ones, of about
  ``SHARD_ROWS`` rows. A query is sent once to each shard it visits. A task holds one shard
  and streams its queries past it, so neither many queries nor a hot cell fill its memory.

Scores are sums of products in double precision, from the first component to the last.

Defined cases: a vector takes no part, neither as query nor as candidate, if it is null,
all zeros, holds a null, NaN or infinite component, or differs in length from the most
frequent length (the longer one of equally frequent ones), and so does a row without
identifier. Of rows that share an identifier the one with the largest vector, compared by
components, takes part. Ties go to the smaller identifier. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from keepwell.session import settle

SAMPLE = 32_768
ROUNDS = 10
PROBES = 256
RECALL = 0.95
SHARD_ROWS = 4096
QUERY_ROWS = 256
LEAST_CENTROIDS, MOST_CENTROIDS = 4, 512  # k * k cell sizes fit the driver

_KEY = ["h1", "h2"]
_SLACK = 1e-9


def _usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and not all zeros."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def usable_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, one per identifier."""
    kept = F.col(vector) if dict(df.dtypes)[vector] == "array<float>" else F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).alias("id"), kept.alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _usable(F.col("vector")))
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    top = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    if top is not None:
        rows = rows.where(F.size("vector") == top.length)
    return rows.groupBy("id").agg(F.max("vector").alias("vector"))


def distinct_vectors(rows: DataFrame, n: int) -> DataFrame:
    """(h1, h2, vector, ids): each vector once, under a 128-bit hash, with its n + 1 smallest identifiers.

    The window keeps n + 1 rows per vector and task before rows are shuffled.
    """
    order = F.row_number().over(Window.partitionBy(*_KEY).orderBy("id"))
    first = rows.withColumn("place", order).where(F.col("place") <= n + 1)
    return first.groupBy(*_KEY).agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("id")).alias("ids"))


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("h1", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit("second"), "vector"))


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids * centroids).sum(1) / 2
    return np.concatenate([(x[i:i + 8192] @ centroids.T - half).argmax(1) for i in range(0, len(x), 8192)] or [np.empty(0, np.int64)])


def _lloyd(x: np.ndarray, k: int) -> np.ndarray:
    centroids = x[np.random.default_rng(7).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = _nearest_centroid(x, centroids)
        size = np.bincount(at, minlength=k)
        total = np.zeros_like(centroids)
        np.add.at(total, at, x)
        centroids[size > 0] = total[size > 0] / size[size > 0, None]
    return centroids


@dataclass
class Codebooks:
    """Centroids of the two halves of a vector."""

    first: np.ndarray
    second: np.ndarray

    @property
    def k(self) -> int:
        return len(self.first)

    def cells(self, x: np.ndarray) -> np.ndarray:
        cut = self.first.shape[1]
        return _nearest_centroid(x[:, :cut], self.first) * self.k + _nearest_centroid(x[:, cut:], self.second)

    def closeness(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return self.first @ query[:cut], self.second @ query[cut:]

    def traverse(self, query: np.ndarray) -> Iterator[int]:
        """Cells by falling sum of the halves' inner products.

        The heap holds, for each first centroid reached, the next second one: a pair's
        followers are the pair with the next second centroid and, from the head of a
        list, the head of the next list.
        """
        a, b = self.closeness(query)
        by_a, by_b = np.argsort(-a, kind="stable").tolist(), np.argsort(-b, kind="stable").tolist()
        a, b, k = a.tolist(), b.tolist(), self.k
        heap = [(-(a[by_a[0]] + b[by_b[0]]), 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield by_a[i] * k + by_b[j]
            if j + 1 < k:
                heapq.heappush(heap, (-(a[by_a[i]] + b[by_b[j + 1]]), i, j + 1))
            if j == 0 and i + 1 < k:
                heapq.heappush(heap, (-(a[by_a[i + 1]] + b[by_b[0]]), i + 1, 0))


def centroids_for(rows: int) -> int:
    """A power of two near a quarter of the root of the row count."""
    wanted = max(1.0, rows ** 0.5 / 4)
    return int(min(MOST_CENTROIDS, max(LEAST_CENTROIDS, 2 ** round(np.log2(wanted)))))


def _share(entries: DataFrame, rows: int, wanted: int) -> pa.Table:
    """About ``wanted`` of the entries, or all if there are fewer: those with the smallest hashes."""
    if rows > wanted:
        entries = entries.where(F.shiftrightunsigned("h1", 1) < int(2 ** 63 * (wanted / rows)))
    return entries.orderBy(*_KEY).toArrow()


def fit(entries: DataFrame, rows: int, sample: int = SAMPLE) -> Codebooks:
    """Codebooks of a bounded sample of the distinct vectors."""
    x = _matrix(_share(entries.select(*_KEY, "vector"), rows, sample).column("vector").combine_chunks())
    k = min(centroids_for(rows), len(x))
    cut = max(1, x.shape[1] // 2)
    return Codebooks(_lloyd(x[:, :cut], k), _lloyd(x[:, cut:], k) if x.shape[1] > cut else np.zeros((k, 0)))


def index(entries: DataFrame, books: Codebooks) -> DataFrame:
    """``entries`` with the cell of each."""
    schema = T.StructType([*entries.schema.fields, T.StructField("cell", T.IntegerType())])
    at = entries.columns.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = books.cells(_matrix(batch.column(at))) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.astype(np.int32))], names=schema.names)

    return entries.mapInArrow(run, schema)


def cell_sizes(indexed: DataFrame, k: int) -> np.ndarray:
    """Entries per cell; k * k numbers."""
    found = indexed.groupBy("cell").agg(F.count("*").alias("n")).toArrow()
    sizes = np.zeros(k * k, dtype=np.int64)
    sizes[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return sizes


def measured_visit(indexed: DataFrame, queries: DataFrame, books: Codebooks, sizes: np.ndarray, n: int,
                   probes: int = PROBES, recall: float = RECALL) -> int:
    """How many entries a query has to visit to meet ``recall`` of its n nearest, by exhaustive search of some queries."""
    asked = _share(queries.select(*_KEY, "vector"), queries.count(), probes)
    if not asked.num_rows:
        return n + 1
    vectors = _matrix(asked.column("vector").combine_chunks())
    keys = [asked.column(h).to_numpy() for h in _KEY]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cell = _matrix(batch.column("vector")), batch.column("cell").to_numpy()
            if not len(x):
                continue
            own = np.logical_and(*[k[:, None] == batch.column(h).to_numpy() for k, h in zip(keys, _KEY)])
            scores = np.where(own, -np.inf, vectors @ x.T)
            top = min(n, len(x))
            at = np.argpartition(-scores, top - 1, axis=1)[:, :top]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(np.arange(len(vectors)), top)), pa.array(np.take_along_axis(scores, at, 1).ravel()),
                pa.array(cell[at].ravel())], names=["query", "score", "cell"])

    found = indexed.select(*_KEY, "vector", "cell").mapInArrow(run, "query long, score double, cell int").where(F.col("score") > float("-inf"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
    nearest = found.withColumn("place", best).where(F.col("place") <= n).select("query", "cell").toArrow()
    needed = [n + 1]
    wanted = {int(q): [] for q in range(len(vectors))}
    for q, cell in zip(nearest.column("query").to_pylist(), nearest.column("cell").to_pylist()):
        wanted[q].append(cell)
    for q, cells in wanted.items():
        a, b = books.closeness(vectors[q])
        order = np.argsort(-(a[:, None] + b[None, :]).ravel(), kind="stable")
        upto = np.empty(len(order), dtype=np.int64)
        upto[order] = np.cumsum(sizes[order])
        needed.extend(upto[cells].tolist())
    return max(n + 1, int(np.quantile(needed, recall, method="higher")))


def _shards(sizes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard of each cell and the number of shards it is dealt over. Small cells share one, large ones are split."""
    parts = np.maximum(1, -(-sizes // rows))
    alone = parts > 1
    shared = np.cumsum(np.where(alone, 0, sizes)) // rows  # neighbours share the first centroid
    used, place = np.unique(shared[~alone], return_inverse=True)
    first = np.zeros(len(sizes), dtype=np.int64)
    first[~alone] = place
    first[alone] = len(used) + np.cumsum(parts[alone]) - parts[alone]
    return first, parts


def search(indexed: DataFrame, queries: DataFrame, books: Codebooks, sizes: np.ndarray, visit: int, n: int,
           shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(h1, h2, score, ids): the n + 1 best entries found in each shard for each query vector."""
    first, parts = _shards(sizes, shard_rows)
    id_type = indexed.schema["ids"].dataType
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("asks", T.BooleanType()),
        T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()),
        indexed.schema["vector"], T.StructField("ids", id_type),
        T.StructField("cells", T.ArrayType(T.IntegerType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column("cell").to_numpy().astype(np.int64)
            shard = first[cell] + batch.column("h1").to_numpy() % parts[cell]
            rows, none = batch.num_rows, pa.nulls(batch.num_rows, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([
                pa.array(shard), pa.array(np.zeros(rows, dtype=bool)), batch.column("h1"), batch.column("h2"), batch.column("vector"), batch.column("ids"),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1), pa.int32()), pa.array(cell, pa.int32())) if rows else none],
                names=schema.names)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.schema.field("ids").type
            for at, vector in enumerate(_matrix(batch.column("vector"))):
                visited, met = {}, 0
                for cell in books.traverse(vector):
                    if sizes[cell]:
                        met += int(sizes[cell])
                        for part in range(int(parts[cell])):
                            visited.setdefault(int(first[cell]) + part, []).append(cell)
                        if met >= visit:
                            break
                many = len(visited)
                row = batch.slice(at, 1)
                again = pa.array(np.zeros(many, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(visited), pa.int64()), pa.array(np.ones(many, dtype=bool)), row.column("h1").take(again), row.column("h2").take(again),
                    row.column("vector").take(again), pa.nulls(many, ids), pa.array(list(visited.values()), pa.list_(pa.int32()))],
                    names=schema.names)

    columns = ["h1", "h2", "vector", "ids"]
    dealt = indexed.select(*columns, "cell").mapInArrow(deal, schema)
    asked = queries.select(*columns).mapInArrow(ask, schema)
    met = dealt.unionByName(asked).repartition("shard").sortWithinPartitions("shard", "asks")
    answer = T.StructType([schema["h1"], schema["h2"], T.StructField("score", T.DoubleType()), schema["ids"]])

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        x = cell = ids = None
        for batch in batches:
            number, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(number)] if len(number) else []):
                piece = batch.slice(start, end - start)
                if number[start] != shard:
                    shard, held, x = int(number[start]), [], None
                if not asks[start]:
                    held.append(piece)
                    continue
                if x is None:
                    table = pa.Table.from_batches(held)
                    order = np.argsort(table.column("cells").combine_chunks().flatten().to_numpy(), kind="stable")
                    table = table.take(pa.array(order)).combine_chunks()
                    x, ids = _matrix(table.column("vector").combine_chunks()), table.column("ids").combine_chunks()
                    cell = table.column("cells").combine_chunks().flatten().to_numpy()
                    held = []
                for at in range(0, piece.num_rows, QUERY_ROWS):
                    yield from _best(piece.slice(at, QUERY_ROWS), x, cell, ids, n + 1, answer.names)

    return met.mapInArrow(rerank, answer)


def _best(asked: pa.RecordBatch, x: np.ndarray, cell: np.ndarray, ids: pa.Array, n: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The n best of a shard's entries in the cells that each query visits, and all that tie with the last.

    ``x`` is ordered by cell. One matrix product per cell with the queries that visit it
    chooses candidates; their scores are then added up in order.
    """
    queries = _matrix(asked.column("vector"))
    visits = asked.column("cells")
    who = np.repeat(np.arange(len(queries)), visits.value_lengths().to_numpy())
    where = visits.flatten().to_numpy()
    order = np.argsort(where, kind="stable")
    who, where = who[order], where[order]
    scores = np.full((len(queries), len(x)), -np.inf)
    heads = np.flatnonzero(np.append(True, where[1:] != where[:-1]))
    for s, e in zip(heads, np.append(heads[1:], len(where))):
        lo, hi = np.searchsorted(cell, [where[s], where[s] + 1])
        if lo < hi:
            scores[who[s:e], lo:hi] = queries[who[s:e]] @ x[lo:hi].T
    top = min(n, len(x))
    least = -np.partition(-scores, top - 1, axis=1)[:, top - 1]
    reach = np.sqrt((queries * queries).sum(1) * (x * x).sum(1).max())
    q, at = np.nonzero((scores >= (least - _SLACK * reach)[:, None]) & np.isfinite(scores))
    exact = np.zeros(len(q))
    for d in range(x.shape[1]):
        exact += queries[q, d] * x[at, d]
    take = pa.array(q)
    yield pa.RecordBatch.from_arrays([asked.column("h1").take(take), asked.column("h2").take(take), pa.array(exact), ids.take(pa.array(at))], names=names)


def nearest(df: DataFrame, key: str, vector: str, n: int, asks: Column, centroids: Codebooks | None = None,
            visit: int | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query, rank, id, score): the n nearest found of each row for which ``asks`` holds, a condition on ``id``.

    The codebooks and the number of entries to visit are learned unless given.
    """
    spark: SparkSession = df.sparkSession
    rows = settle(_hashed(usable_vectors(df, key, vector)), "vectors")
    entries = settle(distinct_vectors(rows, n), "distinct-vectors")
    asking = rows.where(asks).select(F.col("id").alias("query"), *_KEY)
    queries = settle(entries.join(asking.select(*_KEY).distinct(), _KEY, "left_semi"), "query-vectors")
    total = entries.count()
    if not total:
        return spark.createDataFrame([], T.StructType([
            T.StructField("query", rows.schema["id"].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField("id", rows.schema["id"].dataType), T.StructField("score", T.DoubleType())]))
    books = centroids or fit(entries, total)
    indexed = settle(index(entries, books), "multi-index")
    sizes = cell_sizes(indexed, books.k)
    if visit is None:
        visit = measured_visit(indexed, queries, books, sizes, n)
    found = search(indexed, queries, books, sizes, max(visit, n + 1), n, shard_rows)
    return _listed(asking, found, n)


def _listed(asking: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """From the best vectors per query vector to the best rows per query row."""
    ordered = Window.partitionBy(*_KEY).orderBy(F.desc("score"), "id")
    rows = found.select(*_KEY, "score", F.explode("ids").alias("id"))
    best = rows.withColumn("place", F.row_number().over(ordered)).where(F.col("place") <= n + 1)
    lists = best.groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda x: x.id != F.col("query")), 1, n)
    return (asking.join(lists, _KEY).select("query", F.posexplode(others).alias("rank", "x"))
            .select("query", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score")))
