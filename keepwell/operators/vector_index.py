"""A stored index for exact nearest neighbours by squared Euclidean distance.

Layout below ``root``:

* ``centres``: one row per cell, learned once from a bounded sample (``SAMPLE`` rows,
  at most ``MAX_CELLS`` cells);
* ``entries/cell=<n>``: identifier, vector, and its code: the residual to the centre in
  steps of ``step`` as one signed byte per component, with ``error``, the distance
  between the vector and what its code says; ``twin`` is the entry's place among equal
  vectors, so a search for k passes over all but k of a vector's copies;
* ``cells/batch=<n>``: per cell the number of entries and the smallest and largest
  distance to the centre. A batch counts once this table is there: it is written last,
  and entries of other batches are not read.

A search never reads the index as a whole:

1. From centres and cell bounds alone the triangle inequality gives each query a distance
   within which k entries must lie; cells farther than that are not opened.
2. The few cells a query is closest to are read by their codes. Distances to coded
   vectors plus and minus ``error`` bound the true ones, so the k-th smallest upper
   bound tightens the limit and rules out further cells.
3. The remaining cells are read the same way; entries whose lower bound exceeds the limit
   are dropped, the few others are fetched and ranked by exact distance.

Cells are directories, so steps 2 and 3 prune partitions, and of the vectors only the
candidates' are read. The results are those of a full comparison, rounded alike, ties to
the lower identifier. Vectors without structure rule out little, as in any exact search.

Defined cases: rows without identifier or vector, and vectors of another length than the
centres', are not indexed and find nothing; fewer than k entries are all found; an
identifier that is added twice is there twice; an empty index finds nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from keepwell.operators import neighbours
from keepwell.operators.neighbours import DIGITS, _matrix, _squares
from keepwell.session import settle
from keepwell.sources.tables import exists

SAMPLE = 50_000
MAX_CELLS = 1024
CELL_ROWS = 50_000
ROUNDS = 8
FILE_ROWS = 1_000_000
PROBED = 2
_SLACK = 2.0 * 10.0 ** -DIGITS


def _centres(x: np.ndarray, k: int) -> np.ndarray:
    centres = x[np.random.default_rng(3).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([_squares(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[size > 0] = total[size > 0] / size[size > 0, None]
    return centres


def build(rows: DataFrame, root: str, key: str = "id", vector: str = "vector", cells: int | None = None) -> None:
    """Learns the centres from ``rows`` and adds them as the first batch."""
    spark = rows.sparkSession
    known = rows.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        "id is not null and vector is not null")
    total = known.count()
    share = F.lit(True) if total <= SAMPLE else F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40)) < int((1 << 40) * SAMPLE / total)
    sample = known.where(share).select("id", "vector").toPandas().sort_values("id", kind="stable")
    width = int(sample["vector"].map(len).mode().max()) if len(sample) else 0
    x = _matrix(sample["vector"][sample["vector"].map(len) == width])
    wanted = cells or min(MAX_CELLS, max(math.ceil(total / CELL_ROWS), math.ceil(math.sqrt(total) / 4)))
    found = _centres(x, min(wanted, len(x))) if len(x) else np.empty((0, 0))
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(found)], "cell int, centre array<double>") \
        .coalesce(1).write.parquet(f"{root}/centres")
    append(rows, root, key, vector)


def _read_centres(spark: SparkSession, root: str) -> np.ndarray:
    table = spark.read.parquet(f"{root}/centres").toPandas().sort_values("cell")
    return _matrix(table["centre"])


def encode(x: np.ndarray, centres: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, steps, and the distances between vectors and what their codes say."""
    rest = x - centres[cell]
    step = np.abs(rest).max(1, initial=0.0) / 127.0
    code = np.rint(rest / np.where(step > 0, step, 1.0)[:, None]).astype(np.int8)
    return code, step, np.sqrt(((rest - code * step[:, None]) ** 2).sum(1))


def append(rows: DataFrame, root: str, key: str = "id", vector: str = "vector") -> int:
    """Adds rows under the centres that are there; they are found once the batch is complete. Returns its number."""
    spark = rows.sparkSession
    centres = _read_centres(spark, root)
    batch = max(_batches(spark, root), default=-1) + 1
    source = rows.select(F.col(key).alias("id"), F.col(vector).alias("vector")).where("id is not null and vector is not null")
    if len(centres):
        source = source.where(F.size("vector") == centres.shape[1])

    def place(parts):
        for part in parts:
            if len(part) and len(centres):
                x = _matrix(part["vector"])
                d = _squares(x, centres)
                cell = d.argmin(1)
                code, step, error = encode(x, centres, cell)
                yield part.assign(code=[c.tobytes() for c in code], step=step, error=error,
                                  radius=np.sqrt(((x - centres[cell]) ** 2).sum(1)), cell=cell.astype("int32"))

    schema = StructType([*source.schema.fields, *StructType.fromDDL("code binary, step double, error double, radius double, cell int").fields])
    placed = settle(source.mapInPandas(place, schema), "placed")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high"))
    sizes = settle(sizes, "cell-sizes")
    # places are given within shares of at most about FILE_ROWS: k in each are more than the k needed
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(total // FILE_ROWS + 1))
    twin = F.row_number().over(Window.partitionBy("vector", share).orderBy("id"))
    # a large cell is dealt over several tasks
    parts = F.ceil(F.col("n") / FILE_ROWS)
    dealt = placed.withColumn("twin", twin).join(F.broadcast(sizes.select("cell", parts.alias("parts"))), "cell").withColumn(
        "part", F.pmod(F.xxhash64(F.col("id").cast("string")), F.col("parts")))
    (dealt.repartition("cell", "part").withColumn("batch", F.lit(batch)).drop("parts", "part", "radius")
     .write.mode("append").partitionBy("cell").parquet(f"{root}/entries"))
    sizes.coalesce(1).write.parquet(f"{root}/cells/batch={batch}")
    return batch


def _batches(spark: SparkSession, root: str) -> list[int]:
    """Complete batches: those whose cell table was written to its end."""
    base = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/cells")
    store = base.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in store.listStatus(base)] if store.exists(base) else []
    return [int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and exists(spark, f"{root}/cells/{n}/_SUCCESS")]


@dataclass
class Index:
    """What a search holds on the driver: centres and cell bounds, at most ``MAX_CELLS`` of each."""

    centres: np.ndarray
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray
    entries: DataFrame | None

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance from each query to the entries of each cell."""
        d = np.sqrt(_squares(queries, self.centres))
        near = np.maximum(np.maximum(d - self.high, self.low - d), 0.0)
        return np.where(self.size > 0, near, np.inf), np.where(self.size > 0, d + self.high, np.inf)

    def limits(self, queries: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query has k entries, from cell bounds alone."""
        _, far = self.bounds(queries)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.size[order], axis=1) >= min(k, self.size.sum())
        return np.take_along_axis(far, order, 1)[np.arange(len(far)), enough.argmax(1)]


def open_index(spark: SparkSession, root: str) -> Index:
    centres, batches = _read_centres(spark, root), _batches(spark, root)
    size, low, high = np.zeros(len(centres)), np.full(len(centres), np.inf), np.zeros(len(centres))
    if not len(centres) or not batches:
        return Index(centres, size, low, high, None)
    cells = spark.read.parquet(*[f"{root}/cells/batch={b}" for b in batches]).groupBy("cell").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    size[cells["cell"]], low[cells["cell"]], high[cells["cell"]] = cells["n"], cells["low"], cells["high"]
    entries = spark.read.parquet(f"{root}/entries").where(F.col("batch").isin(batches)) if size.sum() else None
    return Index(centres, size, low, high, entries)


def _near_codes(entries: DataFrame, index: Index, asked: np.ndarray, visits: np.ndarray, limit: np.ndarray, k: int) -> DataFrame:
    """(query, cell, id, low, high) of entries that may be among the k nearest, by bounds of squared distances.

    Queries, their cells and limits travel; a task keeps what its own k-th upper bound allows.
    """
    sent = entries.sparkSession.sparkContext.broadcast((asked, visits, limit, index.centres))
    cells = np.flatnonzero(visits.any(0)).tolist()
    schema = StructType([*StructType.fromDDL("query int, cell int").fields, entries.schema["id"],
                         *StructType.fromDDL("low double, high double").fields])

    def search(batches):
        queries, wanted, most, centres = sent.value
        best = np.square(most)  # a k-th upper bound of one task holds for all
        kept = np.full((len(queries), k), np.inf)
        for batch in batches:
            for cell, rows in batch.groupby("cell", sort=False):
                who = np.flatnonzero(wanted[:, cell])
                code = np.frombuffer(b"".join(rows["code"]), dtype=np.int8).reshape(len(rows), -1)
                x = centres[cell] + code * rows["step"].to_numpy()[:, None]
                error, step = rows["error"].to_numpy(), max(1, neighbours.BLOCK_CELLS // len(rows))
                for start in range(0, len(who), step):
                    q = who[start:start + step]
                    d = np.sqrt(_squares(queries[q], x))
                    high, low = np.square(d + error), np.square(np.maximum(d - error, 0.0))
                    kept[q] = np.partition(np.concatenate([kept[q], high], axis=1), k - 1, axis=1)[:, :k]
                    best[q] = np.minimum(best[q], kept[q].max(1))
                    at, col = np.nonzero(low <= best[q][:, None] + _slack(best[q])[:, None])
                    if len(at):
                        yield pd.DataFrame({"query": q[at].astype("int32"), "cell": np.int32(cell), "id": rows["id"].to_numpy()[col],
                                            "low": low[at, col], "high": high[at, col]})

    return entries.where(F.col("cell").isin(cells) & (F.col("twin") <= k)).select("id", "code", "step", "error", "cell").mapInPandas(search, schema)


def _slack(squares: np.ndarray) -> np.ndarray:
    """Covers the rounding of results and of the arithmetic behind the bounds."""
    return _SLACK + 1e-9 * np.where(np.isfinite(squares), squares, 0.0)


def candidates(index: Index, asked: np.ndarray, k: int, probed: int = PROBED) -> DataFrame:
    """(query, cell, id) of all entries that can be among the k nearest of each query."""
    near, _ = index.bounds(asked)
    limit = index.limits(asked, k)
    open_cells = near <= (limit + 1e-6)[:, None]
    first = np.zeros_like(open_cells)
    rows = np.arange(len(asked))[:, None]
    first[rows, np.argsort(near + 1e-9 * _squares(asked, index.centres), axis=1)[:, :probed]] = True
    first &= open_cells
    probe = settle(_near_codes(index.entries, index, asked, first, limit, k), "probed")
    best = F.row_number().over(Window.partitionBy("query").orderBy("high"))
    kth = probe.withColumn("place", best).where(F.col("place") == k).select("query", "high").toPandas()  # one row per query
    limit = limit.copy()
    limit[kth["query"]] = np.minimum(limit[kth["query"]], np.sqrt(kth["high"]))
    rest = open_cells & ~first & (near <= (limit + 1e-6)[:, None])
    found = probe
    if rest.any():
        found = settle(probe.unionByName(_near_codes(index.entries, index, asked, rest, limit, k)), "near-codes")
    kth = F.max("high").over(Window.partitionBy("query"))  # of the k smallest upper bounds
    upper = found.withColumn("place", best).where(F.col("place") <= k).withColumn("kth", F.when(F.count("*").over(
        Window.partitionBy("query")) >= k, kth).otherwise(float("inf"))).select("query", "kth").distinct()
    return found.join(upper, "query").where(F.col("low") <= F.col("kth") * (1 + 1e-9) + _SLACK).select("query", "cell", "id")


def search(queries: DataFrame, root: str, k: int, query_id: str = "id", vector: str = "vector",
           max_bytes: int = neighbours.MAX_QUESTION_BYTES, index: Index | None = None) -> DataFrame:
    """(query_id, neighbour_id, distance, position) of the k nearest entries of each query, exactly.

    Queries within ``max_bytes`` travel to the cells; more of them meet the entries in
    the tiles of ``neighbours.nearest``.
    """
    spark = queries.sparkSession
    index = index or open_index(spark, root)
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("vector").isNotNull() & (F.size("vector") == (index.centres.shape[1] if len(index.centres) else 0)))
    if index.entries is None:
        return spark.createDataFrame([], StructType([q.schema["query_id"], *StructType.fromDDL(
            "neighbour_id string, distance double, position int").fields]))
    entries = index.entries
    schema = StructType([q.schema["query_id"], entries.schema["id"], *StructType.fromDDL("distance double").fields])
    fits = max_bytes // (8 * index.centres.shape[1] + 32 + 16 * len(index.centres))
    if q.limit(fits + 1).count() > fits:
        return neighbours.nearest(q, entries.select(F.col("id").alias("neighbour_id"), "vector"), k, "query_id", "neighbour_id")
    table = q.toPandas()
    if not len(table):
        return neighbours._ranked(spark.createDataFrame([], schema).withColumnRenamed("id", "neighbour_id"), k)
    asked = _matrix(table["vector"])
    found = settle(candidates(index, asked, k), "candidates")
    cells = [r.cell for r in found.select("cell").distinct().collect()]  # at most MAX_CELLS
    vectors = entries.where(F.col("cell").isin(cells) & (F.col("twin") <= k)).select("id", "cell", "vector")
    met = found.distinct().join(vectors, ["cell", "id"])
    sent = spark.sparkContext.broadcast((table["query_id"].to_numpy(), asked))

    def measure(batches):
        names, matrix = sent.value
        for batch in batches:
            if len(batch):
                at = batch["query"].to_numpy()
                d = np.round(((matrix[at] - _matrix(batch["vector"])) ** 2).sum(1), DIGITS)
                yield pd.DataFrame({"query_id": names[at], "id": batch["id"], "distance": d})

    hits = met.select("query", "id", "vector").mapInPandas(measure, schema).withColumnRenamed("id", "neighbour_id")
    return neighbours._ranked(hits, k)
