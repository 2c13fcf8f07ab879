"""Approximate nearest neighbours: an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import materialize

#: Centroids of each half; vectors that they are fitted on at most; share of all entries that a query looks through.
CENTROIDS, FIT_ROWS, VISIT = 16, 20_000, 0.6
#: Entries and queries that meet in one block at most (about, as they are dealt by hash).
BLOCK_ENTRIES, BLOCK_QUERIES = 4096, 1024
#: Scores this near to the last one taken are compared anew by the exact measure.
SLACK = 1e-9


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    rows = vectors.where(F.col("vec_id").isNotNull() & (F.size("embedding") == dim))
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _scaled(m: np.ndarray) -> np.ndarray:
    """Rows divided by powers of two, which is exact: no square of theirs overflows or vanishes, and no cosine changes."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _apart(m: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows to the centroids."""
    return np.maximum((m * m).sum(1)[:, None] - 2 * m @ centroids.T + (centroids * centroids).sum(1), 0)


def fit(sample: np.ndarray, k: int, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """k-means of the rows of ``sample`` from a seeded start."""
    draw = np.random.default_rng(seed)
    centroids = sample[draw.choice(len(sample), k, replace=len(sample) < k)].copy()
    for _ in range(rounds):
        own = _apart(sample, centroids).argmin(1)
        for i in range(k):
            if (own == i).any():
                centroids[i] = sample[own == i].mean(0)
    return centroids


def traverse(first: np.ndarray, second: np.ndarray, counts: np.ndarray, least: int):
    """Cells (i, j) with entries by growing ``first[i] + second[j]``, until ``least`` entries are covered."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen, covered = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}, 0
    while heap and covered < least:
        _, i, j = heapq.heappop(heap)
        if counts[a[i], b[j]]:
            covered += counts[a[i], b[j]]
            yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


def _cells(batches, dim: int, centroids):
    half = dim // 2
    for batch in batches:
        v = np.array(batch.column("v").flatten(), np.float64).reshape(-1, dim)
        if not len(v):
            continue
        unit, k = _unit(v), len(centroids[0])
        i, j = _apart(unit[:, :half], centroids[0]).argmin(1), _apart(unit[:, half:], centroids[1]).argmin(1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), pa.array(i * k + j, pa.int64()), pa.array([r.tobytes() for r in v], pa.binary())], ["vec_id", "cell", "v"]
        )


def _visits(batches, dim: int, centroids, counts: np.ndarray, least: int):
    half, k = dim // 2, len(centroids[0])
    for batch in batches:
        unit = _unit(_matrix(batch.column("v"), dim)) if batch.num_rows else np.empty((0, dim))
        first, second = _apart(unit[:, :half], centroids[0]), _apart(unit[:, half:], centroids[1])
        for lo in range(0, batch.num_rows, 64):
            cells = [[i * k + j for i, j in traverse(first[n], second[n], counts, least)] for n in range(lo, min(lo + 64, batch.num_rows))]
            own = pa.array(np.repeat(np.arange(lo, lo + len(cells)), [len(c) for c in cells]))
            flat = pa.array([c for own_cells in cells for c in own_cells], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(own), flat, batch.column("v").take(own)], ["query_id", "cell", "v"])


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _rank(entries: pa.Table, queries: pa.Table, dim: int, top: int) -> pa.Table:
    """The ``top`` entries of one block for each of its queries, by the exact cosine and then vec_id."""
    if not entries.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    e, q = _scaled(_matrix(entries.column("v"), dim)), _scaled(_matrix(queries.column("v"), dim))
    ids, own = entries.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    rough = _unit(q) @ _unit(e).T
    rough[own[:, None] == ids[None, :]] = -np.inf
    norms = np.sqrt((e * e).sum(axis=1))
    out: list[list] = [[], [], []]
    for n in range(len(q)):
        last = np.partition(rough[n], -top)[-top] if len(ids) > top else -np.inf
        near = np.flatnonzero((rough[n] >= last - SLACK) & (rough[n] > -np.inf))
        score = (e[near] * q[n]).sum(axis=1) / (norms[near] * np.sqrt((q[n] * q[n]).sum()))
        best = np.lexsort((ids[near], -score))[:top]
        out[0] += [own[n]] * len(best)
        out[1] += ids[near][best].tolist()
        out[2] += score[best].tolist()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _FOUND.types)], schema=_FOUND)


def search(
    vectors: DataFrame, queries: DataFrame, *, top: int = 5, centroids: int = CENTROIDS, visit: float = VISIT, fit_rows: int = FIT_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest of ``vectors`` by cosine for each row of ``queries``.

    Both have (vec_id long, embedding array of float or double); other columns are
    ignored.  Centroids of the halves are fitted on ``fit_rows`` vectors at most
    (those with the least hashes of vec_id); every vector is entered in its cell.
    A query takes cells by summed distance until they hold ``visit`` of all
    entries, and these are ranked by the exact measure on the original vectors.
    Cells meet their queries in blocks of bounded size: a cell that holds a third
    of all vectors is many blocks.

    Null vec_ids and vectors that are null, zero, of another length than most of
    the sample, or hold null or non-finite components take no part.  An entry with
    the query's own vec_id is never its neighbour.  Ties go to the smaller vec_id.
    Fewer than ``top`` entries give fewer rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sized = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    lengths = sized.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], schema)
    dim = lengths[0]["d"]
    rows = usable(vectors, dim)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    unit, half = _unit(np.array(sample.column("v").combine_chunks().flatten(), np.float64).reshape(-1, dim)), dim // 2
    fitted = (fit(unit[:, :half], centroids), fit(unit[:, half:], centroids))

    enter = lambda df: df.mapInArrow(lambda it: _cells(it, dim, fitted), "vec_id long, cell long, v binary")
    index = materialize(enter(rows), "ann-index")
    counts = np.zeros((centroids, centroids), np.int64)
    for r in index.groupBy("cell").count().collect():  # centroids squared rows at most
        counts[divmod(r["cell"], centroids)] = r["count"]
    least = int(np.ceil(visit * counts.sum()))
    asked = enter(usable(queries, dim)).select("vec_id", "v")
    visits = asked.mapInArrow(lambda it: _visits(it, dim, fitted, counts, least), "query_id long, cell long, v binary")
    visits = materialize(visits, "ann-visits")

    def parts(cells: list, most: int):
        """SQL for the number of blocks of a cell."""
        return F.element_at(F.array(*(F.lit(max(1, -(-int(n) // most))) for n in cells)), F.col("cell").cast("int") + 1)

    asking = np.zeros(centroids * centroids, np.int64)
    for r in visits.groupBy("cell").count().collect():
        asking[r["cell"]] = r["count"]
    deep, wide = parts(counts.ravel().tolist(), BLOCK_ENTRIES), parts(asking.tolist(), BLOCK_QUERIES)
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    left = index.select("cell", dealt("vec_id", deep).alias("x"), all_of(wide).alias("y"), "vec_id", "v")
    right = visits.select("cell", all_of(deep).alias("x"), dealt("query_id", wide).alias("y"), "query_id", "v")
    met = left.groupBy("cell", "x", "y").cogroup(right.groupBy("cell", "x", "y"))
    found = met.applyInArrow(lambda e, q: _rank(e, q, dim, top), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
