"""Exact top-k search by inner product as a Voronoi kNN join.

Vectors become integers, floor(256 x). Pivots cut the space into cells. Each
query is first solved against its own cell; the score of its k-th hit is a
bound. A cell can hold something at least as good only if
``q.p + |q| * r >= bound``, with the cell's pivot p and radius r from the
cells' summaries, so a query goes to those cells only. Cells and their queries
are split into blocks of bounded size, and each pair of blocks is one local
matrix product. Products of vectors whose lengths multiply to 2**53 or more
would not be exact there; those pairs are multiplied as whole numbers.

Results by case: vectors that are null or hold a null or non-finite component
take no part; components of any finite magnitude do, and scores beyond a long
count as the largest or least one; vectors of different lengths are not
compared; a query's own row is every row with its id; repeated candidate rows
count each and repeated query rows are one query (that of the least bytes);
fewer than k candidates give fewer rows; an empty table gives an empty result;
other input columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, v): the integer components, little-endian, as 32-bit integers or, where one is too large, as doubles."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            column, ids = batch.column("embedding"), batch.column("vec_id")
            values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(256 * values)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size)
            count = lambda bad: np.diff(np.concatenate(([0], np.cumsum(bad)))[np.concatenate((end - size, end[-1:]))]) if len(end) else end
            good = (count(~np.isfinite(whole)) == 0) & column.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
            wide = count(~(np.abs(whole) < (1 << 31))) > 0
            for chosen, kind, width in ((good & ~wide, "<i4", 4), (good & wide, "<f8", 8)):
                at = np.flatnonzero(chosen)
                if len(at):
                    data = whole[np.repeat(chosen, size)].astype(kind)
                    offsets = np.concatenate(([0], np.cumsum(size[at] * width))).astype(np.int32)
                    v = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array(size[at].astype(np.int32)), v], names=["vec_id", "dim", "v"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, dim int, v binary")


def _matrix(values: list[bytes], dim: int) -> np.ndarray:
    if all(len(v) == 4 * dim for v in values):
        return np.frombuffer(b"".join(values), "<i4").reshape(len(values), dim).astype(np.float64)
    return np.stack([np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<f8").astype(np.float64) for v in values])


def _lengths(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(1))


def _assign(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds each vector's cell (the nearest pivot of its length, or -1) and distance to it."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = batch.column("dim").to_numpy()
            cell, far = np.full(len(dims), -1, np.int32), np.zeros(len(dims))
            values = batch.column("v").to_pylist()
            for d in np.unique(dims).tolist():
                if d not in pivots:
                    continue
                every, p = np.flatnonzero(dims == d), pivots[d]
                step = max(1, 4_000_000 // len(p))
                for i in range(0, len(every), step):
                    at = every[i : i + step]
                    x = _matrix([values[j] for j in at.tolist()], d)
                    with np.errstate(over="ignore", invalid="ignore"):
                        best = ((p * p).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
                        cell[at], far[at] = best, _lengths(x - p[best])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "dim", "v")), pa.array(cell), pa.array(far)], names=["vec_id", "dim", "v", "cell", "far"])

    return vectors.mapInArrow(run, "vec_id long, dim int, v binary, cell int, far double")


def best_of(q: np.ndarray, qids: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[list, list, list]:
    """(query ids, vector ids, scores) of each query's k best; ``ids`` ascend."""
    with np.errstate(over="ignore"):
        large = _lengths(q)[:, None] * _lengths(x)[None, :] >= _EXACT
    with np.errstate(over="ignore", invalid="ignore"):
        scores = q @ x.T
    scores[(qids[:, None] == ids[None, :]) | large] = -np.inf
    best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(best)), best.shape[1])
    best = best.reshape(-1)
    s = scores[row, best]
    ok = np.isfinite(s)
    found = [qids[row[ok]].tolist(), ids[best[ok]].tolist(), s[ok].astype(np.int64).tolist()]
    large &= qids[:, None] != ids[None, :]
    for i in np.flatnonzero(large.any(1)).tolist():
        left = [int(c) for c in q[i].tolist()]
        exact = sorted((-sum(a * int(b) for a, b in zip(left, x[j].tolist(), strict=True)), j) for j in np.flatnonzero(large[i]).tolist())[:k]
        for s, j in exact:
            for column, value in zip(found, (int(qids[i]), int(ids[j]), max(-_LONG - 1, min(_LONG, -s))), strict=True):
                column.append(value)
    return tuple(found)


def _solve(queries: DataFrame, data: DataFrame, k: int, block: int, sizes: DataFrame) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in every block of the cell that it comes with."""
    blocks = F.broadcast(sizes.select("dim", "cell", F.greatest(F.ceil(F.col("n") / block), F.lit(1)).cast("int").alias("nb")))
    n = F.col("nb")
    data = data.join(blocks, ["dim", "cell"]).withColumn("db", F.pmod(F.xxhash64("vec_id"), n).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 16).cast("int")))).drop("nb")
    queries = queries.join(blocks, ["dim", "cell"]).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.floor((n - 1) / 16) + 1).cast("int")).withColumn("db", F.explode(F.sequence(F.lit(0), n - 1))).drop("nb")

    def local(left, right):
        import pyarrow as pa

        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            dim = left.column("dim")[0].as_py()
            x = _matrix(right.column("v").to_pylist(), dim)
            ids, qids = right.column("vec_id").to_numpy(), left.column("query_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            x, ids = x[order], ids[order]
            for a in range(0, left.num_rows, 256):
                for column, part in zip(out, best_of(_matrix(left.column("v").slice(a, 256).to_pylist(), dim), qids[a : a + 256], x, ids, k), strict=True):
                    column.extend(part)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    keys = ["dim", "cell", "db", "qb"]
    return queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(local, "query_id long, vec_id long, score long")


def _reach(queries: DataFrame, cells: dict[tuple[int, int], float], pivots: dict[int, np.ndarray]) -> DataFrame:
    """A row for each query and each other cell that can hold a hit: (query_id, dim, v, cell)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims, own = batch.column("dim").to_numpy(), batch.column("cell").to_numpy()
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(float)
            values = batch.column("v").to_pylist()
            for d in np.unique(dims).tolist():
                near = sorted(c for dim, c in cells if dim == d)
                if not near:
                    continue
                radius = np.array([cells[(d, c)] for c in near])
                p = pivots[d][near] if d in pivots and near[0] >= 0 else None
                every, near = np.flatnonzero(dims == d), np.array(near, np.int32)
                step = max(1, 2_000_000 // len(near))
                for i in range(0, len(every), step):
                    at = every[i : i + step]
                    q = _matrix([values[j] for j in at.tolist()], d)
                    out = np.zeros((len(at), len(near)), bool)
                    if p is not None:
                        norm = _lengths(q)[:, None]
                        with np.errstate(over="ignore", invalid="ignore"):
                            most = q @ p.T + norm * radius[None, :]
                            slack = 1 + 1e-9 * norm * (_lengths(p) + radius)[None, :]
                            out = most + slack < bound[at][:, None]  # false where a bound is missing or a product overflows
                    rows, to = np.nonzero(~out & (own[at][:, None] != near[None, :]))
                    if len(rows):
                        take = pa.array(at[rows])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in ("query_id", "dim", "v")), pa.array(near[to])], names=["query_id", "dim", "v", "cell"])

    return queries.mapInArrow(run, "query_id long, dim int, v binary, cell int")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, cell_rows: int = 1000, most_pivots: int = 4096, block: int = 4096, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by ``every``; exact.

    A cell has about ``cell_rows`` rows as long as that needs no more than
    ``most_pivots`` pivots. These and one summary row a cell come to the driver.
    """
    whole = cut(_integers(vectors))
    count = whole.count()
    pivots: dict[int, list] = {}
    for r in whole.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id", "v").limit(min(most_pivots, max(4, count // cell_rows))).collect():
        pivots.setdefault(r["dim"], []).append(bytes(r["v"]))
    centres = {d: _matrix(v, d) for d, v in pivots.items() if d > 0}
    data = cut(_assign(whole, centres))
    summary = cut(data.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")))
    cells = {(r["dim"], r["cell"]): r["far"] for r in summary.collect()}  # a row a pivot, and one for each length without
    queries = data.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min(F.struct("v", "dim", "cell")).alias("x")).select("query_id", "x.dim", "x.v", "x.cell")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = cut(_solve(queries, data, k, block, summary))
    bound = near.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("query_id", F.when(F.col("score") > -_LONG, F.col("score").cast("double")).alias("bound"))
    far = _solve(_reach(queries.join(bound, "query_id", "left"), cells, centres), data, k, block, summary)
    hits = near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id AS vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id AND len(q.e) = len(d.e)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
