"""Exact nearest neighbours by cosine or L2 over unit vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.functions.vector import dot, literal

#: Query vectors that are broadcast, or that one task of the grid holds.
QUERIES = 4096
#: Corpus vectors in one task of the grid, in one matrix product, and centroids in one tile of pairs.
CORPUS, PIECE, TILE = 65_536, 2048, 1024
#: Most pivots around which vectors are dealt.
PIVOTS = 1024


def scored(vectors: DataFrame, query: list[float]) -> DataFrame:
    """Rows with the cosine to one vector in place of their own: what a join or a window then carries."""
    return vectors.withColumn("cosine", dot(F.col("embedding"), literal(query))).drop("embedding")


def nearest(vectors: DataFrame, query: list[float], k: int, keys: list[str]) -> DataFrame:
    """The k rows nearest to one vector: keys, cosine and rank from 0; ties by the keys."""
    return closest(scored(vectors, query), k, keys)


def closest(rows: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """As ``nearest``, of rows that are scored already."""
    best = rows.select(*keys, "cosine").orderBy(F.desc("cosine"), *keys).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("cosine"), *keys)) - 1)


class _Best:
    """The k best (cosine, id) of each of a few queries over pieces of a corpus."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, least: float | None, skip_self: bool):
        self.ids, self.q, self.k, self.least, self.skip_self = ids, q, k, least, skip_self
        self.floor = np.full(len(ids), -np.inf if least is None else least)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, mine: np.ndarray, m: np.ndarray) -> None:
        cos = self.q @ m.T
        if self.skip_self:
            cos[self.ids[:, None] == mine[None, :]] = -np.inf
        floor = self.floor
        if cos.shape[1] > self.k:  # all that reach the piece's k-th best: ties at the edge stay for the merge
            floor = np.maximum(floor, np.partition(cos, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((cos >= floor[:, None]) & (cos > -np.inf))
        at, other, c = (np.concatenate(x) for x in zip(self.found, (i, mine[j], cos[i, j])))
        order = np.lexsort((other, -c, at))
        at, other, c = at[order], other[order], c[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        keep = place < self.k
        self.found = at[keep], other[keep], c[keep]
        full = place == self.k - 1
        self.floor[at[full]] = c[full]

    def batch(self):
        import pyarrow as pa

        at, other, c = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at], pa.int64()), pa.array(other, pa.int64()), pa.array(c, pa.float64())], names=["query_id", "neighbour_id", "cosine"])


def _pieces(batch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of an Arrow batch (id, embedding)."""
    for at in range(0, batch.num_rows, PIECE):
        piece = batch.slice(at, PIECE)
        yield piece.column(0).to_numpy(zero_copy_only=False), np.stack(piece.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)


FOUND = "query_id long, neighbour_id long, cosine double"


def batch_nearest(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", least: float | None = None, skip_self: bool = True) -> DataFrame:
    """(query_id, neighbour_id, cosine, rank from 0): the k nearest rows of ``vectors`` for each query.

    Up to QUERIES queries are broadcast and meet the corpus in place. More make a grid: tiles of queries by parts of the
    corpus, each cell a task of bounded size. Either way a task keeps k rows a query; the final ranking is by query.
    """
    corpus = vectors.select(F.col(id).cast("long").alias("id"), "embedding")
    asked = queries.select(F.col(id).cast("long").alias("id"), "embedding")
    n = asked.count()
    if not n:
        out = spark.createDataFrame([], FOUND)
    elif n <= QUERIES:
        rows = asked.orderBy("id").collect()  # QUERIES rows at most
        shared = spark.sparkContext.broadcast((np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.float64)))

        def run(batches):
            best = _Best(*shared.value, k, least, skip_self)
            for batch in batches:
                for mine, m in _pieces(batch):
                    best.add(mine, m)
            yield best.batch()

        out = corpus.mapInArrow(run, FOUND)
    elif least is not None:
        out = _pruned_nearest(corpus, asked, k, least, skip_self)
    else:
        tiles, parts = -(-n // QUERIES), max(1, -(-corpus.count() // CORPUS))

        def cell(left, right):
            import pyarrow as pa

            best = None
            for batch in left.sort_by("id").combine_chunks().to_batches():
                best = _Best(batch.column("id").to_numpy(), np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)).astype(np.float64), k, least, skip_self)
            for batch in right.combine_chunks().to_batches() if best else ():
                for mine, m in _pieces(batch):
                    best.add(mine, m)
            schema = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("cosine", pa.float64())])
            return pa.Table.from_batches([best.batch()] if best else [], schema)

        spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        deal = lambda seed, m: F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(m)).cast("int")
        q = asked.select("id", "embedding", deal(1, tiles).alias("tile")).withColumn("part", spread(parts))
        c = corpus.select("id", "embedding", deal(2, parts).alias("part")).withColumn("tile", spread(tiles))
        out = q.groupBy("tile", "part").cogroup(c.groupBy("tile", "part")).applyInArrow(lambda a, b: cell(a.select(["id", "embedding"]), b.select(["id", "embedding"])), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "neighbour_id"))
    return out.withColumn("rank", rank - 1).where(F.col("rank") < k)


def _pruned_nearest(corpus: DataFrame, asked: DataFrame, k: int, least: float, skip_self: bool, tile: int | None = None) -> DataFrame:
    """The k nearest of each query within each tile of the corpus that may hold one; queries go only to such tiles."""
    tile = tile or TILE
    form = lambda df: df.select("id", F.col("embedding").cast("array<double>").alias("v"), F.lit(True).alias("m")).where("v is not null")
    homes, guests = form(corpus), form(asked)
    cells = _Cells(homes, tile)
    if not cells.count.any():
        return corpus.sparkSession.createDataFrame([], FOUND)
    _split_guests(cells, guests, least, 4 * tile)

    def settle(batches):
        import pyarrow as pa

        for ids, v, _ in _marked(batches):
            at = _distances(v, cells.pivots)[0].argmin(axis=1)
            n = cells.chunks[at]
            r = np.repeat(np.arange(len(ids)), n)  # a copy in each chunk of the guests
            chunk = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            for i in range(0, len(r), PIECE):
                x, k = r[i : i + PIECE], chunk[i : i + PIECE]
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(v[x].ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(at[x]), pa.array(_dealt(ids[x], 1, cells.tiles[at[x]])), pa.array(k), pa.array(ids[x], pa.int64()), vectors], names=["cell", "tile", "chunk", "id", "v"])

    def cell(left, right):
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("neighbour_id", pa.int64()), ("cosine", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        stack = lambda t: np.stack(t.column("v").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
        mine, m, found = right.column("id").to_numpy(), stack(right), []
        for at in range(0, left.num_rows, PIECE):  # a few queries at a time
            part = left.slice(at, PIECE)
            best = _Best(part.column("id").to_numpy(), stack(part), k, least, skip_self)
            best.add(mine, m)
            found.append(best.batch())
        return pa.Table.from_batches(found, schema)

    settled = homes.mapInArrow(settle, "cell long, tile long, chunk long, id long, v array<double>")
    visiting = guests.mapInArrow(_visits(cells, least, True), DEALT).select("cell", "tile", "chunk", "id", "v")
    return visiting.groupBy("cell", "tile", "chunk").cogroup(settled.groupBy("cell", "tile", "chunk")).applyInArrow(cell, FOUND)


def best_per_video(hits: DataFrame) -> DataFrame:
    """The nearest segment of each video."""
    best = F.max_by(F.struct("segment_id", "start_ms", "end_ms", "cosine"), F.struct("cosine", -F.col("segment_id")))
    return hits.groupBy("video_id").agg(best.alias("b")).select("video_id", "b.*")


def centroids(rows: DataFrame, key: str) -> DataFrame:
    """Unit mean vector and size of each group: sums by position are combined before the shuffle."""
    sums = rows.select(key, F.posexplode("embedding").alias("pos", "x")).groupBy(key, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    packed = sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"), F.max("n").alias("n"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return packed.withColumn("len", F.when(length == 0, 1.0).otherwise(length)).select(key, "n", F.transform("v", lambda x: x / F.col("len")).alias("centroid"))


def moved(centroid, n, e):
    """Unit centroid after one more vector: normalise(c * n + e), n counted before."""
    from framelake.functions.vector import normalise

    return normalise(F.zip_with(centroid, e, lambda c, x: c.cast("double") * n + x.cast("double")))


class _Cells:
    """Vectors dealt to the nearest of a few pivots, and what triangle inequalities need to know about each cell.

    Pivots are chosen from a few rows in hash order, each farthest from those before it: one for about ``tile`` rows, PIVOTS
    at most. For each cell: rows, the largest distance from
    its pivot, the largest squared length, and whether a row is marked. These and the pivots are all that is broadcast.
    """

    def __init__(self, rows: DataFrame, tile: int):
        spark, n = rows.sparkSession, rows.count()
        want = max(1, min(PIVOTS, -(-n // tile)))
        some = rows.orderBy(F.xxhash64(F.lit(3), "id"), "id").limit(4 * want).select("v").collect()  # 4 * PIVOTS at most
        self.pivots = _apart(np.array([r.v for r in some] or [[0.0]], np.float64), want)
        self.count, self.radius, self.square, self.marked = (np.zeros(len(self.pivots), t) for t in (np.int64, float, float, bool))
        shared = spark.sparkContext.broadcast(self.pivots)

        def deal(batches):
            import pyarrow as pa

            for ids, v, m in _marked(batches):
                d, q = _distances(v, shared.value)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(d[np.arange(len(ids)), cell]), pa.array(q), pa.array(m)], names=["cell", "d", "q", "m"])

        found = rows.mapInArrow(deal, "cell long, d double, q double, m boolean").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d"), F.max("q").alias("q"), F.max("m").alias("m"))
        for r in found.collect():  # a row a pivot
            self.count[r.cell], self.radius[r.cell], self.square[r.cell], self.marked[r.cell] = r.n, r.d, r.q, r.m
        self.tiles, self.chunks = np.maximum(1, -(-self.count // tile)), np.ones(len(self.pivots), np.int64)

    def within(self, d: np.ndarray, q: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
        """Which cells may hold a vector whose product with each of these reaches ``least``: |x - y|^2 = |x|^2 + |y|^2 - 2 xy, and
        |x - y| is at least the distance to the pivot less the cell's radius."""
        reach = np.sqrt(np.maximum(0, q[:, None] + self.square[None, :] - 2 * least)) + 1e-6
        return (d <= self.radius[None, :] + reach) & (self.count > 0)[None, :] & (m[:, None] | self.marked[None, :])


def _apart(v: np.ndarray, n: int) -> np.ndarray:
    """At most n of the rows, each farthest from those taken before; copies are taken once."""
    taken, d = [0], np.linalg.norm(v - v[0], axis=1)
    while len(taken) < n and d.max() > 0:
        taken.append(int(d.argmax()))
        d = np.minimum(d, np.linalg.norm(v - v[taken[-1]], axis=1))
    return v[taken]


def _marked(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and marks of Arrow batches (id, v, m)."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            piece = batch.slice(at, PIECE)
            v = np.stack(piece.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
            yield piece.column(0).to_numpy(zero_copy_only=False), v, piece.column(2).to_numpy(zero_copy_only=False).astype(bool)


def _distances(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the pivots, and squared lengths."""
    q = np.einsum("ij,ij->i", v, v)
    return np.sqrt(np.maximum(0, q[:, None] + np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * v @ pivots.T)), q


def _dealt(ids: np.ndarray, seed: int, parts: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


DEALT = "cell long, tile long, chunk long, home boolean, id long, v array<double>, m boolean"


def _visits(cells: _Cells, least: float, guests_only: bool):
    """What deals rows to tiles: a row is at home in its cell's tile, in each chunk of its guests, and a guest of the tiles of all
    cells that may hold a partner; of two rows' tiles the later one's row is the guest."""

    def run(batches):
        import pyarrow as pa

        for ids, v, m in _marked(batches):
            d, q = _distances(v, cells.pivots)
            cell = d.argmin(axis=1)
            tile = _dealt(ids, 1, cells.tiles[cell])
            at, to = np.nonzero(cells.within(d, q, m, least) & (guests_only or np.arange(d.shape[1])[None, :] <= cell[:, None]))
            n = cells.tiles[to]
            row, to = np.repeat(at, n), np.repeat(to, n)
            part = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            if not guests_only:
                earlier = (to < cell[row]) | (part < tile[row])
                row, to, part = row[earlier], to[earlier], part[earlier]
            columns = [to, part, _dealt(ids[row], 2, cells.chunks[to]), np.zeros(len(row), bool), row]
            if not guests_only:
                n = cells.chunks[cell]
                own = np.repeat(np.arange(len(ids)), n)
                chunk = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
                columns = [np.concatenate(x) for x in zip(columns, (cell[own], tile[own], chunk, np.ones(len(own), bool), own))]
            for s in range(0, len(columns[0]), PIECE):
                c, t, k, home, r = (x[s : s + PIECE] for x in columns)
                vectors = pa.FixedSizeListArray.from_arrays(pa.array(v[r].ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(t), pa.array(k), pa.array(home), pa.array(ids[r], pa.int64()), vectors, pa.array(m[r])], names=["cell", "tile", "chunk", "home", "id", "v", "m"])

    return run


def _split_guests(cells: _Cells, guests: DataFrame, least: float, size: int) -> None:
    """Sets into how many chunks of about ``size`` the guests of each cell are split."""

    def counted(batches):
        import pyarrow as pa

        n = np.zeros(len(cells.count), np.int64)
        for _, v, m in _marked(batches):
            d, q = _distances(v, cells.pivots)
            n += cells.within(d, q, m, least).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["cell", "n"])

    for r in guests.mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a row a pivot
        cells.chunks[r.cell] = max(1, -(-r.n // size))


def dealt_pairs(rows: DataFrame, least: float, tile: int | None = None) -> DataFrame:
    """Rows (id, v, m) dealt to the tiles in which all pairs whose product reaches ``least`` meet (DEALT). A cell without a close
    one is never shuffled to; guests of a cell are split into chunks, so a task has a few tiles of rows."""
    tile = tile or TILE
    cells = _Cells(rows, tile)
    _split_guests(cells, rows, least, 4 * tile)
    return rows.mapInArrow(_visits(cells, least, False), DEALT)


def close_pairs(rows: DataFrame, key: str, least: float, changed: str | None = None, tile: int | None = None) -> DataFrame:
    """Pairs of groups (a < b) whose centroids have at least that cosine; with ``changed``, one of them at least is marked.

    Exact: rows meet in tiles around pivots, and pairs of cells that triangle inequalities keep apart, or of which neither
    has a marked row, don't meet. On vectors without clusters nothing is kept apart, and a row is copied once a tile, as in
    a grid.
    """
    mark = F.coalesce(F.col(changed), F.lit(False)) if changed else F.lit(True)
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col("centroid").cast("array<double>").alias("v"), mark.alias("m")).where("v is not null")

    def cell(key, table):
        import pyarrow as pa

        ids, m, home = table.column("id").to_numpy(), table.column("m").to_numpy(zero_copy_only=False).astype(bool), table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        pairs = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if home.any():
            v = np.stack(table.column("v").combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
            mine = np.flatnonzero(home)
            others = np.arange(len(ids)) if key[2].as_py() == 0 else np.flatnonzero(~home)  # rows at home meet in one chunk only
            cos = v[mine] @ v[others].T
            allowed = m[mine][:, None] | m[others][None, :]
            allowed &= ~home[others][None, :] | (ids[mine][:, None] < ids[others][None, :])
            x, y = np.nonzero(allowed & (cos >= least))
            a, b = ids[mine[x]], ids[others[y]]
            pairs = [np.minimum(a, b), np.maximum(a, b), cos[x, y]]
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64()), "similarity": pa.array(pairs[2], pa.float64())})

    return dealt_pairs(rows, least, tile).groupBy("cell", "tile", "chunk").applyInArrow(cell, "a long, b long, similarity double")
