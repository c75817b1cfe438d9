"""Vector search by tiles: exact search, an inverted file with stored cells, and a neighbour graph of shards.

Vectors travel in tiles, rows that hold the ids and numbers of up to ``TILE`` vectors; Spark pairs tiles, and a task
compares two tiles as one product of matrices and keeps each query's best. So no vector crosses a shuffle alone and no
task needs more than two tiles.

In every search a vector takes part if it is not null and its components are neither null, NaN nor infinite; queries
meet vectors of their own length only. Ties go to the smaller id. Repeated ids are vectors of their own, but for the
graph, which keeps one of each id. Ids are integers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE, QUERY_TILE = 2048, 256
#: Vectors that a task gathers before it hands on what it has, tile or not.
HELD = 16_384


def usable(v: str) -> Column:
    x = F.col(v).cast("array<double>")
    return x.isNotNull() & F.forall(x, lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))


def _tiles(df: DataFrame, size: int, metric: str = "ip") -> DataFrame:
    """cell, dims, ids, data of rows (id, v, cell): tiles of one cell and length each; unit vectors for cosine."""

    def run(batches):
        import pyarrow as pa

        held: dict[tuple[int, int], list] = {}
        count = 0

        def told(keys):
            rows = [(c, d, ids, data) for c, d in keys for ids, data in [held.pop((c, d))]]
            for cell, dims, ids, data in rows:
                x = np.array(data, np.float64).reshape(len(ids), dims)
                if metric == "cosine":
                    x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
                yield pa.record_batch({"cell": pa.array([cell], pa.int32()), "dims": pa.array([dims], pa.int32()), "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), "data": pa.array([x.tobytes()], pa.binary())})

        for b in batches:
            for i, v, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                ids, data = held.setdefault((c, len(v)), ([], []))
                ids.append(i)
                data.extend(v)
                count += 1
                if len(ids) >= size:
                    count -= len(ids)
                    yield from told([(c, len(v))])
                elif count >= HELD:
                    count = 0
                    yield from told(list(held))
        yield from told(list(held))

    rows = df.select(F.col("id").cast("long"), F.col("v").cast("array<double>"), F.col("cell").cast("int"))
    return rows.mapInArrow(run, "cell int, dims int, ids binary, data binary")


def _best(pairs: DataFrame, k: int, metric: str, others: bool) -> DataFrame:
    """q, id, score of each query's ``k`` best vectors of a pair of tiles (qids, qdata, ids, data, dims)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for qids, qdata, ids, data, dims in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                q, v = np.frombuffer(qids, "<i8"), np.frombuffer(ids, "<i8")
                x, y = np.frombuffer(qdata).reshape(len(q), dims), np.frombuffer(data).reshape(len(v), dims)
                s = np.stack([-((y - row) ** 2).sum(1) for row in x]) if metric == "l2" else x @ y.T
                s = np.round(s, 9)
                if others:
                    s[q[:, None] == v[None, :]] = -np.inf
                n = min(k, len(v))
                least = np.partition(s, len(v) - n, axis=1)[:, len(v) - n]
                a, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                order = np.lexsort((v[c], -s[a, c], a))
                a, c = a[order], c[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, c = a[place < k], c[place < k]
                yield pa.record_batch({"q": pa.array(q[a]), "id": pa.array(v[c]), "score": pa.array(s[a, c])})

    return pairs.select("qids", "qdata", "ids", "data", "dims").mapInArrow(run, "q long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.asc("id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _asked(queries: DataFrame, metric: str) -> DataFrame:
    """Tiles of queries (q, qv, cell)."""
    t = _tiles(queries.select(F.col("q").alias("id"), F.col("qv").alias("v"), "cell"), QUERY_TILE, metric)
    return t.select("cell", "dims", F.col("ids").alias("qids"), F.col("data").alias("qdata"))


def dense(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", others: bool = False) -> DataFrame:
    """q, id, score, rank of the k most similar vectors, by ``ip``, ``cosine`` or ``l2`` (negative squared distance);
    queries (q, qv), vectors (id, v). With ``others``, a query's own id is no result. A zero vector has cosine 0.

    A stated query set meets all vectors in blocks: every tile of vectors meets every tile of queries.
    """
    v = _tiles(vectors.filter(usable("v")).select("id", "v", F.lit(0).alias("cell")), TILE, metric).drop("cell")
    q = _asked(queries.filter(usable("qv")).select("q", "qv", F.lit(0).alias("cell")), metric).drop("cell").withColumnRenamed("dims", "qdims")
    # Not an equality: tiles of one length would all be one key, and one task.
    alike = (F.col("dims") <= F.col("qdims")) & (F.col("dims") >= F.col("qdims"))
    return _ranked(_best(v.join(q, alike).drop("qdims"), k, metric, others), k)


# --- inverted file


def fit_cells(vectors: DataFrame, n: int = 100, sample: int = 10_000, rounds: int = 10) -> DataFrame:
    """cell, centroid: ``n`` means (Lloyd's rounds from distinct vectors) of at most ``sample`` vectors (id, v), the
    first in the order of their id's hash; of the most frequent length among them. Only these reach the driver; cells
    that end empty keep their last mean."""
    rows = vectors.filter(usable("v")).orderBy(F.xxhash64("id"), "id").limit(sample).select(F.col("v").cast("array<double>").alias("v")).collect()
    schema = "cell int, centroid array<double>"
    if not rows:
        return vectors.sparkSession.createDataFrame([], schema)
    lengths = [len(r.v) for r in rows]
    dims = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([r.v for r in rows if len(r.v) == dims], dtype=np.float64).reshape(-1, dims)
    c = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:n]]
    for _ in range(rounds):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        size = np.bincount(at, minlength=len(c))
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return vectors.sparkSession.createDataFrame([(i, v) for i, v in enumerate(c.tolist())], schema)


def _placed(df: DataFrame, key: str, v: str, means: np.ndarray, n: int) -> DataFrame:
    """key, v, cell: each vector with its ``n`` nearest means, a row each. Vectors of another length than the means go
    to the cell -1, as whole searches."""
    held = df.sparkSession.sparkContext.broadcast(means)  # cells times dimensions: parameters of the index

    def run(batches):
        import pyarrow as pa

        c = held.value
        for b in batches:
            lists = b.column(1).to_pylist()
            fits = [i for i, x in enumerate(lists) if len(x) == c.shape[1]] if len(c) else []
            rows, cells = [i for i in range(len(lists)) if i not in set(fits)], []
            cells = [-1] * len(rows)
            if fits:
                x = np.array([lists[i] for i in fits], np.float64)
                d = (c * c).sum(1) - 2 * x @ c.T
                near = np.argsort(d, axis=1, kind="stable")[:, :n]
                rows += np.repeat(fits, near.shape[1]).tolist()
                cells += near.ravel().tolist()
            at = pa.array(rows, pa.int64())
            yield pa.record_batch([b.column(0).take(at), b.column(1).take(at), pa.array(cells, pa.int32())], names=["id", "v", "cell"])

    given = df.select(F.col(key).cast("long").alias("id"), F.col(v).cast("array<double>").alias("v"))
    return given.mapInArrow(run, "id long, v array<double>, cell int")


def _means(cells: DataFrame) -> np.ndarray:
    rows = cells.orderBy("cell").collect()
    return np.array([r.centroid for r in rows], np.float64).reshape(len(rows), -1 if rows else 0)


def build_vectors(vectors: DataFrame, path: str, cells: int = 100) -> None:
    """Write an inverted file of vectors (id, v): their tiles by cell, the nearest of ``cells`` fitted means, and the
    means. A cell of any size lies over many tiles, and a search reads only the cells it asks for."""
    fit_cells(vectors, cells).write.parquet(f"{path}/cells")
    means = _means(vectors.sparkSession.read.parquet(f"{path}/cells"))
    dealt = _placed(vectors.filter(usable("v")), "id", "v", means, 1).hint("rebalance", "cell").sortWithinPartitions("cell")
    _tiles(dealt, TILE).write.partitionBy("cell").parquet(f"{path}/vectors")


def probe_vectors(spark: SparkSession, path: str, queries: DataFrame, probes: int, k: int, others: bool = False) -> DataFrame:
    """q, id, score, rank of a search of an inverted file: each query (q, qv) meets the vectors of its ``probes`` nearest
    cells, by inner product. Queries of another length than the cells' meet all vectors of theirs."""
    means = _means(spark.read.parquet(f"{path}/cells"))
    asked = _placed(queries.filter(usable("qv")), "q", "qv", means, probes).select(F.col("id").alias("q"), F.col("v").alias("qv"), "cell")
    # Queries of a cell lie together, or their tiles would hold one each.
    q = _asked(asked.hint("rebalance", "cell").sortWithinPartitions("cell"), "ip")
    v = spark.read.schema("dims int, ids binary, data binary, cell int").parquet(f"{path}/vectors")
    return _ranked(_best(v.join(q, ["cell", "dims"]), k, "ip", others), k)


# --- neighbour graph


#: Vectors of a shard of the graph, and queries that a task takes to a shard at once.
SHARD, ASKED = 1 << 13, 4096
#: Of so many vectors one may be the end of long links, which lead from cluster to cluster.
THIN = 8


@dataclass(frozen=True)
class Graph:
    """Parameters of a neighbour graph: nearest neighbours of a vector, links it may have with the reverse ones, and
    vectors that are compared with their whole shard at once. Neighbours in a shard are exact, so ``rounds`` of
    refinement are not needed; the field stays for callers that give it."""

    near: int = 24
    rounds: int = 4
    most: int = 48
    seeds: int = 256


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def _matrix(column, n: int) -> np.ndarray:
    """The lists of one length of an Arrow column as rows."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _neighbours(x: np.ndarray, near: int, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``near`` most similar other rows of each row of unit vectors, and their similarity."""
    n = min(near, len(x) - 1)
    if n < 1:
        return np.zeros((len(x), 0), np.int32), np.zeros((len(x), 0))
    low = x.astype(np.float32)
    to, sims = np.empty((len(x), n), np.int32), np.empty((len(x), n))
    for i in range(0, len(x), seeds):
        s = low[i : i + seeds] @ low.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        to[i : i + seeds] = np.argpartition(s, len(x) - n, axis=1)[:, len(x) - n :]
        sims[i : i + seeds] = np.einsum("ij,ikj->ik", x[i : i + seeds], x[to[i : i + seeds]])
    return to, np.round(sims, 9)


def _hashed(ids: np.ndarray) -> np.ndarray:
    """The places of ids in the order of a hash."""
    with np.errstate(over="ignore"):
        return np.argsort(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), kind="stable")


def _long(x: np.ndarray, to: np.ndarray, ends: np.ndarray, far: int, seeds: int) -> tuple[np.ndarray, np.ndarray]:
    """a, b of ``far`` links of each row to the most similar of ``ends`` that are not its neighbours."""
    n, at = min(far, len(ends)), np.full(len(x), -1)
    at[ends] = np.arange(len(ends))
    low, out = x.astype(np.float32), []
    for i in range(0, len(x), seeds):
        s = low[i : i + seeds] @ low[ends].T
        own = np.concatenate([to[i : i + len(s)], np.arange(i, i + len(s))[:, None]], axis=1)
        row, column = np.repeat(np.arange(len(s)), own.shape[1]), at[own].ravel()
        s[row[column >= 0], column[column >= 0]] = -np.inf
        best = np.argpartition(s, len(ends) - n, axis=1)[:, len(ends) - n :]
        a, b = np.repeat(np.arange(len(s)), n), best.ravel()
        out.append((a[s[a, b] > -np.inf] + i, ends[b[s[a, b] > -np.inf]]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _linked(x: np.ndarray, to: np.ndarray, sims: np.ndarray, far: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """a, b, s in the order of a: of links and reverse links the ``most`` best of each row, then the long ones."""
    size = max(1, len(to))
    a, b, s = np.repeat(np.arange(len(to)), to.shape[1]), to.ravel().astype(np.int64), sims.ravel()
    pair, first = np.unique(np.concatenate([a, b]) * size + np.concatenate([b, a]), return_index=True)
    a, b, s = pair // size, pair % size, np.concatenate([s, s])[first]
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    keep = np.arange(len(a)) - np.searchsorted(a, a) < most
    pair, first = np.unique(np.concatenate([a[keep], far[0]]) * size + np.concatenate([b[keep], far[1]]), return_index=True)
    a, b = pair // size, pair % size
    return a, b, np.round(np.concatenate([np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]), 9)


def build_graph(vectors: DataFrame, path: str, p: Graph = Graph()) -> None:
    """Write a neighbour graph of vectors (id, v) under ``path``: ``nodes`` (id, v: unit vectors), ``links`` (a, b, s)
    and ``shards``, the same packed for searches.

    Vectors are dealt to shards of about ``SHARD`` by the hash of their id. A shard is a graph of its own, built in one
    task: the ``near`` most similar others of each vector, found by products of matrices, and their reverse links, of
    both the best; a fifth of ``most`` are long links to the most similar ones of every ``THIN``th vector, without which
    clusters would not hang together. So work and memory of a shard are bounded, and the build grows with the number of vectors.
    Similarity is the cosine. Vectors of a length other than the most frequent one take no part; of equal ids the
    first by components stays.
    """
    spark = vectors.sparkSession
    rows = vectors.filter(usable("v")).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).groupBy("id").agg(F.min("v").alias("v"))
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)  # one row
    rows = rows.join(F.broadcast(lengths.select("n")), F.size("v") == F.col("n"), "left_semi")

    def unit(batches):
        import pyarrow as pa

        for b in batches:
            if b.num_rows:
                yield pa.record_batch([b.column(0), pa.array(list(_unit_rows(_matrix(b.column(1), b.num_rows))), pa.list_(pa.float64()))], names=["id", "v"])

    rows.mapInArrow(unit, "id long, v array<double>").write.parquet(f"{path}/nodes")
    nodes = spark.read.schema("id long, v array<double>").parquet(f"{path}/nodes")
    shards = max(1, -(-nodes.count() // SHARD))

    def pack(t):
        import pyarrow as pa

        ids = t["id"].to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(t["v"], len(ids))[order]
        far, (to, sims) = p.most // 5, _neighbours(x, p.near, p.seeds)
        a, b, s = _linked(x, to, sims, _long(x, to, np.sort(_hashed(ids)[::THIN]), far, p.seeds), p.most - far)
        ends = np.searchsorted(a, np.arange(len(ids) + 1))
        blobs = (ids.astype("<i8"), x, ends.astype("<i8"), b.astype("<i4"), s)
        return pa.table({"shard": t["shard"][:1].cast(pa.int32()), **{c: pa.array([y.tobytes()], pa.binary()) for c, y in zip(("ids", "data", "ends", "b", "s"), blobs, strict=True)}})

    dealt = nodes.select(F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "v")
    # A file a shard: a reader holds one at once.
    dealt.groupBy("shard").applyInArrow(pack, _SHARD).write.option("maxRecordsPerFile", 1).parquet(f"{path}/shards")

    def told(batches):
        import pyarrow as pa

        for batch in batches:
            for ids, ends, b, s in zip(*batch.columns, strict=True):
                ids, ends, b, s = (np.frombuffer(c.as_py(), k) for c, k in ((ids, "<i8"), (ends, "<i8"), (b, "<i4"), (s, "<f8")))
                a = np.repeat(ids, np.diff(ends))
                for i in range(0, len(a), 1 << 16):
                    yield pa.record_batch({"a": pa.array(a[i : i + (1 << 16)]), "b": pa.array(ids[b[i : i + (1 << 16)]]), "s": pa.array(s[i : i + (1 << 16)])})

    spark.read.schema(_SHARD).parquet(f"{path}/shards").select("ids", "ends", "b", "s").mapInArrow(told, "a long, b long, s double").write.parquet(f"{path}/links")


_SHARD = "shard int, ids binary, data binary, ends binary, b binary, s binary"


def _walk(x: np.ndarray, links: np.ndarray, entries: np.ndarray, q: np.ndarray, own: int, beam: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard that a query meets, and their scores. Rows are in the order of their ids; ``links`` has a row for
    each, filled up with the row itself."""
    seen, done = np.zeros(len(x), bool), np.zeros(len(x), bool)
    if own >= 0:
        seen[own] = True
    fresh = entries[~seen[entries]]
    met, scores = [], []
    best, best_s = np.zeros(0, np.int64), np.zeros(0)
    while True:
        seen[fresh] = True
        s = np.round(x[fresh] @ q, 9)
        met.append(fresh)
        scores.append(s)
        # What leaves the beam does not come back.
        best, best_s = np.concatenate([best, fresh]), np.concatenate([best_s, s])
        order = np.lexsort((best, -best_s))[:beam]
        best, best_s = best[order], best_s[order]
        now = best[~done[best]][:step]
        if not len(now):
            return np.concatenate(met), np.concatenate(scores)
        done[now] = True
        fresh = links[now].ravel()
        fresh = np.unique(fresh[~seen[fresh]]).astype(np.int64)


def _padded(ends: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.diff(ends)
    out = np.repeat(np.arange(len(n), dtype=np.int32)[:, None], max(1, int(n.max(initial=0))), axis=1)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(b)) - np.repeat(ends[:-1], n)] = b
    return out


def search_graph(spark: SparkSession, path: str, queries: DataFrame, k: int, scratch: str, beam: int = 64, step: int = 16, others: bool = False) -> tuple[DataFrame, DataFrame]:
    """Search a stored graph; returns (q, id, score, rank) by cosine, and the met pairs (q, id, score), which are found
    anew when asked for.

    Every query (q, qv) searches every shard and keeps the best of each. It begins at the same entries of a shard, as
    many as the root of its vectors. Each round follows the links of its ``step`` best vectors among its ``beam`` best
    that were not followed yet, and meets what is new to it; it is done when its beam is all followed. Queries travel
    in tiles, written under ``scratch``; a shard goes to a task whole. Queries of another length than the graph's
    vectors find nothing.
    """
    nodes = spark.read.schema("id long, v array<double>").parquet(f"{path}/nodes")
    dims = F.broadcast(nodes.select(F.size("v").alias("_n")).limit(1))
    asked = queries.filter(usable("qv")).select(F.col("q").cast("long").alias("q"), F.col("qv").cast("array<double>").alias("qv")).join(dims, F.size("qv") == F.col("_n"), "left_semi")
    n = asked.count()
    parts = max(-(-n // ASKED), min(spark.sparkContext.defaultParallelism, -(-n // 64)), 1)
    tiles = _tiles(asked.repartition(parts).select(F.col("q").alias("id"), F.col("qv").alias("v"), F.lit(0).alias("cell")), ASKED, "cosine")
    tiles.select(F.col("ids").alias("qids"), F.col("data").alias("qdata")).write.parquet(f"{scratch}/queries")
    tiles = spark.read.schema("qids binary, qdata binary").parquet(f"{scratch}/queries")
    pairs = spark.read.schema(_SHARD).parquet(f"{path}/shards").drop("shard", "s").crossJoin(tiles)

    def search(most: int | None):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for ids, data, ends, b, qids, qdata in zip(*batch.columns, strict=True):
                    ids, x, ends, b, qids = (np.frombuffer(c.as_buffer(), t) for c, t in ((ids, "<i8"), (data, "<f8"), (ends, "<i8"), (b, "<i4"), (qids, "<i8")))
                    x, y = x.reshape(len(ids), -1), np.frombuffer(qdata.as_buffer()).reshape(len(qids), -1)
                    entries, links = _hashed(ids)[: int(max(1, len(ids) ** 0.5))], _padded(ends, b)
                    for q, v in zip(qids.tolist(), y, strict=True):
                        at = int(np.searchsorted(ids, q))
                        own = at if others and at < len(ids) and ids[at] == q else -1
                        met, s = _walk(x, links, entries, v, own, beam, step)
                        order = np.lexsort((met, -s))[:most]
                        yield pa.record_batch({"q": pa.array(np.full(len(order), q)), "id": pa.array(ids[met[order]]), "score": pa.array(s[order])})

        return run

    schema = "q long, id long, score double"
    return _ranked(pairs.mapInArrow(search(k), schema), k), pairs.mapInArrow(search(None), schema)
