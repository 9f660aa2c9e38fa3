"""Nearest neighbours by largest inner product over balanced posting lists.

1. Vectors that are equal are one row with the k + 1 smallest ids that share them (no other copy can be among k answers).
   Inner products become distances by one more component: (v, sqrt(M^2 - |v|^2)) with M the largest norm, so that the
   nearest to (q, 0) is the largest product.
2. Centroids are fitted on a sample of at most SAMPLE vectors (by hash of the id), about one for LIST vectors of the
   sample's share.  A graph over the centroids, held in memory, finds centroids near a vector by best-first search.
3. Every vector goes to its nearest cluster, and a boundary vector (whose next centroids are nearly as near) to several.
   Neighbouring lists lie together in parts of about 1 / PARTS of all vectors, and of PART at most (a longer list is
   split into chunks).
4. A query probes every list whose centroid is within RATIO of its nearest centroid's distance, however many these are,
   and as many more, nearest first, as hold ENOUGH vectors (a query on top of a centroid has no others within any ratio).
   All centroids are ranked.  Without clusters most lists are within RATIO, and most vectors are read.  Queries meet the
   parts of their lists; each task multiplies the queries of a part with all its vectors, and only the best k of each
   part go on to be merged.

Scores are inner products of the original components in double precision.  Cases: a vector that is null, empty or zero,
or holds null or non-finite components takes no part, as query or candidate; vectors of another length than the most
frequent one take no part either; ties go to the smaller id; rows that repeat an id are one; fewer candidates than k are
all returned; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, n_partitions

SAMPLE = 40_000
LIST = 64
PARTS = 64
PART = 32_768
COPIES = 4
BOUNDARY = 1.15
RATIO = 1.6
DEGREE = 24
#: Lists are probed, near or not, until they hold so many times the answers wanted.
ENOUGH = 16
BEAM = 160


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1), 0)


def balanced_centroids(x: np.ndarray, k: int, steps: int = 8, seed: int = 7) -> np.ndarray:
    """k-means whose assignment charges full clusters, so that their sizes stay near the mean."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].astype(np.float64)
    load = np.ones(k)
    for _ in range(steps):
        own = np.empty(len(x), np.int64)
        charge = 0.0
        for a in range(0, len(x), 4096):
            d = _distances(x[a : a + 4096], c)
            charge = d.min(axis=1).mean() * 0.1
            own[a : a + 4096] = (d + charge * (load - 1)).argmin(axis=1)
        n = np.bincount(own, minlength=k)
        load = n * k / len(x)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)])
    return c


class CentroidGraph:
    """Each centroid is linked to its nearest others and to a few far ones; search is best first with a beam."""

    def __init__(self, c: np.ndarray, degree: int = DEGREE, seed: int = 7):
        self.c = np.asarray(c, np.float64)
        n = len(c)
        rng = np.random.default_rng(seed)
        near = np.empty((n, min(degree, max(n - 1, 0))), np.int64)
        for a in range(0, n, 1024):
            d = _distances(self.c[a : a + 1024], self.c)
            d[np.arange(len(d)), np.arange(a, a + len(d))] = np.inf
            near[a : a + 1024] = np.argsort(d, axis=1)[:, : near.shape[1]]
        self.links = [np.unique(np.concatenate([near[i], rng.integers(0, n, min(4, n))])) for i in range(n)]
        back: list[list[int]] = [[] for _ in range(n)]
        for i, js in enumerate(near):
            for j in js[: degree // 2]:
                back[j].append(i)
        self.links = [np.unique(np.concatenate([a, np.array(b, np.int64)])) for a, b in zip(self.links, back, strict=True)]
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def search(self, q: np.ndarray, want: int, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Centroids near q, nearest first, and their squared distances."""
        beam = max(beam, want)
        seen = np.zeros(len(self.c), bool)
        ids = self.entries
        seen[ids] = True
        dist = ((self.c[ids] - q) ** 2).sum(axis=1)
        done: set[int] = set()
        while True:
            order = np.argsort(dist, kind="stable")[:beam]
            ids, dist = ids[order], dist[order]
            todo = [int(i) for i in ids if int(i) not in done][:4]
            if not todo:
                return ids[:want], dist[:want]
            done.update(todo)
            new = np.unique(np.concatenate([self.links[i] for i in todo]))
            new = new[~seen[new]]
            seen[new] = True
            ids = np.concatenate([ids, new])
            dist = np.concatenate([dist, ((self.c[new] - q) ** 2).sum(axis=1)])


def parts_of(c: np.ndarray, held: np.ndarray, most: float) -> np.ndarray:
    """The part of each list: halves along the component that varies most, until a part is one list or holds at most so many vectors."""
    part, todo, n = np.zeros(len(c), np.int64), [np.arange(len(c))], 0
    while todo:
        at = todo.pop()
        if len(at) == 1 or held[at].sum() <= most:
            part[at] = n
            n += 1
            continue
        at = at[np.argsort(c[at, c[at].var(axis=0).argmax()], kind="stable")]
        todo += [at[: len(at) // 2], at[len(at) // 2 :]]
    return part


def probed(q: np.ndarray, c: np.ndarray, held: np.ndarray, enough: int) -> np.ndarray:
    """Which lists (columns) each query (row) probes: all within RATIO, and the nearest until they hold enough vectors."""
    d = _distances(q, c)
    order = np.argsort(d, axis=1, kind="stable")
    d = np.take_along_axis(d, order, axis=1)
    before = np.cumsum(held[order], axis=1) - held[order]
    out = np.zeros(d.shape, bool)
    np.put_along_axis(out, order, (d <= RATIO**2 * d[:, :1]) | (before < enough), axis=1)
    return out


def usable(v: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    x = v.cast("array<double>")
    fine = F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(x) > 0) & fine & F.exists(x, lambda e: e != 0), F.lit(False))


def _matrix(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which is_query (an expression over vec_id) holds."""
    spark = vectors.sparkSession
    rows = vectors.filter(F.col(id_col).isNotNull() & usable(F.col(vec))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("key", F.xxhash64("v"))
    rows = materialise(rows, "vectors")
    stats = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)).alias("m2")).orderBy(F.desc("n"), "d").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if stats is None:
        return spark.createDataFrame([], schema)
    dim, top = stats["d"], stats["m2"]
    rows = rows.filter(F.size("v") == dim)
    # One row for each distinct vector, with its k + 1 smallest ids.  Ids are cut down before they are gathered.
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    least = F.row_number().over(Window.partitionBy("v", "salt").orderBy("vec_id"))
    few = rows.withColumn("salt", salt).withColumn("r", least).filter(F.col("r") <= k + 1)
    base = materialise(few.groupBy("v").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, k + 1).alias("ids"), F.count("*").alias("n")).withColumn("key", F.xxhash64("v")), "distinct")
    total = base.count()
    keep = min(1.0, 0.95 * SAMPLE / max(total, 1))
    picked = base if total <= SAMPLE else base.filter(F.pmod(F.xxhash64(F.col("key")), F.lit(1 << 30)) < int(keep * (1 << 30))).limit(SAMPLE)
    x = _lift(np.array([r["v"] for r in picked.select("v").collect()], np.float64), top)  # at most SAMPLE rows
    graph = CentroidGraph(balanced_centroids(x, max(1, min(len(x), total // LIST, SAMPLE // 8))))
    shared = spark.sparkContext.broadcast(graph)  # at most SAMPLE / 8 centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            at, row = [], []
            for i, v in enumerate(_lift(_matrix(b.column("v")), top)):
                ids, d = g.search(v, COPIES, 32)
                at.append(ids[d <= BOUNDARY**2 * d[0] + 1e-12])
                row.append(np.full(len(at[-1]), i))
            if at:
                x = b.take(pa.array(np.concatenate(row)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(at)), *(x.column(c) for c in ("v", "ids", "key"))], names=["list", "v", "ids", "key"])

    lists = materialise(base.mapInArrow(assign, "list long, v array<double>, ids array<long>, key long"), "lists")
    held = np.zeros(len(graph.c), np.int64)  # vectors in each list
    for r in lists.groupBy("list").count().collect():  # one row for each centroid
        held[r["list"]] = r["count"]
    part = parts_of(graph.c, held, min(held.sum() / PARTS, PART))
    chunks = np.maximum(-(-np.bincount(part, weights=held).astype(np.int64) // PART), 1)
    sizes = spark.createDataFrame([(i, int(p), int(chunks[p])) for i, p in enumerate(part)], "list long, part long, chunks int")  # one row for each centroid
    chunked = lists.join(sizes, "list").select("part", F.pmod("key", "chunks").cast("int").alias("chunk"), F.lit(None).cast("long").alias("query"), "v", "ids")

    # Queries that are equal are searched once, for k + 1 answers, since one of them may be the query itself.
    asked = rows.filter(is_query).groupBy("v").agg(F.min("vec_id").alias("query"))
    asked = materialise(asked, "queries").repartition(n_partitions(spark))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.c
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                v = _matrix(b.column("v"))
                # The lifted query is scaled to the norm M: directions decide the order, and distances compare.
                q = np.concatenate([v * np.sqrt(top / (v * v).sum(axis=1))[:, None], np.zeros((len(v), 1))], axis=1)
                row, lst = np.nonzero(probed(q, c, held, ENOUGH * (k + 1)))
                row, p = np.unique(np.stack([row, part[lst]]), axis=1)
                x = b.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(chunks[p].astype(np.int32)), x.column("query"), x.column("v")], names=["part", "chunks", "query", "v"])

    probes = asked.mapInArrow(probe, "part long, chunks int, query long, v array<double>")
    probes = probes.select("part", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "query", "v", F.lit(None).cast("array<long>").alias("ids"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        own: set[int] = set()  # least ids of held: a vector can be in several lists of a part
        key = None

        def flush(qs: list[tuple]) -> pa.RecordBatch:
            s = np.array([v for _, v in qs]) @ np.array([v for v, _ in held]).T
            cut = min(k + 1, s.shape[1])
            out = []
            for (q, v), row in zip(qs, s, strict=True):
                edge = np.partition(row, len(row) - cut)[len(row) - cut]
                near = np.flatnonzero(row >= edge - 1e-9 * max(abs(edge), 1.0))
                hits = [(i, near[j]) for j in range(len(near)) for i in held[near[j]][1]]
                found = sorted(((-round(float(row[j]), 15), i, j) for i, j in hits))[: 2 * (k + 1)]
                out += [(q, i, held[j][0], v) for _, i, j in found]
            return _scored(out)

        waiting: list[tuple] = []
        for b in batches:
            vs = _matrix(b.column("v"))
            for j, (p, chunk, query, ids) in enumerate(zip(*(b.column(c).to_pylist() for c in ("part", "chunk", "query", "ids")), strict=True)):
                if (p, chunk) != key:
                    if waiting and held:
                        yield flush(waiting)
                    held, own, waiting, key = [], set(), [], (p, chunk)
                if query is None:
                    if ids[0] not in own:
                        own.add(ids[0])
                        held.append((vs[j], ids))
                else:
                    waiting.append((query, vs[j]))
                    if len(waiting) >= 256 and held:
                        yield flush(waiting)
                        waiting = []
        if waiting and held:
            yield flush(waiting)

    met = chunked.unionByName(probes).repartition(n_partitions(spark), "part", "chunk").sortWithinPartitions("part", "chunk", F.col("query").asc_nulls_first())
    found = met.mapInArrow(multiply, "query long, vec_id long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    answers = found.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))  # k + 1 rows each
    every = rows.filter(is_query).select("vec_id", "v").join(asked, "v").select(F.col("vec_id").alias("query_id"), "query").join(answers, "query")
    others = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    x = every.select("query_id", F.posexplode(others).alias("pos", "e"))
    return x.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    if not x.size:
        return x.reshape(0, 1)
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _scored(rows: list[tuple]) -> pa.RecordBatch:
    """Scores summed component by component in order, so that equal vectors have equal scores wherever they are met."""
    if not rows:
        return pa.RecordBatch.from_pydict({"query": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    a, b = np.array([r[3] for r in rows]), np.array([r[2] for r in rows])
    score = np.cumsum(a * b, axis=1)[:, -1]
    return pa.RecordBatch.from_pydict({"query": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": score})
