"""Approximate nearest neighbours: inverted lists scanned by adaptive dimension sampling.

Vectors are scaled to unit length, so the nearest by distance are the nearest by cosine. Each belongs to
the list of its nearest centroid; a query probes the lists of its nearest centroids. Within a list, a
random rotation spreads distance evenly over the dimensions, which are read in blocks of columns: from the
partial distance over d' of d dimensions a hypothesis test decides whether a candidate can still come
below the threshold (the k-th distance so far), and abandons it if not. Survivors are measured exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Centroids are fitted to at most this many vectors, the first by hash of their id.
SAMPLE = 16_384
MAX_LISTS = 1024
#: Share of the lists that a query probes, and the least number of them.
PROBE_SHARE, PROBE_LEAST = 0.6, 16
#: Columns read at a time, and how many standard errors the test allows.
BLOCK, EPSILON = 16, 2.1
#: Vectors of a list, and queries, that meet in one task at most (on average).
CHUNK, QUERIES = 8192, 2048


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, so that the largest component is near 1 and squares stay finite."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1))[1][:, None])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(rows)
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    """A random orthogonal matrix, by Gram-Schmidt on Gaussian rows."""
    rows = np.random.default_rng(seed).normal(size=(dim, dim))
    for i in range(dim):
        for _ in range(2):
            rows[i] -= (rows[:i].T * (rows[:i] * rows[i]).sum(axis=1)).sum(axis=1)
        rows[i] /= math.sqrt((rows[i] ** 2).sum())
    return rows


def centroids_of(rows: np.ndarray, lists: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """k-means on unit vectors; an empty cluster keeps its centroid."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:lists]].copy()
    for _ in range(rounds):
        near = nearest(rows, centres, 1)[:, 0]
        counts = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, rows[:, k], minlength=len(centres)) for k in range(rows.shape[1])], axis=1)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray, k: int) -> np.ndarray:
    """The k nearest centres of each row, nearest first."""
    out = np.empty((len(rows), k), np.int64)
    half = (centres * centres).sum(axis=1) / 2
    for a in range(0, len(rows), 2048):
        far = half - rows[a : a + 2048] @ centres.T
        some = np.argpartition(far, k - 1, axis=1)[:, :k] if k < far.shape[1] else np.tile(np.arange(k), (len(far), 1))
        order = np.argsort(np.take_along_axis(far, some, 1), axis=1, kind="stable")
        out[a : a + 2048] = np.take_along_axis(some, order, 1)
    return out


def scan(columns: np.ndarray, query: np.ndarray, k: int, own: np.ndarray | None = None, block: int = BLOCK, epsilon: float = EPSILON) -> np.ndarray:
    """Candidates (columns: rotated dimensions x vectors) that no test rejects, as far as rows within the
    k-th least distance found: positions, in no order. Those marked in `own` take no part."""
    dim, n = columns.shape
    others = np.arange(n) if own is None else np.flatnonzero(~own)
    first, n = others[: max(64, 4 * k)], len(others)
    near = ((columns[:, first] - query[:, None]) ** 2).sum(axis=0)
    found, distance = [first], [near]
    for a in range(len(first), n, 2048):
        bound = np.partition(np.concatenate(distance), k - 1)[k - 1] if sum(map(len, distance)) >= k else np.inf
        alive = others[a : a + 2048]
        partial = np.zeros(len(alive))
        for d in range(0, dim, block):
            e = min(d + block, dim)
            partial += ((columns[d:e, alive] - query[d:e, None]) ** 2).sum(axis=0)
            ratio = 1.0 if e == dim else e / dim * (1 + epsilon / math.sqrt(e)) ** 2
            keep = partial <= bound * ratio + 1e-9
            alive, partial = alive[keep], partial[keep]
            if not len(alive):
                break
        found.append(alive)
        distance.append(partial)
    found, distance = np.concatenate(found), np.concatenate(distance)
    if len(found) <= k:
        return found
    return found[distance <= np.partition(distance, k - 1)[k - 1] + 1e-9]


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a finite non-zero vector."""
    e = F.col("embedding")
    ok = F.col("vec_id").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.float64)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries (vec_id, embedding; other columns are left out) -> query_id, rank (from 1), vec_id, score.

    score is the cosine of the original vectors in double precision, finite for the smallest and largest components; ties go to the smaller vec_id. A
    vec_id is one query (of several rows the least vector) and none of its rows is its own neighbour; as
    candidates, rows with one vec_id stand each for itself. Unusable vectors (null, empty, zero, not finite, without
    an id) take no part, nor do those of another dimension than the vectors' most frequent one; with no
    vectors the result is empty. Lists too long for one task are divided, as are their queries; a part answers
    for itself and the best of all parts stay."""
    spark = vectors.sparkSession
    base, asked = usable(vectors), usable(queries)
    sized = base.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim, n = (sized["d"], sized["count"]) if sized else (1, 0)
    base = base.where(F.size("embedding") == dim)
    asked = asked.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    lists = max(1, min(MAX_LISTS, math.isqrt(n) // 2))
    probes = min(lists, max(PROBE_LEAST, math.ceil(PROBE_SHARE * lists)))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [_matrix(b["embedding"]) for b in batches if len(b)]
        if rows:
            yield pd.DataFrame({"centre": list(centroids_of(unit(np.concatenate(rows)), lists))})

    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).coalesce(1)
    fitted = [r["centre"] for r in sample.mapInPandas(fit, "centre array<double>").collect()]  # MAX_LISTS rows at most
    centres = spark.sparkContext.broadcast(np.array(fitted))

    def place(count: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    near = nearest(unit(_matrix(b["embedding"])), centres.value, min(count, len(centres.value)))
                    yield b.assign(list=list(near.astype(np.int32)))

        return run

    to = f"vec_id long, embedding {base.schema['embedding'].dataType.simpleString()}, list array<int>"
    home = materialize(base.mapInPandas(place(1), to).withColumn("list", F.col("list")[0]), "homes")
    probe = materialize(asked.mapInPandas(place(probes), to), "probes").withColumn("list", F.explode("list"))
    # Two numbers for each of at most MAX_LISTS lists.
    sizes = {r["list"]: r["count"] for r in home.groupBy("list").count().collect()}
    asks = {r["list"]: r["count"] for r in probe.groupBy("list").count().collect()}
    rows = [(i, -(-c // CHUNK), max(1, -(-asks.get(i, 0) // QUERIES))) for i, c in sizes.items()]
    parts = spark.createDataFrame(rows, "list int, chunks int, blocks int")
    chunk = F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = home.join(F.broadcast(parts), "list").select("list", chunk.alias("chunk"), upto("blocks").alias("block"), "vec_id", "embedding")
    right = probe.join(F.broadcast(parts), "list").select("list", upto("chunks").alias("chunk"), block.alias("block"), "vec_id", "embedding")

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            rows = rows.sort_values("vec_id")
            ids, own = rows["vec_id"].to_numpy(), scaled(_matrix(rows["embedding"]))
            length = np.sqrt((own * own).sum(axis=1))
            turn = rotation(own.shape[1])
            columns = np.ascontiguousarray((unit(own) @ turn.T).T)
            queries = scaled(_matrix(asked["embedding"]))
            turned = unit(queries) @ turn.T
            for q, vector, seen in zip(asked["vec_id"], queries, turned):
                at = scan(columns, seen, k, ids == q)
                score = (own[at] * vector).sum(axis=1) / (length[at] * math.sqrt((vector * vector).sum()))
                best = np.lexsort((ids[at], -score))[:k]
                out.append(pd.DataFrame({"query_id": q, "vec_id": ids[at][best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    by = ["list", "chunk", "block"]
    found = left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_ann_search(spark, sf_dir: str) -> DataFrame:
    from .common import ship, table

    ship(spark)
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))
