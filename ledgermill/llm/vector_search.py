"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is halved again and again along its main direction until the parts are small; the mean of each part is the
centroid of a posting list, so lists are balanced. Every vector goes to its nearest list, and near a boundary also to other
lists whose centroids are almost as near. A graph of centroids is held in memory and searched best first, for rows and
queries alike. A query reads the lists whose centroids are within a ratio of the nearest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ledgermill.session import materialise

#: Bound of the sample that the centroids are fitted on, in rows, and sample rows per list.
SAMPLE_ROWS, PART_ROWS = 20_000, 64
#: Most lists a row is copied to, and the ratio of distances within which it is.
COPIES, COPY_RATIO = 4, 1.1
#: Lists searched by a query: at most so many, within this ratio of the nearest distance.
PROBES, PROBE_RATIO = 48, 1.45
NEIGHBOURS = 24
#: Rows and queries of a block; larger lists are cut into blocks of this size.
BLOCK_ROWS = 20_000


@dataclass
class Centroids:
    """Unit centroids and, for each, the numbers of its nearest other ones."""
    points: np.ndarray
    links: np.ndarray


def fit(sample: np.ndarray, part_rows: int = PART_ROWS, degree: int = NEIGHBOURS) -> Centroids:
    """Centroids of the balanced parts of a sample of unit vectors, and their graph."""
    parts, points = [np.arange(len(sample))], []
    while parts:
        rows = parts.pop()
        own = sample[rows]
        if len(rows) < 2 * part_rows:
            mean = own.mean(axis=0)
            points.append(mean / max(np.linalg.norm(mean), 1e-12))
            continue
        centred = own - own.mean(axis=0)
        axis = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = np.argsort(centred @ axis, kind="stable")
        parts += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    points = np.array(points)
    near = np.argsort(-(points @ points.T), axis=1, kind="stable")
    links = near[:, 1:degree + 1] if len(points) > 1 else np.zeros((1, 1), int)
    # a few far links keep the graph connected
    far = (np.arange(len(points))[:, None] + len(points) * np.array([1, 2, 3]) // 4) % len(points)
    return Centroids(points, np.concatenate([links, far], axis=1))


def nearest_lists(vectors: np.ndarray, centroids: Centroids, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector up to `most` lists in ascending distance: their numbers and distances, by best-first search of
    the graph. All vectors step together; a vector stops when its best open centroid is farther than its `most` best."""
    n, c = len(vectors), len(centroids.points)
    most = min(most, c)
    seen = np.full((n, c), np.inf)
    opened = np.zeros((n, c), bool)
    entry = np.unique(np.linspace(0, c - 1, 8).astype(int))
    seen[:, entry] = np.sqrt(np.maximum(2 - 2 * vectors @ centroids.points[entry].T, 0))
    active = np.arange(n)
    while len(active):
        open_ = np.where(opened[active], np.inf, seen[active])
        at = open_.argmin(axis=1)
        best = open_[np.arange(len(active)), at]
        worst = np.partition(seen[active], most - 1, axis=1)[:, most - 1]
        go = np.isfinite(best) & (best <= worst)
        active, at = active[go], at[go]
        opened[active, at] = True
        near = centroids.links[at]
        dots = np.einsum("nkd,nd->nk", centroids.points[near], vectors[active])
        seen[active[:, None], near] = np.sqrt(np.maximum(2 - 2 * dots, 0))
    order = np.argsort(seen, axis=1, kind="stable")[:, :most]
    return order, np.take_along_axis(seen, order, axis=1)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, of the rows that take part: not null, not empty, not zero, all components finite."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0))
            .select(F.col("vec_id").cast("long"), v.alias("embedding")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.to_list(), np.float64)


def _levelled(rows: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two so that their largest component is between 1/2 and 1. That is exact, leaves cosines as they
    are, and squares neither overflow nor vanish."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = _levelled(rows)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _lists(rows: DataFrame, centroids: Centroids, most: int, ratio: float) -> DataFrame:
    """vec_id, list, embedding: each row once per list within the ratio of its nearest distance."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)        # at most 2 * SAMPLE_ROWS / PART_ROWS points

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                own = batch.iloc[lo:lo + 2000]
                order, distance = nearest_lists(_unit(_matrix(own["embedding"])), shared.value, most)
                keep = distance <= np.maximum(distance[:, :1] * ratio, 1e-6)
                row, place = np.nonzero(keep)
                yield pd.DataFrame({"vec_id": own["vec_id"].to_numpy()[row], "list": order[row, place].astype(np.int32),
                                    "embedding": own["embedding"].to_numpy()[row]})
    return rows.mapInPandas(run, "vec_id long, list int, embedding array<double>")


def _blocks(rows: DataFrame, sizes: DataFrame, own: str, other: str) -> DataFrame:
    """Rows with the number of their own block and, once each, of every block of the other side."""
    return (rows.join(F.broadcast(sizes), "list")      # a row per list
            .withColumn(own, F.pmod(F.xxhash64("vec_id"), F.col(f"n_{own}")))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1)))
            .select("list", "row_block", "query_block", "vec_id", "embedding"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, probes: int = PROBES, ratio: float = PROBE_RATIO,
           sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row of `queries` among all rows of `vectors`, itself excluded.

    Scores are cosines in double precision of the original vectors, of any finite magnitude; ties go to the smaller vec_id. Unusable vectors take no
    part, nor do those of another length than most of the sample. Repeated rows count once. An empty table gives an
    empty result. A list of any size is cut into blocks, and so are its queries; each pair of blocks is a task of
    bounded memory that keeps k rows per query. A query whose lists hold fewer than k others reads on in all lists.
    """
    rows, asked = usable(vectors), usable(queries)
    empty = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if sample.empty:
        return spark.createDataFrame([], empty)
    length = int(sample["embedding"].map(len).mode()[0])
    centroids = fit(_unit(_matrix(sample["embedding"][sample["embedding"].map(len) == length])))
    rows, asked = (t.where(F.size("embedding") == length) for t in (rows, asked))

    def nearest(most: int, width: float, copies: int, these: DataFrame) -> DataFrame:
        posted = _lists(rows, centroids, copies, COPY_RATIO)
        probing = _lists(these, centroids, most, width)
        sizes = materialise(posted.groupBy("list").count().withColumnRenamed("count", "_rows").join(
            probing.groupBy("list").count(), "list").select(
            "list", F.ceil(F.col("_rows") / BLOCK_ROWS).alias("n_row_block"), F.ceil(F.col("count") / BLOCK_ROWS).alias("n_query_block")))
        keys = ["list", "row_block", "query_block"]
        found = (_blocks(posted, sizes, "row_block", "query_block").groupBy(*keys)
                 .cogroup(_blocks(probing, sizes, "query_block", "row_block").groupBy(*keys))
                 .applyInPandas(lambda a, b: top_k(a, b, k), "query_id long, vec_id long, score double")).distinct()
        order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")       # k rows per block searched
        return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))
    first = materialise(nearest(probes, ratio, COPIES, asked))
    full = first.groupBy("query_id").count().where(F.col("count") >= k).select(F.col("query_id").alias("vec_id"))
    short = materialise(asked.join(full, "vec_id", "left_anti"))
    if short.limit(1).count() == 0:
        return first
    rest = nearest(len(centroids.points), float("inf"), 1, short)
    return first.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(rest)


def top_k(posted: pd.DataFrame, probing: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block, exactly. A matrix product finds them; their scores are summed
    anew row by row, so that equal vectors have equal scores wherever they lie."""
    out = []
    if len(posted) and len(probing):
        posted = posted.drop_duplicates("vec_id")
        probing = probing.drop_duplicates("vec_id")
        p, q, ids = _levelled(_matrix(posted["embedding"])), _levelled(_matrix(probing["embedding"])), posted["vec_id"].to_numpy()
        pn, qn = np.sqrt((p * p).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        step = max(1, 4_000_000 // len(p))
        for lo in range(0, len(q), step):
            rough = (q[lo:lo + step] / qn[lo:lo + step, None]) @ (p / pn[:, None]).T
            for i, query_id in enumerate(probing["vec_id"].to_numpy()[lo:lo + step]):
                row = rough[i]
                row[ids == query_id] = -np.inf
                usable_rows = len(row) - int((ids == query_id).sum())
                take = min(k, usable_rows)
                if take == 0:
                    continue
                near = np.flatnonzero(row >= np.partition(row, len(row) - take)[len(row) - take] - 1e-9)
                exact = (p[near] * q[lo + i]).sum(axis=1) / (pn[near] * qn[lo + i])
                best = np.lexsort((ids[near], -exact))[:take]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[near][best], "score": exact[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
