"""Centroid clustering with heap-ordered bounds, exact in integers.

Vectors lie in blocks of bounded size. A block keeps a heap per cluster, ordered by the gap between the distance to the
second nearest and to the own centroid. When centroids move, the gap of a vector shrinks at most by the drift of its own
centroid and the largest drift of the others; these are added up in one number per cluster. A key is the gap plus that
number at the time of the scan, so the vectors whose gap may have closed are those at the top of the heap with a key up to
today's number. Only they are popped, compared with all centroids in integers, and pushed again. Blocks tell the driver what
moved: k sums per component, added up in Spark first.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermill.session import materialise

CLUSTERS, ROUNDS, COMPONENTS, SCALE, SEED = 8, 10, 64, 1024, 3
BLOCK_ROWS = 2048
#: Components from here on (before scaling) are left out: their squared distances do not fit 64 bits.
LIMIT = 2.0 ** 17
#: Rounds between reliable checkpoints of the blocks; in between a lost block is computed again from the one before.
CHECKPOINT_ROUNDS = 20
#: Share by which bounds are widened, far above the rounding of doubles.
SLACK = 1e-9
_BLOCK = ("ids array<bigint>, x binary, own binary, sizes binary, keys binary, rows binary, moved array<bigint>")


@dataclass
class Heaps:
    """The state of a block: the cluster of each vector, and a heap of (key, row) per cluster."""
    own: np.ndarray
    heaps: list[list[tuple[float, int]]]


@dataclass(frozen=True)
class Clusters:
    """Final centroids, the blocks assigned to them, and how many vectors each assignment compared with all centroids."""
    points: list[list[int]]
    blocks: DataFrame
    scanned: list[int] = field(default_factory=list)


def scan(x: np.ndarray, rows: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row (ties: smaller number), exactly, and a lower bound of its gap to the second."""
    best, gap = np.empty(len(rows), np.int64), np.full(len(rows), np.inf)
    for lo in range(0, len(rows), 256):
        part = x[rows[lo:lo + 256]].astype(np.int64)
        squares = ((part[:, None, :] - points[None]) ** 2).sum(axis=2)
        best[lo:lo + 256] = squares.argmin(axis=1)
        if len(points) > 1:
            near = np.sqrt(np.partition(squares, 1, axis=1)[:, :2].astype(np.float64))
            gap[lo:lo + 256] = near[:, 1] * (1 - SLACK) - near[:, 0] * (1 + SLACK)
    return best, gap


def revise(x: np.ndarray, state: Heaps | None, points: np.ndarray, drift: np.ndarray) -> tuple[Heaps, np.ndarray, int]:
    """The state under new centroids; how counts and sums of the clusters change (k x (1 + components)); vectors scanned.

    `drift` has the accumulated drift of each cluster. Without a state, every vector is scanned."""
    k = len(points)
    change = np.zeros((k, 1 + x.shape[1]), np.int64)
    if state is None:
        state, popped = Heaps(np.full(len(x), -1), [[] for _ in range(k)]), np.arange(len(x))
    else:
        out = []
        for cluster, heap in enumerate(state.heaps):
            while heap and heap[0][0] <= drift[cluster]:
                out.append(heapq.heappop(heap)[1])
        popped = np.array(sorted(out), np.int64)
    best, gap = scan(x, popped, points)
    before = state.own[popped]
    for row, new, old, key in zip(popped.tolist(), best.tolist(), before.tolist(),
                                  (gap + drift[best] * (1 - SLACK)).tolist()):
        heapq.heappush(state.heaps[new], (key, row))
        if new != old:
            state.own[row] = new
            change[new, 0] += 1
            change[new, 1:] += x[row]
            if old >= 0:
                change[old, 0] -= 1
                change[old, 1:] -= x[row]
    return state, change, len(popped)


def _blocks(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[list, np.ndarray]]:
    """ids and integer matrices of at most BLOCK_ROWS vectors."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            yield part.column(0), part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, components).astype(np.int32)


def _record(ids: pa.Array, x: np.ndarray, state: Heaps, change: np.ndarray, scanned: int) -> pa.RecordBatch:
    entries = [e for heap in state.heaps for e in heap]
    packed = [x.astype(np.int32), state.own.astype(np.int32), np.array([len(h) for h in state.heaps], np.int32),
              np.array([e[0] for e in entries], np.float64), np.array([e[1] for e in entries], np.int32)]
    ids = ids if isinstance(ids, pa.ListArray) else pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    moved = pa.array([[*change.ravel().tolist(), scanned]], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, *[pa.array([a.tobytes()], pa.binary()) for a in packed], moved],
                                      names=["ids", "x", "own", "sizes", "keys", "rows", "moved"])


def _read(batch: pa.RecordBatch, i: int, components: int) -> tuple[pa.Array, np.ndarray, Heaps]:
    x, own, sizes, keys, rows = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (
        ("x", np.int32), ("own", np.int32), ("sizes", np.int32), ("keys", np.float64), ("rows", np.int32)))
    ends, entries = np.cumsum(sizes), list(zip(keys.tolist(), rows.tolist()))
    heaps = [entries[end - size:end] for end, size in zip(ends.tolist(), sizes.tolist())]
    return batch.column("ids").slice(i, 1), x.reshape(-1, components), Heaps(own.astype(np.int64), heaps)


def start_blocks(vectors: DataFrame, points: list[list[int]]) -> DataFrame:
    centres = np.array(points, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _blocks(batches, centres.shape[1]):
            yield _record(ids, x, *revise(x, None, centres, np.zeros(len(centres))))
    return vectors.mapInArrow(run, _BLOCK)


def next_blocks(blocks: DataFrame, points: list[list[int]], drift: list[float]) -> DataFrame:
    centres, moved = np.array(points, np.int64), np.array(drift)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, state = _read(batch, i, centres.shape[1])
                yield _record(ids, x, *revise(x, state, centres, moved))
    return blocks.mapInArrow(run, _BLOCK)


def changes(blocks: DataFrame, k: int, width: int) -> tuple[list[list[int]], int]:
    """The changes of all blocks, added up in Spark (k x width numbers), and the vectors scanned. Reads, and so keeps, all blocks."""
    rows = blocks.select(F.posexplode("moved").alias("pos", "v")).groupBy("pos").agg(F.sum("v").alias("v")).collect()
    flat = [0] * (k * width + 1)
    for r in rows:
        flat[r["pos"]] = r["v"]
    return [flat[i * width:(i + 1) * width] for i in range(k)], flat[-1]


def usable(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, x: integer vectors of the rows with exactly so many components, all finite and below LIMIT in size."""
    v = F.col("embedding").cast("array<double>")
    fits = (F.size(v) == components) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT))
    return vectors.where(F.coalesce(fits, F.lit(False))).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(v, lambda c: F.floor(c * scale).cast("int")).alias("x"))


def seeds(kept: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order (fewer if there are fewer); null ids last, repeated ids
    by their components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["x"] for r in kept.orderBy(order.asc_nulls_last(), "x").limit(k).collect()]


def fit(kept: DataFrame, points: list[list[int]], rounds: int = ROUNDS) -> Clusters:
    """Rounds of assignment and exact means (floor), and a last assignment. Blocks stay in executor memory or on its disk; a lost
    one is computed again from its vectors and the centroids of each round. If no centroid moves, the rounds left would
    change nothing and are not run."""
    k, width, scanned = len(points), 1 + len(points[0]), []
    totals, drift = [[0] * width for _ in range(k)], [0.0] * k
    blocks, last = start_blocks(kept, points).persist(StorageLevel.MEMORY_AND_DISK), None
    for number in range(1, rounds + 2):
        change, n = changes(blocks, k, width)
        scanned.append(n)
        if last is not None:
            last.unpersist()
        totals = [[a + b for a, b in zip(*rows)] for rows in zip(totals, change)]
        if number > rounds:
            break
        means = [[s // t[0] for s in t[1:]] if t[0] else p for t, p in zip(totals, points)]
        moves = [sum((a - b) ** 2 for a, b in zip(m, p)) ** 0.5 * (1 + SLACK) for m, p in zip(means, points)]
        if not any(moves):
            break
        points = means
        drift = [(d + moves[c] + max([m for j, m in enumerate(moves) if j != c], default=0.0)) * (1 + SLACK) for c, d in enumerate(drift)]
        last, blocks = blocks, next_blocks(blocks, points, drift)
        blocks = materialise(blocks) if number % CHECKPOINT_ROUNDS == 0 else blocks.persist(StorageLevel.MEMORY_AND_DISK)
    return Clusters(points, blocks, scanned)


def assigned(clusters: Clusters) -> DataFrame:
    """vec_id, cluster, distance of every vector: its cluster and the squared distance to that final centroid."""
    centres = np.array(clusters.points, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, x, state = _read(batch, i, centres.shape[1])
                far = ((x.astype(np.int64) - centres[state.own]) ** 2).sum(axis=1)
                yield pa.RecordBatch.from_arrays([ids.flatten(), pa.array(state.own, pa.int32()), pa.array(far)], names=["vec_id", "cluster", "distance"])
    return clusters.blocks.mapInArrow(run, "vec_id bigint, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every usable row of (vec_id, embedding).

    Left out are vectors that are null, of another length than 64, or with a component that is null, not finite or 2^17 or
    more in size, whose squared distance would not fit. Ties go to the smaller cluster number. Rows that repeat a vec_id
    count one by one; a null vec_id is never a first centroid while there are others. With fewer than k vectors there are
    as many clusters; an empty table gives no rows. Sums beyond 64 bits are null. Extra columns are not read.
    """
    spark = vectors.sparkSession
    kept = usable(vectors)
    points = seeds(kept, k)
    if not points:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    fitted = fit(kept, points, rounds)
    rows = assigned(fitted)
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}      # k rows at most
    inertia = None if None in sums.values() or sum(sums.values()) > 2 ** 63 - 1 else sum(sums.values())
    facts = [(c, sums.get(c), inertia, hashlib.sha256(",".join(map(str, p)).encode()).hexdigest()) for c, p in enumerate(fitted.points)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(       # k rows
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
