"""Boosted trees for several classes that go on from a stored ensemble, by histograms that Spark adds up.

Every tree asks one question per level (feature above a border?), so a leaf is a number of `depth` bits and a tree is a small
row: features, borders and a value per leaf and class. A level is chosen from one aggregate over the rows: sums of gradients
and curvatures of the softmax loss per leaf, feature and bin, in whole numbers, so that they do not depend on the order
of rows or tasks. Their number is bounded by leaves x features x bins, whatever the rows. A batch continues an ensemble: its
rows are scored by the trees that are there, and new trees are fitted to what is left. Earlier rows are not read again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermill import fixed_values as V
from ledgermill.operators.risk_model import UPDATED, select_features, update_guard
from ledgermill.session import materialise

ROUNDS, DEPTH, BINS, RATE, L2 = 20, 6, 32, 0.1, 3.0
#: Gradients are counted in units of 2^-20.
UNIT = 1 << 20
#: Splits whose scores agree to this share are ties; the first feature and lowest border wins.
TIE = 1e-12
#: Trees between reliable checkpoints of the scored rows.
CHECKPOINT_TREES = 8


@dataclass(frozen=True)
class Tree:
    """Level l sends a row to the upper half if the bin of features[l] is above bins[l]; values[leaf][class]."""
    features: tuple[int, ...]
    bins: tuple[int, ...]
    values: tuple[tuple[float, ...], ...]


@dataclass(frozen=True)
class BoostedModel:
    """Label dictionary and borders as first fitted, and the trees so far. Features are the numeric ones, then the sectors."""
    labels: tuple[str, ...]
    borders: tuple[tuple[float, ...], ...]
    sectors: tuple[str, ...]
    trees: tuple[Tree, ...] = ()

    def save(self, path: str) -> None:
        """Three small tables; the trees are a row each."""
        spark = SparkSession.active()
        parts = {"labels": [(i, x) for i, x in enumerate(self.labels)], "sectors": [(i, x) for i, x in enumerate(self.sectors)],
                 "borders": [(i, list(b)) for i, b in enumerate(self.borders)],
                 "trees": [(i, list(t.features), list(t.bins), [list(v) for v in t.values]) for i, t in enumerate(self.trees)]}
        schemas = {"labels": "pos INT, name STRING", "sectors": "pos INT, name STRING", "borders": "pos INT, borders ARRAY<DOUBLE>",
                   "trees": "pos INT, features ARRAY<INT>, bins ARRAY<INT>, leaf_values ARRAY<ARRAY<DOUBLE>>"}
        for name, rows in parts.items():
            spark.createDataFrame(rows, schemas[name]).coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, path: str) -> "BoostedModel":
        def rows(name: str) -> list:
            return SparkSession.active().read.parquet(f"{path}/{name}").orderBy("pos").collect()
        return cls(tuple(r["name"] for r in rows("labels")), tuple(tuple(r["borders"]) for r in rows("borders")),
                   tuple(r["name"] for r in rows("sectors")),
                   tuple(Tree(tuple(r["features"]), tuple(r["bins"]), tuple(map(tuple, r["leaf_values"]))) for r in rows("trees")))


def fit_borders(table: DataFrame, bins: int = BINS) -> tuple[tuple[float, ...], ...]:
    """Ascending borders of each numeric feature: its quantiles, from one aggregate; none for a feature without values."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    row = table.agg(*[F.percentile_approx(f, shares, 10_000).alias(f) for f in V.NUMERIC_FEATURES]).first()
    return tuple(tuple(sorted(set(row[f] or ()))) for f in V.NUMERIC_FEATURES)


def bin_numbers(model: BoostedModel) -> Column:
    """Bins of a row of `select_features`: 0 for a missing value, else 1 and the number of borders below it; a sector is 1 in its
    own place. A sector that was not there at first is 0 everywhere."""
    def number(feature: str, borders: tuple[float, ...]) -> Column:
        below = F.filter(F.array(*[F.lit(b) for b in borders]).cast("array<double>"), lambda b: b < F.col(feature))
        return F.when(F.col(feature).isNull(), 0).otherwise(F.size(below) + 1).cast("int")
    numeric = [number(f, borders) for f, borders in zip(V.NUMERIC_FEATURES, model.borders)]
    return F.array(*numeric, *[(F.col(V.SECTOR) == s).cast("int") for s in model.sectors])


def _leaf(tree_features: Sequence[int], tree_bins: Sequence[int]) -> Column:
    """Leaf number from the column `bins`."""
    return sum((F.when(F.col("bins")[f] > b, 1 << level).otherwise(0) for level, (f, b) in enumerate(zip(tree_features, tree_bins))), F.lit(0))


def _added(scores: Column, tree: Tree) -> Column:
    """Scores with the values of a tree added, class by class."""
    leaves = F.array(*[F.array(*[F.lit(v) for v in row]) for row in tree.values])
    return F.zip_with(scores, F.get(leaves, _leaf(tree.features, tree.bins)), lambda a, b: a + b)


def scored(rows: DataFrame, model: BoostedModel) -> DataFrame:
    """`rows` (with `bins`) and `scores`, summed tree by tree in order."""
    out = rows.withColumn("scores", F.array_repeat(F.lit(0.0), len(model.labels)))
    for tree in model.trees:
        out = out.withColumn("scores", _added(F.col("scores"), tree))
    return out


def _shares(scores: Column) -> Column:
    """Softmax."""
    odds = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(odds, lambda o: o / F.aggregate(odds, F.lit(0.0), lambda a, x: a + x))


def with_gradients(rows: DataFrame, classes: int) -> DataFrame:
    """`rows` (scores, label) and `sums`: gradients of all classes, then curvatures, in whole units."""
    shares = rows.withColumn("p", _shares(F.col("scores")))
    gradient = F.transform("p", lambda p, k: F.round((p - F.when(k == F.col("label"), 1.0).otherwise(0.0)) * UNIT).cast("bigint"))
    curvature = F.transform("p", lambda p: F.round(p * (1.0 - p) * UNIT).cast("bigint"))
    return shares.withColumn("sums", F.concat(gradient, curvature)).drop("p")


def histogram(rows: DataFrame, features: Sequence[int], bins: Sequence[int], shape: tuple[int, int, int], classes: int) -> np.ndarray:
    """Sums per (leaf, feature, bin, 2 x class) of the rows under the levels chosen so far. Added up in each task first; what
    reaches the driver is bounded by the shape. Most features of a row are missing or other sectors, which are bin 0: their sums are
    what the other bins leave of the leaf's, exactly, as they are whole numbers, so that those entries need no adding up."""
    sums = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 * classes)]
    entries = F.posexplode(F.concat("bins", F.array(F.lit(1)))).alias("feature", "bin")         # the last one is the leaf itself
    table = (rows.select(_leaf(features, bins).alias("leaf"), "sums", entries).where(F.col("bin") != 0)
             .groupBy("leaf", "feature", "bin").agg(*sums)).toArrow()
    out = np.zeros((shape[0], shape[1] + 1, shape[2], 2 * classes), np.int64)
    at = tuple(table.column(c).to_numpy() for c in ("leaf", "feature", "bin"))
    for i in range(2 * classes):
        out[(*at, i)] = table.column(f"s{i}").to_numpy()
    out, leaves = out[:, :-1], out[:, -1, 1]
    out[:, :, 0] = leaves[:, None] - out[:, :, 1:].sum(axis=2)
    return out


def choose_split(sums: np.ndarray, classes: int, l2: float = L2) -> tuple[int, int, np.ndarray]:
    """The feature and bin whose two sides have the largest sum of G^2 / (H + l2), and the sums of both sides per leaf."""
    left = sums.cumsum(axis=2)
    total = left[:, :, -1:, :]
    sides = np.stack([left, total - left]).astype(np.float64)           # side, leaf, feature, bin, sum
    gain = (sides[..., :classes] ** 2 / (sides[..., classes:] + l2 * UNIT)).sum(axis=(0, 1, 4))[:, :-1]
    best = gain.max()
    feature, at = (int(x) for x in np.argwhere(gain >= best - abs(best) * TIE)[0])
    return feature, at, np.stack([left[:, feature, at], (total - left)[:, feature, at]])


def grow(rows: DataFrame, model: BoostedModel, depth: int = DEPTH, rate: float = RATE, l2: float = L2) -> Tree:
    """One tree for rows with `bins` and `sums`."""
    classes = len(model.labels)
    widths = [len(b) + 2 for b in model.borders] + [2] * len(model.sectors)
    features: list[int] = []
    bins: list[int] = []
    for level in range(depth):
        sums = histogram(rows, features, bins, (1 << level, len(widths), max(widths)), classes)
        feature, at, halves = choose_split(sums, classes, l2)
        features.append(feature)
        bins.append(at)
    leaves = np.concatenate([halves[0], halves[1]])                     # the last level is the highest bit
    values = -rate * leaves[:, :classes] / (leaves[:, classes:] + l2 * UNIT)
    return Tree(tuple(features), tuple(bins), tuple(tuple(float(v) for v in row) for row in values))


def extend(batch: DataFrame, model: BoostedModel, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, l2: float = L2) -> BoostedModel:
    """The model with `rounds` more trees, fitted to the labelled rows of the batch. Fitting 2n trees on the same rows and fitting n
    and n more give the same trees, as scores are summed in the same order."""
    data = select_features(batch, [V.TARGET]).where(F.col(V.TARGET).isin(list(model.labels)))
    label = F.array_position(F.array(*[F.lit(x) for x in model.labels]), F.col(V.TARGET)) - 1
    rows = scored(materialise(data.select(bin_numbers(model).alias("bins"), label.cast("int").alias("label"))), model)
    trees, last = [], None
    for number in range(rounds):
        rows = with_gradients(rows, len(model.labels))
        rows = materialise(rows) if number % CHECKPOINT_TREES == CHECKPOINT_TREES - 1 else rows.persist(StorageLevel.MEMORY_AND_DISK)
        trees.append(grow(rows, model, depth, rate, l2))
        if last is not None:
            last.unpersist()
        last, rows = rows, rows.withColumn("scores", _added(F.col("scores"), trees[-1])).drop("sums")
    if last is not None:
        last.unpersist()
    return replace(model, trees=model.trees + tuple(trees))


def train(table: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, l2: float = L2) -> BoostedModel | None:
    """Label dictionary and sectors (alphabetical), borders, and the first trees; None if no row has a label."""
    data = materialise(select_features(table, [V.TARGET]).where(F.col(V.TARGET).isNotNull()))
    names = data.agg(F.array_sort(F.collect_set(V.TARGET)).alias("labels"), F.array_sort(F.collect_set(V.SECTOR)).alias("sectors")).first()
    if not names["labels"]:
        return None
    return extend(data, BoostedModel(tuple(names["labels"]), fit_borders(data), tuple(names["sectors"])), rounds, depth, rate, l2)


def update(batch: DataFrame, model: BoostedModel | None, rounds: int = ROUNDS, **options) -> tuple[BoostedModel | None, str]:
    """Continue with a batch. The guards are those of the refitted model; a batch that fails one leaves the model as it is."""
    status = update_guard(batch, model)
    return (extend(batch, model, rounds, **options) if status == UPDATED else model), status


def staged_training(initial: DataFrame, batches: Sequence[tuple[str, DataFrame]], rounds: int = ROUNDS,
                    **options) -> tuple[BoostedModel | None, list[tuple[str, str, int]]]:
    """Train on the first rows, then offer the batches in turn: (name, status, trees afterwards). No batch reads an earlier one."""
    model, log = train(initial, rounds, **options), []
    for name, batch in batches:
        model, status = update(batch, model, rounds, **options)
        log.append((name, status, len(model.trees) if model else 0))
    return model, log


def predict(table: DataFrame, model: BoostedModel | None, keep: Sequence[str] = ()) -> DataFrame:
    """keep columns, risk_category, risk_score, probabilities MAP<class, DOUBLE>, error; as the prediction of the refitted model.
    Of equal shares the first class wins."""
    if model is None:
        return table.select(*keep, F.lit(None).cast("string").alias("risk_category"), F.lit(None).cast("double").alias("risk_score"),
                            F.lit(None).cast("map<string,double>").alias("probabilities"), F.lit(V.MODEL_NOT_LOADED).alias("error"))
    rows = scored(select_features(table, keep).withColumn("bins", bin_numbers(model)), model)
    names = F.array(*[F.lit(x) for x in model.labels])
    shares = rows.select(*keep, _shares(F.col("scores")).alias("p"))
    label = F.get(names, F.array_position("p", F.array_max("p")).cast("int") - 1)
    points = F.create_map(*[F.lit(x) for pair in V.RISK_POINTS.items() for x in pair])
    return shares.select(*keep, label.alias("risk_category"), F.try_element_at(points, label).alias("risk_score"),
                         F.map_from_arrays(names, F.col("p")).alias("probabilities"), F.lit(None).cast("string").alias("error"))
