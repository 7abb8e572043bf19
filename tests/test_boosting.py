"""Boosted trees by Spark histograms against a plain Python version, and what going on from a stored ensemble must keep."""

import math
import random

import numpy as np
import pytest

from ledgermill import fixed_values as V
from ledgermill.operators import boosting as B
from ledgermill.operators import risk_model as rm

USED = list(V.NUMERIC_FEATURES[:4])


def make_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [None if rng.random() < 0.1 else round(rng.gauss(0, 1), 3) for _ in USED]
        sector = rng.choice(["agro", "tambang", None])
        score = (x[0] or 0) + (1 if sector == "agro" else 0) - 0.5 * (x[2] or 0) + 0.2 * rng.gauss(0, 1)
        rows.append((f"u{i}", sector, "High" if score > 0.8 else "Low" if score < -0.3 else "Medium", *x))
    return rows


def frame(spark, rows):
    fields = ", ".join(f"{f} double" for f in USED)
    return spark.createDataFrame(rows, f"UniqueID string, {V.SECTOR} string, {V.TARGET} string, {fields}")


def plain_bins(rows, model):
    out = []
    for _, sector, _, *x in rows:
        values = dict(zip(USED, x))
        numeric = [0 if values.get(f) is None else 1 + sum(b < values[f] for b in borders) for f, borders in zip(V.NUMERIC_FEATURES, model.borders)]
        out.append(numeric + [int((sector or "Unknown") == s) for s in model.sectors])
    return out


def plain_trees(rows, model, rounds, depth):
    """The whole method row by row: every split is tried by dividing the rows."""
    bins, k = plain_bins(rows, model), len(model.labels)
    scores, trees = [[0.0] * k for _ in rows], []
    for _ in range(rounds):
        sums = []
        for s, r in zip(scores, rows):
            odds = [math.exp(v - max(s)) for v in s]
            p = [o / sum(odds) for o in odds]
            y = model.labels.index(r[2])
            sums.append([round((p[c] - (c == y)) * B.UNIT) for c in range(k)] + [round(p[c] * (1 - p[c]) * B.UNIT) for c in range(k)])
        leaf, features, cuts = [0] * len(rows), [], []
        for level in range(depth):
            gains = {}
            for f in range(len(bins[0])):
                for at in range(max(b[f] for b in bins)):
                    sides = {}
                    for i, b in enumerate(bins):
                        total = sides.setdefault((leaf[i], b[f] > at), [0] * (2 * k))
                        for j in range(2 * k):
                            total[j] += sums[i][j]
                    gains[f, at] = sum(t[c] ** 2 / (t[k + c] + B.L2 * B.UNIT) for t in sides.values() for c in range(k))
            best = max(gains.values())
            f, at = min(x for x, g in gains.items() if g >= best - abs(best) * 1e-10)
            features.append(f)
            cuts.append(at)
            leaf = [n + ((bins[i][f] > at) << level) for i, n in enumerate(leaf)]
        values = [[0.0] * k for _ in range(1 << depth)]
        for n in range(1 << depth):
            total = [sum(sums[i][j] for i in range(len(rows)) if leaf[i] == n) for j in range(2 * k)]
            values[n] = [-B.RATE * total[c] / (total[k + c] + B.L2 * B.UNIT) for c in range(k)]
        scores = [[a + b for a, b in zip(s, values[n])] for s, n in zip(scores, leaf)]
        trees.append((features, cuts, values))
    return trees, scores


def test_trees_equal_the_plain_version(spark):
    rows = make_rows(200, 1)
    table = frame(spark, [*rows, ("none", "agro", None, 1.0, 1.0, 1.0, 1.0)])        # a row without a label takes no part
    model = B.train(table, rounds=3, depth=3)
    assert model.labels == ("High", "Low", "Medium") and model.sectors == ("Unknown", "agro", "tambang")
    trees, scores = plain_trees(rows, model, 3, 3)
    for tree, (features, cuts, values) in zip(model.trees, trees):
        assert (list(tree.features), list(tree.bins)) == (features, cuts)
        assert all(math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-9) for x, y in zip(tree.values, values) for a, b in zip(x, y))
    found = {r.UniqueID: r for r in B.predict(table, model, ["UniqueID"]).collect()}
    for row, s in zip(rows, scores):
        assert found[row[0]].risk_category == model.labels[s.index(max(s))]
        assert math.isclose(sum(found[row[0]].probabilities.values()), 1.0) and found[row[0]].risk_score == V.RISK_POINTS[found[row[0]].risk_category]


def test_going_on_equals_one_run(spark, tmp_path):
    table = frame(spark, make_rows(300, 2))
    whole = B.train(table, rounds=6, depth=2)
    half = B.train(table.repartition(5), rounds=3, depth=2)             # sums do not depend on the order of rows
    half.save(str(tmp_path / "half"))
    stored = B.BoostedModel.load(str(tmp_path / "half"))
    assert stored == half
    more, status = B.update(table, stored, rounds=3, depth=2)
    assert status == rm.UPDATED and more == whole


def test_staged_batches_and_guards(spark):
    first, second = frame(spark, make_rows(200, 3)), frame(spark, make_rows(150, 4))
    one_class = second.where(f"{V.TARGET} = 'Low'")
    strange = frame(spark, [("z", "agro", "Unheard", 1.0, 1.0, 1.0, 1.0), *make_rows(5, 6)])
    new_sector = frame(spark, [(u, "angkutan", t, *x) for u, _, t, *x in make_rows(60, 5)])
    model, log = B.staged_training(first, [("one", one_class), ("strange", strange), ("none", first.limit(0)), ("more", second), ("sector", new_sector)],
                                   rounds=2, depth=2)
    assert log == [("one", rm.SINGLE_CLASS, 2), ("strange", rm.UNSEEN, 2), ("none", rm.EMPTY, 2), ("more", rm.UPDATED, 4), ("sector", rm.UPDATED, 6)]
    # a batch reads nothing but itself: the same ensemble comes from the stored one alone
    start = B.train(first, rounds=2, depth=2)
    again = B.extend(new_sector, B.extend(second, start, rounds=2, depth=2), rounds=2, depth=2)
    assert again == model and B.update(first, None)[1] == rm.NO_MODEL
    assert B.train(first.where("false")) is None
    missing = B.predict(first, None, ["UniqueID"]).first()
    assert missing.risk_category is None and missing.error == V.MODEL_NOT_LOADED


def test_learns(spark):
    model = B.train(frame(spark, make_rows(2000, 7)), rounds=8, depth=4, rate=0.4)
    held = make_rows(500, 8)
    found = {r.UniqueID: r.risk_category for r in B.predict(frame(spark, held), model, ["UniqueID"]).collect()}
    assert sum(found[r[0]] == r[2] for r in held) / len(held) > 0.75
    assert len(model.borders[0]) <= B.BINS and model.borders[len(USED)] == ()
    assert pytest.approx(0.0, abs=1e-12) == sum(B.Tree((0,), (0,), ((0.0,), (0.0,))).values[0])


def test_missing_values_and_other_sectors_are_not_added_up(spark, monkeypatch):
    """Bin 0 of every feature is what its other bins leave of the leaf; the histogram is that of all entries."""
    rng = random.Random(4)
    data = [([0, rng.randint(0, 3), 0, rng.randint(0, 1), 1], [rng.randint(-99, 99), rng.randint(0, 99)]) for _ in range(200)]
    rows, tables = spark.createDataFrame(data, "bins array<int>, sums array<bigint>"), []
    to_arrow = type(rows).toArrow
    monkeypatch.setattr(type(rows), "toArrow", lambda self: tables.append(to_arrow(self)) or tables[-1])
    found = B.histogram(rows, [1, 3], [1, 0], (4, 5, 4), 1)
    expected = np.zeros((4, 5, 4, 2), np.int64)
    for bins, sums in data:
        for f, b in enumerate(bins):
            expected[(bins[1] > 1) + 2 * (bins[3] > 0), f, b] += sums
    assert (found == expected).all()
    assert 0 not in tables[0].column("bin").to_pylist()
