import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgermill.operators import evaluation as E, roc as R
from ledgermill.operators.ordered import ordered_pass
from ledgermill.sources.keywords import custom_set

KEYS = custom_set([("a", ["a"]), ("b", ["b"]), ("c", ["c"]), ("d", ["d"]), ("e", ["e"])])


def test_roc_ties_and_missing_class(spark):
    rows = spark.createDataFrame([(.75, 1), (.75, 0), (.25, 1), (.25, 0)], "score double, hit int")
    assert [(r.fpr, r.tpr) for r in R.roc_points(rows).orderBy("fpr").collect()] == [(0, 0), (.5, .5), (1, 1)]
    assert R.auc(rows).first()["auc"] == 0.5
    single = spark.createDataFrame([(.7, 1), (.2, 1)], "score double, hit int")
    assert R.auc(single).first()["auc"] == 0.5
    assert sorted((r.fpr, r.tpr) for r in R.roc_points(single).collect()) == [(0, 0), (1, 1)]


def test_ordered_pass_keeps_null_keys_and_balances_any_number_of_buckets(spark):
    rows = spark.createDataFrame([(None, 1.0, 2), (None, 2.0, 3), ("x", 1.0, 5)], "k string, v double, w long")
    for buckets in (2, 64, 3000):
        out = ordered_pass(rows, ["k"], "v", ["w"], buckets=buckets)
        assert {(r.k, r.v, r.w_upto, r.w_total) for r in out.collect()} == {(None, 1.0, 2, 5), (None, 2.0, 5, 5), ("x", 1.0, 5, 5)}


def test_ordered_pass_equals_a_sort(spark):
    rng = np.random.default_rng(3)
    values = rng.permutation(20000).astype(float).tolist()
    rows = spark.createDataFrame([(i % 2, v, int(v) % 7) for i, v in enumerate(values)], "k int, v double, w int")
    out = ordered_pass(rows, ["k"], "v", ["w"], {"before": F.when(F.col("w") == 3, F.col("v"))},
                       {"after": F.when(F.col("w") == 5, F.col("v"))}, buckets=16)
    for k in (0, 1):
        got = sorted((r for r in out.where(F.col("k") == k).collect()), key=lambda r: r.v)
        assert np.array_equal(np.cumsum([r.w for r in got]), [r.w_upto for r in got])
        last = None
        for r in got:
            assert r.before == last
            last = r.v if r.w == 3 else last
        following = None
        for r in reversed(got):
            assert r.after == following
            following = r.v if r.w == 5 else following


def test_evaluation_table(spark):
    docs = spark.createDataFrame([("x.1.pdf", {"a": (10.0, 1.0), "b": (1.0, None), "d": (2.0, None), "c": (None, None), "info_x": (1.0, None)}, None, "ok"),
                                  ("bad.pdf", {"a": (1.0, None)}, "Error", "ok"), ("kosong.pdf", {"a": (1.0, None)}, None, "teks kosong"),
                                  ("untrue.pdf", {"a": (1.0, None)}, None, "ok")],
                                 "nama_file string, items map<string,struct<t:double,t_minus_1:double>>, error_flag string, info_parsing string")
    truth = spark.createDataFrame([(s, {"a": 10.0, "b": 0.0, "c": 5.0}) for s in ("x.1", "bad", "kosong")], "stem string, truth map<string,double>")
    out = E.compare_with_truth(docs, truth, KEYS)
    rows = {r.item: r for r in out.collect()}
    assert {k: (r.tp, r.fp, r.fn) for k, r in rows.items()} == {
        "a": (1, 0, 0), "b": (1, 0, 0), "c": (0, 0, 1), "d": (0, 1, 0), "e": (0, 0, 0)}
    assert rows["b"].mean_percentage_error == 100.0 and rows["b"].mean_absolute_error == 1.0 and rows["b"].exact_match_rate == 0
    assert rows["a"].f1_score == 100.0 and rows["d"].detection_rate is None and rows["e"].precision == 0
    assert E.overall_accuracy(out).first()["accuracy_percentage"] == pytest.approx(100 / 3)
    assert {r.item: r.documents_found for r in E.coverage(docs, KEYS).collect()} == {"a": 4, "b": 1, "d": 1}
    plain = docs.withColumn("items", F.transform_values("items", lambda _, v: v["t"]))
    assert E.compare_with_truth(plain, truth, KEYS).where("item = 'a'").first()["tp"] == 1
    scores = {(r.nama_file, r.item): r.score for r in E.heuristic_scores(docs, KEYS).collect()}
    assert scores[("x.1.pdf", "a")] == 0.75 and scores[("x.1.pdf", "c")] == 0.25 and len(scores) == 20
    assert E.detection_roc(docs, truth, KEYS).count() == 3


def test_class_report(spark):
    rows = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "label string, prediction string")
    out = {r["class"]: r for r in E.class_report(rows, ["a", "b", "c"]).collect()}
    assert (out["a"].precision, out["a"].recall, out["c"].f1_score, out["accuracy"].f1_score) == (0.5, 0.5, 0.0, 0.5)
    assert out["weighted avg"].precision == pytest.approx((0.5 * 2 + 0.5 + 0) / 4) and out["macro avg"].support == 4


def test_multiclass_areas_against_numpy(spark):
    rng = np.random.default_rng(1)
    classes = ["x", "y", "z"]
    labels = rng.choice(classes, 120)
    probs = np.round(rng.random((120, 3)) + 0.4 * (labels[:, None] == np.array(classes)), 1)
    rows = spark.createDataFrame([(str(l), dict(zip(classes, map(float, p)))) for l, p in zip(labels, probs)],
                                 "label string, probabilities map<string,double>")
    got = {(r.measure, r["class"]): r.auc for r in R.multiclass_auc(rows, classes).collect()}

    def curve(hit, score):
        cuts = np.unique(score)[::-1]
        fp = np.array([(score >= c)[~hit].sum() for c in cuts], float)
        tp = np.array([(score >= c)[hit].sum() for c in cuts], float)
        keep = np.r_[True, (np.diff(fp, 2) != 0) | (np.diff(tp, 2) != 0), True] if len(cuts) > 2 else np.ones(len(cuts), bool)
        fp, tp = np.r_[0, fp[keep]], np.r_[0, tp[keep]]
        return fp / fp[-1], tp / tp[-1]
    curves = [curve(labels == k, probs[:, i]) for i, k in enumerate(classes)]
    for k, (f, t) in zip(classes, curves):
        assert got[("class", k)] == pytest.approx(np.trapezoid(t, f), abs=1e-12)
    grid = np.unique(np.concatenate([f for f, _ in curves]))
    mean = sum(np.interp(grid, f, t) for f, t in curves) / 3
    assert got[("macro", None)] == pytest.approx(np.trapezoid(mean, grid), abs=1e-12)
