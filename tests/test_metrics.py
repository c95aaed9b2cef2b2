import numpy as np
import pytest
from pyspark.sql import functions as F

from presage.operators.metrics import best_threshold, confusion, evaluate, threshold_sweep
from presage.plans.compare import compare_models, save_result
from presage.plans.detect import fit_normal, zscore
from presage.plans.drift import drift_by_bin, drift_verdict
from presage.plans.lead_time import first_alerts, lead_time_summary


def frame(spark, labels, scores):
    return spark.createDataFrame([(int(y), float(s)) for y, s in zip(labels, scores)], "y int, s double")


def brute(labels, scores):
    y, s = np.array(labels), np.array(scores)
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    ap = sum(
        ((s == v) & (y == 1)).sum() / (y == 1).sum() * ((s >= v) & (y == 1)).sum() / (s >= v).sum() for v in set(scores)
    )
    return auc, ap


def test_ties(spark):
    y, s = [1, 0, 1, 0, 0, 1, 0, 0], [0.9, 0.9, 0.8, 0.5, 0.5, 0.5, 0.1, 0.1]
    row = evaluate(frame(spark, y, s), "y", "s", 0.5).first()
    auc, ap = brute(y, s)
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-15) and row["pr_auc"] == pytest.approx(ap, abs=1e-15)
    assert (row["tp"], row["fp"], row["fn"], row["tn"], row["n_test"], row["n_positive"]) == (3, 3, 0, 2, 8, 3)


def test_random_scores_and_reversal(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 3000), rng.random(3000).round(2)
    auc, ap = brute(y, s)
    row = evaluate(frame(spark, y, s), "y", "s", 0.5).first()
    back = evaluate(frame(spark, y, -s), "y", "s", 0.5).first()
    assert row["roc_auc"] == pytest.approx(auc, abs=1e-12) and row["pr_auc"] == pytest.approx(ap, abs=1e-12)
    assert back["roc_auc"] == pytest.approx(1 - auc, abs=1e-12)


def test_one_class_constant_and_empty(spark):
    one = evaluate(frame(spark, [0] * 4, [0.1, 0.2, 0.3, 0.9]), "y", "s", 0.5).first()
    assert one["roc_auc"] is None and one["pr_auc"] is None and one["precision"] == 0.0 and one["recall"] == 0.0
    flat = evaluate(frame(spark, [1, 0, 0, 1, 0, 0], [0.5] * 6), "y", "s", 0.5).first()
    assert flat["roc_auc"] == 0.5 and flat["pr_auc"] == pytest.approx(1 / 3)
    none = evaluate(frame(spark, [1], [0.5]).where("y = 5"), "y", "s", 0.5).first()
    assert none["n_test"] == 0 and none["roc_auc"] is None and none["f1"] == 0.0


def test_threshold_edges(spark):
    df = frame(spark, [1, 0], [2.0, 1.0])
    assert evaluate(df, "y", "s", 2.0).first()["tp"] == 1
    assert evaluate(df, "y", "s", 2.0, strict=True).first()["tp"] == 0
    assert confusion(df, "y", F.col("s") > 1.0).first()["tn"] == 1


@pytest.mark.parametrize("strict", [False, True])
def test_sweep_equals_one_pass_per_threshold(spark, strict):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 21, 500) * 0.05
    df = frame(spark, y, s).cache()
    got = threshold_sweep(df, "y", "s", strict=strict).collect()
    assert len(got) == 19
    for r in got:
        flagged = s > r["threshold"] if strict else s >= r["threshold"]
        tp, fp, fn = ((y == 1) & flagged).sum(), ((y == 0) & flagged).sum(), ((y == 1) & ~flagged).sum()
        assert (r["tp"], r["fp"], r["fn"]) == (tp, fp, fn)
        assert r["f1"] == pytest.approx(2 * tp / (2 * tp + fp + fn))
    best = best_threshold(threshold_sweep(df, "y", "s", strict=strict)).first()
    assert best["f1"] == max(r["f1"] for r in got)
    assert best["threshold"] == min(r["threshold"] for r in got if r["f1"] == best["f1"])


def test_zscore(spark):
    df = spark.createDataFrame([(0, 1.0, 5.0), (0, 3.0, 5.0), (1, 9.0, 5.0)], "y int, a double, b double")
    normal = fit_normal(df, ["a", "b"], "y")
    assert normal == {"a": (2.0, 1.0), "b": (5.0, 1e-6)}
    assert [r["score"] for r in zscore(df, normal).orderBy("a").collect()] == [1.0, 1.0, 7.0]


def test_lead_time(spark):
    rows = [
        # job, end, fail, label, score
        (1, 60, 600, 0, 0.9), (1, 120, 600, 1, 0.9), (2, 60, 60, 1, 0.9), (3, 60, 600, 0, 0.9), (4, 60, 180, 1, 0.1),
    ]
    df = spark.createDataFrame(
        [(j, 0, e * 1_000_000, f * 1_000_000, y, s) for j, e, f, y, s in rows],
        "job_id long, task_index long, window_end long, fail_time long, label_fail_soon int, score double",
    )
    alerts = first_alerts(df, 0.5).cache()
    got = {r["job_id"]: r["lead_time_min"] for r in alerts.collect()}
    assert got == {1: 9.0, 2: None, 4: None}
    row = lead_time_summary(alerts).first()
    assert (row["n_failures"], row["n_detected"], row["median_min"]) == (3, 1, 9.0)


def test_drift(spark):
    rows = [(t, int(t % 2), float((t % 2) if t >= 20 else 1 - t % 2)) for t in range(31)]
    df = spark.createDataFrame(rows, "window_end long, label_fail_soon int, score double")
    bins = drift_by_bin(df, 0.5).orderBy("bin").collect()
    assert sum(r["n_test"] for r in bins) == 31 and [r["n_test"] for r in bins] == [10, 10, 11]
    verdict = drift_verdict(drift_by_bin(df, 0.5)).first()
    assert verdict["roc_auc_drift"] == 1.0 and verdict["verdict"] == "improves over time"


def test_registry(spark):
    def result(model, f1):
        return spark.createDataFrame(
            [(model, 0.1, 0.2, f1, 0.5, 0.6, 0.35)],
            "model string, precision double, recall double, f1 double, roc_auc double, pr_auc double, threshold double",
        )

    registry = save_result(save_result(result("boosted_trees", 0.1), result("logreg_baseline", 0.3)), result("boosted_trees", 0.2))
    table = compare_models(registry).orderBy("position").collect()
    assert [r["missing"] for r in table] == [True, False, False, True, True]
    assert [r["f1"] for r in table][1:3] == [0.3, 0.2]


def test_a_row_without_score_raises_everywhere(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, None), (0, None)], "y int, s double")
    for run in (
        lambda: evaluate(df, "y", "s", 0.5), lambda: threshold_sweep(df, "y", "s"),
        lambda: confusion(df, "y", F.col("s") >= 0.5),
    ):
        with pytest.raises(Exception, match="no score"):
            run().collect()


def test_rows_without_time_are_a_group_of_their_own(spark):
    df = spark.createDataFrame([(1, 0.9, 0), (0, 0.1, 100), (1, 0.8, None), (0, 0.2, None)], "y int, score double, window_end long")
    got = {r["bin"]: r["n_test"] for r in drift_by_bin(df, 0.5, 2, label="y").collect()}
    assert got == {1: 1, 2: 1, None: 2}
