import math
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import analysis as A
from corpusloom.operators import evaluate as E

SCHEMA = "model_id string, split string, id string, language string, source_dataset string, y_true int, y_pred int, y_score double"


def scored(spark, n=600, seed=1, null_group=True):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        y = int(r.random() < 0.3)
        s = round(min(1.0, max(0.0, r.gauss(0.35 + 0.3 * y, 0.2))), 2)  # many ties
        rows.append((r.choice(["a", "b", None] if null_group else ["a", "b"]), "test", f"i{k}", r.choice(["en", "pt"]), "s", y, int(s >= 0.5), s))
    rows += [("a", "test", "n1", "en", "s", None, 1, 0.3), ("a", "test", "n2", "en", "s", 1, None, 0.3), ("a", "test", "n3", "en", "s", 1, 1, None)]
    return rows, spark.createDataFrame(rows, SCHEMA)


def group(rows, m):
    return [(r[5], r[7]) for r in rows if r[0] == m and r[5] is not None and r[7] is not None]


def auc(pairs):
    pos, neg = [s for y, s in pairs if y], [s for y, s in pairs if not y]
    return sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))


def average_precision(pairs):
    pos = sum(y for y, _ in pairs)
    return sum(sum(y for y, s in pairs if s == t) * sum(y for y, s in pairs if s >= t) / sum(s >= t for _, s in pairs) for t in {s for _, s in pairs}) / pos


def macro_f1(pairs, cut):
    tp = sum(y and s >= cut for y, s in pairs)
    fp = sum(not y and s >= cut for y, s in pairs)
    fn = sum(y and s < cut for y, s in pairs)
    tn = len(pairs) - tp - fp - fn
    f = lambda h, x, y: 2 * h / (2 * h + x + y) if 2 * h + x + y else 0.0
    return (f(tp, fp, fn) + f(tn, fp, fn)) / 2


@pytest.mark.parametrize("pieces", [1, 4, 256])
def test_running_sums_do_not_depend_on_ranges(spark, pieces):
    rows, df = scored(spark)
    s = df.where("y_score is not null").groupBy("model_id", "y_score").agg(F.count(F.lit(1)).cast("double").alias("k"))
    for r in E.running(s, ["model_id"], "y_score", ["k"], pieces).collect():
        mine = [x[7] for x in rows if x[0] == r.model_id and x[7] is not None]
        assert r.k_below == sum(v < r.y_score for v in mine) and r.k_all == len(mine)
        assert r.x_next == min((v for v in mine if v > r.y_score), default=None)


def test_areas_quantiles_and_thresholds_against_brute_force(spark):
    rows, df = scored(spark)
    got = {r.model_id: r for r in E.areas(df, ["model_id"]).collect()}
    assert got.keys() == {"a", "b", None}
    for m, r in got.items():
        assert r.roc_auc == pytest.approx(auc(group(rows, m))) and r.pr_auc == pytest.approx(average_precision(group(rows, m)))
    probs = [0.0, 0.1, 0.5, 0.975, 1.0]
    for r in E.quantiles(df, ["model_id"], probs).collect():
        v = sorted(x[7] for x in rows if x[0] == r.model_id and x[7] is not None)
        at = r.q * (len(v) - 1)
        lo = math.floor(at)
        assert r.value == pytest.approx(v[lo] + (at - lo) * (v[min(lo + 1, len(v) - 1)] - v[lo]))
    grid = [0.1, 0.3, 0.45, 0.5, 0.7]
    for r in E.best_threshold(df, ["model_id"], grid=grid).collect():
        best = max(grid, key=lambda c: (round(macro_f1(group(rows, r.model_id), c), 9), -c))
        assert r.threshold == best and r.macro_f1 == pytest.approx(macro_f1(group(rows, r.model_id), best))


def test_separating_cut(spark):
    df = spark.createDataFrame([("a", "test", str(k), "en", "s", int(k >= 5), 0, k / 10) for k in range(8)], SCHEMA)
    r = E.best_threshold(df, ["model_id"], grid=[0.2, 0.45, 0.6]).first()
    assert (r.threshold, r.macro_f1) == (0.45, 1.0)
    assert E.areas(df, ["model_id"]).first().roc_auc == 1.0


def test_one_class_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "test", "1", "en", "s", 1, 1, 0.5)], SCHEMA)
    assert E.areas(df, ["model_id"]).first().roc_auc is None
    none = df.limit(0)
    assert E.areas(none, ["model_id"]).count() == E.quantiles(none, ["model_id"], [0.5]).count() == E.best_threshold(none, ["model_id"]).count() == E.calibration(none, ["model_id"]).count() == 0


def test_exact_binomial_p():
    exact = lambda b, c: min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b != c else 1.0
    for b, c in ((0, 0), (40, 0), (0, 1), (3, 9), (12, 12), (100, 140), (500, 420), (1, 2)):
        assert E.two_sided_p(b, c) == pytest.approx(exact(b, c), rel=1e-9)
    assert 0 <= E.two_sided_p(3_000_000_000, 2_999_900_000) <= 1


def test_mcnemar_and_holm(spark):
    rows = [(m, "test", str(k), "en", "s", 1, int(m == "a" or k >= 40), 0.5) for k in range(100) for m in ("a", "b", "c")]
    got = {(r.model_a, r.model_b): r for r in E.holm(E.mcnemar(spark.createDataFrame(rows, SCHEMA)), ["split"]).collect()}
    assert (got["a", "b"].a_only_correct, got["a", "b"].b_only_correct) == (40, 0) and got["a", "b"].significant_holm
    assert got["b", "c"].p_value == 1.0 and not got["b", "c"].significant_holm
    p = spark.createDataFrame([("x", "a", "b", 0.001), ("x", "a", "c", 0.04), ("x", "b", "c", 0.5)], "split string, model_a string, model_b string, p_value double")
    assert {r.p_value: r.significant_holm for r in E.holm(p, ["split"]).collect()} == {0.001: True, 0.04: False, 0.5: False}


def test_calibration_of_uniform_and_unbounded_scores(spark):
    r = random.Random(3)
    rows = [("a", "test", str(k), "en", "s", int(r.random() < p), 0, p) for k in range(4000) for p in [r.random()]]
    assert E.calibration(spark.createDataFrame(rows, SCHEMA), ["model_id"]).first().ece < 0.05
    wild = spark.createDataFrame([("a", "test", str(k), "en", "s", k % 2, 0, s) for k, s in enumerate([-3.0, -1.0, 0.0, 2.0, 5.0, 5.0])], SCHEMA)
    p = [x.p for x in E.scaled(wild, ["model_id"]).collect()]
    assert min(p) == 0 and max(p) == 1 and len(E.scaled(wild, []).collect()) == 6
    assert E.calibration_bins(wild, ["model_id"]).count() == 10


def test_bootstrap_holds_the_value(spark):
    rows, df = scored(spark, null_group=False)
    f1 = {r.model_id: r.macro_f1 for r in E.classification(df, ["model_id"]).collect()}
    for r in E.bootstrap(df, ["model_id"]).collect():
        assert r.macro_f1_low < f1[r.model_id] < r.macro_f1_high < r.macro_f1_low + 0.2


def test_latest_score_wins(spark):
    rows = [("a", "1", 0.1, 1), ("a", "1", 0.9, 2), ("a", "1", 0.9, 2), ("a", "2", None, 1)]
    df = spark.createDataFrame(rows, "model_id string, id string, y_score double, scored_at int")
    assert {(r.id, r.y_score) for r in E.latest(df).collect()} == {("1", 0.9), ("2", None)}


def test_pareto_front_of_six_axes(spark):
    rows = [("A", 0.8, 0.7, 0.05, 0.02, 1.5, 4.0), ("B", 0.75, 0.8, 0.04, 0.03, 3.0, 5.0), ("C", 0.7, 0.6, 0.06, 0.05, 4.0, 6.0), ("D", 0.9, None, 0.1, 0.1, 1.0, 1.0), ("A2", 0.8, 0.7, 0.05, 0.02, 1.5, 4.0)]
    df = spark.createDataFrame(rows, "model_id string, f1 double, recall double, ece double, bias double, p95 double, mb double").repartition(3)
    assert {r.model_id for r in A.pareto_front(df, ["f1", "recall"], ["ece", "bias", "p95", "mb"]).collect()} == {"A", "B", "A2"}
    assert A.pareto_front(df.limit(0), ["f1"], ["ece"]).count() == 0


def test_bias_probe_finds_whole_words_of_the_language(spark):
    preds = spark.createDataFrame([("m", "test", str(k), lang, "s", 0, p, 0.4) for k, (lang, p) in enumerate([("en", 1), ("en", 0), ("pt", 1), ("en", 0)])], SCHEMA)
    text = spark.createDataFrame([("0", "Women!"), ("1", "womenfolk"), ("2", "as mulheres"), ("3", None)], "id string, text_clean string")
    rows = A.bias_probe(preds, text).collect()
    assert [(r.group, r.n_nonhate_mentions, r.group_fpr, r.background_fpr, r.fpr_gap) for r in rows] == [("gender", 2, 1.0, 0.5, 0.5)]


def test_language_thresholds_are_fitted_on_val(spark):
    rows = [("m", s, f"{s}{lang}{k}", lang, "x", int(k >= (5 if lang == "en" else 2)), 0, k / 10) for s in ("val", "test") for lang in ("en", "pt") for k in range(10)] + [("m", "test", "z", None, "x", 1, 1, 0.5)]
    got = {r.language: r for r in A.thresholds_by_language(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([("m", 0.5)], "model_id string, threshold double")).collect()}
    assert got["en"].gain == 0 and got["pt"].gain > 0 and got["pt"].macro_f1_language == 1.0 and got["pt"].recall_hate_whole < 1


def test_review_sample_and_latency(spark):
    s = spark.createDataFrame([(f"i{k}", "p" if k < 50 else "q", int(k % 25 == 0), None) for k in range(80)], "id string, page string, a int, b int")
    rows = A.flagged_and_sample(s, ["a", "b"], "page").collect()
    assert sum(r.part == "flagged" for r in rows) == 4 and sum(r.part != "flagged" and r.page == "p" for r in rows) == 30 and len({r.id for r in rows}) == len(rows)
    low, high = A.latency(len, ["x", "y"])
    assert 0 <= low <= high
