"""Evaluation of binary predictions, as aggregations over one fact table.

A prediction table has y_true, y_pred (0 or 1), y_score (any real number) and whatever columns it is grouped
by.  Model, split and slice are columns, never loops.  Rows with a null among the columns that a metric reads
take no part in that metric.  A ratio with denominator 0 is 0; an area needs both classes and is null otherwise.

Scores are first counted by distinct value within a group, with map-side combining, so ties need no special care.
Cumulative counts are then taken in two steps: within each of PIECES ranges of a group's scores, and over the
sums of the ranges, so no group is sorted in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import exp, lgamma, log, log1p

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


from corpusloom.plans.durable import keep

#: Ranges of about equally many distinct scores into which a group is cut.
PIECES = 256
#: Groups whose ranges are broadcast, PIECES numbers for each.
FEW_GROUPS = 10_000


def same(a: Sequence[str], b: Sequence[str]) -> Column:
    """Whether columns are equal one by one, nulls among them."""
    out = F.lit(True)
    for x, y in zip(a, b):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def running(df: DataFrame, by: Sequence[str], x: str, sums: Sequence[str], pieces: int = PIECES) -> DataFrame:
    """Adds, for each column c of sums, c_below: its sum over rows of the group with smaller x, c_all: over the whole group; and x_next, the next greater x.

    (by, x) is unique and x not null.
    """
    names = [f"_g{k}" for k in range(len(by))]
    df = keep(df, "scores")
    cuts = F.percentile_approx(x, [k / pieces for k in range(1, pieces)], 10 * pieces)
    bounds = keep(df.groupBy(*by).agg(cuts.alias("_cuts")).select(*[F.col(c).alias(n) for c, n in zip(by, names)], "_cuts"), "ranges")
    few = bounds.limit(FEW_GROUPS + 1).count() <= FEW_GROUPS
    rows = df.join(F.broadcast(bounds) if few else bounds, same(by, names)).drop(*names)
    rows = rows.withColumn("_piece", F.size(F.filter("_cuts", lambda c: c < F.col(x)))).drop("_cuts")
    parts = rows.groupBy(*by, "_piece").agg(F.min(x).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums])
    w = Window.partitionBy(*by)
    before = w.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(c).alias(n) for c, n in zip(by, names)], F.col("_piece").alias("_p"), F.lead("_first").over(w.orderBy("_piece")).alias("_after"),
        *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}_before") for c in sums], *[F.sum(f"_{c}").over(w).alias(f"{c}_all") for c in sums],
    )
    rows = rows.join(parts, same([*by, "_piece"], [*names, "_p"]))
    inner = Window.partitionBy(*by, "_piece").orderBy(x)
    out = rows
    for c in sums:
        out = out.withColumn(f"{c}_below", F.col(f"_{c}_before") + F.coalesce(F.sum(c).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = out.withColumn("x_next", F.coalesce(F.lead(x).over(inner), "_after"))
    return out.select(*df.columns, *[f"{c}_below" for c in sums], *[f"{c}_all" for c in sums], "x_next")


def ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def latest(predictions: DataFrame, key: Sequence[str] = ("model_id", "id")) -> DataFrame:
    """One row per key: the last scored, then that of the greatest score; repeated rows fall together.

    A greatest-struct aggregation, so no group is sorted.
    """
    rest = [c for c in predictions.columns if c not in key and c not in ("scored_at", "y_score")]
    best = F.max(F.struct("scored_at", "y_score", *rest)).alias("b")
    return predictions.groupBy(*key).agg(best).select(*key, "b.*").select(*predictions.columns)


def counts() -> list[Column]:
    """Cells of the confusion matrix, as aggregates."""
    t, p = F.col("y_true"), F.col("y_pred")
    cell = lambda c, n: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long").alias(n)
    return [cell((t == 1) & (p == 1), "tp"), cell((t == 0) & (p == 1), "fp"), cell((t == 1) & (p == 0), "fn"), cell((t == 0) & (p == 0), "tn")]


def metric_columns() -> dict[str, Column]:
    """The nine classification metrics, from tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    f1_hate, f1_not = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fn + fp)
    return {
        "n": F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"),
        "n_hate": F.col("tp") + F.col("fn"),
        "macro_f1": (f1_hate + f1_not) / 2,
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "precision_hate": ratio(tp, tp + fp),
        "recall_hate": ratio(tp, tp + fn),
        "f1_hate": f1_hate,
        "precision_nothate": ratio(tn, tn + fn),
        "recall_nothate": ratio(tn, tn + fp),
    }


def classification(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, tp, fp, fn, tn, nine metrics) of each group."""
    cells = df.where("y_true is not null and y_pred is not null").groupBy(*by).agg(*counts())
    return cells.select(*by, "tp", "fp", "fn", "tn", *[c.alias(n) for n, c in metric_columns().items()])


def _by_score(df: DataFrame, by: Sequence[str]) -> DataFrame:
    some = df.where("y_true is not null and y_score is not null")
    return some.groupBy(*by, "y_score").agg(F.sum("y_true").cast("double").alias("pos"), F.sum(1 - F.col("y_true")).cast("double").alias("neg"))


def areas(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, roc_auc, pr_auc): the area under the ROC curve, ties counting half, and average precision (step sum)."""
    s = running(_by_score(df, by), by, "y_score", ["pos", "neg"])
    tp, fp = F.col("pos_all") - F.col("pos_below"), F.col("neg_all") - F.col("neg_below")
    out = s.groupBy(*by).agg(
        F.max("pos_all").alias("p"), F.max("neg_all").alias("q"), F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"), F.sum(F.col("pos") * tp / (tp + fp)).alias("a")
    )
    both = (F.col("p") > 0) & (F.col("q") > 0)
    return out.select(*by, F.when(both, F.col("u") / (F.col("p") * F.col("q"))).alias("roc_auc"), F.when(both, F.col("a") / F.col("p")).alias("pr_auc"))


def quantiles(df: DataFrame, by: Sequence[str], probs: Sequence[float], col: str = "y_score") -> DataFrame:
    """(by, q, value): quantiles with linear interpolation.

    From counts of distinct values: the two order statistics around each rank are found by a cumulative count, so
    no group is collected.
    """
    s = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    s = running(s, by, "v", ["k"])
    q = s.withColumn("q", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    to = F.col("k_below") + F.col("k")
    q = q.withColumn("r", F.col("q") * (F.col("k_all") - 1)).where((F.floor("r") >= F.col("k_below")) & (F.floor("r") < to))
    after = F.when(F.floor("r") + 1 < to, F.col("v")).otherwise(F.coalesce("x_next", "v"))
    return q.select(*by, "q", (F.col("v") + (F.col("r") - F.floor("r")) * (after - F.col("v"))).alias("value"))


def threshold_scan(df: DataFrame, by: Sequence[str], cuts: DataFrame) -> DataFrame:
    """(by, cut, macro_f1) for each cut: predict 1 where y_score >= cut.  cuts: by, cut.

    Scores and cuts are merged in one pass of cumulative counts instead of one scan per cut.
    """
    s = _by_score(df, by).select(*by, F.col("y_score").alias("x"), "pos", "neg", F.lit(0).alias("is_cut"))
    c = cuts.where("cut is not null").select(*by, F.col("cut").alias("x"), F.lit(0.0).alias("pos"), F.lit(0.0).alias("neg"), F.lit(1).alias("is_cut"))
    both = s.unionByName(c).groupBy(*by, "x").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.max("is_cut").alias("is_cut"))
    both = running(both, by, "x", ["pos", "neg"]).where("is_cut = 1 and pos_all + neg_all > 0")
    fn, tn = F.col("pos_below"), F.col("neg_below")
    tp, fp = F.col("pos_all") - fn, F.col("neg_all") - tn
    f1 = (ratio(2 * tp, 2 * tp + fp + fn) + ratio(2 * tn, 2 * tn + fn + fp)) / 2
    return both.select(*by, F.col("x").alias("cut"), f1.alias("macro_f1"))


def best_threshold(df: DataFrame, by: Sequence[str], probs: Sequence[float] | None = None, grid: Sequence[float] | None = None) -> DataFrame:
    """(by, threshold, macro_f1): the cut with the best macro-F1, the smallest among equals.

    Cuts are the score quantiles at probs (by default 0.02 to 0.98 in steps of 0.01), or a fixed grid.
    """
    if grid is not None:
        cuts = df.select(*by).distinct().withColumn("cut", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    else:
        cuts = quantiles(df, by, probs or [round(0.02 + 0.01 * k, 2) for k in range(97)]).select(*by, F.round("value", 9).alias("cut"))
    scan = threshold_scan(df, by, cuts).withColumn("macro_f1", F.round("macro_f1", 9))
    best = scan.groupBy(*by).agg(F.max(F.struct("macro_f1", (-F.col("cut")).alias("less"))).alias("b"))
    return best.select(*by, (-F.col("b.less")).alias("threshold"), F.col("b.macro_f1").alias("macro_f1"))


def scaled(df: DataFrame, by: Sequence[str], col: str = "y_score") -> DataFrame:
    """Adds p: the score scaled to 0..1 over its group; 0.5 where all scores are equal.  Rows without a score are left out."""
    some = df.where(F.col(col).isNotNull())
    if not by:
        lo, hi = some.agg(F.min(col), F.max(col)).first()
        some = some.withColumn("_lo", F.lit(lo).cast("double")).withColumn("_hi", F.lit(hi).cast("double"))
    else:
        names = [f"_g{k}" for k in range(len(by))]
        ends = some.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi")).select(*[F.col(c).alias(n) for c, n in zip(by, names)], "_lo", "_hi")
        some = some.join(ends, same(by, names)).drop(*names)
    return some.withColumn("p", F.when(F.col("_hi") > F.col("_lo"), (F.col(col) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.5)).drop("_lo", "_hi")


def calibration_bins(df: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(by, bin, n, confidence, accuracy) of all bins, empty ones with nulls."""
    p = scaled(df.where("y_true is not null"), by)
    # bin = number of inner edges at or below p
    edges = F.array(*[F.lit(k / n_bins) for k in range(1, n_bins)])
    p = p.withColumn("bin", F.size(F.filter(edges, lambda e: e <= F.col("p"))))
    got = p.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("confidence"), F.avg("y_true").alias("accuracy"))
    all_bins = got.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))))
    return all_bins.join(got, [*by, "bin"], "left").select(*by, "bin", F.coalesce("n", F.lit(0)).alias("n"), "confidence", "accuracy")


def calibration(df: DataFrame, by: Sequence[str], n_bins: int = 10) -> DataFrame:
    """(by, ece, mce, brier); the Brier score is that of the scaled scores."""
    bins = calibration_bins(df, by, n_bins).where("n > 0").withColumn("gap", F.abs(F.col("confidence") - F.col("accuracy")))
    e = bins.groupBy(*by).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    b = scaled(df.where("y_true is not null"), by).groupBy(*by).agg(F.avg((F.col("p") - F.col("y_true")) * (F.col("p") - F.col("y_true"))).alias("brier"))
    return e.join(b, list(by))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    out, m = d, 1
    while True:
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            return front * out
        m += 1


def two_sided_p(b: int, c: int) -> float:
    """Exact two-sided binomial p at one half of b against c discordant pairs; 1 if there are none."""
    n, k = b + c, min(b, c)
    return 1.0 if b == c else min(1.0, 2 * incomplete_beta(n - k, k + 1, 0.5))


def binomial_p(b: Column, c: Column) -> Column:
    """two_sided_p as a column; for tables of a few rows, such as pairs of models.  Counts of any size cost about their root."""

    def one(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(int(i), int(j)) for i, j in zip(x, y)], dtype=float)

    return F.pandas_udf(one, "double")(b.cast("long"), c.cast("long"))


def mcnemar(df: DataFrame, within: Sequence[str] = ("split",)) -> DataFrame:
    """(within, model_a, model_b, a_only_correct, b_only_correct, p_value) of all pairs of models.

    One row per example with the models' outcomes beside each other, then pairs within the row: the join of each
    model with each other is never made.  Models are few; their number bounds the array.
    """
    ok = df.where("y_true is not null and y_pred is not null").select(*within, "id", "model_id", (F.col("y_true") == F.col("y_pred")).alias("ok"))
    rows = ok.groupBy(*within, "id").agg(F.sort_array(F.collect_list(F.struct("model_id", "ok"))).alias("m"))
    a = rows.select(*within, "m", F.posexplode("m").alias("i", "a"))
    pairs = a.select(*within, "a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("b")).where("a.model_id < b.model_id")
    out = pairs.groupBy(*within, F.col("a.model_id").alias("model_a"), F.col("b.model_id").alias("model_b")).agg(
        F.sum(F.when(F.expr("a.ok and not b.ok"), 1).otherwise(0)).alias("a_only_correct"), F.sum(F.when(F.expr("b.ok and not a.ok"), 1).otherwise(0)).alias("b_only_correct")
    )
    return out.withColumn("p_value", binomial_p(F.col("a_only_correct"), F.col("b_only_correct")))


def holm(df: DataFrame, within: Sequence[str], p: str = "p_value", alpha: float = 0.05, order: Sequence[str] = ("model_a", "model_b")) -> DataFrame:
    """Adds significant_holm: step-down rejection at alpha within each family of tests."""
    w = Window.partitionBy(*within)
    ranked = w.orderBy(p, *order)
    ok = (F.col(p) <= F.lit(alpha) / (F.count(F.lit(1)).over(w) - F.row_number().over(ranked) + 1)).cast("int")
    return df.withColumn("_ok", ok).withColumn("significant_holm", F.min("_ok").over(ranked.rowsBetween(Window.unboundedPreceding, 0)) == 1).drop("_ok")


def bootstrap(df: DataFrame, by: Sequence[str], resamples: int = 1000, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """(by, macro_f1_low, macro_f1_high): percentile interval of macro-F1.

    Macro-F1 depends on the four cells alone, so a resample of n rows is one multinomial draw of the cells.
    """
    cells = df.where("y_true is not null and y_pred is not null").groupBy(*by).agg(*counts())
    names = [*by, "macro_f1_low", "macro_f1_high"]

    def one(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for r in pdf.itertuples(index=False):
                c = np.array([r.tp, r.fp, r.fn, r.tn], float)
                if not c.sum():
                    rows.append((None, None))
                    continue
                d = np.random.default_rng(seed).multinomial(int(c.sum()), c / c.sum(), resamples).astype(float)
                f = lambda hit, x, y: np.divide(2 * hit, 2 * hit + x + y, out=np.zeros(len(hit)), where=2 * hit + x + y > 0)
                f1 = (f(d[:, 0], d[:, 1], d[:, 2]) + f(d[:, 3], d[:, 1], d[:, 2])) / 2
                rows.append(tuple(np.percentile(f1, [100 * alpha / 2, 100 * (1 - alpha / 2)])))
            out = pdf[list(by)].copy()
            out["macro_f1_low"], out["macro_f1_high"] = [x[0] for x in rows], [x[1] for x in rows]
            yield out[names]

    kinds = ", ".join(f"{c} {cells.schema[c].dataType.simpleString()}" for c in by)
    return cells.mapInPandas(one, f"{kinds}, macro_f1_low double, macro_f1_high double")


def class_weights(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """(by, label, n, weight): balanced class weights, rows over classes times the class's rows."""
    n = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return n.withColumn("weight", F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
