"""Estimators, calibration, stacking and the training of a model from a configuration."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace
from itertools import islice, product
from random import Random

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LinearSVC, LinearSVCModel, LogisticRegression, LogisticRegressionModel
from pyspark.ml.common import _py2java
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.ml.util import Identifiable
from pyspark.ml.regression import IsotonicRegression
from pyspark.mllib.linalg import Vectors as OldVectors
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from corpusloom.functions import text as T
from corpusloom.operators import evaluate as E
from corpusloom.operators import features as X
from corpusloom.operators import linear as N
from corpusloom.operators import terms as R
from corpusloom.operators.splits import stratified_folds
from corpusloom.plans.durable import discard, keep


@dataclass(frozen=True)
class Config:
    """What to train.  kind: logreg, svm or gbt."""

    kind: str = "logreg"
    c: float = 1.0
    l1: float = 0.0
    balanced: bool = True
    max_iter: int = 1000
    tol: float = 1e-4
    word_features: int = 150_000
    char_features: int = 150_000
    char_ngrams: tuple[int, int] = (3, 5)
    min_df: int = 3
    calibration_folds: int = 3
    lowercase: bool = True
    strip_accents: bool = False
    stop_words: str | None = None
    sublinear: bool = True
    binary: bool = False
    #: light or heavy: clean the text first.
    clean: str | None = None
    #: Rows (lemma, category, level) of a lexicon; its 36 columns are a third block, not weighted.
    lexicon: tuple = ()
    depth: int = 4
    params: dict = field(default_factory=dict)


def spread(df: DataFrame) -> DataFrame:
    """df in four partitions for each core, if it has fewer; a small file is one partition, and its terms are much work."""
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def featurize(df: DataFrame, cfg: Config, text: str = "text_clean") -> DataFrame:
    """Adds the tokens of both blocks as text: _w, words between blanks, and _c, what stands between white space, each with a blank of its own on either side."""
    t = F.coalesce(F.col(text), F.lit(""))
    if cfg.clean:
        t = T.clean(t, {"light": T.LIGHT, "heavy": T.HEAVY}[cfg.clean])
    t = T.strip_accents(t) if cfg.strip_accents else t
    df, t = df.withColumn("_t", t), F.col("_t")
    words = T.word_tokens(t)
    stops = T.stop_words(cfg.stop_words)
    if stops:
        words = F.filter(words, lambda w: ~w.isin(*stops))
    spaced = T.tokens(F.lower(t) if cfg.lowercase else t)
    padded = F.when(F.size(spaced) > 0, F.concat(F.lit(" "), F.array_join(spaced, "  "), F.lit(" "))).otherwise(F.lit(""))
    out = df.withColumn("_w", F.array_join(words, " ")).withColumn("_c", padded)
    if cfg.lexicon:
        block = X.with_lexicon(out.withColumn("_tok", T.letter_tokens(t)), "_tok", cfg.lexicon)
        names = [c for c in block.columns if c not in out.columns and c != "_tok"]
        return block.withColumn("_l", F.array(*names)).drop("_t", "_tok", *names)
    return out.withColumn("_l", F.array().cast("array<double>")).drop("_t")


class Terms:
    """A block's terms, the most frequent first: their codes, and as text, which is looked up when it is first asked for."""

    def __init__(self, codes: np.ndarray, spell: Callable[[], list[str]]) -> None:
        self.codes, self._spell, self._text = codes, spell, None

    @property
    def vocabulary(self) -> list[str]:
        if self._text is None:
            self._text = self._spell()
        return self._text


@dataclass
class Features:
    """The vocabulary and the smoothed idf (1 added) of both blocks, and how terms are made and weighted."""

    vocabularies: list[Terms]
    idf: list[np.ndarray]
    sublinear: bool = True
    lexicon_columns: int = 0
    char_ngrams: tuple[int, int] = (3, 5)
    binary: bool = False

    def design(self) -> N.Design:
        return N.Design([R.Vocabulary.of(v.codes) for v in self.vocabularies], np.concatenate(self.idf), self.char_ngrams, self.sublinear, self.binary, self.lexicon_columns)


def fit_features(train: DataFrame, cfg: Config = Config(), later: DataFrame | None = None) -> Features:
    """From the training rows alone: terms of min_df rows or more, the most frequent first, and their weights.

    later: the same rows, for the terms' text, if train is a table that is deleted before it may be asked for.
    """
    table, n = N.frequencies(train, cfg.char_ngrams, cfg.min_df)
    codes, counts = zip(*[N.most_frequent(table, b, size) for b, size in enumerate((cfg.word_features, cfg.char_features))])
    discard(table)
    spelled: list[list[str]] = []

    def spell(b: int) -> list[str]:
        if not spelled:
            spelled.extend(N.spellings(train if later is None else later, [R.Vocabulary.of(c) for c in codes], cfg.char_ngrams))
        return spelled[b]

    vocabularies = [Terms(c, lambda b=b: spell(b)) for b, c in enumerate(codes)]
    return Features(vocabularies, [np.log((n + 1) / (df + 1)) + 1.0 for df in counts], cfg.sublinear, len(X.CATEGORIES) * len(X.LEVELS) + 2 if cfg.lexicon else 0, tuple(cfg.char_ngrams), cfg.binary)


def apply_features(df: DataFrame, fitted: Features) -> DataFrame:
    """Adds features: in each block (1 + ln tf) * idf, or tf * idf, brought to length 1; then the lexicon's columns as they are."""
    design = fitted.design()
    shared = df.sparkSession.sparkContext.broadcast(design)

    def with_features(rows):
        d = shared.value
        while some := list(islice(rows, R.CHUNK_ROWS // 8)):
            *_, words, chars, lex = zip(*some)
            for s in R.chunks(words, chars):
                e = d.encode(words[s], chars[s])
                x = N.weigh(e.tf, d.sublinear) * d.idf[e.at] * np.repeat(N.norms(e, d.idf, d.sublinear), np.diff(e.starts))
                for k, row in enumerate(some[s]):
                    own = slice(e.starts[2 * k], e.starts[2 * k + 2])
                    there = np.flatnonzero(row[-1])
                    yield (*row[:-3], SparseVector(len(d), np.concatenate([e.at[own], there + len(d.idf)]), np.concatenate([x[own], np.array(row[-1], float)[there]])))

    # A pass over rows: as a column, the optimizer would merge the function into expressions that cannot run it.
    kept = df.drop("_w", "_c", "_l")
    rows = df.select(*kept.columns, "_w", "_c", "_l").rdd.mapPartitions(with_features)
    return df.sparkSession.createDataFrame(rows, StructType([*kept.schema.fields, StructField("features", VectorUDT())]), verifySchema=False)


def estimator(cfg: Config, total_weight: float = 1.0):
    """total_weight: of all training rows; C weighs the sum of their losses, regParam their mean."""
    common = {"featuresCol": "features", "labelCol": "label", **({} if cfg.kind == "gbt" else {"tol": cfg.tol})}
    if cfg.kind == "logreg":
        return LogisticRegression(**common, maxIter=cfg.max_iter, regParam=cfg.params.get("reg", 1 / (cfg.c * total_weight)), elasticNetParam=cfg.l1, standardization=False, weightCol="weight")
    if cfg.kind == "svm":
        return LinearSVC(**common, maxIter=cfg.max_iter, regParam=cfg.params.get("reg", 1 / (cfg.c * total_weight)), standardization=False, weightCol="weight")
    if cfg.kind == "gbt":
        return GBTClassifier(**common, maxIter=cfg.max_iter, maxDepth=cfg.depth, weightCol="weight", seed=7)
    raise ValueError(f"no estimator {cfg.kind!r}; there are logreg, svm, gbt")


def weighted(df: DataFrame, balanced: bool = True) -> DataFrame:
    if not balanced:
        return df.withColumn("weight", F.lit(1.0))
    w = {r["label"]: r["weight"] for r in E.class_weights(df).collect()}  # two rows
    return df.withColumn("weight", F.when(F.col("label") == 1, F.lit(float(w.get(1, 1.0)))).otherwise(F.lit(float(w.get(0, 1.0)))))


def score_column(model: Model) -> Column:
    """Probability of the positive class, or the decision value where there is no probability."""
    return vector_to_array("probability")[1] if "probability" in [p.name for p in model.params] or hasattr(model, "probabilityCol") and model.hasParam("probabilityCol") else vector_to_array("rawPrediction")[1]


@dataclass
class Trained:
    cfg: Config
    features: Features
    #: Models and, where they are calibrated, the (a, b) of each one's sigmoid; the score is the mean of theirs.
    members: list[tuple[Model, tuple[float, float] | None]]
    threshold: float

    def score(self, df: DataFrame) -> DataFrame:
        rows = featurize(spread(df), self.cfg)
        if self.cfg.kind != "gbt":
            weights = [np.append(m.coefficients.toArray(), m.intercept) for m, _ in self.members]
            sigmoids = [ab or (1.0, 0.0) for _, ab in self.members]
            return N.score(rows, self.features.design(), weights, lambda z: np.mean([N.sigmoid(a * x + b) for x, (a, b) in zip(z, sigmoids)], axis=0))
        model = self.members[0][0]
        out = model.transform(apply_features(rows, self.features))
        return out.withColumn("y_score", score_column(model)).drop("features", "rawPrediction", "probability", "prediction")

    def predict(self, df: DataFrame) -> DataFrame:
        return self.score(df).withColumn("y_pred", (F.col("y_score") >= self.threshold).cast("int"))


def train(train_rows: DataFrame, val_rows: DataFrame, cfg: Config = Config()) -> Trained:
    """Fit on train only; choose the threshold on val (on train if val has fewer than 20 rows).

    An svm is one model for each calibration fold, fitted on the other folds, with a sigmoid fitted on its own.
    """
    source = weighted(train_rows.where("label is not null"), cfg.balanced)
    svm = cfg.kind == "svm"
    texts = featurize(spread(source), cfg)
    # Folds move the rows, which spreads them.  Tokens are made once for counting and encoding.
    folds = featurize(stratified_folds(source.select("id", "text_clean", "label", "weight"), k=cfg.calibration_folds), cfg) if svm else texts.withColumn("fold", F.lit(0))
    rows = keep(folds.select("_w", "_c", "_l", "label", "weight", "fold"), "tokens")
    fitted = fit_features(rows, cfg, texts)
    if cfg.kind == "gbt" or cfg.l1:
        ready = apply_features(rows, fitted).select("features", "label", "weight").persist()
        try:
            members = [(estimator(cfg, float(ready.agg(F.sum("weight")).first()[0] or 1.0)).fit(ready), None)]
        finally:
            ready.unpersist()
    else:
        design = fitted.design()
        table = N.blocks(rows, design)
        weights = N.fit(table, design, cfg.kind, list(range(cfg.calibration_folds)) if svm else [None], cfg.c, cfg.params.get("reg"), cfg.tol, cfg.max_iter)
        sigmoids: list[tuple[float, float] | None] = [None]
        if svm:
            own = N.margins(table, design, weights)
            with ThreadPoolExecutor(cfg.calibration_folds) as side_by_side:
                sigmoids = list(side_by_side.map(lambda f: platt(own.where(f"fold = {f}")), range(cfg.calibration_folds)))
            discard(own)
        discard(table)
        members = [(linear_model(cfg.kind, w), ab) for w, ab in zip(weights, sigmoids)]
    discard(rows)
    out = Trained(cfg, fitted, members, 0.5)
    val = val_rows.where("label is not null")
    val = train_rows.where("label is not null") if val.limit(20).count() < 20 else val
    scored = keep(out.score(val).select("y_score", F.col("label").alias("y_true"), F.lit(1).alias("one")), "scores")
    best = E.best_threshold(scored, ["one"]).collect()
    discard(scored)
    if best:
        out.threshold = best[0]["threshold"]
    return out


def linear_model(kind: str, w: np.ndarray) -> Model:
    """Spark's model of these coefficients, the intercept last."""
    sc, kind = SparkSession.active().sparkContext, {"logreg": LogisticRegressionModel, "svm": LinearSVCModel}[kind]
    made = getattr(sc._jvm.org.apache.spark.ml.classification, kind.__name__)(Identifiable()._randomUID(), _py2java(sc, DenseVector(w[:-1])), float(w[-1]))
    return kind(made)


def evaluate(model: Trained, df: DataFrame, by: Sequence[str] = ("split",)) -> DataFrame:
    rows = keep(model.predict(df.where("label is not null")).withColumn("y_true", F.col("label")).select(*by, "y_true", "y_pred", "y_score"), "predictions")  # read several times
    return E.classification(rows, by).join(E.areas(rows, by), list(by))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def platt(df: DataFrame, score: str = "y_score", label: str = "y_true") -> tuple[float, float]:
    """(a, b) of sigmoid(a * score + b), fitted on rows with both values."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("x"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(regParam=0.0, maxIter=100).fit(VectorAssembler(inputCols=["x"], outputCol="features").transform(rows))
    return float(m.coefficients[0]), float(m.intercept)


def isotonic(df: DataFrame, score: str = "y_score", label: str = "y_true"):
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(F.col(score).alias("features"), F.col(label).cast("double").alias("label"))
    return IsotonicRegression().fit(rows)


def member_scores(predictions: DataFrame, members: Sequence[str], keys: Sequence[str] = ("split", "id", "y_true")) -> DataFrame:
    """One column of scores per member; rows that a member has not scored are left out."""
    wide = predictions.where(F.col("model_id").isin(*members)).groupBy(*keys).agg(*[F.max(F.when(F.col("model_id") == m, F.col("y_score"))).alias(m) for m in members])
    return wide.dropna(subset=list(members))


def stacked(df: DataFrame, weights: dict[str, float], bias: float, calibration: tuple[float, float] | None = None, threshold: float = 0.5) -> DataFrame:
    """Adds raw, prob and y_pred: sigmoid of the weighted scores, calibrated if wanted, then the threshold."""
    z = F.lit(float(bias))
    for m, w in weights.items():
        z = z + F.lit(float(w)) * F.col(m)
    raw = sigmoid(z)
    prob = sigmoid(F.lit(calibration[0]) * raw + F.lit(calibration[1])) if calibration else raw
    return df.withColumn("raw", raw).withColumn("prob", prob).withColumn("y_pred", (prob >= threshold).cast("int"))


def save(model: Trained, folder: str) -> None:
    """Vocabularies and members laid out as Spark writes them, all else in one document beside them; the folder may be on any file system."""
    spark = SparkSession.active()
    for k, v in enumerate(model.features.vocabularies):
        spark.createDataFrame([(v.vocabulary,)], "vocabulary array<string>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/vocabulary{k}/data")
    for k, (m, _) in enumerate(model.members):
        m.write().overwrite().save(f"{folder}/member{k}")
    doc = {
        "config": asdict(model.cfg), "threshold": model.threshold, "sigmoids": [list(ab) if ab else None for _, ab in model.members], "idf": [i.tolist() for i in model.features.idf],
        "sublinear": model.features.sublinear, "lexicon_columns": model.features.lexicon_columns,
    }
    spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/model")


def load(spark: SparkSession, folder: str) -> Trained:
    doc = json.loads(spark.read.text(f"{folder}/model", wholetext=True).first()[0])
    tuples = {k: tuple(map(tuple, v)) if k == "lexicon" else tuple(v) if isinstance(v, list) else v for k, v in doc["config"].items()}
    cfg = Config(**tuples)
    kind = {"logreg": LogisticRegressionModel, "svm": LinearSVCModel, "gbt": GBTClassificationModel}[cfg.kind]
    members = [(kind.load(f"{folder}/member{k}"), tuple(ab) if ab else None) for k, ab in enumerate(doc["sigmoids"])]
    texts = [spark.read.parquet(f"{folder}/vocabulary{k}/data").first()["vocabulary"] for k in range(len(doc["idf"]))]
    vocabularies = [Terms(R.codes_of(k, t, cfg.char_ngrams[1]), lambda t=t: t) for k, t in enumerate(texts)]
    fitted = Features(vocabularies, [np.array(i) for i in doc["idf"]], doc["sublinear"], doc["lexicon_columns"], tuple(cfg.char_ngrams), cfg.binary)
    return Trained(cfg, fitted, members, doc["threshold"])


def linear_document(model: Trained, golden: Sequence[tuple[str, float]] = ()) -> dict:
    """A linear model as plain values, for a scorer outside Spark: vocabulary, idf and coefficients of each block, intercept, threshold, and texts with their scores to check the scorer by."""
    if model.cfg.kind != "logreg" or len(model.members) != 1:
        raise ValueError("only a logistic regression is exported")
    fitted, at, blocks = model.members[0][0], 0, []
    w = fitted.coefficients.toArray()
    for name, v, idf in zip(("word", "char"), model.features.vocabularies, model.features.idf):
        blocks.append({"name": name, "vocabulary": list(v.vocabulary), "idf": idf.tolist(), "coefficients": w[at : at + len(idf)].tolist()})
        at += len(idf)
    return {"blocks": blocks, "lexicon": w[at:].tolist(), "sublinear": model.features.sublinear, "char_ngrams": list(model.cfg.char_ngrams), "intercept": float(fitted.intercept), "threshold": model.threshold, "golden": [[t, p] for t, p in golden]}


def fit_stack(val: DataFrame, members: Sequence[str]) -> tuple[dict[str, float], float]:
    """Weights and bias of a logistic regression over the members' scores, with C = 1."""
    n = val.count()
    rows = VectorAssembler(inputCols=list(members), outputCol="features").transform(val.withColumn("label", F.col("y_true").cast("double")))
    m = LogisticRegression(regParam=1 / max(n, 1), maxIter=1000, standardization=False).fit(rows)
    return dict(zip(members, map(float, m.coefficients))), float(m.intercept)


@dataclass(frozen=True)
class Stack:
    """A stack of members: weights, bias, sigmoid over the stacked score, threshold, and its area on the rows it was judged by."""

    weights: dict
    bias: float
    sigmoid: tuple[float, float]
    threshold: float
    roc_auc: float

    def score(self, wide: DataFrame) -> DataFrame:
        return stacked(wide, self.weights, self.bias, self.sigmoid, self.threshold)


#: Quantiles of the calibrated score among which a stack's threshold is chosen.
STACK_CUTS = tuple(round(0.30 + (0.995 - 0.30) * k / 199, 12) for k in range(200))
#: How much more area a larger stack must have to be worth its members.
MIN_GAIN = 0.005


def train_stack(predictions: DataFrame, members: Sequence[str], fit_on: str = "val", judge_by: str = "test") -> Stack:
    """Fit weights, sigmoid and threshold on one split; the area is that on the other."""
    val = member_scores(predictions.where(F.col("split") == fit_on), members)
    w, b = fit_stack(val, members)
    raw = stacked(val, w, b).select("y_true", F.col("raw").alias("y_score"))
    ab = platt(raw)
    prob = raw.withColumn("y_score", sigmoid(F.lit(ab[0]) * F.col("y_score") + F.lit(ab[1]))).withColumn("one", F.lit(1))
    cut = E.best_threshold(prob, ["one"], STACK_CUTS).collect()
    judged = stacked(member_scores(predictions.where(F.col("split") == judge_by), members), w, b, ab).select("y_true", F.col("prob").alias("y_score"), F.lit(1).alias("one"))
    area = E.areas(judged, ["one"]).collect()
    return Stack(w, b, ab, cut[0]["threshold"] if cut else 0.5, float(area[0]["roc_auc"] or 0.0) if area else 0.0)


def choose_stack(predictions: DataFrame, small: Sequence[str], large: Sequence[str], min_gain: float = MIN_GAIN) -> tuple[Stack, Stack, Stack]:
    """(chosen, small, large): the large stack only if its area is greater by min_gain."""
    a, b = train_stack(predictions, small), train_stack(predictions, large)
    return (b if b.roc_auc - a.roc_auc >= min_gain else a), a, b


def isotonic_scores(model, df: DataFrame, score: str = "y_score") -> DataFrame:
    """Adds p: the score as the isotonic model has it; rows without a score are left out."""
    return model.transform(df.where(F.col(score).isNotNull()).withColumn("features", F.col(score))).withColumnRenamed("prediction", "p").drop("features")


def isotonic_threshold(model, val: DataFrame, threshold: float, score: str = "y_score") -> float:
    """The least calibrated score of the rows that are positive at the raw threshold; 1 if there are none."""
    low = isotonic_scores(model, val.where(F.col(score) >= threshold), score).agg(F.min("p")).first()[0]
    return 1.0 if low is None else float(low)


def calibration_report(val: DataFrame, test: DataFrame, threshold: float) -> DataFrame:
    """(method, threshold, ece, mce, brier, macro_f1) of raw, sigmoid and isotonic scores on test; both are fitted on val."""
    a, b = platt(val)
    iso = isotonic(val)
    platted = lambda c: sigmoid(F.lit(a) * c + F.lit(b))
    rows = test.where("y_score is not null and y_true is not null").select("y_true", "y_score")
    kinds = {
        "raw": (rows.withColumn("p", F.col("y_score")), threshold),
        "platt": (rows.withColumn("p", platted(F.col("y_score"))), float(1 / (1 + np.exp(-(a * threshold + b))))),
        "isotonic": (isotonic_scores(iso, rows), isotonic_threshold(iso, val, threshold)),
    }
    out = None
    for name, (r, t) in kinds.items():
        part = r.select("y_true", F.col("p").alias("y_score"), F.lit(name).alias("method"), F.lit(float(t)).alias("threshold"), (F.col("p") >= t).cast("int").alias("y_pred"))
        out = part if out is None else out.unionByName(part)
    by = ["method", "threshold"]
    return E.calibration(out, by).join(E.classification(out, by).select(*by, "macro_f1"), by)


def cross_validate(df: DataFrame, cfg: Config, k: int = 5, seed: int = 42) -> DataFrame:
    """(fold, metrics) of k stratified folds."""
    rows = stratified_folds(df.where("label is not null"), k=k, seed=seed).persist()
    out = None
    for f in range(k):
        m = train(rows.where(f"fold <> {f}"), rows.where(f"fold = {f}"), cfg)
        e = evaluate(m, rows.where(f"fold = {f}"), ["fold"])
        out = e if out is None else out.unionByName(e)
    return out


def validated(train_rows: DataFrame, val_rows: DataFrame, cfg: Config) -> dict:
    """macro-F1 on val at the threshold chosen there, the threshold, and how many features there are."""
    m = train(train_rows, val_rows, cfg)
    rows = evaluate(m, val_rows.withColumn("one", F.lit(1)), ["one"]).collect()
    return {"val_macro_f1": rows[0]["macro_f1"] if rows else 0.0, "threshold": m.threshold, "n_features": sum(map(len, m.features.idf)) + m.features.lexicon_columns}


#: Variants of a configuration, one factor at a time.
ABLATION = {"baseline_light": {}, "clean_heavy": {"clean": "heavy"}, "strip_accents": {"strip_accents": True}, "binary_tf": {"binary": True}, "no_sublinear": {"sublinear": False}, "heavy+accents": {"clean": "heavy", "strip_accents": True}}


def ablation(train_rows: DataFrame, val_rows: DataFrame, base: Config = Config(clean="light"), variants: dict[str, dict] = ABLATION) -> list[dict]:
    """One row for each variant, the best first."""
    rows = [{"variant": name, **validated(train_rows, val_rows, replace(base, **delta))} for name, delta in variants.items()]
    return sorted(rows, key=lambda r: (-r["val_macro_f1"], r["variant"]))


def search(train_rows: DataFrame, val_rows: DataFrame, space: dict[str, Sequence], trials: int = 8, seed: int = 7, done: Sequence[dict] = ()) -> list[dict]:
    """Random search: {params, val_macro_f1, ...} of each trial, best first.  done: trials of an earlier run, which are not made again."""
    every = [dict(zip(space, v)) for v in product(*space.values())]
    picked = Random(seed).sample(every, min(trials, len(every)))
    known = {json.dumps(t["params"], sort_keys=True): t for t in done}
    out = [known.get(json.dumps(p, sort_keys=True)) or {"params": p, **validated(train_rows, val_rows, Config(**p))} for p in picked]
    return sorted(out, key=lambda t: (-t["val_macro_f1"], json.dumps(t["params"], sort_keys=True)))


def distinct_best(trials: Sequence[dict], k: int) -> list[dict]:
    """The k best trials of different parameters."""
    best: dict[str, dict] = {}
    for t in sorted(trials, key=lambda t: -t["val_macro_f1"]):
        best.setdefault(json.dumps(t["params"], sort_keys=True), t)
    return list(best.values())[:k]


def rerank(df: DataFrame, trials: Sequence[dict], k: int = 3, folds: int = 5) -> list[dict]:
    """The k best trials by their mean macro-F1 over folds, with its population deviation."""
    out = []
    for t in distinct_best(trials, k):
        r = cross_validate(df, Config(**t["params"]), folds).agg(F.avg("macro_f1").alias("m"), F.stddev_pop("macro_f1").alias("s")).first()
        out.append({**t, "cv_mean": r["m"], "cv_std": r["s"]})
    return sorted(out, key=lambda t: -t["cv_mean"])


def reduce(df: DataFrame, k: int = 16, features: str = "features") -> DataFrame:
    """Adds `reduced`: the first k coordinates of a singular value decomposition of the feature vectors, which may be sparse."""
    rows = RowMatrix(df.select(features).rdd.map(lambda r: OldVectors.fromML(r[0])))
    v = rows.computeSVD(k, computeU=False).V.toArray()  # features times k
    shared = df.sparkSession.sparkContext.broadcast(v)
    rows = df.rdd.map(lambda r: (*r, [float(x) for x in (shared.value[r[features].indices].T @ r[features].values if isinstance(r[features], SparseVector) else shared.value.T @ r[features].toArray())]))
    return df.sparkSession.createDataFrame(rows, StructType([*df.schema.fields, StructField("reduced", ArrayType(DoubleType()))]), verifySchema=False)
