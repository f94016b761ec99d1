import math

import pytest

from corpusloom.operators import models as M


def test_features_are_sublinear_smoothed_and_not_hashed(spark):
    cfg = M.Config(min_df=2)
    rows = M.featurize(spark.createDataFrame([("aaa bbb aaa",), ("aaa x!",), ("bbb x!",), ("once",)], "text_clean string"), cfg)
    fitted = M.fit_features(rows, cfg)
    assert [sorted(v.vocabulary) for v in fitted.vocabularies] == [["aaa", "bbb"], sorted([" aa", "aaa", "aa ", " aaa", "aaa ", " aaa ", " bb", "bbb", "bb ", " bbb", "bbb ", " bbb ", " x!", "x! ", " x! "])]
    first = M.apply_features(rows, fitted).first().features.toArray()
    idf = math.log(5 / 3) + 1
    a, b = (1 + math.log(2)) * idf, idf
    words = dict(zip(fitted.vocabularies[0].vocabulary, first))
    assert words["aaa"] == pytest.approx(a / math.hypot(a, b)) and words["bbb"] == pytest.approx(b / math.hypot(a, b))
    assert first[2:] @ first[2:] == pytest.approx(1.0)


def test_defaults_are_those_of_the_reference():
    c = M.Config()
    assert (c.word_features, c.char_features, c.char_ngrams, c.min_df, c.max_iter) == (150_000, 150_000, (3, 5), 3, 1000)
    assert M.estimator(M.Config(kind="gbt", max_iter=200)).getMaxIter() == 200


def test_svm_scores_are_calibrated_out_of_fold(spark):
    rows = [(f"i{k}", f"{'bad' if k % 4 == 0 else 'good'} thing {'meh' if k % 7 else 'bad'} w{k % 5}", int(k % 4 == 0)) for k in range(120)]
    df = spark.createDataFrame(rows, "id string, text_clean string, label int")
    m = M.train(df, df, M.Config(kind="svm", max_iter=50))
    assert len(m.members) == 3 and all(a > 0 for _, (a, _) in m.members)
    got = m.predict(df).select("y_score", "y_pred", "label").collect()
    assert all(0 < r.y_score < 1 for r in got) and sum(r.y_pred == r.label for r in got) > 110


def toy(spark, n=90):
    rows = [(f"i{k}", f"{'bad' if k % 3 == 0 else 'good'} thing w{k % 5} <user>", int(k % 3 == 0)) for k in range(n)]
    return spark.createDataFrame(rows, "id string, text_clean string, label int")


@pytest.fixture(scope="module")
def linear(spark):
    df = toy(spark)
    return df, M.train(df, df, M.Config(max_iter=20, min_df=1, word_features=200, char_features=200, lexicon=(("bad", "an", "inclusive"),)))


def test_save_load_score(spark, linear, tmp_path):
    df, m = linear
    M.save(m, str(tmp_path / "m"))
    again = M.load(spark, str(tmp_path / "m"))
    assert again.cfg == m.cfg and again.threshold == m.threshold
    a, b = ({r.id: r.y_score for r in x.predict(df).collect()} for x in (m, again))
    assert a == pytest.approx(b) and len(a) == 90


def test_lexicon_block_is_part_of_the_features(linear):
    df, m = linear
    assert m.features.lexicon_columns == 36
    v = M.apply_features(M.featurize(df.where("id = 'i0'"), m.cfg), m.features).first().features
    assert v.size == sum(map(len, m.features.idf)) + 36 and v.toArray()[-36:].max() == 1.0


def test_exported_document_scores_alike(linear, tmp_path):
    from corpusloom.sources import sinks

    df, m = linear
    doc = M.linear_document(m, [("x", 0.5)])
    sinks.export_linear(doc, str(tmp_path / "e.json"))
    assert [len(b["vocabulary"]) == len(b["coefficients"]) == len(b["idf"]) for b in doc["blocks"]] == [True, True] and len(doc["lexicon"]) == 36
    row = m.score(df.where("id = 'i0'")).first()
    f = M.apply_features(M.featurize(df.where("id = 'i0'"), m.cfg), m.features).first().features
    w = [c for b in doc["blocks"] for c in b["coefficients"]] + doc["lexicon"]
    z = sum(w[int(i)] * x for i, x in zip(f.indices, f.values)) + doc["intercept"]
    assert row.y_score == pytest.approx(1 / (1 + math.exp(-z)))


def members(spark):
    import random

    r = random.Random(5)
    rows = []
    for k in range(600):
        y = int(r.random() < 0.4)
        for m, noise in (("a", 0.3), ("b", 0.3), ("c", 0.3), ("noise", 9.0)):
            rows.append((m, "val" if k % 2 else "test", f"i{k}", y, 1 / (1 + math.exp(-(y - 0.5 + r.gauss(0, noise))))))
    return spark.createDataFrame(rows, "model_id string, split string, id string, y_true int, y_score double")


def test_larger_stack_must_gain(spark):
    p = members(spark)
    chosen, small, large = M.choose_stack(p, ["a", "b"], ["a", "b", "noise"])
    assert chosen is small and 0 < small.threshold < 1 and small.sigmoid[0] > 0
    chosen, small, large = M.choose_stack(p, ["noise"], ["a", "b", "c"])
    assert chosen is large and large.roc_auc > small.roc_auc + M.MIN_GAIN
    assert len(M.STACK_CUTS) == 200


def test_isotonic_threshold_repeats_the_raw_decision(spark):
    p = members(spark).where("model_id = 'a'")
    val = p.where("split = 'val'")
    iso = M.isotonic(val)
    t = M.isotonic_threshold(iso, val, 0.5)
    assert M.isotonic_scores(iso, val).where(f"(y_score >= 0.5) and p < {t!r}").count() == 0
    assert M.isotonic_threshold(iso, val, 2.0) == 1.0
    rows = {r.method: r for r in M.calibration_report(val, p.where("split = 'test'"), 0.5).collect()}
    assert rows.keys() == {"raw", "platt", "isotonic"} and rows["platt"].macro_f1 == pytest.approx(rows["raw"].macro_f1)


def test_ablation_and_search(spark):
    df = toy(spark, 45)
    base = M.Config(max_iter=5, min_df=1, word_features=50, char_features=50)
    rows = M.ablation(df, df, base, {"base": {}, "binary_tf": {"binary": True}, "no_sublinear": {"sublinear": False}, "heavy": {"clean": "heavy"}})
    assert len(rows) == 4 and rows[0]["val_macro_f1"] >= rows[-1]["val_macro_f1"] and len(M.ABLATION) == 6
    done = [{"params": {"c": 1.0}, "val_macro_f1": 0.1, "threshold": 0.5, "n_features": 1}]
    out = M.search(df, df, {"c": [1.0]}, trials=3, done=done)
    assert out == done
    best = M.distinct_best([*done, {"params": {"c": 1.0}, "val_macro_f1": 0.9}, {"params": {"c": 2.0}, "val_macro_f1": 0.5}], 2)
    assert [t["val_macro_f1"] for t in best] == [0.9, 0.5]


def test_reduced_vectors(linear):
    df, m = linear
    some = M.apply_features(M.featurize(df.limit(20), m.cfg), m.features).select("id", "features")
    assert all(len(r.reduced) == 3 for r in M.reduce(some, 3).collect())


def test_rerank_and_boosted_trees(spark):
    df = toy(spark, 60)
    small = {"max_iter": 2, "min_df": 1, "word_features": 20, "char_features": 20}
    out = M.rerank(df, [{"params": small, "val_macro_f1": 0.5}], 1, 2)
    assert 0 <= out[0]["cv_mean"] <= 1 and out[0]["cv_std"] >= 0
    m = M.train(df, df, M.Config(kind="gbt", depth=2, **small))
    assert m.predict(df).where("y_pred = label").count() > 50


def test_streamed_fit_is_the_least_of_its_loss(spark):
    """Each kind's gradient over plain feature vectors vanishes at the fitted weights, and the blocks' tokens give what the vectors give."""
    import numpy as np

    rows = [(f"i{k}", f"{'bad' if k % 4 == 0 else 'good'} thing aaaaaaa aaaa {'meh' if k % 7 else 'bad'} w{k % 5} 😂😂 bad", int(k % 4 == 0)) for k in range(60)] + [("none", "", 1), ("null", None, 0)]
    df = spark.createDataFrame(rows, "id string, text_clean string, label int")
    for kind in ("logreg", "svm"):
        cfg = M.Config(kind=kind, balanced=False, min_df=2, tol=1e-7)
        text = M.featurize(df.withColumn("weight", M.F.lit(1.0)).withColumn("fold", M.F.lit(9)), cfg)
        fitted = M.fit_features(text, cfg)
        assert "😂😂 " in fitted.vocabularies[1].vocabulary and "bad thing" in fitted.vocabularies[0].vocabulary
        design = fitted.design()
        (w,) = M.N.fit(M.N.blocks(text, design), design, kind, [None], tol=cfg.tol)
        got = M.apply_features(text, fitted).select("features", "label").collect()
        x, y = np.array([r.features.toArray() for r in got]), np.array([r.label for r in got])
        z, s = x @ w[:-1] + w[-1], 2 * y - 1
        r = -s / (1 + np.exp(s * z)) if kind == "logreg" else -2 * s * np.maximum(0, 1 - s * z)
        assert np.abs(x.T @ r / len(y) + w[:-1] / len(y)).max() < 1e-6


def test_blocks_are_one_value_of_few_bytes(spark):
    """A block goes to Python as one value, smaller than four bytes an entry, and holds what its rows' features hold."""
    import numpy as np

    cfg = M.Config(min_df=1)
    df = toy(spark, 300).withColumn("weight", M.F.lit(1.0)).withColumn("fold", M.F.lit(0))
    text = M.featurize(df.coalesce(1), cfg)
    fitted = M.fit_features(text, cfg)
    design = fitted.design()
    (row,) = M.N.blocks(text, design).collect()
    block, x = M.N.Block(row.asDict()), np.array([r.features.toArray() for r in M.apply_features(text, fitted).select("features").collect()])
    assert block.n == 300 and len(row.data) < 4 * (x != 0).sum()
    w, r = np.random.default_rng(3).normal(size=len(design) + 1), np.random.default_rng(4).normal(size=300)
    assert block.margins(w * np.append(design.idf, 1.0), len(design.idf)) == pytest.approx(x @ w[:-1] + w[-1])
    assert block.gathered(r, len(design.idf))[:-1] * design.idf == pytest.approx(r @ x)


def test_tokens_are_made_once(spark, monkeypatch):
    """Counting and encoding read one written table, which is gone when the terms' text is asked for."""
    seen = []
    for name in ("frequencies", "blocks"):
        monkeypatch.setattr(M.N, name, lambda df, *a, f=getattr(M.N, name): seen.append(sorted(df.inputFiles())) or f(df, *a))
    df = toy(spark, 60)
    m = M.train(df, df, M.Config(max_iter=3, min_df=1, word_features=20, char_features=20))
    assert seen[0] and seen[0] == seen[1] and all("/tokens-" in f for f in seen[0])
    assert {"good", "bad"} <= set(m.features.vocabularies[0].vocabulary)


def test_svm_reads_tokens_once_in_blocks_of_one_fold(spark, monkeypatch):
    """An svm's tokens are made once too; each block has the rows of one fold, and a model's gradient over the rows of the other folds vanishes."""
    import numpy as np

    seen, kept = [], []
    for name in ("frequencies", "blocks"):
        monkeypatch.setattr(M.N, name, lambda df, *a, f=getattr(M.N, name): seen.append(sorted(df.inputFiles())) or f(df, *a))
    fit = M.N.fit
    monkeypatch.setattr(M.N, "fit", lambda table, design, *a: kept.append(([M.N.Block(r.asDict()) for r in table.collect()], design, fit(table, design, *a))) or kept[0][2])
    df = toy(spark, 90)
    M.train(df, df, M.Config(kind="svm", balanced=False, min_df=1, tol=1e-7))
    assert seen[0] and seen[0] == seen[1] and all("/tokens-" in f for f in seen[0])
    ((blocks, design, weights),) = kept
    assert sum(b.n for b in blocks) == 90 and {int(b.fold[0]) for b in blocks} == {0, 1, 2} and all(len(set(b.fold)) == 1 for b in blocks)
    dims = len(design.idf)
    for k, w in enumerate(weights):
        others = [b for b in blocks if b.fold[0] != k]
        g = sum(b.gathered(M.N.squared_hinge(b.margins(w * np.append(design.idf, 1.0), dims), b.label)[1], dims) for b in others) * np.append(design.idf, 1.0) + w
        assert np.abs(g).max() / sum(b.n for b in others) < 1e-6
