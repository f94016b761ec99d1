"""Analyses of stored predictions and of the corpus: composition, signals, bias, errors, selection."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from time import perf_counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluate as E
from corpusloom.operators import features as X

# Neutral identity terms by group and language.
IDENTITY_TERMS = {
    "gender": {
        "en": ["women", "woman", "girl", "girls", "female", "feminist", "feminists"],
        "pt": ["mulher", "mulheres", "menina", "feminista", "feministas"],
    },
    "sexual_orientation": {
        "en": ["gay", "gays", "lesbian", "lesbians", "homosexual", "bisexual", "trans", "transgender"],
        "pt": ["gay", "gays", "lésbica", "lésbicas", "homossexual", "bissexual", "trans", "transgênero"],
    },
    "race_ethnicity": {
        "en": ["black", "white", "asian", "latino", "latina", "arab"],
        "pt": ["negro", "negra", "negros", "preto", "preta", "branco", "branca", "asiático", "indígena", "índio"],
    },
    "religion": {
        "en": ["muslim", "muslims", "islam", "jew", "jewish", "christian", "catholic"],
        "pt": ["muçulmano", "muçulmana", "islã", "judeu", "judia", "cristão", "católico", "evangélico", "umbanda", "candomblé"],
    },
    "nationality_immigration": {
        "en": ["immigrant", "immigrants", "refugee", "refugees", "foreigner", "mexican"],
        "pt": ["imigrante", "imigrantes", "refugiado", "refugiados", "estrangeiro", "nordestino", "venezuelano"],
    },
    "disability": {
        "en": ["disabled", "autistic", "deaf", "blind"],
        "pt": ["deficiente", "autista", "surdo", "cego"],
    },
}


def composition(df: DataFrame, by: Sequence[str] = ("source_dataset", "language")) -> DataFrame:
    """(by, n, n_hate, hate_rate): null labels count in n only."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n_hate"), F.round(F.sum("label") / F.count("label"), 3).alias("hate_rate"))


def crosstab(df: DataFrame, rows: str = "language", cols: str = "label", values: Sequence = (0, 1)) -> DataFrame:
    cells = [F.sum((F.col(cols) == v).cast("long")).alias(f"{cols}_{v}") for v in values]
    return df.groupBy(rows).agg(*[F.coalesce(c, F.lit(0)).alias(f"{cols}_{v}") for c, v in zip(cells, values)])


def length_histogram(df: DataFrame, by: str, text: str = "text_clean", clip: int = 400, bins: int = 40) -> DataFrame:
    """(by, bin, n, density) of text lengths clipped at `clip`, equal bins from the least to the greatest length of each group."""
    x = df.where(F.col(text).isNotNull()).select(by, F.least(F.length(text), F.lit(clip)).cast("double").alias("x"))
    ends = x.groupBy(by).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("total"))
    lo, hi = F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi"))
    ends = ends.select(by, lo.alias("lo"), hi.alias("hi"), "total")
    b = F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo")))).cast("int")
    # Lengths are counted first: at most clip + 1 rows a group meet the ends.
    counted = x.groupBy(by, "x").agg(F.count(F.lit(1)).alias("k"))
    out = counted.join(ends.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by"))).withColumn("bin", b)
    return out.groupBy(by, "bin").agg(F.sum("k").alias("n"), F.round(F.sum("k") / (F.max("total") * (F.max("hi") - F.max("lo")) / bins), 9).alias("density"))


def class_signals(df: DataFrame, lexicon_tokens: DataFrame, by: str = "label_original", text: str = "text_clean") -> DataFrame:
    """(by, n, share, mean_chars, mean_tokens, rates of profanity, capitals, exclamation marks and mentions)."""
    words = X.words_of(lexicon_tokens)
    t = F.coalesce(F.col("t"), F.lit(""))
    rows = df.select(by, F.col(text).alias("t"), T.tokens(F.lower(F.col(text))).alias("w"))
    rows = rows.select(
        by, F.length(t).alias("chars"), F.size("w").alias("toks"), (F.size(F.array_intersect("w", X.strings(words))) > 0).cast("int").alias("prof"),
        t.rlike(r"(^|[^\p{L}\p{M}\p{N}_])[A-Z]{3,}([^\p{L}\p{M}\p{N}_]|$)").cast("int").alias("caps"), t.contains("!").cast("int").alias("bang"), t.contains("<user>").cast("int").alias("user"),
    )
    mean = lambda c: F.round(F.sum(c) / F.count(F.lit(1)), 4)
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), mean("chars").alias("mean_chars"), mean("toks").alias("mean_tokens"), mean("prof").alias("profanity_rate"),
        mean("caps").alias("allcaps_rate"), mean("bang").alias("exclamation_rate"), mean("user").alias("mention_rate"),
    )
    return out.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))


def evidence(signals: DataFrame, by: str = "label_original", first: str = "1", second: str = "2", third: str = "3") -> DataFrame:
    """One row of checks that classes 1, 2, 3 are ordered by severity; null where a class is absent."""
    v = lambda c, k: F.max(F.when(F.col(by) == k, F.col(c)))
    return signals.agg(
        ((v("n", first) < v("n", second)) & (v("n", second) < v("n", third))).alias("count_ordered"), (v("profanity_rate", first) >= v("profanity_rate", third)).alias("severity_first_third"),
        (v("profanity_rate", second) >= v("profanity_rate", third)).alias("severity_second_third"),
    )


def langid_eval(df: DataFrame) -> DataFrame:
    """(source, n, accuracy, pct_other): the detector against the stored language, for each source and ALL."""
    ok = F.coalesce((F.col("lang_pred") == F.col("language")).cast("int"), F.lit(0))
    other = F.coalesce((F.col("lang_pred") == "other").cast("int"), F.lit(0))
    rows = df.select("source_dataset", ok.alias("ok"), other.alias("other"))
    out = rows.rollup("source_dataset").agg(F.grouping("source_dataset").alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.sum("ok") / F.count(F.lit(1)), 4).alias("accuracy"), F.round(F.sum("other") / F.count(F.lit(1)), 4).alias("pct_other"))
    return out.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("source_dataset")).alias("source"), "n", "accuracy", "pct_other")


def route(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds route_to: the language if it is en or pt and certain enough, else multilingual."""
    sure = F.col("lang_pred").isin("en", "pt") & (F.col("lang_conf") >= threshold)
    return df.withColumn("route_to", F.when(F.coalesce(sure, F.lit(False)), F.col("lang_pred")).otherwise("multilingual"))


def with_text(predictions: DataFrame, corpus: DataFrame, cols: Sequence[str]) -> DataFrame:
    return predictions.join(corpus.select("id", *cols), "id", "left")


def bias_probe(predictions: DataFrame, corpus: DataFrame, by: Sequence[str] = ("model_id",), text: str = "text_clean", terms: dict = IDENTITY_TERMS) -> DataFrame:
    """(by, group, n_nonhate_mentions, group_fpr, background_fpr, fpr_gap, mean_score) over rows that are no hate.

    A row may mention several groups.  Groups without a mention are left out.
    """
    rows = with_text(predictions.where("y_true = 0 and y_pred is not null"), corpus, [text])
    groups = []
    for g, by_lang in terms.items():
        any_lang = F.lit(False)
        for lang, words in by_lang.items():
            any_lang = any_lang | (F.coalesce(F.col("language") == lang, F.lit(False)) & T.contains_word(F.col(text), words))
        groups.append(F.when(any_lang, g))
    rows = rows.withColumn("group", F.explode(F.filter(F.concat(F.array(F.lit("")), F.array(*groups)), lambda x: x.isNotNull())))
    s = rows.groupBy(*by, "group").agg(F.count(F.lit(1)).alias("n"), F.sum("y_pred").alias("fp"), F.sum("y_score").alias("score"), F.count("y_score").alias("scored"))
    base = s.where("group = ''").select(*by, (F.col("fp") / F.col("n")).alias("bg"))
    fpr = F.col("fp") / F.col("n")
    out = s.where("group <> ''").join(base, list(by))
    return out.select(*by, "group", F.col("n").alias("n_nonhate_mentions"), F.round(fpr, 4).alias("group_fpr"), F.round("bg", 4).alias("background_fpr"), F.round(fpr - F.col("bg"), 4).alias("fpr_gap"), F.round(F.col("score") / F.col("scored"), 4).alias("mean_score"))


def error_frame(predictions: DataFrame, corpus: DataFrame, lexicon_tokens: DataFrame, text: str = "text_clean") -> DataFrame:
    """Predictions with kind of error and failure modes: implicit_hate, slur_overflag, is_short, langid_mismatch."""
    words = X.words_of(lexicon_tokens)
    rows = with_text(predictions.where("y_pred is not null"), corpus, [text, "label_confidence", "lang_pred", "route"])
    kind = F.when((F.col("y_true") == 1) & (F.col("y_pred") == 0), "false_negative").when((F.col("y_true") == 0) & (F.col("y_pred") == 1), "false_positive").otherwise("correct")
    prof = F.size(F.array_intersect(T.tokens(F.lower(F.col(text))), X.strings(words))) > 0
    rows = rows.withColumn("kind", kind).withColumn("n_tokens", T.token_count(F.col(text))).withColumn("has_profanity", prof)
    return rows.withColumn("implicit_hate", (F.col("kind") == "false_negative") & ~prof).withColumn("slur_overflag", (F.col("kind") == "false_positive") & prof).withColumn(
        "is_short", F.col("n_tokens") < 4
    ).withColumn("langid_mismatch", ~F.col("lang_pred").eqNullSafe(F.col("language")))


def error_modes(errors: DataFrame, by: Sequence[str] = ("model_id",)) -> DataFrame:
    n = lambda c: F.sum(c.cast("long"))
    wrong = F.col("kind") != "correct"
    return errors.groupBy(*by).agg(
        n(wrong).alias("n_errors"), n(F.col("kind") == "false_negative").alias("false_negatives"), n(F.col("kind") == "false_positive").alias("false_positives"), n(F.col("implicit_hate")).alias("implicit_hate_fn"),
        n(F.col("slur_overflag")).alias("slur_overflag_fp"), n(wrong & F.col("is_short")).alias("short_text_errors"), n(wrong & F.col("langid_mismatch")).alias("langid_mismatch_errors"),
    )


def error_rates(predictions: DataFrame, by: Sequence[str] = ("model_id",), slices: Sequence[str] = ("source_dataset", "language")) -> DataFrame:
    """(by, dimension, value, n, error_rate, fn_rate, fp_rate): one pass over all slices."""
    rows = predictions.where("y_true is not null and y_pred is not null")
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).alias("value")) for s in slices])).alias("s")
    rows = rows.select(*by, "y_true", "y_pred", each).select(*by, "s.dimension", "s.value", "y_true", "y_pred")
    pos = F.sum("y_true")
    return rows.groupBy(*by, "dimension", "value").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum((F.col("y_true") != F.col("y_pred")).cast("long")) / F.count(F.lit(1)), 4).alias("error_rate"),
        F.round(E.ratio(F.sum(((F.col("y_true") == 1) & (F.col("y_pred") == 0)).cast("double")), pos.cast("double")), 4).alias("fn_rate"),
        F.round(E.ratio(F.sum(((F.col("y_true") == 0) & (F.col("y_pred") == 1)).cast("double")), (F.count(F.lit(1)) - pos).cast("double")), 4).alias("fp_rate"),
    )


def error_examples(errors: DataFrame, by: Sequence[str] = ("model_id",), k: int = 20, text: str = "text_clean") -> DataFrame:
    """The k most confident errors of each kind: false negatives of the lowest score, false positives of the highest."""
    far = F.when(F.col("kind") == "false_negative", F.col("y_score")).otherwise(-F.col("y_score"))
    w = Window.partitionBy(*by, "kind").orderBy(far, "id")
    rows = errors.where("kind <> 'correct' and y_score is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    shown = F.substring(F.replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n", " "), F.lit("|"), F.lit("\\|")), 1, 200)
    return rows.select(*by, "kind", "rank", "id", F.round("y_score", 3).alias("score"), shown.alias("example"))


def overlapping_slices(predictions: DataFrame, by: Sequence[str] = ("model_id",), adversarial: str = "vidgen") -> DataFrame:
    """Metrics of the slices en, pt, adversarial and rest; a row is in as many as apply."""
    lang = F.col("language")
    names = F.array(F.when(lang == "en", "en"), F.when(lang == "pt", "pt"), F.when(F.col("source_dataset") == adversarial, "adversarial").otherwise("rest"))
    return E.classification(predictions.withColumn("slice", F.explode(F.filter(names, lambda x: x.isNotNull()))), [*by, "slice"])


def pareto_front(df: DataFrame, up: Sequence[str], down: Sequence[str]) -> DataFrame:
    """Rows that no other row dominates: at least as good on all axes and better on one.  Rows with a null axis are left out.

    Every task keeps the front of its own distinct points, and the fronts are merged in one; rows on the front come back by a semi-join.
    """
    axes = [*up, *down]
    points = df.dropna(subset=axes).select(*[F.col(c).cast("double").alias(c) for c in axes]).distinct()
    sign = np.array([1.0] * len(up) + [-1.0] * len(down))

    def front(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = np.zeros((0, len(axes)))
        for pdf in parts:
            for p in pdf.to_numpy(float) * sign:
                if not ((kept >= p).all(axis=1) & (kept > p).any(axis=1)).any():
                    kept = np.vstack([kept[~((kept <= p).all(axis=1) & (kept < p).any(axis=1))], p])
        yield pd.DataFrame(kept * sign, columns=axes)

    schema = ", ".join(f"`{c}` double" for c in axes)
    best = points.mapInPandas(front, schema).coalesce(1).mapInPandas(front, schema)
    return df.dropna(subset=axes).join(best.select(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(axes)]), [F.col(c).cast("double") == F.col(f"_o{k}") for k, c in enumerate(axes)], "left_semi")


def hash_sample(df: DataFrame, by: str, k: int, seed: int = 42, id_col: str = "id", buckets: int = 64) -> DataFrame:
    """k rows of each stratum, chosen by the hash of their id: the same rows in any engine and at any parallelism.

    First k of each bucket of a stratum, then k of those, so a stratum that holds most rows is not sorted in one task.
    """
    h = F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col)))
    rows = df.withColumn("_h", h).withColumn("_b", F.pmod(F.xxhash64(id_col), F.lit(buckets)))
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_b").orderBy("_h", id_col))).where(F.col("_r") <= k)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy("_h", id_col))).where(F.col("_r") <= k).drop("_h", "_b", "_r")


def largest(df: DataFrame, by: str, k: int = 15, ties: Sequence[str] = ()) -> DataFrame:
    """The k rows of the greatest value, nulls last, ties by further columns."""
    return df.orderBy(F.col(by).desc_nulls_last(), *ties).limit(k)


def flagged_and_sample(scored: DataFrame, flags: Sequence[str], by: str, k: int = 30, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Adds `part`: every flagged row, and up to k unflagged ones of each group, chosen by the hash of their id."""
    any_flag = F.lit(False)
    for f in flags:
        any_flag = any_flag | F.coalesce(F.col(f) == 1, F.lit(False))
    some = hash_sample(scored.where(~any_flag), by, k, seed, id_col).withColumn("part", F.lit("unflagged_sample"))
    return scored.where(any_flag).withColumn("part", F.lit("flagged")).unionByName(some)


def sources_present(df: DataFrame, sets: dict[str, Sequence[str]], source: str = "source_dataset") -> DataFrame:
    """(experiment, present): whether the table has any of an experiment's sources.  Sources are few; their set is made by an aggregation."""
    have = df.agg(F.collect_set(source).alias("have"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("experiment"), F.array(*[F.lit(x) for x in v]).alias("want")) for k, v in sets.items()])).alias("e")
    return have.select(each, "have").select("e.experiment", F.arrays_overlap("e.want", "have").alias("present"))


def model_table(quality: DataFrame, *others: DataFrame) -> DataFrame:
    """Quality of each model beside its calibration, bias, latency and size, where they are known: left joins on model_id."""
    out = quality
    for o in others:
        out = out.join(o, "model_id", "left")
    return out


def latency(infer: Callable[[str], object], texts: Sequence[str], calls: int = 24) -> tuple[float, float]:
    """(p50, p95) in milliseconds of calls of a scorer, one text each, after a warm-up; timed on the driver."""
    infer(texts[0])
    took = []
    for k in range(calls):
        began = perf_counter()
        infer(f"{texts[k % len(texts)]} n{k}")
        took.append(1000 * (perf_counter() - began))
    return float(np.percentile(took, 50)), float(np.percentile(took, 95))


def distinct_top(df: DataFrame, keys: Sequence[str], value: str, k: int, ties: Sequence[str] = ()) -> DataFrame:
    """The k best rows of different keys, the best row of each key."""
    best = df.groupBy(*keys).agg(F.max(F.struct(value, *[c for c in df.columns if c != value and c not in keys])).alias("_b"))
    return largest(best.select(*keys, "_b.*").select(*df.columns), value, k, ties or keys)


def thresholds_by_language(predictions: DataFrame, whole: DataFrame, by: Sequence[str] = ("model_id",), fit_on: str = "val", judge_by: str = "test") -> DataFrame:
    """(by, language, n, threshold, language_threshold, macro_f1 and recall with either, gain): a language's best cut on one split, applied to the other.

    whole: (by, threshold), the cut for all languages.  Rows without a language take no part.
    """
    keys = [*by, "language"]
    cuts = E.best_threshold(predictions.where((F.col("split") == fit_on) & F.col("language").isNotNull()), keys).select(*keys, F.col("threshold").alias("language_threshold"))
    rows = predictions.where((F.col("split") == judge_by) & F.col("y_score").isNotNull()).join(whole, list(by)).join(cuts, keys)
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("cut"), (F.col("y_score") >= F.col(c)).cast("int").alias("y_pred")) for c in ("threshold", "language_threshold")])).alias("p")
    m = E.classification(rows.select(*keys, "threshold", "language_threshold", "y_true", both).select(*keys, "threshold", "language_threshold", "y_true", "p.cut", "p.y_pred"), [*keys, "threshold", "language_threshold", "cut"])
    at = lambda c, which: F.max(F.when(F.col("cut") == which, F.col(c)))
    out = m.groupBy(*keys, "threshold", "language_threshold").agg(F.max("n").alias("n"), *[at(c, w).alias(f"{c}_{n}") for c in ("macro_f1", "recall_hate") for w, n in (("threshold", "whole"), ("language_threshold", "language"))])
    return out.withColumn("gain", F.col("macro_f1_language") - F.col("macro_f1_whole"))


def false_negative_quartiles(predictions: DataFrame, by: Sequence[str] = ("model_id", "language")) -> DataFrame:
    """(by, p25, p50, p75) of the scores of false negatives."""
    q = E.quantiles(predictions.where("y_true = 1 and y_pred = 0"), by, [0.25, 0.5, 0.75])
    return q.groupBy(*by).agg(*[F.max(F.when(F.col("q") == p, F.col("value"))).alias(n) for p, n in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75"))])
