"""Label harmonization: source labels to three classes, and three classes to a binary label under a policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HATE, OFFENSIVE, NEITHER = "hate", "offensive_nothate", "neither"
# Vote columns by what they speak for.
IDENTITY_VOTES = ("homophobia", "racism", "misogyny", "xenophobia")
OFFENSE_VOTES = ("obscene", "insult")
# Label maps of the sources, by policy; numbered classes are 1 hate, 2 offensive, 3 neither.
THREE_WAY = {"strict": {HATE: 1, OFFENSIVE: 0, NEITHER: 0}, "broad": {HATE: 1, OFFENSIVE: 1, NEITHER: 0}}
NUMBERED = {"strict": {"1": 1, "2": 0, "3": 0}, "broad": {"1": 1, "2": 1, "3": 0}}
BINARY = {"strict": {"0": 0, "1": 1}, "broad": {"0": 0, "1": 1}}
MEMES = {"strict": {"hateful_offensive": 1, "very_offensive": 0, "slight": 0, "not_offensive": 0}, "broad": {"hateful_offensive": 1, "very_offensive": 1, "slight": 0, "not_offensive": 0}}
LABEL_MAPS = {"memotion": MEMES, "tweets_ip": NUMBERED, "pt_fortuna": BINARY, "hatebr": THREE_WAY, "toldbr": THREE_WAY, "vidgen": THREE_WAY, "hatexplain": THREE_WAY}
# Confidence of a source label; all others are low.
CONFIDENCE = {"memotion": {"hateful_offensive": "high", "very_offensive": "low", "slight": "high", "not_offensive": "high"}, "tweets_ip": {"1": "medium", "3": "medium"}, "pt_fortuna": {"0": "high", "1": "high"}, "hatebr": {HATE: "high", NEITHER: "high"}, "toldbr": {HATE: "medium", NEITHER: "high"}, "vidgen": {HATE: "high", NEITHER: "high"}, "hatexplain": {HATE: "high", NEITHER: "high"}}


# Label maps by the start of the label.
PREFIX_MAPS = {"multioff": {"strict": {"offensive": 0, "non": 0}, "broad": {"offensive": 1, "non": 0}}}
# Fixed values: (source, policy) that stay out of the primary corpus, and sources that enter it only once their labels have been probed.
AUXILIARY = (("memotion", "strict"), ("memotion", "broad"), ("multioff", "strict"))
PROBE_GATED = ("tweets_ip",)


def first_nonblank(*cols: Column) -> Column:
    """The first column that is neither null nor blank, else the empty text."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols], F.lit(""))


def three_way(code: Column, offensive: Column | None = None) -> Column:
    """0 is neither, -1 offensive, all other codes hate."""
    c = F.trim(code)
    return F.when(c == "0", NEITHER).when(c == "-1", OFFENSIVE).when(c.isNotNull(), HATE)


def votes_three_way(df: DataFrame, least: int = 2) -> Column:
    """Hate if any identity vote reaches `least`, else offensive if any offense vote does, else neither."""
    number = lambda c: F.coalesce(F.expr(f"try_cast(trim(`{c}`) as double)"), F.lit(0.0))
    identity = F.greatest(*[number(c) for c in IDENTITY_VOTES])
    offense = F.greatest(*[number(c) for c in OFFENSE_VOTES])
    return F.when(identity >= least, HATE).when(offense >= least, OFFENSIVE).otherwise(NEITHER)


def annotators(df: DataFrame, total: int = 3) -> Column:
    """The labels of `total` annotators as an array, from vote counts: as many hate as the greatest identity vote, then offensive as the greatest offense vote, the rest neither."""
    number = lambda c: F.least(F.greatest(F.coalesce(F.expr(f"try_cast(trim(`{c}`) as double)"), F.lit(0.0)), F.lit(0.0)), F.lit(float(total))).cast("int")
    hate = F.greatest(*[number(c) for c in IDENTITY_VOTES])
    offensive = F.least(F.greatest(*[number(c) for c in OFFENSE_VOTES]), F.lit(total) - hate)
    return F.concat(F.array_repeat(F.lit(HATE), hate), F.array_repeat(F.lit(OFFENSIVE), offensive), F.array_repeat(F.lit(NEITHER), F.lit(total) - hate - offensive))


def vote_violations(df: DataFrame, least: float = 0.0, most: float = 3.0) -> DataFrame:
    """(vote, n_unreadable, n_out_of_range): counts that are no number or outside the range, for each vote column; null and blank ones are absent, not wrong."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("vote"), F.trim(F.col(c)).alias("v")) for c in (*IDENTITY_VOTES, *OFFENSE_VOTES)])).alias("x")
    rows = df.select(each).select("x.vote", "x.v").withColumn("d", F.expr("try_cast(v as double)"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.groupBy("vote").agg(n((F.col("v") != "") & F.col("d").isNull()).alias("n_unreadable"), n((F.col("d") < least) | (F.col("d") > most)).alias("n_out_of_range"))


def gated(df: DataFrame, probed: Sequence[str] = (), force: bool = False, policies: Sequence[str] = ("strict", "broad")) -> DataFrame:
    """harmonize with `primary`: whether a row enters the primary corpus.  probed: gated sources whose probe is recorded; force lets all gated ones in."""
    out = harmonize(df, policies)
    aux = F.concat_ws(" ", "source_dataset", "policy").isin(*[f"{s} {p}" for s, p in AUXILIARY])
    shut = F.col("source_dataset").isin(*[s for s in PROBE_GATED if s not in probed]) if not force and set(PROBE_GATED) - set(probed) else F.lit(False)
    return out.withColumn("primary", ~(aux | shut))


def majority(labels: Column, least: int = 2) -> Column:
    """The label that at least `least` annotators gave, null if none did; the smallest among equals."""
    distinct = F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isNotNull())))
    counted = F.transform(distinct, lambda v: F.struct(F.size(F.filter(labels, lambda x: x == v)).alias("n"), v.alias("v")))
    best = F.aggregate(counted, F.struct(F.lit(0).alias("n"), F.lit(None).cast("string").alias("v")), lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc))
    return F.when(best["n"] >= least, best["v"])


def map_label(label: Column, mapping: dict[str, int | str], prefix: bool = False) -> Column:
    """The mapped value, null if there is none.  With prefix, the first key that the label starts with, in the order given."""
    out = F.lit(None)
    for k, v in reversed(mapping.items()):
        out = F.when(label.startswith(k) if prefix else label == k, F.lit(v)).otherwise(out)
    return out


def map_table(maps: dict[str, dict[str, dict[str, int]]] = LABEL_MAPS) -> list[tuple[str, str, str, int]]:
    return [(s, p, label, v) for s, by in (maps | PREFIX_MAPS if maps is LABEL_MAPS else maps).items() for p, m in by.items() for label, v in m.items()]


def harmonize(df: DataFrame, policies: Sequence[str] = ("strict", "broad"), exclude: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """All policies in one plan: (id, source_dataset, policy, label, label_confidence) of rows whose label is mapped.

    The map is a dimension of some dozens of rows.  exclude: (source, policy) that stay out of the primary corpus.
    """
    spark = df.sparkSession
    rows = [r for r in map_table() if r[1] in policies and (r[0], r[1]) not in exclude]
    maps = spark.createDataFrame(rows, "source_dataset string, policy string, label_original string, mapped int")
    conf = spark.createDataFrame([(s, label, c) for s, m in CONFIDENCE.items() for label, c in m.items()], "source_dataset string, label_original string, conf string")
    src = df.select("id", "source_dataset", "label_original")
    # A label of a source with a prefix map stands for the first key that it starts with.
    for source, by in PREFIX_MAPS.items():
        keys = list(dict.fromkeys(k for m in by.values() for k in m))
        key = F.coalesce(*[F.when(F.col("label_original").startswith(k), F.lit(k)) for k in keys])
        src = src.withColumn("label_original", F.when(F.col("source_dataset") == source, key).otherwise(F.col("label_original")))
    out = src.join(F.broadcast(maps), ["source_dataset", "label_original"]).join(F.broadcast(conf), ["source_dataset", "label_original"], "left")
    return out.select("id", "source_dataset", "policy", F.col("mapped").alias("label"), F.coalesce("conf", F.lit("low")).alias("label_confidence"))


def unknown_labels(df: DataFrame, known: Sequence[str], label: str = "label") -> DataFrame:
    """(label, n): labels that no map knows; a loader fails if there are any."""
    return df.where(F.col(label).isNull() | ~F.col(label).isin(*known)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def validate(df: DataFrame, id_col: str = "id", text: str = "text", label: str = "label_original") -> DataFrame:
    """One row: n_rows, n_ids, duplicate_ids, empty_text, null_label."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(id_col).alias("n_ids"),
        (F.count(id_col) - F.countDistinct(id_col)).alias("duplicate_ids"),
        F.coalesce(F.sum((F.trim(F.coalesce(F.col(text), F.lit(""))) == "").cast("long")), F.lit(0)).alias("empty_text"),
        F.coalesce(F.sum(F.col(label).isNull().cast("long")), F.lit(0)).alias("null_label"),
    )


def interim(df: DataFrame, source: str, language: str, domain: str, text: str, label: str, row: str) -> DataFrame:
    """The six columns of every source: id from the row number, trimmed text and label, constants."""
    return df.select(
        F.concat(F.lit(f"{source}_"), F.col(row).cast("string")).alias("id"), F.trim(F.coalesce(F.col(text), F.lit(""))).alias("text"), F.trim(F.col(label)).alias("label_original"),
        F.lit(language).alias("language"), F.lit(source).alias("source_dataset"), F.lit(domain).alias("domain"),
    )
