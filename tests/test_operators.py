import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import langid
from corpusloom.functions import text as T
from corpusloom.functions.wordlists import NEGATIONS, stop_list
from corpusloom.operators import analysis as A
from corpusloom.operators import dedup as D
from corpusloom.operators import features as X
from corpusloom.operators import labels as L
from corpusloom.operators import splits as S
from corpusloom.operators.graph import components
from corpusloom.plans import durable


def one(spark, column, *values):
    """The column over a table of one text column t."""
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column).collect()]


# ---- text ----
def test_cleaner_profiles(spark):
    t = "RT @ana: Olá  MUNDO!! veja https://x.y/z #fim \U0001f525"
    assert one(spark, T.clean(F.col("t")), t, None, "  ") == ["<user> : Olá MUNDO!! veja <url> fim \U0001f525", "", ""]
    assert one(spark, T.clean(F.col("t"), T.HEAVY), t)[0] == "<user> : olá mundo veja <url> fim"


def test_demojize_and_accents(spark):
    assert one(spark, T.clean(F.col("t"), T.Profile(demojize=True)), "oi \U0001f525❤️") == ["oi :fire: :heavy_black_heart:"]
    assert one(spark, T.strip_accents(F.col("t")), "ação Ünïq ő", None, "") == ["acao Uniq o", None, ""]
    assert one(spark, T.normalize(F.col("t"), "NFKC"), "ﬁm ２") == ["fim 2"]


def test_tokens_and_grams(spark):
    assert one(spark, T.tokens(F.col("t")), " a  b　c ", None) == [["a", "b", "c"], []]
    assert one(spark, T.ngrams(T.letter_tokens(F.col("t")), 1, 2), "Uma coisa x boa") == [["uma", "coisa", "boa", "uma coisa", "coisa boa"]]
    assert one(spark, T.word_bounded_chars(F.array(F.col("t")), 3, 3), "ab", "a") == [[" ab", "ab "], [" a "]]
    assert [sorted(x) for x in one(spark, T.shingles(F.col("t")), "abcdef", "ab", "", None)] == [["abcde", "bcdef"], ["ab"], [], []]


def test_stop_lists_keep_negations(spark):
    assert {"they", "with", "the"} <= set(T.stop_words("en")) and {"para", "você"} <= {*T.stop_words("pt"), "você"} and not NEGATIONS & set(T.stop_words("enpt"))
    assert T.stop_words(None) is None and T.stop_words(["b", "a"]) == ["a", "b"] and len(stop_list("pt")) > 100
    with pytest.raises(ValueError):
        T.stop_words("xx")


def test_language_by_function_words(spark):
    df = spark.createDataFrame([("the people who were there said it",), ("as pessoas que estavam ali não sabem",), ("los perros que están en la calle y nosotros",), ("هذا نص عربي",), (None,), ("",), ("zzz",)], "text_clean string")
    rows = [(r.lang, round(r.conf, 2) > 0) for r in langid.detect(df).collect()]
    assert rows == [("en", True), ("pt", True), ("other", True), ("other", True), ("other", False), ("other", False), ("other", False)]


# ---- graph ----
def root_of(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


R = random.Random(1)
GRAPHS = {
    "chain": [(k, k + 1) for k in range(60)],
    "giant star and a pair": [(0, k) for k in range(1, 120)] + [(400, 401), (7, 7), (900, 900)],
    "random": [(R.randrange(150), R.randrange(150)) for _ in range(110)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("per_task", [None, 30, 7])
def test_components(spark, name, per_task):
    df = spark.createDataFrame([*GRAPHS[name], (None, 1)], "a long, b long")
    rows = components(df, per_task).collect()
    assert {r.node: r.root for r in rows} == root_of(GRAPHS[name]) and len({r.node for r in rows}) == len(rows)


def test_tables_are_deleted_after_use(spark):
    t = durable.keep(spark.range(3), "t")
    path = t.kept_at.removeprefix("file://")
    assert t.count() == 3 and os.path.isdir(path)
    durable.discard(t)
    assert not os.path.exists(path)


@pytest.mark.parametrize("hot", [True, False])
def test_skewed_join_keeps_all_rows(spark, hot):
    rows = spark.range(2000).select(F.when((F.col("id") % 3 > 0) & F.lit(hot), 0).otherwise(F.col("id")).alias("k"))
    keyed = durable.keep(rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("v", F.col("k") * 2))
    out = durable.join_skewed(rows, keyed, ["k"], "n", share=10)
    assert out.count() == 2000 and out.where("v <> k * 2").count() == 0


# ---- duplicates ----
def test_confident_survivor_and_ties(spark):
    df = spark.createDataFrame([("a", "Same  text", "low", 0), ("b", "same text", "high", 1), ("c", "SAME TEXT", "high", 0), ("d", None, None, 1), ("e", "  ", "low", 0)], "id string, text_clean string, label_confidence string, label int")
    assert {r.id for r in D.exact_duplicates(df).collect()} == {"b", "d"}
    assert D.exact_duplicates(df.limit(0)).count() == 0


def jaccard(a, b):
    x, y = ({t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize(("small", "block"), [(24, 2000), (2, 3)])
def test_near_pairs_against_brute_force(spark, small, block):
    r = random.Random(2)
    base = ["".join(r.choices("abcdefg ", k=150)) for _ in range(6)]
    texts = {}
    for k in range(60):
        t = list(r.choice(base))
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice("xyz")
        texts[f"d{k:02}"] = "".join(t)
    df = spark.createDataFrame(list(texts.items()), "id string, text string")
    got = {(x.id_a, x.id_b) for x in D.near_pairs(df, 0.9, 5, small, block).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if jaccard(texts[a], texts[b]) >= 0.9}


def test_clusters_of_case_and_space_variants(spark):
    df = spark.createDataFrame([("a", "the quick brown fox jumps over it"), ("b", "THE quick  brown fox jumps over it"), ("c", "something else entirely here"), ("d", None), ("e", None)], "id string, text_clean string")
    c = {r.id: r.cluster for r in D.near_clusters(df, links=spark.createDataFrame([("c", "d")], "a string, b string")).collect()}
    assert c["a"] == c["b"] != c["c"] == c["d"] and c["e"] == "e" and len(c) == 5


def test_leakage_gate_catches_a_near_duplicate(spark):
    df = spark.createDataFrame([("a", "same text", 1, "train"), ("b", "Same  text", 2, "test"), ("c", "other", 3, "val"), ("d", "words", 3, "val")], "id string, text_clean string, dup_cluster_id long, split string")
    assert {(r.kind, r.n_groups, r.n_leaking) for r in D.leaks(df).collect()} == {("text", 3, 1), ("cluster", 3, 0)}


# ---- splits ----
@pytest.mark.parametrize("per_task", [10, 1000])
def test_folds_and_numbers(spark, per_task):
    df = spark.createDataFrame([(f"i{k}", [0, 0, 1, None][k % 4]) for k in range(400)], "id string, label int")
    rows = S.stratified_folds(df, per_task=per_task).collect()
    assert len(rows) == 400
    for label in (0, 1, None):
        n = [sum(r.label == label and r.fold == f for r in rows) for f in range(5)]
        assert max(n) - min(n) <= 1
    # the same folds however many rows a task numbers
    assert {(r.id, r.fold) for r in rows} == {(r.id, r.fold) for r in S.stratified_folds(df).collect()}


def test_make_splits_and_statistics(spark):
    r = random.Random(0)
    words = [f"w{k}" for k in range(120)]
    rows = [(f"x_{k}", " ".join(r.choices(words, k=12)), "high", k % 2, "en", "s") for k in range(200)]
    rows += [("x_900", rows[0][1] + ".", "low", 0, "en", "s"), ("x_901", rows[1][1].upper(), "low", 1, "en", "s")]
    df = spark.createDataFrame(rows, "id string, text_clean string, label_confidence string, label int, language string, source_dataset string")
    pairs = spark.createDataFrame([], "row_no long, acl_id string, acl_id_matched string")
    out, stats = S.make_splits(df, pairs, [("train", 0.7), ("val", 0.15), ("test", 0.15)])
    s = {x.name: x.value for x in stats.collect()}
    split = {x.id: x.split_to for x in out.collect()}
    assert s["rows_in"] == 202 and s["exact_removed"] == 1 and s["rows_after_exact"] == 201 and s["near_clusters"] == 200
    assert split["x_0"] == split["x_900"] and s["split_train"] + s["split_val"] + s["split_test"] == 201 and abs(s["split_train"] / 201 - 0.7) < 0.03


# ---- labels ----
def test_policies_gates_and_prefixes(spark):
    df = spark.createDataFrame([("a", "tweets_ip", "2"), ("b", "multioff", "offensive stuff"), ("c", "memotion", "very_offensive"), ("d", "hatebr", "hate"), ("e", "hatebr", "?"), ("f", "tweets_ip", None)], "id string, source_dataset string, label_original string")
    rows = {(r.id, r.policy): r for r in L.gated(df).collect()}
    assert {k: r.label for k, r in rows.items()} == {("a", "strict"): 0, ("a", "broad"): 1, ("b", "strict"): 0, ("b", "broad"): 1, ("c", "strict"): 0, ("c", "broad"): 1, ("d", "strict"): 1, ("d", "broad"): 1}
    assert {k for k, r in rows.items() if r.primary} == {("b", "broad"), ("d", "strict"), ("d", "broad")}
    assert L.gated(df, probed=["tweets_ip"]).where("primary and source_dataset = 'tweets_ip'").count() == 2 == L.gated(df, force=True).where("primary and source_dataset = 'tweets_ip'").count()


def test_votes(spark):
    df = spark.createDataFrame([("2", None, "", "0", "1", "x"), ("0", "3.0", "1", "0", "0", "0"), (None, "1", "9", "0", "0", "-1")], "homophobia string, obscene string, insult string, racism string, misogyny string, xenophobia string")
    assert [r[0] for r in df.select(L.majority(L.annotators(df))).collect()] == ["hate", "offensive_nothate", "offensive_nothate"]
    bad = {r.vote: (r.n_unreadable, r.n_out_of_range) for r in L.vote_violations(df).collect()}
    assert bad["xenophobia"] == (1, 1) and bad["insult"] == (0, 1) and bad["racism"] == (0, 0)


def test_first_nonblank_and_interim(spark):
    df = spark.createDataFrame([(None, "ocr"), ("  ", "x"), ("kept", "x"), (None, None)], "a string, b string")
    assert [r[0] for r in df.select(L.first_nonblank(F.col("a"), F.col("b"))).collect()] == ["ocr", "x", "kept", ""]
    raw = spark.createDataFrame([(1, "  olá mundo ", "1 "), (2, None, "0")], "n int, t string, l string")
    assert [(r.id, r.text, r.label_original) for r in L.interim(raw, "s", "pt", "d", "t", "l", "n").collect()] == [("s_1", "olá mundo", "1"), ("s_2", "", "0")]


# ---- features and analyses ----
def test_lexicon_block_counts_words_and_pairs(spark):
    lex = X.lexicon(spark.createDataFrame([(" Bad  Word ", "ps", "Conservative"), ("bad", "an", "inclusive"), ("bad", "an", "inclusive"), ("one two three", "ps", "inclusive"), ("x", "??", "inclusive")], "lemma string, category string, level string"))
    assert lex.count() == 2
    df = spark.createDataFrame([("a", "A bad word, bad!"), ("b", None), ("c", "fine")], "id string, text_clean string")
    rows = {r.id: r for r in X.lexicon_block(df, lex).collect()}
    assert rows["a"].ps_conservative == pytest.approx(1 / 3) and rows["a"].an_inclusive == pytest.approx(2 / 3) and rows["a"].rate == pytest.approx(1.0) and rows["a"]["any"] == 1.0
    assert rows["b"].rate == rows["c"].rate == rows["c"]["any"] == 0.0 and len(X.lexicon_block(df, lex).columns) == 37
    assert {(r.id, r.category, r.hits) for r in X.lexicon_hits(df, lex).collect()} == {("a", "ps", 1), ("a", "an", 2)}


def test_profanity_is_whole_tokens(spark):
    df = spark.createDataFrame([("1", "badly put"), ("1", "BAD thing"), (None, None)], "label_original string, text_clean string")
    rows = {r.label_original: r for r in A.class_signals(df, spark.createDataFrame([("bad",)], "token string")).collect()}
    assert rows["1"].profanity_rate == 0.5 and rows["1"].n == 2 and rows[None].mean_tokens == 0


def test_histogram_keeps_null_groups(spark):
    df = spark.createDataFrame([("a", "xx"), (None, "y" * 900), (None, "z"), ("b", None)], "source_dataset string, text_clean string")
    assert {r.source_dataset for r in A.length_histogram(df, "source_dataset").collect()} == {"a", None}


def test_word_lists_are_refused_not_cut(spark):
    with pytest.raises(ValueError):
        X.words_of(spark.range(X.MOST_LEMMAS + 1).select(F.col("id").cast("string").alias("token")))


def test_cache(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None)], "k int, text string")
    vectors = spark.createDataFrame([(1, [1.0]), (3, [3.0]), (4, [4.0])], "k int, embedding array<float>")
    cache = X.seed_cache(texts, vectors, "k")
    assert [r.vector for r in cache.collect()] == [[1.0]]
    assert {r.text for r in X.cache_misses(texts, cache, "text").collect()} == {"b"}


def test_sources_and_top(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), (None, None)], "source_dataset string, v double")
    assert {r.experiment: r.present for r in A.sources_present(df, {"x": ["a", "z"], "y": ["q"]}).collect()} == {"x": True, "y": False}
    assert [r.v for r in A.largest(df, "v", 2).collect()] == [3.0, 2.0]
    assert [(r.source_dataset, r.v) for r in A.distinct_top(df.dropna(), ["source_dataset"], "v", 5).collect()] == [("a", 3.0), ("b", 2.0)]
