"""Queries over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import langid as I
from corpusloom.functions import text as T
from corpusloom.operators import analysis as A
from corpusloom.operators import dedup as D
from corpusloom.operators import evaluate as E
from corpusloom.operators import features as X
from corpusloom.operators import labels as L
from corpusloom.operators import models as M
from corpusloom.operators import splits as S
from corpusloom.plans.durable import keep
from corpusloom.sources import html, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "corpus_strict")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """The latest score of each model for each example."""
    return E.latest(_t(spark, d, "predictions"))


# SQL pieces.
PL = """WITH pl AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY model_id, id ORDER BY scored_at DESC NULLS LAST, y_score DESC NULLS LAST,
 split DESC NULLS LAST, language DESC NULLS LAST, source_dataset DESC NULLS LAST, y_true DESC NULLS LAST, y_pred DESC NULLS LAST) AS rn FROM predictions) WHERE rn = 1)"""
CELLS = """count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
 count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn"""
R = lambda a, b: f"(CASE WHEN ({b}) = 0 THEN 0.0::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"
F1H, F1N = R("2*tp", "2*tp+fp+fn"), R("2*tn", "2*tn+fn+fp")
METRICS = f"""tp+fp+fn+tn AS n, tp+fn AS n_hate, round(({F1H} + {F1N}) / 2, 9) AS macro_f1, round({R("tp+tn", "tp+fp+fn+tn")}, 9) AS accuracy,
 round({R("tp", "tp+fp")}, 9) AS precision_hate, round({R("tp", "tp+fn")}, 9) AS recall_hate, round({F1H}, 9) AS f1_hate,
 round({R("tn", "tn+fn")}, 9) AS precision_nothate, round({R("tn", "tn+fp")}, 9) AS recall_nothate"""
WS = T.SPACE.replace("'", "''")


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- corpus ----
@query("SELECT source_dataset, language, count(*) AS n, coalesce(sum(label), 0)::BIGINT AS n_hate, round(sum(label)::DOUBLE / nullif(count(label), 0), 3) AS hate_rate FROM corpus_strict GROUP BY ALL")
def corpus_composition(spark, d):
    return A.composition(corpus(spark, d))


@query("SELECT source_dataset, count(*) AS n, round(avg(label), 9) AS mean_label FROM corpus_strict GROUP BY ALL")
def source_means(spark, d):
    return corpus(spark, d).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("label"), 9).alias("mean_label"))


@query("SELECT language, count(*) FILTER (label = 0) AS label_0, count(*) FILTER (label = 1) AS label_1 FROM corpus_strict GROUP BY ALL")
def label_crosstab(spark, d):
    return A.crosstab(corpus(spark, d))


@query("""WITH x AS (SELECT source_dataset, least(length(text_clean), 400)::DOUBLE AS x FROM corpus_strict WHERE text_clean IS NOT NULL),
 e AS (SELECT source_dataset, count(*) AS total, CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo, CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM x GROUP BY ALL),
 b AS (SELECT x.source_dataset, least(39, floor((x - lo) * 40 / (hi - lo)))::INTEGER AS bin, total, lo, hi FROM x JOIN e USING (source_dataset))
 SELECT source_dataset, bin, count(*) AS n, round(count(*) / (max(total) * (max(hi) - max(lo)) / 40), 9) AS density FROM b GROUP BY ALL""")
def length_histogram(spark, d):
    return A.length_histogram(corpus(spark, d), "source_dataset")


@query("SELECT label, split, count(*) AS n, count(DISTINCT dup_cluster_id) AS clusters FROM corpus_strict GROUP BY ALL")
def split_counts(spark, d):
    return corpus(spark, d).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dup_cluster_id").alias("clusters"))


_PROF = "p AS (SELECT DISTINCT lemma AS token FROM (SELECT trim(regexp_replace(lower(lemma), '\\s+', ' ', 'g')) AS lemma, lower(trim(category)) AS c, lower(trim(level)) AS l FROM lexicon) WHERE lemma <> '' AND NOT contains(lemma, ' ') AND c IN (" + ", ".join(f"'{c}'" for c in X.CATEGORIES) + ") AND l IN ('conservative', 'inclusive'))"
_TOK = f"list_filter(regexp_split_to_array(coalesce(text_clean, ''), '{WS}+'), x -> x <> '')"
_SIGNALS = f"""{_PROF}, r AS (SELECT label_original, length(coalesce(text_clean, '')) AS chars, len({_TOK}) AS toks,
 list_has_any(list_transform({_TOK}, x -> lower(x)), (SELECT list(token) FROM p))::INTEGER AS prof, regexp_matches(coalesce(text_clean, ''), '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])[A-Z]{{3,}}([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')::INTEGER AS caps,
 contains(coalesce(text_clean, ''), '!')::INTEGER AS bang, contains(coalesce(text_clean, ''), '<user>')::INTEGER AS u FROM corpus_strict),
 g AS (SELECT label_original, count(*) AS n, round(sum(chars) / count(*), 4) AS mean_chars, round(sum(toks) / count(*), 4) AS mean_tokens, round(sum(prof) / count(*), 4) AS profanity_rate,
 round(sum(caps) / count(*), 4) AS allcaps_rate, round(sum(bang) / count(*), 4) AS exclamation_rate, round(sum(u) / count(*), 4) AS mention_rate FROM r GROUP BY ALL)"""


@query(f"WITH {_SIGNALS} SELECT *, round(n / sum(n) OVER (), 4) AS share FROM g")
def class_signals(spark, d):
    return A.class_signals(corpus(spark, d), X.profanity(_t(spark, d, "lexicon")))


@query(f"""WITH {_SIGNALS}, v AS (SELECT max(n) FILTER (label_original = '1') AS n1, max(n) FILTER (label_original = '2') AS n2, max(n) FILTER (label_original = '3') AS n3,
 max(profanity_rate) FILTER (label_original = '1') AS p1, max(profanity_rate) FILTER (label_original = '2') AS p2, max(profanity_rate) FILTER (label_original = '3') AS p3 FROM g)
 SELECT n1 < n2 AND n2 < n3 AS count_ordered, p1 >= p3 AS severity_first_third, p2 >= p3 AS severity_second_third FROM v""")
def class_evidence(spark, d):
    return A.evidence(A.class_signals(corpus(spark, d), X.profanity(_t(spark, d, "lexicon"))))


@query("""SELECT coalesce(source_dataset, 'ALL') AS source, count(*) AS n, round(count(*) FILTER (lang_pred = language) / count(*), 4) AS accuracy, round(count(*) FILTER (lang_pred = 'other') / count(*), 4) AS pct_other
 FROM corpus_strict GROUP BY ROLLUP (source_dataset)""")
def langid_eval(spark, d):
    return A.langid_eval(corpus(spark, d))


@query("""SELECT id, CASE WHEN lang_pred IN ('en', 'pt') AND lang_conf >= 0.5 THEN lang_pred ELSE 'multilingual' END AS route_to FROM corpus_strict""")
def language_route(spark, d):
    return A.route(corpus(spark, d)).select("id", "route_to")


def _langid_sql() -> str:
    lists = {c: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in I.function_words(c)) + "]" for c in I.LANGUAGES}
    votes = ", ".join([f"len(list_filter(w, x -> list_contains({v}, x)))" for v in lists.values()] + ["len(list_filter(w, x -> regexp_full_match(x, '[\\x{0600}-\\x{06FF}]+')))"])
    codes = "[" + ", ".join(f"'{c if c in I.OWN else 'other'}'" for c in [*I.LANGUAGES, "ar"]) + "]"
    return f"""WITH w AS (SELECT id, regexp_extract_all(lower(coalesce(text_clean, '')), '\\p{{L}}+') AS w FROM corpus_strict), v AS (SELECT id, [{votes}] AS v FROM w)
 SELECT id, CASE WHEN list_max(v) > 0 THEN {codes}[list_position(v, list_max(v))] ELSE 'other' END AS lang, CASE WHEN list_max(v) > 0 THEN round(list_max(v) / list_sum(v), 6) ELSE 0.0 END AS conf FROM v"""


@query(_langid_sql())
def language_id(spark, d):
    return rounded(I.detect(corpus(spark, d)).select("id", "lang", "conf"), 6)


# ---- labels ----
@query("""WITH v AS (SELECT row_no, greatest(coalesce(try_cast(trim(homophobia) AS DOUBLE), 0), coalesce(try_cast(trim(racism) AS DOUBLE), 0), coalesce(try_cast(trim(misogyny) AS DOUBLE), 0), coalesce(try_cast(trim(xenophobia) AS DOUBLE), 0)) AS i,
 greatest(coalesce(try_cast(trim(obscene) AS DOUBLE), 0), coalesce(try_cast(trim(insult) AS DOUBLE), 0)) AS o FROM toldbr_votes)
 SELECT row_no, CASE WHEN i >= 2 THEN 'hate' WHEN o >= 2 THEN 'offensive_nothate' ELSE 'neither' END AS label_original FROM v""")
def vote_three_way(spark, d):
    v = _t(spark, d, "toldbr_votes")
    return v.select("row_no", L.votes_three_way(v).alias("label_original"))


_MAPS = ", ".join(f"('{s}', '{p}', '{label}', {v})" for s, p, label, v in L.map_table())
_CONF = ", ".join(f"('{s}', '{label}', '{c}')" for s, m in L.CONFIDENCE.items() for label, c in m.items())


@query(f"""WITH m(source_dataset, policy, label_original, mapped) AS (VALUES {_MAPS}), f(source_dataset, label_original, conf) AS (VALUES {_CONF})
 SELECT id, source_dataset, policy, mapped AS label, coalesce(conf, 'low') AS label_confidence FROM corpus_strict JOIN m USING (source_dataset, label_original) LEFT JOIN f USING (source_dataset, label_original)""")
def label_policies(spark, d):
    return L.harmonize(corpus(spark, d))


@query("""SELECT id, CASE WHEN starts_with(label_original, 'offensive') THEN 1 WHEN starts_with(label_original, 'hate') THEN 1 WHEN starts_with(label_original, 'nei') THEN 0 END AS label FROM corpus_strict
 WHERE starts_with(label_original, 'offensive') OR starts_with(label_original, 'hate') OR starts_with(label_original, 'nei')""")
def prefix_labels(spark, d):
    c = corpus(spark, d)
    return c.select("id", L.map_label(F.col("label_original"), {"offensive": 1, "hate": 1, "nei": 0}, prefix=True).alias("label")).where("label is not null")


_VOTE = lambda c: f"least(greatest(coalesce(try_cast(trim({c}) AS DOUBLE), 0), 0), 3)"


@query(f"""WITH v AS (SELECT row_no, trunc(greatest({", ".join(map(_VOTE, L.IDENTITY_VOTES))}))::INTEGER AS h, trunc(greatest({", ".join(map(_VOTE, L.OFFENSE_VOTES))}))::INTEGER AS f FROM toldbr_votes), n AS (SELECT row_no, h, least(f, 3 - h) AS o FROM v)
 SELECT row_no, CASE WHEN h >= 2 THEN 'hate' WHEN o >= 2 THEN 'offensive_nothate' WHEN 3 - h - o >= 2 THEN 'neither' END AS label FROM n""")
def majority_vote(spark, d):
    v = _t(spark, d, "toldbr_votes")
    return v.select("row_no", L.majority(L.annotators(v)).alias("label"))


@query("SELECT vote, count(*) FILTER (v <> '' AND try_cast(v AS DOUBLE) IS NULL) AS n_unreadable, count(*) FILTER (try_cast(v AS DOUBLE) < 0 OR try_cast(v AS DOUBLE) > 3) AS n_out_of_range FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS vote, trim({c}) AS v FROM toldbr_votes" for c in (*L.IDENTITY_VOTES, *L.OFFENSE_VOTES)) + ") GROUP BY ALL")
def vote_violations(spark, d):
    return L.vote_violations(_t(spark, d, "toldbr_votes"))


@query(f"""WITH m(source_dataset, policy, label_original, mapped) AS (VALUES {_MAPS}) SELECT source_dataset, policy, count(*) AS n, NOT (source_dataset IN ({", ".join(f"'{x}'" for x in L.PROBE_GATED)}) OR (source_dataset || ' ' || policy) IN ({", ".join(f"'{a} {b}'" for a, b in L.AUXILIARY)})) AS "primary"
 FROM corpus_strict JOIN m USING (source_dataset, label_original) GROUP BY ALL""")
def gated_corpus(spark, d):
    return L.gated(corpus(spark, d)).groupBy("source_dataset", "policy", "primary").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE WHEN trim(text_clean) <> '' THEN text_clean WHEN trim(text) <> '' THEN text ELSE '' END AS text FROM corpus_strict")
def coalesce_nonblank(spark, d):
    return corpus(spark, d).select("id", L.first_nonblank(F.col("text_clean"), F.col("text")).alias("text"))


@query("SELECT id, CASE WHEN trim(label_original) = '0' THEN 'neither' WHEN trim(label_original) = '-1' THEN 'offensive_nothate' WHEN label_original IS NOT NULL THEN 'hate' END AS three_way FROM corpus_strict")
def code_three_way(spark, d):
    return corpus(spark, d).select("id", L.three_way(F.col("label_original")).alias("three_way"))


@query("SELECT label_original AS label, count(*) AS n FROM corpus_strict WHERE label_original IS NULL OR label_original NOT IN ('hate', 'neither', 'offensive_nothate') GROUP BY ALL")
def unknown_labels(spark, d):
    return L.unknown_labels(corpus(spark, d), ["hate", "neither", "offensive_nothate"], "label_original").select("label", "n")


@query("""SELECT count(*) AS n_rows, count(DISTINCT id) AS n_ids, count(id) - count(DISTINCT id) AS duplicate_ids, count(*) FILTER (trim(coalesce(text, '')) = '') AS empty_text, count(*) FILTER (label_original IS NULL) AS null_label FROM corpus_strict""")
def schema_validation(spark, d):
    return L.validate(corpus(spark, d))


@query("""SELECT 'vidgen_' || row_no AS id, trim(coalesce(text, '')) AS text, trim(label) AS label_original, 'en' AS language, 'vidgen' AS source_dataset, 'synthetic' AS domain FROM vidgen_pairs""")
def interim_vidgen(spark, d):
    return L.interim(_t(spark, d, "vidgen_pairs"), "vidgen", "en", "synthetic", "text", "label", "row_no")


# ---- text ----
def _clean_sql(col: str, heavy: bool) -> str:
    # the engine's pattern flags stand at the start of a pattern; its \\x{..} escapes are the same
    t = f"regexp_replace(nfc_normalize(coalesce({col}, '')), '{T.CONTROL}', ' ', 'g')"
    t = f"regexp_replace({t}, '{T.RETWEET}', '', 'g')"
    t = f"regexp_replace({t}, '{T.URL}', ' <url> ', 'g')"
    t = f"regexp_replace({t}, '{T.MENTION}', ' <user> ', 'g')"
    t = f"regexp_replace({t}, '{T.HASHTAG}', '\\1', 'g')"
    if heavy:
        t = f"regexp_replace(lower(regexp_replace({t}, '{T.EMOJI}', '', 'g')), '{T.PUNCTUATION}', ' ', 'g')"
    return f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'), ' ')"


@query(f"SELECT id, {_clean_sql('text', False)} AS cleaned FROM corpus_strict")
def clean_light(spark, d):
    return corpus(spark, d).select("id", T.clean(F.col("text"), T.LIGHT).alias("cleaned"))


@query(f"SELECT id, {_clean_sql('text', True)} AS cleaned FROM corpus_strict")
def clean_heavy(spark, d):
    return corpus(spark, d).select("id", T.clean(F.col("text"), T.HEAVY).alias("cleaned"))


@query(f"SELECT id, len({_TOK}) AS n_tokens FROM corpus_strict")
def token_counts(spark, d):
    return corpus(spark, d).select("id", T.token_count(F.col("text_clean")).cast("long").alias("n_tokens"))


_LT = "regexp_extract_all(lower(coalesce(text_clean, '')), '\\p{L}{2,}')"


@query(f"""WITH t AS (SELECT {_LT} AS t FROM corpus_strict), g AS (SELECT unnest(list_concat(t, list_transform(range(1, len(t)), i -> t[i] || ' ' || t[i + 1]))) AS gram FROM t)
 SELECT gram, count(*) AS n FROM g GROUP BY ALL""")
def ngram_counts(spark, d):
    grams = T.ngrams(T.letter_tokens(F.col("text_clean")), 1, 2)
    return corpus(spark, d).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH w AS (SELECT unnest({_LT}) AS w FROM corpus_strict), p AS (SELECT ' ' || w || ' ' AS p, count(*) AS k FROM w GROUP BY ALL),
 g AS (SELECT unnest(list_transform(range(1, greatest(length(p) - 2, 1) + 1), i -> substr(p, i, 3))) AS gram, k FROM p UNION ALL SELECT unnest(list_transform(range(1, greatest(length(p) - 3, 1) + 1), i -> substr(p, i, 4))) AS gram, k FROM p)
 SELECT gram, sum(k)::BIGINT AS n FROM g GROUP BY ALL""")
def charwb_grams(spark, d):
    words = corpus(spark, d).select(F.explode(T.letter_tokens(F.col("text_clean"))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("k"))
    return words.select("k", F.explode(T.word_bounded_chars(F.array("w"), 3, 4)).alias("gram")).groupBy("gram").agg(F.sum("k").alias("n"))


@query(f"SELECT source_dataset, count(*) AS n, count(*) FILTER (regexp_matches(text_clean, '{T.MOJIBAKE}')) AS garbled FROM corpus_strict GROUP BY ALL")
def mojibake_audit(spark, d):
    return corpus(spark, d).groupBy("source_dataset").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.col("text_clean").rlike(T.MOJIBAKE).cast("long")), F.lit(0)).alias("garbled"))


@query("""SELECT id, sha256(coalesce(text_clean, '')) AS sha256, sha1(coalesce(text_clean, '')) AS text_key FROM corpus_strict""")
def text_hashes(spark, d):
    t = F.coalesce("text_clean", F.lit(""))
    return corpus(spark, d).select("id", F.sha2(t, 256).alias("sha256"), T.text_key(t).alias("text_key"))


@query()
def accent_stripping(spark, d):
    return corpus(spark, d).select("id", T.strip_accents(F.col("text_clean")).alias("plain"))


@query(f"""WITH t AS (SELECT DISTINCT text_clean AS t FROM corpus_strict WHERE length(text_clean) > 0)
 SELECT t AS text_clean, len(list_distinct(list_transform(range(1, greatest(length(t) - 4, 1) + 1), i -> substr(t, i, 5))))::BIGINT AS n_shingles FROM t""")
def shingle_counts(spark, d):
    t = corpus(spark, d).where("length(text_clean) > 0").select("text_clean").distinct()
    return t.select("text_clean", F.size(T.shingles(F.col("text_clean"), 5)).cast("long").alias("n_shingles"))


# ---- duplicates and splits ----
_KEY = f"trim(regexp_replace(lower(nfc_normalize(coalesce(text_clean, ''))), '{WS}+', ' ', 'g'), ' ')"


@query(f"""SELECT id, label, label_confidence FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY (coalesce(label_confidence, '') = 'high') DESC, id) AS rn FROM corpus_strict) WHERE rn = 1""")
def exact_dedup(spark, d):
    c = corpus(spark, d).select("id", "text_clean", "label", "label_confidence")
    return D.exact_duplicates(c, form="NFC").select("id", "label", "label_confidence")


_NEAR = f"""k AS (SELECT {_KEY} AS text, min(id) AS id FROM corpus_strict GROUP BY 1 HAVING {_KEY} <> ''),
 s AS (SELECT id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), i -> substr(text, i, 5)))) AS g FROM k), z AS (SELECT id, count(*) AS n FROM s GROUP BY id),
 f AS (SELECT s.*, row_number() OVER (PARTITION BY s.id ORDER BY q.df, s.g) AS r, z.n FROM s JOIN (SELECT g, count(*) AS df FROM s GROUP BY g) q USING (g) JOIN z ON z.id = s.id),
 c AS (SELECT DISTINCT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb FROM f a JOIN f b ON a.g = b.g AND a.id < b.id WHERE a.r <= a.n - ceil(0.9 * a.n) + 1 AND b.r <= b.n - ceil(0.9 * b.n) + 1 AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)),
 j AS (SELECT id_a, id_b, count(*) AS i, max(na) AS na, max(nb) AS nb FROM c JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b AND x.g = y.g GROUP BY id_a, id_b),
 np AS (SELECT id_a, id_b, i / (na + nb - i) AS jaccard FROM j WHERE i / (na + nb - i) >= 0.9)"""


@query(f"WITH {_NEAR} SELECT id_a, id_b, round(jaccard, 9) AS jaccard FROM np")
def near_dup_pairs(spark, d):
    c = corpus(spark, d).select("id", T.dedup_key(F.col("text_clean"), "NFC").alias("text")).where("text <> ''").groupBy("text").agg(F.min("id").alias("id"))
    return rounded(D.near_pairs(c))


@query(f"""WITH RECURSIVE {_NEAR}, m AS (SELECT c.id, coalesce(k.id, c.id) AS first FROM corpus_strict c LEFT JOIN k ON k.text = {_KEY.replace("text_clean", "c.text_clean")}),
 p AS (SELECT DISTINCT 'vidgen_' || row_no AS id, trim(acl_id) AS own, trim(acl_id_matched) AS m FROM vidgen_pairs WHERE 'vidgen_' || row_no IN (SELECT id FROM corpus_strict)),
 l AS (SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.m = y.own WHERE lower(coalesce(x.m, '')) NOT IN ('', 'na', 'n/a', 'none', 'nan', 'null')),
 e AS (SELECT id_a AS a, id_b AS b FROM np UNION SELECT x.first, y.first FROM l JOIN m x ON x.id = l.a JOIN m y ON y.id = l.b), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
 r AS (SELECT a AS n, a AS root FROM u UNION SELECT r.n, u.b FROM r JOIN u ON u.a = r.root), t AS (SELECT n, min(root) AS root FROM r GROUP BY n)
 SELECT m.id, coalesce(t.root, m.first) AS cluster FROM m LEFT JOIN t ON t.n = m.first""")
def near_dup_clusters(spark, d):
    c = corpus(spark, d)
    return D.near_clusters(c, links=D.pair_links(c, _t(spark, d, "vidgen_pairs")), form="NFC")


@query(f"SELECT count(*) AS rows_in, count(*) - count(DISTINCT {_KEY}) AS exact_removed, count(DISTINCT {_KEY}) AS rows_after_exact FROM corpus_strict")
def dedup_counts(spark, d):
    c = corpus(spark, d)
    left = D.exact_duplicates(c.select("id", "text_clean", "label_confidence"), form="NFC").agg(F.count(F.lit(1)).alias("rows_after_exact"))
    return c.agg(F.count(F.lit(1)).alias("rows_in")).join(left).select("rows_in", (F.col("rows_in") - F.col("rows_after_exact")).alias("exact_removed"), "rows_after_exact")


RATIOS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


@query()
def make_splits(spark, d):
    return S.make_splits(corpus(spark, d), _t(spark, d, "vidgen_pairs"), RATIOS)[0]


@query()
def split_statistics(spark, d):
    return S.make_splits(corpus(spark, d), _t(spark, d, "vidgen_pairs"), RATIOS)[1]


@query("SELECT concat_ws('|', coalesce(language, '?'), coalesce(source_dataset, '?'), coalesce(label::VARCHAR, '?')) AS stratum, count(*) AS n FROM corpus_strict GROUP BY ALL")
def stratum_counts(spark, d):
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("language", "source_dataset", "label")])
    return corpus(spark, d).groupBy(key.alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT 'vidgen_' || row_no AS id, trim(acl_id) AS own, trim(acl_id_matched) AS m FROM vidgen_pairs WHERE 'vidgen_' || row_no IN (SELECT id FROM corpus_strict))
 SELECT DISTINCT x.id AS a, y.id AS b FROM p x JOIN p y ON x.m = y.own WHERE lower(coalesce(x.m, '')) NOT IN ('', 'na', 'n/a', 'none', 'nan', 'null')""")
def derived_links(spark, d):
    return D.pair_links(corpus(spark, d), _t(spark, d, "vidgen_pairs"))


@query(f"""WITH c AS (SELECT *, md5({_KEY}) AS k FROM corpus_strict WHERE split IS NOT NULL), t AS (SELECT 'text' AS kind, k, min(split) AS lo, max(split) AS hi FROM c GROUP BY ALL UNION ALL
 SELECT 'cluster', dup_cluster_id::VARCHAR, min(split), max(split) FROM c WHERE dup_cluster_id IS NOT NULL GROUP BY ALL) SELECT kind, count(*) AS n_groups, count(*) FILTER (lo <> hi) AS n_leaking FROM t GROUP BY ALL""")
def leakage_gate(spark, d):
    return D.leaks(corpus(spark, d))


_U = "('0x' || substr(md5('42|' || coalesce(dup_cluster_id::VARCHAR, id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE"


@query(f"SELECT id, CASE WHEN {_U} < 0.7 THEN 'train' WHEN {_U} < 0.85 THEN 'val' ELSE 'test' END AS split_to FROM corpus_strict")
def group_split(spark, d):
    group = F.coalesce(F.col("dup_cluster_id").cast("string"), F.col("id"))
    return S.group_split(corpus(spark, d), group, RATIOS).select("id", "split_to")


@query()
def stratified_group_split(spark, d):
    c = corpus(spark, d)
    groups = keep(S.related(c, _t(spark, d, "vidgen_pairs")), "related")
    return S.stratified_group_split(c, groups, ["language", "source_dataset", "label"], RATIOS)


@query("""WITH r AS (SELECT substr(md5(id), 1, 2) AS bucket, md5(id || ':' || coalesce(split, '')) AS h FROM corpus_strict)
 SELECT bucket, count(*) AS n, sum(('0x' || substr(h, 1, 8))::BIGINT)::VARCHAR AS digest_a, sum(('0x' || substr(h, 9, 8))::BIGINT)::VARCHAR AS digest_b FROM r GROUP BY ALL""")
def split_manifest(spark, d):
    return sinks.manifest(corpus(spark, d))


@query("""SELECT id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5('42|' || id), id) - 1) % 5)::INTEGER AS fold FROM corpus_strict""")
def stratified_folds(spark, d):
    return S.stratified_folds(corpus(spark, d).select("id", "label"))


@query("SELECT id, label_original FROM (SELECT *, row_number() OVER (PARTITION BY label_original ORDER BY md5('42|' || id), id) AS rn FROM corpus_strict) WHERE rn <= 50")
def stratified_sample(spark, d):
    return A.hash_sample(corpus(spark, d).select("id", "label_original"), "label_original", 50)


# ---- evaluation ----
@query(f"{PL}, c AS (SELECT model_id, split, {CELLS} FROM pl WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL) SELECT model_id, split, tp, fp, fn, tn, {METRICS} FROM c")
def confusion_metrics(spark, d):
    return rounded(E.classification(preds(spark, d), ["model_id", "split"]))


_BYSCORE = "s AS (SELECT model_id, split, y_score, sum(y_true)::DOUBLE AS pos, sum(1 - y_true)::DOUBLE AS neg FROM pl WHERE y_true IS NOT NULL AND y_score IS NOT NULL GROUP BY ALL)"


@query(f"""{PL}, {_BYSCORE}, w AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model_id, split ORDER BY y_score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s)
 SELECT model_id, split, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM w GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""")
def roc_auc(spark, d):
    return rounded(E.areas(preds(spark, d), ["model_id", "split"]).where("roc_auc is not null").select("model_id", "split", "roc_auc"))


@query(f"""{PL}, {_BYSCORE}, w AS (SELECT *, sum(pos) OVER o AS tp, sum(pos + neg) OVER o AS al FROM s WINDOW o AS (PARTITION BY model_id, split ORDER BY y_score DESC ROWS UNBOUNDED PRECEDING))
 SELECT model_id, split, round(sum(pos * tp / al) / sum(pos), 9) AS pr_auc FROM w GROUP BY ALL HAVING sum(pos) > 0 AND sum(neg) > 0""")
def average_precision(spark, d):
    return rounded(E.areas(preds(spark, d), ["model_id", "split"]).where("pr_auc is not null").select("model_id", "split", "pr_auc"))


@query(f"""{PL}, x AS (SELECT model_id, 'language' AS dimension, language AS value, y_true, y_pred FROM pl UNION ALL SELECT model_id, 'source_dataset', source_dataset, y_true, y_pred FROM pl),
 c AS (SELECT model_id, dimension, value, {CELLS} FROM x WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL)
 SELECT model_id, dimension, value, tp+fp+fn+tn AS n, tp+fn AS n_hate, round(({F1H} + {F1N}) / 2, 9) AS macro_f1, round({R("tp", "tp+fn")}, 9) AS recall_hate FROM c""")
def breakdown_slices(spark, d):
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("dimension"), F.col(s).alias("value")) for s in ("language", "source_dataset")])).alias("s")
    rows = preds(spark, d).select("model_id", "y_true", "y_pred", each).select("model_id", "s.dimension", "s.value", "y_true", "y_pred")
    return rounded(E.classification(rows, ["model_id", "dimension", "value"]).select("model_id", "dimension", "value", "n", "n_hate", "macro_f1", "recall_hate"))


_SCALED = "e AS (SELECT model_id, split, min(y_score) AS lo, max(y_score) AS hi FROM pl WHERE y_true IS NOT NULL GROUP BY ALL), p AS (SELECT pl.*, CASE WHEN hi > lo THEN (y_score - lo) / (hi - lo) ELSE 0.5 END AS p FROM pl JOIN e USING (model_id, split) WHERE y_score IS NOT NULL AND y_true IS NOT NULL)"
_EDGES = "[" + ", ".join(f"({k / 10!r})::DOUBLE" for k in range(1, 10)) + "]"
_BINS = f"b AS (SELECT model_id, split, len(list_filter({_EDGES}, x -> x <= p))::INTEGER AS bin, count(*) AS n, avg(p) AS confidence, avg(y_true) AS accuracy FROM p GROUP BY ALL)"


@query(f"""{PL}, {_SCALED}, {_BINS} SELECT m.model_id, m.split, r.bin::INTEGER AS bin, coalesce(b.n, 0) AS n, round(confidence, 9) AS confidence, round(accuracy, 9) AS accuracy
 FROM (SELECT DISTINCT model_id, split FROM p) m CROSS JOIN (SELECT unnest(range(10)) AS bin) r LEFT JOIN b ON b.model_id = m.model_id AND b.split = m.split AND b.bin = r.bin""")
def calibration_bins(spark, d):
    return rounded(E.calibration_bins(preds(spark, d), ["model_id", "split"]))


@query(f"""{PL}, {_SCALED}, {_BINS}, g AS (SELECT model_id, split, sum(n * abs(confidence - accuracy)) / sum(n) AS ece, max(abs(confidence - accuracy)) AS mce FROM b GROUP BY ALL)
 SELECT g.model_id, g.split, round(ece, 6) AS ece, round(mce, 6) AS mce, round(brier, 6) AS brier FROM g JOIN (SELECT model_id, split, avg((p - y_true) * (p - y_true)) AS brier FROM p GROUP BY ALL) USING (model_id, split)""")
def calibration_summary(spark, d):
    return rounded(E.calibration(preds(spark, d), ["model_id", "split"]), 6)


_MC = f"""{PL}, o AS (SELECT split, id, model_id, y_true = y_pred AS ok FROM pl WHERE y_true IS NOT NULL AND y_pred IS NOT NULL),
 k AS (SELECT a.split, a.model_id AS model_a, b.model_id AS model_b, count(*) FILTER (a.ok AND NOT b.ok) AS a_only_correct, count(*) FILTER (b.ok AND NOT a.ok) AS b_only_correct FROM o a JOIN o b ON a.split = b.split AND a.id = b.id AND a.model_id < b.model_id GROUP BY ALL),
 q AS (SELECT *, CASE WHEN a_only_correct = b_only_correct THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(a_only_correct, b_only_correct) + 1),
 i -> exp(lgamma((a_only_correct + b_only_correct + 1)::DOUBLE) - lgamma((i + 1)::DOUBLE) - lgamma((a_only_correct + b_only_correct - i + 1)::DOUBLE) + (a_only_correct + b_only_correct) * ln(0.5))))) END AS p_value FROM k)"""


@query(f"{_MC} SELECT split, model_a, model_b, a_only_correct, b_only_correct, round(p_value, 6) AS p_value FROM q")
def mcnemar(spark, d):
    return rounded(E.mcnemar(preds(spark, d)), 6)


@query(f"""{_MC}, r AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(p_value, 12), model_a, model_b) AS k, count(*) OVER (PARTITION BY split) AS m FROM q)
 SELECT split, model_a, model_b, min((p_value <= 0.05 / (m - k + 1))::INTEGER) OVER (PARTITION BY split ORDER BY k ROWS UNBOUNDED PRECEDING) = 1 AS significant_holm FROM r""")
def holm(spark, d):
    p = E.mcnemar(preds(spark, d)).withColumn("p_value", F.round("p_value", 12))
    return E.holm(p, ["split"]).select("split", "model_a", "model_b", "significant_holm")


_PROBS = [0.025, 0.25, 0.5, 0.75, 0.95]


@query(f"{PL} SELECT model_id, split, q, round(value, 9) AS value FROM (" + " UNION ALL ".join(f"SELECT model_id, split, ({p})::DOUBLE AS q, quantile_cont(y_score, {p}) AS value FROM pl WHERE y_score IS NOT NULL GROUP BY model_id, split" for p in _PROBS) + ")")
def score_quantiles(spark, d):
    return rounded(E.quantiles(preds(spark, d), ["model_id", "split"], _PROBS))


def _threshold_sql(cuts: str, by: str = "model_id, split") -> str:
    keys = [k.strip() for k in by.split(",")]
    on = " AND ".join(f"c.{k} IS NOT DISTINCT FROM s.{k}" for k in keys)
    c = ", ".join(f"c.{k}" for k in keys)
    return f"""s AS (SELECT * FROM pl WHERE y_true IS NOT NULL AND y_score IS NOT NULL), {cuts},
 h AS (SELECT {c}, c.cut, count(*) FILTER (y_true = 1 AND y_score >= cut) AS tp, count(*) FILTER (y_true = 0 AND y_score >= cut) AS fp, count(*) FILTER (y_true = 1 AND y_score < cut) AS fn, count(*) FILTER (y_true = 0 AND y_score < cut) AS tn FROM cuts c JOIN s ON {on} GROUP BY ALL),
 f AS (SELECT {by}, cut, round(({F1H} + {F1N}) / 2, 9) AS macro_f1 FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY macro_f1 DESC, cut) AS rn FROM f)
 SELECT {by}, cut AS threshold, macro_f1 FROM r WHERE rn = 1"""


_QCUTS = lambda by, n, lo, step: f"cuts AS (SELECT DISTINCT {by}, round(lo + (r - floor(r)) * (hi - lo), 9) AS cut FROM (SELECT {by}, r, v[floor(r)::BIGINT + 1] AS lo, v[least(floor(r)::BIGINT + 2, len(v))] AS hi FROM (SELECT {by}, v, unnest(list_transform(range(0, {n}), k -> round({lo} + {step} * k, 6) * (len(v) - 1))) AS r FROM (SELECT {by}, list_sort(list(y_score)) AS v FROM s GROUP BY ALL))))"  # noqa: E731, E501


@query(f"{PL}, {_threshold_sql(_QCUTS('model_id, split', 97, 0.02, 0.01))}")
def threshold_search(spark, d):
    return rounded(E.best_threshold(preds(spark, d), ["model_id", "split"]))


@query(f"{PL}, {_threshold_sql(_QCUTS('model_id, language', 97, 0.02, 0.01), 'model_id, language')}")
def threshold_per_language(spark, d):
    p = preds(spark, d).withColumn("language", F.coalesce("language", F.lit("\x00")))
    out = rounded(E.best_threshold(p, ["model_id", "language"]))
    return out.withColumn("language", F.when(F.col("language") != "\x00", F.col("language")))


@query(f"{PL}, {_threshold_sql(_QCUTS('model_id, split', 200, 0.30, 0.695 / 199))}")
def threshold_stack_cuts(spark, d):
    return rounded(E.best_threshold(preds(spark, d), ["model_id", "split"], [round(0.30 + 0.695 / 199 * k, 6) for k in range(200)]))


_VAL_CUT = _threshold_sql(_QCUTS("model_id, language", 97, 0.02, 0.01), "model_id, language").replace("FROM pl WHERE", "FROM pl WHERE split = 'val' AND language IS NOT NULL AND")


@query(f"""{PL}, {_VAL_CUT.replace(" SELECT model_id, language, cut AS threshold, macro_f1 FROM r WHERE rn = 1", ", lt AS (SELECT model_id, language, cut AS language_threshold FROM r WHERE rn = 1)")},
 te AS (SELECT p.*, g.threshold, lt.language_threshold FROM pl p JOIN registry g USING (model_id) JOIN lt ON lt.model_id = p.model_id AND lt.language = p.language WHERE p.split = 'test' AND p.y_score IS NOT NULL AND p.y_true IS NOT NULL),
 q AS (SELECT model_id, language, threshold, language_threshold, count(*) AS n, {", ".join(f"count(*) FILTER (y_true = {t} AND (y_score >= {c})::INTEGER = {v}) AS {n}_{k}" for k, c in (("w", "threshold"), ("l", "language_threshold")) for n, t, v in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0)))} FROM te GROUP BY ALL)
 SELECT model_id, language, n, threshold, language_threshold, {", ".join(f"round(({R(f'2*tp_{k}', f'2*tp_{k}+fp_{k}+fn_{k}')} + {R(f'2*tn_{k}', f'2*tn_{k}+fn_{k}+fp_{k}')}) / 2, 6) AS macro_f1_{n}, round({R(f'tp_{k}', f'tp_{k}+fn_{k}')}, 6) AS recall_hate_{n}" for k, n in (("w", "whole"), ("l", "language")))},
 round(({R("2*tp_l", "2*tp_l+fp_l+fn_l")} + {R("2*tn_l", "2*tn_l+fn_l+fp_l")}) / 2 - ({R("2*tp_w", "2*tp_w+fp_w+fn_w")} + {R("2*tn_w", "2*tn_w+fn_w+fp_w")}) / 2, 6) AS gain FROM q""")
def language_threshold_gap(spark, d):
    return rounded(A.thresholds_by_language(preds(spark, d), _t(spark, d, "registry").select("model_id", "threshold")), 6)


@query(f"{PL} SELECT model_id, language, round(quantile_cont(y_score, 0.25), 9) AS p25, round(quantile_cont(y_score, 0.5), 9) AS p50, round(quantile_cont(y_score, 0.75), 9) AS p75 FROM pl WHERE y_true = 1 AND y_pred = 0 AND y_score IS NOT NULL GROUP BY ALL")
def fn_quartiles(spark, d):
    return rounded(A.false_negative_quartiles(preds(spark, d)))


_GRID = [round(0.05 + 0.005 * k, 3) for k in range(181)]


@query(f"{PL}, {_threshold_sql('cuts AS (SELECT DISTINCT model_id, split, g AS cut FROM s CROSS JOIN (SELECT unnest([' + ', '.join(f'({g!r})::DOUBLE' for g in _GRID) + ']) AS g))')}")
def threshold_grid(spark, d):
    return rounded(E.best_threshold(preds(spark, d), ["model_id", "split"], grid=_GRID))


@query()
def bootstrap_ci(spark, d):
    return E.bootstrap(preds(spark, d), ["model_id", "split"])


@query("SELECT label, count(*) AS n, round((SELECT count(label) FROM corpus_strict) / (2.0::DOUBLE * count(*)), 9) AS weight FROM corpus_strict WHERE label IS NOT NULL GROUP BY ALL")
def class_weights(spark, d):
    return rounded(E.class_weights(corpus(spark, d)))


# ---- analyses ----
# Groups that the tables speak of.
GROUP_TERMS = {
    "velmari": {"en": ["velmari", "velmaris"], "pt": ["velmari", "velmaris"]},
    "quilarian": {"en": ["quilarian", "quilarians"], "pt": ["quilário", "quilários"]},
    "tamberite": {"en": ["tamberite", "tamberites"], "pt": ["tamberita", "tamberitas"]},
    "drovian": {"en": ["drovian", "drovians"], "pt": ["droviano", "drovianos"]},
    "norvic": {"en": ["norvic", "norvics", "norviches"], "pt": ["norvic", "norviches"]},
}


def _terms_sql(terms: dict = GROUP_TERMS) -> str:
    parts = []
    for g, by in terms.items():
        alt = " OR ".join(f"(language = '{lang}' AND regexp_matches(lower(coalesce(text_clean, '')), '{T.word_pattern(w)}'))" for lang, w in by.items())
        parts.append(f"SELECT *, '{g}' AS \"group\" FROM n WHERE {alt}")
    return " UNION ALL ".join(parts)


_BIAS = f"""{PL}, n AS (SELECT pl.*, c.text_clean FROM pl LEFT JOIN corpus_strict c USING (id) WHERE y_true = 0 AND y_pred IS NOT NULL), bg AS (SELECT model_id, sum(y_pred)::DOUBLE / count(*) AS bg FROM n GROUP BY ALL),
 g AS ({_terms_sql()}), o AS (SELECT model_id, "group", count(*) AS n_nonhate_mentions, round(sum(y_pred)::DOUBLE / count(*), 4) AS group_fpr, round(max(bg), 4) AS background_fpr, round(sum(y_pred)::DOUBLE / count(*) - max(bg), 4) AS fpr_gap,
 round(sum(y_score) / count(y_score), 4) AS mean_score FROM g JOIN bg USING (model_id) GROUP BY ALL)"""


@query(f"{_BIAS} SELECT * FROM o")
def bias_probe(spark, d):
    return A.bias_probe(preds(spark, d), corpus(spark, d), terms=GROUP_TERMS)


@query(f"{_BIAS} SELECT * FROM o ORDER BY fpr_gap DESC NULLS LAST, model_id, \"group\" LIMIT 15")
def bias_top_gaps(spark, d):
    return A.largest(A.bias_probe(preds(spark, d), corpus(spark, d), terms=GROUP_TERMS), "fpr_gap", 15, ["model_id", "group"])


@query(f"{_BIAS} SELECT model_id, round(avg(fpr_gap), 9) AS mean_gap FROM o GROUP BY ALL")
def mean_bias_gap(spark, d):
    return A.bias_probe(preds(spark, d), corpus(spark, d), terms=GROUP_TERMS).groupBy("model_id").agg(F.round(F.avg("fpr_gap"), 9).alias("mean_gap"))


_ERR = f"""{PL}, {_PROF}, x AS (SELECT pl.*, c.text_clean, c.lang_pred, len({_TOK.replace("text_clean", "c.text_clean")}) AS n_tokens, list_has_any(list_transform({_TOK.replace("text_clean", "c.text_clean")}, x -> lower(x)), (SELECT list(token) FROM p)) AS prof,
 CASE WHEN y_true = 1 AND y_pred = 0 THEN 'false_negative' WHEN y_true = 0 AND y_pred = 1 THEN 'false_positive' ELSE 'correct' END AS kind FROM pl LEFT JOIN corpus_strict c USING (id) WHERE y_pred IS NOT NULL)"""


def _errors(spark, d):
    return A.error_frame(preds(spark, d), corpus(spark, d), X.profanity(_t(spark, d, "lexicon")))


@query(f"""{_ERR} SELECT model_id, count(*) FILTER (kind <> 'correct') AS n_errors, count(*) FILTER (kind = 'false_negative') AS false_negatives, count(*) FILTER (kind = 'false_positive') AS false_positives,
 count(*) FILTER (kind = 'false_negative' AND NOT prof) AS implicit_hate_fn, count(*) FILTER (kind = 'false_positive' AND prof) AS slur_overflag_fp, count(*) FILTER (kind <> 'correct' AND n_tokens < 4) AS short_text_errors,
 count(*) FILTER (kind <> 'correct' AND lang_pred IS DISTINCT FROM language) AS langid_mismatch_errors FROM x GROUP BY ALL""")
def error_modes(spark, d):
    return A.error_modes(_errors(spark, d))


@query(f"""{PL}, x AS (SELECT model_id, 'language' AS dimension, language AS value, y_true, y_pred FROM pl UNION ALL SELECT model_id, 'source_dataset', source_dataset, y_true, y_pred FROM pl)
 SELECT model_id, dimension, value, count(*) AS n, round(count(*) FILTER (y_true <> y_pred)::DOUBLE / count(*), 4) AS error_rate, round({R("count(*) FILTER (y_true = 1 AND y_pred = 0)", "sum(y_true)")}, 4) AS fn_rate,
 round({R("count(*) FILTER (y_true = 0 AND y_pred = 1)", "count(*) - sum(y_true)")}, 4) AS fp_rate FROM x WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL""")
def error_rates(spark, d):
    return A.error_rates(preds(spark, d))


@query(f"""{_ERR}, r AS (SELECT *, row_number() OVER (PARTITION BY model_id, kind ORDER BY CASE WHEN kind = 'false_negative' THEN y_score ELSE -y_score END, id) AS rank FROM x WHERE kind <> 'correct' AND y_score IS NOT NULL)
 SELECT model_id, kind, rank::INTEGER AS rank, id, round(y_score, 3) AS score, substr(replace(replace(coalesce(text_clean, ''), chr(10), ' '), '|', '\\|'), 1, 200) AS example FROM r WHERE rank <= 20""")
def error_examples(spark, d):
    return A.error_examples(_errors(spark, d))


@query(f"""{PL}, x AS (SELECT *, unnest(list_filter([CASE WHEN language = 'en' THEN 'en' END, CASE WHEN language = 'pt' THEN 'pt' END, CASE WHEN source_dataset = 'vidgen' THEN 'adversarial' ELSE 'rest' END], z -> z IS NOT NULL)) AS slice FROM pl),
 c AS (SELECT model_id, slice, {CELLS} FROM x WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL) SELECT model_id, slice, tp, fp, fn, tn, {METRICS} FROM c""")
def overlapping_slices(spark, d):
    return rounded(A.overlapping_slices(preds(spark, d)))


_SOURCES = ("toldbr", "vidgen", "hatebr", "hatexplain", "tweets_ip", "pt_fortuna")


@query(f"""{PL}, c AS (SELECT model_id, source_dataset, {CELLS} FROM pl WHERE y_true IS NOT NULL AND y_pred IS NOT NULL GROUP BY ALL), f AS (SELECT model_id, source_dataset, round(({F1H} + {F1N}) / 2, 9) AS f1 FROM c)
 SELECT model_id, {", ".join(f"max(f1) FILTER (source_dataset = '{s}') AS {s}" for s in _SOURCES)} FROM f GROUP BY ALL""")
def pivot_sources(spark, d):
    m = rounded(E.classification(preds(spark, d), ["model_id", "source_dataset"]))
    return m.groupBy("model_id").pivot("source_dataset", list(_SOURCES)).agg(F.first("macro_f1"))


@query(f"""{PL}, c AS (SELECT source_dataset, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn, count(*) FILTER (y_true = 1) AS pos, count(*) FILTER (y_true = 1 AND y_pred = 0 AND abs(y_score - threshold) <= 0.1) AS near, count(*) FILTER (y_true = 1 AND y_pred = 0 AND y_score < 0.1) AS low,
 model_id FROM pl JOIN registry USING (model_id) WHERE y_pred IS NOT NULL GROUP BY ALL) SELECT model_id, source_dataset, fn, pos, near, low, round({R("fn", "pos")}, 9) AS fn_rate FROM c""")
def fn_anatomy(spark, d):
    p = preds(spark, d).where("y_pred is not null").join(_t(spark, d, "registry").select("model_id", "threshold"), "model_id")
    fn = (F.col("y_true") == 1) & (F.col("y_pred") == 0)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    out = p.groupBy("model_id", "source_dataset").agg(n(fn).alias("fn"), n(F.col("y_true") == 1).alias("pos"), n(fn & (F.abs(F.col("y_score") - F.col("threshold")) <= 0.1)).alias("near"), n(fn & (F.col("y_score") < 0.1)).alias("low"))
    return out.withColumn("fn_rate", F.round(E.ratio(F.col("fn").cast("double"), F.col("pos").cast("double")), 9))


@query(f"""{PL}, v AS (SELECT model_id, id, split, y_true, (y_score >= threshold)::INTEGER AS y_new FROM pl JOIN registry USING (model_id) WHERE y_score IS NOT NULL) SELECT model_id, split, y_new, count(*) AS n, coalesce(sum(y_true), 0)::BIGINT AS n_hate FROM v GROUP BY ALL""")
def thresholding(spark, d):
    p = preds(spark, d).where("y_score is not null").join(_t(spark, d, "registry").select("model_id", "threshold"), "model_id")
    return p.withColumn("y_new", (F.col("y_score") >= F.col("threshold")).cast("int")).groupBy("model_id", "split", "y_new").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y_true"), F.lit(0)).alias("n_hate"))


# ---- registry and selection ----
@query("SELECT model_id, config, policy, seed, val_macro_f1, test_macro_f1, row_number() OVER (PARTITION BY policy ORDER BY test_macro_f1 DESC, model_id)::INTEGER AS rank FROM registry")
def leaderboard(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("policy").orderBy(F.desc("test_macro_f1"), "model_id")
    return _t(spark, d, "registry").select("model_id", "config", "policy", "seed", "val_macro_f1", "test_macro_f1", F.row_number().over(w).alias("rank"))


@query("SELECT policy, arg_max(model_id, test_macro_f1) AS model_id, max(test_macro_f1) AS test_macro_f1 FROM registry WHERE model_id IN (SELECT model_id FROM predictions) GROUP BY ALL")
def servable_best(spark, d):
    r = _t(spark, d, "registry").join(_t(spark, d, "predictions").select("model_id").distinct(), "model_id", "left_semi")
    return r.groupBy("policy").agg(F.max_by("model_id", "test_macro_f1").alias("model_id"), F.max("test_macro_f1").alias("test_macro_f1"))


@query(f"""{PL}, c AS (SELECT model_id, {CELLS} FROM pl WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND split = 'test' GROUP BY ALL), r AS (SELECT regexp_extract(r.model_id, '^[a-z0-9]+_[a-z0-9]+') AS family, config, policy, seed, test_macro_f1, round({R("tp", "tp+fn")}, 9) AS recall FROM registry r LEFT JOIN c USING (model_id))
 SELECT family, config, policy, count(DISTINCT seed) AS n_seeds, round(avg(test_macro_f1), 6) AS mean_f1, round(stddev_samp(test_macro_f1), 6) AS std_f1, round(stddev_pop(test_macro_f1), 6) AS std_pop, round(avg(recall), 6) AS mean_recall, round(stddev_samp(recall), 6) AS std_recall FROM r GROUP BY ALL""")
def seed_aggregate(spark, d):
    recall = rounded(E.classification(preds(spark, d).where("split = 'test'"), ["model_id"]).select("model_id", F.col("recall_hate").alias("recall")))
    r = _t(spark, d, "registry").withColumn("family", F.regexp_extract("model_id", "^[a-z0-9]+_[a-z0-9]+", 0)).join(recall, "model_id", "left")
    six = lambda c: F.round(c, 6)
    return r.groupBy("family", "config", "policy").agg(
        F.countDistinct("seed").alias("n_seeds"), six(F.avg("test_macro_f1")).alias("mean_f1"), six(F.stddev_samp("test_macro_f1")).alias("std_f1"), six(F.stddev_pop("test_macro_f1")).alias("std_pop"),
        six(F.avg("recall")).alias("mean_recall"), six(F.stddev_samp("recall")).alias("std_recall"),
    )


@query("SELECT config, max(test_macro_f1) FILTER (policy = 'strict') AS strict, max(test_macro_f1) FILTER (policy = 'broad') AS broad FROM registry GROUP BY ALL")
def pivot_policies(spark, d):
    return _t(spark, d, "registry").groupBy("config").pivot("policy", ["strict", "broad"]).agg(F.max("test_macro_f1"))


@query("SELECT model_id, config, policy, val_macro_f1 FROM (SELECT *, row_number() OVER (PARTITION BY config ORDER BY val_macro_f1 DESC, model_id DESC) AS rn FROM registry) WHERE rn = 1 ORDER BY val_macro_f1 DESC, config LIMIT 3")
def distinct_trials(spark, d):
    return A.distinct_top(_t(spark, d, "registry").select("model_id", "config", "policy", "val_macro_f1"), ["config"], "val_macro_f1", 3)


_EXPERIMENTS = {"en": ["vidgen", "hatexplain", "tweets_ip"], "pt": ["toldbr", "hatebr", "pt_fortuna"], "memes": ["memotion", "multioff"]}


@query("SELECT experiment, count(*) > 0 AND max(hit) = 1 AS present FROM (SELECT e.experiment, (c.source_dataset IS NOT NULL)::INTEGER AS hit FROM (VALUES " + ", ".join(f"('{k}', '{x}')" for k, v in _EXPERIMENTS.items() for x in v) + ") e(experiment, source) LEFT JOIN (SELECT DISTINCT source_dataset FROM corpus_strict) c ON c.source_dataset = e.source) GROUP BY ALL")
def sources_present(spark, d):
    return A.sources_present(corpus(spark, d), _EXPERIMENTS)


@query("SELECT r.model_id, policy, threshold, d.n AS n_test FROM registry r LEFT JOIN (SELECT model_id, count(*) AS n FROM predictions WHERE split = 'test' AND y_pred IS NOT NULL GROUP BY ALL) d USING (model_id)")
def flat_leaderboard(spark, d):
    m = _t(spark, d, "predictions").where("y_pred is not null").groupBy("model_id", "split").agg(F.count(F.lit(1)).alias("n"))
    docs = _t(spark, d, "registry").join(m.groupBy("model_id").agg(F.map_from_entries(F.collect_list(F.struct("split", F.struct("n")))).alias("splits")), "model_id", "left")  # a few splits a model
    return docs.select("model_id", "policy", "threshold", F.col("splits")["test"]["n"].alias("n_test"))


_SEL = f"""{_BIAS}, sc AS (SELECT model_id, min(y_score) AS lo, max(y_score) AS hi FROM pl WHERE y_true IS NOT NULL AND split = 'test' GROUP BY ALL),
 p AS (SELECT model_id, y_true, CASE WHEN hi > lo THEN (y_score - lo) / (hi - lo) ELSE 0.5 END AS p FROM pl JOIN sc USING (model_id) WHERE y_score IS NOT NULL AND y_true IS NOT NULL AND split = 'test'),
 b AS (SELECT model_id, len(list_filter({_EDGES}, x -> x <= p))::INTEGER AS bin, count(*) AS n, avg(p) AS confidence, avg(y_true) AS accuracy FROM p GROUP BY ALL),
 e AS (SELECT model_id, sum(n * abs(confidence - accuracy)) / sum(n) AS ece FROM b GROUP BY ALL), bm AS (SELECT model_id, avg(fpr_gap) AS bias_gap FROM o GROUP BY ALL), c AS (SELECT model_id, {CELLS} FROM pl WHERE y_true IS NOT NULL AND y_pred IS NOT NULL AND split = 'test' GROUP BY ALL),
 t AS (SELECT model_id, round(({F1H} + {F1N}) / 2, 9) AS macro_f1, round({R("tp", "tp+fn")}, 9) AS recall_hate, round(bias_gap, 9) AS bias_gap, round(e.ece, 9) AS ece, threshold FROM c LEFT JOIN bm USING (model_id) LEFT JOIN registry USING (model_id) LEFT JOIN e ON e.model_id = c.model_id)"""


def selection(spark, d):
    p = preds(spark, d)
    test = p.where("split = 'test'")
    q = rounded(E.classification(test, ["model_id"]).select("model_id", "macro_f1", "recall_hate"))
    gap = A.bias_probe(p, corpus(spark, d), terms=GROUP_TERMS).groupBy("model_id").agg(F.round(F.avg("fpr_gap"), 9).alias("bias_gap"))
    ece = rounded(E.calibration(test, ["model_id"]).select("model_id", "ece"))
    return A.model_table(q, gap, ece, _t(spark, d, "registry").select("model_id", "threshold"))


@query(f"{_SEL} SELECT * FROM t")
def model_selection(spark, d):
    return selection(spark, d)


@query(f"""{_SEL}, w AS (SELECT * FROM t WHERE macro_f1 IS NOT NULL AND recall_hate IS NOT NULL AND bias_gap IS NOT NULL AND ece IS NOT NULL) SELECT * FROM w x WHERE NOT EXISTS (SELECT 1 FROM w y WHERE y.macro_f1 >= x.macro_f1 AND y.recall_hate >= x.recall_hate AND y.bias_gap <= x.bias_gap AND y.ece <= x.ece
 AND (y.macro_f1 > x.macro_f1 OR y.recall_hate > x.recall_hate OR y.bias_gap < x.bias_gap OR y.ece < x.ece))""")
def pareto_front(spark, d):
    return A.pareto_front(selection(spark, d), ["macro_f1", "recall_hate"], ["bias_gap", "ece"])


@query("""SELECT coalesce(r.model_id, p.model_id) AS model_id, CASE WHEN p.model_id IS NOT NULL THEN 'new' ELSE r.config END AS config FROM (SELECT DISTINCT model_id FROM predictions) p FULL JOIN registry r USING (model_id)""")
def registry_upsert(spark, d):
    new = _t(spark, d, "predictions").select("model_id").distinct().withColumn("config", F.lit("new"))
    return sinks.registry_upsert(_t(spark, d, "registry").select("model_id", "config"), new)


@query("""WITH m AS (SELECT {'split': split, 'n': count(*), 'n_hate': sum(y_true)::BIGINT} AS s, model_id FROM predictions WHERE y_pred IS NOT NULL GROUP BY model_id, split), d AS (SELECT model_id, list(s) AS splits FROM m GROUP BY ALL)
 SELECT model_id, u.split AS split, u.n AS n, u.n_hate AS n_hate FROM (SELECT model_id, unnest(splits) AS u FROM d)""")
def breakdown_unnest(spark, d):
    m = _t(spark, d, "predictions").where("y_pred is not null").groupBy("model_id", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("y_true").alias("n_hate"))
    docs = m.groupBy("model_id").agg(F.collect_list(F.struct("split", "n", "n_hate")).alias("splits"))  # a few splits a model
    return docs.select("model_id", F.inline("splits"))


# ---- features ----
_LEX = "x AS (SELECT DISTINCT * FROM (SELECT trim(regexp_replace(lower(lemma), '\\s+', ' ', 'g')) AS lemma, lower(trim(category)) AS category, lower(trim(level)) AS level FROM lexicon) WHERE lemma <> '' AND len(string_split(lemma, ' ')) <= 2 AND category IN (" + ", ".join(f"'{c}'" for c in X.CATEGORIES) + ") AND level IN ('conservative', 'inclusive'))"


@query(f"""WITH {_LEX}, t AS (SELECT id, {_LT} AS t FROM corpus_strict), g AS (SELECT id, len(t) AS n, unnest(list_concat(t, list_transform(range(1, len(t)), i -> t[i] || ' ' || t[i + 1]))) AS lemma FROM t)
 SELECT id, category, level, max(n)::INTEGER AS n, count(*) AS hits FROM g JOIN x USING (lemma) GROUP BY ALL""")
def lexicon_hits(spark, d):
    return X.lexicon_hits(corpus(spark, d), X.lexicon(_t(spark, d, "lexicon")))


@query(f"""WITH {_LEX}, t AS (SELECT id, {_LT} AS t FROM corpus_strict), g AS (SELECT id, len(t) AS n, unnest(list_concat(t, list_transform(range(1, len(t)), i -> t[i] || ' ' || t[i + 1]))) AS lemma FROM t),
 h AS (SELECT id, category, level, max(n) AS n, count(*) AS hits FROM g JOIN x USING (lemma) GROUP BY ALL), r AS (SELECT id, sum(hits) / max(n) AS rate, {", ".join(f"sum(hits / n) FILTER (category = '{c}' AND level = '{v}') AS {c}_{v}" for c in X.CATEGORIES for v in X.LEVELS)} FROM h GROUP BY ALL)
 SELECT t.id, {", ".join(f"round(coalesce({c}_{v}, 0), 9) AS {c}_{v}" for c in X.CATEGORIES for v in X.LEVELS)}, round(coalesce(rate, 0), 9) AS rate, CASE WHEN rate > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "any" FROM t LEFT JOIN r USING (id)""")
def lexicon_block(spark, d):
    return rounded(X.lexicon_block(corpus(spark, d), X.lexicon(_t(spark, d, "lexicon"))))


_TF = f"tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({_LT}) AS term FROM corpus_strict) GROUP BY ALL), v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS total FROM tf GROUP BY ALL HAVING count(*) >= 3)"


@query(f"WITH {_TF} SELECT term, df, total FROM v ORDER BY total DESC, term LIMIT 2000")
def vocabulary_caps(spark, d):
    return X.vocabulary(X.term_counts(corpus(spark, d), T.letter_tokens(F.col("text_clean"))), 3, 2000)


@query(f"""WITH {_TF}, w AS (SELECT id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM corpus_strict)) / (1.0 + df)) + 1) AS w FROM tf JOIN v USING (term)), n AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)
 SELECT term, count(*) AS n, round(sum(weight), 6) AS total_weight FROM n GROUP BY ALL""")
def tfidf_weights(spark, d):
    c = corpus(spark, d)
    tf = X.term_counts(c, T.letter_tokens(F.col("text_clean")))
    w = X.tfidf(tf, X.vocabulary(tf, 3), c.count())
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("total_weight"))


@query("""SELECT sha1(text_clean) AS key, min(text_clean) AS text FROM corpus_strict WHERE text_clean IS NOT NULL AND sha1(text_clean) NOT IN (SELECT sha1(text) FROM vidgen_pairs WHERE text IS NOT NULL) GROUP BY ALL""")
def cache_misses(spark, d):
    cache = _t(spark, d, "vidgen_pairs").where("text is not null").select(T.text_key(F.col("text")).alias("key")).distinct()
    return X.cache_misses(corpus(spark, d), cache)


_QUERY_VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]


@query(f"""WITH q AS (SELECT [{", ".join(f"({x!r})::DOUBLE" for x in _QUERY_VECTOR)}] AS q) SELECT vec_id, round(list_sum(list_transform(range(1, len(embedding) + 1), i -> embedding[i]::DOUBLE * q[i])) / (sqrt(list_sum(list_transform(embedding, x -> x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q, x -> x * x)))), 6) AS similarity FROM embeddings, q""")
def embedding_similarity(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", F.round(X.cosine(None, _QUERY_VECTOR), 6).alias("similarity"))


# ---- scoring ----
_STACK = {"tfidf_logreg_strict_s7": 1.4, "tfidf_svm_strict_s7": 0.6, "tfidf_lgbm_strict_s7": 1.1}


@query(f"""{PL}, w AS (SELECT split, id, y_true, {", ".join(f"max(y_score) FILTER (model_id = '{m}') AS {m}" for m in _STACK)} FROM pl WHERE model_id IN ({", ".join(f"'{m}'" for m in _STACK)}) GROUP BY ALL),
 r AS (SELECT *, 1 / (1 + exp(-(-0.9 + {" + ".join(f"{w} * {m}" for m, w in _STACK.items())}))) AS raw FROM w WHERE {" AND ".join(f"{m} IS NOT NULL" for m in _STACK)}), p AS (SELECT *, 1 / (1 + exp(-(2.1 * raw - 1.2))) AS prob FROM r)
 SELECT split, id, y_true, round(raw, 6) AS raw, round(prob, 6) AS prob, (prob >= 0.45)::INTEGER AS y_pred FROM p""")
def stack_score(spark, d):
    wide = M.member_scores(preds(spark, d), list(_STACK))
    out = M.stacked(wide, _STACK, -0.9, (2.1, -1.2), 0.45)
    return out.select("split", "id", "y_true", F.round("raw", 6).alias("raw"), F.round("prob", 6).alias("prob"), "y_pred")


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST, received_at DESC NULLS LAST, blocks DESC) AS rn FROM field_pages WHERE status = 200 AND blocks IS NOT NULL),
 u AS (SELECT page_id, unnest(blocks) AS block FROM b WHERE rn = 1) SELECT DISTINCT page_id, block FROM u WHERE trim(block) <> ''""")
def page_blocks(spark, d):
    return html.stored_blocks(_t(spark, d, "field_pages")).select("page_id", "block")


_BLOCKS = """b AS (SELECT page_id, blocks FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY fetched_at DESC NULLS LAST, received_at DESC NULLS LAST, blocks DESC) AS rn FROM field_pages WHERE status = 200 AND blocks IS NOT NULL) WHERE rn = 1),
 u AS (SELECT DISTINCT page_id, unnest(blocks) AS block FROM b), t AS (SELECT page_id, md5(page_id || '_' || block) AS id, block FROM u WHERE trim(block) <> '')"""


@query(f"""WITH {_PROF}, {_BLOCKS}, w AS (SELECT page_id, id, list_filter(regexp_split_to_array(lower(block), '{WS}+'), x -> x <> '') AS w FROM t),
 s AS (SELECT page_id, id, CASE WHEN len(w) > 0 THEN len(list_filter(w, x -> list_contains(pl, x))) / len(w) ELSE 0 END AS first_score, CASE WHEN len(w) > 0 THEN len(list_filter(w, x -> length(x) > 7)) / len(w) ELSE 0 END AS second_score FROM w CROSS JOIN (SELECT list(token) AS pl FROM p)),
 f AS (SELECT *, (first_score >= 0.02)::INTEGER AS first_flag, (second_score >= 0.6)::INTEGER AS second_flag FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY md5('42|' || id), id) AS rn FROM f WHERE first_flag = 0 AND second_flag = 0)
 SELECT page_id, id, round(first_score, 6) AS first_score, first_flag, round(second_score, 6) AS second_score, second_flag, 'flagged' AS part FROM f WHERE first_flag = 1 OR second_flag = 1
 UNION ALL SELECT page_id, id, round(first_score, 6), first_flag, round(second_score, 6), second_flag, 'unflagged_sample' FROM r WHERE rn <= 30""")
def review_sheet(spark, d):
    """Blocks scored by two scorers: all that either flags, and up to 30 others a page."""
    blocks = html.stored_blocks(_t(spark, d, "field_pages")).select("page_id", F.md5(F.concat_ws("_", F.col("page_id").cast("string"), "block")).alias("id"), T.tokens(F.lower("block")).alias("w"))
    words = X.words_of(X.profanity(_t(spark, d, "lexicon")))
    share = lambda c: F.when(F.size("w") > 0, F.size(F.filter("w", c)) / F.size("w")).otherwise(F.lit(0.0))
    s = blocks.select("page_id", "id", share(lambda x: x.isin(*words)).alias("first_score"), share(lambda x: F.length(x) > 7).alias("second_score"))
    s = s.withColumn("first_flag", (F.col("first_score") >= 0.02).cast("int")).withColumn("second_flag", (F.col("second_score") >= 0.6).cast("int"))
    return rounded(A.flagged_and_sample(s, ["first_flag", "second_flag"], "page_id"), 6)


@query("SELECT key, list_sum(list_transform(vector, x -> round(x::DOUBLE, 4)))::DOUBLE AS total FROM (SELECT sha1(text) AS key, arg_min(embedding, doc_id) AS vector FROM (SELECT d.doc_id, d.text, e.embedding FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.text IS NOT NULL) GROUP BY sha1(text))")
def cache_seed(spark, d):
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    c = X.seed_cache(_t(spark, d, "documents"), v, "doc_id")
    return c.select("key", F.aggregate("vector", F.lit(0.0), lambda a, x: a + F.round(x.cast("double"), 4)).alias("total"))


# ---- estimators: no SQL form; tests check their properties ----
def _splits(spark, d):
    c = corpus(spark, d).where("label is not null").select("id", "text_clean", "label", "split", "source_dataset", "language")
    return c, c.where("split = 'train'"), c.where("split = 'val'")


def _trained(spark, d, cfg):
    c, tr, va = _splits(spark, d)
    return rounded(M.evaluate(M.train(tr, va, cfg), c.where("split in ('val', 'test')")), 6)


@query()
def train_logreg(spark, d):
    return _trained(spark, d, M.Config())


@query()
def train_svm(spark, d):
    return _trained(spark, d, M.Config(kind="svm"))


def _threshold(spark, d, model):
    return _t(spark, d, "registry").where(F.col("model_id") == model).first()["threshold"]


@query()
def platt_calibration(spark, d):
    """Each model's scores on test by its own sigmoid."""
    p = preds(spark, d)
    out = None
    for model in [r["model_id"] for r in _t(spark, d, "registry").select("model_id").orderBy("model_id").collect()]:  # as many as models
        a, b = M.platt(p.where((F.col("split") == "val") & (F.col("model_id") == model)))
        part = p.where((F.col("split") == "test") & (F.col("model_id") == model) & F.col("y_score").isNotNull()).withColumn("p", M.sigmoid(F.lit(a) * F.col("y_score") + F.lit(b)))
        out = part if out is None else out.unionByName(part)
    return out.select("model_id", "id", "y_true", F.round("p", 6).alias("p"))


@query()
def isotonic_calibration(spark, d):
    """Each model's scores on test by its own isotonic step function."""
    p = preds(spark, d)
    out = None
    for model in [r["model_id"] for r in _t(spark, d, "registry").select("model_id").orderBy("model_id").collect()]:
        own = p.where(F.col("model_id") == model)
        part = M.isotonic_scores(M.isotonic(own.where("split = 'val'")), own.where("split = 'test'"))
        out = part if out is None else out.unionByName(part)
    return out.select("model_id", "id", "y_true", F.round("p", 6).alias("p"))


@query()
def calibration_demo(spark, d):
    model = "tfidf_logreg_strict_s7"
    p = preds(spark, d).where(F.col("model_id") == model)
    return rounded(M.calibration_report(p.where("split = 'val'"), p.where("split = 'test'"), _threshold(spark, d, model)), 6)


@query()
def stacking(spark, d):
    """The stack of three members against that of all models, and which is chosen."""
    p = preds(spark, d)
    every = [r["model_id"] for r in _t(spark, d, "registry").select("model_id").orderBy("model_id").collect()]
    chosen, small, large = M.choose_stack(p, list(_STACK), every)
    out = None
    for name, k in (("small", small), ("large", large)):
        wide = M.member_scores(p, list(k.weights))
        part = k.score(wide).select(F.lit(name).alias("stack"), F.lit(k is chosen).alias("chosen"), "split", "y_true", "y_pred", F.col("prob").alias("y_score"))
        out = part if out is None else out.unionByName(part)
    by = ["stack", "chosen", "split"]
    return rounded(E.classification(out, by).join(E.areas(out, by), by), 6)


@query()
def transfer_matrix(spark, d):
    c, tr, va = _splits(spark, d)
    out = None
    for name, a, b in (("en->pt", ["vidgen", "hatexplain", "tweets_ip"], ["toldbr", "hatebr", "pt_fortuna"]), ("pt->en", ["toldbr", "hatebr", "pt_fortuna"], ["vidgen", "hatexplain", "tweets_ip"])):
        m = M.train(tr.where(F.col("source_dataset").isin(*a)), va.where(F.col("source_dataset").isin(*a)), M.Config())
        e = M.evaluate(m, c.where((F.col("split") == "test") & F.col("source_dataset").isin(*b)), ["split"]).withColumn("experiment", F.lit(name))
        out = e if out is None else out.unionByName(e)
    return rounded(out, 6)
