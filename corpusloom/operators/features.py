"""Features in long form (id, term, weight), and as vectors for estimators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T

# Categories and levels of the lexicon.
CATEGORIES = ("ps", "rci", "pa", "ddf", "ddp", "dmc", "is", "or", "an", "asm", "asf", "pr", "om", "qas", "cds", "re", "svp")
LEVELS = ("conservative", "inclusive")
#: Lemmas that a lexicon may have.
MOST_LEMMAS = 10_000


def lexicon(df: DataFrame) -> DataFrame:
    """(lemma, category, level), lower case, of one or two words, known categories and levels, each once."""
    lemma = T.collapse(F.lower("lemma"))
    out = df.select(lemma.alias("lemma"), F.lower(F.trim("category")).alias("category"), F.lower(F.trim("level")).alias("level"))
    return out.where((F.col("lemma") != "") & (F.size(F.split("lemma", " ")) <= 2) & F.col("category").isin(*CATEGORIES) & F.col("level").isin(*LEVELS)).distinct()


def profanity(df: DataFrame) -> DataFrame:
    """(token): lemmas of one word."""
    return lexicon(df).where(~F.col("lemma").contains(" ")).select(F.col("lemma").alias("token")).distinct()


def lexicon_rows(lex: DataFrame) -> list[tuple[str, str, str]]:
    """The lexicon as plain rows; a fixed resource of some hundred lemmas, and one beyond MOST_LEMMAS is refused."""
    rows = [(r["lemma"], r["category"], r["level"]) for r in lex.select("lemma", "category", "level").limit(MOST_LEMMAS + 1).collect()]
    if len(rows) > MOST_LEMMAS:
        raise ValueError(f"a lexicon of more than {MOST_LEMMAS} lemmas")
    return sorted(rows)


def words_of(tokens: DataFrame) -> list[str]:
    """The column token as a list, under the same bound."""
    rows = [r["token"] for r in tokens.select("token").limit(MOST_LEMMAS + 1).collect()]
    if len(rows) > MOST_LEMMAS:
        raise ValueError(f"a word list of more than {MOST_LEMMAS} words")
    return sorted(rows)


def strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def with_hits(df: DataFrame, tokens: str, lemmas: Sequence[str]) -> DataFrame:
    """Adds _hit: the unigrams and adjacent bigrams of the tokens that are lemmas, as often as they occur.

    Step by step, so that each array is made once for a row; the intersection is hashed.
    """
    out = df.withColumn("_grams", T.ngrams(F.col(tokens), 1, 2))
    out = out.withColumn("_met", F.array_intersect("_grams", strings(sorted(set(lemmas)))))
    hit = F.when(F.size("_met") > 0, F.filter("_grams", lambda g: F.array_contains("_met", g))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("_hit", hit).drop("_grams", "_met")


def lexicon_hits(df: DataFrame, lex: DataFrame, id_col: str = "id", text: str = "text_clean") -> DataFrame:
    """(id, category, level, n, hits): matches of unigrams and adjacent bigrams; n is the number of unigrams."""
    grams = df.select(F.col(id_col).alias("id"), T.letter_tokens(F.col(text)).alias("t")).select("id", F.size("t").alias("n"), F.explode(T.ngrams(F.col("t"), 1, 2)).alias("lemma"))
    # At most MOST_LEMMAS rows.
    table = df.sparkSession.createDataFrame(lexicon_rows(lex), "lemma string, category string, level string")
    return grams.join(F.broadcast(table), "lemma").groupBy("id", "category", "level").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("hits"))


def with_lexicon(df: DataFrame, tokens: str, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Adds the 36 columns of the lexicon block, from an array column of tokens and the lexicon's rows; all within the row."""
    cells = {(c, v): k for k, (c, v) in enumerate((c, v) for c in CATEGORIES for v in LEVELS)}
    of: dict[str, list[int]] = {}
    for lemma, c, v in rows:
        of.setdefault(lemma, []).append(cells[c, v])
    out = with_hits(df, tokens, list(of))
    if of:
        table = F.create_map(*[x for lemma, k in of.items() for x in (F.lit(lemma), F.array(*[F.lit(i) for i in k]))])
        out = out.withColumn("_at", F.flatten(F.transform("_hit", lambda g: table[g])))
    else:
        out = out.withColumn("_at", F.array().cast("array<int>"))
    n = F.size(tokens)
    share = lambda k: F.when(n > 0, F.size(F.filter("_at", lambda x: x == k)) / n).otherwise(F.lit(0.0))
    rate = F.when(n > 0, F.size("_at") / n).otherwise(F.lit(0.0))
    out = out.withColumns({f"{c}_{v}": share(k) for (c, v), k in cells.items()} | {"rate": rate})
    return out.withColumn("any", F.when(F.col("rate") > 0, 1.0).otherwise(0.0)).drop("_hit", "_at")


def lexicon_block(df: DataFrame, lex: DataFrame, id_col: str = "id", text: str = "text_clean") -> DataFrame:
    """36 columns for each row: hits of each category and level over tokens, the overall rate, and whether there is any.  Nothing is shuffled."""
    base = df.select(F.col(id_col).alias("id"), T.letter_tokens(F.col(text)).alias("t"))
    return with_lexicon(base, "t", lexicon_rows(lex)).drop("t")


def term_counts(df: DataFrame, terms: Column, id_col: str = "id") -> DataFrame:
    """(id, term, tf)."""
    return df.select(F.col(id_col).alias("id"), F.explode(terms).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(tf: DataFrame, min_df: int = 1, max_features: int | None = None) -> DataFrame:
    """(term, df, total): document frequency and term frequency of terms in at least min_df documents, the most frequent ones."""
    v = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= min_df)
    return v if max_features is None else v.orderBy(F.desc("total"), "term").limit(max_features)


def tfidf(tf: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(id, term, weight): (1 + ln tf)(ln((1 + N) / (1 + df)) + 1), each document of length 1."""
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1
    w = tf.join(vocab.select("term", "df"), "term").select("id", "term", ((1 + F.log(F.col("tf").cast("double"))) * idf).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return w.select("id", "term", (F.col("w") / norm).alias("weight"))


def cache_misses(texts: DataFrame, cache: DataFrame, text: str = "text_clean") -> DataFrame:
    """(key, text) of texts whose embedding is not in the cache (key); each once."""
    want = texts.where(F.col(text).isNotNull()).groupBy(T.text_key(F.col(text)).alias("key")).agg(F.min(text).alias("text"))
    return want.join(cache.select("key"), "key", "left_anti")


def seed_cache(texts: DataFrame, vectors: DataFrame, on: str, text: str = "text", vector: str = "embedding") -> DataFrame:
    """(key, vector) of a cache from texts and their vectors, which share the column `on`; a text that repeats keeps the vector of the least `on`, null texts are left out."""
    both = texts.where(F.col(text).isNotNull()).select(on, text).join(vectors.select(on, vector), on)
    return both.groupBy(T.text_key(F.col(text)).alias("key")).agg(F.min_by(vector, on).alias("vector"))


def cosine(df: DataFrame, query: Sequence[float], vector: str = "embedding") -> Column:
    """Cosine similarity of an array column and a fixed vector; null for vectors of length 0."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = F.aggregate(F.zip_with(F.col(vector), q, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(F.col(vector), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    own = sum(float(x) * float(x) for x in query) ** 0.5
    return F.when((norm > 0) & F.lit(own > 0), dot / (norm * own))
