"""Language of short texts by their function words, as column expressions.

Each word votes for every language in whose list it stands; the confidence is the best language's part of the
votes.  Arabic is told by its script.  English and Portuguese keep their codes, all others are "other"; a text
without a vote is "other" with confidence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.wordlists import LISTS, function_words

# Languages that keep their code, in order of preference among equals; then those that are told apart from them.
OWN = ("en", "pt")
LANGUAGES = tuple(LISTS)
ARABIC = r"[\x{0600}-\x{06FF}]+"


def words(text: Column) -> Column:
    """Runs of letters, lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+"), F.lit(0))


def detect(df: DataFrame, text: str = "text_clean", as_lang: str = "lang", as_conf: str = "conf") -> DataFrame:
    """Adds lang (en, pt or other) and conf, 0 to 1.  Null and empty texts are other, 0."""
    out = df.withColumn("_words", words(F.col(text)))
    among = lambda own: F.size(F.filter("_words", lambda w: w.isin(*own)))
    votes = [among(function_words(c)) for c in LANGUAGES]
    votes.append(F.size(F.filter("_words", lambda w: w.rlike(f"^{ARABIC}$"))))
    out = out.withColumn("_votes", F.array(*votes))
    total = F.aggregate("_votes", F.lit(0), lambda a, x: a + x)
    out = out.withColumn("_top", F.array_max("_votes")).withColumn("_total", total)
    code = F.get(F.array(*[F.lit(c if c in OWN else "other") for c in [*LANGUAGES, "ar"]]), (F.array_position("_votes", F.col("_top")) - 1).cast("int"))
    found = F.col("_top") > 0
    return out.withColumn(as_lang, F.when(found, code).otherwise("other")).withColumn(as_conf, F.when(found, F.col("_top") / F.col("_total")).otherwise(F.lit(0.0))).drop("_words", "_votes", "_top", "_total")
