"""Micro-batch scoring: texts arrive as a stream and leave with cleaned text, score and label."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T

REQUEST = "id string, text string"


def requests(spark: SparkSession, folder: str, schema: str = REQUEST) -> DataFrame:
    """A stream of JSON lines from a folder."""
    return spark.readStream.schema(schema).json(folder)


def score_batch(df: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, version: str, text: str = "text") -> DataFrame:
    """(id, text_clean, score, label, model_version) of a batch.  Stateless, so the same plan serves tables and streams.

    score adds y_score from text_clean.  Null and blank texts are scored as the empty text.
    """
    out = score(df.withColumn("text_clean", T.clean(F.col(text))))
    label = F.when(F.col("y_score") >= threshold, "hate").otherwise("not_hate")
    return out.select("id", "text_clean", F.col("y_score").alias("score"), label.alias("label"), F.lit(version).alias("model_version"))


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], threshold: float, version: str, out: str, checkpoint: str) -> StreamingQuery:
    """Score all that has arrived and stop; the checkpoint makes every request leave once."""
    rows = score_batch(stream, score, threshold, version)
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lexicon_score(lexicon_tokens: list[str]) -> Callable[[DataFrame], DataFrame]:
    """A scorer without a model: the share of tokens that are in a fixed list."""

    def score(df: DataFrame) -> DataFrame:
        toks = T.tokens(F.lower("text_clean"))
        hits = F.size(F.filter(toks, lambda x: x.isin(*lexicon_tokens)))
        return df.withColumn("y_score", F.when(F.size(toks) > 0, hits / F.size(toks)).otherwise(F.lit(0.0)))

    return score
