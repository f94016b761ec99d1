"""Problems 4 and 5 as operators on tables: one pass over the texts, no shuffle for the rows themselves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import forms, garble


def _src(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")


def look_alike_rows(df: DataFrame, id_col: str = "id", text_col: str = "text_clean") -> DataFrame:
    """(id) of rows that hold a look-alike, an invisible character, a separate accent or another space, and are not garbled.

    These are the rows that character_forms changes: a character is replaced if its prototype is another one and it is
    not at home, and the change is accepted if text and plain form have one skeleton.  Null and plain texts are no cases.
    """
    # ASCII text has one form only; the JVM leaves it out before Python sees it.
    rows = character_forms(df.where(F.col(text_col).rlike("[^\\x00-\\x7f]")), id_col, text_col)
    return rows.where("changed and not garbled").select("id").dropDuplicates(["id"])


def character_forms(df: DataFrame, id_col: str = "id", text_col: str = "text_clean") -> DataFrame:
    """(id, text, changed, garbled, skeleton): the text in one character form, and the 128-bit hash of its skeleton as 32 hex digits.

    Texts that look the same have equal skeleton hashes; skeleton_groups groups by it.  A null text gives nulls.
    Garbled text is not restored here; garbled says that it is.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            out = [forms.plain(t) for t in texts]
            marks = [None if t is None else hashlib.blake2b(forms.skeleton(t).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() for t in texts]
            bad = [None if t is None else bool(garble.repair(t)[2]) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t for t, _ in out], pa.string()), pa.array([None if t is None else c for t, c in out], pa.bool_()), pa.array(bad, pa.bool_()), pa.array(marks, pa.string())],
                names=["id", "text", "changed", "garbled", "skeleton"],
            )

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(one, "id string, text string, changed boolean, garbled boolean, skeleton string")


def repairs(df: DataFrame, id_col: str = "id", text_col: str = "text_clean") -> DataFrame:
    """(id, text: restored as far as possible, places, how: repaired or lost) of each garbled row.

    Rows with null, blank or sound text are left out.  Repeated ids come out once for each text.
    """

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *r) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := garble.repair(t))[2]]
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["id", "text", "places", "how"]
            )

    return _src(df, id_col, text_col).where(F.col("text").rlike("[^\\x00-\\x7f]")).mapInArrow(one, "id string, text string, places int, how string").dropDuplicates(["id", "text"])


def skeleton_groups(df: DataFrame, id_col: str = "id", text_col: str = "text_clean") -> DataFrame:
    """(skeleton, first_id, original_id, originals, look_alikes): texts of equal skeleton of which at least one is not in its plain form.

    original_id is the least id of a row in plain form, null if there is none; originals and look_alikes count rows.
    """
    changed = F.col("changed").cast("long")
    out = character_forms(df, id_col, text_col).where("skeleton is not null").groupBy("skeleton").agg(
        F.min("id").alias("first_id"), F.min(F.when(~F.col("changed"), F.col("id"))).alias("original_id"), F.sum(1 - changed).alias("originals"), F.sum(changed).alias("look_alikes")
    )
    return out.where("look_alikes > 0")
