"""Problem 6: records that are identical but for formatting.

Characters, case, white space, punctuation and the order of `name: value` fields are canonicalized, the
canonical content is hashed to 128 bits, and copies are counted by an aggregation that combines on the
map side.  A second, independent 64-bit hash is part of the key, so that two contents that collide in
the first hash stay apart; how many did is reported.

Rows without a letter or digit (null and blank texts included) have no content and take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import forms, garble
from corpusloom.operators.graph import components
from corpusloom.plans.durable import join_skewed, keep

# What a row is.
SOUND, WORDLESS, LOOK_ALIKE, GARBLED = 0, 1, 2, 3
# The order of label confidences; all others, and null, rank below.
CONFIDENCE = ("low", "medium", "high")

_NOT_CONTENT = re.compile(r"[\W_]+")
_BETWEEN = re.compile(r"[|;\n\r]+")
_FIELD = re.compile(r"[\W_]*([^\W\d_][^\W_]*(?: [^\W_]+)?)\s*:\s*(.*\w.*)")


def content(text: str) -> str:
    """The letters and digits of a text in order, case ignored."""
    return _NOT_CONTENT.sub("", text.casefold())


def fields(text: str) -> str | None:
    """The sorted fields of a text that consists only of two or more `name: value` fields, else null."""
    if text.count(":") < 2:
        return None
    parts = [p for p in _BETWEEN.split(text) if not p.isspace() and _NOT_CONTENT.sub("", p)]
    found = [_FIELD.fullmatch(p) for p in parts]
    if len(parts) < 2 or not all(found):
        return None
    return "\x1f".join(sorted(content(m[1]) + "\x1e" + content(m[2]) for m in found))


def kind_of(text: str | None) -> int:
    """SOUND, WORDLESS, GARBLED (problem 5) or LOOK_ALIKE (problem 4)."""
    if text is None or text.isspace():
        return WORDLESS
    if text.isascii():
        return SOUND if content(text) else WORDLESS
    if garble.repair(text)[2]:
        return GARBLED
    return LOOK_ALIKE if forms.plain(text)[1] else SOUND if content(text) else WORDLESS


def _digest(s: str | None) -> bytes | None:
    return None if s is None else hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def content_rows(df: DataFrame, id_col: str, text_col: str, repair: bool = False) -> DataFrame:
    """(id, kind, key, check, field_key, restored) of each row.  With repair, garbled and look-alike text is first restored, and restored says so."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, keys, checks, fkeys, restored = [], [], [], [], []
            for text in b.column(1).to_pylist():
                changed = False
                if repair and text:
                    text, _, how = garble.repair(text)
                    text, alike = forms.plain(text)
                    changed = bool(how) or alike
                    kind = SOUND if content(text) else WORDLESS
                else:
                    kind = kind_of(text)
                kinds.append(kind)
                restored.append(changed)
                c = content(text) if kind == SOUND else None
                keys.append(_digest(c))
                checks.append(None if c is None else xxhash.xxh64_intdigest(c) - (1 << 63))
                fkeys.append(_digest(fields(text)) if kind == SOUND else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(kinds, pa.int8()), pa.array(keys, pa.binary()), pa.array(checks, pa.int64()), pa.array(fkeys, pa.binary()), pa.array(restored, pa.bool_())],
                names=["id", "kind", "key", "check", "field_key", "restored"],
            )

    src = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(one, "id string, kind tinyint, key binary, check bigint, field_key binary, restored boolean")


def _classes(by_key: DataFrame) -> DataFrame:
    """Adds `cls`, equal for the keys of one content.  by_key: key, check, low and high (the least and greatest field key).

    A content with fields stands for all orders of its fields.  Where one sequence of letters can be read as
    different fields, these are one content too; such rare links are closed by connected components.
    """
    cls = F.coalesce(F.concat(F.lit(b"f"), F.col("low")), F.concat(F.lit(b"s"), F.col("key"), F.col("check").cast("string").cast("binary")))
    out = by_key.withColumn("cls", cls)
    linked = by_key.where(F.col("low") != F.col("high"))
    if linked.isEmpty():
        return out
    roots = components(linked.select(F.hex("low").alias("a"), F.hex("high").alias("b")))
    roots = roots.select(F.unhex("node").alias("low"), F.concat(F.lit(b"f"), F.unhex("root")).alias("root"))
    return out.join(roots, "low", "left").withColumn("cls", F.coalesce("root", "cls")).drop("root")


def representatives(rows: DataFrame, all_sets: bool = False) -> DataFrame:
    """(key, check, n, first_id, copies) of each content key; keys of sets of one row only with all_sets.

    rows: content_rows, sound ones only.  first_id is the smallest id, as a string, of the whole set.
    """
    by_key = rows.groupBy("key", "check").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.min("field_key").alias("low"), F.max("field_key").alias("high")
    )
    if not all_sets:
        by_key = by_key.where((F.col("n") > 1) | F.col("low").isNotNull())
    by_key = _classes(keep(by_key, "content"))
    plain = by_key.where(F.col("low").isNull()).select("key", "check", "n", F.col("first").alias("first_id"), F.col("n").alias("copies"))
    parted = by_key.where(F.col("low").isNotNull())
    sets = parted.groupBy("cls").agg(F.min("first").alias("first_id"), F.sum("n").alias("copies"))
    out = plain.unionByName(parted.join(sets, "cls").select("key", "check", "n", "first_id", "copies"))
    return out if all_sets else out.where(F.col("copies") > 1)


def found(df: DataFrame, id_col: str = "id", text_col: str = "text_clean") -> DataFrame:
    """(first_id, id): one row for each id of a set of copies but the smallest."""
    rows = keep(content_rows(df, id_col, text_col).where(f"kind = {SOUND}").drop("kind"), "copies")
    sets = keep(representatives(rows).drop("copies"), "sets")
    return join_skewed(rows.select("key", "check", "id"), sets, ["key", "check"], "n").where("id <> first_id").select("first_id", "id")


def collapse(df: DataFrame, id_col: str = "id", text_col: str = "text_clean", confidence_col: str = "label_confidence") -> DataFrame:
    """One row per content: (first_id, copies, label_confidence: the best among the copies, collisions: contents that share its hash).

    Garbled and look-alike text is restored first, so that such copies collapse too.  Ids that repeat count each time.
    """
    rank = F.coalesce(*[F.when(F.lower(F.trim(F.col("confidence"))) == c, F.lit(i + 1)) for i, c in enumerate(CONFIDENCE)], F.lit(0))
    # The label rides along inside the id column, which the pass over texts hands through untouched.
    tagged = df.select(F.concat_ws("\x1f", F.coalesce(F.col(confidence_col), F.lit("")), F.col(id_col).cast("string")).alias("id"), F.col(text_col).alias("text"))
    rows = content_rows(tagged, "id", "text", repair=True).where(f"kind = {SOUND}")
    rows = rows.withColumn("confidence", F.substring_index("id", "\x1f", 1)).withColumn("id", F.expr("substring(id, instr(id, '\x1f') + 1)"))
    by_key = rows.groupBy("key", "check").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"), F.min("field_key").alias("low"), F.max("field_key").alias("high")
    )
    by_key = _classes(keep(by_key, "content"))
    out = by_key.groupBy("cls").agg(
        F.min("first").alias("first_id"), F.sum("n").alias("copies"), F.max("best").alias("best"), F.min("key").alias("key")
    )
    clash = by_key.groupBy("key").agg((F.count(F.lit(1)) - 1).alias("collisions")).where("collisions > 0")
    label = F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("best").cast("int"))
    out = out.join(clash, "key", "left")
    return out.select("first_id", "copies", F.when(F.col("best") > 0, label).alias("label_confidence"), F.coalesce("collisions", F.lit(0)).alias("collisions"))
