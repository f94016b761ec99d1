"""Exact duplicates, near-duplicates over character shingles, and the clusters they form.

Near-duplicates: texts are first collapsed to one per exact key, so copies never meet each other.  MinHash
signatures of the sets of character k-grams are cut into bands; buckets are counted with map-side combining;
small buckets are listed, large ones are compared block by block in tasks of their own; every candidate is
verified by the exact Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import dedup_key
from corpusloom.operators.graph import components
from corpusloom.plans.durable import join_skewed, keep

PERMUTATIONS, BAND_ROWS = 64, 4
SMALL, BLOCK = 24, 2000


def confidence_rank(c: Column) -> Column:
    """1 for high, 0 for all others."""
    return F.when(c == "high", 1).otherwise(0)


def exact_duplicates(df: DataFrame, text: str = "text_clean", order: str = "id", confidence: str = "label_confidence", form: str = "NFKC") -> DataFrame:
    """One row per dedup key: the most confident, then the first by `order`.  Null and blank texts share one key.

    A least-struct aggregation: copies are dropped before the shuffle, so a text that holds a third of all rows
    costs one row a task.
    """
    keyed = df.withColumn("_key", F.xxhash64(dedup_key(F.col(text), form))).withColumn("_key2", F.md5(dedup_key(F.col(text), form)))
    best = F.min(F.struct((-confidence_rank(F.coalesce(F.col(confidence), F.lit("")))).alias("_rank"), F.col(order).alias("_order"), *df.columns)).alias("b")
    return keyed.groupBy("_key", "_key2").agg(best).select(*[F.col(f"b.{c}").alias(c) for c in df.columns])


@lru_cache(4)
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return r.integers(1, 1 << 62, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def shingle_hashes(text: str, k: int) -> np.ndarray:
    """Sorted hashes of the set of character k-grams; a shorter text is its own only shingle, the empty text has none."""
    if not text:
        return np.zeros(0, np.uint64)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    k = min(k, len(c))
    h = np.zeros(len(c) - k + 1, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x100000001B3) + c[i : i + len(h)] + np.uint64(1)
    return np.unique(h * np.uint64(0x9E3779B97F4A7C15))


def _sketch(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Signatures; the text goes along, as it is a fraction of its set of shingles."""
    a, b = _hashes(PERMUTATIONS)
    for batch in batches:
        ids, sigs, texts, sizes = [], [], [], []
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if t:
                ids.append(i)
                own = shingle_hashes(t, k)
                sigs.append(((own[:, None] * a + b) >> np.uint64(32)).min(axis=0).astype(np.uint32).tobytes())
                texts.append(t)
                sizes.append(len(own))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sigs, pa.binary()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32())], names=["id", "sig", "text", "size"])


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    n = len(np.intersect1d(x, y, assume_unique=True))
    return n / (len(x) + len(y) - n)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64())], names=["id_a", "id_b", "jaccard"])


def _verify(batches: Iterator[pa.RecordBatch], least: float, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for i, x, j, y in zip(*(c.to_pylist() for c in b.columns)):
            if (s := _jaccard(shingle_hashes(x, k), shingle_hashes(y, k))) >= least:
                rows.append((i, j, s))
        yield _batch(rows)


def _verify_blocks(batches: Iterator[pa.RecordBatch], least: float, k: int) -> Iterator[pa.RecordBatch]:
    group, sides = None, ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        left, right = sides
        for n, (i, x) in enumerate(left):
            rows = [(min(i, j), max(i, j), s) for j, y in (right or left[n + 1 :]) if i != j and min(len(x), len(y)) >= least * max(len(x), len(y)) and (s := _jaccard(x, y)) >= least]
            if rows:
                yield _batch(rows)

    for b in batches:
        for g, side, i, x in zip(*(c.to_pylist() for c in b.columns)):
            if g != group:
                yield from flush()
                group, sides = g, ([], [])
            sides[side].append((i, shingle_hashes(x, k)))
    yield from flush()


def near_pairs(texts: DataFrame, threshold: float = 0.9, k: int = 5, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, jaccard), id_a < id_b, of texts (id, text; ids unique) whose shingle sets are similar enough."""
    sketch = keep(texts.select("id", "text").mapInArrow(lambda it: _sketch(it, k), "id string, sig binary, text string, size int"), "sketch")
    n_bands, width = PERMUTATIONS // BAND_ROWS, 4 * BAND_ROWS
    bands = sketch.select("id", "sig", F.explode(F.sequence(F.lit(0), F.lit(n_bands - 1))).alias("band"))
    bands = bands.select("id", F.xxhash64("band", F.expr(f"substring(sig, band * {width} + 1, {width})")).alias("bucket"))
    counts = keep(bands.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id_a"), F.max("id").alias("id_b")).where("n > 1"), "buckets")
    members = keep(bands.join(counts.where("n > 2").select("bucket", "n"), "bucket"), "members")
    listed = members.where(F.col("n") <= small).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("m"))
    listed = listed.select(F.posexplode("m").alias("i", "id_a"), "m").select("id_a", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("id_b"))
    pairs = counts.where("n = 2").select("id_a", "id_b").unionByName(listed).where("id_a < id_b").distinct()
    a = sketch.select(F.col("id").alias("id_a"), F.col("text").alias("a"), F.col("size").alias("na"))
    b = sketch.select(F.col("id").alias("id_b"), F.col("text").alias("b"), F.col("size").alias("nb"))
    out = pairs.join(a, "id_a").join(b, "id_b").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold).select("id_a", "a", "id_b", "b").mapInArrow(lambda it: _verify(it, threshold, k), "id_a string, id_b string, jaccard double")
    large = members.where(F.col("n") > small)
    if large.isEmpty():
        return out
    large = large.withColumn("k", F.ceil(F.col("n") / F.lit(block)).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k").cast("long")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    large = large.select(F.xxhash64("bucket", lo, hi).alias("grp"), F.when(lo == hi, 0).otherwise((F.col("own") == hi).cast("int")).alias("side"), "id")
    tasks = large.join(sketch.select("id", "text"), "id").select("grp", "side", "id", "text").repartition("grp").sortWithinPartitions("grp")
    wide = tasks.mapInArrow(lambda it: _verify_blocks(it, threshold, k), "id_a string, id_b string, jaccard double")
    return out.unionByName(wide).dropDuplicates(["id_a", "id_b"])


def near_clusters(df: DataFrame, text: str = "text_clean", id_col: str = "id", threshold: float = 0.9, links: DataFrame | None = None, form: str = "NFKC") -> DataFrame:
    """(id, cluster): rows with equal keys, similar keys or an explicit link (a, b: ids) share a cluster, named by its least id.

    Every row gets a cluster; rows with null or blank text are clusters of their own unless linked.
    """
    rows = keep(df.select(F.col(id_col).alias("id"), dedup_key(F.col(text), form).alias("text")), "keys")
    keyed = rows.where("text <> ''").withColumn("key", F.md5("text"))
    firsts = keep(keyed.groupBy("key").agg(F.min("id").alias("id"), F.min("text").alias("text"), F.count(F.lit(1)).alias("n")), "firsts")
    pairs = keep(near_pairs(firsts.select("id", "text"), threshold).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "pairs")
    to_first = keep(join_skewed(keyed.select("key", "id"), firsts.select("key", F.col("id").alias("first"), "n"), ["key"], "n").select("id", "first"), "to_first")
    edges = pairs
    if links is not None:
        f = to_first.select("id", "first")
        a = links.select("a", "b").join(f.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a", "left")
        edges = edges.unionByName(
            a.join(f.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b", "left").select(F.coalesce("fa", "a").alias("a"), F.coalesce("fb", "b").alias("b"))
        )
    roots = components(edges)
    every = rows.select("id").join(to_first, "id", "left").select("id", F.coalesce("first", "id").alias("first"))
    return every.join(roots.select(F.col("node").alias("first"), "root"), "first", "left").select("id", F.coalesce("root", "first").alias("cluster"))


def pair_links(corpus: DataFrame, pairs: DataFrame, source: str = "vidgen") -> DataFrame:
    """(a, b): ids of a record's row and of the row it was derived from, where both are in the corpus."""
    p = pairs.select(F.concat(F.lit(f"{source}_"), F.col("row_no").cast("string")).alias("id"), F.trim("acl_id").alias("own"), F.trim("acl_id_matched").alias("of")).distinct()
    p = p.join(corpus.select("id").distinct(), "id", "left_semi")
    absent = F.lower(F.coalesce("of", F.lit(""))).isin("", "na", "n/a", "none", "nan", "null")
    return p.where(~absent).select(F.col("id").alias("a"), F.col("of").alias("own")).join(p.select("own", F.col("id").alias("b")), "own").select("a", "b").distinct()


def leaks(df: DataFrame, text: str = "text_clean", cluster: str = "dup_cluster_id", split: str = "split", form: str = "NFC") -> DataFrame:
    """(kind, n_groups, n_leaking): texts and clusters that stand in more than one split; none may."""
    by_text = df.where(F.col(split).isNotNull()).groupBy(F.md5(dedup_key(F.col(text), form)).alias("k")).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    by_cluster = df.where(F.col(split).isNotNull() & F.col(cluster).isNotNull()).groupBy(F.col(cluster).cast("string").alias("k")).agg(F.min(split).alias("lo"), F.max(split).alias("hi"))
    both = by_text.withColumn("kind", F.lit("text")).unionByName(by_cluster.withColumn("kind", F.lit("cluster")))
    return both.groupBy("kind").agg(F.count(F.lit(1)).alias("n_groups"), F.sum((F.col("lo") != F.col("hi")).cast("long")).alias("n_leaking"))
