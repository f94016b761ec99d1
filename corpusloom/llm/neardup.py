"""Problem 2: near-duplicate records with small edits (sequential Bayesian verification).

A text is the multiset of its words, order ignored.  Every text gets a MinHash signature of that multiset
(each repetition of a word is an element of its own).  Texts that agree in a whole band of their
signatures are candidates.  A candidate pair is then compared batch by batch: after each batch of the
signature the pair is dropped if, given the matches so far, the posterior probability that its similarity
reaches the threshold is below the chosen miss probability.  What survives is verified exactly.

Why the bands suffice: if the shared words make up a share t of the longer text, the Jaccard similarity of
the multisets is at least t / (2 - t), 0.818 for 0.9.  With BANDS bands of ROWS rows, a pair at that bound is
missed with probability (1 - 0.818 ** 8) ** 48 = 2e-5, and the Bayesian pruning adds MISS.

Skew: signatures are made for one representative of each set of formatting copies (problem 6), so a post that
holds a third of all rows is one text here.  Buckets are counted by an aggregation that combines on the map
side and also carries the two ends of each bucket, so a bucket of two, the usual case, is a pair at once.
Buckets of up to SMALL texts are listed; the texts of larger ones are spread over pairs of blocks, and each
task compares the signatures of its two blocks and emits only pairs that survive, each in the first band that it
shares.  No bucket is capped.

Classes need not all pairs.  Each text is first compared with one representative of each of its buckets; the links
so found make classes, and then only texts of one bucket and different classes are compared.  What is not compared
is in one class already, so the classes are those of all pairs, without quadratic work in a large bucket of copies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from math import ceil, lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import forms, garble
from corpusloom.llm.copies import SOUND, content_rows, representatives
from corpusloom.operators.graph import components
from corpusloom.plans.durable import discard, join_skewed, keep

BANDS, ROWS = 48, 8
#: Bands and rows where classes alone are wanted: a pair at the bound is missed with probability (1 - 0.818 ** 8) ** 36 = 3e-4, and its ends may still meet through others.
CLASS_BANDS, CLASS_ROWS = 36, 8
#: Hashes of the signature that candidates are compared by, in batches; pairs below 0.6 or so never outlast them.
BATCH, COMPARED = 32, 128
#: Probability at which a pair that reaches the threshold may be dropped while its signature is compared.
MISS = 1e-5
#: Texts in a bucket up to which its pairs are listed; beyond, blocks of BLOCK texts are compared in tasks of their own.
SMALL, BLOCK = 24, 2000

_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, case ignored."""
    return _WORD.findall(text.casefold())


def elements(text: str) -> np.ndarray:
    """The word multiset as sorted 48-bit elements: a word's k-th repetition is the k-th element of that word."""
    seen: dict[str, int] = {}
    out = []
    for w in words(text):
        k = seen.get(w, 0)
        seen[w] = k + 1
        out.append(xxhash.xxh64_intdigest(w, k))
    return np.unique(np.array(out, np.uint64) >> np.uint64(16))


def packed(el: np.ndarray) -> bytes:
    """48-bit elements in 6 bytes each."""
    return el.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


@lru_cache(1)
def _hashes() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240301)
    n = BANDS * ROWS
    return r.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def signature(el: np.ndarray, hashes: int = BANDS * ROWS) -> bytes:
    """One byte of each of so many minima (multiply-shift hashing)."""
    a, b = _hashes()
    h = ((el[:, None] * a[None, :hashes] + b[None, :hashes]) >> np.uint64(24)).min(axis=0)
    h ^= h >> np.uint64(17)
    return (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


@lru_cache(8)
def _least_matches(threshold: float, miss: float, total: int) -> tuple[int, ...]:
    """For n = BATCH, 2 BATCH, ... compared hashes: the fewest matches at which a pair stays.

    Prior of the similarity: uniform.  Posterior after m of n matches: Beta(m + 1, n - m + 1), cut at the threshold.
    """
    grid = np.linspace(0, 1, 2001)[1:-1]
    out = []
    for n in range(BATCH, total + 1, BATCH):
        for m in range(n + 1):
            logp = m * np.log(grid) + (n - m) * np.log1p(-grid) + lgamma(n + 2) - lgamma(m + 1) - lgamma(n - m + 1)
            if np.exp(logp)[grid >= threshold].sum() / 2000 >= miss:
                out.append(m)
                break
    return tuple(out)


def survivors(sig_a: np.ndarray, sig_b: np.ndarray, threshold: float, miss: float = MISS) -> np.ndarray:
    """Indices of the row pairs that are still likely enough after all batches of their signatures."""
    left = np.arange(len(sig_a))
    matches = np.zeros(len(sig_a), np.int32)
    for i, least in enumerate(_least_matches(threshold, miss, sig_a.shape[1])):
        lo = i * BATCH
        matches = matches + (sig_a[left, lo : lo + BATCH] == sig_b[left, lo : lo + BATCH]).sum(axis=1)
        stay = matches >= least
        left, matches = left[stay], matches[stay]
        if not len(left):
            break
    return left


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _jaccard(share: float) -> float:
    return share / (2 - share)


def _sketch(batches: Iterator[pa.RecordBatch], least_words: int, repair: bool, hashes: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, sigs, els = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            e = elements(forms.plain(garble.repair(t)[0])[0] if repair else t)
            if len(e) >= least_words:
                ids.append(i)
                sigs.append(signature(e, hashes))
                els.append(packed(e))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(sigs, pa.binary()), pa.array(els, pa.binary())], names=["id", "sig", "el"])


def _sig_matrix(col: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.uint8).reshape(len(col), -1)


def _exact(at: np.ndarray, ids_a: list, ids_b: list, el_a: list[bytes], el_b: list[bytes], share: float) -> list[tuple]:
    out = []
    for i in at:
        ea, eb = el_a[i], el_b[i]
        la, lb = len(ea) // 6, len(eb) // 6
        need = ceil(share * max(la, lb) - 1e-9)
        if min(la, lb) >= need and (s := shared(unpacked(ea), unpacked(eb))) >= need:
            out.append((min(ids_a[i], ids_b[i]), max(ids_a[i], ids_b[i]), s / max(la, lb)))
    return out


def _pairs_batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), pa.array(cols[1], kind), pa.array(cols[2], pa.float64())], names=["id_a", "id_b", "similarity"])


def _verify(batches: Iterator[pa.RecordBatch], share: float) -> Iterator[pa.RecordBatch]:
    """Listed candidates: id_a, sig_a, el_a, id_b, sig_b, el_b; of signatures the first COMPARED hashes."""
    for b in batches:
        if not b.num_rows:
            continue
        ia, sa, ea, ib, sb, eb = (c.to_pylist() for c in b.columns)
        yield _pairs_batch(_exact(survivors(_sig_matrix(sa), _sig_matrix(sb), _jaccard(share)), ia, ib, ea, eb, share), b.schema.field(0).type)


def _verify_blocks(batches: Iterator[pa.RecordBatch], share: float, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted by grp: (grp, side, band, cls, id, sig, el) with whole signatures.  A group is two blocks of a large bucket, or one with itself.

    Pairs of one class, other than class 0, are left out, and such as share an earlier band.
    """
    grp, held = None, ([], [])

    def flush() -> Iterator[pa.RecordBatch]:
        left, right = held
        if not left:
            return
        same = not right
        other = left if same else right
        sigs, classes = _sig_matrix([x[3] for x in other]), np.array([x[1] for x in other])
        for k, (band, cls, i, sig, el) in enumerate(left):
            at = np.arange(k + 1 if same else 0, len(other))
            at = at[classes[at] != cls] if cls else at
            if not len(at):
                continue
            own = np.frombuffer(sig, np.uint8)
            one = np.broadcast_to(own[:COMPARED], (len(at), COMPARED))
            at = at[survivors(one, sigs[at, :COMPARED], _jaccard(share))]
            if band:
                at = at[~(sigs[at, : band * rows].reshape(len(at), band, rows) == own[: band * rows].reshape(band, rows)).all(axis=2).any(axis=1)]
            found = _exact(np.arange(len(at)), [i] * len(at), [other[j][2] for j in at], [el] * len(at), [other[j][4] for j in at], share)
            if found:
                yield _pairs_batch(found, kind)

    for b in batches:
        kind = b.schema.field("id").type
        for g, side, *row in zip(*(c.to_pylist() for c in b.columns)):
            if g != grp:
                yield from flush()
                grp, held = g, ([], [])
            held[side].append(row)
    yield from flush()


def sketches(texts: DataFrame, least_words: int = 1, repair: bool = False, hashes: int = BANDS * ROWS) -> DataFrame:
    """A written table (id, sig, el, n) of each text with enough words; n is a number for the id.  texts: id, text.

    With repair, garbled and look-alike text is first restored.
    """
    made = texts.mapInArrow(lambda it: _sketch(it, least_words, repair, hashes), "id string, sig binary, el binary")
    return keep(made.withColumn("n", F.monotonically_increasing_id()), "sketches")


def _buckets(sketch: DataFrame, bands: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (bucket, size, a, b: its least and greatest n) of buckets of two texts or more, and (bucket, size, first: its least n, band, n) of the texts of larger ones."""
    # A band is a byte for each of its hashes; the JVM cuts bands out of the signature.
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band")
    cut = sketch.select("n", "sig", band).select("n", "band", F.xxhash64("band", F.expr(f"substring(sig, band * {rows} + 1, {rows})")).alias("bucket"))
    counts = cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("n").alias("a"), F.max("n").alias("b")).where("size > 1")
    counts = keep(counts, "buckets")
    more = keep(join_skewed(cut, counts.where("size > 2").select("bucket", "size", F.col("a").alias("first"), F.col("size").alias("weight")), ["bucket"], "weight"), "members")
    return counts, more


def _listed(members: DataFrame) -> DataFrame:
    """(first, x, y) with x, y structs (n, cls), x.n < y.n, of the pairs of each bucket.  members: bucket, first, n, cls; SMALL texts a bucket at most."""
    lists = members.groupBy("bucket", "first").agg(F.sort_array(F.collect_list(F.struct("n", "cls"))).alias("m"))
    return lists.select("first", F.posexplode("m").alias("i", "x"), "m").select("first", "x", F.explode(F.expr("slice(m, i + 2, size(m))")).alias("y"))


def _plausible(pairs: DataFrame, sketch: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) whose numbers of words let them be similar; two joins of a few bytes a row, before those of the sketches."""
    size = sketch.select("n", F.length("el").alias("w"))
    both = pairs.join(size.select(F.col("n").alias("a"), F.col("w").alias("wa")), "a").join(size.select(F.col("n").alias("b"), F.col("w").alias("wb")), "b")
    return both.where(F.least("wa", "wb") >= F.greatest("wa", "wb") * share - 1e-6).select("a", "b")


def _compare(pairs: DataFrame, sketch: DataFrame, name: str, share: float) -> DataFrame:
    """(id_a, id_b, similarity) of the pairs (a, b) of n that are similar; the ids are those of column `name`."""
    slim = sketch.select("n", F.col(name).alias("id"), F.expr(f"substring(sig, 1, {COMPARED})").alias("sig"), "el")
    left = slim.select(F.col("n").alias("a"), F.col("id").alias("id_a"), F.col("sig").alias("sig_a"), F.col("el").alias("el_a"))
    right = slim.select(F.col("n").alias("b"), F.col("id").alias("id_b"), F.col("sig").alias("sig_b"), F.col("el").alias("el_b"))
    full = pairs.join(left, "a").join(right, "b").select("id_a", "sig_a", "el_a", "id_b", "sig_b", "el_b")
    kind = sketch.schema[name].dataType.simpleString()
    return full.mapInArrow(lambda it: _verify(it, share), f"id_a {kind}, id_b {kind}, similarity double")


def _compare_blocks(members: DataFrame, sketch: DataFrame, name: str, share: float, block: int, rows: int) -> DataFrame:
    """The same for all pairs of each large bucket.  members: bucket, size, band, n, cls.  Each text goes to the block pairs that its own block is part of."""
    blocks = F.ceil(F.col("size") / F.lit(block)).cast("int")
    large = members.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("n"), F.col("k").cast("long")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    large = large.select(F.xxhash64("bucket", lo, hi).alias("grp"), F.when(lo == hi, 0).otherwise((F.col("own") == hi).cast("int")).alias("side"), "band", "cls", "n")
    large = keep(large, "blocks")
    # Texts of large buckets are few; the others are left out before their sketches are moved.
    own = sketch.join(large.select("n").distinct(), "n", "left_semi").select("n", F.col(name).alias("id"), "sig", "el")
    large = large.join(own, "n").select("grp", "side", "band", "cls", "id", "sig", "el")
    kind = sketch.schema[name].dataType.simpleString()
    return large.repartition("grp").sortWithinPartitions("grp").mapInArrow(lambda it: _verify_blocks(it, share, rows), f"id_a {kind}, id_b {kind}, similarity double")


def similar_pairs(sketch: DataFrame, share: float = 0.9, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(id_a, id_b, similarity), id_a < id_b, of all pairs whose shared words make up `share` of the longer text.

    sketch: a written table of sketches; id is unique.
    """
    counts, more = _buckets(sketch, BANDS, ROWS)
    more = more.withColumn("cls", F.lit(0).cast("long"))
    # Lists of at most `small` numbers; larger buckets do not reach this aggregation.
    listed = _listed(more.where(F.col("size") <= small)).select(F.col("x.n").alias("a"), F.col("y.n").alias("b"))
    pairs = counts.where("size = 2").select("a", "b").unionByName(listed).where("a < b").distinct()
    out = _compare(pairs, sketch, "id", share)
    large = more.where(F.col("size") > small)
    if large.isEmpty():
        return out
    return out.unionByName(_compare_blocks(large, sketch, "id", share, block, ROWS)).dropDuplicates(["id_a", "id_b"])


def similar_classes(sketch: DataFrame, share: float = 0.9, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(n, root) of all texts that are similar to another, directly or through others; root is the least n of its class.

    sketch: a written table of sketches of CLASS_BANDS * CLASS_ROWS hashes.  The classes are those of all similar pairs.
    """
    counts, more = _buckets(sketch, CLASS_BANDS, CLASS_ROWS)
    # Each text against the first of its bucket.
    star = counts.where("size = 2").select("a", "b").unionByName(more.where("n > first").select(F.col("first").alias("a"), F.col("n").alias("b"))).distinct()
    star = keep(_plausible(star, sketch, share), "star")
    # The first of a bucket may stand for very many texts.
    firsts = star.groupBy("a").agg(F.count(F.lit(1)).alias("k")).join(sketch.select(F.col("n").alias("a"), F.expr(f"substring(sig, 1, {COMPARED})").alias("sig_a"), F.col("el").alias("el_a")), "a")
    firsts = keep(firsts, "firsts")
    right = sketch.select(F.col("n").alias("b"), F.expr(f"substring(sig, 1, {COMPARED})").alias("sig_b"), F.col("el").alias("el_b"))
    full = join_skewed(star, firsts, ["a"], "k").join(right, "b").select("a", "sig_a", "el_a", "b", "sig_b", "el_b")
    links = keep(full.mapInArrow(lambda it: _verify(it, share), "id_a long, id_b long, similarity double").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "links")
    discard(star, firsts, counts)
    roots = keep(components(links), "classes")
    # Buckets whose texts are not all of one class; a class, plus 1, that is not 0.
    named = more.join(roots.select(F.col("node").alias("n"), "root"), "n", "left").withColumn("cls", F.coalesce("root", "n") + 1).drop("root")
    apart = named.groupBy("bucket").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low <> high").select("bucket")
    # The first of the bucket has been compared with all others.
    left_over = keep(named.join(apart, "bucket").where("n > first"), "apart")
    discard(more)
    listed = _listed(left_over.where(F.col("size") <= small)).where("x.cls <> y.cls").select(F.col("x.n").alias("a"), F.col("y.n").alias("b")).distinct()
    # Few pairs are left, as a written table, so that its size decides how they are joined.
    late = _compare(keep(_plausible(listed, sketch, share), "late_pairs"), sketch, "n", share)
    large = left_over.where(F.col("size") > small)
    if not large.isEmpty():
        late = late.unionByName(_compare_blocks(large, sketch, "n", share, block, CLASS_ROWS))
    late = keep(late.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")), "late")
    if late.isEmpty():
        return roots.select(F.col("node").alias("n"), "root")
    return components(links.unionByName(late)).select(F.col("node").alias("n"), "root")


def _set_texts(df: DataFrame, id_col: str, text_col: str, least_words: int, repair: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with their kind, content sets, (id, text) of one representative of each set of formatting copies that is long enough)."""
    rows = keep(content_rows(df, id_col, text_col, repair), "content")
    sets = keep(representatives(rows.where(f"kind = {SOUND}"), all_sets=True).select("key", "check", "n", "first_id"), "sets")
    first = sets.select(F.col("first_id").alias("id")).distinct()
    # Words and the signs between them take two characters each, which the JVM can tell before the join; restored text may be longer.
    least_chars = 1 if repair else 2 * least_words - 1
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.length("text") >= least_chars)
    # An id that repeats has one text here, the least.
    return rows, sets, texts.join(first, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))


def found(df: DataFrame, id_col: str = "id", text_col: str = "text_clean", least_words: int = 36, share: float = 0.9) -> DataFrame:
    """(id_a, id_b): pairs of sets of formatting copies, each by its smallest id, that share `share` of their words.

    Texts that are null, blank, garbled, written with look-alikes or shorter than least_words take no part.
    """
    _, _, texts = _set_texts(df, id_col, text_col, least_words)
    return similar_pairs(sketches(texts, least_words), share).select("id_a", "id_b")


def clusters(df: DataFrame, id_col: str = "id", text_col: str = "text_clean", share: float = 0.9) -> DataFrame:
    """(id, class_id, class_texts): the near-duplicate class of every row, by the least id of its rows, and how many different texts it holds.

    Garbled and look-alike text is first restored, and texts of any length take part.  Copies that differ only in
    formatting are one text.  A row without a letter or digit is a class of its own, of no text.
    """
    rows, sets, texts = _set_texts(df, id_col, text_col, 1, repair=True)
    sketch = sketches(texts, 1, repair=True, hashes=CLASS_BANDS * CLASS_ROWS)
    classes = similar_classes(sketch, share).join(sketch.select("n", "id"), "n")
    named = classes.groupBy("root").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_texts"))
    member = classes.join(named, "root").select(F.col("id").alias("first_id"), "class_id", "class_texts")
    by_key = sets.join(member, "first_id", "left").select("key", "check", "n", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_texts", F.lit(1)).alias("class_texts"))
    worded = rows.where(f"kind = {SOUND}")
    out = join_skewed(worded.select("key", "check", "id"), keep(by_key, "by_key"), ["key", "check"], "n").select("id", "class_id", "class_texts")
    return out.unionByName(rows.where(f"kind <> {SOUND}").select("id", F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("class_texts")))
