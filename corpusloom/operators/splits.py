"""Splits by hash: stateless, the same for a row whatever else is in the table; and splits by groups, balanced over strata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.dedup import exact_duplicates, near_clusters, pair_links
from corpusloom.operators.graph import components
from corpusloom.plans.durable import join_skewed, keep

#: Groups that hold this share of all rows, or more, are assigned one by one; there are at most as many.
LARGE_SHARE = 2000
#: Rows that one task sorts to number them.
ROWS_PER_TASK = 200_000


def unit(c: Column, seed: int) -> Column:
    """A number from 0 up to 1 from the md5 of seed and key, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), c)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def group_split(df: DataFrame, group: Column, ratios: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """Adds split_to: all rows of a group share it.  Shares hold in expectation over groups."""
    u = unit(group, seed)
    out, edge = F.lit(ratios[-1][0]), 1.0
    for name, r in reversed(ratios[:-1]):
        edge = round(sum(x for n, x in ratios[: [n for n, _ in ratios].index(name) + 1]), 9)
        out = F.when(u < edge, name).otherwise(out)
    return df.withColumn("split_to", out)


def numbered(df: DataFrame, classes: Sequence[str], order: Sequence[str], n_rows: int, as_col: str = "i", per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds the number of each row within its class, from 0 up, in the order given.  The first of `order` is hexadecimal text, such as an md5.

    Rows are numbered within buckets of the order's first digits, and the starts of the buckets are added; there are
    so many buckets that a class of all n_rows rows is cut into parts of per_task rows or fewer.
    """
    digits, most = 0, n_rows
    while most > per_task:
        digits, most = digits + 1, most / 16
    rows = df.withColumn("_b", F.substring(order[0], 1, digits) if digits else F.lit(""))
    # One text key, in which null classes meet too.
    rows = rows.withColumn("_k", F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in classes]))
    sizes = rows.groupBy("_k", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_k", "_b", before.alias("_s"))
    own = F.row_number().over(Window.partitionBy("_k", "_b").orderBy(*order)) - 1
    return rows.withColumn("_i", own).join(starts, ["_k", "_b"]).withColumn(as_col, F.col("_s") + F.col("_i")).select(*df.columns, as_col)


def stratified_folds(df: DataFrame, label: str = "label", k: int = 5, seed: int = 42, id_col: str = "id", per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Adds fold, 0..k-1, spread evenly within each label, null labels included; a label that holds most rows is not sorted in one task."""
    rows = df.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col(id_col))))
    out = numbered(rows, [label], ["_h", id_col], df.count(), "_at", per_task)
    return out.withColumn("fold", (F.col("_at") % k).cast("int")).select(*df.columns, "fold")


def related(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, grp): rows tied by equal or similar text, by a pair or by the stored cluster, through others too, share a group."""
    near = keep(near_clusters(corpus, links=pair_links(corpus, pairs)), "near")
    stored = corpus.where("dup_cluster_id is not null").select("id", F.concat(F.lit("s"), F.col("dup_cluster_id").cast("string")).alias("b"))
    roots = components(near.join(stored, "id").select(F.concat(F.lit("r"), F.col("cluster")).alias("a"), "b").distinct())
    roots = keep(roots.where("node like 'r%'").select(F.expr("substring(node, 2)").alias("cluster"), F.col("root").alias("grp")), "roots")
    # Clusters are counted first: one may hold a third of all rows.
    size = near.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    by_cluster = keep(size.join(roots, "cluster", "left").select("cluster", "n", F.coalesce("grp", F.concat(F.lit("r"), F.col("cluster"))).alias("grp")), "groups")
    return join_skewed(near, by_cluster, ["cluster"], "n").select("id", "grp")


def allot(classes: Sequence[tuple[dict[str, float], int]], ratios: Sequence[tuple[str, float]]) -> list[dict[str, int]]:
    """Greedy assignment of classes of groups, largest first: how many groups of each class each split gets.

    classes: (rows of a group by stratum, number of such groups).  A group goes to the split that is furthest below
    its share in the strata of the group, each in proportion to its whole; ties go by order.  Strata too small to
    give each split a row count as one.  A class of many equal groups is filled in steps of a 64th of what is left,
    and of one at the end.
    """
    total = sum(r for _, r in ratios)
    want = {name: r / total for name, r in ratios}
    rows_of: dict[str, float] = {}
    for rows, k in classes:
        for s, n in rows.items():
            rows_of[s] = rows_of.get(s, 0.0) + n * k
    pool = {s: s if n * min(want.values()) >= 1 else None for s, n in rows_of.items()}
    whole: dict[str | None, float] = {}
    for s, n in rows_of.items():
        whole[pool[s]] = whole.get(pool[s], 0.0) + n
    have = {name: dict.fromkeys(whole, 0.0) for name in want}
    out = []
    for rows, k in classes:
        given, left = dict.fromkeys(want, 0), k
        while left:
            step = max(1, left // 64)
            best = max(want, key=lambda x: sum((want[x] - have[x][pool[s]] / whole[pool[s]]) * n / whole[pool[s]] for s, n in rows.items()))
            given[best] += step
            for s, n in rows.items():
                have[best][pool[s]] += n * step
            left -= step
        out.append(given)
    return out


def by_spans(numbered_rows: DataFrame, spans: Sequence[tuple], classes: str) -> DataFrame:
    """Adds split_to from ranges of the numbers within a class.  spans: (class columns, lo, hi, split); there are as many as classes times splits."""
    names = [c.split()[0] for c in classes.split(",")]
    ranges = numbered_rows.sparkSession.createDataFrame(list(spans), f"{classes}, lo long, hi long, split_to string")
    return numbered_rows.join(F.broadcast(ranges), names).where("i >= lo and i < hi").drop("lo", "hi", "i")


def spans_of(given: dict[str, int]) -> list[tuple[int, int, str]]:
    """(first, end, split) of the numbers 0, 1, ... of a class, of which each split gets so many."""
    out, at = [], 0
    for s, c in given.items():
        if c:
            out.append((at, at + c, s))
        at += c
    return out


def stratified_group_split(df: DataFrame, groups: DataFrame, strata: Sequence[str], ratios: Sequence[tuple[str, float]]) -> DataFrame:
    """(id, split_to): all rows of a group share a split, and splits come close to the ratios in all rows and in each stratum.

    groups: a written table (id, grp) with every id once.  Large groups are assigned one by one; small ones, of which
    there are very many alike, by classes of equal rows by stratum, whose members are interchangeable: the groups of a
    class are numbered, and each split gets a range of the numbers.  The driver sees the large groups and the classes alone.
    """
    spark = df.sparkSession
    stratum = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in strata])
    cells = keep(df.select("id", stratum.alias("s")).join(groups, "id").groupBy("grp", "s").agg(F.count(F.lit(1)).alias("n")), "cells")
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = keep(sizes.where(F.col("n") * LARGE_SHARE >= total).limit(LARGE_SHARE), "large")
    big: dict[str, dict[str, int]] = {}
    for r in cells.join(F.broadcast(large.select("grp")), "grp").collect():
        big.setdefault(r["grp"], {})[r["s"]] = r["n"]
    # A class is the rows by stratum: exact for groups of one stratum up to 32 rows, by the size in steps of a tenth, the two
    # main strata and the share of the first in tenths for all others, so classes are few.
    rest = cells.join(F.broadcast(large.select("grp")), "grp", "left_anti")
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "s"))), 1, 2)  # as many entries as strata
    made = rest.groupBy("grp").agg(F.sum("n").alias("n"), top.alias("top"))
    size = F.when(F.col("n") <= 32, F.col("n")).otherwise(F.lit(1000) + F.floor(F.log(1.1, F.col("n").cast("double"))))
    cls = F.concat_ws("\x1f", size, F.round(-F.col("top")[0]["m"] * 10 / F.col("n")).cast("int"), F.col("top")["s"])
    made = keep(made.select("grp", "n", cls.alias("cls"), F.md5("grp").alias("h")), "classes")
    counted = {r["cls"]: r["k"] for r in made.groupBy("cls").agg(F.count(F.lit(1)).alias("k")).collect()}
    inside: dict[str, dict[str, int]] = {}
    for r in rest.join(made.select("grp", "cls"), "grp").groupBy("cls", "s").agg(F.sum("n").alias("n")).collect():
        inside.setdefault(r["cls"], {})[r["s"]] = r["n"]
    plan = [(rows, 1, True, g) for g, rows in big.items()]
    plan += [({s: n / k for s, n in inside[c].items()}, k, False, c) for c, k in counted.items()]
    plan.sort(key=lambda x: (-sum(x[0].values()), not x[2], x[3]))
    one_by_one, spans = [], []
    for (_, _, alone, key), given in zip(plan, allot([x[:2] for x in plan], ratios)):
        if alone:
            one_by_one.append((key, next(s for s, c in given.items() if c)))
        else:
            spans += [(key, *span) for span in spans_of(given)]
    small = by_spans(numbered(made, ["cls"], ["h", "grp"], sum(counted.values())), spans, "cls string").select("grp", "n", "split_to")
    alone = large.join(F.broadcast(spark.createDataFrame(one_by_one, "grp string, split_to string")), "grp").select("grp", "n", "split_to")
    return join_skewed(groups, keep(small.unionByName(alone), "assigned"), ["grp"], "n").select("id", "split_to")


def make_splits(corpus: DataFrame, pairs: DataFrame, ratios: Sequence[tuple[str, float]], strata: Sequence[str] = ("language", "source_dataset", "label"), text: str = "text_clean", form: str = "NFKC") -> tuple[DataFrame, DataFrame]:
    """(rows, statistics): exact duplicates go, near-duplicates and linked pairs are clustered, clusters are split with strata.

    rows: (id, cluster, split_to) of the rows that are left.  statistics: (name, value) with rows_in, exact_removed,
    rows_after_exact, near_clusters and split_<name> for each split.
    """
    left = keep(exact_duplicates(corpus, text=text, form=form), "left")
    clusters = keep(near_clusters(left, text=text, links=pair_links(left, pairs), form=form).select("id", F.col("cluster").alias("grp")), "clusters")
    rows = keep(clusters.join(stratified_group_split(left, clusters, strata, ratios), "id").select("id", F.col("grp").alias("cluster"), "split_to"), "splits")
    n_in, n_left = corpus.count(), left.count()
    counts = {"rows_in": n_in, "exact_removed": n_in - n_left, "rows_after_exact": n_left, "near_clusters": rows.select("cluster").distinct().count()}
    whole = left.sparkSession.createDataFrame(list(counts.items()), "name string, value long")
    return rows, whole.unionByName(rows.groupBy(F.concat(F.lit("split_"), "split_to").alias("name")).agg(F.count(F.lit(1)).alias("value")))
