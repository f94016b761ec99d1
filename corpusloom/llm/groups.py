"""Problem 3: splits that keep related records together.

Related records are found by the distributed union-find of operators.graph: every task builds the forest of
its own edges, and forests are merged level by level in fewer and fewer tasks.

Groups are then assigned largest first to the split that is furthest below its target, in rows and in
positive labels.  Large groups are assigned one by one; small ones, of which there are very many alike, by
the classes of equal size and labels, whose members are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.graph import components
from corpusloom.operators.splits import LARGE_SHARE, by_spans, numbered, spans_of
from corpusloom.plans.durable import join_skewed, keep

#: Splits that may be wanted; a longer table is refused.
MOST_SPLITS = 1000

# How an absent link is written.
NO_LINK = ("", "na", "n/a", "none", "nan", "null", "-", "?")


def link_edges(corpus: DataFrame, pairs: DataFrame, lone_rows: bool) -> DataFrame:
    """Edges (a, b) between clusters and the records that tie them.

    A record X ties the rows it stands for and the rows derived from it, if some of either kind are in the
    corpus; both meet at the node of X, so that a record with very many copies costs one edge a row.
    Nodes are texts: c<cluster>, x<record> and, with lone_rows, r<id> of rows without a cluster.
    """
    rows = corpus.select(
        F.col("id"), F.when(F.col("dup_cluster_id").isNotNull(), F.concat(F.lit("c"), F.col("dup_cluster_id").cast("string"))).otherwise(F.concat(F.lit("r"), F.col("id")) if lone_rows else F.lit(None)).alias("node")
    ).where("id like 'vidgen%' and node is not null")
    p = pairs.select(F.concat(F.lit("vidgen_"), F.col("row_no").cast("string")).alias("id"), F.trim("acl_id").alias("own"), F.trim("acl_id_matched").alias("of")).distinct()
    present = p.join(rows, "id")
    absent = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*NO_LINK)
    ends = present.where(~absent("own")).select(F.col("own").alias("x"), "node", F.lit(1).alias("source"), F.lit(0).alias("derived"))
    ends = ends.unionByName(present.where(~absent("of")).select(F.col("of").alias("x"), "node", F.lit(0).alias("source"), F.lit(1).alias("derived"))).distinct()
    ends = keep(ends, "ends")
    tied = ends.groupBy("x").agg(F.max("source").alias("s"), F.max("derived").alias("d")).where("s = 1 and d = 1").select("x")
    return ends.join(tied, "x").select(F.concat(F.lit("x"), F.col("x")).alias("a"), F.col("node").alias("b"))


def found(corpus: DataFrame, pairs: DataFrame) -> DataFrame:
    """(dup_cluster_id): stored clusters whose tied clusters, themselves included, have rows in more than one split."""
    roots = components(link_edges(corpus, pairs, lone_rows=False)).where("node like 'c%'")
    clusters = corpus.where("dup_cluster_id is not null").groupBy("dup_cluster_id").agg(F.min("split").alias("low"), F.max("split").alias("high"))
    clusters = clusters.withColumn("node", F.concat(F.lit("c"), F.col("dup_cluster_id").cast("string")))
    clusters = keep(clusters.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "clusters")
    split = clusters.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("root")
    return clusters.join(split, "root").select("dup_cluster_id")


def greedy(groups: list[tuple[int, int, int]], ratios: dict[str, float]) -> list[dict[str, int]]:
    """Largest-first greedy assignment of classes of groups.

    groups: (rows of a group, positives of a group, number of such groups), largest first.  Gives for each class
    how many of its groups each split gets.  Each group goes to the split that is furthest below its target,
    where the distance is taken in positives and in other rows, each in proportion to their whole, and a group
    counts for what it brings of either; ties go by name.  A class of many equal groups is filled in steps of a
    64th of what is left, and of one at the end.
    """
    pos = sum(p * n for _, p, n in groups) or 1
    rest = sum((s - p) * n for s, p, n in groups) or 1
    names = sorted(ratios)
    whole = sum(ratios.values()) or 1
    target = {k: ratios[k] / whole for k in names}
    have, have_pos = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    out = []
    for size, p, n in groups:
        given = dict.fromkeys(names, 0)
        left = n
        while left:
            step = max(1, left // 64)
            gap = lambda k: (target[k] - have[k] / rest) * (size - p) / rest + (target[k] - have_pos[k] / pos) * p / pos
            best = max(names, key=lambda k: (gap(k), -names.index(k)))
            given[best] += step
            have[best] += (size - p) * step
            have_pos[best] += p * step
            left -= step
        out.append(given)
    return out


def wanted_shares(ratios: DataFrame) -> dict[str, float]:
    """The positive ratios by split; none, or more than MOST_SPLITS, is an error."""
    rows = ratios.select("split_name", "ratio").where("split_name is not null and ratio > 0").limit(MOST_SPLITS + 1).collect()
    if not 0 < len(rows) <= MOST_SPLITS:
        raise ValueError(f"between 1 and {MOST_SPLITS} splits with a positive ratio are needed")
    return {r["split_name"]: float(r["ratio"]) for r in rows}


def assign(corpus: DataFrame, pairs: DataFrame, ratios: DataFrame) -> DataFrame:
    """(id, split): every row gets a split; rows tied by dup_cluster_id or by pairs share it.

    A row without a cluster is a group of its own unless a pair ties it.  Null labels count as no positive.
    Shares come close to the ratios as far as the largest group allows.  The driver sees the large groups, of which
    there are LARGE_SHARE at most, and the classes of the small ones, some thousands whatever the corpus.
    """
    spark: SparkSession = corpus.sparkSession
    wanted = wanted_shares(ratios)
    roots = components(link_edges(corpus, pairs, lone_rows=True)).where("node not like 'x%'")
    rows = corpus.select(
        F.col("id"), F.coalesce(F.concat(F.lit("c"), F.col("dup_cluster_id").cast("string")), F.concat(F.lit("r"), F.col("id"))).alias("node"), (F.col("label") == 1).cast("int").alias("pos")
    )
    # Rows are first counted by node, with map-side combining: a cluster may hold a third of all rows.
    nodes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("p"))
    nodes = keep(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "nodes")
    groups = keep(nodes.groupBy("root").agg(F.sum("n").alias("n"), F.sum("p").alias("p")), "groups")
    total = groups.agg(F.sum("n")).first()[0] or 0
    large = groups.where(F.col("n") * LARGE_SHARE >= total).limit(LARGE_SHARE).collect()
    rest = groups.where(F.col("n") * LARGE_SHARE < total)
    # Small groups by class: exact up to 32 rows, by steps of a tenth in size and positives beyond, so classes are few.
    size = F.when(F.col("n") <= 32, F.col("n")).otherwise(F.lit(1000) + F.floor(F.log(1.1, F.col("n").cast("double"))))
    share = F.when(F.col("n") <= 32, F.col("p")).otherwise(F.round(F.col("p") * 10 / F.col("n")))
    rest = rest.withColumn("c1", size.cast("long")).withColumn("c2", share.cast("long")).withColumn("h", F.md5("root"))
    plan = [(r["n"], r["p"], 1, ("large", r["root"])) for r in large]
    in_classes = 0
    for r in rest.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("p").alias("p")).collect():
        plan.append((r["n"] / r["k"], r["p"] / r["k"], r["k"], ("class", (r["c1"], r["c2"]))))
        in_classes += r["k"]
    plan.sort(key=lambda x: (-x[0], -x[1], str(x[3])))
    # Within a class, groups are numbered; each split gets a range of the numbers.
    big, spans = [], []
    for (_, _, _, (kind, key)), got in zip(plan, greedy([x[:3] for x in plan], wanted)):
        if kind == "large":
            big.append((key, next(s for s, c in got.items() if c)))
        else:
            spans += [(*key, *span) for span in spans_of(dict(sorted(got.items())))]
    small = by_spans(numbered(rest.select("root", "c1", "c2", "h"), ["c1", "c2"], ["h", "root"], in_classes), spans, "c1 long, c2 long").select("root", "split_to")
    by_root = small.unionByName(spark.createDataFrame(big, "root string, split_to string"))
    by_node = keep(nodes.join(by_root, "root").select("node", "n", F.col("split_to").alias("split")), "assigned")
    return join_skewed(rows.select("node", "id"), by_node, ["node"], "n").select("id", "split")
