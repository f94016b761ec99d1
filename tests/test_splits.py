import random

from corpusloom.operators import splits as S

RATIOS = [("train", 0.7), ("val", 0.15), ("test", 0.15)]


def test_copies_pairs_and_stored_clusters_share_a_split_and_strata_are_balanced(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8))
    rows = [(f"x_{k:05}", " ".join(word() for _ in range(12)), 1 if k % 5 == 0 else 0, "pt" if k % 3 else "en", "a", None) for k in range(3000)]
    # A third of all rows in one stored cluster, a copy, a near-copy, and two rows tied by a pair.
    rows = [(*x[:5], 7) if k < 1000 else x for k, x in enumerate(rows)]
    text = " ".join(word() for _ in range(40))
    rows += [("y_1", text, 0, "en", "a", None), ("y_2", text.upper(), 0, "pt", "a", None), ("y_3", text + "s", 1, "en", "b", 8), ("y_4", "other words", None, None, "b", 8)]
    rows += [("vidgen_1", "one text", 0, "en", "a", None), ("vidgen_2", "quite another", 1, "en", "a", None), ("z", None, 1, "en", "a", None)]
    df = spark.createDataFrame(rows, "id string, text_clean string, label int, language string, source_dataset string, dup_cluster_id bigint")
    pairs = spark.createDataFrame([(1, "A", "NA"), (2, "B", "A")], "row_no bigint, acl_id string, acl_id_matched string")
    groups = S.keep(S.related(df, pairs), "related")
    grp = {x.id: x.grp for x in groups.collect()}
    assert len({grp[f"y_{k}"] for k in (1, 2, 3, 4)}) == 1 and grp["vidgen_1"] == grp["vidgen_2"] and len({grp[x[0]] for x in rows[:1000]}) == 1
    assert len(set(grp.values())) == 1 + 2000 + 1 + 1 + 1
    got = [(x.id, x.split_to) for x in S.stratified_group_split(df, groups, ["language", "source_dataset", "label"], RATIOS).collect()]
    split = dict(got)
    assert len(got) == len(split) == len(rows)
    assert len({(grp[i], s) for i, s in split.items()}) == len(set(grp.values()))
    for language in ("en", "pt"):
        for label in (0, 1):
            ids = [x[0] for x in rows if x[3] == language and x[2] == label and x[4] == "a"]
            for name, ratio in RATIOS:
                assert abs(sum(split[i] == name for i in ids) / len(ids) - ratio) < 0.02
