"""Problem 8: filling containers of fixed capacity (best-two-fit).

A container is filled greedily with the largest item that fits.  Then its smallest item is taken out on trial
and two unpacked items are sought that fit the widened gap more tightly; if there are any, they replace it.
An item larger than a container is divided: into full containers and a rest, which is packed like any item.

Items are packed in blocks of about BLOCK items, formed by the hash of their id.  Every block has the size
distribution of the whole, and only its last container is left partly empty for want of items, so blocks
cost next to nothing: less than one container in BLOCK items.

Items of no tokens (null and empty texts) take no room; they are put into the first container of their block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.durable import keep

#: Items packed together in one task.
BLOCK = 20_000


class _Unpacked:
    """Counts of unpacked items by size, and the largest unpacked size up to any bound."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.count = np.bincount(sizes, minlength=capacity + 1)
        self.count[0] = 0
        self.left = int(self.count.sum())
        self._renew()

    def _renew(self) -> None:
        there = self.count > 0
        self.present = np.flatnonzero(there)
        self.floor = np.maximum.accumulate(np.where(there, np.arange(len(there)), 0))

    def take(self, size: int) -> None:
        self.count[size] -= 1
        self.left -= 1
        if not self.count[size]:
            self._renew()

    def put(self, size: int) -> None:
        self.count[size] += 1
        self.left += 1
        if self.count[size] == 1:
            self._renew()

    def best_two(self, gap: int) -> tuple[int, int] | None:
        """The two unpacked items with the largest sum up to gap."""
        a = self.present[: np.searchsorted(self.present, gap)]
        if not len(a):
            return None
        b = self.floor[gap - a]
        # the same size twice takes two items of it
        alone = (b == a) & (self.count[a] < 2)
        if alone.any():
            b = np.where(alone, self.floor[np.maximum(np.minimum(a - 1, gap - a), 0)], b)
        total = np.where(b > 0, a + b, 0)
        k = int(total.argmax())
        return (int(a[k]), int(b[k])) if total[k] else None


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Containers as lists of item sizes; sizes are 1 to capacity."""
    items = _Unpacked(sizes, capacity)
    out = []
    while items.left:
        gap, inside = capacity, []
        while gap and (size := int(items.floor[gap])):
            items.take(size)
            inside.append(size)
            gap -= size
        if gap and items.left:
            least = inside[-1]
            two = items.best_two(gap + least)
            if two and sum(two) > least:
                items.take(two[0])
                items.take(two[1])
                items.put(least)
                inside[-1:] = two
        out.append(inside)
    return out


def pack_block(ids: list, sizes: np.ndarray, capacity: int) -> pd.DataFrame:
    """(container, id, piece, tokens) of the items of one block, containers numbered from 0."""
    full, rest = np.divmod(sizes, capacity)
    full = np.where((rest == 0) & (full > 0), full - 1, full)
    rest = sizes - full * capacity
    rows_c, rows_i, rows_p, rows_t = [], [], [], []
    n = 0
    for k in np.flatnonzero(full):
        for piece in range(int(full[k])):
            rows_c.append(n)
            rows_i.append(k)
            rows_p.append(piece)
            rows_t.append(capacity)
            n += 1
    waiting: dict[int, list[int]] = {}
    for k in np.flatnonzero(rest)[::-1]:
        waiting.setdefault(int(rest[k]), []).append(int(k))
    for inside in pack(rest[rest > 0], capacity):
        for size in inside:
            k = waiting[size].pop()
            rows_c.append(n)
            rows_i.append(k)
            rows_p.append(int(full[k]))
            rows_t.append(size)
        n += 1
    for k in np.flatnonzero(sizes == 0):
        rows_c.append(0)
        rows_i.append(k)
        rows_p.append(0)
        rows_t.append(0)
    return pd.DataFrame({"container": np.array(rows_c, np.int64), "id": [ids[k] for k in rows_i], "piece": np.array(rows_p, np.int32), "tokens": np.array(rows_t, np.int64)})


def packing(sized: DataFrame, budgets: DataFrame, block: int = BLOCK) -> DataFrame:
    """(budget_id, container, id, piece, tokens): every item of `sized` in containers of each budget's capacity.

    sized: id, n (null counts as 0).  budgets: budget_id, max_tokens; rows without a positive capacity are left out.
    container is unique within a budget.  Items larger than the capacity have several pieces, numbered from 0.
    """
    kind = sized.schema["id"].dataType.simpleString()
    sized = keep(sized.select("id", F.coalesce("n", F.lit(0)).alias("n")), "sizes")
    blocks = max(1, round(sized.count() / block))
    where = F.pmod(F.xxhash64("id"), F.lit(blocks))
    caps = [(r["budget_id"], r["max_tokens"]) for r in budgets.select("budget_id", "max_tokens").where("max_tokens > 0").limit(1000).collect()]
    if not caps:
        return sized.sparkSession.createDataFrame([], f"budget_id int, container bigint, id {kind}, piece int, tokens bigint")
    each = F.explode(F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("cap")) for b, c in caps])).alias("to")
    rows = sized.select("id", "n", where.alias("block"), each).select("id", "n", "block", "to.budget_id", "to.cap")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n", "id"], kind="stable")
        out = pack_block(pdf["id"].tolist(), pdf["n"].to_numpy(np.int64), int(pdf["cap"].iloc[0]))
        out["container"] += int(pdf["block"].iloc[0]) << 32
        out.insert(0, "budget_id", pdf["budget_id"].iloc[0])
        return out[["budget_id", "container", "id", "piece", "tokens"]]

    # One group is one block for one budget: BLOCK items, whatever the size of the corpus.
    return rows.groupBy("budget_id", "block").applyInPandas(one, f"budget_id int, container bigint, id {kind}, piece int, tokens bigint")


def fill(packed: DataFrame, budgets: DataFrame) -> DataFrame:
    """(budget_id, max_tokens, containers, tokens, fill): how full the containers of each budget are."""
    per = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("t"))
    per = per.groupBy("budget_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("t").alias("tokens"))
    caps = budgets.select("budget_id", "max_tokens")
    return caps.join(per, "budget_id").select("budget_id", "max_tokens", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("max_tokens"))).alias("fill"))
