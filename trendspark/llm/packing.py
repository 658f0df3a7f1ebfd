"""Filling containers of fixed capacity with whole texts.

A text longer than the container is cut into full pieces and a rest; every other text stays whole. Items above a third
of the capacity are large: of these two at most share a container, and a greedy matching pairs each, from the largest
down, with the largest that still fits beside it. Smaller items, from the largest down, go to the tightest gap that
takes them, and open containers of their own when no gap does.

Sizes are whole tokens, so all that matters is how many items have each size. The packing is made from that histogram,
which has at most as many rows as the capacity has tokens, however many texts there are: containers of equal content
are handled as one group, and the plan says which ranks of a size go to which run of containers. Ranks are given by a
distributed count: no size, however frequent, is brought into one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import checkpointed
from . import tokens

#: Items of one size that are ranked in one task.
PART_ITEMS = 100_000


class _Gaps:
    """Groups of containers ``(first, how many)`` by their free space."""

    def __init__(self) -> None:
        self.groups: dict[int, list[tuple[int, int]]] = {}
        self.sizes: list[int] = []

    def add(self, gap: int, first: int, n: int) -> None:
        if gap not in self.groups:
            self.groups[gap] = []
            insort(self.sizes, gap)
        self.groups[gap].append((first, n))

    def tightest(self, size: int) -> int | None:
        k = bisect_left(self.sizes, size)
        return self.sizes[k] if k < len(self.sizes) else None

    def take(self, gap: int, most: int) -> tuple[int, int]:
        """At most ``most`` containers of that gap."""
        first, n = self.groups[gap].pop()
        if n > most:
            self.groups[gap].append((first + most, n - most))
        if not self.groups[gap]:
            del self.groups[gap]
            self.sizes.remove(gap)
        return first, min(n, most)


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """``(size, first rank, first container, how many)`` runs, and the number of containers. In a run, rank and container
    go up together. ``histogram``: items of each size from 1 to ``capacity``."""
    left = {s: n for s, n in histogram.items() if n > 0}
    rank = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int]] = []
    gaps, made = _Gaps(), 0

    def put(size: int, first: int, n: int) -> None:
        runs.append((size, rank[size], first, n))
        rank[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        k = bisect_left(large, capacity - a + 1) - 1  # the largest that fits beside it
        while k >= 0 and not (left[large[k]] - (large[k] == a) > 0):
            k -= 1
        if k < 0:
            n = left[a]
            put(a, made, n)
            gaps.add(capacity - a, made, n)
        else:
            b = large[k]
            n = left[a] // 2 if a == b else min(left[a], left[b])
            put(a, made, n)
            put(b, made, n)
            gaps.add(capacity - a - b, made, n)
        made += n
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[s]:
            gap = gaps.tightest(s)
            if gap is None:
                per = capacity // s
                n = -(-left[s] // per)
                full = left[s] // per
                for _ in range(per):
                    if full:
                        put(s, made, full)
                if full:
                    gaps.add(capacity - per * s, made, full)
                if n > full:
                    rest = left[s]
                    for _ in range(rest):
                        put(s, made + full, 1)
                    gaps.add(capacity - rest * s, made + full, 1)
                made += n
            else:
                first, n = gaps.take(gap, left[s])
                put(s, first, n)
                gaps.add(gap - s, first, n)
    return runs, made


def _ranked(items: DataFrame, keys: list[str], order: str, parts: int) -> DataFrame:
    """``items`` and ``_rank`` from 0 within ``keys``: counts per part of a key come first, ranks inside a part after."""
    items = items.withColumn("_part", F.pmod(F.xxhash64(order), F.lit(parts)))
    by = W.partitionBy(*keys).orderBy("_part")
    before = items.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = before.select(*keys, "_part", (F.sum("_n").over(by) - F.col("_n")).alias("_before"))
    inner = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(order)) - 1
    return items.withColumn("_in", inner).join(before, [*keys, "_part"]).withColumn("_rank", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def pack(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """``(pack_name, capacity, <id>, piece, first_token, n_tokens, container)``: one row per container size and text, or per piece
    of a text longer than the container.

    ``limits``: ``(pack_name, capacity_tokens)``, a handful of rows; rows with a null or a capacity below 1 are left
    out, repeated ones count once. A text without tokens (null, empty) needs no container: its ``container`` is null.
    Repeated rows are texts of their own. Other columns are left out, whatever their names.
    """
    sized = tokens.with_token_counts(documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_x")), "_x", tokenizer).select("_id", "n_tokens")
    sized = checkpointed(sized)  # counted once, for the histogram and for the assignment
    parts = max(16, sized.count() // PART_ITEMS)
    packs = [(r[0], int(r[1])) for r in limits.select("pack_name", "capacity_tokens").where("pack_name is not null and capacity_tokens > 0").distinct().collect()]
    spark = documents.sparkSession
    schema = f"pack_name string, capacity int, {id_col} {sized.schema['_id'].dataType.simpleString()}, piece int, first_token bigint, n_tokens bigint, container bigint"
    if not packs:
        return spark.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_name"), F.lit(c).alias("capacity")) for p, c in sorted(packs)]))
    whole = sized.select("*", each.alias("_p")).select("_id", "n_tokens", "_p.*")
    # a rest, or a whole text, is an item to be packed; full pieces have containers of their own
    items = whole.select("pack_name", "capacity", "_id", (F.col("n_tokens") % F.col("capacity")).alias("size"), F.floor(F.col("n_tokens") / F.col("capacity")).alias("full"))
    counts = items.groupBy("pack_name", "capacity", "size").agg(F.count("*").alias("n"), F.sum("full").alias("full")).collect()  # at most the sum of the capacities
    runs: dict[tuple[str, int], tuple[np.ndarray, ...]] = {}
    first_full: dict[str, int] = {}
    for p, c in packs:
        made_runs, made = plan({r["size"]: r["n"] for r in counts if r["pack_name"] == p and r["capacity"] == c and r["size"]}, c)
        first_full[p, c] = made
        made_runs.sort()
        a = np.array(made_runs, dtype=np.int64).reshape(-1, 4)
        for s in np.unique(a[:, 0]):
            of = a[a[:, 0] == s]
            runs[p, c, int(s)] = (of[:, 1], of[:, 2])

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.empty(len(b), dtype=np.int64)
            for (p, c, s), at in b.groupby(["pack_name", "capacity", "size"]).indices.items():
                ranks, bins = runs[p, int(c), int(s)]
                r = b["_rank"].to_numpy()[at]
                k = np.searchsorted(ranks, r, side="right") - 1
                out[at] = bins[k] + r - ranks[k]
            yield b.assign(container=out)[["pack_name", "capacity", "_id", "size", "full", "container"]]

    id_type = sized.schema["_id"].dataType.simpleString()
    ranked = _ranked(items.where("size > 0"), ["pack_name", "capacity", "size"], "_id", parts)
    rests = ranked.mapInPandas(assign, f"pack_name string, capacity int, _id {id_type}, size bigint, full bigint, container bigint").select(
        "pack_name", "capacity", "_id", F.col("full").cast("int").alias("piece"), (F.col("full") * F.col("capacity")).alias("first_token"), F.col("size").alias("n_tokens"), "container"
    )
    # full pieces: container numbers behind the planned ones, by the same distributed ranking over the number of pieces
    big = items.where("full > 0").withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(parts)))
    offsets = big.groupBy("pack_name", "capacity", "_part").agg(F.sum("full").alias("_n"))
    offsets = offsets.select("pack_name", "capacity", "_part", (F.sum("_n").over(W.partitionBy("pack_name", "capacity").orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = W.partitionBy("pack_name", "capacity", "_part").orderBy("_id", "full").rowsBetween(W.unboundedPreceding, -1)
    base = F.coalesce(*[F.when((F.col("pack_name") == p) & (F.col("capacity") == c), F.lit(n)) for (p, c), n in first_full.items()])
    fulls = (
        big.withColumn("_in", F.coalesce(F.sum("full").over(inside), F.lit(0)))
        .join(offsets, ["pack_name", "capacity", "_part"])
        .select("pack_name", "capacity", "_id", (base + F.col("_before") + F.col("_in")).alias("_first"), F.explode(F.sequence(F.lit(0), (F.col("full") - 1).cast("int"))).alias("piece"))
        .select("pack_name", "capacity", "_id", "piece", (F.col("piece").cast("bigint") * F.col("capacity")).alias("first_token"), F.col("capacity").cast("bigint").alias("n_tokens"), (F.col("_first") + F.col("piece")).alias("container"))
    )
    empty = items.where("size = 0 and full = 0").select(
        "pack_name", "capacity", "_id", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("first_token"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("bigint").alias("container")
    )
    return rests.unionByName(fulls).unionByName(empty).withColumnRenamed("_id", id_col)


def packing_checks(documents: DataFrame, packed: DataFrame, limits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per container size ``(pack_name, capacity, texts, lost, overfull, torn, split)``: texts with a row, and of what must not be the
    number: texts without one, containers beyond capacity, texts whose pieces do not lie end to end, texts split though
    they fit."""
    pieces = W.partitionBy("pack_name", "capacity", id_col).orderBy("first_token")
    rows = packed.withColumn("_gap", (F.col("first_token") != F.coalesce(F.lag(F.col("first_token") + F.col("n_tokens")).over(pieces), F.lit(0))).cast("int"))
    texts = rows.groupBy("pack_name", "capacity", id_col).agg(F.max("_gap").alias("gap"), F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    of = texts.groupBy("pack_name", "capacity").agg(
        F.count("*").alias("texts"), F.sum("gap").cast("bigint").alias("torn"), F.count_if(F.col("n") != F.greatest(F.lit(1), F.ceil(F.col("t") / F.col("capacity")))).alias("split")
    )
    full = packed.where("container is not null").groupBy("pack_name", "capacity", "container").agg(F.sum("n_tokens").alias("t")).groupBy("pack_name", "capacity").agg(F.count_if(F.col("t") > F.col("capacity")).alias("overfull"))
    packs = limits.select("pack_name", F.col("capacity_tokens").cast("int").alias("capacity")).where("pack_name is not null and capacity > 0").distinct()
    wanted = documents.select(F.col(id_col)).distinct().select("*", F.explode(F.array(*[F.struct(F.lit(r[0]).alias("pack_name"), F.lit(r[1]).alias("capacity")) for r in packs.collect()])).alias("_p")).select(id_col, "_p.*")
    lost = wanted.join(texts.select("pack_name", "capacity", id_col), ["pack_name", "capacity", id_col], "left_anti").groupBy("pack_name", "capacity").agg(F.count("*").alias("lost"))
    rows = packs
    for part in (of, full, lost):
        rows = rows.join(part, ["pack_name", "capacity"], "left")
    return rows.select("pack_name", "capacity", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("texts", "lost", "overfull", "torn", "split")])


def fill_report(packed: DataFrame) -> DataFrame:
    """Per container size: containers used, the least that could do, and the share of their space that is filled."""
    return (
        packed.where("container is not null")
        .groupBy("pack_name", "capacity", "container")
        .agg(F.sum("n_tokens").alias("used"))
        .groupBy("pack_name", "capacity")
        .agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
        .select("pack_name", "capacity", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("bound"), "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("filled"))
    )
