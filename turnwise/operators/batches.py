"""Batch algebra: repeats, padding, chunks, unions and partitions of balanced length."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnwise.plans.lineage import cut

def numbered(df: DataFrame, order: str, into: str = "pos") -> DataFrame:
    """`df` with dense numbers from 0 in the order of a unique key.

    Ranges of the key alone are numbered by many tasks, and only the sizes of the ranges meet in one place. The
    ranges are stored before they are counted: two evaluations would draw different bounds."""
    spread = cut(df.select(F.col(order).alias("_key")).repartitionByRange("_key").select("_key", F.spark_partition_id().alias("_part")))
    before = spread.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    places = spread.withColumn("_row", F.row_number().over(W.partitionBy("_part").orderBy("_key"))).join(F.broadcast(before), "_part")  # one row a task
    places = places.select("_key", (F.col("_before") + F.col("_row") - 1).alias(into))
    return df.join(places.hint("merge"), F.col(order).eqNullSafe(F.col("_key"))).drop("_key")


def repeat(df: DataFrame, times: int | Column) -> DataFrame:
    """Each row `times` over, with its copy number from 0; order by (row, copy) for interleaved, by (copy, row) for tiled."""
    n = F.lit(times) if isinstance(times, int) else times
    return df.select("*", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).alias("copy"))


def pad_to_divisor(df: DataFrame, divisor: int, pos: str = "pos") -> DataFrame:
    """The rows (numbered from 0) and, flagged `padded`, as many of the first rows again as make the number a multiple."""
    n = df.count()
    lacking = -n % divisor
    again = [df.where(F.col(pos) < min(lacking - k, n)).withColumn(pos, F.col(pos) + n + k) for k in range(0, lacking, max(n, 1))] if n else []
    out = df.withColumn("padded", F.lit(False))
    for part in again:
        out = out.unionByName(part.withColumn("padded", F.lit(True)))
    return out


def unpad(df: DataFrame) -> DataFrame:
    return df.where("NOT padded").drop("padded")


def chunks(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    return df.withColumn("chunk", F.floor(F.col(pos) / size).cast("int"))


def union_columns(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Two tables over the same rows side by side, and one row (rows, conflicts) for each shared column whose values differ."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    other = b.select(key, *[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in b.columns if c != key])
    both = a.join(other.hint("merge"), key)
    checks = both.agg(F.count("*").alias("rows"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"_{c}"))).alias(c) for c in shared])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("conflicts")) for c in shared]).cast("array<struct<column:string,conflicts:bigint>>")
    conflicts = checks.select("rows", F.explode(each).alias("x")).select("rows", "x.column", "x.conflicts")
    return both.drop(*[f"_{c}" for c in shared]), conflicts


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Indices of `lengths` in k parts of nearly equal sums, by largest differencing; with `equal`, parts of equal size (k divides the number)."""
    if equal and len(lengths) % k:
        raise ValueError("parts of equal size need a multiple of k rows")
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    count = itertools.count()
    heap: list[tuple[int, int, list[tuple[int, list[int]]]]] = []
    step = k if equal else 1
    for a in range(0, len(order), step):
        parts = [(lengths[i], [i]) for i in reversed(order[a : a + step])]
        parts += [(0, [])] * (k - len(parts))
        heapq.heappush(heap, (-(parts[0][0] - parts[-1][0]), next(count), parts))
    while len(heap) > 1:
        _, _, p = heapq.heappop(heap)
        _, _, q = heapq.heappop(heap)
        merged = sorted(((s + t, a + b) for (s, a), (t, b) in zip(p, reversed(q))), key=lambda x: -x[0])
        heapq.heappush(heap, (-(merged[0][0] - merged[-1][0]), next(count), merged))
    return [sorted(rows) for _, rows in heap[0][2]] if heap else [[] for _ in range(k)]


def checked_parts(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Balanced parts that hold every index once and none of which is empty; fewer rows than parts are an error."""
    if len(lengths) < k:
        raise ValueError(f"{len(lengths)} rows for {k} parts")
    parts = differencing(lengths, k, equal)
    if len(parts) != k or not all(parts) or sorted(i for p in parts for i in p) != list(range(len(lengths))):
        raise ValueError("parts don't cover the rows")
    return parts


def balanced(df: DataFrame, group: str, key: str, length: str, k: int) -> DataFrame:
    """group, key, length, part: each group's rows in k parts of nearly equal length. A group is one batch, of bounded size."""
    def split(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("key").reset_index(drop=True)
        part = pd.Series(0, index=b.index, dtype="int32")
        for p, rows in enumerate(differencing(b["length"].tolist(), k)):
            part.iloc[rows] = p
        return b.assign(part=part)

    named = df.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), F.col(length).cast("long").alias("length"))
    return named.groupBy("group").applyInPandas(split, "group string, key long, length long, part int")


def imbalance(parts: DataFrame) -> DataFrame:
    """group, low, high, gap of the parts' total lengths."""
    sums = parts.groupBy("group", "part").agg(F.sum("length").alias("s"))
    return sums.groupBy("group").agg(F.min("s").alias("low"), F.max("s").alias("high"), (F.max("s") - F.min("s")).alias("gap"))


def interleaved(items: list) -> list:
    """Items in descending order of load, with the small ones at both ends: every second one backwards, then the others."""
    return items[::2][::-1] + items[1::2]


def micro_batch_rows(lengths: list[int], budget: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Rows of each micro batch: as many batches as the budget asks for, of nearly equal workload, the small ones at both ends."""
    if max(lengths) > budget:
        raise ValueError("a row is longer than the budget")
    k = round_up(max(least, min(len(lengths), ceil_div(sum(lengths), budget))), multiple)
    if k > len(lengths):
        raise ValueError("more batches than rows")
    loads = [24576 * n + n * n for n in lengths]
    parts = sorted(differencing(loads, k), key=lambda rows: (sum(loads[i] for i in rows), rows[0]), reverse=True)
    return interleaved(parts)


def micro_batches(df: DataFrame, group: str, key: str, length: str, budget: int, least: int = 1, multiple: int = 1) -> DataFrame:
    """group, key, length, batch, place: each group's rows in micro batches of nearly equal workload, place being that within all of them.

    The number of batches is all tokens over the budget, rounded up, not above the number of rows, at least `least`,
    and rounded up to a multiple of `multiple`; a row longer than the budget is an error. A group is one mini batch,
    of bounded size. `restored` brings rows back into their order."""

    def split(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("key").reset_index(drop=True)
        parts = micro_batch_rows(b["length"].tolist(), budget, least, multiple)
        out = b.iloc[[i for rows in parts for i in rows]]
        return out.assign(batch=[k for k, rows in enumerate(parts) for _ in rows], place=range(len(out)))

    named = df.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), F.col(length).cast("long").alias("length"))
    return named.groupBy("group").applyInPandas(split, "group string, key long, length long, batch int, place int")


def restored(moved: DataFrame, rows: DataFrame, key: str = "key") -> DataFrame:
    """`moved` values (key, ...) beside the rows they came from, whatever order they were worked on in."""
    return rows.join(moved.hint("merge"), key)


def greedy(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Indices in k parts: each row in its order goes to the part with the smallest sum so far; with `equal`, parts of equal size."""
    if equal and len(lengths) % k:
        raise ValueError("parts of equal size need a multiple of k rows")
    extra = sum(lengths) + 1 if equal else 0
    heap = [(0, p) for p in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        load, p = heapq.heappop(heap)
        out[p].append(i)
        heapq.heappush(heap, (load + n + extra, p))
    return out


def balanced_ranks(df: DataFrame, group: str, key: str, length: str, ranks: int) -> DataFrame:
    """group, key, length, rank, place: each group's rows over ranks of equal size and nearly equal workload, within a rank small rows at both ends.

    A group is one batch, of bounded size, whose rows are a multiple of the ranks."""

    def split(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("key").reset_index(drop=True)
        loads = [24576 * n + n * n for n in b["length"].tolist()]
        parts = [sorted(rows, key=lambda i: (loads[i], i)) for rows in differencing(loads, ranks, equal=True)]
        order = [i for rows in parts for i in rows[::2] + rows[1::2][::-1]]
        return b.iloc[order].assign(rank=[r for r, rows in enumerate(parts) for _ in rows], place=range(len(b)))

    named = df.select(F.col(group).cast("string").alias("group"), F.col(key).alias("key"), F.col(length).cast("long").alias("length"))
    return named.groupBy("group").applyInPandas(split, "group string, key long, length long, rank int, place int")


def ceil_div(a: int, b: int) -> int:
    return -(a // -b)


def round_up(n: int, multiple: int) -> int:
    """The smallest multiple that is not below n."""
    return ceil_div(n, multiple) * multiple


def workload(length: Column) -> Column:
    """Relative cost of a sequence: linear layers and attention."""
    return F.lit(24576) * length.cast("long") + length.cast("long") * length.cast("long")


def pad_array(values: Column, to: int, fill: object, left: bool = False) -> Column:
    """An array brought to one length: padded, or cut at the far end."""
    lacking = F.greatest(F.lit(to) - F.size(values), F.lit(0))
    padding = F.array_repeat(F.lit(fill), lacking)
    cut = F.slice(values, F.greatest(F.size(values) - to + 1, F.lit(1)), F.lit(to)) if left else F.slice(values, 1, to)
    return F.concat(padding, cut) if left else F.concat(cut, padding)


def batches_of(rows: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """Fixed-size batches from a stream of frames; the last may be smaller."""
    kept: list[pd.DataFrame] = []
    n = 0
    for b in rows:
        kept.append(b)
        n += len(b)
        while n >= size:
            whole = pd.concat(kept, ignore_index=True)
            yield whole.iloc[:size]
            kept, n = [whole.iloc[size:]], n - size
    if n:
        yield pd.concat(kept, ignore_index=True)
