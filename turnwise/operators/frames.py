"""Algebra of batches as DataFrames: selection, slices, order, concatenation, folding and iteration over numbered rows.

Rows are numbered by `pos` from 0 (see `batches.numbered`); nothing here collects rows on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnwise.operators.sampling import uniform

# ---- columns -----------------------------------------------------------------------------------------------------


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns; an unknown one is an error."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.select(*names)


def pop_columns(df: DataFrame, *names: str, key: str = "pos") -> tuple[DataFrame, DataFrame]:
    """The named columns with the key, and the rest of the batch."""
    return select_columns(df, key, *(n for n in names if n != key)), df.drop(*(n for n in names if n != key))


def rename_columns(df: DataFrame, old: Iterable[str], new: Iterable[str]) -> DataFrame:
    """Columns by new names, one for each old one; two columns of one name are an error."""
    old, new = list(old), list(new)
    if len(old) != len(new):
        raise ValueError("as many new names as old ones")
    out = [dict(zip(old, new)).get(c, c) for c in df.columns]
    if len(set(out)) < len(out):
        raise ValueError("two columns of one name")
    return df.toDF(*out)


def common_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    return [c for c in df.columns if c in set(names)]


def split_for_generation(df: DataFrame, kept: Iterable[str] = ("data_source", "reward_model", "extra_info", "uid"), key: str = "uid") -> tuple[DataFrame, DataFrame]:
    """What generation takes along (all but the kept columns, and the key), and what stays behind."""
    stay = common_columns(df, kept)
    return df.select(key, *[c for c in df.columns if c not in stay]), df.select(key, *[c for c in stay if c != key])


def flattened(df: DataFrame, separator: str = "/") -> DataFrame:
    """Struct columns as one column for each leaf, named by its path."""

    def leaves(kind: T.StructType, path: tuple[str, ...]) -> Iterator[Column]:
        for f in kind.fields:
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, (*path, f.name))
            else:
                yield F.col(".".join(f"`{p}`" for p in (*path, f.name))).alias(separator.join((*path, f.name)))

    return df.select(*leaves(df.schema, ()))


def described(df: DataFrame) -> list[tuple[str, str]]:
    """Name and type of each column."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema.fields]


def planned_bytes(df: DataFrame) -> int:
    """The planner's estimate of the batch's size; no job is run."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


# ---- rows --------------------------------------------------------------------------------------------------------


def rows_at(df: DataFrame, places: Iterable[int], pos: str = "pos") -> DataFrame:
    """The rows at the places (a bounded list, negative ones counted from the end not allowed)."""
    return df.where(F.col(pos).isin(*places))


def rows_where(df: DataFrame, mask: DataFrame, pos: str = "pos", flag: str = "keep") -> DataFrame:
    """The rows whose place a mask table (pos, keep) marks."""
    return df.join(mask.where(F.col(flag)).select(pos).hint("merge"), pos, "left_semi")


def sliced(df: DataFrame, start: int | None = None, end: int | None = None, step: int = 1, pos: str = "pos") -> DataFrame:
    """Rows start, start + step, ... before end; open ends take all."""
    if step < 1 or (start or 0) < 0 or (end is not None and end < 0):
        raise ValueError("slices go forward from the first row")
    out = df.where(F.col(pos) >= (start or 0))
    out = out if end is None else out.where(F.col(pos) < end)
    return out.where((F.col(pos) - (start or 0)) % step == 0) if step > 1 else out


def reordered(df: DataFrame, order: DataFrame, pos: str = "pos", place: str = "place") -> DataFrame:
    """Rows renumbered by a permutation table (pos, place): the row at `pos` moves to `place`."""
    return df.join(order.select(pos, place).hint("merge"), pos).drop(pos).withColumnRenamed(place, pos)


def inverse(order: DataFrame, pos: str = "pos", place: str = "place") -> DataFrame:
    """The permutation that undoes another."""
    return order.select(F.col(place).alias(pos), F.col(pos).alias(place))


def beside(left: DataFrame, right: DataFrame, pos: str = "pos") -> DataFrame:
    """Two numbered batches row by row; clashing names of the right side get a suffix."""
    names = [f"{c}_right" if c in left.columns and c != pos else c for c in right.columns]
    return left.join(right.toDF(*names).hint("merge"), pos)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two batches hold the same rows, repeats counted; null and NaN equal themselves."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


# ---- several batches ---------------------------------------------------------------------------------------------


def concatenated(*parts: DataFrame, meta: Iterable[Mapping[str, object]] = ()) -> tuple[DataFrame, dict[str, object]]:
    """Batches one below the other, numbered by `part`, and their meta data: equal values are kept, lists of metrics are joined, anything else that differs is an error."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.withColumn("part", F.lit(k)) for k, p in enumerate(parts)])
    joined: dict[str, object] = {}
    for m in meta:
        for k, v in m.items():
            if k == "metrics":
                joined[k] = [*joined.get(k, []), *(v if isinstance(v, list) else [v])]
            elif joined.setdefault(k, v) != v:
                raise ValueError(f"{k} differs")
    return rows, joined


def appended(df: DataFrame, new: DataFrame, fits: Column | None = None) -> DataFrame:
    """A data set and the new rows that fit."""
    return df.unionByName(new if fits is None else new.where(fits), allowMissingColumns=True)


def merged_metrics(*steps: DataFrame, prefix: str = "") -> DataFrame:
    """name, values: metric rows (name, value, step) of several steps as lists in order of the steps."""
    rows = reduce(DataFrame.unionByName, steps)
    lists = rows.groupBy(F.concat(F.lit(prefix), "name").alias("name")).agg(F.array_sort(F.collect_list(F.struct("step", "value"))).alias("x"))
    return lists.select("name", F.transform("x", lambda x: x["value"]).alias("values"))


def columnar(df: DataFrame, *columns: str, pos: str = "pos", group: str | None = None) -> DataFrame:
    """Rows as one row of arrays in order, for each group (one bounded batch)."""
    packed = F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("x")
    rows = df.groupBy(*([group] if group else [])).agg(packed)
    return rows.select(*([group] if group else []), *[F.col(f"x.{c}").alias(c) for c in columns])


def padded_with(df: DataFrame, times: int, which: str = "first", pos: str = "pos") -> DataFrame:
    """The batch and the first or last row again, so many times over, numbered on."""
    n = df.count()
    edge = df.where(F.col(pos) == (0 if which == "first" else n - 1))
    more = edge.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))) if times else edge.limit(0).withColumn("_k", F.lit(0))
    return df.unionByName(more.withColumn(pos, (F.lit(n) + F.col("_k")).cast(df.schema[pos].dataType)).drop("_k"))


# ---- folding -----------------------------------------------------------------------------------------------------


def unfolded_chunks(df: DataFrame, parts: int, *columns: str, pos: str = "pos") -> DataFrame:
    """Each row as `parts` rows: the named array columns cut into equal chunks, all others repeated. New places count through."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_k"))
    for c in columns:
        size = F.size(c) / parts
        rows = rows.withColumn(c, F.slice(c, (F.col("_k") * size + 1).cast("int"), size.cast("int")))
    return rows.withColumn(pos, F.col(pos) * parts + F.col("_k")).drop("_k")


def folded(df: DataFrame, size: int, *columns: str, pos: str = "pos") -> DataFrame:
    """Every `size` rows as one: arrays of their values in order. New places count the rows that came out."""
    return columnar(df.withColumn("_f", F.floor(F.col(pos) / size)).select(pos, "_f", *columns), *columns, pos=pos, group="_f").withColumnRenamed("_f", pos)


def unfolded(df: DataFrame, *columns: str, pos: str = "pos") -> DataFrame:
    """The inverse of `folded` for arrays of one length."""
    rows = df.select(pos, F.posexplode(F.arrays_zip(*columns)).alias("_k", "x"), F.size(columns[0]).alias("_n"))
    return rows.select((F.col(pos) * F.col("_n") + F.col("_k")).alias(pos), *[F.col(f"x.{c}").alias(c) for c in columns])


# ---- iteration ---------------------------------------------------------------------------------------------------


def mini_batches(df: DataFrame, size: int, epochs: int = 1, seed: int | None = None, key: str = "pos", drop_last: bool = False) -> DataFrame:
    """epoch, batch and the rows: each epoch goes once through all rows, in order of their number or (seeded) of a draw of its own.

    Rows must be numbered; a seeded order ranks draws within ranges, see `batches.numbered`."""
    from turnwise.operators.batches import numbered

    parts = []
    n = df.count() if drop_last else 0
    for e in range(epochs):
        if seed is None:
            rows = df.withColumn("_place", F.col(key))
        else:
            drawn = df.withColumn("_draw", F.struct(uniform(F.lit(seed), F.lit(e), key).alias("u"), F.col(key).alias("k")))
            rows = numbered(drawn, "_draw", "_place").drop("_draw")
        rows = rows.select(F.lit(e).alias("epoch"), F.floor(F.col("_place") / size).alias("batch"), *df.columns)
        parts.append(rows.where(F.col("batch") < n // size) if drop_last else rows)
    return reduce(DataFrame.unionByName, parts)


def split_rows(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """`df` with chunk: parts of `size` rows, the last may be smaller."""
    return df.withColumn("chunk", F.floor(F.col(pos) / size))


def chunked(df: DataFrame, parts: int, pos: str = "pos") -> DataFrame:
    """`df` with chunk: `parts` parts of equal size; other numbers of rows are an error."""
    n = df.count()
    if n % parts:
        raise ValueError(f"{n} rows are no multiple of {parts}")
    return df.withColumn("chunk", F.floor(F.col(pos) / max(1, n // parts)))


def ordered_for(df: DataFrame, kind: str = "sequential", seed: int = 0, key: str = "pos", weight: str | None = None) -> DataFrame:
    """`df` with order: by number, by seeded draw, or (curriculum) by an own weight, then number."""
    if kind == "sequential":
        return df.withColumn("order", F.col(key).cast("double"))
    if kind == "random":
        return df.withColumn("order", uniform(F.lit(seed), key))
    if kind == "curriculum" and weight:
        return df.withColumn("order", F.col(weight).cast("double"))
    raise ValueError(f"no sampler {kind}")
