"""Sample that matches target category proportions, by top-down allocation over a category tree.

Category counts (at most one row for each target) go to the driver; rows never do. What a category cannot
fill goes first to its siblings, then to its cousins, in proportion to their targets. The draw at a leaf takes
the lowest ranks of a seeded permutation. Ranks are dense and global but come from two levels, the rank inside
a slice of the permutation plus the number of rows in earlier slices, so a category with a third of all rows is
ranked by many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Parent of each category in the default tree; a category that is not named is its own branch.
TREE = {
    "weather": "outdoors", "gardening": "outdoors", "astronomy": "outdoors", "travel": "errands", "shopping": "errands", "food delivery": "errands", "logistics": "errands",
    "finance": "paperwork", "insurance": "paperwork", "legal advice": "paperwork", "calendar": "paperwork", "health": "personal", "home control": "personal", "music": "personal", "language learning": "personal",
}
SLICES = 1024


def plain_tag(tag: Column) -> Column:
    """Letter case, outer blanks and blank, _ or - between words make no other tag; blank tags are null."""
    t = F.trim(F.regexp_replace(F.lower(tag), r"[\s\p{Z}_-]+", " "))
    return F.when(t != "", t)


def first_tag(tags: Column) -> Column:
    return F.get(F.filter(F.transform(tags, plain_tag), lambda t: t.isNotNull()), F.lit(0))


def allocate(quota: Mapping[str, int], available: Mapping[str, int], tree: Mapping[str, str] = TREE) -> dict[str, int]:
    """Rows to take of each category: its quota as far as it goes, then unmet quota of siblings, then of cousins.

    Within a branch, and then between branches, what is unmet is shared in proportion to the receivers' quotas,
    rounded down, and the rest goes one by one to the receivers with the largest quota that still have rows."""
    take = {c: min(q, available.get(c, 0)) for c, q in quota.items()}

    def pass_on(unmet: int, to: list[str]) -> int:
        while unmet > 0 and (open_ := [c for c in to if available.get(c, 0) > take[c]]):
            weight = sum(quota[c] for c in open_) or len(open_)
            given = 0
            for c in sorted(open_, key=lambda c: (-quota[c], c)):
                more = min(available[c] - take[c], max(unmet * (quota[c] or 1) // weight, 0), unmet - given)
                take[c] += more
                given += more
            if not given:
                for c in sorted(open_, key=lambda c: (-quota[c], c))[:unmet]:
                    take[c] += 1
                    given += 1
            unmet -= given
        return unmet

    branches: dict[str, list[str]] = {}
    for c in sorted(quota):
        branches.setdefault(tree.get(c, c), []).append(c)
    left = sum(pass_on(sum(quota[c] - min(quota[c], available.get(c, 0)) for c in cs), cs) for cs in branches.values())
    pass_on(left, sorted(quota))
    return take


def within(quota: Mapping[str, int], least: Mapping[str, int], n: int) -> dict[str, int]:
    """Quotas that were rounded up, brought down to a sample of n rows: one row less where most was rounded up, never below what is wanted at least."""
    out = dict(quota)
    while (extra := sum(out.values()) - n) > 0 and (open_ := sorted((c for c in out if out[c] > least[c]), key=lambda c: (least[c] - out[c], c))):
        for c in open_[:extra]:
            out[c] -= 1
    return out


def _tagged(records: DataFrame, key: str, tags: str) -> DataFrame:
    return records.select(F.col(key).alias("key"), first_tag(F.col(tags)).alias("plain"))


def report(records: DataFrame, targets: DataFrame, key: str = "record_id", tags: str = "tag", share: int = 5, tree: Mapping[str, str] = TREE) -> DataFrame:
    """tag, plain, target_rows, available, taken, short: the allocation of a sample of one `share`th of all rows.

    Quotas are the targets; where rounding up makes them exceed the sample, they are brought down again, not below
    min_rows and the exact share rounded down.

    target_rows is the larger of min_rows and target_permille of the sample, rounded up. short is how far a tag
    falls below its own target; taken also holds what it took over. Targets with a null or blank tag, or without
    target_permille and min_rows, are left out; spellings of one tag in the targets count as one (largest target)."""
    spark = records.sparkSession
    total = records.count()
    n = total // share
    have = targets.select("tag", plain_tag(F.col("tag")).alias("plain"), "target_permille", "min_rows").where("plain IS NOT NULL")
    counts = _tagged(records, key, tags).join(have.select("plain").distinct(), "plain", "left_semi").groupBy("plain").agg(F.count("*").alias("available"))
    rows = have.join(counts, "plain", "left").groupBy("plain").agg(
        F.min("tag").alias("tag"), F.max(F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.expr(f"(coalesce(target_permille, 0) * {n}L + 999) div 1000"))).alias("target_rows"), F.max(F.coalesce("available", F.lit(0))).alias("available"),
        F.max(F.greatest(F.coalesce("min_rows", F.lit(0)).cast("long"), F.expr(f"(coalesce(target_permille, 0) * {n}L) div 1000"))).alias("least"),
    ).collect()  # fmt: skip  # one row a target
    quota = within({r["plain"]: r["target_rows"] for r in rows}, {r["plain"]: r["least"] for r in rows}, n)
    take = allocate(quota, {r["plain"]: r["available"] for r in rows}, tree)
    out = [(r["tag"], r["plain"], r["target_rows"], r["available"], take[r["plain"]], max(0, r["target_rows"] - r["available"])) for r in rows]
    return spark.createDataFrame(out, "tag string, plain string, target_rows long, available long, taken long, short long")


def sample(records: DataFrame, targets: DataFrame, key: str = "record_id", tags: str = "tag", share: int = 5, seed: int = 17, tree: Mapping[str, str] = TREE) -> DataFrame:
    """record key, tag and rank of the drawn rows. Rows without a usable tag, or whose first tag has no target, are never drawn.

    Rows that repeat a key count and rank as separate rows. The draw depends on the keys and the seed only."""
    plan = report(records, targets, key, tags, share, tree)
    mix = _tagged(records, key, tags).where("plain IS NOT NULL").withColumn("mix", F.xxhash64(F.lit(seed), "key")).withColumn("slice", F.shiftrightunsigned("mix", 54))
    sizes = mix.groupBy("plain", "slice").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(W.partitionBy("plain").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("size")
    last = plan.select("plain", F.col("tag").alias("tag"), "taken")
    # whole slices beyond the allocation are dropped before anything is sorted
    wanted = before.join(last, "plain").where("before < taken")
    ranked = mix.join(wanted, ["plain", "slice"]).withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("plain", "slice").orderBy("mix", "key")))
    return ranked.where("rank <= taken").select(F.col("key").alias(key), "tag", "rank")


def found(records: DataFrame, targets: DataFrame, key: str = "record_id", tags: str = "tag") -> DataFrame:
    """tag: the targets that cannot be met."""
    return report(records, targets, key, tags).where("short > 0").select("tag")
