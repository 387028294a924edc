"""Exact ranks, order statistics and row numbers without one big window.

A window without a fine partitioning would pull a whole column into one task.
Here values are counted first (map-side combine collapses a hot value to one
row), and the counts are cut into ordered buckets: by WAYS approximate quantiles
of the values, then each part again by its own, as often as the number of counts
asks for. Only the bucket totals are cumulated globally; counts are ordered
inside their bucket. The cuts decide how work is spread, not the results.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dosewise.session import stage

#: Parts of one level of cuts, accuracy of their quantiles, and counts aimed at in a bucket.
WAYS, ACCURACY, PER_BUCKET = 256, 1000, 1_000_000


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows (by..., value, n) for the non-missing values."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def bucketed(counts: DataFrame, value: str, keys: Sequence[str], per_bucket: int = PER_BUCKET, ways: int = WAYS) -> tuple[DataFrame, list[str]]:
    """counts with order-preserving bucket numbers, and the names of these columns.

    A level is one small table: a row of cut points for each bucket so far, from
    sketches of ACCURACY entries, joined back. The number of levels follows from
    that of the counts, so a bucket stays within memory at any size.
    """
    names: list[str] = []
    left = counts.count()
    probs = [i / ways for i in range(1, ways)]
    while left > per_bucket:
        level = [*keys, *names]
        sketch = F.percentile_approx(value, probs, max(ACCURACY, ways)).alias("_cuts")
        name = f"_b{len(names)}"
        if level:
            cuts = stage(counts.groupBy(*level).agg(sketch))
            same = [counts[k].eqNullSafe(cuts[k]) for k in level]
            met = counts.join(cuts, _all(same))
            counts = met.select(*[counts[c] for c in counts.columns], _place(F.col("_cuts"), F.col(value), ways).alias(name))
        else:
            points = counts.agg(sketch).first()["_cuts"] or []
            counts = counts.withColumn(name, _place(F.lit(points), F.col(value), ways) if points else F.lit(0))
        names.append(name)
        left /= ways
    return counts, names


def _place(cuts: Column, value: Column, ways: int) -> Column:
    """How many of the sorted cuts, fewer than ways, are below the value: by halves, as a
    row would else be compared with each of them."""
    steps = F.lit([1 << i for i in reversed(range((ways - 1).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < value, step).otherwise(0))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def cumulate(counts: DataFrame, value: str, by: str | None = None, n: str = "n", per_bucket: int = PER_BUCKET, ways: int = WAYS) -> DataFrame:
    """Add ``n_below`` (rows with a smaller value) and ``n_total`` to value counts.

    The counts are written once, since cuts, totals and ranks all read them.
    """
    keys = [by] if by else []
    up_to_here = (Window.unboundedPreceding, -1)
    over_group = Window.partitionBy(*keys)
    cut, buckets = bucketed(stage(counts), value, keys, per_bucket, ways)
    if not buckets:
        below = F.sum(n).over(over_group.orderBy(value).rowsBetween(*up_to_here))
        return cut.withColumns(
            {"n_below": F.coalesce(below, F.lit(0)), "n_total": F.sum(n).over(over_group)}
        )
    totals = (
        cut.groupBy(*keys, *buckets)
        .agg(F.sum(n).alias("_bn"))
        .select(
            *keys,
            *buckets,
            F.coalesce(F.sum("_bn").over(over_group.orderBy(*buckets).rowsBetween(*up_to_here)), F.lit(0)).alias("_offset"),
            F.sum("_bn").over(over_group).alias("n_total"),
        )
    )
    inside = Window.partitionBy(*keys, *buckets).orderBy(value).rowsBetween(*up_to_here)
    # the window has already placed the rows by the join keys, so only the totals move
    return (
        cut.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(totals, [*keys, *buckets])
        .withColumn("n_below", F.col("_offset") + F.col("_in"))
        .drop(*buckets, "_in", "_offset")
    )


def order_statistics(
    counts: DataFrame,
    value: str,
    percents: Sequence[int],
    by: str | None = None,
    prefix: str = "p",
    **cuts: int,
) -> DataFrame:
    """Exact percentiles, definition 5: average the two neighbours at integer n*p.

    One output row per group, columns ``<prefix><percent>``. The 50th percentile
    is the usual median. Ranks are integer arithmetic, so no rounding decides
    which observation is picked.
    """
    c = cumulate(counts, value, by, **cuts)
    last = F.col("n_below") + F.col("n")

    def holds(rank: Column) -> Column:
        return (F.col("n_below") < rank) & (rank <= last)

    aggs = []
    for p in percents:
        whole = F.floor(F.col("n_total") * p / 100)
        exact = (F.col("n_total") * p) % 100 == 0
        upper = F.when(F.lit(p == 100), F.col("n_total")).otherwise(whole + 1)
        lower = F.when(exact, F.greatest(whole, F.lit(1))).otherwise(whole + 1)
        v = F.col(value)
        aggs.append(
            ((F.max(F.when(holds(lower), v)) + F.max(F.when(holds(upper), v))) / 2).alias(f"{prefix}{p}")
        )
    return c.groupBy(*([by] if by else [])).agg(*aggs)


def average_ranks(counts: DataFrame, value: str, by: str | None = None, **cuts: int) -> DataFrame:
    """Average rank for ties, one row per (group, value)."""
    return cumulate(counts, value, by, **cuts).withColumn(
        "avg_rank", F.col("n_below") + (F.col("n") + 1) / 2
    )


def hash_row_number(df: DataFrame, by: Sequence[str], digest: str, tie: str, name: str = "rn") -> DataFrame:
    """Row number within ``by`` in (digest, tie) order, for a hexadecimal digest.

    The first five digits of a digest are uniform, so 2 ** 20 equal buckets carry
    the ordering and only their sizes (one row each per group) are cumulated. The
    join of the sizes reuses the placement of the rows by the window.
    """
    cut = df.withColumn("_b", F.substring(digest, 1, 5))
    w = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = (
        cut.groupBy(*by, "_b")
        .agg(F.count(F.lit(1)).alias("_bn"))
        .select(
            *by,
            "_b",
            F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_offset"),
            F.sum("_bn").over(whole).alias("n_group"),
        )
    )
    inside = Window.partitionBy(*by, "_b").orderBy(digest, tie)
    return (
        cut.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, [*by, "_b"])
        .withColumn(name, F.col("_offset") + F.col("_rn"))
        .drop("_b", "_rn", "_offset")
    )
