"""Ranks, correlations, classification measures and covariate screens.

Screens look at many columns in one pass: one wide aggregate yields a single
row, which is then turned into one row per column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.functions import known
from dosewise.functions.ranks import average_ranks, value_counts
from dosewise.operators.joins import attach_scalars
from dosewise.operators.sums import SCHEMA, batch_of, tree_sums
from dosewise.session import stage

# ---- wide aggregate to long result ----------------------------------------------


def per_column(rows: DataFrame, columns: Sequence[str], measures: dict, by: Sequence[str] = ()) -> DataFrame:
    """One row per (by..., column): ``measures`` maps a name to a function from
    a column name to an aggregate."""
    wide = rows.groupBy(*by).agg(
        *[f(c).alias(f"{m}__{i}") for i, c in enumerate(columns) for m, f in measures.items()]
    )
    structs = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{m}__{i}").alias(m) for m in measures])
        for i, c in enumerate(columns)
    ]
    return wide.select(*by, F.inline(F.array(*structs)))


# ---- ranks and ROC ----------------------------------------------------------------


def rank_average(rows: DataFrame, column: str) -> DataFrame:
    """Each distinct value with its frequency and average rank."""
    return average_ranks(value_counts(rows, column), column).select(column, "n", "avg_rank")


def auc_exact(rows: DataFrame, by: str | None = None, response: str = "response", score: str = "score") -> DataFrame:
    """Area under the ROC curve by the rank-sum formula, ties on average rank."""
    keys = [by] if by else []
    usable = rows.where(F.col(score).isNotNull() & F.col(response).isNotNull())
    counts = usable.groupBy(*keys, score).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(response) == 1).alias("n_pos")
    )
    return auc_of_counts(counts, by, score)


def auc_of_counts(counts: DataFrame, by: str | None = None, score: str = "score") -> DataFrame:
    """The same from rows and positives (n, n_pos) of each distinct score."""
    keys = [by] if by else []
    ranks = average_ranks(counts, score, by)
    # as doubles: the products of counts leave the range of long
    pos, total = F.sum("n_pos").cast("double"), F.sum("n").cast("double")
    rank_sum = F.sum(F.col("n_pos") * F.col("avg_rank"))
    auc = F.try_divide(rank_sum - pos * (pos + 1) / 2, pos * (total - pos))
    return ranks.groupBy(*keys).agg(F.sum("n_pos").alias("n_pos"), F.sum("n").alias("n"), auc.alias("auc"))


def perf_measures(
    rows: DataFrame, cutoff: float, by: Sequence[str] = (), response: str = "response", score: str = "score"
) -> DataFrame:
    """TP, FP, TN, FN, accuracy, PPV and recall at score > cutoff."""
    hit, pos = F.col(score) > cutoff, F.col(response) == 1
    counts = rows.groupBy(*by).agg(
        F.count_if(hit & pos).alias("tp"),
        F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"),
        F.count_if(~hit & pos).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return counts.withColumns(
        {
            "accuracy": F.try_divide(tp + tn, tp + fp + tn + fn),
            "ppv": F.try_divide(tp, tp + fp),
            "recall": F.try_divide(tp, tp + fn),
        }
    )


def confusion_matrix(rows: DataFrame, cutoff: float = 0.5, response: str = "response", score: str = "score") -> DataFrame:
    """2x2 table at score >= cutoff: predicted class by row, true class by column."""
    predicted = known(F.col(score) >= cutoff).cast("int").alias("prediction")
    return (
        rows.select(predicted, response)
        .groupBy("prediction")
        .agg(*[F.count_if(F.col(response) == v).alias(f"reference_{v}") for v in (0, 1)])
    )


def score_bucket_profile(
    rows: DataFrame, columns: Sequence[str], buckets: int, score: str = "score"
) -> DataFrame:
    """Mean of every covariate per equal-width score bucket, transposed.

    Buckets are closed on the left and the last one also on the right.
    """
    ends = rows.agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / buckets
    position = F.coalesce(F.floor(F.try_divide(F.col(score) - F.col("_lo"), width)), F.lit(0))
    bucketed = attach_scalars(rows.where(F.col(score).isNotNull()), ends).withColumn(
        "bucket", (F.least(position, F.lit(buckets - 1)) + 1).cast("int")
    )
    means = bucketed.groupBy("bucket").agg(*[F.avg(c).alias(c) for c in columns])
    return means.unpivot(["bucket"], list(columns), "variable", "mean_value")


# ---- correlation -------------------------------------------------------------------


#: Columns of a block of the cross-product matrix.
BLOCK = 64


def co_moments(rows: DataFrame, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Centred cross products (i, j, s, s_i, s_j) of the complete rows, i <= j.

    Columns travel as one array, which is written once: means and products read
    it, and plans over hundreds of column expressions stay short. They are centred by their means (p numbers,
    gathered first). The matrix is cut into blocks of column pairs; a task adds up each block over its rows and
    hands it on once, whatever their number, and blocks of the tasks are added up
    in a tree. The squares of both columns ride along with each pair.
    """
    p = len(columns)
    full = rows.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    full = stage(full.where(F.forall("x", lambda v: v.isNotNull())))

    def matrix(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(p + 1)
        for b in batches:
            if b.num_rows:
                total += np.append(matrix(b).sum(axis=0), b.num_rows)
        yield batch_of({0: total})

    sums = tree_sums(full.mapInArrow(summed, SCHEMA)).first()
    total = np.frombuffer(sums["total"]) if sums else np.zeros(p + 1)
    centre = total[:p] / max(total[p], 1)
    parts = -(-p // block)
    spans = [(a, min(p, a + block)) for a in range(0, p, block)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """X'X of a task, block by block, each with the squares of its columns."""
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if b.num_rows:
                x = matrix(b) - centre
                square = (x * x).sum(axis=0)
                for i, (a, z) in enumerate(spans):
                    for j, (c, e) in enumerate(spans[i:], i):
                        value = np.concatenate([(x[:, a:z].T @ x[:, c:e]).ravel(), square[a:z], square[c:e]])
                        k = i * parts + j
                        total[k] = total[k] + value if k in total else value
        if total:
            yield batch_of(total)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks as pairs."""
        for batch in batches:
            for k, raw in zip(batch.column("k").to_pylist(), batch.column("total").to_pylist(), strict=True):
                (a, z), (c, e) = spans[k // parts], spans[k % parts]
                value = np.frombuffer(raw)
                n = (z - a) * (e - c)
                i, j = (x.ravel() for x in np.meshgrid(np.arange(a, z), np.arange(c, e), indexing="ij"))
                s_i, s_j = value[n : n + z - a][i - a], value[n + z - a :][j - c]
                keep = i <= j
                columns_ = [i.astype("int32"), j.astype("int32"), value[:n], s_i, s_j]
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in columns_], names=["i", "j", "s", "s_i", "s_j"])

    return tree_sums(full.mapInArrow(partial, SCHEMA)).mapInArrow(cut, "i int, j int, s double, s_i double, s_j double")


def _pairs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return co_moments(rows, columns).select(
        "i", "j", F.try_divide("s", F.sqrt("s_i") * F.sqrt("s_j")).alias("corr")
    )


def corr_matrix(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson matrix as (var1, var2, corr), both triangles and the diagonal; a
    constant column has no correlation."""
    names = F.lit(list(columns))
    i, j = F.col("i"), F.col("j")
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    both = _pairs(rows, columns).select("corr", F.explode(F.array_distinct(F.array(pair(i, j), pair(j, i)))).alias("p"))
    return both.select(names[F.col("p.a")].alias("var1"), names[F.col("p.b")].alias("var2"), "corr")


def high_corr_pairs(rows: DataFrame, columns: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Pairs in column order with |r| above a threshold; ``drop_second`` marks
    pairs whose second member repeats the first."""
    names = F.lit(list(columns))
    r = F.abs("corr")
    found = _pairs(rows, columns).where((F.col("i") < F.col("j")) & (r > threshold))
    return found.select(
        names[F.col("i")].alias("var1"),
        names[F.col("j")].alias("var2"),
        "corr",
        known(r >= 1 - 1e-9).cast("int").alias("drop_second"),
    )


def corr_with_target(rows: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each variable with the target over complete pairs."""
    y = F.col(target).cast("double")

    def pair(c):
        return F.col(c).isNotNull() & y.isNotNull()

    measures = {
        "cov": lambda c: F.covar_pop(F.col(c).cast("double"), y),
        "sx": lambda c: F.stddev_pop(F.when(pair(c), F.col(c).cast("double"))),
        "sy": lambda c: F.stddev_pop(F.when(pair(c), y)),
    }
    return per_column(rows, columns, measures).select(
        "variable", F.try_divide("cov", F.col("sx") * F.col("sy")).alias("pearson")
    )


def spearman_with_target(rows: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Rank correlation of each variable with the target over complete pairs."""
    long = (
        rows.select(F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(c) for c in columns])
        .unpivot(["y"], list(columns), "variable", "x")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    pairs = long.groupBy("variable", "x", "y").agg(F.count(F.lit(1)).alias("n"))

    def ranks(v):
        counts = pairs.groupBy("variable", v).agg(F.sum("n").alias("n"))
        r = average_ranks(counts, v, "variable")
        # ranks have the known mean (N + 1) / 2
        return r.select("variable", v, (F.col("avg_rank") - (F.col("n_total") + 1) / 2).alias(f"r{v}"))

    joined = pairs.join(ranks("x"), ["variable", "x"]).join(ranks("y"), ["variable", "y"])
    n, rx, ry = F.col("n"), F.col("rx"), F.col("ry")
    spread = F.sqrt(F.sum(n * rx * rx)) * F.sqrt(F.sum(n * ry * ry))
    return joined.groupBy("variable").agg(F.try_divide(F.sum(n * rx * ry), spread).alias("spearman"))


# ---- covariate screens ----------------------------------------------------------------


def covariate_screen(
    rows: DataFrame, columns: Sequence[str], response: str = "response", min_positives: int = 10
) -> DataFrame:
    """Per covariate of the complete rows: constant, binary, number of positives
    and whether it is kept. A second pass tests for values strictly between the
    extremes, which needs no distinct count."""
    full = rows.dropna("any", subset=[*columns, response])
    ends = full.agg(
        *[F.min(c).cast("double").alias(f"_lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("double").alias(f"_hi{i}") for i, c in enumerate(columns)],
    )
    position = {c: i for i, c in enumerate(columns)}

    def between(c):
        i = position[c]
        return F.count_if((F.col(c) > F.col(f"_lo{i}")) & (F.col(c) < F.col(f"_hi{i}")))

    measures = {
        "lo": lambda c: F.min(c).cast("double"),
        "hi": lambda c: F.max(c).cast("double"),
        "n_between": between,
        "total": lambda c: F.sum(F.col(c).cast("double")),
    }
    found = per_column(attach_scalars(full, ends), columns, measures)
    constant = F.col("lo") == F.col("hi")
    binary = ~constant & (F.col("n_between") == 0)
    positives = F.when(binary, F.col("total"))
    return found.select(
        "variable",
        constant.cast("int").alias("is_constant"),
        binary.cast("int").alias("is_binary"),
        positives.alias("positives"),
        (~constant & ~known(positives < min_positives)).cast("int").alias("keep"),
    )


def odds_ratio_screen(rows: DataFrame, columns: Sequence[str], response: str = "response", limit: float = 10) -> DataFrame:
    """2x2 odds ratio of each binary covariate with the response; infinite or
    large ratios are marked for dropping."""
    y = F.col(response)

    def cell(x, r):
        return lambda c: F.count_if((F.col(c) == x) & (y == r))

    t = per_column(rows, columns, {"a": cell(1, 1), "b": cell(0, 1), "c": cell(1, 0), "d": cell(0, 0)})
    # as doubles: the product of two large counts would overflow a long
    top, bottom = F.col("a").cast("double") * F.col("d"), F.col("b").cast("double") * F.col("c")
    infinite = (bottom == 0) & (top > 0)
    return t.select(
        "variable",
        "a",
        "b",
        "c",
        "d",
        F.try_divide(top, bottom).alias("odds_ratio"),
        infinite.cast("int").alias("is_infinite"),
        (infinite | known(F.try_divide(top, bottom) > limit)).cast("int").alias("drop"),
    )


def complete_separation(rows: DataFrame, columns: Sequence[str], response: str = "response") -> DataFrame:
    """Range of each covariate by response, flagged where the ranges do not overlap."""

    def end(f, r):
        return lambda c: f(F.when(F.col(response) == r, F.col(c).cast("double")))

    t = per_column(
        rows,
        columns,
        {
            "min_response_0": end(F.min, 0),
            "min_response_1": end(F.min, 1),
            "max_response_0": end(F.max, 0),
            "max_response_1": end(F.max, 1),
        },
    )
    apart = (F.col("max_response_0") <= F.col("min_response_1")) | (
        F.col("max_response_1") <= F.col("min_response_0")
    )
    return t.withColumn("complete_separate", known(apart).cast("int"))


def gender_filter(rows: DataFrame) -> DataFrame:
    """Patients with exactly one known gender; one dummy is enough afterwards."""
    both = F.col("pat_gender_0_Max") + F.col("pat_gender_1_Max")
    return rows.where(both == 1).drop("pat_gender_1_Max")


def best_levels(aucs: DataFrame, parameters: Sequence[str], auc: str = "auc", by: Sequence[str] = ()) -> DataFrame:
    """Per parameter, the level with the highest mean AUC; ties to the lowest."""
    long = aucs.select(*by, auc, *[F.col(p).cast("double").alias(p) for p in parameters]).unpivot(
        [*by, auc], list(parameters), "parameter", "level"
    )
    means = long.groupBy(*by, "parameter", "level").agg(F.avg(auc).alias("mean_auc"))
    best = means.groupBy(*by, "parameter").agg(
        F.min(F.struct((-F.round("mean_auc", 12)).alias("neg"), F.col("level"))).alias("best")
    )
    return best.select(*by, "parameter", F.col("best.level").alias("level"), (-F.col("best.neg")).alias("mean_auc"))

