"""Column profiles of a table: all columns in one pass, long output.

The value-count table (column, value, n) is the one intermediate: distinct
counts, frequent and rare values, moments and medians all come from it, and
counting is combined map-side, so a value that fills a third of a column
arrives as one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampNTZType, TimestampType

from dosewise.functions import day_number, filled, one_of, parse_number, parse_stamp_text
from dosewise.functions.ranks import order_statistics
from dosewise.operators.joins import attach_scalars
from dosewise.session import stage

# Texts that stand for a missing value, compared in lower case.
SENTINELS = (
    "not recorded",
    "ni",
    "unable to obtain",
    "refused",
    "unable",
    "unble",
    "not specified",
    "unspecified",
    "n/a",
    "n\\a",
    "n i",
    "unknown",
    "unsure of usage",
    "0x",
    "1x",
    ".",
    "'",
    "none",
    "u",
    "unclassified",
)


def missing_profile(rows: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values per column, long."""
    columns = list(columns or rows.columns)
    shares = rows.agg(*[F.avg((~filled(F.col(c))).cast("int")).alias(c) for c in columns])
    return shares.unpivot([], columns, "variable", "missing_share")


def long_values(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value) with every value as text, missing ones included."""
    text = rows.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return text.unpivot([], list(columns), "variable", "value")


def text_counts(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(variable, value, kind, n), kind being blank, sentinel or value."""
    counts = long_values(rows, columns).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("kind", _kind(F.col("value"), sentinels))


def _kind(v: Column, sentinels: Sequence[str]) -> Column:
    return F.when(~filled(v), "blank").when(one_of(F.lower(v), sentinels), "sentinel").otherwise("value")


def kind_counts(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str]) -> DataFrame:
    """(variable, kind, key, n) where the text itself is not needed later: texts
    are counted under their SHA-256, so that they are not shuffled."""
    v = F.col("value")
    key = F.sha2(v, 256)
    return (
        long_values(rows, columns)
        .select("variable", _kind(v, sentinels).alias("kind"), key.alias("key"))
        .groupBy("variable", "kind", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _shares(total):
    n = {k: F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)) for k in ("value", "blank", "sentinel")}
    return [
        total.alias("total"),
        n["value"].alias("available"),
        F.try_divide(n["value"], total).alias("available_share"),
        n["blank"].alias("blank"),
        F.try_divide(n["blank"], total).alias("blank_share"),
        n["sentinel"].alias("sentinel"),
        F.try_divide(n["sentinel"], total).alias("sentinel_share"),
    ]


def profile_char(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Available, blank, sentinel and distinct values per text column."""
    return kind_counts(rows, columns, sentinels).groupBy("variable").agg(
        *_shares(F.sum("n")), F.count_if(F.col("kind") == "value").alias("distinct_values")
    )


def profile_date(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """As for text, with first and last date and distinct dates."""
    day = parse_stamp_text(F.col("value"))
    name = lambda c: F.upper(F.date_format(c, "ddMMMyyyy"))
    return (
        text_counts(rows, columns, sentinels)
        .groupBy("variable")
        .agg(
            *_shares(F.sum("n")),
            F.min(day).alias("first_date"),
            F.max(day).alias("last_date"),
            F.count_distinct(day).alias("distinct_dates"),
        )
        .withColumn("range", F.concat(name(F.col("first_date")), F.lit("--"), name(F.col("last_date"))))
    )


def profile_num(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """As for text, with mean, median, minimum and maximum of numeric texts."""
    counts = text_counts(rows, columns, sentinels).withColumn(
        "x", F.when(F.col("kind") == "value", parse_number(F.col("value")))
    )
    basics = counts.groupBy("variable").agg(
        *_shares(F.sum("n")),
        F.count_if(F.col("kind") == "value").alias("distinct_values"),
        F.try_divide(F.sum(F.col("x") * F.col("n")), F.sum(F.when(F.col("x").isNotNull(), F.col("n")))).alias("mean"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    numbers = counts.where(F.col("x").isNotNull()).groupBy("variable", "x").agg(F.sum("n").alias("n"))
    medians = order_statistics(numbers, "x", [50], "variable")
    return basics.join(medians.withColumnRenamed("p50", "median"), "variable", "left")


def sentinel_detail(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Count and share of each sentinel text found, most frequent first."""
    total = rows.agg(F.count(F.lit(1)).alias("_total"))
    found = text_counts(rows, columns, sentinels).where(F.col("kind") == "sentinel")
    return (
        attach_scalars(found, total)
        .select("variable", "value", F.col("n").alias("frequency"), F.try_divide("n", "_total").alias("share"))
        .orderBy("variable", F.col("frequency").desc(), "value")
    )


def top_bottom_values(rows: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most and k least frequent values per column, ties by value.

    Each side is a ranked limit per column, which Spark applies in every task
    before the shuffle, so only k rows per column and task travel. The counts
    are written once for both.
    """
    counts = stage(long_values(rows, columns).groupBy("variable", "value").agg(F.count(F.lit(1)).alias("frequency")))

    def side(name, order):
        w = Window.partitionBy("variable").orderBy(order, F.col("value").asc_nulls_first())
        return (
            counts.withColumn("rank", F.row_number().over(w))
            .where(F.col("rank") <= k)
            .withColumn("side", F.lit(name))
        )

    return side("top", F.col("frequency").desc()).unionByName(side("bottom", F.col("frequency").asc()))


#: Names of the column types in a summary.
TYPE_NAMES = {"text": "Character", "number": "Numeric", "date": "Date"}


def column_types(rows: DataFrame) -> dict[str, str]:
    """text, number or date for each column, by its own type."""
    kinds = ((NumericType, "number"), ((DateType, TimestampType, TimestampNTZType), "date"))
    return {f.name: next((k for t, k in kinds if isinstance(f.dataType, t)), "text") for f in rows.schema.fields}


def typed_counts(rows: DataFrame, types: Mapping[str, str], sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(variable, kind, key, x, n): the value counts of columns of any type.

    Texts are told apart by key, which is a text of less than 64 bytes itself and the
    SHA-256 of a longer one, numbers and dates by x, dates as days since 1970. A text column listed as number or date is read as one; what
    can't be read has no x but counts as a value.
    """
    def cell(c: str) -> Column:
        v, own = F.col(c), isinstance(rows.schema[c].dataType, StringType)
        text = v.cast("string")
        kind = _kind(text, sentinels) if own or types[c] == "text" else F.when(v.isNull(), "blank").otherwise("value")
        x = {
            "text": lambda: F.lit(None).cast("double"),
            "number": lambda: parse_number(v) if own else v.cast("double"),
            "date": lambda: day_number(parse_stamp_text(v) if own else v.cast("date")),
        }[types[c]]()
        short = F.when(F.octet_length(text) < 64, text).otherwise(F.sha2(text, 256))
        key = short if own or types[c] == "text" else F.lit(None).cast("string")
        return F.struct(kind.alias("kind"), key.alias("key"), F.when(kind == "value", x).alias("x")).alias(c)

    long = rows.select(*[cell(c) for c in types]).unpivot([], list(types), "variable", "cell")
    return long.groupBy("variable", "cell.kind", "cell.key", "cell.x").agg(F.count(F.lit(1)).alias("n"))


def table_summary(
    rows: DataFrame,
    columns: Sequence[str] | None = None,
    sentinels: Sequence[str] = SENTINELS,
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per column: position, type, counts and shares of available, blank
    and sentinel values, distinct values and the usual statistics: of numbers in
    min, max, mean, median and range, of dates in the columns that end in _date,
    with the range in days (mean and median fall on the day they reach).

    types lists the columns and what they are (text, number or date); without it
    the columns' own types count. All come from one table of value counts, which
    is written once for the statistics and the medians.
    """
    own = column_types(rows)
    types = dict(types) if types is not None else {c: own[c] for c in columns or rows.columns}
    if unknown := set(types.values()) - set(TYPE_NAMES):
        raise ValueError(f"unknown column types {sorted(unknown)}")
    counts = stage(typed_counts(rows, types, sentinels))
    x, n = F.col("x"), F.col("n")
    basics = counts.groupBy("variable").agg(
        *_shares(F.sum("n")),
        F.count_if(F.col("kind") == "value").alias("distinct_values"),
        F.min("x").alias("_min"),
        F.max("x").alias("_max"),
        F.try_divide(F.sum(x * n), F.sum(F.when(x.isNotNull(), n))).alias("_mean"),
    )
    numbers = counts.where(x.isNotNull()).groupBy("variable", "x").agg(F.sum("n").alias("n"))
    medians = order_statistics(numbers, "x", [50], "variable").withColumnRenamed("p50", "_median")
    about = F.create_map(*[
        v for i, (c, t) in enumerate(types.items(), 1)
        for v in (F.lit(c), F.struct(F.lit(i).alias("position"), F.lit(t).alias("type")))
    ])
    out = basics.join(medians, "variable", "left").withColumn("_is", about[F.col("variable")])
    is_number, is_date = F.col("_is.type") == "number", F.col("_is.type") == "date"
    names = ("min", "max", "mean", "median")
    listed = F.when(F.col("_is.type") == "text", " , ".join(sentinels)).otherwise("")
    return out.select(
        *[c for c in basics.columns if not c.startswith("_")],
        *[F.when(is_number, F.col(f"_{m}")).alias(m) for m in names],
        F.when(is_number | is_date, F.col("_max") - F.col("_min")).alias("range"),
        *[F.when(is_date, F.date_from_unix_date(F.floor(f"_{m}").cast("int"))).alias(f"{m}_date") for m in names],
        F.create_map(*[F.lit(v) for pair in TYPE_NAMES.items() for v in pair])[F.col("_is.type")].alias("type"),
        listed.alias("sentinel_list"),
        F.col("_is.position").alias("position"),
    ).orderBy("position")
