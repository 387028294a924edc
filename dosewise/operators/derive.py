"""Row-level derivations and filters."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dosewise.functions import below, date_to_int, filled, flag, known, one_of, parse_date_int, parse_number
from dosewise.functions.ranks import hash_row_number
from dosewise.session import stage

# Molecule stems and ATC classes behind the therapy flags, and the
# physician specialty codes.
ANTIPLATELET_STEMS = ("ticagrelor", "prasugrel", "clopidogrel", "ticlopidin")
ATC_FLAGS = {
    "ace_inhibitors": ("C09A", "C09B"),
    "beta_blockers": ("C07A", "C07B"),
    "diabetes_insulin": ("A10C",),
    "diabetes_other": ("A10H", "A10J", "A10K", "A10L", "A10M", "A10N", "A10P", "A10S"),
}
GP_CODES = ("11", "34")
UNKNOWN_CODES = ("60", "90")
UNKNOWN_GENDER = 999

THERAPIES = ("oral_anti_platelet", *ATC_FLAGS, "other_drugs")
COST_NAMES = {t: "oap" if t == "oral_anti_platelet" else t for t in THERAPIES}


def add_trans_date(rows: DataFrame, source: str = "transactiondate", name: str = "trans_date") -> DataFrame:
    return rows.withColumn(name, parse_date_int(F.col(source)))


def add_date_int(rows: DataFrame, source: str, name: str) -> DataFrame:
    return rows.withColumn(name, date_to_int(F.col(source)))


def therapy_flags(
    rows: DataFrame, stems: Sequence[str] = ANTIPLATELET_STEMS, blank_atc_is_other: bool = False
) -> DataFrame:
    """0/1 flag per therapy group.

    ``other_drugs`` marks a non-market row of no group. It stays missing for a
    blank ATC code unless ``blank_atc_is_other`` asks for the second variant.
    """
    molecule = F.lower("mol1")
    found = F.lit(False)
    for s in stems:
        found = found | molecule.contains(s)
    cls = F.substring(F.trim("atc"), 1, 4)
    out = rows.withColumns(
        {
            "oral_anti_platelet": flag(found),
            **{name: one_of(cls, codes).cast("int") for name, codes in ATC_FLAGS.items()},
        }
    )
    none = F.col("market") == 0
    for t in THERAPIES[:-1]:
        none = none & (F.col(t) == 0)
    other = flag(none)
    if not blank_atc_is_other:
        other = F.when(filled(F.col("atc")), other)
    return out.withColumn("other_drugs", other)


def therapy_cost_trx(rows: DataFrame, trx: int = 1) -> DataFrame:
    """Cost and transaction count per therapy flag, 0 where the flag is off."""
    cost = F.col("rsp") * F.col("units")
    new = {}
    for t, short in COST_NAMES.items():
        on = known(F.col(t) == 1)
        new[f"{short}_cost"] = F.when(on, cost).otherwise(F.lit(0.0))
        new[f"{short}_trx"] = F.when(on, F.lit(trx)).otherwise(F.lit(0))
    return rows.withColumns(new)


def drop_early_market(rows: DataFrame, start: str) -> DataFrame:
    """Delete market rows before ``start``; a missing date counts as before."""
    early = below(F.col("trans_date"), F.lit(start).cast("date"))
    return rows.where(~known(early & (F.col("market") == 1)))


def atc_levels(rows: DataFrame) -> DataFrame:
    code = F.ltrim("atc")
    return rows.withColumns({"atc2": F.substring(code, 1, 3), "atc3": F.substring(code, 1, 4)})


def recode_molecule(
    rows: DataFrame,
    by_product: Mapping[str, str],
    synonyms: Mapping[str, str] = {},
    baseline: str | None = None,
    fill_by_product: Mapping[str, str] = {},
) -> DataFrame:
    """Molecule with overrides: per product, per product only where missing,
    per synonym; the baseline molecule becomes missing."""
    m = F.when(filled(F.col("mol1")), F.col("mol1"))
    for prod, name in fill_by_product.items():
        m = F.when(m.isNull() & known(F.col("prod") == prod), F.lit(name)).otherwise(m)
    for prod, name in by_product.items():
        m = F.when(F.col("prod") == prod, F.lit(name)).otherwise(m)
    for old, name in synonyms.items():
        m = F.when(m == old, F.lit(name)).otherwise(m)
    if baseline is not None:
        m = F.when(m == baseline, F.lit(None)).otherwise(m)
    return rows.withColumn("molecule", m)


def specialty_group(c: Column) -> Column:
    """GP / Unknown / Non-GP of a specialty code; missing is Unknown."""
    return (
        F.when(c.isin(*GP_CODES), "GP")
        .when(~filled(c) | c.isin(*UNKNOWN_CODES), "Unknown")
        .otherwise("Non-GP")
    )


def clean_name(text: object) -> str:
    return re.sub(r"[^A-Za-z0-9_]", "_", str(text))


def levels_of(rows: DataFrame, column: str, limit: int = 1000) -> list:
    """Sorted distinct levels of a categorical column.

    They become column names, so there must be few of them; more than ``limit``
    is an error, never a silent cut.
    """
    found = rows.select(column).where(F.col(column).isNotNull()).distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{column} has more than {limit} levels; use sparse_dummies, columns are for few")
    return sorted(r[0] for r in found)


def level_dictionary(levels: DataFrame) -> DataFrame:
    """(family, level, number) of the distinct levels, numbered from 0 in hash order
    within their family; made by the cluster, for any number of levels."""
    distinct = levels.select("family", "level").where(F.col("level").isNotNull()).distinct()
    numbered = hash_row_number(distinct.withColumn("_d", F.md5("level")), ["family"], "_d", "level", "number")
    return numbered.select("family", "level", (F.col("number") - 1).alias("number"))


def sparse_dummies(levels: DataFrame, key: str = "p_id") -> DataFrame:
    """(key, family, width, numbers): one sparse 0/1 vector a key and family from
    rows (key, family, level), the sorted numbers of the levels that are 1.

    The form of dummies for columns of any number of levels; ``one_hot`` makes
    columns of a few.
    """
    dictionary = stage(level_dictionary(levels))
    width = dictionary.groupBy("family").agg(F.count(F.lit(1)).alias("width"))
    rows = levels.select(key, "family", "level").join(dictionary, ["family", "level"])
    vectors = rows.groupBy(key, "family").agg(F.array_sort(F.collect_set("number")).alias("numbers"))
    return vectors.join(width, "family").select(key, "family", "width", "numbers")


def one_hot(rows: DataFrame, column: str, prefix: str, levels: Sequence | None = None) -> DataFrame:
    """A 0/1 column per level; levels are looked up unless they are given."""
    levels = levels_of(rows, column) if levels is None else levels
    return rows.withColumns({f"{prefix}{clean_name(v)}": flag(F.col(column) == v) for v in levels})


def fixed_dummies(
    rows: DataFrame, column: str, prefix: str, codes: Sequence, market_prefix: str | None = None
) -> DataFrame:
    """Dummies for a fixed code list, optionally a second set for market rows."""
    new = {f"{prefix}{c}": flag(F.col(column) == c) for c in codes}
    if market_prefix is not None:
        new |= {
            f"{market_prefix}{c}": flag((F.col(column) == c) & (F.col("market") == 1)) for c in codes
        }
    return rows.withColumns(new)


def fill_missing(rows: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return rows.fillna(dict(values))


def persistence_labels(rows: DataFrame, days: str = "capped_days_treatment", months: Sequence[int] = (3, 6, 9)) -> DataFrame:
    """1 where the capped treatment days reach the number of 30-day months."""
    return rows.withColumns(
        {f"persistence_{m}m": flag(F.col(days) / 30 >= m) for m in months}
    )


def split_outputs(rows: DataFrame) -> DataFrame:
    """Label each row pre_index / invalid / market_only; every row is kept.

    A row before the index date is ``pre_index`` unless it is a market row,
    which is ``invalid``. A missing transaction date is before any index date.
    """
    t, i = F.col("trans_date"), F.col("index_date")
    before = known(t < i) | (t.isNull() & i.isNotNull())
    return rows.withColumn(
        "stage",
        F.when(before & (F.col("market") == 0), "pre_index").when(before, "invalid").otherwise("market_only"),
    )


def numbers_from_text(rows: DataFrame, columns: Sequence[str], sentinels: Sequence[str] = ()) -> DataFrame:
    """Text columns to numbers; sentinel texts and anything unreadable are missing."""
    new = {}
    for c in columns:
        text = F.col(c)
        if sentinels:
            text = F.when(~one_of(F.lower(text), sentinels), text)
        new[c] = parse_number(text)
    return rows.withColumns(new)


def code_flag_and_drop(
    rows: DataFrame, code: str, name: str, required: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Y/N code to 1/0, rows without a required value deleted, columns dropped."""
    out = rows.withColumn(name, F.when(F.col(code) == "Y", 1).when(F.col(code) == "N", 0))
    for c in required:
        out = out.where(filled(F.col(c)))
    return out.drop(*drop)


def row_missing_count(rows: DataFrame, columns: Sequence[str], name: str = "n_missing") -> DataFrame:
    """Number of missing values per row over ``columns``; blanks are missing."""
    n = F.lit(0)
    for c in columns:
        n = n + (~filled(F.col(c))).cast("int")
    return rows.withColumn(name, n)


def any_filled(columns: Sequence[str]) -> Column:
    return F.coalesce(*[F.when(filled(F.col(c)), F.lit(True)) for c in columns], F.lit(False))


def select_by_regex(rows: DataFrame, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    found = [c for c in rows.columns if re.search(pattern, c) and c not in keep]
    return rows.select(*keep, *found)


def pre_index_window(rows: DataFrame, days: int | None = 360) -> DataFrame:
    """Rows in [index - days, index); ``days=None`` keeps the whole history."""
    t, i = F.col("trans_date"), F.col("index_date")
    out = rows.where(t < i)
    return out if days is None else out.where(t >= F.date_sub(i, days))


def rename_retype(rows: DataFrame, names: Mapping[str, str], to_text: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    out = rows.drop(*drop).withColumns({c: F.col(c).cast("string") for c in to_text})
    return out.withColumnsRenamed(dict(names))
